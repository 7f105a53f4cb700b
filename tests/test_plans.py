"""Physical-plan properties that the scale design relies on."""

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"


def plan(spark, name):
    df = E.queries()[name](spark, SF)
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_cartesian_products_in_single_person_plans(spark):
    for name in ["i8_flagship_unseen_ranked", "c9_nearest_rated", "h21_vibe_pct", "c10_closest_for_pair"]:
        assert "CartesianProduct" not in plan(spark, name), name


def test_pushdown_pruning_and_top_k(spark):
    p = plan(spark, "f2_unseen_best_for_a")
    assert "TakeOrderedAndProject" in p
    assert "EqualTo(l_returnflag,R)" in p                 # seen filter reaches the scan
    assert "In(c_mktsegment, [AUTOMOBILE,BUILDING])" in p  # person filter pushed through the pivot
    assert "l_tax" not in p and "l_comment" not in p       # column pruning


def test_entity_encodings_are_aggregates_not_windows(spark):
    p = plan(spark, "e1_leave_one_out")
    assert "Window" not in p
    assert "HashAggregate" in p


def test_dedupe_is_an_aggregate(spark):
    p = plan(spark, "e2_dedupe_keep_first")
    assert "Window" not in p
    assert "Aggregate" in p


def test_nearest_rated_reads_the_history_once(spark):
    """History and matches are stored, not made anew for each use."""
    for name in ["c9_nearest_rated", "c10_closest_for_pair"]:
        p = plan(spark, name)
        assert "lineitem" not in p, name
        assert p.count("FlatMapCoGroupsInPandas") <= (name == "c9_nearest_rated"), name


def test_history_of_some_titles(spark):
    """Other titles' line items go before the joins."""
    from reelrank.plans import views as V
    t = V.Tables(spark, SF)
    some = t.part.filter("p_partkey % 7 = 0").selectExpr("p_partkey AS title_id")
    part = V.history(t, "rating", titles=some.union(some))
    want = V.history(t, "rating").filter("title_id % 7 = 0").collect()
    assert sorted(part.collect()) == sorted(want) and want
    assert "LeftSemi" in part._jdf.queryExecution().optimizedPlan().toString()


def test_preferences_and_prompts_read_the_history_once(spark):
    """History, titles and the small tables of D7 are stored: neither is the plan of each use kept by the driver."""
    for name in ["d7_preference_stats", "b8_narrative_prompts"]:
        p = plan(spark, name)
        assert "lineitem" not in p, name
