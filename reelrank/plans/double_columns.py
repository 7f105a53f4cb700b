"""Double-typed output columns of the oracle-checked queries.

Both the Spark result and the oracle SQL round these to 6 decimals, so a
last-bit difference between the engines never reaches a value hash.
``tests/test_oracle.py`` checks this list against the Spark schemas.
"""

DOUBLE_COLUMNS = {
    'b5_full_cards': ['imdb'],
    'b6_full_details': ['imdb'],
    'i2_trained_vectors': ['norm'],
    'f2_deep_page': ['a_pct', 'b_pct', 'imdb_score'],
    'a10_saved_metrics': ['mae', 'r2'],
    'a9_saved_entity_stats': ['avg'],
    'i6_current_model': ['mae', 'r2'],
    'a1_ingest_ratings': ['rating'],
    'a2_flatten_metadata': ['imdb_rating', 'metascore', 'box_office', 'rt_score', 'award_wins', 'award_noms', 'oscar_win', 'oscar_nom'],
    'b1_clean_training_rows': ['rating'],
    'b2_filter_catalog_desktop': ['imdb_score', 'a_pct', 'b_pct'],
    'b2_filter_catalog_web': ['imdb_score', 'a_pct', 'b_pct'],
    'b3_filter_watched_and': ['imdb_score', 'a_pct', 'b_pct'],
    'b3_filter_watched_or': ['imdb_score', 'a_pct', 'b_pct'],
    'b4_filter_genre': ['imdb'],
    'b5_catalog_cards': ['imdb'],
    'c10_closest_for_pair': ['a_sim', 'a_rating', 'b_sim', 'b_rating'],
    'c6_lookup_entity_stats': ['director_avg_rating', 'actor1_avg_rating', 'studio_avg_rating'],
    'c8_attach_scores': ['pct'],
    'c9_nearest_rated': ['similarity', 'match_rating'],
    'd10_feature_importance': ['importance'],
    'd11_coverage_report': ['pct_ok'],
    'd1_overall_average': ['overall_avg'],
    'd1_person_scores': ['pct'],
    'd2_median_impute': ['runtime', 'box_office'],
    'd3_standardise': ['runtime', 'rating'],
    'd4_entity_stats': ['avg'],
    'd5_tag_frequency': ['freq'],
    'd7_preference_stats': ['avg_overall', 'genre_avg', 'director_avg', 'top_tag_avg'],
    'd8_taste_centroid': ['value'],
    'i6_promote_if_better': ['new_mae', 'new_r2', 'cur_mae', 'cur_r2'],
    'd9_regression_metrics': ['mae', 'rmse', 'r2'],
    'e1_leave_one_out': ['rating', 'director_avg_rating', 'actor1_avg_rating', 'studio_avg_rating'],
    'e2_dedupe_keep_first': ['rating'],
    'e2_dedupe_keep_last': ['rating'],
    'e3_top_drivers': ['contrib'],
    'e4_top_signed': ['contrib'],
    'e5_argmax_per_key': ['rating'],
    'e6_stratified_split': ['rating'],
    'f1_page_compat': ['a_pct', 'b_pct', 'imdb_score'],
    'f1_page_imdb_second': ['a_pct', 'b_pct', 'imdb_score'],
    'f1_page_year': ['a_pct', 'b_pct', 'imdb_score'],
    'f2_page_web_b': ['a_pct', 'b_pct', 'imdb_score'],
    'f2_unseen_best_for_a': ['a_pct', 'b_pct', 'imdb_score'],
    'g4_merge_catalog': ['imdb_score'],
    'h21_vibe_pct': ['vibe_pct'],
    'a10_samples_checked': ['rating'],
    'i1_build_features': ['rating', 'slot_sum', 'slot_places'],
    'i2_embed_text': ['norm'],
    'i3_evaluation_checked': ['baseline_mae'],
    'i5_standin_contributions': ['value', 'contrib'],
    'i8_precompute_checked': ['similarity'],
    'i8_flagship_unseen_ranked': ['pct', 'similarity', 'vibe_pct'],
    'k2_incremental_score': ['pct'],
}
