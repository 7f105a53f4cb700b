"""Parsing rules as Column expressions.

All are built-in functions, so they compile into whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed import (COUNTRY_NAMES, DECADE_COLUMNS, RATED_BUCKETS, RATED_ONE_HOT,
                    SEVERITY_ORDINAL)
from .nulls import _c, first_item


# H1 "142 min" -> 142
def runtime_minutes(c) -> Column:
    return F.split(F.trim(_c(c)), r"\s+").getItem(0).try_cast("int")


# H2 "$94,074,173" -> 94074173.0
def money(c) -> Column:
    return F.regexp_replace(_c(c), r"[$,]", "").try_cast("double")


# H3 "1,234,567" -> 1234567
def votes(c) -> Column:
    return F.regexp_replace(_c(c), ",", "").try_cast("bigint")


# H4 first Ratings entry from the given source, "%" removed
def critic_score(ratings, source: str = "Rotten Tomatoes") -> Column:
    hit = F.filter(_c(ratings), lambda r: r["Source"] == F.lit(source))
    return F.regexp_replace(F.get(hit, 0)["Value"], "%", "").try_cast("double")


def _sum_of_counts(c, word: str) -> Column:
    found = F.regexp_extract_all(F.coalesce(_c(c), F.lit("")),
                                 F.lit(r"(?i)(\d+)\s+" + word), F.lit(1))
    return F.aggregate(found, F.lit(0.0), lambda acc, x: acc + x.cast("double"))


# H5 award signals from free text
def award_columns(c) -> dict[str, Column]:
    s = F.coalesce(_c(c), F.lit(""))
    return {
        "award_wins": _sum_of_counts(s, "win"),
        "award_noms": _sum_of_counts(s, "nomination"),
        "oscar_win": F.when(s.rlike(r"(?i)\bwon\b.*\boscar"), 1.0).otherwise(0.0),
        "oscar_nom": F.when(s.rlike(r"(?i)\bnominat") & s.rlike(r"(?i)\boscar"), 1.0)
                      .otherwise(0.0),
    }


# H6 clean year: first run of 4 digits, else 2000
def clean_year(c) -> Column:
    y = F.regexp_extract(F.coalesce(_c(c).cast("string"), F.lit("")), r"(\d{4})", 1)
    return F.coalesce(F.nullif(y, F.lit("")).try_cast("int"), F.lit(2000))


def decade_columns(year_col) -> dict[str, Column]:
    d = F.floor(clean_year(year_col) / 10) * 10
    bounds = [None, 1970, 1980, 1990, 2000, 2010, None]
    out = {}
    for name, b in zip(DECADE_COLUMNS, bounds):
        if name == "decade_pre1970s":
            cond = d < 1970
        elif name == "decade_2020s":
            cond = d >= 2020
        else:
            cond = d == b
        out[name] = cond.cast("int")
    return out


# H7 content rating -> bucket -> 5 one-hots
def rated_bucket(c) -> Column:
    m = F.create_map(*[F.lit(x) for kv in RATED_BUCKETS.items() for x in kv])
    return F.coalesce(F.element_at(m, _c(c)), F.lit("NR"))


def rated_columns(c) -> dict[str, Column]:
    b = rated_bucket(c)
    return {f"rated_{k}": (b == k).cast("int") for k in RATED_ONE_HOT}


# H8 primary language flags
def language_columns(c) -> dict[str, Column]:
    p = F.coalesce(first_item(c), F.lit(""))
    return {"lang_english": (p == "English").cast("int"),
            "lang_hindi": (p == "Hindi").cast("int"),
            "lang_other": (~p.isin("English", "Hindi")).cast("int")}


# H9 country flags (case ignored, not exclusive)
def country_columns(c) -> dict[str, Column]:
    s = F.lower(F.coalesce(_c(c), F.lit("")))
    out = {k: s.contains(v).cast("int") for k, v in COUNTRY_NAMES.items()}
    out["country_other"] = (~(s.contains("united states") | s.contains("united kingdom")
                              | s.contains("india"))).cast("int")
    return out


# H10 genre list (Unknown gives no genre)
def genre_list(c) -> Column:
    items = F.transform(F.split(F.coalesce(_c(c), F.lit("")), ","), lambda x: F.trim(x))
    return F.filter(items, lambda x: ~x.isin("", "N/A", "Unknown"))


# H11 safe tag column name
def tag_column_name(category, value) -> Column:
    v = _c(value)
    for a, b in (("&", "and"), ("/", "_"), (" ", "_"), ("-", "_")):
        v = F.replace(v, F.lit(a), F.lit(b))
    return F.concat(F.lit("tag_"), _c(category), F.lit("_"), v)


def tag_column_name_py(category: str, value: str) -> str:
    safe = value.replace("&", "and").replace("/", "_").replace(" ", "_").replace("-", "_")
    return f"tag_{category}_{safe}"


# H12 primary entities
def primary_director(director) -> Column:
    return first_item(director)


def primary_actor(cast_list, actors) -> Column:
    return F.coalesce(first_item(cast_list), first_item(actors))


def studio_key(studio, production=None) -> Column:
    s = F.trim(_c(studio))
    s = F.when(s.isin("", "N/A"), None).otherwise(s)
    if production is not None:
        p = F.trim(_c(production))
        s = F.coalesce(s, F.when(p.isin("", "N/A"), None).otherwise(p))
    return F.coalesce(s, F.lit("Unknown"))


# H13 text used for the plot embedding
def enriched_text(director, actors, writer, plot, title) -> Column:
    def part(c, label):
        t = F.trim(F.coalesce(_c(c), F.lit("")))
        return F.when((t != "") & ~t.isin("N/A", "Unknown"),
                      F.concat(F.lit(label + ": "), t, F.lit(".")))
    d, a, w = part(director, "Director"), part(actors, "Cast"), part(writer, "Writer")
    p = F.trim(F.coalesce(_c(plot), F.lit("")))
    p = F.when((p != "") & (p != "N/A"), p)
    body = F.concat_ws(" ", d, a, w, p)
    return F.when(body == "", F.coalesce(_c(title), F.lit(""))).otherwise(body)


# H14 title normalisation
def normalise_title(c) -> Column:
    t = F.regexp_replace(_c(c), r"(?<=[A-Za-z])['‘’`](?=[A-Za-z])", "")
    t = F.regexp_replace(t, r"[\-,!?.;:]+", " ")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


# H15 run-together word variants: for each alphabetic word longer than 5
# letters, split it at positions max(3, n-4) .. n-3; only the first
# occurrence of the word in the text is changed.
def word_split_variants(c) -> Column:
    base = _c(c)

    def per_word(w):
        n = F.length(w)
        at = F.instr(base, w)
        positions = F.when(w.rlike(r"^\p{L}+$") & (n > 5),
                           F.sequence(F.greatest(F.lit(3), n - 4), n - 3)) \
                     .otherwise(F.array().cast("array<int>"))
        return F.transform(positions, lambda pos: F.concat(
            F.substr(base, F.lit(1), at - 1),
            F.substr(w, F.lit(1), pos), F.lit(" "), F.substr(w, pos + 1, n),
            F.substr(base, at + n, F.length(base))))
    return F.array_distinct(F.flatten(F.transform(F.split(base, " "), per_word)))


# H16 page slug
def slug(c) -> Column:
    s = F.lower(_c(c))
    s = F.regexp_replace(s, "['‘’]", "")
    s = F.regexp_replace(s, "[^a-z0-9 ]", "_")
    s = F.regexp_replace(F.trim(s), r"\s+", "_")
    s = F.regexp_replace(s, "_+", "_")
    return F.regexp_replace(s, "_+$", "")


# H24 service key from a provider name (first matching rule wins)
def service_key(name) -> Column:
    n = F.lower(F.trim(F.coalesce(_c(name), F.lit(""))))
    nospace = F.replace(n, F.lit(" "), F.lit(""))
    has = n.contains
    return (F.when(has("netflix"), "netflix")
             .when(n.isin("max", "hbo max") | (has("max") & ~has("starz") & ~has("showmax")
                                                & ~has("amazon") & ~has("paramount")), "max")
             .when((has("prime video") | (has("amazon") & has("prime"))) & ~has("channel"), "prime")
             .when(has("disney") & has("plus"), "disney")
             .when(has("disney+"), "disney")
             .when((n == "hulu") | (has("hulu") & ~has("live")), "hulu")
             .when(nospace.contains("appletv+") | (has("apple") & has("tv") & has("+")), "apple")
             .when(has("peacock"), "peacock")
             .when(has("paramount") & (has("plus") | has("+")), "paramount"))


# H25 content type
def content_type(c) -> Column:
    t = F.lower(F.coalesce(_c(c), F.lit("")))
    return F.when(t.contains("series") | t.contains("episode") | t.contains("mini"), "tv") \
            .otherwise("movie")


# H27 severity validation: title-case, one of four levels
def clean_severity(c) -> Column:
    v = F.initcap(F.trim(_c(c)))
    return F.when(v.isin(*SEVERITY_ORDINAL.keys()), v)


# H28 severity ordinal; unknown -> default (-1 for features, 0 in details)
def severity_ordinal(c, default: int = -1) -> Column:
    m = F.create_map(*[F.lit(x) for kv in SEVERITY_ORDINAL.items() for x in kv])
    return F.coalesce(F.element_at(m, _c(c)), F.lit(default))
