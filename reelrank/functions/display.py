"""Display and scoring expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed import (CONFIDENCE_BANDS, CONFIDENCE_DEFAULT, SIM_DISPLAY_CEIL,
                    VERDICT_BANDS, VERDICT_DEFAULT)
from .nulls import _c


# H17 "2h 5m" / "45m" / "N/A"
def runtime_text(c) -> Column:
    m = _c(c).cast("int")
    h = F.floor(m / 60).cast("int")
    r = (m % 60).cast("int")
    return (F.when(m.isNull(), "N/A")
             .when(h > 0, F.format_string("%dh %dm", h, r))
             .otherwise(F.format_string("%dm", r)))


def _plural(n, word):
    return F.concat(n.cast("string"), F.lit(" " + word), F.when(n != 1, "s").otherwise(""))


# H18 award text; the Oscar "count" is the 0/1 flag, as in the source.
def award_text(oscar_win, oscar_nom, award_wins, award_noms) -> Column:
    ow, on, aw, an = [F.coalesce(_c(x), F.lit(0)).cast("int")
                      for x in (oscar_win, oscar_nom, award_wins, award_noms)]
    noms = lambda n: F.when(n != 0, F.concat(F.lit(" / "), _plural(n, "nom"))).otherwise("")
    return (F.when(ow != 0, F.concat(_plural(ow, "Oscar"), noms(on)))
             .when(on != 0, _plural(on, "Oscar nom"))
             .when(aw != 0, F.concat(_plural(aw, "win"), noms(an)))
             .when(an != 0, _plural(an, "nomination")))


def _bands(c, bands, default):
    x = _c(c)
    expr = None
    for lo, label in bands:
        expr = F.when(x >= lo, label) if expr is None else expr.when(x >= lo, label)
    return expr.otherwise(default)


# H19 confidence bands (card) and verdict bands (desktop)
def confidence(c) -> Column:
    return _bands(c, CONFIDENCE_BANDS, CONFIDENCE_DEFAULT)


def verdict(c) -> Column:
    return _bands(c, VERDICT_BANDS, VERDICT_DEFAULT)


# H20 match %: clip 1-10, x10, one decimal (half-even)
def match_pct(pred) -> Column:
    return F.bround(F.least(F.greatest(_c(pred), F.lit(1.0)), F.lit(10.0)) * 10, 1)


def clip_rating(pred) -> Column:
    return F.least(F.greatest(_c(pred), F.lit(1.0)), F.lit(10.0))


# array helpers used by H21 and C9
def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda acc, v: acc + v)


def norm(a) -> Column:
    return F.sqrt(F.aggregate(_c(a), F.lit(0.0),
                              lambda acc, v: acc + v.cast("double") * v.cast("double")))


def cosine(a, b) -> Column:
    den = norm(a) * norm(b)
    return F.when(den > 0, dot(a, b) / den).otherwise(F.lit(0.0))


# H21 vibe %: (cosine to centroid + 1) / 2 * 100, clipped, one decimal
def vibe_pct(vec, centroid) -> Column:
    pct = (cosine(vec, centroid) + 1) / 2 * 100
    return F.bround(F.least(F.greatest(pct, F.lit(0.0)), F.lit(100.0)), 1)


# H22 similarity % for display: min(100, floor(sim / 0.65 * 100)); API form sim*100
def similarity_pct(sim) -> Column:
    return F.least(F.lit(100), F.floor(_c(sim) / SIM_DISPLAY_CEIL * 100).cast("int"))


def similarity_pct_api(sim) -> Column:
    return F.bround(F.coalesce(_c(sim), F.lit(0.0)) * 100, 0).cast("int")


def decimal_round(x, digits: int) -> Column:
    """Half-even rounding to ``digits`` decimals, defined on the value taken
    to nine decimals: the value is scaled to an integer count of 1e-9 units
    and the tie rule is applied in integer arithmetic, so the result never
    depends on how an engine rounds a binary product.  Magnitudes of 1e9 and
    more (where a double has no digits left to tie on) use plain rounding.
    Returns a double; ``sql_decimal_round`` is the same rule in SQL."""
    x = _c(x)
    unit = 10 ** (9 - digits)
    # floor(y + 0.5) on the IEEE product: identical in every engine, and cheap
    v = F.floor(F.when(F.abs(x) < 1e9, x) * F.lit(1e9) + F.lit(0.5))
    a = F.abs(v)
    q = (a / F.lit(unit)).cast("long")               # exact: non-negative
    r = a - q * F.lit(unit)
    up = (r > unit // 2) | ((r == unit // 2) & (q % 2 == 1))
    q2 = (q + F.when(up, 1).otherwise(0)) / F.lit(float(10 ** digits))
    small = F.when(v < 0, -q2).otherwise(q2)
    return F.when(x.isNull(), F.lit(None).cast("double")) \
            .when(F.abs(x) < 1e9, small).otherwise(F.round(x, digits))


def sql_decimal_round(col: str, digits: int) -> str:
    """SQL twin of :func:`decimal_round` (DuckDB)."""
    unit = 10 ** (9 - digits)
    y = f"floor({col} * 1e9 + 0.5)"
    a = f"CAST(abs({y}) AS BIGINT)"
    q = f"({a} // {unit})"
    up = f"CASE WHEN {a} % {unit} > {unit // 2} OR ({a} % {unit} = {unit // 2} AND {q} % 2 = 1) THEN 1 ELSE 0 END"
    small = f"(CASE WHEN {y} < 0 THEN -1 ELSE 1 END * ({q} + {up}) / {float(10 ** digits)})"
    return f"(CASE WHEN {col} IS NULL THEN NULL WHEN abs({col}) < 1e9 THEN {small} ELSE round({col}, {digits}) END)"


def hundredths(x) -> Column:
    """Two-decimal :func:`decimal_round` (driver contributions in prompts)."""
    return decimal_round(x, 2)
