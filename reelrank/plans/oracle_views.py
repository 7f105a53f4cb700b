"""SQL twins of :mod:`reelrank.plans.views` for the DuckDB oracle.

``with_views(sql, *names)`` prefixes a query with the CTEs it needs.
"""

from __future__ import annotations

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "rated": ((), """
        SELECT c.c_mktsegment AS user_id, l.l_partkey AS title_id, l.l_suppkey AS director_id,
               CAST(CAST(l.l_quantity AS BIGINT) % 10 + 1 AS DOUBLE) AS rating,
               CAST(year(l.l_shipdate) AS INTEGER) AS year, l.l_returnflag,
               l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_extendedprice
        FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
                        JOIN customer c ON o.o_custkey = c.c_custkey"""),
    "history": (("rated",), """
        SELECT * EXCLUDE (_rn) FROM (
          SELECT *, row_number() OVER (PARTITION BY user_id, title_id
              ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS _rn
          FROM rated) WHERE _rn = 1"""),
    "seen": (("rated",), """
        SELECT DISTINCT user_id, title_id FROM rated WHERE l_returnflag = 'R'"""),
    "titles": ((), """
        SELECT p_partkey AS title_id, p_name AS title, p_brand AS studio, p_type AS genre,
               p_size AS runtime, p_retailprice AS box_office FROM part"""),
    "listing": ((), """
        SELECT l.l_partkey AS title_id, r.r_name AS service, r.r_regionkey AS service_rank,
               l.l_orderkey, l.l_linenumber
        FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey
                        JOIN nation n ON s.s_nationkey = n.n_nationkey
                        JOIN region r ON n.n_regionkey = r.r_regionkey"""),
    "catalog_base": ((), """
        SELECT p_partkey AS title_id, p_name AS title,
               CASE WHEN p_type IN ('PROMO', 'SMALL') THEN 'tv' ELSE 'movie' END AS type,
               (p_retailprice - 900.0) / 10.0 AS imdb_score,
               CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_size * 2 + 1940 END AS year,
               p_size AS runtime, p_type AS genre, p_brand AS studio
        FROM part"""),
    "title_info": ((), """
        SELECT p.p_partkey AS title_id, p.p_name AS title, CAST(f.sup AS VARCHAR) AS director,
               replace(p.p_name, ' ', ', ') AS actors, p.p_brand AS studio, p.p_type AS genre,
               p.p_size AS runtime, p.p_retailprice AS box_office
        FROM part p LEFT JOIN (
            SELECT l_partkey, arg_min(l_suppkey, (l_orderkey, l_linenumber)) AS sup
            FROM lineitem GROUP BY l_partkey) f ON p.p_partkey = f.l_partkey"""),
    "history_full": (("history", "title_info"), """
        SELECT h.user_id, h.title_id, h.rating, h.year, h.l_orderkey, h.l_linenumber,
               h.l_partkey, h.l_suppkey, h.l_extendedprice,
               t.title, t.director, t.actors, t.studio, t.genre, t.runtime, t.box_office
        FROM history h JOIN title_info t ON h.title_id = t.title_id"""),
    "title_vectors": (("catalog_base",), """
        SELECT e.vec_id AS title_id, e.embedding AS vec,
               list_distinct(list_filter(string_split(c.title, ' '), lambda w: length(w) >= 5)) AS tags,
               c.imdb_score AS score
        FROM embeddings e JOIN catalog_base c ON e.vec_id = c.title_id"""),
}


def _order(names) -> list[str]:
    out: list[str] = []

    def visit(n):
        if n in out:
            return
        for d in VIEWS[n][0]:
            visit(d)
        out.append(n)
    for n in names:
        visit(n)
    return out


def with_views(sql: str, *names: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``sql`` with CTEs for ``names`` (dependencies first) and ``extra``."""
    parts = [f"{n} AS ({VIEWS[n][1]})" for n in _order(names)]
    for k, v in (extra or {}).items():
        parts.append(f"{k} AS ({v})")
    sql = sql.strip()
    if sql.startswith(","):          # the query brings CTEs of its own
        head, body = sql[1:].split("\n    SELECT", 1) if "\n    SELECT" in sql else (sql[1:], "")
        parts.append(head.strip())
        sql = "SELECT" + body
    if not parts:
        return sql
    return "WITH " + ",\n".join(parts) + "\n" + sql
