"""Show rows that differ between a Spark query and its oracle SQL."""
import os, sys
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import duckdb
from oracle_check import TABLES, _norm

sf_dir, name = sys.argv[1], sys.argv[2]
import __spark_entry__ as E
from reelrank.session import get_session
spark = get_session("local[8]")
con = duckdb.connect()
for t in TABLES:
    con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
s = E.queries()[name](spark, sf_dir).toPandas()
o = con.execute(E.oracle_sql()[name]).df()
cols = sorted(s.columns)
a = {tuple(_norm(r[c]) for c in cols) for r in s.to_dict("records")}
b = {tuple(_norm(r[c]) for c in cols) for r in o.to_dict("records")}
print(cols)
print("spark only", len(a - b)); [print(" ", x) for x in sorted(a - b, key=repr)[:8]]
print("oracle only", len(b - a)); [print(" ", x) for x in sorted(b - a, key=repr)[:8]]
