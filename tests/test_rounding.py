"""Values are rounded by the rule of the SQL's round."""

import duckdb
import numpy as np

from gridspark import catalog


def test_rounded_as_in_sql(spark):
    """The first two are what warp_bilinear_3857_to_4326 has before rounding at six times sf0.1 (exactly 26.96965 and 58.78195)."""
    rng = np.random.default_rng(3)
    half = (rng.integers(0, 10_000_000, 20_000) * 2 + 1) / 20_000
    values = [26.969649999999998, 58.781949999999995, *np.concatenate([half, np.nextafter(half, 0), np.nextafter(half, 1e9), -half]).tolist()]
    values += [0.0, -0.0, -0.00001, 1e300, 1.7e308, float("inf"), float("-inf"), float("nan"), None]
    got = catalog.rounded(spark.createDataFrame(list(enumerate(values)), "i int, v double")).orderBy("i").collect()
    con = duckdb.connect()
    con.execute("create table t(i int, v double)")
    con.executemany("insert into t values (?, ?)", [(i, v) for i, v in list(enumerate(values))[:2] + list(enumerate(values))[-9:]])
    con.execute("insert into t select unnest(range(2, 2 + len($v))), unnest($v::double[])", {"v": values[2:-9]})
    want = con.sql("select round(v, 4) + 0e0 from t order by i").fetchall()
    assert [repr(r["v"]) for r in got] == [repr(w) for (w,) in want]
