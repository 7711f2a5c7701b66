"""Every query with SQL gives DuckDB's rows."""

import glob
import os

import duckdb
import pytest

from helixframe.plans import catalog

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


def value(x):
    if x is None or x != x:
        return None
    return float(x) if isinstance(x, (int, float, bool)) else str(x)


def canonical(rows):
    return sorted((tuple(map(value, r)) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query(spark, con, name):
    df = catalog.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = canonical(df.select(*cols).toPandas().astype(object).itertuples(index=False, name=None)) if not cols else canonical(tuple(r) for r in df.select(*cols).collect())
    out = con.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in out.description]
    assert sorted(names) == cols
    order = [names.index(c) for c in cols]
    assert got == canonical(tuple(r[i] for i in order) for r in out.fetchall())


def test_bootstrap_equals_resampling(spark):
    import numpy as np

    from helixframe.operators import statistics as S

    codes, y, s = [0, 1, 0, 2, 1, 2, 2], [0, 0, 1, 0, 1, 1, 0], [0.1, 0.4, 0.4, 0.2, 0.9, 0.3, 0.3]
    df = spark.createDataFrame([(f"v{c}", a, b) for c, a, b in zip(codes, y, s)], "v string, y int, s double")
    got = {r["draw"]: r for r in S.cluster_bootstrap(df, "v", "s", "y", jobs=2, draws=3).collect()}
    streams = [np.random.RandomState(42), np.random.RandomState(43)]  # each job draws three times in turn
    for d in range(6):
        m = np.bincount(streams[d // 3].randint(3, size=3), minlength=3)[codes]
        yy, ss = np.repeat(y, m), np.repeat(s, m)
        pos, neg = ss[yy == 1], ss[yy == 0]
        if len(pos) and len(neg):
            want = np.mean([(a > b) + (a == b) / 2 for a in pos for b in neg])
            assert abs(got[d]["auroc"] - want) < 1e-12


def broadcast_python(df):
    """Lines of the first and the final plan where rows made by Python are beneath a broadcast."""
    import re

    df.collect()
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = [re.match(r"[ :+-]*", x).end() for x in lines]
    assert any("MapIn" in x for x in lines)
    above = lambda k: (i for i in range(k) if depth[i] < min(depth[i + 1 : k + 1]))
    return [x for k, x in enumerate(lines) if "MapIn" in x and any("BroadcastExchange" in lines[i] for i in above(k))]


def test_bootstrap_counts_are_not_broadcast(spark):
    from pyspark.sql import functions as F

    from helixframe.operators import statistics as S

    assert not broadcast_python(catalog.QUERIES["sta06_bootstrap"](spark, DATA))
    assert not broadcast_python(catalog.QUERIES["sta05_bootstrap_mass"](spark, DATA))
    df = spark.range(300).select((F.col("id") % 100).alias("v"), (F.col("id") % 2).alias("y"), F.col("id").cast("double").alias("s"))
    assert not broadcast_python(S.cluster_bootstrap(df, "v", "s", "y", jobs=2, draws=3))


@pytest.mark.parametrize("cells", [1 << 25, 30, 7, 2])  # all draws in a row, blocks of draws, and one draw in 2 or 5 ranges of codes
def test_bootstrap_in_blocks_and_ranges(spark, monkeypatch, cells):
    import numpy as np

    from helixframe.operators import statistics as S

    monkeypatch.setattr(S, "CELLS", cells)
    monkeypatch.setattr(S, "TAKEN", 4)
    n, jobs, draws = 10, 2, 5
    df = spark.createDataFrame([(f"v{i}",) for i in range(n)] * 2 + [(None,)], "v string")
    want = []
    for job in range(jobs):
        rng = np.random.RandomState(42 + job)
        for d in range(draws):
            want += [(job * draws + d, f"v{i}", int(m)) for i, m in enumerate(np.bincount(rng.randint(n, size=n), minlength=n)) if m]
    assert sorted(map(tuple, S.bootstrap_weights(df, "v", jobs, draws).collect())) == want
    none = df.where("v IS NULL").selectExpr("v", "1 AS y", "0.5D AS s")
    assert not S.bootstrap_weights(none, "v", jobs, draws).collect() and not S.cluster_bootstrap(none, "v", "s", "y", jobs, draws).collect()
