"""Places, quantiles and modes by ranges against sorting everything."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from casewise.operators import order, splits


def test_numbers_follow_the_order(spark):
    r = np.random.default_rng(1)
    rows = [(k % 3, float(x), f"c{k:05d}") for k, x in enumerate(r.normal(size=2000).round(1))] + [(0, None, "none"), (1, float("nan"), "nan")]
    df = spark.createDataFrame(rows, "g int, v double, name string")
    key = lambda q: (q.v is not None, np.isnan(q.v) if q.v is not None else False, q.v or 0.0, q.name)
    got = sorted(order.numbered(df, ["v", "name"], "at").collect(), key=lambda q: q["at"])
    assert [q["at"] for q in got] == list(range(len(rows)))
    assert [key(q) for q in got] == sorted(map(key, got))
    for name in ("name", "g"):
        by = order.numbered(df, ["name"], "at", by=["g"]) if name == "g" else order.numbered(df, ["name"], "at")
        groups = {}
        for q in by.collect():
            groups.setdefault(q["g"] if name == "g" else 0, []).append((q["at"], q["name"]))
        for g in groups.values():
            assert [at for at, _ in sorted(g)] == list(range(len(g))) and sorted(g) == sorted(g, key=lambda x: x[1])


def test_numbers_by_levels(spark):
    df = spark.createDataFrame([(k % 4, f"x{k:03d}") for k in range(200)], "level int, name string")
    got = sorted(order.numbered(df, ["name"], "at", levels=["level"]).collect(), key=lambda q: q["at"])
    assert [q["at"] for q in got] == list(range(200)) and [(q["level"], q["name"]) for q in got] == sorted((q["level"], q["name"]) for q in got)


def test_folds_are_ntiles(spark):
    from pyspark.sql.window import Window

    from casewise.functions import draw

    for n, cases in ((3, 10), (5, 4), (4, 100)):
        df = spark.createDataFrame([(k,) for k in range(cases)], "caseid long")
        want = df.select("caseid", (F.ntile(n).over(Window.orderBy(draw(42, F.col("caseid")), "caseid")) - 1).alias("fold"))
        assert sorted(map(tuple, splits.folds(df, n).collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("few", [3, 10_000])
def test_quantiles_are_exact(spark, monkeypatch, few):
    monkeypatch.setattr(order, "FEW", few)
    r = np.random.default_rng(2)
    n = 5001
    columns = {
        "normal": r.normal(size=n), "ties": r.integers(0, 3, n).astype(float), "steep": np.exp(r.normal(size=n) * 40), "zeros": np.where(r.random(n) < 0.7, 0.0, r.normal(size=n)),
        "one": np.full(n, 5.0), "holes": np.where(r.random(n) < 0.4, np.nan, r.normal(size=n)),
    }
    df = spark.createDataFrame([tuple(float(c[k]) for c in columns.values()) + (None,) for k in range(n)], ", ".join(f"{c} double" for c in columns) + ", empty double")
    shares = [0.0, 0.025, 0.25, 0.5, 0.75, 1.0]
    got = order.quantiles(df, [*columns, "empty"], shares)
    for c, v in columns.items():
        assert np.allclose(got[c], np.quantile(v[~np.isnan(v)], shares), rtol=1e-12, atol=0), c
    assert got["empty"] == [None] * len(shares)


def test_modes_take_the_lowest(spark):
    df = spark.createDataFrame([(2.0, 1), (1.0, 1), (2.0, 3), (1.0, None), (None, None), (float("nan"), None)], "a double, b int")
    assert order.modes(df.withColumn("c", F.lit(None).cast("double")), ["a", "b", "c"]) == {"a": 1.0, "b": 1.0, "c": None}


def test_static_features_count_once_for_each_case(spark):
    from casewise.operators import prep

    rows = [(1, t, 20.0, 1.0) for t in range(9)] + [(2, t, 40.0, 2.0) for t in range(2)] + [(3, 0, None, 2.0)]
    df = spark.createDataFrame(rows, "caseid long, time_sec long, age double, x double")
    s = {q.feature: q for q in prep.fit_scaling(df, ["x", "age"], static=["age"]).collect()}
    assert s["age"].fill == 30.0 and s["age"].mean == 30.0 and s["age"].seen == 2 and s["x"].fill == 1.0
    assert abs(s["age"].scale - np.std([20, 40, 30])) < 1e-12
