import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from querysieve.operators import ordering
from querysieve.operators.ordering import exact_quantile, global_index, previous_row, running_sums


def frame(spark, n=500, seed=1):
    rng = np.random.default_rng(seed)
    # Group a holds most of the rows.
    pdf = pd.DataFrame({"id": range(n), "g": rng.choice(["a", "b", "c"], n, p=[0.8, 0.15, 0.05]), "v": rng.integers(0, 40, n)})
    return pdf, spark.createDataFrame(pdf)


@pytest.mark.parametrize("blocks", [None, 1, 7])
def test_running_sums(spark, blocks):
    pdf, df = frame(spark)
    got = running_sums(df, [F.desc("v"), F.col("id")], {"s": F.col("v"), "n": F.lit(1)}, ["g"], blocks).toPandas()
    want = pdf.sort_values(["v", "id"], ascending=[False, True])
    want["s"], want["n"] = want.groupby("g")["v"].cumsum(), want.groupby("g").cumcount() + 1
    merged = got.merge(want, on="id", suffixes=("", "_w"))
    assert len(merged) == len(pdf) and (merged["s"] == merged["s_w"]).all() and (merged["n"] == merged["n_w"]).all()


def test_global_index_is_dense(spark):
    pdf, df = frame(spark)
    got = global_index(df, [F.col("v"), F.col("id")], "i", blocks=7).orderBy("i").toPandas()
    assert got["i"].tolist() == list(range(len(pdf)))
    assert got["id"].tolist() == pdf.sort_values(["v", "id"])["id"].tolist()


def test_previous_row(spark):
    pdf, df = frame(spark)
    got = previous_row(df, [F.col("v"), F.col("id")], {"before": "id"}, ["g"], blocks=9).toPandas().set_index("id")["before"]
    want = pdf.sort_values(["v", "id"])
    want["before"] = want.groupby("g")["id"].shift()
    want = want.set_index("id")["before"]
    assert got.sort_index().fillna(-1).tolist() == want.sort_index().fillna(-1).tolist()


def test_exact_quantile(spark):
    pdf, df = frame(spark)
    for q in (0.0, 0.37, 0.5, 0.999, 1.0):
        got = {r["g"]: r["quantile"] for r in exact_quantile(df, "v", q, ["g"], blocks=6).collect()}
        for g, part in pdf.groupby("g"):
            assert abs(got[g] - np.percentile(part["v"], q * 100)) < 1e-9
    assert abs(exact_quantile(df, "v", 0.25).first()[0] - np.percentile(pdf["v"], 25)) < 1e-9


def test_bracketed_quantile_is_exact(spark):
    rng = np.random.default_rng(2)
    for x in (rng.normal(size=3000), np.round(rng.normal(size=3000), 1), np.r_[np.zeros(2000), rng.normal(size=9) * 1e-9], np.array([1.5])):
        df = spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("nan"),)], "d double")
        for q in (0.0, 0.05, 0.5, 0.999, 1.0):
            for kw in ({}, {"bins": 4, "few": 3}):
                got = ordering.bracketed_quantile(df, "d", q, -10.0, 10.0, **kw)
                assert abs(got - np.quantile(x, q)) <= 1e-15, (q, kw)
    assert np.isnan(ordering.bracketed_quantile(df.limit(0), "d", 0.5, 0.0, 1.0))
