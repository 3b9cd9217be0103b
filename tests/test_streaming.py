import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from querysieve.functions import lexical as lx
from querysieve.operators import cleaning as cl
from querysieve.operators.detectors import ocsvm
from querysieve.session import scratch_path
from querysieve.streaming import scoring as ss


def test_stream_equals_batch(spark, sf):
    from querysieve.plans import fixtures as fx

    log = fx.qlog(spark, sf)
    source = scratch_path(spark, "source")
    log.repartition(5).write.parquet(source)
    templates = fx.log_templates(spark.read.parquet(source))
    step = lambda df: cl.extract_payload(ss.with_lexical(df.drop("template")), templates).select("id", "payload", *lx.FEATURES)
    streamed = ss.run_once(spark, source, log.schema, step, files_per_trigger=2)
    batch = step(spark.read.parquet(source))
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(streamed) == rows(batch)


def test_model_scores_a_stream(spark):
    x = np.random.default_rng(1).normal(size=(60, 3))
    rows = spark.createDataFrame(pd.DataFrame({"id": range(60), "vec": [v.tolist() for v in x]}), "id bigint, vec array<double>")
    model = ocsvm.fit_ocsvm(rows, 3, features=32, passes=3)
    source = scratch_path(spark, "source")
    rows.write.parquet(source)
    streamed = ss.run_once(spark, source, rows.schema, lambda df: ocsvm.score_ocsvm(model, df).select("id", "score"))
    a = streamed.orderBy("id").toPandas()["score"]
    b = ocsvm.score_ocsvm(model, rows).orderBy("id").toPandas()["score"]
    assert np.allclose(a, b)


def test_a_batch_has_files_for_every_core(spark, monkeypatch):
    cores, batches = spark.sparkContext.defaultParallelism, []
    read = ss.read_stream

    def spy(*args):
        batches.append(args[3])
        return read(*args)

    monkeypatch.setattr(ss, "read_stream", spy)
    rows = spark.range(2 * cores + 5).select("id", F.concat(F.lit("a=a "), F.col("id").cast("string")).alias("full_query"))
    got = ss.stream_lexical(spark, rows.repartition(2 * cores + 1))
    assert got.count() == 2 * cores + 5
    assert batches[0] >= 2 * cores
