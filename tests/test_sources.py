import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from querysieve.functions.text import NULL_TOKENS
from querysieve.schemas import QUERY_LOG, STATEMENT_SHARES
from querysieve.session import broadcast_if_small, scratch_path, scratch_root
from querysieve.sources import catalogue as ca, curves as cu, dictionaries as di, querylog as ql, records


def test_log_round_trip(spark):
    rows = [
        ('SELECT "a""b",\n\'x\' -- \\', 1, " lead ", "recon", "t", "success", "select", "T1", "union-0", "union", "test"),
        ("SHOW TABLES;", 0, "", None, None, None, "admin", "T2", None, None, "train"),
        ("NA", 0, "NA", None, None, None, "select", "T2", None, None, "train"),
    ]
    path = scratch_path(spark, "log")
    ql.write_log_csv(spark.createDataFrame(rows, QUERY_LOG), path)
    got = {tuple(r) for r in ql.read_log(spark, path).collect()}
    want = {tuple(None if v == "" else v for v in r) for r in rows}
    assert got == want
    assert ql.read_log(spark, path, NULL_TOKENS).where("full_query IS NULL").count() == 1


@pytest.mark.parametrize("size", ["37", "64", "1000"])
def test_records_with_line_breaks_come_from_many_ranges(spark, tmp_path, size):
    draw = random.Random(5)
    cell = lambda: draw.choice(["a", "", "x,y", 'say ""no""', "two\nlines", "\n\n", "é\n" * draw.randint(1, 40), "1 = 1 -- '"])
    for file, end in (("one.csv", "\n"), ("two.csv", "\r\n")):
        lines = ['a,"b', 'c",n'] if file == "one.csv" else ["a,b,n"]
        lines += [f'"{cell()}","{cell()}",{i}' for i in range(60)] + ["", f"plain,,{60}"]
        (tmp_path / file).write_bytes(end.join(lines).encode())
    schema = spark.createDataFrame([], "a string, b string, n int").schema
    want = []
    for file in ("one.csv", "two.csv"):
        held = (tmp_path / file).read_text(newline="").replace("\r\n", "\n")
        want += [tuple(int(v) if k == 2 else v or None for k, v in enumerate(r)) for r in list(csv.reader(io.StringIO(held)))[1:] if r]
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        df = records.read_csv(spark, str(tmp_path), schema, ca.CSV_OPTIONS)
        assert sorted(map(tuple, df.collect()), key=repr) == sorted(want, key=repr)
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 5
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_records_of_nothing(spark, tmp_path):
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "header.csv").write_text("a,b\n")
    schema = spark.createDataFrame([], "a string, b string").schema
    assert records.read_csv(spark, str(tmp_path), schema, ca.CSV_OPTIONS).count() == 0


def test_split_sink_prunes(spark):
    path = scratch_path(spark, "sink")
    df = spark.range(10).select("id", F.when(F.col("id") < 3, "train").otherwise("test").alias("split"))
    ql.write_log(df, path)
    pruned = spark.read.parquet(path).where("split = 'train'")
    assert pruned.count() == 3 and "PartitionFilters: [isnotnull(split" in pruned._jdf.queryExecution().toString()


def test_shares_must_sum_to_one():
    assert abs(sum(ca.check_shares(STATEMENT_SHARES).values()) - 1) < 1e-10
    with pytest.raises(ValueError):
        ca.check_shares({"select": 0.7, "admin": 0.2})


def test_dictionary_files(spark, tmp_path):
    values = [f"v{i % 50}" for i in range(5000)]
    (tmp_path / "countries_code").write_text("\n".join(values) + "\n")
    (tmp_path / "odd").write_text("a\x0cb\n\n c\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = di.read_dictionaries(spark, str(tmp_path), "airport").orderBy("dict_name", "pos").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    code = [(r["pos"], r["value"]) for r in rows if r["dict_name"] == "countries_code"]
    assert code == list(enumerate(values))
    assert [r["value"] for r in rows if r["dict_name"] == "odd"] == ["a", "b", "", "", "c"]


def test_templates_from_files(spark, tmp_path):
    for kind in STATEMENT_SHARES:
        (tmp_path / f"{kind}.csv").write_text(f'template,ID,description,payload_type\n"{kind} ""{{x}}"" {{x}}",a-{kind}1,"d, e",string\n')
    rows = ca.read_templates(spark, str(tmp_path)).collect()
    assert len(rows) == 5 and all(r["placeholders"] == ["x", "x2"] for r in rows)
    assert {r["statement_type"]: r["proportion"] for r in rows} == STATEMENT_SHARES


def test_resume(spark):
    planned = spark.createDataFrame([("A", "union"), ("A", "time"), ("B", "union")], "query_template_id string, attack_technique string")
    path = scratch_path(spark, "campaigns")
    ql.append_campaigns(planned.limit(1).withColumn("campaign_no", F.lit(4)), path)
    done = spark.read.parquet(path)
    rows = [tuple(r) for r in ql.pending_campaigns(planned, done).orderBy("campaign_no").collect()]
    assert rows == [("A", "time", 5), ("B", "union", 6)]
    assert ql.pending_campaigns(planned, done.limit(0)).agg(F.min("campaign_no")).first()[0] == 0


def test_curves(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "SBERT and AE_chall.csv").write_text("precision,recall\n1.0,0.0\n0.5,1.0\n")
    rows = cu.read_curves(spark, str(tmp_path), ["precision", "recall"]).collect()
    assert {(r["model"], r["challenging"]) for r in rows} == {("sub/SBERT and AE_chall", True)} and len(rows) == 2
    root = scratch_path(spark, "curves")
    cu.write_curves(spark.createDataFrame([("Li and AE", 0.25, 1.0)], "model string, precision double, recall double"), root, ["precision", "recall"])
    assert cu.read_curves(spark, root, ["precision", "recall"]).first()["model"] == "Li and AE"


def test_broadcast_only_when_small(spark):
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    small, large = broadcast_if_small(spark.range(10)), broadcast_if_small(spark.range(1000), max_rows=100)
    assert "broadcast" in plan(spark.range(5).join(small, "id")) and "broadcast" not in plan(spark.range(5).join(large, "id"))


def test_scratch_root_comes_from_the_session(spark):
    assert scratch_root(spark) == (spark.conf.get("spark.checkpoint.dir", None) or "").rstrip("/")
