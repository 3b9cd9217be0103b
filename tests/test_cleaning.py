import re

from pyspark.sql import functions as F

from querysieve.functions import draws as dr
from querysieve.operators import cleaning as cl, stats as st


def test_contradictions_with_a_hot_text(spark):
    rows = [(i, "hot", 0) for i in range(300)] + [(300, "hot", 1), (301, "fine", 1), (302, "ok", 0), (303, None, 0)]
    df = spark.createDataFrame(rows, "id int, full_query string, label int")
    assert sorted(r["id"] for r in cl.drop_contradictions(df).collect()) == [301, 302, 303]


def test_campaign_status(spark):
    rows = [
        (1, "a", "recon", "success"), (2, "a", "exploit", "failure"), (3, "a", "exploit", "success"),
        (4, "b", "recon", "failure"), (5, "b", "recon", "success"), (6, "b", "exploit", "success"),
        (7, "c", "recon", "failure"), (8, "d", "recon", "success"), (9, "d", "recon", "failure"),
    ]
    df = spark.createDataFrame(rows, "id int, attack_id string, attack_stage string, attack_status string")
    got = {r["id"]: r["attack_status"] for r in cl.campaign_status(df).collect()}
    want = {1: "failure", 2: "failure", 3: "failure", 4: "success", 5: "success", 6: "success", 7: "failure", 8: "success", 9: "failure"}
    assert got == want


def test_campaign_ids_follow_technique_order(spark):
    df = spark.createDataFrame([("T1", "union"), ("T1", "boolean"), ("T0", "time"), ("T1", "union")], "query_template_id string, attack_technique string")
    got = {(r[0], r[1]): r["attack_id"] for r in cl.campaign_ids(df).collect()}
    assert got == {("T0", "time"): "time-0", ("T1", "boolean"): "boolean-1", ("T1", "union"): "union-2"}


def test_default_queries_are_dropped_per_template(spark):
    log = spark.createDataFrame([(1, "A", "d"), (2, "A", "x"), (3, "B", "d"), (4, "A", None)], "id int, query_template_id string, full_query string")
    defaults = spark.createDataFrame([("A", "d")], "query_template_id string, full_query string")
    assert sorted(r["id"] for r in cl.drop_default_queries(log, defaults).collect()) == [2, 3, 4]


def test_splits(spark):
    log = spark.range(1000).select("id", (F.col("id") % 10 == 0).cast("int").alias("label"), F.lit(None).cast("string").alias("split"))
    assert st.split_label_counts(cl.first_split(log)).where("split = 'train'").first()["normals"] == 900
    assert cl.assign_split(log).where("split <> 'test'").isEmpty()
    train = cl.first_split(log)
    exact = cl.train_val_split_exact(train, dr.hashed(7))
    assert exact.where("part = 'val'").count() == 90 and exact.where("part = 'val' AND split <> 'train'").isEmpty()
    share = cl.train_val_split(train, dr.hashed(7)).where("part = 'val'").count()
    assert 55 < share < 130


def test_user_input_mode_and_admin_blanking(spark):
    log = spark.createDataFrame([(1, "q", None, "T"), (2, "q", "i", "admin1")], "id int, full_query string, user_inputs string, query_template_id string")
    assert [(r["id"], r["full_query"]) for r in cl.user_input_mode(log).collect()] == [(2, "i")]
    ids = log.where("id = 2")
    assert {r["id"]: r["user_inputs"] for r in cl.blank_admin_inputs(log, ids).collect()} == {1: None, 2: ""}


def test_payload_keeps_unknown_and_repeated_templates(spark):
    from querysieve.operators.cleaning import extract_payload

    log = spark.createDataFrame([("SELECT 1", "t1"), ("SELECT 2", "gone")], "full_query string, query_template_id string")
    templates = spark.createDataFrame([("t1", "SELECT {x}"), ("t1", "SELECT {x}")], "query_template_id string, template string")
    got = {r.query_template_id: r.payload for r in extract_payload(log, templates).collect()}
    assert len(got) == 2 and got["gone"] is None and extract_payload(log, templates).count() == 2


def test_draws_of_large_rows_and_tenth_repeat(spark):
    from pyspark.sql import functions as F
    from querysieve.functions import draws, text

    row = spark.range(1).select(
        draws.linear()(F.lit(9_000_000_000), F.lit(3)).alias("d"),
        F.transform(text.placeholders(F.lit(" ".join(["{x}"] * 10))), text.bare_name).alias("names"),
    ).first()
    assert row.d == (9_000_000_000 * 1103515245 + 3 * 12345) % 2147483647 and set(row.names) == {"x"}


def test_default_statements_are_no_join_key(spark):
    held = [(1, "T", "x"), (2, "T", "y"), (3, "U", "x"), (4, None, "x"), (5, "T", None), (6, "T", "x")]
    log = spark.createDataFrame(held, "id int, query_template_id string, full_query string")
    defaults = spark.createDataFrame([("T", "x"), ("T", "x"), (None, "x"), ("T", None), ("U", "z")], "query_template_id string, full_query string")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = cl.drop_default_queries(log, defaults.hint("merge"))
        assert sorted(r["id"] for r in out.collect()) == [2, 3, 4, 5] and out.columns == log.columns
        plan = [x for x in out._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in x]
        assert plan and all("xxhash64(full_query" in x and "full_query" not in re.sub(r"xxhash64\([^)]*\)", "", x) for x in plan)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
