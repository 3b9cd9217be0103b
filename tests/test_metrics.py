import numpy as np
import pytest
from pyspark.sql import functions as F

from querysieve.operators import metrics as me, stats as st
from querysieve.session import scratch_path


def scores(spark, rows):
    return spark.createDataFrame(
        [("m", i, label, float(s), t) for i, (label, s, t) in enumerate(rows)],
        "model string, id int, label int, score double, attack_technique string",
    )


def brute(labels, values):
    labels, values = np.array(labels), np.array(values, float)
    p, n = labels.sum(), (1 - labels).sum()
    points, roc = [(1.0, 0.0)], [(0.0, 0.0)]
    for t in sorted(set(values), reverse=True):
        tp, fp = (labels * (values >= t)).sum(), ((1 - labels) * (values >= t)).sum()
        points.append((tp / (tp + fp), tp / p))
        roc.append((fp / n, tp / p))
    area = lambda xy: sum((x1 - x0) * (y0 + y1) / 2 for (x0, y0), (x1, y1) in zip(xy, xy[1:]))
    return area([(r, pr) for pr, r in points]), area(roc)


def test_areas_with_ties(spark):
    rng = np.random.default_rng(5)
    labels, values = rng.integers(0, 2, 300), rng.integers(0, 25, 300)
    df = scores(spark, [(int(l), v, "t") for l, v in zip(labels, values)])
    pr, roc = brute(labels, values)
    assert abs(me.auprc(df).first()["auprc"] - pr) < 1e-12
    assert abs(me.auroc(df).first()["auroc"] - roc) < 1e-12
    assert abs(me.auc_from_points(me.pr_curve(df), "recall", "precision", True).first()["area"] - pr) < 1e-12
    assert abs(me.auc_from_points(me.roc_curve(df), "fpr", "tpr").first()["area"] - roc) < 1e-12


def test_score_on_the_threshold_is_an_attack(spark):
    val = scores(spark, [(0, v, None) for v in range(11)])
    t = me.fpr_threshold(val, 0.1)
    assert t.first()["threshold"] == 9.0
    share = me.threshold_share(val, t).first()
    assert (share["n_above"], round(share["share_above"], 6)) == (1, round(1 / 11, 6))
    pred = me.predict(scores(spark, [(1, 9, "a"), (1, 8.9, "b"), (0, 9, None), (0, 1, None)]), t)
    row = me.confusion(pred).first()
    assert (row["tn"], row["fp"], row["fn"], row["tp"]) == (1, 1, 1, 1)
    recalls = {r["attack_technique"]: r["recall"] for r in me.recall_by_technique(pred).collect()}
    assert recalls == {"a": 1.0, "b": 0.0}


def test_all_normal_input(spark):
    df = scores(spark, [(0, v, None) for v in range(5)])
    row = me.confusion(me.predict(df, me.fpr_threshold(df))).first()
    assert row["recall"] == 0 and row["fone"] == 0
    assert me.auprc(df).first()["auprc"] == 0 and me.auroc(df).first()["auroc"] == 0
    assert me.prevalence(df).first()["prevalence"] == 0


def test_percent_format(spark):
    row = spark.range(1).select(me.percent(F.lit(0.28125)), me.percent(F.lit(0.1), 5), me.percent(F.lit(None).cast("double"))).first()
    assert tuple(row) == ("28.12%", "10.00000%", None)


def test_label_conflicts(spark):
    df = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (2, 0)], "id int, label int")
    assert [r["id"] for r in me.label_conflicts(df).collect()] == [1]


def test_report_file_name_follows_the_run_mode(spark):
    report = spark.createDataFrame([("m", "1.00%")], "model string, fone string")
    root = scratch_path(spark, "reports")
    path = me.write_report(report, root, gpu=True, on_user_inputs=True)
    assert path == f"{root}/results-gpu-on-user-inputs.csv"
    assert spark.read.option("header", True).csv(path).first()["fone"] == "1.00%"


def test_unlisted_technique_or_stage_raises(spark):
    recalls = spark.createDataFrame([("m", "union", 1.0)], "model string, attack_technique string, recall double")
    with pytest.raises(Exception, match="unlisted technique"):
        me.recall_columns(recalls, ["boolean"]).collect()
    log = spark.createDataFrame([("a", "recon"), ("a", "cleanup")], "attack_id string, attack_stage string")
    with pytest.raises(Exception, match="unlisted stage"):
        st.stage_pivot(log, ["recon"]).collect()
    assert st.stage_pivot(log).first().asDict() == {"attack_id": "a", "recon": 1, "cleanup": 1, "exploit": 0}
    assert st.stage_pivot(log, ["recon", "cleanup"]).first().asDict() == {"attack_id": "a", "recon": 1, "cleanup": 1}
