"""Labelling, cleaning and campaign post-processing of query logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from querysieve.functions import draws as dr, text as tx
from querysieve.operators.ordering import global_index
from querysieve.schemas import TECHNIQUES
from querysieve.session import broadcast_if_small

VALIDATION_SHARE = 0.1
SLOT_SPLIT = 7


def assign_split(log: DataFrame) -> DataFrame:
    """Attacks go to test, benign rows keep their split, rows without one go to test."""
    return log.withColumn(
        "split", F.when(F.col("label") == 1, "test").otherwise(F.coalesce("split", F.lit("test")))
    )


def first_split(log: DataFrame) -> DataFrame:
    """Initial split: attacks to test, benign rows to train."""
    return log.withColumn("split", F.when(F.col("label") == 1, "test").otherwise("train"))


def contradictory_texts(log: DataFrame) -> DataFrame:
    """Statements that occur under both labels.

    The first pass shuffles 8-byte hashes, pre-aggregated per task; whole texts are only
    compared for the few hashes seen under both labels.
    """
    hashed = log.withColumn("_h", F.xxhash64("full_query"))
    suspects = (
        hashed.groupBy("_h").agg(F.min("label").alias("_lo"), F.max("label").alias("_hi"))
        .where(F.col("_lo") != F.col("_hi")).select("_h")
    )
    return (
        hashed.join(broadcast_if_small(suspects), "_h", "left_semi")
        .groupBy("_h", "full_query")
        .agg(F.min("label").alias("_lo"), F.max("label").alias("_hi"))
        .where(F.col("_lo") != F.col("_hi"))
        .select("_h", "full_query")
    )


def drop_contradictions(log: DataFrame) -> DataFrame:
    """Drop every row whose statement occurs under both labels."""
    bad = broadcast_if_small(contradictory_texts(log))
    return (
        log.withColumn("_h", F.xxhash64("full_query"))
        .join(bad, ["_h", "full_query"], "left_anti")
        .select(*log.columns)
    )


def blank_admin_inputs(log: DataFrame, admin_ids: DataFrame) -> DataFrame:
    """Empty user inputs on rows of the given templates (column ``query_template_id``)."""
    marked = broadcast_if_small(admin_ids.select("query_template_id").distinct().withColumn("_admin", F.lit(True)))
    return (
        log.join(marked, "query_template_id", "left")
        .withColumn("user_inputs", F.when(F.col("_admin"), "").otherwise(F.col("user_inputs")))
        .select(*log.columns)
    )


def template_split(log: DataFrame, held_out: DataFrame) -> DataFrame:
    """Tag rows of held-out templates ``challenging``, the others ``original``."""
    marked = broadcast_if_small(held_out.select("query_template_id").distinct().withColumn("_held", F.lit(True)))
    return log.join(marked, "query_template_id", "left").select(
        *log.columns, F.when(F.col("_held"), "challenging").otherwise("original").alias("template_split")
    )


def extract_payload(log: DataFrame, templates: DataFrame) -> DataFrame:
    """Injected part of each statement: what its template's fixed parts leave over.

    Statements of unknown templates stay, with a null payload; a repeated template counts once.
    """
    known = templates.groupBy("query_template_id").agg(F.min("template").alias("template"))
    side = broadcast_if_small(known)
    return log.join(side, "query_template_id", "left").select(
        *log.columns, tx.payload(F.col("full_query"), F.col("template")).alias("payload")
    )


def drop_default_queries(log: DataFrame, defaults: DataFrame) -> DataFrame:
    """Drop rows equal to their template's default statement; rows without one stay.

    Rows meet by template and a hash of the text, so no text is a key; texts are compared where both agree.
    """
    hashed = lambda df: F.xxhash64(df["full_query"])
    known = defaults.where(F.col("query_template_id").isNotNull() & F.col("full_query").isNotNull())
    side = known.groupBy(F.col("query_template_id").alias("_template"), hashed(known).alias("_hash")).agg(
        F.collect_set("full_query").alias("_texts")
    )
    met = (F.col("query_template_id") == F.col("_template")) & (hashed(log) == F.col("_hash"))
    joined = log.join(broadcast_if_small(side), met, "left")
    same = F.coalesce(F.array_contains("_texts", F.col("full_query")), F.lit(False))
    return joined.where(~same).select(*[log[c] for c in log.columns])


def campaign_outcome(attacks: DataFrame, order: str = "id") -> DataFrame:
    """Outcome per campaign: (attack_id, any successful recon, first exploit status)."""
    exploit = F.col("attack_stage") == "exploit"
    return attacks.groupBy("attack_id").agg(
        F.coalesce(F.bool_or((F.col("attack_stage") == "recon") & (F.col("attack_status") == "success")), F.lit(False))
        .alias("recon_success"),
        F.min_by(F.when(exploit, F.col("attack_status")), F.when(exploit, F.col(order))).alias("exploit_status"),
    )


def campaign_status(attacks: DataFrame, order: str = "id") -> DataFrame:
    """Give every row its campaign's status.

    No successful recon: failure. Otherwise the first exploit row decides; a campaign
    without exploit rows keeps each row's own status.
    """
    outcome = broadcast_if_small(campaign_outcome(attacks, order))
    return (
        attacks.join(outcome, "attack_id", "left")
        .withColumn(
            "attack_status",
            F.when(~F.col("recon_success"), "failure").otherwise(F.coalesce("exploit_status", "attack_status")),
        )
        .select(*attacks.columns)
    )


def campaign_ids(attacks: DataFrame) -> DataFrame:
    """Number campaigns by template, then technique, and name them ``<technique>-<n>``."""
    pairs = attacks.select("query_template_id", "attack_technique").distinct()
    place = F.array_position(F.array(*[F.lit(t) for t in TECHNIQUES]), F.col("attack_technique"))
    numbered = global_index(pairs, [F.col("query_template_id"), place], "campaign_no")
    named = numbered.withColumn(
        "attack_id", F.concat_ws("-", "attack_technique", F.col("campaign_no").cast("string"))
    )
    others = [c for c in attacks.columns if c != "attack_id"]
    return attacks.select(*others).join(
        broadcast_if_small(named), ["query_template_id", "attack_technique"]
    )


def user_input_mode(log: DataFrame) -> DataFrame:
    """Analyse the user inputs instead of the statement; rows without inputs go."""
    return log.where(F.col("user_inputs").isNotNull()).withColumn("full_query", F.col("user_inputs"))


def train_val_split(log: DataFrame, draw: dr.Draw, key: str = "id", share: float = VALIDATION_SHARE) -> DataFrame:
    """Tag train rows ``train`` or ``val`` by an independent draw; other rows keep their split.

    One narrow pass; the share holds in expectation.
    """
    val = dr.unit(draw, F.col(key), F.lit(SLOT_SPLIT)) < F.lit(share)
    return log.withColumn("part", F.when((F.col("split") == "train") & val, "val").otherwise(F.col("split")))


def train_val_split_exact(log: DataFrame, draw: dr.Draw, key: str = "id", share: float = VALIDATION_SHARE) -> DataFrame:
    """As :func:`train_val_split` with exactly ceil(share * n) validation rows.

    Only (key, draw) pairs are ordered; the rows themselves are tagged by a join.
    """
    train = log.where(F.col("split") == "train").select(
        F.col(key), draw(F.col(key), F.lit(SLOT_SPLIT)).alias("_draw")
    )
    n = train.agg(F.ceil(F.count("*") * F.lit(share)).alias("n"))
    ranked = global_index(train, [F.col("_draw"), F.col(key)], "_rank")
    chosen = ranked.where(F.col("_rank") < n.scalar()).select(key, F.lit(True).alias("_val"))
    return log.join(chosen, key, "left").select(
        *log.columns, F.when(F.col("_val"), "val").otherwise(F.col("split")).alias("part")
    )
