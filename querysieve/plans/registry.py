"""Every registered query: name -> function of (session, table folder)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from querysieve.functions import draws as dr, lexical as lx, text as tx
from querysieve.functions.vectors import mean_squared_error
from querysieve.operators import bagofwords as bow, build as bu, cleaning as cl, embedding as em, metrics as me
from querysieve.operators import scaling as sc, stats as st, synth as sy, workload as wl
from querysieve.operators.detectors import hashed, lof, neighbours as nb, ocsvm
from querysieve.operators.ordering import global_index
from querysieve.plans import evaluation as ev, fixtures as fx, grid
from querysieve.plans.fixtures import DRAW, table
from querysieve.session import broadcast_if_small, materialise, scratch_path, spread
from querysieve.sources import catalogue as ca, curves as cu, dictionaries as di, querylog as ql
from querysieve.streaming import scoring as ss

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Embedding classes that count as known; the others play the novel rows.
KNOWN_CLASSES = 7


def query(name: str):
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn

    return add


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: r6(c) for c in columns})


def assigned(spark: SparkSession, sf: str) -> DataFrame:
    return cl.assign_split(fx.qlog(spark, sf))


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """Rule scores, computed once: texts are read a single time per query."""
    return materialise(fx.rule_scores(assigned(spark, sf)), "scores")


def validation(scores: DataFrame) -> DataFrame:
    return scores.where(F.col("split") == "train")


def tested(scores: DataFrame) -> DataFrame:
    return scores.where(F.col("split") == "test")


def test_scores(spark: SparkSession, sf: str) -> DataFrame:
    return tested(scored(spark, sf))


# ---- sources and sinks -------------------------------------------------------------------


@query("scan_templates")
def scan_templates(spark, sf):
    root = scratch_path(spark, "templates")
    ca.write_templates(fx.catalog(spark, sf), root)
    return ca.read_templates(spark, root).select(
        "template", "ID", "description", "payload_type", "proportion", "statement_type",
        F.array_join("placeholders", " ").alias("placeholders"),
    )


@query("scan_dictionaries")
def scan_dictionaries(spark, sf):
    root = scratch_path(spark, "dicts")
    di.write_dictionaries(fx.dictionaries(spark, sf), root)
    return di.read_dictionaries(spark, root, "shop")


@query("build_dictionaries")
def build_dictionaries(spark, sf):
    return fx.dictionaries(spark, sf)


@query("check_proportions")
def check_proportions(spark, sf):
    """Shares of a catalogue per order status; that of status P lacks its urgent part, so its check fails."""
    orders = table(spark, sf, "orders")
    totals = orders.groupBy("o_orderstatus").agg(F.count("*").alias("total"))
    shares = orders.groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n")).join(F.broadcast(totals), "o_orderstatus")
    whole = (F.col("o_orderstatus") != "P") | (F.col("o_orderpriority") != "1-URGENT")
    given = shares.where(whole).withColumn("proportion", F.col("n") / F.col("total"))
    return ca.share_check(given, groups=["o_orderstatus"])


@query("scan_log")
def scan_log(spark, sf):
    path = scratch_path(spark, "log")
    ql.write_log_csv(fx.qlog(spark, sf), path)
    return ql.read_log(spark, path)


@query("null_tokens")
def null_tokens(spark, sf):
    spelled = F.element_at(
        F.array(*[F.lit(t) for t in tx.NULL_TOKENS], F.lit("nah"), F.lit("Null ")), (F.col("o_orderkey") % 21 + 1).cast("int")
    )
    tagged = table(spark, sf, "orders").select(
        F.concat(spelled, F.when(F.col("o_orderstatus") == "P", "x").otherwise("")).alias("value")
    )
    return ql.with_null_tokens(tagged, tx.NULL_TOKENS).groupBy("value").agg(F.count("*").alias("n"))


@query("sink_log")
def sink_log(spark, sf):
    path = scratch_path(spark, "log")
    ql.write_log(assigned(spark, sf).drop("template"), path)
    return spark.read.parquet(path).select("id", "full_query", "label", "statement_type", "split")


@query("resume_anti")
def resume_anti(spark, sf):
    attacks = fx.qlog(spark, sf).where(F.col("label") == 1)
    done = attacks.where(F.col("attack_stage") == "exploit").select(*ql.CAMPAIGN).distinct()
    done = global_index(done, [F.col(c) for c in ql.CAMPAIGN], "campaign_no")
    return ql.pending_campaigns(attacks, done)


@query("campaign_rerun")
def campaign_rerun(spark, sf):
    """A run that is lost between its rows and its markers, and the run after it."""
    attacks = fx.qlog(spark, sf).where(F.col("label") == 1).select("id", *ql.CAMPAIGN, "attack_status")
    path = scratch_path(spark, "campaigns")
    number = global_index(attacks.select(*ql.CAMPAIGN).distinct(), [F.col(c) for c in ql.CAMPAIGN], "_n")
    number = materialise(number, "numbered")
    of = lambda part: attacks.join(number.where(part).select(*ql.CAMPAIGN), ql.CAMPAIGN, "left_semi")
    ql.finish_campaigns(of(F.col("_n") % 3 == 0), path)
    ql.put_campaigns(of(F.col("_n") % 3 == 1).where(F.col("id") % 2 == 0), path)  # lost: half of the rows, no marker
    todo = attacks.join(ql.unfinished(attacks, path).select(*ql.CAMPAIGN), ql.CAMPAIGN, "left_semi")
    ql.finish_campaigns(todo, path)
    ql.finish_campaigns(todo, path)  # a repeated run
    return ql.finished_rows(spark, path).groupBy(*ql.CAMPAIGN).agg(
        F.count("*").alias("n"), F.sum("id").cast("bigint").alias("ids")
    )


@query("scan_curves")
def scan_curves(spark, sf):
    root = scratch_path(spark, "curves")
    scores = test_scores(spark, sf).withColumn(
        "model", F.when(F.col("model") == "length", "length_chall").otherwise(F.col("model"))
    )
    cu.write_curves(me.pr_curve(scores), root, ["precision", "recall"])
    points = cu.read_curves(spark, root, ["precision", "recall"])
    return rounded(points.select("model", "challenging", "precision", "recall"), "precision", "recall")


# ---- log synthesis -----------------------------------------------------------------------


@query("placeholders")
def placeholders(spark, sf):
    return fx.catalog(spark, sf).select(
        "ID", F.array_join(tx.placeholders(F.col("template")), " ").alias("placeholders")
    )


@query("template_roles")
def template_roles(spark, sf):
    return sy.template_roles(fx.catalog(spark, sf), DRAW).select("ID", "role")


@query("sample_fixed_n")
def sample_fixed_n(spark, sf):
    return sy.sample_fixed_n(fx.catalog(spark, sf), DRAW).select("ID", "template")


@query("template_weights")
def template_weights(spark, sf):
    return sy.template_weights(fx.catalog(spark, sf)).select("ID", F.round("normalized_weight", 12).alias("normalized_weight"))


def order_rows(spark, sf) -> DataFrame:
    return spread(table(spark, sf, "orders").select("o_orderkey"))


def sampled(spark, sf) -> DataFrame:
    return sy.weighted_sample(
        order_rows(spark, sf), sy.template_weights(fx.catalog(spark, sf)), "normalized_weight", ["ID"],
        dr.unit(DRAW, F.col("o_orderkey"), F.lit(sy.SLOT_TEMPLATE)), scale=1e9,
    )


@query("weighted_sample")
def weighted_sample(spark, sf):
    return sampled(spark, sf).select("o_orderkey", "ID")


def filled(spark, sf) -> DataFrame:
    expanded = sy.expand_conditions(sampled(spark, sf), fx.SEARCH_FIELDS, DRAW, "o_orderkey")
    bound = sy.slot_bound(fx.catalog(spark, sf), fx.SEARCH_FIELDS)
    return sy.fill_templates(expanded, fx.dictionaries(spark, sf), DRAW, "o_orderkey", bound)


@query("fill_templates")
def fill_templates(spark, sf):
    return filled(spark, sf).select("o_orderkey", "ID", "full_query", "user_inputs")


@query("random_fillers")
def random_fillers(spark, sf):
    row = F.col("o_orderkey")
    return order_rows(spark, sf).select(
        "o_orderkey",
        *[dr.number_filler(DRAW, row, F.lit(i), kind).alias(kind) for i, kind in enumerate(dr.NUMBER_RANGES)],
        dr.string_filler(DRAW, row, F.lit(9)).alias("rand_string"),
    )


@query("fill_conditions")
def fill_conditions(spark, sf):
    rows = order_rows(spark, sf).withColumn("template", F.lit(fx.CONDITIONAL_TEMPLATE))
    expanded = sy.expand_conditions(rows, fx.SEARCH_FIELDS, DRAW, "o_orderkey")
    # The shuffled form, for statements without a known bound on their placeholders.
    return sy.fill_templates(expanded, fx.dictionaries(spark, sf), DRAW, "o_orderkey").select(
        "o_orderkey", "full_query", "user_inputs"
    )


@query("assemble_normal")
def assemble_normal(spark, sf):
    return sy.as_normal_records(filled(spark, sf))


@query("augment_count")
def augment_count(spark, sf):
    return sy.augment_count(assigned(spark, sf))


@query("augment_test_split")
def augment_test_split(spark, sf):
    out = sy.augment_test_split(
        assigned(spark, sf).drop("template"), fx.catalog(spark, sf), fx.dictionaries(spark, sf), DRAW, fields=fx.SEARCH_FIELDS
    )
    return st.split_label_counts(out)


@query("build_log")
def build_log(spark, sf):
    attacks = fx.qlog(spark, sf).where(F.col("label") == 1)
    return bu.build_log(
        attacks, order_rows(spark, sf), fx.catalog(spark, sf), fx.dictionaries(spark, sf), DRAW, "o_orderkey", fx.SEARCH_FIELDS
    )


@query("param_pool")
def param_pool(spark, sf):
    templates = fx.catalog(spark, sf).where(F.col("template") != fx.CONDITIONAL_TEMPLATE)
    return sy.param_pool(spread(templates), fx.dictionaries(spark, sf), DRAW).select(
        "tid", "param", F.array_join("candidates", "|").alias("candidates")
    )


# ---- labelling and cleaning --------------------------------------------------------------


@query("assign_split")
def assign_split(spark, sf):
    return assigned(spark, sf).select("id", "split")


@query("drop_contradictions")
def drop_contradictions(spark, sf):
    return cl.drop_contradictions(fx.qlog(spark, sf)).select("id", "full_query", "label")


@query("blank_admin_inputs")
def blank_admin_inputs(spark, sf):
    log = fx.qlog(spark, sf).withColumn("user_inputs", F.col("full_query"))
    admins = log.where(F.col("query_template_id").contains("admin"))
    return cl.blank_admin_inputs(log, admins).select("id", "user_inputs")


def held_out(log: DataFrame) -> DataFrame:
    """Templates of insert statements play the held-out ones."""
    return log.where(F.col("statement_type") == "insert").select("query_template_id")


@query("template_split")
def template_split(spark, sf):
    log = fx.qlog(spark, sf)
    return cl.template_split(log, held_out(log)).select("id", "template_split")


@query("extract_payload")
def extract_payload(spark, sf):
    log = fx.qlog(spark, sf)
    return cl.extract_payload(log.drop("template"), fx.log_templates(log)).select("id", "payload")


@query("drop_default_queries")
def drop_default_queries(spark, sf):
    log = fx.qlog(spark, sf)
    defaults = log.groupBy("query_template_id").agg(F.min_by("full_query", "id").alias("full_query"))
    return cl.drop_default_queries(log, defaults).select("id", "query_template_id", "full_query")


@query("campaign_status")
def campaign_status(spark, sf):
    attacks = fx.qlog(spark, sf).where(F.col("label") == 1)
    return cl.campaign_status(attacks).select("id", "attack_id", "attack_status")


@query("campaign_ids")
def campaign_ids(spark, sf):
    attacks = fx.qlog(spark, sf).where(F.col("label") == 1)
    return cl.campaign_ids(attacks).select("id", "campaign_no", "attack_id")


@query("user_input_mode")
def user_input_mode(spark, sf):
    return cl.user_input_mode(fx.qlog(spark, sf)).select("id", "full_query")


@query("train_val_split")
def train_val_split(spark, sf):
    return cl.train_val_split(assigned(spark, sf), DRAW).select("id", "part")


@query("train_val_split_exact")
def train_val_split_exact(spark, sf):
    return cl.train_val_split_exact(assigned(spark, sf), DRAW).select("id", "part")


# ---- features ----------------------------------------------------------------------------


def lexical(spark, sf, names: list[str]) -> DataFrame:
    f = lx.lexical_features(F.col("full_query"))
    return fx.qlog(spark, sf).select("id", *[f[n].alias(n) for n in names])


LI_GROUPS = {
    "li_length": ["len_query"],
    "li_word_flags": list(lx.WORD_FLAGS),
    "li_word_sets": list(lx.WORD_SETS),
    "li_substring_sets": list(lx.SUBSTRING_SETS),
    "li_comment": ["has_comment"],
    "li_comparison": ["c_comparison"],
    "li_tautology": ["has_tautology"],
    "li_char_kinds": [
        "c_num", "c_upper", "c_space", "c_special", "c_arith", "c_square_brackets",
        "c_round_brackets", "has_multiline_comment", "c_curly_brackets",
    ],
    "li_features": lx.FEATURES,
}
for _key, _names in LI_GROUPS.items():
    QUERIES[_key] = lambda spark, sf, names=_names: lexical(spark, sf, names)


@query("li_escapes")
def li_escapes(spark, sf):
    # Escaped spelling of the pages: every other special character as \\xHH or \\uHHHH.
    html = table(spark, sf, "pages").select(
        "page_id",
        F.regexp_replace(F.regexp_replace("html", "<", "\\\\x3c"), "&", "\\\\u0026").alias("t"),
    )
    return html.select("page_id", *[c.alias(n) for n, c in lx.escape_counts(F.col("t")).items()])


@query("tokens")
def tokens(spark, sf):
    t = tx.tokens(F.col("full_query"))
    return fx.qlog(spark, sf).select("id", F.size(t).alias("n"), F.array_join(t, " ").alias("tokens"))


def train_log(spark, sf) -> DataFrame:
    return assigned(spark, sf).where(F.col("split") == "train")


@query("vocabulary_topk")
def vocabulary_topk(spark, sf):
    return bow.vocabulary(train_log(spark, sf), bow.MAX_FEATURES)


@query("count_matrix")
def count_matrix(spark, sf):
    return bow.count_matrix(assigned(spark, sf), bow.vocabulary(train_log(spark, sf)))


@query("scale_standard")
def scale_standard(spark, sf):
    names = lx.FEATURES
    wide = lexical_log(spark, sf)
    return rounded(sc.scale_standard(wide, wide.where(F.col("split") == "train"), names).select("id", *names), *names)


def lexical_log(spark, sf) -> DataFrame:
    f = lx.lexical_features(F.col("full_query"))
    return materialise(assigned(spark, sf).select("id", "label", "split", "attack_technique", *[c.alias(n) for n, c in f.items()]), "lexical")


@query("scale_maxabs")
def scale_maxabs(spark, sf):
    names = lx.FEATURES
    wide = lexical_log(spark, sf)
    return rounded(
        sc.scale_maxabs(wide, wide.where(F.col("split") == "train"), names, (0.0, 1.0)).select("id", *names), *names
    )


@query("scale_counts")
def scale_counts(spark, sf):
    train = train_log(spark, sf)
    vocab = materialise(bow.vocabulary(train), "vocabulary")
    terms = bow.doc_terms(assigned(spark, sf))
    out = sc.scale_doc_terms(terms, bow.doc_terms(train), vocab, train.agg(F.count("*")).scalar())
    return rounded(out.select("id", "idx", "scaled"), "scaled")


@query("feature_min_check")
def feature_min_check(spark, sf):
    return sc.feature_minima(lexical_log(spark, sf), lx.FEATURES)


@query("embed_hash")
def embed_hash(spark, sf):
    """One row for each place of each embedding."""
    out = em.embed_hash(fx.qlog(spark, sf).select("id", "full_query"))
    # No embedding is empty; the outer form adds no filter on its size, which would compute every embedding again.
    cells = out.select("id", F.posexplode_outer("embedding").alias("place", "value"))
    return cells.select("id", F.col("place").cast("long").alias("place"), r6("value").alias("value"))


@query("embed_precomputed")
def embed_precomputed(spark, sf):
    v = table(spark, sf, "embeddings")
    return v.select(
        "vec_id", "label", F.size("embedding").alias("dim"),
        r6(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x)).alias("squared_norm"),
    )


# ---- detectors ---------------------------------------------------------------------------


def vectors(spark, sf) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), "label", F.col("embedding").cast("array<double>").alias("vec")
    )


def known(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("label") < KNOWN_CLASSES)


@query("lof_knn")
def lof_knn(spark, sf):
    rows = vectors(spark, sf)
    base = materialise(nb.distinct_vectors(known(rows)), "points")
    out = nb.k_nearest(rows, base, lof.neighbour_count(base, lof.K))
    return out.select("id", "nid", r6("dist").alias("dist"), F.col("w").cast("bigint").alias("w"))


@query("lof_density")
def lof_density(spark, sf):
    model, _ = lof.fit_lof(known(vectors(spark, sf)))
    return model.select("id", r6("k_dist").alias("k_dist"), r6("lrd").alias("lrd"))


@query("lof_score")
def lof_score(spark, sf):
    rows = vectors(spark, sf)
    model, k = lof.fit_lof(known(rows))
    return lof.score_lof(model, k, rows).select("id", "label", r6("score").alias("score"))


@query("lof_copies")
def lof_copies(spark, sf):
    """The same score on a table where copies of single vectors abound."""
    rows = lexical_log(spark, sf)
    small = rows.select(
        "id", "label", "split",
        F.array(*[F.col(c).cast("double") for c in lx.FEATURES if c.startswith("has_")]).alias("vec"),
    )
    model, k = lof.fit_lof(small.where(F.col("split") == "train"))
    return lof.score_lof(model, k, small).groupBy("vec").agg(
        F.count("*").alias("n"), F.count_distinct(r6("score")).alias("scores")
    ).select(F.array_join(F.transform("vec", lambda x: x.cast("int").cast("string")), "").alias("flags"), "n", "scores")


@query("lof_lsh")
def lof_lsh(spark, sf):
    """Neighbours by hash tables, compared with the exact ones by class."""
    rows = materialise(vectors(spark, sf), "vectors")
    base = materialise(nb.distinct_vectors(known(rows)), "points")
    k = lof.neighbour_count(base, lof.K)
    found = hashed.k_nearest_hashed(rows, base, k).select("id", "nid", F.col("w").alias("found"))
    both = nb.k_nearest(rows, base, k).select("id", "nid", "w").join(found, ["id", "nid"], "full")
    hits = both.groupBy("id").agg(
        F.sum("w").alias("w"), F.sum("found").alias("found"), F.sum(F.least("w", F.coalesce("found", F.lit(0)))).alias("hits")
    )
    return rows.join(hits, "id").groupBy("label").agg(
        F.count("*").alias("n"), F.sum("w").cast("bigint").alias("neighbours"), F.sum("found").cast("bigint").alias("found"),
        (F.sum("hits") >= 0.95 * F.sum("w")).alias("recall_95"),
    )


@query("ocsvm_gamma")
def ocsvm_gamma(spark, sf):
    return rounded(ocsvm.scale_gamma(vectors(spark, sf), 64), "gamma")


@query("ocsvm_score")
def ocsvm_score(spark, sf):
    rows = vectors(spark, sf)
    model = ocsvm.fit_ocsvm(known(rows), 64)
    return ocsvm.score_ocsvm(model, rows).select("id", "label", "score")


@query("ae_score")
def ae_score(spark, sf):
    from querysieve.operators.detectors import autoencoder as ae

    rows = vectors(spark, sf)
    model = ae.fit_autoencoder(known(rows), 64, "tanh", epochs=grid.EPOCHS)
    return ae.score_autoencoder(model, rows).select("id", "label", "score")


@query("reconstruction_mse")
def reconstruction_mse(spark, sf):
    v = table(spark, sf, "embeddings")
    # The reconstruction under test is the class mean.
    cells = v.select("label", F.posexplode("embedding").alias("i", "x"))
    means = cells.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    packed = means.groupBy("label").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("center")
    )
    joined = v.join(broadcast_if_small(packed), "label")
    return joined.select("vec_id", r6(mean_squared_error(F.col("embedding"), F.col("center"))).alias("score"))


@query("score_grid")
def score_grid(spark, sf):
    return grid.score_grid(fx.qlog(spark, sf)).select("model", "part", "id", "label", "score", "attack_technique")


@query("grid_report")
def grid_report(spark, sf):
    """The nine trained models of the grid, scored, thresholded and reported by one call."""
    return ev.evaluate(fx.qlog(spark, sf), scratch_path(spark, "grid-report"))


def rule_grid(log: DataFrame) -> DataFrame:
    """Rule scores as an untrained grid; its validation rows are the train split."""
    part = F.when(F.col("split") == "train", "val").otherwise(F.col("split"))
    return fx.rule_scores(cl.assign_split(log)).withColumn("part", part).drop("split")


@query("evaluation_report")
def evaluation_report(spark, sf):
    """Stored reports of the rule scores, on statements and on user inputs."""
    log, root = materialise(fx.qlog(spark, sf), "log"), scratch_path(spark, "evaluation")
    modes = [
        ev.evaluate(log, root, rule_grid, 0.05, fx.LOG_TECHNIQUES, on_user_inputs=inputs).withColumn("on_user_inputs", F.lit(inputs))
        for inputs in (False, True)
    ]
    return modes[0].unionByName(modes[1])


# ---- thresholds, metrics, curves ---------------------------------------------------------


@query("fpr_threshold")
def fpr_threshold(spark, sf):
    return rounded(me.fpr_threshold(validation(fx.rule_scores(assigned(spark, sf)))), "threshold")


@query("fpr_threshold_sketch")
def fpr_threshold_sketch(spark, sf):
    """Thresholds by a sketch; the exact scores tell whether their rank is as near as stated."""
    val = materialise(validation(fx.rule_scores(assigned(spark, sf))), "validation")
    rate = 0.05
    held = val.join(F.broadcast(me.fpr_threshold_sketch(val, rate)), "model")
    at = held.groupBy("model").agg(
        F.count("*").alias("n"), F.count_if(F.col("score") < F.col("threshold")).alias("below"),
        F.count_if(F.col("score") <= F.col("threshold")).alias("upto"), F.max("rank_error").alias("e"),
    )
    low, high = F.col("below") / F.col("n"), F.col("upto") / F.col("n")
    near = (low - F.col("e") - 1 / F.col("n") <= 1 - rate) & (high + F.col("e") + 1 / F.col("n") >= 1 - rate)
    return at.select("model", "n", near.alias("within_error"))


@query("threshold_share")
def threshold_share(spark, sf):
    val = validation(scored(spark, sf))
    return rounded(me.threshold_share(val, me.fpr_threshold(val, 0.05)), "share_above")


def predictions(spark, sf, rate: float = 0.05) -> DataFrame:
    scores = scored(spark, sf)
    return me.predict(tested(scores), me.fpr_threshold(validation(scores), rate))


@query("confusion")
def confusion(spark, sf):
    rates = ("accuracy", "fone", "precision", "recall", "fpr")
    return rounded(me.confusion(predictions(spark, sf)), *rates)


@query("metrics_report")
def metrics_report(spark, sf):
    scores = scored(spark, sf)
    return me.metrics_report(tested(scores), validation(scores), fx.LOG_TECHNIQUES, 0.05)


@query("pr_curve")
def pr_curve(spark, sf):
    return rounded(me.pr_curve(tested(fx.rule_scores(assigned(spark, sf)))), "threshold", "precision", "recall")


@query("auprc")
def auprc(spark, sf):
    return rounded(me.auprc(tested(fx.rule_scores(assigned(spark, sf)))), "auprc")


@query("roc_curve")
def roc_curve(spark, sf):
    return rounded(me.roc_curve(tested(fx.rule_scores(assigned(spark, sf)))), "threshold", "fpr", "tpr")


@query("auroc")
def auroc(spark, sf):
    return rounded(me.auroc(tested(fx.rule_scores(assigned(spark, sf)))), "auroc")


@query("recall_by_technique")
def recall_by_technique(spark, sf):
    return rounded(me.recall_by_technique(predictions(spark, sf)), "recall")


@query("recall_columns")
def recall_columns(spark, sf):
    names = [f"recall{t}" for t in fx.LOG_TECHNIQUES]
    return rounded(me.recall_columns(me.recall_by_technique(predictions(spark, sf)), fx.LOG_TECHNIQUES), *names)


@query("prevalence")
def prevalence(spark, sf):
    return rounded(me.prevalence(tested(fx.rule_scores(assigned(spark, sf)))), "prevalence")


@query("auc_from_points")
def auc_from_points(spark, sf):
    return rounded(me.auc_from_points(me.pr_curve(test_scores(spark, sf)), "recall", "precision", True), "area")


@query("label_consistency")
def label_consistency(spark, sf):
    # The second pipeline reads the quality mark as its label, so conflicts exist.
    log = assigned(spark, sf).select("id", "label")
    marks = table(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("label"))
    return me.label_conflicts(log.unionByName(marks))


# ---- dataset statistics ------------------------------------------------------------------


@query("stage_pivot")
def stage_pivot(spark, sf):
    """A third stage, of every eleventh attack, becomes a column."""
    late = F.when((F.col("label") == 1) & (F.col("id") % 11 == 0), "cleanup").otherwise(F.col("attack_stage"))
    rows = materialise(fx.qlog(spark, sf).select("attack_id", late.alias("attack_stage")), "stages")
    # A log without rows of a known stage has its column all the same, so the columns do not depend on the rows.
    return st.stage_pivot(rows, sorted({"cleanup", "exploit", "recon", *st.found_stages(rows)}))


@query("success_rate")
def success_rate(spark, sf):
    return st.success_rate(fx.qlog(spark, sf))


@query("split_label_counts")
def split_label_counts(spark, sf):
    return st.split_label_counts(assigned(spark, sf))


def templates_by_length(spark, sf) -> DataFrame:
    """A log whose template ids are rare enough for the set differences to be non-empty."""
    return assigned(spark, sf).withColumn(
        "query_template_id", F.concat("query_template_id", F.lit("-"), F.length("full_query").cast("string"))
    )


@query("templates_test_only")
def templates_test_only(spark, sf):
    return st.templates_test_only(templates_by_length(spark, sf))


@query("templates_no_attack")
def templates_no_attack(spark, sf):
    return st.templates_no_attack(templates_by_length(spark, sf))


@query("template_overlap")
def template_overlap(spark, sf):
    return st.template_overlap(templates_by_length(spark, sf))


@query("stmt_proportions")
def stmt_proportions(spark, sf):
    return rounded(st.stmt_proportions(assigned(spark, sf)), "proportion")


@query("template_split_stats")
def template_split_stats(spark, sf):
    log = fx.qlog(spark, sf)
    return st.template_split_stats(cl.template_split(log, held_out(log)))


# ---- relational workload -----------------------------------------------------------------


def airports(key: str, *names: str):
    """Register a workload query over some of the airport relations."""
    def add(fn):
        QUERIES[key] = lambda spark, sf: fn(*[fx.airport_tables(spark, sf)[n] for n in names])
        return fn

    return add


AIRPORT = ["id", "ident", "name", "type", "iso_country", "gps_code", "local_code"]

airports("wl_s01", "airport")(lambda a: wl.by_equality(a, "icao_code", "I64").select(*AIRPORT))
airports("wl_s02", "airport")(lambda a: wl.by_range(a, "elevation_ft", 1000, 5000, ["id", "name", "icao_code"]))
airports("wl_s03", "airport")(lambda a: wl.by_like(a, "name", "Field 1%", ["icao_code", "iata_code", "local_code"]))
airports("wl_s04", "airport")(lambda a: wl.by_either(a, ("gps_code", "G7"), ("local_code", "L9")).select(*AIRPORT))
airports("wl_s05", "airport", "regions")(lambda a, r: wl.region_counts(a, r, "2"))
airports("wl_s06", "airport")(lambda a: wl.by_equality(a, "iso_country", "3", ["id", "ident", "name"]))
airports("wl_s07", "airport_frequencies")(
    lambda f: wl.by_equality(f, "airport_ident", "Customer#000000010", ["type", "description", "frequency_mhz"])
)
airports("wl_s08", "airport")(lambda a: wl.by_equality_and_like(a, ("continent", "1"), ("iso_region", "1%")).select(*AIRPORT))
airports("wl_s09", "airport")(
    lambda a: wl.by_list_and_equality(a, "type", ["BUILDING", "MACHINERY"], ("iso_country", "4"), ["name", "municipality", "iso_country"])
)
airports("wl_s10", "airport")(lambda a: wl.keyword_or_name(a, "building%", "Field 2%"))
airports("wl_s11", "airport")(lambda a: wl.above_average(a, "2", 9000))
airports("wl_s12", "runways", "airport")(lambda r, a: wl.runways_of(r, a, "Customer#000000010", "ident"))
airports("wl_s13", "airport_frequencies", "airport", "navaids")(
    lambda f, a, n: rounded(wl.frequency_search(f, a, n, (100.0, 150.0), (1.0, 5.0)), "frequency")
)
airports("wl_s14", "airport")(lambda a: rounded(wl.nearest(a, "Field 7"), "distance"))
airports("wl_s15", "airport", "regions")(lambda a, r: wl.airports_in_region(a, r, "NATION_3"))
airports("wl_s16", "airport", "regions")(lambda a, r: wl.region_counts(a, r, "4"))
airports("wl_s17", "airport", "regions", "countries")(lambda a, r, c: wl.keyword_union(a, r, c, ["a", "a", "a"]))
airports("wl_s18", "airport", "regions", "countries")(lambda a, r, c: wl.keyword_union(a, r, c, ["g,k_", "nation_1", "asia"]))
airports("wl_s19", "airport", "runways")(lambda a, r: wl.busy_airports(a, r, "1", 10))
airports("wl_s20", "navaids", "countries")(lambda n, c: wl.navaid_types(n, c, "1", "AS", 2))
airports("wl_s21", "airport")(lambda a: wl.display_codes(a, "Town 1%"))
airports("wl_s22", "airport", "runways")(lambda a, r: wl.long_runways(a, r, "2", "3000"))
airports("wl_s23", "airport")(
    lambda a: wl.search(
        a, ["id"], type=("in", "BUILDING", "MACHINERY", "FURNITURE"), name=("any_like", "%1%", "%2%"),
        latitude_deg=("ge", -50), longitude_deg=("between", -100, 120), elevation_ft=("le", 8000),
        scheduled_service="yes", keywords=("in_set", "k1", "k2", "k4"),
    )
)


@query("wl_update")
def wl_update(spark, sf):
    """All single-target updates, one after the other, on their tables."""
    t = fx.airport_tables(spark, sf)
    a = wl.update(t["airport"], {"name": "Renamed"}, F.col("ident") == "Customer#000000005")
    a = wl.update(a, {"municipality": "Capital"}, F.col("iso_country") == "1")
    a = wl.update(a, {"keywords": "linked"}, F.col("name") == "Field 9")
    f = wl.update(t["airport_frequencies"], {"description": "changed"}, F.col("airport_ident") == "Customer#000000010")
    f = wl.update(f, {"frequency_mhz": 118.5}, F.col("type") == "2-HIGH")
    n = wl.update(t["navaids"], {"name": "Beacon"}, F.col("ident") == "Supplier#000000003")
    c = wl.update(t["countries"], {"keywords": "new"}, F.col("code") == "2")
    r = wl.update(t["regions"], {"keywords": "moved"}, F.col("iso_country") == "4")
    s = lambda df, kind, *cols, number=F.lit(None): df.select(
        F.lit(kind).alias("relation"), F.col("id").cast("bigint").alias("id"), F.concat_ws("|", *cols).alias("state"),
        number.cast("double").alias("number"),
    )
    return (
        s(a, "airport", "name", "municipality", "keywords")
        .unionByName(s(f, "frequency", "description", number=r6("frequency_mhz")))
        .unionByName(s(n, "navaid", "name"))
        .unionByName(s(c, "country", "keywords"))
        .unionByName(s(r, "region", "keywords"))
    )


@query("wl_update_in")
def wl_update_in(spark, sf):
    f = fx.airport_tables(spark, sf)["airport_frequencies"]
    names = [f"Customer#{n:09d}" for n in (1, 2, 4, 5)]
    return wl.update(f, {"type": "TWR"}, F.col("airport_ident").isin(names)).select("id", "airport_ident", "type")


@query("wl_insert")
def wl_insert(spark, sf):
    """New rows of all six relations, from suppliers, nations, customers and parts; missing columns stay null."""
    t, supplier = fx.airport_tables(spark, sf), table(spark, sf, "supplier")
    airports_ = supplier.select(
        F.concat(F.lit("new-"), "s_name").alias("ident"), F.lit("heliport").alias("type"), F.col("s_name").alias("name"),
        F.lit(1.5).alias("latitude_deg"), F.col("s_acctbal").alias("longitude_deg"),
    )
    regions_ = supplier.select(
        F.concat(F.lit("S-"), F.col("s_suppkey").cast("string")).alias("code"), F.col("s_name").alias("name"),
        F.lit("9").alias("iso_country"),
    )
    a = wl.insert(t["airport"], airports_, "ident").select(
        F.lit("airport").alias("relation"), F.col("ident").alias("code"), "id", "name", "iso_country"
    )
    r = wl.insert(t["regions"], regions_, "code").select(
        F.lit("region").alias("relation"), "code", F.col("id").cast("bigint").alias("id"), "name", "iso_country"
    )
    customer, s = table(spark, sf, "customer"), lambda c: F.col(c).cast("string")
    countries_ = table(spark, sf, "nation").select(F.concat(F.lit("C"), s("n_nationkey")).alias("code"), F.col("n_name").alias("name"))
    at = [(-F.col("c_custkey") - 1).alias("id"), F.col("c_custkey").alias("airport_ref"), F.col("c_name").alias("airport_ident")]
    frequencies_ = customer.select(*at, F.lit("TWR").alias("type"), F.lit(118.1).alias("frequency_mhz"))
    runways_ = customer.select(*at, F.lit(2500).alias("length_ft"), F.lit("ASP").alias("surface"))
    navaids_ = table(spark, sf, "part").select(
        (-F.col("p_partkey") - 1).alias("id"), F.concat(F.lit("N-"), s("p_partkey")).alias("ident"), F.col("p_name").alias("name"),
        F.lit("VOR").alias("type"),
    )
    none = F.lit(None).cast("string")
    rest = [
        ("country", "countries", countries_, "code", "code", "name", none),
        ("frequency", "airport_frequencies", frequencies_, "id", "airport_ident", "type", none),
        ("runway", "runways", runways_, "id", "airport_ident", "surface", none),
        ("navaid", "navaids", navaids_, "id", "ident", "name", F.col("iso_country")),
    ]
    out = a.unionByName(r)
    for kind, name, rows, key, code, label, country in rest:
        out = out.unionByName(wl.insert(t[name], rows, key).select(
            F.lit(kind).alias("relation"), F.col(code).alias("code"), F.col("id").cast("bigint").alias("id"), F.col(label).alias("name"),
            country.alias("iso_country"),
        ))
    return out


@query("wl_delete")
def wl_delete(spark, sf):
    t = fx.airport_tables(spark, sf)
    a = wl.delete(t["airport"], F.col("ident") == "Customer#000000003")
    a = wl.delete(a, F.col("gps_code") == "G7")
    f = wl.delete(t["airport_frequencies"], F.col("type") == "1-URGENT")
    u = wl.delete(t["runways"], F.col("airport_ident") == "Customer#000000010")
    n = wl.delete(t["navaids"], F.col("ident") == "Supplier#000000002")
    c = wl.delete(t["countries"], F.col("code") == "0")
    r = wl.delete(t["regions"], F.col("name") == "NATION_7")
    s = lambda df, kind: df.select(F.lit(kind).alias("relation"), F.col("id").cast("bigint").alias("id"))
    return s(a, "airport").unionByName(s(f, "frequency")).unionByName(s(u, "runway")).unionByName(
        s(n, "navaid")).unionByName(s(c, "country")).unionByName(s(r, "region"))


@query("wl_delete_or_like")
def wl_delete_or_like(spark, sf):
    a = fx.airport_tables(spark, sf)["airport"]
    return wl.delete(a, F.col("name").like("Field 5%") | F.col("iata_code").like("A1%")).select("id", "name")


@query("key_violations")
def key_violations(spark, sf):
    return wl.key_violations(fx.airport_tables(spark, sf)["airport"], "name")


@query("missing_references")
def missing_references(spark, sf):
    t = fx.airport_tables(spark, sf)
    return wl.missing_references(t["airport"], "id", t["runways"], "airport_ref").select("id")


# ---- streaming ---------------------------------------------------------------------------


@query("stream_features")
def stream_features(spark, sf):
    return ss.stream_lexical(spark, fx.qlog(spark, sf).select("id", "full_query"))


def fixed_machine(dim: int = 64, features: int = 8) -> ocsvm.OneClassModel:
    """A one-class machine of small fixed weights."""
    i, j = np.arange(dim)[:, None], np.arange(features)
    return ocsvm.OneClassModel(dim, (j % 3 - 1) / 4, 0.125, ((7 * i + 3 * j) % 11 - 5) / 10, j / 8)


@query("ocsvm_stream")
def ocsvm_stream(spark, sf):
    """Scores of a stream that is stopped in the middle and resumed from its checkpoint."""
    rows = vectors(spark, sf).select("id", "label", "vec")
    score = lambda df: ocsvm.score_ocsvm(fixed_machine(), df)
    scored_ = ss.stop_and_resume(spark, rows.repartition(6, "id"), score)
    return rounded(scored_.select("id", "label", "score"), "score")
