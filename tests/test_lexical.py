import time
import re

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from querysieve.functions import lexical as lx, text as tx


def features(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    rows = df.select("id", *[c.alias(n) for n, c in lx.lexical_features(F.col("t")).items()]).orderBy("id").collect()
    return [r.asDict() for r in rows]


CASES = [
    ("", {"len_query": 0, "c_special": 0, "has_tautology": 0}),
    ("a<=1", {"c_comparison": 3, "c_num": 1, "c_special": 2}),
    ("a<>b != c", {"c_comparison": 5}),
    ("1=1", {"has_tautology": 1}),
    ("id=id2", {"has_tautology": 1}),
    ("xid=id", {"has_tautology": 1}),
    ("a = a", {"has_tautology": 0}),
    ("a=b=b", {"has_tautology": 1}),
    ("A=a", {"has_tautology": 0}),
    ("é=é", {"has_tautology": 1}),
    ("border", {"has_connection_keywords": 1, "has_order": 0}),
    ("ORDER by x", {"has_order": 1, "has_connection_keywords": 1, "c_upper": 5}),
    ("/*/ a*/b", {"has_multiline_comment": 1, "c_arith": 2}),
    ("1/2*3+4-5", {"has_multiline_comment": 0, "c_arith": 4, "c_num": 5}),
    ("-- x", {"has_comment": 1, "c_arith": 2}),
    ("# x", {"has_comment": 1, "c_special": 1}),
    ("'\"'", {"c_special": 3}),
    ("[(){}]", {"c_square_brackets": 2, "c_round_brackets": 2, "c_curly_brackets": 2, "c_special": 0}),
    ("x²ÀÉ \x1c½", {"c_num": 1, "c_upper": 2, "c_space": 2, "c_special": 0}),
    ("SeLeCt NULL union_all", {"has_query_keywords": 1, "has_null": 1, "has_union": 0}),
    ("exec(if) ifx éif", {"has_exec": 1, "has_if": 1}),
    ("éif", {"has_if": 0}),
    ("SUBSTRING(a) asc1", {"has_string_functions": 1}),
    ("asc1", {"has_string_functions": 0}),
    ("MSysObjects LOAD_FILE", {"has_database_keywords": 1, "has_file_keywords": 1}),
]


def test_edge_rows(spark):
    for (text, want), got in zip(CASES, features(spark, [c[0] for c in CASES])):
        assert {k: got[k] for k in want} == want, text


def test_null_text_gives_nulls(spark):
    assert set(features(spark, [None])[0].values()) == {0, None}


def test_feature_list(spark):
    assert len(lx.FEATURES) == 32 and list(lx.lexical_features(F.lit("x"))) == lx.FEATURES


texts = st.lists(st.text(alphabet="ab1=_ é-/*'²A<", max_size=14), min_size=1, max_size=60)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(texts)
def test_against_brute_force(spark, sample):
    for text, got in zip(sample, features(spark, sample)):
        assert got["has_tautology"] == int(re.search(r"(\w+)=\1", text) is not None), text
        assert got["c_num"] == sum(c.isdigit() for c in text)
        assert got["c_upper"] == sum(c.isupper() for c in text)
        assert got["c_space"] == sum(c.isspace() for c in text)
        assert got["len_query"] == len(text)


def test_tokens_and_escapes(spark):
    row = spark.createDataFrame([("A bc_d É1x \\x41 \\u0041 \\x4",)], "t string").select(
        tx.tokens(F.col("t")).alias("tokens"), *[c.alias(n) for n, c in lx.escape_counts(F.col("t")).items()]
    ).first()
    assert row["tokens"] == ["bc_d", "é1x", "x41", "u0041", "x4"]
    assert (row["c_hex"], row["c_unicode"]) == (1, 1)


@pytest.mark.parametrize("statement,template,want", [
    ('SELECT * FROM t WHERE a = "x" OR 1=1 -- "', 'SELECT * FROM t WHERE a = "{a}"', " x  OR 1=1 --  "),
    ("a1b2c", "a{x}b{x}c", " 1 2 "),
    ("SHOW TABLES;", "SHOW TABLES;", " "),
])
def test_payload(spark, statement, template, want):
    df = spark.createDataFrame([(statement, template)], "s string, t string")
    assert df.select(tx.payload(F.col("s"), F.col("t"))).first()[0] == want


def test_enclosed_capitals_count_once(spark):
    got = features(spark, ["Ⓐⓐ\U0001f130#"])[0]
    assert (got["c_upper"], got["c_special"]) == (2, 2)


def test_tautology_of_long_runs_takes_linear_time(spark):
    run = "a" * 100_000
    texts = [(f"{run}b=c{run}", 0), (f"{run}={run}b", 1), (f"b{run}=c{run}", 0), (f"x{run}y=y{run}z", 1), (f"{'0f' * 50_000}=f{'1e' * 50_000}", 1)]
    df = spark.createDataFrame([(t,) for t, _ in texts], "t string")
    start = time.time()
    assert [r[0] for r in df.select(lx.has_tautology(F.col("t"))).collect()] == [want for _, want in texts]
    assert time.time() - start < 30


def test_counts_meet_their_terms_once(spark, sf):
    """Counts joined the vocabulary, then the deviations; both joins now are one, with the same values."""
    import __spark_entry__ as entry
    from querysieve.operators import bagofwords as bow, scaling as sc

    docs = spark.createDataFrame([(1, "aa aa bb"), (2, "aa cc"), (3, ""), (4, "bb bb dd")], "id int, full_query string")
    train = docs.where("id < 4")
    vocab, n = bow.vocabulary(train), train.agg(F.count("*")).scalar()
    want = sc.scale_counts(bow.count_matrix(docs, vocab), bow.count_matrix(train, vocab), n)
    got = sc.scale_doc_terms(bow.doc_terms(docs), bow.doc_terms(train), vocab, n)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select("id", "idx", "n", "scaled").collect()))
    # The documents' own join with labels and the join with the terms.
    plan = entry.queries()["scale_counts"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 2


def test_counts_of_characters_do_not_join_what_letters_part(spark):
    got, = features(spark, ["<a= >b= <c> !d= /e* *f/ -g- É1h² \u24b6i [j] {k}"])
    assert got["c_comparison"] == 7 and got["has_multiline_comment"] == 0 and got["c_arith"] == 6
    assert (got["c_num"], got["c_upper"], got["c_square_brackets"], got["c_curly_brackets"]) == (2, 2, 2, 2)


def test_classes_are_counted_on_what_lower_case_leaves(spark):
    df = spark.createDataFrame([("a",)], "t string")
    found = lx.lexical_features(F.col("t"))
    plan = df.select(*[found[n] for n in ("c_num", "c_upper", "c_space", "c_special")])._jdf.queryExecution().optimizedPlan().toString()
    for name in (lx.DIGITS, lx.UPPER, lx.SPACE, lx.SPECIAL):
        assert f"regexp_replace(regexp_replace(t#" in plan and f"[a-z]+, , 1), {name}, , 1)" in plan


def test_rule_scores_search_a_text_once(spark, sf):
    from querysieve.plans import fixtures as fx

    plan = fx.rule_scores(fx.qlog(spark, sf))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("exists(arrays_zip(") == 1
