import math
import random

import pytest
from pyspark.sql import functions as F

from querysieve.operators import workload as wl
from querysieve.schemas import AIRPORT_TABLES


def airport(spark):
    rows = [(1, "A", "x", 10.0, "k1,k2", "C"), (2, "B", "y", None, None, "C"), (3, None, "y", 30.0, "k2", None)]
    return spark.createDataFrame(rows, "id int, ident string, name string, elevation_ft double, keywords string, iso_country string")


def test_delete_and_update_keep_unknown_rows(spark):
    a = airport(spark)
    assert sorted(r["id"] for r in wl.delete(a, F.col("ident") == "A").collect()) == [2, 3]
    out = wl.update(a, {"name": "new", "elevation_ft": 5}, F.col("iso_country") == "C")
    assert [(r["id"], r["name"], r["elevation_ft"]) for r in out.orderBy("id").collect()] == [(1, "new", 5.0), (2, "new", 5.0), (3, "y", 30.0)]


def test_insert_checks_the_key(spark):
    a = airport(spark)
    new = lambda *ids: spark.createDataFrame([(i,) for i in ids], "ident string")
    assert wl.insert(a, new("Z"), "ident").where("ident = 'Z' AND name IS NULL").count() == 1
    for bad in (new("A"), new("Q", "Q")):
        with pytest.raises(Exception, match="duplicate ident"):
            wl.insert(a, bad, "ident").collect()


def test_scalar_lookup_must_be_single(spark):
    runways = spark.createDataFrame([(7, 1, 100.0, "S")], "id int, airport_ref int, length_ft double, surface string")
    assert wl.runways_of(runways, airport(spark), "x").count() == 1
    with pytest.raises(Exception, match="SCALAR_SUBQUERY"):
        wl.runways_of(runways, airport(spark), "y").collect()


def test_search_words(spark):
    rows = wl.search(airport(spark), ["id"], keywords=("in_set", "k2", "zz"), elevation_ft=("ge", 5)).collect()
    assert sorted(r["id"] for r in rows) == [1, 3]


def test_references_and_schemas(spark):
    child = spark.createDataFrame([(1,), (9,), (None,)], "airport_ref int")
    assert [r[0] for r in wl.missing_references(child, "airport_ref", airport(spark), "id").collect()] == [9]
    assert {t: len(s) for t, s in AIRPORT_TABLES.items()} == {
        "airport": 19, "airport_frequencies": 6, "runways": 20, "navaids": 20, "countries": 6, "regions": 8,
    }


def test_filters_and_columns_reach_the_scan(spark, sf):
    from querysieve.plans import fixtures as fx

    plan = wl.by_range(fx.airport_tables(spark, sf)["airport"], "elevation_ft", 1000, 5000, ["id", "name"])
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(c_acctbal,1000.0)" in text and "c_mktsegment" not in text


def test_keys_are_like_patterns(spark):
    a = airport(spark).withColumn("municipality", F.lit("m"))
    found = wl.keyword_union(a, a, a, ["k_,k", "zz", "zz"]).collect()
    assert [tuple(r) for r in found] == [("x", "airport")]
    assert sorted(r["id"] for r in wl.keyword_or_name(a, "k2%", "x").collect()) == [1, 3]


def test_terms_are_counted_in_their_row(spark):
    from querysieve.operators import bagofwords as bow

    docs = spark.createDataFrame([(1, "bb aa bb"), (2, None), (3, ""), (4, "cc")], "id int, full_query string")
    made = bow.doc_terms(docs)
    assert sorted(tuple(r) for r in made.collect()) == [(1, "aa", 1), (1, "bb", 2), (4, "cc", 1)]
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()


def places(spark, rows):
    return spark.createDataFrame(
        [(i, f"I{i}", name, lat, lon) for i, name, lat, lon in rows],
        "id bigint, ident string, name string, latitude_deg double, longitude_deg double",
    )


def brute_nearest(rows, name, n):
    def km(a, b):
        if None in (*a, *b):
            return None
        (la, lo), (lb, lp) = [[math.radians(x) for x in p] for p in (a, b)]
        cosine = math.cos(la) * math.cos(lb) * math.cos(lp - lo) + math.sin(la) * math.sin(lb)
        return 6371 * math.acos(max(-1, min(1, cosine)))

    pairs = [(km(r[2:], o[2:]), r[0]) for o in rows if o[1] == name for r in rows if r[0] != o[0]]
    return sorted(pairs, key=lambda p: (p[0] is not None, p[0] or 0, p[1]))[:n]


@pytest.mark.parametrize("kind", ["spread", "poles", "crowd", "nulls", "few", "none"])
def test_nearest_by_cells_is_the_nearest_of_all(spark, kind):
    draw = random.Random(3)
    spot = {
        "spread": lambda: (draw.uniform(-89, 89), draw.uniform(-180, 180)),
        "poles": lambda: (draw.choice([-1, 1]) * draw.uniform(85, 90), draw.choice([draw.uniform(-180, 180), 180.0, -180.0, 179.99])),
        "crowd": lambda: draw.choice([(10.0, 20.0), (10.0, 20.0), (draw.uniform(9.99, 10.01), 20.0), (draw.uniform(-60, 60), 100.0)]),
        "nulls": lambda: draw.choice([(None, 1.0), (None, None), (draw.uniform(-5, 5), draw.uniform(-5, 5))]),
        "few": lambda: (draw.uniform(-89, 89), draw.uniform(-180, 180)),
        "none": lambda: (1.0, 2.0),
    }[kind]
    count = {"few": 9, "none": 20}.get(kind, 400)
    rows = [(i, "o" if i % (3 if kind == "crowd" else 37) == 0 and kind != "none" else "a", *spot()) for i in range(count)]
    got = [(r["distance"], r["id"]) for r in wl.nearest(places(spark, rows), "o", 20).collect()]
    want = brute_nearest(rows, "o", 20)
    assert [d if d is None else round(d, 3) for d, _ in got] == [d if d is None else round(d, 3) for d, _ in want]
    if kind != "crowd":  # rounding decides between places that lie as far
        assert [i for _, i in got] == [i for _, i in want]


def test_nearest_has_no_cartesian_product(spark):
    a = places(spark, [(i, "o", i / 10, i / 7) for i in range(50)])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        origin = a.selectExpr("id AS _id", "latitude_deg AS _lat", "longitude_deg AS _lon", "latitude_deg AS _north", "longitude_deg AS _east")
        held = a.withColumns({"_north": F.col("latitude_deg"), "_east": F.col("longitude_deg")})
        plan = wl.pairs_in_cells(held, origin, 5)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
        assert wl.nearest(a, "o", 5).count() == 5
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_long_runways_mean_of_halves(spark):
    """A mean that ends in a half rounds up in whatever order its lengths are added; as doubles these give 257100.49999999997."""
    lengths = [
        296588.53, 282479.74, 204896.02, 308825.53, 168419.92, 393690.62, 100172.88, 407316.93, 415997.51, 229011.59, 20706.23,
    ]
    airport = spark.createDataFrame([(1, "a", "m", "2")], "id long, name string, municipality string, iso_country string")
    means = set()
    for turned in (lengths, lengths[::-1], sorted(lengths)):
        rows = [(i, 1, x) for i, x in enumerate(turned)]
        runways = spark.createDataFrame(rows, "id long, airport_ref long, length_ft double").coalesce(1)
        found = {r["airport_name"]: r["avg_runway_length"] for r in wl.long_runways(airport, runways, "2", "3000").collect()}
        means.add(found["a"])
    assert means == {257101}
    far = spark.createDataFrame([(1, 2, 1e25), (2, 2, 3e25)], "id long, airport_ref long, length_ft double")
    rough = wl.runway_stats(far).first()
    assert (rough["_len"], rough["_rough"], rough["_lens"]) == (None, 4e25, 2)
