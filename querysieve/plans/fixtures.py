"""Views that shape the driver tables into query logs, catalogues and airport relations.

The same views exist as SQL in ``plans.oracle``; both sides use plain integer draws.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from querysieve.functions import draws as dr, lexical as lx
from querysieve.schemas import STATEMENT_SHARES
from querysieve.session import spread
from querysieve.sources.dictionaries import build_dictionaries, column_values

# Statement wrappers of the derived log: type -> (letter, text before, text after the table number).
LOG_TEMPLATES = {
    "select": ("S", "SELECT id, title FROM articles_", ' WHERE body = "{body}" ORDER BY title ASC;'),
    "delete": ("D", "DELETE FROM articles_", ' WHERE body = "{body}";'),
    "update": ("U", "UPDATE articles_", ' SET body = "{body}" WHERE edits <= 3;'),
    "insert": ("I", "INSERT INTO articles_", ' (body) VALUES ("{body}")'),
    "admin": ("admin", "SHOW GRANTS FOR articles_", '.\'{body}\';'),
}
TEMPLATES_PER_TYPE = 13

# Injected suffix of attack rows, in the order of LOG_TECHNIQUES.
LOG_TECHNIQUES = ["boolean", "error", "inline", "stacked", "time", "union"]
LOG_PAYLOADS = [
    '" OR 1=1 -- ',
    '" AND EXISTS(SELECT COUNT(*), FLOOR(RAND(0)*2) FROM information_schema.tables GROUP BY 2) -- ',
    '" OR (SELECT CONCAT(ASCII(MID(version(),1,1)))) = "5',
    '"; DROP TABLE articles; #',
    '" AND IF(1=1,SLEEP(5),0) /* wait */ -- ',
    '" UNION ALL SELECT NULL,NULL,LENGTH(user()) -- ',
]

# Cumulative percentages of the statement types, used on a number modulo 100.
TYPE_BANDS = [("select", 70), ("delete", 79), ("update", 89), ("insert", 99), ("admin", 100)]

# Catalogue templates: type -> spellings; <brand> and <name> come from the part row.
CATALOG_TEMPLATES = {
    "select": [
        'SELECT * FROM part WHERE p_brand = "<brand>" AND p_name LIKE "{part_name}"',
        'SELECT * FROM customer WHERE c_mktsegment = "{customer_segment}" OR c_mktsegment = "{customer_segment}" LIMIT {rand_small_pos_number}',
        'SELECT * FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey WHERE n.n_name = "{nation_name}" AND r.r_name = "{region_name}" OR n.n_comment = "<name>"',
    ],
    "delete": [
        'DELETE FROM orders WHERE o_orderpriority = "{order_priority}" AND o_orderkey = {rand_pos_number}',
        'DELETE FROM part WHERE p_brand = "<brand>" AND p_name = "{part_name}";',
        'DELETE FROM nation WHERE n_name = "{nation_name}";',
    ],
    "update": [
        'UPDATE part SET p_name = "{part_name}" WHERE p_partkey IN ({rand_pos_number},{rand_pos_number},{rand_pos_number},{rand_pos_number}) AND p_brand = "<brand>"',
        'UPDATE nation SET n_comment = "{rand_string}" WHERE n_name = "{nation_name}"',
        'UPDATE orders SET o_totalprice = {rand_medium_pos_number} WHERE o_orderpriority = "{order_priority}"',
    ],
    "insert": [
        'INSERT INTO nation (n_name, n_comment) VALUES ("{nation_name}", "{rand_string}")',
        'INSERT INTO part (p_name, p_brand) VALUES ("{part_name}", "<brand>")',
        'INSERT INTO region (r_name) VALUES ("{region_name}")',
    ],
    "admin": ["SHOW TABLES;", "SHOW GRANTS FOR '{admin_username}';", "KILL QUERY {rand_pos_number}"],
}
CONDITIONAL_TEMPLATE = "SELECT p_partkey FROM part WHERE {conditions}"
CONDITIONAL_SIZE = 23

SEARCH_FIELDS = {
    "type": ['p_type = "{part_name}"', 'p_type LIKE "{part_name}"', 'p_type IN ("{part_name}","{part_name}")'],
    "name": ['p_name LIKE "%{rand_string}%"', 'p_name LIKE "%{rand_string}%" OR p_name LIKE "%{rand_string}%"'],
    "size": ["p_size >= {rand_small_pos_number}", "p_size <= {rand_small_pos_number}",
             "p_size BETWEEN {rand_small_pos_number} AND {rand_small_pos_number}"],
    "price": ["p_retailprice >= {rand_medium_pos_number}", "p_retailprice <= {rand_medium_pos_number}"],
    "key": ["p_partkey = {rand_pos_number}"],
    "nation": ['n_name = "{nation_name}"', 'n_name LIKE "{nation_name}"'],
    "geo": ['r_name = "{region_name}"', '( FIND_IN_SET("{rand_string}", p_name) > 0 OR FIND_IN_SET("{rand_string}", p_name) > 0)'],
}

LETTERS = {"select": "S", "delete": "D", "update": "U", "insert": "I", "admin": "admin"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _banded(number: Column) -> Column:
    out = F
    for kind, upper in TYPE_BANDS[:-1]:
        out = out.when(number % 100 < upper, kind)
    return out.otherwise(TYPE_BANDS[-1][0])


def _pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def _by_type(kind: Column, values: dict[str, Column | str]) -> Column:
    out = F
    for name, value in values.items():
        out = out.when(kind == name, value if isinstance(value, Column) else F.lit(value))
    return out


def qlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A labelled query log: every document's whole text inside a statement, attacks with a payload."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    marks = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    base = docs.join(marks, "doc_id", "left").select(
        F.col("doc_id").alias("id"),
        F.length("text").cast("bigint").alias("n"),
        F.replace(F.col("text"), F.lit('"'), F.lit('""')).alias("body"),
        F.coalesce("toxic", F.lit(0)).cast("int").alias("label"),
    )
    attack, id_ = F.col("label") == 1, F.col("id")
    number = (F.col("n") % TEMPLATES_PER_TYPE).cast("string")
    kind = F.col("statement_type")
    # Some recon probes go out without a payload, so they equal a benign statement.
    probe = (id_ % 7).isin(3, 5)
    typed = base.withColumns({
        "statement_type": _banded(F.col("n")),
        "inputs": F.when(attack & ~probe, F.concat("body", _pick(LOG_PAYLOADS, id_ % 6))).otherwise(F.col("body")),
    }).withColumns({
        "query_template_id": F.concat(
            F.lit("shop-"), _by_type(kind, {k: v[0] for k, v in LOG_TEMPLATES.items()}), number
        ),
        "template": F.concat(
            _by_type(kind, {k: v[1] for k, v in LOG_TEMPLATES.items()}), number,
            _by_type(kind, {k: v[2] for k, v in LOG_TEMPLATES.items()}),
        ),
    })
    return typed.select(
        "id",
        F.replace(F.col("template"), F.lit("{body}"), F.col("inputs")).alias("full_query"),
        "label",
        F.when(kind == "admin", "").when(id_ % 17 == 0, F.lit(None)).otherwise(F.col("inputs")).alias("user_inputs"),
        F.when(attack, F.when(id_ % 7 < 3, "exploit").otherwise("recon")).alias("attack_stage"),
        F.when(attack, F.concat(F.lit("t"), (id_ % 8).cast("string"))).alias("tamper_method"),
        F.when(attack, F.when(id_ % 5 < 2, "success").otherwise("failure")).alias("attack_status"),
        "statement_type",
        "query_template_id",
        F.when(attack, F.concat(_pick(LOG_TECHNIQUES, id_ % 6), F.lit("-"), (id_ % 12).cast("string"))).alias("attack_id"),
        F.when(attack, _pick(LOG_TECHNIQUES, id_ % 6)).alias("attack_technique"),
        F.when(attack, "test").when(id_ % 2 == 0, "train").when(id_ % 5 != 0, "test").alias("split"),
        "template",
    )


def log_templates(log: DataFrame) -> DataFrame:
    """The templates the log was written from."""
    return log.select("query_template_id", "statement_type", "template").distinct()


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One statement template per part row."""
    part = table(spark, sf_dir, "part").withColumn("statement_type", _banded(F.col("p_partkey")))
    kind, tid = F.col("statement_type"), F.col("p_partkey")
    spelled = _by_type(kind, {k: _pick(v, tid % len(v)) for k, v in CATALOG_TEMPLATES.items()})
    spelled = F.when((kind == "select") & (F.col("p_size") == CONDITIONAL_SIZE), CONDITIONAL_TEMPLATE).otherwise(spelled)
    text = F.replace(F.replace(spelled, F.lit("<brand>"), F.col("p_brand")), F.lit("<name>"), F.col("p_name"))
    return part.select(
        tid.alias("tid"),
        text.alias("template"),
        F.concat(F.lit("shop-"), _by_type(kind, LETTERS), tid.cast("string")).alias("ID"),
        F.concat(F.lit("Statement about "), "p_name").alias("description"),
        F.lit("string").alias("payload_type"),
        _by_type(kind, {k: F.lit(v) for k, v in STATEMENT_SHARES.items()}).alias("proportion"),
        "statement_type",
    )


# dictionary -> (table, key, column)
DICTIONARIES = {
    "nation_name": ("nation", "n_nationkey", "n_name"),
    "region_name": ("region", "r_regionkey", "r_name"),
    "customer_segment": ("customer", "c_custkey", "c_mktsegment"),
    "part_name": ("part", "p_partkey", "p_name"),
    "order_priority": ("orders", "o_orderkey", "o_orderpriority"),
    "admin_username": ("supplier", "s_suppkey", "s_name"),
}


def dictionaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [
        column_values(table(spark, sf_dir, t), key, {name: column})
        for name, (t, key, column) in DICTIONARIES.items()
    ]
    return build_dictionaries(parts, "shop")


def rule_scores(log: DataFrame) -> DataFrame:
    """Three hand-made scores per log row, in long form."""
    # Measures are columns of their own first: inside a ratio each would search the text for itself.
    measures = ["c_special", "has_tautology", "c_comparison", "len_query", "has_comment", "has_union", "has_exist_keyword", "has_sleep"]
    features, f = lx.lexical_features(F.col("full_query")), {n: F.col(n) for n in measures}
    kept = ["id", "label", "attack_technique", "split"]
    measured = log.select(*kept, *[features[n].alias(n) for n in measures])
    rules = {
        "density": (f["c_special"] + 10 * f["has_tautology"] + f["c_comparison"]) / f["len_query"],
        "keywords": (f["has_comment"] + f["has_union"] + f["has_exist_keyword"] + f["has_sleep"] + f["has_tautology"]).cast("double"),
        "length": f["len_query"].cast("double"),
    }
    wide = measured.select(*kept, *[c.cast("double").alias(n) for n, c in rules.items()])
    return wide.unpivot(["id", "label", "attack_technique", "split"], list(rules), "model", "score")


def airport_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The six relations of the statement templates over the driver tables."""
    s = lambda c: c.cast("string")
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    airport = table(spark, sf_dir, "customer").select(
        key.alias("id"),
        F.col("c_name").alias("ident"),
        F.col("c_mktsegment").alias("type"),
        F.concat(F.lit("Field "), s(key % 997)).alias("name"),
        (key * 37 % 161 - 80).cast("double").alias("latitude_deg"),
        (key * 91 % 341 - 170).cast("double").alias("longitude_deg"),
        F.col("c_acctbal").alias("elevation_ft"),
        s(nation % 5).alias("continent"),
        s(nation % 5).alias("iso_country"),
        s(nation).alias("iso_region"),
        F.concat(F.lit("Town "), s(nation)).alias("municipality"),
        F.when(key % 2 == 0, "yes").otherwise("no").alias("scheduled_service"),
        F.when(key % 3 != 0, F.concat(F.lit("G"), s(key % 50))).alias("gps_code"),
        F.when(key % 7 != 0, F.concat(F.lit("I"), s(key))).alias("icao_code"),
        F.when(key % 4 != 0, F.concat(F.lit("A"), s(key % 100))).alias("iata_code"),
        F.when(key % 5 != 0, F.concat(F.lit("L"), s(key % 60))).alias("local_code"),
        F.lower(F.concat_ws(",", "c_mktsegment", F.concat(F.lit("k"), s(key % 11)))).alias("keywords"),
    )
    orders = table(spark, sf_dir, "orders")
    ident = F.concat(F.lit("Customer#"), F.lpad(s(F.col("o_custkey")), 9, "0"))
    supplier, s_nation = table(spark, sf_dir, "supplier"), F.col("s_nationkey")
    return {
        "airport": airport,
        "runways": orders.select(
            F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("airport_ref"), ident.alias("airport_ident"),
            F.col("o_totalprice").alias("length_ft"), F.col("o_orderstatus").alias("surface"),
        ),
        "airport_frequencies": orders.select(
            F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("airport_ref"), ident.alias("airport_ident"),
            F.col("o_orderpriority").alias("type"), F.col("o_orderstatus").alias("description"),
            (F.col("o_totalprice") / 1000).alias("frequency_mhz"),
        ),
        "navaids": supplier.select(
            F.col("s_suppkey").alias("id"), F.col("s_name").alias("ident"), F.col("s_name").alias("name"),
            _pick(["VOR", "NDB", "DME"], F.col("s_suppkey") % 3).alias("type"),
            F.when(F.col("s_suppkey") % 6 != 0, F.col("s_acctbal")).alias("frequency_khz"),
            s(s_nation % 5).alias("iso_country"), F.lit("BOTH").alias("usageType"),
        ),
        "countries": table(spark, sf_dir, "region").select(
            F.col("r_regionkey").alias("id"), s(F.col("r_regionkey")).alias("code"), F.col("r_name").alias("name"),
            F.lower("r_name").alias("keywords"),
        ),
        "regions": table(spark, sf_dir, "nation").select(
            F.col("n_nationkey").alias("id"), s(F.col("n_nationkey")).alias("code"), F.col("n_name").alias("name"),
            s(F.col("n_regionkey")).alias("iso_country"), F.lower("n_name").alias("keywords"),
        ),
    }


DRAW = dr.linear()
