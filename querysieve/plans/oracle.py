"""SQL oracles: the registered queries written independently for an embedded SQL engine."""

from __future__ import annotations

import re

from querysieve.operators import build as bu
from querysieve.plans import fixtures as fx
from querysieve.operators.synth import SLOT_FIELDS, SLOT_FILLER, SLOT_ROLE, SLOT_TEMPLATE, SLOT_VARIANT
from querysieve.functions import draws as dr, lexical as lx, text as tx
from querysieve.schemas import STATEMENT_SHARES, TECHNIQUES


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def lst(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def draw(row: str, slot) -> str:
    return f"((CAST({row} AS BIGINT) % 2147483647 * 1103515245 + CAST({slot} AS BIGINT) * 12345) % 2147483647)"


def by_type(kind: str, values: dict[str, str]) -> str:
    return f"CASE {kind} " + " ".join(f"WHEN {q(k)} THEN {v}" for k, v in values.items()) + " END"


def banded(n: str) -> str:
    parts = [f"WHEN {n} % 100 < {upper} THEN {q(kind)}" for kind, upper in fx.TYPE_BANDS[:-1]]
    return "CASE " + " ".join(parts) + f" ELSE {q(fx.TYPE_BANDS[-1][0])} END"


def pick(values, index: str) -> str:
    return f"{lst(values)}[CAST({index} AS INT) + 1]"


QLOG = f"""
base AS (
  SELECT d.doc_id AS id, CAST(length(d.text) AS BIGINT) AS n, replace(d.text, '"', '""') AS body,
         CAST(coalesce(l.toxic, 0) AS INT) AS label
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
typed AS (SELECT *, {banded('n')} AS statement_type, CAST(n % {fx.TEMPLATES_PER_TYPE} AS VARCHAR) AS number,
  CASE WHEN label = 1 AND id % 7 NOT IN (3, 5) THEN body || {pick(fx.LOG_PAYLOADS, 'id % 6')} ELSE body END AS inputs FROM base),
tpl AS (SELECT *, 'shop-' || {by_type('statement_type', {k: q(v[0]) for k, v in fx.LOG_TEMPLATES.items()})} || number AS query_template_id,
  {by_type('statement_type', {k: q(v[1]) for k, v in fx.LOG_TEMPLATES.items()})} || number
  || {by_type('statement_type', {k: q(v[2]) for k, v in fx.LOG_TEMPLATES.items()})} AS template FROM typed),
qlog AS (SELECT id, replace(template, '{{body}}', inputs) AS full_query, label,
  CASE WHEN statement_type = 'admin' THEN '' WHEN id % 17 = 0 THEN NULL ELSE inputs END AS user_inputs,
  CASE WHEN label = 1 THEN CASE WHEN id % 7 < 3 THEN 'exploit' ELSE 'recon' END END AS attack_stage,
  CASE WHEN label = 1 THEN 't' || (id % 8) END AS tamper_method,
  CASE WHEN label = 1 THEN CASE WHEN id % 5 < 2 THEN 'success' ELSE 'failure' END END AS attack_status,
  statement_type, query_template_id,
  CASE WHEN label = 1 THEN {pick(fx.LOG_TECHNIQUES, 'id % 6')} || '-' || (id % 12) END AS attack_id,
  CASE WHEN label = 1 THEN {pick(fx.LOG_TECHNIQUES, 'id % 6')} END AS attack_technique,
  CASE WHEN label = 1 THEN 'test' WHEN id % 2 = 0 THEN 'train' WHEN id % 5 <> 0 THEN 'test' END AS split,
  template FROM tpl),
slog AS (SELECT * REPLACE (CASE WHEN label = 1 THEN 'test' ELSE coalesce(split, 'test') END AS split) FROM qlog)
"""

CATALOG = f"""
parts AS (SELECT *, {banded('p_partkey')} AS statement_type FROM part),
catalog AS (SELECT p_partkey AS tid,
  replace(replace(CASE WHEN statement_type = 'select' AND p_size = {fx.CONDITIONAL_SIZE} THEN {q(fx.CONDITIONAL_TEMPLATE)}
    ELSE {by_type('statement_type', {k: pick(v, f'p_partkey % {len(v)}') for k, v in fx.CATALOG_TEMPLATES.items()})} END,
    '<brand>', p_brand), '<name>', p_name) AS template,
  'shop-' || {by_type('statement_type', {k: q(v) for k, v in fx.LETTERS.items()})} || p_partkey AS ID,
  'Statement about ' || p_name AS description, 'string' AS payload_type,
  CAST({by_type('statement_type', {k: str(v) for k, v in STATEMENT_SHARES.items()})} AS DOUBLE) AS proportion,
  statement_type FROM parts)
"""

DICTS = "dicts AS (" + " UNION ALL ".join(
    f"SELECT 'shop' AS schema, {q(name)} AS dict_name, CAST(row_number() OVER (ORDER BY {key}) - 1 AS BIGINT) AS pos, {column} AS value "
    f"FROM {t} WHERE {column} IS NOT NULL"
    for name, (t, key, column) in fx.DICTIONARIES.items()
) + ")"

NAMES = "regexp_extract_all({t}, '\\{{([-a-zA-Z_]+)\\}}', 1)"
names_of = lambda t: "regexp_extract_all(" + t + ", '\\{([-a-zA-Z_]+)\\}', 1)"
parts_of = lambda t: "regexp_split_to_array(" + t + ", '\\{[-a-zA-Z_]+\\}')"
suffixed = lambda names: (
    f"list_transform({names}, lambda x, i: x || CASE WHEN len(list_filter({names}[1:i], lambda y: y = x)) > 1 "
    f"THEN CAST(len(list_filter({names}[1:i], lambda y: y = x)) AS VARCHAR) ELSE '' END)"
)

WEIGHTS = "weights AS (SELECT *, proportion / count(*) OVER (PARTITION BY statement_type) AS normalized_weight FROM catalog)"
SAMPLED = f"""
sized AS (SELECT *, CAST(round(normalized_weight * 1e9) AS BIGINT) AS w FROM weights),
spans AS (SELECT *, sum(w) OVER (ORDER BY ID) AS hi, sum(w) OVER () AS total FROM sized),
aimed AS (SELECT o_orderkey, CAST(floor(CAST({draw('o_orderkey', SLOT_TEMPLATE)} AS DOUBLE) / CAST(2147483647 AS DOUBLE)
  * (SELECT CAST(max(total) AS DOUBLE) FROM spans)) AS BIGINT) AS u FROM orders),
sampled AS (SELECT a.o_orderkey, s.* EXCLUDE (w, hi, total) FROM aimed a JOIN spans s ON a.u >= s.hi - s.w AND a.u < s.hi)
"""


def conditions(source: str) -> str:
    """Expand the conditional template of ``source`` (o_orderkey, template, ...)."""
    fields = ", ".join(
        f"{{'d': {draw('o_orderkey', SLOT_FIELDS + 1 + i)}, 'i': {i}, 'p': {lst(v)}[1 + {draw('o_orderkey', SLOT_VARIANT + i)} % {len(v)}]}}"
        for i, v in enumerate(fx.SEARCH_FIELDS.values())
    )
    k = f"(2 + {draw('o_orderkey', SLOT_FIELDS)} % {len(fx.SEARCH_FIELDS) - 1})"
    text = f"array_to_string(list_transform(list_sort([{fields}])[1:{k}], lambda c: c.p), ' AND ')"
    return f"expanded AS (SELECT * REPLACE (replace(template, '{{conditions}}', {text}) AS template) FROM {source})"


def filler(row: str, slot: str, name: str, value: str) -> str:
    number = {n: f"CAST({lo} + {draw(row, slot)} % {hi - lo + 1} AS VARCHAR)" for n, (lo, hi) in dr.NUMBER_RANGES.items()}
    letters = f"substr({q(dr.ALPHABET)}, CAST(1 + {draw(row, f'(({slot}) * {dr.STRING_LENGTH} + c)')} % {len(dr.ALPHABET)} AS INT), 1)"
    text = f"array_to_string(list_transform(range(1, {dr.STRING_LENGTH + 1}), lambda c: {letters}), '')"
    return f"CASE {name} WHEN 'rand_string' THEN {text} " + " ".join(f"WHEN {q(n)} THEN {v}" for n, v in number.items()) + f" ELSE {value} END"


FILLED = f"""
slots AS (SELECT o_orderkey, unnest({names_of('template')}) AS dict_name, generate_subscripts({names_of('template')}, 1) - 1 AS i FROM expanded),
sizes AS (SELECT dict_name, count(*) AS size FROM dicts GROUP BY 1),
valued AS (SELECT s.o_orderkey, s.i, replace({filler('s.o_orderkey', f'({SLOT_FILLER} + s.i)', 's.dict_name', 'd.value')}, '"', '""') AS f
  FROM slots s LEFT JOIN sizes z ON s.dict_name = z.dict_name
  LEFT JOIN dicts d ON d.dict_name = s.dict_name AND d.pos = {draw('s.o_orderkey', f'({SLOT_FILLER} + s.i)')} % z.size),
gathered AS (SELECT o_orderkey, list(f ORDER BY i) AS fs FROM valued GROUP BY 1),
filled AS (SELECT e.*, array_to_string(list_transform(list_zip({parts_of('template')}, list_append(coalesce(fs, []), '')),
  lambda z: z[1] || z[2]), '') AS full_query, array_to_string(coalesce(fs, []), ' ') AS user_inputs
  FROM expanded e LEFT JOIN gathered g ON e.o_orderkey = g.o_orderkey)
"""
GENERATED = ",".join([CATALOG, DICTS, WEIGHTS, SAMPLED, conditions("sampled"), FILLED])

# ---- lexical features --------------------------------------------------------------------

W = "\\p{L}\\p{N}_"
word = lambda w: f"regexp_matches(lq, '(^|[^{W}]){w}($|[^{W}])')"
has = lambda p, c="lq": f"contains({c}, {q(p)})"
occ = lambda p, c="t": f"((length({c}) - length(replace({c}, {q(p)}, ''))) // {len(p)})"
cls = lambda p: f"(length(t) - length(regexp_replace(t, '{p}', '', 'g')))"
SPACES = "\\s\\x0b\\x1c-\\x1f\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}"
ENCLOSED = "\\x{24B6}-\\x{24CF}\\x{1F130}-\\x{1F149}\\x{1F150}-\\x{1F169}\\x{1F170}-\\x{1F189}"
FEATURE_SQL = {"len_query": "length(t)"}
FEATURE_SQL |= {n: f"CAST({word(w)} AS INT)" for n, w in lx.WORD_FLAGS.items()}
FEATURE_SQL |= {n: f"CAST({' OR '.join(word(w) for w in ws)} AS INT)" for n, ws in lx.WORD_SETS.items()}
FEATURE_SQL |= {n: f"CAST({' OR '.join(has(p) for p in ps)} AS INT)" for n, ps in lx.SUBSTRING_SETS.items()}
FEATURE_SQL |= {
    "has_comment": f"CAST({has('--')} OR {has('#')} AS INT)",
    "c_comparison": " + ".join(occ(op, "lq") for op in lx.COMPARISONS),
    "has_tautology": (
        f"CASE WHEN len(list_filter(range(1, len(string_split(t, '='))), lambda i: "
        f"len(list_filter(range(1, 1 + least(length(regexp_extract(string_split(t, '=')[i], '[{W}]*$')), "
        f"length(regexp_extract(string_split(t, '=')[i + 1], '^[{W}]*')))), lambda k: "
        f"right(string_split(t, '=')[i], CAST(k AS INT)) = left(string_split(t, '=')[i + 1], CAST(k AS INT)))) > 0)) > 0 THEN 1 ELSE 0 END"
    ),
    "c_num": cls("[\\p{Nd}" + lx.OTHER_DIGITS + "]"),
    "c_upper": cls(f"[\\p{{Lu}}\\x{{2160}}-\\x{{216F}}{ENCLOSED}]"),
    "c_space": cls(f"[{SPACES}]"),
    "c_special": cls(f"[^\\p{{L}}\\p{{N}}{SPACES}/*+\\-\\[\\](){{}}{ENCLOSED}]"),
    "c_arith": f"{occ('/')} - {occ('/*')} + {occ('*')} - {occ('*/')} + {occ('+')} + {occ('-')}",
    "c_square_brackets": f"{occ('[')} + {occ(']')}",
    "c_round_brackets": f"{occ('(')} + {occ(')')}",
    "has_multiline_comment": f"CAST({has('/*', 't')} OR {has('*/', 't')} AS INT)",
    "c_curly_brackets": f"{occ('{')} + {occ('}')}",
}


def lexical(names, keep=("id",), source="slog") -> str:
    cols = ", ".join(f"CAST({FEATURE_SQL[n]} AS INT) AS {n}" for n in names)
    return f"SELECT {', '.join(keep)}, {cols} FROM (SELECT *, full_query AS t, lower(full_query) AS lq FROM {source})"


TOKENS = "regexp_extract_all(lower(full_query), '[\\p{L}\\p{N}_]{2,}')"
LEXICAL = "wide AS (" + lexical(lx.FEATURES, ("id", "label", "split", "attack_technique")) + ")"
VOCAB = f"""
terms AS (SELECT unnest({TOKENS}) AS term FROM slog WHERE split = 'train'),
totals AS (SELECT term, count(*) AS freq FROM terms GROUP BY 1),
vocab AS MATERIALIZED (SELECT term, freq, row_number() OVER (ORDER BY term) - 1 AS idx FROM totals)
"""
DOC_TERMS = f"""
doc_tokens AS (SELECT id, split, unnest({TOKENS}) AS term FROM slog),
doc_terms AS MATERIALIZED (SELECT id, split, term, count(*) AS n FROM doc_tokens GROUP BY ALL),
matrix AS MATERIALIZED (SELECT d.id, d.split, v.idx, d.n FROM doc_terms d JOIN vocab v ON d.term = v.term)
"""

# ---- scores ------------------------------------------------------------------------------

_density = f"(({FEATURE_SQL['c_special']}) + 10 * ({FEATURE_SQL['has_tautology']}) + ({FEATURE_SQL['c_comparison']})) / CAST(length(t) AS DOUBLE)"
_keywords = " + ".join(FEATURE_SQL[n] for n in ("has_comment", "has_union", "has_exist_keyword", "has_sleep", "has_tautology"))
SCORES = f"""
scored AS (SELECT id, label, attack_technique, split, {_density} AS density, CAST({_keywords} AS DOUBLE) AS keywords,
  CAST(length(t) AS DOUBLE) AS length FROM (SELECT *, full_query AS t, lower(full_query) AS lq FROM slog)),
scores AS (SELECT id, label, attack_technique, split, 'density' AS model, density AS score FROM scored
  UNION ALL SELECT id, label, attack_technique, split, 'keywords', keywords FROM scored
  UNION ALL SELECT id, label, attack_technique, split, 'length', length FROM scored),
val AS (SELECT * FROM scores WHERE split = 'train'),
test AS (SELECT * FROM scores WHERE split = 'test')
"""
RANKED = """
steps AS (SELECT model, score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM test GROUP BY 1, 2),
ranked AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY model) AS p,
  sum(neg) OVER (PARTITION BY model) AS n FROM steps WINDOW w AS (PARTITION BY model ORDER BY score DESC)),
pr AS (SELECT model, score AS threshold, tp / (tp + fp) AS precision, CASE WHEN p = 0 THEN 1 ELSE tp / p END AS recall FROM ranked
  UNION ALL SELECT DISTINCT model, CAST(NULL AS DOUBLE), CAST(1 AS DOUBLE), CAST(0 AS DOUBLE) FROM ranked),
roc AS (SELECT model, score AS threshold, fp / n AS fpr, tp / p AS tpr FROM ranked
  UNION ALL SELECT DISTINCT model, CAST(NULL AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE) FROM ranked),
pr_lag AS (SELECT *, lag(recall) OVER w AS r0, lag(precision) OVER w AS p0 FROM pr WINDOW w AS (PARTITION BY model ORDER BY threshold DESC NULLS FIRST)),
roc_lag AS (SELECT *, lag(fpr) OVER w AS f0, lag(tpr) OVER w AS t0 FROM roc WINDOW w AS (PARTITION BY model ORDER BY threshold DESC NULLS FIRST)),
prc AS (SELECT model, sum((recall - r0) * (precision + p0) / 2) AS auprc FROM pr_lag GROUP BY 1),
rocc AS (SELECT model, sum((fpr - f0) * (tpr + t0) / 2) AS auroc FROM roc_lag GROUP BY 1)
"""
thresholds = lambda rate: f"thr AS (SELECT model, quantile_cont(score, {1 - rate}) AS threshold FROM val GROUP BY 1)"
PREDS = thresholds(0.05) + ", preds AS (SELECT s.*, CAST(score >= threshold AS INT) AS pred FROM test s JOIN thr USING (model))"
CONF = """
conf AS (SELECT model, count(*) FILTER (label = 0 AND pred = 0) AS tn, count(*) FILTER (label = 0 AND pred = 1) AS fp,
  count(*) FILTER (label = 1 AND pred = 0) AS fn, count(*) FILTER (label = 1 AND pred = 1) AS tp FROM preds GROUP BY 1),
rates AS (SELECT *, (tp + tn) / (tp + tn + fp + fn) AS accuracy, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS fone,
  coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall,
  coalesce(fp / nullif(fp + tn, 0), 0) AS fpr FROM conf),
recalls AS (SELECT model, attack_technique, avg(pred) AS recall, count(*) AS n FROM preds WHERE label = 1 GROUP BY 1, 2)
"""
_recall_cols = lambda fmt: ", ".join(
    fmt.format(e=f"max(recall) FILTER (attack_technique = {q(t)})", n=f"recall{t}") for t in fx.LOG_TECHNIQUES
)

# ---- airport relations -------------------------------------------------------------------

AIRPORT = """
airport AS (SELECT c_custkey AS id, c_name AS ident, c_mktsegment AS type, 'Field ' || (c_custkey % 997) AS name,
  CAST(c_custkey * 37 % 161 - 80 AS DOUBLE) AS latitude_deg, CAST(c_custkey * 91 % 341 - 170 AS DOUBLE) AS longitude_deg,
  c_acctbal AS elevation_ft, CAST(c_nationkey % 5 AS VARCHAR) AS continent, CAST(c_nationkey % 5 AS VARCHAR) AS iso_country,
  CAST(c_nationkey AS VARCHAR) AS iso_region, 'Town ' || c_nationkey AS municipality,
  CASE WHEN c_custkey % 2 = 0 THEN 'yes' ELSE 'no' END AS scheduled_service,
  CASE WHEN c_custkey % 3 <> 0 THEN 'G' || (c_custkey % 50) END AS gps_code,
  CASE WHEN c_custkey % 7 <> 0 THEN 'I' || c_custkey END AS icao_code,
  CASE WHEN c_custkey % 4 <> 0 THEN 'A' || (c_custkey % 100) END AS iata_code,
  CASE WHEN c_custkey % 5 <> 0 THEN 'L' || (c_custkey % 60) END AS local_code,
  lower(c_mktsegment || ',k' || (c_custkey % 11)) AS keywords FROM customer),
runways AS (SELECT o_orderkey AS id, o_custkey AS airport_ref, 'Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS airport_ident,
  o_totalprice AS length_ft, o_orderstatus AS surface FROM orders),
airport_frequencies AS (SELECT o_orderkey AS id, o_custkey AS airport_ref, 'Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS airport_ident,
  o_orderpriority AS type, o_orderstatus AS description, o_totalprice / 1000 AS frequency_mhz FROM orders),
navaids AS (SELECT s_suppkey AS id, s_name AS ident, s_name AS name, ['VOR', 'NDB', 'DME'][CAST(s_suppkey % 3 AS INT) + 1] AS type,
  CASE WHEN s_suppkey % 6 <> 0 THEN s_acctbal END AS frequency_khz, CAST(s_nationkey % 5 AS VARCHAR) AS iso_country, 'BOTH' AS usageType FROM supplier),
countries AS (SELECT r_regionkey AS id, CAST(r_regionkey AS VARCHAR) AS code, r_name AS name, lower(r_name) AS keywords FROM region),
regions AS (SELECT n_nationkey AS id, CAST(n_nationkey AS VARCHAR) AS code, n_name AS name, CAST(n_regionkey AS VARCHAR) AS iso_country,
  lower(n_name) AS keywords FROM nation)
"""
KNOWN = 7
LOF = f"""
vecs AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[64]) AS v FROM embeddings),
fit AS (SELECT * FROM vecs WHERE label < {KNOWN}),
pairs AS (SELECT a.id, a.label < {KNOWN} AS fitted, b.id AS nid, array_distance(a.v, b.v) AS dist FROM vecs a JOIN fit b ON true),
near AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, nid) AS r FROM pairs WHERE id <> nid),
fit_near AS (SELECT * FROM near WHERE fitted AND r <= 20),
kd AS (SELECT id, max(dist) AS k_dist FROM fit_near GROUP BY 1),
dens AS (SELECT n.id, 1 / (avg(greatest(n.dist, kd.k_dist)) + 1e-10) AS lrd FROM fit_near n JOIN kd ON n.nid = kd.id GROUP BY 1),
qnear AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, nid) AS r FROM pairs),
lofs AS (SELECT n.id, avg(dens.lrd) * (avg(greatest(n.dist, kd.k_dist)) + 1e-10) AS lof
  FROM qnear n JOIN kd ON n.nid = kd.id JOIN dens ON n.nid = dens.id WHERE n.r <= 20 GROUP BY 1)
"""


def w(*views: str) -> str:
    return "WITH " + ",".join(v.strip() for v in views) + "\n"


r6 = lambda expr, name: f"round({expr}, 6) AS {name}"
ORACLE: dict[str, str] = {}
O = ORACLE

# sources
O["scan_templates"] = w(CATALOG) + f"SELECT template, ID, description, payload_type, proportion, statement_type, array_to_string({suffixed(names_of('template'))}, ' ') AS placeholders FROM catalog"
O["scan_dictionaries"] = O["build_dictionaries"] = w(DICTS) + "SELECT * FROM dicts"
O["check_proportions"] = """SELECT o_orderstatus, round(1 - lost / n, 6) AS total, lost = 0 AS ok
FROM (SELECT o_orderstatus, count(*) AS n, count(*) FILTER (o_orderstatus = 'P' AND o_orderpriority = '1-URGENT') AS lost FROM orders GROUP BY 1)"""
LOG_COLUMNS = "full_query, label, nullif(user_inputs, '') AS user_inputs, attack_stage, tamper_method, attack_status, statement_type, query_template_id, attack_id, attack_technique, split"
O["scan_log"] = w(QLOG) + f"SELECT {LOG_COLUMNS} FROM qlog"
O["null_tokens"] = f"""WITH t AS (SELECT {lst([*tx.NULL_TOKENS, 'nah', 'Null '])}[1 + CAST(o_orderkey % 21 AS INT)] || CASE WHEN o_orderstatus = 'P' THEN 'x' ELSE '' END AS v FROM orders)
SELECT CASE WHEN v IN ({', '.join(q(t) for t in tx.NULL_TOKENS)}) THEN NULL ELSE v END AS value, count(*) AS n FROM t GROUP BY 1"""
O["sink_log"] = w(QLOG) + "SELECT id, full_query, label, statement_type, split FROM slog"
O["campaign_rerun"] = w(QLOG) + "SELECT query_template_id, attack_technique, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM qlog WHERE label = 1 GROUP BY 1, 2"
O["resume_anti"] = w(QLOG) + """, done AS (SELECT DISTINCT query_template_id, attack_technique FROM qlog WHERE attack_stage = 'exploit'),
todo AS (SELECT DISTINCT query_template_id, attack_technique FROM qlog WHERE label = 1 EXCEPT SELECT * FROM done)
SELECT query_template_id, attack_technique, CAST((SELECT count(*) FROM done) + row_number() OVER (ORDER BY query_template_id, attack_technique) - 1 AS BIGINT) AS campaign_no FROM todo"""
O["scan_curves"] = w(QLOG, SCORES, RANKED) + f"SELECT CASE WHEN model = 'length' THEN 'length_chall' ELSE model END AS model, model = 'length' AS challenging, {r6('precision', 'precision')}, {r6('recall', 'recall')} FROM pr"

# synthesis
O["placeholders"] = w(CATALOG) + f"SELECT ID, array_to_string({suffixed(names_of('template'))}, ' ') AS placeholders FROM catalog"
O["template_roles"] = w(CATALOG) + f""", o AS (SELECT *, row_number() OVER (ORDER BY {draw('tid', SLOT_ROLE)}, tid) AS r FROM catalog WHERE NOT contains(ID, 'admin'))
SELECT ID, CASE WHEN r <= (SELECT CAST(round_even(count(*) * 0.1, 0) AS BIGINT) FROM o) OR list_contains({names_of('template')}, 'conditions') THEN 'normal_only' ELSE 'attackable' END AS role FROM o
UNION ALL SELECT ID, 'admin' FROM catalog WHERE contains(ID, 'admin')"""
O["sample_fixed_n"] = w(CATALOG) + f"SELECT ID, template FROM catalog WHERE NOT contains(ID, 'admin') ORDER BY {draw('tid', SLOT_ROLE)}, tid LIMIT 10"
O["template_weights"] = w(CATALOG, WEIGHTS) + "SELECT ID, round(normalized_weight, 12) AS normalized_weight FROM weights"
O["weighted_sample"] = w(CATALOG, WEIGHTS, SAMPLED) + "SELECT o_orderkey, ID FROM sampled"
O["fill_templates"] = w(GENERATED) + "SELECT o_orderkey, ID, full_query, user_inputs FROM filled"
O["random_fillers"] = "SELECT o_orderkey, " + ", ".join(
    f"CAST({lo} + {draw('o_orderkey', i)} % {hi - lo + 1} AS BIGINT) AS {n}" for i, (n, (lo, hi)) in enumerate(dr.NUMBER_RANGES.items())
) + f", {filler('o_orderkey', '9', q('rand_string'), 'NULL')} AS rand_string FROM orders"
O["fill_conditions"] = w(DICTS, f"rows_ AS (SELECT o_orderkey, {q(fx.CONDITIONAL_TEMPLATE)} AS template FROM orders)", conditions("rows_"), FILLED) + "SELECT o_orderkey, full_query, user_inputs FROM filled"
O["assemble_normal"] = w(GENERATED) + "SELECT full_query, 0 AS label, user_inputs, CAST(NULL AS VARCHAR) AS attack_stage, CAST(NULL AS VARCHAR) AS tamper_method, CAST(NULL AS VARCHAR) AS attack_status, statement_type, ID AS query_template_id, CAST(NULL AS VARCHAR) AS attack_id, CAST(NULL AS VARCHAR) AS attack_technique, CAST(NULL AS VARCHAR) AS split FROM filled"
O["augment_count"] = w(QLOG) + "SELECT count(*) AS n_attack, CAST(floor(count(*) / CAST(0.1 AS DOUBLE)) AS BIGINT) - count(*) AS n_normal FROM slog WHERE split = 'test' AND label = 1"
O["augment_test_split"] = w(QLOG) + """, a AS (SELECT count(*) AS n FROM slog WHERE label = 1)
SELECT split, count(*) FILTER (label = 1) AS attacks, CAST(count(*) FILTER (label = 0) + CASE WHEN split = 'test' THEN (SELECT floor(n / CAST(0.1 AS DOUBLE)) - n FROM a) ELSE 0 END AS BIGINT) AS normals FROM slog GROUP BY split"""
# The second batch of statements: the same views under other names, over the rows that the test split lacks.
_AGAIN = re.sub(r"\b(aimed|sampled|expanded|slots|sizes|valued|gathered|filled)\b", r"\1_2", ",".join([SAMPLED[SAMPLED.index("aimed AS"):], conditions("sampled"), FILLED]))
_AGAIN = _AGAIN.replace("FROM orders)", f"FROM (SELECT unnest(range((SELECT CAST(floor(count(*) / CAST(0.1 AS DOUBLE)) AS BIGINT) - count(*) FROM qlog WHERE label = 1))) + {bu.SECOND_BATCH} AS o_orderkey))")
_RECORD = "CAST(NULL AS VARCHAR) AS attack_stage, CAST(NULL AS VARCHAR) AS tamper_method, CAST(NULL AS VARCHAR) AS attack_status, statement_type, ID AS query_template_id, CAST(NULL AS VARCHAR) AS attack_id, CAST(NULL AS VARCHAR) AS attack_technique"
O["build_log"] = w(QLOG, GENERATED, _AGAIN) + f""", every AS (
  SELECT full_query, label, user_inputs, attack_stage, tamper_method, attack_status, statement_type, query_template_id, attack_id, attack_technique, split FROM slog WHERE label = 1
  UNION ALL SELECT full_query, 0, user_inputs, {_RECORD}, 'train' FROM filled UNION ALL SELECT full_query, 0, user_inputs, {_RECORD}, 'test' FROM filled_2)
SELECT * REPLACE (CASE WHEN query_template_id IN (SELECT ID FROM catalog WHERE statement_type = 'admin') THEN '' ELSE user_inputs END AS user_inputs)
FROM every WHERE full_query NOT IN (SELECT full_query FROM every GROUP BY 1 HAVING min(label) <> max(label))"""
O["param_pool"] = w(CATALOG, DICTS) + f""", params AS (SELECT tid, unnest({suffixed(names_of('template'))}) AS param, generate_subscripts({names_of('template')}, 1) - 1 AS i FROM catalog WHERE template <> {q(fx.CONDITIONAL_TEMPLATE)}),
picks AS (SELECT tid, param, i, c, regexp_replace(param, '[0-9]+$', '') AS dict_name, {SLOT_FILLER} + i * 10 + c AS slot FROM params, range(10) t(c)),
sizes AS (SELECT dict_name, count(*) AS size FROM dicts GROUP BY 1),
vals AS (SELECT p.tid, p.param, p.c AS k, {filler('p.tid', 'p.slot', 'p.dict_name', 'd.value')} AS v FROM picks p LEFT JOIN sizes z ON p.dict_name = z.dict_name
  LEFT JOIN dicts d ON d.dict_name = p.dict_name AND d.pos = {draw('p.tid', 'p.slot')} % z.size)
SELECT tid, param, array_to_string(list(v ORDER BY k), '|') AS candidates FROM vals GROUP BY 1, 2"""

# cleaning
O["assign_split"] = w(QLOG) + "SELECT id, split FROM slog"
O["drop_contradictions"] = w(QLOG) + "SELECT id, full_query, label FROM qlog WHERE full_query NOT IN (SELECT full_query FROM qlog GROUP BY 1 HAVING min(label) <> max(label))"
O["blank_admin_inputs"] = w(QLOG) + "SELECT id, CASE WHEN contains(query_template_id, 'admin') THEN '' ELSE full_query END AS user_inputs FROM qlog"
_HELD = "query_template_id IN (SELECT query_template_id FROM qlog WHERE statement_type = 'insert')"
O["template_split"] = w(QLOG) + f"SELECT id, CASE WHEN {_HELD} THEN 'challenging' ELSE 'original' END AS template_split FROM qlog"
O["extract_payload"] = w(QLOG) + f"SELECT id, list_reduce(list_prepend(full_query, list_filter({parts_of('template')}, lambda p: p <> '')), lambda a, p: replace(a, p, ' ')) AS payload FROM qlog"
O["drop_default_queries"] = w(QLOG) + """, d AS (SELECT query_template_id, arg_min(full_query, id) AS dq FROM qlog GROUP BY 1)
SELECT id, query_template_id, full_query FROM qlog JOIN d USING (query_template_id) WHERE full_query <> dq"""
O["campaign_status"] = w(QLOG) + """, a AS (SELECT *, coalesce(max(CAST(attack_stage = 'recon' AND attack_status = 'success' AS INT)) OVER (PARTITION BY attack_id), 0) AS rs,
  first_value(CASE WHEN attack_stage = 'exploit' THEN attack_status END IGNORE NULLS) OVER (PARTITION BY attack_id ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS es
  FROM qlog WHERE label = 1)
SELECT id, attack_id, CASE WHEN rs = 0 THEN 'failure' ELSE coalesce(es, attack_status) END AS attack_status FROM a"""
O["campaign_ids"] = w(QLOG) + f""", a AS (SELECT id, attack_technique, CAST(dense_rank() OVER (ORDER BY query_template_id, list_position({lst(TECHNIQUES)}, attack_technique)) - 1 AS BIGINT) AS campaign_no FROM qlog WHERE label = 1)
SELECT id, campaign_no, attack_technique || '-' || campaign_no AS attack_id FROM a"""
O["user_input_mode"] = w(QLOG) + "SELECT id, user_inputs AS full_query FROM qlog WHERE user_inputs IS NOT NULL"
O["train_val_split"] = w(QLOG) + f"SELECT id, CASE WHEN split = 'train' AND CAST({draw('id', 7)} AS DOUBLE) / CAST(2147483647 AS DOUBLE) < 0.1 THEN 'val' ELSE split END AS part FROM slog"
O["train_val_split_exact"] = w(QLOG) + f""", t AS (SELECT id, row_number() OVER (ORDER BY {draw('id', 7)}, id) AS r, count(*) OVER () AS n FROM slog WHERE split = 'train')
SELECT s.id, CASE WHEN t.r <= ceil(t.n * CAST(0.1 AS DOUBLE)) THEN 'val' ELSE s.split END AS part FROM slog s LEFT JOIN t ON s.id = t.id"""

# features
for _key, _names in {
    "li_length": ["len_query"], "li_word_flags": list(lx.WORD_FLAGS), "li_word_sets": list(lx.WORD_SETS),
    "li_substring_sets": list(lx.SUBSTRING_SETS), "li_comment": ["has_comment"], "li_comparison": ["c_comparison"],
    "li_tautology": ["has_tautology"],
    "li_char_kinds": ["c_num", "c_upper", "c_space", "c_special", "c_arith", "c_square_brackets", "c_round_brackets", "has_multiline_comment", "c_curly_brackets"],
    "li_features": lx.FEATURES, "stream_features": lx.FEATURES,
}.items():
    O[_key] = w(QLOG) + lexical(_names)
O["li_escapes"] = """WITH e AS (SELECT page_id, replace(replace(html, '<', '\\x3c'), '&', '\\u0026') AS t FROM pages)
SELECT page_id, CAST(len(regexp_extract_all(t, '\\\\x[0-9a-fA-F]{2}')) AS INT) AS c_hex, CAST(len(regexp_extract_all(t, '\\\\u[0-9a-fA-F]{4}')) AS INT) AS c_unicode FROM e"""
O["tokens"] = w(QLOG) + f"SELECT id, CAST(len({TOKENS}) AS INT) AS n, array_to_string({TOKENS}, ' ') AS tokens FROM qlog"
O["vocabulary_topk"] = w(QLOG, VOCAB) + ", top AS (SELECT term, freq FROM totals ORDER BY freq DESC, term LIMIT 20000) SELECT term, freq, CAST(row_number() OVER (ORDER BY term) - 1 AS BIGINT) AS idx FROM top"
O["count_matrix"] = w(QLOG, VOCAB, DOC_TERMS) + "SELECT id, CAST(idx AS BIGINT) AS idx, n FROM matrix"
_std = lambda c: r6(f"({c} - (SELECT avg({c}) FROM fit)) / (SELECT CASE WHEN stddev_pop({c}) > 0 THEN stddev_pop({c}) ELSE 1 END FROM fit)", c)
_mab = lambda c: r6(f"greatest(0, least(1, {c} / (SELECT CAST(CASE WHEN max(abs({c})) > 0 THEN max(abs({c})) ELSE 1 END AS DOUBLE) FROM fit)))", c)
FIT = "fit AS (SELECT * FROM wide WHERE split = 'train')"
O["scale_standard"] = w(QLOG, LEXICAL, FIT) + f"SELECT id, {', '.join(_std(c) for c in lx.FEATURES)} FROM wide"
O["scale_maxabs"] = w(QLOG, LEXICAL, FIT) + f"SELECT id, {', '.join(_mab(c) for c in lx.FEATURES)} FROM wide"
_low = lambda e: f"(({e}) & 4294967295)"
_turned = lambda e, bits: _low(f"(({e}) << {bits}) | (({e}) >> {32 - bits})")
_number = lambda e: "CAST('0x' || " + " || ".join(f"substr({e}, {at}, 2)" for at in (7, 5, 3, 1)) + " AS UBIGINT)"
_mixed = lambda e: _low(_turned(_low(f"({e}) * 3432918353"), 15) + " * 461845907")
_folded = lambda e, bits: f"xor({e}, ({e}) >> {bits})"
# The 32-bit hash of a term's UTF-8 bytes, by blocks of four bytes; seed 42.
TERM_HASH = f"""
hex_terms AS MATERIALIZED (SELECT term, hex(encode(term)) AS h, CAST(octet_length(encode(term)) AS UBIGINT) AS len FROM (SELECT DISTINCT term FROM said)),
numbers AS (SELECT term, h, len, list_transform(range(CAST(len // 4 AS BIGINT)), lambda i: {_number("substr(h, 8 * i + 1, 8)")}) AS blocks,
  CASE WHEN len % 4 > 0 THEN {_number("rpad(substr(h, CAST(8 * (len // 4) AS BIGINT) + 1), 8, '0')")} ELSE CAST(0 AS UBIGINT) END AS rest FROM hex_terms),
mixed AS MATERIALIZED (SELECT term, len, [CAST(42 AS UBIGINT)] || list_transform(blocks, lambda k: {_mixed("k")}) AS ks, {_mixed("rest")} AS rest FROM numbers),
body AS MATERIALIZED (SELECT term, xor(xor(list_reduce(ks, lambda a, k: {_low(_turned("xor(a, k)", 13) + " * 5 + 3864292196")}), rest), len) AS a FROM mixed),
first_fold AS MATERIALIZED (SELECT term, {_low(_folded("a", 16) + " * 2246822507")} AS a FROM body),
second_fold AS MATERIALIZED (SELECT term, {_low(_folded("a", 13) + " * 3266489909")} AS a FROM first_fold),
buckets AS MATERIALIZED (SELECT term, CAST({_folded("a", 16)} % 128 AS BIGINT) AS bucket FROM second_fold)
"""
O["embed_hash"] = w(QLOG, f"said AS MATERIALIZED (SELECT id, unnest({TOKENS}) AS term FROM qlog)", TERM_HASH) + """,
cells AS (SELECT id, bucket % 64 AS place, sum(CASE WHEN bucket < 64 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) AS v FROM said JOIN buckets USING (term) GROUP BY 1, 2),
norms AS (SELECT id, sqrt(sum(v * v)) AS norm FROM cells GROUP BY 1)
SELECT q.id, p.place, round(CASE WHEN c.v IS NULL OR n.norm = 0 THEN 0 ELSE c.v / n.norm END, 6) AS value
FROM qlog q CROSS JOIN (SELECT unnest(range(64)) AS place) p LEFT JOIN cells c ON c.id = q.id AND c.place = p.place LEFT JOIN norms n ON n.id = q.id"""
O["scale_counts"] = w(QLOG, VOCAB, DOC_TERMS) + """, summed AS (SELECT id, idx, n, (SELECT count(*) FROM slog WHERE split = 'train') AS d,
  coalesce(sum(n) FILTER (split = 'train') OVER term, 0) AS s, coalesce(sum(n * n) FILTER (split = 'train') OVER term, 0) AS q FROM matrix WINDOW term AS (PARTITION BY idx)),
dev AS (SELECT id, idx, n, sqrt(greatest(q / d - (s / d) * (s / d), 0)) AS s FROM summed)
SELECT id, CAST(idx AS BIGINT) AS idx, round(n / CASE WHEN s > 0 THEN s ELSE 1 END, 6) AS scaled FROM dev"""
O["feature_min_check"] = w(QLOG, LEXICAL) + " UNION ALL ".join(
    f"SELECT {q(c)} AS feature, CAST(min({c}) AS DOUBLE) AS minimum, min({c}) >= 0 AS ok FROM wide" for c in lx.FEATURES
)
O["embed_precomputed"] = "SELECT vec_id, label, CAST(len(embedding) AS INT) AS dim, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)), 6) AS squared_norm FROM embeddings"

# detectors
O["lof_knn"] = w(LOF) + "SELECT id, nid, round(dist, 6) AS dist, CAST(1 AS BIGINT) AS w FROM qnear WHERE r <= 20"
O["lof_density"] = w(LOF) + "SELECT id, round(k_dist, 6) AS k_dist, round(lrd, 6) AS lrd FROM kd JOIN dens USING (id)"
O["lof_score"] = w(LOF) + "SELECT id, label, round(lof - 1.5, 6) AS score FROM lofs JOIN vecs USING (id)"
O["lof_lsh"] = w(LOF) + """SELECT label, count(DISTINCT id) AS n, count(nid) AS neighbours, count(nid) AS found, true AS recall_95
FROM vecs JOIN qnear USING (id) WHERE r <= 20 GROUP BY label"""
_FLAGS = " || ".join(f"CAST({c} AS VARCHAR)" for c in lx.FEATURES if c.startswith("has_"))
O["lof_copies"] = w(QLOG, LEXICAL) + f"SELECT {_FLAGS} AS flags, count(*) AS n, CAST(1 AS BIGINT) AS scores FROM wide GROUP BY 1"
O["ocsvm_gamma"] = "WITH c AS (SELECT CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) SELECT round(1 / (64 * var_pop(x)), 6) AS gamma FROM c"
O["reconstruction_mse"] = """WITH c AS (SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
m AS (SELECT label, i, avg(x) AS m FROM c GROUP BY 1, 2)
SELECT vec_id, round(avg((x - m) * (x - m)), 6) AS score FROM c JOIN m USING (label, i) GROUP BY 1"""

# metrics
O["fpr_threshold_sketch"] = w(QLOG, SCORES, thresholds(0.05)) + "SELECT model, count(*) AS n, true AS within_error FROM val GROUP BY 1"
O["fpr_threshold"] = w(QLOG, SCORES, thresholds(0.001)) + "SELECT model, round(threshold, 6) AS threshold FROM thr"
O["threshold_share"] = w(QLOG, SCORES, thresholds(0.05)) + "SELECT model, count(*) FILTER (score > threshold) AS n_above, round(count(*) FILTER (score > threshold) / count(*), 6) AS share_above FROM val JOIN thr USING (model) GROUP BY 1"
O["confusion"] = w(QLOG, SCORES, PREDS, CONF) + "SELECT model, tn, fp, fn, tp, " + ", ".join(r6(c, c) for c in ("accuracy", "fone", "precision", "recall", "fpr")) + " FROM rates"
_pct = lambda e, n, d=2: f"printf('%.{d}f%%', {e} * 100) AS {n}"
REPORT = (
    ", per AS (SELECT model, " + _recall_cols("{e} AS {n}") + " FROM recalls GROUP BY 1) SELECT model, "
    + ", ".join(_pct(c, c) for c in ("fone", "accuracy", "precision", "recall")) + ", " + _pct("fpr", "fpr", 5)
    + ", printf('%.4f', auprc) AS auprc, printf('%.4f', auroc) AS rocauc, "
    + ", ".join(f"coalesce(printf('%.2f%%', recall{t} * 100), '') AS recall{t}" for t in fx.LOG_TECHNIQUES)
    + " FROM rates JOIN prc USING (model) JOIN rocc USING (model) LEFT JOIN per USING (model)"
)
O["metrics_report"] = w(QLOG, SCORES, RANKED, PREDS, CONF) + REPORT
INPUT_SCORES = SCORES.replace("FROM slog", "FROM (SELECT * REPLACE (user_inputs AS full_query) FROM slog WHERE user_inputs <> '')")
O["evaluation_report"] = " UNION ALL ".join(
    f"SELECT {mode} AS on_user_inputs, * FROM ({w(QLOG, scores, RANKED, PREDS, CONF) + REPORT})"
    for mode, scores in (("false", SCORES), ("true", INPUT_SCORES))
)
O["pr_curve"] = w(QLOG, SCORES, RANKED) + f"SELECT model, {r6('threshold', 'threshold')}, {r6('precision', 'precision')}, {r6('recall', 'recall')} FROM pr"
O["auprc"] = w(QLOG, SCORES, RANKED) + "SELECT model, round(auprc, 6) AS auprc FROM prc"
O["auc_from_points"] = w(QLOG, SCORES, RANKED) + "SELECT model, round(auprc, 6) AS area FROM prc"
O["roc_curve"] = w(QLOG, SCORES, RANKED) + f"SELECT model, {r6('threshold', 'threshold')}, {r6('fpr', 'fpr')}, {r6('tpr', 'tpr')} FROM roc"
O["auroc"] = w(QLOG, SCORES, RANKED) + "SELECT model, round(auroc, 6) AS auroc FROM rocc"
O["recall_by_technique"] = w(QLOG, SCORES, PREDS, CONF) + "SELECT model, attack_technique, round(recall, 6) AS recall, n FROM recalls"
O["recall_columns"] = w(QLOG, SCORES, PREDS, CONF) + "SELECT model, " + _recall_cols("round({e}, 6) AS {n}") + " FROM recalls GROUP BY 1"
O["prevalence"] = w(QLOG, SCORES) + "SELECT model, round(avg(label), 6) AS prevalence FROM test GROUP BY 1"
O["label_consistency"] = w(QLOG) + """, u AS (SELECT id, label FROM slog UNION ALL SELECT doc_id, CAST(quality AS INT) FROM labels)
SELECT id, min(label) AS lowest, max(label) AS highest FROM u GROUP BY 1 HAVING min(label) <> max(label)"""

# statistics
O["stage_pivot"] = w(QLOG) + """SELECT attack_id, count(*) FILTER (s = 'cleanup') AS cleanup, count(*) FILTER (s = 'exploit') AS exploit, count(*) FILTER (s = 'recon') AS recon
FROM (SELECT attack_id, CASE WHEN label = 1 AND id % 11 = 0 THEN 'cleanup' ELSE attack_stage END AS s FROM qlog) WHERE attack_id IS NOT NULL GROUP BY 1"""
O["success_rate"] = w(QLOG) + """, f AS (SELECT attack_id, arg_min(attack_technique, id) AS attack_technique, arg_min(attack_status, id) AS s FROM qlog WHERE label = 1 GROUP BY 1),
c AS (SELECT attack_technique, count(*) FILTER (s = 'success') AS successful, count(*) AS n FROM f GROUP BY 1),
t AS (SELECT attack_technique, count(*) AS total_queries FROM qlog WHERE label = 1 GROUP BY 1)
SELECT attack_technique, successful, round_even(successful / n, 4) AS success_rate, total_queries FROM c JOIN t USING (attack_technique)"""
O["split_label_counts"] = w(QLOG) + "SELECT split, count(*) FILTER (label = 1) AS attacks, count(*) FILTER (label = 0) AS normals FROM slog GROUP BY 1"
_TL = "tl AS (SELECT * REPLACE (query_template_id || '-' || length(full_query) AS query_template_id) FROM slog)"
O["templates_test_only"] = w(QLOG, _TL) + "SELECT query_template_id FROM tl WHERE split = 'test' EXCEPT SELECT query_template_id FROM tl WHERE split = 'train'"
O["templates_no_attack"] = w(QLOG, _TL) + "SELECT query_template_id FROM tl WHERE label = 0 EXCEPT SELECT query_template_id FROM tl WHERE label = 1"
O["template_overlap"] = w(QLOG, _TL) + """, a AS (SELECT DISTINCT query_template_id AS k FROM tl WHERE split = 'test'), b AS (SELECT DISTINCT query_template_id AS k FROM tl WHERE split = 'train')
SELECT count(*) FILTER (b.k IS NULL) AS test_only, count(*) FILTER (a.k IS NULL) AS train_only, count(*) FILTER (a.k IS NOT NULL AND b.k IS NOT NULL) AS both FROM a FULL JOIN b ON a.k = b.k"""
O["stmt_proportions"] = w(QLOG) + """, s AS (SELECT CASE label WHEN 0 THEN 'normal' ELSE 'attack' END AS subset, statement_type FROM slog UNION ALL SELECT split, statement_type FROM slog)
SELECT subset, statement_type, round(count(*) / sum(count(*)) OVER (PARTITION BY subset), 6) AS proportion FROM s GROUP BY 1, 2"""
O["template_split_stats"] = w(QLOG) + f"""SELECT CASE WHEN {_HELD} THEN 'challenging' ELSE 'original' END AS template_split, count(*) AS queries,
count(DISTINCT query_template_id) AS templates, count(*) FILTER (label = 1) AS attacks, count(*) FILTER (label = 0) AS normals FROM qlog GROUP BY 1"""

# workload
_A = "id, ident, name, type, iso_country, gps_code, local_code"
_WL = {
    "wl_s01": f"SELECT {_A} FROM airport WHERE icao_code = 'I64'",
    "wl_s02": "SELECT id, name, icao_code FROM airport WHERE elevation_ft BETWEEN 1000 AND 5000",
    "wl_s03": "SELECT icao_code, iata_code, local_code FROM airport WHERE name LIKE 'Field 1%'",
    "wl_s04": f"SELECT {_A} FROM airport WHERE gps_code = 'G7' OR local_code = 'L9'",
    "wl_s05": "SELECT r.name AS region_name, count(a.id) AS airport_count FROM airport a JOIN regions r ON a.iso_region = r.code WHERE a.iso_country = '2' GROUP BY r.name",
    "wl_s06": "SELECT id, ident, name FROM airport WHERE iso_country = '3'",
    "wl_s07": "SELECT type, description, frequency_mhz FROM airport_frequencies WHERE airport_ident = 'Customer#000000010'",
    "wl_s08": f"SELECT {_A} FROM airport WHERE continent = '1' AND iso_region LIKE '1%'",
    "wl_s09": "SELECT name, municipality, iso_country FROM airport WHERE type IN ('BUILDING', 'MACHINERY') AND iso_country = '4'",
    "wl_s10": "SELECT id, name, municipality, iso_country FROM airport WHERE id IN (SELECT id FROM airport WHERE keywords LIKE 'building%') OR name LIKE 'Field 2%'",
    "wl_s11": "SELECT id, name, type, iso_country, municipality FROM airport WHERE elevation_ft > (SELECT avg(elevation_ft) FROM airport WHERE iso_country = '2') OR elevation_ft > 9000",
    "wl_s12": "SELECT id, length_ft, surface FROM runways WHERE airport_ref = (SELECT id FROM airport WHERE ident = 'Customer#000000010')",
    "wl_s13": """SELECT 'Airport Frequency' AS source_type, af.airport_ident AS code, a.name AS location_name, af.type AS frequency_type, round(af.frequency_mhz, 6) AS frequency,
      af.description, a.municipality, a.iso_country FROM airport_frequencies af JOIN airport a ON af.airport_ident = a.ident WHERE af.frequency_mhz BETWEEN 100 AND 150
      UNION ALL SELECT 'Navaid Frequency', n.ident, n.name, n.type, round(n.frequency_khz / 1000, 6), n.usageType, 'N/A', n.iso_country FROM navaids n
      WHERE n.frequency_khz IS NOT NULL AND n.frequency_khz / 1000 BETWEEN 1 AND 5""",
    "wl_s14": """SELECT id, ident, name, latitude_deg, longitude_deg, round(d, 6) AS distance FROM (SELECT a.*, 6371 * acos(greatest(-1, least(1,
      cos(radians(a.latitude_deg)) * cos(radians(b.latitude_deg)) * cos(radians(b.longitude_deg) - radians(a.longitude_deg))
      + sin(radians(a.latitude_deg)) * sin(radians(b.latitude_deg))))) AS d FROM airport a JOIN airport b ON b.name = 'Field 7' WHERE a.id <> b.id) ORDER BY d, id LIMIT 50""",
    "wl_s15": "SELECT a.ident, a.name, r.name AS region_name FROM airport a JOIN regions r ON a.iso_region = r.code WHERE r.name = 'NATION_3'",
    "wl_s16": "SELECT r.name AS region_name, count(a.id) AS airport_count FROM airport a JOIN regions r ON a.iso_region = r.code WHERE a.iso_country = '4' GROUP BY r.name",
    "wl_s17": "SELECT name, 'airport' AS entity_type FROM airport WHERE keywords LIKE '%a%' UNION SELECT name, 'region' FROM regions WHERE keywords LIKE '%a%' UNION SELECT name, 'country' FROM countries WHERE keywords LIKE '%a%'",
    "wl_s18": "SELECT name, 'airport' AS entity_type FROM airport WHERE keywords LIKE '%g,k_%' UNION SELECT name, 'region' FROM regions WHERE keywords LIKE '%nation_1%' UNION SELECT name, 'country' FROM countries WHERE keywords LIKE '%asia%'",
    "wl_s19": "SELECT a.name AS airport_name, a.ident AS airport_code, a.municipality, count(r.id) AS runway_count FROM airport a JOIN runways r ON a.id = r.airport_ref WHERE a.iso_country = '1' GROUP BY a.id, a.name, a.ident, a.municipality HAVING count(r.id) > 10",
    "wl_s20": "SELECT n.type, c.name AS country_name, count(n.id) AS navaid_count FROM navaids n JOIN countries c ON n.iso_country = c.code WHERE c.code = '1' OR c.name LIKE '%AS%' GROUP BY n.type, c.name HAVING count(n.id) > 2",
    "wl_s21": "SELECT name, coalesce(iata_code, 'NO_IATA') AS iata_display, coalesce(icao_code, 'NO_ICAO') AS icao_display, substr(name, 1, 5) AS short_name, municipality FROM airport WHERE municipality LIKE 'Town 1%'",
    "wl_s22": "SELECT a.name AS airport_name, a.municipality, count(r.id) AS runway_count, CAST(round(avg(r.length_ft)) AS BIGINT) AS avg_runway_length FROM airport a JOIN runways r ON a.id = r.airport_ref WHERE r.length_ft >= 3000 AND a.iso_country = '2' GROUP BY a.id, a.name, a.municipality",
    "wl_s23": """SELECT id FROM airport WHERE type IN ('BUILDING', 'MACHINERY', 'FURNITURE') AND (name LIKE '%1%' OR name LIKE '%2%') AND latitude_deg >= -50 AND longitude_deg BETWEEN -100 AND 120
      AND elevation_ft <= 8000 AND scheduled_service = 'yes' AND list_has_any(string_split(keywords, ','), ['k1', 'k2', 'k4'])""",
    "wl_update": """SELECT 'airport' AS relation, CAST(id AS BIGINT) AS id, CASE WHEN ident = 'Customer#000000005' THEN 'Renamed' ELSE name END || '|' || CASE WHEN iso_country = '1' THEN 'Capital' ELSE municipality END
        || '|' || CASE WHEN ident <> 'Customer#000000005' AND name = 'Field 9' THEN 'linked' ELSE keywords END AS state, CAST(NULL AS DOUBLE) AS number FROM airport
      UNION ALL SELECT 'frequency', CAST(id AS BIGINT), CASE WHEN airport_ident = 'Customer#000000010' THEN 'changed' ELSE description END, round(CASE WHEN type = '2-HIGH' THEN CAST(118.5 AS DOUBLE) ELSE frequency_mhz END, 6) FROM airport_frequencies
      UNION ALL SELECT 'navaid', CAST(id AS BIGINT), CASE WHEN ident = 'Supplier#000000003' THEN 'Beacon' ELSE name END, NULL FROM navaids
      UNION ALL SELECT 'country', CAST(id AS BIGINT), CASE WHEN code = '2' THEN 'new' ELSE keywords END, NULL FROM countries
      UNION ALL SELECT 'region', CAST(id AS BIGINT), CASE WHEN iso_country = '4' THEN 'moved' ELSE keywords END, NULL FROM regions""",
    "wl_update_in": "SELECT id, airport_ident, CASE WHEN airport_ident IN ('Customer#000000001', 'Customer#000000002', 'Customer#000000004', 'Customer#000000005') THEN 'TWR' ELSE type END AS type FROM airport_frequencies",
    "wl_insert": """SELECT 'airport' AS relation, ident AS code, CAST(id AS BIGINT) AS id, name, iso_country FROM airport UNION ALL SELECT 'airport', 'new-' || s_name, NULL, s_name, NULL FROM supplier
      UNION ALL SELECT 'region', code, CAST(id AS BIGINT), name, iso_country FROM regions UNION ALL SELECT 'region', 'S-' || s_suppkey, NULL, s_name, '9' FROM supplier
      UNION ALL SELECT 'country', code, CAST(id AS BIGINT), name, NULL FROM countries UNION ALL SELECT 'country', 'C' || n_nationkey, NULL, n_name, NULL FROM nation
      UNION ALL SELECT 'frequency', airport_ident, CAST(id AS BIGINT), type, NULL FROM airport_frequencies UNION ALL SELECT 'frequency', c_name, CAST(-c_custkey - 1 AS BIGINT), 'TWR', NULL FROM customer
      UNION ALL SELECT 'runway', airport_ident, CAST(id AS BIGINT), surface, NULL FROM runways UNION ALL SELECT 'runway', c_name, CAST(-c_custkey - 1 AS BIGINT), 'ASP', NULL FROM customer
      UNION ALL SELECT 'navaid', ident, CAST(id AS BIGINT), name, iso_country FROM navaids UNION ALL SELECT 'navaid', 'N-' || p_partkey, CAST(-p_partkey - 1 AS BIGINT), p_name, NULL FROM part""",
    "wl_delete": """SELECT 'airport' AS relation, CAST(id AS BIGINT) AS id FROM airport WHERE ident <> 'Customer#000000003' AND (gps_code IS NULL OR gps_code <> 'G7')
      UNION ALL SELECT 'frequency', id FROM airport_frequencies WHERE type <> '1-URGENT' UNION ALL SELECT 'runway', id FROM runways WHERE airport_ident <> 'Customer#000000010'
      UNION ALL SELECT 'navaid', id FROM navaids WHERE ident <> 'Supplier#000000002' UNION ALL SELECT 'country', id FROM countries WHERE code <> '0' UNION ALL SELECT 'region', id FROM regions WHERE name <> 'NATION_7'""",
    "wl_delete_or_like": "SELECT id, name FROM airport WHERE NOT coalesce(name LIKE 'Field 5%' OR iata_code LIKE 'A1%', false)",
    "key_violations": "SELECT name, count(*) AS n FROM airport GROUP BY 1 HAVING count(*) > 1",
    "missing_references": "SELECT id FROM airport WHERE id NOT IN (SELECT airport_ref FROM runways)",
}
O |= {key: w(AIRPORT) + sql for key, sql in _WL.items()}

# streamed scores of fixed weights
_cell = lambda j: f"(((7 * (i - 1) + 3 * {j}) % 11) - 5) / 10"
O["ocsvm_stream"] = "WITH c AS (SELECT vec_id AS id, label, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), " + (
    "p AS (SELECT id, label, " + ", ".join(f"sum(x * {_cell(j)}) AS p{j}" for j in range(8)) + " FROM c GROUP BY 1, 2) "
    "SELECT id, label, round(0.125 - 0.5 * (" + " + ".join(f"{(j % 3 - 1) / 4} * cos(p{j} + {j / 8})" for j in range(8)) + "), 6) AS score FROM p"
)
