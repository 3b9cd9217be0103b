"""The same results as SQL, where SQL can express them."""

from __future__ import annotations

from querysieve.llm import license_scan

ORACLE: dict[str, str] = {}

ORACLE["op3_quality_cascade"] = r"""
WITH held AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), parts AS (
  SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ln
  FROM held
), windows AS (
  SELECT r, i, w[i:i + 4] AS win FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM parts WHERE len(w) >= 5)
), counted AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, win) AS n FROM windows
), spans AS (
  SELECT r, least(5, coalesce(lead(i) OVER (PARTITION BY r ORDER BY i) - i, 5)) AS step FROM counted WHERE n > 1
), repeated AS (
  SELECT r, sum(step)::BIGINT AS n FROM spans GROUP BY r
), measured AS (
  SELECT p.*, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols,
    (len(ln) - len(list_distinct(ln)))::BIGINT AS n_dup_lines, coalesce(repeated.n, 0) AS n_repeat_words
  FROM parts p LEFT JOIN repeated USING (r)
), based AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM measured
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 10 * n_symbols > n_words
    OR 2 * n_dup_lines > len(ln)
    OR 10 * len(regexp_extract_all(text, '(?m)^[ \t]*[-*•]')) > 9 * len(ln)
    OR 10 * len(regexp_extract_all(text, '(?m)(?:\.\.\.|…)[ \t]*$')) > 5 * len(ln)
    OR 10 * len(regexp_extract_all(text, '[^\x20\x09-\x0D]*\p{L}[^\x20\x09-\x0D]*')) < 6 * n_words) AS kept
FROM based
"""

ORACLE["op9_source_mix"] = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), each AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight,
    source_size * 2.0::DOUBLE AS cap, (SELECT sum(source_size) FROM each)::DOUBLE * 1.5 AS total FROM each
), summed AS (
  SELECT *, (total - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS unit
  FROM weighed WINDOW o AS (ORDER BY cap / weight, source NULLS LAST)
), priced AS (
  SELECT *, (SELECT unit FROM summed WHERE weight * unit < cap ORDER BY cap / weight, source NULLS LAST LIMIT 1) AS price
  FROM summed
), targets AS (
  SELECT source, source_size, least(cap, coalesce(weight * price, cap)) AS target FROM priced
), drawn AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
    ('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source
)
SELECT doc_id, size, source_size, target,
  ((floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM drawn
"""

ORACLE["op1_warc_salvage"] = r"""
WITH held AS (
  SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, ''))::BIGINT AS payload_bytes FROM pages
), first AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY html) END AS f FROM held
)
SELECT page_id, payload_bytes, sha256(html) AS payload_digest,
  CASE WHEN f IS NULL OR f IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN f IS DISTINCT FROM page_id THEN f END AS refers_to
FROM first
"""

ORACLE["op5_chat_events"] = r"""
WITH all_rows AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), escaped AS (
  SELECT *, replace(replace(replace(replace(replace(text, '\', '\\'), '<s>', '<\s>'), '</s>', '<\/s>'),
    '[INST]', '[\INST]'), '[/INST]', '[\/INST]') AS body FROM all_rows
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, md5(text))) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, md5(text)) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(role) + length(body) + 20)::BIGINT AS formatted_chars
FROM escaped GROUP BY conv_id
"""

_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


def _values(rows) -> str:
    quoted = lambda x: str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return ", ".join(f"({', '.join(map(quoted, r))})" for r in rows)


def _license_sql() -> str:
    known = license_scan.Templates(license_scan.TEMPLATES, license_scan.PERCENT)
    wanted = _values([
        (number, label, known.span(words), license_scan.needed(len(set(words)), known.percent), len(set(words)), word.decode())
        for number, (label, words) in enumerate(known.held) for word in sorted(set(words))
    ])
    phrases = _values([
        (label, phrase, k, len(phrase.split()), word) for phrase, label in license_scan.PHRASES for k, word in enumerate(phrase.split())
    ])
    return f"""
WITH wanted(template, label, span, least, size, word) AS (VALUES {wanted}), phrases(label, phrase, k, n, word) AS (VALUES {phrases}),
held AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents
), spots AS (
  SELECT * FROM (SELECT r, unnest(range(len(w)))::BIGINT AS spot, unnest(w) AS word FROM held)
  WHERE word IN (SELECT word FROM wanted UNION ALL SELECT word FROM phrases)
), base AS (
  SELECT r, spot - k AS spot, label FROM spots JOIN phrases USING (word) GROUP BY r, spot - k, label, phrase, n HAVING count(*) = n
), based AS (
  SELECT r, count(*)::BIGINT AS n_base, min(spot) AS first_word, max(spot) AS last_word, list(DISTINCT label) AS labels FROM base GROUP BY r
), blocks AS (
  SELECT DISTINCT r, c.span, spot // c.span - k AS block, word
  FROM spots, (SELECT DISTINCT span FROM wanted) c, (VALUES (0), (1)) back(k)
  WHERE spot // c.span >= k AND word IN (SELECT word FROM wanted)
), met AS (
  SELECT r, label, count(*)::DOUBLE / any_value(size) AS score FROM blocks JOIN wanted USING (span, word)
  GROUP BY r, block, template, label HAVING count(*) >= any_value(least)
), more AS (SELECT r, list(DISTINCT label) AS labels, max(score) AS score FROM met GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(array_to_string(list_sort(based.labels), ','), '') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(based.labels, []), coalesce(more.labels, [])))), ',') AS labels,
  CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(more.score, 0.0) END::DOUBLE AS score
FROM held LEFT JOIN based USING (r) LEFT JOIN more USING (r)
"""


ORACLE["op11_license_scan"] = _license_sql()
