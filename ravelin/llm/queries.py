"""Registered queries of the llm operators and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import functions as F

from ravelin.llm import decontaminate, epsilon_join, licenses, pii, secrets, sentencepiece_scan, simhash, toxicity, url_filter, warc
from ravelin.runtime import table

#: Multipliers of the vector's id and of the component in the shift of each copy.
COPIES = [(31, 17), (7, 29)]


def op1_warc_derivatives(spark, sf_dir):
    return warc.derivatives(warc.responses(table(spark, sf_dir, "pages")))


def op2_secret_scan(spark, sf_dir):
    return secrets.scan(table(spark, sf_dir, "documents"))


def op3_epsilon_join(spark, sf_dir):
    return epsilon_join.epsilon_classes(table(spark, sf_dir, "embeddings"))


def epsilon_classes_of_copies(spark, sf_dir):
    """op3 over all embeddings and two shifted copies of each, so that there are links at every scale."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    both = e
    for c, (a, b) in enumerate(COPIES):
        shifted = F.expr(f"transform(embedding, (x, i) -> x + cast((vec_id * {a} + (i + 1) * {b}) % 101 - 50 as double) / cast(1000 as double))")
        both = both.union(e.select((F.col("vec_id") + (c + 1) * 10_000_000_000).alias("vec_id"), shifted.alias("embedding")))
    return epsilon_join.epsilon_classes(both)


def op4_pii(spark, sf_dir):
    return pii.scan(table(spark, sf_dir, "documents"))


def op5_toxicity(spark, sf_dir):
    return toxicity.toxic_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_sentencepiece(spark, sf_dir):
    return sentencepiece_scan.encode(table(spark, sf_dir, "documents"))


def op7_simhash_near_dedup(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_license_scan(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"))


def op9_benchmark_decontamination(spark, sf_dir):
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_url_filter(spark, sf_dir):
    return url_filter.url_filter(table(spark, sf_dir, "pages"), url_filter.default_rules(spark))


QUERIES = {f.__name__: f for f in (op1_warc_derivatives, op2_secret_scan, op3_epsilon_join, op4_pii, op5_toxicity, op6_sentencepiece, op7_simhash_near_dedup, op8_license_scan, op9_benchmark_decontamination, op10_url_filter, epsilon_classes_of_copies)}


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _base32_sql(x: str) -> str:
    chars = [
        f"substr('{warc.BASE32}', CAST((CAST('0x' || substr(sha1({x}), {g * 10 + 1}, 10) AS BIGINT) >> {35 - 5 * k}) & 31 AS INTEGER) + 1, 1)"
        for g in range(4)
        for k in range(8)
    ]
    return f"'sha1:' || {' || '.join(chars)}"


def _urn_sql(seed: str) -> str:
    h = f"md5({seed})"
    return f"'<urn:uuid:' || substr({h},1,8) || '-' || substr({h},9,4) || '-' || substr({h},13,4) || '-' || substr({h},17,4) || '-' || substr({h},21,12) || '>'"


def _warc_sql() -> str:
    text = "payload"
    for p, to in warc.TEXT_STEPS:
        text = f"regexp_replace({text}, {_lit(p)}, {_lit(to)}, 'g')"
    names = "MAP {" + ", ".join(f"{_lit(n)}: {_lit(c)}" for n, c in warc.ENTITIES.items()) + "}"
    odd = "MAP {" + ", ".join(f"{n}: {_lit(c)}" for n, c in warc.CP1252.items()) + "}"
    char = f"""CASE WHEN num IS NOT NULL THEN coalesce({odd}[num], CASE WHEN num = 0 OR num BETWEEN 55296 AND 57343 OR num > 1114111 THEN chr(65533) ELSE chr(num) END) WHEN name <> '' THEN {names}[name] END"""
    decoded = f"""(SELECT page_id, string_agg(CASE WHEN i = 1 THEN part ELSE coalesce({char} || substr(part, length(name) + 2), '&' || part) END, '' ORDER BY i) AS t FROM (
      SELECT *, CAST(CASE WHEN regexp_matches(name, '^#[0-9]') THEN substr(name, 2) WHEN regexp_matches(name, '^#[xX]') THEN '0x' || substr(name, 3) END AS INTEGER) AS num FROM (
        SELECT page_id, i, part, regexp_extract(part, '^(#[0-9]{{1,7}}|#[xX][0-9A-Fa-f]{{1,6}}|[A-Za-z][A-Za-z0-9]{{1,7}});', 1) AS name FROM (
          SELECT page_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS i FROM (SELECT page_id, string_split({text}, '&') AS parts FROM r)))) GROUP BY page_id)"""
    text = "t"
    for p, to in warc.SPACE_STEPS:
        text = f"regexp_replace({text}, {_lit(p)}, {_lit(to)}, 'g')"
    text = rf"trim(regexp_replace({text}, '^\n+|\n+$', '', 'g'), ' ')"
    crlf = "chr(13) || chr(10)"
    field = lambda n, v: f"(CASE WHEN {v} IS NULL OR {v} = '' THEN '' ELSE '{n}: ' || regexp_replace({v}, '[\\r\\n]+', ' ', 'g') || {crlf} END)"
    title = r"trim(regexp_extract(payload, '(?is)<title[^>]*>([^<]*)</title>', 1), ' ')"
    lang = r"regexp_extract(payload, '(?i)<html[^>]*\blang=[\"'']?([A-Za-z-]+)', 1)"
    status = "regexp_extract(http_header, '^HTTP/[0-9.]+ ([0-9]{3})', 1)"
    meta = " || ".join([field("via", "target_uri"), field("httpStatus", status), field("title", title), field("language", lang), field("sourceDigest", "source_digest"), field("sourceLength", "CAST(strlen(payload) AS VARCHAR)")])
    return f"""
WITH r AS (
  SELECT {_urn_sql("'response|' || CAST(page_id AS VARCHAR) || '|' || url")} AS refers_to, url AS target_uri, '2024-01-01T00:00:00Z' AS warc_date,
    'HTTP/1.1 200 OK' || {crlf} || 'Content-Type: text/html; charset=utf-8' || {crlf} || 'Content-Length: ' || CAST(strlen(html) AS VARCHAR) || {crlf} AS http_header,
    html AS payload, {_base32_sql("html")} AS source_digest, page_id
  FROM pages),
d AS (
  SELECT *, 'metadata' AS warc_type, 'application/warc-fields' AS content_type, {meta} AS block FROM r
  UNION ALL
  SELECT r.*, 'conversion', 'text/plain; charset=utf-8', {text} FROM r JOIN {decoded} x ON x.page_id = r.page_id)
SELECT {_urn_sql("warc_type || '|' || refers_to")} AS record_id, warc_type, refers_to, target_uri, warc_date, content_type, http_header AS source_header,
  source_digest, {_base32_sql("block")} AS block_digest, CAST(strlen(block) AS BIGINT) AS content_length, block
FROM d WHERE block IS NOT NULL"""


def _unreserved_sql(x: str) -> str:
    code = "upper(regexp_extract(p, '^([0-9A-Fa-f]{2})', 1))"
    piece = f"CASE WHEN regexp_matches({code}, '^(2D|2E|3[0-9]|4[1-9A-F]|5[0-9A]|5F|6[1-9A-F]|7[0-9A]|7E)$') THEN chr(CAST('0x' || {code} AS INTEGER)) || substr(p, 3) WHEN {code} <> '' THEN '%' || {code} || substr(p, 3) ELSE '%' || p END"
    return f"(string_split({x}, '%')[1] || array_to_string(list_transform(string_split({x}, '%')[2:], lambda p: {piece}), ''))"


def _url_sql() -> str:
    rules = ", ".join(f"({i}, {_lit(p)}, {_lit(a)}, {q})" for i, p, a, q in url_filter.DEFAULT_RULES)
    return rf"""
WITH rules(rule_id, pattern, action, priority) AS (VALUES {rules}),
u AS (SELECT DISTINCT url FROM pages),
b AS (SELECT url, regexp_replace(regexp_replace(regexp_replace(trim(url, ' '), '[\t\r\n]', '', 'g'), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*:[/\\]{{2}}', '') AS bare FROM u WHERE url IS NOT NULL),
a AS (SELECT url, bare, regexp_extract(bare, '^([^/\\?]*)', 1) AS auth FROM b),
t AS (SELECT url, regexp_replace(regexp_replace(auth, '^.*@', ''), ':[0-9]*$', '') AS host, substr(bare, length(auth) + 1) AS tail FROM a),
p AS (SELECT url, lower(regexp_replace({_unreserved_sql("host")}, '^[.]+|[.]+$', '', 'g')) AS host, regexp_extract(tail, '^([^?]*)', 1) AS raw, tail FROM t),
s AS (SELECT url, host, string_split(host, '.') AS labels, {_unreserved_sql("replace(raw, chr(92), '/')")} AS slashed, {_unreserved_sql("substr(tail, length(raw) + 1)")} AS query FROM p),
n AS (SELECT *, list_reduce(list_prepend('', string_split(slashed, '/')), lambda acc, x: CASE WHEN x = '..' THEN regexp_replace(acc, '/[^/]*$', '') WHEN x IN ('', '.') THEN acc ELSE acc || '/' || x END)
        || CASE WHEN regexp_matches(slashed, '(^|/)\.{{0,2}}$') THEN '/' ELSE '' END AS flat FROM s),
q AS (SELECT url, host, labels, CASE WHEN flat = '' THEN '/' ELSE flat END AS path, query FROM n),
h AS (SELECT url, unnest(CASE WHEN regexp_matches(host, '^[0-9.]+$') OR len(labels) < 2 THEN [host]
        ELSE list_transform(range(1, len(labels)), lambda i: array_to_string(labels[i:], '.')) END) AS host FROM q),
f AS (SELECT url, unnest(list_concat(list_transform(range(1, greatest(len(string_split(path, '/')), 2)), lambda i: array_to_string(string_split(path, '/')[1:i], '/') || '/'),
        [path], CASE WHEN length(query) > 1 THEN [path || query] ELSE [] END)) AS prefix FROM q),
e AS (SELECT DISTINCT url, host || prefix AS expr FROM h JOIN f USING (url)),
m AS (SELECT e.url, action, rule_id, pattern, row_number() OVER (PARTITION BY e.url ORDER BY length(regexp_extract(pattern, '^([^/]*)', 1)) DESC, length(pattern) DESC,
        priority DESC, (action = 'allow') DESC, rule_id) AS rn
      FROM e JOIN rules ON sha256(expr) = sha256(pattern))
SELECT u.url, coalesce(m.action, 'none') AS decision, CAST(m.rule_id AS BIGINT) AS rule_id, m.pattern FROM u LEFT JOIN m ON m.url = u.url AND m.rn = 1"""


def _copies_sql() -> str:
    copies = [
        f"SELECT vec_id + {(c + 1) * 10_000_000_000} AS vec_id, list_transform(range(1, len(embedding) + 1), lambda i: CAST(embedding[i] AS DOUBLE) + CAST((vec_id * {a} + i * {b}) % 101 - 50 AS DOUBLE) / CAST(1000 AS DOUBLE)) AS embedding FROM embeddings"
        for c, (a, b) in enumerate(COPIES)
    ]
    return epsilon_join.oracle_sql(f"({' UNION ALL '.join(['SELECT vec_id, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings', *copies])})")


ORACLE_SQL = {"epsilon_classes_of_copies": _copies_sql(), "op1_warc_derivatives": _warc_sql(), "op3_epsilon_join": epsilon_join.ORACLE_SQL, "op9_benchmark_decontamination": decontaminate.ORACLE_SQL, "op10_url_filter": _url_sql()}
