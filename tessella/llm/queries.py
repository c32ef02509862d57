"""The operators applied to their whole tables, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, htmltext, lshforest, milquality, mixing, periodic, pseudonyms, rules, secrets, tokencount, toxicity, treapsearch, warc
from .common import materialise, table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


def op2_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.roundtrip(table(spark, sf_dir, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return milquality.score(docs, milquality.fit(docs, table(spark, sf_dir, "labels")))


def op5_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a fixed key, as results are compared; production passes a secret one."""
    return pseudonyms.pseudonymise(table(spark, sf_dir, "documents"), key="example key")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf_dir, "documents"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    mixed = mixing.draw(materialise(mixing.measured(docs).drop("text"), "mix-measured"))
    rounded = [F.round(c, 6).alias(c) for c in ("prob", "weight")]
    return mixed.select("doc_id", "source", "lang", "topic", "n_tokens", *rounded)


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lshforest.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learned = rules.fit_rules(docs, table(spark, sf_dir, "labels"))
    made = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return rules.apply_rules(docs.select("doc_id", "text"), learned).select("doc_id", *made)


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract_main_text(table(spark, sf_dir, "pages"))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return materialise(scored.select("doc_id", "held_out", "score", "predicted"), "toxicity", small=True)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts with planted runs, as the result is defined on; written without the texts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", periodic.with_planted_runs(F.col("doc_id"), F.col("text")).alias("text"))
    found = periodic.find_runs(docs)
    return materialise(found.select("doc_id", *(c.alias(n) for n, c in periodic.digests(F.col("runs")).items()), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words"), "runs", small=True)


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = materialise(treapsearch.build_index(table(spark, sf_dir, "documents")), "search-index", small=True)
    return treapsearch.search(index, table(spark, sf_dir, "benchmark"))


OP2_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS payload_digest,
         CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes
  FROM pages),
q AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS kept FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN kept > page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN kept > page_id THEN kept END AS refers_to
FROM q
"""

OP8_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i : array_to_string(w[i:i + 4], ' '))) END) AS g
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT u, v FROM pairs JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE c >= 0.8 * (x.n + y.n - c) - 1e-6),
both_ways AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
reach(u, v) AS (
  SELECT u, v FROM both_ways UNION SELECT r.u, b.v FROM reach r JOIN both_ways b ON r.v = b.u)
SELECT d.doc_id, least(d.doc_id, coalesce(r.least, d.doc_id)) AS class_id, coalesce(k.n, 0) AS n_links
FROM documents d
LEFT JOIN (SELECT u, min(v) AS least FROM reach GROUP BY u) r ON r.u = d.doc_id
LEFT JOIN (SELECT u, count(*) AS n FROM both_ways GROUP BY u) k ON k.u = d.doc_id
"""

OP12_SQL = r"""
WITH crc AS (  -- the table of the checksum, by its rule
  SELECT list_transform(range(256), lambda x : list_reduce(range(8), lambda c, k : CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, x)) AS t),
h AS (
  SELECT d.*, xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x : CAST(ascii(x) AS BIGINT)),
    lambda c, b : xor(t[(xor(c, b) & 255) + 1], c >> 8), 4294967295::BIGINT), 4294967295) AS h,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS own
  FROM documents d, crc),
g AS (SELECT *, len(own) AS n, CASE WHEN h % 10 = 0 AND len(own) > 0 THEN (h // 10) % len(own) END AS a, 3 + (h // 10) % 8 AS f FROM h),
w AS (
  SELECT doc_id, n, CASE WHEN a IS NULL THEN own ELSE
    list_transform(range(n), lambda i : CASE WHEN i < a THEN own[i + 1] ELSE own[a + (i - a) % (1 + (n - a) // f) + 1] END) END AS w FROM g),
u AS (SELECT doc_id, n, unnest(w) AS x, unnest(range(n)) AS i FROM w),
pairs AS (SELECT a.doc_id, b.i - a.i AS q, a.i FROM u a JOIN u b ON a.doc_id = b.doc_id AND a.x = b.x AND a.i < b.i AND 4 * (b.i - a.i) <= a.n),
islands AS (
  SELECT doc_id, q, min(i) AS s, count(*) + q AS m
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM pairs) GROUP BY doc_id, q, k
  HAVING count(*) + q >= greatest(6, 4 * q)),
runs AS (SELECT doc_id, s, m, min(q) AS q FROM islands GROUP BY ALL),
r AS (
  SELECT doc_id, count(*) AS n_runs, arg_min({'s': s, 'm': m, 'q': q}, (-m, s, q)) AS b, string_agg(s || ',' || m || ',' || q || chr(10), '' ORDER BY s, q) AS l
  FROM runs GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + m)) AS i FROM runs),
kept AS (SELECT u.doc_id, string_agg(x, ' ' ORDER BY i) AS c FROM u ANTI JOIN gone USING (doc_id, i) GROUP BY u.doc_id)
SELECT w.doc_id, coalesce(n_runs, 0) AS n_runs, b.s AS start, b.m AS length, b.q AS period, 1000 * b.m // b.q AS exponent_milli,
       sha256(coalesce(l, '')) AS runs_sha256, sha256(coalesce(c, '')) AS collapsed_sha256, n AS n_words
FROM w LEFT JOIN r ON r.doc_id = w.doc_id LEFT JOIN kept ON kept.doc_id = w.doc_id
"""

OP13_SQL = r"""
WITH t AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
i AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
c AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
s AS (SELECT count(*) AS nd, CAST(sum(n) AS BIGINT) AS l FROM c),
p AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * nd + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, s GROUP BY term, nd),
x AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nd) // l)))) AS BIGINT) AS score
  FROM i JOIN p USING (term) JOIN w USING (term) JOIN c USING (doc_id), s GROUP BY item_id, doc_id HAVING score > 0)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM x QUALIFY rank <= 10
"""


def op7_sql(seed: int = 42, rounds: int = 20, budget: float = 0.5) -> str:
    """The same raking as one chain of queries; after so many rounds nothing moves any more."""
    m = mixing.MARGINS
    out = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS lang, coalesce(text, '') AS text,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens,
         source AS own_source, lang AS own_lang
  FROM documents),
t AS (
  SELECT *, CASE WHEN text LIKE '%|%|%' THEN 'table' WHEN text LIKE '%License%' THEN 'legal'
    WHEN regexp_matches(text, '[0-9]{3}') THEN 'numeric' WHEN n_tokens < 100 THEN 'note' ELSE 'prose' END AS topic
  FROM d),
c0 AS (
  SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS n, CAST(sum(n_tokens) AS DOUBLE) AS w
  FROM t GROUP BY ALL HAVING sum(n_tokens) > 0)"""
    for x in m:
        out += f""",
s_{x} AS (SELECT {x}, pow(sum(n), {mixing.TEMPERATURE[x]}) AS p FROM c0 GROUP BY {x}),
t_{x} AS (SELECT {x}, p / sum(p) OVER () AS t_{x} FROM s_{x})"""
    out += ",\nr0 AS (SELECT * FROM c0" + "".join(f" JOIN t_{x} USING ({x})" for x in m) + ")"
    steps = [x for _ in range(rounds) for x in m]
    for k, x in enumerate(steps):
        out += f",\nr{k + 1} AS (SELECT * REPLACE (w * t_{x} / sum(w) OVER (PARTITION BY {x}) AS w) FROM r{k})"
    order = f"ORDER BY f DESC, {', '.join(m)} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    out += f""",
f AS (SELECT *, w * sum(n) OVER () / (sum(w) OVER () * n) AS f, sum(n) OVER () AS a FROM r{len(steps)}),
g AS (SELECT *, coalesce(sum(n) OVER ({order}), 0) AS whole, coalesce(sum(n * f) OVER ({order}), 0) AS spent FROM f),
h AS (SELECT *, ({budget} * a - whole) / nullif(a - spent, 0) AS c FROM g),
k AS (SELECT coalesce(arg_min(c, whole) FILTER (c >= 0 AND c * f <= 1), 'inf'::DOUBLE) AS q FROM h),
p AS (SELECT source, lang, topic, least(q * f, 1) AS prob, greatest(q * f, 1) AS weight FROM h, k)
SELECT doc_id, own_source AS source, own_lang AS lang, topic, n_tokens, round(prob, 6) AS prob, round(weight, 6) AS weight
FROM t JOIN p USING (source, lang, topic)
WHERE CAST('0x' || substr(md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) / 4503599627370496.0 < prob"""
    return out


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (
        op1_secret_scan, op2_warc_archive, op3_decontamination, op4_quality_classifier, op5_pii_pseudonyms,
        op6_token_counts, op7_source_mixing, op8_ngram_jaccard, op9_quality_rules, op10_html_extraction,
        op11_toxicity, op12_periodic_runs, op13_ranked_search,
    )
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return {"op2_warc_archive": OP2_SQL, "op7_source_mixing": op7_sql(), "op8_ngram_jaccard": OP8_SQL, "op12_periodic_runs": OP12_SQL, "op13_ranked_search": OP13_SQL}
