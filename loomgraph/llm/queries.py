"""The queries of the corpus operators, and SQL for those that SQL can express.

A query applies its operator, with production parameters, to a whole table and
derives digest columns from the operator's own results.
"""

from __future__ import annotations

import os
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import bpe, decontam, licenses, media, minhash, packing, quality, substrings, toxicity, warc



def _tokenizer(name: str) -> str:
    """Where a public tokenizer file lies: in ``LOOMGRAPH_TOKENIZERS`` if that is set, else where the installed files are."""
    folder = os.environ.get("LOOMGRAPH_TOKENIZERS")
    return os.path.join(folder, name) if folder else public_tokenizers.path(name)


BYTE_BPE = _tokenizer("byte_bpe_50k.json")
BYTE_RANKS = _tokenizer("byte_bpe_50k.tiktoken")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode(docs, BYTE_BPE, decoded="decoded")
    return coded.select(
        "doc_id",
        "n_tokens",
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(read(spark, sf_dir, "documents"), BYTE_RANKS)
    return packed.select("shard", "bin", "n_tokens", "doc_ids", "pieces", "cu_seqlens", F.sha2("input_ids", 256).alias("ids_sha256"), F.sha2("position_ids", 256).alias("positions_sha256"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.score(docs, quality.fit(docs)).select("doc_id", "quality_score", "accepted")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return substrings.remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH w AS (SELECT doc_id, [x FOR x IN string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+') IF x <> ''] AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 49], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50)),
least_id AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM win JOIN least_id USING (k) WHERE m < doc_id),
each AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS word FROM w),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t FROM each ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("data"))
    stored = media.store(docs, "data").select("doc_id", F.octet_length("data").cast("long").alias("n_bytes"), "media")
    return media.load(stored).select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = minhash.groups_of(read(spark, sf_dir, "documents"), percent=85)
    return groups.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


OP6_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, [x FOR x IN string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF x <> ''] AS ws FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)
  UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM w WHERE len(ws) BETWEEN 1 AND 4),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT b, root FROM reach JOIN links ON a = node),
comp AS (SELECT node, min(root) AS component_id FROM reach GROUP BY node)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN comp ON node = d.doc_id
"""


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.contaminated(docs, read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", (F.size("matches") > 0).alias("contaminated"), F.col("matches.item_id").alias("item_ids"), F.array_min("matches.edits").alias("least_edits"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read(spark, sf_dir, "labels").where(~held_out)
    scored = toxicity.score(docs, toxicity.fit(docs, labels))
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(read(spark, sf_dir, "documents"))


def _op9_sql() -> str:
    rows = ", ".join(f"('{words}', '{label}', {str(base).lower()})" for label, _, words, base in licenses.known_templates())
    k, slack = licenses.K, licenses.SLACK
    return rf"""
WITH given(phrase, label, base) AS (SELECT DISTINCT * FROM (VALUES {rows})),
known AS (SELECT row_number() OVER () AS template, label, base, string_split(phrase, ' ') AS ps FROM given),
t AS (SELECT template, label, base, i - 1 AS place, array_to_string(ps[i:i + {k - 1}], ' ') AS run, len(ps) - {k - 1} AS runs, len(ps) AS template_words,
  CASE WHEN len(ps) <= {licenses.SHORT} THEN 1.0 ELSE {licenses.NEED} END AS need FROM (SELECT *, unnest(range(1, len(ps) - {k - 2})) AS i FROM known)),
w AS (SELECT doc_id, [x FOR x IN string_split_regex(translate(coalesce(text, ''), '{licenses.UPPER}', '{licenses.LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') IF x <> ''] AS ws FROM documents),
g AS (SELECT doc_id, i - 1 AS word, array_to_string(ws[i:i + {k - 1}], ' ') AS run FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {k - 2})) AS i FROM w WHERE len(ws) >= {k})),
hits AS (SELECT doc_id, word, word - place AS diagonal, t.* EXCLUDE (run) FROM g JOIN t USING (run)),
apart AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal, word) <= CASE WHEN base THEN 0 ELSE {slack} END THEN 0 ELSE 1 END AS apart FROM hits),
merged AS (SELECT *, sum(apart) OVER (PARTITION BY doc_id, template ORDER BY diagonal, word) AS span FROM apart),
whole AS (SELECT doc_id, template, span, count(DISTINCT place) / any_value(runs) >= any_value(need) AND max(word) + {k} - min(word) > 1.5 * any_value(template_words) + {slack} AS cuts FROM merged GROUP BY 1, 2, 3),
marked AS (SELECT merged.*, CASE WHEN cuts AND (place <= lag(place) OVER reading OR abs(diagonal - lag(diagonal) OVER reading) > {slack}) THEN 1 ELSE 0 END AS cut
  FROM merged JOIN whole USING (doc_id, template, span) WINDOW reading AS (PARTITION BY doc_id, template, span ORDER BY word, place)),
numbered AS (SELECT *, sum(cut) OVER (PARTITION BY doc_id, template, span ORDER BY word, place) AS part FROM marked),
parts AS (SELECT doc_id, template, span, part, min(diagonal) AS diagonal, min(word) AS first, max(word) + {k} AS end_word, count(DISTINCT place) / any_value(runs) AS covered,
  any_value(template_words) AS template_words, any_value(need) AS need, any_value(label) AS label, any_value(base) AS base FROM numbered GROUP BY 1, 2, 3, 4),
held AS (SELECT * FROM parts WHERE covered >= need AND end_word - first <= 1.5 * template_words + {slack}),
found AS (SELECT doc_id, count(*) FILTER (base) AS n_base, min(diagonal) FILTER (base) AS first_word, max(diagonal) FILTER (base) AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(covered) AS score
  FROM held GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM w LEFT JOIN found USING (doc_id)
"""


def warc_records(pages: DataFrame) -> DataFrame:
    """Captures bound to the pages table: of each page a full response, one that failed, and two later revisits, with or without fitting validators."""
    k, page = F.col("k"), F.col("page_id")
    second = F.lit(1704067200) + page * 7919 % 100003 + F.when(k == 3, 30000).otherwise(k * 60000)
    answer = k.isin(0, 3)
    tag = F.when(k < 2, F.md5("html")).when(page % 3 == 1, F.lit("stale"))
    changed = F.when((k == 0) | (k == 2) & (page % 3 == 2), page.cast("string"))
    stored = F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("Content-Length"), F.octet_length("html").cast("string"), F.lit("ETag"), tag, F.lit("Last-Modified"), changed)
    update = F.create_map(F.lit("Content-Length"), F.lit("0"), F.lit("Date"), second.cast("string"), F.lit("ETag"), F.concat(F.lit("W/"), tag), F.lit("Last-Modified"), changed)
    return pages.select("*", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k")).select(
        (page * 4 + k).alias("record_id"),
        "url",
        F.when(answer, "response").otherwise("revisit").alias("kind"),
        F.when(~answer, warc.NOT_MODIFIED).alias("profile"),
        F.timestamp_seconds(second).alias("date"),
        F.map_filter(F.when(answer, stored).otherwise(update), lambda _, v: v.isNotNull()).alias("headers"),
        F.when(k == 0, F.encode("html", "UTF-8")).when(k == 3, F.lit(b"gone")).alias("payload"),
        F.when(k == 0, 200).when(k == 3, F.when(page % 2 == 0, 404).otherwise(206)).otherwise(304).alias("http_status"),
    )


def op10_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.resolve(warc_records(read(spark, sf_dir, "pages")))
    pairs = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(":"), e["value"]))
    return found.select("record_id", "url_key", "refers_to", "status", F.array_join(pairs, "|").alias("headers"), F.sha2("payload", 256).alias("payload_sha256"))


OP10_SQL = r"""
WITH bare AS (SELECT page_id, url, html, regexp_replace(trim(url), '#.*$', '') AS u FROM pages),
cut AS (SELECT page_id, url, html, starts_with(lower(u), 'https:') AS secure, lower(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)', 1)) AS h, regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*(.*)$', 1) AS r FROM bare),
parts AS (SELECT page_id, url, html, regexp_replace(regexp_replace(h, '^www\.', ''), CASE WHEN secure THEN ':443$' ELSE ':80$' END, '') AS h, regexp_replace(regexp_extract(r, '^([^?]*)', 1), '/+$', '') AS p,
  array_to_string(list_sort([q FOR q IN string_split(regexp_extract(r, '\?(.*)$', 1), '&') IF q <> '' AND NOT regexp_matches(q, '^(utm_[a-z]+|fbclid|gclid)(=|$)')]), '&') AS q FROM cut),
keyed AS (SELECT page_id, html, CASE WHEN h = '' THEN url ELSE h || p || CASE WHEN q <> '' THEN '?' || q ELSE '' END END AS url_key FROM parts),
rec AS (SELECT page_id * 4 + k AS record_id, k, page_id, url_key, 1704067200 + page_id * 7919 % 100003 + k * 60000 AS sec,
  CASE WHEN k < 2 THEN md5(html) WHEN page_id % 3 = 1 THEN 'stale' END AS tag, CASE WHEN k = 0 OR (k = 2 AND page_id % 3 = 2) THEN CAST(page_id AS VARCHAR) END AS changed, html
  FROM keyed, (SELECT unnest([0, 1, 2]) AS k)),
pairs AS (SELECT v.record_id, v.url_key, v.sec, v.tag, v.changed, r.record_id AS refers_to, r.tag AS s_tag, r.changed AS s_changed, r.html,
  row_number() OVER (PARTITION BY v.record_id ORDER BY r.sec DESC, r.record_id DESC) AS n
  FROM rec v LEFT JOIN rec r ON r.k = 0 AND r.url_key = v.url_key AND (r.sec < v.sec OR (r.sec = v.sec AND r.record_id < v.record_id)) WHERE v.k > 0),
judged AS (SELECT *, CASE WHEN refers_to IS NULL THEN 'orphan' WHEN tag IS NOT NULL THEN CASE WHEN tag = s_tag THEN 'resolved' ELSE 'mismatch' END
  WHEN changed IS NOT NULL THEN CASE WHEN changed = s_changed THEN 'resolved' ELSE 'mismatch' END ELSE 'unchecked' END AS status FROM pairs WHERE n = 1)
SELECT record_id, url_key, refers_to, status,
  CASE WHEN status IN ('resolved', 'unchecked') THEN 'content-length:' || strlen(html) || '|content-type:text/html|date:' || sec || '|etag:' || coalesce('W/' || tag, s_tag) || '|last-modified:' || coalesce(changed, s_changed) END AS headers,
  CASE WHEN status IN ('resolved', 'unchecked') THEN sha256(html) END AS payload_sha256
FROM judged
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe_round_trip": op1_bpe_round_trip,
    "op2_token_packing": op2_token_packing,
    "op3_quality": op3_quality,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_media_columns": op5_media_columns,
    "op6_minhash_near_dedup": op6_minhash_near_dedup,
    "op7_decontamination": op7_decontamination,
    "op8_toxicity": op8_toxicity,
    "op9_license_scan": op9_license_scan,
    "op10_warc_revisits": op10_warc_revisits,
}

ORACLE: dict[str, str] = {
    "op4_substring_dedup": OP4_SQL,
    "op6_minhash_near_dedup": OP6_SQL,
    "op9_license_scan": _op9_sql(),
    "op10_warc_revisits": OP10_SQL,
}
