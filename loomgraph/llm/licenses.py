"""License notices by diagonal voting, in DataFrame operations throughout.

Every run of ``K`` words of every text is hashed and joined with the hashes of
the templates' runs (the words are compared too, so no hash collision counts).
A hit votes for its template on the diagonal ``word - place in template``. On
one diagonal, votes for every run of a phrase are the phrase itself. A notice
with words put in or left out has its votes on neighbouring diagonals, which
merge where they are ``SLACK`` apart at most; a merged span holds if it covers
the part ``NEED`` of the template's runs within a length of 1.5 templates. Where
a merged span is longer, as several copies in a row are, it is cut before each
run that is not beyond the last one in the template, and the parts are judged.

Templates are a table (``templates``); the public texts of ``license_texts`` are
used where none is given. Their side of the join is broadcast as long as they
have ``BROADCAST_RUNS`` runs at most, which is counted, and is joined by a
shuffle of the runs' hashes beyond it. Each text is scanned once; only hits and
one row per document are shuffled, and all windows over hits lie within one
document, whose hits are one shuffle apart.

Edge cases: a null text has no words; each input row gives one result row, also
where rows repeat or ids are null; a text shorter than ``K`` words has no hits;
an empty table gives an empty one; only the id and text columns are read, so
others cannot clash; templates with a null or a text of under ``K`` words are
left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgraph.llm.license_texts import TEXTS

#: Words of a run.
K = 3
#: Diagonals that merge are this far apart at most.
SLACK = 4
#: Part of a long template's runs that a span must cover; short phrases need all.
NEED = 0.6
SHORT = 7

#: Phrases whose every exact place is counted.
BASE = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]

#: (words, label) of the public texts.
NOTICES = [(words, label) for label, _, words in TEXTS]

#: Runs of templates that are broadcast at most (some 100 bytes each).
BROADCAST_RUNS = 200_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


_OF_TEMPLATE = ("runs", "template_words", "need", "label", "version", "base")


def known_templates() -> list[tuple[str, str, str, bool]]:
    """(label, version, text, base) of the phrases that are counted and of the public texts."""
    return [(label, "", phrase, True) for phrase, label in BASE] + [(label, version, words, False) for label, version, words in TEXTS]


def templates(spark: SparkSession) -> DataFrame:
    """The table (label, version, text, base) of templates that is used where none is given."""
    rows = ", ".join(f"('{label}', '{version}', '{words}', {str(base).lower()})" for label, version, words, base in known_templates())
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(label, version, text, base)")


def template_runs(table: DataFrame) -> DataFrame:
    """(template, place, template_run, hash, runs, template_words, need, label, base) of every run of every template."""
    split = table.where("text IS NOT NULL AND label IS NOT NULL").select("label", "version", F.coalesce("base", F.lit(False)).alias("base"), words_of(F.col("text")).alias("w"))
    n = F.size("w")
    numbered = split.where(n >= K).select(
        F.xxhash64("label", "version", "base", F.array_join("w", " ")).alias("template"),
        "w",
        (n - K + 1).alias("runs"),
        n.alias("template_words"),
        F.when(n <= SHORT, F.lit(1.0)).otherwise(F.lit(NEED)).alias("need"),
        "label",
        "version",
        "base",
    )
    each = numbered.select("template", *_OF_TEMPLATE, F.posexplode(runs_of(F.col("w"))).alias("place", "template_run"))
    return each.withColumn("hash", F.xxhash64("template_run"))


def words_of(text: Column) -> Column:
    """Words of a text, A-Z lower-cased."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), GAPS, -1), lambda w: w != "")


def runs_of(words: Column) -> Column:
    """Every run of ``K`` words, joined by a space; none where there are fewer."""
    n = F.size(words)
    runs = F.transform(F.sequence(F.lit(0), n - K), lambda i: F.concat_ws(" ", *[F.get(words, i + j) for j in range(K)]))
    return F.coalesce(F.when(n >= K, runs), F.array().cast("array<string>"))


def _hits(docs: DataFrame, doc_id: str, text: str, table: DataFrame | None) -> DataFrame:
    """One row per (row, template, place, word), and one per row that has the number of its words."""
    words = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{doc_id}`").alias("doc_id"), words_of(F.col(f"`{text}`")).alias("w"))
    head = F.array(F.lit(None).cast("string"))  # the row that carries the number of words
    each = words.select("row", "doc_id", F.size("w").cast("long").alias("n_words"), F.posexplode(F.concat(head, runs_of(F.col("w")))).alias("at", "run"))
    each = each.withColumn("hash", F.xxhash64("run"))
    known = template_runs(templates(docs.sparkSession) if table is None else table.dropDuplicates(["label", "version", "text", "base"]))
    if table is None or known.limit(BROADCAST_RUNS + 1).count() <= BROADCAST_RUNS:
        known = F.broadcast(known)
    hits = each.join(known, (each["hash"] == known["hash"]) & (each["run"] == known["template_run"]), "left").where("template IS NOT NULL OR at = 0")
    word = (F.col("at") - 1).cast("long")
    return hits.select("row", "doc_id", "n_words", "template", "place", word.alias("word"), (word - F.col("place")).alias("diagonal"), *_OF_TEMPLATE).repartition("row")


def _spans(hits: DataFrame) -> DataFrame:
    """Merged diagonals with what they cover; the row with the number of words stays."""
    diagonal, place = F.col("diagonal"), F.col("place")
    of = ("row", "template", "span")
    along = Window.partitionBy("row", "template").orderBy("diagonal", "word")
    step = diagonal - F.lag("diagonal").over(along)
    merged = hits.withColumn("apart", F.when(step <= F.when(F.col("base"), 0).otherwise(SLACK), 0).otherwise(1)).withColumn("span", F.sum("apart").over(along))
    whole = Window.partitionBy(*of)
    length = F.max("word").over(whole) + K - F.min("word").over(whole)
    longest = 1.5 * F.col("template_words") + SLACK
    covered = F.size(F.collect_set("place").over(whole)) / F.col("runs")
    judged = merged.withColumn("cuts", (covered >= F.col("need")) & (length > longest))
    reading = Window.partitionBy(*of).orderBy("word", "place")
    back = (place <= F.lag("place").over(reading)) | (F.abs(diagonal - F.lag("diagonal").over(reading)) > SLACK)
    cut = judged.withColumn("cut", F.when(F.col("cuts") & back, 1).otherwise(0)).withColumn("part", F.sum("cut").over(reading))
    parts = cut.groupBy("row", "doc_id", "template", "span", "part").agg(
        F.min("diagonal").alias("diagonal"),
        F.min("word").alias("first"),
        (F.max("word") + K).alias("end"),
        F.size(F.collect_set("place")).alias("places"),
        *[F.first(c).alias(c) for c in ("n_words", *_OF_TEMPLATE)],
    )
    parts = parts.withColumn("covered", F.col("places") / F.col("runs"))
    fits = F.col("end") - F.col("first") <= longest
    return parts.withColumn("holds", F.col("template").isNotNull() & (F.col("covered") >= F.col("need")) & fits)


def license_spans(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", templates: DataFrame | None = None) -> DataFrame:
    """(doc_id, label, version, first, end, covered, base) of every verified span; words count from 0, ``end`` is excluded."""
    return _spans(_hits(docs, doc_id, text, templates)).where("holds").select("doc_id", "label", "version", "first", "end", "covered", "base")


def scan_licenses(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", templates: DataFrame | None = None) -> DataFrame:
    """Per row: ``n_words``, places of base phrases (``n_base``, ``first_word``, ``last_word``), labels and a score.

    The score is the largest part of a template that a verified span covers, 0 without any.
    """
    spans = _spans(_hits(docs, doc_id, text, templates))
    base, holds = F.col("holds") & F.col("base"), F.col("holds")
    listed = lambda of: F.array_join(F.array_sort(F.collect_set(F.when(of, F.col("label")))), ",")
    return spans.groupBy("row", "doc_id").agg(
        F.max("n_words").alias("n_words"),
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("diagonal"))).alias("first_word"),
        F.max(F.when(base, F.col("diagonal"))).alias("last_word"),
        listed(base).alias("base_labels"),
        listed(holds).alias("labels"),
        F.coalesce(F.max(F.when(holds, F.col("covered"))), F.lit(0.0)).alias("score"),
    ).drop("row")
