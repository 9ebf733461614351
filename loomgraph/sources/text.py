"""Sources that are text: git logs, unified diffs, Markdown, JSON lines, transcripts.

Each parser takes lines as rows (``doc``, ``pos``, ``line``) and carries headers forward with
windows per document, so a document's lines are one partition's work and documents spread.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgraph.session import prepare


def lines_of(df: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, pos, line): the lines of each text, from 0."""
    return df.select(F.col(doc).alias("doc"), F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n", -1)).alias("pos", "line"))


def git_log(lines: DataFrame) -> DataFrame:
    """(doc, pos, path, at, author, added, deleted) of numstat lines after ``@seconds author`` headers.

    ``-`` counts as 0, quoted paths are dropped.
    """
    head = r"^@(\d+) (.*)$"
    count = "([0-9]+|-)"
    stat = rf"^{count}\t{count}\t(.+)$"
    along = Window.partitionBy("doc").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    is_head = F.col("line").rlike(head)
    carried = lines.withColumn("h", F.last(F.when(is_head, F.col("line")), ignorenulls=True).over(along))
    number = lambda i: F.coalesce(F.regexp_extract("line", stat, i).try_cast("long"), F.lit(0).cast("long"))
    found = carried.where(F.col("line").rlike(stat) & F.col("h").isNotNull()).withColumn("path", F.regexp_extract("line", stat, 3)).where(~F.col("path").startswith('"'))
    return found.select("doc", "pos", "path", F.regexp_extract("h", head, 1).cast("long").alias("at"), F.regexp_extract("h", head, 2).alias("author"), number(1).alias("added"), number(2).alias("deleted"))


def unified_diff(df: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, file_no, path, hunk, added, removed) per hunk of unified diffs, one text a row.

    A text is read where it lies, line by line, so nothing is shuffled and a task holds one batch of texts.
    """
    prepare(df.sparkSession)
    kind = df.schema[doc].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # What ends a line for ``.`` and ``$`` of the JVM's regular expressions.
        named = re.compile("\\+\\+\\+ (?:b/)?([^\r\x85\u2028\u2029]*)[\r\x85\u2028\u2029]?\\Z")
        for batch in batches:
            docs, rows = [], []
            for i, whole in enumerate(batch.column(1).to_pylist()):
                file_no, path, hunk = 0, None, 0
                found: dict[tuple, list[int]] = {}
                for line in (whole or "").split("\n"):
                    if line.startswith("diff --git "):
                        file_no, path, hunk = file_no + 1, None, 0
                        continue
                    if not file_no:
                        continue
                    if line.startswith("@@ "):
                        hunk += 1
                        continue
                    if line.startswith("+++ "):
                        name = named.match(line)
                        path = name[1] if name else ""
                    if hunk:
                        count = found.setdefault((file_no, path, hunk), [0, 0])
                        if line.startswith("+"):
                            count[0] += 1
                        elif line.startswith("-"):
                            count[1] += 1
                docs += [i] * len(found)
                rows += [(*key, *count) for key, count in found.items()]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(docs, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc", "file_no", "path", "hunk", "added", "removed"])

    return df.select(F.col(doc).alias("doc"), F.col(text).alias("text")).mapInArrow(run, f"doc {kind}, file_no long, path string, hunk long, added long, removed long")


_LABEL = r"\[[^\]]*\]"
_PLACE = r"\(\s*<?([^\s>)]+)"
LINK = _LABEL + _PLACE + r">?[^)]*\)"


def links(text: Column) -> Column:
    """Targets of Markdown links, in order."""
    return F.regexp_extract_all(text, F.lit(LINK), F.lit(1))


def is_repo_link(target: Column) -> Column:
    """Neither empty, nor with a scheme, nor from the host's root; checked without query and fragment."""
    bare = F.regexp_replace(target, r"[#?].*$", "")
    return (bare != "") & ~bare.startswith("//") & ~bare.rlike(r"^[A-Za-z][-+.0-9A-Za-z]*:")


def resolve(path: Column) -> Column:
    """A relative path with ``.`` and ``..`` folded; what climbs out of the root keeps its ``..``."""
    start = F.array().cast("array<string>")

    def step(kept: Column, part: Column) -> Column:
        top = F.try_element_at(kept, F.lit(-1))
        pop = F.slice(kept, F.lit(1), F.size(kept) - 1)
        return F.when((part == "") | (part == "."), kept).when((part == "..") & top.isNotNull() & (top != ".."), pop).otherwise(F.array_append(kept, part))

    return F.array_join(F.aggregate(F.split(path, "/"), start, step), "/")


def sections(lines: DataFrame) -> DataFrame:
    """(doc, section, heading, first, lines): ATX headings outside code fences; section 0 is the preamble.

    Fences close by at least as many of the same character, a state that no regular expression
    keeps, so each document's lines pass one automaton; documents are independent.
    """

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("pos").to_pylist(), table.column("line").to_pylist(), strict=True))
        doc = table.column("doc")[0].as_py()
        out: list[list] = [[doc, 0, None, 0, 0]]
        fence = ""
        for pos, line in rows:
            mark = re.match(r"^[ ]{0,3}(~~~+|```+)(.*)$", line)
            if fence:
                if mark and mark[1][0] == fence[0] and len(mark[1]) >= len(fence) and not mark[2].strip():
                    fence = ""
            elif mark:
                fence = mark[1]
            elif head := re.match(r"^ {0,3}#{1,6}(?:[ \t]+(.*?))?[ \t]*#*[ \t]*$", line):
                out.append([doc, len(out), head[1] or "", pos, 0])
                continue
            out[-1][4] += 1
        columns = list(zip(*out, strict=True))
        kinds = [table.schema.field("doc").type, pa.int64(), pa.string(), pa.int64(), pa.int64()]
        return pa.table([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["doc", "section", "heading", "first", "lines"])

    kind = lines.schema["doc"].dataType.simpleString()
    return lines.groupBy("doc").applyInArrow(run, f"doc {kind}, section long, heading string, first long, lines long")


def json_rows(lines: DataFrame, schema: str) -> DataFrame:
    """Parsed JSON lines; those that can't be decoded are left out."""
    parsed = lines.withColumn("j", F.from_json("line", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    return parsed.where(F.col("j").isNotNull()).select("doc", "pos", "j.*")


SPLIT_COMMAND = r"[\s;|&<>()'\"]+"


def command_paths(command: Column, readers: tuple[str, ...] = ("cat", "head", "tail", "sed", "less", "grep", "rg")) -> Column:
    """Source paths that a shell command names, if it runs a reading tool."""
    words = F.filter(F.split(command, SPLIT_COMMAND), lambda w: w != "")
    reads = F.arrays_overlap(words, F.array(*map(F.lit, readers)))
    return F.when(reads, F.array_distinct(F.filter(words, lambda w: w.rlike(r"\.[cm]?[jt]sx?$")))).otherwise(F.array().cast("array<string>"))


def names_symbol(line: Column, symbol: str) -> Column:
    """Whether a line of a diff declares or uses the symbol as a whole word."""
    return line.rlike(r"^[ +-]") & line.rlike(r"(^|[^A-Za-z0-9_$])" + re.escape(symbol) + r"($|[^A-Za-z0-9_$])")


def transcripts(turns: DataFrame) -> DataFrame:
    """Per conversation: turns by role, distinct words, output characters, lines of results, and tool calls by name.

    ``turns``: conv_id, turn, role, text. Words that begin with ``the`` stand for tool names in the bound tables.
    """
    return turns.groupBy("conv_id").agg(
        F.count("*").alias("turns"), F.count_if(F.col("role") == "assistant").alias("steps"), F.coalesce(F.sum(F.when(F.col("role") == "assistant", F.length("text"))), F.lit(0)).alias("output_chars"),
        F.sum(F.size(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""))).alias("lines"), F.max("turn").alias("last_turn"),
    )


def walk(root: str) -> Iterator[str]:
    """Files below a folder on the driver, by name; for checkouts that are not in shared storage."""
    from pathlib import Path

    for p in sorted(Path(root).rglob("*")):
        if p.is_file():
            yield p.relative_to(root).as_posix()
