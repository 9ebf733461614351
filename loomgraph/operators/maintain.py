"""Keeping derived facts up to date: drift, diffs, waves, upserts, baselines, continuations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgraph.operators.lookup import first_by
from loomgraph.session import checkpoint, sent, settled


def drift(indexed: DataFrame, walked: DataFrame, seen: DataFrame) -> DataFrame:
    """(path, state) of paths that moved: changed, deleted or added.

    Size and time that agree settle a file without its hash; a walked path counts as added only if
    the previous walk hadn't seen it either.
    """
    old = indexed.select("path", F.col("content_hash").alias("h0"), F.col("size").alias("s0"), F.col("mtime_ms").alias("t0"))
    new = walked.select("path", F.col("content_hash").alias("h1"), F.col("size").alias("s1"), F.col("mtime_ms").alias("t1"))
    both = old.join(new, "path", "full_outer").join(seen.select("path", F.lit(True).alias("seen")), "path", "left")
    same = ((F.col("s0") == F.col("s1")) & (F.col("t0") == F.col("t1"))) | (F.col("h0") == F.col("h1"))
    state = F.when(F.col("h1").isNull(), "deleted").when(F.col("h0").isNull(), F.when(F.col("seen").isNull(), "added")).when(~same, "changed")
    return both.select("path", state.alias("state")).where("state IS NOT NULL")


def snapshot_diff(base: DataFrame, head: DataFrame) -> DataFrame:
    """(path, change) by content hash."""
    both = base.select("path", F.col("content_hash").alias("h0")).join(head.select("path", F.col("content_hash").alias("h1")), "path", "full_outer")
    change = F.when(F.col("h0").isNull(), "added").when(F.col("h1").isNull(), "removed").when(F.col("h0") != F.col("h1"), "changed")
    return both.select("path", change.alias("change")).where("change IS NOT NULL")


def upsert(old: DataFrame, new: DataFrame, key: str = "path") -> DataFrame:
    """Old rows of keys that the new rows don't have, and the new rows."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def retire(facts: DataFrame, gone: DataFrame, key: str = "path") -> DataFrame:
    return facts.join(gone.select(key).distinct(), key, "left_anti")


def keep_first(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Insert-or-ignore: the earliest row of each key."""
    return first_by(df, keys, [F.col(order).asc()])


def keep_last(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Insert-or-replace: the latest row of each key."""
    return first_by(df, keys, [F.col(order).desc()])


def joined_hash(parts: Column, separator: str = "|") -> Column:
    """SHA-256 of sorted parts; equal for equal sets of parts in any order."""
    return F.sha2(F.array_join(F.array_sort(parts), separator), 256)


def wave(imports: DataFrame, seed: DataFrame, reshaped: Callable[[DataFrame], DataFrame], most: int = 8) -> DataFrame:
    """(path, wave): files to extract again. Importers follow of files whose export shape moved, up to ``most`` waves."""
    imports = settled(imports.select("from_path", "to_path"), "imports")
    visited = pending = checkpoint(seed.select("path").distinct().withColumn("wave", F.lit(0)))
    for w in range(1, most + 1):
        # The files that moved are sent to the imports where they are few, so that no wave moves all imports.
        moved = sent(checkpoint(reshaped(pending.select("path")).select(F.col("path").alias("to_path")).distinct()))
        users = imports.join(moved, "to_path", "left_semi").select(F.col("from_path").alias("path")).distinct()
        pending = checkpoint(users.join(visited.select("path"), "path", "left_anti").withColumn("wave", F.lit(w)))
        if pending.isEmpty():
            break
        visited = visited.unionByName(pending)
    return visited


def choose_baseline(baselines: DataFrame, commit: str) -> DataFrame:
    """The baseline of the commit itself, else the newest of an ancestor. Columns: commit_id, analysed_at, ancestor."""
    exact = F.col("commit_id") == commit
    return baselines.where(exact | F.col("ancestor")).orderBy(exact.desc(), F.col("analysed_at").desc_nulls_last(), "commit_id").limit(1)


def evict(baselines: DataFrame, cap: int) -> DataFrame:
    """Baselines beyond the cap: ancestors are kept first, newer before older."""
    kept = baselines.orderBy(F.col("ancestor").desc(), F.col("analysed_at").desc_nulls_last(), "commit_id").limit(cap)
    return baselines.join(F.broadcast(kept.select("commit_id")), "commit_id", "left_anti")


SIGNALS = ("installed", "postinstall", "lockfile", "options", "globbing", "declarations")


def measure(stored: DataFrame, observed: DataFrame, key: str) -> DataFrame:
    """(key, signal, agrees): one row per signal, in order; a column per signal on both sides."""
    s = stored.select(key, *[F.col(c).alias(f"s_{c}") for c in SIGNALS])
    o = observed.select(key, *[F.col(c).alias(f"o_{c}") for c in SIGNALS])
    rows = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(c).alias("signal"), F.col(f"s_{c}").eqNullSafe(F.col(f"o_{c}")).alias("agrees")) for i, c in enumerate(SIGNALS)])
    return s.join(o, key).select(key, F.inline(rows))


RANKS = ("content-hash", "path-prefix-rewrite", "git-rename", "name-in-head")


def continuation(candidates: DataFrame, cap: int = 10) -> DataFrame:
    """(subject, id, derivations, place, withheld): where a vanished subject may live on.

    Candidates of one id merge; they are ordered by their derivations' ranks compared one by one,
    of equal beginnings the longer list first, then by id.
    """
    rank = F.array_position(F.array(*map(F.lit, RANKS)), F.col("derivation")).cast("int")
    merged = candidates.groupBy("subject", "id").agg(F.array_sort(F.collect_set(rank)).alias("ranks"))
    padded = F.concat(F.col("ranks"), F.array_repeat(F.lit(99), len(RANKS)))
    order = Window.partitionBy("subject").orderBy(padded, "id")
    total = F.count("*").over(Window.partitionBy("subject"))
    names = F.transform("ranks", lambda r: F.element_at(F.array(*map(F.lit, RANKS)), r))
    ranked = merged.select("subject", "id", F.array_join(names, ",").alias("derivations"), F.row_number().over(order).cast("long").alias("place"), F.greatest(total - cap, F.lit(0)).alias("withheld"))
    return ranked.where(F.col("place") <= cap)


def rename_sweep(renames: DataFrame) -> DataFrame:
    """Renames of one commit that go between the same two folders as another. Columns: commit_id, old_path, new_path."""
    folder = lambda c: F.regexp_replace(c, r"/?[^/]*$", "")
    placed = renames.withColumns({"old_dir": folder("old_path"), "new_dir": folder("new_path")})
    many = placed.groupBy("commit_id", "old_dir", "new_dir").agg(F.count("*").alias("n")).where("n > 1 AND old_dir <> new_dir")
    return placed.join(many, ["commit_id", "old_dir", "new_dir"]).select("commit_id", "old_path", "new_path", "old_dir", "new_dir", "n")
