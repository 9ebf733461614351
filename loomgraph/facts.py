"""Fact relations as files: load, validate, save, merge, retire."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators import maintain
from loomgraph.schema import ENUMS, KEYS, SCHEMA_VERSION, SCHEMAS
from loomgraph.session import checkpoint

CHECKED = {"symbol": {"kind": "kind"}, "call_edge": {"attribution": "attribution", "provenance": "provenance"}, "reference_edge": {"kind": "reference_kind", "provenance": "provenance"}, "project": {"fidelity": "fidelity", "cause": "precondition"}, "unresolved_call": {"cause": "call_cause"}, "unresolved_specifier": {"cause": "precondition"}}


class Folder:
    """A folder on any file system that Spark reads, with a file that names its current version."""

    NAME, KEPT = "CURRENT", 2

    def __init__(self, spark: SparkSession, path: str):
        self._jvm, self.path = spark.sparkContext._jvm, path
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):  # noqa: ANN202
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def has(self, name: str) -> bool:
        return self._fs.exists(self._at(name))

    def names(self) -> list[str]:
        return sorted(x.getPath().getName() for x in self._fs.listStatus(self._at(""))) if self._fs.exists(self._at("")) else []

    def remove(self, name: str) -> None:
        self._fs.delete(self._at(name), True)

    def _versions(self) -> list[str]:
        if not self.has(self.NAME):
            return []
        stream = self._fs.open(self._at(self.NAME))
        try:
            return bytes(stream.readAllBytes()).decode().split()
        finally:
            stream.close()

    def current(self) -> str | None:
        return next(iter(self._versions()), None)

    def make_current(self, version: str) -> None:
        """Names a version, keeps the one before it for its readers, and removes older ones."""
        named = [version, *self._versions()]
        out = self._fs.create(self._at(self.NAME), True)
        try:
            out.write(bytearray("\n".join(named[: self.KEPT]).encode()))
        finally:
            out.close()
        for old in named[self.KEPT :]:
            self.remove(old)


def baselines(spark: SparkSession, root: str) -> DataFrame:
    """(commit_id, analysed_at) of the baselines below a folder; each has its own small header, which is all that is read."""
    rows = []
    for commit in Folder(spark, root).names():
        found = FactStore.load(spark, f"{root}/{commit}").meta.where("key = 'analysedAt'").first()
        rows.append((commit, found["value"] if found else None))
    return spark.createDataFrame(rows, "commit_id string, analysed_at string")


class FactStore:
    """Lazy relations of one index. Missing relations are empty, as an older index may lack them."""

    def __init__(self, spark: SparkSession, relations: dict[str, DataFrame]):
        self.spark = spark
        self.relations = relations

    def __getattr__(self, name: str) -> DataFrame:
        if name not in SCHEMAS:
            raise AttributeError(name)
        if name not in self.relations:
            self.relations[name] = self.spark.createDataFrame([], SCHEMAS[name])
        return self.relations[name]

    @classmethod
    def load(cls, spark: SparkSession, path: str, form: str = "parquet") -> FactStore:
        """Relations below a folder, as Parquet or JSON lines, read with their schemas: those of its current version, if it has versions."""
        folder = Folder(spark, path)
        path = f"{path}/{folder.current()}" if folder.current() else path
        there = [n for n in SCHEMAS if Folder(spark, path).has(n)]
        store = cls(spark, {n: spark.read.schema(SCHEMAS[n]).format(form).load(f"{path}/{n}") for n in there})
        version = store.meta.where("key = 'schemaVersion'").first() if "meta" in there else None
        if version and version["value"] != str(SCHEMA_VERSION):
            raise ValueError(f"index has schema {version['value']}, not {SCHEMA_VERSION}: derive it again")
        return store

    def save(self, path: str, form: str = "parquet", order: str | None = None) -> str:
        """Writes whole relations as a new version below a folder, and then names it the current one.

        A store that was loaded from the folder can be saved there, as the version that it reads stays until the
        next save. Rows are written as they are; with ``order``, relations that have that column keep the first or
        the last of equal keys, as their relation asks, and lose the column.
        """
        folder, version = Folder(self.spark, path), f"v-{uuid.uuid4().hex}"
        meta = self.meta.where("key <> 'schemaVersion'").union(self.spark.createDataFrame([("schemaVersion", str(SCHEMA_VERSION))], SCHEMAS["meta"]))
        for name in (self.relations | {"meta": meta}).keys():
            df = meta if name == "meta" else getattr(self, name)
            if order and order in df.columns and name in KEYS:
                df = self.deduplicated(name, order).drop(order)
            df.write.format(form).save(f"{path}/{version}/{name}")
        folder.make_current(version)
        return version

    def with_relation(self, name: str, df: DataFrame) -> FactStore:
        """The same facts but for one relation, which is replaced as a whole."""
        return FactStore(self.spark, dict(self.relations) | {name: df})

    def capture(self, root: str, commit: str, ancestors: DataFrame, cap: int, analysed_at: str) -> DataFrame:
        """Keeps a copy as the baseline of a commit below ``root``, evicts what is beyond the cap, and gives (commit_id, evicted).

        ``ancestors`` (commit_id) are the commits before this one: others leave first, then older ones.
        """
        if cap <= 0:
            return self.spark.createDataFrame([], "commit_id string, evicted boolean")
        self.with_relation("meta", self.meta.where("key <> 'analysedAt'").union(self.spark.createDataFrame([("analysedAt", analysed_at)], SCHEMAS["meta"]))).save(f"{root}/{commit}")
        held = baselines(self.spark, root)
        known = ancestors.select("commit_id").union(self.spark.createDataFrame([(commit,)], "commit_id string")).distinct()
        marked = held.join(known.withColumn("ancestor", F.lit(True)), "commit_id", "left").fillna(False, ["ancestor"])
        # There are as many rows as baselines are kept, and one.
        gone = {r["commit_id"] for r in maintain.evict(marked, cap).collect()}
        for name in gone:
            Folder(self.spark, root).remove(name)
        return held.select("commit_id", F.col("commit_id").isin(*sorted(gone)).alias("evicted") if gone else F.lit(False).alias("evicted"))

    def settled(self) -> FactStore:
        """The same facts, written to the shared folder, so that later passes don't compute them again."""
        return FactStore(self.spark, {n: checkpoint(df) for n, df in self.relations.items()})

    def faults(self) -> DataFrame:
        """(relation, column, value, n): values outside their closed lists."""
        out = self.spark.createDataFrame([], "relation string, column string, value string, n long")
        for name, columns in CHECKED.items():
            for column, enum in columns.items():
                bad = getattr(self, name).where(F.col(column).isNotNull() & ~F.col(column).isin(*ENUMS[enum]))
                out = out.union(bad.groupBy(column).agg(F.count("*").alias("n")).select(F.lit(name), F.lit(column), column, "n"))
        return out

    def deduplicated(self, name: str, order: str) -> DataFrame:
        keys, side = KEYS[name]
        return (maintain.keep_first if side == "first" else maintain.keep_last)(getattr(self, name), keys, order)

    def apply_wave(self, new: FactStore, gone: DataFrame) -> FactStore:
        """Facts after an incremental pass: those of gone or extracted files are replaced by the new ones."""
        extracted = new.file.select("path").union(gone.select("path")).distinct()
        by_path = {"file": "path", "symbol": "path", "declaration": "path", "call_edge": "path", "reference_edge": "path", "file_import": "from_path", "file_project": "path", "unresolved_call": "path", "unresolved_specifier": "path", "label": "node"}
        out = dict(self.relations)
        for name, key in by_path.items():
            out[name] = maintain.retire(getattr(self, name), extracted.withColumnRenamed("path", key), key).unionByName(getattr(new, name))
        return FactStore(self.spark, out)


#: Rounds in which importers follow files whose exports changed.
MOST_WAVES = 8


def repaired(facts: FactStore, walked: DataFrame, extract: Callable[[DataFrame], FactStore]) -> tuple[FactStore, DataFrame]:
    """Facts brought up to date with a walked tree, and (path, wave) of the files that were extracted again.

    Wave 0 is what drifted; of the files whose export shape then differs, importers follow in the next wave, each
    file once. Facts of deleted files go.
    """
    moved = checkpoint(maintain.drift(facts.file, walked, facts.seen_file))
    gone = moved.where("state = 'deleted'").select("path")
    pending = moved.where("state <> 'deleted'").select("path")
    done, now = None, facts
    for wave in range(MOST_WAVES + 1):
        if pending.isEmpty() and (wave or gone.isEmpty()):
            break
        before = now.file.select("path", F.col("export_shape_hash").alias("was"))
        new = extract(pending)
        shapes = checkpoint(new.file.select("path", "export_shape_hash").join(before, "path", "left"))
        reshaped = shapes.where("NOT (export_shape_hash <=> was)").select(F.col("path").alias("to_path"))
        users = now.file_import
        now = now.apply_wave(new, gone).settled()
        part = pending.withColumn("wave", F.lit(wave))
        done = checkpoint(part if done is None else done.union(part))
        leaving = reshaped.union(gone.select(F.col("path").alias("to_path"))) if not wave else reshaped
        pending = checkpoint(users.join(leaving.distinct(), "to_path", "left_semi").select(F.col("from_path").alias("path")).distinct().join(done, "path", "left_anti").join(gone, "path", "left_anti"))
        gone = gone.limit(0)
    nothing = moved.select("path", F.lit(0).alias("wave")).limit(0)
    seen = walked.select("path").union(facts.seen_file.select("path")).distinct().join(moved.where("state = 'deleted'").select("path"), "path", "left_anti")
    return now.with_relation("seen_file", checkpoint(seen)), nothing if done is None else done
