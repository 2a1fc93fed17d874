"""A campaign store: several tables that change together, one experiment bucket at a time.

Every table is dealt to ``parts`` buckets by its experiment and written as
Parquet folders that never change. A commit writes the buckets it touches anew,
then a manifest that names, for *every* table, the folder of every bucket.
The manifest comes last and appears in one step, so a reader sees all tables of
a commit or none, buckets of other experiments keep their files, and of two
writers that started from one version the second one fails.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Collection
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evospark.session import SHUFFLES_GO, settings
from evospark.sources.snapshots import merge_snapshot

PARTS = 256
"""Buckets of a new store; a manifest has this many folders per table at most."""

FEW_PARTS = 16
"""Stores of up to this many buckets are written as the rows lie: a task adds one file to a bucket at most."""


class CommitConflict(RuntimeError):
    """Another writer committed the version after the one this change was computed from."""


@dataclass(frozen=True)
class Version:
    """What one manifest names."""

    number: int = 0
    parts: int = PARTS
    schemas: dict[str, str] = field(default_factory=dict)  # table -> schema as JSON
    folders: dict[str, dict[int, str]] = field(default_factory=dict)  # table -> bucket -> folder
    batches: dict[str, int] = field(default_factory=dict)  # stream -> last batch applied

    def applied(self, batch: tuple[str, int] | None) -> bool:
        """Whether the batch (stream, number) is part of this version. Numbers of a stream only grow."""
        return batch is not None and self.batches.get(batch[0], -1) >= batch[1]


class CampaignStore:
    """Tables below ``root``, a folder that the driver and all executors reach."""

    def __init__(self, spark: SparkSession, root: str, parts: int = PARTS):
        self.spark, self.root, self.parts = spark, root.rstrip("/"), parts
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, below: str):
        return self._hadoop.Path(f"{self.root}/{below}" if below else self.root)

    def _names(self, below: str) -> list[str]:
        path = self._path(below)
        return [s.getPath().getName() for s in self._fs.listStatus(path)] if self._fs.exists(path) else []

    # --- versions -------------------------------------------------------------

    def numbers(self) -> list[int]:
        """Committed versions, oldest first."""
        return sorted(int(n.removesuffix(".json")) for n in self._names("_commits") if n.endswith(".json"))

    def head(self) -> Version:
        """The newest version; an empty one for a new store."""
        numbers = self.numbers()
        return self.version(numbers[-1]) if numbers else Version(parts=self.parts)

    def version(self, number: int) -> Version:
        stream = self._fs.open(self._path(f"_commits/{number:012d}.json"))
        try:
            found = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        found["folders"] = {t: {int(k): p for k, p in parts.items()} for t, parts in found["folders"].items()}
        return Version(**found)

    # --- reading --------------------------------------------------------------

    def part_of(self, experiment: Column, version: Version) -> Column:
        return F.pmod(F.xxhash64(experiment.cast("bigint")), F.lit(version.parts)).cast("int")

    def parts_of(self, rows: DataFrame, version: Version) -> set[int]:
        """Buckets of the experiments in ``rows`` (at most ``parts`` numbers)."""
        return {r[0] for r in rows.select(self.part_of(F.col("experiment_id"), version).alias("p")).distinct().collect()}

    def read(self, table: str, version: Version | None = None, parts: Collection[int] | None = None) -> DataFrame:
        """A table as of a version (the newest by default), of all or only the given buckets."""
        version = version or self.head()
        if table not in version.schemas:
            raise KeyError(f"no table {table} in version {version.number}")
        schema = T.StructType.fromJson(json.loads(version.schemas[table]))
        folders = [f"{self.root}/{p}" for k, p in sorted(version.folders[table].items()) if parts is None or k in parts]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    # --- writing --------------------------------------------------------------

    def _placed(self, rows: DataFrame, version: Version) -> DataFrame:
        """``rows`` with their bucket. Where a task could write many buckets, the rows are dealt by bucket first;
        AQE then splits large ones over tasks. Few buckets are not worth shuffling every row once more."""
        placed = rows.withColumn("part", self.part_of(F.col("experiment_id"), version))
        return placed if version.parts <= FEW_PARTS else placed.hint("rebalance", "part")

    def commit(self, base: Version, changes: dict[str, DataFrame], parts: Collection[int] | None = None,
               batch: tuple[str, int] | None = None) -> Version:
        """The version after ``base``: in every table of ``changes`` the given buckets (all of them by default)
        hold exactly the rows of its frame; everything else stays. Every frame has ``experiment_id``.

        Raises ``CommitConflict``, and changes nothing a reader sees, when ``base`` is no longer the newest version.
        """
        schemas, folders = dict(base.schemas), {t: dict(f) for t, f in base.folders.items()}
        run = uuid.uuid4().hex
        for table, rows in changes.items():
            below = f"{table}/run={run}"
            with settings(rows.sparkSession, SHUFFLES_GO):
                self._placed(rows, base).write.partitionBy("part").option("compression", "zstd").parquet(f"{self.root}/{below}")
            written = {int(n.removeprefix("part=")): f"{below}/{n}" for n in self._names(below) if n.startswith("part=")}
            if parts is not None and not written.keys() <= set(parts):
                raise ValueError(f"{table} has rows outside the buckets it was to change")
            kept = {k: p for k, p in folders.get(table, {}).items() if parts is not None and k not in parts}
            folders[table] = kept | written
            schemas[table] = rows.schema.json()
        batches = base.batches | ({batch[0]: batch[1]} if batch else {})
        return self._publish(Version(base.number + 1, base.parts, schemas, folders, batches))

    def _publish(self, version: Version) -> Version:
        """Write the manifest under a name of its own, then give it the version's name if that is still free."""
        draft = self._path(f"_commits/.{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        try:
            out.write(bytearray(json.dumps(version.__dict__).encode()))
        finally:
            out.close()
        rename = getattr(self._hadoop, "Options$Rename")
        context = self._hadoop.FileContext.getFileContext(draft.toUri(), self.spark._jsc.hadoopConfiguration())
        try:  # without OVERWRITE: fails if the name is taken
            context.rename(draft, self._path(f"_commits/{version.number:012d}.json"), self.spark.sparkContext._gateway.new_array(rename, 0))
        except Py4JJavaError as exc:
            self._fs.delete(draft, False)
            if "FileAlreadyExistsException" in str(exc.java_exception.getClass().getName()):
                raise CommitConflict(f"version {version.number} of {self.root} exists already") from exc
            raise
        return version

    def merge(self, table: str, rows: DataFrame, keys: Collection[str], policy: str = "latest",
              base: Version | None = None) -> Version:
        """Merge rows into one table (see ``merge_snapshot``); only the buckets of their experiments are read and written."""
        base = base or self.head()
        parts = self.parts_of(rows, base)
        if not parts:
            return base
        return self.commit(base, {table: merge_snapshot(self.read(table, base, parts), rows, list(keys), policy)}, parts)

    def purge(self, experiments: DataFrame, base: Version | None = None) -> Version:
        """Remove the rows of the given experiments from every table but ``experiments`` itself."""
        base = base or self.head()
        parts = self.parts_of(experiments, base)
        gone = experiments.select("experiment_id").distinct()
        tables = [t for t in base.schemas if t != "experiments" and base.folders[t].keys() & parts]
        if not tables:
            return base
        return self.commit(base, {t: self.read(t, base, parts).join(gone, "experiment_id", "left_anti") for t in tables}, parts)

    def vacuum(self, keep: int = 2) -> int:
        """Forget all but the newest ``keep`` versions and delete run folders that none of them names (the
        leftovers of crashed and lost commits too). Only when no writer is at work. Returns the folders deleted."""
        numbers = self.numbers()
        for number in numbers[:-keep]:
            self._fs.delete(self._path(f"_commits/{number:012d}.json"), False)
        used = {p.rsplit("/", 1)[0] for n in numbers[-keep:] for f in self.version(n).folders.values() for p in f.values()}
        deleted = 0
        for table in self._names(""):
            for run in self._names(table) if table != "_commits" else []:
                if f"{table}/{run}" not in used:
                    self._fs.delete(self._path(f"{table}/{run}"), True)
                    deleted += 1
        return deleted
