"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings that keep the plans adaptive: AQE sizes the shuffles, splits skewed
# join partitions and turns a join into a broadcast only when the measured size
# of a side is below the threshold. No operator in this package forces a
# broadcast, so that check always applies.
ADAPTIVE_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # A task sorts and hashes what it reads at ten to twenty times its compressed
    # size: small reads keep that constant while the tables grow.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m",
    "spark.sql.files.maxPartitionBytes": "16m",
    "spark.sql.session.timeZone": "UTC",
}


def build_session(app_name: str = "evospark", master: str | None = None, **conf: str) -> SparkSession:
    """Create (or reuse) a session with the adaptive settings applied."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**ADAPTIVE_SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def configure(spark: SparkSession) -> SparkSession:
    """Apply the adaptive settings to a session somebody else created."""
    for key, value in ADAPTIVE_SETTINGS.items():
        spark.conf.set(key, value)
    spark.conf.unset(INITIAL_PARTITIONS)  # see many_partitions
    return spark


INITIAL_PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def many_partitions(spark: SparkSession) -> SparkSession:
    """For queries of few, large shuffles: they start with more partitions than 8 GB takes, whatever the session
    has, as AQE merges partitions but doesn't cut them. Plans of very many small shuffles are slowed by it."""
    spark.conf.set(INITIAL_PARTITIONS, "1000")
    return spark


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """The session's settings while something is planned and run; then they are as before."""
    before = {k: spark.conf.get(k, None) for k in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


# The shuffle files of a write go when it ends, not when the driver happens to collect its garbage.
SHUFFLES_GO = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}

# Rows that repeat most of their text are many times larger in memory than in compressed files: while this holds, a
# join takes a stored table for small only if it is small in memory, too.
SIZES_IN_MEMORY = {"spark.sql.sources.fileCompressionFactor": "16"}


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local-mode session (tests) may fall back to a temporary folder; a
    cluster without the setting is an error, because a machine-local folder
    would be lost together with its executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and current is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="evospark-")
    if current is None:
        sc.setCheckpointDir(named)
    return named or current


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def spread(df: DataFrame) -> DataFrame:
    """Even partitions before costly row work; AQE sizes them and splits large ones."""
    return df.hint("rebalance")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the plan restarts from files, not from executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Scratch:
    """Intermediate tables of one run: compressed files below the shared folder, deleted at the end of its ``with``.
    Unlike ``cut_lineage``, which writes rows as they are in memory and leaves them and their shuffles behind."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self._kept = spark, scratch_path(spark, "scratch"), 0

    def keep(self, df: DataFrame) -> DataFrame:
        """The same rows; later work restarts from files."""
        path, self._kept = f"{self.root}/{self._kept}", self._kept + 1
        with settings(df.sparkSession, SHUFFLES_GO):
            df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
