"""Continuous intake of upload folders into a campaign store.

New files are picked up by a file stream that reads their names only, empty
files included; each micro-batch runs the batch flow on its files and commits
once. The commit records the stream and its batch number, so a batch that is
repeated after a failure changes nothing in any table.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from evospark.operators import qc
from evospark.plans import stored_flows
from evospark.sources import uploads
from evospark.sources.stores import CampaignStore

MAX_FILES = 1000
"""Files of one micro-batch, at most: as many names reach the driver."""


def upload_stream(spark: SparkSession, folder: str, max_files: int = MAX_FILES) -> DataFrame:
    """Stream of new upload files of any format: one row with the name of each; contents are not read."""
    files = spark.readStream.format("binaryFile").option("maxFilesPerTrigger", max_files).schema(
        "path string, modificationTime timestamp, length long, content binary").load(folder)
    return files.select(F.col("_metadata.file_path").alias("file_path"))


def start_intake(
    spark: SparkSession, folder: str, store: CampaignStore, experiment_of: Callable[[Column], Column], checkpoint: str,
    options: qc.QualityOptions = qc.QualityOptions(), max_files: int = MAX_FILES, **trigger,
) -> StreamingQuery:
    """Start merging new TSV, CSV and JSON uploads of ``folder`` into ``store`` (see ``stored_flows.store_files``).

    ``experiment_of`` turns the ``file_path`` column into the experiment id.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        here = CampaignStore(session, store.root, store.parts)
        # The stream's own id: a new checkpoint numbers its batches anew.
        stream = json.loads(session.read.text(f"{checkpoint}/metadata").first()[0])["id"]
        if here.head().applied((stream, batch_id)):
            return
        names = [r[0] for r in batch.select("file_path").distinct().collect()]  # at most max_files
        # A file stream has no rows for empty files: those of the folder that no commit has reported yet.
        empty = uploads.empty_files(session, f"{folder.rstrip('/')}/*")
        if empty:
            reported = here.read("upload_files").where(F.col("file_path").isin(empty)).select("file_path").collect()
            names += sorted(set(empty) - {r[0] for r in reported})
        if names:
            stored_flows.store_files(here, names, experiment_of, options, (stream, batch_id))

    return (
        upload_stream(spark, folder, max_files)
        .writeStream.foreachBatch(merge)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
