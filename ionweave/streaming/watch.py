"""Searches query files as they arrive in a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ionweave.config import SearchConfig
from ionweave.plans.search import search
from ionweave.schema import SPECTRUM


def watch(library: DataFrame, folder: str, out: str, checkpoint: str, cfg: SearchConfig, files_per_batch: int = 50) -> StreamingQuery:
    """Every new Parquet file of spectra under ``folder`` is searched once; matches are appended to ``out``."""
    spark = library.sparkSession

    def one(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            search(batch, library, cfg).write.mode("overwrite").parquet(f"{out}/batch={number}")  # a repeated batch replaces itself

    stream = spark.readStream.schema(SPECTRUM).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
