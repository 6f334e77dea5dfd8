"""Streams: documents of a folder to items as they arrive, and documents assembled from pages."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def document_stream(spark: SparkSession, path: str, schema: T.StructType, per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def tokens(stream: DataFrame, pattern: str) -> DataFrame:
    """Words of each document that match; stateless, so a stream gives what a batch gives."""
    return stream.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("value"))


def windowed_counts(stream: DataFrame, time: str, key: str, size: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    return stream.withWatermark(time, late).groupBy(F.window(time, size), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")


def assembled(pages: DataFrame) -> DataFrame:
    """Documents from pages (doc_id, page, pages, content) that arrive in any order: a document is emitted once, when all are there.
    State holds a document's pages only until then."""
    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        have = dict(zip(*state.get, strict=True)) if state.exists else {}
        total = 0
        for p in parts:
            have |= dict(zip(p["page"], p["content"], strict=True))
            total = int(p["pages"].iloc[0])
        if len(have) >= total:
            if state.exists:
                state.remove()
            yield pd.DataFrame([(key[0], len(have), "\n".join(have[k] for k in sorted(have)))], columns=["doc_id", "pages", "content"])
        else:
            state.update((list(have), list(have.values())))

    return pages.groupBy("doc_id").applyInPandasWithState(run, f"doc_id {dict(pages.dtypes)['doc_id']}, pages int, content string", "pages array<int>, contents array<string>", "append", GroupStateTimeout.NoTimeout)


def run_to_end(stream: DataFrame, into: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Processes what is there and stops; the checkpoint makes a restart go on where it ended."""
    q = stream.writeStream.foreachBatch(into).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
