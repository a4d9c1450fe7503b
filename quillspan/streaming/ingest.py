"""Documents of a folder of tables as a stream of docs, each file once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources.corpus import parse_texts


def stream_texts(spark: SparkSession, path: str) -> DataFrame:
    """docs of texts (doc_id, text) that arrive as Parquet files in the folder."""
    return parse_texts(spark.readStream.schema("doc_id long, text string").parquet(path))


def append_docs(docs: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write what has come to the docs table at path, and end; a later call goes on from there."""
    return docs.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
