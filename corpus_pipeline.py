"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; it is written as
Parquet, and the next one reads it.  All but the last keep documents' columns.
Every stage works on all that its predecessor kept.

The quality model is fitted on labelled rows of the input folder.  Fitting,
alignment and packing are not SQL: tests hold each stage against a plain
version instead, and ORACLE_SQL is None.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm import decontaminate, line_dedup, mil, ngram_join, packing
from quillspan.llm.common import written

#: Scores below it are rejected.
QUALITY = 0.3
#: Lines on so many sites are boilerplate.
MIN_SITES = 10
#: Near duplicates: words in an n-gram, and similarity.
NGRAM, SIMILARITY = 5, 0.8
#: Share of the best alignment score at which a text holds a benchmark item.
LEAK = 0.5
TOKENIZER, CAPACITY, END_ID = "word_bpe_49k.json", 4096, 1


def quality(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    model = mil.train(*mil.tables(spark, sf_dir))
    kept = mil.score(docs, model, *docs.columns, name="_quality").where(F.col("_quality") >= QUALITY)
    return kept.select(*docs.columns)


def lines(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many sites share go from every text."""
    docs = line_dedup.remove_boilerplate(docs, "source", MIN_SITES)
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def near_duplicates(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return ngram_join.one_of_each(docs, SIMILARITY, NGRAM)


def benchmark(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), threshold=LEAK)


def sequences(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all documents' pieces in training sequences."""
    return packing.pack(docs, TOKENIZER, CAPACITY, END_ID)


STAGES = [("quality", quality), ("line dedup", lines), ("n-gram join", near_duplicates), ("decontamination", benchmark), ("packing", sequences)]
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
