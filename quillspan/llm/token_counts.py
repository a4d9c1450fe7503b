"""Token counts with a digest cache.

Each distinct content is encoded once per tokenizer version.  A content is the text
as the tokenizer's own normaliser leaves it, special strings apart, which it does
not normalise: texts of equal contents have equal counts.  A cache table maps
(content digest, tokenizer digest) to a count; a run joins its contents with the
table, encodes the distinct ones that are missing, appends these, and reads all
counts from the table.

Defined results: a null text counts as the empty one (no tokens); equal texts
share one entry; repeated rows each get their count; an empty table gives an
empty result; columns besides the id and the text are left alone and dropped.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import claim, exists, map_batches, shared_folder, text_key, text_of, written
from .tokens import ChunkEncoder, tokenizer_path, tokenizer_version

CACHE_SCHEMA = "digest binary, tokenizer string, n_tokens long"
#: Chunks of texts that a worker's encoder keeps.
CHUNKS = 400_000
_encoders: dict[str, ChunkEncoder] = {}


def encoder(name: str, spaced: bool) -> ChunkEncoder:
    """One encoder for each Python worker: workers serve many tasks."""
    claim("encoder", _encoders.clear)
    if name not in _encoders:
        _encoders.clear()
        _encoders[name] = ChunkEncoder(name, spaced, limit=CHUNKS)
    return _encoders[name]


def content_of(name: str):
    """A function that gives the content of a text; none where the tokenizer takes texts as they are."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path(name))
    if library.normalizer is None:
        return None
    special = sorted((t.content for t in library.get_added_tokens_decoder().values()), key=len, reverse=True)
    parted = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None

    def content(text: str) -> str:
        parts = parted.split(text) if parted else [text]
        return "\0".join(x if i % 2 else library.normalizer.normalize_str(x) for i, x in enumerate(parts))

    return content


def with_digest(rows: DataFrame, name: str) -> DataFrame:
    """rows (doc_id, text, n_bytes) with the digest of each content."""
    if content_of(name) is None:
        return rows.withColumn("digest", text_key(F.col("text")))

    def make():
        content = content_of(name)

        def run(cols):
            return cols | {"digest": [hashlib.md5(content(t).encode()).digest() for t in cols["text"]]}

        return run

    return map_batches(rows, make, ", ".join(f"{n} {t}" for n, t in rows.dtypes) + ", digest binary")


def read_cache(spark, path: str) -> DataFrame:
    if not exists(spark, path):
        return spark.createDataFrame([], CACHE_SCHEMA)
    return spark.read.schema(CACHE_SCHEMA).parquet(path)


def encode_misses(contents: DataFrame, tokenizer: str, version: str) -> DataFrame:
    """(digest, text) to cache rows."""

    def make():
        enc = encoder(tokenizer, spaced=True)

        def run(cols):
            counts = [len(ids) // 4 for ids in enc.encode(cols["text"])]
            return {"digest": cols["digest"], "tokenizer": [version] * len(counts), "n_tokens": counts}

        return run

    return map_batches(contents.select("digest", "text"), make, CACHE_SCHEMA)


def token_counts(docs: DataFrame, tokenizer: str, cache: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens) of every row; the cache at path ``cache`` grows by the misses."""
    spark, version = docs.sparkSession, tokenizer_version(tokenizer)
    text = text_of(text_col)
    rows = with_digest(docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes")), tokenizer)
    known = read_cache(spark, cache).where(F.col("tokenizer") == version).select("digest")
    misses = rows.groupBy("digest").agg(F.first("text").alias("text")).join(known, "digest", "left_anti")
    encode_misses(misses, tokenizer, version).write.mode("append").parquet(cache)
    # runs side by side may both append an entry: they agree, and one is read
    counts = read_cache(spark, cache).where(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    counts = written(counts, "counts")  # as a table of its own, so that the join may split a content that a third of all rows have
    return rows.drop("text").join(counts, "digest").select("doc_id", "n_bytes", "n_tokens")


def op10_token_counts(spark, sf_dir: str, tokenizer: str = "byte_bpe_50k.json", limit: int = 1024) -> DataFrame:
    """The cache lies in the shared folder, one for each input folder."""
    cache = f"{shared_folder(spark)}/token-cache-{hashlib.sha256(sf_dir.encode()).hexdigest()[:16]}"
    counts = token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer, cache)
    return counts.withColumn("over_limit", F.col("n_tokens") > limit)
