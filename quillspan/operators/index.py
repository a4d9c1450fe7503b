"""The inverted index as flat tables: postings, terms, corpus statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from ..functions.analysis import bigrams
from ..functions.lexicon import END, Parameters
from ..sources.corpus import kept
from .ranking import hits as counted

P = Parameters()


def tokens(docs: DataFrame) -> DataFrame:
    """(doc_id, term, in_title, in_body), one row for each occurrence.

    Documents are dealt by id first: what follows groups by document and finds its rows together.
    """
    own = docs.select("doc_id", "title_tokens", "body_tokens").repartition("doc_id")
    def field(name: str):
        here = [F.lit(int(name == f)).alias(f"in_{f}") for f in ("title", "body")]
        return F.transform(f"{name}_tokens", lambda t: F.struct(t.alias("term"), *here))

    marked = F.concat(field("title"), field("body"))
    return own.select("doc_id", F.explode(marked).alias("x")).select("doc_id", "x.*")


def postings(docs: DataFrame, p: Parameters = P) -> DataFrame:
    """(term, doc_id, tf, weight, relative, augmented, logarithm, dl); dl is the document's length in words."""
    by_doc = Window.partitionBy("doc_id")
    counts = tokens(docs).groupBy("doc_id", "term").agg(F.count("*").alias("tf"), F.max("in_title").alias("it"), F.max("in_body").alias("ib"))
    counts = counts.withColumns({"max_tf": F.max("tf").over(by_doc), "size": F.sum("tf").over(by_doc)})
    return counts.select(
        "term", "doc_id", "tf", (F.col("it") * p.title_weight + F.col("ib") * p.body_weight).alias("weight"),
        (F.col("tf") / F.col("size")).alias("relative"), (0.5 + 0.5 * F.col("tf") / F.col("max_tf")).alias("augmented"), (1 + F.log("tf")).alias("logarithm"), F.col("size").alias("dl"),
    )


#: Words that a task counts at once.
CHUNK = 1_000_000


def postings_of_unique(docs: DataFrame, p: Parameters = P) -> DataFrame:
    """The same for documents of which no two have one id: each is counted where it is read, and no word is shuffled for it."""
    def counted(ids: pa.Array, fields: list[pa.Array]) -> pa.RecordBatch:
        lengths = [f.value_lengths().fill_null(0).to_numpy(zero_copy_only=False) for f in fields]
        doc = np.concatenate([np.repeat(np.arange(len(ids)), n) for n in lengths])
        words = pa.concat_arrays([f.flatten() for f in fields]).dictionary_encode()
        term = words.indices.to_numpy().astype(np.int64)
        size_of = max(1, len(words.dictionary))
        keys, inverse, tf = np.unique(doc * size_of + term, return_inverse=True, return_counts=True)
        in_title = np.bincount(inverse, np.arange(len(doc)) < lengths[0].sum(), len(keys)) > 0
        in_body = np.bincount(inverse, np.arange(len(doc)) >= lengths[0].sum(), len(keys)) > 0
        own = keys // size_of
        dl = np.bincount(doc, minlength=len(ids))[own]
        most = np.zeros(len(ids), np.int64)
        np.maximum.at(most, own, tf)
        columns = [words.dictionary.take(pa.array(keys % size_of)), ids.take(pa.array(own)), tf, in_title * p.title_weight + in_body * p.body_weight, tf / dl, 0.5 + 0.5 * tf / most[own], 1 + np.log(tf), dl]
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names)

    def all_counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, *fields = b.columns
            done = np.cumsum(sum(f.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for f in fields))
            i = 0
            while i < len(ids):
                j = max(i + 1, int(np.searchsorted(done, (done[i - 1] if i else 0) + CHUNK, "right")))
                yield counted(ids[i:j], [f[i:j] for f in fields])
                i = j

    kinds = {"term": StringType(), "doc_id": docs.schema["doc_id"].dataType, "tf": LongType()} | dict.fromkeys(("weight", "relative", "augmented", "logarithm"), DoubleType()) | {"dl": LongType()}
    names = list(kinds)
    return docs.select("doc_id", "title_tokens", "body_tokens").mapInArrow(all_counted, StructType([StructField(n, k) for n, k in kinds.items()]))


def max_tf(docs: DataFrame) -> DataFrame:
    return tokens(docs).groupBy("doc_id", "term").agg(F.count("*").alias("tf")).groupBy("doc_id").agg(F.max("tf").alias("max_tf"), F.count("*").alias("distinct_terms"))


def corpus_stats(docs: DataFrame) -> DataFrame:
    """One row: the number of documents, those without words among them, and their mean length."""
    return docs.agg(F.countDistinct("doc_id").alias("n"), F.avg(F.col("title_len") + F.col("body_len")).alias("avdl"))


def terms(own: DataFrame, stats: DataFrame) -> DataFrame:
    """(term, df, cf, idf, prob_idf) over all postings; prob_idf is null for a term of all documents."""
    counts = own.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
    n = F.col("n")
    counts = counts.crossJoin(F.broadcast(stats.select("n")))  # one row
    return counts.select("term", "df", "cf", F.log((1 + n) / F.col("df")).alias("idf"), F.when(F.col("df") < n, F.log((n - F.col("df")) / F.col("df"))).alias("prob_idf"))


def major(all_terms: DataFrame, p: Parameters = P) -> DataFrame:
    """Terms that are frequent enough to stay; statistics are those of before."""
    return all_terms.where(F.col("cf") > p.minor)


def frequent(unigrams: DataFrame, p: Parameters = P) -> DataFrame:
    """(term) of ``major``, from the unigrams of the same documents, which count the ends of fields too."""
    return unigrams.where((F.col("c") > p.minor) & (F.col("word") != END)).select(F.col("word").alias("term"))


def surviving(own: DataFrame, all_terms: DataFrame, p: Parameters = P) -> DataFrame:
    """One row: the words of terms that stay, and the documents that have any of them."""
    stay = own.join(major(all_terms, p).select("term"), "term", "left_semi")
    return stay.agg(F.sum("tf").alias("total_terms"), F.countDistinct("doc_id").alias("docs_with_terms"))


def minor(all_terms: DataFrame, p: Parameters = P) -> DataFrame:
    return all_terms.where(F.col("cf") <= p.minor)


def bigram_postings(docs: DataFrame) -> DataFrame:
    """(term, doc_id, tf) of pairs within one field."""
    pairs = docs.select("doc_id", F.explode(F.concat(bigrams(F.col("title_tokens")), bigrams(F.col("body_tokens")))).alias("term"))
    return pairs.groupBy("term", "doc_id").agg(F.count("*").alias("tf"))


def bigram_terms(own: DataFrame, stats: DataFrame) -> DataFrame:
    return terms(own, stats).drop("prob_idf")


def token_postings(own: DataFrame, token: str, count: int | None = None, by: str = "tf") -> DataFrame:
    """A token's postings, most frequent first."""
    rows = own.where(F.col("term") == token).orderBy(F.desc(by), "doc_id")
    return rows if count is None else rows.limit(count)


def matching_docs(queries: DataFrame, own: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(qid, hits): documents with any of a query's terms, for queries (qid, tokens)."""
    words = kept(queries.select("qid", F.explode(F.array_distinct("tokens")).alias("term")).join(vocabulary.select("term"), "term", "left_semi"), "terms")
    hits = counted(words, own)
    return queries.select("qid").join(hits, "qid", "left").select("qid", F.coalesce("hits", F.lit(0)).alias("hits"))
