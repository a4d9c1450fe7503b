"""Ranking: each ranker gives what one posting adds to a document's score; sums and the top are common to all."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from ..functions.lexicon import Parameters
from ..sources.corpus import FEW_ROWS, kept, lookup

TF = {"r": "relative", "a": "augmented", "l": "logarithm"}
IDF = {"n": "idf", "p": "prob_idf"}
P = Parameters()


class Ranker(Protocol):
    def contribution(self) -> Column: ...


class TfIdf:
    def __init__(self, tf_type: str = "r", idf_type: str = "n"):
        self.tf, self.idf = TF[tf_type], IDF[idf_type]

    def contribution(self) -> Column:
        return F.col(self.tf) * F.col(self.idf) * F.col("weight")


class Bm25:
    def __init__(self, p: Parameters = P):
        self.p = p

    def contribution(self) -> Column:
        norm = self.p.k1 * (1 - self.p.b + self.p.b * F.col("dl") / F.col("avdl"))
        return F.col("prob_idf") * F.col("tf") * (self.p.k1 + 1) / (F.col("tf") + norm) * F.col("weight")


def query_terms(queries: DataFrame) -> DataFrame:
    """(qid, term, qtf) of queries (qid, tokens): a repeated word counts repeatedly."""
    return queries.select("qid", F.explode("tokens").alias("term")).groupBy("qid", "term").agg(F.count("*").alias("qtf"))


def scores(queries: DataFrame, ranker: Ranker, postings: DataFrame, terms: DataFrame, stats: DataFrame) -> DataFrame:
    """(qid, doc_id, score), summed over a query's words.

    The batch's words go to the postings where they are few; beyond that the join
    is one that Spark may split at a word of many postings.
    """
    words = lookup(query_terms(queries).join(terms.select("term", "idf", "prob_idf"), "term"), "query-terms")
    rows = postings.join(words, "term")
    if isinstance(ranker, Bm25):
        rows = rows.crossJoin(F.broadcast(stats.select("avdl")))  # one row
    return rows.groupBy("qid", "doc_id").agg(F.round(F.sum(F.col("qtf") * ranker.contribution()), 6).alias("score")).where(F.col("score").isNotNull())


def best(queries: DataFrame, ranker: Ranker, postings: DataFrame, terms: DataFrame, stats: DataFrame, count: int = P.results) -> DataFrame:
    """(qid, doc_id, score, rank): the top of ``scores``, without its rows of all pairs."""
    words = query_terms(queries).join(terms.select("term", "idf", "prob_idf"), "term")
    rows = postings.join(lookup(words.select("term", "idf", "prob_idf").distinct(), "own-terms"), "term")
    if isinstance(ranker, Bm25):
        rows = rows.crossJoin(F.broadcast(stats.select("avdl")))  # one row
    rows = rows.select("term", "doc_id", ranker.contribution().alias("x"))
    return leaders(words.select("qid", "term", F.col("qtf").cast("double").alias("y")), rows, count, otherwise=lambda _: scores(queries, ranker, postings, terms, stats))


def best_cosine(queries: DataFrame, units: DataFrame, terms: DataFrame, count: int = P.results) -> DataFrame:
    """(qid, doc_id, score, rank): the top of ``cosine_of``."""
    words = query_terms(queries).join(terms.select("term", "idf"), "term").select("qid", "term", F.col("idf").alias("y"))
    return leaders(words, units.select("term", "doc_id", F.col("u").alias("x")), count, True, lambda _: cosine_of(queries, units, terms))


def cosine(queries: DataFrame, postings: DataFrame, terms: DataFrame, tf_type: str = "r") -> DataFrame:
    """(qid, doc_id, score): the angle between a document's weights over the vocabulary and the query's idf."""
    return cosine_of(queries, doc_units(doc_weights(postings, terms, tf_type)), terms)


def cosine_of(queries: DataFrame, units: DataFrame, terms: DataFrame) -> DataFrame:
    """The same from documents' vectors of length 1 (doc_id, term, u), as they are stored: one join with the batch's words."""
    words = lookup(query_terms(queries).join(terms.select("term", "idf"), "term").select("qid", "term", F.col("idf").alias("y")), "query-terms")
    sizes = words.groupBy("qid").agg(F.sqrt(F.sum(F.col("y") * F.col("y"))).alias("size"))
    dots = units.join(words, "term").groupBy("qid", "doc_id").agg(F.sum(F.col("u") * F.col("y")).alias("dot"))
    return dots.join(sizes, "qid").select("qid", "doc_id", F.round(F.try_divide(F.col("dot"), F.col("size")), 6).alias("score"))


def top(scored: DataFrame, count: int = P.results) -> DataFrame:
    """The best documents of each query with their rank; equal scores go by document id."""
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= count)


def rounded(x: np.ndarray) -> np.ndarray:
    """x to six places, halves away from zero, as F.round has it: by the shortest decimal form where a half is near."""
    y = np.abs(x) * 1e6
    low = np.floor(y)
    out = np.copysign(np.floor(y + 0.5) / 1e6, x)
    for i in np.flatnonzero(np.abs(y - low - 0.5) < 1e-6 + y * 1e-15):
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal("0.000001"), ROUND_HALF_UP))
    return out


#: Products that a task holds at once.
CHUNK = 2_000_000


class Batch:
    """A batch's words (qid, term, y) on the driver, as lists of queries by term."""

    def __init__(self, words: DataFrame):
        self.spark, self.qid_type = words.sparkSession, words.schema["qid"].dataType
        rows = words.select("qid", "term", "y").collect()
        self.qids = list(dict.fromkeys(r.qid for r in rows))
        self.terms = list(dict.fromkeys(r.term for r in rows))
        q_of, t_of = ({x: i for i, x in enumerate(xs)} for xs in (self.qids, self.terms))
        t = np.array([t_of[r.term] for r in rows], np.int64)
        order = np.argsort(t, kind="stable")
        self.query = np.array([q_of[r.qid] for r in rows], np.int64)[order]
        self.y = np.array([r.y for r in rows], np.float64)[order]
        self.start = np.searchsorted(t[order], np.arange(len(self.terms) + 1))

    def met(self, rows: DataFrame) -> DataFrame:
        """rows (term, doc_id, ...) of the batch's terms, a document's together, with the term's number ix."""
        numbers = F.broadcast(self.spark.createDataFrame(list(enumerate(self.terms)), "ix int, term string"))
        return rows.join(numbers, "term").drop("term").repartition("doc_id").sortWithinPartitions("doc_id", "ix")

    def named(self, found: DataFrame) -> DataFrame:
        """found (q, ...) with qid in place of the query's number."""
        kind = StructType([StructField("q", IntegerType()), StructField("qid", self.qid_type)])
        return found.join(F.broadcast(self.spark.createDataFrame(list(enumerate(self.qids)), kind)), "q").drop("q")


def sums(batches: Iterator[pd.DataFrame], start: np.ndarray, query: np.ndarray, y: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query's number, doc_id, sum of x * y) of every pair that shares a term, for sorted rows (doc_id, ix, x) of whole documents.

    Rows go by pieces of at most CHUNK products, or of one document.
    """
    def piece(rows: pd.DataFrame):
        if not len(rows):
            return
        ids = rows["doc_id"].to_numpy()
        new = np.r_[True, ids[1:] != ids[:-1]]
        ix = rows["ix"].to_numpy()
        many = start[ix + 1] - start[ix]
        first = np.flatnonzero(new)
        done = np.r_[0, np.cumsum(np.add.reduceat(many, first))]
        i = 0
        while i < len(first):
            j = max(i + 1, int(np.searchsorted(done, done[i] + CHUNK, "right")) - 1)
            a, b = first[i], first[j] if j < len(first) else len(ids)
            n = many[a:b]
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[ix[a:b]], n)
            doc = np.repeat(np.cumsum(new[a:b]) - 1, n)
            pairs, inverse = np.unique(doc * (int(query.max()) + 1) + query[at], return_inverse=True)
            total = np.bincount(inverse, np.repeat(rows["x"].to_numpy()[a:b], n) * y[at], len(pairs))
            yield pairs % (int(query.max()) + 1), ids[a:b][new[a:b]][pairs // (int(query.max()) + 1)], total
            i = j

    held = None
    for rows in batches:
        rows = rows if held is None else pd.concat([held, rows], ignore_index=True)
        ids = rows["doc_id"].to_numpy()
        cut = len(ids) - int(np.argmax(ids[::-1] != ids[-1])) if len(ids) and (ids != ids[-1]).any() else 0
        yield from piece(rows[:cut])
        held = rows[cut:].reset_index(drop=True)
    if held is not None:
        yield from piece(held)


def leaders(words: DataFrame, rows: DataFrame, count: int = P.results, sizes: bool = False, otherwise: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(qid, doc_id, score, rank): the best documents of each query, for words (qid, term, y) and rows (term, doc_id, x).

    A score is the sum of x * y over common terms, by ``sizes`` divided by the length of the query's y, to six places.
    Only the rows of the batch's terms are shuffled, by document; each task adds up its documents' scores and keeps its
    best of each query.  Pairs of a query and a document are never rows, of which there would be the product of both.
    A batch of more than FEW_ROWS words is left to ``otherwise``, as it would not fit into every task.
    """
    words = kept(words, "query-terms")
    if otherwise is not None and words.count() > FEW_ROWS:
        return top(otherwise(words), count)
    batch = Batch(words)
    start, query, y = batch.start, batch.query, batch.y
    length = np.sqrt(np.bincount(query, y * y, len(batch.qids))) if sizes else np.ones(len(batch.qids))

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = None
        for q, ids, total in sums(batches, start, query, y):
            with np.errstate(divide="ignore", invalid="ignore"):
                new = pd.DataFrame({"q": q.astype(np.int32), "doc_id": ids, "score": rounded(total / length[q])})
            every = new if own is None else pd.concat([own, new], ignore_index=True)
            every = every.sort_values(["q", "score", "doc_id"], ascending=[True, False, True])
            own = every[every.groupby("q").cumcount() < count]
        if own is not None:
            yield own

    kind = StructType([StructField("q", IntegerType()), StructField("doc_id", rows.schema["doc_id"].dataType), StructField("score", DoubleType())])
    met = batch.met(rows.select("term", "doc_id", "x").where(F.col("x").isNotNull()))
    return top(batch.named(met.select("doc_id", "ix", "x").mapInPandas(best, kind)), count)


def hits(words: DataFrame, rows: DataFrame) -> DataFrame:
    """(qid, hits): documents with any of a query's terms, for words (qid, term) as a table and rows (term, doc_id), counted as ``leaders`` adds up."""
    if words.count() > FEW_ROWS:
        return rows.select("term", "doc_id").join(words, "term").groupBy("qid").agg(F.countDistinct("doc_id").alias("hits"))
    batch = Batch(words.withColumn("y", F.lit(1.0)))
    start, query, y = batch.start, batch.query, batch.y

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros(len(start) and int(query.max(initial=-1)) + 1, np.int64)
        for q, _, _ in sums(batches, start, query, y):
            n += np.bincount(q, minlength=len(n))
        yield pd.DataFrame({"q": np.arange(len(n), dtype=np.int32), "hits": n})

    kind = StructType([StructField("q", IntegerType()), StructField("hits", LongType())])
    found = batch.met(rows.select("term", "doc_id")).select("doc_id", "ix", F.lit(1.0).alias("x")).mapInPandas(counted, kind)
    return batch.named(found.groupBy("q").agg(F.sum("hits").alias("hits")))


def doc_weights(postings: DataFrame, terms: DataFrame, tf_type: str = "r") -> DataFrame:
    """(doc_id, term, x): documents' vectors, as the cosine uses them."""
    x = F.col(TF[tf_type]) * F.col("idf") * F.col("weight")
    return postings.join(terms.select("term", "idf"), "term").select("doc_id", "term", x.alias("x"))


def doc_units(weights: DataFrame) -> DataFrame:
    """(doc_id, term, u): vectors (doc_id, term, x) brought to length 1."""
    norm = F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy("doc_id")))
    return weights.select("doc_id", "term", F.try_divide(F.col("x"), norm).alias("u"))
