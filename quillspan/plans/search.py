"""Searches end to end: query check, ranking, snippets, the response as JSON; tables of an index on disk."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.analysis import clean, snippet
from ..functions.lexicon import Parameters
from ..operators import index as ix
from ..operators import language_model as lm
from ..operators import ranking as rk
from ..operators import spelling as sp
from ..sources.corpus import Analyser, ensure, exists, kept, lookup, with_unique_ids

P = Parameters()


@dataclass
class Index:
    """All tables that a search reads."""

    docs: DataFrame
    stats: DataFrame
    postings: DataFrame
    all_terms: DataFrame
    unigrams: DataFrame
    bigrams: DataFrame
    p: Parameters = P
    analyse: Analyser = clean
    #: Where the tables are stored, and terms without one of their characters; none of an index that is only planned.
    path: str | None = None
    rests: DataFrame | None = None

    @property
    def terms(self) -> DataFrame:
        return ix.major(self.all_terms, self.p)

    @property
    def vocabulary(self) -> DataFrame:
        """(term) of ``terms``."""
        return self.terms.select("term")

    @property
    def pairs(self) -> DataFrame:
        """Bigrams, of which a pair may have several rows, for those that read some of them."""
        return self.bigrams

    @property
    def totals(self) -> DataFrame | None:
        """(prev, s) of ``pairs``, where they are known without them."""
        return None


def build(docs: DataFrame, p: Parameters = P, analyse: Analyser = clean) -> Index:
    """The index as plans over docs; nothing runs yet.  ``analyse`` makes words of queries, as it has of docs."""
    own, stats = ix.postings(docs, p), ix.corpus_stats(docs)
    return Index(docs, stats, own, ix.terms(own, stats), lm.unigrams(docs), lm.bigrams(docs), p, analyse)


class Stored(Index):
    """The index at path: a table that isn't there is built and written when it is first asked for, and is always read from there.

    Postings lie where their documents were read, terms are dealt by ranges, and both are sorted, so that a search for a term reads few pages of a file.
    Document ids that are given twice are an error.
    """

    def __init__(self, spark: SparkSession, path: str, docs: DataFrame, p: Parameters = P, analyse: Analyser = clean):
        self.spark, self.path, self.given, self.p, self.analyse = spark, path, docs, p, analyse

    def table(self, name: str, made: Callable[[], DataFrame]) -> DataFrame:
        return ensure(self.spark, f"{self.path}/{name}", made)

    @cached_property
    def docs(self) -> DataFrame:
        return self.table("docs", lambda: with_unique_ids(self.given))

    @cached_property
    def stats(self) -> DataFrame:
        return self.table("corpus_stats", lambda: ix.corpus_stats(self.docs))

    @cached_property
    def postings(self) -> DataFrame:
        return self.table("postings", lambda: ix.postings_of_unique(self.docs, self.p).sortWithinPartitions("term", "doc_id"))

    @cached_property
    def all_terms(self) -> DataFrame:
        return self.table("terms", lambda: ix.terms(self.postings, self.stats).repartitionByRange("term").sortWithinPartitions("term"))

    @cached_property
    def minor_terms(self) -> DataFrame:
        return self.table("minor_terms", lambda: ix.minor(self.all_terms, self.p))

    @cached_property
    def rests(self) -> DataFrame:
        return self.table("rests", lambda: sp.deletions(self.vocabulary))

    @cached_property
    def unigrams(self) -> DataFrame:
        return self.table("unigrams", lambda: lm.unigrams(self.docs))

    @cached_property
    def bigrams(self) -> DataFrame:
        return self.table("bigrams", lambda: lm.bigrams(self.docs))

    @property
    def vocabulary(self) -> DataFrame:
        """By the unigrams, whose counts are the terms' cf: no posting is made for it."""
        return ix.frequent(self.unigrams, self.p)

    @property
    def pairs(self) -> DataFrame:
        """The bigrams if they are there; to look some of them up, they are not built."""
        return self.bigrams if exists(self.spark, f"{self.path}/bigrams") else lm.occurrences(self.docs)

    @property
    def totals(self) -> DataFrame:
        return lm.totals_of(self.unigrams)


def stored(spark: SparkSession, path: str, docs: DataFrame, p: Parameters = P, analyse: Analyser = clean) -> Index:
    """The index at path with all of its tables built."""
    i = Stored(spark, path, docs, p, analyse)
    i.docs, i.stats, i.postings, i.all_terms, i.minor_terms, i.rests, i.unigrams, i.bigrams
    return i


def vectors(i: Index, tf_type: str = "r") -> DataFrame:
    """Documents' vectors of length 1 (doc_id, term, u); those of a stored index are built once and read from there."""
    def made() -> DataFrame:
        return rk.doc_units(rk.doc_weights(i.postings, i.terms, tf_type))

    return ensure(i.docs.sparkSession, f"{i.path}/doc_units_{tf_type}", lambda: made().repartitionByRange("term").sortWithinPartitions("term")) if i.path else made()


def as_queries(spark: SparkSession, texts: list[str], force: bool = False, analyse: Analyser = clean) -> DataFrame:
    """(qid, query, tokens, force)."""
    rows = spark.createDataFrame([(i, t, force) for i, t in enumerate(texts)], "qid long, query string, force boolean")
    return rows.withColumn("tokens", analyse(F.col("query")))


def check(queries: DataFrame, i: Index) -> DataFrame:
    """(qid, searched, suggestion, active): which strings are searched for each query, and what is suggested."""
    p, vocabulary = i.p, i.vocabulary
    corrected = kept(sp.correct(queries, vocabulary, i.unigrams, i.pairs, p, i.rests, i.totals).withColumn("tokens", i.analyse(F.col("text"))), "corrected")
    # both readings are counted in one pass over the postings
    both = [rows.select(F.struct("qid", F.lit(kind).alias("kind")).alias("qid"), "tokens") for kind, rows in (("raw", queries), ("own", corrected))]
    hits = kept(ix.matching_docs(both[0].unionByName(both[1]), i.postings, vocabulary).select("qid.*", "hits"), "hits")
    raw_hits, own_hits = (hits.where(F.col("kind") == kind).select("qid", F.col("hits").alias(f"{kind}_hits")) for kind in ("raw", "own"))
    rows = queries.select("qid", "query", "force").join(corrected.select("qid", "text", "p"), "qid").join(raw_hits, "qid").join(own_hits, "qid")
    alone, many, better = F.col("force") | (F.col("query") == F.col("text")), F.col("raw_hits") > p.enough_hits, F.col("own_hits") > p.enough_hits
    searched = F.when(alone | many, F.array("query")).when(better, F.array("text")).otherwise(F.array("query", "text"))
    suggestion = F.when(alone, F.lit("")).when(many, F.when(F.col("p") > p.likely, F.col("text")).otherwise(F.lit(""))).when(better, F.col("text")).otherwise(F.lit(""))
    return rows.select("qid", searched.alias("searched"), suggestion.alias("suggestion"), (~alone & ~many & better).alias("active"))


def parameters(ranker: str | None = None, tf_type: str | None = None, idf_type: str | None = None, dis_func: str | None = None) -> tuple[str, str, str, str]:
    """Request parameters with their defaults in place of what isn't known."""
    return ("b" if ranker == "b" else "t", tf_type if tf_type in rk.TF else "r", idf_type if idf_type in rk.IDF else "n", dis_func if dis_func in ("m", "c") else "m")


def rank(queries: DataFrame, i: Index, ranker: str = "t", tf_type: str = "r", idf_type: str = "n", dis_func: str = "m") -> DataFrame:
    """(qid, doc_id, score) by BM25, the TF-IDF product, or its cosine; a type that isn't known gives no rows."""
    if ranker == "b":
        return rk.scores(queries, rk.Bm25(i.p), i.postings, i.terms, i.stats)
    if tf_type not in rk.TF or idf_type not in rk.IDF or dis_func not in ("m", "c"):
        return rank(queries, i).limit(0)
    if dis_func == "c":
        return rk.cosine_of(queries, vectors(i, tf_type), i.terms)
    return rk.scores(queries, rk.TfIdf(tf_type, idf_type), i.postings, i.terms, i.stats)


def best(queries: DataFrame, i: Index, ranker: str = "t", tf_type: str = "r", idf_type: str = "n", dis_func: str = "m") -> DataFrame:
    """(qid, doc_id, score, rank): the first of ``rank``'s rows, at most i.p.results of each query."""
    if ranker == "b":
        return rk.best(queries, rk.Bm25(i.p), i.postings, i.terms, i.stats, i.p.results)
    if tf_type not in rk.TF or idf_type not in rk.IDF or dis_func not in ("m", "c"):
        return best(queries, i).limit(0)
    if dis_func == "c":
        return rk.best_cosine(queries, vectors(i, tf_type), i.terms, i.p.results)
    return rk.best(queries, rk.TfIdf(tf_type, idf_type), i.postings, i.terms, i.stats, i.p.results)


def search(queries: DataFrame, i: Index, regex: bool = False, checked: DataFrame | None = None, **request: str | None) -> DataFrame:
    """(qid, query_pos, rank, doc_id, url, title, body, score): results of all that is searched for each query, one after another."""
    checked = kept(check(queries, i), "checked") if checked is None else checked
    strings = checked.select("qid", F.posexplode("searched").alias("query_pos", "query"))
    keyed = strings.select(F.struct("qid", "query_pos").alias("qid"), i.analyse(F.col("query")).alias("tokens"))
    # a batch's best documents are few and travel to the texts, which are not shuffled
    found = best(keyed, i, *parameters(**request)).select("qid.*", "rank", "doc_id", "score")
    rows = i.docs.select("doc_id", "url", "title", "body").join(lookup(found.join(strings, ["qid", "query_pos"]), "found"), "doc_id")
    return rows.select("qid", "query_pos", "rank", "doc_id", "url", "title", snippet(F.col("body"), F.col("query"), i.p, regex).alias("body"), "score")


BAD_REQUEST = '{"success":false,"error":"BAD_REQUEST"}'


def envelope(answers: DataFrame, queries: DataFrame) -> DataFrame:
    """answers (qid, response), and the error for each query that is null or empty."""
    bad = queries.where(F.coalesce(F.length("query"), F.lit(0)) == 0).select("qid", F.lit(BAD_REQUEST).alias("response"))
    return answers.select("qid", F.to_json("response", {"ignoreNullFields": "false"}).alias("response")).unionByName(bad)


def respond(queries: DataFrame, i: Index, **request: str | None) -> DataFrame:
    """(qid, response): each query's response as JSON; a query that is null or empty is a bad request."""
    good = queries.where(F.length("query") > 0)
    checked = kept(check(good, i), "checked")
    results = search(good, i, checked=checked, **request).groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("query_pos", "rank", F.struct(F.col("doc_id").alias("id"), "url", "title", "body", "score").alias("r")))).alias("rs"))
    correction = F.when(F.col("active") | (F.col("suggestion") != ""), F.struct("active", F.col("suggestion").alias("query")))
    listed = F.coalesce(F.transform("rs", lambda x: x["r"]), F.array())
    result = F.struct(listed.alias("documents"), correction.alias("correction"))
    return envelope(checked.join(results, "qid", "left").select("qid", F.struct(F.lit(True).alias("success"), result.alias("result")).alias("response")), queries)


def suggestions(queries: DataFrame, i: Index, limit: int | None = None) -> DataFrame:
    return sp.suggest(queries, i.vocabulary, i.unigrams, i.bigrams, i.p.suggestions if limit is None else limit, i.p)


def respond_suggestions(queries: DataFrame, i: Index, limit: int | None = None) -> DataFrame:
    """(qid, response): each query's suggestions as JSON, likeliest first; a query that is null or empty is a bad request."""
    good = queries.where(F.length("query") > 0)
    found = suggestions(good, i, limit).groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("rank", F.struct("text", "score").alias("s")))).alias("ss"))
    listed = F.coalesce(F.transform("ss", lambda x: x["s"]), F.array())
    return envelope(good.select("qid").join(found, "qid", "left").select("qid", F.struct(F.lit(True).alias("success"), listed.alias("suggestions")).alias("response")), queries)
