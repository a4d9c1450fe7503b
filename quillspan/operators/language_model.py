"""Unigram and bigram models of fields, and the probability of sequences of words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lexicon import END, Parameters
from ..sources.corpus import FEW_ROWS, kept

P = Parameters()


def fields(docs: DataFrame) -> DataFrame:
    """(content): each field's words and the end."""
    return docs.select(F.explode(F.array("title_tokens", "body_tokens")).alias("content")).select(F.concat("content", F.array(F.lit(END))).alias("content"))


def unigrams(docs: DataFrame) -> DataFrame:
    return fields(docs).select(F.explode("content").alias("word")).groupBy("word").agg(F.count("*").alias("c"))


def occurrences(docs: DataFrame) -> DataFrame:
    """(prev, word, c) of each place of a field: the bigrams before they are counted, c is 1."""
    n = F.size("content") - 1
    pairs = F.zip_with(F.slice("content", 1, n), F.slice("content", 2, n), lambda a, b: F.struct(a.alias("prev"), b.alias("word")))
    return fields(docs).where(F.size("content") > 1).select(F.inline(pairs)).withColumn("c", F.lit(1).cast("long"))


def bigrams(docs: DataFrame) -> DataFrame:
    return occurrences(docs).groupBy("prev", "word").agg(F.count("*").alias("c"))


def context_totals(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("prev").agg(F.sum("c").alias("s"), F.count("*").alias("continuations"))


def totals_of(words: DataFrame) -> DataFrame:
    """(prev, s), as ``context_totals`` has them, from the unigrams of the same fields: each word but the end has one after it wherever it stands."""
    return words.where(F.col("word") != END).select(F.col("word").alias("prev"), F.col("c").alias("s"))


def unigram_total(words: DataFrame) -> DataFrame:
    """One row: all words less one, by which probabilities are divided."""
    return words.agg((F.sum("c") - 1).alias("total"), F.count("*").alias("vocabulary"))


def unigram_probability(words: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """(word, p) of all words, or of those ``asked`` (word)."""
    own = words if asked is None else words.join(asked.select("word").distinct(), "word", "left_semi")
    return own.crossJoin(F.broadcast(unigram_total(words))).select("word", (F.col("c") / F.col("total")).alias("p"))  # one row


def log_of(p: Column) -> Column:
    """Natural log; that of 0 is minus infinity."""
    return F.when(p > 0, F.log(p)).otherwise(F.lit(float("-inf")))


def follows(rows: DataFrame, words: DataFrame, pairs: DataFrame, smoothed: bool = True, p: Parameters = P, totals: DataFrame | None = None) -> DataFrame:
    """rows (prev, word) with log_p of the word after prev.

    A pair is looked up once, however many rows have it.  Where asked pairs are few they
    travel to the models, of which nothing else is shuffled; else they are counted
    together with the model's, which are shuffled once.  ``pairs`` may have a pair's c
    in several rows, as ``occurrences`` has; ``totals`` (prev, s) are their sums, if known.
    """
    rows = kept(rows, "steps")
    asked = kept(rows.select("prev", "word").distinct(), "asked")
    few = F.broadcast if asked.count() <= FEW_ROWS else None

    def own(model: DataFrame, *names: str) -> DataFrame:
        return model.join(few(asked.select(*names).distinct()), list(names), "left_semi") if few else model

    both = own(pairs, "prev", "word").select("prev", "word", "c", F.lit(False).alias("asked")).unionByName(asked.select("prev", "word", F.lit(0).cast("long").alias("c"), F.lit(True).alias("asked")))
    found = both.groupBy("prev", "word").agg(F.sum("c").alias("c"), F.max("asked").alias("asked")).where("asked").select("prev", "word", "c")
    sums = context_totals(own(pairs, "prev")) if totals is None else own(totals, "prev")
    found = found.join(sums.select("prev", "s"), "prev", "left")
    value = F.coalesce(F.try_divide(F.col("c"), F.col("s")), F.lit(0.0))
    if smoothed:
        single = own(words, "word").crossJoin(F.broadcast(unigram_total(words))).select("word", (F.col("c") / F.col("total")).alias("p"))  # one row
        found = found.join(single, "word", "left")
        value = p.bigram_share * value + (1 - p.bigram_share) * F.coalesce("p", F.lit(0.0))
    found = found.select("prev", "word", log_of(value).alias("log_p"))
    return rows.join(few(found) if few else found, ["prev", "word"], "left")


def sequence_probability(sequences: DataFrame, words: DataFrame, pairs: DataFrame, smoothed: bool = True, p: Parameters = P, totals: DataFrame | None = None) -> DataFrame:
    """(key, p, log_p) of sequences (key, tokens): the product over pairs; of one word its own probability; of none 0.

    The first word's own probability is no factor of a longer sequence.  Logs are
    summed, so that long sequences keep a log_p where p is rounded to 0.
    """
    sequences = sequences.select("key", "tokens")
    single = sequences.where(F.size("tokens") == 1).select("key", F.element_at("tokens", 1).alias("word"))
    none = sequences.where(F.size("tokens") == 0).select("key", F.lit(float("-inf")).alias("log_p"))
    n = F.size("tokens") - 1
    steps = F.zip_with(F.slice("tokens", 1, n), F.slice("tokens", 2, n), lambda a, b: F.struct(a.alias("prev"), b.alias("word")))
    rows = sequences.where(F.size("tokens") > 1).select("key", F.inline(steps))
    many = follows(rows, words, pairs, smoothed, p, totals).groupBy("key").agg(F.sum("log_p").alias("log_p"))
    if smoothed:
        one = single.join(unigram_probability(words, single), "word", "left").select("key", log_of(F.coalesce("p", F.lit(0.0))).alias("log_p"))
    else:
        one = single.select("key", F.lit(float("-inf")).alias("log_p"))
    return many.unionByName(one).unionByName(none).select("key", F.exp("log_p").alias("p"), "log_p")


def known(words: DataFrame, model: DataFrame, column: str = "word") -> DataFrame:
    """words (word) with whether the model has them: unigrams by word, bigrams by context."""
    has = model.select(F.col(column).alias("word")).distinct().withColumn("known", F.lit(True))
    return words.join(has, "word", "left").withColumn("known", F.coalesce("known", F.lit(False)))
