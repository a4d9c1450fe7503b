"""Spelling candidates near a word, corrections of queries, suggestions."""

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from ..functions import lexicon as lx
from ..functions.analysis import edits, layout_swap, letters_for
from ..sources.corpus import kept, lookup
from .language_model import follows, log_of, sequence_probability, unigram_probability

P = lx.Parameters()


def cuts(word: Column) -> Column:
    """(rest, pos, char) for each place of the word: what is left without its character."""
    n = F.length(word)
    places = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: i <= n)
    return F.transform(places, lambda i: F.struct(F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, n)).alias("rest"), i.alias("pos"), F.substring(word, i, F.lit(1)).alias("char")))


def deletions(vocabulary: DataFrame) -> DataFrame:
    """(rest, pos, char, term): each term without one of its characters; an index of it is stored with the others."""
    return vocabulary.select("term", F.inline(cuts(F.col("term")))).select("rest", "pos", "char", "term")


def near_words(words: DataFrame, vocabulary: DataFrame, rests: DataFrame | None = None) -> DataFrame:
    """(word, candidate): terms of the vocabulary at one edit or two, in the other layout, or the word itself.

    Strings at one edit are made.  A term at one more edit shares with such a string
    what is left of either without one character (``rests`` has that of the terms):
    of both for another key or a transposition, of one for an insertion or a
    deletion.  So second edits are joined, not made.
    """
    # a few words become many rows, so they are dealt to as many tasks as the session has, however few bytes they are
    words = words.select("word").distinct().repartition(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    first = kept(words.select("word", F.explode(edits(F.col("word"))).alias("near")), "edits")
    rests = deletions(vocabulary) if rests is None else rests
    own = first.repartition(int(first.sparkSession.conf.get("spark.sql.shuffle.partitions"))).select("word", "near", F.inline(cuts(F.col("near"))))
    theirs = rests.select("rest", F.col("pos").alias("at"), F.col("char").alias("new"), "term")
    keys = F.create_map(*[x for c, adj in lx.NEIGHBOURS.items() for x in (F.lit(c), F.array(*map(F.lit, adj)))])
    # what may stand in place of a character, and where: rows meet by all three, not by the rest alone, which many terms share
    none = F.array().cast("array<string>")
    key = F.transform(F.coalesce(F.element_at(keys, F.col("char")), none), lambda c: F.struct(F.col("pos").alias("at"), c.alias("new")))
    swapped = F.transform(F.array(F.col("pos") - 1, F.col("pos") + 1), lambda i: F.struct(i.alias("at"), F.col("char").alias("new")))
    # most rests are of no term: those go before the others are made distinct
    known = own.select("word", "rest", "pos", "char").join(theirs.select("rest").distinct(), "rest", "left_semi").distinct()
    changed = known.select("word", "rest", F.inline(F.array_distinct(F.concat(key, swapped)))).join(theirs, ["rest", "at", "new"]).select("word", F.col("term").alias("candidate"))
    grown = first.join(theirs.withColumnRenamed("rest", "near"), "near").where(F.array_contains(letters_for(F.col("near")), F.col("new"))).select("word", F.col("term").alias("candidate"))
    once = first.select("word", F.col("near").alias("candidate"))
    less = own.select("word", F.col("rest").alias("candidate"))
    layout = words.select("word", layout_swap(F.col("word")).alias("candidate")).where(F.col("candidate").isNotNull())
    same = words.select("word", F.col("word").alias("candidate"))
    made = once.unionByName(less).unionByName(layout).unionByName(same)
    found = made.join(vocabulary.select(F.col("term").alias("candidate")), "candidate", "left_semi").select("word", "candidate")
    return found.unionByName(changed).unionByName(grown).distinct()


def candidates(words: DataFrame, vocabulary: DataFrame, model: DataFrame, p: lx.Parameters = P, rests: DataFrame | None = None) -> DataFrame:
    """(word, candidate, p, nth): a word's likeliest neighbours in the vocabulary."""
    found = lookup(near_words(words, vocabulary, rests), "near")
    own = unigram_probability(model, found.select(F.col("candidate").alias("word"))).withColumnRenamed("word", "candidate")
    ranked = found.join(own, "candidate", "left").withColumn("p", F.coalesce("p", F.lit(0.0)))
    w = Window.partitionBy("word").orderBy(F.desc("p"), "candidate")
    return ranked.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= p.candidates).select("word", "candidate", "p", "nth")


def best_paths(choices: DataFrame, words: DataFrame, pairs: DataFrame, p: lx.Parameters = P, totals: DataFrame | None = None) -> DataFrame:
    """(key, text, log_p): the likeliest sequence of choices (key, n, pos, nth, word), one for each of n places; none where a place has no choice.

    Viterbi: of all ways to a choice only the likeliest is kept, of equal ones the
    least text, so a sequence takes time in proportion to its length.
    """
    before = choices.select("key", (F.col("pos") + 1).alias("pos"), F.col("nth").alias("prev_nth"), F.col("word").alias("prev"))
    steps = follows(choices.join(before, ["key", "pos"]), words, pairs, True, p, totals).select("key", "n", "pos", "prev_nth", "nth", "word", "log_p")
    alone = choices.where("n = 1").select("word").distinct()
    own = unigram_probability(words, alone)
    start = choices.where("pos = 0").join(own, "word", "left")
    # the first word's own probability is no factor of a longer sequence
    log_p = F.when(F.col("n") == 1, log_of(F.coalesce("p", F.lit(0.0)))).otherwise(F.lit(0.0))
    start = start.select("key", "n", "pos", F.lit(0).alias("prev_nth"), "nth", "word", log_p.alias("log_p"))
    x = F.struct("prev_nth", "nth", "word", "log_p")
    places = steps.unionByName(start).groupBy("key", "n", "pos").agg(F.sort_array(F.collect_list(x)).alias("xs"))
    lists = places.groupBy("key", "n").agg(F.sort_array(F.collect_list(F.struct("pos", "xs"))).alias("places")).where(F.size("places") == F.col("n"))

    def step(state: Column, place: Column) -> Column:
        def way(x: Column) -> Column:
            last = F.get(state, x["prev_nth"] - 1)
            return F.struct((F.coalesce(last["cost"], F.lit(0.0)) - x["log_p"]).alias("cost"), F.concat_ws(" ", last["text"], x["word"]).alias("text"))

        nths = F.array_distinct(F.transform(place["xs"], lambda x: x["nth"]))
        return F.transform(nths, lambda j: F.array_min(F.transform(F.filter(place["xs"], lambda x: x["nth"] == j), way)))

    best = F.aggregate("places", F.array().cast("array<struct<cost: double, text: string>>"), step, F.array_min)
    return lists.select("key", best.alias("best")).select("key", "best.text", (-F.col("best.cost")).alias("log_p"))


def correct(queries: DataFrame, vocabulary: DataFrame, words: DataFrame, pairs: DataFrame, p: lx.Parameters = P, rests: DataFrame | None = None, totals: DataFrame | None = None) -> DataFrame:
    """(qid, query, text, p, log_p): the likeliest reading of each query (qid, query, tokens); the query itself wins ties."""
    tokens = queries.select("qid", F.size("tokens").alias("n"), F.posexplode("tokens").alias("pos", "word"))
    found = candidates(tokens.select("word"), vocabulary, words, p, rests)
    raw = tokens.select(F.struct("qid", F.lit(0).alias("kind")).alias("key"), "n", "pos", F.lit(1).alias("nth"), "word")
    read = tokens.join(found.select("word", "candidate", "nth"), "word").select(F.struct("qid", F.lit(1).alias("kind")).alias("key"), "n", "pos", "nth", F.col("candidate").alias("word"))
    scored = best_paths(lookup(raw.unionByName(read), "choices"), words, pairs, p, totals).select("key.*", "text", "log_p")
    w = Window.partitionBy("qid").orderBy(F.desc("log_p"), "kind", "text")
    best = scored.withColumn("nth", F.row_number().over(w)).where("nth = 1")
    log_p = F.coalesce("log_p", F.lit(float("-inf")))  # a query without words
    return queries.select("qid", "query").join(best, "qid", "left").select("qid", "query", F.when(F.col("kind") == 1, F.col("text")).otherwise(F.col("query")).alias("text"), F.exp(log_p).alias("p"), log_p.alias("log_p"))


#: Characters of a prefix by which tokens and terms meet.
PREFIX = 3
#: Parts into which the terms that a token begins are dealt, so that a token that many queries end with is the work of several tasks.
PARTS = 16


def starts(word: str) -> Column:
    """The first characters of a word, from one to PREFIX of them."""
    sizes = F.filter(F.sequence(F.lit(1), F.lit(PREFIX)), lambda i: i <= F.length(word))
    return F.transform(sizes, lambda i: F.substring(word, F.lit(1), i))


def endings(lasts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(last, term): the terms that each token (last) begins.

    Words meet the tokens by their first characters, PREFIX at most, so that the join is by equality.
    """
    begun = vocabulary.where(F.length("term") > 0).select("term", F.explode(starts("term")).alias("start"))
    return begun.join(lasts.select("last", F.substring("last", 1, PREFIX).alias("start")), "start").where(F.startswith("term", "last") & (F.col("term") != F.col("last"))).select("last", "term")


def completions(queries: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(qid, text, tail): words that the last token begins, with the two last words, which are scored.

    Terms are found once for each token and travel as lists: a text is made where it is put out, those of a query one after another.
    """
    last = queries.where(F.size("tokens") > 0).select("qid", "tokens", F.element_at("tokens", -1).alias("last"))
    found = endings(lookup(last.select("last").distinct(), "last"), vocabulary).groupBy("last", F.pmod(F.xxhash64("term"), F.lit(PARTS)).alias("part")).agg(F.collect_list("term").alias("terms"))
    n = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # so many partitions as the session has, however few bytes go in: much more comes out
    asked = last.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long")))).repartition(n, "last", "part")
    grown = asked.join(found.repartition(n, "last", "part"), ["last", "part"]).select("qid", F.slice("tokens", 1, F.size("tokens") - 1).alias("before"), F.explode("terms").alias("term"))
    tokens = F.concat("before", F.array("term"))
    return grown.select("qid", F.concat_ws(" ", "before", "term").alias("text"), F.slice(tokens, F.greatest(F.size(tokens) - 1, F.lit(1)), 2).alias("tail"))


def followers(lasts: DataFrame, pairs: DataFrame, count: int, drop_end: bool = False) -> DataFrame:
    """(prev, word, c): the words that follow each token (prev) most often, once for each token."""
    rows = pairs.join(lookup(lasts, "last"), "prev")
    if drop_end:
        rows = rows.where(F.col("word") != lx.END)
    w = Window.partitionBy("prev").orderBy(F.desc("c"), "word")
    return rows.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= count).drop("nth")


def continuations(queries: DataFrame, pairs: DataFrame, p: lx.Parameters = P, drop_end: bool = False) -> DataFrame:
    """(qid, text, tail, c): the words that follow the last token most often; earlier tokens are left out."""
    last = queries.where(F.size("tokens") > 0).select("qid", F.element_at("tokens", -1).alias("prev"))
    rows = last.join(followers(last.select("prev").distinct(), pairs, p.continuations, drop_end), "prev")
    w = Window.partitionBy("qid").orderBy(F.desc("c"), "word")
    rows = rows.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= p.continuations)
    return rows.select("qid", F.concat_ws(" ", "prev", "word").alias("text"), F.array("prev", "word").alias("tail"), "c")


def likely_endings(ends: DataFrame, vocabulary: DataFrame, words: DataFrame, pairs: DataFrame, count: int, p: lx.Parameters = P) -> DataFrame:
    """(prev, last, term, log_p): the likeliest completions of each pair of a query's last tokens; prev is empty where there is none.

    A term that never follows prev has a share of its own probability alone, so of these no more than ``count`` of each last token count.
    """
    lasts = endings(lookup(ends.select("last").distinct(), "last"), vocabulary)
    own = lasts.join(words.select(F.col("word").alias("term"), "c"), "term", "left")
    w = Window.partitionBy("last").orderBy(F.desc(F.coalesce("c", F.lit(0))), "term")
    frequent = own.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= count).select("last", "term")
    seen = pairs.join(lookup(ends.select("prev").distinct(), "prev"), "prev").select("prev", F.col("word").alias("term"), F.explode(starts("word")).alias("start"))
    seen = seen.join(ends.withColumn("start", F.substring("last", 1, PREFIX)), ["prev", "start"]).where(F.startswith("term", "last") & (F.col("term") != F.col("last")))
    seen = seen.select("prev", "last", "term").join(vocabulary.select("term"), "term", "left_semi").select("prev", "last", "term")
    every = ends.join(frequent, "last").select("prev", "last", "term").unionByName(seen).distinct()
    tail = F.when(F.col("prev") == "", F.array("term")).otherwise(F.array("prev", "term"))
    scored = sequence_probability(every.select(F.struct("prev", "last", "term").alias("key"), tail.alias("tokens")), words, pairs, p=p).select("key.*", "log_p")
    w = Window.partitionBy("prev", "last").orderBy(F.desc("log_p"), "term")
    return scored.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= count).drop("nth")


def suggest(queries: DataFrame, vocabulary: DataFrame, words: DataFrame, pairs: DataFrame, limit: int = P.suggestions, p: lx.Parameters = P, drop_end: bool = False) -> DataFrame:
    """(qid, text, score, rank): completions and continuations, likeliest first.

    A score depends on the two last words alone, so it is found once for each pair of them and goes to the queries that end so.
    """
    n = F.size("tokens")
    asked = queries.where(n > 0).select("qid", F.slice("tokens", 1, n - 1).alias("before"), F.when(n > 1, F.element_at("tokens", -2)).otherwise(F.lit("")).alias("prev"), F.element_at("tokens", -1).alias("last"))
    # a text that is both has the product of both, so each continuation may put one completion back
    ends = lookup(asked.select("prev", "last").distinct(), "ends")
    grown = asked.join(likely_endings(ends, vocabulary, words, pairs, limit + p.continuations, p), ["prev", "last"]).select("qid", F.concat_ws(" ", "before", "term").alias("text"), "log_p")
    next_ = kept(continuations(queries, pairs, p, drop_end).select("qid", "text", F.col("tail")[0].alias("prev"), F.col("tail")[1].alias("word")), "continuations")
    steps = next_.select("prev", "word").distinct().select(F.struct("prev", "word").alias("key"), F.array("prev", "word").alias("tokens"))
    follow = next_.join(sequence_probability(steps, words, pairs, p=p).select("key.*", "log_p"), ["prev", "word"]).select("qid", "text", "log_p")
    scored = grown.unionByName(follow).groupBy("qid", "text").agg(F.exp(F.sum("log_p")).alias("score"))
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "text")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


@F.pandas_udf(IntegerType())
def weighted_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """Edit distance where a neighbouring key costs 1, any other character 2, and a transposition 1.

    Each row's table depends on itself cell by cell, which column functions can't express.
    """
    def one(x: str, y: str) -> int:
        before, last = None, list(range(len(y) + 1))
        for i, c in enumerate(x):
            now = [i + 1]
            for j, d in enumerate(y):
                cost = 0 if c == d else 1 if d in lx.NEIGHBOURS.get(c, ()) else 2
                best = min(last[j + 1] + 1, now[j] + 1, last[j] + cost)
                if i and j and c == y[j - 1] and x[i - 1] == d:
                    best = min(best, before[j - 1] + 1)
                now.append(best)
            before, last = last, now
        return last[-1]

    return pd.Series([None if x is None or y is None else one(x, y) for x, y in zip(a, b)])
