"""What grows with the product of queries and rows before, and no longer; the same results as by the plain way."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspan.operators import index as ix
from quillspan.operators import language_model as lm
from quillspan.operators import ranking as rk
from quillspan.operators import spelling as sp
from quillspan.plans import catalog as cat
from quillspan.plans import search as se
from quillspan.sources import corpus


def most_joined(spark, run):
    """The most rows that any join of what run() executes has put out."""
    store = spark._jsparkSession.sharedState().statusStore()
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    before = store.executionsList().size()
    run()
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    most, every = 0, store.executionsList()
    for i in range(before, every.size()):
        x = every.apply(i).executionId()
        values, nodes = store.executionMetrics(x), store.planGraph(x).allNodes()
        for node in (nodes.apply(j) for j in range(nodes.size())):
            metrics = node.metrics()
            for m in (metrics.apply(k) for k in range(metrics.size())):
                if "Join" in node.name() and m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                    most = max(most, int(values.apply(m.accumulatorId()).replace(",", "")))
    return most


@pytest.fixture(scope="module")
def many(spark):
    """300 documents of common words, each after each other somewhere."""
    words = [f"wo{a}{b}" for a in "abcdefgh" for b in "abcde"]
    texts = [(i, " ".join(words[(k * (i + 1)) % len(words)] for k in range(60)) + "\n" + " ".join(words[(k + i) % len(words)] for k in range(40))) for i in range(300)]
    return se.build(corpus.parse_texts(spark.createDataFrame(texts, "doc_id long, text string"))), words


def test_continuations_are_found_once_for_each_token(spark, many):
    i, words = many
    queries = se.as_queries(spark, [f"{words[k % 40]} {words[0]}" for k in range(400)])
    got = []
    bigrams = corpus.kept(i.bigrams, "bigrams")
    assert most_joined(spark, lambda: got.extend(sp.continuations(queries, bigrams).collect())) <= 1200
    best = sorted(bigrams.where(F.col("prev") == words[0]).collect(), key=lambda r: (-r.c, r.word))[:3]
    assert len(got) == 1200 and {(r.text, r.c) for r in got} == {(f"{words[0]} {b.word}", b.c) for b in best}


def test_suggestions_are_scored_once_for_each_pair_of_last_words(spark, many):
    i, words = many
    vocabulary, unigrams, bigrams = (corpus.kept(t, "t") for t in (i.terms, i.unigrams, i.bigrams))
    # the third has a completion that is a continuation too
    texts = [f"{words[k % 40]} {words[k % 7]} wo" for k in range(300)] + ["wo", f"{words[0]} {words[0]}", f"wo wo{'a'}", "zz wob"]
    queries = se.as_queries(spark, texts)
    every = sp.completions(queries, vocabulary).unionByName(sp.continuations(queries, bigrams).drop("c")).withColumn("key", F.struct("qid", "text"))
    scored = sp.sequence_probability(every.select("key", F.col("tail").alias("tokens")), unigrams, bigrams).select("key.*", F.round("p", 12).alias("p")).collect()
    expected = {q: [r.text for r in sorted((r for r in scored if r.qid == q), key=lambda r: (-r.p, r.text))[:3]] for q in {r.qid for r in scored}}
    got = {}
    assert most_joined(spark, lambda: got.update({(r.qid, r["rank"]): r.text for r in sp.suggest(queries, vocabulary, unigrams, bigrams).collect()})) < 5000
    assert len(scored) > 10_000 and {q: [got[q, k] for k in range(1, 4) if (q, k) in got] for q in {k[0] for k in got}} == expected


def test_completions_travel_as_lists(spark, many):
    i, words = many
    vocabulary = corpus.kept(i.terms, "terms")
    queries = se.as_queries(spark, [f"{words[k % 40]} wo" for k in range(300)])
    got = []
    assert most_joined(spark, lambda: got.extend(sp.completions(queries, vocabulary).collect())) <= 300 * sp.PARTS
    assert sorted((r.text, tuple(r.tail)) for r in got) == sorted((f"{words[k % 40]} {t.term}", (words[k % 40], t.term)) for k in range(300) for t in vocabulary.collect())


@pytest.mark.parametrize("request_", [{"ranker": "b"}, {"tf_type": "a", "idf_type": "p"}, {"tf_type": "l", "dis_func": "c"}])
def test_best_are_the_top_of_all_scores(spark, many, request_, monkeypatch):
    words = many[1]
    i = se.build(corpus.parse_texts(spark.createDataFrame([(k, f"{words[k % 40]}\n" + " ".join(words[(j * j + 3 * k) % 40] for j in range(k % 25))) for k in range(300)], "doc_id long, text string")))
    queries = se.as_queries(spark, [" ".join(words[k % 40] for k in range(j, j + 1 + j % 9)) for j in range(50)])
    expected = sorted(map(tuple, rk.top(se.rank(queries, i, **request_)).select("qid", "rank", "doc_id", "score").collect()))
    for chunk in (rk.CHUNK, 7):
        monkeypatch.setattr(rk, "CHUNK", chunk)
        got = []
        most = most_joined(spark, lambda: got.extend(se.best(queries, i, **request_).select("qid", "rank", "doc_id", "score").collect()))
        assert most <= i.postings.count() and sorted(map(tuple, got)) == expected and len(expected) > 300


def test_hits_are_distinct_documents(spark, many):
    i, words = many
    queries = se.as_queries(spark, [f"{words[0]} {words[1]} {words[0]}", "unseen", words[2]])
    docs = {w: {r.doc_id for r in i.postings.where(F.col("term") == w).collect()} for w in words[:3]}
    got = {r.qid: r.hits for r in ix.matching_docs(queries, i.postings, i.terms).collect()}
    assert got == {0: len(docs[words[0]] | docs[words[1]]), 1: 0, 2: len(docs[words[2]])}


def test_rounding_is_that_of_spark(spark):
    x = [0.0000005, 1.0000005, 2.5000015, -0.0000005, 123.4567895, 0.1234565, 1e-9, 7.0]
    expected = [r[0] for r in spark.createDataFrame([(v,) for v in x], "v double").select(F.round("v", 6)).collect()]
    assert rk.rounded(np.array(x)).tolist() == expected


def test_postings_of_unique_ids(spark):
    docs = corpus.parse_texts(spark.createDataFrame([(1, "alpha beta\ngamma alpha alpha"), (2, "delta\nalpha epsilon"), (3, "common only\n"), (4, ""), (5, None)], "doc_id long, text string"))
    plain, own = (sorted(map(tuple, f(docs).select(*[F.round(c, 12) if k == "double" else c for c, k in f(docs).dtypes]).collect())) for f in (ix.postings, ix.postings_of_unique))
    assert own == plain


def test_served_builds_what_is_asked_for(spark, tmp_path):
    i = se.Stored(spark, str(tmp_path / "i"), corpus.parse_texts(spark.createDataFrame([(1, "alpha beta\n")], "doc_id long, text string")))
    assert i.unigrams.count() == 3 and sorted(p.name for p in (tmp_path / "i").iterdir()) == ["docs", "unigrams"]


def test_second_edits_are_those_of_two_letters(spark):
    terms = [f"{a}{b}house" for a in "bcdghjklmn" for b in "aeiou"]
    vocabulary = spark.createDataFrame([(t,) for t in [*terms, "house"]], "term string")
    words = spark.createDataFrame([("house",), ("bahouse",)], "word string")
    got = sp.near_words(words, vocabulary).collect()
    assert {r.candidate for r in got if r.word == "house"} == {"house", *terms}


def shuffled(spark, run):
    """Rows that the stages of run() have put out to shuffles."""
    store, sc = spark._jsc.sc().statusStore(), spark._jsc.sc()

    def numbers(after):
        sc.listenerBus().waitUntilEmpty()
        got, missed, i = {}, 0, after
        while missed < 200:
            try:
                stage = store.lastStageAttempt(i)
                got[i], missed = stage.shuffleWriteRecords(), 0
            except Exception:  # noqa: BLE001  no such stage, or one that was skipped
                missed += 1
            i += 1
        return got

    first = spark.sparkContext._jsc.sc().dagScheduler().nextStageId()
    run()
    return sum(numbers(first).values())


def test_a_correction_builds_neither_postings_nor_bigrams(spark, tmp_path):
    """only unigrams and the batch's own pairs are shuffled; results are those of the tables."""
    words = [f"wo{a}{b}" for a in "abcdefgh" for b in "abcde"]
    texts = [(k, " ".join(words[(j * (k + 1) + j * j * (k % 7)) % 40] + ("x" * (j % 3)) for j in range(80)) + "\n" + words[k % 40]) for k in range(200)]
    docs = corpus.parse_texts(spark.createDataFrame(texts, "doc_id long, text string"))
    i, plain = se.Stored(spark, str(tmp_path / "i"), docs), se.build(docs)
    queries = se.as_queries(spark, ["woab woac", "wpab wocd woee", "woaax zz", "unseen", ""])
    plan = sp.correct(queries, i.vocabulary, i.unigrams, i.pairs, rests=i.rests, totals=i.totals)
    got = sorted(map(tuple, plan.collect()))
    assert sorted(p.name for p in (tmp_path / "i").iterdir()) == ["docs", "rests", "unigrams"]
    expected = sorted(map(tuple, sp.correct(queries, plain.terms, plain.unigrams, plain.bigrams).collect()))
    assert [r[:3] for r in got] == [r[:3] for r in expected] and [r[4] for r in got] == pytest.approx([r[4] for r in expected])
    assert sorted(i.vocabulary.collect()) == sorted(plain.vocabulary.collect()) and i.vocabulary.count() > 40
    assert sorted(i.totals.collect()) == sorted(lm.context_totals(i.bigrams).select("prev", "s").collect())
    assert sorted(map(tuple, sp.correct(queries, i.vocabulary, i.unigrams, i.pairs, rests=i.rests, totals=i.totals).collect())) == got  # by the stored bigrams


def test_only_asked_pairs_of_a_model_are_shuffled(spark, many):
    """the left join before shuffled each pair of the asked words."""
    i, words = many
    unigrams, bigrams = corpus.kept(i.unigrams, "unigrams"), corpus.kept(i.bigrams, "bigrams")
    rows = spark.createDataFrame([(k, w, words[0]) for k, w in enumerate(words)], "key int, prev string, word string")
    n, got, totals = bigrams.count(), [], corpus.kept(lm.context_totals(bigrams).select("prev", "s"), "totals")
    # no table of a model is small enough to travel by itself
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        most = shuffled(spark, lambda: got.extend(lm.follows(rows, unigrams, bigrams, totals=totals).collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert n > 900 and most < n / 2 and len(got) == 40


def test_turns_are_scored_without_the_bigram_table(spark, tmp_path, monkeypatch):
    """pairs are counted as they are looked up, by either way the same as by the table."""
    folder = "/root/testdata/sf0.001"
    i = se.Stored(spark, str(tmp_path / "i"), corpus.documents(spark, folder))
    monkeypatch.setattr(cat, "served", lambda *_: i)
    few = sorted(map(str, cat.bigram_prob_interpolated(spark, folder).collect()))
    monkeypatch.setattr(lm, "FEW_ROWS", 0)
    many_ = sorted(map(str, cat.bigram_prob_interpolated(spark, folder).collect()))
    assert sorted(p.name for p in (tmp_path / "i").iterdir()) == ["docs", "unigrams"]
    assert i.bigrams.count() > 0 and few == many_ == sorted(map(str, cat.bigram_prob_interpolated(spark, folder).collect())) and len(few) > 40


def test_a_pair_is_looked_up_once(spark, many, monkeypatch):
    """each row was joined with its first word's total and its second word's count."""
    monkeypatch.setattr(lm, "FEW_ROWS", 0)
    i, words = many
    unigrams, bigrams = corpus.kept(i.unigrams, "unigrams"), corpus.kept(i.bigrams, "bigrams")
    rows = spark.createDataFrame([(k, words[k % 3], words[(k + 1) % 3]) for k in range(3000)], "key int, prev string, word string")
    joins = lm.follows(rows, unigrams, bigrams, totals=lm.totals_of(unigrams))
    got = []
    *others, last = plain_rows(spark, lambda: got.extend(joins.collect()))
    assert last == len(got) == 3000 and max(others) < 100


def plain_rows(spark, run):
    """The rows that each join of what run() executes last has put out."""
    store = spark._jsparkSession.sharedState().statusStore()
    run()
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    x = store.executionsList().apply(store.executionsList().size() - 1).executionId()
    values, nodes = store.executionMetrics(x), store.planGraph(x).allNodes()
    found = []
    for node in (nodes.apply(j) for j in range(nodes.size())):
        metrics = node.metrics()
        found += [int(values.apply(m.accumulatorId()).replace(",", "")) for m in (metrics.apply(k) for k in range(metrics.size())) if "Join" in node.name() and m.name() == "number of output rows" and values.contains(m.accumulatorId())]
    return sorted(x for x in found if x > 1)


def checked(spark, folder):
    """An index of texts of common words, and queries of them."""
    words = [f"wo{a}{b}" for a in "abcdefgh" for b in "abcde"]
    texts = [(k, " ".join(words[(j * (k + 1) + k % 7) % 40] for j in range(60)) + "\n" + " ".join(words[(j + k) % 40] for j in range(40)) if k < 300 else "other") for k in range(700)]
    docs = corpus.parse_texts(spark.createDataFrame(texts, "doc_id long, text string"))
    return se.Stored(spark, folder, docs), se.build(docs), se.as_queries(spark, [f"{words[3]} {words[9]}", words[5].replace("o", "p"), "unseen", ""])


def test_postings_stay_where_their_documents_are_read(spark, tmp_path):
    """each posting was shuffled to its term."""
    i, plain, queries = checked(spark, str(tmp_path / "i"))
    i.docs, i.unigrams, i.rests
    n = plain.postings.count()
    assert shuffled(spark, lambda: i.postings) < n / 10
    columns = [F.round(c, 12).alias(c) if k == "double" else c for c, k in i.postings.dtypes]
    assert sorted(map(str, i.postings.select(columns).collect())) == sorted(map(str, plain.postings.select(columns).collect()))
    got = sorted(map(str, se.check(queries, i).collect()))
    assert got == sorted(map(str, se.check(queries, plain).collect())) and len(got) == 4


def test_texts_are_not_shuffled_for_results(spark, tmp_path):
    """all documents' texts were shuffled to meet the few that are shown."""
    i, plain, queries = checked(spark, str(tmp_path / "i"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        results = se.search(queries, i, checked=corpus.kept(se.check(queries, i), "checked"), ranker="b")
        n = shuffled(spark, results.collect)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    got = sorted(map(str, results.collect()))
    assert n < 100 and len(got) >= 20 and got == sorted(map(str, se.search(queries, plain, ranker="b").select(results.columns).collect()))


def test_rests_of_no_term_are_shuffled_once(spark):
    """all rests of all edits were made distinct, which shuffled them once more, before they met those of the terms."""
    vocabulary = corpus.kept(spark.createDataFrame([("house",), ("horse",)], "term string"), "vocabulary")
    rests = corpus.kept(sp.deletions(vocabulary), "rests")
    words = spark.createDataFrame([("house",), ("hxuses",), ("quite",), ("garden",)], "word string")
    n = sum(len(r.e) * len(r.word) for r in words.select("word", sp.edits(F.col("word")).alias("e")).collect())
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = []
        most = shuffled(spark, lambda: got.extend(sp.near_words(words, vocabulary, rests).collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert ("house", "house") in {(r.word, r.candidate) for r in got} and most < 2.8 * n, (most, n)
