"""Index, ranking, models and the decision table on a small corpus, by hand."""

import json
import math

import pytest
from pyspark.sql import functions as F

from quillspan.functions.analysis import clean
from quillspan.operators import index as ix
from quillspan.operators import language_model as lm
from quillspan.operators import ranking as rk
from quillspan.operators import spelling as sp
from quillspan.plans import search as se
from quillspan.sources import corpus

TEXTS = [(1, "alpha beta\ngamma alpha alpha"), (2, "delta\nalpha epsilon"), (3, "common only\n"), (4, ""), (5, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return corpus.parse_texts(spark.createDataFrame(TEXTS, "doc_id long, text string")).cache()


def rows(df, *keys):
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r for r in df.collect()}


def test_postings(docs):
    got = rows(ix.postings(docs), "term", "doc_id")
    a = got["alpha", 1]
    assert (a.tf, a.relative, a.augmented) == (3, 3 / 5, 1.0)
    assert a.weight == pytest.approx(1.0) and a.logarithm == pytest.approx(1 + math.log(3))
    assert got["beta", 1].weight == pytest.approx(0.7) and got["gamma", 1].weight == pytest.approx(0.3)
    assert got["beta", 1].augmented == pytest.approx(0.5 + 0.5 / 3)


def test_terms_count_empty_documents(docs):
    stats = ix.corpus_stats(docs)
    assert stats.first().n == 5 and stats.first().avdl == pytest.approx(10 / 5)
    t = rows(ix.terms(ix.postings(docs), stats), "term")["alpha"]
    assert (t.df, t.cf) == (2, 4) and t.idf == pytest.approx(math.log(6 / 2)) and t.prob_idf == pytest.approx(math.log(3 / 2))


def test_a_term_of_all_documents_has_no_prob_idf(spark):
    d = corpus.parse_texts(spark.createDataFrame([(1, "xx yy"), (2, "xx")], "doc_id long, text string"))
    assert rows(ix.terms(ix.postings(d), ix.corpus_stats(d)), "term")["xx"].prob_idf is None


def test_sums_agree(docs):
    p = ix.postings(docs)
    total = docs.agg(F.sum(F.col("title_len") + F.col("body_len"))).first()[0]
    assert p.agg(F.sum("tf")).first()[0] == total == ix.terms(p, ix.corpus_stats(docs)).agg(F.sum("cf")).first()[0]
    assert lm.unigrams(docs).agg(F.sum("c")).first()[0] == total + 2 * docs.count()
    assert lm.bigrams(docs).agg(F.sum("c")).first()[0] == total


def test_bm25_by_hand(spark, docs):
    i = se.Index(docs, ix.corpus_stats(docs), ix.postings(docs), ix.terms(ix.postings(docs), ix.corpus_stats(docs)), lm.unigrams(docs), lm.bigrams(docs), se.Parameters(minor=0))
    q = se.as_queries(spark, ["alpha alpha"])
    got = rows(se.rank(q, i, "b"), "doc_id")
    expected = 2 * math.log(3 / 2) * (3 * 2.2) / (3 + 1.2 * (0.25 + 0.75 * 5 / 2)) * 1.0
    assert got[1].score == pytest.approx(expected, abs=1e-6)
    dot = rows(se.rank(q, i, "t"), "doc_id")
    assert dot[1].score == pytest.approx(2 * 0.6 * math.log(3), abs=1e-6)
    cosine = rows(se.rank(q, i, "t", dis_func="c"), "doc_id")
    assert all(0 <= r.score <= 1 for r in cosine.values())
    assert se.rank(q, i, "t", tf_type="x").count() == 0


def test_top_breaks_ties_by_id(spark):
    scored = spark.createDataFrame([(0, 7, 1.0), (0, 3, 1.0), (0, 5, 2.0)], "qid int, doc_id int, score double")
    assert [r.doc_id for r in rk.top(scored, 2).orderBy("rank").collect()] == [5, 3]


def test_probabilities(spark):
    d = corpus.parse_texts(spark.createDataFrame([(1, "aa bb aa bb\n")], "doc_id long, text string"))
    u, b = lm.unigrams(d), lm.bigrams(d)
    assert rows(u, "word")["<END>"].c == 2 and rows(lm.unigram_total(u), "total")
    asked = spark.createDataFrame([(0, ["aa", "bb"]), (1, ["aa"]), (2, []), (3, ["zz", "aa"]), (4, ["bb", "aa", "bb"])], "key int, tokens array<string>")
    got = {r.key: r.p for r in lm.sequence_probability(asked, u, b).collect()}
    uni = 2 / 5
    assert got[0] == pytest.approx(0.9 * 1 + 0.1 * uni) and got[1] == pytest.approx(uni) and got[2] == 0
    assert got[3] == pytest.approx(0.1 * uni) and got[4] == pytest.approx((0.9 * 0.5 + 0.1 * uni) * (0.9 + 0.1 * uni))
    plain = {r.key: r.p for r in lm.sequence_probability(asked, u, b, smoothed=False).collect()}
    assert plain[0] == 1 and plain[3] == 0


@pytest.fixture(scope="module")
def big(spark):
    texts = [(i, f"house number\nthe house stands here with the garden tree{i % 3}") for i in range(12)]
    return se.build(corpus.parse_texts(spark.createDataFrame(texts, "doc_id long, text string")))


@pytest.mark.parametrize(
    "query,force,searched,suggestion,active",
    [("house", False, ["house"], "", False), ("hpuse", False, ["house"], "house", True), ("hpuse", True, ["hpuse"], "", False), ("qqqqqqqq wwwwwwww", False, ["qqqqqqqq wwwwwwww"], "", False), ("و", False, ["و"], "", False), ("House garden", False, ["House garden"], "", False)],
)
def test_decisions(spark, big, query, force, searched, suggestion, active):
    r = se.check(se.as_queries(spark, [query], force), big).first()
    assert (r.searched, r.active) == (searched, active)
    assert r.suggestion == suggestion or query == "House garden"


def test_both_strings_are_searched(spark):
    few = se.build(corpus.parse_texts(spark.createDataFrame([(1, "tower\n" + "tower " * 12)], "doc_id long, text string")))
    r = se.check(se.as_queries(spark, ["tpwer"]), few).first()
    assert (r.searched, r.suggestion, r.active) == (["tpwer", "tower"], "", False)


def test_suggestions(spark, big):
    got = se.suggestions(se.as_queries(spark, ["the hou", "garden", "", "number"]), big).orderBy("qid", "rank").collect()
    assert [r.text for r in got if r.qid == 0] == ["the house"]
    assert {r.text for r in got if r.qid == 3} == {"number <END>"}
    none = sp.continuations(se.as_queries(spark, ["number"]), big.bigrams, drop_end=True)
    assert none.count() == 0


def test_response(spark, big):
    got = {r.qid: json.loads(r.response) for r in se.respond(se.as_queries(spark, ["hpuse", ""]), big).collect()}
    assert got[0]["success"] and got[0]["result"]["correction"] == {"active": True, "query": "house"} and len(got[0]["result"]["documents"]) == 10
    assert got[1] == {"success": False, "error": "BAD_REQUEST"}


def test_request_parameters():
    assert se.parameters("x", "q", None, "c") == ("t", "r", "n", "c") and se.parameters("b", "l", "p", "z") == ("b", "l", "p", "m")


def test_pages_and_xml(spark, tmp_path):
    html = "<html><head><title>A &amp; B</title><style>p{}</style></head><body><!-- no --><p>one</p><script>var x='</p>';</script><p>two &lt;3</p></body></html>"
    pages = spark.createDataFrame([(1, "u", html), (2, "v", None)], "doc_id long, url string, html string")
    got = rows(corpus.parse_pages(pages, "doc_id"), "doc_id")
    assert (got[1].title, got[1].body) == ("A & B", "onetwo <3") and (got[2].title, got[2].body) == ("", "")
    corpus.write_xml(pages.where("doc_id = 1"), str(tmp_path / "c"))
    (tmp_path / "c" / "other.xml").write_text("<ROOT><DOC><DOCID>9</DOCID></DOC></ROOT>")
    odd = spark.createDataFrame([(1, "u", "<title>&#1587;&eacute;</title><body>&amp;lt; &#x41;")], "doc_id long, url string, html string")
    whole, named = corpus.parse_pages(odd, "doc_id").first(), corpus.parse_pages(odd, "doc_id", corpus.entities).first()
    assert (whole.title, whole.body) == ("سé", "&lt; A") and named.title == "&#1587;&eacute;"
    back = corpus.read_xml(spark, str(tmp_path / "c")).collect()
    assert [(r.doc_id, r.url, r.html) for r in back] == [("1", "u", html)]


def test_stored_index(spark, docs, tmp_path):
    path = str(tmp_path / "index")
    first = se.stored(spark, path, docs)
    again = se.stored(spark, path, docs.limit(0))
    assert again.all_terms.count() == first.all_terms.count() > 0
    free = se.Index(first.docs, first.stats, first.postings, first.all_terms, first.unigrams, first.bigrams, se.Parameters(minor=0))
    q = se.as_queries(spark, ["alpha delta"])
    free.path = str(tmp_path / "v")
    from_disk = [sorted(se.rank(q, free, dis_func="c").collect()) for _ in range(2)]
    assert from_disk[0] == from_disk[1] == sorted(rk.cosine(q, free.postings, free.terms).collect()) != []
    assert (tmp_path / "v" / "doc_units_r").exists()
    assert sorted(p.name for p in (tmp_path / "index").iterdir()) == ["bigrams", "corpus_stats", "docs", "minor_terms", "postings", "rests", "terms", "unigrams"]
    assert sorted(r.term for r in spark.read.parquet(f"{path}/minor_terms").collect()) == sorted(r.term for r in first.all_terms.collect())
    with pytest.raises(ValueError, match="several documents"):
        se.stored(spark, str(tmp_path / "twice"), docs.unionAll(docs.limit(1)))


def test_words_of_the_caller_go_all_the_way(spark):
    lemma = F.create_map(F.lit("houses"), F.lit("house"))
    analyse = lambda t: clean(t, lemma, lambda x: F.replace(x, F.lit("ö"), F.lit("o")))
    docs = corpus.parse_texts(spark.createDataFrame([(1, "höuses\nhöuse"), (2, "tree\nhouses"), (3, "tree\ntree")], "doc_id long, text string"), analyse)
    i = se.build(docs, se.Parameters(minor=0), analyse)
    assert rows(i.postings, "term", "doc_id")["house", 1].tf == 2
    q = se.as_queries(spark, ["höuses"], True, analyse)
    assert {r.doc_id for r in se.search(q, i, ranker="b").collect()} == {1, 2}


def test_suggestion_response(spark, big):
    got = {r.qid: json.loads(r.response) for r in se.respond_suggestions(se.as_queries(spark, ["the hou", "", "و"]), big).collect()}
    assert got[0]["success"] and [x["text"] for x in got[0]["suggestions"]] == ["the house"] and got[0]["suggestions"][0]["score"] > 0
    assert got[1] == {"success": False, "error": "BAD_REQUEST"} and got[2] == {"success": True, "suggestions": []}


def plain_best(choices, follow, own):
    import itertools

    def log_p(seq):
        p = [own.get(seq[0], 0)] if len(seq) == 1 else [follow(a, b) for a, b in zip(seq, seq[1:])]
        return sum(math.log(x) if x else -math.inf for x in p)

    return min((-round(log_p(s), 9), " ".join(s)) for s in itertools.product(*choices))


def test_best_paths_are_those_of_all_readings(spark):
    import random

    r = random.Random(2)
    names = [f"w{i}" for i in range(9)]
    texts = [(i, " ".join(r.choice(names) for _ in range(30)) + "\n") for i in range(5)]
    d = corpus.parse_texts(spark.createDataFrame(texts, "doc_id long, text string"))
    u, b = lm.unigrams(d), lm.bigrams(d)
    uni, pairs = {x.word: x.c for x in u.collect()}, {(x.prev, x.word): x.c for x in b.collect()}
    total, starts = sum(uni.values()) - 1, {w: sum(c for (a, _), c in pairs.items() if a == w) for w in names}
    own = {w: c / total for w, c in uni.items()}
    follow = lambda a, c: 0.9 * (pairs.get((a, c), 0) / starts[a] if starts.get(a) else 0) + 0.1 * own.get(c, 0)
    queries = {k: [sorted(r.sample([*names, "unseen"], r.randrange(1, 4))) for _ in range(n)] for k, n in enumerate((1, 2, 5, 7))}
    rows_ = [(k, len(q), pos, nth, w) for k, q in queries.items() for pos, own_ in enumerate(q) for nth, w in enumerate(own_, 1)] + [(99, 2, 0, 1, "w1")]
    got = {x.key: x for x in sp.best_paths(spark.createDataFrame(rows_, "key int, n int, pos int, nth int, word string"), u, b).collect()}
    assert set(got) == set(queries)
    for k, q in queries.items():
        cost, text = plain_best(q, follow, own)
        assert got[k].log_p == pytest.approx(-cost, abs=1e-8) and (got[k].text == text or cost == math.inf)


def test_a_long_query_takes_seconds(spark, big):
    import time

    began = time.time()
    got = sp.correct(se.as_queries(spark, ["hpuse " * 40]), big.terms, big.unigrams, big.bigrams).first()
    assert got.text == " ".join(["house"] * 40) and math.isfinite(got.log_p) and time.time() - began < 60
