"""Column functions against hand-made values and independent plain models."""

import re

import pytest
from pyspark.sql import functions as F

from quillspan.functions import analysis as an
from quillspan.functions import lexicon as lx
from quillspan.operators import spelling as sp


def one(spark, expr, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(expr).first()[0]


@pytest.mark.parametrize(
    "text,words",
    [
        ("Hello, World! a b2", ["hello", "world", "b2"]),
        ("كتاب علي", ["کتاب", "علی"]),
        ("می‌روم و خانه", ["روم", "خانه"]),
        (lx.SYMBOLS, []),
        ("", []),
        (None, []),
        ("x y z 1", []),
        ('say "hi" @you', ["say", '"hi"', "@you"]),
    ],
)
def test_clean(spark, text, words):
    assert one(spark, an.clean(F.col("t")), t=text) == words


def test_lemmas_are_filtered_again(spark):
    lemma = F.create_map(F.lit("books"), F.lit("book"), F.lit("went"), F.lit("و"))
    assert one(spark, an.clean(F.col("t"), lemma), t="books went far") == ["book", "far"]


def test_bigrams_and_digits(spark):
    assert one(spark, an.bigrams(an.clean(F.col("t"))), t="one two three") == ["one two", "two three"]
    assert one(spark, an.bigrams(an.clean(F.col("t"))), t="one") == []
    assert one(spark, an.digits_to_words(an.tokenize(F.col("t"))), t="۱ کتاب ۹") == ["یک", "کتاب", "نه"]


def test_neighbours():
    assert lx.NEIGHBOURS["]"] == ["[", "\\"]
    assert lx.NEIGHBOURS["p"] == ["o", "[", ";", "l"]
    assert lx.NEIGHBOURS["l"] == ["k", ";", "o"]
    assert lx.NEIGHBOURS["q"] == ["w", "a"]
    assert lx.NEIGHBOURS["m"] == ["n", ",", "j", "k"]
    assert lx.NEIGHBOURS["آ"] == lx.NEIGHBOURS["ا"]


def plain_edits(word):
    letters = lx.ALPHABETS["en" if word and word[0] in "".join(lx.KEYBOARDS["en"]) else "fa"]
    out = set()
    for i in range(len(word) + 1):
        a, b = word[:i], word[i:]
        out |= {a + c + b for c in letters}
        if b:
            out |= {a + b[1:]} | {a + c + b[1:] for c in lx.NEIGHBOURS.get(b[0], [])}
        if len(b) > 1:
            out.add(a + b[1] + b[0] + b[2:])
    return out


@pytest.mark.parametrize("word,size", [("a", 56), ("the", 120), ("search", 215), ("onre", 149), ("zq", 84), ("سلام", None), ("l]p", None), ("", None)])
def test_edits(spark, word, size):
    got = one(spark, an.edits(F.col("w")), w=word)
    assert set(got) == plain_edits(word) and len(got) == len(set(got))
    assert size is None or len(got) == size


@pytest.mark.parametrize("word", ["the", "ab", "aab", "l]p", "سلا"])
def test_two_edits(spark, word):
    """Of all strings at two edits, each is found, and none else."""
    two = {x for e in plain_edits(word) for x in plain_edits(e)} | plain_edits(word) | {word}
    far = {x + "qzqzq" for x in list(two)[:50]} | {x[::-1] + "xx" for x in list(two)[:50]}
    some = sorted(two)[:: max(1, len(two) // 3000)] + sorted(far)
    vocabulary = spark.createDataFrame([(t,) for t in some if t], "term string")
    got = {r.candidate for r in sp.near_words(spark.createDataFrame([(word,)], "word string"), vocabulary).collect()}
    swap = one(spark, an.layout_swap(F.col("w")), w=word)
    assert got == {t for t in some if t and (t in two or t == swap)}


@pytest.mark.parametrize("word,swapped", [("sghl", "سلام"), ("سلام", "sghl"), ("aس", None), ("l]p", "مچح"), ("آژ", "hc"), ("1", ",")])
def test_layout_swap(spark, word, swapped):
    assert one(spark, an.layout_swap(F.col("w")), w=word) == swapped


def plain_snippet(body, query):
    found = [m.start() for m in re.finditer(re.escape(query), body)] if query else []
    if not body or not found:
        return body[:100] + "..."
    counts = [sum(x <= y < x + 160 for y in found) for x in found]
    at = found[counts.index(max(counts))]
    left, right = body[: max(0, at - 20)], body[: min(len(body), at + 180)]
    beg = left.rfind(" ") + 1
    end = right.rfind(" ") if " " in right else len(body) - 1
    return "..." + body[beg:end].replace(query, f"<b>{query}</b>") + "..."


@pytest.mark.parametrize("query", ["ab", "b a", "zz", "a.b", "", "ab ab"])
def test_snippets(spark, query):
    import random

    r = random.Random(3)
    bodies = ["", "ab", "ab" * 80, "x" * 300 + " ab", "ab " + "y" * 400] + ["".join(r.choice("ab. xyz ") for _ in range(r.randrange(500))) for _ in range(60)]
    rows = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i int, b string").select("i", an.snippet(F.col("b"), F.lit(query)).alias("s")).collect()
    for i, s in rows:
        assert s == plain_snippet(bodies[i], query), (bodies[i], query)


def test_snippet_takes_patterns(spark):
    assert one(spark, an.snippet(F.col("b"), F.lit("a+"), regex=True), b="x aa y a+ z w") == "...x aa y <b>a+</b> z..."


def plain_distance(a, b):
    """All ways by memory, without a table."""
    from functools import cache

    @cache
    def d(i, j):
        if i == 0 or j == 0:
            return i + j
        cost = 0 if a[i - 1] == b[j - 1] else 1 if b[j - 1] in lx.NEIGHBOURS.get(a[i - 1], ()) else 2
        ways = [d(i - 1, j) + 1, d(i, j - 1) + 1, d(i - 1, j - 1) + cost]
        if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
            ways.append(d(i - 2, j - 2) + 1)
        return min(ways)

    return d(len(a), len(b))


def test_weighted_distance(spark):
    pairs = [("the", "teh"), ("", "ab"), ("search", "seatch"), ("q", "p"), ("ab", "ba"), ("زمین", "ضمین"), (None, "a"), ("kitten", "sitting")]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", sp.weighted_distance("a", "b").alias("d")).collect()
    assert [r.d for r in got] == [None if a is None else plain_distance(a, b) for a, b in pairs]
