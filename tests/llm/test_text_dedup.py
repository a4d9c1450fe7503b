"""Joins and removals against brute force."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspan.llm import decontaminate as dc
from quillspan.llm import line_dedup, ngram_join
from quillspan.llm import substring_dedup as sd

SCHEMA = "doc_id long, text string, source string, lang string, n_chars long"


def words(r, n, size=400):
    return [f"w{r.randrange(size)}x{r.randrange(size)}" for _ in range(n)]


def family(r, base, n):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(r.randrange(4)):
            w[r.randrange(len(w))] = f"e{r.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def corpus(seed=1, n=60):
    r = random.Random(seed)
    texts = [" ".join(words(r, r.randrange(3, 90))) for _ in range(n)]
    for _ in range(6):
        texts += family(r, words(r, 80), 8)
    texts += ["", "  ", None, "one two", "One  two", "a b c d", texts[0], texts[0], texts[1].upper()]
    return [(i, t) for i, t in enumerate(texts)]


def shingles(t):
    w = (t or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    links = Counter()
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if (a == b) or (a and b and len(a & b) / len(a | b) >= 0.8):
                links[i] += 1
                links[j] += 1
                x, y = top(i), top(j)
                parent[max(x, y)] = min(x, y)
    return {rows[i][0]: (min(rows[k][0] for k in range(len(rows)) if top(k) == top(i)), links[i]) for i in range(len(rows))}


@pytest.mark.parametrize("block", [400, 3])
def test_ngram_join(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"v": F.lit(1), "root": F.lit(2), "set_key": F.lit("x")})
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.classify(docs).collect()}
    assert got == brute(rows)


def test_bands():
    bands, rows = ngram_join.bands_for(0.8, 0.999)
    assert bands * rows <= 128 and 1 - (1 - 0.8**rows) ** bands >= 0.999


def test_long_chains_are_one_component(spark):
    edges = [(bytes([i]), bytes([i + 1])) for i in range(60)] + [(bytes([100]), bytes([102])), (bytes([101]), bytes([102]))]
    got = {bytes(r.v)[0]: bytes(r.root)[0] for r in ngram_join.components(spark.createDataFrame([(bytearray(a), bytearray(b)) for a, b in edges], "v binary, w binary")).collect()}
    assert all(got[i] == 0 for i in range(61)) and got[101] == got[102] == got[100] == 100


def test_one_of_each_keeps_one_row(spark):
    rows = corpus(2)
    docs = spark.createDataFrame([(i, t, "s", "en", 0) for i, t in [*rows, rows[0], (None, rows[5][1])]], SCHEMA)
    kept = ngram_join.one_of_each(docs)
    classes = {c for c, _ in brute(rows).values()}
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(classes)
    assert ngram_join.one_of_each(docs.limit(0)).count() == 0 and ngram_join.classify(docs.limit(0)).count() == 0


def plain_lines(rows, least):
    sites = {}
    pages = {}
    for _, t, s, *_ in rows:
        for line in (t or "").split("\n"):
            if n := " ".join(line.replace("\x0b", " ").replace("\f", " ").replace("\t", " ").replace("\r", " ").split(" ")).strip(" "):
                n = " ".join(x for x in n.split(" ") if x)
                k = (n, t)
                pages[k] = min(pages.get(k, s or ""), s or "")
    for (n, _), s in pages.items():
        sites.setdefault(n, set()).add(s)
    return {n for n, s in sites.items() if len(s) >= least}


def test_line_dedup(spark):
    r = random.Random(3)
    common = ["all rights reserved", "menu home", "only  here", "\tmenu   home "]
    rows = []
    for i in range(120):
        lines = [" ".join(words(r, 4)) for _ in range(r.randrange(4))] + [r.choice(common)] * r.randrange(3) + [""] * r.randrange(2)
        r.shuffle(lines)
        rows.append((i, "\n".join(lines), f"s{r.randrange(14)}", "en", 0))
    copied = "copied text\nof many sites"
    rows += [(200 + i, copied, f"s{i}", "en", 0) for i in range(14)] + [(300, None, None, None, None), (301, "", None, None, None), rows[0]]
    bad = plain_lines(rows, 10)
    assert bad >= {"all rights reserved", "menu home"} and "copied text" not in bad
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"line": F.lit(1), "page": F.lit(1)})
    got = line_dedup.remove_boilerplate(docs, "source", 10, "n", "m").collect()
    assert len(got) == len(rows)
    by = {x.doc_id: x for x in got}
    for i, t, *_ in rows:
        if t is None:
            assert by[i].text is None and by[i].m == 0
            continue
        kept = [x for x in t.split("\n") if " ".join(x.replace("\t", " ").split()) not in bad or not x.strip()]
        assert by[i].text == "\n".join(kept) and by[i].n == len(t.split("\n")) and by[i].m == by[i].n - len(kept)


def test_exact_counts_decide_near_the_threshold(spark):
    rows = [(i, f"line {i % 9}\nnine sites", f"s{i % 9}", "en", 0) for i in range(40)] + [(50 + i, f"own {i}\nten sites", f"s{i}", "en", 0) for i in range(10)]
    got = line_dedup.boilerplate(spark.createDataFrame(rows, SCHEMA), "source", 10, margin=0.5)[1].collect()
    assert [r.n_sites for r in got] == [10]


def plain_sentences(text):
    """Parts that make up the text, after the white space before its first word; each with what stands after it."""
    import re

    import xxhash

    found = [(m.group(), m.start(), m.end()) for m in re.finditer(r"\S+", text)]
    ends = []
    for k, (w, _, end) in enumerate(found):
        after = text[end : found[k + 1][1]] if k + 1 < len(found) else "\n"
        ends.append(w.rstrip("\"')]}»”’")[-1:] in tuple(".!?。！？…") or "\n" in after)
    parts, now = [], []
    for k, e in enumerate(ends):
        now.append(k)
        if e:
            long = len(now) > sd.LONG
            for j in now:
                if j == now[-1] or long and (xxhash.xxh64_intdigest(found[j][0].lower()) >> 1) % sd.CUT == 0:
                    parts.append(j + 1)
            now = []
    borders = [found[p][1] if p < len(found) else len(text) for p in parts]
    starts = [found[0][1], *borders[:-1]] if parts else []
    return [(text[a:b], [w.lower() for w, _, _ in found[i:j]]) for a, b, i, j in zip(starts, borders, [0, *parts[:-1]], parts)]


def plain_runs(text):
    own = plain_sentences(text)
    out = []
    for k in range(len(own)):
        n = 0
        for j in range(k, len(own)):
            n += len(own[j][1])
            if j - k + 1 >= sd.RUN and n >= sd.RUN_WORDS:
                out.append((k, j + 1, tuple(w for _, x in own[k : j + 1] for w in x)))
                break
    return own, out


def test_substring_dedup(spark):
    r = random.Random(4)
    sentence = lambda n: " ".join(words(r, n)).capitalize() + r.choice([".", "!", "?", '."'])
    passages = [" ".join(sentence(r.randrange(2, 20)) for _ in range(6)) for _ in range(3)] + [" ".join(words(r, 90))]
    rows = []
    for i in range(50):
        parts = [sentence(r.randrange(1, 60)) for _ in range(r.randrange(1, 12))]
        if i % 3 == 0:
            parts.insert(r.randrange(len(parts) + 1), r.choice(passages))
        rows.append((i, r.choice(["", " \n "]) + r.choice([" ", "\n", "  "]).join(parts) + r.choice(["", " "])))
    rows += [(60, rows[3][1]), (61, rows[3][1]), (62, ""), (63, None), (64, "..! ?\n\n"), (65, passages[0] + " " + passages[0]), (None, passages[1]), rows[3]]
    first = {}
    for i, t in rows:
        for lo, _, w in plain_runs(t or "")[1]:
            first[w] = min(first.get(w, ((True, 10**9), 0)), ((i is None, i or 0), lo))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"key": F.lit("a"), "spans": F.lit(0), "a": F.lit(1)})
    got = Counter((x.doc_id, x.text) for x in sd.remove_repeats(docs, n_sentences="n", n_removed="m").collect())
    expected = Counter()
    for i, t in rows:
        parts, found = plain_runs(t or "")
        gone = {k for lo, hi, w in found if first[w] != ((i is None, i or 0), lo) for k in range(lo, hi)}
        head = (t or "")[: len(t or "") - len((t or "").lstrip())] if parts else ""
        assert not parts or head + "".join(p for p, _ in parts) == t
        expected[i, head + "".join(p for k, (p, _) in enumerate(parts) if k not in gone) if gone else t] += 1
    assert got == expected
    left = " ".join(t or "" for (_, t), n in got.items())
    assert all(left.count(p[len(p) // 2 - 20 : len(p) // 2 + 20]) == 1 for p in passages)
    assert sd.remove_repeats(docs.limit(0)).count() == 0


def plain_sw(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), dtype=int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (dc.MATCH if a[i - 1] == b[j - 1] else dc.MISMATCH), h[i - 1, j] + dc.GAP, h[i, j - 1] + dc.GAP)
    return h.max()


def test_alignment():
    r = np.random.default_rng(1)
    for _ in range(200):
        a, b = r.integers(0, 6, r.integers(1, 14)).astype(np.uint64), r.integers(0, 6, r.integers(1, 30)).astype(np.uint64)
        assert dc.align(a, b)[0] == plain_sw(a, b)


@pytest.mark.parametrize("block_bytes", [10**7, 600])
def test_leaks(spark, block_bytes):
    r = random.Random(6)
    items = [(i, " ".join(words(r, r.randrange(15, 50)))) for i in range(30)] + [(99, "too short"), (96, "lonely"), (98, None), (97, "")]
    rows, planted = [], set()
    for i in range(200):
        w = words(r, r.randrange(0, 200))
        if i % 4 == 0:
            k = r.randrange(30) if i % 8 else 7  # one item leaks often
            copy = items[k][1].split()
            for _ in range(len(copy) // 8):
                at = r.randrange(len(copy))
                copy[at : at + 1] = r.choice([[], ["new"], [copy[at], "more"], [copy[at].upper() + ","]])
            at = r.randrange(len(w) + 1)
            w[at:at] = copy
            planted.add((i, k))
        rows.append((i, " ".join(w)))
    rows += [(500, None), (501, ""), (None, items[3][1]), (502, "it is Too short, really"), (503, "too very short"), (504, "a lonely word")]
    planted |= {(None, 3)}
    brief = {(502, 99), (504, 96)}
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(0) for c in ("item_id", "_key", "_id", "text_key", "score")})
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = dc.find_leaks(docs, bench, block_bytes=block_bytes).collect()
    assert {(x.doc_id, x.item_id) for x in got} == planted | brief
    texts, long = dict(rows), dict(items)
    for x in got:
        if x.doc_id is not None:
            item = long[x.item_id]
            part = " ".join(texts[x.doc_id].split()[x.first_word : x.first_word + x.n_words])
            assert plain_sw(dc.word_hashes(item), dc.word_hashes(part)) / (2 * len(item.split())) == x.score
    kept = dc.drop_leaks(docs, bench)
    # a word or two of an item are no reason to drop a text
    assert kept.columns == docs.columns and {x.doc_id for x in kept.collect()} == {i for i, _ in rows} - {i for i, _ in planted}
    assert dc.find_leaks(docs.limit(0), bench).count() == 0 and dc.find_leaks(docs, bench.limit(0)).count() == 0


@pytest.mark.parametrize("share", [0.15, 0.2, 0.25, 0.3])
def test_leaks_are_those_of_full_alignment(spark, share):
    r = random.Random(share)
    items = [(i, " ".join(words(r, r.choice([3, 4, 5, 8, 20, 35]), 30))) for i in range(24)]
    texts = []
    for i in range(240):
        copy = items[i % 24][1].split()
        if i >= 24:  # beside an exact copy of each, edited ones
            for at in sorted(r.sample(range(len(copy)), max(1, round(share * len(copy)))), reverse=True):
                copy[at : at + 1] = r.choice([["new"], ["new"], [], [copy[at], "more"]])
        texts.append(" ".join([*words(r, r.randrange(40), 30), *copy, *words(r, r.randrange(40), 30)]))
    texts += [" more ".join(t.split()) for _, t in items]
    expected = {}
    for d, t in enumerate(texts):
        for i, item in items:
            a = dc.word_hashes(item)
            if (score := dc.align(a, dc.word_hashes(t))[0] / (dc.MATCH * len(a))) >= 0.5:
                expected[d, i] = score
    got = dc.find_leaks(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(x.doc_id, x.item_id): x.score for x in got} == expected


def test_every_passage_over_50_words_holds_a_run():
    r = random.Random(12)
    for i in range(3000):
        every = r.choice([0, 0.02, 0.04, 0.1])  # share of words that end a sentence
        passage, before, after, other, last = ([w + "." * (r.random() < every) for w in words(r, n, 30)] for n in (51, r.randrange(60), r.randrange(60), r.randrange(60), r.randrange(60)))
        own = [set(found_runs(" ".join([*a, *passage, *b]))) for a, b in ((before, after), (other, last))]
        assert own[0] & own[1], (i, every)


def found_runs(text):
    h, ends = sd.sentences(text)
    _, _, a, b, _ = sd.runs(h, ends)
    return zip(a.tolist(), b.tolist())


def test_edges_of_a_large_group_grow_with_its_members(spark):
    """4,000 near copies of one text, over several blocks: edges stay at a small multiple of members, links are exact."""
    r = random.Random(21)
    base = words(r, 120)
    rows = []
    for i in range(4000):
        w = list(base)
        w[r.randrange(len(w))] = f"e{i}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    made = []
    plain = ngram_join.components
    ngram_join.components = lambda edges: made.append(edges.count()) or plain(edges)
    try:
        got = {x.doc_id: (x.class_id, x.n_links) for x in ngram_join.classify(docs).collect()}
    finally:
        ngram_join.components = plain
    bands = ngram_join.bands_for(0.8)[0]
    assert made[0] <= bands * len(rows) and made[1] < len(rows) + 100
    sets = [ngram_join.ngrams(t, 5) for _, t in rows]
    for i in range(0, 4000, 97):
        links = sum(len(np.intersect1d(sets[i], s, assume_unique=True)) >= 0.8 / 1.8 * (len(sets[i]) + len(s)) - 1e-9 for s in sets) - 1
        assert got[i] == (0, links)


def test_pairs_of_blocks_give_an_edge_for_two_trees():
    left, right = np.array([0, 0, 2, 3]), np.array([0, 1, 1])
    links = {(1, 0), (1, 2), (0, 1), (2, 1), (2, 2)}
    got = ngram_join.bridges(left, right, lambda i, others: np.array([(i, int(j)) in links for j in others], dtype=bool))
    assert len(got) == 3 and set(got) <= links


def test_very_long_texts_make_blocks_of_few(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_BYTES", 200_000)
    r = random.Random(22)
    long = words(r, 60_000, 10**6)
    rows = [(i, " ".join([*long, f"end{i}"])) for i in range(4)] + [(9, "short one")]
    got = {x.doc_id: (x.class_id, x.n_links) for x in ngram_join.classify(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: (0, 3), 1: (0, 3), 2: (0, 3), 3: (0, 3), 9: (9, 0)}


def test_very_long_texts(spark):
    """A text of a million words goes through each removal whole."""
    r = random.Random(31)
    pool = words(r, 5000, 10**6)
    sentences = [" ".join(r.choices(pool, k=20)) + "." for _ in range(50_000)]
    passage, item = " ".join(" ".join(words(r, 12)) + "." for _ in range(6)), " ".join(words(r, 30))
    long = "\n".join([*sentences[:25_000], "all sites have this line", passage, item, *sentences[25_000:]])
    rows = [(1, long, "s0", "en", 0)] + [(10 + i, f"own text {i}\nall sites have this line", f"s{i}", "en", 0) for i in range(12)] + [(90, passage, "s1", "en", 0)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("_bad", "_page", "_kept", "_text", "_spans", "_own", "_key", "_id", "_scored_text")})
    lines = {x.doc_id: x for x in line_dedup.remove_boilerplate(docs, "source", 10).collect()}
    assert lines[1].text == long.replace("all sites have this line\n", "") and lines[10].text == "own text 0"
    cut = {x.doc_id: x.text for x in sd.remove_repeats(docs).collect()}
    assert cut[1] == long and passage[100:300] not in cut[90]
    bench = spark.createDataFrame([(5, item)], "item_id long, text string")
    assert [(x.doc_id, x.item_id, x.score) for x in dc.find_leaks(docs, bench).collect()] == [(1, 5, 1.0)]
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns and {1, 90} <= {x.doc_id for x in kept.collect()}
