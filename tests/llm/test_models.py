"""The lattice against all segmentations one by one; the classifier by gradients and held-out rows; the extraction on made pages."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspan.llm import lattice, mil, wrappers
from quillspan.llm.common import fold

MODEL = "piece_bpe_32k.model"


def ways(p, word):
    """Every segmentation of the marked word as lists of pieces; a character that is no piece is its bytes."""
    text = lattice.MARK + word

    def go(at):
        if at == len(text):
            yield []
            return
        table = p.inner if at else p.first
        for end in range(at + 1, len(text) + 1):
            if text[at:end] in table:
                for rest in go(end):
                    yield [table[text[at:end]], *rest]
        if at and text[at] not in p.inner:
            for rest in go(at + 1):
                yield [p.byte + b for b in text[at].encode()] + rest

    return list(go(0))


@pytest.fixture(scope="module")
def pieces():
    return lattice.Pieces(MODEL)


@pytest.mark.parametrize("word", ["the", "a", "there,", "größe", "x中y", "▁▁", "q🙂", "", "banana"])
def test_lattice_sums_over_all_segmentations(pieces, word):
    r = np.random.default_rng(2)
    scores = np.stack([pieces.scores(pieces.normalised(r.random(pieces.size)), r.random(pieces.size)) for _ in range(2)], axis=1)
    got = pieces.log_probability([word, "other"], scores)[0]
    for k in range(2):
        assert got[k] == pytest.approx(math.log(sum(way_p(pieces, scores[:, k], w) for w in ways(pieces, word))), rel=1e-9)
    counts = pieces.expect([word, "the"], np.array([3.0, 0.5]), scores[:, 0])
    expected = np.zeros(2 * pieces.size)
    for w, c in ((word, 3.0), ("the", 0.5)):
        own = ways(pieces, w)
        each = np.array([way_p(pieces, scores[:, 0], s) for s in own])
        for s, share in zip(own, each / each.sum()):
            np.add.at(expected, s[:-1], c * share)
            expected[pieces.size + s[-1]] += c * share
    assert np.allclose(counts, expected, atol=1e-9)


def way_p(pieces, scores, way):
    """Probability of one segmentation: pieces that go on, and the last one that ends the word."""
    return math.exp(sum(scores[x] for x in way[:-1]) + scores[pieces.size + way[-1]])


def test_start_is_a_distribution(pieces):
    assert pieces.start[: pieces.split].sum() == pytest.approx(1) and pieces.start[pieces.split :].sum() == pytest.approx(1)


def test_score_query(spark):
    r = random.Random(8)
    stems = ["".join(r.choice("abcdeé") for _ in range(3)) for _ in range(40)]
    texts = [(i, " ".join(r.choice(stems[i % 2 * 20 : i % 2 * 20 + 20]) + r.choice(["", "s", "ed", ","]) for _ in range(r.randrange(60))), "x" if i % 2 else None) for i in range(300)]
    texts += [(400, None, "x"), (401, "", "x"), (None, "aaa BBB\x0bccc d", "x"), (402, "z" * 5000, "x"), texts[5], texts[5]]
    docs = spark.createDataFrame(texts, "doc_id long, text string, class string").withColumn("held_out", fold() == 1)
    rows = [(i, (t or ""), h) for i, t, h in ((r.doc_id, r.text, r.held_out) for r in docs.collect())]
    for frequent in (300_000, 20):
        got = lattice.score(docs, MODEL, frequent=frequent).collect()
        assert len(got) == len(texts)
        counts, ends = {}, 0
        for i, t, h in rows:
            if not h:
                ends += 1
                for w in t.encode().lower().split():
                    counts[w] = counts.get(w, 0) + 1
        n, v = sum(counts.values()) + ends, len(counts) + 1
        base = lambda c: math.log10((c + 0.5) / (n + 0.5 * (v + 1)))
        by = {(x.doc_id, x.held_out): x for x in got}
        for i, t, h in rows:
            w = t.encode().lower().split()
            x = by[i, h]
            assert (x.n_tokens, x.n_known, x.train_tokens) == (len(w) + 1, sum(u in counts for u in w) + 1, n)
            assert x.base_score == pytest.approx(sum(base(counts.get(u, 0)) for u in w) + base(ends), rel=1e-9)
            assert x.score < 0 and math.isfinite(x.score)
        held = [x for x in got if x.held_out and x.n_tokens > 5]
        # classes differ in their words
        assert frequent == 20 or sum(x.score for x in held) > sum(x.base_score for x in held)
    assert lattice.score(docs.limit(0), MODEL).count() == 0
    untrained = lattice.score(docs.withColumn("held_out", F.lit(True)), MODEL).collect()
    assert len(untrained) == len(texts) and all(x.train_tokens == 0 and x.n_known == 0 and math.isfinite(x.score) for x in untrained)


def test_words_that_do_not_travel_have_arcs_too(spark):
    r = random.Random(5)
    stems = ["".join(r.choice("abcdeé") for _ in range(4)) for _ in range(60)]
    texts = [(i, " ".join(r.choice(stems) for _ in range(r.randrange(40))), "x" if i % 2 else "y") for i in range(200)] + [(900, "z" * 300, "x"), (901, "unseen once", "y")]
    docs = spark.createDataFrame(texts, "doc_id long, text string, class string").withColumn("held_out", fold() == 1)
    wide, narrow, none = ({x.doc_id: x.score for x in lattice.score(docs, MODEL, frequent=n).collect()} for n in (300_000, 20, 0))
    assert narrow == pytest.approx(wide, rel=1e-9) and none == pytest.approx(wide, rel=1e-9)


def test_probabilities_of_all_short_words_stay_below_one(pieces):
    scores = pieces.first_scores()[:, None]
    words = [a + b for a in ["", *"abcdefghijklmnopqrstuvwxyz"] for b in "abcdefghijklmnopqrstuvwxyz"]
    assert 0.01 < np.exp(pieces.log_probability(words, scores)).sum() < 1


def test_gradients():
    r = np.random.default_rng(3)
    m = mil.Model()
    m.fitted = True
    bags = [r.normal(size=(n, mil.N_FEATURES)) for n in (1, 4, 2)]
    sizes = np.array([1, 4, 2])
    at, bag, y = np.array([0, 1, 5]), np.repeat(np.arange(3), sizes), np.array([1.0, 0.0, 1.0])
    x = np.concatenate(bags)
    loss = lambda: -np.mean([np.log(p if t else 1 - p) for p, t in zip(m.forward(x, at, bag, 3)[-1], y)])
    for k, g in m.gradients(x, at, bag, y).items():
        flat = m.p[k].reshape(-1)
        for i in r.integers(0, flat.size, 5):
            old = flat[i]
            flat[i] = old + 1e-5
            up = loss()
            flat[i] = old - 1e-5
            down = loss()
            flat[i] = old
            assert g.reshape(-1)[i] == pytest.approx((up - down) / 2e-5, abs=1e-6), k


def test_passages():
    assert mil.passages("").shape == (1, mil.N_FEATURES) and not mil.passages(" \n\t").any()
    assert len(mil.passages("w " * 250)) == 3 and len(mil.passages("🙂 " * 100)) == 1


def test_quality_held_out(spark):
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 9)))
    rows, labels = [], []
    for i in range(500):
        w = [word() for _ in range(r.randrange(20, 400))]
        good = i % 3 > 0
        if not good:  # one bad stretch anywhere tells the label
            at = r.randrange(len(w))
            w[at : at + 60] = [x + "%%$" for x in w[at : at + 60]] + ["$$$"] * 20
        rows.append((i, " ".join(w)))
        labels.append((i, int(good)))
    rows += [(600, None), (601, ""), (None, "some words"), rows[0]]
    labels += [(700, 1), (None, 0), (0, None)]
    docs, lab = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit(9)), spark.createDataFrame(labels, "doc_id long, label int")
    model = mil.train(docs, lab)
    got = mil.score(docs, model, "doc_id").withColumn("held_out", fold() == 0).collect()
    assert len(got) == len(rows) and all(0 <= x.score <= 1 for x in got)
    truth = dict(labels[:500])
    held = [x for x in got if x.held_out and x.doc_id in truth]
    assert len(held) > 50 and np.mean([(x.score >= 0.3) == truth[x.doc_id] for x in held]) > 0.9
    assert mil.train(docs, lab.limit(0)).score([np.zeros((1, mil.N_FEATURES))])[0] == 0.5
    assert mil.score(docs.limit(0), model, "doc_id").count() == 0


def page(n, body, extra="", title="t"):
    return f"""<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style><script>var t="</p>";</script></head><body><header><a>Home {n}</a></header><nav><ul><li>menu {n}</ul></nav>
<div class="cookie-notice">We use cookies {n}</div>{body}<aside>side {n}</aside><div id="comments"><p>reader {n}</div><form>mail <input><button>Go</button></form><footer>&copy; {n}</footer>{extra}</body></html>"""


def text_of(spark, pages):
    df = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(pages)], "page_id long, url string, html string").withColumns({c: F.lit("x") for c in ("host", "key", "text", "wrapper", "vote", "slot", "bytes", "salt", "part")})
    return {r.page_id: r.text for r in wrappers.extract(df).collect()}


def test_article_text(spark):
    article = "<article><header><h1>Ti &amp; tle</h1></header><p><b>One\n  two<br>three<p>fo<i>ur</i> &lt;5&gt;<ul><li>six<li>seven</ul><script>no()</script><!-- no --><div class='ad'>buy</div><p hidden>no</p></article>"
    got = text_of(spark, [("http://h/1", page(1, article)), ("http://h/2", page(2, "<div><p>plain &eacute; page</p></div>")), (None, None), ("no host", ""), ("http://h/1", page(1, article)), ("http://h/other", page(1, article))])
    whole = "Ti & tle One two three four <5> six seven"
    assert got == {0: whole, 1: "plain é page", 2: "", 3: "", 4: whole, 5: whole}


@pytest.mark.parametrize("size", [wrappers.BROADCAST_BYTES, 0])
def test_constant_nodes_are_template(spark, monkeypatch, size):
    monkeypatch.setattr(wrappers, "BROADCAST_BYTES", size)
    monkeypatch.setattr(wrappers, "SALT_PAGES", 7)
    r = random.Random(1)
    pages, expected = [], []
    for i in range(40):
        own = [f"own text {i} {k} {r.random()}" for k in range(r.randrange(1, 6))]
        body = f"<div id='post-{i}'><h2>Site name and motto</h2>" + "".join(f"<p>{x}</p>" for x in own) + "<p>Read more on this site</p></div><div>Imprint</div>"
        pages.append((f"https://u@Host.example:8080/{i}", page(i, body)))
        expected.append(" ".join(own))
    pages.append(("https://other.example/", page(1, "<p>Read more on this site</p>")))
    got = text_of(spark, pages)
    assert [got[i] for i in range(40)] == expected and got[40] == "Read more on this site"


def test_copies_of_one_page_are_no_template(spark):
    same = page(0, "<div><p>the same text everywhere</p></div>")
    assert set(text_of(spark, [("http://h/x", same)] * 30 + [(f"http://h/{i}", same) for i in range(9)]).values()) == {"the same text everywhere"}


def sentence(r, n):
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 9))) for _ in range(n)).capitalize() + "."


@pytest.mark.parametrize("size", [1, 2, 3, 5, 9, 30])
def test_neutral_markup(spark, size):
    """No article or main element, no telling names: the slots alone say which part is the article; hosts of 1 to 30 pages."""
    r = random.Random(size)
    pages, expected = [], []
    for host in range(4):
        for i in range(size):
            menu = "".join(f"<li><a href='/{x}'>{sentence(r, 1)}</a></li>" for x in range(6))
            own = [sentence(r, r.randrange(30, 60)) for _ in range(r.randrange(3, 9))]
            title = sentence(r, 6)
            body = f"<div><ul>{menu}</ul></div><div class='x1'>{sentence(r, 7)}</div><div class='x2 id-{i}' id='n{i}'><h1>{title}</h1>" + "".join(f"<p>{x}</p>" for x in own) + f"</div><div class='x3'>&copy; {sentence(r, 4)}</div>"
            pages.append((f"http://h{host}/{i}", f"<html><body>{body}</body></html>"))
            expected.append(" ".join([title, *own]))
    got = text_of(spark, pages)
    assert [got[i] for i in range(len(pages))] == expected


def test_names_that_only_sound_like_asides_stay(spark):
    r = random.Random(3)
    parts = [("div", "social-science alert-study"), ("section", "discussion"), ("p", "tags-theory")]
    pages, expected = [], []
    for i in range(6):
        own = [sentence(r, 40) for _ in range(4)]
        inside = f"<p>{own[0]}</p>" + "".join(f"<{t} class='{c}'>{x}</{t}>" for (t, c), x in zip(parts, own[1:]))
        pages.append((f"http://h/{i}", page(i, f"<article>{inside}<section class='comments'>" + "".join(f"<div class='c'><b>reader {i}</b><p>{sentence(r, 30)}</p></div>" for _ in range(3)) + "</section></article>")))
        expected.append(" ".join(own))
    got = text_of(spark, pages)
    assert [got[i] for i in range(6)] == expected


def test_text_outside_of_the_landmark_stays(spark):
    r = random.Random(5)
    lead, rest = ([sentence(r, n) for _ in range(5)] for n in (20, 60))
    got = text_of(spark, [(f"http://h/{i}", f"<html><body><main><p>{a}</p></main><div><p>{b}</p><p>{b[::-1]}</p></div></body></html>") for i, (a, b) in enumerate(zip(lead, rest))])
    assert [got[i] for i in range(5)] == [f"{a} {b} {b[::-1]}" for a, b in zip(lead, rest)]


def test_pages_of_several_kinds_on_a_host(spark):
    """Each kind's own region is elected on its pages, and the same advert on all goes."""
    r = random.Random(7)
    pages, expected = [], []
    for i in range(30):
        own = [sentence(r, 30) for _ in range(4)]
        kind = i % 3
        inside = "".join(f"<p>{x}</p>" for x in own)
        body = f"<div class='k{'abc'[kind]}'>{inside}</div>"
        pages.append((f"http://h/{i}", f"<html><body><div class='y1'>Buy this now, dear reader of ours.</div>{'<table><tr><td>' if kind == 2 else ''}{body}{'</td></tr></table>' if kind == 2 else ''}<div class='y2'>{sentence(r, 3)}</div></body></html>"))
        expected.append(" ".join(own))
    got = text_of(spark, pages)
    assert [got[i] for i in range(30)] == expected


def plain_host(htmls):
    """A host's description by counting, from its distinct pages."""
    from collections import Counter, defaultdict

    wrapper = wrappers.wrapper_of(wrappers.induced(htmls))
    pages = {h: wrappers.Page(h, *wrapper) for h in htmls}
    votes, texts, regions = Counter(), Counter(), defaultdict(lambda: [0, 0, 0])
    for p in pages.values():
        if (v := p.vote()) >= 0:
            votes[p.regions[v][0]] += 1
        for key, _, chars, links, *_ in p.regions:
            regions[key] = [x + y for x, y in zip(regions[key], (1, chars, links))]
        texts.update({(p.regions[n][0], key) for n, _, key, _ in p.blocks})
    counts = defaultdict(list)
    for (slot, _), m in texts.items():
        counts[slot].append(m)
    told = {k: (*x, 1 - len(counts[k]) / sum(counts[k]) if counts[k] else 0.0) for k, x in regions.items() if x[0] >= 2}
    return pages, wrappers.Host(told, {key for (_, key), m in texts.items() if m >= 3 and 2 * m >= len(htmls)}, dict(votes))


def test_descriptions_are_those_of_plain_counting(spark):
    """Small hosts of pages that are all samples: the query's texts are those of counts in one place."""
    r = random.Random(9)
    for size in (1, 2, 4, 7):
        pool = [sentence(r, r.randrange(1, 20)) for _ in range(12)]
        htmls = []
        for i in range(size):
            parts = [f"<{t} class='{r.choice(['', 'ad', 'x', f'u{i}', 'comments'])}'>{r.choice(pool)}<a>{r.choice(pool)}</a></{t}>" * r.randrange(3) for t in r.choices(["p", "div", "ul", "section", "nav", "footer", "h1"], k=12)]
            htmls.append(f"<body>{sentence(r, 1)}<div>{''.join(parts[:6])}</div>{''.join(parts[6:])}</body>")
        rows = spark.createDataFrame([(h,) for h in htmls], "html string").selectExpr("html", "xxhash64(html) as k").collect()
        parts = {}
        for x in rows:
            part = x.k % wrappers.SAMPLES
            parts[part] = min(parts.get(part, (x.k, x.html)), (x.k, x.html))
        samples = [h for _, h in parts.values()]
        if len(samples) < len(set(htmls)):
            continue
        pages, host = plain_host(samples)
        expected = [wrappers.article(pages[h], pages[h].vote(), host) for h in htmls]
        got = text_of(spark, [(f"http://one/{i}", h) for i, h in enumerate(htmls)])
        assert [got[i] for i in range(size)] == expected


def tree(spec):
    f = wrappers.Fold(spec[0])
    f.kids = [tree(c) for c in spec[1:]]
    return f


def plain_match(a, b):
    if a.label != b.label:
        return 0
    m = [[0] * (len(b.kids) + 1) for _ in range(len(a.kids) + 1)]
    for i, x in enumerate(a.kids, 1):
        for j, y in enumerate(b.kids, 1):
            m[i][j] = max(m[i - 1][j], m[i][j - 1], m[i - 1][j - 1] + plain_match(x, y))
    return 1 + m[-1][-1]


def test_tree_matching_is_best():
    r = random.Random(4)

    def some(depth):
        return [r.choice("abc"), *[some(depth - 1) for _ in range(r.randrange(4) if depth else 0)]]

    for _ in range(150):
        a, b = tree(["r", *some(3)[1:]]), tree(["r", *some(3)[1:]])
        got = wrappers.match(a, b)
        assert len(got) == plain_match(a, b) and len({id(y) for _, y in got}) == len({id(x) for x, _ in got}) == len(got)
    a, b = (tree(["r", *[[c] for c in r.choices("ab", k=300)]]) for _ in range(2))
    assert len(wrappers.match(a, b)) == plain_match(a, b)


def test_broken_and_deep_pages(spark):
    deep = "<div>" * 5000 + "deep" + "</p>" * 10
    got = text_of(spark, [("http://h/", deep), ("http://h/", "<p>a <b>b</i> c<td>d <a href='x>y'>e</a> < 5 <"), ("http://h/", "<!-- open <p>x"), ("http://h/", "just text"), ("http://h/", "<script>no</script>yes<style>no")])
    assert got == {0: "deep", 1: "a b c d e < 5 <", 2: "", 3: "just text", 4: "yes"}


def test_a_very_long_page(spark):
    long = "".join(f"<p>paragraph {i} of this page.</p><h2>head {i}</h2>" for i in range(3000)) + "<ul>" + "<li>item" * 20_000 + "</ul>"
    got = text_of(spark, [("http://h/", f"<article>{long}</article>"), ("http://h/2", "<article><p>short one.</p></article>")])
    assert got[0].split()[:5] == ["paragraph", "0", "of", "this", "page."] and got[0].count("item") == 20_000 and got[1] == "short one."


def plain_lattice(pieces, docs, lattice_share):
    """Each text's log10 probability from all segmentations, one by one: (text, held out, class) rows."""
    counts, texts = {}, {}
    for t, held, k in docs:
        if not held:
            texts[k] = texts.get(k, 0) + 1
            for w in t.lower().split():
                counts.setdefault(k, {})[w] = counts.setdefault(k, {}).get(w, 0) + 1
    own_ways = {}

    def of(w):
        if w not in own_ways:
            own_ways[w] = ways(pieces, w)
        return own_ways[w]

    scores = {}
    for k in texts:
        s = pieces.first_scores()
        for _ in range(4):
            got = np.zeros(2 * pieces.size)
            for w, c in counts.get(k, {}).items():
                each = np.array([way_p(pieces, s, way) for way in of(w)])
                for way, share in zip(of(w), each / each.sum()):
                    np.add.at(got, way[:-1], c * share)
                    got[pieces.size + way[-1]] += c * share
            s = pieces.learnt(got)
        scores[k] = s

    def word(w, k):
        n = sum(counts.get(k, {}).values())
        lattice = sum(way_p(pieces, scores[k], way) for way in of(w))
        return ((1 - lattice_share) * n * lattice + lattice_share * counts[k].get(w, 0)) / (texts[k] + n)

    ends = sum(texts.values())
    end = {k: texts[k] / (texts[k] + sum(counts.get(k, {}).values())) for k in texts}
    out = [math.log10(sum(texts[k] / ends * math.prod(word(w, k) for w in t.lower().split()) * end[k] for k in texts)) for t, _, _ in docs]
    return out, word, end, counts


@pytest.mark.parametrize("whole", [0.5, 0.3])
def test_scores_are_those_of_all_segmentations(spark, pieces, whole):
    r = random.Random(12)
    stems = ["ab", "the", "ing", "go", "é", "xz"]
    texts = [(i, " ".join(r.choice(stems) + r.choice(["", "s", "er"]) for _ in range(r.randrange(1, 7))), r.choice("uv")) for i in range(60)] + [(900, "unseen abs", "u"), (901, "", "v")]
    docs = spark.createDataFrame(texts, "doc_id long, text string, class string").withColumn("held_out", fold() == 1).withColumns({c: F.lit("clash") for c in ("key", "word", "c", "n_words")})
    rows = docs.select("doc_id", "text", "held_out", "class").collect()
    expected, word, end, counts = plain_lattice(pieces, [(x.text, x.held_out, x["class"]) for x in rows], whole)
    got = {x.doc_id: x.score for x in lattice.score(docs, MODEL, frequent=5, whole=whole).collect()}
    assert [got[x.doc_id] for x in rows] == pytest.approx(expected, rel=1e-9)
    short = {a + b for a in ["", *"abcdefghijklmnopqrstuvwxyzé"] for b in "abcdefghijklmnopqrstuvwxyzé"}
    for k in counts:
        total = end[k] + sum(word(w, k) for w in short | set(counts[k]))
        assert 0.3 < total <= 1 + 1e-9


def test_attention_by_hand():
    """A bag's score by loops, from the definition of gated attention."""
    r = np.random.default_rng(5)
    m = mil.Model()
    m.fitted = True
    m.mean, m.scale = r.normal(size=mil.N_FEATURES), r.random(mil.N_FEATURES) + 0.5
    bags = [r.normal(size=(n, mil.N_FEATURES)).astype(np.float32) for n in (1, 3, 5)]
    p, got = m.p, m.score(bags)
    for bag, y in zip(bags, got):
        hs = [np.tanh(((x - m.mean) / m.scale) @ p["w"] + p["b"]) for x in bag]
        es = [sum(math.tanh(float(h @ p["v"][:, i])) / (1 + math.exp(-float(h @ p["u"][:, i]))) * p["a"][i] for i in range(mil.GATE)) for h in hs]
        weights = [math.exp(e) / sum(map(math.exp, es)) for e in es]
        z = sum(w * h for w, h in zip(weights, hs))
        assert y == pytest.approx(1 / (1 + math.exp(-(float(z @ p["c"]) + p["d"][0]))), rel=1e-6)


def test_training_is_bounded(spark):
    """An id of many rows counts once, and texts beyond the bytes that the driver holds aren't taken."""
    rows = [(1, f"text number {i} of one id") for i in range(500)] + [(i, f"good words here {i}" if i % 2 else f"bad %%% words {i}") for i in range(2, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 40)], "doc_id long, label int")
    held = []
    plain = mil.Model.fit
    mil.Model.fit = lambda self, bags, y: held.append(len(bags)) or plain(self, bags, y, epochs=1)
    try:
        mil.train(docs, labels)
        mil.train(docs, labels, max_bytes=100)
        mil.train(docs, labels, max_train=7)
    finally:
        mil.Model.fit = plain
    n = len({i for i in range(1, 40)}) - labels.where(fold() == 0).count()
    assert held[0] == n and 1 <= held[1] <= 100 // 15 and held[2] == 7
