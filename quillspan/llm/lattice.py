"""Language-model scoring over a subword lattice.

Every way to cut a word into pieces of an existing vocabulary counts, each
weighed by the product of its pieces' probabilities and of a stop, and a forward
recursion in log space sums over all of them.  The vocabulary is that of a public
tokenizer.  Its own scores order the pieces by rank and are the start;
expectation maximisation over all training tokens then turns them into
probabilities, one set for each of a few classes of texts.  The lattice has
1 - ``whole`` of a class's words; the rest goes to one more arc from start to end of
each word, weighed by the word's share of the class's training words, so that what
is gathered grows with the corpus.  One formula holds for every word, however
often it was seen.  A document's probability is the sum over classes of the
class's share times the product of its words and its end.  Pieces that begin a
word sum to one, those within it too, each piece either ends the word or goes on,
and arcs, lattice and end sum to one: the whole is a proper distribution.

Counts, the base score and the expectation steps cover all training rows.
Frequent words, ``frequent`` of them at most, travel with the tasks; all others
are counted per document and meet their counts and arcs by a join, with the same
results, so nothing that grows with the corpus is held in one place.

Defined results: a null text counts as the empty one, whose only token is the
end; a null id counts as the empty id; equal rows get equal scores, each its own
row; a null class is a class of its own; without training rows counts are 0, and
the scores come from the vocabulary alone.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import claim, fold, map_batches, text_key, text_of, written
from .tokens import tokenizer_path

MARK = "▁"
LOG10 = math.log(10)
#: Words of more bytes than this do not travel with the tasks.
LONG_WORD = 200
#: Words whose lattices are summed together.
WORDS_AT_ONCE = 8000
#: Share of pieces that end a word, before any is counted.
START_END = 1 / 3


def words_of(text: str) -> list[bytes]:
    """Words between ASCII white space, A to Z in lower case."""
    return text.encode().lower().split()


class Pieces:
    """A sentencepiece vocabulary for lower-case words: pieces that begin a word, pieces within it, bytes."""

    def __init__(self, model: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(model))
        own = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        rank = {p: -sp.get_score(i) for i in own if (p := sp.id_to_piece(i)) == p.lower() and MARK not in p[1:]}
        rank.setdefault(MARK, 0.0)
        first = [p for p in rank if p[0] == MARK]
        inner = [p for p in rank if p[0] != MARK]
        self.first = {p: n for n, p in enumerate(first)}
        self.inner = {p: n for n, p in enumerate(inner, len(first))}
        self.byte = len(rank)  # the piece of byte 0
        self.size = self.byte + 256
        self.split = len(first)
        self.trie = Trie(self.first, self.inner)
        #: Scores of this vocabulary are ranks: a piece's probability falls with its rank, bytes come last.
        self.start = self.normalised(1 / (np.array([rank[p] for p in first + inner] + [10.0 * len(rank)] * 256) + 10))

    def normalised(self, weights: np.ndarray) -> np.ndarray:
        return np.concatenate([x / x.sum() for x in (weights[: self.split], weights[self.split :])])

    def scores(self, pieces: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Natural logs of pieces where they go on, then of pieces where they end the word."""
        return np.concatenate([np.log(pieces) + np.log1p(-ends), np.log(pieces) + np.log(ends)])

    def first_scores(self) -> np.ndarray:
        return self.scores(self.start, np.full(self.size, START_END))

    def lattice(self, words: list[str]) -> Arcs:
        """The lattices of words, marked: all their arcs as arrays, by end, then word.

        A character that is no piece is its bytes, an arc of a kind of its own.
        """
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
        codes = np.frombuffer("".join([MARK + w for w in words]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        base = np.cumsum(sizes) - sizes
        of = np.repeat(np.arange(len(words)), sizes)
        at = np.arange(len(codes)) - base[of]
        begin, length, piece, alone = self.trie.walk(codes, at, sizes[of] - at)
        spelt, kind = np.unique(codes[alone], return_inverse=True)
        begin, length, piece = np.concatenate([begin, alone]), np.concatenate([length, np.ones(len(alone), dtype=np.int64)]), np.concatenate([piece, self.size + kind])
        word, start = of[begin], at[begin]
        end = start + length
        order = by_two(end, word)
        word, start, end, piece = word[order], start[order], end[order], piece[order]
        spellings = [[self.byte + b for b in chr(c).encode("utf-8", "surrogatepass")] for c in spelt.tolist()]
        return Arcs(word, start, end, piece + (end == sizes[word]) * (self.size + len(spellings)), sizes, spellings)

    def log_probability(self, words: list[str], scores: np.ndarray) -> np.ndarray:
        """Natural logs of words' probabilities by each of the classes' scores, which are columns."""
        if not words:
            return np.zeros((0, scores.shape[1]))
        arcs = self.lattice(words)
        return arcs.forward(arcs.spelt(scores, self.size))[arcs.last]

    def expect(self, words: list[str], weights: np.ndarray, score: np.ndarray) -> np.ndarray:
        """Expected counts of pieces that go on, then of pieces that end the word, over words with their weights."""
        arcs = self.lattice(words)
        score = arcs.spelt(score[:, None], self.size)
        a = arcs.forward(score)[:, 0]
        share = np.zeros_like(a)  # of all segmentations, those that pass a place
        share[arcs.last] = weights
        got = np.exp(a[arcs.from_] + score[arcs.piece, 0] - a[arcs.to])
        for lo, hi in reversed(arcs.levels):
            got[lo:hi] *= share[arcs.to[lo:hi]]
            np.add.at(share, arcs.from_[lo:hi], got[lo:hi])
        counts = np.bincount(arcs.piece, weights=got, minlength=len(score))
        width = len(score) // 2
        goes, ends = counts[: self.size].copy(), counts[width : width + self.size].copy()
        for k, spelling in enumerate(arcs.spellings, self.size):
            np.add.at(goes, spelling[:-1], counts[k] + counts[width + k])
            goes[spelling[-1]] += counts[k]
            ends[spelling[-1]] += counts[width + k]
        return np.concatenate([goes, ends])

    def learnt(self, counts: np.ndarray, prior: float = 100.0, prior_end: float = 1.0) -> np.ndarray:
        """Scores from expected counts, the start weighing as ``prior`` of them and each piece's end as ``prior_end``."""
        goes, ends = counts[: self.size], counts[self.size :]
        mean = (ends.sum() + START_END) / (counts.sum() + 1)
        return self.scores(self.normalised(goes + ends + prior * self.start), (ends + prior_end * mean) / (goes + ends + prior_end))


def by_two(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Order by first, then second; small numbers are sorted by their digits."""
    if not len(first) or max(first.max(), second.max()) >= 1 << 16:
        return np.lexsort((second, first))
    order = np.argsort(second.astype(np.uint16), kind="stable")
    return order[np.argsort(first[order].astype(np.uint16), kind="stable")]


class Trie:
    """Prefixes of pieces as states; walks from all places of many words go on together, character by character."""

    def __init__(self, first: dict[str, int], inner: dict[str, int]):
        steps: dict[tuple[int, str], int] = {}
        piece = [-1, -1]  # of the roots: of pieces that begin a word, and of those within it
        for root, table in enumerate((first, inner)):
            for p, n in table.items():
                state = root
                for c in p:
                    if (state, c) not in steps:
                        steps[state, c] = len(piece)
                        piece.append(-1)
                    state = steps[state, c]
                piece[state] = n
        keys = np.array([(s << 21) + ord(c) for s, c in steps], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.next, self.piece = keys[order], np.array(list(steps.values()), dtype=np.int64)[order], np.array(piece, dtype=np.int64)
        self.bits = np.zeros(1 << 20, dtype=bool)  # passes over nearly all steps that there aren't
        self.bits[self.slot(self.keys)] = True

    @staticmethod
    def slot(keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)

    def walk(self, codes: np.ndarray, at: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(place, length, piece) of every piece at every place, and places within words whose character is no piece."""
        place, state = np.arange(len(codes)), (at > 0).astype(np.int64)
        found, alone, length = [], np.zeros(0, dtype=np.int64), 0
        while place.size:
            key = (state << 21) + codes[place + length]
            here = np.flatnonzero(self.bits[self.slot(key)])
            near = np.minimum(np.searchsorted(self.keys, key[here]), len(self.keys) - 1)
            same = self.keys[near] == key[here]
            here, state = here[same], self.next[near[same]]
            length += 1
            piece = self.piece[state]
            if length == 1:
                single = np.zeros(len(codes), dtype=bool)
                single[place[here][piece >= 0]] = True
                alone = np.flatnonzero(~single & (at > 0))
            place = place[here]
            own = piece >= 0
            found.append((place[own], np.full(int(own.sum()), length), piece[own]))
            on = left[place] > length
            place, state = place[on], state[on]
        if not found:
            return alone, alone, alone, alone
        return *(np.concatenate(x) for x in zip(*found)), alone


class Arcs:
    """Arcs of many words' lattices.  A word's places have numbers after one another, over all words."""

    def __init__(self, word, start, end, piece, sizes, spellings):
        base = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
        self.from_, self.to, self.piece = base[word] + start, base[word] + end, piece
        self.n_places, self.last, self.first, self.spellings = int((sizes + 1).sum()), base + sizes, base, spellings
        cuts = np.flatnonzero(np.diff(end)) + 1
        self.levels = list(zip([0, *cuts.tolist()], [*cuts.tolist(), len(end)]))

    def spelt(self, scores: np.ndarray, size: int) -> np.ndarray:
        """scores of pieces that go on and that end, each with a row for each spelt character: only its last byte may end the word."""
        goes, ends = scores[:size], scores[size:]
        on = [goes[s].sum(axis=0, keepdims=True) for s in self.spellings]
        off = [goes[s[:-1]].sum(axis=0, keepdims=True) + ends[s[-1:]] for s in self.spellings]
        return np.concatenate([goes, *on, ends, *off])

    def forward(self, scores: np.ndarray) -> np.ndarray:
        """Natural logs of the probability of all ways to each place, by class: all words' places of one distance at once."""
        a = np.zeros((self.n_places, scores.shape[1]))
        for lo, hi in self.levels:
            terms = a[self.from_[lo:hi]] + scores[self.piece[lo:hi]]
            to = self.to[lo:hi]
            at = np.concatenate([[0], np.flatnonzero(np.diff(to)) + 1])
            top = np.maximum.reduceat(terms, at)
            each = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(to))))
            a[to[at]] = top + np.log(np.add.reduceat(np.exp(terms - top[each]), at))
        return a


_pieces: dict[str, Pieces] = {}


def pieces_for(model: str) -> Pieces:
    claim("pieces", _pieces.clear)
    if model not in _pieces:
        _pieces[model] = Pieces(model)
    return _pieces[model]


def word_counts(docs: DataFrame, class_col: str = "class") -> DataFrame:
    """(word, class, c): words of all texts, as binary; and each class's texts under the null word."""

    def make():
        def out(counts):
            rows = [(w, k, c) for k, own in counts.items() for w, c in own.items()]
            return dict(zip(("word", "class", "c"), zip(*rows)))

        def run(cols):
            counts = defaultdict(Counter)
            for text, k in zip(cols["text"], cols["class"]):
                counts[k].update(words_of(text))
                counts[k][None] += 1
            yield out(counts)

        return run

    got = map_batches(docs.select("text", F.col(class_col).alias("class")), make, "word binary, class string, c long")
    return got.groupBy("word", "class").agg(F.sum("c").alias("c"))


def packed(counts: DataFrame) -> DataFrame:
    """(word, class, c) as rows of thousands of words each: (class, words parted by spaces, their counts), so that each round reads them at once."""

    def make():
        def run(cols):
            by: dict[str, list[int]] = defaultdict(list)
            for i, k in enumerate(cols["class"]):
                by[k].append(i)
            words, c = cols["word"], np.array(cols["c"], dtype=np.float64)
            for k, own in by.items():
                yield {"class": [k], "words": [b" ".join([words[i] for i in own])], "weights": [c[own].tobytes()]}

        return run

    return map_batches(counts.select("word", "class", "c"), make, "class string, words binary, weights binary", WORDS_AT_ONCE)


def expected(words: DataFrame, model: str, scores: dict[str, np.ndarray]) -> DataFrame:
    """(class, piece, c): expected counts of pieces over packed words."""

    def make():
        pieces = pieces_for(model)

        def run(cols):
            for k, words, weights in zip(cols["class"], cols["words"], cols["weights"]):
                got = pieces.expect(words.decode().split(" "), np.frombuffer(weights), scores[k])
                at = np.flatnonzero(got)
                yield {"class": [k] * len(at), "piece": at, "c": got[at]}

        return run

    return map_batches(words, make, "class string, piece int, c double").groupBy("class", "piece").agg(F.sum("c").alias("c"))


def fit(words: DataFrame, classes: list[str], model: str, rounds: int = 3) -> dict[str, np.ndarray]:
    """Scores of each class from packed words: ``rounds`` steps and a last one, each over all its words."""
    pieces = pieces_for(model)
    scores = {k: pieces.first_scores() for k in classes}
    for _ in range(rounds + 1):
        got = {k: np.zeros(2 * pieces.size) for k in classes}
        for r in expected(words, model, scores).collect():  # classes times the vocabulary at most
            got[r["class"]][r["piece"]] = r["c"]
        scores = {k: pieces.learnt(got[k]) for k in classes}
    return scores


def most_frequent(totals: DataFrame, most: int) -> DataFrame:
    """The words of the highest counts, ``most`` of LONG_WORD bytes at most: a bound that doesn't grow with the corpus.

    Counts fall into levels, eight to a doubling; whole levels are taken from above, so no task sorts the words.
    """
    level = F.floor(F.log2("c") * 8).cast("int")
    short = totals.where(F.length("word") <= LONG_WORD).withColumn("level", level)
    least, taken = None, 0
    for r in sorted(short.groupBy("level").count().collect(), key=lambda r: -r["level"]):  # some hundred levels
        taken += r["count"]
        if taken > most:
            break
        least = r["level"]
    return short.where(F.lit(False) if least is None else F.col("level") >= least).drop("level")


def score(docs: DataFrame, model: str, frequent: int = 300_000, max_classes: int = 8, whole: float = 0.5) -> DataFrame:
    """docs (doc_id, text, held_out, class) to counts, base score and the lattice's score.

    The classes with most training texts, ``max_classes`` at most, have a set of
    scores each; the others share one.  ``whole`` is the share of the words'
    probability that arcs of whole words have.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", text_of().alias("text"), "held_out", F.coalesce("class", F.lit("")).alias("class"))
    train = docs.where(~F.col("held_out"))
    sizes = train.groupBy("class").count().orderBy(F.desc("count"), "class").limit(max_classes).collect()
    shared = F.when(F.col("class").isin([r["class"] for r in sizes]), F.col("class")).otherwise(F.lit(""))
    counts = written(word_counts(train.withColumn("class", shared)), "word-counts")
    texts = {r["class"]: r["c"] for r in counts.where(F.col("word").isNull()).collect()}
    counts = counts.where(F.col("word").isNotNull())
    totals = written(counts.groupBy("word").agg(F.sum("c").alias("c")), "word-totals")
    size = totals.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n_ends = sum(texts.values())
    n, v = size["n"] + n_ends, size["v"] + (n_ends > 0)
    floor = math.log10(n + 0.5 * (v + 1))
    classes = sorted(texts) or [""]
    scores = fit(written(packed(counts), "packed-words"), classes, model)
    words = {r["class"]: r["c"] for r in counts.groupBy("class").agg(F.sum("c").alias("c")).collect()}
    tokens = {k: texts.get(k, 1) + words.get(k, 1) for k in classes}
    arcs = {k: math.log(tokens[k]) for k in classes}
    rest = [math.log((1 - whole) * words.get(k, 1) / tokens[k]) for k in classes]
    lattice = Lattice(model, np.stack([scores[k] for k in classes], axis=1), rest, floor)
    pivot = [F.sum(F.when(F.col("class") == k, F.col("c") * (whole / tokens[k]))).alias(f"arc{i}") for i, k in enumerate(classes)]
    known = written(counts.groupBy("word").agg(F.sum("c").alias("c"), F.array(*[F.coalesce(x, F.lit(0.0)) for x in pivot]).alias("arcs")), "known-words")
    table = lattice.look(most_frequent(known, frequent)).toArrow()
    index = {w: i for i, w in enumerate(table["word"].to_pylist())}
    values = np.array(table["sums"].to_pylist(), dtype=float).reshape(len(index), 1 + len(classes))
    share = [math.log(texts[k] / n_ends) if n_ends else 0.0 for k in classes]
    ends = [share[i] + math.log(texts.get(k, 1)) - arcs[k] for i, k in enumerate(classes)]
    key = text_key(F.concat_ws("|", F.col("doc_id").cast("string"), F.col("doc_id").isNull().cast("string"), "text"))
    mixed = written(first_sums(docs.select(key.alias("key"), "text"), index, values), "scored")
    rare = mixed.where(F.col("word").isNotNull()).select("key", "word", "tf")
    distinct = rare.select("word").distinct().join(known, "word", "left")
    looked = lattice.look(distinct)
    columns = range(1 + len(classes))
    per_word = rare.join(looked, "word").select("key", F.lit(0).cast("long").alias("n_words"), F.when(F.col("known"), F.col("tf")).otherwise(0).alias("n_known"), *[(F.col("tf") * F.col("sums")[i]).alias(f"s{i}") for i in columns], F.lit(0).alias("copies"))
    per_doc = mixed.where(F.col("word").isNull()).select("key", "n_words", "n_known", *[F.col("sums")[i].alias(f"s{i}") for i in columns], F.lit(1).alias("copies"))
    # rows repeated with their id have one key and add up to a multiple of their values
    sums = per_word.unionByName(per_doc).groupBy("key").agg(*[(F.sum(x) / F.sum("copies")).alias(x) for x in ("n_words", "n_known", *[f"s{i}" for i in columns])])
    logs = F.array(*[F.col(f"s{i + 1}") + F.lit(e) for i, e in enumerate(ends)])
    total = (F.log(F.aggregate(logs, F.lit(0.0), lambda a, x: a + F.exp(x - F.array_max(logs)))) + F.array_max(logs)) / F.lit(LOG10)
    end_base, end_known = math.log10(n_ends + 0.5) - floor, int(n_ends > 0)
    sums = sums.select(
        "key", (F.col("n_words") + 1).cast("long").alias("n_tokens"), (F.col("n_known") + end_known).cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("s0") + F.lit(end_base)).alias("base_score"), total.alias("score"),
    )
    return docs.select("doc_id", "held_out", key.alias("key")).join(sums, "key").drop("key")


class Lattice:
    """What it takes to look words up: the vocabulary, each class's scores, its share of the classes' tokens."""

    def __init__(self, model: str, scores: np.ndarray, rest: list[float], floor: float):
        self.model, self.scores, self.rest, self.floor = model, scores, rest, floor

    def look(self, words: DataFrame) -> DataFrame:
        """(word, c, arcs) to (word, known, sums): log10 of the base's, ln of each class's probability."""
        shared = words.sparkSession.sparkContext.broadcast(self)

        def make():
            own = shared.value
            pieces = pieces_for(own.model)

            def run(cols):
                logs = pieces.log_probability([w.decode() for w in cols["word"]], own.scores) + np.array(own.rest)
                if at := [i for i, x in enumerate(cols["arcs"]) if x]:
                    with np.errstate(divide="ignore"):  # a class without the word has no arc: its spelling's log stays
                        logs[at] = np.logaddexp(np.log(np.array([cols["arcs"][i] for i in at])), logs[at])
                known = [c is not None for c in cols["c"]]
                base = np.log10(np.array([c or 0 for c in cols["c"]]) + 0.5) - own.floor
                return {"word": cols["word"], "known": known, "sums": np.concatenate([base[:, None], logs], axis=1).tolist()}

            return run

        return map_batches(words.select("word", "c", "arcs"), make, "word binary, known boolean, sums array<double>", WORDS_AT_ONCE)


def first_sums(docs: DataFrame, index: dict[bytes, int], values: np.ndarray) -> DataFrame:
    """Each text's sums over frequent words, and a row for each of its other words."""
    shared = docs.sparkSession.sparkContext.broadcast((index, values))

    def make():
        index, values = shared.value

        def run(cols):
            rare_key, rare_word, rare_tf, n_words, n_known, all_sums = [], [], [], [], [], []
            for key, text in zip(cols["key"], cols["text"]):
                own = Counter(words_of(text))
                at, tf = np.array([index.get(w, -1) for w in own], dtype=np.int64), np.fromiter(own.values(), dtype=np.int64, count=len(own))
                hot = at >= 0
                if not hot.all():
                    rare = [w for w, i in zip(own, at.tolist()) if i < 0]
                    rare_key += [key] * len(rare)
                    rare_word += rare
                    rare_tf += tf[~hot].tolist()
                n_words.append(int(tf.sum()))
                n_known.append(int(tf[hot].sum()))
                all_sums.append((tf[hot] @ values[at[hot]]).tolist())
            m, none = len(rare_key), [None]
            if m:
                yield {"key": rare_key, "word": rare_word, "tf": rare_tf, "n_words": none * m, "n_known": none * m, "sums": none * m}
            m = len(cols["key"])
            yield {"key": cols["key"], "word": none * m, "tf": none * m, "n_words": n_words, "n_known": n_known, "sums": all_sums}

        return run

    return map_batches(docs, make, "key binary, word binary, tf long, n_words long, n_known long, sums array<double>")


def op9_lattice_score(spark, sf_dir: str, model: str = "piece_bpe_32k.model", whole: float = 0.3) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs.select("doc_id", "text", (fold() == 1).alias("held_out"), F.col("lang").alias("class")), model, whole=whole)
