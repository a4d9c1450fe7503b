"""Benchmark decontamination: pairs of near words as seeds, then Smith-Waterman alignment.

1. Every two words of an item that stand side by side, or with one between, are a
   seed; none is left out, however common it is.
2. Between two matches that follow each other in an alignment, an error or none
   leaves a seed.  A score of ``threshold`` or more of an item of S words has
   ``threshold * S - 1`` such places at least, whose shifts against the item lie
   within ``2 * S * (1 - threshold)``: fewer cannot reach the score, and only they
   are passed over.
3. Around the others the text is aligned with the item word by word.  The score is
   the share of the best possible one, so edited and paraphrased copies score by
   what they keep.

The benchmark travels to the tasks in blocks of at most ``block_bytes`` of text,
whose seeds take about twenty times as much; a larger one is done block after block.

Defined results: words are what white space parts, in lower case, without marks
around them; items of fewer words than n are only found whole, and not used to
drop texts, since a word or two are no leak; null items, and those without words,
have no rows; a null
text counts as the empty one; an item id given twice counts by each of its
texts, and the best score is kept; repeated rows give equal rows each; of equal
scores in a text the first place is kept; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import claim, map_batches, text_key, text_of, written
from .ngram_join import mix

#: Marks that don't belong to the word beside them.
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»“”„‘’…¿¡"
MATCH, MISMATCH, GAP = 2, -1, -1
_BITS = 20
#: A name that no table has.
KEY = "__decontaminate_key"


class BareHashes(dict):
    """64-bit hashes of words without the marks around them; the first many stay."""

    def __missing__(self, word: str) -> int:
        import xxhash

        h = xxhash.xxh64_intdigest(word.strip(MARKS))
        if len(self) < 400_000:
            self[word] = h
        return h


_hashes = BareHashes()


def own_words() -> None:
    """Called in a task: a function of a module acts on the worker's own dictionary, a pickled closure would have a copy."""
    claim("bare words", _hashes.clear)


def word_hashes(text: str) -> np.ndarray:
    return np.fromiter(map(_hashes.__getitem__, text.lower().split()), dtype=np.uint64)


def pairs(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each two words side by side, then of those with one between; and the place of the first of the two."""
    h = mix(words)
    return np.concatenate([mix(h[:-1] ^ words[1:]), mix(h[:-2] ^ words[2:])]), np.concatenate([np.arange(max(0, len(words) - 1)), np.arange(max(0, len(words) - 2))])


class Finder:
    """Tells where hashes of a set stand, and their numbers in it; a bit table passes over nearly all others."""

    def __init__(self, wanted: np.ndarray):
        self.wanted = np.unique(wanted)
        self.bits = np.zeros(1 << _BITS, dtype=bool)
        self.bits[(self.wanted >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    def places(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(self.bits[(found >> np.uint64(64 - _BITS)).astype(np.int64)])
        near = np.minimum(np.searchsorted(self.wanted, found[at]), len(self.wanted) - 1)
        same = self.wanted[near] == found[at]
        return at[same], near[same]


def align(item: np.ndarray, words: np.ndarray) -> tuple[int, int]:
    """Best local alignment score (Smith-Waterman, linear gaps) and the place in words after its end."""
    steps = np.arange(1, len(words) + 1) * -GAP
    above = np.zeros(len(words) + 1, dtype=np.int64)
    best, end = 0, 0
    for w in item:
        t = np.maximum(above[:-1] + np.where(words == w, MATCH, MISMATCH), above[1:] + GAP)
        t = np.maximum(t, 0)
        # a gap in words: the best of all earlier cells less the way from there
        above[1:] = np.maximum.accumulate(t + steps) - steps
        at = int(np.argmax(above))
        if above[at] > best:
            best, end = int(above[at]), at
    return best, end


def item_blocks(benchmark: DataFrame, block_bytes: int) -> list[DataFrame]:
    """The benchmark in parts whose texts are of ``block_bytes`` together, about; at least one."""
    sized = benchmark.select("item_id", "text").where(F.col("text").isNotNull())
    total = sized.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    n = max(1, -(-total // block_bytes))
    return [sized.where(F.pmod(F.xxhash64("text"), F.lit(n)) == i) for i in range(n)] if n > 1 else [sized]


def spread(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges after one another, and the range of each."""
    n = hi - lo
    of = np.repeat(np.arange(len(n)), n)
    return np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + lo[of], of


class Whole:
    """Items too short for seeds: found where all their words stand side by side."""

    def __init__(self, items: list[tuple[object, np.ndarray]]):
        self.items = items
        self.firsts = np.unique(np.array([w[0] for _, w in items], dtype=np.uint64))

    def leaks_in(self, words: np.ndarray) -> dict[int, tuple[float, int, int]]:
        if not self.items or not np.isin(words, self.firsts).any():
            return {}
        out = {}
        for number, (_, item) in enumerate(self.items):
            n = len(words) - len(item) + 1
            if n > 0 and (at := np.flatnonzero(np.all([words[k : n + k] == w for k, w in enumerate(item)], axis=0))).size:
                out[number] = (1.0, int(at[0]), len(item))
        return out


class Seeds:
    """The pairs of all items, and how many of them an item's copy has at least."""

    def __init__(self, items: list[tuple[object, np.ndarray]], threshold: float):
        self.items, self.threshold = items, threshold
        if not items:
            return
        found = [pairs(w) for _, w in items]
        hashes = np.concatenate([h for h, _ in found])
        self.finder = Finder(hashes)
        self.size = np.array([len(w) for _, w in items])
        self.base = np.concatenate([[0], np.cumsum(self.size)])  # places have numbers over all items
        self.keys, self.places = np.searchsorted(self.finder.wanted, hashes), np.concatenate([p for _, p in found])
        self.bounds = np.concatenate([[0], np.cumsum([len(h) for h, _ in found])])
        numbers = np.repeat(np.arange(len(items)), np.diff(self.bounds))
        order = np.argsort(self.keys, kind="stable")
        self.own, self.of = (self.base[numbers] + self.places)[order], np.searchsorted(self.keys[order], np.arange(len(self.finder.wanted) + 1))
        self.least = np.maximum(1, np.ceil(threshold * self.size - 1 - 1e-9)).astype(np.int64)
        self.drift = np.floor(2 * self.size * (1 - threshold) + 1e-9).astype(np.int64)

    def leaks_in(self, words: np.ndarray) -> dict[int, tuple[float, int, int]]:
        """Of one text: item's number to (score, first word, number of words)."""
        if not self.items:
            return {}
        h, at = pairs(words)
        found, key = self.finder.places(h)
        if not found.size:
            return {}
        order = np.argsort(key, kind="stable")
        key, at = key[order], at[found[order]]
        once = key[np.concatenate([[True], key[1:] != key[:-1]])]
        own = np.unique(self.own[spread(self.of[once], self.of[once + 1])[0]])
        n = np.bincount(np.searchsorted(self.base, own, side="right") - 1, minlength=len(self.items))
        out = {}
        for number in np.flatnonzero(n >= self.least).tolist():
            mine = slice(self.bounds[number], self.bounds[number + 1])
            keys, places = self.keys[mine], self.places[mine]
            hit, of = spread(np.searchsorted(key, keys, side="left"), np.searchsorted(key, keys, side="right"))
            # two pairs from one place to one place count once
            size, drift, more = self.size[number], self.drift[number], self.least[number] - 1
            both = np.unique(at[hit] * size + places[of])
            shift = np.sort(both // size - both % size)
            first = shift[: len(shift) - more]
            if (got := best_in(self.items[number][1], words, first[shift[more:] - first <= drift], int(drift), self.threshold)) is not None:
                out[number] = got
        return out


def best_in(item: np.ndarray, words: np.ndarray, shifts: np.ndarray, drift: int, threshold: float) -> tuple[float, int, int] | None:
    """(score, first word, number of words) of the best alignment near the shifts, in order; none below the threshold."""
    size, best = len(item), None
    spans: list[list[int]] = []
    for s in shifts.tolist():
        lo, hi = max(0, s - drift), min(len(words), s + size + drift)
        if spans and lo <= spans[-1][1]:
            spans[-1][1] = hi
        else:
            spans.append([lo, hi])
    for lo, hi in spans:
        part = words[lo:hi]
        if MATCH * np.isin(item, part).sum() < threshold * MATCH * size:
            continue  # not even all common words in order would do
        top, end = align(item, part)
        score = top / (MATCH * size)
        if score >= threshold and score > (best or (0,))[0]:
            _, back = align(item[::-1], part[:end][::-1])
            best = (score, lo + end - back, back)
    return best


def find_leaks(docs: DataFrame, benchmark: DataFrame, n: int = 3, threshold: float = 0.5, block_bytes: int = 8_000_000, short: bool = True) -> DataFrame:
    """(doc_id, text_key, item_id, score, first_word, n_words): each text with each item that it has a copy of; ``short`` items too, where they stand whole."""
    if threshold * n <= 1:
        raise ValueError("a copy has a pair of near words for sure only where the threshold is more than 1 / n")
    spark = docs.sparkSession
    kind, item_kind = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {kind}, text_key binary, item_id {item_kind}, score double, first_word int, n_words int"
    texts = docs.select("doc_id", text_of().alias("text"))
    found = []
    for block in item_blocks(benchmark, block_bytes):
        rows = block.select("item_id", "text").collect()  # block_bytes of text at most
        items = [(r["item_id"], w) for r in rows if len(w := word_hashes(r["text"]))]
        long, brief = [x for x in items if len(x[1]) >= n], [x for x in items if short and len(x[1]) < n]
        if not long and not brief:
            continue
        shared = spark.sparkContext.broadcast((Seeds(long, threshold), Whole(brief)))

        def make(shared=shared):
            own_words()
            finders = shared.value

            def run(cols):
                out = []
                for doc, key, text in zip(cols["doc_id"], cols["text_key"], cols["text"]):
                    best: dict = {}
                    words = word_hashes(text)
                    for finder in finders:
                        for number, x in finder.leaks_in(words).items():
                            item = finder.items[number][0]
                            if x[0] > best.get(item, (0,))[0]:
                                best[item] = x
                    out += [(doc, key, item, *x) for item, x in best.items()]
                if out:
                    yield dict(zip(("doc_id", "text_key", "item_id", "score", "first_word", "n_words"), zip(*out)))

            return run

        found.append(map_batches(texts.withColumn("text_key", text_key(F.col("text"))), make, schema))
    if not found:
        return spark.createDataFrame([], schema)
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, n: int = 3, threshold: float = 0.5) -> DataFrame:
    """docs without those that have a copy of an item."""
    leaks = written(find_leaks(docs, benchmark, n, threshold, short=False).select(F.col("text_key").alias(KEY)).distinct(), "leaks")
    return docs.withColumn(KEY, text_key(text_of())).join(leaks, KEY, "left_anti").select(*docs.columns)


def op7_decontaminate(spark, sf_dir: str, n: int = 3, threshold: float = 0.5) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return find_leaks(docs, benchmark, n, threshold).drop("text_key")
