"""Removal of repeated passages by hashes of sliding runs of sentences.

A sentence ends with a word that ends in a mark, or with its line; a sentence of
more than LONG words is cut further after words that their own hash picks, and
where WINDOW words in a row would have no cut, after the least hash of them, so
that equal wording is cut alike wherever it stands.  From every sentence a run
goes on until it has RUN sentences and RUN_WORDS words at least: 3 * WINDOW words
that are repeated, wherever they begin, hold a run.  Runs are hashed
to 96 bits, and meet all others by their hash.  The first run, by document id and
then by place, is the original; sentences covered by any other one are removed.

Runs are written once.  Partial aggregation finds the first document of each
repeated run; a very frequent run is one row there, and in the join that tells
its other occurrences Spark splits what is skewed.

Defined results: sentences are compared by their words in lower case; white space
after a sentence goes with it; a text shorter than a run has none; a null text
counts as the empty one and stays null; a null id is one id and comes after all
others; rows that share an id are one document, so what they repeat of each other
stays; an empty table gives an empty result; other columns pass unchanged.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import claim, map_batches, text_of, written
from .ngram_join import mix

RUN = 2
RUN_WORDS = 16
LONG = 0
WINDOW = 17
#: A long sentence is cut after one in so many of its words.
CUT = 8
MARKS = ".!?。！？…"
CLOSING = "\"')]}»”’"
_WORD = re.compile(r"\S+")
#: Factors of the two hashes' powers, with their inverses modulo 2**64.
FACTORS = [(np.uint64(f), np.uint64(pow(f, -1, 1 << 64))) for f in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]


class Hashes(dict):
    """Of each word a hash in lower case, whose last bit tells whether a sentence ends; the first many stay."""

    def __missing__(self, word: str) -> int:
        import xxhash

        ends = word.rstrip(CLOSING).endswith(tuple(MARKS))
        h = xxhash.xxh64_intdigest(word.lower()) & ~1 | ends
        if len(self) < 700_000:
            self[word] = h
        return h


_hashes = Hashes()


def own_words() -> None:
    """Called in a task: a function of a module acts on the worker's own dictionary, a pickled closure would have a copy."""
    claim("sentences", _hashes.clear)


def sentences(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the text's words, and the number of words up to each sentence's end."""
    words: list[str] = []
    lines = []
    for line in text.split("\n"):
        words += line.split()
        lines.append(len(words))
    h = np.fromiter(map(_hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    if not words:
        return h, np.zeros(0, dtype=np.int64)
    end = (h & np.uint64(1)).astype(bool)
    end[[n - 1 for n in lines if n]] = True
    last = np.flatnonzero(end)
    size = np.diff(last, prepend=-1)
    if size.max() > LONG:
        end |= np.repeat(size > LONG, size) & ((h >> np.uint64(1)) % np.uint64(CUT) == 0)
        last = np.flatnonzero(end)
    size = np.diff(last, prepend=-1)
    if (wide := np.flatnonzero(size >= WINDOW)).size:
        n = size[wide] - WINDOW + 1
        at = np.arange(n.sum()) + np.repeat(last[wide] - size[wide] + 1 - np.cumsum(n) + n, n)
        end[at + np.lib.stride_tricks.sliding_window_view(mix(h), WINDOW)[at].argmin(axis=1)] = True
        last = np.flatnonzero(end)
    return h, last + 1


def runs(h: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first sentence, number of sentences, two hashes, whether the text had it before) of each run."""
    starts = np.concatenate([[0], ends[:-1]])
    # the run from sentence i ends with the first that makes it long enough both ways
    last = np.maximum(np.arange(len(ends)) + RUN - 1, np.searchsorted(ends, starts + RUN_WORDS, side="left"))
    first = np.flatnonzero(last < len(ends))
    last = last[first]
    lo, hi = starts[first], ends[last]
    out = []
    for factor, inverse in FACTORS:
        # sums of words times powers: a difference of two sums is the run's, and the inverse power moves it to the start
        power = np.cumprod(np.full(len(h), factor, dtype=np.uint64))
        sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(mix(h ^ factor) * power, dtype=np.uint64)])
        back = np.cumprod(np.full(len(h), inverse, dtype=np.uint64))
        out.append(mix((sums[hi] - sums[lo]) * back[lo] + (hi - lo).astype(np.uint64)))
    a, b = out[0].view(np.int64), (out[1] >> np.uint64(32)).astype(np.uint32).view(np.int32)
    again = np.ones(len(a), dtype=bool)
    again[np.unique(a, return_index=True)[1]] = False
    return first, last + 1 - first, a, b, again


def spans(docs: DataFrame) -> DataFrame:
    """(doc, key, a, b, first, n, again): the runs of each text."""

    def make():
        own_words()

        def run(cols):
            docs, keys, out = [], [], []
            for doc, key, text in zip(cols["doc"], cols["key"], cols["text"]):
                h, ends = sentences(text)
                if len(ends) >= RUN and len(h) >= RUN_WORDS:
                    found = runs(h, ends)
                    out.append(found)
                    docs += [doc] * len(found[0])
                    keys.append(np.full(len(found[0]), key, dtype=np.int32))
            if out:
                yield {"doc": docs, "key": np.concatenate(keys)} | dict(zip(("first", "n", "a", "b", "again"), (np.concatenate(x) for x in zip(*out))))

        return run

    kind = docs.schema["doc"].dataType.simpleString()
    return map_batches(docs, make, f"doc {kind}, key int, a long, b int, first int, n int, again boolean")


def text_hash(text: Column) -> Column:
    """32 bits, to tell the texts of one id apart."""
    return F.hash(text)


def repeated(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_doc, _key, _spans): of each document the runs that aren't the first of their kind."""
    rows = docs.select(F.col(id_col).alias("doc"), text_of(text_col).alias("text")).withColumn("key", text_hash(F.col("text")))
    found = written(spans(rows.select("doc", "key", "text")), "runs", "zstd")
    firsts = found.groupBy("a", "b").agg(F.min("doc").alias("least"), F.count("*").alias("c")).where(F.col("c") > 1).drop("c")
    firsts = written(firsts, "repeated-runs")  # as a table of its own, so that Spark may split the join at a very frequent run
    others = found.join(firsts, ["a", "b"]).where(F.col("again") | ~F.col("doc").eqNullSafe(F.col("least")))
    return others.groupBy(F.col("doc").alias("__sub_doc"), F.col("key").alias("__sub_key")).agg(F.collect_set(F.struct("first", "n")).alias("__sub_spans"))


def cut(text: str, found: list) -> tuple[str, int, int]:
    """The text without the sentences of the spans, the number of sentences, and of those removed."""
    _, ends = sentences(text)
    if not found:
        return text, len(ends), 0
    gone = np.zeros(len(ends), dtype=bool)
    for s in found:
        gone[s["first"] : s["first"] + s["n"]] = True
    words = [m.start() for m in _WORD.finditer(text)]
    borders = [words[e] if e < len(words) else len(text) for e in ends]
    parts = [text[a:b] for a, b, g in zip([words[0], *borders[:-1]], borders, gone) if not g]
    return text[: words[0]] + "".join(parts), len(ends), int(gone.sum())


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_sentences: str | None = None, n_removed: str | None = None) -> DataFrame:
    """docs with the sentences of repeated runs taken out; optional columns with the sentences before, and those removed."""
    found = repeated(docs, id_col, text_col)
    joined = docs.withColumn("__sub_own", text_hash(text_of(text_col))).join(found, (F.col("__sub_own") == F.col("__sub_key")) & F.col(id_col).eqNullSafe(F.col("__sub_doc")), "left")
    columns = [f for f in docs.schema.fields if f.name != text_col]
    rows = joined.select(*[F.col(f"`{f.name}`") for f in columns], F.col(text_col).alias("__sub_text"), "__sub_spans")

    def make():
        own_words()

        def run(cols):
            texts, n, m = [], [], []
            for text, spans in zip(cols["__sub_text"], cols["__sub_spans"]):
                left, own, gone = cut(text or "", spans)
                texts.append(left if gone else text)
                n.append(own)
                m.append(gone)
            return {f.name: cols[f.name] for f in columns} | {"__sub_text": texts, "__sub_n": n, "__sub_m": m}

        return run

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in columns] + ["__sub_text string, __sub_n long, __sub_m long"])
    out = map_batches(rows, make, schema)
    extra = [(n_sentences, "__sub_n"), (n_removed, "__sub_m")]
    return out.select(*[F.col("__sub_text").alias(text_col) if c == text_col else F.col(f"`{c}`") for c in docs.columns], *[F.col(c).alias(name) for name, c in extra if name])


def op2_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs, n_sentences="n_sentences", n_removed="n_removed").select("doc_id", text_of().alias("text"), "n_sentences", "n_removed")
