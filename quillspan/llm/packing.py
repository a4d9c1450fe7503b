"""Best-two-fit packing of documents into sequences of a fixed number of tokens.

Pieces of one length can stand for each other, so a plan is made on the driver
over the counts of lengths alone: at most ``capacity`` numbers however large the
input.  A bin is filled greedily, longest first; where a gap stays, its smallest
piece gives way to the two unpacked pieces that fill the widened gap best.  A
bin's pattern is repeated as often as the counts allow.  Pieces then get a rank
within their length, and the plan turns ranks into places.

Defined results: a null or empty text is one piece, the end id alone; repeated
rows are pieces of their own; a text of exactly ``capacity`` ids is one piece;
an empty table gives an empty result; other columns are left alone and dropped.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, text_of, written
from .token_counts import encoder

#: Pieces of one length that one task ranks, about.
RANK_BLOCK = 50_000


def best_two_fit(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(pieces of each length in a bin, number of such bins), for counts of each length."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] = n
    bins = []
    while (lengths := np.flatnonzero(left)).size:
        lengths = lengths.tolist()
        used: dict[int, int] = {}
        gap, at = capacity, len(lengths) - 1
        while at >= 0 and gap:
            length = lengths[at]
            if n := min(int(left[length]), gap // length):
                used[length] = n
                gap -= n * length
            at = min(at - 1, bisect_right(lengths, gap) - 1)
        if gap:
            swap(left, used, gap)
        times = min(int(left[length]) // n for length, n in used.items())
        for length, n in used.items():
            left[length] -= n * times
        bins.append((used, times))
    return bins


def swap(left: np.ndarray, used: dict[int, int], gap: int) -> None:
    """Put the two unpacked pieces that fill the gap best in the smallest one's place."""
    smallest = min(used)
    room = smallest + gap
    rest = left[: room + 1].copy()
    for length, n in used.items():
        if length <= room:
            rest[length] -= n
    free = np.flatnonzero(rest)
    if not free.size:
        return
    at = np.searchsorted(free, room - free, side="right") - 1
    alone = (at >= 0) & (free[at] == free) & (rest[free] < 2)
    at = np.where(alone, at - 1, at)
    total = np.where(at >= 0, free + free[at], 0)
    best = int(np.argmax(total))
    if smallest < total[best] <= room:
        used[smallest] -= 1
        if not used[smallest]:
            del used[smallest]
        for length in (int(free[best]), int(free[at[best]])):
            used[length] = used.get(length, 0) + 1


class Places:
    """Turns (length, rank within the length) into (sequence, offset)."""

    def __init__(self, bins: list[tuple[dict[int, int], int]]):
        rows: dict[int, list[tuple[int, int, int, int]]] = {}
        taken: dict[int, int] = {}
        sequence = 0
        for used, times in bins:
            offset = 0
            for length, n in sorted(used.items(), reverse=True):
                rank = taken.get(length, 0)
                rows.setdefault(length, []).append((rank, n, sequence, offset))
                taken[length] = rank + n * times
                offset += n * length
            sequence += times
        self.sequences = sequence
        self.by_length = {k: np.array(v, dtype=np.int64) for k, v in rows.items()}

    def of(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.empty_like(rank), np.empty_like(rank)
        for k in np.unique(length):
            own = length == k
            table = self.by_length[int(k)]
            row = table[np.searchsorted(table[:, 0], rank[own], side="right") - 1]
            nth = rank[own] - row[:, 0]
            sequence[own] = row[:, 2] + nth // row[:, 1]
            offset[own] = row[:, 3] + nth % row[:, 1] * k
        return sequence, offset


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each text's ids and an end id, cut at the capacity."""
    docs = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    end = int(end_id).to_bytes(4, "little")

    def make():
        enc = encoder(tokenizer, spaced=False)

        def run(cols):
            out = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
            for doc, ids in zip(cols["doc_id"], enc.encode(cols["text"])):
                ids += end
                for n, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    for k, v in zip(out, (doc, n, at // 4, len(part) // 4, zlib.crc32(part))):
                        out[k].append(v)
            return out

        return run

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs, make, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def ranked(parts: DataFrame, block: int = RANK_BLOCK) -> DataFrame:
    """parts with each row's rank within its length, from 0; a frequent length is ranked in shards."""
    shards = max(1, parts.count() // block)
    parts = parts.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(shards)))
    before = Window.partitionBy("length").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.groupBy("length", "shard").count().withColumn("base", F.coalesce(F.sum("count").over(before), F.lit(0)))
    within = Window.partitionBy("length", "shard").orderBy("doc_id", "piece", "ids_crc32")
    parts = parts.withColumn("nth", F.row_number().over(within) - 1)
    joined = parts.join(bases.select("length", "shard", "base"), ["length", "shard"])
    return joined.withColumn("rank", F.col("base") + F.col("nth")).drop("shard", "nth", "base")


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece with its sequence and its offset there."""
    parts = written(pieces(docs, tokenizer, capacity, end_id, id_col, text_col), "pieces")
    counts = {r["length"]: r["count"] for r in parts.groupBy("length").count().collect()}  # capacity rows at most
    places = Places(best_two_fit(counts, capacity))
    shared = parts.sparkSession.sparkContext.broadcast(places)
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def make():
        def run(cols):
            sequence, offset = shared.value.of(np.array(cols["length"], dtype=np.int64), np.array(cols["rank"], dtype=np.int64))
            return {k: cols[k] for k in names} | {"sequence_id": sequence, "offset": offset}

        return run

    kind = parts.schema["doc_id"].dataType.simpleString()
    return map_batches(ranked(parts), make, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op3_packing(spark, sf_dir: str, tokenizer: str = "word_bpe_49k.json", capacity: int = 4096, end_id: int = 1) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer, capacity, end_id)
