"""Self join of texts on the Jaccard similarity of their word n-grams, by MinHash banding.

1. Each text's set of n-grams is hashed and reduced to a signature; texts of one
   set are one vertex from here on, so copies are never expanded.
2. The number of bands and of rows in each follow from the recall wanted at the
   threshold.  Vertices meet on band hashes.  In a bucket, signatures are compared,
   and a spanning forest of the pairs that may be similar leaves it.
3. Forests of all buckets give groups of vertices that may be linked.  In a group
   every pair is verified on the full n-gram sets.  What leaves is each vertex's
   number of links and a spanning forest of the verified links.
4. These forests' components are the classes.

Buckets and groups of up to BLOCK members are one block.  Larger ones are cut into
blocks, and each pair of blocks is a row key of its own, so no task takes a whole
group and no pair of rows is written.  A block by itself gives less edges than it
has members; two blocks give one edge for each two of their components that are
linked, so a group of one component gives fewer edges than members and pairs of
blocks together.  An exact number of links takes a comparison of all pairs of a
group: its n-gram sets, made once, are read by each of its n / BLOCK blocks.

Defined results: words are what white space parts, in lower case; a text of fewer
words than n has its words as its only n-gram; a null text counts as the empty
one; texts without words have the empty set, and are copies of each other; rows
repeated are copies; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, claim, if_small, map_batches, text_key, text_of, written

#: Members of a block, and bytes of its n-gram sets; two blocks are compared at once.
BLOCK, BLOCK_BYTES = 500, 8_000_000
#: Signatures that agree in a share lower than the threshold by this much don't lead to a pair of sets.
SLACK = 0.2
COLUMNS = 4096
#: A name that no table has.
OWN = "__ngram_join_key"


def bands_for(threshold: float, recall: float = 0.999, most: int = 128) -> tuple[int, int]:
    """(bands, rows): the most rows whose bands, ``most`` hashes in all, find ``recall`` of the pairs at the threshold."""
    for rows in range(16, 0, -1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if bands * rows <= most:
            return bands, rows
    return most, 1


class WordHashes(dict):
    """64-bit hashes of words; the first many stay."""

    def __missing__(self, word: str) -> int:
        import xxhash

        h = xxhash.xxh64_intdigest(word)
        if len(self) < 400_000:
            self[word] = h
        return h


_hashes = WordHashes()


def own_words() -> None:
    """Called in a task: a function of a module acts on the worker's own dictionary, a pickled closure would have a copy."""
    claim("n-grams", _hashes.clear)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def ngrams(text: str, n: int) -> np.ndarray:
    """Sorted distinct hashes of the text's n-grams."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    w = np.array([_hashes[x] for x in words], dtype=np.uint64)
    if len(w) < n:
        w = np.concatenate([w, np.arange(n - len(w), dtype=np.uint64)])
    h = np.zeros(len(w) - n + 1, dtype=np.uint64)
    for k in range(n):
        h = mix(h ^ w[k : k + len(h)])
    return np.unique(h)


def signatures(sets: list[np.ndarray], size: int) -> np.ndarray:
    """MinHash signatures of sets that aren't empty, one row each."""
    flat = np.concatenate(sets)
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    r = np.random.default_rng(20)
    factors = r.integers(0, 2**63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.empty((len(sets), size), dtype=np.uint32)
    for k, f in enumerate(factors):
        out[:, k] = np.minimum.reduceat(mix_lightly(flat, f), at) >> np.uint64(32)
    return out


def mix_lightly(x: np.ndarray, factor: np.uint64) -> np.ndarray:
    return (x ^ (factor >> np.uint64(7))) * factor


def band_hashes(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.empty((len(sig), bands), dtype=np.int64)
    for b in range(bands):
        h = np.full(len(sig), b + 1, dtype=np.uint64)
        for k in range(rows):
            h = mix(h ^ sig[:, b * rows + k].astype(np.uint64))
        out[:, b] = h.view(np.int64)
    return out


def signed(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """(set_key, text_key, sig, bands) for each text: digests of the n-gram set and of the text."""
    docs = docs.select(text_of().alias("text"), "doc_id").withColumn("text_key", text_key(F.col("text")))

    def make():
        own_words()

        def run(cols):
            sets = [ngrams(t, n) for t in cols["text"]]
            full = [s for s in sets if len(s)]
            sig = signatures(full, bands * rows) if full else np.zeros((0, bands * rows), dtype=np.uint32)
            hashes = band_hashes(sig, bands, rows)
            at, sigs, bh = 0, [], []
            for s in sets:
                sigs.append(sig[at].tobytes() if len(s) else None)
                bh.append(hashes[at].tolist() if len(s) else None)
                at += len(s) > 0
            return {"doc_id": cols["doc_id"], "set_key": [hashlib.md5(s.tobytes()).digest() for s in sets], "text_key": cols["text_key"], "sig": sigs, "bands": bh}

        return run

    return map_batches(docs, make, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, set_key binary, text_key binary, sig binary, bands array<long>")


def block_count(n: Column, size: Column | None = None) -> Column:
    blocks = F.ceil(n / BLOCK)
    return (blocks if size is None else F.greatest(blocks, F.ceil(size / BLOCK_BYTES))).cast("int").alias("blocks")


def in_block_pairs(members: DataFrame) -> DataFrame:
    """members (v, blocks) with columns bi and bj: a row for each pair of blocks of its group that it is part of, and side."""
    rows = members.withColumn("own", F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.withColumn("bi", F.least("own", "other")).withColumn("bj", F.greatest("own", "other")).withColumn("side", (F.col("own") != F.col("bi")).cast("int")).drop("own", "other", "blocks")


def by_group(rows: DataFrame, key: list[str], value: str, make, schema: str) -> DataFrame:
    """make()(members, values, sides, weights, whether it is one block) for each pair of blocks; groups come sorted, so one is held at a time."""
    from pyspark.sql.types import _parse_datatype_string

    from .common import arrow_schema

    spark = rows.sparkSession
    bounded_batches(spark)
    keys = [*key, "bi", "bj"]
    rows = rows.repartition(*keys).sortWithinPartitions(*keys, "side", "v").select(*keys, "v", "side", "weight", value)
    kind = _parse_datatype_string(schema)
    arrow = pa.schema([pa.field(f.name, f.type) for f in arrow_schema(kind)])

    def run(batches):
        fn, now, held = make(), None, ([], [], [], [])
        out: list[tuple] = []
        for b in batches:
            cols = {name: b.column(i).to_pylist() for i, name in enumerate(b.schema.names)}
            for k, *row in zip(zip(*(cols[c] for c in keys)), cols["v"], cols[value], cols["side"], cols["weight"]):
                if k != now:
                    if len(held[0]) > 1:
                        out += fn(*held, now[-1] == now[-2])
                    now, held = k, ([], [], [], [])
                for x, y in zip(held, row):
                    x.append(y)
            if len(out) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), arrow)], schema=arrow)
                out = []
        if len(held[0]) > 1:
            out += fn(*held, now[-1] == now[-2])
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), arrow)], schema=arrow)

    return rows.mapInArrow(run, kind)


def spanning(n: int, near) -> tuple[list[tuple[int, int]], np.ndarray]:
    """(edges of a spanning forest of n members' links, each member's tree); near(i, others) tells which others are linked with i."""
    out, tree, left = [], np.zeros(n, dtype=np.int64), np.arange(n)
    while left.size:
        queue, left = [int(left[0])], left[1:]
        tree[queue[0]] = root = queue[0]
        for i in queue:
            if not left.size:
                break
            hit = near(i, left)
            found = left[hit].tolist()
            tree[found] = root
            out += [(i, j) for j in found]
            queue += found
            left = left[~hit]
    return out, tree


def bridges(left_tree: np.ndarray, right_tree: np.ndarray, near) -> list[tuple[int, int]]:
    """An edge (left member, right member) for each two trees that links between them connect, without rings; near as above."""
    parent: dict[tuple[int, int], tuple[int, int]] = {}

    def top(x):
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = parent[p]
            x = p
        return x

    out = []
    trees = np.unique(right_tree)
    for i, own in enumerate(left_tree.tolist()):
        apart = [t for t in trees.tolist() if top((1, t)) != top((0, own))]
        if not apart:
            continue
        others = np.flatnonzero(np.isin(right_tree, apart))
        for j in others[near(i, others)].tolist():
            a, b = top((0, own)), top((1, int(right_tree[j])))
            if a != b:
                parent[a] = b
                out.append((i, j))
    return out


def forest(left: np.ndarray, right: np.ndarray, same: bool, near, near_left, near_right) -> list[tuple[int, int]]:
    """Edges between members of one block, or of two whose own forests another key gives; near of left and right, and within each."""
    if same:
        return [(int(left[a]), int(left[b])) for a, b in spanning(len(left), near)[0]]
    trees = spanning(len(left), near_left)[1], spanning(len(right), near_right)[1]
    return [(int(left[a]), int(right[b])) for a, b in bridges(*trees, near)]


def sides(side: list[int], same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places of the members of either block; a block with itself is compared as both."""
    left, right = np.flatnonzero(np.array(side) == 0), np.flatnonzero(np.array(side) == 1)
    return (left, left) if same else (left, right)


def compare_signatures(least: float):
    """In a bucket: a forest of the pairs whose signatures agree in a share of ``least`` or more."""

    def run(members, sigs, side, weights, same):
        left, right = sides(side, same)
        if not left.size or not right.size:
            return []
        sig = np.stack([np.frombuffer(s, dtype=np.uint32) for s in sigs])
        enough = least * sig.shape[1]

        def near(a: np.ndarray, b: np.ndarray):
            return lambda i, others: (b[others] == a[i]).sum(axis=1) >= enough

        a, b = sig[left], sig[right]
        return [(members[i], members[j]) for i, j in forest(left, right, same, near(a, b), near(a, a), near(b, b))]

    return run


class Shared:
    """Sets of one block, to tell which of them have the threshold's similarity with one of them."""

    def __init__(self, sets: list[np.ndarray], threshold: float):
        self.sets, self.threshold, self.size = sets, threshold, np.array([len(s) for s in sets])
        self.flat, self.at = np.concatenate(sets), np.concatenate([[0], np.cumsum(self.size)[:-1]])

    def near(self, i: int, others: np.ndarray) -> np.ndarray:
        own = self.sets[i]
        place = np.minimum(np.searchsorted(own, self.flat), len(own) - 1)
        common = np.add.reduceat((own[place] == self.flat).astype(np.int64), self.at)[others]
        return common >= self.threshold * (len(own) + self.size[others] - common) - 1e-6


def jaccard_links(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, same: bool, threshold: float) -> np.ndarray:
    """Which pairs of a left and a right set have the threshold's similarity, by matrix products over shared n-grams."""
    size = np.array([len(s) for s in sets])
    flat = np.concatenate([sets[i] for i in range(len(sets))])
    owner = np.repeat(np.arange(len(sets)), size)
    _, column, seen = np.unique(flat, return_inverse=True, return_counts=True)
    shared = seen > 1
    place = np.cumsum(shared) - 1
    keep = shared[column]
    column, owner = place[column[keep]], owner[keep]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    row_left, row_right = np.full(len(sets), -1), np.full(len(sets), -1)
    row_left[left], row_right[right] = np.arange(len(left)), np.arange(len(right))
    common = np.zeros((len(left), len(right)), dtype=np.float32)
    for lo in range(0, int(shared.sum()), COLUMNS):
        a, b = np.searchsorted(column, [lo, lo + COLUMNS])
        width = min(COLUMNS, int(shared.sum()) - lo)
        m = np.zeros((2, max(len(left), len(right)), width), dtype=np.float32)
        for s, row in enumerate((row_left, row_right)):
            own = row[owner[a:b]]
            m[s, own[own >= 0], column[a:b][own >= 0] - lo] = 1
        common += m[0, : len(left)] @ m[1, : len(right)].T
    union = size[left][:, None] + size[right][None, :] - common
    linked = common >= threshold * union - 1e-6
    if same:
        np.fill_diagonal(linked, False)
    return linked


def verify(threshold: float):
    """In a group: each vertex's number of linked texts as (v, null, links), and a forest of the links as (v, w, 0)."""

    def run(members, packed, side, weights, same):
        left, right = sides(side, same)
        if not left.size or not right.size:
            return []
        sets = [np.frombuffer(s, dtype=np.uint64) for s in packed]
        linked = jaccard_links(sets, left, right, same, threshold)
        w = np.array(weights)
        counts = np.zeros(len(members), dtype=np.int64)
        counts[left] += linked @ w[right]
        if not same:
            counts[right] += linked.T @ w[left]
        out = [(members[i], None, int(c)) for i, c in enumerate(counts) if c]
        a, b = Shared([sets[i] for i in left], threshold), Shared([sets[i] for i in right], threshold)
        pairs = forest(left, right, same, lambda i, others: linked[i, others], a.near, b.near)
        return out + [(members[i], members[j], 0) for i, j in pairs]

    return run


def with_sets(members: DataFrame, n: int) -> DataFrame:
    """members (v, root, weight, text) with the n-gram set in place of the text: made once, however many blocks read it."""

    def make():
        own_words()

        def run(cols):
            return {c: cols[c] for c in ("v", "root", "weight")} | {"grams": [ngrams(t, n).tobytes() for t in cols["text"]]}

        return run

    return map_batches(members.select("v", "root", "weight", "text"), make, "v binary, root binary, weight long, grams binary")


def components(edges: DataFrame) -> DataFrame:
    """(v, root): the least vertex that each vertex of the edges (v, w) is connected with.

    Labels pass over edges, and then to the label's own label, so the number of
    rounds grows with the logarithm of the longest path.  Each round is written.
    """
    edges = written(edges.distinct(), "pairs")
    both = written(edges.unionByName(edges.select(F.col("w").alias("v"), F.col("v").alias("w"))).distinct(), "edges")
    labels = written(both.groupBy("v").agg(F.least(F.col("v"), F.min("w")).alias("root")), "labels")
    while True:
        near = both.join(labels.select(F.col("v").alias("w"), "root"), "w").groupBy("v").agg(F.min("root").alias("near"))
        step = labels.join(near, "v").select("v", F.least("root", "near").alias("next"), "root")
        far = labels.select(F.col("v").alias("next"), F.col("root").alias("far"))
        new = written(step.join(far, "next").select("v", F.col("far").alias("root"), (F.col("far") != F.col("root")).alias("changed")), "labels")
        labels = new.select("v", "root")
        if not new.where("changed").limit(1).count():
            return labels


def similar(docs: DataFrame, threshold: float = 0.8, n: int = 5, recall: float = 0.999) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): each text's (doc_id, set_key, text_key), and each set's (v, root, n_copies, n_links).

    n_copies counts the rows of the set; n_links counts the rows of other sets of
    which each has the similarity; sets without any have themselves as root.
    """
    bands, rows = bands_for(threshold, recall)
    table = written(signed(docs, n, bands, rows), "signatures")
    sets = table.groupBy("set_key").agg(F.count("*").alias("weight"), F.min("text_key").alias("text_key"), F.first("sig").alias("sig"), F.first("bands").alias("bands")).withColumnRenamed("set_key", "v")
    sets = written(sets, "sets")
    placed = sets.where(F.col("bands").isNotNull()).select("v", F.posexplode("bands").alias("band", "hash"))
    # buckets are a table of their own, so that Spark may split the join where one bucket has many members
    met = placed.groupBy("band", "hash").agg(F.count("*").alias("n")).where("n > 1").select("band", "hash", block_count(F.col("n")))
    members = placed.join(written(met, "buckets"), ["band", "hash"]).join(sets.select("v", "sig", F.lit(0).alias("weight")), "v")
    pairs = by_group(in_block_pairs(members), ["band", "hash"], "sig", lambda: compare_signatures(threshold - SLACK), "v binary, w binary")
    groups = components(pairs)
    # one text stands for all of its set; texts without a partner stay where they are
    wanted = written(sets.join(groups, "v").select("v", "root", "weight", "text_key"), "wanted")
    texts = docs.select(text_of().alias("text")).withColumn("text_key", text_key(F.col("text"))).join(if_small(wanted), "text_key")
    texts = texts.groupBy("v", "root", "weight").agg(F.first("text").alias("text"))
    members = written(with_sets(texts, n), "members")
    sizes = written(members.groupBy("root").agg(block_count(F.count("*"), F.sum(F.octet_length("grams")))), "group-sizes")
    members = members.join(if_small(sizes), "root")
    found = written(by_group(in_block_pairs(members), ["root"], "grams", lambda: verify(threshold), "v binary, w binary, links long"), "links")
    links = found.where(F.col("w").isNull()).groupBy("v").agg(F.sum("links").alias("n_links"))
    roots = components(found.where(F.col("w").isNotNull()).select("v", "w"))
    classes = sets.select("v", F.col("weight").alias("n_copies")).join(links, "v", "left").join(roots, "v", "left")
    return table.select("doc_id", "set_key", "text_key"), classes.select("v", F.coalesce("root", "v").alias("root"), "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def classify(docs: DataFrame, threshold: float = 0.8, n: int = 5) -> DataFrame:
    """One row for each text: doc_id, class_id (the class's least id), copy_of (its set's least id), n_links.

    n_links counts the other rows whose text has the similarity, copies among them.
    """
    rows, classes = similar(docs, threshold, n)
    ids = written(rows.groupBy("set_key").agg(F.min("doc_id").alias("copy_of")).join(classes.withColumnRenamed("v", "set_key"), "set_key"), "classes")
    least = ids.groupBy("root").agg(F.min("copy_of").alias("class_id"))
    ids = ids.join(least, "root").select("set_key", "class_id", "copy_of", (F.col("n_links") + F.col("n_copies") - 1).alias("n_links"))
    return rows.select("doc_id", "set_key").join(ids, "set_key").drop("set_key")


def one_of_each(docs: DataFrame, threshold: float = 0.8, n: int = 5) -> DataFrame:
    """docs without near duplicates: of each class, the row of least id and text stays."""
    rows, classes = similar(docs, threshold, n)
    rows = rows.join(classes.select(F.col("v").alias("set_key"), "root"), "set_key")
    stay = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")).alias("s"))
    stay = stay.select(F.col("s.doc_id").alias(f"{OWN}_id"), F.col("s.text_key").alias(OWN))
    kept = docs.withColumn(OWN, text_key(text_of())).join(stay, OWN).where(F.col("doc_id").eqNullSafe(F.col(f"{OWN}_id")))
    return kept.dropDuplicates([OWN]).select(*docs.columns)


def op6_ngram_join(spark, sf_dir: str, threshold: float = 0.8, n: int = 5) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), threshold, n)


OP6_SQL = r"""
with recursive w as (select doc_id, string_split(trim(regexp_replace(lower(coalesce(text, '')), '\s+', ' ', 'g')), ' ') as ws from documents),
sh as (select distinct doc_id, array_to_string(ws[i:i + 4], ' ') as s from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) as i from w)),
sz as (select doc_id, count(*) as n from sh group by doc_id),
pr as (select a.doc_id as x, b.doc_id as y, count(*) as c from sh a join sh b using (s) where a.doc_id <> b.doc_id group by all),
ln as (select x, y, c = a.n and c = b.n as same from pr join sz a on a.doc_id = x join sz b on b.doc_id = y where c >= 0.8 * (a.n + b.n - c)),
r as (select doc_id as x, doc_id as y from documents union select r.x, ln.y from r join ln on ln.x = r.y),
cl as (select x as doc_id, min(y) as class_id from r group by x),
k as (select x as doc_id, count(*) as n_links, min(y) filter (where same) as least from ln group by x)
select doc_id, class_id, least(doc_id, coalesce(least, doc_id)) as copy_of, coalesce(n_links, 0)::bigint as n_links from cl left join k using (doc_id)
"""
