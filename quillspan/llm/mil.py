"""Quality scores by attention-based multiple-instance learning.

A text is a bag of passages of PASSAGE_WORDS words.  Each passage is encoded by
shares of characters of each kind, shapes of its words, and hashed word endings;
a layer turns that into a representation, and gated attention (tanh times
sigmoid, softmax over the bag) weighs the passages.  The weighted representation
gives the score.  Only the bag's label is known in training; attention learns
which passages tell it.

Training takes ``max_train`` labelled texts at most, those of least hash, and of
these no more than have ``max_bytes`` together, on the driver; scoring reads every whole text, in Arrow batches, and holds one batch.

Defined results: a null or empty text is one passage of zeros and gets a score;
rows without a label aren't trained on; labels that are null count as missing; an
id labelled twice counts once, by its least label, and one with several rows by
its least text; without both labels in
training, the score is the share of label 1, or 0.5 without any; repeated rows
get equal scores; columns besides id and text are no input of the score.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import claim, fold, map_batches, text_of, written

PASSAGE_WORDS = 100
#: Characters up to here have a kind each or share one; all others share kinds by class.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
KINDS = 6 + len(PUNCTUATION)  # lower, upper, digit, space, line feed, other; then each mark
ENDINGS = 64
N_SHAPES = 10
N_FEATURES = KINDS + N_SHAPES + ENDINGS
HIDDEN, GATE = 24, 12


def _kinds() -> np.ndarray:
    table = np.full(65536, 5, dtype=np.uint8)
    for c in range(65536):
        x = chr(c)
        table[c] = 0 if x.islower() else 1 if x.isupper() else 2 if x.isdigit() else 4 if x == "\n" else 3 if x.isspace() else 5
    for i, x in enumerate(PUNCTUATION):
        table[ord(x)] = 6 + i
    return table


KIND_OF = _kinds()
SPACE_OF = (KIND_OF == 3) | (KIND_OF == 4)


def passages(text: str) -> np.ndarray:
    """Features of a text's passages, one row each."""
    codes = np.frombuffer(text.encode("utf-16-le", "surrogatepass"), dtype="<u2")
    space = SPACE_OF[codes]
    starts = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    if not starts.size:
        return np.zeros((1, N_FEATURES), dtype=np.float32)
    ends = np.flatnonzero(~space & np.concatenate([space[1:], [True]])) + 1
    n = -(-starts.size // PASSAGE_WORDS)
    word_passage = np.arange(starts.size) // PASSAGE_WORDS
    borders = np.append(starts[::PASSAGE_WORDS], codes.size)
    borders[0] = 0
    size = np.diff(borders).astype(np.float32)
    char_passage = np.repeat(np.arange(n), np.diff(borders))
    kinds = np.bincount(char_passage * KINDS + KIND_OF[codes], minlength=n * KINDS).reshape(n, KINDS) / size[:, None]
    words = np.bincount(word_passage, minlength=n)
    length = ends - starts
    a, b, c = codes[ends - 1].astype(np.int64), codes[np.maximum(ends - 2, starts)].astype(np.int64), codes[starts].astype(np.int64)
    ending = (a * 31 + b * 1009) % 8191 % ENDINGS
    endings = np.bincount(word_passage * ENDINGS + ending, minlength=n * ENDINGS).reshape(n, ENDINGS) / words[:, None]

    def mean(x: np.ndarray) -> np.ndarray:
        return np.bincount(word_passage, weights=x, minlength=n) / words

    # a word stands for its length, both ends and a middle character in the count of distinct words
    middle = codes[(starts + ends) // 2].astype(np.int64)
    word_id = (((length * 65537 + a) * 65537 + b) * 65537 + c) * 65537 + middle
    pairs = np.unique(np.stack([word_passage, word_id]), axis=1)[0] if n > 1 else np.zeros(np.unique(word_id).size, dtype=int)
    distinct = np.bincount(pairs, minlength=n) / words
    letters = KIND_OF[codes[ends - 1]] <= 1
    upper_start = KIND_OF[codes[starts]] == 1
    upper_end = KIND_OF[codes[ends - 1]] == 1
    stops = (codes[ends - 1] == ord(".")).astype(float)
    shapes = np.stack(
        [mean(length) / 10, np.sqrt(mean(length.astype(float) ** 2)) / 10, mean(length == 1), mean(length > 15), mean(~letters), mean(upper_start), mean(upper_end), mean(stops), distinct, np.minimum(words / PASSAGE_WORDS, 1)], axis=1
    )
    return np.concatenate([kinds * 4, shapes * 2, endings * 2], axis=1).astype(np.float32)


class Model:
    """Gated attention over a bag's passages, trained by Adam on the log loss."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.mean, self.scale = np.zeros(N_FEATURES), np.ones(N_FEATURES)
        self.prior = 0.5
        self.fitted = False
        self.p = {
            "w": r.normal(0, 1 / np.sqrt(N_FEATURES), (N_FEATURES, HIDDEN)), "b": np.zeros(HIDDEN),
            "v": r.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, GATE)), "u": r.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, GATE)),
            "a": r.normal(0, 1 / np.sqrt(GATE), GATE), "c": r.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), "d": np.zeros(1),
        }

    def forward(self, x: np.ndarray, at: np.ndarray, bag: np.ndarray, n: int):
        """x: passages of all bags, one after another; at: where each of the n bags starts; bag: each passage's."""
        p = self.p
        h = np.tanh((x - self.mean) / self.scale @ p["w"] + p["b"])
        t, g = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-(h @ p["u"])))
        e = (t * g) @ p["a"]
        e = np.exp(e - np.maximum.reduceat(e, at)[bag])
        weight = e / np.add.reduceat(e, at)[bag]
        z = np.add.reduceat(weight[:, None] * h, at)
        y = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"][0], -30, 30)))
        return h, t, g, weight, z, y

    def score(self, bags: list[np.ndarray]) -> np.ndarray:
        if not self.fitted:
            return np.full(len(bags), self.prior)
        sizes = np.array([len(b) for b in bags])
        at = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        return self.forward(np.concatenate(bags), at, np.repeat(np.arange(len(bags)), sizes), len(bags))[-1]

    def fit(self, bags: list[np.ndarray], labels: np.ndarray, epochs: int = 40, size: int = 64, rate: float = 0.01, decay: float = 1e-4, seed: int = 7) -> Model:
        if labels.size:
            self.prior = float(labels.mean())
        if len(set(labels.tolist())) < 2:
            return self
        self.fitted = True
        everything = np.concatenate(bags)
        self.mean, self.scale = everything.mean(axis=0), everything.std(axis=0) + 0.05
        r, p, step = np.random.default_rng(seed), self.p, 0
        m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
        for epoch in range(epochs):
            order = r.permutation(len(bags))
            for lo in range(0, len(order), size):
                own = order[lo : lo + size]
                sizes = np.array([len(bags[i]) for i in own])
                at, bag = np.concatenate([[0], np.cumsum(sizes)[:-1]]), np.repeat(np.arange(len(own)), sizes)
                grads = self.gradients(np.concatenate([bags[i] for i in own]), at, bag, labels[own])
                step += 1
                now = rate * (1 - epoch / epochs)
                for k, g in grads.items():
                    g = g + decay * p[k]
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    p[k] -= now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return self

    def gradients(self, x: np.ndarray, at: np.ndarray, bag: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        p, n = self.p, len(label)
        h, t, g, weight, z, y = self.forward(x, at, bag, n)
        dy = (y - label) / n
        dz = dy[:, None] * p["c"]
        dweight = (dz[bag] * h).sum(axis=1)
        de = weight * (dweight - np.add.reduceat(weight * dweight, at)[bag])
        dgate = de[:, None] * p["a"]
        dt, dg = dgate * g * (1 - t * t), dgate * t * g * (1 - g)
        dh = weight[:, None] * dz[bag] + dt @ p["v"].T + dg @ p["u"].T
        pre = dh * (1 - h * h)
        return {"w": ((x - self.mean) / self.scale).T @ pre, "b": pre.sum(axis=0), "v": h.T @ dt, "u": h.T @ dg, "a": (t * g).T @ de, "c": z.T @ dy, "d": np.array([dy.sum()])}


def train(docs: DataFrame, labels: DataFrame, max_train: int = 6000, max_bytes: int = 64_000_000) -> Model:
    """docs (doc_id, text) and labels (doc_id, label): a model from rows whose fold isn't 0.

    ``max_train`` and ``max_bytes`` bound what the driver holds: the passages'
    features, of about as many bytes as the texts, of so many labelled ids, those of
    least hash.  They meet their texts by a broadcast of these ids.
    """
    label = labels.where(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & (fold() != 0)).groupBy("doc_id").agg(F.min("label").alias("label"))
    chosen = label.withColumn("h", F.xxhash64(F.col("doc_id").cast("string"))).orderBy("h").limit(max_train)
    rows = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = written(rows.groupBy("h", "label").agg(F.min("text").alias("text")), "training")  # an id may have several rows
    sizes, taken, total = sorted((r["h"], r["n"]) for r in rows.select("h", F.octet_length("text").alias("n")).collect()), [], 0  # max_train rows
    for h, n in sizes:
        total += n
        if total > max_bytes:
            break
        taken.append(h)
    if len(taken) < len(sizes):
        rows = rows.where(F.col("h") <= taken[-1]) if taken else rows.limit(0)

    def make():
        claim("passages")

        def run(cols):
            return {"h": cols["h"], "label": cols["label"], "x": [passages(t).tobytes() for t in cols["text"]]}

        return run

    got = sorted(map_batches(rows, make, "h long, label int, x binary").collect(), key=lambda r: (r["h"], r["x"]))
    bags = [np.frombuffer(r["x"], dtype=np.float32).reshape(-1, N_FEATURES) for r in got]
    return Model().fit(bags, np.array([r["label"] for r in got], dtype=float))


def score(docs: DataFrame, model: Model, *keep: str, name: str = "score") -> DataFrame:
    """docs with a score under that name; columns in ``keep`` stay."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*[F.col(f"`{k}`") for k in keep], text_of().alias("__scored_text"))
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keep)

    def make():
        claim("passages")
        model = shared.value

        def run(cols):
            scores, texts = [], cols["__scored_text"]
            for at in range(0, len(texts), 100):
                scores += model.score([passages(t) for t in texts[at : at + 100]]).tolist()
            return {k: cols[k] for k in keep} | {name: scores}

        return run

    return map_batches(rows, make, f"{kinds}, `{name}` double")


def tables(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return docs, labels.select("doc_id", F.col("quality").cast("int").alias("label"))


def op4_quality(spark, sf_dir: str, threshold: float = 0.3) -> DataFrame:
    docs, labels = tables(spark, sf_dir)
    scored = score(docs, train(docs, labels), "doc_id")
    return scored.select("doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
