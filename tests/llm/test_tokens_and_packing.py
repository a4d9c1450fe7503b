"""Chunked encoding equals the library; packing keeps every token and wastes little; the count cache grows by misses only."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspan.llm import packing, token_counts
from quillspan.llm.tokens import ChunkEncoder, tokenizer_path

ODD = ["", " ", "  a  b", "don't  'S x́ é  z\x1c q\x85r", "a<|endoftext|>b <|endoftext|> c <|startoftext|>", "İX ß ſ 12345 1a2", "\n\n a \n b", "a" * 300 + " b", "🙂👍🏽 x​y", "<| x |>", "a\tb \tc", "\r\na b ", '"Word," (other) x;y']


@pytest.mark.parametrize("name,spaced", [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_encoder_equals_library(name, spaced):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path(name))
    r = random.Random(1)
    texts = ODD + ["".join(r.choice(["a", "B", "1", " ", "\n", "\t", "'s", "é", "́", ".", ",", "　", "中", "<|endoftext|>", "<|", "|>", "\xa0", "'", "s ", "_", "Wort "]) for _ in range(50)) for _ in range(400)]
    latin = ["a", "É", "ß", "ÿ", "×", "÷", "9", "  ", " ", "\n", "\t", "\x0b", "\x1c", "\x1f", "\x7f", "\0", "'", "'LL", "'re", "'s", "-", ".,", "Und", " Ñ"]
    texts += ["".join(r.choice(latin) for _ in range(60)) for _ in range(600)]
    texts += ["".join(r.choice([*latin, "ª", "µ", "²", "\x85", "ı", "е"]) for _ in range(60)) for _ in range(200)]
    small = ChunkEncoder(name, spaced, limit=40)
    for at in range(0, len(texts), 50):
        for t, ids in zip(texts[at : at + 50], small.encode(texts[at : at + 50])):
            assert np.frombuffer(ids, dtype="<u4").tolist() == tok.encode(t, add_special_tokens=False).ids, repr(t)


def test_best_two_fit_swaps_the_smallest():
    # 6 and 3 leave a gap of 1 in 10; the two pieces of 2 fill the 4 that 3 leaves
    bins = packing.best_two_fit({6: 1, 3: 1, 2: 2}, 10)
    assert bins[0] == ({6: 1, 2: 2}, 1)


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_every_piece_once(seed):
    r = random.Random(seed)
    cap = 64
    counts = {}
    for _ in range(r.choice([3, 500, 5000])):
        n = min(cap, int(r.expovariate(1 / 20)) + 1)
        counts[n] = counts.get(n, 0) + 1
    bins = packing.best_two_fit(counts, cap)
    used = {}
    for own, times in bins:
        assert sum(k * n for k, n in own.items()) <= cap
        for k, n in own.items():
            used[k] = used.get(k, 0) + n * times
    assert used == counts
    places = packing.Places(bins)
    spans = {}
    for k, n in counts.items():
        for s, o in zip(*places.of(np.full(n, k), np.arange(n))):
            spans.setdefault(int(s), []).append((int(o), k))
    for own in spans.values():
        at = 0
        for o, k in sorted(own):
            assert o == at
            at += k
    least = -(-sum(k * n for k, n in counts.items()) // cap)
    assert places.sequences == len(spans) <= least * 1.03 + 2


def test_pack(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    texts = [(1, "one two three"), (2, ""), (None, None), (3, "word " * 130), (3, "word " * 130), (4, "x " * 63)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumn("sequence_id", F.lit("clash"))
    got = packing.pack(docs, "word_bpe_49k.json", 64, 1).collect()
    ids = {(i, t): [*tok.encode(t or "", add_special_tokens=False).ids, 1] for i, t in texts}
    assert sum(r.length for r in got) == sum(len(ids[i, t]) for i, t in texts)
    assert len([r for r in got if r.doc_id == 3]) == 2 * 3 and len([r for r in got if r.doc_id == 4]) == 1
    for r in got:
        own = next(v for (i, t), v in ids.items() if i == r.doc_id)
        part = own[r.start : r.start + r.length]
        assert len(part) == r.length and r.ids_crc32 == zlib.crc32(np.array(part, dtype="<u4").tobytes())
        assert r.length == 64 or r.start + r.length == len(own)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        assert [o for o, _ in sorted(own)] == np.cumsum([0, *[n for _, n in sorted(own)]])[:-1].tolist()
    assert packing.pack(docs.limit(0), "word_bpe_49k.json", 64, 1).count() == 0


def test_counts_and_cache(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "cache")
    docs = spark.createDataFrame([(1, "a b c"), (2, "a b c"), (None, "<|endoftext|> x"), (3, None), (1, "a b c")], "doc_id long, text string").withColumn("digest", F.lit(0))
    got = token_counts.token_counts(docs, "byte_bpe_50k.json", path).collect()
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_tokens) for r in got) == [(0, 15, 3 - 1), (1, 5, 3), (1, 5, 3), (2, 5, 3), (3, 0, 0)]
    cache = token_counts.read_cache(spark, path)
    assert cache.count() == 3
    more = spark.createDataFrame([(9, "a b c"), (8, "new text")], "doc_id long, text string")
    assert token_counts.token_counts(more, "byte_bpe_50k.json", path).count() == 2
    assert token_counts.read_cache(spark, path).count() == 4
    monkeypatch.setattr(token_counts, "tokenizer_version", lambda name: "another")
    assert token_counts.token_counts(more, "byte_bpe_50k.json", path).count() == 2
    assert token_counts.read_cache(spark, path).count() == 6
    assert token_counts.token_counts(docs.limit(0), "byte_bpe_50k.json", str(tmp_path / "none")).count() == 0


def test_counts_at_the_limit(spark, tmp_path):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    texts = [(n, "a" + " b" * (n - 1)) for n in (1, 1023, 1024, 1025)] + [(7, "long text of words, " * 60_000)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in token_counts.op10_token_counts(spark, str(tmp_path)).collect()}
    for i, t in texts:
        n = len(tok.encode(t, add_special_tokens=False).ids)
        assert (got[i].n_tokens, got[i].over_limit, got[i].n_bytes) == (n, n > 1024, len(t)) and (i == 7 or n == i)


def test_contents_are_normalised_as_the_tokenizer_does(spark, tmp_path):
    """Texts that its normaliser makes equal share an entry; special strings in other letters don't become special."""
    from tokenizers import Tokenizer

    name, path = "word_bpe_49k.json", str(tmp_path / "cache")
    tok = Tokenizer.from_file(tokenizer_path(name))
    special = next(iter(tok.get_added_tokens_decoder().values())).content
    texts = ["Some Words", "some  words", "SOME\nwords", "caf\u00e9", "cafe\u0301", f"x{special}y", f"x{special.upper()}y", f"X{special}Y"]
    content = token_counts.content_of(name)
    for a in texts:
        for b in texts:
            if content(a) == content(b):
                assert len(tok.encode(a, add_special_tokens=False).ids) == len(tok.encode(b, add_special_tokens=False).ids)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    # counts of the chunked encoder are for byte level; the key is what is looked at here
    keys = {r.doc_id: bytes(r.digest) for r in token_counts.with_digest(docs, name).collect()}
    assert keys[0] == keys[1] == keys[2] and keys[3] == keys[4] and keys[5] == keys[7] != keys[6]
    assert token_counts.content_of("byte_bpe_50k.json") is None and path


def test_very_long_and_odd_rows_are_packed(spark):
    texts = [(1, "word " * 300_000), (2, ""), (2, ""), (None, "x"), (3, None)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("piece", "start", "length", "offset")})
    got = packing.pack(docs, "word_bpe_49k.json", 4096, 1).collect()
    own = sorted((r.start, r.length) for r in got if r.doc_id == 1)
    assert len(own) > 70 and all(n == 4096 for _, n in own[:-1]) and len([r for r in got if r.doc_id == 2]) == 2
