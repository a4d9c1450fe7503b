"""Round trips, damage, and a reader written apart from the writer."""

import hashlib
import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from quillspan.llm import ogg


def slow_crc(data):
    crc = 0
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ (0x04C11DB7 if crc & 0x80000000 else 0)) & 0xFFFFFFFF
    return crc


@pytest.mark.parametrize("data", [b"", b"a", b"OggS" * 9, bytes(range(256))])
def test_checksum(data):
    assert ogg.checksum(data) == slow_crc(data)


@pytest.mark.parametrize("size", [0, 1, 63, 64, 65, 7999, 8000, 8001, 255 * 255, 70_000, 200_000])
def test_round_trip(size):
    text = "".join(random.Random(size).choice("abcé ") for _ in range(size))
    payload, n = ogg.payload_of(text)
    assert len(payload) % 64 == 0 and len(payload) >= 64 and payload[:n].decode() == text and not payload[n:].strip(b"\0")
    sound = ogg.decode(ogg.encode(payload, n))
    assert (sound.samples, sound.n_bytes) == (payload, n)
    assert sound.ends == [min(8000 * (i + 1), len(payload)) / 8000 for i in range(-(-len(payload) // 8000))]


def test_packets_over_pages_and_exact_lacing():
    packets = [(b"h", 0), (b"x" * 255, 5), (b"", 6), (b"y" * 140_000, 7), (b"z" * 510, 8)]
    pages = ogg.pages_of(3, packets)
    s = ogg.read(b"".join(pages))[0]
    assert s.packets == [p for p, _ in packets] and s.granules[-1] == 8
    flags = [p[5] for p in pages]
    assert flags[0] & ogg.FIRST and flags[-1] & ogg.LAST and any(f & ogg.CONTINUED for f in flags)
    assert any(struct.unpack_from("<q", p, 6)[0] == -1 for p in pages)


def test_streams_are_told_apart():
    a, b = ogg.pages_of(1, [(b"a", 0), (b"A" * 100_000, 9)]), ogg.pages_of(2, [(b"b", 0), (b"B" * 100_000, 9)])
    mixed = [x for pair in zip(a, b) for x in pair]
    assert [s.packets[1][:1] for s in ogg.read(b"".join(mixed))] == [b"A", b"B"]


def test_damage_is_found():
    good = ogg.encode(*ogg.payload_of("some text " * 3000))
    r = random.Random(5)
    for _ in range(60):
        bad = bytearray(good)
        bad[r.randrange(len(bad))] ^= 1 << r.randrange(8)
        with pytest.raises(ogg.OggError):
            ogg.decode(bytes(bad))
    for cut in (10, 40, len(good) - 1, len(good) // 2):
        with pytest.raises(ogg.OggError):
            ogg.decode(good[:cut])


def test_query(spark):
    docs = spark.createDataFrame([(1, "héllo"), (2, "héllo"), (None, None), (4, ""), (5, "x" * 100_000)], "doc_id long, text string")
    rows = ogg.read_media(ogg.store_texts(docs)).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == 5 and by[1][1:] == by[2][1:] and by[None][1:] == by[4][1:]
    payload, n = ogg.payload_of("héllo")
    assert (by[1].n_bytes, by[1].payload_bytes, by[1].payload_sha256, by[1].tail_crc32) == (n, 64, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert by[5].payload_bytes == 100_032 and ogg.read_media(ogg.store_texts(docs.limit(0))).count() == 0


def plain_read(media):
    """Packets of each stream by serial number, and the granule position at its end: from the format's description."""
    at, streams, granules = 0, {}, {}
    while at < len(media):
        assert media[at : at + 4] == b"OggS" and media[at + 4] == 0
        granule, serial, _, crc = struct.unpack("<qIII", media[at + 6 : at + 26])
        lacing = list(media[at + 27 : at + 27 + media[at + 26]])
        end = at + 27 + len(lacing) + sum(lacing)
        page = bytearray(media[at:end])
        page[22:26] = bytes(4)
        assert slow_crc(page) == crc
        packets, body = streams.setdefault(serial, [b""]), at + 27 + len(lacing)
        for size in lacing:
            packets[-1] += media[body : body + size]
            body += size
            if size < 255:
                packets.append(b"")
        if granule >= 0:
            granules[serial] = granule
        at = end
    assert all(p[-1] == b"" for p in streams.values())
    return {k: p[:-1] for k, p in streams.items()}, granules


def plain_feature(payload, rate, pages, packets):
    x = [b - 128 for b in payload]
    n = len(x)
    zcr = sum((a < 0) != (b < 0) for a, b in zip(x, x[1:])) / n
    step = sum(abs(b - a) for a, b in zip(x, x[1:])) / n
    seconds = [x[at : at + rate] for at in range(0, n, rate)]
    loud = [sum(map(abs, s)) * 1000 // len(s) for s in seconds]
    return (
        f"rate={rate};end_s={n / rate:.6f};pages={pages};packets={packets};mean={sum(x) / n:.4f};power={sum(v * v for v in x) / n:.4f};"
        f"zcr={zcr:.6f};step={step:.4f};min={min(x)};max={max(x)};loudest_s={loud.index(max(loud))}"
    )


def test_stored_form_by_another_reader(spark):
    texts = [(1, "héllo wörld"), (2, ""), (3, "long text with words. " * 900), (4, None), (5, "🙂" * 33)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("media", "feature", "n_bytes")})
    stored = ogg.store_texts(docs)
    media = {r.doc_id: bytes(r.media) for r in stored.collect()}
    told = {r.doc_id: r for r in ogg.read_media(stored).collect()}
    for i, t in texts:
        raw = (t or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        streams, granules = plain_read(media[i])
        sound = next(k for k, p in streams.items() if p[0].startswith(b"PCM"))
        assert b"".join(streams[sound][2:]) == payload and granules[sound] == len(payload) and len(streams) == 2
        r = told[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(media[i]), hashlib.sha256(media[i]).hexdigest())
        assert r.feature == plain_feature(payload, 8000, media[i].count(b"OggS"), sum(map(len, streams.values())))


def test_other_media_are_refused():
    pcm_only = b"".join(ogg.pages_of(1, [(b"PCM     " + bytes(20), 0), (b"c", 0), (b"x" * 64, 64)]))
    other = b"".join(ogg.pages_of(1, [(b"vorbis", 0), (b"x", 1)]))
    short = b"".join([*ogg.pages_of(1, [(b"PCM     ", 0), (b"c", 0), (b"x", 1)]), *ogg.pages_of(2, [(b"index   ", 0), (b"x" * 16, 1)])])
    for bad in (None, b"", pcm_only, other, short):
        with pytest.raises(ogg.OggError):
            ogg.decode(bad)
