"""Media columns: 8-bit PCM in Ogg, written, read back and described.

Writing: a payload becomes a physical stream of two logical ones, the samples
(an OggPCM header, a comment packet, then packets of one second) and an index
stream that holds the payload's length before padding.  Reading: every page's
checksum is verified, packets are put together from lacing values across pages,
logical streams are told apart by serial number, and a packet's end time comes
from the granule positions.

Defined results: a null text counts as the empty one and is stored as 64 zero
bytes; damaged streams raise OggError; equal texts give equal values; repeated
rows are described each; other columns are left alone and dropped.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, text_of

RATE = 8000
UNIT = 64
#: Byte with its bits in reverse order.
_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))
#: The page header before the lacing values: capture pattern, version, flags, granule, serial, number, checksum, segments.
_HEAD = struct.Struct("<4sBBqIIIB")
CONTINUED, FIRST, LAST = 1, 2, 4
NO_PACKET_ENDS = -1


class OggError(ValueError):
    pass


def checksum(page: bytes) -> int:
    """Ogg's CRC-32: zlib's polynomial, bits not reflected, no inversion before or after.

    zlib works on reflected bits, so bytes go in and the sum comes out reversed;
    its two inversions are undone.
    """
    crc = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(crc.to_bytes(4, "little").translate(_REVERSED), "big")


def page(serial: int, number: int, flags: int, granule: int, lacing: bytes, body: bytes) -> bytes:
    blank = _HEAD.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + lacing + body
    return blank[:22] + checksum(blank).to_bytes(4, "little") + blank[26:]


def lacing_values(size: int) -> bytes:
    return b"\xff" * (size // 255) + bytes([size % 255])


def pages_of(serial: int, packets: list[tuple[bytes, int]]) -> list[bytes]:
    """Pages of one logical stream; packets come with the granule position at their end.

    The first packet has a page of its own, as it tells the codec.
    """
    out: list[bytes] = []
    groups = [packets[:1], packets[1:]]
    for g, group in enumerate(groups):
        lacing = b"".join(lacing_values(len(p)) for p, _ in group)
        body = b"".join(p for p, _ in group)
        ends, at = [], 0
        for p, granule in group:
            at += len(p) // 255 + 1
            ends.append((at, granule))
        done, k, inside = 0, 0, False
        for seg in range(0, len(lacing), 255):
            part = lacing[seg : seg + 255]
            granule = NO_PACKET_ENDS
            while k < len(ends) and ends[k][0] <= seg + len(part):
                granule = ends[k][1]
                k += 1
            last = seg + len(part) == len(lacing) and (g == 1 or not groups[1])
            flags = CONTINUED * inside | FIRST * (not out) | LAST * last
            size = sum(part)
            out.append(page(serial, len(out), flags, granule, part, body[done : done + size]))
            done += size
            inside = part[-1] == 255
    return out


def encode(payload: bytes, n_bytes: int) -> bytes:
    """The physical stream of a payload of samples, n_bytes of them before padding."""
    serial = zlib.crc32(payload)
    header = b"PCM     " + struct.pack(">HHIIBBHI", 0, 0, 0, RATE, 8, 1, 0, 0)  # version 0.0, unsigned 8 bits, one channel
    samples: list[tuple[bytes, int]] = [(header, 0), (b"quillspan", 0)]
    samples += [(payload[at : at + RATE], min(at + RATE, len(payload))) for at in range(0, len(payload), RATE)]
    index = [(b"index   ", 0), (struct.pack("<QQ", n_bytes, len(payload)), len(payload))]
    a, b = pages_of(serial, samples), pages_of(serial ^ 0xFFFFFFFF, index)
    return b"".join([a[0], b[0], *a[1:2], *b[1:], *a[2:]])  # first pages of all streams come first; then streams alternate


@dataclass
class Stream:
    """A logical stream as read: packets, and where pages tell a granule position, that of the last packet ended."""

    serial: int
    packets: list[bytes] = field(default_factory=list)
    granules: list[int] = field(default_factory=list)
    pages: int = 0
    ended: bool = False
    part: list[bytes] = field(default_factory=list)


def read(media: bytes) -> list[Stream]:
    """Logical streams in the order in which they begin."""
    streams: dict[int, Stream] = {}
    at = 0
    while at < len(media):
        if len(media) - at < _HEAD.size:
            raise OggError("cut off in a page's header")
        mark, version, flags, granule, serial, number, crc, n = _HEAD.unpack_from(media, at)
        if mark != b"OggS" or version:
            raise OggError(f"no page at byte {at}")
        lacing = media[at + _HEAD.size : at + _HEAD.size + n]
        end = at + _HEAD.size + n + sum(lacing)
        if len(lacing) < n or end > len(media):
            raise OggError("cut off in a page")
        raw = media[at:end]
        if checksum(raw[:22] + b"\0\0\0\0" + raw[26:]) != crc:
            raise OggError(f"checksum of the page at byte {at}")
        if bool(flags & FIRST) == (serial in streams):
            raise OggError("a stream begins twice or never")
        s = streams.setdefault(serial, Stream(serial))
        if number != s.pages or s.ended:
            raise OggError("a page is missing or stands after the end")
        if bool(flags & CONTINUED) != bool(s.part):
            raise OggError("a packet's other part is missing")
        s.pages += 1
        place = at + _HEAD.size + n
        for size in lacing:
            s.part.append(media[place : place + size])
            place += size
            if size < 255:
                s.packets.append(b"".join(s.part))
                s.granules.append(NO_PACKET_ENDS)
                s.part = []
        if granule != NO_PACKET_ENDS and s.granules:
            s.granules[-1] = granule
        s.ended = bool(flags & LAST)
        at = end
    if any(s.part or not s.ended for s in streams.values()):
        raise OggError("a stream has no end")
    return list(streams.values())


@dataclass
class Sound:
    samples: bytes
    n_bytes: int
    rate: int
    pages: int
    packets: int
    #: Seconds at which data packets end.
    ends: list[float]


def decode(media: bytes) -> Sound:
    if media is None:
        raise OggError("no media")
    streams = read(media)
    by_kind = {s.packets[0][:8]: s for s in streams}
    pcm, index = by_kind.get(b"PCM     "), by_kind.get(b"index   ")
    if pcm is None or index is None:
        raise OggError("a stream of samples or their index is missing")
    if len(pcm.packets) < 3 or len(pcm.packets[0]) < 20 or len(index.packets) < 2 or len(index.packets[1]) != 16:
        raise OggError("a header is cut off")
    rate = struct.unpack_from(">I", pcm.packets[0], 16)[0]
    if not rate:
        raise OggError("no sample rate")
    data = pcm.packets[2:]
    samples = b"".join(data)
    n_bytes, n_samples = struct.unpack("<QQ", index.packets[1])
    if n_samples != len(samples) or pcm.granules[-1] != n_samples:
        raise OggError("samples are missing")
    # a page tells the position of its last packet; those before it follow from their lengths
    ends, position = [0] * len(data), 0
    for i in range(len(data) - 1, -1, -1):
        position = pcm.granules[i + 2] if pcm.granules[i + 2] != NO_PACKET_ENDS else position
        ends[i] = position
        position -= len(data[i])
    if position:
        raise OggError("granule positions don't fit the packets")
    return Sound(samples, n_bytes, rate, sum(s.pages for s in streams), sum(len(s.packets) for s in streams), [e / rate for e in ends])


def describe(sound: Sound) -> str:
    """Features of the samples, rounded so that they are equal on every machine."""
    x = np.frombuffer(sound.samples, dtype=np.uint8).astype(np.int64) - 128
    rms = int(np.dot(x, x)) / len(x)
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0))) if len(x) > 1 else 0
    steps = int(np.abs(np.diff(x)).sum())
    seconds = [f"{e:.6f}" for e in sound.ends[-1:]]
    loud = [int(np.abs(x[at : at + RATE]).sum()) * 1000 // len(x[at : at + RATE]) for at in range(0, len(x), RATE)]
    return (
        f"rate={sound.rate};end_s={seconds[0] if seconds else 0};pages={sound.pages};packets={sound.packets};mean={int(x.sum()) / len(x):.4f};power={rms:.4f};"
        f"zcr={crossings / len(x):.6f};step={steps / len(x):.4f};min={int(x.min())};max={int(x.max())};loudest_s={loud.index(max(loud))}"
    )


def payload_of(text: str) -> tuple[bytes, int]:
    raw = text.encode()
    return raw + b"\0" * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw)), len(raw)


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, media): each text's bytes as sound in Ogg."""
    docs = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))

    def make():
        def run(cols):
            yield {"doc_id": cols["doc_id"], "media": [encode(*payload_of(t)) for t in cols["text"]]}

        return run

    return map_batches(docs, make, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, media binary")


def read_media(media: DataFrame) -> DataFrame:
    """(doc_id, media) to sizes, digests and features of what is stored."""
    fields = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    names = [f.split()[0] for f in fields.split(", ")]

    def make():
        def one(m: bytes):
            s = decode(m)
            return s.n_bytes, len(s.samples), hashlib.sha256(s.samples).hexdigest(), zlib.crc32(s.samples[-UNIT:]), len(m), hashlib.sha256(m).hexdigest(), describe(s)

        def run(cols):
            return {"doc_id": cols["doc_id"]} | dict(zip(names, zip(*map(one, cols["media"]))))

        return run

    return map_batches(media, make, f"doc_id {media.schema['doc_id'].dataType.simpleString()}, {fields}")


def op5_media(spark, sf_dir: str) -> DataFrame:
    return read_media(store_texts(spark.read.parquet(f"{sf_dir}/documents.parquet")))
