"""Token ids of whole texts by a public tokenizer, each distinct pre-token encoded once.

A byte-pair encoder parts a text into pre-tokens before it merges, so a text's ids
are its pre-tokens' ids one after another.  Texts of ASCII and Latin-1 letters are
parted here, by the tokenizer's pattern for these characters; other texts are cut
where a border is sure, and only the chunks with other characters stay whole.  A
few hundred thousand units stay in a bounded dictionary.  A pre-token goes to the
library's model at once; whole chunks go through all of the tokenizer together,
parted by the special token, whose id never comes from ordinary text.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct

import numpy as np

#: Units longer than this are encoded but not kept.
KEEP_CHARS = 48
#: Characters of which letters, digits and blanks are known here: ASCII and the letters of Latin-1.
OTHER = re.compile(r"[^\x00-\x7f\xc0-\xff]")
LETTER, BLANK = r"A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff", r"\t-\r "
SHORT = "'(?:s|t|re|ve|m|ll|d)"
#: Pre-tokens of tokenizers that drop white space, and of those that keep it (byte level).
DROPPED = re.compile(f"[{LETTER}]+|{SHORT}|[0-9]|[^{BLANK}{LETTER}0-9]+")
KEPT = re.compile(f" ?[{LETTER}]+|{SHORT}| ?[0-9]+| ?[^{BLANK}{LETTER}0-9]+|[{BLANK}]+(?![^{BLANK}])|[{BLANK}]+")
#: The model's character for each byte: printable bytes stand for themselves, others follow from U+0100.
PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTES = "".join(chr(b if b in PRINTED else 256 + sum(x not in PRINTED for x in range(b))) for b in range(256))


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return name if os.sep in name else public_tokenizers.path(name)


def tokenizer_version(name: str) -> str:
    """Digest of the tokenizer's file: counts of another version never match."""
    with open(tokenizer_path(name), "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


class ChunkEncoder:
    """Encodes texts by a ``tokenizers`` file without added special tokens.

    ``spaced`` tells how texts are cut.  False: the tokenizer lowers letters and
    drops white space, so any space parts chunks.  True (byte level): a space
    belongs to the word after it, so chunks start at single spaces, and texts of
    other characters with other runs of white space are encoded as they are.
    """

    def __init__(self, name: str, spaced: bool, part: str = "<|endoftext|>", limit: int = 800_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(tokenizer_path(name))
        self.model = self.tok.model
        self.spaced, self.part, self.limit = spaced, part, limit
        self.part_id = self.tok.token_to_id(part)
        self.cache: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _chunks(self, text: str) -> list[str] | None:
        if not self.spaced:
            return text.replace("\n", " ").split(" ")
        first, *rest = text.split(" ")
        for c in rest:
            if not c or c[0].isspace():
                return None
        if any(c and c[-1].isspace() for c in (first, *rest)):
            return None
        return [first, *[" " + c for c in rest]]

    def _units(self, text: str) -> list[str] | None:
        """Strings whose ids make up the text's; none where no border is sure."""
        if self.part[:2] not in text and not OTHER.search(text):
            return KEPT.findall(text) if self.spaced else DROPPED.findall(text.lower())
        if (chunks := self._chunks(text)) is None:
            return None
        units: list[str] = []
        for c in chunks:
            if self.part[:2] in c or OTHER.search(c):
                units.append(c)
            else:
                units += KEPT.findall(c) if self.spaced else DROPPED.findall(c.lower())
        return units

    def _merged(self, unit: str) -> bytes:
        """A pre-token's ids by the library's model."""
        ids = [t.id for t in self.model.tokenize(unit.encode().decode("latin-1").translate(BYTES))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _encode_apart(self, pieces: list[str]) -> dict[str, bytes]:
        found = {}
        plain = [p for p in pieces if self.part[:2] not in p]
        blocks = [plain[at : at + 1000] for at in range(0, len(plain), 1000)]
        coded = self.tok.encode_batch_fast([self.part.join(b) for b in blocks], add_special_tokens=False)
        for block, e in zip(blocks, coded):
            ids = np.array(e.ids, dtype="<u4")
            ends = np.flatnonzero(ids == self.part_id)
            if len(ends) != len(block) - 1:
                found.update((p, self.whole(p)) for p in block)
                continue
            raw, start = ids.tobytes(), 0
            for p, end in zip(block, [*(ends * 4).tolist(), len(raw)]):
                found[p] = raw[start:end]
                start = end + 4
        found.update((p, self.whole(p)) for p in pieces if p not in found)
        return found

    def _learn(self, missing: list[str]) -> dict[str, bytes]:
        short = [u for u in missing if len(u) <= KEEP_CHARS]
        chunks = [u for u in short if self.part[:2] in u or OTHER.search(u)]
        found = self._encode_apart(chunks)
        found.update((u, self._merged(u)) for u in short if u not in found)
        if len(self.cache) < self.limit:
            self.cache.update(found)
        found.update((u, self.whole(u)) for u in missing if len(u) > KEEP_CHARS)
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit numbers.

        A full dictionary stays as it is, since frequent words come early; it is
        emptied when most words of a batch are missing, as in another language.
        """
        cut = [self._units(t) for t in texts]
        seen = set().union(*(c for c in cut if c))
        own = {c: self.cache.get(c) for c in seen}  # a batch's units fit the processor's cache, the dictionary doesn't
        missing = [c for c, ids in own.items() if ids is None]
        if len(self.cache) >= self.limit and len(missing) > 0.6 * len(seen):
            self.cache.clear()
        own.update(self._learn(missing))
        get = own.__getitem__
        return [self.whole(t) if c is None else b"".join(map(get, c)) for t, c in zip(texts, cut)]
