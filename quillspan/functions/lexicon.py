"""Fixed values of the text search: word lists, symbols, keyboards, parameters."""

from __future__ import annotations

from dataclasses import dataclass

# Stop words, symbols that count as spaces, names of digits, keyboard rows, letters that sound alike, letters for insertion.
STOP_WORDS = "؟ ? : و در به از که می این است را با های برای تا ای بر بود کند هم یا نمی آن ان شود شده خود کرد شد گفت چه هر اما ما شما تو من او همه » «".split()
SYMBOLS = ".؟?)(»«<>،-|[]{},/؛+!ء_;‏‍=:–*'"
DIGIT_WORDS = {"۰": "صفر", "۱": "یک", "۲": "دو", "۳": "سه", "۴": "چهار", "۵": "پنج", "۶": "شش", "۷": "هفت", "۸": "هشت", "۹": "نه"}
KEYBOARDS = {
    "en": ["qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,"],
    "fa": ["ضصثقفغعهخحجچپ", "شسیبلاتنمکگ", "ظطزرذدئو"],
}
SOUND_ALIKE = ["زذظض", "صسث", "حه", "یئ", "قغ", "تط"]
KEY_OF = {"آ": "ا", "ژ": "ز"}
#: Steps from a key to its neighbours, by the key's row: (rows down, keys right).
STEPS = [
    [(0, -1), (0, 1), (1, 0), (1, -1)],
    [(0, -1), (0, 1), (-1, 0), (1, 0), (-1, 1), (1, -1)],
    [(0, -1), (0, 1), (-1, 0), (-1, 1)],
]
ZWNJ = "‌"
FOLDED = {ZWNJ: " ", "ي": "ی", "ك": "ک"}
END = "<END>"

ALPHABETS = {"en": "".join(c for row in KEYBOARDS["en"] for c in row if c.isalpha()), "fa": "".join(KEYBOARDS["fa"]) + "ژآ"}


@dataclass(frozen=True)
class Parameters:
    title_weight: float = 0.7
    body_weight: float = 0.3
    k1: float = 1.2
    b: float = 0.75
    bigram_share: float = 0.9
    minor: int = 10
    results: int = 10
    candidates: int = 3
    continuations: int = 3
    suggestions: int = 3
    enough_hits: int = 10
    likely: float = 0.0001
    window: int = 160
    lead: int = 20
    fallback: int = 100


def place_of(char: str) -> tuple[str, int, int] | None:
    char = KEY_OF.get(char, char)
    return next(((lang, i, row.index(char)) for lang, rows in KEYBOARDS.items() for i, row in enumerate(rows) if char in row), None)


def neighbours(char: str) -> list[str]:
    """Letters that sound like this one, then the keys around it.

    A step that leaves the row's width is left out; one onto a shorter row that
    has no such key ends the list.
    """
    near = [x for group in SOUND_ALIKE if char in group for x in group if x != char]
    if place := place_of(char):
        lang, i, j = place
        rows = KEYBOARDS[lang]
        for down, right in STEPS[i]:
            if 0 <= j + right < len(rows[i]):
                if j + right >= len(rows[i + down]):
                    break
                near.append(rows[i + down][j + right])
    return near


def other_key(char: str, lang: str) -> str | None:
    """The same key's character on the layout ``lang``; none if the character is of that layout; the last key if it is of none."""
    place = place_of(char)
    if place is None:
        return KEYBOARDS[lang][-1][-1]
    return None if place[0] == lang else KEYBOARDS[lang][place[1]][place[2]]


#: Every character that a keyboard has, or that stands for one.
KEYS = [c for rows in KEYBOARDS.values() for row in rows for c in row] + list(KEY_OF)
NEIGHBOURS = {c: neighbours(c) for c in KEYS}
SWAPS = {lang: {c: k for c in KEYS if (k := other_key(c, lang))} for lang in KEYBOARDS}
