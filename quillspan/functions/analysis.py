"""Text analysis as column expressions: all of it stays in generated code, none is a UDF."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as lx


def remove_symbols(text: Column) -> Column:
    return F.translate(text, lx.SYMBOLS, " " * len(lx.SYMBOLS))


def tokenize(text: Column) -> Column:
    """Symbols to spaces, white space to one space, lower case, Arabic letters to Persian ones, then words."""
    x = F.lower(F.trim(F.regexp_replace(remove_symbols(F.coalesce(text, F.lit(""))), r"(?U)\s+", " ")))
    x = F.translate(x, "".join(lx.FOLDED), "".join(lx.FOLDED.values()))
    return F.filter(F.split(x, " "), lambda t: t != "")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) where value is computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def clean(text: Column, lemma: Column | None = None, normalise: Callable[[Column], Column] | None = None) -> Column:
    """Words without stop words, before and after lemmas are taken, and without single characters.

    ``lemma`` is a map from a word to its lemma; without one words stay as they are.
    ``normalise`` is applied to the text before it is split.
    """
    text = text if normalise is None else normalise(text)
    tokens = F.filter(tokenize(text), lambda t: ~t.isin(lx.STOP_WORDS))
    if lemma is not None:
        tokens = F.transform(tokens, lambda t: F.coalesce(F.element_at(lemma, t), t))
    return F.filter(tokens, lambda t: (F.length(t) > 1) & ~t.isin(lx.STOP_WORDS))


def bigrams(tokens: Column) -> Column:
    """Pairs of words that follow one another, joined by a space; a joiner in a word becomes a space."""
    n = F.size(tokens) - 1
    pairs = F.zip_with(F.slice(tokens, 1, F.greatest(n, F.lit(0))), F.slice(tokens, 2, F.greatest(n, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return F.transform(pairs, lambda p: F.replace(p, F.lit(lx.ZWNJ), F.lit(" ")))


def digits_to_words(tokens: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in lx.DIGIT_WORDS.items() for x in pair])
    return F.transform(tokens, lambda t: F.coalesce(F.element_at(names, t), t))


def letters_for(word: Column) -> Column:
    """The characters that may be inserted into the word."""
    return F.when(language(word) == "en", F.split(F.lit(lx.ALPHABETS["en"]), "")).otherwise(F.split(F.lit(lx.ALPHABETS["fa"]), ""))


def edits(word: Column) -> Column:
    """Distinct strings one edit away: deletions, transpositions, neighbouring keys, insertions of the word's alphabet."""
    n = F.length(word)
    places = F.sequence(F.lit(1), F.greatest(n, F.lit(1)))
    near = F.create_map(*[x for c, adj in lx.NEIGHBOURS.items() for x in (F.lit(c), F.array(*map(F.lit, adj)))])
    letters = letters_for(word)
    left = lambda i: F.substring(word, F.lit(1), i - 1)
    right = lambda i: F.substring(word, i, n)
    inside = F.filter(places, lambda i: i <= n)
    deletes = F.transform(inside, lambda i: F.concat(left(i), right(i + 1)))
    transposes = F.transform(F.filter(places, lambda i: i < n), lambda i: F.concat(left(i), F.substring(word, i + 1, F.lit(1)), F.substring(word, i, F.lit(1)), right(i + 2)))
    replaces = F.flatten(F.transform(inside, lambda i: F.transform(F.coalesce(F.element_at(near, F.substring(word, i, F.lit(1))), F.array().cast("array<string>")), lambda c: F.concat(left(i), c, right(i + 1)))))
    inserts = F.flatten(F.transform(F.sequence(F.lit(1), n + 1), lambda i: F.transform(letters, lambda c: F.concat(left(i), c, right(i)))))
    return F.array_distinct(F.concat(deletes, transposes, replaces, inserts))


def language(word: Column) -> Column:
    """The layout that has the first character; Persian where none has."""
    return F.when(F.substring(word, 1, 1).isin(list("".join(lx.KEYBOARDS["en"]))), F.lit("en")).otherwise(F.lit("fa"))


def layout_swap(word: Column) -> Column:
    """The word as typed on the other layout, or null if it has a character of that layout already."""
    chars = F.split(word, "")
    out = None
    for lang in lx.KEYBOARDS:
        table = F.create_map(*[F.lit(x) for pair in lx.SWAPS[lang].items() for x in pair])
        foreign = [c for c in lx.KEYS if c not in lx.SWAPS[lang]]
        swapped = F.array_join(F.transform(chars, lambda c: F.coalesce(F.element_at(table, c), F.lit(lx.KEYBOARDS[lang][-1][-1]))), "")
        swapped = F.when(~F.exists(chars, lambda c: c.isin(foreign)), swapped)
        out = F.when(language(word) != lang, swapped) if out is None else F.coalesce(out, F.when(language(word) != lang, swapped))
    return out


def densest(parts: Column, lengths: Column, window: int) -> Column:
    """Where the first of the most matches within ``window`` characters starts; null without matches.

    ``parts`` are the strings between matches, ``lengths`` those of the matches.  One
    pass: the state has the place, and the starts that still share a window with it.
    """
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("near"), F.lit(0).alias("most"), F.lit(None).cast("int").alias("first"))

    def step(s, x):
        start = s["at"] + F.length(x["part"])
        return let(F.concat(F.filter(s["near"], lambda y: y > start - window), F.array(start)), lambda near: F.struct(
            (start + x["size"]).alias("at"), near.alias("near"), F.greatest(s["most"], F.size(near)).alias("most"), F.when(F.size(near) > s["most"], near[0]).otherwise(s["first"]).alias("first")
        ))

    pairs = F.zip_with(F.slice(parts, 1, F.size(lengths)), lengths, lambda part, size: F.struct(part.alias("part"), size.alias("size")))
    return F.aggregate(pairs, state, step, lambda s: s["first"])


def snippet(body: Column, query: Column, p: lx.Parameters = lx.Parameters(), regex: bool = False) -> Column:
    """The part of the body where the query's matches are densest, matches marked; its start where there are none.

    With ``regex`` the query is a pattern, otherwise it is taken literally.
    """
    pattern = query if regex else F.concat(F.lit("\\Q"), F.replace(query, F.lit("\\E"), F.lit("")), F.lit("\\E"))
    pattern = F.when(F.length(query) > 0, pattern).otherwise(F.lit("(?!)"))
    space = lambda x: F.instr(F.reverse(x), " ")

    def cut(start: Column, before: Column, until: Column) -> Column:
        begin = F.when(space(before) == 0, F.lit(0)).otherwise(F.length(before) - space(before) + 1)
        end = F.when(space(until) == 0, F.length(body) - 1).otherwise(F.length(until) - space(until))
        part = let(begin, lambda b: F.substring(body, b + 1, F.greatest(end - b, F.lit(0))))
        return F.concat(F.lit("..."), F.replace(part, query, F.concat(F.lit("<b>"), query, F.lit("</b>"))), F.lit("..."))

    def around(start: Column) -> Column:
        before = F.substring(body, F.lit(1), F.greatest(start - p.lead, F.lit(0)))
        until = F.substring(body, F.lit(1), F.least(F.length(body), start + p.window + p.lead))
        marked = let(before, lambda b: let(until, lambda u: cut(start, b, u)))
        return F.when(start.isNotNull(), marked).otherwise(F.concat(F.substring(body, F.lit(1), F.lit(p.fallback)), F.lit("...")))

    def found(parts: Column) -> Column:
        sizes = F.transform(F.regexp_extract_all(body, pattern, F.lit(0)), F.length) if regex else F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda _: F.length(query))
        return let(densest(parts, sizes, p.window), around)

    return let(F.split(body, pattern), found)
