"""Row-wise text expressions, ``Column -> Column``; usable in batch and streaming frames."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from operator import add, or_

from pyspark.sql import Column, functions as F

from gradeloom.functions.constants import CONNECTIVES, CONTRACTIONS, STOP_WORDS

# Unicode letters, numbers and underscore; Java's own \w is ASCII only.
WORD = r"\p{L}\p{N}_"
# Every character Unicode counts as white space.
BLANK = r"\s\x0b\x1c-\x1f\x85\p{Z}"

PUNCTUATION = {
    "num_commas": ",", "num_periods": ".", "num_semicolons": ";", "num_exclamations": "!",
    "num_questions": "?",
}


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    Higher-order functions run outside generated code, where repeated subexpressions are
    evaluated once per mention.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def as_text(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def normalise(text: Column) -> Column:
    """Lower-case, then delete all but word characters and white space."""
    return F.regexp_replace(F.lower(as_text(text)), f"[^{WORD}{BLANK}]+", "")


def split_contractions(text: Column) -> Column:
    """``cannot`` -> ``can not`` and the like, on normalised text."""
    heads = "|".join(f"{head}(?={tail})" for head, tail in CONTRACTIONS)
    tails = "|".join(sorted({tail for _, tail in CONTRACTIONS}))
    # Literals first and word edges after them, so most positions fail on one comparison.
    pattern = f"({heads})(?<=(?:^|[{BLANK}])[a-z]{{3}})(?=(?:{tails})(?:[{BLANK}]|$))"
    # Few texts hold any of them, and a plain search is far cheaper than the pattern.
    return bind(text, lambda t: F.when(
        reduce(or_, (F.contains(t, F.lit(head + tail)) for head, tail in CONTRACTIONS)),
        F.regexp_replace(t, pattern, "$1 ")).otherwise(t))


def words(text: Column) -> Column:
    """White-space tokens of normalised text."""
    return F.filter(F.split(text, f"[{BLANK}]+"), lambda token: token != "")


def drop_stop_words(tokens: Column, stop_words: Sequence[str] = STOP_WORDS) -> Column:
    return F.filter(tokens, lambda token: ~token.isin(list(stop_words)))


def content_tokens(text: Column, stop_words: Sequence[str] = STOP_WORDS) -> Column:
    """Normalise, split contractions, tokenise and drop stop words."""
    pieces = F.split(split_contractions(normalise(text)), f"[{BLANK}]+")
    return F.filter(pieces, lambda token: (token != "") & ~token.isin(list(stop_words)))


def ngrams(tokens: Column, n: int = 2, joined: bool = True) -> Column:
    """Consecutive token n-tuples in order, as blank-joined strings or as structs w1..wn.

    Tokens never hold a blank, so the joined form is an exact key.
    """
    def build(tok: Column) -> Column:
        length = F.greatest(F.size(tok) - F.lit(n - 1), F.lit(0))
        shifted = [F.slice(tok, F.lit(i + 1), length) for i in range(n)]
        if joined:
            return reduce(
                lambda left, right: F.zip_with(
                    left, right, lambda a, b: F.concat(a, F.lit(" "), b)), shifted)
        names = [f"w{i + 1}" for i in range(n)]
        return F.transform(
            F.arrays_zip(*shifted),
            lambda t: F.struct(*(t[str(i)].alias(name) for i, name in enumerate(names))))

    return bind(tokens, build)


def gram_runs(grams: Column) -> Column:
    """Distinct n-grams of an array as ``gram, repeats, first_pos``, in the order of the n-grams.

    One sort per row; equal n-grams lie side by side, so nothing is kept between rows.
    """
    def runs(placed: Column) -> Column:
        def change(i: Column) -> Column:
            return (i == 0) | (F.get(placed, i)["gram"] != F.get(placed, i - 1)["gram"])

        def run(starts: Column) -> Column:
            return F.transform(starts, lambda start, j: F.struct(
                F.get(placed, start)["gram"].alias("gram"),
                (F.coalesce(F.get(starts, j + 1), F.size(placed)) - start).cast("bigint").alias("repeats"),
                F.get(placed, start)["pos"].alias("first_pos")))

        places = F.filter(F.sequence(F.lit(0), F.greatest(F.size(placed) - 1, F.lit(0))),
                          lambda i: (i < F.size(placed)) & change(i))
        return bind(places, run)

    return bind(F.sort_array(F.transform(
        grams, lambda gram, i: F.struct(gram.alias("gram"), i.alias("pos")))), runs)


def occurrences(text: Column, needle: str) -> Column:
    """Non-overlapping occurrences of a substring, counted on bytes so no string is decoded."""
    removed = F.octet_length(text) - F.octet_length(F.replace(text, F.lit(needle), F.lit("")))
    return (removed / F.lit(len(needle.encode()))).cast("bigint")


def sentence_count(text: Column) -> Column:
    pieces = F.split(as_text(text), r"[.!?]+(?=[" + BLANK + r"]+|$)")
    return F.size(F.filter(pieces, lambda s: s.rlike(f"[^{BLANK}]"))).cast("bigint")


def word_runs(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(as_text(text)), F.lit(f"([{WORD}]+)"), F.lit(1))


def word_run_count(text: Column) -> Column:
    return F.regexp_count(F.lower(as_text(text)), F.lit(f"[{WORD}]+")).cast("bigint")


def word_char_count(text: Column) -> Column:
    return F.length(F.regexp_replace(F.lower(as_text(text)), f"[^{WORD}]+", "")).cast("bigint")


def blank_word_count(text: Column) -> Column:
    """Words between white space, the fill of a missing word count."""
    return F.regexp_count(as_text(text), F.lit(f"[^{BLANK}]+")).cast("bigint")


def connective_count(text: Column, phrases: Sequence[str] = CONNECTIVES) -> Column:
    lowered = F.lower(as_text(text))
    return reduce(add, (occurrences(lowered, phrase) for phrase in phrases))


def ratio_or_zero(numerator: Column, denominator: Column) -> Column:
    return F.coalesce(F.try_divide(numerator.cast("double"), denominator), F.lit(0.0))


def rule_hits(text: Column, patterns: Sequence[str],
              needed: Mapping[str, Sequence[str]] | None = None) -> Column:
    """Matches of all patterns together; the list is the caller's and stays in the plan.

    ``needed`` may name, for a pattern, literals of which every match holds one; texts without any of
    them are not searched by that pattern.
    """
    body, needed = as_text(text), needed or {}

    def hits(pattern: str) -> Column:
        count = F.regexp_count(body, F.lit(pattern)).cast("bigint")
        if pattern not in needed:
            return count
        held = reduce(or_, (F.contains(body, F.lit(part)) for part in needed[pattern]))
        return F.when(held, count).otherwise(F.lit(0).cast("bigint"))

    return reduce(add, map(hits, patterns), F.lit(0).cast("bigint"))
