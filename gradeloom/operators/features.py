"""Surface features of a text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from gradeloom.functions.text import (
    PUNCTUATION, as_text, connective_count, occurrences, ratio_or_zero, rule_hits, sentence_count,
    word_char_count, word_run_count)
from gradeloom.operators.lexicon import unknown_word_counts

# Default writing rules, (rule id, pattern). A rule whose id starts with SPELLING_PREFIX counts
# as spelling, any other as grammar.
SPELLING_PREFIX = "MORFOLOGIK_"
DEFAULT_RULES = [
    ("DOUBLE_BLANK", r"[^\s] {2,}[^\s]"),
    ("BLANK_BEFORE_MARK", r" [,.;!?]"),
    ("LOWER_AFTER_STOP", r"[.!?] +[a-z]"),
    ("LONE_LOWER_I", r"(^| )i( |$)"),
    ("MORFOLOGIK_TRIPLE_LETTER", r"[a-z]*(aaa|eee|iii|ooo|uuu|ttt|sss)[a-z]*"),
]
# Literals of which a match holds one. That pattern starts again at every letter of a word.
NEEDED = {r"[a-z]*(aaa|eee|iii|ooo|uuu|ttt|sss)[a-z]*":
          ("aaa", "eee", "iii", "ooo", "uuu", "ttt", "sss")}

FEATURES = [
    "avg_sentence_length", "avg_word_length", *PUNCTUATION, "num_connectives",
    "num_spelling_errors", "num_grammar_errors",
]


def text_counts(docs: DataFrame, text: str = "full_text") -> DataFrame:
    """Integer counts behind the features, in one projection."""
    body = F.col(text)
    return docs.withColumns({
        "num_sentences": sentence_count(body),
        "num_words": word_run_count(body),
        "num_word_chars": word_char_count(body),
        **{name: occurrences(as_text(body), mark) for name, mark in PUNCTUATION.items()},
        "num_connectives": connective_count(body),
    })


def rule_counts(docs: DataFrame, text: str = "full_text",
                rules: Sequence[tuple[str, str]] = DEFAULT_RULES) -> DataFrame:
    spelling = [p for name, p in rules if name.startswith(SPELLING_PREFIX)]
    grammar = [p for name, p in rules if not name.startswith(SPELLING_PREFIX)]
    return docs.withColumns({
        "rule_spelling_errors": rule_hits(F.col(text), spelling, NEEDED),
        "num_grammar_errors": rule_hits(F.col(text), grammar, NEEDED),
    })


def add_features(docs: DataFrame, doc: str = "essay_id", text: str = "full_text",
                 dictionary: DataFrame | None = None,
                 rules: Sequence[tuple[str, str]] = DEFAULT_RULES) -> DataFrame:
    """The ten features as columns.

    Spelling errors are words outside ``dictionary`` (column ``token``); without one, words
    the corpus uses in a single document. Averages keep full precision, see ``rounded``.
    """
    unknown = unknown_word_counts(docs, doc, text, dictionary)
    counted = rule_counts(text_counts(docs, text), text, rules)
    return counted.join(unknown, doc, "left").withColumns({
        "avg_sentence_length": ratio_or_zero(F.col("num_words"), F.col("num_sentences")),
        "avg_word_length": ratio_or_zero(F.col("num_word_chars"), F.col("num_words")),
        "num_spelling_errors":
            F.coalesce("unknown_words", F.lit(0)) + F.col("rule_spelling_errors"),
    }).select(*docs.columns, *FEATURES)


def rounded(df: DataFrame, columns: Sequence[str], digits: int = 2) -> DataFrame:
    """Half-even rounding for display."""
    return df.withColumns({c: F.bround(c, digits) for c in columns})
