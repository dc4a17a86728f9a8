"""Rows with nulls, empty and long texts, ties, repeated rows and columns with clashing names."""

from __future__ import annotations

import random

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, size long, `group` string, "
    "kept boolean, token string, shard int, `a.b` string"
)
LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
PROSE = "The quick brown fox jumps over the lazy dog, and then it sleeps until the next morning comes again."


def rows() -> list[tuple]:
    texts = [
        (1, PROSE, "en", "b"),
        (2, PROSE.replace(" ", "  "), "en", "a"),
        (3, PROSE, None, None),
        (3, PROSE, None, None),
        (4, None, "en", "a"),
        (5, "", "fr", "a"),
        (6, " \t\n\r\x0b\x0c ", "fr", None),
        (7, LONG, "en", "c"),
        (8, LONG + " end", "en", "c"),
        (9, "x", None, "d"),
        (10, "één héél klein stukje", "nl", "é"),
        (11, "日本語の文章です。", "ja", "z"),
        (12, "12345 67890 !!! ???", "en", "a"),
        (None, PROSE, "en", "b"),
        (None, None, None, None),
        (13, "a▁b  c ▁  d😀", "en", "b"),
        (14, "one two three", "en", "b"),
        (15, "One TWO three", "en", "b"),
    ]
    return [(i, t, lang, s, 1, 2, "g", False, "t", 9, "ab") for i, t, lang, s in texts]


def frame(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def mutated(rng: random.Random, words: list[str], edits: int, vocabulary: list[str]) -> list[str]:
    words = list(words)
    for _ in range(edits):
        i, kind = rng.randrange(len(words)), rng.random()
        if kind < 0.6:
            words[i] = rng.choice(vocabulary)
        elif kind < 0.8 or len(words) < 2:
            words.insert(i, rng.choice(vocabulary))
        else:
            words.pop(i)
    return words
