"""Awkward tables that every operator has to take."""

from __future__ import annotations

from random import Random

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"

WORDS = "the quick brown fox jumps over the lazy dog while seven wise owls watch from an old oak tree near town".split()


def prose(n: int, seed: int) -> str:
    random = Random(seed)
    return " ".join(f"{random.choice(WORDS)}{random.randrange(13)}" for _ in range(n))


def rows() -> list[tuple]:
    base = prose(120, 3)
    long = " ".join(prose(400, s) for s in range(30))
    return [
        (1, base, "en", "a", 1),
        (2, base, "en", "a", 1),
        (2, base, "en", "a", 1),  # the same row again
        (3, base.replace("fox", "cat", 1), "en", None, None),
        (4, prose(80, 11), None, "b", 5),
        (5, "", "en", "b", 0),
        (6, None, "en", "b", None),
        (7, " \n\t ", "de", "", 3),
        (8, "word", "de", "b", 4),
        (9, "two words", "de", "b", 9),
        (10, long, "en", "a", len(long)),
        (11, "漢字 и кириллица é ß 😀 0123 !!", "de", "a", 9),
        (None, base, "en", "a", 1),
        (None, None, None, None, None),
        (12, "line one\n\nline  two ", "en", "a", 1),
    ]


def documents(spark, extra: bool = True):
    """With columns whose names clash with helpers', if ``extra``."""
    df = spark.createDataFrame(rows(), DOCUMENTS)
    if extra:
        for name in ("id", "node", "kind", "band", "n", "key", "component", "text_hash", "fraction", "chunk", "held"):
            df = df.selectExpr("*", f"'x' as `{name}`")
    return df


def empty(spark):
    return spark.createDataFrame([], DOCUMENTS)
