"""Small tables and plain counterparts for the tests of this folder."""

from __future__ import annotations

import random

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns whose names the operators use inside.
CLASHING = ["tie", "h", "blob", "spans", "component", "rep", "hit", "_id", "_lang", "_hash", "place", "turn", "guest"]

ODD_TEXTS = [None, "", " \n\t ", "a", "A b", "é", "...", "x" * 50_000, "word " * 30_000, "Ａ　Ｂ c", "\x1c\x1d  tail  ", "😀 😀"]


def rows_of(texts: list[str | None], lang: str = "en") -> list[tuple]:
    return [(i, t, lang, f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]


def odd_documents(spark):
    """Nulls, empty and long texts, ties, repeated rows, a null id and extra columns."""
    rows = rows_of(ODD_TEXTS) + [(3, "a", None, None, None), (3, "a", None, None, None), (3, "b", "en", None, 1), (None, "word one two three four five", None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in CLASHING:
        df = df.selectExpr("*", f"'x' AS {name}")
    return df.repartition(3)


def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)


def babble(rng: random.Random, n: int, vocabulary: list[str]) -> str:
    return " ".join(rng.choice(vocabulary) for _ in range(n))
