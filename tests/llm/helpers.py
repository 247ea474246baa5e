"""Small fixtures for the operators of the training-data pipeline."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Odd documents that every operator must take: nulls, empty and blank texts, repeated rows, a very long text, ties.
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
ODD = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, " \n\t ", "en", "s", 4), (4, "same text", "en", "s", 9), (4, "same text", "en", "s", 9),
       (None, "no id at all here", "de", None, 3), (5, LONG, "en", "s", 1), (6, "é ü \U0001f600 日本", None, "s", 2)]


def docs(spark, rows, extra: bool = False):
    df = spark.createDataFrame([(*r, None, None, None)[:5] if len(r) == 2 else r for r in rows], DOCS)
    if extra:  # columns whose names the operators use themselves
        for c in ("h", "t", "fp", "text_hash", "bad_hash", "bad_id", "keep_id", "line", "line_no", "key", "g", "name", "gone_id", "gone_lines", "uniform", "kept"):
            df = df.selectExpr("*", f"'x' AS {c}")
    return df


def prose(rng: random.Random, n: int, vocabulary: int = 4000) -> str:
    return " ".join(f"{'abcdefghij'[w % 10]}{'klmnopqr'[w // 10 % 8]}ou{w}" for w in (rng.randrange(vocabulary) for _ in range(n)))
