"""Small tables with every awkward case: nulls, empty and long texts, repeats, clashing extra columns."""

from __future__ import annotations

import random

WORDS = "river stone light paper window garden letter music simple answer history number morning village teacher surface picture measure winter summer".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    out = []
    for i in range(n):
        out.append(rng.choice(WORDS) + rng.choice("abcdefghij") + str(rng.randint(0, 9)))
        if i % 12 == 11:
            out[-1] += ".\n"
    return " ".join(out).replace("\n ", "\n")


def documents(spark, texts, extra=True):
    rows = [(i, t, "en", "src0", len(t or ""), "x") for i, t in enumerate(texts)]
    return frame(spark, rows, extra)


def frame(spark, rows, extra=True):
    # the added columns clash with names that the operators use
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string"
    df = spark.createDataFrame(rows, schema)
    return df if extra else df.drop("score")


def awkward():
    return [None, "", " \n\t ", "a", prose(1, 60), prose(1, 60), prose(2, 3000), "é" * 49, "###", "\x00 \x1f"]
