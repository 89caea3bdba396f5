"""Tables with the odd cases every operator has to stand: nulls in any column, empty and very long
texts, repeated rows, and extra columns with the names that operators add."""

import random

SCHEMA = "doc_id long, text string, lang string, n_words string, score string, labels string, ids string, items string, text_a string, matches string, perplexity string, spans string, kept string"


def filler(n: int, seed: int, words=("ka", "lo", "mi", "nu", "pe", "Ri", "so", "tu", "vé", "wa")) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(words) for _ in range(rng.randint(1, 4))) for _ in range(n))


def odd_rows() -> list[tuple[int | None, str | None]]:
    a, b = filler(120, 1), filler(90, 2)
    return [
        (1, a), (2, None), (3, ""), (4, " \n\t "), (5, filler(30_000, 3)), (6, a), (6, a), (7, a + " " + b), (8, "start " + b + " end"), (None, a), (None, None),
        (9, "MIT License and the GNU General Public License, mit license"), (10, "é"), (11, "x" * 5000), (12, b[:200]), (13, "Apache License Version 2.0; CC-BY-SA 4.0"),
    ]


def odd_table(spark, rows=None):
    rows = odd_rows() if rows is None else rows
    return spark.createDataFrame([(i, t, None if (i or 0) % 3 == 0 else "en", *["clash"] * 10) for i, t in rows], SCHEMA)


def empty_table(spark):
    return spark.createDataFrame([], SCHEMA)
