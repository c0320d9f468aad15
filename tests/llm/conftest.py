import random

import pytest
from pyspark.sql import functions as F

#: Columns that operators use for their own results; a table may have them already.
CLASHES = ["kept", "n_words", "component_id", "n_lines", "n_dropped", "line_id", "piece_ids", "removed", "n_bytes", "simhash_id", "text_h1", "h1", "fp", "id", "row", "n", "key"]


def make(spark, rows, clash=True):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for k, c in enumerate(CLASHES if clash else []):
        df = df.withColumn(c, F.lit(f"x{k}"))
    return df


def prose(rng, n):
    return " ".join(rng.choice(["the", "quick", "Brown", "fox", "jumps", "over", "lazy", "dogs", "é", "straße", "run", "day", "night", "sing", "of", "and"]) + rng.choice(["", "", "ing", "s", "er"]) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empties, white space, repeats, ties, one very long text, near copies, a shared passage."""
    rng = random.Random(5)
    passage = prose(rng, 60)
    base = "\n".join(prose(rng, 40) for _ in range(4))
    texts = [(1, None), (2, ""), (3, " \t\n \x0b"), (4, "a"), (5, "One two"), (6, base), (7, base), (8, base + " tail"), (9, prose(rng, 30) + "\n" + passage + "\n" + prose(rng, 30)),
             (10, passage), (11, "Shared boilerplate line\nown words here"), (12, "  SHARED boilerplate LINE \nother"), (13, "word " * 400), (14, "x" * 3000), (15, "\n".join(["same line again"] * 30)), (16, base.upper()),
             (17, "é" * 9 + "\n" + "é" * 10), (18, "é" * 9 + "\n" + "é" * 10), (None, "Shared boilerplate line"), (None, None), (6, base), (20, "\n".join(prose(rng, 12) for _ in range(3000))), (21, "𝕏 token=abcdef12345 𝕏"), (22, "no-break space \x1c control")]
    return [(i, t, None if k % 5 == 0 else "en", None if k % 7 == 0 else "src0", None if t is None else len(t)) for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return make(spark, odd_rows).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return make(spark, [])
