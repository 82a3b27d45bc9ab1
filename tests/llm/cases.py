"""Documents with nulls, empty and long texts, ties, repeated rows and clashing columns, for all operators."""

import random

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rnd, n, letters="abcdefgh"):
    return " ".join("".join(rnd.choice(letters) for _ in range(rnd.randint(2, 7))) for _ in range(n))


def documents(spark, n=120, seed=1):
    rnd = random.Random(seed)
    texts = [words(rnd, rnd.randint(1, 80)) for _ in range(n)]
    rows = [(k, t, ("en", "de")[k % 2], "s", len(t)) for k, t in enumerate(texts)]
    rows += [(500 + k, texts[k % 7], "en", "s", None) for k in range(20)]  # copies
    rows += [(600, None, None, None, None), (601, "", "en", None, 0), (602, "   ", None, "s", 3), (603, "42 !!", "en", "s", 5), (604, "é", "de", "s", 1), (None, "no id here at all", "en", "s", 1)]
    rows += [rows[3], rows[3], (605, "long " * 30_000, "en", "s", 150_000), (606, "\n\n", "en", "s", 2), (607, "x" * 70_000, "de", "s", 70_000)]
    return spark.createDataFrame(rows, DOCUMENTS).repartition(3)


def empty(spark, schema=DOCUMENTS):
    return spark.createDataFrame([], schema)
