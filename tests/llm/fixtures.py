"""Small tables with every odd case that the operators promise to handle."""

import random

WORDS = "the river bends under old stone bridges while traders count copper coins and argue about salt wool barley wine iron amber".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + (str(r.randrange(40)) if r.random() < 0.5 else "") for _ in range(n))


def documents(spark, rows):
    """rows of (doc_id, text), with columns whose names clash with what operators make."""
    full = [(i, t, "en", "s", None if t is None else len(t), "mine", -1, "x") for i, t in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, key string, component long, carried_0 string")


ODD = [(1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "one two"), (None, "a row without an id but with a few words"), (6, "ümläut Straße   ΑΣ İ 😀"), (7, "a\u0000b\u001fc"), (8, prose(8, 30_000)), (9, prose(9, 60)), (9, prose(9, 60)), (10, prose(9, 60))]
