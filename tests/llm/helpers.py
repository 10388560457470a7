"""Small documents for the operators, with columns whose names clash with those the operators use."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, row string, text_hash long, fp long, spans string, key string, label string, _task int, size long, rank long"


def documents(spark, pairs, lang="en"):
    """From (doc_id, text) pairs."""
    rows = [(i, t, lang if not isinstance(lang, dict) else lang.get(i), "src", None if t is None else len(t), "x", "y", 1, 2, "s", "k", "l", 3, 4, 5) for i, t in pairs]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return documents(spark, [])


def words(rng, n, vocabulary=200, prefix="w"):
    return " ".join(f"{prefix}{rng.randrange(vocabulary)}" for _ in range(n))


def odd(seed=5):
    """Nulls, empty and blank texts, a very long one, ties and repeated rows, a null id, one id for two texts."""
    rng = random.Random(seed)
    long = words(rng, 30_000)
    same = words(rng, 120)
    return [
        (1, None), (2, ""), (3, " \n\t "), (4, long), (5, same), (5, same), (6, same), (7, same + " tail"), (7, words(rng, 90)),
        (None, same), (None, None), (8, "É😀 ñ " * 40), (9, "a"), (10, "x" * 50_000), (11, "0 1 2 " * 60), (12, words(rng, 60)), (13, same + " " + words(rng, 55)),
    ]
