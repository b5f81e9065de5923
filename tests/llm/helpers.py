"""Small corpora for the tests of the training-data operators."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng: random.Random, n: int, vocabulary: int = 400) -> list[str]:
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def corpus(seed: int = 0, n: int = 60) -> list[tuple]:
    """Random texts, copies, near copies, shared passages, repeats, and the odd cases."""
    rng = random.Random(seed)
    passage = words(rng, 30)
    texts: list = []
    for i in range(n):
        kind = i % 6
        if kind == 0 or not texts:
            t = words(rng, rng.randrange(5, 120))
        elif kind == 1:
            t = (rng.choice([x for x in texts if x]) or "x").split()
        elif kind == 2:
            t = (rng.choice([x for x in texts if x]) or "x").split()
            for _ in range(rng.randrange(1, 4)):
                t[rng.randrange(len(t))] = f"edit{rng.randrange(1000)}"
        elif kind == 3:
            t = words(rng, rng.randrange(30)) + passage[rng.randrange(5) : 30 - rng.randrange(5)] + words(rng, rng.randrange(30))
        elif kind == 4:
            t = words(rng, 7, 3) * rng.randrange(1, 12)
        else:
            t = words(rng, rng.randrange(1, 10), 5)
        texts.append(rng.choice([" ", "  ", "\n", "\t "]).join(t))
    texts += [None, "", " \n\t ", "one", "A b C d", "a B c D", "x\x1cy z", "  nbsp word", "tick " * 300, " ".join(words(rng, 3000))]
    rows = [(i * 3, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    rows.append(rows[0])  # a repeated row
    return rows


def frame(spark, rows, **extra):
    """The rows with columns whose names clash with results."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return df.withColumns({k: F.lit(v) for k, v in extra.items()})


def by_id(df, *columns):
    out: dict = {}
    for r in df.collect():
        out.setdefault(r.doc_id, set()).add(tuple(r[c] for c in columns))
    return out
