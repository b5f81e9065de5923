import random
from collections import Counter

from pyspark.sql import functions as F

from lodegraph.llm import decontaminate as D
from lodegraph.llm.decontaminate import matches, op3_decontaminate

from .helpers import SCHEMA, frame

ITEMS = "item_id long, text string"


def bag(words, k):
    k = min(k, len(words))
    return Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def brute(rows, items, k=5, least=0.8):
    """Every window of every document against every item."""
    out: dict = {}
    for item, t in items:
        w = (t or "").lower().split()
        if not w or item is None:
            continue
        kk, y = min(k, len(w)), bag(w, k)
        for i, d, *_ in rows:
            v = (d or "").lower().split()
            n = min(len(w), len(v))
            if i is None or n < kk:
                continue
            for s in range(len(v) - n + 1):
                x = Counter(tuple(v[s + j : s + j + kk]) for j in range(n - kk + 1))
                both = sum((x & y).values())
                value = both / (sum(x.values()) + sum(y.values()) - both)
                if value >= least and value > out.get((i, item), (0, 0))[0]:
                    out[i, item] = (value, s)
    return out


def sample(seed):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(300)}"
    items = [(i, " ".join(word() for _ in range(rng.randrange(12, 50)))) for i in range(12)]
    items += [(12, "tiny Thing"), (13, "alone"), (14, items[0][1]), (15, None), (16, ""), (None, "w1 w2 w3 w4 w5 w6")]
    rows = []
    for i in range(80):
        t = [word() for _ in range(rng.randrange(0, 80))]
        if i % 2:
            inner = rng.choice(items[:13])[1].split()
            for _ in range(rng.randrange(3) if i % 4 == 1 else 0):
                inner[rng.randrange(len(inner))] = "changed"
            inner = inner[rng.randrange(2) :]
            at = rng.randrange(len(t) + 1)
            t[at:at] = [x.upper() for x in inner] if i % 5 == 0 else inner
        rows.append((i, " ".join(t), None, None, 0))
    rows += [(100, None, None, None, 0), (101, "", None, None, 0), (102, " ".join(items[3][1].split()[1:]), None, None, 0), (None, items[1][1], None, None, 0), rows[1], (103, " ".join(word() for _ in range(4000)) + " " + items[5][1], None, None, 0)]
    return rows, items


def test_equals_brute_force(spark):
    for seed, table_rows in ((0, 50_000), (1, 50_000), (1, 0)):
        rows, items = sample(seed)
        got = matches(frame(spark, rows, item=1, words="x", n=3), spark.createDataFrame(items, ITEMS), table_rows=table_rows).collect()
        assert {(r.doc_id, r.item): (round(r.similarity, 9), r.start) for r in got} == {k: (round(v, 9), s) for k, (v, s) in brute(rows, items).items()}
        assert len(got) == len({(r.doc_id, r.item) for r in got})


def bits(words, n):
    return [sum((2 * sum(w[t] >> b & 1 for w in words) > n) << b for b in range(64)) for t in range(D.TABLES)]


def test_sliding_fingerprints_equal_counts(spark):
    rng = random.Random(4)
    rows = [(i, [rng.randrange(-(1 << 63), 1 << 63) for _ in range(rng.randrange(1, 30))]) for i in range(20)]
    rows = [(i, hs, rng.randrange(1, len(hs) + 1)) for i, hs in rows]
    df = spark.createDataFrame(rows, "id int, hs array<bigint>, n int")
    words = {r.id: [[x % (1 << 64) for x in w] for w in r.words] for r in df.select("id", D.tables_of(F.col("hs")).alias("words")).collect()}
    got = {(r.id, r.pos): [x % (1 << 64) for x in r.f] for r in D.fingerprints(df, ["id"]).collect()}
    assert got == {(i, s): bits(words[i][s : s + n], n) for i, hs, n in rows for s in range(len(hs) - n + 1)}


def test_index_finds_all_within_the_radius_and_little_else(spark):
    rng = random.Random(6)
    items = [[rng.randrange(-(1 << 63), 1 << 63) for _ in range(D.TABLES)] for _ in range(60)]
    asked = [[rng.randrange(-(1 << 63), 1 << 63) for _ in range(D.TABLES)] for _ in range(400)]
    for i in range(60):  # one table at the radius, the others random
        f, t = list(asked[i]), i % D.TABLES
        mask = sum(1 << b for b in rng.sample(range(64), D.RADIUS))
        f[t] = (items[i][t] ^ (mask - (1 << 64) if mask >> 63 else mask))
        asked[i] = f
    a = spark.createDataFrame(list(enumerate(asked)), "a int, f array<bigint>").select("a", "f", F.explode(D.blocks(F.col("f"))).alias("key"))
    b = spark.createDataFrame(list(enumerate(items)), "b int, g array<bigint>").select("b", "g", F.explode(D.blocks(F.col("g"), True)).alias("key"))
    met = a.join(b, "key")
    pairs = {(r.a, r.b) for r in met.where(D.near(F.col("f"), F.col("g"))).collect()}
    assert {(i, i) for i in range(60)} <= pairs
    assert met.where("a >= 60").count() < 0.01 * 340 * 60


def test_items_of_any_length(spark):
    """An item whose counters don't fit 16 bits is found like the others, and doesn't stop them."""
    rng = random.Random(9)
    long = [f"w{rng.randrange(300)}" for _ in range((1 << 15) + 50)]
    edited = [*long[:-20], *(f"new{i}" for i in range(20))]
    repeated = "tick " * (1 << 15)
    short = " ".join(long[:20])
    other = " ".join(f"v{rng.randrange(300)}" for _ in range(1 << 15))
    rows = [(i, t, None, None, 0) for i, t in enumerate((" ".join(long), " ".join(edited), repeated, other, "so " + short))]
    items = spark.createDataFrame([(0, " ".join(long)), (1, repeated), (2, short)], ITEMS)
    got = {(r.doc_id, r.item): r.similarity for r in matches(frame(spark, rows), items).collect()}
    assert set(got) == {(0, 0), (1, 0), (2, 1), (0, 2), (1, 2), (4, 2)}
    assert got[0, 0] == got[2, 1] == got[4, 2] == 1 and 0.99 < got[1, 0] < 1


def test_plan_is_native(spark, tmp_path):
    rows, items = sample(2)
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, ITEMS).write.parquet(f"{tmp_path}/benchmark.parquet")
    out = op3_decontaminate(spark, str(tmp_path))
    plan = out._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
    assert {r.doc_id for r in out.collect()} == {i for i, _ in brute(rows, items)}


def test_empty_tables(spark):
    rows, items = sample(3)
    docs, bench = frame(spark, rows), spark.createDataFrame(items, ITEMS)
    assert matches(docs, bench.limit(0)).collect() == []
    assert matches(spark.createDataFrame([], SCHEMA), bench).collect() == []
