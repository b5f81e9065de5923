"""Operator 3: benchmark decontamination by SimHash, with DataFrame functions only.

A benchmark item of m words is looked for in windows of m words (in the whole text, where it is shorter) of every document. Texts
are compared in lower case by shingles of SHINGLE words (of m words, for shorter items), each weighing as often as it occurs.

1. Regions. An item and a window that share no shingle have similarity 0, so only windows that hold a shingle of some item of
   their size are fingerprinted: documents' shingles are matched against the items' shingles, and the windows of the item's size
   around the matches are gathered into regions, each a run of windows that follow each other. This loses nothing. A region is
   stored as the hashes of its shingles, so it is as long as the text that it covers, and equal regions are one from here on.
2. SimHash. Fingerprints have TABLES times 64 bits; a bit is set if most of the window's shingle hashes have it set. Counters slide
   over a region: the next window adds one hash and drops one.
3. Multi-index. Each 64 bits are cut into the BLOCKS. Two fingerprints within RADIUS bits differ in at most FLIPS bits in some
   block, so items are listed under every value of each block within that distance: a lookup of a window's blocks finds all items
   of its size within RADIUS in any of the tables, and of the others less than one in a hundred (0.7 % of pairs of random
   fingerprints). At similarity 0.8 a window is within RADIUS in one of the tables with probability 0.98, at 0.85 with 0.999.
4. Verification. Candidates within RADIUS are compared exactly: the sum of least weights over the sum of greatest weights of all
   shingles, at least ``similarity``.

Items' shingles are a constant of the plan if they are counted to be at most TABLE_ROWS; otherwise they are joined. Both find the
same regions. Null and empty texts and items match nothing; rows without a key aren't searched; items and texts may be of any
length. Rows that share a key are searched each. Equal items are all found; a document is reported once for each item, by its best
window (the first of equals). Empty tables of either kind give an empty result. Only the key and the text are read, so other
columns may have any names.
"""

from __future__ import annotations

import json
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

SHINGLE = 5
BITS, TABLES, FLIPS = 64, 3, 3
BLOCKS = ((0, 22), (22, 21), (43, 21))  # first bit, number of bits
RADIUS = len(BLOCKS) * (FLIPS + 1) - 1
TABLE_ROWS = 50_000
SPACES = "[\\x20\\x09-\\x0D]+"


def word_hashes(text: Column) -> Column:
    return F.transform(F.filter(F.split(F.lower(text), SPACES), lambda w: w != ""), lambda w: F.xxhash64(w))


def once(c: Column) -> Column:
    """The same column, which the optimiser can't move into the places that use it (a lambda would work it out for each element)."""
    return F.when(F.monotonically_increasing_id() >= 0, c)


def shingles(words: Column, k: int) -> Column:
    n = F.size(words) - (k - 1)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.xxhash64(F.slice(words, i, F.lit(k))))).otherwise(F.array().cast("array<bigint>"))


def tables_of(hashes: Column) -> Column:
    """For each hash the words of 64 bits, one for each table, whose bits are counted."""
    return F.transform(hashes, lambda h: F.array(h, *(F.xxhash64(h, F.lit(t)) for t in range(1, TABLES))))


def bit_of(words: Column, b: Column) -> Column:
    """Bit b of all tables' bits; shifts go by the last six bits of b."""
    word = F.get(words, F.call_function("shiftright", b, F.lit(6)))
    return F.call_function("shiftrightunsigned", word, b).bitwiseAND(F.lit(1)).cast("int")


def fingerprint(counts: Column, n: Column) -> Column:
    """One long for each table: the bits that more than half of n hashes have."""

    def table(t: int) -> Column:
        bits = F.transform(F.slice(counts, BITS * t + 1, BITS), lambda c, b: F.when(2 * c > n, F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long")))
        return F.aggregate(bits, F.lit(0).cast("long"), lambda x, y: x.bitwiseOR(y))

    return F.array(*map(table, range(TABLES)))


def sliding(words: Column, n: Column) -> Column:
    """The fingerprints of all runs of n entries of ``words`` (see tables_of), in order."""
    zero = F.array_repeat(F.lit(0), BITS * TABLES)
    first = F.aggregate(F.slice(words, F.lit(1), n), zero, lambda counts, w: F.transform(counts, lambda c, b: c + bit_of(w, b)))

    def step(state: Column, s: Column) -> Column:
        counts = F.transform(state["counts"], lambda c, b: c + bit_of(F.get(words, s + n - 1), b) - bit_of(F.get(words, s - 1), b))
        return F.struct(counts.alias("counts"), state["prints"].alias("prints"), F.lit(True).alias("new"))

    def put(state: Column) -> Column:
        return F.struct(state["counts"].alias("counts"), F.concat(state["prints"], F.array(fingerprint(state["counts"], n))).alias("prints"), F.lit(False).alias("new"))

    start = F.struct(first.alias("counts"), F.array().cast("array<array<bigint>>").alias("prints"), F.lit(True).alias("new"))
    # every other step puts out the print of the counters, so that they are worked out once
    last = F.size(words) - n
    steps = F.sequence(F.lit(0), 2 * last)
    walked = F.aggregate(steps, start, lambda state, i: F.when(state["new"], put(state)).otherwise(step(state, F.call_function("shiftright", i + 1, F.lit(1)))))
    return walked["prints"]


def fingerprints(rows: DataFrame, by: list[str]) -> DataFrame:
    """``by``, pos, f: the fingerprints of all windows of ``n`` hashes in ``hs``."""
    worked = rows.select(*by, "n", once(tables_of(F.col("hs"))).alias("words"))
    return worked.select(*by, F.posexplode(sliding(F.col("words"), F.col("n"))).alias("pos", "f"))


def blocks(f: Column, flips: bool = False) -> Column:
    """The index keys of a fingerprint: (table, block, value) as one number, with ``flips`` of every value within FLIPS bits."""
    out = []
    for t in range(TABLES):
        for k, (first, width) in enumerate(BLOCKS):
            value = F.shiftrightunsigned(F.get(f, F.lit(t)), first).bitwiseAND(F.lit((1 << width) - 1))
            place = (t * len(BLOCKS) + k) << 32
            if not flips:
                out.append(F.array(value.bitwiseOR(F.lit(place).cast("long"))))
            else:
                based = value.bitwiseOR(F.lit(place).cast("long"))
                out.append(F.transform(flipped(width), based.bitwiseXOR))
    return F.concat(*out)


def flips_of(width: int) -> list[int]:
    """All numbers of ``width`` bits of which at most FLIPS are set."""
    return [sum(1 << b for b in bits) for r in range(FLIPS + 1) for bits in combinations(range(width), r)]


def flipped(width: int) -> Column:
    return F.from_json(F.lit(json.dumps(flips_of(width))), "array<bigint>")


def near(f: Column, g: Column) -> Column:
    """Whether two fingerprints are within RADIUS in some table."""
    return reduce(lambda x, y: x | y, (F.bit_count(F.get(f, F.lit(t)).bitwiseXOR(F.get(g, F.lit(t)))) <= RADIUS for t in range(TABLES)))


def item_table(benchmark: DataFrame, key: str, text: str, k: int) -> DataFrame:
    """item, m (words), k (words of a shingle), words, hashes."""
    rows = benchmark.where(F.col(key).isNotNull()).select(F.col(key).alias("item"), once(word_hashes(F.col(text))).alias("words")).withColumn("m", F.size("words")).where("m > 0")
    k_of = F.least(F.lit(k), F.col("m"))
    hashes = reduce(lambda rest, i: F.when(k_of == i, shingles(F.col("words"), i)).otherwise(rest), range(1, k), shingles(F.col("words"), k))
    return rows.withColumn("k", k_of).withColumn("hashes", hashes)


def hash_table(rows: list, slots: int) -> Column:
    """A constant array of ``slots`` lists of struct<h, m>; the list of a hash h is at h modulo ``slots`` (a power of two)."""
    table: list[list] = [[] for _ in range(slots)]
    for r in rows:
        table[r.h & (slots - 1)].append({"h": r.h, "m": r.m})
    return F.from_json(F.lit(json.dumps(table, separators=(",", ":"))), "array<array<struct<h:bigint,m:int>>>")


def around(at: Column, m: Column, n: Column, width) -> Column:
    """m, and the first and last start of the windows of m words (n, if the text is shorter) that hold the shingle at a place."""
    length = F.least(m, n)
    return F.struct(m.alias("m"), F.greatest(F.lit(0), at - (length - width)).alias("lo"), F.least(at, n - length).alias("hi"))


def regions(rows: DataFrame, width: int) -> DataFrame:
    """doc, k, m, n (shingles of a window), len, lo (start of the first window), hs: spans of windows that meet are one region.

    ``rows``: doc, total (number of words), hs, spans (array of struct<m, lo, hi>).
    """

    def merge(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        longer = F.struct(x["m"].alias("m"), last["lo"].alias("lo"), F.greatest(last["hi"], x["hi"]).alias("hi"))
        meets = (F.size(done) > 0) & F.coalesce(F.get(done, F.size(done) - 1)["m"] == x["m"], F.lit(False)) & F.coalesce(F.get(done, F.size(done) - 1)["hi"] + 1 >= x["lo"], F.lit(False))
        return F.when(meets, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(longer))).otherwise(F.concat(done, F.array(x)))

    empty = F.array().cast("array<struct<m:int,lo:int,hi:int>>")
    whole = F.aggregate(F.array_sort(F.array_distinct("spans")), empty, merge)

    def region(x: Column) -> Column:
        length = F.least(x["m"], F.col("total"))
        n = length - (width - 1)
        return F.struct(x["m"].alias("m"), n.alias("n"), length.alias("len"), x["lo"].alias("lo"), F.slice(F.col("hs"), x["lo"] + 1, x["hi"] - x["lo"] + n).alias("hs"))

    return rows.select("doc", F.lit(width).alias("k"), F.explode(F.transform(whole, region)).alias("r")).select("doc", "k", "r.*")


def regions_by_table(texts: DataFrame, sizes: list, width: int) -> DataFrame:
    """Regions around shared shingles, found row by row: the few known hashes are a constant of the plan. Nothing is shuffled."""
    slots = 1 << max(10, (4 * len(sizes) - 1).bit_length())
    table = hash_table(sizes, slots)

    def known(h: Column) -> Column:
        return F.get(table, h.bitwiseAND(F.lit(slots - 1).cast("long")).cast("int"))

    hashed = texts.select("doc", F.size("words").alias("total"), once(shingles(F.col("words"), width)).alias("hs"))
    places = F.filter(F.transform(F.col("hs"), lambda h, i: F.struct(i.alias("at"), h.alias("h"))), lambda x: F.exists(known(x["h"]), lambda y: y["h"] == x["h"]))
    found = hashed.select("doc", "total", "hs", once(places).alias("places")).where(F.size("places") > 0)
    spans = F.transform(F.col("places"), lambda x: F.transform(F.filter(known(x["h"]), lambda y: y["h"] == x["h"]), lambda y: around(x["at"], y["m"], F.col("total"), width)))
    return regions(found.select("doc", "total", "hs", once(F.flatten(spans)).alias("spans")), width)


def regions_by_join(docs: DataFrame, item_hashes: DataFrame, widths: list[int], key: str, text: str) -> DataFrame:
    """The same for any number of hashes, by joins; texts with a match are read again."""
    hashed = docs.select(F.col(key).alias("doc"), F.xxhash64(text).alias("seal"), once(word_hashes(F.col(text))).alias("words"))
    sizes = item_hashes.select("k", "h", "m").distinct()
    out = []
    for width in widths:
        places = hashed.select("doc", "seal", F.size("words").alias("n"), F.posexplode(shingles(F.col("words"), width)).alias("at", "h"))
        met = places.join(sizes.where(F.col("k") == width), "h").select("doc", "seal", around(F.col("at"), F.col("m"), F.col("n"), width).alias("x"))
        spans = C.materialise(met.groupBy("doc", "seal").agg(F.collect_set("x").alias("spans")), "decon-spans")
        texts = docs.select(F.col(key).alias("doc"), F.xxhash64(text).alias("seal"), F.col(text).alias("text")).join(spans, ["doc", "seal"])
        rows = texts.select("doc", "spans", once(word_hashes(F.col("text"))).alias("words")).select("doc", "spans", F.size("words").alias("total"), once(shingles(F.col("words"), width)).alias("hs"))
        out.append(regions(rows, width))
    return reduce(DataFrame.unionByName, out)


def matches(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", k: int = SHINGLE, similarity: float = 0.8, table_rows: int = TABLE_ROWS) -> DataFrame:
    """``key``, item, start (word), n_words, similarity: every document and item of which a window is similar enough."""
    items = C.materialise(item_table(benchmark, item_key, item_text, k), "decon-items")
    total, widths = items.agg(F.sum(F.size("hashes"))).first()[0], sorted(r.k for r in items.select("k").distinct().collect())  # at most k widths
    docs = docs.where(F.col(key).isNotNull())
    if not widths:
        item_type = benchmark.schema[item_key].dataType.simpleString()
        return docs.limit(0).select(key, F.lit(None).cast(item_type).alias("item"), *(F.lit(None).cast(t).alias(n) for n, t in (("start", "int"), ("n_words", "int"), ("similarity", "double"))))
    item_hashes = items.select("item", "m", "k", F.explode("hashes").alias("h"))

    # 1. regions around shared shingles
    if total <= table_rows:
        texts = docs.select(F.col(key).alias("doc"), once(word_hashes(F.col(text))).alias("words"))
        sizes = item_hashes.select("k", "h", "m").distinct().collect()  # at most table_rows
        found = reduce(DataFrame.unionByName, [regions_by_table(texts, [r for r in sizes if r.k == w], w) for w in widths])
    else:
        found = regions_by_join(docs, item_hashes, widths, key, text)
    kind = ["seal", "k", "m", "n"]
    found = C.materialise(found.withColumn("seal", F.xxhash64("hs")), "decon-regions")
    kinds = C.materialise(found.select(*kind, "hs").dropDuplicates(kind), "decon-kinds")

    # 2. and 3. fingerprints, and the items within RADIUS
    code = F.xxhash64("k", "m", "key").alias("code")  # a place of the index; pairs that meet by chance are too far apart
    prints = fingerprints(kinds, kind).select(*kind, "pos", "f", F.explode(blocks(F.col("f"))).alias("key")).select(*kind, "pos", "f", code)
    of_items = C.materialise(fingerprints(items.select("item", "k", "m", F.size("hashes").alias("n"), F.col("hashes").alias("hs")), ["item", "k", "m"]).select("item", "k", "m", F.col("f").alias("g")), "decon-prints")
    listed = of_items.select("item", "k", "m", F.explode(blocks(F.col("g"), True)).alias("key")).select("item", code)
    # the list has thousands of rows an item, which Spark can't know: it is shuffled, never broadcast
    met = prints.join(listed.hint("merge"), "code").join(of_items, ["item", "k", "m"])
    close = met.where(near(F.col("f"), F.col("g")))
    candidates = C.materialise(close.select(*kind, "pos", "item").distinct(), "decon-candidates")

    # 4. exact weighted similarity
    windows = kinds.join(candidates.select(*kind, "pos").distinct(), kind).select(*kind, "pos", F.explode(F.slice("hs", F.col("pos") + 1, F.col("n"))).alias("h"))
    of_window = windows.groupBy(*kind, "pos", "h").agg(F.count(F.lit(1)).alias("c"))
    of_item = item_hashes.groupBy("item", "h").agg(F.count(F.lit(1)).alias("d"))
    shared = candidates.join(of_window, [*kind, "pos"]).join(of_item, ["item", "h"]).groupBy(*kind, "pos", "item").agg(F.sum(F.least("c", "d")).alias("both"))
    value = F.col("both") / (F.col("n") + F.col("n_item") - F.col("both"))
    sized = shared.join(items.select("item", F.size("hashes").alias("n_item")), "item")
    similar = sized.withColumn("similarity", value).where(F.col("similarity") >= similarity).select(*kind, "pos", "item", "similarity")
    hits = found.select("doc", *kind, "lo", "len").join(similar, kind)
    best = hits.groupBy(F.col("doc").alias(key), "item").agg(F.max(F.struct("similarity", (-(F.col("lo") + F.col("pos"))).alias("back"), "len")).alias("b"))
    return best.select(key, "item", (-F.col("b.back")).alias("start"), F.col("b.len").alias("n_words"), "b.similarity")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matches(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.col("item").alias("item_id"), "start", "n_words", "similarity")
