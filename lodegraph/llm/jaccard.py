"""Operator 8: size-aware heavy-light join on the Jaccard similarity of shingle sets, and its groups.

Documents with equal sets are one set from the start. The least similarity is t = num/den. Sets are light (small) or heavy
(large); the boundary between them minimises the number of list entries, worked out from the sizes of all sets:

* Light sets enumerate fixed-size subsets. Two sets that link share at least ceil(t n) elements, n the size of either, so among
  the first n - ceil(t n) + SUBSET elements in order of hash they share SUBSET elements at least: every SUBSET-subset of those
  first elements is a list key, and linked sets have one in common.
* Heavy sets are posted to inverted lists and the lists scanned. Two sets that link differ in at most d = floor((1-t)/t n)
  elements, n the size of the smaller; so if the elements are dealt into blocks by hash, and the smaller set has more than d
  blocks that aren't empty, one of them is the same in both: its whole content is the list key. (Lists of single elements
  would hold every document that shares a common passage.) Block counts go by size class; a class spans a factor 1/t, so a
  linked pair is in one class or in neighbouring ones, and a set is posted in its own class and, with d + 1 blocks, in the next.
  Sets with too few blocks for the guarantee are joined on single elements instead.

Light sets of sizes up to boundary/t reach across the boundary: heavy sets up to that size enumerate subsets too.

Elements that only one of the listed sets has can't be shared: they bound a set's overlap with any other, and sets or pairs that
this rules out are dropped (most edited copies that are too far from everything are); so are pairs whose parities differ in too
many bits. Then lists are scanned in two rounds. First
every member is paired with the list's centre, pairs are verified exactly, and linked sets united. Then members of a list that
are still in different groups are paired. So a group of any number of copies costs pairs in proportion to its size, and no link
between groups is lost.

Null and empty texts have no set and link with nothing; rows without a key are returned, in no group (component null). Sets
are identified by 64-bit hashes of all their shingles, shingles by 64-bit hashes. Repeated rows are copies.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import common as C
from .components import components

SUBSET = 3
LOWEST = 32  # smaller sets have too few blocks to be heavy
HIGHEST = 256
PARITY = 1024


def shingle_sets(texts: list[bytes], k: int, hasher: C.WordHasher) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of each text's k-word shingles, ascending, in a row, and how many each text has.

    A-Z count as lower case. A text of fewer words has one shingle, its whole sequence; one without words has none.
    """
    count, one, _ = hasher.of([t.lower() for t in texts])
    begin = np.cumsum(count) - count
    many = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    runs = C.rolling(one, k)
    doc = np.repeat(np.arange(len(texts)), many)
    start = np.cumsum(many) - many
    place = np.arange(len(doc)) - start[doc] + begin[doc]
    out = np.zeros(len(doc), np.uint64)
    long = (count >= k)[doc]
    out[long] = runs[place[long]]
    for i in np.flatnonzero((count > 0) & (count < k)).tolist():
        n = int(count[i])
        out[start[i]] = C.rolling(one[begin[i] : begin[i] + n], n)[0] ^ np.uint64(n)
    for a, b in zip(start.tolist(), (start + many).tolist()):
        out[a:b].sort()
    first = np.ones(len(out), bool)
    first[1:] = (out[1:] != out[:-1]) | (doc[1:] != doc[:-1])
    return out[first], np.bincount(doc[first], minlength=len(texts))


def set_ids(tokens: np.ndarray, count: np.ndarray) -> list[int | None]:
    """A signed 64-bit number for each set; None for empty ones."""
    digest, view = xxhash.xxh3_64_intdigest, memoryview(tokens.view(np.uint8))
    out, a = [], 0
    for n in count.tolist():
        x = digest(view[8 * a : 8 * (a + n)]) if n else None
        out.append(x if x is None or x < 1 << 63 else x - (1 << 64))
        a += n
    return out


class Plan:
    """Sizes, thresholds and list keys for a least similarity num/den."""

    def __init__(self, num: int, den: int, boundary: int = LOWEST):
        self.num, self.den, self.boundary = num, den, boundary
        edges = [1]
        while edges[-1] < 1 << 40:
            edges.append(edges[-1] * den // num + 1)
        self.edges = np.array(edges, np.int64)
        # above 1/t**2 - 1/t of the class's least size there can be no more differing blocks; some are empty
        self.blocks = (self.edges * (116 * (den - num) * den) // (100 * num * num)) + 9
        self.reach = boundary * den // num
        self._picks: dict[int, np.ndarray] = {}

    def differ(self, n):
        return (self.den - self.num) * n // self.num

    def common(self, n):
        return -(-self.num * n // self.den)

    def subsets(self, n: int) -> int:
        p = n - self.common(n) + SUBSET
        return p * (p - 1) * (p - 2) // 6 if self.differ(n) else 0

    def entries(self, n: int) -> float:
        """List entries of a heavy set, about."""
        return n * (self.den - self.num) / self.num * 2.2 + 8

    def with_boundary(self, sizes: dict[int, int]) -> Plan:
        """The boundary of least cost, given the number of sets of each size (sizes above HIGHEST / t don't matter)."""

        def cost(x: int) -> float:
            reach = x * self.den // self.num
            return sum(c * ((self.subsets(n) if n <= reach else 0) + (self.entries(n) if n > x else 0)) for n, c in sizes.items())

        return Plan(self.num, self.den, min(range(LOWEST, HIGHEST + 1), key=cost))

    def subset_keys(self, tokens: np.ndarray) -> np.ndarray:
        n = len(tokens)
        if not self.differ(n):
            return np.zeros(0, np.uint64)  # nothing but an equal set is as similar
        if n not in self._picks:
            self._picks[n] = np.array(list(combinations(range(n - self.common(n) + SUBSET), SUBSET)))
        a, b, c = tokens[self._picks[n]].T  # tokens are sorted, and hashes already
        with np.errstate(over="ignore"):
            return C.mix(a * np.uint64(0xD6E8FEB86659FD93) + b * np.uint64(0xA0761D6478BD642F) + c * np.uint64(0xE7037ED1A0B428DB))

    def block_keys(self, tokens: np.ndarray, n: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List keys of heavy sets (tokens in a row, n of each), the ids they belong to, and the ids that lack the guarantee."""
        own = np.searchsorted(self.edges, n, side="right") - 1
        keys, of, short = [], [], []
        for step in (0, 1):
            level = own + step
            b = self.blocks[level]
            base = np.concatenate([[0], np.cumsum(b)[:-1]])
            with np.errstate(over="ignore"):
                salt = C.mix((level + 1).astype(np.uint64) * C.ODD)
                mixed = C.mix(tokens ^ np.repeat(salt, n))
                place = np.repeat(base, n) + ((mixed >> np.uint64(33)) % np.repeat(b, n).astype(np.uint64)).astype(np.int64)
                total = int(b.sum())
                content, count = np.zeros(total, np.uint64), np.bincount(place, minlength=total)
                np.add.at(content, place, C.mix(mixed ^ C.ODD))
                doc = np.repeat(np.arange(len(n)), b)
                key = C.mix(content + C.mix((np.arange(total) - base[doc]).astype(np.uint64) + salt[doc]))
            full = count > 0
            upto = np.cumsum(full)
            rank = upto - (upto[base] - full[base])[doc]  # 1 for a set's first block that isn't empty
            need = self.differ(n) + 1
            short.append(ids[np.add.reduceat(full, base) < need])
            if step:
                full = full & (rank <= need[doc])
            keys.append(key[full])
            of.append(ids[doc[full]])
        return np.concatenate(keys), np.concatenate(of), np.unique(np.concatenate(short))


def profile(docs: DataFrame, k: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, n_shingles, set_id (null without words)."""

    def make():
        hasher = C.WordHasher()

        def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
            tokens, count = shingle_sets(C.as_bytes(batch, text), k, hasher)
            return {"n_shingles": pa.array(count), "set_id": pa.array(set_ids(tokens, count), pa.int64())}

        return run

    return C.map_texts(docs, make, "n_shingles long, set_id long", (key,), text)


def postings(docs: DataFrame, k: int, plan: Plan, text: str = "text") -> DataFrame:
    """(list_key, set_id); list_key is null for a set that lacks the guarantee. A set is posted once for each piece of input."""

    def run(batches):
        hasher = C.WordHasher()
        for batch in C.chunks(batches, text):
            tokens, count = shingle_sets(C.as_bytes(batch, text), k, hasher)
            ids = set_ids(tokens, count)
            new = np.zeros(len(ids), bool)
            new[list({i: d for d, i in reversed(list(enumerate(ids))) if i is not None}.values())] = True
            begin = np.cumsum(count) - count
            keys, of = [], []
            for d in np.flatnonzero(new & (count <= plan.reach)).tolist():
                found = plan.subset_keys(tokens[begin[d] : begin[d] + count[d]])
                keys.append(found)
                of.append(np.full(len(found), ids[d], np.int64))
            short = np.zeros(0, np.int64)
            heavy = new & (count > plan.boundary)
            if heavy.any():
                mine = np.array([ids[d] for d in np.flatnonzero(heavy).tolist()], np.int64)
                found, owner, short = plan.block_keys(tokens[np.repeat(heavy, count)], count[heavy], mine)
                keys.append(found)
                of.append(owner)
            if keys:
                key, owner = np.concatenate(keys), np.concatenate(of)
                for start in range(0, len(key), 200_000):
                    yield pa.RecordBatch.from_arrays([C.signed(key[start : start + 200_000]), pa.array(owner[start : start + 200_000])], names=["list_key", "set_id"])
            if len(short):
                yield pa.RecordBatch.from_arrays([pa.nulls(len(short), pa.int64()), pa.array(short)], names=["list_key", "set_id"])

    return docs.select(text).mapInArrow(run, StructType.fromDDL("list_key long, set_id long"))


def elements(docs: DataFrame, k: int, plan: Plan, text: str = "text") -> DataFrame:
    """(list_key, set_id) with single elements: the first n - ceil(t n) + 1 of each set."""

    def run(batches):
        hasher = C.WordHasher()
        for batch in C.chunks(batches, text):
            tokens, count = shingle_sets(C.as_bytes(batch, text), k, hasher)
            if not len(tokens):
                continue
            doc = np.repeat(np.arange(len(count)), count)
            rank = np.arange(len(doc)) - (np.cumsum(count) - count)[doc]
            low = rank <= (count - plan.common(count))[doc]
            ids = np.array([i or 0 for i in set_ids(tokens, count)], np.int64)
            yield pa.RecordBatch.from_arrays([C.signed(tokens[low]), pa.array(ids[doc[low]])], names=["list_key", "set_id"])

    return docs.select(text).mapInArrow(run, StructType.fromDDL("list_key long, set_id long"))


def member_sets(members: DataFrame, docs: DataFrame, profiled: DataFrame, k: int, key: str, text: str) -> DataFrame:
    """(set_id, tokens array<long>, parity array<long>) of the sets in ``members``, each read from the document of least key.

    parity has PARITY bits: each tells whether the number of elements that fall on it is odd. So two sets differ in at least as many
    elements as their parities differ in bits.
    """
    holders = profiled.join(members, "set_id", "left_semi").groupBy("set_id").agg(F.min(key).alias(key))

    def tokens_of(batches):
        hasher = C.WordHasher()
        for batch in C.chunks(batches, text):
            tokens, count = shingle_sets(C.as_bytes(batch, text), k, hasher)
            ids = pa.array(set_ids(tokens, count), pa.int64())
            edges = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(edges), C.signed(tokens))
            doc = np.repeat(np.arange(len(count)), count)
            odd = np.bincount(doc * PARITY + (C.mix(tokens) % np.uint64(PARITY)).astype(np.int64), minlength=len(count) * PARITY) & 1
            bits = np.packbits(odd.astype(np.uint8)).view(np.int64)
            parity = pa.ListArray.from_arrays(pa.array(np.arange(len(count) + 1, dtype=np.int32) * (PARITY // 64)), pa.array(bits))
            right = pc.fill_null(pc.equal(ids, C.column(batch, "set_id")), False)  # a key may have several texts
            yield pa.RecordBatch.from_arrays([ids, lists, parity], names=["set_id", "tokens", "parity"]).filter(right)

    # copies grow with the corpus: the same join at every size
    read = docs.select(key, text).join(holders.hint("merge"), key).select(text, "set_id").mapInArrow(tokens_of, StructType.fromDDL("set_id long, tokens array<long>, parity array<long>"))
    return read  # a set comes twice only where a row is repeated, which costs work but changes nothing


def sized(sets: DataFrame) -> DataFrame:
    """(set_id, n, own): the size of each set, and of how many elements at least no other of the sets has one.

    40 bits tell elements apart here, which are fewer bytes to shuffle: one that isn't told from another isn't counted.
    """
    once = sets.select("set_id", F.explode("tokens").alias("t")).withColumn("t", F.col("t").bitwiseAND(F.lit((1 << 40) - 1))).groupBy("t").agg(F.count(F.lit(1)).alias("c"), F.min("set_id").alias("set_id")).where("c = 1")
    own = once.groupBy("set_id").agg(F.count(F.lit(1)).alias("own"))
    return sets.select("set_id", F.size("tokens").cast("long").alias("n")).join(own, "set_id", "left").select("set_id", "n", F.coalesce("own", F.lit(0)).alias("own"))


def may_link(plan: Plan, n: str, own: str, m: str, other_own: str | None = None):
    """Whether sets of n and m elements can be as similar as asked, given the elements that no other set has."""
    most = F.col(n) - F.col(own)
    if other_own is not None:
        most = F.least(most, F.col(m) - F.col(other_own))
    return most * (plan.num + plan.den) >= plan.num * (F.col(n) + F.col(m))


def close(plan: Plan, n: str, parity: str, m: str, other: str):
    """Whether the parities of two sets leave it open that they are as similar as asked."""
    differ = reduce(lambda x, y: x + y, (F.bit_count(F.get(F.col(parity), F.lit(i)).bitwiseXOR(F.get(F.col(other), F.lit(i)))) for i in range(PARITY // 64)))
    return differ * (plan.num + plan.den) <= (plan.den - plan.num) * (F.col(n) + F.col(m))


def pruned(lists: DataFrame, sizes: DataFrame, plan: Plan) -> DataFrame:
    """(list_key, set_id, n, own, centre): entries that can link with some member of their list.

    A list's centre is the member with the fewest elements of its own, the least of equals: of edited copies, the one that is
    closest to the others.
    """
    of_list = Window.partitionBy("list_key")
    rich = sizes.where((F.col("n") - F.col("own")) * plan.den >= plan.num * F.col("n"))
    named = lists.select("list_key", "set_id").join(rich, "set_id").withColumn("least", F.min("n").over(of_list))
    kept = named.where(may_link(plan, "n", "own", "least"))
    return kept.withColumn("centre", F.min(F.struct("own", "set_id", "n")).over(of_list)).drop("least")


def verified(pairs: DataFrame, sets: DataFrame, plan: Plan) -> DataFrame:
    """The pairs (a, b) of set ids whose sets have similarity num/den or more, by their whole sets."""
    both = pairs.join(sets.select(F.col("set_id").alias("a"), F.col("tokens").alias("x"), F.col("parity").alias("p")), "a").join(sets.select(F.col("set_id").alias("b"), F.col("tokens").alias("y"), F.col("parity").alias("q")), "b")

    def compare(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            sides = []
            for name in "xy":
                lists = C.column(batch, name)
                sides.append((lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).view(np.uint64)))
            (p, x), (q, y) = sides
            for i in range(batch.num_rows):
                u, v = x[p[i] : p[i + 1]], y[q[i] : q[i + 1]]
                if len(u) > len(v):
                    u, v = v, u
                shared = int((v[np.minimum(np.searchsorted(v, u), len(v) - 1)] == u).sum())
                keep[i] = plan.den * shared >= plan.num * (len(u) + len(v) - shared)
            yield pa.RecordBatch.from_arrays([C.column(batch, "a"), C.column(batch, "b")], names=["a", "b"]).filter(pa.array(keep))

    sizes = both.withColumn("n", F.size("x")).withColumn("m", F.size("y"))
    return sizes.where(close(plan, "n", "p", "m", "q")).select("a", "b", "x", "y").mapInArrow(compare, StructType.fromDDL("a long, b long"))


def shared_lists(posted: DataFrame) -> DataFrame:
    """The entries of lists with two sets or more; entries without a list are kept, and dealt out by their sets."""
    of_list = Window.partitionBy("list_key", "alone")  # a column, so that both bounds come from one shuffle
    ends = posted.withColumn("alone", F.when(F.col("list_key").isNull(), F.col("set_id"))).withColumn("lo", F.min("set_id").over(of_list)).withColumn("hi", F.max("set_id").over(of_list))
    return ends.where("list_key IS NULL OR lo < hi").select("list_key", "set_id")


def cross_pairs(lists: DataFrame, labels: DataFrame, sets: DataFrame, plan: Plan) -> DataFrame:
    """Pairs of members of one list that are in different groups and may link."""
    named = lists.join(labels.select(F.col("node").alias("set_id"), "component"), "set_id", "left").select("list_key", "set_id", "n", "own", F.coalesce("component", "set_id").alias("label"))
    open_lists = named.groupBy("list_key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("list_key")
    rest = C.materialise(named.join(open_lists, "list_key", "left_semi").distinct().join(sets.select("set_id", "parity"), "set_id"), "jaccard-open")
    a, b = (rest.select("list_key", *(F.col(c).alias(f"{c}_{side}") for c in ("set_id", "n", "own", "label", "parity"))) for side in "ab")
    unlike = (F.col("set_id_a") < F.col("set_id_b")) & (F.col("label_a") != F.col("label_b"))
    return a.join(b, (a.list_key == b.list_key) & unlike & may_link(plan, "n_a", "own_a", "n_b", "own_b") & close(plan, "n_a", "parity_a", "n_b", "parity_b")).select(F.col("set_id_a").alias("a"), F.col("set_id_b").alias("b")).distinct()


def groups(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, n_shingles, component_id: the least key that is reachable by links of similarity num/den or more."""
    C.bounded_batches(docs.sparkSession)
    profiled = C.materialise(profile(docs, k, key, text), "jaccard-profile")
    known = profiled.where(F.col(key).isNotNull() & F.col("set_id").isNotNull())
    with_key = docs.where(F.col(key).isNotNull())
    counted = known.where(F.col("n_shingles") <= 2 * HIGHEST).groupBy("n_shingles").agg(F.count_distinct("set_id").alias("n")).collect()  # at most 2 HIGHEST rows
    plan = Plan(num, den).with_boundary({r.n_shingles: r.n for r in counted})

    lists = C.materialise(shared_lists(postings(with_key, k, plan, text)), "jaccard-lists")
    short = lists.where("list_key IS NULL").select("set_id").distinct()
    lists = lists.where("list_key IS NOT NULL")
    if not short.isEmpty():
        single = elements(with_key, k, plan, text)
        of_short = single.join(short, "set_id", "left_semi").select("list_key").distinct()
        touched = single.join(of_short, "list_key", "left_semi").distinct()
        lists = lists.unionByName(C.materialise(shared_lists(touched), "jaccard-short"))

    members = lists.select("set_id").distinct()
    sets = C.materialise(member_sets(members, with_key, known, k, key, text), "jaccard-sets")
    lists = C.materialise(pruned(lists, sized(sets), plan), "jaccard-pruned")
    to_centre = lists.select("n", "own", F.col("set_id").alias("b"), F.col("centre.set_id").alias("a"), F.col("centre.n").alias("m"), F.col("centre.own").alias("other"))
    pairs = C.materialise(to_centre.where((F.col("a") != F.col("b")) & may_link(plan, "n", "own", "m", "other")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "jaccard-pairs")
    links = C.materialise(verified(pairs, sets, plan), "jaccard-links")
    labels = components(links)
    more = C.materialise(cross_pairs(lists, labels, sets, plan).join(pairs, ["a", "b"], "left_anti"), "jaccard-cross")
    if not more.isEmpty():
        found = C.materialise(verified(more, sets, plan), "jaccard-links")
        if not found.isEmpty():
            labels = components(links.unionByName(found))
    return _named(profiled, labels, key)


def _named(profiled: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Each row's least key of its group; the least keys are gathered by set first, so copies meet before they travel."""
    by_set = profiled.where(F.col("set_id").isNotNull()).groupBy("set_id").agg(F.min(key).alias("least"))
    united = by_set.join(labels.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("label", F.coalesce("component", "set_id"))
    least = united.groupBy("label").agg(F.min("least").alias("component_id"))
    of_set = united.join(least, "label").select("set_id", "component_id")
    out = profiled.join(of_set, "set_id", "left")
    own = F.when(F.col("set_id").isNull(), F.col(key)).otherwise(F.col("component_id"))
    return out.select(key, "n_shingles", F.when(F.col(key).isNotNull(), own).alias("component_id"))


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(C.table(spark, sf_dir, "documents"), k=4, num=85, den=100)
