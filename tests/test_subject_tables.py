"""Stores and statistics of mapped tables, made of rows, say what those of their triples say."""

import datetime

import pytest

from lodegraph.engine import Engine
from lodegraph.plans import statistics as S
from lodegraph.sources import MappedSource, Mapping, Store


@pytest.fixture(scope="module")
def source(spark):
    day = datetime.datetime(2020, 1, 2, 3, 4, 5, 600)
    rows = [(1, 'a "quote"', 0.0, 7, day, "1.50"), (2, "back\\slash", -0.0, None, None, None), (3, None, float("nan"), 8, day, "1.50"), (4, "b", -0.0, 7, day, "2.00"), (None, "lost", 1.0, 7, day, "3.00")]
    a = spark.createDataFrame(rows, "k int, name string, x double, b long, at timestamp, price string").selectExpr("*", "cast(price as decimal(9,2)) as paid").drop("price")
    b = spark.createDataFrame([(7, "b", 7, 1.5), (8, "b", 7, 1.50)], "b long, title string, near int, paid float").selectExpr("b", "title", "near", "cast(paid as decimal(5,1)) as due")
    return MappedSource({"a": Mapping(a, ["k"], {"b": "b"}), "b": Mapping(b, ["b"], {"near": "b"}), "pairs": Mapping(a.select("k", "b", "at").where("k is not null"), ["k", "b", "at"], {"k": "a"})})


def bag(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("k", [1, 3, 100])
def test_statistics_of_rows_are_those_of_triples(source, k):
    triples = source.scan_all()
    assert bag(source.counted("coarse", k)) == bag(S.coarse(triples, k))
    assert bag(source.counted("full", k)) == bag(S.full(triples, k))
    some = frozenset(["<urn:p:b>", "<urn:p:x>", "<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>", "<urn:p:nothing>"])
    of_some = triples.where(triples.p.isin(*some))
    assert bag(source.counted("coarse", k, some)) == bag(S.coarse(of_some, k))
    assert bag(source.counted("full", k, some)) == bag(S.full(of_some, k))


def test_a_store_of_tables_holds_their_triples(spark, source, tmp_path):
    store = Store.load(spark, source, f"{tmp_path}/tables", "full", stat_size=3)
    plain = Store.load(spark, source.scan_all(), f"{tmp_path}/triples", "full", stat_size=3)
    assert not store._exists("triples")  # no triple was shuffled to its place
    again = Store(spark, store.root)
    assert bag(again.scan_all()) == bag(plain.scan_all()) and bag(again.predicates()) == bag(plain.predicates())
    for kind in ("coarse", "full"):
        assert bag(spark.read.parquet(f"{store.root}/stats_{kind}")) == bag(spark.read.parquet(f"{plain.root}/stats_{kind}"))
    for where in ("?s <urn:p:b> ?b . ?b <urn:p:title> ?t", "?s ?p <urn:r:b/7>", "?s <urn:p:x> ?x . ?s <urn:p:at> ?at", "<urn:r:a/4> ?p ?o", "?s <urn:p:nothing> ?o"):
        for level in ("none", "stats", "cost"):
            text = f"SELECT * WHERE {{ {where} }}"
            assert bag(Engine(again).sparql(text, level)) == bag(Engine(plain).sparql(text, level)), where
    again.drop()
    assert not again._exists("")


def test_rows_that_share_a_key_are_stored_as_triples(spark, tmp_path):
    t = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b")], "k int, name string")
    store = Store.load(spark, MappedSource({"t": Mapping(t, ["k"])}), f"{tmp_path}/store", "full")
    assert store._exists("triples") and store.scan("<urn:p:name>").count() == 2 and store.scan_all().count() == 4


def test_a_digest_is_stored_only_where_the_key_is_not(spark, tmp_path):
    t = spark.createDataFrame([(1, "a", [1]), (1, "b", [1]), (2, None, [2])], "k int, name string, list array<int>")
    whole = Store.load(spark, MappedSource({"t": Mapping(t, ["k", "name"], unique=True)}), f"{tmp_path}/whole")
    part = Store.load(spark, MappedSource({"t": Mapping(t, ["k", "name", "list"], unique=True)}), f"{tmp_path}/part")
    assert spark.read.parquet(f"{whole.root}/tables/0").columns == ["k", "name"]  # its digest is made of these on reading
    assert spark.read.parquet(f"{part.root}/tables/0").columns == ["k", "name", "digest"]  # lists aren't stored
    for store, key in ((whole, ["k", "name"]), (part, ["k", "name", "list"])):
        assert bag(Store(spark, store.root).scan_all()) == bag(MappedSource({"t": Mapping(t, key, unique=True)}).scan_all())


def test_shuffles_of_a_load_are_removed_with_their_jobs(spark, source, tmp_path):
    """What counting and placing shuffled doesn't lie on disk beside the store while a query on it shuffles."""
    kept, cleanup = spark._jsc.sc().env().mapOutputTracker().shuffleStatuses(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def ids():
        found, numbers = kept.keysIterator(), set()
        while found.hasNext():
            numbers.add(found.next())
        return numbers

    held = source.scan_all().repartition(3).cache()
    assert held.count()
    before = ids()
    Store.load(spark, source, f"{tmp_path}/tables", "full")
    Store.load(spark, held, f"{tmp_path}/triples", "full")
    assert ids() <= before and spark.conf.get(cleanup, None) is None
    assert bag(held) == bag(Store(spark, f"{tmp_path}/triples").scan_all())  # a kept table still has its own
    held.unpersist()


def test_patterns_about_one_subject_are_one_scan_of_its_table(spark, source, tmp_path):
    """Planned apart, as on a store of triples, but a table isn't shuffled to be joined with itself."""
    tables, triples = Store.load(spark, source, f"{tmp_path}/tables", "full"), Store.load(spark, source.scan_all(), f"{tmp_path}/triples", "full")
    near = "?s <urn:p:b> ?b . ?b <urn:p:title> ?t . ?s <urn:p:x> ?x . ?b <urn:p:near> ?n . ?n <urn:p:due> ?d . ?s <urn:p:k> ?k"
    for where, scans in ((near, 3), ("?s <urn:p:b> ?b . ?s <urn:p:b> ?b . ?s <urn:p:b.value> ?v", 1), ("?s <urn:p:x> ?x . ?s <urn:p:near> ?n", 0), ("?s <urn:p:b> ?b . ?s ?p ?b", None), ("?s <urn:p:b> ?b . ?s <urn:p:k> 4 . ?r <urn:p:b> ?b . ?r <urn:p:at> ?at", 3)):
        for level in ("none", "cost"):
            text = f"SELECT * WHERE {{ {where} }}"
            found = Engine(tables).sparql(text, level)
            assert bag(found) == bag(Engine(triples).sparql(text, level)), (where, level)
            if scans is not None and level == "none":
                assert found._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == scans, (where, level)


def test_scans_are_read_together_only_where_no_product_comes_of_it():
    from lodegraph.plans import planner as P
    from lodegraph.plans.syntax import Term, Triple, Var

    def scan(s, o):
        return P.Scan(P.Unit((Triple(Var(s), Term(f"<{s}{o}>"), Var(o)),)))

    def same(a, b):
        return a.triples[0].s == b.triples[0].s

    sx, sy, bs, yc = scan("s", "x"), scan("s", "y"), scan("b", "s"), scan("y", "c")
    chain = P.as_written([bs.unit, sx.unit, yc.unit, sy.unit])
    both = P.Scan(P.Unit(sx.unit.triples + sy.unit.triples))
    assert P.read_together(chain, same) == P.Joined(P.Joined(bs, both), yc)  # y comes with the scan, so it is a product no more
    assert P.read_together(P.Star((sx, sy, bs), ("s",)), same) == P.Joined(both, bs)
    assert P.read_together(P.Star((sx, bs, sy, yc), ("s",)), same).parts == (both, bs, yc)
    ax = scan("a", "x")
    bushy = P.Joined(P.Joined(ax, sx), P.Joined(P.Joined(bs, sy), yc))
    assert P.read_together(bushy, same) == bushy  # without sy, bs and yc have nothing in common
    small = P.Joined(sx, sy, "broadcast")
    assert P.read_together(P.Joined(small, scan("s", "z")), same) == P.Joined(small, scan("s", "z"))


def test_whole_numbers_of_a_store_are_short(spark, tmp_path):
    n = 150_000
    t = spark.range(n).selectExpr("id * 7 AS k", "CAST(xxhash64(id) & 262143 AS INT) AS i", "CAST(id % 3 AS STRING) AS name", "IF(id % 7 = 0, NULL, id * 31) AS some").orderBy("i").coalesce(1)
    store = Store.load(spark, MappedSource({"t": Mapping(t, ["k"], unique=True)}), f"{tmp_path}/store")
    files = [f.getLen() for f in store._fs().listStatus(store._path("tables/0"))]
    assert sum(files) < 7 * n
    assert store._mapped().tables["t"].table.exceptAll(t).isEmpty() and store._mapped().tables["t"].table.count() == n
