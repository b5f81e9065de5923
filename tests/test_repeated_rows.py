"""Mapped tables whose rows repeat are loaded as tables, each row once."""

import pytest

from lodegraph.sources import MappedSource, Mapping, Store, store as stores

ROWS = [(1, "a", 0.0), (1, "a", 0.0), (2, "b", None), (3, None, -0.0), (None, "c", 1.0), (2, "b", None)]
KEYLESS = [("x", 0.0), ("x", -0.0), ("x", 0.0), (None, None), (None, None)]


def source(spark, rows, keyless=KEYLESS):
    def local(rows, names, schema):  # a relation whose size Spark knows
        cells = ", ".join("(" + ", ".join("null" if x is None else f"cast('{x}' as double)" if isinstance(x, float) else repr(x) for x in r) + ")" for r in rows)
        return spark.sql(f"select * from values {cells} t({names})").selectExpr(*schema)

    a = Mapping(local(rows, "k, t, d", ["cast(k as int) k", "cast(t as string) t", "cast(d as double) d"]), ["k"])
    return MappedSource({"a": a, "b": Mapping(local(keyless, "u, v", ["cast(u as string) u", "cast(v as double) v"]), ["u", "v"])})


def triples(df):
    return sorted(map(tuple, df.select("s", "p", "o").collect()))


@pytest.mark.parametrize("size", [stores.SLICE_BYTES, 40])
def test_repeated_rows_are_loaded_once_as_tables(spark, tmp_path, monkeypatch, size):
    monkeypatch.setattr(stores, "SLICE_BYTES", size)  # one slice, and several
    twice = source(spark, ROWS).plus(source(spark, ROWS))
    store = Store.load(spark, twice, f"{tmp_path}/store")
    assert store._mapped() is not None
    assert triples(store.scan_all()) == triples(source(spark, ROWS).scan_all().distinct())
    assert {(r.iri, r.n_triples) for r in store.predicates().collect()} == {(r.p, r["count"]) for r in source(spark, ROWS).scan_all().distinct().groupBy("p").count().collect()}


def test_rows_that_share_a_key_and_differ_are_loaded_as_triples(spark, tmp_path):
    more = [*ROWS, (1, "z", 0.0)]
    store = Store.load(spark, source(spark, ROWS).plus(source(spark, more)), f"{tmp_path}/store")
    assert store._mapped() is None and not store._exists("tables")
    assert triples(store.scan_all()) == triples(source(spark, more).scan_all().distinct())


def test_repeats_are_kept_without_dedup(spark, tmp_path):
    store = Store.load(spark, source(spark, ROWS[:1], KEYLESS[:1]).plus(source(spark, ROWS[:1], KEYLESS[:1])), f"{tmp_path}/store", dedup=False)
    assert triples(store.scan_all()) == triples(source(spark, ROWS[:1], KEYLESS[:1]).scan_all())  # a mapped source is a set itself


def test_tables_of_one_name_are_alike(spark):
    other = MappedSource({"a": Mapping(spark.createDataFrame([(1,)], "k int"), ["k"])})
    with pytest.raises(ValueError):
        source(spark, ROWS).plus(other)
