import json
import random

import pytest
from pyspark.sql import functions as F

from lodegraph.__main__ import main
from lodegraph.engine import Engine
from lodegraph.functions import terms as T
from lodegraph.plans.planner import LEVELS
from lodegraph.plans.syntax import SparqlError
from lodegraph.sources import MappedSource, Mapping, Store, read_ntriples, write_ntriples
from lodegraph.sources.ntriples import parse_lines

INT = f"^^<{T.XSD}integer>"
PEOPLE = [
    ("<a>", "<name>", '"Ann"'),
    ("<b>", "<name>", '"Bob"'),
    ("<c>", "<name>", '"Cy"@en'),
    ("<a>", "<age>", f'"9"{INT}'),
    ("<b>", "<age>", f'"10"{INT}'),
    ("<d>", "<age>", f'"9.0"^^<{T.XSD}double>'),
    ("<a>", "<knows>", "<b>"),
    ("<a>", "<knows>", "<c>"),
    ("<b>", "<knows>", "<b>"),
    ("<b>", "<knows>", "<d>"),
    ("<c>", "<knows>", "<a>"),
    ("<a>", "<mail>", "_:m"),
    ("_:m", "<text>", '"line\\nwith \\"quotes\\" and \\\\n"'),
    ("<A>", "<Name>", '"case"'),
]


@pytest.fixture(scope="module")
def people(spark):
    return Engine.from_dataframe(spark.createDataFrame([*PEOPLE, PEOPLE[0]], "s string, p string, o string"))


def bag(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def ask(engine, where, **options):
    return bag(engine.sparql(f"SELECT * WHERE {{ {where} }}", **options))


def test_patterns(people):
    assert ask(people, "?x <knows> ?x") == [("<b>",)]
    assert ask(people, "?x <knows> ?y . ?y <knows> ?x") == [("<a>", "<c>"), ("<b>", "<b>"), ("<c>", "<a>")]
    assert ask(people, "<a> <knows> <b> . ?x <name> \"Bob\"") == [("<b>",)]
    assert ask(people, "<a> <knows> <d> . ?x <name> ?n") == []
    assert len(ask(people, "?s ?p ?o")) == len(PEOPLE)
    assert ask(people, "<b> ?p <b>") == [("<knows>",)]
    assert ask(people, "?x ?x ?y") == []
    assert ask(people, "?x <nothing> ?y") == []
    assert ask(people, '?x <name> "Cy"') == []  # another term than "Cy"@en
    assert len(ask(people, "?x <name> ?n . ?y <age> ?a")) == 9


def test_blank_nodes_keep_multiplicity(people):
    assert bag(people.sparql("SELECT ?y WHERE { _:x <knows> ?y }")) == [("<a>",), ("<b>",), ("<b>",), ("<c>",), ("<d>",)]
    assert ask(people, "_:x <knows> _:x") == [()]


def test_optional_and_unbound(people):
    assert ask(people, "?x <age> ?a OPTIONAL { ?x <name> ?n }") == sorted([("<a>", f'"9"{INT}', '"Ann"'), ("<b>", f'"10"{INT}', '"Bob"'), ("<d>", f'"9.0"^^<{T.XSD}double>', None)], key=str)
    assert ask(people, "?x <name> ?n OPTIONAL { ?y <nothing> ?z }") == sorted([(s, o, None, None) for s, p, o in PEOPLE if p == "<name>"], key=str)
    # an unbound variable joins with anything, and takes its value
    got = ask(people, "?x <age> ?a OPTIONAL { ?x <name> ?n } { ?y <name> ?n }")
    assert len([r for r in got if r[0] == "<d>"]) == 3 and len(got) == 5
    # the filter of an optional group decides the match, and sees the outer variables
    got = ask(people, "?x <age> ?a OPTIONAL { ?x <knows> ?y . ?y <age> ?b FILTER(?b > ?a) }")
    assert sorted((r[0], r[2]) for r in got if r[2]) == [("<a>", "<b>")] and len(got) == 3


def test_union(people):
    assert ask(people, "{ ?x <name> ?n } UNION { ?x <mail> ?m } UNION { ?x <name> ?n }") == sorted([(s, o, None) for s, p, o in PEOPLE if p == "<name>"] * 2 + [("<a>", None, "_:m")], key=str)
    assert ask(people, "{ ?x <name> ?n } UNION { ?x <nothing> ?k }") == sorted([(s, o, None) for s, p, o in PEOPLE if p == "<name>"], key=str)


def test_filters(people):
    names = lambda test: [r[0] for r in ask(people, f"?x <age> ?a FILTER({test})")]
    assert names("?a = 9") == ["<a>", "<d>"]
    assert names("9 < ?a") == ["<b>"]
    assert names("?a <= 9.0") == ["<a>", "<d>"]
    assert names("?a != 9") == ["<b>"]
    assert names('?a < "x"') == []  # no meaning: no row
    assert names("?x = <a>") == ["<a>"] and names("?x != <a>") == ["<b>", "<d>"]
    assert names("?nowhere = 1") == []
    assert ask(people, '?x <name> ?n FILTER REGEX(?n, "^[ab]", "i")') == [("<a>", '"Ann"'), ("<b>", '"Bob"')]
    assert ask(people, '?x <knows> ?y FILTER REGEX(?y, "a")') == []
    assert ask(people, '?x <text> ?t FILTER REGEX(?t, "with \\"quotes\\" and \\\\\\\\n$")') != []
    assert ask(people, "?x <knows> ?y . ?x <age> ?a . ?y <age> ?b FILTER(?a = ?b)") == [("<b>", "<b>", f'"10"{INT}', f'"10"{INT}')]


def test_order_and_distinct(people):
    rows = lambda text, **o: [tuple(r) for r in people.sparql(text, **o).collect()]
    ages = rows("SELECT ?a WHERE { ?x <age> ?a } ORDER BY DESC(?a) ?x", decode={"a": "double"})
    assert [a for (a,) in ages] == [10.0, 9.0, 9.0]
    assert rows("SELECT ?x WHERE { ?x <age> ?a } ORDER BY ?a", order="lexical")[0] == ("<b>",)
    mixed = rows("SELECT ?v WHERE { { ?x <mail> ?v } UNION { ?x <age> ?v } UNION { ?x <knows> ?v } UNION { ?x <name> ?n } } ORDER BY ?v")
    kinds = [("unbound" if v is None else "blank" if v[0] == "_" else "iri" if v[0] == "<" else "literal") for (v,) in mixed]
    assert kinds == sorted(kinds, key=["unbound", "blank", "iri", "literal"].index)
    assert rows("SELECT DISTINCT ?x WHERE { ?x <knows> ?y } ORDER BY DESC(?x)") == [("<c>",), ("<b>",), ("<a>",)]
    with pytest.raises(SparqlError):
        people.sparql("SELECT DISTINCT ?x WHERE { ?x <knows> ?y } ORDER BY ?y")
    assert rows("SELECT ?gone ?x WHERE { ?x <mail> ?y }") == [(None, "<a>")]


def test_levels_agree(spark):
    rng = random.Random(3)
    triples = {(f"<n{rng.randrange(12)}>", f"<p{rng.randrange(4)}>", f"<n{rng.randrange(12)}>") for _ in range(90)}
    engine = Engine.from_dataframe(spark.createDataFrame(sorted(triples), "s string, p string, o string"))
    engine.source.cache()
    for seed in range(6):
        rng = random.Random(seed)
        atom = lambda: f"?v{rng.randrange(4)}" if rng.random() < 0.8 else f"<n{rng.randrange(12)}>"
        where = " . ".join(f"{atom()} <p{rng.randrange(5 if seed == 5 else 4)}> {atom()}" for _ in range(rng.randrange(2, 5)))
        rows = [{}]
        for part in where.split(" . "):
            s, p, o = part.split()
            new = []
            for r in rows:
                for t in triples:
                    b = dict(r)
                    if t[1] == p and all(b.setdefault(x, y) == y if x[0] == "?" else x == y for x, y in ((s, t[0]), (o, t[2]))):
                        new.append(b)
            rows = new
        names = list(dict.fromkeys(x[1:] for x in where.split() if x[0] == "?"))
        want = sorted((tuple(r["?" + n] for n in names) for r in rows), key=str)
        for level in LEVELS:
            assert ask(engine, where, optimizer=level) == want, (where, level)
        assert ask(engine, where, optimizer="cost", stat_limit=2) == want


def test_explain(people):
    text = "SELECT DISTINCT ?x WHERE { ?x <knows> ?y . ?y <name> \"Bob\" . ?x <age> ?a OPTIONAL { ?x <mail> ?m } FILTER(?a = 9) } ORDER BY ?x"
    out = people.explain(text, optimizer="cost")
    assert "OPTIONAL" in out and "SCAN" in out and "physical plan" in out
    plan = json.loads(people.explain(text, "json", "cost"))
    ops = {c["op"] for c in plan["commands"]}
    assert {"PRED", "FILTER", "SELECT", "LEFTJOIN", "DISTINCT", "ORDER"} <= ops
    assert plan["result"] == plan["commands"][-1]["id"]
    assert "EMPTY" in {c["op"] for c in json.loads(people.explain("SELECT * { ?a <nothing> ?b . ?b <name> ?n }", "json", "cost"))["commands"]}


LINES = [
    "<s> <p> <o> .",
    "<s> <p> <o>.",
    "",
    "   # a comment",
    '_:b <p> "a . \\"b\\" \\u00e9\\U0001F600 \\\\u0041 \\t" . # note',
    '<s> <P> "x"@EN .',
    f'<s> <p> "x"^^<{T.XSD}string> .',
    f'<s> <{"long" * 100}> "1"{INT}.',
    "<s> <p> <o> .",
    '<s> <p> "' + "\\\\" * 50_000 + '" .',
]


def test_ntriples(spark):
    rows = [tuple(r) for r in parse_lines(spark.createDataFrame([(x,) for x in LINES], "value string")).collect()]
    assert len(rows) == 8 and rows.count(("<s>", "<p>", "<o>")) == 3
    assert ("_:b", "<p>", '"a . \\"b\\" é😀 \\\\u0041 \t"') in rows
    assert ("<s>", "<P>", '"x"@en') in rows and ("<s>", "<p>", '"x"') in rows
    bad = spark.createDataFrame([("<s> <p> .",), ("<s> <p> <o> .",)], "value string")
    assert parse_lines(bad, mode="drop").count() == 1
    with pytest.raises(Exception, match="not a triple"):
        parse_lines(bad).collect()


def test_term_functions(spark):
    df = spark.createDataFrame([('"a\\\\n\\n"',), ('"x"@en-GB',), (f'"5"{INT}',), ("<i>",), ("_:b",), (None,)], "c string")
    c = F.col("c")
    rows = [tuple(r) for r in df.select(T.lexical(c), T.datatype(c), T.language(c), T.numeric(c)).collect()]
    assert rows == [("a\\n\n", "", "", None), ("x", "", "en-gb", None), ("5", T.XSD + "integer", "", 5.0), ("i", None, None, None), ("b" if False else "_:b", None, None, None), (None, None, None, None)]


def test_store(spark, tmp_path):
    root = f"{tmp_path}/store"
    triples = spark.createDataFrame([*PEOPLE, PEOPLE[3], ("<s>", "<" + "p" * 400 + ">", "<o>")], "s string, p string, o string")
    store = Store.load(spark, triples, root, "full", stat_size=2, rows_per_part=2)
    engine = Engine(store)
    assert bag(store.scan_all()) == sorted([*PEOPLE, ("<s>", "<" + "p" * 400 + ">", "<o>")], key=str)
    assert ask(engine, "?s <Name> ?o") == [("<A>", '"case"')]  # names that differ in case alone stay apart
    direct = Engine.from_dataframe(triples)
    for where in ("?x <knows> ?y . ?y <name> ?n", "?x ?p <b>", "?x <age> ?a . ?x <name> ?n . ?x <knows> ?y", "?s <nothing> ?o"):
        want = ask(direct, where)
        for level in LEVELS:
            assert ask(engine, where, optimizer=level) == want
    with pytest.raises(FileExistsError):
        Store.load(spark, triples, root)
    plan = store.scan("<knows>")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(pid" in plan
    store.drop()
    with pytest.raises(FileNotFoundError):
        Store(spark, root)
    empty = Store.load(spark, triples.limit(0), root)
    assert empty.scan_all().collect() == [] and ask(Engine(empty), "?s <p> ?o") == []


def test_command_line(spark, tmp_path, capsys):
    file, rq, root = f"{tmp_path}/people.nt", f"{tmp_path}/q.rq", f"{tmp_path}/db"
    write_ntriples(spark.createDataFrame(PEOPLE, "s string, p string, o string"), file)
    (tmp_path / "q.rq").write_text("SELECT ?x WHERE { ?x <knows> ?y . ?y <name> \"Bob\" } ORDER BY ?x")
    assert bag(read_ntriples(spark, file)) == sorted(PEOPLE, key=str)
    for command in (["loadall", root, file], ["query", "--fullstat", root, rq], ["query", "--restricted-stat", "1", root, rq], ["query", "--stat", root, rq], ["direct-query", file, rq]):
        assert main(command) == 0
    assert capsys.readouterr().out.count("<a>\n<b>\n") == 4
    assert main(["query", root, rq, "-o", f"{tmp_path}/out"]) == 0
    assert spark.read.csv(f"{tmp_path}/out", header=True).count() == 2
    main(["stat", root]), main(["loadfullstat", root]), main(["translate", "--json", root, rq])
    assert '"commands"' in capsys.readouterr().out
    main(["remove", root])
    with pytest.raises(FileNotFoundError):
        main(["remove", root])


@pytest.fixture(scope="module")
def shop(spark):
    a = spark.createDataFrame([(1, "x", 1.5, 7), (2, 'quote " and \\', None, None), (3, "y", -2.0, 8)], "k int, name string, price double, b long")
    b = spark.createDataFrame([(7, "seven", [1]), (8, "eight", [2])], "b long, name string, list array<int>")
    return Engine.from_mapping({"a": Mapping(a, ["k"], {"b": "b"}), "b": Mapping(b, ["b"]), "pairs": Mapping(a.select("k", "b"), ["k", "b"])})


def test_mapped_tables(shop):
    pre = "PREFIX p: <urn:p:> "
    rows = lambda text, **o: bag(shop.sparql(pre + text, **o))
    assert rows("SELECT ?n ?m { ?x p:b ?y . ?x p:price ?p . ?x p:name ?n . ?y p:name ?m }") == [('"x"', '"seven"'), ('"y"', '"eight"')]
    assert rows('SELECT ?x { ?x p:name "quote \\" and \\\\" }') == [("<urn:r:a/2>",)]
    assert rows("SELECT ?x { ?x p:price 1.5e0 }") == []  # another term than "1.5"
    assert rows('SELECT ?x { ?x p:price "1.5"^^<http://www.w3.org/2001/XMLSchema#double> }') == [("<urn:r:a/1>",)]
    assert rows("SELECT ?x { ?x p:k 03 }") == [] and len(rows("SELECT ?x { ?x p:k 3 }")) == 2
    assert rows("SELECT ?x { ?x p:b <urn:r:b/7> }") == [("<urn:r:a/1>",)] and rows("SELECT ?x { ?x p:b <urn:r:b/x> }") == []
    assert rows("SELECT ?p { <urn:r:a/2> ?p ?o }") == [("<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>",), ("<urn:p:k>",), ("<urn:p:name>",)]
    assert len(rows("SELECT ?x { ?x a <urn:c:pairs> . ?x p:k ?k }")) == 3
    assert rows("SELECT ?x { ?x a <urn:c:b> . ?x p:price ?y }") == []
    assert rows("SELECT ?x { ?x p:name ?x }") == []


def test_mapped_equals_its_triples(shop, spark):
    plain = Engine.from_dataframe(shop.source.scan_all())
    for where in ("?x <urn:p:name> ?n . ?x <urn:p:b> ?y", "?x <urn:p:k> ?k . ?x <urn:p:b> ?y . ?z <urn:p:name> ?n", "?x ?p ?o . ?o <urn:p:name> ?n", "<urn:r:a/1> <urn:p:b> ?y . ?y ?q ?v"):
        want = ask(plain, where)
        for level in LEVELS:
            assert ask(shop, where, optimizer=level) == want


def test_a_star_is_one_scan(shop):
    plan = shop.sparql("SELECT * { ?x <urn:p:k> ?k . ?x <urn:p:price> ?p . ?x <urn:p:name> ?n }")._jdf.queryExecution().toString()
    assert "Join" not in plan and "Exchange" not in plan


def test_sources_are_checked(spark):
    with pytest.raises(ValueError, match="optimizer"):
        Engine.from_dataframe(spark.createDataFrame(PEOPLE, "s string, p string, o string")).sparql("SELECT * { ?a <p> ?b }", optimizer="best")
    assert isinstance(Engine.from_mapping({"x": Mapping(spark.range(3).toDF("k"), ["k"])}).source, MappedSource)


def test_keys_of_several_columns_stay_apart(spark):
    t = spark.createDataFrame([("a|b", "c", 1), ("a", "b|c", 2), ("a", None, 3), (None, "a", 4), ("1:a", "", 5), ("", "1:a", 6)], "x string, y string, n int")
    engine = Engine.from_mapping({"t": Mapping(t, ["x", "y"])})
    assert len({s for s, _ in ask(engine, "?s <urn:p:n> ?n")}) == 6


def test_keys_that_are_not_unique(spark):
    """Rows that share a key are one subject with the triples of all, in a star too."""
    t = spark.createDataFrame([(1, "a", 5), (1, "b", 6), (1, "b", 6), (2, "c", 7)], "k int, name string, n int")
    mapped = Engine.from_mapping({"t": Mapping(t, ["k"])})
    plain = Engine.from_dataframe(mapped.source.scan_all())
    for where in ("?s <urn:p:name> ?a . ?s <urn:p:n> ?n", "?s <urn:p:name> ?a", "<urn:r:t/1> ?p ?o", '?s <urn:p:name> "b" . ?s <urn:p:n> ?n'):
        assert ask(mapped, where) == ask(plain, where)
    assert len(ask(mapped, "?s <urn:p:name> ?a . ?s <urn:p:n> ?n")) == 5


def test_values_are_compared_in_their_columns(shop, spark):
    """What typed columns answer, terms answer too."""
    plain = Engine.from_dataframe(shop.source.scan_all())
    row = "?x <urn:p:k> ?k . ?x <urn:p:name> ?n . ?x <urn:p:price> ?p"
    for test in ("?p > 0", "?p <= 1.5", "?p = 1.5e0", "?k != 1", "?k < 2.5", '?n >= "x"', '?n = "x"', '?n < 3', "?k = ?p", "?p < ?k", "?x = <urn:r:a/1>", "?x != <urn:r:a/1>", "?x != <other>", "?nowhere != 1", 'REGEX(?n, "^X", "i")', '?k = "1"'):
        where = f"{row} FILTER({test})" if not test.startswith("REGEX") else f"{row} FILTER {test}"
        assert ask(shop, where) == ask(plain, where), test
    for where in ("?x <urn:p:k> ?k OPTIONAL { ?x <urn:p:price> ?p }", "{ ?x <urn:p:k> ?v } UNION { ?x <urn:p:name> ?v }", "?x <urn:p:k> ?k OPTIONAL { ?x <urn:p:b> ?y } { ?y <urn:p:name> ?n }", "?x <urn:p:price> ?p . ?z <urn:p:price> ?p"):
        assert ask(shop, where) == ask(plain, where), where
    plan = shop.sparql(f"SELECT ?x {{ {row} FILTER(?k > 1) }}")._jdf.queryExecution().optimizedPlan().toString()
    assert "> 1" in plan and "regexp" not in plan
