import random

import pytest

from lodegraph.llm import jaccard
from lodegraph.llm.components import components
from lodegraph.llm.jaccard import Plan, groups, op8_jaccard

from .helpers import SCHEMA, by_id, corpus, frame


def sets_of(rows, k):
    out = []
    for i, t, *_ in rows:
        w = bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode()).split()
        out.append((i, {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()))
    return out


def brute(rows, k, num, den):
    sets = sets_of(rows, k)
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and None not in (sets[a][0], sets[b][0]) and den * len(x & y) >= num * len(x | y):
                parent[root(a)] = root(b)
    least: dict = {}
    for a, (i, _) in enumerate(sets):
        if i is not None:
            least[root(a)] = min(least.get(root(a), i), i)
    out: dict = {}
    for a, (i, x) in enumerate(sets):
        out.setdefault(i, set()).add((len(x), None if i is None else least[root(a)]))
    return out


def near_copies(seed, sizes, edits):
    """Chains of copies in which each differs a little from the one before."""
    rng = random.Random(seed)
    rows = []
    for n in sizes:
        base = [f"v{rng.randrange(5000)}" for _ in range(n)]
        for _ in range(8):
            rows.append((len(rows), " ".join(base), None, None, 0))
            base = base[:]
            for _ in range(rng.randrange(edits + 1)):
                base[rng.randrange(len(base))] = f"e{rng.randrange(10**6)}"
            if rng.random() < 0.5:
                base.insert(rng.randrange(len(base)), "new")
    return rows


@pytest.mark.parametrize(("k", "num", "den"), [(4, 85, 100), (5, 4, 5)])
def test_equals_brute_force(spark, k, num, den):
    for rows in (corpus(5, 120), near_copies(7, [8, 12, 20, 35, 38, 40, 45, 60, 90, 150, 400], 3), near_copies(8, [30, 33, 36, 39, 42, 48, 100], 2)):
        rows = [*rows, (None, rows[0][1], None, None, 0)]
        got = by_id(groups(frame(spark, rows, set_id=1, component_id=2), k, num, den), "n_shingles", "component_id")
        assert got == brute(rows, k, num, den)


def test_sets_without_the_guarantee(spark, monkeypatch):
    """With too few blocks every heavy set goes the other way, and nothing is lost."""
    plain = Plan.__init__

    def few(self, *args, **kwargs):
        plain(self, *args, **kwargs)
        self.blocks = self.blocks * 0 + 3

    monkeypatch.setattr(Plan, "__init__", few)
    rows = near_copies(11, [40, 60, 90], 2)
    assert by_id(groups(frame(spark, rows), 4, 85, 100), "n_shingles", "component_id") == brute(rows, 4, 85, 100)


def test_boundary_follows_the_sizes():
    plan = Plan(85, 100)
    assert plan.with_boundary({n: 10 for n in range(6, 200)}).boundary == jaccard.LOWEST
    assert Plan(85, 100).subsets(5) == 0
    many_small = Plan(85, 100).with_boundary({33: 10**6})
    assert many_small.boundary in range(jaccard.LOWEST, jaccard.HIGHEST + 1)


def test_query_and_empty_table(spark, tmp_path):
    rows = corpus(9, 60)
    frame(spark, rows).write.parquet(f"{tmp_path}/a/documents.parquet")
    assert by_id(op8_jaccard(spark, f"{tmp_path}/a"), "n_shingles", "component_id") == brute(rows, 4, 85, 100)
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/b/documents.parquet")
    assert op8_jaccard(spark, f"{tmp_path}/b").collect() == []


def test_components_of_a_long_path(spark):
    rng = random.Random(0)
    order = list(range(200))
    rng.shuffle(order)
    links = [*zip(order, order[1:]), (500, 501), (501, 502), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(200)}, 500: 500, 501: 500, 502: 500}
