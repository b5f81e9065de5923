import hashlib

from pyspark.sql import functions as F

from lodegraph.llm import substring
from lodegraph.llm.substring import PassageIndex, op5_substring

from .helpers import SCHEMA, by_id, corpus, frame


def brute(rows, window=20):
    """Judge all windows by comparing words."""
    docs = [(i, (t or "").encode().split()) for i, t, *_ in rows]
    first: dict = {}
    for i, w in sorted(((i, w) for i, w in docs if i is not None), key=lambda x: x[0]):
        for s in range(len(w) - window + 1):
            seal = tuple(w[s : s + window])
            first[seal] = min(first.get(seal, (i, s)), (i, s))
    out: dict = {}
    for i, w in docs:
        gone = set()
        if i is not None:
            for s in range(len(w) - window + 1):
                if first[tuple(w[s : s + window])] < (i, s):
                    gone.update(range(s, s + window))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.setdefault(i, set()).add((len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def test_query_equals_brute_force(spark, tmp_path):
    for seed in (0, 1):
        rows = [*corpus(seed, 90), (None, "no key here " * 20, None, None, 0)]
        d = f"{tmp_path}/{seed}"
        frame(spark, rows, n_words=1, marks="x", kept="y").write.parquet(f"{d}/documents.parquet")
        got = by_id(op5_substring(spark, d), "n_words", "n_removed", "kept_sha256")
        assert got == brute(rows)


def test_more_batches_and_compaction(spark, monkeypatch):
    rows = corpus(3, 90)
    df = frame(spark, rows)
    for fan_in in (1, 2, 9):
        monkeypatch.setattr(substring, "FAN_IN", fan_in)
        index = PassageIndex(spark)
        parts, cuts = [], [0, 60, 130, 200, 10**9]
        for k, (lo, hi) in enumerate(zip(cuts, cuts[1:]), 1):
            parts += [by_id(index.add(df.where(F.col("doc_id").between(lo, hi - 1))), "n_words", "n_removed", "kept")]
            assert len(index.runs) == min(k, fan_in + 1 if fan_in == 1 else {2: [1, 2, 2, 2], 9: [1, 2, 3, 4]}[fan_in][k - 1])
        got = {i: {(n, m, hashlib.sha256(k.encode()).hexdigest()) for n, m, k in x} for p in parts for i, x in p.items()}
        assert got == brute(rows)
        index.drop()


def test_runs_are_merged_as_they_lie(spark):
    """The join of a third batch with the runs neither sorts nor shuffles them."""
    df = frame(spark, corpus(3, 90))
    index = PassageIndex(spark)
    for lo, hi in ((0, 60), (60, 130), (130, 10**9)):
        index.add(df.where((F.col("doc_id") >= lo) & (F.col("doc_id") < hi)))
    *old, new = index.runs

    def plan_of(run):
        return index._ordered(lambda: index.partners(run, new)._jdf.queryExecution().executedPlan().toString())

    assert len(old) == 2
    for run in old:
        lines = plan_of(run).splitlines()
        join = next(i for i, x in enumerate(lines) if "SortMergeJoin" in x)
        left = []  # the first child: lines that go deeper, up to the second child's mark
        for x in lines[join + 1 :]:
            if left and x.lstrip(" |").startswith("+-") and x.index("+-") == lines[join + 1].index(":-"):
                break
            left.append(x)
        assert any(run in x for x in left) and not any(w in x for x in left for w in ("Sort", "Exchange")), lines
    index.drop()


def test_one_id_with_two_texts(spark, tmp_path):
    a, b = [" ".join(f"{c}{i}" for i in range(40)) for c in "ab"]
    rows = [(1, a, None, None, 0), (2, a, None, None, 0), (2, b, None, None, 0), (3, b, None, None, 0)]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    assert by_id(op5_substring(spark, str(tmp_path)), "n_words", "n_removed", "kept_sha256") == brute(rows)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert op5_substring(spark, str(tmp_path)).collect() == []
