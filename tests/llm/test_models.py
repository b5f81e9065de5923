"""Language identification, quality, language-model scores and fertility rules."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from lodegraph.llm import fertility, langid, lmscore, quality

from .helpers import SCHEMA, by_id, corpus, frame

STEMS = {"en": ["the", "and", "tion", "ing", "er", "wh"], "de": ["und", "sch", "keit", "ü", "ein", "ver"], "fr": ["eau", "des", "oi", "é", "que", "ment"]}


def sentences(rng, lang, n):
    return " ".join("".join(rng.choice(STEMS[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def test_languages(spark, tmp_path):
    rng = random.Random(0)
    rows = [(i, sentences(rng, lang := rng.choice(list(STEMS)), rng.randrange(6, 60)), lang, "s", 0) for i in range(300)]
    rows += [(900, None, "en", "s", 0), (901, "", "en", "s", 0), (902, "123 !? 4 ½ ² Ⅻ", "en", "s", 0), (903, "the und " * 5, None, None, 0), (None, "the and the", "en", "s", 0)]
    frame(spark, rows, lang_pred="x", score=2).write.parquet(f"{tmp_path}/documents.parquet")
    out = {r.doc_id: r for r in langid.op1_langid(spark, str(tmp_path)).collect()}
    assert len(out) == len(rows)
    held = [(out[i].lang_pred, lang) for i, _, lang, *_ in rows[:300] if out[i].held_out]
    assert all(out[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, *_ in rows[:300])
    assert sum(a == b for a, b in held) >= 0.97 * len(held) > 0
    assert [out[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3
    assert out[None].lang_pred == "en" and not out[None].held_out
    assert all(0 <= r.score <= 1 for r in out.values())


def test_longest_known_ngrams_score_unseen_words():
    one, two = np.array([-1.0, -3.0]), np.array([-3.0, -1.0])
    m = langid.Model(["x", "y"], {"known": one}, {"abc": two, "bc ": two, " d": one, "d ": one, "e": one, "f": one}, np.zeros(2))
    assert m.predict("known")[0] == "x"
    assert m.score("abc").tolist() == two.tolist()  # two of three 3-grams
    assert m.score("abz").tolist() == [0, 0]  # none are known, of any length
    assert m.score("abcz").tolist() == [0, 0]  # one of four 3-grams is too few, and shorter ones are unknown
    assert m.score("d").tolist() == one.tolist()  # 2-grams
    assert m.score("ef").tolist() == one.tolist()  # two of four 1-grams
    assert m.predict("QQQ") == ("x", 0.5)
    assert langid.Model([], {}, {}, np.zeros(0)).predict("text") == ("und", 0.0)


def brute_languages(rows, most=60_000):
    """Word and n-gram tables by counting, texts scored one by one."""
    taught = [(t.lower(), lang) for i, t, lang, *_ in rows if None not in (i, t, lang) and zlib.crc32(str(i).encode()) % 4 != 2]
    langs = sorted({lang for _, lang in taught})
    letters = lambda t: "".join(c if c.isalpha() else " " for c in t).split()

    def table(items):
        counts = {}
        for item, lang in items:
            counts.setdefault(item, [0] * len(langs))[langs.index(lang)] += 1
        whole = [sum(c[k] for c in counts.values()) + 0.5 * len(counts) for k in range(len(langs))]
        return {x: [math.log((n + 0.5) / w) for n, w in zip(c, whole)] for x, c in counts.items()}

    known = table((w, lang) for t, lang in taught for w in letters(t))
    grams = {n: [(f" {w} "[i : i + n], lang) for t, lang in taught for w in letters(t) for i in range(len(w) + 3 - n)] for n in langid.SIZES}
    parts = table(x for n in langid.SIZES for x in grams[n])
    assert max(len(known), len(parts)) <= most
    prior = [math.log(sum(x == lang for _, x in taught) / len(taught)) for lang in langs]

    def predict(t):
        words = letters((t or "").lower())
        if not words:
            return "und", 0.0
        total = list(prior)
        for w in words:
            score = known.get(w)
            for n in langid.SIZES if score is None else ():
                own = [f" {w} "[i : i + n] for i in range(len(w) + 3 - n)]
                found = [parts[g] for g in own if g in parts]
                if found and 2 * len(found) >= len(own):
                    score = [sum(x) / len(found) for x in zip(*found)]
                    break
            total = [a + b for a, b in zip(total, score or [0] * len(langs))]
        top = max(total)
        p = [math.exp(x - top) for x in total]
        return langs[total.index(top)], max(p) / sum(p)

    return predict


def test_languages_equal_brute_force(spark, tmp_path):
    rng = random.Random(7)
    rows = [(i, sentences(rng, lang := rng.choice(list(STEMS)), rng.randrange(1, 30)) + rng.choice(("", " ½ x² 12a", " _b_")), lang, "s", 0) for i in range(80)]
    rows += [(500, "the" * 40 + " tion" * 5, "en", "s", 0), (501, sentences(rng, "de", 9000), "de", "s", 0), (502, "½", "de", "s", 0), (None, "eau que", "fr", "s", 0), rows[0]]
    frame(spark, rows, lang_pred="x", score=3.0).write.parquet(f"{tmp_path}/documents.parquet")
    predict, found = brute_languages(rows), langid.op1_langid(spark, str(tmp_path)).collect()
    text = {i: t for i, t, *_ in rows}
    assert len(found) == len(rows)
    for r in found:
        lang, score = predict(text[r.doc_id])
        assert r.lang_pred == lang and r.score == pytest.approx(score, abs=1e-9), r.doc_id


def test_nothing_to_learn_languages_from(spark):
    df = frame(spark, [(1, "some text", None, None, 0)])
    assert [tuple(r) for r in langid.identify(df, langid.learn(df)).collect()] == [(1, "und", 0.0)]
    assert langid.identify(df.limit(0), langid.learn(df.limit(0))).collect() == []


def log_sum_exp(values):
    top = max(values)
    return top + math.log(sum(math.exp(v - top) for v in values))


def test_marginals_equal_enumeration():
    from itertools import product

    rng = np.random.default_rng(0)
    field = quality.Field(rng.normal(size=quality.WIDTH + 5))
    counts = np.array([3, 0, 1, 4])
    x = rng.normal(size=(8, quality.WIDTH)) / 4
    good, pairs, log_z = field.marginals(x, counts)
    unary = x @ field.w + field.bias
    at, want_pairs, want_z = 0, np.zeros((2, 2)), 0.0
    for n in counts:
        paths = {y: sum(unary[at + i] * y[i] for i in range(n)) + sum(field.edge[a, b] for a, b in zip(y, y[1:])) for y in product((0, 1), repeat=int(n))}
        z = log_sum_exp(list(paths.values()))
        if n:
            want_z += z
        for i in range(n):
            assert good[at + i] == pytest.approx(sum(math.exp(v - z) for y, v in paths.items() if y[i]))
        for y, v in paths.items():
            for a, b in zip(y, y[1:]):
                want_pairs[a, b] += math.exp(v - z)
        at += n
    assert np.allclose(pairs, want_pairs)
    assert log_z == pytest.approx(want_z)


def test_gradient_equals_differences():
    """Weighted documents: the slope of the likelihood by its definition."""
    rng = np.random.default_rng(3)
    counts, labels = np.array([2, 3, 1, 2]), np.array([1, 0, 0, 0])
    x = rng.normal(size=(8, quality.WIDTH)) / 4
    weights = np.array([3.0, 1, 1, 1])

    def likelihood(theta):
        field, at, total = quality.Field(theta), 0, 0.0
        for n, y, w in zip(counts, labels, weights):
            part = x[at : at + n]
            _, _, z = field.marginals(part, np.array([n]))
            total += w * ((part @ field.w + field.bias).sum() * y + field.edge[y, y] * (n - 1) - z)
            at += n
        return total

    theta = rng.normal(size=quality.WIDTH + 5) / 5
    good, pairs, _ = quality.Field(theta).marginals(x, counts, weights)
    lines = np.repeat(weights, counts)
    seen = np.zeros((2, 2))
    for n, y, w in zip(counts, labels, weights):
        seen[y, y] += w * (n - 1)
    wanted = lines * np.repeat(labels, counts)
    slope = np.concatenate([x.T @ (wanted - good * lines), [(wanted - good * lines).sum()], (seen - pairs).ravel()])
    for k in range(0, len(theta), 7):
        step = np.zeros(len(theta))
        step[k] = 1e-5
        assert slope[k] == pytest.approx((likelihood(theta + step) - likelihood(theta - step)) / 2e-5, abs=1e-5)


def test_long_texts_are_learned_from(spark):
    """The sample is bounded by lines; a text isn't left out for its length."""
    rng = random.Random(1)
    rows = [(i, "\n".join((sentences(rng, "en", 8) if i % 2 else "a | b | c | d | e") for _ in range(3000)), "en", "s", 0) for i in range(6)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(6)], "doc_id long, quality int")
    df = frame(spark, rows, score=5)
    field = quality.learn(df, labels)
    got = {r.doc_id: r.score for r in quality.score(df, field).collect()}
    assert all((got[i] > 0.5) == (i % 2 == 1) for i in got)
    assert quality.learn(df, labels, max_lines=1) is None  # the first document alone has one class


def test_quality(spark, tmp_path):
    rng = random.Random(0)
    rows, labels = [], []
    for i in range(240):
        bad = i % 3 == 0
        lines = [sentences(rng, "en", rng.randrange(4, 14)) + "." for _ in range(rng.randrange(1, 8))]
        if bad:
            lines = [" | ".join(x.split()) if i % 2 else x.replace(" ", "### ") for x in lines]
        rows.append((i, "\n".join(lines), "en", "s", 0))
        labels.append((i, 0 if bad else 1, 0))
    rows += [(900, None, None, None, 0), (901, " \n", None, None, 0), (None, "good words here.", None, None, 0), rows[0]]
    labels += [(None, 1, 0), (5000, None, None)]
    frame(spark, rows, score=1, predicted=9).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = quality.op2_quality(spark, str(tmp_path)).collect()
    assert len(out) == len(rows)
    held = [r for r in out if r.held_out and r.doc_id is not None and r.doc_id < 240]
    assert all((zlib.crc32(str(r.doc_id).encode()) % 5 == 0) == r.held_out for r in out if r.doc_id is not None)
    assert sum(r.predicted == (r.doc_id % 3 != 0) for r in held) >= 0.95 * len(held) > 0
    assert {r.score for r in out if r.doc_id in (900, 901)} == {0.0}
    assert quality.score(frame(spark, rows), quality.learn(frame(spark, rows), spark.createDataFrame([], "doc_id long, quality int"))).agg(F.max("score")).first()[0] == 0.0


def test_blocks_of_numbers():
    rng = np.random.default_rng(1)
    columns = [np.sort(rng.integers(0, 1 << 63, 500).astype(np.uint64) * 2), np.zeros(500, np.int64), rng.integers(0, 300, 500), np.zeros(0, np.int64)]
    for x, y in zip(columns, lmscore.unpack(lmscore.pack(columns))):
        assert (x.astype(np.uint64) == y).all() and len(x) == len(y)
    assert (np.cumsum(lmscore.rises(columns[0]), dtype=np.uint64) == columns[0]).all()


def test_losses_equal_brute_force(spark, monkeypatch):
    """The vocabulary is unbounded and every word a head, whatever the pieces and slices."""
    rows = [*corpus(6, 40), (900, "rare " + "x" * 70 + " rare " + "x" * 70, None, None, 0), (901, "rare " + "y" * 70, None, None, 0), (None, "rare words", None, None, 0)]
    df = frame(spark, rows, n_tokens=7, score="x", piece=1, key=2)
    targets = spark.createDataFrame([(i,) for i, *_ in rows if i is not None and i % 2 == 0] + [(0,), (None,), (77777,)], "doc_id long")
    docs = [(i, (t or "").encode().split()) for i, t, *_ in rows]
    vocabulary = {w for _, ws in docs for w in ws}

    def model(chosen):
        uni, heads, pairs = Counter(), Counter(), Counter()
        for _, ws in chosen:
            uni.update(ws)
            heads.update([None, *ws][: len(ws)])
            pairs.update(zip([None, *ws], ws))
        total = sum(uni.values()) + 0.5 * (len(vocabulary) + 1)

        def loss(h, w):
            u = (uni[w] + 0.5) / total
            return -math.log2(0.6 * (pairs[h, w] + 5 * u) / (heads[h] + 5) + 0.4 * u)

        return loss

    models = model(docs), model([d for d in docs if d[0] is not None and d[0] % 2 == 0])
    for piece, part in ((lmscore.PIECE_BYTES, lmscore.SLICE_BYTES), (1, 4000)):
        monkeypatch.setattr(lmscore, "PIECE_BYTES", piece)
        monkeypatch.setattr(lmscore, "SLICE_BYTES", part)
        out = lmscore.score(df, targets, keep=("doc_id", "lang", "score"))
        assert out.count() == len(rows) and out.columns == ["doc_id", "lang", "n_tokens", "background_loss", "target_loss", "score"]
        got = by_id(out, "n_tokens", "background_loss", "target_loss")
        for i, ws in docs:
            want = [sum(m(h, w) for h, w in zip([None, *ws], ws)) / len(ws) if ws else None for m in models]
            for n, *losses in got[i]:
                assert n == len(ws) and (losses == pytest.approx(want, abs=1e-9) if ws else losses == want)


def test_without_a_target_the_target_model_is_uniform(spark):
    df = frame(spark, [(1, "a b a", None, None, 0), (2, "", None, None, 0)])
    got = by_id(lmscore.score(df, spark.createDataFrame([], "doc_id long")), "target_loss")
    assert got[1].pop()[0] == pytest.approx(math.log2(3)) and got[2] == {(None,)}


def test_pieces_are_joined_where_they_are(spark):
    """Texts are shuffled neither for the counts nor for the losses."""
    out = lmscore.score(frame(spark, corpus(2, 30)), spark.createDataFrame([(0,)], "doc_id long"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_lm_query_and_empty_tables(spark, tmp_path):
    rows = [*corpus(5, 30), (None, "w1 w2", None, None, 0)]
    frame(spark, rows, is_target="x", n_tokens=0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1, 0), (3, 1, 0), (3, 1, 0), (6, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert lmscore.op6_lm_score(spark, str(tmp_path)).count() == len(rows)
    assert lmscore.score(spark.createDataFrame([], SCHEMA), spark.createDataFrame([(1,)], "doc_id long")).collect() == []


def repeats(words, window=8):
    seen = Counter(tuple(words[i : i + window]) for i in range(len(words) - window + 1))
    covered = set()
    for i in range(len(words) - window + 1):
        if seen[tuple(words[i : i + window])] > 1:
            covered.update(range(i, i + window))
    return len(covered)


def test_fertility_base_rules(spark, tmp_path):
    rows = [*corpus(6, 90), (700, "a line\na line\n\n\n é# ñ$\na line ", "fr", "s", 0), (None, "b c", None, None, 0)]
    frame(spark, rows, n_words=3, kept="x").write.parquet(f"{tmp_path}/documents.parquet")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    out = fertility.op10_fertility(spark, str(tmp_path))
    got = by_id(out, *names)
    for i, t, *_ in rows:
        raw = (t or "").encode()
        w = raw.split()
        lines = [x for x in raw.split(b"\n") if x.split()]
        again = repeats(w)
        want = (len(w), len(b"".join(w).decode()), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), again, len(w) < 20 or 100 * again > 30 * len(w))
        assert got[i] == {want}
    assert out.where("kept AND base_failed").isEmpty() and out.where("kept IS NULL").isEmpty()


def test_fertility_bands(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, sentences(rng, "en", 60), "en", "s", 0) for i in range(80)]
    rows.append((500, " ".join("\U00013000\U00013001\U00013002" + chr(0x13000 + i) for i in range(60)), "en", "s", 0))  # falls back on bytes
    df = frame(spark, rows)
    judged = fertility.judge(fertility.measure(df, P.path("piece_bpe_32k.model"), ("doc_id", "lang")).cache())
    kept = {r.doc_id: r.kept for r in judged.collect()}
    assert not kept[500] and sum(kept.values()) >= 79
    assert fertility.judge(fertility.measure(df.limit(0), P.path("piece_bpe_32k.model"), ("doc_id", "lang"))).collect() == []
