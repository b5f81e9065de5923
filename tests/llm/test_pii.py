import hashlib
import math
import random
import re

from pyspark.sql import functions as F

from lodegraph.llm import pii

from .helpers import SCHEMA, by_id, corpus, frame

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in EMAIL.finditer(t)]
    out += [("ip", *m.span()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(t):
        d = [int(c) for c in digits(m[0])]
        total = sum(d[-1::-2]) + sum(sum(divmod(2 * x, 10)) for x in d[-2::-2])
        if 16 <= len(d) <= 19 and total % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in PHONE.finditer(t) if 8 <= len(digits(m[0])) <= 15]


def test_base_spans_equal_the_patterns():
    rng = random.Random(0)
    for alphabet in ("a.@-0 1", "0123456789 -+().", "a@b.c", "12.5 +", "é@a.b\n1", "4111 -"):
        for _ in range(4000):
            t = "".join(rng.choice(alphabet) for _ in range(rng.randrange(45)))
            assert pii.base_spans(t) == brute(t)
    assert pii.base_spans("9" * 100_000 + "." * 50_000 + "a" * 100_000 + "@") == []


def test_contexts_of_long_words():
    """Contexts are whole words, six on either side, however long the words are."""
    rng = random.Random(2)
    for size in (4, 70, 500):
        for _ in range(50):
            left, right = (["".join(rng.choice("abc") for _ in range(rng.randrange(3, size))) for _ in range(rng.randrange(9))] for _ in range(2))
            t = "\n ".join([*left, "<x@mail.example.com>,", *right])
            ((entity, _, terms),) = pii.contexts(t, pii.base_spans(t), 6)
            # the signs around the entity are a word on either side
            assert entity == "email:x@mail.example.com" and [w for w, _, _ in terms] == left[-5:] + right[:5]
            assert all(t[a:b] == w for w, a, b in terms)


def texts():
    """One address is named in many different contexts with one word that occurs nowhere else."""
    rng = random.Random(1)
    word = lambda: f"word{rng.randrange(40)}"
    rows = [(i, " ".join(word() for _ in range(30)), None, None, 0) for i in range(40)]
    for i in range(100, 106):
        near = [word() for _ in range(6)]
        rows.append((i, f"Dear {' '.join(near[:3])} Zaphod, write to z.b@mail.example.com {' '.join(near[3:])} bye", None, None, 0))
    rows += [(200 + i, f"the same copied context {'Unique'} x@copy.example.com again and again", None, None, 0) for i in range(6)]
    rows += [(300, None, None, None, 0), (301, "", None, None, 0), (302, "call +1 (243) 555-5526 or 4111 1111 1111 1111, 10.0.0.255", None, None, 0), (None, "null@key.example.com", None, None, 0)]
    return rows


def test_disclosing_terms(spark, tmp_path):
    rows = texts()
    df = frame(spark, rows, spans="x", all_spans="y", terms=1, n_email=5)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    out = {r.doc_id: r for r in pii.op4_pii(spark, str(tmp_path)).collect()}
    assert len(out) == len(rows)
    for i, t, *_ in rows:
        base = ",".join(f"{k}:{a}:{b}" for k, a, b in brute(t or ""))
        assert out[i].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert out[i].spans.startswith(base)
        extra = [x.split(":") for x in out[i].spans.split(",") if x.startswith("term")]
        words = [t[int(a) : int(b)] for _, a, b in extra]
        if i in range(100, 106):
            assert "Zaphod" in words and "word1" not in words
        else:
            assert words == []
    assert (out[302].n_phone, out[302].n_card, out[302].n_ip, out[302].n_email) == (1, 1, 1, 0)


def test_pairs_of_one_context(spark):
    """A rare word that is found elsewhere is judged by one sighting; a word that stands nowhere else and common words aren't terms."""
    rows = [(i, f"filler text number n{i} of common words", None, None, 0) for i in range(600)]
    rows += [(1000, "common words by Trillian at t.m@mail.example.com only", None, None, 0), (1001, "Trillian was here", None, None, 0)]
    df = frame(spark, rows)
    pairs = {tuple(r) for r in pii.disclosing(pii.find(df).cache(), df).select("entity", "term").collect()}
    assert pairs == {("email:t.m@mail.example.com", "trillian")}


def brute_pairs(rows, threshold=0.8, support=3, chance=0.01, reach=6):
    """Strengths of all pairs, from counts over every row."""
    held, words = [], []
    for i, t, *_ in rows:
        if i is None:
            continue
        held.append([(e, s, {w for w, _, _ in terms}) for e, s, terms in pii.contexts(t or "", brute(t or ""), reach)])
        words.append({w.strip(pii.EDGES).lower() for w in re.split("[ \\t\\n\\v\\f\\r]+", t or "")})
    n, out = len(held), {}
    for e in {e for row in held for e, _, _ in row}:
        c_e = sum(any(x == e for x, _, _ in row) for row in held)
        near = {w for row in held for x, _, ws in row if x == e for w in ws}
        for w in near if c_e < n else ():
            c_te = sum(any(x == e and w in ws for x, _, ws in row) for row in held)
            seals = {s for row in held for x, s, ws in row if x == e and w in ws}
            c_t = sum(w in x for x in words)
            strength = math.log(n * c_te / (c_t * c_e)) / math.log(n / c_e) if c_t else -1
            k = min(len(seals), 20)
            meant = len(seals) >= support or (c_t > c_te and (c_t * c_e / n) ** k / math.factorial(k) <= chance)
            if strength >= threshold and meant:
                out[e, w] = (round(strength, 9), c_te, c_e, c_t)
    return out


def test_strengths_equal_brute_force(spark):
    rng = random.Random(5)
    word = lambda: f"word{min(rng.randrange(400), rng.randrange(400))}"
    rows = []
    for i in range(400):
        t = [word() for _ in range(rng.randrange(2, 25))]
        for _ in range(rng.choice((0, 0, 1, 1, 2))):
            who = rng.randrange(12)
            t.insert(rng.randrange(len(t)), f"Name{who},")
            t.insert(rng.randrange(len(t)), rng.choice((f"user{who}@mail.example.com", f"10.0.0.{who}", f"(Name{who}:user{who}@mail.example.com)")))
        rows.append((i, rng.choice((" ", "\n", "  ")).join(t), None, None, 0))
    rows += [rows[3], (None, "Name1 user1@mail.example.com", None, None, 0), (900, None, None, None, 0)]
    df = frame(spark, rows, term="x", c_t=1, row=2)
    got = {(r.entity, r.term): (round(r.strength, 9), r.c_te, r.c_e, r.c_t) for r in pii.disclosing(pii.find(df).cache(), df).collect()}
    assert got == brute_pairs(rows) and any(w.startswith("name") for _, w in got) and len(got) >= 10


def test_terms_far_from_the_entity(spark):
    long = "very" * 50
    rows = [(i, f"filler text number n{i} of common words", None, None, 0) for i in range(5000, 8000)]
    rows += [(1000, "Trillian, " + "common words " * 20 + f"by trillian {long} at t.m@mail.example.com only", None, None, 0), (1001, f"(Trillian) was here, not trillian@mail.example.org, {long.upper()}!", None, None, 0)] + [(1001, f"(Trillian) was here, not trillian@mail.example.org, {long.upper()}!", None, None, 0)]
    rows.append((1002, "common words " * 30_000 + "Trillian", None, None, 0))
    df = pii.with_key(frame(spark, rows, spans="x", wanted="y"))
    pairs = pii.disclosing(pii.find(df, (pii.KEY,)).cache(), df, pii.KEY)
    text = {i: t for i, t, *_ in rows}
    for size in (pii.SHARED_BYTES, 0):  # terms given to every task, or joined
        out = pii.all_spans(df, pairs, ("doc_id",), pii.KEY, shared_bytes=size)
        assert out.count() == len(rows)
        got = {r.doc_id: [text[r.doc_id][s.a : s.b] for s in r.all_spans if s.kind == "term"] for r in out.collect()}
        assert got[1000] == ["Trillian", "trillian", long] and got[1001] == ["Trillian", long.upper()] and got[1002] == ["Trillian"]
        assert not any(got[i] for i in range(5000, 8000))


def test_sanitised_texts(spark):
    rows = texts()
    df = frame(spark, rows)
    spans = pii.all_spans(df, pii.disclosing(pii.find(df).cache(), df), ("doc_id", "text"))
    got = by_id(pii.sanitise(spans), "text")
    once = pii.all_spans(df, pii.disclosing(pii.find(df).cache(), df), ("doc_id",), with_text=True)
    assert by_id(once, "sanitised") == got and pii.sanitise(spans).columns == ["doc_id", "text", "spans"]
    assert got[302] == {("call [PHONE] or [CARD], [IP]",)}
    ((text,),) = got[100]
    assert "[EMAIL]" in text and "[TERM]" in text and "Zaphod" not in text
    assert got[300] == {(None,)} and got[301] == {("",)} and got[0] == {(rows[0][1],)}


def test_clean_corpus_and_empty_table(spark, tmp_path):
    rows = corpus(8)
    df = frame(spark, rows)
    out = pii.all_spans(df, pii.disclosing(pii.find(df).cache(), df))
    assert out.where(F.size("all_spans") > 0).isEmpty() and out.count() == len(rows)
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert pii.op4_pii(spark, str(tmp_path)).collect() == []
