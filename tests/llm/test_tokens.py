import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from lodegraph.llm import bpe, wordpiece

from .helpers import SCHEMA, by_id, corpus, frame


@pytest.fixture(scope="module")
def coder():
    return bpe.coder(P.path(bpe.VOCABULARY), P.PATTERN)


@pytest.fixture(scope="module")
def reference(coder):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})


def odd_texts():
    rng = random.Random(1)
    ranges = [(32, 127), (0, 32), (0x80, 0x300), (0x300, 0xD7FF), (0x1F300, 0x1F650)]
    out = ["".join(chr(rng.choice([rng.randrange(*rng.choice(ranges)), 32, 97, 10, 0xA0, 0x85])) for _ in range(rng.randrange(60))) for _ in range(1500)]
    return [*out, "a" * 30_000, "ab" * 3000, "\x1c\x1d a", "²³ x½", "é" * 500, " " * 5000 + "x", "don't we'll", "<|endoftext|>"]


def test_ids_equal_the_public_library(coder, reference):
    for t, ids in zip(odd_texts(), coder.encode_many(odd_texts())):
        assert [int.from_bytes(ids[i : i + 4], "little") for i in range(0, len(ids), 4)] == reference.encode_ordinary(t)
        assert coder.decode(ids) == t.encode()


def test_one_tree_and_many_trees_agree(coder):
    rng = random.Random(2)
    pieces = [bytes(rng.choice(b"abcdethion ") for _ in range(rng.randrange(2, bpe.SHORT + 1))) for _ in range(400)]
    for p, ids in zip(pieces, coder.merge_many(pieces)):
        assert ids.tolist() == coder.merge_long(p)


def test_bpe_query(spark, tmp_path, reference):
    rows = [*corpus(1), (None, "no key", None, None, 0)]
    frame(spark, rows, n_tokens=1, token_ids="x").write.parquet(f"{tmp_path}/documents.parquet")
    got = by_id(bpe.op7_bpe(spark, str(tmp_path)), "n_tokens", "ids_sha256", "decoded_sha256")
    for i, t, *_ in rows:
        ids = reference.encode_ordinary(t or "")
        raw = b"".join(x.to_bytes(4, "little") for x in ids)
        assert got[i] == {(len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())}


def greedy(word, vocabulary):
    n = 0
    while word:
        size = next((s for s in range(len(word), 0, -1) if word[:s] in vocabulary), 0)
        if not size:
            return -1
        word, n = word[size:], n + 1
    return n


def test_automaton_equals_greedy_longest_match():
    rng = random.Random(0)
    whole = {b"a", b"ab", b"abc", b"b", b"bcd", b"c", b"d", b" a", b" abc", b" ", b"cdab", b"dabcda"}
    for vocabulary in (whole, whole - {b"b"}, whole - {b"d", b"c"}):
        m = wordpiece.Matcher(vocabulary)
        for _ in range(5000):
            w = b" " + bytes(rng.choice(b"abcd") for _ in range(rng.randrange(12)))
            assert m.count(w) == greedy(w, vocabulary)


def test_token_counts_query(spark, tmp_path):
    rows = corpus(2)
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = by_id(wordpiece.op9_token_counts(spark, str(tmp_path)), "n_words", "n_tokens", "n_unknown")
    vocabulary = set(bpe.read_ranks(P.path(bpe.VOCABULARY)))
    for i, t, *_ in rows:
        w = (t or "").encode().split()
        assert got[i] == {(len(w), sum(greedy(b" " + x, vocabulary) for x in w), 0)}


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert bpe.encode(empty, P.path(bpe.VOCABULARY), P.PATTERN).collect() == []
    assert wordpiece.token_counts(empty, P.path(bpe.VOCABULARY)).collect() == []


def test_any_pattern(spark):
    """The quick form stands for one pattern only."""
    ranks = bpe.read_ranks(P.path(bpe.VOCABULARY))
    assert bpe.SLOW == P.PATTERN
    coder = bpe.Coder(ranks, r"\p{N}{1,3}|[^\p{N}]+")
    assert coder.split("abc 12345") == ["abc ", "123", "45"]
    other = bpe.Coder(ranks, r"(a|b)+|[^ab]+")
    assert other.split("abba cd") == ["abba", " cd"]  # groups don't matter
