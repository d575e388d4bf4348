"""Periodic runs against brute force."""

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import periodic
from tidemark.llm import queries as Q


def brute(w):
    """(start, length, period) of all runs of a list, by every period and place."""
    n, found = len(w), {}
    for p in range(1, n // 4 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and w[j] == w[j + p]:
                j += 1
            if j - i + p >= max(6, 4 * p):
                found.setdefault((i, j + p - i), p)
            i = max(j, i + 1) if j > i else i + 1
    return sorted((s, k, p) for (s, k), p in found.items())


def collapse(w, runs):
    gone = {i for s, k, p in runs for i in range(s + p, s + k)}
    return [x for i, x in enumerate(w) if i not in gone]


piece = st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=5), st.integers(1, 9)).map(lambda x: x[0] * x[1])
word_lists = st.lists(st.lists(piece, max_size=6).map(lambda x: [w for y in x for w in y]), max_size=5)


@settings(max_examples=400, deadline=None)
@given(word_lists)
def test_runs_equal_brute_force(docs):
    n = np.array([len(d) for d in docs], dtype=np.int64)
    got = periodic.find_runs(np.array([x for d in docs for x in d], dtype=np.int64), n)
    assert list(zip(*(x.tolist() for x in got))) == [(k, *r) for k, d in enumerate(docs) for r in brute(d)]


@pytest.mark.parametrize("top", [0, 2])
def test_extensions_equal_comparison(monkeypatch, top):
    monkeypatch.setattr(periodic, "TOP", max(top, 1))
    rng = np.random.default_rng(3)
    base = np.concatenate([rng.integers(0, 2, 400), np.tile(rng.integers(0, 3, 7), 40), np.zeros(90, int), rng.integers(0, 2, 100)])
    text = np.concatenate([[0], base + 2, [1]])
    levels = periodic.recompress(text, 2)
    assert len(levels) > 5
    a, b = rng.integers(1, len(base) + 1, (2, 3_000))
    a, b = a[a != b], b[a != b]

    def walk(i, j, step):
        k = 0
        while text[i] == text[j] and text[i] > 1:
            i, j, k = i + step, j + step, k + 1
        return k

    for step in (1, -1):
        assert periodic.extend(levels, a, b, step).tolist() == [walk(i, j, step) for i, j in zip(a.tolist(), b.tolist())]


def test_grid_in_small_steps(monkeypatch):
    rng = np.random.default_rng(4)
    docs = [rng.integers(0, 2, k).tolist() + [7] * 30 for k in (0, 5, 90, 300)]
    n = np.array([len(d) for d in docs])
    flat = np.concatenate(docs).astype(np.int64)
    want = [x.tolist() for x in periodic.find_runs(flat, n)]
    monkeypatch.setattr(periodic, "TOGETHER", 3)
    assert [x.tolist() for x in periodic.find_runs(flat, n)] == want


def planted(doc_id, w):
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    g = h // 10
    if doc_id is None or h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return w[:a] + [w[a + (i - a) % p] for i in range(a, n)]


def row(doc_id, text):
    w = planted(doc_id, re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    runs = brute_fast(w)
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *((None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])),
            sha("".join(f"{s},{k},{p}\n" for s, k, p in runs)), sha(" ".join(collapse(w, runs))))


def brute_fast(w):
    """brute() by whole arrays: stretches of equal words p apart."""
    ids = {}
    x = np.array([ids.setdefault(v, len(ids)) for v in w], dtype=np.int64)
    found = {}
    for p in range(1, len(x) // 4 + 1):
        same = np.concatenate([[False], x[p:] == x[:-p], [False]])
        edge = np.flatnonzero(same[1:] != same[:-1])
        for i, j in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if j - i + p >= max(6, 4 * p):
                found.setdefault((i, j + p - i), p)
    return sorted((s, k, p) for (s, k), p in found.items())


TEXTS = [None, "", " \t\n", "a " * 5, "a " * 6, "a\tb " * 4, "x a\x0bb\x0ca b a\rb y", "é\xa0é " * 9, "tie tie " * 20, "tie tie " * 20,
         "p q r " * 3 + "p q", "p q r " * 4, "b " + "a a b " * 8 + "z", " ".join(f"w{i % 17}" for i in range(700)), "u " * 3_000]


def test_query_equals_brute_force(spark, tmp_path):
    ids = [None if i == 3 else 7 if i in (8, 9) else i for i in range(len(TEXTS))]
    more = [(i, " ".join(f"w{(i * k * k + k) % 11}" for k in range(i))) for i in range(100, 330)]
    rows = [*zip(ids, TEXTS), *more]
    spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, runs string, start int") \
        .repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in more) > 5
    key = lambda r: tuple((x is not None, x) for x in r)
    got = sorted((tuple(r) for r in Q.QUERIES["op11_periodic_runs"](spark, str(tmp_path)).collect()), key=key)
    assert got == sorted((row(*r) for r in rows), key=key)


def test_given_documents(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(tuple(r) for r in Q.QUERIES["op11_periodic_runs"](spark, sf).collect())
    want = sorted(row(r["doc_id"], r["text"]) for r in rows)
    assert got == want and any(r[1] for r in want)


def test_empty_table(spark):
    assert periodic.periodic_runs(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_words():
    flat, n = periodic.words_of(pa.array([" a  b\x1c\n", "", "\v\f\r c"]))
    assert flat.to_pylist() == ["a", "b\x1c", "c"] and n.tolist() == [2, 0, 1]
