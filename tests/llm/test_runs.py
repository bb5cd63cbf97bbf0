"""Periodic runs against a plain search over every period, on sequences, odd texts and the whole
documents table."""

import hashlib
import os
import random
import zlib
from collections import Counter

import numpy as np
from llm.conftest import corpus, empty, frame, words

from tickflow.llm import periodic_runs as P

SF = "/root/testdata/sf0.001"


def brute_runs(s, least_words, least_power):
    n, out, number = len(s), [], {}
    x = np.array([number.setdefault(w, len(number)) for w in s])
    for p in range(1, n // least_power + 1):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], x[p:] == x[:-p], [0]])))
        for i, j in zip(edge[::2].tolist(), edge[1::2].tolist()):
            size = j + p - i
            if size >= max(least_words, least_power * p):
                part = x[i : i + size]
                if not any((part[q:] == part[:-q]).all() for q in range(1, p)):
                    out.append((i, size, p))
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_digest(doc_id, text):
    w = words(text)
    n = len(w)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w, 24, 3)
    keep = [True] * n
    best = (None,) * 4
    for s, size, p in runs:
        keep[s + p : s + size] = [False] * (size - p)
        if best[0] is None or size * best[2] > best[1] * p:
            best = (s, size, p, 1000 * size // p)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *best, sha("".join(f"{s},{size},{p}\n" for s, size, p in runs)), sha(" ".join(x for x, k in zip(w, keep) if k)))


def digest(df):
    return Counter((r.doc_id, r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) for r in df.collect())


def test_runs_equal_brute_force():
    rnd = random.Random(1)
    for _ in range(1500):
        n, k = rnd.randint(0, 60), rnd.randint(1, 3)
        s = [rnd.randint(1, k) for _ in range(n)]
        if n and rnd.random() < 0.6:
            p, a = rnd.randint(1, 8), rnd.randint(0, n - 1)
            s = [s[i] if i < a else s[a + (i - a) % min(p, n - a)] for i in range(n)]
        for words_, power in ((2, 2), (6, 3), (24, 3)):
            assert P.runs_of(s, words_, power) == brute_runs(s, words_, power)


def test_extensions_are_those_of_the_sequence():
    rnd = random.Random(2)
    s = [rnd.randint(1, 2) for _ in range(80)]
    tree = P.SuffixTree(s)
    for a in range(80):
        for b in range(a + 1, 80):
            size = next((k for k in range(80 - b) if s[a + k] != s[b + k]), 80 - b)
            assert tree.extension(np.array([a]), np.array([b]))[0] == size
    assert tree.rank.tolist() == [sorted(range(81), key=lambda i: [*s, 0][i:]).index(i) for i in range(81)]


def odd_rows():
    rnd = random.Random(4)
    rows = corpus()
    at = 100_000
    for n, power in ((24, 3), (23, 3), (25, 3), (30, 4), (90, 2), (400, 7), (9000, 3)):
        p = -(-n // power)
        part = [f"p{rnd.randrange(9)}" for _ in range(p)]
        head = " ".join(f"h{i}" for i in range(rnd.randrange(40)))
        rows.append((at, f"{head} {' '.join((part * (power + 1))[:n])} tail {rnd.random()}"))
        at += 1
    nested = ("a b " * 12 + "c ") * 5  # runs inside the periods of a run
    rows += [(at, nested), (at + 1, "x " * 24 + "y " * 23 + "z " * 25), (at + 2, "x\n" * 24), (None, "q " * 30), (at + 1, "x " * 24 + "y " * 23 + "z " * 25), (at + 3, "long " * 4000)]
    return rows


def test_odd_texts(spark):
    rows = odd_rows()
    assert digest(P.digests(frame(spark, rows))) == Counter(brute_digest(i, t) for i, t in rows)
    assert P.digests(empty(spark)).collect() == []


def test_the_general_interface(spark):
    rows = [(1, "x y z " * 9 + "end"), (2, "no run here"), (3, None)]
    got = {r.doc_id: ([tuple(x) for x in r.runs], r.collapsed) for r in P.collapsed(frame(spark, rows)).collect()}
    assert got == {1: ([(0, 27, 3)], "x y z end"), 2: ([], "no run here"), 3: ([], "")}
    assert {r.doc_id: r.runs for r in P.collapsed(frame(spark, rows), 28, 4).collect()}[1] == []


def test_whole_table(spark):
    import __spark_entry__ as e

    docs = spark.read.parquet(os.path.join(SF, "documents.parquet"))
    want = Counter(brute_digest(r.doc_id, r.text) for r in docs.collect())
    assert digest(e.queries()["op13_periodic_runs"](spark, SF)) == want
    assert sum(r[1] > 0 for r in want) > 10
