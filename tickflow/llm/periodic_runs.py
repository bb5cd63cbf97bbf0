"""Periodic runs of words: stretches that repeat one passage three times and more, found by longest
common extensions on suffix trees.

A run is a stretch of consecutive words with smallest period q that no neighbouring word extends
keeping the period; reported are those of at least max(LEAST_WORDS, LEAST_POWER * q) words.

1. *Where runs can lie.* With at least 24 words and three periods, every word of a run starts or
   ends an equal pair of GRAM words at a distance of at most a third of the stretch. Word hashes find
   all such pairs of a batch at once; the stretches that they cover hold every run whole (a
   collision of hashes only widens one). The step is repeated inside what is left until it stands.
2. *Suffix trees.* Ukkonen's construction over each stretch (words as dense numbers, compared by
   their bytes) and over its reversal. The Euler tour of a tree is kept as the depths between
   successive leaves; a sparse table over it answers the lowest common ancestor of two leaves,
   and so the longest common extension of two places, in constant time.
3. *Candidates.* A run has a Lyndon root: at some place the longest Lyndon word, under the order of
   the words or its reverse, is as long as the period. Both follow from the order of the leaves (the
   next smaller and the next greater suffix). Each candidate is extended to the right by the tree
   and to the left by that of the reversal; equal (start, period) are one run.

Defined results: a word is ``[^\\x20\\x09-\\x0D]+``, unchanged; null, empty and blank texts have no
words, no run and an empty collapsed text; repeated rows each get a row; an empty table gives no
rows; of the other columns none is read, whatever their names. A text of any length is one chain;
a worker holds one stretch's two trees at a time (about 600 bytes a word of the stretch). Nothing is
shuffled: a lost executor's tasks read their input again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickflow.llm.common import U64, Words, column, mix, sliced, windows, words_of

LEAST_WORDS, LEAST_POWER = 24, 3
GRAM = 8  # 24 words and three periods leave GRAM words at both ends of every equal pair


class SuffixTree:
    """Ukkonen's tree of a sequence of numbers from 1 on, ended by 0."""

    def __init__(self, symbols: list[int]):
        s = self.symbols = [*symbols, 0]
        n = len(s)
        start, end, link, kids = [0], [0], [0], [{}]
        node = at = length = left = 0
        for pos in range(n):
            c, need = s[pos], 0
            left += 1
            while left:
                if not length:
                    at = pos
                here = kids[node]
                child = here.get(s[at])
                if child is None:
                    here[s[at]] = len(start)
                    start.append(pos)
                    end.append(n)
                    link.append(0)
                    kids.append(None)
                    if need:
                        link[need] = node
                    need = node
                else:
                    first = start[child]
                    size = (end[child] if end[child] <= pos else pos + 1) - first
                    if length >= size:
                        at += size
                        length -= size
                        node = child
                        continue
                    if s[first + length] == c:
                        length += 1
                        if need:
                            link[need] = node
                        break
                    inner = len(start)
                    start += (first, pos)
                    end += (first + length, n)
                    link += (0, 0)
                    kids += ({s[first + length]: child, c: inner + 1}, None)
                    start[child] = first + length
                    here[s[at]] = inner
                    if need:
                        link[need] = inner
                    need = inner
                left -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    at = pos - left + 1
        self._tour(start, end, kids)

    def _tour(self, start: list[int], end: list[int], kids: list) -> None:
        """Leaves in order, and the depth of the tour's shallowest node between each two."""
        n = len(self.symbols)
        leaves, depths, least = [], [], 0
        stack = [(0, 0, 0)]  # node, depth above it, depth of the branch taken (-1: the first)
        while stack:
            node, depth, branch = stack.pop()
            if branch >= 0:
                least = branch
            depth += end[node] - start[node]
            below = kids[node]
            if below is None:
                leaves.append(n - depth)
                depths.append(least)
            else:
                order = sorted(below, reverse=True)
                stack += [(below[x], depth, depth) for x in order[:-1]]
                stack.append((below[order[-1]], depth, -1))
        self.rank = np.empty(n, np.int64)
        self.rank[leaves] = np.arange(n)
        self.table = [np.array(depths, np.int32)]
        while 2 << (len(self.table) - 1) <= n:
            row, step = self.table[-1], 1 << (len(self.table) - 1)
            self.table.append(np.minimum(row[:-step], row[step:]))

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest common extension of the places a and b (a != b), pair by pair."""
        low, high = self.rank[a], self.rank[b]
        low, high = np.minimum(low, high) + 1, np.maximum(low, high) + 1
        level = np.frexp((high - low).astype(np.float64))[1] - 1  # floor of the logarithm
        out = np.empty(len(low), np.int64)
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            row = self.table[k]
            out[at] = np.minimum(row[low[at]], row[high[at] - (1 << k)])
        return out


def _lyndon_ends(rank: list[int]) -> tuple[list[int], list[int]]:
    """One past the longest Lyndon word that starts at each place, under the order of the symbols
    and under its reverse: the next suffix that is smaller, and the next that is greater. The end
    mark is smaller than all symbols; reversed it is greater, and a word that reaches over it (no
    greater suffix) stands for no root: its end is out of reach."""
    n = len(rank) - 1
    smaller, greater = [n] * n, [4 * n] * n
    low, high = [], []
    for i in range(n):
        r = rank[i]
        while low and rank[low[-1]] > r:
            smaller[low.pop()] = i
        low.append(i)
        while high and rank[high[-1]] < r:
            greater[high.pop()] = i
        high.append(i)
    return smaller, greater


def runs_of(symbols: list[int], least_words: int = LEAST_WORDS, least_power: int = LEAST_POWER) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a sequence of numbers from 1 on, in order."""
    n = len(symbols)
    if n < max(least_words, least_power):
        return []
    tree, back = SuffixTree(symbols), SuffixTree(symbols[::-1])
    i = np.tile(np.arange(n), 2)
    j = np.concatenate(_lyndon_ends(tree.rank.tolist()))
    short = (j - i) * least_power <= n
    i, j = i[short], j[short]
    right = tree.extension(i, j)  # place n is the end mark
    left = back.extension(n - i, n - j)
    start, period = i - left, j - i
    length = j + right - start
    good = (length >= least_words) & (length >= least_power * period)
    found = np.unique(np.stack([start, period, length])[:, good], axis=1)
    return [(s, size, p) for s, p, size in found.T.tolist()]


def _stretches(hashes: np.ndarray, bounds: np.ndarray, least_words: int, least_power: int) -> list[tuple[int, int]]:
    """Ranges of words that hold every run of the texts cut at `bounds` whole."""
    first, end = bounds[:-1], bounds[1:]
    grams = windows(hashes, GRAM) if len(hashes) >= GRAM else np.zeros(0, U64)
    while True:
        big = end - first >= least_words
        first, end = first[big], end[big]
        if not len(first):
            return []
        size = end - first - GRAM + 1
        owner = np.repeat(np.arange(len(first)), size)
        at = np.arange(size.sum()) + np.repeat(first - (np.cumsum(size) - size), size)
        key = mix(grams[at] ^ (owner.astype(U64) * U64(0x9E3779B97F4A7C15)))
        order = np.argsort(key, kind="stable")
        same = np.flatnonzero((key[order[1:]] == key[order[:-1]]) & (owner[order[1:]] == owner[order[:-1]]))
        one, two = order[same], order[same + 1]
        near = (two - one) * least_power <= (end - first)[owner[one]]
        marked = np.zeros(len(at), bool)
        marked[one[near]] = marked[two[near]] = True
        place, of = at[marked], owner[marked]
        if not len(place):
            return []
        new = np.ones(len(place), bool)
        new[1:] = (place[1:] > place[:-1] + GRAM) | (of[1:] != of[:-1])
        last = np.append(np.flatnonzero(new)[1:] - 1, len(place) - 1)
        starts, ends = place[new], place[last] + GRAM
        if len(starts) == len(first) and (starts == first).all() and (ends == end).all():
            return list(zip(first.tolist(), end.tolist()))
        first, end = starts, ends


def _numbered(words: list[bytes]) -> list[int]:
    seen: dict[bytes, int] = {}
    return [seen.setdefault(w, len(seen) + 1) for w in words]


RUN = "array<struct<start:bigint,length:bigint,period:bigint>>"


def collapsed(docs: DataFrame, least_words: int = LEAST_WORDS, least_power: int = LEAST_POWER) -> DataFrame:
    """doc_id, runs (by start, then period) and collapsed of every row: the words joined by one
    space, without those that a run holds after its first period."""
    if least_power < 3 or least_words < 3 * GRAM:
        raise ValueError("a run has at least three periods and 24 words here")
    rows = docs.select(column(docs, "doc_id").alias("doc_id"), F.coalesce(column(docs, "text"), F.lit("")).alias("text"))

    def run(batches):
        for batch in batches:
            for piece in sliced(batch, "text"):
                texts = piece.column("text")
                words = Words(texts)
                split = [t.encode().split() for t in texts.to_pylist()]
                found: list[list] = [[] for _ in split]
                for a, b in _stretches(words.hashes(), words.bounds, least_words, least_power):
                    i = int(np.searchsorted(words.bounds, a, "right")) - 1
                    base = a - int(words.bounds[i])
                    found[i] += [(base + s, n, p) for s, n, p in runs_of(_numbered(split[i][base : base + b - a]), least_words, least_power)]
                out = []
                for own, runs in zip(split, found):
                    if runs:
                        runs.sort(key=lambda r: (r[0], r[2]))
                        keep = np.ones(len(own), bool)
                        for s, n, p in runs:
                            keep[s + p : s + n] = False
                        own = [own[k] for k in np.flatnonzero(keep).tolist()]
                    out.append(b" ".join(own).decode())
                spans = [[{"start": s, "length": n, "period": p} for s, n, p in runs] for runs in found]
                kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(spans, kind), pa.array(out, pa.string())], ["doc_id", "runs", "collapsed"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, runs {RUN}, collapsed string")


def with_repeated_tails(docs: DataFrame) -> DataFrame:
    """doc_id, text: the query's input. Every tenth document by the checksum of its doc_id repeats a
    passage from some word on to its end; the others (and rows without doc_id) stay as they are."""
    rows = docs.select(column(docs, "doc_id").alias("doc_id"), column(docs, "text").alias("text"))
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = rows.select("doc_id", "text", F.when(h % 10 == 0, words_of(F.col("text"))).alias("w"), F.floor(h / 10).cast("bigint").alias("g"))
    rows = rows.select("doc_id", "text", "w", "g", F.size("w").cast("bigint").alias("n"))
    rows = rows.select("doc_id", "text", "w", "g", "n", F.expr("CASE WHEN n > 0 THEN g % n END").alias("a"))
    rows = rows.select("doc_id", "text", "w", "n", "a", F.expr("1 + (n - a) div (3 + g % 8)").alias("p"))
    tail = "array_join(transform(sequence(0, n - 1), i -> w[CAST(CASE WHEN i < a THEN i ELSE a + (i - a) % p END AS INT)]), ' ')"
    return rows.select("doc_id", F.expr(f"CASE WHEN n > 0 THEN {tail} ELSE text END").alias("text"))


def digests(docs: DataFrame) -> DataFrame:
    """The query's digest of :func:`collapsed` over :func:`with_repeated_tails`."""
    out = collapsed(with_repeated_tails(docs))
    # greatest length / period, compared exactly; the runs come by start, then period
    best = "aggregate(slice(runs, 2, greatest(size(runs) - 1, 0)), runs[0], (x, y) -> CASE WHEN y.length * x.period > x.length * y.period THEN y ELSE x END)"
    out = out.select("*", F.expr(f"CASE WHEN size(runs) > 0 THEN {best} END").alias("b"))
    return out.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        F.col("b.start").alias("start"),
        F.col("b.length").alias("length"),
        F.col("b.period").alias("period"),
        F.expr("(1000 * b.length) div b.period").alias("exponent_milli"),
        F.sha2(F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
