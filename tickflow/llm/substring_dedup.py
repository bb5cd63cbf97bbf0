"""Substring dedup: removes every word covered by a window of `width` words whose word sequence
also starts in a document with a smaller doc_id. Windows are judged on the input texts.

Method. The method first named for this operator, suffix automata of reference shards broadcast to
a stream of all documents, can't give whole results here: every document is a reference for
the later ones, so the automata hold the whole corpus (nothing of a bounded size to broadcast), and
each of its shards would have to meet every document. The README has the figures. Equal windows
are found by fingerprints instead:

1. Copies of whole texts are told by their digest; all but the first lose every window.
2. A window's minimizer is the smallest hash among its runs of GRAM words. Equal windows have equal
   minimizers, and a text has about one in (width - GRAM + 2) / 2 words, so the minimizers that
   occur in two documents (a fifth of the words to shuffle, not all) say which windows can repeat.
3. Those windows only are compared, by 128-bit fingerprints: a window goes if the smallest doc_id
   that holds it is smaller than its own.
4. Each text is cut by the list of its removed windows.

The texts are dealt by doc_id once; the index, the candidates and the cut read the same exchange.
Minimizers and windows are grouped by streaming aggregates and hash joins whose build side has
one row a key, so a key with a third of all rows passes through without being held or sorted.

Defined results: a word is ``[^\\x20\\x09-\\x0D]+``, unchanged; null text has no words; texts under
`width` words lose nothing; rows that repeat a doc_id are neither smaller nor larger than each
other; a row without doc_id neither loses words nor makes others lose any; empty tables give no
rows. Only doc_id and text are read (`cut_documents` keeps the other columns).
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickflow.llm.common import U64, Words, as_long, column, mix, sliced, windows

WIDTH, GRAM = 13, 5


def _sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    """Minimum of every `size` consecutive values (by doubling)."""
    out, done = x, 1
    while done < size:
        step = min(done, size - done)
        out = np.minimum(out[: len(out) - step], out[step:])
        done += step
    return out


class Windowed:
    """The windows of a batch of texts: per text, fingerprints and minimizers by starting word."""

    def __init__(self, texts: pa.Array, width: int):
        words = Words(texts)
        self.width, self.bounds, self.h = width, words.bounds, words.hashes()

    def rows(self):
        """(text number, first window, one past the last) of the texts that have windows."""
        starts, ends = self.bounds[:-1], self.bounds[1:] - (self.width - 1)
        for i in np.flatnonzero(ends > starts).tolist():
            yield i, int(starts[i]), int(ends[i])

    def minimizers(self) -> np.ndarray:
        grams = windows(self.h, min(GRAM, self.width))
        return _sliding_min(mix(grams ^ U64(0x5851F42D4C957F2D)), self.width - min(GRAM, self.width) + 1) if len(self.h) >= self.width else np.zeros(0, U64)

    def prints(self) -> np.ndarray:
        return windows(self.h, self.width)

    def second_prints(self) -> np.ndarray:
        return windows(mix(self.h ^ U64(0x2545F4914F6CDD1D)), self.width)


def _index(rows: DataFrame, width: int) -> DataFrame:
    """(m, doc_id): the distinct minimizers of every text that isn't a copy."""

    def run(batches):
        for batch in batches:
            for piece in sliced(batch, "text"):
                ids, copy = piece.column("doc_id"), piece.column("copy").to_pylist()
                windowed = Windowed(piece.column("text"), width)
                m = windowed.minimizers()
                found = [(i, np.unique(m[a:b])) for i, a, b in windowed.rows() if not copy[i] and ids[i].is_valid]
                if found:
                    owner = np.repeat([i for i, _ in found], [len(x) for _, x in found])
                    yield pa.RecordBatch.from_arrays([as_long(np.concatenate([x for _, x in found])), ids.take(pa.array(owner))], ["m", "doc_id"])

    return rows.mapInArrow(run, "m bigint, doc_id bigint")  # all columns, so that its exchange is that of the cut


def _candidates(rows: DataFrame, width: int) -> DataFrame:
    """(h1, h2, doc_id): fingerprints of the windows whose minimizer is in the row's list."""

    def run(batches):
        for batch in batches:
            for piece in sliced(batch, "text"):
                ids, copy, lists = piece.column("doc_id"), piece.column("copy").to_pylist(), piece.column("ms")
                windowed = Windowed(piece.column("text"), width)
                m, one, two = windowed.minimizers(), windowed.prints(), windowed.second_prints()
                found = []
                for i, a, b in windowed.rows():
                    if not copy[i] and lists[i].is_valid and ids[i].is_valid:
                        at = a + np.flatnonzero(np.isin(m[a:b], lists[i].values.to_numpy().view(U64)))
                        _, first = np.unique(one[at], return_index=True)
                        found.append((i, at[first]))
                if found:
                    owner, at = np.repeat([i for i, _ in found], [len(x) for _, x in found]), np.concatenate([x for _, x in found])
                    yield pa.RecordBatch.from_arrays([as_long(one[at]), as_long(two[at]), ids.take(pa.array(owner))], ["h1", "h2", "doc_id"])

    return rows.mapInArrow(run, "h1 bigint, h2 bigint, doc_id bigint")


def _kept(rows: DataFrame, width: int, digest: bool) -> DataFrame:
    """doc_id, n_words, n_removed and the kept words joined by spaces (or their digest)."""
    name = "kept_sha256" if digest else "kept"
    extra = [] if digest else [f for f in rows.columns if f.startswith("_")]

    def run(batches):
        for batch in batches:
            for piece in sliced(batch, "text"):
                texts, copy, lists = piece.column("text"), piece.column("copy").to_pylist(), piece.column("gone")
                split = [t.encode().split() for t in texts.to_pylist()]
                ids = piece.column("doc_id")
                gone = {i for i, x in enumerate(lists) if x.is_valid and not copy[i] and ids[i].is_valid}
                keep: dict[int, np.ndarray] = {}
                if gone:
                    windowed = Windowed(texts, width)
                    one = windowed.prints()
                    for i, a, b in windowed.rows():
                        if i in gone:
                            hit = np.isin(one[a:b], lists[i].values.to_numpy().view(U64))
                            change = np.zeros(b - a + width, np.int64)  # +1 where a removed window starts, -1 behind it
                            change[: b - a] += hit
                            change[width : width + b - a] -= hit
                            keep[i] = np.cumsum(change)[:-1] == 0
                out, removed = [], []
                for i, words in enumerate(split):
                    if copy[i] and len(words) >= width:
                        kept = []
                    elif i in keep:
                        kept = list(compress(words, keep[i].tolist()))
                    else:
                        kept = words
                    body = b" ".join(kept)
                    out.append(hashlib.sha256(body).hexdigest() if digest else body.decode() if len(kept) < len(words) else texts[i].as_py())
                    removed.append(len(words) - len(kept))
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), pa.array([len(w) for w in split], pa.int64()), pa.array(removed, pa.int64()), pa.array(out, pa.string()), *(piece.column(c) for c in extra)],
                    ["doc_id", "n_words", "n_removed", name, *extra],
                )

    more = "".join(f", {c} {rows.schema[c].dataType.simpleString()}" for c in extra)
    return rows.select("doc_id", "text", "copy", "gone", *extra).mapInArrow(run, f"doc_id bigint, n_words bigint, n_removed bigint, {name} string{more}")


def _marked(rows: DataFrame, width: int) -> DataFrame:
    """`rows` (doc_id, text, ..) with `copy` (the text is that of a smaller doc_id) and `gone` (the
    fingerprints of its removed windows)."""
    texts = rows.select("doc_id", F.md5("text").alias("key")).where("doc_id is not null")
    firsts = texts.groupBy("key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    copies = texts.join(firsts, "key").where("doc_id > first").groupBy("doc_id").agg(F.collect_set("key").alias("keys"))
    # Each exchange below is read more than once. Spark makes it once if its uses are alike, so the
    # texts meet left joins only and the keys are tested for null before, not by one of the joins.
    # Rows without doc_id meet nothing, and are dealt by their texts.
    dealt = rows.withColumn("k", F.coalesce("doc_id", F.xxhash64("text"))).repartition("k").join(copies.withColumnRenamed("doc_id", "k"), "k", "left")
    dealt = dealt.withColumn("copy", F.when(F.col("keys").isNull() | F.col("doc_id").isNull(), F.lit(False)).otherwise(F.array_contains("keys", F.md5("text")))).drop("keys")

    index = _index(dealt, width).where("m is not null and doc_id is not null").repartition("m")
    shared = index.groupBy("m").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("m")
    lists = index.join(shared.hint("shuffle_hash"), "m").groupBy(F.col("doc_id").alias("k")).agg(F.collect_list("m").alias("ms"))

    found = _candidates(dealt.join(lists, "k", "left"), width)
    found = found.where("h1 is not null and h2 is not null and doc_id is not null").repartition("h1", "h2")
    firsts = found.groupBy("h1", "h2").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("h1", "h2", "lo")
    gone = found.join(firsts.hint("shuffle_hash"), ["h1", "h2"]).where("doc_id > lo").groupBy(F.col("doc_id").alias("k")).agg(F.collect_list("h1").alias("gone"))
    return dealt.join(gone, "k", "left")


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(column(docs, "doc_id").cast("bigint").alias("doc_id"), F.coalesce(column(docs, "text"), F.lit("")).alias("text"))


def removed(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """The query's digest: doc_id, n_words, n_removed, kept_sha256 of every row."""
    return _kept(_marked(_rows(docs), width), width, digest=True)


def cut_documents(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """`docs` with the repeated passages cut out of `text` (a text that loses nothing stays as it
    is, null too) and without the rows that lose all their words; the other columns are kept."""
    names = docs.columns
    at = {n: i for i, n in enumerate(names)}
    rest = [column(docs, n).alias(f"_{i}") for i, n in enumerate(names)]
    rows = docs.select(column(docs, "doc_id").cast("bigint").alias("doc_id"), F.coalesce(column(docs, "text"), F.lit("")).alias("text"), *[c for n, c in zip(names, rest) if n != "text"], column(docs, "text").isNull().alias("_null"))
    out = _kept(_marked(rows, width), width, digest=False).where("n_words = 0 or n_removed < n_words")
    text = F.when(F.col("_null"), F.lit(None)).otherwise(F.col("kept"))
    return out.select(*[(text if n == "text" else F.col(f"_{at[n]}")).alias(n) for n in names])


ORACLE_SQL = r"""
WITH w AS (
  SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
), pos AS (
  SELECT rid, doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM w WHERE len(words) >= 13
), win AS (
  SELECT rid, doc_id, i, words[i:i+12] AS g FROM pos
), hit AS (
  SELECT rid, i FROM (SELECT rid, i, doc_id, min(doc_id) OVER (PARTITION BY g) AS lo FROM win) WHERE doc_id > lo
), gone AS (
  SELECT DISTINCT rid, i + k AS j FROM hit, (SELECT unnest(range(0, 13)) AS k)
), lists AS (
  SELECT rid, list(j) AS js FROM gone GROUP BY rid
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(len(js), 0) AS BIGINT) AS n_removed,
       sha256(coalesce(array_to_string(CASE WHEN js IS NULL THEN words ELSE list_filter(words, lambda x, p: NOT list_contains(js, p)) END, ' '), '')) AS kept_sha256
FROM w LEFT JOIN lists USING (rid)
"""
