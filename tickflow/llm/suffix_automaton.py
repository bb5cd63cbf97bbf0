"""Suffix automata of reference shards: passages of documents that occur in a bounded set of
reference texts.

The references (a benchmark, a block list of passages) are cut into shards of at most
`shard_words` words; each shard's automaton is built once in a task and broadcast, and the documents
are streamed past all of them. At each word an automaton gives the longest suffix of the text so
far that a reference holds (the matching statistics); the words of all matches of at least `least`
words form the spans.

The references must be bounded: more than MAX_WORDS words raise ValueError, as nothing that grows
with the corpus may be broadcast. `substring_dedup`, whose references are all documents, can't
use it for that reason (README).

Defined results: null or wordless texts have no spans; repeated rows each have theirs; empty
tables on either side give no spans; only doc_id and text are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickflow.llm.common import Words, column, sliced

MAX_WORDS = 2_000_000
SHARD_WORDS = 250_000


class SuffixAutomaton:
    """Of one sequence of words (their hashes); texts are kept apart by separators of their own."""

    def __init__(self, sequence):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]
        last = 0
        for word in sequence:
            new = len(self.next)
            self.next.append({})
            self.length.append(self.length[last] + 1)
            self.link.append(0)
            at = last
            while at >= 0 and word not in self.next[at]:
                self.next[at][word] = new
                at = self.link[at]
            if at >= 0:
                to = self.next[at][word]
                if self.length[to] == self.length[at] + 1:
                    self.link[new] = to
                else:  # split: the shorter suffixes of `to` get a state of their own
                    copy = len(self.next)
                    self.next.append(dict(self.next[to]))
                    self.length.append(self.length[at] + 1)
                    self.link.append(self.link[to])
                    while at >= 0 and self.next[at].get(word) == to:
                        self.next[at][word] = copy
                        at = self.link[at]
                    self.link[to] = self.link[new] = copy
            last = new

    def matches(self, sequence) -> list[int]:
        """Per word the length of the longest match that ends there."""
        out, state, size = [], 0, 0
        for word in sequence:
            while state and word not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if word in self.next[state]:
                state, size = self.next[state][word], size + 1
            out.append(size)
        return out


def _shards(references: DataFrame, shard_words: int) -> list[list[int]]:
    """Word hashes of the references in shards, a separator behind each text."""
    texts = [r["text"] for r in references.select(column(references, "text").alias("text")).where("text is not null").limit(MAX_WORDS + 1).collect()]
    words = Words(pa.array(texts, pa.large_string()))
    h, bounds = words.hashes().tolist(), words.bounds.tolist()
    if len(h) > MAX_WORDS or len(texts) > MAX_WORDS:
        raise ValueError(f"the references have more than {MAX_WORDS} words")
    shards: list[list[int]] = []
    for i, (a, b) in enumerate(zip(bounds, bounds[1:])):
        if not shards or len(shards[-1]) + b - a > shard_words:
            shards.append([])
        shards[-1] += [*h[a:b], -1 - i]
    return shards


def matched_spans(docs: DataFrame, references: DataFrame, least: int = 13, shard_words: int = SHARD_WORDS) -> DataFrame:
    """doc_id, first_word, n_words of every maximal run of words covered by matches."""
    spark = docs.sparkSession
    automata = [spark.sparkContext.broadcast(SuffixAutomaton(s)) for s in _shards(references, shard_words)]
    rows = docs.select(column(docs, "doc_id").alias("doc_id"), F.coalesce(column(docs, "text"), F.lit("")).alias("text"))

    def run(batches):
        for batch in batches:
            for piece in sliced(batch, "text"):
                words = Words(piece.column("text"))
                h, bounds = words.hashes(), words.bounds
                owner, first, size = [], [], []
                for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
                    sequence = h[a:b].tolist()
                    change = np.zeros(len(sequence) + 1, np.int64)
                    for automaton in automata:
                        found = np.array(automaton.value.matches(sequence), np.int64)
                        ends = np.flatnonzero(found >= least)
                        np.add.at(change, ends - found[ends] + 1, 1)
                        np.add.at(change, ends + 1, -1)
                    inside = np.concatenate([[0], np.cumsum(change)[:-1] > 0, [0]]).astype(np.int8)
                    edges = np.flatnonzero(np.diff(inside))
                    owner += [i] * (len(edges) // 2)
                    first += edges[::2].tolist()
                    size += (edges[1::2] - edges[::2]).tolist()
                yield pa.RecordBatch.from_arrays([piece.column("doc_id").take(pa.array(owner, pa.int64())), pa.array(first, pa.int64()), pa.array(size, pa.int64())], ["doc_id", "first_word", "n_words"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, first_word bigint, n_words bigint")
