"""Byte-level BPE by prefix dynamic programming.

For every prefix of a byte string the encoding ends in one token, and dropping that token leaves
the encoding of a shorter prefix. So it is enough to store, per prefix, its last token: token t
ends the prefix of length i if the prefix before it ends in a token l such that the pair (l, t)
survives, that is, BPE of the two tokens' bytes gives l and t again. Exactly one t does. Appending
bytes therefore computes the new prefixes only, and an edit computes prefixes from its start until
the stored tokens agree with the old ones again over the length of the longest token.

Whether a pair survives is read off the merge trees: a boundary is crossed if some token on the
right edge of l and some token on the left edge of t, standing side by side at the same time (a
token exists from its own rank until its parent's), form a token of a rank within that time.

A text is first cut by the tokenizer's pattern, each match encoded separately. A worker keeps the
ids of the runs it has met in a table of bounded size (words repeat).

Defined results: null text is empty (0 tokens, checksums of nothing); repeated rows each get a
row; an empty table gives no rows; only doc_id and text are read. Batches are cut by bytes; there
is no shuffle and nothing to recover but the task.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickflow.llm.common import column, sliced

RUNS = 1_200_000  # runs that a worker remembers (about 200 bytes each)
PAIRS = 250_000  # pairs of tokens that a worker remembers
LONG_RUN = 256  # characters of a run that is worth remembering
# White_Space of Unicode, as the pattern's \s means it
SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"

DECODE = 1 << 18  # ids that are decoded at once

_CODERS: dict[tuple[str, str, int], Coder] = {}


class Ranks:
    """A vocabulary of byte strings by rank, with the merge tree of each token on demand."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {r: b for b, r in ranks.items()}
        self.longest = max(map(len, ranks))
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._right: dict[int, list[tuple[int, int]]] = {}
        self._left: dict[int, list[tuple[int, int]]] = {}
        self.known: dict[tuple[int, int], bool] = {}
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for data, rank in ranks.items():
            automaton.add_word(data.decode("latin-1"), (len(data), rank))
        automaton.make_automaton()
        self.endings = automaton.iter

    @classmethod
    def load(cls, path: str) -> Ranks:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())})

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a single byte."""
        if token not in self._halves:
            parts = [bytes([b]) for b in self.tokens[token]]
            while len(parts) > 2:  # merge by lower ranks until two parts are left
                pairs = [(self.ranks.get(a + b, token), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
                rank, i = min(pairs)
                if rank >= token:
                    break
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            self._halves[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return self._halves[token]

    def _edge(self, token: int, side: int) -> list[tuple[int, int, int]]:
        """Tokens on one edge of the merge tree: (token, exists from, exists until)."""
        store = self._right if side else self._left
        if token not in store:
            out, until, at = [], 1 << 60, token
            while at is not None:
                halves = self.halves(at)
                out.append((at, at if halves else -1, until))
                until, at = at, halves[side] if halves else None
            store[token] = out
        return store[token]

    def survives(self, left: int, right: int) -> bool:
        """Whether no merge crosses the boundary between two neighbouring tokens."""
        key = (left, right)
        known = self.known.get(key)
        if known is None:
            known = True
            for a, a_from, a_until in self._edge(left, 1):
                for b, b_from, b_until in self._edge(right, 0):
                    if max(a_from, b_from) < min(a_until, b_until):
                        rank = self.ranks.get(self.tokens[a] + self.tokens[b])
                        # of two equal merges the left one comes first, so a's parent wins a tie
                        if rank is not None and rank < a_until and rank <= b_until:
                            known = False
            if len(self.known) >= PAIRS:
                self.known.clear()
            self.known[key] = known
        return known


class PrefixTable:
    """The last token of every prefix of one byte string."""

    def __init__(self, ranks: Ranks, data: bytes = b""):
        self.ranks, self.data, self.last = ranks, b"", [-1]
        self.append(data)

    def append(self, more: bytes) -> None:
        start, self.data = len(self.data), self.data + more
        self._extend(start + 1, len(self.data) + 1)

    def _extend(self, start: int, end: int) -> None:
        """The last tokens of the prefixes of length start to end - 1. The automaton gives the
        tokens that end at each place, the longest first."""
        data, last, known, survives = self.data, self.last, self.ranks.known.get, self.ranks.survives
        have, begin = start - 1, max(0, start - self.ranks.longest)  # prefixes up to `have` are done
        for at, (size, token) in self.ranks.endings(data[begin : end - 1].decode("latin-1")):
            i = begin + at + 1
            if i <= have:
                continue
            if i > have + 1:
                break
            if size < i:
                pair = (last[i - size], token)
                alive = known(pair)
                if not alive and (alive is not None or not survives(*pair)):
                    continue
            last.append(token)
            have = i
        if have + 1 < end:
            raise ValueError("a byte of the text isn't in the vocabulary")

    def replace(self, start: int, end: int, new: bytes) -> int:
        """Replace data[start:end]; returns how many prefixes were computed anew."""
        old, shift = self.last, len(new) - (end - start)
        self.data = self.data[:start] + new + self.data[end:]
        self.last, agree, done = old[: start + 1], 0, 0
        for i in range(start + 1, len(self.data) + 1):
            self._extend(i, i + 1)
            done += 1
            # prefixes beyond the edit depend on `longest` earlier ones and their bytes only
            agree = agree + 1 if i - len(new) > start and old[i - shift] == self.last[i] else 0
            if agree >= self.ranks.longest and i - start - len(new) >= self.ranks.longest:
                self.last.extend(old[i - shift + 1 :])
                break
        return done

    def become(self, data: bytes) -> None:
        """Turn into the table of other bytes, keeping the prefixes that both have."""
        old, n = self.data, min(len(self.data), len(data))
        if old[:n] != data[:n]:
            n = next(i for i in range(n) if old[i] != data[i])
        del self.last[n + 1 :]
        self.data = data
        self._extend(n + 1, len(data) + 1)

    def ids(self) -> list[int]:
        out, i = [], len(self.data)
        while i:
            out.append(self.last[i])
            i -= len(self.ranks.tokens[self.last[i]])
        return out[::-1]


class Coder(dict):
    """Encodes texts with a pattern and ranks; itself the table of known runs (run -> packed ids)."""

    def __init__(self, ranks: Ranks, pattern: str, remembered: int = RUNS):
        import regex

        super().__init__()
        self.ranks, self.remembered = ranks, remembered
        # regex's own \s holds U+001C..U+001F too, which White_Space doesn't
        inner = pattern.replace("[^\\s", "[^" + SPACE).replace("\\S", f"[^{SPACE}]").replace("\\s", f"[{SPACE}]")
        self.match = regex.compile(inner).findall
        # runs that the pattern never crosses: a space and what follows it, or white space alone
        self.runs = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+").findall
        # a run of letters only is one piece: U+00C0 to U+024F are letters but for two signs
        self.plain = re.compile(" ?[A-Za-zÀ-ÖØ-öø-ɏ]+").fullmatch if "| ?\\p{L}+|" in pattern and pattern.startswith("'s|") else lambda run: False
        # the vocabulary as one buffer: where each token starts in it, and its size
        tokens, ids = self.ranks.tokens, np.array(sorted(self.ranks.tokens))
        self.sizes, self.starts = (np.zeros(ids[-1] + 1, np.int64) for _ in range(2))
        self.sizes[ids] = [len(tokens[i]) for i in ids.tolist()]
        self.starts[ids] = np.cumsum(self.sizes[ids]) - self.sizes[ids]
        self.buffer = np.frombuffer(b"".join([tokens[i] for i in ids.tolist()]), np.uint8)
        self.older: dict[str, bytes] = {}

    def __missing__(self, run: str) -> bytes:
        """A run that isn't remembered (a long one, or one of a table just emptied)."""
        return b"".join([self._packed(PrefixTable(self.ranks, piece.encode())) for piece in self.match(run)])

    def _packed(self, table: PrefixTable) -> bytes:
        ids = table.ids()
        return struct.pack(f"<{len(ids)}I", *ids)

    def learn(self, runs: set[str]) -> None:
        """Encode new runs and remember them. Their distinct pieces are taken in byte order, so
        that a piece's table begins with the prefixes that it shares with the piece before."""
        if len(self) > self.remembered // 2:  # keep what the last half of them needed
            self.older = dict(self)
            self.clear()
        for run in runs & self.older.keys():
            self[run] = self.older[run]
        cut = {run: [run] if self.plain(run) else self.match(run) for run in runs if run not in self and len(run) <= LONG_RUN}
        pieces = sorted({piece.encode() for found in cut.values() for piece in found})
        table, packed, whole = PrefixTable(self.ranks), {}, self.ranks.ranks.get
        for data in pieces:
            rank = whole(data)
            if rank is not None:
                packed[data] = struct.pack("<I", rank)
            else:
                table.become(data)
                packed[data] = self._packed(table)
        for run, found in cut.items():
            self[run] = b"".join([packed[piece.encode()] for piece in found])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Of each text the ids, as little-endian unsigned 32-bit integers."""
        runs = [self.runs(text) for text in texts]
        self.learn(set().union(*runs).difference(self))
        ids_of = self.__getitem__
        return [b"".join(map(ids_of, found)) for found in runs]

    def decode(self, packed: list[bytes]) -> list[bytes]:
        """Of each text's ids the bytes: one gather from the vocabulary's buffer for all of them."""
        ids = np.frombuffer(b"".join(packed), "<u4")
        parts = []
        for at in range(0, len(ids), DECODE):
            some = ids[at : at + DECODE]
            size = self.sizes[some]
            first = self.starts[some] - (np.cumsum(size) - size)  # minus the place in the output
            parts.append(self.buffer[np.repeat(first, size) + np.arange(size.sum())].tobytes())
        whole, out, at, end = b"".join(parts), [], 0, 0
        sums = np.concatenate([[0], np.cumsum(self.sizes[ids])])
        for p in packed:
            start, at = end, at + len(p) // 4
            end = int(sums[at])
            out.append(whole[start:end])
        return out


def coder(ranks_path: str, pattern: str, remembered: int = RUNS) -> Coder:
    key = (ranks_path, pattern, remembered)
    if key not in _CODERS:
        _CODERS[key] = Coder(Ranks.load(ranks_path), pattern, remembered)
    return _CODERS[key]


def encoded(docs: DataFrame, ranks_path: str, pattern: str, remembered: int = RUNS) -> DataFrame:
    """doc_id, n_tokens, ids (array of int), decoded_sha256 of every row. `remembered` bounds the
    runs that a worker keeps."""

    def columns(packed: list[bytes], decoded: list[bytes]):
        sizes = [len(p) // 4 for p in packed]
        flat = pa.array(np.frombuffer(b"".join(packed), "<i4"))
        ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), flat)
        return [pa.array(sizes, pa.int64()), ids, _sha256(decoded)]

    return _mapped(docs, ranks_path, pattern, remembered, "n_tokens bigint, ids array<int>, decoded_sha256 string", columns)


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, remembered: int = RUNS) -> DataFrame:
    """The query's digest: doc_id, n_tokens, ids_sha256, decoded_sha256 of every row."""

    def columns(packed: list[bytes], decoded: list[bytes]):
        return [pa.array([len(p) // 4 for p in packed], pa.int64()), _sha256(packed), _sha256(decoded)]

    return _mapped(docs, ranks_path, pattern, remembered, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", columns)


def _sha256(values: list[bytes]) -> pa.Array:
    return pa.array([hashlib.sha256(v).hexdigest() for v in values], pa.string())


def _mapped(docs: DataFrame, ranks_path: str, pattern: str, remembered: int, fields: str, columns) -> DataFrame:
    rows = docs.select(column(docs, "doc_id").alias("doc_id"), F.coalesce(column(docs, "text"), F.lit("")).alias("text"))
    names = [f.split()[0] for f in fields.split(", ")]

    def run(batches):
        code = coder(ranks_path, pattern, remembered)
        for batch in batches:
            for piece in sliced(batch, "text"):
                packed = code.encode(piece.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), *columns(packed, code.decode(packed))], ["doc_id", *names])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {fields}")
