"""Token counts with a SentencePiece BPE model: batches of pieces of text, lengths only.

A text is split where no merge can cross, so that the parts are encoded independently and their
lengths add up to the library's count of the whole text:

* before a space that follows another character than a space: no piece of the vocabulary holds a
  space mark after another character (checked when the model is loaded);
* before a line feed, if no piece holds one;
* in a part without such places that is still long, between two characters that stand side by
  side in no piece.

Words repeat, so a worker keeps the lengths of the parts it has met, in a table of bounded size;
the parts that are new in a batch are encoded together. Batches are cut by bytes, so a task
holds a bounded amount of text (one text at least), and only (doc_id, n_bytes, n_tokens) leave it.

Defined results: null text counts as empty (0 bytes, 0 tokens); repeated rows each get their row;
an empty table gives no rows; only doc_id and text are read, other columns may have any name.
Special strings in a text are ordinary text, as in the library. No shuffle; nothing to recover
but the task itself.
"""

from __future__ import annotations

import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickflow.llm.common import column, sliced

MARK = "▁"  # how the model writes a space
PARTS = 250_000  # lengths that a worker remembers
LONG_PART = 16_384  # characters
OVER_LIMIT = 4096

_COUNTERS: dict[str, Counter] = {}


class Counter:
    """Counts tokens of texts with one model."""

    def __init__(self, model_path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size()) if not (self.model.is_byte(i) or self.model.is_control(i) or self.model.is_unknown(i))]
        self.inside = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}  # pairs of neighbours
        plain = self.model.encode("a  b", out_type=str) == self.model.encode(f"a{MARK}{MARK}b", out_type=str) and "".join(self.model.encode(" a", out_type=str)) == MARK * 2 + "a"
        self.splits = plain and not any(pair[1] == MARK and pair[0] != MARK for pair in self.inside)
        self.lines = self.splits and not any("\n" in pair for pair in self.inside) and "\n" not in pieces
        self.mark = 1 if self.splits else 0
        self.known: dict[str, int] = {}

    def parts(self, text: str) -> list[str]:
        """Parts whose lengths add up. Of a text of single spaces they begin at spaces and line
        feeds; a part that begins with a line feed then stands without the mark that the library
        puts before a text. Of any other text they begin at spaces, each with a mark; those are
        told apart by a leading U+0000, and an empty last one stands for its mark."""
        if not self.splits or not text:
            return ["\0" + text]
        if self.lines and MARK not in text and "  " not in text and " \n" not in text and text[0] not in " \n\0" and text[-1] != " " and " \0" not in text:
            return text.replace("\n", " \n").split(" ")
        return ["\0" + part for part in re.split(f"(?<=[^ {MARK}]) ", text)]

    def _length(self, parts: list[str]) -> list[int]:
        """Tokens of each part (encoded as one batch)."""
        marked = [p[0] == "\0" for p in parts]
        bare = [p[1:] if m else p for p, m in zip(parts, marked)]
        out = []
        for part, m, ids in zip(bare, marked, self.model.encode([p if len(p) <= LONG_PART else "" for p in bare], num_threads=1)):
            if part == "":
                out.append(self.mark)
                continue
            size = self._long(part) if len(part) > LONG_PART else len(ids)
            out.append(size if m or part[0] != "\n" else size - 1)
        return out

    def _long(self, part: str) -> int:
        """A long part, cut between neighbours that no piece holds. A cut's right side is encoded
        behind a line feed, which takes the mark that the library puts first."""
        if not self.lines:
            return len(self.model.encode(part))
        total, at = 0, 0
        while at < len(part):
            to = min(len(part), at + LONG_PART)
            while to < len(part) and part[to - 1 : to + 1].replace(" ", MARK) in self.inside:
                to += 1
            chunk = part[at:to]
            if at == 0:
                total += len(self.model.encode(chunk))
            else:
                total += len(self.model.encode("\n" + chunk)) - 2
            at = to
        return total

    def count(self, texts: list[str]) -> list[int]:
        parted = [self.parts(t) for t in texts]
        new = set().union(*parted).difference(self.known)
        if len(self.known) + len(new) > PARTS:
            self.known.clear()
            new = set().union(*parted)
        new = list(new)
        self.known.update(zip(new, self._length(new)))
        known = self.known.__getitem__
        return [sum(map(known, p)) if t else 0 for t, p in zip(texts, parted)]


def counter(model_path: str) -> Counter:
    if model_path not in _COUNTERS:
        _COUNTERS[model_path] = Counter(model_path)
    return _COUNTERS[model_path]


def token_counts(docs: DataFrame, model_path: str, limit: int = OVER_LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row."""
    rows = docs.select(column(docs, "doc_id").alias("doc_id"), F.coalesce(column(docs, "text"), F.lit("")).alias("text"))

    def run(batches):
        count = counter(model_path).count
        for batch in batches:
            for piece in sliced(batch, "text"):
                texts = piece.column("text")
                n_bytes = pc.binary_length(texts).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), n_bytes, pa.array(count(texts.to_pylist()), pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint").withColumn("over_limit", F.col("n_tokens") > limit)
