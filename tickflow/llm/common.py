"""Helpers shared by the operators of this folder: column naming, written tables in the shared
folder, and vectorised word hashing over Arrow text."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickflow.session import checkpoint_dir, prepare

# Word separators of the text contracts: U+0020 and U+0009..U+000D (single bytes in UTF-8).
SEPARATORS = " \t\n\x0b\x0c\r"
SPLIT_REGEX = "[ \\t-\\r]+"

U64 = np.uint64


def quoted(name: str) -> str:
    """A column name as Spark's parser wants it, whatever characters it holds."""
    return "`" + name.replace("`", "``") + "`"


def column(df: DataFrame, name: str) -> Column:
    return df[quoted(name)]


BATCH_ROWS = "1000"  # rows of an Arrow batch: what the JVM and a Python worker hold at once
# Rows of a Parquet reader's batch. It keeps the texts of a batch in one array a column, which grows by
# doubling: at the default of 4096 rows these are tens of MB each, for which the heap grows to its limit.
READ_ROWS = "256"


def lean(spark: SparkSession) -> SparkSession:
    """The session settings of these operators: the library's, and small Arrow and Parquet batches."""
    prepare(spark)
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", READ_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write `df` as Parquet under the shared folder named by
    ``spark.checkpoint.dir`` and read it back (survives the loss of any executor)."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def words_of(text: Column) -> Column:
    """Array of the words ``[^\\x20\\x09-\\x0D]+`` of a text; null and blank texts give []."""
    body = F.trim(F.coalesce(text, F.lit("")), F.lit(SEPARATORS))
    return F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, SPLIT_REGEX))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ---------------------------------------------------------------- word hashing in Arrow batches

_IS_SEP = np.zeros(256, bool)
_IS_SEP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LEN_MASK = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], U64)
_LONG = 64  # bytes of a word hashed in numpy; longer words are hashed one by one


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (bijective)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Words:
    """The words of a batch of texts: byte ranges in one buffer and, per text, the range of words."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        texts = texts.cast(pa.large_binary())
        n = len(texts)
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
        if texts.null_count:
            valid = np.asarray(texts.is_valid())
            sizes = np.where(valid, np.diff(offsets), 0)
            chunks = [texts[i].as_buffer() for i in range(n) if valid[i]]
            data = np.frombuffer(b"".join(bytes(c) for c in chunks), np.uint8)
            offsets = np.concatenate([[0], np.cumsum(sizes)])
        else:
            raw = texts.buffers()[2]
            data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
            offsets = offsets - offsets[0]
        self.n_texts = n
        self.lower = lower
        self.data = _LOWER[data] if lower else data
        self.original = data
        inside = ~_IS_SEP[data]
        before = np.empty(len(inside), bool)
        before[:1] = False
        before[1:] = inside[:-1]
        first = offsets[:-1]
        before[first[first < len(inside)]] = False  # a text begins anew
        self.starts = np.flatnonzero(inside & ~before)
        after = np.empty(len(inside), bool)
        after[-1:] = False
        after[:-1] = inside[1:]
        last = offsets[1:] - 1
        after[last[last >= 0]] = False
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.bounds = np.searchsorted(self.starts, offsets)  # words of text i: bounds[i]..bounds[i+1]

    def hashes(self, seed: int = 0) -> np.ndarray:
        """64-bit hash of every word (of its bytes; lower-cased when asked for)."""
        starts, size = self.starts, self.ends - self.starts
        out = np.full(len(starts), U64(0x9E3779B97F4A7C15 ^ seed), U64) + size.astype(U64)
        if not len(starts):
            return out
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        view = np.lib.stride_tricks.sliding_window_view(padded, 8)
        todo = np.arange(len(starts))
        for at in range(0, _LONG, 8):
            todo = todo[size[todo] > at]
            if not len(todo):
                break
            piece = np.ascontiguousarray(view[starts[todo] + at]).view(U64).ravel()
            piece = piece & _LEN_MASK[np.minimum(size[todo] - at, 8)]
            out[todo] = mix((out[todo] ^ piece) * U64(0xD6E8FEB86659FD93) + U64(at + 1))
        for i in np.flatnonzero(size > _LONG):
            import xxhash

            out[i] = U64(xxhash.xxh3_64_intdigest(self.data[starts[i] : self.ends[i]].tobytes(), seed=seed))
        return out


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k consecutive word hashes (by doubling; len(h) - k + 1 values)."""
    if len(h) < k:
        return np.zeros(0, U64)
    out, done, power, width = None, 0, h, 1
    while True:
        if k & width:
            if out is None:
                out, done = power, width
            else:
                m = len(h) - done - width + 1
                out = _join(out[:m], power[done : done + m], done * 131 + width)
                done += width
        if done == k:
            return out if k > 1 else mix(out)
        m = len(h) - 2 * width + 1
        power = _join(power[:m], power[width : width + m], width)
        width *= 2


def _join(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    return mix(a * U64(0x9FB21C651E98DF25) + (b ^ (b >> U64(32))) * U64(0xC2B2AE3D27D4EB4F) + U64(salt))


def sliced(batch: pa.RecordBatch, name: str, limit: int = 1_000_000):
    """Cut a batch into runs of rows whose texts hold about `limit` bytes together (a longer
    text stands alone), so that what a task holds at once is bounded by bytes, not rows."""
    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(name)), 0)).astype(np.int64)
    ends = np.cumsum(size)
    at = 0
    while at < len(size):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield batch.slice(at, to - at)
        at = to


def as_long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def list_of_long(values: np.ndarray, sizes) -> pa.Array:
    """An Arrow array of lists over one flat array."""
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), as_long(values))
