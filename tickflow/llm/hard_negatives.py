"""Hard-negative mining by angular triangle filtering.

Anchors are a stated set of rows (every vec_id divisible by EVERY), searched against all rows. A row's
components are whole numbers, floor(SCALE * x); its score is the inner product with the anchor's. An
anchor's positives are the POSITIVES best other rows of its label; for each positive the NEGATIVES
best rows of other labels whose score lies between 50 % and 95 % of the positive's are returned.

1. *Stored angles.* Every row keeps its angles to REFERENCES directions (k-means of a bounded
   sample) and its norm. Rows are written by nearest direction and angle to it, range-partitioned
   with vec_id as the last key, so that copies of one vector are split like all others. An Arrow
   batch of the written table is a window: rows that lie close to each other.
2. *Bounds.* For an anchor at angle s to a direction and a window whose angles to it span [lo, hi],
   the angle between them is at least the distance of s to [lo, hi] and at most the largest
   min(s + t, 2 pi - s - t) in it. All directions together give a cosine interval; times the norms,
   widened by SLACK for rounding, it bounds every score of the window.
3. *Scores.* A window is scored only against anchors whose wanted scores overlap the bounds: for
   positives those from the fifth best so far on, for negatives the spans of the positives, above
   the third best so far. Scores are exact (products of doubles below 2^53, else of 64-bit numbers).
4. A task keeps what its windows have best; the tasks' lists are ranked per anchor.

Anchors go out in rounds of at most ROUND (their vectors are what a round broadcasts); each round
is written, so a lost executor costs its own tasks only. No pair of rows is shuffled.

Defined results: rows with a null vec_id, label or vector, or with a null or non-finite component,
take no part; a shorter vector is filled up with zeros (an empty one scores 0 everywhere); components
beyond +-2^27 count as that; equal scores go to the smaller vec_id; rows repeated as a whole count
once, rows that share a vec_id only are rows of their own but never each other's positives; an anchor
without positives, or a positive without negatives, gives no row; an empty table gives none. Other
columns aren't read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickflow.llm.common import column, written
from tickflow.session import checkpoint_dir

EVERY, SCALE = 50, 256
POSITIVES, NEGATIVES = 5, 3
LOW, HIGH = 50, 95  # per cent of the positive's score
REFERENCES, SAMPLE = 16, 2048  # directions, rows that they are fitted to
ROUND = 1 << 16  # anchors sent out at once
LARGEST = 1 << 27
SLACK = 2e-6  # of an angle: the stored ones have single precision
SCHEMA = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"


def whole(vectors: DataFrame) -> DataFrame:
    """vec_id, label, v (whole numbers) of the rows that take part."""
    rows = vectors.select(column(vectors, "vec_id").cast("bigint").alias("vec_id"), column(vectors, "label").alias("label"), column(vectors, "embedding").alias("e"))
    # null if a component is null, NaN where one isn't finite
    fine = F.expr("vec_id IS NOT NULL AND label IS NOT NULL AND e IS NOT NULL AND forall(e, x -> x IS NOT NULL AND NOT isnan(x) AND abs(CAST(x AS DOUBLE)) < double('Infinity'))")
    v = F.expr(f"transform(e, x -> CAST(greatest(least(floor(greatest(least(CAST(x AS DOUBLE) * {SCALE}, 1e15D), -1e15D)), {LARGEST}L), -{LARGEST}L) AS INT))")
    return rows.where(fine).select("vec_id", "label", v.alias("v"))


def _matrix(lists: pa.Array, dim: int, kind) -> np.ndarray:
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(kind)
    if (sizes == dim).all():
        return flat.reshape(len(sizes), dim)
    out = np.zeros((len(sizes), dim), kind)
    out[np.arange(dim)[None, :] < sizes[:, None]] = flat
    return out


def _unit(m: np.ndarray) -> np.ndarray:
    m = m.astype(np.float64)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def _directions(sample: np.ndarray, count: int) -> np.ndarray:
    """Directions near the sample's rows: farthest first, then a few rounds of k-means."""
    unit = _unit(sample[(sample != 0).any(axis=1)])
    if not len(unit):
        return np.eye(1, sample.shape[1])
    chosen, best = [0], unit @ unit[0]
    while len(chosen) < min(count, len(unit)):
        chosen.append(int(best.argmin()))
        best = np.maximum(best, unit @ unit[chosen[-1]])
    centre = unit[chosen]
    for _ in range(8):
        own = (unit @ centre.T).argmax(axis=1)
        sums = np.zeros_like(centre)
        np.add.at(sums, own, unit)
        some = np.linalg.norm(sums, axis=1) > 1e-9
        centre = np.where(some[:, None], _unit(sums), centre)
    return centre


def _angles(m: np.ndarray, directions: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(_unit(m) @ directions.T, -1, 1))


class Anchors:
    """The anchors of a round, and the bounds of windows against them."""

    def __init__(self, ids, labels, vectors: np.ndarray, directions: np.ndarray):
        self.ids, self.labels, self.v = ids, labels, vectors.astype(np.float64)
        self.norm = np.linalg.norm(self.v, axis=1)
        self.angle = _angles(vectors, directions)
        self.zero = self.norm == 0

    def bounds(self, angle: np.ndarray, norm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest score of each anchor with any row of a window."""
        lo, hi = angle.min(axis=0) - SLACK, angle.max(axis=0) + SLACK
        s = self.angle
        least = np.maximum(np.maximum(lo - s, s - hi), 0).max(axis=1)
        most = np.where(s + hi <= np.pi, s + hi, np.where(s + lo >= np.pi, 2 * np.pi - s - lo, np.pi)).min(axis=1)
        up, down = np.cos(np.clip(least, 0, np.pi)), np.cos(np.clip(most, 0, np.pi))
        small, big = norm.min(), norm.max()
        top = self.norm * np.where(up > 0, big, small) * up
        low = self.norm * np.where(down > 0, small, big) * down
        slack = 1 + 1e-9 * self.norm * big  # of the products
        return np.floor(low - slack), np.ceil(top + slack)

    def scores(self, chosen: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Exact scores of chosen anchors (first axis) with a window's rows."""
        a = self.v[chosen]
        if not len(a) or not rows.size or np.abs(a).max() * float(np.abs(rows).max()) * a.shape[1] < 2.0**53:
            return (a @ rows.T.astype(np.float64)).astype(np.int64)
        return a.astype(np.int64) @ rows.T.astype(np.int64)


class Best:
    """The `count` best (score, id) of every slot: higher scores first, then smaller ids."""

    def __init__(self, slots: int, count: int):
        self.count = count
        self.slot, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))
        self.least = np.full(slots, np.iinfo(np.int64).min)  # the last score that still counts

    def add(self, slot: np.ndarray, score: np.ndarray, ident: np.ndarray) -> None:
        slot, score, ident = (np.concatenate(x) for x in ((self.slot, slot), (self.score, score), (self.id, ident)))
        order = np.lexsort((ident, -score, slot))
        slot, score, ident = slot[order], score[order], ident[order]
        new = np.ones(len(slot), bool)  # a row repeated as a whole
        new[1:] = (slot[1:] != slot[:-1]) | (score[1:] != score[:-1]) | (ident[1:] != ident[:-1])
        slot, score, ident = slot[new], score[new], ident[new]
        first = np.ones(len(slot), bool)
        first[1:] = slot[1:] != slot[:-1]
        rank = np.arange(len(slot)) - np.maximum.accumulate(np.where(first, np.arange(len(slot)), 0))
        keep = rank < self.count
        self.slot, self.score, self.id = slot[keep], score[keep], ident[keep]
        full = rank == self.count - 1
        self.least[slot[full]] = score[full]

    def batch(self, names: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.slot), pa.array(self.score), pa.array(self.id)], names)


NONE = np.iinfo(np.int64).min


def _offer(best: Best, slots: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
    """Offer a matrix of scores (NONE: not wanted) of the slots; ties at the last place stay in."""
    scores = np.where(scores >= best.least[slots][:, None], scores, NONE)
    some = (scores != NONE).any(axis=1)
    slots, scores = slots[some], scores[some]
    if not len(slots):
        return
    if scores.shape[1] > best.count:
        last = np.partition(scores, scores.shape[1] - best.count, axis=1)[:, scores.shape[1] - best.count]
        scores = np.where(scores >= last[:, None], scores, NONE)
    at, row = np.nonzero(scores != NONE)
    best.add(slots[at], scores[at, row], ids[row])


def _windows(batches: Iterator[pa.RecordBatch], dim: int, refs: int):
    """ids, labels, vectors, angles and norms of every window, rows repeated as a whole once."""
    for batch in batches:
        if batch.num_rows:
            ids, labels = (np.asarray(batch.column(c)) for c in ("vec_id", "label"))
            v, angle = _matrix(batch.column("v"), dim, np.int32), _matrix(batch.column("angles"), refs, np.float64)
            if len(np.unique(ids)) < len(ids):
                _, first = np.unique(np.column_stack([ids, labels, v]), axis=0, return_index=True)
                ids, labels, v, angle = ids[first], labels[first], v[first], angle[first]
            yield ids, labels, v, angle, np.linalg.norm(v.astype(np.float64), axis=1)


def _positives(table: DataFrame, anchors: Anchors, dim: int, refs: int) -> DataFrame:
    """(a, score, id): the best rows of the anchor's label in every task's windows."""

    def run(batches):
        best = Best(len(anchors.ids), POSITIVES)
        for ids, labels, v, angle, norm in _windows(batches, dim, refs):
            _, top = anchors.bounds(angle, norm)
            chosen = np.flatnonzero(np.isin(anchors.labels, labels) & (top >= best.least))
            s = anchors.scores(chosen, v)
            other = (anchors.labels[chosen][:, None] != labels) | (anchors.ids[chosen][:, None] == ids)
            _offer(best, chosen, np.where(other, NONE, s), ids)
        yield best.batch(["a", "score", "id"])

    return table.mapInArrow(run, "a bigint, score bigint, id bigint")


def _negatives(table: DataFrame, anchors: Anchors, owner: np.ndarray, positive: np.ndarray, dim: int, refs: int) -> DataFrame:
    """(p, score, id): for every positive p (of anchor owner[p]) the best rows of other labels inside
    its span of scores, in every task's windows."""
    low, high = -((-positive * LOW) // 100), (positive * HIGH) // 100
    first = np.searchsorted(owner, np.arange(len(anchors.ids)))
    count = np.searchsorted(owner, np.arange(len(anchors.ids)), "right") - first
    most = int(count.max()) if len(count) else 0

    def run(batches):
        best = Best(len(owner), NEGATIVES)
        for ids, labels, v, angle, norm in _windows(batches, dim, refs):
            down, top = anchors.bounds(angle, norm)
            wanted = (low <= high) & (high >= down[owner]) & (np.maximum(low, best.least) <= top[owner])
            chosen = np.unique(owner[wanted])
            s = anchors.scores(chosen, v)
            s = np.where(anchors.labels[chosen][:, None] == labels, NONE, s)
            for k in range(most):
                has = np.flatnonzero(count[chosen] > k)
                p = first[chosen[has]] + k
                has, p = has[wanted[p]], p[wanted[p]]
                part = s[has]
                _offer(best, p, np.where((part >= low[p][:, None]) & (part <= high[p][:, None]), part, NONE), ids)
        yield best.batch(["p", "score", "id"])

    return table.mapInArrow(run, "p bigint, score bigint, id bigint")


def _ranked(found: DataFrame, key: str, count: int) -> DataFrame:
    """The `count` best of each key over all tasks, with their rank."""
    order = Window.partitionBy(key).orderBy(F.col("score").desc(), F.col("id"))
    return found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count)


def stored(spark: SparkSession, rows: DataFrame, dim: int) -> tuple[DataFrame, np.ndarray]:
    """The written table of windows (vec_id, label, v, angles) and the directions."""
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").select("v").limit(SAMPLE).toArrow()
    directions = _directions(_matrix(sample.column("v"), dim, np.int64), REFERENCES)

    def run(batches):
        for batch in batches:
            angle = _angles(_matrix(batch.column("v"), dim, np.int32), directions)
            near = angle.argmin(axis=1)
            own = angle[np.arange(len(angle)), near]
            offsets = np.arange(0, angle.size + 1, max(angle.shape[1], 1), dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(angle.astype(np.float32).ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists, pa.array(near.astype(np.int32)), pa.array(own.astype(np.float32))], [*batch.schema.names, "angles", "near", "own"])

    out = rows.mapInArrow(run, f"vec_id bigint, label {rows.schema['label'].dataType.simpleString()}, v array<int>, angles array<float>, near int, own float")
    out = out.repartitionByRange("near", "own", "vec_id").sortWithinPartitions("near", "own", "vec_id")
    return written(spark, out.select("vec_id", "label", "v", "angles"), "windows"), directions


def mined(spark: SparkSession, vectors: DataFrame, every: int = EVERY, round_: int = ROUND) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of every anchor,
    positive and hard negative."""
    rows = whole(vectors)
    facts = rows.agg(F.max(F.size("v")).alias("dim"), F.count_if(F.col("vec_id") % every == 0).alias("n")).first()
    if not facts["n"]:
        return spark.createDataFrame([], SCHEMA)
    dim, rounds = max(facts["dim"], 1), -(-facts["n"] // round_)
    table, directions = stored(spark, rows, dim)
    folder = f"{checkpoint_dir(spark).rstrip('/')}/llm-negatives-{uuid.uuid4().hex}"
    for r in range(rounds):
        chosen = table.where((F.col("vec_id") % every == 0) & (F.pmod(F.xxhash64("vec_id"), F.lit(rounds)) == r)).select("vec_id", "label", "v").distinct()
        part = chosen.orderBy("vec_id", "label", "v").toArrow()  # about `round_` rows
        anchors = Anchors(np.asarray(part.column("vec_id")), np.asarray(part.column("label")), _matrix(part.column("v"), dim, np.int64), directions)
        top = _ranked(_positives(table, anchors, dim, len(directions)), "a", POSITIVES).orderBy("a", "rank").toArrow()  # POSITIVES an anchor
        owner, score, ident = (np.asarray(top.column(c)) for c in ("a", "score", "id"))
        found = _ranked(_negatives(table, anchors, owner, score, dim, len(directions)), "p", NEGATIVES)
        _named(found, anchors.ids[owner], score, ident).write.parquet(f"{folder}/{r}")
    return spark.read.schema(SCHEMA).parquet(*[f"{folder}/{r}" for r in range(rounds)])


def _named(found: DataFrame, anchor: np.ndarray, score: np.ndarray, ident: np.ndarray) -> DataFrame:
    """Slots of a round put back into anchors and positives."""

    def run(batches):
        for b in batches:
            p = np.asarray(b.column("p")).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(anchor[p]), pa.array(ident[p]), b.column("rank"), b.column("id"), pa.array(score[p]), b.column("score")], [f.split()[0] for f in SCHEMA.split(", ")])

    return found.select("p", "rank", "id", "score").mapInArrow(run, SCHEMA)


def relabelled(vectors: DataFrame) -> DataFrame:
    """The query's input: where vec_id is divisible by 7, label becomes (label + 1) % 10."""
    label = column(vectors, "label")
    return vectors.select(
        column(vectors, "vec_id").alias("vec_id"),
        F.when(column(vectors, "vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"),
        column(vectors, "embedding").alias("embedding"),
    )


ORACLE_SQL = """
WITH w AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, CAST(list_inner_product(CAST(a.v AS DOUBLE[]), CAST(b.v AS DOUBLE[])) AS BIGINT) AS score
  FROM w a, w b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 3
"""
