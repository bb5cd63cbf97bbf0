"""Language identification by a linear-chain conditional random field over words.

Every word of a text gets a label; neighbouring labels are tied by learned transitions, so a text
that switches languages is labelled run by run. A word's features are its byte trigrams (with its
borders), its prefixes and suffixes of one to three bytes, and its entry in a lexicon of the
training words; the weights of all of them and of the transitions are learned together by
maximum likelihood (gradients by forward-backward). A document's language is the one with the
largest share of the words' posterior, and that share is its score.

Forward-backward runs on a whole batch as one chain that starts anew at each text. The chain is
cut into blocks: the blocks' transfer matrices are multiplied side by side, carried from block to
block, and the words inside all blocks are then done side by side: exact, for texts of any length.

Training takes a bounded sample on the driver: PER_LABEL texts of each label (those of smallest
hash), of at most TRAIN_CHARS characters. Everything else runs on the executors, batch by batch;
the model (a few MB) goes with the function.

Defined results: null texts and texts without a letter are `und` with score 0; ties go to the
label that sorts first; repeated rows get equal results; with no labelled row to learn from every
text is `und`; empty tables give no rows. Only doc_id, text and, to learn, lang are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickflow.llm.common import Words, column, sliced

UNKNOWN = "und"
PER_LABEL, TRAIN_CHARS = 100, 8000
ROUNDS, RATE, DECAY = 24, 0.25, 1e-4
BUCKETS = 1 << 16  # of each of the hashed feature kinds
LEXICON = 1 << 15


def _fold(data: np.ndarray) -> np.ndarray:
    """Lower case of A-Z and of the two-byte letters U+00C0..U+00DE."""
    out = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    if len(data) > 1:
        wide = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:][wide] += 32
    return out


def _bucket(x: np.ndarray, kind: int) -> np.ndarray:
    return ((x.astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int32) + kind * BUCKETS


class Features:
    """Feature numbers of the words of a batch: `grams` per byte position (trigrams centred there),
    `affixes` six per word, and the words' hashes for the lexicon."""

    def __init__(self, texts: pa.Array):
        self.words = words = Words(texts)
        data = _fold(words.data)
        words.data = data
        padded = np.zeros(len(data) + 6, np.uint32)
        padded[3 : 3 + len(data)] = data
        inside = np.zeros(len(data) + 6, bool)
        first, end = words.starts, words.ends
        self.size = end - first
        # positions of all words' bytes, one word after another
        self.at = np.arange(self.size.sum()) + np.repeat(first - (np.cumsum(self.size) - self.size), self.size)
        inside[self.at + 3] = True
        padded[~inside] = 0
        starts_here = np.zeros(len(data) + 7, bool)
        starts_here[first + 3] = True
        p = self.at + 3
        before = np.where(starts_here[p], 0, padded[p - 1])  # words of two texts may touch
        after = np.where(starts_here[p + 1], 0, padded[p + 1])
        self.grams = _bucket((before << 16) | (padded[p] << 8) | after, 0)
        self.offsets = np.cumsum(self.size) - self.size
        b = [np.where(self.size > i, padded[first + 3 + np.minimum(i, self.size - 1)], 0) for i in range(3)]
        e = [np.where(self.size > i, padded[end + 2 - np.minimum(i, self.size - 1)], 0) for i in range(3)]
        self.affixes = np.stack(
            [_bucket(b[0], 1), _bucket(b[0] | b[1] << 8, 2), _bucket(b[0] | b[1] << 8 | b[2] << 16, 3), _bucket(e[0], 4), _bucket(e[0] | e[1] << 8, 5), _bucket(e[0] | e[1] << 8 | e[2] << 16, 6)],
            axis=1,
        ) if len(first) else np.zeros((0, 6), np.int32)
        self.hashes = words.hashes()

    def resets(self) -> np.ndarray:
        """True at the first word of every text."""
        out = np.zeros(len(self.size), bool)
        bounds = self.words.bounds
        out[bounds[:-1][bounds[:-1] < bounds[1:]]] = True
        return out


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray  # (7 * BUCKETS + lexicon + 1, labels)
    lexicon: np.ndarray  # sorted word hashes
    transitions: np.ndarray  # log potentials, from row to column

    def lexicon_rows(self, hashes: np.ndarray) -> np.ndarray:
        """Weight row of each word's lexicon entry; the last row stands for none."""
        none = len(self.weights) - 1
        if not len(self.lexicon):
            return np.full(len(hashes), none)
        at = np.minimum(np.searchsorted(self.lexicon, hashes), len(self.lexicon) - 1)
        return np.where(self.lexicon[at] == hashes, 7 * BUCKETS + at, none)

    def emissions(self, f: Features) -> np.ndarray:
        """Log potentials (words, labels)."""
        if not len(f.size):
            return np.zeros((0, len(self.labels)), np.float32)
        out = np.add.reduceat(self.weights[f.grams], f.offsets, axis=0)
        for i in range(6):
            out += self.weights[f.affixes[:, i]]
        return out + self.weights[self.lexicon_rows(f.hashes)]


def forward_backward(emissions: np.ndarray, transitions: np.ndarray, resets: np.ndarray, pairs: bool = False):
    """Posteriors (words, labels) of a chain that starts anew where `resets` is true; with `pairs`
    also the expected number of each transition."""
    n, k = emissions.shape
    if not n:
        return (emissions, np.zeros((k, k))) if pairs else emissions
    size = max(1, int(np.sqrt(n)))
    blocks = -(-n // size)
    e = np.ones((blocks * size, k))
    e[:n] = np.exp(emissions - emissions.max(axis=1, keepdims=True))
    fresh = np.ones(blocks * size, bool)  # padding: words of their own
    fresh[:n] = resets
    fresh[0] = True
    e, fresh = e.reshape(blocks, size, k), fresh.reshape(blocks, size)
    t = np.exp(transitions - transitions.max())

    def step(v, at):  # (blocks, rows, k) times the transfer matrix of word `at` of each block
        moved = v @ t
        new = fresh[:, at]
        moved[new] = v[new].sum(axis=2, keepdims=True)
        moved *= e[:, at, None, :]
        return moved

    product = np.broadcast_to(np.eye(k), (blocks, k, k)).copy()
    for at in range(size):
        product = step(product, at)
        product /= product.max(axis=(1, 2), keepdims=True)
    into = np.ones((blocks + 1, 1, k))  # what reaches each block from the left
    back = np.ones((blocks + 1, k))  # and from the right
    for b in range(blocks):
        into[b + 1] = into[b] @ product[b]
        into[b + 1] /= into[b + 1].sum()
    for b in range(blocks - 1, -1, -1):
        back[b] = product[b] @ back[b + 1]
        back[b] /= back[b].sum()
    alpha = np.empty((blocks, size, k))
    v = into[:-1]
    for at in range(size):
        v = step(v, at)
        v = v / v.sum(axis=2, keepdims=True)
        alpha[:, at] = v[:, 0]
    beta = np.empty((blocks, size, k))
    u = back[1:]
    for at in range(size - 1, -1, -1):
        beta[:, at] = u
        w = e[:, at] * u
        u = w @ t.T
        new = fresh[:, at]
        u[new] = w[new].sum(axis=1, keepdims=True)
        u = u / u.sum(axis=1, keepdims=True)
    gamma = alpha * beta
    gamma = (gamma / gamma.sum(axis=2, keepdims=True)).reshape(-1, k)[:n]
    if not pairs:
        return gamma
    a, eb = alpha.reshape(-1, k)[: n - 1], (e * beta).reshape(-1, k)[1:n]
    joint = a[:, :, None] * t[None] * eb[:, None, :]
    joint /= joint.sum(axis=(1, 2), keepdims=True)
    return gamma, joint[~fresh.reshape(-1)[1:n]].sum(axis=0)


def fit(texts: list[str], labels: list[str]) -> Model:
    """Maximum likelihood with decay; a text's label is the label of all its words."""
    names = sorted(set(labels))
    f = Features(pa.array(texts, pa.large_string()))
    k, n = len(names), len(f.size)
    known, counts = np.unique(f.hashes, return_counts=True)
    order = np.lexsort((known, -counts))[:LEXICON]
    lexicon = np.sort(known[order][counts[order] > 1])
    model = Model(names, np.zeros((7 * BUCKETS + len(lexicon) + 1, k), np.float32), lexicon, np.zeros((k, k)))
    if not n or k < 2:
        return model
    bounds = f.words.bounds
    truth = np.repeat([names.index(x) for x in labels], np.diff(bounds))
    resets = f.resets()
    seen = np.zeros((k, k))
    np.add.at(seen, (truth[:-1][~resets[1:]], truth[1:][~resets[1:]]), 1)
    lex = model.lexicon_rows(f.hashes)
    # features in use, numbered densely
    flat = np.concatenate([f.grams, f.affixes.ravel(), lex])
    owner = np.concatenate([np.repeat(np.arange(n), f.size), np.repeat(np.arange(n), 6), np.arange(n)])
    used, flat = np.unique(flat, return_inverse=True)
    square, t_square = np.full((len(used), k), 1e-8), np.full((k, k), 1e-8)
    for _ in range(ROUNDS):
        gamma, expected = forward_backward(model.emissions(f), model.transitions, resets, pairs=True)
        slope = gamma.copy()
        slope[np.arange(n), truth] -= 1
        for j in range(k):
            grad = np.bincount(flat, slope[owner, j], minlength=len(used)) / n + DECAY * model.weights[used, j]
            square[:, j] += grad * grad
            model.weights[used, j] -= (RATE * grad / np.sqrt(square[:, j])).astype(np.float32)
        grad = (expected - seen) / n + DECAY * model.transitions
        t_square += grad * grad
        model.transitions -= RATE * grad / np.sqrt(t_square)
    return model


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, per_label: int = PER_LABEL) -> Model:
    """A model from `per_label` labelled rows of each label that aren't held out."""
    rows = docs.select(column(docs, "doc_id").alias("doc_id"), column(docs, "text").alias("text"), column(docs, "lang").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").rlike("\\p{L}") & (F.length("text") <= TRAIN_CHARS) & ~held_out(F.col("doc_id")))
    slim = rows.select("lang", F.xxhash64("doc_id", "text").alias("h"))
    first = Window.partitionBy("lang").orderBy("h")  # Spark keeps per_label rows a label before the shuffle
    chosen = slim.withColumn("r", F.row_number().over(first)).where(F.col("r") <= per_label).select("lang", "h").distinct()
    sample = rows.withColumn("h", F.xxhash64("doc_id", "text")).join(F.broadcast(chosen), ["lang", "h"], "left_semi")
    sample = sample.dropDuplicates(["lang", "h"]).orderBy("lang", "h").select("text", "lang").collect()  # per_label texts a label
    return fit([r["text"] for r in sample], [r["lang"] for r in sample])


def _texts(docs: DataFrame) -> DataFrame:
    text = column(docs, "text")
    return docs.select(column(docs, "doc_id").alias("doc_id"), F.when(text.rlike("\\p{L}"), text).alias("text"))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score of every row."""
    rows = _texts(docs)

    def run(batches):
        names = np.array([*model.labels, UNKNOWN], object)
        for batch in batches:
            for piece in sliced(batch, "text"):
                lang, score = _scores(piece.column("text"), model)
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(names[lang], pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def accepted(docs: DataFrame, model: Model, least: float) -> DataFrame:
    """The rows of `docs`, all columns, whose text has a letter and a language of score >= least
    (a model without labels rejects letterless texts only)."""
    names = docs.columns
    text = column(docs, "text")
    rows = docs.select(*[column(docs, n).alias(f"_{i}") for i, n in enumerate(names)], F.when(text.rlike("\\p{L}"), text).alias("text"))

    def run(batches):
        for batch in batches:
            for piece in sliced(batch, "text"):
                keep = np.asarray(piece.column("text").is_valid())
                if model.labels:
                    _, score = _scores(piece.column("text"), model)
                    keep = keep & (score >= least)
                yield piece.select(range(len(names))).filter(pa.array(keep))

    kept = rows.mapInArrow(run, rows.drop("text").schema)
    return kept.select(*[F.col(f"_{i}").alias(n) for i, n in enumerate(names)])


def _scores(texts: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Number of the predicted label (len(labels): unknown) and score of each text."""
    lang, score = np.full(len(texts), len(model.labels)), np.zeros(len(texts))
    if model.labels and texts.null_count < len(texts):
        f = Features(texts)
        gamma = forward_backward(model.emissions(f), model.transitions, f.resets())
        total = np.concatenate([np.zeros((1, len(model.labels))), np.cumsum(gamma, axis=0)])
        bounds = f.words.bounds
        share, n = total[bounds[1:]] - total[bounds[:-1]], np.diff(bounds)
        some = n > 0
        lang[some] = np.round(share[some], 9).argmax(axis=1)
        score[some] = np.clip(share[some].max(axis=1) / n[some], 0, 1)
    return lang, score


def spans(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, first_word, n_words, lang of every run of words of one label (the most probable label
    of each word); texts without a letter have none."""
    rows = _texts(docs)
    fields = ["doc_id", "first_word", "n_words", "lang"]

    def run(batches):
        for batch in batches:
            for piece in sliced(batch, "text"):
                f = Features(piece.column("text"))
                if not len(f.size) or not model.labels:
                    continue
                best = forward_backward(model.emissions(f), model.transitions, f.resets()).argmax(axis=1)
                new = f.resets()
                new[1:] |= best[1:] != best[:-1]
                starts = np.flatnonzero(new)
                row = np.searchsorted(f.words.bounds, starts, "right") - 1
                size = np.diff(np.append(starts, len(best)))
                names = np.array(model.labels, object)[best[starts]]
                yield pa.RecordBatch.from_arrays([piece.column("doc_id").take(pa.array(row)), pa.array(starts - f.words.bounds[row]), pa.array(size), pa.array(names, pa.string())], fields)

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, first_word bigint, n_words bigint, lang string")


def identified(docs: DataFrame, per_label: int = PER_LABEL) -> DataFrame:
    """The query's digest: doc_id, held_out, lang_pred, score of every row."""
    out = predict(docs, learn(docs, per_label))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
