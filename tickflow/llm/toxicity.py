"""Toxicity by a weighted finite-state pattern grammar over clauses.

A text is cut into clauses (at . ! ? ; : and line ends) and words. Each word is a symbol: an insult,
a threat, a target, a negation, a verb of report, or any other word. Small transducers read them:

* *target*: a person named within NEAR words before;
* *negation*: a negation within NEAR words before;
* *reported speech*: a verb of report earlier in the clause;
* *threat*: a threat that a target follows within NEAR words;
* *insult*: writes a match, in the context that the others are in.

:func:`compose` builds their product once: one table of moves and one of written contexts (insult,
aimed insult, negated insult, reported insult, threat). Clauses that hold an insult or a threat run
through it side by side; the best path of a clause is its heaviest match. A document's features
are, per context, how surely one of its clauses matches; its score is a logistic function of them,
so what is scored are matched clauses in their context, not words.

What is learned, from rows with a label that aren't held out: the insults (whole words and stems of
4 to 7 bytes, counted without their commonest word; the weight is a lower bound of the log odds that a text with the
word is toxic, kept if far beyond chance for the number of words looked at), and the weights of the
contexts, drawn towards PRIOR. It takes a bounded sample: about TOXIC_ROWS and OTHER_ROWS texts, by a hash of
doc_id, near copies among them once; the insults are counted on the executors. The lists of threats, targets, negations and verbs of report are fixed.

Defined results: null, empty and letterless texts score what a text without matches scores; repeated
rows get equal scores; labels other than 1 count as not toxic, null ones and those of held-out
rows aren't read, of several labels of a doc_id the toxic one counts; ties of equal weights go to the
first word; without a toxic label nothing matches and every score is the (smoothed) share of toxic
labels; empty tables give no rows. Only doc_id and text are read, and doc_id and toxic of the labels.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickflow.llm.common import Words, as_long, column, mix, sliced, windows, written
from tickflow.llm.langid import _fold, held_out

TOXIC_ROWS, OTHER_ROWS = 3000, 6000
LEXICON, LEAST_TEXTS, LEAST_ODDS = 20_000, 3, 0.5
STEMS = (4, 5, 6, 7)
NEAR = 3
THRESHOLD = 0.3

# Fixed lists, lower case.
THREATS = (
    "kill hurt beat burn shoot stab strangle destroy murder töten umbringen erschießen schlagen verbrennen vernichten "
    "tuer frapper brûler détruire égorger matar golpear quemar destruir disparar"
)
TARGETS = (
    "you your yours yourself he him she her they them their people everyone du dich dir dein deine ihr euch euer sie ihnen leute "
    "tu toi te ton ta vous votre il elle ils elles leur gens tú ti tus usted ustedes él ella ellos ellas gente"
)
NEGATIONS = "not never no without nobody cannot nicht nie niemals kein keine keinen ohne pas jamais ni sans nunca jamás sin tampoco"
REPORTS = (
    "said says say wrote writes claimed claims reported reports quoted called alleged sagte sagt schrieb behauptete nannte zitierte "
    "dit disait écrit affirmé prétend cité dijo dice escribió afirmó llamó citó"
)

OTHER, TARGET, NEGATION, REPORT, THREAT, INSULT = range(6)
NOTHING, PLAIN, AIMED, NEGATED, REPORTED, THREATENED = range(6)
CONTEXTS = ("", "insult", "aimed insult", "negated insult", "reported insult", "threat")
THREAT_WEIGHT = 3.0
PRIOR = np.array([-3.0, 6.0, 7.0, 3.0, 3.0, 5.0])  # bias, then one a context
PULL = 0.02  # towards PRIOR


# ---------------------------------------------------------------- transducers


def _within(symbol: int, near: int = NEAR):
    """(states, move): how many words ago `symbol` was read counts down from `near`."""
    return near + 1, lambda state, s: near if s == symbol else max(state - 1, 0)


def _since(symbol: int):
    return 2, lambda state, s: 1 if s == symbol else state


MACHINES = {"target": _within(TARGET), "negation": _within(NEGATION), "report": _since(REPORT), "threat": _within(THREAT)}


def _written(state: dict[str, int], s: int) -> int:
    if s == INSULT:
        return NEGATED if state["negation"] else REPORTED if state["report"] else AIMED if state["target"] else PLAIN
    if s == TARGET and state["threat"] and not state["negation"] and not state["report"]:
        return THREATENED
    return NOTHING


def compose(machines=None) -> tuple[np.ndarray, np.ndarray]:
    """The product of the transducers: moves[state, symbol] and written[state, symbol]; state 0 is the
    start of a clause."""
    machines = machines or MACHINES
    states = list(product(*(range(n) for n, _ in machines.values())))
    number = {s: i for i, s in enumerate(states)}
    moves, out = np.zeros((len(states), 6), np.int16), np.zeros((len(states), 6), np.int8)
    for s, i in number.items():
        for symbol in range(6):
            moves[i, symbol] = number[tuple(move(x, symbol) for x, (_, move) in zip(s, machines.values()))]
            out[i, symbol] = _written(dict(zip(machines, s)), symbol)
    return moves, out


MOVES, WRITTEN = compose()


# ---------------------------------------------------------------- words and clauses

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_BREAK = np.zeros(256, np.int64)
_BREAK[[ord(c) for c in ".!?;:\n\r"]] = 1


class Tokens(Words):
    """Runs of letters, lower-cased, and the clause that each stands in."""

    def __init__(self, texts: pa.Array):
        super().__init__(texts)
        size = np.asarray(pc.fill_null(pc.binary_length(texts.cast(pa.large_binary())), 0)).astype(np.int64)
        offsets = np.concatenate([[0], np.cumsum(size)])
        raw = self.data
        self.data = _fold(raw)
        inside = _LETTER[raw]
        first = np.zeros(len(raw) + 1, bool)
        first[offsets] = True  # a text begins anew
        before = np.concatenate([[False], inside[:-1]]) if len(raw) else inside
        after = np.concatenate([inside[1:], [False]]) if len(raw) else inside
        self.starts = np.flatnonzero(inside & (~before | first[:-1]))
        self.ends = np.flatnonzero(inside & (~after | first[1:])) + 1
        self.bounds = np.searchsorted(self.starts, offsets)
        breaks = np.concatenate([[0], np.cumsum(_BREAK[raw])])
        clause = breaks[self.starts]
        new = np.ones(len(clause), bool)
        new[1:] = clause[1:] != clause[:-1]
        new[self.bounds[:-1][self.bounds[:-1] < len(new)]] = True
        self.clauses = np.append(np.flatnonzero(new), len(clause))  # first words, and the end

    def keys(self, kind: int) -> tuple[np.ndarray, np.ndarray]:
        """(words, their keys): the whole words (kind 0), or the stems of the words longer than kind."""
        ends = self.ends
        if not kind:
            return np.arange(len(self.starts)), self.hashes(0)
        at = np.flatnonzero(ends - self.starts > kind)
        part = object.__new__(Words)
        part.data, part.starts, part.ends = self.data, self.starts[at], self.starts[at] + kind
        return at, Words.hashes(part, kind)


def _hash_list(text: str) -> np.ndarray:
    return np.sort(Words(pa.array([text], pa.large_string())).hashes(0))


_LISTS = {TARGET: _hash_list(TARGETS), NEGATION: _hash_list(NEGATIONS), REPORT: _hash_list(REPORTS), THREAT: _hash_list(THREATS)}


def _found(keys: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Place of each key in a sorted table, or -1."""
    if not len(table):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, -1)


@dataclass
class Model:
    insults: dict[int, tuple[np.ndarray, np.ndarray]]  # kind -> sorted keys, weights
    weights: np.ndarray  # bias, then one a context


@dataclass
class Matches:
    """The heaviest match of every clause that has one."""

    text: np.ndarray
    clause: np.ndarray  # first word
    size: np.ndarray  # words
    word: np.ndarray
    key: np.ndarray  # of the word
    context: np.ndarray
    weight: np.ndarray


def parse(tokens: Tokens, model: Model) -> Matches:
    n = len(tokens.starts)
    weight, symbol = np.zeros(n), np.zeros(n, np.int8)
    whole = tokens.keys(0)[1]
    for kind in STEMS:
        if kind in model.insults:
            at, keys = tokens.keys(kind)
            table, odds = model.insults[kind]
            place = _found(keys, table)
            hit = place >= 0
            weight[at[hit]] = np.maximum(weight[at[hit]], odds[place[hit]])
    if 0 in model.insults:
        table, odds = model.insults[0]
        place = _found(whole, table)
        weight[place >= 0] = odds[place[place >= 0]]
    for s, table in _LISTS.items():
        symbol[_found(whole, table) >= 0] = s
    symbol[weight > 0] = INSULT
    first, end = tokens.clauses[:-1], tokens.clauses[1:]
    calls = np.concatenate([[0], np.cumsum(symbol >= THREAT)])
    some = calls[end] > calls[first]
    first, end = first[some], end[some]
    # the clauses side by side, word by word; the longest come first, so that those that go on lead
    order = np.argsort(first - end, kind="stable")
    lane, size = first[order], (end - first)[order]
    state, context = np.zeros(len(lane), np.int16), np.zeros(n, np.int8)
    live = len(lane)
    for step in range(int(size.max()) if live else 0):
        while size[live - 1] <= step:
            live -= 1
        at = lane[:live] + step
        s = symbol[at]
        context[at] = WRITTEN[state[:live], s]
        state[:live] = MOVES[state[:live], s]
    word = np.flatnonzero(context)
    heavy = np.where(context[word] == THREATENED, THREAT_WEIGHT, weight[word])
    owner = np.searchsorted(first, word, "right") - 1
    best = np.lexsort((word, -heavy, owner))
    lead = np.ones(len(best), bool)
    lead[1:] = owner[best][1:] != owner[best][:-1]
    best = best[lead]
    word, heavy, owner = word[best], heavy[best], owner[best]
    text = np.searchsorted(tokens.bounds, word, "right") - 1
    return Matches(text, first[owner], (end - first)[owner], word, whole[word], context[word], heavy)


def features(matches: Matches, n_texts: int) -> np.ndarray:
    """(texts, contexts): how surely a clause matches in each context. Clauses decided by the same
    word count once."""
    order = np.lexsort((matches.key, matches.context, matches.text))
    text, context, key, weight = (x[order] for x in (matches.text, matches.context, matches.key, matches.weight))
    new = np.ones(len(order), bool)
    new[1:] = (text[1:] != text[:-1]) | (context[1:] != context[:-1]) | (key[1:] != key[:-1])
    missed = np.zeros((n_texts, len(CONTEXTS) - 1))  # logarithm of "none does"
    np.add.at(missed, (text[new], context[new] - 1), -np.log1p(np.exp(weight[new])))
    return -np.expm1(missed)


def scores(f: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-(weights[0] + f @ weights[1:])))


# ---------------------------------------------------------------- learning


def calibrate(f: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Logistic weights of the contexts (Newton's method), drawn towards PRIOR."""
    x = np.column_stack([np.ones(len(f)), f])
    total, w = weight.sum(), PRIOR.copy()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - toxic)) / total + PULL * (w - PRIOR) * (np.arange(len(w)) > 0)
        bend = (x * (weight * p * (1 - p) / total)[:, None]).T @ x + np.diag([1e-6] + [PULL] * (len(w) - 1))
        w = w - np.clip(np.linalg.solve(bend, slope), -1, 1)
    return w


def _sample(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, int, int]:
    """(toxic, text) of a bounded number of labelled rows, and the labels of each kind in all."""
    known = labels.select(column(labels, "doc_id").alias("doc_id"), (column(labels, "toxic") == 1).cast("int").alias("toxic"))
    known = known.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    # by a hash under the share that is wanted of each kind: no order of all labels
    share = F.when(F.col("toxic") == 1, min(1.0, TOXIC_ROWS / max(counts.get(1, 0), 1))).otherwise(min(1.0, OTHER_ROWS / max(counts.get(0, 0), 1)))
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share * (1 << 30))
    rows = docs.select(column(docs, "doc_id").alias("doc_id"), F.coalesce(column(docs, "text"), F.lit("")).alias("text"))
    rows = rows.join(F.broadcast(chosen.select("doc_id", "toxic")), "doc_id")  # about TOXIC_ROWS + OTHER_ROWS ids
    rows = rows.groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("toxic", "text")
    for seed in (1, 2):  # near copies bear witness once
        rows = rows.mapInArrow(_sketched(seed), "toxic int, text string, sketch bigint").groupBy("toxic", "sketch").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("toxic", "text")
    return written(spark, rows, "toxicity"), counts.get(1, 0), counts.get(0, 0)


def _sketched(seed: int):
    """The least hash of a text's runs of five words, which near copies share as often as they share
    their runs."""

    def run(batches):
        for batch in batches:
            for piece in sliced(batch, "text"):
                tokens = Tokens(piece.column("text"))
                h, sketch = tokens.keys(0)[1], []
                for a, b in zip(tokens.bounds[:-1], tokens.bounds[1:]):
                    part = windows(h[a:b], min(5, b - a)) if b > a else np.zeros(1, np.uint64)
                    sketch.append(mix(part ^ np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64))).min())
                yield pa.RecordBatch.from_arrays([*piece.columns, as_long(np.array(sketch, np.uint64))], ["toxic", "text", "sketch"])

    return run


def _counted(sample: DataFrame) -> DataFrame:
    """kind, h, toxic and other texts that hold it. A stem is counted without its commonest word,
    which is known as a whole."""

    def run(batches):
        for batch in batches:
            for piece in sliced(batch, "text"):
                tokens = Tokens(piece.column("text"))
                owner = np.repeat(np.arange(tokens.n_texts), np.diff(tokens.bounds))
                toxic, whole = np.asarray(piece.column("toxic")), tokens.keys(0)[1]
                for kind in (0, *STEMS):
                    at, keys = tokens.keys(kind)
                    if len(at):
                        order = np.lexsort((whole[at], keys, owner[at]))
                        at, keys = at[order], keys[order]
                        new = np.ones(len(at), bool)
                        new[1:] = (keys[1:] != keys[:-1]) | (owner[at][1:] != owner[at][:-1])
                        at, keys = at[new], keys[new]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), kind, np.int32)), as_long(keys), as_long(whole[at]), pa.array(toxic[owner[at]])], ["kind", "h", "word", "toxic"])

    out = sample.mapInArrow(run, "kind int, h bigint, word bigint, toxic int")
    each = out.groupBy("kind", "h", "word").agg(F.sum("toxic").alias("k"), F.sum(1 - F.col("toxic")).alias("m"))
    top = F.when(F.col("kind") == 0, F.struct(F.lit(0).alias("k"), F.lit(0).alias("m"))).otherwise(F.max(F.struct("k", "m")))
    both = each.groupBy("kind", "h").agg(F.sum("k").alias("k"), F.sum("m").alias("m"), top.alias("top"))
    return both.select("kind", "h", (F.col("k") - F.col("top.k")).alias("k"), (F.col("m") - F.col("top.m")).alias("m"))


def _odds(k: Column, m: Column, rows: tuple[int, int], prior: float) -> tuple[Column, Column]:
    """Log odds of "toxic" for texts with a feature, less their standard error, and the feature's
    likelihood ratio."""
    toxic, other = rows
    share = toxic / (toxic + other)
    term = lambda x, e: F.when(x > 0, x * F.log(x / e)).otherwise(0.0)
    n = k + m
    odds = F.log((k + 0.5) / (toxic + 1) * (other + 1) / (m + 0.5)) - F.sqrt(1 / (k + 0.5) + 1 / (m + 0.5)) + prior
    return odds, 2 * (term(k, n * share) + term(m, n * (1 - share)))


def learn(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> Model:
    """The insults and the weights of the contexts from a bounded sample of labelled rows."""
    sample, all_toxic, all_other = _sample(spark, docs, labels)
    rows = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, other = rows.get(1, 0), rows.get(0, 0)
    none = PRIOR.copy()
    none[0] = math.log((all_toxic + 0.5) / (all_other + 0.5))
    if not toxic or not other:
        return Model({}, none)
    counted = written(spark, _counted(sample).where(F.col("k") >= LEAST_TEXTS), "insults")
    odds, ratio = _odds(F.col("k"), F.col("m"), (toxic, other), none[0])
    chance = 2 * math.log(2 * counted.count() + 2)
    kept = counted.select("kind", "h", odds.alias("odds"), ratio.alias("ratio")).where((F.col("odds") >= LEAST_ODDS) & (F.col("ratio") >= chance))
    insults = {}
    chosen = kept.orderBy(F.col("ratio").desc(), "kind", "h").limit(LEXICON).collect()
    for kind in (0, *STEMS):
        own = sorted((r["h"] % (1 << 64), r["odds"]) for r in chosen if r["kind"] == kind)
        if own:
            insults[kind] = (np.array([h for h, _ in own], np.uint64), np.array([w for _, w in own]))
    model = Model(insults, PRIOR)
    found = sample.mapInArrow(_featured(model, "toxic"), "toxic int, f array<double>").toArrow()  # a row a sampled text
    f, is_toxic = np.array(found.column("f").to_pylist()), np.asarray(found.column("toxic"))
    model.weights = calibrate(f, is_toxic, np.where(is_toxic == 1, all_toxic / toxic, all_other / other))
    return model


def _featured(model: Model, name: str):
    def run(batches):
        for batch in batches:
            for piece in sliced(batch, "text"):
                f = features(parse(Tokens(piece.column("text")), model), piece.num_rows)
                yield pa.RecordBatch.from_arrays([piece.column(name), pa.array(list(f), pa.list_(pa.float64()))], [name, "f"])

    return run


# ---------------------------------------------------------------- use


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(column(docs, "doc_id").alias("doc_id"), F.coalesce(column(docs, "text"), F.lit("")).alias("text"))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of every row."""
    rows = _rows(docs)

    def run(batches):
        for batch in batches:
            for piece in sliced(batch, "text"):
                f = features(parse(Tokens(piece.column("text")), model), piece.num_rows)
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(scores(f, model.weights))], ["doc_id", "score"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")


def clauses(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, clause, word, context, weight of every matched clause: its text, the word that
    decided it and the context it was matched in."""
    rows = _rows(docs)
    names = ["doc_id", "clause", "word", "context", "weight"]

    def run(batches):
        for batch in batches:
            for piece in sliced(batch, "text"):
                tokens = Tokens(piece.column("text"))
                m = parse(tokens, model)
                cut = lambda a, b: [tokens.original[tokens.starts[i] : tokens.ends[j]].tobytes().decode() for i, j in zip(a, b)]
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id").take(pa.array(m.text)), pa.array(cut(m.clause, m.clause + m.size - 1), pa.string()), pa.array(cut(m.word, m.word), pa.string()),
                     pa.array([CONTEXTS[c] for c in m.context], pa.string()), pa.array(m.weight)], names)

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, clause string, word string, context string, weight double")


def scored(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The query's digest: doc_id, held_out, score, predicted of every row."""
    out = predict(docs, learn(spark, docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
