"""The toxicity grammar against a plain reading of its rules, and its held-out accuracy."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from llm.conftest import SCHEMA, CLASHING, empty, frame

from tickflow.llm import toxicity as T

INSULTS = {"fool": 4.0, "vermin": 3.0, "twit": 1.0}


def model():
    def table(pairs, kind):
        keys = [(int(T.Tokens(pa.array([w], pa.large_string())).keys(kind)[1][0]), x) for w, x in pairs]
        keys.sort()
        return np.array([k for k, _ in keys], np.uint64), np.array([x for _, x in keys])

    return T.Model({0: table(INSULTS.items(), 0), 4: table([("blorb", 2.0)], 4)}, T.PRIOR)


KINDS = {w: s for s, ws in ((T.THREAT, T.THREATS), (T.REPORT, T.REPORTS), (T.NEGATION, T.NEGATIONS), (T.TARGET, T.TARGETS)) for w in ws.split()}


def symbol(w):
    weight = INSULTS.get(w) or (2.0 if len(w.encode()) > 4 and w.startswith("blor") else 0)
    if weight:
        return T.INSULT, weight
    return KINDS.get(w, T.OTHER), 0


def read(text):
    """(clause, word, context, weight) of the heaviest match of every clause."""
    out = []
    for clause in re.split(r"[.!?;:\n\r]", text or ""):
        ws = re.findall(r"[A-Za-z\u0080-\U0010ffff]+", clause)
        syms = [symbol(w.lower()) for w in ws]
        best = None
        for i, (s, weight) in enumerate(syms):
            near = lambda kind: any(x == kind for x, _ in syms[max(0, i - 3) : i])
            context = None
            told = s in (T.INSULT, T.TARGET) and any(x == T.REPORT for x, _ in syms[:i])
            if s == T.INSULT:
                context = T.NEGATED if near(T.NEGATION) else T.REPORTED if told else T.AIMED if near(T.TARGET) else T.PLAIN
            elif s == T.TARGET and near(T.THREAT) and not near(T.NEGATION) and not told:
                context, weight = T.THREATENED, T.THREAT_WEIGHT
            if context is not None and (best is None or weight > best[3]):
                best = (i, ws[i], T.CONTEXTS[context], weight)
        if best is not None:
            first, last = clause.index(ws[0]), clause.rindex(ws[-1]) + len(ws[-1])
            out.append((clause[first:last], *best[1:]))
    return out


PARTS = ["fool", "Vermin", "TWIT", "blorbish", "blor", "you", "they", "not", "never", "said", "kill", "hurt", "a", "the", "day", "été", "Él", "says", ".", "!", "\n", "; ", ",", "x1y"]


def texts():
    rnd = random.Random(8)
    out = ["", " ", None, "...", "fool", "You are a fool. He said you are a fool! You are not a fool", "I will kill you", "I will not kill you", "123 456", "日本 fool 日本"]
    out += [" ".join(rnd.choice(PARTS) for _ in range(rnd.randint(1, 40))) for _ in range(300)]
    return out + ["day " * 50_000 + "fool", "a fool. " * 5000]


def test_clauses_equal_a_plain_reading(spark):
    rows = list(enumerate(texts())) + [(5, "a twit"), (None, "fool")]
    want = Counter((i, *m) for i, t in rows for m in read(t))
    got = Counter(tuple(r) for r in T.clauses(frame(spark, rows), model()).collect())
    assert got == want
    assert {c for _, _, _, c, _ in got} == set(T.CONTEXTS[1:])


def test_scores_follow_the_contexts(spark):
    rows = [(1, "You are a fool."), (2, "He said you are a fool."), (3, "You are not a fool."), (4, "A day."), (5, None), (6, ""), (7, "I will kill you"), (8, "a fool. a fool. a fool"), (9, "a fool")]
    s = {r.doc_id: r.score for r in T.predict(frame(spark, rows), model()).collect()}
    assert s[1] > s[9] > s[2] >= s[3] > s[4] == s[5] == s[6] and s[7] > 0.5 and s[8] == s[9]
    assert T.predict(empty(spark), model()).collect() == []


def test_product_machine():
    moves, out = T.compose()
    assert len(moves) == 4 * 4 * 2 * 4
    state = 0
    for s in (T.TARGET, T.OTHER, T.OTHER):
        state = moves[state, s]
    assert out[state, T.INSULT] == T.AIMED
    assert out[moves[state, T.OTHER], T.INSULT] == T.PLAIN


def labelled(spark, n=1200):
    rnd = random.Random(2)
    docs, labels = [], []
    common = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    for i in range(n):
        toxic = i % 8 == 0
        ws = [rnd.choice(common) for _ in range(60)]
        if toxic:
            for _ in range(3):
                ws[rnd.randrange(60)] = rnd.choice(["grubbo", "snarfa" + rnd.choice(["lo", "mi", "te", "qu"]), "Plonk"])
        docs.append((i, " ".join(ws)))
        labels.append((i, int(toxic), 1))
    docs += [(n + i, docs[16][1] + f" end{i}") for i in range(300)]  # near copies of one toxic text
    labels += [(n + i, 1, 1) for i in range(300)] + [(3, None, 1), (None, 1, 1), (999_999, 1, 1), (5, 7, 0)]
    return frame(spark, docs), spark.createDataFrame(labels, "doc_id bigint, toxic int, text int"), n


def test_held_out_rows_are_told(spark):
    docs, labels, n = labelled(spark)
    out = T.scored(spark, docs, labels).where(f"doc_id < {n}").collect()
    for held in (True, False):
        part = [r for r in out if r.held_out == held]
        assert len(part) > 200
        assert sum(r.predicted == (r.doc_id % 8 == 0) for r in part) >= 0.99 * len(part)
    assert all(r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in out)


def test_held_out_labels_change_nothing(spark):
    docs, labels, _ = labelled(spark, 400)
    from pyspark.sql import functions as F

    flipped = labels.withColumn("toxic", F.when(T.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    score = lambda x: sorted((r.doc_id, r.score) for r in T.scored(spark, docs, x).collect())
    assert score(labels) == score(flipped)


def test_nothing_to_learn_from(spark):
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    rows = [(1, "you fool"), (2, None)]
    for labels in (none, spark.createDataFrame([(1, 0)], "doc_id bigint, toxic int"), spark.createDataFrame([(1, 1)], "doc_id bigint, toxic int")):
        out = T.scored(spark, frame(spark, rows), labels).collect()
        assert len({r.score for r in out}) == 1 and len(out) == 2
    assert T.scored(spark, spark.createDataFrame([], f"{SCHEMA}, {CLASHING}"), none).collect() == []


def test_whole_table(spark):
    import __spark_entry__ as e

    sf = "/root/testdata/sf0.1"
    out = e.queries()["op11_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    held = [r for r in out.collect() if r.held_out]
    right = sum(r.predicted == r.toxic for r in held)
    assert len(held) > 900 and right >= 0.97 * len(held)
