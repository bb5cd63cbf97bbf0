import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CLASHING = "sid bigint, n bigint, token bigint, words string, copy boolean, h bigint, shard int, `a.b` string, _0 string"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = SparkSession.getActiveSession()
    if s is None:
        from tickflow.session import local_session

        s = local_session(8, 8, "llm-tests")
    if not s.conf.get("spark.checkpoint.dir", None):
        import tempfile

        s.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="llm-test-ckpt-"))
    from tickflow.session import prepare

    return prepare(s)


def sentence(rnd, size, vocabulary=400):
    return " ".join(f"w{rnd.randrange(vocabulary)}" for _ in range(size))


def corpus(seed=3):
    """(doc_id, text) rows with copies, near copies, shared passages, odd texts and repeated rows."""
    rnd = random.Random(seed)
    rows, base = [], [sentence(rnd, rnd.randint(1, 120)) for _ in range(25)]
    passage = sentence(rnd, 30)
    texts = list(base)
    for t in base[:12]:
        words = t.split()
        for _ in range(3):
            near = list(words)
            near[rnd.randrange(len(near))] = "edited"
            texts.append(" ".join(near))
        texts.append(t.upper() if rnd.random() < 0.5 else t)
        texts.append(t.replace(" ", "\n", 2))
    for _ in range(8):
        texts.append(f"{sentence(rnd, 20)} {passage} {sentence(rnd, 20)}")
    texts += [None, "", " ", "\n\t", "one", "one two", "one two three", "one two three", "a b c d", "A b C d", "x " * 3000, "É é \x0bz\x0c", "日本語 テキスト"]
    ids = list(range(1, 10 * len(texts), 10))[: len(texts)]
    rnd.shuffle(ids)
    rows = [(i, t) for i, t in zip(ids, texts)]
    rows += [rows[0], rows[30], (rows[1][0], rows[2][1])]  # repeated rows, one doc_id with two texts
    return rows


@pytest.fixture(scope="session")
def rows():
    return corpus()


def frame(spark, rows, parts=3):
    """documents with columns whose names clash with what operators use inside."""
    data = [(i, t, "en", "src", None if t is None else len(t), 1, 2, 3, "w", True, 4, 5, "dot", "zero") for i, t in rows]
    return spark.createDataFrame(data, f"{SCHEMA}, {CLASHING}").repartition(parts)


def empty(spark):
    return spark.createDataFrame([], f"{SCHEMA}, {CLASHING}")


def words(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", text or "")
