"""What __spark_entry__ gets: one query per operator, the pipeline, SQL where it can say it; each
query with SQL equals it over whole tables; the pipeline equals its stages done by brute force."""

import os
from collections import Counter

import pytest

from llm.test_native import norm, similarity
from llm.test_pairs import brute_components
from llm.conftest import words

SF = "/root/testdata/sf0.001"


def test_one_query_per_operator():
    import __spark_entry__ as e

    names = [n for n in e.queries() if n == "pipeline" or n.startswith("op") and n[2].isdigit()]
    assert sorted(n.split("_")[0] for n in names) == sorted([f"op{i}" for i in range(1, 14)] + ["pipeline"])
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("name", ["op1_url_filter", "op5_jaccard_join", "op7_warc", "op8_quality_ledger", "op10_substring_dedup", "op12_hard_negatives"])
def test_queries_equal_their_sql(spark, name):
    import __spark_entry__ as e
    from tools.oracle_check import _norm, duck_connect

    out = e.queries()[name](spark, SF)
    cols = sorted(out.columns)
    cursor = duck_connect(SF).execute(e.oracle_sql()[name])
    at = [[d[0] for d in cursor.description].index(c) for c in cols]
    want = Counter(tuple(_norm(r[i]) for i in at) for r in cursor.fetchall())
    assert Counter(tuple(_norm(r[c]) for c in cols) for r in out.collect()) == want


def test_pipeline_equals_brute_force(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(os.path.join(SF, "documents.parquet"))
    items = [norm(r.text) for r in spark.read.parquet(os.path.join(SF, "benchmark.parquet")).collect()]
    rows = {r.doc_id: r.text for r in docs.collect()}
    label = {i: c for i, _, c in brute_components(list(rows.items()), 5, 8, 10)}
    rows = {i: t for i, t in rows.items() if label[i] == i}
    first = {}
    for i in sorted(rows):
        w = words(rows[i])
        for j in range(len(w) - 12):
            first.setdefault(tuple(w[j : j + 13]), i)
    left = {}
    for i, t in rows.items():
        w = words(t)
        gone = {j + k for j in range(len(w) - 12) if first[tuple(w[j : j + 13])] < i for k in range(13)}
        if len(gone) < len(w) or not w:
            left[i] = " ".join(x for j, x in enumerate(w) if j not in gone) if gone else t
    grams = [{tuple(b[j : j + 5]) for j in range(len(b) - 4)} for b in items]

    def leaks(text):
        w = norm(text)
        own = {tuple(w[j : j + 5]) for j in range(len(w) - 4)}
        near = [b for b, g in zip(items, grams) if 2 * len(own & g) >= len(g) > 0]
        return any(similarity(w[s : s + len(b)], b) >= 0.8 for b in near for s in range(max(1, len(w) - len(b) + 1)))

    want = {i: t for i, t in left.items() if not leaks(t)}
    out = cp.run(spark, SF).collect()
    assert Counter(r.doc_id for r in out) == Counter(want.keys())
    import hashlib

    assert {r.doc_id: r.decoded_sha256 for r in out} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in want.items()}
    assert all(r.n_tokens == len(r.ids) for r in out)
    assert [n for n, _ in cp.STAGES] == ["language_id", "ngram_jaccard_join", "substring_dedup", "benchmark_decontamination", "byte_level_bpe"]


def test_stages_keep_the_columns(spark):
    import corpus_pipeline as cp

    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    none = spark.createDataFrame([], schema)
    odd = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (None, "a word", None, "s", 6)], schema)
    for _, stage in cp.STAGES[:-1]:
        assert stage(spark, none, SF).collect() == []
        assert stage(spark, odd, SF).columns == odd.columns
