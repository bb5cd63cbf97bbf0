"""Near copies and repeated passages against brute force."""

import hashlib
import itertools
from collections import Counter

import pytest

from llm.conftest import empty, frame, words


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text, k=4):
    w = words(ascii_lower(text))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def brute_components(rows, k, num, den):
    sets = [(i, shingles(t, k)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, x), (b, y) in itertools.combinations(sets, 2):
        if x and y and den * len(x & y) >= num * len(x | y):
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return Counter((i, len(s), find(i)) for i, s in sets)


@pytest.mark.parametrize("k,num,den,hot", [(4, 85, 100, 1 << 17), (5, 80, 100, 4), (2, 50, 100, 0)])
def test_components_equal_brute_force(spark, rows, k, num, den, hot):
    from tickflow.llm.jaccard_join import Similarity, linked

    got = linked(spark, frame(spark, rows), Similarity(words=k, num=num, den=den, hot=hot)).collect()
    assert Counter(tuple(r) for r in got) == brute_components(rows, k, num, den)


def brute_links(rows, k, num, den):
    named = {}
    for i, t in rows:
        if i is not None and shingles(t, k):
            named.setdefault(frozenset(shingles(t, k)), set()).add(i)
    out = Counter()
    for (x, p), (y, q) in itertools.combinations(named.items(), 2):
        if den * len(x & y) >= num * len(x | y):
            (a, n), (b, m) = sorted([(min(p), len(p)), (min(q), len(q))])
            out[a, b, n, m, len(x & y), len(x | y)] += 1
    return out


@pytest.mark.parametrize("k,num,den,hot,block", [(4, 85, 100, 1 << 17, 512), (2, 50, 100, 0, 3)])
def test_links_equal_brute_force(spark, rows, k, num, den, hot, block):
    """All links between different sets, those inside a component too."""
    from tickflow.llm.jaccard_join import Similarity, links

    base = [f"g{i}" for i in range(200)]  # a group in which all pairs link, with copies and a null doc_id
    group = [" ".join(base[:j] + [f"n{j}"] + base[j + 1 :]) for j in range(0, 80, 4)]
    more = [(5000 + i, t) for i, t in enumerate(group + group[:3])] + [(None, group[0]), (None, " ".join(base))]
    got = links(spark, frame(spark, rows + more), Similarity(words=k, num=num, den=den, hot=hot), block)
    want = brute_links(rows + more, k, num, den)
    assert Counter(tuple(r) for r in got.collect()) == want
    assert sum(a >= 5000 for a, *_ in want) == 190
    assert links(spark, empty(spark)).collect() == []


@pytest.mark.parametrize("bits", [0, 5])
def test_sets_that_share_a_name_stay_apart(spark, rows, bits):
    """With names of few bits most sets share one: components and links are the same."""
    from tickflow.llm.jaccard_join import Similarity, linked, links

    by = Similarity(words=3, num=60, den=100, bits=bits)
    assert Counter(tuple(r) for r in linked(spark, frame(spark, rows), by, block=3).collect()) == brute_components(rows, 3, 60, 100)
    assert Counter(tuple(r) for r in links(spark, frame(spark, rows), by).collect()) == brute_links(rows, 3, 60, 100)


def test_lists_of_many_groups_in_blocks(spark):
    """Groups of near copies that share lines with other groups, lists in blocks of three."""
    from tickflow.llm.jaccard_join import Similarity, linked

    lines = [" ".join(f"l{i}x{j}" for j in range(12)) for i in range(6)]
    rows = [(100 * g + c, " ".join([lines[g % 6], lines[(g + 1) % 6], *(f"g{g}y{j}" for j in range(20)), f"c{c}"])) for g in range(18) for c in range(4)]
    got = linked(spark, frame(spark, rows), Similarity(words=4, num=70, den=100, hot=0), block=3)
    assert Counter(tuple(r) for r in got.collect()) == brute_components(rows, 4, 70, 100)


def test_a_row_without_doc_id_links_nothing(spark):
    from tickflow.llm.jaccard_join import deduplicated, linked, Similarity

    t = "a b c d e f g h"
    docs = frame(spark, [(None, t), (3, t), (5, t), (7, None)])
    got = {(r.doc_id, r.component_id) for r in linked(spark, docs).collect()}
    assert got == {(None, None), (3, 3), (5, 3), (7, 7)}
    kept = deduplicated(spark, docs, Similarity())
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 3, 7] and kept.columns == docs.columns


def test_many_near_copies_of_one_text(spark):
    """A chain of edits: the ends share little, but links connect all."""
    from tickflow.llm.jaccard_join import linked

    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(40):
        rows.append((i, " ".join(base)))
        base[(7 * i) % 100] = f"e{i}"
    got = Counter(tuple(r) for r in linked(spark, frame(spark, rows)).collect())
    assert got == brute_components(rows, 4, 85, 100)
    assert len({c for _, _, c in got}) == 1


def test_components_of_a_path_and_loops(spark):
    from tickflow.llm.components import components

    edges = [(i, i + 1) for i in range(60)] + [(100, 100), (200, 201), (201, 200), (None, 5)]
    got = {r.node: r.label for r in components(spark, spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 200: 200, 201: 200}


def brute_removed(rows, width=13):
    first = {}
    for i, t in rows:
        w = words(t)
        for j in range(len(w) - width + 1):
            key = tuple(w[j : j + width])
            first[key] = min(first.get(key, i), i)
    out = Counter()
    for i, t in rows:
        w = words(t)
        gone = set()
        for j in range(len(w) - width + 1):
            if first[tuple(w[j : j + width])] < i:
                gone.update(range(j, j + width))
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out[i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    return out


@pytest.mark.parametrize("width", [13, 5, 4])
def test_removed_words_equal_brute_force(spark, rows, width):
    from tickflow.llm.substring_dedup import removed

    got = Counter(tuple(r) for r in removed(frame(spark, rows), width).collect())
    assert got == brute_removed(rows, width)


def test_cut_documents_keeps_columns_and_clean_texts(spark):
    from tickflow.llm.substring_dedup import cut_documents

    passage = " ".join(f"p{i}" for i in range(60))
    docs = frame(spark, [(1, f"Start here.\n{passage} end"), (2, f"other  {passage} tail"), (3, passage), (4, "clean  text\n"), (5, None), (None, passage)])
    out = cut_documents(docs)
    got = {(r.doc_id, r.text) for r in out.collect()}
    assert out.columns == docs.columns
    assert got == {(1, f"Start here.\n{passage} end"), (2, "other tail"), (4, "clean  text\n"), (5, None), (None, passage)}


def test_empty_tables(spark):
    from tickflow.llm.jaccard_join import deduplicated, linked, Similarity
    from tickflow.llm.substring_dedup import cut_documents, removed

    for out in (linked(spark, empty(spark)), removed(empty(spark)), cut_documents(empty(spark)), deduplicated(spark, empty(spark), Similarity())):
        assert out.collect() == []


def test_automaton_spans_equal_brute_force(spark):
    """The method named for the operator, on a bounded set of references."""
    import random

    from tickflow.llm.suffix_automaton import matched_spans

    rnd = random.Random(1)
    refs = [(i, " ".join(f"w{rnd.randrange(12)}" for _ in range(60))) for i in range(6)]
    texts = [(i, " ".join(f"w{rnd.randrange(12)}" for _ in range(80))) for i in range(10)] + [(10, refs[0][1]), (11, None), (12, "w1 w2")]
    got = {(r.doc_id, r.first_word, r.n_words) for r in matched_spans(frame(spark, texts), frame(spark, refs), least=4, shard_words=100).collect()}
    held = {tuple(w[j : j + 4]) for _, t in refs for w in [words(t)] for j in range(len(w) - 3)}
    want = set()
    for i, t in texts:
        w, j = words(t), 0
        covered = set()
        for j in range(len(w) - 3):
            if tuple(w[j : j + 4]) in held:
                covered.update(range(j, j + 4))
        runs = sorted(covered)
        for k, j in enumerate(runs):
            if k == 0 or runs[k - 1] != j - 1:
                end = j
                while end in covered:
                    end += 1
                want.add((i, j, end - j))
    assert got == want
