"""The operators without Python: URL filter, decontamination, hash ring, quality ledger."""

import random
import zlib
from collections import Counter

import pytest

from llm.conftest import empty, frame, words

URLS = [
    None, "", "no scheme", "http://", "http://NET/", "https://a.b.net", "https://a.b.net/x", "http://example.net/en/1?q", "http://www.example.net/en", "http://badexample.net/en/",
    "http://x.example.com/de/1", "http://x.example.com/en/2", "http://y.example.com/en/", "ftp://q.org/fr/#a/b", "http://q.org?x=/fr/", "a://b://c/d", "http://É.Example.ORG/fr/é",
]


def brute_url(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host, tail = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
        path = tail[: min([tail.index(c) for c in "?#" if c in tail], default=len(tail))]
    best = None
    for action, h, p in [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, action)
    return host, path, best


def pages(spark, urls):
    return spark.createDataFrame([(i, u, "x", "clash", True) for i, u in enumerate(urls)], "page_id bigint, url string, html string, host string, listed boolean")


@pytest.mark.parametrize("max_bits", [1 << 28, 1])
def test_urls_equal_brute_force(spark, max_bits):
    """Both ways: the cascade, and the join beyond the size bound."""
    from tickflow.llm.url_filter import judge

    rnd = random.Random(2)
    urls = URLS + [f"http://h{rnd.randrange(60)}.example.com/{rnd.choice(['de', 'en', 'fr'])}/{i}" for i in range(150)] + ["http://hot.example.com/en/"] * 100
    judged = [brute_url(u) for u in urls]
    listed = {h for h, _, best in judged if best and best[1] == "block"}
    want = Counter((i, h, p, best[0] if best else None, best[1] if best else "block" if h in listed else "allow") for i, (h, p, best) in enumerate(judged))
    got = Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in judge(spark, pages(spark, urls), max_bits=max_bits).collect())
    assert got == want


def test_url_filter_without_rows_or_list(spark):
    from tickflow.llm.url_filter import judge

    none = judge(spark, spark.createDataFrame([], "page_id bigint, url string")).collect()
    assert none == []
    assert {r.verdict for r in judge(spark, pages(spark, ["http://a.xyz/1", "http://b.xyz/2", None])).collect()} == {"allow"}


def test_cascade_is_exact_over_its_universe(spark):
    from pyspark.sql import functions as F

    from tickflow.llm.url_filter import build_cascade

    keys = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("key"), (F.col("id") % 9 == 0).alias("listed"))
    cascade = build_cascade(spark, keys)
    assert len(cascade.levels) > 2
    assert keys.where(cascade.listed(F.col("key")) != F.col("listed")).count() == 0


@pytest.mark.parametrize("copies", [0, 700])
def test_shards(spark, rows, copies):
    """Counts at most one apart, slots gapless, sizes and checksums; also if one key has most rows."""
    from tickflow.llm.hash_ring import sharded

    rows = rows + [(77, "hot text")] * copies + [(None, None)]
    got = sharded(spark, frame(spark, rows)).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    by = {s: sorted(r.slot for r in got if r.shard == s) for s in range(8)}
    assert all(slots == list(range(len(slots))) for slots in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert {(r.law, r.grown_shard) for r in got} == {("rows", None)}


def test_shards_follow_the_ring(spark):
    """Against the walk round the ring, arc by arc: as many rows of each arc in each shard."""
    from tickflow.llm.hash_ring import ring

    r = ring(spark, 3, 4).orderBy("arc").collect()
    assert [x.arc for x in r] == list(range(12)) and all(sorted(x.targets) == [0, 1, 2] for x in r)
    assert [x.point for x in r] == sorted(x.point for x in r)
    owners = [x.targets[0] for x in r]
    for x in r:  # the order in which the other shards are met clockwise
        walk = [owners[(x.arc + k) % 12] for k in range(12)]
        assert x.targets == list(dict.fromkeys(walk))


def test_an_empty_table_has_no_shards(spark):
    from tickflow.llm.hash_ring import sharded

    assert sharded(spark, empty(spark)).collect() == []


def brute_quality(text):
    w, text = words(text), text or ""
    at = {}
    for i in range(len(w) - 4):
        at.setdefault(tuple(w[i : i + 5]), []).append(i)
    covered = {i + k for places in at.values() if len(places) > 1 for i in places for k in range(5)}
    lines = [x for x in text.split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality_measurements_equal_brute_force(spark, rows):
    from tickflow.llm.quality import ablations, ledger, rated

    rows = rows + [(900, "a b c d e " * 4), (901, "x#y |z| <b>&\n\n \nx#y |z| <b>&\nq"), (902, "s s s s s s s s s s s"), (903, None)]
    docs = frame(spark, rows)
    got = rated(docs).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == Counter((i, *brute_quality(t)) for i, t in rows)
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert r.kept == (r.fail_bits == 0) and not (r.kept and r.base_failed)
    book = ledger(docs)
    bits = [r.fail_bits for r in book.collect()]
    for a in ablations(book, {"p": 5}).collect():
        bit = {"few_words": 1, "symbols": 4}[a.rule]
        assert (a.n_docs, a.n_kept, a.n_fail, a.n_fail_alone) == (len(bits), sum(b & 5 == 0 for b in bits), sum(b & bit != 0 for b in bits), sum(b & 5 == bit for b in bits))
    assert rated(empty(spark)).collect() == []


def norm(text):
    return [w for w in words((text or "").lower().translate({ord(c): None for c in ".,;:!?\"'()[]"})) if w]


def similarity(a, b):
    x, y = (Counter(tuple(s[i : i + 5]) for i in range(len(s) - 4)) for s in (a, b))
    return sum((x & y).values()) / max(1, sum((x | y).values()))


def test_leaks_equal_brute_force(spark):
    """Every item-sized window of every text: found are exactly the pairs with a window of 0.8
    (windows near 0.8 whose SimHash is farther than the radius aren't in the fixture)."""
    from tickflow.llm.decontaminate import clean, leaks

    rnd = random.Random(4)
    item = lambda n: [f"b{rnd.randrange(300)}" for _ in range(n)]
    items = [item(n) for n in (20, 25, 40, 60, 6, 12)]
    noise = lambda n: [f"w{rnd.randrange(500)}" for _ in range(n)]
    texts = [noise(40) + items[k] + noise(30) for k in range(6)]
    edited = list(items[3])
    edited[30] = "changed"
    texts += [noise(10) + edited + noise(5), noise(3) + items[2][:20] + ["put", "in"] + items[2][20:], items[1], items[0][:8] + noise(50), noise(100), items[0] + items[1]]
    docs = [(i, " ".join(t).capitalize() + ".") for i, t in enumerate(texts)] + [(50, None), (51, ""), (52, "two words"), (2, "a second text of a doc_id")]
    docs += [docs[0], (None, " ".join(items[2]))]
    bench = [(i, " ".join(t)) for i, t in enumerate(items)] + [(90, "too short"), (91, None), (92, " ".join(items[0]))]
    table = spark.createDataFrame([(i, t, 7) for i, t in bench], "item_id bigint, text string, n int")
    got = leaks(spark, frame(spark, docs), table).collect()
    want = set()
    for d, t in docs:
        w = norm(t)
        for k, b in enumerate(items):
            n = min(len(b), len(w))
            if any(similarity(w[s : s + n], b) >= 0.8 for s in range(len(w) - n + 1)):
                want.add((d, k))
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
    for r in got:
        texts_of = [norm(t) for d, t in docs if d == r.doc_id]
        assert any(abs(similarity(w[r.start_word : r.start_word + r.n_words], items[r.item_id]) - r.similarity) < 1e-9 for w in texts_of)
    kept = clean(spark, frame(spark, docs), table)
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter((d, t) for d, t in docs if not any((d, k) in want for k in range(6)) or t == "a second text of a doc_id")
    assert leaks(spark, empty(spark), table).collect() == [] == leaks(spark, frame(spark, docs), table.limit(0)).collect()


def test_leaks_in_another_order_equal_brute_force(spark):
    """Items whose parts are swapped or rotated inside a document: the best window is aligned with no
    part of the item."""
    from tickflow.llm.decontaminate import _dense, leaks

    rnd = random.Random(8)
    items = [[f"b{k}x{rnd.randrange(900)}" for _ in range(n)] for k, n in enumerate((50, 59, 100, 100, 64))]
    items.append(["r", "s"] * 10 + [f"q{i}" for i in range(30)])  # shingles that the item holds more than once
    cuts = [(0, 25), (1, 45), (1, 50), (2, 50), (3, 90), (4, 10), (5, 12), (5, 35)]
    noise = lambda n: [f"w{rnd.randrange(5000)}" for _ in range(n)]
    texts = [noise(30) + items[k][c:] + items[k][:c] + noise(20) for k, c in cuts]
    texts += [items[2][50:] + items[2][:50], items[2][50:] + items[2][3:50], items[0][25:] + noise(60) + items[0][:25], noise(90)]
    docs = [(i, " ".join(t)) for i, t in enumerate(texts)]
    table = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id bigint, text string")
    want = {}
    for d, t in enumerate(texts):
        for k, b in enumerate(items):
            n = min(len(b), len(t))
            best, start = max((similarity(t[s : s + n], b), -s) for s in range(len(t) - n + 1))
            if best >= 0.8:
                want[d, k] = (-start, round(best, 9))
    got = leaks(spark, frame(spark, docs), table).collect()
    assert {(r.doc_id, r.item_id): (r.start_word, round(r.similarity, 9)) for r in got} == want
    assert len(got) == len(want) and {d for d, _ in want} == set(range(len(cuts) + 2))

    # the windows themselves: all that hold enough seeds, each once
    rows, dense = [], set()
    for i in range(60):
        size, n = rnd.randrange(5, 60), rnd.randrange(5, 30)
        p = [j for j in range(size - 4) if rnd.random() < (0.8, 0.95)[i % 2]]
        m = min(size, n) - 4
        need = -(-4 * (m + n - 4) // 9)
        rows.append((i, 0, size, n, p))
        dense |= {(i, n, s) for s in range(max(0, size - n) + 1) if sum(s <= j < s + m for j in p) >= need}
    got = _dense(spark.createDataFrame(rows, "doc_id bigint, tid bigint, size int, n int, p array<int>")).collect()
    assert Counter((r.doc_id, r.n, r.start) for r in got) == Counter(dense)


def test_multi_index_misses_nothing_within_the_radius(spark):
    from tickflow.llm.decontaminate import RADIUS, _blocks

    rnd = random.Random(6)
    base = [rnd.getrandbits(64) for _ in range(40)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    probes = []
    for b in base:
        for _ in range(10):
            x = b
            for bit in rnd.sample(range(64), rnd.randint(0, RADIUS)):
                x ^= 1 << bit
            probes.append(x)
    left = spark.createDataFrame([(i, signed(x)) for i, x in enumerate(base)], "i int, print bigint")
    right = spark.createDataFrame([(i, signed(x)) for i, x in enumerate(probes)], "j int, print bigint")
    found = _blocks(left, True).select("i", "block", "value").join(_blocks(right, False).select("j", "block", "value"), ["block", "value"]).select("i", "j").distinct()
    pairs = {(r.i, r.j) for r in found.collect()}
    want = {(i, j) for i, x in enumerate(base) for j, y in enumerate(probes) if (x ^ y).bit_count() <= RADIUS}
    assert want <= pairs
