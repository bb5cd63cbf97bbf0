"""Token counts, BPE, WARC and language ID: against the libraries, exact round trips, held-out
accuracy."""

import base64
import hashlib
import itertools
import random
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from llm.conftest import empty, frame

ODD = [
    "", " ", "  ", "a ", " a", "a  b", "\n", " \n a", "a\n\n b ", "▁ x", "a▁ b", "<s> hi </s>", "\t\ta", "x" * 40000, "ab " * 9000 + "  ", "日本語" * 7000, "\x00a", " \x00", "a\x1cb \x85c",
    "I'm we'll  it's\n\n x", " " * 700, "🎉é" * 30, "<0x0A>", "a \n", "\nb", "word\n", "d\r\n e", "　x  y", "123 4567 !!?? a_b", "ǅ ª º µ × ÷ ß",
]


def odd_texts(n=400):
    rnd = random.Random(5)
    alphabet = [" ", "  ", "\n", "a", "the", " The", "▁", "é", "ß", ".", "'s", "12", "\t", "日", "\x1c", "\xa0", "tion", "ing", "zz", "\x00"]
    return ODD + ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 40))) for _ in range(n)]


def test_token_counts_equal_the_library(spark):
    import sentencepiece

    from tickflow.llm.token_count import token_counts

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = [(i, t) for i, t in enumerate(odd_texts())] + [(9000, None), (5, "a  b"), (None, "x y")]
    got = token_counts(frame(spark, rows), path, limit=10).collect()
    want = Counter((i, len((t or "").encode()), n := len(model.encode(t or "")), n > 10) for i, t in rows)
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == want
    assert token_counts(empty(spark), path).collect() == []


@pytest.fixture(scope="module")
def library():
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library(spark, library):
    from tickflow.llm.prefix_bpe import encoded, round_trip

    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    rows = [(i, t) for i, t in enumerate(odd_texts())] + [(9000, None), (5, "a  b"), (None, "x y")]
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want, ids_want = Counter(), Counter()
    for i, t in rows:
        ids = library.encode_ordinary(t or "")
        want[i, len(ids), sha(struct.pack(f"<{len(ids)}I", *ids)), sha((t or "").encode())] += 1
        ids_want[i, tuple(ids)] += 1
    assert Counter(tuple(r) for r in round_trip(frame(spark, rows), path, pattern).collect()) == want
    assert Counter((r.doc_id, tuple(r.ids)) for r in encoded(frame(spark, rows), path, pattern).collect()) == ids_want
    assert round_trip(empty(spark), path, pattern).collect() == []


def test_appends_and_edits_equal_a_new_table(library):
    from tickflow.llm.prefix_bpe import PrefixTable, Ranks

    ranks = Ranks.load(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    rnd = random.Random(1)
    table = PrefixTable(ranks, b"hello world this is a test of the tables " * 20)
    saved = 0
    for _ in range(120):
        start = rnd.randint(0, len(table.data))
        end = min(len(table.data), start + rnd.randint(0, 6))
        done = table.replace(start, end, rnd.choice([b"", b"x", b"ing the", b"zzz q", "é日".encode()]))
        whole = PrefixTable(ranks, table.data)
        assert table.last == whole.last and table.ids() == whole.ids()
        saved += done < len(table.data) - start
    assert saved > 20  # edits meet the old table again
    table = PrefixTable(ranks, b"abc")
    table.append(b" defthe")
    assert table.last == PrefixTable(ranks, b"abc defthe").last
    table.become(b"abc dear")
    assert table.last == PrefixTable(ranks, b"abc dear").last
    for text in ("hello", " internationalisation", "aaaaaaaaaaaaaaaaaaaaaaaaa"):
        assert PrefixTable(ranks, text.encode()).ids() == library._encode_single_piece(text)


# ---------------------------------------------------------------- WARC


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", 1) for i, u, h in rows], "page_id bigint, url string, html string, digest string, length int").repartition(3)


def warc_rows():
    big = "<p>" + "same payload " * 20
    return [
        (5, "http://a/", big), (3, "http://b/ x\r\nEvil: 1", big), (9, None, big), (4, "http://c/é", "short"), (2, "http://d", "short"), (1, "http://e", None), (7, "http://f", ""),
        (8, "http://g", "\r\n\r\nWARC/1.1\r\n" * 30), (10, "http://h", "é" * 50), (11, "http://i", "é" * 50), (12, "http://j", "x" * 99), (13, "http://k", "x" * 99), (6, "http://l", "long " * 100_000), (None, "http://m", "no id " * 40),
    ]


def test_warc_round_trip(spark, tmp_path):
    from tickflow.llm.warc import read_archives, write_archives

    rows = warc_rows()
    write_archives(spark, pages(spark, rows), str(tmp_path / "w"))
    got = read_archives(spark, str(tmp_path / "w")).collect()
    first = {}
    for i, _, h in rows:
        b = (h or "").encode()
        if len(b) >= 100 and i is not None:
            first[b] = min(first.get(b, i), i)
    want = Counter()
    for i, _, h in rows:
        b = (h or "").encode()
        to = first.get(b)
        revisit = to is not None and to != i
        want[i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if revisit else "response", to if revisit else None, None if revisit else b] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in got) == want


def test_warc_files_are_plain_zstandard(spark, tmp_path):
    """Another reader sees the same records: dictionary first, then frame after frame."""
    import zstandard

    from tickflow.llm.warc import DICT_FRAME, _dictionary, frames, write_archives

    write_archives(spark, pages(spark, warc_rows() * 20), str(tmp_path / "w"))
    n = 0
    for f in (tmp_path / "w").glob("part-*"):
        data = f.read_bytes()
        found = list(frames(memoryview(data)))
        assert found[0][0] == DICT_FRAME and found[-1][2] == len(data)
        reader = zstandard.ZstdDecompressor(dict_data=_dictionary(data[8 : found[0][2]]))
        n += reader.stream_reader(data[found[0][2] :], read_across_frames=True).read().count(b"WARC-Record-ID: <urn:page:")
    assert n == 20 * len(warc_rows())


def test_damaged_archives_are_refused():
    import zstandard

    from tickflow.llm.warc import archive_records, parse_record, record_bytes, skippable

    payload = b"<p>payload</p>"
    record = record_bytes(1, "http://a", hashlib.sha256(payload).hexdigest(), len(payload), payload, None)
    assert parse_record(record)["payload"] == payload
    for damaged in (record[:-1], record.replace(b"WARC/1.1", b"WARC/9.9"), record.replace(b"payload<", b"PAYLOAD<"), record.replace(b"WARC-Date", b"X-Date"), record.replace(b"<urn:page", b"<urn:none"), b"nothing"):
        with pytest.raises(ValueError):
            parse_record(damaged)
    frame_bytes = zstandard.ZstdCompressor(write_checksum=True).compress(record)
    assert [r["page_id"] for r in archive_records(frame_bytes + skippable(0x184D2A50, b"") + frame_bytes)] == [1, 1]
    for damaged in (frame_bytes[:-3], b"\x00" * 20, frame_bytes + b"abc", frame_bytes + skippable(0x184D2A5D, b"late dictionary")):
        with pytest.raises((ValueError, zstandard.ZstdError)):
            list(archive_records(damaged))


def test_no_pages_no_records(spark):
    from tickflow.llm.warc import archived

    assert archived(spark, spark.createDataFrame([], "page_id bigint, url string, html string")).collect() == []


# ---------------------------------------------------------------- language ID


@pytest.mark.parametrize("n", [1, 2, 9])
def test_forward_backward_equals_enumeration(n):
    from tickflow.llm.langid import forward_backward

    rng = np.random.default_rng(n)
    e, t = rng.normal(size=(n, 3)), rng.normal(size=(3, 3))
    resets = rng.random(n) < 0.3
    resets[0] = True
    gamma, pairs = forward_backward(e, t, resets, pairs=True)
    want, want_pairs, total = np.zeros((n, 3)), np.zeros((3, 3)), 0.0
    for y in itertools.product(range(3), repeat=n):
        w = np.exp(sum(e[i, y[i]] for i in range(n)) + sum(t[y[i - 1], y[i]] for i in range(1, n) if not resets[i]))
        total += w
        for i in range(n):
            want[i, y[i]] += w
            if i and not resets[i]:
                want_pairs[y[i - 1], y[i]] += w
    assert np.allclose(gamma, want / total) and np.allclose(pairs, want_pairs / total)


def test_features_don_t_depend_on_the_batch():
    import pyarrow as pa

    from tickflow.llm.langid import Features

    texts = ["Über alles", "a", "bc", "", "Éa x", "word"]
    whole = Features(pa.array(texts, pa.large_string()))
    one = [Features(pa.array([t], pa.large_string())) for t in texts]
    assert whole.grams.tolist() == [g for f in one for g in f.grams.tolist()]
    assert whole.affixes.tolist() == [a for f in one for a in f.affixes.tolist()]
    assert whole.hashes.tolist() == [h for f in one for h in f.hashes.tolist()]


def languages(n=160):
    rnd = random.Random(8)
    parts = {"aa": ["ka", "to", "ri", "mu"], "bb": ["sch", "ung", "ein", "ver"], "cc": ["tion", "eau", "oix", "men"]}
    word = lambda lang: "".join(rnd.choice(parts[lang]) for _ in range(rnd.randint(1, 3)))
    rows = []
    for i in range(n):
        lang = rnd.choice(sorted(parts))
        rows.append((i, " ".join(word(lang) for _ in range(rnd.randint(3, 40))), lang))
    switched = " ".join([word("aa") for _ in range(30)] + [word("bb") for _ in range(60)])
    return rows, switched


def test_held_out_accuracy_and_code_switching(spark):
    from tickflow.llm.langid import accepted, identified, learn, spans

    rows, switched = languages()
    rows += [(1000, switched, "bb"), (1001, None, "aa"), (1002, "123 !!", "bb"), (1003, "", None), (1004, "kato rimu", None), (None, "kato rimu kato", "aa"), (1, rows[1][1], rows[1][2])]
    docs = spark.createDataFrame([(i, t, lang, 0.5, "clash") for i, t, lang in rows], "doc_id bigint, text string, lang string, score double, _0 string").repartition(3)
    got = identified(docs).collect()
    assert len(got) == len(rows)
    label = {i: lang for i, _, lang in rows}
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    tested = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 1000]
    assert len(tested) > 20 and sum(r.lang_pred == label[r.doc_id] for r in tested) / len(tested) >= 0.97
    by = {r.doc_id: r for r in got}
    assert {i: (by[i].lang_pred, by[i].score) for i in (1001, 1002, 1003)} == {i: ("und", 0.0) for i in (1001, 1002, 1003)}
    assert by[1004].lang_pred == "aa" and all(0 <= r.score <= 1 for r in got)
    model = learn(docs)
    runs = [(r.first_word, r.n_words, r.lang) for r in spans(docs.where("doc_id = 1000"), model).orderBy("first_word").collect()]
    assert runs[0][2] == "aa" and runs[-1][2] == "bb" and sum(n for _, n, _ in runs) == 90
    assert sum(n for _, n, lang in runs if lang == "aa") in range(28, 33)
    kept = accepted(docs, model, 0.4)
    assert kept.columns == docs.columns and Counter(r.doc_id for r in kept.collect()) == Counter(i for i, t, _ in rows if i not in (1001, 1002, 1003))


def test_nothing_to_learn_from(spark):
    from tickflow.llm.langid import accepted, identified, learn

    docs = spark.createDataFrame([(1, "some text", None), (2, None, "aa")], "doc_id bigint, text string, lang string")
    assert {(r.doc_id, r.lang_pred, r.score) for r in identified(docs).collect()} == {(1, "und", 0.0), (2, "und", 0.0)}
    assert [r.doc_id for r in accepted(docs, learn(docs), 0.4).collect()] == [1]
    assert identified(empty(spark)).collect() == []


def test_warc_payloads_pass_unsorted_and_are_read_in_small_batches(spark):
    """What an executor holds of the payloads: no sort of them, and few rows of a Parquet batch."""
    import contextlib
    import io

    from tickflow.llm.common import lean
    from tickflow.llm.warc import records

    lean(spark)
    assert int(spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")) <= 256
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with contextlib.redirect_stdout(io.StringIO()) as plan:
            records(pages(spark, warc_rows())).explain()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "ShuffledHashJoin" in plan.getvalue() and "Sort " not in plan.getvalue()
