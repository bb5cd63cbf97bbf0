"""WARC archives as Zstandard files: one frame per record, the dictionary in a leading skippable
frame.

Writing. Every partition becomes one archive: the dictionary frame, then a frame per record. The
files are written by Spark's own text sink (so they land in any shared store, and a lost task is
committed once): a row is a frame's bytes and the line separator is an empty skippable frame,
which every Zstandard reader passes over. Records with equal payloads of at least
`min_revisit` bytes are written once, as the response with the smallest page_id; the others are
revisit records that refer to it and carry no payload. Which payloads repeat is found from
digests, pre-aggregated before any shuffle; a hot digest's rows are split by the adaptive
skew join.

Reading. A file's frames are walked by their block headers, so no byte is decoded twice; each is
decoded alone with the dictionary and its record validated: version line, required headers,
Content-Length against the block, the end mark, the payload against its digest. Anything else
raises ValueError.

Defined results: null html is an empty payload; a null url is written without a target; a null
page_id reads back as null (and is never referred to); rows that repeat the smallest page_id of
a payload are responses all of them; empty tables write and read no records. Columns beyond
page_id, url, html are not read. The dictionary is trained on SAMPLES payload heads (the smallest
hashes of page_id) and only affects the size of the files.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickflow.llm.common import column, sliced
from tickflow.session import checkpoint_dir

MIN_REVISIT = 100
SAMPLES, SAMPLE_CHARS, DICT_BYTES = 256, 8192, 32768
LEVEL = 3

# Fixed values of the formats
SKIPPABLE = 0x184D2A50  # .. 0x184D2A5F
DICT_FRAME = 0x184D2A5D
ZSTD_FRAME = 0xFD2FB528
SEPARATOR = struct.pack("<II", SKIPPABLE, 0)  # an empty skippable frame: ASCII bytes only
DATE = "1970-01-01T00:00:00Z"
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REQUIRED = ("warc-type", "warc-record-id", "warc-date", "content-length", "warc-payload-digest")


# ---------------------------------------------------------------- records


def record_bytes(page_id: int | None, url: str | None, digest: str, length: int, payload: bytes | None, refers_to: int | None) -> bytes:
    """A response record (payload given) or a revisit record (None) with its HTTP block."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % length
    block = http + (payload or b"")
    kind = "response" if payload is not None else "revisit"
    head = [VERSION.decode(), f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{_id(page_id)}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%')}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{_id(refers_to)}>", f"WARC-Profile: {PROFILE}"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def _id(value: int | None) -> str:
    return "none" if value is None else str(value)


def _page(header: str) -> int | None:
    if not (header.startswith("<urn:page:") and header.endswith(">")):
        raise ValueError(f"not a record id: {header!r}")
    value = header[len("<urn:page:") : -1]
    return None if value == "none" else int(value)


def parse_record(data: bytes) -> dict:
    """The validated record: page_id, url, record_type, refers_to, payload_bytes, payload_digest,
    payload (None for a revisit)."""
    end = data.find(b"\r\n\r\n")
    if end < 0:
        raise ValueError("a record without an end of its header")
    first, *lines = data[:end].split(b"\r\n")
    if first != VERSION:
        raise ValueError(f"not a version line: {first[:20]!r}")
    headers = {}
    for line in lines:
        name, colon, value = line.decode().partition(":")
        if not colon:
            raise ValueError(f"not a header line: {line[:40]!r}")
        headers[name.strip().lower()] = value.strip()
    missing = [name for name in REQUIRED if name not in headers]
    if missing:
        raise ValueError(f"headers missing: {missing}")
    block = data[end + 4 : -4]
    if data[-4:] != b"\r\n\r\n" or int(headers["content-length"]) != len(block):
        raise ValueError("the block's length isn't the header's")
    http, mark, payload = block.partition(b"\r\n\r\n")
    length = [int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
    if not mark or len(length) != 1:
        raise ValueError("the HTTP header is damaged")
    algorithm, _, digest = headers["warc-payload-digest"].partition(":")
    kind = headers["warc-type"]
    out = {"page_id": _page(headers["warc-record-id"]), "url": headers.get("warc-target-uri"), "record_type": kind, "refers_to": None, "payload_bytes": length[0], "payload_digest": digest, "payload": None}
    if kind == "response":
        if len(payload) != length[0] or algorithm != "sha256" or hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError("the payload isn't what its length and digest say")
        out["payload"] = payload
    elif kind == "revisit":
        if payload or "warc-refers-to" not in headers:
            raise ValueError("a revisit with a payload, or without the record it refers to")
        out["refers_to"] = _page(headers["warc-refers-to"])
    else:
        raise ValueError(f"unknown record type: {kind}")
    return out


# ---------------------------------------------------------------- frames


def skippable(magic: int, content: bytes) -> bytes:
    return struct.pack("<II", magic, len(content)) + content


def frames(data: memoryview):
    """(magic, start, end) of every frame, from the block headers alone."""
    import zstandard

    at = 0
    while at < len(data):
        if len(data) - at < 8:
            raise ValueError("a truncated frame")
        magic, size = struct.unpack_from("<II", data, at)
        if SKIPPABLE <= magic <= SKIPPABLE + 15:
            end = at + 8 + size
        elif magic == ZSTD_FRAME:
            head = data[at : at + 18]
            params = zstandard.get_frame_parameters(head)
            end, last = at + zstandard.frame_header_size(head), False
            while not last:
                if end + 3 > len(data):
                    raise ValueError("a truncated frame")
                block = int.from_bytes(data[end : end + 3], "little")
                last = bool(block & 1)
                end += 3 + (1 if (block >> 1) & 3 == 1 else block >> 3)  # a run-length block holds one byte
            end += 4 if params.has_checksum else 0
        else:
            raise ValueError(f"not a frame: {magic:#x}")
        if end > len(data):
            raise ValueError("a truncated frame")
        yield magic, at, end
        at = end


def _dictionary(content: bytes):
    import zstandard

    kind = zstandard.DICT_TYPE_FULLDICT if content[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
    return zstandard.ZstdCompressionDict(content, dict_type=kind)


def archive_records(data: bytes):
    """The records of one archive."""
    import zstandard

    view, decoder = memoryview(data), zstandard.ZstdDecompressor()
    for magic, start, end in frames(view):
        if magic == DICT_FRAME:
            if start:
                raise ValueError("a dictionary that isn't the archive's first frame")
            decoder = zstandard.ZstdDecompressor(dict_data=_dictionary(bytes(view[start + 8 : end])))
        elif magic == ZSTD_FRAME:
            yield parse_record(decoder.decompressobj().decompress(view[start:end]))


# ---------------------------------------------------------------- Spark


def train_dictionary(pages: DataFrame) -> bytes:
    """At most DICT_BYTES, from the heads of SAMPLES payloads."""
    import zstandard

    heads = pages.select(F.xxhash64(column(pages, "page_id")).alias("h"), F.substring(column(pages, "html"), 1, SAMPLE_CHARS).alias("head")).where("head <> ''")
    # the hashes alone are ranked; then only the chosen rows' heads come to the driver
    last = heads.select("h").orderBy("h").limit(SAMPLES).agg(F.max("h")).first()[0]
    samples = [r["head"].encode() for r in heads.where(F.col("h") <= F.lit(last)).limit(SAMPLES).collect()]
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too few samples to train on: their text itself
        return b"".join(samples)[-DICT_BYTES:]


def records(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """page_id, url, payload (null for a revisit), digest, length, refers_to of every page."""
    html = F.coalesce(column(pages, "html"), F.lit("")).cast("binary")
    rows = pages.select(column(pages, "page_id").cast("bigint").alias("page_id"), column(pages, "url").alias("url"), html.alias("payload"))
    rows = rows.withColumns({"digest": F.sha2("payload", 256), "length": F.octet_length("payload").cast("bigint")})
    repeated = rows.where(F.col("length") >= min_revisit).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first")
    # the payloads pass by a table of the repeated digests of their partition, unsorted
    rows = rows.join(repeated.hint("shuffle_hash"), "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return rows.select("page_id", "url", F.when(~revisit, F.col("payload")).alias("payload"), "digest", "length", F.when(revisit, F.col("first")).alias("refers_to"))


def write_archives(spark: SparkSession, pages: DataFrame, path: str, min_revisit: int = MIN_REVISIT) -> None:
    """One archive per partition under `path`."""
    dictionary = train_dictionary(pages)

    def pack(batches):
        import zstandard

        encoder = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(dictionary)) if dictionary else zstandard.ZstdCompressor(level=LEVEL)
        begun = not dictionary
        for batch in batches:
            for piece in sliced(batch, "payload"):
                out = [] if begun or not len(piece) else [skippable(DICT_FRAME, dictionary)]
                begun = begun or bool(out)
                for row in piece.to_pylist():
                    out.append(encoder.compress(record_bytes(row["page_id"], row["url"], row["digest"], row["length"], row["payload"], row["refers_to"])))
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["frame"])

    packed = records(pages, min_revisit).mapInArrow(pack, "frame binary")
    packed.select(F.col("frame").cast("string")).write.option("lineSep", SEPARATOR.decode("ascii")).text(path)


RECORD = "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary"


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """The records of every archive under `path`, validated; one file is read by one task."""
    files = spark.read.format("binaryFile").load(path).select("content")
    fields = RECORD if with_payload else RECORD.removesuffix(", payload binary")
    names = [f.split()[0] for f in fields.split(", ")]
    kinds = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    types = [kinds[f.split()[1]] for f in fields.split(", ")]

    def unpack(batches):
        for batch in batches:
            for content in batch.column("content"):
                out, held = [], 0
                for record in archive_records(content.as_py()):
                    out.append([record[name] for name in names])
                    held += len(record["payload"] or b"") + 200 if with_payload else 200
                    if held > 4_000_000:
                        yield _batch(out, names, types)
                        out, held = [], 0
                if out:
                    yield _batch(out, names, types)

    return files.mapInArrow(unpack, fields)


def _batch(rows, names, types) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], list(names))


def archived(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """The query's digest: write the archives to the shared folder and read them back."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm-warc-{uuid.uuid4().hex}"
    write_archives(spark, pages, path)
    return read_archives(spark, path, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""
