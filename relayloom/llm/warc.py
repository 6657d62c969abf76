"""WARC archives of pages: segmented records, written by Spark's text writer and read back whole.

Writing.  A page is an HTTP response; payloads of ``chunk_from`` bytes or more use chunked transfer
framing.  A record block over ``segment_bytes`` is cut into segments: the first keeps the record's
type and has ``WARC-Segment-Number: 1``, the rest are ``continuation`` records that name it in
``WARC-Segment-Origin-ID``; the last has ``WARC-Segment-Total-Length``.  Every record ends with two
line ends, which is the text writer's line separator, so its files are WARC files as they stand,
in any store that Spark writes to.

Of pages with equal payloads of at least ``revisit_from`` bytes the largest ``page_id`` is a
response; the others are ``revisit`` records with the headers and digest only.

Reading.  Files are parsed by ``Content-Length``.  Segments are grouped by their origin's id and
ordered by number; a gap, a wrong total length or a wrong digest is an error.  Then the framing is
decoded.

Null html is an empty payload.  Rows with equal ``page_id`` are archived each (the record id has
a hash of the payload, and a number from the second row with both equal on).  Null ids are archived with an
empty id and read back as null.  Further columns are not read.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relayloom.llm.common import scratch, written

RECORD = "record_id string, type string, page string, refers_to string, digest string, origin string, segment int, total long, block binary"
RESULT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
EOL = "\r\n"


def _cat(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _hex(n: Column) -> Column:
    return F.lower(F.hex(n))


def _framed(payload: Column, chunk: int) -> Column:
    """Chunked transfer framing of a binary column."""
    size = F.octet_length(payload)
    count = F.ceil(size / chunk).cast("int")
    piece = lambda i: F.substring(payload, i * chunk + 1, F.lit(chunk))
    parts = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.concat(F.to_binary(_cat(_hex(F.octet_length(piece(i))), EOL), F.lit("utf-8")), piece(i), F.to_binary(F.lit(EOL), F.lit("utf-8"))))
    return F.concat(F.array_join(parts.cast("array<string>"), "").cast("binary"), F.to_binary(F.lit("0" + EOL + EOL), F.lit("utf-8")))


def records(pages: DataFrame, revisit_from: int = 1000, chunk_from: int = 4096, chunk: int = 16384, segment_bytes: int = 65536) -> DataFrame:
    """(record string): a WARC record a row, without the line ends that close it; its bytes need not be UTF-8."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    equal = rows.where(F.octet_length("payload") >= revisit_from).select("page_id", "digest").groupBy("digest").agg(F.max("page_id").alias("to"), F.count("*").alias("n")).where("n > 1").drop("n")
    equal = written(equal, "equal-payloads").withColumn("large", F.lit(True))
    rows = rows.withColumn("large", F.octet_length("payload") >= revisit_from)
    rows = rows.join(equal, ["digest", "large"], "left").withColumn("refers", F.when(F.col("to") > F.col("page_id"), F.col("to")))
    rows = _numbered(rows)
    rows = rows.withColumn("name", _cat(_record_name(F.col("page_id"), F.col("digest")), F.when(F.col("copy") > 1, _cat(".", F.col("copy").cast("string"))).otherwise(F.lit(""))))
    revisit = F.col("refers").isNotNull()
    framed = F.octet_length("payload") >= chunk_from
    head = _cat("HTTP/1.1 200 OK", EOL, "Content-Type: text/html; charset=utf-8", EOL, F.when(framed & ~revisit, F.lit("Transfer-Encoding: chunked")).otherwise(_cat("Content-Length: ", F.octet_length("payload").cast("string"))), EOL, EOL)
    body = F.when(revisit, F.lit("").cast("binary")).when(framed, _framed(F.col("payload"), chunk)).otherwise(F.col("payload"))
    rows = rows.withColumn("block", F.concat(F.to_binary(head, F.lit("utf-8")), body)).drop("payload")
    rows = rows.withColumn("size", F.octet_length("block")).withColumn("last", F.greatest(F.lit(1), F.ceil(F.col("size") / segment_bytes).cast("int")))
    # The block is cut before its rows are made, so a row holds its own part only.
    cut = F.transform(F.sequence(F.lit(1), F.col("last")), lambda i: F.substring(F.col("block"), (i - 1) * segment_bytes + 1, F.lit(segment_bytes)))
    rows = rows.withColumn("parts", cut).drop("block").select("*", F.posexplode_outer("parts").alias("segment", "part")).drop("parts").withColumn("segment", F.col("segment") + 1)
    part = F.col("part")
    first, many = F.col("segment") == 1, F.col("last") > 1
    page = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    line = lambda name, value, when=None: (_cat(name + ": ", value, EOL) if when is None else F.when(when, _cat(name + ": ", value, EOL)).otherwise(F.lit("")))
    header = F.concat(
        F.lit("WARC/1.1" + EOL),
        line("WARC-Type", F.when(~first, F.lit("continuation")).when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", _cat("<urn:page:", F.col("name"), ":", F.col("segment").cast("string"), ">")),
        line("WARC-Date", F.lit("2024-01-01T00:00:00Z")),
        line("WARC-Target-URI", F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", "")),
        line("Content-Type", F.lit("application/http; msgtype=response"), first),
        line("WARC-Page-ID", page, first),
        line("WARC-Payload-Digest", _cat("sha1:", F.col("digest")), first),
        line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), first & revisit),
        line("WARC-Refers-To", _cat("<urn:page:", _record_name(F.col("refers"), F.col("digest")), ":1>"), first & revisit),
        line("WARC-Segment-Number", F.col("segment").cast("string"), many),
        line("WARC-Segment-Origin-ID", _cat("<urn:page:", F.col("name"), ":1>"), ~first),
        line("WARC-Segment-Total-Length", F.col("size").cast("string"), many & (F.col("segment") == F.col("last"))),
        line("Content-Length", F.octet_length(part).cast("string")),
        F.lit(EOL),
    )
    return rows.select(F.concat(F.to_binary(header, F.lit("utf-8")), part).cast("string").alias("record"))


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with copy: 1, or from 1 on among rows with equal page_id and digest; only those are shuffled."""
    again = rows.groupBy("page_id", "digest").agg(F.count("*").alias("n")).where("n > 1").select(F.col("page_id").alias("p"), F.col("digest").alias("d"))
    again = written(again, "repeated-pages")
    if not again.limit(1).count():
        return rows.withColumn("copy", F.lit(1))
    same = F.col("page_id").eqNullSafe(F.col("p")) & (F.col("digest") == F.col("d"))
    number = F.row_number().over(Window.partitionBy("page_id", "digest").orderBy("url"))
    return rows.join(again, same, "left_anti").withColumn("copy", F.lit(1)).unionByName(rows.join(again, same, "left_semi").withColumn("copy", number))


def _record_name(page_id: Column, digest: Column) -> Column:
    return _cat(F.coalesce(page_id.cast("string"), F.lit("")), ":", digest)


def write_archives(pages: DataFrame, path: str, records_per_file: int = 1000, **how: int) -> None:
    """Gzipped WARC files under ``path``, at most ``records_per_file`` records each."""
    records(pages, **how).write.option("lineSep", EOL + EOL).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def parse(data: bytes) -> Iterator[dict]:
    """Records of a WARC file, gzipped or not."""
    data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:end].split(b"\r\n")
        if not version.startswith(b"WARC/"):
            raise ValueError(f"no record at byte {at}")
        headers = {k.strip().lower().decode(): v.strip().decode("utf-8", "replace") for k, _, v in (x.partition(b":") for x in lines)}
        size = int(headers["content-length"])
        block = data[end + 4 : end + 4 + size]
        at = end + 4 + size
        if len(block) != size or data[at : at + 4] != b"\r\n\r\n":
            raise ValueError(f"record {headers.get('warc-record-id')} is cut off")
        at += 4
        total = headers.get("warc-segment-total-length")
        yield {
            "record_id": headers["warc-record-id"], "type": headers["warc-type"], "page": headers.get("warc-page-id"), "refers_to": headers.get("warc-refers-to"), "digest": headers.get("warc-payload-digest"),
            "origin": headers.get("warc-segment-origin-id", headers["warc-record-id"]), "segment": int(headers.get("warc-segment-number", 1)), "total": int(total) if total else None, "block": block,
        }


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("record_id", pa.string()), ("type", pa.string()), ("page", pa.string()), ("refers_to", pa.string()), ("digest", pa.string()), ("origin", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), ("block", pa.binary())])
    for batch in batches:
        for content in batch.column("content"):
            rows = []
            for row in parse(content.as_py()):
                rows.append(row)
                if len(rows) >= 200:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)


def unframed(block: bytes) -> tuple[bytes | None, int]:
    """The payload of an HTTP response and its length; of one without a body, the length that it names."""
    head, _, body = block.partition(b"\r\n\r\n")
    named = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}
    if named.get(b"transfer-encoding", b"").lower() != b"chunked":
        return body, int(named[b"content-length"])
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if size == 0:
            break
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk has a wrong length")
        out.append(body[at : at + size])
        at += size + 2
    payload = b"".join(out)
    return payload, len(payload)


def reassembled(kinds: pd.Series, blocks: pd.Series, numbers: pd.Series, totals: pd.Series, digests: pd.Series) -> pd.DataFrame:
    """Payload length and payload of records whose segments are in order."""
    out = []
    for kind, parts, number, total, digest in zip(kinds, blocks, numbers, totals, digests, strict=True):
        block = b"".join(parts)
        if list(number) != list(range(1, len(number) + 1)) or (len(number) > 1 and (pd.isna(total) or int(total) != len(block))):
            raise ValueError(f"segments {list(number)} with {len(block)} of {total} bytes")
        payload, size = unframed(block)
        if kind == "revisit":
            out.append((size, None))
            continue
        if len(payload) != size or "sha1:" + hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError(f"a payload of {len(payload)} bytes does not match {digest}")
        out.append((size, payload))
    return pd.DataFrame(out, columns=["payload_bytes", "payload"])


def read_archives(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """RESULT rows of the archives under ``path``, and the payload of responses on request."""
    files = spark.read.format("binaryFile").load(path).select("content")
    found = files.mapInArrow(_parsed, RECORD)
    whole = found.groupBy("origin").agg(
        F.sort_array(F.collect_list(F.struct("segment", "block"))).alias("parts"),
        *[F.max(c).alias(c) for c in ("page", "refers_to", "digest", "total")],
        F.max(F.when(F.col("type") != "continuation", F.col("type"))).alias("type"),
    )
    payload = F.pandas_udf(reassembled, "payload_bytes long, payload binary")("type", "parts.block", "parts.segment", "total", "digest")
    whole = whole.select("page", "refers_to", "digest", "type", payload.alias("p"))
    return whole.select(
        F.when(F.col("page") != "", F.col("page").cast("long")).alias("page_id"), "p.payload_bytes", F.expr("substring(digest, 6)").alias("payload_digest"), F.col("type").alias("record_type"),
        F.nullif(F.regexp_extract(F.coalesce("refers_to", F.lit("")), "^<urn:page:([0-9-]+):", 1), F.lit("")).cast("long").alias("refers_to"), *(["p.payload"] if with_payload else []),
    )


def archive_round_trip(pages: DataFrame) -> DataFrame:
    path = scratch(pages.sparkSession, "warc")
    write_archives(pages, path)
    return read_archives(pages.sparkSession, path)
