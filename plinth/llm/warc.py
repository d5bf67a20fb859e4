"""WARC archives as a chunked record table.

Writing: each page is one record. A payload of more than `chunk` bytes is written as segments (a first record and
`continuation` records, as WARC 1.1 has them), so no output row is longer than a chunk and a header. Of records with
equal payloads of at least MIN_REVISIT bytes, that with the largest page_id is a `response` and the others are
`revisit` records that refer to it, without payload. Spark's text writer puts the rows, ended by CR LF CR LF, into
gzip files on any file system that Spark reaches.

Reading: gzip files aren't split, so their blocks come in order. A parser is fed the bytes and keeps a header, a chunk
at most and a running digest; it gives rows (record_id, chunk_no, …, digest so far), never a whole record.

* A null or empty html is an empty payload, a null url is left out, CR and LF in a url become spaces.
* Rows without page_id come as null and count as smaller than any; equal payloads of such rows only are all responses.
  Rows that repeat the largest page_id of their group are all responses.
* Payloads are equal if length and SHA-256 are. Groups of any size are reduced by partial aggregation, and the joined
  side (groups of more than one row) is broadcast only within a counted bound.
* Very long payloads take more segments and chunks, not longer ones. An empty table gives no records; further columns
  are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.llm.shared import materialize, scratch_path, ship, small_side

CHUNK = 1 << 16
MIN_REVISIT = 1000
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = "urn:plinth:page:"


def records(pages: DataFrame, chunk: int = CHUNK, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """(record): one row for each WARC record, without its final CR LF CR LF; a page's segments follow each other."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumns({"bytes": F.octet_length("payload").cast("long"), "same": F.sha2("payload", 256)})
    large = rows.filter(F.col("bytes") >= MIN_REVISIT).select("page_id", "bytes", "same")
    heads = large.groupBy("same", "bytes").agg(F.max("page_id").alias("head"), F.count("*").alias("n")).filter("n > 1 and head is not null")
    heads = materialize(heads.select("same", "bytes", "head"), "warc-heads")
    rows = rows.join(small_side(heads), ["same", "bytes"], "left")
    revisit = F.col("head").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("head"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END)).cast("binary")
    rows = rows.withColumns({"revisit": revisit, "http": http})
    segments = F.when(F.col("revisit"), F.lit(1)).otherwise(F.greatest(F.ceil(F.col("bytes") / chunk), F.lit(1))).cast("int")
    rows = rows.withColumn("segments", segments).withColumn("no", F.explode(F.sequence(F.lit(1), "segments")))
    first, last = F.col("no") == 1, F.col("no") == F.col("segments")
    part = F.substring(F.col("payload"), (F.col("no") - 1) * chunk + 1, F.lit(chunk))
    block = F.when(F.col("revisit"), F.lit("").cast("binary")).when(first, F.concat("http", part)).otherwise(part)
    split = F.col("segments") > 1
    page = F.coalesce(F.col("page_id").cast("string"), F.lit("null"))
    own = F.concat(F.lit(f"<{_ID}"), page, F.lit(">"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value)
    header = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.1"),
        line("WARC-Type", F.when(F.col("revisit"), "revisit").when(first, "response").otherwise("continuation")),
        line("WARC-Record-ID", F.when(first, own).otherwise(F.concat(F.lit(f"<{_ID}"), page, F.lit(":"), F.col("no").cast("string"), F.lit(">")))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.regexp_replace("url", "[\r\n]", " ")),
        F.when(first, line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.sha1("payload")))),
        F.when(F.col("revisit"), line("WARC-Profile", F.lit(PROFILE))),
        F.when(F.col("revisit"), line("WARC-Refers-To", F.concat(F.lit(f"<{_ID}"), F.col("head").cast("string"), F.lit(">")))),
        F.when(F.col("revisit"), line("X-Payload-Length", F.col("bytes").cast("string"))),
        F.when(split, line("WARC-Segment-Number", F.col("no").cast("string"))),
        F.when(split & ~first, line("WARC-Segment-Origin-ID", own)),
        F.when(split & last, line("WARC-Segment-Total-Length", (F.col("bytes") + F.octet_length("http")).cast("string"))),
        F.when(~F.col("revisit"), line("Content-Type", F.lit("application/http; msgtype=response"))),
        line("Content-Length", F.octet_length("part").cast("string")),
    )
    rows = rows.withColumn("part", block)
    return rows.select(F.concat(header, F.lit(END), F.col("part").cast("string")).alias("record"))


def write(pages: DataFrame, path: str, chunk: int = CHUNK) -> None:
    records(pages, chunk).write.option("lineSep", END).option("compression", "gzip").text(path)


class Parser:
    """Fed the bytes of an archive in order; yields a record's chunks as they fill.

    A chunk: record id, type, the id referred to, chunk number, data, payload bytes so far, digest so far, last.
    """

    def __init__(self, chunk: int = CHUNK) -> None:
        self.chunk = chunk
        self.buffer = bytearray()
        self.left = -1  # of the block; -1: in a header
        self.skip = 0  # of the end of a record
        self.record: dict | None = None

    def feed(self, data: bytes) -> Iterator[tuple]:
        self.buffer += data
        while True:
            if self.skip:
                n = min(self.skip, len(self.buffer))
                del self.buffer[:n]
                self.skip -= n
                if self.skip:
                    return
            if self.left < 0:
                # blank lines may stand before a header, as the reader of lines adds one at the end of a file
                while self.buffer[:2] == b"\r\n":
                    del self.buffer[:2]
                end = self.buffer.find(b"\r\n\r\n")
                if end < 0:
                    return
                head = bytes(self.buffer[:end]).decode("utf-8", "replace")
                del self.buffer[: end + 4]
                yield from self._begin(head)
                continue
            n = min(self.left, len(self.buffer), self.chunk)
            part = bytes(self.buffer[:n])
            del self.buffer[:n]
            self.left -= n
            yield from self._body(part)
            if self.left:
                if not self.buffer:
                    return
                continue
            self.left, self.skip = -1, 4
            if self.record and self.record["closing"]:
                yield self._chunk(True)
                self.record = None

    def _begin(self, head: str) -> Iterator[tuple]:
        version, *lines = head.split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"not a WARC header: {version[:40]!r}")
        h = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
        self.left = int(h["content-length"])
        kind = h["warc-type"]
        if kind == "revisit":
            digest = h["warc-payload-digest"].removeprefix("sha1:")
            yield (h["warc-record-id"], kind, h.get("warc-refers-to"), 0, b"", int(h.get("x-payload-length", 0)), digest, True)
        elif kind == "response":
            self.record = {"id": h["warc-record-id"], "http": bytearray(), "data": bytearray(), "no": 0, "bytes": 0, "sha": hashlib.sha1(), "closing": "warc-segment-number" not in h}
        elif kind == "continuation" and self.record and self.record["id"] == h["warc-segment-origin-id"]:
            self.record["closing"] = "warc-segment-total-length" in h

    def _body(self, part: bytes) -> Iterator[tuple]:
        r = self.record
        if r is None:
            return
        if r["http"] is not None:
            r["http"] += part
            end = r["http"].find(b"\r\n\r\n")
            if end < 0:
                return
            part, r["http"] = bytes(r["http"][end + 4 :]), None
        r["sha"].update(part)
        r["bytes"] += len(part)
        r["data"] += part
        while len(r["data"]) > self.chunk:
            yield self._chunk(False)

    def _chunk(self, last: bool) -> tuple:
        r = self.record
        data = bytes(r["data"][: self.chunk])
        del r["data"][: self.chunk]
        r["no"] += 1
        return (r["id"], "response", None, r["no"] - 1, data, r["bytes"] - len(r["data"]), r["sha"].hexdigest(), last)


_CHUNK_SCHEMA = "record_id string, record_type string, refers_to string, chunk_no int, data binary, bytes_so_far long, sha1_so_far string, last boolean"


def read(spark: SparkSession, path: str, chunk: int = CHUNK) -> DataFrame:
    """The chunk table of all archives below a path. sha1_so_far covers the bytes fed so far, the whole payload in the
    row marked `last`. Blocks are read up to the next CR LF CR LF, so those of other writers may come in longer rows."""
    ship(spark)
    blocks = spark.read.option("lineSep", END).text(path).select(F.col("value").cast("binary").alias("value"), F.input_file_name().alias("file"))
    names = [x.split()[0] for x in _CHUNK_SCHEMA.split(", ")]
    types = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.binary(), pa.int64(), pa.string(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parser = None, Parser(chunk)
        for b in batches:
            out, size = [], 0
            for value, file in zip(b.column(0), b.column(1), strict=True):
                if file != now:
                    now, parser = file, Parser(chunk)
                for piece in (value.as_py(), b"\r\n\r\n"):
                    for row in parser.feed(piece):
                        out.append(row)
                        size += len(row[4])
                if size > 8 << 20:
                    yield _batch(out, types, names)
                    out, size = [], 0
            if out:
                yield _batch(out, types, names)

    return blocks.mapInArrow(run, _CHUNK_SCHEMA)


def _batch(rows: list[tuple], types: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)


def round_trip(pages: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Write all pages to archives in the shared folder, read those back as chunks: one row a page, by its last chunk."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write(pages.select("page_id", "url", "html"), path, chunk)
    page = lambda c: F.regexp_extract(c, f"{_ID}(-?[0-9]+)>", 1).try_cast("long")
    return read(spark, path, chunk).filter("last").select(
        page("record_id").alias("page_id"), F.col("bytes_so_far").alias("payload_bytes"), F.col("sha1_so_far").alias("payload_digest"),
        "record_type", page("refers_to").alias("refers_to"),
    )
