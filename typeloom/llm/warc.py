"""Web archives: a distributed writer and a splittable reader.

The writer makes one gzip member for each record and lets Spark's text writer
lay the members end to end, so files appear through Spark's own commit.  The
reader cuts the files into byte ranges.  A task looks through its range for the gzip
magic, takes a candidate for a member if its header decodes to a WARC record, and
owns the records that start inside the range; the last may end behind it.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAGIC = b"\x1f\x8b\x08"
#: An empty member; it ends in a zero byte whatever stands before it.
EMPTY_MEMBER = bytes.fromhex("1f8b0800000000000003" + "0300" + "00000000" + "00000000")
SPLIT_BYTES = 8 << 20
READ_BYTES = 1 << 20
PROBE_BYTES = 4096
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Salts of the join that finds the original of a payload.
SALTS = 16


def record_types(
    pages: DataFrame, id_column: str, payload_column: str, min_bytes: int
) -> DataFrame:
    """``id, url, payload`` with digest, size and, for copies, the id of the original.

    Equal payloads of at least ``min_bytes`` bytes refer to that with the largest id.
    A payload that a third of all pages share is counted in each map task first, and
    its pages meet its original in ``SALTS`` groups.
    """
    sized = pages.withColumn("payload_bytes", F.octet_length(payload_column).cast("long"))
    digested = sized.withColumn("payload_digest", F.sha1(payload_column))
    long = F.col("payload_bytes") >= min_bytes
    groups = (
        digested.filter(long)
        .groupBy("payload_digest")
        .agg(F.max(id_column).alias("original"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1 and original is not null")
        .select("payload_digest", "original", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    )
    salt = F.pmod(F.xxhash64(id_column), F.lit(SALTS)).cast("int")
    joined = digested.withColumn("salt", salt).join(groups, ["payload_digest", "salt"], "left")
    other = F.col("original").isNotNull() & ~F.col("original").eqNullSafe(F.col(id_column))
    return joined.withColumn("refers_to", F.when(long & other, F.col("original"))).drop(
        "salt", "original"
    )


def _header(fields: list[tuple[str, str]]) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in fields)]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def _one_line(value: str) -> str:
    """A header's value: line ends would begin another header."""
    return "".join(c if c >= " " else "%%%02X" % ord(c) for c in value)


def member(page_id: str, url: str, payload: bytes, size: int, digest: str, refers_to: str | None) -> bytes:
    """Gzip member of a record, ending in a zero byte."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n"
    block = http.encode() + (payload if refers_to is None else b"")
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:page:{page_id}>"),
        ("WARC-Target-URI", _one_line(url)),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if refers_to is not None:
        fields[2:2] = [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", PROFILE)]
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    data = squeeze.compress(_header(fields) + block + b"\r\n\r\n") + squeeze.flush()
    # the size at a member's end has a zero on top below 16 MB; else an empty member has
    return data if data.endswith(b"\0") else data + EMPTY_MEMBER


def write_warc(
    pages: DataFrame,
    folder: str,
    id_column: str = "page_id",
    url_column: str = "url",
    payload_column: str = "html",
    min_bytes: int = 1000,
) -> None:
    """Write a record for every row of ``pages`` below ``folder``.

    Null payloads are empty, null urls too; a null id is written as ''.  Rows that share
    the largest id of a payload are all responses.  Text is written in UTF-8.
    """
    source = pages.select(
        pages[id_column].alias("id"),
        F.coalesce(pages[url_column].cast("string"), F.lit("")).alias("url"),
        F.coalesce(pages[payload_column].cast("binary"), F.lit(b"")).alias("payload"),
    )
    typed = record_types(source, "id", "payload", min_bytes).select(
        F.coalesce(F.col("id").cast("string"), F.lit("")).alias("id"),
        "url",
        "payload_bytes",
        "payload_digest",
        F.col("refers_to").cast("string").alias("refers_to"),
        F.when(F.col("refers_to").isNull(), F.col("payload")).otherwise(F.lit(b"")).alias("payload"),
    )

    def members(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [
                batch.column(c)
                for c in ("id", "url", "payload", "payload_bytes", "payload_digest", "refers_to")
            ]
            for i in range(0, batch.num_rows, 256):
                rows = zip(*(c[i : i + 256].to_pylist() for c in columns), strict=True)
                # the line separator gives back the zero byte
                data = [member(*row)[:-1] for row in rows]
                yield pa.RecordBatch.from_arrays([pa.array(data, pa.binary())], ["value"])

    (
        typed.mapInArrow(members, "value binary")
        .select(F.col("value").cast("string"))
        .write.option("lineSep", "\0")
        .text(folder)
    )


def byte_ranges(spark: SparkSession, folder: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(path, size, begin, end) of every range of the files below ``folder``."""
    files = spark.read.format("binaryFile").load(folder).select("path", F.col("length").alias("size"))
    return (
        files.filter("size > 0")
        .select("*", F.explode(F.expr(f"sequence(0L, size - 1, {split_bytes}L)")).alias("begin"))
        .withColumn("end", F.least("size", F.col("begin") + split_bytes))
    )


class RangeReader:
    """Records of a gzip file that start in a range of bytes."""

    def __init__(self, file, size: int, begin: int, end: int):
        self.file, self.size, self.begin, self.end = file, size, begin, end
        self.buffer, self.at = b"", begin  # bytes of the file from ``at`` on

    def _fill(self, until: int) -> bool:
        """Have the bytes up to ``until``; False if the file ends before."""
        while self.at + len(self.buffer) < min(until, self.size):
            self.file.seek(self.at + len(self.buffer))
            more = self.file.read(max(READ_BYTES, until - self.at - len(self.buffer)))
            if not more:
                break
            self.buffer += more
        return self.at + len(self.buffer) >= until

    def _forget(self, before: int) -> None:
        if before - self.at > READ_BYTES:
            self.buffer = self.buffer[before - self.at :]
            self.at = before

    def _is_record(self, place: int) -> bool:
        """Whether a member that decodes to the start of a WARC record is here."""
        self._fill(place + PROBE_BYTES)
        try:
            head = zlib.decompressobj(31).decompress(
                self.buffer[place - self.at : place - self.at + PROBE_BYTES], 5
            )
        except zlib.error:
            return False
        return head == b"WARC/"

    def _member(self, place: int) -> tuple[bytes, int] | None:
        """(content, end) of the member here; None if it does not decode to its end."""
        unzip, parts, at = zlib.decompressobj(31), [], place
        try:
            while not unzip.eof:
                if not self._fill(at + 1):
                    return None
                data = self.buffer[at - self.at : at - self.at + READ_BYTES]
                parts.append(unzip.decompress(data))
                at += len(data)
        except zlib.error:
            return None
        return b"".join(parts), at - len(unzip.unused_data)

    def records(self) -> Iterator[bytes]:
        place = self.begin
        while place < self.end:
            self._forget(place)
            # a magic that begins in the range may end behind it
            self._fill(min(place + READ_BYTES, self.end + len(MAGIC) - 1))
            found = self.buffer.find(MAGIC, place - self.at)
            if found < 0 or self.at + found >= self.end:
                if self.at + len(self.buffer) >= min(self.size, self.end + len(MAGIC) - 1):
                    return
                place = max(place, self.at + len(self.buffer) - len(MAGIC) + 1)
                continue
            place = self.at + found
            got = self._member(place) if self._is_record(place) else None
            if got is None:
                place += 1
            else:
                yield got[0]
                place = got[1]


def parse_record(data: bytes) -> dict:
    """Type, ids, url, payload and digest of a record as ``write_warc`` makes them."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = {}
    for line in head.decode().split("\r\n")[1:]:
        key, _, value = line.partition(":")
        fields[key.strip().lower()] = value.strip()
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(
        int(line.split(b":")[1]) for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:")
    )
    digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
    revisit = fields["warc-type"] == "revisit"
    name = lambda k: fields[k].removeprefix("<urn:page:").removesuffix(">") if k in fields else None
    intact = revisit or (len(payload) == size and hashlib.sha1(payload).hexdigest() == digest)
    return {
        "id": name("warc-record-id"),
        "url": fields.get("warc-target-uri", ""),
        "record_type": fields["warc-type"],
        "payload_bytes": size,
        "payload_digest": digest,
        "refers_to": name("warc-refers-to"),
        "payload": None if revisit else payload,
        "intact": intact,
    }


RECORD = {
    "id": pa.string(),
    "url": pa.string(),
    "record_type": pa.string(),
    "payload_bytes": pa.int64(),
    "payload_digest": pa.string(),
    "refers_to": pa.string(),
    "payload": pa.binary(),
    "intact": pa.bool_(),
}


def read_warc(
    spark: SparkSession, folder: str, split_bytes: int = SPLIT_BYTES, payloads: bool = True
) -> DataFrame:
    """The records of the archives below ``folder``.

    (id, url, record_type, payload_bytes, payload_digest, refers_to, payload, intact);
    a revisit has no payload.  ``intact`` says that size and digest are those of the
    payload.  Archives may lie in any store that Arrow's file systems open.
    """
    ranges = byte_ranges(spark, folder, split_bytes)
    spread = ranges.repartition(max(1, ranges.count()), "path", "begin")
    names = [c for c in RECORD if payloads or c != "payload"]

    def batch_of(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([r[c] for r in rows], RECORD[c]) for c in names], names
        )

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, path = fs.FileSystem.from_uri(row["path"])
                with store.open_input_file(path) as file:
                    held, rows = 0, []
                    for data in RangeReader(file, row["size"], row["begin"], row["end"]).records():
                        rows.append(parse_record(data))
                        held += len(data)
                        if held > READ_BYTES * 8 and payloads or len(rows) >= 5000:
                            yield batch_of(rows)
                            held, rows = 0, []
                    if rows:
                        yield batch_of(rows)

    payload = "payload binary, " if payloads else ""
    return spread.mapInArrow(
        read,
        "id string, url string, record_type string, payload_bytes long, payload_digest string,"
        f" refers_to string, {payload}intact boolean",
    )


def as_type(column: str, like: DataFrame, like_column: str) -> Column:
    """An id as it was before it became part of a record."""
    return F.when(F.col(column) != "", F.col(column)).cast(like.schema[like_column].dataType)


#: DuckDB twin of the query over ``pages``.
ORACLE_SQL = """
with p as (
  select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes,
    sha1(coalesce(html, '')) as payload_digest
  from pages
), g as (
  select *, max(page_id) over (partition by payload_digest) as original from p
)
select page_id, payload_bytes, payload_digest,
  case when payload_bytes >= 1000 and page_id <> original then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 1000 and page_id <> original then original end as refers_to
from g
"""
