"""WARC archives in Zstandard, record by record, each archive with a dictionary of its own.

An archive begins with a skippable frame that holds the dictionary, itself compressed, built from the archive's first records.
Each record follows as a frame of its own, so one record can be read by its offset and the dictionary. Payloads that
occur more than once are stored once, the other records refer to that one (``revisit``).

Archives are written by Spark's text writer, one row a file, with an empty skippable frame as the line's end: what is
written stays a valid sequence of frames, under Spark's own commit protocol and on any file system it knows.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairlead.llm.common import FILTER_BITS, in_batches, portions, row_filter, salted, spread
from fairlead.sources.tables import Staging

# Fixed values of the formats: skippable frames (sixteen magic numbers, of which one marks a dictionary), dictionaries.
SKIPPABLE = 0x184D2A50
DICTIONARY = 0x184D2A5D
FRAME = (0xFD2FB528).to_bytes(4, "little")
#: An empty skippable frame, in characters below 128.
LINE_END = (SKIPPABLE.to_bytes(4, "little") + bytes(4)).decode("ascii")

_NAME = "urn:page:"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_STEP = 1 << 15


@dataclass(frozen=True)
class WarcRules:
    """``shared_bytes``: least size of a payload that is stored once. ``archive_bytes``: compressed size at which an archive ends.

    The dictionary is built from an archive's first records, ``sample_bytes`` of them or all if they are fewer, and has
    a hundredth of their size, but at least 1,024 and at most ``dictionary_bytes``. It changes sizes only.
    """

    shared_bytes: int = 1000
    archive_bytes: int = 1 << 24
    sample_bytes: int = 1 << 22
    dictionary_bytes: int = 1 << 16
    level: int = 3
    date: str = "2000-01-01T00:00:00Z"


def classified(pages: DataFrame, staging: Staging, rules: WarcRules = WarcRules()) -> DataFrame:
    """Per row: page_id, url, payload (null for a revisit), payload_bytes, payload_digest, record_type, refers_to, refers_url.

    Payloads are equal if their SHA-1, length and a further hash are. Groups are summed per task before the shuffle. Whether a row may
    be of a group is told by a bitmap of bounded size; only such rows meet the groups, dealt by salt, all others stay where they are.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    signed = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn(
        "payload_digest", F.sha1("payload")
    )
    key = ["payload_bytes", "payload_digest", "__check"]
    signed = signed.withColumn("__check", F.xxhash64("payload"))
    found = signed.filter(F.col("payload_bytes") >= rules.shared_bytes).groupBy(*key)
    shared = found.agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("page_id", "url")).alias("kept")).filter("n > 1")
    groups = staging.keep(
        shared.select(*key, F.col("kept.page_id").alias("kept_id"), F.col("kept.url").alias("kept_url")), "groups"
    )
    bitmap = row_filter(groups, "__check")
    slot = F.pmod(F.xxhash64("__check"), F.lit(1 << FILTER_BITS))
    marked = (
        signed.withColumn("__slot", slot)
        .withColumn("__word", F.shiftright("__slot", 6))
        .join(F.broadcast(bitmap), "__word", "left")
        .withColumn("__may", F.expr("coalesce((__mask & shiftleft(1L, cast(__slot & 63 as int))) != 0, false)"))
        .drop("__slot", "__word", "__mask")
    )
    met = salted(marked.filter("__may"), F.xxhash64("page_id", "url")).join(spread(groups), [*key, "__salt"], "left")
    again = F.col("kept_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("kept_id"))
    decided = met.select(
        "page_id",
        "url",
        F.when(~again, F.col("payload")).alias("payload"),
        "payload_bytes",
        "payload_digest",
        F.when(again, F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"),
        F.when(again, F.col("kept_id")).alias("refers_to"),
        F.when(again, F.col("kept_url")).alias("refers_url"),
    )
    alone = marked.filter("not __may").select(
        "page_id", "url", "payload", "payload_bytes", "payload_digest", F.lit("response").alias("record_type"),
        F.lit(None).cast("long").alias("refers_to"), F.lit(None).cast("string").alias("refers_url"),
    )
    return alone.unionByName(decided)


def _name(page_id: int | None) -> str:
    return f"<{_NAME}{'' if page_id is None else page_id}>"


def _uri(url: str) -> str:
    """The address with whatever a header line can't hold percent-encoded."""
    return quote(url, safe="!#$%&'()*+,/:;=?@[]~-._|{}^`\"\\<>")


def record(row: dict, rules: WarcRules) -> bytes:
    """One record, whole: the header, the block (an HTTP response, of a revisit without its body), and two line ends."""
    digest = base64.b32encode(bytes.fromhex(row["payload_digest"])).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n"
    block = http.encode() + (row["payload"] or b"")
    lines = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: {_name(row['page_id'])}", f"WARC-Date: {rules.date}"]
    if row["url"] is not None:
        lines.append(f"WARC-Target-URI: {_uri(row['url'])}")
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if row["record_type"] == "revisit":
        lines += [f"WARC-Profile: {_REVISIT}", f"WARC-Refers-To: {_name(row['refers_to'])}", f"WARC-Refers-To-Date: {rules.date}"]
        if row["refers_url"] is not None:
            lines.append(f"WARC-Refers-To-Target-URI: {_uri(row['refers_url'])}")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary(records: list[bytes], rules: WarcRules) -> zstandard.ZstdCompressionDict:
    """A dictionary built from the records; from too few to build one, their last bytes as they are."""
    weight = sum(map(len, records))
    size = max(1024, min(weight // 100, rules.dictionary_bytes))
    try:
        return zstandard.train_dictionary(size, records, k=256, d=8, level=rules.level)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(records)[-size:], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def _skippable(magic: int, body: bytes) -> bytes:
    return magic.to_bytes(4, "little") + len(body).to_bytes(4, "little") + body


def archives(records: Iterable[bytes], rules: WarcRules = WarcRules()) -> Iterator[tuple[bytes, int]]:
    """The records as archives: whole content and number of records of each."""
    waiting: list[bytes] = []
    parts: list[bytes] = []
    weight = size = count = 0
    compressor = None

    def opened() -> zstandard.ZstdCompressor:
        own = dictionary(waiting, rules)
        packed = zstandard.ZstdCompressor(level=rules.level).compress(own.as_bytes())
        parts.append(_skippable(DICTIONARY, packed))
        return zstandard.ZstdCompressor(level=rules.level, dict_data=own, write_checksum=True)

    for item in records:
        waiting.append(item)
        weight += len(item)
        if compressor is None:
            if weight < rules.sample_bytes:
                continue
            compressor = opened()
        for one in waiting:
            parts.append(compressor.compress(one))
            size += len(parts[-1])
        count += len(waiting)
        waiting = []
        if size >= rules.archive_bytes:
            yield b"".join(parts), count
            parts, weight, size, count, compressor = [], 0, 0, 0, None
    if waiting and compressor is None:
        compressor = opened()
    for one in waiting:
        parts.append(compressor.compress(one))
    if parts:
        yield b"".join(parts), count + len(waiting)


def packed(records: DataFrame, rules: WarcRules = WarcRules()) -> DataFrame:
    """Rows as ``classified`` gives them -> one row per archive: content, records. A task keeps one archive in memory."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = (record(row, rules) for batch in portions(batches, "payload") for row in batch.to_pylist())
        for content, number in archives(own, rules):
            yield pa.RecordBatch.from_arrays([pa.array([content], pa.binary()), pa.array([number], pa.int64())], ["content", "records"])

    return in_batches(records, rows, "content binary, records long")


def write_archives(pages: DataFrame, path: str, staging: Staging, rules: WarcRules = WarcRules()) -> None:
    """Writes every row of ``pages`` (page_id, url, html) as a record of an archive under ``path``.

    Of rows with equal payloads of at least ``shared_bytes`` bytes those with the largest page_id are responses and the others
    revisits of it; a null page_id is smaller than any, and a group of nulls only has no revisits. Null html is an empty payload. Repeated rows are records of their own.
    Null addresses are left out of the header, characters that can't stand there are percent-encoded. Other columns are not read.
    An empty table gives no archive. A record is never divided, so a very long payload makes a long archive.
    """
    content = packed(classified(pages, staging, rules), rules).select(F.col("content").cast("string").alias("value"))
    content.write.mode("overwrite").option("lineSep", LINE_END).option("maxRecordsPerFile", 1).text(path)


def frames(data: memoryview) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, content) of each compressed frame, read with the dictionary that comes before it."""
    at, reader = 0, zstandard.ZstdDecompressor()
    while at < len(data):
        magic = int.from_bytes(data[at : at + 4], "little")
        if magic & 0xFFFFFFF0 == SKIPPABLE:
            end = at + 8 + int.from_bytes(data[at + 4 : at + 8], "little")
            if end > len(data):
                raise ValueError("archive ends inside a frame")
            if magic == DICTIONARY:
                body = bytes(data[at + 8 : end])
                body = zstandard.ZstdDecompressor().decompress(body) if body.startswith(FRAME) else body
                reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(body))
            at = end
            continue
        frame, parts, place = reader.decompressobj(), [], at
        while not frame.eof:
            if place >= len(data):
                raise ValueError("archive ends inside a frame")
            parts.append(frame.decompress(data[place : place + _STEP]))
            place = min(place + _STEP, len(data))
        end = place - len(frame.unused_data)
        yield at, end - at, b"".join(parts)
        at = end


def _header(block: bytes, at: int) -> tuple[str, dict[str, str], int]:
    """First line, fields by lower-case name, and where the header ends."""
    end = block.find(b"\r\n\r\n", at)
    if end < 0:
        raise ValueError("record without the end of its header")
    first, *lines = block[at:end].decode().split("\r\n")
    fields = (line.partition(":") for line in lines)
    return first, {name.strip().lower(): value.strip() for name, _, value in fields}, end + 4


def _page(name: str | None) -> int | None:
    number = (name or "").removeprefix(f"<{_NAME}").removesuffix(">")
    return int(number) if number else None


def parsed(content: bytes) -> Iterator[dict]:
    """The records of a decompressed frame. A payload that doesn't fit its length or digest is an error."""
    at = 0
    while at < len(content):
        first, fields, begin = _header(content, at)
        if not first.startswith("WARC/"):
            raise ValueError("no WARC record where one should begin")
        end = begin + int(fields["content-length"])
        if content[end : end + 4] != b"\r\n\r\n":
            raise ValueError("record longer or shorter than its header says")
        at, kind = end + 4, fields["warc-type"]
        if kind not in ("response", "revisit"):
            continue
        _, http, body = _header(content, begin)
        digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
        payload = content[body:end] if kind == "response" else None
        size = int(http["content-length"])
        if payload is not None and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
            raise ValueError(f"payload of {fields['warc-record-id']} differs from its digest")
        yield {
            "page_id": _page(fields["warc-record-id"]),
            "target_uri": fields.get("warc-target-uri"),
            "record_type": kind,
            "payload_bytes": size,
            "payload_digest": digest,
            "refers_to": _page(fields.get("warc-refers-to")),
            "payload": payload,
        }


RECORD_SCHEMA = (
    "archive string, offset long, length long, page_id long, target_uri string, record_type string, payload_bytes long, "
    "payload_digest string, refers_to long"
)
_LAYOUT = pa.schema(
    [("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("page_id", pa.int64()), ("target_uri", pa.string()),
     ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())]
)


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of all archives under ``path``, each with the place of its frame; with ``payloads``, also the payload (null for a revisit).

    Every payload is held against its digest. One row of a batch is a whole archive.
    """
    layout = _LAYOUT.append(pa.field("payload", pa.binary())) if payloads else _LAYOUT

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path"), batch.column("content"), strict=True):
                found: list[dict] = []
                weight = 0
                for offset, length, frame in frames(memoryview(content.as_buffer())):
                    for item in parsed(frame):
                        found.append(item | {"archive": name.as_py(), "offset": offset, "length": length})
                        weight += len(item["payload"] or b"") if payloads else 0
                    if weight >= 1 << 23 or len(found) >= 1 << 14:
                        yield pa.RecordBatch.from_pylist(found, layout)
                        found, weight = [], 0
                yield pa.RecordBatch.from_pylist(found, layout)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return in_batches(files, rows, RECORD_SCHEMA + (", payload binary" if payloads else ""))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the whole table's pages and reads the archives back."""
    staging = Staging(spark)
    folder = f"{staging.folder}/archives"
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder, staging)
    records = read_archives(spark, folder, payloads=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP13_SQL = """
WITH sized AS (
  SELECT page_id, coalesce(html, '') AS payload, octet_length(encode(coalesce(html, ''))) AS payload_bytes FROM pages),
held AS (SELECT *, max(page_id) OVER (PARTITION BY payload) AS kept FROM sized),
judged AS (SELECT *, payload_bytes >= 1000 AND kept IS NOT NULL AND page_id IS DISTINCT FROM kept AS again FROM held)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, sha1(payload) AS payload_digest,
       CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN kept END AS refers_to
FROM judged
"""
