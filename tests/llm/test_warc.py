"""WARC archives: written, read back, and read by the plain decompressor."""

from __future__ import annotations

import glob
import hashlib
import io

import pytest
import zstandard

from fairlead.llm.warc import DICTIONARY, LINE_END, WarcRules, archives, classified, frames, parsed, read_archives, record, write_archives


def page(spark, *rows):
    layout = "page_id long, url string, html string, payload string, record_type string, kept_id long, __salt int"
    return spark.createDataFrame([(*r, "x", "y", 1, 2) for r in rows], layout)


LONG = "lorem ipsum " * 100
ROWS = [
    (1, "http://a/1", LONG), (2, "http://a/2", LONG), (3, None, LONG), (4, "http://b/ü\r\nX: y\n", "<p>short</p>"), (5, "u", "<p>short</p>"),
    (6, "u", None), (7, "u", ""), (8, "u", "é" * 500), (9, "u", "é" * 500), (10, "u", "é" * 499), (11, "u", "é" * 499), (None, "n", LONG),
    (None, "n", LONG + "other"), (None, "m", LONG + "other"), (12, "u", LONG * 2000), (13, "r", LONG + "r"), (13, "r", LONG + "r"), (13, "s", LONG + "r"),
    (14, "w", "WARC/1.1\r\n\r\n" + LINE_END + "\x00\x85 " * 400),
]


def expected(rows):
    held = {}
    for i, _, html in rows:
        if i is not None and len((html or "").encode()) >= 1000:
            held[html] = max(held.get(html, i), i)
    for i, _, html in rows:
        data = (html or "").encode()
        kept = held.get(html)
        again = kept is not None and kept != i
        yield i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", kept if again else None


@pytest.mark.parametrize("rules", [WarcRules(), WarcRules(archive_bytes=500, sample_bytes=3000)])
def test_round_trip(spark, staging, tmp_path, rules):
    path = str(tmp_path / "archives")
    write_archives(page(spark, *ROWS).repartition(2), path, staging, rules)
    got = read_archives(spark, path).collect()
    fields = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted((tuple(r[f] for f in fields) for r in got), key=str) == sorted(expected(ROWS), key=str)
    texts = {(i, (h or "").encode()) for i, _, h in ROWS}
    assert all((r.page_id, bytes(r.payload)) in texts for r in got if r.record_type == "response")
    assert all(r.payload is None for r in got if r.record_type == "revisit")
    assert {r.target_uri for r in got if r.page_id in (3, 4)} == {None, "http://b/%C3%BC%0D%0AX:%20y%0A"}
    files = glob.glob(f"{path}/part-*")
    assert len(files) == len({r.archive for r in got}) and (len(files) > 4 or rules == WarcRules())
    for file in files:
        data = open(file, "rb").read()
        assert data[:4] == DICTIONARY.to_bytes(4, "little")
        assert data.endswith(LINE_END.encode())
        # A record by its place alone, with the archive's dictionary.
        size = int.from_bytes(data[4:8], "little")
        own = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(data[8 : 8 + size]))
        for r in got:
            if r.archive.endswith(file.rsplit("/", 1)[1]):
                frame = data[r.offset : r.offset + r.length]
                assert next(parsed(zstandard.ZstdDecompressor(dict_data=own).decompress(frame)))["page_id"] == r.page_id
        whole = zstandard.ZstdDecompressor(dict_data=own).stream_reader(io.BytesIO(data[8 + size :]), read_across_frames=True).read()
        assert whole.count(b"WARC-Type: ") == sum(r.archive.endswith(file.rsplit("/", 1)[1]) for r in got)


def test_empty_table(spark, staging, tmp_path):
    path = str(tmp_path / "archives")
    none = page(spark, *ROWS).filter("false")
    write_archives(none, path, staging)
    assert read_archives(spark, path).count() == 0 and classified(none, staging).count() == 0


def test_damage_is_found():
    row = {"page_id": 1, "url": "u", "payload": b"text", "payload_bytes": 4, "payload_digest": hashlib.sha1(b"text").hexdigest(), "record_type": "response", "refers_to": None, "refers_url": None}
    whole = record(row, WarcRules())
    assert next(parsed(whole))["payload"] == b"text"
    for broken in (whole.replace(b"text\r", b"texT\r"), whole.replace(b"Content-Length: 4", b"Content-Length: 3"), whole[:-2]):
        with pytest.raises(ValueError):
            list(parsed(broken))
    content, number = next(archives([whole]))
    assert number == 1
    with pytest.raises(ValueError):
        list(frames(memoryview(content[:-3])))


def test_dictionary_makes_small_records_smaller():
    row = {"page_id": 1, "url": "u", "record_type": "response", "refers_to": None, "refers_url": None}
    pages = [f"<html><head><title>{i}</title></head><body><p class='intro'>Page {i * i}</p></body></html>".encode() for i in range(3000)]
    records = [record(row | {"page_id": i, "payload": p, "payload_bytes": len(p), "payload_digest": hashlib.sha1(p).hexdigest()}, WarcRules()) for i, p in enumerate(pages)]
    one_by_one = sum(len(zstandard.ZstdCompressor(level=3).compress(r)) for r in records)
    assert sum(len(content) for content, _ in archives(records)) < one_by_one / 2
