"""Archives: exact round trips, reading by place, odd rows, damage."""

import gzip
import hashlib
import zlib

import pytest

from classweave.llm import queries, warc
from classweave.llm.shared_files import make_folder
from classweave.session import new_folder
from compare import compare, connect

LONG = "<p>" + "long page " * 200 + "</p>"
ROWS = [
    (1, "u1", LONG, "x"), (2, None, LONG, "x"), (2, None, LONG, "y"), (9, "u\r\n: é", "é", None),
    (8, "u8", "é", None), (None, "none", LONG, "z"), (None, "n2", "only here" * 200, "z"),
    (3, "", None, "q"), (4, "u4", "", "q"), (5, "u5", "big\r\n\r\n" * 400_000, "w"),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(
        ROWS, "page_id long, url string, html string, payload string")


def expected():
    out = []
    for page, url, html, _ in ROWS:
        raw = (html or "").encode()
        same = [p for p, _, h, _ in ROWS if h == html and p is not None]
        ref = max(same) if len(raw) >= 1000 and same else None
        ref = None if ref == page else ref
        out.append((page, url, "response" if ref is None else "revisit", len(raw),
                    hashlib.sha1(raw).hexdigest(), ref, raw if ref is None else None))
    return sorted(out, key=str)


def test_round_trip(pages):
    rows = warc.archive_pages(pages).collect()
    found = [tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in rows]
    assert sorted(found, key=str) == expected()


def test_members_and_index(spark, pages, monkeypatch):
    written = warc.write_archives(
        warc.with_references(pages).coalesce(1), new_folder(spark, "w"))
    sources = [r.archive for r in written.collect()]
    whole = zlib.decompressobj(31)
    data = open(sources[0].removeprefix("file:"), "rb").read()
    plain = whole.decompress(data)
    assert len(sources) == 1 and whole.eof and not whole.unused_data  # one member
    normal = warc.normalise(written, new_folder(spark, "n")).collect()
    raw = open(normal[0].archive.removeprefix("file:"), "rb").read()
    assert gzip.decompress(raw) == plain
    at = 0
    for line in open(normal[0].sidecar.removeprefix("file:")):
        offset, size, kind, page = line.split()
        record = gzip.decompress(raw[int(offset):int(offset) + int(size)])
        headers = warc.parse_headers(record[:record.index(b"\r\n\r\n")])
        assert (int(offset), headers["WARC-Type"]) == (at, kind)
        assert headers.get("Page-Id", "-") == page
        at += int(size)
    assert at == len(raw) and normal[0].records == len(ROWS)
    again = warc.normalise(spark.createDataFrame(normal), new_folder(spark, "n")).collect()
    assert open(again[0].archive.removeprefix("file:"), "rb").read() == raw


def test_rolls_over(spark, pages, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 1)
    written = warc.write_archives(warc.with_references(pages), new_folder(spark, "w"))
    assert written.count() == len(ROWS)
    done = warc.read_archives(warc.normalise(written, new_folder(spark, "n")))
    assert done.count() == len(ROWS)


def test_pieces_of_any_size():
    records = [warc.record_bytes(i, f"u{i}", b"x" * i * 50, "d", None) for i in range(20)]
    for size in (1, 7, 4096):
        stream = b"".join(records)
        cut = iter([stream[i:i + size] for i in range(0, len(stream), size)])
        assert [r for _, r in warc.RecordReader(cut)] == records
    with pytest.raises(ValueError):
        list(warc.RecordReader(iter([b"".join(records)[:-9]])))


def test_empty_table(spark, pages):
    assert warc.archive_pages(pages.where("page_id < 0")).count() == 0


def test_query(spark, small):
    assert compare(queries.QUERIES["op3_warc"](spark, small), connect(small),
                   queries.ORACLES["op3_warc"]) is None


def test_folder_address(tmp_path):
    make_folder(f"file://{tmp_path}/a/b")
    assert (tmp_path / "a" / "b").is_dir()


FOREIGN = (
    b"WARC/1.0\r\nwarc-type:warcinfo\r\ncontent-length: 5\r\n\r\nhello\r\n\r\n"
    b"WARC/1.1\r\nWARC-TYPE:  response\r\nWARC-Target-URI: http://x/\xff\r\n"
    b"Content-Type: application/http; msgtype=response\r\nX-Long: a\r\n  b\r\n"
    b"WARC-Payload-Digest: sha1:QWERTY\r\nContent-Length: 24\r\n\r\n"
    b"HTTP/1.1 200 OK\r\n\r\nbody!\r\n\r\n"
    b"WARC/1.1\r\nWARC-Type: revisit\r\nWARC-Payload-Digest: sha1:ABC\r\n"
    b"Content-Length:0\r\n\r\n\r\n\r\n"
    b"WARC/1.1\r\nContent-Length: 0\r\n\r\n\r\n\r\n")


def stored(spark, folder, raw):
    """An archive of someone else's, as a list of one file."""
    make_folder(folder)
    with open(f"{folder}/foreign.warc.gz", "wb") as out:
        out.write(raw)
    return spark.createDataFrame([(f"{folder}/foreign.warc.gz", None, 0, 0)], warc.FILES_TYPE)


@pytest.mark.parametrize("cuts", [(), (7,), (60, 300)])
def test_archives_of_others(spark, cuts):
    """Any case, any type, no blank, folded lines, members cut anywhere."""
    parts = [FOREIGN[a:b] for a, b in zip((0, *cuts), (*cuts, len(FOREIGN)))]
    files = stored(spark, new_folder(spark, "foreign"), b"".join(map(gzip.compress, parts)))
    found = warc.read_archives(warc.normalise(files, new_folder(spark, "normal"))).collect()
    sha = lambda b: hashlib.sha1(b).hexdigest()
    assert [tuple(r) for r in found] == [
        (None, None, "warcinfo", 5, sha(b"hello"), None, b"hello"),
        (None, "http://x/\ufffd", "response", 5, sha(b"body!"), None, b"body!"),
        (None, None, "revisit", None, "ABC", None, None),
        (None, None, "-", 0, sha(b""), None, b"")]


def test_a_stream_cut_behind_a_record_is_an_error(spark):
    engine = zlib.compressobj(6, zlib.DEFLATED, 31)
    raw = engine.compress(FOREIGN) + engine.flush(zlib.Z_FULL_FLUSH)
    files = stored(spark, new_folder(spark, "cut"), raw)
    with pytest.raises(Exception, match="ends inside a gzip member"):
        warc.normalise(files, new_folder(spark, "normal"))


@pytest.mark.parametrize("raw", [b"WARC/1.1\r\nWARC-Type: x\r\n\r\n",
                                 b"WARC/1.1\r\nno mark\r\n\r\n", b"HTTP/1.1\r\n\r\n"])
def test_what_is_no_record_is_an_error(raw):
    with pytest.raises(ValueError):
        list(warc.RecordReader(iter([raw])))
