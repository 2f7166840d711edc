"""Archives: round trips, framing, damage, lost attempts."""

import base64
import gzip
import hashlib
import io
import os

import pytest

from docfields.llm import warc

EXTRA = "digest string, size int, first long, archive string, pages int"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "d", 1, 2, "a", 3) for r in rows], f"page_id long, url string, html string, {EXTRA}")


def brute(rows):
    """(page_id, bytes, digest, type, refers_to) of each row."""
    groups = {}
    for page_id, _, html in rows:
        groups.setdefault(html or "", []).append(page_id)
    out = []
    for page_id, _, html in rows:
        data = (html or "").encode()
        ids = [i for i in groups[html or ""] if i is not None]
        head = max(ids, default=None)
        out.append((page_id, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), *(("response", None) if page_id == head else ("revisit", head))))
    return sorted(out, key=repr)


ROWS = [
    (1, "http://a/1", "<p>same</p>"), (2, "http://a/2", "<p>same</p>"), (9, "http://b/9", "<p>same</p>"), (9, "http://b/9", "<p>same</p>"),
    (3, None, None), (4, "", ""), (5, "http://c/5?q=ü x\r\nWARC-Type: warcinfo", "ends in line ends\r\n\r\n"), (None, "http://d", "of no page"),
    (None, "http://d", "<p>same</p>"), (6, "http://e", "WARC/1.1\r\nContent-Length: 3\r\n\r\n\x1f\x8b\x08"), (7, "http://f", "äöü𝒳 " * 400_000), (-8, "http://g", "negative"),
]


def digests(df):
    return sorted((tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "type", "refers_to").collect()), key=repr)


def test_round_trip(spark, tmp_path):
    written = warc.write_archives(pages(spark, ROWS).repartition(3), f"file://{tmp_path}/out")
    assert written.agg({"records": "sum"}).head()[0] == len(ROWS)
    read = warc.read_archives(written).filter("type <> 'warcinfo'")
    assert digests(read) == brute(ROWS)
    got = read.collect()
    assert all(r.intact and r.problem is None for r in got)
    html = {r[0]: (r[2] or "").encode() for r in ROWS}
    assert all(r.payload == html[r.page_id] for r in got if r.type == "response" and r.page_id is not None)
    assert {r.url for r in got if r.page_id == 5} == {"http://c/5?q=%C3%BC%20x%0D%0AWARC-Type:%20warcinfo"}
    lean = warc.read_archives(written, payloads=False).filter("type <> 'warcinfo'")
    assert digests(lean) == brute(ROWS) and lean.filter("payload IS NOT NULL").count() == 0


def test_any_gzip_reader_reads_the_archives(spark, tmp_path):
    warc.write_archives(pages(spark, ROWS[:6]).coalesce(1), str(tmp_path / "out"))
    (name,) = os.listdir(tmp_path / "out")
    plain = gzip.decompress((tmp_path / "out" / name).read_bytes())
    assert plain.count(b"WARC/1.1\r\n") == 7 and plain.count(b"WARC-Type: revisit") == 3


def test_small_payloads_are_all_responses(spark, tmp_path):
    rows = [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")]
    read = warc.read_archives(warc.write_archives(pages(spark, rows), str(tmp_path / "out"), least=3)).filter("type <> 'warcinfo'")
    assert sorted((r.page_id, r.type, r.refers_to) for r in read.collect()) == [(1, "response", None), (2, "response", None), (3, "revisit", 4), (4, "response", None)]


def test_many_archives_and_what_a_lost_attempt_left(spark, tmp_path):
    rows = [(i, f"http://h/{i}", f"page {i % 7} " * 50) for i in range(60)]
    folder = str(tmp_path / "out")
    written = warc.write_archives(pages(spark, rows).repartition(2), folder, archive_bytes=500)
    assert written.count() > 10
    (tmp_path / "out" / "left.warc.gz").write_bytes(warc.page_record(1, "u", b"twice")[:40])
    assert digests(warc.read_archives(written).filter("type <> 'warcinfo'")) == brute(rows)


def test_no_pages(spark, tmp_path):
    written = warc.write_archives(pages(spark, []), str(tmp_path / "out"))
    assert written.count() == 0 and warc.read_archives(written).count() == 0


def whole(members):
    return [m if isinstance(m, bytes) else type(m) for _, m in members]


@pytest.mark.parametrize("piece", [1, 7, 1 << 18])
def test_broken_members_are_reported_and_left(piece):
    good = [warc.page_record(i, "u", os.urandom(300)) for i in range(4)]
    inflated = [gzip.decompress(g) for g in good]
    offset = len(good[0])
    # damage inside a member; nonsense between members; the end cut off
    hurt = bytearray(good[1])
    hurt[len(hurt) // 2] ^= 0xFF
    got = list(warc.members(io.BytesIO(good[0] + bytes(hurt) + good[2] + good[3]), piece))
    assert whole(got) == [inflated[0], warc.Broken, inflated[2], inflated[3]] and [o for o, _ in got][:2] == [0, offset]
    assert whole(warc.members(io.BytesIO(good[0] + b"nonsense\x1f\x8b\x08 again" + good[1]), piece)) == [inflated[0], warc.Broken, inflated[1]]
    assert whole(warc.members(io.BytesIO(good[0] + good[1][:-9]), piece)) == [inflated[0], warc.Broken]
    assert whole(warc.members(io.BytesIO(b""), piece)) == []


def test_framing_and_digests():
    block = b"HTTP/1.1 200 OK\r\nContent-Length: 3\r\n\r\nabc"
    head = lambda *lines: "\r\n".join(["WARC/1.1", "WARC-Type: response", *lines, "", ""]).encode()
    fine = warc.parsed(head(f"content-length:{len(block)}") + block + warc.END)
    assert fine["intact"] and (fine["payload"], fine["payload_bytes"], fine["page_id"]) == (b"abc", 3, None)
    for wrong in (b"no record", head() + block + warc.END, head("Content-Length: 3") + block + warc.END, head("Content-Length: 900") + block + warc.END):
        with pytest.raises(warc.Broken):
            warc.parsed(wrong)
    other = "sha1:" + warc.base32_sha1(b"other")
    for line in (f"WARC-Payload-Digest: {other}", f"WARC-Block-Digest: {other}"):
        assert not warc.parsed(head(line, f"Content-Length: {len(block)}") + block + warc.END)["intact"]
