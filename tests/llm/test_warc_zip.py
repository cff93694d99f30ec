"""Archives as files: ZIP64, bytes before the ZIP, broken payloads, payloads that many pages share."""

import io
import zipfile

import pytest

from callatlas.llm import warc_zip as W


def records(n, payload=b"<p>x</p>"):
    digest = W.base64.b32encode(W.hashlib.sha1(payload).digest()).decode()
    return [(f"urn:page:{i}", W.warc_record(i, f"http://h/{i} ?q=1", payload, len(payload), digest, i, False)) for i in range(n)]


def parsed(raw):
    return [W.parse_record(r) for r in W.Archive(W.Buffer(raw)).records()]


def test_round_trip_and_prefix():
    raw = W.archive(records(50))
    rows = parsed(raw)
    assert [r[0] for r in rows] == list(range(50)) and {r[2] for r in rows} == {b"<p>x</p>"}
    assert parsed(b"#!stub\n" * 99 + raw) == rows


def test_zip64_directory_of_many_members():
    inner = zipfile.ZipFile(io.BytesIO(W.archive(records(3))))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for i in range(66_000):
            z.writestr(f"extra/{i}", b"")
        for name in (W.DATA, W.INDEX):
            z.writestr(name, inner.read(name))
    assert b"PK\6\6" in out.getvalue()
    for before in (b"", b"x" * 1000):
        assert len(parsed(before + out.getvalue())) == 3
        assert len(W.Archive(W.Buffer(before + out.getvalue())).entries) == 66_002


def test_a_read_takes_few_ranges():
    class Counted(W.Buffer):
        reads = 0

        def read(self, offset, length):
            self.reads += 1
            return super().read(offset, length)

    source = Counted(W.archive(records(500)))
    assert len(list(W.Archive(source).records())) == 500
    assert source.reads < 10


def test_broken_archives():
    target, good = records(1)[0]
    for bad in (good.replace(b"<p>x", b"<p>y"), good.replace(b"Content-Length: 8\r\n", b"Content-Length: 9\r\n")):
        with pytest.raises(ValueError):
            parsed(W.archive([(target, bad)]))
    for raw in (b"", b"no zip at all", W.archive([(target, good)])[:-30]):
        with pytest.raises(ValueError):
            parsed(raw)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(W.DATA, good)
        z.writestr(W.INDEX, "")
    with pytest.raises(ValueError, match="compressed"):
        parsed(out.getvalue())


def test_shared_payloads_and_odd_ids(spark):
    rows = [(i, f"u{i}", "same for many") for i in range(300)] + [(1000 + i, None, f"own {i}") for i in range(40)] + [(None, "n", "same for many"), (None, "n", "of a null id"), (7, "again", "twice"), (7, "again", "twice"), (8, "", None), (9, "", "")]
    pages = spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, digest string, top int")
    got = {c: [tuple(r) for r in W.with_response(pages, share=10, least=least).select("page_id", "html", "top").collect()] for c, least in (("hot", 5), ("cold", 10**6))}
    assert sorted(map(repr, got["hot"])) == sorted(map(repr, got["cold"]))
    tops = {bytes(h): t for _, h, t in got["hot"]}
    assert tops[b"same for many"] == 299 and tops[b"of a null id"] is None and tops[b""] == 9
    stored = W.archives(pages, most=3000)
    assert stored.count() > 3
    back = W.read_archives(stored).select("page_id", "record_type", "refers_to").collect()
    assert len(back) == len(rows)
    assert sorted(r.page_id for r in back if r.record_type == "revisit" and r.page_id is not None) == sorted([*range(299), 8])
    assert {r.refers_to for r in back if r.page_id is None} == {299, None}
