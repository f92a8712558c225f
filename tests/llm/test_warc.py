"""Archives written and read back, whole and damaged."""

import base64
import glob
import gzip
import hashlib
import os
import random

import pytest

from anamnesis.llm.warc_salvage import Gap, archived, member, page_of, read_archives, salvage, write_archives, write_record


def sha(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def make(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


PAGES = [
    (7, "http://a/", "<p>same é</p>"),
    (3, "http://b/\r\nX: y", "<p>same é</p>"),
    (5, None, None),
    (9, "", ""),
    (4, "http://c/", "x" * 300_000),
    (None, "http://d/", "<p>same é</p>"),
    (8, "http://e/", "WARC/1.1\r\nWARC-Type: response\r\n\r\nnot a record\r\n\r\n"),
    (11, "http://f/", "\x1f\x8b\x08 text\x00"),
    (3, "http://b/", "<p>same é</p>"),
]


def brute(rows):
    least = {}
    for page, _, text in rows:
        if page is not None:
            least[text or ""] = min(page, least.get(text or "", page))
    out = []
    for page, _, text in rows:
        first = least.get(text or "", page)
        again = page != first
        out.append((page, len((text or "").encode()), sha(text), "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


def test_write_and_read(spark, tmp_path):
    path = str(tmp_path / "w")
    write_archives(make(spark, PAGES), path)
    found = read_archives(spark, path)
    rows = found.select(page_of("record_id"), "payload_bytes", "payload_digest", "record_type", page_of("refers_to"), "gap").collect()
    assert sorted((tuple(r)[:5] for r in rows), key=str) == brute(PAGES) and not any(r["gap"] for r in rows)
    bodies = {r["payload"].decode() for r in found.where("record_type = 'response'").collect()}
    assert bodies == {t or "" for _, _, t in PAGES}
    # Any gzip reader sees the records one after the other.
    for name in glob.glob(path + "/*/part-*"):
        assert gzip.open(name).read().startswith(b"WARC/1.1\r\n")


def test_empty_table_and_clashing_columns(spark):
    assert archived(make(spark, [])).count() == 0
    pages = make(spark, PAGES[:2]).selectExpr("*", "1 as page", "2 as digest", "3 as payload", "4 as size", "5 as least")
    assert archived(pages).where("gap is null").count() == 2


def archive(n=30, packed=None, seed=1):
    rng = random.Random(seed)
    parts, starts, at = [], [], 0
    for i in range(n):
        body = bytes(rng.choice(b"abc \r\n") for _ in range(rng.choice([0, 10, 3000])))
        record = write_record(i, f"http://x/{i}", body, None, False)
        zipped = rng.random() < 0.5 if packed is None else packed
        part = member(record) + b"\0" if zipped else record
        parts.append(part)
        starts.append(at)
        at += len(part)
    return parts, starts


def ids(data):
    found = list(salvage(data))
    return [r.headers["warc-record-id"] for r in found if not isinstance(r, Gap)], [g for g in found if isinstance(g, Gap)]


@pytest.mark.parametrize("packed", [True, False, None])
def test_later_records_are_recovered(packed):
    parts, starts = archive(packed=packed)
    whole, none = ids(b"".join(parts))
    assert len(whole) == 30 and none == []
    rng = random.Random(4)
    for _ in range(60):
        hurt = sorted(rng.sample(range(30), 3))
        broken, spans, at = [], [], 0
        for i, part in enumerate(parts):
            if i in hurt:
                how = rng.choice(["cut", "flip", "junk", "zero"])
                k = rng.randrange(4, len(part) - 6)
                body = part.rstrip(b"\0")
                part = {
                    "cut": part[:k],
                    "flip": part[:k] + bytes([part[k] ^ 0x15]) + part[k + 1 :],
                    "junk": b"garbage\n" + body[7:],
                    "zero": b"Q" * len(part),
                }[how]
                spans.append((at, at + len(part)))
            broken.append(part)
            at += len(part)
        data = b"".join(broken)
        got, gaps = ids(data)
        lost = {f"<urn:page:{i}>" for i in hurt}
        assert set(whole) - lost <= set(got), hurt
        # What is not recovered lies in a reported gap, and gaps only cover damaged bytes.
        for a, b in spans:
            name = whole[[i for i in hurt][spans.index((a, b))]]
            assert name in got or any(g.start < b and g.end > a for g in gaps)
        for g in gaps:
            assert any(a <= g.start and g.end <= b + 1 or (g.start < b and g.end > a) for a, b in spans)
            assert g.reason


def test_gap_is_exact():
    parts, _ = archive(3, packed=True)
    data = parts[0] + b"lost bytes" + parts[1] + parts[2]
    _, gaps = ids(data)
    assert [(g.start, g.end) for g in gaps] == [(len(parts[0]), len(parts[0]) + 10)]
    assert ids(b"") == ([], []) and ids(b"\0\0") == ([], [])
    assert [(g.start, g.end) for g in ids(b"nothing here")[1]] == [(0, 12)]


def test_long_headers_are_read():
    url = "data:text/html," + "a" * 200_000
    for pack in (bytes, member):
        found = list(salvage(pack(write_record(1, url, b"x", None, False)) + pack(write_record(2, "http://WARC/1.1", b"y", None, False))))
        assert [r.headers["warc-target-uri"] for r in found] == [url, "http://WARC/1.1"]


@pytest.mark.parametrize("how", ["payload", "header", "cut", "checksum"])
def test_records_of_one_member_are_salvaged(how):
    rng = random.Random(5)
    records = [write_record(i, f"http://x/{i}", rng.randbytes(30_000), None, False) for i in range(9)]
    if how == "payload":
        records[4] = records[4][:900] + b"?" + records[4][901:]
    if how == "header":
        records[4] = b"?" + records[4][1:]
    packed = member(b"".join(records))
    if how == "cut":
        packed = packed[: len(packed) // 2]
    if how == "checksum":
        packed = packed[:-8] + bytes([packed[-8] ^ 1]) + packed[-7:]
    got, gaps = ids(packed + member(write_record(99, None, b"last", None, False)))
    lost = {"payload": {4}, "header": {4}, "cut": set(range(4, 9)), "checksum": set(range(9))}[how]
    assert got == [f"<urn:page:{i}>" for i in [*range(9), 99] if i not in lost]
    assert [(g.start, g.end) for g in gaps] == [(0, len(packed))]


def plain(i, own=True):
    record = write_record(i, f"http://x/{i}", b"body of %d \r\n\r\n" % i, None, False)
    if own:
        return record
    head, _, rest = record.partition(b"\r\nX-Header-Digest: ")
    return head + rest[rest.index(b"\r\n") :]


@pytest.mark.parametrize("own", [True, False])
def test_a_record_cut_anywhere_leaves_a_gap_and_its_followers(own):
    """With and without the header digest, which other writers lack."""
    records = [plain(i, own) for i in range(4)]
    for k in range(1, len(records[1]) - 4):
        got, gaps = ids(records[0] + records[1][:k] + records[2] + records[3])
        assert got == [f"<urn:page:{i}>" for i in (0, 2, 3)], k
        assert [(g.start, g.end) for g in gaps] == [(len(records[0]), len(records[0]) + k)], k


def test_any_flipped_header_byte_is_noticed():
    records = [plain(i) for i in range(3)]
    digest_line = records[1].index(b"\r\nX-Header-Digest")
    for k in range(records[1].index(b"\r\n\r\n")):
        flipped = records[1][:k] + bytes([records[1][k] ^ 0x15]) + records[1][k + 1 :]
        got, gaps = ids(records[0] + flipped + records[2])
        if k < digest_line:
            assert got == ["<urn:page:0>", "<urn:page:2>"] and len(gaps) == 1, k
        assert got[0] == "<urn:page:0>" and got[-1] == "<urn:page:2>"


def test_files_are_bounded_by_bytes(spark, tmp_path, monkeypatch):
    from anamnesis.llm import warc_salvage as W

    monkeypatch.setattr(W, "FILE_BYTES", 50_000)
    rng = random.Random(6)
    rows = [(i, None, base64.b64encode(rng.randbytes(rng.choice([10, 6000, 30_000]))).decode()) for i in range(60)]
    path = str(tmp_path / "w")
    write_archives(make(spark, rows).coalesce(2), path)
    sizes = [len(open(f, "rb").read()) for f in glob.glob(path + "/*/part-*")]
    assert len(sizes) > 10 and max(sizes) <= 50_001
    found = read_archives(spark, path).collect()
    assert sorted((r["record_id"], r["payload"].decode()) for r in found) == sorted((f"<urn:page:{i}>", t) for i, _, t in rows)


def test_a_lost_record_is_an_error(spark, monkeypatch):
    from anamnesis.llm import warc_salvage as W

    def damaged(pages, path, **columns):
        write_archives(pages, path + "-whole", **columns)
        os.mkdir(path)
        for number, name in enumerate(glob.glob(path + "-whole/*/part-*")):
            data = bytearray(open(name, "rb").read())
            data[len(data) // 2] ^= 1
            with open(f"{path}/{number}", "wb") as out:
                out.write(data)

    monkeypatch.setattr(W, "write_archives", damaged)
    with pytest.raises(Exception, match="not read back"):
        archived(make(spark, PAGES[:2])).collect()
