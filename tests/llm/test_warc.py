from __future__ import annotations

import gzip
import zlib

from ledgerloom.llm import catalog, warc
from tests.llm.conftest import SF

KIND = "page_id long, url string, html string, digest string, keeper long"


def _want(rows):
    largest = {}
    for i, h in rows:
        h = (h or "").encode()
        if h not in largest or (i is not None and (largest[h] is None or i > largest[h])):
            largest[h] = i
    out = []
    for i, h in rows:
        h = (h or "").encode()
        same = largest[h] == i
        out.append((i, len(h), warc.base32_sha1(h), "response" if same else "revisit", None if same else largest[h]))
    return sorted(out, key=str)


def _got(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=str)


def test_round_trip(spark):
    rows = [(1, "a"), (2, "a"), (3, ""), (4, None), (5, "WARC/1.1\r\n\r\n\x1f\x8b é𝄞\r\n\r\n"), (6, "x" * 400_000), (7, "a"), (7, "a"), (None, "n"), (None, "a"), (8, "n")]
    df = spark.createDataFrame([(i, "http://h/é \r\n" if i else None, h, "d", 9) for i, h in rows], KIND).repartition(3)
    folder = warc.new_folder(spark)
    warc.write_archives(df, folder)
    found = warc.read_archives(spark, folder)
    assert _got(found) == _want(rows) and found.filter("kind = 'gap'").count() == 0
    assert {bytes(r.payload).decode() for r in found.filter("record_type = 'response'").collect()} == {h or "" for _, h in rows}
    # The archives are gzip files that any reader takes.
    whole = b"".join(gzip.decompress(bytes(r.content)) for r in spark.read.format("binaryFile").load(folder).collect() if r.length)
    assert whole.count(b"WARC-Record-ID") == len(rows)


def _records(n, compressed=True):
    made = [warc.record(i, "u", f"<p>{i} WARC/1.1</p>".encode() * 9, 17 * 9, warc.base32_sha1(b""), i, False) for i in range(n)]
    return [warc.member(m) if compressed else m for m in made]


def _ids(data):
    found = list(warc.salvage(data))
    return [warc._number(f["warc-record-id"]) for k, _, _, f in found if k == "record"], [(a, b) for k, a, b, _ in found if k == "gap"]


def test_salvage_of_damaged_archives():
    for compressed in (True, False):
        parts = _records(6, compressed)
        at = [sum(map(len, parts[:i])) for i in range(7)]
        whole = b"".join(parts)
        assert _ids(whole) == (list(range(6)), [])
        broken = bytearray(whole)
        broken[at[3] - 20] ^= 0xFF
        assert _ids(bytes(broken)) == ([0, 1, 3, 4, 5], [(at[2], at[3])])
        cut = whole[:at[1] + 20] + whole[at[2]:]
        assert _ids(cut) == ([0, 2, 3, 4, 5], [(at[1], at[1] + 20)])
        assert _ids(b"junk" + whole + b"\0" * 7) == (list(range(6)), [(0, 4), (4 + at[6], 11 + at[6])])
        assert _ids(whole[:-3])[0] == [0, 1, 2, 3, 4]
    mixed = b"".join(_records(2)) + b"\n\n" + b"".join(_records(2, False))
    assert _ids(mixed)[0] == [0, 1, 0, 1]
    assert _ids(b"") == ([], []) and _ids(zlib.compress(b"x"))[0] == []


def test_salvage_in_files(spark, tmp_path):
    parts = _records(4)
    (tmp_path / "a.warc.gz").write_bytes(parts[0] + parts[1][:-9] + parts[2])
    (tmp_path / "b.warc").write_bytes(b"x" + b"".join(_records(2, False)))
    rows = warc.read_archives(spark, f"file://{tmp_path}").collect()
    assert sorted(r.page_id for r in rows if r.kind == "record") == [0, 0, 1, 2]
    gaps = {r.archive[-7:]: (r.start, r.end, r.reason) for r in rows if r.kind == "gap"}
    assert gaps["warc.gz"][:2] == (len(parts[0]), len(parts[0]) + len(parts[1]) - 9) and gaps["/b.warc"][:2] == (0, 1)


def test_empty(spark):
    folder = warc.new_folder(spark)
    warc.write_archives(spark.createDataFrame([], KIND), folder)
    assert warc.read_archives(spark, folder).count() == 0


def test_query(spark):
    rows = [(r.page_id, r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    assert _got(catalog.op9_warc(spark, SF)) == _want(rows)
