import gzip
import io
import struct
import zipfile
from collections import Counter

import pyarrow as pa
import pyarrow.fs
import pytest
from pyspark.sql import functions as F

from plumbline.llm import warc

ROWS = [
    (5, "http://a/\r\nX: y", "same"), (3, None, "same"), (9, "http://b/é", "same"), (4, "u", None), (1, "u", ""), (2, "u", "é" * 4000),
    (7, "u", "x\r\n\r\ny"), (None, "n", "same"), (None, "n", "only null"), (6, "u", "long " * 400_000), (3, None, "same"), (8, "u", "x\r\n\r\ny"),
]


def pages(spark, rows=ROWS):
    return spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id long, url string, html string, payload string, sha1 int").repartition(3)


def expected(rows, least=0):
    out, seen = Counter(), set()
    for i, _, html in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")):
        data = (html or "").encode()
        first = min((r[0] for r in rows if (r[2] or "") == (html or "") and r[0] is not None), default=None)
        response = data not in seen or len(data) < least
        seen.add(data)
        out[(i, len(data), warc.digest(data), "response" if response else "revisit", None if response else first)] += 1
    return out


@pytest.mark.parametrize("options", [{}, {"package_records": 1}, {"package_bytes": 200}, {"least_bytes": 5}])
def test_round_trip(spark, tmp_path, options):
    packages = warc.write_packages(pages(spark), f"file://{tmp_path}/w", **options)
    rows = warc.read_packages(packages, range_bytes=300).withColumns({c: warc.page_of(c).cast("long") for c in ("record_id", "refers_to")}).collect()
    assert all(r.error is None for r in rows)
    got = Counter((r.record_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows)
    assert got == expected(ROWS, options.get("least_bytes", 0))
    assert {bytes(r.payload) for r in rows if r.record_type == "response"} == {(h or "").encode() for _, _, h in ROWS}
    names = {r.path.removeprefix("file://") for r in rows}
    for name in names:
        with zipfile.ZipFile(name) as z:
            assert z.testzip() is None and all(m.compress_type == 0 for m in z.infolist())
            text = gzip.decompress(z.read(warc.DATA))
            assert text.startswith(b"WARC/1.1\r\n")
    row = rows[0]
    with open(row.path.removeprefix("file://"), "rb") as f:
        f.seek(row.offset)
        assert gzip.decompress(f.read(row.length)).startswith(b"WARC/1.1")


def test_empty(spark, tmp_path):
    packages = warc.write_packages(pages(spark).limit(0), f"{tmp_path}/w")
    assert packages.count() == 0 and warc.read_packages(packages).count() == 0


def member(payload, n=1):
    return b"".join(gzip.compress(warc.record(i, "u", payload, len(payload), b"\0" * 20, "0")) for i in range(n))


def test_without_index_and_damaged(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "plain.zip", "w") as z:
        z.writestr("archive/x.warc.gz", member(b"", 5))
    with zipfile.ZipFile(tmp_path / "deflated.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("archive/x.warc.gz", member(b"", 5))
    (tmp_path / "noise.zip").write_bytes(b"no zip at all")
    (tmp_path / "empty.zip").write_bytes(b"")
    paths = spark.createDataFrame([(str(p),) for p in tmp_path.glob("*.zip")] + [(str(tmp_path / "absent.zip"),)], "path string")
    rows = warc.read_packages(paths).groupBy(F.regexp_extract("path", r"(\w+)\.zip", 1).alias("p")).agg(F.count("record_id").alias("n"), F.count("error").alias("e")).collect()
    assert {r.p: (r.n, r.e) for r in rows} == {"plain": (5, 0), "deflated": (0, 1), "noise": (0, 1), "empty": (0, 1), "absent": (0, 1)}


def test_one_flipped_byte_costs_one_record(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "plain.zip", "w") as z:
        z.writestr("archive/x.warc.gz", b"".join(member(b"%d " % i * 400) for i in range(30)))
    warc.write_packages(pages(spark, [(i, "u", f"{i} " * 400) for i in range(30)]), f"file://{tmp_path}/w").collect()
    written = [p for p in (tmp_path / "w").rglob("*.zip")]
    before = warc.read_packages(spark.createDataFrame([(str(p),) for p in written + [tmp_path / "plain.zip"]], "path string")).collect()
    whole = Counter(r.path for r in before)
    assert len(before) == 60 and all(r.error is None for r in before)
    for name in whole:
        row = sorted((r for r in before if r.path == name), key=lambda r: r.offset)[whole[name] // 3]
        data = bytearray(open(name, "rb").read())
        data[row.offset + row.length // 2] ^= 0x55
        open(name, "wb").write(data)
    after = warc.read_packages(spark.createDataFrame([(n,) for n in whole], "path string")).collect()
    assert Counter(r.path for r in after if r.error is None) == {n: c - 1 for n, c in whole.items() if c > 1}
    assert Counter(r.path for r in after if r.error) == {n: 1 for n in whole}


def test_zip64_directory(tmp_path):
    """A directory whose entry, count and place are only in the ZIP64 fields."""
    data = member(b"")
    name = b"archive/x.warc.gz"
    local = struct.pack("<4sHHHHHIIIHH", b"PK\x03\x04", 45, 0, 0, 0, 0, 0, len(data), len(data), len(name), 0) + name
    extra = struct.pack("<HHQQQ", 1, 24, len(data), len(data), 0)
    entry = struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\x01\x02", 45, 45, 0, 0, 0, 0, 0, 2**32 - 1, 2**32 - 1, len(name), len(extra), 0, 0, 0, 0, 2**32 - 1) + name + extra
    at = len(local) + len(data)
    end64 = struct.pack("<4sQHHIIQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, 1, 1, len(entry), at)
    locator = struct.pack("<4sIQI", b"PK\x06\x07", 0, at + len(entry), 1)
    end = struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, 2**32 - 1, 2**32 - 1, 0)
    (tmp_path / "z.zip").write_bytes(local + data + entry + end64 + locator + end)
    with pa.fs.LocalFileSystem().open_input_file(str(tmp_path / "z.zip")) as file:
        (found,) = warc.central_directory(file)
        assert found == {"name": name.decode(), "method": 0, "size": len(data), "header": 0}
        assert warc.data_start(file, found) == len(local)
        assert list(warc.ranges(file, 100)) == [(len(local), [-len(data)])]
    assert zipfile.ZipFile(io.BytesIO((tmp_path / "z.zip").read_bytes())).namelist() == [name.decode()]
