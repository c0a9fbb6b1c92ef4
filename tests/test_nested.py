"""Archives inside archives: ranges, depth, damage, and the image job."""

import bz2
import gzip
import io
import tarfile

import pytest

from tesserae.plans import jobs
from tesserae.sources import archive, nested


def tar(members, pax=None):
    buffer = io.BytesIO()
    with tarfile.open(fileobj=buffer, mode="w", format=tarfile.PAX_FORMAT if pax else tarfile.GNU_FORMAT, pax_headers=pax) as out:
        for name, payload in members:
            info = tarfile.TarInfo(name)
            info.size = len(payload)
            out.addfile(info, io.BytesIO(payload))
    return buffer.getvalue()


LONG = "d/" * 90 + "img_x_n00000042.jpeg"


@pytest.fixture()
def folder(tmp_path):
    deep = tar([("z_n00000007.jpg", b"deep")])
    inner = tar([("a_n00000001.JPEG", b"one"), ("skip.txt", b"text"), (LONG, b"long"), ("deep.tgz", gzip.compress(deep))])
    path = tmp_path / "in"
    path.mkdir()
    first = [("i.tar", inner), ("b_n00000002.jpg", b""), ("one_n00000003.jpg.gz", gzip.compress(b"alone")), ("j.tar.bz2", bz2.compress(inner))]
    (path / "0.tar").write_bytes(tar(first))
    (path / "1.tar.gz").write_bytes(gzip.compress(tar([("i.tar", inner), ("b_n00000002.jpg", b"again")])))
    return path


INNER = [("a_n00000001.JPEG", b"one"), (LONG, b"long")]


def found(rows):
    rows = sorted(rows.collect(), key=lambda r: (r.archive, r.start, r.nr))
    return [(r.archive.rsplit("/", 1)[-1], r.inner, r.name, bytes(r.payload)) for r in rows if r.name]


def want():
    def one(top, inner):
        return [(top, inner, *f) for f in INNER] + [(top, f"{inner}!/deep.tgz", "z_n00000007.jpg", b"deep")]

    return [
        *one("0.tar", "i.tar"),
        ("0.tar", "", "b_n00000002.jpg", b""),
        ("0.tar", "", "one_n00000003.jpg", b"alone"),
        *one("0.tar", "j.tar.bz2"),
        *one("1.tar.gz", "i.tar"),
        ("1.tar.gz", "", "b_n00000002.jpg", b"again"),
    ]


@pytest.mark.parametrize("split", [nested.SPLIT_BYTES, 1])
def test_every_file_once_whatever_the_ranges(spark, folder, split):
    assert found(nested.read_files(spark, str(folder), ["jpg", ".JPEG"], split_bytes=split)) == want()
    ranges = nested.cut(spark, str(folder), split).groupBy("archive").count().collect()
    assert {r.archive.rsplit("/", 1)[-1]: r["count"] for r in ranges} == {"0.tar": 4 if split == 1 else 1, "1.tar.gz": 1}


def test_long_names_and_shared_headers_at_a_cut():
    data = tar([("a", b"1"), (LONG, b"2"), (LONG + "x", b"3")])
    cuts = nested.ranges_of(io.BytesIO(data), len(data), 1)
    assert cuts[0][0] == 0 and cuts[-1][1] == len(data) and len(cuts) == 3
    assert all(a[1] == b[0] for a, b in zip(cuts, cuts[1:]))
    names = [r[1] for a, b in cuts for r in nested.walk(nested._Part(io.BytesIO(data), a, b), "", None, 2)]
    assert names == ["a", LONG, LONG + "x"]
    shared = tar([("a", b"1"), ("b", b"2")], {"comment": "all"})
    assert nested.ranges_of(io.BytesIO(shared), len(shared), 1) == [(0, len(shared))]


def test_depth_and_damage(spark, folder, tmp_path):
    shallow = nested.read_files(spark, str(folder), ["jpg"], depth=2, errors="report")
    assert {r.error.split(":")[0] for r in shallow.collect() if r.error} == {"i.tar!/deep.tgz", "j.tar.bz2!/deep.tgz"}
    out = tmp_path / "bad"
    out.mkdir()
    half = tar([("x.jpg", b"x" * 5000), ("y.jpg", b"y" * 5000)])[:8000]
    squeezed = gzip.compress(tar([("p.jpg", bytes(range(256)) * 40)]))
    members = [("half.tar", half), ("no.tar", b"none" * 300), ("cut.tgz", squeezed[:-200]), ("bad.jpg.gz", b"no gzip"), ("end.jpg", b"end")]
    (out / "0.tar").write_bytes(tar(members))
    (out / "1.tar").write_bytes(tar([("u.jpg", b"u" * 2000), ("v.jpg", b"v" * 2000)])[:4000])
    (out / "2.tar").write_bytes(b"")
    rows = nested.read_files(spark, f"{out},{out}/9.tar", ["jpg"], errors="report").collect()
    assert sorted(r.name for r in rows if r.name) == ["end.jpg", "u.jpg", "x.jpg"]
    bad = {(r.archive[-5:], r.error.split(":")[0]) for r in rows if r.error}
    assert {("0.tar", n) for n in ("half.tar!/y.jpg", "no.tar", "bad.jpg")} <= bad
    assert any(r.error and "cut.tgz" in r.error for r in rows) and {a for a, _ in bad} == {f"{n}.tar" for n in (0, 1, 2, 9)}
    assert nested.read_files(spark, str(out), ["jpg"]).count() == 3


def test_empty_folder_and_empty_archive(spark, tmp_path):
    assert nested.read_files(spark, str(tmp_path)).count() == 0
    (tmp_path / "0.tar").write_bytes(tar([]))
    assert nested.read_files(spark, str(tmp_path), errors="report").count() == 0


def test_image_job_numbers_in_file_order(spark, folder, tmp_path):
    out = str(tmp_path / "out")
    jobs.convert_images(spark, str(folder), out, "val", 4)
    rows = archive.sample_columns(archive.read_sample_rows(spark, out), {"jpg": "jpg", "cls": "cls"}).orderBy("key").collect()
    assert [r.key for r in rows] == [f"{i:08d}" for i in range(12)] and [r.shard for r in rows] == [i // 4 for i in range(12)]
    assert [bytes(r.jpg) for r in rows] == [w[3] for w in want()]
    assert bytes(rows[0].cls) == b"n00000001" and bytes(rows[2].cls) == b"n00000007"
