"""Files as byte ranges: pages written as files, read back in ranges."""

import zlib

import pytest
from pyspark.sql import functions as F

from lectern.sources import byte_source as B


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("files")
    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "html").orderBy("page_id").limit(30).collect()
    texts = {f"p{r.page_id}.html": (r.html or "").encode() for r in rows}
    texts["large.html"] = b"".join(texts.values()) * 30
    texts["empty.html"] = b""
    for name, data in texts.items():
        (d / name).write_bytes(data)
    (d / "_hidden").write_bytes(b"x")
    return str(d), texts


def test_ranges_join_to_the_files(spark, folder):
    d, texts = folder
    got = {}
    for r in B.byte_ranges(spark, d, 1000).orderBy("path", "start").collect():
        name = r.path.rsplit("/", 1)[1]
        assert r.size == len(texts[name]) and r.start == len(got.get(name, b"")) and len(r.data) <= 1000
        got[name] = got.get(name, b"") + bytes(r.data)
    assert got == texts


def test_heads_of_named_files(spark, folder):
    d, texts = folder
    rows = B.byte_ranges(spark, f"{d}/l*.html", head=True).collect()
    assert [(r.size, r.start, bytes(r.data)) for r in rows] == [(len(texts["large.html"]), 0, texts["large.html"][: B.HEAD])]
    assert len(texts["large.html"]) > B.HEAD


def test_a_large_file_is_read_by_many_tasks(spark, folder):
    d, texts = folder
    df = B.byte_ranges(spark, f"{d}/large.html", 10_000, task=100_000)
    assert df.rdd.getNumPartitions() > 5
    assert df.agg(F.sum(F.length("data"))).first()[0] == len(texts["large.html"])


def test_pruned_columns_and_conditions_open_nothing_else(spark, folder, monkeypatch):
    d, texts = folder
    reader = B.ByteRanges({"path": d, "rangeBytes": "1000"}).reader(spark.createDataFrame([], "path string, start long").schema)
    listed = B.files(d)
    monkeypatch.setattr(B, "files", lambda pattern: listed)
    monkeypatch.setattr(B, "_opened", lambda path: pytest.fail("opened"))
    rows = [r for p in reader.partitions() for r in reader.read(p)]
    assert {r[0].rsplit("/", 1)[1] for r in rows} == set(texts) and all(len(r) == 2 for r in rows)
    left = list(reader.pushFilters([B.GreaterThanOrEqual(("start",), 2000), B.EqualTo(("path",), "x")]))
    assert left == [B.EqualTo(("path",), "x")]
    assert {s for p in reader.partitions() for *_, s, _ in p.parts} == {s for t in texts.values() for s, _ in B.ranges(len(t), 1000) if s >= 2000}


def test_conditions_through_spark(spark, folder):
    d, texts = folder
    got = B.byte_ranges(spark, d, 1000).where("start = 1000").collect()
    assert {r.path.rsplit("/", 1)[1]: zlib.crc32(bytes(r.data)) for r in got} == {k: zlib.crc32(t[1000:2000]) for k, t in texts.items() if len(t) > 1000}


def test_mistakes(spark, folder):
    d, _ = folder
    for bad in (lambda: B.byte_ranges(spark, d, 0).count(), lambda: B.byte_ranges(spark, d, columns="name string").count(), lambda: B.byte_ranges(spark, d + "/none").count()):
        with pytest.raises(Exception):  # noqa: B017
            bad()
