"""Archives, arrays, named files and lines: ranges of large files, bad files, failed writes, URIs."""

import json
import os
import struct
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe import storage
from lumenframe.sources import archives, lines, named, npy, readers, writers
from lumenframe.sources import ranges as R


def test_members_of_an_archive_behind_three_gigabytes(spark, tmp_path):
    """A sparse file: the archive stands behind 3 GB, and neither listing nor reading one member takes more than the ranges."""
    with open(tmp_path / "big_trajectory.zip", "wb") as f:
        f.seek(3 << 30)
        with zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED) as z:
            for n in (10, 9, 1):
                z.writestr(f"t/CAM_2/rgb/{n}.jpg", f"picture {n}" * 1000)
            z.writestr("t/ünï.txt", "text")
    listed = archives.archive_members(spark, str(tmp_path), task_bytes=1 << 30)
    assert listed.rdd.getNumPartitions() == 2 and {r.member for r in listed.collect()} == {*(f"t/CAM_2/rgb/{n}.jpg" for n in (1, 9, 10)), "t/ünï.txt"}
    got = archives.archive_members(spark, f"file://{tmp_path}", contents=True).filter("member = 't/CAM_2/rgb/9.jpg'").collect()
    assert len(got) == 1 and bytes(got[0].content) == b"picture 9" * 1000 and got[0].size == 9000 and got[0].stem == 9
    frames = readers.frame_members(listed).first()
    assert [f.split("/")[-1] for f in frames.frames] == ["1.jpg", "9.jpg", "10.jpg"] and frames.camera_number == 2


def test_wide_records_of_an_archive(tmp_path):
    """Numbers beyond 32 bits stand in wide places, for a member and for the directory."""
    with open(tmp_path / "a.zip", "wb") as f, zipfile.ZipFile(f, "w") as z:
        with z.open("m", "w", force_zip64=True) as m:
            m.write(b"abc")
    data = (tmp_path / "a.zip").read_bytes()
    count, start, size, _ = archives.directory(*_opened(tmp_path / "a.zip"))
    assert count == 1
    end = data.rfind(archives.END)
    wide = struct.pack("<4sQHHLLQQQQ", archives.END_64, 44, 45, 45, 0, 0, 1, 1, size, start) + struct.pack("<4sLQL", archives.END_64_PLACE, 0, end, 1)
    (tmp_path / "b.zip").write_bytes(data[:end] + wide + archives.END + struct.pack("<HHHHLLH", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0))
    assert zipfile.ZipFile(tmp_path / "b.zip").read("m") == b"abc"
    f, n = _opened(tmp_path / "b.zip")
    (member,) = archives.members(f, n)
    assert archives.content(f, member) == b"abc" and member.size == 3


def _opened(path):
    system, at = R.located(str(path))
    return system.open_input_file(at), os.path.getsize(path)


def test_damaged_archives_are_errors(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("m", "hello hello")
    data = bytearray((tmp_path / "x.zip").read_bytes())
    data[32] ^= 1
    (tmp_path / "x.zip").write_bytes(bytes(data))
    with pytest.raises(Exception, match="damaged"):
        archives.archive_members(spark, str(tmp_path), "*.zip", contents=True).collect()
    (tmp_path / "x.zip").write_bytes(b"no archive")
    with pytest.raises(Exception, match="no end of directory"):
        archives.archive_members(spark, str(tmp_path), "*.zip").collect()


def test_archives_are_written_whole(spark, tmp_path):
    df = spark.createDataFrame([("a.zip", "m2", "two"), ("a.zip", "m1", None), ("b.zip", "m", "é")], "zip string, member string, content string")
    assert archives.write_archives(df, f"{tmp_path}/out") == 3 and sorted(os.listdir(tmp_path / "out")) == ["a.zip", "b.zip"]
    assert zipfile.ZipFile(tmp_path / "out/a.zip").namelist() == ["m1", "m2"]
    got = {(r.zip.rsplit("/", 1)[1], r.member, bytes(r.content)) for r in archives.archive_members(spark, f"{tmp_path}/out", "*.zip", contents=True).collect()}
    assert got == {("a.zip", "m1", b""), ("a.zip", "m2", b"two"), ("b.zip", "m", "é".encode())}


def test_arrays_of_all_orders_and_bad_files(spark, tmp_path):
    rng = np.random.default_rng(1)
    made = {"c": rng.normal(size=(7, 3, 2)), "f": np.asfortranarray(rng.integers(0, 99, (5, 3, 2)).astype(np.int16)), "flat": np.arange(4, dtype=np.uint8), "point": np.array(2.5), "empty": np.zeros((0, 4)), "flags": np.array([[True, False]])}
    for name, a in made.items():
        np.save(tmp_path / f"{name}.npy", a)
    (tmp_path / "bad.npy").write_bytes(b"\x93NUMPY\x01\x00 no header")
    (tmp_path / "none.npy").write_bytes(b"")
    np.save(tmp_path / "objects.npy", np.array([{}], dtype=object), allow_pickle=True)
    (tmp_path / "short.npy").write_bytes((tmp_path / "c.npy").read_bytes()[:-8])
    for task_bytes in (R.TASK_BYTES, 64):
        rows = {}
        for r in npy.npy_rows(spark, str(tmp_path), task_bytes=task_bytes).collect():
            rows.setdefault(r.path.rsplit("/", 1)[1].removesuffix(".npy"), []).append(r)
        for name in ("bad", "none", "objects", "short"):
            assert [tuple(r)[1:] for r in rows.pop(name)] == [(None, None, None)]
        assert rows.keys() == made.keys() - {"empty"}
        for name, own in rows.items():
            flat = made[name].reshape(made[name].shape[0] if made[name].ndim else 1, -1)
            assert [r["values"] for r in sorted(own, key=lambda r: r.row)] == flat.astype(float).tolist() and own[0].shape == list(made[name].shape)


def test_a_large_array_is_read_by_several_tasks_in_ranges(spark, tmp_path):
    """A sparse array of 3 GB; only the rows and columns that are asked for are made."""
    a = np.lib.format.open_memmap(tmp_path / "big.npy", "w+", np.float32, (3 << 20, 256))
    a[2_000_000] = 7
    a.flush()
    df = npy.npy_rows(spark, f"file://{tmp_path}", columns=[3, 5])
    assert df.rdd.getNumPartitions() == 24
    few = df.filter((F.col("row") >= 1_999_999) & (F.col("row") < 2_000_002))
    assert few.rdd.getNumPartitions() == 1 and [(r.row, r["values"]) for r in few.orderBy("row").collect()] == [(1_999_999, [0.0, 0.0]), (2_000_000, [7.0, 7.0]), (2_000_001, [0.0, 0.0])]


def test_an_array_that_reaches_two_tasks_is_an_error(spark, tmp_path, monkeypatch):
    """As where Spark drops the shuffle by file; each task's part took the file's name, so rows were lost unseen."""
    kind = type(spark.range(0))
    monkeypatch.setattr(kind, "repartition", lambda self, *by, deal=kind.repartition: deal(self, 2))
    rows = spark.range(100).select(F.lit("a.npy").alias("file"), F.col("id").alias("place"), F.array(F.col("id").cast("double")).alias("values"))
    with pytest.raises(Exception, match="of its 100 rows in one task"):
        npy.write_npy(rows, str(tmp_path))
    assert os.listdir(tmp_path) == []


def test_small_tasks_of_many_bytes_are_made_larger(tmp_path):
    np.lib.format.open_memmap(tmp_path / "a.npy", "w+", np.float64, (1 << 20, 64))
    reader = npy.NpyReader({"path": str(tmp_path), "taskbytes": "65536"})
    ranges = [p for part in reader.partitions() for p in part.pieces]
    assert len(ranges) <= npy.MOST_TASKS + 1 and [r[2] for r in ranges] == [0, *(r[3] for r in ranges[:-1])] and ranges[-1][3] == 1 << 20


def test_named_files_appear_together_or_not_at_all(spark, tmp_path):
    df = spark.createDataFrame([(f, i, f"{f} {i}") for f in ("a.txt", "b.txt") for i in range(50)], "file string, n int, line string")
    named.write_named(df, f"file://{tmp_path}/out", ["n"])
    assert sorted(os.listdir(tmp_path / "out")) == ["a.txt", "b.txt"]
    assert (tmp_path / "out/a.txt").read_text() == "".join(f"a.txt {i}\n" for i in range(50))
    broken = df.withColumn("line", F.when((F.col("file") == "b.txt") & (F.col("n") == 49), F.raise_error(F.lit("lost"))).otherwise("new"))
    with pytest.raises(Exception, match="lost"):
        named.write_named(broken, str(tmp_path / "out"), ["n"])
    assert sorted(os.listdir(tmp_path / "out")) == ["a.txt", "b.txt"] and (tmp_path / "out/a.txt").read_text().startswith("a.txt 0\n")
    spark.dataSource.register(named.NamedFiles)
    split = spark.createDataFrame([("a.txt", "x")] * 8, "file string, line string").repartition(4)
    with pytest.raises(Exception, match="two tasks"):
        split.write.format("named_files").mode("append").option("path", str(tmp_path / "out")).save()
    assert sorted(os.listdir(tmp_path / "out")) == ["a.txt", "b.txt"]


def test_documents_go_where_their_uri_says(spark, tmp_path):
    writers.write_json_document({"b": 1, "a": "é"}, f"file://{tmp_path}/d/x.json")
    writers.write_config({"k": [1, 2]}, f"file://{tmp_path}/d/c.yaml")
    assert json.loads((tmp_path / "d/x.json").read_text()) == {"a": "é", "b": 1} and readers.read_config(str(tmp_path / "d/c.yaml")) == {"k": [1, 2]}
    m = spark.createDataFrame([("base", 1.0, 2.0, None, 0.5, None)], "model string, pmf double, psnr double, ssim double, lpips double, fvd double")
    writers.write_final_summary(m, f"file://{tmp_path}/s")
    assert sorted(os.listdir(tmp_path / "s")) == ["metrics_summary.csv", "metrics_summary.json", "metrics_summary.md"] and not os.path.exists("file:")


def test_split_files(spark, tmp_path):
    df = spark.createDataFrame([("train", 2, None), ("val", 1, "x"), ("train", 1, "y")], "split string, id int, note string")
    assert writers.write_split_files(df, str(tmp_path / "s"), ["id"]) == {"train": 2, "val": 1}
    assert (tmp_path / "s/train.jsonl").read_text() == '{"id":1,"note":"y","split":"train"}\n{"id":2,"note":null,"split":"train"}\n'
    assert writers.write_split_files(df, str(tmp_path / "dry"), ["id"], dry_run=True) == {"train": 2, "val": 1} and not (tmp_path / "dry").exists()


def test_bad_lines_are_named_in_files_of_many_blocks(spark, tmp_path):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    text = "".join("\n" if i % 7 == 0 else f'{{"sample_id": "{i}"}}\n' if i not in (500, 1999) else "[1]\n" if i == 500 else "{broken\n" for i in range(1, 3000))
    (tmp_path / "a.jsonl").write_text(text)
    (tmp_path / "b.jsonl").write_text('{"sample_id": "x"}\nnull\n')
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 30
        found = {(r.file.rsplit("/", 1)[1], r.line, r.value) for r in lines.bad_json_lines(spark, str(tmp_path)).collect()}
        assert found == {("a.jsonl", 500, "[1]"), ("a.jsonl", 1999, "{broken"), ("b.jsonl", 2, "null")}
        with pytest.raises(ValueError, match=r"a\.jsonl:500: "):
            lines.read_jsonl_located(spark, str(tmp_path))
        (tmp_path / "c").mkdir()
        (tmp_path / "c/good.jsonl").write_text('{"sample_id": "1"}\n\n{"sample_id": "2"}\n')
        assert sorted(r.sample_id for r in lines.read_jsonl_located(spark, str(tmp_path / "c")).collect()) == ["1", "2"]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_a_local_session_without_a_shared_folder_gets_one(spark, monkeypatch):
    class Conf(dict):
        get = lambda self, k, d=None: dict.get(self, k, d)

    class Context:
        master, applicationId = "local[2]", "app-without-folder"
        getConf = lambda self: Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    one = storage.shared_dir(Session())
    assert one.startswith("file:///") and storage.shared_dir(Session()) == one and os.path.isdir(one.removeprefix("file://"))
