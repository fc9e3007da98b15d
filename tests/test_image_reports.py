"""Files of an upload folder with a reason for each that gives no image."""

from __future__ import annotations

import struct
import zlib

from compare import check, duck
from proofline.sources import images


def png(w: int, h: int) -> bytes:
    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    lines = b"".join(b"\0" + bytes([40, 80, 120] * w) for _ in range(h))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def bmp(w: int, h: int) -> bytes:
    data = bytes((w * 3 + 3) // 4 * 4 * h)
    return b"BM" + struct.pack("<IHHI", 54 + len(data), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, len(data), 0, 0, 0, 0) + data


def test_every_file_has_a_row(spark, tmp_path):
    files = {"good.png": png(7, 5), "good.bmp": bmp(6, 4), "named.jpg": png(3, 2), "cut.png": png(9, 9)[:20], "empty.gif": b"",
             "note.txt": b"no image at all", "head.jpg": b"\xff\xd8\xff\xe0"}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    got = {r.name.rsplit("/", 1)[1]: (r.size_bytes, r.format, r.w, r.h, r.channels, r.error_message) for r in images.image_reports(spark, str(tmp_path)).collect()}
    assert got == {"good.png": (len(files["good.png"]), "png", 7, 5, 3, None), "good.bmp": (len(files["good.bmp"]), "bmp", 6, 4, 3, None),
                   "named.jpg": (len(files["named.jpg"]), "png", 3, 2, 3, None), "cut.png": (20, "png", None, None, None, "damaged png data"),
                   "note.txt": (15, None, None, None, None, "unknown format"),
                   "head.jpg": (4, "jpeg", None, None, None, "damaged jpeg data")}
    ids = {r.image_id for r in images.image_reports(spark, str(tmp_path)).filter("error_message IS NULL").collect()}
    assert ids == {r.image_id for r in images.read_images(spark, str(tmp_path)).collect()}


def test_upload_folder_twin(spark, sf):
    ok, note = check(spark, duck(sf), "upload_reports", sf)
    assert ok, note


def test_folders_are_listed_a_few_tasks_together(spark, tmp_path):
    """A folder for each of many files, and the session's own setting comes back."""
    for i in range(300):
        (tmp_path / f"part={i}").mkdir()
        (tmp_path / f"part={i}" / "note.txt").write_bytes(b"no image at all")
    key, sc = images.LISTING_TASKS, spark.sparkContext
    before = spark.conf.get(key, "10000")
    spark.conf.set(key, "10000")
    try:
        sc.setJobGroup("listing", "listing")
        out = images.image_reports(spark, str(tmp_path))
        tracker = sc.statusTracker()
        stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("listing") for s in tracker.getJobInfo(j).stageIds]
        assert stages and max(s.numTasks for s in stages) < 300 and spark.conf.get(key) == "10000"
        assert out.count() == 300
    finally:
        spark.conf.set(key, before)
        sc.setLocalProperty("spark.jobGroup.id", None)


def test_files_of_one_small_table_are_written_by_many_tasks(spark, sf, monkeypatch):
    from catalog import platform

    seen = []
    real = images.write_result
    monkeypatch.setattr(images, "write_result", lambda df, *rest: (seen.append(df.rdd.getNumPartitions()), real(df, *rest)))
    platform.upload_reports(spark, sf)
    assert seen and seen[0] >= 4
