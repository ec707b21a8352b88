import struct

import pytest

from kinelake.sources import bags, readers


def test_bags_by_topic_and_cut_off(spark, tmp_path):
    rows = [("/a" if i % 3 else "/b", "t/A", i * 10, bytes([i % 256])) for i in range(50)]
    whole = bags.bag_bytes(rows, chunk=7, compression="zstd")
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "1.mcap").write_bytes(whole)
    got = sorted(tuple(r)[1:] for r in bags.read_bags(spark, str(tmp_path), ["/b"]).collect())
    assert [(g[0], g[1], g[2], g[3], g[4], bytes(g[6])) for g in got] == [("/b", "t/A", "cdr", i, i * 10, bytes([i])) for i in range(0, 50, 3)]
    assert bags.read_bags(spark, str(tmp_path)).count() == 50
    plan = bags._plan(str(tmp_path / "x" / "1.mcap"), {"/nothing"})
    assert plan == []  # no chunk is read for a topic that it doesn't hold
    cut = tmp_path / "cut"
    cut.mkdir()
    (cut / "2.mcap").write_bytes(whole[: len(whole) // 2])
    n = bags.read_bags(spark, str(cut)).count()
    assert 0 < n < 50 and n % 7 == 0
    (cut / "3.mcap").write_bytes(b"no bag at all")
    with pytest.raises(Exception, match="no bag"):
        bags.read_bags(spark, str(cut)).count()
    with pytest.raises(ValueError):
        bags._unpacked(struct.pack("<QQQI", 0, 0, 4, 0) + struct.pack("<I", 3) + b"lz4" + struct.pack("<Q", 0), "p")


def test_images_in_messages():
    assert bags.compressed_image(b"") is None and bags.compressed_image(b"\0\1\0\0" + b"\xff" * 30) is None


def test_truncated_camera_files(spark, tmp_path):
    data = struct.pack("<QiiQQ4d", 2, 1, 1, 640, 480, 500, 501, 320, 240)
    (tmp_path / "cameras.bin").write_bytes(data)
    with pytest.raises(Exception, match="camera 1 of the file"):
        readers.read_colmap_cameras_binary(spark, str(tmp_path / "cameras.bin"), strict=True).count()
    (tmp_path / "images.bin").write_bytes(struct.pack("<Qi", 1, 7))
    with pytest.raises(Exception, match="images.bin"):
        readers.read_colmap_images_binary(spark, str(tmp_path / "images.bin")).count()


def test_bundle_cameras_and_views(spark, tmp_path):
    (tmp_path / "b.out").write_text("# Bundle\n1 1\n5 0.1 0.2\n1 0 0\n0 1 0\n0 0 1\n7 8 9\n1 2 3\n9 8 7\n2 0 11 0.5 1.5 4 1 1 1\n")
    c = readers.read_bundle_cameras(spark, str(tmp_path / "b.out")).first()
    assert c[:4] == (0, 5.0, 0.1, 0.2) and list(c["rotation"]) == [1, 0, 0, 0, 1, 0, 0, 0, 1] and list(c["translation"]) == [7, 8, 9]
    v = readers.read_bundle_views(spark, str(tmp_path / "b.out")).first()
    assert (list(v["cameras"]), list(v["keys"]), list(v["us"]), list(v["vs"])) == ([0], [11], [0.5], [1.5])


def test_dataset_lists():
    assert readers.dataset_entries('[{"json_path": "a"}]') == [{"json_path": "a"}]
    with pytest.raises(ValueError):
        readers.dataset_entries('{"datasets": 3}')
    pytest.importorskip("yaml")
    assert readers.dataset_entries("datasets:\n  - json_path: a\n    sampling_strategy: first:10%\n") == [{"json_path": "a", "sampling_strategy": "first:10%"}]


def test_long_headers_are_skipped():
    jpg = b"\xff\xd8" + b"".join(b"\xff\xe1" + struct.pack(">H", 60_000) + b"x" * 59_998 for _ in range(3)) + b"\xff\xc0" + struct.pack(">HBHH", 17, 8, 480, 640) + b"\0" * 20
    assert readers.image_header(jpg) == ("jpeg", 640, 480)
