import datetime as dt

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from kinelake.operators import compact
from kinelake.session import scratch_path
from kinelake.sources import footer


def write(folder, name, rows, **options):
    pq.write_table(pa.table(rows), folder / name, **options)


def test_thrift_tree_round_trip(tmp_path):
    write(tmp_path, "a.parquet", {"x": [1, 2, None], "s": ["a", None, "b" * 500], "n": [[1], [], None]}, row_group_size=2)
    with open(tmp_path / "a.parquet", "rb") as f:
        size = f.seek(0, 2)
        tree = footer.read_footer(f, size)
    assert footer.decode(footer.encode(tree)) == tree
    assert tree[footer.ROWS][1] == 3 and len(tree[footer.GROUPS][1][1]) == 2


@pytest.mark.parametrize("codec", ["snappy", "zstd", "none"])
def test_blocks_are_copied_whole(spark, tmp_path, codec):
    folder = tmp_path / "in"
    folder.mkdir()
    n = 0
    for i in range(23):
        k = i % 4  # some files are empty
        write(folder, f"f{i:03}.parquet", {"id": pa.array(range(n, n + k), pa.int64()), "t": pa.array([f"v{j % 3}" if j % 5 else None for j in range(k)], pa.string()), "b": pa.array([b"x" * j for j in range(k)], pa.binary())}, compression=codec, row_group_size=2)
        n += k
    out = scratch_path(spark, "t")
    m = compact.compact_parquet(spark, str(folder), out, 4000)
    back = compact.read_compacted(spark, str(folder), out, m)
    assert m.count() < 23 and m.agg(F.sum("n_files"), F.sum("n_rows")).first()[:] == (23, n)
    key = lambda r: r["id"]
    assert sorted(back.collect(), key=key) == sorted(spark.read.parquet(str(folder)).collect(), key=key)
    # the encoded bytes are those of the inputs: nothing was decoded
    blob = b"".join((folder / f"f{i:03}.parquet").read_bytes() for i in range(23))
    for r in m.collect():
        with open(r["out_path"].removeprefix("file://"), "rb") as f:
            data = f.read()
        meta = pq.read_metadata(pa.BufferReader(data))
        for g in range(meta.num_row_groups):
            c = meta.row_group(g).column(1)
            start = c.dictionary_page_offset or c.data_page_offset
            assert data[start : start + c.total_compressed_size] in blob


def test_other_schemas_stay_apart_and_large_files_stay(spark, tmp_path):
    write(tmp_path, "a.parquet", {"x": [1]})
    write(tmp_path, "b.parquet", {"x": ["one"]})
    write(tmp_path, "c.parquet", {"x": list(range(50_000))})
    m = compact.compact_parquet(spark, str(tmp_path), scratch_path(spark, "t"), 20_000).toPandas()
    assert len(m) == 3 and m.kept.sum() == 1 and m.n_rows.sum() == 50_002


def test_a_broken_file_is_named(spark, tmp_path):
    (tmp_path / "bad.parquet").write_bytes(b"PAR1 no footer at all PAR1")
    with pytest.raises(Exception, match="bad.parquet"):
        compact.compact_parquet(spark, str(tmp_path), scratch_path(spark, "t"))


def test_record_key_ignores_spelling(spark):
    same = ["ep1/camera/7/head_color.jpg", "./ep1/camera//00007/head_color.jpg", "ep1\\camera\\7\\head_color.jpg", "/mnt/r/ep1/camera/007/HEAD_COLOR.JPG", "ep1/camera/tmp/../7/head_color (2).jpg", "ep1/Camera/000007/head%5Fcolor.jpg", "ep1/camera/7/head_color - Copy.jpg"]
    other = [None, "", "ep1/camera/7/head_color.png", "ep1/camera/x/head_color.jpg", "head_color.jpg", "ep1/camera/7/tail_color.jpg"]
    rows = compact.with_record_key(spark.createDataFrame([(p,) for p in same + other], "file_path string")).collect()
    assert {(r["frame_no"], r["camera"]) for r in rows[: len(same)]} == {("7", "head_color")}
    assert {r["camera"] for r in rows[len(same) :]} == {None}


FILES = "file_id long, episode_id string, file_path string, n_bytes int, payload binary, written_at timestamp, digest string"


def test_repeats_by_hand(spark):
    p = "e/camera/1/head_color.jpg"
    rows = [
        (5, "e", p, 2, b"ab"), (9, "e", "e//camera/01/head_color (1).jpg", 2, b"ab"), (7, "e", p, 2, b"ab"),
        (3, "e", p, 3, b"ab"), (4, "e", p, None, b"ab"), (1, "e", p, 2, None),  # incomplete
        (10, "e", p, 2, b"cd"),  # recorded anew
        (11, "e", "e/camera/2/head_color.jpg", 2, b"ab"), (12, "f", p, 2, b"ab"), (13, None, p, 2, b"ab"), (14, None, p, 2, b"ab"), (15, "e", None, 2, b"ab"),
    ]
    df = spark.createDataFrame([(*r, dt.datetime(2024, 1, 1), "clash") for r in rows], FILES)
    assert sorted(r[0] for r in compact.repeated_records(df).collect()) == [7, 9]
    assert compact.distinct_records(df).count() == len(rows) - 2
    assert compact.repeated_records(df.limit(0)).count() == 0


def test_hot_record(spark):
    df = spark.range(3000).selectExpr("id as file_id", "'e' as episode_id", "'e/camera/1/head_depth.png' as file_path", "1 as n_bytes", "cast('x' as binary) as payload")
    assert compact.repeated_records(df).count() == 2999


def test_tiny_parquet_is_readable():
    assert pq.read_table(pa.BufferReader(compact.tiny_parquet(pd.DataFrame({"a": [1]})))).num_rows == 1


def test_outputs_have_a_bounded_number_of_blocks(spark, tmp_path):
    import glob

    from kinelake.operators import compact

    for i in range(40):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{i:02d}.parquet").write_bytes(compact.tiny_parquet(pd.DataFrame({"a": [i, i + 100]})))
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    manifest = compact.compact_parquet(spark, source, out).toPandas()
    assert manifest.n_rows.sum() == 80 and manifest.n_files.sum() == 40 and len(manifest) == 1
    bounded = compact.compact_parquet(spark, source, str(tmp_path / "more"), most_blocks=8).toPandas()
    assert len(bounded) == 5 and (bounded.n_blocks == 8).all()
    first = spark.createDataFrame(manifest)
    old, new = compact.reencode_small_blocks(spark, first, str(tmp_path / "big"))
    assert len(old) == 1 and sorted(r["a"] for r in spark.read.parquet(*new).collect()) == sorted([*range(40), *range(100, 140)])
    assert len(glob.glob(str(tmp_path / "out" / "*.parquet"))) == 1


def test_paths_with_many_layers(spark):
    from kinelake.operators import compact

    paths = ["e/a/b/c/d/e/f/../../../../../../12/head_color.jpg", "e/12/head%25252525255fcolor.jpg", "e/%252E/12/head_color.jpg"]
    df = compact.with_record_key(spark.createDataFrame([(p,) for p in paths], "file_path string"))
    assert [(r["frame_no"], r["camera"]) for r in df.collect()] == [("12", "head_color")] * 3
