"""Far too many small files: compaction by copying encoded blocks.

``compact_parquet`` joins small Parquet files without decoding a value: the
bytes of the column chunks are copied one after another and one new footer,
with moved offsets, names them all. Files whose schema or key-value metadata
differ never share an output. Every output is validated against its inputs
(schema, number of blocks, rows) and against its own bytes.

The plan: the listing is a distributed scan of (path, length), range
partitioned by path, so that neighbours stay together; each task streams its
files into outputs of about ``target_bytes`` and at most ``MOST_BLOCKS`` blocks.
Files that already have that size stay where they are. Copying can't make small
blocks larger: ``reencode_small_blocks`` is a separate call that rewrites outputs
whose blocks are small on average. A task's outputs have fixed names and appear by
rename, so a repeated attempt replaces equal files and nothing is lost or
doubled when an executor dies.

``repeated_records`` finds camera files that store a record again. A record is
an episode, a frame number, one of the six camera files and the bytes. Data
files are never rewritten for that: the repeats are positional deletes, and
``distinct_records`` is the compacted table without them.

Defined cases: an empty file list gives an empty manifest; files without rows
take part, but blocks without rows are left out; a file that is no Parquet, is
encrypted or keeps its chunks in other files raises ValueError, naming the
file. Rows with a null ``payload`` or ``n_bytes``, or whose length differs,
are incomplete and are never repeats; a path from which no frame and camera
can be read is no record.
"""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinelake.session import materialize, scratch_path
from kinelake.sources import footer as ft

#: Blocks of an output: enough for its size, few enough that its footer stays small; the ordinal of a block has 15 bits.
MOST_BLOCKS = 4096
MANIFEST = "out_path string, n_files long, n_blocks long, n_rows long, n_bytes long, kept boolean"


def _open(path: str):
    from pyarrow import fs

    if path.startswith("file:"):
        path = "file:///" + path[5:].lstrip("/")
    if path.startswith("/"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


def _blocks(foot: dict) -> list[dict]:
    """A footer's blocks that hold rows."""
    return [g for g in foot[ft.GROUPS][1][1] if g[ft.G_ROWS][1] > 0]


def copy_blocks(sources: list[tuple[str, dict]], target: str) -> dict:
    """Write one file of all blocks of ``sources`` (path, footer), in order; returns a manifest row.

    Raises ValueError where the schemas differ or the written file does not
    hold what its inputs hold.
    """
    first = sources[0][1]
    if len({ft.schema_key(f) for _, f in sources}) != 1:
        raise ValueError(f"schemas differ among the inputs of {target}")
    out_fs, out_path = _open(target)
    hidden = out_path.rpartition("/")[0] + "/." + out_path.rpartition("/")[2] + "." + __import__("uuid").uuid4().hex
    groups: list[dict] = []
    with out_fs.open_output_stream(hidden) as out:
        out.write(ft.MAGIC)
        at = 4
        for path, foot in sources:
            in_fs, in_path = _open(path)
            with in_fs.open_input_file(in_path) as f:
                for group in _blocks(foot):
                    begin, columns = at, []
                    for chunk in group[ft.G_COLUMNS][1][1]:
                        if ft.C_META not in chunk or 1 in chunk:
                            raise ValueError(f"{path}: column chunks lie elsewhere or are encrypted")
                        start, n = ft.chunk_span(chunk[ft.C_META][1])
                        f.seek(start)
                        data = f.read(n)
                        if len(data) != n:
                            raise ValueError(f"{path}: a column chunk ends early")
                        out.write(data)
                        columns.append(ft.relocate(chunk, at - start))
                        at += n
                    new = dict(group)
                    new[ft.G_COLUMNS] = (ft.LIST, (ft.STRUCT, columns))
                    new[ft.G_OFFSET] = (ft.I64, begin)
                    new.pop(ft.G_ORDINAL, None)
                    if len(groups) <= 0x7FFF:  # a single input may have more
                        new[ft.G_ORDINAL] = (ft.I16, len(groups))
                    groups.append(new)
        foot = dict(first)
        foot[ft.ROWS] = (ft.I64, sum(f[ft.ROWS][1] for _, f in sources))
        foot[ft.GROUPS] = (ft.LIST, (ft.STRUCT, groups))
        raw = ft.encode(foot)
        out.write(raw + struct.pack("<I", len(raw)) + ft.MAGIC)
        size = at + len(raw) + 8
    row = validate(hidden, out_fs, sources, size)
    out_fs.move(hidden, out_path)
    return row | {"out_path": target, "n_files": len(sources), "kept": False}


def validate(path: str, fs, sources: list[tuple[str, dict]], size: int) -> dict:
    """Check a written file against its inputs' footers; returns its blocks, rows and bytes."""
    import pyarrow.parquet as pq

    with fs.open_input_file(path) as f:
        if f.size() != size:
            raise ValueError(f"{path}: {f.size()} bytes, expected {size}")
        meta = pq.read_metadata(f)
        own = ft.read_footer(f, size)
    blocks = sum(len(_blocks(x)) for _, x in sources)
    rows = sum(x[ft.ROWS][1] for _, x in sources)
    in_blocks = sum(meta.row_group(i).num_rows for i in range(meta.num_row_groups))
    if ft.schema_key(own) != ft.schema_key(sources[0][1]) or meta.num_row_groups != blocks or meta.num_rows != rows or in_blocks != rows:
        raise ValueError(f"{path}: schema, blocks or rows differ from the inputs")
    return {"n_blocks": blocks, "n_rows": rows, "n_bytes": size}


def _compact_partition(batches: Iterator[pd.DataFrame], out_dir: str, target_bytes: int, most_blocks: int) -> Iterator[pd.DataFrame]:
    from pyspark import TaskContext

    task = TaskContext.get().partitionId()
    pending: dict[bytes, list[tuple[str, dict]]] = {}
    held: dict[bytes, int] = {}
    blocks: dict[bytes, int] = {}
    made = 0

    def flush(key: bytes) -> pd.DataFrame:
        nonlocal made
        row = copy_blocks(pending.pop(key), f"{out_dir}/part-{task:05d}-{made:05d}.parquet")
        held.pop(key), blocks.pop(key)
        made += 1
        return pd.DataFrame([row])

    for batch in batches:
        for path, length in zip(batch["path"], batch["length"]):
            fs, local = _open(path)
            with fs.open_input_file(local) as f:
                try:
                    foot = ft.read_footer(f, length)
                except (ValueError, IndexError, struct.error) as e:
                    raise ValueError(f"{path}: {e}") from e
            if length >= target_bytes:
                yield pd.DataFrame([{"out_path": path, "n_files": 1, "n_blocks": len(_blocks(foot)), "n_rows": foot[ft.ROWS][1], "n_bytes": length, "kept": True}])
                continue
            key = ft.schema_key(foot)
            n = len(_blocks(foot))
            if key in pending and (held[key] + length > target_bytes or blocks[key] + n > most_blocks):
                yield flush(key)
            pending.setdefault(key, []).append((path, foot))
            held[key], blocks[key] = held.get(key, 0) + length, blocks.get(key, 0) + n
    for key in list(pending):
        yield flush(key)


def compact_parquet(spark: SparkSession, source: str, out_dir: str, target_bytes: int = 128 << 20, most_blocks: int = MOST_BLOCKS) -> DataFrame:
    """Compact the Parquet files at ``source`` into ``out_dir``; returns the manifest, one row an output.

    ``out_dir`` must be a fresh folder that all executors share. Every output is
    checked against the schema, blocks and rows of its inputs; raises ValueError
    also if the outputs together don't hold as many files and rows as the source.
    """
    listing = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(source).select("path", "length")
    total = listing.agg(F.sum("length").alias("b"), F.count("*").alias("n")).first()
    n_in = total["n"]
    fs, local = _open(out_dir)
    fs.create_dir(local, recursive=True)
    parts = max(1, -(-(total["b"] or 0) // target_bytes))
    manifest = materialize(
        listing.repartitionByRange(parts, "path")
        .sortWithinPartitions("path")
        .mapInPandas(lambda it: _compact_partition(it, out_dir, target_bytes, most_blocks), MANIFEST)
    )
    done = manifest.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_files", "n_rows")]).first()
    rows = spark.read.option("pathGlobFilter", "*.parquet").parquet(source).count() if n_in else 0  # read from the footers
    if done["n_files"] != n_in or done["n_rows"] != rows:
        raise ValueError(f"{done['n_files']} of {n_in} files and {done['n_rows']} of {rows} rows were compacted")
    return manifest


def reencode_small_blocks(spark: SparkSession, manifest: DataFrame, out_dir: str, least_block_bytes: int = 1 << 20, target_bytes: int = 128 << 20) -> tuple[list[str], list[str]]:
    """Rewrites, decoded, the outputs whose blocks hold less than ``least_block_bytes`` on average; (paths replaced, paths written).

    The caller swaps the paths; nothing is deleted. Rows keep their order within
    a file; no shuffle. Outputs are few (input bytes / target_bytes), so their paths may pass the driver.
    """
    small = [r["out_path"] for r in manifest.where(F.col("n_bytes") < F.col("n_blocks") * least_block_bytes).select("out_path", "n_bytes").collect()]
    if not small:
        return [], []
    size = manifest.where(F.col("n_bytes") < F.col("n_blocks") * least_block_bytes).agg(F.sum("n_bytes")).first()[0]
    spark.read.parquet(*small).coalesce(max(1, -(-size // target_bytes))).write.mode("error").parquet(out_dir)
    fs, local = _open(out_dir)
    from pyarrow.fs import FileSelector

    return small, [f.path for f in fs.get_file_info(FileSelector(local)) if f.base_name.endswith(".parquet")]


def read_compacted(spark: SparkSession, source: str, out_dir: str, manifest: DataFrame) -> DataFrame:
    """The records of a compacted folder, and of the large files that stayed; row totals are checked by the manifest."""
    whole = spark.read.parquet(source).schema
    paths = [out_dir] if manifest.where(~F.col("kept")).limit(1).count() else []
    kept = [r["out_path"] for r in manifest.where("kept").select("out_path").collect()]  # at most input bytes / target_bytes
    if not paths and not kept:
        return spark.createDataFrame([], whole)
    return spark.read.schema(whole).parquet(*paths, *kept)


# The six camera files of a frame, in a folder named by the frame number, and the marks of repeated uploads.
RECORD_PATH = (
    r"^(?:.*/)? *(?:frame[ _-]?)?0*(\d+) */ *(?:copy of )?(hand_left|hand_right|head)[ _-](color|depth)"
    r"(?:[ _-]*(?:\(\d+\)|copy(?: ?\(?\d+\)?)?|\d+)|~\d*)*\.(jpe?g|png)(?:~|\.(?:\d+|bak|part|tmp|orig))* *$"
)


def _once(df: DataFrame, expr, name: str) -> DataFrame:
    """Adds a column that is worked out once a row: a generator keeps later filters and projections from repeating it."""
    return df.select("*", F.explode(F.array(expr)).alias(name))


def with_record_key(df: DataFrame, path: str = "file_path") -> DataFrame:
    """Adds frame_no and camera of a path, however it is spelled; null where the path names no camera file of a frame.

    Percent codes, slashes of either kind, repeated slashes, ``.`` and ``..``
    steps, case, leading zeros, folders before the episode and the marks of
    repeated uploads ("name (1).jpg", "name - Copy.jpg", "name.jpg~") don't count.
    """
    p = F.col(path)
    decode = lambda x, _: F.coalesce(F.try_url_decode(F.replace(x, F.lit("+"), F.lit("%2B"))), x)
    # a percent code that is itself encoded has a 25 for each layer
    p = F.when(F.contains(p, F.lit("%")), F.aggregate(F.sequence(F.lit(0), F.regexp_count(p, F.lit("25"))), p, decode)).otherwise(p)
    df = _once(df, F.lower(F.translate(p, "\\", "/")), "__path")
    p = F.col("__path")
    steps = F.regexp_replace(p, r"/(?:\./|/)+", "/")
    up = lambda x, _: F.regexp_replace(x, r"(^|/)(?!\.\./)[^/]+/\.\.(?=/|$)/?", "$1")
    steps = F.aggregate(F.sequence(F.lit(0), F.regexp_count(steps, F.lit(r"\.\."))), steps, up)
    plain = F.when(F.contains(p, F.lit("/.")) | F.contains(p, F.lit("//")), F.regexp_replace(steps, r"/(?:\./|/)+", "/")).otherwise(p)
    df = _once(df, F.split(F.regexp_replace(plain, RECORD_PATH, "$1\n$2_$3\n$4"), "\n"), "__hit")
    hit = F.col("__hit")
    camera, ext = F.try_element_at(hit, F.lit(2)), F.try_element_at(hit, F.lit(3))
    fits = (F.size(hit) == 3) & (F.endswith(camera, F.lit("depth")) == (ext == "png"))
    return df.withColumns({"frame_no": F.when(fits, F.element_at(hit, 1)), "camera": F.when(fits, camera)}).drop("__path", "__hit")


def complete_records(files: DataFrame) -> DataFrame:
    """(file_id, episode_id, frame_no, camera, digest) of the complete rows that name a camera file of a frame."""
    whole = files.select("file_id", "episode_id", "file_path", "n_bytes", "payload").where(F.col("payload").isNotNull() & (F.octet_length("payload") == F.col("n_bytes")) & F.col("episode_id").isNotNull())
    rows = _once(whole, F.unhex(F.sha2("payload", 256)), "digest").drop("payload", "n_bytes")
    return with_record_key(rows).where(F.col("camera").isNotNull()).drop("file_path")


def repeated_records(files: DataFrame) -> DataFrame:
    """(file_id): complete rows that store again what a complete row with a smaller file_id stores.

    The smallest file_id of a record comes from an aggregation with map-side
    combine, so a record that fills a third of the table costs no large group;
    the join back spreads the copies.
    """
    rows = complete_records(files)
    key = ["episode_id", "frame_no", "camera", "digest"]
    first = rows.groupBy(*key).agg(F.min("file_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    return rows.join(first, key).where("file_id > first_id").select("file_id")


def compacted_files(spark: SparkSession, source: str, target_bytes: int = 128 << 20) -> tuple[DataFrame, DataFrame]:
    """(manifest, records) of a camera file table compacted into the shared folder."""
    out = scratch_path(spark, "compact")
    manifest = compact_parquet(spark, source, out, target_bytes)
    return manifest, read_compacted(spark, source, out, manifest)


def distinct_records(files: DataFrame) -> DataFrame:
    """The table without its repeats: complete records once, incomplete rows as they are."""
    return files.join(repeated_records(files), "file_id", "left_anti")


def tiny_parquet(rows: pd.DataFrame) -> bytes:
    """A Parquet file of a few rows as bytes, for tests."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    out = io.BytesIO()
    pq.write_table(pa.Table.from_pandas(rows, preserve_index=False), out)
    return out.getvalue()
