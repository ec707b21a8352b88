"""Readers of the file formats around episodes, each a DataFrame.

Text formats are read line by line with Spark's own text source and column
expressions; binary ones come through ``binaryFile`` and an Arrow function that
parses a file where it lies. Broken files give no rows or rows with an error
column, as each reader says; nothing is collected.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from kinelake.operators.order_stats import first_rows


def read_json_documents(spark: SparkSession, folder: str, schema: StructType | str, pattern: str = "*.json", recursive: bool = True) -> DataFrame:
    """One row a JSON file, with its path; a broken file is a row with ``_corrupt_record``."""
    if isinstance(schema, str):
        from pyspark.sql.types import _parse_datatype_string

        schema = _parse_datatype_string(schema)
    full = StructType([*schema.fields]).add("_corrupt_record", "string")
    r = spark.read.schema(full).option("multiLine", True).option("mode", "PERMISSIVE").option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive)
    return r.json(folder).withColumn("path", F.col("_metadata.file_path"))


def read_json_lines(spark: SparkSession, paths: Sequence[str], schema: StructType | str) -> DataFrame:
    """JSONL files; {a,b} in a path is expanded by the file system."""
    return spark.read.schema(schema).json(list(paths))


def read_datasets(spark: SparkSession, entries: Sequence[dict], schema: StructType | str, key: str) -> DataFrame:
    """Union of dataset entries {json_path, sampling_strategy}: all, first:N, end:N or random:N, or with N% (rounded up)."""
    out = None
    for e in entries:
        df = sample_rows(spark.read.schema(schema).json(e["json_path"]), e.get("sampling_strategy", "all"), key).withColumn("dataset", F.lit(e["json_path"]))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise ValueError("no dataset entries")
    return out


def dataset_entries(text: str) -> list[dict]:
    """The entries of a dataset list in YAML or JSON: a list, or a map with a list under ``datasets``. Raises ValueError for anything else."""
    import json

    try:
        value = json.loads(text)
    except ValueError:
        try:
            import yaml
        except ImportError as e:
            raise ValueError("reading YAML needs a YAML library; give the list as JSON") from e
        value = yaml.safe_load(text)
    entries = value.get("datasets") if isinstance(value, dict) else value
    if not isinstance(entries, list) or not all(isinstance(e, dict) and "json_path" in e for e in entries):
        raise ValueError("a dataset list has entries with a json_path")
    return entries


def sample_files(spark: SparkSession, folder: str, strategy: str, pattern: str = "*.jsonl") -> list[str]:
    """The paths of a folder's files by the same strategies: first:N, end:N, random:N (seeded by the path), each also with N%."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path")
    kind, _, amount = strategy.partition(":")
    if kind == "all":
        return sorted(r["path"] for r in f.collect())  # the names of files, not their rows
    n = -(-f.count() * int(amount[:-1]) // 100) if amount.endswith("%") else int(amount)
    order = {"first": [F.col("path")], "end": [F.col("path").desc()], "random": [F.xxhash64(F.element_at(F.split("path", "/"), -1), F.lit(7)), F.col("path")]}
    if kind not in order:
        raise ValueError(f"unknown sampling strategy {strategy!r}")
    return [r["path"] for r in f.orderBy(*order[kind]).limit(n).collect()]


def sample_rows(df: DataFrame, strategy: str, key: str) -> DataFrame:
    """The sampling operator: first:N, end:N, random:N, each also with N%; order by ``key``, random by a fixed hash of it. ``key`` is a number."""
    kind, _, amount = strategy.partition(":")
    if kind == "all":
        return df
    n = -(-df.count() * int(amount[:-1]) // 100) if amount.endswith("%") else int(amount)
    order = {"first": F.col(key), "end": -F.col(key), "random": F.xxhash64(key, F.lit(7))}
    if kind not in order:
        raise ValueError(f"unknown sampling strategy {strategy!r}")
    return first_rows(df, order[kind], n, [key])


def read_dirty_scores(spark: SparkSession, path: str, label_column: int = 1) -> DataFrame:
    """(score, label) of a CSV with noise lines: the first field that is a number, and the label ``label_column`` fields behind it.

    Lines without a number or without a label are noise. No valid line gives no rows.
    """
    parts = F.transform(F.split("value", ","), lambda p: F.trim(p))
    at = F.array_position(F.transform(F.col("parts"), lambda p: p.try_cast("double").isNotNull()), True).cast("int")
    df = spark.read.text(path).select(parts.alias("parts")).withColumn("at", at).where("at > 0")
    return df.select(F.element_at("parts", F.col("at")).try_cast("double").alias("score"), F.try_element_at("parts", F.col("at") + label_column).alias("label")).where("label is not null and label <> '' and not isnan(score)")


def read_numbered_folders(spark: SparkSession, root: str) -> DataFrame:
    """(folder_no, path, length) of the files below numeric sub-folders."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    return f.withColumn("folder_no", F.regexp_extract("path", r"/(\d+)/[^/]*$", 1).try_cast("int")).where("folder_no is not null")


_PLY_TYPES = {"char": "b", "int8": "b", "uchar": "B", "uint8": "B", "short": "h", "int16": "h", "ushort": "H", "uint16": "H", "int": "i", "int32": "i", "uint": "I", "uint32": "I", "float": "f", "float32": "f", "double": "d", "float64": "d"}  # fixed values: type names of the format


def parse_ply(data: bytes) -> pd.DataFrame:
    """The vertex table of a PLY file, ASCII or binary. ValueError if it isn't one."""
    import numpy as np

    end = data.find(b"end_header")
    if not data.startswith(b"ply") or end < 0:
        raise ValueError("no PLY header")
    body = data[data.index(b"\n", end) + 1 :]
    fmt, n, fields, inside = "", 0, [], False
    for line in data[:end].decode("ascii", "replace").splitlines():
        w = line.split()
        if w[:1] == ["format"]:
            fmt = w[1]
        elif w[:1] == ["element"]:
            inside = w[1] == "vertex"
            n = int(w[2]) if inside else n
        elif w[:1] == ["property"] and inside:
            fields.append((w[-1], _PLY_TYPES[w[1]]))
    if fmt == "ascii":
        rows = [line.split() for line in body.decode("ascii").splitlines()[:n]]
        return pd.DataFrame({name: pd.to_numeric([r[i] for r in rows]) for i, (name, _) in enumerate(fields)})
    order = "<" if fmt == "binary_little_endian" else ">"
    a = np.frombuffer(body, dtype=[(name, order + t) for name, t in fields], count=n)
    return pd.DataFrame({name: a[name].astype(a[name].dtype.newbyteorder("=")) for name, _ in fields})


def read_ply(spark: SparkSession, path: str) -> DataFrame:
    """(path, x, y, z, r, g, b) of all vertices; missing colours are null, files that are no PLY give no rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, data in zip(b["path"], b["content"]):
                try:
                    v = parse_ply(data)
                except (ValueError, KeyError, IndexError):
                    continue
                out = pd.DataFrame({"path": p, **{c: v[c].astype(float) for c in "xyz"}})
                for c, name in zip("rgb", ("red", "green", "blue")):
                    out[c] = v[name].astype("Int16") if name in v else pd.array([None] * len(v), dtype="Int16")
                yield out

    f = spark.read.format("binaryFile").load(path).select("path", "content")
    return f.mapInPandas(run, "path string, x double, y double, z double, r short, g short, b short")


def write_ply(df: pd.DataFrame) -> bytes:
    """A binary PLY of x, y, z and, if there, red, green, blue."""
    import numpy as np

    cols = [(c, "<f4", "float") for c in "xyz"] + [(c, "u1", "uchar") for c in ("red", "green", "blue") if c in df]
    a = np.empty(len(df), dtype=[(c, t) for c, t, _ in cols])
    for c, _, _ in cols:
        a[c] = df[c]
    head = "ply\nformat binary_little_endian 1.0\n" + f"element vertex {len(df)}\n" + "".join(f"property {k} {c}\n" for c, _, k in cols) + "end_header\n"
    return head.encode() + a.tobytes()


# Camera models of the format and their numbers of parameters.
COLMAP_MODELS = {0: ("SIMPLE_PINHOLE", 3), 1: ("PINHOLE", 4), 2: ("SIMPLE_RADIAL", 4), 3: ("RADIAL", 5), 4: ("OPENCV", 8), 5: ("OPENCV_FISHEYE", 8), 6: ("FULL_OPENCV", 12), 7: ("FOV", 5), 8: ("SIMPLE_RADIAL_FISHEYE", 4), 9: ("RADIAL_FISHEYE", 5), 10: ("THIN_PRISM_FISHEYE", 12)}


def read_colmap_cameras_text(spark: SparkSession, path: str) -> DataFrame:
    """(camera_id, model, width, height, params) of cameras.txt; comments are skipped."""
    p = F.split(F.trim("value"), r"\s+")
    t = spark.read.text(path).where(~F.col("value").startswith("#") & (F.trim("value") != "")).select(p.alias("p"))
    return t.select(F.col("p")[0].cast("int").alias("camera_id"), F.col("p")[1].alias("model"), F.col("p")[2].cast("long").alias("width"), F.col("p")[3].cast("long").alias("height"), F.slice("p", 5, 100).cast("array<double>").alias("params"))


def read_colmap_images_text(spark: SparkSession, path: str) -> DataFrame:
    """(image_id, qw..qz, tx..tz, camera_id, name) of images.txt: its pose lines have ten fields and end in a name."""
    p = F.split(F.trim("value"), r"\s+")
    t = spark.read.text(path).where(~F.col("value").startswith("#")).select(p.alias("p")).where((F.size("p") == 10) & F.col("p")[9].try_cast("double").isNull())
    names = ["qw", "qx", "qy", "qz", "tx", "ty", "tz"]
    return t.select(F.col("p")[0].cast("int").alias("image_id"), *[F.col("p")[i + 1].cast("double").alias(n) for i, n in enumerate(names)], F.col("p")[8].cast("int").alias("camera_id"), F.col("p")[9].alias("name"))


def read_colmap_points_text(spark: SparkSession, path: str) -> DataFrame:
    """(x, y, z, r, g, b, error) of points3D.txt."""
    p = F.split(F.trim("value"), r"\s+")
    t = spark.read.text(path).where(~F.col("value").startswith("#") & (F.trim("value") != "")).select(p.alias("p"))
    return t.select(*[F.col("p")[i + 1].cast("double").alias(c) for i, c in enumerate("xyz")], *[F.col("p")[i + 4].cast("short").alias(c) for i, c in enumerate("rgb")], F.col("p")[7].cast("double").alias("error"))


def read_colmap_cameras_binary(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """The same table from cameras.bin. A file that ends early or names an unknown model gives the cameras before that, or, if ``strict``, raises ValueError."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for where, data in zip(b["path"], b["content"]):
                rows, at = [], 8
                try:
                    for _ in range(struct.unpack_from("<Q", data)[0]):
                        cam, model, w, h = struct.unpack_from("<iiQQ", data, at)
                        name, k = COLMAP_MODELS[model]
                        rows.append((cam, name, w, h, list(struct.unpack_from(f"<{k}d", data, at + 24))))
                        at += 24 + 8 * k
                except (struct.error, KeyError) as e:
                    if strict:
                        raise ValueError(f"{where}: camera {len(rows)} of the file can't be read") from e
                yield pd.DataFrame(rows, columns=["camera_id", "model", "width", "height", "params"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "camera_id int, model string, width long, height long, params array<double>")


def colmap_images(data: bytes) -> list[tuple]:
    """(image_id, qw..qz, tx..tz, camera_id, name, point ids, x, y) of images.bin. Raises struct.error where it ends early."""
    out, at = [], 8
    for _ in range(struct.unpack_from("<Q", data)[0]):
        head = struct.unpack_from("<i7di", data, at)
        end = data.index(b"\0", at + 64)
        n = struct.unpack_from("<Q", data, end + 1)[0]
        flat = struct.unpack_from("<" + "ddq" * n, data, end + 9)
        out.append((*head[:8], head[8], data[at + 64 : end].decode(), list(flat[2::3]), list(flat[0::3]), list(flat[1::3])))
        at = end + 9 + 24 * n
    return out


def colmap_points(data: bytes) -> list[tuple]:
    """(point_id, x, y, z, r, g, b, error, image ids of its track, places in them) of points3D.bin."""
    out, at = [], 8
    for _ in range(struct.unpack_from("<Q", data)[0]):
        head = struct.unpack_from("<QdddBBBdQ", data, at)
        flat = struct.unpack_from(f"<{2 * head[8]}i", data, at + 51)
        out.append((*head[:8], list(flat[0::2]), list(flat[1::2])))
        at += 51 + 8 * head[8]
    return out


def _binary_rows(spark: SparkSession, path: str, parse, ddl: str) -> DataFrame:
    """The rows that ``parse`` finds in each file. Raises ValueError, naming the file, where one ends early."""
    names = [c.strip().split(" ")[0] for c in ddl.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for where, data in zip(b["path"], b["content"]):
                try:
                    rows = parse(data)
                except (struct.error, ValueError) as e:
                    raise ValueError(f"{where}: {e}") from e
                yield pd.DataFrame(rows, columns=names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, ddl)


def read_colmap_images_binary(spark: SparkSession, path: str) -> DataFrame:
    """The images of images.bin with the points that they see."""
    return _binary_rows(spark, path, colmap_images, "image_id int, qw double, qx double, qy double, qz double, tx double, ty double, tz double, camera_id int, name string, point_ids array<long>, xs array<double>, ys array<double>")


def read_colmap_points_binary(spark: SparkSession, path: str) -> DataFrame:
    """The points of points3D.bin with their tracks."""
    return _binary_rows(spark, path, colmap_points, "point_id long, x double, y double, z double, r short, g short, b short, error double, image_ids array<int>, places array<int>")


def read_transforms(spark: SparkSession, path: str) -> DataFrame:
    """(file_path, camera_angle_x, frame_no, matrix) of a transforms.json, the y and z axes flipped."""
    schema = "camera_angle_x double, frames array<struct<file_path:string, transform_matrix:array<array<double>>>>"
    x = spark.read.schema(schema).option("multiLine", True).json(path).select("camera_angle_x", F.posexplode("frames").alias("frame_no", "f"))
    flip = F.transform("f.transform_matrix", lambda row: F.transform(row, lambda v, j: F.when(j.isin(1, 2), -v).otherwise(v)))
    return x.select(F.col("f.file_path").alias("file_path"), "camera_angle_x", "frame_no", flip.alias("matrix"))


def image_header(data: bytes) -> tuple[str, int, int] | None:
    """(type, width, height) of a PNG, GIF, BMP or JPEG, without decoding it; a JPEG's segments are skipped by their lengths. None for anything else."""
    try:
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            return ("png", *struct.unpack(">II", data[16:24]))
        if data[:6] in (b"GIF87a", b"GIF89a"):
            return ("gif", *struct.unpack("<HH", data[6:10]))
        if data[:2] == b"BM":
            w, h = struct.unpack("<ii", data[18:26])
            return "bmp", w, abs(h)
        if data[:2] == b"\xff\xd8":
            at = 2
            while at + 9 < len(data):
                if data[at] != 0xFF:
                    return None
                mark = data[at + 1]
                if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
                    h, w = struct.unpack(">HH", data[at + 5 : at + 9])
                    return "jpeg", w, h
                at += 2 + struct.unpack(">H", data[at + 2 : at + 4])[0]
    except struct.error:
        pass
    return None


def with_image_header(df: DataFrame, content: str) -> DataFrame:
    """Adds header (type, width, height) of an image column, without decoding it; null where there is none."""

    @F.pandas_udf("struct<type:string,width:long,height:long>")
    def probe(b: pd.Series) -> pd.DataFrame:
        rows = [image_header(bytes(x)) if x is not None else None for x in b]
        return pd.DataFrame([r or (None, None, None) for r in rows], columns=["type", "width", "height"])

    return df.withColumn("header", probe(F.col(content)))


def _bundle_lines(data: bytes) -> tuple[int, int, list[str]]:
    lines = [x for x in data.decode("utf-8", "replace").splitlines() if x.strip() and not x.startswith("#")]
    if not lines:
        return 0, 0, []
    n_cameras, n_points = (int(v) for v in lines[0].split()[:2])
    return n_cameras, n_points, lines[1:]


def bundle_points(data: bytes, most_points: int | None = None) -> list[tuple]:
    """(point_no, x, y, z, r, g, b, n_views, cameras, keys, us, vs) of a Bundler file; views of cameras that it doesn't have, or that are cut off, are left out. Raises ValueError if points are missing."""
    n_cameras, n_points, lines = _bundle_lines(data)
    if most_points is not None and n_points > most_points:
        return []
    rest, rows = lines[5 * n_cameras :], []
    if len(rest) < 3 * n_points:
        raise ValueError(f"{len(rest) // 3} of {n_points} points")
    for i in range(n_points):
        view = rest[3 * i + 2].split()
        seen = [(int(view[j]), int(view[j + 1]), float(view[j + 2]), float(view[j + 3])) for j in range(1, min(1 + 4 * int(view[0]), len(view) - 3), 4)]
        seen = [v for v in seen if 0 <= v[0] < n_cameras]
        rows.append((i, *map(float, rest[3 * i].split()[:3]), *map(int, rest[3 * i + 1].split()[:3]), int(view[0]), *([v[k] for v in seen] for k in range(4))))
    return rows


def bundle_cameras(data: bytes) -> list[tuple]:
    """(camera_no, focal, k1, k2, rotation of nine, translation of three) of a Bundler file."""
    n_cameras, _, lines = _bundle_lines(data)
    out = []
    for i in range(n_cameras):
        values = [[float(v) for v in line.split()] for line in lines[5 * i : 5 * i + 5]]
        out.append((i, *values[0], sum(values[1:4], []), values[4]))
    return out


def read_bundle(spark: SparkSession, path: str, most_points: int | None = None) -> DataFrame:
    """(point_no, x, y, z, r, g, b, n_views) of a Bundler file; none at all above ``most_points``."""
    return read_bundle_views(spark, path, most_points).drop("cameras", "keys", "us", "vs")


def read_bundle_views(spark: SparkSession, path: str, most_points: int | None = None) -> DataFrame:
    """The same with the cameras, keys and places of the views of each point."""
    ddl = "point_no long, x double, y double, z double, r int, g int, b int, n_views int, cameras array<int>, keys array<int>, us array<double>, vs array<double>"
    return _binary_rows(spark, path, lambda data: bundle_points(data, most_points), ddl)


def read_bundle_cameras(spark: SparkSession, path: str) -> DataFrame:
    """(camera_no, focal, k1, k2, rotation, translation) of a Bundler file."""
    return _binary_rows(spark, path, bundle_cameras, "camera_no int, focal double, k1 double, k2 double, rotation array<double>, translation array<double>")


def read_sqlite(spark: SparkSession, path: str, table: str, schema: str) -> DataFrame:
    """The columns of one table of SQLite files, by name; each file is read where a task runs, in slices."""
    names = [c.strip().split(" ")[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import sqlite3

        for b in batches:
            for data in b["content"]:
                base = sqlite3.connect(":memory:")
                base.deserialize(data)
                quoted = ", ".join('"' + n.replace('"', '""') + '"' for n in names)
                rows = base.execute(f'SELECT {quoted} FROM "{table}"')
                while part := rows.fetchmany(10_000):
                    yield pd.DataFrame(part, columns=names)
                base.close()

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, schema)
