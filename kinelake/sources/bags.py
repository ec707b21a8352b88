"""Recorded message bags in the public MCAP container, read in parallel by chunk.

A bag is a row of records: an opcode, a length, a body. Messages lie in chunks,
and the summary at the file's end tells where each chunk is and which channels
it holds. The listing stage reads only the summaries; chunks without a wanted
topic are never read. A file without a summary, cut off while it was recorded,
is scanned from its start, and its whole records count.

Defined cases: a file that is no bag raises ValueError, naming it; compressed
chunks may use zstd; a chunk with another compression raises ValueError; an
empty folder gives no rows.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the container: its magic and the opcodes that are read or written.
MAGIC = b"\x89MCAP0\r\n"
HEADER, FOOTER, SCHEMA, CHANNEL, MESSAGE, CHUNK, CHUNK_INDEX, DATA_END = 0x01, 0x02, 0x03, 0x04, 0x05, 0x06, 0x08, 0x0F


def _text(data: bytes, at: int) -> tuple[str, int]:
    n = struct.unpack_from("<I", data, at)[0]
    return data[at + 4 : at + 4 + n].decode("utf-8", "replace"), at + 4 + n


def records(data: bytes, at: int = 0) -> Iterator[tuple[int, bytes]]:
    """(opcode, body) of the whole records from a position on; one that is cut off ends them."""
    while at + 9 <= len(data):
        op, n = data[at], struct.unpack_from("<Q", data, at + 1)[0]
        if at + 9 + n > len(data):
            return
        yield op, data[at + 9 : at + 9 + n]
        at += 9 + n


def _channel(body: bytes) -> tuple[int, int, str, str]:
    number, schema = struct.unpack_from("<HH", body)
    topic, at = _text(body, 4)
    return number, schema, topic, _text(body, at)[0]


def _schema(body: bytes) -> tuple[int, str]:
    return struct.unpack_from("<H", body)[0], _text(body, 2)[0]


def _chunk_index(body: bytes) -> tuple[int, int, list[int]]:
    """(where the chunk's record starts, its length, its channels)."""
    start, length, size = struct.unpack_from("<QQI", body, 16)
    return start, length, [struct.unpack_from("<H", body, at)[0] for at in range(36, 36 + size, 10)]


def _unpacked(body: bytes, path: str) -> bytes:
    """The records in a chunk's body."""
    kind, at = _text(body, 28)
    n = struct.unpack_from("<Q", body, at)[0]
    data = body[at + 8 : at + 8 + n]
    if not kind:
        return data
    if kind == "zstd":
        import zstandard

        return zstandard.ZstdDecompressor().decompress(data, max_output_size=struct.unpack_from("<Q", body, 16)[0])
    raise ValueError(f"{path}: chunks compressed by {kind!r} can't be read")


def _plan(path: str, topics: set[str] | None) -> list[tuple[str, int, int, str]]:
    """(path, start, length, channels as topic and type by number) of the chunks to read; one whole-file entry where there is no summary."""
    import json

    from kinelake.operators.compact import _open

    fs, local = _open(path)
    with fs.open_input_file(local) as f:
        size = f.size()
        if size < len(MAGIC) or f.read(len(MAGIC)) != MAGIC:
            raise ValueError(f"{path}: no bag")
        tail = 8 + 9 + 20
        f.seek(max(0, size - tail))
        end = f.read(tail)
        start = struct.unpack_from("<Q", end, 9)[0] if len(end) == tail and end[-8:] == MAGIC and end[0] == FOOTER else 0
        if not start:
            return [(path, 0, size, "{}")]
        f.seek(start)
        summary = f.read(size - tail - start)
    schemas, channels, chunks = {}, {}, []
    for op, body in records(summary):
        if op == SCHEMA:
            number, name = _schema(body)
            schemas[number] = name
        elif op == CHANNEL:
            number, schema, topic, encoding = _channel(body)
            channels[number] = (topic, schema, encoding)
        elif op == CHUNK_INDEX:
            chunks.append(_chunk_index(body))
    known = {n: [t, schemas.get(s, ""), e] for n, (t, s, e) in channels.items()}
    keep = [(a, n) for a, n, held in chunks if topics is None or any(known[c][0] in topics for c in held if c in known)]
    return [(path, a, n, json.dumps(known)) for a, n in keep]


def _messages(path: str, start: int, length: int, known: dict[int, list[str]], topics: set[str] | None) -> list[tuple]:
    from kinelake.operators.compact import _open

    fs, local = _open(path)
    with fs.open_input_file(local) as f:
        f.seek(start)
        data = f.read(length)
    out: list[tuple] = []
    schemas: dict[int, str] = {}

    def read(part: bytes, at: int = 0) -> None:
        for op, body in records(part, at):
            if op == CHUNK:
                read(_unpacked(body, path))
            elif op == SCHEMA:
                number, name = _schema(body)
                schemas[number] = name
            elif op == CHANNEL:
                number, schema, topic, encoding = _channel(body)
                known[number] = [topic, schemas.get(schema, ""), encoding]
            elif op == MESSAGE:
                channel, sequence, logged, published = struct.unpack_from("<HIQQ", body)
                topic, kind, encoding = known.get(channel, ["", "", ""])
                if topics is None or topic in topics:
                    out.append((path, topic, kind, encoding, sequence, logged, published, body[22:]))

    read(data, len(MAGIC) if start == 0 and data[: len(MAGIC)] == MAGIC else 0)
    return out


MESSAGES = "path string, topic string, msg_type string, encoding string, sequence long, log_ns long, publish_ns long, data binary"


def read_bags(spark: SparkSession, folder: str, topics: Sequence[str] | None = None, pattern: str = "*.mcap") -> DataFrame:
    """The messages of all bags below a folder, of some topics or of all. One task reads some chunks, of one file or of many."""
    import json

    wanted = None if topics is None else set(topics)

    def plan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([c for p in b["path"] for c in _plan(p, wanted)], columns=["path", "start", "length", "channels"])

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split(" ")[0] for c in MESSAGES.split(", ")]
        for b in batches:
            for path, start, length, channels in b.itertuples(index=False):
                yield pd.DataFrame(_messages(path, start, length, {int(k): v for k, v in json.loads(channels).items()}, wanted), columns=names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder).select("path")
    chunks = files.mapInPandas(plan, "path string, start long, length long, channels string")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return chunks.repartition(parts, "path", "start").mapInPandas(read, MESSAGES)


def bag_bytes(messages: Sequence[tuple[str, str, int, bytes]], chunk: int = 1000, compression: str = "") -> bytes:
    """A bag of (topic, message type, time in nanoseconds, data), chunked and with its summary."""
    text = lambda s: struct.pack("<I", len(s.encode())) + s.encode()
    record = lambda op, body: struct.pack("<BQ", op, len(body)) + body
    kinds = list(dict.fromkeys(k for _, k, _, _ in messages))
    channels = list(dict.fromkeys((t, k) for t, k, _, _ in messages))
    meta = b"".join(record(SCHEMA, struct.pack("<H", i + 1) + text(k) + text("") + struct.pack("<I", 0)) for i, k in enumerate(kinds))
    meta += b"".join(record(CHANNEL, struct.pack("<HH", i, kinds.index(k) + 1) + text(t) + text("cdr") + struct.pack("<I", 0)) for i, (t, k) in enumerate(channels))
    out = bytearray(MAGIC + record(HEADER, text("") + text("kinelake")))
    index = b""
    for lo in range(0, len(messages), chunk):
        part = messages[lo : lo + chunk]
        body = meta + b"".join(record(MESSAGE, struct.pack("<HIQQ", channels.index((t, k)), lo + i, at, at) + data) for i, (t, k, at, data) in enumerate(part))
        packed = __import__("zstandard").ZstdCompressor().compress(body) if compression == "zstd" else body
        times = [m[2] for m in part]
        whole = record(CHUNK, struct.pack("<QQQI", min(times), max(times), len(body), 0) + text(compression) + struct.pack("<Q", len(packed)) + packed)
        held = sorted({channels.index((t, k)) for t, k, _, _ in part})
        offsets = b"".join(struct.pack("<HQ", c, 0) for c in held)
        index += record(CHUNK_INDEX, struct.pack("<QQQQI", min(times), max(times), len(out), len(whole), len(offsets)) + offsets + struct.pack("<Q", 0) + text(compression) + struct.pack("<QQ", len(packed), len(body)))
        out += whole
    out += record(DATA_END, struct.pack("<I", 0))
    summary = len(out)
    out += meta + index + record(FOOTER, struct.pack("<QQI", summary, 0, 0)) + MAGIC
    return bytes(out)


def compressed_image(data: bytes) -> tuple[int, str, str, bytes] | None:
    """(time in nanoseconds, frame id, format, image) of a CompressedImage message in CDR; None if it is none."""
    try:
        order = "<" if data[1] & 1 else ">"
        at = 4
        seconds, nanos, n = struct.unpack_from(f"{order}iII", data, at)
        frame = data[at + 12 : at + 12 + n - 1].decode()
        at = 8 + (at + 12 + n - 8 + 3) // 4 * 4
        n = struct.unpack_from(f"{order}I", data, at)[0]
        kind = data[at + 4 : at + 4 + n - 1].decode()
        at = 4 + (at + 4 + n - 4 + 3) // 4 * 4
        n = struct.unpack_from(f"{order}I", data, at)[0]
        image = data[at + 4 : at + 4 + n]
        return (seconds * 1_000_000_000 + nanos, frame, kind, image) if len(image) == n else None
    except (struct.error, IndexError, UnicodeDecodeError):
        return None


def read_bag_images(spark: SparkSession, folder: str, topics: Sequence[str] | None = None) -> DataFrame:
    """(path, topic, at_ns, frame_id, format, image) of the compressed images in bags; other messages give no rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, t, *found) for p, t, d in zip(b["path"], b["topic"], b["data"]) if (found := compressed_image(d))]
            yield pd.DataFrame(rows, columns=["path", "topic", "at_ns", "frame_id", "format", "image"])

    m = read_bags(spark, folder, topics).where(F.col("msg_type").endswith("CompressedImage")).select("path", "topic", "data")
    return m.mapInPandas(run, "path string, topic string, at_ns long, frame_id string, format string, image binary")
