"""Parquet footers as generic Thrift compact-protocol trees.

Enough of the protocol to read a footer, change a few numbers and write it
again, without knowing every field. A struct is ``{field id: (type, value)}``,
a list is ``(element type, [values])``.
"""

from __future__ import annotations

import struct

MAGIC = b"PAR1"
TRUE, FALSE, BYTE, I16, I32, I64, DOUBLE, BINARY, LIST, SET, MAP, STRUCT = 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12


class _Reader:
    def __init__(self, buf: bytes) -> None:
        self.buf, self.at = buf, 0

    def byte(self) -> int:
        self.at += 1
        return self.buf[self.at - 1]

    def varint(self) -> int:
        out = shift = 0
        while True:
            b = self.byte()
            out |= (b & 0x7F) << shift
            if b < 0x80:
                return out
            shift += 7

    def signed(self) -> int:
        n = self.varint()
        return (n >> 1) ^ -(n & 1)

    def value(self, kind: int, in_list: bool = False):
        if kind in (TRUE, FALSE):
            return self.byte() == TRUE if in_list else kind == TRUE
        if kind == BYTE:
            return self.byte()
        if kind in (I16, I32, I64):
            return self.signed()
        if kind == DOUBLE:
            self.at += 8
            return struct.unpack_from("<d", self.buf, self.at - 8)[0]
        if kind == BINARY:
            n = self.varint()
            self.at += n
            return self.buf[self.at - n : self.at]
        if kind in (LIST, SET):
            head = self.byte()
            n, elem = head >> 4, head & 15
            if n == 15:
                n = self.varint()
            return elem, [self.value(elem, True) for _ in range(n)]
        if kind == MAP:
            n = self.varint()
            kinds = self.byte() if n else 0
            return kinds, [(self.value(kinds >> 4, True), self.value(kinds & 15, True)) for _ in range(n)]
        if kind == STRUCT:
            return self.struct()
        raise ValueError(f"unknown Thrift type {kind}")

    def struct(self) -> dict:
        out: dict = {}
        last = 0
        while True:
            head = self.byte()
            if head == 0:
                return out
            delta, kind = head >> 4, head & 15
            last = last + delta if delta else self.signed()
            out[last] = (kind, self.value(kind))


def _varint(n: int, out: bytearray) -> None:
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)


def _put(kind: int, value, out: bytearray, in_list: bool = False) -> None:
    if kind in (TRUE, FALSE):
        if in_list:
            out.append(TRUE if value else FALSE)
    elif kind == BYTE:
        out.append(value)
    elif kind in (I16, I32, I64):
        _varint((value << 1) ^ (value >> 63) if value < 0 else value << 1, out)
    elif kind == DOUBLE:
        out += struct.pack("<d", value)
    elif kind == BINARY:
        _varint(len(value), out)
        out += value
    elif kind in (LIST, SET):
        elem, items = value
        if len(items) < 15:
            out.append(len(items) << 4 | elem)
        else:
            out.append(0xF0 | elem)
            _varint(len(items), out)
        for x in items:
            _put(elem, x, out, True)
    elif kind == MAP:
        kinds, items = value
        _varint(len(items), out)
        if items:
            out.append(kinds)
        for k, v in items:
            _put(kinds >> 4, k, out, True)
            _put(kinds & 15, v, out, True)
    elif kind == STRUCT:
        last = 0
        for field in sorted(value):
            k, v = value[field]
            if k in (TRUE, FALSE):
                k = TRUE if v else FALSE
            if 0 < field - last <= 15:
                out.append((field - last) << 4 | k)
            else:
                out.append(k)
                _varint(field << 1, out)
            _put(k, v, out)
            last = field
        out.append(0)
    else:
        raise ValueError(f"unknown Thrift type {kind}")


def decode(buf: bytes) -> dict:
    """The tree of a serialized struct."""
    return _Reader(buf).struct()


def encode(tree: dict) -> bytes:
    """The bytes of a struct's tree."""
    out = bytearray()
    _put(STRUCT, tree, out)
    return bytes(out)


def read_footer(f, size: int) -> dict:
    """The footer's tree of an open file of ``size`` bytes; ValueError if it is no plain Parquet file."""
    if size < 12:
        raise ValueError("too short for a Parquet file")
    f.seek(size - 8)
    tail = f.read(8)
    if tail[4:] != MAGIC:
        raise ValueError("no Parquet magic at the end")
    n = struct.unpack("<I", tail[:4])[0]
    if n + 12 > size:
        raise ValueError("footer longer than the file")
    f.seek(size - 8 - n)
    return decode(f.read(n))


# Field ids of the Parquet format.
SCHEMA, ROWS, GROUPS, KEY_VALUES, ORDERS = 2, 3, 4, 5, 7
G_COLUMNS, G_ROWS, G_OFFSET, G_ORDINAL = 1, 3, 5, 7
C_OFFSET, C_META = 2, 3
C_INDEXES = (4, 5, 6, 7)
M_COMPRESSED, M_DATA, M_INDEX, M_DICT = 7, 9, 10, 11
M_BLOOM = (14, 15)


def schema_key(footer: dict) -> bytes:
    """Equal for files whose blocks may stand in one file."""
    return encode({k: footer[k] for k in (SCHEMA, KEY_VALUES, ORDERS) if k in footer})


def chunk_span(meta: dict) -> tuple[int, int]:
    """(first byte, length) of a column chunk."""
    start = meta[M_DATA][1]
    if M_DICT in meta and 0 < meta[M_DICT][1] < start:
        start = meta[M_DICT][1]
    return start, meta[M_COMPRESSED][1]


def relocate(chunk: dict, shift: int) -> dict:
    """The chunk's tree for bytes that moved by ``shift``; page indexes and Bloom filters, which hold offsets, are left out."""
    kind, meta = chunk[C_META]
    meta = {k: v for k, v in meta.items() if k not in M_BLOOM}
    for k in (M_DATA, M_INDEX, M_DICT):
        if k in meta:
            meta[k] = (meta[k][0], meta[k][1] + shift if meta[k][1] > 0 else meta[k][1])
    out = {k: v for k, v in chunk.items() if k not in C_INDEXES}
    out[C_OFFSET] = (I64, 0)
    out[C_META] = (kind, meta)
    return out
