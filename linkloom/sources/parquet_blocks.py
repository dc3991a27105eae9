"""Parquet files at the level of their encoded blocks: footers are read and written, column data is only copied.

The footer is Thrift in the compact protocol. It is held as plain lists of (field id, type, value), so fields that this
module does not know are carried over as they are.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

from pyarrow import fs

MAGIC = b"PAR1"

# Type codes of the Thrift compact protocol (fixed values).
TRUE, FALSE, BYTE, I16, I32, I64, DOUBLE, BINARY, LIST, SET, MAP, STRUCT = range(1, 13)

# Field ids of the Parquet footer (fixed values).
META_SCHEMA, META_ROWS, META_GROUPS, META_KEY_VALUES = 2, 3, 4, 5
GROUP_COLUMNS, GROUP_ROWS, GROUP_OFFSET, GROUP_ORDINAL = 1, 3, 5, 7
CHUNK_OFFSET, CHUNK_META, CHUNK_INDEX_FIELDS = 2, 3, (4, 5, 6, 7)
COLUMN_VALUES, COLUMN_COMPRESSED, COLUMN_DATA, COLUMN_INDEX, COLUMN_DICT, COLUMN_BLOOM_FIELDS = 5, 7, 9, 10, 11, (14, 15)


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def varint(self) -> int:
        out = shift = 0
        while True:
            b = self.data[self.at]
            self.at += 1
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    def zigzag(self) -> int:
        n = self.varint()
        return (n >> 1) ^ -(n & 1)

    def take(self, n: int) -> bytes:
        self.at += n
        return self.data[self.at - n : self.at]

    def value(self, kind: int):
        if kind in (I16, I32, I64):
            return self.zigzag()
        if kind == BINARY:
            return self.take(self.varint())
        if kind == STRUCT:
            return self.struct()
        if kind in (LIST, SET):
            head = self.take(1)[0]
            n = self.varint() if head >> 4 == 15 else head >> 4
            return (head & 15, [self.value(head & 15) for _ in range(n)])
        if kind in (TRUE, FALSE, BYTE):
            return self.take(1)
        if kind == DOUBLE:
            return self.take(8)
        if kind == MAP:
            n = self.varint()
            kinds = self.take(1)[0] if n else 0
            return (kinds, [(self.value(kinds >> 4), self.value(kinds & 15)) for _ in range(n)])
        raise ValueError(f"unknown Thrift type {kind}")

    def struct(self) -> list:
        fields, last = [], 0
        while head := self.take(1)[0]:
            last = last + (head >> 4) if head >> 4 else self.zigzag()
            kind = head & 15
            fields.append([last, kind, None if kind in (TRUE, FALSE) else self.value(kind)])
        return fields


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _zigzag(n: int) -> bytes:
    return _varint((n << 1) ^ (n >> 63))


def _write_value(kind: int, v, out: bytearray) -> None:
    if kind in (I16, I32, I64):
        out += _zigzag(v)
    elif kind == BINARY:
        out += _varint(len(v)) + v
    elif kind == STRUCT:
        _write_struct(v, out)
    elif kind in (LIST, SET):
        of, items = v
        out += bytes([len(items) << 4 | of]) if len(items) < 15 else bytes([0xF0 | of]) + _varint(len(items))
        for x in items:
            _write_value(of, x, out)
    elif kind == MAP:
        kinds, items = v
        out += _varint(len(items)) + (bytes([kinds]) if items else b"")
        for a, b in items:
            _write_value(kinds >> 4, a, out)
            _write_value(kinds & 15, b, out)
    else:
        out += v


def _write_struct(fields: list, out: bytearray) -> None:
    last = 0
    for number, kind, v in fields:
        step = number - last
        out += bytes([step << 4 | kind]) if 0 < step < 16 else bytes([kind]) + _zigzag(number)
        last = number
        if kind not in (TRUE, FALSE):
            _write_value(kind, v, out)
    out.append(0)


def get(fields: list, number: int, default=None):
    return next((v for n, _, v in fields if n == number), default)


def put(fields: list, number: int, v) -> None:
    for f in fields:
        if f[0] == number:
            f[2] = v


@dataclass
class Footer:
    fields: list
    size: int

    @property
    def rows(self) -> int:
        return get(self.fields, META_ROWS, 0)

    @property
    def groups(self) -> list:
        return get(self.fields, META_GROUPS, (STRUCT, []))[1]

    @property
    def signature(self) -> bytes:
        """Equal for files whose blocks may lie in one file: same schema, same engine's schema note."""
        out = bytearray()
        _write_value(LIST, get(self.fields, META_SCHEMA), out)
        notes = sorted((get(kv, 1, b""), get(kv, 2, b"")) for kv in get(self.fields, META_KEY_VALUES, (STRUCT, []))[1])
        return bytes(out) + b"".join(k + b"=" + v for k, v in notes if k.endswith(b"row.metadata"))


def read_footer(filesystem: fs.FileSystem, path: str) -> Footer:
    with filesystem.open_input_file(path) as f:
        size = f.size()
        if size < 12:
            raise ValueError(f"{path} is no Parquet file")
        f.seek(size - 8)
        tail = f.read(8)
        if tail[4:] != MAGIC:
            raise ValueError(f"{path} has no plain Parquet footer")
        length = struct.unpack("<I", tail[:4])[0]
        f.seek(size - 8 - length)
        return Footer(_Reader(f.read(length)).struct(), size)


def _group_span(group: list) -> tuple[int, int]:
    """First byte of a row group's blocks and the byte after its last."""
    spans = []
    for chunk in get(group, GROUP_COLUMNS)[1]:
        meta = get(chunk, CHUNK_META)
        if meta is None or get(chunk, 1):
            raise ValueError("column data outside the file is not supported")
        pages = [x for x in (get(meta, COLUMN_DATA), get(meta, COLUMN_DICT)) if x]
        if pages:  # a group without rows may have none
            spans.append((min(pages), min(pages) + get(meta, COLUMN_COMPRESSED)))
    return (min(s for s, _ in spans), max(e for _, e in spans)) if spans else (0, 0)


def _moved(group: list, shift: int, ordinal: int) -> list:
    """The row group's entry with all positions moved. Page indexes and Bloom filters are not taken along."""
    for chunk in get(group, GROUP_COLUMNS)[1]:
        meta = get(chunk, CHUNK_META)
        for number in (COLUMN_DATA, COLUMN_INDEX, COLUMN_DICT):
            if get(meta, number):
                put(meta, number, get(meta, number) + shift)
        put(chunk, CHUNK_META, [f for f in meta if f[0] not in COLUMN_BLOOM_FIELDS])
        if get(chunk, CHUNK_OFFSET):
            put(chunk, CHUNK_OFFSET, get(chunk, CHUNK_OFFSET) + shift)
        chunk[:] = [f for f in chunk if f[0] not in CHUNK_INDEX_FIELDS]
    if get(group, GROUP_OFFSET):
        put(group, GROUP_OFFSET, get(group, GROUP_OFFSET) + shift)
    put(group, GROUP_ORDINAL, ordinal)
    return group


def append_files(filesystem: fs.FileSystem, sources: list[str], target: str, buffer: int = 8 << 20) -> tuple[int, int]:
    """Write target as the row groups of sources, in order, byte for byte; (rows, row groups) of it.

    All sources must have one signature. The target is written whole or, on an error, must be thrown away by the caller.
    """
    groups, rows, first = [], 0, None
    with filesystem.open_output_stream(target) as out:
        out.write(MAGIC)
        at = len(MAGIC)
        for path in sources:
            footer = read_footer(filesystem, path)
            first = first or footer
            if footer.signature != first.signature:
                raise ValueError(f"{path} has another schema")
            with filesystem.open_input_file(path) as f:
                for group in footer.groups:
                    start, end = _group_span(group)
                    f.seek(start)
                    left = end - start
                    while left:
                        data = f.read(min(buffer, left))
                        if not data:
                            raise ValueError(f"{path} ends early")
                        out.write(data)
                        left -= len(data)
                    groups.append(_moved(group, at - start, len(groups)))
                    at += end - start
            rows += footer.rows
        put(first.fields, META_ROWS, rows)
        put(first.fields, META_GROUPS, (STRUCT, groups))
        tail = bytearray()
        _write_struct(first.fields, tail)
        out.write(bytes(tail) + struct.pack("<I", len(tail)) + MAGIC)
    return rows, len(groups)
