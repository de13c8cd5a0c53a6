"""FASTA as a Spark data source: ``spark.read.format("fasta")`` and ``spark.readStream.format("fasta")``.

Files (a path, several, a folder or a glob) are planned as byte ranges, one task each. A record belongs to the range that
holds the line feed before its ``>``; a task goes on behind its range to the record's end. Block-gzip files (.bgz) are cut too,
at the starts of their blocks, which a task finds by their headers; other gzip files are one range and unpacked as they
stream by. A task holds one record.

Rows: seq_id, seq, length, source_file, place (rises with the records of a file). Options: header (line: the whole header is the name; token: its first word), clean (true: upper case, IUPAC letters only),
partitionBytes (of a range, compressed or not; 64 MB). The n-th record without a name is sequence_n, in a later range of its
file sequence_<range's start>_<n>. Records of one name all stay: ``readers.read_fasta`` keeps the last one.

The stream gives the records of every file once, in the order of (time of change, path): files must be moved into the folder whole.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator
from fnmatch import fnmatchcase

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .readers import parsed_records

SCHEMA = "seq_id string, seq string, length long, source_file string, place long"
PARTITION, READ = 64 << 20, 1 << 20
_BLOCK = b"\x1f\x8b\x08\x04"
_BATCH = 4 << 20


class Range(InputPartition):
    def __init__(self, path: str, start: int, end: int, kind: str):
        self.path, self.start, self.end, self.kind = path, start, end, kind


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def _files(paths: list[str]) -> list[tuple[str, int, int]]:
    """(path, bytes, time of change) of all files, sorted; a missing path raises."""
    out = set()
    for given in paths:
        system, path = _opened(given)
        head = given[: len(given) - len(path)] if given.endswith(path) else ""
        fixed = path[: min((path.find(c) for c in "*?[" if c in path), default=len(path))]
        if fixed != path:
            root = fixed.rsplit("/", 1)[0] or "/"
            found = [i for i in system.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True)) if i.type == pafs.FileType.File and i.path.count("/") == path.count("/") and all(fnmatchcase(a, b) for a, b in zip(i.path.split("/"), path.split("/"), strict=True))]
        else:
            info = system.get_file_info(path)
            inside = info.type == pafs.FileType.Directory
            found = [i for i in system.get_file_info(pafs.FileSelector(path)) if i.type == pafs.FileType.File and not i.base_name.startswith((".", "_"))] if inside else [info] if info.type == pafs.FileType.File else None
        if not found and not (fixed == path and found is not None):
            raise FileNotFoundError(f"no FASTA file at {given}")
        out |= {(head + i.path, i.size, i.mtime_ns or 0) for i in found}
    return sorted(out)


def _kind(path: str) -> str:
    """plain, gzip or blocks, by a file's first bytes."""
    system, at = _opened(path)
    with system.open_input_file(at) as f:
        head = f.read(18)
    return "plain" if head[:2] != b"\x1f\x8b" else "blocks" if _block_size(head) else "gzip"


def _block_size(head: bytes) -> int:
    """Bytes of the block that begins with head, by its extra field; 0 if it is none."""
    if len(head) < 18 or head[:4] != _BLOCK:
        return 0
    extra = struct.unpack_from("<H", head, 10)[0]
    return struct.unpack_from("<H", head, 16)[0] + 1 if extra >= 6 and head[12:16] == b"BC\x02\x00" else 0


def plan(paths: list[str], size: int = PARTITION) -> list[Range]:
    out = []
    for path, n, _ in _files(paths):
        kind = _kind(path) if n else "plain"
        step = max(1, n) if kind == "gzip" else size
        out += [Range(path, a, min(n, a + step), kind) for a in range(0, max(1, n), step)]
    return out


def _plain(f, part: Range) -> Iterator[tuple[bytes, bool]]:
    f.seek(part.start)
    at = part.start
    while True:
        data = f.read(min(READ, part.end - at) if at < part.end else READ)
        if not data:
            return
        yield data, at < part.end
        at += len(data)


def _gzip(f) -> Iterator[tuple[bytes, bool]]:
    """A stream of gzip members, unpacked piece by piece."""
    machine = zlib.decompressobj(31)
    while data := f.read(READ):
        while data:
            if machine.eof:
                machine = zlib.decompressobj(31)
            out = machine.decompress(data, READ)
            while out or machine.unconsumed_tail:
                if out:
                    yield out, True
                out = machine.decompress(machine.unconsumed_tail, READ) if machine.unconsumed_tail else b""
            data = machine.unused_data if machine.eof else b""


def _first_block(f, start: int, size: int) -> int:
    """Where the first block at or behind ``start`` begins: a header whose block ends at another header or at the file's end."""
    while start < size:
        f.seek(start)
        window = f.read(1 << 17)
        at = window.find(_BLOCK)
        while at >= 0:
            f.seek(start + at)
            n = _block_size(f.read(18))
            f.seek(start + at + n)
            if n and (start + at + n == size or _block_size(f.read(18))):
                return start + at
            at = window.find(_BLOCK, at + 1)
        start += max(1, len(window) - 3)
    return size


def _blocks(f, part: Range, size: int) -> Iterator[tuple[bytes, bool]]:
    at = 0 if part.start == 0 else _first_block(f, part.start, size)
    while at < size:
        f.seek(at)
        n = _block_size(f.read(18))
        if not n:
            raise ValueError(f"{part.path}: no gzip block at byte {at}")
        f.seek(at)
        data = zlib.decompress(f.read(n), 31)
        if data:
            yield data, at < part.end
        elif at >= part.end:
            return
        at += n


def owned(chunks: Iterator[tuple[bytes, bool]], first: bool) -> Iterator[bytes]:
    """The pieces, each from a ``>`` at a line's start, whose line feed before lies in a chunk that is marked; ``first``: the file's start too."""
    held = bytearray() if first else None
    fed: bool | None = None  # the mark of a chunk that ended with a line feed
    for data, inside in chunks:
        if fed is not None and data[:1] == b">":
            if held is not None:
                yield bytes(held[:-1])
            if not fed:
                return
            held = bytearray()
        at = 0
        while (i := data.find(b"\n>", at)) >= 0:
            if held is not None:
                held += data[at:i]
                yield bytes(held)
            if not inside:
                return
            held, at = bytearray(), i + 1
        if held is not None:
            held += data[at:]
        elif not inside:
            return
        fed = inside if data.endswith(b"\n") else None
    if held is not None:
        yield bytes(held)


def records(part: Range, header: str, clean: bool) -> Iterator[tuple[str, str]]:
    system, path = _opened(part.path)
    unnamed = 0
    with system.open_input_file(path) as f:
        chunks = _gzip(f) if part.kind == "gzip" else _blocks(f, part, f.size()) if part.kind == "blocks" else _plain(f, part)
        for piece in owned(chunks, part.start == 0):
            for name, seq in parsed_records(piece.decode("utf-8", "replace"), False, header, clean):
                if not name:
                    unnamed += 1
                    name = f"sequence_{part.start}_{unnamed}" if part.start else f"sequence_{unnamed}"
                yield name, seq


class _Options:
    def __init__(self, options: dict):
        self.header = options.get("header", "line")
        if self.header not in ("line", "token"):
            raise ValueError(f"header is line or token, not {self.header}")
        self.clean = str(options.get("clean", "true")).lower() == "true"
        self.size = int(options.get("partitionBytes", PARTITION))
        given = options.get("paths") or options.get("path")
        if not given:
            raise ValueError("give a path")
        self.paths = json.loads(given) if given.startswith("[") else [given]

    def batches(self, part: Range) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for k, (name, seq) in enumerate(records(part, self.header, self.clean)):
            rows.append((name, seq, len(seq), part.path, (part.start << 20) + k))
            held += len(seq)
            if held >= _BATCH:
                yield self._batch(rows)
                rows, held = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["seq_id", "seq", "length", "source_file", "place"])


class FastaReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = _Options(options)

    def partitions(self) -> list[Range]:
        return plan(self.options.paths, self.options.size)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        yield from self.options.batches(partition)


class FastaStreamReader(DataSourceStreamReader):
    """Offsets are the last file of a batch: its time of change and its path."""

    def __init__(self, options: dict):
        self.options = _Options(options)

    def _later(self, start: dict, end: dict | None = None) -> list[tuple[int, str, int]]:
        found = sorted((t, path, n) for path, n, t in _files(self.options.paths))
        return [f for f in found if f[:2] > (start["time"], start["path"]) and (end is None or f[:2] <= (end["time"], end["path"]))]

    def initialOffset(self) -> dict:
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict:
        found = self._later(self.initialOffset())
        return {"time": found[-1][0], "path": found[-1][1]} if found else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return [r for _, path, _ in self._later(start, end) for r in plan([path], self.options.size)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        yield from self.options.batches(partition)

    def commit(self, end: dict) -> None:
        """Nothing is kept but the offset, which the checkpoint holds."""


class FastaDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fasta"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return FastaReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return FastaStreamReader(self.options)


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    spark.dataSource.register(FastaDataSource)
