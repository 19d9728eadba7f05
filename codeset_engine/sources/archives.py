"""Zip archives as a Spark data source, read member by member by many tasks.

The driver reads an archive's directory only; each input partition is a range of its members, and
a task seeks to their bytes and inflates them as a stream. So an archive may be larger than any
task's memory, and so may a member, whose content leaves in parts.
"""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from collections.abc import Iterator
from typing import NamedTuple

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

TASK_BYTES = 64 << 20    # compressed bytes of a range of members
PART_BYTES = 8 << 20     # content of one row
READ_BYTES = 1 << 20
STORED, DEFLATED = 0, 8
ENCRYPTED = 1            # bit of a member's flags


class Member(NamedTuple):
    name: str
    offset: int
    packed: int
    size: int
    crc: int
    method: int
    flags: int


class MemberRange(InputPartition):
    """Some members of one archive, or the reason why its directory cannot be read."""

    def __init__(self, archive: str, members: list[Member], error: str | None = None):
        super().__init__((archive, members, error))
        self.archive, self.members, self.error = archive, members, error


def _open(uri: str):
    system, path = fs.FileSystem.from_uri(uri)
    return system.open_input_file(path)


def archive_files(path: str) -> list[str]:
    """The archive itself, or all ``.zip`` files of a folder and its subfolders, by name."""
    system, inner = fs.FileSystem.from_uri(path)
    if system.get_file_info(inner).type == fs.FileType.File:
        return [path]
    found = system.get_file_info(fs.FileSelector(inner, recursive=True))
    root = path.rstrip("/")
    return sorted(root + info.path[len(inner.rstrip("/")):] for info in found
                  if info.type == fs.FileType.File and info.path.lower().endswith(".zip"))


def member_ranges(archive: str, task_bytes: int) -> list[MemberRange]:
    """The members (no folders) in ranges of about ``task_bytes``."""
    try:
        with _open(archive) as file, zipfile.ZipFile(file) as directory:
            members = [Member(i.filename, i.header_offset, i.compress_size, i.file_size, i.CRC, i.compress_type,
                              i.flag_bits) for i in directory.infolist() if not i.is_dir()]
    except Exception as error:
        return [MemberRange(archive, [], f"{type(error).__name__}: {error}")]
    ranges: list[list[Member]] = []
    held = task_bytes
    for member in members:
        if held >= task_bytes:
            ranges.append([])
            held = 0
        ranges[-1].append(member)
        held += max(member.packed, 1)
    return [MemberRange(archive, r) for r in ranges]


def _inflated(file, member: Member, part_bytes: int) -> Iterator[bytes]:
    """The content of a member in parts; its length and checksum are compared at the end."""
    if member.flags & ENCRYPTED:
        raise ValueError("member is encrypted")
    if member.method not in (STORED, DEFLATED):
        raise ValueError(f"compression method {member.method} is not read")
    file.seek(member.offset)
    header = file.read(30)
    if len(header) < 30 or header[:4] != b"PK\x03\x04":
        raise ValueError("no member at its offset")
    name, extra = struct.unpack("<HH", header[26:30])
    file.seek(member.offset + 30 + name + extra)
    inflate = zlib.decompressobj(-zlib.MAX_WBITS) if member.method == DEFLATED else None
    held, left, crc, size = io.BytesIO(), member.packed, 0, 0

    def cut(last: bool) -> Iterator[bytes]:
        data = held.getvalue()
        whole = len(data) if last else len(data) // part_bytes * part_bytes
        for start in range(0, whole, part_bytes):
            yield data[start:min(start + part_bytes, whole)]
        held.seek(0)
        held.truncate()
        held.write(data[whole:])

    while left:
        packed = file.read(min(READ_BYTES, left))
        if not packed:
            raise ValueError("archive ends within a member")
        left -= len(packed)
        while packed:
            data = inflate.decompress(packed, part_bytes) if inflate else packed
            packed = inflate.unconsumed_tail if inflate else b""
            held.write(data)
            crc, size = zlib.crc32(data, crc), size + len(data)
            if held.tell() >= part_bytes:
                yield from cut(False)
    if inflate:
        data = inflate.flush()
        held.write(data)
        crc, size = zlib.crc32(data, crc), size + len(data)
    if (crc, size) != (member.crc, member.size):
        raise ValueError("content does not match its checksum")
    yield from cut(True)


class ZipReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        if "path" not in options:
            raise ValueError("the zip source needs a path")
        self.path = options["path"]
        self.task_bytes = int(options.get("taskbytes", TASK_BYTES))
        self.part_bytes = int(options.get("partbytes", PART_BYTES))

    def partitions(self) -> list[MemberRange]:
        return [r for archive in archive_files(self.path) for r in member_ranges(archive, self.task_bytes)] or [
            MemberRange("", [])]

    def read(self, partition: MemberRange) -> Iterator[tuple]:
        if partition.error:
            yield partition.archive, None, 0, None, None, partition.error
        if not partition.members:
            return
        with _open(partition.archive) as file:
            for member in partition.members:
                part = 0
                try:
                    for content in _inflated(file, member, self.part_bytes):
                        yield partition.archive, member.name, part, member.size, content, None
                        part += 1
                    if not part:
                        yield partition.archive, member.name, 0, 0, b"", None
                except Exception as error:
                    yield partition.archive, member.name, part, member.size, None, f"{type(error).__name__}: {error}"


class ZipSource(DataSource):
    """``zip``: archive, member, part, size, content, error. Options: path, taskBytes, partBytes."""

    @classmethod
    def name(cls) -> str:
        return "zip"

    def schema(self) -> str:
        return "archive string, member string, part int, size long, content binary, error string"

    def reader(self, schema) -> ZipReader:
        return ZipReader({key.lower(): value for key, value in self.options.items()})


def scan_archives(spark: SparkSession, path: str, task_bytes: int = TASK_BYTES,
                  part_bytes: int = PART_BYTES) -> DataFrame:
    """Rows (archive, member, part, size, content, error) of an archive or a folder of them.

    A member that is damaged keeps the parts that were read and ends with a row that has the error;
    an archive without a readable directory has one row with its error. Paths are those that
    ``pyarrow.fs`` opens (local, hdfs, s3, gs), from the driver and from the tasks.
    """
    spark.dataSource.register(ZipSource)
    return (spark.read.format("zip").option("taskBytes", task_bytes).option("partBytes", part_bytes)
            .load(path))
