"""BAM as a data source: blocks of gzip with binary records, read as a stream, one partition per file."""

from __future__ import annotations

import glob
import os
import struct
import zlib
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Records that go to Spark at once.
BATCH = 50_000
SCHEMA = "rid bigint, flag int, seqid string, pos bigint, span bigint"
#: Operations that advance on the reference: M, D, N, = and X among MIDNSHP=X.
ON_REFERENCE = {0, 2, 3, 7, 8}


class BadBam(ValueError):
    """The file isn't BAM or breaks off."""


class _Blocks:
    """The unpacked bytes of concatenated gzip members, a block at a time."""

    def __init__(self, file):
        self.file, self.packed, self.data, self.at = file, b"", b"", 0

    def _more(self) -> bool:
        unpack = zlib.decompressobj(31)
        out = []
        while not unpack.eof:
            if not self.packed:
                self.packed = self.file.read(1 << 16)
                if not self.packed:
                    if out or unpack.unconsumed_tail:
                        raise BadBam("cut off block")
                    return False
            try:
                out.append(unpack.decompress(self.packed))
            except zlib.error as fault:
                raise BadBam(str(fault)) from None
            self.packed = unpack.unused_data
        self.data, self.at = self.data[self.at :] + b"".join(out), 0
        return True

    def take(self, n: int) -> bytes | None:
        """None at the end of the file."""
        while len(self.data) - self.at < n:
            if not self._more():
                if len(self.data) > self.at:
                    raise BadBam("cut off record")
                return None
        out = self.data[self.at : self.at + n]
        self.at += n
        return out

    def must(self, n: int) -> bytes:
        if (out := self.take(n)) is None and n:
            raise BadBam("cut off header")
        return out or b""


def records(file) -> Iterator[tuple[int, str, int, int]]:
    """(flag, sequence name or "*", 0-based position, bases of reference) of each record."""
    blocks = _Blocks(file)
    if blocks.must(4) != b"BAM\1":
        raise BadBam("no BAM magic")
    blocks.must(struct.unpack("<i", blocks.must(4))[0])
    names = []
    for _ in range(struct.unpack("<i", blocks.must(4))[0]):
        names.append(blocks.must(struct.unpack("<i", blocks.must(4))[0])[:-1].decode("ascii", "replace"))
        blocks.must(4)
    while (size := blocks.take(4)) is not None:
        body = blocks.must(struct.unpack("<i", size)[0])
        ref, pos, l_name, _, _, n_cigar, flag = struct.unpack_from("<iiBBHHH", body)
        cigar = struct.unpack_from(f"<{n_cigar}I", body, 32 + l_name)
        span = sum(c >> 4 for c in cigar if c & 15 in ON_REFERENCE)
        yield flag, names[ref] if 0 <= ref < len(names) else "*", pos, span


class _File(InputPartition):
    def __init__(self, number: int, path: str):
        super().__init__(number)
        self.number, self.path = number, path


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path.removeprefix("file://")

    def partitions(self) -> list[InputPartition]:
        found = sorted(glob.glob(os.path.join(self.path, "*.bam"))) if os.path.isdir(self.path) else sorted(glob.glob(self.path))
        if not found:
            raise FileNotFoundError(self.path)
        return [_File(i, p) for i, p in enumerate(found)]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
        with open(partition.path, "rb") as file:
            found, n = records(file), 0
            while rows := list(islice(found, BATCH)):
                ids = range((partition.number << 40) + n, (partition.number << 40) + n + len(rows))
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip((ids, *zip(*rows)), types)], names=[c.split()[0] for c in SCHEMA.split(", ")])
                n += len(rows)


class BamSource(DataSource):
    """``spark.read.format("strandline_bam").load(path)``: a file, a folder or a pattern on a file system all executors mount."""

    @classmethod
    def name(cls) -> str:
        return "strandline_bam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])
