"""Binary alignments (BAM) as the table that SAM texts give.

A file's compressed blocks are inflated one after another and its records become SAM lines, which the SAM
reader parses. Each file is one task's work and Spark's binary source holds up to 2 GB of it, so
larger ones should be kept as a folder of parts, as aligners of many reads write them.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import reads

#: Codes of bases and CIGAR operations, and sizes of tag values.
BASES, OPERATIONS = "=ACMGRSVTWYHKDBN", "MIDNSHP=X"
SIZES = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}
RECORD = struct.Struct("<iiBBHHHiiii")


def inflate(data: bytes) -> Iterator[bytes]:
    """The blocks of a BGZF file."""
    at = 0
    while at < len(data):
        extra = struct.unpack_from("<H", data, at + 10)[0]
        field, size = at + 12, 0
        while field < at + 12 + extra:
            tag, n = data[field : field + 2], struct.unpack_from("<H", data, field + 2)[0]
            if tag == b"BC":
                size = struct.unpack_from("<H", data, field + 4)[0] + 1
            field += 4 + n
        if not size:
            raise ValueError("not a BGZF block")
        yield zlib.decompress(data[at + 12 + extra : at + size - 8], -15)
        at += size


class Stream:
    """Bytes of the blocks as they are asked for; a record may cross blocks."""

    def __init__(self, data: bytes):
        self.blocks, self.held = inflate(data), b""

    def take(self, n: int) -> bytes:
        while len(self.held) < n:
            block = next(self.blocks, None)
            if block is None:
                if self.held:
                    raise ValueError("the file ends inside a record")
                return b""
            self.held += block
        out, self.held = self.held[:n], self.held[n:]
        return out

    def number(self) -> int:
        return struct.unpack("<i", self.take(4))[0]


def header(stream: Stream) -> list[tuple[str, int]]:
    """Names and lengths of the contigs."""
    if stream.take(4) != b"BAM\1":
        raise ValueError("not a BAM file")
    stream.take(stream.number())
    return [(stream.take(stream.number())[:-1].decode(), stream.number()) for _ in range(stream.number())]


def supplementary_tag(tags: bytes) -> str | None:
    """The value of the SA tag."""
    at = 0
    while at < len(tags):
        name, kind = tags[at : at + 2], chr(tags[at + 2])
        at += 3
        if kind in "ZH":
            end = tags.index(b"\0", at)
            if name == b"SA":
                return tags[at:end].decode()
            at = end + 1
        elif kind == "B":
            at += 5 + SIZES[chr(tags[at])] * struct.unpack_from("<I", tags, at + 1)[0]
        else:
            at += SIZES[kind]
    return None


def sam_line(record: bytes, names: list[str]) -> str:
    ref, pos, name_n, mapq, _, cigar_n, flag, seq_n, mate, mate_pos, size = RECORD.unpack_from(record)
    at = RECORD.size
    name = record[at : at + name_n - 1].decode()
    at += name_n
    cigar = "".join(f"{x >> 4}{OPERATIONS[x & 15]}" for x in struct.unpack_from(f"<{cigar_n}I", record, at)) or "*"
    at += 4 * cigar_n
    packed = record[at : at + (seq_n + 1) // 2]
    seq = "".join(BASES[b >> 4] + BASES[b & 15] for b in packed)[:seq_n] or "*"
    at += len(packed)
    raw = record[at : at + seq_n]
    qual = "*" if not seq_n or raw[0] == 255 else "".join(chr(q + 33) for q in raw)
    sa = supplementary_tag(record[at + seq_n :])
    of = lambda k: names[k] if k >= 0 else "*"
    fields = [name, flag, of(ref), pos + 1, mapq, cigar, "=" if mate == ref and mate >= 0 else of(mate), mate_pos + 1, size, seq, qual, *([f"SA:Z:{sa}"] if sa else [])]
    return "\t".join(map(str, fields))


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("content")


def read_contigs(spark: SparkSession, path: str) -> DataFrame:
    """ref and length from the headers of the files."""

    def emit(batches):
        for batch in batches:
            for data in batch.column("content"):
                found = header(Stream(data.as_py()))
                yield pa.record_batch([pa.array([n for n, _ in found], pa.string()), pa.array([x for _, x in found], pa.int64())], names=["ref", "length"])

    return _files(spark, path).mapInArrow(emit, "ref string, length long").distinct()


def read_bam(spark: SparkSession, path: str, sample: str | None = None) -> DataFrame:
    """The table of ``reads.read_sam``, from a file or a folder of files."""

    def emit(batches):
        for batch in batches:
            for data in batch.column("content"):
                stream = Stream(data.as_py())
                names, lines = [n for n, _ in header(stream)], []
                while head := stream.take(4):
                    lines.append(sam_line(stream.take(struct.unpack("<i", head)[0]), names))
                    if len(lines) == 5000:
                        yield pa.record_batch([pa.array(lines, pa.string())], names=["value"])
                        lines = []
                yield pa.record_batch([pa.array(lines, pa.string())], names=["value"])

    return reads.from_lines(_files(spark, path).mapInArrow(emit, "value string"), sample)
