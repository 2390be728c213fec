"""BAM files give what SAM texts give."""

import os
import struct
import zlib

from strandline import storage
from strandline.sources import bam, reads

SAM = [
    "r1\t99\tchr1\t101\t60\t5S20M2I3D10M\t=\t301\t250\t" + "ACGTN" * 7 + "AC\t" + "I" * 37,
    "r2\t2064\tchr2\t7\t0\t30M\tchr1\t9\t0\t" + "G" * 30 + "\t*\tSA:Z:chr1,5,+,20S10M,9,0;",
    "r3\t4\t*\t0\t0\t*\t*\t0\t0\tAC\t#$",
]
CONTIGS = [("chr1", 1000), ("chr2", 500)]


def record(line):
    name, flag, ref, pos, mapq, cigar, mate, mate_pos, size, seq, qual, *tags = line.split("\t")
    ids = {n: i for i, (n, _) in enumerate(CONTIGS)} | {"*": -1}
    ids["="] = ids[ref]
    import re

    steps = [(int(n) << 4) | bam.OPERATIONS.index(op) for n, op in re.findall(r"(\d+)([MIDNSHP=X])", cigar)]
    codes = [bam.BASES.index(b) for b in seq]
    codes += [0] * (len(codes) % 2)
    body = bam.RECORD.pack(ids[ref], int(pos) - 1, len(name) + 1, int(mapq), 0, len(steps), int(flag), len(seq), ids[mate], int(mate_pos) - 1, int(size))
    body += name.encode() + b"\0" + struct.pack(f"<{len(steps)}I", *steps) + bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2]))
    body += b"\xff" * len(seq) if qual == "*" else bytes(ord(c) - 33 for c in qual)
    body += b"NMi" + struct.pack("<i", 3) + b"XBBs" + struct.pack("<Ihh", 2, 1, 2)
    for tag in tags:
        body += tag[:2].encode() + b"Z" + tag[5:].encode() + b"\0"
    return struct.pack("<i", len(body)) + body


def block(data):
    z = zlib.compressobj(6, zlib.DEFLATED, -15)
    packed = z.compress(data) + z.flush()
    return struct.pack("<BBBBIBBHBBHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(packed) + 25) + packed + struct.pack("<II", zlib.crc32(data), len(data))


def test_bam_as_sam(spark, tmp_path):
    text = b"@HD\tVN:1.6\n"
    raw = b"BAM\1" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(CONTIGS))
    for name, n in CONTIGS:
        raw += struct.pack("<i", len(name) + 1) + name.encode() + b"\0" + struct.pack("<i", n)
    raw += b"".join(map(record, SAM))
    parts = [raw[i : i + 61] for i in range(0, len(raw), 61)]  # records cross blocks
    (tmp_path / "x.bam").write_bytes(b"".join(map(block, [*parts, b""])))
    (tmp_path / "x.sam").write_text("\n".join(SAM) + "\n")
    key = lambda r: r.read_name
    got = bam.read_bam(spark, str(tmp_path / "x.bam"), "s")
    want = reads.read_sam(spark, str(tmp_path / "x.sam"), "s")
    assert got.schema == want.schema and sorted(got.collect(), key=key) == sorted(want.collect(), key=key)
    assert sorted(map(tuple, bam.read_contigs(spark, str(tmp_path / "x.bam")).collect())) == CONTIGS
    assert reads.read_size(got) == 37


def test_newest(spark, tmp_path):
    assert storage.newest(spark, str(tmp_path)) is None
    for k, name in enumerate("bac"):
        (tmp_path / name).write_text("x")
        os.utime(tmp_path / name, (1000 + (name == "a"), 1000 + (name == "a")))
    assert storage.newest(spark, str(tmp_path)).endswith("/a")
