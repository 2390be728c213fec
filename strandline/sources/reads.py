"""Alignments of reads as a table, and the events in them: clips, indels, supplementary and discordant reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sequence as S

FLAGS = {"paired": 1, "proper": 2, "unmapped": 4, "mate_unmapped": 8, "reverse": 16, "mate_reverse": 32, "read1": 64, "secondary": 256, "duplicate": 1024, "supplementary": 2048}


def read_sam(spark: SparkSession, path: str, sample: str | None = None) -> DataFrame:
    """Alignments of a SAM text: pos is 0-based, end exclusive; a column for each flag; sa is the SA tag."""
    return from_lines(spark.read.text(path), sample)


def from_lines(lines: DataFrame, sample: str | None = None) -> DataFrame:
    """The same from SAM lines in the column ``value``."""
    f = F.split("value", "\t")
    rows = lines.where(~F.col("value").startswith("@") & (F.size(f) >= 11))
    flag = f[1].cast("int")
    tag = F.regexp_extract("value", r"\tSA:Z:([^\t]*)", 1)
    out = rows.select(
        f[0].alias("read_name"),
        f[2].alias("ref"),
        (f[3].cast("int") - 1).alias("pos"),
        f[4].cast("int").alias("mapq"),
        f[5].alias("cigar"),
        F.when(f[6] == "=", f[2]).otherwise(f[6]).alias("mate_ref"),
        (f[7].cast("int") - 1).alias("mate_pos"),
        f[8].cast("int").alias("template_len"),
        F.nullif(f[9], F.lit("*")).alias("seq"),
        F.nullif(f[10], F.lit("*")).alias("qual"),
        F.nullif(tag, F.lit("")).alias("sa"),
        F.lit(sample).cast("string").alias("sample"),
        *[flag.bitwiseAND(bit).cast("boolean").alias(name) for name, bit in FLAGS.items()],
    )
    return out.withColumn("end", F.col("pos") + S.reference_length("cigar").cast("int"))


def read_size(reads: DataFrame, most: int = 500) -> int:
    """The length of most of some reads (``most`` of them; the longest of equals): a property of a library, not of a read."""
    n = reads.where("seq IS NOT NULL").select(F.length("seq").alias("n")).limit(most)
    found = n.groupBy("n").count().orderBy(F.desc("count"), F.desc("n")).first()
    return found.n if found else 0


def usable(reads: DataFrame, least_mapq: int = 10, duplicates: bool = False, supplementary: bool = True) -> DataFrame:
    """Mapped primary alignments with bases and quality enough."""
    keep = ~F.col("unmapped") & ~F.col("secondary") & F.col("seq").isNotNull() & (F.col("mapq") >= least_mapq)
    if not duplicates:
        keep &= ~F.col("duplicate")
    if not supplementary:
        keep &= ~F.col("supplementary")
    return reads.where(keep)


#: An array of (n, op, query and reference places before it) of a CIGAR, by one fold.
STEPS = r"""aggregate(regexp_extract_all(cigar, '(\\d+[MIDNSHP=X])', 1),
  struct(0L AS q, 0L AS r, CAST(array() AS array<struct<n: bigint, op: string, q: bigint, r: bigint>>) AS steps),
  (s, x) -> transform(array(struct(CAST(left(x, length(x) - 1) AS BIGINT) AS n, right(x, 1) AS op)), t -> struct(
    s.q + CASE WHEN t.op IN ('M', 'I', 'S', '=', 'X') THEN t.n ELSE 0 END AS q,
    s.r + CASE WHEN t.op IN ('M', 'D', 'N', '=', 'X') THEN t.n ELSE 0 END AS r,
    concat(s.steps, array(struct(t.n AS n, t.op AS op, s.q AS q, s.r AS r))) AS steps))[0], s -> s.steps)"""


def _event(kind: str, reads: DataFrame, beg: Column, end: Column, length: Column, seq: Column, side: Column | None = None) -> DataFrame:
    return reads.select(
        F.lit(kind).alias("type"), "ref", beg.cast("long").alias("beg"), end.cast("long").alias("end"), length.cast("long").alias("length"),
        "read_name", "sample", (F.lit(None).cast("string") if side is None else side).alias("side"), seq.alias("insert_seq"),
        F.when(F.col("reverse"), "-").otherwise("+").alias("orientation"), "mapq", F.col("duplicate").alias("is_dup"), "mate_ref", "mate_pos",
    )


def indels(reads: DataFrame, least: int = 50) -> DataFrame:
    """INS and DEL events inside alignments: place on the reference, length, inserted bases."""
    rows = reads.withColumn("x", F.explode(F.expr(f"filter({STEPS}, s -> s.op IN ('I', 'D') AND s.n >= {least})")))
    at = F.col("pos") + F.col("x.r")
    ins = rows.where("x.op = 'I'")
    dels = rows.where("x.op = 'D'")
    inserted = F.expr("substring(seq, CAST(x.q + 1 AS INT), CAST(x.n AS INT))")
    return _event("INS", ins, at, at, F.col("x.n"), inserted).unionByName(_event("DEL", dels, at, at + F.col("x.n"), F.col("x.n"), F.lit(None).cast("string")))


def clips(reads: DataFrame, least: int = 50) -> DataFrame:
    """CLIPPING events at an alignment's ends: breakpoint, side, clipped bases if they are soft."""
    sides = F.explode(F.array(F.struct(F.lit("left").alias("side"), F.regexp_extract("cigar", r"^(\d+)[SH]", 1).alias("n"), F.col("cigar").rlike(r"^\d+S").alias("soft")), F.struct(F.lit("right").alias("side"), F.regexp_extract("cigar", r"(\d+)[SH]$", 1).alias("n"), F.col("cigar").endswith("S").alias("soft"))))
    rows = reads.withColumn("x", sides).withColumn("n", F.col("x.n").try_cast("int")).where(F.col("n") >= least)
    at = F.when(F.col("x.side") == "left", F.col("pos")).otherwise(F.col("end"))
    seq = F.when(F.col("x.soft"), F.when(F.col("x.side") == "left", F.expr("left(seq, n)")).otherwise(F.expr("right(seq, n)")))
    return _event("CLIPPING", rows, at, at, F.col("n"), seq, F.col("x.side"))


def discordant(reads: DataFrame) -> DataFrame:
    """DISCORDANT events: paired reads that aren't a proper pair though both ends are mapped."""
    rows = reads.where("paired AND NOT proper AND NOT mate_unmapped")
    return _event("DISCORDANT", rows, F.col("pos"), F.col("end"), F.col("end") - F.col("pos"), F.lit(None).cast("string"))


def events(reads: DataFrame, least_clip: int = 50, least_indel: int = 50) -> DataFrame:
    """All events in one table, told apart by ``type``."""
    return indels(reads, least_indel).unionByName(clips(reads, least_clip)).unionByName(discordant(reads))


def supplementary(reads: DataFrame) -> DataFrame:
    """The alignments that SA tags name, a row each: ref, pos (0-based), strand, cigar, mapq and the interval on the read."""
    rows = reads.where("sa IS NOT NULL").select("read_name", F.explode(F.split("sa", ";")).alias("e")).where("e <> ''")
    f = F.split("e", ",")
    out = rows.select("read_name", f[0].alias("ref"), (f[1].cast("int") - 1).alias("pos"), f[2].alias("strand"), f[3].alias("cigar"), f[4].cast("int").alias("mapq"))
    out = out.withColumn("minus__", F.col("strand") == "-").withColumn("on_read", S.query_interval("cigar", "minus__"))
    return out.select("read_name", "ref", "pos", (F.col("pos") + S.reference_length("cigar").cast("int")).alias("end"), "strand", "cigar", "mapq", F.col("on_read.beg").alias("q_beg"), F.col("on_read.end").alias("q_end"))


def fastq(reads: DataFrame) -> DataFrame:
    """Reads as they were sequenced: those on the reverse strand turned back."""
    turned = F.when(F.col("reverse"), S.reverse_complement("seq")).otherwise(F.col("seq"))
    return reads.where("NOT secondary AND NOT supplementary").select(F.col("read_name").alias("seq_id"), F.lit(None).cast("string").alias("description"), turned.alias("seq"), F.when(F.col("reverse"), F.reverse("qual")).otherwise(F.col("qual")).alias("qual"))


def blocks(reads: DataFrame) -> DataFrame:
    """Intervals on the reference that reads cover, split at skipped parts."""
    cut = F.expr(f"filter({STEPS}, s -> s.op = 'N')")
    n = F.concat(F.array(F.lit(0).cast("long")), F.transform(cut, lambda s: s["r"] + s["n"]))
    e = F.concat(F.transform(cut, lambda s: s["r"]), F.array((F.col("end") - F.col("pos")).cast("long")))
    rows = reads.withColumn("x", F.explode(F.arrays_zip(n.alias("b"), e.alias("e"))))
    return rows.select("ref", (F.col("pos") + F.col("x.b")).alias("beg"), (F.col("pos") + F.col("x.e")).alias("end"), "read_name", "mapq", F.when(F.col("reverse"), "-").otherwise("+").alias("strand"))


def as_paf(reads: DataFrame) -> DataFrame:
    """Mapped alignments as the columns of PAF that a SAM line knows: query and target intervals, strand, quality."""
    on_read = S.query_interval("cigar", "reverse")
    n = S.cigar_length("cigar", "M=XISH")
    strand = F.when(F.col("reverse"), "-").otherwise("+")
    return reads.where("NOT unmapped").select(F.col("read_name").alias("q_name"), n.alias("q_len"), on_read["beg"].alias("q_beg"), on_read["end"].alias("q_end"), strand.alias("strand"), F.col("ref").alias("t_name"), F.col("pos").alias("t_beg"), F.col("end").alias("t_end"), "mapq")
