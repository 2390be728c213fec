"""Text formats of genomics as typed tables, and back: sequences, intervals, alignments, repeats, single cells.

Readers are plans over Spark's text source: lines are split and cast by expressions, so
files are read in parallel. Lines that a format doesn't allow give no row. The row order
of a file is kept as ``ord`` where ties are broken by it (within a file: the order of
Spark's splits, then of lines).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The columns of the formats, in their order.
PAF = "q_name string, q_len int, q_beg int, q_end int, strand string, t_name string, t_len int, t_beg int, t_end int, nb_matches int, block_len int, mapq int"
PSL = (
    "matches int, mismatches int, rep_matches int, n_count int, q_gaps int, q_gap_bases int, t_gaps int, t_gap_bases int, strand string,"
    " q_name string, q_len int, q_beg int, q_end int, t_name string, t_len int, t_beg int, t_end int, blocks int, block_sizes string, q_starts string, t_starts string"
)
TRF = (
    "beg int, end int, repeat_size int, nb_copies double, motif_size int, perc_matches double, perc_indels double, score double,"
    " perc_a double, perc_c double, perc_g double, perc_t double, entropy double, motif_seq string, tr_seq string, no_tr5 string, no_tr3 string"
)
CELLS = ["chrom", "beg", "end", "sample", "cell", "state", "scalar", "nb_bins", "call1", "code1", "call2", "code2", "llr2ref", "llr2second", "af"]


def _typed(fields: Column, schema: str) -> list[Column]:
    names = [part.split() for part in schema.split(",")]
    return [F.try_element_at(fields, F.lit(i + 1)).try_cast(kind).alias(name) for i, (name, kind) in enumerate(names)]


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).withColumn("ord", F.monotonically_increasing_id())


# sequences --------------------------------------------------------------------------------------


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """seq_id (up to the first white space) and seq, a row a record."""
    parts = spark.read.option("lineSep", ">").text(path).where(F.trim("value") != "")
    head = F.substring_index("value", "\n", 1)
    body = F.regexp_replace("value", r"^[^\n]*\n?", "")
    return parts.select(F.regexp_extract(head, r"^(\S*)", 1).alias("seq_id"), F.regexp_replace(body, r"\s", "").alias("seq"))


def fasta_record(seq_id: Column | str, seq: Column | str) -> Column:
    as_column = lambda x: F.col(x) if isinstance(x, str) else x
    return F.concat(F.lit(">"), as_column(seq_id), F.lit("\n"), as_column(seq))


def write_fasta(seqs: DataFrame, path: str) -> None:
    """Two lines a record, in as many files as partitions."""
    seqs.select(fasta_record("seq_id", "seq").alias("value")).write.mode("overwrite").text(path)


def fastq_record() -> Column:
    """Four lines from seq_id, description, seq and qual; a missing description leaves the bare id."""
    return F.concat(F.lit("@"), F.concat_ws(" ", "seq_id", F.nullif("description", F.lit(""))), F.lit("\n"), F.col("seq"), F.lit("\n+\n"), F.col("qual"))


def write_fastq(seqs: DataFrame, path: str) -> None:
    seqs.select(fastq_record().alias("value")).write.mode("overwrite").text(path)


def phred(qualities: Column | str) -> Column:
    """Text of an array of qualities: the character of each plus 33."""
    return F.array_join(F.transform(qualities, lambda q: F.char((q + 33).cast("long"))), "")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """ref and length from a FASTA index."""
    return spark.read.csv(path, sep="\t", schema="ref string, length long, offset long, bases int, width int").select("ref", "length")


# intervals --------------------------------------------------------------------------------------


def read_bed(spark: SparkSession, path: str, refs: list[str] | None = None) -> DataFrame:
    """ref, beg, end and a column for each further name in the '#' line (else name, where there is a fourth field)."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    head = lines.where(F.col("value").startswith("#")).limit(1).collect()
    names = head[0].value.lstrip("#").split()[3:] if head else ["name"]
    f = F.split(F.trim("value"), r"\s+")
    rows = lines.where(~F.col("value").startswith("#") & (F.size(f) >= 3))
    out = rows.select(f[0].alias("ref"), f[1].try_cast("int").alias("beg"), f[2].try_cast("int").alias("end"), *[F.try_element_at(f, F.lit(i + 4)).alias(n) for i, n in enumerate(names)])
    return out.where(F.col("ref").isin(refs)) if refs is not None else out


def write_bed(ivals: DataFrame, path: str, optional: list[str] = ()) -> None:
    """A header line and rows by reference and begin, in parts whose order is that of their names."""
    columns = ["ref", "beg", "end", *optional]
    head = ivals.sparkSession.createDataFrame([(0, "", 0, "#" + "\t".join(columns))], "o int, ref string, beg int, value string")
    rows = ivals.select(F.lit(1).alias("o"), "ref", F.col("beg").cast("int").alias("beg"), F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit(".")) for c in columns]).alias("value"))
    head.unionByName(rows).orderBy("o", "ref", "beg", "value").select("value").write.mode("overwrite").text(path)


def annovar_line() -> Column:
    """Input line of a gene annotator: ref, beg, end, two zeros and the name as a comment."""
    return F.concat_ws("\t", "ref", F.col("beg").cast("string"), F.col("end").cast("string"), F.lit("0"), F.lit("0"), F.concat(F.lit("comments: "), F.col("name")))


def read_annovar(spark: SparkSession, path: str) -> DataFrame:
    """region, gene and name (the comment) of annotated intervals."""
    f = F.split("value", "\t")
    return spark.read.text(path).where(F.size(f) >= 3).select(f[0].alias("region"), f[1].alias("gene"), F.regexp_replace(F.element_at(f, -1), "^comments: ", "").alias("name"))


def transduced_windows(sources: DataFrame, size: int, buffer: int, ends: list[int] = (5, 3)) -> DataFrame:
    """Where a source element's transductions come from: a window beyond its 5' or 3' end, by its strand.

    A window begins ``buffer`` before the element's end and reaches ``size`` beyond it.
    """
    rows = sources.withColumn("src_end", F.explode(F.array(*[F.lit(e) for e in ends])))
    after = (F.col("src_end") == 3) == (F.col("strand") == "+")
    beg = F.when(after, F.col("end") - buffer).otherwise(F.greatest(F.col("beg") - size, F.lit(0)))
    end = F.when(after, F.col("end") + size).otherwise(F.col("beg") + buffer)
    return rows.select(*sources.columns, "src_end", beg.alias("td_beg"), end.alias("td_end"))


# alignments and repeats -------------------------------------------------------------------------


def read_paf(spark: SparkSession, path: str) -> DataFrame:
    """The twelve columns of a hit and its order; lines with fewer fields give none."""
    f = F.split(F.trim("value"), r"\s+")
    rows = _lines(spark, path).where(~F.col("value").startswith("#") & (F.size(f) >= 12))
    return rows.select("ord", *_typed(f, PAF))


def read_psl(spark: SparkSession, path: str) -> DataFrame:
    """The 21 columns; header lines, which don't begin with a count, give no rows."""
    f = F.split(F.trim("value"), r"\s+")
    rows = _lines(spark, path).where((F.size(f) >= 21) & F.col("value").rlike(r"^\s*\d"))
    return rows.select("ord", *_typed(f, PSL))


def psl_targets(hits: DataFrame) -> DataFrame:
    """Each query's targets."""
    return hits.groupBy("q_name").agg(F.sort_array(F.collect_set("t_name")).alias("t_names"))


def psl_coverage(hits: DataFrame) -> DataFrame:
    """Adds the aligned percentage of each hit's query."""
    return hits.withColumn("align_perc", F.expr("try_divide(q_end - q_beg, q_len) * 100"))


def read_trf(spark: SparkSession, path: str) -> DataFrame:
    """Calls of a tandem repeat finder by sequence; beg and end are stored less by 1, tr_len is end - beg.

    A line that begins with '@' names the sequence of the calls below it. Lines are read one by one, so a
    sequence with many calls is spread over tasks; a split of a file takes over the name of the splits before it.
    """
    at = ["file__", "block__"]
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file__"), F.col("_metadata.file_block_start").alias("block__"), F.monotonically_increasing_id().alias("id__"), "value")
    # a name and the number of its line in the split; the lines of a split are in order by id
    lines = lines.withColumn("name__", F.when(F.col("value").startswith("@"), F.regexp_extract("value", r"^@(\S*)", 1)))
    w = Window.partitionBy(*at).orderBy("id__").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("line__", F.row_number().over(Window.partitionBy(*at).orderBy("id__")))
    rows = rows.withColumn("head__", F.last(F.when(F.col("name__").isNotNull(), F.struct(F.col("name__").alias("name"), F.col("line__").alias("line"))), ignorenulls=True).over(w))
    blocks = lines.groupBy(*at).agg(F.count(F.lit(1)).alias("n"), F.max_by("name__", F.when(F.col("name__").isNotNull(), F.col("id__"))).alias("name"), F.max(F.when(F.col("name__").isNotNull(), F.col("id__"))).alias("last_id"), F.max("id__").alias("end_id"))
    over = Window.partitionBy("file__").orderBy("block__")
    upto, before = over.rowsBetween(Window.unboundedPreceding, 0), over.rowsBetween(Window.unboundedPreceding, -1)
    # lines of the file up to the end of a split; the name that its last lines have, and where it stands
    blocks = blocks.withColumn("sum__", F.sum("n").over(upto))
    blocks = blocks.withColumn("open__", F.when(F.col("name").isNotNull(), F.struct("name", (F.col("sum__") - (F.col("end_id") - F.col("last_id"))).alias("line"))))
    carried = blocks.select(*at, (F.col("sum__") - F.col("n")).alias("offset__"), F.last("open__", ignorenulls=True).over(before).alias("carried__"))
    rows = rows.where(F.col("name__").isNull()).join(carried, at)
    seq = F.coalesce("head__.name", "carried__.name")
    line = F.coalesce(F.col("offset__") + F.col("head__.line"), F.col("carried__.line"))
    calls = rows.select(seq.alias("seq_id"), (F.col("offset__") + F.col("line__") - line - 1).cast("int").alias("ord"), F.split(F.trim("value"), r"\s+").alias("f__"))
    calls = calls.where(F.col("seq_id").isNotNull() & (F.size("f__") == 17))
    typed = calls.select("seq_id", "ord", *_typed(F.col("f__"), TRF))
    return typed.withColumns({"beg": F.col("beg") - 1, "end": F.col("end") - 1}).withColumn("tr_len", F.col("end") - F.col("beg"))


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """Single-cell calls: 15 columns under a header that begins with chrom; 'chr' goes, calls split into type and haplotype."""
    f = F.split("value", "\t")
    rows = spark.read.text(path).where((F.trim("value") != "") & ~F.col("value").startswith("chrom"))
    raw = rows.select(*[F.try_element_at(f, F.lit(i + 1)).alias(c) for i, c in enumerate(CELLS)])
    part = lambda c, i: F.nullif(F.split_part(F.col(c), F.lit("_"), F.lit(i)), F.lit(""))
    return raw.select(
        F.regexp_replace("chrom", "^chr", "").alias("ref"),
        *[F.col(c).try_cast("int").alias(c) for c in ("beg", "end")],
        "sample",
        "cell",
        "state",
        F.col("scalar").try_cast("double").alias("scalar"),
        F.col("nb_bins").try_cast("int").alias("nb_bins"),
        *[x for k in ("1", "2") for x in (part(f"call{k}", 1).alias(f"type{k}"), part(f"call{k}", 2).alias(f"haplo{k}"), F.col(f"code{k}"))],
        *[F.col(c).try_cast("double").alias(c) for c in ("llr2ref", "llr2second", "af")],
    )
