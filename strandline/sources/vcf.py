"""VCF as a typed table, and back."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Header:
    """contigs: lengths by name; info, format: (number, type, description) by id; samples in order."""

    contigs: dict[str, int] = field(default_factory=dict)
    info: dict[str, tuple[str, str, str]] = field(default_factory=dict)
    format: dict[str, tuple[str, str, str]] = field(default_factory=dict)
    samples: list[str] = field(default_factory=list)


_PAIR = re.compile(r'(\w+)=("(?:[^"\\]|\\.)*"|[^,>]*)')


def parse_header(lines: list[str]) -> Header:
    out = Header()
    for line in lines:
        kind, _, body = line[2:].partition("=")
        parts = {k: v.strip('"') for k, v in _PAIR.findall(body)} if body.startswith("<") else {}
        if line.startswith("##contig"):
            out.contigs[parts["ID"]] = int(parts.get("length", 0))
        elif kind in ("INFO", "FORMAT") and parts:
            (out.info if kind == "INFO" else out.format)[parts["ID"]] = (parts.get("Number", "."), parts.get("Type", "String"), parts.get("Description", ""))
        elif line.startswith("#CHROM"):
            out.samples = line.rstrip("\n").split("\t")[9:]
    return out


def read_header(spark: SparkSession, path: str) -> Header:
    """From the file's header lines, which a VCF has few of."""
    rows = spark.read.text(path).where(F.col("value").startswith("#"))
    return parse_header([r.value for r in rows.collect()])


def read_variants(spark: SparkSession, path: str) -> DataFrame:
    """chrom, pos, id, ref, alt, qual, filter, info (map; a flag is 'true'), gt (map of maps by sample)."""
    names = read_header(spark, path).samples
    f = F.split("value", "\t")
    lines = spark.read.text(path).where((F.col("value") != "") & ~F.col("value").startswith("#"))
    entry = lambda x: F.struct(F.substring_index(x, "=", 1).alias("k"), F.when(x.contains("="), F.regexp_replace(x, "^[^=]*=", "")).otherwise("true").alias("v"))
    entries = F.filter(F.split(f[7], ";"), lambda x: (x != "") & (x != "."))
    info = F.map_from_entries(F.transform(entries, entry))
    genotype = lambda i: F.map_from_arrays(F.split(f[8], ":"), F.slice(F.concat(F.split(f[9 + i], ":"), F.array_repeat(F.lit(None).cast("string"), 64)), 1, F.size(F.split(f[8], ":"))))
    gt = F.create_map(*[x for i, s in enumerate(names) for x in (F.lit(s), genotype(i))]) if names else F.lit(None).cast("map<string,map<string,string>>")
    return lines.select(f[0].alias("chrom"), f[1].cast("int").alias("pos"), f[2].alias("id"), f[3].alias("ref"), f[4].alias("alt"), f[5].alias("qual"), f[6].alias("filter"), info.alias("info"), gt.alias("gt"))


def info_text(values: dict[str, Column], flags: set[str] = frozenset()) -> Column:
    """key=value joined by ';' in order; null is left out, a true flag is the bare key."""
    part = lambda k, v: F.when(v, k) if k in flags else F.when(v.isNotNull(), F.concat(F.lit(f"{k}="), v.cast("string")))
    return F.array_join(F.array_compact(F.array(*[part(k, v) for k, v in values.items()])), ";")


def line(*columns: Column | str) -> Column:
    return F.concat_ws("\t", *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in columns])


def header_text(header: Header) -> str:
    out = ["##fileformat=VCFv4.2", *[f"##contig=<ID={k},length={n}>" for k, n in sorted(header.contigs.items())]]
    for kind, table in (("INFO", header.info), ("FORMAT", header.format)):
        out += [f'##{kind}=<ID={k},Number={n},Type={t},Description="{d}">' for k, (n, t, d) in table.items()]
    columns = ["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", *(["FORMAT", *header.samples] if header.samples else [])]
    return "\n".join([*out, "\t".join(columns)])


def write_variants(variants: DataFrame, header: Header, path: str) -> None:
    """Header, then variants by chromosome (as text) and position, in parts whose order is that of their names;
    INFO from the map, genotypes kept."""
    info = F.array_join(F.transform(F.map_entries("info"), lambda e: F.when(e["value"] == "true", e["key"]).otherwise(F.concat(e["key"], F.lit("="), e["value"]))), ";")
    columns = ["chrom", "pos", "id", "ref", "alt", "qual", "filter", F.when(info == "", ".").otherwise(info)]
    if header.samples:
        keys = F.map_keys(F.map_values("gt")[0])
        values = lambda s: F.transform(keys, lambda k: F.coalesce(F.element_at(F.col("gt")[s], k), F.lit(".")))
        columns += [F.array_join(keys, ":"), *[F.array_join(values(s), ":") for s in header.samples]]
    rows = variants.select(F.lit(1).alias("o"), "chrom", "pos", line(*columns).alias("value"))
    head = variants.sparkSession.createDataFrame([(0, "", 0, header_text(header))], "o int, chrom string, pos int, value string")
    head.unionByName(rows).orderBy("o", "chrom", "pos", "value").select("value").write.mode("overwrite").text(path)
