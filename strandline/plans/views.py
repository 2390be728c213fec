"""Genomic-shaped views over the driver's tables, in SQL that Spark and DuckDB share.

``{G}`` is the flag of a global regex replacement, which only DuckDB needs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "hits": (
        "lineitem",
        """SELECT l_orderkey AS q_name, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_discount, l_quantity) AS INT) AS hit_ord, CAST(1000 AS BIGINT) AS q_len,
 CAST(floor(l_extendedprice) AS BIGINT) % 700 AS q_beg, CAST(floor(l_extendedprice) AS BIGINT) % 700 + CAST(floor(l_quantity) AS BIGINT) * 6 AS q_end,
 CASE WHEN l_returnflag = 'R' THEN '-' ELSE '+' END AS strand, concat('chr', CAST(l_suppkey % 5 + 1 AS STRING)) AS t_name, CAST(100000 AS BIGINT) AS t_len,
 (l_partkey * 37) % 90000 AS t_beg, (l_partkey * 37) % 90000 + CAST(floor(l_quantity) AS BIGINT) * 6 AS t_end, CAST(floor(l_discount * 600 + 0.5) AS INT) AS mapq FROM lineitem""",
    ),
    "bed": (
        "orders",
        """SELECT concat('chr', CAST(o_custkey % 5 + 1 AS STRING)) AS ref, (o_orderkey * 131) % 90000 AS beg, (o_orderkey * 131) % 90000 + CAST(floor(o_totalprice / 500) AS BIGINT) AS end_pos,
 'EXON' AS name, concat('gene', CAST(o_custkey AS STRING)) AS gene_name, o_orderkey AS bed_id FROM orders""",
    ),
    "reads": (
        "events",
        """SELECT event_id AS read_ord, event_type AS ref, (event_id * 7919) % 50000 AS beg, (event_id * 7919) % 50000 + CAST(floor(value) AS BIGINT) % 150 AS end_pos,
 concat('r', CAST(user_id AS STRING)) AS read_name, CASE WHEN user_id % 3 = 0 THEN 'NORMAL' ELSE 'TUMOUR' END AS sample, CASE WHEN event_id % 2 = 0 THEN 'PLUS' ELSE 'MINUS' END AS orientation,
 CAST(floor(value) AS BIGINT) % 61 AS mapq, event_id % 10 = 0 AS is_dup FROM events""",
    ),
    "sv_cells": (
        "orders",
        """SELECT o_custkey % 20 AS cell_id, concat('chr', CAST(o_orderkey % 4 + 1 AS STRING)) AS chrom, (o_orderkey * 9973) % 3000000 AS beg, (o_orderkey * 9973) % 3000000 + 1000 + o_orderkey % 5000 AS end_pos,
 CASE o_orderkey % 4 WHEN 0 THEN 'del' WHEN 1 THEN 'dup' WHEN 2 THEN 'inv' ELSE 'idup' END AS sv_type, CASE o_orderkey % 3 WHEN 0 THEN 'h1' WHEN 1 THEN 'h2' ELSE 'hom' END AS haplo,
 CAST(o_orderkey % 11 AS DOUBLE) / CAST(10 AS DOUBLE) AS af, o_orderkey AS sv_id FROM orders""",
    ),
    "haplotypes": (
        "lineitem",
        "SELECT l_suppkey AS sample_id, l_partkey % 12 AS position, CAST(min(l_partkey % 5) AS BIGINT) AS status FROM lineitem GROUP BY l_suppkey, l_partkey % 12",
    ),
    "repeats": (
        "supplier",
        """SELECT concat('chr', CAST(s_suppkey % 5 + 1 AS STRING)) AS ref, (s_suppkey * 977) % 90000 AS beg, (s_suppkey * 977) % 90000 + 200 + s_suppkey % 700 AS end_pos,
 CASE s_suppkey % 5 WHEN 0 THEN 'Simple_repeat' WHEN 1 THEN 'L1' WHEN 2 THEN 'Satellite' WHEN 3 THEN 'telo' ELSE 'Alu' END AS family, concat('gene', CAST(s_nationkey AS STRING)) AS gene_name FROM supplier""",
    ),
    "zones": ("region", "SELECT concat('m', CAST(r_regionkey AS STRING)) AS ref, r_regionkey * 9000 + 1000 AS beg, r_regionkey * 9000 + 2000 AS end_pos FROM region"),
    "targets": (
        "benchmark",
        "SELECT item_id AS t_name, translate(regexp_replace(lower(text), '[^a-z]', ''{G}), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC') AS seq FROM benchmark",
    ),
    "metas": (
        "orders",
        """SELECT o_orderkey AS meta_id, CAST(o_custkey % 8 + 1 AS STRING) AS ref, (o_orderkey * 131) % 90000 AS beg, (o_orderkey * 131) % 90000 + 50 + o_orderkey % 400 AS end_pos,
 CASE o_orderkey % 5 WHEN 0 THEN 'INS' WHEN 1 THEN 'DUP' WHEN 2 THEN 'DEL' WHEN 3 THEN 'BND' ELSE 'INS' END AS sv_type,
 CASE o_custkey % 7 WHEN 1 THEN 'TD1' WHEN 2 THEN 'TD2' WHEN 3 THEN 'partnered' WHEN 4 THEN 'orphan' WHEN 5 THEN 'L1' WHEN 6 THEN 'Alu' END AS identity,
 concat(CAST(o_orderkey % 8 + 1 AS STRING), CASE WHEN o_orderkey % 2 = 0 THEN 'p' ELSE 'q' END, '21.3') AS src_id, o_orderkey % 3 = 0 AS has_tail,
 CASE o_custkey % 3 WHEN 0 THEN 'RECIPROCAL' WHEN 1 THEN 'PLUS' ELSE 'MINUS' END AS orientation FROM orders""",
    ),
    "pairs": (
        "events",
        """SELECT event_id AS read_ord, event_type AS ref, (event_id * 7919) % 50000 AS beg, (event_id * 7919) % 50000 + 40 + CAST(floor(value) AS BIGINT) % 110 AS end_pos, concat('r', CAST(user_id AS STRING)) AS read_name,
 concat('m', CAST(user_id % 6 AS STRING)) AS mate_ref, (event_id * 104729) % 50000 AS mate_beg, event_id % 3 <> 0 AS proper, CAST(event_id % 2 + 1 AS INT) AS pair_no, CASE WHEN event_id % 4 < 2 THEN 'PLUS' ELSE 'MINUS' END AS orientation,
 event_id % 401 - 200 AS insert_size, event_id % 5 * 10 AS q_beg, event_id % 5 * 10 + 60 AS q_end, CAST(floor(value) AS BIGINT) % 61 AS mapq, event_id % 7 = 0 AS double_clip, user_id % 3 = 0 AS normal FROM events""",
    ),
    "variants": (
        "documents",
        """SELECT doc_id AS variant_ord, concat('chr', CAST(doc_id % 5 + 1 AS STRING)) AS chrom, 1000 + (doc_id * 7919) % 90000 AS pos, concat('sv', CAST(doc_id AS STRING)) AS id, 'N' AS ref_allele,
 concat(CASE WHEN doc_id % 4 = 1 THEN repeat('T', CAST(10 + doc_id % 30 AS INT)) ELSE '' END,
  translate(regexp_replace(lower(text), '[^a-z]', ''{G}), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC'),
  CASE WHEN doc_id % 4 = 0 THEN repeat('A', CAST(10 + doc_id % 30 AS INT)) ELSE '' END) AS alt FROM documents""",
    ),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, sql = VIEWS[name]
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return spark.sql(sql.replace("{G}", "").replace(f"FROM {table}", "FROM {t}"), t=rows)


def oracle(body: str, *names: str) -> str:
    """DuckDB SQL with the views as common table expressions in front."""
    ctes = ", ".join(f"{n} AS ({VIEWS[n][1].replace('{G}', chr(44) + ' ' + chr(39) + 'g' + chr(39))})" for n in names)
    recursive, rest = ("RECURSIVE ", body[len("WITH RECURSIVE ") :]) if body.startswith("WITH RECURSIVE ") else ("", body[len("WITH ") :] if body.startswith("WITH ") else None)
    return f"WITH {recursive}{ctes}, {rest}" if rest is not None else f"WITH {ctes} {body}"
