"""Line dedup with content-defined chunks.

A document's lines are cut into chunks where a rolling hash over the hashes of the last
``WINDOW`` lines meets a condition, so boundaries depend on content alone and shift with it.
A chunk of two lines or more that occurs again anywhere is kept at its first place
(least document id, then place) and removed elsewhere, after its bytes were compared. All of it
is DataFrame expressions; no Python runs on the executors.

Stages: hashes of chunks are counted (pre-aggregated); only chunks whose hash is met again
carry their text on, are grouped by the text itself, and their later places go.

Defined results: null text is empty; a text without a repeated chunk is unchanged; an
emptied text is the empty string; of repeated rows (same id and text) all copies keep
the first place's chunks; an empty table gives an empty table; a very long text is one row
of the plan, as its lines are; columns other than id and text are left out, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _common as C

#: Lines under the rolling hash, and one boundary in so many lines.
WINDOW, DIVISOR = 3, 4


def line_hash(line: Column) -> Column:
    """28 bits of a line's MD5."""
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 7), 16, 10).cast("long")


def with_chunks(docs: DataFrame, keep: list[str], text: str = "text", divisor: int = DIVISOR, pairs: bool = False) -> DataFrame:
    """The columns to keep, ``lines``, and ``ends``: the places of each chunk's last line.

    With ``pairs`` no chunk of a longer document is a single line: a boundary right after another
    one, after the first line or before the last line doesn't count.
    """
    rows = docs.select(*keep, F.split(F.coalesce(F.col(text).cast("string"), F.lit("")), "\n", -1).alias("lines"))
    rows = rows.withColumn("h", F.transform("lines", line_hash))
    roll = "h[i] + CASE WHEN i > 0 THEN h[i - 1] ELSE 0 END * 31 + CASE WHEN i > 1 THEN h[i - 2] ELSE 0 END * 961"
    ends = f"filter(sequence(0, size(h) - 1), i -> i = size(h) - 1 OR ({roll}) % {divisor} = 0)"
    rows = rows.withColumn("ends", F.expr(ends))
    if pairs:  # ends are sorted: the one before is the neighbour
        rows = rows.withColumn("ends", F.expr("filter(ends, (e, k) -> e = size(h) - 1 OR e > 0 AND e < size(h) - 2 AND (k = 0 OR ends[k - 1] < e - 1))"))
    return rows.drop("h")


#: SQL of chunk k's length and lines; e is its last line.
LENGTH = "e - CASE WHEN k = 0 THEN -1 ELSE ends[k - 1] END"
LINES = f"slice(lines, CASE WHEN k = 0 THEN 1 ELSE ends[k - 1] + 2 END, {LENGTH})"
#: SQL of what remains of a text, and of the number of lines that go; ``gone`` has chunks' places or is null.
KEPT = f"array_join(flatten(filter(transform(ends, (e, k) -> CASE WHEN array_contains(gone, k) THEN NULL ELSE {LINES} END), x -> x IS NOT NULL)), '\n')"
LINES_GONE = f"aggregate(transform(ends, (e, k) -> CASE WHEN array_contains(gone, k) THEN {LENGTH} ELSE 0 END), 0L, (a, x) -> a + x)"


def repeated_chunks(docs: DataFrame, divisor: int = DIVISOR, pairs: bool = False) -> DataFrame:
    """(kid, gone): places of the chunks that go, of the documents of ``keyed`` that have any."""
    chunks = with_chunks(docs, ["kid", "doc_id"], divisor=divisor, pairs=pairs)
    chunks = chunks.select("kid", "doc_id", F.inline(F.expr(f"transform(ends, (e, k) -> struct(k AS place, {LENGTH} AS n_lines, array_join({LINES}, '\n') AS chunk))")))
    chunks = chunks.where("n_lines > 1").withColumn("h", F.xxhash64("chunk"))
    again = C.cut(chunks.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"))
    met = C.cut(chunks.join(again, "h").select("h", "kid", "doc_id", "place", "chunk"))
    first = met.groupBy("h", "chunk").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "kid", "place")).alias("at"))
    first = C.cut(first.where("n > 1").select("h", "chunk", "at"))
    later = met.join(first, ["h", "chunk"]).where(~((F.col("at.kid") == F.col("kid")) & (F.col("at.place") == F.col("place"))))
    return later.groupBy("kid", "place").agg(F.count(F.lit(1)).alias("n")).groupBy("kid").agg(F.collect_list("place").alias("gone"))


def dedup_lines(docs: DataFrame, divisor: int = DIVISOR, id_col: str = "doc_id", text_col: str = "text", pairs: bool = False) -> DataFrame:
    """doc_id, kept (text), n_chunks, n_removed (chunks), n_removed_lines."""
    docs = C.keyed(docs, id_col, text_col)
    out = with_chunks(docs, ["kid", "doc_id"], divisor=divisor, pairs=pairs).join(repeated_chunks(docs, divisor, pairs), "kid", "left")
    out = out.withColumn("gone", F.coalesce("gone", F.expr("cast(array() AS array<int>)")))
    return out.select("doc_id", F.expr(KEPT).alias("kept"), F.size("ends").cast("long").alias("n_chunks"), F.size("gone").cast("long").alias("n_removed"), F.expr(LINES_GONE).alias("n_removed_lines"))


def without_repeated_chunks(docs: DataFrame, divisor: int = DIVISOR, pairs: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with all their columns; text (and n_chars, where there is one) without repeated chunks.

    A null text stays null; of repeated rows none loses its first chunks' places; columns may have any
    names; an empty table gives an empty table.
    """
    names = docs.columns
    rows = C.nested(docs, id_col, text_col).join(repeated_chunks(C.keyed(docs, id_col, text_col), divisor, pairs), "kid", "left")
    cut = with_chunks(rows, ["row", "gone"], divisor=divisor, pairs=pairs)
    same = lambda x, new: F.when(F.col("gone").isNull(), F.col("row").getField(x)).otherwise(new.cast(docs.schema[x].dataType))
    kept = F.expr(KEPT)
    new = {text_col: same(text_col, kept)}
    if "n_chars" in names:
        new["n_chars"] = same("n_chars", F.length(kept))
    return C.flat(cut, names, new)


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    return _digests(dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def op1_line_dedup_pairs(spark, sf_dir: str) -> DataFrame:
    """The same with chunks of two lines at least, as the pipeline takes them."""
    return _digests(dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"), pairs=True))


def _digests(out: DataFrame) -> DataFrame:
    return out.select("doc_id", "n_chunks", "n_removed", "n_removed_lines", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
e AS (SELECT doc_id, i, l[i] AS line, len(l) AS n, ('0x' || substr(md5(l[i]), 1, 7))::BIGINT AS h FROM d, unnest(range(1, len(l) + 1)) AS u(i)),
r AS (SELECT *, (h + 31 * coalesce(lag(h) OVER w, 0) + 961 * coalesce(lag(h, 2) OVER w, 0)) % {DIVISOR} = 0 OR i = n AS ends FROM e WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
k AS (SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM r),
c AS (SELECT doc_id, place, count(*) AS n_lines, string_agg(line, chr(10) ORDER BY i) AS chunk FROM k GROUP BY doc_id, place),
f AS (SELECT *, n_lines > 1 AND row_number() OVER (PARTITION BY chunk ORDER BY doc_id, place) > 1 AS gone FROM c)
SELECT doc_id, count(*) AS n_chunks, count(*) FILTER (WHERE gone) AS n_removed,
  CAST(coalesce(sum(n_lines) FILTER (WHERE gone), 0) AS BIGINT) AS n_removed_lines,
  sha256(coalesce(string_agg(chunk, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM f GROUP BY doc_id
"""

#: Boundaries right after another one, after the first line or before the last one go.
PAIRS_SQL = ORACLE_SQL.replace("\nk AS (SELECT *, coalesce(", "\nm AS (SELECT * EXCLUDE (ends), i = n OR ends AND i > 1 AND i < n - 1 AND NOT coalesce(lag(ends) OVER (PARTITION BY doc_id ORDER BY i), FALSE) AS ends FROM r),\nk AS (SELECT *, coalesce(").replace("AS place FROM r)", "AS place FROM m)")
