"""Nucleotide sequences as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def reverse_complement(seq) -> Column:
    return F.translate(F.reverse(F.upper(_c(seq))), "ACGTN,", "TGCANN")


def count_base(seq, base: str) -> Column:
    return (F.length(_c(seq)) - F.length(F.replace(_c(seq), F.lit(base), F.lit("")))).cast("long")


def percent_base(seq, base: str) -> Column:
    """Case-sensitive; 0 for an empty sequence."""
    return F.when(F.length(_c(seq)) > 0, count_base(seq, base) / F.length(_c(seq)) * 100).otherwise(0.0)


def tail_monomer(seq: str, base: str = "A", window: int = 10, max_gap: int = 1, purity: int = 80) -> Column:
    """The run of ``base`` nearest to the sequence's end: struct(beg, end), 0-based half-open, null if none.

    Windows are counted from the end; a window is pure if ``purity`` percent of its bases are
    ``base``; pure windows with at most max_gap impure ones between them join; then the run
    grows base by base into the next window on each side.
    """
    w, impure = window, window * (100 - purity)
    rev = f"reverse({seq})"  # windows from the end: one pass over the sequence
    bind = lambda name, value, then: f"transform(array({value}), {name} -> {then})[0]"
    pure = f"transform(x.w, v -> length(replace(v, '{base}', '')) * 100 <= {impure})"
    last = f"aggregate(sequence(y.first, size(y.pure) - 1), y.first, (at, i) -> CASE WHEN y.pure[i] AND i - at <= {max_gap + 1} THEN i ELSE at END)"
    right = f"CASE WHEN z.first > 0 THEN length(regexp_extract(z.w[z.first - 1], '{base}*$', 0)) ELSE 0 END"
    left = f"length(regexp_extract(CASE WHEN z.last + 1 < size(z.w) THEN z.w[z.last + 1] ELSE substring(z.rev, {w} * size(z.w) + 1) END, '^{base}*', 0))"
    run = f"struct(CAST(z.n - {w} * (z.last + 1) - {left} AS LONG) AS beg, CAST(z.n - {w} * z.first + {right} AS LONG) AS end)"
    found = bind("z", f"struct(x.w AS w, x.rev AS rev, length(x.rev) AS n, y.first AS first, {last} AS last)", run)
    with_pure = bind("y", "struct(p AS pure, CAST(array_position(p, true) AS INT) - 1 AS first)", f"CASE WHEN y.first >= 0 THEN {found} END")
    return F.expr(bind("x", f"struct(regexp_extract_all({rev}, '.{{{w}}}', 0) AS w, {rev} AS rev)", bind("p", pure, with_pure)))


def poly_tail(seq: str, base: str = "A", max_to_end: int = 50, least_begin: int = 15) -> Column:
    """The tail monomer if it ends near enough to the end and begins far enough from the begin."""
    return tail_only(tail_monomer(seq, base), seq, max_to_end, least_begin)


def tail_only(run: Column, seq: str, max_to_end: int = 50, least_begin: int = 15) -> Column:
    return F.when((F.length(seq) - run["end"] <= max_to_end) & (run["beg"] >= least_begin), run)


def _tsd(target: str, insert: str, max_mismatches: int) -> str:
    m = f"least(length({target}), length({insert}))"
    bad = f"filter(CASE WHEN {m} > 0 THEN sequence(1, CAST({m} AS INT)) ELSE array() END, i -> substring(upper({target}), i, 1) <> substring(upper({insert}), i, 1))"
    n = f"coalesce(try_element_at({bad}, {max_mismatches + 1}) - 1, {m})"
    return f"CAST(CASE WHEN {n} <= {max_mismatches + 1} THEN 0 ELSE {n} END AS LONG)"


def tsd_length(target: str, insert: str, max_mismatches: int = 2) -> Column:
    """Length of the target-site duplication: position-wise match up to one mismatch too many."""
    return F.expr(_tsd(target, insert, max_mismatches))


def tsd_both(downstream: str, upstream: str, insert: str, max_mismatches: int = 2) -> Column:
    """struct(down, up, len, seq, trimmed) of the duplications at an insert's head and tail, in upper case.

    The downstream target is compared with the head, which is cut off; then the upstream target and
    what remains are compared from their ends. ``seq`` is the tail's part and the head's after it.
    """
    bind = lambda name, value, then: f"transform(array({value}), {name} -> {then})[0]"
    sides = f"struct(upper(coalesce({insert}, '')) AS ins, upper(coalesce({downstream}, '')) AS dt, reverse(upper(coalesce({upstream}, ''))) AS ut)"
    head = bind("a", "struct(x.dt AS target, left(x.ins, length(x.dt)) AS part)", _tsd("a.target", "a.part", max_mismatches))
    cut = f"struct(x.ut AS ut, x.ins AS ins, {head} AS down)"
    rest = "struct(y.ut AS ut, y.ins AS ins, y.down AS down, substring(y.ins, CAST(y.down + 1 AS INT)) AS rest)"
    tail = bind("b", "struct(z.ut AS target, reverse(right(z.rest, length(z.ut))) AS part)", _tsd("b.target", "b.part", max_mismatches))
    both = "struct(v.z.down AS down, v.up AS up, v.z.down + v.up AS len, concat(right(v.z.rest, CAST(v.up AS INT)), left(v.z.ins, CAST(v.z.down AS INT))) AS seq, left(v.z.rest, CAST(length(v.z.rest) - v.up AS INT)) AS trimmed)"
    return F.expr(bind("x", sides, bind("y", cut, bind("z", rest, bind("v", f"struct(z AS z, {tail} AS up)", both)))))


def cigar_length(cigar: str, operations: str) -> Column:
    """Sum of the lengths of the given operations."""
    return F.expr(f"aggregate(regexp_extract_all({cigar}, '(\\\\d+)[{operations}]', 1), 0L, (a, x) -> a + CAST(x AS LONG))")


def reference_length(cigar: str) -> Column:
    return cigar_length(cigar, "M=XDN")


def query_interval(cigar: str, reverse: str) -> Column:
    """struct(beg, end) of the aligned part on the read, from its own 5' end."""
    head = F.expr(f"coalesce(try_cast(regexp_extract({cigar}, '^(\\\\d+)[SH]', 1) AS BIGINT), 0L)")
    tail = F.expr(f"coalesce(try_cast(regexp_extract({cigar}, '(\\\\d+)[SH]$', 1) AS BIGINT), 0L)")
    n = cigar_length(cigar, "M=XI")
    beg = F.when(F.col(reverse), tail).otherwise(head)
    return F.struct(beg.alias("beg"), (beg + n).alias("end"))


def without_tail(seq: str, run: Column, strand: Column) -> Column:
    """struct(tail, rest): a tail's bases, and what stands before it (+ strand) or behind it."""
    cut = lambda beg, end: F.substring(F.col(seq), (beg + 1).cast("int"), (end - beg).cast("int"))
    n = F.length(seq)
    return F.struct(cut(run["beg"], run["end"]).alias("tail"), F.when(strand == "+", cut(F.lit(0), run["beg"])).otherwise(cut(run["end"], n)).alias("rest"))
