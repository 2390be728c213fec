"""Runs of one base in a sequence, as array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _bind(name: str, value: str, then: str) -> str:
    return f"transform(array({value}), {name} -> {then})[0]"


def monomers(seq: str, base: str = "A", window: int = 10, max_gap: int = 1, purity: int = 80, least: int = 10) -> Column:
    """Every run of ``base``, from 5' to 3': array of struct(beg, end), 0-based half-open.

    Windows are counted from the end; pure ones (``purity`` percent) with at most max_gap
    impure ones between them join; a run grows base by base into the next window on each
    side; those shorter than ``least`` go. A null sequence gives null.
    """
    w, impure = window, window * (100 - purity)
    flags = f"array_join(transform(x.w, v -> CASE WHEN length(replace(v, '{base}', '')) * 100 <= {impure} THEN '1' ELSE '0' END), '')"
    parts = f"regexp_extract_all(f, '(1(?:0{{0,{max_gap}}}1)*|0+)', 1)"  # runs and what is between them, in turn
    spans = f"aggregate({parts}, struct(0 AS at, CAST(array() AS array<struct<first: int, last: int>>) AS runs), (s, p) -> struct(s.at + length(p) AS at, CASE WHEN left(p, 1) = '1' THEN concat(s.runs, array(struct(s.at AS first, s.at + length(p) - 1 AS last))) ELSE s.runs END AS runs), s -> s.runs)"
    right = f"CASE WHEN r.first > 0 THEN length(regexp_extract(x.w[r.first - 1], '{base}*$', 0)) ELSE 0 END"
    left = f"length(regexp_extract(CASE WHEN r.last + 1 < size(x.w) THEN x.w[r.last + 1] ELSE substring(x.rev, {w} * size(x.w) + 1) END, '^{base}*', 0))"
    runs = f"transform({_bind('f', flags, spans)}, r -> struct(CAST(length(x.rev) - {w} * (r.last + 1) - {left} AS LONG) AS beg, CAST(length(x.rev) - {w} * r.first + {right} AS LONG) AS end))"
    whole = _bind("x", f"struct(regexp_extract_all({seq}__r, '.{{{w}}}', 0) AS w, {seq}__r AS rev)", f"reverse(filter({runs}, m -> m.end - m.beg >= {least}))")
    return F.expr(_bind(f"{seq}__r", f"reverse({seq})", f"CASE WHEN {seq} IS NOT NULL THEN {whole} END"))


def near_an_end(runs: str, seq: str, base: str = "A", max_to_end: int = 20, least: int = 15, purity: float = 90, only_3prime: bool = False) -> Column:
    """Runs near an end (of the 3' end only, if asked), or long and pure enough to stand inside."""
    n = f"length({seq})"
    inside = f"(m.end - m.beg > {least} AND (m.end - m.beg - length(replace(substring({seq}, CAST(m.beg + 1 AS INT), CAST(m.end - m.beg AS INT)), '{base}', ''))) * 100 > {purity} * (m.end - m.beg))"
    near = f"{n} - m.end <= {max_to_end} OR m.beg >= {max_to_end} AND {inside}" if only_3prime else f"m.beg <= {max_to_end} OR {n} - m.end <= {max_to_end} OR {inside}"
    return F.expr(f"filter({runs}, m -> {near})")


def total_length(runs: str) -> Column:
    return F.expr(f"aggregate({runs}, 0L, (a, m) -> a + m.end - m.beg)")


def transduced_pieces(runs: str) -> Column:
    """What lies between consecutive runs of a tail: array of struct(beg, end); empty unless there are two."""
    return F.expr(f"CASE WHEN size({runs}) > 1 THEN transform(sequence(1, size({runs}) - 1), i -> struct({runs}[i - 1].end AS beg, {runs}[i].beg AS end)) ELSE array() END")


def tail_type(runs: str) -> Column:
    """No run: none; one: polyA; more: partnered, with transduced pieces between them."""
    return F.when(F.size(runs) == 0, "none").when(F.size(runs) == 1, "polyA").otherwise("partnered")


def strand(a_runs: str, t_runs: str) -> Column:
    """+ if the A runs are longer in sum than the T runs, - if shorter, null if neither."""
    a, t = total_length(a_runs), total_length(t_runs)
    return F.when(a > t, "+").when(a < t, "-")


def homopolymer(run: str, seq: str, percent: float = 95, rest: int = 10) -> Column:
    """Whether a run is (nearly) the whole sequence."""
    n, m = F.length(seq), F.col(f"{run}.end") - F.col(f"{run}.beg")
    return (m * 100 >= n * percent) | (n - m < rest)
