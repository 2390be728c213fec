"""Greedy chaining of complementary hits of one query, as array folds inside one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def chain(hits: DataFrame, key: str, beg: str, end: str, order: str, carry: list[str], max_dist: int, max_percent: float) -> DataFrame:
    """(key, chain): hits as an array of structs in chain order.

    The longest hit starts the chain (ties: ``order``). Each round takes the first hit, in
    order of length, that continues the chain's interval (begin of its first to end of its
    last hit) on the left or right; rounds end when none does.
    """
    hit = F.struct((F.col(beg) - F.col(end)).alias("neg"), F.col(order).alias("ord"), F.col(beg).alias("beg"), F.col(end).alias("end"), *carry)
    rows = hits.groupBy(key).agg(F.sort_array(F.collect_list(hit)).alias("h"))
    cb, ce = "s.chain[0].beg", "element_at(s.chain, -1).end"
    shared = f"greatest(least({ce}, x.end) - greatest({cb}, x.beg) + 1, 0)"
    fits = f"{cb} - {max_dist} <= x.end + {max_dist} AND x.beg - {max_dist} <= {ce} + {max_dist} AND {shared} * 100.0D / ({ce} - {cb} + 1) <= {max_percent} AND {shared} * 100.0D / (x.end - x.beg + 1) <= {max_percent}"
    grow = f"""aggregate(sequence(1, size(h)), struct(slice(h, 1, 1) AS chain, slice(h, 2, size(h)) AS rest),
      (s, i) -> transform(array(filter(s.rest, x -> {fits})), f -> CASE WHEN size(f) = 0 THEN s ELSE struct(
        CASE WHEN {cb} > f[0].beg THEN concat(slice(f, 1, 1), s.chain) ELSE concat(s.chain, slice(f, 1, 1)) END AS chain,
        filter(s.rest, y -> y.ord <> f[0].ord) AS rest) END)[0], s -> s.chain)"""
    return rows.select(key, F.expr(grow).alias("chain"))


def coverage(chain: str = "chain", length: Column | str = "q_len") -> Column:
    """Percentage of the query from the first hit's begin to the last one's end."""
    return (F.element_at(chain, -1)["end"] - F.element_at(chain, 1)["beg"]) / (F.col(length) if isinstance(length, str) else length) * 100


def duplication_type(chain: str = "chain") -> Column:
    plus, minus = F.exists(chain, lambda x: x["strand"] == "+"), F.exists(chain, lambda x: x["strand"] == "-")
    return F.when(plus & minus, "COMPLEX_DUP").when(plus, "DUP").otherwise("INV_DUP")


def conformation(chain: str = "chain", t_len: str = "t_len", least_truncation: int = 10) -> Column:
    """FOR and REV hits with the junctions between them, TRUN where a template's end is missing."""
    part = lambda x: F.when(x["strand"] == "+", "FOR").otherwise("REV")
    step = f"transform(sequence(1, size({chain})), i -> CASE WHEN i = 1 THEN '' ELSE CASE WHEN {chain}[i - 1].t_beg < {chain}[i - 2].t_beg THEN 'JUMP+' WHEN {chain}[i - 1].t_beg = {chain}[i - 2].t_end THEN 'BLUNT+' WHEN {chain}[i - 1].t_beg > {chain}[i - 2].t_end THEN 'DEL+' ELSE 'DUP+' END END)"
    body = F.array_join(F.zip_with(F.expr(step), F.transform(chain, part), lambda a, b: F.concat(a, b)), "+")
    first, last = F.element_at(chain, 1), F.element_at(chain, -1)
    head = F.when(first["t_beg"] > least_truncation, "TRUN+").otherwise("")
    tail = F.when(last[t_len] - last["t_end"] > least_truncation, "+TRUN").otherwise("")
    return F.concat(head, body, tail)


def strand_runs(chain: str = "chain") -> Column:
    """FOR and REV of runs of equal strands, in chain order."""
    kept = f"filter(transform(sequence(0, size({chain}) - 1), i -> CASE WHEN i > 0 AND {chain}[i].strand = {chain}[i - 1].strand THEN '' WHEN {chain}[i].strand = '+' THEN 'FOR' ELSE 'REV' END), x -> x <> '')"
    return F.array_join(F.expr(kept), "+")


def conformation_extended(chain: str = "chain", t_len: str = "t_len", least_truncation: int = 10) -> Column:
    """The conformation with lengths and places: hits as (query length,begin-end), junctions with what they skip or repeat."""
    hit = f"transform({chain}, h -> concat(CASE WHEN h.strand = '+' THEN 'FOR' ELSE 'REV' END, '(', CAST(h.end - h.beg AS STRING), ',', CAST(h.t_beg AS STRING), '-', CAST(h.t_end AS STRING), ')'))"
    back, gap = f"{chain}[i - 1].t_beg - {chain}[i - 2].t_beg", f"{chain}[i - 1].t_beg - {chain}[i - 2].t_end"
    step = f"transform(sequence(1, size({chain})), i -> CASE WHEN i = 1 THEN '' WHEN {back} < 0 THEN concat('JUMP(', CAST({back} AS STRING), ')+') WHEN {gap} = 0 THEN 'BLUNT(NA)+' WHEN {gap} > 0 THEN concat('DEL(', CAST({gap} AS STRING), ')+') ELSE concat('DUP(', CAST(-({gap}) AS STRING), ')+') END)"
    body = F.array_join(F.zip_with(F.expr(step), F.expr(hit), lambda a, b: F.concat(a, b)), "+")
    first, last = F.element_at(chain, 1), F.element_at(chain, -1)
    text = lambda x: x.cast("string")
    left = last[t_len] - last["t_end"]
    head = F.when(first["t_beg"] > least_truncation, F.concat(F.lit("TRUN("), text(first["t_beg"]), F.lit(",0-"), text(first["t_beg"]), F.lit(")+"))).otherwise("")
    tail = F.when(left > least_truncation, F.concat(F.lit("+TRUN("), text(left), F.lit(","), text(last["t_end"]), F.lit("-"), text(last[t_len]), F.lit(")"))).otherwise("")
    return F.concat(head, body, tail)
