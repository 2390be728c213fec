"""Windows of a fixed length that occur more than once in a corpus, found from seeds.

A document is a sequence of symbols (words or bytes). Each window of ``length``
symbols picks the k-gram of least hash in it, its *seed*; equal windows pick the same
seed, so an equal pair is found by joining on seeds. Consecutive windows that pick
the same seed make a *run*; a run is the seed extended to both sides as far as it is
the pick. The stages:

1. ``runs``: a row for each run: hash of the seed, hash of the whole run, place.
2. Seeds met once go. Runs that agree as a whole with another run are repeats as a
   whole; copies thus cost a count, not pairs, and one of them stands for all.
3. The runs of a seed that differ as a whole are a *bucket*. Their symbols are cut out
   (``pieces``), and a solver (the operator's own method) finds the windows they share.
4. A bucket too large for one task is split first: the windows of its pieces are dealt
   to blocks by their distance from the seed. All windows of a block hold the same
   longer core, which is the key of the new, smaller buckets; pieces whose whole part
   agrees are counted again, and one stands for all. A block is a fourth of the one
   before; of a single window core and whole are the same, so the splitting ends, and
   each bucket is solved by the same method, however common its seed.

What is written are ranges of windows, never a row a window. Counts are pre-aggregated,
joins have both sides freshly exchanged so that a hot key can be split, and what is
brought together by document is bounded by its length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as C

#: Bits of a position in a piece of a slice; the other bits order the k-grams.
PLACE_BITS = 27
RUN_SCHEMA = "kid long, h long, c long, s0 int, s1 int"
#: A block of windows becomes so many smaller ones.
SPLIT = 4


@dataclass(frozen=True)
class Kind:
    """What a text's symbols are: ``items`` of a text buffer (with the rows' offsets in them), their type, and a 64-bit number of each."""

    items: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
    dtype: type
    codes: Callable[[np.ndarray], np.ndarray]


def _word_items(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, row = C.words_of(data, offsets)
    return C.word_hashes(data, starts, ends), np.searchsorted(row, np.arange(len(offsets)))


BYTES = Kind(lambda data, offsets: (data, offsets), np.uint8, lambda x: C.BYTE_CODE[x])
WORDS = Kind(_word_items, np.uint64, lambda x: x)


def runs_of(symbols: np.ndarray, offsets: np.ndarray, length: int, k: int) -> dict[str, np.ndarray]:
    """Runs of the windows of each row: row, first and last window's start and seed's place in it, hashes of seed and run."""
    n, w = len(symbols), length - k + 1
    none = np.zeros(0, np.int64)
    if n < length:
        return {x: none for x in ("row", "s0", "s1", "p", "h", "c")}
    grams = C.mix(C.Rolling(symbols).grams(k))
    place = np.uint64((1 << PLACE_BITS) - 1)
    at = np.empty(len(grams) - w + 1, np.int64)
    step = (1 << PLACE_BITS) - w + 1
    for a in range(0, len(at), step):  # pieces whose places fit the bits
        piece = grams[a : a + step + w - 1]
        keys = (piece & ~place) | np.arange(len(piece), dtype=C.U64)
        at[a : a + step] = (C.sliding_min(keys, w) & place).astype(np.int64) + a
    fits = np.zeros(n + 1, np.int32)
    long = np.diff(offsets) >= length
    np.add.at(fits, offsets[:-1][long], 1)
    np.add.at(fits, offsets[1:][long] - length + 1, -1)
    window = np.flatnonzero(np.cumsum(fits)[: len(at)] > 0)
    if not len(window):
        return {x: none for x in ("row", "s0", "s1", "p", "h", "c")}
    at = at[window]
    row = np.searchsorted(offsets, window, side="right") - 1
    first = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (row[1:] != row[:-1]))))
    last = np.concatenate((first[1:], [len(at)])) - 1
    s0, s1, p, row = window[first], window[last], at[first], row[first]
    whole = C.Rolling(symbols, C.BASE2).span(s0, s1 + length)
    c = C.mix(whole + C.mix(((s1 - s0).astype(C.U64) << C.U64(32)) + (p - s0).astype(C.U64)))
    return {"row": row, "s0": s0 - offsets[row], "s1": s1 - offsets[row], "p": p - offsets[row], "h": grams[p], "c": c}


def runs(keyed: DataFrame, kind: Kind, length: int, k: int) -> DataFrame:
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = C.buffers(batch.column("text"))
            kid = batch.column("kid").to_numpy()
            for lo, hi in C.slices(offsets):
                part = data[offsets[lo] : offsets[hi]]
                items, at = kind.items(part, offsets[lo : hi + 1] - offsets[lo])
                r = runs_of(kind.codes(items), at, length, k)
                yield pa.record_batch(
                    [kid[lo:hi][r["row"]], C.as_long(r["h"]), C.as_long(r["c"]), r["s0"].astype(np.int32), r["s1"].astype(np.int32)],
                    names=["kid", "h", "c", "s0", "s1"],
                )

    return keyed.select("kid", "text").mapInArrow(emit, RUN_SCHEMA)


def packed(keyed: DataFrame) -> DataFrame:
    """The text as compressed bytes, for a shuffle."""

    def emit(batches):
        z = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            text = [z.compress(x or b"") for x in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.record_batch([batch.column("kid"), batch.column("doc_id"), pa.array(text, pa.binary())], names=["kid", "doc_id", "z"])

    return keyed.mapInArrow(emit, f"kid long, doc_id {keyed.schema['doc_id'].dataType.simpleString()}, z binary")


def packed_slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch of packed texts in parts of bounded size."""
    _, offsets = C.buffers(batch.column("z"))
    for lo, hi in C.slices(offsets, C.SLICE_BYTES // 3):
        yield batch.slice(lo, hi - lo)


def unpack(column: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    z = zstandard.ZstdDecompressor()
    texts = [z.decompress(x) for x in column.to_pylist()]
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(x) for x in texts], out=offsets[1:])
    return texts, np.frombuffer(b"".join(texts), np.uint8), offsets


def gathered(rows: DataFrame) -> DataFrame:
    """(kid, s0, s1) as one list a document; repeated rows of a document count once."""
    one = rows.groupBy("kid", "s0", "s1").agg(F.count(F.lit(1)).alias("n"))
    return one.groupBy("kid").agg(F.collect_list(F.struct("s0", "s1")).alias("spans"))


PIECE_SCHEMA = "key long, d long, kid long, s0 int, p int, n int, piece binary"


def slabs(items: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The items of some ranges one after another, and the ranges' offsets in them."""
    size = ends - starts
    offsets = np.concatenate(([0], np.cumsum(size)))
    return items[np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], size)], offsets


def as_binary(items: np.ndarray, offsets: np.ndarray) -> pa.Array:
    at = (offsets * items.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(at.tobytes()), pa.py_buffer(items.tobytes())])


def pieces(keyed: DataFrame, ask: DataFrame, kind: Kind, length: int, k: int) -> DataFrame:
    """The runs asked for (h, d, kid, s0, s1) with their symbols: n windows from s0 on, the seed p symbols after s0."""
    lists = ask.groupBy("kid").agg(F.collect_list(F.struct("h", "d", "s0", "s1")).alias("asked"))
    joined = packed(keyed).select("kid", "z").join(lists, "kid").select("kid", "z", *[F.col(f"asked.{x}").alias(x) for x in ("h", "d", "s0", "s1")])

    def emit(batches):
        for batch in batches:
            for part in packed_slices(batch):
                _, data, offsets = unpack(part.column("z"))
                items, at = kind.items(data, offsets)
                doc = np.repeat(np.arange(part.num_rows), [len(x) for x in part.column("s0")])
                h, d, s0, s1 = (part.column(x).flatten().to_numpy() for x in ("h", "d", "s0", "s1"))
                for x in range(0, len(h), 4096):
                    some = slice(x, x + 4096)
                    first = at[doc[some]] + s0[some]
                    flat, edge = slabs(items, first, at[doc[some]] + s1[some] + length)
                    grams = C.mix(C.Rolling(kind.codes(flat)).grams(k))
                    of = np.repeat(np.arange(len(edge) - 1), np.diff(edge))[: len(grams)]
                    place = np.flatnonzero(C.as_long(grams) == h[some][of])
                    _, one = np.unique(of[place], return_index=True)  # the first place of the k-gram is the pick
                    p = place[one] - edge[:-1]
                    yield pa.record_batch(
                        [h[some], d[some], part.column("kid").to_numpy()[doc[some]], s0[some], p.astype(np.int32), s1[some] - s0[some] + 1, as_binary(flat, edge)],
                        names=["key", "d", "kid", "s0", "p", "n", "piece"],
                    )

    return joined.mapInArrow(emit, PIECE_SCHEMA)


def blocks_of(large: DataFrame, kind: Kind, length: int, width: int) -> DataFrame:
    """Each piece cut to its windows of each block; ``key``: hash of the block's core, ``u``: of the whole part."""

    def emit(batches):
        for batch in batches:
            raw, at = C.buffers(batch.column("piece"))
            items, at = raw.view(kind.dtype), at // np.dtype(kind.dtype).itemsize
            key, kid, s0, p, n = (batch.column(x).to_numpy().astype(np.int64) for x in ("key", "kid", "s0", "p", "n"))
            low, high = (p - n + 1) // width, p // width
            of = np.repeat(np.arange(len(p)), high - low + 1)
            j = np.arange(len(of)) - np.repeat(np.cumsum(high - low + 1) - (high - low + 1), high - low + 1) + low[of]
            xa, xb = np.maximum((p - n + 1)[of], j * width), np.minimum(p[of], j * width + width - 1)
            seed = at[of] + p[of]
            roll, back = (C.Rolling(kind.codes(items), b) for b in (C.BASE, C.BASE2))
            tag = C.mix(key.view(C.U64)[of] + C.mix(j.astype(C.U64)))
            core = seed - j * width, seed + length - (j * width + width - 1)
            whole = seed - xb, seed - xa + length
            new = C.mix(roll.span(*core) ^ C.mix(back.span(*core) ^ tag))
            u = C.mix(roll.span(*whole) ^ C.mix(back.span(*whole) ^ (xa.astype(C.U64) << C.U64(32)) ^ xb.astype(C.U64)))
            for x in range(0, len(of), 4096):
                some = slice(x, x + 4096)
                part = as_binary(*slabs(items, whole[0][some], whole[1][some]))
                yield pa.record_batch([C.as_long(new[some]), C.as_long(u[some]), kid[of][some], (s0 + p)[of][some].astype(np.int32) - xb[some].astype(np.int32), xb[some].astype(np.int32), (xb - xa + 1)[some].astype(np.int32), part], names=["key", "u", "kid", "s0", "p", "n", "piece"])

    return large.mapInArrow(emit, "key long, u long, kid long, s0 int, p int, n int, piece binary")


def solved(buckets: DataFrame, solve: Callable[[pa.Table], list[np.ndarray]]) -> DataFrame:
    """Ranges of shared windows (kid, s0, s1); ``solve`` gets whole buckets and returns numbers of rows, first and last x.

    x is a window's distance from the seed: the window at x starts at s0 + p - x.
    """

    def emit(batches):
        for t in grouped(batches, ["key"]):
            for rows in bounded(t):
                i, xa, xb = solve(rows)
                s0, p = (rows.column(x).to_numpy().astype(np.int64)[i] for x in ("s0", "p"))
                yield pa.record_batch([rows.column("kid").to_numpy()[i], (s0 + p - xb).astype(np.int32), (s0 + p - xa).astype(np.int32)], names=["kid", "s0", "s1"])

    return C.dealt(buckets, "key").mapInArrow(emit, "kid long, s0 int, s1 int")


def bounded(t: pa.Table, most: int = 16384) -> Iterator[pa.Table]:
    """A table of whole buckets, sorted by key, in parts of about ``most`` rows."""
    key = t.column("key").to_numpy()
    edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
    lo = 0
    while lo < len(edge) - 1:
        hi = max(int(np.searchsorted(edge, edge[lo] + most, side="right")) - 1, lo + 1)
        yield t.slice(edge[lo], edge[hi] - edge[lo]).combine_chunks()
        lo = hi


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups from rows sorted by the keys; at most a batch and a group are held."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        column = [batch.column(k).to_numpy() for k in keys]
        same = np.logical_and.reduce([x == x[-1] for x in column])
        end = tuple(x[-1] for x in column)
        if same.all() and end == last:  # a group over many batches is put together once
            held.append(batch)
            continue
        whole = batch.num_rows - int(np.argmin(same[::-1])) if not same.all() else 0
        done = pa.Table.from_batches([*held, batch.slice(0, whole)])
        if done.num_rows:
            yield done
        held, last = [batch.slice(whole)], end
    if held:
        yield pa.Table.from_batches(held)


def repeated(keyed: DataFrame, kind: Kind, length: int, k: int, solve: Callable, bucket: int) -> DataFrame:
    """Starts of repeated windows as ranges: (kid, spans: list of (s0, s1) both inclusive).

    Buckets of at most ``bucket`` pieces go to the solver; larger ones are split until they are.
    """
    found = runs(keyed, kind, length, k)
    seeds = C.cut(found.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"))
    shared = C.cut(found.join(seeds, "h"))
    groups = C.cut(shared.groupBy("h", "c").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("kid", "s0", "s1")).alias("at")))
    spans = [shared.join(groups.where("n > 1").select("h", "c"), ["h", "c"]).select("kid", "s0", "s1")]
    several = C.cut(groups.groupBy("h").agg(F.count(F.lit(1)).alias("d"), F.min("n").alias("least")).where("d > 1 AND least = 1").select("h", "d"))
    rows = C.cut(pieces(keyed, groups.join(several, "h").select("h", "d", "at.*"), kind, length, k))
    width = length - k + 1
    while True:
        spans.append(solved(rows.where(F.col("d") <= bucket), solve))
        large = rows.where(F.col("d") > bucket)
        if not large.limit(1).count():
            return gathered(reduce(DataFrame.unionByName, spans))
        width = -(-width // SPLIT)
        parts = C.cut(blocks_of(large, kind, length, width))
        groups = C.cut(parts.groupBy("key", "u").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("kid", "s0")).alias("at")))
        spans.append(parts.select("key", "u", "kid", "s0", "n").join(groups.where("n > 1").select("key", "u"), ["key", "u"]).select("kid", "s0", (F.col("s0") + F.col("n") - 1).alias("s1")))
        several = C.cut(groups.groupBy("key").agg(F.count(F.lit(1)).alias("d"), F.min("n").alias("least")).where("d > 1 AND least = 1").select("key", "d"))
        stand = groups.join(several, "key").select("key", "u", "d", "at.*")
        rows = C.cut(parts.join(stand, ["key", "u", "kid", "s0"]).select("key", "d", "kid", "s0", "p", "n", "piece"))


def covered(spans: list[dict] | None, length: int, n: int) -> np.ndarray:
    """Which of a document's n symbols its repeated windows cover."""
    step = np.zeros(n + 1, np.int32)
    if spans is not None and len(spans):
        np.add.at(step, np.fromiter((x["s0"] for x in spans), np.int64, len(spans)), 1)
        np.add.at(step, np.fromiter((x["s1"] + length for x in spans), np.int64, len(spans)), -1)
    return np.cumsum(step[:n]) > 0
