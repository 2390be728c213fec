"""Benchmark decontamination: size-partitioned MinHash containment search.

Items are partitioned by their number of shingles (sizes up to 8, 16, 32, ...). For a
partition of sizes up to S, documents are seen as segments of 2 S shingles, one every S,
so that a contained item is a fair part of some segment however long the document is.
An item and a segment that agree in any of ``hashes`` minima are candidates; exact
containment of the item's shingles in the whole document decides.

Items of fewer than ``FEW`` distinct shingles are found exactly, by each shingle. Another item,
of q > S / 2 shingles (or q = 4, for S = 8) of which 0.8 are in one segment has a Jaccard similarity of
at least 0.4 S / 2.1 S to it: it is missed with probability (1 - 0.19) ** 64 < 2e-6 at most;
shingles spread over several segments add up likewise.

The items are the stated query set. They are taken in blocks of about ``block`` items and ``block_bytes``
bytes, whose index is sent to the tasks; each block is one pass over the documents, so memory
is bounded for any number of items and any of their lengths (a longer item is a block of its own).
Shingles are compared by 64-bit hashes.

Defined results: null texts and items have no words; an item of fewer than five words is
one shingle of all its words; an item without words matches nothing; repeated rows give
repeated pairs; no items or no documents give no pairs; texts and items of any length are taken as a
whole, a document in one task with about 100 bytes of memory for each of its own; further
columns are left out (or kept as they are by ``without_items``), whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import _common as C

LEAST_SIZE = 8
#: Items of fewer distinct shingles are looked up by each of them.
FEW = 4


def shingles_of(words: np.ndarray, n: int) -> np.ndarray:
    return C.mix(C.Rolling(words).grams(n))


class ItemIndex:
    """MinHash signatures of one block of items, and their exact shingles."""

    def __init__(self, items: list[tuple[object, str]], n: int, hashes: int, threshold: float):
        self.n, self.hashes, self.threshold = n, hashes, threshold
        rng = np.random.default_rng(977)
        self.factors = rng.integers(1, 1 << 63, hashes, dtype=np.uint64) | C.U64(1)
        self.ids, self.sets, self.short = [], [], {}
        for name, text in items:
            raw = (text or "").encode()
            data = np.frombuffer(raw, np.uint8)
            starts, ends, _ = C.words_of(data, np.array([0, len(raw)]))
            if len(starts):
                words = C.word_hashes(data, starts, ends)
                k = min(n, len(words))
                if k < n:
                    self.short.setdefault(k, []).append(len(self.ids))
                self.ids.append(name)
                self.sets.append(np.unique(shingles_of(words, k)))
        self.classes: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        short = {i for x in self.short.values() for i in x}
        few = [i for i, s in enumerate(self.sets) if i not in short and len(s) < FEW]
        keys, owner = np.concatenate([np.zeros(0, np.uint64), *[self.sets[i] for i in few]]), np.repeat(np.array(few, np.int64), [len(self.sets[i]) for i in few])
        by = np.argsort(keys, kind="stable")
        self.few = keys[by], owner[by]
        by_size: dict[int, list[int]] = {}
        for i, s in enumerate(self.sets):
            if i not in short and len(s) >= FEW:
                by_size.setdefault(max(LEAST_SIZE, 1 << (len(s) - 1).bit_length()), []).append(i)
        for size, mine in by_size.items():
            keys = np.array([[self._key(j, (self.sets[i] * f).min()) for j, f in enumerate(self.factors)] for i in mine], np.uint64)
            flat, owner = keys.ravel(), np.repeat(np.array(mine), hashes)
            by = np.argsort(flat, kind="stable")
            self.classes[size] = (flat[by], owner[by])
        self.filters = {size: _Filter(keys) for size, (keys, _) in self.classes.items()}

    @staticmethod
    def _key(j: int, least):
        return (least & ~C.U64(255)) | C.U64(j)

    def candidates(self, shingles: np.ndarray, row: np.ndarray, n_rows: int) -> set[tuple[int, int]]:
        """(row, item) pairs that agree in a minimum of some segment."""
        if not len(shingles) or not self.classes:
            return set()
        count = np.bincount(row, minlength=n_rows)
        edge = np.concatenate(([0], np.cumsum(count)))
        unit = np.concatenate([np.arange(edge[r], edge[r + 1], LEAST_SIZE) for r in np.flatnonzero(count)])
        of_unit = row[unit]
        n = len(unit)
        sizes = [LEAST_SIZE << i for i in range((max(self.classes) // LEAST_SIZE).bit_length())]
        same = {s: np.flatnonzero(of_unit[s // LEAST_SIZE :] == of_unit[: max(n - s // LEAST_SIZE, 0)]) for s in sizes}
        found: set[tuple[int, int]] = set()
        for j, factor in enumerate(self.factors):
            least = np.minimum.reduceat(shingles * factor, unit)
            for size in sizes:  # least: over twice as many shingles from each unit on
                go = same[size]
                longer = least.copy()
                longer[go] = np.minimum(least[go], least[go + size // LEAST_SIZE])
                least = longer
                if size in self.classes:
                    keys, owner = self.classes[size]
                    mine = self._key(j, least)
                    at = np.flatnonzero(self.filters[size].may(mine))
                    a, b = np.searchsorted(keys, mine[at]), np.searchsorted(keys, mine[at], side="right")
                    for x in np.flatnonzero(a < b):
                        found.update((int(of_unit[at[x]]), int(i)) for i in owner[a[x] : b[x]])
        return found

    def met(self, shingles: np.ndarray, row: np.ndarray) -> set[tuple[int, int]]:
        """(row, item) pairs that share a shingle, of the items of few."""
        keys, owner = self.few
        a, b = np.searchsorted(keys, shingles), np.searchsorted(keys, shingles, side="right")
        return {(int(row[x]), int(i)) for x in np.flatnonzero(a < b) for i in owner[a[x] : b[x]]}

    def search(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, object, int, int]]:
        """(row, item id, shared shingles, item's shingles) of contained items."""
        n_rows = len(offsets) - 1
        starts, ends, row = C.words_of(data, offsets)
        words = C.word_hashes(data, starts, ends)
        at = np.searchsorted(row, np.arange(n_rows + 1))
        out = []
        grams, inside = shingles_of(words, self.n), np.flatnonzero(row[self.n - 1 :] == row[: len(row) - self.n + 1]) if len(row) >= self.n else np.zeros(0, int)
        pairs = self.candidates(grams[inside], row[inside], n_rows) | self.met(grams[inside], row[inside])
        for k, mine in self.short.items():
            if len(words) >= k:
                g = shingles_of(words, k)
                g, r = (x[row[k - 1 :] == row[: len(row) - k + 1]] for x in (g, row[: len(row) - k + 1]))
                for i in mine:
                    out += [(int(x), self.ids[i], 1, 1) for x in np.unique(r[g == self.sets[i][0]])]
        for r, i in sorted(pairs):
            have = grams[at[r] : at[r + 1] - self.n + 1]
            shared, size = int(np.isin(self.sets[i], have).sum()), len(self.sets[i])
            if shared >= self.threshold * size:
                out.append((r, self.ids[i], shared, size))
        return out


class _Filter:
    """Tells most values that are not among the keys."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(16, (32 * len(keys)).bit_length())
        self.table = np.zeros(1 << self.bits, bool)
        self.table[self._at(keys)] = True

    def _at(self, x: np.ndarray) -> np.ndarray:
        return ((x * C.BASE) >> C.U64(64 - self.bits)).astype(np.int64)

    def may(self, x: np.ndarray) -> np.ndarray:
        return self.table[self._at(x)]


def item_blocks(items: DataFrame, n: int = 5, threshold: float = 0.8, hashes: int = 64, block: int = 20_000, block_bytes: int = 16 << 20, item_id: str = "item_id", item_text: str = "text") -> Iterator[ItemIndex]:
    """Indexes of the distinct items, a block of them at a time (about; they are dealt by hash)."""
    items = items.select(items[item_id].alias("item_id"), items[item_text].cast("string").alias("text")).distinct()
    size = items.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    blocks = max(1, -(-size.n // block), -(-size.bytes // block_bytes))
    dealt = items.withColumn("b", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    for b in range(blocks):
        yield ItemIndex([(r.item_id, r.text) for r in dealt.where(F.col("b") == b).orderBy("item_id", "text").collect()], n, hashes, threshold)


def contained_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """Pairs doc_id, item_id, n_shared, n_shingles, containment; ``how`` as in ``item_blocks``."""
    docs = C.keyed(docs, id_col, text_col).select("doc_id", "text")
    kinds = docs.schema["doc_id"].dataType.simpleString(), items.schema[how.get("item_id", "item_id")].dataType
    item_kind = to_arrow_type(kinds[1])

    def one(index: ItemIndex) -> DataFrame:
        def emit(batches):
            for batch in batches:
                data, offsets = C.buffers(batch.column("text"))
                for lo, hi in C.slices(offsets):
                    hits = index.search(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                    if hits:
                        row, item, shared, size = zip(*hits)
                        yield pa.record_batch([batch.column("doc_id").take(pa.array([lo + r for r in row])), pa.array(item, item_kind), pa.array(shared, pa.int64()), pa.array(size, pa.int64())], names=["doc_id", "item_id", "n_shared", "n_shingles"])

        return docs.mapInArrow(emit, f"doc_id {kinds[0]}, item_id {kinds[1].simpleString()}, n_shared long, n_shingles long")

    found = reduce(DataFrame.unionByName, map(one, item_blocks(items, **how)))
    return found.withColumn("containment", F.col("n_shared") / F.col("n_shingles"))


def without_items(docs: DataFrame, items: DataFrame, text_col: str = "text", **how) -> DataFrame:
    """The rows, with all their columns, that contain none of the items."""

    def clean(index: ItemIndex):
        def keep(data, offsets):
            out = np.ones(len(offsets) - 1, bool)
            out[[hit[0] for hit in index.search(data, offsets)]] = False
            return out

        return keep

    return reduce(lambda rows, index: C.filtered(rows, text_col, clean(index)), item_blocks(items, **how), docs)


def op9_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    """Every (document, benchmark item) pair where the document contains the item."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return contained_items(read("documents"), read("benchmark"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM d, unnest(range(1, len(w) - 3)) AS u(i)),
bs AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 4], ' ') AS s FROM b, unnest(range(1, len(w) - 3)) AS u(i)),
n AS (SELECT item_id, count(*) AS n_shingles FROM bs GROUP BY item_id)
SELECT doc_id, item_id, n_shared, n_shingles, n_shared / n_shingles AS containment
FROM (SELECT doc_id, item_id, count(*) AS n_shared FROM ds JOIN bs USING (s) GROUP BY doc_id, item_id) JOIN n USING (item_id)
WHERE n_shared >= 0.8 * n_shingles
"""
