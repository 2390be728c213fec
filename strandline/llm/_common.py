"""Helpers that the corpus operators share: shared storage, text buffers, hashes."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import cut, shared_dir  # noqa: F401

#: ASCII white space: space, tab, newline, vertical tab, form feed, carriage return.
WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Bytes of text handled at once inside a task.
SLICE_BYTES = 512 << 10
U64 = np.uint64
BASE = U64(0x9E3779B97F4A7C13)  # odd, 3 modulo 8
BASE2 = U64(0xC2B2AE3D27D4EB4B)


def findable(spark: SparkSession) -> None:
    """Let Python workers find this package where the driver found it, unless their path is set."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    have = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in have.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (have, root) if x)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bytes of one part that tasks deal out among themselves by key.
DEALT_BYTES = 32 << 20


def dealt(rows: DataFrame, *keys: str, size: int | None = None) -> DataFrame:
    """Rows dealt out and sorted by keys, in as many parts as their bytes ask for.

    ``size`` is for plans other than a written table, whose own estimate says nothing.
    """
    spark = rows.sparkSession
    if size is None:
        size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    n = max(partitions(spark), size // DEALT_BYTES)
    return rows.repartition(n, *keys).sortWithinPartitions(*keys)


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``kid`` (a hash of id and text), ``doc_id`` and ``text`` (null: empty); other columns go.

    Rows that agree in id and text share a ``kid``; every result of the operators
    depends on the content only, so such rows get the same result.
    """
    findable(docs.sparkSession)
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    return docs.select(F.xxhash64(docs[id_col], text).alias("kid"), docs[id_col].alias("doc_id"), text.alias("text"))


def nested(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``kid`` and ``text`` as in ``keyed``, and the whole row in one column ``row``, so that no name can clash."""
    findable(docs.sparkSession)
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    return docs.select(F.xxhash64(docs[id_col], text).alias("kid"), text.alias("text"), F.struct(*[docs[_quoted(x)] for x in docs.columns]).alias("row"))


def flat(rows: DataFrame, names: list[str], new: dict[str, Column] | None = None) -> DataFrame:
    """The columns of ``row`` again; ``new`` replaces some."""
    new = new or {}
    return rows.select(*[new.get(x, F.col("row").getField(x)).alias(x) for x in names])


def filtered(docs: DataFrame, text_col: str, keep) -> DataFrame:
    """The rows that ``keep`` (of a text buffer and its offsets) tells to keep; columns may have any names."""
    findable(docs.sparkSession)
    at = docs.columns.index(text_col)
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])

    def emit(batches):
        for batch in batches:
            data, offsets = buffers(batch.column(at))
            kept = [keep(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]) for lo, hi in slices(offsets)]
            if kept:
                yield batch.filter(pa.array(np.concatenate(kept)))

    return plain.mapInArrow(emit, plain.schema).toDF(*docs.columns)


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string or binary column's bytes and its n + 1 offsets, null as empty."""
    kind = pa.large_string() if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else pa.large_binary()
    column = column.cast(kind)
    if column.null_count:
        column = pc.fill_null(column, "" if kind == pa.large_string() else b"")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES):
    """Ranges of rows with about ``most`` bytes, one row at least."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs without ASCII white space) and the row of each."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    black = ~WHITE[data]
    cut_at = np.zeros(n + 1, dtype=bool)
    cut_at[offsets] = True
    first = black.copy()
    first[1:] &= ~black[:-1] | cut_at[1:n]
    last = black.copy()
    last[:-1] &= ~black[1:] | cut_at[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64."""

    def __init__(self, base: np.uint64):
        self.base, self.inverse = base, U64(pow(int(base), -1, 1 << 64))
        self.up = self.down = np.ones(1, U64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) <= n:
            size = max(n + 1, 2 * len(self.up), 1 << 16)
            for name, base in (("up", self.base), ("down", self.inverse)):
                x = np.full(size, base, U64)
                x[0] = 1
                setattr(self, name, np.cumprod(x, dtype=U64))
        return self.up, self.down


_POWERS = {int(b): _Powers(b) for b in (BASE, BASE2)}
_rng = np.random.default_rng(20240607)
#: A random number for each byte.
BYTE_CODE = _rng.integers(0, 1 << 64, 256, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (finaliser of a multiplicative hash)."""
    x = x ^ (x >> U64(31))
    x *= U64(0x7FB5D329728EA185)
    x ^= x >> U64(27)
    x *= U64(0x81DADEF4BC2DD44D)
    x ^= x >> U64(33)
    return x


class Rolling:
    """Polynomial hashes of any span of a symbol array from one prefix sum."""

    def __init__(self, symbols: np.ndarray, base: np.uint64 = BASE):
        up, self.down = _POWERS[int(base)].upto(len(symbols))
        self.sums = np.empty(len(symbols) + 1, U64)
        self.sums[0] = 0
        np.cumsum(symbols * up[: len(symbols)], dtype=U64, out=self.sums[1:])

    def span(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (self.sums[ends] - self.sums[starts]) * self.down[starts]

    def grams(self, k: int) -> np.ndarray:
        """Hash of the k symbols from each position on."""
        n = len(self.sums) - k
        return (self.sums[k:] - self.sums[:n]) * self.down[:n] if n > 0 else np.zeros(0, U64)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    h = Rolling(BYTE_CODE[data]).span(starts, ends)
    return mix(h + (ends - starts).astype(U64))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum over each w consecutive values."""
    if len(x) < w:
        return x[:0]
    m, have = x, 1
    while 2 * have <= w:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    return np.minimum(m[: len(x) - w + 1], m[w - have :][: len(x) - w + 1])


def as_long(x: np.ndarray) -> np.ndarray:
    return x.astype(U64, copy=False).view(np.int64)


def ragged(values: np.ndarray, group: np.ndarray, n: int) -> list[np.ndarray]:
    """The values of each of n groups; ``group`` ascends."""
    return np.split(values, np.searchsorted(group, np.arange(1, n))) if n else []


def text_bytes(texts: Column) -> Column:
    return F.octet_length(texts)


def vocabulary(name: str, folder: str | None = None) -> str:
    """Path of a public tokenizer's file: in ``folder``, or where the installed package has it."""
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
