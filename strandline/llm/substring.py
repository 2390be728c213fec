"""Substring dedup on words: seed and extend.

Documents are joined on winnowed anchors (the least k-gram of each window). Where an anchor
meets itself, the match is extended word by word to both sides as far as both places agree
and choose that anchor; matches of ``window`` words or more are kept: a maximal repeat is
such a match, or the union of those of consecutive anchors. Surroundings that agree as a whole are
extended once for all of them, and the matches of one anchor are compared in buckets
of at most ``BUCKET`` different surroundings; those of more common anchors are split
first by longer sequences that they share (``repeats``).

Defined results: a null text has no words; a text shorter than the window keeps all;
repeated rows count as further occurrences; an empty table gives an empty table; columns other
than id and text are left out, whatever their names; a document is handled by one task, with
about 100 bytes of memory for each of its bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as C
from . import repeats as R


#: Different surroundings of an anchor that are extended against each other at most.
BUCKET = 32


def padded(items: np.ndarray, starts: np.ndarray, sizes: np.ndarray, step: int) -> np.ndarray:
    """A row of items for each start, forward or backward (step -1); ended by numbers that no other row has."""
    wide = int(sizes.max(initial=0)) + 1
    k = np.arange(wide)
    at = np.clip(starts[:, None] + step * k[None, :], 0, max(len(items) - 1, 0))
    own = C.mix(np.arange(len(starts), dtype=C.U64) + C.U64(1))
    return np.where(k[None, :] < sizes[:, None], items[at], own[:, None])


def extended(key: np.ndarray, items: np.ndarray, at: np.ndarray, p: np.ndarray, n: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Extends all matches of the pieces of a key; numbers of pieces, and least and largest x of the windows in a match.

    A match of l words before the seed and r from it on holds the windows that start
    window - r to l words before the seed.
    """
    right = padded(items, at[:-1] + p, np.diff(at) - p, 1)
    left = padded(items, at[:-1] + p - 1, p, -1)
    edge = np.searchsorted(key, key, side="right")
    later = edge - np.arange(len(key)) - 1  # pieces of the same key after this one
    out = [np.zeros((3, 0), np.int64)]
    a_all = np.repeat(np.arange(len(key)), later)
    b_all = np.arange(len(a_all)) - np.repeat(np.cumsum(later) - later, later) + a_all + 1
    for x in range(0, len(a_all), 8192):
        a, b = a_all[x : x + 8192], b_all[x : x + 8192]
        r = np.argmin(right[a] == right[b], axis=1)
        l = np.argmin(left[a] == left[b], axis=1)
        far = l + r >= window
        for i in (a[far], b[far]):
            out.append(np.stack((i, np.maximum(window - r[far], (p - n + 1)[i]), np.minimum(l[far], p[i]))))
    return tuple(np.unique(np.concatenate(out, axis=1), axis=1))


def by_extension(window: int):
    def solve(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        raw, at = C.buffers(rows.column("piece").combine_chunks())
        p, n = (rows.column(x).to_numpy().astype(np.int64) for x in ("p", "n"))
        return extended(rows.column("key").to_numpy(), raw.view(np.uint64), at // 8, p, n, window)

    return solve


def remove_repeated_passages(docs: DataFrame, window: int = 35, anchor: int = 8, bucket: int = BUCKET, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept (words joined by one space), removed (ranges of words).

    Words are compared by 64-bit hashes, whole surroundings by 128 bits.
    """
    docs = C.keyed(docs, id_col, text_col)
    spans = R.repeated(docs, R.WORDS, window, min(anchor, window), by_extension(window), bucket)
    joined = R.packed(docs).join(spans, "kid", "left").select("doc_id", "z", "spans")

    def emit(batches):
        for batch in batches:
            for part in R.packed_slices(batch):
                texts, _, _ = R.unpack(part.column("z"))
                out = []
                for text, found in zip(texts, part.column("spans").to_pylist()):
                    words = text.split()
                    gone = R.covered(found, window, len(words))
                    if gone.any():
                        edge = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False]))))
                        kept = [w for a, b in zip(np.r_[0, edge[1::2]], np.r_[edge[::2], len(words)]) for w in words[a:b]]
                        out.append((len(words), int(gone.sum()), b" ".join(kept).decode(), edge.reshape(-1, 2).tolist()))
                    else:
                        out.append((len(words), 0, b" ".join(words).decode(), []))
                n, gone, kept, removed = zip(*out)
                yield pa.record_batch(
                    [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string()), pa.array(removed, pa.list_(pa.list_(pa.int64())))],
                    names=["doc_id", "n_words", "n_removed", "kept", "removed"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(emit, f"doc_id {kind}, n_words long, n_removed long, kept string, removed array<array<long>>")


def op3_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = remove_repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS g FROM d, unnest(range(1, len(w) - 33)) AS u(i)),
m AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY g) AS n FROM g) WHERE n > 1),
e AS (SELECT doc_id, i, 1 AS step FROM m UNION ALL SELECT doc_id, i + 35, -1 FROM m),
v AS (SELECT doc_id, i, w[i] AS word FROM d, unnest(range(1, len(w) + 1)) AS u(i)),
q AS (SELECT doc_id, i, sum(step) AS step FROM e GROUP BY doc_id, i),
z AS (SELECT v.*, sum(coalesce(q.step, 0)) OVER (PARTITION BY v.doc_id ORDER BY v.i) > 0 AS gone FROM v LEFT JOIN q ON q.doc_id = v.doc_id AND q.i = v.i),
k AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM z GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k ON k.doc_id = d.doc_id
"""
