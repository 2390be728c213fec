"""Suffix-array dedup on bytes with deep-shallow sorting.

The suffix array is sparse: its suffixes start at content-defined seeds (the least
k-gram of each ``window``-byte string), so that a string that occurs twice meets
itself at one of them. Seeds whose whole surroundings agree are counted. The rest is
sorted in buckets by seed, once to the right of the seed and once to the left:
multikey quicksort on 8-byte characters to a shallow depth, then a blind trie for each
group whose common prefix is longer. From both arrays' longest-common-prefix
intervals follow the strings that two suffixes share. A seed with more than
``MOST`` different surroundings is taken by counts of fingerprints instead, which can
be spread over tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as C
from . import repeats as R

#: Bytes that the multikey quicksort looks at.
SHALLOW = 32
#: Different surroundings that are sorted together at most.
BUCKET = 512


def lcp(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix."""
    m = min(len(a), len(b))
    x = int.from_bytes(a[:m], "big") ^ int.from_bytes(b[:m], "big")
    return m - (x.bit_length() + 7) // 8


class BlindTrie:
    """A trie that keeps branching depths and characters only; strings are looked at to verify a place."""

    def __init__(self, strings: list[bytes]):
        self.strings, self.root = strings, None

    def _at(self, i: int, depth: int) -> int:
        s = self.strings[i]
        return s[depth] if depth < len(s) else -1

    def add(self, i: int) -> None:
        """Nodes: [depth, {character: node}] or, for equal strings, a list of their numbers in a tuple."""
        if self.root is None:
            self.root = ("leaf", [i])
            return
        node = self.root
        while node[0] != "leaf":  # blind: characters between branchings aren't compared
            node = node[1].get(self._at(i, node[0])) or next(iter(node[1].values()))
        other = node[1][0]
        common = lcp(self.strings[i], self.strings[other])
        if common == len(self.strings[i]) == len(self.strings[other]):
            node[1].append(i)
            return
        above, node = None, self.root
        while node[0] != "leaf" and node[0] < common:
            above, node = node, node[1][self._at(other, node[0])]
        if node[0] == common:
            node[1][self._at(i, common)] = ("leaf", [i])
            return
        fork = [common, {self._at(other, common): node, self._at(i, common): ("leaf", [i])}]
        if above is None:
            self.root = fork
        else:
            above[1][self._at(other, above[0])] = fork

    def ordered(self) -> tuple[list[int], list[int]]:
        """Numbers in order, and of each the common prefix with the one before (0 for the first)."""
        order: list[int] = []
        common: list[int] = []
        stack = [(self.root, 0)]
        while stack:
            node, with_last = stack.pop()
            if node[0] == "leaf":
                for k, i in enumerate(node[1]):
                    order.append(i)
                    common.append(len(self.strings[i]) if k else with_last)
            else:
                ways = sorted(node[1].items())
                stack += [(x, node[0] if k else with_last) for k, (_, x) in reversed(list(enumerate(ways)))]
        return order, common


def deep_shallow(strings: list[bytes], group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the strings in each group (numbers ascend), and each one's common prefix with the one before.

    The common prefix is -1 at the start of a group.
    """
    n = len(strings)
    order = np.argsort(group, kind="stable")
    if n == 0:
        return order, np.zeros(0, np.int64)
    wide = b"".join(s[:SHALLOW].ljust(SHALLOW, b"\0") for s in strings)
    chars = np.frombuffer(wide, ">u8").reshape(n, SHALLOW // 8).astype(np.uint64)
    size = np.fromiter(map(len, strings), np.int64, n)
    block = np.cumsum(np.concatenate(([0], group[order][1:] != group[order][:-1])))
    for depth in range(SHALLOW // 8):  # all open blocks are split by their next character
        open_ = np.bincount(block)[block] > 1
        if not open_.any():
            break
        at = np.flatnonzero(open_)
        mine = order[at]
        key = chars[mine, depth]
        tail = np.minimum(size[mine] - 8 * depth, 8)  # a shorter string comes first
        by = np.lexsort((tail, key, block[at]))
        order[at] = mine[by]
        key, tail = key[by], tail[by]
        new = np.zeros(n, bool)
        new[at[1:]] = (key[1:] != key[:-1]) | (tail[1:] != tail[:-1])
        edge = np.concatenate(([False], block[1:] != block[:-1])) | new
        block = np.cumsum(edge)
    start = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
    count = np.diff(np.concatenate((start, [n])))
    common = np.zeros(n, np.int64)
    for a, m in zip(start[count > 1], count[count > 1]):  # long common prefixes
        mine = order[a : a + m]
        trie = BlindTrie([strings[i] for i in mine])
        for i in range(m):
            trie.add(i)
        by, same = trie.ordered()
        order[a : a + m] = mine[by]
        common[a : a + m] = same
    sorted_group = group[order]
    for i in start.tolist():
        common[i] = lcp(strings[order[i - 1]], strings[order[i]]) if i and sorted_group[i] == sorted_group[i - 1] else -1
    return order, common


def shared_windows(group: np.ndarray, texts: list[bytes], seed_at: np.ndarray, n_windows: np.ndarray, length: int, skip: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of texts, first and last x of windows that another text of the group has too.

    The window at x starts x bytes before the seed. Two texts share it if they are in one
    longest-common-prefix interval of x bytes or more of the left array, and in one of
    ``length`` - x or more of the right array. ``skip``: bytes from the seed on that all texts of a group share.
    """
    m = len(texts)
    ro, rc = deep_shallow([t[p + skip :] for t, p in zip(texts, seed_at)], group)
    lo, lc = deep_shallow([t[:p][::-1] for t, p in zip(texts, seed_at)], group)
    rc = np.where(rc < 0, -1, rc + skip)
    rank_r, rank_l = np.empty(m, np.int64), np.empty(m, np.int64)
    rank_r[ro], rank_l[lo] = np.arange(m), np.arange(m)
    best = lambda c, rank: np.maximum(c, np.append(c[1:], -1))[rank]  # noqa: E731  with either neighbour
    first = np.maximum(seed_at - n_windows + 1, length - best(rc, rank_r))
    last = np.minimum(seed_at, best(lc, rank_l))
    open_ = np.flatnonzero(first <= last)
    if not len(open_):
        return np.zeros((3, 0), np.int64)
    low, high = int(first[open_].min()), int(last[open_].max())
    met = np.zeros((m, high - low + 3), bool)
    for x in range(low, high + 1):
        mine = open_[(first[open_] <= x) & (x <= last[open_])]
        if len(mine) > 1:
            left, right = np.cumsum(lc < x)[rank_l[mine]], np.cumsum(rc < length - x)[rank_r[mine]]
            _, pair, count = np.unique(left * (m + 1) + right, return_inverse=True, return_counts=True)
            met[mine[count[pair] > 1], x - low + 1] = True
    i, edge = np.nonzero(met[:, 1:] != met[:, :-1])
    return i[::2], edge[::2] + low, edge[1::2] + low - 1


def by_suffix_arrays(length: int, skip: int):
    def solve(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        _, group = np.unique(rows.column("key").to_numpy(), return_inverse=True)
        p, n = (rows.column(x).to_numpy().astype(np.int64) for x in ("p", "n"))
        return shared_windows(group, rows.column("piece").to_pylist(), p, n, length, skip)

    return solve


def remove_repeated_bytes(docs: DataFrame, length: int = 200, seed: int = 48, bucket: int = BUCKET, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, kept (binary), removed (ranges of bytes, maximal).

    Texts are their UTF-8 bytes; null is empty. A text shorter than ``length`` keeps all. Repeated
    rows count as further occurrences; an empty table gives an empty table; columns other than
    id and text are left out, whatever their names. A document is handled by one task, with
    about 100 bytes of memory for each of its own.
    """
    docs = C.keyed(docs, id_col, text_col)
    seed = min(seed, length)
    spans = R.repeated(docs, R.BYTES, length, seed, by_suffix_arrays(length, seed), bucket)
    joined = R.packed(docs).join(spans, "kid", "left").select("doc_id", "z", "spans")

    def emit(batches):
        for batch in batches:
            for part in R.packed_slices(batch):
                texts, _, _ = R.unpack(part.column("z"))
                out = []
                for text, found in zip(texts, part.column("spans").to_pylist()):
                    gone = R.covered(found, length, len(text)) if found else np.zeros(len(text), bool)
                    edge = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])))) if found else np.zeros(0, np.int64)
                    kept = np.frombuffer(text, np.uint8)[~gone].tobytes() if found else text
                    out.append((len(text), len(text) - len(kept), kept, edge.reshape(-1, 2).tolist()))
                n, lost, kept, removed = zip(*out)
                yield pa.record_batch(
                    [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(lost, pa.int64()), pa.array(kept, pa.binary()), pa.array(removed, pa.list_(pa.list_(pa.int64())))],
                    names=["doc_id", "n_bytes", "n_removed", "kept", "removed"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(emit, f"doc_id {kind}, n_bytes long, n_removed long, kept binary, removed array<array<long>>")


def op6_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    out = remove_repeated_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


#: Bytes as pairs of hexadecimal digits, as strings have no substrings by bytes there.
ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
y AS (SELECT doc_id, 256 * j AS o, substr(x, 512 * j + 1, 910) AS y FROM d, unnest(range(0, len(x) // 512 + 1)) AS u(j)),
g AS (SELECT doc_id, o + i AS i, md5_number_lower(substr(y, 2 * i + 1, 400)) AS g, md5_number_upper(substr(y, 2 * i + 1, 400)) AS f FROM y, unnest(range(0, len(y) // 2 - 199)) AS u(i)),
m AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY g, f) AS n FROM g) WHERE n > 1),
o AS (SELECT doc_id, i, i - coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -1000) > 200 AS new FROM m),
r AS (SELECT doc_id, i, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM o),
s AS (SELECT doc_id, r, min(i) AS a, max(i) + 200 AS b FROM r GROUP BY doc_id, r),
t AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM s),
k AS (SELECT t.doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last, string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept FROM t JOIN d ON d.doc_id = t.doc_id GROUP BY t.doc_id)
SELECT d.doc_id, len(x) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(kept, '') || substr(x, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN k ON k.doc_id = d.doc_id
"""
