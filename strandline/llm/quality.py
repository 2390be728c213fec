"""Quality rules with suffix-array repetition.

A suffix array over the words of a batch of documents (prefix doubling; suffixes of
different documents never match) gives longest-common-prefix values; their intervals
are the maximal repeated word sequences. The union of the spans of those of
``min_repeat`` words or more must cover at most ``max_covered`` of a document's words,
and the longest must have at most ``max_longest`` words and ``max_longest_share`` of them.

Defined results: null text has no words and fails the base rule; rows are independent, so repeated
rows get the same verdict; of equal repeats each counts; a text of any length is taken as a whole
in one task, with about 200 bytes of memory for each of its own; an empty table gives an
empty table; further columns are left out (or kept as they are by ``keep_good``), whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import _common as C

#: Characters counted as symbols.
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True


def longest_repeats(words: np.ndarray, row: np.ndarray) -> np.ndarray:
    """For each word, the length of the longest sequence from it on that the same row has elsewhere too."""
    n = len(words)
    if n < 2:
        return np.zeros(n, np.int64)
    end = np.searchsorted(row, row, side="right")
    _, group, count = np.unique(words ^ C.mix(row.astype(C.U64) + C.U64(1)), return_inverse=True, return_counts=True)
    rank = (np.cumsum(count) - count)[group]
    levels, k = [rank], 1
    active = np.flatnonzero(count[group] > 1)
    while len(active):  # ranks by the first k words become ranks by 2 k
        then = active + k
        key = np.where(then < end[active], rank[np.minimum(then, n - 1)], -1)
        by = np.lexsort((key, rank[active]))
        a, r, key = active[by], rank[active][by], key[by]
        new_group = np.concatenate(([True], r[1:] != r[:-1]))
        new_sub = new_group | np.concatenate(([True], key[1:] != key[:-1]))
        i = np.arange(len(a))
        group_at = np.maximum.accumulate(np.where(new_group, i, 0))
        sub_at = np.maximum.accumulate(np.where(new_sub, i, 0))
        rank = rank.copy()
        rank[a] = r + sub_at - group_at
        size = np.bincount(np.cumsum(new_sub) - 1)[np.cumsum(new_sub) - 1]
        active = np.sort(a[size > 1])
        levels.append(rank)
        k *= 2
    array = np.empty(n, np.int64)
    array[rank] = np.arange(n)
    at = np.flatnonzero(levels[0][array[:-1]] == levels[0][array[1:]])  # neighbours that share a word
    i, j = array[:-1][at], array[1:][at]
    common = np.zeros(len(at), np.int64)
    for depth in range(len(levels) - 1, -1, -1):
        x, y = i + common, j + common
        ok = (x < end[i]) & (y < end[j])
        x, y = np.minimum(x, n - 1), np.minimum(y, n - 1)
        common += np.where(ok & (levels[depth][x] == levels[depth][y]), 1 << depth, 0)
    best = np.zeros(n, np.int64)
    np.maximum.at(best, i, common)
    np.maximum.at(best, j, common)
    return best


def cover(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """How many of the spans lie on each of n places."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + lengths, -1)
    return np.cumsum(step[:n])


def measure(data: np.ndarray, offsets: np.ndarray, min_repeat: int) -> dict[str, np.ndarray]:
    """The counts of each row of a text buffer."""
    n = len(offsets) - 1
    starts, ends, row = C.words_of(data, offsets)
    total = lambda values, at: np.bincount(at, values, n).astype(np.int64)
    of_byte = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    symbols = np.concatenate(([0], np.cumsum(SYMBOLS[data])))
    words = C.word_hashes(data, starts, ends)
    out = {"n_words": np.bincount(row, minlength=n), "word_chars": total(of_byte[ends] - of_byte[starts], row), "n_symbols": symbols[offsets[1:]] - symbols[offsets[:-1]]}
    windows = np.flatnonzero(row[2:] == row[:-2]) if len(row) > 2 else np.zeros(0, np.int64)
    triple = C.mix(C.Rolling(words).grams(3)[windows] ^ C.mix(row[windows].astype(C.U64))) if len(windows) else np.zeros(0, C.U64)
    _, group, count = np.unique(triple, return_inverse=True, return_counts=True)
    again = windows[count[group] > 1]
    out["n_repeat_words"] = total(cover(again, np.full(len(again), 3), len(words)) > 0, row)
    longest = longest_repeats(words, row)
    far = np.flatnonzero(longest >= min_repeat)
    out["n_covered"] = total(cover(far, longest[far], len(words)) > 0, row)
    out["longest_repeat"] = np.zeros(n, np.int64)
    np.maximum.at(out["longest_repeat"], row, longest)
    out["n_dup_lines"] = np.zeros(n, np.int64)
    breaks = np.flatnonzero(data == 10)
    lines = np.unique(np.concatenate((offsets, breaks + 1)))
    lines = lines[lines <= len(data)]
    first = np.searchsorted(starts, lines[:-1])
    full = first < np.searchsorted(starts, lines[1:])
    a, b = lines[:-1][full], lines[1:][full]
    b = np.where(data[b - 1] == 10, b - 1, b)
    h = C.word_hashes(data, a, b) if len(a) else np.zeros(0, C.U64)
    of = np.searchsorted(offsets, a, side="right") - 1
    _, group, count = np.unique(h ^ C.mix(of.astype(C.U64)), return_index=True, return_counts=True)
    out["n_dup_lines"] = np.bincount(of, minlength=n) - np.bincount(of[group], minlength=n)
    return out


LIMITS = {"min_repeat": 5, "max_covered": 0.4, "max_longest": 200, "max_longest_share": 0.3, "min_words": 50}


def verdicts(data: np.ndarray, offsets: np.ndarray, limits: dict) -> dict[str, np.ndarray]:
    m = measure(data, offsets, limits["min_repeat"])
    n, longest = m["n_words"], m["longest_repeat"]
    m["base_failed"] = (n < limits["min_words"]) | (100 * m["n_repeat_words"] > 50 * n)
    good = m["n_covered"] <= limits["max_covered"] * n
    good &= (longest < limits["min_repeat"]) | (longest <= np.minimum(limits["max_longest"], limits["max_longest_share"] * n))
    m["kept"] = ~m["base_failed"] & good
    return m


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """doc_id with the counts, base_failed, n_covered, longest_repeat and the verdict ``kept``; limits as in ``LIMITS``."""
    docs = C.keyed(docs, id_col, text_col)
    limits = LIMITS | limits
    longs, flags = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered", "longest_repeat"], ["base_failed", "kept"]

    def emit(batches):
        for batch in batches:
            data, offsets = C.buffers(batch.column("text"))
            for lo, hi in C.slices(offsets):
                m = verdicts(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], limits)
                yield pa.record_batch([batch.column("doc_id").slice(lo, hi - lo), *[pa.array(m[x], pa.int64()) for x in longs], *[pa.array(m[x]) for x in flags]], names=["doc_id", *longs, *flags])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(emit, f"doc_id {kind}, " + ", ".join([*(f"{x} long" for x in longs), *(f"{x} boolean" for x in flags)]))


def keep_good(docs: DataFrame, text_col: str = "text", **limits) -> DataFrame:
    """The rows, with all their columns, whose text is kept."""
    limits = LIMITS | limits
    return C.filtered(docs, text_col, lambda data, offsets: verdicts(data, offsets, limits)["kept"])


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _longest_sql(levels: int) -> str:
    """Common table expressions up to ``longest`` (doc_id, n): classes of 2 ** k words by doubling, then the length's bits from the top."""
    out = ["g0 AS MATERIALIZED (SELECT doc_id, i, hash(w[i]) AS h FROM d, unnest(range(1, len(w) + 1)) AS u(i))"]
    for k in range(1, levels):
        out.append(f"g{k} AS MATERIALIZED (SELECT a.doc_id, a.i, hash(a.h, b.h) AS h FROM g{k - 1} AS a JOIN g{k - 1} AS b ON b.doc_id = a.doc_id AND b.i = a.i + {1 << (k - 1)})")
    out.append(f"c{levels} AS MATERIALIZED (SELECT doc_id, i, CAST(0 AS UBIGINT) AS h, 0 AS n FROM g0)")
    for k in reversed(range(levels)):
        out.append(f"t{k} AS MATERIALIZED (SELECT c.doc_id, c.i, hash(c.h, g.h) AS h, c.n + {1 << k} AS n FROM c{k + 1} AS c JOIN g{k} AS g ON g.doc_id = c.doc_id AND g.i = c.i + c.n)")
        out.append(f"r{k} AS MATERIALIZED (SELECT DISTINCT doc_id FROM (SELECT doc_id FROM t{k} GROUP BY doc_id, h HAVING count(*) > 1))")
        out.append(f"c{k} AS MATERIALIZED (SELECT * FROM t{k} WHERE doc_id IN (SELECT doc_id FROM r{k}) UNION ALL SELECT * FROM c{k + 1} WHERE doc_id NOT IN (SELECT doc_id FROM r{k}))")
    out.append("longest AS (SELECT doc_id, max(n) AS n FROM c0 GROUP BY doc_id)")
    return ",\n".join(out)


def _covered_sql(name: str, k: int) -> str:
    """(doc_id, n): words in windows of k words that the text has twice or more."""
    return f"""{name}_w AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(w[i:i + {k - 1}], ' ')) AS n FROM d, unnest(range(1, len(w) - {k - 2})) AS u(i)),
{name} AS (SELECT doc_id, count(DISTINCT i + j.j) AS n FROM {name}_w, unnest(range(0, {k})) AS j(j) WHERE n > 1 GROUP BY doc_id)"""


#: For texts of fewer than 2 ** 15 words.
ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, count(*) - count(DISTINCT x.x) AS n FROM d, unnest(string_split(t, chr(10))) AS x(x) WHERE regexp_matches(x.x, '[^\x20\x09-\x0D]') GROUP BY doc_id),
{_covered_sql("three", 3)},
{_covered_sql("five", LIMITS["min_repeat"])},
{_longest_sql(15)},
m AS (SELECT d.doc_id, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  coalesce(l.n, 0) AS n_dup_lines, coalesce(three.n, 0) AS n_repeat_words, coalesce(five.n, 0) AS n_covered, CAST(coalesce(longest.n, 0) AS BIGINT) AS longest_repeat
  FROM d LEFT JOIN l ON l.doc_id = d.doc_id LEFT JOIN three ON three.doc_id = d.doc_id LEFT JOIN five ON five.doc_id = d.doc_id LEFT JOIN longest ON longest.doc_id = d.doc_id),
b AS (SELECT *, n_words < {LIMITS["min_words"]} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND n_covered <= {LIMITS["max_covered"]}::DOUBLE * n_words
  AND (longest_repeat < {LIMITS["min_repeat"]} OR longest_repeat <= least({LIMITS["max_longest"]}, {LIMITS["max_longest_share"]}::DOUBLE * n_words)) AS kept
FROM b
"""
