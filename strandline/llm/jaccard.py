"""N-gram Jaccard join by chosen paths.

Documents are sets of five-word shingles, embedded as ``SKETCH`` MinHash values so that two
sets share each value with the probability of their similarity. A run picks a coordinate at
its root and two at each deeper node, by a hash of the path, and splits the sets there by
their value: only sets that share the sampled tokens go down the same path. Buckets of at
most ``BUCKET`` sets are compared by brute force on the sketches; larger ones are split again,
until no large one is left. A large bucket that kept ``DENSE`` of the one above holds sets
that are similar to most others there, so splitting would only multiply its paths: as in the
published method such sets are compared by brute force instead, here by the exact
verification of the whole bucket. Every other bucket has less than that share of the one
above, so paths end after a few levels; none is cut off. The number of runs follows from
the target recall.

Pairs whose sketches agree well enough, and dense buckets, tie their sets to candidate
groups. Groups of at most ``BLOCK`` sets are verified on the exact shingles. In larger ones each set is
compared with a centre (the shingles that most of a sample of the group have). From the
sizes of the sets and of their parts inside the centre follow bounds of each pair's
similarity: what is certain is counted by classes of equal sizes, without pairs; only the sets
of undecided classes are compared with each other, in blocks. The choice of the centre
changes the work, not the result.

Sets that agree as a whole (by 64 bits of hashes of all their shingles) are one node from
the start: copies are counted, not paired.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as C
from . import repeats as R
from .components import components

SKETCH, BUCKET, BLOCK = 128, 512, 256
#: Sets of a large bucket that keeps so much of the one above are similar to most others there.
DENSE = 0.6
#: Sets of a large group from which its centre is taken (about), and steps of the sizes' classes.
SAMPLE, STEPS = 64, 128
_rng = np.random.default_rng(31337)
FACTORS = _rng.integers(1, 1 << 63, SKETCH, dtype=np.uint64) | C.U64(1)


def runs_for(recall: float, threshold: float) -> int:
    """Runs so that a pair at the threshold is tied with that probability: a root coordinate, then two a node.

    A node's pair stays alive with probability q = 1 - (1 - threshold q)^2 below it, at any depth.
    """
    alive = min(1.0, (2 * threshold - 1) / threshold**2)
    if alive <= 0:
        raise ValueError("two coordinates a node keep pairs only if the threshold is over 0.5")
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold * alive)) if threshold * alive < 1 else 1


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each row and their rows, rows ascending; fewer than n words are one shingle."""
    starts, ends, row = C.words_of(data, offsets)
    words = C.word_hashes(data, starts, ends)
    roll = C.Rolling(words)
    count = np.bincount(row, minlength=len(offsets) - 1)
    first = np.cumsum(count) - count
    inside = np.flatnonzero(row[n - 1 :] == row[: len(row) - n + 1]) if len(row) >= n else np.zeros(0, np.int64)
    few = np.flatnonzero((count > 0) & (count < n))
    value = C.mix(np.concatenate((roll.span(inside, inside + n), roll.span(first[few], first[few] + count[few]))))
    of = np.concatenate((row[inside], few))
    by = np.lexsort((value, of))
    value, of = value[by], of[by]
    keep = np.concatenate(([True], (value[1:] != value[:-1]) | (of[1:] != of[:-1]))) if len(of) else np.zeros(0, bool)
    return value[keep], of[keep]


def _sets(docs: DataFrame, n: int, runs: int) -> DataFrame:
    roots = np.random.default_rng(7).permutation(SKETCH)[np.arange(runs) % SKETCH]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = C.buffers(batch.column("text"))
            for lo, hi in C.slices(offsets):
                m = hi - lo
                value, of = shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], n)
                size = np.bincount(of, minlength=m)
                have = np.flatnonzero(size)
                start = (np.cumsum(size) - size)[have]
                digest = np.zeros(m, np.uint64)
                least = np.zeros((m, SKETCH), np.uint64)
                if len(have):
                    digest[have] = C.mix(np.add.reduceat(C.mix(value), start)) ^ C.mix(np.bitwise_xor.reduceat(C.mix(value ^ C.BASE2), start))
                    for j, f in enumerate(FACTORS):
                        least[have, j] = np.minimum.reduceat(value * f, start)
                sketch = (C.mix(least) >> C.U64(56)).astype(np.uint8)
                path = C.as_long(C.mix(least[:, roots] ^ C.mix(np.arange(runs, dtype=np.uint64) + C.U64(1))))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum((size > 0) * runs))), pa.int32()), pa.array(path[size > 0].ravel()))
                yield pa.record_batch([batch.column("kid").slice(lo, m), batch.column("doc_id").slice(lo, m), batch.column("th").slice(lo, m), C.as_long(digest), pa.array(size, pa.int64()), pa.array([x.tobytes() for x in sketch], pa.binary()), lists], names=["kid", "doc_id", "th", "node", "size", "sketch", "roots"])

    schema = f"kid long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, th long, node long, size long, sketch binary, roots array<long>"
    return docs.withColumn("th", F.xxhash64("text")).mapInArrow(emit, schema)


def local_labels(near: np.ndarray) -> np.ndarray:
    """The least index of each one's component, from a matrix of neighbours."""
    m = len(near)
    label = np.arange(m)
    near = near | np.eye(m, dtype=bool)
    while True:
        new = np.where(near, label[None, :], m).min(axis=1)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _ties(rows: DataFrame, least: float, n_rows: int) -> DataFrame:
    """Spanning ties of buckets by brute force on sketches."""

    def emit(batches):
        for t in R.grouped(batches, ["path"]):
            path, node = t.column("path").to_numpy(), t.column("node").to_numpy()
            sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(len(t), SKETCH)
            edge = np.flatnonzero(np.concatenate(([True], path[1:] != path[:-1], [True])))
            size = np.diff(edge)
            two = edge[:-1][size == 2]
            ok = (sketch[two] == sketch[two + 1]).mean(axis=1) >= least if len(two) else np.zeros(0, bool)
            a, b = [node[two[ok]]], [node[two[ok] + 1]]
            for x, m in zip(edge[:-1][size > 2], size[size > 2]):
                s = sketch[x : x + m]
                near = np.stack([(s == s[i]).mean(axis=1) >= least for i in range(m)])
                label = local_labels(near)
                far = np.flatnonzero(label != np.arange(m))
                a.append(node[x + far])
                b.append(node[x + label[far]])
            yield pa.record_batch([np.concatenate(a), np.concatenate(b)], names=["a", "b"])

    return C.dealt(rows, "path", size=n_rows * (SKETCH + 40)).mapInArrow(emit, "a long, b long")


def candidate_ties(nodes: DataFrame, threshold: float, bucket: int = BUCKET) -> DataFrame:
    slack = 4 * math.sqrt(threshold * (1 - threshold) / SKETCH)
    sketches = nodes.select("node", "sketch")
    rows = nodes.select("node", F.explode("roots").alias("path"), F.lit(None).cast("long").alias("above"))
    ties = []
    while True:
        sizes = C.cut(rows.groupBy("path").agg(F.count(F.lit(1)).alias("m"), F.min("node").alias("least"), F.max("above").alias("above")).where("m > 1"))
        small = rows.join(sizes.where(F.col("m") <= bucket).select("path"), "path")
        n_rows = sizes.where(F.col("m") <= bucket).agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0]
        ties.append(C.cut(_ties(small.select("node", "path").join(sketches, "node"), threshold - slack, n_rows)))
        large = sizes.where(F.col("m") > bucket)
        if not large.limit(1).count():
            break
        whole = F.coalesce(F.col("m") / F.col("above"), F.lit(0.0)) >= DENSE
        ties.append(C.cut(rows.select("node", "path").join(large.where(whole), "path").select(F.col("node").alias("a"), F.col("least").alias("b"))))
        big = rows.drop("above").join(large.where(~whole).select("path", F.col("m").alias("above")), "path").join(sketches, "node")
        split = [F.struct(F.lit(k).alias("k"), (F.pmod(F.xxhash64("path", F.lit(k)), F.lit(SKETCH)).cast("int") + 1).alias("at")) for k in (1, 2)]
        next_ = big.select("path", "node", "sketch", "above", F.explode(F.array(*split)).alias("c"))
        rows = C.cut(next_.select("node", F.xxhash64("path", "c.k", F.expr("substring(sketch, c.at, 1)")).alias("path"), "above"))
    out = ties[0]
    for t in ties[1:]:
        out = out.unionByName(t)
    return out


FOUND = "a long, b long, links long"


def _verify(members: DataFrame, n: int, threshold: float, block: int = BLOCK) -> DataFrame:
    """Exact links inside candidate groups (label, node, n_texts, z): (a, b, links) with a node's links, or a spanning tie."""
    sizes = C.cut(members.groupBy("label").agg(F.count(F.lit(1)).alias("m")))
    large = sizes.where(F.col("m") > block)
    rows = members.join(sizes.where((F.col("m") > 1) & (F.col("m") <= block)).select("label"), "label")
    none = F.lit(0).cast("int")
    found = _blocks(rows.select("label", none.alias("i"), none.alias("j"), none.alias("mine"), "node", "n_texts", none.alias("qs"), none.alias("qi"), F.lit(-1).alias("c"), "z"), n, threshold, members.agg(F.coalesce(F.sum(F.octet_length("z")), F.lit(0))).first()[0])
    if not large.limit(1).count():
        return found
    rows = C.cut(_profiles(members.join(large, "label"), n))
    plans = C.cut(_plans(rows, threshold, block))
    rows = rows.join(plans, ["label", "qs", "qi"])
    sure = rows.select("node", "root", (F.col("sure") - F.when(F.col("self"), F.col("n_texts")).otherwise(0)).alias("links"))
    found = found.unionByName(sure.select(F.col("node").alias("a"), F.col("node").alias("b"), "links"))
    found = found.unionByName(sure.where("root <> node").select(F.col("node").alias("a"), F.col("root").alias("b"), F.lit(0).cast("long").alias("links")))
    rows = rows.where("size(others) > 0").withColumn("mine", F.col("part") + F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode("others")).select("label", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "node", "n_texts", "qs", "qi", "c", "z")
    return found.unionByName(_blocks(C.cut(rows), n, threshold))


def _blocks(rows: DataFrame, n: int, threshold: float, size: int | None = None) -> DataFrame:
    """Brute force inside a group's block (i = j) or between two, of the pairs that their classes leave open (c < 0: all)."""

    def emit(batches):
        for t in R.grouped(batches, ["label", "i", "j"]):
            label, i, j, mine, node, weight, qs, qi, c = (t.column(x).to_numpy() for x in ("label", "i", "j", "mine", "node", "n_texts", "qs", "qi", "c"))
            edge = np.flatnonzero(np.concatenate(([True], (label[1:] != label[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]), [True])))
            a, b, links = [], [], []
            for x, y in zip(edge[:-1], edge[1:]):
                if y - x < 2:
                    continue
                g = slice(x, y)
                linked = _links(t.column("z").slice(x, y - x).combine_chunks(), n, threshold)
                if i[x] != j[x]:
                    linked &= mine[g][:, None] != mine[g][None, :]
                if c[x] >= 0:
                    linked &= _relation(qs[g], qi[g], int(c[x]), threshold)[1]
                a.append(node[g])
                b.append(node[g])
                links.append(linked @ weight[g])
                root = local_labels(linked)
                far = np.flatnonzero(root != np.arange(y - x))
                a.append(node[g][far])
                b.append(node[g][root[far]])
                links.append(np.zeros(len(far), np.int64))
            if a:
                yield pa.record_batch([np.concatenate(x) for x in (a, b, links)], names=["a", "b", "links"])

    return C.dealt(rows, "label", "i", "j", size=size).mapInArrow(emit, FOUND)


def _profiles(members: DataFrame, n: int) -> DataFrame:
    """The members of large groups with their class: steps of the set's size (qs) and of its part inside the centre (qi); c: the centre's size."""
    sample = members.where(F.pmod(F.xxhash64("node"), F.ceil(F.col("m") / SAMPLE)) == 0)
    lists = sample.groupBy("label").agg(F.collect_list("z").alias("some"))

    def centre(batches):
        for batch in batches:
            for label, some in zip(batch.column("label").to_pylist(), batch.column("some").to_pylist()):
                _, data, offsets = R.unpack(pa.array(some, pa.binary()))
                value, count = np.unique(shingle_sets(data, offsets, n)[0], return_counts=True)
                yield pa.record_batch([pa.array([label]), pa.array([value[2 * count > len(some)].tobytes()], pa.binary())], names=["label", "centre"])

    joined = members.join(C.cut(lists.mapInArrow(centre, "label long, centre binary")), "label", "left").select("label", "node", "n_texts", "z", "centre")

    def emit(batches):
        for batch in batches:
            for part in R.packed_slices(batch):
                _, data, offsets = R.unpack(part.column("z"))
                value, of = shingle_sets(data, offsets, n)
                m = part.num_rows
                size = np.bincount(of, minlength=m)
                edge = np.concatenate(([0], np.cumsum(size)))
                inside, c = np.zeros(m, np.int64), np.zeros(m, np.int64)
                label, known = part.column("label").to_numpy(), part.column("centre")
                for one in np.unique(label):
                    mine = np.flatnonzero(label == one)
                    centre = np.frombuffer(known[int(mine[0])].as_py() or b"", np.uint64)
                    c[mine] = len(centre)
                    for i in mine:
                        inside[i] = np.isin(value[edge[i] : edge[i + 1]], centre).sum()
                step = np.maximum(1, c // STEPS)
                yield pa.record_batch([part.column("label"), part.column("node"), part.column("n_texts"), part.column("z"), *(pa.array(x, pa.int32()) for x in (size // step, inside // step, c))], names=["label", "node", "n_texts", "z", "qs", "qi", "c"])

    return joined.mapInArrow(emit, "label long, node long, n_texts long, z binary, qs int, qi int, c int")


def _relation(qs: np.ndarray, qi: np.ndarray, c: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Which classes' sets are surely linked, and which pairs of classes are open.

    Two sets share at least what their parts inside the centre must have in common, and at most the
    smaller part inside and the smaller rest.
    """
    step = max(1, c // STEPS)
    s0, i0 = (x.astype(np.int64) * step for x in (qs, qi))
    s1, i1 = s0 + step - 1, np.minimum(i0 + step - 1, c)
    both = lambda f, x: f(x[:, None], x[None, :])
    least = np.maximum(both(np.add, i0) - c, 0)
    most = both(np.minimum, i1) + both(np.minimum, s1 - i0)
    sure = least >= threshold * (both(np.add, s1) - least) + 1e-6
    sure &= least > 0
    may = most >= threshold * (both(np.add, s0) - most) - 1e-6
    return sure, may & ~sure


def _plans(rows: DataFrame, threshold: float, block: int) -> DataFrame:
    """For each class of a large group: the texts it is surely linked to (``sure``, with its own if ``self``), a node that
    ties it to those (``root``), its blocks (``parts`` from ``part`` on) and the blocks to compare it with (``others``)."""
    classes = rows.groupBy("label", "qs", "qi").agg(F.count(F.lit(1)).alias("m"), F.sum("n_texts").alias("w"), F.min("node").alias("rep"), F.max("c").alias("c"))
    lists = classes.groupBy("label").agg(F.collect_list(F.struct("qs", "qi", "m", "w", "rep", "c")).alias("classes"))
    names = ["label", "qs", "qi", "sure", "self", "root", "part", "parts", "others"]

    def emit(batches):
        for batch in batches:
            for label, found in zip(batch.column("label").to_pylist(), batch.column("classes").to_pylist()):
                qs, qi, m, w, rep, c = (np.array([x[k] for x in found], np.int64) for k in ("qs", "qi", "m", "w", "rep", "c"))
                by = np.lexsort((qs, qs - 2 * qi))  # by distance from the centre
                qs, qi, m, w, rep = (x[by] for x in (qs, qi, m, w, rep))
                sure, open_ = _relation(qs, qi, int(c[0]), threshold)
                alone = np.diag(sure).copy()
                linked = sure.copy()
                np.fill_diagonal(linked, alone & (m > 1))
                tied = linked.any(axis=1)
                root = rep[local_labels(linked)]
                parts = -(-m // block)
                part, at, room = np.zeros(len(m), np.int64), -1, 0
                for k in range(len(m)):  # small classes share a block
                    if parts[k] == 1 and m[k] <= room:
                        part[k], room = at, room - m[k]
                    else:
                        part[k] = at + 1
                        at += parts[k]
                        room = block - m[k] if parts[k] == 1 else 0
                others = [sorted({int(v) for q in np.flatnonzero(open_[k]) for v in range(part[q], part[q] + parts[q])}) for k in range(len(m))]
                yield pa.record_batch(
                    [pa.array([label] * len(m), pa.int64()), pa.array(qs, pa.int32()), pa.array(qi, pa.int32()), pa.array(sure @ w, pa.int64()), pa.array(alone), pa.array(np.where(tied, root, rep), pa.int64(), mask=~tied), pa.array(part, pa.int32()), pa.array(parts, pa.int32()), pa.array(others, pa.list_(pa.int32()))],
                    names=names,
                )

    return lists.mapInArrow(emit, "label long, qs int, qi int, sure long, self boolean, root long, part int, parts int, others array<int>")


def _links(packed: pa.Array, n: int, threshold: float) -> np.ndarray:
    """Which of the texts have the similarity, from their whole sets."""
    _, data, offsets = R.unpack(packed)
    m = len(packed)
    value, of = shingle_sets(data, offsets, n)
    size = np.bincount(of, minlength=m)
    _, column, count = np.unique(value, return_inverse=True, return_counts=True)
    common = count[column] > 1
    value, of, column = value[common], of[common], column[common]
    _, column = np.unique(column, return_inverse=True)
    shared = np.zeros((m, m), np.float32)
    wide = 1 + (column.max() if len(column) else 0)
    by = np.argsort(column, kind="stable")
    at = np.searchsorted(column[by], np.arange(0, wide + 4096, 4096))
    for k, (x, y) in enumerate(zip(at[:-1], at[1:])):
        part = np.zeros((m, min(4096, wide - 4096 * k)), np.float32)
        part[of[by[x:y]], column[by[x:y]] - 4096 * k] = 1
        shared += part @ part.T
    both = size[:, None] + size[None, :] - shared
    linked = shared >= threshold * both
    np.fill_diagonal(linked, False)
    return linked & (size > 0)[:, None] & (size > 0)[None, :]


def jaccard_join(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.9999, bucket: int = BUCKET, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """kid, doc_id, label, class_id and n_links of every document.

    The label names the class, ids or none.
    class_id is the least id of the documents that links or equal sets tie together; n_links
    counts the other distinct texts of similarity ``threshold`` or more. Texts without words
    (null among them) have equal, empty sets; a text of fewer than n words is one shingle.
    Repeated rows are copies. An empty table gives an empty table. Columns other than id and text are left
    out. A text is one set in one task, with about 60 bytes of memory for each of its own.
    """
    docs = C.keyed(docs, id_col, text_col)
    sets = C.cut(_sets(docs, n, runs_for(recall, threshold)))
    one = sets.groupBy("node", "th").agg(F.min("doc_id").alias("doc_id"), F.min("kid").alias("kid"), F.max("size").alias("size"), F.max("sketch").alias("sketch"), F.max("roots").alias("roots"))
    nodes = C.cut(one.groupBy("node").agg(F.min("doc_id").alias("first_doc"), F.min("kid").alias("kid"), F.count(F.lit(1)).alias("n_texts"), F.max("size").alias("size"), F.max("sketch").alias("sketch"), F.max("roots").alias("roots")))
    groups = components(candidate_ties(nodes.where("size > 0").select("node", "sketch", "roots"), threshold, bucket))
    members = groups.join(nodes.select("node", "kid", "n_texts"), "node")
    members = C.cut(R.packed(docs).select("kid", "z").join(members, "kid").groupBy("node").agg(F.first("label").alias("label"), F.first("n_texts").alias("n_texts"), F.first("z").alias("z")))
    found = C.cut(_verify(members, n, threshold, block))
    classes = components(found.where("a <> b").select("a", "b"))
    links = found.where("a = b").groupBy("a").agg(F.sum("links").alias("links"))
    full = nodes.select("node", "first_doc", "n_texts").join(classes, "node", "left").join(links.withColumnRenamed("a", "node"), "node", "left")
    full = C.cut(full.select("node", F.coalesce("label", "node").alias("label"), "first_doc", (F.col("n_texts") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")))
    ids = C.cut(full.groupBy("label").agg(F.min("first_doc").alias("class_id")))
    per_node = C.cut(full.join(ids, "label").select("node", "label", "class_id", "n_links"))
    return sets.select("kid", "doc_id", "node").join(per_node, "node").select("kid", "doc_id", "label", "class_id", "n_links")


def one_of_each_class(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows, with all their columns, of the first document of each class (least id; null ids last).

    Of rows that agree in id and text the one stays whose columns have the least hash. Texts without
    words are one class. Columns may have any names; an empty table gives an empty table.
    """
    found = jaccard_join(docs, id_col=id_col, text_col=text_col, **how)
    first = found.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "kid")).alias("at"))
    keep = C.cut(first.select(F.col("at.kid").alias("kid")))
    rows = C.nested(docs, id_col, text_col).join(keep, "kid", "left_semi")
    return C.flat(rows.groupBy("kid").agg(F.min_by("row", F.xxhash64("row")).alias("row")), docs.columns)


def op10_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kid", "label")


ORACLE_SQL = r"""
WITH RECURSIVE x AS (SELECT coalesce(text, '') AS t, min(doc_id) AS k FROM documents GROUP BY 1),
w AS (SELECT k, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM x),
s AS (SELECT DISTINCT k, md5(array_to_string(w[i:i + 4], ' ')) AS s FROM w, unnest(range(1, CASE WHEN len(w) < 5 THEN least(len(w), 1) ELSE len(w) - 4 END + 1)) AS u(i)),
n AS (SELECT k, count(*) AS n FROM s GROUP BY k),
p AS (SELECT a.k AS a, b.k AS b, count(*) AS c FROM s AS a JOIN s AS b ON a.s = b.s AND a.k <> b.k GROUP BY a.k, b.k),
e AS (SELECT a, b FROM p JOIN n AS x ON x.k = a JOIN n AS y ON y.k = b WHERE c >= 0.8 * (x.n + y.n - c)
  UNION ALL SELECT a.k, b.k FROM w AS a JOIN w AS b ON len(a.w) = 0 AND len(b.w) = 0 AND a.k <> b.k),
r AS (SELECT k AS a, k AS b FROM x UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a, min(b) AS class_id FROM r GROUP BY a),
l AS (SELECT a, count(*) AS n_links FROM e GROUP BY a)
SELECT d.doc_id, c.class_id, coalesce(l.n_links, 0) AS n_links
FROM documents AS d JOIN x ON coalesce(d.text, '') = x.t JOIN c ON c.a = x.k LEFT JOIN l ON l.a = x.k
"""
