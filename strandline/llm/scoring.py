"""Language-model scores by deleted interpolation.

Maximum-likelihood estimates of the n-gram orders and a uniform one are mixed; the
weights depend on how often the longest known context was met (its frequency
bucket), and expectation-maximisation learns them on counts held out of training:
the tokens of one fold of the training documents, under the counts of the others.

Documents are packed into blocks of a few MB. A block asks for the counts of its
distinct n-grams, by order, sorted by their hash and packed as differences, with its own counts
beside them; a range of hashes adds the blocks' counts up and answers in the same
order. Sums are taken as a tree: at most about ``FAN`` blocks meet in a group; where there are more, groups
ask on in the same way, in 64 times as many ranges each time, so neither a message nor a
group grows with the corpus, however common an n-gram is. What is shuffled are distinct n-grams in
a few bytes each; no table of n-grams is broadcast or brought to the driver. The estimates of the tokens held out are
written once; each round of expectation-maximisation sums the shares on the executors, and the
driver gets a row of sums for each of at most 256 frequency buckets.

A context of a document's first tokens holds begin marks; it was met as often as there are
learned documents.

Defined results: null text is empty (one end token); a null id counts as the empty
string for the fold; repeated rows count as often as they occur; no training documents give
probability from the uniform part only; an empty table gives an empty table; columns other than id and text
are left out, whatever their names; a text of any length is in one block, with about 30 times
its bytes of memory.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from . import _common as C

BLOCK_BYTES = 4 << 20
BEGIN, END = C.U64(0x1F83D9ABFB41BD6B), C.U64(0x5BE0CD19137E2179)
#: Frequency buckets: 32 for each order of the longest known context.
BUCKETS, MOST_ORDER = 256, 8
#: Blocks or groups of blocks whose counts are added up at once (about), and bits of the hash by which a range is split.
FAN, SPLIT_BITS = 256, 6
#: Bits of an n-gram's hash: counts of words are exact; of 10 ** 12 longer n-grams 0.4 % meet another one's hash.
WORD_BITS, GRAM_BITS = 64, 48
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
LOWER_CODE = np.frombuffer(LOWER, np.uint8)


def shrink(x: np.ndarray) -> bytes:
    """Bytes of numbers, plane by plane, compressed; unsigned ones in as few bytes as the largest needs."""
    if x.dtype.kind == "u":
        x = x.astype(np.min_scalar_type(int(x.max(initial=0))))
    return bytes([x.itemsize]) + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes())


def grow(raw: bytes, kind: str = "u") -> np.ndarray:
    size = raw[0]
    x = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[1:]), np.uint8)
    return np.ascontiguousarray(x.reshape(size, -1).T).view(f"{kind}{size}").ravel()


def block_rows(docs: DataFrame, tuning_fold: int, block_bytes: int) -> DataFrame:
    """Documents packed into rows; those of the tuning fold apart."""

    def emit(batches):
        seq, waiting = 0, {False: [], True: []}
        size = {False: 0, True: 0}
        task = TaskContext.get().partitionId()

        def flush(tune):
            nonlocal seq
            rows, waiting[tune], size[tune] = waiting[tune], [], 0
            texts = [r[1] for r in rows]
            ids = pa.record_batch([pa.array([r[0] for r in rows], id_type)], names=["doc_id"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, ids.schema) as w:
                w.write_batch(ids)
            seq += 1
            return pa.record_batch(
                [[task << 32 | seq], [tune], [zstandard.ZstdCompressor(level=1).compress(b"".join(texts))], [shrink(np.array([len(t) for t in texts], np.uint32))], [sink.getvalue().to_pybytes()], [bytes(r[2] for r in rows)]],
                names=["block", "tune", "texts", "sizes", "ids", "folds"],
            )

        id_type = None
        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            for doc, text, fold in zip(*(batch.column(x).to_pylist() for x in ("doc_id", "text", "fold"))):
                raw, tune = text.encode(), fold == tuning_fold
                waiting[tune].append((doc, raw, fold))
                size[tune] += len(raw)
                if size[tune] >= block_bytes:
                    yield flush(tune)
        for tune in (False, True):
            if waiting[tune]:
                yield flush(tune)

    return docs.mapInArrow(emit, "block long, tune boolean, texts binary, sizes binary, ids binary, folds binary")


class Block:
    """The tokens of a block's documents, and by order their n-grams' distinct hashes and each token's place among them."""

    def __init__(self, texts: bytes, sizes: bytes, folds: bytes, order: int):
        data = np.frombuffer(zstandard.ZstdDecompressor().decompress(texts), np.uint8)
        offsets = np.concatenate(([0], np.cumsum(grow(sizes).astype(np.int64))))
        n = len(offsets) - 1
        self.folds = np.frombuffer(folds, np.uint8)
        words, row = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for lo, hi in C.slices(offsets):
            part = LOWER_CODE[data[offsets[lo] : offsets[hi]]]
            starts, ends, of = C.words_of(part, offsets[lo : hi + 1] - offsets[lo])
            words.append(C.word_hashes(part, starts, ends))
            row.append(of + lo)
        words, row = np.concatenate(words), np.concatenate(row)
        count = np.bincount(row, minlength=n)
        pad = order - 1
        length = count + pad + 1
        first = np.cumsum(length) - length
        symbols = np.full(length.sum(), BEGIN, np.uint64)
        symbols[first + length - 1] = END
        symbols[np.arange(len(row)) - (np.cumsum(count) - count)[row] + (first + pad)[row]] = words
        self.n_tokens = count + 1
        self.begins = np.cumsum(self.n_tokens) - self.n_tokens
        self.row = np.repeat(np.arange(n), self.n_tokens)
        token = np.arange(len(self.row)) + pad * (self.row + 1)
        roll = C.Rolling(symbols)
        self.keys, self.place = [], []
        for k in range(1, order + 1):
            hashes = C.mix(roll.span(token - k + 1, token + 1)) >> C.U64(64 - (WORD_BITS if k == 1 else GRAM_BITS))
            keys, place = np.unique(hashes, return_inverse=True)
            self.keys.append(keys)
            self.place.append(place.astype(np.int32))

    def counts(self, weight: np.ndarray) -> list[np.ndarray]:
        """By order, how often each distinct n-gram occurs in documents of the weights."""
        of = weight[self.row]
        return [np.bincount(p, of, len(k)).astype(np.uint32) for k, p in zip(self.keys, self.place)]


def probabilities(block: Block, counts: list[np.ndarray], n_docs: float, total: float, kinds: float) -> tuple[np.ndarray, np.ndarray]:
    """Each token's estimates (uniform, then by order) and its frequency bucket, from the counts of the block's n-grams."""
    grams = [c[p] for c, p in zip(counts, block.place)]
    n = len(block.row)
    parts = [np.full(n, 1 / (kinds + 1)), grams[0] / max(total, 1)]
    bucket = np.zeros(n, np.int64)
    for k in range(1, len(grams)):
        context = np.empty(n)  # of a token: the n-gram of the order below that ends before it
        context[1:] = grams[k - 1][:-1]
        context[block.begins] = n_docs
        known = context > 0
        parts.append(np.divide(grams[k], context, out=np.zeros(n), where=known))
        bucket[known] = 32 * k + np.log2(context[known]).astype(np.int64)
    return np.stack(parts, 1), bucket


def shares(bucket: np.ndarray, p: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """By bucket: the number of tokens, and the sum of each part's share in their probability."""
    share = weights[bucket] * p
    share /= share.sum(1, keepdims=True)
    return np.stack([np.bincount(bucket, x, BUCKETS) for x in (np.ones(len(bucket)), *share.T)], 1)


def new_weights(sums: np.ndarray) -> np.ndarray:
    """Weights by bucket from the sums of the shares; buckets without tokens get those of all tokens."""
    every = sums.sum(0)
    parts = sums.shape[1] - 1
    pooled = every[1:] / every[0] if every[0] else np.full(parts, 1 / parts)
    return np.where(sums[:, :1] > 0, sums[:, 1:] / np.maximum(sums[:, :1], 1), pooled)


ASKED = "g long, r long, src long, tune boolean, keys binary, every binary, fit binary"
ANSWERS = "src long, r long, every binary, fit binary"


def split(r: int, level: int, keys: np.ndarray):
    """Sub-ranges of a range at a level: (number of the sub-range, its place in the sorted keys)."""
    bits = GRAM_BITS if r >> (SPLIT_BITS * (level - 1)) else WORD_BITS
    part = (keys >> C.U64(bits - SPLIT_BITS * level)) & C.U64((1 << SPLIT_BITS) - 1)
    cut = np.searchsorted(part, np.arange((1 << SPLIT_BITS) + 1, dtype=np.uint64))
    return [((r << SPLIT_BITS) + j, x, y) for j, (x, y) in enumerate(zip(cut[:-1], cut[1:])) if y > x]


def message(g: int, r: int, src: int, tune: bool, keys: np.ndarray, every: np.ndarray, fit: np.ndarray | None) -> tuple:
    """``fit``: the counts without the tuning fold; none: those of a block, which is of that fold as a whole or not at all."""
    return g, r, src, tune, shrink(np.diff(keys, prepend=C.U64(0))), shrink(every), None if fit is None else shrink(fit)


def merged(table: pa.Table):
    """Distinct keys of a group's messages, each message's places among them, and the sums of both counts."""
    keys = [np.cumsum(grow(x.as_py()), dtype=np.uint64) for x in table.column("keys")]
    at = np.concatenate(([0], np.cumsum([len(k) for k in keys])))
    own, place = np.unique(np.concatenate(keys), return_inverse=True)
    del keys
    counts = [grow(x.as_py()) for x in table.column("every")]
    every = np.bincount(place, np.concatenate(counts), len(own)).astype(np.uint64)
    given = table.column("fit").to_pylist()
    counts = [(c if not tune else np.zeros(len(c), np.uint8)) if x is None else grow(x) for c, x, tune in zip(counts, given, table.column("tune").to_pylist())]
    fit = np.bincount(place, np.concatenate(counts), len(own)).astype(np.uint64)
    return own, [place[x:y] for x, y in zip(at[:-1], at[1:])], every, fit


def replies(table: pa.Table, places: list[np.ndarray], every: np.ndarray, fit: np.ndarray) -> list[pa.Array]:
    """To each message the counts of its keys; those without the tuning fold only if it is for tuning."""
    tune = table.column("tune").to_pylist()
    return [table.column("src"), table.column("r"), pa.array([shrink(every[p]) for p in places], pa.binary()), pa.array([shrink(fit[p]) if t else None for t, p in zip(tune, places)], pa.binary())]


def totals(asked: DataFrame, groups: int, level: int = 1, fan: int = FAN) -> tuple[DataFrame, Row]:
    """Answers to the messages, and the number of learned tokens and words, with and without the tuning fold."""
    names = [x.split()[0] for x in ANSWERS.split(", ")]
    if groups <= 1:

        def answer(table: pa.Table) -> pa.Table:
            _, places, every, fit = merged(table)
            word = table.column("r")[0].as_py() >> (SPLIT_BITS * level) == 0
            once = lambda v: pa.array([int(v) if word else 0, *[0] * (len(places) - 1)], pa.int64())
            return pa.table(replies(table, places, every, fit) + [once(x) for x in (every.sum(), np.count_nonzero(every), fit.sum(), np.count_nonzero(fit))], names=[*names, "n", "v", "n_fit", "v_fit"])

        answers = C.cut(asked.groupBy("g", "r").applyInArrow(answer, f"{ANSWERS}, n long, v long, n_fit long, v_fit long"))
        return answers.select(*names), answers.agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("n", "v", "n_fit", "v_fit")]).first()

    above = -(-groups // fan)

    def on(table: pa.Table) -> pa.Table:
        own, _, every, fit = merged(table)
        g, r = (table.column(x)[0].as_py() for x in ("g", "r"))
        tune = any(table.column("tune").to_pylist())
        rows = [message(g % above, part, g, tune, own[x:y], every[x:y], fit[x:y]) for part, x, y in split(r, level + 1, own)]
        return pa.table([pa.array(x) for x in zip(*rows)], names=[x.split()[0] for x in ASKED.split(", ")])

    def back(table: pa.Table, known: pa.Table) -> pa.Table:
        _, places, every, fit = merged(table)
        known = known.sort_by("r")
        every = np.concatenate([grow(x.as_py()) for x in known.column("every")])
        if known.column("fit").null_count == 0:
            fit = np.concatenate([grow(x.as_py()) for x in known.column("fit")])
        return pa.table(replies(table, places, every, fit), names=names)

    asked = C.cut(asked)
    answers, total = totals(asked.groupBy("g", "r").applyInArrow(on, ASKED), above, level + 1, fan)
    known = answers.select(F.col("src").alias("g"), F.shiftright("r", SPLIT_BITS).alias("whole"), "r", "every", "fit")
    answered = asked.groupBy("g", "r").cogroup(known.groupBy("g", "whole")).applyInArrow(back, ANSWERS)
    return C.cut(answered), total


def score_documents(docs: DataFrame, order: int = 3, folds: int = 7, held_out: int = 2, tuning: int = 3, rounds: int = 12, fan: int = FAN, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every whole text.

    The fold is crc32 of the id as text modulo ``folds``; fold ``held_out`` isn't learned
    from, and the weights are learned on fold ``tuning`` under the counts of the rest, in ``rounds`` rounds.
    """
    if not 1 <= order <= MOST_ORDER:
        raise ValueError(f"the order must be from 1 to {MOST_ORDER}")
    spark = docs.sparkSession
    docs = C.keyed(docs, id_col, text_col)
    id_kind = docs.schema["doc_id"].dataType.simpleString()
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds
    blocks = C.cut(block_rows(docs.select("doc_id", "text", fold.cast("int").alias("fold")), tuning, block_bytes))
    groups = max(1, -(-blocks.count() // fan))
    learned = lambda f: (f != held_out).astype(float)
    field = lambda batch, i, names: (batch.column(x)[i].as_py() for x in names)
    block_fields = ("texts", "sizes", "folds")

    def ask(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                b = Block(*field(batch, i, block_fields), order)
                block, tune = field(batch, i, ("block", "tune"))
                every = b.counts(learned(b.folds))
                group = int(C.mix(np.array([block], np.uint64))[0] % C.U64(groups))
                for k, keys in enumerate(b.keys):
                    rows = [message(group, r, block, tune, keys[x:y], every[k][x:y], None) for r, x, y in split(k, 1, keys)]
                    *columns, fit = zip(*rows)
                    yield pa.record_batch([*(pa.array(x) for x in columns), pa.array(fit, pa.binary())], names=[x.split()[0] for x in ASKED.split(", ")])

    answers, total = totals(blocks.select("block", "tune", *block_fields).mapInArrow(ask, ASKED), groups, 1, fan)
    folds_of = docs.select(fold.cast("int").alias("f")).groupBy("f").count().collect()
    n_docs = sum(r["count"] for r in folds_of if r.f != held_out)
    n_docs_fit = sum(r["count"] for r in folds_of if r.f not in (held_out, tuning))

    def with_counts(some: DataFrame, column: str) -> DataFrame:
        lists = answers.where(F.col(column).isNotNull()).groupBy(F.col("src").alias("block")).agg(F.sort_array(F.collect_list(F.struct("r", F.col(column).alias("c")))).alias("counts"))
        return some.join(lists, "block").withColumn("counts", F.col("counts.c"))

    def counted(batch, i):
        b = Block(*field(batch, i, block_fields), order)
        counts = np.concatenate([grow(c) for c in batch.column("counts")[i].as_py()]).astype(float)
        return b, np.split(counts, np.cumsum([len(k) for k in b.keys])[:-1])

    names = [f"p{k}" for k in range(1, order + 1)]

    def estimates(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                b, counts = counted(batch, i)
                p, bucket = probabilities(b, counts, n_docs_fit, total.n_fit, total.v_fit)
                yield pa.record_batch([pa.array([shrink(bucket.astype(np.uint8))]), *[pa.array([shrink(x.astype(np.float32))]) for x in p.T[1:]]], names=["bucket", *names])

    tokens = C.cut(with_counts(blocks.where("tune"), "fit").select(*block_fields, "counts").mapInArrow(estimates, "bucket binary, " + ", ".join(f"{x} binary" for x in names)))
    columns = ["n", *[f"s{k}" for k in range(order + 1)]]
    weights = np.full((BUCKETS, order + 1), 1 / (order + 1))
    for _ in range(rounds):

        def expect(batches, weights=weights):
            sums = np.zeros((BUCKETS, order + 2))
            for batch in batches:
                for i in range(batch.num_rows):
                    bucket, *p = field(batch, i, ("bucket", *names))
                    bucket = grow(bucket)
                    p = np.stack([np.full(len(bucket), 1 / (total.v_fit + 1)), *[grow(x, "f").astype(float) for x in p]], 1)
                    sums += shares(bucket, p, weights)
            met = np.flatnonzero(sums[:, 0])
            yield pa.record_batch([pa.array(met, pa.int32()), *[pa.array(x) for x in sums[met].T]], names=["bucket", *columns])

        found = tokens.mapInArrow(expect, "bucket int, " + ", ".join(f"{x} double" for x in columns)).groupBy("bucket").agg(*[F.sum(x).alias(x) for x in columns]).collect()
        sums = np.zeros((BUCKETS, order + 2))
        for r in found:
            sums[r.bucket] = [r[x] for x in columns]
        weights = new_weights(sums)
    weights = 0.99999 * weights + 0.00001 / (order + 1)  # no weight is nothing

    def score(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                b, counts = counted(batch, i)
                p, bucket = probabilities(b, counts, n_docs, total.n, total.v)
                n = len(b.folds)
                words = counts[0][b.place[0]]
                base = np.bincount(b.row, np.log10((words + 1) / (total.n + total.v + 1)), n)
                mixed = np.bincount(b.row, np.log10(np.einsum("ij,ij->i", p, weights[bucket])), n)
                ids = pa.ipc.open_stream(batch.column("ids")[i].as_py()).read_all().column("doc_id").combine_chunks()
                known = np.bincount(b.row, words > 0, n).astype(np.int64)
                yield pa.record_batch([ids, pa.array(b.folds == held_out), pa.array(b.n_tokens, pa.int64()), known, pa.array([int(total.n)] * n, pa.int64()), base, mixed], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    full = with_counts(blocks, "every").select(*block_fields, "ids", "counts")
    return full.mapInArrow(score, f"doc_id {id_kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op2_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
