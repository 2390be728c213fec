"""Token ids as flat binary files with 64-bit document offsets.

A folder holds for each part ``<part>.ids`` (unsigned little-endian integers of
``width`` bytes, flat), ``<part>.offsets`` (64-bit, one more than documents, from 0) and
``<part>.docs`` (the document ids as an Arrow stream), and ``manifest.json`` with the
parts in order and each one's base: the prefix sum of the parts' lengths, so that
base + offset is a document's place in the whole sequence.

Parts are ranges of the document id. A task writes files named by its attempt; the
manifest names those of the attempts that ended, so a lost executor or a second
attempt does no harm.

Defined results: null text is empty (the end id alone); null ids come first; repeated
rows are repeated documents, ordered by a hash of the text; no rows give no parts.
"""

from __future__ import annotations

import gc
import json
import uuid
import zlib
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C
from .bpe import byte_alphabet, refuse_unless
from .pieces import PLAIN, Lazy, plain_bytes

#: How the tokenizer cuts text before it merges.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Signs that make one piece together where they end a chunk.
SIGNS = ".,;:!?#*$%&|<>-_+=/()[]{}\""


class PieceEncoder:
    """Encodes with the tokenizers library, each distinct chunk between spaces, and each piece in it, once."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        cut = spec["pre_tokenizer"] or {}
        fits = cut.get("type") == "ByteLevel" and cut.get("use_regex") and not cut.get("add_prefix_space") and not spec["normalizer"] and spec["model"]["type"] == "BPE"
        refuse_unless(bool(fits), path)
        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.width = 2 if self.library.get_vocab_size() <= 1 << 16 else 4
        self.shown = {b: c for c, b in byte_alphabet().items()}
        self.space = self.shown[32]
        self.tokenize = self.library.model.tokenize
        self.ids, self.pieces = Lazy(self._chunk, 2_000_000), Lazy(self._merge, 900_000)

    def _bytes(self, ids: list[int]) -> bytes:
        return array("H" if self.width == 2 else "I", ids).tobytes()

    def _merge(self, piece: str) -> bytes:
        """Ids of a piece that the pre-tokenizer keeps whole."""
        return self._bytes([t.id for t in self.tokenize(piece.encode().decode("latin-1").translate(self.shown))])

    def _chunk(self, chunk: str) -> bytes:
        """Ids of a chunk; one that starts with NUL begins a text, any other follows a space.

        A word's ids are kept as the chunk's alone, and found there if signs follow the word.
        """
        if chunk.isalpha():
            if chunk.isascii():
                return self._bytes([t.id for t in self.tokenize(self.space + chunk)])
            return self._merge(" " + chunk)
        word = chunk.rstrip(SIGNS)
        if word.isalpha():
            return self.ids[word] + self.pieces[chunk[len(word) :]]
        if chunk[:1] == "\0":
            return b"".join(map(self.pieces.__getitem__, PIECES.findall(chunk[1:])))
        first, *rest = PIECES.findall(" " + chunk)
        first = self.ids[first[1:]] if first[1:].isalpha() and first[0] == " " else self.pieces[first]
        return first + b"".join(map(self.pieces.__getitem__, rest))

    def encode(self, texts: list[str], plain: bool = False) -> list[bytes]:
        """A text is cut at its spaces, where no merge crosses, unless it has something out of the common.

        plain: all texts are known to be ``PLAIN``.
        """
        self.ids.trim()
        self.pieces.trim()
        get, special, out = self.ids.__getitem__, self.special, []
        for text in texts:
            if not plain and not PLAIN.fullmatch(text) or "  " in text or any([s in text for s in special]):
                out.append(self._bytes(self.library.encode(text, add_special_tokens=False).ids))
            else:
                chunks = text.split(" ")
                chunks[0] = "\0" + chunks[0]
                out.append(b"".join(map(get, chunks)))
        return out


_LOADED: dict[str, PieceEncoder] = {}


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)


def write_token_files(docs: DataFrame, folder: str, vocabulary: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> dict:
    """Write every whole text's ids and the end id, in ascending order of document id; returns the manifest."""
    spark = docs.sparkSession
    docs = C.keyed(docs, id_col, text_col)
    bytes_ = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(C.partitions(spark), bytes_ // C.DEALT_BYTES)
    ordered = docs.repartitionByRange(n, "doc_id", "kid").sortWithinPartitions("doc_id", "kid").select("doc_id", "text")
    store, at = _open(folder)
    store.create_dir(at)

    def emit(batches):
        if vocabulary not in _LOADED:
            _LOADED[vocabulary] = PieceEncoder(vocabulary)
        model = _LOADED[vocabulary]
        gc.disable()  # the memory's many small objects form no cycles
        end = model._bytes([end_id])
        task = TaskContext.get()
        part = f"part-{task.partitionId():06d}-{task.taskAttemptId()}"
        store, at = _open(folder)
        total, count = 0, 0
        with store.open_output_stream(f"{at}/{part}.ids") as ids, store.open_output_stream(f"{at}/{part}.offsets") as offsets, store.open_output_stream(f"{at}/{part}.docs") as names:
            offsets.write(np.zeros(1, "<u8").tobytes())
            sink = None
            for batch in batches:
                sink = sink or pa.ipc.new_stream(names, pa.schema([batch.schema.field("doc_id")]))
                sink.write_batch(batch.select(["doc_id"]))
                data, limits = C.buffers(batch.column("text"))
                for lo, hi in C.slices(limits):
                    coded = [x + end for x in model.encode(batch.column("text").slice(lo, hi - lo).to_pylist(), plain_bytes(data[limits[lo] : limits[hi]]))]
                    ids.write(b"".join(coded))
                    ends = total + np.cumsum([len(x) // model.width for x in coded])
                    offsets.write(ends.astype("<u8").tobytes())
                    total, count = int(ends[-1]), count + len(coded)
            if sink:
                sink.close()
        if count:
            yield pa.record_batch([[task.partitionId()], [part], [count], [total], [model.width]], names=["p", "part", "n_docs", "n_ids", "width"])

    rows = sorted(ordered.mapInArrow(emit, "p long, part string, n_docs long, n_ids long, width long").collect())  # a row a part
    base = np.concatenate(([0], np.cumsum([r.n_ids for r in rows]))).astype(int).tolist()
    manifest = {"width": rows[0].width if rows else 2, "n_ids": base[-1], "parts": [{"name": r.part, "base": b, "n_docs": r.n_docs, "n_ids": r.n_ids} for r, b in zip(rows, base)]}
    with store.open_output_stream(f"{at}/manifest.json") as f:
        f.write(json.dumps(manifest).encode())
    return manifest


#: Bytes of ids that are read at once.
READ_BYTES = 16 << 20


def _reader(store: fs.FileSystem, path: str, kind: str):
    """Numbers a to b of a file: memory-mapped where it is local to all, else that range is read."""
    size = np.dtype(kind).itemsize
    if isinstance(store, fs.LocalFileSystem):
        if not store.get_file_info(path).size:
            return lambda a, b: np.zeros(0, kind)
        whole = np.memmap(path, kind, "r")
        return lambda a, b: whole[a:b]
    f = store.open_input_file(path)
    return lambda a, b: np.frombuffer(f.read_at((b - a) * size, a * size), kind)


def read_token_files(spark: SparkSession, folder: str, id_type: str = "long") -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the files alone."""
    C.findable(spark)
    store, at = _open(folder)
    with store.open_input_file(f"{at}/manifest.json") as f:
        manifest = json.loads(f.read())
    parts, width = manifest["parts"], manifest["width"]

    def emit(batches):
        store, at = _open(folder)
        for batch in batches:
            for i in batch.column("id").to_pylist():
                part = parts[i]
                ids = _reader(store, f"{at}/{part['name']}.ids", f"<u{width}")
                offsets = _reader(store, f"{at}/{part['name']}.offsets", "<u8")(0, part["n_docs"] + 1).astype(np.int64)
                with store.open_input_stream(f"{at}/{part['name']}.docs") as f:
                    names = pa.ipc.open_stream(f).read_all().column("doc_id").combine_chunks()
                for lo, hi in C.slices(offsets, READ_BYTES // width):
                    here = ids(int(offsets[lo]), int(offsets[hi]))
                    some = offsets[lo : hi + 1]
                    crc = [zlib.crc32(here[a:b].astype("<u4").tobytes()) for a, b in zip(some[:-1] - some[0], some[1:] - some[0])]
                    yield pa.record_batch([names.slice(lo, hi - lo), part["base"] + some[:-1], np.diff(some), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return spark.range(0, len(parts), 1, max(1, len(parts))).mapInArrow(emit, f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long")


def op4_token_files(spark, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{C.shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    write_token_files(docs, folder, vocabulary or C.vocabulary("byte_bpe_50k.json"))
    return read_token_files(spark, folder, docs.schema["doc_id"].dataType.simpleString())
