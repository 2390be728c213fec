"""BPE encoding and decoding by traversal of a trie of distinct words.

Every prefix of a word has one last token in its encoding, and the encoding is that of
the rest of the prefix followed by that token. The distinct words of a batch go into a
trie; a depth-first walk gives each node the last token of its prefix from the states
above it, so prefixes that words share are encoded once. Two tokens may follow each
other exactly if merging their joined symbols gives them back.

Defined results: null is empty and has no tokens; special tokens in a text are kept as
the tokenizers library keeps them; rows are independent, so repeated rows agree.
"""

from __future__ import annotations

import gc
import json
import os
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as C
from .pieces import PLAIN, Memory, plain_bytes

WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: A longer word is walked alone by the same states: the path's encodings by depth would take its length squared.
LONG_WORD = 2000


def refuse_unless(fits: bool, path: str) -> None:
    if not fits:
        raise ValueError(f"{path} cuts, normalises or merges text in a way that isn't supported")


def byte_alphabet() -> dict[str, int]:
    """The printable character of each byte, as byte-level vocabularies write them."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}


class TrieEncoder:
    """Encodes words with a vocabulary whose words end in ``end``.

    ``shown`` is what a token is decoded to. An automaton over the tokens' bytes gives,
    for each place in a word, the tokens that end there.
    """

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], end: str, shown: dict[int, bytes]):
        of = byte_alphabet()
        self.rank = {(vocab[a], vocab[b]): (r, vocab[a + b]) for r, (a, b) in enumerate(merges)}
        self.parts = {vocab[a + b]: (vocab[a], vocab[b]) for a, b in merges}
        self.level = {vocab[a + b]: r for r, (a, b) in enumerate(merges)}
        self.twice = len(self.parts) < len(merges)  # some token is made in two ways
        self.valid: dict[int, bool] = {}
        self.code = {i: (array("i", [i]).tobytes(), s) for i, s in shown.items()}
        self.step: list[dict[int, int]] = [{}]
        own: list[list[tuple[int, int] | None]] = [[None, None]]  # a token inside a word, at its end
        for s, i in vocab.items():
            last = s.endswith(end)
            if any(x not in of for x in (s[: -len(end)] if last else s)):  # a special token
                continue
            raw = bytes(of[x] for x in (s[: -len(end)] if last else s))
            at = 0
            for ch in raw:
                if ch not in self.step[at]:
                    self.step[at][ch] = len(self.step)
                    self.step.append({})
                    own.append([None, None])
                at = self.step[at][ch]
            own[at][last] = (i, len(raw))
        self.inner: list[tuple] = [()] * len(self.step)
        self.final: list[tuple] = [()] * len(self.step)
        self.fail = [0] * len(self.step)
        level = [(0, 0, at) for at in self.step[0].values()]
        while level:  # breadth first: the shorter suffix is ready before
            after = []
            for _, fail, at in level:
                self.fail[at] = fail
                for table, k in ((self.inner, 0), (self.final, 1)):
                    table[at] = ((own[at][k],) if own[at][k] else ()) + table[fail]
                after += [(at, self.move(fail, ch), x) for ch, x in self.step[at].items()]
            level = after

    def move(self, at: int, ch: int) -> int:
        """The automaton's state after one more byte."""
        while (to := self.step[at].get(ch)) is None:
            if not at:
                return 0
            at = self.fail[at]
        return to

    def leaves(self, token: int) -> list[int]:
        stack, out = [token], []
        while stack:
            t = stack.pop()
            if t in self.parts:
                stack += self.parts[t][::-1]
            else:
                out.append(t)
        return out

    def merged(self, ids: list[int]) -> list[int]:
        """Plain merging, the pair of least rank first."""
        while len(ids) > 1:
            r, at = min((self.rank.get((ids[i], ids[i + 1]), (1 << 60,))[0], i) for i in range(len(ids) - 1))
            if r == 1 << 60:
                break
            ids = [*ids[:at], self.rank[ids[at], ids[at + 1]][1], *ids[at + 2 :]]
        return ids

    def meet(self, a: int, b: int) -> bool:
        """Whether no merge crosses the border of a and b while they are made, told by undoing their merges, the latest first."""
        rank, parts, level, limit = self.rank.get, self.parts, self.level.get, 1 << 60
        while True:
            across = rank((a, b))
            if across and across[0] < limit:
                return False
            of_a, of_b = level(a, -1), level(b, -1)
            if of_a > of_b:
                limit, a = of_a, parts[a][1]  # of equal merges the left one comes first
            elif of_b >= 0:
                limit, b = of_b + 1, parts[b][0]
            else:
                return True

    def follows(self, a: int, b: int) -> bool:
        """Whether b may follow a; a = -1: nothing is before b."""
        if a < 0 or self.twice:
            ok = self.merged([*(self.leaves(a) if a >= 0 else []), *self.leaves(b)]) == ([a, b] if a >= 0 else [b])
        else:
            ok = self.follows(-1, b) if (known := self.valid.get(-1 << 20 | b)) is None else known
            ok = ok and self.meet(a, b)
        if len(self.valid) > 1_000_000:
            self.valid.clear()
        self.valid[a << 20 | b] = ok
        return ok

    def last(self, ends: tuple, depth: int, states: list[int]) -> tuple[int, int]:
        """Of the tokens that end at a place, the one that may follow what is before it, and its length."""
        for t, n in ends:
            before = states[depth - n]
            ok = self.valid.get(before << 20 | t)
            if ok or ok is None and self.follows(before, t):
                return t, n
        raise ValueError("a byte has no token")

    def encode_words(self, words: list[bytes]) -> dict[bytes, tuple[bytes, bytes]]:
        """Each distinct word's ids (int32) and decoded tokens, each after a space.

        The trie is held as the sorted words: each one's common prefix with the word before
        is the path that they share, and going through them is the depth-first walk. The
        states of the current path are kept by depth.
        """
        out: dict[bytes, tuple[bytes, bytes]] = {}
        words = sorted(words)
        deepest = min(LONG_WORD, max(map(len, words), default=0))
        states, ids, shown, ats = [-1] * (deepest + 1), [b""] * (deepest + 1), [b""] * (deepest + 1), [0] * (deepest + 1)
        code, inner, final, step, valid, move = self.code, self.inner, self.final, self.step, self.valid.get, self.move
        before, known = b"", 0  # the word before, and the depth up to which the states are its prefixes'
        for w in words:
            size = len(w)
            if size > LONG_WORD:
                out[w] = self._alone(w)
                continue
            m = min(known, size - 1)
            same = int.from_bytes(before[:m]) ^ int.from_bytes(w[:m])
            depth = m - (same.bit_length() + 7) // 8
            at = ats[depth]
            for ch in w[depth:]:
                depth += 1
                to = step[at].get(ch)
                at = move(at, ch) if to is None else to
                for t, n in final[at] if depth == size else inner[at]:  # the last byte is a symbol of its own
                    start = depth - n
                    ok = valid(states[start] << 20 | t)
                    if ok or ok is None and self.follows(states[start], t):
                        break
                else:
                    raise ValueError("a byte has no token")
                a, b = code[t]
                if depth == size:
                    out[w] = ids[start] + a, shown[start] + b
                else:
                    states[depth], ats[depth] = t, at
                    ids[depth], shown[depth] = ids[start] + a, shown[start] + b
            before, known = w, size - 1
        return out

    def _alone(self, w: bytes) -> tuple[bytes, bytes]:
        """One long word, by the same states along its only path."""
        states, at, back = [-1], 0, [0]
        for d, ch in enumerate(w, 1):
            at = self.move(at, ch)
            t, n = self.last((self.final if d == len(w) else self.inner)[at], d, states)
            states.append(t)
            back.append(d - n)
        tokens, d = [], len(w)
        while d:
            tokens.append(self.code[states[d]])
            d = back[d]
        return b"".join([a for a, _ in reversed(tokens)]), b"".join([b for _, b in reversed(tokens)])


class WordBpe:
    """The lower-casing word tokenizer of a file: text to ids and back."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        steps = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        first, *rest = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        fits = first.get("pattern", {}).get("Regex") == WORDS.pattern and first.get("invert") and [x["type"] for x in rest] == ["ByteLevel"] and steps == ["NFC", "Replace", "Lowercase"]
        plain = not any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"])
        refuse_unless(bool(fits and plain and model["type"] == "BPE" and model["end_of_word_suffix"] and not model["unk_token"] and not model["ignore_merges"]), path)
        self.path, self.library = path, None
        self.mark = os.path.commonprefix([t["content"] for t in spec["added_tokens"]])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.shown = {i: b" " + s.encode() for s, i in [*model["vocab"].items(), *self.special.items()]}
        self.encoder = TrieEncoder(model["vocab"], [tuple(m) for m in model["merges"]], model["end_of_word_suffix"], self.shown)
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")")
        self.ids, self.words = Memory(self._encode, 1_500_000), Memory(self._merge, 1_000_000)

    def _merge(self, words: list[str]) -> list[tuple[bytes, bytes]]:
        raw = [w.encode() for w in words]
        found = self.encoder.encode_words(raw)
        return [found[w] for w in raw]

    def _encode(self, chunks: list[str]) -> list[tuple[bytes, bytes]]:
        """Ids and decoded tokens of normalised text without white space or special tokens."""
        cut = [[c] if c.isalpha() else WORDS.findall(c) for c in chunks]
        self.words.learn(set().union(*cut))
        get = self.words.__getitem__
        return [get(c[0]) if len(c) == 1 else tuple(map(b"".join, zip(*map(get, c)))) for c in cut]

    def chunks(self, text: str, plain: bool) -> list[str]:
        """Normalised text cut at white space; characters beyond ``PLAIN`` are left to the library's rules."""
        if plain or PLAIN.fullmatch(text):
            return text.lower().split()
        if self.library is None:
            from tokenizers import Tokenizer

            self.library, self.of = Tokenizer.from_file(self.path), byte_alphabet()
        text = self.library.normalizer.normalize_str(text)
        return [bytes(self.of[c] for c in w).decode() for w, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def pieces(self, text: str, plain: bool) -> list[str | int]:
        if self.mark not in text or not self.special:
            return self.chunks(text, plain)
        out: list = []
        for part in self.cut.split(text):
            out += [self.special[part]] if part in self.special else self.chunks(part, plain)
        return out

    def encode(self, texts: list[str], plain: bool = False) -> tuple[list[bytes], list[bytes]]:
        """Each text's ids as native int32, and their tokens decoded (joined by a space, UTF-8).

        plain: all texts are known to be ``PLAIN``.
        """
        cut = [self.pieces(t, plain) for t in texts]
        self.ids.learn({x for x in set().union(*cut) if x.__class__ is str})
        get, ids, shown = self.ids.get, [], []
        for p, text in zip(cut, texts):
            if self.special and self.mark in text:
                got = [get(x) or (array("i", [x]).tobytes(), self.shown[x]) for x in p]
            else:
                got = map(get, p)
            a, b = zip(*got) if p else ((), ())
            ids.append(b"".join(a))
            shown.append(b"".join(b)[1:])
        return ids, shown


_LOADED: dict[str, WordBpe] = {}


def encode_decode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int), decoded (string) of every whole text; ``vocabulary`` is the file's path."""
    docs = C.keyed(docs, id_col, text_col).select("doc_id", "text")

    def emit(batches):
        if vocabulary not in _LOADED:
            _LOADED[vocabulary] = WordBpe(vocabulary)
        model = _LOADED[vocabulary]
        gc.disable()  # the memory's many small objects form no cycles
        for batch in batches:
            data, offsets = C.buffers(batch.column("text"))
            for lo, hi in C.slices(offsets, 4 << 20):
                ids, shown = model.encode(batch.column("text").slice(lo, hi - lo).to_pylist(), plain_bytes(data[offsets[lo] : offsets[hi]]))
                flat = np.frombuffer(b"".join(ids), "<i4")
                at = np.concatenate(([0], np.cumsum([len(x) // 4 for x in ids]))).astype(np.int32)
                yield pa.record_batch([batch.column("doc_id").slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(at), pa.array(flat)), pa.array(shown, pa.string())], names=["doc_id", "ids", "decoded"])

    return docs.mapInArrow(emit, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>, decoded string")


def op5_bpe_encode_decode(spark, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digests(encode_decode(docs, vocabulary or C.vocabulary("word_bpe_49k.json")))


def digests(encoded: DataFrame) -> DataFrame:
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
