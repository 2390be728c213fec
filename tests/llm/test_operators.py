"""The corpus operators against brute force, libraries and round trips."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from strandline.llm import _common as C
from strandline.llm import bpe, chat, components, contamination, jaccard, lines, quality, repeats, scoring, substring, suffix, token_files

WORD = re.compile(r"[^\x20\x09-\x0D]+")
sha = lambda b: hashlib.sha256(b).hexdigest()


def rows(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def removed(sequences, length):
    count = collections.Counter(s[i : i + length] for s in sequences for i in range(len(s) - length + 1))
    out = []
    for s in sequences:
        gone = [False] * len(s)
        end = 0
        for i in range(len(s) - length + 1):
            if count[s[i : i + length]] > 1:
                gone[max(i, end) : i + length] = [True] * (i + length - max(i, end))
                end = i + length
        out.append(gone)
    return out


def generated(seed=5, n=60):
    r = random.Random(seed)
    words = ["".join(r.choice("abcde") for _ in range(r.randint(1, 4))) for _ in range(80)]
    pool = [" ".join(r.choice(words) for _ in range(r.randint(10, 120))) for _ in range(8)]
    docs = []
    for i in range(n):
        parts = [r.choice(pool) if r.random() < 0.5 else " ".join(r.choice(words) for _ in range(r.randint(3, 60))) for _ in range(r.randint(0, 4))]
        text = r.choice(["\n", " ", "  "]).join(parts)
        if r.random() < 0.2 and docs:
            text = docs[-1][1].replace("a", "b", 2)
        docs.append((i, text))
    return docs


@pytest.mark.parametrize("window", [35, 7])
def test_passages_against_brute_force(table, texts, window):
    for df in (table(), table(generated())):
        docs = texts(df)
        words = [tuple(t.encode().split()) for _, t in docs]
        want = sorted(((d, len(w), sum(g), b" ".join(x for x, y in zip(w, g) if not y).decode()) for (d, _), w, g in zip(docs, words, removed(words, window))), key=repr)
        assert rows(substring.remove_repeated_passages(df, window=window, anchor=4), "doc_id", "n_words", "n_removed", "kept") == want


@pytest.mark.parametrize("length,bucket", [(200, 512), (40, 512), (40, 2)])
def test_bytes_against_brute_force(table, texts, length, bucket):
    df = table(generated(9)) if length == 40 else table([(i, t) for i, t in generated(3)] + [(None, None), (7, "x" * 3000), (8, "")])
    docs = texts(df)
    raw = [t.encode() for _, t in docs]
    want = sorted(((d, len(b), sum(g), bytes(x for x, y in zip(b, g) if not y)) for (d, _), b, g in zip(docs, raw, removed(raw, length))), key=repr)
    got = suffix.remove_repeated_bytes(df, length=length, seed=16, bucket=bucket)
    assert rows(got.withColumn("kept", got.kept), "doc_id", "n_bytes", "n_removed", "kept") == want


def hot_passage(n=1000):
    """A passage in n different surroundings, some of which share a little more of them."""
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(1, 6)))
    passage = " ".join(word() for _ in range(60))
    return [(i, " ".join([*(word() for _ in range(20)), r.choice("xyz"), passage, r.choice("xyz"), r.choice("xyz"), *(word() for _ in range(20))])) for i in range(n)]


@pytest.mark.parametrize("bucket", [512, 8])
def test_a_seed_with_a_thousand_surroundings(table, texts, bucket):
    df = table(hot_passage())
    docs = texts(df)
    raw = [t.encode() for _, t in docs]
    want = sorted(((d, len(b), sum(g)) for (d, _), b, g in zip(docs, raw, removed(raw, 200))), key=repr)
    assert rows(suffix.remove_repeated_bytes(df, bucket=bucket), "doc_id", "n_bytes", "n_removed") == want
    words = [tuple(t.split()) for _, t in docs]
    want = sorted(((d, len(w), sum(g)) for (d, _), w, g in zip(docs, words, removed(words, 35))), key=repr)
    assert rows(substring.remove_repeated_passages(df, bucket=bucket), "doc_id", "n_words", "n_removed") == want


def test_runs_of_texts_longer_than_the_place_bits(monkeypatch):
    data = np.random.default_rng(2).integers(0, 256, 5000).astype(np.uint8)
    symbols = repeats.BYTES.codes(data), np.array([0, 3500, 5000])
    want = repeats.runs_of(*symbols, 200, 16)
    monkeypatch.setattr(repeats, "PLACE_BITS", 10)
    got = repeats.runs_of(*symbols, 200, 16)
    assert len(want["p"]) > 20 and all(np.array_equal(want[x], got[x]) for x in want)


def test_deep_shallow_sorts():
    r = random.Random(1)
    strings = [bytes(r.choice(b"ab\0") for _ in range(r.randint(0, 90))) for _ in range(150)]
    strings += [strings[0] + b"x" * 40, b"q" * 60 + b"a", b"q" * 60 + b"b", b"q" * 60]
    group = np.array([r.randint(0, 2) for _ in strings])
    order, common = suffix.deep_shallow(strings, group)
    assert [(group[i], strings[i]) for i in order] == sorted(zip(group.tolist(), strings))
    for k, i in enumerate(order):
        before = order[k - 1]
        same = k and group[before] == group[i]
        n = next((x for x, (a, b) in enumerate(zip(strings[before], strings[i])) if a != b), min(len(strings[before]), len(strings[i])))
        assert common[k] == (n if same else -1)


def test_lines_keep_first_place(table, texts):
    df = table(generated(2) + [(None, None), (100, "a\nb\nc\nd"), (101, "a\nb\nc\nd"), (102, ""), (102, "")])
    got = {r.doc_id: r for r in lines.dedup_lines(df).collect()}
    seen, want = set(), {}

    def chunks(text):
        ls = text.split("\n")
        h = [int(hashlib.md5(x.encode()).hexdigest()[:7], 16) for x in ls]
        part = []
        for i, x in enumerate(ls):
            part.append(x)
            if i == len(ls) - 1 or (h[i] + 31 * (h[i - 1] if i else 0) + 961 * (h[i - 2] if i > 1 else 0)) % lines.DIVISOR == 0:
                yield part
                part = []

    for d, t in sorted(texts(df), key=lambda x: (x[0] is None, x[0])):
        kept = []
        for c in chunks(t):
            if len(c) < 2 or "\n".join(c) not in seen:
                kept += c
            if len(c) > 1:
                seen.add("\n".join(c))
        want[d] = "\n".join(kept)
    assert {d: r.kept for d, r in got.items()} == want
    stage = lines.without_repeated_chunks(df, pairs=False)
    assert stage.schema == df.schema
    rest = lambda d: sorted(((r.doc_id, *r[2:]) for r in d.collect()), key=repr)
    assert rest(stage) == rest(df) and all((r.text or "") == want[r.doc_id] for r in stage.collect())


def test_lines_of_copies_all_go(table):
    r = random.Random(4)
    bodies = ["\n".join(f"line {r.random()}" for _ in range(r.randint(2, 30))) for _ in range(60)]
    df = table([(i, b) for i, b in enumerate(bodies + bodies)])
    for out in (lines.dedup_lines(df, pairs=True).select("doc_id", "kept"), lines.without_repeated_chunks(df).select("doc_id", "text")):
        got = dict(map(tuple, out.collect()))
        assert all(got[i] == b and got[60 + i] == "" for i, b in enumerate(bodies))


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_pairs_of_lines_against_sql(spark, sf):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '/root/testdata/{sf}/documents.parquet'")
    want = con.execute(lines.PAIRS_SQL).fetchall()
    assert rows(lines.op1_line_dedup_pairs(spark, f"/root/testdata/{sf}"), "doc_id", "n_chunks", "n_removed", "n_removed_lines", "kept_sha256") == sorted(want, key=repr)


def interpolated(docs, order, rounds=12):
    """Deleted interpolation as plainly as can be: (id, tokens, known, training tokens, held out, base score, score)."""
    low = lambda t: WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t)) + [None]
    fold = lambda d: zlib.crc32(str(d if d is not None else "").encode()) % 7

    def grams(t):
        w = ["<s>"] * (order - 1) + low(t)
        return [[tuple(w[i - k : i + 1]) for k in range(order)] for i in range(order - 1, len(w))]

    def counts(some):
        c = collections.Counter(g for t in some for token in grams(t) for g in token)
        for k in range(1, order):
            c[("<s>",) * k] = len(some)
        words = [n for g, n in c.items() if len(g) == 1 and g != ("<s>",)]
        return c, sum(words), len(words)

    def estimates(token, c, n, v):
        p, bucket = [1 / (v + 1), c[token[0]] / max(n, 1)], 0
        for k, g in enumerate(token[1:], 1):
            context = c[g[:-1]]
            p.append(c[g] / context if context else 0.0)
            if context:
                bucket = 32 * k + int(math.log2(context))
        return p, bucket

    every = counts([t for d, t in docs if fold(d) != 2])
    fit = counts([t for d, t in docs if fold(d) not in (2, 3)])
    tuning = [estimates(g, *fit) for d, t in docs if fold(d) == 3 for g in grams(t)]
    weights, pooled = {}, [1 / (order + 1)] * (order + 1)
    for _ in range(rounds):
        sums = collections.defaultdict(lambda: [0.0] * (order + 2))
        for p, b in tuning:
            mixed = [x * y for x, y in zip(weights.get(b, pooled), p)]
            for s in (sums[b], sums[None]):
                s[0] += 1
                for k, x in enumerate(mixed):
                    s[k + 1] += x / sum(mixed)
        if tuning:
            pooled = [x / sums[None][0] for x in sums[None][1:]]
        weights = {b: [x / s[0] for x in s[1:]] for b, s in sums.items() if b is not None}
    out = []
    for d, t in docs:
        score = base = known = 0
        for g in grams(t):
            p, b = estimates(g, *every)
            w = [0.99999 * x + 0.00001 / (order + 1) for x in weights.get(b, pooled)]
            score += math.log10(sum(x * y for x, y in zip(p, w)))
            base += math.log10((every[0][g[0]] + 1) / (every[1] + every[2] + 1))
            known += every[0][g[0]] > 0
        out.append((d, len(grams(t)), known, every[1], fold(d) == 2, base, score))
    return out


@pytest.mark.parametrize("order", [1, 2, 3, 5])
def test_scores_against_brute_force(table, texts, order):
    for df in (table(generated(3) + [(None, None), (3, "a a a"), (3, "a a a")]), table()):
        want = sorted(interpolated(texts(df), order), key=repr)
        got = rows(scoring.score_documents(df, order=order), "doc_id", "n_tokens", "n_known", "train_tokens", "held_out", "base_score", "score")
        assert len(got) == len(want)
        for a, b in zip(got, want):
            assert a[:5] == b[:5] and math.isclose(a[5], b[5], rel_tol=1e-9) and math.isclose(a[6], b[6], rel_tol=1e-4)


def test_sums_as_a_tree(table, texts):
    df = table(generated(3, 40))
    names = ("doc_id", "n_tokens", "n_known", "train_tokens", "held_out", "base_score", "score")
    want = rows(scoring.score_documents(df), *names)
    got = rows(scoring.score_documents(df, fan=2, block_bytes=3000), *names)
    assert all(a[:5] == b[:5] and math.isclose(a[5], b[5], rel_tol=1e-9) and math.isclose(a[6], b[6], rel_tol=1e-6) for a, b in zip(got, want)) and len(got) == len(want)


def test_orders_that_are_not_supported(table):
    for order in (0, 9):
        with pytest.raises(ValueError):
            scoring.score_documents(table(), order=order)


def test_weights_by_expectation_maximisation():
    p = np.array([[0.1, 0.5]] * 80 + [[0.1, 0.0]] * 20)
    weights = np.full((scoring.BUCKETS, 2), 0.5)
    for _ in range(500):
        weights = scoring.new_weights(scoring.shares(np.full(100, 3), p, weights))
    # d/dx of 80 log(.1 x + .5 (1 - x)) + 20 log(.1 x) is 0 at x = .25
    assert math.isclose(weights[3][0], 0.25, abs_tol=1e-3) and math.isclose(weights[3].sum(), 1)


def test_token_files(spark, table, texts, tmp_path):
    from tokenizers import Tokenizer

    path = C.vocabulary("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    df = table()
    token_files.write_token_files(df, str(tmp_path / "f"), path)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_files.read_token_files(spark, str(tmp_path / "f")).collect())
    ids = sorted((str(d), zlib.crc32(np.array(x := t.encode(s, add_special_tokens=False).ids + [0], "<u4").tobytes()), len(x)) for d, s in texts(df))
    assert sorted((str(d), c, n) for _, d, n, c in got) == ids
    known = [d for _, d, _, _ in got]
    assert known == sorted(known, key=lambda d: (d is not None, d))
    assert all(a[0] + a[2] == b[0] for a, b in zip(got, got[1:]))


SAMPLES = ["", " a", "a ", "a  b\n\n c", "İstanbul ΣΑΣ", "don't I'LL 12ab \x1c x", "éé ﬁ ½ 😀👍🏽", "x" * 5000, "<|endoftext|>a<|startoftext|>", "日本語　text \x85\xa0", "é Å"]


def test_encoders_agree_with_the_library():
    from tokenizers import Tokenizer

    words, byte = C.vocabulary("word_bpe_49k.json"), C.vocabulary("byte_bpe_50k.json")
    lib, model = Tokenizer.from_file(words), bpe.WordBpe(words)
    ids, shown = model.encode(SAMPLES)
    for s, i, d in zip(SAMPLES, ids, shown):
        want = lib.encode(s, add_special_tokens=False).ids
        assert np.frombuffer(i, "<i4").tolist() == want and d.decode() == lib.decode(want, skip_special_tokens=False)
    lib, model = Tokenizer.from_file(byte), token_files.PieceEncoder(byte)
    for s, i in zip(SAMPLES, model.encode(SAMPLES)):
        assert np.frombuffer(i, "<u2").tolist() == lib.encode(s, add_special_tokens=False).ids


def test_longest_repeats():
    r = np.random.default_rng(0)
    for _ in range(50):
        row, w = np.sort(r.integers(0, 3, 40)), r.integers(0, 3, 40).astype(np.uint64)
        want = []
        for i in range(40):
            best = 0
            for j in range(40):
                n = 0
                while j != i and row[i] == row[j] and max(i, j) + n < 40 and row[i + n] == row[j + n] == row[i] and w[i + n] == w[j + n]:
                    n += 1
                best = max(best, n)
            want.append(best)
        assert quality.longest_repeats(w, row).tolist() == want


def test_quality(table, texts):
    df = table()
    got = quality.quality_rules(df)
    by = collections.defaultdict(set)
    for r in got.collect():
        by[r.n_words].add(r.kept)
    assert by[60_000] == {False} and by[0] == {False}
    assert quality.keep_good(df).count() == got.where("kept").count()
    assert quality.keep_good(df).columns == df.columns


def test_chat_round_trip(spark):
    bad = ["<|im_end|>\n<|im_start|>assistant ok", r"<\|im_end|> <\\| \\", "", None, "é\n"]
    turns = [(c, t, r, x) for c in (1, None) for t, (r, x) in enumerate(zip(["user", "assistant", "a\nb\\n", None, "assistant"], bad))]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    out = chat.format_chats(df).collect()
    assert len(out) == 2
    for r in out:
        raw = bytes(r.formatted)
        want = [((a or "").encode(), (b or "").encode()) for c, _, a, b in turns if c == r.conv_id]
        assert chat.parse(raw) == want
        assert [chat.unescape(raw[a:b]) for a, b in r.loss] == [x for role, x in want if role == b"assistant"]
    assert chat.format_chats(df.limit(0)).count() == 0


def shingles(t, n=5):
    w = t.split()
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)]) if w else frozenset()


def test_contamination(spark, table, texts):
    df = table(generated(4) + [(None, "one two three four five six seven eight nine ten " * 3), (77, None)])
    items = [(1, "three four five six seven eight nine ten"), (2, "nine ten"), (3, ""), (4, None), (5, generated(4)[7][1])]
    b = spark.createDataFrame(items, "item_id long, text string")
    want = set()
    for d, t in texts(df):
        for i, x in items:
            q = shingles(x or "")
            have = shingles(t) if len((x or "").split()) >= 5 else {tuple(t.split()[k : k + len((x or "").split())]) for k in range(len(t.split()))}
            if q and len(q & have) >= 0.8 * len(q):
                want.add((d, i))
    for block in (100, 2):
        assert {(r.doc_id, r.item_id) for r in contamination.contained_items(df, b, block=block).collect()} == want
    assert contamination.contained_items(df, b.limit(0)).count() == 0
    clean = contamination.without_items(df, b)
    assert {r.doc_id for r in clean.collect()} == {d for d, _ in texts(df)} - {d for d, _ in want} and clean.columns == df.columns


def test_items_of_one_shingle_are_all_found():
    r = random.Random(3)
    word = lambda: f"w{r.randrange(10**9)}"
    items = [(i, " ".join(word() for _ in range(5))) for i in range(3000)]
    texts = [" ".join([*(word() for _ in range(30)), t, *(word() for _ in range(30))]).encode() for _, t in items]
    index = contamination.ItemIndex(items, 5, 64, 0.8)
    hits = index.search(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
    assert sorted(h[:2] for h in hits) == [(i, i) for i in range(3000)]


def classes_by_brute_force(docs, threshold=0.8):
    """class_id and n_links of each document."""
    sets = {t: shingles(t) for _, t in docs}
    each = list(sets)
    near = {t: set() for t in each}
    for i, x in enumerate(each):
        for y in each[:i]:
            a, b = sets[x], sets[y]
            if a == b or len(a & b) >= threshold * len(a | b):
                near[x].add(y)
                near[y].add(x)
    label = {}
    for t in each:
        if t not in label:
            todo, label[t] = [t], t
            while todo:
                for y in near[todo.pop()]:
                    if y not in label:
                        label[y] = t
                        todo.append(y)
    ids = collections.defaultdict(list)
    for d, t in docs:
        if d is not None:
            ids[label[t]].append(d)
    return [(d, min(ids[label[t]], default=None), len(near[t])) for d, t in docs]


def near_copies(n=300, seed=12):
    """Groups of texts with a few words changed, around the threshold and well over it."""
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(5000)}"
    docs = []
    for k, (size, edits) in enumerate([(n, 3), (n // 2, 8), (n // 3, 1), (40, 12)]):
        body = [word() for _ in range(150 + 50 * k)]
        for _ in range(size):
            text = list(body)
            for _ in range(r.randint(0, edits)):
                text[r.randrange(len(text))] = word()
            docs.append(" ".join(text))
    r.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize("bucket,block", [(512, 256), (16, 24)])
def test_jaccard_against_brute_force(table, texts, bucket, block):
    for df in (table(), table(generated(6)), table(near_copies())):
        want = sorted(classes_by_brute_force(texts(df)), key=repr)
        assert rows(jaccard.jaccard_join(df, bucket=bucket, block=block), "doc_id", "class_id", "n_links") == want


def test_one_of_each_class(table, texts):
    df = table()
    got = jaccard.one_of_each_class(df)
    assert got.schema == df.schema
    kept = got.collect()
    assert {r.doc_id for r in kept} == {c for _, c, _ in classes_by_brute_force(texts(df))}
    assert all(r in df.collect() for r in kept) and len(kept) == len({r.doc_id for r in kept})


def test_recall_of_near_pairs(table):
    """Of pairs of similarity 0.8 to 0.85, which are met least often, at least 0.9 are found (all of these)."""
    r = random.Random(77)
    docs, want = [], 0
    for k in range(400):
        body = [f"{k}w{r.randrange(9000)}" for _ in range(r.randint(60, 200))]
        other = list(body)
        while True:
            change = list(other)
            change[r.randrange(len(change))] = f"{k}x{r.randrange(9000)}"
            a, b = shingles(" ".join(body)), shingles(" ".join(change))
            if len(a & b) < 0.8 * len(a | b):
                break
            other = change
        docs += [(2 * k, " ".join(body)), (2 * k + 1, " ".join(other))]
        want += 2 * (body != other)
    found = sum(x.n_links for x in jaccard.jaccard_join(table(docs)).collect())
    assert want > 600 and found >= 0.99 * want


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 99), (99, 98), (7, 7)], "a long, b long")
    got = {r.node: r.label for r in components.components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 98 for i in (98, 99, 100)}}


def test_empty_tables(spark, table, tmp_path):
    empty = table().limit(0)
    path = C.vocabulary("word_bpe_49k.json")
    for f in (substring.remove_repeated_passages, suffix.remove_repeated_bytes, lines.dedup_lines, scoring.score_documents, quality.quality_rules, jaccard.jaccard_join, lambda d: bpe.encode_decode(d, path)):
        assert f(empty).count() == 0
    token_files.write_token_files(empty, str(tmp_path / "e"), C.vocabulary("byte_bpe_50k.json"))
    assert token_files.read_token_files(spark, str(tmp_path / "e")).count() == 0


def measured(text):
    """The quality rules' counts and verdict of a text, as plainly as can be."""
    w = WORD.findall(text or "")
    n = len(w)
    lines_ = [x for x in (text or "").split("\n") if WORD.search(x)]
    triples = collections.Counter(tuple(w[i : i + 3]) for i in range(n - 2))
    again = {j for i in range(n - 2) if triples[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    best = [0] * n
    for i in range(n):
        for j in range(i):
            k = 0
            while i + k < n and w[i + k] == w[j + k]:
                k += 1
            best[i], best[j] = max(best[i], k), max(best[j], k)
    covered = {k for i in range(n) if best[i] >= 5 for k in range(i, i + best[i])}
    longest = max(best, default=0)
    failed = n < 50 or 100 * len(again) > 50 * n
    kept = not failed and len(covered) <= 0.4 * n and (longest < 5 or longest <= min(200, 0.3 * n))
    return n, sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>") if text else 0, len(lines_) - len(set(lines_)), len(again), len(covered), longest, failed, kept


QUALITY = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered", "longest_repeat", "base_failed", "kept")


def test_quality_against_brute_force(table, texts):
    r = random.Random(31)
    word = lambda: r.choice("abcdefghijklmnop") * r.randint(1, 4) + r.choice(["", "#", "é", "|"])
    docs = generated(8) + [(None, None), (500, ""), (500, "")]
    for i in range(60):
        body = [word() for _ in range(r.randint(40, 120))]
        body += body[: r.choice([0, 4, 6, 30])] + [word() for _ in range(5)]
        docs.append((600 + i, " ".join(body).replace(" a", "\n", 3)))
    df = table(docs)
    want = sorted(((d, *measured(t)) for d, t in docs), key=repr)
    assert rows(quality.quality_rules(df), "doc_id", *QUALITY) == want
    kept = quality.keep_good(df)
    assert kept.schema == df.schema and sorted(map(repr, kept.collect())) == sorted(repr(x) for x in df.collect() if measured(x.text)[-1])
    assert {x[-1] for x in want} == {True, False}


def without_chunks(docs):
    """Line dedup with chunks of two lines at least; (id, text) in order of ids, null ids last."""
    seen, out = set(), []
    for d, text in sorted(docs, key=lambda x: (x[0] is None, x[0])):
        ls = (text or "").split("\n")
        h = [int(hashlib.md5(x.encode()).hexdigest()[:7], 16) for x in ls]
        n = len(ls)
        ends = [i for i in range(n) if i == n - 1 or (h[i] + 31 * (h[i - 1] if i else 0) + 961 * (h[i - 2] if i > 1 else 0)) % lines.DIVISOR == 0]
        ends = [e for k, e in enumerate(ends) if e == n - 1 or 0 < e < n - 2 and (k == 0 or ends[k - 1] < e - 1)]
        kept, at = [], 0
        for e in ends:
            chunk = ls[at : e + 1]
            at = e + 1
            if len(chunk) < 2 or "\n".join(chunk) not in seen:
                kept += chunk
            if len(chunk) > 1:
                seen.add("\n".join(chunk))
        out.append((d, "\n".join(kept)))
    return out


def pipeline_by_brute_force(docs, items, path):
    from tokenizers import Tokenizer

    docs = [(d, t) for d, t in docs if measured(t)[-1]]
    docs = without_chunks(docs)
    found = classes_by_brute_force(docs)
    groups = collections.defaultdict(list)
    for (d, t), (_, c, _) in zip(docs, found):
        groups[c].append((d is None, d, t))
    docs = [min(g, key=lambda x: (x[0], x[1] or 0))[1:] for g in groups.values()]
    clean = [(d, t) for d, t in docs if not any(q and len(q & shingles(t)) >= 0.8 * len(q) for q in map(shingles, items))]
    lib, out = Tokenizer.from_file(path), []
    for d, t in clean:
        ids = lib.encode(t, add_special_tokens=False).ids
        out.append((d, len(ids), sha(" ".join(map(str, ids)).encode()), sha(lib.decode(ids, skip_special_tokens=False).encode())))
    return sorted(out, key=repr)


def test_pipeline_against_brute_force(spark, table, tmp_path):
    import corpus_pipeline as p

    r = random.Random(17)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8)))
    prose = lambda n: "\n".join(" ".join(word() for _ in range(12)) for _ in range(n))
    shared = prose(9)
    items = [" ".join(word() for _ in range(20)) for _ in range(4)]
    docs = [(i, prose(r.randint(6, 14))) for i in range(25)]
    docs += [(30 + i, prose(6) + "\n" + shared + "\n" + prose(3)) for i in range(5)]
    docs += [(40 + i, t.replace("a", "b", 1)) for i, (_, t) in enumerate(docs[:6])] + [(50, docs[3][1]), (50, docs[3][1])]
    docs += [(60 + i, prose(6) + "\n" + x + "\n" + prose(2)) for i, x in enumerate(items)]
    docs += [(70, None), (None, prose(8)), (71, ""), (72, "too short"), (73, "same words here " * 40)]
    table(docs).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(items)) + [(9, None), (10, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    want = pipeline_by_brute_force(docs, items, C.vocabulary("word_bpe_49k.json"))
    got = rows(p.run(spark, str(tmp_path)), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert got == want and 20 < len(want) < len(docs) - 8


def test_stages_on_empty_tables(spark, table):
    empty = table().limit(0)
    items = spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")
    stages = (quality.keep_good, lines.without_repeated_chunks, jaccard.one_of_each_class, lambda d: contamination.without_items(d, items), lambda d: contamination.without_items(d, items.limit(0)))
    for stage in stages:
        out = stage(empty)
        assert out.schema == empty.schema and out.count() == 0


def test_pipeline_keeps_columns(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for _, stage in p.STAGES[:-1]:
        assert stage(spark, docs, "/root/testdata/sf0.001").columns == docs.columns


def test_tokens_that_meet():
    """Undoing merges tells the same as merging all symbols of both tokens."""
    e = bpe.WordBpe(C.vocabulary("word_bpe_49k.json")).encoder
    ends = {i for i, s in e.code.items() if s[1].endswith(b"</w>")}
    every = [i for i in e.code if e.code[i][1][1:2] != b"<"]
    inner, rnd = [i for i in every if i not in ends], random.Random(11)
    for _ in range(3000):
        a, b = rnd.choice(inner), rnd.choice(every)
        assert e.follows(a, b) == (e.merged([*e.leaves(a), *e.leaves(b)]) == [a, b])
