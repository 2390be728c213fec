import pytest


@pytest.fixture
def table(spark):
    """Documents with nulls, ties, repeated rows, empty and long texts, and columns whose names clash."""

    def make(rows=None):
        if rows is None:
            line = "the quick brown fox jumps over the lazy dog again and again today"
            body = "\n".join(f"{line} {i} {'abcdefgh'[i % 8]}" for i in range(12))
            rows = [(1, body), (2, body), (2, body), (3, None), (None, "a few words only here"), (None, body + "\nand one more line"), (4, ""), (5, " \t\n "), (6, "é ü <|endoftext|> ñ\r\n日本 😀"), (7, "x" * 300_000), (8, ("word " * 60_000)), (9, body.replace("fox", "cat", 1))]
        names = ["kid__", "kid", "gone", "lines", "ends", "h", "row", "label", "node", "at", "a.b"]
        return spark.createDataFrame([(i, t, b"z", k, *[f"{x}{k % 3}" for x in names]) for k, (i, t) in enumerate(rows)], "doc_id long, text string, z binary, n int, " + ", ".join(f"`{x}` string" for x in names))

    return make


@pytest.fixture
def texts():
    return lambda df: [(r.doc_id, r.text or "") for r in df.collect()]
