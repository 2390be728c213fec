"""A pipeline over documents: quality, line dedup, near duplicates, decontamination, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return
the columns of documents.

For all stages: a null text is empty; a null id is an id of its own, after all others; columns may have any names
and keep their contents; an empty table gives an empty table; a text is handled by one task as a whole, whatever
its length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandline.llm import _common, bpe, contamination, jaccard, lines, quality


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go; repeated rows get the same verdict, texts without words go."""
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Chunks of lines met before go from the texts; the least id keeps them, repeated rows of it all do."""
    return lines.without_repeated_chunks(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that of the least id; of repeated rows one."""
    return jaccard.one_of_each_class(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go; items without words match nothing, repeated rows fare alike."""
    return contamination.without_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def bpe_encode_decode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the documents' ids and of the texts that they decode to, a row for each row."""
    return bpe.digests(bpe.encode_decode(docs, _common.vocabulary("word_bpe_49k.json")))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("BPE encoding and decoding", bpe_encode_decode),
]

#: SQL can't express the verdicts of the suffix array nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = _common.cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
