"""From raw documents to token files: five stages, each one operator, each written and read again.

toxicity drops what the tagger rejects, near_duplicates keeps one document of each class of similar texts,
decontamination drops documents that hold a benchmark item, mixing takes each source to its target (repeated
documents are repeated rows), tokens writes the ids as planes and returns what is read back from them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm import decontam, mixing, shingle_join, token_output, toxicity
from tallyframe.llm.common import stage, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.5; null and empty texts score like clean ones and stay."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of texts linked by a 5-word Jaccard of 0.8 or more: the one of smallest doc_id.

    SimHash pivot tables link the closest ones, an exact join of shingles the rest; every link is verified.
    """
    return shingle_join.drop_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which tiles cover less than 0.8 of every benchmark item."""
    columns = docs.columns
    made = decontam.contaminated(docs.select(*columns), table(spark, sf_dir, "benchmark"))
    return made.where(F.size("leaks") == 0).select(*columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix to 5, 2, 1 weights over 150 % of all words, as documents; those without words are left out."""
    return mixing.materialise(mixing.mix(docs), docs.columns)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document of the mix, from the files."""
    return token_output.digest(token_output.token_output(spark, docs))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("tokens", write_tokens),
]

#: No SQL for the tagger, the fingerprints and the tokenizer; a test holds the whole run against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
