"""The training-data pipeline: five stages over ``documents``, each read from the last one's Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import bpe, minhash, mixing, quality, toxicity
from quarry.llm.common import noted, removed, saved, table
from quarry.llm.tokens import public

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the limits of their language and source reject go.

    Null, empty and wordless texts go (under 20 words); repeated rows stay or go together; null
    languages and sources are groups of their own; very long texts are counted whole.
    """
    return quality.passing(docs.select(*COLUMNS))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is 0.5 or more go; the labels teach the model, not the verdict.

    Null, empty and letterless texts have no finding and stay; repeated rows are scored alike.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.clean(docs.select(*COLUMNS), model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8) the least doc_id stays.

    Null, empty and wordless texts and rows without an id stay; rows that repeat an id are one
    document, so all of them stay or go; texts under five words are one shingle.
    """
    groups = saved(minhash.near_duplicates(docs, shingle=5, percent=80), "groups")
    return minhash.without(docs.select(*COLUMNS), groups.where("NOT kept")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by the target weights of the tree; a document of a second epoch comes twice.

    The budget is ``mixing.SHARE`` of all tokens, so the rest of them goes: weights and supply alone
    would take nearly everything. Null names are nodes of their own; texts without words cost
    nothing and go with any prefix; rows that repeat an id are taken or left together.
    """
    return mixing.mixed(docs.select(*COLUMNS)).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row's text, their digest and that of the text decoded from them.

    Null and empty texts have no ids; every row gives a row, also where an id repeats or is null.
    """
    return bpe.encoded(docs, public("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("toxicity", drop_toxic),
    ("minhash near-dedup", drop_near_duplicates),
    ("mixing sources", mix_sources),
    ("bpe encoding", encode),
]

#: Toxicity and encoding are beyond SQL; tests hold each stage against brute force or a plain computation.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; a stage's scratch tables go when its result is written, and no others do."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with noted() as scratch:
            made = stage(spark, docs, sf_dir)
        docs = saved(made, name.replace(" ", "-"))
        removed(spark, scratch)
    return docs
