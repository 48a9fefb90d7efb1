"""The corpus pipeline: five stages, each over all that the one before kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the
columns of documents. Copies go by the near-duplicate stage, so what the substring stage removes are passages that unlike
documents share. No stage can be told in SQL as a whole (a trained score, sampled signatures), so ORACLE_SQL is None.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm import bagminhash, packing, pii, substring_dedup, toxicity
from pagemill.llm.common import Carried, Scratch, load
from pagemill.llm.queries import tokenizer


def _with_text(out: DataFrame, carried: Carried) -> DataFrame:
    """The documents' columns from rows with a new column text, and n_chars of it."""
    out = out.select(*carried.columns())
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in carried.names else out


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.7 or more go. Null and empty texts are scored as texts without windows; repeated
    rows share one fate; an empty table stays empty; other columns of any name stay."""
    carried = Carried(docs, text="text")
    model = toxicity.fit(docs, load(spark, sf_dir, "labels"))
    return model.score(carried.frame).where(F.col("score") < toxicity.LIMIT).select(*carried.columns())


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays: that with the least id. Null and empty texts are classes of their own;
    of repeated rows one stays; an empty table stays empty; other columns of any name stay."""
    return bagminhash.deduplicated(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in windows of 35 that occur more than once go; every document stays, if with an empty text. Null texts stay null;
    repeated rows count as copies; an empty table stays empty; other columns of any name stay."""
    carried = Carried(docs, text="text")
    out = substring_dedup.remove_repeats(carried.frame)
    return _with_text(out.withColumn("text", F.when(F.col("text").isNotNull(), F.col("kept"))), carried)


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data, plain or disguised, becomes its kind in angle brackets. Null texts stay null and empty ones empty;
    repeated rows are treated alike; an empty table stays empty; other columns of any name stay."""
    carried = Carried(docs, text="text")
    return _with_text(pii.masked(carried.frame), carried)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their ids, placed in sequences. Null and empty texts are one piece each; repeated
    rows are packed as often as they come; an empty table gives no rows; other columns than doc_id and text are left."""
    return packing.pack_documents(docs.select("doc_id", "text"), tokenizer("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("pii", mask_pii),
    ("packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents. Each stage's output is written and read again, so that none is computed twice."""
    docs, scratch = load(spark, sf_dir, "documents"), Scratch(spark)
    for name, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return docs
