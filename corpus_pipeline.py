"""The corpus pipeline: toxicity, line dedup, near-duplicates, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes it as Parquet to the shared folder and
reads it back as the next one's documents. All stages but the last return the columns of documents; the last returns
the mix: doc_id, size, source_size, target, taken, first_slot and last_slot. No SQL for the whole exists, since toxicity
is learned with zstandard; tests hold line dedup, near-duplicates, decontamination and the mix against brute-force
versions, and toxicity against planted documents and held-out labels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, linededup, mixing, simhash, toxicity
from tessera.llm.shared import discard, free_names, materialise, noted, read


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, learned from their labels, does not find likelier toxic than not."""
    model = toxicity.train_toxicity(docs, read(spark, sf_dir, "labels"))
    (out,) = free_names(docs, "_toxicity")
    return toxicity.score_toxicity(docs, model, out=out).where(F.col(out)["score"] < 0.5).drop(out)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat an earlier one; n_chars follows the text. No document goes."""
    return linededup.remove_repeated_lines(docs).withColumn("n_chars", F.when(F.col("text").isNotNull(), F.char_length("text").cast("long")).otherwise(F.col("n_chars")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that SimHash fingerprints within 3 bits link, or sets of five-word shingles at a Jaccard
    similarity of 0.8 or more."""
    return simhash.first_of_groups(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    return decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix of all that is left takes of each document."""
    return mixing.mix_sources(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix),
]

#: Toxicity is learned with zstandard dictionaries, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in a row; what a stage has written goes as soon as its result is there."""
    docs, last = read(spark, sf_dir, "documents"), []
    for _, stage in STAGES:
        with noted() as names:
            docs = materialise(stage(spark, docs, sf_dir))
        discard(spark, [*last, *names[:-1]])
        last = names[-1:]
    return docs
