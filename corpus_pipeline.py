"""From raw documents to packed training sequences: stages over Parquet, each calling one operator of tapewright.llm.

1. toxicity: documents that the classifier rejects go. 2. lines: repeated three-line passages go from the later documents.
3. near_duplicates: one document of each class stays, that of the least doc_id. 4. mix: documents are put in the order of the
schedule that keeps sources at their target weights, held by the column ``position``. 5. pack: sequences of 4,096 tokens, whose
pieces and numbers follow ``position``; its rows hold the token ids of each piece.

Stages read the columns of ``documents`` alone, so extra columns, whatever their names, end with the first. Documents without an id stay, each for itself,
but for copies of one text; null texts are empty ones; empty tables give no rows. Texts are whole in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.llm import toxicity
from tapewright.llm.common import materialize, read
from tapewright.llm.line_dedup import dedup_lines
from tapewright.llm.mixing import mix_sources
from tapewright.llm.near_dedup import drop_near_duplicates
from tapewright.llm.packing import pack_documents
from tapewright.llm.queries import word_tokenizer

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS)
    return toxicity.drop_toxic(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


def lines_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``n_chars`` follows the text."""
    return dedup_lines(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs.select(*COLUMNS))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix_sources(docs.select(*COLUMNS)).repartitionByRange(F.col("position")).sortWithinPartitions("position").select(*COLUMNS, "position")


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs.select("doc_id", "text", "position"), word_tokenizer(), with_ids=True, order="position")


STAGES = [("toxicity", toxicity_stage), ("lines", lines_stage), ("near_duplicates", near_duplicates_stage), ("mix", mix_stage), ("pack", pack_stage)]

#: A classifier, signatures and a tokenizer have no SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
