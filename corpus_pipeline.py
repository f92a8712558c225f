"""From raw documents to token ids: five stages, each over all that the one before kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's ``docs``. All but the last return the columns of
``documents``. Every stage takes null, empty and repeated rows, empty tables and further columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anamnesis.llm.common import load, materialise
from anamnesis.llm.decontaminate import drop_contaminated
from anamnesis.llm.jaccard_join import linked_rows
from anamnesis.llm.pieces import encode_texts
from anamnesis.llm.privacy import sanitise
from anamnesis.llm.quality_rules import count_text, kept, learn

#: The vocabulary file of the last stage.
PIECES = "/opt/tokenizers/piece_bpe_32k.model"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go: the base rules and the list learned from the labels of these documents."""
    names = docs.columns
    labels = load(spark, sf_dir, "labels")
    # Only labelled rows are learned from; texts are counted where they are read, so that no join deals them out.
    every = count_text(docs.select("doc_id", "text"), out="_counts").select("doc_id", "_counts")
    labelled = materialise(every, "counted").join(labels.select("doc_id"), "doc_id", "left_semi")
    rules = learn(materialise(labelled, "labelled"), labels, out="_counts")
    # The row number, which no filter passes, keeps this one above the counts: below, it would count again for each condition.
    counted = count_text(docs, out="_counts").withColumn("_row", F.monotonically_increasing_id())
    return counted.where(kept(rules, F.col("_counts")) & (F.col("_row") >= 0)).select(*names)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group the row with the least id stays, once; rows without an id all stay.

    Rows are told apart by id and text, so other texts under the id of a copy stay.
    """
    found = linked_rows(docs, n=5, share=80, by_prefix=True)
    named = found.where("doc is not null")
    others = named.where("doc <> first.doc or mark <> first.mark").select(F.col("doc").alias("_doc"), F.col("mark").alias("_mark"))
    repeated = named.groupBy("doc").agg(F.count("*").alias("n")).where("n > 1")
    same = (docs["doc_id"] == F.col("_doc")) & (F.xxhash64(docs["text"]) == F.col("_mark"))
    left = docs.join(others, same, "left_anti")
    if repeated.isEmpty():
        return left.select(*docs.columns)
    once = left.where("doc_id is not null").dropDuplicates(["doc_id", "text"])
    return once.union(left.where("doc_id is null")).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go, all others stay as they are."""
    return drop_contaminated(docs, load(spark, sf_dir, "benchmark"), n=13, share=5)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Private spans are replaced in the text; n_chars is counted anew."""
    return sanitise(docs, count_col="n_chars")


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_pieces, and whether decoding gives the text back."""
    found = encode_texts(docs, PIECES)
    return found.select(F.col("key").alias("doc_id"), "ids", "n_pieces", F.col("same").alias("round_trip"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("private_data", private_data),
    ("sentencepiece", sentencepiece),
]

#: Learned rules, components and merges have no SQL; tests hold each stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
