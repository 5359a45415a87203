"""From raw documents to packed training sequences, stage by stage.

Each stage takes ``(spark, docs, sf_dir)``, where ``docs`` is all that its predecessor kept, read
again from Parquet; all but the last return the columns of ``documents``. Every decision takes
effect: rejected documents and near copies go, mixed documents repeat, packed ones come as pieces.

1. quality: rows stay that have a good grade with probability 0.5 or more; null and empty texts
   are graded as texts without features.
2. toxicity: rows stay that score below 0.3.
3. near duplicates: of each class, the document with the least doc_id stays; a doc_id that repeats
   with another text is another document.
4. mixing: rows repeat as their source's target takes them (0 to 3 times), whole documents only.
5. packing: every piece of every row, with its sequence and offset.

Rows that repeat a doc_id and text count one by one but in stage 3, which keeps one of them; rows
without a doc_id pass stages 3 and 4 once. An empty table gives empty tables. Both classifiers learn from
the labelled documents of the input table outside the held-out fold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siltbed.llm import dart_minhash, mixing, packing, quality, toxicity
from siltbed.llm.queries import byte_vocabulary
from siltbed.storage import materialize, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.select_quality(docs, quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dart_minhash.drop_near_duplicates(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.apply_mix(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, byte_vocabulary())


STAGES = [
    ("quality classifier", quality_stage),
    ("toxicity", toxicity_stage),
    ("MinHash near-dedup", near_duplicate_stage),
    ("mixing sources", mixing_stage),
    ("best-fit packing", packing_stage),
]

#: SQL expresses neither the classifiers nor the signatures and the local search.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents`` of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
