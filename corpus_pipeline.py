"""A corpus pipeline: stages over ``documents``, each written and read again.

Order: toxic documents go; of each group of near copies one stays; documents
contaminated with benchmark passages go; personal data is replaced; what is left
is mixed to the target weights of its sources.  All stages but the last return
the columns of their input; the last returns them with what the mix takes.

Near copies are those of operator 10: sets of four-word shingles, 85 of 100 shared.

Cases: rows with a null doc_id are never near copies and stay; null and wordless texts pass
all stages but the mix, which takes no words of them; very long texts are judged whole;
repeated rows are judged alike and one stays; ties and further cases are those of each
operator; extra columns are kept, but the mix's own names give way to its columns; empty
tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strataq.llm import decontaminate, jaccard, mixing, pii, toxicity
from strataq.llm.common import Store, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.clean(docs, n=4, percent=85)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.clean(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with size, target and words taken."""
    return mixing.taken_rows(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near copies", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("personal data", replace_personal_data),
    ("mixing", mix_sources),
]

#: Training, keyed ciphers and random draws are beyond SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    store = Store(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        old, docs = docs, store.put(stage(spark, docs, sf_dir))
        if hasattr(old, "_strataq_path"):
            store.drop(old)
    return STAGES[-1][1](spark, docs, sf_dir)
