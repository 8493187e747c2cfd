"""The corpus pipeline: documents to a training sequence, in five stages.

Every stage gets all that the one before kept. The first four return the columns
of ``documents``; the last returns the training sequence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from logistra.llm import decontaminate, mixing, ngram_join, quality, secrets
from logistra.llm.frames import pick, table
from logistra.llm.queries import LLM_ORACLES as _ORACLES
from logistra.llm.queries import LLM_QUERIES as _QUERIES
from logistra.storage import drop_table, stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
# Five words a shingle, a similarity of 0.8 or more.
NEAR = ngram_join.Rule(k=5, num=80, den=100, spare=0.25)


def quality_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that a classifier of the labelled ones does not reject.

    Null and empty texts are scored as empty; repeated rows stay or go together; an
    empty table stays empty.
    """
    labels = pick(table(spark, folder, "labels"), "doc_id", "quality")
    model = quality.train(docs, labels.withColumnRenamed("quality", "label"))
    return quality.good_documents(pick(docs, *COLUMNS), model)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest id.

    Documents without words stay.
    """
    return ngram_join.one_of_each(pick(docs, *COLUMNS), NEAR)


def decontamination_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents in which no benchmark item is found.

    Null, empty and wordless texts stay; repeated rows stay or go together; an empty
    benchmark keeps all.
    """
    return decontaminate.without_leaks(pick(docs, *COLUMNS), table(spark, folder, "benchmark"))


def secret_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """All documents, secrets masked in their texts, n_chars of the new text.

    Null, empty and blank texts stay as they are; repeated rows are masked alike; an
    empty table stays empty.
    """
    documents = pick(docs, *COLUMNS)
    return secrets.mask(documents, secrets.train(secrets.corpus_examples(documents)))


def mixing_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The training sequence: a row for each pass of the mix over a document, by position.

    ``taken`` is the number of words that the pass takes, ``position`` its time. Null
    and empty texts have no words and are never taken; repeated rows are documents each, and
    ties are broken by id and text, so reruns agree; an empty table gives none.
    """
    return mixing.training_sequence(pick(docs, *COLUMNS))


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("secret scans", secret_stage),
    ("mixing sources to target weights", mixing_stage),
]
# A trained classifier, a forest and an edit distance are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs, path = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before:
            drop_table(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)


LLM_QUERIES = _QUERIES | {"pipeline": run}
LLM_ORACLES = dict(_ORACLES)
