"""Documents through toxicity, language, near-duplicate, decontamination and encoding stages, each on all rows that the one before kept.

Every stage but the last returns the rows it keeps with all their columns, whatever their names; rows that repeat pass or go together, but
the near-duplicate stage keeps one of rows that repeat id and text. Null ids are ids like others. Empty tables give empty results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skeinmatch.llm import bpe_transducer, lang_ecoc, prefix_join, qgram_decon, weak_toxicity
from skeinmatch.llm.common import written
from skeinmatch.llm.queries import BYTE_BPE, fold, table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier, fitted on the labels outside fold 2 of 4, scores below its threshold. Null and empty texts hold no toxic word and stay."""
    model = weak_toxicity.fit(docs, table(spark, sf_dir, "labels"), ~fold(4, 2))
    return weak_toxicity.clean(docs, model)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language the codes, fitted outside fold 1 of 3, are sure of. Null and empty texts and those without a letter go."""
    return lang_ecoc.identified(docs, lang_ecoc.fit(docs, ~fold(3, 1)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of similar texts: the smallest doc_id. Null and empty texts are like nothing and stay."""
    return prefix_join.first_of_each_group(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in which no benchmark item occurs. Null and empty texts hold none and stay."""
    return qgram_decon.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded text of each row, by doc_id. Null and empty texts have no ids."""
    return bpe_transducer.encoded(docs, BYTE_BPE)


STAGES = [("toxicity", toxicity), ("language", language), ("near duplicates", near_duplicates), ("decontamination", decontamination), ("encoding", encoding)]

#: The fitted models and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again before the next; the last one's rows."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
