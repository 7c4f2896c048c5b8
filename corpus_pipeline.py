"""Cleaning of a document table in stages, each written as Parquet and read again as the next one's documents."""

import uuid

from faultframe.llm import decontamination, jaccard, language, packing, pii
from faultframe.session import shared_folder


def language_id(spark, docs, sf_dir):
    """Documents in a recognised language, by a model of a sample of their labels; those without letters go."""
    return language.recognised(docs, language.fit(docs))


def near_duplicates(spark, docs, sf_dir):
    """One document, that of the lowest id, of each group linked by a shingle likeness of 0.8 or more."""
    return jaccard.one_of_each(docs)


def decontaminated(spark, docs, sf_dir):
    """Documents without a passage of a benchmark item."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sanitised(spark, docs, sf_dir):
    """All documents, with personal data and the terms that disclose it generalised."""
    return pii.sanitise(docs)


def packed(spark, docs, sf_dir):
    """The place of each piece of a document in the training sequences."""
    return packing.pack(docs)[1]


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontaminated", decontaminated),
    ("sanitised", sanitised),
    ("packed", packed),
]

# Language models, token ids and disclosure statistics have no SQL form; the stages are tested by brute force.
ORACLE_SQL = None


def run(spark, sf_dir, folder=None):
    """The last stage's rows over the whole `documents` table; each stage's rows stay in `folder`, by its name."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = folder or f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
