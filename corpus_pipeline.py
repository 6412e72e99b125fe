"""From raw documents to token ids: quality, line dedup, near-dedup, mixing, encoding."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stellara.llm import bpe, lines, mixing, quality, simhash
from stellara.llm.common import free, remove, shared_folder, table


def reject_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the byte-level network scores under the threshold.

    Null, empty and very long texts are scored as any other, equal texts alike; without labels of both kinds a single score decides
    on all. An empty table stays empty. Columns are kept, whatever their names.
    """
    score = free(docs, "quality")
    net = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, net, column=score).where(F.col(score) >= quality.THRESHOLD).drop(score)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop lines whose template recurs across documents from all but the first of them.

    All rows stay: null texts null, texts of which all lines go empty. Rows of one doc_id are one document; a null doc_id
    comes last. Ties don't arise: a row of the least id keeps its lines, and so do its repetitions. Columns are kept, whatever their names.
    """
    return lines.dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group linked by the similarity of five-word shingle sets, met by Golay keys of their SimHash fingerprints.

    Texts without words (null, empty) are one group; the row of the least doc_id stays, nulls last; unlike texts that
    share a doc_id, or have none, are told apart; of rows alike in doc_id and words one stays. Columns are kept, whatever their names.
    """
    return simhash.dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replicate documents by Poisson counts for sources to get their target weights, and shuffle them.

    A source of n rows weighs n ** 0.5; a null source is one of its own. Texts are not looked at; rows that share a doc_id, or have
    none, get equal counts. An empty table stays empty. Columns are kept, whatever their names.
    """
    return mixing.mix(docs)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, as token_ids, in place of texts.

    Null and empty texts have no ids; long ones are encoded whole. A column called token_ids is replaced, others are kept.
    """
    return bpe.encode(docs, *bpe.vocabulary())


STAGES = [
    ("quality", reject_poor),
    ("line_dedup", drop_lines),
    ("simhash_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("byte_bpe", encode_texts),
]

#: A trained network and a transducer have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written as Parquet in the shared folder and read again;
    what a stage has read is deleted once its own rows are written."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(f"{folder}/{k}-{name}")
        if k:
            remove(spark, f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
