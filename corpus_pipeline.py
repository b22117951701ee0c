"""Five stages that turn ``documents`` into encoded training text.

Each stage gets all that the one before kept, written as Parquet and read again; all but the last return the
columns of ``documents``.

In every stage null texts count as empty, texts are taken whole, empty tables give empty tables, and columns besides doc_id,
text and n_chars pass through, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftline.llm.common import shared_folder, table
from weftline.llm.lines import dedup_lines
from weftline.llm.pieces import default_model, digest_pieces
from weftline.llm.quality import keep_good
from weftline.llm.simhash import distinct_documents
from weftline.llm.templates import without_leaks


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label scorer accepts. Equal texts fare alike, so repeated rows stay or go together; ids aren't read."""
    return keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without runs of lines, of 50 words or more, that stand earlier in the corpus. No row goes: a text may become empty.
    Null texts stay null, rows without an id stay as they are, and a row twice over is one document."""
    return dedup_lines(docs).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of near copies. Texts without words are copies of each other, a
    repeated row goes, rows without an id stay."""
    return distinct_documents(docs).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of a benchmark item, verbatim or re-parameterised. Rows without an id stay, as do all for an
    empty benchmark; repeated rows stay or go together."""
    return without_leaks(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of every document that is left: their number, and digests of ids, decoded text and spans. A row for each row; an empty
    text has the begin and end ids."""
    return digest_pieces(docs, default_model())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("SentencePiece encoding", encoding),
]

#: Trained scorers, fingerprints and tokens have no SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each stage's result written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return STAGES[-1][1](spark, docs, sf_dir)
