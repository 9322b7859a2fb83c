"""Documents -> facts -> retrieval index, as one lazy plan each."""

from __future__ import annotations

from pyspark.sql import DataFrame

from factloom.operators.facts import extract_facts
from factloom.operators.records import embed_text, retrieval_records
from factloom.schemas import FACTS
from factloom.sources.store import append_facts, by_heading, pending_documents, reset_facts, shared_folder, stored_rows


def build_facts(documents: DataFrame, path: str) -> None:
    """Add the facts of documents that have none yet to the folder ``path``."""
    documents = pending_documents(documents, stored_rows(documents.sparkSession, path, FACTS))
    draft = shared_folder(documents.sparkSession)
    reset_facts(extract_facts(documents), draft)
    append_facts(documents.sparkSession.read.schema(FACTS).parquet(draft), path)


def build_index(facts: DataFrame, **embedding) -> DataFrame:
    """Index rows (id, heading, document, metadata, embedding) of all facts.

    The texts are put in order before they are embedded, so that no embedding
    is shuffled and none is computed for the sampling of the ranges.
    """
    return embed_text(by_heading(retrieval_records(facts)), **embedding)
