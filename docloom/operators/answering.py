"""Interfaces for models, and the deterministic part of answering a question.

A model is made once per worker by a factory and sees one Arrow batch of rows at a time; a row on which it fails
becomes a row that says so, not a failed job.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.operators import citations, retrieval

MENTIONS = "chunk_id string, doc_id string, start int, end int, surface string, type string, note string"


def tag(chunks: DataFrame, make_tagger: Callable[[], Callable[[str], list[tuple[str, str]]]]) -> DataFrame:
    """chunks(chunk_id, doc_id, text) to mentions: the tagger gives (surface, type) pairs, their places are found here."""

    def run(batches):
        tagger = make_tagger()
        for b in batches:
            out = []
            for chunk, doc, text in zip(b["chunk_id"], b["doc_id"], b["text"]):
                try:
                    found = tagger(text)
                except Exception as e:  # one bad chunk must not end the job
                    out.append((chunk, str(doc), -1, -1, None, None, f"failed: {type(e).__name__}"))
                    continue
                for (surface, kind), at in zip(found, retrieval.locate(text, [s for s, _ in found])):
                    out.append((chunk, str(doc), at, at + len(surface) if at >= 0 else -1, surface, kind, None if at >= 0 else "unlocated"))
            yield pd.DataFrame(out, columns=["chunk_id", "doc_id", "start", "end", "surface", "type", "note"])

    return chunks.select(F.col("chunk_id").cast("string"), "doc_id", "text").mapInPandas(run, MENTIONS)


def embed(rows: DataFrame, make_model: Callable[[], Callable[[list[str]], list[list[float]]]], prefix: str = "") -> DataFrame:
    """rows(id, text) with a vector `v` of unit length from the model."""

    def run(batches):
        model = make_model()
        for b in batches:
            vectors = model([prefix + t for t in b["text"]])
            norms = [sum(x * x for x in v) ** 0.5 or 1.0 for v in vectors]
            yield b.assign(v=[[x / n for x in v] for v, n in zip(vectors, norms)])[["id", "text", "v"]]

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", "text").mapInPandas(run, f"id {kind}, text string, v array<float>")


def graph_context(question: str, names: DataFrame, store: DataFrame) -> str:
    """What the graph says on a question, with its sources: the connection of its first two entities, the surroundings of a
    single one, or nothing. names(name, entity_id); the store is that of citations.evidence_store."""
    asked = store.sparkSession.createDataFrame([(0, question)], "question_id int, text string")
    return citations.question_contexts(asked, names, store).first().text


def answer(question: str, hits: DataFrame, ask: Callable[[str], str], names: DataFrame | None = None, store: DataFrame | None = None) -> dict:
    """hits(rank, text, page_start, page_end), with the graph's part if there is one, put to a language model."""
    context = retrieval.context(hits).first().context or ""
    told = graph_context(question, names, store) if store is not None else ""
    parts = [p for p in (told, context) if p]
    return {"question": question, "context": "\n\n".join(parts), "answer": ask("\n\n".join([*parts, question])), "graph": told}
