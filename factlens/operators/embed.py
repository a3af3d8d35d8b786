"""Embedding units by a user's model function, batch by batch, with a status for each row."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .units import embedding_inputs
from .windows import cap_per_key


def targets(units: DataFrame, per_document: int | None = None) -> DataFrame:
    """Units with a title or content; the first ones of each document, if so many are asked for."""
    some = units.where((F.coalesce(F.trim("content"), F.lit("")) != "") | (F.coalesce(F.trim("title"), F.lit("")) != ""))
    return cap_per_key(some, ["document_id"], ["unit_id"], per_document) if per_document else some


def run(units: DataFrame, load_model: Callable[[], Callable[[list[str]], list[list[float]]]] | None, batch: int = 32, per_document: int | None = None, max_chars: int | None = None) -> DataFrame:
    """(unit_id, embedding, embedding_status, embedding_error). The model is loaded once a task; a batch that fails marks its own rows
    failed; without a model all rows are unavailable."""
    rows = embedding_inputs(targets(units, per_document), max_chars).select("unit_id", "input_text")
    kind = rows.schema["unit_id"].dataType.simpleString()

    def job(batches):
        model, reason = None, "no model"
        try:
            model = load_model() if load_model else None
        except Exception as e:  # noqa: BLE001  a model that can't be loaded is a status, not a crash
            reason = f"{type(e).__name__}: {e}"
        for pdf in batches:
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                n = len(part)
                if model is None:
                    vectors, status, error = [None] * n, ["unavailable"] * n, [reason] * n
                else:
                    try:
                        vectors, status, error = list(model(part.input_text.tolist())), ["embedded"] * n, [None] * n
                        if len(vectors) != n:
                            raise ValueError(f"{len(vectors)} vectors for {n} texts")
                    except Exception as e:  # noqa: BLE001
                        vectors, status, error = [None] * n, ["failed"] * n, [f"{type(e).__name__}: {e}"] * n
                yield pd.DataFrame({"unit_id": part.unit_id.to_numpy(), "embedding": vectors, "embedding_status": status, "embedding_error": error}, dtype=object)

    return rows.mapInPandas(job, f"unit_id {kind}, embedding array<float>, embedding_status string, embedding_error string")


def attach(units: DataFrame, embedded: DataFrame) -> DataFrame:
    """Units with their latest embedding; units that were no target have status none."""
    base = units.drop("embedding", "embedding_status", "embedding_error")
    return base.join(embedded, "unit_id", "left").withColumn("embedding_status", F.coalesce("embedding_status", F.lit("none")))
