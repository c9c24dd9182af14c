"""Scorers by name: batches of rows in, class, confidence and evidence out."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "id long, category string, confidence double, evidence string"
Scorer = Callable[[pd.DataFrame], pd.DataFrame]
REGISTRY: dict[str, Callable[..., Scorer]] = {}


def scorer(name: str):
    def add(make: Callable[..., Scorer]) -> Callable[..., Scorer]:
        REGISTRY[name] = make
        return make
    return add


@scorer("nearest_centroid")
def nearest_centroid(labels: list[str], matrix: np.ndarray) -> Scorer:
    """Class of the closest class vector by cosine; the confidence is that cosine."""
    unit = matrix / np.linalg.norm(matrix, axis=1, keepdims=True)

    def score(rows: pd.DataFrame) -> pd.DataFrame:
        v = np.stack(rows["vector"].to_numpy()).astype("float64")
        sims = (v / np.linalg.norm(v, axis=1, keepdims=True)) @ unit.T
        best = np.round(sims, 9).argmax(axis=1)
        return pd.DataFrame({"id": rows["id"], "category": [labels[b] for b in best],
                             "confidence": sims[np.arange(len(best)), best], "evidence": "cosine"})
    return score


def run_scorer(rows: DataFrame, name: str, default: str = "Normal", **settings) -> DataFrame:
    """Scores ``id, vector`` rows in Arrow batches.

    A batch that fails is tried row by row, and a row that fails becomes a row
    with the default class and the error text, so no row is lost.
    """
    make = REGISTRY[name]
    held = rows.sparkSession.sparkContext.broadcast(settings)  # one copy per executor, not one per task

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = make(**held.value)  # once per task
        for batch in batches:
            try:
                yield score(batch)
            except Exception:
                out = []
                for i in range(len(batch)):
                    row = batch.iloc[i:i + 1].reset_index(drop=True)
                    try:
                        out.append(score(row))
                    except Exception as exc:
                        out.append(pd.DataFrame({"id": row["id"], "category": [default], "confidence": [0.0],
                                                 "evidence": [f"error: {exc}"]}))
                yield pd.concat(out) if out else batch.iloc[0:0].reindex(columns=["id", "category", "confidence", "evidence"])
    return rows.select("id", F.col("vector")).mapInPandas(apply, SCHEMA)
