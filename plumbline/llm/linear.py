"""Small dense learners, over samples in memory or all rows of a table, and labelled rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import need
from plumbline.plans.workers import ship

ship(__name__)


def fold(doc_id: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; 0 where there is no id."""
    text = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % folds


def labelled(labels: DataFrame, label: str, keep: Column) -> DataFrame:
    """(doc_id, label column) of the rows to learn from, which ``keep`` names; only 0 and 1 count."""
    return need(labels, "doc_id", label).where(keep & F.col(label).isin(0, 1)).distinct()


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, keep: Column,
                    rows: int) -> DataFrame:
    """(text, label) of at most ``rows`` labelled documents, those of smallest id hash.

    Labels other than 0 and 1 are left out; ``keep`` names the rows to learn from.
    """
    marks = labelled(labels, label, keep)
    chosen = (marks.withColumn("_h", F.xxhash64("doc_id", label)).orderBy("_h", "doc_id", label)
              .limit(rows).drop("_h"))
    return need(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id").select(
        "doc_id", "text", F.col(label).cast("int").alias("label"))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def newton(x: np.ndarray, y: np.ndarray | None, ridge: float = 1.0, steps: int = 25) -> np.ndarray:
    """Weights of logistic loss; without ``y`` all rows are wins (preference pairs)."""
    y = np.ones(len(x)) if y is None else y
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = sigmoid(x @ w)
        slope = x.T @ (p - y) + ridge * w
        bend = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(bend, slope)
        w -= step
        if np.abs(step).max() < 1e-7:
            break
    return w


PARTS = 64  # partial sums of one pass that reach the driver


def sums_over(df: DataFrame, fn: Callable[[pa.RecordBatch], list[np.ndarray]]) -> list[np.ndarray] | None:
    """Sums over all batches of ``df`` of the arrays that ``fn`` makes; None without rows.

    Tasks add up what they read, so the driver gets at most ``PARTS`` rows of sums.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                got = fn(b)
                total = got if total is None else [t + g for t, g in zip(total, got, strict=True)]
        if total is not None:
            yield pa.RecordBatch.from_pydict({
                "shape": [[list(t.shape) for t in total]], "cells": [[t.ravel().tolist() for t in total]]})

    rows = df.coalesce(PARTS).mapInArrow(run, "shape array<array<bigint>>, cells array<array<double>>").collect()
    if not rows:
        return None
    return [sum(np.array(r["cells"][i]) for r in rows).reshape(shape) for i, shape in enumerate(rows[0]["shape"])]


def newton_over(df: DataFrame, design: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]], width: int,
                ridge: float = 1.0, steps: int = 25) -> np.ndarray:
    """``newton`` over all rows of a stored table, a pass per step; ``design`` makes (x, y) of a batch."""
    w = np.zeros(width)
    for _ in range(steps):
        def parts(b: pa.RecordBatch, w: np.ndarray = w) -> list[np.ndarray]:
            x, y = design(b)
            p = sigmoid(x @ w)
            return [x.T @ (p - y), (x * (p * (1 - p))[:, None]).T @ x]

        slope, bend = sums_over(df, parts)
        step = np.linalg.solve(bend + ridge * np.eye(width), slope + ridge * w)
        w = w - step
        if np.abs(step).max() < 1e-7:
            break
    return w
