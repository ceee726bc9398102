"""Models behind a function: encoders and judges that run where the rows are.

Nothing here opens a connection. A caller passes a picklable function; rows reach it
in Arrow batches, with bounded request sizes, retries and checks of what comes back.
Concurrency is the number of tasks. A judge that may spend no more, or whose provider
is down, ends its task's work without an error: rows it has judged are results, the
others come back marked with the reason, so that a run keeps the former and is resumed.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Seconds before each repeated request.
WAITS = (1.0, 3.0, 8.0)
REQUEST = 64

Encoder = Callable[[list[str]], "list[list[float]]"]
#: texts, question -> (value, confidence, quote) each, with what it cost if that is known, or None for a text that is blocked
Model = Callable[[list[str], str], "list[tuple | None]"]
COMPLETE, BUDGET, PROVIDER = "complete", "paused_budget", "paused_provider"


class BudgetExceeded(RuntimeError):
    """A model raises this when it may spend no more; what it has judged is kept."""


class ProviderUnavailable(RuntimeError):
    """A model's requests failed to the last retry; what it has judged before is kept."""


def ladder(*models: Model) -> Model:
    """A model that asks the first of ``models``, and the next where one fails; a spent budget ends the ladder."""

    def asked(texts: list[str], question: str) -> list:
        for i, model in enumerate(models):
            try:
                got = list(model(texts, question))
                if len(got) != len(texts):
                    raise ValueError(f"{len(got)} results for {len(texts)} texts")
                return got
            except BudgetExceeded:
                raise
            except Exception:
                if i == len(models) - 1:
                    raise
        return []

    return asked


def attempt(call: Callable[[], list], n: int, waits: tuple[float, ...] = WAITS) -> list:
    """The call's n results; a failing or short one is repeated after each wait."""
    for wait in (*waits, None):
        try:
            got = list(call())
            if len(got) != n:
                raise ValueError(f"{len(got)} results for {n} texts")
            return got
        except BudgetExceeded:
            raise
        except Exception:
            if wait is None:
                raise
            time.sleep(wait)
    return []


def encode(docs: DataFrame, encoder: Encoder, waits: tuple[float, ...] = WAITS) -> DataFrame:
    """Rows (id, v): unit vectors of (id, text), asked for ``REQUEST`` texts at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, REQUEST):
                part = batch.slice(at, REQUEST)
                texts = [t or "" for t in part.column(1).to_pylist()]
                v = np.array(attempt(lambda texts=texts: encoder(texts), len(texts), waits), float)
                v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-8)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(v.tolist(), pa.list_(pa.float64()))], names=["id", "v"])

    return docs.select("id", "text").mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, v array<double>")


def judge_by(model: Model, waits: tuple[float, ...] = WAITS) -> Callable[[DataFrame, str], DataFrame]:
    """A judge for stored aspects: rows (id, score, value, confidence, quote, cost, status).

    A quote that is not in its text is dropped; blocked rows give no row. After a stop the
    task's other rows have no value, and the stop as their status.
    """

    def judge(docs: DataFrame, question: str) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            stopped = None
            for batch in batches:
                for at in range(0, batch.num_rows, REQUEST):
                    part = batch.slice(at, REQUEST)
                    texts = [t or "" for t in part.column(1).to_pylist()]
                    got: list = []
                    if stopped is None:
                        try:
                            got = attempt(lambda texts=texts: model(texts, question), len(texts), waits)
                        except BudgetExceeded:
                            stopped = BUDGET
                        except Exception:
                            stopped = PROVIDER
                    keep = [i for i in range(len(texts)) if stopped or got[i] is not None]
                    rows = [(None, None, "", 0.0) if stopped else (*got[i], 0.0)[:4] for i in keep]
                    quotes = [q if q and q in texts[i] else "" for i, (_, _, q, _) in zip(keep, rows)]
                    ids, conf = part.column(0).take(pa.array(keep, pa.int64())), pa.array([None if c is None else float(c) for _, c, _, _ in rows], pa.float64())
                    value, cost = pa.array([None if v is None else bool(v) for v, _, _, _ in rows], pa.bool_()), pa.array([float(c) for *_, c in rows], pa.float64())
                    yield pa.RecordBatch.from_arrays([ids, conf, value, conf, pa.array(quotes, pa.string()), cost, pa.array([stopped or COMPLETE] * len(rows), pa.string())], names=["id", "score", "value", "confidence", "quote", "cost", "status"])

        return docs.select(F.col("id"), "text").mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, score double, value boolean, confidence double, quote string, cost double, status string")

    return judge
