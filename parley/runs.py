"""Runs and stored answers: each question's way from plan to answer, as rows.

A run is a small control row; changes go through the store's keyed rewrite. Numbers
about unrecorded content wait for a confirmation, as they judge rows; a run that ran
out of budget is resumed and judges only what is left.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.engine import Engine
from parley.plans.answer import Answer
from parley.plans.compiler import QuerySpec
from parley.sources.remote import BudgetExceeded, ProviderUnavailable

RUN = "id string, question string, spec string, status string, rows long, seconds double, note string, created_at string, updated_at string"
GROUP = "struct<group_key:string,label:string,count:long,total:double,value:double,share:double,value_label:string,terms:array<string>>"
ANSWER = (
    f"id string, run_id string, question string, path string, denominator long, excluded_count long, groups array<{GROUP}>, standouts array<struct<kind:string,group_key:string,lift:double,count:long>>, "
    "evidence array<struct<group_key:string,id:string,quote:string,place:int>>, headline string, interpretation string, suggestions array<string>, dropped array<string>, is_overview boolean"
)
#: What may follow each status.
NEXT = {
    "awaiting_confirmation": ("queued", "failed"), "queued": ("evaluating", "aggregating", "failed"), "evaluating": ("aggregating", "paused_budget", "paused_provider", "failed"),
    "aggregating": ("synthesizing", "failed"), "synthesizing": ("complete", "failed"), "paused_budget": ("queued", "failed"), "paused_provider": ("queued", "failed"), "complete": (), "failed": (),
}


class Runs:
    """``listener`` is told of each change of a run: its row, with the number of rows judged so far."""

    def __init__(self, engine: Engine, listener: Callable[[dict], None] | None = None):
        if engine.store is None:
            raise ValueError("runs need a store")
        self.engine, self.store, self.spark = engine, engine.store, engine.spark
        self.listener = listener
        self._specs: dict[str, tuple[QuerySpec, list[str]]] = {}

    def create(self, question: str, parent: QuerySpec | None = None) -> str:
        spec, dropped = self.engine.plan(question, parent)
        cost = self.engine.estimate(spec)
        now, id_ = datetime.now(UTC).isoformat(), uuid.uuid4().hex
        status = "awaiting_confirmation" if spec.path == "layer3_aspect" else "queued"
        row = (id_, question, json.dumps(spec.to_dict()), status, cost["rows"], cost["seconds"], "", now, now)
        self.store.append("runs", self.spark.createDataFrame([row], RUN))
        self._specs[id_] = spec, dropped
        return id_

    def get(self, id_: str) -> dict:
        row = self.store.table("runs").where(F.col("id") == id_).first()
        if row is None:
            raise KeyError(id_)
        return row.asDict()

    def _move(self, id_: str, status: str, note: str = "") -> None:
        now = self.get(id_)["status"]
        if status not in NEXT[now]:
            raise ValueError(f"a run that is {now} cannot become {status}")
        self._set(id_, status, note)

    def _set(self, id_: str, status: str, note: str = "") -> None:
        self.store.update("runs", "id", id_, status=status, note=note, updated_at=datetime.now(UTC).isoformat())
        if self.listener:
            self.listener(self.progress(id_))

    def progress(self, id_: str) -> dict:
        """A run's row and the number of its rows that are judged."""
        row = self.get(id_)
        question = json.loads(row["spec"]).get("aspect_question")
        asked = self._specs[id_][0].aspect_question if id_ in self._specs else question
        known = self.engine.aspects.catalogue().where(F.col("question") == asked).first() if asked else None
        return row | {"done": self.engine.aspects.of(known.id).count() if known else 0}

    def events(self, id_: str, every: float = 0.2) -> Iterator[dict]:
        """The run's progress whenever it has changed, until it is over or waits for someone."""
        last = None
        while True:
            now = self.progress(id_)
            if now != last:
                yield now
            if now["status"] in ("complete", "failed", "paused_budget", "paused_provider", "awaiting_confirmation"):
                return
            last = now
            time.sleep(every)

    def confirm(self, id_: str, question: str | None = None) -> None:
        """Lets a waiting run start, perhaps with its row question reworded."""
        if question:
            self._specs[id_][0].aspect_question = question
        self._move(id_, "queued")

    def resume(self, id_: str) -> Answer:
        if self.get(id_)["status"].startswith("paused"):
            self._move(id_, "queued")
        return self.execute(id_)

    def execute(self, id_: str) -> Answer:
        """Runs a queued run to its stored answer; errors leave it failed, a spent budget or a provider that is down paused."""
        spec, dropped = self._specs[id_] if id_ in self._specs else self.engine.plan(self.get(id_)["question"])
        try:
            if spec.path == "layer3_aspect":
                self._move(id_, "evaluating")
                self.engine.evaluate(spec)
            self._move(id_, "aggregating")
            answer = self.engine.run(spec, dropped)
            self._move(id_, "synthesizing")
            self.save(id_, answer)
            self._move(id_, "complete")
            return answer
        except BudgetExceeded as e:
            self._set(id_, "paused_budget", str(e)[:200])
            raise
        except ProviderUnavailable as e:
            self._set(id_, "paused_provider", str(e)[:200])
            raise
        except Exception as e:
            self._set(id_, "failed", str(e)[:200])
            raise

    def save(self, run_id: str, a: Answer) -> DataFrame:
        """One nested row per answer."""
        groups = [(g["group_key"], g["label"], g["count"], g["total"], g["value"], g["share"], g["value_label"], g.get("terms") or []) for g in a.groups]
        standouts = [(s["kind"], s["group_key"], s["lift"], s["count"]) for s in a.standouts]
        evidence = [(e["group_key"], e["id"], e["quote"], e["place"]) for e in a.evidence]
        row = (uuid.uuid4().hex, run_id, a.spec.question, a.spec.path, a.denominator, a.excluded, groups, standouts, evidence, a.headline, a.interpretation, a.suggestions, a.dropped, a.spec.broad)
        return self.store.append("answers", self.spark.createDataFrame([row], ANSWER))

    def answer(self, run_id: str) -> dict:
        row = self.store.table("answers").where(F.col("run_id") == run_id).first()
        if row is None:
            raise KeyError(run_id)
        return row.asDict(recursive=True)
