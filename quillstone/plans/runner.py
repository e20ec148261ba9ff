"""Stages in order with a trace: skipped, optional, failing and halting ones."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


@dataclass
class Stage:
    id: str
    label: str
    run: Callable[[dict], Any]
    optional: bool = False
    when: Callable[[dict], bool] | None = None


@dataclass
class StageFailure(Exception):
    stage: str
    cause: Exception
    trace: list = field(default_factory=list)

    def __str__(self) -> str:
        return f"{self.stage}: {self.cause}"


def run_pipeline(stages: list[Stage], ctx: dict, on_stage: Callable[[dict], None] | None = None, observe: bool = False) -> dict:
    """Runs the stages on ``ctx``; what a stage returns as a dict is merged in. ctx["trace"] has id, label, status, ms, detail.

    With ``observe`` each frame that a stage returns counts its rows as it is read by whatever reads it first, without a job of its
    own; stage_figures has the counts.

    A stage whose ``when`` is false is skipped, an optional one that raises is passed over (failed-skipped), a required one ends the
    run with StageFailure, which has the trace. After a stage that sets ctx["halt"] no other runs.
    """
    trace = ctx.setdefault("trace", [])

    def note(stage: Stage, status: str, began: float | None, detail=None):
        entry = {"id": stage.id, "label": stage.label, "status": status, "ms": None if began is None else (time.perf_counter() - began) * 1000, "detail": detail}
        trace.append(entry)
        if on_stage:
            on_stage(entry)

    for stage in stages:
        if stage.when and not stage.when(ctx):
            note(stage, "skipped", None)
            continue
        began = time.perf_counter()
        try:
            got = stage.run(ctx)
        except Exception as e:
            note(stage, "failed-skipped" if stage.optional else "failed", began, str(e))
            if stage.optional:
                continue
            raise StageFailure(stage.id, e, trace) from e
        got = dict(got) if isinstance(got, dict) else {}
        seen = {}
        for key, value in got.items() if observe else ():
            if isinstance(value, DataFrame):
                seen[key] = Observation(f"{stage.id}.{key}")
                got[key] = value.observe(seen[key], F.count(F.lit(1)).alias("rows"))
        ctx.update(got)
        note(stage, "ok", began, ctx.pop("detail", None))
        trace[-1]["observed"] = seen
        if ctx.get("halt"):
            break
    return ctx


def timings(trace: list[dict]) -> dict[str, float]:
    """Milliseconds by stage, of those that ran."""
    return {t["id"]: t["ms"] for t in trace if t["ms"] is not None}


def stage_figures(trace: list[dict], wait_seconds: float = 5.0) -> dict[str, dict]:
    """By stage: label, status, ms, and rows: a count for each observed frame, None for one that nothing has read to the end.

    Counts are told shortly after the job that made them; they are waited for so long at most, all together.
    """
    until = time.monotonic() + wait_seconds
    told = lambda x: x._jo.future().isCompleted()

    def rows(x):
        while not told(x) and time.monotonic() < until:
            time.sleep(0.02)
        return int(x.get["rows"]) if told(x) else None

    return {t["id"]: {"label": t["label"], "status": t["status"], "ms": t["ms"], "rows": {k: rows(x) for k, x in t.get("observed", {}).items()}} for t in trace}


def figures_frame(spark: SparkSession, trace: list[dict]) -> DataFrame:
    """The figures as rows: place, stage, label, status, ms, frame, rows; a stage without observed frames has one row."""
    out = []
    for k, (name, x) in enumerate(stage_figures(trace).items()):
        for frame, n in x["rows"].items() or [(None, None)]:
            out.append((k, name, x["label"], x["status"], x["ms"], frame, n))
    return spark.createDataFrame(out, "place int, stage string, label string, status string, ms double, frame string, rows long")
