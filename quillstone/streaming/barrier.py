"""Verdicts that come in any order, held back until all claims of an answer have one."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

STATUSES = ("supported", "contradicted", "uncertain", "unverified")
COUNTS = ", ".join(f"{s} int" for s in STATUSES)


def counted(statuses: list[str], total: int) -> list[int]:
    """How often each status stands; claims without a verdict, and unknown ones, are unverified."""
    known = [statuses.count(s) for s in STATUSES[:-1]]
    return [*known, total - sum(known)]


def verification_barrier(messages: DataFrame, wait_seconds: int = 600, delay: str = "10 minutes", id_col: str = "answer_id", at_col: str = "at") -> DataFrame:
    """One row for each answer, once: the id, a count for each status, total, complete.

    messages: (id, at timestamp, claim_ord, status, total). A verdict has a claim_ord and a status and patches that claim; of several
    for one claim the one with the latest time counts, of equal times the last that came. The end of an answer has a null claim_ord and
    the number of its claims. Both come in any order, and again after a restart. The row leaves when the end and a verdict for every
    claim are there; ``wait_seconds`` of event time after the answer's last message it leaves as it is, with complete false and what
    is missing unverified, and so does an answer without an end (its claims are then those that have a verdict). A claim_ord outside
    the total is passed over. State: a status and a time for each claim, and for the wait after it left a mark that it has.
    """

    def run(key, frames, state):
        total, ords, says, times, left, last = state.get if state.exists else (None, [], [], [], False, 0)
        held = {o: (t, s) for o, s, t in zip(ords, says, times, strict=True)}
        out = []
        leave = lambda whole: out.append((key[0], *counted([s for o, (_, s) in held.items() if o < total], total), total, whole))
        if state.hasTimedOut:
            if not left:
                total = max(held, default=-1) + 1 if total is None else total
                leave(False)
            state.remove()
        else:
            for pdf in frames:
                for at, o, s, n in zip(pdf[at_col], pdf["claim_ord"], pdf["status"], pdf["total"], strict=True):
                    at = at.value
                    last = max(last, at)
                    if pd.isna(o):
                        total = int(n) if not pd.isna(n) else total
                    elif int(o) >= 0 and (int(o) not in held or held[int(o)][0] <= at):
                        held[int(o)] = (at, s)
            if not left and total is not None and all(o in held for o in range(total)):
                leave(True)
                left = True
            kept = [] if left else sorted(held)
            state.update((total, kept, [held[o][1] for o in kept], [held[o][0] for o in kept], left, last))
            state.setTimeoutTimestamp(max(last // 1_000_000 + wait_seconds * 1000, state.getCurrentWatermarkMs() + 1))
        # Spark hands results and states on by the number of result rows: a call without one gives a blank, so that states do not pile up
        yield pd.DataFrame(out or [(key[0], *[None] * (len(STATUSES) + 2))], columns=[id_col, *STATUSES, "total", "complete"])

    kind = dict(messages.dtypes)[id_col]
    timed = messages.select(id_col, at_col, F.col("claim_ord").cast("int").alias("claim_ord"), "status", F.col("total").cast("int").alias("total")).withWatermark(at_col, delay)
    said = timed.groupBy(id_col).applyInPandasWithState(
        run, f"{id_col} {kind}, {COUNTS}, total int, complete boolean", "total int, ords array<int>, says array<string>, times array<long>, left boolean, last long", "append", GroupStateTimeout.EventTimeTimeout
    )
    return said.where("complete IS NOT NULL")


def answer_messages(verdicts: DataFrame, id_col: str, at: Column) -> DataFrame:
    """What a run over (id, claim_ord, status) says: each verdict, and the end of each answer."""
    said = verdicts.select(F.col(id_col).alias("answer_id"), at.alias("at"), "claim_ord", "status", F.lit(None).cast("int").alias("total"))
    ends = verdicts.groupBy(F.col(id_col).alias("answer_id")).agg(F.count("*").cast("int").alias("total"))
    return said.unionByName(ends.select("answer_id", F.lit("2024-01-01 00:00:00").cast("timestamp").alias("at"), F.lit(None).cast("int").alias("claim_ord"), F.lit(None).cast("string").alias("status"), "total"))
