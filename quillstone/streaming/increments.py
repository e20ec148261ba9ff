"""Incremental operators on Structured Streaming: claims as an answer grows, index appends, a telemetry ring."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..operators.claims import split_claims
from ..operators.lexical import build_lexical_index


def stream_claims(parts: DataFrame, id_col="answer_id", order_col="ord", text_col="text", done_col="done") -> DataFrame:
    """Each claim once, as soon as a later one exists or the answer is done: answer_id, claim_ord, text, cites.

    parts: pieces of growing answers with their order and whether the answer ends. The state is the text so far, the pieces that came
    early, and how many claims are out.
    """

    def run(key, frames, state):
        text, sent, place, early, done = state.get if state.exists else ("", 0, 0, "[]", False)
        import json

        waiting = {int(o): (t, d) for o, t, d in json.loads(early)}
        for pdf in frames:
            for o, t, d in zip(pdf[order_col], pdf[text_col], pdf[done_col], strict=True):
                waiting[int(o)] = (t or "", bool(d))
        while place in waiting:
            t, d = waiting.pop(place)
            text, done, place = text + t, done or d, place + 1
        found = split_claims(text, done)
        ready = len(found) if done else max(0, len(found) - 1)
        out = [(key[0], i, found[i][0], found[i][1]) for i in range(sent, ready)]
        state.update((text, max(sent, ready), place, json.dumps([[o, *v] for o, v in waiting.items()]), done))
        yield pd.DataFrame(out, columns=[id_col, "claim_ord", "text", "cites"])

    kind = dict(parts.dtypes)[id_col]
    return parts.groupBy(id_col).applyInPandasWithState(
        run, f"{id_col} {kind}, claim_ord int, text string, cites array<int>", "text string, sent int, place int, early string, done boolean", "append", GroupStateTimeout.NoTimeout
    )


def append_postings(chunks: DataFrame, path: str, checkpoint: str, key_col="key", ord_col="ord", text_col="text"):
    """A streaming query that appends each batch's postings and lengths; a batch written again replaces itself.

    For documents that are new each time: one that comes again in a later batch counts twice here, and is replaced by
    stored_index.index_stream.
    """

    def write(batch: DataFrame, number: int) -> None:
        index = build_lexical_index(batch, key_col, ord_col, text_col)
        index.postings.write.mode("overwrite").parquet(f"{path}/postings/batch={number}")
        index.lengths.write.mode("overwrite").parquet(f"{path}/lengths/batch={number}")

    return chunks.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def statistics_of(postings: DataFrame, lengths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The document frequencies and the one-row stats of appended postings and lengths."""
    stats = lengths.agg(F.count("*").alias("n"), F.coalesce(F.avg("len"), F.lit(0.0)).alias("avg_len"))
    return postings.groupBy("term").agg(F.count("*").alias("df")), stats


def ring(events: DataFrame, n: int, by: str, id_col="event_id", value_col="value") -> DataFrame:
    """Per group the mean and the count of the n latest values after each batch, as updates."""

    def run(key, frames, state):
        held = list(zip(*state.get, strict=True)) if state.exists else []
        for pdf in frames:
            held += list(zip(pdf[id_col].tolist(), pdf[value_col].tolist(), strict=True))
        held = sorted(set(held))[-n:]
        state.update(([i for i, _ in held], [v for _, v in held]))
        yield pd.DataFrame({by: [key[0]], "kept": [len(held)], "mean": [sum(v for _, v in held) / len(held) if held else None], "latest": [held[-1][0] if held else None]})

    return events.groupBy(by).applyInPandasWithState(
        run, f"{by} string, kept long, mean double, latest long", "ids array<long>, vals array<double>", "update", GroupStateTimeout.NoTimeout
    )
