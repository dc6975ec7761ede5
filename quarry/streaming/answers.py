"""Answers as they are written: events of many answers, put in order by state that lives across batches."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quarry.operators.retrieval import SUFFICIENT

#: What happens to an answer: its hits (citation map, best score), a token, its end, a failure. seq is its place in the answer, from 0.
INPUT = "answer_id long, seq long, kind string, data string, score double, ts timestamp"
EVENTS = "answer_id long, place long, type string, data string"
STATE = "answers string"
#: Answers are dealt to so many groups by a hash of their ids, each with one state: calls of Python grow with the groups and batches, not
#: with the answers. A checkpoint holds the groups' states, so the number stays as it is.
GROUPS = 1024
# What is said without hits, and the caveat of hits of low scores.
NOTHING, LOW = "I couldn't find any relevant information in the CAG reports to answer this question.", "low_relevance"


def events_of(kind: str, data: str | None, score: float | None) -> tuple[list[tuple[str, str | None]], bool]:
    """Events that one thing makes, and whether the answer ends with them."""
    if kind == "hits":
        if not data:
            return [("token", NOTHING), ("done", None)], True
        low = [("caveat", LOW)] if score is None or score < SUFFICIENT else []
        return [*low, ("citation_map", data)], False
    if kind == "end":
        return [("done", None)], True
    if kind == "fail":
        return [("error", data)], True
    return [("token", data)], False


def _follow(patience_ms: int):
    def follow(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentWatermarkMs()
        # of each answer: next seq, next place, closed, last time, when it is over, and what waits
        known = {a: (*told, {s: tuple(x) for s, *x in waiting}) for a, *told, waiting in (json.loads(state.get[0]) if state.exists else [])}
        out: list[tuple[int, int, str, str | None]] = []
        heard: dict[int, list[tuple]] = {}
        for frame in frames:
            for row in zip(*(frame[c].tolist() for c in ("answer_id", "seq", "at", "kind", "data", "score")), strict=True):
                heard.setdefault(row[0], []).append(row[1:])
        for a, rows in heard.items():
            after, place, closed, last, _, waiting = known.get(a, (0, 0, False, 0, 0, {}))
            for seq, at, kind, data, score in rows:
                last = max(last, at)
                if seq >= after and not closed:
                    waiting.setdefault(seq, (kind, None if pd.isna(data) else data, None if pd.isna(score) else float(score)))
            while not closed and after in waiting:
                made, closed = events_of(*waiting.pop(after))
                out += ((a, place + i, kind, data) for i, (kind, data) in enumerate(made))
                after, place = after + 1, place + len(made)
            known[a] = (after, place, closed, last, max(last + patience_ms, now + 1), {} if closed else waiting)
        for a in [a for a, told in known.items() if a not in heard and told[4] < now]:
            _, place, closed, *_ = known.pop(a)
            if not closed:
                out.append((a, place, "error", "timeout"))
        if known:
            state.update((json.dumps([(a, *told, [(s, *x) for s, x in sorted(waiting.items())]) for a, (*told, waiting) in known.items()]),))
            state.setTimeoutTimestamp(max(now, min(told[4] for told in known.values())))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["answer_id", "place", "type", "data"]).astype({"answer_id": "int64", "place": "int64", "type": object, "data": object})

    return follow


def answer_events(arrivals: DataFrame, late: str = "1 minute", patience_ms: int = 180_000) -> DataFrame:
    """Events of answers in their order from a stream of INPUT rows, in whatever order and batches these come.

    First comes a caveat if hits have low scores, then the citation map, tokens, and done or error; without hits a token says
    so and the answer is done. Things that come too early wait in the answer's state; those after its end, and repeats, count for
    nothing. An answer that hears nothing for the patience, by event time, ends with the error "timeout". State goes after
    the same time. The answers of a group, of which there are GROUPS, are followed in one call a batch.
    """
    rows = arrivals.where(F.col("answer_id").isNotNull() & F.col("seq").isNotNull() & F.col("ts").isNotNull()).withWatermark("ts", late)
    rows = rows.withColumns({"at": F.unix_millis("ts"), "part": F.pmod(F.xxhash64("answer_id"), F.lit(GROUPS))})
    return rows.groupBy("part").applyInPandasWithState(_follow(patience_ms), EVENTS, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def frame_of(kind: Column, data: Column) -> Column:
    """An event as a frame of a server-sent stream."""
    return F.concat(F.lit("data: "), F.to_json(F.struct(kind.alias("type"), data.alias("data")), {"ignoreNullFields": "false"}), F.lit("\n\n"))


def stream_answers(spark: SparkSession, source: str, target: str, checkpoint: str, files_a_batch: int = 1) -> None:
    """Events of all things in the source's files appended to the target, batch by batch; all files there are, then done."""
    arrivals = spark.readStream.schema(INPUT).option("maxFilesPerTrigger", files_a_batch).parquet(source)
    answer_events(arrivals).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
