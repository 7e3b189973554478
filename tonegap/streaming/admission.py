"""The gate over arriving posts: the earliest row of an id decides, however rows arrive.

Content verdicts are a plain projection. Those that settle an id go into keyed state, one row per id: the earliest seen
so far, by event time and then by order. Once the watermark has passed its time no earlier one can come, a timer fires and
the id is decided: accepted rows leave, and a mark without text stays behind and blocks later rows. Marks can be given
an age at which they go, which bounds the state by the ids of that stretch. Rows without an id settle nothing; as
heartbeats they move time when no posts come. Rows behind the watermark are dropped, as in any stream.

Without event times what comes in an earlier micro-batch is earlier, and order decides inside one.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tonegap.operators.gates import ACCEPTED, GateRules, blocking_reasons, verdicts
from tonegap.operators.keyed import anti_seen

#: A post's phase: waiting for the watermark, or decided.
PENDING, SETTLED = 0, 1
STATE = "phase int, at long, ord long, reason string, caption string"
Pending = tuple[int, int, int, str | None, str | None]


def _earliest(best: Pending | None, rows: Iterator[pd.DataFrame], after: int | None = None) -> Pending | None:
    """The first of what was known and of what came (after a time), by time and order."""
    for part in rows:
        for at, order, reason, caption in zip(part["_at"], part["_ord"], part["reason"], part["caption"]):
            if (after is None or at > after) and (best is None or (at, order) < best[1:3]):
                best = (PENDING, int(at), int(order), reason, caption if reason == ACCEPTED else None)
    return best


def _row(key: str, best: Pending) -> Iterator[pd.DataFrame]:
    if best[3] == ACCEPTED:
        yield pd.DataFrame({"post_id": [key], "ord": [best[2]], "at": [best[1]], "caption": [best[4]]})


def _by_time(remember_ms: int | None):
    def decide(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best: Pending | None = tuple(state.get) if state.exists else None

        def mark(settled: Pending) -> None:
            state.update((SETTLED, settled[1], settled[2], None, None))
            if remember_ms is not None:
                state.setTimeoutTimestamp(max(settled[1] // 1000 + remember_ms, state.getCurrentWatermarkMs() + 1))

        if state.hasTimedOut:
            if best[0] == SETTLED:
                state.remove()
            else:
                mark(best)
                yield from _row(key[0], best)
            return
        if key[0] is None:
            for _ in rows:
                pass
            return
        settled = best if best is not None and best[0] == SETTLED else None
        if settled is None:
            best = _earliest(best, rows)
        else:  # only what comes after its age is news
            end = 2**63 - 1 if remember_ms is None else settled[1] + 1000 * remember_ms
            best = _earliest(None, rows, end)
        if best is not None:
            state.update(best)
            state.setTimeoutTimestamp(max(best[1] // 1000, state.getCurrentWatermarkMs() + 1))
        elif settled is not None:
            mark(settled)

    return decide


def _by_arrival(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    best = _earliest(None, rows)
    if key[0] is not None and best is not None and not state.exists:
        state.update((SETTLED, best[1], best[2], None, None))
        yield from _row(key[0], best)


def stream_ingest(
    posts: DataFrame,
    rules: GateRules,
    seen: DataFrame,
    *,
    event_time: str | None = None,
    lateness: str = "1 day",
    remember_ms: int | None = None,
    ord_col: str = "ord",
    media_ok: Column | None = None,
    face_ok: Column | None = None,
) -> DataFrame:
    """(post_id, ord, at, caption) of the accepted posts of a stream, each id once, by the rules of the batch gate.

    ``at`` is the event time in microseconds (0 without one). With ``event_time``, rows may come ``lateness`` out of order, and
    what an id's earliest settling row says holds, also against rows of one micro-batch; ids leave when the watermark
    has passed them. ``remember_ms`` is how long after its time an id keeps blocking; None for ever.
    """
    timed = posts if event_time is None else posts.withWatermark(event_time, lateness)
    known = seen.select(F.col("post_id").cast("string").alias("post_id"))
    fresh = anti_seen(timed.withColumn("post_id", F.col("post_id").cast("string")), known)
    judged = verdicts(fresh, rules, media_ok=media_ok, face_ok=face_ok)
    settling = judged.filter(F.col("reason").isin(*blocking_reasons(rules)) | F.col("post_id").isNull())
    at = F.lit(0).cast("long") if event_time is None else F.unix_micros(event_time)
    rows = settling.select(
        "post_id",
        at.alias("_at"),
        F.col(ord_col).cast("long").alias("_ord"),
        "reason",
        F.when(F.col("reason") == ACCEPTED, F.col("caption")).alias("caption"),
        *([] if event_time is None else [event_time]),
    )
    decide = _by_arrival if event_time is None else _by_time(remember_ms)
    timeout = GroupStateTimeout.NoTimeout if event_time is None else GroupStateTimeout.EventTimeTimeout
    return rows.groupBy("post_id").applyInPandasWithState(
        decide, "post_id string, ord long, at long, caption string", STATE, "append", timeout
    )
