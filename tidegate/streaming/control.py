"""How long a stream runs: until nothing comes any more, or for a time, and always to the end of a batch."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql.streaming import StreamingQuery

# Idle and longest run of a drain, and how long a running batch may still take at its end.
IDLE_SECONDS = 30.0
MAX_SECONDS = 7200.0
GRACE_SECONDS = 600.0
POLL_SECONDS = 0.2


@dataclass
class Drained:
    """``reason`` is idle, time or finished (the query ended by itself)."""

    reason: str = "finished"
    rows: int = 0
    batches: int = 0
    seconds: float = 0.0


def _rows_of(query: StreamingQuery) -> dict[int, int]:
    """Rows of the recent batches; an empty trigger repeats the number of the next batch."""
    return {p["batchId"]: p["numInputRows"] for p in query.recentProgress if p["numInputRows"]}


def stop(query: StreamingQuery, grace: float = GRACE_SECONDS) -> None:
    """Stop when the batch that runs now has ended.

    What a batch has begun by then, or past ``grace``, is broken off; the checkpoint has it done again.
    """
    ends = time.monotonic() + grace
    last = max(_rows_of(query), default=-1)
    while query.isActive and query.status["isTriggerActive"] and max(_rows_of(query), default=-1) == last:
        if time.monotonic() > ends:
            break
        time.sleep(POLL_SECONDS / 10)
    query.stop()


def drain(
    query: StreamingQuery, idle: float = IDLE_SECONDS, longest: float = MAX_SECONDS, grace: float = GRACE_SECONDS,
    poll: float = POLL_SECONDS,
) -> Drained:
    """Let a stream run until it had nothing to do for ``idle`` seconds, or for ``longest``, then stop it.

    A query that fails raises here. What came in is counted batch by batch.
    """
    began = active = time.monotonic()
    seen: dict[int, int] = {}
    out = Drained()
    while not query.awaitTermination(poll):
        now, known = time.monotonic(), len(seen)
        seen |= _rows_of(query)
        status = query.status
        if len(seen) > known or status["isDataAvailable"] or (status["isTriggerActive"] and not seen):
            active = now
        if now - began >= longest:
            out.reason = "time"
            break
        if now - active >= idle:
            out.reason = "idle"
            break
    if out.reason != "finished":
        stop(query, grace)
    seen |= _rows_of(query)
    out.rows, out.batches, out.seconds = sum(seen.values()), len(seen), time.monotonic() - began
    return out
