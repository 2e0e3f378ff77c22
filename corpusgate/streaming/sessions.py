"""Verification sessions as a stateful stream.

Reports arrive with a session, the reporter's id and a status. A session ends as soon as all
expected ids have succeeded, one has failed, an unknown or repeated id reports, or the timeout
after its first report has run out; later reports change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OUTCOME = "session string, outcome string, reporter string, reports long"
STATE = "seen array<string>, reports long, closed boolean, began long"


def advance(seen: list[str], expected: list[str], reporter: str, status: str) -> str | None:
    """The outcome that a report brings about, if any: failed, unknown, duplicate or complete."""
    if reporter not in expected:
        return "unknown"
    if reporter in seen:
        return "duplicate"
    if status != "success":
        return "failed"
    seen.append(reporter)
    return "complete" if len(seen) == len(expected) else None


def session_outcomes(reports: DataFrame, expected: list[str], timeout_ms: int = 15_000) -> DataFrame:
    """``session, outcome, reporter, reports`` of a stream of ``session, reporter, status, at``.

    One row when a session ends. Reports of one micro-batch are taken in the order of ``at``, then
    reporter. The timer runs in processing time from the first report.
    """
    wanted = sorted(set(expected))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in OUTCOME.split(", ")]
        if state.hasTimedOut:
            _, reports_, closed, _ = state.get
            state.remove()
            if not closed:
                yield pd.DataFrame([(key[0], "timeout", None, reports_)], columns=columns)
            return
        now = state.getCurrentProcessingTimeMs()
        seen, reports_, closed, began = state.get if state.exists else ([], 0, False, now)
        seen, ended = list(seen), None
        rows = pd.concat(list(batches)).sort_values(["at", "reporter"])
        for reporter, status in zip(rows["reporter"], rows["status"]):
            if closed:
                break
            reports_ += 1
            outcome = advance(seen, wanted, reporter, status)
            if outcome:
                closed, ended = True, (key[0], outcome, reporter, reports_)
        state.update((seen, reports_, closed, began))
        # Every call clears the timer, so it is set again for what is left of it.
        state.setTimeoutDuration(max(1, began + timeout_ms - now))
        if ended:
            yield pd.DataFrame([ended], columns=columns)

    return reports.groupBy("session").applyInPandasWithState(step, OUTCOME, STATE, "append", "ProcessingTimeTimeout")


def finished_sessions(reports: DataFrame, expected: list[str]) -> DataFrame:
    """The same outcomes of a finished batch of reports, open sessions included as ``open``, without a timer.

    A session's deciding report is its first bad one, or the one that completes it; reports of one
    id at one time are one, bad if one of them is. Of each id only the two earliest are looked at,
    which each task picks before the shuffle, so a session with most reports is no single task.
    """
    wanted = F.col("reporter").isin(*expected)
    good = wanted & F.coalesce(F.col("status") == "success", F.lit(False))
    order = F.struct("at", "reporter")
    once = reports.groupBy("session", "reporter", "at").agg(F.bool_and(good).alias("ok"))
    of_id = Window.partitionBy("session", "reporter").orderBy("at")
    early = once.withColumn("__i", F.row_number().over(of_id)).where("__i <= 2")
    first = F.col("__i") == 1
    done = early.groupBy("session").agg(
        F.min(F.when(~first, order)).alias("again"), F.count_if(first & wanted & F.col("ok")).alias("good"), F.max(F.when(first & wanted & F.col("ok"), order)).alias("last")
    )
    sessions = once.groupBy("session").agg(F.min(F.when(~F.col("ok"), order)).alias("bad"))
    joined = sessions.join(done, "session")
    complete = F.when(F.col("good") == len(set(expected)), F.col("last"))
    deciding = F.least("bad", "again", complete)
    kind = (
        F.when(deciding.isNull(), "open").when(deciding == F.col("bad"), F.when(F.col("bad.reporter").isin(*expected), "failed").otherwise("unknown"))
        .when(deciding == F.col("again"), "duplicate").otherwise("complete")
    )
    return joined.select("session", kind.alias("outcome"), deciding["reporter"].alias("reporter"))
