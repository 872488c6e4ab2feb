"""Event folds: receipts per step, run lengths and stop reasons, in batch or from a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: When a loop of steps ends.
MAX_STEPS, MAX_STALLS, MAX_REPEATS = 8, 2, 2
TERMINAL = ("done", "abort", "ask_user")
RECEIPT = "task string, step bigint, n_events bigint, n_redactions bigint, n_errors bigint, latency_ms double, sealed boolean"


def receipts(events: DataFrame, by: str = "task") -> DataFrame:
    """One receipt per task and step: task, step, n_events, n_redactions, n_errors, latency_ms, sealed.

    events: task, seq, step, type, value. A step is sealed once its step/done has come. All are sums,
    so the order of events doesn't count and partial sums combine before they move.
    """
    t = F.col("type")
    return events.groupBy(F.col(by).alias("task"), "step").agg(F.count("*").alias("n_events"), F.count_if(t == "redaction").alias("n_redactions"), F.count_if(t == "error").alias("n_errors"), F.coalesce(F.sum(F.when(t == "latency", F.col("value"))), F.lit(0.0)).alias("latency_ms"), F.bool_or(t == "step/done").alias("sealed"))


def _add(state: dict, events: pd.DataFrame) -> dict:
    for step, type_, value in zip(events["step"], events["type"], events["value"], strict=True):
        r = state.setdefault(int(step), [0, 0, 0, 0.0])
        r[0] += 1
        r[1] += type_ == "redaction"
        r[2] += type_ == "error"
        r[3] += float(value) if type_ == "latency" and value == value else 0.0
    return state


def fold_stream(events: DataFrame, idle: str = "1 hour") -> DataFrame:
    """Receipts of a stream (task, seq, step, type, value): a step's row comes when its step/done does.

    A task's open steps and the numbers of those sealed are its state; events of a sealed step that come in a later batch are dropped. When a task is idle, its open steps come unsealed and its state goes.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = dict(zip(state.get[0], ([a, b, c, d] for a, b, c, d in zip(*state.get[1:5], strict=True)), strict=True)) if state.exists else {}
        sealed = set(state.get[5]) if state.exists else set()
        done: list[tuple] = []
        if state.hasTimedOut:
            done = [(key[0], s, *r, False) for s, r in sorted(held.items())]
            state.remove()
        else:
            for events in batches:
                events = events[~events["step"].isin(sealed)].sort_values("seq")
                _add(held, events)
                for s in events.loc[events["type"] == "step/done", "step"].unique():
                    done.append((key[0], int(s), *held.pop(int(s)), True))
                    sealed.add(int(s))
            columns = [list(held), *map(list, zip(*held.values(), strict=True))] if held else [[], [], [], [], []]
            state.update((*columns, sorted(sealed)))
            state.setTimeoutDuration(int(pd.Timedelta(idle).total_seconds() * 1000))
        yield pd.DataFrame(done, columns=["task", "step", "n_events", "n_redactions", "n_errors", "latency_ms", "sealed"])

    held = "step array<bigint>, n array<bigint>, r array<bigint>, e array<bigint>, ms array<double>, sealed array<bigint>"
    return events.groupBy("task").applyInPandasWithState(update, RECEIPT, held, "append", GroupStateTimeout.ProcessingTimeTimeout)


def session_counts(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions per user from a stream or table with ts and user_id. An extension: the model has no event time."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def runs(events: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """Runs of equal values: by, run, value, first, last, length."""
    w = Window.partitionBy(*by).orderBy(order)
    new = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & F.lag(order).over(w).isNotNull(), 0).otherwise(1)
    numbered = events.withColumn("_new", new).withColumn("run", F.sum("_new").over(w))
    return numbered.groupBy(*by, "run", value).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("length"))


def stop_reasons(steps: DataFrame, by: list[str], max_steps: int = MAX_STEPS, max_stalls: int = MAX_STALLS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Why each task's loop ends, and after how many steps: by, steps, reason.

    steps: by, step (from 1), action, key (the whole action), fingerprint (of the page behind it), error,
    cancelled. The first step that meets a reason ends the loop; of one step's reasons: cancelled, error,
    done, abort or ask_user, repeating, no-progress, max-steps.
    """
    w = Window.partitionBy(*by).orderBy("step")
    same = lambda c: F.coalesce(F.lag(c).over(w) == F.col(c), F.lit(False))
    flags = steps.withColumns({"_rep": same("key"), "_stall": same("fingerprint")})
    for c in ("_rep", "_stall"):
        # A running count that starts anew where the flag is off.
        flags = flags.withColumn(f"{c}_at", F.max(F.when(~F.col(c), F.col("step"))).over(w)).withColumn(f"{c}_n", F.col("step") - F.coalesce(F.col(f"{c}_at"), F.lit(0)))
    reason = (
        F.when(F.coalesce(F.col("cancelled"), F.lit(False)), "cancelled")
        .when(F.col("error").isNotNull(), "error")
        .when(F.col("action").isin(*TERMINAL), F.col("action"))
        .when(F.col("_rep") & (F.col("_rep_n") >= max_repeats), "repeating")
        .when(F.col("_stall") & (F.col("_stall_n") >= max_stalls), "no-progress")
        .when(F.col("step") >= max_steps, "max-steps")
    )
    return flags.withColumn("_reason", reason).where("_reason is not null").groupBy(*by).agg(F.min("step").alias("steps"), F.min_by("_reason", "step").alias("reason"))


def latency_bars(parts: DataFrame, by: list[str], label: str = "label", ms: str = "ms") -> DataFrame:
    """Each part's share of its group's total; 0 where the total is 0."""
    total = F.sum(ms).over(Window.partitionBy(*by))
    return parts.select(*by, label, ms, F.when(total == 0, 0.0).otherwise(F.col(ms) / total).alias("fraction"))


def group_redactions(entries: DataFrame, by: str = "kind") -> DataFrame:
    """Counts and strategies per kind or source, most first."""
    return entries.groupBy(by).agg(F.count("*").alias("n"), F.array_sort(F.collect_set("strategy")).alias("strategies")).orderBy(F.desc("n"), by)
