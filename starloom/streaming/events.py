"""Run events: the status fold, in batch and as a stateful stream."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: the phases in the order they run
PHASES = ("SCAN_INPUT", "CHANNEL_SPLIT", "NORMALIZATION", "GLOBAL_METRICS", "TILE_GRID", "REGISTRATION", "PREWARP", "COMMON_OVERLAP", "LOCAL_METRICS", "TILE_RECONSTRUCTION", "STATE_CLUSTERING", "SYNTHETIC_FRAMES", "STACKING", "DEBAYER", "ASTROMETRY", "BGE", "PCC")
STATUS = "run_id string, status string, current_phase string, progress double"


def _early(state: dict, name: str) -> bool:
    """Whether a phase comes before the one that a running resume began with."""
    start = state.get("from") if state.get("resuming") else None
    return name in PHASES and start in PHASES and PHASES.index(name) < PHASES.index(start)


def _resume(state: dict, start: str) -> None:
    """Phases before ``start`` that were pending count as done; it and the later ones begin again."""
    state |= {"from": start, "resuming": True, "current": start}
    if state.get("status", "unknown") in ("unknown", "pending", "completed"):
        state["status"] = "running"
    if start not in PHASES:
        return
    phases, at = state["phases"], PHASES.index(start)
    for i, p in enumerate(PHASES):
        if i >= at:
            phases[p] = {"status": "running" if i == at else "pending", "pct": 0.0}
        elif phases.get(p, {}).get("status", "pending") == "pending":
            phases[p] = {"status": "ok", "pct": 1.0}


def fold(state: dict, events: Iterable[dict]) -> dict:
    """Status of a run after more events, in order."""
    phases, shares = state.setdefault("phases", {}), state.setdefault("shares", {})
    state.setdefault("status", "unknown")
    for e in events:
        kind, name = e.get("type"), e.get("phase_name")
        success = e.get("success") in (True, "true")
        if name and kind in ("phase_start", "phase_progress", "phase_end"):
            p = phases.setdefault(name, {"status": "pending", "pct": 0.0})
            if kind == "phase_end":
                was, done = p["status"], (e.get("status") or "unknown").lower()
                known = was in ("ok", "completed", "done") and (e.get("reason") or "").lower() == "existing_wcs"
                if known and done == "skipped" and state.get("resuming") and name == "ASTROMETRY" != state.get("from"):
                    done = "ok"  # solved before: the resumed run only looked it up
                p["status"] = done
                if done in ("ok", "skipped"):
                    p["pct"] = 1.0
                if not _early(state, name) and state.get("current") == name and done in ("ok", "skipped", "error", "aborted"):
                    state["current"] = None
                if done in ("error", "aborted"):
                    state["status"] = "failed"
                continue
            if kind == "phase_start":
                p["pct"] = 0.0 if p["status"] != "running" or p["pct"] >= 1 else p["pct"]
            elif e.get("progress") is not None and e["progress"] == e["progress"]:
                p["pct"] = shares[name] = max(p["pct"], min(max(e["progress"], 0.0), 1.0))
            p["status"] = "running"
            if not _early(state, name):
                state["current"] = name
            if state["status"] in ("unknown", "pending"):
                state["status"] = "running"
        elif kind == "resume_start":
            start = (e.get("from_phase") or state.get("from") or "").upper()
            if start:
                _resume(state, start)
        elif kind == "resume_end":
            state |= {"status": "completed" if success else "failed", "resuming": False}
            start = state.get("from")
            if success and start:
                if phases.get(start, {}).get("status") in ("running", "pending"):
                    phases[start] = {"status": "ok", "pct": 1.0}
                if state.get("current") == start:
                    state["current"] = None
        elif kind == "run_end":
            state["status"] = "completed" if success else "failed"
    return state


def verdict(state: dict) -> str:
    """The run's status; one without a start but with signs of work is running."""
    done = any(state.get("phases", {}).get(p, {}).get("status") in ("ok", "skipped") for p in PHASES)
    return "running" if state.get("status", "unknown") == "unknown" and (state.get("current") or done) else state.get("status", "unknown")


def progress(state: dict) -> float:
    """Finished phases and the current one's share, of all phases; 1 for a completed run."""
    if verdict(state) == "completed":
        return 1.0
    phases, now = state.get("phases", {}), state.get("current")
    done = sum(phases.get(p, {}).get("status") in ("ok", "skipped") for p in PHASES)
    share = state.get("shares", {}).get(now, phases.get(now, {}).get("pct", 0.0)) if now else 0.0
    return round(min(max((done + share) / len(PHASES), 0.0), 1.0), 4)


def _row(run: str, state: dict) -> pd.DataFrame:
    return pd.DataFrame([{"run_id": str(run), "status": verdict(state), "current_phase": state.get("current"), "progress": progress(state)}])


def status_batch(events: DataFrame) -> DataFrame:
    """Status of every run; events(run_id, line_no, ...), folded in the order of line_no."""
    return events.groupBy("run_id").applyInPandas(lambda df: _row(df["run_id"].iloc[0], fold({}, df.sort_values("line_no").astype(object).where(df.notna(), None).to_dict("records"))), STATUS)


def status_stream(events: DataFrame) -> DataFrame:
    """The same fold over a stream: state by run, an update for each batch that touches it."""
    import json

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now = json.loads(state.get[0]) if state.exists else {}
        rows = pd.concat(list(batches)).sort_values("line_no")
        fold(now, rows.astype(object).where(rows.notna(), None).to_dict("records"))
        state.update((json.dumps(now),))
        yield _row(key[0], now)

    return events.groupBy("run_id").applyInPandasWithState(step, STATUS, "state string", "update", "NoTimeout")


def overlay(status: DataFrame, jobs: DataFrame) -> DataFrame:
    """The latest job's state over the status that a stale event log gives; jobs(run_id, created, state, progress in %)."""
    last = jobs.groupBy("run_id").agg(F.max_by(F.struct("state", "progress"), "created").alias("job"))
    job, share = F.col("job.state"), F.least(F.greatest(F.col("job.progress") / 100, F.lit(0.0)), F.lit(1.0))
    named = F.when(job.isin("pending", "running"), job).when(job == "cancelled", "cancelled").when(job == "error", "failed").when(job == "ok", "completed")
    out = status.join(last, "run_id", "left")
    moved = F.when(job.isin("pending", "running"), F.greatest("progress", share)).when(job == "ok", 1.0).otherwise(F.col("progress"))
    return out.select("run_id", F.coalesce(named, "status").alias("status"), F.when(job.isin("cancelled", "error", "ok"), None).otherwise(F.col("current_phase")).alias("current_phase"), F.round(moved, 4).alias("progress"))


def discover_runs(spark: SparkSession, folder: str, limit: int = 200) -> DataFrame:
    """run_dir, path and modified of every run below ``folder``, the latest first: a run is where an event log lies, or
    the folder above if that is called logs. Files are listed, not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "{run_events,events}.jsonl").load(folder)
    run = F.regexp_replace("path", "(?:/logs/run_events|/run_events|/events)\\.jsonl$", "")
    runs = files.select(run.alias("run_dir"), "path", F.col("modificationTime").alias("modified"))
    return runs.groupBy("run_dir").agg(F.min("path").alias("path"), F.min_by("modified", "path").alias("modified")).orderBy(F.col("modified").desc(), "run_dir").limit(limit)


def run_id(at: Column, token: Column) -> Column:
    """A run's name: its start to the second, and eight hexadecimal digits."""
    return F.concat(F.date_format(at, "yyyyMMdd_HHmmss"), F.lit("_"), F.lower(F.substring(token, 1, 8)))


def windowed_counts(events: DataFrame, width: str = "1 day", late: str = "2 hours") -> DataFrame:
    """Events by type in tumbling windows; late ones beyond the watermark are dropped in a stream."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")
