"""Run states from event logs, job overlays and run names, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.registry import SQL, query
from starloom.sources.frames import table
from starloom.streaming.events import PHASES, overlay, run_id, status_batch

N = len(PHASES)
_LIST = "[" + ", ".join(f"'{p}'" for p in PHASES) + "]"


def run_events(events: DataFrame) -> DataFrame:
    """The events table read as run logs: a run for each user, kinds by event_type, phases by event_id."""
    i, kind = F.col("event_id"), F.col("event_type")
    name = F.element_at(F.array(*map(F.lit, PHASES)), (i % N + 1).cast("int"))
    odd = F.when(i % 3 == 0, "resume_start").when(i % 3 == 1, "resume_end").otherwise("run_end")
    type_ = F.when(kind == "click", "phase_start").when(kind == "view", "phase_progress").when(kind.isin("purchase", "error"), "phase_end").otherwise(odd)
    done = F.when(kind == "error", "skipped").when(i % 4 == 2, "skipped").when(i % 4 == 3, "Error").otherwise("OK")
    return events.select(
        F.col("user_id").alias("run_id"), i.alias("line_no"), type_.alias("type"), F.when(kind == "error", "ASTROMETRY").otherwise(name).alias("phase_name"), done.alias("status"),
        F.round(F.col("value") / 100, 3).alias("progress"), F.lower(name).alias("from_phase"), (i % 2 == 0).alias("success"), F.when(kind == "error", "existing_wcs").alias("reason"))


# one event of each run a step: st and pct hold the phases' states, sh the shares last reported
_MINE = "list_transform(range(1, {n} + 1), lambda i: CASE WHEN {cond} THEN {then} ELSE {keep} END)"
_START = "(e.kind = 'phase_start' AND i = e.idx)"
_STEP = "(e.kind = 'phase_progress' AND i = e.idx)"
_END = "(e.kind = 'phase_end' AND i = e.idx)"
_AST = PHASES.index("ASTROMETRY") + 1
_DONE = f"CASE WHEN f.resuming AND e.idx = {_AST} AND f.res <> {_AST} AND e.raw = 'skipped' AND e.known AND f.st[e.idx] = 'ok' THEN 'ok' ELSE e.raw END"
_ST = f"""list_transform(range(1, {N + 1}), lambda i: CASE WHEN {_START} OR {_STEP} THEN 'running' WHEN {_END} THEN {_DONE}
  WHEN e.kind = 'resume_start' THEN CASE WHEN i = e.idx THEN 'running' WHEN i > e.idx THEN 'pending' WHEN f.st[i] = 'pending' THEN 'ok' ELSE f.st[i] END
  WHEN e.kind = 'resume_end' AND e.success AND i = f.res AND f.st[i] IN ('running', 'pending') THEN 'ok' ELSE f.st[i] END)"""
_PCT = f"""list_transform(range(1, {N + 1}), lambda i: CASE WHEN {_START} THEN CASE WHEN f.st[i] <> 'running' OR f.pct[i] >= 1 THEN 0.0 ELSE f.pct[i] END WHEN {_STEP} THEN greatest(f.pct[i], e.prog)
  WHEN {_END} THEN CASE WHEN e.raw IN ('ok', 'skipped') THEN 1.0 ELSE f.pct[i] END
  WHEN e.kind = 'resume_start' THEN CASE WHEN i >= e.idx THEN 0.0 WHEN f.st[i] = 'pending' THEN 1.0 ELSE f.pct[i] END
  WHEN e.kind = 'resume_end' AND e.success AND i = f.res AND f.st[i] IN ('running', 'pending') THEN 1.0 ELSE f.pct[i] END)"""
_EARLY = "(f.resuming AND e.idx < f.res)"
SQL["e2_run_status"] = f"""WITH RECURSIVE ev AS (SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, CASE event_type WHEN 'click' THEN 'phase_start' WHEN 'view' THEN 'phase_progress' WHEN 'purchase' THEN 'phase_end' WHEN 'error' THEN 'phase_end'
  ELSE CASE event_id % 3 WHEN 0 THEN 'resume_start' WHEN 1 THEN 'resume_end' ELSE 'run_end' END END AS kind, CASE WHEN event_type = 'error' THEN {_AST} ELSE event_id % {N} + 1 END AS idx, least(greatest(round(value / 100, 3), 0), 1) AS prog,
  CASE WHEN event_type = 'error' OR event_id % 4 = 2 THEN 'skipped' WHEN event_id % 4 = 3 THEN 'error' ELSE 'ok' END AS raw, event_type = 'error' AS known, event_id % 2 = 0 AS success FROM events),
f AS (SELECT DISTINCT run, 0::BIGINT AS n, list_transform(range({N}), lambda i: 'pending') AS st, list_transform(range({N}), lambda i: 0.0::DOUBLE) AS pct, list_transform(range({N}), lambda i: NULL::DOUBLE) AS sh, 'unknown' AS status, 0::BIGINT AS cur, 0::BIGINT AS res, FALSE AS resuming FROM ev
 UNION ALL SELECT f.run, e.n, {_ST}, {_PCT}, list_transform(range(1, {N + 1}), lambda i: CASE WHEN {_STEP} THEN greatest(f.pct[i], e.prog) ELSE f.sh[i] END),
  CASE WHEN e.kind IN ('phase_start', 'phase_progress') AND f.status = 'unknown' THEN 'running' WHEN e.kind = 'phase_end' AND e.raw = 'error' THEN 'failed' WHEN e.kind = 'resume_start' AND f.status IN ('unknown', 'completed') THEN 'running'
   WHEN e.kind IN ('resume_end', 'run_end') THEN CASE WHEN e.success THEN 'completed' ELSE 'failed' END ELSE f.status END,
  CASE WHEN e.kind IN ('phase_start', 'phase_progress') THEN CASE WHEN {_EARLY} THEN f.cur ELSE e.idx END WHEN e.kind = 'phase_end' THEN CASE WHEN NOT {_EARLY} AND f.cur = e.idx THEN 0 ELSE f.cur END
   WHEN e.kind = 'resume_start' THEN e.idx WHEN e.kind = 'resume_end' AND e.success AND f.cur = f.res THEN 0 ELSE f.cur END,
  CASE WHEN e.kind = 'resume_start' THEN e.idx ELSE f.res END, CASE e.kind WHEN 'resume_start' THEN TRUE WHEN 'resume_end' THEN FALSE ELSE f.resuming END
 FROM f JOIN ev e ON e.run = f.run AND e.n = f.n + 1),
z AS (SELECT *, len(list_filter(st, lambda x: x IN ('ok', 'skipped'))) AS done FROM f QUALIFY row_number() OVER (PARTITION BY run ORDER BY n DESC) = 1),
v AS (SELECT *, CASE WHEN status = 'unknown' AND (cur > 0 OR done > 0) THEN 'running' ELSE status END AS verdict FROM z)
SELECT CAST(run AS VARCHAR) AS run_id, verdict AS status, CASE WHEN cur > 0 THEN {_LIST}[cur] END AS current_phase,
 CASE WHEN verdict = 'completed' THEN 1.0 ELSE round(least(greatest((done + CASE WHEN cur > 0 THEN coalesce(sh[cur], pct[cur]) ELSE 0 END) / {N}, 0), 1), 4) END AS progress FROM v"""


@query("e2_run_status", SQL["e2_run_status"])
def _status(s, d):
    return status_batch(run_events(table(s, d, "events")))


@query("e3_progress_bands", f"SELECT status, floor(progress * 4) / 4 AS band, count(*) AS runs FROM ({SQL['e2_run_status']}) GROUP BY 1, 2")
def _bands(s, d):
    return _status(s, d).groupBy("status", (F.floor(F.col("progress") * 4) / 4).alias("band")).agg(F.count("*").alias("runs"))


@query("e7_job_overlay", f"""WITH j AS (SELECT CAST(user_id AS VARCHAR) AS run_id, arg_max(struct_pack(s := ['pending', 'running', 'cancelled', 'error', 'ok'][CAST(event_id % 5 AS INT) + 1], p := value), event_id) AS job FROM events WHERE event_type = 'click' AND user_id % 3 > 0 GROUP BY 1)
SELECT run_id, CASE WHEN job.s IN ('pending', 'running', 'cancelled') THEN job.s WHEN job.s = 'error' THEN 'failed' WHEN job.s = 'ok' THEN 'completed' ELSE status END AS status, CASE WHEN job.s IN ('cancelled', 'error', 'ok') THEN NULL ELSE current_phase END AS current_phase,
round(CASE WHEN job.s IN ('pending', 'running') THEN greatest(progress, least(greatest(job.p / 100, 0), 1)) WHEN job.s = 'ok' THEN 1 ELSE progress END, 4) AS progress FROM ({SQL['e2_run_status']}) LEFT JOIN j USING (run_id)""")
def _overlay(s, d):
    state = F.element_at(F.array(*map(F.lit, ("pending", "running", "cancelled", "error", "ok"))), (F.col("event_id") % 5 + 1).cast("int"))
    jobs = table(s, d, "events").where("event_type = 'click' and user_id % 3 > 0").select(F.col("user_id").cast("string").alias("run_id"), F.col("event_id").alias("created"), state.alias("state"), F.col("value").alias("progress"))
    return overlay(_status(s, d), jobs)


@query("x23_run_id", "SELECT event_id, strftime(ts, '%Y%m%d_%H%M%S') || '_' || substr(md5(CAST(event_id AS VARCHAR)), 1, 8) AS run_id FROM events")
def _run_id(s, d):
    return table(s, d, "events").select("event_id", run_id(F.col("ts"), F.md5(F.col("event_id").cast("string").cast("binary"))).alias("run_id"))
