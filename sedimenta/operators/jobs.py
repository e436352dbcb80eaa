"""The job log: submission, states, events, retention, quotas, rate limits and fair order."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimenta.config import PRIORITIES, TERMINAL, TRANSITIONS, ServerLimits
from sedimenta.errors import EngineError
from sedimenta.operators.ordered import fold_sorted, lagged, ordered
from sedimenta.staging import stage

#: What a command asks a job to become; submission makes it.
COMMANDS = {"submit": "queued", "start": "running", "cancel": "cancelling", "complete": "completed", "fail": "failed", "finish_cancel": "cancelled"}


def submissions(requests: DataFrame, order: list[str]) -> DataFrame:
    """Adds outcome to requests (owner, idempotency_key, params): the first of a key is accepted,
    one that repeats it a replay, one with other params a conflict.

    The first one is found by a combined minimum, so a key with very many requests is no hot window.
    """
    keys = ["owner", "idempotency_key"]
    first = requests.groupBy(*keys).agg(F.min(F.struct(*order, "params")).alias("__first"))
    met = requests.join(first, keys)
    is_first = F.struct(*order) == F.struct(*[F.col(f"__first.{c}") for c in order])
    outcome = F.when(is_first, "accepted").when(F.col("params").eqNullSafe(F.col("__first.params")), "replay").otherwise("conflict")
    return met.withColumn("outcome", outcome).drop("__first")


def capped(requests: DataFrame, order: list[str], retained: int = ServerLimits.retained_jobs, per_owner: int = ServerLimits.jobs_per_session) -> DataFrame:
    """`submissions` to a store in which no job ends: a new key is refused for `retention` once the store
    holds `retained` jobs, else for `quota` once its owner has `per_owner`. So is each request that repeats a refused key.

    Both are running counts, so a request needs to see no other one; `order` must tell requests apart.
    """
    keys = ["owner", "idempotency_key"]
    made = stage(submissions(requests, order))
    firsts = made.where("outcome = 'accepted'").select(*order, *keys)
    fit = ordered(firsts, order, number="__nth", keys=["owner"]).where(F.col("__nth") < per_owner)
    kept = ordered(fit, order, number="__all").select(*keys, "__all")
    met = made.join(kept, keys, "left").withColumn("__takes", F.when((F.col("outcome") == "accepted") & F.col("__all").isNotNull(), 1).otherwise(0))
    told = ordered(met, order, sums={"__before": "__takes"})
    outcome = F.when(F.col("__all") < retained, F.col("outcome")).when(F.col("__before") >= retained, "retention").otherwise("quota")
    return told.withColumn("outcome", outcome).drop("__all", "__takes", "__before")


def allowed(before: Column, after: Column) -> Column:
    """Whether a job in one state may be told to go to another."""
    return F.coalesce(F.concat_ws(">", before, after).isin(*[f"{a}>{b}" for a, b in TRANSITIONS]), F.lit(False))


def transition_checks(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Adds the state before each logged one, and whether the step is allowed; a first state must be queued."""
    out = lagged(log, keys, order, "state", "before")
    return out.withColumn("valid", F.when(F.col("before").isNull(), F.col("state") == "queued").otherwise(allowed(F.col("before"), F.col("state"))))


def next_state(state: str | None, command: str) -> tuple[str | None, str]:
    """State after a command, and what came of it: applied, ignored or conflict.

    Cancelling a queued job ends it at once and a second cancel changes nothing; a job
    that is queued can also be completed, and any that hasn't ended can fail.
    """
    if command == "submit":
        return ("queued", "applied") if state is None else (state, "ignored")
    if state is None:
        return None, "not found"
    if command == "cancel":
        if state in ("cancelling", "cancelled"):
            return state, "ignored"
        if state in TERMINAL:
            return state, "conflict"
        return ("cancelled" if state == "queued" else "cancelling"), "applied"
    if command == "complete":
        return ("completed", "applied") if state in ("queued", "running") else (state, "conflict")
    if command == "fail":
        return (state, "conflict") if state in TERMINAL else ("failed", "applied")
    to = COMMANDS.get(command)
    return (to, "applied") if (state, to) in TRANSITIONS else (state, "conflict")


def applied(commands: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Adds state and outcome to commands (keys, command): each job's commands in order through its state machine.

    What each command does in each state is worked out once; the fold only looks it up.
    """
    states = (None, *COMMANDS.values())
    known = {(s, c): next_state(s, c) for s in states for c in COMMANDS}

    def step(held, command):
        made = known.get((held[0], command)) or next_state(held[0], command)
        return made[:1], made

    # the state before a job is submitted is None, so the fold keeps it in a tuple
    return fold_sorted(commands, keys, order, ["command"], "state string, outcome string", lambda: (None,), step)


def with_sequence(log: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Adds sequence, from 1 for each job, and completed_units, 1 in an end state. Holds for jobs with any number of events."""
    made = ordered(log, order, number="__n", keys=keys)
    return made.withColumn("sequence", F.col("__n") + 1).drop("__n").withColumn("completed_units", F.col("state").isin(*TERMINAL).cast("long"))


def retained(events: DataFrame, keys: list[str], most: int = ServerLimits.events_per_job) -> DataFrame:
    """The newest events of each job. Sequences have no gaps, so the last one tells which are kept, without a window."""
    last = events.groupBy(*keys).agg(F.max("sequence").alias("__last"))
    return events.join(last, keys).where(F.col("sequence") > F.col("__last") - most).drop("__last")


def since(events: DataFrame, keys: list[str], after: int) -> DataFrame:
    """For each job the events after a cursor, the latest sequence, and whether it has ended."""
    per = events.groupBy(*keys).agg(F.max("sequence").alias("latest_sequence"), F.max_by("state", "sequence").isin(*TERMINAL).alias("terminal"))
    return events.where(F.col("sequence") > after).join(per, keys)


def snapshot(events: DataFrame, keys: list[str]) -> DataFrame:
    return events.groupBy(*keys).agg(F.max_by("state", "sequence").alias("state"), F.max("sequence").alias("sequence"), F.max("occurred_at_ms").alias("updated_ms"))


def cancelled(jobs: DataFrame) -> DataFrame:
    """What a cancel request does to each job."""
    s = F.col("state")
    to = F.when(s == "queued", "cancelled").when(s == "running", "cancelling").otherwise(s)
    outcome = F.when(s.isin("completed", "failed"), "conflict").when(s.isin("cancelling", "cancelled"), "ignored").otherwise("applied")
    return jobs.withColumn("outcome", outcome).withColumn("state", to)


def expired(jobs: DataFrame, now_ms: Column) -> DataFrame:
    """Jobs whose deadline has passed: queued ones fail, running ones are cancelling."""
    due = F.col("deadline_ms") <= now_ms
    to = F.when(due & (F.col("state") == "queued"), "failed").when(due & (F.col("state") == "running"), "cancelling").otherwise(F.col("state"))
    return jobs.withColumn("state_after", to)


def recovered(jobs: DataFrame, verified: DataFrame) -> DataFrame:
    """After a restart: a job that hadn't ended is completed if its output's identity is verified, else failed."""
    met = jobs.join(verified.select("job_id", F.col("identity").alias("__seen")).distinct(), "job_id", "left")
    ended = F.col("state").isin(*TERMINAL)
    to = F.when(ended, F.col("state")).when(F.coalesce(F.col("identity") == F.col("__seen"), F.lit(False)), "completed").otherwise("failed")
    return met.withColumn("state_after", to).drop("__seen")


def published(jobs: DataFrame) -> DataFrame:
    """Adds outcome and recorded_after to jobs (state, was_absent, recorded, seen) whose output has been verified.

    The first phase, before a job writes, notes in was_absent that its output didn't exist; the second one records the
    identity that was `seen` in the output, while the job runs or is cancelling. Recording the same identity again changes nothing,
    another one is a mismatch, and without the first phase there's nothing to record. `recovered` trusts only what is recorded.
    """
    outcome = (
        F.when(~F.col("state").isin("running", "cancelling"), "conflict")
        .when(~F.coalesce("was_absent", F.lit(False)) | F.col("seen").isNull(), "internal")
        .when(F.col("recorded").isNull(), "recorded")
        .when(F.col("recorded") == F.col("seen"), "unchanged")
        .otherwise("integrity_mismatch")
    )
    return jobs.withColumn("outcome", outcome).withColumn("recorded_after", F.when(F.col("outcome") == "recorded", F.col("seen")).otherwise(F.col("recorded")))


def closed(jobs: DataFrame) -> DataFrame:
    """At shutdown: queued jobs are cancelled and running ones cancelling."""
    to = F.when(F.col("state") == "queued", "cancelled").when(F.col("state") == "running", "cancelling").otherwise(F.col("state"))
    return jobs.withColumn("state_after", to)


def owned(jobs: DataFrame, owner: str | int) -> DataFrame:
    """What a session sees: others' jobs don't exist."""
    return jobs.where(F.col("owner") == owner)


def store_problems(jobs: DataFrame, events: DataFrame, keys: list[str]) -> DataFrame:
    """Jobs whose events have gaps, whose counter isn't one beyond the last, or whose state isn't the last event's."""
    per = events.groupBy(*keys).agg(F.count("*").alias("__n"), F.min("sequence").alias("__first"), F.max("sequence").alias("__last"), F.max_by("state", "sequence").alias("__state"))
    met = jobs.join(per, keys, "full")
    problem = F.when(F.col("state").isNull(), "no job").when(F.col("__n").isNull(), "no events").when(F.col("__n") != F.col("__last") - F.col("__first") + 1, "gap").when(F.col("next_sequence") != F.col("__last") + 1, "counter").when(F.col("state") != F.col("__state"), "state")
    return met.select(*keys, problem.alias("problem")).where("problem IS NOT NULL")


def quota_ok(value: Column, most: int) -> Column:
    return (value > 0) & (value <= most)


def rate_limited(requests: DataFrame, keys: list[str], order: list[str], now_ms: str, rate: int, burst: int) -> DataFrame:
    """Adds allowed and tokens_milli: a bucket for each connection, full at first.

    Time that passes between two requests refills it by `rate` thousandths of a token a millisecond, up to `burst`
    tokens; a request takes a whole token if there is one. Time that runs backwards refills nothing, and a request
    at time 0 counts as none before it: the next one finds no time passed.
    """
    full = burst * 1000

    def step(bucket, now):
        held, seen = bucket
        passed = now - seen if seen and now > seen else 0
        held = min(full, held + passed * rate)
        left = held - 1000 if held >= 1000 else held
        return (left, now), (left < held, left)

    return fold_sorted(requests, keys, order, [now_ms], "allowed boolean, tokens_milli long", lambda: (full, 0), step)


def lane_order(jobs: DataFrame, order: list[str], lane: list[str] | None = None) -> DataFrame:
    """Adds turn: how jobs that wait in one lane leave it, round-robin over sessions in the order they came, first in first out in each."""
    lane = lane or []
    numbered = ordered(jobs, order, number="__round", keys=[*lane, "session"])
    came = jobs.groupBy(*lane, "session").agg(F.min(F.struct(*order)).alias("__came"))
    return ordered(numbered.join(came, [*lane, "session"]), ["__round", "__came"], number="turn", keys=lane).drop("__round", "__came")


def fair_order(waiting: DataFrame, order: list[str], weights: dict[str, int] = PRIORITIES) -> DataFrame:
    """Adds cycle, turn and place: the order in which waiting jobs (priority, session) are served.

    Lanes go by priority, in the order of `weights`. A cycle visits each lane once and takes as many jobs as it weighs;
    what an empty lane could have taken is lost, so a lane's n-th job goes in cycle n div weight, whatever
    the other lanes hold. In a lane sessions take turns. Computed from counts: no queue is walked.
    """
    lanes = list(weights)
    lane = F.array_position(F.array(*map(F.lit, lanes)), F.col("priority"))
    weight = F.element_at(F.array(*map(F.lit, weights.values())), lane.cast("int"))
    turns = lane_order(waiting, order, ["priority"])
    return ordered(turns.withColumn("cycle", F.floor(F.col("turn") / weight).cast("long")).withColumn("__lane", lane), ["cycle", "__lane", "turn"], number="place").drop("__lane")


def dag_levels(tasks: dict[int, Iterable[int]], most: int = 100_000) -> dict[int, int]:
    """The level of each task in a graph of dependencies; unknown ones and cycles fail."""
    if len(tasks) > most:
        raise EngineError("resource_limit", "tasks")
    waits = {t: set(d) for t, d in tasks.items()}
    if lost := {d for ds in waits.values() for d in ds} - set(waits):
        raise EngineError("invalid_metadata", f"missing dependency {min(lost)}")
    levels: dict[int, int] = {}
    level = 0
    while len(levels) < len(waits):
        ready = [t for t, ds in waits.items() if t not in levels and ds <= set(levels)]
        if not ready:
            raise EngineError("dependency_cycle")
        levels |= dict.fromkeys(ready, level)
        level += 1
    return levels


def levels(edges: DataFrame, tasks: DataFrame) -> DataFrame:
    """task, level for a table of dependencies (task, needs): a round for each level, by joins; a cycle fails."""
    done = stage(tasks.join(edges.select("task").distinct(), "task", "left_anti").withColumn("level", F.lit(0)))
    total, n, level = tasks.count(), 0, 0
    while (now := done.count()) < total:
        if now == n:
            raise EngineError("dependency_cycle")
        n, level = now, level + 1
        open_ = edges.join(done.select(F.col("task").alias("needs")), "needs", "left_anti").select("task").distinct()
        ready = tasks.join(done.select("task"), "task", "left_anti").join(open_, "task", "left_anti")
        done = stage(done.unionByName(ready.withColumn("level", F.lit(level))))
    return done


def dispatch(tasks: list[dict], memory: int) -> list[int]:
    """The order in which tasks (id, priority, needs, memory) start, one at a time, by priority and id among those that are ready."""
    if any(t["memory"] > memory for t in tasks):
        raise EngineError("memory_limit")
    dag_levels({t["id"]: t["needs"] for t in tasks})
    out: list[int] = []
    while len(out) < len(tasks):
        ready = [t for t in tasks if t["id"] not in out and set(t["needs"]) <= set(out)]
        out.append(min(ready, key=lambda t: (t["priority"], t["id"]))["id"])
    return out


def permits(memory_bytes: Column) -> Column:
    """Memory permits of one MiB each, at least one."""
    return F.greatest(F.ceil(memory_bytes / (1 << 20)), F.lit(1)).cast("long")


def permit_use(events: DataFrame, order: list[str], capacity: dict[str, int]) -> DataFrame:
    """Adds to a log of permits taken (positive) and given back (negative) what is in use of each resource after
    each event, as used_<resource>, and whether all are within capacity and none below zero.
    """
    out = ordered(events, order, sums={f"__{r}": r for r in capacity})
    for r in capacity:
        out = out.withColumn(f"used_{r}", F.col(f"__{r}") + F.col(r)).drop(f"__{r}")
    fine = F.lit(True)
    for r, most in capacity.items():
        fine = fine & F.col(f"used_{r}").between(0, most)
    return out.withColumn("within", fine)


def session_log(rows: DataFrame, order: list[str], ttl_ms: int = ServerLimits.session_ms) -> DataFrame:
    """Adds outcome to a log of sessions (session, action, token, next_token, now_ms): created, resumed or denied.

    A session is created unless it lives, and lives `ttl_ms` from then on. To resume it takes the token that was given out
    last; it's then replaced by next_token, and the time starts again. Only hashes of tokens are held. A session that has
    expired is gone.
    """

    def step(held, action, token, fresh, now):
        live = held[1] > now
        if action == "create" and not live:
            return (fresh, now + ttl_ms), ("created",)
        if action == "resume" and live and token is not None and token == held[0]:
            return (fresh, now + ttl_ms), ("resumed",)
        return held if live else ("", 0), ("denied",)

    hashed = rows.withColumn("__token", F.sha2("token", 256)).withColumn("__fresh", F.sha2("next_token", 256))
    return fold_sorted(hashed, ["session"], order, ["action", "__token", "__fresh", "now_ms"], "outcome string", lambda: ("", 0), step).drop("__token", "__fresh")


def session_capacity(sessions: DataFrame, now_ms: Column, most: int = ServerLimits.sessions) -> DataFrame:
    """How many sessions live; as many as the registry holds leave no room for another one."""
    return live_sessions(sessions, now_ms).agg(F.count("*").alias("live")).withColumn("full", F.col("live") >= most)


def live_sessions(sessions: DataFrame, now_ms: Column, ttl_ms: int = ServerLimits.session_ms) -> DataFrame:
    return sessions.where(F.col("created_ms") + ttl_ms > now_ms)


def operation_hash(*cols: str) -> Column:
    """A key for the parameters of an operation, from canonical JSON."""
    return F.sha2(F.to_json(F.struct(*sorted(cols))), 256)


def _depth(raw: Column) -> Column:
    """How deep brackets outside strings are nested."""
    bare = F.regexp_replace(F.regexp_replace(raw, r"\\.", ""), '"[^"]*"', "")
    marks = F.regexp_extract_all(bare, F.lit(r"[\[\]{}]"), 0)
    zero = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))
    step = lambda s, c: F.when(c.isin("[", "{"), F.struct((s["now"] + 1).alias("now"), F.greatest(s["most"], s["now"] + 1).alias("most"))).otherwise(F.struct((s["now"] - 1).alias("now"), s["most"].alias("most")))
    return F.aggregate(marks, zero, step, lambda s: s["most"])


def request_problem(raw: Column, methods: Iterable[str], most_bytes: int = 1 << 20, most_depth: int = 64, most_id: int = 128) -> Column:
    """Why a JSON-RPC request is refused: size, depth, syntax, unknown or repeated fields, version, id or method; null if it isn't.

    An id has 1 to `most_id` bytes without control characters.
    """
    fields = F.json_object_keys(raw)
    known = ("jsonrpc", "id", "method", "params")
    got = F.from_json(raw, "jsonrpc string, id string, method string")
    return (
        F.when(F.octet_length(raw) > most_bytes, "too large")
        .when(_depth(raw) > most_depth, "too deep")
        .when(fields.isNull(), "syntax")
        .when(F.size(F.array_except(fields, F.array(*map(F.lit, known)))) > 0, "unknown field")
        .when(F.size(F.array_distinct(fields)) != F.size(fields), "duplicate field")
        .when(~got["jsonrpc"].eqNullSafe(F.lit("2.0")), "version")
        .when(got["id"].isNull() | (got["id"] == "") | (F.octet_length(got["id"]) > most_id) | got["id"].rlike(r"[\x00-\x1f\x7f]"), "id")
        .when(got["method"].isNull() | ~got["method"].isin(*methods), "method")
    )
