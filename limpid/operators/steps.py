"""Run status over a table of runs: normalised words, the fixed stage list, progress, stage durations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from limpid import vocab
from limpid.functions.text import strip
from limpid.operators.cells import col


def normalize_status(c: Column) -> Column:
    """Status word as ok, running, failed or pending; empty is pending; an unknown word stays."""
    word = F.lower(strip(F.coalesce(c, F.lit(""))))
    out = F.when(word == "", F.lit("pending"))
    for status, words in vocab.STATUS_WORDS.items():
        out = out.when(word.isin(*words), F.lit(status))
    return out.otherwise(word)


def stage_title(c: Column) -> Column:
    """Stage title of a slug; a name that is no known slug is kept."""
    name = strip(F.coalesce(c, F.lit("")))
    titles = F.create_map(*[F.lit(v) for kv in vocab.STAGE_TITLES.items() for v in kv])
    return F.coalesce(F.try_element_at(titles, F.lower(name)), name)


def _stages(status_of) -> Column:
    stages = F.array(*[F.lit(s) for s in vocab.STAGES])
    return F.transform(stages, lambda s: F.struct(s.alias("name"), status_of(s).alias("status")))


def upgrade_steps(steps: Column, current: Column | None = None) -> Column:
    """Array of ``{name, status}`` mapped onto the fixed stage list; entries may say ``step`` or ``title`` for ``name``.

    A stage that is not listed is pending; the pending current stage is running; the last entry of a
    repeated stage counts.
    """
    current = stage_title(current) if current is not None else F.lit(None).cast("string")
    entries = F.from_json(F.to_json(steps), "array<struct<name string, step string, title string, status string>>")

    def status_of(stage):
        listed = F.filter(entries, lambda s: stage_title(F.coalesce(s["name"], s["step"], s["title"])) == stage)
        known = F.coalesce(normalize_status(F.try_element_at(listed, F.lit(-1))["status"]), F.lit("pending"))
        missing = F.coalesce(F.size(listed), F.lit(0)) <= 0
        status = F.when(missing, F.lit("pending")).otherwise(known)
        return F.when((status == "pending") & current.eqNullSafe(stage), F.lit("running")).otherwise(status)

    return _stages(status_of)


def upgrade_finished(finished: Column, current: Column | None = None) -> Column:
    """Array of finished stage names mapped onto the fixed stage list."""
    current = stage_title(current) if current is not None else F.lit(None).cast("string")
    done = F.transform(F.coalesce(finished, F.array().cast("array<string>")), stage_title)
    return _stages(lambda stage: F.when(F.array_contains(done, stage), F.lit("ok"))
                   .when(current.eqNullSafe(stage), F.lit("running")).otherwise(F.lit("pending")))


def progress(steps: Column) -> Column:
    """Percent done: a finished step counts one, a running one half; rounded half to even, 0 to 100."""
    points = F.aggregate(
        steps, F.lit(0.0),
        lambda acc, s: acc + F.when(s["status"] == "ok", 1.0).when(s["status"] == "running", 0.5).otherwise(0.0))
    share = F.bround(points * 100 / F.nullif(F.size(steps), F.lit(0)), 0)
    return F.coalesce(F.least(F.greatest(share, F.lit(0.0)), F.lit(100.0)), F.lit(0.0)).cast("int")


def clamp_progress(given: Column, steps: Column) -> Column:
    """The reported percent clamped to 0..100, or the one implied by the steps when none is reported."""
    return F.coalesce(F.least(F.greatest(given.cast("int"), F.lit(0)), F.lit(100)), progress(steps))


def stage_spans(log: DataFrame, order: str, run: str | None = None) -> DataFrame:
    """``(run, stage, state, duration_ms)``: every stage of every run, each start met with the end that follows it.

    Events of a run and stage are taken in ``order``. A start that the next event ends has that end's status as its state. A start
    without an end is ``crashed`` if the run has later events, else ``open``. An end without a start keeps its status.
    ``run`` names the column of the run; without one the log is that of one run, and a task sorts each of its stages.
    """
    events = log.where(F.col("type").isin("stage_start", "stage_end")).select(
        (col(run) if run else F.lit(None).cast("string")).alias("run"), "stage", "type", "status",
        F.col("duration_ms").cast("long").alias("duration_ms"), col(order).alias("at"))
    last = events.groupBy("run").agg(F.max("at").alias("last"))
    here = Window.partitionBy("run", "stage").orderBy("at")
    met = events.withColumns({"after": F.lead(F.struct("type", "status", "duration_ms")).over(here), "before": F.lag("type").over(here)})
    met = met.join(last.withColumnRenamed("run", "of"), F.col("run").eqNullSafe(F.col("of")))
    start, ended = F.col("type") == "stage_start", F.coalesce(F.col("after.type") == "stage_end", F.lit(False))
    state = (F.when(start & ended, F.col("after.status")).when(start & (F.col("at") < F.col("last")), "crashed").when(start, "open")
             .otherwise(F.col("status")))
    lone_end = ~start & ~F.coalesce(F.col("before") == "stage_start", F.lit(False))
    return met.where(start | lone_end).select("run", "stage", state.alias("state"),
                                              F.when(start, F.when(ended, F.col("after.duration_ms"))).otherwise(F.col("duration_ms")).alias("duration_ms"))


def stage_durations(log: DataFrame, order: str | None = None, run: str | None = None) -> DataFrame:
    """``(stage, runs, failed, total_ms, max_ms)`` from the stage-end events of a run log.

    With ``order``, a column of the place of an event, starts count too: ``crashed`` and ``open`` are the runs of a stage that has
    no end, as ``stage_spans`` tells them.
    """
    if order:
        spans, more = stage_spans(log, order, run), [F.count_if(F.col("state") == s).alias(s) for s in ("crashed", "open")]
    else:
        spans, more = log.where(F.col("type") == "stage_end").withColumn("state", F.col("status")), []
    duration = F.col("duration_ms").cast("long")
    return spans.groupBy("stage").agg(
        F.count(F.lit(1)).alias("runs"), F.count_if(F.col("state") == "failed").alias("failed"), *more,
        F.coalesce(F.sum(duration), F.lit(0)).alias("total_ms"), F.max(duration).alias("max_ms"))
