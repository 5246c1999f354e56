"""State that ages: stores that are claimed once, preferences that expire, progress of jobs, what sessions have open."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def claimed(records: DataFrame, now: str, hours: float = 1.0) -> DataFrame:
    """Records (key, at, id) that a claim gets at the time `now`: of each key the newest that hasn't expired, once."""
    age = F.lit(now).cast("timestamp_ntz").cast("timestamp").cast("double") - F.col("at").cast("timestamp").cast("double")
    fresh = records.where((age >= 0) & (age <= hours * 3600))
    best = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("at"), F.desc("id")))
    return fresh.withColumn("k", best).where("k = 1").drop("k")


def live(preferences: DataFrame, now: str, version: int, days: int = 365) -> DataFrame:
    """Preferences (key, saved, version, value) of this version that haven't expired."""
    return preferences.where((F.col("version") == version) & (F.col("saved") + F.expr(f"interval {days} days") > F.lit(now).cast("timestamp_ntz")))


def progress(messages: DataFrame, job: int) -> DataFrame:
    """The latest progress (job, seq, done, total, label) of one job; messages of other jobs are stale."""
    return messages.where(F.col("job") == job).groupBy("job").agg(F.max_by(F.struct("done", "total", "label"), "seq").alias("p")).select("job", "p.done", "p.total", "p.label")


def open_documents(events: DataFrame) -> DataFrame:
    """session, file: what each session has open after its events (session, seq, kind, file): open, close, end."""
    ends = events.where("kind = 'end'").groupBy("session").agg(F.max("seq").alias("end"))
    last = events.where("kind <> 'end'").groupBy("session", "file").agg(F.max_by("kind", "seq").alias("kind"), F.max("seq").alias("seq"))
    return last.join(ends, "session", "left").where("kind = 'open' and (end is null or seq > end)").select("session", "file")
