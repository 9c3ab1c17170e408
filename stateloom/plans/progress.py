"""Lines on the progress of a long job, from Spark's own count of finished tasks."""

from __future__ import annotations

import sys
import threading
import time

from pyspark.sql import SparkSession


class Progress:
    """While the block runs, every ``interval`` seconds a line: states processed, of how many, and how many a second.

    Processed states are the share of finished tasks of the job's first stage
    that has run; a task counts when it ends.
    """

    def __init__(self, spark: SparkSession, what: str, states: int, interval: float = 60.0, tell=None):
        if interval <= 0:
            raise ValueError(f"an interval of {interval} seconds")
        self.context, self.what, self.states, self.interval = spark.sparkContext, what, states, interval
        self.tell = tell or (lambda line: print(line, file=sys.stderr, flush=True))
        self.group = f"progress {what} {id(self)}"
        self.ended = threading.Event()

    def __enter__(self) -> Progress:
        self.began = time.monotonic()
        self.before = self.context.getLocalProperty("spark.jobGroup.id"), self.context.getLocalProperty("spark.job.description")
        self.context.setJobGroup(self.group, self.what)
        self.thread = threading.Thread(target=self._watch, daemon=True)
        self.thread.start()
        return self

    def __exit__(self, *_: object) -> None:
        self.ended.set()
        self.thread.join()
        for name, value in zip(("spark.jobGroup.id", "spark.job.description"), self.before, strict=True):
            self.context.setLocalProperty(name, value)

    def share(self) -> float:
        """Of the earliest stage's tasks those that have ended; 0 before it starts."""
        tracker = self.context.statusTracker()
        jobs = [tracker.getJobInfo(job) for job in tracker.getJobIdsForGroup(self.group)]
        stages = [tracker.getStageInfo(s) for s in sorted(s for job in jobs if job for s in job.stageIds)]
        known = [s for s in stages if s and s.numTasks]
        return known[0].numCompletedTasks / known[0].numTasks if known else 0.0

    def line(self) -> str:
        done, passed = int(self.states * self.share()), time.monotonic() - self.began
        return f"{self.what}: {done:,} of {self.states:,} states processed, {done / max(passed, 1e-9):,.0f} a second"

    def _watch(self) -> None:
        while not self.ended.wait(self.interval):
            self.tell(self.line())
