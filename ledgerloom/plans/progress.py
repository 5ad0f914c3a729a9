"""How far a run is, while it runs."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

#: A run is at LAST at most until it is done.
LAST, DONE = 99, 100


class Watch:
    """Calls back with (percent, phase) from a thread of its own, each time the percent rises.

    A run has phases of equal weight; within one the share of its tasks that are done counts, as
    Spark's status tracker knows them: a task that was tried twice is one task, and a stage that runs
    again doesn't take anything back. The last call is (100, last phase); none if the run fails.
    """

    def __init__(self, spark: SparkSession, phases: list[str], callback: Callable[[int, str], None], every: float = 0.2):
        self.spark, self.phases, self.callback, self.every = spark, phases, callback, every
        self.at, self.best = -1, -1
        self.group = ""
        self.lock, self.over = threading.Lock(), threading.Event()
        self.thread = threading.Thread(target=self._poll, daemon=True)

    def phase(self) -> None:
        """The next phase begins: the jobs that this thread starts from now on belong to it."""
        with self.lock:
            self.at += 1
            self.group = f"progress-{uuid.uuid4().hex}"
        self.spark.sparkContext.setJobGroup(self.group, self.phases[self.at])
        self._tell(0.0)

    def share(self, group: str) -> float:
        """The share of the tasks of a phase's jobs that are done."""
        tracker = self.spark.sparkContext.statusTracker()
        done = total = 0
        for job in tracker.getJobIdsForGroup(group):
            info = tracker.getJobInfo(job)
            for stage in info.stageIds if info else ():
                tasks = tracker.getStageInfo(stage)
                if tasks:  # a stage that is skipped has none
                    total += tasks.numTasks
                    done += min(tasks.numTasks, tasks.numTasks if info.status == "SUCCEEDED" else tasks.numCompletedTasks)
        return done / total if total else 0.0

    def _tell(self, share: float) -> None:
        with self.lock:
            percent = min(LAST, int(DONE * (max(self.at, 0) + min(share, 1.0)) / len(self.phases)))
            if percent > self.best:
                self.best = percent
                self.callback(percent, self.phases[max(self.at, 0)])

    def _poll(self) -> None:
        while not self.over.wait(self.every):
            with self.lock:
                at, group = self.at, self.group
            if group:
                share = self.share(group)
                if at == self.at:
                    self._tell(share)

    def __enter__(self) -> "Watch":
        self.thread.start()
        return self

    def __exit__(self, kind, *_) -> None:
        self.over.set()
        self.thread.join()
        self.spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        if kind is None:
            self.callback(DONE, self.phases[-1])
