"""Background runs of a plan over a project, with a log of states that outlives the driver.

Every change of a job's state is a row in a folder of its own (jobs write at the
same time), in any store that Spark writes; nothing is changed or removed. A job's state is its
last row, so any driver can read it. A job runs under its id as job tag: cancel
stops what runs under it, on whatever thread, and no later step begins.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import mapping
from ..runtime import scratch
from ..sources.files import project
from .entries import map_project

# The states of a job.
PROCESSING, COMPLETED, FAILED = "processing", "completed", "failed"
STATE = "job_id string, at long, owner string, status string, message string, warning string, error string, results_file string"


class Cancelled(Exception):
    """The job was cancelled."""


@dataclass
class Jobs:
    """Jobs of one driver over a shared log.

    plan: session and folder to mapped methods.
    """

    spark: SparkSession
    log: str | None = None
    plan: Callable[[SparkSession, str], DataFrame] = map_project
    threads: dict[str, threading.Thread] = field(default_factory=dict)
    stops: dict[str, threading.Event] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.log = self.log or scratch(self.spark, "jobs")
        self.owner = self.spark.sparkContext.applicationId

    def submit(self, source_type: str, path: str, output: str, credentials: str | None = None) -> str:
        job = str(uuid.uuid4())
        self._say(job, PROCESSING)
        self.stops[job] = threading.Event()
        self.threads[job] = threading.Thread(target=self._run, args=(job, source_type, path, output, credentials), daemon=True)
        self.threads[job].start()
        return job

    def states(self) -> DataFrame:
        """The last state of each job, of this driver and of others."""
        try:
            d = self.spark.read.schema(STATE).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(self.log)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            d = self.spark.createDataFrame([], STATE)
        rest = [c for c in d.columns if c != "job_id"]
        return d.groupBy("job_id").agg(F.max_by(F.struct(*rest), "at").alias("_s")).select("job_id", "_s.*")

    def status(self, job: str) -> dict:
        row = self.states().where(F.col("job_id") == job).first()
        if row is None:
            raise KeyError(job)
        return {k: row[k] for k in ("status", "message", "warning", "error", "results_file") if row[k] is not None}

    def cancel(self, job: str, wait: float = 30.0) -> None:
        """Stop a job of this driver; it ends as failed."""
        if job not in self.threads:
            raise KeyError(job)
        self.stops[job].set()
        end = time.monotonic() + wait
        while self.threads[job].is_alive() and time.monotonic() < end:
            self.spark.sparkContext.cancelJobsWithTag(job)
            self.threads[job].join(0.2)

    def give_up_lost(self) -> int:
        """End the jobs that another driver began and did not end, as failed; their number. For when that driver is gone."""
        lost = [r.job_id for r in self.states().where((F.col("status") == PROCESSING) & (F.col("owner") != self.owner)).collect()]
        for job in lost:
            self._say(job, FAILED, error="the driver of this job is gone")
        return len(lost)

    def _say(self, job: str, status: str, **more: str) -> None:
        row = {"job_id": job, "at": time.time_ns(), "owner": self.owner, "status": status, **more}
        self.spark.createDataFrame([row], STATE).coalesce(1).write.json(f"{self.log}/{job}/{row['at']}-{status}")

    def _run(self, job: str, source_type: str, path: str, output: str, credentials: str | None) -> None:
        def go_on() -> None:
            if self.stops[job].is_set():
                raise Cancelled("cancelled")

        try:
            with project(source_type, path, credentials) as folder:
                self.spark.sparkContext.addJobTag(job)
                try:
                    go_on()
                    mapped = self.plan(self.spark, folder).persist()
                    try:
                        nothing = mapped.isEmpty()
                        go_on()
                        if not nothing:
                            mapping.mapped_json(mapping.by_class(mapped)).coalesce(1).write.mode("overwrite").text(output)
                    finally:
                        mapped.unpersist()
                    go_on()
                finally:
                    self.spark.sparkContext.removeJobTag(job)
            if nothing:
                self._say(job, COMPLETED, warning="nothing was extracted")
            else:
                self._say(job, COMPLETED, message="mapping is complete", results_file=output)
        except Exception as e:  # noqa: BLE001 - the state carries any failure to the caller
            said = "cancelled" if self.stops[job].is_set() else f"{type(e).__name__}: {e}"[:500]
            self._say(job, FAILED, error=said)
