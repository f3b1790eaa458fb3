"""Jobs: states that another driver reads, cancellation, failures."""

from __future__ import annotations

import json
import subprocess
import sys
import time
from pathlib import Path

import pytest

from sparkloom.plans import jobs as J
from sparkloom.plans.entries import map_project

SHOP = "class OrderView(View):\n    def get(self, request):\n        return order_service.load(1)\nclass OrderService:\n    def load(self, n):\n        return n\n"


@pytest.fixture
def tree(tmp_path):
    (tmp_path / "shop").mkdir()
    (tmp_path / "shop" / "views.py").write_text(SHOP)
    (tmp_path / "empty").mkdir()
    return tmp_path / "shop"


def ended(jobs: J.Jobs) -> None:
    for t in jobs.threads.values():
        t.join(120)
        assert not t.is_alive()


def test_states(spark, tree, tmp_path):
    jobs = J.Jobs(spark, str(tmp_path / "log"))
    assert jobs.states().count() == 0
    good, bad, none = (jobs.submit("local", str(p), str(tmp_path / o)) for p, o in ((tree, "out"), (tmp_path / "no", "o2"), (tmp_path / "empty", "o3")))
    ended(jobs)
    assert jobs.status(good) == {"status": "completed", "message": "mapping is complete", "results_file": str(tmp_path / "out")}
    assert "OrderView" in json.loads(spark.read.text(str(tmp_path / "out")).first()[0])
    assert jobs.status(bad)["status"] == "failed" and "no such folder" in jobs.status(bad)["error"]
    assert jobs.status(none) == {"status": "completed", "warning": "nothing was extracted"} and not (tmp_path / "o3").exists()
    with pytest.raises(KeyError):
        jobs.status("x")
    # a second reader of the same log, as after a restart, sees them all; nothing was rewritten
    again = J.Jobs(spark, str(tmp_path / "log"))
    assert again.status(good)["status"] == "completed" and len(list((tmp_path / "log").rglob("part-*.json"))) == 6


def slow(spark, folder):
    """The plan, behind rows that take their time."""

    def wait(batches):
        for b in batches:
            time.sleep(60)
            yield b

    d = map_project(spark, folder)
    return d.mapInArrow(wait, d.schema)


def test_cancel(spark, tree, tmp_path):
    jobs = J.Jobs(spark, str(tmp_path / "log"), plan=slow)
    job = jobs.submit("local", str(tree), str(tmp_path / "out"))
    time.sleep(4)
    assert jobs.status(job) == {"status": "processing"}
    start = time.monotonic()
    jobs.cancel(job)
    ended(jobs)
    assert time.monotonic() - start < 30
    assert jobs.status(job) == {"status": "failed", "error": "cancelled"} and not (tmp_path / "out").exists()
    with pytest.raises(KeyError):
        jobs.cancel("x")


def test_another_driver(spark, tmp_path):
    log = str(tmp_path / "log")
    code = f"""
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.app.id", "gone").getOrCreate()
from sparkloom.plans.jobs import Jobs
jobs = Jobs(spark, {log!r})
jobs._say("done", "completed", message="mapping is complete")
jobs._say("cut", "processing")
"""
    root = str(Path(__file__).resolve().parent.parent)
    subprocess.run([sys.executable, "-c", code], check=True, cwd=root, timeout=200, capture_output=True)
    jobs = J.Jobs(spark, log)
    assert jobs.status("done") == {"status": "completed", "message": "mapping is complete"} and jobs.status("cut") == {"status": "processing"}
    assert jobs.give_up_lost() == 1 and jobs.give_up_lost() == 0
    assert jobs.status("cut")["status"] == "failed" and jobs.status("done")["status"] == "completed"
