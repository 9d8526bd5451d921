"""A time limit for the jobs of one call."""

from __future__ import annotations

import logging
import threading
import uuid

from pyspark.sql import SparkSession

log = logging.getLogger("skeinmatch")


def within(spark: SparkSession, seconds: float, run):
    """run(), whose Spark jobs are cancelled after so many seconds; then TimeoutError."""
    context, group, over = spark.sparkContext, f"skeinmatch-{uuid.uuid4().hex}", threading.Event()

    def stop():
        over.set()
        log.warning("time limit of %g s reached, cancelling", seconds)
        context.cancelJobGroup(group)

    timer = threading.Timer(seconds, stop)
    context.setJobGroup(group, "bounded run", interruptOnCancel=True)
    timer.start()
    try:
        return run()
    except Exception as e:
        if over.is_set():
            raise TimeoutError(f"not done within {seconds:g} s") from e
        raise
    finally:
        timer.cancel()
        context.setLocalProperty("spark.jobGroup.id", None)
        context.setLocalProperty("spark.job.description", None)
