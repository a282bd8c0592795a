"""Session construction and the shared scratch location."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path
from typing import TypeVar

from pyspark.sql import SparkSession
from pyspark.util import inheritable_thread_target

T = TypeVar("T")

_LOCAL_FALLBACK: dict[str, str] = {}
_ROOT = str(Path(__file__).resolve().parents[1])


def build_session(app: str = "tidemark", master: str | None = None,
                  **conf: str) -> SparkSession:
    """A session with the settings every job here relies on.

    Adaptive execution sizes shuffles at run time; ``spark.sql.shuffle.partitions``
    is therefore only an upper bound and is left to the cluster unless passed in.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local-mode session may fall back to a temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_FALLBACK:
        _LOCAL_FALLBACK[app] = tempfile.mkdtemp(prefix="tidemark-")
    return _LOCAL_FALLBACK[app]


def at_once(spark: SparkSession, *tasks: Callable[[], T]) -> list[T]:
    """What each task returns, in order; independent jobs run side by side and fill the cluster together.

    All tasks have ended when this returns or raises the first one's error.
    """
    with ThreadPoolExecutor(max(len(tasks), 1)) as pool:
        running = [pool.submit(inheritable_thread_target(spark)(task)) for task in tasks]
    return [r.result() for r in running]


def ready(spark: SparkSession) -> None:
    """Lets Python workers import this package where the path is shared."""
    known = spark.sparkContext.environment
    parts = [x for x in known.get("PYTHONPATH", "").split(":") if x]
    if _ROOT not in parts:
        known["PYTHONPATH"] = ":".join([_ROOT, *parts])


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
