"""A run's journal: facts about its steps as JSON lines, which ``files.json_lines`` reads back as a table.

Whoever has something to say puts it in an inbox; one writer empties it. The writer is the only one that
touches the file and the only clock: when its inbox stays empty for ``beat`` seconds, it writes a
sign of life for every open step, with whatever ``progress`` tells of it.
"""

from __future__ import annotations

import json
import queue
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from datetime import UTC, datetime
from pathlib import Path
from typing import Any

from pyspark.sql import SparkSession

#: What is put in the inbox to close it.
_OVER = None


def spark_progress(spark: SparkSession) -> Callable[[], dict[str, int]]:
    """Counts of stages at work and of their tasks, for signs of life."""
    tracker = spark.sparkContext.statusTracker()

    def counts() -> dict[str, int]:
        infos = [i for i in map(tracker.getStageInfo, tracker.getActiveStageIds()) if i]
        return {"stages": len(infos), "tasks": sum(i.numTasks for i in infos), "tasks_done": sum(i.numCompletedTasks for i in infos)}

    return counts


class Journal:
    """Use as a context: what was noted is on disk when it ends."""

    def __init__(self, path: str | Path, beat: float = 15.0, progress: Callable[[], dict[str, Any]] = dict):
        self._inbox: queue.SimpleQueue = queue.SimpleQueue()
        self._open: dict[str, float] = {}
        self._path, self._beat, self._progress, self._zero = Path(path), beat, progress, time.monotonic()

    def __enter__(self) -> Journal:
        self._pool = ThreadPoolExecutor(1)
        self._written = self._pool.submit(self._write)
        return self

    def __exit__(self, *_: object) -> None:
        self._inbox.put(_OVER)
        self._written.result()
        self._pool.shutdown()

    def note(self, kind: str, **facts: Any) -> None:
        """Facts that JSON can hold, NaN and infinities excluded; others fail here and not in the writer."""
        stamp = {"kind": kind, "time_utc": datetime.now(UTC).isoformat(timespec="milliseconds"), "elapsed_s": round(time.monotonic() - self._zero, 3)}
        self._inbox.put(json.dumps(facts | stamp, allow_nan=False))

    def run(self, step: str, work: Callable[[], Any]) -> Any:
        """The result of ``work``, its begin and its end or error noted."""
        self._open[step] = time.monotonic()
        self.note("begin", step=step)
        failure = "stopped"
        try:
            result = work()
            failure = ""
            return result
        except Exception as e:
            failure = type(e).__name__
            raise
        finally:
            took = round(time.monotonic() - self._open.pop(step), 3)
            self.note("error" if failure else "end", step=step, step_s=took, **({"error": failure} if failure else {}))

    def _write(self) -> None:
        with self._path.open("a") as out:
            while True:
                try:
                    line = self._inbox.get(timeout=self._beat)
                except queue.Empty:
                    now = time.monotonic()
                    for step, began in list(self._open.items()):
                        self.note("alive", step=step, step_s=round(now - began, 3), **self._progress())
                    continue
                if line is _OVER:
                    return
                out.write(line + "\n")
                out.flush()
