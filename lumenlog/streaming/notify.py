"""Webhook delivery of alerts, and metrics of running streams."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from lumenlog.config import Webhook


def post(url: str, body: bytes, headers: dict[str, str], timeout: float) -> None:
    """One POST; OSError where it fails or isn't answered with success."""
    request = urllib.request.Request(url, body, {"Content-Type": "application/json", **headers}, method="POST")
    with urllib.request.urlopen(request, timeout=timeout) as answer:
        if answer.status >= 300:
            raise urllib.error.URLError(f"status {answer.status}")


def send_alerts(alerts: DataFrame, hook: Webhook, send: Callable[..., None] = post, pause: Callable[[float], None] = time.sleep) -> tuple[int, int]:
    """Posts CRITICAL alerts, each at most 1 + max_retries times; (delivered, failed). Failed ones are appended to the dead-letter file.

    Alerts are fetched partition by partition, so the driver never holds them all.
    """
    return _posted(alerts.filter("severity = 'CRITICAL'").select(F.struct(*alerts.columns).alias("doc")), hook, "alert", send, pause)


def send_changes(changes: DataFrame, hook: Webhook, send: Callable[..., None] = post, pause: Callable[[float], None] = time.sleep) -> tuple[int, int]:
    """Posts resolved alerts (of operators.alerts.resolutions) of any severity as changes of status, as send_alerts does."""
    about = [c for c in changes.columns if c not in ("old_status", "new_status", "nth")]
    doc = F.struct(F.lit("status_change").alias("type"), "alert_id", "old_status", "new_status", F.current_timestamp().alias("timestamp"), F.struct(*about).alias("alert"))
    return _posted(changes.select(doc.alias("doc")), hook, "payload", send, pause)


def _posted(docs: DataFrame, hook: Webhook, key: str, send: Callable[..., None], pause: Callable[[float], None]) -> tuple[int, int]:
    done = failed = 0
    for row in docs.select(F.to_json("doc", {"ignoreNullFields": "false"}).alias("json")).toLocalIterator():
        error = None
        for attempt in range(1 + hook.max_retries if hook.url else 0):
            try:
                send(hook.url, row.json.encode(), dict(hook.headers), hook.timeout_seconds)
                error = ""
                break
            except OSError as e:
                error = str(e)
                if attempt < hook.max_retries:
                    pause(hook.retry_interval_seconds)
        done, failed = done + (error == ""), failed + bool(error)
        if error and hook.dead_letter_file:
            with open(hook.dead_letter_file, "a") as f:
                f.write(json.dumps({key: json.loads(row.json), "error": error}) + "\n")
    return done, failed


class Metrics(StreamingQueryListener):
    """Appends one JSON line for each finished micro-batch: rows, rates, batch time; beat, where given, gets each line too."""

    def __init__(self, path: str, beat: Callable[[str], None] | None = None):
        self.path, self.beat, self.total = path, beat, {}

    def counted(self, progress) -> dict:
        """What the micro-batch has counted as records passed, its share of errors, and the lines of the query so far."""
        row = (progress.observedMetrics or {}).get("records")
        if row is None:
            return {}
        told = row.asDict()
        self.total[str(progress.id)] = self.total.get(str(progress.id), 0) + told["lines"]
        return {**told, "error_rate": round(told["errors"] / told["lines"], 4) if told["lines"] else 0.0, "total_lines": self.total[str(progress.id)]}

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        line = json.dumps({"query": str(p.id), "batch": p.batchId, "at": p.timestamp, "rows": p.numInputRows, "rows_per_second": p.processedRowsPerSecond, "batch_ms": p.batchDuration, **self.counted(p)})
        with open(self.path, "a") as f:
            f.write(line + "\n")
        if self.beat:
            self.beat(line)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass
