"""Command line: run, init, validate, list-rules, detect, anomaly replay|rules|alerts|feedback|status|reset, stream."""

from __future__ import annotations

import argparse
import dataclasses
import json
import sys
import time
from collections.abc import Callable, Iterable, Sequence
from itertools import islice

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlog.config import Settings, load
from lumenlog.operators import alerts as A
from lumenlog.operators import pipeline as L
from lumenlog.operators.anchored import spread_alerts
from lumenlog.operators.detect import BUILTIN, Rule, sanitize
from lumenlog.operators.detectors import DetectorConfig, anchored_alerts
from lumenlog.operators.mapping import MappingStore, mapped_records
from lumenlog.operators.parse import parse_lines
from lumenlog.session import ship
from lumenlog.sources.tail import TailSource
from lumenlog.sources.named import write_named
from lumenlog.sources.replay import replay_stream
from lumenlog.sources.resume import FileRange, Manifest, newest, plan, put_manifest, read_ranges, went_on
from lumenlog.sources.text import input_files, read_alerts, read_feedback, read_lines, read_log, read_sanitized, write_alerts, write_log, write_records
from lumenlog.streaming.judge import StreamJudge, start_alerts
from lumenlog.streaming.keyed import ask_reset, stream_status
from lumenlog.streaming.live import batch_name, live_records, parsed_records, start_routed, stream_counts, stream_lines
from lumenlog.streaming.notify import Metrics, send_alerts, send_changes

TEMPLATE = """name: logs
inputs:
  paths: ["./logs"]
parser:
  format: auto
sanitizers:
  builtin_rules: []
  custom_rules: []
output:
  file: ./output
report_json: ./report.json
anomaly_detection:
  enabled: false
"""


@dataclasses.dataclass
class Run:
    """A run that goes on from earlier ones: what they have done, the ranges that it reads and how many lines these have, and how many files have nothing new."""

    known: Manifest
    files: list[FileRange] = dataclasses.field(default_factory=list)
    lines: dict[str, int] = dataclasses.field(default_factory=dict)
    skipped: int = 0

    @property
    def number(self) -> int:
        return self.known.number + 1

    def folder(self, path: str) -> str:
        return f"{path}/run={self.number}"

    def commit(self, spark: SparkSession, s: Settings) -> None:
        put_manifest(spark, f"{s.state_file}/runs", went_on(self.known, self.files, self.lines))


def next_run(spark: SparkSession, s: Settings) -> Run | None:
    return Run(newest(spark, f"{s.state_file}/runs")) if s.state_file else None


def read_records(spark: SparkSession, s: Settings, run: Run | None = None) -> DataFrame:
    """Parsed records of the inputs, and whether the filters keep them. In a numbered run only what earlier ones haven't read."""
    files = input_files(spark, list(s.paths), s.recursive)
    if run:
        run.files, run.skipped = plan(files, run.known, s.encoding, s.idle_seconds)
        lines, run.lines = read_ranges(spark, run.files)
    else:
        lines = read_lines(spark, files, encoding=s.encoding, sizes=True)
    return L.mark_kept(parse_lines(lines, s.fmt, s.year, s.custom, s.names), **s.filters)


def tail_lines(spark: SparkSession, s: Settings) -> DataFrame:
    """Lines appended to the input files."""
    spark.dataSource.register(TailSource)
    return spark.readStream.format("line_tail").option("paths", ",".join(s.paths)).option("max_line_length", s.max_line_length).load()


def current_rules(path: str, rules: Sequence[Rule]) -> Callable[[], Sequence[Rule]]:
    """The rules of the configuration as it is at each call; the last good ones, at first rules, where it can't be read or is wrong."""
    import yaml

    last = [rules]

    def read() -> Sequence[Rule]:
        try:
            last[0] = load(path).rules
        except (OSError, ValueError, TypeError, KeyError, AttributeError, yaml.YAMLError) as e:
            print(f"configuration: {e}; the rules before stay", file=sys.stderr)
        return last[0]

    return read


def report(records: DataFrame) -> tuple[dict, dict[str, int], dict[str, int]]:
    """Totals, detections by kind and by field: small aggregates, collected."""
    totals = L.audit_report(L.file_stats(records, F.col("kept") if "kept" in records.columns else None)).first().asDict()
    kinds = {r.kind: r.n for r in L.detection_counts(records).filter("source_file IS NULL AND kind IS NOT NULL").collect()}
    return totals, kinds, {r.field: r.n for r in L.top_fields(records).collect()}


def judged_alerts(records: DataFrame, s: Settings, run: Run | None = None, by_time: bool = False) -> DataFrame:
    """Alerts of records after deduplication, correlation and the suppression rules, with a stable alert_id. In a numbered run the detectors go on
    from where the last one left each source, and their new states are kept."""
    spark, states = records.sparkSession, f"{s.state_file}/detectors"
    config = tuned(spark, s)
    if run:
        both = anchored_alerts(records, config, read_log(spark, states, "source", run.known.number), save=True, by_time=by_time).persist(StorageLevel.DISK_ONLY)
        write_log(both.filter("state IS NOT NULL").select("source", "state"), states, run.number)
        found = both.filter("state IS NULL").drop("state")
    else:
        found = spread_alerts(records, config) if s.spread_sources and not by_time else anchored_alerts(records, config, by_time=by_time)
    found = A.correlate(A.dedup(found, s.dedup_seconds), s.correlate_seconds)
    out = A.release(A.apply_suppression(found, s.suppression)).drop("rule", "action", "delay_seconds")
    return A.with_ids(out)


def tuned(spark: SparkSession, s: Settings) -> DetectorConfig:
    """The detectors' configuration with the thresholds that feedback has moved: one for each (detector, source) that somebody judged."""
    d = s.detectors
    if not (s.feedback_file and s.alert_file):
        return d
    try:
        moved = A.tuned_thresholds(read_feedback(spark, s.feedback_file), read_alerts(spark, s.alert_file), by_detector={"frequency": d.multiplier, "error_rate": d.z_threshold}).collect()
    except AnalysisException:  # no feedback or no alerts yet
        return d
    return dataclasses.replace(d, overrides={**d.overrides, **{(r.detector, r.source): r.threshold for r in moved}})


def tell_resolved(spark: SparkSession, s: Settings, folder: str | None) -> int:
    """Posts the alerts that feedback has resolved since the last time to the webhook; how many. Those that folder names were posted before; a run that
    dies in between posts again. Without a folder to keep them in nothing is posted."""
    if not (folder and s.webhook.url and s.alert_file and s.feedback_file):
        return 0
    try:
        found = A.resolutions(read_alerts(spark, s.alert_file).dropDuplicates(["alert_id"]), read_feedback(spark, s.feedback_file))
    except AnalysisException:  # no alerts yet
        return 0
    try:
        found = found.join(spark.read.schema("alert_id string, nth int").json(folder), ["alert_id", "nth"], "left_anti")
    except AnalysisException:  # nothing posted yet
        pass
    found = found.persist(StorageLevel.DISK_ONLY)
    try:
        if told := found.count():
            send_changes(found, s.webhook)
            found.select("alert_id", "nth").write.mode("append").json(folder)
        return told
    finally:
        found.unpersist()


def stream_judge(spark: SparkSession, s: Settings, checkpoint: str, live: bool) -> StreamJudge:
    """Judges the alerts of a stream's micro-batches, with what waits beside the checkpoint's; alerts go to the alert file and, where critical, to the webhook."""

    def emit(alerts: DataFrame, number: int) -> None:
        if s.alert_file:
            write_alerts(alerts, s.alert_file, batch_name(checkpoint, number))
        if s.webhook.url:
            send_alerts(alerts, s.webhook)
            tell_resolved(spark, s, f"{checkpoint}/anomaly/told")

    return StreamJudge(f"{checkpoint}/anomaly", emit, s.suppression, s.dedup_seconds, s.correlate_seconds, clock=time.time if live else None)


def run(spark: SparkSession, s: Settings) -> dict:
    """The batch run of a configuration; its totals. Values are detected once: what several outputs read is kept on the executors' disks,
    and computed again where an executor is lost. All lines count, only those that the filters keep are sanitized and written."""
    run, begun = next_run(spark, s), time.monotonic()
    found = L.detected_records(read_records(spark, s, run), s.rules, s.sanitize_unparseable)
    if s.mapping and not s.dry_run:
        found = mapped_records(found.persist(StorageLevel.DISK_ONLY), MappingStore(s.mapping, s.mapping_key))
    records = L.spliced_records(found).persist(StorageLevel.DISK_ONLY)
    try:
        totals = _outputs(records, s, run, begun)
        if run and not s.dry_run:
            run.commit(spark, s)
        return totals
    finally:
        records.unpersist()
        found.unpersist()


def _outputs(every: DataFrame, s: Settings, run: Run | None, begun: float) -> dict:
    records = every.filter("kept")
    if s.dry_run:
        L.preview(records).show(truncate=False)
    else:
        if s.file:
            own = run and not s.overwrite
            if s.template or s.pretty:
                write_named(L.standard(records), run.folder(s.file) if own else s.file, s.template or "output.jsonl", s.split, s.pretty, bool(own) or s.overwrite)
            else:
                write_records(L.standard(records), run.folder(s.file) if own else s.file, "overwrite" if own or s.overwrite else "append", s.split)
        if s.stdout:
            for row in L.standard(records).select("json").toLocalIterator():
                print(json.dumps(json.loads(row.json), ensure_ascii=False, indent=2) if s.pretty else row.json)
        if s.audit_file:
            L.audit_log(records).write.mode("overwrite" if run else "append").json(run.folder(s.audit_file) if run else s.audit_file)
        if s.anomaly and s.alert_file:
            alerts = judged_alerts(records, s, run)
            write_alerts(alerts, s.alert_file, f"run-{run.number}" if run else None)
            if s.webhook.url:
                send_alerts(alerts, s.webhook)
                tell_resolved(every.sparkSession, s, f"{s.state_file}/told" if run else None)
    totals, kinds, fields = report(every)
    took = time.monotonic() - begun
    totals |= {"skipped_files": run.skipped if run else 0, "seconds": round(took, 2), "lines_per_second": round((totals["total_lines"] or 0) / took, 1)}
    files = (r.asDict() for r in L.file_report(every, F.col("kept")).toLocalIterator())
    if s.report_json:
        with open(s.report_json, "w") as f:
            skipped = [x.name for x in run.files if x.begin >= x.stop] if run else []
            json.dump({"summary": totals, "detections": kinds, "fields": fields, "files": list(files), "skipped": skipped}, f, default=str)
        files = (r.asDict() for r in L.file_report(every, F.col("kept")).toLocalIterator())
    if s.report_file:
        with open(s.report_file, "w") as f:
            f.writelines(line + "\n" for line in L.render_report(totals, kinds, fields, files))
    return totals


def pipe(spark: SparkSession, s: Settings, lines: Iterable[str], rows: int = 50_000) -> int:
    """Sanitizes lines of a pipe, some at a time, and appends them to their targets; how many there were. The driver holds rows lines."""
    done, each = 0, iter(lines)
    while chunk := list(islice(each, rows)):
        frame = spark.createDataFrame([("stdin", done + k, x) for k, x in enumerate(chunk, 1)], "source_file string, line_no long, raw string")
        out = live_records(frame, s.fmt, s.rules, s.custom, s.names, s.year, **s.filters).withColumn("target", L.route(s.routes, s.file)).persist()
        for target in sorted({s.file, *(t for _, t in s.routes)}):
            out.filter(F.col("target") == target).select(F.col("json").alias("value")).write.mode("append").text(target)
        out.unpersist()
        done += len(chunk)
    return done


def detector_status(spark: SparkSession, s: Settings) -> list[dict]:
    """The detectors' stored state of each source: windows, statistics and how many templates it knows."""
    run = next_run(spark, s)
    states = read_log(spark, f"{s.state_file}/detectors", "source", run.known.number) if run else None
    out = []
    for row in states.orderBy("source").toLocalIterator() if states is not None else ():
        told = json.loads(row.state)
        out.append({"source": row.source, "seen": told["seen"], "ewma": told["ewma"], "rates": len(told["rates"]), "templates": len(told["known"]), "absent": len(told["absent"]), "frequency_threshold": s.detectors.threshold("frequency", row.source), "error_rate_threshold": s.detectors.threshold("error_rate", row.source)})
    return out


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser("lumenlog")
    sub = top.add_subparsers(dest="command", required=True)
    for name, help_ in (("run", "batch run"), ("validate", "check a configuration"), ("stream", "run over new files until stopped")):
        p = sub.add_parser(name, help=help_)
        p.add_argument("-c", "--config", required=True)
        if name == "run":
            p.add_argument("-i", "--input", action="append")
            p.add_argument("-o", "--output")
            p.add_argument("--dry-run", action="store_true")
        if name == "stream":
            p.add_argument("--checkpoint", help="needed but for --pipe")
            p.add_argument("--once", action="store_true", help="what is there, then stop")
            p.add_argument("--tail", action="store_true", help="follow the lines that are appended to the inputs")
            p.add_argument("--pipe", action="store_true", help="read standard input to its end")
    sub.add_parser("init", help="write a configuration").add_argument("path")
    sub.add_parser("list-rules", help="built-in rules")
    p = sub.add_parser("detect", help="what the rules find in a text")
    p.add_argument("text", help="or with --file a path")
    p.add_argument("--file", action="store_true", help="search the first lines of files")
    p.add_argument("--limit", type=int, default=1000)
    p.add_argument("-c", "--config")
    anomaly = sub.add_parser("anomaly", help="alerts").add_subparsers(dest="what", required=True)
    for name in ("replay", "rules", "alerts", "feedback", "status", "reset"):
        p = anomaly.add_parser(name)
        p.add_argument("-c", "--config", required=True)
        if name == "replay":
            p.add_argument("path", help="sanitized JSON lines")
            p.add_argument("--speed", type=float, help="replay as a stream: seconds of event time let in each second")
            p.add_argument("--checkpoint", help="needed with --speed")
            p.add_argument("--seconds", type=int, help="how long the stream goes on")
        if name == "status":
            p.add_argument("--checkpoint", help="of a stream, whose state is told")
        if name == "reset":
            p.add_argument("source")
            p.add_argument("--checkpoint", help="of a stream, which drops the source's state with its next records")
        if name == "alerts":
            p.add_argument("--status")
            p.add_argument("--source")
            p.add_argument("--sort", choices=("timestamp", "severity", "source"), default="timestamp")
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Exit code: 0, or 1 with a message for a wrong configuration."""
    args = parser().parse_args(argv)
    if args.command == "init":
        with open(args.path, "x") as f:
            f.write(TEMPLATE)
        return 0
    if args.command == "list-rules":
        for r in BUILTIN:
            print(f"{r.name}\t{r.kind}\t{r.strategy}")
        return 0
    try:
        s = load(args.config) if getattr(args, "config", None) else None
    except (FileNotFoundError, ValueError, TypeError) as e:
        print(f"configuration: {e}", file=sys.stderr)
        return 1
    if args.command == "validate":
        print("configuration is valid")
        return 0
    if args.command == "anomaly" and args.what == "rules":
        for r in s.suppression:
            print(f"{r.name}\t{r.action}\t{'on' if r.enabled else 'off'}")
        return 0
    spark = ship(spark or SparkSession.builder.appName("lumenlog").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    if args.command == "run":
        s = dataclasses.replace(s, paths=tuple(args.input or s.paths), file=args.output or s.file, dry_run=args.dry_run or s.dry_run)
        try:
            print(json.dumps(run(spark, s), default=str))
        except ValueError as e:
            print(e, file=sys.stderr)
            return 1
    elif args.command == "detect" and args.file:
        rows = sanitize(read_lines(spark, args.text).filter(F.col("line_no") <= args.limit), "raw", s.rules if s else BUILTIN).filter(F.size("found") > 0)
        for row in rows.select(F.explode("found.kind").alias("kind")).groupBy("kind").count().orderBy("kind").collect():
            print(f"{row.kind}\t{row['count']}")
        for row in rows.orderBy("source_file", "line_no").limit(10).collect():
            print(f"{row.source_file}:{row.line_no}\t{row.sanitized[max(0, row.found[0].start - 20) : row.found[0].start + 20]}")
    elif args.command == "detect":
        row = sanitize(spark.createDataFrame([(args.text,)], "t string"), "t", s.rules if s else BUILTIN).first()
        for m in row.found:
            print(f"{m.kind}\t{m.value}")
        print(row.sanitized)
    elif args.command == "stream" and args.pipe:
        print(f"{pipe(spark, s, (x.rstrip(chr(10)) for x in sys.stdin))} lines", file=sys.stderr)
    elif args.command == "stream":
        if s.metrics_file:
            spark.streams.addListener(Metrics(s.metrics_file, lambda line: print(line, file=sys.stderr)))
        lines = tail_lines(spark, s) if args.tail else stream_lines(spark, s.paths, recursive=s.recursive)
        records = parsed_records(lines, s.fmt, s.custom, s.names, s.year, **s.filters)
        query = start_routed(records, s.routes, s.file, args.checkpoint, once=args.once, rules=current_rules(args.config, s.rules))
        if s.anomaly:  # a query of its own: the detectors see what is sanitized by the rules of the start
            judge = stream_judge(spark, s, args.checkpoint, args.tail)
            alerts = start_alerts(L.sanitize_records(records, s.rules), tuned(spark, s), judge, f"{args.checkpoint}/alerts", args.once, f"{args.checkpoint}/resets")
            if args.once:
                alerts.awaitTermination()
                judge.flush(spark)
        query.awaitTermination() if args.once else spark.streams.awaitAnyTermination()
    elif args.what == "status":
        if args.checkpoint:
            try:
                for row in stream_counts(spark, args.checkpoint).orderBy("source", "kind").toLocalIterator():
                    print(f"{row.source}\t{row.kind}\t{row.n:g}")
            except AnalysisException:  # a stream without records of its own
                pass
        for row in stream_status(spark, f"{args.checkpoint}/alerts") if args.checkpoint else detector_status(spark, s):
            print(json.dumps(row))
        if s.alert_file and s.feedback_file:
            for row in A.lifecycle(read_alerts(spark, s.alert_file), read_feedback(spark, s.feedback_file), s.max_resolved).groupBy("status").count().orderBy("status").collect():
                print(f"{row.status}\t{row['count']}")
    elif args.what == "reset" and args.checkpoint:
        ask_reset(spark, f"{args.checkpoint}/resets", args.source)
    elif args.what == "reset":
        this = next_run(spark, s)
        write_log(spark.createDataFrame([(args.source, None, True)], "source string, state string, removed boolean"), f"{s.state_file}/detectors", this.number)
        this.commit(spark, s)
    elif args.what == "replay" and args.speed:
        judge = stream_judge(spark, s, args.checkpoint, False)
        query = start_alerts(replay_stream(spark, input_files(spark, args.path), args.speed, checkpoint=f"{args.checkpoint}/alerts"), tuned(spark, s), judge, f"{args.checkpoint}/alerts", False)
        query.awaitTermination(args.seconds)
        query.stop()
        judge.flush(spark)
    elif args.what == "replay":
        rows = read_sanitized(spark, args.path).withColumn("line_no", F.monotonically_increasing_id())
        this = next_run(spark, s)
        alerts = judged_alerts(rows, s, this, by_time=True)
        write_alerts(alerts, s.alert_file, f"run-{this.number}" if this else None) if s.alert_file else alerts.show(truncate=False)
        if this:
            this.commit(spark, s)
    elif args.what == "alerts":
        alerts = read_alerts(spark, s.alert_file)
        if s.feedback_file:
            alerts = A.lifecycle(alerts, read_feedback(spark, s.feedback_file), s.max_resolved)
        for row in A.listing(alerts, args.status, args.source, args.sort).toJSON().toLocalIterator():
            print(row)
    else:
        moved = tuned(spark, s).overrides
        for (detector, source), threshold in sorted(moved.items()):
            print(f"{detector}\t{source}\t{threshold:.4f}")
        if told := tell_resolved(spark, s, f"{s.state_file}/told" if s.state_file else None):
            print(f"{told} resolved alerts posted", file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
