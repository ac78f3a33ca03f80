"""Configuration of a run as YAML: sections inputs, parser, filters, sanitizers, output, audit_log, anomaly_detection, stream."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from pathlib import Path

from lumenlog.operators.alerts import Suppression
from lumenlog.operators.detect import Rule, configured, custom_rule
from lumenlog.operators.detectors import DetectorConfig

FORMATS = ("auto", "json", "apache", "nginx", "syslog", "plaintext", "custom")


@dataclass(frozen=True)
class Webhook:
    url: str | None = None
    headers: Mapping[str, str] = field(default_factory=dict)
    timeout_seconds: float = 5
    max_retries: int = 2
    retry_interval_seconds: float = 1
    dead_letter_file: str | None = None


@dataclass(frozen=True)
class Settings:
    """What a run needs, checked and in the forms that the operators take."""

    name: str
    paths: tuple[str, ...]
    recursive: bool
    encoding: str
    fmt: str
    custom: str | None
    names: dict[str, str]
    filters: dict[str, object]
    rules: tuple[Rule, ...]
    file: str | None
    stdout: bool
    overwrite: bool
    split: str | None
    dry_run: bool
    audit_file: str | None
    report_file: str | None
    report_json: str | None
    anomaly: bool
    detectors: DetectorConfig
    alert_file: str | None
    feedback_file: str | None
    dedup_seconds: int
    correlate_seconds: int
    max_resolved: int
    suppression: tuple[Suppression, ...]
    webhook: Webhook
    routes: tuple[tuple[str, str], ...]
    metrics_file: str | None
    max_line_length: int
    year: int | None = None
    state_file: str | None = None
    idle_seconds: float = 300.0
    spread_sources: bool = True
    template: str | None = None
    pretty: bool = False
    mapping: str | None = None
    mapping_key: str = "default_key"
    sanitize_unparseable: bool = False


def _section(doc: Mapping, name: str) -> Mapping:
    found = doc.get(name) or {}
    if not isinstance(found, Mapping):
        raise ValueError(f"{name}: expected a mapping")
    return found


def parse_rules(doc: Mapping) -> tuple[Rule, ...]:
    """Rules of a sanitizers section. builtin_rules: a mapping of names to true or false, or a list of names with settings."""
    told = doc.get("builtin_rules") or {}
    if isinstance(told, Mapping):
        overrides = {name: v if isinstance(v, Mapping) else {"enabled": bool(v)} for name, v in told.items()}
    else:
        overrides = {r["name"]: {k: v for k, v in r.items() if k in ("enabled", "strategy", "params") and v is not None} for r in told}
    for key in ("strategies", "params"):
        for name, v in (doc.get(key) or {}).items():
            overrides.setdefault(name, {})["strategy" if key == "strategies" else "params"] = v
    custom = [custom_rule(r.get("name") or "", r.get("pattern") or "", r.get("type") or "custom", r.get("strategy") or "mask", r.get("params"), r.get("enabled", True)) for r in doc.get("custom_rules") or []]
    return configured(overrides, custom)


def _thresholds(detector: str, told: object, default: float) -> tuple[float, dict[tuple[str, str], float]]:
    """A threshold is one number, `auto` (the initial one, which feedback then tunes), or either by source with an optional default."""
    value = lambda v: default if v is None or str(v).lower() == "auto" else float(v)
    if not isinstance(told, Mapping):
        return value(told), {}
    return value(told.get("default")), {(detector, source): value(v) for source, v in told.items() if source != "default"}


def parse_detectors(doc: Mapping) -> DetectorConfig:
    """Thresholds and windows of the detectors; each may have a window size of its own."""
    algorithms = _section(doc, "algorithms")
    parts = {"frequency": _section(algorithms, "frequency"), "error_rate": _section(algorithms, "error_rate"), "pattern": _section(algorithms, "pattern")}
    frequency, rate, pattern = parts.values()
    multiplier, by_source = _thresholds("frequency", frequency.get("threshold_multiplier"), float(frequency.get("initial_threshold_multiplier", 3.0)))
    z, more = _thresholds("error_rate", rate.get("z_score_threshold"), float(rate.get("initial_z_score_threshold", 2.5)))
    return DetectorConfig(
        window_seconds=300.0, windows={k: float(v["window_size_seconds"]) for k, v in parts.items() if "window_size_seconds" in v}, alpha=float(frequency.get("alpha", 0.3)), multiplier=multiplier, history=int(rate.get("k_windows", 20)), z_threshold=z,
        min_samples=int(pattern.get("min_samples", doc.get("min_samples", 100))), disappear_windows=int(pattern.get("disappear_windows", 3)), overrides={**by_source, **more}, weights={str(k): float(v) for k, v in (doc.get("source_weights") or {}).items()},
    )


def parse_suppression(rows: list[Mapping]) -> tuple[Suppression, ...]:
    out = []
    for k, row in enumerate(rows):
        match = _section(row, "match")
        many = lambda v: tuple([v] if isinstance(v, str) else v or ())  # noqa: B023, E731
        kinds, severities = many(match.get("alert_type")), tuple(s.upper() for s in many(match.get("severity")))
        for v, known in ((kinds, ("frequency_spike", "error_rate_surge", "new_pattern", "pattern_disappeared", "composite_anomaly")), (severities, ("INFO", "WARNING", "CRITICAL"))):
            if unknown := set(v) - set(known):
                raise ValueError(f"suppression rule {k}: unknown {sorted(unknown)}")
        out.append(Suppression(row.get("name") or f"rule_{k}", row.get("action") or "suppress", match.get("source_pattern"), kinds, severities, row.get("cron_expression") or match.get("cron_expression"), int(row.get("delay_seconds") or 0), bool(row.get("enabled", True))))
    return tuple(out)


def parse_settings(doc: object) -> Settings:
    """Settings of a parsed YAML document; ValueError names what is wrong with it."""
    if not isinstance(doc, Mapping):
        raise ValueError("expected a mapping at the top")
    inputs, parser, filters, output, audit, anomaly, stream = (_section(doc, k) for k in ("inputs", "parser", "filters", "output", "audit_log", "anomaly_detection", "stream"))
    if not (paths := inputs.get("paths")):
        raise ValueError("inputs.paths: no inputs")
    fmt = str(parser.get("format") or "auto").lower()
    if fmt not in FORMATS:
        raise ValueError(f"parser.format: unknown format {fmt}")
    if fmt == "custom" and not parser.get("custom_pattern"):
        raise ValueError("parser.custom_pattern: needed for the format custom")
    file, stdout = output.get("file"), bool(output.get("stdout")) or output.get("target") == "stdout"
    if not (file or stdout or doc.get("dry_run")):
        raise ValueError("output: neither file nor stdout")
    split = output.get("split_by_time") or ("day" if output.get("split_by_day") else None)
    if split not in (None, "day", "hour"):
        raise ValueError(f"output.split_by_time: unknown span {split}")
    low, high = stream.get("low_watermark", 5000), stream.get("high_watermark", 10000)
    if low >= high:
        raise ValueError("stream: low_watermark must be below high_watermark")
    keep = {"levels": filters.get("levels"), "start": filters.get("start_time"), "end": filters.get("end_time"), "include": filters.get("include_keywords"), "exclude": filters.get("exclude_keywords")}
    return Settings(
        name=doc.get("name") or "default", paths=tuple([paths] if isinstance(paths, str) else paths), recursive=bool(inputs.get("recursive", True)), encoding=inputs.get("encoding") or "utf-8",
        fmt="apache" if fmt == "nginx" else fmt, custom=parser.get("custom_pattern"), names=dict(parser.get("custom_field_names") or {}),
        filters={k: str(v) if k in ("start", "end") else v for k, v in keep.items() if v}, rules=parse_rules(_section(doc, "sanitizers")),
        file=file, stdout=stdout, overwrite=bool(output.get("overwrite")), split=split, dry_run=bool(doc.get("dry_run")),
        audit_file=audit.get("file") if audit.get("enabled") else None, report_file=doc.get("report_file"), report_json=doc.get("report_json"),
        anomaly=bool(anomaly.get("enabled")), detectors=parse_detectors(anomaly), alert_file=anomaly.get("alert_file"), feedback_file=anomaly.get("feedback_file"),
        dedup_seconds=int(anomaly.get("suppression_window_seconds", 600)), correlate_seconds=int(anomaly.get("correlation_window_seconds", 30)), max_resolved=int(anomaly.get("max_resolved_alerts", 100)),
        suppression=parse_suppression(anomaly.get("suppression_rules") or []), webhook=Webhook(**{k: v for k, v in _section(anomaly, "webhook").items() if v is not None}),
        routes=tuple((r.get("level_match") or r["match"], r.get("output_target") or r["output"]) for r in stream.get("route_rules") or []), metrics_file=stream.get("metrics_file"), max_line_length=int(_section(stream, "tail").get("max_line_length", 65536)),
        year=int(parser["year"]) if parser.get("year") else None, state_file=doc.get("state_file"), idle_seconds=float(inputs.get("idle_seconds", 300)), spread_sources=bool(anomaly.get("spread_sources", True)), template=output.get("filename_template"), pretty=bool(output.get("pretty")), mapping=_section(doc, "sanitizers").get("mapping_store"), mapping_key=str(_section(doc, "sanitizers").get("hmac_key") or "default_key"), sanitize_unparseable=bool(parser.get("sanitize_unparseable")),
    )


def load(path: str) -> Settings:
    """Settings of a YAML file."""
    import yaml

    if not Path(path).is_file():
        raise FileNotFoundError(f"no configuration at {path}")
    return parse_settings(yaml.safe_load(Path(path).read_text()))
