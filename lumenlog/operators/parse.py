"""Parsers from raw lines to records: JSON, access log, syslog (both forms), plain text, custom patterns, and detection of the format.

A record has ts, level, message, extra (map of strings), typed (the JSON text of those values of extra that are no strings: numbers, objects, ...),
fmt, is_parseable, parse_error, and source where the line names one. All native: a line is matched once by the pattern of its format, all
groups in one go, and JSON is parsed once.
"""

from __future__ import annotations

import re
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlog.functions import patterns as P
from lumenlog.functions import scalars as S
from lumenlog.operators.detect import java_pattern
from lumenlog.session import built

RECORD = "struct<ts:timestamp,level:string,message:string,source:string,extra:map<string,string>,typed:map<string,string>>"
#: Stands between the groups of a match; two control characters that no log line has next to each other.
_CUT = "\x01\x02"
#: Only a line feed ends a line: other characters that Java takes for line ends belong to the text.
_LINES = "(?d)"


def _empty() -> Column:
    return F.create_map().cast("map<string,string>")


def _record(ts: Column, level: Column, message: Column, extra: Column, source: Column | None = None, typed: Column | None = None) -> Column:
    source = F.lit(None).cast("string") if source is None else source
    typed = _empty() if typed is None else typed
    return F.struct(ts.alias("ts"), level.alias("level"), message.alias("message"), source.alias("source"), extra.cast("map<string,string>").alias("extra"), typed.alias("typed")).cast(RECORD)


def _map(**columns: Column) -> Column:
    return F.create_map(*(x for k, v in columns.items() for x in (F.lit(k), v)))


def groups(raw: Column, pattern: str) -> Column:
    """All groups of a pattern that matches whole lines, from one match; an array of one where it doesn't match. A line that holds what stands between groups is matched once a group."""
    n = re.compile(pattern.replace("(?<", "(?P<")).groups
    once = F.split(F.regexp_replace(raw, _LINES + pattern, _CUT.join(f"${k}" for k in range(1, n + 1))), _CUT, n)
    each = F.when(raw.rlike(_LINES + pattern), F.array(*(F.regexp_extract(raw, _LINES + pattern, k) for k in range(1, n + 1)))).otherwise(F.array(raw))
    return F.when(raw.contains(_CUT), each).otherwise(once)


def _json_record(doc: Column, raw: Column) -> Column:
    """doc: a map of variants. The first usable of the known keys; other keys stay in extra, nested values as JSON text."""
    text = lambda k: F.nullif(F.element_at(doc, F.lit(k)).cast("string"), F.lit(""))
    first = lambda keys: F.coalesce(*map(text, keys))
    # The first value that looks like a stamp is nearly always one; only where it isn't are all keys tried.
    likely = S.parse_timestamp(F.coalesce(*(F.when(text(k).rlike(P.STAMP_ANY), text(k)) for k in P.TIME_KEYS)))
    every = F.get(F.filter(F.transform(F.array(*map(text, P.TIME_KEYS)), lambda v: S.parse_timestamp(v)), lambda v: v.isNotNull()), F.lit(0))
    ts = F.coalesce(likely, F.when(first(P.TIME_KEYS).isNotNull(), every))
    level = F.coalesce(*(S.known_level(text(k)) for k in P.LEVEL_KEYS), F.lit("UNKNOWN"))
    named = F.array(*(F.lit(k) for k in ("timestamp", "time", "date", "level", "log_level", "severity", "message", "msg", "content", *P.SOURCE_KEYS)))
    rest = F.map_filter(doc, lambda k, v: ~F.array_contains(named, F.lower(k)))
    typed = F.transform_values(F.map_filter(rest, lambda k, v: F.schema_of_variant(v) != "STRING"), lambda k, v: F.coalesce(F.to_json(v), F.lit("null")))
    return _record(ts, level, F.coalesce(first(P.MESSAGE_KEYS), raw), F.transform_values(rest, lambda k, v: v.cast("string")), first(P.SOURCE_KEYS), typed)


def _access_record(g: Column) -> Column:
    """The combined access log: level by status, message from the request line."""
    status = g[5].try_cast("int")
    level = F.when(status >= 500, "ERROR").when(status >= 400, "WARN").otherwise("INFO")
    return _record(S.parse_timestamp(g[1]), level, F.concat_ws(" ", g[2], g[3], g[4]), _map(ip=g[0], status=g[5], size=g[6], referer=g[7], user_agent=g[8]))


def _priority_level(priority: Column) -> Column:
    s = priority.try_cast("int") % 8
    return F.when(s <= 2, "ERROR").when(s <= 4, "WARN").when(s <= 6, "INFO").otherwise("DEBUG")


def _newer_syslog(g: Column) -> Column:
    priority = F.map_filter(_map(priority=g[0]), lambda k, v: v.try_cast("long").isNotNull())
    return _record(S.parse_timestamp(g[2]), _priority_level(g[0]), g[8], _map(version=g[1], hostname=g[3], appname=g[4], procid=g[5], msgid=g[6], structured_data=g[7], priority=g[0]), typed=priority)


def _older_syslog(g: Column, year: int) -> Column:
    priority = F.map_filter(_map(priority=g[0]), lambda k, v: v.try_cast("long").isNotNull())
    return _record(S.parse_timestamp(g[1], year), _priority_level(g[0]), g[5], _map(hostname=g[2], tag=g[3], pid=F.when(g[4] != "", g[4]), priority=g[0]), typed=priority)


def _plain_record(g: Column, raw: Column, strict: bool) -> Column:
    """`time [LEVEL] message`; otherwise, unless strict, a line with a level word or a timestamp anywhere."""
    exact = _record(S.parse_timestamp(g[0]), S.normal_level(F.concat(g[1], g[2])), g[3], _empty())
    out = F.when(F.size(g) == 4, exact)
    if strict:
        return out
    found = _record(S.parse_timestamp(raw), S.parse_log_level(raw), raw, _empty())
    return out.otherwise(F.get(F.filter(F.array(found), lambda r: r["ts"].isNotNull() | (r["level"] != "UNKNOWN")), F.lit(0)))


def parse_custom(raw: Column, pattern: str, names: dict[str, str] | None = None) -> Column:
    """A user's pattern with named groups, matched at the line's beginning; names maps fields to groups."""
    groups = re.compile(pattern).groupindex
    java = _LINES + "^(?:" + java_pattern(pattern) + ")"
    at = lambda f: F.regexp_extract(raw, java, groups[g]) if (g := (names or {}).get(f, f)) in groups else None
    used = {(names or {}).get(f, f) for f in ("timestamp", "level", "message", "source")}
    ts, level, message, source = at("timestamp"), at("level"), at("message"), at("source")
    rest = [x for g, k in groups.items() if g not in used for x in (F.lit(g), F.regexp_extract(raw, java, k))]
    extra = F.map_filter(F.create_map(*rest), lambda k, v: v != "") if rest else _empty()
    null = F.lit(None)
    return F.when(raw.rlike(java), _record(S.parse_timestamp(ts) if ts is not None else null.cast("timestamp"), S.normal_level(level) if level is not None else F.lit("UNKNOWN"), message if message is not None else raw, extra, F.when(source != "", source) if source is not None else None))


def parse_lines(lines: DataFrame, fmt: str = "auto", year: int | None = None, custom: str | None = None, names: dict[str, str] | None = None, sticky: bool = True, strict: bool = False) -> DataFrame:
    """lines (source_file, line_no, raw) with the record's columns.

    auto: a file takes the format of its first line that parses; lines before it are unparseable. The file's format is one small
    aggregate, joined back by file. With sticky false each line is taken by the first format that fits. The older syslog form has no
    year of its own: it is the one given, else the present one (UTC). So that reruns agree, name it.
    """
    year = year or datetime.now(timezone.utc).year
    raw = F.regexp_replace("raw", r"[\r\n]+$", "")
    fmt = "apache" if fmt == "nginx" else fmt
    if fmt == "auto":
        # The tests alone, without the records: what decides the format stays small where it is sorted by file.
        def fitting() -> Column:
            tests = {"json": raw.rlike(r"^\s*\{") & F.try_parse_json(raw).isNotNull(), "apache": raw.rlike(_LINES + P.ACCESS), "syslog": raw.rlike(_LINES + P.SYSLOG_5424) | raw.rlike(_LINES + P.SYSLOG_3164), "plaintext": raw.rlike(f"(?i){P.LEVEL}") | S.parse_timestamp(raw).isNotNull() | raw.rlike(_LINES + P.PLAIN)}
            if custom:
                tests["custom"] = parse_custom(raw, custom, names).isNotNull()
            return F.coalesce(*(F.when(v, F.lit(k)) for k, v in tests.items()))

        fits = built(fitting, custom, names)
        if sticky:
            first = lines.withColumn("_fits", fits).filter("_fits IS NOT NULL").groupBy("source_file").agg(F.min(F.struct("line_no", "_fits")).alias("first")).select("source_file", F.col("first._fits").alias("_file_fmt"), F.col("first.line_no").alias("_from"))
            out = lines.join(first, "source_file", "left").withColumn("_fits", F.when(F.col("line_no") >= F.col("_from"), F.col("_file_fmt"))).drop("_file_fmt", "_from")
        else:
            out = lines.withColumn("_fits", fits)
    else:
        out = lines.withColumn("_fits", F.lit(fmt))
    # Each step is a projection of its own, since a later one uses its columns more than once.
    raw, at = F.col("_raw"), F.col("_fits")
    out = out.withColumn("_raw", F.regexp_replace("raw", r"[\r\n]+$", ""))
    out = out.withColumn("_v", F.when((at == "json") & raw.rlike(r"^\s*\{"), F.try_parse_json(raw))).withColumn("_a", F.when(at == "apache", groups(raw, P.ACCESS)))
    out = out.withColumn("_n", F.when(at == "syslog", groups(raw, P.SYSLOG_5424))).withColumn("_o", F.when(at == "syslog", groups(raw, P.SYSLOG_3164))).withColumn("_p", F.when(at == "plaintext", groups(raw, P.PLAIN)))
    out = out.withColumn("_doc", F.try_variant_get("_v", "$", "map<string,variant>"))
    g = F.col

    def parsed() -> Column:
        record = F.when(g("_doc").isNotNull(), _json_record(g("_doc"), raw)).when(F.size("_a") == 9, _access_record(g("_a"))).when(F.size("_n") == 9, _newer_syslog(g("_n")))
        record = record.when(F.size("_o") == 6, _older_syslog(g("_o"), year)).when(at == "plaintext", _plain_record(g("_p"), raw, strict))
        return record.when(at == "custom", parse_custom(raw, custom, names)) if custom else record

    out = out.withColumn("record", built(parsed, year, strict, custom, names))
    ok, blank = F.col("record").isNotNull(), F.trim(raw) == ""
    error = F.when(ok, F.lit(None)).when(blank, "Empty line").when(at == "json", "JSON parse error").otherwise("Format not detected")
    return out.select(
        *lines.columns,
        F.coalesce("record.source", "source_file").alias("source"),
        F.when(ok, at).otherwise("unparseable").alias("fmt"),
        F.col("record.ts").alias("ts"),
        F.coalesce("record.level", F.lit("UNKNOWN")).alias("level"),
        F.coalesce("record.message", raw).alias("message"),
        F.coalesce("record.extra", _empty()).alias("extra"),
        F.coalesce("record.typed", _empty()).alias("typed"),
        ok.alias("is_parseable"),
        error.alias("parse_error"),
    )
