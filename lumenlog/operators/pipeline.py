"""Filters, routing, standard output, previews and audit statistics of parsed and sanitized records."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenlog.functions import scalars as S
from lumenlog.operators.detect import BUILTIN, MATCH, Rule, detections, splice
from lumenlog.operators.nested import json_tokens, quote, unquote
from lumenlog.session import built


def level_filter(levels: Sequence[str] | None) -> Column:
    """Levels to keep; aliases such as WARNING are accepted."""
    alias = {"WARNING": "WARN", "CRITICAL": "ERROR", "FATAL": "ERROR"}
    return F.col("level").isin(*{alias.get(x.upper(), x.upper()) for x in levels}) if levels else F.lit(True)


def _utc(text: str) -> Column:
    """A time that is UTC unless it names a zone, whatever the session's zone is."""
    at = datetime.fromisoformat(text)
    return F.timestamp_micros(F.lit(round((at if at.tzinfo else at.replace(tzinfo=timezone.utc)).timestamp() * 1e6)))


def keep(levels: Sequence[str] | None = None, start: str | None = None, end: str | None = None, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> Column:
    """Whether a record passes. Bounds are inclusive and read as UTC, a null time passes; keywords are looked for in the raw line."""
    out = level_filter(levels)
    if start:
        out = out & (F.col("ts").isNull() | (F.col("ts") >= _utc(start)))
    if end:
        out = out & (F.col("ts").isNull() | (F.col("ts") <= _utc(end)))
    for words, wanted in ((include, True), (exclude, False)):
        if words:
            any_word = F.lit(False)
            for w in words:
                any_word = any_word | F.col("raw").contains(w)
            out = out & (any_word if wanted else ~any_word)
    return out


def mark_kept(records: DataFrame, **options) -> DataFrame:
    """Records with kept: whether they pass, as filter_records has it; null tests don't pass."""
    return records.withColumn("kept", F.coalesce(~F.col("is_parseable") | keep(**options), F.lit(False)))


def filter_records(records: DataFrame, **options) -> DataFrame:
    """Records that pass; unparseable ones always do."""
    return records.filter(~F.col("is_parseable") | keep(**options))


def sanitize_records(records: DataFrame, rules: Sequence[Rule] = BUILTIN, sanitize_unparseable: bool = False) -> DataFrame:
    """Records with message and all strings of extra sanitized, and found: (field, match) of every detection, fields and changed fields counted.

    Values of extra that aren't strings keep their types: of objects and arrays the strings inside are sanitized, each a field with a path of its
    own, and numbers, true, false and null stay. A string whose first match is of a delete rule becomes empty. Unparseable lines stay as they are unless asked otherwise, and
    so do records that a column kept says aren't. All strings of a record lie in one array, over which the rules run once.
    """
    return spliced_records(detected_records(records, rules, sanitize_unparseable))


def detected_records(records: DataFrame, rules: Sequence[Rule] = BUILTIN, sanitize_unparseable: bool = False) -> DataFrame:
    """Records with _items, all their strings (null where a record is left as it is), and _found, what the rules find in each."""
    on = F.lit(True) if sanitize_unparseable else F.col("is_parseable")
    on = on & F.col("kept") if "kept" in records.columns else on
    none = F.lit(None).cast("string")
    path = lambda e: F.concat(F.lit("extra."), e["key"])
    item = lambda kind, key, token, at, old: F.struct(F.lit(kind).alias("kind"), key.alias("key"), token.alias("token"), at.alias("path"), old.alias("old"))
    typed = F.col("typed") if "typed" in records.columns else F.create_map().cast("map<string,string>")
    plain = F.filter(F.map_entries("extra"), lambda e: ~F.map_contains_key(F.col("_typed"), e["key"]) & e["value"].isNotNull())
    deep = F.filter(F.map_entries("_typed"), lambda e: e["value"].rlike(r"^[{\[]"))
    tokens = lambda e, ts: F.transform(ts, lambda t: item("token", e["key"], t["token"], t["path"], F.when(t["path"].isNotNull(), unquote(t["token"]))))
    items = F.concat(F.array(item("message", none, none, F.lit("message"), F.col("message"))), F.transform(plain, lambda e: item("plain", e["key"], none, path(e), e["value"])), F.flatten(F.zip_with("_deep", "_tokens", tokens)))
    staged = records.withColumn("_typed", typed).withColumn("_deep", F.when(on, deep))
    staged = staged.withColumn("_tokens", json_tokens(F.transform("_deep", lambda e: e["value"]), F.transform("_deep", path)))
    staged = staged.withColumn("_items", F.when(on, items)).drop("_deep", "_tokens")
    return staged.withColumn("_found", built(lambda: F.transform("_items", lambda i: detections(i["old"], rules, i["path"])), tuple(rules)))


def spliced_records(staged: DataFrame) -> DataFrame:
    """What sanitize_records gives, of detected_records."""
    # Each step is a projection of its own, since a later one uses its columns more than once.
    new = lambda i, found: F.when((i["kind"] != "message") & (F.get(found, F.lit(0))["strategy"] == "delete"), F.lit("")).otherwise(splice(i["old"], found))
    columns, on = [c for c in staged.columns if c not in ("message", "extra", "typed", "_typed", "_items", "_found")], F.col("_items").isNotNull()
    staged = staged.withColumn("_new", F.zip_with("_items", "_found", new))
    staged = staged.withColumn("_done", F.zip_with("_items", "_new", lambda i, n: F.struct(i["kind"].alias("kind"), i["key"].alias("key"), i["token"].alias("token"), i["path"].alias("path"), i["old"].alias("old"), n.alias("new"))))
    of = lambda kind: F.filter("_done", lambda d: d["kind"] == kind)
    told = lambda d: F.when(d["path"].isNotNull() & (d["new"] != d["old"]), quote(d["new"])).otherwise(d["token"])
    remade = F.map_from_entries(F.transform(F.array_distinct(F.transform(of("token"), lambda d: d["key"])), lambda k: F.struct(k, F.array_join(F.transform(F.filter("_done", lambda d: (d["kind"] == "token") & (d["key"] == k)), told), ""))))
    cleaned = F.map_from_entries(F.transform(of("plain"), lambda d: F.struct(d["key"], F.coalesce(d["new"], d["old"]))))
    staged = staged.withColumn("_remade", F.coalesce(remade, F.create_map().cast("map<string,string>"))).withColumn("_cleaned", F.coalesce(cleaned, F.create_map().cast("map<string,string>")))
    over = lambda column: F.transform_values(column, lambda k, v: F.coalesce(F.element_at(F.col("_remade"), k), F.element_at(F.col("_cleaned"), k), v))
    found = F.flatten(F.zip_with("_items", "_found", lambda i, found: F.transform(found, lambda m: F.struct(i["path"].alias("field"), m.alias("match")))))
    return staged.select(
        *columns,
        F.col("message").alias("original_message"),
        F.when(F.col("_new").isNotNull(), F.get("_new", F.lit(0))).otherwise(F.col("message")).alias("message"),
        over("extra").alias("extra"),
        F.transform_values("_typed", lambda k, v: F.coalesce(F.element_at(F.col("_remade"), k), v)).alias("typed"),
        F.coalesce(found, F.array().cast(f"array<struct<field:string,match:{MATCH[6:-1]}>>")).alias("found"),
        F.when(on, F.size(F.filter("_items", lambda i: i["path"].isNotNull()))).otherwise(0).alias("total_fields"),
        F.when(on, F.size(F.filter("_done", lambda d: d["new"] != d["old"]))).otherwise(0).alias("sanitized_fields"),
    )


def standard(records: DataFrame) -> DataFrame:
    """json: one line for each record: timestamp (ISO 8601, UTC, or null), level, source, message, extra; unparseable ones are marked. Values of extra keep their types."""
    stamp = F.concat(F.regexp_replace(F.date_format(F.to_utc_timestamp("ts", F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), r"\.000000$", ""), F.lit("+00:00"))
    body = F.to_json(F.struct(stamp.alias("timestamp"), F.col("level"), F.col("source"), F.col("message")), {"ignoreNullFields": "false"})
    extra = F.to_json("extra")
    if "typed" in records.columns:
        value = lambda e: F.concat(quote(e["key"]), F.lit(":"), F.coalesce(F.element_at(F.col("typed"), e["key"]), quote(e["value"]), F.lit("null")))
        extra = F.concat(F.lit("{"), F.array_join(F.transform(F.map_entries("extra"), value), ","), F.lit("}"))
    good = F.concat(F.expr("substring(b, 1, length(b) - 1)"), F.lit(',"extra":'), extra, F.lit("}"))
    mark = F.to_json(F.struct(F.lit(True).alias("_unparseable"), F.col("parse_error").alias("_parse_error")))
    bad = F.concat(F.expr("substring(b, 1, length(b) - 1)"), F.lit(',"extra":{},'), F.expr("substring(u, 2)"))
    return records.withColumn("b", body).withColumn("u", mark).withColumn("json", F.when(F.col("is_parseable"), good).otherwise(bad)).drop("b", "u")


def route(rules: Sequence[tuple[str, str]], default: str) -> Column:
    """The target of a record: the first rule (comma list of levels, target) that its level is in, else the default."""
    out = F.lit(default)
    for levels, target in reversed(rules):
        out = F.when(level_filter([x.strip() for x in levels.split(",")]), F.lit(target)).otherwise(out)
    return out


def preview(records: DataFrame, rows: int = 20) -> DataFrame:
    """The first rows of each file, original and sanitized."""
    at = Window.partitionBy("source_file").orderBy("line_no")
    return records.withColumn("_at", F.row_number().over(at)).filter(F.col("_at") <= rows).select("source_file", "line_no", "original_message", "message")


def file_stats(records: DataFrame, kept: Column | None = None) -> DataFrame:
    """Per file: lines, parsed, unparsed, fields, sanitized fields, bytes. kept: which records pass the filters; all lines count, fields only of those."""
    kept = F.lit(True) if kept is None else F.coalesce(kept, F.lit(False))
    return records.groupBy("source_file").agg(
        F.count("*").alias("total_lines"), F.count_if("is_parseable").alias("parsed_lines"), F.count_if(~F.col("is_parseable")).alias("unparsed_lines"),
        F.coalesce(F.sum(F.when(kept, F.col("total_fields"))), F.lit(0)).alias("total_fields"), F.coalesce(F.sum(F.when(kept, F.col("sanitized_fields"))), F.lit(0)).alias("sanitized_fields"), F.sum(F.octet_length("raw") + 1).alias("bytes"),
    )


def detection_counts(records: DataFrame) -> DataFrame:
    """Detections by file and kind, by kind alone (file null) and in all."""
    # explode_outer, as explode would have the optimizer test the whole expression of found once more
    hits = records.select("source_file", F.explode_outer("found").alias("d")).filter("d IS NOT NULL").select("source_file", F.col("d.match.kind").alias("kind"))
    hits = hits.groupBy("source_file", "kind").agg(F.count("*").alias("n"))
    return hits.cube("source_file", "kind").agg(F.sum("n").alias("n")).filter("kind IS NOT NULL OR source_file IS NULL")


def top_fields(records: DataFrame, rows: int = 5) -> DataFrame:
    """The fields with most detections."""
    return records.select(F.explode_outer("found").alias("d")).filter("d IS NOT NULL").groupBy(F.col("d.field").alias("field")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "field").limit(rows)


def audit_report(stats: DataFrame) -> DataFrame:
    """One row over all files: counts and rates (0 where there is nothing to divide by)."""
    rate = lambda a, b: F.when(F.sum(b) > 0, F.round(F.sum(a) / F.sum(b), 4)).otherwise(0.0)
    return stats.agg(F.count("*").alias("files"), *(F.sum(c).alias(c) for c in ("total_lines", "parsed_lines", "unparsed_lines", "total_fields", "sanitized_fields")), rate("unparsed_lines", "total_lines").alias("failure_rate"), rate("sanitized_fields", "total_fields").alias("coverage"))


def audit_log(records: DataFrame) -> DataFrame:
    """One row for each replaced value: line, field, original, sanitized, rule, time (event time)."""
    d = F.col("d")
    return records.select("source_file", "line_no", "ts", F.explode_outer("found").alias("d")).filter("d IS NOT NULL").select("source_file", F.col("line_no").alias("line_number"), d["field"].alias("field_path"), d["match"]["value"].alias("original_value"), d["match"]["new"].alias("sanitized_value"), d["match"]["rule"].alias("rule_name"), F.col("ts").alias("timestamp")).filter("original_value <> sanitized_value")


def file_report(records: DataFrame, kept: Column | None = None) -> DataFrame:
    """file_stats with the detections of each file by kind (a map), in order of the files."""
    hits = records.select(F.col("source_file").alias("_file"), F.explode_outer("found").alias("d")).filter("d IS NOT NULL").groupBy("_file", F.col("d.match.kind").alias("kind")).agg(F.count("*").alias("n"))
    kinds = hits.groupBy("_file").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias("detections"))
    stats = file_stats(records, kept)
    return stats.join(kinds, F.col("source_file").eqNullSafe(F.col("_file")), "left").drop("_file").orderBy("source_file")


def render_report(report: dict, kinds: dict[str, int], fields: dict[str, int], files: Iterable[dict] = ()) -> Iterator[str]:
    """The lines of a plain-text report from collected aggregates, and a part for each file, which may come one by one."""
    top = max(kinds.values(), default=1)
    yield from ("Audit report", "=" * 40, *(f"{k:<18}{v}" for k, v in report.items()), "", "Detections", *(f"{k:<12}{n:>8} {'#' * max(1, 30 * n // top)}" for k, n in sorted(kinds.items(), key=lambda x: -x[1])), "", "Fields", *(f"{k:<24}{n:>8}" for k, n in sorted(fields.items(), key=lambda x: -x[1])))
    for f in files:
        share = f" ({f['sanitized_fields'] / f['total_fields']:.2%})" if f["total_fields"] else ""
        yield from ("", f"File {f['source_file']}", f"  lines {f['total_lines']}, parsed {f['parsed_lines']}, unparsed {f['unparsed_lines']}, bytes {f['bytes']}", f"  sanitized fields {f['sanitized_fields']}/{f['total_fields']}{share}")
        if f["detections"]:
            yield "  " + ", ".join(f"{k}={n}" for k, n in sorted(f["detections"].items()))
