"""Detection of sensitive values and their replacement, as Column expressions.

Rules run as regular expressions over a string column; matches carry code-point offsets, overlaps are resolved leftmost-longest (an
earlier rule wins ties), and replacements are spliced in. Where a rule's value is a group, the value's last occurrence in the match is
what is replaced, so that `password: pass` hides the secret, not the key.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace

from py4j.protocol import Py4JJavaError
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlog.functions import patterns as P
from lumenlog.functions import scalars as S

STRATEGIES = ("mask", "hash", "replace", "delete", "generalize")


@dataclass(frozen=True)
class Rule:
    """One detection rule. probe: a cheap pattern that any text with a match has; check: further test of a value."""

    name: str
    kind: str
    pattern: str
    strategy: str = "mask"
    params: Mapping[str, object] = field(default_factory=dict)
    group: int = 0
    probe: str = ""
    check: Callable[[Column], Column] | None = None
    enabled: bool = True


BUILTIN = (
    Rule("ipv4", "ipv4", P.IPV4, "generalize", probe=r"\d\.\d"),
    Rule("ipv6", "ipv6", P.IPV6, "generalize", probe="[0-9a-fA-F]:|::"),
    Rule("email", "email", P.EMAIL, "generalize", probe="@"),
    Rule("phone", "phone", P.PHONE, "mask", {"keep_start": 3, "keep_end": 4}, probe=r"1[3-9]\d"),
    Rule("id_card", "id_card", P.ID_CARD, "mask", {"keep_start": 4, "keep_end": 4}, probe=r"\d{17}", check=S.id_card_ok),
    Rule("bank_card", "bank_card", P.BANK_CARD, "mask", {"keep_start": 6, "keep_end": 4}, probe=r"\d{16}", check=S.luhn_ok),
    Rule("token", "token", P.TOKEN, "replace", {"replacement": "[REDACTED_TOKEN]"}, group=1, probe="token|api_key|secret|passw|pwd"),
    Rule("session", "token", P.SESSION, "replace", {"replacement": "[REDACTED_SESSION]"}, group=1, probe="sess"),
    Rule("cookie", "cookie", P.COOKIE, "replace", {"replacement": "[REDACTED_COOKIE]"}, group=1, probe="cookie:"),
)


def java_pattern(pattern: str) -> str:
    """A Python pattern as Java's: named groups and references to them. ValueError where the running JVM can't read it."""
    java = re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", pattern).replace("(?P<", "(?<")
    if (session := SparkSession.getActiveSession()) is not None:
        try:
            session._jvm.java.util.regex.Pattern.compile(java)
        except (Py4JJavaError, IllegalArgumentException) as e:
            raise ValueError(f"pattern {pattern}: {e}") from e
    return java


def custom_rule(name: str, pattern: str, kind: str = "custom", strategy: str = "mask", params: Mapping[str, object] | None = None, enabled: bool = True) -> Rule:
    """A user's rule. The value is the first group where the pattern has one. Named groups are written as in Python."""
    if not pattern:
        raise ValueError(f"rule {name} has no pattern")
    if strategy not in STRATEGIES:
        raise ValueError(f"rule {name}: unknown strategy {strategy}")
    try:
        groups = re.compile(pattern).groups
    except re.error as e:
        raise ValueError(f"rule {name}: {e}") from e
    return Rule(name, kind, java_pattern(pattern), strategy, dict(params or {}), group=1 if groups else 0, enabled=enabled)


def configured(overrides: Mapping[str, Mapping[str, object]] | None = None, custom: Sequence[Rule] = ()) -> tuple[Rule, ...]:
    """The built-in rules with overrides by name (enabled, strategy; params are merged), then the custom ones; disabled rules are left out."""
    out = []
    for rule in BUILTIN:
        o = dict((overrides or {}).get(rule.name, {}))
        if (strategy := o.get("strategy", rule.strategy)) not in STRATEGIES:
            raise ValueError(f"rule {rule.name}: unknown strategy {strategy}")
        out.append(replace(rule, enabled=bool(o.get("enabled", rule.enabled)), strategy=strategy, params={**rule.params, **dict(o.get("params", {}))}))
    return tuple(r for r in (*out, *custom) if r.enabled)


def replacement(rule: Rule, value: Column) -> Column:
    """What takes the place of a value."""
    p = rule.params
    if rule.strategy == "mask":
        return S.mask_value(value, int(p.get("keep_start", 3)), int(p.get("keep_end", 4)), str(p.get("mask_char", "*")))
    if rule.strategy == "hash":
        return S.sha256_hash(value, int(p.get("hash_length", 16)))
    if rule.strategy == "replace":
        return F.lit(str(p.get("replacement", f"[REDACTED_{rule.kind.upper()}]")))
    if rule.strategy == "delete":
        return F.lit("")
    if rule.kind in ("ipv4", "ipv6"):
        return S.generalize_ip(value)
    return S.generalize_email(value) if rule.kind == "email" else S.mask_value(value, 1, 0)


MATCH = "array<struct<start:int,neg_end:int,ord:int,value:string,kind:string,rule:string,strategy:string,new:string>>"


#: Stands between the parts of a marked text; where a text has it itself, its second character is exchanged before rules run.
_CUT = "\x01\x02"


def rule_matches(text: Column, rule: Rule, order: int, id_field: Column | None = None) -> Column:
    """All checked matches of one rule: start, negated end, rule order, value, kind, rule, strategy, new.

    One pass of the pattern: it marks what it matches, and the marked text is cut into gap, match (and its group), gap, ...
    """
    safe = F.when(text.contains(_CUT), F.translate(text, "\x02", "\x03")).otherwise(text)
    mark = _CUT + "$0" + _CUT + (f"${rule.group}{_CUT}" if rule.group else "")
    marked, each = F.regexp_replace(safe, f"(?i){rule.pattern}", mark), 3 if rule.group else 2

    def fold(ps: Column) -> Column:
        def step(at: Column, k: Column) -> Column:
            gap, full = F.get(ps, k), F.get(ps, k + 1)
            group = F.get(ps, k + 2)
            value = F.trim(F.when(group == "", full).otherwise(group)) if rule.group else F.trim(full)
            one = F.struct((at["pos"] + F.length(gap)).alias("from"), full.alias("full"), value.alias("value"))
            return F.struct((at["pos"] + F.length(gap) + F.length(full)).cast("int").alias("pos"), F.concat(at["out"], F.array(one)).alias("out"))

        start = F.struct(F.lit(0).alias("pos"), F.array().cast("array<struct<from:int,full:string,value:string>>").alias("out"))
        return F.aggregate(F.sequence(F.lit(0), F.size(ps) - 2, F.lit(each)), start, step)["out"]

    def placed(m: Column) -> Column:
        start = m["from"] + F.length(m["full"]) - F.instr(F.reverse(m["full"]), F.reverse(m["value"])) + 1 - F.length(m["value"])
        return S.bound(start, lambda at: F.struct(at.alias("start"), F.substring(text, at + 1, F.length(m["value"])).alias("value")))

    def told(m: Column) -> Column:
        start, value = m["start"], m["value"]
        return F.struct(start.cast("int").alias("start"), (-(start + F.length(value))).cast("int").alias("neg_end"), F.lit(order).alias("ord"), value.alias("value"), F.lit(rule.kind).alias("kind"), F.lit(rule.name).alias("rule"), F.lit(rule.strategy).alias("strategy"), replacement(rule, value).alias("new"))

    good = lambda m: (m["value"] != "") & (rule.check(m["value"]) if rule.check else F.lit(True))
    none = F.array().cast(MATCH)
    # Arrays of one bind a value that is used more than once, so that it is made once; what has no mark isn't cut.
    cut = F.filter(F.transform(F.filter(F.array(marked), lambda m: m.contains(_CUT)), lambda m: F.split(m, _CUT, -1)), lambda ps: F.size(ps) > 1)
    found = F.flatten(F.transform(cut, lambda ps: F.transform(F.transform(F.filter(fold(ps), good), placed), told)))
    needed = text.rlike(f"(?i){rule.probe or rule.pattern}")
    if rule.kind == "phone" and id_field is not None:
        needed = needed & ~id_field
    return F.when(needed, found).otherwise(none)


def resolve(matches: Column) -> Column:
    """Leftmost, then longest, then earlier rule; matches that overlap a kept one go."""
    ordered = F.array_sort(matches)
    start = F.struct(F.lit(0).alias("end"), F.array().cast(MATCH).alias("kept"))
    keep = lambda at, m: F.when(m["start"] >= at["end"], F.struct((-m["neg_end"]).alias("end"), F.concat(at["kept"], F.array(m)).alias("kept"))).otherwise(at)
    return F.aggregate(ordered, start, keep)["kept"]


def detections(text: Column, rules: Sequence[Rule] = BUILTIN, field_name: Column | None = None) -> Column:
    """Kept matches of all rules. A field whose name looks like an identifier's is not searched for phone numbers."""
    id_field = S.is_id_field(field_name) if field_name is not None else None
    none = F.array().cast(MATCH)
    if not rules:
        return none
    found = F.concat(*(rule_matches(text, r, k, id_field) for k, r in enumerate(rules)))
    kept = S.bound(found, lambda f: F.when(F.size(f) > 1, resolve(f)).otherwise(f))
    # A text without what any match has is left at once; patterns without a probe aren't put together, as they may count their groups.
    likely = text.rlike("(?i)" + "|".join(f"(?:{r.probe})" for r in rules)) if all(r.probe for r in rules) else text.isNotNull()
    return F.when(likely, kept).otherwise(none)


def splice(text: Column, kept: Column) -> Column:
    """The text with its kept matches replaced."""
    step = lambda at, m: F.struct((-m["neg_end"]).alias("pos"), F.concat(at["out"], F.substring(text, at["pos"] + 1, m["start"] - at["pos"]), m["new"]).alias("out"))
    done = F.aggregate(kept, F.struct(F.lit(0).alias("pos"), F.lit("").alias("out")), step)
    return F.when(F.size(kept) == 0, text).otherwise(S.bound(done, lambda d: F.concat(d["out"], F.substr(text, d["pos"] + 1))))


def sanitize(df: DataFrame, column: str, rules: Sequence[Rule] = BUILTIN, out: str = "sanitized", found: str = "found") -> DataFrame:
    """df with the matches of a column and its sanitized text. One pass, no shuffle, no Python."""
    return df.withColumn(found, detections(F.col(column), rules, F.lit(column))).withColumn(out, splice(F.col(column), F.col(found)))
