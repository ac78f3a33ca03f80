"""Scalar functions as Column expressions: hashing, checks, masking, generalisation, timestamps, levels, templates, cron."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenlog.functions import patterns as P


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value made once: inside lambdas Spark makes an expression anew wherever it stands."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def sha256_hash(v: Column, n: int = 16) -> Column:
    """The first n hex digits of SHA-256."""
    return F.substring(F.sha2(v.cast("binary"), 256), 1, n)


def hmac_sha256(v: Column, key: str) -> Column:
    """HMAC-SHA256 in hex, from two nested SHA-256 over the padded key."""
    import hashlib

    raw = key.encode()
    raw = (hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
    pad = lambda x: F.unhex(F.lit(bytes(b ^ x for b in raw).hex()))
    return F.sha2(F.concat(pad(0x5C), F.unhex(F.sha2(F.concat(pad(0x36), v.cast("binary")), 256))), 256)


def luhn_ok(v: Column) -> Column:
    """Luhn checksum of the digits; all zeros and single digits fail."""
    digits = F.regexp_replace(v, r"\D", "")
    return F.coalesce(F.call_function("luhn_check", digits) & digits.rlike("[1-9]") & (F.length(digits) >= 2), F.lit(False))


def id_card_ok(v: Column) -> Column:
    """18 characters whose last is the check code of the weighted sum modulo 11."""
    total = sum((F.substring(v, k + 1, 1).try_cast("int") * w for k, w in enumerate(P.ID_CARD_WEIGHTS)), F.lit(0))
    code = F.element_at(F.array(*map(F.lit, P.ID_CARD_CHECK_CODES)), (total % 11 + 1).cast("int"))
    return F.coalesce(v.rlike(r"^\d{17}[\dXx]$") & (F.upper(F.substring(v, 18, 1)) == code), F.lit(False))


def is_id_field(name: Column) -> Column:
    """Whether a field's name looks like an identifier's."""
    return F.coalesce(F.lower(name).rlike("id|seq|no|number|serial|uuid|guid"), F.lit(False))


def mask_value(v: Column, start: int = 3, end: int = 4, char: str = "*") -> Column:
    """Keeps the ends; a value of at most start + end characters, or with nothing kept, is masked whole."""
    n = F.length(v)
    inner = F.concat(F.substring(v, 1, start), F.repeat(F.lit(char), n - start - end), F.right(v, F.lit(end)) if end else F.lit(""))
    return F.when(n <= start + end, F.repeat(F.lit(char), n)).otherwise(inner)


def generalize_ip(v: Column) -> Column:
    """Two groups of an address; anything else as it is."""
    v4 = F.concat(F.split_part(v, F.lit("."), F.lit(1)), F.lit("."), F.split_part(v, F.lit("."), F.lit(2)), F.lit(".*.*"))
    v6 = F.concat(F.split_part(v, F.lit(":"), F.lit(1)), F.lit(":"), F.split_part(v, F.lit(":"), F.lit(2)), F.lit("::*"))
    return F.when(F.size(F.split(v, r"\.")) == 4, v4).when(v.contains(":"), v6).otherwise(v)


def generalize_email(v: Column) -> Column:
    """Hides what stands before the first @."""
    at = F.instr(v, "@")
    return F.when(at > 0, F.concat(F.lit("***"), F.substr(v, at))).otherwise(v)


def parse_log_level(text: Column) -> Column:
    """The first level word, bracketed or free, as DEBUG, TRACE, INFO, WARN, ERROR; else UNKNOWN."""
    return normal_level(F.translate(F.regexp_extract(text, f"(?i){P.LEVEL}", 0), "[]", ""))


def known_level(word: Column) -> Column:
    """The level of a name or alias; null for anything else."""
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in P.LEVEL_NAMES.items() for x in pair)), F.upper(word))


def normal_level(word: Column) -> Column:
    """Level names and their aliases; anything else is UNKNOWN."""
    return F.coalesce(known_level(word), F.lit("UNKNOWN"))


def parse_timestamp(text: Column, year: int = 1900) -> Column:
    """The first known stamp in the text; one without a zone is UTC. The dashed form may carry a fraction; the syslog form takes the year given."""
    find = lambda p: F.regexp_extract(text, p, 0)
    dashed = F.regexp_replace(F.regexp_replace(find(P.STAMP_DASHED), r"([T ][\d:.]+)$", "$1+00:00"), r"([+-]\d{2})(\d{2})$", "$1:$2")
    stamp = lambda v, f: F.try_to_timestamp(v, F.lit(f))
    slashed = F.concat(F.translate(find(P.STAMP_SLASHED), "T", " "), F.lit(" +0000"))
    access = F.regexp_replace(find(P.STAMP_ACCESS), r"\s*([+-])", " $1")
    syslog = F.concat(F.lit(f"{year:04d} "), F.regexp_replace(find(P.STAMP_SYSLOG), r"\s+", " "), F.lit(" +0000"))
    mail = F.regexp_replace(F.regexp_replace(find(P.STAMP_MAIL), r"^[A-Z][a-z]{2},", ""), r"\s+", " ")
    return F.coalesce(
        dashed.try_cast("timestamp"),
        stamp(slashed, "yyyy/MM/dd HH:mm:ss Z"),
        stamp(access, "dd/MMM/yyyy:HH:mm:ss Z"),
        stamp(syslog, "yyyy MMM d HH:mm:ss Z"),
        stamp(mail, " d MMM yyyy HH:mm:ss Z"),
    )


def code_point(n: Column) -> Column:
    """The character of a code point; Spark's own chr takes n modulo 256. Half of a surrogate pair becomes a question mark."""
    return F.decode(F.unhex(F.lpad(F.hex(n.cast("long")), 8, "0")), "UTF-32")


def templatize(message: Column) -> Column:
    """A message's template: e-mails, addresses, path variables, UUIDs and numbers become placeholders, in this order."""
    out = F.regexp_replace(message, P.EMAIL, "<EMAIL>")
    out = F.regexp_replace(F.regexp_replace(out, P.IPV6, "<IP>"), P.IPV4, "<IP>")
    out = F.regexp_replace(out, rf"(?<=/)(?:{P.UUID[2:-2]}|\d+)(?=/|\s|$)", "<VAR>")
    return F.regexp_replace(F.regexp_replace(out, P.UUID, "<UUID>"), r"\b\d+\b", "<NUM>")


def median(values: Column) -> Column:
    """Median of an array; null where it is empty."""
    s, n = F.array_sort(values), F.size(values)
    at = lambda k: F.try_element_at(s, k.cast("int"))
    return F.when(n % 2 == 1, at(F.floor((n + 1) / 2))).otherwise((at(F.greatest(F.floor(n / 2), F.lit(1))) + at(F.floor(n / 2) + 1)) / 2)


def modified_z(values: Column, x: Column) -> Column:
    """(x - median) / (1.4826 MAD); 0 without values; with MAD 0 it is 0 at the median and infinite elsewhere."""
    med = median(values)
    mad = median(F.transform(values, lambda v: F.abs(v - med)))
    return F.when(F.size(values) == 0, 0.0).when(mad == 0, F.when(x == med, 0.0).otherwise(float("inf"))).otherwise((x - med) / (1.4826 * mad))


def finite(x: Column) -> Column:
    """NaN and infinities become null."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def cron_matches(expression: str, ts: Column) -> Column:
    """Five cron fields (minute, hour, day, month, weekday from Monday = 0) against a timestamp; another number of fields is always true."""
    fields = expression.split()
    if len(fields) != 5:
        return F.lit(True)
    out = F.lit(True)
    for field, value in zip(fields, (F.minute(ts), F.hour(ts), F.dayofmonth(ts), F.month(ts), F.weekday(ts)), strict=True):
        options = F.lit(False)
        for part in field.split(","):
            if part == "*":
                options = options | F.lit(True)
            elif part.startswith("*/"):
                options = options | (value % int(part[2:]) == 0)
            elif "-" in part:
                low, high = part.split("-")
                options = options | value.between(int(low), int(high))
            else:
                options = options | (value == int(part))
        out = out & options
    return out


def downgrade(severity: Column) -> Column:
    """One level less severe."""
    return F.when(severity == "CRITICAL", "WARNING").when(severity == "WARNING", "INFO").otherwise(severity)


def weighted_severity(severity: Column, weight: Column) -> Column:
    """Below 0.5 everything is INFO; below 0.8 CRITICAL is WARNING."""
    return F.when(weight < 0.5, "INFO").when((weight < 0.8) & (severity == "CRITICAL"), "WARNING").otherwise(severity)
