"""Strings inside JSON values and their paths.

A JSON text is cut into tokens, and one pass over them keeps the path of the place where it is, so nesting may be of any depth. Only string
values are looked at: keys, numbers, true, false and null stay as they are. Paths read `a.b[0].c`. The pass is a small helper over Arrow
batches, as a fold of Spark's own takes some 15 microseconds a token; all else is native.
"""

from __future__ import annotations

import json as js
import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenlog.functions.scalars import bound

# Strings, marks and bare words, as Java's patterns read them: white space is ASCII, and no line end follows a backslash.
_TOKEN = re.compile(r'"(?:[^"\\]++|\\[^\n\r\x85\u2028\u2029])*+"|[{}\[\],:]|[^\s"{}\[\],:]+', re.ASCII)
_PLACED = "array<struct<token:string,path:string>>"


def _key(literal: str) -> str | None:
    try:
        return js.loads(literal).encode(errors="replace").decode()
    except ValueError:
        return None


def placed(json: str, root: str) -> tuple[list[str], list[str | None]]:
    """String values as they are written, with their paths; what lies between two of them is one token, without a path."""
    names, counts, tokens, paths, run = [root], [None], [], [], []  # counts: None in an object, else the place in a list
    found = _TOKEN.findall(json)
    for t, after in zip(found, [*found[1:], ""], strict=True):
        if t[0] == '"' and after != ":":
            if run:
                tokens.append("".join(run))
                paths.append(None)
                run = []
            tokens.append(t)
            paths.append(".".join(n if c is None else f"[{c}]" for n, c in zip(names, counts, strict=True) if n is not None).replace(".[", "["))
            continue
        run.append(t)
        if t[0] == '"':
            names[-1:], counts[-1:] = [_key(t)], [None]
        elif t in "{[":
            names.append("")
            counts.append(0 if t == "[" else None)
        elif t in "}]":
            names, counts = names[:-1], counts[:-1]
        elif t == "," and counts and counts[-1] is not None:
            counts[-1] += 1
    if run:
        tokens.append("".join(run))
        paths.append(None)
    return tokens, paths


def _placed_lists(texts: pa.Array, roots: pa.Array) -> pa.Array:
    """placed() of each text in lists of texts."""
    rows, inner, none, tokens, paths = [0], [0], [], [], []
    for own, at in zip(texts.to_pylist(), roots.to_pylist(), strict=True):
        for text, root in zip(own or (), at or (), strict=True):
            if text is not None:
                found = placed(text, root)
                tokens += found[0]
                paths += found[1]
            none.append(text is None)
            inner.append(len(tokens))
        rows.append(len(none))
    made = pa.StructArray.from_arrays([pa.array(tokens, pa.string()), pa.array(paths, pa.string())], ["token", "path"])
    lists = pa.ListArray.from_arrays(pa.array(inner, pa.int32()), made, mask=pa.array(none, pa.bool_()))
    return pa.ListArray.from_arrays(pa.array(rows, pa.int32()), lists)


def json_tokens(texts: Column, roots: Column) -> Column:
    """Arrays of JSON texts and of what their paths begin with: for each text its tokens in order, for string values (not keys) with their path, null for all others."""
    return F.arrow_udf(_placed_lists, f"array<{_PLACED}>")(texts, roots)


def unquote(literal: Column) -> Column:
    """The text of a JSON string literal."""
    return F.try_variant_get(F.try_parse_json(literal), "$", "string")


def quote(text: Column) -> Column:
    """A text as a JSON string literal."""
    return bound(F.to_json(F.array(text)), lambda one: F.substr(one, F.lit(2), F.length(one) - 2))


def leaves(json: Column, root: Column) -> Column:
    """path, value of all strings in a JSON text, in order."""
    return F.transform(F.filter(F.get(json_tokens(F.array(json), F.array(root)), F.lit(0)), lambda t: t["path"].isNotNull()), lambda t: F.struct(t["path"].alias("path"), unquote(t["token"]).alias("value")))


def field_path(path: Column) -> Column:
    """The parts of a path: `a.b[0]` is a, b, [0]."""
    return F.regexp_extract_all(path, F.lit(r"\[[^\]]*\]|[^.\[]+|\[[^.\]]*$"), F.lit(0))
