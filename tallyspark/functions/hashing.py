"""Digests of bytes and of canonical JSON, closed key sets and pointers."""

from __future__ import annotations

import functools
import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .exact import holds

SHA256 = r"\A[a-f0-9]{64}\z"


def is_digest(value: Column) -> Column:
    return holds(value.rlike(SHA256))


@functools.cache
def canonical():
    """Pandas UDF: JSON text with sorted keys and no white space; null if it has no canonical form.

    None has what is no JSON, a number that is not finite, a lone surrogate, which UTF-8 cannot say, and what is nested too deep to be read.
    Of repeated keys the last counts.
    """

    def refuse(constant):
        raise ValueError(constant)

    def one(text):
        try:
            made = None if text is None else json.dumps(json.loads(text, parse_constant=refuse), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
            return made if made is None or made.isascii() else made.encode().decode()
        except (ValueError, RecursionError):
            return None

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(one)

    return run


def canonical_sha256(text: Column) -> Column:
    """Digest that does not change with the order of keys or white space."""
    return F.sha2(canonical()(text), 256)


def same_json(a: Column, b: Column) -> Column:
    """Whether two JSON texts are equal whatever the order of their keys."""
    return holds(canonical()(a) == canonical()(b))


def has_keys(text: Column, *keys: str) -> Column:
    """A JSON object with exactly these keys, each once.

    ``from_json`` would drop other keys and keep the last of repeated ones, so the text's own keys are
    compared; ``try_parse_json`` refuses repeated keys and numbers that are not finite.
    """
    wanted = F.array(*[F.lit(k) for k in sorted(keys)])
    return holds(F.try_parse_json(text).isNotNull() & (F.sort_array(F.json_object_keys(text)) == wanted))


def writable(text: str) -> str:
    """Text with lone surrogates, which UTF-8 cannot say, written as escapes."""
    return text if text.isascii() else text.encode("utf-8", "backslashreplace").decode()


@functools.cache
def differing():
    """Pandas UDF: the JSON pointers at which two JSON texts differ, sorted; the root is the empty pointer.

    Numbers are equal by value (1 and 1.0), a boolean is no number, keys have no order and lists do. A key or item that only
    one has is a difference at its place. Text that is no JSON, or nested too deep, differs at the root from everything; null gives null.
    """

    def walk(a, b, at: str, out: list) -> None:
        if isinstance(a, dict) and isinstance(b, dict):
            for name in a.keys() | b.keys():
                place = at + "/" + name.replace("~", "~0").replace("/", "~1")
                if name in a and name in b:
                    walk(a[name], b[name], place, out)
                else:
                    out.append(place)
        elif isinstance(a, list) and isinstance(b, list):
            for i, (x, y) in enumerate(zip(a, b)):
                walk(x, y, f"{at}/{i}", out)
            out += [f"{at}/{i}" for i in range(min(len(a), len(b)), max(len(a), len(b)))]
        elif a != b or isinstance(a, bool) != isinstance(b, bool):
            out.append(at)

    def one(a, b):
        out: list = []
        try:
            walk(json.loads(a), json.loads(b), "", out)
        except (ValueError, RecursionError):
            return [""]
        return sorted({writable(p) for p in out})

    @F.pandas_udf("array<string>")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else one(x, y) for x, y in zip(a, b)], dtype=object)

    return run


@functools.lru_cache(maxsize=16)
def _unapproved(fields: tuple[tuple[str, tuple[str, ...]], ...], root: str):
    """Pandas UDF: what :func:`unapproved` lists."""
    allowed = {path: set(names) for path, names in fields}

    def walk(value, path: str, out: list) -> None:
        if isinstance(value, dict):
            if path not in allowed:
                out.append(path)
                return
            out += [f"{path}.{name}" for name in value if name not in allowed[path]]
            for name in allowed[path].intersection(value):
                walk(value[name], f"{path}.{name}", out)
        elif isinstance(value, list):
            for item in value:
                walk(item, f"{path}[]", out)

    def one(text):
        out: list = []
        try:
            walk(json.loads(text), root, out)
        except (ValueError, RecursionError):
            return [root]
        return sorted({writable(p) for p in out})

    @F.pandas_udf("array<string>")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else one(v))

    return run


def unapproved(text: Column, fields: dict[str, Sequence[str]], root: str = "root") -> Column:
    """Paths in JSON text that a public allowlist does not name: keys beyond it, and objects where it has none.

    ``fields`` lists the keys of the object at each path, such as ``root.facts[].period``; objects may nest
    to any depth that can be read, and a list's items share a path. Text that is no JSON, or is nested too deep, breaks the root itself. A lone
    surrogate in a key is shown as an escape.
    """
    return _unapproved(tuple(sorted((path, tuple(names)) for path, names in fields.items())), root)(text)


def extra_keys(text: Column, *allowed: str) -> Column:
    """SET4: keys of a JSON object beyond the allowed ones."""
    return F.sort_array(F.array_except(F.json_object_keys(text), F.array(*[F.lit(k) for k in allowed])))


def pointer(*parts: str | Column) -> Column:
    """``/records/3/value`` from its parts."""
    return F.concat(*[x for p in parts for x in (F.lit("/"), (F.lit(p) if isinstance(p, str) else p.cast("string")))])
