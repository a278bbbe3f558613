"""JSON texts of unknown shape: canonical form, paths and values, lists under several possible keys."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Keys under which a list of actions may stand, in order. Fixed values.
ACTION_KEYS = ("claims", "claimRejections", "data")


def _loads(text: str) -> Any:
    return json.loads(text)


@F.pandas_udf(T.StringType())
def canonical_json(text: pd.Series) -> pd.Series:
    """The document with sorted keys, ", " and ": " between items and ASCII escapes; null where the text is no JSON."""

    def one(t: str | None) -> str | None:
        try:
            return None if t is None else json.dumps(_loads(t), sort_keys=True)
        except ValueError:
            return None

    return text.map(one)


@F.pandas_udf(T.StringType())
def wrapped_json(text: pd.Series) -> pd.Series:
    """The document in canonical form; a text that is no JSON as the only value of an object, empty texts as null."""

    def one(t: str | None) -> str | None:
        if t is None or t == "":
            return None
        try:
            return json.dumps(_loads(t), sort_keys=True)
        except ValueError:
            return json.dumps({"unparsed_native_value": t}, sort_keys=True)

    return text.map(one)


def _paths(value: Any, prefix: str = "") -> Iterator[tuple[str, str]]:
    if isinstance(value, dict):
        for key in sorted(value):
            yield from _paths(value[key], f"{prefix}.{key}" if prefix else str(key))
    else:
        yield prefix, json.dumps(value, sort_keys=True)


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("path", T.StringType()), T.StructField("value", T.StringType())])))
def json_paths(text: pd.Series) -> pd.Series:
    """(path, value as JSON) of every leaf of nested objects, keys in order and joined by dots; lists are leaves. No JSON: no rows."""

    def one(t: str | None) -> list[dict[str, str]]:
        try:
            return [] if not t else [{"path": p, "value": v} for p, v in _paths(_loads(t))]
        except ValueError:
            return []

    return text.map(one)


@F.pandas_udf(T.ArrayType(T.StringType()))
def action_list(text: pd.Series) -> pd.Series:
    """The objects of a list, or of the list under the first of ACTION_KEYS that holds one, as JSON; else none."""

    def one(t: str | None) -> list[str]:
        try:
            value = None if t is None else _loads(t)
        except ValueError:
            return []
        if isinstance(value, dict):
            value = next((value[k] for k in ACTION_KEYS if isinstance(value.get(k), list)), None)
        return [json.dumps(x, sort_keys=True) for x in value if isinstance(x, dict)] if isinstance(value, list) else []

    return text.map(one)


def last_label(path: Column) -> Column:
    """The part of a path behind its last dot."""
    return F.substring_index(path, ".", -1)
