"""JSON that means one thing only: manifests and records read without leniency."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.errors import EngineError


def strict_json(text: str):
    """The value of ``text``; a name given twice, a number that is not finite or anything behind the value is an error."""

    def once(pairs: list) -> dict:
        out = dict(pairs)
        if len(out) != len(pairs):
            raise ValueError("a name is given twice")
        return out

    def no(constant: str):
        raise ValueError(f"{constant} is no number")

    try:
        return json.loads(text, object_pairs_hook=once, parse_constant=no)
    except (ValueError, RecursionError) as e:
        raise EngineError("InvalidConfiguration", f"not strict JSON: {e}") from e


def json_status(df: DataFrame, col: str, out_col: str = "json_status") -> DataFrame:
    """``df`` with what ``strict_json`` says of the texts of ``col``: ok, or the flaw; null for null."""

    def one(text) -> str | None:
        if text is None:
            return None
        try:
            strict_json(text)
            return "ok"
        except EngineError as e:
            return str(e)

    status = F.pandas_udf(lambda texts: pd.Series([one(t) for t in texts], dtype=object), "string")
    return df.withColumn(out_col, status(F.col(col).cast("string")))


def manifest(text: str, keys: dict[str, type]) -> list[dict]:
    """The samples of a manifest {"schema": ..., "samples": [...]}, each with the ``keys`` of those types and ids of its own."""
    value = strict_json(text)
    if not isinstance(value, dict) or not isinstance(value.get("samples"), list):
        raise EngineError("InvalidConfiguration", "a manifest has a list of samples")
    for row in value["samples"]:
        for k, kind in keys.items():
            if not isinstance(row, dict) or type(row.get(k)) is not kind:
                raise EngineError("InvalidConfiguration", f"{k} is to be of type {kind.__name__}")
    ids = [row.get("id") for row in value["samples"]]
    if len(set(ids)) != len(ids):
        raise EngineError("InvalidConfiguration", "two samples have one id")
    return value["samples"]
