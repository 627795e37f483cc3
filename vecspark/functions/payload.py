"""Fields of JSON payloads as typed column expressions, and edits of payloads.

A payload is JSON text. A field's token is its text as written (a string's without quotes); its tag is the type that a
VARIANT of it has. Comparisons check the tag first, so "12", 12 and 12.0 stay apart, and so do a missing field and a null.
Field names are flat keys: dots in them mean nothing.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from vecspark.types import MOST_ID, FilterError


class Field:
    def __init__(self, payload: Column, name: str) -> None:
        if '"' in name or "\\" in name:
            raise FilterError(f"a field can't be named {name!r}")
        self.path = f'$["{name}"]'
        tokens = F.from_json(payload, "map<string,string>")
        self.whole = F.try_parse_json(payload)
        self.has = F.coalesce(F.map_contains_key(tokens, name), F.lit(False))
        self.token = F.try_element_at(tokens, F.lit(name))
        self.variant = F.try_variant_get(self.whole, self.path, "variant")
        self.tag = F.schema_of_variant(self.variant)

    def is_number(self) -> Column:
        return number(self.tag)

    def is_array(self) -> Column:
        return self.tag.startswith("ARRAY")

    def is_object(self) -> Column:
        return self.tag.startswith("OBJECT")

    def as_double(self) -> Column:
        return F.when(self.is_number(), self.token.try_cast("double"))

    def elements(self) -> Column:
        """The array of (tag, token, json) of an array field's elements; else null."""
        variants = F.try_variant_get(self.whole, self.path, "array<variant>")
        tags = F.transform(variants, lambda e: F.schema_of_variant(e))
        return F.when(self.is_array(), F.arrays_zip(tags.alias("tag"), F.from_json(self.token, "array<string>").alias("token"), F.transform(variants, lambda e: F.to_json(e)).alias("json")))

    def count(self) -> Column:
        """An array's or object's size, 0 for null, 1 for any other value; null if missing."""
        by_tag = F.when(self.is_array(), F.json_array_length(self.token)).when(self.is_object(), F.size(F.json_object_keys(self.token))).when(self.tag == "VOID", 0).otherwise(1)
        return F.when(self.has, by_tag)

    def member(self, key: str) -> Column:
        """An object's numeric member as double."""
        inner = F.try_variant_get(self.whole, f'{self.path}["{key}"]', "variant")
        return F.when(self.is_object() & number(F.schema_of_variant(inner)), F.try_variant_get(self.whole, f'{self.path}["{key}"]', "double"))


def number(tag: Column) -> Column:
    return tag.isin("BIGINT", "DOUBLE") | tag.startswith("DECIMAL")


def canonical(value: object) -> str:
    """JSON text with sorted keys; integers that no 64 bits hold become floats."""

    def plain(x: object) -> object:
        if isinstance(x, dict):
            return {str(k): plain(v) for k, v in x.items()}
        if isinstance(x, (list, tuple)):
            return [plain(v) for v in x]
        if isinstance(x, int) and not isinstance(x, bool) and not -(1 << 63) <= x < 1 << 64:
            return float(x)
        return x

    return json.dumps(plain(value), sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def select_keys(payload: Column, include: Iterable[str] | None, exclude: Iterable[str] | None) -> Column:
    """payload with the included keys only, less the excluded ones; a null stays. For the few rows of a result."""
    keep, drop = (set(include) if include is not None else None), set(exclude or ())

    @F.pandas_udf("string")
    def pick(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> str | None:
            if text is None:
                return None
            return canonical({k: v for k, v in json.loads(text).items() if (keep is None or k in keep) and k not in drop})

        return texts.map(one)

    return pick(payload)


def canonical_id(value: Column) -> Column:
    """normalise_id() as an expression."""
    text = value.cast("string")
    short = F.regexp_replace(text, r"^\+?0*(?=[0-9])", "")
    small = (F.length(short) < len(MOST_ID)) | (F.length(short) == len(MOST_ID)) & (short <= MOST_ID)
    return F.when(text.rlike(r"^\+?[0-9]+$") & small, short).otherwise(text)


def edited(payload: str | None, op: str, values: dict | None, keys: Iterable[str] = ()) -> str | None:
    """A payload after set_payload, merge or delete_keys; merging nothing changes nothing."""
    now = json.loads(payload) if payload is not None else None
    if op == "set_payload":
        now = dict(values or {})
    elif op == "merge":
        now = {**(now or {}), **values} if values else now
    elif now is not None:
        now = {k: v for k, v in now.items() if k not in set(keys)}
    return None if now is None else canonical(now)
