"""Payload filters as column expressions.

A filter is {"must": [...], "must_not": [...], "should": [...], "min_should": {"conditions": [...], "min_count": n}}; every
group that is there has to hold, and an empty list of should asks nothing. A condition is {"field": name, "condition": c},
where c is a kind by itself ("IsNull") or {kind: arguments}. Every condition is true or false, never null, so a negated one
also takes rows that lack the field or have no payload.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from vecspark.functions.payload import Field, canonical, number
from vecspark.types import FilterError, normalise_id

#: Fixed value: the mean radius of the Earth in metres.
EARTH = 6_371_008.8
SCALARS = ("STRING", "BOOLEAN")
#: Whether an indexed field is read as a number, its column, and for others whether it holds an array.
Shadow = tuple[bool, Column, Column]


def compile_filter(spec: dict[str, Any] | str | None, payload: Column, point_id: Column | None = None, shadows: dict[str, Shadow] | None = None) -> Column:
    """The filter over a payload column. shadows: typed columns of indexed fields, whose predicates reach the Parquet scan, as
    those on ids do."""
    spec = json.loads(spec) if isinstance(spec, str) else spec or {}
    if unknown := set(spec) - {"must", "must_not", "should", "min_should"}:
        raise FilterError(f"a filter has no {sorted(unknown)}")
    one = lambda c: _condition(c, payload, point_id)
    every: list[Column] = [one(c) for c in spec.get("must") or ()]
    every += [~one(c) for c in spec.get("must_not") or ()]
    if spec.get("should"):
        every.append(reduce(lambda a, b: a | b, map(one, spec["should"])))
    if least := spec.get("min_should"):
        held = [one(c).cast("int") for c in least["conditions"]]
        every.append(reduce(lambda a, b: a + b, held, F.lit(0)) >= least["min_count"])
    every = [p for c in spec.get("must") or () if (p := _on_shadow(c, shadows or {}, point_id)) is not None] + every
    return reduce(lambda a, b: a & b, every) if every else F.lit(True)


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres along the surface, of degrees."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    return 2 * EARTH * F.asin(F.sqrt(h))


def _condition(spec: dict[str, Any], payload: Column, point_id: Column | None) -> Column:
    try:
        condition, name = spec["condition"], spec.get("field", "")
        kind, arg = (condition, {}) if isinstance(condition, str) else next(iter(condition.items()))
        if kind == "HasId":
            if point_id is None:
                raise FilterError("HasId needs an id")
            return F.coalesce(point_id.isin([normalise_id(x) for x in arg["ids"]]), F.lit(False))
        if kind == "Not":
            return ~_condition({"field": name, "condition": arg["condition"]}, payload, point_id)
        held = KINDS[kind](Field(payload, name), arg or {}, point_id)
    except (KeyError, TypeError, StopIteration) as e:
        raise FilterError(f"this condition can't be read: {spec}") from e
    return F.coalesce(held, F.lit(False))


def _match(f: Field, arg: dict, _) -> Column:
    value = str(arg["value"])
    scalar = lambda tag, token: (tag.isin(*SCALARS) | number(tag)) & (token == value)
    return scalar(f.tag, f.token) | F.coalesce(F.exists(f.elements(), lambda e: F.coalesce(scalar(e.tag, e.token), F.lit(False))), F.lit(False))


def _match_any(f: Field, arg: dict, _) -> Column:
    def equal(tag: Column, token: Column, text: Column, value: Any) -> Column:
        if value is None:
            return tag == "VOID"
        if isinstance(value, bool):
            return (tag == "BOOLEAN") & (token == str(value).lower())
        if isinstance(value, (int, float)):
            return number(tag) & (token == canonical(value))
        if isinstance(value, str):
            return (tag == "STRING") & (token == value)
        return tag.startswith("OBJECT" if isinstance(value, dict) else "ARRAY") & (text == canonical(value))

    values = arg["values"]
    any_of = lambda tag, token, text: reduce(lambda a, b: a | b, [F.coalesce(equal(tag, token, text, v), F.lit(False)) for v in values], F.lit(False))
    return F.when(f.is_array(), F.exists(f.elements(), lambda e: any_of(e.tag, e.token, e.json))).otherwise(any_of(f.tag, f.token, F.to_json(f.variant)))


def _bounds(x: Column, arg: dict) -> Column:
    tests: dict[str, Callable[[Any], Column]] = {"gt": lambda v: x > v, "gte": lambda v: x >= v, "lt": lambda v: x < v, "lte": lambda v: x <= v}
    return reduce(lambda a, b: a & b, [tests[k](v) for k, v in arg.items() if v is not None], x.isNotNull())


def _is_empty(f: Field, _arg: dict, _) -> Column:
    return (f.is_array() | f.is_object()) & (f.count() == 0) | (f.tag == "STRING") & (f.token == "")


def _nested(f: Field, arg: dict, point_id: Column | None) -> Column:
    return F.exists(f.elements(), lambda e: F.coalesce(e.tag.startswith("OBJECT"), F.lit(False)) & compile_filter(arg["filter"], e.json, point_id))


def _geo_radius(f: Field, arg: dict, _) -> Column:
    return haversine(f.member("lat"), f.member("lon"), F.lit(float(arg["center"]["lat"])), F.lit(float(arg["center"]["lon"]))) <= float(arg["radius"])


def _geo_box(f: Field, arg: dict, _) -> Column:
    top, bottom = arg["top_left"], arg["bottom_right"]
    return f.member("lat").between(float(bottom["lat"]), float(top["lat"])) & f.member("lon").between(float(top["lon"]), float(bottom["lon"]))


def _contains(f: Field, arg: dict, _) -> Column:
    value = str(arg["value"])
    element = lambda e: F.coalesce((e.tag.isin(*SCALARS) | number(e.tag)) & (e.token == value), F.lit(False))
    return F.when(f.is_array(), F.exists(f.elements(), element)).otherwise((f.tag == "STRING") & f.token.contains(value))


def _starts_with(f: Field, arg: dict, _) -> Column:
    begins = lambda tag, token: F.coalesce((tag == "STRING") & token.startswith(str(arg["prefix"])), F.lit(False))
    return F.when(f.is_array(), F.exists(f.elements(), lambda e: begins(e.tag, e.token))).otherwise(begins(f.tag, f.token))


KINDS: dict[str, Callable[[Field, dict, Column | None], Column]] = {
    "Match": _match,
    "MatchAny": _match_any,
    "Range": lambda f, arg, _: _bounds(f.as_double(), arg),
    "IsEmpty": _is_empty,
    "IsNull": lambda f, arg, _: ~f.has | (f.tag == "VOID"),
    "Nested": _nested,
    "GeoRadius": _geo_radius,
    "GeoBoundingBox": _geo_box,
    "ValuesCount": lambda f, arg, _: _bounds(f.count(), arg),
    "Contains": _contains,
    "StartsWith": _starts_with,
}


def _on_shadow(spec: dict[str, Any], shadows: dict[str, Shadow], point_id: Column | None) -> Column | None:
    """What a must condition says about a typed column or the id: true wherever the condition is, so it only narrows the scan."""
    name, condition = spec.get("field"), spec.get("condition")
    if not isinstance(condition, dict):
        return None
    kind, arg = next(iter(condition.items()))
    if kind == "HasId" and point_id is not None:
        return point_id.isin([normalise_id(x) for x in arg["ids"]])
    if name not in shadows:
        return None
    numeric, value, many = shadows[name]
    if numeric:
        return _bounds(value, arg) if kind == "Range" else None
    if kind == "Match":
        return (value == str(arg["value"])) | many
    if kind == "MatchAny" and arg["values"] and all(isinstance(v, (bool, int, float, str)) for v in arg["values"]):
        return value.isin([v if isinstance(v, str) else canonical(v) for v in arg["values"]]) | many
    return None


class where:
    """Builders of conditions: where.match("color", "red"), where.range("price", gte=10) and so on."""

    @staticmethod
    def _of(name: str, condition: Any) -> dict[str, Any]:
        return {"field": name, "condition": condition}

    match = staticmethod(lambda name, value: where._of(name, {"Match": {"value": value}}))
    match_any = staticmethod(lambda name, values: where._of(name, {"MatchAny": {"values": list(values)}}))
    range = staticmethod(lambda name, **bounds: where._of(name, {"Range": bounds}))
    is_empty = staticmethod(lambda name: where._of(name, "IsEmpty"))
    is_null = staticmethod(lambda name: where._of(name, "IsNull"))
    has_id = staticmethod(lambda ids: where._of("_id", {"HasId": {"ids": list(ids)}}))
    nested = staticmethod(lambda name, spec: where._of(name, {"Nested": {"filter": spec}}))
    geo_radius = staticmethod(lambda name, lat, lon, radius: where._of(name, {"GeoRadius": {"center": {"lat": lat, "lon": lon}, "radius": radius}}))
    geo_box = staticmethod(lambda name, top, left, bottom, right: where._of(name, {"GeoBoundingBox": {"top_left": {"lat": top, "lon": left}, "bottom_right": {"lat": bottom, "lon": right}}}))
    values_count = staticmethod(lambda name, **bounds: where._of(name, {"ValuesCount": bounds}))
    contains = staticmethod(lambda name, value: where._of(name, {"Contains": {"value": value}}))
    starts_with = staticmethod(lambda name, prefix: where._of(name, {"StartsWith": {"prefix": prefix}}))
    negated = staticmethod(lambda condition: where._of(condition["field"], {"Not": {"condition": condition["condition"]}}))
