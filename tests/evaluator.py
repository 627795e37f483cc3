"""The filter language over Python values, row by row: what the compiled columns are held against."""

import math

EARTH = 6_371_008.8


def text(v):
    if isinstance(v, bool):
        return str(v).lower()
    return v if isinstance(v, str) else repr(v) if isinstance(v, float) else str(v)


def matches(spec, payload, point_id):
    one = lambda c: leaf(c, payload, point_id)
    groups = [
        all(one(c) for c in spec.get("must") or ()),
        not any(one(c) for c in spec.get("must_not") or ()),
        not spec.get("should") or any(one(c) for c in spec["should"]),
    ]
    least = spec.get("min_should")
    return all(groups) and (not least or sum(one(c) for c in least["conditions"]) >= least["min_count"])


def is_number(v):
    return isinstance(v, (int, float)) and not isinstance(v, bool)


def within(x, b):
    return (b.get("gt") is None or x > b["gt"]) and (b.get("gte") is None or x >= b["gte"]) and (b.get("lt") is None or x < b["lt"]) and (b.get("lte") is None or x <= b["lte"])


def same(a, b):
    return type(a) is type(b) and a == b


def leaf(c, payload, point_id):
    cond, name = c["condition"], c.get("field")
    kind, arg = (cond, {}) if isinstance(cond, str) else next(iter(cond.items()))
    if kind == "HasId":
        return point_id in {str(int(x)) if str(x).lstrip("+").isdigit() else str(x) for x in arg["ids"]}
    if kind == "Not":
        return not leaf({"field": name, "condition": arg["condition"]}, payload, point_id)
    has = payload is not None and name in payload
    v = payload[name] if has else None
    if kind == "IsNull":
        return v is None
    if not has:
        return False
    scalar = lambda x: isinstance(x, (str, bool, int, float))
    if kind == "Match":
        return any(scalar(x) and text(x) == arg["value"] for x in (v if isinstance(v, list) else [v]))
    if kind == "MatchAny":
        return any(same(x, y) for x in (v if isinstance(v, list) else [v]) for y in arg["values"])
    if kind == "Range":
        return is_number(v) and within(v, arg)
    if kind == "IsEmpty":
        return v in ([], {}, "") and not is_number(v)
    if kind == "ValuesCount":
        return within(len(v) if isinstance(v, (list, dict)) else 0 if v is None else 1, arg)
    if kind == "Contains":
        return any(scalar(x) and text(x) == arg["value"] for x in v) if isinstance(v, list) else isinstance(v, str) and arg["value"] in v
    if kind == "StartsWith":
        return any(isinstance(x, str) and x.startswith(arg["prefix"]) for x in (v if isinstance(v, list) else [v]))
    if kind == "Nested":
        return isinstance(v, list) and any(isinstance(x, dict) and matches(arg["filter"], x, point_id) for x in v)
    if not (isinstance(v, dict) and is_number(v.get("lat")) and is_number(v.get("lon"))):
        return False
    if kind == "GeoRadius":
        a, b = math.radians(v["lat"]), math.radians(arg["center"]["lat"])
        h = math.sin((b - a) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin(math.radians(arg["center"]["lon"] - v["lon"]) / 2) ** 2
        return 2 * EARTH * math.asin(math.sqrt(h)) <= arg["radius"]
    return arg["bottom_right"]["lat"] <= v["lat"] <= arg["top_left"]["lat"] and arg["top_left"]["lon"] <= v["lon"] <= arg["bottom_right"]["lon"]
