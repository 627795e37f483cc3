import json

import pytest
from pyspark.sql import functions as F

from tests.evaluator import matches
from vecspark.plans.filters import compile_filter, where
from vecspark.types import FilterError, normalise_id

PAYLOADS = [
    None, {}, {"f": None}, {"f": "red"}, {"f": "re"}, {"f": ""}, {"f": 12}, {"f": 12.0}, {"f": 0.1}, {"f": -3}, {"f": "12"}, {"f": True}, {"f": False},
    {"f": []}, {"f": {}}, {"f": ["red", 12]}, {"f": [12.0, "x"]}, {"f": [None, "red"]}, {"f": {"a": 1, "b": 2}}, {"f": [{"city": "lyon", "zip": 3}, {"city": "paris"}]},
    {"f": [{"city": "berlin"}]}, {"f": {"lat": 48.8566, "lon": 2.3522}}, {"f": {"lat": 45.764, "lon": 4.8357}}, {"f": {"lat": "48", "lon": 2}}, {"a.b": "red"}, {"f": "redder é\"quote"}, {"f": 1e3}, {"g": "red"},
]
LEAVES = [
    where.match("f", "red"), where.match("f", "12"), where.match("f", "12.0"), where.match("f", "true"), where.match("a.b", "red"),
    where.match_any("f", ["red", 12]), where.match_any("f", [12.0, None]), where.match_any("f", [True, "x"]), where.match_any("f", [{"a": 1, "b": 2}]),
    where.range("f", gte=0, lt=12.5), where.range("f", gt=12), where.range("f", lte=-3), where.is_empty("f"), where.is_null("f"), where.has_id([3, "007", "x"]),
    where.nested("f", {"must": [where.match("city", "lyon"), where.range("zip", lte=3)]}), where.nested("f", {"must_not": [where.match("city", "paris")]}),
    where.geo_radius("f", 48.8566, 2.3522, 1000), where.geo_radius("f", 48.8566, 2.3522, 400_000), where.geo_box("f", 50, 2, 45, 3),
    where.values_count("f", gte=2), where.values_count("f", lte=0), where.contains("f", "re"), where.contains("f", "12"), where.starts_with("f", "red"), where.starts_with("f", "1"),
]
LEAVES += [where.negated(c) for c in LEAVES[:12]]
GROUPS = [
    {}, {"should": []}, {"must": LEAVES[:2]}, {"must_not": [LEAVES[0], LEAVES[13]]}, {"should": [LEAVES[0], LEAVES[9]]},
    {"min_should": {"conditions": [LEAVES[0], LEAVES[22], LEAVES[24]], "min_count": 2}}, {"min_should": {"conditions": [], "min_count": 0}},
    {"should": [LEAVES[12]], "min_should": {"conditions": [LEAVES[0], LEAVES[20]], "min_count": 1}},
]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(i, str(i), json.dumps(p) if p is not None else None) for i, p in enumerate(PAYLOADS)], "slot long, id string, payload string").cache()


def test_every_condition_is_what_the_evaluator_says(rows):
    specs = [{"must": [c]} for c in LEAVES] + GROUPS
    for at in range(0, len(specs), 12):
        some = specs[at : at + 12]
        got = rows.select("slot", *[compile_filter(s, F.col("payload"), F.col("id")).alias(f"s{i}") for i, s in enumerate(some)]).orderBy("slot").collect()
        for i, s in enumerate(some):
            want = [matches(s, p, str(n)) for n, p in enumerate(PAYLOADS)]
            assert [r[f"s{i}"] for r in got] == want, s


def test_filters_that_cannot_be_read(rows):
    for bad in ({"most": []}, {"must": [{"field": "f", "condition": {"Nothing": {}}}]}, {"must": [{"field": "f", "condition": {"Match": {}}}]}, {"must": [where.match('a"b', "x")]}):
        with pytest.raises(FilterError):
            compile_filter(bad, F.col("payload"), F.col("id"))


def test_ids_have_one_text():
    assert [normalise_id(x) for x in ("007", "+7", 7, "x7", "", str(1 << 64), "-7")] == ["7", "7", "7", "x7", "", str(1 << 64), "-7"]
