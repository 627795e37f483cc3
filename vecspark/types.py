"""Points, queries, configurations and errors."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import types as T

METRICS = ("Cosine", "Euclid", "Dot", "Manhattan")
SCHEMA_TAGS = ("keyword", "integer", "float", "text", "bool", "geo", "datetime")

POINTS = T.StructType([
    T.StructField("slot", T.LongType()),
    T.StructField("id", T.StringType()),
    T.StructField("vector", T.ArrayType(T.FloatType())),
    T.StructField("payload", T.StringType()),
])


class VectorError(Exception):
    """Every error that this library raises by itself; code tells the kinds apart."""

    code = 1


class NotFound(VectorError):
    code = 2


class AlreadyExists(VectorError):
    code = 3


class InvalidConfig(VectorError):
    code = 4


class InvalidDimension(VectorError):
    code = 5


class InvalidPoint(VectorError):
    """A point that can't be stored; the next four say why."""

    code = 6


class CapacityExceeded(VectorError):
    code = 7


class FilterError(VectorError):
    code = 8


class Misuse(VectorError):
    code = 9


class InvalidId(InvalidPoint):
    code = 10


class NonFinite(InvalidPoint):
    code = 11


class InvalidPayload(InvalidPoint):
    code = 12


class UnknownPoint(InvalidPoint):
    code = 13


class InvalidName(InvalidConfig):
    code = 14


class UnsupportedMetric(InvalidConfig):
    code = 15


class Incomplete(NotFound):
    """A collection's folder without a table or manifest that it should have."""

    code = 16


class CorruptData(VectorError):
    """A manifest or snapshot that can't be read."""

    code = 17


class Conflict(VectorError):
    """Other writers came first, each time."""

    code = 18


MOST_ID = str((1 << 64) - 1)


def normalise_id(value: Any) -> str:
    """The canonical text of an id: a number below 2^64, however it is written, or the text itself."""
    text = str(value)
    digits = text[1:] if text[:1] == "+" else text
    if digits.isascii() and digits.isdigit():
        short = digits.lstrip("0") or "0"
        if (len(short), short) <= (len(MOST_ID), MOST_ID):
            return short
    return text


def check_vector(vector: Sequence[float], dim: int) -> list[float]:
    if len(vector) != dim:
        raise InvalidDimension(f"the vector has {len(vector)} elements, the collection {dim}")
    if not all(math.isfinite(x) for x in vector):
        raise NonFinite("every element of a vector has to be finite")
    return [float(x) for x in vector]


@dataclass
class HnswConfig:
    m: int = 16
    ef_construct: int = 100
    ef_search: int = 40
    full_scan_threshold: int = 10_000
    iterative_max_rounds: int = 3
    max_scan_tuples: int | None = None

    def validate(self) -> None:
        if self.m < 2 or self.ef_construct < max(2 * self.m, 4):
            raise InvalidConfig("m must be at least 2 and ef_construct at least 2 m and 4")
        if self.iterative_max_rounds < 1 or (self.max_scan_tuples is not None and self.max_scan_tuples < 1):
            raise InvalidConfig("iterative_max_rounds and max_scan_tuples must be at least 1")


@dataclass
class IvfConfig:
    lists: int | None = None
    min_build_points: int = 100_000
    sample_limit: int = 65_536
    kmeans_max_iter: int = 64
    drift_threshold: float = 0.10
    default_nprobe: int = 8
    max_probes: int | None = None
    auto_promotion: bool = False

    def validate(self) -> None:
        if self.lists is not None and self.lists < 1:
            raise InvalidConfig("lists must be at least 1")
        if not 1 <= self.kmeans_max_iter <= 500 or self.default_nprobe < 1:
            raise InvalidConfig("kmeans_max_iter must be 1 to 500 and default_nprobe at least 1")

    def lists_for(self, live: int) -> int:
        return self.lists or max(1, min(4096, round(math.sqrt(live))))


@dataclass
class QuantizationConfig:
    kind: str = "scalar"
    quantile: float = 0.99
    ratio: int = 16

    def validate(self) -> None:
        if self.kind not in ("scalar", "binary", "product"):
            raise InvalidConfig(f"there is no quantization {self.kind}")
        if not 0 < self.quantile <= 1:
            raise InvalidConfig("quantile must be above 0 and at most 1")
        if self.ratio not in (4, 8, 16, 32, 64):
            raise InvalidConfig("ratio must be 4, 8, 16, 32 or 64")

    def parts(self, dim: int) -> int:
        """Subspaces of a product code: dim * 4 / ratio rounded up, lowered to a divisor of dim."""
        most = min(dim, max(1, math.ceil(dim * 4 / self.ratio)))
        return next(m for m in range(most, 0, -1) if dim % m == 0)


@dataclass
class CollectionConfig:
    dim: int = 1536
    metric: str = "Cosine"
    index: str = "Hnsw"
    hnsw: HnswConfig = field(default_factory=HnswConfig)
    ivf: IvfConfig = field(default_factory=IvfConfig)
    quantization: QuantizationConfig | None = None
    max_points: int | None = None
    compaction_ratio: float = 0.20

    def validate(self) -> None:
        if self.metric not in METRICS:
            raise UnsupportedMetric(f"there is no metric {self.metric}")
        if self.dim < 1 or self.index not in ("Flat", "Hnsw", "Ivf"):
            raise InvalidConfig("dim must be at least 1, and index a known one")
        if self.max_points is not None and self.max_points < 1:
            raise InvalidConfig("max_points must be at least 1")
        self.hnsw.validate()
        self.ivf.validate()
        if self.quantization:
            self.quantization.validate()

    def to_dict(self) -> dict[str, Any]:
        return asdict(self)

    @classmethod
    def from_dict(cls, d: dict[str, Any]) -> CollectionConfig:
        d = dict(d)
        for name, kind in (("hnsw", HnswConfig), ("ivf", IvfConfig), ("quantization", QuantizationConfig)):
            if isinstance(d.get(name), dict):
                d[name] = kind(**d[name])
        try:
            return cls(**d)
        except TypeError as e:
            raise InvalidConfig(str(e)) from e


@dataclass
class SearchQuery:
    """limit and offset count after the threshold. `k` or `radius` stand for a search mode and are always honoured."""

    vector: list[float]
    limit: int = 10
    offset: int = 0
    filter: dict[str, Any] | None = None
    score_threshold: float | None = None
    with_payload: bool = True
    with_vector: bool = False
    include: list[str] | None = None
    exclude: list[str] | None = None
    k: int | None = None
    ef_search: int | None = None
    radius: float | None = None
    max_results: int | None = None
    exact: bool = False
    ignore_quantization: bool = False
    rescore: bool | None = None
    oversampling: float | None = None
    nprobe: int | None = None

    @property
    def wanted(self) -> int:
        return self.k if self.k is not None else self.max_results if self.max_results is not None else self.limit

    @property
    def threshold(self) -> float | None:
        floors = [t for t in (self.score_threshold, self.radius) if t is not None]
        return max(floors) if floors else None

    @property
    def wide(self) -> list[str]:
        """Columns of a point that are asked for."""
        return ["payload"] * self.with_payload + ["vector"] * self.with_vector

    @classmethod
    def from_dict(cls, d: dict[str, Any]) -> SearchQuery:
        try:
            return cls(**d)
        except TypeError as e:
            raise Misuse(str(e)) from e
