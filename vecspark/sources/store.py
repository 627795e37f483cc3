"""A collection as keyed Parquet tables: a base of all points, tables of later changes, and a manifest that names them.

A change holds whole rows, so a point is as its latest change says, or else as the base does: reading is a left-anti join and
a union. A writer adds the next manifest, which it can only do if no one else has; readers keep the tables that theirs named.
Changes are merged with others of about their size, and become part of the base when they are a share of it, so what a change
costs doesn't grow with the collection. The base's index columns are made for the new rows then, so indexes stay.
"""

from __future__ import annotations

import math
import os
import re
from collections.abc import Callable
from typing import Any, TypeVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vecspark.functions.payload import Field
from vecspark.plans.filters import Shadow
from vecspark.sources.files import Files, checkpointed
from vecspark.types import POINTS, SCHEMA_TAGS, AlreadyExists, CapacityExceeded, CollectionConfig, Conflict, InvalidConfig, InvalidDimension, InvalidId, InvalidPayload, NonFinite

CHANGES = "lsn long, live boolean, id string, slot long, vector array<float>, payload string"
#: A share of the base's bytes that changes may have, and bytes that they always may.
FOLD_SHARE, FOLD_LEAST = 0.25, 64 << 20
#: Changes of about the same size that are merged into one, and the bytes of the smallest size.
MERGED, SMALLEST = 8, 1 << 20
#: Ids of a change by which the base's files are chosen; more are joined.
FEW = 1000
#: Rows of an inverted list's file, about.
FILE_ROWS = 1_000_000
#: Writers that came first, before one gives up.
TRIES = 20

#: Tags of payload indexes that hold numbers.
NUMERIC = ("integer", "float")

R = TypeVar("R")
Manifest = dict[str, Any]


class Store:
    def __init__(self, spark: SparkSession, files: Files, name: str) -> None:
        self.spark, self.files, self.name = spark, files, name

    # Manifests

    @classmethod
    def create(cls, spark: SparkSession, files: Files, name: str, config: CollectionConfig) -> Store:
        store = cls(spark, files, name)
        files.make(name)
        spark.range(0).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in POINTS)).write.mode("overwrite").parquet(files.at(f"{name}/v=0"))
        first = {"number": 0, "base": "v=0", "base_bytes": 0, "lsn": 0, "next_slot": 0, "live": 0, "changes": [], "config": config.to_dict(), "payload_indexes": {}, "shadows": [], "index": None, "quantization": None, "revision": 0, "batches": {}}
        if not files.create_json(f"{name}/manifest-0.json", first):
            raise AlreadyExists(f"{name} exists")
        return store

    @staticmethod
    def latest(files: Files, name: str) -> int | None:
        """The number of the newest manifest."""
        if not files.exists(name):
            return None
        return max((int(m[1]) for f in files.files(name) if (m := re.fullmatch(r"manifest-(\d+)\.json", f))), default=None)

    def manifest(self) -> Manifest:
        return self.files.read_json(f"{self.name}/manifest-{self.latest(self.files, self.name)}.json")

    def commit(self, manifest: Manifest) -> bool:
        """manifest as the next one; False if another writer came first."""
        manifest = manifest | {"number": manifest["number"] + 1, "revision": manifest["revision"] + 1}
        return self.files.create_json(f"{self.name}/manifest-{manifest['number']}.json", manifest)

    def change(self, work: Callable[[Manifest], R]) -> R:
        """What work(manifest) returns, once the manifest that it has changed is the newest; done again if another writer came first."""
        for _ in range(TRIES):
            manifest = self.manifest()
            result = work(manifest)
            if self.commit(manifest):
                return result
        raise Conflict(f"other writers keep changing {self.name}")

    @property
    def config(self) -> CollectionConfig:
        return CollectionConfig.from_dict(self.manifest()["config"])

    def new_folder(self, kind: str) -> str:
        return f"{kind}-{os.urandom(8).hex()}"

    # Reading

    def base(self, manifest: Manifest) -> DataFrame:
        return self.spark.read.parquet(self.files.at(f"{self.name}/{manifest['base']}"))

    def changes(self, manifest: Manifest) -> DataFrame | None:
        """The latest change of each changed id, or None if nothing waits."""
        if not manifest["changes"]:
            return None
        return self._latest([c["folder"] for c in manifest["changes"]])

    def _latest(self, folders: list[str]) -> DataFrame:
        rows = self.spark.read.schema(CHANGES).parquet(*[self.files.at(f"{self.name}/{f}") for f in folders])
        return rows.groupBy("id").agg(F.max_by(F.struct("lsn", "live", "slot", "vector", "payload"), "lsn").alias("_c")).select("id", "_c.*")

    def settled(self, manifest: Manifest) -> DataFrame:
        """The base's points that no change has touched, with the columns of indexes."""
        changed = self.changes(manifest)
        return self.base(manifest) if changed is None else self.base(manifest).join(changed.select("id"), "id", "left_anti")

    def pending(self, manifest: Manifest) -> DataFrame | None:
        """The changed points that live (slot, id, vector, payload), or None."""
        changed = self.changes(manifest)
        return None if changed is None else changed.where("live").select("slot", "id", "vector", "payload")

    def points(self, manifest: Manifest | None = None) -> DataFrame:
        """Live points: slot, id, vector, payload."""
        manifest = manifest or self.manifest()
        settled, pending = self.settled(manifest).select("slot", "id", "vector", "payload"), self.pending(manifest)
        return settled if pending is None else settled.unionByName(pending)

    def with_ids(self, manifest: Manifest, ids: list[str]) -> DataFrame:
        """The live points of a few ids; row groups that can't have them aren't read."""
        settled = self.base(manifest).where(F.col("id").isin(ids)).select("slot", "id", "vector", "payload")
        if not manifest["changes"]:
            return settled
        changed = checkpointed(self.changes(manifest).where(F.col("id").isin(ids)))
        return settled.join(F.broadcast(changed.select("id")), "id", "left_anti").unionByName(changed.where("live").select("slot", "id", "vector", "payload"))  # as many as ids

    def shadows(self, manifest: Manifest) -> dict[str, Shadow]:
        """The base's columns of indexed fields."""
        known = {f: manifest["payload_indexes"][f] for f in manifest["shadows"] if f in manifest["payload_indexes"]}
        return {f: (tag in NUMERIC, F.col(f"`p_{f}`"), F.lit(False) if tag in NUMERIC else F.col(f"`m_{f}`").isNotNull()) for f, tag in known.items() if tag != "geo"}

    # Writing

    def prepare(self, manifest: Manifest, rows: DataFrame) -> tuple[int, int]:
        """Adds rows to manifest as one change; returns how many points are new and how many are gone.

        rows: id, vector, payload (JSON text or null), seq, and live and renew, both boolean. Of equal ids the row of the largest
        seq counts; one that isn't live takes the point away. A known id keeps its slot unless renew says that it was taken away
        before; new ones get slots in the order in which they first come. All rows are checked before any counts, and rows is
        read once for what is written.
        """
        config = CollectionConfig.from_dict(manifest["config"])
        rows = rows.select(F.col("id").cast("string").alias("id"), F.col("vector").cast("array<float>").alias("vector"), F.col("payload").cast("string").alias("payload"), F.col("seq").cast("long").alias("seq"), "live", "renew")
        flag = lambda bad: F.max(F.coalesce(F.col("live") & bad, F.lit(True)).cast("int"))
        infinite = F.exists("vector", lambda x: F.coalesce(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(True)))
        odd = F.col("payload").isNotNull() & ~F.coalesce(F.schema_of_variant(F.try_parse_json("payload")).startswith("OBJECT"), F.lit(False))
        checks = {"dim": F.size("vector") != config.dim, "infinite": F.col("vector").isNotNull() & infinite, "odd": odd}
        one = rows.groupBy("id").agg(F.min("seq").alias("first"), F.max_by(F.struct("vector", "payload", "live", "renew"), "seq").alias("_r"), *(flag(v).alias(f"_{k}") for k, v in checks.items())).select("id", "first", "_r.*", *(f"_{k}" for k in checks))
        one = checkpointed(one)
        found = one.agg(F.count("*").alias("n"), F.count(F.when(F.col("id").isNull(), 1)).alias("ids"), *(F.coalesce(F.sum(f"_{k}"), F.lit(0)).alias(k) for k in checks)).first()
        if found.ids:
            raise InvalidId(f"{found.ids} points have no id")
        if found.dim:
            raise InvalidDimension(f"vectors of {found.dim} points don't have {config.dim} elements")
        if found.infinite:
            raise NonFinite(f"{found.infinite} points have elements that aren't finite")
        if found.odd:
            raise InvalidPayload(f"payloads of {found.odd} points aren't JSON objects")
        if not found.n:
            return 0, 0
        known = self.with_ids(manifest, [r.id for r in one.select("id").collect()]) if found.n <= FEW else self.points(manifest)
        joined = one.drop(*(f"_{k}" for k in checks)).join(known.select("id", F.col("slot").alias("old")), "id", "left").where("live OR old IS NOT NULL")
        ranged = checkpointed(joined.withColumn("slot", F.when(~F.coalesce("renew", F.lit(False)), F.col("old"))).repartitionByRange("first", "id").withColumn("_part", F.spark_partition_id()))
        fresh = F.col("live") & F.col("slot").isNull()
        sizes = ranged.groupBy("_part").agg(F.count(F.when(fresh, 1)).alias("fresh"), F.count(F.when(F.col("live") & F.col("old").isNull(), 1)).alias("more"), F.count(F.when(~F.col("live"), 1)).alias("gone"), F.count("*").alias("n")).orderBy("_part").collect()
        more, gone, n = (sum(r[k] for r in sizes) for k in ("more", "gone", "n"))
        if config.max_points is not None and more > gone and manifest["live"] + more - gone > config.max_points:
            raise CapacityExceeded(f"{self.name} holds {config.max_points} points at most, not {manifest['live'] + more - gone}")
        if not n:
            return 0, 0
        begin, at = [], manifest["next_slot"]
        for r in sizes:
            begin.append((r["_part"], at))
            at += r.fresh
        before = beginnings(self.spark, begin)
        running = F.sum(fresh.cast("long")).over(Window.partitionBy("_part").orderBy("first", "id"))
        numbered = ranged.withColumn("_n", running).join(F.broadcast(before), "_part").withColumn("slot", F.when(fresh, F.col("_begin") + F.col("_n") - 1).otherwise(F.coalesce("slot", "old")))  # a row for each partition
        lsn, folder = manifest["lsn"] + 1, self.new_folder("changes")
        when_live = lambda c: F.when(F.col("live"), F.col(c)).alias(c)
        numbered.select(F.lit(lsn).cast("long").alias("lsn"), "live", "id", "slot", when_live("vector"), when_live("payload")).write.parquet(self.files.at(f"{self.name}/{folder}"))
        manifest |= {"lsn": lsn, "next_slot": at, "live": manifest["live"] + more - gone, "changes": [*manifest["changes"], self._told(folder, n)]}
        self._merge_changes(manifest)
        return more, gone

    def _told(self, folder: str, rows: int) -> dict[str, Any]:
        return {"folder": folder, "rows": rows, "bytes": self.files.size(f"{self.name}/{folder}")}

    def _merge_changes(self, manifest: Manifest) -> None:
        """The newest MERGED changes become one as long as they are of about the same size."""
        size = lambda c: int(math.log(max(c["bytes"], SMALLEST) / SMALLEST, MERGED))
        while len(last := manifest["changes"][-MERGED:]) == MERGED and len(set(map(size, last))) == 1:
            folder = self.new_folder("changes")
            merged = self._latest([c["folder"] for c in last])
            merged.select(*(c.split()[0] for c in CHANGES.split(", "))).write.parquet(self.files.at(f"{self.name}/{folder}"))
            rows = self.spark.read.parquet(self.files.at(f"{self.name}/{folder}")).count()
            manifest["changes"] = [*manifest["changes"][:-MERGED], self._told(folder, rows)]

    def due(self, manifest: Manifest) -> bool:
        """Whether changes have grown to their share of the base."""
        return sum(c["bytes"] for c in manifest["changes"]) > max(FOLD_LEAST, FOLD_SHARE * manifest["base_bytes"])

    def write_base(self, manifest: Manifest, points: DataFrame, by_list: bool = False) -> None:
        """points as the new base, with the columns of declared payload indexes, sorted by the first of them; no change waits then."""
        folder = self.new_folder("v")
        for name, tag in manifest["payload_indexes"].items():
            points = points.withColumns(shadow(F.col("payload"), name, tag))
        points = points.drop(*(f"{c}_{n}" for n in manifest["shadows"] if n not in manifest["payload_indexes"] for c in "pm"))
        if by_list:
            points = checkpointed(points)
            sizes = points.groupBy("list_id").count().select("list_id", F.ceil(F.col("count") / FILE_ROWS).alias("_files"))
            points = points.join(F.broadcast(sizes), "list_id")  # a row for each list
            points = points.repartition("list_id", F.pmod(F.xxhash64("slot"), "_files")).drop("_files")
        lead = [f"`p_{n}`" for n, tag in manifest["payload_indexes"].items() if tag != "geo"][:1]
        writer = points.sortWithinPartitions(*lead, "slot").write.option("parquet.bloom.filter.enabled#id", "true")
        for name, tag in manifest["payload_indexes"].items():
            if tag == "keyword":
                writer = writer.option(f"parquet.bloom.filter.enabled#p_{name}", "true")
        (writer.partitionBy("list_id") if by_list else writer).parquet(self.files.at(f"{self.name}/{folder}"))
        manifest |= {"base": folder, "base_bytes": self.files.size(f"{self.name}/{folder}"), "changes": [], "shadows": list(manifest["payload_indexes"])}

    def vacuum(self) -> list[str]:
        """Deletes tables that neither the newest manifest nor the one before it names, and older manifests."""
        newest = self.latest(self.files, self.name)
        kept, gone = set(), []
        for n in (newest, newest - 1):
            if n >= 0 and self.files.exists(f"{self.name}/manifest-{n}.json"):
                told = self.files.read_json(f"{self.name}/manifest-{n}.json")
                kept |= {told["base"], *(c["folder"] for c in told["changes"]), *(told["index"] or {}).get("folders", ())}
        for folder in self.files.folders(self.name):
            if folder not in kept:
                self.files.delete(f"{self.name}/{folder}")
                gone.append(folder)
        for f in self.files.files(self.name):
            if (m := re.fullmatch(r"manifest-(\d+)\.json", f)) and int(m[1]) < newest - 1:
                self.files.delete(f"{self.name}/{f}")
        return gone

    # Payload indexes

    @staticmethod
    def check_index(manifest: Manifest, field: str, tag: str) -> str:
        tag = tag.strip().lower()
        if field == "_id" or tag not in SCHEMA_TAGS:
            raise InvalidConfig(f"{field} can't be indexed as {tag}")
        if field in manifest["payload_indexes"]:
            raise AlreadyExists(f"{field} has an index")
        return tag


def shadow(payload: Column, name: str, tag: str) -> dict[str, Column]:
    """The columns of an indexed field: a number, or a value's text and whether it is an array instead. Null where the field has
    another type, so they narrow only what they can tell."""
    field = Field(payload, name)
    if tag in NUMERIC:
        return {f"p_{name}": field.as_double()}
    if tag == "geo":
        return {}
    scalar = field.tag.isin("STRING", "BOOLEAN") | field.is_number()
    return {f"p_{name}": F.when(scalar, field.token), f"m_{name}": F.when(field.is_array(), True)}


def beginnings(spark: SparkSession, begin: list[tuple[int, int]]) -> DataFrame:
    """(_part, _begin) as an Arrow table: rows of a list would start Python workers on each executor, which stay there."""
    return spark.createDataFrame(pa.table({"_part": pa.array([part for part, _ in begin], pa.int32()), "_begin": pa.array([at for _, at in begin], pa.int64())}))


def number_in_order(rows: DataFrame, start: int) -> DataFrame:
    """rows with slot: start, start + 1 ... in the order of slot. Ranges are numbered by themselves, after a count of each."""
    ranged = checkpointed(rows.repartitionByRange("slot").withColumn("_part", F.spark_partition_id()))
    begin, at = [], start
    for r in ranged.groupBy("_part").count().orderBy("_part").collect():
        begin.append((r["_part"], at))
        at += r["count"]
    before = beginnings(rows.sparkSession, begin)
    place = F.row_number().over(Window.partitionBy("_part").orderBy("slot"))
    return ranged.withColumn("_n", place).join(F.broadcast(before), "_part").withColumn("slot", F.col("_begin") + F.col("_n") - 1).drop("_part", "_n", "_begin")


def estimate(dim: int, live: int, index: bool) -> int:
    """Bytes of vectors, keys and, if there is one, an index, about."""
    return live * (4 * dim + 64) + (live * 4 * round(2 * math.log2(live + 2)) if index else 0)
