"""The engine: named collections under a root folder, and everything that is done with them."""

from __future__ import annotations

import json
import math
import time
from collections import Counter
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from dataclasses import asdict
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspark.functions import distance as D
from vecspark.functions.payload import canonical, canonical_id, edited
from vecspark.operators import graph, ivf
from vecspark.operators import quantization as quant
from vecspark.operators.search import batch_search, best_scored, filtered, projected, rank_scored, top_of_each
from vecspark.plans.filters import compile_filter
from vecspark.sources.files import Files
from vecspark.sources.store import Manifest, Store, estimate, number_in_order
from vecspark.types import POINTS, AlreadyExists, CollectionConfig, CorruptData, HnswConfig, Incomplete, InvalidConfig, InvalidName, InvalidPoint, IvfConfig, Misuse, NotFound, QuantizationConfig, SearchQuery, UnknownPoint, check_vector, normalise_id

__version__ = "0.1.0"
REBUILD, OLD, SUSPECT = ".rebuild-", ".old-", ".suspect-"
POINT_ROW = "id string, vector array<float>, payload string, seq long, live boolean, renew boolean"
#: Percentiles of metrics; a call's time counts as the next power of two of microseconds.
PERCENTILES = (0.5, 0.95, 0.99)


class Engine:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.files = spark, Files(spark, root)
        self.metrics: dict[str, Counter] = {}
        self.times: dict[tuple[str, str], Counter] = {}
        self.defaults: dict[str, Any] = {"hnsw": HnswConfig(), "ivf": IvfConfig(), "quantization": None}

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> Engine:
        return cls(spark, root)

    @property
    def root_dir(self) -> str:
        return self.files.root

    def __enter__(self) -> Engine:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        """Nothing is held between calls."""

    # Collections

    def _store(self, name: str) -> Store:
        if not self.collection_exists(name):
            if name and self.files.exists(name):
                raise Incomplete(f"{name} has no manifest")
            raise NotFound(f"there is no collection {name}")
        return Store(self.spark, self.files, name)

    def create_collection(self, name: str, config: dict[str, Any] | CollectionConfig | None = None) -> None:
        if not name or name in (".", "..") or set(name) & set("/\\\0"):
            raise InvalidName(f"a collection can't be named {name!r}")
        if isinstance(config, CollectionConfig):
            made = config
        else:
            given = {k: asdict(v) if v is not None else None for k, v in self.defaults.items()} | (config or {})
            made = CollectionConfig.from_dict(given)
        made.validate()
        if self.collection_exists(name):
            raise AlreadyExists(f"{name} exists")
        Store.create(self.spark, self.files, name, made)

    def delete_collection(self, name: str) -> None:
        self._store(name)
        self.files.delete(name)

    def collection_exists(self, name: str) -> bool:
        return bool(name) and Store.latest(self.files, name) is not None

    def list_collections(self) -> list[str]:
        return [n for n in self.files.folders() if self.collection_exists(n)]

    def collection_names(self) -> list[str]:
        """Without scratch and backup collections."""
        return [n for n in self.list_collections() if not any(mark in n for mark in (REBUILD, OLD, SUSPECT))]

    def collection_config(self, name: str) -> dict[str, Any]:
        return self._store(name).manifest()["config"]

    def collection_info(self, name: str) -> dict[str, Any]:
        manifest = self._store(name).manifest()
        return {"name": name, "points": manifest["live"], "dim": manifest["config"]["dim"], "metric": manifest["config"]["metric"], "tombstones": manifest["next_slot"] - manifest["live"], "version": manifest["number"], "pending_changes": pending_rows(manifest), "payload_indexes": manifest["payload_indexes"], "index": self.index_info(name), "quantized": bool(manifest["quantization"])}

    def memory_estimate(self, name: str) -> int:
        return estimate(self._store(name).config.dim, self.count(name), self.has_index(name))

    def _change_config(self, name: str, part: str, value: Any) -> None:
        value.validate()

        def work(manifest: Manifest) -> None:
            if part != "quantization" and manifest["config"]["index"].lower() != part:
                raise InvalidConfig(f"{name} isn't indexed by {part}")
            manifest["config"][part] = asdict(value)

        self._store(name).change(work)

    def set_hnsw_config(self, name: str, **values: Any) -> None:
        self._change_config(name, "hnsw", HnswConfig(**values))

    def set_ivf_config(self, name: str, **values: Any) -> None:
        self._change_config(name, "ivf", IvfConfig(**values))

    def set_quantization_config(self, name: str, **values: Any) -> None:
        self._change_config(name, "quantization", QuantizationConfig(**values))

    def set_default_hnsw_config(self, **values: Any) -> None:
        self._default("hnsw", HnswConfig(**values))

    def set_default_ivf_config(self, **values: Any) -> None:
        self._default("ivf", IvfConfig(**values))

    def set_default_quantization_config(self, **values: Any) -> None:
        self._default("quantization", QuantizationConfig(**values) if values else None)

    def _default(self, part: str, value: Any) -> None:
        if value is not None:
            value.validate()
        self.defaults[part] = value

    def get_default_hnsw_config(self) -> dict[str, Any]:
        return asdict(self.defaults["hnsw"])

    def get_default_ivf_config(self) -> dict[str, Any]:
        return asdict(self.defaults["ivf"])

    def get_default_quantization_config(self) -> dict[str, Any] | None:
        return asdict(self.defaults["quantization"]) if self.defaults["quantization"] else None

    # Writing

    def upsert(self, name: str, point_id: Any, vector: list[float], payload: dict[str, Any] | None = None) -> None:
        self.upsert_batch(name, [{"id": point_id, "vector": vector, "payload": payload}])

    def upsert_batch(self, name: str, points: Iterable[dict[str, Any]]) -> None:
        """All of the points or none; of equal ids the last counts. A point without payload loses the one that it had."""
        self.apply_txn([{**p, "op": "upsert", "collection": name} for p in points] or [{"op": None, "collection": name}])

    def upsert_dataframe(self, name: str, df: DataFrame, point_id: str = "id", vector: str = "vector", payload: str | list[str] | None = None, batch: tuple[str, int] | None = None) -> None:
        """Points from a DataFrame: payload names a column of JSON text, or the columns that make it. A column seq orders equal ids.

        batch: a source and the number of what comes from it. What has come already, by its number, changes nothing again.
        """
        body = F.lit(None).cast("string") if payload is None else F.to_json(F.struct(*payload)) if isinstance(payload, list) else F.col(payload)
        seq = F.col("seq") if "seq" in df.columns else F.monotonically_increasing_id()
        rows = df.select(canonical_id(F.col(point_id)).alias("id"), F.col(vector).alias("vector"), body.alias("payload"), seq.alias("seq"), F.lit(True).alias("live"), F.lit(False).alias("renew"))
        self._write(name, "upsert", rows, batch)

    def _write(self, name: str, what: str, rows: DataFrame, batch: tuple[str, int] | None = None) -> tuple[int, int]:
        """How many points are new, and how many are gone."""
        store = self._store(name)

        def work(manifest: Manifest) -> tuple[int, int]:
            if batch and manifest["batches"].get(batch[0], -1) >= batch[1]:
                return 0, 0
            found = store.prepare(manifest, rows)
            if batch:
                manifest["batches"][batch[0]] = batch[1]
            if store.due(manifest):
                self._fold(store, manifest)
            return found

        with self._timed(name, what):
            return store.change(work)

    def delete(self, name: str, point_id: Any) -> None:
        self.delete_batch(name, [point_id])

    def delete_batch(self, name: str, ids: Iterable[Any]) -> None:
        """Ids that aren't there change nothing."""
        self.apply_txn([{"op": "delete", "collection": name, "id": i} for i in ids] or [{"op": None, "collection": name}])

    def delete_dataframe(self, name: str, ids: DataFrame) -> int:
        """ids: a column id. Returns how many points are gone."""
        return self._write(name, "delete", _gone(ids))[1]

    def delete_by_filter(self, name: str, spec: dict[str, Any]) -> int:
        store = self._store(name)

        def work(manifest: Manifest) -> int:
            gone = store.prepare(manifest, _gone(self._candidates(store, manifest, spec).select("id")))[1]
            if store.due(manifest):
                self._fold(store, manifest)
            return gone

        with self._timed(name, "delete"):
            return store.change(work)

    def _edit(self, name: str, op: str, point_id: Any, values: dict[str, Any] | None = None, keys: Iterable[str] = ()) -> None:
        """A point's payload edited; the point has to be there."""
        store, own = self._store(name), normalise_id(point_id)

        def work(manifest: Manifest) -> None:
            row = store.with_ids(manifest, [own]).first()
            if row is None:
                raise UnknownPoint(f"{name} has no point {own}")
            store.prepare(manifest, self.spark.createDataFrame([(own, list(row.vector), edited(row.payload, op, values, list(keys)), 0, True, False)], POINT_ROW))

        with self._timed(name, op):
            store.change(work)

    def set_payload(self, name: str, point_id: Any, payload: dict[str, Any]) -> None:
        self._edit(name, "set_payload", point_id, payload)

    def merge_payload(self, name: str, point_id: Any, payload: dict[str, Any]) -> None:
        self._edit(name, "merge", point_id, payload)

    def set_payload_field(self, name: str, point_id: Any, field: str, value: Any) -> None:
        self._edit(name, "merge", point_id, {field: value})

    def delete_payload_keys(self, name: str, point_id: Any, keys: Iterable[str]) -> None:
        self._edit(name, "delete_keys", point_id, keys=keys)

    def apply_txn(self, ops: Iterable[dict[str, Any]]) -> None:
        """ops: {"op": "upsert" or "delete", "collection", "id", ...}, in order. All of a collection's are one change, and no
        collection is changed unless the ops of all can be. A point that is taken away and put in again gets a new slot."""
        by_name: dict[str, dict[str, tuple]] = {}
        kinds: dict[str, set] = {}
        dims: dict[str, int] = {}
        for seq, op in enumerate(ops):
            own = by_name.setdefault(op["collection"], {})
            if op["collection"] not in dims:
                dims[op["collection"]] = self._store(op["collection"]).config.dim
            kinds.setdefault(op["collection"], set()).add(op["op"])
            if op["op"] is None:
                continue
            if op["op"] not in ("upsert", "delete"):
                raise Misuse(f"a transaction can't {op['op']}")
            key = normalise_id(op["id"])
            before = own.pop(key, None)
            if op["op"] == "delete":
                own[key] = (key, None, None, seq, False, True)
            else:
                payload = canonical(op["payload"]) if op.get("payload") is not None else None
                first = seq if before is None or not before[4] else before[3]
                own[key] = (key, check_vector(op["vector"], dims[op["collection"]]), payload, first, True, before is not None and before[5])
        made = []
        for name in sorted(by_name):
            store, rows = self._store(name), list(by_name[name].values())
            if not rows:
                continue
            manifest = store.manifest()
            with self._timed(name, kinds[name].pop() if len(kinds[name]) == 1 else "txn"):
                store.prepare(manifest, self.spark.createDataFrame(rows, POINT_ROW))
                if store.due(manifest):
                    self._fold(store, manifest)
            made.append((store, manifest, rows))
        for store, manifest, rows in made:
            if not store.commit(manifest):
                self._write(store.name, "txn_again", self.spark.createDataFrame(rows, POINT_ROW))

    # Reading

    def points(self, name: str) -> DataFrame:
        return self._store(name).points()

    def get(self, name: str, point_id: Any) -> dict[str, Any] | None:
        store = self._store(name)
        row = store.with_ids(store.manifest(), [normalise_id(point_id)]).first()
        return None if row is None else {"id": row.id, "vector": list(row.vector), "payload": json.loads(row.payload) if row.payload is not None else None}

    def slot_of(self, name: str, point_id: Any) -> int | None:
        store = self._store(name)
        row = store.with_ids(store.manifest(), [normalise_id(point_id)]).select("slot").first()
        return row.slot if row else None

    def count(self, name: str) -> int:
        return self._store(name).manifest()["live"]

    def count_by_filter(self, name: str, spec: dict[str, Any]) -> int:
        store = self._store(name)
        return self._candidates(store, store.manifest(), spec).count()

    def points_by_filter(self, name: str, spec: dict[str, Any] | None) -> DataFrame:
        """The live points that a filter takes, by way of payload indexes where there are any."""
        store = self._store(name)
        return self._candidates(store, store.manifest(), spec)

    def _candidates(self, store: Store, manifest: Manifest, spec: dict[str, Any] | None, wide: tuple[str, ...] = ()) -> DataFrame:
        """Live points that the filter takes; those that wait in changes have nulls in the wide columns."""
        settled = filtered(store.settled(manifest), spec, store.shadows(manifest)).select("slot", "id", "vector", "payload", *wide)
        pending = store.pending(manifest)
        return settled if pending is None else settled.unionByName(filtered(pending, spec), allowMissingColumns=True)

    def scroll(self, name: str, limit: int = 10, offset_id: Any = None, with_payload: bool = True, with_vector: bool = False, spec: dict[str, Any] | None = None, order: str = "slot") -> tuple[list[dict[str, Any]], str | None]:
        """A page in the order of slots (or of ids), from behind the point offset_id, and the id to go on from. An unknown
        offset_id gives an empty page; a limit of 0 gives one row."""
        store = self._store(name)
        manifest = store.manifest()
        live = self._candidates(store, manifest, spec)
        if offset_id is not None:
            cursor = store.with_ids(manifest, [normalise_id(offset_id)]).select(order).first()
            if cursor is None:
                return [], None
            live = live.where(F.col(order) > cursor[0])
        page = live.orderBy(order).limit(max(1, limit)).select("id", *["payload"] * with_payload, *["vector"] * with_vector).collect()
        rows = [{"id": r.id} | ({"payload": json.loads(r.payload) if r.payload is not None else None} if with_payload else {}) | ({"vector": list(r.vector)} if with_vector else {}) for r in page]
        return rows, rows[-1]["id"] if rows else None

    def scroll_by_filter(self, name: str, spec: dict[str, Any], limit: int = 10, offset_id: Any = None, with_payload: bool = True, with_vector: bool = False) -> tuple[list[dict[str, Any]], str | None]:
        return self.scroll(name, limit, offset_id, with_payload, with_vector, spec)

    def scroll_stream(self, name: str, spec: dict[str, Any] | None = None) -> Iterator[Any]:
        """All points in the order of slots, a partition at a time."""
        return self.points_by_filter(name, spec).orderBy("slot").toLocalIterator(prefetchPartitions=True)

    scroll_by_filter_stream = scroll_stream

    def search(self, name: str, query: dict[str, Any] | SearchQuery) -> DataFrame:
        """id, score, and payload and vector if asked for. Indexes change how, not what: changed points that no index has yet are
        scored by themselves, and a search that an index can't fill is done again on all points."""
        query = query if isinstance(query, SearchQuery) else SearchQuery.from_dict(query)
        store = self._store(name)
        manifest = store.manifest()
        config = CollectionConfig.from_dict(manifest["config"])
        check_vector(query.vector, config.dim)
        tier = "exact" if query.exact else manifest["index"]["kind"] if manifest["index"] else "quantized" if manifest["quantization"] and not query.ignore_quantization else "exact"
        with self._timed(name, f"search_{tier}"):
            found = {"Ivf": self._search_ivf, "Hnsw": self._search_graph, "quantized": self._search_quantized}[tier](store, manifest, config, query) if tier != "exact" else None
            if found is None:
                if tier != "exact":
                    self._count(name, "exact_retries")
                return self._search_exact(store, manifest, config, query)
            return self._answer(store, manifest, query, found)

    def search_batch(self, name: str, queries: DataFrame, k: int = 10, nprobe: int | None = None, ef_search: int | None = None, oversampling: float | None = None, exact: bool = False) -> DataFrame:
        """queries: qid long, vector. Returns qid, id, slot, score, rank of the k best points for each query, by the
        collection's index or codes, and of the changes that wait."""
        store = self._store(name)
        manifest = store.manifest()
        config = CollectionConfig.from_dict(manifest["config"])
        kind, settled, pending = (manifest["index"] or {}).get("kind"), store.settled(manifest), store.pending(manifest)
        if exact or not kind and not manifest["quantization"]:
            return batch_search(store.points(manifest), queries, k, config.metric)
        if kind == "Ivf":
            found = ivf.batch_probe(settled, queries, np.array(manifest["index"]["centroids"]), nprobe or config.ivf.default_nprobe, k, config.metric)
        elif kind == "Hnsw":
            graphs = self.spark.read.parquet(store.files.at(f"{name}/{manifest['index']['folders'][0]}"))
            found = graph.batch_search(graphs, queries, config.metric, config.hnsw, max(ef_search or config.hnsw.ef_search, k), k if pending is None else None)
            if pending is not None:
                found = found.join(settled.select("slot"), "slot", "left_semi").select("qid", "slot", "id", "score")
        else:
            q = manifest["quantization"]
            width = quant.coarse_width(q["kind"], k, manifest["live"], oversampling)
            found = quant.batch_two_stage(settled, queries, q | {"dim": config.dim}, k, width, config.metric)
        if pending is not None:
            found = found.unionByName(batch_search(pending, queries, k, config.metric).drop("rank"))
        return top_of_each(found, k).select("qid", "id", "slot", "score", "rank")

    def search_vector(self, name: str, vector: list[float], limit: int = 10, spec: dict[str, Any] | None = None, threshold: float = -1.0) -> DataFrame:
        """A negative threshold asks for none."""
        return self.search(name, SearchQuery(vector, limit=limit, filter=spec, score_threshold=threshold if threshold >= 0 else None))

    def search_stream(self, name: str, query: dict[str, Any] | SearchQuery) -> Iterator[Any]:
        return self.search(name, query).toLocalIterator()

    def _scored(self, points: DataFrame, config: CollectionConfig, query: SearchQuery) -> DataFrame:
        return best_scored(points, query.vector, query.wanted + query.offset, config.metric)

    def _search_exact(self, store: Store, manifest: Manifest, config: CollectionConfig, query: SearchQuery) -> DataFrame:
        winners = rank_scored(self._scored(self._candidates(store, manifest, query.filter), config, query), query.wanted, query.offset, query.threshold)
        if not query.wide:
            return winners.select("id", "score")
        return self._answer(store, manifest, query, winners.collect())  # as many rows as asked for

    def _answer(self, store: Store, manifest: Manifest, query: SearchQuery, winners: list) -> DataFrame:
        """The winners in order, with what else the query asks for, which is read for their slots alone."""
        rows = [(i, r.slot, r.id, float(r.score)) for i, r in enumerate(winners) if query.threshold is None or r.score >= query.threshold]
        ranked = self.spark.createDataFrame(rows, "_place int, slot long, id string, score double")
        if query.wide:
            some = store.points(manifest).where(F.col("slot").isin([r[1] for r in rows])).select("slot", *query.wide)
            ranked = projected(some.join(F.broadcast(ranked), "slot"), query)  # as many rows as asked for
        return ranked.coalesce(1).sortWithinPartitions("_place").select("id", "score", *query.wide)

    def _pending_scored(self, store: Store, manifest: Manifest, config: CollectionConfig, query: SearchQuery) -> DataFrame | None:
        pending = store.pending(manifest)
        return None if pending is None else self._scored(filtered(pending, query.filter), config, query)

    def _search_ivf(self, store: Store, manifest: Manifest, config: CollectionConfig, query: SearchQuery) -> list | None:
        """The winners before the threshold, or None if fewer than asked for were found in the lists that may be read."""
        order = ivf.probe_order(query.vector, np.array(manifest["index"]["centroids"]), config.metric)
        nprobe, most = min(query.nprobe or config.ivf.default_nprobe, len(order)), min(config.ivf.max_probes or len(order), len(order))
        settled = filtered(store.settled(manifest), query.filter, store.shadows(manifest))
        pending = self._pending_scored(store, manifest, config, query)
        while True:
            near = self._scored(ivf.probe(settled, order, nprobe), config, query)
            winners = rank_scored(near if pending is None else near.unionByName(pending), query.wanted, query.offset).collect()
            if nprobe == len(order) or len(winners) >= query.wanted:
                return winners
            if nprobe >= most:
                return None
            nprobe = min(2 * nprobe, most)
            self._count(store.name, "probe_retries")

    def _search_graph(self, store: Store, manifest: Manifest, config: CollectionConfig, query: SearchQuery) -> list | None:
        graphs = self.spark.read.parquet(store.files.at(f"{store.name}/{manifest['index']['folders'][0]}"))
        k = query.wanted + query.offset
        width = max(query.ef_search or config.hnsw.ef_search, k)
        most = max(width, config.hnsw.max_scan_tuples or manifest["index"]["built"])
        settled = store.settled(manifest)
        allowed = filtered(settled, query.filter, store.shadows(manifest)) if query.filter or manifest["changes"] else None
        pending = self._pending_scored(store, manifest, config, query)
        for _ in range(config.hnsw.iterative_max_rounds):
            near = graph.search(graphs, query.vector, config.metric, config.hnsw, width, allowed)
            winners = rank_scored(near if pending is None else near.unionByName(pending), query.wanted, query.offset).collect()
            if len(winners) >= query.wanted:
                return winners
            if width >= most:
                break
            width = min(4 * width, most)
        return winners if allowed is None and width >= manifest["index"]["built"] else None

    def _coded(self, manifest: Manifest, config: CollectionConfig, points: DataFrame) -> DataFrame:
        """points with the codes that the manifest's quantization gives them."""
        q = manifest["quantization"]
        if q["kind"] == "scalar":
            return points.withColumn("code", quant.scalar_codes(F.col("vector"), q["low"], q["high"]))
        if q["kind"] == "binary":
            return points.withColumn("code", quant.binary_words(F.col("vector"), config.dim))
        return quant.product_encode(points, np.array(q["books"]))

    def _search_quantized(self, store: Store, manifest: Manifest, config: CollectionConfig, query: SearchQuery) -> list:
        q = manifest["quantization"]
        coded = filtered(store.settled(manifest), query.filter, store.shadows(manifest)).select("slot", "id", "code")
        if (pending := store.pending(manifest)) is not None:
            coded = coded.unionByName(self._coded(manifest, config, filtered(pending, query.filter)).select("slot", "id", "code"))
        k = query.wanted + query.offset
        if q["kind"] == "scalar":
            values = quant.scalar_values(F.col("code"), q["low"], q["high"])
            coarse = coded.select("slot", "id", D.score(config.metric, values, D.vector(query.vector)).alias("score"))
        elif q["kind"] == "binary":
            own = quant.binary_words(D.vector(query.vector), config.dim)
            coarse = coded.select("slot", "id", (-quant.hamming(F.col("code"), own)).cast("double").alias("score"))
        else:
            coarse = quant.product_scores(coded, np.array(q["books"]), query.vector, config.metric)
        if not (query.rescore if query.rescore is not None else q["kind"] == "binary"):
            return rank_scored(coarse, query.wanted, query.offset).collect()
        width = quant.coarse_width(q["kind"], k, manifest["live"], query.oversampling)
        some = [r.slot for r in quant.best_coarse(coarse, width).collect()]  # a few times what is asked for
        exact = self._scored(store.points(manifest).where(F.col("slot").isin(some)), config, query)
        return rank_scored(exact, query.wanted, query.offset).collect()

    # Indexes

    def create_payload_index(self, name: str, field: str, tag: str = "keyword") -> None:
        store = self._store(name)

        def work(manifest: Manifest) -> None:
            manifest["payload_indexes"][field] = store.check_index(manifest, field, tag)
            self._fold(store, manifest)

        store.change(work)

    def delete_payload_index(self, name: str, field: str) -> bool:
        return self._store(name).change(lambda manifest: manifest["payload_indexes"].pop(field, None) is not None)

    def list_payload_indexes(self, name: str) -> dict[str, str]:
        return dict(sorted(self._store(name).manifest()["payload_indexes"].items()))

    def _fold(self, store: Store, manifest: Manifest) -> None:
        """Waiting changes become part of the base. New rows get the codes and the list of what is there; a graph is built again."""
        config = CollectionConfig.from_dict(manifest["config"])
        kind = (manifest["index"] or {}).get("kind")
        listed, coded = kind == "Ivf", bool(manifest["quantization"])
        points = self._candidates(store, manifest, None, ("list_id", "list_distance") * listed + ("code",) * coded)
        if manifest["changes"] and (listed or coded):
            new = store.pending(manifest)
            new = self._coded(manifest, config, new) if coded else new
            new = ivf.assign(new, np.array(manifest["index"]["centroids"]), config.metric) if listed else new
            points = store.settled(manifest).select(*points.columns).unionByName(new)
        store.write_base(manifest, points, listed)
        if kind == "Hnsw":
            self._build_graph(store, manifest, config)

    def _build_graph(self, store: Store, manifest: Manifest, config: CollectionConfig) -> None:
        folder = store.new_folder("graph")
        graph.build(store.base(manifest), config.metric, config.hnsw).write.parquet(store.files.at(f"{store.name}/{folder}"))
        manifest["index"] = {"kind": "Hnsw", "folders": [folder], "built": manifest["live"]}

    def build_index(self, name: str) -> bool:
        """Trains codes if they are configured, then builds what the collection's config names. True if there is an index then."""
        store = self._store(name)
        self.build_quantization(name)

        def work(manifest: Manifest) -> bool:
            config, n = CollectionConfig.from_dict(manifest["config"]), manifest["live"]
            manifest["index"] = None
            if config.index == "Flat" or not n or config.index == "Ivf" and n < config.ivf.min_build_points:
                return False
            if config.index == "Hnsw":
                if manifest["changes"]:
                    self._fold(store, manifest)
                self._build_graph(store, manifest, config)
                return True
            coded = ("code",) * bool(manifest["quantization"])
            if coded and manifest["changes"]:
                self._fold(store, manifest)
            live = self._candidates(store, manifest, None, coded)
            centroids = ivf.train(live, config.ivf, config.metric, n)
            store.write_base(manifest, ivf.assign(live, centroids, config.metric), True)
            baseline = store.base(manifest).agg(F.avg("list_distance")).first()[0]
            manifest["index"] = {"kind": "Ivf", "centroids": centroids.tolist(), "baseline": baseline, "built": n}
            return True

        with self._timed(name, "build"):
            return store.change(work)

    def build_quantization(self, name: str) -> bool:
        store = self._store(name)

        def work(manifest: Manifest) -> bool:
            config = CollectionConfig.from_dict(manifest["config"])
            if config.quantization is None or not manifest["live"]:
                return False
            q, live = config.quantization, store.points(manifest)
            if q.kind == "scalar":
                low, high = quant.scalar_range(live, q.quantile, config.dim)
                known = {"low": low, "high": high}
            elif q.kind == "binary":
                known = {}
            else:
                known = {"books": quant.product_codebooks(live, q.parts(config.dim)).tolist()}
            manifest |= {"index": None, "quantization": {"kind": q.kind, **known}}
            store.write_base(manifest, self._coded(manifest, config, live))
            return True

        return store.change(work)

    def has_index(self, name: str) -> bool:
        return bool(self._store(name).manifest()["index"])

    def has_quantization(self, name: str) -> bool:
        return bool(self._store(name).manifest()["quantization"])

    def index_info(self, name: str) -> dict[str, Any] | None:
        manifest = self._store(name).manifest()
        if not manifest["index"]:
            return None if manifest["config"]["index"] == "Flat" else {"kind": "ExactScan"}
        return {k: v for k, v in manifest["index"].items() if k in ("kind", "built", "baseline")}

    def drop_index(self, name: str) -> None:
        self._store(name).change(lambda manifest: manifest.update(index=None))

    drop_published_index = drop_index

    def index_drift(self, name: str) -> float:
        store = self._store(name)
        manifest = store.manifest()
        if not manifest["index"] or manifest["index"]["kind"] != "Ivf":
            return 0.0
        config = CollectionConfig.from_dict(manifest["config"])
        assigned = ivf.assign(store.points(manifest), np.array(manifest["index"]["centroids"]), config.metric)
        return ivf.drift(assigned, manifest["index"]["baseline"] or 0.0)

    get_index_metadata = index_info

    # Upkeep

    def drain_pending(self, name: str) -> int:
        """Folds waiting changes into the base and its indexes; returns how many points had one."""
        store = self._store(name)

        def work(manifest: Manifest) -> int:
            n = pending_rows(manifest)
            if n:
                self._fold(store, manifest)
            return n

        return store.change(work) if pending_rows(store.manifest()) else 0

    checkpoint = drain_pending

    def compact(self, name: str) -> int:
        """Slots without gaps, in the old order; returns how many points there are."""
        store = self._store(name)

        def work(manifest: Manifest) -> int:
            if manifest["changes"]:
                self._fold(store, manifest)
            kind = (manifest["index"] or {}).get("kind")
            shadows = [c for c in store.base(manifest).columns if c[:2] in ("p_", "m_")]
            store.write_base(manifest, number_in_order(store.base(manifest).drop(*shadows), 0), kind == "Ivf")
            manifest["next_slot"] = manifest["live"]
            if kind == "Hnsw":
                self._build_graph(store, manifest, CollectionConfig.from_dict(manifest["config"]))
            return manifest["live"]

        with self._timed(name, "compact"):
            return store.change(work)

    def needs_checkpoint(self, name: str) -> bool:
        """Whether changes wait that no index has yet."""
        return bool(self._store(name).manifest()["changes"])

    def stale_ratio(self, name: str) -> float:
        """Changes since the index was built, as a share of the points that it was built of."""
        manifest = self._store(name).manifest()
        return pending_rows(manifest) / max(1, manifest["index"]["built"]) if manifest["index"] else 0.0

    def repair_index(self, name: str) -> bool:
        """Takes waiting changes into a stale index; its shards or lists have nothing of what was deleted then."""
        if self.stale_ratio(name) <= 0:
            return False
        self.drain_pending(name)
        return True

    def vacuum(self, name: str) -> list[str]:
        """Deletes tables that neither the newest state nor the one before it has; returns their folders."""
        return self._store(name).vacuum()

    def needs_compaction(self, name: str) -> bool:
        manifest = self._store(name).manifest()
        return manifest["next_slot"] > 0 and 1 - self.count(name) / manifest["next_slot"] > manifest["config"]["compaction_ratio"]

    def run_maintenance_sweep(self) -> dict[str, list[str]]:
        """One round over all collections: fold, compact, build where a rule asks for it, and vacuum. Returns what was done."""
        done: dict[str, list[str]] = {}
        for name in self.collection_names():
            acts = done.setdefault(name, [])
            manifest = self._store(name).manifest()
            config, n = CollectionConfig.from_dict(manifest["config"]), self.count(name)
            if self.needs_compaction(name):
                self.compact(name)
                acts.append("compact")
            elif manifest["changes"]:
                self.drain_pending(name)
                acts.append("drain")
            wanted = config.index == "Hnsw" and n >= config.hnsw.full_scan_threshold or config.index == "Ivf" and config.ivf.auto_promotion and n >= config.ivf.min_build_points
            drifted = self.has_index(name) and config.index == "Ivf" and self.index_drift(name) > config.ivf.drift_threshold
            if drifted or wanted and not self.has_index(name):
                self.build_index(name)
                acts.append("build")
            if self.vacuum(name):
                acts.append("vacuum")
        return done

    def promote_temp_collection(self, temp: str, live: str) -> str | None:
        """temp takes the name live; what was there becomes the one backup, whose name is returned."""
        self._store(temp)
        for old in self.list_old_backups(live):
            self.files.delete(old)
        backup = None
        if self.collection_exists(live):
            backup = f"{live}{OLD}{int(time.time() * 1000)}"
            self.files.rename(live, backup)
        if not self.files.rename(temp, live):
            if backup:
                self.files.rename(backup, live)
            raise Misuse(f"{temp} can't take the name {live}")
        return backup

    def restore_promote_backup(self, live: str) -> None:
        backups = self.list_old_backups(live)
        if not backups:
            raise NotFound(f"{live} has no backup")
        if self.files.exists(live):
            self.files.rename(live, f"{live}{SUSPECT}{int(time.time() * 1000)}")
        self.files.rename(max(backups, key=lambda b: int(b.rpartition("-")[2])), live)

    def list_temp_collections(self, live: str) -> list[str]:
        return [n for n in self.list_collections() if n.startswith(live + REBUILD)]

    def list_old_backups(self, live: str) -> list[str]:
        return [n for n in self.list_collections() if n.startswith(live + OLD)]

    # Snapshots

    def export_collection(self, name: str, path: str) -> None:
        """Points as JSON lines in the order of their ids, and the manifest's settings beside them."""
        store = self._store(name)
        manifest = store.manifest()
        store.points(manifest).select("id", "vector", "payload").orderBy("id").write.mode("overwrite").json(f"{path}/points")
        Files(self.spark, path).write_json("collection.json", {"version": 1, "name": name, "config": manifest["config"], "payload_indexes": manifest["payload_indexes"]})

    def import_collection(self, path: str, name: str | None = None) -> None:
        """Everything is checked before a collection of that name is replaced."""
        told = self._told(path, "collection.json")
        name = name or told["name"]
        points = self.spark.read.schema("id string, vector array<float>, payload string").json(f"{path}/points")
        if not points.groupBy("id").count().where("count > 1").isEmpty():
            raise InvalidPoint("a snapshot can't have two points of one id")
        temp = f"{name}{REBUILD}{int(time.time() * 1000)}"
        self.create_collection(temp, CollectionConfig.from_dict(told["config"]))
        try:
            self.upsert_dataframe(temp, points, payload="payload")
            for field, tag in told["payload_indexes"].items():
                self.create_payload_index(temp, field, tag)
        except Exception:
            self.delete_collection(temp)
            raise
        self.promote_temp_collection(temp, name)

    def _told(self, path: str, name: str) -> dict[str, Any]:
        files = Files(self.spark, path)
        if not files.exists(name):
            raise CorruptData(f"{path} has no {name}")
        try:
            told = files.read_json(name)
        except ValueError as e:
            raise CorruptData(f"{name} of {path} can't be read") from e
        if told.get("version") != 1:
            raise InvalidConfig("this snapshot's version isn't known")
        return told

    def export_snapshot(self, path: str) -> None:
        for name in self.collection_names():
            self.export_collection(name, f"{path}/{name}")
        Files(self.spark, path).write_json("snapshot.json", {"version": 1, "collections": self.collection_names()})

    def import_snapshot(self, path: str) -> None:
        told = self._told(path, "snapshot.json")
        for name in told["collections"]:
            self.import_collection(f"{path}/{name}")

    def revision(self, name: str) -> int:
        return self._store(name).manifest()["revision"]

    # Metrics and health

    def _count(self, name: str, what: str, n: float = 1) -> None:
        self.metrics.setdefault(name, Counter())[what] += n

    @contextmanager
    def _timed(self, name: str, what: str):
        began = time.perf_counter()
        yield
        took = time.perf_counter() - began
        self._count(name, f"{what}_calls")
        self._count(name, f"{what}_seconds", took)
        self.times.setdefault((name, what), Counter())[int(took * 1e6).bit_length()] += 1

    def percentiles(self, name: str, what: str) -> dict[str, float]:
        """Seconds within which shares of the calls were done, rounded up to a power of two of microseconds."""
        seen = self.times.get((name, what), Counter())
        out, below = {}, 0
        for power in sorted(seen):
            below += seen[power]
            out |= {f"{what}_p{round(100 * q)}": 2**power / 1e6 for q in PERCENTILES if below >= math.ceil(q * seen.total()) and f"{what}_p{round(100 * q)}" not in out}
        return out

    def collection_metrics(self, name: str) -> dict[str, float]:
        """Calls, seconds and their percentiles by kind since this engine was opened, retries, and the collection's points and bytes."""
        by_kind = [self.percentiles(name, what) for n, what in self.times if n == name]
        return dict(self.metrics.get(name, Counter())) | {k: v for x in by_kind for k, v in x.items()} | {"points": self.count(name), "bytes": self.files.size(name)}

    def health_check(self) -> dict[str, Any]:
        return {"status": "ok", "version": __version__, "collections": len(self.list_collections())}

    def is_local(self) -> bool:
        return True


def pending_rows(manifest: Manifest) -> int:
    """Rows of waiting changes; a point that changed in several counts in each."""
    return sum(c["rows"] for c in manifest["changes"])


def _gone(ids: DataFrame) -> DataFrame:
    return ids.select(canonical_id(F.col("id")).alias("id"), F.lit(None).cast("array<float>").alias("vector"), F.lit(None).cast("string").alias("payload"), F.lit(0).cast("long").alias("seq"), F.lit(False).alias("live"), F.lit(True).alias("renew"))


__all__ = ["POINTS", "Engine", "compile_filter"]
