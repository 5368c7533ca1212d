"""A feature store kept as tables in a shared folder.

* entities: a name and its join keys;
* feature views: a named, versioned DataFrame over one or more entities,
  materialised as parquet under ``<root>/views/<name>/<version>/<snapshot>``;
* datasets: a spine left-joined to views, materialised under
  ``<root>/datasets/<name>/<snapshot>`` in parts (train, validation, test), so
  that a read of one part opens only its files.

Every write goes to a new snapshot folder and the registry then points at
it, so a reader holding an older snapshot is never cut off by a refresh;
:meth:`FeatureStore.vacuum` removes the snapshots that nothing points at.

The registry is an append-only log (``<root>/registry``): every register,
refresh and delete appends one small row with the object's next sequence
number, and the current state is the row with the highest number per object.
Nothing is ever overwritten while being read, and concurrent writers only add
files (of two that take the same number the later clock wins).

A view with a :class:`MergeableView` definition refreshes from new rows only:
its state (sums, minima, maxima per key) is kept beside it and merged with the
state of the new rows.  A refresh names the position in the source that it
covers (``upto``), so one that is repeated adds nothing.  Other views are
recomputed and overwritten.  Scheduling a refresh ("every day") belongs to the
caller.  Point-in-time joins are not part of the source and not offered.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException

from menurec.session import open_files

REGISTRY_SCHEMA = ("kind string, name string, version string, spec string, "
                   "deleted boolean, seq long, at double")
PART = "part"    # partition column of datasets
OPEN_PARTS = 4   # files that a task writing a dataset keeps open


@dataclass(frozen=True)
class MergeableView:
    """A view kept up to date from new rows: ``partial`` makes the state of some
    rows (``keys`` and the columns of ``merge``), ``merge`` says how states of
    the same keys combine (sum, min or max), ``finish`` makes the view."""
    keys: tuple[str, ...]
    partial: Callable[[DataFrame], DataFrame]
    merge: Mapping[str, str]
    finish: Callable[[DataFrame], DataFrame]

    def merged(self, states: DataFrame) -> DataFrame:
        how = {"sum": F.sum, "min": F.min, "max": F.max}
        return states.groupBy(*self.keys).agg(*[how[h](c).alias(c) for c, h in self.merge.items()])


@dataclass(frozen=True)
class Entity:
    name: str
    join_keys: tuple[str, ...]

    def __init__(self, name: str, join_keys: Sequence[str]):
        object.__setattr__(self, "name", name)
        object.__setattr__(self, "join_keys", tuple(join_keys))


@dataclass
class FeatureView:
    """A registered view: its entities' keys and a lazy scan of its table."""
    name: str
    version: str
    entities: list[str]
    join_keys: list[str]
    path: str
    refresh_freq: str | None = None
    df: DataFrame | None = field(default=None, repr=False)


class FeatureStore:
    def __init__(self, spark: SparkSession, root: str,
                 definitions: Mapping[str, MergeableView] | None = None):
        self.spark = spark
        self.root = root.rstrip("/")
        self.definitions = dict(definitions or {})

    # -- registry log ------------------------------------------------------
    def _log(self, kind: str, name: str, version: str, spec: dict, deleted: bool = False):
        last = self._registry().filter(
            (F.col("kind") == kind) & (F.lower("name") == name.lower())
            & (F.col("version") == version)).agg(F.max("seq")).first()[0] or 0
        row = [(kind, name, version, json.dumps(spec), deleted, last + 1, time.time())]
        self.spark.createDataFrame(row, REGISTRY_SCHEMA).coalesce(1).write.mode(
            "append").parquet(f"{self.root}/registry")

    def _registry(self) -> DataFrame:
        try:
            return self.spark.read.schema(REGISTRY_SCHEMA).parquet(f"{self.root}/registry")
        except AnalysisException as exc:
            if "PATH_NOT_FOUND" not in str(exc):
                raise  # a failing read is not an empty registry
            return self.spark.createDataFrame([], REGISTRY_SCHEMA)

    def _current(self, kind: str) -> DataFrame:
        """Latest non-deleted registry row per (name, version) of ``kind``."""
        w = Window.partitionBy(F.lower("name"), "version").orderBy(
            F.col("seq").desc(), F.col("at").desc(), F.col("deleted").desc(), F.col("spec"))
        latest = self._registry().filter(F.col("kind") == kind).withColumn(
            "_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
        return latest.filter(~F.col("deleted"))

    def _lookup(self, kind: str, name: str, version: str = "") -> dict | None:
        rows = self._current(kind).filter(
            (F.lower("name") == name.lower()) & (F.col("version") == version)).collect()
        return json.loads(rows[0]["spec"]) if rows else None

    # -- entities ----------------------------------------------------------
    def register_entity(self, entity: Entity) -> Entity:
        """Register ``entity``; registering an existing name again is a no-op."""
        if self._lookup("entity", entity.name) is None:
            self._log("entity", entity.name, "", {"join_keys": list(entity.join_keys)})
        return entity

    def get_entity(self, name: str) -> Entity:
        spec = self._lookup("entity", name)
        if spec is None:
            raise KeyError(f"entity {name!r} is not registered")
        return Entity(name, spec["join_keys"])

    def list_entities(self) -> DataFrame:
        return self._current("entity").select(
            "name", F.from_json("spec", "join_keys array<string>")["join_keys"].alias("join_keys"))

    def delete_entity(self, name: str) -> None:
        views = self._current("view").filter(
            F.exists(F.from_json("spec", "entities array<string>")["entities"], lambda e: F.lower(e) == name.lower()))
        if views.limit(1).count():
            raise ValueError(f"entity {name!r} is still used by a feature view")
        self._log("entity", name, "", {}, deleted=True)

    # -- views -------------------------------------------------------------
    def _view_path(self, name: str, version: str) -> str:
        return f"{self.root}/views/{name.lower()}/{version}/{uuid.uuid4().hex}"

    def register_view(self, name: str, entities: Sequence[Entity], df: DataFrame,
                      version: str, refresh_freq: str | None = None,
                      overwrite: bool = False) -> FeatureView:
        """Materialise ``df`` as version ``version`` of view ``name``.

        An existing version is rejected unless ``overwrite`` is set.  Every
        entity must be registered and its keys must be columns of ``df``.
        """
        if self._lookup("view", name, version) is not None and not overwrite:
            raise ValueError(f"feature view {name}/{version} exists; pass overwrite=True")
        keys: list[str] = []
        lowered = {c.lower() for c in df.columns}
        for e in entities:
            self.get_entity(e.name)
            for k in e.join_keys:
                if k.lower() not in lowered:
                    raise ValueError(f"join key {k!r} of {e.name!r} not in the view")
                if k.lower() not in {x.lower() for x in keys}:
                    keys.append(k)
        spec = {"entities": [e.name for e in entities], "join_keys": keys,
                "refresh_freq": refresh_freq}
        return self._publish(name, version, spec, df)

    def _publish(self, name: str, version: str, spec: dict, df: DataFrame) -> FeatureView:
        path = self._view_path(name, version)
        df.write.parquet(path)
        self._log("view", name, version, {**spec, "path": path})
        return self.get_view(name, version)

    def register_mergeable(self, name: str, entities: Sequence[Entity], definition: str,
                           rows: DataFrame, version: str, upto: int,
                           refresh_freq: str | None = None) -> FeatureView:
        """Materialise the view that ``definition`` (a name of ``definitions``)
        makes of ``rows``, the source up to position ``upto``; later refreshes
        take only the rows behind it."""
        made = self.definitions[definition]
        state = self._write_state(name, version, made.partial(rows))
        view = self.register_view(name, entities, made.finish(state[0]), version, refresh_freq)
        spec = self._lookup("view", name, version)
        self._log("view", name, version, {**spec, "definition": definition, "upto": upto, "state": state[1]})
        return view

    def _write_state(self, name: str, version: str, state: DataFrame) -> tuple[DataFrame, str]:
        path = self._view_path(name, version)
        state.write.parquet(path)
        return self.spark.read.parquet(path), path

    def refresh(self, name: str, version: str, df: DataFrame, upto: int | None = None) -> FeatureView:
        """Bring a registered version up to date.

        A mergeable view takes only the new rows of its source (``df``, up to
        position ``upto``) and merges their state into the stored one; if the
        stored state already covers ``upto``, nothing changes.  Any other view
        is overwritten with ``df``, the recomputed features."""
        spec = self._lookup("view", name, version)
        if spec is None:
            raise KeyError(f"feature view {name}/{version} is not registered")
        if "definition" not in spec:
            entities = [self.get_entity(n) for n in spec["entities"]]
            return self.register_view(name, entities, df, version, spec.get("refresh_freq"),
                                      overwrite=True)
        if upto is None:
            raise ValueError("refreshing a mergeable view needs the position its rows reach (upto)")
        if upto <= spec["upto"]:
            return self.get_view(name, version)
        made = self.definitions[spec["definition"]]
        old = self.spark.read.parquet(spec["state"])
        new = made.partial(df).select(*old.columns)
        state, path = self._write_state(name, version, made.merged(old.unionByName(new)).select(
            *[F.col(f.name).cast(f.dataType) for f in old.schema.fields]))
        return self._publish(name, version, {**spec, "upto": upto, "state": path}, made.finish(state))

    def get_view(self, name: str, version: str) -> FeatureView:
        spec = self._lookup("view", name, version)
        if spec is None:
            raise KeyError(f"feature view {name}/{version} is not registered")
        return FeatureView(name, version, spec["entities"], spec["join_keys"], spec["path"],
                           spec.get("refresh_freq"), self.spark.read.parquet(spec["path"]))

    def list_views(self, entity: str | None = None) -> DataFrame:
        spec = F.from_json("spec", "entities array<string>, join_keys array<string>, "
                                   "path string, refresh_freq string")
        views = self._current("view").select("name", "version", spec.alias("s")).select(
            "name", "version", "s.entities", "s.join_keys", "s.refresh_freq")
        if entity is not None:
            views = views.filter(F.exists("entities", lambda e: F.lower(e) == entity.lower()))
        return views

    def delete_view(self, name: str, version: str) -> None:
        self._log("view", name, version, {}, deleted=True)

    # -- datasets ----------------------------------------------------------
    def retrieve(self, spine: DataFrame, views: Sequence[FeatureView]) -> DataFrame:
        """``spine`` left-joined to each view on its join keys (lazy)."""
        return retrieve(spine, [(v.df, v.join_keys) for v in views])

    def dataset(self, name: str, spine: DataFrame, views: Sequence[FeatureView],
                drop: Sequence[str] = (), part: Column | None = None) -> DataFrame:
        """Materialise :meth:`retrieve` without the ``drop`` columns under
        ``<root>/datasets/<name>``, in folders by ``part`` (a whole number per
        row) if given, and return a scan of it."""
        path = f"{self.root}/datasets/{name}/{uuid.uuid4().hex}"
        write_parts(self.retrieve(spine, views).drop(*drop), path, part)
        self._log("dataset", name, "", {"path": path, "parts": part is not None})
        return self.get_dataset(name)

    def get_dataset(self, name: str, part: int | None = None) -> DataFrame:
        """A scan of the dataset, or of the folder of one part."""
        spec = self._lookup("dataset", name)
        if spec is None:
            raise KeyError(f"dataset {name!r} is not registered")
        rows = self.spark.read.parquet(spec["path"])
        if part is not None:
            rows = rows.filter(F.col(PART) == part)
        return rows.drop(PART) if spec["parts"] else rows

    def list_datasets(self) -> DataFrame:
        return self._current("dataset").select("name")

    def delete_dataset(self, name: str) -> None:
        self._log("dataset", name, "", {}, deleted=True)

    # -- files -------------------------------------------------------------
    def snapshots(self) -> list[str]:
        """Every snapshot folder on disk (a registered view's state is one too)."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        fs = self._fs()
        return [found.getPath().toUri().getPath()
                for pattern in ("views/*/*/*", "datasets/*/*")
                for found in fs.globStatus(path(f"{self.root}/{pattern}")) or []]

    def _fs(self):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def vacuum(self) -> int:
        """Remove every snapshot that no current view or dataset points at;
        returns how many.  Call it when no reader holds an older snapshot and
        no writer is at work."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        fields = F.from_json("spec", "path string, state string")
        used = {path(p).toUri().getPath() for kind in ("view", "dataset")   # a row per object
                for r in self._current(kind).select(fields.alias("s")).select("s.*").collect()
                for p in r if p}
        gone = [p for p in self.snapshots() if p not in used]
        for p in gone:
            self._fs().delete(path(p), True)
        return len(gone)


def write_parts(df: DataFrame, path: str, part: Column | None = None) -> None:
    """Write ``df`` at ``path``, in a folder per value of ``part`` if given."""
    if part is None:
        df.write.parquet(path)
    else:
        with open_files(df.sparkSession, OPEN_PARTS):   # a few parts need no sort of the rows
            df.withColumn(PART, part.cast("int")).write.partitionBy(PART).parquet(path)


def retrieve(spine: DataFrame, views: Sequence[tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """``spine`` left-joined to each ``(view, join_keys)`` in turn.

    A view's rows should be unique on its keys; then the spine keeps its row
    count.  Columns the spine already has are not taken again.  Each join
    is planned by Spark on its own size: a small view is broadcast, a large
    one shuffled on its keys.
    """
    out = spine
    for df, keys in views:
        keys = list(keys)
        lk = {k.lower() for k in keys}
        have = {c.lower() for c in out.columns}
        wanted = [c for c in df.columns if c.lower() not in have or c.lower() in lk]
        out = out.join(df.select(*wanted), on=keys, how="left")
    return out
