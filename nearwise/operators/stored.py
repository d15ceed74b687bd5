"""An index of points that stays: written once, opened by any session, changed by inserts and deletes.

A folder holds numbered versions. The first is a base: points in order of the leaves they lie in, and for each leaf
its number of points and extents. An insert writes its points under the same layout, with leaves of their own; a delete
writes the ids that go, and leaves whose numbers are negative. Reading merges them: leaves of one path add up, and a
point is left out if a later version deletes its id, so whoever opens the index sees exact counts and hence exact
bounds (extents may be wider than the points that are left, which costs comparisons only). The merged leaves are
as many as one base has, whatever the number of versions. When the changes since the base are more than a share of
it, or too many, they are compacted into a new base with a layout of its own.

A version counts once its line is in `versions`, which is written last; a writer that fails before leaves nothing but
unread files. There is one writer at a time; readers keep the versions they have opened until `vacuum`.
Rows without finite coordinates are left out, as in joins. A null id is never deleted."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearwise.functions.geometry import rect
from nearwise.plans.tables import remove, save

from .join import PER_LEAF, RightIndex, as_points, levels_of
from .layout import Layout, layout, nodes

#: Changes since the base, and their share of its points, beyond which they are compacted.
MAX_CHANGES, MAX_SHARE = 8, 0.5
_VERSION = "version long, kind string, rows long, layout string"


@dataclass
class Stored:
    spark: SparkSession
    path: str
    versions: list[dict]

    @classmethod
    def create(cls, points: DataFrame, path: str, *, on=("id", "x", "y"), kind: str = "kdtree", per_leaf: int = PER_LEAF) -> Stored:
        """Writes a new index of the points at `path`."""
        index = cls(points.sparkSession, path.rstrip("/"), [])
        index._base(save(as_points(points, on)), kind, per_leaf)
        return index

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Stored:
        """The index as it is now."""
        path = path.rstrip("/")
        lines = spark.read.schema(_VERSION).json(f"{path}/versions").orderBy("version").collect()  # a line a version
        return cls(spark, path, [r.asDict() for r in lines])

    def _write(self, kind: str, layout_: dict | None = None, rows: int = 0, **tables: DataFrame) -> None:
        version = self.versions[-1]["version"] + 1 if self.versions else 1
        for name, df in tables.items():
            df.write.parquet(f"{self.path}/{name}/{version}")
        line = {"version": version, "kind": kind, "rows": rows, "layout": json.dumps(layout_ or {})}
        self.spark.createDataFrame([line], _VERSION).coalesce(1).write.mode("append").json(f"{self.path}/versions")
        self.versions.append(line)

    def _base(self, points: DataFrame, kind: str, per_leaf: int) -> None:
        n = points.count()
        plane = layout(points, kind, n, per_leaf)
        self._write("base", {"kind": kind, "per_leaf": per_leaf, "plane": asdict(plane)}, n, **self._laid_out(points, plane))

    @staticmethod
    def _laid_out(points: DataFrame, plane: Layout) -> dict[str, DataFrame]:
        placed = points.withColumn("path", plane.path(F.col("x"), F.col("y")))
        return {"points": placed.repartitionByRange("path").sortWithinPartitions("path"), "leaves": nodes(placed, plane.depth)}

    def _since_base(self) -> list[dict]:
        bases = [i for i, v in enumerate(self.versions) if v["kind"] == "base"]
        if not bases:
            raise ValueError(f"there is no index at {self.path}")
        return self.versions[bases[-1] :]

    def _read(self, name: str, *kinds: str) -> DataFrame | None:
        df = None
        for v in self._since_base():
            if v["kind"] in kinds:
                one = self.spark.read.parquet(f"{self.path}/{name}/{v['version']}").withColumn("version", F.lit(v["version"]))
                df = one if df is None else df.unionByName(one)
        return df

    def plane(self) -> Layout:
        return Layout(**json.loads(self._since_base()[0]["layout"])["plane"])

    def points(self) -> DataFrame:
        """id, x, y, path of the points that are there now."""
        points, gone = self._read("points", "base", "insert"), self._read("gone", "delete")
        if gone is not None:
            last = gone.groupBy(F.col("id").alias("gone_id")).agg(F.max("version").alias("gone_at"))
            points = points.join(last, (F.col("id") == F.col("gone_id")) & (F.col("version") < F.col("gone_at")), "left_anti")
        return points.drop("version")

    def index(self) -> RightIndex:
        """For `join.knn_join`, in place of the right side."""
        leaves = self._read("leaves", "base", "insert", "delete")
        box = rect(F.min("box.min_x"), F.min("box.min_y"), F.max("box.max_x"), F.max("box.max_y")).alias("box")
        leaves = save(leaves.groupBy("node").agg(F.sum("n").alias("n"), box).where("n > 0"))
        plane = self.plane()
        return RightIndex(self.points(), plane, *levels_of(leaves, plane.depth))

    def insert(self, points: DataFrame, *, on=("id", "x", "y")) -> None:
        """Adds rows; ids that are there already stay there too."""
        rows = save(as_points(points, on))
        self._write("insert", rows=rows.count(), **self._laid_out(rows, self.plane()))
        self._compact_if_due()

    def delete(self, ids: DataFrame, *, id_col: str = "id") -> None:
        """Takes away all rows with these ids that are there now."""
        ids = save(ids.select(F.col(f"`{id_col}`").alias("id")).where("id IS NOT NULL").distinct())
        gone = save(self.points().join(ids, "id", "left_semi"))
        less = gone.groupBy(F.col("path").alias("node")).agg((-F.count("*")).alias("n")).withColumn("box", F.lit(None).cast(self._read("leaves", "base").schema["box"].dataType))
        self._write("delete", rows=gone.count(), gone=gone.select("id").distinct(), leaves=less)
        self._compact_if_due()

    def _compact_if_due(self) -> None:
        base, *changes = self._since_base()
        if len(changes) > MAX_CHANGES or sum(v["rows"] for v in changes) > MAX_SHARE * max(1, base["rows"]):
            self.compact()

    def compact(self) -> None:
        """Writes what is there now as a new base."""
        made = json.loads(self._since_base()[0]["layout"])
        self._base(save(self.points().drop("path")), made["kind"], made["per_leaf"])

    def vacuum(self) -> None:
        """Deletes the files of versions before the last base."""
        upto = self._since_base()[0]["version"]
        for v in self.versions:
            if v["version"] < upto:
                for name in ("points", "leaves", "gone"):
                    remove(self.spark, f"{self.path}/{name}/{v['version']}")
