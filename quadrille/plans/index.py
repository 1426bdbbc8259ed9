"""A table of boxes with its options: build, open, change, query, inspect, write."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from ..functions import shapes as S
from ..operators import aggregate, join, layout, select
from ..sources import text

#: Fixed names: folders of a saved index.
ROWS, LEAVES = "rows", "leaves"


@dataclass(frozen=True)
class Options:
    """Layout and result options, checked when made."""

    fill: float = 0.7
    leaf_capacity: int = 100
    index_capacity: int = 100
    dimension: int = 2
    near_minimum_overlap: int = 32
    split_factor: float = 0.4
    reinsert_factor: float = 0.3
    tight: bool = True
    result_limit: int = 0
    result_offset: int = 0

    def __post_init__(self) -> None:
        for name in ("fill", "split_factor", "reinsert_factor"):
            if not 0 < getattr(self, name) < 1:
                raise ValueError(f"{name} must lie between 0 and 1")
        for name in ("leaf_capacity", "index_capacity"):
            if getattr(self, name) < 4:
                raise ValueError(f"{name} must be 4 or more")
        if self.dimension < 2:
            raise ValueError("dimension must be 2 or more")
        if not 1 <= self.near_minimum_overlap <= min(self.leaf_capacity, self.index_capacity):
            raise ValueError("near_minimum_overlap must lie between 1 and the capacities")
        if self.result_limit < 0 or self.result_offset < 0:
            raise ValueError("limits can't be negative")

    @property
    def per_leaf(self) -> int:
        return int(self.leaf_capacity * self.fill)


class BoxIndex:
    """Rows (id, xlo, ylo, xhi, yhi, others). Changes give new indexes; nothing is run before it is asked for.

    A saved index has its rows by leaf and, beside them, the description of each leaf, which
    ``is_valid`` holds against the rows when it is opened again.
    """

    def __init__(self, rows: DataFrame, options: Options = Options(), placed: DataFrame | None = None, described: DataFrame | None = None):  # noqa: B008
        self.rows, self.options, self._placed, self._described = rows, options, placed, described

    @classmethod
    def from_text(cls, spark: SparkSession, path: str, options: Options = Options()) -> BoxIndex:  # noqa: B008
        return cls(text.read_mbr(spark, path), options)

    @classmethod
    def open(cls, spark: SparkSession, path: str, options: Options = Options()) -> BoxIndex:  # noqa: B008
        placed = spark.read.parquet(f"{path}/{ROWS}")
        return cls(placed.drop("leaf"), options, placed, spark.read.parquet(f"{path}/{LEAVES}"))

    def save(self, path: str, mode: str = "errorifexists") -> None:
        """Rows of a leaf lie together, so window queries skip row groups by the sides' minima and maxima."""
        placed = layout.str_leaves(self.rows.drop("leaf"), self.options.per_leaf)
        placed.repartitionByRange("leaf").sortWithinPartitions("leaf").write.mode(mode).parquet(f"{path}/{ROWS}")
        written = self.rows.sparkSession.read.parquet(f"{path}/{ROWS}")
        layout.nodes(written).write.mode(mode).parquet(f"{path}/{LEAVES}")

    def persist(self) -> BoxIndex:
        return BoxIndex(self.rows.persist(StorageLevel.MEMORY_AND_DISK), self.options)

    def insert(self, rows: DataFrame) -> BoxIndex:
        return BoxIndex(layout.insert(self.rows, rows), self.options)

    def delete(self, rows: DataFrame) -> BoxIndex:
        return BoxIndex(layout.delete(self.rows, rows), self.options)

    def _paged(self, found: DataFrame, *order: str) -> DataFrame:
        return select.page(found, self.options.result_offset, self.options.result_limit, *order)

    def intersecting(self, shape: S.Shape) -> DataFrame:
        return self._paged(select.intersecting(self.rows, shape))

    def contained(self, shape: S.Shape) -> DataFrame:
        return self._paged(select.contained(self.rows, shape))

    def nearest(self, shape: S.Shape, k: int) -> DataFrame:
        return self._paged(select.nearest(self.rows, shape, k), "distance", "id")

    def join(self, other: BoxIndex) -> DataFrame:
        return self._paged(join.plan_join(self.rows, other.rows), "id", "id_r")

    def self_join(self, window: S.Region | None = None) -> DataFrame:
        return self._paged(join.self_join(self.rows, window), "id", "id_r")

    def bounds(self) -> DataFrame:
        return aggregate.bounds(self.rows)

    def _laid(self) -> DataFrame:
        return self._placed if self._placed is not None else layout.str_leaves(self.rows, self.options.per_leaf)

    def leaves(self) -> DataFrame:
        return self._described if self._described is not None else layout.nodes(self._laid())

    def statistics(self) -> DataFrame:
        return layout.statistics(self._laid(), self.options.per_leaf)

    def is_valid(self) -> bool:
        """Whether the leaves' description, the stored one if there is one, is that of the rows."""
        return layout.faults(self._laid(), self.leaves(), self.options.leaf_capacity).isEmpty()

    def properties(self) -> dict:
        return asdict(self.options)
