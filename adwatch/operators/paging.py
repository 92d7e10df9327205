"""Pages of an ordered table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Largest page a request may ask for.
MOST = 500


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """``limit`` rows after ``offset`` of an ordered table; a page has 1 to ``MOST`` rows, other requests are refused."""
    if not 1 <= limit <= MOST or offset < 0:
        raise ValueError(f"a page has 1 to {MOST} rows from offset 0 on, not {limit} from {offset}")
    return df.orderBy(*order).offset(offset).limit(limit)


def page_after(df: DataFrame, column: str, last: object, key: str, last_key: object, limit: int) -> DataFrame:
    """The page after a known row, by its descending sort value and ascending key.

    Unlike an offset, a deep page costs no more than the first one.
    """
    value = F.col(column)
    below = (value < F.lit(last)) | ((value == F.lit(last)) & (F.col(key) > F.lit(last_key)))
    return df.where(below).orderBy(value.desc(), F.col(key).asc()).limit(limit)


def numbered_page(df: DataFrame, order: list[Column], number: int, size: int) -> tuple[DataFrame, dict[str, object]]:
    """Page ``number`` (from 1, clamped to the last page) and its flags."""
    total = df.count()
    pages = max(1, -(-total // size))
    at = min(max(1, number), pages)
    rows = df.orderBy(*order).offset((at - 1) * size).limit(size)
    return rows, {"page": at, "pages": pages, "total": total, "has_previous": at > 1, "has_next": at < pages}


def page_count(df: DataFrame, size: int) -> DataFrame:
    """Row total and number of pages as one row."""
    pages = F.greatest(F.lit(1), F.ceil(F.col("total") / size))
    return df.agg(F.count(F.lit(1)).alias("total")).select("total", pages.cast("long").alias("pages"))


#: Rows of a range of the page map.
RANGE_ROWS = 100_000


@dataclass
class PageMap:
    """How many rows lie in each range of a sort key, with the first and last key of the range: an order-statistics table.

    ``order`` is a list of (column, ascending) that ends with a unique column. One pass over the sort columns deals them by
    range and counts; no other column moves. A page then reads the rows between the keys of the one range it lies in (or
    the two it spans): the bounds are plain comparisons, so they reach the scan, and a deep page costs what the first does.
    The map holds one row per ``RANGE_ROWS`` rows; it stays right while rows are only read.
    """

    order: list[tuple[str, bool]]
    ranges: list[tuple[int, Row, Row]]

    @staticmethod
    def of(df: DataFrame, order: list[tuple[str, bool]], rows: int = RANGE_ROWS) -> PageMap:
        names = [name for name, _ in order]
        sort = _sorting(order)
        parts = max(1, -(-df.count() // rows))
        dealt = df.select(*names).repartitionByRange(parts, *sort).sortWithinPartitions(*sort)
        key = F.struct(*names)
        counted = dealt.groupBy(F.spark_partition_id().alias("_range")).agg(
            F.count(F.lit(1)).alias("n"), F.first(key).alias("first"), F.last(key).alias("last"))
        found = sorted(counted.collect(), key=lambda r: r["_range"])  # a row per range
        return PageMap(order, [(r["n"], r["first"], r["last"]) for r in found])

    @property
    def total(self) -> int:
        return sum(n for n, _, _ in self.ranges)

    def store(self, spark: SparkSession, path: str) -> None:
        """Write the map, a row per range, with its order."""
        rows = [(i, n, first, last) for i, (n, first, last) in enumerate(self.ranges)]
        order = T.StructType.fromDDL("place int, name string, ascending boolean")
        spark.createDataFrame([(i, *o) for i, o in enumerate(self.order)], order).coalesce(1).write.mode("overwrite").parquet(f"{path}/order")
        if rows:
            spark.createDataFrame(rows, ["place", "n", "first", "last"]).coalesce(1).write.mode("overwrite").parquet(f"{path}/ranges")

    @staticmethod
    def load(spark: SparkSession, path: str) -> PageMap:
        order = [(r["name"], r["ascending"]) for r in spark.read.parquet(f"{path}/order").orderBy("place").collect()]
        return PageMap(order, [(r["n"], r["first"], r["last"]) for r in spark.read.parquet(f"{path}/ranges").orderBy("place").collect()])

    def page(self, df: DataFrame, limit: int, offset: int = 0) -> DataFrame:
        """``limit`` rows after ``offset``, from the ranges they lie in."""
        if not 1 <= limit <= MOST or offset < 0:
            raise ValueError(f"a page has 1 to {MOST} rows from offset 0 on, not {limit} from {offset}")
        before, wanted = 0, []
        for n, first, last in self.ranges:
            if before < offset + limit and before + n > offset:
                wanted.append((before, first, last))
            before += n
        if not wanted:
            return df.limit(0)
        inside = _from(self.order, wanted[0][1], True) & _from(self.order, wanted[-1][2], False)
        return df.where(inside).orderBy(*_sorting(self.order)).offset(offset - wanted[0][0]).limit(limit)

    def numbered(self, df: DataFrame, number: int, size: int) -> tuple[DataFrame, dict[str, object]]:
        """Page ``number`` (from 1, clamped to the last page) and its flags, without counting again."""
        pages = max(1, -(-self.total // size))
        at = min(max(1, number), pages)
        flags = {"page": at, "pages": pages, "total": self.total, "has_previous": at > 1, "has_next": at < pages}
        return self.page(df, size, (at - 1) * size), flags


def _sorting(order: list[tuple[str, bool]]) -> list[Column]:
    """Nulls come first upwards and last downwards."""
    return [F.col(name).asc() if ascending else F.col(name).desc() for name, ascending in order]


def _from(order: list[tuple[str, bool]], key: Row, after: bool) -> Column:
    """Rows at or after a key in the order, or at or before it."""
    found = F.lit(True)
    for name, ascending in reversed(order):
        value, column = key[name], F.col(name)
        up = ascending == after
        if value is None:
            beyond = column.isNotNull() if up else F.lit(False)
            found = beyond | (column.isNull() & found)
        else:
            beyond = column > F.lit(value) if up else (column < F.lit(value)) | column.isNull()
            found = (beyond | ((column == F.lit(value)) & found))
            found = (column >= F.lit(value)) & found if up else found
    return found
