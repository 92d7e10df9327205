"""The objects inside JSON documents of any size, read by as many tasks as a file has splits.

Spark's text source cuts a file at ``}``, which it can do from any byte. What a piece means depends on all text before
it: whether it begins inside a string, and how deep. Both are sums over pieces, so a first pass tells per split what it
adds under either assumption, a running sum over splits (one row each) gives the true state at its start, and a second
pass cuts out the objects. Only objects that lie across a split's edge meet in a small shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from adwatch.operators.skew import SMALL_ROWS
from adwatch.session import settled

ESCAPE = re.compile(r"\\.", re.S)
TOKEN = re.compile(r'\\.|["{\[\]]', re.S)
KEY_BEFORE = r'"((?:[^"\\]|\\.)*)"\s*:\s*$'


def _effect(piece: str, inside: bool) -> tuple[bool, int]:
    """Whether the text after a piece and its ``}`` is inside a string, and by how much depth grew."""
    parts = (ESCAPE.sub("", piece) if "\\" in piece else piece).split('"')
    plain = "".join(parts[inside::2])
    inside ^= len(parts) % 2 == 0
    return inside, plain.count("{") + plain.count("[") - plain.count("]") - (not inside)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(column.to_pylist() for column in batch.columns))


def _splits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per split: whether it turns inside to outside, and how depth grows when it begins outside or inside a string."""
    def told(at, states):
        return pa.record_batch([pa.array([v]) for v in (*at, states[0][0], states[0][1], states[1][1])], names=["file", "block", "turns", "outside", "inside"])

    at, states = None, None
    for file, block, piece in _rows(batches):
        if (file, block) != at:
            if at:
                yield told(at, states)
            at, states = (file, block), [(False, 0), (True, 0)]
        for i, (inside, depth) in enumerate(states):
            inside, more = _effect(piece, inside)
            states[i] = (inside, depth + more)
    if at:
        yield told(at, states)


class _Cutter:
    """Cuts the objects at ``level`` out of the pieces of one split."""

    def __init__(self, file: str, block: int, depth: int, inside: bool, level: int) -> None:
        self.at, self.depth, self.inside, self.level = (file, block), depth, inside, level
        self.before, self.body, self.whole = [], [], block == 0  # the first object of a later split may begin earlier

    def row(self, kind: int, closed: bool) -> tuple:
        found = (*self.at, kind, closed, "".join(self.before), "".join(self.body))
        self.before, self.body = [], []
        return found

    def _opening(self, piece: str) -> int | None:
        """Where the next object at the level begins in a piece."""
        inside, depth = self.inside, self.depth
        for token in TOKEN.finditer(piece):
            sign = token.group()
            if sign == '"':
                inside = not inside
            elif not inside and sign == "]":
                depth -= 1
            elif not inside and sign in "{[":
                if depth == self.level:
                    if sign == "[":
                        raise ValueError(f"an element of {self.at[0]} is an array, not an object")
                    return token.start()
                depth += 1
        return None

    def take(self, piece: str) -> tuple | None:
        """Add a piece; the row of the object that it ends, if it ends one."""
        start = 0 if self.depth > self.level else self._opening(piece)
        if start is None:
            self.before.append(piece + "}")
        else:
            if start:
                self.before.append(piece[:start])
            self.body.append(piece[start:] + "}")
        self.inside, more = _effect(piece, self.inside)
        self.depth += more
        if start is None or self.inside or self.depth != self.level:
            return None
        kind, self.whole = (2 if self.whole else 0), True
        return self.row(kind, True)


def _objects(level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["file", "block", "kind", "closed", "before", "body"]
        cutter, out, size = None, [], 0

        def table():
            types = (pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.string(), pa.string())
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

        for file, block, piece, depth, inside in _rows(batches):
            if cutter is None or cutter.at != (file, block):
                if cutter:
                    out.append(cutter.row(1 if cutter.whole else 0, False))
                cutter = _Cutter(file, block, depth, inside, level)
            found = cutter.take(piece)
            if found:
                out.append(found)
                size += len(found[-1])
                if size > 1 << 22:
                    yield table()
                    out, size = [], 0
        if cutter:
            out.append(cutter.row(1 if cutter.whole else 0, False))
            yield table()

    return run


def json_objects(spark: SparkSession, path: str, level: int = 1, small_rows: int = SMALL_ROWS) -> DataFrame:
    """Every object at ``level`` of the JSON documents under ``path``: ``(file, key, value)``. A file may hold several.

    Level 1 are the elements of one array, or the values of one object with their ``key`` (null in an array). ``value`` is the
    object's text. Elements that are plain values are left out, arrays raise; an empty file holds none. An object is one
    row, so it must fit into memory; a document need not.
    """
    text = spark.read.option("lineSep", "}").text(path)
    pieces = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    splits = pieces.mapInArrow(_splits, "file string, block long, turns boolean, outside long, inside long")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row per split
    states = splits.withColumn("_in", F.coalesce(F.sum(F.col("turns").cast("int")).over(before), F.lit(0)) % 2 == 1)
    depth = F.coalesce(F.sum(F.when(F.col("_in"), F.col("inside")).otherwise(F.col("outside"))).over(before), F.lit(0))
    states = settled(states.select("file", "block", depth.alias("depth"), F.col("_in").alias("in_string")))
    columns = ["file", "block", "value", "depth", "in_string"]
    if states.limit(small_rows + 1).count() <= small_rows:
        known = pieces.join(F.broadcast(states), ["file", "block"]).select(*columns)
    else:  # a split is one group, read in order again
        numbered = pieces.withColumn("line", F.monotonically_increasing_id())
        dealt = numbered.join(states, ["file", "block"]).repartition("file", "block").sortWithinPartitions("file", "block", "line")
        known = dealt.select(*columns)
    cut = settled(known.mapInArrow(_objects(level), "file string, block long, kind int, closed boolean, before string, body string"))
    whole = cut.where("kind = 2").select("file", "before", "body")
    # at most two rows per split: the rest at its end, and what ends (or carries on) the object that began before it
    order = Window.partitionBy("file").orderBy("block", "kind")
    parts = cut.where("kind < 2").withColumn("_n", F.sum(F.col("closed").cast("int")).over(order) - F.col("closed").cast("int"))
    met = parts.groupBy("file", "_n").agg(F.max("closed").alias("closed"), F.array_sort(F.collect_list(F.struct("block", "kind", "before", "body"))).alias("_p"))
    joined = met.where("closed").select("file", F.array_join("_p.before", "").alias("before"), F.array_join("_p.body", "").alias("body"))
    key = F.regexp_extract("before", KEY_BEFORE, 1)
    key = F.when(F.col("before").rlike(KEY_BEFORE), F.get_json_object(F.concat(F.lit('{"k":"'), key, F.lit('"}')), "$.k"))
    return whole.unionByName(joined).select("file", key.alias("key"), F.col("body").alias("value"))
