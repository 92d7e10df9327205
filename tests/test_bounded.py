"""What a task holds at once stays bounded, however large the tables are."""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adwatch.operators import postings as P
from adwatch.operators import retrieve as R


class Caught:
    """Stands in for a table of queries and hands back the function that would run in its tasks."""

    columns = ["q", "_q"]
    schema = T.StructType([T.StructField("q", T.LongType()), T.StructField("_q", T.ArrayType(T.DoubleType()))])

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):
        return run


def test_queries_go_to_many_clusters_in_parts(monkeypatch):
    monkeypatch.setattr(R, "CELLS", 100)
    rng = np.random.default_rng(3)
    centers, rows = rng.normal(size=(8, 4)), rng.normal(size=(50, 4))
    centers /= np.linalg.norm(centers, axis=1)[:, None]
    run = R.route_queries(Caught(), "q", 4, -1.0, centers, {c: (math.pi, 5) for c in range(8)})
    parts = list(run(iter([pa.record_batch([pa.array(range(50)), pa.array(rows.tolist())], names=["q", "_q"])])))
    assert max(p.num_rows for p in parts) * 4 <= 100
    met = [(c, q) for p in parts for c, q in zip(p.column(0).to_pylist(), p.column(1).to_pylist())]
    assert sorted(met) == [(c, q) for c in range(8) for q in range(50)]


def test_index_is_dealt_to_more_tasks_as_it_grows(spark, folder, monkeypatch):
    monkeypatch.setattr(P, "TASK_ROWS", 20)
    monkeypatch.setattr(P, "TASK_BYTES", 100)
    ads = [(i, f"lot wort{i % 7} ferme") for i in range(150)] + [(None, "lot")]
    P.write_segment(spark.createDataFrame(ads, "id long, title string"), folder, 0, "id", "title")
    P.write_segment(spark.createDataFrame([(3, "vin"), (None, "ferme")], "id long, title string"), folder, 1, "id", "title")
    P.merge_segments(spark, folder, 1)
    terms = spark.createDataFrame([(1, "lot"), (2, "fer"), (3, "wort1")], "term_id long, term string")
    index = P.Index(spark, folder)
    assert index.words.select(F.input_file_name()).distinct().count() > 4
    hits = P.joined_hits(index, P.term_tokens(terms).select("term_id", "term", F.explode("_tokens").alias("prefix")))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert hits.rdd.getNumPartitions() > n
    want = {(i, t) for i in range(150) if i != 3 for t in (1, 2)} | {(i, 3) for i in range(150) if i % 7 == 1} | {(None, 2)}
    got = [(r.key, r.term_id) for r in hits.collect()]
    assert set(got) == want and len(got) == len(set(got))
