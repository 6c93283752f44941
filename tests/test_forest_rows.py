"""A forest depends on the different rows only, and all tasks share its rows."""
import numpy as np
from pyspark.sql import functions as F

from tests.test_trees import data
from tidemark.operators import trees as T


def test_equal_rows_are_one(spark):
    x, y, w, frame = data(spark)
    often = frame.crossJoin(spark.range(4).select(F.col("id").alias("copy"))).withColumn("w", F.col("w") / 4)
    made, again = (T.extra_trees(f, "x", "y", "w", trees=4, depth=3, seed=9) for f in (frame, often))
    assert (made.feature == again.feature).all() and (made.threshold == again.threshold).all() and (made.share == again.share).all()


def test_rows_of_one_file_go_to_all_tasks(spark, monkeypatch):
    _, _, _, frame = data(spark)
    tables = []
    monkeypatch.setattr(T, "written", lambda df, label, keep=T.written: tables.append(keep(df, label)) or tables[-1])
    T.extra_trees(frame.coalesce(1), "x", "y", "w", trees=2, depth=1)
    assert len(tables) == 1 and tables[0].rdd.getNumPartitions() >= 8
    assert tables[0].agg(F.sum("w")).first()[0] == np.round(np.array([r["w"] for r in frame.collect()]) * T.FIXED).sum()
