"""Matrices by byte ranges: parts, headers, repeated tasks and records."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimloom.sources import matrices


def test_a_file_is_read_by_ranges(spark, tmp_path):
    m = np.random.default_rng(1).normal(size=(1000, 7)).astype(np.float64)
    np.save(tmp_path / "m.npy", m)
    frame = matrices.scan_matrix(spark, str(tmp_path / "m.npy"), 64)
    assert frame.rdd.getNumPartitions() == 16
    got = {r["index"]: r.embedding for r in frame.collect()}
    assert sorted(got) == list(range(1000)) and all(np.allclose(got[k], m[k].astype(np.float32)) for k in got)
    assert matrices.scan_matrix(spark, f"file://{tmp_path}/m.npy").where("index = 999").first().embedding == m[999].astype(np.float32).tolist()


def test_parts_are_written_by_tasks_and_read_in_order(spark, tmp_path):
    rows = spark.range(500).select(F.col("id").alias("index"), F.array(F.col("id").cast("float"), F.lit(0.5).cast("float")).alias("embedding")).repartition(7)
    for _ in range(2):  # a second run replaces each part
        matrices.write_matrix(rows, str(tmp_path / "m"), 3)
    assert sorted(p.name for p in (tmp_path / "m").iterdir()) == [f"part-00000{k}.npy" for k in range(3)]
    got = matrices.scan_matrix(spark, str(tmp_path / "m"), 50)
    assert sorted((r["index"], r.embedding[0]) for r in got.collect()) == [(k, float(k)) for k in range(500)]
    records = spark.range(500).selectExpr("id as index", "id * 2 as name")
    assert matrices.aligned(got, records).where("name = 8").first().embedding == [4.0, 0.5]
    for bad in (records.where("index < 499"), records.union(records.limit(1)), records.union(spark.range(1).selectExpr("500L as index", "1L as name"))):
        with pytest.raises(ValueError):
            matrices.aligned(got, bad)


def test_refused_matrices(spark, tmp_path):
    np.save(tmp_path / "turned.npy", np.asfortranarray(np.ones((3, 2))))
    np.save(tmp_path / "flat.npy", np.ones(3))
    np.save(tmp_path / "whole.npy", np.ones((3, 2), np.int64))
    np.save(tmp_path / "cut.npy", np.ones((30, 2)))
    (tmp_path / "cut.npy").write_bytes((tmp_path / "cut.npy").read_bytes()[:-8])
    for name in ("turned", "flat", "whole", "cut"):
        with pytest.raises(Exception, match="matrix|hold"):
            matrices.scan_matrix(spark, str(tmp_path / f"{name}.npy")).collect()
    with pytest.raises(ValueError):
        matrices.write_matrix(spark.range(1, 5).selectExpr("id as index", "array(1f) as embedding"), str(tmp_path / "gap"), 2)
    np.save(tmp_path / "none.npy", np.zeros((0, 4), np.float32))
    assert matrices.scan_matrix(spark, str(tmp_path / "none.npy")).collect() == []
