import json
import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.sources import packed


def blocks(spark, shards, n, size=8):
    df = spark.range(shards * n).select((F.col("id") % shards).cast("int").alias("shard_id"), F.floor(F.col("id") / shards).alias("block_id"))
    ids = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: (F.col("shard_id") * 1000 + F.col("block_id") * size + i).cast("int"))
    return df.withColumns({"input_ids": ids, "labels": ids, "attention_mask": F.array_repeat(F.lit(1).cast("tinyint"), size)})


def test_round_trip_and_files(spark, tmp_path):
    root = str(tmp_path / "out")
    df = blocks(spark, 5, 40)
    packed.write_packed(df.repartition(7), root, block_size=8, rows_per_file=15)
    back = packed.read_packed(spark, root)
    assert back.columns == df.columns and back.exceptAll(df).count() == 0 and back.count() == 200
    assert sorted(os.listdir(root)) == [f"shard-{i:03d}" for i in range(5)]
    state = json.load(open(f"{root}/shard-002/state.json"))
    at = 0
    for f in state["_data_files"]:  # any reader of Arrow streams finds the rows in the order of the files
        with pa.ipc.open_stream(f"{root}/shard-002/{f['filename']}") as s:
            t = s.read_all()
        assert f["first_block"] == at and t.num_rows == f["rows"] <= 15 and t.column("input_ids")[0].as_py()[0] == 2000 + at * 8
        at += t.num_rows
    assert at == 40 == json.load(open(f"{root}/shard-002/dataset_info.json"))["num_rows"]


def test_pushdown_limit_and_pruning(spark, tmp_path):
    root = str(tmp_path / "out")
    packed.write_packed(blocks(spark, 4, 10), root)
    own = packed.read_packed(spark, root).where("shard_id in (1, 3) and block_id < 4")
    assert own.groupBy("shard_id").count().orderBy("shard_id").collect() == [(1, 4), (3, 4)]
    assert own.rdd.getNumPartitions() < packed.read_packed(spark, root).rdd.getNumPartitions()
    assert packed.read_packed(spark, root, limit=2).select("shard_id").distinct().count() == 2
    assert packed.read_packed(spark, root).where("shard_id > 99").count() == 0
    assert packed.read_packed(spark, root).where("shard_id is null or shard_id = 2").count() == 10
    assert packed.read_packed(spark, root).select("block_id").agg(F.sum("block_id")).first()[0] == 4 * 45


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    root = str(tmp_path / "out")
    packed.write_packed(blocks(spark, 2, 10), root)
    bad = blocks(spark, 6, 50).where("shard_id > 1").withColumn("input_ids", F.when((F.col("shard_id") == 4) & (F.col("block_id") == 30), F.raise_error(F.lit("a lost task")).cast("array<int>")).otherwise(F.col("input_ids")))
    with pytest.raises(Exception, match="a lost task"):
        packed.write_packed(bad, root)
    assert sorted(os.listdir(root)) == ["shard-000", "shard-001"]
    packed.write_packed(blocks(spark, 4, 10).where("shard_id > 1"), root)
    assert packed.listed(root) == dict.fromkeys(range(4), True)


def test_what_is_there_stays(spark, tmp_path):
    root = str(tmp_path / "out")
    packed.write_packed(blocks(spark, 2, 10), root)
    with pytest.raises(Exception, match="there already"):
        packed.write_packed(blocks(spark, 3, 20), root)
    with pytest.raises(Exception, match="without gaps"):
        packed.write_packed(blocks(spark, 4, 20).where("shard_id = 3 and block_id <> 7"), root)
    with pytest.raises(Exception, match="never overwritten"):
        blocks(spark, 1, 1).write.format("packed").mode("overwrite").save(root)
    assert packed.read_packed(spark, root).count() == 20 and sorted(os.listdir(root)) == ["shard-000", "shard-001"]


def test_incomplete_shards(spark, tmp_path):
    root = str(tmp_path / "out")
    packed.write_packed(blocks(spark, 3, 10), root)
    os.remove(f"{root}/shard-001/state.json")
    with pytest.raises(Exception, match="incomplete"):
        packed.read_packed(spark, root).count()
    assert packed.read_packed(spark, root, strict=False).count() == 20
    assert packed.drop_incomplete_packed(root) == [1] and packed.read_packed(spark, root).count() == 20
    with pytest.raises(Exception, match="no complete"):
        packed.read_packed(spark, str(tmp_path / "none")).count()
    packed.write_packed(blocks(spark, 1, 3).limit(0), str(tmp_path / "empty"))
    assert packed.listed(str(tmp_path / "empty")) == {}
