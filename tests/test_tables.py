"""Tables that are changed in place, and a database."""

import datetime as dt
import glob
import os

import pytest
from pyspark.sql import functions as F

from memspark.schemas import MEMORIES, with_defaults
from memspark.sources import tables

NOW = dt.datetime(2024, 2, 1)


def rows(spark, numbers, content="text"):
    base = {"namespace": "user:u", "created_at": NOW, "updated_at": NOW, "content": content, "tags": ["a", "b"], "metadata": {"k": "v"}}
    full = [base | {"memory_id": f"m{i:03}", "user_id": f"u{i % 20}"} for i in numbers]
    return with_defaults(spark.createDataFrame([tuple(r.get(f.name) for f in MEMORIES) for r in full], MEMORIES))


def files(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/user_bucket=*/*.parquet")}


def test_merge_rewrites_touched_buckets_alone(spark, tmp_path):
    path = str(tmp_path / "memories")
    tables.write_table(rows(spark, range(200)), path, buckets=8)
    before, bucket = files(path), {r.user_id: r.user_bucket for r in spark.read.parquet(path).select("user_id", "user_bucket").distinct().collect()}
    changes, deletes = rows(spark, [3, 23, 203], "new"), spark.createDataFrame([("u3", "m043"), ("u3", "none"), ("u4", "m003")], "user_id string, memory_id string")
    for _ in range(2):  # a second run changes nothing more
        tables.merge_table(spark, path, 8, changes, deletes)
        got = {r.memory_id: r.content for r in spark.read.parquet(path).collect()}
        assert got == {f"m{i:03}": "new" if i in (3, 23, 203) else "text" for i in (*range(200), 203) if i != 43}
    after = files(path)
    touched = {f"user_bucket={bucket[u]}" for u in ("u3", "u4")}
    assert {f for f in before if before[f] == after.get(f)} == {f for f in before if f.split("/")[-2] not in touched}
    assert not {f for f in before if f in after and f.split("/")[-2] in touched}


def test_merge_empties_a_bucket(spark, tmp_path):
    path = str(tmp_path / "memories")
    tables.write_table(rows(spark, [1, 2]), path, buckets=64)
    tables.merge_table(spark, path, 64, rows(spark, []), spark.createDataFrame([("u1", "m001")], "user_id string, memory_id string"))
    assert [r.memory_id for r in spark.read.parquet(path).collect()] == ["m002"]
    tables.merge_table(spark, path, 64, rows(spark, []))
    assert spark.read.parquet(path).count() == 1


@pytest.mark.parametrize("format", ["orc", "json", "csv"])
def test_other_formats(spark, tmp_path, format):
    df = rows(spark, range(9)).select("memory_id", "user_id", "content", "created_at", "access_count")
    tables.write_table(df, f"{tmp_path}/t", format=format)
    assert sorted(tables.read_table(spark, f"{tmp_path}/t", df.schema, format).collect()) == sorted(df.collect())


def test_database(spark, tmp_path):
    """Derby, which Spark ships: types, nulls and nested columns survive; rows are replaced by key; reads are split by text and by number."""
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    first = rows(spark, range(60))
    tables.upsert_jdbc(first, url, "memories")
    assert sorted(tables.read_jdbc(spark, url, "memories", MEMORIES).collect()) == sorted(first.select(*MEMORIES.names).collect())
    tables.upsert_jdbc(rows(spark, [5, 6, 100], "new"), url, "memories")
    found = tables.read_jdbc(spark, url, "memories", MEMORIES, partitions=4)
    assert {r.memory_id: r.content for r in found.collect()} == {f"m{i:03}": "new" if i in (5, 6, 100) else "text" for i in (*range(60), 100)}
    assert found.rdd.getNumPartitions() > 1
    numbers = spark.range(1000).withColumn("x", F.col("id") * 2)
    tables.upsert_jdbc(numbers, url, "numbers", key="id", key_type="BIGINT")
    read = tables.read_jdbc(spark, url, "numbers", numbers.schema, key="id", partitions=5)
    assert read.rdd.getNumPartitions() == 5 and read.agg(F.sum("x"), F.count("*")).first()[:] == (999000, 1000)
    assert spark.read.format("jdbc").options(url=url, query="SELECT COUNT(*) AS n FROM SYS.SYSTABLES WHERE TABLENAME LIKE '%\\_%' ESCAPE '\\' AND TABLETYPE = 'T'").load().first()[0] == 0
