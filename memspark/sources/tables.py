"""Reading and writing of the canonical tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from memspark.schemas import OBSERVATIONS


def read_table(spark: SparkSession, path: str, schema: StructType | None = None, format: str = "parquet", **options: str) -> DataFrame:
    """A table; with a schema nothing is inferred. ``format`` may be parquet, orc, json or csv; read_jdbc() reads from databases."""
    reader = spark.read.format(format).options(**options)
    reader = reader.schema(schema) if schema is not None else reader
    return reader.load(path) if path else reader.load()


def _bucketed(df: DataFrame, buckets: int) -> DataFrame:
    return df.withColumn("user_bucket", F.pmod(F.xxhash64("user_id"), F.lit(buckets)).cast("int"))


def write_table(df: DataFrame, path: str, mode: str = "append", buckets: int = 0, format: str = "parquet") -> None:
    """Write a table; with ``buckets`` it is partitioned by a hash of user_id, so that a user's rows are read alone."""
    if buckets:
        df = _bucketed(df, buckets).repartition("user_bucket")
    writer = df.write.mode(mode).format(format)
    (writer.partitionBy("user_bucket") if buckets else writer).save(path)


def merge_table(spark: SparkSession, path: str, buckets: int, changes: DataFrame, deletes: DataFrame | None = None, key: str = "memory_id") -> None:
    """Put ``changes`` (whole rows) in the place of the rows of their user and key in a table of write_table(), and take out ``deletes`` (user_id, key).

    Only the buckets of the users that change are read and written, by dynamic partition overwrite; all other files stay as they are.
    The new rows are made beside the table first, so a job that fails leaves it whole and can be run again. Of changes with one key
    any may win: bring the last one only (upsert_vectors() chooses it).
    """
    columns = [c for c in spark.read.parquet(path).columns if c != "user_bucket"]
    new = _bucketed(changes.select(*columns).dropDuplicates(["user_id", key]), buckets)
    gone = new.select("user_bucket", "user_id", key)
    if deletes is not None:
        gone = gone.unionByName(_bucketed(deletes.select("user_id", key), buckets).select("user_bucket", "user_id", key))
        new = new.join(deletes.select("user_id", key), ["user_id", key], "left_anti")
    touched = sorted(r[0] for r in gone.select("user_bucket").distinct().collect())  # as many as there are buckets at most
    if not touched:
        return
    held = spark.read.parquet(path).filter(F.col("user_bucket").isin(touched))
    stay = held.join(gone.drop("user_bucket").distinct(), ["user_id", key], "left_anti")
    rows = materialise(stay.select(*columns, "user_bucket").unionByName(new.select(*columns, "user_bucket")), "merged")
    rows.repartition("user_bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("user_bucket").parquet(path)
    # A bucket that has lost its last row is written by nobody.
    for bucket in set(touched) - {r[0] for r in rows.select("user_bucket").distinct().collect()}:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/user_bucket={bucket}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


_COMPLEX = ("array", "map", "struct")


def read_jdbc(spark: SparkSession, url: str, table: str, schema: StructType, key: str = "memory_id", partitions: int = 8, **options: str) -> DataFrame:
    """A table of a database with the types of ``schema``, read by ``partitions`` tasks.

    A number as key splits its range into strides; for other keys each task takes an equal range of the sorted keys' first
    letters by predicates, which the database evaluates. Arrays, maps and structs are held as JSON.
    """
    reader = lambda: spark.read.format("jdbc").options(url=url, **options)
    name = f'"{key}"'
    if schema[key].dataType.typeName() in ("long", "integer", "short"):
        low, high = reader().option("query", f"SELECT MIN({name}) AS low, MAX({name}) AS high FROM {table}").load().first()
        bounds = {} if low is None else {"partitionColumn": name, "lowerBound": str(low), "upperBound": str(high + 1), "numPartitions": str(partitions)}
        found = reader().option("dbtable", table).options(**bounds).load()
    else:
        heads = sorted(r[0] or "" for r in reader().option("query", f"SELECT DISTINCT SUBSTR({name}, 1, 2) AS head FROM {table}").load().collect())
        cuts = [heads[len(heads) * i // partitions] for i in range(1, partitions)] if heads else []
        cuts = [c.replace("'", "''") for c in sorted(set(cuts) - {""})]
        predicates = [" AND ".join([f"{name} >= '{a}'"] * bool(a) + [f"{name} < '{b}'"] * bool(b)) or "1 = 1" for a, b in zip(["", *cuts], [*cuts, ""])]
        predicates[0] = f"({predicates[0]}) OR {name} IS NULL"
        found = spark.read.jdbc(url, table, predicates=predicates, properties=dict(options))
    by_name = {c.lower(): c for c in found.columns}
    typed = lambda f: F.from_json(by_name[f.name.lower()], f.dataType) if f.dataType.typeName() in _COMPLEX else F.col(by_name[f.name.lower()]).cast(f.dataType)
    return found.select(*(typed(f).alias(f.name) for f in schema))


def upsert_jdbc(df: DataFrame, url: str, table: str, key: str = "memory_id", key_type: str = "VARCHAR(255)", **options: str) -> None:
    """Put the rows of ``df`` in the place of those with their keys, making the table if it isn't there.

    The rows go to a staging table, by many tasks; one transaction of the database then exchanges them, so readers see all or nothing.
    """
    spark, staging = df.sparkSession, f"{table}_{uuid.uuid4().hex[:12]}"
    flat = df.select(*(F.to_json(f.name).alias(f.name) if f.dataType.typeName() in _COMPLEX else F.col(f.name) for f in df.schema))
    write = lambda rows, name: rows.write.format("jdbc").options(url=url, dbtable=name, createTableColumnTypes=f"{key} {key_type}", **options).mode("append").save()
    write(flat, staging)
    write(flat.limit(0), table)
    columns = ", ".join(f'"{c}"' for c in flat.columns)
    connection = spark._jvm.java.sql.DriverManager.getConnection(url)
    try:
        connection.setAutoCommit(False)
        run = connection.createStatement()
        run.executeUpdate(f'DELETE FROM {table} WHERE "{key}" IN (SELECT "{key}" FROM {staging})')
        run.executeUpdate(f"INSERT INTO {table} ({columns}) SELECT {columns} FROM {staging}")
        run.executeUpdate(f"DROP TABLE {staging}")
        connection.commit()
    finally:
        connection.close()


def read_observations(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Ingest requests as JSON lines, in batch or as a stream of files."""
    return (spark.readStream if streaming else spark.read).schema(OBSERVATIONS).json(path)


def upsert_vectors(held: DataFrame, changes: DataFrame, deletes: DataFrame | None = None) -> DataFrame:
    """memory_id, embedding, seq after ``changes``: the last write of an id wins; ids of ``deletes`` go."""
    latest = F.row_number().over(Window.partitionBy("memory_id").orderBy(F.desc("seq")))
    out = held.unionByName(changes).withColumn("_k", latest).filter("_k = 1").drop("_k")
    return out if deletes is None else out.join(deletes.select("memory_id"), "memory_id", "left_anti")


def get_vectors(held: DataFrame, ids: DataFrame) -> DataFrame:
    return held.join(ids.select("memory_id"), "memory_id", "left_semi")


def new_folder(spark: SparkSession, label: str) -> str:
    """A new place in the folder that driver and executors share; in one of our own only in local mode, where none is set."""
    name = spark.conf.get("spark.checkpoint.dir", None)
    if not name:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        name = tempfile.mkdtemp(prefix="memspark-")
        spark.conf.set("spark.checkpoint.dir", name)
    return f"{name.rstrip('/')}/{label}-{uuid.uuid4().hex}"


_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def materialise(df: DataFrame, label: str, batch: int | None = None) -> DataFrame:
    """``df`` as a table in the shared folder: what is read several times is made once. ``batch``: bytes that are sent to Python at a time, where rows are wide."""
    conf, path = df.sparkSession.conf, new_folder(df.sparkSession, label)
    before = conf.get(_BATCH)
    try:
        conf.set(_BATCH, f"{batch}b" if batch else before)
        df.write.parquet(path)
    finally:
        conf.set(_BATCH, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)
