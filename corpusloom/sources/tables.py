"""Table access, tolerant JSON, change-only and upsert sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StringType, StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def tolerant_json(spark: SparkSession, path: str, schema: StructType, name: str = r"([^/]+)\.json$") -> tuple[DataFrame, DataFrame]:
    """(good rows, bad files) of one JSON document a file; a bad file isn't fatal.  ``name`` finds a document's name in its path."""
    full = StructType(list(schema.fields)).add("_corrupt", "string")
    text = spark.read.text(path, wholetext=True).select(
        F.regexp_extract(F.col("_metadata.file_path"), name, 1).alias("slug"),
        F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("doc"),
    )
    rows = text.select("slug", "doc.*")
    return rows.where(F.col("_corrupt").isNull()).drop("_corrupt"), rows.where(F.col("_corrupt").isNotNull()).select("slug", "_corrupt")


def with_side(df: DataFrame, side: DataFrame, key: str, column: str, empty: Column) -> DataFrame:
    """Attach a side table's column; rows without an entry get ``empty``."""
    return df.join(side.select(key, column), key, "left").withColumn(column, F.coalesce(column, empty))


def content_hash(*cols: Column) -> Column:
    return F.md5(F.concat_ws("|", *(F.coalesce(c.cast("string"), F.lit("")) for c in cols)).cast("binary"))


def changed(new: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """(key, status) of a hash diff: added, changed, stale or same.  Both have (key, digest)."""
    n, s = new.select(key, F.col("digest").alias("new")), stored.select(key, F.col("digest").alias("old"))
    status = (
        F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "stale").when(F.col("old") != F.col("new"), "changed").otherwise("same")
    )
    return n.join(s, key, "full_outer").select(key, status.alias("status"))


def write_changed(new: DataFrame, stored: DataFrame, key: str, path: str) -> None:
    """Write only the rows whose content differs from what is stored."""
    todo = changed(new, stored, key).where("status in ('added', 'changed')").select(key)
    new.join(todo, key, "left_semi").write.mode("append").parquet(path)


def upsert(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key: the newest by ``order``."""
    w = Window.partitionBy(*keys).orderBy(*(c.desc() for c in order))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def first_wins(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def ordinals(df: DataFrame, column: str, out: str) -> DataFrame:
    """Dictionary encoding: 0-based rank of a value among the distinct ones, -1 for null.

    Distinct values are counted in blocks by their beginnings, so neither rows nor values go
    through one task.
    """
    values = df.select(column).where(F.col(column).isNotNull()).distinct()
    kind = df.schema[column].dataType
    block = F.substring(column, 1, 3) if isinstance(kind, StringType) else F.floor(F.col(column) / 4096) if isinstance(kind, IntegralType) else F.col(column)
    ranked = numbered(values, [column], out, block)
    return df.join(ranked, column, "left").withColumn(out, F.coalesce(out, F.lit(-1)))


def page_after(rows: DataFrame, cursor: int, limit: int, seq: str = "seq") -> DataFrame:
    """Rows after a cursor in order, with a flag whether there are more."""
    got = rows.where(F.col(seq) > cursor).orderBy(seq).limit(limit + 1)
    w = Window.orderBy(seq)
    return got.withColumn("_n", F.row_number().over(w)).withColumn("more", F.max("_n").over(Window.partitionBy()) > limit).where(F.col("_n") <= limit).drop("_n")


def sections(lines: DataFrame, key: str, pos: str, text: str, is_header: Column) -> DataFrame:
    """Carry the last header line of each key to the lines below it."""
    w = Window.partitionBy(key).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("header", F.last(F.when(is_header, F.col(text)), ignorenulls=True).over(w)).where(~is_header)


def numbered(rows: DataFrame, order: list[str], out: str, block: Column | None = None) -> DataFrame:
    """0-based place of each row by ``order``: places inside blocks plus the counts of the blocks before.

    A block must not decrease along the order; by default it is an hour of the first column.
    Blocks, not rows, go through the one global window.
    """
    block = F.floor(F.unix_timestamp(F.col(order[0]).cast("timestamp")) / 3600) if block is None else block
    rows = rows.withColumn("_b", block)
    sizes = rows.groupBy("_b").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    inner = F.row_number().over(Window.partitionBy("_b").orderBy(*order)) - 1
    return rows.withColumn("_i", inner).join(before, "_b").withColumn(out, F.col("_i") + F.col("_before")).drop("_b", "_i", "_before")


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder that driver and executors share: below ``spark.checkpoint.dir``, in tests below the warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def spread(df: DataFrame, *keys: str | Column) -> DataFrame:
    """Rows dealt to all cores by a hash of ``keys``, before work that is long for a small file, which would be read by one task.

    The number is given, so that adaptive execution doesn't put the small partitions together again.
    """
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return df.repartition(n, *keys)


def sized(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """Rows dealt by ``keys`` to as many tasks as hold about ``rows`` each, so a task's share doesn't grow with the table."""
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // rows)), *keys)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise a frame in the shared folder that the session names in ``spark.checkpoint.dir``.

    Only where that is unset, as in tests on one machine, a folder below the warehouse is taken.
    """
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        found = spark.conf.get("spark.checkpoint.dir", None)
        spark.sparkContext.setCheckpointDir(found or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")
    return df.checkpoint(eager=True)
