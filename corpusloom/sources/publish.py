"""Publishing in two phases: data first, and one small file last that makes it count.

A published folder holds ``data/run=<id>/`` with the artifacts that one run wrote,
``manifests/<id>`` with a row for each artifact (its digest and the run that holds it), and
``versions/``, where the file of the highest number names the manifest in force.  A version file is created, never
replaced, so of two writers one fails; whatever a run wrote before that is invisible.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "artifact string, digest string, n_rows long, run string, since long"


class Conflict(RuntimeError):
    """Another writer made the next version first."""


def digests(rows: DataFrame, artifact: str) -> DataFrame:
    """(artifact, digest, n_rows): a digest of each artifact's rows whatever their order, from sums of their hashes."""
    columns = [c for c in sorted(rows.columns) if c != artifact]
    sha = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    part = lambda k: F.sum(F.conv(F.substring(sha, 15 * k + 1, 15), 16, 10).cast("decimal(38,0)"))
    found = rows.groupBy(F.col(artifact).cast("string").alias("artifact")).agg(F.count("*").alias("n_rows"), *(part(k).alias(f"s{k}") for k in range(4)))
    return found.select("artifact", F.sha2(F.concat_ws("-", "n_rows", "s0", "s1", "s2", "s3"), 256).alias("digest"), "n_rows")


class Published:
    """A folder of artifacts of which readers see one whole version at a time."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _files(self):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), lambda *parts: self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))

    def version(self) -> int:
        """The number of the version in force; 0 before the first."""
        files, path = self._files()
        if not files.exists(path("versions")):
            return 0
        return max((int(s.getPath().getName()) for s in files.listStatus(path("versions")) if s.getPath().getName().isdigit()), default=0)

    def _named(self, version: int) -> str:
        return self.spark.read.text(f"{self.root}/versions/{version:010d}").first()[0]

    def manifest(self, version: int | None = None) -> DataFrame:
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifests/{self._named(version)}")

    def publish(self, rows: DataFrame, artifact: str) -> int:
        """Make ``rows`` the published state: changed artifacts are written, unchanged ones stay where they are, others are no longer listed.

        Nothing is visible until the version file stands; a run that fails before leaves the old version.
        A row without an artifact fails the run.
        """
        if rows.where(F.col(artifact).isNull()).limit(1).count():
            raise ValueError(f"a row has no {artifact}")
        base, run = self.version(), uuid.uuid4().hex
        held = self.manifest(base).select("artifact", F.col("digest").alias("old"), F.col("run").alias("old_run"), F.col("since").alias("old_since"))
        same = F.col("old").isNotNull() & (F.col("old") == F.col("digest"))
        planned = digests(rows, artifact).join(held, "artifact", "left").select(
            "artifact", "digest", "n_rows", F.when(same, F.col("old_run")).otherwise(run).alias("run"), F.when(same, F.col("old_since")).otherwise(F.lit(base + 1).cast("long")).alias("since")
        )
        # the plan is written before the data: what is written follows it, and a reader can't see either
        planned.write.parquet(f"{self.root}/manifests/{run}")
        todo = self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifests/{run}").where(F.col("run") == run).select("artifact")
        named = rows.withColumn("artifact", F.col(artifact).cast("string"))
        named.join(todo, "artifact", "left_semi").repartition("artifact").write.partitionBy("artifact").parquet(f"{self.root}/data/run={run}")
        self._switch(base + 1, run)
        return base + 1

    def _switch(self, version: int, run: str) -> None:
        files, path = self._files()
        try:
            out = files.create(path("versions", f"{version:010d}"), False)
        except Exception as e:
            if "already exists" in str(e) or "FileAlreadyExists" in str(e):
                raise Conflict(f"version {version} was made by another writer") from None
            raise
        out.write(bytearray(run.encode()))
        out.close()

    def read(self, schema: str, version: int | None = None, where: Column | None = None) -> DataFrame:
        """Rows of a version with their ``artifact`` and the version it was written in (``since``); only listed artifacts are opened.

        ``schema`` is that of the rows; ``where`` is a condition on ``artifact``.
        """
        listed = self.manifest(version)
        listed = listed if where is None else listed.where(where)
        runs = [r.run for r in listed.select("run").distinct().collect()]  # one for each run that still holds something
        if not runs:
            return self.spark.createDataFrame([], f"artifact string, {schema}, since long")
        data = self.spark.read.schema(f"{schema}, run string, artifact string").option("basePath", f"{self.root}/data").parquet(*(f"{self.root}/data/run={r}" for r in runs))
        data = data if where is None else data.where(where)
        return data.join(listed.select("run", "artifact", "since"), ["run", "artifact"]).drop("run")

    def unreferenced(self) -> list[str]:
        """Runs that no version lists: what was aborted, and what later versions have replaced in all that are kept."""
        files, path = self._files()
        if not files.exists(path("data")):
            return []
        every = {s.getPath().getName().removeprefix("run=") for s in files.listStatus(path("data"))}
        versions = range(1, self.version() + 1)
        used = {r.run for v in versions for r in self.manifest(v).select("run").distinct().collect()}
        return sorted(every - used)
