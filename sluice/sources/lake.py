"""The Parquet lake: append-only shards by table and source, current and as-of reads, and their verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice import schema
from sluice.operators import history


class Lake:
    """Tables under a root: root/<table>/source_id=<source>/run=<run>/*.parquet, and a manifest of written runs."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def write(self, table: str, rows: DataFrame, source: str, run: str) -> None:
        """Append a run of one source: rows are conformed, keys must be unique in the run, a repeated run replaces itself."""
        checked = schema.conform(rows, table)
        if not (bad := schema.duplicate_keys(checked, table)).isEmpty():
            raise ValueError(f"{table} has repeated keys, one is {bad.first()[0]}")
        body = checked.drop("source_id") if "source_id" in checked.columns else checked
        target = f"{self.path(table)}/source_id={source}/run={run}"
        body.write.mode("overwrite").option("compression", "zstd").parquet(target)
        # The manifest names every shard with its rows and digest; reads go by it, so a body without an entry is not there.
        rows = self.spark.read.parquet(target).groupBy(_name(F.col("_metadata.file_path")).alias("shard")).agg(F.count(F.lit(1)).alias("rows"))
        files = checksums(self.spark, target).select(_name(F.col("path")).alias("shard"), "size", "sha256").where(F.col("shard").endswith(".parquet"))
        entry = files.join(F.broadcast(rows), "shard", "left").select(F.lit(table).alias("table"), F.lit(source).alias("source"), F.lit(run).alias("run"), "shard", F.coalesce("rows", F.lit(0).cast("long")).alias("rows"), "size", "sha256", F.lit(False).alias("removed"))
        self._record(entry)

    def _record(self, entry: DataFrame) -> None:
        entry.withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{self.root}/_manifest")

    def remove(self, table: str, source: str, run: str) -> None:
        """Mark a run as removed; reads leave it out from then on."""
        entry = self.spark.createDataFrame([(table, source, run, None, 0, 0, None, True)], "table string, source string, run string, shard string, rows long, size long, sha256 string, removed boolean")
        self._record(entry)

    def manifest(self) -> DataFrame:
        """The last entries of each run: one a shard, or one that says it is removed."""
        every = self.spark.read.parquet(f"{self.root}/_manifest")
        last = every.groupBy("table", "source", "run").agg(F.max("at").alias("at"))
        return every.join(last, ["table", "source", "run", "at"])

    def history(self, table: str, source: str | None = None, run: str | None = None) -> DataFrame:
        """All rows of the runs that are not removed; a source or run reads only its folders."""
        there = self.manifest().where((F.col("table") == table) & ~F.col("removed")).select("source", "run").distinct()
        for column, value in (("source", source), ("run", run)):
            if value is not None:
                there = there.where(F.col(column) == value)
        # Only folders that the manifest names are opened: what else lies there may have columns of other types.
        folders = sorted(f"{self.path(table)}/source_id={r['source']}/run={r['run']}" for r in there.toLocalIterator())
        if not folders:
            return self.spark.createDataFrame([], schema.spark_schema(table))
        df = self.spark.read.option("mergeSchema", "true").option("basePath", self.path(table)).parquet(*folders)
        order = [n for n, _, _ in schema.fields(table) if n in df.columns]
        return df.select(*order)

    def current(self, table: str) -> DataFrame:
        """Latest row of each key: version, time, source."""
        df = self.history(table)
        version = "record_version" if "record_version" in df.columns else None
        return history.current(df, schema.primary_key(table), schema.time_column(table), version)

    def as_of(self, table: str, cutoff: str, include_deleted: bool = False) -> DataFrame:
        """The state at an ISO time, from the whole history: later versions never hide the rows that were current then."""
        df, time = self.history(table), schema.time_column(table)
        at = F.lit(cutoff).cast("timestamp")
        if table == "source_object":
            deleted = None if include_deleted else F.col("deleted_at") <= at
            return history.as_of(df, ["source_id", "native_id"], at, time, ["source_object_id"], deleted)
        ties = [c for c in ("record_version", "source_id") if c in df.columns]
        return history.as_of(df, [schema.primary_key(table)], at, time, ties)

    def install_views(self) -> list[str]:
        """Temporary views <table>_history and <table> of every table that the lake has."""
        made = []
        for entry in self.manifest().where(~F.col("removed")).select("table").distinct().collect():
            self.history(entry["table"]).createOrReplaceTempView(f"{entry['table']}_history")
            self.current(entry["table"]).createOrReplaceTempView(entry["table"])
            made.append(entry["table"])
        return sorted(made)

    def verify(self) -> DataFrame:
        """(table, source, run, shard, problem) of shards that are missing, changed, or not in the manifest: one pass over all files."""
        known = self.manifest().where(~F.col("removed")).select("table", "source", "run", "shard", F.col("sha256").alias("expected"))
        found = checksums(self.spark, self.root).where(F.col("path").rlike("/source_id=[^/]*/run=[^/]*/[^/]*[.]parquet$"))
        part = lambda p: F.regexp_extract("path", p, 1)
        here = found.select(part("/([^/]+)/source_id=").alias("table"), part("/source_id=([^/]*)/").alias("source"), part("/run=([^/]*)/").alias("run"), _name(F.col("path")).alias("shard"), "sha256")
        gone = self.manifest().where("removed").select("table", "source", "run")
        both = known.join(here, ["table", "source", "run", "shard"], "full").join(gone, ["table", "source", "run"], "left_anti")
        problem = F.when(F.col("sha256").isNull(), "missing").when(F.col("expected").isNull(), "not in the manifest").when(F.col("expected") != F.col("sha256"), "changed")
        return both.withColumn("problem", problem).where(F.col("problem").isNotNull()).select("table", "source", "run", "shard", "problem")


def _name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, sha256) of all files below a folder, hashed where they are read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))
