"""Tables: the driver's inputs, cut lineage, and a content-addressed artifact store."""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one serves local mode where it is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        path = "file://" + tempfile.mkdtemp(prefix="weft-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def new_path(spark: SparkSession) -> str:
    """A path in the shared folder that is taken away when the session ends. There is nothing at it yet."""
    path = f"{shared_dir(spark)}/weft-{uuid.uuid4().hex}"
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(jpath)  # only what exists can be marked
    fs.deleteOnExit(jpath)
    return path


def cut(df: DataFrame) -> DataFrame:
    """The rows as a written table in the shared folder: a lost executor costs a reread only."""
    path = new_path(df.sparkSession) + "/rows"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def placed(rows: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """The rows with ``idx``, their place in their group by the order (from 0), and ``n``, the group's size.

    By a range sort over all tasks: a row's place in its written partition, and the counts of the partitions before.
    """
    keys = [F.col(group), *order]
    dealt = cut(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("place", F.monotonically_increasing_id())).withColumn("part", F.shiftright("place", 33))
    one = Window.partitionBy(group)
    runs = dealt.groupBy(group, "part").agg(F.min("place").alias("first"), F.count("*").alias("here"))
    runs = runs.select(group, "part", "first", (F.sum("here").over(one.orderBy("part")) - F.col("here")).alias("before"), F.sum("here").over(one).alias("n"))
    return dealt.join(runs, [group, "part"]).withColumn("idx", F.col("before") + F.col("place") - F.col("first")).drop("part", "place", "first", "before")


def canonical(value) -> str:
    """JSON with sorted keys and no spaces."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def address(seeds: list[str], parameters: dict) -> str:
    """Content address of a run: the seeds as a set, and every parameter that is set."""
    kept = {k: v for k, v in parameters.items() if not (k == "llm" and v is None)}
    return hashlib.sha256(canonical({"seeds": sorted(set(seeds)), "parameters": kept}).encode()).hexdigest()


def address_of(seeds: Column, parameters: str) -> Column:
    """``address`` as an expression: of an array of seeds that need no escapes in JSON, and the canonical text of the parameters."""
    listed = F.array_join(F.transform(F.array_sort(F.array_distinct(seeds)), lambda x: F.concat(F.lit('"'), x, F.lit('"'))), ",")
    return F.sha2(F.concat(F.lit('{"parameters":' + parameters + ',"seeds":['), listed, F.lit("]}")), 256)


class ArtifactStore:
    """Bundles of tables under ``root/address=<sha256>/``; a bundle is what its marker names.

    A writer puts its tables in a folder of its own, and then creates the marker, which names the folder, exclusively: of
    several writers of one address just one succeeds, and the others' folders are taken away. A marker that a dead writer left empty isn't a bundle.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def _path(self, key: str, name: str = ""):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.root}/address={key}/{name}".rstrip("/"))
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _meta(self, key: str) -> dict | None:
        fs, p = self._path(key, "marker")
        if not fs.exists(p):
            return None
        lines = [r[0] for r in self.spark.read.text(p.toString()).collect()]  # one line
        return json.loads(lines[0]) if lines else None

    def _create(self, key: str, name: str, text: str) -> None:
        """Creates the file with this text; raises FileExistsError if there is one."""
        fs, p = self._path(key, name)
        if p.toUri().getScheme() in (None, "file"):
            with open(p.toUri().getPath(), "x", encoding="utf-8") as f:
                f.write(text)
            return
        try:
            out = fs.create(p, False)
        except Exception as e:  # noqa: BLE001  py4j wraps whatever the file system raises
            if "FileAlreadyExists" in str(e):
                raise FileExistsError(key) from None
            raise
        out.write(bytearray(text.encode()))
        out.close()

    def has(self, key: str) -> bool:
        return self._meta(key) is not None

    def write(self, seeds: list[str], parameters: dict, tables: dict[str, DataFrame]) -> str:
        """Stores the tables; raises FileExistsError if the address has a bundle, or gets one meanwhile."""
        key = address(seeds, parameters)
        if self.has(key):
            raise FileExistsError(key)
        attempt = f"attempt={uuid.uuid4().hex}"
        try:
            for name, df in tables.items():
                df.write.parquet(f"{self.root}/address={key}/{attempt}/{name}")
            self._create(key, "marker", canonical({"attempt": attempt, "seeds": sorted(set(seeds)), "parameters": parameters, "tables": sorted(tables)}))
        except BaseException:
            fs, p = self._path(key, attempt)
            fs.delete(p, True)
            raise
        return key

    def read(self, key: str) -> tuple[dict, dict[str, DataFrame]]:
        """Metadata and tables; raises if there is no bundle, or its own content doesn't give its address."""
        meta = self._meta(key)
        if meta is None:
            raise FileNotFoundError(key)
        if address(meta["seeds"], meta["parameters"]) != key:
            raise ValueError(f"bundle {key} does not match its address")
        return meta, {n: self.spark.read.parquet(f"{self.root}/address={key}/{meta['attempt']}/{n}") for n in meta["tables"]}

    def cached(self, seeds: list[str], parameters: dict, run) -> tuple[str, dict[str, DataFrame], bool]:
        """Read-through: the stored tables, or those that ``run()`` makes; true on a hit. Of writers at one time the first one's tables are read by all."""
        key = address(seeds, parameters)
        hit = self.has(key)
        if not hit:
            try:
                self.write(seeds, parameters, run())
            except FileExistsError:
                pass
        return key, self.read(key)[1], hit
