"""Result sinks."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quotemill.operators.relational import keep_last_arrival
from quotemill.schema import POSITION_SCHEMA

#: Results of a path that a reader may still be reading: versions that `forget_old` leaves alone.
KEPT_VERSIONS = 10


class Manifest:
    """Which folders hold the current rows of each (signal, bucket) under a path, one file per version.

    A version becomes the current one by a single rename that fails if the name is taken. So a reader sees the state before a
    write or after it, a write that dies leaves the old state, and of two writes at a time one is refused. Its size is bounded
    by rules times buckets.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.fs = spark._jvm.org.apache.hadoop.fs
        self.conf = spark._jsc.hadoopConfiguration()
        self.files = self._at("").getFileSystem(self.conf)

    def _at(self, name: str):
        return self.fs.Path(f"{self.path}/{name}" if name else self.path)

    def versions(self) -> list[int]:
        folder = self._at("_manifest")
        if not self.files.exists(folder):
            return []
        names = [x.getPath().getName() for x in self.files.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def read(self, version: int) -> dict:
        stream = self.files.open(self._at(f"_manifest/{version:012d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def current(self) -> tuple[int, dict]:
        """The last version and its content; version -1, without folders, where nothing was written yet."""
        found = self.versions()
        return (found[-1], self.read(found[-1])) if found else (-1, {"folders": {}})

    def switch(self, after: int, content: dict) -> None:
        """Make `content` the version after `after`, the one it was built on."""
        draft = self._at(f"_manifest/{uuid.uuid4().hex}.draft")
        stream = self.files.create(draft, False)
        stream.write(json.dumps(content).encode())
        stream.close()
        context = self.fs.FileContext.getFileContext(self.files.getUri(), self.conf)
        plain = self.spark._sc._gateway.new_array(getattr(self.fs, "Options$Rename"), 0)
        try:
            context.rename(draft, self._at(f"_manifest/{after + 1:012d}.json"), plain)
        except Exception as e:
            self.files.delete(draft, False)
            if "FileAlreadyExists" in str(e):
                raise RuntimeError(f"another write to {self.path} came first; write again") from e
            raise

    def forget(self, versions: list[int]) -> None:
        for v in versions:
            self.files.delete(self._at(f"_manifest/{v:012d}.json"), False)

    def forget_folders(self, named: set[str]) -> None:
        """Delete the writes of which no folder is named."""
        folder = self._at("data")
        for x in self.files.listStatus(folder) if self.files.exists(folder) else []:
            write = x.getPath().getName()
            if not any(f.split("/")[1] == write for f in named):
                self.files.delete(x.getPath(), True)


def _read(spark: SparkSession, path: str, folders: list[str], format: str, schema: T.StructType) -> DataFrame:
    if not folders:
        return spark.createDataFrame([], schema)
    reader = spark.read.format(format).schema(schema).options(**_options(format))
    return reader.load([f"{path.rstrip('/')}/{f}" for f in folders])


def _options(format: str) -> dict[str, str]:
    return {"header": "true"} if format == "csv" else {}


def read_positions(spark: SparkSession, path: str, signals: list[str] | None = None) -> DataFrame:
    """What `write_positions` has stored; with `signals`, only their folders are read."""
    _, state = Manifest(spark, path).current()
    folders = [f for key, held in state["folders"].items() if signals is None or json.loads(key)[0] in signals for f in held]
    return _read(spark, path, folders, state.get("format", "parquet"), _schema(state))


def _schema(state: dict) -> T.StructType:
    return T.StructType.fromJson(state["schema"]) if "schema" in state else POSITION_SCHEMA


def write_positions(positions: DataFrame, path: str, format: str = "parquet", buckets: int = 16) -> None:
    """Position frames by signal and symbol bucket; replaces exactly the (symbol, signal) pairs it is given.

    The frame is computed once, as it is written to a folder of its own. Of the signals and buckets it touches, the other
    pairs' rows are then copied beside it, and the manifest is switched. Folders are per signal and bucket of symbols:
    one per symbol would mean millions on a wide panel. Format, buckets and columns of a path cannot change.
    """
    spark = positions.sparkSession
    manifest = Manifest(spark, path)
    version, state = manifest.current()
    if state.get("buckets", buckets) != buckets or state.get("format", format) != format:
        raise ValueError(f"{path} holds {state['format']} in {state['buckets']} buckets")
    schema = _schema(state) if state["folders"] else positions.schema
    if set(schema.names) != set(positions.columns):
        raise ValueError(f"{path} holds the columns {schema.names}")
    write = f"data/{uuid.uuid4().hex}"
    new = _write(positions.select(*schema.names), f"{path}/{write}/new", format, buckets)
    old = {key: folders for key, folders in state["folders"].items() if key in new}
    kept: set[str] = set()
    if old:
        # What was written is read back: the frame itself is not computed again.
        pairs = _read(spark, path, [f"{write}/new/{new[k]}" for k in old], format, schema).select("symbol", "signal").distinct()
        others = _read(spark, path, [f for folders in old.values() for f in folders], format, schema).join(pairs, ["symbol", "signal"], "left_anti")
        kept = set(_write(others.select(*schema.names), f"{path}/{write}/kept", format, buckets))
    folders = dict(state["folders"])
    for key, place in new.items():
        folders[key] = [f"{write}/new/{place}"] + [f"{write}/kept/{place}"] * (key in kept)
    manifest.switch(version, {"format": format, "buckets": buckets, "schema": schema.jsonValue(), "folders": folders})


def _write(rows: DataFrame, folder: str, format: str, buckets: int) -> dict[str, str]:
    """Write rows under signal and bucket folders; (signal, bucket) -> place of each that got rows."""
    own = rows.withColumns({"_signal": F.col("signal"), "_bucket": F.pmod(F.xxhash64("symbol"), F.lit(buckets)).cast("int")})
    keys = ["_signal", "_bucket"]
    (
        own.repartition(*keys, "symbol")
        .sortWithinPartitions(*keys, "symbol", "date")
        .write.partitionBy(*keys)
        .format(format)
        .options(**_options(format))
        .save(folder)
    )
    spark = rows.sparkSession
    jvm, found = spark._jvm.org.apache.hadoop.fs, {}
    top = jvm.Path(folder)
    files = top.getFileSystem(spark._jsc.hadoopConfiguration())
    for signal in files.listStatus(top):
        if signal.isDirectory() and (name := signal.getPath().getName()).startswith("_signal="):
            for bucket in files.listStatus(signal.getPath()):
                place = f"{name}/{bucket.getPath().getName()}"
                value = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName(name.split("=", 1)[1])
                found[json.dumps([value, int(place.rsplit("=", 1)[1])])] = place
    return found


def forget_old(spark: SparkSession, path: str, versions: int = KEPT_VERSIONS) -> None:
    """Delete what only versions before the last `versions` name, and what writes that died have left.

    Not to be run while a write goes on: its rows are not named yet.
    """
    manifest = Manifest(spark, path)
    found = manifest.versions()
    manifest.forget(found[:-versions])
    manifest.forget_folders({f for v in found[-versions:] for folders in manifest.read(v)["folders"].values() for f in folders})


def write_bad_dates(report: DataFrame, path: str) -> None:
    """The bad-bar report as CSV files for whoever mends the feed, replaced on every run."""
    report.write.mode("overwrite").csv(path, header=True)


def write_bars(bars: DataFrame, path: str) -> None:
    """Bars clustered by symbol, so that a symbol filter skips row groups and files."""
    clustered(bars).write.mode("overwrite").parquet(path)


def clustered(bars: DataFrame) -> DataFrame:
    return bars.repartition("symbol").sortWithinPartitions("symbol", "date")


def save_bucketed_bars(bars: DataFrame, table: str, buckets: int, path: str | None = None) -> None:
    """Bars as a table bucketed by symbol; per-symbol windows and kernels then need no shuffle (see `session.bucketed`).

    With `path` the files lie there, outside the warehouse.
    """
    writer = bars.repartition(buckets, "symbol").write.mode("overwrite").bucketBy(buckets, "symbol").sortBy("symbol", "date")
    if path is not None:
        writer = writer.option("path", path)
    writer.saveAsTable(table)


#: What is wrong with a bar, as a condition on its row.
FAULTS = {"null_closes": "close IS NULL", "crossed": "high < low"}


def load_bars(delivered: DataFrame, path: str, arrival: str) -> dict[str, int]:
    """Write a delivery's bars, the last arrival of each (symbol, date), and report on it, all in one job.

    Rows with a fault go to the folder `quarantine`, the others to `bars`. The counts are observed as the rows pass: `rows` and
    each fault before copies are dropped, `copies` dropped, `kept` and `quarantined`.
    """
    before, after = Observation(f"delivered {uuid.uuid4().hex}"), Observation(f"kept {uuid.uuid4().hex}")
    bad = F.coalesce(F.expr(" OR ".join(f"({x})" for x in FAULTS.values())), F.lit(False))
    counts = [F.count(F.lit(1)).alias("rows"), *[F.count_if(F.coalesce(F.expr(x), F.lit(False))).alias(n) for n, x in FAULTS.items()]]
    seen = delivered.observe(before, *counts)
    last = keep_last_arrival(seen, arrival).withColumn("_bad", bad)
    told = last.observe(after, F.count(F.lit(1)).alias("kept"), F.count_if("_bad").alias("quarantined"))
    folder = F.when(F.col("_bad"), F.lit("quarantine")).otherwise(F.lit("bars"))
    told.withColumn("part", folder).drop("_bad").write.mode("overwrite").partitionBy("part").parquet(path)
    first, second = before.get, after.get
    return first | {"copies": first["rows"] - second["kept"], "kept": second["kept"] - second["quarantined"], "quarantined": second["quarantined"]}


def loaded_bars(spark: SparkSession, path: str, part: str = "bars") -> DataFrame:
    """What `load_bars` kept, or its quarantine."""
    return spark.read.parquet(path).where(F.col("part") == part).drop("part")
