"""Session helpers: the work folder, written tables, and grouped passes."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, GroupedData, SparkSession

_local_folder: dict[str, str] = {}
_shipped: set[str] = set()


def work_folder(spark: SparkSession) -> str:
    """Folder shared by all executors, as the cluster names it in spark.checkpoint.dir.

    Only a local session may go without the setting; it then gets a folder of its own.
    """
    app = spark.sparkContext.applicationId
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder all executors can reach")
        if app not in _local_folder:
            _local_folder[app] = tempfile.mkdtemp(prefix="quotemill-")
        shared = _local_folder[app]
    return f"{shared.rstrip('/')}/quotemill/{app}"


def write_table(df: DataFrame, name: str) -> str:
    """Write `df` once to the shared folder; a lost executor then costs a re-read, not a re-run."""
    path = f"{work_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, wherever they run; once per application."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        package = os.path.dirname(os.path.abspath(__file__))
        target = os.path.join(tempfile.mkdtemp(prefix="quotemill-"), "quotemill")
        spark.sparkContext.addPyFile(
            shutil.make_archive(target, "zip", os.path.dirname(package), os.path.basename(package))
        )
        _shipped.add(app)


@contextmanager
def bucketed(spark: SparkSession) -> Iterator[None]:
    """Plans built inside read bars that are bucketed by symbol; see `spread`."""
    before = spark.conf.get("spark.quotemill.bucketed", "false")
    spark.conf.set("spark.quotemill.bucketed", "true")
    try:
        yield
    finally:
        spark.conf.set("spark.quotemill.bucketed", before)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash rows by key over as many partitions as the session runs tasks, twice over.

    Per-series work costs far more than its bytes suggest; the explicit count keeps adaptive execution
    from packing many series into one task because their rows are small. `spark.quotemill.seriesPartitions`
    sets another count, for clusters that grow while they run. With `spark.quotemill.bucketed` the rows are left where
    they are: bars of a table bucketed by symbol lie right for windows and grouped passes, and Spark moves what does not.
    """
    spark = df.sparkSession
    if spark.conf.get("spark.quotemill.bucketed", "false") == "true":
        return df
    count = spark.conf.get("spark.quotemill.seriesPartitions", None)
    return df.repartition(int(count) if count else 2 * spark.sparkContext.defaultParallelism, *keys)


def date_sorted_groups(df: DataFrame, *keys: str) -> GroupedData:
    """Groups whose rows reach a grouped map in date order.

    The sort by key and date already clusters the keys, so the map adds no sort of its own, and a
    frame that is laid out this way keeps its exchange.
    """
    ship_package(df.sparkSession)
    return spread(df, *keys).sortWithinPartitions(*keys, "date").groupBy(*keys)


def pieces(batches: Iterable[pd.DataFrame], rows: int) -> Iterator[pd.DataFrame]:
    """The batches of one group in slices of at most `rows`, without empty ones."""
    for pdf in batches:
        for start in range(0, len(pdf), rows):
            yield pdf.iloc[start : start + rows]
