"""Session settings and lineage cuts that survive the loss of executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Prefix of a private folder below the shared one; removed when the driver ends.
_RUN = f"landweave-{uuid.uuid4().hex}"
#: Removes the shuffle files of a query when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_made: set[str] = set()
_kept: dict[tuple, DataFrame] = {}


def local_session(cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the benchmark; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("landweave")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python workers, where it isn't installed there.

    The archive is made in the shared folder of the session; a session with one machine needs none.
    """
    import importlib.util
    import io
    import os
    import zipfile

    root = os.path.dirname(os.path.abspath(importlib.util.find_spec("landweave").origin))  # type: ignore[union-attr,arg-type]
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(root):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    path = f"{shared_dir(spark)}/{_RUN}-landweave.zip"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    out.write(bytearray(buffer.getvalue()))
    out.close()
    spark.sparkContext.addPyFile(path)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: the cluster's ``spark.checkpoint.dir``.

    Only where the session names none (tests on one machine) a temporary folder is set.
    """
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not conf:
        conf = spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        conf = tempfile.mkdtemp(prefix="landweave-")
        spark.conf.set("spark.checkpoint.dir", conf)
    return conf.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


class Stage:
    """Written tables in the shared folder that cut lineage.

    Every table is Parquet on storage that outlives an executor, so a lost executor costs a
    re-read and no recomputation. ``drop`` removes a table that nothing reads any more; what
    remains is removed when the driver ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{_RUN}"
        if self.root not in _made:
            _made.add(self.root)
            atexit.register(self._clean, spark, self.root)

    @staticmethod
    def _clean(spark: SparkSession, root: str) -> None:
        try:
            _delete(spark, root)
        except Exception:  # the JVM may be gone already
            pass
        for k in [k for k in _kept if k[0] == root]:
            del _kept[k]

    def write(self, df: DataFrame) -> DataFrame:
        """Write the rows of ``df`` and return the written table."""
        path = f"{self.root}/{uuid.uuid4().hex}"
        # The shuffle files of a written table serve nothing more; otherwise they stay until the driver happens to collect its garbage.
        before = self.spark.conf.get(_CLEANUP, "false")
        self.spark.conf.set(_CLEANUP, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.set(_CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._landweave_path = path
        return out

    def once(self, key: str, path: str, make: Callable[[], DataFrame]) -> DataFrame:
        """The table ``key`` made from the data at ``path``, written at the first call and read again while that data is the same."""
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at = hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(hadoop)
        k = (self.root, key, path, at.getModificationTime(), at.getLen())
        if k not in _kept:
            made = make()
            _kept[k] = made if getattr(made, "_landweave_path", None) else self.write(made)
        return _kept[k]

    def drop(self, *tables: DataFrame | None) -> None:
        """Remove written tables; anything not written here is left alone."""
        for t in tables:
            path = getattr(t, "_landweave_path", None) if t is not None else None
            if path and path.startswith(self.root):
                _delete(self.spark, path)
