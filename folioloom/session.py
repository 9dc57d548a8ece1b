"""Session settings and shared storage."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
#: Folders that ``staged`` wrote and nothing has removed yet, oldest first.
_STAGED: list[str] = []


def build_session(app: str = "folioloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC times and adaptive execution; an existing session is reused."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder; only Spark's reader touches the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Where it is unset, a local master gets a temporary folder of its own; any
    other master is an error, since executors would not see a local folder.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir", None)
    if not base:
        base = os.environ.get("FOLIOLOOM_LOCAL_SHARED")
        if not base:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            base = os.environ["FOLIOLOOM_LOCAL_SHARED"] = tempfile.mkdtemp(prefix="folioloom-")
    return base.rstrip("/")


def staged(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    This cuts lineage: a lost executor costs a reread of the files, and row
    numbers assigned before the write stay as they are.
    """
    path = f"{shared_dir(spark)}/folioloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    _STAGED.append(path)
    trim(spark)
    return out


def trim(spark: SparkSession) -> None:
    """Let the driver's JVM give freed native memory back to the system, where it can."""
    gateway, jvm = spark.sparkContext._gateway, spark.sparkContext._jvm
    of = jvm.Class.forName

    def array(kind, *values):
        out = gateway.new_array(kind, len(values))
        for i, v in enumerate(values):
            out[i] = v
        return out

    with contextlib.suppress(Py4JError):
        kinds = array(jvm.Class, of("javax.management.ObjectName"), of("java.lang.String"), of("[Ljava.lang.Object;"), of("[Ljava.lang.String;"))
        command = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        given = array(jvm.Object, command, "systemTrimNativeHeap", array(jvm.Object), array(jvm.String))
        of("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), given)


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder, where it is there."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession, *frames: DataFrame) -> None:
    """Remove the files of what ``staged`` returned, once nothing reads them any more."""
    for df in frames:
        remove(spark, df._staged_at)
        _STAGED.remove(df._staged_at)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """What is staged inside is removed at the end, also of a body that raises, but for the frames given to the function that this yields."""
    before, kept = set(_STAGED), set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df._staged_at)
        return df

    try:
        yield keep
    finally:
        for path in [p for p in _STAGED if p not in before | kept]:
            remove(spark, path)
            _STAGED.remove(path)


#: Settings of queries that move whole texts: shuffle files go when their query ends, not when the driver happens to collect
#: garbage; and rows are gathered by one sort, where a hash table gives up after 128 keys and then sorts twice.
_LEAN = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.useObjectHashAggregateExec": "false"}


@contextlib.contextmanager
def lean(spark: SparkSession) -> Iterator[None]:
    """Queries that are run inside move texts with less disk and CPU (``_LEAN``); a stream that is started inside keeps to it."""
    before = {k: spark.conf.get(k, None) for k in _LEAN}
    for k, v in _LEAN.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def ship(spark: SparkSession) -> None:
    """Give the executors this package, for its Python functions; once a session."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="folioloom-ship-")) / "folioloom.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"folioloom/{p.relative_to(root)}")
    spark.sparkContext.addPyFile(str(target))
    _SHIPPED.add(app)
