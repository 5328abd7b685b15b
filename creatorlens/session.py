"""Session construction and the shared scratch area.

Jobs that need an intermediate result more than once write it as a Parquet
table into the folder named by ``spark.checkpoint.dir``. A written table
survives executor loss, cuts the lineage, and unlike an RDD checkpoint can be
read back with column pruning and pushed-down filters.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence
from hashlib import md5

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of generated code above which HotSpot never compiles a method. Stages of many parsers are larger
#: as one method; below the limit Spark splits them.
HUGE_METHOD = "spark.sql.codegen.hugeMethodLimit", "8000"

_LOCAL_SCRATCH: dict[str, str] = {}
_RESULTS: dict[str, dict[tuple, object]] = {}


def build_session(app: str = "creatorlens", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the library assumes (UTC, AQE, skew join)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        HUGE_METHOD[0]: HUGE_METHOD[1],
    }
    for k, v in {**defaults, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """Folder for intermediate tables of this application."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    app_id = spark.sparkContext.applicationId
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        base = _LOCAL_SCRATCH.get(app_id)
        if base is None:
            base = _LOCAL_SCRATCH[app_id] = tempfile.mkdtemp(prefix="creatorlens-")
    return f"{base.rstrip('/')}/creatorlens/{app_id}"


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` once as Parquet and return a frame that scans the result.

    A partitioned table is rebalanced by its partition column first: a folder's files follow its
    size, not the number of tasks, and a large folder is written by several."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    writer = df.hint("rebalance", partition_by).write.partitionBy(partition_by) if partition_by else df.write
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)


def input_version(spark: SparkSession, folder: str) -> str:
    """Changes when a table directly below ``folder`` is replaced or gets other files."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(conf)
    seen = []
    for entry in fs.listStatus(path):
        parts = fs.listStatus(entry.getPath()) if entry.isDirectory() else [entry]
        seen += [(p.getPath().toString(), p.getLen(), p.getModificationTime()) for p in parts]
    return md5(repr(sorted(seen)).encode()).hexdigest()


def once(spark: SparkSession, key: tuple, folder: str, build: Callable[[], object]):
    """Result of ``build``, made once per application and state of the input ``folder``:
    stored tables and fits that several queries read."""
    key = (*key, folder, input_version(spark, folder))
    results = _RESULTS.setdefault(spark.sparkContext.applicationId, {})
    if key not in results:
        results[key] = build()
    return results[key]


def literal_frame(spark: SparkSession, names: Sequence[str], rows: Sequence[tuple]) -> DataFrame:
    """A short fixed table as literals of the plan (no Python data source, no job)."""
    cells = [F.struct(*[F.lit(v).alias(n) for n, v in zip(names, r)]) for r in rows]
    return spark.range(1).select(F.inline(F.array(*cells)))


def drop_scratch(spark: SparkSession) -> None:
    """Delete this application's intermediate tables (call when results are saved)."""
    _RESULTS.pop(spark.sparkContext.applicationId, None)
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
