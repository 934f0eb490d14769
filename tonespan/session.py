"""Makes this package importable in Python workers of any cluster."""

from __future__ import annotations

import io
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Bytes of a file (or of the table, by task) up to which a text table is one task's: scoring takes much more time than reading.
SPREAD_EACH = 8 << 20

_shipped: set[str] = set()


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The folder that the cluster shares, as spark.checkpoint.dir names it."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return at.rstrip("/") if at else None


def ship(spark: SparkSession) -> None:
    """Sends the package's source to the executors once per Spark application, from the shared folder if there is one."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    shared = checkpoint_dir(spark)
    if shared:
        path = sc._jvm.org.apache.hadoop.fs.Path(f"{shared}/ship-{sc.applicationId}/{root.name}.zip")
        out = path.getFileSystem(sc._jsc.hadoopConfiguration()).create(path, True)
        out.write(bytearray(data.getvalue()))
        out.close()
        sc.addPyFile(path.toString())
    else:
        local = Path(tempfile.mkdtemp(prefix="ship-")) / f"{root.name}.zip"
        local.write_bytes(data.getvalue())
        sc.addPyFile(str(local))
    _shipped.add(sc.applicationId)


def spread(df: DataFrame, key: str = "id") -> DataFrame:
    """df over all cores, in parts that are small however large its files are: a row group would be one task.

    Tables in many small files have splits enough and aren't moved; neither are streams and frames without files.
    """
    if df.isStreaming:
        return df
    cores, files = df.sparkSession.sparkContext.defaultParallelism, len(df.inputFiles())
    if not files:
        return df
    plan = df._jdf.queryExecution().optimizedPlan()
    if "RepartitionByExpression" in plan.toString():  # it is spread already: tokens needn't move too
        return df
    leaves = plan.collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))  # of a join the estimate would be a product
    size = min(size, int(str(plan.stats().sizeInBytes())))
    parts = -(-size // SPREAD_EACH)
    return df if files >= max(cores, parts) else df.repartition(max(parts, 2 * cores), key)
