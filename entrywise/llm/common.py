"""Session helpers shared by the operators."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.folders import shared_folder


def delete_at_end(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate tables when the application ends: lazy results may read it until then."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)


def delete_now(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: Rows of an Arrow batch: texts are long, and a batch is held by the JVM and by Python at once.
BATCH_ROWS = 1000


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once for each SparkContext, and keep Arrow batches of texts small."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    sc = spark.sparkContext
    if getattr(sc, "_entrywise_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    made = Path(tempfile.mkdtemp(prefix="entrywise-code-")) / "entrywise_code.zip"
    with zipfile.ZipFile(made, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, Path(root.name) / p.relative_to(root))
    sc.addPyFile(str(made))
    sc._entrywise_shipped = True


def materialize(df: DataFrame) -> DataFrame:
    """Write a DataFrame as a table in the shared checkpoint folder and read it back: lineage is cut and nothing is computed twice."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/entrywise/{uuid.uuid4().hex}"
    df.write.parquet(path)
    delete_at_end(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, stem: str) -> str:
    """A column name that the DataFrame doesn't have (names compare without case)."""
    have = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in have:
        name += "_"
    return name


def hash_unit(*cols: Column | str) -> Column:
    """A uniform number in [0, 1) from the MD5 of the parts; the same in any SQL engine with md5()."""
    text = F.concat_ws(":", *[c if isinstance(c, Column) else F.lit(c) for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
