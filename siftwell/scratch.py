"""Tables written to the shared scratch folder, where a plan has to be fixed before it is read twice."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where unset in local mode (tests), a folder set once for the session."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-scratch-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def materialize(df: DataFrame, label: str, rows_a_group: int | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends there,
    and an executor that is lost later takes nothing with it.  The table goes when the application ends.  Rows of megabytes need
    rows_a_group: writers look at the size of a row group only after a hundred rows, and readers hold up to 4096 rows of one."""
    path = f"{scratch_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    (df.write.option("parquet.block.row.count.limit", rows_a_group) if rows_a_group else df.write).parquet(path)
    p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).deleteOnExit(p)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def put_line(spark: SparkSession, path: str, line: str) -> None:
    """Write a one-line file in full beside its place, then move it there: a crash leaves the old line or the new one."""
    jvm = spark._jvm
    new, place = jvm.org.apache.hadoop.fs.Path(f"{path}.new"), jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(new, True)
    out.write(bytearray(line.encode()))
    out.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(new, place, options)


def read_line(spark: SparkSession, path: str) -> str | None:
    """The line of such a file; None where there is none."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return None
    return "".join(r.value for r in spark.read.text(path).collect())
