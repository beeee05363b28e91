"""Parquet tables of a data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


_OWN: list[str] = []


def load(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The table ``name`` of ``sf_dir``, with only ``columns`` if any are given."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared folder that the cluster names for checkpoints, or None where none is set."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.

    Only a local session without that setting (tests, local use) gets a folder of its own,
    which goes with the process; on a cluster it is an error.
    """
    context = spark.sparkContext
    shared = checkpoint_dir(spark)
    if shared is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if not _OWN:
            import atexit
            import shutil
            import tempfile

            _OWN.append(tempfile.mkdtemp(prefix="contextframe-"))
            atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
        shared = _OWN[0]
    return shared


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written to the reliable checkpoint folder and read from there."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def drop_cut(df: DataFrame) -> None:
    """Deletes the files of a ``cut_lineage`` result that nothing reads any longer."""
    rdd = df._jdf.queryExecution().analyzed().rdd()
    file = rdd.getCheckpointFile()
    if file.isDefined():
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(file.get())
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
