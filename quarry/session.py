"""SparkSession with the settings that results rely on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "quarry", **conf: str) -> SparkSession:
    """UTC, adaptive execution; anything else comes from the cluster or from conf."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for k, v in conf.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


#: Rows and bytes of one Arrow batch, which ends with the row that fills either: texts can be long, so batches stay small.
BATCH_ROWS, BATCH_BYTES = 512, 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the checkpoint folder of the context; on one machine a temporary one, on a cluster without any an error."""
    import tempfile

    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        root = f"{tempfile.gettempdir()}/quarry-checkpoints"
    return root.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder and read again: later jobs start from it, whatever executors are lost. It goes when the application ends, or by `unstored`."""
    import uuid

    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    files, place = _files(spark, path)
    files.deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def unstored(df: DataFrame) -> None:
    """Removes the folder that `stored` wrote df to; nothing may read it any more."""
    if found := df.inputFiles():
        files, place = _files(df.sparkSession, found[0])
        files.delete(place.getParent(), True)


def _files(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place
