"""What several corpus operators need: the folder that all executors share, and the rules for words."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import xxhash
from pyspark.sql import DataFrame, SparkSession

#: Between words, by the contract of the corpus queries: space and the five control characters from tab on.
WORD = r"[^\x20\x09-\x0D]+"
#: Shuffle files go when the query that wrote them has ended.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_written: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a temporary folder serves if driver and executors are one process (local[n], as in tests); on a cluster that is an error."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if conf:
        return conf.rstrip("/")
    jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
    if jvm_dir.isDefined():
        return jvm_dir.get()
    if not spark.sparkContext._jsc.sc().isLocal():
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="marlstone-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def new_folder(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_remove_all)
    _written.append((spark, path))
    return path


def store(df: DataFrame, label: str, rows: int | None = None) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: lineage is cut and lost executors cost nothing.

    rows: how many rows at most Python workers take at once meanwhile, where single rows are megabytes.
    """
    spark = df.sparkSession
    path = new_folder(spark, label)
    wanted = {CLEAN: "true"} | ({BATCH: str(rows)} if rows else {})
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def remove(spark: SparkSession, *tables: DataFrame | str) -> None:
    """Deletes tables that store() wrote and that no later step reads."""
    for table in tables:
        path = spark._jvm.org.apache.hadoop.fs.Path(table if isinstance(table, str) else table.stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _remove_all() -> None:
    for spark, path in _written:
        try:
            remove(spark, path)
        except Exception:  # the session has ended; its folder is the cluster's to clean
            return


def words_of(text: str | None) -> list[bytes]:
    """Lower-cases A-Z and splits at the separators of WORD; bytes.split() knows exactly these six."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


class WordHashes(dict):
    """The hash of each word met, forgotten when they are many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 1 << 18:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


HASHES = WordHashes()
