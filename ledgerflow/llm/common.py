"""Helpers shared by the operators: document columns, Arrow maps, durable intermediate tables.

The query forms select the columns they name and nothing else, and the filtering forms, which keep all columns, take
names of their own from free_names(); so extra columns of the input never clash.
"""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Dictionary caches in Python workers stop growing here; beyond it a cache is emptied and refilled.
CACHE_ENTRIES = 400_000


def shared_dir(spark: SparkSession) -> str:
    """The folder for durable intermediate tables: spark.checkpoint.dir, which all executors share.

    Where neither the session nor the context names one, a temporary folder is set in local mode (tests); on a
    cluster that is an error, as executors would not see each other's files.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="ledgerflow-"))
    return sc._jsc.sc().getCheckpointDir().get()


def saved(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """df written as Parquet to the shared folder and read again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path) if not partition_by else spark.read.parquet(path)


def dropped(df: DataFrame) -> None:
    """Removes the files behind a frame made by saved(), once nothing reads it any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


#: Rows of an Arrow batch between the JVM and its Python workers. Whole texts are long: with batches of the default 10,000 rows the
#: buffers of an executor's many writer threads were seen to take over a gigabyte.
ARROW_ROWS = 1000


def tuned(spark: SparkSession) -> SparkSession:
    """Bounds the session's Arrow batches. The registered queries and the pipeline, which own their session, call this; operators never
    change a session's settings."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))
    return spark


#: Rows and bytes that a Python worker takes apart at once.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def bounded(batches):
    """Arrow batches cut to at most BATCH_ROWS rows and BATCH_BYTES bytes (one row at least)."""
    for batch in batches:
        rows = batch.num_rows
        step = max(1, min(BATCH_ROWS, rows * BATCH_BYTES // max(1, batch.nbytes)))
        for lo in range(0, rows, step):
            part = batch.slice(lo, step)
            if part.nbytes <= BATCH_BYTES or part.num_rows == 1:
                yield part
            else:  # rows of very different sizes
                half = part.num_rows // 2
                yield from bounded([part.slice(0, half), part.slice(half)])


_held: list = [None, None]


def hold(owner: str, clear) -> None:
    """A Python worker keeps the caches of one operator: those of the last one are emptied when another begins."""
    if _held[0] != owner:
        if _held[1] is not None:
            _held[1]()
        _held[:] = owner, clear


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until no column of df has it (whatever its case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def read_documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def arrow_map(df: DataFrame, fn, schema: str) -> DataFrame:
    """fn: record batch -> record batch, or an iterable of them, one batch at a time."""

    names = df.columns
    if any("." in c or "`" in c for c in names):  # mapInArrow resolves names, and takes a dot for a field
        df = df.toDF(*[f"c{i}" for i in range(len(names))])

    def run(batches):
        for batch in bounded(batches):
            out = fn(batch.rename_columns(names))
            if isinstance(out, pa.RecordBatch):
                yield out
            else:
                yield from out

    return df.mapInArrow(run, schema)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """Whole texts; null is empty."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def mix64(x: np.ndarray) -> np.ndarray:
    """The public SplitMix64 finaliser on unsigned 64-bit arrays."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def crc32_of_id(col) -> F.Column:
    """crc32 of the id written as decimal text."""
    return F.crc32(col.cast("string").cast("binary"))


#: For words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of the UTF-8 bytes after lower-casing A-Z: every other byte becomes a space.
WORD_BYTES = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    """Lower-cased (A-Z only) words of letters, digits and non-ASCII characters, as UTF-8 bytes."""
    return text.encode().translate(WORD_BYTES).split()


def keep_where(docs: DataFrame, keep, text_col: str = "text") -> DataFrame:
    """docs, all columns as they are, without the rows for whose text keep(text) is false; null texts are given as empty."""

    def run(batch):
        flags = pa.array([keep(t) for t in texts_of(batch, text_col)], pa.bool_())
        return batch.filter(flags)

    return arrow_map(docs, run, docs.schema)
