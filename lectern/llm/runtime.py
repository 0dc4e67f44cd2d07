"""Session plumbing shared by the training-data operators.

Intermediate results that must outlive an executor go to the folder named by ``spark.checkpoint.dir``.  Only when the
session names none and driver and executors are one process is a folder under the system's temporary directory used
instead; on a cluster it is an error.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lectern.llm import textkit

SPACE = "\\x20\\x09-\\x0D"
WORD_PATTERN = f"[^{SPACE}]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; also made Spark's checkpoint folder if it is not yet."""
    folder = spark.conf.get("spark.checkpoint.dir", "")
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = f"file://{tempfile.gettempdir()}/lectern-checkpoints"
        spark.conf.set("spark.checkpoint.dir", folder) if spark.conf.isModifiable("spark.checkpoint.dir") else None
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back, which ends its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spill(df: DataFrame) -> DataFrame:
    """Like :func:`cut`, as Parquet: for wide tables of which later steps read only some columns."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lectern-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame | None) -> None:
    """Deletes the files of a table that :func:`spill` has written."""
    if df is None:
        return
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    for folder in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        if folder.rsplit("/", 1)[1].startswith("lectern-"):
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


@contextmanager
def described(spark: SparkSession, text: str) -> Iterator[None]:
    """Names the jobs that start within, for the UI and the event log, where RDD jobs have no plan that says what they read."""
    context = spark.sparkContext
    before = context.getLocalProperty("spark.job.description")
    context.setJobDescription(text)
    try:
        yield
    finally:
        context.setLocalProperty("spark.job.description", before)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def arrow_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches of texts small, whatever the length of the texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def crc_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id's decimal text, modulo ``folds``; null ids hash as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """Drops columns that would clash with ``names``, upper and lower case alike."""
    taken = {x.lower() for x in names}
    return df.select(*[df[f"`{c}`"] for c in df.columns if c.lower() not in taken])


def extend(docs: DataFrame, kernel, fields: str, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """Runs ``kernel(texts) -> list of arrays`` over slices of the text column and appends the arrays as columns.

    ``kernel`` is made once a task by calling it without arguments; it gets an Arrow string array.  ``keep`` names the
    columns carried along (all by default); columns that clash with the new ones are replaced.
    """
    arrow_batches(docs.sparkSession)
    new = StructType.fromDDL(fields)
    carried = without(docs, new.names)
    if keep is not None:
        carried = carried.select(*[c for c in keep if c.lower() not in {x.lower() for x in new.names}])
    names = carried.columns
    ready = text in names and carried.schema[text].dataType == StringType()
    more = [] if ready else [docs[text].cast("string").alias("__text")]
    place = names.index(text) if ready else len(names)
    schema = StructType(list(carried.schema.fields) + list(new.fields))
    # mapInArrow looks its columns up by name, so that a name with a dot must not reach it
    plain = [f"c{k}" for k in range(len(schema.fields))]
    source = docs.select(*[docs[f"`{c}`"].alias(x) for c, x in zip(names, plain, strict=False)], *more)
    safe = StructType([StructField(x, f.dataType, f.nullable) for x, f in zip(plain, schema.fields, strict=True)])

    def run(batches):
        work = kernel()
        for batch in batches:
            column = batch.column(place)
            parts = [work(column.slice(i, j - i)) for i, j in textkit.slices(textkit.buffers(column)[1])]
            if not parts:
                continue
            made = [pa.concat_arrays([p[k] for p in parts]) for k in range(len(new.fields))]
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in range(len(names))] + made, names=plain)

    return source.mapInArrow(run, safe).toDF(*schema.names)
