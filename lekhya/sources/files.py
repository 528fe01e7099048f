"""Files in and out: whole texts, JSON arrays, manifests, indexes kept as tables."""

from __future__ import annotations

import hashlib
import re
import time
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pa_fs
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: File that names the current version of a published table.
POINTER = "_current"
#: Bytes of a file held at a time.
READ = 1 << 23


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def whole_texts(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """(path, text): one row per UTF-8 file."""
    return spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def json_array(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Records of a JSON array, or of JSON lines, with an explicit schema."""
    return spark.read.schema(schema).json(path, multiLine=True)


def optional_json(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """``json_array``, empty where the file is missing."""
    return json_array(spark, path, schema) if exists(spark, path) else spark.createDataFrame([], schema)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def publish(df: DataFrame, path: str) -> None:
    """Parquet written as a new version under ``path``, then named current by replacing one small file in one step.

    Readers (``read_published``) see the old or the new table, never a part and never none, and so does whoever comes
    after a crash at any point. The version before stays for those still reading it; older ones are deleted.
    """
    spark = df.sparkSession
    version = f"v{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    df.write.parquet(f"{path}/{version}")
    jvm = spark._jvm
    fs, aside = _fs(spark, f"{path}/{POINTER}.{version}")
    out = fs.create(aside, True)
    out.write(version.encode())
    out.close()
    options = jvm.org.apache.hadoop.fs.Options.Rename
    chosen = spark.sparkContext._gateway.new_array(options, 1)
    chosen[0] = options.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    context.rename(fs.makeQualified(aside), fs.makeQualified(_fs(spark, f"{path}/{POINTER}")[1]), chosen)
    versions = sorted(n for n in (s.getPath().getName() for s in fs.listStatus(_fs(spark, path)[1])) if n.startswith("v") and n <= version)
    for old in versions[:-2]:
        fs.delete(_fs(spark, f"{path}/{old}")[1], True)


def published(spark: SparkSession, path: str) -> str:
    """Folder of the current version of a published table; FileNotFoundError where none is."""
    fs, pointer = _fs(spark, f"{path}/{POINTER}")
    if not fs.exists(pointer):
        raise FileNotFoundError(f"nothing is published at {path}")
    stream = fs.open(pointer)
    version = spark._jvm.java.util.Scanner(stream, "UTF-8").next()
    stream.close()
    return f"{path}/{version}"


def read_published(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(published(spark, path))


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of files read block by block, wherever they lie and however large they are."""
    for batch in batches:
        sums = []
        for path in batch.column(0).to_pylist():
            fs, inner = pa_fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))
            total = hashlib.sha256()
            with fs.open_input_stream(inner, compression=None) as stream:
                while block := stream.read(READ):
                    total.update(block)
            sums.append(total.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sums, pa.string()), batch.column(1)], names=["path", "sha256", "size_bytes"])


def file_manifest(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """(path, sha256, size_bytes) of files; contents are never held whole."""
    return spark.read.format("binaryFile").load(paths).select("path", "length").mapInArrow(_summed, "path string, sha256 string, size_bytes long")


def manifest_matches(recorded: DataFrame, current: DataFrame) -> bool:
    """Whether two manifests have the same files with the same sums."""
    r, c = recorded.select("path", F.col("sha256").alias("r")), current.select("path", F.col("sha256").alias("c"))
    return r.join(c, "path", "full").filter(~F.col("r").eqNullSafe(F.col("c"))).isEmpty()


def modified(spark: SparkSession, path: str) -> int:
    """Latest change of a file or folder, in milliseconds."""
    fs, p = _fs(spark, path)
    return max([fs.getFileStatus(p).getModificationTime(), *(s.getModificationTime() for s in (fs.listStatus(p) or []))])


def require_fresh(spark: SparkSession, derived: str, origin: str) -> None:
    """Raise where ``derived`` is older than what it was made from."""
    if exists(spark, derived) and modified(spark, derived) < modified(spark, origin):
        raise ValueError(f"{derived} is older than {origin}")


def write_index(chunks: DataFrame, path: str) -> None:
    """A lexical and dense index as tables: postings, lengths, vectors, statistics."""
    from lekhya.operators import dense, lexical

    publish(lexical.postings(chunks, "chunk_id", "text"), f"{path}/postings")
    publish(lexical.lengths(chunks, "chunk_id", "text"), f"{path}/lengths")
    publish(chunks.select("chunk_id", dense.hashed_vector(F.col("text")).alias("embedding")), f"{path}/vectors")
    publish(chunks.agg(F.count(F.lit(1)).alias("chunk_count"), F.bround(F.avg(F.length("text")), 2).alias("avg_chars"), F.current_timestamp().alias("built_at")), f"{path}/stats")


PARTS = ("postings", "lengths", "vectors", "stats")
#: What Spark calls a table that is not there or can't be read as one; any other error isn't the index's.
BROKEN = ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA", "CANNOT_READ_FILE_FOOTER", "is not a Parquet file")


def read_index(spark: SparkSession, path: str, chunks: DataFrame | None = None) -> dict[str, DataFrame]:
    """The tables of an index, rebuilt from ``chunks`` where one is missing or corrupt; other errors are raised."""
    try:
        return {p: read_published(spark, f"{path}/{p}") for p in PARTS}
    except (FileNotFoundError, PySparkException, Py4JJavaError) as e:
        broken = isinstance(e, FileNotFoundError) or any(b in str(e) for b in BROKEN)
        if chunks is None or not broken:
            raise
    write_index(chunks, path)
    return {p: read_published(spark, f"{path}/{p}") for p in PARTS}


def text_report(lines: DataFrame, path: str) -> None:
    """Lines (column ``line``) as one text file per partition, in order of ``line`` within."""
    lines.select("line").write.mode("overwrite").text(path)
