"""Writers of canonical records, evaluation results and run folders, and versions of an output.

An output that readers may hold is a folder of versions and a pointer. A writer fills a version of
its own, and the pointer is put in place last, by one rename: a writer that breaks off at any
point leaves the output as it was. The pointer names the version before it too, which stays for
readers under way; the one before that goes.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prefloom.schemas import RESULT

POINTER = "_current"


def _file_system(spark: SparkSession, path: str):
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop_path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that this package wrote."""
    fs, p = _file_system(spark, path)
    fs.delete(p, True)


def new_version(out: str) -> str:
    """A path below ``out`` that no writer has used."""
    return f"{out.rstrip('/')}/v-{uuid.uuid4().hex}"


def _pointed(spark: SparkSession, out: str) -> list[str]:
    """Names of the current version and the one before it; none if nothing was published."""
    fs, p = _file_system(spark, f"{out.rstrip('/')}/{POINTER}")
    if not fs.exists(p):
        return []
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").split()
    finally:
        stream.close()


def published(spark: SparkSession, out: str) -> str:
    """Path of the version that readers of ``out`` are to see; ``out`` itself if it has no pointer."""
    named = _pointed(spark, out)
    return f"{out.rstrip('/')}/{named[0]}" if named else out


def read_published(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(published(spark, out))


def commit(spark: SparkSession, out: str, version: str) -> None:
    """Make ``version``, a finished folder below ``out``, the one that readers see."""
    before = _pointed(spark, out)
    name = version.rstrip("/").rsplit("/", 1)[1]
    fs, fresh = _file_system(spark, f"{out.rstrip('/')}/{POINTER}-{name}")
    stream = fs.create(fresh, True)
    try:
        stream.write("\n".join([name, *before[:1]]).encode())
    finally:
        stream.close()
    _put(spark, fresh, f"{out.rstrip('/')}/{POINTER}")
    for old in before[1:]:
        remove(spark, f"{out.rstrip('/')}/{old}")


def _put(spark: SparkSession, fresh, place: str) -> None:
    """Rename one file over another; readers find the old or the new one, never none."""
    sc = spark.sparkContext
    fs = sc._jvm.org.apache.hadoop.fs
    kind = getattr(fs, "Options$Rename")
    how = sc._gateway.new_array(kind, 1)
    how[0] = kind.OVERWRITE
    _, target = _file_system(spark, place)
    context = fs.FileContext.getFileContext(fresh.getFileSystem(sc._jsc.hadoopConfiguration()).getUri(), sc._jsc.hadoopConfiguration())
    context.rename(fresh, target, how)


def _opener(root: str) -> Callable:
    """Opens files below ``root`` by name to write them, and makes their folders."""
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(root) if ":" in root else (fs.LocalFileSystem(), root)
    made = set()

    def opened(name: str):
        target = f"{base.rstrip('/')}/{name}"
        folder = target.rsplit("/", 1)[0]
        if folder not in made:
            store.create_dir(folder, recursive=True)
            made.add(folder)
        return store.open_output_stream(target)

    return opened


def write_files(df: DataFrame, root: str, path: str = "path", content: str = "content") -> None:
    """Each row as one file: ``content`` at ``path`` below ``root``, written by the tasks.

    A task that runs again writes the same files again. ``root`` is a folder that all executors
    reach, a local path or one of a store that Arrow knows (``file:``, ``hdfs:``, ``s3:``, ``gs:``).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, n = _opener(root), 0
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with opened(name) as out:
                    out.write(raw or b"")
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    rows = df.select(F.col(path).alias("path"), F.col(content).cast("binary").alias("content"))
    rows.mapInArrow(run, "n long").write.format("noop").mode("overwrite").save()


def write_pieces(df: DataFrame, root: str, order: list[str], path: str = "path", part: str = "part",
                 content: Column | str = "content", sep: str = ",") -> None:
    """Files from rows that each hold a piece of one, so that no cell or task holds a file.

    The rows of a ``path`` are put together by ``order``; those of one ``part`` are parted by ``sep``, and parts follow
    each other. Where a part is lower than the one before, the file is begun anew. ``root`` is as for :func:`write_files`.
    """
    mark = sep.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, out, at, n = _opener(root), None, None, 0
        try:
            for batch in batches:
                names, parts, raws = batch.columns
                same = pc.and_(pc.equal(names[1:], names[:-1]), pc.equal(parts[1:], parts[:-1]))
                starts = [0, *(np.flatnonzero(~same.to_numpy(zero_copy_only=False)) + 1).tolist()] if len(names) else []
                heads = zip(names.take(pa.array(starts, pa.int64())).to_pylist(), parts.take(pa.array(starts, pa.int64())).to_pylist())
                texts = raws.to_pylist()
                for (name, this), start, end in zip(heads, starts, [*starts[1:], len(texts)]):
                    if at is None or name != at[0] or this < at[1]:
                        if out is not None:
                            out.close()
                        out, n = opened(name), n + 1
                    elif this == at[1]:
                        out.write(mark)
                    out.write(mark.join([t or b"" for t in texts[start:end]]))
                    at = name, this
        finally:
            if out is not None:
                out.close()
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    # What a piece holds is worked out after the shuffle.
    dealt = df.where(F.col(path).isNotNull()).repartition(path).sortWithinPartitions(path, *order)
    rows = dealt.select(F.col(path).alias("path"), F.col(part).alias("part"),
                        (F.col(content) if isinstance(content, str) else content).cast("binary").alias("content"))
    rows.mapInArrow(run, "n long").write.format("noop").mode("overwrite").save()


def write_records(records: DataFrame, path: str) -> None:
    """Canonical records as Parquet."""
    records.write.mode("overwrite").parquet(path)


def _metrics(results: DataFrame):
    return F.struct(*[F.col(f) for f in RESULT.names if f in results.columns])


def keyed_lines(results: DataFrame) -> DataFrame:
    """One JSON object per run, keyed by its name; nulls are written."""
    keyed = F.create_map(F.col("run"), _metrics(results))
    return results.select("run", F.to_json(keyed, {"ignoreNullFields": "false"}).alias("value"))


def object_lines(results: DataFrame) -> DataFrame:
    """Lines ``ord, run, value`` of one JSON object keyed by run: a brace, a line per run, a brace."""
    last = results.agg(F.max("run")).scalar()
    entry = F.regexp_extract(F.to_json(F.create_map(F.col("run"), _metrics(results)), {"ignoreNullFields": "false"}), r"^\{(.*)\}$", 1)
    runs = results.select(F.lit(1).alias("ord"), "run", F.concat(
        entry, F.when(F.col("run") == last, "").otherwise(",")).alias("value"))
    braces = results.sparkSession.createDataFrame([(0, None, "{"), (2, None, "}")], "ord int, run string, value string")
    return runs.unionByName(braces)


def write_results(results: DataFrame, path: str, layout: str = "rows") -> None:
    """Results as Parquet ``rows``, as keyed ``lines``, or as one keyed ``object`` over all part files in order.

    Run names tell results apart.
    """
    if layout == "rows":
        results.write.mode("overwrite").parquet(path)
    elif layout == "lines":
        keyed_lines(results).orderBy("run").select("value").write.mode("overwrite").text(path)
    elif layout == "object":
        object_lines(results).orderBy("ord", "run").select("value").write.mode("overwrite").text(path)
    else:
        raise ValueError("layout must be rows, lines or object")
