"""Scans: Parquet, JSON and named splits, pasted JSON texts, run folders, result files."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from prefloom.functions import json as J
from prefloom.functions import text as X
from prefloom.operators import catalog
from prefloom.schemas import MESSAGES, RESULT, TRAINER_STATE
from prefloom.session import stored
from prefloom.sources.states import log_slices

# A JSON string, or what is left of a broken one; with it a bracket, a comma, or what lies between them.
_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"?'
_MARKS = _STRING + r'|[\[\]{},]|[^"\[\]{},]++'

# Layout only: a folder of more files than this is listed and read by tasks, not through the driver.
LISTED_FILES = 1_000
# Layout only: a trainer state of more bytes than this is parsed in slices of about as many.
SLICE_BYTES = 1 << 20

_FORMATS = {".json": "json", ".jsonl": "json", ".parquet": "parquet"}


def named_split(spark: SparkSession, table: str, split: str | None = None) -> DataFrame:
    """Rows of a table, or of one split of it (a partition column, so others are not read)."""
    df = spark.table(table)
    return df if split is None else df.where(F.col("split") == split)


def read_splits(df: DataFrame, split: str, eval_split: str | None = None,
                column: str = "split") -> tuple[DataFrame, DataFrame | None]:
    """Training rows and, when asked for, evaluation rows of a frame with a split column."""
    pick = lambda name: df.where(F.col(column) == name).drop(column)
    return pick(split), pick(eval_split) if eval_split else None


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop_path


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _file_system(spark, path)
    return fs.exists(p)


def _suffix(name: str) -> str:
    dot = name.rfind(".")
    return name[dot:].lower() if dot > 0 else ""


def data_files(spark: SparkSession, path: str) -> tuple[str, list[str]]:
    """Format and files of a path. In a folder, JSON files win over Parquet ones."""
    fs, p = _file_system(spark, path)
    if not fs.exists(p):
        raise FileNotFoundError(f"no such path: {path}")
    if not fs.getFileStatus(p).isDirectory():
        suffix = _suffix(p.getName())
        if suffix not in _FORMATS:
            raise ValueError(f"unsupported file type: {suffix or path}")
        return _FORMATS[suffix], [path]
    by_format: dict[str, list[str]] = {}
    for status in fs.listStatus(p):
        name = status.getPath().getName()
        fmt = _FORMATS.get(_suffix(name))
        if fmt and not name.startswith((".", "_")):
            by_format.setdefault(fmt, []).append(status.getPath().toString())
    for fmt in ("json", "parquet"):
        if fmt in by_format:
            return fmt, sorted(by_format[fmt])
    raise FileNotFoundError(f"no json, jsonl or parquet file in {path}")


def read_path(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
              array_files: bool = False) -> DataFrame:
    """Training rows of a file or folder, by suffix.

    JSON is read as lines in splits; ``array_files`` reads files that hold one JSON
    array or object over several lines. Give a ``schema`` to spare JSON the inference pass.
    """
    fmt, files = data_files(spark, path)
    reader = spark.read if schema is None else spark.read.schema(schema)
    if fmt == "parquet":
        return reader.parquet(*files)
    return reader.option("multiLine", array_files).json(files)


def read_folder(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Rows of a file, or of all files of one format in a folder and the folders in it.

    Folders named ``column=value`` give a column, by which a scan leaves files out. As in
    :func:`data_files`, JSON lines win over Parquet.
    """
    fs, p = _file_system(spark, path)
    if not fs.exists(p):
        raise FileNotFoundError(f"no such path: {path}")
    if not fs.getFileStatus(p).isDirectory():
        return read_path(spark, path, schema)
    found, files = set(), fs.listFiles(p, True)
    while files.hasNext() and "json" not in found:
        file = files.next().getPath()
        parts = file.toString()[len(p.toString()):].split("/")
        if not any(part.startswith((".", "_")) for part in parts):
            found.add(_FORMATS.get(_suffix(file.getName())))
    fmt = next((f for f in ("json", "parquet") if f in found), None)
    if fmt is None:
        raise FileNotFoundError(f"no json, jsonl or parquet file in {path}")
    reader = spark.read if schema is None else spark.read.schema(schema)
    patterns = [suffix for suffix, f in _FORMATS.items() if f == fmt]
    return reader.format(fmt).option("pathGlobFilter", f"*{{{','.join(patterns)}}}").load(path)


def read_texts(spark: SparkSession, path: str, layout: str = "value") -> DataFrame:
    """Pasted-JSON files as ``(path, text)``.

    With the layout ``value`` a file is one text, which may span lines and is one cell; with
    ``lines`` each line is one, and large files are read in splits. A layout means the same at any size.
    """
    if layout not in ("value", "lines"):
        raise ValueError("layout must be 'value' or 'lines'")
    reader = spark.read.option("recursiveFileLookup", True)
    return reader.text(path, wholetext=layout == "value").select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def array_items(spark: SparkSession, path: str) -> DataFrame:
    """Items of files that each hold one JSON array over many lines: ``path, item_pos, text``, read in splits.

    A JSON string has no line break, so a line starts outside of strings, and the depth at its start is the
    sum of the brackets before it: summed within a split of a file, and over the splits before. Commas at
    depth 1 part the items; lines that stay below it are kept whole. Only the first and the last piece of a
    split can go on in another, and are put together at the end; no other text leaves its split. One line and
    one item are a cell each. A file that is no array of balanced brackets fails; items are not parsed here.
    """
    value = F.concat("value", F.lit("\n"))
    bare = F.regexp_replace(value, _STRING, "")
    count = lambda letters: F.length(bare) - F.length(F.translate(bare, letters, ""))
    split = ["path", "block"]
    # A split's lines are one task's, as they are in the scan.
    lines = spark.read.option("recursiveFileLookup", True).text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"), value.alias("value"),
        count("[{").alias("opened"), count("]}").alias("closed")).repartition(*split)
    ahead = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("path")
    depths = lines.groupBy(*split).agg(F.sum(F.col("opened") - F.col("closed")).alias("steps")).select(
        *split, F.coalesce(F.sum("steps").over(ahead), F.lit(0)).alias("before"),
        (F.sum("steps").over(whole) != 0).alias("left_open"))

    by_line = Window.partitionBy(*split).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    net = F.col("opened") - F.col("closed")
    at_start = F.col("before") + F.sum(net).over(by_line) - net
    placed = lines.join(depths, split).withColumn("inner", at_start - F.col("closed") > 1)
    parts = F.when(F.col("inner"), F.array("value")).otherwise(F.regexp_extract_all("value", F.lit(_MARKS), 0))
    marks = placed.select(*split, "line", "before", "left_open", "inner", net.alias("net"), F.posexplode(parts).alias("pos", "mark"))
    step = F.when(F.col("inner"), F.col("net")).when(F.col("mark").isin("[", "{"), 1).when(
        F.col("mark").isin("]", "}"), -1).otherwise(0)
    so_far = Window.partitionBy(*split).orderBy("line", "pos").rowsBetween(Window.unboundedPreceding, 0)
    deep = marks.withColumn("depth", F.col("before") + F.sum(step).over(so_far))
    edge = ((F.col("mark") == "[") & (F.col("depth") == 1)) | ((F.col("mark") == "]") & (F.col("depth") == 0))
    comma = (F.col("mark") == ",") & (F.col("depth") == 1)
    outside = (F.col("depth") == 0) & ~edge & (F.trim(F.translate("mark", "\t\r\n", "   ")) != "")
    numbered = deep.withColumn("local", F.sum(comma.cast("long")).over(so_far))
    text = F.when(~edge & ~comma, F.struct("line", "pos", "mark"))
    pieces = stored(numbered.groupBy(*split, "local").agg(
        F.array_sort(F.collect_list(text)).alias("marks"), F.count_if(edge).alias("edges"),
        F.bool_or((F.col("depth") < 0) | F.col("left_open") | outside).alias("stray")).select(
        *split, "local", F.array_join("marks.mark", "").alias("text"), "edges", "stray"), "array-items")

    counts = pieces.groupBy(*split).agg(
        F.max("local").alias("commas"), F.sum("edges").alias("edges"), F.bool_or("stray").alias("stray"))
    # A row per split; written, so that the join knows its size and leaves the texts in place where that is small.
    places = stored(counts.select(
        *split, "commas", F.coalesce(F.sum("commas").over(ahead), F.lit(0)).alias("first"), F.sum("commas").over(whole).alias("last"),
        (F.bool_or("stray").over(whole) | (F.sum("edges").over(whole) != 2)).alias("broken")), "array-places")
    found = pieces.join(places, split).select(
        "path", "block", (F.col("first") + F.col("local")).alias("item_pos"), "text", "last", "broken",
        F.col("local").between(1, F.col("commas") - 1).alias("complete"))
    parted = found.where(~F.col("complete")).groupBy("path", "item_pos").agg(
        F.array_sort(F.collect_list(F.struct("block", "text"))).alias("parts"), F.max("last").alias("last"),
        F.bool_or("broken").alias("broken")).select("path", "item_pos", F.array_join("parts.text", "").alias("text"), "last", "broken")
    items = found.where("complete").select(parted.columns).unionByName(parted)
    checked = F.when(F.col("broken"), F.raise_error(F.concat(F.lit("not one JSON array: "), "path")).cast("string")).otherwise(
        X.strip(F.col("text")))
    # An empty array has one place without a text; elsewhere a place without one is kept, as a broken item.
    return items.select("path", "item_pos", checked.alias("text"), "last").where(
        (F.col("text") != "") | (F.col("last") > 0)).drop("last")


def strict_list(df: DataFrame, text: str = "text") -> DataFrame:
    """Texts that must each be one JSON list, as one variant ``item`` per row; fails on others."""
    parsed = df.withColumn("_v", J.parse_strict(F.col(text)))
    good = F.col("_v").isNotNull() & J.is_array(F.col("_v"))
    items = F.when(good, F.col("_v").cast("array<variant>")).otherwise(
        F.raise_error(F.lit("training data must be a JSON list")).cast("array<variant>"))
    return parsed.select(*[c for c in df.columns if c != text], F.posexplode(items).alias("item_pos", "item"))


def parse_messages(text) -> F.Column:
    """A JSON message list literal as messages; null when it is not one."""
    return F.from_json(text, MESSAGES.simpleString())


# --------------------------------------------------------------------- runs

def _run_root(spark: SparkSession, runs_dir: str) -> str:
    """The folder as Spark names it in a file's path."""
    fs, p = _file_system(spark, runs_dir)
    plain = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p.toUri().normalize())
    return fs.makeQualified(plain).toString().rstrip("/")


def _below(root: str) -> tuple[F.Column, F.Column, F.Column]:
    """Run and path within the run of a file ``path`` below ``root``, and whether it lies in a run."""
    rest = F.substring("path", len(root) + 2, 1 << 30)
    inside = F.startswith("path", F.lit(root + "/")) & F.contains(rest, F.lit("/"))
    return (F.substring_index(rest, "/", 1).alias("run"), F.regexp_replace(rest, r"^[^/]*/", "").alias("rel_path"), inside)


def _arrow_store(root: str):
    """The store of ``root`` as Arrow opens it, and the folder's path there."""
    from pyarrow import fs

    if root.startswith("file:"):
        return fs.LocalFileSystem(), "/" + root[len("file:"):].lstrip("/")
    return fs.FileSystem.from_uri(quote(root, safe=":/@"))


def _by_tasks(spark: SparkSession, runs_dir: str) -> bool:
    """Whether a folder holds more than LISTED_FILES files, in a store that Arrow opens too."""
    fs, p = _file_system(spark, runs_dir)
    found, n = fs.listFiles(p, True), 0
    while n <= LISTED_FILES and found.hasNext():
        found.next()
        n += 1
    return n > LISTED_FILES and _opened_by_arrow(_run_root(spark, runs_dir))


def _opened_by_arrow(root: str) -> bool:
    try:
        _arrow_store(root)
    except (pa.ArrowException, OSError):
        return False
    return True


def _hidden(name: str) -> bool:
    """Whether Spark's own listing passes a file or folder of this name over."""
    if name.startswith(("_metadata", "_common_metadata")):
        return False
    return (name.startswith("_") and "=" not in name) or name.startswith(".") or name.endswith("._COPYING_")


def _list_runs(root: str) -> Callable:
    """The names of the folders in ``root``, for one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for _ in batches:
            store, base = _arrow_store(root)
            names = (i.base_name for i in store.get_file_info(fs.FileSelector(base)) if i.type == fs.FileType.Directory)
            yield pa.RecordBatch.from_arrays([pa.array([n for n in names if not _hidden(n)], pa.string())], ["run"])

    return run


def _list_files(root: str) -> Callable:
    """The files of each run of a batch: ``run, rel_path, bytes, millis, path``."""
    names = ["run", "rel_path", "bytes", "millis", "path"]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = _arrow_store(root)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                folder, rows = f"{base.rstrip('/')}/{name}", []
                for info in store.get_file_info(fs.FileSelector(folder, recursive=True)):
                    rel = info.path[len(folder) + 1:]
                    # Spark's scan gives no row for an empty file.
                    if info.type == fs.FileType.File and info.size and not any(map(_hidden, rel.split("/"))):
                        rows.append((name, rel, info.size, info.mtime_ns // 1_000_000, f"{root}/{name}/{rel}"))
                columns = zip(*rows) if rows else [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return run


def _read_files(root: str, most: int) -> Callable:
    """``run, first, content`` of each trainer state of a batch ``run, rel_path``: whole up to ``most`` bytes, else its slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _arrow_store(root)
        row = lambda *cells: pa.RecordBatch.from_arrays(
            [pa.array([c], k) for c, k in zip(cells, (pa.string(), pa.int64(), pa.binary()))], ["run", "first", "content"])
        for batch in batches:
            for name, rel in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                path = f"{base.rstrip('/')}/{name}/{rel}"
                if store.get_file_info(path).size > most:
                    with store.open_input_file(path) as file:
                        if slices := log_slices(file, most):
                            for first, text in slices.texts(file):
                                yield row(name, first, text)
                            continue
                with store.open_input_stream(path) as file:
                    yield row(name, 0, file.read())

    return run


def _dealt(df: DataFrame) -> DataFrame:
    """Rows over all tasks, as many as a shuffle has; names are small, but what they stand for is not."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def run_files(spark: SparkSession, runs_dir: str) -> DataFrame:
    """Every file below the runs folder as ``(run, rel_path, bytes, modified, path)``; no content is read.

    Spark's own listing is held by the driver. With more than LISTED_FILES files one task names the
    runs and others list them, a run each, so that no file's row is gathered; the rows are the same.
    """
    if not path_exists(spark, runs_dir):
        return spark.createDataFrame([], "run string, rel_path string, bytes bigint, modified timestamp, path string")
    root = _run_root(spark, runs_dir)
    if _by_tasks(spark, runs_dir):
        runs = spark.range(1, numPartitions=1).mapInArrow(_list_runs(root), "run string")
        found = _dealt(runs).mapInArrow(_list_files(root), "run string, rel_path string, bytes bigint, millis bigint, path string")
        return found.select("run", "rel_path", "bytes", F.timestamp_millis("millis").alias("modified"), "path")
    run, rel_path, inside = _below(root)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(runs_dir)
    return found.where(inside).select(
        run, rel_path, F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"), "path")


def trainer_states(spark: SparkSession, runs_dir: str, order: str = "numeric",
                   files: DataFrame | None = None) -> DataFrame:
    """Parsed trainer state per run: the root's file, else the last checkpoint's.

    A state of more than SLICE_BYTES has a row per slice of its log, so that no cell holds it: ``first`` is the number of the
    slice's first entry, and the row where it is 0 has the state's other fields.

    The listing (``files``, or a fresh one) says which file of each run is read, and
    the second scan opens those alone. In a folder of more than LISTED_FILES files the tasks open
    them; else their paths pass the driver, as the listing does, and tasks open the large ones. A store
    that Arrow does not open gives whole states.
    """
    listed = run_files(spark, runs_dir) if files is None else files
    root = _run_root(spark, runs_dir)
    parsed = lambda texts: texts.select(
        "run", "first", F.from_json(F.col("content").cast("string"), TRAINER_STATE).alias("s")).select("run", "first", "s.*")
    by_tasks = lambda states: parsed(
        states.mapInArrow(_read_files(root, SLICE_BYTES), "run string, first bigint, content binary"))
    if path_exists(spark, runs_dir) and _by_tasks(spark, runs_dir):
        return by_tasks(_dealt(catalog.pick_state_file(listed.select("run", "rel_path"), order).select("run", "rel_path")))
    picked = catalog.pick_state_file(listed.select("run", "rel_path", "bytes", "path"), order).collect()
    large = [r for r in picked if r.bytes > SLICE_BYTES] if _opened_by_arrow(root) else []
    paths = [_literal(r.path) for r in picked if r not in large]
    run, _, _ = _below(root)
    parts = []
    if paths:
        parts.append(parsed(spark.read.format("binaryFile").load(paths).select(run, F.lit(0).cast("bigint").alias("first"), "content")))
    if large:
        names = spark.createDataFrame([(r.run, r.rel_path) for r in large], "run string, rel_path string")
        parts.append(by_tasks(names.repartition(len(large))))
    if not parts:
        first = T.StructField("first", T.LongType())
        return spark.createDataFrame([], T.StructType([T.StructField("run", T.StringType()), first, *TRAINER_STATE.fields]))
    return reduce(DataFrame.unionByName, parts)


def _literal(path: str) -> str:
    """``path`` for a reader that takes patterns."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", path)


# ------------------------------------------------------------------ results

def parse_results(texts: DataFrame, column: str = "value") -> DataFrame:
    """Texts that are JSON objects keyed by run, as one row per run."""
    by_run = F.from_json(F.col(column), f"map<string, {RESULT.simpleString()}>")
    return texts.select(F.explode(by_run).alias("run", "r")).select("run", "r.*")


def read_results(spark: SparkSession, path: str, layout: str = "value") -> tuple[DataFrame | None, str]:
    """Results and a message; a missing or unreadable file is reported, not raised.

    ``value``: a file is one JSON object keyed by run, in one cell. ``lines``: a line is one. ``object``:
    the writer's object, whose braces and runs each have a line; read in splits like lines.
    """
    if layout not in ("value", "lines", "object"):
        raise ValueError("layout must be value, lines or object")
    if not path_exists(spark, path):
        return None, f"not found: {path}"
    texts = spark.read.text(path, wholetext=layout == "value").where(F.trim("value") != "")
    if layout == "object":
        entry = F.regexp_replace(X.strip(F.col("value")), ",$", "")
        texts = texts.where(~X.strip(F.col("value")).isin("{", "}")).select(
            F.concat(F.lit("{"), entry, F.lit("}")).alias("value"))
    runs = F.coalesce(F.size(F.from_json("value", "map<string, string>")), F.lit(0))
    broken, n = texts.agg(F.count_if(J.parse_strict(F.col("value")).isNull()), F.sum(runs)).first()
    if broken:
        return None, f"could not read {path}: not JSON"
    return parse_results(texts), f"loaded {path} ({n or 0} entries)"
