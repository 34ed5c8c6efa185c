"""Reading raw datasets against their contracts, and writing intermediates."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brasstally.errors import ConfigError, IngestError
from brasstally.functions import fixed, money

FORMATS = ("csv", "json", "jsonl", "xlsx", "xls", "parquet")
#: Bad lines that an error names.
SHOWN = 5
# Keys of a JSON object that may hold its rows, first match first.
ROW_KEYS = ("data", "items", "records", "rows", "transactions", "accounts")
# Readings of dates besides the engine's own, first match first.
DATE_PATTERNS = ("yyyy-MM-dd'T'HH:mm:ssX", "yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd", "dd/MM/yyyy", "dd-MM-yyyy", "MMM d, yyyy")


@dataclass(frozen=True)
class Dataset:
    """What a dataset must have and how its columns are read."""

    name: str
    required: tuple[str, ...]
    dates: tuple[str, ...] = ()
    numbers: tuple[str, ...] = ()
    strings: tuple[str, ...] = ()
    key: str | None = None
    recursive: bool = True
    multi_file: bool = True


# The datasets' contracts.
DATASETS = {
    d.name: d
    for d in (
        Dataset("transactions", ("transaction_id", "account_id", "amount", "currency", "timestamp"), ("timestamp",), ("amount",), ("transaction_id", "account_id", "currency", "merchant", "category", "description"), "transaction_id"),
        Dataset("accounts", ("account_id", "account_name"), (), (), ("account_id", "account_name", "account_type", "currency"), "account_id"),
        Dataset("fees_and_limits", ("item_id", "item_type", "value"), (), ("value",), ("item_id", "item_type", "unit", "notes"), "item_id"),
        Dataset("products", ("product_id", "product_name"), (), (), ("product_id", "product_name", "product_type"), "product_id"),
        Dataset("metadata", ("key", "value"), (), (), ("key", "value", "source"), None),
    )
}


@dataclass(frozen=True)
class Source:
    """Where the datasets' folders are: a local root, or a bucket and prefix that are read as s3a://."""

    mode: str = "local"
    root: str = "data"
    bucket: str | None = None
    prefix: str = ""
    options: dict[str, str] = field(default_factory=dict)

    def path(self, dataset: str) -> str:
        mode = self.mode.strip().lower()
        if mode == "local":
            return f"{self.root.rstrip('/')}/{dataset}"
        if mode != "s3":
            raise ConfigError(f"mode must be local or s3: {self.mode!r}")
        if not self.bucket:
            raise ConfigError("mode s3 needs a bucket")
        return "s3a://" + "/".join(p.strip("/") for p in (self.bucket, self.prefix, dataset) if p.strip("/"))


def header(name: str) -> str:
    """The canonical form of a header: lower case, words joined by underscores, known variants by their column."""
    word = re.sub(r"_+", "_", re.sub(r"[ \-/]", "_", name.strip().lower()))
    word = re.sub(r"[^a-z0-9_]", "", word)
    return fixed.HEADER_ALIASES.get(word, word)


def with_headers(df: DataFrame) -> DataFrame:
    new = [c if c.startswith("_") else header(c) for c in df.columns]
    if repeated := sorted({c for c in new if new.count(c) > 1}):
        raise IngestError(f"several columns become {repeated}: {df.columns}")
    return df.toDF(*new)


def timestamp(c: Column) -> Column:
    """The first reading that works for this row, in UTC sessions; null where none does."""
    return F.coalesce(c.try_cast("timestamp"), *(F.try_to_timestamp(c.cast("string"), F.lit(p)) for p in DATE_PATTERNS))


def coerce(df: DataFrame, dataset: Dataset) -> DataFrame:
    readings = {c: timestamp(F.col(c)) for c in dataset.dates} | {c: money.number(F.col(c)) for c in dataset.numbers} | {c: F.col(c).cast("string") for c in dataset.strings}
    return df.withColumns({c: e for c, e in readings.items() if c in df.columns})


def check_required(df: DataFrame, dataset: Dataset) -> DataFrame:
    if missing := [c for c in dataset.required if c not in df.columns]:
        raise IngestError(f"{dataset.name} lacks {missing}; it has {sorted(df.columns)}")
    return df


def keep_first(df: DataFrame, key: str | list[str] | None, order: list[str | Column]) -> DataFrame:
    """The first row of each key by ``order``; null keys are one key. Without a key, or if ``df`` lacks it, nothing changes."""
    keys = [key] if isinstance(key, str) else list(key or ())
    if not keys or any(k not in df.columns for k in keys):
        return df
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def union_by_name(frames: Iterable[DataFrame]) -> DataFrame:
    """All rows, with nulls for the columns that a table lacks."""
    listed = list(frames)
    if not listed:
        raise IngestError("there are no tables")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), listed)


def _named(df: DataFrame) -> DataFrame:
    """Each row's file and place: where its part of the file begins, and its number, which grows within the part."""
    return df.select("*", F.col("_metadata.file_path").alias("_source_name"), _place(F.col("_metadata.file_block_start")))


def _place(start: Column) -> Column:
    return F.struct(start.cast("long").alias("start"), F.monotonically_increasing_id().alias("row")).alias("_ord")


def _json(spark: SparkSession, paths: list[str], options: dict[str, str]) -> DataFrame:
    """Files with a list of objects, an object with rows under one of ROW_KEYS, or one object.

    A file that goes on after its first value (JSON Lines under a wrong name) is an error, as the reader would leave out the rest in silence. All shapes are
    brought into one list of rows by an expression, so the rows are read in a single pass.
    """
    whole = spark.read.options(**options).text(paths, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    first, rest = F.regexp_extract("value", r"\A\s*+(\S[^\r\n]*+)", 1), F.regexp_extract("value", r"\A\s*+\S[^\r\n]*+\s*+(\S)", 1)
    if several := whole.where(F.try_parse_json(first).isNotNull() & (rest != "")).select("path").take(5):
        raise IngestError(f"not one JSON value but lines of them: {[r['path'] for r in several]}")
    df = spark.read.options(**options).json(paths, multiLine=True, mode="FAILFAST")
    types = {f.name: f.dataType for f in df.schema.fields}
    listed = [k for k in ROW_KEYS if isinstance(types.get(k), T.ArrayType)]
    if not listed:
        return _named(df)
    nested = [k for k in listed if isinstance(types[k].elementType, T.StructType)]
    # rows under a key and rows of their own become structs of all columns, those that are missing null; a column of two types is text
    own = {c: types[c] for c in df.columns if c not in nested}
    shapes = [{f.name: f.dataType for f in types[k].elementType.fields} for k in nested] + [own] * bool(own)
    names = list(dict.fromkeys(c for shape in shapes for c in shape))
    kinds = {c: found.pop() if len(found := {shape[c] for shape in shapes if c in shape}) == 1 else T.StringType() for c in names}
    row = lambda shape, get: F.struct(*((get(c) if c in shape else F.lit(None)).cast(kinds[c]).alias(c) for c in names))
    made = lambda k, shape: F.transform(k, lambda r: row(shape, lambda c: r[c]))
    none = F.slice(F.array(row({}, None)), 1, 0)
    rows = F.when(F.lit(False), none)
    for k in listed:
        # an empty list has no rows, whatever its type; a list of plain values is a column
        rows = rows.when(F.col(k).isNotNull(), made(k, shapes[nested.index(k)])) if k in nested else rows.when(F.size(k) == 0, none)
    if own:
        rows = rows.otherwise(F.array(row(own, F.col)))
    return df.select(F.explode(rows).alias("r"), F.col("_metadata.file_path").alias("_source_name")).select("r.*", "_source_name").select("*", _place(F.lit(0)))


def bad_lines(spark: SparkSession, paths: list[str], options: dict[str, str]) -> DataFrame:
    """path, line (from 1) and content of the lines that aren't JSON objects; blank ones don't count.

    A file may be split among tasks. Within a split rows are numbered as they are read, and splits before it add their lines, so a line's number needs no file in one place."""
    lines = spark.read.options(**options).text(paths).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id"))
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    splits = lines.groupBy("path", "start").agg(F.min("id").alias("first"), F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    whole = F.coalesce(F.schema_of_variant(F.try_parse_json("value")).startswith("OBJECT"), F.lit(False))
    bad = lines.where((F.trim("value") != "") & ~whole)
    return bad.join(splits, ["path", "start"]).select("path", (F.col("before") + F.col("id") - F.col("first") + 1).alias("line"), F.col("value").alias("content"))


def _json_lines(spark: SparkSession, paths: list[str], options: dict[str, str]) -> DataFrame:
    """One object a line. A bad line is an error that names file and line; only then are lines looked at one by one."""
    try:
        return _named(spark.read.options(**options).json(paths, mode="FAILFAST"))
    except Exception as e:  # the reader has errors of several kinds
        found = bad_lines(spark, paths, options).orderBy("path", "line").limit(SHOWN).collect()
        if not found:
            raise
        raise IngestError("lines that aren't JSON objects: " + "; ".join(f"{r['path']}, line {r['line']}: {r['content'][:80]}" for r in found)) from e


def _excel(spark: SparkSession, paths: list[str]) -> DataFrame:
    try:
        import openpyxl  # noqa: F401
    except ImportError as e:
        raise IngestError("Excel files need the package openpyxl, which isn't installed") from e
    import io

    import pandas as pd

    files = spark.read.format("binaryFile").load(paths)

    def headers(batches):
        for batch in batches:
            yield pd.DataFrame({"name": [str(c) for content in batch["content"] for c in pd.read_excel(io.BytesIO(content), nrows=0).columns]})

    # only the names of columns come here, those of the first file first
    names = list(dict.fromkeys(r["name"] for r in files.select("content").mapInPandas(headers, "name string").collect()))
    schema = T.StructType([*(T.StructField(c, T.StringType()) for c in names), T.StructField("_source_name", T.StringType()), T.StructField("_ord", T.LongType())])

    def read(batches):
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                rows = pd.read_excel(io.BytesIO(content), dtype=str)
                yield rows.set_axis([str(c) for c in rows.columns], axis=1).reindex(columns=names).assign(_source_name=path, _ord=range(len(rows)))

    return files.select("path", "content").mapInPandas(read, schema).withColumn("_ord", F.struct(F.lit(0).cast("long").alias("start"), F.col("_ord").alias("row")))


def read_files(spark: SparkSession, paths: str | list[str], fmt: str, recursive: bool = True, options: dict[str, str] | None = None) -> DataFrame:
    """All files of one format under the paths, each row with _source_name (its file) and _ord (its place).

    CSV columns are read as strings, so that leading zeros stay. Quoted CSV fields may hold line breaks, which keeps a file from being split among tasks;
    the option multiLine=false splits files that have none.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    opts = {"recursiveFileLookup": str(recursive).lower(), "pathGlobFilter": _glob(fmt)} if not any(_format(p) == fmt for p in paths) else {}
    opts |= options or {}
    if fmt == "csv":
        return _named(spark.read.options(**opts).csv(paths, header=True, inferSchema=False, encoding="UTF-8", escape='"', multiLine=str(opts.get("multiLine", "true")).lower() == "true"))
    if fmt == "jsonl":
        return _json_lines(spark, paths, opts)
    if fmt == "json":
        return _json(spark, paths, opts)
    if fmt == "parquet":
        return _named(spark.read.options(**opts).parquet(*paths))
    if fmt in ("xlsx", "xls"):
        return _excel(spark, paths)
    raise IngestError(f"unknown format {fmt!r}; known are {FORMATS}")


def _format(path: str) -> str:
    """A file's extension in lower case; files in a folder that is named as a JSON Lines file, as ``write_tables`` leaves them, are of that format."""
    folder, _, name = path.lower().rstrip("/").rpartition("/")
    return "jsonl" if folder.endswith(".jsonl") else name.rpartition(".")[2]


def _glob(*formats: str) -> str:
    """A pattern for files with one of these extensions in any case."""
    any_case = ("".join(f"[{c}{c.upper()}]" for c in f) for f in formats)
    return "*.{" + ",".join(any_case) + "}"


def file_table(spark: SparkSession, path: str, recursive: bool = True, formats: tuple[str, ...] = FORMATS) -> DataFrame:
    """path, format, bytes and changed of the supported files below a folder, as a table; no content is read.

    A file's format is its extension in lower case; files in a folder that is named as a JSON Lines file are of that format (column ``by_folder``)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", _glob(*formats)).load(path)
    low = F.split(F.lower("path"), "/")
    by_folder = F.element_at(low, -2).endswith(".jsonl")
    kind = F.when(by_folder, "jsonl").otherwise(F.element_at(F.split(F.element_at(low, -1), r"\."), -1))
    return files.select("path", kind.alias("format"), F.col("length").alias("bytes"), F.col("modificationTime").alias("changed"), by_folder.alias("by_folder"))


#: The order of files: whose row of a repeated key stays, and which is the first.
FILE_ORDER = (F.lower, F.col)


def list_files(spark: SparkSession, path: str, recursive: bool = True, formats: tuple[str, ...] = FORMATS) -> list[str]:
    """Paths of the supported files below a folder, by lower-case path, through the file system that the path names."""
    return [r["path"] for r in file_table(spark, path, recursive, formats).select("path").orderBy(*(f("path") for f in FILE_ORDER)).collect()]


def load(spark: SparkSession, dataset: Dataset | str, source: Source) -> DataFrame:
    """One dataset, canonical: renamed, coerced, checked and without repeated keys (the first in the order of files stays).

    Files are counted by format, and each format is read from the folder by its extension, so no list of paths comes here; only where JSON Lines
    stand in folders named so, which no extension tells from JSON, the paths of these two formats do.
    """
    spec = DATASETS[dataset] if isinstance(dataset, str) else dataset
    folder = source.path(spec.name)
    files = file_table(spark, folder, spec.recursive)
    if not spec.multi_file:
        files = files.orderBy(*(f("path") for f in FILE_ORDER)).limit(1)
    found = {r["format"]: r["by_folder"] for r in files.groupBy("format").agg(F.max("by_folder").alias("by_folder")).collect()}
    if not found:
        raise IngestError(f"{folder} holds no file of a known format")

    def paths(fmt: str) -> str | list[str]:
        listed = not spec.multi_file or any(found.values()) and fmt in ("json", "jsonl")
        return [r["path"] for r in files.where(F.col("format") == fmt).select("path").collect()] if listed else folder

    frames = [coerce(with_headers(read_files(spark, paths(f), f, spec.recursive, source.options)), spec) for f in FORMATS if f in found]
    df = check_required(union_by_name(frames), spec)
    return keep_first(df, spec.key, [*(f("_source_name") for f in FILE_ORDER), "_ord"])


def load_bundle(spark: SparkSession, source: Source, strict: bool = True) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """All datasets that can be loaded, and why others can't; with ``strict`` the first failure is raised."""
    found, failed = {}, {}
    for name, spec in DATASETS.items():
        try:
            found[name] = load(spark, spec, source)
        except Exception as e:
            if strict:
                raise
            failed[name] = str(e)
    return found, failed


def write_tables(tables: dict[str, DataFrame], folder: str, fmt: str = "parquet") -> dict[str, str]:
    """Each table as <folder>/<name>.<fmt>, replacing what is there."""
    if fmt not in ("parquet", "csv", "jsonl"):
        raise IngestError(f"can't write {fmt!r}; known are parquet, csv, jsonl")
    out = {}
    for name, df in tables.items():
        out[name] = f"{folder.rstrip('/')}/{name}.{fmt}"
        writer = df.write.mode("overwrite")
        if fmt == "csv":
            writer.option("header", True).csv(out[name])
        elif fmt == "jsonl":
            writer.json(out[name])
        else:
            writer.parquet(out[name])
    return out
