"""Flow tables: CSV in, Parquet in and out, JSON messages out."""

from __future__ import annotations

import csv
import logging
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from flowlens.functions.numeric import quoted
from flowlens.functions.hashing import row_key
from flowlens.schemas import CIC_2018_DROP, CSV_FILES, csv_schema
from flowlens.sources.storage import files_of, first_line, matching, side_by_side

log = logging.getLogger(__name__)


def _present(spark: SparkSession, paths) -> list[str]:
    """All data files of the paths that exist."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    found = []
    for path in dict.fromkeys(paths):
        files = files_of(spark, path)
        if not files:
            log.warning("no such file, skipped: %s", path)
        found += files
    if not found:
        raise FileNotFoundError(f"none of the {len(paths)} input files exist")
    return list(dict.fromkeys(found))


def _column_names(line: str) -> tuple[str, ...]:
    """Column names of a header line. A repeated name becomes ``name.1``, ``name.2`` in order, a missing one
    ``_c`` and its position."""
    names, seen = [], {}
    for n, name in enumerate(next(csv.reader([line.removeprefix("\ufeff")]))):
        name = name.strip() or f"_c{n}"
        again = seen.get(name.lower(), 0)
        seen[name.lower()] = again + 1
        names.append(f"{name}.{again}" if again else name)
    return tuple(names)


def _headers(spark: SparkSession, files: list[str]) -> list[tuple[str, list[str]]]:
    """Distinct first lines with their files, in the order of ``files``; empty files have none.

    No Spark job reads a first line alone: Python functions of partitions are given all rows of a task, so a
    scan would pass over all data. The file system is asked for the start of each listed file instead.
    """
    groups: dict[str, list[str]] = {}
    for path, line in zip(files, side_by_side(lambda path: first_line(spark, path), files)):
        if line is not None:
            groups.setdefault(line, []).append(path)
    return list(groups.items())


#: Decimal numbers and the names of non-finite ones, as texts; Spark's cast would also take suffixes like 12d.
NUMBER = r"^[+-]?(([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?|NaN|Infinity)$"


def _typed(df: DataFrame, unknown: list[str]) -> DataFrame:
    """Columns outside the schema as longs or doubles where no value loses anything; one aggregate finds out.

    A long is the same text again when it is written; a double has neither leading zeros, nor more than 17
    digits, nor a whole part beyond 2^53. Columns with another value stay text.
    """
    unknown = [c for c in unknown if c in df.columns]
    if not unknown:
        return df

    def text(name):
        return F.trim(quoted(name))

    def long(name):  # a failing cast costs some ten microseconds, a pattern less than one
        return F.when(text(name).rlike("^[+-]?[0-9]{1,19}$"), text(name).try_cast("bigint"))

    def exact_long(name):
        return F.coalesce(long(name).cast("string") == text(name), F.lit(False))

    def exact_double(name):
        whole = F.coalesce(long(name).between(-2**53, 2**53), F.lit(True))
        digits = F.regexp_replace(F.regexp_replace(text(name), "[eE].*$|[^0-9]", ""), "^0+", "")
        # Most values are the same text again, and so short enough.
        short = (text(name).try_cast("double").cast("string") == text(name)) | (F.length(digits) <= 17)
        return F.when(exact_long(name), whole).otherwise(
            text(name).rlike(NUMBER) & ~text(name).rlike("^[+-]?0[0-9]") & short & (whole | text(name).contains(".")))

    checks = [F.struct(F.count(quoted(c)).alias("n"), F.count_if(exact_long(c)).alias("longs"),
                       F.count_if(exact_double(c)).alias("doubles")).alias(f"_{i}") for i, c in enumerate(unknown)]
    counted = dict(zip(unknown, df.agg(*checks).first()))

    def column(name):
        r = counted.get(name)
        if r is None or not r["n"] or r["n"] not in (r["longs"], r["doubles"]):
            return quoted(name)
        return text(name).try_cast("bigint" if r["n"] == r["longs"] else "double").alias(name)

    return df.select(*[column(c) for c in df.columns])


#: Columns that carry a malformed line and its file through a scan.
LINE, FILE = "_malformed_line", "_malformed_file"


def _scans(spark: SparkSession, paths, schema: T.StructType, header: bool, checked: bool):
    """Scans of the files that share a header, and the names of columns outside ``schema``."""
    found = _present(spark, paths)
    by_header: dict[tuple[str, ...], list[str]] = {}
    for line, files in _headers(spark, found):
        names = _column_names(line)
        by_header.setdefault(names if header else (str(len(names)),), []).extend(files)
    types = {f.name.strip().lower(): f for f in schema.fields}
    scans, unknown = [], {}
    for names, group in by_header.items():
        if header:
            fields = []
            for name in names:
                known = types.get(name.lower())
                if known is None:  # other files may spell it in other letters
                    known = T.StructField(unknown.setdefault(name.lower(), name), T.StringType(), True)
                fields.append(T.StructField(known.name, known.dataType, True))
            file_schema = T.StructType(fields)
        elif checked or names == (str(len(schema.fields)),):
            file_schema = schema  # the first line may be a malformed one
        else:
            raise ValueError(f"{group[0]} has {names[0]} columns, expected {len(schema.fields)}")
        reader = spark.read.option("header", header)
        if checked:
            reader = reader.option("columnNameOfCorruptRecord", LINE).option("columnPruning", False)
            scans.append(reader.schema(T.StructType([*file_schema.fields, T.StructField(LINE, T.StringType())])).csv(group)
                         .withColumn(FILE, F.col("_metadata.file_path"))
                         # A scan converts the columns that a query uses, so the line uses all of them, and none of
                         # their letters; every query then sees the same lines as malformed.
                         .withColumn(LINE, F.concat(LINE, F.substring(F.concat_ws(
                             "", *[quoted(c).cast("string") for c in file_schema.names]), 1, 0))))
        else:
            scans.append(reader.schema(file_schema).csv(group))
    return scans, list(unknown.values())


def read_flow_csv(spark: SparkSession, paths, schema: T.StructType, header: bool = True,
                  drop=()) -> DataFrame:
    """Read many CSV files with explicit types; missing files are skipped with a warning.

    A path is a file, a folder or a pattern. Without a header the columns are taken by
    position and their number must match. With one they are taken by name, file by file:
    files that share a header form one scan, and scans with other headers are united by
    name, absent columns being null. Repeated names become ``name.1``, ``name.2``. Columns
    outside ``schema`` are kept, as longs or doubles if no value loses anything by it.
    ``drop`` names columns to leave out. A value that its column's type can't hold is null;
    ``read_flow_csv_checked`` sets such lines apart.
    """
    scans, unknown = _scans(spark, paths, schema, header, False)
    if not scans:
        return spark.createDataFrame([], schema).drop(*drop)
    return _typed(union_flows(scans, drop=drop, on_mismatch="null"), unknown)


def read_flow_csv_checked(spark: SparkSession, paths, schema: T.StructType, header: bool = True,
                          drop=()) -> tuple[DataFrame, DataFrame]:
    """What ``read_flow_csv`` reads, without the malformed lines, and those lines.

    A line is malformed if a value doesn't fit its column's type or the number of values isn't that of the
    header (or of ``schema``). Each line is in one of both results. The second has a row (file, line) for each.
    """
    scans, unknown = _scans(spark, paths, schema, header, True)
    if not scans:
        return spark.createDataFrame([], schema).drop(*drop), spark.createDataFrame([], "file string, line string")
    rows = union_flows(scans, on_mismatch="null")
    rejects = rows.where(F.col(LINE).isNotNull()).select(F.col(FILE).alias("file"), F.col(LINE).alias("line"))
    return _typed(rows.where(F.col(LINE).isNull()).drop(LINE, FILE, *drop), unknown), rejects


def read_dataset(spark: SparkSession, folder: str, dataset: str) -> DataFrame:
    """A published dataset from the CSV files found in ``folder``.

    For UNSW the raw files join the train and test sets only if their columns agree,
    and are skipped with a warning otherwise.
    """
    def found(kind):
        paths = [f"{folder.rstrip('/')}/{name}" for name in CSV_FILES[kind]]
        return [p for p in paths if matching(spark, p)], paths

    if dataset != "unsw":
        drop = CIC_2018_DROP if dataset == "cicids2018" else ()
        return read_flow_csv(spark, found(dataset)[1], csv_schema(dataset), drop=drop)
    frames = [read_flow_csv(spark, found(kind)[0], csv_schema(kind), header=kind == "unsw")
              for kind in ("unsw", "unsw_raw") if found(kind)[0]]
    if not frames:
        raise FileNotFoundError(f"no UNSW files in {folder}")
    return union_flows(frames, on_mismatch="skip")


def union_flows(frames: list[DataFrame], drop=(), on_mismatch: str = "raise") -> DataFrame:
    """All rows of the frames, matched by column name.

    A frame whose column set differs from the first one's is an error (``raise``), is
    left out with a warning (``skip``), or gets nulls for what it lacks (``null``).
    """
    if on_mismatch not in ("raise", "skip", "null"):
        raise ValueError(f"unknown on_mismatch {on_mismatch!r}")
    frames = [f.drop(*drop) for f in frames]
    if not frames:
        raise ValueError("nothing to unite")
    first, kept = set(frames[0].columns), [frames[0]]
    for frame in frames[1:]:
        if set(frame.columns) != first:
            difference = sorted(first ^ set(frame.columns))
            if on_mismatch == "raise":
                raise ValueError(f"columns differ: {difference}")
            if on_mismatch == "skip":
                log.warning("frame skipped, columns differ: %s", difference)
                continue
        kept.append(frame)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=on_mismatch == "null"), kept)


def read_processed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_processed(df: DataFrame, path: str, partitions: int | None = None) -> None:
    """Overwrite a Parquet table, by default with as many files as there are tasks.

    ``partitions`` sets the number of files through a shuffle; merging partitions without
    one would make that number the parallelism of everything before the write. Adaptive
    execution writes more files where one would exceed its advisory size, so that no task
    grows with the table, and fewer where they would be tiny.
    """
    (df if partitions is None else df.hint("rebalance", partitions)).write.mode("overwrite").parquet(path)


def write_metadata(metadata: DataFrame, path: str) -> None:
    """Store a small description table (one row per class) as JSON."""
    metadata.coalesce(1).write.mode("overwrite").json(path)


def verify_written(spark: SparkSession, path: str, expected: int) -> DataFrame:
    """One row: rows found, rows expected, whether they agree."""
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("written_rows")).withColumn(
        "expected_rows", F.lit(expected).cast("bigint")).withColumn(
        "verified", F.col("written_rows") == F.col("expected_rows"))


def _message_value(df: DataFrame, name: str) -> Column:
    column, data_type = quoted(name), df.schema[name].dataType
    if isinstance(data_type, T.NumericType):
        return F.coalesce(F.nanvl(column.cast("double"), F.lit(0.0)), F.lit(0.0))
    if isinstance(data_type, T.BooleanType):
        return column
    return F.coalesce(column.cast("string"), F.lit("0.0"))


def flows_to_json(df: DataFrame, key_col: str = "Source IP", producer_id: int = 0,
                  clock: Column | None = None, batch_size: int = 100) -> DataFrame:
    """Messages (key, value): every row as a JSON object with timestamp and producer_id.

    Null and NaN become 0.0 and numbers become doubles. The key is the source address
    where the table has one, else a number below ``batch_size`` that spreads the rows.
    """
    fields = [_message_value(df, c).alias(c.strip()) for c in df.columns]
    stamp = (F.current_timestamp() if clock is None else clock).cast("string")
    body = F.struct(*fields, stamp.alias("timestamp"), F.lit(producer_id).alias("producer_id"))
    named = {c.strip(): c for c in df.columns}
    if key_col in named:
        key = quoted(named[key_col]).cast("string")
    else:
        key = F.pmod(F.xxhash64(*[quoted(c) for c in df.columns]), F.lit(batch_size)).cast("string")
    return df.select(key.alias("key"), F.to_json(body).alias("value"))


def shuffled_head(df: DataFrame, key: list[str], n: int | None = None, seed: int = 42) -> DataFrame:
    """Rows in a seeded pseudo-random order that does not depend on partitioning; ``n`` keeps the first ones."""
    mixed = df.orderBy(F.xxhash64(row_key(key), F.lit(seed)), *key)
    return mixed if n is None else mixed.limit(n)
