"""Readers for flow tables (CSV, ARFF) and the sinks."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from flowsieve.functions.columns import total
from flowsieve.operators.clean import fill_missing, numeric_columns, vpn_label
from flowsieve.operators.combine import stack_tables
from flowsieve.operators.sampling import head_per_file
from flowsieve.session import materialize
from flowsieve.sources.heads import arff_heads, csv_headers

TABLE_TYPES = {".csv": "csv", ".arff": "arff", ".pcap": "pcap", ".cap": "pcap"}


def list_files(spark: SparkSession, paths: str | Sequence[str], pattern: str = "*") -> list[str]:
    """Paths below the given folders; the files are listed, not read."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    found = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
        .load(paths).select("path").collect()
    )
    return sorted(r.path for r in found)


def file_path() -> Column:
    return F.col("_metadata.file_path")


def file_name() -> Column:
    return F.col("_metadata.file_name")


def data_files(spark: SparkSession, path: str | Sequence[str]) -> list[str]:
    """The files a reader would read for a file, a folder or a list of them; nothing is opened."""
    return _files_of(spark.read.text(path if isinstance(path, str) else list(path)))


def _files_of(df: DataFrame) -> list[str]:
    return sorted(unquote(f) for f in df.inputFiles())


def _quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _plain(header: Sequence[str]) -> list[str]:
    """Stripped names; an empty one is ``_c<position>`` and a repeated one gets its position, as both can hold data."""
    out: list[str] = []
    seen: set[str] = set()
    for i, c in enumerate(header):
        name = c.strip() or f"_c{i}"
        name = f"{name}_{i}" if name.lower() in seen else name
        seen.add(name.lower())
        out.append(name)
    return out


def _typed(names: Sequence[str], wanted: StructType | None) -> StructType:
    kinds = {f.name.lower(): f.dataType for f in wanted} if wanted else {}
    return StructType([StructField(c, kinds.get(c.lower(), StringType())) for c in names])


def read_csv(
    spark: SparkSession, path: str | Sequence[str], label_column: str | None = None, schema: str | None = None,
    encoding: str = "UTF-8", with_path: str | None = None,
) -> DataFrame:
    """CSV with a header; blanks around column names are cut. A missing label column is an error.

    Columns go by name: files are grouped by their header (one distributed pass over the heads), so files with other orders or
    sets of columns in one folder keep their values in the right column; absent ones are NULL. Columns come as in ``schema``, else
    in the order in which the files (sorted by path) name them. Without a schema every column is text: nothing is read twice to
    guess types. Files without any line give no rows. ``with_path`` names a column for the file's path.
    """
    wanted = StructType.fromDDL(schema) if schema else None
    folders = spark.read.text(path if isinstance(path, str) else list(path))
    partitions = [f for f in folders.schema if f.name != "value"]
    groups = csv_headers(spark, _files_of(folders), encoding)
    groups.pop((), None)
    reader = spark.read.option("header", "true").option("encoding", encoding)
    if partitions and isinstance(path, str):
        reader = reader.option("basePath", path)
    order = [f.name for f in wanted] if wanted else []
    parts = []
    for header, files in groups.items():
        names = _plain(header)
        extra = [f for f in partitions if f.name.lower() not in {c.lower() for c in names}]
        # the header is given as the schema, so a name's spelling in the file does not matter any more
        df = reader.schema(StructType(_typed(names, wanted).fields + extra)).option("enforceSchema", "true").csv(files)
        if with_path:
            df = df.select("*", file_path().alias(with_path))
        parts.append(df)
        known = {c.lower() for c in order}
        order += [] if wanted else [c for c in names if c.lower() not in known]
    if not parts:
        parts = [spark.createDataFrame([], StructType((wanted.fields if wanted else []) + ([StructField(with_path, StringType())] if with_path else [])))]
    df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    if label_column and label_column not in df.columns:
        raise ValueError(f"label column {label_column!r} not among {df.columns}")
    held = {c.lower() for c in df.columns}
    listed = {c.lower() for c in order}
    kept = [_quoted(c) if c.lower() in held else F.lit(None).cast(wanted[c].dataType).alias(c) for c in order]
    tail = [f.name for f in partitions if f.name.lower() not in listed and f.name.lower() in held] + ([with_path] if with_path else [])
    return df.select(*kept, *[_quoted(c) for c in tail])


def read_text_table(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """All-text CSV in latin1, header names stripped; partitions follow the file splits."""
    return read_csv(spark, path, encoding="ISO-8859-1")


def read_any_encoding(spark: SparkSession, files: Sequence[str]) -> DataFrame:
    """CSV files in UTF-8 where all their bytes are valid UTF-8, in latin1 otherwise.

    latin1 keeps every byte, so one pass over the raw text tells per file
    whether the bytes decode; then each set is read with its encoding.
    """
    raw = spark.read.option("encoding", "ISO-8859-1").option("sep", "\u0001").option("quote", "").schema("line string").csv(list(files))
    valid = F.is_valid_utf8(F.encode("line", "ISO-8859-1").cast("string"))
    checked = raw.select(file_path().alias("path"), valid.alias("ok")).groupBy("path").agg(F.min("ok").alias("ok")).collect()
    parts = []
    for wanted, encoding in ((True, "UTF-8"), (False, "ISO-8859-1")):
        paths = sorted(r.path for r in checked if bool(r.ok) is wanted)
        if paths:
            parts.append(read_csv(spark, paths, encoding=encoding))
    return stack_tables(parts)


def read_csv_union(spark: SparkSession, files: Sequence[str], encoding: str = "UTF-8", per_file: int | None = None) -> DataFrame:
    """CSV files with unlike headers over the sorted union of their columns, at most ``per_file`` rows of each."""
    df = read_csv(spark, files, encoding=encoding, with_path="_file")
    names = [c for c in df.columns if c != "_file"]
    if per_file:
        keyed = df.withColumn("_key", F.to_json(F.struct(*[_quoted(c) for c in names])))
        df = head_per_file(keyed, "_file", "_key", per_file)
    return df.select(*[_quoted(c) for c in sorted(names)])


def combine_csv(spark: SparkSession, folders: Sequence[str], output: str, per_file: int | None = None) -> DataFrame:
    df = read_csv_union(spark, list_files(spark, folders, "*.csv"), per_file=per_file)
    write_table(df, output, "csv")
    return read_csv(spark, output)


# -- ARFF ------------------------------------------------------------------------------------------

ATTRIBUTE = re.compile(r"@attribute\s+('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|\S+)\s+(.+?)[\s,]*$", re.IGNORECASE)

# a value: quoted in either way (a backslash keeps the next sign), or up to the comma
VALUE = r"""'[^'\\]*+(?:\\.[^'\\]*+)*+'|"[^"\\]*+(?:\\.[^"\\]*+)*+"|[^,]*?"""
# one cell and the comma after it, in a plain and in a sparse row
CELL, SPARSE_CELL = rf"\s*({VALUE})\s*,", rf"\s*((?:\d++\s++)?(?:{VALUE}))\s*,"
# one cell of a sparse row: its position, blanks, its value
SPARSE = r"^\s*(\d+)\s+(.*)$"


def arff_attributes(head: Sequence[str]) -> list[tuple[str, str]]:
    """(name, type) of the ``@attribute`` lines; a nominal type keeps the case of its values."""
    found = [m for m in (ATTRIBUTE.match(line) for line in head) if m]
    return [(_unquoted(m[1]), m[2].strip()) for m in found]


def _unquoted(text: str) -> str:
    text = text.strip()
    if len(text) > 1 and text[0] in "'\"" and text[-1] == text[0]:
        text = re.sub(r"\\(.)", r"\1", text[1:-1])
    return text.strip()


def _sparse_default(kind: str) -> str | None:
    """What a sparse row means by a cell it does not name: 0, or the first nominal value."""
    if kind.startswith("{"):
        values = re.match(r"\s*('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|[^,}]*)", kind[1:])
        return _unquoted(values[1]) if values else None
    return "0" if kind.split()[0].lower() in ("numeric", "real", "integer") else None


def _cells(line: Column, pattern: str = CELL) -> Column:
    return F.regexp_extract_all(F.concat(line, F.lit(",")), F.lit(pattern), 1)


def _value(raw: Column) -> Column:
    """A cell without its quotes; ``?`` and blanks are NULL unless quoted."""
    quoted = raw.rlike(r"(?s)^'.*'$|^\".*\"$") & (F.length(raw) > 1)
    inner = F.regexp_replace(F.substring(raw, F.lit(2), F.length(raw) - 2), r"\\(.)", "$1")
    return F.when(quoted, F.when(inner != "", inner)).when(~F.trim(raw).isin("", "?"), F.trim(raw))


def _arff_parts(spark: SparkSession, files: Sequence[str]) -> list[tuple[list[tuple[str, str]], DataFrame]]:
    """Per header: its attributes and the data rows as (_path, _ok, cells); ``cells`` is NULL where ``_ok`` is false."""
    groups: dict[tuple, list[str]] = {}
    for head, paths in arff_heads(spark, files).items():
        groups.setdefault(tuple(arff_attributes(head)), []).extend(paths)
    bare = groups.pop((), [])
    if bare:
        raise ValueError(f"no ARFF header in {sorted(bare)[:5]}" + (f" and {len(bare) - 5} more" if len(bare) > 5 else ""))
    out = []
    for attrs, paths in groups.items():
        width = len(attrs)
        lines = spark.read.text(sorted(paths)).select(F.trim(F.rtrim(F.trim(F.translate("value", "\r\t", "  ")), F.lit(","))).alias("line"), file_path().alias("_path"))
        lines = lines.where((F.col("line") != "") & ~F.col("line").startswith("%") & ~F.col("line").rlike(r"(?i)^@(relation|attribute|data|end)\b"))
        sparse = F.col("line").startswith("{") & F.col("line").endswith("}")
        body = F.expr("substring(line, 2, length(line) - 2)")
        named = F.when(sparse & (F.trim(body) != ""), F.filter(_cells(F.rtrim(F.trim(body), F.lit(",")), SPARSE_CELL), lambda c: F.trim(c) != "")).when(sparse, F.array().cast("array<string>"))
        rows = lines.select("_path", sparse.alias("_sparse"), F.when(~sparse, _cells(F.col("line"))).alias("_dense"), named.alias("_named"))
        at = F.transform("_named", lambda c: F.regexp_extract(c, SPARSE, 1).try_cast("int"))
        rows = rows.withColumns({"_at": at, "_put": F.transform("_named", lambda c: F.regexp_extract(c, SPARSE, 2))})
        fits = ~F.exists("_at", lambda i: i.isNull() | (i >= width)) & (F.size(F.array_distinct("_at")) == F.size("_at"))
        rows = rows.withColumn("_ok", F.coalesce(F.when(F.col("_sparse"), fits).otherwise(F.size("_dense") == width), F.lit(False)))
        pairs = F.when(F.col("_ok") & F.col("_sparse"), F.map_from_arrays("_at", "_put"))
        out.append((list(attrs), rows.withColumn("_pairs", pairs).select("_path", "_ok", "_sparse", "_dense", "_pairs")))
    return out


def read_arff(spark: SparkSession, files: Sequence[str], source_column: str | None = None) -> DataFrame:
    """ARFF files, united by name.

    Headers are read by tasks that stop at ``@data``; a file without one is an error. Comment, header and blank lines are
    skipped, trailing commas cut. Commas inside quotes of either kind belong to the value. Sparse rows (``{0 1, 3 2}``) hold 0, or
    the first nominal value, where they name nothing (NULL for text). Rows of another width than the header, or with a position
    twice or too large, are left out (``rejected_rows`` counts them); ``?`` and blanks are NULL and numeric attributes
    become doubles (NULL where they do not parse). Of two attributes of one name the later gets its position added.
    """
    parts = []
    for attrs, rows in _arff_parts(spark, files):
        columns = []
        for i, (name, (_, kind)) in enumerate(zip(_plain([a for a, _ in attrs]), attrs)):
            named = F.when(F.map_contains_key("_pairs", F.lit(i)), _value(F.element_at("_pairs", F.lit(i)))).otherwise(F.lit(_sparse_default(kind)))
            raw = F.when(F.col("_sparse"), named).otherwise(_value(F.get("_dense", F.lit(i))))
            columns.append((raw.try_cast("double") if kind.split()[0].lower() in ("numeric", "real", "integer") else raw).alias(name))
        if source_column:
            columns.append(F.col("_path").alias(source_column))
        parts.append(rows.where("_ok").select(*columns))
    if not parts:
        raise ValueError("no ARFF file")
    return stack_tables(parts)


def rejected_rows(spark: SparkSession, files: Sequence[str]) -> DataFrame:
    """(path, n_rows, n_rejected) of ARFF files: data rows, and those of them that ``read_arff`` leaves out."""
    parts = [rows.select("_path", "_ok") for _, rows in _arff_parts(spark, files)]
    both = reduce(lambda a, b: a.unionByName(b), parts)
    return both.groupBy(F.col("_path").alias("path")).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(~F.col("_ok")).alias("n_rejected"))


def read_arff_folders(spark: SparkSession, folders: Sequence[str]) -> DataFrame:
    return read_arff(spark, list_files(spark, folders, "*.arff"))


def combine_scenarios(
    spark: SparkSession, scenarios: Mapping[str, str | Sequence[str]], kind: str = "arff", per_file: int | None = None, label: str | None = "label",
    label_from: str = "name",
) -> DataFrame:
    """One table from a folder (or list of files) per scenario: ``scenario`` and ``source_file`` columns, a VPN label
    from the file name (or path), missing numbers by median and texts by mode, duplicates dropped."""
    parts = []
    for name, folder in scenarios.items():
        if kind == "arff":
            files = list_files(spark, folder, "*.arff") if isinstance(folder, str) else folder
            df = read_arff(spark, files, source_column="_path")
        else:
            df = read_csv(spark, folder, with_path="_path")
        if per_file:
            keyed = df.withColumn("_key", F.to_json(F.struct(*df.columns)))
            df = head_per_file(keyed, "_path", "_key", per_file).drop("_key")
        parts.append(df.withColumn("scenario", F.lit(name)))
    out = stack_tables(parts)
    file = F.element_at(F.split("_path", "/"), -1)
    if label and label not in out.columns:
        out = out.withColumn(label, vpn_label(file if label_from == "name" else F.col("_path")))
    out = materialize(out.withColumn("source_file", file).drop("_path"), "scenarios")  # the files are parsed once, not for every statistic
    numbers = [c for c in numeric_columns(out) if c != label]
    texts = [c for c, k in out.dtypes if k == "string" and c not in ("scenario", "source_file")]
    out = fill_missing(out, "median", numbers)
    if texts:
        out = fill_missing(out, "mode", texts)
    return out.dropDuplicates()


# -- batches, counts, dispatch -----------------------------------------------------------------------

def rows_per_file(spark: SparkSession, files: Sequence[str]) -> DataFrame:
    """(path, file_name, n_rows): data rows per CSV file, header lines not counted; files of one name in two folders stay apart."""
    df = spark.read.option("header", "true").csv(list(files))
    return df.groupBy(file_path().alias("path"), file_name().alias("file_name")).agg(F.count(F.lit(1)).alias("n_rows"))


def read_batch(spark: SparkSession, files: Sequence[str], schema: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, status per file) of many CSV files in one scan.

    A row that does not fit the schema counts against its file: ``success``
    without such rows, ``partial`` with some, ``error`` without a good row.
    """
    bad = "_corrupt"
    raw = (
        spark.read.option("header", "true").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", bad)
        .schema(f"{schema}, {bad} string").csv(list(files)).select("*", file_path().alias("file"))
    )
    # rows without any content are skipped; the test also makes the reader parse every cell
    filled = total([F.col(c).isNotNull().cast("int") for c in raw.columns if c not in (bad, "file")])
    raw = raw.where((filled > 0) | F.col(bad).isNotNull())
    status = raw.groupBy("file").agg(F.count(F.lit(1)).alias("n_rows"), F.count(bad).alias("n_bad")).withColumn(
        "status", F.when(F.col("n_bad") == 0, "success").when(F.col("n_bad") < F.col("n_rows"), "partial").otherwise("error")
    )
    return raw.where(F.col(bad).isNull()).drop(bad), status


def file_kind(path: str) -> str:
    """Reader name by file extension."""
    dot = path.rfind(".")
    kind = TABLE_TYPES.get(path[dot:].lower() if dot >= 0 else "")
    if kind is None:
        raise ValueError(f"no reader for {path}")
    return kind


def load(spark: SparkSession, path: str) -> DataFrame:
    """Read a file with the reader for its extension."""
    from flowsieve.sources.capture import read_captures

    kind = file_kind(path)
    if kind == "csv":
        return read_csv(spark, path)
    return read_arff(spark, [path]) if kind == "arff" else read_captures(spark, [path])


# -- sinks -----------------------------------------------------------------------------------------

def write_table(df: DataFrame, path: str, kind: str = "parquet", partition_by: Sequence[str] = (), mode: str = "error") -> str:
    writer = df.write.mode(mode).partitionBy(*partition_by) if partition_by else df.write.mode(mode)
    if kind == "csv":
        writer.option("header", "true").csv(path)
    elif kind == "json":
        writer.json(path)
    elif kind == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"unknown sink {kind}")
    return path


def store_predictions(df: DataFrame, path: str, model: str = "model_type", mode: str = "append") -> str:
    """Predictions as JSON, one folder per model type."""
    return write_table(df, path, "json", [model], mode)


def prediction_report(spark: SparkSession, path: str, schema: str, model: str = "model_type") -> DataFrame:
    """Stored predictions per model type, with the total."""
    df = spark.read.schema(schema).json(path)
    return df.rollup(model).agg(F.count(F.lit(1)).alias("n")).withColumn(model, F.coalesce(model, F.lit("total")))
