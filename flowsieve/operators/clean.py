"""Projection, filtering and cleaning of flow tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from flowsieve.functions.columns import finite_or_null
from flowsieve.operators.ordering import attach_row, column_quantiles, index_rows, join_class_stats, join_group_stats

# Column names of common flow datasets and the names used here.
COLUMN_NAMES = {
    "Source IP": "srcIP", "src_ip": "srcIP", "source_ip": "srcIP", "saddr": "srcIP",
    "Destination IP": "dstIP", "dst_ip": "dstIP", "destination_ip": "dstIP", "daddr": "dstIP",
    "Source Port": "srcPort", "src_port": "srcPort", "source_port": "srcPort", "sport": "srcPort",
    "Destination Port": "dstPort", "dst_port": "dstPort", "destination_port": "dstPort", "dport": "dstPort",
    "Proto": "protocol", "protocol": "protocol", "Protocol": "protocol",
    "Time": "timestamp", "stime": "timestamp", "Timestamp": "timestamp",
    "pkt_len": "pktLen", "packet_length": "pktLen", "tot_len": "totalLength",
    "flow_duration": "flowDuration", "dur": "flowDuration",
    "Attack": "label", "attack": "label", "attack_cat": "label", "Class": "label", "class": "label",
}
LABEL_NAMES = ["class", "label", "target", "attack_cat", "attack", "category"]
BENIGN = ["0", "BENIGN", "benign", "Normal", "normal"]
ALWAYS_KEPT = ["label", "flow id"]

FLOATING = (T.DoubleType, T.FloatType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def standard_names(df: DataFrame, label: str | None = None) -> DataFrame:
    """Trim column names, map known synonyms, call the label column ``label``."""
    names, used = [], set()
    for c in df.columns:
        name = COLUMN_NAMES.get(c.strip(), c.strip())
        if label and c.strip() == label.strip():
            name = "label"
        names.append(name if name not in used else c.strip())
        used.add(names[-1])
    out = df.toDF(*names)
    if "label" not in names:
        hint = [c for c in names if any(w in c.lower() for w in ("label", "attack", "class"))]
        if hint:
            out = out.withColumnRenamed(hint[0], "label")
    return out


def label_column(columns: Sequence[str]) -> str:
    """The label column by name, else the last column."""
    known = [c for c in columns if c.lower() in LABEL_NAMES]
    return known[0] if known else columns[-1]


def drop_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    wanted = {n.strip() for n in names}
    return df.drop(*[c for c in df.columns if c.strip() in wanted])


def keep_numeric(df: DataFrame, always: Sequence[str] = ALWAYS_KEPT) -> DataFrame:
    numeric = set(numeric_columns(df))
    return df.select(*[c for c in df.columns if c in numeric or c.strip().lower() in always])


def coerce_numeric(df: DataFrame, columns: Sequence[str], fill: float | None = 0.0) -> DataFrame:
    """Text to double; NaN and what cannot be parsed become ``fill``."""
    made = {}
    for c in columns:
        x = F.col(c).try_cast("double")
        x = F.when(~F.isnan(x), x)
        made[c] = x if fill is None else F.coalesce(x, F.lit(float(fill)))
    return df.withColumns(made)


def mark_missing(df: DataFrame) -> DataFrame:
    """NaN and infinities become NULL in every floating column."""
    return df.withColumns({f.name: finite_or_null(f.name) for f in df.schema.fields if isinstance(f.dataType, FLOATING)})


def most_frequent(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row with the most frequent value of each column, the smallest on ties."""
    kinds = dict(df.dtypes)
    cells = []
    for c in columns:
        text = kinds[c] == "string"
        cells.append(F.struct(
            F.lit(c).alias("feature"),
            (F.lit(None).cast("double") if text else F.col(c).cast("double")).alias("num"),
            (F.col(c) if text else F.lit(None).cast("string")).alias("txt"),
        ))
    counts = (
        df.select(F.explode(F.array(*cells)).alias("_e")).select("_e.*")
        .where(F.col("num").isNotNull() | F.col("txt").isNotNull())
        .groupBy("feature", "num", "txt").agg(F.count(F.lit(1)).alias("n"))
    )
    best = counts.groupBy("feature").agg(F.min(F.struct(-F.col("n"), "num", "txt")).alias("_m"))
    picks = []
    for c in columns:
        field = "_m.txt" if kinds[c] == "string" else "_m.num"
        picks.append(F.max(F.when(F.col("feature") == c, F.col(field))).cast(kinds[c]).alias(c))
    return best.agg(*picks)


def fill_missing(df: DataFrame, strategy: str = "mean", columns: Sequence[str] | None = None) -> DataFrame:
    """Missing values by ``mean``, ``median``, ``mode``, ``zero`` or ``drop``.

    All statistics come from one aggregate over the table and reach the rows as
    a scalar subquery. ``mean`` and ``median`` touch numeric columns only.
    """
    df = mark_missing(df)
    numeric = [c for c in (columns or numeric_columns(df)) if c in numeric_columns(df)]
    everything = list(columns or df.columns)
    if strategy == "drop":
        return df.dropna(subset=everything)
    if strategy == "zero":
        return df.fillna(0, subset=numeric)
    if strategy == "mean":
        stats, targets = df.agg(*[F.avg(c).alias(c) for c in numeric]), numeric
    elif strategy == "median":
        row = column_quantiles(df, numeric, [0.5])
        stats, targets = row.toDF(*numeric), numeric
    elif strategy == "mode":
        stats, targets = most_frequent(df, everything), everything
    else:
        raise ValueError(f"unknown strategy {strategy}")
    kinds = dict(df.dtypes)
    default = {c: F.lit("0") if kinds[c] == "string" else F.lit(0.0) for c in targets}
    out = attach_row(df, stats, "_fill")
    return out.withColumns({c: F.coalesce(F.col(c), F.col(f"_fill.{c}"), default[c]) for c in targets}).drop("_fill")


def impute_approximate_median(df: DataFrame, columns: Sequence[str], accuracy: int = 10000) -> DataFrame:
    """NULLs by a one-pass approximate median; bounded memory whatever the table size."""
    stats = df.agg(*[F.percentile_approx(c, 0.5, accuracy).alias(c) for c in columns])
    out = attach_row(df, stats, "_fill")
    return out.withColumns({c: F.coalesce(F.col(c), F.col(f"_fill.{c}")) for c in columns}).drop("_fill")


def drop_sparse_rows(df: DataFrame, threshold: float = 0.3, columns: Sequence[str] | None = None) -> DataFrame:
    """Keep rows whose share of missing cells is below ``threshold``."""
    columns = list(columns or df.columns)
    missing = reduce(lambda a, b: a + b, [F.col(c).isNull().cast("int") for c in columns])
    return df.where(missing / F.lit(float(len(columns))) < threshold)


def drop_duplicate_rows(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def fit_iqr_bounds(df: DataFrame, columns: Sequence[str], t: float = 3.0, sequential: bool = True) -> list[tuple]:
    """(column, low, high) limits. Sequential limits of a column use the rows that
    passed the columns before it, so each column needs its own pass; only two
    numbers per column return to the driver."""
    bounds = []
    kept = df
    if not sequential:
        row = column_quantiles(df, columns, [0.25, 0.75]).first()
    for c in columns:
        if sequential:
            row = column_quantiles(kept, [c], [0.25, 0.75]).first()
        q1, q3 = row[f"{c}_p25"], row[f"{c}_p75"]
        if q1 is None:
            continue
        bounds.append((c, q1 - t * (q3 - q1), q3 + t * (q3 - q1)))
        kept = apply_bounds(df, bounds)
    return bounds


def apply_bounds(df: DataFrame, bounds: Sequence[tuple]) -> DataFrame:
    for c, low, high in bounds:
        df = df.where((F.col(c) >= low) & (F.col(c) <= high))
    return df


def iqr_filter(df: DataFrame, columns: Sequence[str], t: float = 3.0, sequential: bool = True) -> DataFrame:
    return apply_bounds(df, fit_iqr_bounds(df, columns, t, sequential))


def zscore_filter(df: DataFrame, columns: Sequence[str], t: float = 3.0) -> DataFrame:
    """Rows with all |z| < t (population std). A constant column has no z and drops every row."""
    stats = df.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns])
    out = attach_row(df, stats)
    for c in columns:
        std = F.col(f"_s.s_{c}")
        out = out.where(F.abs((F.col(c) - F.col(f"_s.m_{c}")) / F.when(std != 0, std)) < t)
    return out.drop("_s")


def binary_label(c: str | Column) -> Column:
    x = F.col(c) if isinstance(c, str) else c
    return (~x.cast("string").isin(*BENIGN)).cast("int")


def vpn_label(name: str | Column) -> Column:
    """1 VPN, 0 plain, -1 mixed, from a file name; both spellings of the plain files count as plain."""
    n = F.lower(F.col(name) if isinstance(name, str) else name)
    return (
        F.when(n.contains("no-vpn") | n.contains("novpn"), 0).when(n.contains("vpn"), 1)
        .when(n.contains("allinone"), -1).otherwise(0)
    )


def vpn_text_label(c: str | Column) -> Column:
    x = F.col(c) if isinstance(c, str) else c
    return F.lower(x).contains("vpn").cast("int")


def encryption_flag(path: str | Column) -> Column:
    p = F.lower(F.col(path) if isinstance(path, str) else path)
    return (
        F.when(p.contains("no-vpn") | p.contains("no_vpn") | p.contains("novpn"), 0).when(p.contains("vpn"), 1)
        .when(p.contains("scenario a1"), 1).otherwise(-1)
    )


def fit_label_codes(df: DataFrame, column: str) -> DataFrame:
    """(value, code): rank of each distinct value in sorted order, from 0."""
    values = df.where(F.col(column).isNotNull()).select(F.col(column).alias("value")).distinct()
    ranked = index_rows(values, [], ["value"], "code")
    return ranked.select("value", (F.col("code") - 1).alias("code"))


def apply_label_codes(df: DataFrame, codes: DataFrame, column: str, spread: Sequence[str], out: str | None = None) -> DataFrame:
    """Code of each value; -1 for values that were not seen when fitting."""
    renamed = codes.select(F.col("value").alias(column), F.col("code").alias("_code"))
    joined = join_group_stats(df, renamed, [column], spread, how="left")
    return joined.withColumn(out or f"{column}_code", F.coalesce("_code", F.lit(-1))).drop("_code")


def drop_rare_classes(df: DataFrame, label: str, spread: Sequence[str], at_least: int = 2) -> DataFrame:
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= at_least).drop("_n")
    return join_class_stats(df, counts, [label], spread)


def remap_label(c: str | Column, source: int = -1, target: int = 2) -> Column:
    """Replace one label value; any other negative label is an error when it is reached."""
    x = F.col(c) if isinstance(c, str) else c
    checked = F.when(x >= 0, x).otherwise(F.raise_error(F.concat(F.lit("negative label "), x.cast("string"))).cast("int"))
    return F.when(x == source, F.lit(target)).otherwise(checked)


def to_float32(df: DataFrame) -> DataFrame:
    return df.withColumns({f.name: F.col(f.name).cast("float") for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)})
