"""Flow tables: schemas, CSV/Parquet scans, client catalogs, positional test sets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..operators.cleaning import IDENTIFIERS, UNUSED_LABELS

# Feature counts and label columns of the two table families.
SLICE_WIDTH, SLICE_LABEL = 49, "NST_B_Label"
DAY_WIDTH, DAY_LABEL = 78, "Label"

# Input data files by client number; the day files are the public CIC-IDS-2017 set.
SLICE_FILES = {
    1: "output_bottom.csv",
    2: "output_left.csv",
    3: "output_right.csv",
}
DAY_FILES = {
    1: "Tuesday-WorkingHours.pcap_ISCX.csv",
    2: "Wednesday-workingHours.pcap_ISCX.csv",
    3: "Thursday-WorkingHours-Afternoon-Infilteration.pcap_ISCX.csv",
    4: "Thursday-WorkingHours-Morning-WebAttacks.pcap_ISCX.csv",
    5: "Friday-WorkingHours-Afternoon-PortScan.pcap_ISCX.csv",
    6: "Friday-WorkingHours-Morning.pcap_ISCX.csv",
    7: "Friday-WorkingHours-Afternoon-DDos.pcap_ISCX.csv",
}


def feature_names(width: int) -> list[str]:
    return [f"f{i:02d}" for i in range(1, width + 1)]


def slice_schema(features: Sequence[str] | None = None) -> T.StructType:
    """Identifiers, features, unused labels and the 0/1 label of a slice table."""
    double = {"start", "end"}
    fields = [(c, T.DoubleType() if c in double else T.StringType()) for c in IDENTIFIERS]
    fields += [(c, T.DoubleType()) for c in features or feature_names(SLICE_WIDTH)]
    fields += [(c, T.StringType()) for c in UNUSED_LABELS]
    return T.StructType([T.StructField(n, t) for n, t in [*fields, (SLICE_LABEL, T.LongType())]])


def day_schema(features: Sequence[str] | None = None) -> T.StructType:
    """Features and text label of a day table."""
    fields = [T.StructField(c, T.DoubleType()) for c in features or feature_names(DAY_WIDTH)]
    return T.StructType([*fields, T.StructField(DAY_LABEL, T.StringType())])


def read_flows(
    spark: SparkSession, path: str, schema: T.StructType | None = None, source: str = "csv", **options
) -> DataFrame:
    """One flow table. CSV has a header; ``inf``, ``-inf``, ``Infinity`` and ``NaN`` are numbers.

    With a schema the columns are taken in file order and the header names are
    not checked, so blanks around them or repeated names do no harm; without
    one the types are inferred by an extra pass.
    """
    reader = spark.read.options(**options)
    if source == "csv":
        reader = reader.options(header=True, positiveInf="inf", negativeInf="-inf", enforceSchema=True)
        reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    elif schema is not None:
        reader = reader.schema(schema)
    return reader.format(source).load(path)


def read_flows_by_name(spark: SparkSession, path: str, schema: T.StructType, **options) -> DataFrame:
    """One CSV flow table whose columns are found by header name, in any file order.

    Blanks around header names and their case do not matter; a schema column that
    the header lacks is an error, other columns are left out. Values that are no
    number become NULL; ``malformed_values`` counts them.
    """
    raw = _by_name(spark, path, schema, options)
    return raw.select(*[
        F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema.fields
    ])


def malformed_values(spark: SparkSession, path: str, schema: T.StructType, **options) -> DataFrame:
    """(column, malformed) of the table's columns: values that are there but do not fit the column's type."""
    raw = _by_name(spark, path, schema, options)
    bad = raw.agg(*[
        F.count_if(F.col(f.name).isNotNull() & F.col(f.name).try_cast(f.dataType).isNull()).alias(f.name)
        for f in schema.fields
    ])
    cells = F.explode(F.array(*[
        F.struct(F.lit(f.name).alias("column"), F.col(f.name).alias("malformed")) for f in schema.fields
    ]))
    return bad.select(cells.alias("c")).select("c.*")


def _by_name(spark: SparkSession, path: str, schema: T.StructType, options: Mapping) -> DataFrame:
    """The schema's columns as text."""
    raw = spark.read.options(header=True, **options).csv(path)
    places = {}
    for c in raw.columns:
        places.setdefault(c.strip().lower(), c)
    missing = [f.name for f in schema.fields if f.name.strip().lower() not in places]
    if missing:
        raise ValueError(f"{path}: no columns {missing}")
    return raw.select(*[
        F.trim(F.col("`" + places[f.name.strip().lower()].replace("`", "``") + "`")).alias(f.name) for f in schema.fields
    ])


def catalog(folder: str, files: Mapping[int, str]) -> dict[int, str]:
    """Client number to path."""
    return {client: f"{folder.rstrip('/')}/{name}" for client, name in files.items()}


def read_catalog(
    spark: SparkSession, paths: Mapping[int, str], schema: T.StructType | None = None, source: str = "csv",
    clients: Sequence[int] | None = None, **options,
) -> DataFrame:
    """All (or the named) clients' tables as one, with the ``client`` number on every row."""
    wanted = list(paths) if clients is None else list(clients)
    unknown = [c for c in wanted if c not in paths]
    if unknown:
        raise KeyError(f"no path for clients {unknown}")
    out = None
    for client in wanted:
        table = read_flows(spark, paths[client], schema, source, **options)
        table = table.withColumn("client", F.lit(client).cast("int"))
        out = table if out is None else out.unionByName(table)
    return out


def write_by_client(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parquet in one folder per client, so that a filter on ``client`` reads only its files."""
    df.write.mode(mode).partitionBy("client").parquet(path)


def positional_test_set(df: DataFrame, width: int = SLICE_WIDTH, label: str = "label") -> DataFrame:
    """The first ``width`` columns as ``features``, the last one as ``label``, whatever their names."""
    if len(df.columns) <= width:
        raise ValueError(f"{len(df.columns)} columns, {width} features and a label wanted")
    first = [F.col("`" + c.replace("`", "``") + "`").cast("double") for c in df.columns[:width]]
    last = F.col("`" + df.columns[-1].replace("`", "``") + "`").cast("bigint")
    return df.select(F.array(*first).alias("features"), last.alias(label))
