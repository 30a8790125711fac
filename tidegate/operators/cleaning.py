"""Cleaning and encoding of flow tables: projections only, no shuffle but for the label map."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..session import pinned

# Identifier and unused label columns of the slice flow tables.
IDENTIFIERS = (
    "sAddress", "rAddress", "sMACs", "rMACs", "sIPs", "rIPs", "protocol",
    "startDate", "endDate", "start", "end",
)
UNUSED_LABELS = ("IT_B_Label", "IT_M_Label", "NST_M_Label")

# The two classes of a binarised label.
BENIGN, MALIGNANT = "BENIGN", "MALIGNANT"

MAX_CLASSES = 10_000


def numeric_columns(df: DataFrame, without: Sequence[str] = ()) -> list[str]:
    return [
        f.name for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType) and f.name not in without
    ]


def drop_identifiers(df: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Drop identifiers and unused labels; absent names are ignored."""
    return df.drop(*IDENTIFIERS, *UNUSED_LABELS, *extra)


def fill_gaps(df: DataFrame, value: float = 0, strings: bool = False) -> DataFrame:
    """NULL and NaN become ``value``; in text columns only on request."""
    filled = df.na.fill(value)
    return filled.na.fill(str(value)) if strings else filled


def trim_headers(df: DataFrame) -> DataFrame:
    """Strip blanks around column names; a repeated name gets ``.1``, ``.2``, …"""
    seen: dict[str, int] = {}
    names = []
    for name in (c.strip() for c in df.columns):
        count = seen.get(name, 0)
        seen[name] = count + 1
        names.append(f"{name}.{count}" if count else name)
    return df.toDF(*names)


def _quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def repair_infinities(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """±Infinity, NaN and NULL become 0 in one projection."""
    targets = set(
        columns
        if columns is not None
        else [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    )

    def repaired(name: str) -> Column:
        c = _quoted(name)
        kind = df.schema[name].dataType
        # NaN sorts above Infinity, so two comparisons cover NaN and both infinities
        finite = (c < F.lit(float("inf"))) & (c > F.lit(float("-inf")))
        return F.when(finite, c).otherwise(F.lit(0).cast(kind)).alias(name)

    return df.select(*[repaired(c) if c in targets else _quoted(c) for c in df.columns])


def binarise_label(df: DataFrame, label: str = "Label") -> DataFrame:
    """BENIGN stays, anything else, a missing label too, is MALIGNANT."""
    benign = F.col(label).eqNullSafe(BENIGN)
    return df.withColumn(label, F.when(benign, BENIGN).otherwise(MALIGNANT))


def fit_label_codes(train: DataFrame, label: str = "Label") -> DataFrame:
    """Map of distinct labels, ascending, to 0..k-1; fitted once and reused on test rows."""
    classes = pinned(train.select(label).where(F.col(label).isNotNull()).distinct(), MAX_CLASSES)
    code = (F.row_number().over(Window.orderBy(label)) - 1).cast("bigint")
    return pinned(classes.withColumn("code", code), MAX_CLASSES)


def encode_label(df: DataFrame, codes: DataFrame, label: str = "Label", out: str = "label_code") -> DataFrame:
    """Attach the code of each label; a label unseen in training gets NULL."""
    return df.join(codes.withColumnRenamed("code", out), label, "left")


def assemble_features(df: DataFrame, columns: Sequence[str], out: str = "features") -> DataFrame:
    """Feature columns to one ARRAY<DOUBLE>, everything else untouched."""
    packed = F.array(*[_quoted(c).cast("double") for c in columns]).alias(out)
    rest = [_quoted(c) for c in df.columns if c not in set(columns)]
    return df.select(*rest, packed)


def split_features_label(df: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    """Features without the label, and the label alone, as two projections."""
    return df.drop(label), df.select(label)


def cast_types(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Features to FLOAT, label to BIGINT; text that is no number becomes NULL."""
    wanted = set(features)

    def cast(name: str) -> Column:
        if name in wanted:
            return _quoted(name).try_cast("float").alias(name)
        if name == label:
            return _quoted(name).try_cast("bigint").alias(name)
        return _quoted(name)

    return df.select(*[cast(c) for c in df.columns])


def require_width(df: DataFrame, features: Sequence[str], width: int) -> DataFrame:
    """Refuse a table whose feature count or types do not fit the model input."""
    if len(features) != width:
        raise ValueError(f"{len(features)} feature columns, model takes {width}")
    wrong = [c for c in features if not isinstance(df.schema[c].dataType, T.NumericType)]
    if wrong:
        raise TypeError(f"not numeric: {wrong}")
    return df


def width_violations(df: DataFrame, width: int, features: str = "features", groups: Sequence[str] = ()) -> DataFrame:
    """Rows, and rows whose feature array has another length or a gap in it."""
    bad = (
        F.col(features).isNull()
        | (F.size(features) != width)
        | F.exists(F.col(features), lambda v: v.isNull() | F.isnan(v))
    )
    return df.groupBy(*groups).agg(
        F.count("*").alias("n_rows"),
        F.sum(F.when(bad, 1).otherwise(0)).cast("bigint").alias("n_bad"),
    )
