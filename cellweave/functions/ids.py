"""Identifier, flag and ratio expressions (column in, column out)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Identifier and barcode formats, accepted truth words.
INTEGRAL_DECIMAL = r"^([+-]?\d+)\.0+$"
SQUARE_BARCODE = r"^s_\d+um_(\d+)_(\d+)(-\d+)?$"
TRUE_WORDS = ("1", "true", "t", "yes", "y")


def normalize_cell_id(value: Column) -> Column:
    """Text id: trimmed, ``12.0`` becomes ``12``, blank becomes null."""
    text = F.trim(value.cast("string"))
    integral = F.regexp_extract(text, INTEGRAL_DECIMAL, 1)
    return F.when(text == "", F.lit(None)).when(integral != "", integral).otherwise(text)


def normalize_numeric_id(value: Column) -> Column:
    """Numeric id: integral values as integers, NaN and infinite become null."""
    v = value.cast("double")
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    return (F.when(~finite, F.lit(None))
            .when(v == F.floor(v), v.cast("decimal(38,0)").cast("string"))
            .otherwise(v.cast("string")))


def coerce_bool(value: Column) -> Column:
    return F.coalesce(F.lower(F.trim(value.cast("string"))).isin(*TRUE_WORDS), F.lit(False))


def barcode_part(barcode: Column, group: int) -> Column:
    part = F.regexp_extract(barcode, SQUARE_BARCODE, group)
    return F.when(part != "", part.cast("int"))


def barcode_row(barcode: Column, y_um: Column | None = None, pitch_um: float = 2.0) -> Column:
    parsed = barcode_part(barcode, 1)
    return parsed if y_um is None else F.coalesce(parsed, F.rint(y_um / pitch_um).cast("int"))


def barcode_col(barcode: Column, x_um: Column | None = None, pitch_um: float = 2.0) -> Column:
    parsed = barcode_part(barcode, 2)
    return parsed if x_um is None else F.coalesce(parsed, F.rint(x_um / pitch_um).cast("int"))


def slug(value: Column, default: str) -> Column:
    text = F.trim(F.regexp_replace(value, r"[^A-Za-z0-9._-]+", "_"), F.lit("_"))
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit(default)).otherwise(text)


def json_id_list(value: Column) -> Column:
    """JSON array text to an array of normalised ids, nulls dropped."""
    items = F.from_json(value, "array<string>")
    return F.filter(F.transform(items, normalize_cell_id), lambda v: v.isNotNull())


def overlap_category(predicted: Column, predicted_match: Column, truth: Column) -> Column:
    return (F.when(predicted.isNull() & truth.isNull(), "unscored")
            .when(predicted.isNull(), "gt_only")
            .when(truth.isNull(), "pred_only")
            .when(predicted_match.isNull(), "unmatched_owner")
            .when(predicted_match == truth, "correct_owner")
            .otherwise("wrong_owner"))


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    return F.when(denominator > 0, numerator.cast("double") / denominator)


def finite_or_null(value: Column) -> Column:
    v = value.cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)
