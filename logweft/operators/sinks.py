"""Writers. Each writes one part file per task; row order is the input's."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .projection import chosen_fields, export_field, select_fields


def json_line(fields: Sequence[str] | None = None) -> Column:
    """One JSON object, keys sorted, all values text."""
    return F.to_json(F.struct(*[export_field(f).alias(f) for f in sorted(set(chosen_fields(fields)))]))


def yaml_document(fields: Sequence[str] | None = None) -> Column:
    """``---`` and one ``key: "value"`` line per field."""
    rows = [
        F.concat(F.lit(f'{f}: "'), F.replace(export_field(f), F.lit('"'), F.lit('\\"')), F.lit('"'))
        for f in chosen_fields(fields)
    ]
    return F.concat_ws("\n", F.lit("---"), *rows)


def _text(df: DataFrame, line: Column, path: str, mode: str) -> None:
    df.select(line.alias("value")).write.mode(mode).text(path)


def write_raw(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    _text(df, F.col("raw"), path, mode)


def write_json(df: DataFrame, path: str, fields: Sequence[str] | None = None, mode: str = "errorifexists") -> None:
    _text(df, json_line(fields), path, mode)


def write_csv(df: DataFrame, path: str, fields: Sequence[str] | None = None, mode: str = "errorifexists") -> None:
    """CSV with a header line in every part file."""
    out = select_fields(df, fields)
    out.write.mode(mode).csv(
        path,
        header=True,
        quote='"',
        escape='"',
        emptyValue="",
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
    )


def write_yaml(df: DataFrame, path: str, fields: Sequence[str] | None = None, mode: str = "errorifexists") -> None:
    _text(df, yaml_document(fields), path, mode)


RECORD_TIME = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def record_yaml(df: DataFrame) -> Column:
    """A whole record as a YAML list item; nested values in JSON form, which YAML includes."""
    rows = []
    for i, f in enumerate(df.schema.fields):
        c = F.col(f.name)
        simple = f.dataType.typeName() in ("long", "integer", "boolean", "double")
        text = c.cast("string") if simple else F.to_json(F.struct(c.alias("v")))
        value = text if simple else F.regexp_extract(text, r'(?s)\A\{"v":(.*)\}\z', 1)
        shown = F.coalesce(F.nullif(value, F.lit("")), F.lit("null"))
        rows.append(F.concat(F.lit(("- " if i == 0 else "  ") + f.name + ": "), shown))
    return F.concat_ws("\n", *rows)


def write_records(df: DataFrame, path: str, fmt: str = "json", mode: str = "errorifexists") -> None:
    """All fields with their nesting: ``json`` (one record per line), ``yaml`` or ``parquet``."""
    if fmt == "yaml":
        _text(df, record_yaml(df), path, mode)
    else:
        # JSON would cut times to milliseconds by default.
        options = {"timestampFormat": RECORD_TIME} if fmt == "json" else {}
        df.write.mode(mode).format(fmt).options(**options).save(path)
