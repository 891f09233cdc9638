"""Dynamic JSON properties as typed values, canonical JSON, and small text helpers."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NUMERIC = r"^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL|BOOLEAN)"


@dataclass(frozen=True)
class Value:
    """A column with what is known of its type: ``string``, ``number``, ``bool`` or ``variant``."""

    column: Column
    kind: str

    @staticmethod
    def of(column: Column, data_type: T.DataType) -> Value:
        if isinstance(data_type, T.BooleanType):
            return Value(column, "bool")
        return Value(column, "number" if isinstance(data_type, T.NumericType) else "string")

    @staticmethod
    def property(properties: Column, name: str) -> Value:
        """The property ``name`` of a JSON object column; absent and JSON null alike are null."""
        path = "$." + name
        got = F.try_variant_get(F.try_parse_json(properties), path, "variant")
        return Value(F.when(~F.is_variant_null(got), got), "variant")

    def shown(self) -> Column:
        """The value as a result column: booleans as 1 and 0, dynamic values as text."""
        if self.kind == "bool":
            return self.column.cast("int")
        return self.text() if self.kind == "variant" else self.column

    def text(self) -> Column:
        if self.kind == "variant":
            kind = F.schema_of_variant(self.column)
            plain = F.try_variant_get(self.column, "$", "string")
            return (
                F.when(kind == "BOOLEAN", F.try_variant_get(self.column, "$", "boolean").cast("int").cast("string"))
                .when(kind.rlike("^(OBJECT|ARRAY|STRUCT)"), F.to_json(self.column))
                .otherwise(plain)
            )
        return self.column.cast("int").cast("string") if self.kind == "bool" else self.column.cast("string")

    def equals(self, literal: str | float | bool | None) -> Column:
        """Three-valued equality without coercion between text and numbers; booleans count as 1 and 0."""
        known = self.column.isNotNull()
        if literal is None:
            return F.lit(None).cast("boolean")
        if isinstance(literal, str):
            if self.kind in ("number", "bool"):
                return F.when(known, F.lit(False))
            if self.kind == "variant":
                is_text = ~F.schema_of_variant(self.column).rlike(_NUMERIC)
                return F.when(known, is_text & (self.text() == literal))
            return self.column == literal
        number = float(literal)
        if self.kind == "string":
            return F.when(known, F.lit(False))
        if self.kind == "variant":
            is_number = F.schema_of_variant(self.column).rlike(_NUMERIC)
            return F.when(known, is_number & (F.coalesce(F.try_variant_get(self.column, "$", "double"), F.lit(float("nan"))) == number))
        if self.kind == "bool":
            return self.column.cast("int") == number
        return self.column == (int(literal) if number.is_integer() else number)

    def order_keys(self) -> list[Column]:
        """Columns that sort as null < numbers < text."""
        if self.kind != "variant":
            return [self.column]
        number = F.schema_of_variant(self.column).rlike(_NUMERIC)
        return [
            F.when(self.column.isNull(), 0).when(number, 1).otherwise(2),
            F.when(number, F.try_variant_get(self.column, "$", "double")),
            F.when(~number, self.text()),
        ]


def canonical_json(column: Column) -> Column:
    """JSON text with the keys of every object sorted; text that isn't JSON stays as it is."""
    return F.coalesce(F.to_json(F.try_parse_json(column)), column)


def property_is(properties: Column, name: str, wanted) -> Column:
    """Type-strict equality of one property with a JSON value; a missing property equals nothing, not even null."""
    got = F.try_variant_get(F.try_parse_json(properties), "$." + name, "variant")
    if wanted is None:
        return F.coalesce(F.is_variant_null(got), F.lit(False))
    text = F.to_json(F.parse_json(F.lit(json.dumps(wanted, ensure_ascii=False))))
    return F.coalesce((F.to_json(got) == text) & ~F.is_variant_null(got), F.lit(False))


def ignore_case(pattern: str) -> str:
    """``pattern`` as a Java pattern that ignores case; raises on one that no engine takes."""
    try:
        re.compile(pattern)
    except re.error as e:
        raise ValueError(f"Invalid pattern {pattern!r}: {e}") from e
    return "(?iu)" + pattern


def glob_pattern(glob: str) -> str:
    """``*`` stands for anything; ``?`` makes the character before it optional; the rest is literal."""
    return "(?iu)" + "".join(".*" if c == "*" else "?" if c == "?" else re.escape(c) for c in glob)


def shortened(column: Column, most: int = 200) -> Column:
    return F.when(F.length(column) > most, F.concat(F.substring(column, 1, most), F.lit("…"))).otherwise(column)


def approximate_tokens(column: Column) -> Column:
    return F.ceil(F.length(column) / 4).cast("long")


def text_sha1(column: Column) -> Column:
    return F.sha1(column)
