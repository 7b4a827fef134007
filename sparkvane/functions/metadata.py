"""Typed reading and comparison of schemaless metadata (VARIANT objects or plain columns).

Integers and floats compare as doubles; booleans and strings equal only their own kind; NaN
equals nothing. Spark's own casts are more lenient, so kinds are tested first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Value = bool | int | float | str
_NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def path(key: str) -> str:
    if '"' in key and "'" in key:
        raise ValueError(f"a metadata key can't hold both kinds of quotes: {key}")
    return f"$['{key}']" if '"' in key else f'$["{key}"]'


class Field:
    """A metadata field as three typed columns, null where the value is of another kind."""

    def __init__(self, df: DataFrame, key: str, metadata: str = "metadata"):
        kinds = {f.name: f.dataType for f in df.schema}
        if isinstance(kinds.get(metadata), T.VariantType):
            v = F.try_variant_get(F.col(metadata), path(key), "variant")
            kind = F.schema_of_variant(v)
            number = kind.isin("BIGINT", "DOUBLE", "FLOAT", "INT", "SMALLINT", "TINYINT") | kind.startswith("DECIMAL")
            self.number = F.when(number, F.try_variant_get(v, "$", "double"))
            self.text = F.when(kind == "STRING", F.try_variant_get(v, "$", "string"))
            self.flag = F.when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean"))
            return
        kind, c, none = kinds.get(key), F.col(f"`{key}`"), F.lit(None)
        self.number = c.cast("double") if isinstance(kind, _NUMBERS) else none.cast("double")
        self.text = c if isinstance(kind, T.StringType) else none.cast("string")
        self.flag = c if isinstance(kind, T.BooleanType) else none.cast("boolean")

    def equals(self, value: Value) -> Column:
        if isinstance(value, bool):
            found = self.flag == F.lit(value)
        elif isinstance(value, (int, float)):
            found = (self.number == F.lit(float(value))) & ~F.isnan(self.number)
        elif isinstance(value, str):
            found = self.text == F.lit(value)
        else:
            raise TypeError(f"not a metadata value: {value!r}")
        return F.coalesce(found, F.lit(False))

    def within(self, low: float | None, high: float | None) -> Column:
        """Closed range of numbers; None is open."""
        found = ~F.isnan(self.number)
        if low is not None:
            found = found & (self.number >= F.lit(float(low)))
        if high is not None:
            found = found & (self.number <= F.lit(float(high)))
        return F.coalesce(found, F.lit(False))

    def key(self) -> Column:
        """A string by which equal values group together."""
        number = F.when(self.number == 0, F.lit("n:0.0")).otherwise(F.concat(F.lit("n:"), self.number.cast("string")))
        return F.coalesce(number, F.concat(F.lit("s:"), self.text), F.concat(F.lit("b:"), self.flag.cast("string")))
