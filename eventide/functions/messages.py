"""Message encode / decode and keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Messages print times to the whole second and keep null fields as JSON null.
JSON_OPTIONS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss", "ignoreNullFields": "false",
                "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss"}
READ_OPTIONS = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]",
                "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]", "mode": "PERMISSIVE"}

DEFAULT_KEY_ATTRS = ("AccountId", "ModelId")


def message_key(df: DataFrame, attrs: Sequence[str] = DEFAULT_KEY_ATTRS) -> Column:
    """``AccountId='1', ModelId='m'``; an attribute the message lacks prints as ''.

    A present-but-null attribute prints ``None`` (as the reference's string formatting does).
    """
    parts: list[Column] = []
    for a in attrs:
        if a in df.columns:
            v = F.coalesce(F.col(a).cast("string"), F.lit("None"))
            parts.append(F.concat(F.lit(f"{a}='"), v, F.lit("'")))
        else:
            parts.append(F.lit(""))
    return F.concat_ws(", ", *parts)


def to_message(schema: T.StructType) -> Column:
    """One JSON text per row, fields in schema order."""
    return F.to_json(F.struct(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields]),
                     JSON_OPTIONS)


def from_message(value: Column, schema: T.StructType) -> Column:
    """Parse a JSON text into a struct; malformed text gives a NULL struct."""
    return F.from_json(value, schema, READ_OPTIONS)


def encode_messages(df: DataFrame, schema: T.StructType,
                    key_attrs: Sequence[str] = DEFAULT_KEY_ATTRS) -> DataFrame:
    """Projection to (key, value) ready for a topic sink."""
    proj = df.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields])
    return proj.select(message_key(proj, key_attrs).alias("key"), to_message(schema).alias("value"))
