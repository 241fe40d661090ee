"""Log records: each column an attribute, each struct a group of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import Field, Source
from ..plans.rewrite import Rewriter, kind_of

#: Attributes of the record itself, and the types with which they pass.
PASSTHROUGH = {"time": (T.TimestampType, T.TimestampNTZType), "level": (T.StringType,), "source": (T.StructType, T.StringType)}


def mask_log_records(masker, df: DataFrame, passthrough: dict = PASSTHROUGH) -> DataFrame:
    """df with its attributes masked. Undecided scalars keep their type; strings are searched.

    What the policy, or a field's metadata, says of a group holds for all in it, the outermost first: a rule or an omission makes all its members
    markers. An attribute left out at the top goes; within a group it becomes a marker.
    """
    out = []
    plan = Rewriter(masker)
    for f in df.schema:
        value = F.col("`" + f.name.replace("`", "``") + "`")
        if isinstance(f.dataType, passthrough.get(f.name, ())) and not (f.metadata or {}).get(masker.config.metadata_key):
            out.append(value)
            continue
        made = _attribute(plan, value, f.dataType, Field(f.name, f"$[{f.name}]", Source.ANY), f.metadata or {}, False)
        if made is not None:
            out.append(made.alias(f.name))
    return df.select(*out)


def _attribute(plan: Rewriter, value: Column, dtype: T.DataType, where: Field, metadata: dict, inside: bool) -> Column | None:
    marker, config = plan.c.redaction, plan.c
    found = plan.decide(Field(where.key, where.path, where.source, kind_of(dtype)), metadata)
    if isinstance(dtype, T.StructType):
        if found:
            return _markers(dtype, marker)
        parts = [_attribute(plan, value.getField(f.name), f.dataType, Field(f.name, f"{where.path}[{f.name}]", where.source), f.metadata or {}, True).alias(f.name) for f in dtype]
        return F.when(value.isNotNull(), F.struct(*parts))
    if found.omit:
        return F.lit(marker) if inside else None
    if not found.rule and isinstance(dtype, (T.LongType, T.DecimalType)) and config.cards:  # a number may be a card's
        return F.when(value.isNotNull(), plan.m.mask_text(value.cast("string")))
    if found.rule or isinstance(dtype, (T.StringType, T.ArrayType, T.MapType, T.BinaryType)):
        return plan.column(value, dtype, where, metadata)
    return value


def _markers(dtype: T.StructType, marker: str) -> Column:
    return F.struct(*((_markers(f.dataType, marker) if isinstance(f.dataType, T.StructType) else F.lit(marker)).alias(f.name) for f in dtype))
