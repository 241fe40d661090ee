"""The public masker: column functions and whole-frame masking under one policy and one configuration."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import detect, documents
from .functions.rules import Rule
from .model import ERROR_FIELDS, ERRORS, MASKED, Field, Kind, MaskConfig, Source
from .plans import rewrite
from .policy import Policy, default_policy


@dataclass(frozen=True)
class Masker:
    """Immutable. Columns in, columns out: masking never shuffles, never collects and never fails a job for a value."""

    policy: Policy = field(default_factory=default_policy)
    config: MaskConfig = MaskConfig()

    @property
    def by_function(self) -> bool:
        """Whether texts are masked in Python: a policy, or a rule of a key policy, is a function."""
        return self.policy.keys is None or any(r.python for r in self.policy.keys.values())

    # -- values

    def mask_string(self, value: Column, rule: Rule) -> Column:
        """A string column under a rule."""
        return rule(value, self.config.redaction)

    def mask_column(self, value: Column, dtype: T.DataType, where: Field = Field()) -> Column | None:
        """A column of any type under the policy; None if the policy leaves it out."""
        return rewrite.Rewriter(self).column(value, dtype, where, {})

    def mask_value(self, value: Column, key: str, dtype: T.DataType = T.StringType()) -> Column | None:
        return self.mask_column(value, dtype, Field(key, f"$[{key}]", Source.MAP))

    def mask_dataframe(self, df: DataFrame) -> DataFrame:
        """df with each column rewritten by the policy and by field metadata; columns left out are gone. One projection."""
        return rewrite.Rewriter(self).frame(df)

    def mask_dataframe_checked(self, df: DataFrame, errors: str = "errors") -> DataFrame:
        """mask_dataframe(), and a column with each row's errors: where a rule, a policy or a document failed, or the node limit was passed."""
        return rewrite.Rewriter(self, told=True).frame(df, errors)

    # -- documents and text

    def _document(self, value: Column, what, fallback: str) -> Column:
        policy, config = self.policy, self.config

        run = arrow(lambda values: documents.frame(policy, config, what, values, fallback), MASKED)

        # invalid UTF-8 never reaches Python
        said = {"code": "invalid_utf8", "operation": documents.name_of(what), "path": "$", "depth": 0}
        bad = F.struct(F.lit(fallback).alias("value"), F.array(F.struct(*(F.lit(said.get(n, "")).alias(n) for n in ERROR_FIELDS))).alias("errors"))
        return F.when(~F.is_valid_utf8(value), bad).otherwise(run(F.when(F.is_valid_utf8(value), value)))

    def mask_json(self, value: Column) -> Column:
        """struct<value, errors> of JSON documents: keys sorted, numbers as written, the marker as a JSON string on any error."""
        return self._document(value, documents.Operation.json, documents.encode_string(self.config.redaction))

    def inspect(self, value: Column) -> Column:
        """struct<value, errors> of strings that may be URLs, JSON, forms or text."""
        return self._document(value, documents.Operation.inspect, self.config.redaction)

    def mask_url(self, value: Column, preserve_fragment: bool = False) -> Column:
        """struct<value, errors> of absolute or relative URLs."""
        return self._document(value, lambda op, v: op.url(v, preserve_fragment), self.config.redaction)

    def mask_text(self, value: Column) -> Column:
        """Free text, keys and secrets in it masked. With a key policy Java patterns do it all; policies and rules that are functions take Arrow batches."""
        if self.by_function:
            return self._document(value, documents.Operation.free_text, self.config.redaction)["value"]
        c = self.config
        out = detect.mask_text(value, self.policy.keys, c.redaction, c.cards, c.aws_key_ids)
        return F.when(value.isNull(), F.lit(None)).when(~F.is_valid_utf8(value) | (F.octet_length(value) > c.max_input_bytes), F.lit(c.redaction)).otherwise(out)

    def detect_spans(self, value: Column) -> Column:
        return detect.detect_spans(value, self.config.cards, self.config.aws_key_ids)

    def detect_pairs(self, value: Column) -> Column:
        return detect.detect_pairs(value)

    def locate(self, value: Column) -> Column:
        """array<struct<kind, key, begin, end>>: where the keys and values and the secrets of a text stand, in characters from 0."""
        return self._locate()(F.when(F.is_valid_utf8(value), value))

    def _locate(self):
        c, kind = self.config, pa.list_(pa.struct([("kind", pa.string()), ("key", pa.string()), ("begin", pa.int32()), ("end", pa.int32())]))
        names = ("kind", "key", "begin", "end")
        return arrow(lambda values: pa.array([None if v is None else [dict(zip(names, f)) for f in detect.locate_row(v, c.cards, c.aws_key_ids)] for v in values.to_pylist()], kind), "array<struct<kind: string, key: string, begin: int, end: int>>")

    def mask_headers(self, headers: Column) -> Column:
        """map<string, array<string>> of HTTP headers: cookies and what the policy names become markers, other values are inspected.

        A header whose values are all left out, or that the policy leaves out, is dropped. Header decisions are full whatever the rule. A key that is NULL or
        values that are NULL count as empty; a value that can't be masked is the marker. Only maps with a value that may hold something go to Python.
        """
        from .policy import fold_column

        c = self.config
        if self.policy.keys is None:
            return self._headers(headers)["value"]
        keys = list(self.policy.keys)
        known = lambda k: F.lower(k).isin("cookie", "set-cookie") | (fold_column(k).isin(keys) if keys else F.lit(False))
        open_ = lambda v: detect.may_hold(v, c.cards, c.aws_key_ids, c.embedded) | (F.octet_length(v) > c.max_input_bytes) | ~F.is_valid_utf8(v)
        suspicious = F.exists(F.map_entries(headers), lambda e: ~known(e["key"]) & F.exists(F.coalesce(e["value"], F.array().cast("array<string>")), lambda v: F.coalesce(open_(v), F.lit(False))))
        plain = F.transform_values(headers, lambda k, vs: F.when(known(k), F.transform(vs, lambda _: F.lit(c.redaction))).otherwise(vs))
        return F.when(F.coalesce(suspicious, F.lit(False)), self._headers(F.when(suspicious, headers))["value"]).otherwise(F.map_filter(plain, lambda _, vs: F.size(vs) > 0))

    def mask_headers_checked(self, headers: Column) -> Column:
        """struct<value, errors> of headers: with any error no header is given, and the errors say why."""
        both = self._headers(headers)
        none = F.create_map().cast("map<string,array<string>>")
        return F.struct(F.when(F.size(both["errors"]) > 0, none).otherwise(both["value"]).alias("value"), both["errors"].alias("errors"))

    def _headers(self, headers: Column) -> Column:
        """struct<value, errors> of headers, a whole map in Python at once."""
        policy, config = self.policy, self.config
        returned = T.StructType([T.StructField("value", T.MapType(T.StringType(), T.ArrayType(T.StringType()))), T.StructField("errors", ERRORS)])

        run = arrow(lambda maps: documents.headers_frame(policy, config, maps), returned)
        # values that are no UTF-8 never reach Python
        safe = F.transform_values(headers, lambda _, vs: F.transform(vs, lambda v: F.when(F.is_valid_utf8(v), v).when(v.isNotNull(), F.lit(config.redaction))))
        return run(safe)

    def mask_to_json(self, value: Column, dtype: T.DataType) -> Column:
        """A value of any type masked and written as JSON text with sorted keys: what mask_dataframe() gives, as a document.

        dtype is the value's type, tags in field metadata included. Undecided numbers and booleans are texts, or JSON's own with preserve_safe. With any
        error, a number that JSON has not (NaN), or over the node limit the result is the marker.
        """
        return rewrite.Rewriter(self, told=True).document(value, dtype)

    def rows_to_json(self, df: DataFrame) -> DataFrame:
        """One column `value`: each row masked, tags counted, as a JSON document with sorted keys."""
        row = F.struct(*(F.col("`" + c.replace("`", "``") + "`") for c in df.columns))
        return df.select(self.mask_to_json(row, df.schema).alias("value"))

    # -- SQL

    def register(self, spark: SparkSession) -> None:
        """SQL functions mask_json, mask_url, mask_inspect, mask_text (text results), mask_headers and locate, and the table function detect(text).

        locate(text) works in Arrow batches: `LATERAL VIEW inline(locate(text))` gives a row for each pair and secret of a table's texts.
        """
        for name, what, fallback in (
            ("mask_json", documents.Operation.json, documents.encode_string(self.config.redaction)), ("mask_url", documents.Operation.url, self.config.redaction),
            ("mask_inspect", documents.Operation.inspect, self.config.redaction), ("mask_text", documents.Operation.free_text, self.config.redaction),
        ):
            spark.udf.register(name, self._plain(what, fallback))
        policy, config = self.policy, self.config
        spark.udf.register("mask_headers", arrow(lambda maps: documents.headers_frame(policy, config, maps).field("value"), "map<string,array<string>>"))

        spark.udf.register("locate", self._locate())

        class Detect:
            """A row for each pair and secret of a text; a text's rows are made together."""

            def eval(self, text: str):
                yield from detect.locate_row(text or "", config.cards, config.aws_key_ids)

        spark.udtf.register("detect", F.udtf(Detect, returnType="kind: string, key: string, begin: int, end: int", useArrow=True))

    def _plain(self, what, fallback: str):
        policy, config = self.policy, self.config
        return arrow(lambda values: documents.texts(policy, config, what, values, fallback), "string")


def arrow(work: Callable[[pa.Array], pa.Array], returned: T.DataType | str):
    """A function of Arrow arrays as a Column function."""

    def run(values: pa.Array) -> pa.Array:
        return work(values)

    run.__annotations__ = {"values": pa.Array, "return": pa.Array}  # as types: here annotations are strings
    return F.arrow_udf(run, returned)


__all__ = ["Masker", "Field", "Kind", "Source", "MaskConfig"]
