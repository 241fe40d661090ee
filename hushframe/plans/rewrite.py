"""Rewriting a schema at plan time: decisions are made on field names, paths and metadata, and become one projection.

What a field's metadata says under the masker's key goes before the policy: "omit" leaves it out, a rule's name applies that rule.
A decided field of any type becomes a string; a column that a full rule hides is never read.

What only Python can decide (documents inside strings, rules and policies that are functions) is taken out of a column leaf by leaf,
as nested arrays of the column's own shape, and put back by position; so it works at any depth of structs, arrays and maps.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import detect, documents, rules
from ..model import ERROR_FIELDS, ERRORS, MAX_ERRORS, ErrorCode, Field, Kind, MaskError, Source
from ..policy import OMIT, Decision, fold_column

_NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
_TIMES = {T.TimestampType: "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'", T.TimestampNTZType: "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def kind_of(dtype: T.DataType) -> Kind:
    if isinstance(dtype, T.BooleanType):
        return Kind.BOOL
    if isinstance(dtype, _NUMBERS):
        return Kind.NUMBER
    if isinstance(dtype, (T.StructType, T.MapType)):
        return Kind.OBJECT
    return Kind.ARRAY if isinstance(dtype, T.ArrayType) else Kind.STRING


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), where f uses the value more than once: it is made once."""
    return F.get(F.transform(F.array(value), lambda v: f(v)), F.lit(0))


def _number_text(value: Column, low: int, high: int, least: int) -> Column:
    """Shortest digits: plain where the power of ten is from low up to below high, else d.dde+dd with `least` digits in a negative power; NULL for what is no number."""

    def parts(s: Column) -> Column:
        whole, part, power = (F.regexp_extract(s, r"^-?([0-9]+)\.([0-9]*?)0*(?:E(-?[0-9]+))?$", i) for i in (1, 2, 3))
        return F.struct(s.startswith("-").alias("minus"), whole.alias("whole"), F.concat(whole, part).alias("every"), F.when(power == "", 0).otherwise(F.try_to_number(power, F.lit("S99999")).cast("int")).alias("power"))

    def measured(x: Column) -> Column:
        digits = F.regexp_replace(x["every"], "^0+|0+$", "")
        # the decimal point stands after so many digits
        point = F.length(x["whole"]) + x["power"] - (F.length(x["every"]) - F.length(F.regexp_replace(x["every"], "^0+", "")))
        return F.struct(x["minus"].alias("minus"), digits.alias("digits"), F.length(digits).alias("n"), point.alias("point"))

    def text(x: Column) -> Column:
        digits, n, point = x["digits"], x["n"], x["point"]
        exponent, power = point - 1, F.abs(point - 1).cast("string")
        scientific = F.concat(F.left(digits, F.lit(1)), F.when(n > 1, F.concat(F.lit("."), F.substr(digits, F.lit(2)))).otherwise(""), F.when(exponent < 0, "e-").otherwise("e+"), F.lpad(power, F.greatest(F.when(exponent < 0, F.lit(least)).otherwise(2), F.length(power)), F.lit("0")))
        plain = F.when(point <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits)).when(n <= point, F.concat(digits, F.repeat(F.lit("0"), point - n))).otherwise(F.concat(F.left(digits, point), F.lit("."), F.substr(digits, point + 1)))
        return F.concat(F.when(x["minus"], "-").otherwise(""), F.when(digits == "", "0").when((exponent < low) | (exponent >= high), scientific).otherwise(plain))

    s = value.cast("string")
    return F.when(~s.isin("Infinity", "-Infinity", "NaN"), once(once(once(s, parts), measured), text))


def float_text(value: Column) -> Column:
    """A floating number's shortest digits: plain from 0.0001 up to below 1000000, else d.dde+dd; NaN, +Inf, -Inf."""
    s = value.cast("string")
    special = F.when(s == "Infinity", "+Inf").when(s == "-Infinity", "-Inf").when(s == "NaN", "NaN")
    return F.coalesce(special, _number_text(value, -4, 6, 2))


def json_float(value: Column) -> Column:
    """A floating number as JSON has it: plain from 0.000001 up to below 1e21, else d.dde-d; NULL where JSON has none."""
    return _number_text(value, -6, 21, 1)


#: What a JSON string has in place of characters, in this order; safe inside HTML as well.
_ESCAPES = [("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")]
_ESCAPES += [(c, f"\\u{ord(c):04x}") for c in [*map(chr, range(32)), "<", ">", "&", "\u2028", "\u2029"] if c not in "\n\r\t\b\f"]
_ESCAPES_SQL = "array(" + ", ".join(f"struct(decode(X'{a.encode().hex()}', 'UTF-8') AS a, decode(X'{b.encode().hex()}', 'UTF-8') AS b)" for a, b in _ESCAPES) + ")"
#: Stands for a value that can't be written; no JSON text holds it.
_BROKEN = "\0"


def json_string(value: Column) -> Column:
    """A string as JSON text; NULL is null."""
    pairs = F.expr(_ESCAPES_SQL)
    escaped = lambda v: F.when(v.rlike(r'["\\\x00-\x1f<>&\u2028\u2029]'), F.aggregate(pairs, v, lambda acc, p: F.replace(acc, p["a"], p["b"]))).otherwise(v)
    return F.coalesce(F.concat(F.lit('"'), once(value, escaped), F.lit('"')), F.lit("null"))


# ---- leaves for Python --------------------------------------------------------------------------------------------------

#: A leaf's result; action: 0 no opinion, 1 value, 2 left out.
_RESULT = "struct<value: string, action: int, errors: array<struct<" + ", ".join(f"{n}: {'int' if n == 'depth' else 'string'}" for n in ERROR_FIELDS) + ">>>"
#: A leaf's function: what to make of a value that is not NULL.
_Work = Callable[[object], tuple[str | None, int, list]]


def _leaf_udf(levels: int, work: _Work, steady: bool, told: bool):
    """The work on nested arrays of so many levels, in Arrow batches; steady: it says the same of equal values; told: actions and errors are given, else values only."""

    def run(values: pa.Array) -> pa.Array:
        shapes = []
        for _ in range(levels):
            offsets = values.offsets.to_numpy()
            shapes.append((pa.array(offsets - offsets[0]), values.is_null()))
            values = values.values.slice(int(offsets[0]), int(offsets[-1] - offsets[0]))
        known: dict = {}
        rows = []
        for v in values.to_pylist():
            key = tuple(v.values()) if isinstance(v, dict) else v
            out = known.get(key) if steady and v is not None else None
            if out is None:
                out = (None, None, None) if v is None else work(v)
                if steady and len(known) < documents.KEPT:
                    known[key] = out
            rows.append(out)
        out = pa.array([r[0] for r in rows], pa.string())
        if told:
            parts = [out, pa.array([r[1] for r in rows], pa.int32()), documents.errors_array([r[2] for r in rows])]
            out = pa.StructArray.from_arrays(parts, ["value", "action", "errors"], mask=pa.array([r[1] is None for r in rows], pa.bool_()))
        for offsets, empty in reversed(shapes):
            out = pa.ListArray.from_arrays(offsets, out, mask=empty)
        return out

    # the types are told here: this module's annotations are strings
    run.__annotations__ = {"values": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "array<" * levels + (_RESULT if told else "string") + ">" * levels)


@dataclass
class _Leaves:
    """What of one column goes to Python: by kind, path and rule, a nested array, its levels and the work on it; then the columns of results."""

    asked: dict[tuple, tuple[Column, int, _Work]] = field(default_factory=dict)
    found: dict[tuple, Column] = field(default_factory=dict)
    told: bool = False

    def value(self, key: tuple, at: list[Column]) -> Column:
        out = self.result(key, at)
        return out["value"] if self.told else out

    def result(self, key: tuple, at: list[Column]) -> Column:
        out = self.found[key]
        for i in at:
            out = F.get(out, i)
        return out


def _holds_containers(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.ArrayType, T.MapType)) or isinstance(dtype, T.StructType) and any(_holds_containers(f.dataType) for f in dtype)


def _markers(dtype: T.DataType, marker: str) -> Column:
    """A value of a masked type that shows nothing."""
    if isinstance(dtype, T.StructType):
        return F.struct(*(_markers(f.dataType, marker).alias(f.name) for f in dtype))
    return F.lit(marker) if isinstance(dtype, T.StringType) else F.lit(None).cast(dtype)


class Rewriter:
    def __init__(self, masker, told: bool = False):
        """told: errors are asked for."""
        self.m, self.c, self.told = masker, masker.config, told
        self.tags = rules.BUILT_IN | self.c.tag_rules
        self.by_rule: dict[rules.Rule, list[str]] = {}
        for k, r in (masker.policy.keys or {}).items():
            self.by_rule.setdefault(r, []).append(k)
        #: texts are masked in Python
        self.by_function = masker.by_function
        #: arrays of errors of the columns made so far
        self.errors: list[Column] = []

    def frame(self, df: DataFrame, errors: str | None = None) -> DataFrame:
        """df rewritten, and with a name for them the errors of each row. A row over the node limit shows nothing."""
        if len({f.name for f in df.schema}) < len(df.schema) or errors in df.columns:
            raise MaskError(ErrorCode.FIELD_CONFLICT, "columns of one name")
        out, nodes = [], F.lit(0).cast("long")
        for f in df.schema:
            value, where = F.col("`" + f.name.replace("`", "``") + "`"), Field(f.name, f"$[{f.name}]", Source.STRUCT)
            made = self.column(value, f.dataType, where, f.metadata or {})
            nodes = nodes + self.nodes(value, f.dataType, where, f.metadata or {})
            if made is not None:
                out.append(made.alias(f.name))
        over = nodes > self.c.max_nodes if any(_holds_containers(f.dataType) for f in df.schema) else F.lit(len(df.schema) > self.c.max_nodes)
        can_bind = any(_holds_containers(f.dataType) for f in df.schema) or len(df.schema) > self.c.max_nodes
        if not can_bind and errors is None:
            return df.select(*out)
        flag, told = ("__over", "__errors") if "__over" not in df.columns else ("__over_" + "_".join(df.columns), "__errors_" + "_".join(df.columns))
        step = df.select(*out, over.alias(flag), self.all_errors(over).alias(told))
        shown = [F.when(F.col(flag), _markers(f.dataType, self.c.redaction)).otherwise(F.col("`" + f.name.replace("`", "``") + "`")).alias(f.name) for f in step.schema[:-2]]
        return step.select(*shown, *([F.col(told).alias(errors)] if errors else []))

    def all_errors(self, over: Column | None = None) -> Column:
        """The errors of what was made, MAX_ERRORS at most."""
        none = F.array().cast(ERRORS)
        found = F.concat(none, *(F.coalesce(e, none) for e in self.errors))
        if over is None:
            return F.slice(found, 1, MAX_ERRORS)
        said = {"code": ErrorCode.NODE_LIMIT.value, "operation": "value", "path": "$", "depth": 0}
        limit = F.array(F.struct(*(F.lit(said.get(n, "")).alias(n) for n in ERROR_FIELDS)))
        return F.when(over, limit).otherwise(F.slice(found, 1, MAX_ERRORS))

    def decide(self, where: Field, metadata: dict) -> Decision:
        tag = metadata.get(self.c.metadata_key)
        if tag == "omit":
            return OMIT
        if tag is not None:
            if tag not in self.tags:
                raise MaskError(ErrorCode.INVALID_CONFIG, f"tag {tag!r}")
            return Decision(self.tags[tag])
        try:
            return self.m.policy.decide(where)
        except MaskError:
            raise
        except Exception:  # its text may hold what the policy knows
            raise MaskError(ErrorCode.POLICY_FAILURE, where.path) from None

    # -- a column with what Python makes of its leaves

    def column(self, value: Column, dtype: T.DataType, where: Field, metadata: dict) -> Column | None:
        """The rewritten column; None where it is left out."""
        return self._bound(value, dtype, where, metadata, self._column)

    def json(self, value: Column, dtype: T.DataType, where: Field, metadata: dict) -> Column | None:
        """The rewritten column as JSON text with sorted keys; _BROKEN in it for a number that JSON has not."""
        return self._bound(value, dtype, where, metadata, self._json)

    def _bound(self, value: Column, dtype: T.DataType, where: Field, metadata: dict, make: Callable) -> Column | None:
        leaves = _Leaves(told=self.told)
        self._gather(dtype, where, metadata, 0, lambda g: g(value), 0, leaves)
        results = [_leaf_udf(levels, work, key[0] != "rule" and not self.by_function, self.told or key[0] == "map")(nested) for key, (nested, levels, work) in leaves.asked.items()]
        for result, (_, levels, _) in zip(results, leaves.asked.values()) if self.told else ():
            errors = self._of(result, levels, lambda x: x["errors"])
            for _ in range(levels):
                errors = F.flatten(F.filter(errors, lambda e: e.isNotNull()))
            self.errors.append(errors)
        if not results or not _holds_containers(dtype):
            leaves.found = dict(zip(leaves.asked, results))
            return make(value, dtype, where, metadata, 0, [], leaves)

        def bound(s: Column) -> Column:
            leaves.found = {key: s[f"l{k}"] for k, key in enumerate(leaves.asked)}
            made = make(s["v"], dtype, where, metadata, 0, [], leaves)
            return F.lit(None) if made is None else made

        # no function of an array may call Python, but its argument may: the results are bound to a name first
        one = F.array(F.struct(value.alias("v"), *(r.alias(f"l{k}") for k, r in enumerate(results))))
        return F.get(F.transform(one, bound), F.lit(0))

    def _of(self, nested: Column, levels: int, part: Callable[[Column], Column]) -> Column:
        return part(nested) if not levels else F.transform(nested, lambda x: self._of(x, levels - 1, part))

    # -- what goes to Python

    def _gather(self, dtype: T.DataType, where: Field, metadata: dict, depth: int, get: Callable, levels: int, leaves: _Leaves) -> None:
        """get(g) is g of each value that stands at this place, in nested arrays of so many levels."""
        where = replace(where, kind=kind_of(dtype))
        found = self.decide(where, metadata) if depth <= self.c.max_depth else OMIT
        if found.omit:
            return
        if found.rule:
            if found.rule.python and self._partial(found.rule, dtype):
                leaves.asked["rule", where.path, found.rule] = (get(lambda x: self.text(x, dtype)), levels, self._rule_work(found.rule, where))
            return
        self._gather_open(dtype, where, metadata, depth, get, levels, leaves)

    def _gather_open(self, dtype: T.DataType, where: Field, metadata: dict, depth: int, get: Callable, levels: int, leaves: _Leaves) -> None:
        if isinstance(dtype, T.StructType):
            for f in dtype:
                self._gather(f.dataType, Field(f.name, f"{where.path}[{f.name}]", Source.STRUCT), f.metadata or {}, depth + 1, self._field(get, f.name), levels, leaves)
        elif isinstance(dtype, T.ArrayType):
            self._gather(dtype.elementType, Field("", f"{where.path}[]", where.source), {}, depth + 1, lambda g: get(lambda x: F.transform(x, lambda e: g(e))), levels + 1, leaves)
        elif isinstance(dtype, T.MapType):
            entries = lambda g: get(lambda x: F.transform(F.map_entries(x), lambda e: g(e)))
            inner = Field("", f"{where.path}[*]", Source.MAP, kind_of(dtype.valueType))
            text = lambda e: self.text(e["value"], dtype.valueType) if inner.kind not in (Kind.OBJECT, Kind.ARRAY) and not isinstance(dtype.valueType, T.BinaryType) else F.lit("")
            if self.m.policy.keys is None:
                leaves.asked["map", where.path] = (entries(lambda e: F.struct(F.when(F.is_valid_utf8(e["key"]), e["key"]).alias("key"), F.when(F.is_valid_utf8(text(e)), text(e)).alias("text"))), levels + 1, self._map_work(where, inner.kind))
            for rule, names in self.by_rule.items():
                if rule.python and self._partial(rule, dtype.valueType):
                    leaves.asked["rule", inner.path, rule] = (entries(lambda e, names=names: F.when(fold_column(e["key"]).isin(names), text(e))), levels + 1, self._rule_work(rule, inner))
            self._gather_open(dtype.valueType, inner, {}, depth + 1, lambda g: entries(lambda e: g(e["value"])), levels + 1, leaves)
        elif isinstance(dtype, T.StringType) and metadata.get("format") == "json":
            leaves.asked["json", where.path] = (get(lambda x: F.when(F.is_valid_utf8(x), x)), levels, self._document_work("json", where))
        elif isinstance(dtype, T.StringType) and (self.c.embedded or self.c.text_detectors and self.by_function):
            leaves.asked["string", where.path] = (get(lambda x: F.when(self._for_python(x), x)), levels, self._document_work("inspect", where))

    @staticmethod
    def _field(get: Callable, name: str) -> Callable:
        return lambda g: get(lambda x: g(x.getField(name)))

    def _for_python(self, value: Column) -> Column:
        """Whether a string looks like a document, or holds what a policy that is a function must judge."""
        looks = value.rlike(r"://|^[ \t\n\r]*[{\[]|^[^\s;]+=") if self.c.embedded else F.lit(False)
        if self.c.text_detectors and self.by_function:
            looks = looks | detect.may_hold(value, self.c.cards, self.c.aws_key_ids)
        return F.coalesce(F.is_valid_utf8(value) & looks, F.lit(False))

    def _document_work(self, name: str, where: Field) -> _Work:
        policy, config, path = self.m.policy, self.c, where.path
        marker = config.redaction

        def inspect(operation, value):
            return operation.inspect(value, path)

        what, fallback = (documents.Operation.json, documents.encode_string(marker)) if name == "json" else (inspect, marker)

        def work(value):
            out, errors = documents.run(policy, config, what, value, fallback)
            return out, 1, errors

        return work

    def _rule_work(self, rule: rules.Rule, where: Field) -> _Work:
        policy, config = self.m.policy, self.c

        def work(value):
            operation = documents.Operation(policy, config, "value")
            return operation.apply(rule, where, value), 1, operation.errors

        return work

    def _map_work(self, where: Field, kind: Kind) -> _Work:
        policy, config = self.m.policy, self.c

        def work(entry):
            operation = documents.Operation(policy, config, "value")
            if entry["key"] is None:
                operation.fail(ErrorCode.INVALID_UTF8, where.path)
                return config.redaction, 1, operation.errors
            out = operation.decide(Field(entry["key"], f"{where.path}[{entry['key']}]", Source.MAP, kind), entry["text"] or "")
            return (None, 2, operation.errors) if out is documents.OMITTED else (out, int(out is not None), operation.errors)

        return work

    # -- the value

    def _enter(self, dtype: T.DataType, where: Field, metadata: dict, depth: int) -> tuple[Field, Decision]:
        if depth > self.c.max_depth:
            raise MaskError(ErrorCode.DEPTH_LIMIT, where.path)
        where = replace(where, kind=kind_of(dtype))
        return where, self.decide(where, metadata)

    def _column(self, value: Column, dtype: T.DataType, where: Field, metadata: dict, depth: int, at: list[Column], leaves: _Leaves) -> Column | None:
        where, found = self._enter(dtype, where, metadata, depth)
        if found.omit:
            return None
        if found.rule:
            return self._applied(found.rule, value, dtype, where, at, leaves)
        return self._open(value, dtype, where, metadata, depth, at, leaves)

    def _partial(self, rule: rules.Rule, dtype: T.DataType) -> bool:
        """Whether the rule is given the value: a whole subtree, or bytes, give it no text."""
        return not rule.full and kind_of(dtype) not in (Kind.OBJECT, Kind.ARRAY) and not isinstance(dtype, T.BinaryType)

    def _applied(self, rule: rules.Rule, value: Column, dtype: T.DataType, where: Field, at: list[Column], leaves: _Leaves) -> Column:
        if not self._partial(rule, dtype):
            return F.lit(self.c.redaction)
        if ("rule", where.path, rule) in leaves.found:
            return F.coalesce(leaves.value(("rule", where.path, rule), at), F.lit(self.c.redaction))
        return rule(self.text(value, dtype), self.c.redaction)

    def text(self, value: Column, dtype: T.DataType) -> Column:
        """A scalar's text; instants in UTC, floating numbers as short as they can be."""
        if isinstance(dtype, (T.FloatType, T.DoubleType)):
            return float_text(value)
        for kind, pattern in _TIMES.items():
            if isinstance(dtype, kind):
                value = F.to_utc_timestamp(value, F.current_timezone()) if kind is T.TimestampType else value
                return F.regexp_replace(F.date_format(value, pattern), r"(?:\.0+|(\.\d*[1-9])0+)(Z?)$", "$1$2")
        return value.cast("string")

    def _open(self, value: Column, dtype: T.DataType, where: Field, metadata: dict, depth: int, at: list[Column], leaves: _Leaves) -> Column:
        """A value without an opinion on it."""
        if isinstance(dtype, T.StructType):
            parts = [made.alias(f.name) for f, made in self._fields(self._column, value, dtype, where, depth, at, leaves)]
            made = F.struct(*parts) if parts else F.struct(F.lit(None).cast("string").alias("_"))
            return F.when(value.isNotNull(), made)
        if isinstance(dtype, T.ArrayType):
            return F.transform(value, self._element(self._column, dtype, where, depth, at, leaves, F.lit(None).cast("string")))
        if isinstance(dtype, T.MapType):
            scalar = kind_of(dtype.valueType) not in (Kind.OBJECT, Kind.ARRAY)
            inner = self._open if scalar else self._open_json
            kept = self._entries(value, dtype, where, depth, at, leaves, lambda v, w, a: inner(v, dtype.valueType, w, {}, depth + 1, a, leaves).cast("string"), lambda out: out)
            return F.map_from_entries(kept)
        if isinstance(dtype, (T.BooleanType, *_NUMBERS)) and self.c.preserve_safe:
            return value
        return self._scalar(value, dtype, where, metadata, at, leaves)

    def _fields(self, make: Callable, value: Column, dtype: T.StructType, where: Field, depth: int, at: list[Column], leaves: _Leaves) -> list[tuple[T.StructField, Column]]:
        if len({f.name for f in dtype}) < len(dtype):
            raise MaskError(ErrorCode.FIELD_CONFLICT, where.path)
        made = ((f, make(value.getField(f.name), f.dataType, Field(f.name, f"{where.path}[{f.name}]", Source.STRUCT), f.metadata or {}, depth + 1, at, leaves)) for f in dtype)
        return [(f, c) for f, c in made if c is not None]

    def _element(self, make: Callable, dtype: T.ArrayType, where: Field, depth: int, at: list[Column], leaves: _Leaves, gone: Column) -> Callable:
        def one(x: Column, i: Column) -> Column:
            made = make(x, dtype.elementType, Field("", f"{where.path}[]", where.source), {}, depth + 1, [*at, i], leaves)
            return gone if made is None else made

        return one

    def _entries(self, value: Column, dtype: T.MapType, where: Field, depth: int, at: list[Column], leaves: _Leaves, safe: Callable, said: Callable) -> Column:
        """array<struct<key, value>> of a map's entries that stay; said() is what a rule's text becomes."""
        if not isinstance(dtype.keyType, T.StringType):
            raise MaskError(ErrorCode.UNSUPPORTED_MAP_KEY, where.path)
        inner = Field("", f"{where.path}[*]", Source.MAP)

        def one(e: Column, i: Column) -> Column:
            out, gone = safe(e["value"], inner, [*at, i]), F.lit(False)
            for rule, names in self.by_rule.items():
                out = F.when(fold_column(e["key"]).isin(names), said(self._applied(rule, e["value"], dtype.valueType, inner, [*at, i], leaves))).otherwise(out)
            if self.m.policy.keys is None:
                found = leaves.result(("map", where.path), [*at, i])
                out, gone = F.when(found["action"] == 1, said(found["value"])).otherwise(out), found["action"] == 2
            return F.struct(e["key"].alias("key"), out.alias("value"), gone.alias("gone"))

        kept = F.filter(F.transform(F.map_entries(value), one), lambda e: ~e["gone"])
        return F.transform(kept, lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))

    def _scalar(self, value: Column, dtype: T.DataType, where: Field, metadata: dict, at: list[Column], leaves: _Leaves) -> Column:
        """The text of a value that is no container."""
        if isinstance(dtype, T.StringType):
            marker = F.lit(self.c.redaction)
            if ("json", where.path) in leaves.found:
                return F.when(value.isNotNull(), F.coalesce(leaves.value(("json", where.path), at), F.lit(documents.encode_string(self.c.redaction))))
            own = self.m.mask_text(value) if self.c.text_detectors and not self.by_function else value
            if ("string", where.path) in leaves.found:
                own = F.when(self._for_python(value), F.coalesce(leaves.value(("string", where.path), at), marker)).otherwise(own)
                own = F.when(F.is_valid_utf8(value) | value.isNull(), own).otherwise(marker)
            return own
        if isinstance(dtype, T.BinaryType):
            text = value.cast("string")
            secret = detect.is_candidate(text, self.c.cards, self.c.aws_key_ids)
            if not self.by_function:
                secret = secret & (self.m.mask_text(text) != text)
            if not self.c.text_detectors:
                secret = F.lit(False)
            return F.when(value.isNull(), F.lit(None)).when(F.coalesce(F.is_valid_utf8(text), F.lit(False)) & secret, F.lit(self.c.redaction)).otherwise(F.base64(value))
        if isinstance(dtype, (T.BooleanType, *_NUMBERS, T.DateType, T.TimestampType, T.TimestampNTZType, T.DayTimeIntervalType, T.YearMonthIntervalType)):
            return self.text(value, dtype)
        raise MaskError(ErrorCode.UNSUPPORTED_TYPE, f"{where.path}: {dtype.simpleString()}")

    # -- the value as JSON text

    def _json(self, value: Column, dtype: T.DataType, where: Field, metadata: dict, depth: int, at: list[Column], leaves: _Leaves) -> Column | None:
        where, found = self._enter(dtype, where, metadata, depth)
        if found.omit:
            return None
        if found.rule:
            return json_string(self._applied(found.rule, value, dtype, where, at, leaves))
        return self._open_json(value, dtype, where, metadata, depth, at, leaves)

    def _open_json(self, value: Column, dtype: T.DataType, where: Field, metadata: dict, depth: int, at: list[Column], leaves: _Leaves) -> Column:
        if isinstance(dtype, T.StructType):
            members = sorted(self._fields(self._json, value, dtype, where, depth, at, leaves), key=lambda m: m[0].name.encode())
            parts = [F.concat(F.lit(documents.encode_string(f.name) + ":"), text) for f, text in members]
            made = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
        elif isinstance(dtype, T.ArrayType):
            made = F.concat(F.lit("["), F.array_join(F.transform(value, self._element(self._json, dtype, where, depth, at, leaves, F.lit("null"))), ","), F.lit("]"))
        elif isinstance(dtype, T.MapType):
            kept = self._entries(value, dtype, where, depth, at, leaves, lambda v, w, a: self._open_json(v, dtype.valueType, w, {}, depth + 1, a, leaves), json_string)
            made = F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(kept), lambda e: F.concat(json_string(e["key"]), F.lit(":"), e["value"])), ","), F.lit("}"))
        elif self.c.preserve_safe and isinstance(dtype, (T.FloatType, T.DoubleType)):
            made = F.coalesce(json_float(value), F.lit(_BROKEN))
        elif self.c.preserve_safe and isinstance(dtype, (T.BooleanType, *_NUMBERS)):
            made = value.cast("string")
        elif isinstance(dtype, T.StringType) and metadata.get("format") == "json":
            made = self._scalar(value, dtype, where, metadata, at, leaves)  # a member that is a document stays one
        else:
            return json_string(self._scalar(value, dtype, where, metadata, at, leaves))
        return F.when(value.isNotNull(), made).otherwise("null")

    def document(self, value: Column, dtype: T.DataType) -> Column:
        """A value masked and written as a JSON document; the marker as a JSON string if anything fails."""
        fallback = F.lit(documents.encode_string(self.c.redaction))
        text = self.json(value, dtype, Field("", "$", Source.ANY), {})
        if text is None:
            return F.lit("null")
        nodes = self.nodes(value, dtype, Field("", "$", Source.ANY), {})
        failed = text.contains(_BROKEN) | (nodes > self.c.max_nodes)
        if self.errors:
            failed = failed | (F.size(self.all_errors()) > 0)
        return F.when(failed, fallback).otherwise(text)

    # -- budgets

    def nodes(self, value: Column, dtype: T.DataType, where: Field, metadata: dict) -> Column:
        """How many values masking enters: each field, element and entry, but nothing below what is decided."""
        found = self.decide(replace(where, kind=kind_of(dtype)), metadata)
        one = F.lit(0 if metadata.get(self.c.metadata_key) == "omit" else 1).cast("long")
        return one if found else self._below(value, dtype, where)

    def _below(self, value: Column, dtype: T.DataType, where: Field) -> Column:
        one = F.lit(1).cast("long")
        if isinstance(dtype, T.StructType):
            for f in dtype:
                one = one + self.nodes(value.getField(f.name), f.dataType, Field(f.name, f"{where.path}[{f.name}]", Source.STRUCT), f.metadata or {})
            return F.when(value.isNotNull(), one).otherwise(1)
        if isinstance(dtype, (T.ArrayType, T.MapType)):
            inner, items = (dtype.elementType, value) if isinstance(dtype, T.ArrayType) else (dtype.valueType, F.map_values(value))
            at = Field("", f"{where.path}[]", where.source) if isinstance(dtype, T.ArrayType) else Field("", f"{where.path}[*]", Source.MAP)
            if kind_of(inner) not in (Kind.OBJECT, Kind.ARRAY):
                return one + F.when(value.isNotNull(), F.size(value)).otherwise(0)
            return one + F.coalesce(F.aggregate(F.transform(items, lambda x: self._below(x, inner, at)), F.lit(0).cast("long"), lambda a, b: a + b), F.lit(0))
        return one
