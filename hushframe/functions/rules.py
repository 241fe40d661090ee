"""Rules: what becomes of a value that a policy has decided on. Built-in ones are Column expressions and row functions alike."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import ErrorCode, MaskError

CONTROL = r"[\p{Cc}\p{Cf}\p{Zl}\p{Zp}]"
_CONTROL_OR_SPACE = r"[\p{Cc}\p{Cf}\p{Zl}\p{Zp}\p{Zs}]"


@dataclass(frozen=True)
class Rule:
    """A name, a Column function (value, marker) and a row function (value, marker). Two rules are the same if they are equal."""

    name: str
    column: Callable[[Column, str], Column]
    row: Callable[[str, str], str]
    full: bool = False
    #: the row function is the rule, and its Column form only calls it in Arrow batches
    python: bool = False

    def __call__(self, value: Column, marker: str) -> Column:
        """The rule on a string column. NULL and invalid UTF-8 become the marker."""
        if self.full:
            return F.lit(marker)
        return F.when(value.isNull() | ~F.is_valid_utf8(value), F.lit(marker)).otherwise(self.column(value, marker))


def _email_column(v: Column, marker: str) -> Column:
    bad = v.rlike(_CONTROL_OR_SPACE) | ~v.rlike(r"^[^@]+@[^@]+\z")
    return F.when(bad, F.lit(marker)).otherwise(F.concat(F.substring(v, 1, 1), F.lit("***@"), F.substring_index(v, "@", -1)))


def _digits_column(v: Column, marker: str) -> Column:
    fits = v.rlike(r"^[0-9 +\-()./]*\z") & (F.length(F.regexp_replace(v, "[^0-9]", "")) > 4)
    return F.when(~fits, F.lit(marker)).otherwise(F.regexp_replace(v, r"[0-9](?=(?:[^0-9]*[0-9]){4})", "*"))


def _id_column(v: Column, marker: str) -> Column:
    bad = v.rlike(CONTROL) | (F.length(v) <= 4)
    head = F.regexp_replace(F.left(v, F.length(v) - 4), r"[^\p{Zs}]", "*")
    return F.when(bad, F.lit(marker)).otherwise(F.concat(head, F.right(v, F.lit(4))))


def _control(text: str, spaces: bool) -> bool:
    import unicodedata

    return any(unicodedata.category(c) in ("Cc", "Cf", "Zl", "Zp", *(("Zs",) if spaces else ())) for c in text)


def _email_row(v: str, marker: str) -> str:
    name, at, host = v.partition("@")
    return f"{name[0]}***@{host}" if name and at and host and "@" not in host and not _control(v, True) else marker


def _digits_row(v: str, marker: str) -> str:
    digits = sum(c in "0123456789" for c in v)
    if digits <= 4 or not re.fullmatch(r"[0-9 +\-()./]*", v):
        return marker
    return re.sub(r"[0-9](?=(?:[^0-9]*[0-9]){4})", "*", v)


def _id_row(v: str, marker: str) -> str:
    import unicodedata

    if len(v) <= 4 or _control(v, False):
        return marker
    return "".join(c if unicodedata.category(c) == "Zs" else "*" for c in v[:-4]) + v[-4:]


def _full(name: str) -> Rule:
    return Rule(name, lambda v, m: F.lit(m), lambda v, m: m, True)


full, password, token = _full("full"), _full("password"), _full("token")
email = Rule("email", _email_column, _email_row)
phone = Rule("phone", _digits_column, _digits_row)
card = Rule("card", _digits_column, _digits_row)
id_ = Rule("id", _id_column, _id_row)
BUILT_IN = {r.name: r for r in (full, password, token, email, phone, id_, card)}


def new_rule(name: str, function: Callable[[str], str]) -> Rule:
    """A rule of one's own from a row function; it runs in Arrow batches.

    Where it raises, or returns what is no text, a column's value becomes the marker, and a document fails as a whole with rule_failure.
    """
    if not name or not callable(function) or _control(name, False):
        raise MaskError(ErrorCode.INVALID_CONFIG, "rule")

    def row(value: str, marker: str) -> str:
        out = function(value)
        if not isinstance(out, str):
            raise TypeError("no text")
        out.encode("utf-8")
        return out

    def safe(value: str, marker: str) -> str:
        try:
            return row(value, marker)
        except Exception:  # the error may hold the value
            return marker

    def column(value: Column, marker: str) -> Column:
        @F.pandas_udf("string")
        def run(values: pd.Series) -> pd.Series:
            return pd.Series([None if v is None else safe(v, marker) for v in values], dtype=object)

        return run(value)

    return Rule(name, column, row, python=True)


def rule_from_column(name: str, function: Callable[[Column], Column]) -> Rule:
    """A rule of one's own from a Column function; in JSON and text, where keys are met row by row, it gives the marker."""
    if not name or not callable(function):
        raise MaskError(ErrorCode.INVALID_CONFIG, "rule")
    return Rule(name, lambda v, m: F.coalesce(function(v), F.lit(m)), lambda v, m: m)
