"""What masking decides on and how: fields, decisions, limits and errors."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import types as T


class Source(str, Enum):
    UNKNOWN, ANY, MAP, STRUCT, JSON, HEADER, URL_QUERY, URL_USERINFO, URL_FRAGMENT, TEXT = "unknown any map struct json header url_query url_userinfo url_fragment text".split()


class Kind(str, Enum):
    INVALID, NIL, STRING, BOOL, NUMBER, OBJECT, ARRAY = "invalid nil string bool number object array".split()


class ErrorCode(str, Enum):
    INVALID_CONFIG, INVALID_JSON, INVALID_UTF8, INPUT_LIMIT, DEPTH_LIMIT, NODE_LIMIT, CYCLE, UNSUPPORTED_TYPE, UNSUPPORTED_MAP_KEY, FIELD_CONFLICT, POLICY_FAILURE, RULE_FAILURE, PANIC = (
        "invalid_config invalid_json invalid_utf8 input_limit depth_limit node_limit cycle unsupported_type unsupported_map_key field_conflict policy_failure rule_failure panic".split()
    )


class MaskError(Exception):
    """A masker, or a plan, that cannot be built. Values never raise: they become the marker."""

    def __init__(self, code: ErrorCode, what: str = ""):
        super().__init__(f"{code.value}: {what}" if what else code.value)
        self.code = code


@dataclass(frozen=True)
class Field:
    """The place of a value: the key it stands under, its path from the root `$`, where it comes from and what it is."""

    key: str = ""
    path: str = "$"
    source: Source = Source.ANY
    kind: Kind = Kind.STRING


#: Errors of one operation, at most MAX_ERRORS.
ERROR_FIELDS = ("code", "operation", "path", "field", "conflicting_field", "depth", "rule")
ERRORS = T.ArrayType(T.StructType([T.StructField(n, T.IntegerType() if n == "depth" else T.StringType()) for n in ERROR_FIELDS]))
MASKED = T.StructType([T.StructField("value", T.StringType()), T.StructField("errors", ERRORS)])
MAX_ERRORS = 64


@dataclass(frozen=True)
class MaskConfig:
    """Limits and switches of a masker."""

    redaction: str = "[REDACTED]"
    max_depth: int = 32
    max_nodes: int = 100_000
    max_input_bytes: int = 8 << 20
    preserve_safe: bool = False
    embedded: bool = True
    text_detectors: bool = True
    cards: bool = False
    aws_key_ids: bool = False
    metadata_key: str = "mask"
    tag_rules: dict = field(default_factory=dict)

    def __post_init__(self):
        ok = bool(self.redaction) and 0 <= self.max_depth <= 10_000 and self.max_nodes > 0 and self.max_input_bytes > 0 and bool(self.metadata_key)
        if not ok or not self.redaction.isprintable():
            raise MaskError(ErrorCode.INVALID_CONFIG, "redaction, limits or metadata key")
        for name in self.tag_rules:
            if not name or name == "omit" or any(c in name for c in ',"` '):
                raise MaskError(ErrorCode.INVALID_CONFIG, f"tag {name!r}")
