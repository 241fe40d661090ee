"""JSON log lines: split at line feeds only, each line masked as a document, blank lines as they are; and whole files as documents."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import documents
from ..model import ERROR_FIELDS, ERRORS, Field, Kind, Source

#: What loggers append to a key for further details of its value.
SUFFIXES = ("Verbose", "Causes", "Error")


def read_lines(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Rows (value) of text files; a carriage return belongs to its line."""
    reader = spark.readStream if stream else spark.read
    return reader.option("lineSep", "\n").text(path)


def read_documents(spark: SparkSession, path: str, max_bytes: int | None = None) -> DataFrame:
    """Rows (file, value): each file as one document. Of files over max_bytes only the size is read; their value is NULL, and `too_long` tells it. An empty file gives no row."""
    if max_bytes is None:
        return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    files = spark.read.format("binaryFile").load(path)
    # the filter reaches the scan, so longer files aren't opened
    short = files.where(F.col("length") <= max_bytes).select(F.col("path").alias("file"), F.col("content").cast("string").alias("value"), F.lit(False).alias("too_long"))
    return short.unionAll(files.where(F.col("length") > max_bytes).select(F.col("path").alias("file"), F.lit(None).cast("string").alias("value"), F.lit(True).alias("too_long")))


def mask_documents(masker, spark: SparkSession, path: str) -> DataFrame:
    """Rows (file, value, errors): each file masked as one JSON document; one over the input limit is never read, and fails with input_limit."""
    files = read_documents(spark, path, masker.config.max_input_bytes)
    masked = masker.mask_json(F.col("value"))
    said = {"code": "input_limit", "operation": "json", "path": "$", "depth": 0}
    limit = F.array(F.struct(*(F.lit(said.get(n, "")).alias(n) for n in ERROR_FIELDS))).cast(ERRORS)
    made = files.select("file", "too_long", masked.alias("m"))
    return made.select("file", F.when(F.col("too_long"), F.lit(documents.encode_string(masker.config.redaction))).otherwise(F.col("m.value")).alias("value"), F.when(F.col("too_long"), limit).otherwise(F.col("m.errors")).alias("errors"))


def write_lines(masker, df: DataFrame, path: str, column: str = "value", diagnostics: bool = False, mode: str = "append") -> None:
    """Writes lines into text files, masked on the way: what reaches the folder is never raw."""
    mask_json_lines(masker, df.select(F.col(column).alias("value")), diagnostics=diagnostics).write.mode(mode).text(path)


def write_records(masker, df: DataFrame, path: str, mode: str = "append") -> None:
    """Writes each row as a masked JSON line: columns and groups by policy and tags, keys sorted."""
    masker.rows_to_json(df).write.mode(mode).text(path)


def _diagnose(operation: documents.Operation, text: str) -> str:
    """The masked document text, with keys like `<base>Error` masked as `<base>` would be."""
    if not any(s in text for s in SUFFIXES):
        return text
    quiet = operation.config.redaction

    def walk(node: list) -> str:
        kind, token = node
        if kind == "array":
            return "[" + ",".join(map(walk, token)) + "]"
        if kind != "object":
            return token
        out = []
        for name, child in token:
            base = next((name.removesuffix(s) for s in SUFFIXES if name.endswith(s) and name != s), None)
            value = json.loads(child[1]) if child[0] == "string" else documents.PROBE
            new = operation.decide(Field(base, f"$[{base}]", Source.JSON, Kind.STRING), value) if base else None
            if new is documents.OMITTED:
                continue
            if new is None or (child[0] != "string" and new == documents.PROBE):
                shown = walk(child)
            else:
                shown = documents.encode_string(new if child[0] == "string" else quiet)
            out.append(f"{documents.encode_string(name)}:{shown}")
        return "{" + ",".join(out) + "}"

    return walk(documents.parse(text))


def mask_line(masker, line: Column, diagnostics: bool = False) -> Column:
    """A line masked: blank ones stay, what is no JSON document becomes {"message": marker}; a carriage return at the end stays."""
    policy, config = masker.policy, masker.config
    fallback = '{"message":' + documents.encode_string(config.redaction) + "}"

    def what(operation: documents.Operation, text: str) -> str:
        end = "\r" if text.endswith("\r") else ""
        operation.suffixes = SUFFIXES if diagnostics else ()
        out = operation.json(text)
        return (_diagnose(operation, out) if diagnostics and not operation.diagnosed else out) + end

    def run(values: pa.Array) -> pa.Array:
        return documents.texts(policy, config, what, values, fallback)

    run.__annotations__ = {"values": pa.Array, "return": pa.Array}  # as types: here annotations are strings
    masked = F.arrow_udf(run, "string")
    blank = line.rlike(r"^[ \t\r]*\z")
    return F.when(line.isNull() | blank, line).when(~F.is_valid_utf8(line), F.lit(fallback)).otherwise(masked(F.when(~blank & F.is_valid_utf8(line), line)))


def mask_json_lines(masker, df: DataFrame, column: str = "value", diagnostics: bool = False) -> DataFrame:
    """df, batch or stream, with its lines masked."""
    return df.withColumn(column, mask_line(masker, F.col(column), diagnostics))
