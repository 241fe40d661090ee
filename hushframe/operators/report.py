"""Where secrets are: counts of what the detectors find, by any columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def detections(masker, df: DataFrame, column: str, *keep: str) -> DataFrame:
    """A row (keep..., kind, key, secret_length) for each secret or named value in a text column; secrets themselves stay out."""
    pairs = F.transform(masker.detect_pairs(F.col(column)), lambda p: F.struct(F.lit("pair").alias("kind"), p["key"].alias("key"), F.length(p["value"]).alias("secret_length")))
    spans = F.transform(masker.detect_spans(F.col(column)), lambda s: F.struct(s["kind"].alias("kind"), F.lit("").alias("key"), F.length(s["secret"]).alias("secret_length")))
    return df.select(*keep, F.explode(F.concat(pairs, spans)).alias("d")).select(*keep, "d.*")


def detection_report(masker, df: DataFrame, column: str, *by: str) -> DataFrame:
    """Counts by kind and the columns `by`, with subtotals (NULL)."""
    return detections(masker, df, column, *by).rollup("kind", *by).agg(F.count("*").alias("n"))


def output_digest(df: DataFrame, hex_digits: int = 8) -> DataFrame:
    """One row (n, digest): the rows' count, and the sum of the first hexadecimal digits of each row's MD5, whatever their order.

    Columns go in the order of their names, as text, between U+001F; NULL is U+0000. Pinned, it tells when output changes. Sums of parts add up to
    the sum of the whole. With 8 digits the digest is a long; with more, up to 15, a decimal as text.
    """
    columns = [F.coalesce(F.col("`" + c.replace("`", "``") + "`").cast("string"), F.lit("\0")) for c in sorted(df.columns)]
    bits = F.conv(F.left(F.md5(F.concat_ws("\x1f", *columns).cast("binary")), F.lit(hex_digits)), 16, 10).cast("long")
    if hex_digits <= 8:
        return df.agg(F.count("*").alias("n"), F.coalesce(F.sum(bits), F.lit(0)).cast("long").alias("digest"))
    return df.agg(F.count("*").alias("n"), F.coalesce(F.sum(bits.cast("decimal(20,0)")), F.lit(0)).cast("string").alias("digest"))
