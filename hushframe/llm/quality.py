"""Quality rules on documents, with verdicts on their hosts (DataFrame functions only).

Every text gets counts of words, symbols, repeated lines and repeated three-word windows. Each rule's failures
are summed by host; a host's rate is shrunk towards the corpus by a beta prior fitted to all hosts; the host's
verdict is joined back to its documents.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

SYMBOLS = r"[#*$%&|<>]"
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines")
#: A window's place takes the lower 20 bits, its hash the others.
_PLACES = 1 << 20
_UPPER_BITS = -_PLACES


@dataclass(frozen=True)
class HostRules:
    """The thresholds. Shares are of words or lines; the host rates are posterior means of the beta prior."""

    min_words: int = 50
    max_repeat_percent: int = 50
    symbols_per_100_words: int = 30
    dup_lines_percent: int = 30
    blocked_rate: float = 0.8
    watched_rate: float = 0.5


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (long), in place of columns so named.

    A null or empty text has none of anything. Three-word windows are compared by their 64-bit hash within one text.
    """
    added = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
    keep = [c for c in docs.columns if c not in added]
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    step = docs.select(*keep, shared.words(F.col(text)).alias("__words"), lines.alias("__lines"), (F.length(whole) - F.length(F.regexp_replace(whole, SYMBOLS, ""))).cast("long").alias("n_symbols"))
    size = F.size("__words")
    step = step.select(
        *keep,
        "n_symbols",
        size.cast("long").alias("n_words"),
        F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        shared.grams(F.col("__words"), 3).alias("__windows"),
    )
    # windows in order of their hash, those of equal hash next to each other: the hash's upper bits and the place in one
    # long where no two hashes share these bits and the places fit, else both as a struct, whose sort is slower
    kinds = F.size(F.array_distinct("__windows"))
    upper = F.transform("__windows", lambda h: h.bitwiseAND(_UPPER_BITS))
    step = step.withColumn("__repeats", kinds < F.size("__windows"))
    step = step.withColumn("__packs", F.col("__repeats") & (F.size("__windows") <= _PLACES) & (F.size(F.array_distinct(upper)) == kinds))
    packed = F.sort_array(F.transform("__windows", lambda h, i: h.bitwiseAND(_UPPER_BITS).bitwiseOR(i.cast("long"))))
    placed = F.sort_array(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    step = step.select(*keep, *_COUNTS, F.when(F.col("__packs"), packed).alias("__packed"), F.when(F.col("__repeats") & ~F.col("__packs"), placed).alias("__placed"))
    again = F.filter("__placed", lambda x, j: (x["h"] == F.get(F.col("__placed"), j - 1)["h"]) | (x["h"] == F.get(F.col("__placed"), j + 1)["h"]))
    same = F.zip_with("__packed", F.slice("__packed", 2, F.size("__packed")), lambda x, y: F.shiftright(x.bitwiseXOR(y), 20) == 0)
    step = step.withColumn("__same", same)
    again_packed = F.transform(F.filter("__packed", lambda x, j: F.coalesce(F.get(F.col("__same"), j), F.lit(False)) | F.coalesce(F.get(F.col("__same"), j - 1), F.lit(False))), lambda x: x.bitwiseAND(_PLACES - 1).cast("int"))
    step = step.select(*keep, *_COUNTS, F.sort_array(F.coalesce(again_packed, F.transform(again, lambda x: x["i"]))).alias("__starts"))
    # windows at sorted starts cover three words each, less what the one before has covered
    covered = F.aggregate(F.transform("__starts", lambda s, j: F.when(j == 0, 3).otherwise(F.least(F.lit(3), s - F.get(F.col("__starts"), j - 1)))), F.lit(0), lambda a, b: a + b)
    return step.select(*keep, *_COUNTS, F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def rule_columns(rules: HostRules) -> dict[str, object]:
    """Each rule's name and its condition for failure."""
    return {
        "fails_short": F.col("n_words") < rules.min_words,
        "fails_repeats": 100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"),
        "fails_symbols": 100 * F.col("n_symbols") > rules.symbols_per_100_words * F.col("n_words"),
        "fails_lines": 100 * F.col("n_dup_lines") > rules.dup_lines_percent * F.col("n_lines"),
    }


def host_verdicts(measured: DataFrame, host: str, rules: HostRules) -> DataFrame:
    """A row for each host (null is none): n documents, failures and shrunk rate of each rule, verdict.

    The prior's mean is the corpus rate, its strength comes from the variance of the hosts' rates (method of
    moments), at least 2 and at most 1e6 documents' worth. The verdict is `blocked` if the shrunk rate of the base rules
    reaches blocked_rate, `watched` if the shrunk rate of any rule reaches watched_rate, else `fine`.
    """
    named = rule_columns(rules)
    flags = measured.where(F.col(host).isNotNull()).select(F.col(host).alias("host"), *(c.cast("long").alias(k) for k, c in named.items()), (named["fails_short"] | named["fails_repeats"]).cast("long").alias("fails_base"))
    every = [*named, "fails_base"]
    hosts, _ = shared.write_table(flags.groupBy("host").agg(F.count("*").alias("n"), *(F.sum(k).alias(k) for k in every)), "hosts")
    moments = []
    for k in every:
        rate = F.col(k) / F.col("n")
        moments += [F.sum(k).alias(f"{k}_k"), F.avg(rate).alias(f"{k}_m"), F.var_pop(rate).alias(f"{k}_v"), F.avg(1 / F.col("n")).alias(f"{k}_h")]
    prior = hosts.agg(F.sum("n").alias("n"), *moments).first()  # one row
    out = hosts
    for k in every:
        mean = (prior[f"{k}_k"] or 0) / (prior["n"] or 1)
        noise = mean * (1 - mean)
        between = max((prior[f"{k}_v"] or 0.0) - noise * (prior[f"{k}_h"] or 0.0), 0.0)
        strength = min(max(noise / between - 1 if between else 1e6, 2.0), 1e6)
        out = out.withColumn(k.replace("fails", "rate"), (F.col(k) + mean * strength) / (F.col("n") + strength))
    watched = F.greatest(*(F.col(k.replace("fails", "rate")) for k in named)) >= rules.watched_rate
    return out.withColumn("verdict", F.when(F.col("rate_base") >= rules.blocked_rate, "blocked").when(watched, "watched").otherwise("fine"))


def judge(docs: DataFrame, text: str = "text", host: str = "source", rules: HostRules = HostRules(), keep_text: bool = True) -> DataFrame:
    """docs with the measures, base_failed, host_verdict and kept; one row for each row of docs. Without keep_text the texts are left out, and never written.

    kept: not base_failed, the host not blocked, and on a watched host no rule failed at all. A null host has the
    verdict `fine`. An empty table gives an empty table. Own columns of the names added are replaced; repeated rows
    count, and are judged, one by one. The measured rows are written once, so texts are measured once.
    """
    added = ("base_failed", "host_verdict", "kept")
    measured = measure(docs.drop(*added), text)
    measured, _ = shared.write_table(measured if keep_text else measured.drop(text), "measured")
    return _judged(measured, host, rules)


def _judged(measured: DataFrame, host: str, rules: HostRules) -> DataFrame:
    """The measured rows with base_failed, host_verdict and kept."""
    named = rule_columns(rules)
    verdicts = host_verdicts(measured, host, rules).select(F.col("host").alias("__host"), F.col("verdict").alias("host_verdict"))
    base = named["fails_short"] | named["fails_repeats"]
    soft = named["fails_symbols"] | named["fails_lines"]
    judged = measured.join(shared.small(verdicts), F.col(host) == F.col("__host"), "left").drop("__host")
    judged = judged.withColumn("host_verdict", F.coalesce("host_verdict", F.lit("fine"))).withColumn("base_failed", base)
    kept = ~F.col("base_failed") & (F.col("host_verdict") != "blocked") & ((F.col("host_verdict") != "watched") | ~soft)
    return judged.withColumn("kept", kept)


def keep_good(docs: DataFrame, text: str = "text", host: str = "source", rules: HostRules = HostRules()) -> DataFrame:
    """The rows of docs that judge() keeps, with docs' own columns.

    Rows of equal text and host have equal verdicts, so counts are written without texts, and what is rejected is taken out
    by a 128-bit key of the text and the host.
    """
    names = {c: f"__own_{i}" for i, c in enumerate(docs.columns)}
    own = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items()))
    whole = F.coalesce(F.col(names[text]), F.lit(""))
    k1, k2 = F.xxhash64(whole), F.xxhash64(F.lit("key"), whole)
    measured = measure(own.select(k1.alias("__k1"), k2.alias("__k2"), F.col(names[host]).alias("__from"), F.col(names[text]).alias("__text")), "__text").drop("__text")
    measured, _ = shared.write_table(measured, "measured")
    rejected, _ = shared.write_table(_judged(measured, "__from", rules).where(~F.col("kept")).select("__k1", "__k2", "__from").distinct(), "rejected")
    same = (k1 == F.col("__k1")) & (k2 == F.col("__k2")) & F.col(names[host]).eqNullSafe(F.col("__from"))
    return own.join(shared.small(rejected), same, "left_anti").select(*(F.col(n).alias(c) for c, n in names.items()))
