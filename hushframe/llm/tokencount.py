"""Token counts of byte-level BPE vocabularies, with a shortcut for whole tokens.

Before any text is read, every vocabulary string is merged once: those that come out as one token are proven whole.
A text's pre-tokens that are such strings count one each by lookup; only the others are merged. Texts are counted
together: what single spaces set apart in them is counted once for each different piece.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vectext
from .bpe import KEEP_WORD, LETTER, NUMBER, OTHER, Merger, merger

#: How byte-level vocabularies split a text before merging.
PRE_TOKEN = regex.compile(rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d| ?{LETTER}+| ?{NUMBER}+| ?{OTHER}+|\s+(?!\S)|\s+")


#: A worker keeps the costs of so many pre-tokens, besides whole tokens, and of so many pieces; then it begins anew.
KEPT = 100_000
#: Bytes of texts that are counted together.
TOGETHER = 32 << 20

#: Where pieces between single spaces don't stand for themselves.
UNEVEN = regex.compile(r"\s \s|\s \Z")


@lru_cache(maxsize=2)
def pieces(path: str, whole: frozenset[str]) -> Pieces:
    """A worker's memory of costs."""
    return Pieces(Costs(merger(path), whole))


@lru_cache(maxsize=4)
def whole_tokens(path: str) -> frozenset[str]:
    """The vocabulary strings that merging turns into one token; at most as many as the vocabulary has."""
    bpe = merger(path)
    byte = {c: b for b, c in enumerate(bpe.letters)}
    whole = set()
    for name, i in bpe.ids.items():
        if bpe.merge([bpe.ids[c] for c in name]) == [i]:
            try:
                whole.add(bytes(map(byte.__getitem__, name)).decode("utf-8"))
            except UnicodeDecodeError:  # part of a character: no pre-token by itself
                pass
    return frozenset(whole)


class Costs(dict):
    """Tokens of each pre-token: 1 for whole tokens, merged when first asked for otherwise."""

    def __init__(self, bpe: Merger, whole: frozenset[str]):
        super().__init__(dict.fromkeys(whole, 1))
        self.bpe, self.names = bpe, whole
        self.bytes = [bpe.ids[c] for c in bpe.letters]

    def __missing__(self, token: str) -> int:
        n = len(self.bpe.merge([self.bytes[b] for b in token.encode("utf-8", "replace")]))
        if len(token) <= KEEP_WORD:
            if len(self) >= len(self.names) + KEPT:
                self.clear()
                self.update(dict.fromkeys(self.names, 1))
            self[token] = n
        return n


class Pieces(dict):
    """Tokens of each piece after a space, space included; pieces are what single spaces set apart.

    A space before a character that is no white space begins a pre-token unless more white space stands before it, and then
    too: the pattern leaves the last white space to what follows. So pieces cost the same in any text, but where
    white space, a space and white space (or the end) follow each other.
    """

    def __init__(self, costs: Costs):
        super().__init__()
        self.costs = costs

    def whole(self, text: str) -> int:
        return sum(map(self.costs.__getitem__, PRE_TOKEN.findall(text)))

    def __missing__(self, piece: str) -> int:
        n = self.whole(" " + piece)
        if len(piece) <= KEEP_WORD:
            if len(self) >= KEPT:
                self.clear()
            self[piece] = n
        return n

    def count(self, text: str) -> int:
        if UNEVEN.search(text):
            return self.whole(text)
        first, *rest = text.split(" ")
        return (self.whole(first) if first else 0) + sum(map(self.__getitem__, rest))

    def count_all(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text, none of them null; each different piece of these texts is counted once, so many words need no memory between them."""
        uneven = np.array([UNEVEN.search(t) is not None for t in texts.to_pylist()], bool)
        split = pc.split_pattern(texts, " ")
        pieces_ = split.flatten().dictionary_encode()
        costs = np.fromiter((self.whole(" " + x) for x in pieces_.dictionary.to_pylist()), np.int64, len(pieces_.dictionary))
        at = split.offsets.to_numpy() - split.offsets[0].as_py()
        costs = costs[pieces_.indices.to_numpy()]
        costs[at[:-1]] = 0  # a text's first piece has no space before it
        out = np.add.reduceat(costs, at[:-1])
        for i, first in enumerate(split.flatten().take(pa.array(at[:-1])).to_pylist()):
            out[i] = self.count(texts[i].as_py()) if uneven[i] else out[i] + self.whole(first)
        return out


def count_tokens(docs: DataFrame, path: str, limit: int = 512, text: str = "text") -> DataFrame:
    """docs with n_bytes, n_tokens (long) and over_limit (n_tokens > limit), in place of columns so named.

    A null or empty text has no bytes and no tokens. A special token's string in a text is one token. One pass
    over the rows, no shuffle; repeated rows are counted one by one.
    """
    spark: SparkSession = docs.sparkSession
    whole = spark.sparkContext.broadcast(whole_tokens(path))  # bounded by the vocabulary

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = merger(path)
        special = regex.compile("|".join(map(regex.escape, bpe.special)) or r"(?!)")
        marks = tuple(bpe.special)
        known = pieces(path, whole.value)
        for batch in batches:
            out = np.zeros(len(batch), np.int64)
            texts = batch.fillna("").tolist()
            marked = [i for i, t in enumerate(texts) if any(m in t for m in marks)]
            for i in marked:
                parts = special.split(texts[i])
                out[i] = len(parts) - 1 + sum(map(known.count, parts))
                texts[i] = ""
            done = 0
            for part in vectext.slices(pa.array(texts, pa.large_string()), TOGETHER):
                out[done : done + len(part)] += known.count_all(part)
                done += len(part)
            yield pd.Series(out)

    keep = [F.col(f"`{c}`") for c in docs.columns if c not in ("n_bytes", "n_tokens", "over_limit")]
    counted = docs.select(*keep, F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("n_bytes"), count(F.col(text)).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
