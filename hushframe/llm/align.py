"""Alignment of two tokenizers over the same bytes.

A text's bytes are cut wherever a token of A and a token of B both end; tokens between two cuts form a group, and each token of A in
a group is linked with each of B in it. Texts are put one behind the other with their byte offsets, so all of a batch are aligned
at once: ends are counted by offset, cuts are where both counts are, and differences of running sums give each document's share.

Which tokens of B a token of A is mostly linked with needs the whole corpus: pairs of ids are counted by documents in Spark
and brought back to the documents that hold them, the most frequent pairs by broadcast, all others by a join.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .bpe import KEEP_WORD, Recent, byte_letters
from .tokencount import UNEVEN

#: How the byte-level vocabulary A splits a text before merging: a fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes of text that are aligned at once (a longer text by itself), and words whose tokens a worker remembers.
TOGETHER, KEEP_WORDS = 1_000_000, 200_000
#: Groups with more links than this are linked by distinct ids and their counts.
WIDE = 256
#: Pairs that are broadcast at most, the most frequent; all others are joined.
BROADCAST_PAIRS = 150_000

_COLUMNS = "doc_id long, uid long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
SCHEMA = f"{_COLUMNS}, a array<int>, b array<int>, m array<long>"
_BITS = 20  # of an id in a pair's number


def _byte_bpe(path: str):
    """A's encoder, and its tokens' bytes by id. Ids of this kind of vocabulary follow the order of merges."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    byte = {c: b for b, c in enumerate(byte_letters())}
    names = {bytes(map(byte.__getitem__, name)): i for name, i in vocab.items()}
    encode = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=names, special_tokens={}).encode_ordinary
    tokens = [b""] * (1 + max(names.values()))
    for name, i in names.items():
        tokens[i] = name
    return encode, tokens


def _piece_bpe(path: str):
    """B's encoder of lists of texts, and its tokens' bytes by id."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    one_byte = regex.compile("<0x([0-9A-F]{2})>")
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    tokens = [bytes([int(m[1], 16)]) if (m := one_byte.fullmatch(n)) else n.replace("▁", " ").encode() for n in names]
    # a space inside a piece, but for its beginning, would let merges go over a word's border
    alone = not any("▁" in n.lstrip("▁") for n in names)
    return lambda texts: model.encode(texts, num_threads=1), tokens, alone


class Aligner:
    """Both vocabularies, and the tokens of words met of late."""

    def __init__(self, path_a: str, path_b: str):
        self.encode_a, self.bytes_a = _byte_bpe(path_a)
        self.encode_b, self.bytes_b, self.alone = _piece_bpe(path_b)
        self.width_a = np.fromiter(map(len, self.bytes_a), np.int64, len(self.bytes_a))
        self.width_b = np.fromiter(map(len, self.bytes_b), np.int64, len(self.bytes_b))
        self.words = Recent(2 * KEEP_WORDS)
        # each id as text behind each separator
        most = max(len(self.bytes_a), len(self.bytes_b))
        self.most, self.texts = most, np.array([b"%c%d" % (c, i) for c in b",;|" for i in range(most)], dtype=object)

    def _both(self, texts: list[str]) -> list[tuple[bytes, bytes] | None]:
        """The ids of A and B for a space and each text, as int32; None where their bytes are not these."""
        out = []
        for text, b in zip(texts, self.encode_b(texts)):
            want = b" " + text.encode()
            a = self.encode_a(" " + text)
            fits = b"".join(map(self.bytes_a.__getitem__, a)) == want == b"".join(map(self.bytes_b.__getitem__, b))
            out.append((array("i", a).tobytes(), array("i", b).tobytes()) if fits else None)
        return out

    def encode(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """Ids of each text. Words between single spaces are encoded by themselves: no token of either vocabulary goes over a space that begins a word."""
        cut: list[list[str] | None] = []
        for t in texts:
            plain = self.alone and "  " not in t and t[:1] != " " and t[-1:] != " " and not UNEVEN.search(t)
            cut.append(t.split(" ") if t and plain else None)
        new = list(self.words.unknown({w for ws in cut if ws for w in ws}, lambda w, ids: 1))
        long = []
        for w, ids in zip(new, self._both(new) if new else []):
            if len(w) <= KEEP_WORD:
                self.words.keep(w, ids, 1)
            else:
                self.words[w] = ids
                long.append(w)
        none, out = (b"", b""), []
        for t, ws in zip(texts, cut):
            got = [self._both([t])[0]] if t and ws is None else list(map(self.words.__getitem__, ws or ()))
            out.append(none if None in got else (b"".join([g[0] for g in got]), b"".join([g[1] for g in got])))
        for w in long:
            del self.words[w]
        self.words.trim()
        return out

    def align(self, texts: list[str]) -> dict[str, object]:
        """Columns for texts, one value for each; a, b, m are flat, `pairs` of them for each text."""
        coded = self.encode(texts)
        n_a, n_b = (np.array([len(c[k]) // 4 for c in coded], np.int64) for k in (0, 1))
        a, b = (np.frombuffer(b"".join([c[k] for c in coded]), np.int32).astype(np.int64) for k in (0, 1))
        ends_a, ends_b = np.cumsum(self.width_a[a]), np.cumsum(self.width_b[b])
        # the documents' offsets in bytes, and how many tokens come before each
        first_a, first_b = np.concatenate([[0], np.cumsum(n_a)]), np.concatenate([[0], np.cumsum(n_b)])
        offsets = np.concatenate([[0], ends_a])[first_a]
        size = int(offsets[-1])
        cuts = (np.bincount(ends_a, minlength=size + 1) > 0) & (np.bincount(ends_b, minlength=size + 1) > 0)
        so_far = np.cumsum(cuts)
        group_a, group_b = so_far[ends_a - 1], so_far[ends_b - 1]
        groups = int(so_far[-1]) if size else 0
        in_a, in_b = np.bincount(group_a, minlength=groups), np.bincount(group_b, minlength=groups)
        at = so_far[offsets] if size else np.zeros(len(offsets), np.int64)
        upto_a, upto_b, upto_links = (np.concatenate([[0], np.cumsum(x)]) for x in (in_a, in_b, in_a * in_b))
        out = {"n_a": n_a, "n_b": n_b, "n_groups": np.diff(at), "n_links": np.diff(upto_links[at])}
        out["groups_sha256"] = self._digests(a, b, group_a, group_b, upto_a, upto_b, first_a + first_b)
        owner = np.repeat(np.arange(len(texts)), n_a)
        return out | self._pairs(a, b, group_a, in_a, in_b, upto_a, upto_b, owner, len(texts))

    def _digests(self, a, b, group_a, group_b, upto_a, upto_b, first) -> list[str]:
        """The digest of each document's groups as text; "" where it has no tokens. Tokens stand as A's and then B's of each group."""
        place = np.empty(len(a) + len(b), np.int64)
        new_a, new_b = np.diff(group_a, prepend=-1) > 0, np.diff(group_b, prepend=-1) > 0
        place[np.arange(len(a)) + upto_b[group_a]] = a + self.most * new_a
        place[np.arange(len(b)) + upto_a[group_b + 1]] = b + 2 * self.most * new_b
        texts = self.texts[place].tolist()
        return [hashlib.sha256(b"".join(texts[i:j])[1:]).hexdigest() if j > i else "" for i, j in zip(first[:-1].tolist(), first[1:].tolist())]

    def _pairs(self, a, b, group_a, in_a, in_b, upto_a, upto_b, owner, docs: int) -> dict[str, object]:
        """Distinct pairs of linked ids of each document, and how many links each has."""
        number = lambda doc, x, y: (doc << 2 * _BITS) | (x << _BITS) | y
        narrow = in_a * in_b <= WIDE
        own = np.flatnonzero(narrow[group_a])
        many = in_b[group_a[own]]
        right = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + np.repeat(upto_b[group_a[own]], many)
        found, counts = np.unique(number(np.repeat(owner[own], many), np.repeat(a[own], many), b[right]), return_counts=True)
        wide = np.flatnonzero(~narrow)
        if len(wide):
            keys, sums = [found], [counts]
            for g in wide.tolist():
                x, nx = np.unique(a[upto_a[g] : upto_a[g + 1]], return_counts=True)
                y, ny = np.unique(b[upto_b[g] : upto_b[g + 1]], return_counts=True)
                keys.append(number(owner[upto_a[g]], x[:, None], y[None, :]).ravel())
                sums.append((nx[:, None] * ny[None, :]).ravel())
            found, place = np.unique(np.concatenate(keys), return_inverse=True)
            total = np.zeros(len(found), np.int64)
            np.add.at(total, place, np.concatenate(sums))
            counts = total
        mask = (1 << _BITS) - 1
        return {"pairs": np.bincount(found >> 2 * _BITS, minlength=docs), "a": (found >> _BITS) & mask, "b": found & mask, "m": counts}


@lru_cache(maxsize=2)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def _slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    begin = size = 0
    for k, t in enumerate(texts):
        if size and size + len(t) > TOGETHER:
            yield begin, k
            begin, size = k, 0
        size += len(t)
    if begin < len(texts):
        yield begin, len(texts)


def aligned(docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row of docs: SCHEMA, uid a number of the row's own; a, b, m are its distinct pairs of linked ids and the links of each. One pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = aligner(path_a, path_b)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for i, j in _slices(texts):
                got = of.align(texts[i:j])
                offsets = pa.array(np.concatenate([[0], np.cumsum(got["pairs"])]), pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(got[c], kind)) for c, kind in (("a", pa.int32()), ("b", pa.int32()), ("m", pa.int64()))]
                plain = [pa.array(got[c], pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), batch.column("uid").slice(i, j - i), *plain, pa.array(got["groups_sha256"], pa.string()), *lists], [f.split()[0] for f in SCHEMA.split(", ")])

    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"), F.monotonically_increasing_id().alias("uid"))
    return rows.mapInArrow(run, SCHEMA)


def pair_counts(rows: DataFrame) -> DataFrame:
    """Rows (a, b, n, best): in how many of aligned()'s rows a pair is linked, and whether that is the most of its a."""
    pairs, _ = shared.write_table(_exploded(rows).groupBy("a", "b").agg(F.count("*").alias("n")), "pairs")
    most = pairs.groupBy("a").agg(F.max("n").alias("most"))  # a row for an id of A at most: bounded by the vocabulary
    return pairs.join(F.broadcast(most), "a").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


def _exploded(rows: DataFrame) -> DataFrame:
    return rows.select("uid", F.inline(F.arrays_zip("a", "b", "m")))


def _frequent(pairs: DataFrame, most: int) -> int:
    """The least power of two from which on counts belong to `most` pairs at most."""
    sizes = {r["k"]: r["c"] for r in pairs.groupBy(F.floor(F.log2("n")).cast("int").alias("k")).agg(F.count("*").alias("c")).collect()}  # 63 rows at most
    k, held = max(sizes, default=0) + 1, 0
    while k > 0 and held + sizes.get(k - 1, 0) <= most:
        k, held = k - 1, held + sizes.get(k - 1, 0)
    return 1 << k


def alignment(docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text", broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """A row for each row of docs: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A (byte-level BPE, a tokenizers file) encodes a space and the text, B (BPE pieces, a sentencepiece model) the text; special tokens'
    strings are plain text. A text that is null or empty, or whose tokens' bytes are not a space and the text in both, has no tokens: zeros and
    "". n_best counts the links whose pair is in as many documents as any pair of its id of A; count_sum sums up the documents of each link's pair.
    Rows of equal doc_id or text count one by one. An empty table gives an empty table. Only the two columns are read.
    """
    rows, _ = shared.write_table(aligned(docs, path_a, path_b, doc_id, text), "aligned")
    pairs, _ = shared.write_table(pair_counts(rows), "pairs")
    least = _frequent(pairs, broadcast_pairs)
    sums = [F.sum(F.when(F.col("best"), F.col("m")).otherwise(0)).alias("n_best"), F.sum(F.col("m") * F.col("n")).alias("count_sum")]
    frequent = pairs.where(F.col("n") >= least)
    met = _exploded(rows).join(F.broadcast(frequent), ["a", "b"]).groupBy("uid").agg(*sums)
    if least > 1:
        # a pair that is in fewer documents than `least` can't be a hot key
        rest = _exploded(rows).join(F.broadcast(frequent.select("a", "b")), ["a", "b"], "left_anti")
        met = met.unionAll(rest.join(pairs.where(F.col("n") < least).hint("shuffle_hash"), ["a", "b"]).groupBy("uid").agg(*sums)).groupBy("uid").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.join(met, "uid", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
