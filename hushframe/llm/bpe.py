"""Byte-pair encoding: exact merging, encoding by guess and check, and decoding.

encode() guesses each word's tokens by greedy longest match and keeps the guess where every pair of neighbours is
compatible: a pair is compatible if exact merging of its joined symbols gives these two tokens again. When all tokens of
a word stand in compatible pairs, no merge can cross a border between them, so the guess is what merging would give.
Only words that fail are merged. Pairs are tested as arrays, each distinct pair once in a worker.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from operator import itemgetter

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Longer words are not kept between batches, nor more characters of words and their codes or more words than this.
KEEP_WORD, KEEP_CHARS, KEEP_WORDS = 100, 24_000_000, 200_000
#: Texts that are encoded at once.
TOGETHER = 256
_first = itemgetter(0)


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies, by byte."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    letters, spare = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in letters:
            letters[b], spare = chr(spare), spare + 1
    return [letters[b] for b in range(256)]


class Merger:
    """Vocabulary and merges of a tokenizers file of model BPE."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"] or ""
        self.special: dict[str, int] = {t["content"]: t["id"] for t in spec["added_tokens"]}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        #: pair of ids: its rank, above 20 bits that hold the id it becomes
        self.ranks = {(self.ids[a], self.ids[b]): rank << 20 | self.ids[a + b] for rank, (a, b) in enumerate(pairs)}
        self.letters = byte_letters()
        size = 1 + max([*self.ids.values(), *self.special.values()])
        self.names = [""] * size
        for name, i in [*self.ids.items(), *self.special.items()]:
            self.names[i] = name
        #: the most letters of a token that begins with these three letters
        self.reach: dict[str, int] = {}
        for name in self.ids:
            letters = len(name.removesuffix(self.end)) if self.end else len(name)
            if letters > 2:
                self.reach[name[:3]] = max(letters, self.reach.get(name[:3], 0))

    def spell(self, word: str) -> str:
        """The word's bytes as letters."""
        return word if word.isascii() and "!" <= min(word, default="!") and max(word, default="!") <= "~" else "".join(map(self.letters.__getitem__, word.encode("utf-8", "replace")))

    def symbols(self, name: str, closes: bool) -> list[int]:
        """The single symbols of letters, the last with the end of a word if that closes."""
        if not closes or not self.end:
            return [self.ids[c] for c in name]
        return [*(self.ids[c] for c in name[:-1]), self.ids[name[-1] + self.end]]

    def parts(self, token: int) -> list[int]:
        name = self.names[token]
        closes = bool(self.end) and name.endswith(self.end)
        return self.symbols(name[: -len(self.end)] if closes else name, closes)

    def merge(self, symbols: list[int]) -> list[int]:
        """The lowest rank first, the leftmost of a rank first, until none applies."""
        if len(symbols) > 40:
            return self._merge_long(symbols)
        get, none, out = self.ranks.get, 1 << 60, list(symbols)
        found = [get(pair, none) for pair in zip(out, out[1:])]
        while found and (best := min(found)) != none:
            at = found.index(best)
            out[at : at + 2] = [new := best & 0xFFFFF]
            del found[at]
            if at:
                found[at - 1] = get((out[at - 1], new), none)
            if at < len(found):
                found[at] = get((new, out[at + 1]), none)
        return out

    def _merge_long(self, symbols: list[int]) -> list[int]:
        """As merge(), by a heap over a linked list: n log n steps."""
        ranks, now, n = self.ranks, list(symbols), len(symbols)
        after, before, heap = [*range(1, n), -1], [*range(-1, n - 1)], []

        def offer(i: int) -> None:
            j = after[i]
            if j >= 0 and (f := ranks.get((now[i], now[j]))):
                heapq.heappush(heap, (f >> 20, i, now[i], now[j], f & 0xFFFFF))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i]
            if now[i] != a or j < 0 or now[j] != b:
                continue
            now[i], now[j], after[i] = new, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [x for x in now if x >= 0]


@lru_cache(maxsize=4)
def merger(path: str) -> Merger:
    return Merger(path)


# Characters that became letters or numbers only in Unicode 17, after the encoders' version (16), by
# their first and last code point in hexadecimal.
LATE_LETTERS = """
558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7
10ED9-10EEE 11B0A 11DB0-11DDB 11DF1 16EA0-16EB8 16EBB-16ED3 16FF2-16FF3 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2
18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2
1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F
"""
LATE_NUMBERS = "11DE0-11DE9 1246F 12475-1247F 12550-12686 16FF4-16FF6"
# Capitals of Unicode 16 and 17 that Python's lower() may not know, and their small letters.
LATE_SMALL = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
LATE_SMALL |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}


def _ranges(listed: str) -> str:
    ends = (r.split("-") for r in listed.split())
    return "".join(f"{chr(int(e[0], 16))}-{chr(int(e[-1], 16))}" for e in ends)


#: Character classes of letters and numbers as the encoders have them, and of what is neither and no white space.
LETTER = rf"[\p{{L}}--[{_ranges(LATE_LETTERS)}]]"
NUMBER = rf"[\p{{N}}--[{_ranges(LATE_NUMBERS)}]]"
OTHER = rf"[^\s{LETTER}{NUMBER}]"

#: The word pattern of the lower-case vocabulary with word ends.
WORD = regex.compile(rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d|{LETTER}+|{NUMBER}|{OTHER}+")


def lower(text: str) -> str:
    """Each character's small letter by itself: a sigma at a word's end is like any other."""
    small = text.replace("Σ", "σ").lower()
    return small if text.isascii() else small.translate(LATE_SMALL)


class Recent(dict):
    """What was found of late: when its size passes half of the limit, only what is asked for again stays."""

    def __init__(self, limit: int):
        super().__init__()
        self.limit, self.size, self.before = limit, 0, {}

    def keep(self, key: str, value, size: int) -> None:
        self[key] = value
        self.size += size

    def unknown(self, keys: set[str], size) -> set[str]:
        """Those of keys that are not known; the others are from now on known by []."""
        new = keys - self.keys()
        again = new & self.before.keys()
        for key in again:
            self.keep(key, value := self.before[key], size(key, value))
        return new - again

    def trim(self) -> None:
        if 2 * self.size > self.limit:
            self.before = dict(self)
            self.clear()
            self.size = 0


def _code_size(piece: str, code: tuple[int, str, str]) -> int:
    return len(piece) + len(code[1]) + len(code[2])


class WordCoder:
    """Encodes normalised words; keeps what it has found of late, within KEEP_CHARS."""

    def __init__(self, path: str):
        self.bpe = merger(path)
        self.words, self.kept = Recent(KEEP_CHARS), Recent(KEEP_WORDS)
        self.pairs = np.empty(0, np.int64)
        self.fits = np.empty(0, bool)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.bpe.special, key=len, reverse=True))) + ")")

    def guess(self, word: str) -> list[int]:
        """Greedy longest match over the vocabulary; the match that reaches the end has the word's end."""
        bpe, s = self.bpe, self.bpe.spell(word)
        ids, end, reach, n, i, out = bpe.ids, bpe.end, bpe.reach, len(s), 0, []
        while i < n:
            stop = min(n, i + reach.get(s[i : i + 3], 2))
            if stop == n and (token := ids.get(s[i:] + end)) is not None:
                out.append(token)
                break
            stop -= stop == n
            while stop > i + 1 and s[i:stop] not in ids:
                stop -= 1
            out.append(ids[s[i : max(stop, i + 1)]])
            i = max(stop, i + 1)
        return out

    def compatible(self, codes: np.ndarray) -> np.ndarray:
        """Whether exact merging keeps each pair (left * names + right) apart."""
        n = len(self.bpe.names)
        wanted = np.unique(codes)
        new = wanted[~np.isin(wanted, self.pairs, assume_unique=True)]
        if len(new):
            verdicts = [self.bpe.merge(self.bpe.parts(a) + self.bpe.parts(b)) == [a, b] for a, b in zip((new // n).tolist(), (new % n).tolist())]
            if len(self.pairs) > 1_000_000:
                again = ~np.isin(wanted, new, assume_unique=True)
                old = self.fits[np.searchsorted(self.pairs, wanted[again])]
                self.pairs, self.fits = wanted[again], old
            pairs, fits = np.concatenate([self.pairs, new]), np.concatenate([self.fits, np.array(verdicts, bool)])
            order = np.argsort(pairs, kind="stable")
            self.pairs, self.fits = pairs[order], fits[order]
        return self.fits[np.searchsorted(self.pairs, codes)]

    def encode_words(self, new: list[str]) -> list[list[int]]:
        guesses = [self.guess(w) for w in new]
        lengths = np.fromiter(map(len, guesses), np.int64, len(guesses))
        flat = np.fromiter((t for g in guesses for t in g), np.int64, int(lengths.sum()))
        owner = np.repeat(np.arange(len(new)), lengths)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        wrong = owner[inner[~self.compatible(flat[inner] * len(self.bpe.names) + flat[inner + 1])]] if len(inner) else []
        for k in np.unique(wrong):
            guesses[k] = self.bpe.merge(self.bpe.symbols(self.bpe.spell(new[k]), True))
        return guesses

    def split(self, text: str) -> list[str]:
        """The words, lower-cased, of a piece of text that holds no special token."""
        return WORD.findall(lower(unicodedata.normalize("NFC", text)))

    def pieces(self, text: str) -> list[str]:
        """What white space sets apart: no word goes over it. Special tokens stay whole, after a U+001C: no other piece has their strings."""
        out = []
        for part in self.cut.split(text) if "<|" in text else (text,):
            if part in self.bpe.special:
                out.append("\x1c" + part)
            elif "\x1c" in part or "\x1d" in part or "\x1e" in part or "\x1f" in part:  # white space for split() only
                out += regex.findall(r"\S+", part)
            else:
                out += part.split()
        return out

    def encode_pieces(self, new: list[str]) -> dict[str, tuple[int, str, str]]:
        """For each piece: the count of ids, the ids and the tokens' names, each joined by one space."""
        names = self.bpe.names
        split = {p: self.split(p) for p in new if p[0] != "\x1c" or p[1:] not in self.bpe.special}
        words = list(self.kept.unknown({w for ws in split.values() for w in ws}, lambda w, ids: 1))
        coded = dict(zip(words, self.encode_words(words)))
        out = {}
        for p in new:
            ids = [i for w in split[p] for i in (self.kept.get(w) or coded[w])] if p in split else [self.bpe.special[p[1:]]]
            out[p] = (len(ids), " ".join(map(str, ids)), " ".join(map(names.__getitem__, ids)))
        for w, ids in coded.items():
            if len(w) <= KEEP_WORD:
                self.kept.keep(w, ids, 1)
        self.kept.trim()
        return out

    def encode(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """For each text: the count of ids, the ids and the decoded tokens, each joined by one space."""
        cut = [self.pieces(t) for t in texts]
        known, long = self.words, []
        for p, f in self.encode_pieces(list(known.unknown(set().union(*cut), _code_size))).items():
            if len(p) <= KEEP_WORD:
                known.keep(p, f, _code_size(p, f))
            else:
                known[p] = f
                long.append(p)
        for own in cut:
            got = list(map(known.__getitem__, own))
            yield sum(map(_first, got)), " ".join([f[1] for f in got]), " ".join([f[2] for f in got])
        for p in long:
            del known[p]
        known.trim()


@lru_cache(maxsize=2)
def coder(path: str) -> WordCoder:
    return WordCoder(path)


def encode_documents(docs: DataFrame, path: str, text: str = "text", ids: bool = True) -> DataFrame:
    """docs with n_tokens, ids_text (decimal ids joined by a space), decoded, ids_sha256 and decoded_sha256.

    A null or empty text has no tokens: empty strings and their digests. Own columns of these names are replaced. The
    strings `<|startoftext|>` and `<|endoftext|>` in a text are special tokens. With ids=False the two texts are
    left out. One pass over the rows, no shuffle; repeated rows are encoded one by one.
    """
    fields = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids_text string, decoded string" * ids

    @F.pandas_udf(fields)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        of = coder(path)
        digest = lambda s: hashlib.sha256(s.encode("utf-8", "replace")).hexdigest()
        for batch in batches:
            rows = []
            texts = batch.fillna("").tolist()
            for at in range(0, len(texts), TOGETHER):
                rows += [(n, digest(i), digest(d), *((i, d) if ids else ())) for n, i, d in of.encode(texts[at : at + TOGETHER])]
            yield pd.DataFrame(rows, columns=[f.split(" ")[0] for f in fields.split(", ")])

    names = [f.split(" ")[0] for f in fields.split(", ")]
    keep = [c for c in docs.columns if c not in names]
    return docs.select(*(F.col(f"`{c}`") for c in keep), run(F.col(text)).alias("__coded")).select(*(F.col(f"`{c}`") for c in keep), *(F.col(f"__coded.{n}").alias(n) for n in names))
