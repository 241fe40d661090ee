"""Secrets in free text: one scan for spans and for keys with values, as Column expressions and as a row function.

At each place a span is looked for first, then a key with its value. The search goes on behind a span, but inside a value, so a
secret or another key in it is found too. Of edits that overlap the outermost counts. Java and Python read the patterns alike.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules

_TOKEN = r"[A-Za-z0-9\-._~+/]"
_B64 = r"[A-Za-z0-9_\-]"

# Prefixes of access tokens, what follows them, and how much of it.
PROVIDERS = [
    (["ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_"], "[A-Za-z0-9]", "36,"),
    (["github_pat_"], "[A-Za-z0-9_]", "22,"),
    (["glpat-"], _B64, "20,"),
    (["xoxb-", "xoxp-", "xoxa-", "xoxr-", "xoxs-", "xoxe-"], r"[A-Za-z0-9\-]", "10,"),
    (["sk_live_", "rk_live_", "sk_test_", "rk_test_"], "[A-Za-z0-9]", "16,"),
    (["AIza"], _B64, "35"),
]


def _provider() -> str:
    parts = [f"(?:{'|'.join(names)}){kind}{{{many}}}" + ("" if many.endswith(",") else f"(?!{kind})") for names, kind, many in PROVIDERS]
    return rf"(?<![A-Za-z0-9_])(?:{'|'.join(parts)})"


#: What stays before a secret.
_SCHEME, _URL = r"(?i:bearer|basic)[ \t]+", r"[A-Za-z][A-Za-z0-9+.\-]*+://"
_LABEL = r"(?=(?:(?!-----)[^\n]){0,65}-----)(?:(?!-----)[^\n])*?PRIVATE KEY(?:(?!-----)[^\n])*?"
PEM_LEAD = rf"-----BEGIN {_LABEL}-----"


def _pem_body(group: int) -> str:
    return rf"(?!-----END \{group}-----)[\s\S]+?(?=-----END \{group}-----|(?![\s\S]))"


def _pem(group: int) -> str:
    """The label is that group."""
    return rf"-----BEGIN ({_LABEL})-----{_pem_body(group)}"


#: At least eight characters, `=` at the end only; up to 19 small letters alone are prose.
_CREDENTIAL = rf"(?![a-z]{{1,19}}(?![A-Za-z0-9\-._~+/=]))(?:{_TOKEN}{{8,}}=*|" + "|".join(rf"{_TOKEN}{{{n}}}={{{8 - n},}}" for n in range(7, -1, -1)) + ")"
#: Spans that begin at no letter's or digit's inside, in the order in which they are tried: name, pattern.
SPANS = {
    "card": r"[0-9](?:[ \-]?[0-9]){12,18}(?![A-Za-z0-9]|[ \-][0-9])",
    "bearer": rf"(?<!_){_SCHEME}{_CREDENTIAL}",
    "jwt": rf"(?<![A-Za-z0-9_\-.])eyJ{_B64}{{7,}}\.eyJ{_B64}{{7,}}\.{_B64}*",
    "provider_token": _provider(),
    "aws_key_id": r"(?:AKIA|ASIA|ABIA|ACCA)[A-Z0-9]{16}(?![A-Za-z0-9])",
    "url_userinfo": rf"(?<![A-Za-z0-9+.\-]){_URL}[^/?#@\s]+(?=@)",
}

_KEY_CHAR = r"[A-Za-z0-9_.\-]"
_KEY = rf"(?=[A-Za-z0-9_.\-]*[A-Za-z])[A-Za-z_\-.]{_KEY_CHAR}{{0,63}}"
_VALUE_CHAR = r"[^,;&)\]}>\"'\s]"
#: A separator goes on with the value unless the text ends, white space follows, or a `key=`.
_RUN = rf"(?:{_VALUE_CHAR}|[,;&](?={_VALUE_CHAR}|[,;&])(?![A-Za-z_\-.]{_KEY_CHAR}{{0,63}}=))+"
_QUOTED = r"(?:\"(?:[^\"\\\n]|\\[^\n]|\\(?=\n))+|'(?:[^'\\\n]|\\[^\n]|\\(?=\n))+)"
_SEPARATOR = r"[ \t]*(?:=|:(?!//))[ \t]*"
#: Between quotes, or bare; a separator is looked for first: few words have one, and keys are many.
_QUOTED_KEY = rf"(?:\"{_KEY}\"|'{_KEY}')(?=[ \t]*[=:])"
_BARE_KEY = rf"(?<![A-Za-z0-9_.\-/])(?={_KEY_CHAR}++[ \t]*+[=:]){_KEY}(?!{_KEY_CHAR})"
_VALUE = rf"(?:{_QUOTED}|(?i:bearer|basic|token)[ \t]+{_RUN}|{_RUN})"


def spans(cards: bool = False, aws: bool = False) -> dict[str, str]:
    return {n: p for n, p in SPANS.items() if (cards or n != "card") and (aws or n != "aws_key_id")}


def _alternatives(cards: bool, aws: bool, pem: str, quoted: str, bare: str, wrap: Callable[[str, str], str] = lambda name, p: p) -> str:
    """All that may begin at one place; what begins inside a word is passed over at once."""
    outside = f"{wrap('pem', pem)}|{wrap('quoted', quoted)}"
    inside = "|".join(wrap(n, p) for n, p in spans(cards, aws).items())
    return rf"(?:{outside}|(?<![A-Za-z0-9])(?:{inside}|{wrap('bare', bare)}))"


def _scan(cards: bool, aws: bool) -> tuple[str, dict[str, list[int]]]:
    """A pattern for Java, and its groups by name: a span or a key with its value, what stays before the secret or value, a pair's key, a card number.

    The match itself is what the search goes on behind: all of a span, but only what is before a value, and a card number's first digit.
    """
    groups: dict[str, list[int]] = {"hit": [], "lead": [], "key": [], "card": []}
    count = 0

    def group(*names: str) -> int:
        nonlocal count
        count += 1
        for name in names:
            groups[name].append(count)
        return count

    def told(name: str, p: str) -> str:
        """An alternative with groups that tell what it is. Java keeps groups of what is looked ahead for and then fails, so nothing may fail behind those."""
        group("hit", "card") if name == "card" else group("hit")
        if name == "card":
            return f"(?=({p}))[0-9]"
        if name in ("quoted", "bare"):
            group("lead"), group("key")
            key = rf"[\"']({_KEY_CHAR}+)[\"']" if name == "quoted" else f"({_KEY_CHAR}+)"
            return rf"(?=({p}))({key}{_SEPARATOR}[\"']?)"
        if name == "pem":
            group("lead")
            return f"(({PEM_LEAD.replace(_LABEL, f'({_LABEL})')}){_pem_body(group())})"
        before = {"bearer": _SCHEME, "url_userinfo": _URL}.get(name)
        if before:
            group("lead")
            p = p.replace(before, f"({before})", 1)
        return f"({p})"

    return _alternatives(cards, aws, "", _QUOTED_KEY + _SEPARATOR + _VALUE, _BARE_KEY + _SEPARATOR + _VALUE, told), groups


def scan_pattern(cards: bool = False, aws: bool = False) -> str:
    """A pattern whose group 1 is a span, or a key with its value; the match itself is what the search goes on behind."""
    full = _alternatives(cards, aws, _pem(2), _QUOTED_KEY + _SEPARATOR + _VALUE, _BARE_KEY + _SEPARATOR + _VALUE)
    behind = _alternatives(cards, aws, _pem(3), _QUOTED_KEY + _SEPARATOR + "[\"']?", _BARE_KEY + _SEPARATOR + "[\"']?", lambda name, p: "[0-9]" if name == "card" else p)
    return f"(?=({full})){behind}"


#: Strings of which a text with such a span holds one at least; Bearer and Basic in lower case.
HINTS = {
    "pem": ["-----BEGIN "], "bearer": ["bearer", "basic"], "jwt": ["eyJ"], "provider_token": ["glpat-", "xox", "AIza"],
    "url_userinfo": ["://"], "aws_key_id": ["AKIA", "ASIA", "ABIA", "ACCA"],
}
#: Prefixes of providers with "_": looked for only in texts that hold one.
_UNDERSCORED = [n for names, _, _ in PROVIDERS for n in names if "_" in n]


def may_hold(text: Column, cards: bool = False, aws: bool = False, embedded: bool = False) -> Column:
    """Whether a text may hold a span, a key and value or, if asked, a document: plain searches, far cheaper than the pattern."""
    out = text.contains("=") | text.contains(":") | (text.contains("_") & reduce(or_, (text.contains(n) for n in _UNDERSCORED)))
    for name in ["pem", *spans(cards, aws)]:
        if name == "card":
            out = out | text.rlike("[0-9](?:[ -]?[0-9]){12}")
            continue
        where = F.lower(text) if name == "bearer" else text
        for hint in HINTS[name]:
            out = out | where.contains(hint)
    return out | text.contains("{") | text.contains("[") if embedded else out


def is_candidate(text: Column, cards: bool = False, aws: bool = False) -> Column:
    """Whether a text holds any span or any key and value."""
    return may_hold(text, cards, aws) & text.rlike(scan_pattern(cards, aws))


#: What a found string is, by itself: a span of this kind, else a key with its value.
_LEAD = rf"^(?:{PEM_LEAD}|{_SCHEME}|{_URL})"
_PAIR_LEAD = rf"^((?:{_QUOTED_KEY}|{_BARE_KEY}){_SEPARATOR}[\"']?)"


def _hits(text: Column, cards: bool, aws: bool) -> Column:
    """array<struct<h, kind, lead, consumed>>: what is found, its kind (`pair` for keys and values), characters before the secret or the value, and before the place to go on."""

    def one(h: Column) -> Column:
        kind = F.when(h.rlike("^" + PEM_LEAD), "pem")
        for name, p in spans(cards, aws).items():
            kind = kind.when(h.rlike("^(?:" + p.replace("(?=@)", "") + r")\z"), name)
        return F.struct(h.alias("h"), kind.otherwise("pair").alias("kind"))

    def measured(x: Column) -> Column:
        pair = F.length(F.regexp_extract(x["h"], _PAIR_LEAD, 1))
        lead = F.when(x["kind"] == "pair", pair).when(x["kind"].isin("pem", "bearer", "url_userinfo"), F.length(F.regexp_extract(x["h"], _LEAD, 0))).otherwise(0)
        return F.struct(x["h"].alias("h"), x["kind"].alias("kind"), lead.alias("lead"), F.when(x["kind"] == "pair", lead).when(x["kind"] == "card", 1).otherwise(F.length(x["h"])).alias("consumed"))

    found = F.when(may_hold(text, cards, aws), F.regexp_extract_all(text, F.lit(scan_pattern(cards, aws)), F.lit(1))).otherwise(F.array().cast("array<string>"))
    return F.transform(F.transform(found, one), measured)


def _secret(x: Column) -> Column:
    return F.substr(x["h"], x["lead"] + 1)


def _digits(h: Column) -> Column:
    return F.regexp_replace(h, "[ -]", "")


def _valid(x: Column) -> Column:
    return (x["kind"] != "card") | F.call_function("luhn_check", _digits(x["h"]))


def _key(x: Column) -> Column:
    return F.regexp_extract(x["h"], rf"^[\"']?({_KEY_CHAR}+)", 1)


def detect_spans(text: Column, cards: bool = False, aws: bool = False) -> Column:
    """array<struct<kind, secret>> in the order of the text; of overlapping card numbers all."""
    found = F.filter(_hits(text, cards, aws), lambda x: (x["kind"] != "pair") & _valid(x))
    return F.transform(found, lambda x: F.struct(x["kind"].alias("kind"), _secret(x).alias("secret")))


def detect_pairs(text: Column) -> Column:
    """array<struct<key, value>> of keys and values, values without their opening quote; those inside a value too, but not those inside a span."""
    found = F.filter(_hits(text, False, False), lambda x: x["kind"] == "pair")
    return F.transform(found, lambda x: F.struct(_key(x).alias("key"), _secret(x).alias("value")))


#: Stand between what is found in a text, and behind it. They are no characters (U+FDD0, U+FDD1): in texts they are replaced.
_FIELD, _FOUND = chr(0xFDD0), chr(0xFDD1)


def mask_text(text: Column, keys: dict[str, rules.Rule], marker: str, cards: bool = False, aws: bool = False) -> Column:
    """text with the values of policy keys and all spans masked: one pass of a Java pattern, no Python.

    Spans don't overlap, so where no value and no card number may be masked they are replaced as they stand; else an ordered fold settles which edits count.
    The noncharacters U+FDD0 and U+FDD1 in a text that may hold something become U+FFFD.
    """
    by_rule: dict[rules.Rule, list[str]] = {}
    for k, r in keys.items():
        by_rule.setdefault(r, []).append(k)
    pattern, groups = _scan(cards, aws)
    told = "".join(_FIELD + "".join(f"${n}" for n in groups[name]) for name in ("hit", "lead", "key", "card")) + _FOUND
    clean = F.when(text.rlike(f"[{_FIELD}{_FOUND}]"), F.translate(text, _FIELD + _FOUND, chr(0xFFFD) * 2)).otherwise(text)
    folded_key = lambda key: F.lower(F.translate(key, "_-.", ""))

    def edit(f: Column) -> Column:
        """Of a piece of text and what was found behind it: what stands in place of the secret or the value (NULL: it stays), and what the fold asks for."""
        h, key, card = (F.coalesce(F.get(f, F.lit(i)), F.lit("")) for i in (1, 3, 4))
        lead = F.coalesce(F.length(F.get(f, F.lit(2))), F.lit(0))
        new = F.when(card != "", F.when(F.call_function("luhn_check", _digits(h)), rules.card(h, marker))) if cards else F.when(F.lit(False), F.lit(""))
        for rule, names in by_rule.items():
            new = new.when((key != "") & folded_key(key).isin(names), rule(F.substr(h, lead + 1), marker))
        new = new.when((key == "") & (h != ""), F.lit(marker))
        return F.struct(F.get(f, F.lit(0)).alias("piece"), h.alias("h"), lead.alias("lead"), F.when(key != "", lead).when(card != "", 1).otherwise(F.length(h)).alias("consumed"), new.alias("new"))

    def cut(part: Column, n: Column) -> Column:
        return F.when(n <= 0, part).otherwise(F.substr(part, n + 1))

    def step(acc: Column, x: Column) -> Column:
        """acc: where the next piece begins, where the last edit begins and up to where the text is done, what is written. x: a piece of text and what was found behind it."""
        start = acc["pos"] + F.length(x["piece"])
        begin, end = start + x["lead"], start + F.length(x["h"])
        edits = x["new"].isNotNull()
        kept = edits & (begin >= acc["done"])
        # of edits with one beginning the longer counts: a card number in groups, whose first is a key's value
        longer = edits & (begin == acc["begin"]) & (end > acc["done"])
        shown = cut(F.left(x["h"], F.when(kept, x["lead"]).otherwise(x["consumed"])), acc["done"] - start)
        written = F.when(longer & ~kept, F.slice(acc["out"], F.lit(1), F.size(acc["out"]) - 1)).otherwise(F.array_append(acc["out"], F.concat(cut(x["piece"], acc["done"] - acc["pos"]), shown)))
        return F.struct(
            (start + x["consumed"]).alias("pos"),
            F.when(kept, begin).otherwise(acc["begin"]).alias("begin"),
            F.when(kept | longer, end).otherwise(acc["done"]).alias("done"),
            F.when(kept | longer, F.array_append(written, x["new"])).otherwise(written).alias("out"),
        )

    def settled(parts: Column) -> Column:
        begin = F.struct(F.lit(0).alias("pos"), F.lit(-1).alias("begin"), F.lit(0).alias("done"), F.array().cast("array<string>").alias("out"))
        return F.aggregate(F.transform(parts, edit), begin, step, lambda acc: F.array_join(acc["out"], ""))

    def spans_only(parts: Column) -> Column:
        """Spans become what is before their secret, and the marker; of keys with values what is before the value is put back."""
        put = lambda f: F.concat(f[0], f[2], F.when(f[3] == "", marker).otherwise(""))
        return F.array_join(F.transform(parts, lambda f: F.when(F.size(f) == 1, f[0]).otherwise(put(f))), "")

    def whole(parts: Column) -> Column:
        behind = lambda f, i: F.coalesce(F.get(f, F.lit(i)), F.lit(""))
        values = F.exists(parts, lambda f: (behind(f, 3) != "") & folded_key(behind(f, 3)).isin(list(keys))) if keys else F.lit(False)
        numbers = F.exists(parts, lambda f: behind(f, 4) != "") if cards else F.lit(False)
        return F.when(values | numbers, settled(parts)).otherwise(spans_only(parts))

    parts = F.transform(F.split(F.regexp_replace(clean, pattern, told), _FOUND), lambda part: F.split(part, _FIELD))
    return F.when(may_hold(text, cards, aws), _let(parts, whole)).otherwise(text)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), for which value is made once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


# ---- row by row -------------------------------------------------------------------------------------------------------

_DIGITS = re.compile("[0-9](?:[ -]?[0-9]){12}")


def may_hold_row(text: str, cards: bool = False, aws: bool = False) -> bool:
    """may_hold() of one text."""
    if "=" in text or ":" in text or "_" in text and any(n in text for n in _UNDERSCORED) or "eyJ" in text or "glpat-" in text or "xox" in text or "AIza" in text or "-----BEGIN " in text:
        return True
    if aws and any(h in text for h in HINTS["aws_key_id"]) or cards and _DIGITS.search(text):
        return True
    small = text.lower()
    return "bearer" in small or "basic" in small


def _row_pattern(cards: bool, aws: bool) -> re.Pattern:
    named = lambda name, p: f"(?P<{name}>{p})"
    return re.compile(_alternatives(cards, aws, _pem(2), f"{_QUOTED_KEY}{_SEPARATOR}(?P<v1>{_VALUE})", f"{_BARE_KEY}{_SEPARATOR}(?P<v2>{_VALUE})", named), re.ASCII)


_SCANS = {(cards, aws): _row_pattern(cards, aws) for cards in (False, True) for aws in (False, True)}
_LEAD_ROW, _KEY_ROW = re.compile(_LEAD, re.ASCII), re.compile(rf"[\"']?({_KEY_CHAR}+)")


def luhn(digits: str) -> bool:
    total = sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(digits)))
    return total % 10 == 0


def scan_row(text: str, cards: bool = False, aws: bool = False) -> Iterator[tuple[str, str, int, int]]:
    """Kind, key (of a pair), begin and end of each secret or value."""
    search, at = _SCANS[cards, aws].search, 0
    while m := search(text, at):
        kind = m.lastgroup
        if kind == "quoted" or kind == "bare":
            begin = m.start("v1" if kind == "quoted" else "v2")
            begin += text[begin] in "\"'"
            yield "pair", _KEY_ROW.match(text, m.start())[1], begin, m.end()
            at = begin
        elif kind == "card":
            if luhn(re.sub("[ -]", "", m[0])):
                yield kind, "", m.start(), m.end()
            at = m.start() + 1
        else:
            yield kind, "", m.start() + (len(_LEAD_ROW.match(m[0])[0]) if kind in ("pem", "bearer", "url_userinfo") else 0), m.end()
            at = m.end()


def locate_row(text: str, cards: bool = False, aws: bool = False) -> list[tuple[str, str, int, int]]:
    """(kind, key, begin, end) of all pairs and secrets, in order; places count characters from 0."""
    return sorted(scan_row(text, cards, aws), key=lambda f: (f[2], f[3], f[0]))


def mask_text_row(text: str, decide: Callable[[str, str], str | None], marker: str, cards: bool = False, aws: bool = False) -> str:
    """text with spans masked, and values for whose key and value decide() gives a text; of overlapping edits the outermost counts."""
    if not may_hold_row(text, cards, aws):
        return text
    edits = []
    for kind, key, begin, end in scan_row(text, cards, aws):
        out = decide(key, text[begin:end]) if kind == "pair" else rules.card.row(text[begin:end], marker) if kind == "card" else marker
        if out is not None:
            edits.append((begin, -end, out))
    out, at = [], 0
    for begin, end, new in sorted(edits, key=lambda e: e[:2]):
        if begin >= at:
            out += [text[at:begin], new]
            at = -end
    return "".join([*out, text[at:]])
