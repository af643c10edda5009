"""Personal data by offset-preserving deobfuscation.

Detectors for e-mail addresses, IPv4 addresses, card and phone numbers run on the text itself (base spans). A chain of
transducers then rewrites disguises (homoglyphs, spelled digits, "at" and "dot") while it keeps, for each character it
writes, the source characters it came from; the same detectors run on what was rewritten, and their spans are mapped
back to the source. A span found only that way is added unless it overlaps a base span of its kind.

One pass over the rows, no shuffle; every scan takes time in proportion to the text.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from . import common as c

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]

# The contract's patterns, with possessive quantifiers where a failure must not be retried.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)++")
_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def emails(text: str) -> list[Span]:
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            out.append((start, end))
        else:
            # Nothing that begins before this @ can match, as @ is in no local part.
            end = max(end, at + 1)
        at = text.find("@", max(end, at + 1))
    return out


def ips(text: str) -> list[Span]:
    """Of a chain of numbers with dots between, each four make a match; those with a part over 255 are dropped."""
    out = []
    for m in _DOTTED.finditer(text):
        parts, at = m.group().split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in four):
                out.append((at, end))
            at = end + 1
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def cards(text: str) -> list[Span]:
    out = []
    for m in _DIGITS.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(m.span())
    return out


def phones(text: str) -> list[Span]:
    return [m.span() for m in _PHONE.finditer(text) if 8 <= len(_DIGIT.findall(m.group())) <= 15]


def detect(text: str) -> dict[str, list[Span]]:
    return {
        "email": emails(text) if "@" in text else [],
        "ip": ips(text),
        "card": cards(text),
        "phone": phones(text) if "+" in text else [],
    }


# Homoglyphs, fixed values: letters of other scripts that look like a Latin one, in pairs.
_PAIRS = (
    "аa вB еe кK мM нH оo рp сc тT уy хx іi јj ѕs һh ԁd ԛq ԝw АA ВB ЕE КK МM НH ОO РP СC ТT УY ХX ІI ЈJ ЅS "
    "αa οo ρp νv ιi κk τt υu ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX"
)
_HOMOGLYPHS = {p[0]: p[1] for p in _PAIRS.split()}
#: Characters that show nothing: soft hyphen, zero-width space, joiners, word joiner, byte order mark.
_HIDDEN = "­​‌‍⁠﻿"
#: Full-width forms U+FF01 to U+FF5E stand for U+0021 to U+007E; other decimal digits for 0 to 9.
_OTHER_DIGITS = "".join(chr(i) for i in range(0x80, 0x1FBFA) if unicodedata.decimal(chr(i), None) is not None)
_ODD_CHARS = frozenset([*_HOMOGLYPHS, *_HIDDEN, *_OTHER_DIGITS, *map(chr, range(0xFF01, 0xFF5F))])
_ODD = re.compile("[" + "".join(_HOMOGLYPHS) + _HIDDEN + "！-～" + _OTHER_DIGITS + "]")

_NAMES = "zero one two three four five six seven eight nine".split()
_VALUE = {name: str(i) for i, name in enumerate(_NAMES)} | {"oh": "0"}
_NUMBER = "(?:" + "|".join(_VALUE) + ")"
#: At least four digits in words, or digits and words mixed, one after the other.
_SPELLED = re.compile(rf"(?<![A-Za-z0-9])(?:{_NUMBER}|[0-9])(?:[ \t-]{{1,2}}(?:{_NUMBER}|[0-9]{{1,4}})){{3,}}+(?![A-Za-z0-9])", re.I)
# Hints are looked for in lower case.
_SPELLED_HINT = re.compile(rf"(?<![a-z]){_NUMBER}[ \t-]{{1,2}}(?:{_NUMBER}|[0-9])|[0-9][ \t-]{{1,2}}{_NUMBER}")
_TOKEN = re.compile(rf"{_NUMBER}|[0-9]", re.I)
_PLUS = re.compile(r"(?<![A-Za-z0-9])plus[ \t]{1,2}(?=[0-9])", re.I)
_BRACKETED = re.compile(r"[ \t]{0,2}[\[({<][ \t]{0,2}(at|dot|@|\.)[ \t]{0,2}[\])}>][ \t]{0,2}", re.I)
_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]{0,62})"
_DOT = r"(?:[ \t]{1,2}dot[ \t]{1,2}|\.)"
_AT = r"(?:[ \t]{1,2}at[ \t]{1,2}|@)"
#: Last labels, fixed values: those of countries and common others.
_ENDS = (
    "com|org|net|edu|gov|mil|int|info|biz|pro|app|dev|xyz|site|shop|store|tech|cloud|blog|email|club|aero|coop|jobs|mobi|museum|asia|tel|"
    "a[cdefgilmoqrstuwxz]|b[abdefghijmnorstvwyz]|c[acdfghiklmnoruvwxyz]|d[ejkmoz]|e[cegrstu]|f[ijkmor]|g[abdefghilmnpqrstuwy]|h[kmnrtu]|"
    "i[delmnoqrst]|j[emop]|k[eghimnprwyz]|l[abcikrstuvy]|m[acdeghklmnopqrstuvwxyz]|n[acefgilopruz]|om|p[aefghklmnrstwy]|qa|r[eosuw]|"
    "s[abcdeghijklmnorstuvxyz]|t[cdfghjklmnortvwz]|u[agksyz]|v[aceginu]|w[fs]|y[et]|z[amw]"
)
_NO_HOST = r"(?!(?:the|an?|this|that|my|your|our|his|her|its|their|each|every|which)[ \t]{1,2}dot[ \t]{1,2}(?!(?:com|org|net|edu|gov|info|io|co|de|fr|es|uk|eu)(?![A-Za-z0-9-])))"
#: name at host dot end, where end is such a label and, before labels that may be words, host is no article or the like,
#: so that plain prose isn't taken for an address.
_WORDED = re.compile(
    rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9_%+-]{{1,64}}(?:{_DOT}[A-Za-z0-9_%+-]{{1,64}}){{0,3}}{_AT}{_NO_HOST}{_LABEL}(?:{_DOT}{_LABEL}){{0,4}}?{_DOT}"
    rf"(?:{_ENDS})(?![A-Za-z0-9-])",
    re.I,
)
_WORDED_HINT = re.compile(r"[ \t]dot[ \t]|[ \t]at[ \t]{1,2}[a-z0-9-]+\.|@[a-z0-9-]+[ \t]dot")
_AT_OR_DOT = re.compile(r"[ \t]{1,2}(at|dot)[ \t]{1,2}", re.I)
_NUMBER_DOT = re.compile(r"(?<=[0-9])[ \t]{1,2}(?:dot|point)[ \t]{1,2}(?=[0-9])", re.I)
_SPELLED_OCTETS = re.compile(rf"(?<![A-Za-z0-9])(?:(?:{_NUMBER}|[0-9]+)[ \t]+){{1,3}}dot(?:[ \t]+(?:{_NUMBER}|[0-9]+)){{1,3}}(?:[ \t]+dot(?:[ \t]+(?:{_NUMBER}|[0-9]+)){{1,3}}){{2}}(?![A-Za-z0-9])", re.I)


class Mapped:
    """A text with, for each character, the source characters [start, end) it stands for."""

    def __init__(self, text: str, start: list[int] | None = None, end: list[int] | None = None):
        self.text = text
        self.start = start if start is not None else list(range(len(text)))
        self.end = end if end is not None else list(range(1, len(text) + 1))

    def rewrite(self, pattern: re.Pattern, write: Callable[[re.Match], str]) -> Mapped:
        """Each match replaced by write(match); what is written stands for the whole match."""
        text, start, end, last = [], [], [], 0
        for m in pattern.finditer(self.text):
            new = write(m)
            if new == m.group():
                continue
            a, b = m.span()
            text += [self.text[last:a], new]
            start += self.start[last:a] + [self.start[a]] * len(new)
            end += self.end[last:a] + [self.end[b - 1]] * len(new)
            last = b
        if not last:
            return self
        return Mapped("".join([*text, self.text[last:]]), start + self.start[last:], end + self.end[last:])


def _plain_char(m: re.Match) -> str:
    ch = m.group()
    if ch in _HIDDEN:
        return ""
    if "！" <= ch <= "～":
        return chr(ord(ch) - 0xFEE0)
    return _HOMOGLYPHS.get(ch) or str(unicodedata.decimal(ch))


def _digits(m: re.Match) -> str:
    return "".join(_VALUE.get(x.lower(), x) for x in _TOKEN.findall(m.group()))


def _octets(m: re.Match) -> str:
    return ".".join("".join(_VALUE.get(x.lower(), x) for x in _TOKEN.findall(part)) for part in re.split("dot", m.group(), flags=re.I))


def hinted(text: str) -> bool:
    """Whether a transducer of words or brackets may rewrite something; a word that must be there is looked for before
    its pattern is."""
    low = text.lower()
    if not text.isascii():
        # What patterns that ignore case take for ASCII letters.
        for odd, plain in (("ſ", "s"), ("ı", "i"), ("i̇", "i")):
            if odd in low:
                low = low.replace(odd, plain)
    dot = "dot" in low
    return bool(
        ((dot or "at " in low or "at\t" in low) and _WORDED_HINT.search(low))
        or _SPELLED_HINT.search(low)
        or (any(x in low for x in "[({<") and _BRACKETED.search(low))
        or ("plus" in low and _PLUS.search(low))
        or ((dot or "point" in low) and _NUMBER_DOT.search(low))
    )


def deobfuscate(text: str) -> Mapped | None:
    """The rewritten text, None if there is no disguise in it. What any transducer can rewrite is hinted at."""
    has_odd = not text.isascii() and not _ODD_CHARS.isdisjoint(text)
    if not has_odd and not hinted(text):
        return None
    m = Mapped(text)
    if has_odd:
        m = m.rewrite(_ODD, _plain_char)
    m = m.rewrite(_BRACKETED, lambda x: {"at": "@", "dot": "."}.get(x[1].lower(), x[1]))
    m = m.rewrite(_SPELLED_OCTETS, _octets)
    m = m.rewrite(_SPELLED, lambda x: _digits(x) if re.search("[A-Za-z]", x.group()) else x.group())
    m = m.rewrite(_PLUS, lambda x: "+")
    m = m.rewrite(_NUMBER_DOT, lambda x: ".")
    # The words "at" and "dot" only where the whole reads as an address; one rewrite per word keeps offsets narrow.
    inside = [x.span() for x in _WORDED.finditer(m.text)]
    if inside:
        where = iter(inside)
        now = next(where)

        def worded(x: re.Match) -> str:
            nonlocal now
            while now and now[1] <= x.start():
                now = next(where, None)
            return {"at": "@", "dot": "."}[x[1].lower()] if now and now[0] <= x.start() and x.end() <= now[1] else x.group()

        m = m.rewrite(_AT_OR_DOT, worded)
    return m if m.text != text else None


def find_spans(text: str | None) -> tuple[dict[str, list[Span]], dict[str, list[Span]]]:
    """Base spans, and base and added spans together, by kind; code points, end exclusive."""
    text = text or ""
    base = detect(text)
    m = deobfuscate(text)
    if m is None:
        return base, base
    every = {}
    for kind, spans in detect(m.text).items():
        every[kind] = list(base[kind])
        for a, b in spans:
            s, e = m.start[a], m.end[b - 1]
            if text[s:e] != m.text[a:b] and not any(s < y and x < e for x, y in base[kind]):
                every[kind].append((s, e))
        every[kind].sort()
    return base, every


def joined(spans: dict[str, list[Span]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind in KINDS for a, b in spans[kind])


def scan_pii(docs: DataFrame) -> DataFrame:
    """A row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans and n_added.

    Null and empty texts have no spans; a null doc_id stays a row; repeated rows give repeated results; long texts are
    scanned whole; where matches of one kind could overlap, the leftmost holds. Columns other than doc_id and text are
    not read; an empty table gives an empty one.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch["text"]:
                base, every = find_spans(text)
                n = [len(base[k]) for k in KINDS]
                rows.append((*n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(every), sum(map(len, every.values())) - sum(n)))
            out = pd.DataFrame(rows, columns=[*(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])
            yield out.assign(doc_id=batch["doc_id"].to_numpy(), no_id=batch["no_id"].to_numpy())

    counts = ", ".join(f"n_{k} long" for k in KINDS)
    found = docs.select(*c.id_columns(), "text").mapInPandas(scan, f"doc_id long, no_id boolean, {counts}, base_sha256 string, spans string, n_added long")
    return c.with_id(found)
