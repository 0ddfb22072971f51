"""Personal data in plain and in disguised form, with offsets in the source.

Plain identifiers are found in the text as it is.  Then transducers rewrite the
text - look-alike and full-width characters, invisible characters, digits spelled
as words, "at" and "dot" in brackets or as words - and carry for every character
they emit the source characters it came from.  The same finders run over the
result, and what they find is mapped back to spans of the source.  A mapped span
is added unless it lies within a plain one of its kind.

Offsets are code points, the end exclusive.  All finders take time linear in the
text.  Rows: a null or empty text has no spans; repeated rows repeat.  Other
columns pass through; one named like the output is replaced.
"""

from __future__ import annotations

import re
import unicodedata
from array import array
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches

#: The kinds, in the order in which spans of one start are listed.
KINDS = ("email", "ip", "card", "phone")
#: Characters that look like an ASCII one.
LOOK_ALIKES = dict(zip("асеорхуіјѕԁһԛԝкмтвнАВСЕНІЈКМОРЅТХΑΒΕΖΗΙΚΜΝΟΡΤΥΧοανικρτυ", "aceopxyijsdhqwkmtbhABCEHIJKMOPSTXABEZHIKMNOPTYXoavikptu")) | dict(zip("‐‑‒–—−﹣", "-------")) | {"。": ".", "｡": ".", "․": ".", "﹒": ".", "﹫": "@"}
#: Digits as words, in four languages.
DIGIT_WORDS = dict(
    zero=0, one=1, two=2, three=3, four=4, five=5, six=6, seven=7, eight=8, nine=9,
    oh=0, null=0, eins=1, zwei=2, drei=3, vier=4, fünf=5, sechs=6, sieben=7, acht=8, neun=9,
    zéro=0, un=1, deux=2, trois=3, quatre=4, cinq=5, sept=7, huit=8, neuf=9,
    cero=0, uno=1, dos=2, tres=3, cuatro=4, cinco=5, seis=6, siete=7, ocho=8, nueve=9,
)
INVISIBLE = "­​‌‍‎‏⁠﻿"

_DIGIT = "(?:" + "|".join(sorted(DIGIT_WORDS, key=len, reverse=True)) + ")"
_AT_WORDS = ("at", "@", "ät", "arroba", "arobase", "chez")
_AT, _DOT = "(?:" + "|".join(_AT_WORDS) + ")", r"(?:dot|\.|punkt|punto|point|period)"
_OPEN, _SHUT = r"[\[({<]", r"[\])}>]"
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_ANY_DIGIT = re.compile("[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

_CHAR = re.compile(f"[{INVISIBLE}²³¹]|[^\\x00-\\u024f]")
#: Ends of domains that a spoken "at" must lead to.
_ENDS = "(?:com|org|net|edu|gov|mil|int|info|biz|io|co|ai|app|dev|me|tv|eu|uk|us|de|fr|es|it|nl|be|ch|at|pl|pt|se|no|dk|fi|ru|cn|jp|in|br|mx|ca|au|nz|za)"
_SPOKEN_DOT = r"[ \t]+(?:dot|punkt|punto|point|\.)[ \t]+"
_ANY_DOT = rf"(?:\.|{_SPOKEN_DOT}|[ \t]*{_OPEN}[ \t]*{_DOT}[ \t]*{_SHUT}[ \t]*)"
_DOMAIN_AHEAD = rf"(?=[A-Za-z0-9-]+(?:{_ANY_DOT}[A-Za-z0-9-]+){{0,6}}{_ANY_DOT}{_ENDS}\b)"
_BRACKETED = re.compile(rf"(?<!\s)\s*{_OPEN}\s*(?:({_AT})\s*{_SHUT}\s*{_DOMAIN_AHEAD}|{_DOT}\s*{_SHUT}\s*)", re.I)
_BRACKET_HINT = re.compile(rf"{_OPEN}\s*(?:{_AT}|{_DOT})\s*{_SHUT}", re.I)
_ESCAPED = re.compile(r"&#0*64;|&#x0*40;|&commat;|%40|(&#0*46;|&#x0*2e;|&period;)", re.I)
_LETTER_DIGIT = re.compile(r"(?<=[0-9.])(?:([Oo])|[Il])(?=[0-9.])")
_SPOKEN = re.compile(
    rf"(?<=[A-Za-z0-9])(?:[ \t]+(at|arroba|arobase)[ \t]+|[ \t]+(@)[ \t]*|(@)[ \t]+){_DOMAIN_AHEAD}|(?<=[A-Za-z0-9])[ \t]+(?:dot|punkt|punto|point)[ \t]+(?=[A-Za-z0-9])|(?<=[A-Za-z0-9])[ \t]+\.[ \t]+(?={_ENDS}\b)", re.I
)
#: What stands before and after a spoken "at".
_BEFORE = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_AFTER = re.compile(rf"([A-Za-z0-9-]+)((?:{_ANY_DOT}[A-Za-z0-9-]+){{0,6}}{_ANY_DOT}({_ENDS}))\b", re.I)
#: A local part that no word looks like, an announcement before one, and pronouns, which are none after it.
_NAME_LIKE = re.compile(r"[A-Za-z0-9]+[._+%][A-Za-z0-9._+%-]*[A-Za-z0-9]|[A-Za-z]{2,}[0-9]{2,}")
_CUE = re.compile(r"\b(?:e-?mail|mail|contact|reach|correo|courriel|kontakt)(?:[ \t]+(?:address|me|us|is|to|at))*[ \t]*[:=]?[ \t]+\Z", re.I)
_PRONOUNS = frozenset("me us him her them it you".split())
#: Hints: each is found wherever its transducer changes something.
_SPOKEN_HINT = re.compile(rf"[ \t]@|@[ \t]|[ \t](?:dot|punkt|punto|point)[ \t]|[ \t]\.[ \t]+{_ENDS}\b|[ \t](?:at|arroba|arobase)[ \t]+[A-Za-z0-9-]+[ \t]*[.\[({{<]", re.I)
_SPELLED_HINT = re.compile(rf"\bplus[ ,-]+{_DIGIT}\b|\b{_DIGIT}\b[ ,-]+(?:{_DIGIT}\b|[0-9])", re.I)
_SPELLED = re.compile(rf"(?:\bplus[ ,-]+(?={_DIGIT}\b))?\b{_DIGIT}\b(?:[ ,-]+(?:{_DIGIT}|[0-9]+)\b)*", re.I)
_SPELLED_PART = re.compile(r"plus|[^\W\d_]+|[0-9]", re.I)


def find_emails(t: str) -> list[tuple[int, int]]:
    out, done, at = [], 0, t.find("@")
    while at >= 0:
        a = at
        while a > done and t[a - 1] in _LOCAL_CHARS:
            a -= 1
        m = _DOMAIN.match(t, at + 1) if a < at else None
        if m:
            out.append((a, m.end()))
            done = m.end()
        else:
            done = max(done, at + 1)
        at = t.find("@", done)
    return out


def find_ips(t: str) -> list[tuple[int, int]]:
    small = lambda d: len(d := d.lstrip("0")) <= 3 and int(d or 0) <= 255
    return [m.span() for m in _IP.finditer(t) if all(map(small, m.groups()))]


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def find_cards(t: str) -> list[tuple[int, int]]:
    out = []
    for m in _CARD.finditer(t):
        if m.end() - m.start() >= 12:
            d = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(d) <= 19 and luhn(d):
                out.append(m.span())
    return out


def find_phones(t: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(t) if 9 <= sum(map(str.isdigit, m.group())) <= 15]


FINDERS: dict[str, Callable] = {"email": find_emails, "ip": find_ips, "card": find_cards, "phone": find_phones}


def find_all(t: str) -> list[tuple[int, int, str]]:
    """Spans (start, end, kind) by start, then kind in the order of KINDS."""
    out = [(a, b, 0) for a, b in find_emails(t)] if "@" in t else []
    if _ANY_DIGIT.search(t):
        out += [(a, b, 1) for a, b in find_ips(t)]
        out += [(a, b, 2) for a, b in find_cards(t)]
        if "+" in t:
            out += [(a, b, 3) for a, b in find_phones(t)]
    out.sort(key=lambda x: (x[0], x[2]))
    return [(a, b, KINDS[k]) for a, b, k in out]


class Tape:
    """A rewritten text and, for each of its characters, the source span it stands for."""

    def __init__(self, text: str, first: array | None = None, last: array | None = None):
        self.text = text
        self.first = array("q", range(len(text))) if first is None else first
        self.last = array("q", range(1, len(text) + 1)) if last is None else last

    def rewrite(self, pattern: re.Pattern, change: Callable[[re.Match], list[tuple[str, int, int]] | None]) -> Tape:
        """Replace matches; ``change`` gives (character, start, end) in this tape, or None to leave the match."""
        out, first, last, done = [], array("q"), array("q"), 0
        for m in pattern.finditer(self.text):
            new = change(m)
            if new is None:
                continue
            a, b = m.span()
            out.append(self.text[done:a])
            first += self.first[done:a]
            last += self.last[done:a]
            for c, x, y in new:
                out.append(c)
                first.append(self.first[x])
                last.append(self.last[y - 1])
            done = b
        if not done:
            return self
        out.append(self.text[done:])
        first += self.first[done:]
        last += self.last[done:]
        return Tape("".join(out), first, last)


@lru_cache(1 << 14)
def _plain(c: str) -> str | None:
    """The ASCII character that one above it stands for."""
    if c in LOOK_ALIKES:
        return LOOK_ALIKES[c]
    if (d := unicodedata.digit(c, None)) is not None:
        return str(d)
    plain = unicodedata.normalize("NFKC", c)
    return plain if len(plain) == 1 and plain.isascii() else None


def _plain_char(m: re.Match) -> list[tuple[str, int, int]] | None:
    c = m.group()
    if c in INVISIBLE:
        return []
    new = _plain(c)
    return None if new is None else [(new, m.start(), m.end())]


def _evident(m: re.Match) -> bool:
    """Whether a spoken "at" is one of an address, not the preposition before the name of a site.

    Evidence is a dot that is disguised too, a local part that is no word, a word that announces
    an address right before it, or a line that holds nothing else.
    """
    t = m.string
    local, domain = _BEFORE.search(t, max(0, m.start() - 64), m.start()), _AFTER.match(t, m.end())
    if local is None or domain is None:
        return False
    dots = [c for c in domain.group(2) if not c.isalnum() and c != "-"]
    if (set(dots) != {"."} or re.search(r"\s", domain.group(2))) and domain.group(1).lower() not in DIGIT_WORDS:
        return True
    if _NAME_LIKE.fullmatch(local.group()):
        return True
    if _CUE.search(t, max(0, local.start() - 40), local.start()) and local.group().lower() not in _PRONOUNS:
        return True
    before, after = t[t.rfind("\n", 0, local.start()) + 1 : local.start()], t[domain.end() : domain.end() + 8].partition("\n")[0]
    return not before.strip() and not after.strip()


def _sign(m: re.Match) -> list[tuple[str, int, int]] | None:
    word = next((g for g in m.groups() if g), ".")
    if m.re is _SPOKEN and word.lower() == "at" and not _evident(m):
        return None
    if m.re is _BRACKETED and m.group(1) and m.group()[-1].isspace():
        # a remark in brackets may stand before a name with the end of a country's domain
        domain = _AFTER.match(m.string, m.end())
        if domain and len(domain.group(3)) == 2 and not _evident(m):
            return None
    return [("@" if word.lower() in _AT_WORDS else ".", m.start(), m.end())]


def _escaped(m: re.Match) -> list[tuple[str, int, int]]:
    return [("." if m.group(1) else "@", m.start(), m.end())]


def _letter_digit(m: re.Match) -> list[tuple[str, int, int]]:
    return [("0" if m.group(1) else "1", m.start(), m.end())]


def _digits(m: re.Match) -> list[tuple[str, int, int]] | None:
    words = _SPELLED_PART.findall(m.group())
    if len(words) < 2 or len(words) < 3 and words[0].lower() != "plus":
        return None
    out = []
    for w in _SPELLED_PART.finditer(m.group()):
        word = w.group().lower()
        c = "+" if word == "plus" else str(DIGIT_WORDS.get(word, word))
        if len(c) > 1:  # one that only looks like a digit's word in lower case
            return None
        out.append((c, m.start() + w.start(), m.start() + w.end()))
    return out


#: The transducers in their order, each with a hint whether the text so far may hold what it changes.
STEPS: tuple[tuple[Callable[[str], object], re.Pattern, Callable], ...] = (
    (lambda t: not t.isascii() and _CHAR.search(t), _CHAR, _plain_char),
    (lambda t: ("&" in t or "%40" in t) and _ESCAPED.search(t), _ESCAPED, _escaped),
    (_LETTER_DIGIT.search, _LETTER_DIGIT, _letter_digit),
    (_SPELLED_HINT.search, _SPELLED, _digits),
    (_BRACKET_HINT.search, _BRACKETED, _sign),
    (_SPOKEN_HINT.search, _SPOKEN, _sign),
)


def normalise(text: str) -> Tape | None:
    """The rewritten text, or nothing if no hint finds a disguise."""
    tape, t = None, text
    for hint, pattern, change in STEPS:
        if hint(t):
            tape = (tape or Tape(text)).rewrite(pattern, change)
            t = tape.text
    return tape


def spans(text: str) -> list[tuple[int, int, str, bool]]:
    """(start, end, kind, plain) of all spans, by start, then kind, then end."""
    base = find_all(text)
    out = [(a, b, k, True) for a, b, k in base]
    tape = normalise(text) if text else None
    if tape is not None and tape.text != text:
        of = {k: [(a, b) for a, b, kind in base if kind == k] for k in KINDS}
        for a, b, k in find_all(tape.text):
            x, y = tape.first[a], tape.last[b - 1]
            if y - x == b - a and text[x:y] == tape.text[a:b] and k != "email":
                continue  # nothing was disguised here, and plain identifiers are known
            if not any(p <= x and y <= q for p, q in of[k]):
                out.append((x, y, k, False))
        out.sort(key=lambda s: (s[0], KINDS.index(s[2]), s[1]))
    return out


def detect(df: DataFrame, text: str = "text", *, out: str = "pii") -> DataFrame:
    """Append an array of (kind, start, end, plain) for each whole text."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("plain", pa.bool_())]))

    def make():
        def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            rows = [[{"kind": k, "start": a, "end": b, "plain": p} for a, b, k, p in spans(t or "")] for t in texts]
            return {out: pa.array(rows, kind)}

        return run

    return map_batches(df, make, f"`{out}` array<struct<kind:string,start:long,end:long,plain:boolean>>")


def mask(text: str, found: list[tuple[int, int, str, bool]]) -> str:
    """The text with each span replaced by its kind in brackets; overlapping ones become one."""
    out, done, k = [], 0, 0
    while k < len(found):
        a, b, kind, _ = found[k]
        k += 1
        while k < len(found) and found[k][0] < b:
            b = max(b, found[k][1])
            k += 1
        out += [text[done:a], f"[{kind.upper()}]"]
        done = b
    return "".join([*out, text[done:]])


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """Replace all spans in column ``text``; a null text stays null."""

    def make():
        def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            return {text: pa.array([None if t is None else mask(t, spans(t)) for t in texts], pa.string())}

        return run

    return map_batches(df, make, f"`{text}` string").select(*[F.col(f"`{c}`") for c in df.columns])


def listed(found: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
