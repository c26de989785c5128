"""Personal data, found also where it is disguised, with spans in the source's code points.

Base spans come from four patterns on the text as it is. Then transducers rewrite the text: look-alike
characters and foreign digits to ASCII, zero-width characters to nothing, runs of spelled digits to digits,
disguised "at" and "dot" to the sign. Each keeps, for every character it writes, the source range it stands
for; the patterns run once more, and a match is mapped back to the source range of its first and last
character. It is added unless it meets a base span of its kind. Base spans always stay.

Null and empty texts have no span; an empty table gives an empty result. Rows are independent, so repeated rows and
ids need no rule; added spans of one kind that meet each other all stay, in order of start, then end. Other columns are ignored. Very long
texts: every pattern takes time linear in the text (none begins with a repetition that may begin inside a run of the
same characters), spans are merged by one sweep, and the source ranges are two arrays of numbers.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: (kind, start, end) in code points; and source ranges as arrays of starts and of ends.
Span = tuple[str, int, int]
Ranges = tuple[np.ndarray, np.ndarray]
KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
#: A match that begins inside a run of digits is never the leftmost one.
IP = r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

DIGIT_WORDS = {
    "zero": 0, "oh": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9,
    "null": 0, "eins": 1, "zwei": 2, "zwo": 2, "drei": 3, "vier": 4, "fünf": 5, "sechs": 6, "sieben": 7, "acht": 8, "neun": 9,
    "zéro": 0, "un": 1, "deux": 2, "trois": 3, "quatre": 4, "cinq": 5, "sept": 7, "huit": 8, "neuf": 9,
    "cero": 0, "uno": 1, "dos": 2, "tres": 3, "cuatro": 4, "cinco": 5, "seis": 6, "siete": 7, "ocho": 8, "nueve": 9,
}
#: So many digits in words, at least, make a number; a count in prose has fewer.
LEAST_WORDS = 4
_WORD = "(?:" + "|".join(sorted(DIGIT_WORDS, key=len, reverse=True)) + ")"
_DOTS = r"(?:dot|punkt|point|punto|period)"
#: Brackets about a sign, with the white space beside them; a match never begins inside a run of white space.
_INNER, _CLOSE = r"[\(\[\{<]\s*+", r"\s*+[\)\]\}>]\s*+"
_OPEN = rf"(?<!\s)\s*+{_INNER}"
SPELLED = rf"(?i)\b(?:plus[\s,-]++)?{_WORD}(?:(?:[\s,_-]++(?:{_DOTS}[\s,_-]++)?|\s*+[.]\s*+)(?:{_WORD}|[0-9]+)(?![^\W_])){{{LEAST_WORDS - 1},}}"
#: The same in folded text, where a search is twice as fast; most texts have none.
SPELLED_FOLDED = SPELLED.removeprefix("(?i)").replace(r"(?:plus[\s,-]++)?", "")
SPELLED_PART = rf"(?i)(plus)[\s,-]++|({_WORD})(?![^\W_])|[\s,_-]++({_DOTS})[\s,_-]++|\s*+([.])\s*+|[\s,_-]++"
#: What a host must end in if its signs are plain words; in prose "at the dot on" is none.
ENDINGS = "com org net edu gov mil int info biz app dev io example invalid local test online shop store site xyz cloud tech blog page world live club space news email agency studio design works media solutions company network digital group today life pro name mobi museum travel jobs coop aero academy center consulting global host link social support systems team tools website wiki zone".split()
_LAST = r"(?!(?:am|an|as|at|be|by|do|go|he|if|in|is|it|me|my|no|of|on|or|so|to|up|us|we)\b)(?:" + "|".join(ENDINGS) + r"|[a-z]{2})\b"
_HOST = r"[A-Za-z0-9-]++"
AT_DOT = (
    rf"(?i)(?P<at>{_OPEN}(?:at|@|arroba|ät){_CLOSE}"
    rf"|(?<=[A-Za-z0-9])\s++(?:at|arroba)\s++(?={_HOST}(?:\s++{_DOTS}\s++{_HOST}){{0,4}}?(?:\s++{_DOTS}\s++{_LAST}|\s*+{_INNER}(?:{_DOTS}|\.){_CLOSE}[A-Za-z0-9]))"
    rf"|(?<=[A-Za-z0-9])\s++@\s*+(?=[A-Za-z0-9])|(?<=[A-Za-z0-9])@\s++(?=[A-Za-z0-9]))"
    rf"|(?P<dot>{_OPEN}(?:{_DOTS}|\.){_CLOSE}|(?<=[A-Za-z0-9])\s++{_DOTS}\s++(?=[A-Za-z0-9]))"
)
AT_DOT_HINT = rf"(?i)[\(\[\{{<]\s*+(?:at|@|arroba|ät|{_DOTS}|\.)\s*+[\)\]\}}>]|\s{_DOTS}\s|\s@|@\s"


def look_alikes() -> dict[int, str | None]:
    """Character -> the ASCII character it passes for; None for those that take no width."""
    table: dict[int, str | None] = {}
    for code in (*range(0xA0, 0x3400), *range(0xFE00, 0x10000), *range(0x1D400, 0x1D800), *range(0x1F100, 0x1F190), *range(0x1FBF0, 0x1FBFA)):
        c = chr(code)
        digit = unicodedata.digit(c, None)
        plain = str(digit) if digit is not None else unicodedata.normalize("NFKC", c)
        if len(plain) == 1 and " " <= plain <= "~":
            table[code] = plain
        elif unicodedata.category(c) == "Pd":
            table[code] = "-"
        elif unicodedata.category(c) == "Cf":
            table[code] = None
    pairs = "аaеeоoрpсcхxуyіiѕsјjԁdһhԛqԝwкkмmтtвbнhАAЕEОOРPСCХXУYІIЅSЈJКKМMТTВBНHοoαaεeιiνvρpτtυuκkΟOΑAΕEΙIΡPΤTΥYΚKΒBΗHΜMΝNΖZΧX。.․.⸱.·.•.＠@﹫@"
    table.update({ord(a): b for a, b in zip(pairs[::2], pairs[1::2])})
    return table


def _luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


class Finder:
    """Compiled patterns; one per worker process."""

    def __init__(self) -> None:
        self.domain, self.ip, self.card, self.phone = map(re.compile, (DOMAIN, IP, CARD, PHONE))
        self.spelled, self.folded, self.part, self.at_dot, self.hint = map(re.compile, (SPELLED, SPELLED_FOLDED, SPELLED_PART, AT_DOT, AT_DOT_HINT))
        table = look_alikes()
        self.odd = frozenset(map(chr, table))
        self.plain = np.arange(0x110000, dtype=np.int32)  # -1: written as nothing
        self.plain[list(table)] = [-1 if c is None else ord(c) for c in table.values()]

    def base(self, t: str) -> list[Span]:
        """Spans of the four patterns, by kind and start."""
        out, seen, at = [], 0, t.find("@")
        while at >= 0:
            start = at
            while start > seen and t[start - 1] in LOCAL:
                start -= 1
            m = self.domain.match(t, at + 1) if start < at else None
            if m:
                out.append(("email", start, seen := m.end()))
            at = t.find("@", max(at + 1, seen))
        out += [("ip", *m.span()) for m in self.ip.finditer(t) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))]
        for kind, pattern, least, most in (("card", self.card, 13, 19), ("phone", self.phone, 9, 15)):
            for m in pattern.finditer(t):
                if len(m[0]) >= least:
                    digits = "".join(c for c in m[0] if c in "0123456789")
                    if least <= len(digits) <= most and (kind == "phone" or _luhn(digits)):
                        out.append((kind, *m.span()))
        return out

    def clear(self, t: str) -> tuple[str, Ranges | None]:
        """The text without disguises, and for each of its characters the source range; None if nothing changed."""
        where = None
        if not t.isascii() and not self.odd.isdisjoint(t):
            plain = self.plain[np.frombuffer(t.encode("utf-32-le"), np.uint32)]
            at = np.flatnonzero(plain >= 0)
            t, where = plain[at].astype("<u4").tobytes().decode("utf-32-le"), (at, at + 1)
        if self.folded.search(t.casefold()) and self.spelled.search(t):
            t, where = self._rewrite(t, where, self.spelled, self._digits)
        if self.hint.search(t):
            t, where = self._rewrite(t, where, self.at_dot, lambda m: [("@" if m["at"] else ".", m.start(), m.end())])
        return t, where

    def _digits(self, m: re.Match) -> list[Span]:
        out, at = [], m.start()
        while at < m.end():
            p = self.part.match(m.string, at, m.end())
            if not p or p.end() == at:
                out.append((m.string[at], at, at + 1))
                at += 1
                continue
            sign = "+" if p[1] else str(DIGIT_WORDS[p[2].lower()]) if p[2] else "." if p[3] or p[4] else ""
            if sign:
                out.append((sign, p.start(), p.end()))
            at = p.end()
        return out

    @staticmethod
    def _rewrite(t: str, where: Ranges | None, pattern: re.Pattern, write) -> tuple[str, Ranges]:
        begin, end = where or (np.arange(len(t)), np.arange(1, len(t) + 1))
        chars, begins, ends, at = [], [], [], 0
        for m in pattern.finditer(t):
            signs = write(m)
            chars += [t[at : m.start()], *(x[0] for x in signs)]
            begins += [begin[at : m.start()], [begin[a] for _, a, _ in signs]]
            ends += [end[at : m.start()], [end[b - 1] for _, _, b in signs]]
            at = m.end()
        chars.append(t[at:])
        return "".join(chars), (np.concatenate([*begins, begin[at:]]).astype(np.int64), np.concatenate([*ends, end[at:]]).astype(np.int64))

    def find(self, t: str) -> tuple[list[Span], list[Span]]:
        """Base spans, and all spans."""
        base = self.base(t)
        plain, where = self.clear(t)
        if where is None:
            return base, base
        taken = {k: [x for x in base if x[0] == k] for k in KINDS}  # by start, none meets another
        new = []
        for kind, a, b in self.base(plain):
            start, end = int(where[0][a]), int(where[1][b - 1])
            before = bisect.bisect_left(taken[kind], end, key=lambda x: x[1]) - 1  # the last that starts before the end
            if before < 0 or taken[kind][before][2] <= start:
                new.append((kind, start, end))
        return base, sorted(base + new, key=lambda x: (KINDS.index(x[0]), x[1], x[2]))


def _text(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base spans by kind, base_sha256, spans (all, ``kind:start:end``), n_added."""

    def kernel(batches):
        finder = Finder()
        for batch in batches:
            rows = [finder.find(t) if t else ([], []) for t in batch.column(1).to_pylist()]
            counts = [pa.array([sum(x[0] == k for x in base) for base, _ in rows], pa.int64()) for k in KINDS]
            digests = [hashlib.sha256(_text(base).encode()).hexdigest() for base, _ in rows]
            every = [_text(spans) for _, spans in rows]
            added = pa.array([len(spans) - len(base) for base, spans in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array(digests), pa.array(every), added], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(kernel, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")
