"""Operator 10, personal data with offset-preserving deobfuscation.

Base kinds are found in the text as it stands (e-mail, IPv4, card, phone; leftmost, not overlapping within a kind). Then a
chain of transducers rewrites the text where it holds disguises: look-alike letters and full-width or other digits become
ASCII, zero-width characters vanish, character references become their signs, spelled digits of a run become figures, and
"(at)", "[dot]", "(a)", "name at host dot com", "name_at_host_dot_com" become signs. Each transducer carries, for every character it emits, the source span that it came from; what the same
patterns find in the rewritten text is mapped back to source characters. Such a span is added if it covers a disguise, unless
a base span of its kind covers it; a base span may be a part of it, and base spans always stay.

Words alone ("at", "dot", one spelled digit) rewrite nothing: at/dot words count only as a whole address
``word at word dot word`` or as four short numbers, spelled digits only in runs of at least seven, or of four behind a plus.
Words for the signs and for digits are read in English, German, Spanish, French, Portuguese and Italian. "name at host.com" is
prose as often as not and counts only right behind a verb of mail ("write to name at host.com").

Defined cases: a null text is empty and has no spans; rows that repeat are searched each; an empty table gives no rows;
extra columns are ignored; no pattern backtracks over more than one run of its characters, so long runs stay linear.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from lodestar.llm.common import map_arrow, only

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# Starting inside a run of digits can't succeed where its start fails: each part takes the whole run.
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
_DIGIT = re.compile(r"[0-9]")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """A match has one @: its local part is the run before it, back to the last match at most."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _HOST.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
            at = text.find("@", m.end())
        else:
            done = at + 1
            at = text.find("@", at + 1)


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def base(text: str) -> list[tuple[str, int, int]]:
    """kind, start, end (code points, end exclusive) by start, then kind as listed."""
    out = [("email", s, e) for s, e in emails(text)]
    if _DIGIT.search(text):
        if "." in text:
            out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(g.lstrip("0")) < 4 and int(g.lstrip("0") or 0) <= 255 for g in m.groups())]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and _luhn(digits):
                    out.append(("card", m.start(), m.end()))
        if "+" in text:
            out += [("phone", s, e) for s, e in phones(text)]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def phones(text: str) -> Iterator[tuple[int, int]]:
    """\\+[0-9][\\x20().0-9-]+[0-9] of 9 to 15 digits."""
    at = text.find("+")
    while at >= 0:
        m = _PHONE_RUN.match(text, at)
        end = at + 1
        if m:
            stop = m.end()
            while not "0" <= text[stop - 1] <= "9":
                stop -= 1
            if stop - at >= 4:  # the sign, a digit, one or more of the run, a digit
                end = stop
                if 9 <= sum("0" <= c <= "9" for c in text[at:stop]) <= 15:
                    yield at, stop
        at = text.find("+", end)


_PHONE_RUN = re.compile(r"\+[0-9][\x20().0-9-]++")

# -- transducers ---------------------------------------------------------------------------------------------------------

#: Look-alikes that no Unicode decomposition gives: Cyrillic and Greek letters drawn as Latin ones.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ѵ": "v", "ԝ": "w",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "У": "Y", "Х": "X",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ı": "i", "ɑ": "a", "ɡ": "g", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "․": ".", "。": ".", "·": ".",
}
ZERO_WIDTH = "​‌‍⁠﻿­"
#: Figures in the words of six languages, nought first.
DIGITS = (
    "zero oh null cero zéro", "one eins uno un um", "two zwei zwo dos deux dois due", "three drei tres trois três tre", "four vier cuatro quatre quatro quattro",
    "five fünf cinco cinq cinque", "six sechs seis sei", "seven sieben siete sept sete sette", "eight acht ocho huit oito otto", "nine neun nueve neuf nove",
)
SPELLED = {word: str(figure) for figure, words in enumerate(DIGITS) for word in words.split()}
#: Words for the two signs that go together; those of the second row are nothing else in prose, so any word for a dot goes with them.
SIGNS = (("at|ät", "dot|punkt"), ("arroba|arobase|arrobase|chiocciola", "dot|punkt|punto|ponto|point"), ("at|ät", "punto|ponto|point"))
AT, DOT = "|".join(at for at, _ in SIGNS), SIGNS[1][1]
#: Words after "at" that are prose, not hosts ("look at the dot com era").
NOT_HOSTS = frozenset("a all an any each her his it its my no our that the their these this those which your".split())
#: Endings that count behind a blank, a point and a blank, where a sentence may end as well.
ENDINGS = frozenset("com org net edu gov io info co biz de fr es uk eu pt it nl us ca br mx".split())
#: Endings that count where an English or German sign meets a Romance point ("at melting point it"), and behind short signs.
GENERIC = frozenset("com org net edu gov info io".split())
#: Words before "at" that are prose, not names.
NOT_NAMES = frozenset(
    "am and are arrive arrived back be been down end ended ends her here him is it live lived lives look looked looking looks me meet met more not online or out "
    "start started starts stay stayed stays them there up us was were work worked works you".split()
)
#: An ending longer than this needs a sign or a figure in the name, or a word of mail close before it.
SHORT, NEAR = 4, 60

_LETTERS = re.compile(r"[^\x00-\x7f¡-ɏ]|[­²³·¹ı]")
_FIGURE = "|".join(sorted(SPELLED, key=len, reverse=True)) + "|[0-9]+"
_SPELLED_RUN = re.compile(rf"(?<![^\W_])(?:(?:{_FIGURE})(?:[\x20,-]{{1,2}}|\x20(?:{DOT})\x20)){{6,}}(?:{_FIGURE})(?![^\W_])", re.I)
_SEP = rf"(?:[\x20,-]{{1,2}}|\x20(?:{DOT})\x20)"
#: In lower case, what every run that _spelled rewrites holds: a word between two others, behind a number, or before five numbers.
_SPELLED_HINT = re.compile(
    rf"(?<=[a-zé0-9]){_SEP}(?:{'|'.join(SPELLED)}){_SEP}(?:{_FIGURE})(?![^\W_])|(?<=[0-9]){_SEP}(?:{'|'.join(SPELLED)})(?![^\W_])"
    r"|(?<=[a-zé])[\x20,-]{1,2}[0-9]+(?:[\x20,-]{1,2}[0-9]+){4}"
)
#: Behind a plus, in figures or as a word, four numbers are enough, since only a whole telephone number counts.
_PLUS_RUN = re.compile(rf"(?:\+\x20?|(?<![^\W_])(?:plus|più|mais)\x20)(?:(?:{_FIGURE})[\x20,-]{{1,2}}){{3,}}(?:{_FIGURE})(?![^\W_])", re.I)
_REFERENCE = re.compile(r"&(?:#0*(\d{2,3})|#x0*([0-9a-f]{2})|(commat|period));", re.I)
#: Addresses whose signs are joined to the words, or one letter in brackets: whole ones with a usual ending only.
_JOINED = re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}?([_-]at[_-])[A-Za-z0-9-]{{1,63}}?((?:[_-]dot[_-][A-Za-z0-9]{{1,63}}){{0,4}}?[_-]dot[_-](?:{'|'.join(sorted(ENDINGS))}))(?![A-Za-z0-9_-])", re.I)
_JOINED_DOT = re.compile(r"[_-]dot[_-]", re.I)
_SHORT = re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}(\x20{{0,2}}[(\[{{]a[)\]}}]\x20{{0,2}})[A-Za-z0-9-]{{1,63}}((?:(?:\.|\x20{{0,2}}[(\[{{](?:d|{DOT})[)\]}}]\x20{{0,2}})[A-Za-z0-9-]{{1,63}}){{0,4}}?(?:\.|\x20{{0,2}}[(\[{{](?:d|{DOT})[)\]}}]\x20{{0,2}})(?:{'|'.join(sorted(GENERIC))}))(?![A-Za-z0-9-])", re.I)
_SHORT_DOT = re.compile(rf"\x20{{0,2}}[(\[{{](?:d|{DOT})[)\]}}]\x20{{0,2}}", re.I)
#: What stands right before the name of an address with a plain host.
_WRITE_TO = re.compile(r"(?<![^\W_])(?:e-?mail|write|contact|reach|ping|message)(?:\x20(?:is|to))?:?\x20$", re.I)
_BRACKET_AT = re.compile(rf"\x20{{0,2}}(?:[(\[{{<](?:{AT})[)\]}}>]|\(@\)|\[@\])\x20{{0,2}}", re.I)
_BRACKET_DOT = re.compile(rf"\x20{{0,2}}(?:[(\[{{<](?:{DOT})[)\]}}>]|\(\.\)|\[\.\])\x20{{0,2}}", re.I)
_MAIL = re.compile(r"mail|contact|kontakt|correo|courriel|correio|schreib|write|reach|escrib|écri|@", re.I)
#: In lower case, what every address with a plain host and a verb of mail holds.
_WRITE_AT = re.compile(r"(?:mail|write|contact|reach|ping|message)(?:\x20(?:is|to))?:?\x20[a-z0-9._%+-]{1,64}\x20at\x20[a-z0-9-]+\.")
_SIGN_DOT = re.compile(rf"\x20(?:{DOT}|\.)\x20", re.I)
_WORD_DOT = re.compile(rf"\x20(?:{DOT})\x20", re.I)
_WORDY_IP = re.compile(rf"(?<![0-9.])[0-9]{{1,3}}(?:(?:\x20(?:{DOT})\x20|\.)[0-9]{{1,3}}){{3}}(?![0-9])", re.I)


def _address(at: str, dot: str) -> re.Pattern:
    """name, sign, host and the rest of the host with its ending, where a name may hold spelled dots too."""
    name, sep = r"[A-Za-z0-9._%+-]{1,64}", rf"(?:\x20(?:{dot})\x20|\.|\x20\.\x20)"
    return re.compile(rf"(?<![A-Za-z0-9._%+-])({name}(?:\x20(?:{dot})\x20{name}){{0,3}})(\x20(?:{at})\x20|\x20@\x20|@)([A-Za-z0-9-]{{1,63}})((?:{sep}[A-Za-z0-9-]{{1,63}}){{0,4}}{sep}([A-Za-z]{{2,24}}))(?![A-Za-z0-9-])", re.I)


_ADDRESSES = tuple(_address(at, dot) for at, dot in SIGNS)


class Tape:
    """A text with, for each of its characters, the source span it stands for, and whether a transducer wrote it."""

    def __init__(self, text: str):
        self.text, self.start, self.end, self.new = text, list(range(len(text))), list(range(1, len(text) + 1)), bytearray(len(text))

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace spans of the present text (in order, disjoint); all characters of a replacement stand for the whole span."""
        if not edits:
            return
        text, start, end, new, at = [], [], [], bytearray(), 0
        for s, e, put in edits:
            text += [self.text[at:s], put]
            start += self.start[at:s] + [self.start[s]] * len(put)
            end += self.end[at:s] + [self.end[e - 1]] * len(put)
            new += self.new[at:s] + b"\x01" * len(put)
            at = e
        self.text, self.start, self.end, self.new = "".join([*text, self.text[at:]]), start + self.start[at:], end + self.end[at:], new + self.new[at:]


def _letters(text: str) -> list[tuple[int, int, str]]:
    out = []
    for m in _LETTERS.finditer(text):
        c = m[0]
        if c in ZERO_WIDTH:
            out.append((m.start(), m.end(), ""))
        elif put := HOMOGLYPHS.get(c):
            out.append((m.start(), m.end(), put))
        else:
            put = unicodedata.normalize("NFKC", c)
            if len(put) == 1 and not put.isascii() and (d := unicodedata.decimal(put, None)) is not None:
                put = str(d)
            if put != c and put.isascii():
                out.append((m.start(), m.end(), put))
    return out


def _spelled(text: str) -> list[tuple[int, int, str]]:
    """Figures for the spelled digits of runs; the separators behind them vanish, a spelled dot among them is a point."""
    out = []
    for run in _SPELLED_RUN.finditer(text):
        parts = [(run.start() + m.start(), run.start() + m.end(), m[0].lower()) for m in re.finditer(r"[^\x20,-]+", run[0])]
        if not any(word in SPELLED for _, _, word in parts):
            continue
        for (s, e, word), (following, _, sign) in zip(parts, [*parts[1:], (parts[-1][1], 0, "")]):
            if word in SPELLED:
                out.append((s, following, SPELLED[word]))
            elif not word.isdigit():
                out.append((s, following, "."))
            elif sign and not sign.isdigit() and sign not in SPELLED:
                out.append((e, following, ""))
    return out


def _wordy(pattern: re.Pattern, text: str) -> list[tuple[int, int, str]]:
    """Signs for the words of whole addresses."""
    out = []
    for m in pattern.finditer(text):
        spoken = bool(_WORD_DOT.search(m[0]))
        if m[2] != "@" and (m[3].lower() in NOT_HOSTS or m[1].lower() in NOT_NAMES):
            continue
        if pattern is _ADDRESSES[2] and m[5].lower() not in GENERIC:
            continue
        told = m[5].lower() in ENDINGS and bool(_WRITE_TO.search(text, max(0, m.start() - NEAR), m.start()))
        if not (spoken or m[2] == " @ " or told) or (not _WORD_DOT.search(m[4]) and " . " in m[4] and m[5].lower() not in ENDINGS):
            continue
        if len(m[5]) > SHORT and not (re.search(r"[._%+0-9-]", m[1]) or _WORD_DOT.search(m[1]) or _MAIL.search(text, max(0, m.start() - NEAR), m.end(2))):
            continue
        out += [(m.start(1) + d.start(), m.start(1) + d.end(), ".") for d in _WORD_DOT.finditer(m[1])]
        out += [(m.start(2), m.end(2), "@")] if m[2] != "@" else []
        out += [(m.start(4) + d.start(), m.start(4) + d.end(), ".") for d in _SIGN_DOT.finditer(m[4])]
    return out


def _references(text: str) -> list[tuple[int, int, str]]:
    """Characters for references to ASCII signs, letters and figures."""
    codes = ((m, {"commat": 64, "period": 46}[m[3].lower()] if m[3] else int(m[1]) if m[1] else int(m[2], 16)) for m in _REFERENCE.finditer(text))
    return [(m.start(), m.end(), chr(c)) for m, c in codes if 32 < c < 127]


def _plus(text: str) -> list[tuple[int, int, str]]:
    """The sign and the figures of numbers behind a plus that hold spelled ones."""
    out = []
    for run in _PLUS_RUN.finditer(text):
        parts = [(run.start() + m.start(), run.start() + m.end(), m[0].lower()) for m in re.finditer(r"[^\x20,+-]+", run[0])]
        parts = parts if run[0][0] == "+" else parts[1:]
        if any(word in SPELLED for _, _, word in parts):
            out.append((run.start(), parts[0][0], "+"))
            for (s, e, word), (following, _, _) in zip(parts, [*parts[1:], (parts[-1][1], 0, "")]):
                out.append((s, following, SPELLED[word])) if word in SPELLED else out.append((e, following, ""))
    return [x for x in out if x[0] < x[1]]


def _short(text: str) -> list[tuple[int, int, str]]:
    """Signs for those of whole addresses that are joined to their words or one letter in brackets."""
    found = [(m, dot) for pattern, dot in ((_JOINED, _JOINED_DOT), (_SHORT, _SHORT_DOT)) for m in pattern.finditer(text)]
    out = [(m.start(1), m.end(1), "@") for m, _ in found]
    return sorted(out + [(m.start(2) + d.start(), m.start(2) + d.end(), ".") for m, dot in found for d in dot.finditer(m[2])])


def _wordy_ips(text: str) -> list[tuple[int, int, str]]:
    return [(m.start() + d.start(), m.start() + d.end(), ".") for m in _WORDY_IP.finditer(text) for d in _WORD_DOT.finditer(m[0])]


def disguised(text: str, known: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans that only the rewritten text shows, in source characters."""
    letters = [] if text.isascii() else _letters(text)
    low = text.lower()
    plus = ("+" in low or "plus " in low or "più " in low or "mais " in low) and bool(_plus(text))
    spelled = plus or bool(_SPELLED_HINT.search(low))
    references = ("&#" in low or "&commat;" in low or "&period;" in low) and bool(_references(text))
    short = any(x in low for x in ("_at_", "-at-", "(a)", "[a]", "{a}")) and bool(_short(text))
    signs = any(x in text for x in "([{<") and bool(_BRACKET_AT.search(text) or _BRACKET_DOT.search(text))
    if not signs:
        # what _wordy and _wordy_ips need to rewrite anything
        signs = " @ " in low or (" at " in low and bool(_WRITE_AT.search(low))) or (any(f" {x} " in low for x in DOT.split("|")) and ("@" in low or any(f" {x} " in low for x in AT.split("|")) or bool(_WORDY_IP.search(low))))
    if not (letters or spelled or signs or references or short):
        return []
    tape = Tape(text)
    tape.rewrite(letters)
    if references:
        tape.rewrite(_references(tape.text))
    if spelled or letters:
        tape.rewrite(_plus(tape.text))
        tape.rewrite(_spelled(tape.text))
    if short or letters:
        tape.rewrite(_short(tape.text))
    if signs or letters or references:
        tape.rewrite([(m.start(), m.end(), "@") for m in _BRACKET_AT.finditer(tape.text)])
        tape.rewrite([(m.start(), m.end(), ".") for m in _BRACKET_DOT.finditer(tape.text)])
        for pattern in _ADDRESSES:
            tape.rewrite(_wordy(pattern, tape.text))
        tape.rewrite(_wordy_ips(tape.text))
    if not any(tape.new) and tape.text == text:
        return []
    out = []
    # spans of one kind don't overlap, so only the last one that starts at a place or before it can cover it
    ends = {kind: [(x, y) for k, x, y in known if k == kind] for kind in KINDS}
    for kind, s, e in base(tape.text):
        if any(tape.new[s:e]) or tape.end[e - 1] - tape.start[s] != e - s:
            a, b = tape.start[s], tape.end[e - 1]
            at = bisect_right(ends[kind], a, key=lambda x: x[0])
            if not at or ends[kind][at - 1][1] < b:
                out.append((kind, a, b))
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def spans_of(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and all spans."""
    found = base(text)
    more = disguised(text, found)
    return found, sorted({*found, *more}, key=lambda x: (x[1], KINDS.index(x[0]), x[2])) if more else found


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def detect(docs: DataFrame) -> DataFrame:
    """A row for each document: counts of base spans, their digest, and all spans."""
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = [pa.int64()] * 5 + [pa.string()] * 2

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in names]
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found, every = spans_of(text or "")
                counts = [sum(k == kind for k, _, _ in found) for kind in KINDS]
                for c, v in zip(cols, [doc, *counts, hashlib.sha256(joined(found).encode()).hexdigest(), joined(every)]):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

    return map_arrow(only(docs, "doc_id", "text"), scan, SCHEMA)


def mask(text: str) -> str:
    """text with each span replaced by its kind in brackets; of overlapping spans, the union under the first one's kind."""
    out, at = [], 0
    merged: list[list] = []
    for kind, s, e in spans_of(text)[1]:
        if merged and s < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], e)
        else:
            merged.append([kind, s, e])
    for kind, s, e in merged:
        out += [text[at:s], f"[{kind}]"]
        at = e
    return "".join([*out, text[at:]])


def masked(docs: DataFrame) -> DataFrame:
    """docs with personal data masked in text and n_chars (if present) counted again; null texts stay null."""
    schema = docs.schema
    names = [f.name for f in schema]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [None if t is None else mask(t) for t in b.column(names.index("text")).to_pylist()]
            cols = list(b.columns)
            cols[names.index("text")] = pa.array(texts, b.schema.field(names.index("text")).type)
            if "n_chars" in names:
                old = b.column(names.index("n_chars"))
                cols[names.index("n_chars")] = pa.array([o if t is None else len(t) for o, t in zip(old.to_pylist(), texts)], old.type)
            yield pa.RecordBatch.from_arrays(cols, names)

    return map_arrow(docs, scan, schema)
