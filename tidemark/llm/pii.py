"""Personal data, also where it is disguised: transducers rewrite a text, detectors run on the rewritten text, and the
spans found are mapped back to the characters of the source.

Runs per text; nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import whole_text

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]

# Digit words of the four languages, and what stands for "at", "dot" and "plus" in them.
DIGIT_WORDS = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
    "oh": "0",
}
AT_WORDS = ("at", "arroba", "arobase", "ät")
DOT_WORDS = ("dot", "punkt", "punto", "point")
PLUS_WORDS = ("plus", "más")

# Letters and signs of other scripts that look like ASCII ones.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ғ": "f", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "п": "n", "о": "o", "р": "p", "ԛ": "q", "г": "r", "ѕ": "s", "т": "t", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y", "З": "3",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "γ": "y",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ɑ": "a", "ɡ": "g", "ɩ": "i", "ı": "i", "ⅼ": "l", "ℓ": "l", "ο": "o", "օ": "o", "ѡ": "w",
    "\u2010": "-", "\u2011": "-", "\u2012": "-", "\u2013": "-", "\u2014": "-", "\u2212": "-", "\ufe63": "-", "\u2024": ".", "\u3002": ".", "\ufe52": ".", "\ufe62": "+", "\ufe6b": "@",
    "\u00a0": " ", "\u2007": " ", "\u2009": " ", "\u202f": " ",
}


def _one_to_one() -> dict[int, str]:
    """Character to character: look-alikes, full-width forms, digits of other scripts, mathematical letters."""
    table = {ord(k): v for k, v in LOOKALIKES.items()}
    table |= {0xFF01 + i: chr(0x21 + i) for i in range(94)}
    for zero in (0x0660, 0x06F0, 0x0966, 0x09E6, 0x1D7CE, 0x1D7D8, 0x1D7E2, 0x1D7EC, 0x1D7F6):
        table |= {zero + i: chr(0x30 + i) for i in range(10)}
    for first in range(0x1D400, 0x1D6A4, 52):
        table |= {first + i: chr((0x41 if i < 26 else 0x61 - 26) + i) for i in range(52)}
    return table


ONE_TO_ONE = _one_to_one()
#: Signs without width, which only part the characters around them.
HIDDEN = "\u00ad\u200b\u200c\u200d\u200e\u2060\ufeff"
ODD = frozenset(HIDDEN) | {chr(c) for c in ONE_TO_ONE}
# Last labels that need no more evidence.
LAST_LABELS = frozenset(("com", "org", "net", "edu", "gov", "info", "biz", "int", "mil", "io", "co", "me", "eu", "us", "uk", "de", "fr", "es", "it", "nl", "ch", "at", "be", "ca", "au", "mx", "ar", "br", "in", "jp", "cn", "ru"))
# Words of the four languages, none of them a top-level domain, that go on a sentence after "dot".
NO_LABELS = frozenset(
    "the and or of on if an that this these those with when then which what where who was were are has had have will would can could they you she he we "
    "his her our their there but not from into und der das den dem die ein eine ist nicht mit wir ich sie auf le les une des que qui pour dans sur nous "
    "vous il el los las del una por para con".split()
)


def odd(text: str) -> bool:
    """Whether the text has look-alikes or hidden signs."""
    if text.isascii():
        return False
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return not ODD.isdisjoint(text)
    return "\u00ad" in text or "\u00a0" in text


_any = lambda words: "|".join(sorted(map(re.escape, words), key=len, reverse=True))
_digit = rf"(?:{_any(DIGIT_WORDS)})"
_open, _close, _label = r"[\[({<]", r"[\])}>]", r"[A-Za-z0-9-]+"
BRACKETED = re.compile(rf"{_open}\s*(?:(?P<at>{_any(AT_WORDS)}|@)|{_any(DOT_WORDS)}|\.)\s*{_close}", re.I)
_dot = rf"(?:\s+(?:{_any(DOT_WORDS)})\s+|\.)"
#: "name at host dot tld", in plain words; _address() tells how far it goes, and whether it is one.
PLAIN = re.compile(rf"(?<=[A-Za-z0-9._%+-])(?P<at>\s+(?P<word>{_any(AT_WORDS)})\s+|@){_label}(?:{_dot}{_label})+", re.I)
STEP = re.compile(rf"(?P<dot>\s+(?P<word>{_any(DOT_WORDS)})\s+|\.)(?P<label>{_label})", re.I)
#: A dot word between numerals.
NUMERAL_DOT = re.compile(rf"(?<=[0-9])\s+(?:{_any(DOT_WORDS)})\s+(?=[0-9])", re.I)
_item, _between = rf"(?:{_digit}|[0-9]++)", rf"(?:[\s,-]++(?:(?:{_any(DOT_WORDS)})[\s,-]++)?|\.)"
#: Digit words in a row, also among numerals, with "plus" before and "dot" between.
SPELLED = re.compile(rf"(?<!\w)(?:(?:{_any(PLUS_WORDS)})[\s,-]+)?{_item}(?:{_between}{_item})+(?!\w)", re.I)
SPELLED_PART = re.compile(
    rf"(?P<digit>{_digit})|(?P<numeral>[0-9]+)|(?P<dot>[\s,-]*(?:{_any(DOT_WORDS)})[\s,-]*|\.)|(?P<plus>{_any(PLUS_WORDS)})|[\s,-]+", re.I
)
SPELLED_HINT = re.compile(rf"(?<!\w)(?:{_digit}|[0-9]++)(?:[\s,-]++(?:\w+[\s,-]+)?|\.){_digit}(?!\w)|(?<!\w){_digit}\.[0-9]", re.I)
SAID_HINT = re.compile(rf"\s(?:{_any(AT_WORDS)})\s+[A-Za-z0-9-]+\.[A-Za-z]", re.I)
SPOKEN, RUN = frozenset(w.casefold() for w in DIGIT_WORDS), re.compile(r"\w+")
PLAIN_HINT = re.compile(rf"\s(?:{_any(DOT_WORDS)})\s", re.I)
BRACKET_HINT = re.compile(rf"{_open}\s*(?:{_any(AT_WORDS)}|@|{_any(DOT_WORDS)}|\.)\s*{_close}", re.I)

#: A sign "@" with white space on one side at least; the host after it.
SPACED_AT = re.compile(r"(?<=[A-Za-z0-9._%+-])(?:[ \t]++(?P<at>@)[ \t]*+|(?P<tight>@)[ \t]++)(?=[A-Za-z0-9])")
HOST = re.compile(r"[A-Za-z0-9-]+(?:[ \t]*\.[ \t]*([A-Za-z0-9-]+))+")
#: Numerals, each with a digit or alone after a dot, in which letters may stand for digits.
_lettered = r"(?:(?=[OoIl]*[0-9])[0-9OoIl]++|(?<=[0-9OoIl]\.)[OoIl](?![A-Za-z0-9]))"
LETTERED = re.compile(rf"(?<![A-Za-z0-9])\+?{_lettered}(?:[ ().-]{{1,2}}{_lettered})*+(?![A-Za-z0-9])")
LETTERED_HINT = re.compile(r"[0-9][OoIl]|[OoIl][0-9]")
#: Words before an address that is only said ("mail anna at example.com"); else it may be a place ("look at example.com").
CUES = frozenset("mail e-mail email mailto contact write reach address correo courriel mél adresse schreib kontakt escribe contacto contacte écrivez".split())

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can't start within a run of digits: what fails at its first digit fails at the others.
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_no_digits = re.compile("[^0-9]+")


def emails(text: str) -> list[Span]:
    found, done = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            done = m.end()
            found.append((start, done))
        at = text.find("@", max(done, at + 1))
    return found


def ips(text: str) -> list[Span]:
    small = lambda x: len(x := x.lstrip("0")) <= 3 and int(x or 0) <= 255
    return [m.span() for m in IP.finditer(text) if all(map(small, m[0].split(".")))]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) << (i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def cards(text: str) -> list[Span]:
    found = []
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _no_digits.sub("", m[0])) <= 19 and luhn(d):
            found.append(m.span())
    return found


def phones(text: str) -> list[Span]:
    if "+" not in text:
        return []
    return [m.span() for m in PHONE.finditer(text) if 8 <= len(_no_digits.sub("", m[0])) <= 15]


DETECT = (emails, ips, cards, phones)


class Rewritten:
    """A text with some ranges replaced, which knows where each of its characters comes from."""

    def __init__(self, text: str, edits: list[tuple[int, int, str]]):
        """edits: start, end, replacement; in order, without overlap."""
        parts, self.at, self.source, at, n = [], [], [], 0, 0
        for start, end, new in edits:
            for piece, a, b, kept in ((text[at:start], at, start, True), (new, start, end, False)):
                if piece:
                    parts.append(piece)
                    self.at.append(n)
                    self.source.append((a, b, kept))
                    n += len(piece)
            at = end
        if at < len(text):
            parts.append(text[at:])
            self.at.append(n)
            self.source.append((at, len(text), True))
        self.text = "".join(parts)

    def _of(self, i: int) -> Span:
        k = bisect_right(self.at, i) - 1
        a, b, kept = self.source[k]
        return (a + i - self.at[k], a + i - self.at[k] + 1) if kept else (a, b)

    def back(self, span: Span) -> Span:
        return self._of(span[0])[0], self._of(span[1] - 1)[1]


def spelled(text: str) -> bool:
    """Whether digit words may stand in a row; most texts hold none at all, which a set tells faster than the pattern."""
    return not SPOKEN.isdisjoint(RUN.findall(text.casefold())) and bool(SPELLED_HINT.search(text))


def _hidden(text: str) -> list[tuple[int, int, str]]:
    return [(*m.span(), "") for m in re.finditer(f"[{HIDDEN}]+", text)]


def _brackets(text: str) -> list[tuple[int, int, str]]:
    """A bracket with the white space around it; looked for from the bracket on, so in time proportional to the text."""
    out: list[tuple[int, int, str]] = []
    for m in BRACKETED.finditer(text):
        start, end = m.span()
        floor = out[-1][1] if out else 0
        while start > floor and text[start - 1].isspace():
            start -= 1
        while end < len(text) and text[end].isspace():
            end += 1
        out.append((start, end, "@" if m["at"] else "."))
    return out


def _spaced(text: str) -> list[tuple[int, int, str]]:
    """The white space around a sign "@", and what parts single characters beside it ("a n n @ x . d e")."""
    out, floor = [], 0
    for m in SPACED_AT.finditer(text):
        at = m.start("at") if m["at"] else m.start()
        if m.start() < floor:
            continue
        single = text[at + 1].isspace() and m.end() < len(text) and (m.end() + 1 == len(text) or text[m.end() + 1].isspace())
        left, right = m.start(), m.end()
        if not single:
            host = HOST.match(text, right)
            if host and host[1].lower() in LAST_LABELS:
                cuts = [(left, at)] + [(at + 1, right)] + [x.span() for x in re.finditer(r"\s+", text[: host.end()][right:])]
                cuts = cuts[:2] + [(a + right, b + right) for a, b in cuts[2:]]
                out += [(a, b, "") for a, b in cuts if a < b]
                floor = host.end()
            continue
        alone = lambda i: (i == 0 or text[i - 1].isspace()) and (i + 1 == len(text) or text[i + 1].isspace())
        start = left - 1
        while start - 2 >= floor and text[start - 1].isspace() and text[start - 2] in LOCAL and alone(start - 2):
            start -= 2
        end = right
        while end + 2 < len(text) and text[end + 1].isspace() and (text[end + 2].isalnum() or text[end + 2] in ".-") and alone(end + 2):
            end += 2
        if alone(left - 1) and DOMAIN.fullmatch(re.sub(r"\s", "", text[right : end + 1])):
            out += [(i, i + 1, "") for i in range(start, end + 1) if text[i].isspace()]
            floor = end + 1
    return out


def _letters(text: str) -> list[tuple[int, int, str]]:
    """Letters that stand for a digit, within numerals that are long enough together."""
    out = []
    for m in LETTERED.finditer(text):
        if sum(c.isalnum() for c in m[0]) >= 7 and sum(c.isdigit() for c in m[0]) * 2 >= sum(c.isalnum() for c in m[0]):
            out += [(m.start() + i, m.start() + i + 1, "0" if c in "Oo" else "1") for i, c in enumerate(m[0]) if c in "OoIl"]
    return out


def _dots_before(text: str, at: int, floor: int) -> list[tuple[int, int, str]]:
    """Dot words of the local part that ends at `at`: start, end, word, the last first."""
    found = []
    while True:
        while at > floor and text[at - 1] in LOCAL:
            at -= 1
        end = at
        while at > floor and text[at - 1].isspace():
            at -= 1
        stop = at
        while at > floor and text[at - 1].isalpha():
            at -= 1
        word, start = text[at:stop].lower(), at
        while start > floor and text[start - 1].isspace():
            start -= 1
        if end == stop or start == at or start == floor or text[start - 1] not in LOCAL or word not in DOT_WORDS:
            return found
        found.append((start, end, word))
        at = start


def _said(text: str, at: int, floor: int) -> bool:
    """Whether the word that ends at `at` is a local part: it has a sign or digit within, or a cue is near before it."""
    start = at
    while start > floor and text[start - 1] in LOCAL:
        start -= 1
    word = text[start:at].strip(".-")
    return not word.isalpha() and len(word) > 2 or not CUES.isdisjoint(re.findall(r"[\w-]+", text[max(floor, start - 40) : start].lower())[-4:])


def _address(text: str, m: re.Match, floor: int) -> tuple[int, list[tuple[int, int, str]]] | None:
    """The end and the edits of an address in plain words, or None if the match is none.

    It needs a dot word, in the host or the local part. The host goes on as far as its dot word stays the same, and ends
    with letters that no sentence goes on with. As "at this point" is usual, "at" with "point" needs a known last label.
    """
    steps, used = [], None
    for step in STEP.finditer(text, m.end("at"), m.end()):
        word = step["word"] and step["word"].lower()
        if word and used and word != used:
            break
        used = used or word
        steps.append(step)
    before = _dots_before(text, m.start("at"), floor)
    plain_point = used == "point" and m["word"] and m["word"].lower() == "at"
    while steps:
        last = steps[-1]["label"].lower()
        if last in LAST_LABELS or not plain_point and len(last) > 1 and last.isalpha() and last not in NO_LABELS:
            break
        steps.pop()
    # Words alike in host and local part; by itself, only "dot" can't be part of a sentence.
    worded = any(step["word"] for step in steps)
    own = 0
    while own < len(before) and before[own][2] == (used if worded else "dot"):
        own += 1
    if not steps or not (worded or own):
        if not steps or not m["word"] or steps[-1]["label"].lower() not in LAST_LABELS or not _said(text, m.start("at"), floor):
            return None
    edits = [(a, b, ".") for a, b, _ in reversed(before[:own])]
    if m["word"]:
        edits.append((*m.span("at"), "@"))
    return steps[-1].end(), edits + [(*step.span("dot"), ".") for step in steps if step["word"]]


def _plain(text: str) -> list[tuple[int, int, str]]:
    out, floor = [], 0
    m = PLAIN.search(text)
    while m:
        if found := _address(text, m, floor):
            floor, edits = found
            out += edits
        m = PLAIN.search(text, floor if found else m.end("at"))
    return out


def _spelled(text: str) -> list[tuple[int, int, str]]:
    """Digit words as digits, without the space around them; numerals and what is between them stay.

    One word at the edge of numerals may belong to the sentence ("+49 30 1234567 one day"), unless a dot joins it to them.
    """
    out = []
    for run in SPELLED.finditer(text):
        parts = list(SPELLED_PART.finditer(text, *run.span()))
        items = [i for i, m in enumerate(parts) if m["digit"] or m["numeral"]]
        words = [i for i in items if parts[i]["digit"]]
        if not words or sum(len(parts[i]["numeral"] or "1") for i in items) < 4:
            continue
        if len(words) == 1:
            i = words[0]
            joined = any(parts[j]["dot"] for j in (i - 1, i + 1) if 0 <= j < len(parts))
            if i in (items[0], items[-1]) and not joined:
                continue
        for i, m in enumerate(parts):
            if m["digit"]:
                out.append((*m.span(), DIGIT_WORDS[m["digit"].lower()]))
            elif m["dot"]:
                out.append((*m.span(), "."))
            elif m["plus"]:
                out.append((*m.span(), "+"))
            elif not m["numeral"] and any(parts[j]["digit"] or parts[j]["plus"] for j in (i - 1, i + 1)):
                out.append((*m.span(), ""))
    return out


def _numeral_dots(text: str) -> list[tuple[int, int, str]]:
    return [(*m.span(), ".") for m in NUMERAL_DOT.finditer(text)]


def disguised(text: str) -> list[list[Span]]:
    """Spans of the source, per kind, that the detectors find once the disguises are undone."""
    strange = odd(text)
    brackets, plain = BRACKET_HINT.search, PLAIN_HINT.search
    hints = (brackets, plain, spelled, LETTERED_HINT.search, SAID_HINT.search, *([SPACED_AT.search] if "@" in text else []))
    if not (strange or any(hint(text) for hint in hints)):
        return [[] for _ in KINDS]
    now = text.translate(ONE_TO_ONE) if strange else text  # character by character: places stay
    layers = []
    for rewrite in (_hidden, _brackets, _spaced, _plain, _letters, _spelled, _numeral_dots):
        if edits := rewrite(now):
            layers.append(Rewritten(now, edits))
            now = layers[-1].text
    if now == text:
        return [[] for _ in KINDS]
    out = []
    for detect in DETECT:
        spans = []
        for span in detect(now):
            for layer in reversed(layers):
                span = layer.back(span)
            spans.append(span)
        out.append(spans)
    return out


def find(text: str) -> tuple[list[list[Span]], list[list[Span]]]:
    """Base spans and added ones, per kind. A span within a base one of its kind isn't added."""
    base = [detect(text) for detect in DETECT]
    added = [
        [x for x in spans if not any(a <= x[0] and x[1] <= b for a, b in own)] if spans else []
        for own, spans in zip(base, disguised(text), strict=True)
    ]
    return base, added


def _listed(spans: list[list[Span]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, own in zip(KINDS, spans, strict=True) for a, b in sorted(own))


def redact(text: str, spans: list[list[Span]]) -> str:
    """Every maximal run of covered characters becomes the tag of the kind that starts it."""
    runs: list[list] = []
    for a, b, kind in sorted((a, b, kind) for kind, own in zip(KINDS, spans, strict=True) for a, b in own):
        if runs and a < runs[-1][1]:
            runs[-1][1] = max(b, runs[-1][1])
        else:
            runs.append([a, b, kind])
    out, at = [], 0
    for a, b, kind in runs:
        out += [text[at:a], f"<{kind.upper()}>"]
        at = b
    return "".join([*out, text[at:]])


@F.pandas_udf(StringType())
def redacted(texts: pd.Series) -> pd.Series:
    """The text with every span, base or added, replaced by its kind's tag; null stays null."""
    out = []
    for t in texts:
        out.append(None if t is None else redact(t, [x + y for x, y in zip(*find(t), strict=True)]))
    return pd.Series(out, dtype=object)


def find_personal_data(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True
) -> DataFrame:
    """One row per row of docs: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, redacted.

    The counts and base_sha256 are those of the base patterns; spans lists these and the n_added ones found through
    disguises (look-alike characters, hidden signs, spelled digits, "at" and "dot"), as kind:start:end in code points.
    redacted: the text with every span replaced by its kind's tag; null unless with_text.

    Null text: empty, no spans; its redacted text is null. Repeated rows each give a row; a null doc_id is kept; other
    columns are ignored; an empty table gives no rows. Every detector takes time in proportion to the text.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for doc, text, none in zip(b["doc_id"], b["text"], b["none"], strict=True):
                base, added = find(text)
                spans = [x + y for x, y in zip(base, added, strict=True)]
                sha = hashlib.sha256(_listed(base).encode()).hexdigest()
                clean = redact(text, spans) if with_text and not none else None
                out.append((doc, *map(len, base), sha, _listed(spans), sum(map(len, added)), clean))
            names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added", "redacted"]
            yield pd.DataFrame(out, columns=names).astype({"doc_id": "Int64"})

    rows = docs.select(
        docs[id_col].cast("long").alias("doc_id"), whole_text(docs, text_col).alias("text"), docs[text_col].isNull().alias("none")
    )
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return rows.mapInPandas(
        run, f"doc_id long, {counts}, base_sha256 string, spans string, n_added long, redacted string"
    )
