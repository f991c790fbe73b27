"""Personal data with offset-preserving deobfuscation.

Identifiers are first found in the text as it stands. Where a text holds disguises, a transducer rewrites it: look-alike and full-width
characters become ASCII, invisible characters go, spelled digits become digits, and bracketed or spelled-out at and dot signs
become `@` and `.`. Every rewritten piece keeps the characters it came from, so that identifiers found in the rewritten text are
reported as spans of the source.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from analystry.llm.memory import frugal
from analystry.session import spread

KINDS = ("email", "ip", "card", "phone")

DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# The look-behind changes no match (a run of digits is taken whole) and keeps long runs of digits linear.
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

#: Look-alikes of ASCII letters and digits in other scripts; fixed values.
LOOK_ALIKES = str.maketrans(
    "АВЕКМНОРСТХаеорсухіјѕԁɡΑΒΕΖΗΙΚΜΝΟΡΤΥΧοѵ٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹",
    "ABEKMHOPCTXaeopcyxijsdgABEZHIKMNOPTYXov01234567890123456789")
#: Full-width forms lie at a constant distance from ASCII.
LOOK_ALIKES |= {0xFEE0 + c: chr(c) for c in range(0x21, 0x7F)}
INVISIBLE = "­​‌‍⁠﻿"
LOOK_ALIKES |= {ord(c): "" for c in INVISIBLE}


def _compatible() -> dict[int, str]:
    """What the standard folds to ASCII letters, digits or one of `@.+-_%`, and the decimal digits of all scripts."""
    found = {}
    for code in range(0x80, 0x20000):
        char = chr(code)
        digit = unicodedata.decimal(char, None)
        folded = str(digit) if digit is not None else unicodedata.normalize("NFKC", char)
        if folded.isascii() and (folded.isalnum() or len(folded) == 1 and folded in "@.+-_%"):
            found[code] = folded
    return found


LOOK_ALIKES = _compatible() | LOOK_ALIKES

DIGIT_WORDS = {"zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
_DIGIT = "zero|one|two|three|four|five|six|seven|eight|nine"
_LABEL = "[A-Za-z0-9-]{1,63}"
#: Endings that a spelled dot may stand before in any text; whole addresses take all endings.
_ENDINGS = "com|org|net|edu|gov|io|info|biz|co|uk|eu|us|de|fr|es|it|ch|at|example"
# Plain ASCII is turned away first, and the basic plane is a set of its own, which the engine looks up by table.
_PLANES = ["[" + "".join(re.escape(chr(c)) for c in LOOK_ALIKES if (c > 0xFFFF) == high) + "]" for high in (False, True)]
_STRANGE = rf"(?=[^\x00-\x7f])(?:{_PLANES[0]}|(?=[^\x00-\uffff]){_PLANES[1]})"

#: Pieces that are rewritten; at most three blanks around a sign, so that long runs of blanks stay linear.
DISGUISE = re.compile(
    rf"(?P<strange>(?-i:{_STRANGE}))"
    rf"|(?P<at>(?<![ \t])[ \t]{{0,3}}[\[({{<][ \t]{{0,2}}(?:at|@)[ \t]{{0,2}}[\])}}>][ \t]{{0,3}}|(?<=[A-Za-z0-9]) at (?={_LABEL}(?: dot {_LABEL}){{0,4}} dot (?:{_ENDINGS})\b))"
    rf"|(?P<dot>(?<![ \t])[ \t]{{0,3}}[\[({{<][ \t]{{0,2}}(?:dot|\.)[ \t]{{0,2}}[\])}}>][ \t]{{0,3}}|(?<=[A-Za-z0-9]) dot (?=(?:{_LABEL} dot ){{0,4}}(?:{_ENDINGS})\b|(?:{_DIGIT})\b|[0-9]))"
    rf"|(?P<plus>\bplus (?=(?:{_DIGIT}|[0-9])))"
    rf"|(?P<digit>\b(?:{_DIGIT})\b(?:[ -](?=(?:{_DIGIT})\b))?)",
    re.IGNORECASE)


#: Whole addresses: the signs between labels, plain or in disguise. An `at` counts if a label, a dot and a label follow; a plain `@` if
#: that dot is spelled, all else being found as it stands.
_PART = rf"(?-i:(?:[A-Za-z0-9-]|{_STRANGE}){{1,63}})"
_SPELLED = r"[ \t]{0,3}[\[({{<][ \t]{0,2}(?:dot|\.)[ \t]{0,2}[\])}}>][ \t]{0,3}|[ \t]{1,3}dot[ \t]{1,3}"
AT = re.compile(
    rf"(?P<firm>[ \t]{{0,3}}[\[({{<][ \t]{{0,2}}(?:at|@)[ \t]{{0,2}}[\])}}>][ \t]{{0,3}})(?={_PART}(?:{_SPELLED}|\.){_PART})"
    rf"|(?P<plain>@)(?={_PART}(?:{_SPELLED}){_PART})|(?P<word> at )(?={_PART}(?:{_SPELLED}|\.){_PART})", re.IGNORECASE)
NEXT = re.compile(rf"(?P<dot>{_SPELLED}|\.)(?P<label>{_PART})", re.IGNORECASE)
LABEL = re.compile(_PART, re.IGNORECASE)
BEFORE = re.compile(rf"(?:{_SPELLED})\Z", re.IGNORECASE)
#: The longest spelled dot.
_LONGEST = 15
#: After `at` in a sentence these are no host, unless a known ending follows: "look at the dot on it".
_NO_HOST = frozenset("a an any each every her his its my no our some that the their these this those what which your".split()) | frozenset(DIGIT_WORDS)
_KNOWN = frozenset(_ENDINGS.split("|"))


def _local(c: str) -> bool:
    return c in LOCAL or ord(c) in LOOK_ALIKES


def address_signs(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, sign) of the at and dot signs of whole addresses told in words; any ending of two letters or more."""
    free = 0
    for at in AT.finditer(text):
        if at.start() <= free:
            continue
        label = LABEL.match(text, at.end())
        dots, end, names, whole = [], label.end(), [label[0].translate(LOOK_ALIKES).lower()], 0
        while step := NEXT.match(text, end):
            dots.append(step)
            names.append(step["label"].translate(LOOK_ALIKES).lower())
            end = step.end()
            if len(names[-1]) > 1 and names[-1].isalpha() and names[-1] not in DIGIT_WORDS:
                whole = len(dots)
        if not whole or at.lastgroup != "firm" and whole == 1 and names[0] in _NO_HOST and names[whole] not in _KNOWN:
            continue
        dots = dots[:whole]
        signs, start = [], at.start()
        while True:
            place = start
            while place > free and _local(text[place - 1]):
                place -= 1
            if place == start:
                break
            dot = BEFORE.search(text, max(free, place - _LONGEST), place)
            if dot is None or dot.start() == free or not _local(text[dot.start() - 1]):
                break
            signs.append((dot.start(), dot.end(), "."))
            start = dot.start()
        if not signs and place == start:
            continue
        yield from reversed(signs)
        if at.lastgroup != "plain":
            yield at.start(), at.end(), "@"
        yield from ((d.start("dot"), d.end("dot"), ".") for d in dots if d["dot"] != ".")
        free = dots[-1].end()


def disguises(text: str) -> list[tuple[int, int, str, int]]:
    """(start, end, what it stands for, end without blanks behind) of all pieces to rewrite, in order, none overlapping."""
    found = []
    for match in DISGUISE.finditer(text):
        kind, piece, end = match.lastgroup, match[0], match.end()
        if kind == "strange":
            new = piece.translate(LOOK_ALIKES)
        elif kind == "digit":
            new, end = DIGIT_WORDS[piece.rstrip(" -").lower()], match.start() + len(piece.rstrip(" -"))
        else:
            new = {"at": "@", "dot": ".", "plus": "+"}[kind]
        found.append((match.start(), match.end(), new, end))
    signs = [(a, b, new, b) for a, b, new in address_signs(text)]
    if not signs:
        return found
    # A spelled digit takes the blank behind it, which may begin a sign: the sign goes first.
    taken, kept, k = sorted(signs), [], 0
    for piece in found:
        while k < len(taken) and taken[k][1] <= piece[0]:
            k += 1
        if k == len(taken) or piece[1] <= taken[k][0]:
            kept.append(piece)
        elif piece[3] <= taken[k][0]:
            kept.append((piece[0], piece[3], piece[2], piece[3]))
    return sorted(kept + taken)


def luhn(digits: str) -> bool:
    total = 0
    for place, c in enumerate(reversed(digits)):
        value = ord(c) - 48
        if place % 2:
            value = value * 2 - 9 * (value > 4)
        total += value
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches; a match is the run of local characters before an `@` that a domain follows."""
    free = 0
    for match in DOMAIN.finditer(text):
        start = match.start()
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        if start < match.start():
            yield start, match.end()
            free = match.end()


def find_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) of all identifiers, by start and then kind; ends exclusive, in code points."""
    found: list[tuple[int, int, int]] = []
    if "@" in text:
        found += [(a, 0, b) for a, b in emails(text)]
    for match in IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or "0") <= 255 for part in match[0].split(".")):
            found.append((match.start(), 1, match.end()))
    for match in CARD.finditer(text):
        if match.end() - match.start() >= 12:
            digits = match[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((match.start(), 2, match.end()))
    if "+" in text:
        for match in PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in match[0]) <= 15:
                found.append((match.start(), 3, match.end()))
    return sorted(found)


class Rewritten:
    """A text with its disguises undone, and the way back to the source's code points."""

    def __init__(self, text: str, found: list[tuple[int, int, str, int]]):
        pieces, self.at, self.source = [], [], []  # per rewritten piece: where it stands, (source start, source end, length)
        done = made = 0
        for start, resume, new, end in found:
            pieces += [text[done:start], new]
            made += start - done
            self.at.append(made)
            self.source.append((start, end, resume, len(new)))
            made += len(new)
            done = resume
        pieces.append(text[done:])
        self.text = "".join(pieces)

    def span(self, start: int, end: int) -> tuple[int, int] | None:
        """The source span of characters [start, end) of the rewritten text; None if nothing in it was rewritten."""
        first, last = bisect_right(self.at, start) - 1, bisect_right(self.at, end - 1) - 1
        while last >= 0 and self.source[last][3] == 0 and self.at[last] == end - 1 and last > first:
            last -= 1
        changed = any(self.at[k] >= start for k in range(max(first, 0), last + 1))
        return (self._place(start, False), self._place(end - 1, True)) if changed else None

    def _place(self, at: int, ending: bool) -> int:
        k = bisect_right(self.at, at) - 1
        if k < 0:
            return at + ending
        start, end, resume, length = self.source[k]
        inside = at - self.at[k]
        if inside < length:
            return end if ending else start
        return resume + inside - length + ending


def all_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(spans of the text as it stands, those and the spans that undoing disguises adds)."""
    base = find_spans(text)
    found = disguises(text)
    if not found:
        return base, base
    rewritten, every = Rewritten(text, found), set(base)
    for start, kind, end in find_spans(rewritten.text):
        span = rewritten.span(start, end)
        if span and not any(k == kind and a <= span[0] and span[1] <= b for a, k, b in base):
            every.add((span[0], kind, span[1]))
    return base, sorted(every)


def spans_text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find_personal_data(docs: DataFrame) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added.

    The counts and base_sha256 are those of the text as it stands; spans has these and the added ones. Null texts count as empty:
    no spans. Texts of any length are read whole, in linear time; rows that repeat are judged each; other columns are not read.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, spans, added = [[] for _ in KINDS], [], [], []
            for text in batch.column(1).to_pylist():
                base, every = all_spans(text)
                for kind, column in enumerate(counts):
                    column.append(sum(k == kind for _, k, _ in base))
                digests.append(hashlib.sha256(spans_text(base).encode()).hexdigest())
                spans.append(spans_text(every))
                added.append(len(every) - len(base))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(digests, pa.string()), pa.array(spans, pa.string()), pa.array(added, pa.int64())],
                ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_added"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = spread(docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")))
    return rows.mapInArrow(find, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def mask(text: str) -> str:
    """The text with every span replaced by its kind in angle brackets; overlapping spans become one, named by the first."""
    out, done = [], 0
    for start, kind, end in all_spans(text)[1]:
        if start >= done:
            out += [text[done:start], f"<{KINDS[kind].upper()}>"]
        done = max(done, end)
    return "".join([*out, text[done:]]) if out else text


def masked(docs: DataFrame) -> DataFrame:
    """`docs` with all its columns; personal data in `text` is masked and n_chars, if there, counts the new text. Null texts stay."""

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.schema.get_field_index("text")
            texts = pa.array([None if t is None else mask(t) for t in batch.column(place).to_pylist()], pa.string())
            yield batch.set_column(place, batch.schema.field(place).with_type(pa.string()), texts)

    out = docs.mapInArrow(frugal(rewrite), docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out
