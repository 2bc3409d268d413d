"""Personal data, plain and disguised: normalising transducers that keep source offsets, detectors, redaction."""

from __future__ import annotations

import bisect
import re
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

KINDS = ("email", "ip", "card", "phone")

# Possessive and guarded forms of the plain patterns; they find the same matches, in linear time.
_LOCAL = "A-Za-z0-9._%+-"
_EMAIL = re.compile(rf"[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_EMAIL_AT_START = re.compile(rf"(?<![{_LOCAL}])" + _EMAIL.pattern)
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")

Span = tuple[int, int, int]  # start, place of the kind in KINDS, end


def _emails(text: str) -> Iterator[re.Match]:
    """Leftmost matches. A run of local characters is looked at once, and again only where a match ended within it."""
    at = 0
    while (found := _EMAIL_AT_START.search(text, at)) is not None:
        while found is not None:
            yield found
            at = found.end()
            found = _EMAIL.match(text, at)


def _luhn(digits: str) -> bool:
    values = [int(d) for d in reversed(digits)]
    return sum(values[::2] + [d * 2 - 9 * (d > 4) for d in values[1::2]]) % 10 == 0


def plain_spans(text: str) -> list[Span]:
    """Spans of the plain patterns, by start, then kind."""
    out: list[Span] = []
    if "@" in text:
        out += [(m.start(), 0, m.end()) for m in _emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and _luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_DIGIT.findall(m[0])) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


# Letters of other scripts that look like Latin ones, what stands for them,
# characters without width, blanks and dashes.
LOOK_ALIKES = dict(
    zip(
        "авеіјкмнорсѕтухАВЕІЈКМНОРСЅТУХαεικνορτυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ",
        "abeijkmhopcstyxABEIJKMHOPCSTYXaeiknoptuxABEZHIKMNOPTYX",
        strict=True,
    )
)
NO_WIDTH = "­​‌‍⁠﻿"
BLANKS = "              　"
DASHES = "‐‑‒–—−"
DOTS = "․。｡"

# Digits as words of the four languages, and words for signs.
DIGIT_WORDS = {
    **dict(zip("zero one two three four five six seven eight nine".split(), "0123456789", strict=True)),
    **dict(zip("null eins zwei drei vier fünf sechs sieben acht neun".split(), "0123456789", strict=True)),
    **dict(zip("zéro un deux trois quatre cinq six sept huit neuf".split(), "0123456789", strict=True)),
    **dict(zip("cero uno dos tres cuatro cinco seis siete ocho nueve".split(), "0123456789", strict=True)),
    "oh": "0",
}
SIGN_WORDS = {"plus": "+", "dot": ".", "point": ".", "punkt": ".", "punto": "."}
AT_WORDS = ("at", "arroba", "arobase")
DOT_WORDS = ("dot", "point", "punkt", "punto")
#: "look at the dot" names no host.
ARTICLES = ("the", "a", "an", "this", "that")
#: "available at example.com" is no address: words that come before a place.
BEFORE_PLACE = frozenset(
    "look looks looked looking see visit online available found find read more info information details us me you him her them it here "
    "shop shops shopped shopping buy bought order ordered sold work works worked working live lives meet stay site website page and or".split()
)
#: Ends of a host after a spoken at and a written dot, besides those of two letters.
HOST_ENDS = frozenset("com org net edu gov mil int info biz name pro app dev cloud online site shop blog tech".split())
#: Words and digits in a row that are read as one number.
LEAST_SPELLED = 7

_CHANGED = re.compile(f"[{''.join(LOOK_ALIKES)}{NO_WIDTH}{BLANKS}{DASHES}{DOTS}！-～\U0001d400-\U0001d7cb]|(?![0-9])\\d")
_AT, _DOT = "|".join(AT_WORDS), "|".join(DOT_WORDS)
_SIGN = rf"[\[({{<][\x20\t]*(?:({_AT}|@)|({_DOT}|\.))[\x20\t]*[\])}}>]"
_BRACKETED = re.compile(rf"(?ia)(?:(?<![\x20\t])[\x20\t]++)?{_SIGN}[\x20\t]*")
_HOST = r"[A-Za-z0-9-]++"
_SPOKEN = re.compile(
    rf"(?ia)(?<![{_LOCAL}])([{_LOCAL}]++)(\x20++(?:{_AT})\x20++|@)({_HOST})((?:\x20++(?:{_DOT})\x20++{_HOST}|\.{_HOST})++)"
)
_SPOKEN_SIGN = re.compile(rf"(?ia)\x20+(?:({_AT})|({_DOT}))\x20+")
_SPOKEN_DOT = re.compile(rf"(?ia)\x20(?:{_DOT})\x20")
_NUMBER_WORD = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
_SIGN_WORD = "|".join(SIGN_WORDS)
_SPELLED = re.compile(rf"(?<!\w)(?:(?:{_NUMBER_WORD}|{_SIGN_WORD}|\+?[0-9]+)(?!\w)[\x20.-]*)+")
_TOKEN = re.compile(r"[^\W\d_]+|\+?[0-9]+|[.-]")

# Gates: what a transducer cannot do without, so that texts without it are passed over. All but the first read lower-cased text.
_HAS_SIGN = re.compile(f"(?ia){_SIGN}")
_AFTER_AT = re.compile(rf"(?:\x20(?:{_AT})\x20++|@)[a-z0-9-]++(?:\x20++(?:{_DOT})\x20|\.[a-z0-9-])")
_WORDS = re.compile(r"\w+")
_SPELLING = frozenset([*DIGIT_WORDS, *DOT_WORDS])
# A word for a digit with another token of a number beside it, or a word for a dot with digits or their words on both sides.
_BESIDE = re.compile(
    rf"(?<!\w)(?:(?:{_NUMBER_WORD})(?!\w)[\x20.-]*(?:[+0-9]|{_NUMBER_WORD}|{_SIGN_WORD})"
    rf"|[0-9]+(?!\w)[\x20.-]*(?:(?:{_NUMBER_WORD})(?!\w)|(?:{_DOT})\x20*(?:[0-9]|{_NUMBER_WORD})))"
)

Mapped = tuple[str, list[int], list[int]]  # text, and for each character the source's start and end


def _same(text: str) -> Mapped:
    return text, list(range(len(text))), list(range(1, len(text) + 1))


def _rewrite(mapped: Mapped, edits: Iterator[tuple[int, int, str]]) -> Mapped:
    """Replace (start, end, text); each new character stands for all that it replaces."""
    text, starts, ends = mapped
    out, out_starts, out_ends, at = [], [], [], 0
    for start, end, new in edits:
        out += [text[at:start], new]
        out_starts += starts[at:start]
        out_ends += ends[at:start]
        if end > start:
            out_starts += [starts[start]] * len(new)
            out_ends += [ends[end - 1]] * len(new)
        at = end
    return "".join([*out, text[at:]]), out_starts + starts[at:], out_ends + ends[at:]


def _fold(text: str) -> Iterator[tuple[int, int, str]]:
    """Look-alike letters, full-width and mathematical forms, digits of other scripts, blanks and characters without width."""
    for m in _CHANGED.finditer(text):
        c = m[0]
        if c in LOOK_ALIKES:
            new = LOOK_ALIKES[c]
        elif "！" <= c <= "～":
            new = chr(ord(c) - 0xFEE0)
        elif "\U0001d400" <= c <= "\U0001d7cb":  # letters of mathematics
            new = unicodedata.normalize("NFKC", c)
        elif c in NO_WIDTH:
            new = ""
        else:
            new = " " if c in BLANKS else "-" if c in DASHES else "." if c in DOTS else str(unicodedata.decimal(c))
        yield m.start(), m.end(), new


def _signs(text: str) -> Iterator[tuple[int, int, str]]:
    """[at], (dot) and the like."""
    for m in _BRACKETED.finditer(text):
        yield m.start(), m.end(), "@" if m[1] else "."


def _written_host(name: str, sign: str, host: str) -> bool:
    """Whether name, at as a word and a host with written dots are an address.

    The host ends in two letters or one of ``HOST_ENDS``, in lower case or all of it
    in upper case ("at work.It" is a sentence's end), and the word before is none of
    ``BEFORE_PLACE``.
    """
    end = host.rpartition(".")[2]
    known = len(end) == 2 or end.lower() in HOST_ENDS
    return sign != "@" and known and (end.islower() or host.isupper()) and name.lower() not in BEFORE_PLACE


def _spoken(text: str) -> Iterator[tuple[int, int, str]]:
    """name at host dot tld; name at host.tld under the rule of ``_written_host``."""
    for m in _SPOKEN.finditer(text):
        if m[3].lower() in ARTICLES or not m[4].rpartition(" ")[2].rpartition(".")[2].isalpha():
            continue
        if not _SPOKEN_DOT.search(m[4]) and not _written_host(m[1], m[2], m[3] + m[4]):
            continue
        for sign in _SPOKEN_SIGN.finditer(text, m.start(2), m.end()):
            yield sign.start(), sign.end(), "@" if sign[1] else "."


DOT_SIGNS = (*DOT_WORDS, ".")

Token = tuple[int, int, str]  # start, end, lower-cased text


def _one_number(tokens: list[Token], edge: int) -> list[Token]:
    """Of the digits beside an address's first (-1) or last (0) dot, those that belong to it: a number, or digits one by one."""
    if len(tokens[edge][2]) > 1 and tokens[edge][2].isdigit():
        return [tokens[edge]]
    alone = [at for at, t in enumerate(tokens) if len(t[2]) > 1 and t[2].isdigit()]
    return tokens[alone[-1] + 1 :] if edge and alone else tokens[: alone[0]] if alone else tokens


def _dotted(tokens: list[Token]) -> Iterator[list[Token]]:
    """Four groups of digits with exactly three dots between that the detector takes, at least one of the tokens a word.

    A dot before a blank ends a sentence and is none; what follows a plus is a phone.
    """
    groups: list[list[Token]] = [[]]
    dots: list[Token] = []
    plus = False
    for at, token in enumerate([*tokens, (-1, -1, "")]):
        start, end, text = token
        if text.isdigit() or text in DIGIT_WORDS:
            groups[-1].append(token)
        elif groups[-1] and (text in DOT_WORDS or (text == "." and at + 1 < len(tokens) and tokens[at + 1][0] == end)):
            groups.append([])
            dots.append(token)
        else:
            groups = groups if groups[-1] else groups[:-1]
            if len(groups) == 4 and not plus:
                groups = [_one_number(groups[0], -1), groups[1], groups[2], _one_number(groups[3], 0)]
                found = sorted([t for group in groups for t in group] + dots[:3])
                clear = "".join(DIGIT_WORDS.get(t[2]) or SIGN_WORDS.get(t[2]) or t[2] for t in found)
                if any(t[2].isalpha() for t in found) and plain_spans(clear) == [(0, 1, len(clear))]:
                    yield found
            groups, dots = [[]], []
            plus = text[:1] == "+" or text == "plus" or (plus and text in DOT_SIGNS)


def _spelled(text: str) -> Iterator[tuple[int, int, str]]:
    """Digits as words: a run of enough of them, or of four groups with dots between, becomes digits and signs without blanks."""
    lowered = _lower(text)
    for m in _SPELLED.finditer(lowered):
        tokens = [(t.start(), t.end(), t[0]) for t in _TOKEN.finditer(lowered, m.start(), m.end())]
        done = 0
        for found in _dotted(tokens):
            at = bisect.bisect_left(tokens, found[0])
            yield from _long_number(tokens[done:at])
            yield from _as_digits(found, whole=True)
            done = at + len(found)
        yield from _long_number(tokens[done:])


def _long_number(tokens: list[Token]) -> Iterator[tuple[int, int, str]]:
    """Three words for digits at least, among ``LEAST_SPELLED`` words and digits."""
    while tokens and (tokens[-1][2] in ".-" or tokens[-1][2] in SIGN_WORDS):
        tokens.pop()
    spelled = [t for t in tokens if t[2] in DIGIT_WORDS]
    if len(spelled) >= 3 and sum(t[2] not in ".-" and t[2] not in SIGN_WORDS for t in tokens) >= LEAST_SPELLED:
        yield from _as_digits(tokens)


def _as_digits(tokens: list[Token], whole: bool = False) -> Iterator[tuple[int, int, str]]:
    """Words become digits and signs; blanks go beside words, or all of them."""
    for at, (start, end, token) in enumerate(tokens):
        new = DIGIT_WORDS.get(token) or SIGN_WORDS.get(token) or token
        after = tokens[at + 1][0] if at + 1 < len(tokens) else end
        joined = at + 1 < len(tokens) and (whole or new != token or tokens[at + 1][2] in DIGIT_WORDS or tokens[at + 1][2] in SIGN_WORDS)
        if new != token:
            yield start, end, new
        if joined and after > end:
            yield end, after, ""


def _lower(text: str) -> str:
    """``text`` in lower case, character by character, so that places stay."""
    lowered = text.lower()
    return lowered if len(lowered) == len(text) else "".join([c.lower() if len(c.lower()) == 1 else c for c in text])


def _may_fold(text: str) -> bool:
    return not text.isascii() and _CHANGED.search(text) is not None


def _may_have_signs(text: str) -> bool:
    return _HAS_SIGN.search(text) is not None


def _may_be_spoken(text: str) -> bool:
    """A host after an at that reads on after a dot; without a word for at or dot there is nothing to rewrite."""
    lowered = text.lower()
    signs = [f" {word} " for word in AT_WORDS + DOT_WORDS]
    return any(sign in lowered for sign in signs) and _AFTER_AT.search(lowered) is not None


def _may_be_spelled(text: str) -> bool:
    """Both kinds of spelled numbers hold a word for a digit with a token beside it or a word for a dot between digits."""
    lowered = _lower(text)
    return not _SPELLING.isdisjoint(_WORDS.findall(lowered)) and _BESIDE.search(lowered) is not None


#: Each transducer with its gate, which looks at what the transducers before it made.
STEPS: tuple[tuple[Callable[[str], bool], Callable[[str], Iterator[tuple[int, int, str]]]], ...] = (
    (_may_fold, _fold),
    (_may_have_signs, _signs),
    (_may_be_spoken, _spoken),
    (_may_be_spelled, _spelled),
)


def normalised(text: str) -> Mapped | None:
    """``text`` without its disguises and where each character came from; None if there are none."""
    mapped: Mapped | None = None
    for may, step in STEPS:
        seen = mapped[0] if mapped else text
        if may(seen):
            mapped = _rewrite(mapped or _same(text), step(seen))
    return mapped


def spans(text: str | None) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, disguised) in code points of the source, by start, then kind.

    Plain spans are those of the patterns on the text as it is. A span found in the
    normalised text counts as disguised if the source reads differently there and
    it holds any plain span of its kind that it meets, and more.
    """
    if not text:
        return []
    plain = plain_spans(text)
    found = [(start, kind, end, False) for start, kind, end in plain]
    mapped = normalised(text)
    if mapped is not None:
        clear, starts, ends = mapped
        for start, kind, end in plain_spans(clear):
            a, b = starts[start], ends[end - 1]
            met = [(s, e) for s, k, e in plain if k == kind and s < b and a < e]
            if text[a:b] != clear[start:end] and all(a <= s and e <= b and (s, e) != (a, b) for s, e in met):
                found.append((a, kind, b, True))
    return [(KINDS[kind], start, end, disguised) for start, kind, end, disguised in sorted(found)]


SPAN_TYPE = T.ArrayType(
    T.StructType(
        [
            T.StructField("kind", T.StringType()),
            T.StructField("start", T.LongType()),
            T.StructField("end", T.LongType()),
            T.StructField("disguised", T.BooleanType()),
        ]
    )
)
_ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("disguised", pa.bool_())]))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and ``spans`` of every row, found in whole texts.

    A row needs no other row: nothing is shuffled, whatever is hot. Null and empty
    texts have no spans; repeated rows are answered each; other columns are ignored.
    """
    schema = T.StructType([docs.schema[id_col], T.StructField("spans", SPAN_TYPE)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.name for f in _ARROW_SPANS.value_type]
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                found = [[dict(zip(names, s, strict=True)) for s in spans(t)] for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, _ARROW_SPANS)], names=schema.names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def redacted(text: str | None) -> str | None:
    """``text`` with each span, or run of overlapping spans, replaced by [KIND]."""
    if not text:
        return text
    out, at = [], 0
    for kind, start, end, _ in spans(text):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """``docs`` with personal data in ``text_col`` replaced, and ``length_col``, where there is one, counted anew.

    All rows and columns stay, in their order; null texts stay null, with their length.
    """
    schema = docs.schema
    text_at = schema.names.index(text_col)
    length_at = schema.names.index(length_col) if length_col in schema.names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                texts = [redacted(t) for t in part.column(text_at).to_pylist()]
                columns = list(part.columns)
                columns[text_at] = pa.array(texts, columns[text_at].type)
                if length_at is not None:
                    old = columns[length_at].to_pylist()
                    columns[length_at] = pa.array([n if t is None else len(t) for n, t in zip(old, texts, strict=True)], columns[length_at].type)
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.mapInArrow(run, schema)
