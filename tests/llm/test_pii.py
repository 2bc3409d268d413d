"""Detectors against the plain patterns, disguises, redaction."""

import random
import re

import pytest
from corpus_data import SCHEMA, frame, rows

from allocora.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = 0
    for at, d in enumerate(reversed(digits)):
        value = int(d) * (1 + at % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def plain(text):
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


@pytest.mark.parametrize("letters", ["a@.b_c-1 2+3(0)9@..", "0123456789 -", "+0123456789 ().-", "0123.25"])
def test_plain_spans_equal_the_patterns(letters):
    draw = random.Random(letters)
    for _ in range(20_000):
        text = "".join(draw.choice(letters) for _ in range(draw.randint(1, 40)))
        assert pii.plain_spans(text) == plain(text), text


@pytest.mark.parametrize(
    ("text", "kind", "source"),
    [
        ("write john.smith [at] mail (dot) example [dot] com now", "email", "john.smith [at] mail (dot) example [dot] com"),
        ("ask john at example dot com today", "email", "john at example dot com"),
        ("mail jоhn@exаmple.com", "email", "jоhn@exаmple.com"),
        ("call plus one five five five two three four five six seven eight", "phone", "plus one five five five two three four five six seven eight"),
        ("card four" + " one" * 15 + " ok", "card", "four" + " one" * 15),
        ("９８.12.4.5 x", "ip", "９８.12.4.5"),
        ("ip eins neun zwei punkt eins sechs acht punkt eins punkt eins", "ip", "eins neun zwei punkt eins sechs acht punkt eins punkt eins"),
    ],
)
def test_disguises_map_back_to_the_source(text, kind, source):
    assert [(k, text[a:b], d) for k, a, b, d in pii.spans(text)] == [(kind, source, True)]
    assert pii.redacted(text) == text.replace(source, f"[{kind.upper()}]")


@pytest.mark.parametrize(
    "source",
    ["john@example dot com", "john@mail-1 dot example dot com", "JOHN@EXAMPLE  DOT  COM", "john at example.com", "j.doe at mail.example.co.uk", "JOHN AT EXAMPLE.COM", "juan arroba ejemplo.es"],
)
@pytest.mark.parametrize("around", ["{}", "({}) gorda", "lemnu {} gorda", "we met at noon, {} gorda"])
def test_half_spoken_addresses_stand_alone(source, around):
    text = around.format(source)
    assert [(k, text[a:b], d) for k, a, b, d in pii.spans(text)] == [("email", source, True)]


@pytest.mark.parametrize(
    ("source", "kind"),
    [
        ("plus five 5 5 five 1 2 3 4 five", "phone"),
        ("192 .168 .0 .one", "ip"),
        ("1.2.3.4 five", "ip"),
        ("1.2 five.3.4", "ip"),
        ("one (dot) 2 (dot) 3 (dot) 4", "ip"),
        ("10 dot 11 dot 12 dot 13", "ip"),
        ("10.11.12 dot one", "ip"),
        ("john (at) mail dot com", "email"),
        ("john@mail (punkt) com", "email"),
        ("JOHN ARROBA EJEMPLO PUNTO ES", "email"),
        ("\U0001d5f7\U0001d5fc\U0001d5f5\U0001d5fb@example.com", "email"),
    ],
)
@pytest.mark.parametrize("around", ["{}", "call {} please", "one two three. lemnu {} please", "x one dot two y, {} gorda", "we met at noon, {} gorda", "{} \u0130stanbul"])
def test_a_disguise_does_not_depend_on_text_elsewhere(source, kind, around):
    text = around.format(source)
    assert [(k, text[a:b]) for k, a, b, d in pii.spans(text) if d] == [(kind, source)]


@pytest.mark.parametrize(
    "parts",
    [
        ["one", "Fünf", "six", "5", "+1", "192", "dot", "point", "plus", "at", "@", ".", "-", " ", " ", " ", "  ", "(dot)", "[at]", "< . >", "mail", "com", "x", ",", "_", "é", "»"],
        ["10", "0", "255", "one", "fünf", "10", " dot ", ".", " ", " . ", " punkt "],
        ["one ", "two ", "six ", "5 ", "49 ", "+49 ", "-", ".", "plus ", "x "],
        ["john", "mail", "com", " at ", " arroba ", "@", ".", " dot ", " Punto ", " (at) ", "[.]"],
    ],
)
def test_gates_let_through_what_transducers_rewrite(parts):
    """Random texts of numbers, signs and words: a transducer that changes the text is never gated off."""
    draw = random.Random(4)
    changed = 0
    for _ in range(10_000):
        text = "".join(draw.choice(parts) for _ in range(draw.randint(1, 24)))
        for may, step in pii.STEPS:
            new = pii._rewrite(pii._same(text), step(text))[0]
            assert new == text or may(text), text
            changed += new != text
    assert changed > 50


@pytest.mark.parametrize("text", ["available at example.com", "back at work.It rained", "see us at example.org", "error at main.html", "at example.com"])
def test_places_are_no_addresses(text):
    assert pii.spans(text) == []


@pytest.mark.parametrize(
    "source",
    [
        "eight dot eight dot eight dot eight",
        "one dot one dot one dot one",
        "one two seven dot zero dot zero dot one",
        "192 dot 168 dot 0 dot 1",
        "10.0 dot 0.1",
        "Eins.zwei.drei.vier",
        "un point 2 point trois point 4",
    ],
)
@pytest.mark.parametrize("around", ["{}", "gorda {}, lemnu", "{}. Two of them", "in 2024 {}", "{} 500 times"])
def test_short_spelled_addresses(source, around):
    text = around.format(source)
    assert [(k, text[a:b], d) for k, a, b, d in pii.spans(text)] == [("ip", source, True)]


@pytest.mark.parametrize(
    "text",
    ["one dot two dot three", "one. Two. Three. Four.", "300 dot 1 dot 1 dot 1", "1 dot 2 dot 3 dot 4 dot 5", "3 point 5", "one - two dot three dot four"],
)
def test_other_dotted_numbers_are_left_alone(text):
    assert pii.spans(text) == []


def test_long_dotted_texts_take_linear_time():
    for text in ("1 dot " * 50_000, "one.2." * 50_000, "1 dot 2 dot 3 dot 4 x " * 10_000, "1 dot 2 dot 3 dot 4 - " * 10_000, "a@" + "b dot " * 50_000, "a@b" * 50_000):
        pii.spans(text)


@pytest.mark.parametrize("text", ["look at the dot com", "one two three", "she ran at dawn", "un deux trois soleil", "Straße at Ñandú"])
def test_plain_prose_is_left_alone(text):
    assert pii.spans(text) == []


def test_plain_spans_stay_beside_disguised_ones():
    text = "a@b.cd and c [at] d [dot] ef"
    assert [(k, text[a:b], d) for k, a, b, d in pii.spans(text)] == [("email", "a@b.cd", False), ("email", "c [at] d [dot] ef", True)]


def test_disguised_span_may_hold_a_plain_one():
    text = "mail jo\u200bhn@example.com now"
    assert [(k, text[a:b], d) for k, a, b, d in pii.spans(text)] == [
        ("email", "jo\u200bhn@example.com", True),
        ("email", "hn@example.com", False),
    ]
    assert pii.redacted(text) == "mail [EMAIL] now"


def test_long_texts_take_linear_time():
    for text in ("1" * 300_000, "a" * 300_000, "a@" * 150_000, "1." * 150_000, " " * 300_000 + "(", "( " * 100_000, "one " * 50_000, "@" * 300_000, " at a" * 100_000, "+1" * 150_000, "a at " * 50_000):
        pii.spans(text)


def test_find_and_redact(spark):
    data = [*rows(), (2000, "a@b.cd 1.2.3.4", "en", "src0", 14)]
    found = {(r["doc_id"], len(r["spans"])) for r in pii.find(frame(spark, data)).collect()}
    assert (2000, 2) in found and (1003, 0) in found and len(found) <= len(data)
    docs = frame(spark, data)
    clean = pii.redact(docs)
    assert clean.columns == docs.columns
    by_text = {r["doc_id"]: r for r in clean.collect()}
    assert by_text[2000]["text"] == "[EMAIL] [IP]" and by_text[2000]["n_chars"] == 12
    assert by_text[1003]["text"] is None and by_text[1003]["n_chars"] is None
    assert clean.count() == len(data)
    assert pii.find(spark.createDataFrame([], SCHEMA)).count() == 0
