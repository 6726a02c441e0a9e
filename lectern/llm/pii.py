"""Personal data: fixed patterns, and a conditional random field over word shapes.

Base findings are matches of one pattern per kind that pass the kind's test.
Around every *anchor* (a digit, ``@``, or a spelled-out ``at``/``dot``), the
field labels tokens by their shapes and neighbours; it is trained from a small
labelled table and decoded by Viterbi in numpy batches.  Its findings are added
where they pass the kind's test in normal form and touch no base finding, so
base findings always stay.  Text without an anchor within ``AROUND`` characters
holds none of these kinds and is not decoded.

Defined results: a null or empty text has no findings; offsets count code
points, ends are exclusive; repeated rows are scanned alike; extra columns are
ignored.  All patterns take time in proportion to the text.
"""

from __future__ import annotations

import functools
import random
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import crf

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))

# The base patterns.  Where a start inside a run cannot do better than the run's own start, it is not tried.
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def is_card(text: str) -> bool:
    d = digits_of(text)
    return 12 <= len(d) <= 19 and luhn(d)


def is_ip(text: str) -> bool:
    return all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in text.split("."))


def emails(text: str):
    done = 0
    at = text.find("@")
    while at >= 0:
        before = text[done:at]
        start = done + len(before.rstrip(LOCAL))
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
        done = m.end() if m else at + 1
        at = text.find("@", done)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    out = [(a, b, "email") for a, b in emails(text)] if "@" in text else []
    out += [(m.start(), m.end(), "ip") for m in IP.finditer(text) if is_ip(m.group())]
    out += [(m.start(), m.end(), "card") for m in CARD.finditer(text) if is_card(m.group())]
    if "+" in text:
        out += [(m.start(), m.end(), "phone") for m in PHONE.finditer(text) if 9 <= len(digits_of(m.group())) <= 15]
    return out


# --- the labelled table ---------------------------------------------------------------------------------------------

CARRIERS = {
    "email": ("write to {} today", "contact: {}", "mail {} for help", "my address is {}.", "reach me at {} or call", "send it to {} please", "e-mail {}"),
    "ip": ("the host {} answered", "server at {} is down", "from {} port 22", "ip address {}", "ping {} now"),
    "card": ("card number {} expires soon", "paid with visa {}", "charge {} today", "credit card: {}", "my card is {}."),
    "phone": ("call {} now", "tel: {}", "phone {} or write", "reach us on {}.", "mobile {}", "ring {} at noon", "fax {}"),
}
NOTHING = (
    "on 2024-01-15 at 10:30 the meeting began", "version 1.2.3 of the tool", "see pages 120-145 and 300", "doi 10.1016/j.cell.2020.01.001",
    "isbn 978-3-16-148410-0 was printed", "it cost 1,299.99 in 2019", "order 100200300400 was shipped", "the years 1990 to 1995", "a total of 12 345 678 units",
    "at 5 o'clock dot the i", "chapter 3.1.2.4.5 of the manual", "the score was 3-2 after 90 minutes", "the value is 3.14159265358979", "room 12, floor 3",
    "follow @handle for news", "meet me at the station at 9", "a dot on the map at noon", "id 0000123456789012345678", "section 4.2 and 4.3", "12.05.2021 was a sunny day",
    "ratio 10:20:30:40", "part no 555-12", "call 911 or 112", "phone booth 42 is at the corner", "batch 2021-0042-17", "the 3 dot 2 release", "lat 48.8566 lon 2.3522",
    "build 20240115.3", "the sum 1 + 2 + 3 = 6", "tel 12", "1 2 3 4 5 6 7 8 9", "page 7 at line 12", "license CC BY-NC 4.0 applies", "item 42 of 100",
)


def labelled_table(seed: int = 7, each: int = 60) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Sentences with their findings: plain and obfuscated values of each kind in carrier sentences, and sentences without any."""
    rng = random.Random(seed)
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice(("an", "be", "co", "do", "er", "fi", "ga", "lo", "mi", "ta")) for _ in range(rng.randint(2, 3)))
    end = lambda: rng.choice(("com", "org", "net", "de", "fr", "es", "io", "edu"))

    def email() -> str:
        at, dot = rng.choice((("@", "."), (" at ", " dot "), (" (at) ", " (dot) "), ("[at]", "[dot]"), (" [at] ", " [dot] "), ("(at)", "."), (" @ ", " . "), (" @ ", ".")))
        local = word() + rng.choice(("", dot + word(), number(2)))
        return local + at + word() + rng.choice(("", dot + word())) + dot + end()

    def ip() -> str:
        return rng.choice((".", ".", " . ", "[.]", "(.)")).join(str(rng.randint(0, 255)) for _ in range(4))

    def card() -> str:
        d = rng.choice("3456") + number(14)
        d += next(c for c in "0123456789" if luhn(d + c))
        return rng.choice((" ", "-", ".", "", "/", " - ")).join(d[i : i + 4] for i in range(0, 16, 4))

    def phone() -> str:
        a, b, c = number(3), number(3), number(4)
        return rng.choice((f"+{rng.randint(1, 99)} {a} {b} {c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+1 ({a}) {b}-{c}", f"0{a} {b} {c}", f"00{rng.randint(30, 49)} {a} {b}{c}", f"0{a}/{b}{c}"))

    makers = {"email": email, "ip": ip, "card": card, "phone": phone}
    rows = []
    for kind, make in makers.items():
        for _ in range(each):
            carrier, value = rng.choice(CARRIERS[kind]), make()
            lead = rng.choice(("", word() + " ", f"{word()} {word()}, "))
            start = len(lead) + carrier.index("{}")
            rows.append((lead + carrier.replace("{}", value), [(start, start + len(value), kind)]))
    rows += [(s, []) for s in NOTHING for _ in range(2)]
    rows += [(f"{word()} {number(rng.randint(1, 19))} {word()} {word()}", []) for _ in range(each)]
    return rows


# --- the field ------------------------------------------------------------------------------------------------------

TOKEN = re.compile(r"[A-Za-zÀ-￿]+|[0-9]+|[^\sA-Za-z0-9À-￿]")
ANCHOR = re.compile(r"[0-9@]|[\[(]at[\])]|\bdot\b|[\[(]dot[\])]", re.A)
CUES = frozenset("at dot mail email e contact write address reach ip host server ping port from card visa credit charge paid tel phone call mobile ring fax number version isbn doi page pages".split())
AROUND, BLOCK, MARGIN = 80, 512, 32


def shape(token: str) -> str:
    if token[0].isdigit():
        return f"d{len(token)}" if len(token) <= 6 else "d7-" if len(token) < 12 else "d12-" if len(token) < 20 else "d20"
    if token[0].isalpha():
        low = token.lower()
        return f"w:{low}" if low in CUES else ("x" if token == low else "X") + ("1" if len(token) == 1 else "3" if len(token) <= 3 else "")
    return token


def features(tokens: list[tuple[str, int, int]]) -> list[list[str]]:
    shapes = ["^^", "^", *(shape(t) for t, _, _ in tokens), "$", "$$"]
    glued = [False, *(b == a for (_, _, b), (_, a, _) in zip(tokens, tokens[1:], strict=False)), False]
    out = []
    for i in range(len(tokens)):
        s = shapes[i : i + 5]
        g = "g" if glued[i] else "_"
        h = "g" if glued[i + 1] else "_"
        out.append(["b", f"0{s[2]}", f"-{s[1]}{g}", f"+{s[3]}{h}", f"-0{s[1]}{g}{s[2]}", f"0+{s[2]}{h}{s[3]}", f"--{s[0]}|{s[1]}", f"++{s[3]}|{s[4]}", f"-+{s[1]}{g}{s[2]}{h}{s[3]}"])
    return out


def tokens_of(text: str, start: int, end: int) -> list[tuple[str, int, int]]:
    return [(m.group(), m.start(), m.end()) for m in TOKEN.finditer(text, start, end)]


@functools.cache
def model() -> crf.Model:
    rows, tags = [], []
    for text, spans in labelled_table():
        tokens = tokens_of(text, 0, len(text))
        own = ["O"] * len(tokens)
        for a, b, kind in spans:
            inside = [i for i, (_, x, y) in enumerate(tokens) if a <= x and y <= b]
            for i in inside:
                own[i] = ("B-" if i == inside[0] else "I-") + kind
        rows.append(features(tokens))
        tags.append(own)
    return crf.train(rows, tags, LABELS)


def valid(kind: str, text: str) -> bool:
    """Does a finding of the field pass the test of its kind in normal form?"""
    if kind == "email":
        plain = re.sub(r"\s*[\[(]?\bdot\b[\])]?\s*|\s+\.\s+", ".", re.sub(r"\s*(?:[\[(]at[\])]|\bat\b|@)\s*", "@", text, count=1))
        return bool(re.fullmatch(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,8}", plain))
    if kind == "ip":
        plain = re.sub(r"\s*[\[(]?\.[\])]?\s*", ".", text)
        return bool(re.fullmatch(r"[0-9]{1,3}(\.[0-9]{1,3}){3}", plain)) and is_ip(plain)
    if kind == "card":
        return bool(re.fullmatch(r"[0-9]{4}(\s*[-./\s]?\s*[0-9]{2,6}){2,4}", text)) and is_card(text)
    return 9 <= len(digits_of(text)) <= 15 and bool(re.fullmatch(r"[+(0-9][-()./0-9\s]*[0-9]", text)) and len(re.findall(r"[0-9]+", text)) >= 3


def windows(text: str):
    """Stretches around anchors, cut at blanks, as (start, end)."""
    begun = None
    for m in ANCHOR.finditer(text):
        a, b = max(0, m.start() - AROUND), min(len(text), m.end() + AROUND)
        if begun is None:
            begun, until = a, b
        elif a <= until:
            until = b
        else:
            yield begun, until
            begun, until = a, b
    if begun is not None:
        yield begun, until


def blocks(texts: list[str]):
    """(text number, tokens, first and last token whose findings count) for all windows; long ones overlap by twice the margin."""
    for n, text in enumerate(texts):
        if not text or not ANCHOR.search(text):
            continue
        for a, b in windows(text):
            tokens = tokens_of(text, a, b)
            step = BLOCK - 2 * MARGIN
            for at in range(0, max(1, len(tokens) - 2 * MARGIN), step):
                part = tokens[at : at + BLOCK]
                yield n, part, at and MARGIN, len(part) if at + BLOCK >= len(tokens) else BLOCK - MARGIN


def find_all(texts: list[str | None], field: crf.Model) -> list[list[tuple[int, int, str]]]:
    """All findings of each text as (start, end, kind), in order of start, then of ``KINDS``."""
    texts = [t or "" for t in texts]
    out = [base_spans(t) for t in texts]
    taken = [sorted(spans) for spans in out]
    todo: list = []

    def decode() -> None:
        for (n, tokens, first, last), labels in zip(todo, crf.viterbi(field, [features(t) for _, t, _, _ in todo]), strict=True):
            i = 0
            while i < len(tokens):
                if labels[i][0] != "B":
                    i += 1
                    continue
                j, kind = i + 1, labels[i][2:]
                while j < len(tokens) and labels[j] == f"I-{kind}":
                    j += 1
                a, b = tokens[i][1], tokens[j - 1][2]
                if first <= i < last and valid(kind, texts[n][a:b]) and not any(x < b and a < y for x, y, _ in taken[n]):
                    out[n].append((a, b, kind))
                i = j
        todo.clear()

    for block in blocks(texts):
        todo.append(block)
        if len(todo) >= 2_000:
            decode()
    decode()
    return [sorted(set(spans), key=lambda s: (s[0], KINDS.index(s[2]), s[1])) for spans in out]


SPANS = "array<struct<kind: string, start: long, end: long, base: boolean>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))


def find(docs: DataFrame) -> DataFrame:
    """``doc_id, spans``; the field is trained on the driver and travels with the task."""
    field = model()

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            rows = []
            for text, spans in zip(texts, find_all(texts, field), strict=True):
                own = set(base_spans(text or ""))
                rows.append([{"kind": k, "start": a, "end": b, "base": (a, b, k) in own} for a, b, k in spans])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, _SPANS)], names=["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, f"doc_id long, spans {SPANS}")
