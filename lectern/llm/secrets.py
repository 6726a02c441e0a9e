"""Secret scans: fixed patterns, and novelty measured by a primed zstandard coder.

Three patterns give the base findings.  Beyond them, a string is a candidate if
a sensitive word stands shortly before it on its line, or ends the line before,
and it has digits amid its letters; after the header of a private key, every
line of base64 up to the END marker is one.  It is reported (kind ``novel``) if a compressor that
already knows a dictionary of identifiers, and has just read the text around
the candidate, still needs many bytes for it: random keys cannot be predicted,
names and words can.

Defined results: a null or empty text has no findings; offsets count code
points, ends are exclusive; findings of one kind never overlap, findings of
different kinds may, except that a novel one never overlaps a base one;
repeated rows are scanned alike.  All patterns take time in proportion to the
text.  ``scan`` returns the id and the findings only, and ``redact`` passes
extra columns through.
"""

from __future__ import annotations

import functools
import re

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "novel")
MASK = "[SECRET]"

# The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")

SENSITIVE = re.compile(
    r"passphrase|password|passwd|pwd|secret|token|credential|bearer|authorization|auth[_-]?key|"
    r"(?:api|access|private|signing|encryption|account|session|client)[_ -]?key|connection[_ -]?string|BEGIN [A-Z ]{0,20}PRIVATE KEY",
    re.A | re.I,
)
HINTS = ("pass", "pwd", "secret", "token", "credential", "bearer", "auth", "key", "connection")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=~-]{16,}")
#: The least length of a candidate, and of the windows by which longer ones are measured: over more, even random base 32 costs less than its share.
LEAST, MEASURED = 16, 128
#: From the end of a sensitive word that ends its line into the next line.
NEXT_LINE = re.compile(r"[^A-Za-z0-9\n]*\n[^\n]*")
#: A private key: its header, the breaks between its lines (escaped ones too), and what a line holds, a field or base64.
KEY_HEADER = re.compile(r"BEGIN [A-Z ]{0,20}PRIVATE KEY(?: BLOCK)?-*", re.A | re.I)
KEY_BREAK = re.compile(r"""[ \t"',;]*(?:\\r)?(?:\\n|\r?\n)[ \t>|#*"']*""")
KEY_LINE = re.compile(r"(?P<field>[A-Za-z-]+:[^\n\\]*)|[A-Za-z0-9+/=]*")
KEY_END = re.compile(r"""[ \t"',;]*(?:-----END|$)""")
#: Letters or digits in a row.
RUN = re.compile(r"[0-9]+|[A-Za-z]+")
#: How far after a sensitive word a candidate may begin, how much text around it primes the coder, and the least share of its length that it must cost.
REACH, AROUND, NOVELTY = 64, 600, 0.72

IDENTIFIERS = """
password passwd passphrase secret token api_key apikey access_key private_key client_secret client_id credential
credentials authorization authentication bearer basic session session_id cookie signature refresh_token access_token
connection_string database username user_name hostname localhost endpoint example placeholder changeme your_token_here
environment variable configuration settings production development staging default parameter argument function return
import export class public private static const string integer boolean null true false none undefined self this
get_secret set_password read_config load_settings os.environ process.env getenv System.getProperty application.properties
http https www com org net html json yaml xml utf-8 base64 sha256 md5 hmac rsa ssh-rsa ssh-ed25519 openssl
the and for with that this from have not are was were which their there been will would could should
0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ xxxxxxxxxxxxxxxx 0000000000000000 1234567890123456
""".strip()


@functools.cache
def coder(level: int = 3) -> zstandard.ZstdCompressor:
    dictionary = zstandard.ZstdCompressionDict(IDENTIFIERS.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(level=level, dict_data=dictionary, write_content_size=False, write_checksum=False, write_dict_id=False)


def novelty(candidate: str, around: str) -> float:
    """Marginal compressed bytes of ``candidate`` after ``around``, per byte of it."""
    return next(novelties([candidate], around.replace(candidate, " ")))


def novelties(parts: list[str], around: str):
    """The novelty of each part; ``around`` is compressed once."""
    known = around.encode("utf-8") + b" "
    plain = len(coder().compress(known))
    for part in parts:
        own = part.encode("utf-8")
        yield (len(coder().compress(known + own)) - plain) / len(own)


def is_mixed(word: str) -> bool:
    """Letters amid digits or digits amid letters; a name with a number at its end is neither."""
    changes, last = 0, None
    for m in RUN.finditer(word):
        digit = m.group()[0].isdigit()
        changes += last is not None and digit != last
        if changes > 1:
            return True
        last = digit
    return False


def base_spans(text: str) -> list[tuple[int, int, str]]:
    out: list[tuple[int, int, str]] = []
    low = text.lower()
    if any(k in low for k in ("passw", "secret", "token", "api")):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return out


def key_lines(text: str) -> list[list[tuple[int, int]]]:
    """The lines of base64 of each private key, up to its END marker or to what no key has."""
    keys, at = [], 0
    for m in KEY_HEADER.finditer(text):
        if m.start() < at:
            continue
        at, lines = m.end(), []
        while after := KEY_BREAK.match(text, at):
            line = KEY_LINE.match(text, after.end())
            at = line.end()
            if not line["field"] and at > line.start() and (KEY_BREAK.match(text, at) or KEY_END.match(text, at)):
                lines.append(line.span())
        keys.append(lines)
    return keys


def outside(start: int, end: int, taken: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """The parts of a span that none of the spans ``taken`` (in order) covers."""
    parts = []
    for a, b, _ in taken:
        if a >= end:
            break
        if b > start:
            parts += [(start, a)] * (a > start)
            start = b
    return parts + [(start, end)] * (start < end)


def novel_keys(text: str, taken: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """The novel lines of private keys; one too short to be measured goes with the line before it.

    A line is measured after the dictionary alone: other lines of base64 would
    teach the coder its letters.
    """
    out = []
    for lines in key_lines(text):
        told, at = False, [t for t in taken if lines and t[1] > lines[0][0] and t[0] < lines[-1][1]]
        for start, end in lines:
            if end - start >= LEAST:
                told = is_novel(text[start:end], "")
            if told:
                out += [(a, b, "novel") for a, b in outside(start, end, at)]
    return out


def is_novel(word: str, around: str) -> bool:
    """Whether any of the equal windows, of ``MEASURED`` characters at most, that make up ``word`` is novel; ``word`` itself is taken out of ``around``."""
    step = -(-len(word) // -(-len(word) // MEASURED))
    shares = novelties([word[i : i + step] for i in range(0, len(word), step)], around.replace(word, " "))
    return any(share >= NOVELTY for share in shares)


def find(text: str | None) -> list[tuple[int, int, str]]:
    """All findings as (start, end, kind), in order of start, then of ``KINDS``."""
    if not text:
        return []
    out = base_spans(text)
    low = text.lower()
    if any(k in low for k in HINTS):
        out += novel_keys(text, sorted(out))
        taken = sorted(out)
        seen = at = 0
        for m in SENSITIVE.finditer(text):
            for c in CANDIDATE.finditer(text, max(m.end(), seen), min(len(text), m.end() + REACH + LEAST - 1)):
                start, end = c.start(), CANDIDATE.match(text, c.start()).end()  # the reach limits where it begins, not where it ends
                gap = text[m.end() : start]
                if "\n" in gap and not NEXT_LINE.fullmatch(gap):
                    break
                seen = end
                while at < len(taken) and taken[at][1] <= start:
                    at += 1
                if any(a < end and start < b for a, b, _ in taken[max(0, at - 3) : at + 8]):
                    continue
                word = text[start:end]
                if not is_mixed(word):
                    continue
                if is_novel(word, text[max(0, start - AROUND) : start] + " " + text[end : end + AROUND]):
                    out.append((start, end, "novel"))
    return sorted(set(out), key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


SPANS = "array<struct<kind: string, start: long, end: long>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id, spans``."""

    def run(batches):
        for batch in batches:
            spans = [[{"kind": k, "start": a, "end": b} for a, b, k in find(t.as_py())] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, _SPANS)], names=["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, f"doc_id long, spans {SPANS}")


def masked(text: str | None) -> str | None:
    """``text`` with every finding, or run of overlapping findings, replaced by ``MASK``."""
    if not text or not (spans := find(text)):
        return text
    parts, done = [], 0
    for a, b, _ in spans:
        if a >= done:
            parts += [text[done:a], MASK]
        done = max(done, b)
    return "".join([*parts, text[done:]])


def redact(docs: DataFrame, length: str = "n_chars") -> DataFrame:
    """The documents with findings masked; ``length``, if it is a column, counts the new code points."""

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = pa.array([masked(t.as_py()) for t in batch.column(at)], pa.string())
            yield batch.set_column(at, batch.schema.field(at), texts)

    out = docs.mapInArrow(run, docs.schema)
    if length in docs.columns:
        out = out.withColumn(length, F.char_length("text").cast(docs.schema[length].dataType))
    return out
