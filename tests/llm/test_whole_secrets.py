"""Secrets that go over line ends."""

import base64
import hashlib
import random
import re
import string
import time

import pytest
from conftest import SF

from lectern.llm import secrets
from lectern.llm.queries_secrets import op7_secrets

ALPHABET = string.ascii_letters + string.digits + "+/"


def key(seed, n):
    rng = random.Random(seed)
    return "".join(rng.choice(ALPHABET) for _ in range(n))


@pytest.mark.parametrize("newline", ["\n", "\r\n", "\\n", "\n    "])
@pytest.mark.parametrize("kind", ["RSA PRIVATE KEY", "PRIVATE KEY", "OPENSSH PRIVATE KEY"])
def test_every_line_of_a_private_key(kind, newline):
    lines = [key(i, 64) for i in range(12)] + ["q8Z="]
    fields = ["Proc-Type: 4,ENCRYPTED", ""] if kind.startswith("RSA") and newline == "\n" else []
    text = newline.join(["see below", f"-----BEGIN {kind}-----", *fields, *lines, f"-----END {kind}-----", "and more text here"])
    assert [text[a:b] for a, b, k in secrets.find(text) if k == "novel"] == lines
    out = secrets.masked(text)
    assert not any(x in out for x in lines) and out.endswith("and more text here") and f"-----END {kind}-----" in out


def test_value_on_the_line_after_its_word():
    value = "q8Zr3TtB1mX0LwVd9Kp"
    assert secrets.masked(f"password:\n  {value}\nend") == "password:\n  [SECRET]\nend"
    for text in (f"password:\n\n{value}", f"password of mine\n{value}", f"plain\n{value}"):
        assert secrets.find(text) == []


def test_no_words_after_a_header_are_keys():
    assert secrets.find("-----BEGIN PRIVATE KEY-----\nsomething\nthe authentication configuration\n") == []
    text = "x: BEGIN PRIVATE KEY\n" * 20_000
    assert secrets.find(text) == []


@pytest.mark.parametrize("length", [32, 128, 256, 1_024, 6_000])
def test_keys_of_small_alphabets_and_any_length(length):
    rng = random.Random(length)
    found = 0
    for _ in range(20):
        word = base64.b32encode(rng.randbytes(length)).decode()[:length]
        found += any(k == "novel" for *_, k in secrets.find(f"the bearer is {word} today"))
    assert found >= 19


def test_the_whole_candidate_is_measured():
    dull, random_part = "xy1" * 1_400, key(9, 4_000)
    for word in (dull + random_part, random_part + dull):
        assert [(a, b) for a, b, k in secrets.find(f"bearer {word} end") if k == "novel"] == [(7, 7 + len(word))]
    assert secrets.find(f"bearer {dull} end") == []


def test_mixed_equals_its_definition():
    rng = random.Random(2)
    plain = re.compile(r"[0-9].*[A-Za-z].*[0-9]|[A-Za-z].*[0-9].*[A-Za-z]")
    for _ in range(5_000):
        word = "".join(rng.choice("a1-Z9_") for _ in range(rng.randrange(12)))
        assert secrets.is_mixed(word) == bool(plain.search(word))


def test_candidates_take_linear_time():
    began = time.process_time()
    for text in ("token is " + "z" * 100_000 + "1-" * 50_000, "token is " + "1-" * 100_000, "bearer " + "a1" * 100_000):
        secrets.find(text)
    assert time.process_time() - began < 20


def plain_spans(text):
    """The base patterns by the definition: leftmost matches, failing ones dropped."""
    spans = [(m.start(), m.end(), "assign") for m in re.finditer(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[1]) >= 8]
    spans += [(m.start(), m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 16]
    spans += [(m.start(), m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 32]
    return sorted(spans, key=lambda s: (s[0], ["assign", "access", "hex"].index(s[2])))


def test_query_equals_brute_force(spark):
    rows = {r.doc_id: r for r in op7_secrets(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs:
        want, r = plain_spans(d.text or ""), rows[d.doc_id]
        joined = ",".join(f"{k}:{a}:{b}" for a, b, k in want)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x for *_, k in want) for x in ("assign", "access", "hex"))
        every = r.spans.split(",") if r.spans else []
        assert {f"{k}:{a}:{b}" for a, b, k in want} <= set(every)
        assert [x for x in every if not x.startswith("novel")] == [f"{k}:{a}:{b}" for a, b, k in want]
