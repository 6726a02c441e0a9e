"""Byte-level BPE encoding and decoding by a lazily determinised transducer.

The merges (given as token ranks) are compiled into a finite-state transducer
that reads a pre-token byte by byte.  It rests on two facts about BPE:

* two neighbouring tokens can stand in an encoding exactly if no merge across
  their boundary would have come before the merges that built them, and an
  encoding is right exactly if all its neighbours can stand together;
* hence every prefix of the input has one possible last token, found from the
  last tokens of shorter prefixes.

A state is the last emitted token and the bytes after it.  Start positions at
which some longer token could still begin are *live*; what the token chains of
all live positions share can no longer change, so it is emitted.  The lookahead
is thus bounded by the longest token.  Emitted tokens that forbid the same
continuations lead to one state.  States and transitions are made when
first met and kept in two generations: when the younger is full, the older one,
which holds what was not met since, goes.  ``max_moves`` bounds a generation; it
changes speed only.  A piece that is a token itself needs no machine.

Decoding feeds token bytes, in chunks, to an incremental UTF-8 state machine
that holds back an unfinished character until its next bytes arrive; malformed
bytes become U+FFFD.

Defined results: a null or empty text has no tokens and decodes to the empty
string; an id outside the vocabulary raises; repeated rows give repeated
results; texts are handled in blocks of pre-tokens, so a very long one needs no
more memory than its text and its ids.  Extra columns pass through ``encode``
and ``decode`` unless they bear the name of the added column, which replaces
them.
"""

from __future__ import annotations

import base64
import codecs
import functools
import hashlib
from bisect import bisect_left
from itertools import chain, islice

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK = 20_000
ENDLESS = 1 << 60


class State:
    """``ends[i]``: the last token of the first ``i`` pending bytes, for 0 the token before them; ``live``: the places from which a token may still go on."""

    __slots__ = ("ends", "live", "number", "pending")

    def __init__(self, number: int, pending: bytes, ends: tuple[int, ...], live: tuple[int, ...]):
        self.number, self.pending, self.ends, self.live = number, pending, ends, live


class Transducer:
    #: Liveness looks at each longer token if there are so few; else it takes one of them to fit, which is safe.
    FEW = 4

    def __init__(self, ranks: dict[bytes, int], max_moves: int = 100_000):
        self.ranks, self.max_moves = ranks, max_moves
        self.token = {v: k for k, v in ranks.items()}
        self.sizes = {v: len(k) for k, v in ranks.items()}
        self.open: dict[bytes, list[int]] = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                self.open.setdefault(token[:i], []).append(rank)
        self.shift = max(ranks.values()).bit_length()
        self.spines: dict[int, list[tuple[bytes, int]]] = {}
        self.rivals: dict[tuple[bytes, bytes], list[int]] = {}
        self.fits: dict[int, bool] = {}
        self.start, self.numbers = State(0, b"", (-1,), (0,)), 0
        self.states: dict[tuple[int, bytes], State] = {}
        self.moves: dict[int, tuple[State, tuple[int, ...]]] = {}
        self.old_states, self.old_moves = self.states, self.moves

    def split(self, token: bytes) -> tuple[bytes, bytes]:
        """The two parts that the last merge of ``token`` joins."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], ENDLESS))
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts[0], parts[1]

    def spine(self, token: int, right: bool) -> list[tuple[bytes, int]]:
        """The parts along one edge of a token while it is built, each with the rank of the merge that takes it up."""
        key = token * 2 + right
        if (known := self.spines.get(key)) is None:
            part, until, known = self.token[token], ENDLESS, []
            while True:
                known.append((part, until))
                if len(part) == 1:
                    break
                until, part = self.ranks[part], self.split(part)[right]
            self.spines[key] = known
        return known

    def fit(self, left: int, right: int) -> bool:
        """Can ``left`` and ``right`` be neighbours?  Of merges of equal rank the leftmost comes first."""
        key = left << self.shift | right
        if (known := self.fits.get(key)) is None:
            if len(self.fits) > 2 * self.max_moves:
                self.fits.clear()
            known, rank_of, rights = True, self.ranks.get, self.spine(right, False)
            for a, until_a in self.spine(left, True):
                for b, until_b in rights:
                    rank = rank_of(a + b)
                    if rank is not None and rank < until_a and rank <= until_b:
                        known = False
                        break
                if not known:
                    break
            self.fits[key] = known
        return known

    def extends(self, left: int, start: bytes) -> bool:
        """Can a token that goes on from ``start`` follow ``left``?"""
        longer = self.open.get(start)
        if longer is None:
            return False
        if left < 0 or len(longer) > self.FEW:
            return True
        for x in longer:
            if self.fit(left, x):
                return True
        return False

    def end_of(self, state: State, pending: bytes) -> int:
        """The last token of what ``pending`` makes of the input."""
        ends = state.ends
        for at in state.live:
            token = self.ranks.get(pending[at:])
            if token is not None and (ends[at] < 0 or self.fit(ends[at], token)):
                return token
        raise ValueError(f"the vocabulary has no token for the byte {pending[-1:]!r}")

    def chain(self, ends: tuple[int, ...], at: int) -> tuple[int, ...]:
        """The tokens that make up the first ``at`` pending bytes."""
        out, sizes = [], self.sizes
        while at:
            out.append(ends[at])
            at -= sizes[ends[at]]
        return tuple(reversed(out))

    def step(self, state: State, byte: int) -> tuple[State, tuple[int, ...]]:
        pending, sizes = state.pending + bytes((byte,)), self.sizes
        ends = (*state.ends, self.end_of(state, pending))
        cut, live = len(pending), []
        for at in state.live:
            if self.extends(ends[at], pending[at:]):
                live.append(at)
                while at != cut:  # back along both token chains to where they meet
                    if at > cut:
                        at -= sizes[ends[at]]
                    else:
                        cut -= sizes[ends[cut]]
        live.append(len(pending))
        rest, tail = pending[cut:], [-1] * (len(pending) - cut + 1)
        for at in live:
            while at > cut and tail[at - cut] < 0:
                tail[at - cut] = ends[at]
                at -= sizes[ends[at]]
        # If no token will begin at the cut, its left neighbour has no more say.
        kind = self.kind(ends[cut], rest) if cut == live[0] else -1
        key = (kind, rest, *tail)
        after = self.states.get(key)
        if after is None:
            after = self.old_states.get(key)
            if after is None:
                self.numbers += 1
                tail[0] = ends[cut] if cut == live[0] else -1
                after = State(self.numbers, rest, tuple(tail), tuple(at - cut for at in live))
            self.states[key] = after
        return after, self.chain(ends, cut)

    def kind(self, left: int, start: bytes) -> tuple[tuple[bytes, int], ...]:
        """What of ``left`` can forbid a token that begins with ``start``: parts at its right edge, and how many merges come before they are taken up."""
        if left < 0:
            return ()
        out = []
        for part, until in self.spine(left, True):
            key = (part, start)
            if (rivals := self.rivals.get(key)) is None:
                if len(self.rivals) >= self.max_moves:
                    self.rivals.clear()
                whole = part + start
                ranks = [self.ranks.get(whole[:i], -1) for i in range(len(part) + 1, len(whole) + 1)]
                rivals = self.rivals[key] = sorted([*self.open.get(whole, ()), *[r for r in ranks if r >= 0]])
            if before := bisect_left(rivals, until):
                out.append((part, before))
        return tuple(out)

    def move(self, state: State, byte: int) -> tuple[State, tuple[int, ...]]:
        """A transition that is not in the younger generation."""
        key = state.number << 8 | byte
        move = self.old_moves.get(key) or self.step(state, byte)
        if len(self.moves) >= self.max_moves:
            self.old_moves, self.old_states, self.moves, self.states = self.moves, self.states, {}, {}
        self.moves[key] = move
        return move

    def encode(self, piece: bytes) -> list[int]:
        if not piece:
            return []
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        state, out, known = self.start, [], self.moves.get
        for byte in piece[:-1]:
            state, emitted = known(state.number << 8 | byte) or self.move(state, byte)
            if emitted:
                out += emitted
        # Nothing follows the last byte, so no state is made for it.
        pending = state.pending + piece[-1:]
        out += self.chain((*state.ends, self.end_of(state, pending)), len(pending))
        return out


class Codec:
    """Splits texts by ``pattern`` and runs each piece through the transducer."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, cached_pieces: int = 120_000):
        self.machine = Transducer(ranks)
        self.pieces = regex.compile(pattern)
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.digits = [str(i) for i in range(len(self.bytes_of))]
        # Pieces met lately, in two generations: the older one is dropped when the younger is full.
        self.known: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.cached_pieces = cached_pieces

    def piece_ids(self, piece: str) -> tuple[int, ...]:
        ids = self.known.get(piece) or self.older.get(piece)  # a block may have begun before the last turn
        if ids is None:
            ids = tuple(self.machine.encode(piece.encode("utf-8")))
            if len(piece) > 40:
                return ids
        if len(self.known) >= self.cached_pieces:
            self.known, self.older = {}, self.known
        self.known[piece] = ids
        return ids

    def encode_blocks(self, text: str):
        """The ids of ``text``, some thousands of pieces at a time."""
        found = (m.group() for m in self.pieces.finditer(text)) if len(text) > 200_000 else iter(self.pieces.findall(text))
        while block := list(islice(found, BLOCK)):
            known = self.known
            yield list(chain.from_iterable([known.get(p) or self.piece_ids(p) for p in block]))

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(self.encode_blocks(text or "")))

    def decode_blocks(self, blocks):
        """Text of blocks of ids, as far as its characters are complete."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        for block in blocks:
            yield machine.decode(b"".join(map(self.bytes_of.__getitem__, block)))
        yield machine.decode(b"", True)

    def decode(self, ids) -> str:
        ids = iter(ids)
        return "".join(self.decode_blocks(iter(lambda: list(islice(ids, BLOCK)), [])))


@functools.lru_cache(maxsize=4)
def codec(vocabulary: str, pattern: str) -> Codec:
    """One codec per worker process; ``vocabulary`` is a file of base-64 tokens and ranks on every machine."""
    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    return Codec(ranks, pattern)


def _mapped(df: DataFrame, column: str, kind: T.DataType, function) -> DataFrame:
    """``df`` with ``column`` made by ``function(batch)``; the other columns stay as they are."""
    schema = T.StructType([f for f in df.schema.fields if f.name != column] + [T.StructField(column, kind)])
    names = [f.name for f in schema.fields[:-1]]

    def run(batches):
        for batch in batches:
            values = function(batch)
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(n)) for n in names], values], names=[*names, column])

    return df.mapInArrow(run, schema)


def encode(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the array of token ids of its text."""

    def run(batch):
        c = codec(vocabulary, pattern)
        at = batch.schema.get_field_index(text)
        return pa.array((c.encode(t.as_py()) for t in batch.column(at)), pa.list_(pa.int32()))

    return _mapped(docs, ids, T.ArrayType(T.IntegerType()), run)


def decode(encoded: DataFrame, vocabulary: str, pattern: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """``encoded`` with the text of its token ids."""

    def run(batch):
        c = codec(vocabulary, pattern)
        at = batch.schema.get_field_index(ids)
        return pa.array((c.decode(x.as_py() or ()) for x in batch.column(at)), pa.string())

    return _mapped(encoded, text, T.StringType(), run)


ROUND_TRIP = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def round_trip(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """Encodes every text, decodes the ids, and returns digests of both, block by block."""

    def run(batches):
        c = codec(vocabulary, pattern)
        for batch in batches:
            counts, ids_sha, text_sha = [], [], []
            for value in batch.column(1):
                n, ids_hash, text_hash = 0, hashlib.sha256(), hashlib.sha256()

                def fed(blocks, ids_hash=ids_hash):
                    nonlocal n
                    for block in blocks:
                        if block:
                            ids_hash.update(((" " if n else "") + " ".join(map(c.digits.__getitem__, block))).encode())
                            n += len(block)
                            yield block

                for part in c.decode_blocks(fed(c.encode_blocks(value.as_py() or ""))):
                    text_hash.update(part.encode("utf-8"))
                counts.append(n)
                ids_sha.append(ids_hash.hexdigest())
                text_sha.append(text_hash.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha), pa.array(text_sha)],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, ROUND_TRIP)
