"""Decoder of binary equations: bytes to a tree of nodes, with warnings.

The grammar is a table of record types; a record either yields a node or only
moves the reader.  Truncated input keeps what was read before.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from lectern.formulas.symbols import ACCENTS, OPERATORS, SELECTORS, shown

# Option bits of records.
NUDGED, EMBELLISHED, FUNCTION_START, WIDE_8, WIDE_16, NO_CODE = 0x08, 0x01, 0x02, 0x04, 0x10, 0x20
EMPTY_LINE, LINE_SPACE, RULED = 0x01, 0x04, 0x02
# Limits that shape the result on broken input.
MOST_RECORDS, MOST_ACCENTS, MOST_HOPS = 10_000, 1_000, 8
MOST_DEPTH = 150

SUB, SUP, SUBSUP = 27, 28, 29


@dataclass
class Node:
    """``kind``: row, pile, text, template, matrix or accent."""

    kind: str
    at: int
    kids: list[Node] = field(default_factory=list)
    text: str = ""
    code: int | None = None
    unknown: bool = False
    selector: int = 0
    variation: int = 0
    rows: int = 0
    cols: int = 0


def hexed(value: int, width: int = 2) -> str:
    return f"0x{value:0{width}X}"


class Truncated(ValueError):
    pass


class Reader:
    def __init__(self, data: bytes):
        self.data, self.at, self.nibble = data, 0, None

    @property
    def left(self) -> int:
        return len(self.data) - self.at

    def skip(self, n: int) -> None:
        if n > self.left:
            raise Truncated(f"Unexpected end of MTEF stream at offset {self.at}")
        self.at += n
        self.nibble = None

    def uint(self, size: int = 1) -> int:
        start = self.at
        self.skip(size)
        return int.from_bytes(self.data[start : self.at], "little")

    def packed(self) -> int:
        first = self.uint()
        return first if first < 0xFF else self.uint(2) if self.left >= 2 else self.uint() and self.uint()

    def text(self) -> str:
        end = self.data.find(b"\0", self.at)
        end = len(self.data) if end < 0 else end
        out = self.data[self.at : end].decode("latin-1")
        self.at, self.nibble = min(end + 1, len(self.data)), None
        return out

    def half(self) -> int:
        if self.nibble is not None:
            out, self.nibble = self.nibble, None
            return out
        byte = self.uint()
        self.nibble = byte & 0x0F
        return byte >> 4


class Decoder:
    def __init__(self, data: bytes):
        self.r, self.warnings, self.version, self.depth = Reader(data), [], 0, 0
        self.makers = {1: self.line, 2: self.char, 3: self.template, 4: self.pile, 5: self.matrix}
        self.skippers = {
            7: self.ruler, 8: lambda: (self.r.packed(), self.r.uint()), 9: self.size, **dict.fromkeys(range(10, 15), lambda: None),
            15: self.r.packed, 16: self.color, 17: lambda: (self.r.packed(), self.r.text()), 18: self.preferences, 19: self.r.text,
        }

    def warn(self, kind: str, message: str, at: int, hex: str | None = None, **extra) -> None:
        self.warnings.append({"type": kind, "message": message, "position": at, "hex": hex, "extra": {k: str(v) for k, v in extra.items()}})

    def decode(self) -> tuple[dict, list[Node]]:
        header = {"version": self.r.uint()}
        self.version = header["version"]
        if self.version >= 3 and self.r.left >= 5:
            for name in ("platform", "product", "product_version", "product_subversion"):
                header[name] = self.r.uint()
            header["application_key"] = self.r.text()
            if self.r.left:
                header["equation_options"] = self.r.uint()
        return header, self.objects(outermost=True)

    # --- records -----------------------------------------------------------------------------------------------------

    def tag(self) -> tuple[int, int | None, int]:
        """Type, options if the tag holds them, position.  Older versions share one byte between both."""
        at, raw = self.r.at, self.r.uint()
        return (raw, None, at) if self.version >= 5 or not raw else (raw & 0x0F, raw & 0xF0, at)

    def options(self, given: int | None) -> int:
        got = given if given is not None else self.r.uint() if self.version >= 5 else 0
        if got & NUDGED:
            if (self.r.uint(), self.r.uint()) == (0x80, 0x80):
                self.r.uint(2), self.r.uint(2)
        return got

    def objects(self, outermost: bool = False) -> list[Node]:
        self.depth += 1
        if self.depth > MOST_DEPTH:
            raise Truncated("records are nested too deeply")
        out: list[Node] = []
        for _ in range(MOST_RECORDS):
            if not self.r.left:
                break
            kind, given, at = self.tag()
            if kind == 0:
                break
            try:
                node = self.accent(given, at) if kind == 6 else self.record(kind, given, at)
            except Truncated as broken:
                self.warn("malformed-input", str(broken), at, hexed(kind))
                if outermost:
                    break
                raise
            if node:
                out.append(node)
        self.depth -= 1
        return out

    def record(self, kind: int, given: int | None, at: int) -> Node | None:
        if kind in self.makers:
            return self.makers[kind](self.options(given), at)
        if kind in self.skippers:
            self.skippers[kind]()
        elif kind >= 100:
            length = self.r.packed()
            self.r.skip(min(length, self.r.left))
            self.warn("unknown-record", "Skipped future MTEF record", at, hexed(kind), length=length)
        else:
            self.warn("unknown-record", "Unknown MTEF record; stopping current object list to avoid desynchronization", at, hexed(kind))
        return None

    def line(self, options: int, at: int) -> Node:
        if options & LINE_SPACE:
            self.r.uint(2)
        if options & RULED:
            self.ruler()
        return Node("row", at, [] if options & EMPTY_LINE else attached(self.objects()))

    def char(self, options: int, at: int) -> Node:
        self.r.uint()  # typeface
        node = Node("text", at, text="?")
        if not options & NO_CODE:
            node.code = self.r.uint(2)
            found = shown(node.code)
            if found is None:
                node.unknown = True
                self.warn("unknown-char", "Unknown MTEF character; emitted ? fallback", at, hexed(node.code, 4))
            else:
                node.text = found
        if options & (WIDE_8 | WIDE_16):
            place = self.r.uint(1 if options & WIDE_8 else 2)
            if node.code is None and 0x20 <= place <= 0x7E:
                node.text = chr(place)
        accents = self.char_accents() if options & EMBELLISHED else []
        if accents and all(a in ACCENTS and ACCENTS[a][0] for a in accents):
            return replace(node, text=node.text + "".join(ACCENTS[a][1] for a in accents))
        for a in accents:
            node = Node("accent", at, [node], code=a)
        return node

    def char_accents(self) -> list[int]:
        out: list[int] = []
        for _ in range(MOST_ACCENTS):
            if not self.r.left:
                break
            kind, given, at = self.tag()
            if kind == 0:
                break
            if kind != 6:
                self.r.at = at
                break
            self.options(given)
            out.append(self.r.uint())
            self.objects()
        return out

    def template(self, options: int, at: int) -> Node:
        selector, first = self.r.uint(), self.r.uint()
        variation = (first & 0x7F) | (self.r.uint() << 8 if first & 0x80 else 0)
        self.r.uint()  # options of the template itself
        kids = self.objects()
        if selector >= len(SELECTORS):
            self.warn("unknown-template", "Unknown MTEF template selector", at, hexed(selector))
        return Node("template", at, kids, selector=selector, variation=variation)

    def pile(self, options: int, at: int) -> Node:
        self.r.skip(2)
        if options & RULED:
            self.ruler()
        return Node("pile", at, self.objects())

    def matrix(self, options: int, at: int) -> Node:
        self.r.skip(3)
        rows, cols = self.r.uint(), self.r.uint()
        self.r.skip(-(-(rows + 1) // 4))
        self.r.skip(-(-(cols + 1) // 4))
        return Node("matrix", at, self.objects(), rows=rows, cols=cols)

    def accent(self, given: int | None, at: int) -> Node:
        """A record of its own: it decorates what it holds, or else what follows within a few records."""
        self.options(given)
        code = self.r.uint()
        inner = self.objects()
        base = inner[0] if inner else None
        for _ in range(0 if inner else MOST_HOPS):
            kind, own, where = self.tag()
            if kind == 0:
                break
            if base := decorated(self.record(kind, own, where)):
                break
        if base:
            return Node("accent", at, [base], code=code)
        tried = "lookbehind-empty,lookahead,nested-exhausted"
        self.warn("embell-orphan", "EMBELL had no inner base; lookahead/nested recovery failed", at, decoration_hex=hexed(code), attempts=tried)
        self.warn("embell-result-trivial", "EMBELL recovery produced only a standalone fallback atom", at, decoration_hex=hexed(code))
        prime = code in ACCENTS and ACCENTS[code][0]
        return Node("text", at, text=ACCENTS[code][1] if prime else "?", unknown=not prime)

    # --- records without a node ----------------------------------------------------------------------------------------

    def ruler(self) -> None:
        self.r.skip(3 * self.r.uint())

    def size(self) -> None:
        kind = self.r.uint()
        self.r.skip({101: 2, 100: 3}.get(kind, 1))

    def color(self) -> None:
        options = self.r.uint()
        self.r.skip(8 if options & 1 else 6)
        if options & 4:
            self.r.text()

    def preferences(self) -> None:
        self.r.uint()
        for _ in range(2):
            for _ in range(self.r.uint()):
                self.r.half()
                while self.r.left and self.r.half() != 0x0F:
                    pass
        for _ in range(self.r.uint()):
            if self.r.uint():
                self.r.uint()


def decorated(node: Node | None) -> Node | None:
    """What an accent before ``node`` decorates: the only child of a row, a row of several, the first such cell of a matrix."""
    if node is None or node.kind not in ("row", "matrix"):
        return node
    if node.kind == "row":
        return None if not node.kids else node.kids[0] if len(node.kids) == 1 else node
    return next((found for cell in node.kids if (found := decorated(cell))), None)


def blank(node: Node | None) -> bool:
    if node is None:
        return True
    if node.kind in ("row", "pile"):
        return all(map(blank, node.kids))
    return node.kind == "text" and not node.text.strip()


def attached(nodes: list[Node]) -> list[Node]:
    """Scripts that follow their base as templates of their own get it as their first slot; a sub- and a superscript become one."""
    out: list[Node] = []
    for node in nodes:
        joined = joined_script(out[-1], node) if out and node.kind == "template" else None
        if joined:
            out[-1] = joined
        else:
            out.append(node)
    return out


def joined_script(base: Node, script: Node) -> Node | None:
    able = base.kind in ("template", "accent", "matrix") or (base.kind == "text" and base.text.strip() and base.text.strip() not in OPERATORS)
    if not able or not script.kids:
        return None
    first, second = script.kids[0], script.kids[1] if len(script.kids) > 1 else None
    pair = base.kids[:2] if base.kind == "template" and len(base.kids) >= 2 else None
    if script.selector == SUB and second and blank(second):
        if pair and base.selector == SUP:
            return replace(script, selector=SUBSUP, kids=[pair[0], first, pair[1]])
        return replace(script, kids=[base, first])
    if script.selector == SUP and second and blank(first):
        if pair and base.selector == SUB:
            return replace(script, selector=SUBSUP, kids=[*pair, second])
        return replace(script, kids=[base, second])
    if script.selector == SUBSUP and len(script.kids) == 2:
        return replace(script, kids=[base, first, second])
    return None
