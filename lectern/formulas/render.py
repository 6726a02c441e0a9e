"""MathML and LaTeX of decoded equations, driven by tables of templates."""

from __future__ import annotations

import re

from lectern.formulas.mtef import SUB, SUBSUP, SUP, Node, hexed
from lectern.formulas.symbols import ACCENTS, COMMANDS, FUNCTIONS, LATEX, OPERATORS, SELECTORS, is_function, is_identifier, is_number

# What templates are in MathML and in LaTeX, by selector.
FENCES = {0: ("〈", "〉"), 1: "()", 2: "{}", 3: "[]", 4: "||", 5: "‖‖"}
LATEX_FENCES = {0: ("\\langle ", " ", "\\rangle"), 1: ("(", "", ")"), 2: ("\\{", "", "\\}"), 3: ("[", "", "]"), 4: ("|", "", "|")}
BIG = {15: ("∫", "\\int"), 16: ("∑", "\\sum"), 17: ("∏", "\\prod"), 19: ("∪", "\\bigcup"), 20: ("∩", "\\bigcap"), 21: ("∫", "\\int"), 22: ("∑", "\\sum")}
MARKS = {12: ("munder", "_", "\\underline"), 13: ("mover", "¯", "\\overline"), 31: ("mover", "→", "\\vec"), 32: ("mover", "~", "\\tilde"), 33: ("mover", "^", "\\hat")}
BRACES = {True: ("mover", "⏞", "\\overbrace"), False: ("munder", "⏟", "\\underbrace")}
LOWER, UPPER = 0x10, 0x20
PRIMES = {"'": "&#x2032;", "’": "&#x2032;", "′": "&#x2032;", "″": "&#x2033;", "‴": "&#x2034;"}

MEANT = re.compile(r"<(mi|mn|mo|mtext|mfrac|msqrt|mroot|msub|msup|msubsup|mtable)\b", re.I)
ONLY_SPACE = re.compile(r"<mrow\s*/>|<mrow>\s*</mrow>|<mspace\b[^>]*/>|<mrow>\s*<mspace\b[^>]*/>\s*</mrow>", re.I)


def escaped(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")


def meant(markup: str) -> bool:
    """Has a slot anything but space?"""
    flat = re.sub(r"\s+", " ", markup).strip()
    return bool(flat) and not ONLY_SPACE.fullmatch(flat) and bool(MEANT.search(flat))


def child(node: Node, i: int) -> Node | None:
    return node.kids[i] if i < len(node.kids) else None


def alone(node: Node) -> Node:
    return node.kids[0] if node.kind == "row" and len(node.kids) == 1 else node


class MathML:
    def __init__(self, warnings: list[dict]):
        self.warnings = warnings

    def document(self, nodes: list[Node]) -> str:
        return f'<math xmlns="http://www.w3.org/1998/Math/MathML">{self.row(nodes)}</math>'

    def row(self, nodes: list[Node]) -> str:
        return f"<mrow>{''.join(map(self.node, with_functions(nodes)))}</mrow>"

    def slot(self, node: Node, i: int) -> str:
        kid = child(node, i)
        return self.node(kid) if kid else "<mrow/>"

    def node(self, node: Node) -> str:
        if node.kind in ("row", "pile"):
            return self.row(node.kids)
        if node.kind == "text":
            return self.text(node)
        if node.kind == "matrix":
            cells = [[f"<mtd>{self.slot(node, r * node.cols + c)}</mtd>" for c in range(node.cols)] for r in range(node.rows)]
            return f"<mtable>{''.join(f'<mtr>{"".join(row)}</mtr>' for row in cells)}</mtable>"
        return self.accent(node) if node.kind == "accent" else self.template(node)

    def text(self, node: Node) -> str:
        text = node.text
        if node.unknown:
            return "<mtext>?</mtext>"
        if text in PRIMES:
            return f"<mo>{PRIMES[text]}</mo>"
        if not text.strip():
            return '<mspace width="0.25em"/>'
        kinds = ((is_function, "mi"), (is_number, "mn"), (is_identifier, "mi"), (OPERATORS.__contains__, "mo"))
        tag = next((tag for test, tag in kinds if test(text)), "mtext")
        return f"<{tag}>{escaped(text)}</{tag}>"

    def scripts(self, base: str, sub: str, sup: str) -> str:
        sub, sup = (x if meant(x) else "" for x in (sub, sup))
        tag = {(True, True): "msubsup", (True, False): "msub", (False, True): "msup"}.get((bool(sub), bool(sup)))
        return f"<{tag}>{base}{sub}{sup}</{tag}>" if tag else base

    def accent(self, node: Node) -> str:
        inner = alone(node.kids[0])
        if node.code not in ACCENTS:
            self.warnings.append({"type": "embell-decoration-unknown", "message": "Unknown EMBELL decoration; emitted visible fallback accent", "position": node.at, "hex": None, "extra": {"decoration_hex": hexed(node.code)}})
            return f"<mover>{self.node(inner)}<mtext>?</mtext></mover>"
        prime, char, _ = ACCENTS[node.code]
        mark = f"<mo>{PRIMES.get(char) if prime else escaped(char)}</mo>"
        if not prime:
            return f'<mover accent="true">{self.node(inner)}{mark}</mover>'
        if inner.kind == "template" and inner.selector in (SUB, SUP):
            base, script = self.slot(inner, 0), self.slot(inner, 1)
            if inner.selector == SUB:
                return self.scripts(base, script, mark)
            base = f"<mrow>{base}{mark}</mrow>"
            return self.scripts(base, "", script)
        return f"<msup>{self.node(inner)}{mark}</msup>"

    def marked(self, body: str, tag: str, mark: str) -> str:
        return f"<{tag}>{body}<mo>{mark}</mo></{tag}>" if meant(body) else f"<mo>{mark}</mo>"

    def template(self, node: Node) -> str:
        s, slot = node.selector, lambda i: self.slot(node, i)
        if s in FENCES:
            left, right = FENCES[s]
            return f"<mrow><mo>{escaped(left)}</mo>{slot(0)}<mo>{escaped(right)}</mo></mrow>"
        if s == 10:
            return f"<mroot>{slot(1)}{slot(0)}</mroot>" if node.variation == 1 else f"<msqrt>{slot(0)}</msqrt>"
        if s in (11, 26):
            return f"<mfrac>{slot(0)}{slot(1)}</mfrac>"
        if s in MARKS:
            return self.marked(slot(0), *MARKS[s][:2])
        if s == 24:
            return self.marked(slot(0), *BRACES[bool(node.variation & 1)][:2])
        if s in BIG:
            return self.big(node)
        if s == 23:
            low = slot(0)
            return f"<munder><mi>lim</mi>{low}</munder>" if meant(low) else "<mi>lim</mi>"
        if s in (SUB, SUP, SUBSUP):
            return self.scripts(slot(0), slot(1) if s != SUP else "", slot(1) if s == SUP else slot(2) if s == SUBSUP else "")
        self.warnings.append({"type": "unknown-template", "message": f"Rendered unsupported template {selector_name(s)} as grouped children", "position": node.at, "hex": hexed(s), "extra": {}})
        return f"<mrow>{''.join(map(self.node, node.kids))}</mrow>"

    def big(self, node: Node) -> str:
        op, at = f"<mo>{BIG[node.selector][0]}</mo>", iter(range(3))
        low = self.slot(node, next(at)) if node.variation & LOWER else ""
        up = self.slot(node, next(at)) if node.variation & UPPER else ""
        rest = self.slot(node, next(at))
        low, up = (x if meant(x) else "" for x in (low, up))
        tag = {(True, True): "munderover", (True, False): "munder", (False, True): "mover"}.get((bool(low), bool(up)))
        return f"<{tag}>{op}{low}{up}</{tag}>{rest}" if tag else f"<mrow>{op}{rest}</mrow>"


def selector_name(selector: int) -> str:
    return SELECTORS[selector] if selector < len(SELECTORS) else "unknown"


def with_functions(nodes: list[Node]) -> list[Node]:
    """Runs of single letters that spell a function become one token; else the first letter stays and the rest is tried."""
    out, i = [], 0
    while i < len(nodes):
        end = i
        while end < len(nodes) and nodes[end].kind == "text" and len(t := nodes[end].text) == 1 and t.isascii() and t.isalpha():
            end += 1
        word = "".join(n.text for n in nodes[i:end])
        if len(word) >= 2 and word.lower() in FUNCTIONS:
            out.append(Node("text", nodes[i].at, text=word))
            i = end
        else:
            out.append(nodes[i])
            i += 1
    return out


class Latex:
    def __init__(self, warnings: list[dict]):
        self.warnings = warnings

    def document(self, nodes: list[Node]) -> str:
        return spaced(flat(self.all(nodes)))

    def all(self, nodes: list[Node]) -> str:
        return "".join(map(self.node, nodes))

    def slot(self, node: Node, i: int) -> str:
        kid = child(node, i)
        return self.node(kid) if kid else ""

    def node(self, node: Node) -> str:
        if node.kind == "row":
            return self.all(node.kids)
        if node.kind == "pile":
            return " \\\\ ".join(map(self.node, node.kids))
        if node.kind == "text":
            if node.unknown:
                return "?"
            own = LATEX.get(node.code) if node.code is not None else None
            return own if own is not None else {"{": "\\{", "}": "\\}", "\\": "\\backslash"}.get(node.text, node.text)
        if node.kind == "matrix":
            rows = (" & ".join(self.slot(node, r * node.cols + c) for c in range(node.cols)) for r in range(node.rows))
            return f"\\begin{{matrix}}{' \\\\ '.join(rows)}\\end{{matrix}}"
        return self.accent(node) if node.kind == "accent" else self.template(node)

    def accent(self, node: Node) -> str:
        inner = alone(node.kids[0])
        if node.code not in ACCENTS:
            self.warnings.append({"type": "embell-decoration-unknown", "message": "Unknown EMBELL decoration; emitted visible placeholder in LaTeX", "position": node.at, "hex": None, "extra": {"decoration_hex": hexed(node.code)}})
            return f"\\overset{{?}}{{{self.node(inner)}}}"
        prime, _, command = ACCENTS[node.code]
        if not prime:
            return f"{command}{{{self.node(inner)}}}"
        if inner.kind == "template" and inner.selector == SUB:
            return scripted(self.slot(inner, 0), self.slot(inner, 1), command)
        if inner.kind == "template" and inner.selector == SUP:
            base, sup = f"{{{self.slot(inner, 0)}^{{{command}}}}}", self.slot(inner, 1)
            return f"{base}^{{{sup}}}" if sup else base
        return f"{self.node(inner)}^{{{command}}}"

    def template(self, node: Node) -> str:
        s, slot = node.selector, lambda i: self.slot(node, i)
        if s in LATEX_FENCES:
            left, gap, right = LATEX_FENCES[s]
            return f"\\left{left}{slot(0)}{gap}\\right{right}"
        if s == 10:
            return f"\\sqrt[{slot(0)}]{{{slot(1)}}}" if node.variation == 1 else f"\\sqrt{{{slot(0)}}}"
        if s == 11:
            return f"\\frac{{{slot(0)}}}{{{slot(1)}}}"
        if s in MARKS:
            return f"{MARKS[s][2]}{{{slot(0)}}}"
        if s == 24:
            return f"{BRACES[bool(node.variation & 1)][2]}{{{slot(0)}}}"
        if s in BIG:
            at = iter(range(3))
            low = slot(next(at)) if node.variation & LOWER else ""
            up = slot(next(at)) if node.variation & UPPER else ""
            limits = (f"_{subscript(low)}" if low else "") + (f"^{{{up}}}" if up else "")
            return flat(f"{BIG[s][1]}{limits} {slot(next(at))}")
        if s == 23:
            return scripted("\\lim", slot(0), "")
        if s in (SUB, SUP, SUBSUP):
            return scripted(slot(0), slot(1) if s != SUP else "", slot(1) if s == SUP else slot(2) if s == SUBSUP else "")
        self.warnings.append({"type": "latex-best-effort", "message": f"LaTeX rendered unsupported template {selector_name(s)} by concatenating children", "position": node.at, "hex": hexed(s), "extra": {}})
        return self.all(node.kids)


def flat(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip()


def subscript(text: str, base: str = "") -> str:
    """Braces, unless they are there or the text is one Latin letter after a base that is no command."""
    bare = re.fullmatch(r"\{[^{}]*\}", text) or (not base.startswith("\\") and re.fullmatch(r"[a-zA-Z]", text))
    return text if bare else f"{{{text}}}"


def scripted(base: str, sub: str, sup: str) -> str:
    return base + (f"_{subscript(sub, base)}" if sub else "") + (f"^{{{sup}}}" if sup else "")


_NAMES = re.compile(r"\\([a-zA-Z]+)")


def known_command(letters: str) -> str:
    """The longest known command that ``letters`` begin with, or all of them."""
    return next((letters[:n] for n in range(len(letters), 0, -1) if letters[:n] in COMMANDS), letters)


def spaced(latex: str) -> str:
    """A blank between a command and a letter glued to it."""

    def apart(m: re.Match) -> str:
        name = known_command(m[1])
        return f"\\{name} {m[1][len(name):]}" if len(name) < len(m[1]) else m[0]

    return _NAMES.sub(apart, latex)


def validated(latex: str | None) -> list[str]:
    """What is wrong with a LaTeX string, in the order of the checks; nothing if it is valid."""
    s = (latex or "").strip()
    errors = []
    for pattern, error in (
        (r"_\{\}\s*_\{\}|\^\{\}\s*\^\{\}", "empty subscript/superscript pair"),
        (r"_\{\}(?:\s*_\{\})+", "repeated empty subscripts"),
        (r"\^\{\}(?:\s*\^\{\})+", "repeated empty superscripts"),
        (r"(?:^|[^\\])[a-zA-Z]_\{\}(?!\})", "empty subscript after letter"),
        (r"(?:^|[^\\])[a-zA-Z]\^\{\}(?!\})", "empty superscript after letter"),
    ):
        if re.search(pattern, s):
            errors.append(error)
    depth = 0
    for c in s:
        depth += (c == "{") - (c == "}")
        if depth < 0:
            errors.append("unbalanced closing brace")
            break
    if depth:
        errors.append("unbalanced braces")
    if len(re.findall(r"\\left(?![a-z])", s)) != len(re.findall(r"\\right(?![a-z])", s)):
        errors.append("\\left / \\right count mismatch")
    if any(len(known_command(m[1])) < len(m[1]) for m in _NAMES.finditer(s)):
        errors.append("command-no-space")
    return errors
