"""Office markup of formulas to LaTeX and MathML: one walk, two dialects."""

from __future__ import annotations

import re
from xml.etree import ElementTree

from lectern.formulas.render import escaped

M = "{http://schemas.openxmlformats.org/officeDocument/2006/math}"

# Characters of runs with a LaTeX command.
COMMANDS = {
    "⨂": "\\otimes", "⊗": "\\otimes", "⨁": "\\oplus", "⊕": "\\oplus", "∑": "\\Sigma", "∏": "\\Pi", "∙": "\\cdot", "•": "\\cdot", "·": "\\cdot", "∞": "\\infty",
    "∈": "\\in", "∉": "\\notin", "⊂": "\\subset", "⊃": "\\supset", "∀": "\\forall", "∃": "\\exists", "≤": "\\leq", "≥": "\\geq", "≠": "\\neq", "≈": "\\approx",
    "→": "\\to", "←": "\\leftarrow", "↔": "\\leftrightarrow", "≺": "\\prec", "≻": "\\succ", "∂": "\\partial", "∇": "\\nabla", "…": "\\ldots", "⋯": "\\cdots",
}
# Runs that are set apart or change their form when they stand alone outside scripts.
ALONE = {"=": " = ", "+": " + ", "-": " - ", "−": " - ", "[": "\\left[", "]": "\\right]"}
ACCENTS = {"̇": "\\dot", "˙": "\\dot", "̈": "\\ddot", "̄": "\\bar", "¯": "\\bar", "⃗": "\\vec", "→": "\\vec", "̃": "\\tilde", "~": "\\tilde", "̂": "\\hat", "^": "\\hat"}
BIG = {"∑": "\\sum", "Σ": "\\sum", "∏": "\\prod", "Π": "\\prod", "∫": "\\int", "∬": "\\iint"}
LEFT = {"{": "\\{", "[": "[", "|": "|", "‖": "\\|", "(": "("}
RIGHT = {"}": "\\}", "]": "]", "|": "|", "‖": "\\|", ")": ")"}
MATRICES = {"[": "bmatrix", "(": "pmatrix", "{": "Bmatrix", "|": "vmatrix", "‖": "Vmatrix", "∥": "Vmatrix"}
WRAPPED = {"[]": "bmatrix", "()": "pmatrix", "{}": "Bmatrix", "||": "vmatrix", "‖‖": "Vmatrix"}
FUNCTIONS = "sin cos tan log ln exp lim max min sup inf det dim".split()
RELATIONS = re.compile(r"\\(?:in|notin|subset|supset|leq|geq|neq|approx)\b")
TIGHT = ("sup", "sub", "deg", "num", "den")
OPERATORS = frozenset("=+-−∙•·∞∈∉⊂⊃∀∃≤≥≠≈→←↔≺≻∂∇…⋯,:;()[]{}|‖/\\")
SMALLER = {"∙": "⋅", "•": "⋅", "⨂": "⊗", "⨁": "⊕"}


def flat(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip()


def name(el) -> str:
    return el.tag.rpartition("}")[2]


def child(el, tag: str):
    return el.find(M + tag) if el is not None else None


def value(el, *path: str) -> str | None:
    """The value attribute at the end of a path of properties."""
    for tag in path:
        el = child(el, tag)
    return None if el is None else el.get(f"{M}val")


def rows_aligned(content: str) -> str:
    """Rows of a system, each marked before its first equality, else before its first relation."""
    return " \\\\ ".join(row for line in re.split(r"\s*\\\\\s*", content) if (row := aligned(line)))


def tidy_row(line: str) -> str:
    return re.sub(r"\s+([,.;:])", r"\1", flat(line)).strip()


def aligned(line: str) -> str:
    row = tidy_row(line)
    if not row or "&=" in row or re.search("&" + RELATIONS.pattern, row):
        return row
    if "=" in row:
        return row.replace("=", "&=", 1)
    m = RELATIONS.search(row)
    return f"{row[: m.start()].rstrip()} &{row[m.start() :]}" if m else row


def system(content: str) -> str:
    return f"\\left\\{{\\begin{{aligned}} {rows_aligned(content)} \\end{{aligned}}\\right."


def left_array(content: str) -> str:
    rows = (tidy_row(line) for line in re.split(r"\s*\\\\\s*", content))
    return f"\\begin{{array}}{{l}} {' \\\\ '.join(filter(None, rows))} \\end{{array}}"


def plain_index(el) -> str | None:
    """The letters of a script made of plain runs only, if they are a word: Cyrillic, or two Latin letters at least."""
    if el is None or any(name(x) not in ("sub", "sup", "e", "r", "t", "rPr") for x in el.iter()):
        return None
    text = re.sub(r"\s+", "", "".join(el.itertext()))
    if not text or not all(c.isalpha() for c in text):
        return None
    return text if re.search(r"[\u0400-\u052f]", text) or re.fullmatch(r"[A-Za-z]{2,}", text) else None


class Dialect:
    """Walks the tree; elements without a method of their own are their children, properties are nothing."""

    def __init__(self, root):
        self.parents = {kid: el for el in root.iter() for kid in el}

    def node(self, el) -> str:
        tag = name(el)
        if tag.endswith("Pr") or tag in ("mcs",):
            return ""
        return getattr(self, f"on_{tag}", self.kids)(el)

    def kids(self, el) -> str:
        return "" if el is None else "".join(map(self.node, el))

    def fences(self, el) -> tuple[str, str]:
        left, right = value(el, "dPr", "begChr"), value(el, "dPr", "endChr")
        return "(" if left is None else left, ")" if right is None else right

    def run_text(self, el) -> str:
        return "".join("".join(t.itertext()) for t in el.iter(M + "t"))


class Latex(Dialect):
    def part(self, el, tag: str) -> str:
        return self.kids(child(el, tag))

    def script(self, el, tag: str) -> str:
        word = plain_index(child(el, tag))
        return f"\\text{{{word}}}" if word else self.part(el, tag)

    def on_r(self, el) -> str:
        first = next(el.iter(M + "t"), None)
        text = "".join(f"{COMMANDS[c]} " if c in COMMANDS else c for c in (first.text or "" if first is not None else ""))
        up = self.parents.get(el)
        while up is not None and name(up) not in (*TIGHT, "oMath"):
            up = self.parents.get(up)
        return text if up is not None and name(up) in TIGHT else ALONE.get(text, text)

    def on_t(self, el) -> str:
        return "".join(el.itertext())

    def on_f(self, el) -> str:
        num, den = self.part(el, "num").strip(), self.part(el, "den").strip()
        if value(el, "fPr", "type") == "lin":
            return f"{{{num}}}/{{{den}}} "
        if num == "d" and den.startswith("dt"):
            return "\\tfrac{d}{dt}\\,"
        small = len(num) <= 2 and len(den) <= 5 and "\\frac" not in num + den
        return f"\\{'t' if small else 'd'}frac{{{num}}}{{{den}}}"

    def on_sSub(self, el) -> str:
        return f"{self.part(el, 'e')}_{{{self.script(el, 'sub')}}}"

    def on_sSup(self, el) -> str:
        return f"{self.part(el, 'e')}^{{{self.script(el, 'sup')}}}"

    def on_sSubSup(self, el) -> str:
        return f"{self.part(el, 'e')}_{{{self.script(el, 'sub')}}}^{{{self.script(el, 'sup')}}}"

    def on_rad(self, el) -> str:
        degree = self.part(el, "deg").strip()
        return f"\\sqrt{f'[{degree}]' if degree else ''}{{{self.part(el, 'e')}}}"

    def on_d(self, el) -> str:
        left, right = self.fences(el)
        parts = [self.kids(e) for e in el.findall(M + "e")]
        if len(parts) == 1:
            if left == "{" and right in ("", " ", ")"):
                if "\\left\\{\\begin{aligned}" in parts[0]:
                    return parts[0]
                if "\\\\" in parts[0]:
                    return system(parts[0])
            env = WRAPPED.get(left + right)
            if env and re.fullmatch(rf"(?s)\\begin\{{{env}\}}.*\\end\{{{env}\}}", parts[0].strip()):
                return parts[0].strip()
        body = ", ".join(parts)
        if left == "{" and right == ")":
            return f"\\left\\{{ {body} \\right."
        if (left, right) == ("(", ")") and len(parts) > 1:
            return f"({parts[0].strip()}){''.join(parts[1:])}"
        tall = any(mark in body for mark in ("\\frac{", "\\begin{", "\\sum", "\\int", "\\prod"))
        opened, closed = LEFT.get(left, "("), RIGHT.get(right, ")")
        if right in ("", " "):
            return f"\\left{opened} {body} \\right." if tall else f"{opened}{body}"
        return f"\\left{opened} {body} \\right{closed}" if tall else f"{opened}{body}{closed}"

    def on_nary(self, el) -> str:
        out = BIG.get(value(el, "naryPr", "chr") or "", "\\int")
        for tag, mark in (("sub", "_"), ("sup", "^")):
            if child(el, tag) is not None:
                out += f"{mark}{{{self.part(el, tag)}}}"
        return f"{out} {self.part(el, 'e')}"

    def on_acc(self, el) -> str:
        return f"{ACCENTS.get(value(el, 'accPr', 'chr') or '', '\\hat')}{{{self.part(el, 'e')}}}"

    def on_m(self, el) -> str:
        columns = int(next((v for c in el.iter(M + "count") if (v := c.get(f"{M}val"))), "1"))
        rows = " \\\\ ".join(" & ".join(self.kids(e) for e in row.findall(M + "e")) for row in el.findall(M + "mr"))
        env, up = "pmatrix", self.parents.get(el)
        fence = self.parents.get(up) if up is not None and name(up) == "e" else None
        if fence is not None and name(fence) == "d":
            left, right = self.fences(fence)
            if left == "{" and right in ("", " ") and columns == 1:
                return system(rows)
            env = MATRICES.get(left, env)
        return f"\\begin{{{env}}} {rows} \\end{{{env}}}"

    def on_eqArr(self, el) -> str:
        return " \\\\ ".join(self.kids(e) for e in el.findall(M + "e"))

    def on_bar(self, el) -> str:
        return f"\\overline{{{self.part(el, 'e')}}}"

    def on_box(self, el) -> str:
        return self.part(el, "e")

    on_groupChr = on_box

    def on_func(self, el) -> str:
        word, body = self.part(el, "fName").strip(), self.part(el, "e")
        if any(f"\\{known}" in word for known in ("lim", "max", "min")):
            return f"{word} {body}"
        return f"\\{word} {body}" if word in FUNCTIONS else f"\\operatorname{{{word}}} {body}"

    def on_limLow(self, el) -> str:
        base, low = self.part(el, "e").strip(), self.part(el, "lim").strip()
        return f"{'\\lim' if base == 'lim' else base}_{{{low}}}"

    def on_limUpp(self, el) -> str:
        return f"{self.part(el, 'e')}^{{{self.part(el, 'lim')}}}"


def row(content: str) -> str:
    body = flat(content)
    return body if re.match(r"<mrow[\s>]", body) and body.endswith("</mrow>") else f"<mrow>{body}</mrow>"


def text_to_mathml(text: str) -> str:
    """Characters of one class run together, operators stand alone; brackets of plain text do not stretch."""
    out, run, kind = [], "", ""

    def done() -> None:
        nonlocal run
        if run:
            out.append(f"<{kind}>{escaped(run)}</{kind}>")
        run = ""

    for c in text.strip():
        c = SMALLER.get(c, c)
        now = "" if c.isspace() else "mn" if c.isnumeric() else "mo" if c in OPERATORS else "mi" if c.isalpha() else "mtext"
        if now != kind or now in ("", "mo"):
            done()
        kind = now
        if now == "mo":
            out.append(f'<mo stretchy="false">{c}</mo>' if c in "()[]{}" else f"<mo>{escaped(c)}</mo>")
        elif now:
            run += c
    done()
    return "".join(out)


class MathML(Dialect):
    def part(self, el, tag: str) -> str:
        return row(self.kids(child(el, tag)))

    def script(self, el, tag: str) -> str:
        word = plain_index(child(el, tag))
        return f"<mtext>{escaped(word)}</mtext>" if word else self.part(el, tag)

    def rowed(self, el) -> str:
        return row(self.kids(el))

    on_oMath = on_e = on_num = on_den = on_sub = on_sup = on_deg = on_lim = on_fName = rowed

    def on_r(self, el) -> str:
        return text_to_mathml(self.run_text(el))

    def on_t(self, el) -> str:
        return text_to_mathml("".join(el.itertext()))

    def on_f(self, el) -> str:
        return f"<mfrac>{self.part(el, 'num')}{self.part(el, 'den')}</mfrac>"

    def on_sSub(self, el) -> str:
        return f"<msub>{self.part(el, 'e')}{self.script(el, 'sub')}</msub>"

    def on_sSup(self, el) -> str:
        return f"<msup>{self.part(el, 'e')}{self.script(el, 'sup')}</msup>"

    def on_sSubSup(self, el) -> str:
        return f"<msubsup>{self.part(el, 'e')}{self.script(el, 'sub')}{self.script(el, 'sup')}</msubsup>"

    def on_rad(self, el) -> str:
        degree = flat(self.kids(child(el, "deg")))
        return f"<mroot>{self.part(el, 'e')}{row(degree)}</mroot>" if degree else f"<msqrt>{self.part(el, 'e')}</msqrt>"

    def on_d(self, el) -> str:
        left, right = self.fences(el)
        parts = [self.kids(e) for e in el.findall(M + "e")]
        if left == "{" and right in ("", " ") and len(parts) == 1 and "<mtable" in parts[0]:
            table = parts[0] if "displaystyle" in parts[0] else parts[0].replace("<mtable", '<mtable displaystyle="true"', 1)
            return f'<mfenced open="{{" close="" separators="">{table}</mfenced>'
        fence = lambda char, form: f'<mo fence="true" form="{form}">{escaped(char)}</mo>' if char.strip() else ""
        inner = parts[:1] if (left, right) == ("(", ")") else parts
        body = "<mo>,</mo>".join(map(row, inner))
        return row(f"{fence(left, 'prefix')}{body}{fence(right, 'postfix')}") + "".join(parts[len(inner) :])

    def on_nary(self, el) -> str:
        sign = value(el, "naryPr", "chr") or "∫"
        low, up = (self.part(el, t) if child(el, t) is not None else "" for t in ("sub", "sup"))
        stacked = sign in "∑Σ∏Π"
        tag = {(True, True): "munderover" if stacked else "msubsup", (True, False): "munder" if stacked else "msub", (False, True): "mover" if stacked else "msup"}.get((bool(low), bool(up)))
        op = f"<mo>{escaped(sign)}</mo>"
        return row((f"<{tag}>{op}{low}{up}</{tag}>" if tag else op) + self.part(el, "e"))

    def on_acc(self, el) -> str:
        return f'<mover accent="true">{self.part(el, "e")}<mo>{escaped(value(el, "accPr", "chr") or "^")}</mo></mover>'

    def on_m(self, el) -> str:
        rows = "".join(f"<mtr>{''.join(f'<mtd>{row(self.kids(e))}</mtd>' for e in r.findall(M + 'e'))}</mtr>" for r in el.findall(M + "mr"))
        return f"<mtable>{rows}</mtable>"

    def on_eqArr(self, el) -> str:
        return f"<mtable>{''.join(f'<mtr><mtd>{row(self.kids(e))}</mtd></mtr>' for e in el.findall(M + 'e'))}</mtable>"

    def on_bar(self, el) -> str:
        return f'<mover accent="true">{self.part(el, "e")}<mo>¯</mo></mover>'

    def on_box(self, el) -> str:
        return self.part(el, "e")

    on_groupChr = on_box

    def on_func(self, el) -> str:
        return row(self.kids(child(el, "fName")) + self.part(el, "e"))

    def on_limLow(self, el) -> str:
        return f"<munder>{self.part(el, 'e')}{self.part(el, 'lim')}</munder>"

    def on_limUpp(self, el) -> str:
        return f"<mover>{self.part(el, 'e')}{self.part(el, 'lim')}</mover>"


def to_latex(el, display: bool = False) -> str:
    latex = flat(re.sub(r"(\\[A-Za-z]+)\s+([,.;:!?])", r"\1\2", Latex(el).node(el).strip()))
    return re.sub(r"\\tfrac\b", r"\\dfrac", latex) if display else latex


def to_mathml(el, display: bool = False, wrap: bool = True) -> str:
    body = flat(MathML(el).node(el))
    if display:
        body = re.sub(r"<mfrac(?![^>]*displaystyle=)", '<mfrac displaystyle="true"', body)
    return f'<math xmlns="http://www.w3.org/1998/Math/MathML"{" display=\"block\"" if display else ""}>{row(body)}</math>' if wrap else body


def parse(xml: str):
    """The first formula of a fragment; the usual prefixes need not be declared."""
    el = ElementTree.fromstring(xml if "xmlns:m=" in xml else f'<root xmlns:m="{M[1:-1]}" xmlns:w="w">{xml}</root>')
    return el if name(el) == "oMath" else next(el.iter(M + "oMath"), el)
