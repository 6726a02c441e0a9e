"""Symbols of binary equations: character codes, accents and template selectors."""

from __future__ import annotations


# LaTeX of Greek letters from U+0391 and U+03B1 on; capitals that look Latin are typed as such.
_CAPITALS = "A B \\Gamma \\Delta E Z H \\Theta I K \\Lambda M N \\Xi O \\Pi P - \\Sigma T \\Upsilon \\Phi X \\Psi \\Omega".split()
_SMALL = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi - pi rho varsigma sigma tau upsilon phi chi psi omega".split()

# LaTeX of the other characters with one of their own.
_OTHERS = {
    "\\": "\\backslash", "{": "\\{", "}": "\\}", "±": "\\pm", " ": " ", "×": "\\times", "÷": "\\div",
    "ϑ": "\\vartheta", "ϕ": "\\varphi", "ϖ": "\\varpi", "ϰ": "\\varkappa", "ϱ": "\\varrho",
    "…": "\\ldots", "′": "'", "″": "''", "←": "\\leftarrow", "→": "\\to", "⇒": "\\Rightarrow", "⇔": "\\Leftrightarrow",
    "∀": "\\forall", "∂": "\\partial", "∃": "\\exists", "∈": "\\in", "∉": "\\notin", "−": "-", "∙": "\\bullet", "√": "\\sqrt{}",
    "∞": "\\infty", "∩": "\\cap", "∪": "\\cup", "∫": "\\int", "≈": "\\approx", "≠": "\\ne", "≤": "\\le", "≥": "\\ge", "≫": "\\gg",
    "⊂": "\\subset", "⊆": "\\subseteq", "⋅": "\\cdot", "〈": "\\langle", "〉": "\\rangle",
}


def _latex_by_code() -> dict[int, str | None]:
    own: dict[int, str | None] = {ord(c): c for c in "()+,-./:;<=>[]|" if c}
    own |= {code: chr(code) for first, last in ("09", "AZ", "az") for code in range(ord(first), ord(last) + 1)}
    own |= {0x391 + i: name for i, name in enumerate(_CAPITALS) if name != "-"}
    own |= {0x3B1 + i: "o" if name == "-" else f"\\{name}" for i, name in enumerate(_SMALL)}
    return own | {ord(c): latex for c, latex in _OTHERS.items()} | {0x20: None}


#: LaTeX by character code; a code that is not here is unknown (but printable ASCII stands for itself).
LATEX = _latex_by_code()
#: What is shown for a code, where that is not the character itself.
SHOWN = {0xA0: " ", 0x2329: "〈", 0x232A: "〉"}

# Accents by code, as (prime?, character, LaTeX).
ACCENTS = {
    2: (False, "˙", "\\dot"), 3: (False, "¨", "\\ddot"), 4: (False, "⃛", "\\dddot"),
    5: (True, "′", "\\prime"), 6: (True, "″", "\\prime\\prime"), 8: (False, "~", "\\tilde"), 9: (False, "^", "\\hat"),
    11: (False, "→", "\\vec"), 17: (False, "¯", "\\bar"), 18: (True, "‴", "\\prime\\prime\\prime"),
}

# Names of template selectors, from 0 on.
SELECTORS = """tmANGLE tmPAREN tmBRACE tmBRACK tmBAR tmDBAR tmFLOOR tmCEILING tmOBRACK tmINTERVAL tmROOT tmFRACT tmUBAR tmOBAR
tmARROW tmINTEG tmSUM tmPROD tmCOPROD tmUNION tmINTER tmINTOP tmSUMOP tmLIM tmHBRACE tmHBRACK tmLDIV tmSUB tmSUP tmSUBSUP
tmDIRAC tmVEC tmTILDE tmHAT tmARC tmJSTATUS tmSTRIKE tmBOX""".split()

# Names set as one token, longest first where one begins another.
FUNCTIONS = "arcsin arccos arctan sinh cosh tanh sech csch coth sin cos tan cot sec csc log ln exp lim inf sup min max det dim arg".split()

# Single characters that are operators.
OPERATORS = frozenset("+-=<>()[]{}|,.;:/*±×·÷∫∑∏∪∩∀∃∈∉⊂⊆⇒⇔→←≤≥≠≈∞")

# LaTeX commands known besides those of the symbols.
_COMMANDS = """frac sqrt int sum prod lim left right begin end matrix aligned array overbrace underbrace underline overline hat tilde
vec prime langle rangle backslash cdot times div pm ldots cdots""".split()


def _command(latex: str | None) -> str:
    name = (latex or "")[1:].removesuffix("{}")
    return name if (latex or "").startswith("\\") and name.isalpha() else ""


COMMANDS = frozenset(_COMMANDS) | {name for latex in LATEX.values() if (name := _command(latex))}


def shown(code: int) -> str | None:
    """The character a code stands for; None if unknown."""
    if code in LATEX:
        return SHOWN.get(code, chr(code))
    return chr(code) if 0x20 <= code <= 0x7E else None


def is_identifier(text: str) -> bool:
    return len(text) == 1 and ("A" <= text <= "Z" or "a" <= text <= "z" or "Α" <= text <= "ω" or text in "ϑϕϰϱϖ")


def is_number(text: str) -> bool:
    return bool(text) and all(c in "0123456789.," for c in text)


def is_function(text: str) -> bool:
    return text.lower() in FUNCTIONS


