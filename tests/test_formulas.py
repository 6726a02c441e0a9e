import pytest
from helpers import accent, char, equation, line, matrix, template

from lectern.formulas import omml
from lectern.formulas.mtef import Decoder
from lectern.formulas.render import Latex, MathML, spaced, validated
from lectern.functions.udfs import decoded

X = line(char("x"))


def latex(*parts):
    d = Decoder(equation(*parts))
    _, nodes = d.decode()
    return Latex(d.warnings).document(nodes)


@pytest.mark.parametrize(
    "parts, expected",
    [
        ([X], "x"), ([line(char("x"), char("+"), char("y"))], "x+y"), ([line(char(0xE123))], "?"), ([line(b"\2\x24\0\x41")], "A"), ([b"\x64\2\xaa\xbb", X], "x"),
        ([line(template(11, 0, line(char("a")), line(char("b"))))], r"\frac{a}{b}"), ([line(template(28, 0, X, line(char("2"))))], "x^{2}"), ([line(template(27, 0, X, line(char("i"))))], "x_i"),
        ([line(template(29, 0, X, line(char("i")), line(char("2"))))], "x_i^{2}"), ([line(char(0x3C5), template(27, 0, line(char("i")), line()))], r"\upsilon_{i}"),
        ([line(char(0x3C5), template(27, 0, line(char("i")), line()), template(28, 0, line(), line(char("2"))))], r"\upsilon_{i}^{2}"), ([line(char(0x3C5), char("i"))], r"\upsilon i"),
        ([line(template(10, 0, X))], r"\sqrt{x}"), ([line(template(10, 1, line(char("3")), X))], r"\sqrt[3]{x}"),
        ([matrix(2, 2, *[line(char(c)) for c in "abcd"])], r"\begin{matrix}a & b \\ c & d\end{matrix}"), ([line(template(0, 3, X))], r"\left\langle x \right\rangle"),
        ([line(template(15, 0x30, line(char("0")), line(char("1")), X))], r"\int_{0}^{1} x"), ([line(template(13, 0, X))], r"\overline{x}"),
        ([accent(2), char("X")], r"\dot{X}"), ([accent(3), char(0x3BE)], r"\ddot{\xi}"), ([accent(99), char("x")], r"\overset{?}{x}"),
        ([line(bytes.fromhex("020500be0378"), accent(3), b"\0", char("="), char("X"))], r"\ddot{\xi}=X"),
        ([line(template(28, 0, line(template(1, 0, X)), line()))], r"\left(x\right)"),
    ],
)
def test_latex_of_equations(parts, expected):
    assert latex(*parts) == expected


def test_mathml_and_warnings():
    mathml, _, warnings, error = decoded(equation(line(char("x"), char("="), char(0x2212), char("3"))))
    assert mathml == '<math xmlns="http://www.w3.org/1998/Math/MathML"><mrow><mrow><mi>x</mi><mo>=</mo><mtext>−</mtext><mn>3</mn></mrow></mrow></math>'
    assert not warnings and error is None
    assert [w["type"] for w in decoded(equation(accent(5)))[2]] == ["embell-orphan", "embell-result-trivial"]
    assert "sin" in decoded(equation(line(char("s"), char("i"), char("n"))))[0]


def test_broken_equations():
    assert decoded(b"")[3]
    assert [w["type"] for w in decoded(equation(line(char("x")))[:-5])[2]] == ["malformed-input"] * 2
    assert decoded(bytes.fromhex("d0cf11e0a1b11ae1") + b"\0" * 600)[3]
    assert decoded(b"\5\1\0\7\0T\0\0" + b"\1\0" * 5000)[0] is not None


def test_equation_header():
    body = equation(X)
    head = b"\x1c\0" + (0x20000).to_bytes(4, "little") + b"\0\0" + len(body).to_bytes(4, "little") + b"\0" * 16
    assert decoded(head + body)[1] == "x"
    assert [w["type"] for w in decoded(b"\x1c\0" + b"\0" * 26 + body)[2]] == ["malformed-input"]


def test_latex_checks():
    assert spaced(r"\partialt") == r"\partial t"
    assert validated(r"\partialt") == ["command-no-space"] and validated(r"\partial t") == [] and validated(None) == []
    assert validated("{{") == ["unbalanced braces"] and validated("a_{}") == ["empty subscript after letter"]


def run(text):
    return f"<m:r><m:t>{text}</m:t></m:r>"


@pytest.mark.parametrize(
    "xml, display, expected",
    [
        (f"<m:f><m:num>{run(1)}</m:num><m:den>{run(2)}</m:den></m:f>", False, r"\tfrac{1}{2}"), (f"<m:f><m:num>{run(1)}</m:num><m:den>{run(2)}</m:den></m:f>", True, r"\dfrac{1}{2}"),
        (f"<m:sSub><m:e>{run('A')}</m:e><m:sub>{run('и')}</m:sub></m:sSub>", False, r"A_{\text{и}}"), (f"<m:sSub><m:e>{run('A')}</m:e><m:sub>{run('max')}</m:sub></m:sSub>", False, r"A_{\text{max}}"),
        (f"<m:func><m:fName><m:limLow><m:e>{run('lim')}</m:e><m:lim>{run('x→∞')}</m:lim></m:limLow></m:fName><m:e>{run('f(x)')}</m:e></m:func>", False, r"\lim_{x\to ∞} f(x)".replace("∞", r"\infty")),
        ("<m:d><m:dPr><m:begChr m:val='['/><m:endChr m:val=']'/></m:dPr><m:e><m:m><m:mr>" + f"<m:e>{run('0.1')}</m:e><m:e>{run(0)}</m:e></m:mr></m:m></m:e></m:d>", False, r"\begin{bmatrix} 0.1 & 0 \end{bmatrix}"),
        (f"{run('i')}{run('=')}{run('1,⋯,n')}", False, r"i = 1,\cdots,n"),
    ],
)
def test_office_math(xml, display, expected):
    el = omml.parse(f'<m:oMath xmlns:m="http://schemas.openxmlformats.org/officeDocument/2006/math">{xml}</m:oMath>')
    assert omml.to_latex(el, display) == expected
    assert omml.to_mathml(el, display).startswith("<math")


def test_office_brackets():
    el = omml.parse(f"<m:oMath>{run('(a)')}<m:d><m:e>{run('b')}</m:e></m:d></m:oMath>")
    out = omml.to_mathml(el)
    assert '<mo stretchy="false">(</mo>' in out and '<mo fence="true" form="prefix">(</mo>' in out
