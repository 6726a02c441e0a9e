"""Queries over equations: binary objects and office markup built from row numbers, results built by SQL."""

from pyspark.sql import functions as F

from lectern.functions import udfs
from lectern.operators import quality
from lectern.plans.base import spread, table

HEAD = "050100070054455354" + "0000"
L, M = "l_linenumber", "l_partkey"


def letter(number):
    """A small Latin letter as a character record."""
    code = F.hex((F.lit(97) + number % 26).cast("long"))
    return F.concat(F.lit("020000"), code, F.lit("00"))


def code(point):
    return F.lit(f"020000{point & 255:02X}{point >> 8:02X}")


def line(*parts):
    return F.concat(F.lit("0100"), *parts, F.lit("00"))


def template(selector, variation, *slots):
    return F.concat(F.lit(f"0300{selector:02X}{variation:02X}00"), *slots, F.lit("00"))


def equation(*parts):
    return F.unhex(F.concat(F.lit(HEAD), *parts, F.lit("00")))


def decoded(spark, sf_dir, *parts):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", L, F.col(M).cast("long").alias("a"), F.col("l_suppkey").cast("long").alias("b"))
    return rows.withColumn("d", udfs.decode_equation(equation(*parts))).select("l_orderkey", L, F.col("d.latex").alias("latex"), F.col("d.mathml").alias("mathml"), F.size("d.warnings").alias("n_warnings"))




def mtef_sum(spark, sf_dir):
    return decoded(spark, sf_dir, line(letter(F.col("a")), code(0x2B), letter(F.col("b"))))


def mtef_fraction(spark, sf_dir):
    return decoded(spark, sf_dir, line(template(11, 0, line(letter(F.col("a"))), line(letter(F.col("b")))))).drop("mathml")


def mtef_scripts(spark, sf_dir):
    """A Greek base with a subscript and a superscript that follow as records of their own."""
    return decoded(spark, sf_dir, line(code(0x3C5), template(27, 0, line(letter(F.col("a"))), line()), template(28, 0, line(), line(letter(F.col("b")))))).drop("mathml")


def mtef_templates(spark, sf_dir):
    x = line(letter(F.col("a")))
    slots = [template(s, 0, x) for s in (1, 2, 3, 4, 10, 12, 13, 31, 32, 33)]
    return decoded(spark, sf_dir, line(*slots, template(15, 0x30, line(code(0x30)), line(code(0x31)), x))).drop("mathml")


def mtef_matrix(spark, sf_dir):
    a, b = line(letter(F.col("a"))), line(letter(F.col("b")))
    return decoded(spark, sf_dir, F.lit("050000000002020000"), a, b, b, a, F.lit("00")).drop("mathml")


def mtef_accents(spark, sf_dir):
    return decoded(spark, sf_dir, F.lit("06000200"), letter(F.col("a")), F.lit("06000B00"), letter(F.col("b"))).drop("mathml")


def mtef_v3(spark, sf_dir):
    """Version 3: options share a byte with the record's type, characters stand without an options byte."""
    old = lambda n: F.concat(F.lit("0283"), F.hex((F.lit(97) + n % 26).cast("long")), F.lit("00"))
    row = lambda *parts: F.concat(F.lit("01"), *parts, F.lit("00"))
    a, b = old(F.col("a")), old(F.col("b"))
    data = F.unhex(F.concat(F.lit("0301010300" + "00" + "00"), row(a, F.lit("02862B00"), F.lit("030B0000"), row(b), row(a), F.lit("00")), F.lit("00")))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", L, F.col(M).cast("long").alias("a"), F.col("l_suppkey").cast("long").alias("b"))
    return rows.withColumn("d", udfs.decode_equation(data)).select("l_orderkey", L, F.col("d.latex").alias("latex"), F.size("d.warnings").alias("n_warnings"))


def mtef_skippers(spark, sf_dir):
    """Rulers, sizes, colours and encodings that carry nothing to show."""
    skipped = F.lit("07" + "01" + "AABBCC" + "0965" + "1000" + "0964" + "02" + "0500" + "0903" + "07" + "0A" + "13" + "41" + "00" + "0F" + "01")
    return decoded(spark, sf_dir, skipped, line(letter(F.col("a")), F.lit("0B"), code(0x2B), letter(F.col("b")))).drop("mathml")


def mtef_warnings(spark, sf_dir):
    """How often each kind of warning is raised: unknown characters, skipped records, unsupported templates."""
    rows = table(spark, sf_dir, "lineitem").select((F.col(L) % 3).alias("kind"))
    bad = F.when(F.col("kind") == 0, equation(line(code(0xE123)))).when(F.col("kind") == 1, equation(F.lit("6402AABB"), line(code(0x78)))).otherwise(equation(line(template(14, 0, line(code(0x78))))))
    return quality.warning_histogram(rows.select(udfs.decode_equation(bad).alias("d")).select("d.*"))


def mtef_coverage(spark, sf_dir):
    """Equations in their 28-byte header, cut short for some rows."""
    body = F.concat(F.lit(HEAD), line(letter(F.col(M)), code(0x2B), letter(F.col("l_suppkey"))), F.lit("00"))
    header = F.concat(F.lit("1C0000000200"), F.lit("0000"), F.lit("FF000000"), F.repeat(F.lit("00"), 16))
    data = F.when(F.col(L) == 1, F.unhex(F.lit(""))).otherwise(F.unhex(F.concat(header, body)))
    return quality.coverage(table(spark, sf_dir, "lineitem").select(udfs.decode_equation(data).alias("d")).select("d.*"))


LATEX = ("\\partialt", "\\partial t", "a_{}", "{x", "x}", "\\left(a", "\\frac{a}{b}", "_{}_{}")


def latex_validate(spark, sf_dir):
    pick = F.element_at(F.array(*[F.lit(x) for x in LATEX]), (F.col("c_custkey") % len(LATEX) + 1).cast("int"))
    checked = table(spark, sf_dir, "customer").select("c_custkey", pick.alias("latex")).withColumn("v", udfs.validate_latex(F.col("latex"))).withColumn("spaced", udfs.latex_spacing(F.col("latex")))
    return checked.select("c_custkey", F.col("v.valid").alias("valid"), F.array_join("v.errors", "; ").alias("errors"), "spaced")


def run(text):
    return F.concat(F.lit("<m:r><m:t>"), text, F.lit("</m:t></m:r>"))


def omml_latex(spark, sf_dir):
    """Fractions, scripts with words, sums, systems and accents from office markup."""
    a, b = F.chr(F.lit(97) + F.col("c_custkey") % 26), F.col("c_nationkey").cast("string")
    el = lambda tag, *kids: F.concat(F.lit(f"<m:{tag}>"), *kids, F.lit(f"</m:{tag.split()[0]}>"))
    val = lambda tag, v: F.lit(f'<m:{tag} m:val="{v}"/>')
    fraction = el("f", el("num", run(a)), el("den", run(b)))
    script = el("sSub", el("e", run(a)), el("sub", run(F.lit("max"))))
    total = el("nary", el("naryPr", val("chr", "∑")), el("sub", run(F.lit("i"))), el("sup", run(b)), el("e", run(a)))
    rows = el("d", el("dPr", val("begChr", "{"), val("endChr", "")), el("e", el("eqArr", el("e", run(a), run(F.lit("=")), run(b)), el("e", run(b), run(F.lit("≤")), run(a)))))
    accent = el("acc", el("accPr", val("chr", "→")), el("e", run(a)))
    xml = F.concat(F.lit('<m:oMath xmlns:m="http://schemas.openxmlformats.org/officeDocument/2006/math">'), fraction, script, total, accent, rows, F.lit("</m:oMath>"))
    return spread(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_custkey").withColumn("o", udfs.omml(xml)).select("c_custkey", F.col("o.latex").alias("latex"), F.regexp_count("o.mathml", F.lit("<m(i|n|o|text)[ >]")).cast("long").alias("atoms"))


QUERIES = {f.__name__: f for f in (mtef_sum, mtef_fraction, mtef_scripts, mtef_templates, mtef_matrix, mtef_accents, mtef_v3, mtef_skippers, mtef_warnings, mtef_coverage, latex_validate, omml_latex)}

_a, _b = "chr((97 + l_partkey % 26)::INT)", "chr((97 + l_suppkey % 26)::INT)"
_rows = lambda latex, more="": f"SELECT l_orderkey, l_linenumber, {latex} AS latex{more}, 0 AS n_warnings FROM lineitem"
ORACLE_SQL = {
    "mtef_sum": _rows(
        f"concat({_a}, '+', {_b})",
        f""", concat('<math xmlns="http://www.w3.org/1998/Math/MathML"><mrow><mrow><mi>', {_a}, '</mi><mo>+</mo><mi>', {_b}, '</mi></mrow></mrow></math>') AS mathml""",
    ),
    "mtef_fraction": _rows(f"concat('\\frac{{', {_a}, '}}{{', {_b}, '}}')"),
    "mtef_scripts": _rows(f"concat('\\upsilon_{{', {_a}, '}}^{{', {_b}, '}}')"),
    "mtef_templates": _rows(
        f"replace('\\left(@\\right)\\left\\{{@\\right\\}}\\left[@\\right]\\left|@\\right|\\sqrt{{@}}\\underline{{@}}\\overline{{@}}\\vec{{@}}\\tilde{{@}}\\hat{{@}}\\int_{{0}}^{{1}} @', '@', {_a})"
    ),
    "mtef_matrix": _rows(f"concat('\\begin{{matrix}}', {_a}, ' & ', {_b}, ' \\\\ ', {_b}, ' & ', {_a}, '\\end{{matrix}}')"),
    "mtef_accents": _rows(f"concat('\\dot{{', {_a}, '}}\\vec{{', {_b}, '}}')"),
    "mtef_v3": _rows(f"concat({_a}, '+\\frac{{', {_b}, '}}{{', {_a}, '}}')"),
    "mtef_skippers": _rows(f"concat({_a}, '+', {_b})"),
    "mtef_warnings": """SELECT type, sum(n)::BIGINT AS n FROM (
  SELECT CASE l_linenumber % 3 WHEN 0 THEN 'unknown-char' WHEN 1 THEN 'unknown-record' ELSE 'unknown-template' END AS type, 1 AS n FROM lineitem
  UNION ALL SELECT 'latex-best-effort', 1 FROM lineitem WHERE l_linenumber % 3 = 2) GROUP BY type""",
    "mtef_coverage": "SELECT count(*) AS total, count(*) FILTER (l_linenumber <> 1) AS decoded FROM lineitem",
    "latex_validate": r"""SELECT c_custkey, c_custkey % 8 IN (1, 6) AS valid,
  CASE c_custkey % 8 WHEN 0 THEN 'command-no-space' WHEN 2 THEN 'empty subscript after letter' WHEN 3 THEN 'unbalanced braces' WHEN 4 THEN 'unbalanced closing brace; unbalanced braces'
    WHEN 5 THEN '\left / \right count mismatch' WHEN 7 THEN 'empty subscript/superscript pair; repeated empty subscripts' ELSE '' END AS errors,
  CASE c_custkey % 8 WHEN 0 THEN '\partial t' WHEN 1 THEN '\partial t' WHEN 2 THEN 'a_{}' WHEN 3 THEN '{x' WHEN 4 THEN 'x}' WHEN 5 THEN '\left(a' WHEN 6 THEN '\frac{a}{b}' ELSE '_{}_{}' END AS spaced FROM customer""",
    "omml_latex": r"""WITH d AS (SELECT c_custkey, chr((97 + c_custkey % 26)::INT) AS a, c_nationkey::VARCHAR AS b FROM customer)
SELECT c_custkey, concat('\tfrac{', a, '}{', b, '}', a, '_{\text{max}}\sum_{i}^{', b, '} ', a, '\vec{', a, '}\left\{\begin{aligned} ', a, ' &= ', b, ' \\ ', b, ' &\leq ', a, ' \end{aligned}\right.') AS latex, 16::BIGINT AS atoms FROM d""",
}
