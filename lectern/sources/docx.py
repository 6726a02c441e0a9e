"""Document archives: finding them, their parts, and their paragraphs as rows.

Archives are read by Spark's binary source and opened inside Arrow batches; only
the parts that are needed are inflated.  A broken archive gives an error and
never stops the others.
"""

from __future__ import annotations

import base64
import io
import re
import urllib.parse
import zipfile
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.formulas import omml
from lectern.formulas.render import escaped
from lectern.functions.udfs import decoded

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"

# Paragraph styles as (element, style, section).
STYLES = {
    "TitleArticle": ("h1", "title-article", "title"), "Author": ("p", "author", None), "Address": ("p", "affiliation", None), "EMail": ("p", "email", None),
    "Email": ("p", "email", None), "Abstract": ("p", "abstract", None), "Keywords": ("p", "keywords", None), "KeyWords": ("p", "keywords", None), "UDK": ("p", "udk", None),
    "Heading": ("h2", "heading", None), "Heading1": ("h1", "heading1", None), "Heading2": ("h2", "heading2", None), "Heading3": ("h3", "heading3", None),
    "BodyL": ("p", "body", None), "BodyLNoTab": ("p", "body-no-indent", None), "Figure": ("p", "figure", None), "FigCaption": ("p", "fig-caption", None),
    "Equation": ("p", "equation", None), "Reference": ("p", "reference", None), "References": ("p", "reference", None), "TableTitle": ("p", "table-title", None),
}
MARKS = (("b", "strong"), ("i", "em"), ("u", "u"), ("strike", "s"))
UNSHOWN = ("wmf", "emf", "tiff", "tif")
LEAST_FILES = 5


def find_archives(spark: SparkSession, root: str) -> DataFrame:
    """``path, length, content`` of all archives under ``root``; lock files are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    name = F.element_at(F.split("path", "/"), -1)
    return files.where(F.lower(name).endswith(".docx") & ~name.startswith("~$")).select("path", "length", "content")


def corpus_root(spark: SparkSession, candidates: list[str], explicit: str | None = None) -> str:
    """The first folder with enough archives; an explicit one that is too sparse is an error."""
    for root in [explicit] if explicit else candidates:
        try:
            if find_archives(spark, root).limit(LEAST_FILES).count() >= LEAST_FILES:
                return root
        except Exception as missing:
            if "PATH_NOT_FOUND" not in str(missing):
                raise
    raise ValueError(f"no folder with {LEAST_FILES} archives or more among {[explicit] if explicit else candidates}")


def shown_image(path: str, data: bytes) -> str:
    """An image as an address; kinds that browsers do not show become a labelled placeholder."""
    extension, file = path.rpartition(".")[2].lower(), path.rpartition("/")[2]
    if extension in UNSHOWN:
        box = (
            '<svg xmlns="http://www.w3.org/2000/svg" width="400" height="80" viewBox="0 0 400 80"><rect fill="#f5f5f5" stroke="#ddd" width="400" height="80" rx="4"/>'
            f'<text x="200" y="45" text-anchor="middle" fill="#999" font-family="sans-serif" font-size="13">[{extension.upper()}: {file}]</text></svg>'
        )
        return "data:image/svg+xml," + urllib.parse.quote(box, safe="-_.!~*'()")
    kind = "jpeg" if extension == "jpg" else extension
    return f"data:image/{kind};base64,{base64.b64encode(data).decode()}"


def open_archive(content: bytes) -> dict:
    """The parts of an archive: document, images by target, relations to images and to equations, equations, footnotes."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = [n for n in z.namelist() if not n.endswith("/")]
        if "word/document.xml" not in names:
            raise ValueError("word/document.xml is missing")
        images = {n.removeprefix("word/"): shown_image(n, z.read(n)) for n in names if n.startswith("word/media/")}
        blobs = {n.removeprefix("word/"): z.read(n) for n in names if n.startswith("word/embeddings/") and n.lower().endswith(".bin")}
        relations = {}
        if "word/_rels/document.xml.rels" in names:
            relations = {e.get("Id"): (e.get("Target") or "").removeprefix("/word/") for e in ElementTree.fromstring(z.read("word/_rels/document.xml.rels"))}
        footnotes = {}
        if "word/footnotes.xml" in names:
            for note in ElementTree.fromstring(z.read("word/footnotes.xml")).iter(f"{W}footnote"):
                if note.get(f"{W}id") not in (None, "0", "-1"):
                    footnotes[note.get(f"{W}id")] = "".join(t.text or "" for t in note.iter(f"{W}t")).strip()
        return {
            "xml": z.read("word/document.xml").decode("utf-8", "replace"), "images": images, "blobs": blobs, "footnotes": footnotes,
            "image_rels": {i: images[t] for i, t in relations.items() if t in images}, "ole_rels": {i: t for i, t in relations.items() if t in blobs},
            "image_targets": {i: t for i, t in relations.items() if t in images},
        }


# --- paragraphs -----------------------------------------------------------------------------------------------------


def flag(properties, tag: str) -> bool:
    el = None if properties is None else properties.find(W + tag)
    return el is not None and el.get(f"{W}val") not in ("0", "false", "none")


def run_html(run, parts: dict) -> str:
    out = []
    for el in run:
        tag = el.tag.rpartition("}")[2]
        if tag == "t":
            out.append(escaped(el.text or "").replace("&quot;", '"'))
        elif tag in ("br", "cr"):
            out.append("<br>")
        elif tag == "tab":
            out.append(" ")
        elif tag == "footnoteReference":
            note = el.get(f"{W}id")
            out.append(f'<sup class="footnote-ref" title="{escaped(parts["footnotes"].get(note, ""))}">[{note}]</sup>')
        elif tag in ("drawing", "pict"):
            out += [f'<img src="{parts["image_rels"][i]}" alt="">' for b in el.iter(f"{A}blip") if (i := b.get(f"{R}embed")) in parts["image_rels"]]
    html = "".join(out)
    properties = run.find(f"{W}rPr")
    if html:
        for mark, tag in MARKS:
            if flag(properties, mark):
                html = f"<{tag}>{html}</{tag}>"
        align = properties.find(f"{W}vertAlign") if properties is not None else None
        html = {"superscript": f"<sup>{html}</sup>", "subscript": f"<sub>{html}</sub>"}.get(align.get(f"{W}val") if align is not None else "", html)
    return html


def equation_of(run, parts: dict) -> dict | None:
    """The equation object of a run, decoded: program, target, MathML, LaTeX."""
    ole = next((e for e in run.iter() if e.tag.lower().endswith("oleobject")), None)
    if ole is None:
        return None
    program, target = ole.get("ProgID") or "", parts["ole_rels"].get(ole.get(f"{R}id"))
    known = program in ("Equation.3", "Equation.DSMT4") or re.fullmatch(r"(?i)MathType(\..*)?", program)
    mathml, latex, warnings, error = decoded(parts["blobs"][target]) if known and target else (None, None, (), None)
    return {"program": program, "target": target, "mathml": mathml, "latex": latex, "n_warnings": len(warnings or ()), "error": error}


def heading_level(style: str) -> int:
    m = re.fullmatch(r"(?i)(?:heading|заголовок)\s*([1-6])|([1-6])", style)
    return int(m[1] or m[2]) if m else 0


def paragraph(p, parts: dict) -> dict:
    """One paragraph as a row: its kind, level, style, text, markup, formulas and what it refers to."""
    properties = p.find(f"{W}pPr")
    style = "" if properties is None or properties.find(f"{W}pStyle") is None else properties.find(f"{W}pStyle").get(f"{W}val") or ""
    html, text, formulas, equations = [], [], [], []
    displayed = p.find(f"{omml.M}oMathPara") is not None
    for el in p:
        for unit in el if el.tag in (f"{W}hyperlink", f"{W}ins", f"{W}smartTag", f"{omml.M}oMathPara") else (el,):
            if unit.tag == f"{omml.M}oMath":
                latex, mathml = omml.to_latex(unit, displayed), omml.to_mathml(unit, displayed)
                formulas.append({"source": "omml", "latex": latex, "mathml": mathml, "target": None})
                html.append(f'<span class="math-inline" data-latex="{escaped(latex)}">{mathml}</span>')
            elif unit.tag == f"{W}r":
                if (eq := equation_of(unit, parts)) is not None:
                    equations.append(eq)
                    if eq["mathml"]:
                        formulas.append({"source": "ole", "latex": eq["latex"], "mathml": eq["mathml"], "target": eq["target"]})
                        html.append(f'<span class="math-inline" data-latex="{escaped(eq["latex"])}">{eq["mathml"]}</span>')
                        continue
                html.append(run_html(unit, parts))
                text += [t.text or "" for t in unit.iter(f"{W}t")]
    plain = re.sub(r"\s+", " ", "".join(text)).strip()
    images = [i for b in p.iter(f"{A}blip") if (i := b.get(f"{R}embed"))]
    element, named, section = STYLES.get(style, ("p", None, None))
    level = int(element[1]) if element != "p" else heading_level(style)
    label = re.fullmatch(r"\(\s*(\d{1,3})\s*\)[.,;]?", plain)
    only_math = bool(formulas) and (not plain or label)
    kind = (
        "math_block" if only_math and (displayed or len(formulas) == 1) else "image" if images and not plain else "heading" if level else "paragraph"
    )
    return {
        "kind": kind, "level": level, "style": style or None, "style_type": named, "section": section, "text": plain, "html": "".join(html), "label": label[0].rstrip(".,;") if label else None,
        "image_target": parts["image_targets"].get(images[0]) if images else None, "has_image": bool(images), "has_ole": bool(equations), "ole_target": equations[0]["target"] if equations else None,
        "ole_program": equations[0]["program"] if equations else None, "formulas": formulas,
    }


def table_rows(table, parts: dict) -> dict:
    """A table as a row; one of formulas, one row to each and a number in the last cell, is so marked."""
    rows = [[[paragraph(p, parts) for p in cell.findall(f"{W}p")] for cell in row.findall(f"{W}tc")] for row in table.findall(f"{W}tr")]
    cells = ["".join(f"<td>{'<br>'.join(p['html'] for p in cell)}</td>" for cell in row) for row in rows]
    formulas = [f for row in rows for cell in row for p in cell for f in p["formulas"]]
    labels = [m[0] for row in rows if row and (m := re.fullmatch(r"\(\s*\d{1,3}\s*\)", " ".join(p["text"] for p in row[-1]).strip()))]
    is_formula = bool(formulas) and len(rows) <= 3 and (len(labels) == len(rows) or len(rows) == 1)
    blank = {"level": 0, "style": None, "style_type": None, "section": None, "image_target": None, "has_image": False, "has_ole": False, "ole_target": None, "ole_program": None}
    text = " ".join(p["text"] for row in rows for cell in row for p in cell if p["text"])
    html = f"<table>{''.join(f'<tr>{c}</tr>' for c in cells)}</table>"
    return blank | {"kind": "math_block" if is_formula else "table", "text": text, "html": html, "label": labels[0] if labels and is_formula else None, "formulas": formulas}


BLOCK = (
    "idx int, kind string, level int, style string, style_type string, section string, text string, html string, label string, image_target string, has_image boolean, "
    "has_ole boolean, ole_target string, ole_program string, formulas array<struct<source: string, latex: string, mathml: string, target: string>>"
)
_FORMULA = pa.struct([("source", pa.string()), ("latex", pa.string()), ("mathml", pa.string()), ("target", pa.string())])
_BLOCK = [
    ("idx", pa.int32()), ("kind", pa.string()), ("level", pa.int32()), ("style", pa.string()), ("style_type", pa.string()), ("section", pa.string()), ("text", pa.string()), ("html", pa.string()),
    ("label", pa.string()), ("image_target", pa.string()), ("has_image", pa.bool_()), ("has_ole", pa.bool_()), ("ole_target", pa.string()), ("ole_program", pa.string()), ("formulas", pa.list_(_FORMULA)),
]


def rows_of(content: bytes) -> list[dict]:
    parts = open_archive(content)
    body = ElementTree.fromstring(parts["xml"]).find(f"{W}body")
    rows = [paragraph(el, parts) if el.tag == f"{W}p" else table_rows(el, parts) for el in (body if body is not None else ()) if el.tag in (f"{W}p", f"{W}tbl")]
    return [r | {"idx": i} for i, r in enumerate(rows)]


def read_blocks(archives: DataFrame) -> DataFrame:
    """``path`` and one row per paragraph or table, in order (``idx``); an archive that cannot be read is one row with its ``error``."""

    schema = pa.schema([("path", pa.string()), *_BLOCK, ("error", pa.string())])

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    rows = [{"path": path} | r for r in rows_of(content.as_py() or b"")]
                except (ValueError, KeyError, zipfile.BadZipFile, ElementTree.ParseError, NotImplementedError, RuntimeError) as broken:
                    rows = [{"path": path, "error": str(broken) or type(broken).__name__}]
                for at in range(0, len(rows), 500):
                    yield pa.RecordBatch.from_pylist(rows[at : at + 500], schema)

    return archives.select("path", "content").mapInArrow(run, f"path string, {BLOCK}, error string")


def formula_rows(blocks: DataFrame) -> DataFrame:
    """``path, idx, seq, display, label, source, latex, mathml, target`` of every formula."""
    return blocks.select("path", "idx", (F.col("kind") == "math_block").alias("display"), "label", F.posexplode("formulas").alias("seq", "f")).select("path", "idx", "seq", "display", "label", "f.*")


def with_labels(blocks: DataFrame) -> DataFrame:
    """Paragraphs that are a number in brackets only give it to the display formula before, and go."""
    from lectern.functions import text as X
    from lectern.operators.captions import ordered

    w = ordered("path", "idx")
    own = F.nullif(X.formula_label(F.col("text")), F.lit(""))
    lone = (F.col("kind") == "paragraph") & own.isNotNull()
    after = F.lead(F.when(lone, own)).over(w)
    taken = lone & (F.lag("kind").over(w) == "math_block") & F.lag("label").over(w).isNull()
    marked = blocks.withColumn("__label", F.when((F.col("kind") == "math_block") & F.col("label").isNull(), after).otherwise(F.col("label"))).withColumn("__taken", F.coalesce(taken, F.lit(False)))
    return marked.where(~F.col("__taken")).withColumn("label", F.col("__label")).drop("__label", "__taken")


def document_html(blocks: DataFrame) -> DataFrame:
    """``path, html``: the imported markup of each document, its blocks in order."""
    tag = F.when(F.col("level") > 0, F.concat(F.lit("h"), F.col("level"))).otherwise("p")
    cls = F.when(F.col("style_type").isNotNull(), F.concat(F.lit(' class="style-'), F.col("style_type"), F.lit('"'))).otherwise("")
    math = F.concat(F.lit('<div class="math-block" data-label="'), F.coalesce("label", F.lit("")), F.lit('">'), F.array_join("formulas.mathml", ""), F.lit("</div>"))
    block = F.when(F.col("kind") == "math_block", math).when(F.col("kind") == "table", F.col("html")).otherwise(F.concat(F.lit("<"), tag, cls, F.lit(">"), F.col("html"), F.lit("</"), tag, F.lit(">")))
    rows = blocks.where(F.col("error").isNull()).withColumn("block", block)
    return rows.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("idx", "block"))).alias("rows")).select("path", F.array_join("rows.block", "\n").alias("html"))


def artifact_rows(blocks: DataFrame) -> DataFrame:
    """The ten columns of a document's report, one row per paragraph."""
    from lectern.functions import text as X
    from lectern.operators.captions import ordered, preceding_caption

    cut = blocks.where(F.col("error").isNull() & (F.col("kind") != "table")).withColumn("raw_text", F.substring("text", 1, 500))
    return cut.select(
        "path", (F.row_number().over(ordered("path", "idx")) - 1).alias("pi"), F.col("style").alias("pStyle"), "raw_text", "has_image", "image_target", "has_ole", "ole_target", F.col("ole_program").alias("ole_progid"),
        preceding_caption(F.col("raw_text"), ordered("path", "idx")).alias("preceding_caption"), X.imported_as(F.col("style"), F.col("raw_text"), F.col("has_image"), F.col("has_ole")).alias("imported_as"),
    )
