"""Documents as data: envelopes, trees as node rows, navigation, export, constraints, rights and quality tiers."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lectern.formulas.render import escaped
from lectern.functions import text as X
from lectern.operators.captions import ordered

# The empty metadata of an envelope, its version, and the elements of marks.
EMPTY_META = {
    "title": {"ru": "", "en": ""}, "authors": [], "authorsEn": [], "affiliations": [], "abstract": {"ru": "", "en": ""}, "abstracts": {"ru": "", "en": ""}, "keywords": {"ru": [], "en": []},
    "contributors": [], "contributorsEn": [], "dates": {"received": "", "accepted": "", "published_online": "", "published_print": "", "revised": ""}, "udk": "", "doi": "", "publicationDate": "",
    "fundingInfo": "", "authorInfo": "", "authorContributions": "", "acknowledgments": "", "conflictsOfInterest": "",
}
VERSION = "0.1"
MARK_TAGS = {"bold": "strong", "italic": "em", "underline": "u", "strikethrough": "s", "superscript": "sup", "subscript": "sub", "code": "code"}
GROUPS = (("sections", "Разделы"), ("figures", "Рисунки"), ("tables", "Таблицы"), ("formulas", "Формулы"))
# What a node may hold; * is any number of blocks or inline nodes.
GRAMMAR = {"figure_block": r"figure_image(,figcaption){0,2}", "table_block": r"(table_caption,){0,2}table", "bullet_list": r"list_item(,list_item)*", "ordered_list": r"list_item(,list_item)*", "table": r"table_row(,table_row)*"}
INLINE = ("text", "hard_break", "math_inline", "image", "citation_ref", "footnote_ref", "formula_image_inline")


def envelope(text: str | None) -> dict:
    """An envelope from JSON; blank or broken text is an empty one, a bare document is wrapped, unknown metadata is dropped."""
    empty = {"pm": None, "meta": json.loads(json.dumps(EMPTY_META)), "references": [], "version": VERSION, "translations": {}, "rights": None}
    try:
        found = json.loads(text or "")
    except ValueError:
        return empty
    if not isinstance(found, dict):
        return empty
    if not found.get("version") and found.get("type") == "doc":
        return empty | {"pm": found}
    meta, given = empty["meta"], found.get("meta") if isinstance(found.get("meta"), dict) else {}
    for k, default in EMPTY_META.items():
        v = given.get(k)
        if v is None:
            continue
        if k == "keywords" and isinstance(v, dict):
            meta[k] = {lang: v[lang] if isinstance(v.get(lang), list) else meta[k][lang] for lang in ("ru", "en")}
        elif isinstance(default, dict):
            meta[k] |= v if isinstance(v, dict) else {}
        elif isinstance(default, list):
            meta[k] = v if isinstance(v, list) and (v or not k.endswith("En")) else meta[k]
        else:
            meta[k] = v
    return {
        "pm": found.get("pm"), "meta": meta, "references": found["references"] if isinstance(found.get("references"), list) else [], "version": found.get("version") or VERSION,
        "translations": found["translations"] if isinstance(found.get("translations"), dict) else {}, "rights": found.get("rights"),
    }


def read_envelope(text: Column) -> Column:
    """The envelope as normal JSON."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: json.dumps(envelope(v), ensure_ascii=False, separators=(",", ":")))

    return run(text)


def tree_rows(doc: dict) -> list[dict]:
    """A tree's nodes in order: id, parent, place among its siblings, depth, type, text, attributes."""
    out: list[dict] = []
    todo = [(doc, None, 0, 0)]
    while todo:
        node, parent, place, depth = todo.pop()
        own = len(out)
        out.append({"node_id": own, "parent_id": parent, "ord": place, "depth": depth, "type": node.get("type"), "text": node.get("text"), "attrs": json.dumps(node.get("attrs") or {}, ensure_ascii=False)})
        todo += [(kid, own, i, depth + 1) for i, kid in reversed(list(enumerate(node.get("content") or [])))]
    return out


NODES = "array<struct<node_id: int, parent_id: int, ord: int, depth: int, type: string, text: string, attrs: string>>"


def nodes(df: DataFrame, key: str, tree: str) -> DataFrame:
    """Rows of ``tree_rows`` for a column of trees in JSON; broken ones give none."""

    @F.pandas_udf(NODES)
    def run(values: pd.Series) -> pd.Series:
        def rows(v):
            try:
                found = json.loads(v or "")
            except ValueError:
                return []
            return tree_rows(found) if isinstance(found, dict) else []

        return values.map(rows)

    return df.select(key, F.inline(run(F.col(tree))))


def violations(rows: DataFrame, key: str) -> DataFrame:
    """Nodes whose children the grammar does not allow: ``key, node_id, type, children``."""
    # Each row once as itself and once as a child, so that trees are read once and nodes meet their children without a join.
    own, kid = F.struct("type"), F.struct("ord", "type")
    none = lambda of: F.when(F.lit(False), of)
    roles = F.array(F.struct(F.col("node_id"), own.alias("own"), none(kid).alias("kid")), F.struct(F.col("parent_id").alias("node_id"), none(own).alias("own"), kid.alias("kid")))
    children = F.array_join(F.transform(F.array_sort(F.collect_list("kid")), lambda s: s["type"]), ",").alias("children")
    met = rows.select(key, F.inline(roles)).where("node_id IS NOT NULL").groupBy(key, "node_id").agg(F.collect_list("own").alias("own"), children)
    joined = met.select(key, "node_id", F.inline("own"), "children")
    wrong = F.lit(False)
    for kind, pattern in GRAMMAR.items():
        wrong = wrong | ((F.col("type") == kind) & ~F.col("children").rlike(f"^{pattern}$"))
    inline = "|".join(INLINE)
    wrong = wrong | (F.col("type").isin("paragraph", "heading", "figcaption", "table_caption") & ~F.col("children").rlike(f"^$|^(?:{inline})(?:,(?:{inline}))*$"))
    return joined.where(wrong)


def caption_of(captions: Column, default: str) -> Column:
    """Of ``array<struct<lang, text>>``: the first that is not English, else the first, else ``default``."""
    first = lambda found: F.get(found, F.lit(0))["text"]
    russian = F.filter(captions, lambda c: (F.coalesce(c["lang"], F.lit("")) != "en") & (c["text"] != ""))
    either = F.filter(captions, lambda c: c["text"] != "")
    return F.coalesce(first(russian), first(either), F.lit(default))


def nav_label(caption: Column, words: str) -> Column:
    pattern = rf"^({words})\s*([0-9]+)([A-Za-zА-Яа-яЁё]?)"
    found = F.concat(F.regexp_extract(caption, pattern, 1), F.lit(" "), F.regexp_extract(caption, pattern, 2), F.regexp_extract(caption, pattern, 3))
    return F.when(caption.rlike(pattern), found).otherwise(X.shortened(caption, 60))


def navigation(items: DataFrame, key: str) -> DataFrame:
    """``key, group, label, items`` for each of the four groups, in their order, from rows of ``idx, type, id, level, section_type, text, captions, label``."""
    t, ok = F.col("type"), F.coalesce(F.col("id"), F.lit("")) != ""
    figure, table = caption_of(F.col("captions"), "Рисунок"), caption_of(F.col("captions"), "Таблица")
    group = (
        F.when((t == "heading") & X.is_body_section(F.col("section_type")) & (F.col("text") != ""), "sections").when(t == "figure_block", "figures")
        .when(t == "table_block", "tables").when((t == "math_block") & (F.coalesce(F.col("label"), F.lit("")) != ""), "formulas")
    )
    title = F.when(t == "heading", F.col("text")).when(t == "figure_block", figure).when(t == "table_block", table).otherwise(F.col("label"))
    label = F.when(t == "figure_block", nav_label(figure, r"Рис\.|Рисунок|Fig\.?|Figure")).when(t == "table_block", nav_label(table, r"Табл\.|Таблица|Table")).otherwise(title)
    found = items.where(ok & group.isNotNull()).select(key, "idx", group.alias("group"), label.alias("label"), title.alias("title"), F.col("id").alias("target_id"), F.when(t == "heading", F.coalesce("level", F.lit(1))).alias("level"))
    entry = F.struct("idx", "target_id", "label", "title", "level")
    grouped = found.groupBy(key, "group").agg(F.array_sort(F.collect_list(entry)).alias("items"))
    frame = items.select(key).distinct().select(key, F.inline(F.array(*[F.struct(F.lit(i).alias("place"), F.lit(g).alias("group"), F.lit(name).alias("name")) for i, (g, name) in enumerate(GROUPS)])))
    return frame.join(grouped, [key, "group"], "left").select(key, "place", "group", "name", F.coalesce("items", F.array().cast(grouped.schema["items"].dataType)).alias("items"))


def heading_ids(headings: DataFrame, key: str, idx: str, text: str, level: str) -> DataFrame:
    """``headings`` with the id that the export gives: a slug and the running number."""
    n = F.row_number().over(ordered(key, idx))
    slug = X.heading_slug(F.col(text))
    return headings.withColumn("heading_id", F.when(slug != "", F.concat_ws("-", slug, n)).otherwise(F.concat(F.lit("h"), F.col(level), F.lit("-"), n)))


# --- export ---------------------------------------------------------------------------------------------------------


# Fixed value: what stands for an image that the source did not have.
NO_IMAGE = '<div class="figure-placeholder" data-needs-image="true">⚠ Изображение не вложено в DOCX. Добавьте вручную через панель.</div>'


def marked(html: str, marks: list[dict]) -> str:
    for mark in sorted(marks, key=lambda m: m["type"]):
        attrs, kind = mark.get("attrs") or {}, mark["type"]
        if kind in MARK_TAGS:
            html = f"<{MARK_TAGS[kind]}>{html}</{MARK_TAGS[kind]}>"
        elif kind == "lang":
            html = f'<span lang="{escaped(attrs.get("lang") or "")}" class="lang-foreign">{html}</span>'
        elif kind == "link":
            title = f' title="{escaped(attrs["title"])}"' if attrs.get("title") else ""
            html = f'<a href="{escaped(attrs.get("href") or "#")}"{title} target="_blank" rel="noopener">{html}</a>'
    return html


def attributes(**values) -> str:
    """Attributes that have a value, in order; a trailing underscore of a name goes, others become hyphens."""
    return "".join(f' {name.rstrip("_").replace("_", "-")}="{escaped(str(v))}"' for name, v in values.items() if v not in (None, ""))


def element(tag: str, inner: str, **values) -> str:
    return f"<{tag}{attributes(**values)}>{inner}</{tag}>"


def image(a: dict, cls: str, **more) -> str:
    return f'<img class="{cls}" src="{escaped(a.get("src") or "")}" alt="{escaped(a.get("alt") or "")}"{attributes(title=a.get("title"), **more)}>'


class Html:
    """Serializes a tree; formulas as LaTeX.  Kinds of nodes without a method of their own leave nothing."""

    def __init__(self):
        self.headings = 0

    def text_of(self, node: dict) -> str:
        return node.get("text") or "".join(map(self.text_of, node.get("content") or []))

    def each(self, node: dict, *kinds: str):
        return [kid for kid in node.get("content") or [] if not kinds or kid["type"] in kinds]

    # --- inline ------------------------------------------------------------------------------------------------------

    def inline(self, node: dict) -> str:
        return "".join(self.inline_node(kid, kid.get("attrs") or {}) for kid in self.each(node))

    def inline_node(self, kid: dict, a: dict) -> str:
        kind = kid["type"]
        if kind == "text":
            return marked(escaped(kid.get("text") or ""), kid.get("marks") or [])
        if kind == "math_inline":
            return f'<span class="math-inline">\\({escaped(a.get("latex") or "")}\\)</span>'
        if kind == "citation_ref":
            ids = a.get("ref_ids") or []
            return f'<span class="citation-ref" data-refs="{escaped(",".join(ids))}">[{",".join(str(i + 1) for i in range(len(ids)))}]</span>'
        if kind == "footnote_ref":
            return f'<sup class="footnote-ref" data-fn="{escaped(a.get("footnote_id") or "")}">*</sup>'
        if kind == "image":
            return image(a, "inline-image")
        if kind == "formula_image_inline":
            return image({**a, "title": None}, "formula-image-inline", data_latex_hint=a.get("latex_hint"))
        return "<br>" if kind == "hard_break" else ""

    # --- blocks ------------------------------------------------------------------------------------------------------

    def blocks(self, node: dict) -> str:
        return "".join(map(self.block, self.each(node)))

    def block(self, node: dict) -> str:
        write = getattr(self, f"on_{node['type']}", None)
        return write(node, node.get("attrs") or {}) if write else ""

    def on_paragraph(self, node: dict, a: dict) -> str:
        style, inner = a.get("styleType"), self.inline(node)
        if style == "fig-caption":
            return f'<figure class="caption-block style-fig-caption"><figcaption>{inner}</figcaption></figure>'
        if style == "table-caption":
            return f'<p class="style-table-caption">{inner}</p>'
        return element("p", inner, id=a.get("id"), lang=a.get("lang"), class_=style and f"style-{style}", style=a.get("align") and f"text-align:{a['align']}")

    def on_heading(self, node: dict, a: dict) -> str:
        level, text = min(4, max(1, a.get("level") or 1)), self.text_of(node).strip()
        self.headings += 1
        slug = re.sub(r"^-|-$", "", re.sub(r"[\W_]+", "-", (text or "h").lower()))[:48]
        name = a.get("id") or (f"{slug}-{self.headings}" if slug else f"h{level}-{self.headings}")
        return element(f"h{level}", self.inline(node), id=name, data_section_type=a.get("sectionType"), style=a.get("align") and f"text-align:{a['align']}")

    def on_blockquote(self, node: dict, a: dict) -> str:
        return element("blockquote", self.blocks(node))

    def on_code_block(self, node: dict, a: dict) -> str:
        return f"<pre><code>{escaped(self.text_of(node))}</code></pre>"

    def on_horizontal_rule(self, node: dict, a: dict) -> str:
        return "<hr>"

    def on_bullet_list(self, node: dict, a: dict) -> str:
        return element("ul", "".join(element("li", self.blocks(i)) for i in self.each(node)))

    def on_ordered_list(self, node: dict, a: dict) -> str:
        order = a.get("order", 1)
        return element("ol", "".join(element("li", self.blocks(i)) for i in self.each(node)), start=order if order != 1 else None)

    def on_math_block(self, node: dict, a: dict) -> str:
        label = f'<span class="formula-label">{escaped(str(a["label"]))}</span>' if a.get("label") else ""
        return f'<div class="formula"{attributes(id=a.get("id"))}><div class="formula-body">\\[{escaped(a.get("latex") or "")}\\]</div>{label}</div>'

    def on_formula_image_block(self, node: dict, a: dict) -> str:
        inner = f'<img src="{escaped(a.get("src") or "")}" alt="{escaped(a.get("alt") or "")}" />'
        return element("figure", inner, class_="formula-image-block", data_id=a.get("id"), data_number=a.get("number"), data_latex_hint=a.get("latex_hint"))

    def on_figure_block(self, node: dict, a: dict) -> str:
        inner = []
        for kid in self.each(node, "figure_image", "figcaption"):
            b = kid.get("attrs") or {}
            if kid["type"] == "figcaption":
                english = b.get("lang") == "en"
                inner.append(element("figcaption", self.inline(kid), class_=f"figure-caption-{'en' if english else 'ru'}", lang="en" if english else None))
            else:
                inner.append(NO_IMAGE if b.get("placeholder") else image(b, "figure-block-img"))
        return f'<figure data-schema-v2 class="figure-block"{attributes(id=a.get("id"))}>{"".join(inner)}</figure>'

    def on_table_block(self, node: dict, a: dict) -> str:
        tables = self.each(node, "table")
        captions = [element("div", self.inline(c), class_=f"table-caption table-caption-{'en' if (c.get('attrs') or {}).get('lang') == 'en' else 'ru'}") for c in self.each(node, "table_caption")]
        return element("div", "".join(captions) + self.on_table(tables[-1], {}), class_="table-wrap", id=a.get("id")) if tables else ""

    def on_figure(self, node: dict, a: dict) -> str:
        picture = f'<img src="{escaped(a["src"])}" alt="{escaped(a.get("alt") or "")}"{attributes(title=a.get("title"))}>' if a.get("src") else ""
        captions = [element("figcaption", self.inline(c)) for c in self.each(node, "figcaption")]
        return element("figure", picture + "".join(captions[-1:]), class_="figure")

    def on_table(self, node: dict, a: dict, caption: str = "") -> str:
        rows = "".join(element("tr", "".join(map(self.cell, self.each(row)))) for row in self.each(node))
        return element("table", (element("caption", caption) if caption else "") + element("tbody", rows))

    def cell(self, node: dict) -> str:
        a = node.get("attrs") or {}
        spans = {name: a[name] for name in ("colspan", "rowspan") if a.get(name, 1) not in (0, 1, None)}
        return element("th" if node["type"] == "table_header" else "td", self.blocks(node), **spans)

    # --- whole documents ---------------------------------------------------------------------------------------------

    def title(self, node: dict) -> str:
        """The first heading of level 1, at any depth, that has a text."""
        for kid in self.each(node):
            own = self.text_of(kid).strip() if kid["type"] == "heading" and (kid.get("attrs") or {}).get("level") == 1 else self.title(kid)
            if own:
                return own
        return ""

    def body(self, doc: dict) -> str:
        """The blocks, one a line: without the heading that the title repeats, tables with the caption just before them."""
        nodes, title, parts = self.each(doc), self.title(doc), []
        first = nodes[0] if nodes else {}
        if title and first.get("type") == "heading" and (first.get("attrs") or {}).get("level") == 1 and self.text_of(first).strip() == title:
            nodes = nodes[1:]
        caption = None
        for node, after in zip(nodes, [*nodes[1:], None], strict=True):
            if caption is not None:
                parts.append(self.on_table(node, {}, caption))
                caption = None
            elif after and after["type"] == "table" and node["type"] == "paragraph" and (node.get("attrs") or {}).get("styleType") == "table-caption":
                caption = self.inline(node)
            else:
                parts.append(self.block(node))
        return "\n".join(filter(None, parts))


def exported(tree: str | None) -> str | None:
    """A whole page for a tree in JSON; its title is the first heading of level 1.  Scripts and styles are left to the site that shows it."""
    try:
        doc = json.loads(tree or "")
    except ValueError:
        return None
    html = Html()
    title = escaped(html.title(doc) or "Document")
    return (
        f'<!DOCTYPE html>\n<html lang="ru">\n<head>\n<meta charset="UTF-8">\n<meta name="viewport" content="width=device-width, initial-scale=1.0">\n<title>{title}</title>\n</head>\n<body>\n'
        f'<article class="publication">\n<header class="doc-meta">\n<h1>{title}</h1>\n<p class="doc-authors"></p>\n<p class="doc-abstract"></p>\n<p class="doc-keywords"></p>\n</header>\n'
        f'<main>\n{html.body(doc)}\n</main>\n<footer class="doc-bibliography"></footer>\n</article>\n</body>\n</html>'
    )


def write_pages(documents: DataFrame, path: str, key: str = "doc", tree: str = "tree") -> None:
    """Each document as a page of HTML in a folder of its key; trees that are no JSON are left out."""
    pages = documents.select(F.col(key).alias("doc"), export_html(F.col(tree)).alias("value")).where(F.col("value").isNotNull())
    pages.write.mode("overwrite").partitionBy("doc").option("lineSep", "\n").text(path)


def export_html(tree: Column) -> Column:
    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(exported)

    return run(tree)


# --- rights, tiers, mappings (of the draft format) -------------------------------------------------------------------


def inherited_rights(documents: DataFrame, blocks: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """The rights of each paragraph: its own, else its block's, else its document's."""
    joined = paragraphs.join(blocks.select("doc", "block", F.col("rights").alias("block_rights")), ["doc", "block"], "left").join(documents.select("doc", F.col("rights").alias("doc_rights")), "doc", "left")
    return joined.withColumn("effective", F.coalesce("rights", "block_rights", "doc_rights")).drop("block_rights", "doc_rights")


def quality_tier(gates: Column, orcid: Column, email: Column, affiliations: Column, credit: Column, funding: Column, dois: Column, complete: Column) -> Column:
    """Bronze to platinum, from shares between 0 and 1 and yes-or-no conditions."""
    silver = gates & (orcid >= 0.5) & (email >= 0.5) & affiliations
    gold = silver & (orcid >= 0.8) & credit & funding & (dois >= 1)
    return F.when(gold & complete, "platinum").when(gold, "gold").when(silver, "silver").otherwise("bronze")


def from_article(article: Column) -> Column:
    """A draft document from an article of the older format: fields renamed, blocks of all sections in one list."""
    return F.struct(
        F.struct(article["doc_kind"].alias("doc_kind"), article["primary_language"].alias("primary_language")).alias("envelope"),
        F.struct(article["titles"].alias("titles"), article["annotations"].alias("abstracts"), article["keywords"].alias("keywords"), article["identifiers"].alias("identifiers")).alias("metadata"),
        article["authors"].alias("contributors"), article["affiliations"].alias("affiliations"), F.flatten(article["sections"]["blocks"]).alias("body"), article["references"].alias("references"),
    )


def jats(title: Column, abstract: Column, keywords: Column, authors: Column, body: Column, references: Column, kind: Column) -> Column:
    """A JATS article from a document's fields; lists are arrays of strings."""
    each = lambda items, tag: F.array_join(F.transform(items, lambda x: F.concat(F.lit(f"<{tag}>"), X.xml_escaped(x), F.lit(f"</{tag}>"))), "")
    return F.concat(
        F.lit('<article article-type="'), X.xml_escaped(kind), F.lit('"><front><article-meta><title-group><article-title>'), X.xml_escaped(title), F.lit("</article-title></title-group><contrib-group>"),
        each(authors, "contrib"), F.lit("</contrib-group><abstract>"), X.xml_escaped(abstract), F.lit("</abstract><kwd-group>"), each(keywords, "kwd"), F.lit("</kwd-group></article-meta></front><body><sec>"),
        each(body, "p"), F.lit("</sec></body><back><ref-list>"), each(references, "ref"), F.lit("</ref-list></back></article>"),
    )


def filled_placeholders(figures: DataFrame, images: DataFrame, key: list[str]) -> DataFrame:
    """Placeholders that have an allowed image get it; all else stays."""
    new = images.where(X.is_allowed_image(F.col("src"))).select(*key, F.col("src").alias("__src"))
    joined = figures.join(new, key, "left")
    fill = F.col("placeholder") & F.col("__src").isNotNull()
    return joined.withColumns({"src": F.when(fill, F.col("__src")).otherwise(F.col("src")), "placeholder": F.col("placeholder") & ~fill}).drop("__src")


def styled_range(paragraphs: DataFrame, key: str, idx: str, start: Column, stop: Column, **attrs: str) -> DataFrame:
    """Attributes set on the paragraphs of a range; None takes one away."""
    inside = F.col(idx).between(start, stop)
    return paragraphs.withColumns({name: F.when(inside, F.lit(v)).otherwise(F.col(name)) for name, v in attrs.items()})


def first_per_key(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """One row per key, the first in order: a set that keeps insertion order."""
    return df.withColumn("__n", F.row_number().over(W.partitionBy(*key).orderBy(order))).where("__n = 1").drop("__n")
