"""Structuring passes over imported paragraphs: captions taken apart and put to their blocks, headings recognised, preambles without styles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.functions.html import tag_free
from lectern.functions.jsregex import FOLD, SPACE
from lectern.functions.typography import collapse_white_space
from lectern.operators import metadata
from lectern.operators.captions import claimed_captions, ordered, running

# Where the body of a paragraph begins after a merged caption, and the least it must have.
BODY_MARKERS = rf"\.{SPACE}+(?:[АA]{SPACE}+именно|Здесь|Видно)(?=[\s,;:.!?]|$)"
LEAST_BODY = 8
RUSSIAN_FIGURE = rf"(?:^|[^A-Za-zА-Яа-я])(?:Рисунок|Рис\.|Рис){SPACE}*[0-9]"
ENGLISH_FIGURE = rf"(?:Fig\.?|Figure){SPACE}*[0-9]"


def bilingual_caption(html: Column) -> Column:
    """``struct<ru, en>`` of a caption in both languages: parted at a break, at a bold figure word, or at the first English one; null for others."""
    text = tag_free(F.regexp_replace(html, r"(?i)<br\s*/?>", " "))
    both = X.true(text.rlike(FOLD + RUSSIAN_FIGURE)) & X.is_strict_english_figure(html, text)
    trim = lambda c: F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")
    pair = lambda a, b: F.struct(trim(a).alias("ru"), trim(b).alias("en"))
    at_break = rf"(?is)^(.*?)<br{SPACE}*/?>(.*)$"
    left, right = F.regexp_extract(html, at_break, 1), F.regexp_extract(html, at_break, 2)
    by_break = X.true(tag_free(left).rlike(FOLD + RUSSIAN_FIGURE)) & X.is_strict_english_figure(right, tag_free(right)) & (right != "")
    at_bold = rf"(?isu)^(.*?)(<strong[^>]*>{SPACE}*(?:Fig\.?|Figure).*)$"
    at_word = rf"(?isu)^(.*?(?:^|[^A-Za-zА-Яа-я]))({ENGLISH_FIGURE}.*)$"
    cut = lambda p: F.when(html.rlike(p), pair(F.regexp_extract(html, p, 1), F.regexp_extract(html, p, 2)))
    return F.when(both, F.coalesce(F.when(by_break, pair(left, right)), cut(at_bold), cut(at_word)))


def split_merged_captions(blocks: DataFrame, key: str = "doc", idx: str = "idx") -> DataFrame:
    """Captions that run on into body text become two rows (``part`` 0 and 1); all others stay one."""
    flat = collapse_white_space(F.col("text"))
    at = F.regexp_instr(flat, F.lit(FOLD + BODY_MARKERS))
    body = collapse_white_space(flat.substr(at + 1, F.length(flat)))
    merged = X.true(flat.rlike(rf"{FOLD}^(?:Рис\.|Рисунок){SPACE}*[0-9]")) & (at > 0) & (F.length(body) >= LEAST_BODY)
    row = lambda part, style, text: F.struct(F.lit(part).alias("part"), style.alias("style_type"), text.alias("text"))
    two = F.array(row(0, F.lit("fig-caption"), flat.substr(F.lit(1), at)), row(1, F.lit("body"), body))
    one = F.array(row(0, F.col("style_type"), F.col("text")))
    return blocks.select(key, idx, F.inline(F.when(merged, two).otherwise(one)))


def table_captions(blocks: DataFrame, key: str = "doc", idx: str = "idx") -> DataFrame:
    """Each table with the number and captions (Russian, English) of the rows just before it, four at most; those rows have ``of_table``."""
    w = ordered(key, idx)
    t = F.col("text")
    role = (
        F.when(F.col("kind") == "table", "table").when(t.rlike(rf"{FOLD}^(?:Табл\.|Таблица){SPACE}*[0-9]+{SPACE}*$"), "number").when(t.rlike(rf"{FOLD}^Table{SPACE}*[0-9]+{SPACE}*$"), "number_en")
        .when(t.rlike(rf"{FOLD}^(?:Табл\.|Таблица){SPACE}*[0-9]"), "caption").when(t.rlike(rf"{FOLD}^Table{SPACE}*[0-9]"), "caption_en")
    )
    marked = blocks.withColumn("role", F.coalesce(role, F.lit("other")))
    caption = ~F.col("role").isin("table", "other")
    # Rows of one run of captions and the table that ends it share a number.
    run = F.sum((~caption).cast("int")).over(w) - F.when(caption, 0).otherwise(1)
    runs = marked.withColumn("run", run).withColumn("back", F.count("*").over(w.partitionBy(key, "run").rowsBetween(0, 4)) - 1)
    end = F.last("role").over(w.partitionBy(key, "run").rowsBetween(0, 4))
    at = F.last(idx).over(w.partitionBy(key, "run").rowsBetween(0, 4))
    return runs.withColumn("of_table", F.when(caption & (end == "table"), at)).drop("run", "back")


def placed_figures(blocks: DataFrame, key: str = "doc", idx: str = "idx") -> DataFrame:
    """``key, idx, caption_idx, placeholder``: images with the caption they claim, and captions that no image claims, as placeholders."""
    claimed = claimed_captions(blocks, key, idx, "kind", "text")
    orphans = blocks.where((F.col("kind") == "paragraph") & X.is_caption_of_block(F.col("text"))).select(key, F.col(idx).alias("caption_idx")).join(claimed.select(key, "caption_idx"), [key, "caption_idx"], "left_anti")
    return claimed.select(key, "idx", "caption_idx", F.lit(False).alias("placeholder")).unionByName(orphans.select(key, F.col("caption_idx").cast("long").alias("idx"), F.col("caption_idx").cast("long").alias("caption_idx"), F.lit(True).alias("placeholder")))


def is_uppercase_heading(html: Column) -> Column:
    """Short paragraphs in capitals, bold throughout or numbered."""
    text = tag_free(html)
    bold = tag_free(F.array_join(F.regexp_extract_all(html, F.lit(r"(?is)<(?:strong|b)>(.*?)</(?:strong|b)>"), 1), ""))
    plain = ~html.rlike(r'(?i)<img\b|<table\b|class="math-(?:inline|block)"')
    capital = text.rlike("[А-ЯA-Z]") & (text == F.upper(text)) & ~text.rlike("[а-яa-z]")
    return X.true(plain & F.length(text).between(3, 80) & capital & (text.rlike(rf"^[0-9]+\.{SPACE}+[^\s]") | (bold == text)))


def equation_tables(html: Column) -> Column:
    """One-row tables of two or three cells whose last is ``(n)`` become display formulas."""
    cell = r"<td[^>]*>\s*((?:(?!</td>).)*?)\s*</td>\s*"
    label = r"<td[^>]*>\s*(\([0-9]+\))\s*</td>\s*"
    begin, end = r"(?is)<table[^>]*>\s*(?:<tbody[^>]*>\s*)?<tr[^>]*>\s*", r"</tr>\s*(?:</tbody>\s*)?</table>"
    block = '<div class="math-block" data-latex="$F">$F<span class="math-label">$L</span></div>'
    three = F.regexp_replace(html, rf"{begin}<td[^>]*>(?:(?!</td>).)*?</td>\s*{cell}{label}{end}", block.replace("$F", "$1").replace("$L", "$2"))
    return F.regexp_replace(three, rf"{begin}{cell}{label}{end}", block.replace("$F", "$1").replace("$L", "$2"))


def unstyled_preamble(blocks: DataFrame, key: str = "doc", idx: str = "idx") -> DataFrame:
    """What paragraphs without styles say by their place, length and words: title, authors, affiliation, e-mail, abstract."""
    w = ordered(key, idx)
    t = F.col("text")
    place = F.row_number().over(w)
    email = F.regexp_extract(t, r"(?i)e[-\s]?mail\s*[:=]?\s*([^\s]+@[^\s]+)", 1)
    is_title = (place == 1) & F.length(t).between(20, 600)
    is_authors = t.contains(",") & (F.length(t) < 500) & t.rlike(r"[А-ЯA-ZЁ]\.\s*[А-ЯA-ZЁ]\.|[А-ЯA-ZЁ]\.\.")
    is_place = F.length(t).between(25, 799) & (email == "") & t.rlike(rf"{FOLD}«|»|объединение|институт|университет|лаборатори|academy|university|NPO|LLC")
    is_abstract = (F.length(t) > 200) & (email == "") & ~t.rlike(rf"{FOLD}^(?:рис\.|рисунок|табл|таблица|doi|удк|ключевые|keywords)")
    role = F.when(is_title, "title").when(is_authors, "authors").when(is_place, "affiliation").when(email != "", "email").when(is_abstract, "abstract")
    marked = blocks.select(key, idx, t, role.alias("role"), email.alias("mail"))
    first = lambda name, value=t: F.min_by(F.when(F.col("role") == name, value), F.when(F.col("role") == name, F.col(idx)))
    pieces = F.array_sort(F.collect_list(F.when(F.col("role") == "abstract", F.struct(F.col(idx).alias("at"), t.alias("text")))))
    found = marked.groupBy(key).agg(first("title").alias("title"), first("authors").alias("author_line"), first("affiliation").alias("affiliation"), first("email", F.col("mail")).alias("email"), pieces.alias("pieces"))
    russian = F.col("title").rlike(r"[\x{0400}-\x{04ff}]")
    return found.select(
        key, F.when(X.true(russian), F.col("title")).alias("title_ru"), F.when(~X.true(russian), F.col("title")).alias("title_en"),
        metadata.parse_authors(F.coalesce("author_line", F.lit(""))).alias("authors"), "affiliation", "email", F.array_join("pieces.text", "\n\n").alias("abstract"),
    )


def inline_formula_spacing(before: Column, after: Column) -> Column:
    """``struct<left, right>``: the blanks that a formula within a sentence needs towards its neighbours' text."""
    word = r"[\p{L}\p{N}]"
    left = F.when(X.true(before.rlike(rf"(?:{word}|[)\]}},;:])$")), " ").otherwise("")
    right = F.when(X.true(after.rlike(rf"^(?:{word}|[(\[{{])")), " ").otherwise("")
    return F.struct(left.alias("left"), right.alias("right"))


def is_figure_table(html: Column) -> Column:
    """A table of four cells at most, with an image and a figure's label, is a figure."""
    cells = F.regexp_count(html, F.lit(r"(?i)<t[dh]\b"))
    text = tag_free(F.regexp_replace(html, r"(?i)</t[dh]>|<br\s*/?>", " "))
    labelled = text.rlike(FOLD + RUSSIAN_FIGURE) | X.is_strict_english_figure(html, text)
    return X.true(html.rlike(r"(?i)<table\b") & (cells <= 4) & html.rlike(r"(?i)<img\b") & labelled)


def without_caption_list(blocks: DataFrame, key: str = "doc", idx: str = "idx") -> DataFrame:
    """The document without the list of captions at its end: the line that announces it, and captions and blank rows after it."""
    marker = X.true(F.col("text").rlike(rf"{FOLD}^(?:подписи{SPACE}+к{SPACE}+рисункам|figure{SPACE}+captions?|captions?{SPACE}+to{SPACE}+figures?){SPACE}*[.:]?{SPACE}*$"))
    seen = F.max(marker.cast("int")).over(running(key, idx)) == 1
    listed = marker | ((F.col("kind") == "paragraph") & ((F.col("text") == "") | X.is_caption_of_block(F.col("text"))))
    return blocks.withColumn("__gone", seen & listed).where(~F.col("__gone")).drop("__gone")


def tail_labels(tail: Column, n: Column) -> Column:
    """``struct<labels, rest>``: the numbers in brackets that lead the text after ``n`` equations, shared out over them.

    As many as equations or more: each takes its own; a single one for several
    equations goes to the last; otherwise the text stays whole.
    """
    bare = F.regexp_replace(F.coalesce(tail, F.lit("")), f"^{SPACE}+|{SPACE}+$", "")
    lead = rf"^((?:{SPACE}*\([0-9]+\){SPACE}*)+)"
    found = F.regexp_extract_all(F.regexp_extract(bare, lead, 1), F.lit(r"(\([0-9]+\))"), 1)
    rest = F.regexp_replace(bare, lead, "")
    none = F.when(n > 0, F.array_repeat(F.lit(None).cast("string"), n.cast("int"))).otherwise(F.array().cast("array<string>"))
    enough, last = (n > 0) & (F.size(found) >= n), (n > 1) & (F.size(found) == 1)
    labels = F.when(enough, F.slice(found, 1, F.greatest(n, F.lit(0)).cast("int"))).when(last, F.concat(F.slice(none, 1, F.greatest(n - 1, F.lit(0)).cast("int")), found)).otherwise(none)
    return F.struct(labels.alias("labels"), F.when(enough | last, rest).otherwise(bare).alias("rest"))
