"""Predicates, extractors and classifiers of paragraphs, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.jsregex import CYRILLIC, FOLD, LEFT, RIGHT, SPACE, SPACES
from lectern.functions.typography import collapse_white_space

# Pattern fragments and vocabularies.
FIGURE_WORDS = r"рис\.?|рисунок|fig\.?|figure"
TABLE_WORDS = r"табл\.?|таблица|table"
SECTION_RULES = (
    (rf"^результаты{SPACE}+и{SPACE}+обсуждени", "results"),
    (r"^(введение|introduction)$", "introduction"),
    (r"^(теоретическая модель|theoretical model)$", "methods"),
    (r"^(методы|материалы и методы|материалы и методика|methods|materials and methods)$", "methods"),
    (rf"(^|{SPACE}|-)(модель|model)({SPACE}|-|$)", "methods"),
    (r"^(результаты|results)$", "results"),
    (r"^(возмущенные функции|perturbed distribution functions?)", "results"),
    (r"(distribution functions?|numerical|analysis)", "results"),
    (r"^(обсуждение|discussion)$", "discussion"),
    (r"^(заключение|выводы|conclusion|conclusions)$", "conclusion"),
    (r"^(финансирование|funding)$", "funding"),
    (r"^(информация об авторах|author information)$", "author_info"),
    (r"^(вклад авторов|author contributions?)$", "author_contributions"),
    (r"^(благодарности|acknowledgements|acknowledgments)$", "acknowledgments"),
    (r"^(конфликт интересов|conflict of interest|conflicts of interest)$", "conflicts"),
    (r"^(список литературы|литература|references|bibliography)$", "references"),
    (rf"^(приложение(?:{SPACE}+[a-zа-яё0-9]+)?|appendix(?:{SPACE}+[a-z0-9]+)?)$", "appendix"),
    (r"^(аннотация|abstract|реферат)$", "abstract"),
    (r"актуальност|relevance|significance", "introduction"),
    (r"краткое содержание|summary|overview|обзор", "abstract"),
    (r"основные результат|main results|key findings", "results"),
    (r"публикации|publications|список.*(работ|трудов)", "references"),
    (r"общая характеристика|general description|характеристика работы", "introduction"),
    (r"научная новизна|novelty|новизна", "results"),
    (r"практическая (ценность|значимость)|practical (value|significance)", "results"),
    (rf"постановка задач|problem statement|задач[аи]{SPACE}", "methods"),
    (r"предмет исследования|subject|объект исследования", "methods"),
    (r"цел[ьи] исследования|objectives|aims", "methods"),
)
STYLE_RULES = (
    ("TitleArticle", "metadata-title"), ("Author", "metadata-author"), ("Address|EMail|Email", "metadata-affiliation"),
    ("Abstract|Keywords|KeyWords|UDK", "metadata-abstract"), ("Reference|References", "reference"), ("Heading[0-9]*", "heading-h2"),
)
LATIN_OF = dict(zip("абвгдеёжзийклмнопрстуфхцчшщъыьэюя", "a b v g d e e zh z i i k l m n o p r s t u f h c ch sh sch - y - e yu ya".split(), strict=True))
BODY_SECTIONS = ("introduction", "methods", "results", "discussion", "conclusion")
NO_BODY_SECTIONS = ("title", "abstract", "references", "funding", "author_info", "author_contributions", "acknowledgments", "acknowledgements", "conflicts", "appendix")


def true(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def is_equation_program(prog_id: Column) -> Column:
    return true(prog_id.isin("Equation.3", "Equation.DSMT4") | prog_id.rlike(rf"{FOLD}^MathType(\.|$)"))


def is_equation_program_loose(prog_id: Column) -> Column:
    """The reconciliation report's wider test."""
    return true(prog_id.rlike(f"{FOLD}Equation|MathType|DSMT"))


def is_image_only(html: Column) -> Column:
    return true(F.regexp_replace(html, rf"{FOLD}<br{SPACE}*/?>", "").rlike(rf"{FOLD}^{SPACE}*<img\b[^>]*>{SPACE}*$"))


def visible_length(text: Column) -> Column:
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), f"{SPACE}+", ""))


def is_worth_keeping(content: Column) -> Column:
    """Paragraphs with fewer than two visible characters are dropped by the archive reader."""
    bare = F.regexp_replace(F.replace(F.coalesce(content, F.lit("")), F.lit("&nbsp;"), F.lit("")), f"<br{SPACE}*/?>", "")
    return visible_length(bare) >= 2


def is_kept_paragraph(inner: Column) -> Column:
    """Imported paragraphs stay for their text, an inline formula or an image."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(inner, F.lit("")), "<[^>]+>", ""), "&nbsp;|&#160;", " ")
    return true(inner.rlike(rf'<span class="math-inline"|{FOLD}<img\b')) | (visible_length(bare) > 0)


def is_usable_image(src: Column) -> Column:
    trimmed = collapse_white_space(F.coalesce(src, F.lit("")))
    return (trimmed != "") & ~trimmed.rlike(f"{FOLD}^data:[^,]*,$")


def is_strict_english_figure(html: Column, text: Column) -> Column:
    """A bold figure word in the markup, or one before a number in the text."""
    bold = html.rlike(rf"{FOLD}<strong[^>]*>{SPACE}*(?:Fig\.|Figure){RIGHT}")
    return true(bold) | true(collapse_white_space(text).rlike(rf"(?:^|[-{SPACES}.;:—()])(?:Fig\.|Figure){SPACE}*[0-9]"))


def is_caption(text: Column) -> Column:
    """Does a paragraph begin like the caption of a figure or table?"""
    return true(text.rlike(rf"{FOLD}^(?:{FIGURE_WORDS}|{TABLE_WORDS}){SPACE}*[0-9]+"))


def is_figure_caption(html: Column) -> Column:
    bare = collapse_white_space(F.regexp_replace(F.regexp_replace(html, "<[^>]+>", ""), "&nbsp;|&#160;", " "))
    return true(bare.rlike(rf"^Рис(?:унок)?\.?{SPACE}*[0-9]+{SPACE}+[А-ЯA-Zа-яa-zЁё]"))


def is_caption_of_block(text: Column) -> Column:
    return true(collapse_white_space(text).rlike(rf"{FOLD}^(?:Рис\.|Рисунок|Fig\.?|Figure){SPACE}*[0-9]"))


def likely_english(text: Column) -> Column:
    latin, cyrillic = F.regexp_count(text, F.lit("[A-Za-z]")), F.regexp_count(text, F.lit(CYRILLIC))
    both = latin + cyrillic
    return true((both > 0) & (latin / F.nullif(both, F.lit(0)) > 0.5) & (cyrillic / F.nullif(both, F.lit(0)) < 0.1))


def is_reference_stop(text: Column) -> Column:
    captions = rf"^(?:подписи{SPACE}+к{SPACE}+рисункам|figure{SPACE}+captions?|captions?{SPACE}+to{SPACE}+figures?){RIGHT}"
    return true(text.rlike(rf"{FOLD}{captions}") | text.rlike(rf"{FOLD}^(?:{FIGURE_WORDS}){SPACE}*[0-9]+\.?(?:{SPACE}|$)"))


def is_reference_style(classes: Column) -> Column:
    return true(F.lower(classes).rlike(rf"{LEFT}style-reference{RIGHT}"))


def is_allowed_image(url: Column, relative: bool = True) -> Column:
    """Embedded images and web addresses; relative ones too, where asked for."""
    trimmed = collapse_white_space(F.coalesce(url, F.lit("")))
    scheme = F.lower(F.regexp_extract(trimmed, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    plain = (scheme == "") & F.lit(relative)
    return (trimmed != "") & (scheme.isin("http", "https") | trimmed.rlike(rf"{FOLD}^data:image/") | plain)


def is_word_html(html: Column) -> Column:
    marks = ("urn:schemas-microsoft-com:office", "xmlns:w=", 'class="Mso', "mso-", "<o:p>")
    return true(F.greatest(*[html.contains(m) for m in marks]))


def is_body_section(section_type: Column) -> Column:
    return true((section_type != "") & ~section_type.isin(*NO_BODY_SECTIONS))


def character_class(char: Column) -> Column:
    """The MathML element of a character of a formula's text."""
    return (
        F.when(char.rlike(r"\p{N}"), "mn")
        .when(char.rlike(r"^[=+\-−*∙•·∞∈∉⊂⊃∀∃≤≥≠≈→←↔≺≻∂∇…⋯,:;()\[\]{}|‖/\\]$"), "mo")
        .when(char.rlike(r"\p{L}"), "mi")
        .otherwise("mtext")
    )


def heading_text(text: Column) -> Column:
    """A heading as the section rules see it."""
    bare = F.regexp_replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\u00a0"), F.lit(" ")), rf"^(?:{SPACE}|[0-9.()])+", "")
    return F.lower(collapse_white_space(F.regexp_replace(bare, "[.:]+$", "")))


def section_type(text: Column) -> Column:
    name = heading_text(text)
    rule = F.when(name == "", "other")
    for pattern, kind in SECTION_RULES:
        rule = rule.when(name.rlike(FOLD + pattern), kind)
    return rule.otherwise("other")


def imported_as(style: Column, text: Column, has_image: Column, has_ole: Column) -> Column:
    """What a paragraph of the archive becomes; the first rule that holds decides."""
    style, text = F.coalesce(style, F.lit("")), F.coalesce(text, F.lit(""))
    rule = F
    for pattern, kind in STYLE_RULES:
        rule = rule.when(style.rlike(f"{FOLD}^(?:{pattern})$"), kind)
    return (
        rule.when(style.rlike(f"{FOLD}^Equation") | (has_ole & (text == "")), "math-block")
        .when(has_ole, "math-inline-host")
        .when(has_image, "figure-block")
        .when(style.rlike(f"{FOLD}^(?:FigCaption|Figure)$") | is_caption(text), "fig-caption")
        .when(text == "", "skipped")
        .otherwise("paragraph")
    )


def artifact_slug(path: Column) -> Column:
    """The name of a document's report: its path in Latin letters, and a hash of it."""
    name = F.lower(F.regexp_replace(path, rf"{FOLD}\.docx$", ""))
    single = {c: latin for c, latin in LATIN_OF.items() if len(latin) == 1 and latin != "-"}
    silent = "".join(c for c, latin in LATIN_OF.items() if latin == "-")
    name = F.translate(name, "".join(single) + silent, "".join(single.values()))
    for c, latin in LATIN_OF.items():
        if len(latin) > 1:
            name = F.replace(name, F.lit(c), F.lit(latin))
    name = F.regexp_replace(F.regexp_replace(name, "[^a-z0-9]+", "_"), "^_+|_+$", "")
    name = F.substring(name, 1, 120)
    return F.concat(F.when(name == "", "docx").otherwise(name), F.lit("_"), F.substring(F.sha1(path), 1, 8), F.lit(".jsonl"))


def flexible_date(text: Column) -> Column:
    """``d.m.y`` and ``d/m/y`` as ISO dates; ISO dates cut to ten characters; all else as it is."""
    t = collapse_white_space(F.coalesce(text, F.lit("")))
    part = lambda i: F.regexp_extract(t, r"^([0-9]{1,2})[./]([0-9]{1,2})[./]([0-9]{4})", i)
    return (
        F.when(part(3) != "", F.concat_ws("-", part(3), F.lpad(part(2), 2, "0"), F.lpad(part(1), 2, "0")))
        .when(t.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}"), F.substring(t, 1, 10))
        .otherwise(t)
    )


def star_marked_authors(html: Column) -> Column:
    stars = F.regexp_replace(html, rf"{FOLD}<sup>{SPACE}*\*+{SPACE}*</sup>", "*")
    return collapse_white_space(F.regexp_replace(F.regexp_replace(stars, "<[^>]+>", " "), rf"{FOLD}&(?:nbsp|#160);", " "))


def affiliation_email(text: Column) -> Column:
    return F.regexp_extract(text, rf"(?i)\*?{SPACE}*e(?:-|{SPACE})?mail{SPACE}*[:=]{SPACE}*([^\s]+@[^\s]+)", 1)


def without_email_lines(text: Column) -> Column:
    return collapse_white_space(F.regexp_replace(text, rf"{FOLD}\*?{SPACE}*e(?:-|{SPACE})?mail{SPACE}*[:=]{SPACE}*[^\s]+@[^\s]+\.?{SPACE}*", ""))


def doi(text: Column) -> Column:
    found = F.regexp_extract(text, rf"(?i){LEFT}(10\.[0-9]{{4,9}}/[^\s\"'<>\[\]]*[A-Za-z0-9_]){RIGHT}", 1)
    return F.regexp_replace(found, r"[.,;:\])]+$", "")


def udc(text: Column) -> Column:
    return collapse_white_space(F.regexp_extract(text, rf"{FOLD}^{SPACE}*(?:УДК|UDC){SPACE}*[:.]?{SPACE}*(.+?){SPACE}*$", 1))


def shortened(text: Column, most: int = 80) -> Column:
    cut = F.regexp_replace(F.substring(text, 1, most - 1), f"{SPACE}+$", "")
    return F.when(F.length(text) <= most, text).otherwise(F.concat(cut, F.lit("…")))


def caption_number(text: Column) -> Column:
    """The number of a figure caption; null if there is none."""
    digits = F.regexp_extract(collapse_white_space(text), rf"^(?:Рис\.|Рисунок|Fig\.?|Figure){SPACE}*([0-9]+)", 1)
    return F.when(digits != "", digits.cast("long"))


def formula_label(text: Column) -> Column:
    """``(n)``: a number in brackets alone, or that of a sequence field."""
    simple = F.regexp_extract(text, r"^\(([0-9]+)\)$", 1)
    sequence = F.regexp_extract(text, rf"SEQ{SPACE}+[^\s]+{SPACE}+\\?\*{SPACE}*ARABIC{SPACE}+([0-9]+)", 1)
    shown = F.regexp_extract(text, "([0-9]+)", 1)
    number = (
        F.when(simple != "", simple).when(sequence != "", sequence)
        .when((shown != "") & (F.length(text) < 40) & text.rlike("SEQ|ARABIC"), shown)
    )
    return F.coalesce(F.concat(F.lit("("), number, F.lit(")")), F.lit(""))


def keyword_list(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "[,;]"), collapse_white_space), lambda k: k != "")


def heading_slug(text: Column) -> Column:
    """Letters and digits joined by hyphens, 48 characters at most."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "-"), "^-+|-+$", "")
    return F.substring(slug, 1, 48)


def xml_escaped(text: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def hexed(number: Column, width: int = 2) -> Column:
    digits = F.hex(number)
    return F.concat(F.lit("0x"), F.when(F.length(digits) >= width, digits).otherwise(F.lpad(digits, width, "0")))


def tex_source(latex: Column) -> Column:
    return collapse_white_space(F.coalesce(latex, F.lit("")))
