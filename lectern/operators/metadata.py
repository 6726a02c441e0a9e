"""Publication metadata: authors, contributors, abstracts with their markers, preamble rules, and the merge into an envelope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.functions.bound import let
from lectern.functions.jsregex import FOLD, RIGHT, SPACE
from lectern.functions.typography import collapse_white_space
from lectern.operators.captions import running

# What separates the parts of an abstract, and where each goes.
MARKERS = (
    ("received_ru", "Поступила в редакцию"), ("revised_ru", "После доработки"), ("accepted_ru", "Принята к публикации"), ("keywords_ru", f"Ключевые{SPACE}*слова"),
    ("received_en", f"Received{RIGHT}"), ("revised_en", f"Revised{RIGHT}"), ("accepted_en", f"Accepted{RIGHT}"), ("keywords_en", f"Keywords{RIGHT}"),
)
BACK_SECTIONS = ("funding", "author_info", "author_contributions", "acknowledgments", "conflicts")
CAPITAL = "[А-ЯA-ZЁ]"


def parse_authors(raw: Column) -> Column:
    """``array<struct<full_name, initials, surname, starred>>`` of a line of authors; parts without initials are left out."""
    line = collapse_white_space(F.regexp_replace(raw, rf"{FOLD}&(?:nbsp|#160);", " "))
    parts = F.filter(F.transform(F.split(line, ","), collapse_white_space), lambda p: p != "")

    def author(part: Column) -> Column:
        starred = part.rlike(r"\*+$")
        bare = collapse_white_space(F.regexp_replace(part, r"\*+$", ""))
        for _ in range(3):  # initials set apart move together, two at a time
            bare = F.regexp_replace(bare, r"([А-ЯЁа-яA-Za-z])\s*\.\s*([А-ЯЁа-яA-Za-z])\s*\.", "$1.$2.")
        two = rf"^({CAPITAL}\.{SPACE}*{CAPITAL}?\.{SPACE}*)(.+)$"
        one = rf"^({CAPITAL}\.{SPACE}*)(.+)$"

        def cut(bare: Column) -> Column:
            pick = lambda pattern: F.struct(F.regexp_replace(F.regexp_extract(bare, pattern, 1), f"{SPACE}+", "").alias("initials"), collapse_white_space(F.regexp_extract(bare, pattern, 2)).alias("rest"))
            return F.when(bare.rlike(two), pick(two)).otherwise(pick(one))

        def named(found: Column) -> Column:
            surname = F.regexp_replace(F.element_at(F.split(found["rest"], f"{SPACE}+"), 1), "[,;]+$", "")
            return F.struct(F.concat_ws(" ", found["initials"], found["rest"]).alias("full_name"), found["initials"].alias("initials"), surname.alias("surname"), starred.alias("starred"))

        return let(let(bare, cut), named)

    return F.filter(F.transform(parts, author), lambda a: a["initials"] != "")


def contributors(authors: Column, has_affiliations: Column) -> Column:
    first = F.array(F.lit("aff_1"))
    return F.transform(
        authors,
        lambda a: F.struct(
            a["full_name"].alias("full_name"), a["initials"].alias("initials"), a["surname"].alias("surname"), a["starred"].alias("is_corresponding"),
            F.when(a["starred"] | has_affiliations, first).otherwise(F.array().cast("array<string>")).alias("affiliation_ids"),
        ),
    )


def with_email(authors: Column, email: Column, starred_paragraph: Column) -> Column:
    """The address goes to the only author, or to the only starred one if the paragraph is starred; else to nobody."""

    def given(authors: Column) -> Column:
        n, stars = F.size(authors), F.size(F.filter(authors, lambda a: a["starred"]))
        owner = F.struct(((n == 1) & (email != "")).alias("single"), (starred_paragraph & (stars == 1) & (email != "")).alias("marked"))
        each = lambda owner, a: F.struct(
            a["full_name"].alias("full_name"), a["initials"].alias("initials"), a["surname"].alias("surname"), (a["starred"] | owner["single"]).alias("starred"),
            F.when(owner["single"] | (owner["marked"] & a["starred"]), email).otherwise("").alias("email"),
        )
        return let(owner, lambda owner: F.transform(authors, lambda a: each(owner, a)))

    return let(authors, given)


def split_abstract(text: Column) -> Column:
    """``struct`` of an abstract and what its markers set apart: dates (Russian first; the last of the revised ones), keywords."""
    flat = collapse_white_space(text)
    cut = f"{FOLD}(?=" + "|".join(m for _, m in MARKERS) + ")"
    parts = F.filter(F.transform(F.split(flat, cut), collapse_white_space), lambda p: p != "")
    pattern = dict(MARKERS)
    mark = lambda name: rf"{FOLD}^{pattern[name]}" + (rf"[:\s.]?{SPACE}*(.+)$" if name.startswith("keywords") else f"{SPACE}+(.+)$")
    own = lambda name: F.transform(F.filter(parts, lambda p: p.rlike(mark(name))), lambda p: F.regexp_extract(p, mark(name), 1))
    date = lambda values: X.flexible_date(F.regexp_replace(values, r"\.+$", ""))
    last = lambda name: F.try_element_at(own(name), F.lit(-1))
    first = lambda name: F.try_element_at(own(name), F.lit(1))
    revised = F.try_element_at(F.filter(F.transform(parts, lambda p: F.when(p.rlike(mark("revised_ru")), F.regexp_extract(p, mark("revised_ru"), 1)).when(p.rlike(mark("revised_en")), F.regexp_extract(p, mark("revised_en"), 1))), lambda v: v.isNotNull()), F.lit(-1))
    rest = F.filter(parts, lambda p: ~_any(p, mark))
    return F.struct(
        F.array_join(rest, "\n\n").alias("abstract"), date(F.coalesce(last("received_ru"), first("received_en"), F.lit(""))).alias("received"), date(F.coalesce(revised, F.lit(""))).alias("revised"),
        date(F.coalesce(last("accepted_ru"), first("accepted_en"), F.lit(""))).alias("accepted"), X.keyword_list(F.coalesce(last("keywords_ru"), F.lit(""))).alias("keywords_ru"),
        X.keyword_list(F.coalesce(last("keywords_en"), F.lit(""))).alias("keywords_en"),
    )


def _any(part: Column, mark) -> Column:
    found = F.lit(False)
    for name, _ in MARKERS:
        found = found | part.rlike(mark(name))
    return found


def styled_preamble(blocks: DataFrame, key: str = "doc", idx: str = "idx") -> DataFrame:
    """Title, authors, affiliation, UDC, e-mail, abstract and keywords by paragraph style, Russian until the second title, English from there."""
    second = F.sum((F.col("style") == "title").cast("int")).over(running(key, idx)) >= 2
    lang = F.when(second, "en").otherwise("ru")
    marked = blocks.withColumn("lang", lang)
    first = lambda value: F.min_by(F.nullif(value, F.lit("")), F.when(F.nullif(value, F.lit("")).isNotNull(), F.col(idx)))
    pick = lambda style, lang: first(F.when((F.col("style") == style) & (F.col("lang") == lang), F.col("text")))
    both = [pick(style, lang).alias(f"{name}_{lang}") for style, name in (("title", "title"), ("author", "authors"), ("abstract", "abstract"), ("keywords", "keywords")) for lang in ("ru", "en")]
    return marked.groupBy(key).agg(
        *both, pick("affiliation", "ru").alias("affiliation_ru"), first(F.when(F.col("style") == "udk", X.udc(F.col("text")))).alias("udc"),
        first(F.when(F.col("style").isin("email", "affiliation"), X.affiliation_email(F.col("text")))).alias("email"), first(X.doi(F.col("text"))).alias("doi"),
    )


def back_sections(blocks: DataFrame, key: str = "doc", idx: str = "idx") -> DataFrame:
    """What stands under each closing section, in order: ``key, section, html``."""
    from lectern.operators.captions import sections

    under = sections(blocks, key, idx, "heading_type").where(F.col("section").isin(*BACK_SECTIONS) & F.col("heading_type").isNull())
    rows = F.array_sort(F.collect_list(F.struct(F.col(idx).alias("idx"), F.col("html").alias("html"))))
    return under.groupBy(key, "section").agg(rows.alias("rows")).select(key, "section", F.array_join("rows.html", "\n").alias("html"))


def references(blocks: DataFrame, key: str = "doc", idx: str = "idx") -> DataFrame:
    """``key, id, raw, doi``: the list of references until something ends it."""
    from lectern.operators.captions import reference_rows, sections

    under = sections(blocks, key, idx, "heading_type").where((F.col("section") == "references") & F.col("heading_type").isNull())
    rows = reference_rows(under, key, idx, "text")
    return rows.select(key, F.concat(F.lit("ref-"), F.col("n")).alias("id"), F.col("text").alias("raw"), F.nullif(X.doi(F.col("text")), F.lit("")).alias("doi"))


def merged_envelope(current: DataFrame, extracted: DataFrame, fields: list[str], key: str = "doc") -> DataFrame:
    """Fields of ``current``, overridden where the extraction found something."""
    new = extracted.select(key, *[F.col(f).alias(f"new_{f}") for f in fields])
    keep = lambda f: F.when(F.coalesce(F.col(f"new_{f}"), F.lit("")) != "", F.col(f"new_{f}")).otherwise(F.col(f)).alias(f)
    return current.join(new, key, "left").select(key, *[keep(f) for f in fields])
