"""Typographic normalization of Russian and English text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.bound import let
from lectern.functions.jsregex import FOLD, LEFT, SPACE

NBSP, EN_DASH, EM_DASH = "\u00a0", "–", "—"

# Word lists and character classes of the rules.
PUNCTUATION = '[,.;:!?)\\]}»"]'
RU_PREPOSITIONS = "в|на|с|к|по|об|от|из|у|о|и|а|но|не|для|при|под|над|про|что|как|же|ли|бы"
EN_PREPOSITIONS = "a|an|in|on|at|by|to|of|or"
UNITS = "мм|см|м|км|кг|г|мг|т|л|мл|с|мин|ч|Вт|В|А|Гц|Па|К|°С|%|‰"


def space_before_punctuation(text: Column) -> Column:
    return F.regexp_replace(text, f" +({PUNCTUATION})", "$1")


def en_dash_to_em_dash(text: Column) -> Column:
    """Every en dash but those of digit ranges."""
    return F.regexp_replace(text, rf"{EN_DASH}(?<![0-9]{SPACE}?{EN_DASH})(?!{SPACE}?[0-9])", EM_DASH)


def hanging_prepositions(text: Column) -> Column:
    # What can stand there is looked at before the list of words, which is dear to try at every character.
    russian = F.regexp_replace(text, rf"(?<![\p{{L}}\p{{M}}])(?=\p{{L}}{{1,3}}+{SPACE})((?iu:{RU_PREPOSITIONS})){SPACE}", f"$1{NBSP}")
    return F.regexp_replace(russian, rf"{FOLD}(?=[abiot]){LEFT}({EN_PREPOSITIONS}){SPACE}", f"$1{NBSP}")


def collapse_spaces(text: Column) -> Column:
    return F.regexp_replace(text, " {2,}", " ")


def normalize(text: Column) -> Column:
    """The four rules in their order."""
    return collapse_spaces(hanging_prepositions(en_dash_to_em_dash(space_before_punctuation(text))))


def typed_dashes(text: Column) -> Column:
    """Three hyphens to an em dash; two to an en dash before a digit, else to an em dash."""
    three = F.regexp_replace(text, "---", EM_DASH)
    ranges = F.regexp_replace(three, "--([0-9])", f"{EN_DASH}$1")
    return F.regexp_replace(ranges, "--([^-])", f"{EM_DASH}$1")


def unit_spaces(text: Column) -> Column:
    """No line break between a number and its unit, nor after a number sign.

    A unit of letters counts only before an ASCII letter or digit, as the border
    the rule asks for is never there before a blank; ``%`` likewise.
    """
    units = F.regexp_replace(text, rf"([0-9]) ({UNITS})(?=[A-Za-z0-9_])", f"$1{NBSP}$2")
    return F.regexp_replace(units, "№ ([0-9])", f"№{NBSP}$1")


def russian_quotes(text: Column) -> Column:
    """Straight double quotes turned, one after the other, into opening and closing guillemets and low quotes."""

    def mark(done: Column, inner: Column) -> Column:
        low = F.length(inner) - F.length(F.replace(inner, F.lit("„"), F.lit("")))
        straight = F.length(inner) - F.length(F.replace(inner, F.lit('"'), F.lit("")))
        return (
            F.when(~F.contains(done, F.lit("«")) | F.contains(inner, F.lit("»")), "«")
            .when(low > straight, '"')
            .when((low == straight) & (low == 0) & (F.length(inner) == 0), "„")
            .otherwise("»")
        )

    def after(done: Column, piece: Column) -> Column:
        return F.concat(done, let(F.substring_index(done, "«", -1), lambda inner: mark(done, inner)), piece)

    # From one straight quote to the next: nothing changes between them.
    return let(F.split(text, '"'), lambda pieces: F.aggregate(F.slice(pieces, F.lit(2), F.size(pieces)), F.get(pieces, F.lit(0)), after))


def collapse_white_space(text: Column) -> Column:
    """Runs of any white space as one blank, none at the ends."""
    return F.regexp_replace(F.regexp_replace(text, f"{SPACE}+", " "), "^ | $", "")


def initials(text: Column) -> Column:
    """No line break between an initial and a surname or another initial."""
    surname = F.regexp_replace(text, rf"([А-ЯA-Z])\.{SPACE}([А-ЯA-Z][а-яa-zёЁ]+)", f"$1.{NBSP}$2")
    return F.regexp_replace(surname, rf"([А-ЯA-Z])\.{SPACE}([А-ЯA-Z])\.", f"$1.{NBSP}$2.")


def imported_text(text: Column) -> Column:
    """What a text node becomes on import: ``normalize``, whose rules for blanks find nothing after those of the import, and initials."""
    blanks = F.regexp_replace(text, r"[ \t]{2,}", " ")
    return initials(hanging_prepositions(en_dash_to_em_dash(F.regexp_replace(blanks, rf"[ \t]+({PUNCTUATION})", "$1"))))


#: Formulas and images, which typography leaves alone, and the character that stands for one meanwhile.
PROTECTED = r'(?is)<span\b(?=[^>]*\bclass="[^"]*\bmath-inline\b[^"]*")[^>]*>.*?</span>|<div\b(?=[^>]*\bclass="[^"]*\bmath-block\b[^"]*")[^>]*>.*?</div>|<img\b[^>]*>'
HELD = "\ue000"


def imported_markup(html: Column) -> Column:
    """What the inside of a paragraph becomes on import: its text nodes, their edges and the blanks across tags; formulas and images stay."""
    held = F.regexp_extract_all(html, F.lit(PROTECTED), F.lit(0))

    def passed(open_html: Column) -> Column:
        tags = F.regexp_extract_all(open_html, F.lit("(<[^>]+>)"), 1)
        texts = let(F.transform(F.split(open_html, "<[^>]+>"), imported_text), across_tags)
        return F.array_join(F.zip_with(texts, tags, lambda t, tag: F.concat(t, F.coalesce(tag, F.lit("")))), "")

    parts = F.split(let(F.regexp_replace(html, PROTECTED, HELD), passed), HELD)
    return F.array_join(F.zip_with(parts, held, lambda part, own: F.concat(part, F.coalesce(own, F.lit("")))), "")


def across_tags(texts: Column) -> Column:
    """The texts between tags without blanks at the edges of the whole, and without those that double across a tag."""
    solid = F.filter(F.transform(texts, lambda t, i: F.when(t != "", i)), lambda i: i.isNotNull())
    ends = let(solid, lambda solid: F.struct(F.get(solid, F.lit(0)).alias("first"), F.try_element_at(solid, F.lit(-1)).alias("last")))

    def trimmed(ends: Column) -> Column:
        # The first text that is not empty loses its leading blanks, the last one those at its end.
        lead = lambda t, i: F.when(i == ends["first"], F.regexp_replace(t, "^[ \t]+", "")).otherwise(t)
        tail = lambda t, i: F.when(i == ends["last"], F.regexp_replace(t, "[ \t]+$", "")).otherwise(t)
        return F.transform(F.transform(texts, lead), tail)

    def joined(done: Column, text: Column) -> Column:
        before = F.try_element_at(done, F.lit(-1))
        bare = F.regexp_replace(text, rf"^[ \t]+({PUNCTUATION})", "$1")
        after_blank = F.coalesce(before.rlike("[ \t]$"), F.lit(False))
        one = F.when(F.size(done) == 0, bare).when(after_blank, F.regexp_replace(bare, "^[ \t]+", "")).otherwise(F.regexp_replace(bare, "^[ \t]{2,}", " "))
        return F.array_append(done, F.when(text == "", text).otherwise(one))

    return F.aggregate(let(ends, trimmed), F.array().cast("array<string>"), joined)


def plain_paragraph(inner: Column) -> Column:
    """A paragraph's text without tags, hard blanks decoded, trimmed."""
    bare = F.regexp_replace(F.regexp_replace(inner, "<[^>]+>", ""), "&nbsp;|&#160;", NBSP)
    return F.regexp_replace(bare, f"^{SPACE}+|{SPACE}+$", "")


def is_numbered(inner: Column) -> Column:
    return F.coalesce(plain_paragraph(inner).rlike(rf"^[0-9]+[.)]{SPACE}"), F.lit(False))


def figure_label_dot(text: Column) -> Column:
    """A full stop after the number of the first figure label where none is."""
    return F.regexp_replace(text, rf"^(.*?)(Рис(?:унок)?\.?{SPACE}*[0-9]+){SPACE}+([А-ЯA-Zа-яa-zЁё])", "$1$2. $3")


def markdown_block(text: Column) -> Column:
    """The block that the beginning of a line asks for."""
    return (
        F.when(text.rlike(f"^#{{1,4}}{SPACE}"), F.concat(F.lit("heading"), F.length(F.regexp_extract(text, "^(#{1,4})", 1))))
        .when(text.rlike(f"^{SPACE}*>{SPACE}"), "blockquote")
        .when(text.rlike(f"^{SPACE}*[-+*]{SPACE}"), "bullet_list")
        .when(text.rlike(rf"^[0-9]+\.{SPACE}"), "ordered_list")
        .when(text.rlike("^```"), "code_block")
        .otherwise("paragraph")
    )


