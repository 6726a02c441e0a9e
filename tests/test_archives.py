import struct

import pytest
from helpers import archive, char, equation, image, line, ole, para

from lectern.operators import metadata, quality
from lectern.operators.captions import claimed_captions
from lectern.sources import docx
from lectern.sources.compound import equation_bytes, streams


def compound(name: str, payload: bytes) -> bytes:
    """A compound file with one stream of regular sectors."""
    payload = payload.ljust(4096, b"\0")
    sectors = len(payload) // 512
    entry = lambda n, kind, start, size: (n.encode("utf-16-le") + b"\0\0").ljust(64, b"\0") + struct.pack("<HB", 2 * len(n) + 2, kind) + b"\0" * 49 + struct.pack("<IQ", start, size)
    directory = (entry("Root Entry", 5, 0xFFFFFFFE, 0) + entry(name, 2, 2, len(payload))).ljust(512, b"\0")
    fat = [0xFFFFFFFD, 0xFFFFFFFE, *range(3, 2 + sectors), 0xFFFFFFFE]
    fat = struct.pack("<128I", *(fat + [0xFFFFFFFF] * (128 - len(fat))))
    head = bytes.fromhex("d0cf11e0a1b11ae1") + b"\0" * 16 + struct.pack("<5H", 0x3E, 3, 0xFFFE, 9, 6) + b"\0" * 6 + struct.pack("<9I", 0, 1, 1, 0, 4096, 0xFFFFFFFE, 0, 0xFFFFFFFE, 0)
    return head + struct.pack("<109I", 0, *[0xFFFFFFFF] * 108) + fat + directory + payload


def test_compound_file():
    body = equation(line(char("x")))
    data = compound("Equation Native", b"\x1c\0" + (0x20000).to_bytes(4, "little") + b"\0\0" + len(body).to_bytes(4, "little") + b"\0" * 16 + body)
    assert list(streams(data)) == ["Equation Native"]
    assert equation_bytes(data) == (body, [])
    with pytest.raises(ValueError):
        equation_bytes(compound("Other", b"x"))


BODY = "".join(
    [
        para("Заглавие", "TitleArticle"), para("А. Б. Иванов*", "Author"), para("Введение", "Heading2"), para("Text"), para("", "", ole("o1")), para("(18)"), para("", "", image("i1")), para("Рис. 1. Схема"),
        para("Note", "", '<w:r><w:footnoteReference w:id="2"/></w:r>'), para("Список литературы", "Heading2"), para("[1] A. doi 10.1000/xyz.1", "References"), para("Рис. 9. Подписи"),
    ]
)
BLOB = equation(line(char("x"), char("+"), char("y")))


@pytest.fixture(scope="module")
def blocks(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("corpus")
    (root / "sub").mkdir()
    for i in range(5):
        (root / "sub" / f"a{i}.DOCX").write_bytes(archive(BODY, {"i1": b"png"}, {"o1": BLOB}, {"0": "no", "2": "a note"}))
    (root / "~$a.docx").write_bytes(b"lock")
    (root / "broken.docx").write_bytes(b"no zip")
    assert docx.corpus_root(spark, [str(root / "none"), str(root)]) == str(root)
    with pytest.raises(ValueError):
        docx.corpus_root(spark, [str(root)], explicit=str(root / "none"))
    return docx.read_blocks(docx.find_archives(spark, str(root)))


def test_blocks_of_archives(blocks):
    rows = blocks.collect()
    errors = [r for r in rows if r.error]
    assert len({r.path for r in rows}) == 6 and len(errors) == 1 and errors[0].path.endswith("broken.docx")
    one = sorted((r for r in rows if r.path.endswith("a0.DOCX")), key=lambda r: r.idx)
    assert [r.kind for r in one] == ["heading", "paragraph", "heading", "paragraph", "math_block", "paragraph", "image", *["paragraph"] * 2, "heading", "paragraph", "paragraph"]
    assert one[4].formulas[0].latex == "x+y" and one[4].ole_target == "embeddings/o1.bin" and one[6].image_target == "media/i1.png"
    assert 'title="a note">[2]' in one[8].html


def test_labels_html_and_reports(blocks):
    labelled = docx.with_labels(blocks).where("kind = 'math_block'").collect()
    assert {r.label for r in labelled} == {"(18)"}
    html = docx.document_html(docx.with_labels(blocks)).collect()
    assert len(html) == 5 and 'data-label="(18)"' in html[0].html and '<h1 class="style-title-article">' in html[0].html
    report = docx.artifact_rows(blocks.where("path LIKE '%a1.DOCX'")).orderBy("pi").collect()
    assert [r.imported_as for r in report] == ["metadata-title", "metadata-author", "heading-h2", "paragraph", "math-block", "paragraph", "figure-block", "fig-caption", "paragraph", "heading-h2", "reference", "fig-caption"]
    assert report[8].preceding_caption == "Рис. 1. Схема"
    assert docx.formula_rows(blocks).count() == 5


def test_references_and_metadata(blocks):
    from pyspark.sql import functions as F

    from lectern.functions import text as X

    rows = blocks.where("path LIKE '%a2.DOCX'").withColumn("doc", F.lit(1)).withColumn("heading_type", F.when(F.col("kind") == "heading", X.section_type(F.col("text"))))
    refs = metadata.references(rows).collect()
    assert [(r.id, r.doi) for r in refs] == [("ref-1", "10.1000/xyz.1")]
    assert quality.coverage(docx.formula_rows(blocks)).first().decoded == 5


def test_abstract_and_authors(spark):
    text = "We study. Поступила в редакцию 15.01.2024. Ключевые слова: один, два. Received 1.2.2023 Accepted 2024-03-04 Keywords: a; b"
    df = spark.createDataFrame([(text, "А. Б. Иванов*, C. D. Smith, nobody")], "t string, a string")
    r = df.select(metadata.split_abstract(df.t).alias("s"), metadata.parse_authors(df.a).alias("a")).first()
    assert (r.s.abstract, r.s.received, r.s.accepted, r.s.keywords_ru, r.s.keywords_en) == ("We study.", "2024-01-15", "2024-03-04", ["один", "два."], ["a", "b"])
    assert [(x.initials, x.surname, x.starred) for x in r.a] == [("А.Б.", "Иванов", True), ("C.D.", "Smith", False)]


def test_captions_are_claimed_once(spark):
    rows = [(1, 0, "image", ""), (1, 1, "paragraph", "Рис. 1. A"), (1, 2, "image", ""), (1, 3, "paragraph", ""), (1, 4, "image", "")]
    got = claimed_captions(spark.createDataFrame(rows, "doc int, idx int, kind string, text string"), "doc", "idx", "kind", "text").collect()
    assert {(r.idx, r.caption_idx) for r in got} == {(0, 1), (2, None), (4, None)}
