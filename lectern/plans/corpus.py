"""Queries over ordered paragraphs, bounded joins, corpus totals, regressions and reconciliation."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lectern.functions import text as X
from lectern.operators import captions as C
from lectern.operators import corpus
from lectern.plans.base import derived, duck, spread, table

# Paragraphs of invented documents: one per order, a document per customer.
BLOCKS = """
SELECT o_custkey AS doc, o_orderkey AS idx,
  CASE o_orderkey % 7 WHEN 0 THEN 'image' WHEN 3 THEN 'image' WHEN 6 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'table' ELSE 'paragraph' END ELSE 'paragraph' END AS kind,
  CASE o_orderkey % 7 WHEN 0 THEN '' WHEN 3 THEN '' WHEN 1 THEN concat('Рис. ', CAST(o_orderkey % 9 + 1 AS STRING), '. Схема') WHEN 5 THEN concat('Fig. ', CAST(o_orderkey % 4 + 1 AS STRING), ' Plot')
    WHEN 2 THEN '' ELSE concat('text ', CAST(o_orderkey AS STRING)) END AS text,
  CASE WHEN o_orderkey % 11 = 0 THEN 'introduction' WHEN o_orderkey % 13 = 0 THEN 'references' ELSE NULL END AS heading_type,
  CASE WHEN o_orderkey % 5 = 0 THEN 'title' ELSE 'body' END AS style
FROM {orders}"""
FILES = """SELECT o_orderkey AS file, CAST(o_custkey % 5 AS DOUBLE) AS figure_blocks, CAST(CASE WHEN o_custkey % 4 = 0 THEN NULL ELSE o_custkey % 3 END AS DOUBLE) AS figure_placeholders,
  CASE WHEN o_orderkey % 17 = 0 THEN 'broken' ELSE NULL END AS parse_error FROM {orders}"""
CURRENT = """SELECT o_orderkey AS file, CAST(o_custkey % 5 + o_orderkey % 3 - 1 AS DOUBLE) AS figure_blocks, CAST(o_custkey % 3 + o_orderkey % 2 AS DOUBLE) AS figure_placeholders,
  CASE WHEN o_orderkey % 19 = 0 THEN 'broken' ELSE NULL END AS parse_error FROM {orders} WHERE o_orderkey % 5 <> 0"""
SOURCES = """SELECT l_suppkey AS doc, l_orderkey * 10 + l_linenumber AS seq, CASE WHEN l_linenumber % 2 = 0 THEN concat('t', CAST(l_partkey AS STRING)) ELSE NULL END AS target,
  CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE concat('(', CAST(l_linenumber AS STRING), ')') END AS label, concat('x_', CAST(l_partkey AS STRING), '  = y') AS latex FROM {lineitem}"""
EMITTED = """SELECT l_suppkey AS doc, l_orderkey * 10 + l_linenumber AS pos, CASE WHEN l_linenumber % 2 = 0 THEN concat('t', CAST(l_partkey AS STRING)) ELSE NULL END AS target,
  concat('(', CAST(l_linenumber % 4 AS STRING), ')') AS label, concat('x_', CAST(l_partkey AS STRING), ' = ', CASE WHEN l_orderkey % 3 = 0 THEN 'z' ELSE 'y' END) AS latex FROM {lineitem} WHERE l_linenumber <> 1"""


def blocks(spark, sf_dir):
    return derived(spark, sf_dir, BLOCKS)


def caption_lag(spark, sf_dir):
    return blocks(spark, sf_dir).select("doc", "idx", C.preceding_caption(F.col("text"), C.ordered()).alias("preceding_caption"))


def caption_gap(spark, sf_dir):
    return C.caption_gaps(blocks(spark, sf_dir), "doc", "idx", "text")


def nearest_caption(spark, sf_dir):
    df = blocks(spark, sf_dir)
    return df.select(
        "doc", "idx", C.nearest_following(df, "doc", "idx", "kind", "text", 3).alias("following"), C.nearest_preceding(df, "doc", "idx", "kind", "text", 4).alias("preceding"),
        C.report_caption_before(F.col("text"), "doc", "idx").alias("reported"),
    ).where("following IS NOT NULL OR preceding IS NOT NULL OR reported IS NOT NULL")


def claimed_captions(spark, sf_dir):
    return C.claimed_captions(blocks(spark, sf_dir), "doc", "idx", "kind", "text").select("doc", "idx", "caption_idx")


def section_extent(spark, sf_dir):
    marked = C.english_part(C.preamble(C.sections(blocks(spark, sf_dir), "doc", "idx", "heading_type"), "doc", "idx", "heading_type"), "doc", "idx", "style")
    return marked.select("doc", "idx", "section", "in_preamble", "in_english")


def reference_rank(spark, sf_dir):
    return C.reference_rows(blocks(spark, sf_dir).where("kind = 'paragraph'"), "doc", "idx", "text").select("doc", "idx", "n")


def caption_runs(spark, sf_dir):
    return C.caption_runs(blocks(spark, sf_dir), "doc", "idx", "text").select("doc", "idx", "place")


def figure_texts(spark, sf_dir):
    df = blocks(spark, sf_dir).where("kind = 'paragraph'")
    found = C.figure_texts(df.where(df.text.startswith("Рис")).select("doc", "idx", "text"), df.where(df.text.startswith("text")).select("doc", "idx", "text"), "doc")
    return found.select("doc", "idx", "full_text")


def metric_regression(spark, sf_dir):
    return corpus.regressions(derived(spark, sf_dir, FILES), derived(spark, sf_dir, CURRENT), metrics=("figure_blocks", "figure_placeholders"))


def corpus_totals(spark, sf_dir):
    return corpus.totals(derived(spark, sf_dir, FILES), ("figure_blocks", "figure_placeholders"))


def equation_reconcile(spark, sf_dir):
    return corpus.reconcile(derived(spark, sf_dir, SOURCES), derived(spark, sf_dir, EMITTED))


def relation_joins(spark, sf_dir):
    """Two hops from a paragraph by relation and target to bytes: a miss at either leaves no formula; footnotes stay without a text."""
    paragraphs = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), "l_linenumber", F.col("l_partkey").alias("rid"), F.col("l_suppkey").alias("note"))
    relations = table(spark, sf_dir, "part").where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("rid"), F.col("p_size").alias("target"))
    blobs = relations.select("target").distinct().where("target % 2 = 0").select("target", F.concat(F.lit("blob"), "target").alias("bytes"))
    notes = table(spark, sf_dir, "supplier").where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("note"), F.col("s_name").alias("note_text"))
    formulas = paragraphs.join(relations, "rid").join(blobs, "target")
    return formulas.join(notes, "note", "left").groupBy("target").agg(F.count("*").alias("formulas"), F.count("note_text").alias("with_note"), F.min(F.coalesce("note_text", F.concat(F.lit("["), "note", F.lit("]")))).alias("first_note"))


def author_contributors(spark, sf_dir):
    """Starred authors refer to the first affiliation, others too if there is any; the e-mail goes to the only corresponding one."""
    raw = F.concat(F.lit("А. Б. Иванов"), F.when(F.col("c_custkey") % 2 == 0, "*").otherwise(""), F.lit(", C. Smith"), F.col("c_custkey"))
    from lectern.operators.metadata import contributors, parse_authors

    authors = spread(table(spark, sf_dir, "customer"), "c_custkey").select("c_custkey", F.posexplode(contributors(parse_authors(raw), F.lit(True))).alias("pos", "a"))
    return authors.select("c_custkey", F.col("pos").cast("long").alias("pos"), "a.surname", "a.initials", "a.is_corresponding", F.array_join("a.affiliation_ids", ",").alias("affiliations"))


def image_hints(spark, sf_dir):
    """Distinct names joined by plus, in order of appearance."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey"))).alias("rows"))
    return lines.select("l_orderkey", F.array_join(F.array_distinct(F.transform("rows", lambda r: (r["l_suppkey"] % 3).cast("string"))), "+").alias("hints"))


def natural_sort(spark, sf_dir):
    """Names ranked by the number in them, then by themselves."""
    name = F.concat(F.lit("eq"), F.col("s_suppkey"), F.lit(".bin"))
    number = F.regexp_extract("name", "([0-9]+)", 1).cast("long")
    return table(spark, sf_dir, "supplier").select(name.alias("name")).select("name", F.row_number().over(W.orderBy(number, "name")).cast("long").alias("rank"))


def warning_topk(spark, sf_dir):
    warnings = table(spark, sf_dir, "events").select(F.col("event_type").alias("type"), F.col("event_id").alias("seq"))
    return corpus.top_warnings(warnings)


def imported_paragraphs(spark, sf_dir):
    """Which paragraphs stay, by either rule, and the caption predicates that differ."""
    t = F.col("text")
    return blocks(spark, sf_dir).select(
        "doc", "idx", X.is_worth_keeping(t).alias("kept"), X.is_kept_paragraph(t).alias("kept_on_import"), X.is_caption(t).alias("caption"), X.is_figure_caption(t).alias("figure_caption"),
        X.is_caption_of_block(t).alias("block_caption"), X.is_strict_english_figure(t, t).alias("english_figure"), X.is_reference_stop(t).alias("stop"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        caption_lag, caption_gap, nearest_caption, claimed_captions, section_extent, reference_rank, caption_runs, figure_texts, metric_regression, corpus_totals,
        equation_reconcile, relation_joins, author_contributors, image_hints, natural_sort, warning_topk, imported_paragraphs,
    )
}

_blocks = f"b AS ({duck(BLOCKS)})"
_cap = "(text LIKE 'Рис.%' OR text LIKE 'Fig.%')"
_solid = "CASE WHEN kind IN ('image', 'table') OR text <> '' THEN {'kind': kind, 'text': text} END"
_near = lambda expr: f"CASE WHEN kind = 'image' AND ({expr}).kind = 'paragraph' AND (({expr}).text LIKE 'Рис.%' OR ({expr}).text LIKE 'Fig.%') THEN ({expr}).text END"
_first_of = "coalesce(" + ", ".join(f"lead({_solid}, {k}) OVER w" for k in (1, 2, 3)) + ")"
_last_of = "coalesce(" + ", ".join(f"lag({_solid}, {k}) OVER w" for k in (1, 2, 3, 4)) + ")"

ORACLE_SQL = {
    "caption_lag": f"WITH {_blocks} SELECT doc, idx, lag(CASE WHEN {_cap} THEN text END) OVER (PARTITION BY doc ORDER BY idx) AS preceding_caption FROM b",
    "caption_gap": f"""WITH {_blocks}, n AS (SELECT doc, idx, regexp_extract(text, '([0-9]+)', 1)::BIGINT AS v FROM b WHERE {_cap}),
  j AS (SELECT doc, greatest(v - lag(v) OVER (PARTITION BY doc ORDER BY idx) - 1, 0) AS jump FROM n), s AS (SELECT doc, sum(jump)::BIGINT AS g FROM j GROUP BY doc)
SELECT b.doc, coalesce(any_value(g), 0)::BIGINT AS caption_gaps FROM b LEFT JOIN s USING (doc) GROUP BY b.doc""",
    "nearest_caption": f"""WITH {_blocks}, f AS (SELECT doc, idx, kind, {_first_of} AS nxt, {_last_of} AS prv,
  coalesce({", ".join(f"lag(CASE WHEN {_cap} THEN text END, {k}) OVER w" for k in (1, 2, 3))}) AS reported FROM b WINDOW w AS (PARTITION BY doc ORDER BY idx)),
  o AS (SELECT doc, idx, {_near('nxt')} AS following, {_near('prv')} AS preceding, reported FROM f)
SELECT * FROM o WHERE following IS NOT NULL OR preceding IS NOT NULL OR reported IS NOT NULL""",
    # The walk of an import, pair by pair: from the first image or caption of a chain on, each takes the next.
    "claimed_captions": f"""WITH RECURSIVE {_blocks}, r AS (SELECT doc, idx, row_number() OVER (PARTITION BY doc ORDER BY idx) AS n,
    CASE WHEN kind = 'image' THEN 'i' WHEN kind = 'paragraph' AND {_cap} THEN 'c' WHEN kind <> 'paragraph' OR text <> '' THEN 'o' END AS t FROM b),
  s AS (SELECT doc, idx, n, t, row_number() OVER (PARTITION BY doc ORDER BY idx) AS k FROM r WHERE t IS NOT NULL),
  l AS (SELECT a.doc, a.idx, a.k, a.t, b.t AS pt, b.idx AS pidx, a.n - b.n AS apart, coalesce(concat(b.t, a.t) IN ('ic', 'ci') AND a.n - b.n <= 3, false) AS linked FROM s a LEFT JOIN s b ON b.doc = a.doc AND b.k = a.k - 1),
  p AS (SELECT doc, k, false AS taken FROM l WHERE k = 1 UNION ALL SELECT l.doc, l.k, l.linked AND NOT p.taken FROM p JOIN l ON l.doc = p.doc AND l.k = p.k + 1),
  m AS (SELECT l.*, p.taken, q.taken AS next_taken, o.taken AS before_taken, z.idx AS nidx FROM l JOIN p ON p.doc = l.doc AND p.k = l.k LEFT JOIN p q ON q.doc = l.doc AND q.k = l.k + 1
    LEFT JOIN p o ON o.doc = l.doc AND o.k = l.k - 1 LEFT JOIN l z ON z.doc = l.doc AND z.k = l.k + 1)
SELECT doc, idx, CASE WHEN taken THEN pidx WHEN next_taken THEN nidx WHEN pt = 'c' AND apart = 4 AND NOT before_taken THEN pidx END AS caption_idx FROM m WHERE t = 'i'""",
    "section_extent": f"""WITH {_blocks} SELECT doc, idx, last_value(heading_type IGNORE NULLS) OVER w AS section,
  coalesce(idx < min(CASE WHEN heading_type = 'introduction' THEN idx END) OVER (PARTITION BY doc), true) AS in_preamble, count(*) FILTER (style = 'title') OVER w >= 2 AS in_english
FROM b WINDOW w AS (PARTITION BY doc ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "reference_rank": rf"""WITH {_blocks}, p AS (SELECT * FROM b WHERE kind = 'paragraph'),
  s AS (SELECT doc, idx, text, max({_cap}::INT) OVER (PARTITION BY doc ORDER BY idx ROWS UNBOUNDED PRECEDING) AS stopped FROM p)
SELECT doc, idx, row_number() OVER (PARTITION BY doc ORDER BY idx)::INT AS n FROM s WHERE stopped = 0 AND text <> ''""",
    "caption_runs": f"""WITH {_blocks}, g AS (SELECT doc, idx, {_cap} AS c, count(*) FILTER (NOT {_cap}) OVER (PARTITION BY doc ORDER BY idx ROWS UNBOUNDED PRECEDING) AS run FROM b),
  r AS (SELECT doc, idx, row_number() OVER (PARTITION BY doc, run ORDER BY idx)::INT AS place FROM g WHERE c) SELECT * FROM r WHERE place <= 4""",
    "figure_texts": f"""WITH {_blocks}, a AS (SELECT doc, idx, row_number() OVER (PARTITION BY doc ORDER BY idx) AS o, count(*) OVER (PARTITION BY doc) AS n FROM b WHERE kind = 'paragraph' AND text LIKE 'Рис%'),
  t AS (SELECT doc, text, row_number() OVER (PARTITION BY doc ORDER BY idx) AS o, count(*) OVER (PARTITION BY doc) AS n FROM b WHERE kind = 'paragraph' AND text LIKE 'text%')
SELECT a.doc, a.idx, t.text AS full_text FROM a JOIN t ON a.doc = t.doc AND t.o = a.o - greatest(a.n - t.n, 0)""",
    "metric_regression": f"""WITH p AS ({duck(FILES)}), q AS ({duck(CURRENT)}), l AS (
  SELECT file, 'figure_blocks' AS metric, p.figure_blocks AS before, q.figure_blocks AS after, false AS lower_better FROM p JOIN q USING (file)
  UNION ALL SELECT file, 'figure_placeholders', p.figure_placeholders, q.figure_placeholders, true FROM p JOIN q USING (file))
SELECT file, metric, before, after, after - before AS delta, CASE WHEN (after > before) = lower_better THEN 'regression' ELSE 'improvement' END AS verdict FROM l WHERE before <> after
UNION ALL SELECT file, 'parse_error', NULL, NULL, NULL, 'regression' FROM p JOIN q USING (file) WHERE p.parse_error IS NULL AND q.parse_error IS NOT NULL""",
    "corpus_totals": f"""WITH p AS ({duck(FILES)}), g AS (SELECT * FROM p WHERE parse_error IS NULL)
SELECT (SELECT count(*) FROM g) AS files_ok, (SELECT count(*) FROM p WHERE parse_error IS NOT NULL) AS files_error, sum(figure_blocks) AS sum_figure_blocks, sum(coalesce(figure_placeholders, 0)) AS sum_figure_placeholders,
  avg(figure_blocks) AS mean_figure_blocks, avg(coalesce(figure_placeholders, 0)) AS mean_figure_placeholders FROM g""",
    "equation_reconcile": f"""WITH s AS ({duck(SOURCES)}), e AS ({duck(EMITTED)}), f AS (SELECT *, regexp_replace(latex, '\\s+', ' ', 'g') AS flat FROM s),
  byt AS (SELECT doc, target, arg_min(label, pos) AS label, arg_min(latex, pos) AS latex FROM e WHERE target IS NOT NULL GROUP BY 1, 2),
  byl AS (SELECT doc, latex, arg_min(label, pos) AS label FROM e GROUP BY 1, 2),
  m AS (SELECT f.doc, f.seq, f.label, f.flat, CASE WHEN f.target IS NOT NULL THEN byt.latex ELSE byl.latex END AS met, CASE WHEN f.target IS NOT NULL THEN byt.label ELSE byl.label END AS met_label
    FROM f LEFT JOIN byt ON f.doc = byt.doc AND f.target = byt.target LEFT JOIN byl ON f.doc = byl.doc AND f.flat = byl.latex)
SELECT doc, seq, 'missing-dom-block' AS mismatch FROM m WHERE met IS NULL UNION ALL SELECT doc, seq, 'label-mismatch' FROM m WHERE met IS NOT NULL AND coalesce(label, '') <> met_label
UNION ALL SELECT doc, seq, 'latex-mismatch' FROM m WHERE met IS NOT NULL AND flat <> met""",
    "relation_joins": """WITH r AS (SELECT p_partkey AS rid, p_size AS target FROM part WHERE p_partkey % 3 <> 0 AND p_size % 2 = 0)
SELECT target, count(*) AS formulas, count(s_name) AS with_note, min(coalesce(s_name, concat('[', l_suppkey::VARCHAR, ']'))) AS first_note
FROM lineitem JOIN r ON l_partkey = rid LEFT JOIN supplier ON s_suppkey = l_suppkey AND s_suppkey % 2 = 0 GROUP BY target""",
    "author_contributors": """SELECT c_custkey, 0::BIGINT AS pos, 'Иванов' AS surname, 'А.Б.' AS initials, c_custkey % 2 = 0 AS is_corresponding, 'aff_1' AS affiliations FROM customer
UNION ALL SELECT c_custkey, 1, concat('Smith', c_custkey::VARCHAR), 'C.', false, 'aff_1' FROM customer""",
    "image_hints": """WITH r AS (SELECT l_orderkey, (l_suppkey % 3)::VARCHAR AS h, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey) AS o FROM lineitem),
  f AS (SELECT l_orderkey, h, min(o) AS o FROM r GROUP BY 1, 2) SELECT l_orderkey, string_agg(h, '+' ORDER BY o) AS hints FROM f GROUP BY 1""",
    "natural_sort": "SELECT concat('eq', s_suppkey::VARCHAR, '.bin') AS name, row_number() OVER (ORDER BY s_suppkey) AS rank FROM supplier",
    "warning_topk": "SELECT event_type AS type, count(*) AS n, min(event_id) AS first_seen FROM events GROUP BY 1 ORDER BY n DESC, first_seen LIMIT 3",
    "imported_paragraphs": f"""WITH {_blocks} SELECT doc, idx, length(replace(text, ' ', '')) >= 2 AS kept, text <> '' AS kept_on_import, {_cap} AS caption, false AS figure_caption,
  {_cap} AS block_caption, text LIKE 'Fig.%' AS english_figure, {_cap} AS stop FROM b""",
}
