"""Queries over document trees, navigation, rights, tiers and edit streams."""

from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators import documents as D
from lectern.plans.base import derived, duck, spread, table
from lectern.streaming.edits import latest_state, save_points

ITEMS = """
SELECT o_custkey AS doc, o_orderkey AS idx, CASE o_orderkey % 4 WHEN 0 THEN 'heading' WHEN 1 THEN 'figure_block' WHEN 2 THEN 'table_block' ELSE 'math_block' END AS type,
  concat('id', CAST(o_orderkey AS STRING)) AS id, CAST(o_orderkey % 3 + 1 AS INT) AS level, CASE WHEN o_orderkey % 8 = 0 THEN 'results' ELSE 'references' END AS section_type,
  concat('Heading ', CAST(o_orderkey AS STRING)) AS text, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE concat('(', CAST(o_orderkey AS STRING), ')') END AS label FROM {orders}"""


def navigation_groups(spark, sf_dir):
    kind, n = F.col("type"), F.col("idx").cast("string")
    english = F.struct(F.lit("en").alias("lang"), F.concat(F.lit("Figure "), n, F.lit(" A plot")).alias("text"))
    russian = F.struct(F.lit(None).cast("string").alias("lang"), F.concat(F.when(kind == "figure_block", "Рис. ").otherwise("Табл. "), n, F.lit("а. Подпись")).alias("text"))
    items = derived(spark, sf_dir, ITEMS).withColumn("captions", F.array(english, russian))
    nav = D.navigation(items, "doc")
    return nav.select("doc", "place", "group", F.size("items").alias("n"), F.array_join("items.label", "|").alias("labels"))


def heading_ids(spark, sf_dir):
    headings = derived(spark, sf_dir, ITEMS).where("type = 'heading'")
    return D.heading_ids(headings, "doc", "idx", "text", "level").select("doc", "idx", "heading_id")


def rights_inherit(spark, sf_dir):
    """Documents are customers, blocks their orders, paragraphs the lines of those."""
    docs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc"), F.lit("all rights").alias("rights"))
    blocks = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("block"), F.when(F.col("o_orderkey") % 3 == 0, "CC-BY").alias("rights"))
    lines = table(spark, sf_dir, "lineitem").join(blocks.select("doc", "block"), F.col("l_orderkey") == F.col("block"))
    paragraphs = lines.select("doc", "block", F.col("l_linenumber").alias("par"), F.when(F.col("l_linenumber") % 4 == 0, "CC0").alias("rights"))
    return D.inherited_rights(docs, blocks, paragraphs).groupBy("doc", "effective").agg(F.count("*").alias("n"))


def quality_tiers(spark, sf_dir):
    c = F.col
    k, n = c("c_custkey"), c("c_nationkey")
    tier = D.quality_tier(k % 5 != 0, (n % 11) / 10, (n % 7) / 6, k % 3 != 0, k % 2 == 0, k % 4 == 0, ((k % 8 == 0).cast("double")), k % 16 == 0)
    return table(spark, sf_dir, "customer").select("c_custkey", tier.alias("tier"))


def jats_export(spark, sf_dir):
    name, key = F.col("c_name"), F.col("c_custkey").cast("string")
    xml = D.jats(name, F.lit("a < b"), F.array(F.lit("k1"), key), F.array(name), F.array(F.lit("p & q")), F.array(F.concat(F.lit("ref "), key)), F.lit("research"))
    return table(spark, sf_dir, "customer").select("c_custkey", xml.alias("xml"))


def html_export(spark, sf_dir):
    """Pages of a title, marks, formulas, a table with the caption before it, figures and lists."""
    text = lambda t: F.concat(F.lit('{"type":"text","text":"'), t, F.lit('"}'))
    even = F.col("c_custkey") % 2 == 0
    title = F.concat(F.lit('{"type":"heading","attrs":{"level":1},"content":['), text(F.col("c_name")), F.lit("]}"))
    tree = F.concat(
        F.lit('{"type":"doc","content":['), F.when(even, title).otherwise(F.concat(F.lit('{"type":"horizontal_rule"},'), title)),
        F.lit(',{"type":"paragraph","content":[{"type":"text","text":"a<b","marks":[{"type":"italic"},{"type":"bold"}]},{"type":"math_inline","attrs":{"latex":"x_'), F.col("c_nationkey"),
        F.lit('"}}]},{"type":"math_block","attrs":{"latex":"y","label":"(1)"}},{"type":"paragraph","attrs":{"styleType":"table-caption"},"content":['), text(F.lit("T 1")),
        F.lit(']},{"type":"table","content":[{"type":"table_row","content":[{"type":"table_header","attrs":{"colspan":2},"content":[{"type":"paragraph","content":['), text(F.col("c_nationkey").cast("string")),
        F.lit(']}]}]}]},{"type":"figure_block","attrs":{"id":"f"},"content":[{"type":"figure_image","attrs":{"src":"s","title":"t"}},{"type":"figcaption","attrs":{"lang":"en"},"content":['), text(F.lit("Fig")),
        F.lit(']}]},{"type":"ordered_list","attrs":{"order":3},"content":[{"type":"list_item","content":[{"type":"paragraph","attrs":{"align":"center"},"content":['), text(F.lit("i")), F.lit("]}]}]}]}"),
    )
    page = D.export_html(tree)
    pages = spread(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey"), "c_custkey").select("c_custkey", page.alias("page"))
    page = F.col("page")
    return pages.select("c_custkey", F.regexp_extract(page, "(?s)<main>\n(.*)\n</main>", 1).alias("body"), F.regexp_extract(page, "<title>(.*)</title>", 1).alias("title"))


def tree_violations(spark, sf_dir):
    """Trees of a figure with as many captions as the key says; more than two are too many."""
    captions = F.array_join(F.transform(F.sequence(F.lit(0), (F.col("c_custkey") % 5).cast("int")), lambda i: F.lit('{"type":"figcaption"}')), ",")
    tree = F.concat(F.lit('{"type":"doc","content":[{"type":"figure_block","content":[{"type":"figure_image"},'), captions, F.lit("]}]}"))
    rows = D.nodes(spread(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey").select("c_custkey", tree.alias("tree")), "c_custkey", "tree")
    return D.violations(rows, "c_custkey").select("c_custkey", "type")


def micros(ts: str):
    """Microseconds since 1970, whatever the session's time zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST({ts} AS TIMESTAMP_NTZ))")


def event_sessions(spark, sf_dir):
    edits = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc"), "ts")
    return save_points(edits, gap="30 minutes").select("doc", micros("started").alias("started"), micros("saved_at").alias("saved_at"), "edits")


def event_states(spark, sf_dir):
    edits = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc"), F.col("event_id").alias("seq"), F.col("event_type").alias("text"))
    return latest_state(edits)


def figure_placeholders(spark, sf_dir):
    figures = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("fig"), F.concat(F.lit("old"), "o_orderkey").alias("src"), (F.col("o_orderkey") % 2 == 0).alias("placeholder"))
    images = table(spark, sf_dir, "orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("fig"), F.when(F.col("o_orderkey") % 4 == 0, "javascript:x").otherwise("https://img/x.png").alias("src"))
    return D.filled_placeholders(figures, images, ["fig"])


def styled_paragraphs(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.lit("left").alias("align"))
    return D.styled_range(rows, "o_custkey", "o_orderkey", F.col("o_custkey") * 2, F.col("o_custkey") * 8, align="center")


def conversation_sections(spark, sf_dir):
    """Turns under the last user turn before them: the running heading over a real table."""
    from lectern.operators.captions import sections

    turns = table(spark, sf_dir, "conversations").withColumn("opened", F.when(F.col("role") == "user", F.col("turn")))
    return sections(turns, "conv_id", "turn", "opened").select("conv_id", "turn", "role", F.col("section").alias("under"))


def slugs_of_pages(spark, sf_dir):
    head = F.regexp_extract("html", r"(?is)<h1[^>]*>(.*?)</h1>", 1)
    return table(spark, sf_dir, "pages").select("page_id", X.heading_slug(F.regexp_replace(head, "<[^>]*>", "")).alias("slug"))


QUERIES = {
    f.__name__: f
    for f in (
        navigation_groups, heading_ids, rights_inherit, quality_tiers, jats_export, html_export, tree_violations, event_sessions, event_states, figure_placeholders, styled_paragraphs,
        conversation_sections, slugs_of_pages,
    )
}

_items = f"i AS ({duck(ITEMS)})"
ORACLE_SQL = {
    "navigation_groups": f"""WITH {_items}, g AS (SELECT DISTINCT doc, unnest([0, 1, 2, 3]) AS place FROM i), n AS (SELECT doc, idx, CASE type WHEN 'heading' THEN 0 WHEN 'figure_block' THEN 1 WHEN 'table_block' THEN 2 ELSE 3 END AS place,
  CASE type WHEN 'heading' THEN text WHEN 'figure_block' THEN concat('Рис. ', idx::VARCHAR, 'а') WHEN 'table_block' THEN concat('Табл. ', idx::VARCHAR, 'а') ELSE label END AS label
  FROM i WHERE (type = 'heading' AND section_type = 'results') OR type IN ('figure_block', 'table_block') OR (type = 'math_block' AND label IS NOT NULL))
SELECT g.doc, g.place, ['sections', 'figures', 'tables', 'formulas'][g.place + 1] AS "group", count(n.idx)::INT AS n, coalesce(string_agg(n.label, '|' ORDER BY n.idx), '') AS labels
FROM g LEFT JOIN n ON g.doc = n.doc AND g.place = n.place GROUP BY g.doc, g.place""",
    "heading_ids": f"WITH {_items} SELECT doc, idx, concat('heading-', idx::VARCHAR, '-', (row_number() OVER (PARTITION BY doc ORDER BY idx))::VARCHAR) AS heading_id FROM i WHERE type = 'heading'",
    "rights_inherit": """SELECT o_custkey AS doc, CASE WHEN l_linenumber % 4 = 0 THEN 'CC0' WHEN o_orderkey % 3 = 0 THEN 'CC-BY' ELSE CASE WHEN c_custkey IS NOT NULL THEN 'all rights' END END AS effective, count(*) AS n
FROM lineitem JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2""",
    "quality_tiers": """WITH s AS (SELECT c_custkey AS k, c_custkey % 5 <> 0 AND (c_nationkey % 11) / 10.0 >= 0.5 AND (c_nationkey % 7) / 6.0 >= 0.5 AND c_custkey % 3 <> 0 AS silver, (c_nationkey % 11) / 10.0 >= 0.8 AND c_custkey % 8 = 0 AS more FROM customer)
SELECT k AS c_custkey, CASE WHEN silver AND more AND k % 16 = 0 THEN 'platinum' WHEN silver AND more THEN 'gold' WHEN silver THEN 'silver' ELSE 'bronze' END AS tier FROM s""",
    "jats_export": """SELECT c_custkey, concat('<article article-type="research"><front><article-meta><title-group><article-title>', c_name, '</article-title></title-group><contrib-group><contrib>', c_name,
  '</contrib></contrib-group><abstract>a &lt; b</abstract><kwd-group><kwd>k1</kwd><kwd>', c_custkey::VARCHAR, '</kwd></kwd-group></article-meta></front><body><sec><p>p &amp; q</p></sec></body><back><ref-list><ref>ref ',
  c_custkey::VARCHAR, '</ref></ref-list></back></article>') AS xml FROM customer""",
    "html_export": r"""SELECT c_custkey, concat(CASE WHEN c_custkey % 2 = 0 THEN '' ELSE concat('<hr>', chr(10), '<h1 id="', lower(regexp_replace(c_name, '[^A-Za-z0-9]+', '-', 'g')), '-1">', c_name, '</h1>', chr(10)) END,
  '<p><em><strong>a&lt;b</strong></em><span class="math-inline">\(x_', c_nationkey::VARCHAR, '\)</span></p>', chr(10), '<div class="formula"><div class="formula-body">\[y\]</div><span class="formula-label">(1)</span></div>', chr(10),
  '<table><caption>T 1</caption><tbody><tr><th colspan="2"><p>', c_nationkey::VARCHAR, '</p></th></tr></tbody></table>', chr(10),
  '<figure data-schema-v2 class="figure-block" id="f"><img class="figure-block-img" src="s" alt="" title="t"><figcaption class="figure-caption-en" lang="en">Fig</figcaption></figure>', chr(10),
  '<ol start="3"><li><p style="text-align:center">i</p></li></ol>') AS body, c_name AS title FROM customer""",
    "tree_violations": "SELECT c_custkey, 'figure_block' AS type FROM customer WHERE c_custkey % 5 >= 2",
    "event_sessions": """WITH e AS (SELECT user_id AS doc, epoch_us(ts) AS t, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events),
  s AS (SELECT doc, t, sum(CASE WHEN before IS NULL OR t - before >= 1800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT doc, min(t) AS started, max(t) + 1800000000 AS saved_at, count(*) AS edits FROM s GROUP BY doc, k""",
    "event_states": "SELECT user_id AS doc, arg_max(event_type, event_id) AS text, max(event_id) AS seq, count(*) AS edits FROM events GROUP BY 1",
    "figure_placeholders": """SELECT o_orderkey AS fig, CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 3 = 0 AND o_orderkey % 4 <> 0 THEN 'https://img/x.png' ELSE concat('old', o_orderkey::VARCHAR) END AS src,
  o_orderkey % 2 = 0 AND NOT (o_orderkey % 3 = 0 AND o_orderkey % 4 <> 0) AS placeholder FROM orders""",
    "styled_paragraphs": "SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey BETWEEN o_custkey * 2 AND o_custkey * 8 THEN 'center' ELSE 'left' END AS align FROM orders",
    "conversation_sections": "SELECT conv_id, turn, role, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS under FROM conversations",
    "slugs_of_pages": r"""SELECT page_id, substr(regexp_replace(regexp_replace(lower(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]*>', '', 'g')), '[^\p{L}\p{N}]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 48) AS slug FROM pages""",
}
