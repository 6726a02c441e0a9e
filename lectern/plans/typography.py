"""Queries over typography and text functions."""

from pyspark.sql import functions as F

from lectern.functions import search
from lectern.functions import text as X
from lectern.functions import typography as Y
from lectern.plans.base import derived, duck, table

NB = "\u00a0"
# Words that both engines cut out of row numbers, so that every rule has something to do.
RUSSIAN = """
SELECT l_orderkey AS k, l_linenumber AS n,
       concat('в  начале ', CAST(l_linenumber AS STRING), ' – ', CAST(l_partkey AS STRING), ' стр . и на юге – , от ',
              CASE WHEN l_linenumber % 2 = 0 THEN 'А. Б. Иванова' ELSE 'С. Петрова' END, ' к ', CAST(l_suppkey AS STRING), ' !') AS text
FROM {lineitem}"""
QUOTES = """SELECT l_orderkey AS k, l_linenumber AS n, concat('он сказал "да', CAST(l_linenumber AS STRING), '" и "', CAST(l_suppkey AS STRING), '"') AS text FROM {lineitem}"""
DASHES = """SELECT l_orderkey AS k, l_linenumber AS n, concat('стр. ', CAST(l_linenumber AS STRING), '--', CAST(l_partkey AS STRING), ' a--b --- c') AS text FROM {lineitem}"""
UNITS = """SELECT l_orderkey AS k, l_linenumber AS n, concat('№ ', CAST(l_linenumber AS STRING), ' и ', CAST(l_suppkey AS STRING), ' кг7') AS text FROM {lineitem}"""
EN = "a|an|in|on|at|by|to|of|or"
RU = Y.RU_PREPOSITIONS
SP = r"[\t-\r\x20\x{00a0}\x{feff}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def hang_sql(text: str) -> str:
    """Prepositions without look-behind: two marks after each blank, of which a match takes one and the next word sees the other."""
    text = rf"regexp_replace({text}, '({SP})', '\1' || chr(2) || chr(2), 'g')"
    text = rf"regexp_replace({text}, '(?i)(^|[^\p{{L}}\p{{M}}])({RU}){SP}' || chr(2), '\1\2{NB}', 'g')"
    text = rf"regexp_replace({text}, '(?i)(^|[^A-Za-z0-9_])({EN}){SP}' || chr(2), '\1\2{NB}', 'g')"
    return f"replace({text}, chr(2), '')"


def dash_sql(text: str) -> str:
    """En dashes of digit ranges set aside, all others lengthened."""
    kept = rf"regexp_replace(regexp_replace({text}, '([0-9]{SP}?)–', '\1' || chr(1), 'g'), '–({SP}?[0-9])', chr(1) || '\1', 'g')"
    return f"replace(replace({kept}, '–', '—'), chr(1), '–')"


def chain_sql(text: str) -> str:
    punct = rf"""regexp_replace({text}, ' +([,.;:!?)\]}}»"])', '\1', 'g')"""
    return f"regexp_replace({hang_sql(dash_sql(punct))}, ' {{2,}}', ' ', 'g')"


def typography_normalize(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", Y.normalize(F.col("text")).alias("normalized"))


def typography_russian(spark, sf_dir):
    return derived(spark, sf_dir, RUSSIAN).select("k", "n", Y.normalize(F.col("text")).alias("normalized"))


def typography_imported(spark, sf_dir):
    return derived(spark, sf_dir, RUSSIAN).select("k", "n", Y.imported_text(F.col("text")).alias("imported"))


def typography_quotes(spark, sf_dir):
    return derived(spark, sf_dir, QUOTES).select("k", "n", Y.russian_quotes(F.col("text")).alias("quoted"))


def typography_dashes(spark, sf_dir):
    return derived(spark, sf_dir, DASHES).select("k", "n", Y.typed_dashes(F.col("text")).alias("dashed"))


def typography_units(spark, sf_dir):
    return derived(spark, sf_dir, UNITS).select("k", "n", Y.unit_spaces(F.col("text")).alias("spaced"))


LABELS = """SELECT l_orderkey AS k, l_linenumber AS n, concat(CASE l_linenumber % 4 WHEN 0 THEN 'Рис. ' WHEN 1 THEN 'Рисунок ' WHEN 2 THEN '12. Пункт ' ELSE '3) Пункт ' END, CAST(l_suppkey AS STRING), ' Схема') AS text FROM {lineitem}"""


def figure_label_dot(spark, sf_dir):
    t = F.col("text")
    return derived(spark, sf_dir, LABELS).select("k", "n", Y.figure_label_dot(t).alias("fixed"), Y.is_numbered(t).alias("numbered"))


def markdown_blocks(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    styled = F.concat(F.element_at(F.array(*[F.lit(x) for x in ("## ", "> ", "- ", "3. ", "```", "")]), (F.col("pos") % 6 + 1).cast("int")), F.col("line"))
    return lines.select("doc_id", "pos", Y.markdown_block(styled).alias("block"))


def find_overlapping(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", search.count(t, "anan").cast("long").alias("n"))


def find_whole_word(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", search.count(t, "the", word=True).cast("long").alias("n"))


def find_regex(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", search.count(t, "th[a-e]+", case=True, regex=True).cast("long").alias("n"), search.count(t, "(", regex=True).cast("long").alias("invalid"))


def find_spans(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.inline(search.spans(F.col("text"), "idiot"))).select("doc_id", F.col("from").cast("long").alias("start"), F.col("to").cast("long").alias("stop"))


def find_replace_all(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", search.replace_all(t, "the", "$1 [x]", case=True).alias("replaced"), search.replace_first(t, "the", "T").alias("first"))


def find_cycle(spark, sf_dir):
    n, k = F.col("l_linenumber"), F.col("l_suppkey") % 7
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", search.cycled(k, 1, n).cast("long").alias("following"), search.cycled(k, -1, n).cast("long").alias("previous"))


QUERIES = {
    f.__name__: f
    for f in (
        typography_normalize, typography_russian, typography_imported, typography_quotes, typography_dashes, typography_units, figure_label_dot,
        markdown_blocks, find_overlapping, find_whole_word, find_regex, find_spans, find_replace_all, find_cycle,
    )
}

_imported = chain_sql(rf"""regexp_replace(regexp_replace(text, '[ \t]{{2,}}', ' ', 'g'), '[ \t]+([,.;:!?)\]}}»"])', '\1', 'g')""")
ORACLE_SQL = {
    "typography_normalize": f"SELECT doc_id, {chain_sql('text')} AS normalized FROM documents",
    "typography_russian": f"WITH d AS ({duck(RUSSIAN)}) SELECT k, n, {chain_sql('text')} AS normalized FROM d",
    "typography_imported": rf"WITH d AS ({duck(RUSSIAN)}) SELECT k, n, regexp_replace(regexp_replace({_imported}, '([А-ЯA-Z])\.{SP}([А-ЯA-Z][а-яa-zёЁ]+)', '\1.{NB}\2', 'g'), '([А-ЯA-Z])\.{SP}([А-ЯA-Z])\.', '\1.{NB}\2.', 'g') AS imported FROM d",
    "typography_quotes": f"""WITH d AS ({duck(QUOTES)}) SELECT k, n, concat('он сказал «да', n::VARCHAR, '» и «', regexp_extract(text, '([0-9]+)"$', 1), '»') AS quoted FROM d""",
    "typography_dashes": "SELECT l_orderkey AS k, l_linenumber AS n, concat('стр. ', l_linenumber::VARCHAR, '–', l_partkey::VARCHAR, ' a—b — c') AS dashed FROM lineitem",
    "typography_units": f"SELECT l_orderkey AS k, l_linenumber AS n, concat('№{NB}', l_linenumber::VARCHAR, ' и ', l_suppkey::VARCHAR, '{NB}кг7') AS spaced FROM lineitem",
    "figure_label_dot": f"WITH d AS ({duck(LABELS)}) SELECT k, n, CASE WHEN text LIKE 'Рис%' THEN replace(text, ' Схема', '. Схема') ELSE text END AS fixed, text LIKE '12. %' OR text LIKE '3) %' AS numbered FROM d",
    "markdown_blocks": """
WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents)
SELECT doc_id, pos::INT AS pos, CASE pos % 6 WHEN 0 THEN 'heading2' WHEN 1 THEN 'blockquote' WHEN 2 THEN 'bullet_list' WHEN 3 THEN 'ordered_list' WHEN 4 THEN 'code_block'
  ELSE CASE WHEN regexp_matches(line, '^[0-9]+[.]\\s') THEN 'ordered_list' WHEN regexp_matches(line, '^\\s*[-+*]\\s') THEN 'bullet_list' ELSE 'paragraph' END END AS block FROM lines""",
    "find_overlapping": "SELECT doc_id, (SELECT count(*) FROM range(length(text)) r(i) WHERE substr(lower(text), (i + 1)::INT, 4) = 'anan') AS n FROM documents",
    "find_whole_word": r"SELECT doc_id, len(regexp_extract_all(regexp_replace(lower(text), '([^\p{L}\p{M}\p{N}_])', '\1\1', 'g'), '(^|[^\p{L}\p{M}\p{N}_])the($|[^\p{L}\p{M}\p{N}_])')) AS n FROM documents",
    "find_regex": "SELECT doc_id, len(regexp_extract_all(text, 'th[a-e]+')) AS n, 0::BIGINT AS invalid FROM documents",
    "find_spans": """
WITH parts AS (SELECT doc_id, string_split(lower(text), 'idiot') AS p FROM documents), cuts AS (SELECT doc_id, p, unnest(range(1, len(p))) AS i FROM parts)
SELECT doc_id, (list_sum(list_transform(p[1:i], lambda x: length(x))) + 5 * (i - 1))::BIGINT AS start, (list_sum(list_transform(p[1:i], lambda x: length(x))) + 5 * i)::BIGINT AS stop FROM cuts""",
    "find_replace_all": "SELECT doc_id, replace(text, 'the', '$1 [x]') AS replaced, CASE WHEN strpos(text, 'the') > 0 THEN concat(substr(text, 1, strpos(text, 'the') - 1), 'T', substr(text, strpos(text, 'the') + 3)) ELSE text END AS first FROM documents",
    "find_cycle": "SELECT l_orderkey, l_linenumber, ((l_suppkey % 7 + 1) % l_linenumber)::BIGINT AS following, ((l_suppkey % 7 - 1 + l_linenumber) % l_linenumber)::BIGINT AS previous FROM lineitem",
}
