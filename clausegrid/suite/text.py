"""Queries over the text of documents: addresses, sections, topics, features, primitives, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import durations, primitives, textfeatures
from ..functions.hashing import compose, content_hash, normalise_source
from ..operators import project, semantic
from ..sources.documents import html_blocks
from . import demo
from .registry import query, table


@query("SELECT doc_id, 'lr1:' || sha256(text) AS hash, 'lr1:' || sha256('doc' || chr(31) || CAST(doc_id AS VARCHAR) || chr(31)) AS key FROM documents")
def q_doc_hash(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", content_hash(normalise_source(F.col("text"))).alias("hash"), compose("doc", F.col("doc_id")).alias("key"))


@query(f"WITH {demo.LINES} SELECT doc_id, ord, section_id, heading, char_start, length(text) AS chars FROM l")
def q_sections_lines(spark: SparkSession, sf: str) -> DataFrame:
    lines = project.split_lines(table(spark, sf, "documents"))
    return lines.select("doc_id", "ord", "section_id", F.regexp_extract("text", r"^[^.]*", 0).alias("heading"), "char_start", F.char_length("text").alias("chars"))


@query(r"""WITH b AS (
  SELECT page_id, generate_subscripts(t, 1) - 1 AS k, lower(unnest(t)) AS tag, trim(unnest(x), ' ') AS text
  FROM (SELECT page_id, regexp_extract_all(html, '(?is)<(h[1-6]|p|li)(?:\s[^>]*)?>([^<]*)', 1) AS t, regexp_extract_all(html, '(?is)<(h[1-6]|p|li)(?:\s[^>]*)?>([^<]*)', 2) AS x FROM pages)),
g AS (SELECT *, sum(CASE WHEN tag LIKE 'h%' THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY k) AS grp FROM b)
SELECT page_id AS doc_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY grp) - 1 AS INT) AS ord, coalesce(max(text) FILTER (tag LIKE 'h%'), '') AS heading,
       coalesce(string_agg(text, chr(10) ORDER BY k) FILTER (tag NOT LIKE 'h%'), '') AS text FROM g GROUP BY page_id, grp""")
def q_sections_pages(spark: SparkSession, sf: str) -> DataFrame:
    b = html_blocks(table(spark, sf, "pages")).withColumn("char_start", F.col("block_ord"))
    return project.group_by_heading(b).select("doc_id", "ord", "heading", "text")


@query(f"WITH {demo.SECTIONS} SELECT doc_id, section_id, primary_topic, topic_density, is_operative_for_topic, is_country_supplement FROM s")
def q_operative_section(spark: SparkSession, sf: str) -> DataFrame:
    return demo.sections(spark, sf).select("doc_id", "section_id", "primary_topic", "topic_density", "is_operative_for_topic", "is_country_supplement")


@query(f"""WITH {demo.LINES}, x AS (SELECT doc_id, section_id, unnest({demo.SCORES}) AS e FROM l)
SELECT doc_id, section_id, e.t AS topic, CAST(e.s AS DOUBLE) AS score FROM x WHERE e IS NOT NULL""")
def q_topic_scores(spark: SparkSession, sf: str) -> DataFrame:
    return demo.sections(spark, sf).select("doc_id", "section_id", F.explode("topic_scores").alias("topic", "score"))


@query(f"WITH {demo.SECTIONS} SELECT doc_id, category, count(*) AS n, string_agg(section_id, ',' ORDER BY section_id) AS ids FROM s GROUP BY ALL")
def q_categories(spark: SparkSession, sf: str) -> DataFrame:
    return project.categories(demo.sections(spark, sf)).select("doc_id", "category", F.size("section_ids").cast("bigint").alias("n"), F.array_join("section_ids", ",").alias("ids"))


_KINDS = (("romance", ("de la", "la ")), ("english", ("of the", "and ")), ("german", ("der ", "die ")))


@query(f"""WITH {demo.LINES}, v AS (
  SELECT doc_id, {', '.join(f"sum(CASE WHEN contains(lower(text), '{g}') THEN 1 ELSE 0 END) AS h{i}" for i, g in enumerate(g for _, gs in _KINDS for g in gs))} FROM l WHERE ord < 60 GROUP BY doc_id),
u AS (SELECT doc_id, unnest([{{'k': 'romance', 'n': h0 + h1, 'a': CASE WHEN h0 > 0 THEN 0 ELSE 1 END}}, {{'k': 'english', 'n': h2 + h3, 'a': CASE WHEN h2 > 0 THEN 2 ELSE 3 END}}, {{'k': 'german', 'n': h4 + h5, 'a': CASE WHEN h4 > 0 THEN 4 ELSE 5 END}}]) AS x FROM v)
SELECT doc_id, x.k AS kind, CAST(x.n AS BIGINT) AS votes FROM u WHERE x.n > 0 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY x.n DESC, x.a) = 1""")
def q_doc_kind(spark: SparkSession, sf: str) -> DataFrame:
    lines = project.split_lines(table(spark, sf, "documents")).withColumn("block_ord", F.col("ord"))
    return project.document_kinds(lines, _KINDS)


@query("""SELECT doc_id, CASE WHEN length(text) > 0 THEN array_to_string(list_transform(range(1, len(p) + 1), lambda i: CAST(CAST(coalesce(list_sum(list_transform(p[1:i - 1], lambda x: length(x) + 1)), 0) AS BIGINT) AS VARCHAR)), ',') ELSE '' END AS starts,
  CAST(CASE WHEN length(text) > 0 THEN len(p) ELSE 0 END AS BIGINT) AS n FROM (SELECT doc_id, text, string_split(text, chr(10)) AS p FROM documents)""")
def q_paragraph_offsets(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").withColumn("p", project.paragraph_offsets(F.col("text")))
    return docs.select("doc_id", F.array_join(F.transform("p", lambda x: x["char_start"].cast("string")), ",").alias("starts"), F.size("p").cast("bigint").alias("n"))


# ---- features of all documents and of clauses built from parts, since documents state few figures; the SQL takes them out of the
# same texts with its own functions and engine ----


def _clauses(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "part")
    days, pct, months = F.col("p_size"), F.col("p_size") % 20, F.col("p_partkey") % 12 + 1
    text = F.concat(
        F.lit("The buyer shall pay each invoice within "), days.cast("string"), F.lit(" days.\nLate fees are "), pct.cast("string"), F.lit("% per annum; a notice runs "), months.cast("string"),
        F.lit(" months.\nThe cyber cover is $"), F.floor("p_retailprice").cast("string"), F.lit(" thousand, the general liability cover $"), (days + 1).cast("string"), F.lit(" million, for two years."))
    docs = table(spark, sf, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("key"), "text")
    return docs.unionByName(t.select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("key"), text.alias("text")))


def _features(spark: SparkSession, sf: str, *names: str) -> DataFrame:
    f = textfeatures.text_features(F.col("text"))
    return _clauses(spark, sf).select("key", *(f[n].alias(n) for n in names))


_TEXTS = """t AS (SELECT 'd' || doc_id AS key, coalesce(text, '') AS text FROM documents UNION ALL
  SELECT 'p' || p_partkey, 'The buyer shall pay each invoice within ' || p_size || ' days.' || chr(10) || 'Late fees are ' || p_size % 20 || '% per annum; a notice runs ' || (p_partkey % 12 + 1) || ' months.' || chr(10)
    || 'The cyber cover is $' || CAST(floor(p_retailprice) AS BIGINT) || ' thousand, the general liability cover $' || (p_size + 1) || ' million, for two years.' FROM part)"""


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_WORDS = "CASE regexp_replace(lower(v), '[\\s-]+', ' ', 'g') " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in textfeatures.NUMBER_WORDS.items()) + " END"
_CLAUSES = r"""list_filter(flatten(list_transform(string_split(text, chr(10)), lambda x: CASE WHEN length(x) < 200 THEN [x] ELSE string_split(regexp_replace(x, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) END)), lambda x: x <> '')"""
#: ``textfeatures.DOLLAR`` with boundaries in place of its look ahead, which this engine lacks.
_DOLLAR = r"(?i)(?:\$|USD\s*\$?|CAD\s*\$?|US\$|CAD\$)\s*(\d{1,3}(?:[,\s]\d{3})*(?:\.\d+)?)\s*(million\b|billion\b|[mbk]\b)?"
_BY = "CASE lower(u) WHEN 'k' THEN 1e3 WHEN 'm' THEN 1e6 WHEN 'million' THEN 1e6 WHEN 'b' THEN 1e9 WHEN 'billion' THEN 1e9 ELSE 1 END"


def _stated(digits: str, words: str) -> str:
    return (f"list_sort(list_distinct(list_filter(list_concat(list_transform(regexp_extract_all(text, {_quoted(digits)}, 1), lambda v: CAST(v AS BIGINT)), "
            f"list_transform(regexp_extract_all(text, {_quoted(words)}, 1), lambda v: CAST({_WORDS} AS BIGINT))), lambda v: v IS NOT NULL)))")


def _amounts(text: str) -> str:
    def scaled(pattern: str) -> str:
        numbers, units = (f"regexp_extract_all({text}, {_quoted(pattern)}, {g})" for g in (1, 2))
        return f"list_transform(list_zip({numbers}, {units}), lambda z: CAST(round_even(CAST(regexp_replace(z[1], '[, ]', '', 'g') AS DOUBLE) * {_BY.replace('lower(u)', 'lower(z[2])')}, 0) AS BIGINT))"

    return f"list_concat({scaled(_DOLLAR)}, {scaled(textfeatures.DOLLAR_WORDS)})"


def _best(topic: str, values: str) -> str:
    return f"CAST(coalesce(list_max(flatten(list_transform(list_filter(c, lambda x: regexp_matches(x, {_quoted(topic)})), lambda x: {values}))), 0) AS BIGINT)"


def _day_values() -> str:
    return f"list_transform(regexp_extract_all(x, {_quoted(textfeatures.DAY)}, 1), lambda v: CAST(v AS BIGINT))"


@query(f"""WITH {_TEXTS}, f AS (SELECT key, {_CLAUSES} AS c, {_stated(textfeatures.DAY, textfeatures.DAY_WORDS)} AS d, {_stated(textfeatures.MONTH, textfeatures.MONTH_WORDS)} AS m, {_stated(textfeatures.YEAR, textfeatures.YEAR_WORDS)} AS y FROM t)
SELECT key, array_to_string(d, ',') AS day_counts, coalesce(list_max(d), 0) AS day_count_max, {_best(textfeatures.DAY_TOPICS['payment'], _day_values())} AS day_count_for_payment,
  {_best(textfeatures.DAY_TOPICS['notice'], _day_values())} AS day_count_for_notice, coalesce(list_min(m), 0) AS month_count_min, coalesce(list_max(y), 0) AS year_count_max FROM f""")
def q_features_days(spark: SparkSession, sf: str) -> DataFrame:
    out = _features(spark, sf, "day_counts", "day_count_max", "day_count_for_payment", "day_count_for_notice", "month_count_min", "year_count_max")
    return out.withColumn("day_counts", F.array_join(F.transform("day_counts", lambda v: v.cast("string")), ","))


@query(f"""WITH {_TEXTS}, f AS (SELECT key, list_zip(regexp_extract_all(text, {_quoted(textfeatures.PERCENT)}, 1), regexp_extract_all(text, {_quoted(textfeatures.PERCENT)}, 2)) AS z FROM t)
SELECT key, coalesce(list_max(list_transform(z, lambda p: round_even(CAST(p[1] AS DOUBLE), 4))), 0) AS percent_max,
  coalesce(list_max(list_transform(z, lambda p: round_even(CASE WHEN lower(p[2]) IN ('annum', 'year') THEN CAST(p[1] AS DOUBLE) / 12.0 ELSE CAST(p[1] AS DOUBLE) END, 4))), 0) AS percent_max_per_month FROM f""")
def q_features_percent(spark: SparkSession, sf: str) -> DataFrame:
    return _features(spark, sf, "percent_max", "percent_max_per_month")


@query(f"""WITH {_TEXTS}, f AS (SELECT key, {_CLAUSES} AS c, {_amounts('text')} AS a FROM t)
SELECT key, coalesce(list_min(a), 0) AS dollar_min, coalesce(list_max(a), 0) AS dollar_max, {', '.join(f"{_best(rx, _amounts('x'))} AS dollar_for_{k}" for k, rx in textfeatures.DOLLAR_TOPICS.items())} FROM f""")
def q_features_dollars(spark: SparkSession, sf: str) -> DataFrame:
    return _features(spark, sf, "dollar_min", "dollar_max", "dollar_for_cyber", "dollar_for_gcl", "dollar_for_professional")


@query(r"""SELECT doc_id, regexp_matches(text, '(?is)th.nd') AS rx, (contains(lower(text), 'nda') OR contains(lower(text), 'and the')) AS phrase,
  (contains(lower(text), 'tbd') OR contains(lower(text), 'tba') OR contains(lower(text), 'fill in')) AS boiler,
  CAST(len(list_filter(regexp_split_to_array(regexp_replace(text, '([0-9])([.!?])', '\1', 'g'), '[.!?](?:\s+|$)'), lambda s: len(list_filter(regexp_split_to_array(s, '\s+'), lambda w: length(w) > 0)) >= 8)) AS INT) AS sentences
FROM documents""")
def q_primitives(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf, "documents").select(
        "doc_id", primitives.regex_match(t, "th.nd").alias("rx"), primitives.phrase_match(t, ["NDA", "and the"]).alias("phrase"), primitives.is_template_boilerplate(t).alias("boiler"), primitives.count_prose_sentences(t).alias("sentences"))


_PROSE = r"len(list_filter(regexp_split_to_array(regexp_replace(text, '([0-9])([.!?])', '\1', 'g'), '[.!?](?:\s+|$)'), lambda s: len(list_filter(regexp_split_to_array(s, '\s+'), lambda w: length(w) > 0)) >= 8))"


@query(f"""WITH t AS (SELECT 'd' || doc_id AS key, text FROM documents UNION ALL
  SELECT 'p' || p_partkey, CASE WHEN p_size % 3 = 0 THEN 'Glossary of terms' ELSE 'Terms' END || chr(10) || CASE WHEN p_size % 5 = 0 THEN repeat('TLS Transport Layer Security' || chr(10), 4) ELSE 'TLS Transport Layer Security' || chr(10) END
    || CASE WHEN p_size % 2 = 0 THEN '(ARB-1) (ARB‑2 if required) to be completed by the team' ELSE '(ARB-1) only' END FROM part),
u AS (SELECT key, text, {_PROSE} AS prose, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') AS l FROM t)
SELECT key, regexp_matches(text, '\\S') AND prose <= 2 AND (len(list_filter(l, lambda x: regexp_matches(x, {_quoted(primitives.GLOSSARY)}))) > 0
    OR len(list_filter(l, lambda x: regexp_matches(x, {_quoted(primitives.ACRONYM_ROW)}) AND NOT regexp_matches(x, '[0-9%]'))) >= 4) AS glossary,
  regexp_matches(text, '\\S') AND prose <= 1 AND len(regexp_extract_all(text, {_quoted(primitives.REVIEW_TAG)})) + len(regexp_extract_all(text, {_quoted(primitives.TEMPLATE_PHRASE)})) >= 3 AS scaffold FROM u""")
def q_prim_scaffolding(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    row = "TLS Transport Layer Security\n"
    text = F.concat(F.when(F.col("p_size") % 3 == 0, "Glossary of terms\n").otherwise("Terms\n"), F.when(F.col("p_size") % 5 == 0, row * 4).otherwise(row),
                    F.when(F.col("p_size") % 2 == 0, "(ARB-1) (ARB‑2 if required) to be completed by the team").otherwise("(ARB-1) only"))
    docs = table(spark, sf, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("key"), "text")
    both = docs.unionByName(p.select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("key"), text.alias("text")))
    return both.select("key", primitives.is_glossary_listing(F.col("text")).alias("glossary"), primitives.is_review_scaffolding(F.col("text")).alias("scaffold"))


@query("""WITH t AS (SELECT doc_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9àâäáçéèêëíîïñóôöúûüùß]+'), lambda w: length(w) >= 3 AND NOT list_contains(['the','and','for','are','but','not','you','all','any','can','had','has','have','was','were','been','being','from','that','this','with','which','shall','should','must','will','may','upon','into','onto','also','only','such','than','then','when','where','while','these','those','their','there','them','they','because','however','therefore'], w))) AS w FROM documents)
SELECT doc_id, CAST(len(w) AS INT) AS n FROM t""")
def q_floor_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.size(primitives.floor_tokens(F.col("text"))).alias("n"))


_PHRASE = """CASE o_orderkey % 5 WHEN 0 THEN 'Every ' || (o_orderkey % 400 + 1) || ' days.' WHEN 1 THEN ' on a 90-day   cycle' WHEN 2 THEN 'p' || (o_orderkey % 50) || 'W'
  WHEN 3 THEN CASE WHEN o_orderkey % 3 = 0 THEN 'Quarterly;' WHEN o_orderkey % 3 = 1 THEN 'every  TWO years' ELSE o_orderpriority END ELSE 'on a ' || (o_orderkey % 30 + 1) || ' day basis' END"""


@query(f"""WITH p AS (SELECT o_orderkey, {_PHRASE} AS phrase FROM orders), c AS (SELECT *, lower(regexp_replace(regexp_replace(trim(phrase, ' '), '[.,;]+$', ''), '\\s+', ' ', 'g')) AS low FROM p)
SELECT o_orderkey, CAST(CASE WHEN length(phrase) >= 3 AND lower(phrase[1]) = 'p' THEN coalesce(try_cast(nullif(regexp_extract(trim(phrase, ' '), '(?i)^P(\\d+)W$', 1), '') AS BIGINT) * 7, try_cast(nullif(regexp_extract(trim(phrase, ' '), '(?i)^P(\\d+)D$', 1), '') AS BIGINT))
  ELSE coalesce(CASE low {' '.join(f"WHEN '{k}' THEN {v}" for k, v in durations.PHRASES.items())} END,
    nullif(try_cast(nullif(regexp_extract(low, {_quoted(durations.EVERY_N)}, 1), '') AS INT), 0), nullif(try_cast(nullif(regexp_extract(low, {_quoted(durations.ON_N)}, 1), '') AS INT), 0)) END AS BIGINT) AS days FROM c""")
def q_duration_normalize(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    n = lambda c: c.cast("string")
    other = F.when(k % 3 == 0, "Quarterly;").when(k % 3 == 1, "every  TWO years").otherwise(F.col("o_orderpriority"))
    phrase = (F.when(k % 5 == 0, F.concat(F.lit("Every "), n(k % 400 + 1), F.lit(" days."))).when(k % 5 == 1, F.lit(" on a 90-day   cycle"))
              .when(k % 5 == 2, F.concat(F.lit("p"), n(k % 50), F.lit("W"))).when(k % 5 == 3, other).otherwise(F.concat(F.lit("on a "), n(k % 30 + 1), F.lit(" day basis"))))
    return table(spark, sf, "orders").select("o_orderkey", durations.to_days(phrase).cast("bigint").alias("days"))


@query(r"""WITH w AS (
  SELECT doc_id, k, list_filter(regexp_extract_all(lower(s), '[\p{L}\p{N}][\p{L}\p{N}''\-]*'), lambda w: NOT list_contains(['the', 'of', 'and'], w) AND NOT regexp_matches(w, '^[0-9]{1,2}$')) AS w
  FROM (SELECT doc_id, generate_subscripts(p, 1) AS k, unnest(p) AS s FROM (SELECT doc_id, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS p FROM documents))),
g AS (SELECT doc_id, k, generate_subscripts(w, 1) AS i, unnest(w) AS token, 1 AS ngram FROM w
      UNION ALL SELECT doc_id, k, unnest(range(1, len(w))), unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])), 2 FROM w WHERE len(w) >= 2),
f AS (SELECT doc_id, token, ngram, count(*) AS tf, min(k * 1000000 + i) AS first FROM g GROUP BY ALL)
SELECT doc_id AS section_id, token, ngram, tf FROM f QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY tf DESC, first, token) <= 256""")
def q_tokens_tf(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("section_id"), "text")
    return semantic.section_tokens(d, ["the", "of", "and"]).select("section_id", "token", "ngram", "tf")


@query("""WITH h AS (SELECT conv_id AS doc_id, role AS title, CAST(length(text) % 3 + 1 AS INT) AS level, CAST(turn * 10 AS INT) AS start FROM conversations)
SELECT a.doc_id, printf('n_%08x', a.start) AS node_id, (SELECT printf('n_%08x', max(b.start)) FROM h b WHERE b.doc_id = a.doc_id AND b.start < a.start AND b.level < a.level) AS parent_id, a.title, a.level, a.start,
  coalesce((SELECT min(b.start) FROM h b WHERE b.doc_id = a.doc_id AND b.start > a.start AND b.level <= a.level), 1000) AS "end" FROM h a""")
def q_tree(spark: SparkSession, sf: str) -> DataFrame:
    h = table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("role").alias("title"), (F.char_length("text") % 3 + 1).alias("level"), (F.col("turn") * 10).cast("int").alias("start"), F.lit(1000).alias("doc_end"))
    return project.document_tree(h)
