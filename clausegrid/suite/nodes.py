"""Queries over JSON nodes, vectors and streams of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import semantic
from ..operators.sized import spread
from ..plans import selectors
from ..streaming.review import event_counts
from . import demo
from .registry import query, table


def _graph(spark: SparkSession, sf: str) -> DataFrame:
    """Events as small documents: {"sections": [{"category", "score", "props"}, {"category", "score": text}, {"note": null}]}."""
    e = table(spark, sf, "events")
    text = F.concat(F.lit('{"sections":[{"category":"'), "event_type", F.lit('","score":'), F.round("value", 2).cast("string"), F.lit(',"props":'), "props",
                    F.lit('},{"category":"fixed","score":"high"},{"note":null}]}'))
    return e.select("event_id", "event_type", "value", F.parse_json(text).alias("doc"))


def _paths(found):
    return F.array_join(F.transform(found, lambda x: x["path"]), ",")


def _selected(spark, sf, found) -> DataFrame:
    return _graph(spark, sf).select("event_id", _paths(found).alias("paths"))


@query("SELECT event_id, '$.sections[0].props.k' AS paths, CAST(props ->> '$.k' AS BIGINT) AS k FROM events")
def q_sel_path(spark: SparkSession, sf: str) -> DataFrame:
    found = selectors.json_matches(F.col("doc"), "$.sections[*].props.k")
    return _graph(spark, sf).select("event_id", _paths(found).alias("paths"), F.variant_get(found[0]["node"], "$", "bigint").alias("k"))


@query("SELECT event_id, CASE WHEN event_type = 'click' THEN '$.sections[0]' ELSE '' END AS paths FROM events")
def q_sel_filter(spark: SparkSession, sf: str) -> DataFrame:
    return _selected(spark, sf, selectors.json_matches(F.col("doc"), "$.sections[?(@.category == 'click')]"))


@query("SELECT event_id, CASE WHEN event_type <> 'click' THEN '$.sections[0],$.sections[1]' ELSE '$.sections[1]' END AS paths FROM events")
def q_sel_missing_field(spark: SparkSession, sf: str) -> DataFrame:
    """The third section has no category: it fails ``!=`` too."""
    return _selected(spark, sf, selectors.json_matches(F.col("doc"), "$.sections[?(@.category != 'click')]"))


@query("SELECT event_id, CASE WHEN round(value, 2) < 50 THEN '$.sections[0],$.sections[1]' ELSE '$.sections[1]' END AS paths FROM events")
def q_sel_numeric(spark: SparkSession, sf: str) -> DataFrame:
    """A text under a numeric comparison is below all numbers."""
    return _selected(spark, sf, selectors.json_matches(F.col("doc"), "$.sections[?(@.score < 50)]"))


@query("SELECT event_id, CASE WHEN contains(event_type, 'i') THEN '$.sections[0].category,$.sections[1].category' ELSE '$.sections[1].category' END AS paths FROM events")
def q_sel_regex(spark: SparkSession, sf: str) -> DataFrame:
    return _selected(spark, sf, selectors.regex_nodes(F.col("doc"), "$.sections[*].category", "i"))


@query("""SELECT event_id, CASE WHEN event_type LIKE '%i%' AND value > 50 THEN '$.sections[0],$.sections[1]' WHEN event_type LIKE '%i%' THEN '$.sections[0]' WHEN value > 50 THEN '$.sections[1]' ELSE '' END AS paths FROM events""")
def q_sel_has_field(spark: SparkSession, sf: str) -> DataFrame:
    """A key counts whatever is under it, null included."""
    text = F.concat(F.lit('{"sections":[{"'), F.when(F.col("event_type").contains("i"), "note").otherwise("other"), F.lit('":null},{"'), F.when(F.col("value") > 50, "note").otherwise("other"), F.lit('":"x"}]}'))
    docs = table(spark, sf, "events").select("event_id", F.parse_json(text).alias("doc"))
    return docs.select("event_id", _paths(selectors.has_field(F.col("doc"), "$.sections[*]", "note")).alias("paths"))


@query("""SELECT event_id, CASE WHEN event_type = 'click' THEN '' ELSE '$.sections[0].category,' END || '$.sections[0].props.k,$.sections[0].score,$.sections[1].category' AS paths,
  CASE WHEN contains(event_type, 'ic') THEN '$.sections[0].category,' ELSE '' END || '$.sections[1].score' AS found FROM events""")
def q_sel_leaves(spark: SparkSession, sf: str) -> DataFrame:
    """The leaves that two selectors leave, and the text leaves with a pattern, wherever they stand."""
    d = F.col("doc")
    gone = selectors.select_any(selectors.json_matches(d, "$.sections[1].score"), selectors.value_in(d, "$.sections[*].category", ["click"]))
    return _graph(spark, sf).select("event_id", _paths(selectors.select_not(d, gone)).alias("paths"), _paths(selectors.regex_nodes(d, None, "ic|gh")).alias("found"))


@query("SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN '$.sections[0].category' ELSE '' END AS paths FROM events")
def q_sel_value_in(spark: SparkSession, sf: str) -> DataFrame:
    return _selected(spark, sf, selectors.value_in(F.col("doc"), "$.sections[*].category", ["click", "view", "none"]))


@query("SELECT event_id, CASE WHEN event_type = 'click' AND round(value, 2) < 50 THEN '$.sections[0]' ELSE '' END AS paths FROM events")
def q_sel_all(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("doc")
    return _selected(spark, sf, selectors.select_all(selectors.json_matches(d, "$.sections[?(@.category == 'click')]"), selectors.json_matches(d, "$.sections[?(@.score < 50)]")))


@query("SELECT event_id, CASE WHEN event_type = 'click' THEN '$.sections[0],$.sections[1]' ELSE '$.sections[1]' END AS paths FROM events")
def q_sel_any(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("doc")
    return _selected(spark, sf, selectors.select_any(selectors.json_matches(d, "$.sections[?(@.category == 'click')]"), selectors.json_matches(d, "$.sections[1]")))


@query(f"WITH {demo.SECTIONS} SELECT doc_id, section_id FROM s WHERE category = 'supply' OR ord = 2")
def q_sel_sections(spark: SparkSession, sf: str) -> DataFrame:
    s = demo.sections(spark, sf)
    either = {"kind": "any", "of": [{"kind": "path", "path": "$.sections[?(@.category == 'supply')]"}, {"kind": "path", "path": "$.sections[2]"}]}
    return s.where(selectors.section_selector(either, lambda p: F.col(p), F.col("ord"))).select("doc_id", "section_id")


@query("""SELECT a.vec_id AS query_id, b.vec_id AS item_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS similarity
FROM embeddings a CROSS JOIN embeddings b WHERE a.vec_id % 50 = 0""")
def q_cosine(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return semantic.similarities(q, spread(e.select(F.col("vec_id").alias("item_id"), "embedding")), 6)


@query("""WITH s AS (SELECT a.vec_id AS query_id, b.vec_id AS item_id, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS c FROM embeddings a CROSS JOIN embeddings b WHERE a.vec_id % 50 = 0)
SELECT query_id, item_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY c DESC, item_id) AS INT) AS rank FROM s QUALIFY rank <= 5""")
def q_semantic_topk(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return semantic.top_k(q, spread(e.select(F.col("vec_id").alias("item_id"), "embedding")), 5).select("query_id", "item_id", "rank")


@query("""SELECT b.vec_id AS section_id, CAST(a.vec_id AS VARCHAR) AS concept, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) >= 0.3 AS holds FROM embeddings a CROSS JOIN embeddings b WHERE a.vec_id < 4""")
def q_contains_meaning(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    c = e.where("vec_id < 4").select(F.col("vec_id").cast("string").alias("concept"), F.col("embedding").alias("vector"))
    return semantic.contains_meaning(e.select(F.col("vec_id").alias("section_id"), "embedding"), c, 0.3).select("section_id", "concept", "holds")


@query("""WITH t AS (SELECT vec_id // 20 AS section_id, 't' || vec_id AS token, vec_id % 2 + 1 AS ngram, vec_id % 20 AS place, embedding FROM embeddings),
p AS (SELECT section_id, a.vec_id AS anchor, token, place, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(t.embedding AS DOUBLE[])) AS c FROM t CROSS JOIN embeddings a WHERE a.vec_id IN (7, 8) AND ngram = 1)
SELECT section_id, anchor, token, CAST(row_number() OVER (PARTITION BY section_id, anchor ORDER BY c DESC, place, token) AS INT) AS rank FROM p WHERE c >= 0.05 QUALIFY rank <= 3""")
def q_anchor_bindings(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    v = F.col("vec_id")
    t = e.select((v / 20).cast("bigint").alias("section_id"), F.concat(F.lit("t"), v.cast("string")).alias("token"), (v % 2 + 1).cast("int").alias("ngram"), (v % 20).alias("char_start"), "embedding")
    a = e.where("vec_id in (7, 8)").select(v.alias("anchor"), F.col("embedding").alias("vector"), F.lit(0.1).alias("threshold"), F.array(F.lit(1)).alias("ngrams"))
    return semantic.bindings(t, a, minimum=0.05, offset=0.06).select("section_id", "anchor", "token", "rank")


@query("""WITH s AS (SELECT vec_id // 10 AS doc_id, vec_id % 10 AS ord, 'label' || label AS topic, embedding FROM embeddings),
a AS (SELECT 'label' || label AS topic, vec_id AS anchor, embedding AS v FROM embeddings WHERE vec_id < 6),
absent AS (SELECT d.doc_id, t.topic FROM (SELECT DISTINCT doc_id FROM s) d CROSS JOIN (SELECT DISTINCT topic FROM a) t WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.doc_id = d.doc_id AND s.topic = t.topic)),
b AS (SELECT s.doc_id, a.topic, s.ord, max(list_cosine_similarity(CAST(a.v AS DOUBLE[]), CAST(s.embedding AS DOUBLE[]))) AS c FROM s CROSS JOIN a GROUP BY ALL)
SELECT b.doc_id, b.topic, printf('s_%08d', b.ord) AS synthetic_from, 's_synthetic_' || b.topic || '_' || printf('%04d', row_number() OVER (PARTITION BY b.doc_id, b.topic ORDER BY b.ord)) AS section_id
FROM b JOIN absent USING (doc_id, topic) WHERE c >= 0.1""")
def q_synthetic_sections(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    v, topic = F.col("vec_id"), F.concat(F.lit("label"), F.col("label").cast("string"))
    s = e.select((v / 10).cast("bigint").alias("doc_id"), (v % 10).cast("int").alias("ord"), F.format_string("s_%08d", (v % 10).cast("int")).alias("section_id"), topic.alias("primary_topic"),
                 F.create_map(topic, F.lit(0.9)).alias("topic_scores"), "embedding", F.lit("").alias("text"))
    a = e.where("vec_id < 6").select(topic.alias("topic"), v.cast("string").alias("anchor"), F.col("embedding").alias("vector"))
    return semantic.synthetic_sections(s, a, least=0.1).select("doc_id", "topic", "synthetic_from", "section_id")


@query("SELECT time_bucket(INTERVAL 1 hour, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def q_event_windows(spark: SparkSession, sf: str) -> DataFrame:
    return event_counts(table(spark, sf, "events"))
