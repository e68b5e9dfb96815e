"""Queries over what stands around rules: names, phrases, amendments, kinds, anchors, vectors, rule sets as tables, Markdown."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import hashing, primitives, vectors
from ..operators import authoring, evaluate, facts, governance, project, semantic
from ..operators.evaluate import Options, Rule, RuleSet
from ..plans import selectors
from ..sources import documents, store
from . import demo
from .registry import query, table


@query(r"""WITH t AS (SELECT doc_id, text, trim(CASE WHEN regexp_matches(text, '[.!?]') THEN regexp_extract(text, '(?s)^[^.!?]*[.!?]') ELSE text END, ' ') AS s FROM documents)
SELECT doc_id, s AS sentence, CASE WHEN length(s) > 200 THEN substring(s, 1, 199) || '…' ELSE s END AS synopsis, sha256(lower(regexp_replace(trim(text, ' '), '\s+', ' ', 'g'))) AS key,
  regexp_replace(regexp_replace(lower(trim(s, ' ')), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM t""")
def q_sentences_keys(spark: SparkSession, sf: str) -> DataFrame:
    first, t = primitives.first_sentence(F.col("text")), F.col("text")
    return table(spark, sf, "documents").select("doc_id", first.alias("sentence"), authoring.synopsis(t).alias("synopsis"), F.sha2(semantic.similarity_key(t), 256).alias("key"), authoring.slug(first).alias("slug"))


@query("SELECT p_partkey, CASE WHEN p_size % 8 = 0 THEN CAST(p_size // 8 AS VARCHAR) ELSE rtrim(printf('%.4f', p_size / 8.0), '0') END AS n FROM part")
def q_format_number(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", primitives.format_number(F.col("p_size") / 8.0).alias("n"))


_PARTIES = """p AS (SELECT s_suppkey % 10 AS doc_id, s_suppkey AS block_ord, n_name || ' Holdings Ltd ("Buyer' || s_suppkey % 7 || '") pays and "Seller" (Acme Corp) delivers to Buyer' || s_suppkey % 7 || 'x and Buyer' || s_suppkey % 5 || '.' AS text
  FROM supplier JOIN nation ON s_nationkey = n_nationkey),
a AS (SELECT doc_id, regexp_extract(text, '"(Buyer[0-9]+)"', 1) AS alias, arg_min(regexp_extract(text, '^(.*) \\("', 1), block_ord) AS canonical FROM p GROUP BY ALL)"""


def _parties(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    joined = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return joined.select((k % 10).alias("doc_id"), k.alias("block_ord"), F.concat(
        "n_name", F.lit(' Holdings Ltd ("Buyer'), (k % 7).cast("string"), F.lit('") pays and "Seller" (Acme Corp) delivers to Buyer'), (k % 7).cast("string"), F.lit("x and Buyer"), (k % 5).cast("string"), F.lit(".")).alias("text"))


@query(f"WITH {_PARTIES} SELECT * FROM a")
def q_party_aliases(spark: SparkSession, sf: str) -> DataFrame:
    return project.party_aliases(_parties(spark, sf))


@query(f"""WITH {_PARTIES}, l AS (SELECT doc_id, list(alias ORDER BY alias) AS names, list(canonical ORDER BY alias) AS meant FROM a GROUP BY doc_id)
SELECT p.doc_id, block_ord, list_reduce(list_prepend(text, list_transform(range(1, len(names) + 1), lambda i: names[i] || chr(1) || meant[i])),
  lambda t, r: regexp_replace(t, '\\b' || split_part(r, chr(1), 1) || '\\b', split_part(r, chr(1), 2), 'g')) AS text FROM p JOIN l USING (doc_id)""")
def q_alias_rewrite(spark: SparkSession, sf: str) -> DataFrame:
    p = _parties(spark, sf)
    held = project.party_aliases(p).groupBy("doc_id").agg(F.collect_list(F.struct("alias", "canonical")).alias("aliases"))
    return p.join(held, "doc_id").select("doc_id", "block_ord", project.apply_aliases(F.col("text"), F.col("aliases")).alias("text"))


_AMENDED = project.TopicMap("amended.v1", (("payment", ("payment",)), ("tax", ("duties",))), amendments=(r"amends '([^']+)'",))


@query("""WITH RECURSIVE l AS (SELECT user_id AS doc_id, CAST(row_number() OVER w - 1 AS INT) AS ord, greatest(1, row_number() OVER w - 1 - event_id % 2) AS j, event_id % 5 = 0 AS plain, event_id % 7 = 0 AS named FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
r AS (SELECT doc_id, ord, ['payment'] AS topics, ['-'] AS sources FROM l WHERE ord = 0
  UNION ALL SELECT l.doc_id, l.ord, list_append(topics, CASE WHEN plain THEN 'unknown' WHEN named THEN 'tax' ELSE topics[j] END),
    list_append(sources, CASE WHEN plain THEN '-' WHEN named THEN '<by-title>' WHEN topics[j] = 'unknown' THEN '-' ELSE printf('s_%08d', j - 1) END) FROM r JOIN l ON l.doc_id = r.doc_id AND l.ord = r.ord + 1)
SELECT doc_id, ord, topics[ord + 1] AS topic, sources[ord + 1] AS source FROM r""")
def q_amendments(spark: SparkSession, sf: str) -> DataFrame:
    """Chains of amending sections: each names an earlier one, or a topic, or nothing."""
    n, e = F.col("n"), F.col("event_id")
    item = lambda k: F.format_string("item %05d", k.cast("int"))
    other = F.when(e % 5 == 0, "Nothing is changed.").when(e % 7 == 0, "This amends 'customs duties'.").otherwise(F.concat(F.lit("This amends '"), item(F.greatest(F.lit(1), n - 1 - e % 2)), F.lit("'.")))
    rows = table(spark, sf, "events").withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")))
    s = rows.select(
        F.col("user_id").alias("doc_id"), (n - 1).cast("int").alias("ord"), project.section_id(n - 1).alias("section_id"), F.concat(F.when(n == 1, "Payment ").otherwise("The "), item(n)).alias("heading"),
        F.when(n == 1, "Paid.").otherwise(other).alias("text"), F.lit(0).alias("char_start"))
    out = project.enrich(s, _AMENDED, features=False)
    return out.select("doc_id", "ord", F.col("primary_topic").alias("topic"), F.coalesce("inherited_from", F.lit("-")).alias("source"))


@query("""SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN p_type WHEN p_size % 4 = 1 THEN 'contract' WHEN p_size % 4 = 2 THEN p_brand ELSE 'unknown' END AS kind FROM part""")
def q_kind_resolve(spark: SparkSession, sf: str) -> DataFrame:
    m = F.col("p_size") % 4
    return table(spark, sf, "part").select("p_partkey", project.resolve_kind(
        F.when(m == 0, F.concat(F.lit(" "), "p_type", F.lit(" "))).when(m == 1, "  "), F.when(m == 1, "C:\\Docs\\Rulesets\\Contracts\\a.md").otherwise("a.md"), F.when(m != 3, F.col("p_brand"))).alias("kind"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 7 WHEN event_id % 3 = 1 THEN 5 ELSE 0 END AS span FROM events")
def q_span_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """The nearest place upwards that has a span."""
    m = F.col("event_id") % 3
    path = F.when(m == 0, "$.sections[1].props.k").when(m == 1, "$.sections[2].props").otherwise("$.title")
    spans = F.create_map(F.lit("$"), F.lit(0), F.lit("$.sections[1]"), F.lit(7), F.lit("$.sections"), F.lit(5))
    return table(spark, sf, "events").select("event_id", selectors.span_of(path, spans).alias("span"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 4 = 0 THEN 'P' || '' ELSE NULL END AS none, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_custkey AS VARCHAR) END AS number,
  CASE WHEN o_orderkey % 7 <> 0 THEN CASE o_orderstatus WHEN 'F' THEN 'true' WHEN 'O' THEN 'false' END END AS flag, CASE WHEN o_orderkey % 7 <> 0 AND o_orderpriority IN ('1-URGENT', '2-HIGH') THEN o_orderpriority END AS choice,
  CASE WHEN o_orderkey % 7 <> 0 THEN CAST((o_orderkey % 50) * 7 AS VARCHAR) END AS days, CASE WHEN o_orderkey % 7 <> 0 THEN substring(repeat(o_orderpriority, 40), 1, 200) END AS words FROM orders""".replace(
    "CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 4 = 0 THEN 'P' || '' ELSE NULL END AS none, ", ""))
def q_fact_values(spark: SparkSession, sf: str) -> DataFrame:
    """Extracted values as their types' strings; a quote that is not in the text drops them."""
    k = F.col("o_orderkey")
    text, quote = F.concat(F.lit("Order "), k.cast("string")), F.when(k % 7 == 0, "absent").otherwise("Order")
    of = lambda raw, kind, allowed=None: facts.convert_value(raw, kind, quote, text, allowed)
    return table(spark, sf, "orders").select(
        "o_orderkey", of(F.concat(F.lit(" "), F.col("o_custkey").cast("string")), "int").alias("number"), of(F.when(F.col("o_orderstatus") == "F", " True").when(F.col("o_orderstatus") == "O", "FALSE").otherwise("maybe"), "bool").alias("flag"),
        of(F.col("o_orderpriority"), "enum", ["1-URGENT", "2-HIGH"]).alias("choice"), of(F.concat(F.lit("P"), (k % 50).cast("string"), F.lit("W")), "duration").alias("days"), of(F.repeat("o_orderpriority", F.lit(40)), "text").alias("words"))


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    e, v = table(spark, sf, "embeddings"), F.col("vec_id")
    return e.select(v.alias("doc_id"), F.lit(0).alias("ord"), F.lit("s_00000000").alias("section_id"), F.lit("").alias("heading"), F.lit("").alias("text"), F.lit(0).alias("char_start"), F.when(v % 11 != 0, F.col("embedding")).alias("embedding"))


@query("""WITH c AS (SELECT e.vec_id, max(CASE WHEN q.vec_id = 1 THEN s END) AS a, max(CASE WHEN q.vec_id = 2 THEN s END) AS b FROM embeddings e,
  LATERAL (SELECT q.vec_id, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS s FROM embeddings q WHERE q.vec_id IN (1, 2)) q GROUP BY e.vec_id)
SELECT vec_id AS doc_id, CASE WHEN vec_id % 11 = 0 THEN 'Error' WHEN a >= 0.2 OR b >= 0.2 THEN 'Pass' ELSE 'Error' END AS any_of, CASE WHEN vec_id % 11 = 0 THEN 'Error' WHEN a >= 0.2 THEN 'Pass' ELSE 'Fail' END AS one FROM c""")
def q_meanings_in_rules(spark: SparkSession, sf: str) -> DataFrame:
    """A concept without vector, behind the others: an error only where none of them was met; a section without vector: always."""
    few = table(spark, sf, "embeddings").where("vec_id in (1, 2)").collect()  # two concepts' vectors
    rules = RuleSet("r", "1", (Rule("ANY", 'MatchesAnyMeaning(input1.id, "c1|c2|gone", 0.2)'), Rule("ONE", 'ContainsMeaning(input1.id, "c1", 0.2)')))
    v = evaluate.evaluate(_vectors(spark, sf), rules, Options(meaning=semantic.meaning("embedding", {f"c{r['vec_id']}": list(r["embedding"]) for r in few})))
    return v.groupBy("doc_id").agg(F.max(F.when(F.col("rule_id") == "ANY", F.col("outcome"))).alias("any_of"), F.max(F.when(F.col("rule_id") == "ONE", F.col("outcome"))).alias("one"))


_BOUND = RuleSet("r", "1", (Rule("A", 'SemanticBindings("of").Count > 0', anchors=({"name": "of", "anchorText": "of the", "threshold": 0.999, "ngram": [2]}, {"name": "and", "anchorText": "and", "threshold": 0.999, "ngram": [1]})),))


@query(r"""WITH b AS (SELECT item_id, text, length(regexp_extract(lower(text), '(?s)^(.*?)(^|[^\p{L}\p{N}''\-])and([^\p{L}\p{N}''\-]|$)', 1)) + length(regexp_extract(lower(text), '(?s)^(.*?)(^|[^\p{L}\p{N}''\-])and([^\p{L}\p{N}''\-]|$)', 2)) AS place,
  regexp_matches(lower(text), '(^|[^\p{L}\p{N}''\-])and([^\p{L}\p{N}''\-]|$)') AS has, regexp_matches(lower(text), '(^|[^\p{L}\p{N}''\-])of[^\p{L}\p{N}.!?]+the([^\p{L}\p{N}''\-]|$)') AS pair FROM benchmark)
SELECT item_id AS doc_id, CASE WHEN pair THEN 'Pass' ELSE 'Fail' END AS outcome, CASE WHEN has THEN CAST(place AS INT) END AS and_at FROM b""")
def q_anchors_in_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Anchors bound to equal tokens; where the one-word anchor first stands."""
    s = table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), F.lit(0).alias("ord"), F.lit("s_00000000").alias("section_id"), F.lit("").alias("heading"), "text", F.lit(0).alias("char_start"))
    bound = semantic.bind(s, _BOUND, vectors.hash_vector)
    v = evaluate.evaluate(bound, _BOUND, Options(bindings_col="__bindings")).select("doc_id", "outcome")
    at = primitives.anchor_span(F.try_element_at("__bindings", F.lit(evaluate.binding_key(_BOUND.rules[0], "and"))), "and")["char_start"]
    return v.join(bound.select("doc_id", at.alias("and_at")), "doc_id")


@query(r"""WITH b AS (SELECT doc_id, list_concat(list_transform(range(16), lambda i: CAST('0x' || substring(sha256(text), i * 4 + 1, 4) AS INT)), list_transform(range(16), lambda i: CAST('0x' || substring(sha256(unhex(sha256(text))), i * 4 + 1, 4) AS INT))) AS l FROM documents),
s AS (SELECT doc_id, list_transform(l, lambda v: (CASE WHEN v >= 32768 THEN v - 65536 ELSE v END) / 32767.0) AS l FROM b), n AS (SELECT doc_id, l, sqrt(list_sum(list_transform(l, lambda x: x * x))) AS n FROM s)
SELECT doc_id, round(l[1] / n, 9) AS first, round(l[32] / n, 9) AS last FROM n""")
def q_hash_vector(spark: SparkSession, sf: str) -> DataFrame:
    v = vectors.hash_vector(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", v.alias("v")).select("doc_id", F.round(F.col("v")[0], 9).alias("first"), F.round(F.col("v")[31], 9).alias("last"))


@query("SELECT vec_id, round(CAST(embedding[1] AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))), 9) AS first, len(embedding) AS n FROM embeddings")
def q_normalise(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", F.round(vectors.normalise(F.col("embedding"))[0], 9).alias("first"), F.size("embedding").cast("bigint").alias("n"))


# ---- rule sets as tables ----


def _rules(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(F.col("p_brand").alias("ruleset_id"), F.lit("1").alias("ruleset_version"), F.lit("d").alias("domain"), F.format_string("R-%07d", F.col("p_partkey").cast("int")).alias("rule_id"),
                                           F.col("p_type").alias("predicate"), (F.col("p_size") % 3).cast("string").alias("lambda"), hashing.compose(F.col("p_name")).alias("fingerprint"))


@query("SELECT min(printf('R-%07d', p_partkey)) AS rule_id, p_type AS predicate, CAST(p_size % 3 AS VARCHAR) AS lambda FROM part GROUP BY p_type, p_size % 3")
def q_rules_distinct(spark: SparkSession, sf: str) -> DataFrame:
    return governance.deduplicate(_rules(spark, sf)).select("rule_id", "predicate", "lambda")


@query("""SELECT p_brand AS ruleset_id, '1' AS ruleset_version, 'lr1:' || sha256(p_brand || chr(31) || '1' || chr(31) || 'd' || chr(31) || string_agg('lr1:' || sha256(p_name || chr(31)) || chr(31), '' ORDER BY p_partkey)) AS fingerprint, count(*) AS n_rules FROM part GROUP BY p_brand""")
def q_ruleset_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return governance.ruleset_fingerprints(_rules(spark, sf))


@query(f"""{demo.VERDICTS}, r AS (SELECT doc_id, rule_id, arg_min(outcome, CASE outcome WHEN 'Pass' THEN 1 WHEN 'Fail' THEN 2 WHEN 'Error' THEN 3 WHEN 'Gap' THEN 4 WHEN 'NotApplicable' THEN 5 ELSE 6 END) AS outcome FROM v GROUP BY doc_id, rule_id)
SELECT doc_id, count(*) AS rules, {demo.COUNTS} FROM r GROUP BY doc_id""")
def q_rule_stats(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.rule_outcome_counts(evaluate.rule_summaries(evaluate.evaluate(demo.sections(spark, sf), demo.RULES)))


@query(f"""WITH {demo.SECTIONS}, f AS (SELECT doc_id, section_id, unnest(['category', 'ord']) AS field, unnest([category, CAST(ord AS VARCHAR)]) AS value FROM s) SELECT * FROM f""")
def q_section_index(spark: SparkSession, sf: str) -> DataFrame:
    return governance.section_index(demo.sections(spark, sf), ["category", "gone", "ord"])


@query(f"""WITH {demo.SECTIONS} SELECT doc_id, section_id, CASE WHEN {demo._hit('heading', ('ble ', 'ment'))} THEN 'Pass' ELSE 'Fail' END AS strong, CASE WHEN {demo.has_topic_sql('supply')} THEN 'Pass' ELSE 'Fail' END AS any FROM s""")
def q_has_topic(spark: SparkSession, sf: str) -> DataFrame:
    rules = RuleSet("r", "1", (Rule("STRONG", 'HasTopic(input1, "supply", 0.5)'), Rule("ANY", 'LambdaPrimitives.HasTopic(input1, "supply")')))
    v = evaluate.evaluate(demo.sections(spark, sf), rules)
    return v.groupBy("doc_id", "section_id").agg(F.max(F.when(F.col("rule_id") == "STRONG", F.col("outcome"))).alias("strong"), F.max(F.when(F.col("rule_id") == "ANY", F.col("outcome"))).alias("any"))


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def q_latest(spark: SparkSession, sf: str) -> DataFrame:
    return store.latest(table(spark, sf, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id")


@query("""SELECT o_orderkey, CAST(CASE o_orderkey % 4 WHEN 0 THEN (o_orderkey % 60 + 1) * 3600.0 WHEN 1 THEN (o_orderkey % 9 + 0.5) * 86400.0 WHEN 2 THEN NULL ELSE 900.0 END AS DOUBLE) AS seconds FROM orders""")
def q_duration_near(spark: SparkSession, sf: str) -> DataFrame:
    """The duration nearest to the anchor in its own sentence; none where only another sentence has one."""
    from ..operators.clauses import seconds_near

    k = F.col("o_orderkey")
    n = lambda c: c.cast("string")
    text = (F.when(k % 4 == 0, F.concat(F.lit("The RPO is 15 min. The RTO is "), n(k % 60 + 1), F.lit(" hours."))).when(k % 4 == 1, F.concat(F.lit("RTO "), n(k % 9), F.lit(",5 days, then 2 weeks")))
            .when(k % 4 == 2, "The RTO is set. 4 hours are for others.").otherwise("Within 3 days, or 15 minutes RTO"))
    return table(spark, sf, "orders").select("o_orderkey", seconds_near(text, "rto").alias("seconds"))


@query("""SELECT p_partkey, CAST(p_size AS DOUBLE) AS near, 'within ' || p_size || ' days' AS around FROM part""")
def q_number_near(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat(F.lit("Clause twelve pays seven sums within "), F.col("p_size").cast("string"), F.lit(" days of notice 99."))
    at = F.array(F.struct(F.lit("within").alias("text"), F.lit(1.0).alias("similarity"), F.lit(30).alias("char_start"), F.lit(6).alias("char_length")))
    width = 8  # one behind the number's end for numbers of two digits
    nearest = F.regexp_extract(primitives.nearest_text(text, at, 40), r"within \d+ days", 0)
    return table(spark, sf, "part").select("p_partkey", primitives.number_near(text, "within", width).alias("near"), nearest.alias("around"))


_MD = "# Part {k}\n\nThe **bold** size is `{n}`.\n\n- item *one*\n- item [two](http://x.y)\n\n## Sub {n}\n\nTail text\n\n---\n\nEnd.\n"


@query("""WITH x AS (SELECT p_partkey AS k, p_size AS n FROM part)
SELECT k AS p_partkey, unnest(['heading', 'paragraph', 'list_item', 'list_item', 'heading', 'paragraph', 'paragraph']) AS kind, unnest(['Part ' || k, 'The bold size is ' || n || '.', 'item one', 'item two', 'Sub ' || n, 'Tail text', 'End.']) AS text,
  unnest(list_concat(list_transform(range(4), lambda i: '/Part ' || k), list_transform(range(3), lambda i: '/Part ' || k || '/Sub ' || n))) AS path, unnest([0, 1, 2, 3, 4, 5, 6]) AS place FROM x""")
def q_markdown(spark: SparkSession, sf: str) -> DataFrame:
    k, n = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    text = F.replace(F.replace(F.lit(_MD), F.lit("{k}"), k), F.lit("{n}"), n)
    files = table(spark, sf, "part").select(k.alias("doc_id"), F.lit("markdown").alias("kind"), text.alias("text"), F.lit(None).cast("binary").alias("content"), F.lit(None).cast("string").alias("problem"))
    return documents.blocks(files).select(F.col("doc_id").cast("bigint").alias("p_partkey"), "kind", "text", F.col("heading_path").alias("path"), F.col("block_ord").alias("place"))
