"""A small topic map and rule set for the driver's tables, and the sections they are used on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.evaluate import Rule, RuleSet
from ..operators.project import TopicMap, enrich, split_lines
from .registry import table

TOPICS = TopicMap("demo.v1", (("tax", ("gst", "hst")), ("secrecy", ("nda",)), ("supply", ("ble ", "ment"))), (("jurisdiction", ("ontion", "la ", "der ")),))

RULES = RuleSet(
    "rs_demo", "1.0.0", (
        Rule("D-SEC-001", 'input1.text.Contains("ion") && !input1.text.Contains("token")', 'input1.category == "secrecy"', natural_language="Secrecy clauses speak of ions.",
             remediation='Rewrite "{section.heading}" under {rule.id} within {meta.days} days; {unknown.x} stays.', metadata={"days": "30"}, evidence_quote="Secrecy clauses are needed.", source_document="policy-1", source_start=10, source_length=20),
        Rule("D-SUP-001", 'input1.text.ToLower().Contains("tion") || input1.topic_density > 5', 'input1.category == "supply" && input1.topics.Contains("supply")', natural_language="Supply clauses are dense.", source_document="policy-1", source_start=40, source_length=7),
        Rule("D-SUP-002", 'input1.text.Length >= 60 && input1.is_operative_for_topic == true', 'input1.category == "supply"', natural_language="Supply clauses are long.", severity="Warning", applicability="Optional", source_document="policy-1", source_start=60, source_length=9),
        Rule("D-TAX-001", 'input1.text.Contains("gst")', 'input1.category == "tax"', natural_language="Tax clauses name the tax.", remediation="Name it.", source_document="policy-2", source_start=0, source_length=5),
        Rule("D-TAX-002", 'PhraseMatch(input1.text, "missing")', 'input1.category == "tax"', natural_language="Tax clauses follow the book.", source_document="policy-2", source_start=5, source_length=5),
    ), domain="demo")


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of documents, each headed by what stands before its first full stop."""
    lines = split_lines(table(spark, sf_dir, "documents")).withColumn("heading", F.regexp_extract("text", r"^[^.]*", 0))
    return enrich(lines, TOPICS, features=False)


# ---- the same in SQL ----

LINES = """l AS (
  SELECT doc_id, ord, text, CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS char_start,
         printf('s_%08d', ord) AS section_id, regexp_extract(text, '^[^.]*', 0) AS heading
  FROM (SELECT doc_id, unnest(p) AS text, generate_subscripts(p, 1) - 1 AS ord FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)))"""


def _hit(column: str, words) -> str:
    return "(" + " OR ".join(f"contains(lower({column}), '{w}')" for w in words) + ")"


PRIMARY = "CASE " + " ".join(f"WHEN {_hit('heading', kw)} THEN '{t}'" for t, kw in TOPICS.topics) + " ELSE 'unknown' END"
DENSITY = "CASE primary_topic " + " ".join(
    f"WHEN '{t}' THEN " + " + ".join(f"(length(text) - length(replace(lower(text), '{k}', ''))) / {len(k)}.0" for k in kw) for t, kw in TOPICS.topics) + " ELSE 0 END"
SUPPLEMENT = _hit("heading", TOPICS.axes[0][1])
SCORES = "list_concat(" + ", ".join(["[" + ", ".join(
    [f"CASE WHEN {_hit('heading', kw)} THEN {{'t': '{t}', 's': 0.9}} WHEN {_hit('text', kw)} THEN {{'t': '{t}', 's': 0.4}} END" for t, kw in TOPICS.topics]
    + [f"CASE WHEN contains(lower(heading), '{p}') THEN {{'t': '{a}:{p.replace(' ', '_')}', 's': 1.0}} END" for a, ps in TOPICS.axes for p in ps]) + "]", "[]"]) + ")"
SECTIONS = f"""{LINES},
p AS (SELECT *, {PRIMARY} AS primary_topic, {SUPPLEMENT} AS is_country_supplement FROM l),
e AS (
  SELECT *, CASE WHEN length(text) > 0 THEN round_even(CAST(({DENSITY}) / (greatest(1, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: length(w) > 0))) / 100.0) AS DOUBLE), 4) ELSE 0.0 END AS topic_density,
         list_contains([{', '.join(repr(t) for t, _ in TOPICS.topics)}], primary_topic) AS known FROM p),
s AS (
  SELECT *, primary_topic AS category, (known AND NOT is_country_supplement AND
         row_number() OVER (PARTITION BY doc_id, primary_topic, is_country_supplement ORDER BY topic_density DESC, section_id) = 1) AS is_operative_for_topic FROM e)"""


def has_topic_sql(topic: str) -> str:
    kw = dict(TOPICS.topics)[topic]
    return f"({_hit('heading', kw)} OR {_hit('text', kw)})"


#: Every rule at every section: outcome, error and where it points, as the demo rule set has it.
VERDICTS = f"""WITH {SECTIONS},
here AS (
  SELECT doc_id, section_id, ord, char_start, heading, text, 'D-SEC-001' AS rule_id, contains(text, 'ion') AND NOT contains(text, 'token') AS ok FROM s WHERE category = 'secrecy'
  UNION ALL SELECT doc_id, section_id, ord, char_start, heading, text, 'D-SUP-001', contains(lower(text), 'tion') OR topic_density > 5 FROM s WHERE category = 'supply' AND {has_topic_sql('supply')}
  UNION ALL SELECT doc_id, section_id, ord, char_start, heading, text, 'D-SUP-002', length(text) >= 60 AND is_operative_for_topic FROM s WHERE category = 'supply'
  UNION ALL SELECT doc_id, section_id, ord, char_start, heading, text, 'D-TAX-001', contains(text, 'gst') FROM s WHERE category = 'tax'
  UNION ALL SELECT doc_id, section_id, ord, char_start, heading, text, 'D-TAX-002', NULL FROM s WHERE category = 'tax'),
rules(rule_id, nl, mandatory, src, src_start, src_len, predicate) AS (VALUES
  {', '.join(f"('{r.id}', '{r.natural_language}', {r.applicability == 'Mandatory'}, '{r.source_document}', {r.source_start}, {r.source_length}, '{r.predicate}')" for r in RULES.rules)}),
hit AS (
  SELECT *, CASE WHEN NOT ok THEN list_filter([{{'at': instr(lower(text), 'ion') - 1, 'size': 3, 'r': 'D-SEC-001'}}, {{'at': instr(lower(text), 'token') - 1, 'size': 5, 'r': 'D-SEC-001'}},
      {{'at': instr(lower(text), 'tion') - 1, 'size': 4, 'r': 'D-SUP-001'}}, {{'at': instr(lower(text), 'gst') - 1, 'size': 3, 'r': 'D-TAX-001'}}], lambda x: x.r = rule_id AND x.at >= 0)[1] END AS h FROM here),
v AS (
  SELECT doc_id, hit.rule_id, section_id, ord, CASE WHEN ok IS NULL THEN 'Error' WHEN ok THEN 'Pass' ELSE 'Fail' END AS outcome,
         CASE WHEN ok IS NULL THEN 'unknown phrasebook ''missing''' WHEN NOT ok THEN 'Rule ''' || hit.rule_id || ''' failed: ' || nl END AS error,
         CASE WHEN NOT ok AND hit.rule_id = 'D-SEC-001' THEN 'Rewrite "' || heading || '" under D-SEC-001 within 30 days; {{unknown.x}} stays.' WHEN NOT ok AND hit.rule_id = 'D-TAX-001' THEN 'Name it.' END AS remediation,
         CAST(char_start + coalesce(h.at, 0) AS BIGINT) AS start, CAST(coalesce(h.size, length(text)) AS BIGINT) AS length,
         CASE WHEN NOT ok AND text <> '' THEN CAST(char_start AS BIGINT) END AS clause_start, CASE WHEN NOT ok AND text <> '' THEN CAST(length(text) AS BIGINT) END AS clause_length, CAST(doc_id AS VARCHAR) AS source, predicate
  FROM hit JOIN rules USING (rule_id)
  UNION ALL
  SELECT d.doc_id, r.rule_id, NULL, NULL, CASE WHEN mandatory THEN 'Gap' ELSE 'NotApplicable' END, NULL, CASE WHEN mandatory THEN 'Document does not address: ' || nl END, src_start, src_len, NULL, NULL, src, predicate
  FROM (SELECT DISTINCT doc_id FROM s) d CROSS JOIN rules r WHERE NOT EXISTS (SELECT 1 FROM here h WHERE h.doc_id = d.doc_id AND h.rule_id = r.rule_id))"""
#: The address of a verdict in ``v``.
VERDICT_ID = """'lr1:' || sha256(array_to_string(list_concat(['verdict', rule_id, '1.0.0', 'rs_demo', '1.0.0', 'lr1:' || sha256(predicate), source, CAST(start AS VARCHAR), CAST(length AS VARCHAR), outcome],
  CASE WHEN clause_start IS NULL THEN [] ELSE ['clause:' || clause_start, 'clauseLen:' || clause_length] END, ['']), chr(31)))"""
COUNTS = """count(*) FILTER (outcome = 'Pass') AS passed, count(*) FILTER (outcome = 'Fail') AS failed, count(*) FILTER (outcome = 'Error') AS errored,
       count(*) FILTER (outcome = 'Gap') AS gaps, count(*) FILTER (outcome = 'NotApplicable') AS not_applicable, count(*) FILTER (outcome = 'Skipped') AS skipped"""
SCORE = "CASE WHEN passed + failed + gaps = 0 THEN 1.0 ELSE CAST(passed AS DOUBLE) / (passed + failed + gaps) END"
