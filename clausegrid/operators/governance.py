"""Rule sets as data: addresses, overlays, differences, signatures, coverage, calibration."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import UNIT, address, compose_list
from ..functions.vectors import cosine
from ..plans import expression as ex
from .evaluate import Rule, RuleSet

_EQUALS = re.compile(r'input1((?:\.[A-Za-z_]\w*)+)\s*==\s*"([^"]*)"')
_EQUALS_BACK = re.compile(r'"([^"]*)"\s*==\s*input1((?:\.[A-Za-z_]\w*)+)')
_CONTAINS = re.compile(r'input1((?:\.[A-Za-z_]\w*)+)\.Contains\("([^"]*)"\)')


def rule_fingerprint(r: Rule) -> str:
    """Address of what a rule decides by; optional parts count only where they are set."""
    parts = [r.id, r.version, r.predicate, r.lambda_, r.remediation or "", r.anchor or "", json.dumps(r.schema, separators=(",", ":")), r.severity, r.applicability]
    listed = lambda xs: UNIT.join(sorted(x.strip() for x in xs if x.strip()))
    if r.gate_threshold > 0:
        parts.append(f"gate:{r.gate_threshold!r}".removesuffix(".0"))
    if r.examples is not None:
        parts += ["examples.positive:" + UNIT.join(r.examples.get("positive", ())), "examples.negative:" + UNIT.join(r.examples.get("negative", ()))]
    if r.kinds:
        parts.append("appliesToDocKinds:" + listed(r.kinds))
    for a in sorted(r.anchors, key=lambda a: a["name"]):
        grams = ",".join(str(n) for n in sorted(a["ngram"])) if a.get("ngram") else "1-2"
        parts.append(f"anchor:{a['name']}|{a['anchorText']}|{a.get('threshold', 0.78)!r}|{grams}")
    if r.mode:
        parts.append("evaluationMode:" + r.mode)
    if r.required_facts:
        parts.append("requiredFacts:" + listed(r.required_facts))
    if r.required_any:
        parts.append("requiredFactsAny:" + listed(r.required_any))
    return address(*parts)


def ruleset_fingerprint(s: RuleSet) -> str:
    parts = [s.id, s.version, s.domain, *(rule_fingerprint(r) for r in sorted(s.rules, key=lambda r: r.id))]
    if s.kinds:
        parts.append("appliesToDocKinds:" + UNIT.join(sorted(k.strip() for k in s.kinds if k.strip())))
    parts += [f"phrasebook:{b}={UNIT.join(sorted(ps))}" for b, ps in sorted(s.phrasebooks.items())]
    if s.embedder:
        parts.append("embedderId:" + s.embedder)
    return address(*parts)


def rule_rows(spark: SparkSession, rules: RuleSet) -> DataFrame:
    """The rule set as a table, with a content address for each rule."""
    rows = [(rules.id, rules.version, rules.domain, r.id, r.version, r.natural_language, r.predicate, r.lambda_, r.severity, r.applicability, float(r.gate_threshold), r.remediation or "", rule_fingerprint(r), r.evidence_quote, r.source_document) for r in rules.rules]
    return spark.createDataFrame(rows, "ruleset_id string, ruleset_version string, domain string, rule_id string, version string, natural_language string, predicate string, lambda string, severity string, "
                                       "applicability string, gate_threshold double, remediation string, fingerprint string, evidence_quote string, source_document string")


def ruleset_fingerprints(rules: DataFrame) -> DataFrame:
    """Address of each rule set from its rules' addresses in rule order."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("rule_id", "fingerprint"))), lambda r: r["fingerprint"])
    head = F.array("ruleset_id", "ruleset_version", "domain")
    return rules.groupBy("ruleset_id", "ruleset_version", "domain").agg(ordered.alias("parts"), F.count("*").alias("n_rules")).select(
        "ruleset_id", "ruleset_version", compose_list(F.concat(head, F.col("parts"))).alias("fingerprint"), "n_rules")


def apply_overlay(rules: DataFrame, disabled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(active rules, audit) for disabled(rule_id, reason): audit counts what was dropped and lists unknown ids."""
    active = rules.join(disabled.select("rule_id").distinct(), "rule_id", "left_anti")
    met = disabled.select("rule_id").distinct().join(rules.select("rule_id", F.lit(1).alias("there")), "rule_id", "left")
    audit = met.agg(F.count("there").alias("dropped"), F.sort_array(F.collect_list(F.when(F.col("there").isNull(), F.col("rule_id")))).alias("unknown"))
    return active, audit


def structural_problems(rules: DataFrame) -> DataFrame:
    """(rule_id, problem) of the rules that cannot be traced: without a quote, or else without a known source document."""
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    problem = F.when(blank("evidence_quote"), "missing evidenceQuote").when(
        F.coalesce(F.col("source_document").isin("", "(unknown)"), F.lit(True)), "missing or unknown sourceSpan.documentId")
    return rules.select("rule_id", problem.alias("problem")).where("problem is not null")


_COMPARED = ("version", "predicate", "lambda", "severity", "applicability", "gate_threshold", "remediation")


def diff(old: DataFrame, new: DataFrame, fields: Iterable[str] = _COMPARED) -> DataFrame:
    """(rule_id, change, fields): added, removed, changed with the fields that differ, or unchanged."""
    fields = list(fields)
    a, b = (d.select("rule_id", F.struct("fingerprint", *fields).alias(n)) for d, n in ((old, "a"), (new, "b")))
    both = a.join(b, "rule_id", "full_outer")
    changed = F.array_compact(F.array(*(F.when(~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), F.lit(f)) for f in fields)))
    kind = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a.fingerprint") != F.col("b.fingerprint"), "changed").otherwise("unchanged")
    return both.select("rule_id", kind.alias("change"), F.when(kind == "changed", F.array_join(changed, ",")).otherwise("").alias("fields"))


def deduplicate(rules: DataFrame) -> DataFrame:
    """Of rules with equal predicate and lambda the one with the least id."""
    return rules.groupBy(F.sha2(F.concat_ws("::", "predicate", "lambda"), 256).alias("k")).agg(F.min_by(F.struct(*(c for c in rules.columns)), "rule_id").alias("r")).select("r.*")


def signature(rule: Rule) -> list[tuple[str, str, str]]:
    """(kind, field, literal) atoms of a predicate; none: the rule is a candidate everywhere."""
    p = rule.predicate.strip()
    if p in ("", "true"):
        return []
    atoms = [("eq", f[1:], v) for f, v in _EQUALS.findall(p)] + [("eq", f[1:], v) for v, f in _EQUALS_BACK.findall(p)] + [("contains", f[1:], v) for f, v in _CONTAINS.findall(p)]
    return sorted(set(atoms))


def candidate(rule: Rule, env: ex.Env) -> Column:
    """Whether a section can be met by the rule's index entry: any atom holds, or there is none."""
    atoms = signature(rule)
    if not atoms:
        return F.lit(True)
    hit = F.lit(False)
    for kind, path, literal in atoms:
        c = env.member(("input1", *path.split(".")))
        if c is None:
            continue
        held = F.array_contains(c, literal) if path in env.arrays else (c == literal if kind == "eq" else F.contains(c, F.lit(literal)))
        hit = hit | F.coalesce(held, F.lit(False))
    return hit


def signature_rows(spark: SparkSession, rules: RuleSet) -> DataFrame:
    rows = [(r.id, not signature(r), k, f, v) for r in rules.rules for k, f, v in signature(r) or [(None, None, None)]]
    return spark.createDataFrame(rows, "rule_id string, universal boolean, kind string, field string, literal string")


def section_index(sections: DataFrame, fields: Iterable[str]) -> DataFrame:
    """(doc_id, section_id, field, value): what sections have under each of the fields, arrays by their JSON text; fields that
    no section has are left out. Equality and substring lookups are filters on it, the values of a field its distinct ones."""
    held = []
    for name in fields:
        try:
            kind = sections.select(F.col(name)).schema[0].dataType
        except AnalysisException:
            continue
        nested = isinstance(kind, (T.ArrayType, T.StructType, T.MapType))
        held.append(F.struct(F.lit(name).alias("field"), (F.to_json(F.col(name)) if nested else F.col(name).cast("string")).alias("value")))
    none = F.array().cast("array<struct<field:string,value:string>>")
    return sections.select("doc_id", "section_id", F.inline(F.array(*held) if held else none))


def candidates(sections: DataFrame, signatures: DataFrame) -> DataFrame:
    """(doc_id, section_id, rule_id) by the index: atoms of any field that sections have, arrays by their JSON text.

    The signatures are a rule set's, which the driver holds anyway: a section meets their literals by field in one
    projection, without a join, and each of its rules once."""
    atoms: dict[tuple[str, str, str], list[str]] = {}
    always = []
    for r in signatures.select("rule_id", "universal", "kind", "field", "literal").collect():
        if r["universal"]:
            always.append(r["rule_id"])
        else:
            atoms.setdefault((r["field"], r["kind"], r["literal"]), []).append(r["rule_id"])
    listed = lambda ids: F.array(*(F.lit(x) for x in sorted(set(ids)))) if ids else F.array().cast("array<string>")
    found = [listed(always)]
    for name in sorted({f for f, _, _ in atoms}):
        try:
            kind = sections.select(F.col(name)).schema[0].dataType
        except AnalysisException:  # no section has the field
            continue
        nested = isinstance(kind, (T.ArrayType, T.StructType, T.MapType))
        value = F.to_json(F.col(name)) if nested else F.col(name).cast("string")
        equal = {v: ids for (f, k, v), ids in atoms.items() if f == name and k == "eq"}
        if equal:
            found.append(F.try_element_at(F.create_map(*(x for v, ids in sorted(equal.items()) for x in (F.lit(v), listed(ids)))), value))
        found += [F.when(F.contains(value, F.lit(v)), listed(ids)) for (f, k, v), ids in sorted(atoms.items()) if f == name and k == "contains"]
    rules = F.array_distinct(F.flatten(F.array_compact(F.array(*found))))
    return sections.select("doc_id", "section_id", F.explode(rules).alias("rule_id"))


def vocabulary_coverage(rules: DataFrame, declared: list[str]) -> DataFrame:
    """One row: topics that predicates and lambdas name by category or topic, those the map declares, what is missing, what is unused."""
    both = F.concat_ws(" ", "predicate", "lambda")
    rx = r'(?:category|primary_topic)\s*==\s*"([^"]+)"|topics\.Contains\("([^"]+)"\)|HasTopic\([^,]+,\s*"([^"]+)"'
    found = F.flatten(F.array(*(F.filter(F.regexp_extract_all(both, F.lit(rx), F.lit(g)), lambda x: F.char_length(x) > 0) for g in (1, 2, 3))))
    used = rules.select(F.explode(found).alias("t")).agg(F.array_sort(F.collect_set("t")).alias("referenced"))
    own = F.array(*(F.lit(t) for t in sorted(declared))) if declared else F.array().cast("array<string>")
    return used.select("referenced", own.alias("declared"), F.array_except("referenced", own).alias("missing"), F.array_except(own, "referenced").alias("unused"))


def example_similarities(spark: SparkSession, rules: RuleSet, embed: Callable[[Column], Column]) -> DataFrame:
    """(rule_id, positive, example, similarity) of the rules' examples to the rules' own sentences; for ``validator_margins``."""
    rows = [(r.id, r.natural_language, positive, x) for r in rules.rules if r.examples for positive, name in ((True, "positive"), (False, "negative")) for x in r.examples.get(name, ())]
    held = spark.createDataFrame(rows, "rule_id string, sentence string, positive boolean, example string")
    vectors = held.select(F.explode(F.array("sentence", "example")).alias("text")).distinct().withColumn("v", embed(F.col("text")))
    own, other = (vectors.select(F.col("text").alias(c), F.col("v").alias(f"v_{c}")) for c in ("sentence", "example"))
    return held.join(own, "sentence").join(other, "example").select("rule_id", "positive", "example", cosine(F.col("v_sentence"), F.col("v_example")).alias("similarity"))


def anchor_embeddings(spark: SparkSession, rules: RuleSet, embed: Callable[[Column], Column]) -> DataFrame:
    """(rule_id, anchor, anchor_text, embedding): anchors' own vectors where they have them, else new ones; each text once."""
    rows = [(r.id, a["name"], a["anchorText"], [float(x) for x in a["anchorEmbedding"]] if a.get("anchorEmbedding") else None) for r in rules.rules for a in r.anchors]
    held = spark.createDataFrame(rows, "rule_id string, anchor string, anchor_text string, own array<double>")
    new = held.where("own is null").select("anchor_text").distinct().withColumn("v", embed(F.col("anchor_text")))
    return held.join(new, "anchor_text", "left").select("rule_id", "anchor", "anchor_text", F.coalesce("own", "v").alias("embedding"))


def validator_margins(examples: DataFrame, epsilon: float = 0.05) -> DataFrame:
    """examples(rule_id, positive, similarity) to (rule_id, min_positive, max_negative, margin, threshold, accepted)."""
    e = examples.groupBy("rule_id").agg(F.min(F.when(F.col("positive"), F.col("similarity"))).alias("min_positive"), F.max(F.when(~F.col("positive"), F.col("similarity"))).alias("max_negative"))
    margin = F.col("min_positive") - F.col("max_negative")
    return e.select("rule_id", "min_positive", "max_negative", margin.alias("margin"), ((F.col("min_positive") + F.col("max_negative")) / 2).alias("threshold"),
                    F.coalesce((margin > 0) & (margin >= epsilon), F.lit(False)).alias("accepted"))


def apply_thresholds(rules: DataFrame, margins: DataFrame) -> DataFrame:
    """Accepted rules take their midpoint as gate, the others keep theirs."""
    own = margins.where("accepted").select("rule_id", F.col("threshold").alias("__t"))
    return rules.join(own, "rule_id", "left").withColumn("gate_threshold", F.coalesce("__t", "gate_threshold")).drop("__t")


def coverage(verdicts: DataFrame) -> DataFrame:
    """Per rule over all documents: candidate sections, sections it passed in, documents it spoke in."""
    return verdicts.groupBy("rule_id").agg(F.count("section_id").alias("candidates"), F.count_if(F.col("outcome") == "Pass").alias("passed"),
                                           F.count_if(F.col("outcome") == "Fail").alias("failed"), F.countDistinct(F.when(F.col("section_id").isNotNull(), F.col("doc_id"))).alias("documents"))


def document_coverage(verdicts: DataFrame) -> DataFrame:
    """Per document and rule: candidate sections, sections it passed or failed in, and the list of those, in order."""
    own = F.when(F.col("outcome").isin("Pass", "Fail"), F.struct("ord", "section_id", "outcome"))
    out = verdicts.groupBy("doc_id", "rule_id").agg(F.count("section_id").alias("candidates"), F.count(own).alias("applied"), F.sort_array(F.collect_list(own)).alias("sections"))
    return out.withColumn("sections", F.transform("sections", lambda x: F.struct(x["section_id"].alias("section_id"), x["outcome"].alias("outcome"))))


def accuracy(outcomes: DataFrame, group: str | None = None) -> DataFrame:
    """outcomes(predicted boolean, truth boolean) to TP, FP, FN, TN, recall, precision, F1 (1 where nothing is to be found)."""
    c = lambda p, t: F.count_if((F.col("predicted") == p) & (F.col("truth") == t))
    base = outcomes.groupBy(group) if group else outcomes.groupBy()
    out = base.agg(c(True, True).alias("tp"), c(True, False).alias("fp"), c(False, True).alias("fn"), c(False, False).alias("tn"))
    ratio = lambda a, b: F.when(b == 0, 1.0).otherwise(a / b)
    return out.withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn"))).withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn(
        "f1", ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))
