"""Facts stated by sections, merged per rule and document, and rules over the merged facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.durations import to_days
from ..plans import expression as ex
from .evaluate import Rule, RuleSet, functions_for, verdict_id


def merge_facts(facts: DataFrame, kinds: dict[str, str], by: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """facts(doc_id, section_id, concept, value string) to (doc_id, concept, value, conflicts); ``by``: what to merge within.

    In section order: booleans are true if any is ("true" in any case), ints and durations take the least that
    parses, enums and texts the first that is not null. conflicts counts, pairwise in that order, the values that
    differ from what had been merged before them. The fold is over one concept of one document.
    """
    typed = F.create_map(*(F.lit(x) for c, k in sorted(kinds.items()) for x in (c, k))) if kinds else F.create_map().cast("map<string,string>")
    kind = F.coalesce(F.try_element_at(typed, F.col("concept")), F.lit("text"))
    held = facts.where("value is not null").withColumn("kind", kind)
    low = F.lower(F.trim("value"))
    number = F.when(F.col("kind") == "int", F.trim("value").try_cast("bigint")).when(F.col("kind") == "duration", to_days(F.col("value")).cast("bigint"))
    shown = F.when(F.col("kind") == "bool", F.when(low == "true", "true").otherwise("false")).otherwise(F.col("value"))
    rows = held.select(*by, "concept", "kind", "section_id", shown.alias("value"), number.alias("number"))
    numeric = F.col("kind").isin("int", "duration")
    agg = rows.groupBy(*by, "concept", "kind").agg(
        F.max(F.when(F.col("value") == "true", 1).otherwise(0)).alias("any"), F.min("number").alias("least"), F.min_by("value", "section_id").alias("first"),
        F.sort_array(F.collect_list(F.when(~numeric | F.col("number").isNotNull(), F.struct("section_id", "number", "value")))).alias("seq"))
    state = lambda v, n, c: F.struct(v.alias("v"), n.alias("n"), c.alias("c"))

    def fold(s, x):
        differs = F.when(numeric, s["n"] != x["number"]).otherwise(s["v"] != x["value"])
        new_v = F.when(F.col("kind") == "bool", F.when((s["v"] == "true") | (x["value"] == "true"), "true").otherwise("false")).otherwise(F.coalesce(s["v"], x["value"]))
        return state(new_v, F.least(s["n"], x["number"]), s["c"] + F.coalesce(differs & s["v"].isNotNull(), F.lit(False)).cast("int"))

    folded = F.aggregate("seq", state(F.lit(None).cast("string"), F.lit(None).cast("bigint"), F.lit(0)), fold)
    value = F.when(F.col("kind") == "bool", F.when(F.col("any") == 1, "true").otherwise("false")).when(numeric, F.col("least").cast("string")).otherwise(F.col("first"))
    return agg.select(*by, "concept", "kind", value.alias("value"), folded["c"].alias("conflicts")).where("value is not null")


def evaluate_fact_rules(documents: DataFrame, facts: DataFrame, rules: RuleSet, kinds: dict[str, str], scopes: dict[str, list[str]] | None = None) -> DataFrame:
    """One verdict per document and fact rule: doc_id, rule_id, outcome, error, verdict_id.

    A rule sees the facts of its sections: those that ``scopes`` names, else all with one of its concepts, else all. It is
    NotApplicable if a required fact is missing, or all of the alternatives are; else its lambda decides over ``facts.*``.
    Facts are read once and merged once for each different scope, whatever the number of rules.
    """
    ordered = sorted((r for r in rules.rules if r.mode == "facts"), key=lambda r: r.id)
    if not ordered:
        raise ValueError("the rule set has no fact rules")
    scope_of = {r.id: ("sections", tuple(sorted(scopes[r.id]))) if (scopes or {}).get(r.id) else ("concepts", tuple(sorted({*r.required_facts, *r.required_any}))) for r in ordered}
    number = {s: k for k, s in enumerate(sorted(set(scope_of.values())))}
    stated = F.collect_set(F.when(F.col("value").isNotNull(), F.col("concept"))).over(Window.partitionBy("doc_id", "section_id"))

    def within(kind: str, names: tuple[str, ...]) -> Column:
        if kind == "sections":
            return F.col("section_id").isin(*names)
        return F.arrays_overlap("__stated", F.array(*(F.lit(n) for n in names))) if names else F.lit(True)

    own = F.array_compact(F.array(*(F.when(within(*s), k) for s, k in number.items())))
    dealt = facts.select("doc_id", "section_id", "concept", "value").withColumn("__stated", stated).withColumn("scope", F.explode(own)).drop("__stated")
    bags = merge_facts(dealt, kinds, ("doc_id", "scope")).groupBy("doc_id", "scope").agg(F.map_from_entries(F.collect_list(F.struct("concept", "value"))).alias("bag"))
    held = bags.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("scope", "bag"))).alias("bags"))
    none = F.create_map().cast("map<string,string>")
    joined = documents.select("doc_id").distinct().join(held, "doc_id", "left").select(
        "doc_id", *(F.coalesce(F.try_element_at("bags", F.lit(k)), none).alias(f"__bag{k}") for k in number.values()))
    return joined.select("doc_id", F.inline(F.array(*(_fact_verdict(r, rules, kinds, F.col(f"__bag{number[scope_of[r.id]]}")) for r in ordered))))


def _fact_verdict(r: Rule, rules: RuleSet, kinds: dict[str, str], bag: Column) -> Column:
    def value(name: str) -> Column:
        own = F.try_element_at(bag, F.lit(name))
        kind = kinds.get(name, "text")
        return own.cast("boolean") if kind == "bool" else own.try_cast("bigint") if kind in ("int", "duration") else own

    def member(path):
        return value(path[1]) if path[0] == "facts" and len(path) == 2 else None

    env = ex.Env(member, frozenset(), functions_for(rules))
    gone = lambda names: F.filter(F.array(*(F.when(value(n).isNull(), F.lit(n)) for n in names)), lambda x: x.isNotNull()) if names else F.array().cast("array<string>")
    missing, none_of = gone(r.required_facts), gone(r.required_any)
    stop = F.when(F.size(missing) > 0, F.concat(F.lit("missing_required_facts:"), F.array_join(missing, ",")))
    if r.required_any:
        stop = F.coalesce(stop, F.when(F.size(none_of) == len(r.required_any), F.concat(F.lit("missing_required_facts_any:"), F.array_join(none_of, ","))))
    try:
        passes, bad = ex.truth(ex.parse(r.lambda_), env), None
    except ex.RuleError as e:
        passes, bad = F.lit(False), str(e)
    outcome = F.when(stop.isNotNull(), "NotApplicable").when(F.lit(bad is not None), "Error").when(passes, "Pass").otherwise("Fail")
    error = F.coalesce(stop, F.lit(bad).cast("string"), F.when(outcome == "Fail", f"Rule '{r.id}' failed: {r.natural_language}"))
    vid = verdict_id(r, rules, F.lit(r.source_document), F.lit(r.source_start), F.lit(r.source_length), outcome)
    return F.struct(F.lit(r.id).alias("rule_id"), outcome.alias("outcome"), error.alias("error"), vid.alias("verdict_id"))


def convert_value(raw: Column, kind: str, quote: Column, text: Column, allowed: list[str] | None = None) -> Column:
    """An extracted value as its type's string, or null: the quote has to stand in the text, enums in their list, texts
    are cut at 200 characters."""
    ok = F.coalesce(F.contains(text, quote), F.lit(False))
    if kind == "bool":
        value = F.when(F.lower(F.trim(raw)).isin("true", "false"), F.lower(F.trim(raw)))
    elif kind == "int":
        value = F.trim(raw).try_cast("bigint").cast("string")
    elif kind == "duration":
        value = to_days(raw).cast("string")
    elif kind == "enum":
        value = F.when(raw.isin(*(allowed or [""])), raw)
    else:
        value = F.substring(raw, 1, 200)
    return F.when(ok, value)
