"""Rules over sections: gates, verdicts, documents that say nothing, reports.

Rules are compiled on the driver into one array of structs per section. A document's arrays
meet once, where its sections already are, and what no section answered is added to them:
one pass over the texts and no join or Python, whatever the number of rules. Rules go into
projections of RULES_PER_STEP each, so that no generated method grows with a rule set.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hashing, primitives
from ..functions.vectors import cosine
from ..plans import expression as ex
from ..plans.selectors import section_selector

RULES_PER_STEP = 40
OUTCOMES = ("Pass", "Fail", "Error", "Gap", "NotApplicable", "Skipped")
ARRAYS = frozenset({"topics", *(f"text_features.{n}" for n in ("day_counts", "month_counts", "year_counts", "percent_values", "dollar_amounts"))})


@dataclass(frozen=True)
class Rule:
    id: str
    lambda_: str
    predicate: str = "true"
    version: str = "1.0.0"
    natural_language: str = ""
    selector: dict | None = None
    severity: str = "Violation"
    applicability: str = "Mandatory"
    gate_threshold: float = 0.0
    remediation: str | None = None
    anchor: str | None = None
    evidence_quote: str = ""
    source_document: str = ""
    source_start: int = 0
    source_length: int = 0
    metadata: dict = field(default_factory=dict)
    kinds: tuple[str, ...] = ()
    mode: str | None = None
    required_facts: tuple[str, ...] = ()
    required_any: tuple[str, ...] = ()
    schema: dict = field(default_factory=dict)
    examples: dict | None = None
    anchors: tuple[dict, ...] = ()

    @staticmethod
    def from_json(r: dict) -> "Rule":
        span = r.get("sourceSpan") or {}
        return Rule(
            r["id"], r.get("lambda", "true"), r.get("predicate") or "true", r.get("version", "1.0.0"), r.get("naturalLanguage", ""), r.get("selector"), r.get("severity", "Violation"),
            r.get("applicability", "Mandatory"), float(r.get("gateThreshold") or 0), r.get("remediation"), r.get("anchor"), r.get("evidenceQuote", ""), span.get("documentId", ""),
            int(span.get("charStart") or 0), int(span.get("charLength") or 0), dict(r.get("metadata") or {}), tuple(r.get("appliesToDocKinds") or ()), r.get("evaluationMode"),
            tuple(r.get("requiredFacts") or ()), tuple(r.get("requiredFactsAny") or ()), dict(r.get("appliesToSchema") or {}), r.get("examples"), tuple(r.get("semanticAnchors") or ()))


@dataclass(frozen=True)
class RuleSet:
    id: str
    version: str
    rules: tuple[Rule, ...]
    domain: str = ""
    kinds: tuple[str, ...] = ()
    phrasebooks: dict = field(default_factory=dict)
    embedder: str | None = None

    @staticmethod
    def from_json(s: dict) -> "RuleSet":
        return RuleSet(s["id"], s.get("version", "1.0.0"), tuple(Rule.from_json(r) for r in s["rules"]), s.get("domain", ""), tuple(s.get("appliesToDocKinds") or ()), dict(s.get("phrasebooks") or {}), s.get("embedderId"))


def require_domain(declared: str | None, rules: RuleSet) -> None:
    if declared and declared.strip().lower() != rules.domain.strip().lower():
        raise ValueError(f"document domain {declared!r} does not match rule set domain {rules.domain!r}")


def require_embedder(model: str | None, rules: RuleSet) -> None:
    if rules.embedder and model and rules.embedder != model:
        raise ValueError(f"rule set was embedded with {rules.embedder!r}, the vectors come from {model!r}")


def _text(node, env) -> Column:
    return ex.column(node, env)


def _const(node):
    if not isinstance(node, ex.Lit):
        raise ex.RuleError("this argument has to be a literal")
    return node.value


def functions_for(rules: RuleSet, meaning: Callable | None = None, bound: Callable | None = None) -> dict[str, Callable]:
    """The functions that rules may call. ``meaning(concept)`` gives a similarity column, null where a vector is missing,
    if vectors are there; ``bound(anchor)`` gives the rule's bindings of an anchor, best first (see ``semantic.bind``)."""
    def book(env, text, name):
        if _const(name) not in rules.phrasebooks:
            raise ex.RuleError(f"unknown phrasebook {_const(name)!r}")
        return primitives.phrase_match(_text(text, env), list(rules.phrasebooks[_const(name)]))

    def regex(env, text, pattern):
        try:
            return primitives.regex_match(_text(text, env), _const(pattern))
        except re.error as e:
            raise ex.RuleError(str(e)) from e

    def bindings(name) -> Column:
        return F.lit(None).cast(primitives.BINDINGS) if bound is None else F.coalesce(bound(_const(name)), F.array().cast(primitives.BINDINGS))

    def topic(env, section, name, least=None, anchor=None):
        there = primitives.has_topic(env.member((*section.names, "topics")), env.member((*section.names, "topic_scores")), _const(name), None if least is None else float(_const(least)))
        return there if anchor is None else there | F.coalesce(F.size(bindings(anchor)) > 0, F.lit(False))

    def similarity(env, concept) -> Column:
        if meaning is None:
            raise ex.RuleError("no vectors are configured")
        return meaning(concept)

    def means(env, _id, concept, least):
        s = similarity(env, _const(concept))
        env.noted.append(F.when(s.isNull(), f"no vector for the section or for {_const(concept)!r}"))
        return F.coalesce(s >= float(_const(least)), F.lit(False))

    def means_any(env, _id, concepts, least):
        """In order: a concept without vector before the first hit is an error, behind it it is not noticed."""
        hit, error = F.lit(False), F.lit(None).cast("string")
        for c in (c.strip() for c in _const(concepts).split("|") if c.strip()):
            s = similarity(env, c)
            error = F.coalesce(error, F.when(~hit & s.isNull(), f"no vector for the section or for {c!r}"))
            hit = hit | (error.isNull() & F.coalesce(s >= float(_const(least)), F.lit(False)))
        env.noted.append(error)
        return hit

    def synthetic(env, section, name=None):
        made = env.member((*section.names, "is_synthetic_anchor"))
        if made is None:
            return F.lit(False)
        made = F.coalesce(made.cast("boolean"), F.lit(False))
        return made if name is None else made & F.coalesce(env.member((*section.names, "synthetic_anchor")) == F.lit(_const(name) or None), F.lit(False))

    def listed(env, node) -> Column:
        return bindings(node.args[0]) if isinstance(node, ex.Call) and node.name == "SemanticBindings" else bindings(node)

    def nearest(env, text, anchor, width=ex.Lit(40)):
        return primitives.nearest_text(_text(text, env), listed(env, anchor), int(_const(width)))

    def number(env, text, anchor, width=ex.Lit(40)):
        if isinstance(anchor, ex.Lit) and bound is None:  # a word of the text stands for its anchor
            return primitives.number_near(_text(text, env), _const(anchor), int(_const(width)))
        return primitives.number_near_bindings(_text(text, env), listed(env, anchor), int(_const(width)))

    def span(env, anchor, text=None):
        return primitives.anchor_span(bindings(anchor), _const(anchor), None if text is None else _text(text, env))

    def duration(env, text, anchor, width=ex.Lit(120)):
        from .clauses import seconds_near

        return seconds_near(_text(text, env), _const(anchor), max(0, int(_const(width))), bindings(anchor))

    one = lambda f: lambda env, text: f(_text(text, env))
    return {
        "RegexMatch": regex, "PhraseMatch": book, "HasTopic": topic, "ContainsMeaning": means, "MatchesAnyMeaning": means_any,
        "IsTemplateBoilerplate": one(primitives.is_template_boilerplate), "CountProseSentences": one(primitives.count_prose_sentences),
        "IsArbScaffolding": one(primitives.is_review_scaffolding), "IsGlossaryOrAppendixListing": one(primitives.is_glossary_listing),
        "HasSyntheticAnchor": synthetic, "SemanticBindings": lambda env, name: bindings(name), "NearestText": nearest, "ExtractNumberNear": number, "ResolveAnchorSpan": span,
        "ExtractDurationNear": duration, "HasExtractedDurationNear": lambda env, *args: duration(env, *args).isNotNull(),
    }


def section_env(sections: DataFrame, functions: dict[str, Callable]) -> ex.Env:
    """Members of ``input1`` are columns of the section row, and fields of its structs."""
    names = set(sections.columns)
    alias = {"id": "section_id"}

    def member(path):
        path = path[1:] if path[0] == "input1" else path
        if not path or alias.get(path[0], path[0]) not in names:
            return None
        out = F.col(f"`{alias.get(path[0], path[0])}`")
        for p in path[1:]:
            out = out[p]
        return out

    return ex.Env(member, ARRAYS, functions)


#: What a template may name of a section, by its column; and its first sentence.
_SECTION = {"id": "id", "heading": "heading", "headingPath": "heading_path", "category": "category", "text": "text"}
_PLACE = re.compile(r"\{([^{}]+)\}")


def render(template: str | None, rule: Rule, env: ex.Env | None) -> Column:
    """Fills {rule.*}, {section.*}, {meta.k} and {input.path}; what is unknown stays as it is; values are not read again."""
    if template is None:
        return F.lit(None).cast("string")
    known = {"id": rule.id, "version": rule.version, "naturalLanguage": rule.natural_language, "severity": rule.severity, "applicability": rule.applicability, "evidenceQuote": rule.evidence_quote}
    parts, at = [], 0
    for m in _PLACE.finditer(template):
        root, _, rest = m[1].partition(".")
        value = None
        if root == "rule" and rest in known:
            value = F.lit(known[rest])
        elif root == "meta" and rest in rule.metadata:
            value = F.lit(str(rule.metadata[rest]))
        elif root in ("section", "input") and env is not None and rest:
            if root == "section" and rest == "firstSentence":
                own = primitives.first_sentence(env.member(("input1", "text")))
            else:
                own = env.member(("input1", *(_SECTION.get(rest, rest) if root == "section" else rest).split(".")))
            value = None if own is None or (root == "section" and rest not in _SECTION and rest != "firstSentence") else F.coalesce(own.cast("string"), F.lit(m[0]))
        parts += [F.lit(template[at:m.start()]), F.lit(m[0]) if value is None else value]
        at = m.end()
    return F.concat(*parts, F.lit(template[at:]))


def hit_span(rule: Rule, env: ex.Env) -> tuple[Column, Column]:
    """(start, length) in the section's text, as code points, of what a verdict points at: the rule's anchor pattern, else
    the first of its literals that stands in the text, whatever the case; nulls without one."""
    text = env.member(("input1", "text"))
    try:
        words = ex.literals(ex.parse(rule.lambda_))
    except ex.RuleError:
        words = []
    at, size = F.lit(None).cast("int"), F.lit(None).cast("int")
    low = F.lower(text)
    for w in reversed([w for w in words if w]):
        here = F.locate(w.lower(), low)
        at, size = F.when(here > 0, here - 1).otherwise(at), F.when(here > 0, len(w)).otherwise(size)
    if rule.anchor:
        pat = f"(?is){rule.anchor}"
        long = F.char_length(F.regexp_extract(text, pat, 0))
        at, size = F.when(long > 0, F.regexp_instr(text, F.lit(pat)) - 1).otherwise(at), F.when(long > 0, long).otherwise(size)
    return at, size


def clause_of(text: Column, at: Column, size: Column) -> Column:
    """struct<start, length> of the lines that a hit touches; without a hit, of all from the first that is not empty to
    the last; null for an empty text."""
    n = F.char_length(text)
    lead = n - F.char_length(F.ltrim(text, F.lit("\n")))
    whole = F.char_length(F.trim(text, F.lit("\n")))
    begin = at - F.char_length(F.substring_index(F.substring(text, F.lit(1), at), "\n", -1))
    stop = at + size + F.char_length(F.substring_index(F.substring(text, at + size + 1, n), "\n", 1))
    return F.when(whole > 0, F.struct(F.coalesce(begin, lead).alias("start"), F.coalesce(stop - begin, whole).alias("length")))


def applies_to_kind(rule: Rule, rules: RuleSet, kind: Column | None) -> Column:
    """No lists, or the document's kind in either; unknown kinds are kinds too, a null kind gates nothing."""
    lists = {k.strip().lower() for k in (*rule.kinds, *rules.kinds) if k.strip()}
    if kind is None or not lists:
        return F.lit(True)
    return kind.isNull() | F.lower(kind).isin(*sorted(lists))


@dataclass(frozen=True)
class Options:
    floor: float = 0.0  # least share of a rule's topic words in a section, for rules without a predicate
    kind_col: str | None = None
    vector_col: str | None = None  # sections' vectors
    rule_vectors: dict | None = None  # rule id to its vector
    meaning: Callable | None = None  # of a concept: its similarity column (see ``semantic.meaning``)
    bindings_col: str | None = None  # bindings of all rules' anchors (see ``semantic.bind``)
    least_anchors: int = 0  # with it, a Pass of a rule of two anchors or more needs so many of them bound
    prefilter: bool = False  # by the atoms of predicates, whatever stands around them: drops what a negated atom would admit


def floor_words(rule: Rule) -> list[str]:
    """A rule's topic words: of its evidence (else its sentence) and its topic slug."""
    seed = (rule.evidence_quote.strip() and rule.evidence_quote) or rule.natural_language
    found = re.findall(r"[^\W_]+", f"{seed} {rule.metadata.get('topicSlug', '')}".lower())
    return sorted({w for w in found if len(w) >= 3 and w not in primitives.FLOOR_STOPWORDS})


def binding_key(rule: Rule, anchor: str) -> str:
    return f"{rule.id}{hashing.UNIT}{anchor}"


def _state(rule: Rule, rules: RuleSet, env: ex.Env, o: Options) -> tuple[Column, Column]:
    """(outcome, error) of a rule at a section. Outcome null: it does not come to a verdict; 'floor': stopped by the floor."""
    none = F.lit(None).cast("string")
    kind = F.col(o.kind_col) if o.kind_col else None
    member = lambda path: env.member(("input1", *path.split(".")))
    gate = applies_to_kind(rule, rules, kind) & section_selector(rule.selector, member, F.col("ord"))
    if o.prefilter:
        from .governance import candidate

        gate = gate & candidate(rule, env)
    if rule.gate_threshold > 0 and o.vector_col and (o.rule_vectors or {}).get(rule.id):
        v = F.array(*(F.lit(float(x)) for x in o.rule_vectors[rule.id]))
        gate = gate & F.coalesce(cosine(F.col(o.vector_col), v) >= rule.gate_threshold, F.lit(True))
    if o.bindings_col:
        env = replace(env, functions=functions_for(rules, o.meaning, lambda anchor: F.try_element_at(F.col(o.bindings_col), F.lit(binding_key(rule, anchor)))), noted=[])
    try:
        applies, p_error = ex.checked(ex.parse(rule.predicate), env)
    except ex.RuleError as e:
        applies, p_error = F.lit(True), F.lit(str(e))
    p_error = None if p_error is None else F.concat(F.lit("predicate: "), p_error)
    try:
        passes, l_error = ex.checked(ex.parse(rule.lambda_), env)
    except ex.RuleError as e:
        passes, l_error = F.lit(False), F.lit(str(e))
    outcome = F.when(passes, "Pass").otherwise("Fail")
    error = F.when(~passes, f"Rule '{rule.id}' failed: {rule.natural_language}")
    if o.least_anchors and len(rule.anchors) >= 2 and o.bindings_col:
        from .semantic import cohesion

        seen = [F.coalesce(F.size(F.try_element_at(F.col(o.bindings_col), F.lit(binding_key(rule, a["name"])))) > 0, F.lit(False)).cast("int") for a in rule.anchors]
        outcome = cohesion(outcome, sum(seen[1:], seen[0]), len(rule.anchors), o.least_anchors)
    if l_error is not None:
        outcome, error = F.when(l_error.isNotNull(), "Error").otherwise(outcome), F.coalesce(l_error, error)
    outcome, error = F.when(applies, outcome), F.when(applies, error)
    if p_error is not None:
        outcome, error = F.when(p_error.isNotNull(), "Error").otherwise(outcome), F.coalesce(p_error, error)
    outcome, error = F.when(gate, outcome), F.when(gate, error)
    words = floor_words(rule)
    if o.floor > 0 and rule.gate_threshold <= 0 and rule.predicate == "true" and words:
        own = primitives.floor_tokens(env.member(("input1", "text")))
        low = F.size(F.array_intersect(own, F.array(*(F.lit(w) for w in words)))) / float(len(words)) < o.floor
        outcome, error = F.when(gate & low, "floor").otherwise(outcome), F.when(gate & low, none).otherwise(error)
    return outcome, error


def verdict_id(rule: Rule, rules: RuleSet, document: Column, start: Column, length: Column, outcome: Column, clause: tuple[Column, Column] | None = None) -> Column:
    pred = hashing.content_hash(F.lit(rule.predicate))
    base = [F.lit("verdict"), F.lit(rule.id), F.lit(rule.version), F.lit(rules.id), F.lit(rules.version), pred, document, start, length, outcome]
    joined = [x for c in base for x in (F.coalesce(c.cast("string"), F.lit("")), F.lit(hashing.UNIT))]
    if clause is not None:
        more = F.when(clause[0].isNotNull(), F.concat(F.lit("clause:"), clause[0].cast("string"), F.lit(hashing.UNIT), F.lit("clauseLen:"), clause[1].cast("string"), F.lit(hashing.UNIT)))
        joined.append(F.coalesce(more, F.lit("")))
    return hashing.content_hash(F.concat(*joined))


_FIELDS = ("rule_id", "section_id", "ord", "outcome", "error", "remediation", "start", "length", "clause_start", "clause_length", "verdict_id")


def _struct(**values: Column) -> Column:
    kinds = {"ord": "int", "start": "int", "length": "int", "clause_start": "int", "clause_length": "int"}
    return F.struct(*(values[n].cast(kinds.get(n, "string")).alias(n) for n in _FIELDS))


def evaluate(sections: DataFrame, rules: RuleSet, options: Options = Options()) -> DataFrame:
    """One row per verdict: doc_id, rule_id, section_id, ord, outcome, error, remediation, start, length, clause_start,
    clause_length, verdict_id. A Fail points at what its rule names and at the lines around that; others at the section.

    A rule that comes to no verdict in a document gives one row without section: Skipped for a document of another
    kind; NotApplicable if the floor stopped it or it is not mandatory; else a Gap. ``sections``: doc_id, ord,
    section_id, heading, text, char_start and whatever the rules name; every document to be judged needs a row (a
    document without sections: one with a null section_id, which no rule sees).
    """
    env = section_env(sections, functions_for(rules, options.meaning))
    ordered = sorted((r for r in rules.rules if r.mode != "facts"), key=lambda r: r.id)
    if not ordered:
        raise ValueError("the rule set has no section rules")
    spanned = "span_start" in sections.columns  # of the section's heading, where there is one
    own_start, own_length = (F.col("span_start"), F.col("span_length")) if spanned else (F.col("char_start"), F.char_length("text"))
    seen = F.col("section_id").isNotNull()
    shown, said, floored = sections, [], []
    for at in range(0, len(ordered), RULES_PER_STEP):
        part = list(enumerate(ordered))[at:at + RULES_PER_STEP]
        # a column a step: what several columns use is computed once
        shown = shown.withColumns({f"__s{k}": F.when(seen, F.struct(*(c.alias(n) for n, c in zip(("outcome", "error"), _state(r, rules, env, options))))) for k, r in part})
        failed = {k: F.col(f"__s{k}.outcome") == "Fail" for k, _ in part}
        shown = shown.withColumns({f"__h{k}": F.when(failed[k], F.struct(*(c.alias(n) for n, c in zip(("at", "size"), hit_span(r, env))))) for k, r in part})
        shown = shown.withColumns({f"__c{k}": F.when(failed[k], clause_of(F.col("text"), F.col(f"__h{k}.at"), F.col(f"__h{k}.size"))) for k, _ in part})
        made = []
        for k, r in part:
            outcome, error = F.col(f"__s{k}.outcome"), F.col(f"__s{k}.error")
            start, length = F.coalesce(F.col("char_start") + F.col(f"__h{k}.at"), own_start), F.coalesce(F.col(f"__h{k}.size"), own_length)
            clause, span = F.col("char_start") + F.col(f"__c{k}.start"), F.col(f"__c{k}.length")
            verdict = _struct(
                rule_id=F.lit(r.id), section_id=F.col("section_id"), ord=F.col("ord"), outcome=outcome, error=error, remediation=F.when(failed[k], render(r.remediation, r, env)),
                start=start, length=length, clause_start=clause, clause_length=span, verdict_id=verdict_id(r, rules, F.col("doc_id"), start, length, outcome, (clause, span)))
            made.append(F.when(outcome != "floor", verdict))  # null, and not computed, where a rule says nothing
        said.append(F.array_compact(F.array(*made)))
        if options.floor > 0:
            floored.append(F.array_compact(F.array(*(F.when(F.col(f"__s{k}.outcome") == "floor", k) for k, _ in part))))
    none = F.array().cast("array<int>")
    kind = F.col(options.kind_col) if options.kind_col else F.lit(None).cast("string")
    rows = shown.select("doc_id", kind.alias("__kind"), F.concat(*said).alias("said"), (F.concat(*floored) if floored else none).alias("floored"))
    docs = rows.groupBy("doc_id").agg(F.first("__kind").alias("__kind"), F.flatten(F.collect_list("said")).alias("said"), F.flatten(F.collect_list("floored")).alias("floored"))
    docs = docs.withColumn("spoke", F.array_distinct(F.transform("said", lambda v: v["rule_id"])))
    absent = [_absent(k, r, rules, options) for k, r in enumerate(ordered)]
    return docs.select("doc_id", F.inline(F.concat("said", F.array_compact(F.array(*absent)))))


def _absent(k: int, r: Rule, rules: RuleSet, o: Options) -> Column:
    """The verdict of a rule that said nothing in a document; null if it spoke."""
    other_kind = ~applies_to_kind(r, rules, F.col("__kind") if o.kind_col else None)
    times = F.size(F.filter("floored", lambda x: x == k)) if o.floor > 0 else F.lit(0)
    outcome = F.when(other_kind, "Skipped").when(times > 0, "NotApplicable").otherwise("Gap" if r.applicability == "Mandatory" else "NotApplicable")
    error = F.when(other_kind, F.concat(F.lit("doc_kind_mismatch:"), F.col("__kind"))).when(
        times > 0, F.concat(F.lit("applicability_floor:no_relevant_section (filtered "), times.cast("string"), F.lit(" candidate section(s))")))
    predicate = hashing.PREFIX + hashlib.sha256(r.predicate.encode()).hexdigest()
    made = {x: hashing.address("verdict", r.id, r.version, rules.id, rules.version, predicate, r.source_document, str(r.source_start), str(r.source_length), x) for x in ("Skipped", "NotApplicable", "Gap")}
    ids = F.when(outcome == "Skipped", made["Skipped"]).when(outcome == "Gap", made["Gap"]).otherwise(made["NotApplicable"])
    none = F.lit(None)
    verdict = _struct(
        rule_id=F.lit(r.id), section_id=none, ord=none, outcome=outcome, error=error, remediation=F.when(outcome == "Gap", F.lit(f"Document does not address: {r.natural_language}")),
        start=F.lit(r.source_start), length=F.lit(r.source_length), clause_start=none, clause_length=none, verdict_id=ids)
    return F.when(~F.array_contains("spoke", r.id), verdict)


def _counts() -> list[Column]:
    names = {"Pass": "passed", "Fail": "failed", "Error": "errored", "Gap": "gaps", "NotApplicable": "not_applicable", "Skipped": "skipped"}
    return [F.count_if(F.col("outcome") == k).alias(v) for k, v in names.items()]


def _score() -> Column:
    judged = F.col("passed") + F.col("failed") + F.col("gaps")
    return F.when(judged == 0, 1.0).otherwise(F.col("passed") / judged)


def report(verdicts: DataFrame) -> DataFrame:
    """Per document: counts by outcome, score = passed / (passed + failed + gaps) (1 without any), wrong_profile: all skipped."""
    out = verdicts.groupBy("doc_id").agg(F.count("*").alias("total"), *_counts())
    return out.withColumn("score", _score()).withColumn("wrong_profile", (F.col("skipped") == F.col("total")) & (F.col("total") > 0))


def rule_summaries(verdicts: DataFrame) -> DataFrame:
    """Per document and rule: counts, the strongest outcome (Pass, Fail, Error, Gap, NotApplicable, Skipped), the first
    verdict of that outcome in path order, and the rule's own score."""
    rank = F.array_position(F.array(*(F.lit(x) for x in OUTCOMES)), F.col("outcome")).cast("int")
    path = F.coalesce(F.concat(F.lit("$.sections["), F.col("ord").cast("string"), F.lit("]")), F.lit(""))
    out = verdicts.groupBy("doc_id", "rule_id").agg(
        F.count("section_id").alias("sections_evaluated"), *_counts(), F.min_by("outcome", rank).alias("outcome"), F.min_by("verdict_id", F.struct(rank.alias("r"), path.alias("p"), "verdict_id")).alias("representative"))
    return out.withColumn("score", _score())


def rule_outcome_counts(summaries: DataFrame) -> DataFrame:
    """Per document: how many rules ended in each outcome."""
    return summaries.groupBy("doc_id").agg(F.count("*").alias("rules"), *_counts())


def review(docs_sections: DataFrame, rules: RuleSet, options: Options = Options(), domain: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(verdicts, reports); the domain gate is checked before anything runs."""
    require_domain(domain, rules)
    v = evaluate(docs_sections, rules, options)
    return v, report(v)
