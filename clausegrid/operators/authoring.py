"""Rules from policy text: templates, checks of proposed rules, identifiers, chunks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What a keyword-only lambda may be made of.
_WHITELIST = r'''^(?:input1\.text(?:\.ToLower\(\))?\.Contains\("(?:[^"\\]|\\.)*"\)|\|\||&&|[()]|\s)+$'''


@dataclass(frozen=True)
class Template:
    """A rule that is proposed for a chunk which holds any trigger."""

    topic: str
    triggers: tuple[str, ...]
    lambda_: str
    severity: str = "Violation"


def applicability(text: Column) -> Column:
    low = F.lower(text)
    has = lambda *ws: F.regexp_like(low, F.lit(r"\b(" + "|".join(ws) + r")\b"))
    return F.when(has("must", "shall"), "Mandatory").when(has("if", "when"), "Conditional").when(has("should"), "Optional").otherwise("Mandatory")


def author_from_templates(chunks: DataFrame, templates: list[Template], min_chars: int = 0) -> DataFrame:
    """chunks(doc_id, chunk_ord, text) to proposed rules: doc_id, chunk_ord, topic, predicate, lambda, severity, applicability,
    evidence. Templates are literals, so a chunk meets them all in one projection."""
    low = F.lower("text")
    def proposed(t: Template) -> Column:
        hit = F.lit(False)
        for w in t.triggers:
            hit = hit | F.contains(low, F.lit(w.lower()))
        return F.when(hit, F.struct(F.lit(t.topic).alias("topic"), F.lit(f'input1.category == "{t.topic}"').alias("predicate"), F.lit(t.lambda_).alias("lambda"), F.lit(t.severity).alias("severity")))

    made = F.filter(F.array(*map(proposed, templates)), lambda x: x.isNotNull())
    fair = chunks.where(F.char_length("text") >= min_chars)
    return fair.select("doc_id", "chunk_ord", applicability(F.col("text")).alias("applicability"), F.substring("text", 1, 200).alias("evidence"), F.inline(made))


def stamp_ids(rules: DataFrame, prefix: str = "") -> DataFrame:
    """rule_id = {prefix}{TOPIC}-{NNN}, counted within a document and topic in chunk order."""
    n = F.row_number().over(Window.partitionBy("doc_id", "topic").orderBy("chunk_ord", "lambda"))
    return rules.withColumn("rule_id", F.concat(F.lit(prefix), F.upper("topic"), F.lit("-"), F.lpad(n.cast("string"), 3, "0")))


def is_plain_lambda(text: Column) -> Column:
    """Whether a lambda is made of substring tests and logic alone."""
    return F.coalesce(F.regexp_like(text, F.lit(_WHITELIST)), F.lit(False))


def validate_candidates(candidates: DataFrame) -> DataFrame:
    """candidates(slug, quote, chunk, lambda, natural_language) with ``problem``: null for a sound rule."""
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    problem = (F.when(~F.coalesce(F.regexp_like("slug", F.lit("^[A-Z]{3,6}$")), F.lit(False)), "slug").when(blank("natural_language"), "natural_language")
               .when(blank("quote") | ~F.coalesce(F.contains("chunk", F.col("quote")), F.lit(False)), "quote").when(~is_plain_lambda(F.col("lambda")), "lambda"))
    return candidates.withColumn("problem", problem)


def section_identity(parent: Column, heading: Column) -> Column:
    joined = F.concat(F.coalesce(parent, F.lit("")), F.lit("::"), F.coalesce(heading, F.lit("")))
    return F.concat(F.lit("section:"), F.substring(F.sha2(joined.cast("binary"), 256), 1, 16))


def reassemble(chunks: DataFrame, separator: str = "\n") -> DataFrame:
    """chunks(parent, part, ord, text) joined in order per (parent, part); chunks without part stay single."""
    alone = chunks.where("part is null").select("parent", "part", "text", F.lit(1).cast("bigint").alias("n"))
    held = chunks.where("part is not null").groupBy("parent", "part").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "text"))), lambda c: c["text"]), separator).alias("text"), F.count("*").alias("n"))
    return held.unionByName(alone)


def synopsis(text: Column, limit: int = 200) -> Column:
    """First sentence, cut at ``limit`` characters with an ellipsis."""
    from ..functions.primitives import first_sentence

    s = first_sentence(text)
    return F.when(F.char_length(s) > limit, F.concat(F.substring(s, 1, limit - 1), F.lit("…"))).otherwise(s)


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")


def suggest_topics(headings: DataFrame, known: DataFrame, top: int = 3) -> DataFrame:
    """headings(heading_id, heading) against known(topic, keyword): the ``top`` topics by shared words, ties by name."""
    words = headings.select("heading_id", F.explode(F.array_distinct(F.split(slug(F.col("heading")), "_"))).alias("w")).where("char_length(w) > 2")
    seeds = known.select("topic", F.explode(F.split(slug(F.col("keyword")), "_")).alias("w")).distinct()
    scored = words.join(seeds, "w").groupBy("heading_id", "topic").agg(F.count("*").alias("score"))
    rank = F.row_number().over(Window.partitionBy("heading_id").orderBy(F.desc("score"), "topic"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= top)


def with_client(rows: DataFrame, client: Callable[[str], str | None], text_col: str = "text", out_col: str = "answer", cache: DataFrame | None = None) -> DataFrame:
    """Runs a pluggable text client over distinct texts: what ``cache(text, answer)`` has is not asked again. The client is
    made for executors: any picklable callable, such as a recorded replay; an exception becomes a null answer."""
    asked = rows.select(F.col(text_col).alias("__t")).where("__t is not null").distinct()
    if cache is not None:
        asked = asked.join(cache.select(F.col(text_col).alias("__t")), "__t", "left_anti")

    def run(batches: Iterator):
        for pdf in batches:
            answers = []
            for t in pdf["__t"]:
                try:
                    answers.append(client(t))
                except Exception:  # noqa: BLE001  a failing call must not lose the batch
                    answers.append(None)
            yield pdf.assign(**{out_col: answers})

    new = asked.mapInPandas(run, f"__t string, {out_col} string")
    if cache is not None:
        new = new.unionByName(cache.select(F.col(text_col).alias("__t"), out_col))
    return rows.join(new, rows[text_col] == new["__t"], "left").drop("__t")


# ---- rules that a text client proposes, as JSON ----

#: Fields of a proposed rule and what each has to be; fixed values. Texts: least and greatest length; lists: least and
#: greatest size, then that of their texts.
PROPOSAL_TEXTS = {"naturalLanguage": (8, 240), "predicate": (0, None), "lambda": (0, None), "remediation": (16, 800), "evidenceQuote": (1, 200)}
PROPOSAL_CHOICES = {"severity": ("Violation", "Warning", "Info"), "applicability": ("Mandatory", "Optional")}
PROPOSAL_ID = "^[A-Z][A-Z0-9_-]{2,80}$"
PROPOSAL_LISTS = {"concepts": (3, 8, 3, 80), "examples.positive": (3, 3, 16, 600), "examples.negative": (3, 3, 16, 600)}
PROPOSAL_FIELDS = ("ruleId", "naturalLanguage", "predicate", "lambda", "concepts", "severity", "applicability", "remediation", "evidenceQuote", "sourceSpan", "examples", "metadata")
PROPOSAL_PARTS = {"sourceSpan": ("documentId", "headingPath", "pageNumber", "charStart", "charLength"), "examples": ("positive", "negative")}


def proposal_problems(raw: Column) -> Column:
    """array<string> of what is wrong with a proposed rule's JSON, by field; empty for a sound one, one entry if it is no JSON object."""
    doc = F.try_parse_json(raw)
    at = lambda path, kind="string": F.try_variant_get(doc, f"$.{path}", kind)
    is_text = lambda path: F.coalesce(F.schema_of_variant(F.try_variant_get(doc, f"$.{path}", "variant")) == "STRING", F.lit(False))
    fails = lambda ok, what: F.when(~F.coalesce(ok, F.lit(False)), F.lit(what))
    within = lambda n, lo, hi: (n >= lo) if hi is None else n.between(lo, hi)
    found = [fails(is_text("ruleId") & F.regexp_like(at("ruleId"), F.lit(PROPOSAL_ID)), "ruleId")]
    found += [fails(is_text(f) & within(F.char_length(at(f)), lo, hi), f) for f, (lo, hi) in PROPOSAL_TEXTS.items()]
    found += [fails(is_text(f) & at(f).isin(*choices), f) for f, choices in PROPOSAL_CHOICES.items()]
    for f, (lo, hi, least, most) in PROPOSAL_LISTS.items():
        items = at(f, "array<string>")
        found.append(fails(F.size(items).between(lo, hi) & F.forall(items, lambda x: F.coalesce(F.char_length(x).between(least, most), F.lit(False))), f))
    numbers = [at(f"sourceSpan.{f}").isNull() | (at(f"sourceSpan.{f}", "bigint") >= least) for f, least in (("pageNumber", 1), ("charStart", 0), ("charLength", 0))]
    found.append(fails(is_text("sourceSpan.documentId") & numbers[0] & numbers[1] & numbers[2], "sourceSpan"))
    found.append(fails(F.forall(F.map_values(at("metadata", "map<string,variant>")), lambda v: F.schema_of_variant(v) == "STRING"), "metadata"))
    known = lambda text, names: F.size(F.array_except(F.json_object_keys(text), F.array(*(F.lit(n) for n in names)))) == 0
    found.append(fails(known(raw, PROPOSAL_FIELDS), "unknown field"))
    found += [fails(known(F.to_json(F.try_variant_get(doc, f"$.{f}", "variant")), names), f"unknown field in {f}") for f, names in PROPOSAL_PARTS.items()]
    is_object = F.try_variant_get(doc, "$", "map<string,variant>").isNotNull()
    return F.when(is_object, F.array_compact(F.array(*found))).otherwise(F.array(F.lit("no JSON object")))


_RECORDS = "values array<struct<recordId:string,data:struct<chunk:string,documentId:string,parentDocumentId:string,headingPath:string,chunkOrdinal:int>>>"


def skill_records(requests: DataFrame) -> DataFrame:
    """Records of batch requests (request_id, body): request_id, place, record_id, chunk, document_id, parent_id, heading, section
    (``section_identity``)."""
    held = requests.select("request_id", F.posexplode(F.from_json("body", _RECORDS)["values"]).alias("place", "v"))
    parent = F.coalesce("v.data.parentDocumentId", "v.data.documentId")
    return held.select("request_id", "place", F.col("v.recordId").alias("record_id"), F.col("v.data.chunk").alias("chunk"), F.col("v.data.documentId").alias("document_id"), parent.alias("parent_id"),
                       F.col("v.data.headingPath").alias("heading"), section_identity(parent, F.col("v.data.headingPath")).alias("section"))


def skill_responses(records: DataFrame, answers: DataFrame) -> DataFrame:
    """(request_id, body) for records and what a client answered to each: answers(request_id, record_id, answer). An answer that
    is no sound proposal becomes an error of its record; each record gives one, in the order of the request."""
    joined = records.join(answers, ["request_id", "record_id"], "left")
    wrong = F.when(F.coalesce(F.trim("chunk") == "", F.lit(True)), F.array(F.lit("empty chunk"))).when(F.col("answer").isNull(), F.array(F.lit("no answer"))).otherwise(proposal_problems(F.col("answer")))
    errors = F.transform(F.slice(wrong, F.lit(1), F.lit(3)), lambda m: F.struct(m.alias("message")))
    text = F.concat(F.lit('{"recordId":'), F.to_json(F.array("record_id")).substr(F.lit(2), F.char_length(F.to_json(F.array("record_id"))) - 2), F.lit(',"data":{'),
                    F.when(F.size(wrong) == 0, F.concat(F.lit('"rule":'), F.col("answer"), F.lit(',"section":"'), F.col("section"), F.lit('"'))).otherwise(""), F.lit('},"errors":'), F.to_json(errors), F.lit(',"warnings":[]}'))
    bodies = joined.select("request_id", "place", text.alias("t")).groupBy("request_id").agg(F.sort_array(F.collect_list(F.struct("place", "t"))).alias("l"))
    return bodies.select("request_id", F.concat(F.lit('{"values":['), F.array_join(F.transform("l", lambda x: x["t"]), ","), F.lit("]}")).alias("body"))
