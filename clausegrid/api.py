"""From files to reports in one call, every gate a parameter."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import authoring, clauses, evaluate, governance, project, semantic
from .operators.evaluate import Options, RuleSet
from .operators.project import TopicMap
from .sources import documents


def project_files(spark: SparkSession, path: str, topics: TopicMap, wrappers: bool = True) -> DataFrame:
    """Sections of all files under ``path`` that have a parser, with aliases of parties written out."""
    blocks = documents.blocks(documents.read_files(spark, path))
    sections = project.group_by_heading(blocks).withColumn("text_raw", F.col("text"))
    aliases = project.party_aliases(blocks).groupBy("doc_id").agg(F.collect_list(F.struct("alias", "canonical")).alias("aliases"))
    sections = sections.join(aliases, "doc_id", "left").withColumn("text", project.apply_aliases(F.col("text"), F.col("aliases"))).drop("aliases")
    out = project.enrich(sections, topics)
    return clauses.expand_wrappers(out, topics) if wrappers else out


def active_rules(rules: RuleSet, disabled: DataFrame | None) -> RuleSet:
    """The rule set without the rules of an overlay (rule_id): a rule set's few, so they come to the driver."""
    off = {r["rule_id"] for r in disabled.select("rule_id").collect()} if disabled is not None else set()
    return replace(rules, rules=tuple(r for r in rules.rules if r.id not in off))


def document_kinds(spark: SparkSession, path: str, explicit: str | None = None) -> DataFrame:
    """(doc_id, kind): what ``explicit`` says, else the path, else the first blocks, else 'unknown'."""
    files = documents.read_files(spark, path)
    votes = project.document_kinds(documents.blocks(files)).select("doc_id", F.col("kind").alias("voted"))
    named = files.join(votes, "doc_id", "left").select("doc_id", project.resolve_kind(F.lit(explicit).cast("string"), F.col("path"), F.col("voted")).alias("kind"))
    return named.groupBy("doc_id").agg(F.min("kind").alias("kind"))  # equal files are one document


def add_synthetic(sections: DataFrame, anchors: DataFrame, least: float = 0.30) -> DataFrame:
    """``sections`` (with their embedding) and the synthetic ones that anchors(topic, anchor, vector) give, behind them."""
    made = semantic.synthetic_sections(sections, anchors, least)
    last = sections.groupBy("doc_id").agg(F.max("ord").alias("__last"))
    n = F.regexp_extract("section_id", r"_([0-9]+)$", 1).cast("int")
    rows = made.join(last, "doc_id").select(
        "doc_id", (F.col("__last") + n).cast("int").alias("ord"), "section_id", F.col("topic").alias("heading"), "text", F.col("topic").alias("primary_topic"), F.col("topic").alias("category"),
        F.array("topic").alias("topics"), F.create_map("topic", "synthetic_cosine").alias("topic_scores"), F.lit(0).cast(sections.schema["char_start"].dataType).alias("char_start"),
        F.lit(True).alias("is_synthetic_anchor"), "synthetic_from", "synthetic_anchor", "synthetic_cosine")
    return sections.unionByName(rows, allowMissingColumns=True)


def review(spark: SparkSession, path: str, rules: RuleSet, topics: TopicMap, disabled: DataFrame | None = None, domain: str | None = None, kinds: bool = False, options: Options = Options(),
           embed: Callable[[Column], Column] | None = None, embedder: str | None = None, anchors: DataFrame | None = None, kind: str | None = None) -> dict[str, DataFrame]:
    """verdicts, reports, rules (summaries) and coverage of a folder of documents.

    ``kinds`` gates by each document's kind (``kind``: the same for all); 'unknown' is a kind too. ``embed`` maps a text
    column to a vector column, as ``embedder`` names it: with it rules may ask for meanings, their anchors are bound, and
    ``anchors`` (topic, anchor, vector) give synthetic sections for topics that a document lacks.
    """
    evaluate.require_domain(domain, rules)
    evaluate.require_embedder(embedder, rules)
    rules = active_rules(rules, disabled)
    sections = project_files(spark, path, topics)
    if embed is not None:
        sections = semantic.embed_sections(sections, embed)
        if anchors is not None:
            sections = add_synthetic(sections, anchors)
        sections = semantic.bind(sections, rules, embed)
        vectors = semantic.embed_texts(spark, semantic.concepts_of(rules), embed)
        options = replace(options, meaning=options.meaning or semantic.meaning("embedding", vectors), bindings_col="__bindings", vector_col=options.vector_col or "embedding")
    if kinds or kind:
        found = document_kinds(spark, path, kind).withColumnRenamed("kind", "__doc_kind")
        sections = sections.join(found, "doc_id", "left").withColumn("__doc_kind", F.coalesce("__doc_kind", F.lit("unknown")))
        options = replace(options, kind_col="__doc_kind")
    verdicts = evaluate.evaluate(sections, rules, options)
    return {"verdicts": verdicts, "reports": evaluate.report(verdicts), "rules": evaluate.rule_summaries(verdicts), "coverage": governance.coverage(verdicts)}


def extract_rules(spark: SparkSession, path: str, templates: list[authoring.Template], prefix: str = "X", min_chars: int = 200) -> tuple[DataFrame, DataFrame]:
    """(rules, counts) from a folder of policies: blocks of ``min_chars`` or more meet the templates, rules are numbered by
    document and topic, and of equal decisions the one of the least id stays."""
    files = documents.read_files(spark, path)
    blocks = documents.blocks(files)
    # numbers run within a document: its own prefix keeps ids of different documents apart
    chunks = blocks.select("doc_id", F.col("block_ord").alias("chunk_ord"), "text", "char_start", "char_length", "heading_path")
    made = authoring.stamp_ids(authoring.author_from_templates(chunks, templates, min_chars), "")
    made = made.withColumn("rule_id", F.concat(F.lit(prefix), F.upper(F.substring(F.sha2("doc_id", 256), 1, 4)), F.lit("-"), "rule_id"))
    placed = made.join(chunks.select("doc_id", "chunk_ord", F.col("char_start").alias("source_start"), F.col("char_length").alias("source_length"), "heading_path"), ["doc_id", "chunk_ord"])
    rules = governance.deduplicate(placed)
    fair = F.char_length(F.trim("text")) > 0
    counts = blocks.agg(F.count_if(fair & (F.char_length("text") >= min_chars)).alias("blocks_examined"), F.count_if(~fair | (F.char_length("text") < min_chars)).alias("blocks_skipped_short"))
    return rules, counts
