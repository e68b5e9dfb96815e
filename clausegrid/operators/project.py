"""Documents to sections, and what a section is said to be about."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import let, running_totals
from ..functions.textfeatures import text_features

UNKNOWN = "unknown"
HEADING_SCORE, BODY_SCORE, AXIS_SCORE, INHERITED_SCORE, BY_TITLE_SCORE = 0.9, 0.4, 1.0, 0.95, 0.85


@dataclass(frozen=True)
class TopicMap:
    """Topics in order, each with lower-case keywords; axes tag headings; amendments name a heading in group 1."""

    id: str
    topics: tuple[tuple[str, tuple[str, ...]], ...]
    axes: tuple[tuple[str, tuple[str, ...]], ...] = ()
    amendments: tuple[str, ...] = ()

    @staticmethod
    def from_json(spec: dict) -> "TopicMap":
        return TopicMap(
            spec.get("id") or f"{spec.get('domain', 'map')}.{spec.get('version', 'v1')}",
            tuple((t["id"], tuple(t.get("keywords", ()))) for t in spec.get("topics", ()) if not t.get("axis")),
            tuple((a, tuple(d.get("headingPatterns", ()))) for a, d in (spec.get("axes") or {}).items()), tuple(spec.get("amendmentPatterns") or ()))


def section_id(position: Column) -> Column:
    return F.format_string("s_%08d", position.cast("int"))


def split_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A section for each line: doc_id, ord, section_id, text, char_start. A null text has none; nothing is shuffled."""
    lines = let(F.split(F.col(text_col), "\n"), lambda own: F.zip_with(
        own, running_totals(F.transform(own, lambda x: F.char_length(x) + 1)), lambda text, start: F.struct(text.alias("text"), start.alias("char_start"))))
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(lines).alias("ord", "line")).select(
        "doc_id", "ord", F.col("line.text").alias("text"), section_id(F.col("ord")).alias("section_id"), F.col("line.char_start").alias("char_start"))


def group_by_heading(blocks: DataFrame) -> DataFrame:
    """Blocks (doc_id, block_ord, kind, text, char_start[, char_length, heading_path]) to sections: a heading begins one, and blocks
    before the first heading are one without heading. A document's blocks meet in one window, so they stay in order."""
    order = Window.partitionBy("doc_id").orderBy("block_ord")
    is_heading = F.col("kind") == "heading"
    path = F.col("heading_path") if "heading_path" in blocks.columns else F.lit(None).cast("string")
    size = F.col("char_length") if "char_length" in blocks.columns else F.char_length("text")
    grouped = blocks.withColumn("grp", F.sum(is_heading.cast("int")).over(order)).withColumn("path", path)
    body = F.sort_array(F.collect_list(F.when(~is_heading, F.struct("block_ord", "text"))))
    out = grouped.groupBy("doc_id", "grp").agg(
        F.max(F.when(is_heading, F.col("text"))).alias("heading"), F.max(F.when(is_heading, F.col("path"))).alias("heading_path"),
        F.array_join(F.transform(body, lambda b: b["text"]), "\n").alias("text"),
        F.coalesce(F.min_by(F.when(~is_heading, F.col("char_start")), F.when(~is_heading, F.col("block_ord"))), F.min("char_start")).alias("char_start"),
        F.min_by("char_start", "block_ord").alias("span_start"), F.min_by(size, "block_ord").alias("span_length"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("grp")) - 1
    return out.withColumn("ord", place).select(
        "doc_id", "ord", section_id(F.col("ord")).alias("section_id"), F.coalesce("heading", F.lit("")).alias("heading"), F.coalesce("heading_path", F.lit("/")).alias("heading_path"), "text", "char_start", "span_start", "span_length")


def _any(text: Column, words) -> Column:
    hit = F.lit(False)
    for w in words:
        hit = hit | F.contains(text, F.lit(w))
    return hit


def topic_scores(heading: Column, body: Column, topics: TopicMap) -> Column:
    """array<struct<topic, score>> by score and then name: headings outweigh bodies, axes tag headings only."""
    head, low = F.lower(F.coalesce(heading, F.lit(""))), F.lower(F.coalesce(body, F.lit("")))
    entry = lambda t, s: F.struct(F.lit(t).alias("topic"), s.alias("score"))
    own = [entry(t, F.when(_any(head, kw), HEADING_SCORE).when(_any(low, kw), BODY_SCORE)) for t, kw in topics.topics]
    own += [entry(f"{a}:{p.replace(' ', '_')}", F.when(F.contains(head, F.lit(p)), AXIS_SCORE)) for a, pats in topics.axes for p in pats]
    found = F.filter(F.array(*own), lambda e: e["score"].isNotNull())
    by = lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).when(a["topic"] < b["topic"], -1).when(a["topic"] > b["topic"], 1).otherwise(0)
    return F.array_sort(found, by)


def primary_topic(heading: Column, topics: TopicMap) -> Column:
    """The first topic of the map with a keyword in the heading; null if none has."""
    head = F.lower(F.coalesce(heading, F.lit("")))
    out = F.lit(None).cast("string")
    for t, kw in reversed(topics.topics):
        out = F.when(_any(head, kw), t).otherwise(out)
    return out


def is_supplement(heading: Column, topics: TopicMap) -> Column:
    """Whether the heading names a jurisdiction, country or region."""
    return _any(F.lower(F.coalesce(heading, F.lit(""))), [p for a, pats in topics.axes if a in ("jurisdiction", "country", "region") for p in pats])


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: F.char_length(w) > 0))


def topic_density(primary: Column, body: Column, topics: TopicMap) -> Column:
    """Non-overlapping keyword hits of the primary topic per hundred words, to four places, halves to even."""
    low = F.lower(body)
    hits = F.lit(0)
    for t, kws in topics.topics:
        own = sum(((F.char_length(low) - F.char_length(F.replace(low, F.lit(k), F.lit("")))) / len(k) for k in kws), F.lit(0))
        hits = F.when(primary == t, own).otherwise(hits)
    return F.when(F.char_length(body) > 0, F.bround(hits / (F.greatest(F.lit(1), word_count(body)) / 100.0), 4)).otherwise(0.0)


def paragraph_offsets(body: Column) -> Column:
    """array<struct<char_start, char_length>> of the lines of a text; none for an empty one."""
    sizes = F.transform(F.split(body, "\n"), lambda x: F.char_length(x))
    made = let(sizes, lambda own: F.zip_with(running_totals(F.transform(own, lambda n: n + 1)), own, lambda start, n: F.struct(start.cast("int").alias("char_start"), n.alias("char_length"))))
    return F.when(F.char_length(body) > 0, made).otherwise(F.array().cast("array<struct<char_start:int,char_length:int>>"))


def operative(sections: DataFrame) -> DataFrame:
    """Marks, for each document and topic, the densest section that is no supplement (ties: least id). The window is over
    documents, so that whatever else groups by document finds them together."""
    group = [F.col("primary_topic"), F.col("is_country_supplement")]
    order = Window.partitionBy("doc_id").orderBy(*group, F.desc("topic_density"), "section_id")
    first = ~F.coalesce(F.lag(F.struct(*group)).over(order) == F.struct(*group), F.lit(False))
    return sections.withColumn("is_operative_for_topic", (F.col("primary_topic") != UNKNOWN) & ~F.col("is_country_supplement") & first)


def operative(sections: DataFrame) -> DataFrame:
    """Marks, for each document and topic, the densest section that is no supplement (ties: least id)."""
    rank = F.row_number().over(Window.partitionBy("doc_id", "primary_topic", "is_country_supplement").orderBy(F.desc("topic_density"), "section_id"))
    return sections.withColumn("is_operative_for_topic", (F.col("primary_topic") != UNKNOWN) & ~F.col("is_country_supplement") & (rank == 1))


def enrich(sections: DataFrame, topics: TopicMap, features: bool = True, inherit: bool = True) -> DataFrame:
    """Sections (doc_id, ord, section_id, heading, text, char_start) with topics, density, features and marks."""
    out = sections.withColumn("primary_topic", primary_topic(F.col("heading"), topics)).withColumn("scored", topic_scores(F.col("heading"), F.col("text"), topics))
    if inherit and topics.amendments:
        out = inherit_amended(out, topics)
    elif "inherited_from" not in out.columns:
        out = out.withColumn("inherited_from", F.lit(None).cast("string"))
    out = out.withColumn("primary_topic", F.coalesce("primary_topic", F.lit(UNKNOWN))).withColumn("category", F.col("primary_topic"))
    out = out.withColumn("topics", F.transform("scored", lambda e: e["topic"])).withColumn("topic_scores", F.map_from_entries("scored")).drop("scored")
    out = out.withColumn("topic_density", topic_density(F.col("primary_topic"), F.col("text"), topics)).withColumn("is_country_supplement", is_supplement(F.col("heading"), topics))
    if features:
        out = out.withColumn("text_features", F.struct(*(c.alias(n) for n, c in text_features(F.col("text")).items())))
    return operative(out)


def inherit_amended(sections: DataFrame, topics: TopicMap) -> DataFrame:
    """A section without topic of its own that amends another by title takes the topic of the first earlier section that the
    title names, else the topic that the title itself names; patterns are tried in order. A document's sections are folded in
    order, so a topic that was gained is passed on and chains of any length settle."""
    own = [c for c in sections.columns if c not in ("doc_id", "inherited_from")]
    found = [F.lower(F.trim(F.regexp_extract("text", p, 1))) for p in topics.amendments]
    asks = F.array_compact(F.array(*(F.when(F.col("primary_topic").isNull() & (F.char_length(t) > 0), F.struct(t.alias("title"), primary_topic(t, topics).alias("topic"))) for t in found)))
    marked = sections.withColumns({"__asks": asks, "__head": F.lower("heading")})
    by_ord = lambda a, b: F.when(a["ord"] < b["ord"], -1).when(a["ord"] > b["ord"], 1).otherwise(0)
    docs = marked.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*own, "__asks", "__head")), by_ord).alias("all"))
    item = f"struct<ord:{sections.schema['ord'].dataType.simpleString()},pid:string,pt:string,score:double>"
    at = lambda known, ord_: F.get(F.filter(known, lambda x: x["ord"] == ord_), F.lit(0))

    def settle(settled: Column, section: Column) -> Column:
        def named(ask: Column) -> Column:
            earlier = F.get(F.filter("all", lambda s: (s["ord"] < section["ord"]) & F.contains(s["__head"], ask["title"])), F.lit(0))
            gained = lambda p: let(F.coalesce(p["primary_topic"], at(settled, p["ord"])["pt"]), lambda t: F.when(
                t.isNotNull(), F.struct(section["ord"], p["section_id"], t, F.lit(INHERITED_SCORE)).cast(item)).when(
                ask["topic"].isNotNull(), F.struct(section["ord"], F.lit("<by-title>"), ask["topic"], F.lit(BY_TITLE_SCORE)).cast(item)))
            return let(earlier, gained)

        first = F.get(F.array_compact(F.transform(section["__asks"], named)), F.lit(0))
        return let(first, lambda x: F.when(x.isNull(), settled).otherwise(F.concat(settled, F.array(x))))

    asking = F.filter("all", lambda s: F.size(s["__asks"]) > 0)
    parents = docs.select("doc_id", "all", F.aggregate(asking, F.array().cast(f"array<{item}>"), settle).alias("parents"))
    joined = parents.select("doc_id", F.explode(F.transform("all", lambda s: F.struct(s.alias("s"), at(F.col("parents"), s["ord"]).alias("parent")))).alias("r")).select(
        "doc_id", *(F.col(f"r.s.{c}").alias(c) for c in own), F.col("r.parent").alias("parent"))
    gained = F.col("parent").isNotNull()
    return joined.select("doc_id", *(c for c in own if c not in ("primary_topic", "scored")),
                         F.when(gained, F.col("parent.pt")).otherwise(F.col("primary_topic")).alias("primary_topic"), F.col("parent.pid").alias("inherited_from"),
                         F.when(gained, _with_score(F.col("scored"), F.col("parent.pt"), F.col("parent.score"))).otherwise(F.col("scored")).alias("scored"))


def _with_score(scored: Column, topic: Column, score: Column) -> Column:
    rest = F.filter(scored, lambda e: e["topic"] != topic)
    own = F.array_max(F.concat(F.transform(F.filter(scored, lambda e: e["topic"] == topic), lambda e: e["score"]), F.array(score)))
    return F.concat(F.array(F.struct(topic.alias("topic"), own.alias("score"))), rest)


def categories(sections: DataFrame) -> DataFrame:
    """(doc_id, category, section_ids in order)."""
    return sections.groupBy("doc_id", "category").agg(F.sort_array(F.collect_list("section_id")).alias("section_ids"))


def party_aliases(blocks: DataFrame) -> DataFrame:
    """(doc_id, alias, canonical): ``Canonical ("Alias")``; a document's first definition of an alias holds."""
    rx = r"""([A-Z][\w&.\-]*(?:\s+[A-Z][\w&.\-]*){0,4})\s*\(["“‘']([A-Z][\w]{2,30})["”’']\)"""
    pairs = F.arrays_zip(F.regexp_extract_all("text", F.lit(rx), F.lit(1)), F.regexp_extract_all("text", F.lit(rx), F.lit(2)))
    found = blocks.select("doc_id", "block_ord", F.posexplode(pairs).alias("k", "p")).select("doc_id", "block_ord", "k", F.trim(F.col("p.0")).alias("canonical"), F.trim(F.col("p.1")).alias("alias"))
    fair = found.where("char_length(alias) >= 3 and not contains(canonical, alias)")
    return fair.groupBy("doc_id", "alias").agg(F.min_by("canonical", F.struct("block_ord", "k")).alias("canonical"))


def apply_aliases(text: Column, aliases: Column) -> Column:
    """Whole-word replacement of array<struct<alias, canonical>>, longest alias first."""
    by = lambda a, b: F.when(F.char_length(a["alias"]) > F.char_length(b["alias"]), -1).when(F.char_length(a["alias"]) < F.char_length(b["alias"]), 1).when(a["alias"] < b["alias"], -1).otherwise(1)
    safe = lambda c: F.regexp_replace(c, r"([\\$])", r"\\$1")
    step = lambda t, a: F.regexp_replace(t, F.concat(F.lit(r"\b\Q"), a["alias"], F.lit(r"\E\b")), safe(a["canonical"]))
    return F.when(aliases.isNull(), text).otherwise(F.aggregate(F.array_sort(aliases, by), text, step))


# ---- kinds of documents ----

#: Bigrams that vote for a kind, in order; fixed values.
KIND_BIGRAMS = (
    ("arb-psa", ("project solution", "solution architecture", "architecture review", "review board", "psa guide", "arb intake", "design patterns", "decision records",
                 "architecture risks", "architecture constraints", "data security", "information governance", "security architecture", "infrastructure architecture",
                 "dr & resiliency", "dr and resiliency", "non-functional")),
    ("contract", ("master services", "services agreement", "payment terms", "governing law", "limitation of liability", "confidentiality clause")),
    ("gov-architecture", ("cloud guardrails", "treasury board", "protected b")),
    ("fsi", ("guideline b-10", "third-party risk", "model risk")),
    ("permitting", ("building code", "impact assessment")),
    ("oil-gas", ("pipeline regulations", "well integrity", "methane regulations")),
)
KIND_BLOCKS = 60
#: Parts of a path that name a kind, in order; fixed values.
KIND_PATHS = (
    ("arb-psa", ("samples/architecture", "rulesets/architecture-review")), ("contract", ("samples/contracts", "rulesets/contracts")),
    ("fsi", ("corpus/fsi",)), ("gov-architecture", ("corpus/gov-architecture",)), ("oil-gas", ("corpus/oil-gas",)), ("permitting", ("corpus/permitting",)),
)


def resolve_kind(explicit: Column, path: Column, voted: Column, paths=KIND_PATHS) -> Column:
    """What a document is said to be, else what its path says, whatever the case and kind of slash, else what its blocks
    voted for, else 'unknown'."""
    low = F.lower(F.translate(path, "\\", "/"))
    by_path = F.lit(None).cast("string")
    for kind, parts in reversed(paths):
        by_path = F.when(_any(low, [p.lower() for p in parts]), kind).otherwise(by_path)
    said = F.trim(explicit)
    return F.coalesce(F.when(F.char_length(said) > 0, said), by_path, voted, F.lit(UNKNOWN))


def document_kinds(blocks: DataFrame, bigrams=KIND_BIGRAMS, window: int = KIND_BLOCKS) -> DataFrame:
    """(doc_id, kind, votes): the kind with the most bigram hits in a document's first blocks; ties go to the kind
    whose bigram comes first in the list. Documents without a hit give no row."""
    low = F.lower("text")
    flat = [(k, g) for k, gs in bigrams for g in gs]
    hits = F.filter(F.array(*(F.when(F.contains(low, F.lit(g)), F.struct(F.lit(k).alias("kind"), F.lit(i).alias("at"))) for i, (k, g) in enumerate(flat))), lambda e: e.isNotNull())
    votes = blocks.where(F.col("block_ord") < window).select("doc_id", F.explode(hits).alias("v")).groupBy("doc_id", "v.kind").agg(F.count("*").alias("votes"), F.min("v.at").alias("at"))
    return votes.groupBy("doc_id").agg(F.max_by(F.struct("kind", "votes"), F.struct("votes", (-F.col("at")).alias("at"))).alias("m")).select("doc_id", "m.kind", "m.votes")


# ---- outline ----


def outline_headings(blocks: DataFrame) -> DataFrame:
    """(doc_id, title, level, start, doc_end) of the headings of blocks."""
    ends = F.max(F.col("char_start") + F.col("char_length")).over(Window.partitionBy("doc_id"))
    return blocks.withColumn("doc_end", ends).where("kind = 'heading'").select("doc_id", F.col("text").alias("title"), F.col("heading_level").alias("level"), F.col("char_start").alias("start"), "doc_end")


#: Heading levels that sources give; deeper ones count as the last in an outline.
LEVELS = 9


def document_tree(headings: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(doc_id, node_id, parent_id, title, level, start, end) from headings (doc_id, title, level, start, doc_end): a node ends
    where the next heading of its level or a shallower one begins; its parent is the last shallower one before it.

    Running extremes by level over a document's headings, once forward and once backward: no join."""
    depth = F.least(F.greatest("level", F.lit(1)), F.lit(levels))
    before = Window.partitionBy("doc_id").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("doc_id").orderBy(F.desc("start")).rowsBetween(Window.unboundedPreceding, -1)
    held = headings.withColumn("__depth", depth)
    held = held.withColumns({f"__above{n}": F.max(F.when(F.col("__depth") < n, F.col("start"))).over(before) for n in range(2, levels + 1)})
    held = held.withColumns({f"__next{n}": F.min(F.when(F.col("__depth") <= n, F.col("start"))).over(after) for n in range(1, levels + 1)})
    none = F.lit(None).cast("int")
    parent, stop = none, none
    for n in range(levels, 0, -1):
        parent = F.when(F.col("__depth") == n, F.col(f"__above{n}") if n > 1 else none).otherwise(parent)
        stop = F.when(F.col("__depth") == n, F.col(f"__next{n}")).otherwise(stop)
    node = lambda c: F.format_string("n_%08x", c)
    return held.select(
        "doc_id", node(F.col("start")).alias("node_id"), F.when(parent.isNotNull(), node(parent)).alias("parent_id"), "title", "level", "start", F.coalesce(stop, "doc_end").alias("end"))
