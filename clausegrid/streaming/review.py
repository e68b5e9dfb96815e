"""Reviews of documents as they arrive.

Sections and verdicts of a document need nothing but the document, so a micro-batch is a
batch: it is reviewed whole and appended. Documents are addressed by content, and those
that a table already has are left out, so a batch that is run again adds nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.hashing import content_hash
from ..operators.evaluate import Options, RuleSet, evaluate, report
from ..operators.project import TopicMap, enrich, split_lines
from ..sources.store import insert_new


def sections_of(docs: DataFrame, topics: TopicMap) -> DataFrame:
    """Lines of documents (doc_id, text) with the part before a line's first full stop as its heading."""
    lines = split_lines(docs).withColumn("heading", F.regexp_extract("text", r"^[^.]*", 0))
    return enrich(lines, topics, features=False)


def review_stream(docs: DataFrame, rules: RuleSet, topics: TopicMap, out: str, checkpoint: str, options: Options = Options(), **trigger) -> StreamingQuery:
    """Appends the verdicts and reports of a stream of documents (text) to ``out``/verdicts and ``out``/reports."""
    def review(batch: DataFrame, _: int) -> None:
        named = batch.select(content_hash(F.col("text")).alias("doc_id"), "text").where("text is not null").dropDuplicates(["doc_id"])
        verdicts = evaluate(sections_of(named, topics), rules, options)
        insert_new(verdicts, f"{out}/verdicts", ["doc_id", "rule_id", "verdict_id", "ord"])
        insert_new(report(verdicts), f"{out}/reports", ["doc_id"])

    return docs.writeStream.foreachBatch(review).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def event_counts(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts and sums of events by type and window, for a stream with late rows; runs on a table too."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    return timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(
        F.col("w.start").alias("window_start"), "event_type", "n", "total")
