"""Verdicts to review annotations, in reading order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import compose
from .sized import sized

#: Order and label of severities in a comment's banner; fixed values.
SEVERITIES = {"Violation": "VIOLATION", "Warning": "WARNING", "Info": "INFO"}


def banner(severity: Column, outcome: Column) -> Column:
    label = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in SEVERITIES.items() for x in kv)), severity), F.upper(severity))
    return F.concat(F.lit("["), label, F.lit("] "), outcome)


def initials(author: Column) -> Column:
    """First letters of up to three words."""
    return F.upper(F.array_join(F.transform(F.slice(F.filter(F.split(author, r"\s+"), lambda w: F.char_length(w) > 0), F.lit(1), F.lit(3)), lambda w: F.substring(w, 1, 1)), ""))


def body_text(severity: Column, outcome: Column, message: Column, remediation: Column) -> Column:
    return F.concat_ws("\n", banner(severity, outcome), message, F.when(F.char_length(remediation) > 0, F.concat(F.lit("Suggested: "), remediation)))


def annotations(verdicts: DataFrame, severities: DataFrame, with_passes: bool = False, rewrites: bool = False) -> DataFrame:
    """doc_id, annotation_id, kind, rule_id, start, length, text: a comment for Fail and Error (for Pass on request), a replacement
    for a Fail with remediation if rewrites are asked for, and one summary of the gaps of each document.

    severities(rule_id, severity) is a rule set's. Verdicts on a title or preamble (``heading_path`` '/') are not replaced.
    """
    v = verdicts.join(sized(severities), "rule_id", "left").withColumn("severity", F.coalesce("severity", F.lit("Info")))
    shown = ["Fail", "Error", *(["Pass"] if with_passes else [])]
    start, length = F.coalesce("clause_start", "start"), F.coalesce("clause_length", "length")
    replace = F.lit(rewrites) & (F.col("outcome") == "Fail") & (F.char_length("remediation") > 0)
    if "heading_path" in verdicts.columns:
        replace = replace & (F.coalesce("heading_path", F.lit("")) != "/")
    spoken = v.where(F.col("outcome").isin(*shown)).select(
        "doc_id", F.when(replace, "replace").otherwise("comment").alias("kind"), "rule_id", start.alias("start"), length.alias("length"),
        F.when(replace, F.col("remediation")).otherwise(body_text(F.col("severity"), F.col("outcome"), F.col("error"), F.col("remediation"))).alias("text"), "verdict_id")
    gaps = (v.where("outcome = 'Gap'").groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_list("rule_id")), ", ").alias("rules"), F.count("*").alias("n"))
            .select("doc_id", F.lit("summary").alias("kind"), F.lit(None).cast("string").alias("rule_id"), F.lit(0).alias("start"), F.lit(0).alias("length"),
                    F.concat(F.col("n").cast("string"), F.lit(" rule(s) not addressed: "), F.col("rules")).alias("text"), F.lit("gaps").alias("verdict_id")))
    both = spoken.unionByName(gaps)
    return both.withColumn("annotation_id", compose("annotation", F.col("kind"), F.col("verdict_id"), F.col("start"), F.col("length"))).drop("verdict_id")


def comment_ids(notes: DataFrame) -> DataFrame:
    """Numbers a document's annotations from 1 by place and address."""
    return notes.withColumn("comment_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("start", "annotation_id")))


def clause_text(text: Column, clause_start: Column, clause_length: Column, quotes: Column) -> Column:
    """The text at the clause, else the first quote."""
    return F.coalesce(F.when(clause_length > 0, F.substring(text, clause_start + 1, clause_length)), F.get(quotes, F.lit(0)))
