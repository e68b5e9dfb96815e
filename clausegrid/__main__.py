"""python -m clausegrid VERB ...: the library's calls on files, results as JSON lines or JSON files."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import api
from .functions.vectors import hash_vector
from .operators import authoring, governance, overlays, project
from .sources import documents, store

_VERBS = {
    "review": ("docs", "rules", "topics"), "project": ("docs", "topics"), "parse": ("docs",), "dump-tree": ("docs",), "coverage": ("docs", "rules", "topics"), "author": ("docs", "templates"),
    "index": ("rules",), "topic-map": ("topics",), "topic-coverage": ("rules", "topics"), "extract-rules": ("docs", "templates"), "rules-diff": ("rules", "other"), "rules-show": ("rules", "rule"),
    "rules-disable": ("rules", "rule"), "rules-enable": ("rules", "rule"), "rules-annotate": ("rules", "rule"), "ruleset-validate": ("rules",), "ruleset-reembed-anchors": ("rules",),
}


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="clausegrid", description=__doc__)
    verbs = p.add_subparsers(dest="verb", required=True)
    for name, args in _VERBS.items():
        v = verbs.add_parser(name)
        for a in args:
            v.add_argument(a)
        v.add_argument("--out", required=name not in ("rules-show", "topic-map"))
        if name in ("review", "coverage"):
            v.add_argument("--overlay")
            v.add_argument("--domain")
            v.add_argument("--floor", type=float, default=0.0)
            v.add_argument("--kinds", action="store_true")
            v.add_argument("--kind")
            v.add_argument("--hash-embedder", action="store_true", help="vectors by hash, for tries")
        if name in ("author", "extract-rules"):
            v.add_argument("--prefix", default="X")
            v.add_argument("--min-chars", type=int, default=200 if name == "extract-rules" else 0)
        if name.startswith("rules-"):
            v.add_argument("--overlay")
            v.add_argument("--by")
            v.add_argument("--reason", default="")
            v.add_argument("--note", default="")
        if name == "ruleset-validate":
            v.add_argument("--epsilon", type=float, default=0.05)
    return p


def _templates(spark: SparkSession, path: str) -> list[authoring.Template]:
    return [authoring.Template(t["topic"], tuple(t["triggers"]), t["lambda"], t.get("severity", "Violation")) for t in store.load_json(spark, path)]


def main(argv: list[str] | None = None) -> None:
    a = _parser().parse_args(argv)
    spark = SparkSession.builder.appName("clausegrid").getOrCreate()
    if a.verb in ("review", "coverage"):
        rules = store.load_ruleset(spark, a.rules)
        off = store.load_overlay(spark, a.overlay, rules) if a.overlay else None
        embed = hash_vector if a.hash_embedder else None
        found = api.review(spark, a.docs, rules, store.load_topic_map(spark, a.topics), off, a.domain, a.kinds, api.Options(floor=a.floor), embed, kind=a.kind)
        if a.verb == "coverage":
            store.write_json(found["coverage"], a.out)
        else:
            for name, df in found.items():
                store.write_json(df, f"{a.out}/{name}")
    elif a.verb == "project":
        store.write_json(api.project_files(spark, a.docs, store.load_topic_map(spark, a.topics)), a.out)
    elif a.verb in ("parse", "dump-tree"):
        blocks = documents.blocks(documents.read_files(spark, a.docs))
        store.write_json(project.document_tree(project.outline_headings(blocks)) if a.verb == "dump-tree" else blocks, a.out)
    elif a.verb in ("author", "extract-rules"):
        made, counts = api.extract_rules(spark, a.docs, _templates(spark, a.templates), a.prefix, a.min_chars)
        store.write_json(made, f"{a.out}/rules")
        store.write_json(counts, f"{a.out}/counts")
    elif a.verb == "topic-map":
        topics = store.load_topic_map(spark, a.topics)
        print(json.dumps({"id": topics.id, "topics": dict(topics.topics), "axes": dict(topics.axes), "amendments": topics.amendments}, indent=2, ensure_ascii=False))
    else:
        _rules(spark, a)


def _rules(spark: SparkSession, a: argparse.Namespace) -> None:
    """The verbs on a rule set alone."""
    rules = store.load_ruleset(spark, a.rules)
    if a.verb == "index":
        store.write_json(governance.signature_rows(spark, rules), a.out)
    elif a.verb == "topic-coverage":
        topics = store.load_topic_map(spark, a.topics)
        store.write_json(governance.vocabulary_coverage(governance.rule_rows(spark, rules), [t for t, _ in topics.topics]), a.out)
    elif a.verb == "rules-diff":
        store.write_json(governance.diff(governance.rule_rows(spark, rules), governance.rule_rows(spark, store.load_ruleset(spark, a.other))), a.out)
    elif a.verb == "rules-show":
        print(json.dumps(overlays.show(rules, a.rule), indent=2, ensure_ascii=False))
    elif a.verb == "ruleset-validate":
        examples = governance.example_similarities(spark, rules, hash_vector)
        store.write_json(governance.validator_margins(examples, a.epsilon), f"{a.out}/margins")
        store.write_json(governance.structural_problems(governance.rule_rows(spark, rules)), f"{a.out}/problems")
    elif a.verb == "ruleset-reembed-anchors":
        store.write_json(governance.anchor_embeddings(spark, rules, hash_vector), a.out)
    else:
        held = store.load_json(spark, a.overlay) if a.overlay else overlays.empty(rules, a.by)
        if a.verb == "rules-disable":
            held = overlays.disable(held, rules, a.rule, a.reason, a.by)
        elif a.verb == "rules-enable":
            held = overlays.enable(held, rules, a.rule)
        else:
            held = overlays.annotate(held, rules, a.rule, a.note, a.by)
        store.save_json(spark, held, a.out)


if __name__ == "__main__":
    main()
