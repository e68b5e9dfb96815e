"""Overlays: what a rule set's owner switches off and notes, as a JSON document of its own. Every edit gives a new document."""

from __future__ import annotations

from ..functions.hashing import address
from .evaluate import Rule, RuleSet
from .governance import rule_fingerprint

#: The time of edits where none is given: equal edits are equal documents.
STAMP = "2000-01-01T00:00:00Z"


def empty(rules: RuleSet, by: str | None = None, at: str = STAMP) -> dict:
    made = {"ruleSetId": rules.id, "ruleSetVersion": rules.version, "createdAt": at, "disabled": [], "annotations": []}
    return made | ({"createdBy": by} if by else {})


def require_bound(overlay: dict, rules: RuleSet) -> None:
    bound = (overlay.get("ruleSetId"), overlay.get("ruleSetVersion"))
    if bound != (rules.id, rules.version):
        raise ValueError(f"overlay is for {bound[0]} {bound[1]}, not {rules.id} {rules.version}")


def find(rules: RuleSet, rule_id: str) -> Rule:
    for r in rules.rules:
        if r.id == rule_id:
            return r
    raise ValueError(f"rule {rule_id!r} does not exist in {rules.id} {rules.version}")


def disable(overlay: dict, rules: RuleSet, rule_id: str, reason: str, by: str | None = None, at: str = STAMP) -> dict:
    """Switches a rule off, for a reason; an earlier reason is replaced."""
    require_bound(overlay, rules)
    find(rules, rule_id)
    if not (reason or "").strip():
        raise ValueError("a rule is not disabled without a reason")
    own = {"ruleId": rule_id, "reason": reason, "disabledAt": at} | ({"disabledBy": by} if by else {})
    return overlay | {"disabled": [d for d in overlay.get("disabled", []) if d["ruleId"] != rule_id] + [own]}


def enable(overlay: dict, rules: RuleSet, rule_id: str) -> dict:
    """Takes a rule's disabling back; without one nothing changes."""
    require_bound(overlay, rules)
    return overlay | {"disabled": [d for d in overlay.get("disabled", []) if d["ruleId"] != rule_id]}


def annotate(overlay: dict, rules: RuleSet, rule_id: str, note: str, by: str | None = None, at: str = STAMP) -> dict:
    require_bound(overlay, rules)
    find(rules, rule_id)
    own = {"ruleId": rule_id, "note": note, "annotatedAt": at} | ({"authoredBy": by} if by else {})
    return overlay | {"annotations": [*overlay.get("annotations", []), own]}


def fingerprint(overlay: dict) -> str:
    """Address of what an overlay decides: who made it and when do not count."""
    gone = [f"disable:{d['ruleId']}|{d.get('reason', '')}" for d in sorted(overlay.get("disabled", []), key=lambda d: d["ruleId"])]
    notes = [f"note:{a['ruleId']}|{a['note']}" for a in sorted(overlay.get("annotations", []), key=lambda a: (a["ruleId"], a["note"]))]
    return address("overlay", overlay["ruleSetId"], overlay["ruleSetVersion"], *gone, *notes)


def show(rules: RuleSet, rule_id: str) -> dict:
    """What there is to know of one rule."""
    r = find(rules, rule_id)
    return {"id": r.id, "version": r.version, "severity": r.severity, "applicability": r.applicability, "fingerprint": rule_fingerprint(r), "naturalLanguage": r.natural_language,
            "predicate": r.predicate, "lambda": r.lambda_, "remediation": r.remediation, "source": [r.source_document, r.source_start, r.source_start + r.source_length], "evidenceQuote": r.evidence_quote}
