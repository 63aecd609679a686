"""Rules and decision tables over fact tables: three-valued, with exceptions and hit policies."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.logic import Refused, Signature


@dataclass(frozen=True)
class Rule:
    rule_id: str
    condition: dict
    outputs: dict[str, object]
    scope: dict | None = None
    exceptions: list[dict] = field(default_factory=list)


def effect(value: object, sig: Signature) -> Column:
    """What an output is set to, as text: a literal, or the fact it names ({"symbol": name})."""
    return sig.operand(value).cast("string") if isinstance(value, dict) else F.lit(None if value is None else str(value)).cast("string")


def status(rule: Rule, sig: Signature, off_scope: str = "out_of_scope") -> Column:
    """out_of_scope (off_scope), no_match, matched, defeated or unknown for each row of facts; an effect that is an unknown fact makes a match unknown."""
    cond = sig.compile(rule.condition)
    settled = F.lit(True)
    for v in rule.outputs.values():
        if isinstance(v, dict):
            settled = settled & sig.operand(v).isNotNull()
    scope = sig.compile(rule.scope) if rule.scope else F.lit(True)
    out = F.lit(False)
    for e in rule.exceptions:
        out = out | sig.compile(e)
    return (
        F.when(scope == F.lit(False), off_scope).when(scope.isNull(), "unknown").when(cond == F.lit(False), "no_match").when(cond.isNull(), "unknown")
        .when(out, "defeated").when(out.isNull() | ~settled, "unknown").otherwise("matched")
    )


def evaluate(facts: DataFrame, rules: list[Rule], sig: Signature) -> tuple[DataFrame, list[tuple[str, str, str]]]:
    """facts with one status column for each rule that compiles; the refusals (rule, code, reason)."""
    cols, refused = {}, []
    for r in rules:
        try:
            cols[r.rule_id] = status(r, sig)
        except Refused as e:
            refused.append((r.rule_id, e.code, e.reason))
    return facts.withColumns(cols), refused


def decide(facts: DataFrame, rules: list[Rule], sig: Signature, target: str, policy: str) -> DataFrame:
    """facts with decision_status, decision (the target's value as text) and matched (ids).

    UNIQUE: more than one match is a conflict, then any unknown rule makes the
    decision unknown.  ANY: any unknown rule makes it unknown, then matches that
    differ in any output are a conflict.  A table with a rule that does not
    compile is refused.  A match that does not set the target decides null.
    """
    if policy not in ("UNIQUE", "ANY"):
        raise Refused("UNSUPPORTED_HIT_POLICY", policy)
    names = sorted({k for r in rules for k in r.outputs})
    values_of = lambda r: F.array(*[effect(r.outputs.get(k), sig) for k in names]) if names else F.array().cast("array<string>")
    try:
        states = F.array(*[F.struct(F.lit(r.rule_id).alias("id"), status(r, sig).alias("s"), values_of(r).alias("v")) for r in rules])
    except Refused:
        return facts.withColumns({"decision_status": F.lit("refused"), "decision": F.lit(None).cast("string"), "matched": F.lit("")})
    x = facts.withColumn("_s", states)
    hits, maybe = F.filter("_s", lambda s: s["s"] == "matched"), F.filter("_s", lambda s: s["s"] == "unknown")
    values = lambda k: F.array_distinct(F.filter(F.transform(hits, lambda s: s["v"][names.index(k)]), lambda v: v.isNotNull()))
    differ = F.lit(False)
    for k in names:
        differ = differ | (F.size(values(k)) > 1)
    if policy == "UNIQUE":
        state = F.when(F.size(hits) > 1, "conflict").when(F.size(maybe) > 0, "unknown")
    else:
        state = F.when(F.size(maybe) > 0, "unknown").when(differ, "conflict")
    x = x.withColumn("decision_status", state.when(F.size(hits) > 0, "matched").otherwise("no_match"))
    decision = F.get(values(target), F.lit(0)) if target in names else F.lit(None).cast("string")
    return x.withColumns({"decision": F.when(F.col("decision_status") == "matched", decision), "matched": F.array_join(F.array_sort(F.transform(hits, lambda s: s["id"])), ",")}).drop("_s")


def replay(cases: DataFrame, old: list[Rule], new: list[Rule], sig: Signature, target: str) -> DataFrame:
    """cases with old and new decisions (ANY) and whether they differ; null-safe."""
    a = decide(cases, old, sig, target, "ANY").withColumnsRenamed({"decision_status": "old_status", "decision": "old_decision"}).drop("matched")
    b = decide(a, new, sig, target, "ANY").withColumnsRenamed({"decision_status": "new_status", "decision": "new_decision"}).drop("matched")
    same = F.col("old_status").eqNullSafe(F.col("new_status")) & F.col("old_decision").eqNullSafe(F.col("new_decision"))
    return b.withColumn("differs", ~same)
