"""Decision, process and case models out of rules, and their readers, checks and diagrams.

Each model is made rule by rule in Arrow batches; a document that holds many is
put together on the driver only by `document`, for as many as it is asked for.
"""

from __future__ import annotations

import json
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Namespaces of the three model languages and of our own marks; types and tags as they write them.
DMN, BPMN, CMMN, OWN = "https://www.omg.org/spec/DMN/20191111/MODEL/", "http://www.omg.org/spec/BPMN/20100524/MODEL", "http://www.omg.org/spec/CMMN/20151109/MODEL", "urn:rules"
TYPE_REFS = {"boolean": "boolean", "number": "number", "date": "date", "date_time": "date and time", "time": "time", "duration": "days and time duration"}
TAGS = {"business_rule_task": "businessRuleTask", "user_task": "userTask", "service_task": "serviceTask", "send_task": "sendTask", "receive_task": "receiveTask"}
CONSTRUCTORS = {"date": "date", "date_time": "date and time", "time": "time", "duration": "duration"}
CONCEPT_KINDS = ("actor_role", "business_object", "decision_variable", "event", "evidence_object", "process")


def xml_id(prefix: str, *parts) -> str:
    return "_".join([prefix, *("".join(c if c.isascii() and (c.isalnum() or c in "_.-") else "_" for c in str(p)) for p in parts)])


def feel(value, kind: str | None = None) -> str:
    """A literal of the decision language."""
    if value is None or isinstance(value, (bool, int, float)):
        return json.dumps(value)
    text = json.dumps(str(value), ensure_ascii=False)
    return f"{CONSTRUCTORS[kind]}({text})" if kind in CONSTRUCTORS else text


def test_of(p: dict) -> str:
    """A predicate as a cell; what has no form is false."""
    op, value, kind = str(p.get("operator") or ""), p.get("value"), p.get("value_type")
    if op in ("==", "="):
        return feel(value, kind)
    if op in ("!=", "<>", "<", "<=", ">", ">="):
        return f"{'!=' if op == '<>' else op} {feel(value, kind)}"
    if op in ("in", "not_in") and isinstance(value, list):
        cells = "[" + ", ".join(feel(v, kind) for v in value) + "]"
        return cells if op == "in" else f"not({cells})"
    return f"contains(?, {feel(value)})" if op == "contains" else "false"


def node(parent: ET.Element | None, space: str, tag: str, text: str | None = None, **attributes: str) -> ET.Element:
    at = {k.replace("own_", f"{{{OWN}}}"): str(v) for k, v in attributes.items()}
    made = ET.Element(f"{{{space}}}{tag}", at) if parent is None else ET.SubElement(parent, f"{{{space}}}{tag}", at)
    made.text = text
    return made


def decision(rule: dict) -> str | None:
    """A decision table of one row; one for every rule."""
    rid = str(rule.get("rule_id") or "")
    types = {str(v.get("name")): TYPE_REFS.get(str(v.get("type")), "string") for v in rule.get("variables") or []}
    top = node(None, DMN, "decision", id=xml_id("decision", rid), name=str(rule.get("rule_name") or rid), own_ruleId=rid, own_requiresReview=str(bool(rule.get("requires_review", True))).lower())
    table = node(top, DMN, "decisionTable", id=xml_id("table", rid), hitPolicy=str(rule.get("recommended_hit_policy") or "UNIQUE"))
    tests, outcomes = rule.get("condition_predicates") or [], rule.get("outcomes") or []
    for p in tests:
        name = str(p.get("variable"))
        expression = node(node(table, DMN, "input", id=xml_id("input", rid, name)), DMN, "inputExpression", typeRef=types.get(name, "string"))
        node(expression, DMN, "text", name)
    for o in outcomes:
        node(table, DMN, "output", id=xml_id("output", rid, o.get("variable")), name=str(o.get("variable")), typeRef=types.get(str(o.get("variable")), "string"))
    row = node(table, DMN, "rule", id=xml_id("row", rid))
    for p in tests:
        node(node(row, DMN, "inputEntry"), DMN, "text", test_of(p))
    for o in outcomes:
        node(node(row, DMN, "outputEntry"), DMN, "text", feel(o.get("value"), o.get("value_type")))
    return ET.tostring(top, encoding="unicode")


def process(rule: dict) -> str | None:
    """Start, ordered tasks and end of a rule that is marked eligible; None for any other."""
    w = rule.get("workflow_semantics")
    if not rule.get("bpmn_eligible") or not isinstance(w, dict):
        return None
    rid = str(rule.get("rule_id") or "")
    top = node(None, BPMN, "process", id=xml_id("process", rid), name=str(rule.get("rule_name") or rid), isExecutable="true", own_ruleId=rid, own_actorRole=str(w.get("actor_role")))
    before = node(top, BPMN, "startEvent", id=xml_id("start", rid), name=str(w.get("trigger_event")))
    steps = [(TAGS[s["kind"]], xml_id("step", rid, s["step_id"]), str(s.get("name"))) for s in w.get("ordered_steps") or []]
    for k, (tag, name, label) in enumerate([*steps, ("endEvent", xml_id("end", rid), "")]):
        here = node(top, BPMN, tag, id=name, **({"name": label} if label else {}))
        node(top, BPMN, "sequenceFlow", id=xml_id("flow", rid, k), sourceRef=before.get("id"), targetRef=name)
        before = here
    return ET.tostring(top, encoding="unicode")


def case(rule: dict) -> str | None:
    """A review case of a rule that goes to people or to case management; None for any other."""
    if rule.get("route") not in ("case_management", "human_review"):
        return None
    rid = str(rule.get("rule_id") or "")
    top = node(None, CMMN, "case", id=xml_id("case", rid), name=str(rule.get("rule_name") or rid), own_ruleId=rid, own_reviewRoute=rule["route"])
    plan = node(top, CMMN, "casePlanModel", id=xml_id("plan", rid), name="Resolve findings")
    for tag, prefix, label in (("humanTask", "review_task", "Review findings"), ("milestone", "resolved", "Review resolved")):
        node(plan, CMMN, tag, id=xml_id(prefix, rid), name=label)
        node(plan, CMMN, "planItem", id=xml_id(f"{prefix}_item", rid), definitionRef=xml_id(prefix, rid))
    return ET.tostring(top, encoding="unicode")


def emitted(rules: DataFrame, make: Callable[[dict], str | None]) -> DataFrame:
    """(rule_id, xml) of rules (rule_id, rule as JSON) that have such a model."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"rule_id": b["rule_id"], "xml": [make(json.loads(t)) for t in b["rule"]]}).dropna(subset=["xml"])

    return rules.select("rule_id", "rule").mapInPandas(run, "rule_id string, xml string")


def document(models: DataFrame, space: str, most: int = 10_000) -> str:
    """One definitions document of the first `most` models in order of rule, put together on the driver."""
    body = "".join(r.xml for r in models.orderBy("rule_id").limit(most).collect())
    return f'<?xml version="1.0" encoding="utf-8"?><definitions xmlns="{space}" id="definitions">{body}</definitions>'


def read_models(models: DataFrame, space: str) -> DataFrame:
    """(rule_id, tag, id, name, text, source, target): every element of models (rule_id, xml), in order of pos."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for rid, xml in zip(b["rule_id"], b["xml"], strict=True):
                for k, e in enumerate(ET.fromstring(xml).iter()):
                    rows.append((rid, k, e.tag.removeprefix(f"{{{space}}}"), e.get("id"), e.get("name"), e.text, e.get("sourceRef"), e.get("targetRef")))
            yield pd.DataFrame(rows, columns=["rule_id", "pos", "tag", "id", "name", "text", "source", "target"])

    return models.mapInPandas(run, "rule_id string, pos long, tag string, id string, name string, text string, source string, target string")


def model_faults(models: DataFrame, expected: DataFrame, elements: DataFrame) -> DataFrame:
    """(rule_id, fault): rules without their model, models of no such rule, flows with an end that is not there."""
    missing = expected.select("rule_id").distinct().join(models, "rule_id", "left_anti").withColumn("fault", F.lit("missing"))
    extra = models.select("rule_id").distinct().join(expected, "rule_id", "left_anti").withColumn("fault", F.lit("unexpected"))
    ids = elements.where("id is not null").select("rule_id", "id").distinct()
    flows = elements.where("tag = 'sequenceFlow'").select("rule_id", F.explode(F.array("source", "target")).alias("id"))
    loose = flows.where("id is null").select("rule_id").unionByName(flows.join(ids, ["rule_id", "id"], "left_anti").select("rule_id")).distinct().withColumn("fault", F.lit("loose flow"))
    return missing.unionByName(extra).unionByName(loose)


def vocabulary(entities: DataFrame, relationships: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Concepts (with whether their kind is known) of entities (name, definition, kind), and fact types of relationships (name, source_entity, target_entity, status)."""
    term = F.initcap(F.replace("name", F.lit("_"), F.lit(" ")))
    kind = F.coalesce("kind", F.lit("unresolved"))
    c = entities.select(F.col("name").alias("concept_id"), term.alias("preferred_term"), F.coalesce("definition", F.lit("")).alias("definition"), kind.alias("concept_kind"), (~kind.isin(*CONCEPT_KINDS)).alias("unresolved"))
    f = relationships.select(F.col("name").alias("fact_type_id"), F.col("source_entity").alias("subject_concept"), F.lower(F.replace("name", F.lit("_"), F.lit(" "))).alias("verb_term"), F.col("target_entity").alias("object_concept"), F.coalesce("status", F.lit("unverified")).alias("grounding_status"))
    return c, f


def emission_report(rules: DataFrame, models: dict[str, DataFrame]) -> DataFrame:
    """(model, emitted, rules, percent)."""
    n = rules.select("rule_id").distinct().agg(F.count("*").alias("rules"))
    out = None
    for name, df in sorted(models.items()):
        x = df.select("rule_id").distinct().agg(F.count("*").alias("emitted")).withColumn("model", F.lit(name))
        out = x if out is None else out.unionByName(x)
    return out.crossJoin(F.broadcast(n)).select("model", "emitted", "rules", F.round(F.col("emitted") / F.col("rules") * 100, 1).alias("percent"))


def condition_text(rule: dict) -> str:
    """The condition of a rule as words, with AND and OR and brackets where they are needed."""
    by = {str(p.get("predicate_id")): f"{p.get('variable')} {p.get('operator')} {feel(p.get('value'))}" if not isinstance(p.get("value"), list) else f"{p.get('variable')} {p.get('operator')} [{', '.join(feel(v) for v in p['value'])}]" for p in rule.get("condition_predicates") or []}

    def go(x, inside: bool) -> str:
        if isinstance(x, str):
            x = {"all" if x == "AND" else "any": [{"predicate_ref": i} for i in by]}
        if "predicate_ref" in x:
            return by.get(str(x["predicate_ref"]), f"unknown {x['predicate_ref']}")
        if "constant" in x:
            return "always" if x["constant"] else "never"
        word = "all" if "all" in x else "any"
        text = (" AND " if word == "all" else " OR ").join(go(y, len(x[word]) > 1) for y in x[word])
        return f"({text})" if inside and len(x[word]) > 1 else text

    return go(rule.get("condition_logic") or {"constant": True}, False)


def json_schema(attributes: list[dict]) -> dict:
    """A JSON Schema of classes out of rows (class, name, type, required, values)."""
    plain = {"Integer": "integer", "Boolean": "boolean", **dict.fromkeys(("Money", "Percentage", "Decimal", "Quantity", "Duration"), "number")}
    made: dict = {"$schema": "https://json-schema.org/draft/2020-12/schema", "$defs": {}}
    for a in sorted(attributes, key=lambda a: (a["class"], a["name"])):
        c = made["$defs"].setdefault(a["class"], {"type": "object", "properties": {}, "required": []})
        c["properties"][a["name"]] = {"enum": a["values"]} if a.get("values") else {"type": plain.get(a["type"], "string"), **({"format": {"Date": "date", "DateTime": "date-time", "Time": "time"}[a["type"]]} if a["type"] in ("Date", "DateTime", "Time") else {})}
        if a.get("required"):
            c["required"].append(a["name"])
    return made


def class_diagram(attributes: list[dict], relationships: list[dict], style: str = "mermaid") -> str:
    """Classes and relationships (source, verb, target) as a Mermaid or PlantUML class diagram."""
    lines = ["classDiagram"] if style == "mermaid" else ["@startuml"]
    for name in sorted({a["class"] for a in attributes}):
        lines += [f"class {name} {{", *(f"  {a['name']}: {a['type']}" if style != "mermaid" else f"  {a['type']} {a['name']}" for a in sorted(attributes, key=lambda a: a["name"]) if a["class"] == name), "}"]
    lines += [f"{r['source']} --> {r['target']} : {r['verb']}" for r in sorted(relationships, key=lambda r: (r["source"], r["target"], r["verb"]))]
    return "\n".join(lines if style == "mermaid" else [*lines, "@enduml"])


def yaml_schema(attributes: list[dict]) -> str:
    """Classes, slots and enumerations as YAML."""
    q = lambda v: json.dumps(str(v), ensure_ascii=False)
    lines = ["classes:"]
    for name in sorted({a["class"] for a in attributes}):
        lines += [f"  {name}:", "    attributes:"]
        for a in sorted(attributes, key=lambda a: a["name"]):
            if a["class"] == name:
                lines += [f"      {a['name']}:", f"        range: {a['type']}", f"        required: {str(bool(a.get('required'))).lower()}", *([f"        any_of: [{', '.join(map(q, a['values']))}]"] if a.get("values") else [])]
    return "\n".join(lines) + "\n"


def markdown_table(rows: DataFrame, most: int = 1000) -> str:
    """The first `most` rows as Markdown, bars escaped."""
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = ["| " + " | ".join(rows.columns) + " |", "|" + " --- |" * len(rows.columns)]
    return "\n".join([*lines, *("| " + " | ".join(map(cell, r)) + " |" for r in rows.limit(most).collect())]) + "\n"


def write_table(rows: DataFrame, path: str, kind: str = "json") -> None:
    """A sink: parquet, json, csv (with a header) or text (one column) at a path, replacing what is there."""
    w = rows.write.mode("overwrite")
    {"parquet": w.parquet, "json": w.json, "csv": w.option("header", True).csv, "text": w.text}[kind](path)
