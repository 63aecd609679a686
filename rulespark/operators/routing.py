"""Where rules and findings go: scopes, execution targets, claim requirements, review routes, conflicts, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import normalize as N
from .repair import filled

#: Execution targets; kinds of workflow steps; claim types and what needs them; marks of a judgment that is a person's.
TARGETS = ("bpmn", "cmmn", "dmn", "lexec", "sbvr")
STEP_KINDS = ("business_rule_task", "receive_task", "send_task", "service_task", "user_task")
REQUIRED_FOR = [
    (("condition", "outcome", "exception", "scope"), "source_bearing", ("dmn", "lexec")),
    (("workflow_actor",), "source_bearing", ("bpmn", "cmmn")),
    (("workflow", "workflow_step", "workflow_trigger"), "source_bearing", ("bpmn",)),
    (("case_trigger", "case_task", "case_milestone"), "source_bearing", ("cmmn",)),
    (("concept", "concept_definition", "concept_relationship"), "source_bearing", ("sbvr",)),
    (("condition_logic", "variable", "test_vector", "execution"), "derived", ("dmn", "lexec")),
    (("classification", "entity_attachment"), "derived", ()),
]
JUDGMENT = ("source conflict", "legal ambiguity", "policy owner decision")
MACHINE = ("contract", "execution", "naming", "test_vectors")
#: The most pairs of one remediation request.
MOST_CANDIDATES = 5000


def strings(*values: str) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def clean_scope(scope: Column) -> Column:
    """Dimensions (map<string, array<string>>) with a name and a list; null scopes are empty."""
    named = F.map_filter(F.coalesce(scope, F.create_map().cast("map<string,array<string>>")), lambda k, v: (F.trim(k) != "") & v.isNotNull())
    return F.transform_keys(named, lambda k, _: F.trim(k))


def populated_scope(scope: Column) -> Column:
    """Dimensions with at least one value that is not null or empty, and only such values."""
    kept = F.transform_values(clean_scope(scope), lambda _, v: F.filter(v, lambda x: x.isNotNull() & (x != "")))
    return F.map_filter(kept, lambda _, v: F.size(v) > 0)


def newly_populated(before: Column, after: Column) -> Column:
    """How many dimensions have values now and had none before."""
    old, new = F.map_keys(populated_scope(before)), F.map_keys(populated_scope(after))
    return F.size(F.array_except(new, old))


def scope_issues(scope: Column) -> Column:
    """What keeps a JSON text from being an object of lists, dimension by dimension."""
    parsed = F.from_json(scope, "map<string,string>")
    bad = F.filter(F.map_entries(parsed), lambda e: (F.trim(e["key"]) == "") | ~F.coalesce(F.startswith(F.trim(e["value"]), F.lit("[")), F.lit(False)))
    each = F.transform(bad, lambda e: F.when(F.trim(e["key"]) == "", "scope contains an empty dimension name").otherwise(F.concat(F.lit("scope dimension "), F.trim(e["key"]), F.lit(" must be list-valued"))))
    whole = F.coalesce(F.startswith(F.trim(scope), F.lit("{")) & parsed.isNotNull(), F.lit(False))
    return F.when(whole, F.array_sort(each)).otherwise(strings("scope must be an object whose values are lists"))


def execution_targets(rules: DataFrame, variables: DataFrame) -> DataFrame:
    """rules (rule_id, unconditional, bpmn_eligible) with targets: DMN given outputs and inputs or no condition, BPMN if eligible."""
    role = N.name(F.col("role"))
    g = variables.groupBy("rule_id").agg(F.count_if(role.isin("input", "derived")).alias("inputs"), F.count_if(role == "output").alias("outputs"))
    x = rules.join(g, "rule_id", "left")
    dmn = (F.coalesce("outputs", F.lit(0)) > 0) & ((F.coalesce("inputs", F.lit(0)) > 0) | F.col("unconditional"))
    return x.select("rule_id", F.array_compact(F.array(F.when(dmn, "DMN"), F.when(F.col("bpmn_eligible"), "BPMN"))).alias("targets"))


def bpmn_reasons(workflow: Column, responsible: Column) -> Column:
    """Why a rule is no workflow, in order; empty if it is one.

    workflow: struct<kind, basis, trigger_event, actor_role, evidence array<struct<chunk_path, section_id,
    source_text>>, ordered_steps array<struct<step_id, name, kind>>>, or null.
    """
    w, evidence, steps = workflow, workflow["evidence"], workflow["ordered_steps"]
    one = lambda bad, why: F.when(bad, F.array(why if isinstance(why, Column) else F.lit(why))).otherwise(strings())
    empty = lambda c: filled(c).isNull()
    actor = F.coalesce(F.trim(w["actor_role"]), F.lit(""))
    at = lambda name, i, why: F.concat(F.lit(name), i.cast("string"), F.lit(why))

    def proof(e: Column, i: Column) -> Column:
        return one(empty(e["chunk_path"]) | empty(e["section_id"]) | empty(e["source_text"]), at("workflow evidence ", i, " is incomplete"))

    def step(s: Column, i: Column) -> Column:
        mine = F.coalesce(F.trim(s["step_id"]), F.lit(""))
        before = F.exists(F.slice(steps, F.lit(1), i), lambda t: F.coalesce(F.trim(t["step_id"]), F.lit("")) == mine)
        return F.concat(
            one((mine == "") | before, at("ordered_steps[", i, "] has a missing or duplicate step_id")), one(empty(s["name"]), at("ordered_steps[", i, "] has no name")),
            one(~F.coalesce(s["kind"].isin(*STEP_KINDS), F.lit(False)), at("ordered_steps[", i, "] has an unsupported kind")),
        )

    several = F.coalesce(F.size(steps), F.lit(0)) >= 2
    reasons = F.concat(
        one(~F.coalesce(w["kind"] == "prescriptive_process", F.lit(False)), "workflow kind is not prescriptive_process"), one(~F.coalesce(w["basis"] == "explicit_in_source", F.lit(False)), "workflow order is not explicit in source"),
        one(empty(w["trigger_event"]), "trigger_event is absent"), one(actor == "", "actor_role is absent"), one((actor != "") & (actor != F.coalesce(F.trim(responsible), F.lit(""))), "actor_role does not match responsible_party"),
        F.when(F.coalesce(F.size(evidence), F.lit(0)) < 1, strings("workflow evidence is absent")).otherwise(F.flatten(F.transform(evidence, proof))),
        F.when(~several, strings("at least two explicit ordered_steps are required")).otherwise(F.flatten(F.transform(steps, step))),
    )
    return F.when(w.isNull(), strings("workflow_semantics is absent")).otherwise(reasons)


def claim_requirement(field_path: Column, claim_type: Column) -> Column:
    """struct(origin, required_for): which targets need a claim; what is not known is needed by all."""
    path, kind = filled(field_path), filled(claim_type)
    s = lambda origin, targets: F.struct(F.lit(origin).alias("origin"), strings(*targets).alias("required_for"))
    out = F.when(path.isNull() | kind.isNull(), s("unknown", TARGETS)).when(kind.isin("description", "generated_label"), s("presentation", ())).when(F.startswith(path, F.lit("counterparties[")), s("source_bearing", ("bpmn", "cmmn")))
    core, *rest = REQUIRED_FOR
    out = out.when(kind.isin(*core[0]), s(*core[1:])).when(path == "responsible_party", s("source_bearing", ("bpmn", "cmmn")))
    for kinds, origin, targets in rest:
        out = out.when(kind.isin(*kinds), s(origin, targets))
    return out.otherwise(s("unknown", TARGETS))


def modality(rule_type: Column, mandatory: Column) -> Column:
    kind = F.coalesce(N.name(rule_type), F.lit(""))
    return F.when(kind.rlike("prohibit|restriction|forbidden"), "prohibition").when(kind.isin("definition", "calculation"), "definition").when(mandatory, "obligation").when(mandatory == F.lit(False), "permission").otherwise("none")


def review_routes(findings: DataFrame) -> DataFrame:
    """(rule_id, route, human_review_required) from findings (rule_id, requirement, code, reason, human_review_required, evidence_limited).

    A counted contradiction, a mark of judgment or an explicit request goes to people; what only machines need to mend
    to machine_repair; the rest to case_management.
    """
    reason, code = F.lower(F.coalesce("reason", F.lit(""))), F.coalesce(filled(F.col("code")), F.lit(""))
    counted = F.regexp_extract(reason, r"(?:^|\s)([0-9]+)\s+contradicted(?:$|[^a-z0-9_])", 1)
    marked = F.lit(False)
    for m in JUDGMENT:
        marked = marked | F.contains(reason, F.lit(m))
    grounding = F.coalesce(F.col("requirement") == "grounding", F.lit(False)) & (counted != "")
    human = F.coalesce("human_review_required", F.lit(False)) | F.when(grounding, F.try_to_number(counted, F.lit("999999")) > 0).otherwise(marked)
    need = F.coalesce(filled(F.col("requirement")), F.when(code == "", "unclassified").when(code.contains("evidence") | code.isin("missing_source_reference", "invalid_source_reference"), "evidence").otherwise("contract"))
    g = findings.groupBy("rule_id").agg(F.max(human).alias("human"), F.min(need.isin(*MACHINE) & ~F.coalesce("evidence_limited", F.lit(False))).alias("machine"))
    return g.select("rule_id", F.when(F.col("human"), "human_review").when(F.col("machine"), "machine_repair").otherwise("case_management").alias("route"), F.col("human").alias("human_review_required"))


def failure_routes(requirement: Column, code: Column) -> Column:
    """The repair paths of a failed requirement: itself, its code, and the family of the code."""
    c = filled(code)
    return F.array_sort(F.array_distinct(F.array_compact(F.array(filled(requirement), F.concat(F.lit("code:"), c), F.when(c.contains("exception"), "exceptions").when(c.contains("scope"), "scope").when(c.isNotNull(), "contract")))))


def source_root(path: Column) -> Column:
    """The first part of a path that names something; null if there is none."""
    parts = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda p: ~p.isin("", ".", ".."))
    return F.get(parts, F.lit(0))


def entity_groups(rules: DataFrame, entities: list[str]) -> DataFrame:
    """(entity, rule_id): each rule under the canonical key of every entity its columns name; distinct."""
    x = rules.select("rule_id", F.explode(F.array_compact(F.array(*[filled(F.col(c)) for c in entities]))).alias("e"))
    return x.select(N.entity_key(F.col("e")).alias("entity"), "rule_id").distinct()


def conflict_groups(groups: DataFrame, citations: DataFrame) -> DataFrame:
    """(entity, root, rules): rules of an entity that cite one source, two at least; rules without a source are a group of their own."""
    roots = citations.select("rule_id", source_root(F.col("chunk_path")).alias("root")).where("root is not null").distinct()
    x = groups.join(roots, "rule_id", "left").withColumn("root", F.coalesce("root", F.lit("__unscoped__")))
    return x.groupBy("entity", "root").agg(F.count_distinct("rule_id").alias("rules")).where("rules > 1")


def output_value(value: Column, kind: Column) -> Column:
    """A comparison key of an output: true and eligible are the same decision, and so are false, ineligible and not_eligible."""
    low = F.lower(F.trim(value))
    yes_no = F.when(kind == "boolean", F.when(low == "true", "decision:eligible").when(low == "false", "decision:ineligible")).when(kind == "enum", F.when(low == "eligible", "decision:eligible").when(low.isin("ineligible", "not_eligible"), "decision:ineligible"))
    return F.coalesce(yes_no, F.concat(F.coalesce(kind, F.lit("")), F.lit(":"), F.coalesce(low, F.lit(""))))


def conflict_pairs(entries: DataFrame, outcomes: DataFrame, most: int | None = None) -> DataFrame:
    """(entity, a, b, status): unresolved groups (entity, rule_ids array, status, resolution) as pairs; pairs that write nothing in common, or the same, are none.

    With `most`, the pairs that are still open are cut to so many in order, as one remediation request takes them.
    """
    open_ = (F.col("status") == "unresolved") | ((F.col("status") == "conflict") & filled(F.col("resolution")).isNull())
    ids = F.array_sort(F.array_distinct("rule_ids"))
    x = entries.where(open_).select("entity", ids.alias("ids")).select("entity", "ids", F.posexplode("ids").alias("i", "a")).select("entity", "a", F.explode(F.slice("ids", F.col("i") + 2, F.greatest(F.size("ids") - F.col("i") - 1, F.lit(0)))).alias("b")).distinct()
    o = outcomes.select("rule_id", "variable", output_value(F.col("value"), F.col("value_type")).alias("v"))
    shared = x.join(o.toDF("a", "variable", "va"), "a").join(o.toDF("b", "variable", "vb"), ["b", "variable"]).groupBy("entity", "a", "b").agg(F.max(F.col("va") != F.col("vb")).alias("differ"))
    out = x.join(shared, ["entity", "a", "b"], "left").select("entity", "a", "b", F.when(F.coalesce("differ", F.lit(False)), "unresolved").otherwise("non_conflict").alias("status"))
    return out if most is None else out.where("status = 'unresolved'").orderBy("entity", "a", "b").limit(most)


def dedup_conflicts(conflicts: DataFrame, columns: list[str]) -> DataFrame:
    """One row for each stable hash of the columns."""
    return conflicts.withColumn("conflict_id", F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns)), 256)).groupBy("conflict_id", *columns).agg(F.count("*").alias("copies"))


def missing_keys(rows: DataFrame, catalog: DataFrame, column: str) -> DataFrame:
    """Rows whose column, as a canonical key, is in no catalog (name): orphan buckets, parties to add."""
    return rows.withColumn("_k", N.entity_key(F.col(column))).join(catalog.select(N.entity_key(F.col("name")).alias("_k")).distinct(), "_k", "left_anti").drop("_k")


def placeholders(parties: DataFrame, catalog: DataFrame) -> DataFrame:
    """catalog (name, definition, placeholder) with a placeholder for every party that it lacks."""
    new = missing_keys(parties.where(filled(F.col("party")).isNotNull()), catalog, "party").select(N.entity_key(F.col("party")).alias("name")).distinct()
    return catalog.select("name", "definition", F.lit(False).alias("placeholder")).unionByName(new.select("name", F.lit(None).cast("string").alias("definition"), F.lit(True).alias("placeholder")))


def naming_issues(references: DataFrame, catalog: DataFrame) -> DataFrame:
    """references (rule_id, field, value) that are no exact canonical key of the catalog (name)."""
    known = catalog.select(F.col("name").alias("value")).where(F.col("value").rlike("^[A-Z][A-Z0-9]*(_[A-Z0-9]+)*$")).distinct()
    return references.where("value is not null and value <> ''").join(known, "value", "left_anti").select(F.concat("rule_id", F.lit("."), "field").alias("path"), "value")


def run_status(stages: DataFrame, by: str, status: str = "status") -> DataFrame:
    """fail before review before pass; a run in which nothing is any of them has failed."""
    s = F.col(status)
    return stages.groupBy(by).agg(F.when(F.max(s == "fail"), "fail").when(F.max(s == "review"), "review").when(F.max(s == "pass"), "pass").otherwise("fail").alias("status"))


def gates(reports: DataFrame) -> DataFrame:
    """reports (run, total, ready, failed_invariants, unverified) -> may it go on as review only, does it need remediation, is grounding complete."""
    held = F.col("total") - F.col("ready")
    return reports.select("run", ((F.col("failed_invariants") == 0) & (held > 0)).alias("review_only"), ((F.col("failed_invariants") > 0) | (held > 0)).alias("remediate"), (F.col("unverified") == 0).alias("grounding_complete"))


def set_differences(sides: dict[str, DataFrame], column: str) -> DataFrame:
    """(side, column): what each named set has and some other has not."""
    spark_rows = None
    n = len(sides)
    for name, df in sides.items():
        x = df.select(F.col(column)).where(F.col(column).isNotNull()).distinct().withColumn("side", F.lit(name))
        spark_rows = x if spark_rows is None else spark_rows.unionByName(x)
    g = spark_rows.groupBy(column).agg(F.collect_set("side").alias("s"))
    return g.where(F.size("s") < n).select(F.explode("s").alias("side"), column)


def first_present(*columns: Column) -> Column:
    """The first text that is not empty."""
    return F.coalesce(*[filled(c) for c in columns])


def statement(texts: list[Column], conditions: Column, outcomes: Column) -> Column:
    """A rule's own words, else a sentence of its conditions and outcomes."""
    made = F.concat(F.lit("When "), F.coalesce(filled(conditions), F.lit("the rule applies")), F.lit(", then "), F.coalesce(filled(outcomes), F.lit("the policy outcome is evaluated")), F.lit("."))
    return F.coalesce(first_present(*texts), made)


def source_anchor(path: Column, section: Column, start: Column, end: Column) -> Column:
    text = lambda c: F.coalesce(F.trim(c.cast("string")), F.lit(""))
    return F.concat(F.lit("source-"), F.left(F.sha1(F.concat_ws("|", text(path), text(section), text(start), text(end))), F.lit(16)))


def unique_references(references: DataFrame) -> DataFrame:
    """references (rule_id, pos, field, chunk_path, section_id, start, end): one a place, with the field that comes first, and its anchor."""
    a = source_anchor(F.col("chunk_path"), F.col("section_id"), F.col("start"), F.col("end"))
    return references.withColumn("anchor", a).groupBy("rule_id", "anchor").agg(F.min(F.struct("pos", "field")).alias("f"), F.count("*").alias("uses")).select("rule_id", "anchor", "f.field", "f.pos", "uses")


def reference_texts(references: DataFrame, chunks: DataFrame) -> DataFrame:
    """references (chunk_path, section_id, source_text) with `shown`: their text, else that of (path, section), else that of (path, "")."""
    c = chunks.select("chunk_path", F.coalesce("section_id", F.lit("")).alias("section_id"), "text")
    x = references.join(c.withColumnRenamed("text", "_exact"), ["chunk_path", "section_id"], "left").join(c.where("section_id = ''").select("chunk_path", F.col("text").alias("_whole")), "chunk_path", "left")
    return x.withColumn("shown", F.coalesce(filled(F.col("source_text")), "_exact", "_whole", F.lit(""))).drop("_exact", "_whole")


def passages(references: DataFrame) -> DataFrame:
    """Distinct (rule_id, chunk_path, section_id) of references that name both."""
    x = references.select("rule_id", filled(F.col("chunk_path")).alias("chunk_path"), filled(F.col("section_id")).alias("section_id"))
    return x.where("chunk_path is not null and section_id is not null").distinct()


def section_manifest(before: DataFrame, after: DataFrame, reasons: DataFrame) -> DataFrame:
    """(section_id, change, reason, pass): cited sections added or removed; each needs a reason (section_id, reason)."""
    b, a = (df.select(filled(F.col("section_id")).alias("section_id")).where("section_id is not null").distinct() for df in (before, after))
    moved = a.join(b, "section_id", "left_anti").withColumn("change", F.lit("added")).unionByName(b.join(a, "section_id", "left_anti").withColumn("change", F.lit("removed")))
    x = moved.join(reasons, "section_id", "left")
    return x.select("section_id", "change", F.coalesce("reason", F.lit("")).alias("reason"), filled(F.col("reason")).isNotNull().alias("pass"))


def canonical_edges(edges: DataFrame, fallback: DataFrame, admission: bool) -> DataFrame:
    """Directed edges (source, target, kind, directed, admission, verified); under admission only canonical ones that are verified.

    Without admission and without any such edge, the rules' own lists (source, target) stand in.
    """
    directed = edges.where(F.coalesce("directed", F.lit(True)) & ~F.coalesce(N.name(F.col("kind")), F.lit("")).isin("association", "conflict"))
    if admission:
        return directed.where("admission = 'canonical' and verified").select("source", "target")
    none = directed.agg((F.count("*") == 0).alias("none"))
    return directed.select("source", "target").unionByName(fallback.crossJoin(F.broadcast(none)).where("none").select("source", "target"))


def union_edges(old: DataFrame, new: DataFrame, aligned: DataFrame) -> DataFrame:
    """Edges of both versions under the old ids; aligned (old_id, new_id)."""
    one = aligned.where("old_id is not null and new_id is not null")
    for c in ("source", "target"):
        new = new.join(one.select(F.col("new_id").alias(c), "old_id"), c, "left").withColumn(c, F.coalesce("old_id", c)).drop("old_id")
    return old.select("source", "target").unionByName(new.select("source", "target")).distinct()


def semantic_pairs(old: DataFrame, new: DataFrame, aligned: DataFrame, most: int) -> DataFrame:
    """Unmatched old and new rules (rule_id, rule_type) of one type, in order, the first `most` as the comparison's budget has it."""
    kind = F.coalesce(N.name(F.col("rule_type")), F.lit("")).alias("kind")
    one = aligned.where("old_id is not null and new_id is not null")
    left = old.join(one.select(F.col("old_id").alias("rule_id")), "rule_id", "left_anti").select(F.col("rule_id").alias("old_id"), kind)
    right = new.join(one.select(F.col("new_id").alias("rule_id")), "rule_id", "left_anti").select(F.col("rule_id").alias("new_id"), kind)
    return left.join(right, "kind").select("old_id", "new_id").orderBy("old_id", "new_id").limit(most)


def response_protocol(claims: DataFrame, responses: DataFrame) -> DataFrame:
    """For each rule of claims (rule_id, claim_id): returned, missing and duplicate answers; answers to no claim are counted under unexpected."""
    r = responses.groupBy("rule_id", "claim_id").agg(F.count("*").alias("n"))
    x = claims.select("rule_id", "claim_id").distinct().withColumn("asked", F.lit(True)).join(r, ["rule_id", "claim_id"], "full_outer")
    n, asked = F.coalesce("n", F.lit(0)), F.col("asked").isNotNull()
    return x.groupBy("rule_id").agg(
        F.count_if(asked & (n > 0)).alias("returned"), F.count_if(asked & (n == 0)).alias("missing"), F.sum(F.when(asked & (n > 1), n - 1).otherwise(0)).cast("long").alias("duplicates"), F.sum(F.when(~asked, n).otherwise(0)).cast("long").alias("unexpected")
    )


def negative_provenance(claim_id: Column, structured: Column, search: Column, digest: Column, count: Column) -> Column:
    """Is an absence certified: search struct<status, corpus_sha256, chunk_count> of the whole corpus as it is now."""
    absent = ((claim_id == "exception_basis") & (structured == "explicitly_none_in_source")) | ((claim_id == "scope_basis") & (structured == "genuinely_unscoped"))
    return F.coalesce(absent & filled(digest).isNotNull() & (search["status"] == structured) & (search["corpus_sha256"] == digest) & (search["chunk_count"] == count), F.lit(False))


def stale_certificates(certificates: DataFrame, rules: DataFrame, digest: Column) -> DataFrame:
    """(rule_id, reasons): why a certificate (rule_id, subject_sha256, corpus_sha256, verdict) cannot be used for the rule (rule_id, subject_sha256) as it is now."""
    x = rules.select("rule_id", F.col("subject_sha256").alias("_now")).join(certificates, "rule_id", "left")
    why = lambda bad, text: F.when(F.coalesce(bad, F.lit(True)), text)
    none = F.col("verdict").isNull()
    reasons = F.array_compact(F.array(why(F.col("subject_sha256") != F.col("_now"), "subject changed"), why(F.col("corpus_sha256") != digest, "corpus changed"), why(F.col("verdict") != "certified", "not certified")))
    return x.select("rule_id", F.when(none, strings("no certificate")).otherwise(reasons).alias("reasons"))


def validated_results(pairs: DataFrame, results: DataFrame) -> DataFrame:
    """results (pair_id, relationship, similarity_score, confidence, contradiction as JSON) with `fault`: null for a result that may be used.

    Each pair has one result; scores are in 0..100 and 0..1; CONTRADICTORY needs all five parts of its explanation.
    """
    parts = ("shared_subject", "shared_scope", "old_requirement", "new_requirement", "incompatibility")
    told = F.lit(True)
    for p in parts:
        told = told & filled(F.get_json_object("contradiction", f"$.{p}")).isNotNull()
    x = results.join(pairs.select("pair_id").distinct().withColumn("_asked", F.lit(True)), "pair_id", "left").withColumn("_n", F.count("*").over(W.partitionBy("pair_id")))
    bad = lambda c: ~F.coalesce(c, F.lit(False))
    fault = (
        F.when(F.col("_asked").isNull(), "unknown pair").when(F.col("_n") > 1, "duplicate pair").when(bad(F.upper("relationship").isin("IDENTICAL", "EQUIVALENT", "CONTRADICTORY", "UNRELATED")), "invalid relationship")
        .when(bad(F.col("similarity_score").between(0, 100)) | bad(F.col("confidence").between(0, 1)), "score out of range").when((F.upper("relationship") == "CONTRADICTORY") & bad(told), "contradiction without evidence")
    )
    return x.withColumn("fault", fault).drop("_asked", "_n")
