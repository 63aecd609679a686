"""Repairs of extracted rules: parties, names, predicates, variables, exceptions, evidence.

Rules are kept as child tables (predicates, variables, outcomes, exceptions,
parties), one row an item with the rule's id and the item's place, so that each
repair is a projection, a join or a window by rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import normalize as N

#: Cues of conditional and of binding sentences, of exceptions; comparison operators; types a literal may take from its variable.
CONDITIONAL = r"(?i)(^|[^\p{L}\p{N}_])(if|when|whenever|unless|provided\s+that|only\s+if|in\s+the\s+event\s+that)($|[^\p{L}\p{N}_])"
BINDING = r"(?i)(^|[^\p{L}\p{N}_])(must|shall|is\s+required\s+to|are\s+required\s+to|requires?)($|[^\p{L}\p{N}_])"
EXCEPTION_CUES = ("except", "unless", "notwithstanding", "waiver", "exempt", "exception", "does not apply")
COMPARISONS = ("==", "!=", "<", "<=", ">", ">=", "in", "not_in", "contains")
DECLARABLE = ("date", "date_time", "time", "duration", "enum", "number", "boolean", "list", "range", "string")
CANONICAL = "^[A-Z][A-Z0-9]*(_[A-Z0-9]+)*$"
FACT_ID = "^[a-z][a-z0-9]*(_[a-z0-9]+)*$"


def filled(c: Column) -> Column:
    """The trimmed text, null if nothing is left."""
    return F.nullif(F.trim(c), F.lit(""))


def unwrap_party(party: Column) -> Column:
    """A party given as an object becomes the name it holds; plain text stays."""
    parts = [filled(F.get_json_object(party, f"$.{k}")) for k in ("entity_type", "entity", "name_ref")]
    return F.when(F.startswith(F.trim(party), F.lit("{")), F.coalesce(*parts)).otherwise(filled(party))


def quarantine_parties(parties: DataFrame, catalog: DataFrame) -> DataFrame:
    """parties (.., party) with kept and reason: one that the catalog (name, kind) knows as something else than an actor goes."""
    kinds = catalog.where("kind is not null and kind <> ''").groupBy(N.name(F.col("name")).alias("_n")).agg(F.max("kind").alias("_kind"))
    x = parties.withColumn("_n", N.name(F.col("party"))).join(kinds, "_n", "left")
    bad = F.coalesce(F.col("_kind") != "actor_role", F.lit(False))
    return x.withColumns({"kept": ~bad, "reason": F.when(bad, F.concat(F.lit("concept_kind "), "_kind", F.lit(" cannot bear a party role")))}).drop("_n", "_kind")


def unconditional_source(text: Column) -> Column:
    """A binding sentence without a conditional cue."""
    return F.coalesce(text.rlike(BINDING) & ~text.rlike(CONDITIONAL), F.lit(False))


def unusable(sources: list[Column], sizes: list[Column]) -> Column:
    """A phantom record: no part of a source, and none of the lists holds anything."""
    no_source, nothing = F.lit(True), F.lit(True)
    for s in sources:
        no_source = no_source & filled(s).isNull()
    for n in sizes:
        nothing = nothing & (F.coalesce(n, F.lit(0)) == 0)
    return no_source & nothing


def literal_type(value: Column, declared: Column, operator: Column) -> Column:
    """The type of a JSON literal: what it is, else what its variable declares, else enum or string by the operator."""
    text = N.lookup(N.name(declared), N.TYPE_ALIASES)
    return (
        F.when(value.isin("true", "false"), "boolean").when(value.rlike(r"^-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?$"), "number").when(F.startswith(value, F.lit("[")), "list")
        .when(F.startswith(value, F.lit('"')), F.when(text.isin(*DECLARABLE), text).when(operator.isin("in", "not_in"), "enum").otherwise("string"))
    )


def entity_names(entities: DataFrame, references: DataFrame) -> DataFrame:
    """(name, canonical): entity keys that are not canonical, and references whose canonical form is a known entity."""
    e = entities.select("name").where("name <> ''").distinct().withColumn("canonical", N.camel_to_key(N.entity_key_parts(F.col("name"))))
    fine = F.col("name").rlike(CANONICAL)
    known = e.select(F.when(fine, F.col("name")).otherwise(F.col("canonical")).alias("canonical")).where("canonical <> ''").distinct()
    changed = e.where(~fine & (F.col("canonical") != "") & (F.col("canonical") != F.col("name")))
    r = references.select("name").where("name <> ''").distinct().where(~fine).withColumn("canonical", N.camel_to_key(N.entity_key_parts(F.col("name"))))
    return changed.unionByName(r.where("canonical <> name").join(known, "canonical", "left_semi").select("name", "canonical")).distinct()


def rename(df: DataFrame, columns: list[str], names: DataFrame) -> DataFrame:
    """Every value of the columns that names has (name, canonical) in its canonical form."""
    for c in columns:
        df = df.join(names.select(F.col("name").alias(c), "canonical"), c, "left").withColumn(c, F.coalesce("canonical", c)).drop("canonical")
    return df


def collisions(definitions: DataFrame, names: DataFrame) -> DataFrame:
    """Definitions (name, placeholder) that a renaming would merge: (canonical, n, merges); several real ones must not merge."""
    x = rename(definitions.select("name", "placeholder"), ["name"], names)
    g = x.groupBy(F.col("name").alias("canonical")).agg(F.count("*").alias("n"), F.count_if(~F.col("placeholder")).alias("real"))
    return g.where("n > 1").select("canonical", "n", (F.col("real") <= 1).alias("merges"))


def coerce_basis(basis: Column, reason: Column, valid: list[str], unresolved: str, field: str) -> Column:
    """struct(basis, reason): what is no valid state becomes the unresolved one, its text kept as the reason unless there is one."""
    why = F.coalesce(filled(reason), basis, F.lit(f"No valid {field} was produced by extraction or evidence completion."))
    ok = F.coalesce(basis.isin(*valid), F.lit(False))
    return F.struct(F.when(ok, basis).otherwise(unresolved).alias("basis"), F.when(ok, reason).otherwise(why).alias("reason"))


def compact(c: Column) -> Column:
    """A name without case and separators."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")


def resolve_references(references: DataFrame, variables: DataFrame, ref: str = "variable") -> DataFrame:
    """references (rule_id, ref, ..) with `resolved`: the one variable (rule_id, name) of the rule that is written alike but for case and separators."""
    v = variables.select("rule_id", filled(F.col("name")).alias("name")).distinct().withColumn("_c", compact(F.col("name"))).where("_c <> ''")
    one = v.groupBy("rule_id", "_c").agg(F.min("name").alias("_name"), F.count("*").alias("_n")).where("_n = 1").drop("_n")
    x = references.withColumn("_c", compact(F.col(ref))).join(one, ["rule_id", "_c"], "left")
    return x.withColumn("resolved", F.coalesce("_name", ref)).drop("_c", "_name")


def canonical_fact_ids(variables: DataFrame) -> DataFrame:
    """variables (rule_id, pos, fact_id, name) with `canonical`, unique in its rule: the first free of x, x_2, x_3, .. in order of pos."""
    given, spare = N.name(F.col("fact_id")), F.coalesce(N.name(F.col("name")), F.lit(""))
    s = F.regexp_replace(F.regexp_replace(F.when(given.rlike(FACT_ID), given).otherwise(spare), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    s = F.when(s == "", "fact").when(s.rlike("^[0-9]"), F.concat(F.lit("fact_"), s)).otherwise(s)
    rows = variables.withColumn("_b", s).groupBy("rule_id").agg(F.array_sort(F.collect_list(F.struct("pos", "_b"))).alias("v"))

    def step(done: Column, x: Column) -> Column:
        others = F.transform(F.sequence(F.lit(2), F.size(done) + 2), lambda k: F.concat(x["_b"], F.lit("_"), k.cast("string")))
        name = F.filter(F.concat(F.array(x["_b"]), others), lambda c: ~F.exists(done, lambda d: d["canonical"] == c))[0]
        return F.concat(done, F.array(F.struct(x["pos"].alias("pos"), name.alias("canonical"))))

    kind = f"array<struct<pos:{variables.schema['pos'].dataType.simpleString()},canonical:string>>"
    named = rows.select("rule_id", F.inline(F.aggregate("v", F.array().cast(kind), step)))
    return variables.join(named, ["rule_id", "pos"])


def predicate_ids(predicates: DataFrame) -> DataFrame:
    """predicates (rule_id, pos, predicate_id): one without an id gets the first free of p1, p2, .. in its rule."""
    has = filled(F.col("predicate_id"))
    used = predicates.groupBy("rule_id").agg(F.collect_set(has).alias("_used"), F.count("*").alias("_n"))
    free = F.filter(F.transform(F.sequence(F.lit(1), (F.col("_n") * 2).cast("int")), lambda k: F.concat(F.lit("p"), k.cast("string"))), lambda p: ~F.array_contains("_used", p))
    nth = F.row_number().over(W.partitionBy("rule_id", has.isNull()).orderBy("pos"))
    x = predicates.withColumn("_k", nth).join(used.withColumn("_free", free), "rule_id")
    return x.withColumn("predicate_id", F.coalesce(has, F.get("_free", F.col("_k") - 1))).drop("_k", "_used", "_n", "_free")


def positional_references(references: DataFrame, predicates: DataFrame) -> DataFrame:
    """references (rule_id, ref) with `resolved`: an id of the rule as it is; pN else means its N-th predicate; null if there is none."""
    p = predicates.select("rule_id", "predicate_id", F.row_number().over(W.partitionBy("rule_id").orderBy("pos")).alias("_n"))
    x = references.withColumn("_at", F.try_to_number(F.regexp_extract("ref", "^p([0-9]{1,6})$", 1), F.lit("999999")).cast("int"))
    exact = p.select("rule_id", F.col("predicate_id").alias("ref"), F.col("predicate_id").alias("_exact")).distinct()
    x = x.join(exact, ["rule_id", "ref"], "left").join(p.select("rule_id", F.col("_n").alias("_at"), F.col("predicate_id").alias("_nth")), ["rule_id", "_at"], "left")
    return x.withColumn("resolved", F.coalesce("_exact", "_nth")).drop("_at", "_exact", "_nth")


def restore_operators(outcomes: DataFrame, baseline: DataFrame) -> DataFrame:
    """outcomes (rule_id, variable, operator): an assignment that was a comparison in the baseline is one again."""
    b = baseline.select("rule_id", "variable", F.col("operator").alias("_was")).where(F.col("_was").isin(*COMPARISONS)).distinct()
    x = outcomes.join(b, ["rule_id", "variable"], "left")
    back = F.col("operator").isin("=", "assign") & F.col("_was").isNotNull()
    return x.withColumns({"restored": back, "operator": F.when(back, F.col("_was")).otherwise(F.col("operator"))}).drop("_was")


def exception_ids(exceptions: DataFrame) -> DataFrame:
    """exceptions (rule_id, pos, predicate_id): flattened ids repeat, so the second of an id gets _copy_2, the third _copy_3."""
    base = F.coalesce(filled(F.col("predicate_id")), F.concat(F.lit("ex"), (F.col("pos") + 1).cast("string")))
    k = F.row_number().over(W.partitionBy("rule_id", "_b").orderBy("pos"))
    x = exceptions.withColumn("_b", base).withColumn("_k", k)
    return x.withColumn("predicate_id", F.when(F.col("_k") == 1, F.col("_b")).otherwise(F.concat("_b", F.lit("_copy_"), F.col("_k").cast("string")))).drop("_b", "_k")


def flatten_exceptions(rules: DataFrame, exceptions: str) -> DataFrame:
    """(rule_id, pos, predicate_id, variable) out of nested exceptions array<struct<id, variable, parts array<struct<id, variable>>>>: leaves in order."""
    leaf = lambda i, v: F.struct(i.alias("predicate_id"), v.alias("variable"))
    leaves = F.flatten(F.transform(exceptions, lambda e: F.when(e["variable"].isNotNull(), F.array(leaf(e["id"], e["variable"]))).otherwise(F.transform(F.coalesce(e["parts"], F.array().cast("array<struct<id:string,variable:string>>")), lambda p: leaf(F.coalesce(p["id"], e["id"]), p["variable"])))))
    return rules.select("rule_id", F.posexplode(leaves).alias("pos", "x")).select("rule_id", "pos", "x.predicate_id", "x.variable")


def split_exceptions(exceptions: DataFrame, outcomes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Exceptions on variables that the rule puts out are effects of the exception: (conditions, effects)."""
    out = outcomes.select("rule_id", N.name(F.col("variable")).alias("_v")).distinct()
    x = exceptions.withColumn("_v", N.name(F.col("variable")))
    return x.join(out, ["rule_id", "_v"], "left_anti").drop("_v"), x.join(out, ["rule_id", "_v"], "left_semi").drop("_v")


def undeclared(predicates: DataFrame, variables: DataFrame) -> DataFrame:
    """(rule_id, name, type, role): variables that predicates (rule_id, pos, variable, value, operator) test and nobody declares, as inputs."""
    v = variables.select("rule_id", N.name(F.col("name")).alias("_v")).distinct()
    x = predicates.withColumn("_v", N.name(F.col("variable"))).join(v, ["rule_id", "_v"], "left_anti")
    first = x.groupBy("rule_id", "_v").agg(F.min_by(F.struct(F.col("variable").alias("name"), literal_type(F.col("value"), F.lit(None).cast("string"), F.col("operator")).alias("type")), "pos").alias("f"))
    return first.select("rule_id", "f.name", F.coalesce("f.type", F.lit("string")).alias("type"), F.lit("input").alias("role"))


def repair_roles(variables: DataFrame, assigned: DataFrame, tested: DataFrame) -> DataFrame:
    """variables (rule_id, name, role): a role that is none becomes output if only assigned, input if only tested, else derived."""
    mark = lambda df, c: df.select("rule_id", N.name(F.col("variable")).alias("_v")).distinct().withColumn(c, F.lit(True))
    x = variables.withColumn("_v", N.name(F.col("name"))).join(mark(assigned, "_out"), ["rule_id", "_v"], "left").join(mark(tested, "_in"), ["rule_id", "_v"], "left")
    role, out, inp = N.name(F.col("role")), F.col("_out").isNotNull(), F.col("_in").isNotNull()
    fixed = F.when(role.isin("input", "output", "derived"), F.col("role")).when(out & ~inp, "output").when(inp & ~out, "input").otherwise("derived")
    return x.withColumn("role", fixed).drop("_v", "_out", "_in")


def merge_variables(variables: DataFrame, fields: list[str]) -> DataFrame:
    """variables (rule_id, pos, name, role, fields): declarations of one name but for case are one; the first filled value of a field stays, output wins over input."""
    first = lambda c: F.min_by(filled(F.col(c)), F.when(filled(F.col(c)).isNotNull(), F.col("pos")))
    role = F.when(F.max(N.name(F.col("role")) == "output"), "output").when((F.count("*") > 1) & F.max(N.name(F.col("role")) == "input"), "input").otherwise(first("role"))
    x = variables.where(filled(F.col("name")).isNotNull()).withColumn("_v", N.name(F.col("name")))
    return x.groupBy("rule_id", "_v").agg(F.min("pos").alias("pos"), F.min_by("name", "pos").alias("name"), role.alias("role"), *(first(c).alias(c) for c in fields), F.count("*").alias("declared")).drop("_v")


def evidence_pointer(path: Column, section: Column, text: Column, *aliases: Column) -> Column:
    """struct(chunk_path, section_id, source_text) if all three are filled; aliases stand in for a text that is not there."""
    t = F.coalesce(text, *aliases)
    whole = filled(path).isNotNull() & filled(section).isNotNull() & filled(t).isNotNull()
    return F.when(whole, F.struct(F.trim(path).alias("chunk_path"), F.trim(section).alias("section_id"), F.trim(t).alias("source_text")))


def best_evidence(dedicated: Column, of_field: Column) -> Column:
    """A field's own evidence list, else what the rule's evidence says on it; null if both are empty."""
    return F.coalesce(F.when(F.size(dedicated) > 0, dedicated), F.when(F.size(of_field) > 0, of_field))


def backfill(evidence: DataFrame, fields: list[str], spare: list[str]) -> DataFrame:
    """Evidence columns that are null take the first of the spare columns that is not."""
    return evidence.withColumns({f: F.coalesce(f, *spare) for f in fields})


def sync_evidence(records: DataFrame) -> DataFrame:
    """Verified records (rule_id, field, chunk_path, section_id, source_text, verified) by field; incomplete pointers are dropped, equal ones are one."""
    p = evidence_pointer(F.col("chunk_path"), F.col("section_id"), F.col("source_text"))
    return records.where("verified").select("rule_id", "field", p.alias("p")).where("p is not null").distinct().groupBy("rule_id", "field").agg(F.count("*").alias("records"), F.min("p.chunk_path").alias("first_path"))


def evidence_state(basis: Column, n_exceptions: Column, complete_search: Column, text: Column) -> Column:
    """An exception state that no exception and no cue of a complete search bears out becomes the no-cue state."""
    cue = F.lit(False)
    for c in EXCEPTION_CUES:
        cue = cue | F.contains(F.lower(F.coalesce(text, F.lit(""))), F.lit(c))
    wrong = (n_exceptions == 0) & basis.isin("explicit_in_source", "unresolved_after_full_document_search") & complete_search & ~cue
    return F.when(wrong, "no_exception_cue_found_in_complete_search").otherwise(basis)


def scope_state(basis: Column, n_dimensions: Column, n_evidence: Column) -> Column:
    """A populated scope with evidence is explicit, whatever the candidate label."""
    return F.when(basis.isin("inferred", "unresolved_after_source_review") & (n_dimensions > 0) & (n_evidence > 0), "explicit_in_source").otherwise(basis)


def patched(rules: DataFrame, patches: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """rules with the allowed fields of their patch; null in a patch leaves a field as it is, other columns of patches are not looked at."""
    p = patches.select(key, *(F.col(f).alias(f"_p_{f}") for f in fields))
    x = rules.join(p, key, "left")
    return x.withColumns({f: F.coalesce(f"_p_{f}", f) for f in fields}).drop(*(f"_p_{f}" for f in fields))


def list_outputs(outcomes: DataFrame) -> DataFrame:
    """outcomes (rule_id, variable, value as JSON, value_type, hit_policy): a variable that is given a list anywhere is a list everywhere, collected."""
    lists = outcomes.where(F.startswith("value", F.lit("["))).select("variable").distinct().withColumn("_l", F.lit(True))
    x = outcomes.join(lists, "variable", "left")
    is_list, now = F.col("_l").isNotNull(), F.startswith("value", F.lit("["))
    return x.withColumns({
        "value": F.when(is_list & ~now, F.concat(F.lit("["), "value", F.lit("]"))).otherwise(F.col("value")), "value_type": F.when(is_list, "list").otherwise(F.col("value_type")),
        "hit_policy": F.when(is_list, "COLLECT").otherwise(F.col("hit_policy")),
    }).drop("_l")


def checked_candidates(raw: Column, schema: str) -> Column:
    """struct(rule, requires_review, raw): text that is no JSON object of a rule is kept as a record to review."""
    rule = F.from_json(raw, schema)
    ok = F.coalesce(F.startswith(F.trim(raw), F.lit("{")) & rule.isNotNull() & F.get_json_object(raw, "$").isNotNull(), F.lit(False))
    return F.struct(F.when(ok, rule).alias("rule"), (~ok).alias("requires_review"), F.when(~ok, raw).alias("raw"))
