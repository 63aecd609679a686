"""The business information model: attributes, classes, relationships, its ten checks, and proposals to it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import normalize as N
from .infomodel import BASIS_RANK, PLAIN, infer_type, reconcile
from .repair import filled

#: Kinds of concepts that become classes; how sure a proposal may be.
CLASS_KINDS = ("business_object", "evidence_object", "event", "process", "actor_role")
SURE = ("high", "medium", "low", "unclear")


def attributes(declarations: DataFrame, reads: DataFrame) -> DataFrame:
    """One attribute for each symbol of declarations (rule_id, pos, symbol, kind, unit, values array<string>, low, high, default, free_text).

    The type is the one that refines all others, else the best founded; its first unit, default and range in order of pos
    stay, values are united.  conflict: contradiction, refinement, declared_type or null.  A symbol that some rule reads
    (reads: symbol) is required.
    """
    integral = F.coalesce((F.col("low").isNotNull() | F.col("high").isNotNull()) & (F.coalesce(F.col("low") % 1, F.lit(0.0)) == 0) & (F.coalesce(F.col("high") % 1, F.lit(0.0)) == 0), F.lit(False))
    d = declarations.withColumn("symbol", N.name(F.col("symbol"))).withColumn("t", infer_type(F.col("symbol"), N.name(F.col("kind")), N.name(F.col("unit")), F.coalesce(F.size("values"), F.lit(0)), F.col("free_text"), integral))
    d = d.withColumns({"type": F.col("t.type"), "basis": F.col("t.basis"), "needs_review": F.col("t.needs_review")})
    one = reconcile(d, "symbol", "type").withColumnRenamed("type", "resolved")
    rank = F.create_map(*[F.lit(x) for kv in BASIS_RANK.items() for x in kv])
    j = d.join(one, "symbol")
    fits = F.when(F.col("resolved").isNull() | (F.col("type") == F.col("resolved")), 1).otherwise(0)
    best = F.max_by(F.struct("type", "basis", "needs_review"), F.struct(fits, rank[F.col("basis")], -F.col("pos")))
    first = lambda c, ok: F.min_by(c, F.when(ok, F.col("pos")))
    has_range = F.col("low").isNotNull() | F.col("high").isNotNull()
    g = j.groupBy("symbol").agg(
        best.alias("b"), F.max("resolved").alias("resolved"), F.max("candidates").alias("types"), F.count_distinct(N.name(F.col("kind"))).alias("kinds"), first(N.name(F.col("unit")), filled(F.col("unit")).isNotNull()).alias("unit"),
        first("default", F.col("default").isNotNull()).alias("default"), first(F.struct("low", "high"), has_range).alias("r"), F.max(N.name(F.col("kind")) == "list").alias("many"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("values", F.array().cast("array<string>")))))).alias("values"), F.count_distinct("rule_id").alias("rules"),
    ).join(reads.select(N.name(F.col("symbol")).alias("symbol"), F.lit(True).alias("read")).distinct(), "symbol", "left")
    name, required = N.camel(F.col("symbol")), F.col("read").isNotNull()
    number = lambda c: F.format_string("%.2f", c)
    bounds = F.concat_ws(" and ", F.when(F.col("r.low").isNotNull(), F.concat(name, F.lit(" >= "), number(F.col("r.low")))), F.when(F.col("r.high").isNotNull(), F.concat(name, F.lit(" <= "), number(F.col("r.high")))))
    conflict = F.when((F.col("types") > 1) & F.col("resolved").isNull(), "contradiction").when(F.col("types") > 1, "refinement").when(F.col("kinds") > 1, "declared_type")
    return g.select(
        "symbol", name.alias("name"), F.col("b.type").alias("type"), F.col("b.basis").alias("basis"), F.coalesce("unit", F.lit("")).alias("unit"), F.when(F.col("many"), "0..*").when(required, "1").otherwise("0..1").alias("multiplicity"),
        required.alias("required"), "default", "values", bounds.alias("range"), conflict.alias("conflict"), (F.col("b.needs_review") | (F.col("types") > 1)).alias("needs_review"), "rules",
    )


def relationships(facts: DataFrame, classes: DataFrame) -> DataFrame:
    """Distinct (source, target, verb) of fact types (subject, verb, object) whose ends are two different classes (concept_id, class); all need review, for facts state no multiplicity."""
    c = classes.select(N.name(F.col("concept_id")).alias("_c"), "class")
    x = facts.withColumns({"_s": N.name(F.col("subject")), "_o": N.name(F.col("object"))})
    x = x.join(c.toDF("_s", "source"), "_s").join(c.toDF("_o", "target"), "_o").where("source <> target")
    return x.select("source", "target", F.coalesce(filled(F.col("verb")), F.lit("relates to")).alias("verb")).distinct().withColumn("needs_review", F.lit(True))


def assembled(concepts: DataFrame, entities: DataFrame, owned: DataFrame) -> DataFrame:
    """Classes (concept_id, class, definition, kind, attributes, needs_review): concepts, and entities that are none of them, of a kind that may be a class, with an attribute at least (owned: symbol, owner)."""
    c = concepts.select(N.name(F.col("concept_id")).alias("k"), "concept_id", "definition", "kind")
    e = entities.select(N.name(F.col("concept_id")).alias("k"), "concept_id", "definition", "kind").join(c.select("k"), "k", "left_anti")
    kind = F.coalesce(N.name(F.col("kind")), F.lit(""))
    every = c.unionByName(e).where((kind == "") | kind.isin(*CLASS_KINDS))
    n = owned.where("owner is not null").groupBy(N.name(F.col("owner")).alias("k")).agg(F.count_distinct("symbol").alias("attributes"))
    return every.join(n, "k").select("concept_id", N.pascal(F.col("concept_id")).alias("class"), F.coalesce("definition", F.lit("")).alias("definition"), kind.alias("kind"), "attributes", filled(F.col("definition")).isNull().alias("needs_review"))


def model_findings(concepts: DataFrame, classes: DataFrame, members: DataFrame, relations: DataFrame, enums: DataFrame, declared: DataFrame) -> DataFrame:
    """(check, severity, subject): what the ten checks find; nothing is mended.

    concepts (concept_id, kind), classes (concept_id, class), members: attributes with their class or null (class, symbol, name, type, basis, n_values, constrained, conflict, needs_review),
    relations (source, target, needs_review), enums (enumeration, n), declared (symbol).
    """
    say = lambda df, check, severity, subject: df.select(F.lit(check).alias("check"), (severity if isinstance(severity, Column) else F.lit(severity)).alias("severity"), (F.col(subject) if isinstance(subject, str) else subject).alias("subject"))
    m, placed = members, members.where("class is not null")
    by = placed.groupBy("class").agg(F.count("*").alias("n"), F.count_if(F.col("type") == "Boolean").alias("flags"))
    full = F.concat("class", F.lit("."), "name")
    whole = F.lit("model")
    some = placed.agg(F.count("*").alias("n"), F.count_if("constrained").alias("c"))
    known = concepts.where(N.name(F.col("kind")).isin(*CLASS_KINDS)).withColumn("k", N.name(F.col("concept_id")))
    lost = declared.select(N.name(F.col("symbol")).alias("symbol")).distinct().join(m.select("symbol"), "symbol", "left_anti").agg(F.count("*").alias("n")).where("n > 0")
    held = m.where("class is null").agg(F.count("*").alias("n")).where("n > 0")
    found = [
        say(known.join(classes.select(N.name(F.col("concept_id")).alias("k")), "k", "left_anti"), "concept_representation", "review", "concept_id"),
        say(classes.join(by, "class", "left_anti"), "attribute_presence", "error", "class"), say(by.where("n > 3 and flags = n"), "attribute_presence", "review", "class"),
        say(placed.where("basis in ('fallback', 'heuristic')"), "type_defensibility", "review", full),
        say(m.where("conflict is not null"), "type_consistency", F.when(F.col("conflict") == "contradiction", "error").otherwise("review"), "symbol"),
        say(relations.where("needs_review"), "relationship_direction_and_multiplicity", "review", F.concat("source", F.lit(" -> "), "target")),
        say(placed.where((F.col("n_values") > 0) & F.col("type").isin(*PLAIN)), "enumeration_usage", "error", full),
        say(some.where("n > 0 and c = 0"), "constraint_coverage", "error", whole),
        say(enums.where("n < 2"), "no_superfluous_elements", "review", "enumeration"), say(by.where("n = 1 and flags = 1"), "no_superfluous_elements", "review", "class"),
        say(lost, "source_consistency", "error", whole), say(held, "source_consistency", "review", whole),
        say(m.where("class is null and needs_review"), "ambiguity_flagged", "review", "name"),
    ]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def accepted_proposals(proposals: DataFrame, unassigned: DataFrame, classes: DataFrame) -> DataFrame:
    """proposals (pos, symbol, owner, new_class, value_object, confidence) with outcome; of a symbol the first that places it counts.

    accepted: an owner that is a class, or a new class with three attributes, two of them no flags.  flag_class, too_few,
    unknown_symbol, unknown_class, bad_shape, unclear: why not.  value_object: one of two or more of a new value object.
    """
    p = proposals.withColumns({"symbol": N.name(F.col("symbol")), "sure": F.coalesce(N.name(F.col("confidence")), F.lit("")), "new": filled(N.pascal(F.col("new_class"))), "vo": filled(N.pascal(F.col("value_object"))), "owner": filled(F.col("owner"))})
    u = unassigned.select(N.name(F.col("symbol")).alias("symbol"), "type").dropDuplicates(["symbol"])
    c = classes.select(F.col("class").alias("owner"), F.lit(True).alias("is_class")).distinct()
    x = p.join(u, "symbol", "left").join(c, "owner", "left").join(c.select(F.col("owner").alias("new"), F.col("is_class").alias("taken")), "new", "left").join(c.select(F.col("owner").alias("vo"), F.col("is_class").alias("vo_taken")), "vo", "left")
    clear = F.col("type").isNotNull() & F.col("sure").isin(*SURE) & (F.col("sure") != "unclear")
    to = F.when(clear & F.col("is_class").isNotNull(), "owner").when(clear & F.col("new").isNotNull(), "new")
    first = x.where(to.isNotNull()).groupBy("symbol").agg(F.min("pos").alias("first"))
    x = x.withColumn("to", to).join(first, "symbol", "left").withColumn("late", F.col("first").isNotNull() & (F.col("pos") > F.col("first")))
    news = x.where("to = 'new' and not late").groupBy("new").agg(F.count("*").alias("n"), F.count_if(F.col("type") != "Boolean").alias("real"))
    vos = x.where(clear & F.col("vo").isNotNull() & ~F.col("late")).groupBy("vo").agg(F.count("*").alias("parts"))
    x = x.join(news, "new", "left").join(vos, "vo", "left")
    outcome = (
        F.when(F.col("type").isNull() | F.col("late"), "unknown_symbol").when(~F.col("sure").isin(*SURE), "bad_shape").when(F.col("sure") == "unclear", "unclear").when(F.col("vo").isNotNull() & (F.col("parts") >= 2) & F.col("vo_taken").isNull(), "value_object")
        .when(F.col("to") == "owner", "accepted").when((F.col("to") == "new") & (F.col("n") >= 3) & (F.col("real") >= 2) & F.col("taken").isNull(), "accepted").when((F.col("to") == "new") & (F.col("n") >= 3) & (F.col("real") < 2), "flag_class")
        .when(F.col("to") == "new", "too_few").when(F.col("owner").isNotNull(), "unknown_class").otherwise("unclear")
    )
    return x.select("pos", "symbol", outcome.alias("outcome"))


def catalog_rows(members: DataFrame) -> DataFrame:
    """The attribute catalog: class, attribute, business type and the Spark type it is stored as."""
    t = F.col("type")
    stored = F.when(t.isin("Money", "Percentage", "Decimal", "Quantity", "Duration"), "decimal(38,10)").when(t == "Integer", "bigint").when(t == "Boolean", "boolean").when(t == "Date", "date").when(t == "DateTime", "timestamp").otherwise("string")
    return members.where("class is not null").select("class", F.col("name").alias("attribute"), "type", stored.alias("stored_as"))
