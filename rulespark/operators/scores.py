"""Scores and summaries of extracted rules, catalogs, compilations and answers; samples and batches."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import normalize as N
from .graph import components
from .measures import running
from .repair import filled

#: What a rule's and a dependency's confidence are made of.
RULE_WEIGHTS = {"extraction_clarity": 0.3, "numeric_precision": 0.25, "context_completeness": 0.2, "source_authority": 0.15, "logical_consistency": 0.1}
DEPENDENCY_WEIGHTS = {"semantic_similarity": 0.25, "logical_connection": 0.30, "temporal_ordering": 0.20, "cross_reference": 0.15, "domain_relevance": 0.10}
LEAST_CONFIDENCE = 70.0


def part(c: Column, key: str) -> Column:
    return F.try_element_at(c, F.lit(key))


def catalog_quality(entities: DataFrame, relationships: DataFrame) -> DataFrame:
    """entity_score, relationship_score, overall: shares in percent of definitions that are whole; without relationships entities alone count.

    entities (definition, concept_kind, n_attributes, n_evidence); relationships (source_entity, target_entity, definition, n_evidence).
    """
    has = lambda *c: [filled(F.col(x)).isNotNull() for x in c]
    every = lambda parts: F.avg(F.when(F.array_min(F.array(*[p.cast("int") for p in parts])) == 1, 100.0).otherwise(0.0))
    e = entities.agg(F.coalesce(F.round(every([*has("definition", "concept_kind"), F.col("n_attributes") == 5, F.col("n_evidence") > 0]), 1), F.lit(0.0)).alias("entity_score"))
    r = relationships.agg(F.round(every([*has("source_entity", "target_entity", "definition"), F.col("n_evidence") > 0]), 1).alias("relationship_score"))
    return e.crossJoin(r).select("entity_score", "relationship_score", F.round((F.col("entity_score") + F.coalesce("relationship_score", F.lit(0.0))) / F.when(F.col("relationship_score").isNull(), 1).otherwise(2), 1).alias("overall"))


def rule_confidence(breakdown: Column, reported: Column, weights: dict[str, float] = RULE_WEIGHTS, least: float = LEAST_CONFIDENCE) -> Column:
    """struct(score, source, requires_review) from a map of parts, else the reported score, else not scored."""
    made = sum((F.coalesce(part(breakdown, k), F.lit(0.0)) * w for k, w in weights.items()), F.lit(0.0))
    s = lambda score, source, review: F.struct(score.cast("double").alias("score"), F.lit(source).alias("source"), review.alias("requires_review"))
    return F.when(breakdown.isNotNull(), s(F.round(made, 2), "derived_from_breakdown", made < least)).when(reported.isNotNull(), s(reported, "model_reported", F.lit(False))).otherwise(s(F.lit(None), "not_scored", F.lit(False)))


def dependency_confidence(breakdown: Column, weights: dict[str, float] = DEPENDENCY_WEIGHTS) -> Column:
    """Weighted mean of the known parts that are there, else the plain mean of what is, else 50."""
    top = sum((F.coalesce(part(breakdown, k) * w, F.lit(0.0)) for k, w in weights.items()), F.lit(0.0))
    low = sum((F.when(part(breakdown, k).isNotNull(), w).otherwise(0.0) for k, w in weights.items()), F.lit(0.0))
    rest = F.map_values(breakdown)
    mean = F.aggregate(rest, F.lit(0.0), lambda a, x: a + x) / F.size(rest)
    return F.when(low > 0, F.round(top / low, 2)).when(F.size(rest) > 0, F.round(mean, 2)).otherwise(50.0)


def confidence_scale(*scores: Column) -> Column:
    """The first score there is, on 0 to 100: what lies in 0 to 1 is a share."""
    s = F.coalesce(*scores)
    return F.when(s.between(0, 1), s * 100).otherwise(s)


def validation_summary(rules: DataFrame) -> DataFrame:
    """rules (outcome: passed | warning | failure, confidence) -> counts, scored and unscored rules, mean confidence of the scored ones."""
    o = F.col("outcome")
    return rules.agg(
        F.count_if(o == "passed").alias("passed"), F.count_if(o == "warning").alias("warnings"), F.count_if(o == "failure").alias("failures"), F.count("confidence").alias("scored"),
        (F.count("*") - F.count("confidence")).alias("unscored"), F.round(F.avg("confidence"), 4).alias("avg_confidence"),
    )


def confidence_findings(rules: DataFrame, least: float = LEAST_CONFIDENCE) -> DataFrame:
    """(rule_id, severity): high below the least confidence, medium where there is none."""
    c = F.col("confidence")
    return rules.select("rule_id", F.when(c.isNull(), "medium").when(c < least, "high").alias("severity")).where("severity is not null")


def missing_fields(required: list[str]) -> Column:
    """The required columns that are null or empty text, in order."""
    return F.array_compact(F.array(*[F.when(filled(F.col(c).cast("string")).isNull(), F.lit(c)) for c in required]))


def grounding_report(claims: DataFrame) -> DataFrame:
    """claims (rule_id, verdict) -> rules, certified, failed, held rules and rates: a contradiction fails a rule, a gap holds it."""
    v = F.col("verdict")
    r = claims.groupBy("rule_id").agg(F.max(v == "contradicted").alias("bad"), F.max(v == "insufficient_evidence").alias("open"), F.count("*").alias("n"), F.count_if(v == "supported").alias("ok"))
    n = F.count("*")
    return r.agg(
        n.alias("rules"), F.sum("n").alias("claims"), F.sum("ok").alias("supported"), F.count_if(~F.col("bad") & ~F.col("open")).alias("certified"), F.count_if("bad").alias("failed"), F.count_if(F.col("open") & ~F.col("bad")).alias("held"),
        F.round(F.count_if(F.col("open") | F.col("bad")) / n * 100, 2).alias("hold_rate"),
    )


def compile_ladder(rules: DataFrame) -> DataFrame:
    """rules (stage, compiled, code) -> for each stage: total, compiled, percent, and the refusals by code as text."""
    t = rules.groupBy("stage").agg(F.count("*").alias("total"), F.count_if("compiled").alias("compiled"))
    by = rules.where(~F.col("compiled")).groupBy("stage", "code").agg(F.count("*").alias("n"))
    codes = by.groupBy("stage").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("code", "n"))), lambda x: F.concat(x["code"], F.lit("="), x["n"].cast("string"))), ",").alias("refusals"))
    return t.join(codes, "stage", "left").select("stage", "total", "compiled", F.round(F.col("compiled") / F.col("total") * 100, 1).alias("percent"), F.coalesce("refusals", F.lit("")).alias("refusals"))


def section_buckets(rules: DataFrame, cases: DataFrame) -> DataFrame:
    """cases (case_id, section) with bucket: covered if some rule (section, compiled) of the section compiled, refused if none did, else no_rule."""
    b = rules.groupBy("section").agg(F.max("compiled").alias("_c"))
    return cases.join(b, "section", "left").withColumn("bucket", F.when(F.col("_c"), "covered").when(~F.col("_c"), "refused").otherwise("no_rule")).drop("_c")


def agreement(cases: DataFrame) -> DataFrame:
    """cases (bucket, answer, label) -> answered cases, right ones and their share in percent of each bucket."""
    right = F.count_if(F.col("answer") == F.col("label"))
    return cases.groupBy("bucket").agg(F.count("answer").alias("answered"), right.alias("right"), F.round(right / F.nullif(F.count("answer"), F.lit(0)) * 100, 2).alias("percent"))


def parse_answer(reply: Column) -> Column:
    """struct(answer, confidence) out of a reply: the JSON object in it, an answer of 0 or 1, a confidence held within 0 and 100."""
    body = F.regexp_extract(reply, r"(?s)\{.*\}", 0)
    a, c = F.trim(F.get_json_object(body, "$.answer")), F.get_json_object(body, "$.confidence").try_cast("double")
    return F.struct(F.when(a.isin("0", "1"), a.cast("int")).alias("answer"), F.when(c.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(100.0), c))).alias("confidence"))


def duration_text(seconds: Column) -> Column:
    s = F.greatest(seconds, F.lit(0.0))
    whole = F.bround(s).cast("long")
    minutes = F.floor(whole / 60)
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return (
        F.when(seconds.isNull(), "--").when(s < 60, F.concat(F.format_string("%.1f", s), F.lit("s"))).when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m "), two(whole % 60), F.lit("s")))
        .otherwise(F.concat(F.floor(minutes / 60).cast("string"), F.lit("h "), two(minutes % 60), F.lit("m")))
    )


def cost_text(usd: Column) -> Column:
    return F.when(usd <= 0, "$0.00").when(usd < 0.01, F.concat(F.lit("$"), F.format_string("%.4f", usd))).otherwise(F.concat(F.lit("$"), F.format_string("%.2f", usd)))


def token_text(n: Column) -> Column:
    return F.when(n < 1000, n.cast("string")).when(n < 1_000_000, F.concat(F.format_string("%.1f", n / 1000), F.lit("k"))).otherwise(F.concat(F.format_string("%.2f", n / 1_000_000), F.lit("M")))


def decision_variables(variables: DataFrame) -> DataFrame:
    """variables (rule_id, name, type, role) -> one row a name: types, roles, number of rules, reusable or rule_local."""
    texts = lambda c: F.array_join(F.array_sort(F.collect_set(filled(F.col(c)))), ",")
    g = variables.where(filled(F.col("name")).isNotNull()).groupBy(F.trim("name").alias("variable_id")).agg(texts("type").alias("types"), texts("role").alias("roles"), F.count_distinct("rule_id").alias("rules"))
    return g.withColumn("scope", F.when(F.col("rules") > 1, "reusable").otherwise("rule_local"))


def merge_statistics(rules: DataFrame, entity: str, kind: str) -> DataFrame:
    """(by, value, n): rules counted by entity and by type."""
    one = rules.select(F.explode(F.array(F.struct(F.lit("entity").alias("by"), F.coalesce(F.col(entity), F.lit("unknown")).alias("value")), F.struct(F.lit("type").alias("by"), F.coalesce(F.col(kind), F.lit("unknown")).alias("value")))).alias("x"))
    return one.groupBy("x.by", "x.value").agg(F.count("*").alias("n"))


def catalog_union(definitions: DataFrame, scalars: list[str], lists: list[str]) -> DataFrame:
    """definitions (pos, name, ..): names that are alike but for case and marks are one; the first name, the first filled scalars, all list items in order of entry."""
    key = F.regexp_replace(F.upper("name"), "[^A-Z0-9]", "")
    first = lambda c: F.min_by(filled(F.col(c)), F.when(filled(F.col(c)).isNotNull(), F.col("pos"))).alias(c)
    whole = lambda c: F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.col(c).alias("v")))), lambda x: x["v"]))).alias(c)
    return definitions.groupBy(key.alias("key")).agg(F.min_by("name", "pos").alias("name"), *map(first, scalars), *map(whole, lists))


def concept_union(concepts: DataFrame, fact_types: DataFrame) -> DataFrame:
    """Vocabulary concepts (pos, concept_id, definition, kind) and the ends of fact types (pos, subject, object): first definition and first kind that is not unresolved win."""
    ends = fact_types.select((F.col("pos") + 2**40).alias("pos"), F.explode(F.array("subject", "object")).alias("concept_id")).select("pos", "concept_id", F.lit(None).cast("string").alias("definition"), F.lit("business_object").alias("kind"))
    x = concepts.select("pos", "concept_id", "definition", "kind").unionByName(ends).withColumn("concept_id", filled(F.col("concept_id"))).where("concept_id is not null")
    real = F.when(F.col("kind") != "unresolved", F.col("kind"))
    return x.groupBy("concept_id").agg(F.min_by(filled(F.col("definition")), F.when(filled(F.col("definition")).isNotNull(), F.col("pos"))).alias("definition"), F.coalesce(F.min_by(real, F.when(real.isNotNull(), F.col("pos"))), F.lit("unresolved")).alias("kind"))


def merge_batches(rules: DataFrame) -> DataFrame:
    """rules (bucket, batch, pos, rule_id, rule_name) that stay: of each batch those whose id and name, but for case, no earlier batch of the bucket kept."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        ids, names, kept = set(), set(), []
        for _, g in rows.sort_values(["batch", "pos"]).groupby("batch", sort=True):
            low = g["rule_name"].fillna("").str.lower()
            new = g[~g["rule_id"].isin(ids) & ~low.isin(names)]
            kept.append(new)
            ids |= set(new["rule_id"])
            names |= set(low[new.index])
        return pd.concat(kept)

    return rules.groupBy("bucket").applyInPandas(fold, rules.schema)


def spaced_sample(documents: DataFrame, order: str, path: str, most: int = 6, offset: int = 0) -> DataFrame:
    """`most` documents at even distances in order, in one of three phases; tables of contents only if there is nothing else."""
    low = F.lower(path)
    real = documents.where(~low.contains("table_of_contents"))
    some = real if real.limit(1).count() else documents
    x = running(some, [order], [])
    n = some.count()
    if n <= most:
        return some
    phases = max(1, 3 * (most - 1))
    at = [min(n - 1, round((k * 3 + offset % 3) * (n - 1) / phases)) + 1 for k in range(most)]
    return x.where(F.col("place").isin(at)).drop("place")


def claim_fragments(claims: DataFrame, most: int) -> DataFrame:
    """claims (rule_id, pos) with fragment: runs of `most` claims of a rule."""
    return claims.withColumn("fragment", F.floor((F.row_number().over(W.partitionBy("rule_id").orderBy("pos")) - 1) / most))


def pack_fragments(fragments: DataFrame, most_rules: int, most_claims: int, most_chars: int) -> DataFrame:
    """fragments (run, pos, claims, chars) with batch: in order, a batch is full before any of the three limits is passed."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        out, batch, n, claims, chars = [], 0, 0, 0, 0
        for c, s in zip(rows["claims"], rows["chars"], strict=True):
            if n and (n >= most_rules or claims + c > most_claims or chars + s > most_chars):
                batch, n, claims, chars = batch + 1, 0, 0, 0
            out.append(batch)
            n, claims, chars = n + 1, claims + c, chars + s
        return rows.assign(batch=out)

    return fragments.groupBy("run").applyInPandas(fold, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in fragments.schema)}, batch long")


def conflict_batches(outcomes: DataFrame, most: int) -> DataFrame:
    """(component, batch, rule_id): rules (rule_id, variable) that hang together by outputs, two at least, in runs of `most` in order of id."""
    o = outcomes.select("rule_id", "variable").distinct()
    links = o.withColumn("next", F.lead("rule_id").over(W.partitionBy("variable").orderBy("rule_id"))).where("next is not null").select(F.col("rule_id").alias("source"), F.col("next").alias("target"))
    c = components(links, o.select(F.col("rule_id").alias("node")).distinct())
    w = W.partitionBy("component")
    x = c.withColumns({"n": F.count("*").over(w), "k": F.row_number().over(w.orderBy("node"))}).where("n > 1")
    return x.select("component", F.floor((F.col("k") - 1) / max(2, most)).alias("batch"), F.col("node").alias("rule_id"))


def merge_unique(*lists: Column) -> Column:
    """All items in order of entry, each once."""
    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(*[F.coalesce(x, none) for x in lists]))


def top_concepts(concepts: DataFrame, most: int = 8) -> DataFrame:
    """The concepts (term, rule_links, fact_links) with most links."""
    return concepts.orderBy(F.desc("rule_links"), F.desc("fact_links"), F.lower("term"), "term").limit(most)


def fisher_exact(a: int, b: int, c: int, d: int, block: int = 1 << 12) -> float:
    """Two-sided exact p of a 2 x 2 table: all tables with the same margins that are no likelier than it.

    Likelihoods relative to the likeliest table, by their ratios from one table to the next, up to where they are zero
    as doubles: some 40 standard deviations each way, so the work grows with the root of the counts.
    """
    n, row, col = a + b + c + d, a + b, a + c
    least, most = max(0, col - (n - row)), min(row, col)
    mode = min(most, max(least, (row + 1) * (col + 1) // (n + 2)))

    def walk(step: int) -> Iterator[tuple[int, np.ndarray]]:
        """(first x, likelihoods of x, x + step, ...) from the table beside the mode outwards."""
        x, last, end = mode, 1.0, most if step > 0 else least
        while x != end and last > 0:
            k = x + step * np.arange(min(block, abs(end - x)), dtype=np.float64)
            ratio = (row - k) / (k + 1) * ((col - k) / (n - row - col + k + 1)) if step > 0 else k / (row - k + 1) * ((n - row - col + k) / (col - k + 1))
            p = last * np.cumprod(ratio)
            yield x + step, p
            x, last = x + step * len(p), p[-1]

    seen = float(a == mode)
    for x, p in walk(1 if a > mode else -1):
        if 0 <= (a - x) * (1 if a > mode else -1) < len(p):
            seen = float(p[abs(a - x)])
            break
    total, tail = [1.0], [float(seen * (1 + 1e-9) >= 1)]
    for step in (1, -1):
        for _, p in walk(step):
            total.append(float(p.sum()))
            tail.append(float(p[p <= seen * (1 + 1e-9)].sum()))
    return min(1.0, math.fsum(tail) / math.fsum(total))


def fisher(tables: DataFrame, a: str, b: str, c: str, d: str) -> DataFrame:
    """tables with p_value."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            yield t.assign(p_value=[fisher_exact(*map(int, r)) for r in zip(t[a], t[b], t[c], t[d], strict=True)])

    return tables.mapInPandas(run, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in tables.schema)}, p_value double")
