"""The information model: types of variables, enumerations, owners, conflicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import normalize as N

#: Units and the types they make; endings of names that suggest a type, in order; which type refines which.
UNITS = {
    **dict.fromkeys(("usd", "eur", "gbp", "currency", "dollars", "usd_per_month"), "Money"),
    **dict.fromkeys(("percent", "%", "percentage", "ratio", "basis_points", "bps"), "Percentage"),
    **dict.fromkeys(("days", "business_days", "months", "years", "weeks", "hours"), "Duration"),
    **dict.fromkeys(("count", "units", "loans"), "Integer"),
}
NAMES = [
    ("_(id|identifier|number)$", "Identifier"),
    ("_(amount|balance|price|cost|fee|payment|proceeds|income)$", "Money"),
    ("_(ratio|rate|percent|percentage|ltv|cltv|hcltv|dti)$", "Percentage"),
    ("_(days|months|years|weeks|hours|period|term)$", "Duration"),
    ("_(count|units|number_of_[a-z_]+)$", "Integer"),
    ("_date$", "Date"),
    ("_(timestamp|datetime)$", "DateTime"),
]
REFINES = [("Text", "String"), ("Identifier", "String"), ("Identifier", "Text"), *((t, "Decimal") for t in ("Money", "Percentage", "Duration", "Quantity", "Integer"))]
PLAIN = ("Text", "Identifier", "Money", "Percentage", "Duration", "Quantity", "Integer", "String", "Decimal", "Boolean", "Date", "DateTime", "Time")
DECLARED = {"boolean": "Boolean", "date": "Date", "date_time": "DateTime", "time": "Time", "duration": "Duration"}
CATEGORY = {"Identifier": "identifier", "Money": "quantity", "Percentage": "quantity", "Integer": "quantity", "Decimal": "quantity", "Quantity": "quantity", "Duration": "temporal", "Date": "temporal", "DateTime": "temporal", "Time": "temporal", "Boolean": "flag", "Enumeration": "categorical", "Text": "descriptive", "String": "descriptive"}
BASIS_RANK = {"declared": 3, "derived": 2, "heuristic": 1, "fallback": 0}


def infer_type(name: Column, kind: Column, unit: Column, n_allowed: Column, free_text: Column, integral: Column) -> Column:
    """struct(type, basis, needs_review), by the first rule that applies: values, declared types, units, ranges, names."""
    s = lambda t, b, r=False: F.struct((t if isinstance(t, Column) else F.lit(t)).alias("type"), F.lit(b).alias("basis"), (r if isinstance(r, Column) else F.lit(r)).alias("needs_review"))
    table = lambda m: F.create_map(*[F.lit(x) for kv in m.items() for x in kv])
    declared, by_unit = F.try_element_at(table(DECLARED), kind), F.try_element_at(table(UNITS), unit)
    hint = lambda kinds: F.coalesce(*[F.when(name.rlike(p), F.lit(t)) for p, t in NAMES if t in kinds])
    measure, any_ = hint(("Money", "Percentage", "Integer", "Duration")), hint([t for _, t in NAMES])
    number = F.when(F.coalesce(integral, F.lit(False)), s("Integer", "derived")).when(measure.isNotNull(), s(measure, "heuristic", True)).otherwise(s("Decimal", "derived"))
    string = F.when(F.coalesce(free_text, F.lit(False)), s("Text", "declared")).when(any_.isNotNull(), s(any_, "heuristic", True)).otherwise(s("String", "fallback", True))
    return (
        F.when(n_allowed > 0, s("Enumeration", "declared")).when(declared.isNotNull(), s(declared, "declared")).when(by_unit.isNotNull(), s(by_unit, "declared", F.contains(unit, F.lit("_per_"))))
        .when(kind == "number", number).when(kind == "list", s("String", "derived", True)).when(kind == "string", string).when(any_.isNotNull(), s(any_, "heuristic", True)).otherwise(s("String", "fallback", True))
    )


def reconcile(candidates: DataFrame, symbol: str, kind: str) -> DataFrame:
    """The one type that refines all others of a symbol; null if there is no such type."""
    spark = candidates.sparkSession
    order = F.broadcast(spark.createDataFrame(REFINES, "a string, b string"))
    c = candidates.select(symbol, F.col(kind).alias("t")).distinct()
    pairs = c.join(c.select(F.col(symbol), F.col("t").alias("u")), symbol)
    # Any type that is not in the table is an enumeration, a closed set of texts.
    closed = ~F.col("t").isin(*PLAIN) & F.col("u").isin("String", "Text")
    apart = (F.col("t") != F.col("u")) & F.col("a").isNull() & ~closed
    beats = pairs.join(order, (F.col("t") == F.col("a")) & (F.col("u") == F.col("b")), "left").groupBy(symbol, "t").agg(F.max(F.when(apart, 1).otherwise(0)).alias("open"))
    return beats.groupBy(symbol).agg(F.max(F.when(F.col("open") == 0, F.col("t"))).alias("type"), F.count("*").alias("candidates"))


def enumerations(values: DataFrame, symbol: str, value: str) -> DataFrame:
    """Symbols with the same values share an enumeration, named after the shortest of them; equal names get a number."""
    sets = values.groupBy(symbol).agg(F.array_join(F.array_sort(F.collect_set(value)), "|").alias("values"))
    named = sets.groupBy("values").agg(F.min(F.struct(F.length(symbol).alias("n"), F.col(symbol).alias("s"))).alias("b"), F.count("*").alias("members"))
    named = named.withColumn("base", N.pascal(F.col("b.s"))).withColumn("k", F.row_number().over(W.partitionBy("base").orderBy("b.s")))
    return named.select("values", F.when(F.col("k") == 1, F.col("base")).otherwise(F.concat("base", F.col("k").cast("string"))).alias("enumeration"), "members")


def retyped(attributes: DataFrame, values: DataFrame, symbol: str, value: str, kind: str) -> DataFrame:
    """attributes with their enumeration for a type where they have one."""
    sets = values.groupBy(symbol).agg(F.array_join(F.array_sort(F.collect_set(value)), "|").alias("values"))
    of = sets.join(enumerations(values, symbol, value), "values").select(symbol, "enumeration")
    return attributes.join(of, symbol, "left").withColumn(kind, F.coalesce("enumeration", kind)).drop("enumeration")


def owners(votes: DataFrame, attribute: str, owner: str, actors: DataFrame | None = None) -> DataFrame:
    """Most votes; a tie at the top leaves the attribute without an owner.  Actors (a column named like owner) own nothing."""
    w = W.partitionBy(attribute).orderBy(F.desc("votes"), owner)
    votes = votes if actors is None else votes.join(actors.select(owner).distinct(), owner, "left_anti")
    x = votes.groupBy(attribute, owner).agg(F.count("*").alias("votes")).withColumns({"r": F.row_number().over(w), "next": F.lead("votes").over(w)})
    tie = F.coalesce(F.col("next") == F.col("votes"), F.lit(False))
    return x.where("r = 1").select(attribute, F.when(~tie, F.col(owner)).alias("owner"), "votes", tie.alias("needs_review"))
