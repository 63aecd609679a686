"""Scalar normalisers: names, identifiers, keys, codes and text, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def name(c: Column) -> Column:
    return F.lower(F.trim(c))


def safe_identifier(c: Column, prefix: str = "s_") -> Column:
    """Lower case; everything but letters, digits and _ becomes _; begins with a letter."""
    s = F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9_]", "_"), "^_+|_+$", "")
    return F.when(s.rlike("^[a-z]"), s).otherwise(F.concat(F.lit(prefix), s))


def entity_key(c: Column) -> Column:
    """SCREAMING_SNAKE of any text."""
    return F.upper(entity_key_parts(c))


def entity_key_parts(c: Column) -> Column:
    """Runs of anything but letters and digits as one _, none at the ends."""
    return F.regexp_replace(F.regexp_replace(c, "[^A-Za-z0-9]+", "_"), "^_+|_+$", "")


def camel_to_key(c: Column) -> Column:
    s = F.regexp_replace(c, "(.)([A-Z][a-z]+)", "$1_$2")
    return F.upper(F.regexp_replace(s, "([a-z0-9])([A-Z])", "$1_$2"))


def pascal(c: Column) -> Column:
    """Parts in upper case are capitalised; parts in mixed case keep their tails."""
    parts = F.filter(F.split(c, "[^A-Za-z0-9]+"), lambda p: p != "")
    cap = lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.when(p == F.upper(p), F.lower(F.substring(p, 2, 2147483647))).otherwise(F.substring(p, 2, 2147483647)))
    return F.array_join(F.transform(parts, cap), "")


def camel(c: Column) -> Column:
    p = pascal(c)
    return F.concat(F.lower(F.substring(p, 1, 1)), F.substring(p, 2, 2147483647))


def xml_id(c: Column, prefix: str = "id_") -> Column:
    s = F.regexp_replace(c, "[^A-Za-z0-9_.-]", "_")
    return F.when(s.rlike("^[A-Za-z_]"), s).otherwise(F.concat(F.lit(prefix), s))


def folder(c: Column, most: int = 100) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    s = F.substring(s, 1, most)
    return F.when((s == "") | s.isNull(), "untitled").otherwise(s)


def citation_code(c: Column) -> Column:
    """The first section code such as B3-4.1 of a citation; null if none."""
    s = F.regexp_extract(F.upper(c), r"\b([A-Z][0-9]+(?:-[0-9]+)+(?:\.[0-9]+)*)\b", 1)
    return F.when(s != "", s)


def squeeze(c: Column) -> Column:
    """White space collapsed, ends trimmed."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def cased_text(c: Column) -> Column:
    """Quotes unified, soft hyphens dropped, white space collapsed."""
    return squeeze(F.translate(c, "‘’“”­", "''\"\""))


def ascii_text(c: Column) -> Column:
    """The same in lower case: text normalisation without NFKC."""
    return F.lower(cased_text(c))


def lookup(c: Column, table: dict[str, str], default: Column | None = None) -> Column:
    """A small fixed mapping; anything else keeps its value."""
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, c), c if default is None else default)


#: Predicate operators and their negations; older spellings of operators and types.
NEGATED = {"==": "!=", "!=": "==", ">": "<=", ">=": "<", "<": ">=", "<=": ">", "in": "not_in", "not_in": "in"}
OPERATOR_ALIASES = {"=": "==", "eq": "==", "equals": "==", "ne": "!=", "gt": ">", "gte": ">=", "ge": ">=", "lt": "<", "lte": "<=", "le": "<=", "not in": "not_in"}
TYPE_ALIASES = {"integer": "number", "float": "number", "decimal": "number", "bool": "boolean", "text": "string", "datetime": "date_time", "array": "list"}


def threshold_name(variable: Column, op: Column) -> Column:
    """Output names that say which bound a threshold is, unless they say so already."""
    low = F.lower(variable)
    return (
        F.when((op == "<=") & ~low.contains("max"), F.concat(F.lit("maximum_allowed_"), variable)).when((op == ">=") & ~low.contains("min"), F.concat(F.lit("minimum_required_"), variable))
        .when((F.upper(op) == "IN") & ~low.contains("allowed"), F.concat(F.lit("allowed_"), variable, F.lit("_values"))).otherwise(variable)
    )
