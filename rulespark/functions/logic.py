"""Rule formulas compiled to Columns.

A formula is a nested dict: {"op": "and" | "or", "args": [..]}, {"op": "not",
"arg": f}, {"op": "eq" | "ne" | "lt" | "le" | "gt" | "ge" | "contains" |
"in_binned_range", "left": operand, "right": operand}, {"op": "is_null", "arg":
operand}.  An operand is {"symbol": name} or {"literal": value, "type": theory}.

SQL's null logic is Kleene's three-valued logic, so an unknown fact makes a
formula unknown exactly where it must.  What cannot be compiled is refused with
a reason before any data is read.
"""

from __future__ import annotations

import ast
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

THEORIES = {"bool": "boolean", "int": "bigint", "real": "double", "enum": "string", "string": "string"}
COMPARE = {"eq": "=", "ne": "<>", "lt": "<", "le": "<=", "gt": ">", "ge": ">="}


class Refused(ValueError):
    """A formula or expression that has no meaning here: code and reason."""

    def __init__(self, code: str, reason: str):
        super().__init__(f"{code}: {reason}")
        self.code, self.reason = code, reason


@dataclass(frozen=True)
class Signature:
    """Theory of each symbol."""

    symbols: dict[str, str]

    def theory(self, x: dict) -> str:
        if "symbol" in x:
            if x["symbol"] not in self.symbols:
                return "missing"
            return self.symbols[x["symbol"]]
        if x.get("type") not in THEORIES:
            raise Refused("UNSUPPORTED_VALUE_TYPE", str(x.get("type")))
        return x["type"]

    def operand(self, x: dict) -> Column:
        """A missing symbol is unknown; NaN is unknown."""
        kind = self.theory(x)
        if kind == "missing":
            return F.lit(None)
        if "symbol" in x:
            c = F.col(x["symbol"]).cast(THEORIES[kind])
            return F.when(~F.isnan(c), c) if kind == "real" else c
        v = x["literal"]
        ok = {"bool": bool, "int": int, "real": (int, float), "enum": str, "string": str}[kind]
        if v is not None and (not isinstance(v, ok) or (kind in ("int", "real") and isinstance(v, bool))):
            raise Refused("TYPE_MISMATCH", f"{v!r} is no {kind}")
        return F.lit(v).cast(THEORIES[kind])

    def compile(self, f: dict) -> Column:
        op = f.get("op")
        if op in ("and", "or"):
            if not f.get("args"):
                raise Refused("EMPTY_LOGIC", op)
            parts = [self.compile(a) for a in f["args"]]
            out = parts[0]
            for p in parts[1:]:
                out = out & p if op == "and" else out | p
            return out
        if op == "not":
            return ~self.compile(f["arg"])
        if op == "is_null":
            return self.operand(f["arg"]).isNull()
        if op == "constant":
            return F.lit(bool(f["value"]))
        left, right = f.get("left"), f.get("right")
        if op == "in_binned_range":
            m = re.fullmatch(r"\s*([\[(])\s*(-?[\d.]+)?\s*,\s*(-?[\d.]+)?\s*([\])])\s*", str(right.get("literal")))
            if not m:
                return F.lit(None).cast("boolean")
            c, out = self.operand(left), F.lit(True)
            if m[2]:
                out = out & (c >= float(m[2]) if m[1] == "[" else c > float(m[2]))
            if m[3]:
                out = out & (c <= float(m[3]) if m[4] == "]" else c < float(m[3]))
            return F.when(c.isNotNull(), out)
        a, b = self.theory(left), self.theory(right)
        if "missing" in (a, b):
            return F.lit(None).cast("boolean")
        numeric, text = {"int", "real"}, {"enum", "string"}
        if a != b and not {a, b} <= numeric and not {a, b} <= text:
            raise Refused("TYPE_MISMATCH", f"{a} {op} {b}")
        x, y = self.operand(left), self.operand(right)
        if op == "contains":
            return F.contains(x, y)
        if op not in COMPARE:
            raise Refused("UNSUPPORTED_OPERATOR", str(op))
        return {"eq": x == y, "ne": x != y, "lt": x < y, "le": x <= y, "gt": x > y, "ge": x >= y}[op]


def _cmp(op):
    return lambda name, value, kind: {"op": op, "left": {"symbol": name}, "right": {"literal": value, "type": kind}}


eq, ne, lt, le, gt, ge, contains = (_cmp(op) for op in ("eq", "ne", "lt", "le", "gt", "ge", "contains"))


def all_of(*fs: dict) -> dict:
    return {"op": "and", "args": list(fs)}


def any_of(*fs: dict) -> dict:
    return {"op": "or", "args": list(fs)}


def negate(f: dict) -> dict:
    return {"op": "not", "arg": f}


def kleene_all(c: Column) -> Column:
    """Aggregate: false if any is false, true if all are true, else unknown."""
    return F.when(F.max(F.when(c == F.lit(False), True)), False).when(F.count(c) == F.count("*"), True)


def kleene_any(c: Column) -> Column:
    return F.when(F.max(F.when(c, True)), True).when(F.count(c) == F.count("*"), False)


#: Phrases of rule prose and the functions they stand for; functions of the arithmetic language.
PROSE = [(r"\blesser of\b|\bsmaller of\b", "min"), (r"\bgreater of\b|\blarger of\b", "max"), (r"\bmultiplied by\b|\btimes\b", "*"), (r"\bdivided by\b", "/"), (r"\bplus\b", "+"), (r"\bminus\b", "-")]
FUNCTIONS = {"abs", "ceil", "ceiling", "floor", "max", "min", "sum"}


def arithmetic(text: str, columns: set[str]) -> Column:
    """An arithmetic expression over columns; null where it has no finite value."""
    for pattern, to in PROSE:
        text = re.sub(pattern, to, text, flags=re.IGNORECASE)
    text = re.sub(r"(?<=\d)%|(?<=\d),(?=\d{3})|\$", "", text)
    try:
        tree = ast.parse(text.strip(), mode="eval").body
    except SyntaxError as e:
        raise Refused("NOT_AN_EXPRESSION", text) from e

    def go(n: ast.expr) -> Column:
        if isinstance(n, ast.Constant) and isinstance(n.value, (int, float)) and not isinstance(n.value, bool):
            return F.lit(float(n.value))
        if isinstance(n, ast.Name):
            if n.id not in columns:
                raise Refused("UNKNOWN_NAME", n.id)
            return F.col(n.id).cast("double")
        if isinstance(n, ast.UnaryOp) and isinstance(n.op, (ast.UAdd, ast.USub)):
            return -go(n.operand) if isinstance(n.op, ast.USub) else go(n.operand)
        if isinstance(n, ast.BinOp):
            a, b = go(n.left), go(n.right)
            if isinstance(n.op, ast.Add):
                return a + b
            if isinstance(n.op, ast.Sub):
                return a - b
            if isinstance(n.op, ast.Mult):
                return a * b
            if isinstance(n.op, ast.Div):
                return F.try_divide(a, b)
            if isinstance(n.op, ast.Mod):
                return F.when(b != 0, a - b * F.floor(F.try_divide(a, b)))
            if isinstance(n.op, ast.Pow):
                return F.pow(a, b)
        if isinstance(n, ast.Call) and isinstance(n.func, ast.Name) and n.func.id in FUNCTIONS and not n.keywords:
            args = [go(a) for a in n.args]
            known = args[0].isNotNull()
            for a in args[1:]:
                known = known & a.isNotNull()
            if n.func.id in ("max", "min") and len(args) > 1:
                return F.when(known, (F.greatest if n.func.id == "max" else F.least)(*args))
            if n.func.id == "sum":
                return sum(args[1:], args[0])
            if len(args) == 1:
                return {"abs": F.abs, "ceil": F.ceil, "ceiling": F.ceil, "floor": F.floor, "max": lambda x: x, "min": lambda x: x}[n.func.id](args[0]).cast("double")
        raise Refused("UNSUPPORTED_EXPRESSION", ast.dump(n)[:60])

    out = go(tree)
    return F.when(~F.isnan(out) & (F.abs(out) < float("inf")), out)


def feel_literal(value: Column, kind: Column) -> Column:
    """A literal as the decision language writes it."""
    return F.when(value.isNull(), "null").when(kind.isin("number", "boolean"), value).when(kind == "date", F.concat(F.lit('date("'), value, F.lit('")'))).when(kind == "date_time", F.concat(F.lit('date and time("'), value, F.lit('")'))).otherwise(F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('\\"')), F.lit('"')))


def unary_test(op: Column, value: Column, kind: Column) -> Column:
    """A predicate as a cell of a decision table; what has no form there is false."""
    v = feel_literal(value, kind)
    return F.coalesce(
        F.when(op.isin("==", "="), v).when(op.isin("!=", "<>"), F.concat(F.lit("!= "), v)).when(op.isin("<", "<=", ">", ">="), F.concat(op, F.lit(" "), v))
        .when(op == "in", F.concat(F.lit("["), v, F.lit("]"))).when(op == "not_in", F.concat(F.lit("not(["), v, F.lit("])"))).when(op == "contains", F.concat(F.lit("contains(?, "), v, F.lit(")"))),
        F.lit("false"),
    )


