"""XPath 1.0 compiled to DataFrames over the node table.

``parse`` reads an expression into a small syntax tree; ``XPath.select`` and
``XPath.value`` turn it into joins, windows and aggregates:

* a step is an equi-join on the document with an interval or parent condition,
* a predicate that counts positions is a window over (context, step) ordered
  along the axis, renumbered after each predicate,
* a path inside a predicate is evaluated once for all context nodes, aggregated
  per context node and joined back (no nested loops, no per-node evaluation),
* ``//x`` is rewritten to the descendant axis where no predicate counts positions.

* following and preceding nodes are found from the nearest context alone, nodes
  below or above the contexts of a document by one sorted pass over it (no pair of
  a context and a node is compared), unless a predicate counts positions,
* node-sets compare by an equi-join on values, or by their least and greatest value.

Names, numbers of arguments and node-sets where they are needed are checked when
compiling: what doesn't fit raises ``XPathError`` there.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeline.functions import xpath as fx


XML_NS = "http://www.w3.org/XML/1998/namespace"


class XPathError(ValueError):
    """An expression that can't be parsed or bound."""


# ---- syntax -------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Step:
    axis: str
    test: tuple  # ("name", prefix, local) | ("node",) | ("text",) | ("comment",) | ("pi", target)
    predicates: tuple = ()


@dataclass(frozen=True)
class Path:
    start: object  # "root" | "context" | an expression
    steps: tuple
    predicates: tuple = ()  # of the start expression


@dataclass(frozen=True)
class Function:
    """An extension function: a function of Columns, the kinds of its arguments and of its result.

    Kinds are ``string``, ``number`` and ``boolean``; an argument of the kind ``set`` is an
    array of the strings of its nodes in document order. With ``more`` any number of
    arguments of the last kind may follow. Columns of any function will do, Arrow
    functions too.
    """

    fn: Callable[..., Column]
    args: tuple[str, ...] = ()
    kind: str = "string"
    more: bool = False


@dataclass(frozen=True)
class Limits:
    """What an expression may ask for: the nesting and the number of its operations. Beyond that it is an ``XPathError`` before anything runs."""

    depth: int = 60
    operations: int = 5_000


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple
    #: The kind of an extension function's result.
    kind: str | None = None


@dataclass(frozen=True)
class Binary:
    op: str
    left: object
    right: object


@dataclass(frozen=True)
class Literal:
    value: object


@dataclass(frozen=True)
class Variable:
    name: str


AXES = {
    "self", "child", "parent", "descendant", "descendant-or-self", "ancestor", "ancestor-or-self", "following-sibling",
    "preceding-sibling", "following", "preceding", "attribute", "namespace",
}
REVERSE = {"parent", "ancestor", "ancestor-or-self", "preceding", "preceding-sibling"}
#: Axes on which two different context nodes never meet.
DISJOINT = {"self", "child", "attribute", "namespace"}

TOKEN = re.compile(
    r"\s*(?:(?P<number>\d+(?:\.\d*)?(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)|(?P<literal>\"[^\"]*\"|'[^']*')|(?P<op>::|//|\.\.|!=|<=|>=|[()\[\].@,/|+\-=<>*$:])|(?P<name>[^\W\d][\w.\-·]*))"
)


def tokens(text: str) -> list[tuple[str, str]]:
    found, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = TOKEN.match(text, at)
        if m is None:
            raise XPathError(f"unexpected {text[at : at + 10]!r} in {text!r}")
        found.append((m.lastgroup, m.group(m.lastgroup)))
        at = m.end()
    return [*found, ("end", "")]


class Parser:
    """Recursive descent over the XPath 1.0 grammar."""

    LEVELS = (("or",), ("and",), ("=", "!="), ("<", "<=", ">", ">="), ("+", "-"), ("*", "div", "mod"))
    TYPES = {"comment", "text", "node", "processing-instruction"}

    def __init__(self, text: str, limits: Limits = Limits()):
        self.text, self.tokens, self.at, self.inside, self.limits = text, tokens(text), 0, 0, limits
        if len(self.tokens) > limits.operations:
            raise XPathError(f"more than {limits.operations} operations")

    def peek(self, ahead: int = 0) -> tuple[str, str]:
        return self.tokens[min(self.at + ahead, len(self.tokens) - 1)]

    def take(self, *values: str) -> str | None:
        kind, value = self.peek()
        if kind != "literal" and value in values:
            self.at += 1
            return value
        return None

    def need(self, value: str) -> None:
        if self.take(value) is None:
            raise XPathError(f"expected {value!r} at {self.peek()[1]!r} in {self.text!r}")

    def parse(self) -> object:
        out = self.binary(0)
        if self.peek()[0] != "end":
            raise XPathError(f"unexpected {self.peek()[1]!r} in {self.text!r}")
        layer, depth = [out], 0
        while layer := [x for e in layer for x in below(e)]:
            depth += 1
            if depth > 3 * self.limits.depth:
                raise XPathError(f"more than {3 * self.limits.depth} operations inside each other")
        return out

    def binary(self, level: int) -> object:
        if level == len(self.LEVELS):
            return self.unary()
        self.inside += level == 0
        if self.inside > self.limits.depth:
            raise XPathError(f"nested more than {self.limits.depth} deep")
        left = self.binary(level + 1)
        while op := self.take(*self.LEVELS[level]):
            left = Binary(op, left, self.binary(level + 1))
        self.inside -= level == 0
        return left

    def unary(self) -> object:
        signs = 0
        while self.take("-"):
            signs += 1
        out = self.union()
        for _ in range(signs):
            out = Call("-", (out,))
        return out

    def union(self) -> object:
        left = self.path()
        while self.take("|"):
            left = Binary("|", left, self.path())
        return left

    def path(self) -> object:
        kind, value = self.peek()
        follows = self.peek(1)[1]
        call = kind == "name" and (follows == "(" and value not in self.TYPES or follows == ":" and self.peek(3)[1] == "(")
        if kind in ("number", "literal") or value in ("(", "$") or call:
            start = self.primary()
            predicates = self.predicates()
            steps: list[Step] = []
            self.steps(steps, first=False)
            return Path(start, tuple(steps), predicates) if steps or predicates else start
        steps = []
        if value in ("/", "//"):
            if value == "/":
                self.at += 1
                if not self.begins_step():
                    return Path("root", ())
                steps.append(self.step())
            self.steps(steps, first=False)
            return Path("root", tuple(steps))
        steps.append(self.step())
        self.steps(steps, first=False)
        return Path("context", tuple(steps))

    def begins_step(self) -> bool:
        kind, value = self.peek()
        return kind == "name" or value in (".", "..", "@", "*")

    def steps(self, steps: list[Step], first: bool) -> None:
        while op := self.take("/", "//"):
            if op == "//":
                steps.append(Step("descendant-or-self", ("node",)))
            steps.append(self.step())

    def step(self) -> Step:
        if self.take("."):
            return Step("self", ("node",))
        if self.take(".."):
            return Step("parent", ("node",))
        axis = "child"
        if self.take("@"):
            axis = "attribute"
        elif self.peek()[0] == "name" and self.peek(1)[1] == "::":
            axis = self.peek()[1]
            if axis not in AXES:
                raise XPathError(f"unknown axis {axis!r}")
            self.at += 2
        return Step(axis, self.test(), self.predicates())

    def test(self) -> tuple:
        if self.take("*"):
            return ("name", None, "*")
        kind, value = self.peek()
        if kind != "name":
            raise XPathError(f"expected a node test at {value!r} in {self.text!r}")
        self.at += 1
        if value in self.TYPES and self.take("("):
            target = None
            if value == "processing-instruction" and self.peek()[0] == "literal":
                target = self.peek()[1][1:-1]
                self.at += 1
            self.need(")")
            return ("pi", target) if value == "processing-instruction" else (value,)
        if self.peek()[1] == ":" and self.peek()[0] == "op":
            self.at += 1
            local = "*" if self.take("*") else self.peek()[1]
            if local != "*":
                self.at += 1
            return ("name", value, local)
        return ("name", None, value)

    def predicates(self) -> tuple:
        found = []
        while self.take("["):
            found.append(self.binary(0))
            self.need("]")
        return tuple(found)

    def primary(self) -> object:
        kind, value = self.peek()
        self.at += 1
        if kind == "number":
            return Literal(float(value))
        if kind == "literal":
            return Literal(value[1:-1])
        if value == "(":
            out = self.binary(0)
            self.need(")")
            return out
        if value == "$":
            name = self.peek()[1]
            self.at += 1
            return Variable(name)
        if self.take(":"):
            value = f"{value}:{self.peek()[1]}"
            self.at += 1
        self.need("(")
        args = []
        while not self.take(")"):
            args.append(self.binary(0))
            if self.peek()[1] != ")":
                self.need(",")
        return Call(value, tuple(args))


def parse(text: str, limits: Limits = Limits()) -> object:
    return Parser(text, limits).parse()


def below(expr: object) -> list:
    """The expressions inside an expression."""
    if isinstance(expr, Call):
        return list(expr.args)
    if isinstance(expr, Binary):
        return [expr.left, expr.right]
    if isinstance(expr, Path):
        return [*([] if isinstance(expr.start, str) else [expr.start]), *expr.predicates, *(p for s in expr.steps for p in s.predicates)]
    return []


def dump(expr: object, level: int = 0) -> str:
    """A parsed expression as indented lines, an operation each."""
    pad = "  " * level
    inner = lambda xs: "".join("\n" + dump(x, level + 1) for x in xs)
    if isinstance(expr, Literal):
        return f"{pad}NUMBER {expr.value:g}" if isinstance(expr.value, float) else f"{pad}STRING {expr.value}"
    if isinstance(expr, Variable):
        return f"{pad}VARIABLE {expr.name}"
    if isinstance(expr, Call):
        return f"{pad}FUNCTION {expr.name}({len(expr.args)})" + inner(expr.args)
    if isinstance(expr, Binary):
        return f"{pad}{expr.op.upper()}" + inner([expr.left, expr.right])
    steps = "".join(f"\n{pad}  STEP {s.axis} {' '.join(str(x) for x in s.test if x is not None)}" + "".join(f"\n{pad}    PREDICATE\n" + dump(p, level + 3) for p in s.predicates) for s in expr.steps)
    start = f" {expr.start.upper()}" if isinstance(expr.start, str) else "\n" + dump(expr.start, level + 1)
    return f"{pad}PATH{start}" + "".join(f"\n{pad}  PREDICATE\n" + dump(p, level + 2) for p in expr.predicates) + steps


def positional(expr: object) -> bool:
    """Whether a predicate looks at positions: a number, or position() or last() outside of nested predicates."""
    return kind_of(expr) == "number" or uses_position(expr)


def uses_position(expr: object) -> bool:
    if isinstance(expr, Call):
        return expr.name in ("position", "last") or any(map(uses_position, expr.args))
    if isinstance(expr, Binary):
        return uses_position(expr.left) or uses_position(expr.right)
    return isinstance(expr, Path) and not isinstance(expr.start, str) and uses_position(expr.start)


STRINGS = {"string", "concat", "substring", "substring-before", "substring-after", "normalize-space", "translate", "name", "local-name", "namespace-uri"}
NUMBERS = {"number", "floor", "ceiling", "round", "count", "sum", "position", "last", "string-length", "-"}
BOOLEANS = {"boolean", "not", "true", "false", "lang", "contains", "starts-with"}


#: Functions by the least and greatest number of their arguments (no greatest: -1) and which of these must be node-sets.
SIGNATURES = {
    "last": (0, 0, ()), "position": (0, 0, ()), "count": (1, 1, (0,)), "id": (1, 1, ()), "local-name": (0, 1, (0,)), "namespace-uri": (0, 1, (0,)), "name": (0, 1, (0,)),
    "string": (0, 1, ()), "concat": (2, -1, ()), "starts-with": (2, 2, ()), "contains": (2, 2, ()), "substring-before": (2, 2, ()), "substring-after": (2, 2, ()), "substring": (2, 3, ()),
    "string-length": (0, 1, ()), "normalize-space": (0, 1, ()), "translate": (3, 3, ()), "boolean": (1, 1, ()), "not": (1, 1, ()), "true": (0, 0, ()), "false": (0, 0, ()), "lang": (1, 1, ()),
    "number": (0, 1, ()), "sum": (1, 1, (0,)), "floor": (1, 1, ()), "ceiling": (1, 1, ()), "round": (1, 1, ()), "-": (1, 1, ()),
}


def constant(expr: object) -> bool:
    """Whether a scalar expression has the same value for every context node."""
    if isinstance(expr, (Literal, Variable)):
        return True
    if isinstance(expr, Binary):
        return expr.op != "|" and constant(expr.left) and constant(expr.right)
    return isinstance(expr, Call) and expr.name in SIGNATURES and expr.name not in ("position", "last", "lang", "id") and (bool(expr.args) or expr.name in ("true", "false")) and all(map(constant, expr.args))


def kind_of(expr: object) -> str:
    """The static type: ``set``, ``number``, ``string`` or ``boolean`` (``any`` for variables)."""
    if isinstance(expr, Literal):
        return "number" if isinstance(expr.value, float) else "string"
    if isinstance(expr, Path):
        return "set"
    if isinstance(expr, Binary):
        return {"|": "set"}.get(expr.op) or ("number" if expr.op in ("+", "-", "*", "div", "mod") else "boolean")
    if isinstance(expr, Call):
        if expr.kind:
            return expr.kind
        return "string" if expr.name in STRINGS else "number" if expr.name in NUMBERS else "boolean" if expr.name in BOOLEANS else "set" if expr.name == "id" else "any"
    return "any"


def rewrite(steps: tuple) -> tuple:
    """``descendant-or-self::node()/child::x`` is ``descendant::x``, unless a predicate counts positions."""
    out: list[Step] = []
    for step in steps:
        if out and out[-1] == Step("descendant-or-self", ("node",)) and step.axis in ("child", "descendant", "self", "descendant-or-self") and not any(map(positional, step.predicates)):
            out[-1] = Step("descendant-or-self" if step.axis in ("self", "descendant-or-self") else "descendant", step.test, step.predicates)
        else:
            out.append(step)
    return tuple(out)


# ---- plans --------------------------------------------------------------------------------------------------------

NODE = ["doc_id", "pre", "end", "level", "parent", "kind", "ns", "prefix", "name", "value"]


@dataclass
class Value:
    """A compiled expression: a column of the scope's rows, or a node-set as rows ``(doc_id, o, node...)`` by origin ``o``."""

    kind: str
    column: Column | None = None
    nodes: DataFrame | None = None
    #: A scalar that is the same in every row.
    fixed: bool = False


@dataclass
class Scope:
    """Rows in whose context an expression is evaluated: nodes, with ``position`` and ``last`` where they are known."""

    df: DataFrame
    names: itertools.count = field(default_factory=itertools.count)
    #: Whether the rows are all documents, so that paths from the root need no join to find them.
    top: bool = False

    def attach(self, found: DataFrame, *columns: tuple[str, Column]) -> list[Column]:
        """Aggregate ``found(doc_id, o, ...)`` by origin and join it to the rows; returns the new columns."""
        k = next(self.names)
        fresh = [f"__{name}_{k}" for name, _ in columns]
        summed = found.groupBy(F.col("doc_id").alias(f"__d{k}"), F.col("o").alias(f"__o{k}")).agg(*[c.alias(n) for n, (_, c) in zip(fresh, columns, strict=True)])
        self.df = self.df.join(summed, (F.col("doc_id") == F.col(f"__d{k}")) & (F.col("pre") == F.col(f"__o{k}")), "left").drop(f"__d{k}", f"__o{k}")
        return [F.col(n) for n in fresh]


class XPath:
    """Compiles expressions over one node table."""

    def __init__(self, nodes: DataFrame, *, variables: dict[str, object] | None = None, namespaces: dict[str, str] | None = None, functions: dict[str | tuple[str, str], Callable | Function] | None = None, id_attribute: str = "id", limits: Limits = Limits()):
        """``functions`` by name, or by namespace and local name; a plain callable takes and gives strings."""
        self.limits = limits
        self.nodes, self.variables, self.namespaces, self.functions, self.id_attribute = nodes.select(*NODE), variables or {}, namespaces or {}, functions or {}, id_attribute

    # entry points

    def roots(self) -> DataFrame:
        return self.nodes.where("kind = 'document'")

    def select(self, expression: str, context: DataFrame | None = None) -> DataFrame:
        """The distinct nodes that a node-set expression finds in each document (or below each context node)."""
        scope, expr = Scope(context if context is not None else self.roots(), top=context is None), self.parsed(expression)
        got = self.compile(expr, scope)
        if got.kind != "set":
            raise XPathError(f"{expression!r} is no node-set")
        found = got.nodes.select(*NODE)
        # Steps drop their repeats for each origin, and from the top a document has one; namespaces are found from each element anew.
        once = scope.top and isinstance(expr, Path) and expr.start == "root" and bool(expr.steps) and all(s.axis != "namespace" for s in expr.steps)
        return found if once else found.dropDuplicates(["doc_id", "pre"])

    def value(self, expression: str, kind: str = "string", context: DataFrame | None = None) -> DataFrame:
        """``doc_id, pre, result`` for each context node (each document): the expression cast to ``kind``."""
        scope = Scope(context if context is not None else self.roots(), top=context is None)
        got = self.compile(self.parsed(expression), scope)
        column = {"string": self.string, "number": self.number, "boolean": self.boolean}[kind](got, scope)
        return scope.df.select("doc_id", "pre", column.alias("result"))

    def values(self, expressions: list[tuple[object, str]], context: DataFrame) -> DataFrame:
        """``doc_id, pre, v0, v1, ...``: several parsed expressions, each cast to its kind, for the same context nodes in one plan."""
        scope, columns = Scope(context), []
        for k, (expr, kind) in enumerate(expressions):
            got = self.compile(expr, scope)
            columns.append({"string": self.string, "number": self.number, "boolean": self.boolean}[kind](got, scope).alias(f"v{k}"))
        return scope.df.select("doc_id", "pre", *columns)

    def parsed(self, expression: str) -> object:
        return self.bind(parse(expression, self.limits))

    def bind(self, expr: object) -> object:
        """The expression with extension functions found and their numbers of arguments checked."""
        if isinstance(expr, Call):
            args, found = tuple(map(self.bind, expr.args)), self.function(expr.name)
            if found is None:
                return replace(expr, args=args)
            least = len(found.args) - found.more
            if len(args) < least or (len(args) > len(found.args) and not found.more):
                raise XPathError(f"{expr.name}() has {len(args)} arguments, not {f'{least} or more' if found.more else least}")
            return replace(expr, args=args, kind=found.kind)
        if isinstance(expr, Binary):
            return replace(expr, left=self.bind(expr.left), right=self.bind(expr.right))
        if isinstance(expr, Path):
            steps = tuple(replace(s, predicates=tuple(map(self.bind, s.predicates))) for s in expr.steps)
            return replace(expr, start=expr.start if isinstance(expr.start, str) else self.bind(expr.start), steps=steps, predicates=tuple(map(self.bind, expr.predicates)))
        return expr

    def function(self, name: str) -> Function | None:
        """The extension function of a name; None for the language's own."""
        found = self.functions.get(name)
        if found is None and ":" in name:
            prefix, _, local = name.partition(":")
            if prefix not in self.namespaces:
                raise XPathError(f"undefined prefix {prefix!r}")
            found = self.functions.get((self.namespaces[prefix], local))
            if found is None:
                raise XPathError(f"unknown function {name}()")
        return Function(found, ("string",), "string", True) if found is not None and not isinstance(found, Function) else found

    def extended(self, name: str, found: Function, args: tuple, scope: Scope) -> Value:
        columns = []
        for k, a in enumerate(args):
            kind, v = found.args[min(k, len(found.args) - 1)], self.compile(a, scope)
            if kind == "set":
                if v.kind != "set":
                    raise XPathError(f"{name}() takes a node-set")
                ordered = F.transform(F.array_sort(F.collect_list(F.struct("pre", "value"))), lambda x: x["value"])
                (c,) = scope.attach(v.nodes, ("strings", ordered))
                columns.append(F.coalesce(c, F.array().cast("array<string>")))
            else:
                columns.append({"string": self.string, "number": self.number, "boolean": self.boolean}[kind](v, scope))
        cast = {"number": "double", "boolean": "boolean"}.get(found.kind, "string")
        return Value(found.kind, found.fn(*columns).cast(cast))

    # casts

    def string(self, v: Value, scope: Scope) -> Column:
        if v.kind == "set":
            (first,) = scope.attach(v.nodes, ("first", F.min_by("value", "pre")))
            return F.coalesce(first, F.lit(""))
        return {"string": lambda c: c, "number": fx.number_to_string, "boolean": fx.boolean_to_string}[v.kind](v.column)

    def number(self, v: Value, scope: Scope) -> Column:
        if v.kind == "number":
            return v.column
        return fx.boolean_to_number(v.column) if v.kind == "boolean" else fx.string_to_number(self.string(v, scope))

    def boolean(self, v: Value, scope: Scope) -> Column:
        if v.kind == "set":
            (n,) = scope.attach(v.nodes, ("some", F.count(F.lit(1))))
            return F.coalesce(n > 0, F.lit(False))
        return {"boolean": lambda c: c, "number": fx.number_to_boolean, "string": fx.string_to_boolean}[v.kind](v.column)

    # expressions

    def compile(self, expr: object, scope: Scope) -> Value:
        got = self.compiled(expr, scope)
        got.fixed = got.kind != "set" and constant(expr)
        return got

    def compiled(self, expr: object, scope: Scope) -> Value:
        if isinstance(expr, Literal):
            return Value("number" if isinstance(expr.value, float) else "string", F.lit(expr.value))
        if isinstance(expr, Variable):
            if expr.name not in self.variables:
                raise XPathError(f"undefined variable ${expr.name}")
            value = self.variables[expr.name]
            if isinstance(value, DataFrame):  # a node-set: the same for every context node of a document
                return Value("set", nodes=scope.df.select("doc_id", F.col("pre").alias("o")).distinct().join(value.select(*NODE), "doc_id").select("o", *NODE))
            return Value("boolean" if isinstance(value, bool) else "string" if isinstance(value, str) else "number", F.lit(value if isinstance(value, (bool, str)) else float(value)))
        if isinstance(expr, Path):
            return Value("set", nodes=self.path(expr, scope))
        if isinstance(expr, Call):
            return self.call(expr, scope)
        if expr.op in ("and", "or"):
            a, b = (self.boolean(self.compile(x, scope), scope) for x in (expr.left, expr.right))
            return Value("boolean", a & b if expr.op == "and" else a | b)
        left, right = self.compile(expr.left, scope), self.compile(expr.right, scope)
        if expr.op == "|":
            if left.kind != "set" or right.kind != "set":
                raise XPathError("| joins node-sets only")
            return Value("set", nodes=left.nodes.unionByName(right.nodes).dropDuplicates(["doc_id", "o", "pre"]))
        if expr.op in ("=", "!=", "<", "<=", ">", ">="):
            return Value("boolean", self.comparison(expr.op, left, right, scope))
        a, b = self.number(left, scope), self.number(right, scope)
        return Value("number", {"+": fx.add, "-": fx.subtract, "*": fx.multiply, "div": fx.divide, "mod": fx.modulo}[expr.op](a, b))

    def comparison(self, op: str, a: Value, b: Value, scope: Scope) -> Column:
        """Sets compare existentially; of scalars a boolean goes before a number before a string."""
        equality = op in ("=", "!=")
        if "set" in (a.kind, b.kind) and "boolean" in (a.kind, b.kind):
            x, y = self.boolean(a, scope), self.boolean(b, scope)
            return (x == y if op == "=" else x != y) if equality else fx.compare(op, fx.boolean_to_number(x), fx.boolean_to_number(y))
        if a.kind == "set" and b.kind == "set":
            if op == "=":
                x, y = (v.nodes.select("doc_id", "o", "value").distinct() for v in (a, b))
                (some,) = scope.attach(x.join(y, ["doc_id", "o", "value"], "left_semi"), ("same", F.count(F.lit(1))))
                return F.coalesce(some > 0, F.lit(False))
            if op == "!=":
                # Some pair differs unless all values of both are one.
                (x0, x1), (y0, y1) = (scope.attach(v.nodes, ("low", F.min("value")), ("high", F.max("value"))) for v in (a, b))
                return F.coalesce((x0 != x1) | (y0 != y1) | (x0 != y0), F.lit(False)) & x0.isNotNull() & y0.isNotNull()
            # Some pair is in order if the least of one and the greatest of the other are.
            number = lambda c: F.nullif(fx.string_to_number(c), F.lit(fx.NAN))
            (x0, x1), (y0, y1) = (scope.attach(v.nodes, ("least", F.min(number(F.col("value")))), ("most", F.max(number(F.col("value"))))) for v in (a, b))
            return F.coalesce(fx.compare(op, x0, y1) if op[0] == "<" else fx.compare(op, x1, y0), F.lit(False))
        if "set" in (a.kind, b.kind):
            nodes, other, flip = (a.nodes, b, False) if a.kind == "set" else (b.nodes, a, True)
            if equality and other.kind == "string":
                test = lambda x: x == other.column if op == "=" else x != other.column
            else:
                wanted = self.number(other, scope)
                if equality:
                    same = fx.numbers_equal if op == "=" else fx.numbers_differ
                    test = lambda x: same(fx.string_to_number(x), wanted)
                else:
                    test = lambda x: fx.compare(op, wanted, fx.string_to_number(x)) if flip else fx.compare(op, fx.string_to_number(x), wanted)
            if other.fixed:
                (hit,) = scope.attach(nodes, ("hit", F.max(test(F.col("value")))))
                return F.coalesce(hit, F.lit(False))
            (values,) = scope.attach(nodes, ("values", F.collect_set("value")))
            return F.coalesce(F.exists(values, test), F.lit(False))
        if not equality:
            return fx.compare(op, self.number(a, scope), self.number(b, scope))
        if "boolean" in (a.kind, b.kind):
            x, y = self.boolean(a, scope), self.boolean(b, scope)
            return x == y if op == "=" else x != y
        if "number" in (a.kind, b.kind):
            return (fx.numbers_equal if op == "=" else fx.numbers_differ)(self.number(a, scope), self.number(b, scope))
        return a.column == b.column if op == "=" else a.column != b.column

    def call(self, expr: Call, scope: Scope) -> Value:
        name, args = expr.name, expr.args
        if (found := self.function(name)) is not None:
            return self.extended(name, found, args, scope)
        self.check(name, args)
        here = Value("string", F.coalesce(F.col("value"), F.lit("")))
        own = lambda k: self.compile(args[k], scope)
        text = lambda k: self.string(own(k), scope)
        first = lambda: own(0) if args else here
        if name == "-":
            return Value("number", -self.number(own(0), scope))
        if name in ("position", "last"):
            if name not in scope.df.columns:
                return Value("number", F.lit(1.0))
            return Value("number", F.col(name).cast("double"))
        if name == "count":
            v = own(0)
            (n,) = scope.attach(v.nodes, ("count", F.count(F.lit(1))))
            return Value("number", F.coalesce(n, F.lit(0)).cast("double"))
        if name == "sum":
            (n,) = scope.attach(own(0).nodes, ("sum", F.sum(fx.string_to_number(F.col("value")))))
            return Value("number", F.coalesce(n, F.lit(0.0)))
        if name == "id":
            return Value("set", nodes=self.by_id(own(0), scope))
        if name in ("name", "local-name", "namespace-uri"):
            column = "ns" if name == "namespace-uri" else "name"
            full = F.when(F.col("prefix").isNotNull() & (F.lit(name) == "name"), F.concat_ws(":", "prefix", "name")).otherwise(F.col(column))
            if not args:
                return Value("string", F.coalesce(full, F.lit("")))
            (c,) = scope.attach(own(0).nodes, ("name", F.min_by(F.coalesce(full, F.lit("")), "pre")))
            return Value("string", F.coalesce(c, F.lit("")))
        if name == "lang":
            near = self.walk(scope.df, Step("ancestor-or-self", ("node",)), scope)
            at = self.step_from(near, Step("attribute", ("name", None, "*"))).where((F.col("name") == "lang") & (F.col("ns") == XML_NS))
            (value,) = scope.attach(at, ("lang", F.max_by("value", "level")))
            return Value("boolean", fx.lang_matches(value, text(0)))
        simple = {
            "string": lambda: Value("string", self.string(first(), scope)),
            "string-length": lambda: Value("number", F.length(self.string(first(), scope)).cast("double")),
            "concat": lambda: Value("string", fx.concat(*[text(k) for k in range(len(args))])),
            "contains": lambda: Value("boolean", fx.contains(text(0), text(1))),
            "starts-with": lambda: Value("boolean", fx.starts_with(text(0), text(1))),
            "substring": lambda: Value("string", fx.substring(text(0), *[self.number(own(k), scope) for k in range(1, len(args))])),
            "substring-before": lambda: Value("string", fx.substring_before(text(0), text(1))),
            "substring-after": lambda: Value("string", fx.substring_after(text(0), text(1))),
            "normalize-space": lambda: Value("string", fx.normalize_space(self.string(first(), scope))),
            "translate": lambda: Value("string", F.call_function("translate", text(0), text(1), text(2))),
            "boolean": lambda: Value("boolean", self.boolean(own(0), scope)),
            "not": lambda: Value("boolean", ~self.boolean(own(0), scope)),
            "true": lambda: Value("boolean", F.lit(True)),
            "false": lambda: Value("boolean", F.lit(False)),
            "number": lambda: Value("number", self.number(first(), scope)),
            "floor": lambda: Value("number", fx.floor(self.number(own(0), scope))),
            "ceiling": lambda: Value("number", fx.ceiling(self.number(own(0), scope))),
            "round": lambda: Value("number", fx.xround(self.number(own(0), scope))),
        }
        return simple[name]()

    def check(self, name: str, args: tuple) -> None:
        """The function is known, has as many arguments as it takes, and node-sets where it takes them."""
        if name not in SIGNATURES:
            raise XPathError(f"unknown function {name}()")
        least, most, sets = SIGNATURES[name]
        if len(args) < least or 0 <= most < len(args):
            raise XPathError(f"{name}() has {len(args)} arguments, not {least if least == most else f'{least} to {most}' if most >= 0 else f'{least} or more'}")
        for k in sets:
            if k < len(args) and kind_of(args[k]) not in ("set", "any"):
                raise XPathError(f"{name}() takes a node-set")
            if k < len(args) and isinstance(args[k], Variable) and not isinstance(self.variables.get(args[k].name), DataFrame):
                raise XPathError(f"{name}() takes a node-set")

    def by_id(self, v: Value, scope: Scope) -> DataFrame:
        """Elements whose id attribute is one of the words of a string, or of a set's strings."""
        if v.kind == "set":
            wanted = v.nodes.select("doc_id", "o", F.explode(F.split(fx.normalize_space(F.col("value")), " ")).alias("token"))
        else:
            wanted = scope.df.select("doc_id", F.col("pre").alias("o"), F.explode(F.split(fx.normalize_space(self.string(v, scope)), " ")).alias("token"))
        ids = self.nodes.where((F.col("kind") == "attr") & (F.col("name") == self.id_attribute)).select(F.col("doc_id"), F.col("value").alias("token"), F.col("parent").alias("at"))
        found = wanted.distinct().join(ids, ["doc_id", "token"]).select("doc_id", "o", F.col("at").alias("pre")).distinct()
        return found.join(self.nodes.where("kind = 'element'"), ["doc_id", "pre"]).select("o", *NODE)

    # paths

    def path(self, expr: Path, scope: Scope) -> DataFrame:
        if expr.start == "context":
            rows = scope.df.select(*NODE, F.col("pre").alias("o"))
        elif expr.start == "root" and scope.top and expr.steps:
            rows, steps = self.from_top(rewrite(expr.steps))
            for step in steps:
                rows = self.step_from(rows, step, single=True)
            return rows
        elif expr.start == "root":
            tops = self.roots()
            rows = scope.df.select("doc_id", F.col("pre").alias("o")).join(tops, "doc_id").select(*NODE, "o")
        else:
            v = self.compile(expr.start, scope)
            if v.kind != "set":
                raise XPathError("only node-sets have steps and predicates")
            rows = v.nodes.select(*NODE, "o")
            for p in expr.predicates:
                rows = self.filter(rows, p, ["doc_id", "o"], reverse=False)
        for step in rewrite(expr.steps):
            rows = self.step_from(rows, step)
        return rows

    def from_top(self, steps: tuple) -> tuple[DataFrame, tuple]:
        """The first step or two from the documents by filters alone: a document is at 0 and holds all its nodes."""
        step, rest = steps[0], steps[1:]
        n = self.nodes.withColumn("o", F.lit(0).cast("long"))
        tree, above = ~F.col("kind").isin("attr", "ns"), F.lit(0).cast("long")
        if step == Step("descendant-or-self", ("node",)) and rest and rest[0].axis in ("child", "attribute"):
            # Children, or attributes, of any node: each has its parent as context.
            step, rest = rest[0], rest[1:]
            above = F.col("parent")
            held = F.col("parent").isNotNull() & (tree if step.axis == "child" else F.col("kind") == "attr")
        elif step.axis == "child":
            held = (F.col("parent") == 0) & tree
        elif step.axis == "descendant":
            held = F.col("parent").isNotNull() & tree
        else:
            rows = self.roots().withColumn("o", F.col("pre"))
            return rows.select(*NODE, "o"), steps
        found = n.where(held & self.node_test(step)).withColumn("c", above)
        for p in step.predicates:
            found = self.filter(found, p, ["doc_id", "o", "c"], reverse=False)
        return found.select("o", *NODE), rest

    def walk(self, rows: DataFrame, step: Step, scope: Scope) -> DataFrame:
        return self.step_from(rows.select(*NODE, F.col("pre").alias("o")), step)

    def step_from(self, rows: DataFrame, step: Step, single: bool = False) -> DataFrame:
        """One step for rows ``(o, node...)``: join, filter by predicates, drop repeats. ``single``: each document has one origin."""
        if not any(map(positional, step.predicates)):
            found = None
            if step.axis in ("following", "preceding"):
                found = self.beyond(rows, step)
            elif single and step.axis in ("descendant", "descendant-or-self"):
                found = self.below(rows, step)
            elif single and step.axis in ("ancestor", "ancestor-or-self"):
                found = self.above(rows, step)
            if found is not None:
                # Each node is there once; a predicate that needs no positions needs no context.
                found = found.withColumn("c", F.lit(0).cast("long"))
                for p in step.predicates:
                    found = self.filter(found, p, ["doc_id", "o", "c"], False)
                return found.select("o", *NODE)
        if step.axis == "namespace":
            found = self.namespaces_of(rows, step)
            for p in step.predicates:
                found = self.filter(found, p, ["doc_id", "o", "c"], False)
            return found.select("o", *NODE)
        c = rows.select(F.col("doc_id").alias("c_doc"), "o", *[F.col(x).alias(f"c_{x}") for x in ("pre", "end", "parent", "kind")])
        n = self.nodes.where(self.node_test(step))
        if step.axis == "self":
            found = rows.where(self.node_test(step)).withColumn("c", F.col("pre"))
        else:
            pre, end, parent = F.col("pre"), F.col("end"), F.col("parent")
            cp, ce, cparent = F.col("c_pre"), F.col("c_end"), F.col("c_parent")
            tree, sibling = ~F.col("kind").isin("attr", "ns"), ~F.col("c_kind").isin("attr", "ns")
            on = {
                "child": (parent == cp) & tree,
                "parent": pre == cparent,
                "descendant": (pre > cp) & (pre <= ce) & tree,
                "descendant-or-self": (pre >= cp) & (pre <= ce) & (tree | (pre == cp)),
                "ancestor": (pre < cp) & (end >= ce) & tree,
                "ancestor-or-self": (pre <= cp) & (end >= ce) & (tree | (pre == cp)),
                "following-sibling": (parent == cparent) & (pre > cp) & tree & sibling,
                "preceding-sibling": (parent == cparent) & (pre < cp) & tree & sibling,
                "following": (pre > ce) & tree,
                "preceding": (end < cp) & tree,
                "attribute": (parent == cp) & (F.col("kind") == "attr"),
            }[step.axis]
            found = c.join(n, (F.col("c_doc") == F.col("doc_id")) & on).select("o", F.col("c_pre").alias("c"), *NODE)
        for p in step.predicates:
            found = self.filter(found, p, ["doc_id", "o", "c"], step.axis in REVERSE)
        out = found.select("o", *NODE)
        return out if step.axis in DISJOINT else out.dropDuplicates(["doc_id", "o", "pre"])

    def beyond(self, rows: DataFrame, step: Step) -> DataFrame:
        """Following (preceding) nodes: those after the end of the context that ends first (before the start of the one that starts last)."""
        ahead = step.axis == "following"
        near = rows.groupBy(F.col("doc_id").alias("c_doc"), "o").agg((F.min("end") if ahead else F.max("pre")).alias("edge"))
        n = self.nodes.where(self.node_test(step) & ~F.col("kind").isin("attr", "ns"))
        on = (F.col("pre") > F.col("edge")) if ahead else (F.col("end") < F.col("edge"))
        return near.join(n, (F.col("c_doc") == F.col("doc_id")) & on).select("o", *NODE)

    def below(self, rows: DataFrame, step: Step) -> DataFrame:
        """Nodes below the contexts of a document: sorted by place, a node is below a context if one that began before it hasn't ended."""
        n = self.nodes.where(self.node_test(step) & ~F.col("kind").isin("attr", "ns")).select(*NODE)
        own = step.axis.endswith("self")
        starts = rows.select("doc_id", F.col("pre").alias("at"), F.col("end").alias("stop"), "o").distinct().select("doc_id", "at", F.lit(0 if own else 1).alias("turn"), "stop", "o", F.lit(None).cast(n.schema).alias("node"))
        spots = n.select("doc_id", F.col("pre").alias("at"), F.lit(1 if own else 0).alias("turn"), F.lit(None).cast("long").alias("stop"), F.lit(None).cast("long").alias("o"), F.struct(*NODE).alias("node"))
        before = Window.partitionBy("doc_id").orderBy("at", "turn").rowsBetween(Window.unboundedPreceding, 0)
        swept = starts.unionByName(spots).withColumn("reach", F.max("stop").over(before)).withColumn("origin", F.max("o").over(before))
        inside = swept.where(F.col("node").isNotNull() & (F.col("reach") >= F.col("at"))).select(F.col("origin").alias("o"), "node.*")
        if not own:
            return inside
        # An attribute may be a context, and is its own self.
        return inside.unionByName(rows.where(F.col("kind").isin("attr", "ns") & self.node_test(step)).select("o", *NODE).distinct())

    def above(self, rows: DataFrame, step: Step) -> DataFrame:
        """Ancestors of the contexts of a document: nodes that more contexts have begun before the end of than before their start."""
        n = self.nodes.where(self.node_test(step) & ~F.col("kind").isin("attr", "ns") & (F.col("end") > F.col("pre"))).select(*NODE)
        none = F.lit(None).cast(n.schema)
        marks = rows.select("doc_id", F.col("pre").alias("at"), "o").distinct().select("doc_id", "at", F.lit(0).alias("turn"), F.lit(1).alias("one"), "o", none.alias("node"))
        spot = lambda at: n.select("doc_id", F.col(at).alias("at"), F.lit(1).alias("turn"), F.lit(0).alias("one"), F.lit(None).cast("long").alias("o"), F.struct(*NODE).alias("node"))
        before = Window.partitionBy("doc_id").orderBy("at", "turn").rowsBetween(Window.unboundedPreceding, 0)
        swept = marks.unionByName(spot("pre")).unionByName(spot("end")).withColumn("seen", F.sum("one").over(before)).withColumn("origin", F.max("o").over(before))
        met = swept.where(F.col("node").isNotNull()).groupBy("doc_id", F.col("node.pre").alias("pre")).agg(F.min("seen").alias("low"), F.max("seen").alias("high"), F.max("origin").alias("o"), F.first("node").alias("node"))
        found = met.where("high > low").select("o", "node.*")
        if step.axis == "ancestor":
            return found
        return found.unionByName(rows.where(self.node_test(step)).select("o", *NODE)).dropDuplicates(["doc_id", "o", "pre"])

    def namespaces_of(self, rows: DataFrame, step: Step) -> DataFrame:
        """Namespaces in scope of the context elements: of each prefix the nearest declaration, unless it undoes one. ``xml`` has no row."""
        e = self.nodes.where("kind = 'element'").select(F.col("doc_id").alias("e_doc"), F.col("pre").alias("e_pre"), F.col("end").alias("e_end"))
        declared = self.nodes.where("kind = 'ns'").join(e, (F.col("doc_id") == F.col("e_doc")) & (F.col("parent") == F.col("e_pre"))).select(*NODE, "e_pre", "e_end")
        c = rows.where("kind = 'element'").select(F.col("doc_id").alias("c_doc"), "o", F.col("pre").alias("c"))
        held = c.join(declared, (F.col("c_doc") == F.col("doc_id")) & (F.col("e_pre") <= F.col("c")) & (F.col("e_end") >= F.col("c")))
        nearest = held.groupBy("c_doc", "o", "c", F.col("name").alias("of")).agg(F.max_by(F.struct(*NODE), "e_pre").alias("node"))
        return nearest.select("o", "c", "node.*").where((F.col("value") != "") & self.node_test(step))

    def filter(self, rows: DataFrame, predicate: object, by: list[str], reverse: bool) -> DataFrame:
        """Rows for which a predicate holds; positions are counted anew within ``by``, along the axis."""
        if positional(predicate):
            order = F.col("pre").desc() if reverse else F.col("pre")
            rows = rows.withColumn("position", F.row_number().over(Window.partitionBy(*by).orderBy(order)))
            if isinstance(predicate, Literal) or not mentions(predicate, "last"):
                pass
            else:
                rows = rows.withColumn("last", F.count(F.lit(1)).over(Window.partitionBy(*by)))
        if isinstance(predicate, Literal):
            value = predicate.value
            whole = isinstance(value, float) and value == int(value) and 0 < value < 2**31 if not isinstance(value, str) and value == value and abs(value) != fx.INF else False
            return rows.where(F.col("position") == F.lit(int(value))) if whole else rows.where(F.lit(isinstance(value, str) and value != ""))
        scope = Scope(rows)
        v = self.compile(predicate, scope)
        holds = fx.numbers_equal(F.col("position").cast("double"), v.column) if v.kind == "number" else self.boolean(v, scope)
        kept = scope.df.where(holds)
        return kept.select(*[x for x in rows.columns if x not in ("position", "last")])

    def node_test(self, step: Step) -> Column:
        kind = F.col("kind")
        what = step.test[0]
        if what == "node":
            return F.lit(True)
        if what == "text":
            return kind.isin("text", "cdata")
        if what == "comment":
            return kind == "comment"
        if what == "pi":
            return (kind == "pi") & (F.lit(True) if step.test[1] is None else F.col("name") == step.test[1])
        _, prefix, local = step.test
        principal = kind == {"attribute": "attr", "namespace": "ns"}.get(step.axis, "element")
        if prefix is not None:
            if prefix not in self.namespaces:
                raise XPathError(f"undefined prefix {prefix!r}")
            principal = principal & (F.col("ns") == self.namespaces[prefix])
        if local == "*":
            return principal
        # A name without a prefix is in no namespace, whatever the default namespace is.
        return principal & (F.col("name") == local) & (F.col("ns").isNull() if prefix is None else F.lit(True))


def mentions(expr: object, name: str) -> bool:
    if isinstance(expr, Call):
        return expr.name == name or any(mentions(a, name) for a in expr.args)
    return isinstance(expr, Binary) and (mentions(expr.left, name) or mentions(expr.right, name))
