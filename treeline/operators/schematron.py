"""Schematron: rules read from a schema document, fired over the node table.

A node is tried against the rules of a pattern in order and meets the first whose
context it matches. All tests, messages and variables of a rule are compiled into
one plan over its context nodes, so a schema costs one plan a rule, not one a
node. A failed ``assert`` and a ``report`` that holds give a row each.

``let`` names an expression: on the schema, a pattern or a rule; it stands for
its expression wherever it is used in the rule, so inside a predicate of a path
only a constant or absolute one may be used.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce
from xml.etree import ElementTree

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.plans import xpath
from treeline.plans.xpath import XPath, XPathError


def local(e: ElementTree.Element) -> str:
    return e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""


@dataclass
class Check:
    kind: str
    test: str
    #: Texts and, for ``value-of`` and ``name``, ("expression", text).
    message: list
    id: str | None = None


@dataclass
class Rule:
    context: str
    checks: list[Check]
    lets: dict[str, str] = field(default_factory=dict)


@dataclass
class Schema:
    namespaces: dict[str, str]
    patterns: list[tuple[str, list[Rule]]]
    phases: dict[str, list[str]]
    default: str | None = None


class SchemaError(ValueError):
    """A schema that can't be read."""


def read(text: str) -> Schema:
    """Read a schema. ``diagnostics`` are looked up by id and end the message; abstract rules are put where ``extends`` names them."""
    try:
        root = ElementTree.fromstring(text)
    except ElementTree.ParseError as e:
        raise SchemaError(str(e)) from None
    if local(root) != "schema":
        raise SchemaError("no schema")
    children = lambda e, name: [c for c in e if local(c) == name]
    lets = lambda e: {c.get("name"): c.get("value") for c in children(e, "let")}

    def words(e: ElementTree.Element) -> list:
        out = [e.text or ""]
        for c in e:
            if local(c) == "value-of":
                out.append(("expression", c.get("select", "")))
            elif local(c) == "name":
                out.append(("expression", f"name({c.get('path', '.')})"))
            else:
                out += words(c)
            out.append(c.tail or "")
        return out

    diagnostics = {d.get("id"): words(d) for g in children(root, "diagnostics") for d in children(g, "diagnostic")}
    patterns = []
    for n, p in enumerate(children(root, "pattern")):
        abstract = {r.get("id"): r for r in children(p, "rule") if r.get("abstract") == "true"}
        rules = []

        def checks(r: ElementTree.Element, depth: int = 0, abstract: dict = abstract) -> list[Check]:
            out = []
            for c in r:
                if local(c) in ("assert", "report"):
                    if not c.get("test"):
                        raise SchemaError(f"{local(c)} has no test")
                    more = [x for d in (c.get("diagnostics") or "").split() for x in [" ", *diagnostics.get(d, [])]]
                    out.append(Check(local(c), c.get("test"), [*words(c), *more], c.get("id")))
                elif local(c) == "extends":
                    if c.get("rule") not in abstract or depth > 20:
                        raise SchemaError(f"no abstract rule {c.get('rule')}")
                    out += checks(abstract[c.get("rule")], depth + 1)
            return out

        for r in children(p, "rule"):
            if r.get("abstract") != "true":
                if not r.get("context"):
                    raise SchemaError("rule has no context")
                rules.append(Rule(r.get("context"), checks(r), lets(root) | lets(p) | lets(r)))
        patterns.append((p.get("id") or p.get("name") or f"pattern {n + 1}", rules))
    phases = {p.get("id"): [a.get("pattern") for a in children(p, "active")] for p in children(root, "phase")}
    return Schema({n.get("prefix"): n.get("uri") for n in children(root, "ns")}, patterns, phases, root.get("defaultPhase"))


def absolute(context: str) -> str:
    """A rule's context as a path from the root: a relative alternative may begin anywhere."""
    parts = [p.strip() for p in split_union(context)]
    return " | ".join(p if p.startswith("/") else f"//{p}" for p in parts)


def split_union(text: str) -> list[str]:
    out, depth, at, quote = [], 0, 0, ""
    for k, c in enumerate(text):
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
        elif c == "|" and not depth:
            out.append(text[at:k])
            at = k + 1
    return [*out, text[at:]]


def bound(expr: object, lets: dict[str, object], nested: bool = False) -> object:
    """The expression with variables replaced by what they stand for."""
    if isinstance(expr, xpath.Variable) and expr.name in lets:
        held = lets[expr.name]
        if nested and not xpath.constant(held) and not (isinstance(held, xpath.Path) and held.start == "root"):
            raise XPathError(f"${expr.name} depends on the rule's node and can't be used in a predicate")
        return held
    if isinstance(expr, xpath.Binary):
        return replace(expr, left=bound(expr.left, lets, nested), right=bound(expr.right, lets, nested))
    if isinstance(expr, xpath.Call):
        return replace(expr, args=tuple(bound(a, lets, nested) for a in expr.args))
    if isinstance(expr, xpath.Path):
        steps = tuple(replace(s, predicates=tuple(bound(p, lets, True) for p in s.predicates)) for s in expr.steps)
        start = expr.start if isinstance(expr.start, str) else bound(expr.start, lets, nested)
        return replace(expr, start=start, steps=steps, predicates=tuple(bound(p, lets, True) for p in expr.predicates))
    return expr


def report(nodes: DataFrame, schema: Schema, phase: str | None = None, variables: dict | None = None) -> DataFrame:
    """``doc_id, pre, pattern, context, kind, test, message`` of all checks that fire; ``#ALL`` or no phase takes every pattern."""
    x = XPath(nodes, namespaces=schema.namespaces, variables=variables)
    phase = phase or schema.default
    if phase not in (None, "#ALL") and phase not in schema.phases:
        raise SchemaError(f"no phase {phase}")
    found = []
    for name, rules in schema.patterns:
        if phase not in (None, "#ALL") and name not in schema.phases[phase]:
            continue
        taken = None
        for rule in rules:
            lets: dict[str, object] = {}
            for k, v in rule.lets.items():
                lets[k] = bound(xpath.parse(v), lets)
            here = x.select(absolute(rule.context))
            fresh = here if taken is None else here.join(taken, ["doc_id", "pre"], "left_anti")
            keys = here.select("doc_id", "pre")
            taken = keys if taken is None else taken.unionByName(keys)
            if not rule.checks:
                continue
            wanted: list[tuple[object, str]] = []
            for c in rule.checks:
                wanted.append((bound(xpath.parse(c.test), lets), "boolean"))
                wanted += [(bound(xpath.parse(m[1]), lets), "string") for m in c.message if isinstance(m, tuple)]
            got, at, fired = x.values(wanted, fresh), 0, []
            for c in rule.checks:
                holds, at = F.col(f"v{at}"), at + 1
                parts = []
                for m in c.message:
                    if isinstance(m, tuple):
                        parts.append(F.col(f"v{at}"))
                        at += 1
                    else:
                        parts.append(F.lit(m))
                message = F.trim(F.regexp_replace(F.concat(*parts), r"\s+", " "))
                row = F.struct(F.lit(c.kind).alias("kind"), F.lit(c.test).alias("test"), message.alias("message"))
                fired.append(F.when(~holds if c.kind == "assert" else holds, row))
            rows = got.select("doc_id", "pre", F.explode(F.array_compact(F.array(*fired))).alias("x"))
            found.append(rows.select("doc_id", "pre", F.lit(name).alias("pattern"), F.lit(rule.context).alias("context"), "x.*"))
    if not found:
        return nodes.sparkSession.createDataFrame([], "doc_id long, pre long, pattern string, context string, kind string, test string, message string")
    return reduce(DataFrame.unionByName, found)
