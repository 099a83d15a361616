"""A registry of callable tools: schemas from signatures, validation, errors as values, and use as Spark functions."""

from __future__ import annotations

import inspect
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

JSON_TYPES = {int: "integer", float: "number", str: "string", bool: "boolean", list: "array", dict: "object"}


@dataclass
class Tool:
    name: str
    fn: Callable
    description: str

    def parameters(self) -> dict[str, inspect.Parameter]:
        """What a caller passes: all but ``ctx``."""
        return {k: p for k, p in inspect.signature(self.fn, eval_str=True).parameters.items() if k != "ctx"}

    def schema(self) -> dict:
        """The JSON schema of the parameters; those without a default are required."""
        p = self.parameters()
        of = lambda t: {"type": JSON_TYPES.get(getattr(t, "__origin__", t), "string")}
        return {
            "name": self.name,
            "description": self.description,
            "parameters": {"type": "object", "properties": {k: of(x.annotation) for k, x in p.items()}, "required": [k for k, x in p.items() if x.default is inspect.Parameter.empty]},
        }

    def validate(self, args: dict) -> list[str]:
        p, errors = self.parameters(), []
        errors += [f"missing argument {k}" for k, x in p.items() if k not in args and x.default is inspect.Parameter.empty]
        errors += [f"unknown argument {k}" for k in args if k not in p]
        for k, v in args.items():
            wanted = p[k].annotation if k in p else None
            if wanted in (int, float, str, bool, list, dict):
                ok = isinstance(v, wanted) and not (isinstance(v, bool) and wanted is not bool) or wanted is float and isinstance(v, int) and not isinstance(v, bool)
                if not ok:
                    errors.append(f"argument {k} is no {JSON_TYPES[wanted]}")
        return errors


@dataclass
class Toolbox:
    """Tools by name; of equal names the first stays."""

    tools: dict[str, Tool] = field(default_factory=dict)
    context: object = None

    def register(self, fn: Callable | None = None, *, name: str | None = None) -> Callable:
        def keep(f: Callable) -> Callable:
            p = inspect.signature(f).parameters
            if "ctx" in p and p["ctx"].kind is not inspect.Parameter.KEYWORD_ONLY:
                raise TypeError("ctx must be a keyword-only argument")
            self.tools.setdefault(name or f.__name__, Tool(name or f.__name__, f, inspect.getdoc(f) or ""))
            return f

        return keep(fn) if fn else keep

    def call(self, name: str, args: dict) -> dict:
        """``{"result": ...}`` or ``{"error": ..., "details": [...]}``; nothing is raised."""
        tool = self.tools.get(name)
        if tool is None:
            return {"error": f"unknown tool {name}", "details": sorted(self.tools)}
        if errors := tool.validate(args):
            return {"error": "invalid arguments", "details": errors}
        extra = {"ctx": self.context} if "ctx" in inspect.signature(tool.fn).parameters else {}
        try:
            return {"result": tool.fn(**args, **extra)}
        except Exception as e:  # a tool's failure is a value here
            return {"error": str(e), "details": [type(e).__name__]}

    def call_json(self, name: str, args: str) -> str:
        try:
            parsed = json.loads(args)
        except ValueError as e:
            return json.dumps({"error": "arguments are no JSON", "details": [str(e)]})
        return json.dumps(self.call(name, parsed), sort_keys=True)

    def column(self, name: Column, args: Column) -> Column:
        """The JSON result of each row's tool and JSON arguments, in Arrow batches."""
        box = self

        @pandas_udf("string")
        def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            for names, arguments in batches:
                yield pd.Series([box.call_json(n, a) for n, a in zip(names, arguments, strict=True)], dtype=object)

        return run(name, args)


def signature_type(fn: Callable) -> str:
    """The Spark type of a function's return annotation."""
    kinds = {int: "long", float: "double", str: "string", bool: "boolean", bytes: "binary"}
    return kinds[inspect.signature(fn, eval_str=True).return_annotation]


def tool_called(calls: Column, name: str) -> Column:
    """Whether one of an array of calls has a name."""
    return F.exists(calls, lambda c: c["name"] == name)
