"""Walking a document by commands, and stopping work that takes too long."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.operators.nodes import serialize
from treeline.plans.xpath import XPath, XPathError
from treeline.session import written


class Shell:
    """A place in one document of a node table, and commands that look around from it.

    ``pwd``, ``cd PATH``, ``ls [PATH]``, ``cat [PATH]``, ``xpath EXPRESSION``,
    ``grep TEXT``, ``du [PATH]`` (elements by depth); what a command says is text.
    Answers longer than ``most`` lines are cut with a mark, as a screen is.
    """

    def __init__(self, nodes: DataFrame, doc_id: int, most: int = 200):
        # Each command looks around anew, so the document is taken out of its table once.
        self.nodes, self.most = written(nodes.where(F.col("doc_id") == doc_id)), most
        self.here = 0
        self.x = XPath(self.nodes)

    def context(self) -> DataFrame:
        return self.nodes.where(F.col("pre") == self.here)

    def found(self, path: str) -> DataFrame:
        return self.x.select(path or ".", self.context())

    def run(self, line: str) -> str:
        """What a command says; a fault is said too."""
        word, _, rest = line.strip().partition(" ")
        command = getattr(self, f"do_{word}", None)
        if command is None:
            return f"unknown command {word}"
        try:
            return command(rest.strip())
        except XPathError as e:
            return f"error: {e}"

    def lines(self, texts: list[str]) -> str:
        return "\n".join(texts if len(texts) <= self.most else [*texts[: self.most], "..."])

    def do_pwd(self, _: str) -> str:
        names = self.x.select("ancestor-or-self::*", self.context()).orderBy("pre").select("name").collect()
        return "/" + "/".join(r.name for r in names)

    def do_cd(self, path: str) -> str:
        got = self.found(path or "/").where("kind in ('element', 'document')").orderBy("pre").select("pre").limit(2).collect()
        if len(got) != 1:
            return f"{path} is {'no node' if not got else 'several nodes'}"
        self.here = got[0].pre
        return ""

    def do_ls(self, path: str) -> str:
        rows = self.x.select("node()", self.found(path)).orderBy("pre").select("kind", "name", "value", "level").limit(self.most + 1).collect()
        return self.lines([r.name if r.kind == "element" else f"#{r.kind}" for r in rows])

    def do_cat(self, path: str) -> str:
        rows = self.found(path).orderBy("pre").limit(self.most + 1)
        keys = [r.pre for r in rows.select("pre").collect()]
        xml = {r.pre: r.xml for r in serialize(self.nodes, F.col("pre").isin(keys)).collect()} if keys else {}
        said = {r.pre: r.value for r in rows.select("pre", "value").collect()}
        return self.lines([xml.get(k, said[k] or "") for k in keys])

    def do_xpath(self, expression: str) -> str:
        from treeline.plans.xpath import kind_of, parse

        if kind_of(parse(expression)) == "set":
            return self.lines([r.value or "" for r in self.found(expression).orderBy("pre").select("value").limit(self.most + 1).collect()])
        return self.x.value(expression, "string", self.context()).first().result

    def do_grep(self, text: str) -> str:
        rows = self.nodes.where(F.col("kind").isin("text", "cdata", "comment") & F.contains("value", F.lit(text))).orderBy("pre").select("value").limit(self.most + 1).collect()
        return self.lines([r.value for r in rows])

    def do_du(self, path: str) -> str:
        below = self.x.select("descendant-or-self::*", self.found(path)).groupBy("level", "name").agg(F.count(F.lit(1)).alias("n")).orderBy("level", "name").collect()
        return self.lines([f"{'  ' * (r.level - 1)}{r.name} {r.n}" for r in below])


class Interrupted(RuntimeError):
    """Work that was asked to stop."""


def interruptible(spark: SparkSession, work: Callable[[], object], stop: Callable[[], bool], every: float = 0.2) -> object:
    """What ``work`` returns, unless ``stop`` says so before: it is asked again and again, and the work's jobs are cancelled when it is true."""
    tag, out = f"work-{uuid.uuid4().hex}", {}

    def go() -> None:
        spark.sparkContext.addJobTag(tag)
        try:
            out["value"] = work()
        except Exception as e:  # handed to the caller's thread
            out["error"] = e

    thread = InheritableThread(target=go)
    thread.start()
    done = threading.Event()
    while thread.is_alive():
        if stop():
            while thread.is_alive():  # a job that begins only now is cancelled too
                spark.sparkContext.cancelJobsWithTag(tag)
                thread.join(every)
            if "value" not in out:
                raise Interrupted("stopped")
        done.wait(every)
    thread.join()
    if "error" in out:
        raise out["error"]
    return out["value"]
