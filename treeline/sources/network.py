"""Documents over HTTP, behind a policy: nothing is fetched that no allowed prefix covers.

``fetched`` reads the URLs of a column in Arrow batches; an address that the
policy refuses, one that doesn't answer and a body over the limit are errors in
their rows, never failed jobs. Without allowed prefixes nothing leaves a machine.
"""

from __future__ import annotations

import urllib.error
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf


@dataclass(frozen=True)
class Policy:
    """What may be fetched: prefixes of addresses, seconds to wait, bytes at most."""

    allowed: tuple[str, ...] = ()
    seconds: float = 10.0
    most: int = 1 << 24

    def permits(self, url: str) -> bool:
        """A prefix covers an address if it ends at one of its parts: ``http://a`` doesn't cover ``http://ab``."""
        if urlsplit(url).scheme not in ("http", "https") or "@" in urlsplit(url).netloc or "/../" in f"{urlsplit(url).path}/":
            return False
        return any(url == p or url.startswith(p if p.endswith("/") else f"{p}/") or url.startswith(f"{p}?") for p in self.allowed)


class Refused(urllib.request.HTTPRedirectHandler):
    """Redirects go where the policy permits, nowhere else."""

    def __init__(self, policy: Policy):
        self.policy = policy

    def redirect_request(self, req, fp, code, msg, headers, newurl):
        if not self.policy.permits(newurl):
            raise urllib.error.URLError("redirected to where it is not allowed")
        return super().redirect_request(req, fp, code, msg, headers, newurl)


def fetch(url: str | None, policy: Policy) -> tuple[int | None, bytes | None, str | None]:
    """Status, body and error of one address."""
    if url is None or not policy.permits(url):
        return None, None, None if url is None else "not allowed"
    opener = urllib.request.build_opener(urllib.request.ProxyHandler({}), Refused(policy))
    try:
        with opener.open(url, timeout=policy.seconds) as answer:
            body = answer.read(policy.most + 1)
            return (answer.status, None, "too large") if len(body) > policy.most else (answer.status, body, None)
    except urllib.error.HTTPError as e:
        return e.code, None, f"status {e.code}"
    except (OSError, ValueError) as e:
        return None, None, str(getattr(e, "reason", e))


def permitted(url: Column, policy: Policy) -> Column:
    """Whether a policy lets an address be fetched; null stays null. Nothing is fetched."""

    @pandas_udf("boolean")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for urls in batches:
            yield urls.map(policy.permits, na_action="ignore")

    return run(url)


def fetched(url: Column, policy: Policy) -> Column:
    """``status, body, error`` of each address."""

    @pandas_udf("status int, body binary, error string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for urls in batches:
            yield pd.DataFrame([fetch(u, policy) for u in urls], columns=["status", "body", "error"]).astype({"status": "Int32"})

    return run(url)
