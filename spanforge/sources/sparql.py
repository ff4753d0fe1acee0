"""A provider for lookups: SELECT queries sent to a SPARQL endpoint over HTTP."""

from __future__ import annotations

import base64
import json
import urllib.parse
import urllib.request

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


class SparqlEndpoint:
    """Callable for ``LookupResolver``. ``method`` is GET, with the query in the address, or POST, with it in a form.

    Values come as text; a variable without a value in a row is null there. ``numbers`` names variables that are
    integers. A failed request raises the endpoint's error.
    """

    def __init__(self, spark: SparkSession, url: str, method: str = "GET", user: str | None = None, password: str = "", numbers: tuple[str, ...] = (), timeout: float = 60.0) -> None:
        if method not in ("GET", "POST"):
            raise ValueError(f"a query is sent by GET or POST, not by {method}")
        self.spark, self.url, self.method, self.user, self.password, self.numbers, self.timeout = spark, url, method, user, password, numbers, timeout

    def request(self, query: str) -> urllib.request.Request:
        form = urllib.parse.urlencode({"query": query})
        headers = {"Accept": "application/sparql-results+json"}
        if self.user is not None:
            headers["Authorization"] = "Basic " + base64.b64encode(f"{self.user}:{self.password}".encode()).decode()
        if self.method == "GET":
            return urllib.request.Request(f"{self.url}{'&' if '?' in self.url else '?'}{form}", headers=headers)
        return urllib.request.Request(self.url, form.encode(), {**headers, "Content-Type": "application/x-www-form-urlencoded"})

    def __call__(self, query: str) -> DataFrame:
        with urllib.request.urlopen(self.request(query), timeout=self.timeout) as answer:
            found = json.load(answer)
        names = found["head"]["vars"]
        value = lambda row, n: None if n not in row else int(row[n]["value"]) if n in self.numbers else row[n]["value"]
        rows = [tuple(value(r, n) for n in names) for r in found["results"]["bindings"]]
        schema = T.StructType([T.StructField(n, T.LongType() if n in self.numbers else T.StringType()) for n in names])
        return self.spark.createDataFrame(rows, schema)
