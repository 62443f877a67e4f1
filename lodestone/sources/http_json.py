"""JSON over HTTP as a table. The request is the value that a query demands of the filter column:

    SELECT key FROM http.etcd.keys WHERE _http = '{"url": "http://host:2379", "uri": "v2/keys", "dataPath": "node.nodes"}'

Options: url, uri, dataPath, timeout (ms), method, partitionBy, contentType, body. partitionBy names an array in the
JSON body, the form body or the query string; it is sliced over `slices` requests, each of them a Spark partition.
A response that isn't JSON gives no rows. Rows are the objects at dataPath; missing keys are null.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from urllib.parse import parse_qsl, urlencode
from urllib.request import Request, urlopen

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..config import TableEntry
from ..shipping import ship
from ..types import lenient, type_of_name

FORMAT = "lodestone_http"


def requests_of(text: str, slices: int) -> list[dict]:
    """One request, or one for each slice of the array that partitionBy names."""
    asked = json.loads(text)
    if not asked.get("url"):
        raise ValueError("the request needs a url")
    key, body = asked.get("partitionBy"), asked.get("body") or ""
    if not key:
        return [asked]
    kind, uri = str(asked.get("contentType") or ""), str(asked.get("uri") or "")
    path, _, query = uri.partition("?")
    if isinstance(body, dict):
        body = json.dumps(body)

    def sliced(values) -> list[list]:
        values = json.loads(values) if isinstance(values, str) else values
        if not isinstance(values, list):
            raise ValueError(f"{key} isn't an array")
        n = max(1, min(slices, len(values)))
        bounds = [len(values) * k // n for k in range(n + 1)]
        return [values[a:b] for a, b in zip(bounds, bounds[1:])]

    if body and "json" in kind:
        whole = json.loads(body)
        return [asked | {"body": json.dumps(whole | {key: part})} for part in sliced(whole[key])]
    form = dict(parse_qsl(body if body else query, keep_blank_values=True))
    parts = [urlencode(form | {key: json.dumps(part)}) for part in sliced(form[key])]
    return [asked | ({"body": p} if body else {"uri": f"{path}?{p}"}) for p in parts]


def fetched(asked: dict) -> str | None:
    """The body of the response, or None if it isn't JSON."""
    base, uri = str(asked["url"]), str(asked.get("uri") or "").lstrip("/")
    address = base.rstrip("/") + "/" + uri if uri and not base.endswith("?") else base + uri
    body = asked.get("body")
    data = (json.dumps(body) if isinstance(body, (dict, list)) else str(body)).encode() if body else None
    headers = {"Content-Type": str(asked["contentType"])} if asked.get("contentType") else {}
    request = Request(address, data, headers, method=str(asked.get("method") or ("POST" if data else "GET")).upper())
    with urlopen(request, timeout=float(asked.get("timeout") or 60_000) / 1000) as response:
        if response.headers.get_content_type() != "application/json":
            return None
        return response.read().decode()


def objects(text: str, path: str | None) -> list[dict]:
    """The object or objects at a dotted path."""
    found = json.loads(text)
    for step in [p for p in (path or "").split(".") if p]:
        found = found.get(step) if isinstance(found, dict) else None
    found = found if isinstance(found, list) else [found]
    return [x for x in found if isinstance(x, dict)]


class HttpReader(DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType) -> None:
        self.asked, self.slices, self.columns = options["request"], int(options.get("slices", 1)), schema.names
        self.filter, self.result, self.path = options["filterColumn"], options["resultColumn"], options.get("dataPath")

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(r) for r in requests_of(self.asked, self.slices)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        text = fetched(partition.value)
        if text is None:
            return
        for row in objects(text, partition.value.get("dataPath") or self.path):
            fixed = {self.filter.lower(): self.asked, self.result.lower(): text}
            values = [fixed.get(c.lower(), row.get(c)) for c in self.columns]
            yield tuple(v if v is None or isinstance(v, str) else json.dumps(v) for v in values)


class HttpSource(DataSource):
    """Rows of text; the table's types are applied by Spark."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        raise ValueError("the columns come from the catalog")

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return HttpReader(self.options | {"request": self.options["request"]}, schema)


def read(spark: SparkSession, entry: TableEntry, name: tuple[str, str, str], requests: dict[str, str]) -> DataFrame:
    wanted = entry.options.get("filter-column") or "_http"
    asked = requests.get(wanted.lower())
    if asked is None:
        raise ValueError(f"{'.'.join(name)} needs a condition {wanted} = '{{\"url\": ...}}' that every row must meet")
    ship(spark)
    spark.dataSource.register(HttpSource)
    schema = T.StructType([T.StructField(c, T.StringType()) for c, _ in entry.columns])
    options = {"request": asked, "filterColumn": wanted, "resultColumn": entry.options.get("result-column") or "_", "slices": str(entry.options.get("slices") or spark.sparkContext.defaultParallelism)}
    if entry.options.get("data-path"):
        options["dataPath"] = entry.options["data-path"]
    raw = spark.read.format(FORMAT).schema(schema).options(**options).load()
    return raw.select(*(lenient(F.col(f"`{c}`"), type_of_name(t), strict=True).alias(c) for c, t in entry.columns))
