"""An HTTP endpoint: POST a statement to /query, get rows in the form that Accept asks for.

Each request has an engine of its own over the shared catalog entries, so USE holds for its request only. Rows stream
in every form, a partition at a time on the driver. An error after the first rows breaks off the chunked answer
without its last chunk, which clients see as an incomplete one.
"""

from __future__ import annotations

import csv
import io
import json
from datetime import timezone
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from itertools import chain, islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema

from .session import Engine
from .types import name_of_type


BATCH = 10_000


def distinct_names(names: list[str]) -> list[str]:
    """`names`, told apart by numbers where they repeat."""
    out: list[str] = []
    for name in names:
        free, n = name, 1
        while free in out or free != name and free in names:
            n += 1
            free = f"{name}_{n}"
        out.append(free)
    return out


def as_json(df: DataFrame):
    """A JSON array of objects, row by row; missing values are null. Names that repeat get _2, _3 and so on."""
    names = distinct_names(df.columns)
    yield b"["
    for k, row in enumerate(df.toLocalIterator()):
        yield (b"," if k else b"") + json.dumps(dict(zip(names, row)), default=str).encode()
    yield b"]"


def as_lines(df: DataFrame):
    """The schema as JSON, then lines of CSV."""
    yield json.dumps([{"name": f.name, "type": name_of_type(f.dataType)} for f in df.schema.fields]).encode() + b"\n"
    for row in df.toLocalIterator():
        line = io.StringIO()
        csv.writer(line, lineterminator="\n").writerow(["" if v is None else v for v in row])
        yield line.getvalue().encode()


def _zoned(value, kind: pa.DataType):
    """Collected timestamps are in this process's zone, without saying so."""
    return value.astimezone(timezone.utc) if value is not None and pa.types.is_timestamp(kind) and kind.tz else value


def as_arrow(df: DataFrame):
    """An Arrow stream of batches of `BATCH` rows."""
    df = df.toDF(*distinct_names(df.columns))
    schema, sink = to_arrow_schema(df.schema), io.BytesIO()
    rows = df.toLocalIterator()
    with pa.ipc.new_stream(sink, schema) as writer:
        while part := list(islice(rows, BATCH)):
            columns = [pa.array([_zoned(r[k], f.type) for r in part], f.type) for k, f in enumerate(schema)]
            writer.write_batch(pa.RecordBatch.from_arrays(columns, schema=schema))
            yield sink.getvalue()
            sink.seek(0)
            sink.truncate()
    yield sink.getvalue()


FORMS = {"application/json": as_json, "application/octet-stream": as_arrow, "text/plain": as_lines}


def serve(engine: Engine, port: int = 0, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    """A server, bound but not yet running: call serve_forever."""

    class Handler(BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"

        def do_POST(self) -> None:
            if self.path.rstrip("/") != "/query":
                self.send_error(404)
                return
            statement = self.rfile.read(int(self.headers.get("Content-Length") or 0)).decode()
            kind = next((k for k in FORMS if k in (self.headers.get("Accept") or "")), "text/plain")
            try:
                parts = FORMS[kind](engine.session().sql(statement))
                first = next(parts)
            except Exception as error:  # whatever it is, the client learns of it
                body = json.dumps({"error": str(error)}).encode()
                self.send_response(400)
                self.send_header("Content-Type", "application/json")
                self.send_header("Content-Length", str(len(body)))
                self.end_headers()
                self.wfile.write(body)
                return
            self.send_response(200)
            self.send_header("Content-Type", kind)
            self.send_header("Transfer-Encoding", "chunked")
            self.end_headers()
            try:
                for part in chain((first,), parts):
                    if part:
                        self.wfile.write(b"%x\r\n%b\r\n" % (len(part), part))
            except Exception:  # too late for a status: leave the answer visibly incomplete
                self.close_connection = True
                return
            self.wfile.write(b"0\r\n\r\n")

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
