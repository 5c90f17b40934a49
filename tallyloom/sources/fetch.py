"""Projects over HTTP: a Python data source, and a map over a table of ids.

A project takes two steps: its metadata, then, where that carries a token, its JSON. Whatever goes wrong gives a null json and a reason
in error, never a failed job. get is the transport, (url, timeout) -> (content type, body); tests put their own there.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.streaming import StreamingQuery

from tallyloom.sources.store import WAVE_ROWS, fill

Get = Callable[[str, float], tuple[str, str]]
TIMEOUT = 10.0
ACCEPTED = ("application/json", "application/octet-stream")
SCHEMA = "project_id long, json string, error string"


def http_get(url: str, timeout: float) -> tuple[str, str]:
    from urllib.request import Request, urlopen

    with urlopen(Request(url, headers={"User-Agent": "Mozilla/5.0", "Accept": "application/json"}), timeout=timeout) as r:
        return r.headers.get("Content-Type", ""), r.read().decode("utf-8", "replace")


def parse_body(content_type: str, body: str) -> object | None:
    """The JSON of a response whose type says that it is JSON or bytes; else None."""
    if not any(x in content_type for x in ACCEPTED):
        return None
    try:
        return json.loads(body.strip())
    except ValueError:
        return None


def fetch_project(project_id: int, metadata_base: str, project_base: str, get: Get = http_get) -> tuple[str | None, str | None]:
    """(json, error) of one project."""
    try:
        found = parse_body(*get(f"{metadata_base}/{project_id}", TIMEOUT))
        if isinstance(found, dict) and (token := found.get("project_token")):
            found = parse_body(*get(f"{project_base}/{project_id}?token={token}", TIMEOUT))
        return (json.dumps(found), None) if isinstance(found, dict) else (None, "no JSON object")
    except Exception as e:  # one project's trouble, whatever it is, stays with it
        return None, f"{type(e).__name__}: {e}"


def paced(get: Get, per_second: float) -> Get:
    """get, called for each host no more often than that; a caller waits until its turn."""
    ready: dict[str, float] = {}

    def wait(url: str, timeout: float) -> tuple[str, str]:
        host = urlsplit(url).netloc
        now = time.monotonic()
        turn = max(now, ready.get(host, now))
        ready[host] = turn + 1 / per_second
        time.sleep(turn - now)
        return get(url, timeout)

    return wait


def fetch_projects(
    ids: DataFrame, metadata_base: str, project_base: str, get: Get = http_get, partitions: int | None = None, per_second: float | None = None
) -> DataFrame:
    """(project_id, json, error) of ids' project_id; partitions bounds the requests at a time, per_second those that a task sends to a host."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        send = paced(get, per_second) if per_second else get
        for batch in batches:
            own = batch.column("project_id").to_pylist()
            found = [fetch_project(i, metadata_base, project_base, send) for i in own]
            yield pa.RecordBatch.from_arrays(
                [pa.array(own, pa.int64()), pa.array([x for x, _ in found], pa.string()), pa.array([e for _, e in found], pa.string())], ["project_id", "json", "error"]
            )

    ids = ids.select("project_id")
    return (ids.repartition(partitions) if partitions else ids).mapInArrow(run, SCHEMA)


def fetch_missing(ids: DataFrame, path: str, metadata_base: str, project_base: str, wave_rows: int = WAVE_ROWS, **how) -> DataFrame:
    """fetch_projects() of those ids only whose project isn't in the table at path yet; the table is committed wave by wave.

    Projects that failed are fetched again by the next run. The result is what the table has of ids; how goes to fetch_projects().
    """
    return fill(ids.select("project_id"), "project_id", path, SCHEMA, lambda some: fetch_projects(some, metadata_base, project_base, **how), wave_rows)


def stream_projects(ids: DataFrame, path: str, checkpoint: str, metadata_base: str, project_base: str, available_now: bool = False, **how) -> StreamingQuery:
    """fetch_missing() of a stream of ids: each micro-batch adds what is missing to the table at path.

    The checkpoint holds the offsets in ids; a batch that is run again after a failure finds what it had committed in the table.
    """

    def add(batch: DataFrame, _: int) -> None:
        fetch_missing(batch, path, metadata_base, project_base, **how)

    writer = ids.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


class _Part(InputPartition):
    def __init__(self, ids: list[int]):
        self.ids = ids


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.ids = [int(x) for x in options.get("ids", "").split(",") if x.strip()]
        self.bases = options.get("metadata_base", ""), options.get("project_base", "")
        self.parts = max(1, int(options.get("partitions", "1")))

    def partitions(self):
        return [_Part(self.ids[k :: self.parts]) for k in range(min(self.parts, max(1, len(self.ids))))]

    def read(self, part):
        for i in part.ids:
            yield (i, *fetch_project(i, *self.bases))


class ProjectSource(DataSource):
    """spark.dataSource.register(ProjectSource); spark.read.format("projects").option("ids", "1,2").option("metadata_base", ...)."""

    @classmethod
    def name(cls) -> str:
        return "projects"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)
