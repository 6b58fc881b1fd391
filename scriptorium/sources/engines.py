"""Search engines as plug-ins: a Python data source that calls a registered engine for each query of its options.

No engine here opens a connection; a user registers functions of their own. An unknown name is the mock engine.
"""

from __future__ import annotations

import json
import time
import zlib
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "query string, engine string, pos int, title string, url string, snippet string, score double"
Engine = Callable[[str, int], list[dict]]
ENGINES: dict[str, Engine] = {}
# Statuses that are asked again, the scores of engines' rows, and what a page may take.
RETRIED, SCORES, MOST_PAGES = (403, 429, 503), {"duckduckgo": 0.7, "sogou": 0.8, "360": 0.8, "bing": 0.8, "mock": 0.5}, 20


def register(name: str, engine: Engine) -> None:
    ENGINES[name] = engine


def mock(query: str, most: int) -> list[dict]:
    return [{"title": f"Result for {query}", "url": f"https://example.com/search?q={query}", "snippet": ""}][:most]


def source_of(known: dict[str, Engine]) -> type[DataSource]:
    """A data source class that carries ``known`` to the executors, where this module's registry is empty."""

    class Query(InputPartition):
        def __init__(self, query: str) -> None:
            self.query = query

    class Reader(DataSourceReader):
        def __init__(self, options: dict) -> None:
            self.queries, self.engines, self.most = json.loads(options["queries"]), json.loads(options["engines"]), int(options.get("most", 10))

        def partitions(self) -> list[InputPartition]:
            return [Query(q) for q in self.queries]

        def read(self, partition: InputPartition) -> Iterator[tuple]:
            for name in self.engines:
                for pos, row in enumerate(known.get(name, mock)(partition.query, self.most)[: self.most]):
                    yield partition.query, name, pos, row.get("title", ""), row.get("url", ""), row.get("snippet", ""), float(row.get("score", SCORES.get(name, 0.5)))

    class SearchSource(DataSource):
        """A row for each result of each engine; a task for each query."""

        @classmethod
        def name(cls) -> str:
            return "search"

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> DataSourceReader:
            return Reader(self.options)

    return SearchSource


def search(spark: SparkSession, queries: list[str], engines: list[str], most: int = 10) -> DataFrame:
    """Rows of all engines for a few queries, at most ``most`` of each engine and query."""
    spark.dataSource.register(source_of({name: ENGINES.get(name, mock) for name in engines}))
    return spark.read.format("search").options(queries=json.dumps(queries), engines=json.dumps(engines), most=str(most)).load()


def fetched(urls: DataFrame, fetch: Callable[[str, dict], tuple[int, str]], agents: tuple[str, ...], retry: int = 2, pause: float = 0.0) -> DataFrame:
    """(url, status, attempts, html) by a user's ``fetch(url, headers)``: refused and failed pages again, other statuses not, the agent changing by URL and attempt."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for url in batch.column("url").to_pylist():
                at = zlib.crc32((url or "").encode())
                status, html, attempt = 0, None, 0
                for attempt in range(retry + 1):
                    try:
                        status, html = fetch(url, {"User-Agent": agents[(at + attempt) % len(agents)]})
                    except Exception:
                        status, html = 0, None
                    if status == 200 or status and status not in RETRIED:
                        break
                    time.sleep(pause)
                rows.append((url, status, attempt + 1, html if status == 200 else None))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int32(), pa.int32(), pa.string()))], names=["url", "status", "attempts", "html"])

    return urls.select(F.col("url").cast("string").alias("url")).mapInArrow(run, "url string, status int, attempts int, html string")
