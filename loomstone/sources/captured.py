"""A data source over captured pages of paged sources: ``spark.read.format("captured_pages")``.

A capture is a Parquet table (source, query, page, status, items, last, body) in folders by source and query, a row for each page
as it was answered; ``capture`` writes it. Reading replays each query's scan: pages in order, at most as many items as the
source's cap, until a page is short, empty or broken. The option ``table`` tells what comes out:

* ``items`` (default): the items that fit the source's schema and business filter, a row each;
* ``rejects``: those that don't, with what is wrong;
* ``scans``: a row for each query: received, kept and rejected items, whether the cap cut the scan short, and the failure if any.

A task reads a range of pages of one query, so a query of any size is spread. What its earlier pages had is told by a column
of counts, without their bodies. Filters on source and query choose folders; those on title, city and mode are applied while
items are read (``spark.sql.python.filterPushdown.enabled``, which ``register`` sets), after the cap, as a filter has to be.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringContains
from pyspark.sql.types import StructType

from ..functions.text import plain_normalize
from .schemas import CHECKED, ENVELOPES, PAGES

SCHEMAS = {
    "items": "source string, query string, page int, pos long, source_id string, title string, city string, mode string, payload string",
    "rejects": "source string, query string, page int, pos long, kind string, problem string, payload string",
    "scans": "source string, query string, received long, kept long, schema_rejected long, business_rejected long, truncated boolean, failure string",
}
CAPTURE = "source string, query string, page int, status int, items int, last boolean, body string"
#: Pages of a query that a task reads.
PAGES_PER_TASK = 200
#: Columns whose filters the reader applies itself.
FOLDERS, ITEM_FIELDS = ("source", "query"), ("title", "city", "mode")


def register(spark: SparkSession) -> None:
    """Make the format known to a session, with filters pushed down to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CapturedPages)


def capture(pages: DataFrame, path: str) -> None:
    """Write answered pages (source, query, page, status, body) as a capture; the number of items is null where the body isn't the source's envelope, and a source may say which page is its last."""
    items = F.lit(None).cast("int")
    for source, (at, _) in ENVELOPES.items():
        listed = F.get_json_object("body", f"$.{at}") if at else F.col("body")
        items = F.when(F.col("source") == source, F.json_array_length(listed)).otherwise(items)
    last = F.coalesce(F.get_json_object("body", "$.last") == "true", F.lit(False))
    whole = pages.withColumns({"items": items, "last": last}).select(*(c.split()[0] for c in CAPTURE.split(", ")))
    whole.repartitionByRange("source", "query", "page").sortWithinPartitions("source", "query", "page").write.partitionBy("source", "query").parquet(path)


def request_parameters(source: str, page: int, title: str | None = None, city: str | None = None, kind: str | None = None, remote: bool | None = None, cap: int | None = None) -> dict[str, str]:
    """What a page is asked for with; filters that the source applies itself are among it."""
    rules = PAGES[source]
    given: dict[str, str | None] = {}
    if source == "gupy":
        rest = (cap or rules.cap) - page * rules.size
        given = {"jobName": title, "city": city, "type": kind, "isRemoteWork": None if remote is None else str(remote).lower(), "limit": str(min(rules.size, rest)), "offset": str(page * rules.size)}
    elif source == "solides":
        given = {"title": title or "", "locations": rules.cities.get(city, city) if city else None, "take": str(rules.size), "page": str(page + 1)}
    elif source == "ciee":  # can't filter
        given = {"page": str(page), "size": str(rules.size)}
    return {k: v for k, v in given.items() if v is not None and (v != "" or k == "title")}


# --- items


def _fits(value: object, kind: str) -> bool:
    """Whether a value is of a kind; ``?`` at the end also allows null."""
    if kind.endswith("?"):
        return value is None or _fits(value, kind[:-1])
    number = isinstance(value, int | float) and not isinstance(value, bool)
    return {"text": isinstance(value, str), "number": number, "id": number or isinstance(value, str), "flag": isinstance(value, bool), "texts": isinstance(value, list) and all(isinstance(x, str) for x in value), "object": isinstance(value, dict)}[kind]


def schema_problem(source: str, item: object) -> str | None:
    """The first thing wrong with an item, None if it fits: a missing field that is required, or one of another kind."""
    if not isinstance(item, dict):
        return "(item): not an object"
    for field, kind in CHECKED.get(source, {}).items():
        *outer, name = field.split(".")
        at: object = item
        for part in outer:
            at = at.get(part) if isinstance(at, dict) else None
        if not isinstance(at, dict):
            continue
        required = kind.endswith("!")
        if name not in at:
            if required:
                return f"{field}: missing"
        elif not _fits(at[name], kind.rstrip("!")):
            return f"{field}: not of kind {kind.rstrip('!').rstrip('?')}"
    return None


def _text(item: dict, field: str | None) -> str | None:
    at: object = item
    for part in (field or "").split("."):
        at = at.get(part) if isinstance(at, dict) else None
    return at if isinstance(at, str) else None


def _id(value: object) -> str:
    return str(int(value)) if isinstance(value, float) and value.is_integer() else str(value)


@dataclass(frozen=True)
class Wanted:
    """The business filter of a source that can't filter: levels, and parts of the normalised city and area."""

    levels: tuple[str, ...]
    city: str
    area: str

    def refuses(self, item: dict) -> str | None:
        if self.levels and (item.get("nivelEscolar") or "") not in self.levels:
            return "level"
        for term, field in ((self.city, "local.cidade"), (self.area, "areaProfissional")):
            if term and plain_normalize(term) not in plain_normalize(_text(item, field) or ""):
                return field
        return None


# --- scans


@dataclass(frozen=True)
class Pages(InputPartition):
    """A range of pages of one query, of whose folder it has the place."""

    source: str
    query: str
    folder: str
    first: int
    end: int


@dataclass
class Scan:
    """How a query's scan goes: items taken of each page, and how it ends."""

    taken: dict[int, tuple[int, int]]
    received: int = 0
    truncated: bool = False
    failure: str | None = None


def plan_scan(source: str, pages: list[tuple[int, int, int | None, bool]], cap: int) -> Scan:
    """Replays a scan from (page, status, items, last) in order of the page. taken: page -> (position of its first item, number of items).

    The cap bounds items seen, not items kept, so that a source whose items get worse isn't asked for more. A scan cut
    short by the cap is truncated where the last page was full or had more than was asked of it.
    """
    rules, scan = PAGES[source], Scan({})
    expected = pages[0][0] if pages else 0
    for page, status, items, last in pages:
        if scan.received >= cap:
            break
        if page != expected:
            scan.failure = f"page {expected} was not captured"
            break
        if not 200 <= status < 300:
            scan.failure = f"page {page} was answered with {status}"
            break
        if items is None:
            scan.failure = f"page {page} isn't the source's envelope"
            break
        if items == 0:
            break
        rest = cap - scan.received
        asked = min(rules.size, rest) if rules.asks_rest else rules.size
        take = min(items, rest, asked) if rules.asks_rest else min(items, rest)
        scan.taken[page] = scan.received, take
        scan.truncated = not rules.asks_rest and items > rest
        scan.received += take
        if last or (take if rules.asks_rest else items) < asked:
            break
        scan.truncated = scan.truncated or scan.received >= cap
        expected = page + 1
    return scan


def _files(path: str):
    """(file system, path) of a folder; a path without a scheme is local."""
    import pyarrow.fs as pafs

    return pafs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


class CapturedPages(DataSource):
    """The format ``captured_pages``. Options: path, table, max_results (in place of each source's cap), pages_per_task, levels, city, area."""

    @classmethod
    def name(cls) -> str:
        return "captured_pages"

    def schema(self) -> str:
        table = self.options.get("table", "items")
        if table not in SCHEMAS:
            raise ValueError(f"table: one of {', '.join(SCHEMAS)}")
        return SCHEMAS[table]

    def reader(self, schema: StructType) -> CapturedReader:
        return CapturedReader(dict(self.options))


class CapturedReader(DataSourceReader):
    """Plans page ranges and reads them."""

    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.table = options.get("table", "items")
        self.cap = int(options["max_results"]) if "max_results" in options else None
        self.per_task = int(options.get("pages_per_task", PAGES_PER_TASK))
        levels = options.get("levels", "SU")
        self.wanted = Wanted(tuple(x for x in levels.split(",") if x), options.get("city", ""), options.get("area", ""))
        self.equal: list[tuple[str, frozenset]] = []
        self.parts: list[tuple[str, str]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Takes over equality and membership on folders and item fields, and parts of these fields; the rest stays with Spark."""
        own = FOLDERS + (ITEM_FIELDS if self.table == "items" else ())
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in own and isinstance(f, EqualTo):
                self.equal.append((column, frozenset([f.value])))
            elif column in own and isinstance(f, In):
                self.equal.append((column, frozenset(f.value)))
            elif column in own and column in ITEM_FIELDS and isinstance(f, StringContains):
                self.parts.append((column, f.value))
            else:
                yield f

    def _passes(self, row: dict[str, str | None]) -> bool:
        whole = all(row[c] is not None and row[c] in values for c, values in self.equal if c in row)
        return whole and all(row[c] is not None and part in row[c] for c, part in self.parts)

    def partitions(self) -> list[Pages]:
        """Ranges of pages of the queries that the filters leave. One range for all of a query's pages where scans are asked for."""
        import pyarrow.dataset as ds
        import pyarrow.fs as pafs

        fs, root = _files(self.path)
        found = []
        folders = lambda at, key: [(unquote(x.base_name.split("=", 1)[1]), x.path) for x in fs.get_file_info(pafs.FileSelector(at)) if x.type == pafs.FileType.Directory and x.base_name.startswith(key + "=")]
        for source, at in sorted(folders(root, "source")):
            if source not in PAGES:
                continue
            for query, folder in sorted(folders(at, "query")):
                named = {"source": source, "query": query}
                if not all(named[c] in values for c, values in self.equal if c in FOLDERS):
                    continue
                pages = ds.dataset(folder, filesystem=fs, format="parquet").count_rows()
                cap = self.cap if self.cap is not None else PAGES[source].cap
                pages = min(pages, cap)  # a page that is read has an item at least
                step = max(1, pages) if self.table == "scans" else self.per_task
                found += [Pages(source, query, folder, i, min(i + step, pages)) for i in range(0, max(1, pages), step)]
        return found or [Pages("", "", "", 0, 0)]

    def read(self, part: Pages) -> Iterator[pa.RecordBatch]:
        """Rows of a page range, a batch for some pages at a time."""
        if not part.folder:
            return
        import pyarrow.dataset as ds

        fs, _ = _files(self.path)
        pages = ds.dataset(part.folder, filesystem=fs, format="parquet")
        counts = pages.to_table(columns=["page", "status", "items", "last"]).sort_by("page").to_pylist()
        told = [(r["page"], r["status"], r["items"], bool(r["last"])) for i, r in enumerate(counts) if not i or r["page"] != counts[i - 1]["page"]]
        scan = plan_scan(part.source, told, self.cap if self.cap is not None else PAGES[part.source].cap)
        mine = [p for p, *_ in told[part.first : part.end] if p in scan.taken]
        totals = {"kept": 0, "schema": 0, "business": 0}
        names = [c.split()[0] for c in SCHEMAS[self.table].split(", ")]
        schema = pa.schema([(n, {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_()}.get(c.split()[1], pa.string())) for n, c in zip(names, SCHEMAS[self.table].split(", "), strict=True)])
        for at in range(0, len(mine), 20):
            some = mine[at : at + 20]
            bodies = pages.to_table(columns=["page", "body"], filter=(ds.field("page") >= some[0]) & (ds.field("page") <= some[-1])).sort_by("page").to_pylist()
            rows: list[dict] = []
            seen: set[int] = set()
            for body in bodies:
                if body["page"] not in seen and body["page"] in scan.taken:
                    seen.add(body["page"])
                    rows += self._page(part, body["page"], body["body"], *scan.taken[body["page"]], totals)
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
        if self.table == "scans":
            row = {"source": part.source, "query": part.query, "received": scan.received, "kept": totals["kept"], "schema_rejected": totals["schema"], "business_rejected": totals["business"], "truncated": scan.truncated, "failure": scan.failure}
            yield pa.RecordBatch.from_pylist([row], schema=schema)

    def _page(self, part: Pages, page: int, body: str, first: int, take: int, totals: dict[str, int]) -> list[dict]:
        """Rows of a page's taken items, and their numbers added to the totals."""
        at, key = ENVELOPES[part.source]
        items = json.loads(body)
        for name in filter(None, at.split(".")):
            items = items[name]
        fields = PAGES[part.source]
        rows = []
        for i, item in enumerate(items[:take]):
            problem = schema_problem(part.source, item)
            kind = "schema" if problem else None
            if not problem and fields.filtered_here:
                problem = self.wanted.refuses(item)
                kind = "business" if problem else None
            totals[kind or "kept"] += 1
            place = {"source": part.source, "query": part.query, "page": page, "pos": first + i}
            if self.table == "rejects" and problem:
                rows.append(place | {"kind": kind, "problem": problem, "payload": json.dumps(item, ensure_ascii=False)})
            elif self.table == "items" and not problem:
                row = {"title": _text(item, fields.title), "city": _text(item, fields.city), "mode": _text(item, fields.mode) if fields.mode else None}
                if self._passes(row):
                    rows.append(place | row | {"source_id": _id(item[key]), "payload": json.dumps(item, ensure_ascii=False)})
        return rows
