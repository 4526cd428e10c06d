"""WARC archives of pages, and capture histories by external index merge.

Archives are written by Spark's text writer and read by its text reader, so any
file system that Spark knows will do and a file is split among tasks.  What
separates records there is the version line together with the first header, which
names the archive's own warcinfo record: a random id that no payload can hold, as
it is drawn after the payloads were made.  Index entries of what was read are sorted into
runs of bounded size; runs are cut at range bounds, and each range is merged from
its runs by a loser tree on URL key and time.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import re
import uuid
from bisect import bisect_right
from collections import deque
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.plans.joins import attach
from skein.plans.scratch import materialize, new_path
from skein.plans.ship import map_batches

VERSION = "WARC/1.1\r\n"
#: What a revisit record is one of.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads shorter than this are always written in full.
LEAST_REVISIT = 100
#: Index entries of a run, and of a piece of a run that travels as one row.
RUN_ROWS, PIECE_ROWS = 100_000, 256
#: URLs that range bounds are taken from; they only balance the ranges.
BOUND_SAMPLE = 4_000
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_CAPTURE = pa.struct([("urlkey", pa.string()), ("time", pa.string()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string())])
_CAPTURE_SQL = "struct<urlkey:string,time:string,page_id:bigint,payload_bytes:bigint,payload_digest:string,record_type:string,refers_to:bigint,url:string>"


def url_key(url: str) -> str:
    """Sortable key of a URL: host labels from the last on, then path and query in lower case."""
    m = re.match(r"(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)(?::\d+)?([^#]*)", url, re.I)
    if not m:
        return url.lower()
    host = m[1].lower().removeprefix("www.")
    return ",".join(reversed(host.split("."))) + ")" + (m[2].lower() or "/")


def separator(archive_id: str) -> str:
    """What every record but the warcinfo records begins with."""
    return f"{VERSION}WARC-Warcinfo-ID: <urn:uuid:{archive_id}>\r\n"


def _stamp(page_id: str) -> Column:
    return F.date_format(F.timestamp_seconds(F.coalesce(F.pmod(page_id, F.lit(4_000_000_000)), F.lit(0)) + 1_577_836_800), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def _record_id(page_id: str, url: str, digest: str) -> Column:
    name = F.md5(F.concat_ws("|", F.coalesce(F.col(page_id).cast("string"), F.lit("")), url, digest))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", name.substr(1, 8), name.substr(9, 4), name.substr(13, 4), name.substr(17, 4), name.substr(21, 12)), F.lit(">"))


def _safe(url: str) -> Column:
    return F.regexp_replace(F.regexp_replace(url, "\n", "%0A"), "\r", "%0D")


def _header(name: str, value: Column) -> Column:
    """A header line, or nothing if the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n")), F.lit(""))


def records(pages: DataFrame, archive_id: str, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row for each page: ``value`` string, a whole WARC record up to its last line end.

    The payload is the html in UTF-8 as it is.  Of pages with equal payloads of
    LEAST_REVISIT bytes or more, those with the smallest id are responses and the
    others revisits of that one (the smallest URL's, if the id repeats).  Rows
    without id are responses.  The capture time is the page id in seconds after
    2020.  The first row of each task, and so of each file, begins with a
    warcinfo record.
    """
    payload = F.coalesce(F.col(html), F.lit(""))
    source = pages.select(F.col(page_id).cast("long").alias("page_id"), F.coalesce(F.col(url), F.lit("")).alias("url"), payload.alias("html")).withColumns({"size": F.octet_length(F.col("html")).cast("long"), "digest": F.sha2(F.col("html"), 256)})
    groups = source.where(f"size >= {LEAST_REVISIT} and page_id is not null").groupBy("digest").agg(F.min(F.struct("page_id", "url")).alias("first"), F.max("page_id").alias("last")).where("first.page_id < last")
    repeated = materialize(groups.select("digest", F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url")), "repeated")
    known = attach(source, repeated, ["digest"])
    revisit = (F.col("first_id") < F.col("page_id")) & (F.col("size") >= LEAST_REVISIT)
    for_revisit = lambda c: F.when(revisit, c)
    block = F.concat(F.lit(_HTTP), F.when(F.coalesce(revisit, F.lit(False)), F.lit("")).otherwise(F.col("html")))
    headers = [
        _header("WARC-Type", F.coalesce(for_revisit(F.lit("revisit")), F.lit("response"))), _header("WARC-Record-ID", _record_id("page_id", "url", "digest")), _header("WARC-Date", _stamp("page_id")),
        _header("WARC-Target-URI", F.when(F.col("url") != "", _safe("url"))), _header("X-Target-URI-Base64", F.when(F.col("url").rlike(r"[\r\n]|^\s|\s$"), F.regexp_replace(F.base64(F.encode("url", "UTF-8")), r"\s", ""))),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")), _header("X-Page-Id", F.col("page_id")),
        _header("WARC-Profile", for_revisit(F.lit(PROFILE))), _header("WARC-Refers-To", for_revisit(_record_id("first_id", "first_url", "digest"))),
        _header("WARC-Refers-To-Target-URI", for_revisit(F.when(F.col("first_url") != "", _safe("first_url")))), _header("WARC-Refers-To-Date", for_revisit(_stamp("first_id"))), _header("X-Refers-To-Page-Id", for_revisit(F.col("first_id"))),
        _header("Content-Type", F.lit("application/http; msgtype=response")), _header("Content-Length", F.octet_length(block)),
    ]
    fields = "software: skein\r\nformat: WARC File Format 1.1\r\n"
    now = datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    info = f"{VERSION}WARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{archive_id}>\r\nWARC-Date: {now}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(fields)}\r\n\r\n{fields}\r\n\r\n"
    # The lower 33 bits count the rows of a task.
    first = F.when(F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0, info).otherwise("")
    return known.select(F.concat(first, F.lit(separator(archive_id)), *headers, F.lit("\r\n"), block, F.lit("\r\n\r")).alias("value"))


def write_archives(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html") -> str:
    """Write the pages' records as uncompressed WARC files under ``path``, a file for each task; returns the archive's id."""
    archive_id = str(uuid.uuid4())
    records(pages, archive_id, page_id, url, html).write.option("lineSep", "\n").text(path)
    return archive_id


def archive_id_of(spark: SparkSession, path: str) -> str | None:
    """The id in the first warcinfo record of the archives under ``path``; null if they are empty."""
    lines = spark.read.option("lineSep", "\r\n").text(path).where(F.col("value").startswith("WARC-Record-ID: <urn:uuid:")).first()
    return lines["value"].removeprefix("WARC-Record-ID: <urn:uuid:").removesuffix(">") if lines else None


def parse_record(data: bytes) -> dict:
    """Index entry of a record without its separator.

    The block is taken by its length; the digest and the length are those of the
    payload that was read, and null (the length) for a revisit, which has none.
    """
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n") if ": " in line)
    length = int(fields["Content-Length"])
    block = rest[:length]
    if rest[length:] != b"\r\n\r\n":
        raise ValueError(f"{fields['WARC-Record-ID']} has another length than it says")
    number = lambda k: int(fields[k]) if fields.get(k) else None
    size, digest = None, fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if fields["WARC-Type"] == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        size = len(payload)
        if digest != hashlib.sha256(payload).hexdigest():
            raise ValueError(f"payload of {fields['WARC-Record-ID']} is damaged")
    url = base64.b64decode(fields["X-Target-URI-Base64"]).decode() if "X-Target-URI-Base64" in fields else fields.get("WARC-Target-URI", "")
    return {"urlkey": url_key(url), "time": fields["WARC-Date"], "page_id": number("X-Page-Id"), "payload_bytes": size, "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": number("X-Refers-To-Page-Id"), "url": url}


def _order(c: dict) -> tuple:
    return c["urlkey"], c["time"], -1 if c["page_id"] is None else c["page_id"], c["record_type"]


class LoserTree:
    """k-way merge of sorted sources: a node keeps the loser of its match, so a step replays one path to the root."""

    def __init__(self, heads: list[tuple | None]) -> None:
        self.k = max(1, len(heads))
        self.keys = list(heads) or [None]
        self.losers = [-1] * self.k
        self.winner = self._play(1)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.keys[a], self.keys[b]
        return x is not None and (y is None or (x, a) <= (y, b))

    def _play(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._play(2 * node), self._play(2 * node + 1)
        win, lose = (a, b) if self._beats(a, b) else (b, a)
        self.losers[node] = lose
        return win

    def replace(self, key: tuple | None) -> None:
        """The winner's source goes on with ``key``; None if it has ended."""
        at = self.winner
        self.keys[at] = key
        node = (at + self.k) // 2
        while node >= 1:
            if self._beats(self.losers[node], at):
                self.losers[node], at = at, self.losers[node]
            node //= 2
        self.winner = at


def merge_runs(pieces: Iterable[tuple[int, list[dict]]], order: Callable[[dict], tuple] = _order) -> Iterator[dict]:
    """Merge sorted runs that arrive as pieces ``(run, entries)`` by their first entry.

    A piece is taken in only when its first entry is due, so one piece of each run
    is held at most.
    """
    pieces = iter(pieces)
    coming = next(pieces, None)
    runs: dict[int, int] = {}
    queues: list[deque] = []
    tree: LoserTree | None = None
    while True:
        while coming is not None and (tree is None or tree.keys[tree.winner] is None or order(coming[1][0]) <= tree.keys[tree.winner]):
            run, entries = coming
            at = runs.setdefault(run, len(queues))
            if at == len(queues):
                queues.append(deque())
            waiting = bool(queues[at])
            queues[at].extend(entries)
            if not waiting:
                tree = LoserTree([order(q[0]) if q else None for q in queues])
            coming = next(pieces, None)
        if tree is None or tree.keys[tree.winner] is None:
            return
        queue = queues[tree.winner]
        yield queue.popleft()
        tree.replace(order(queue[0]) if queue else None)


def _runs(bounds: list[tuple]):
    def cut(buffer: list[dict], run: int) -> pa.RecordBatch:
        buffer.sort(key=_order)
        ranges, firsts, pieces = [], [], []
        at = 0
        while at < len(buffer):
            r = bisect_right(bounds, _order(buffer[at])[:3])
            end = at + 1
            while end < len(buffer) and end - at < PIECE_ROWS and bisect_right(bounds, _order(buffer[end])[:3]) == r:
                end += 1
            ranges.append(r)
            firsts.append(buffer[at])
            pieces.append(buffer[at:end])
            at = end
        return pa.RecordBatch.from_arrays(
            [pa.array(ranges, pa.int32()), pa.array([f["urlkey"] for f in firsts], pa.string()), pa.array([f["time"] for f in firsts], pa.string()), pa.array([-1 if f["page_id"] is None else f["page_id"] for f in firsts], pa.int64()), pa.array([f["record_type"] for f in firsts], pa.string()), pa.array([run] * len(ranges), pa.int64()), pa.array(pieces, pa.list_(_CAPTURE))],
            names=["range", "k1", "k2", "k3", "k4", "run", "piece"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        buffer, n = [], 0
        for b in batches:
            buffer += [parse_record(x) for x in b.column(0).to_pylist()]
            while len(buffer) >= RUN_ROWS:
                yield cut(buffer[:RUN_ROWS], (task << 32) + n)
                buffer, n = buffer[RUN_ROWS:], n + 1
        if buffer:
            yield cut(buffer, (task << 32) + n)

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple[int, int, list[dict]]]:
        for b in batches:
            yield from zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)

    source = rows()
    row = next(source, None)
    while row is not None:
        at = row[0]

        def one_range() -> Iterator[tuple[int, list[dict]]]:
            nonlocal row
            while row is not None and row[0] == at:  # noqa: B023  used up before the next
                yield row[1], row[2]
                row = next(source, None)

        out: list[dict] = []
        n = 0
        for entry in merge_runs(one_range()):
            out.append(entry)
            if len(out) == 4096:
                yield _batch(out, at, n)
                n += len(out)
                out = []
        if out:
            yield _batch(out, at, n)


def _batch(entries: list[dict], at: int, n: int) -> pa.RecordBatch:
    fields = pa.array(entries, _CAPTURE)
    return pa.RecordBatch.from_arrays([pa.array([at] * len(entries), pa.int32()), pa.array(range(n, n + len(entries)), pa.int64()), *fields.flatten()], names=["range", "position", *[f.name for f in _CAPTURE]])


def range_bounds(pages: DataFrame, ranges: int, page_id: str = "page_id", url: str = "url") -> list[tuple]:
    """Bounds that cut the captures into about equal ranges, from a sample of BOUND_SAMPLE pages.

    They include time and id, so one URL's captures may span ranges.
    """
    sample = pages.select(F.coalesce(F.col(url), F.lit("")).alias("url"), F.col(page_id).cast("long").alias("id")).orderBy(F.xxhash64("id", "url")).limit(BOUND_SAMPLE)
    sample = sample.withColumn("time", _stamp("id"))
    keys = sorted((url_key(r["url"]), r["time"], -1 if r["id"] is None else r["id"]) for r in sample.collect())
    return [keys[i * len(keys) // ranges] for i in range(1, ranges)] if keys else []


def read_histories(spark: SparkSession, path: str, bounds: list[tuple], archive_id: str | None = None) -> DataFrame:
    """Capture histories of the archives under ``path``, globally ordered by ``(range, position)``.

    Columns: ``range int, position long`` and the index entry: ``urlkey, time,
    page_id, payload_bytes, payload_digest, record_type, refers_to, url``.
    ``payload_bytes`` of a revisit is null.
    """
    archive_id = archive_id or archive_id_of(spark, path) or ""
    raw = spark.read.option("lineSep", separator(archive_id)).text(path).select(F.col("value").cast("binary").alias("value"))
    # Before the first separator of a file stands its warcinfo record.
    raw = raw.where((F.octet_length("value") > 0) & ~F.col("value").cast("string").startswith(VERSION + "WARC-Type: warcinfo\r\n"))
    runs = raw.transform(map_batches, _runs(bounds), f"range int, k1 string, k2 string, k3 long, k4 string, run long, piece array<{_CAPTURE_SQL}>")
    dealt = runs.repartition(len(bounds) + 1, "range").sortWithinPartitions("range", "k1", "k2", "k3", "k4", "run")
    columns = _CAPTURE_SQL.removeprefix("struct<").removesuffix(">").replace(":", " ")
    return dealt.select("range", "run", "piece").transform(map_batches, _merged, f"range int, position long, {columns}")


def resolve_revisits(histories: DataFrame) -> DataFrame:
    """Histories whose revisits have the length of the response that they refer to and share the digest with; null where there is none."""
    held = materialize(histories, "histories")
    wanted = held.where("record_type = 'revisit'").select(F.col("refers_to").alias("page_id"), "payload_digest").distinct()
    responses = held.where("record_type = 'response'").join(wanted, ["page_id", "payload_digest"], "left_semi").groupBy("page_id", "payload_digest").agg(F.max("payload_bytes").alias("_bytes"))
    responses = materialize(responses.withColumnRenamed("page_id", "refers_to"), "responses")
    return attach(held, responses, ["refers_to", "payload_digest"]).withColumn("payload_bytes", F.coalesce("payload_bytes", "_bytes")).select(histories.columns)


def archive(pages: DataFrame, path: str | None = None, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write pages as WARC, read them back, and return their capture histories.

    A null html is the empty payload, a null URL the empty one, a null id stays
    null.  Repeated rows are repeated captures (of one record id); pages of any
    length and content round-trip; an empty table gives no rows; other columns are
    not written.
    """
    spark = pages.sparkSession
    path = path or new_path(spark, "archives")
    archive_id = write_archives(pages, path, page_id, url, html)
    return resolve_revisits(read_histories(spark, path, range_bounds(pages, int(spark.conf.get("spark.sql.shuffle.partitions")), page_id, url), archive_id))
