"""WARC archives of captures, and an external merge of their indexes into globally ordered capture histories.

Archives are written by Spark's own text sink, so they go to whatever store the path names: every record is a gzip
member of its own, and the "line separator" is an empty gzip member. A part file is thus an ordinary .warc.gz, and can
be split between members when it is read back.

Reading checks each payload against its digest and yields runs of index rows sorted by (URL key, timestamp, page).
The runs are stored, dealt into ranges of that key, and in each range merged by a tree of losers.

Payloads of `least` bytes or more that occur more than once are stored once: the capture with the largest page id is
the response, the others are revisits of it. Only digests are grouped; records travel compressed.

The rows have no time of capture, so one is made from the page id: so many seconds after the start of 2024, modulo
1,000,000,000; null counts as 0. Equal times of one URL are ordered by page id.

Defined cases: null html is an empty payload, a null url an empty key; a null page id is never a response while the
group has an id; repeated rows of the responding page are responses too, each a record with an id of its own; an empty table gives empty archives.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from datetime import UTC, datetime, timedelta
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm.shared import chunks, materialize, named, new_path

#: An empty gzip member, as the separator of members.
EMPTY_MEMBER = gzip.compress(b"", mtime=0)
#: Rows of a range's runs that are Python objects at a time, over all runs.
HEADS = 20_000
FIRST_CAPTURE = datetime(2024, 1, 1, tzinfo=UTC)
INDEX = "url_key string, captured string, page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
RUN = f"run bigint, seq int, {INDEX}"


def url_key(url: str) -> str:
    """The sort-friendly form of a URL: host labels reversed, then the lower-cased rest; equal for www. and plain hosts."""
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or "").removeprefix("www."), parts.port
    except ValueError:
        return url.strip().lower()
    path = (parts.path or "/").lower() + (f"?{parts.query.lower()}" if parts.query else "")
    return ",".join(reversed(host.split("."))) + (f":{port}" if port else "") + ")" + path


def record_id(kind: str, page: int | None, url: str, number: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{kind}/{page}/{number}/{url}')}>"


def record(kind: str, page: int | None, url: str, captured: str, payload: bytes, n: int, sha1: str, refers_to: int | None, number: int) -> bytes:
    """One WARC/1.1 record as a gzip member; a revisit has the response's headers only. number tells repeated rows apart."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(kind, page, url, number)}", f"WARC-Date: {captured}",
        f"WARC-Target-URI: {' '.join(url.split())}", f"WARC-Payload-Digest: sha1:{sha1}", f"X-Payload-Length: {n}", f"X-Page-ID: {'' if page is None else page}",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-ID: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    out = zlib.compressobj(4, zlib.DEFLATED, 31)
    return out.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + out.flush()


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and payload of a record; raises if it is damaged."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[:int(headers["content-length"])]
    if not lines[0].startswith("WARC/") or rest[len(block):] != b"\r\n\r\n":
        raise ValueError(f"damaged record {headers.get('warc-record-id')}")
    payload = block.partition(b"\r\n\r\n")[2]
    if headers["warc-type"] == "response" and hashlib.sha1(payload).hexdigest() != headers["warc-payload-digest"].removeprefix("sha1:"):
        raise ValueError(f"payload of {headers['warc-record-id']} differs from its digest")
    return headers, payload


def _captured(page: int | None) -> str:
    return (FIRST_CAPTURE + timedelta(seconds=(page or 0) % 1_000_000_000)).strftime("%Y-%m-%dT%H:%M:%SZ")


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 1000) -> None:
    """Write one record per row of pages under path; part files are .warc.gz archives by content."""
    plain = pages.select(named(id_col).cast("bigint").alias("page"), F.coalesce(named(url_col), F.lit("")).alias("url"), F.coalesce(named(html_col), F.lit("")).cast("binary").alias("body"))
    digest = F.sha1("body").alias("digest")
    groups = plain.filter(F.octet_length("body") >= least).select("page", digest).groupBy("digest").agg(F.max("page").alias("winner"), F.count("*").alias("n")).filter("n > 1").select("digest", "winner")

    def records(batches):
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in chunks(batch, "body"):
                rows = [(r["page"], r["url"], _captured(r["page"]), len(r["body"]), hashlib.sha1(r["body"]).hexdigest(), r["body"]) for r in part.to_pylist()]
                out = [record("response", p, u, c, body, n, d, None, number + i) for i, (p, u, c, n, d, body) in enumerate(rows)]
                number += len(rows)
                yield pa.RecordBatch.from_arrays([part.column("page"), part.column("url"), pa.array([r[3] for r in rows], pa.int64()), pa.array([r[4] for r in rows]), pa.array(out, pa.binary())], names=["page", "url", "n", "digest", "member"])

    def settle(batches):
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                original = r["winner"] is None or r["winner"] == r["page"]
                out.append(r["member"] if original else record("revisit", r["page"], r["url"], _captured(r["page"]), b"", r["n"], r["digest"], r["winner"], number))
                number += 1
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    made = plain.mapInArrow(records, "page bigint, url string, n bigint, digest string, member binary")
    # Small payloads have no other record to refer to, however often they occur: each gets a key of its own.
    key = F.when(F.col("n") >= least, F.col("digest")).otherwise(F.monotonically_increasing_id().cast("string"))
    settled = made.withColumn("key", key).join(groups.withColumnRenamed("digest", "key").hint("merge"), "key", "left").select("page", "url", "n", "digest", "member", "winner").mapInArrow(settle, "value binary")
    # The sink writes the bytes of the value as they are, whatever they decode to.
    settled.select(F.col("value").cast("string")).write.option("lineSep", EMPTY_MEMBER.decode("latin-1")).option("encoding", "ISO-8859-1").text(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Index rows of the archives under path, as sorted runs: one for each batch a task reads."""
    members = spark.read.option("lineSep", EMPTY_MEMBER.decode("latin-1")).option("encoding", "ISO-8859-1").text(path).select(F.col("value").cast("binary").alias("member"))

    def runs(batches):
        task = TaskContext.get().partitionId()
        number = 0
        for batch in batches:
            rows = []
            for member in batch.column("member"):
                h, _ = parse(member.as_py())
                refers = h.get("x-refers-to-page-id")
                rows.append((url_key(h["warc-target-uri"]), h["warc-date"], int(h["x-page-id"]) if h["x-page-id"] else None, int(h["x-payload-length"]), h["warc-payload-digest"].removeprefix("sha1:"), h["warc-type"], int(refers) if refers else None))
            rows.sort(key=order)
            columns = [pa.array(list(x), t) for x, t in zip(zip(*rows, strict=True) if rows else [()] * 7, INDEX_TYPES, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([task << 32 | number] * len(rows), pa.int64()), pa.array(range(len(rows)), pa.int32()), *columns], names=["run", "seq", *INDEX_NAMES])
            number += 1

    return members.mapInArrow(runs, RUN)


INDEX_NAMES = [x.split()[0] for x in INDEX.split(", ")]
INDEX_TYPES = [pa.int64() if x.endswith("bigint") else pa.string() for x in INDEX.split(", ")]


def order(row: tuple) -> tuple:
    return row[0], row[1], row[2] is not None, row[2] or 0


def merge_runs(runs: list):
    """Merge sorted iterables by a tree of losers: each step replays one path from a leaf to the root."""
    feeds = [iter(x) for x in runs]
    heads = [next(f, None) for f in feeds]
    keys = [None if x is None else order(x) for x in heads]
    k = len(feeds)

    def beats(a: int, b: int) -> bool:
        """Whether feed a goes before feed b; an exhausted feed goes last, equal keys by feed."""
        if keys[a] is None or keys[b] is None:
            return keys[b] is None and (keys[a] is not None or a < b)
        return (keys[a], a) < (keys[b], b)

    losers = [-1] * max(k, 1)
    for leaf in range(k):
        winner, node = leaf, (leaf + k) // 2
        while node and losers[node] >= 0:
            if beats(losers[node], winner):
                winner, losers[node] = losers[node], winner
            node //= 2
        losers[node] = winner  # an empty node waits for the winner of its other side; node 0 holds the champion
    while k and keys[top := losers[0]] is not None:
        yield heads[top]
        heads[top] = next(feeds[top], None)
        keys[top] = None if heads[top] is None else order(heads[top])
        winner, node = top, (top + k) // 2
        while node:
            if beats(losers[node], winner):
                winner, losers[node] = losers[node], winner
            node //= 2
        losers[0] = winner


def merged_index(runs: DataFrame, ranges: int | None = None, range_bytes: int = 64 << 20) -> DataFrame:
    """The runs (a stored table) as one globally ordered index: ranges in order, each merged from its runs.

    By default there are so many ranges that one has about `range_bytes`. A range's runs are held as Arrow columns, and
    only the next few rows of each as Python objects.
    """
    if ranges is None:
        size = runs.agg(F.sum(F.coalesce(F.octet_length("url_key"), F.lit(0)) + 160)).first()[0] or 0
        ranges = max(int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // range_bytes))
    dealt = runs.repartitionByRange(ranges, "url_key", "captured", "page_id").sortWithinPartitions("run", "seq")

    def feed(slices: list, most: int):
        for part in slices:
            for a in range(0, part.num_rows, most):
                yield from zip(*[c.to_pylist() for c in part.slice(a, most).columns], strict=True)

    def merge(batches):
        held: dict[int, list[pa.RecordBatch]] = {}
        for batch in batches:
            run = batch.column("run").to_numpy()
            cuts = (np.flatnonzero(run[1:] != run[:-1]) + 1).tolist()
            columns = batch.select(INDEX_NAMES)
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                if a < b:
                    held.setdefault(int(run[a]), []).append(columns.slice(a, b - a))
        out: list = []
        for row in merge_runs([feed(x, max(1, HEADS // len(held))) for x in held.values()]):
            out.append(row)
            if len(out) == 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), INDEX_TYPES, strict=True)], names=INDEX_NAMES)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), INDEX_TYPES, strict=True)], names=INDEX_NAMES)

    return dealt.mapInArrow(merge, INDEX)


def capture_index(pages: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Write pages as archives under path (default: a new folder in the shared one), read them back, merge their indexes."""
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    write_archives(pages, path, **options)
    return merged_index(materialize(read_runs(spark, path), "runs"))


def op6(spark, sf_dir: str) -> DataFrame:
    return capture_index(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
w AS (SELECT d, max(page_id) AS winner FROM p WHERE n >= 1000 GROUP BY d)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
       CASE WHEN winner IS NULL OR winner = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN winner <> page_id THEN winner END AS refers_to
FROM p LEFT JOIN w USING (d)
"""
