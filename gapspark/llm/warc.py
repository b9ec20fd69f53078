"""WARC archives: writing with revisit records, and reading by boundary chains.

Reading cuts a file into byte ranges. A task lists every place in its range where a
record could begin, with the place of the successor its Content-Length gives. Inside
the range the chains are followed at once; what leaves a range is joined to the range
it enters. Pointer jumping over those exits, from each file's start, then tells which
records are reachable. A record header inside a payload has no chain from the start
and is rejected.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapspark.llm.common import open_fs, stored, write_file
from gapspark.session import fresh_path

#: Payload bytes after which a writer closes its file, and bytes of a reading range.
FILE_BYTES = 64_000_000
RANGE_BYTES = 8_000_000
LEAST_REVISIT = 100
VERSION = b"WARC/1.0\r\n"
HEADER_LIMIT = 65_536
#: Longer URLs do not stand in the record's header but in a metadata record before it.
URL_LIMIT = 32_768
#: Reading tasks at most; beyond that each reads more ranges.
MOST_TASKS = 50_000
DATE = "2020-01-01T00:00:00Z"


def record(kind: str, fields: list[tuple[str, str]], payload: bytes) -> bytes:
    head = [("WARC-Type", kind), ("WARC-Date", DATE), *fields, ("Content-Length", str(len(payload)))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in head)
    return VERSION + lines.encode("utf-8") + b"\r\n" + payload + b"\r\n\r\n"


def record_id() -> str:
    return f"<urn:uuid:{uuid.uuid4()}>"


def header_value(text: str) -> str:
    """A URL as one header line: control characters and blanks percent-encoded."""
    return "".join(f"%{ord(c):02X}" if c <= " " or c == "\x7f" else c for c in text)


def digests(df: DataFrame, key: str, html: str, url: str) -> DataFrame:
    payload = F.encode(F.coalesce(F.col(f"`{html}`"), F.lit("")), "UTF-8")
    return df.select(
        F.col(f"`{key}`").cast("long").alias("key"), F.coalesce(F.col(f"`{url}`"), F.lit("")).alias("url"),
        payload.alias("payload"),
    ).withColumns({"digest": F.sha2("payload", 256), "size": F.octet_length("payload").cast("long")})


def revisits(rows: DataFrame, least: int) -> DataFrame:
    """key, digest and the key they refer to, for rows that are not the first of their payload.

    Only keys and digests are shuffled; partial minima keep a payload with many copies
    from gathering anywhere.
    """
    large = rows.where((F.col("size") >= least) & F.col("key").isNotNull()).select("key", "digest")
    first = large.groupBy("digest").agg(F.min("key").alias("refers_to"), F.count(F.lit(1)).alias("n"))
    later = large.join(first.where("n > 1").drop("n"), "digest").where("key <> refers_to")
    return stored(later.distinct(), "warc-revisits")


def write_archives(
    df: DataFrame, folder: str, key: str = "page_id", html: str = "html", url: str = "url", least: int = LEAST_REVISIT
) -> DataFrame:
    """Write a record per row below ``folder``; returns the manifest (file, size, records).

    Of rows with equal payloads of at least ``least`` bytes the one with the smallest key
    is a response, the others are revisit records that name it and hold no payload.
    Rows that share that smallest key are all responses; a row without a key always is
    one. Null payloads are empty. A URL of more than ``URL_LIMIT`` bytes is the payload of
    a metadata record before the page's, of any length. Payloads are not shuffled while the table of revisits
    is small enough for the planner to broadcast, and go through one join beyond it.
    """
    rows = digests(df, key, html, url)
    later = revisits(rows, least).select(F.col("key").alias("__k"), F.col("digest").alias("__d"), "refers_to")
    marked = rows.join(later, (F.col("key") == F.col("__k")) & (F.col("digest") == F.col("__d")), "left")
    chosen = marked.select(
        "key", "url", F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload"), "digest", "size", "refers_to"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        parts: list[bytes] = []
        done: list[tuple[str, int, int]] = []
        size = 0

        def flush():
            nonlocal size
            if parts:
                info = record("warcinfo", [("WARC-Record-ID", record_id()), ("Content-Type", "application/warc-fields")], b"software: gapspark\r\n")
                name = write_file(folder, f"pages-{part:06d}-{len(done):04d}", [info, *parts])
                done.append((name, size + len(info), len(parts)))
                parts.clear()
                size = 0

        for batch in batches:
            for row in batch.to_pylist():
                own_id, made = record_id(), b""
                fields = [("WARC-Record-ID", own_id)]
                uri = header_value(row["url"])
                if len(uri.encode("utf-8")) > URL_LIMIT:
                    told = [("WARC-Record-ID", record_id()), ("WARC-Concurrent-To", own_id), ("Content-Type", "text/uri-list")]
                    made = record("metadata", told, uri.encode("utf-8"))
                elif uri:
                    fields.append(("WARC-Target-URI", uri))
                if row["key"] is not None:
                    fields.append(("X-Page-ID", str(row["key"])))
                fields += [("WARC-Payload-Digest", f"sha256:{row['digest']}"), ("X-Payload-Length", str(row["size"]))]
                if row["refers_to"] is None:
                    made += record("response", fields, row["payload"])
                else:
                    fields.append(("X-Refers-To-Page", str(row["refers_to"])))
                    fields.append(("WARC-Profile", "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"))
                    made += record("revisit", fields, b"")
                parts.append(made)
                size += len(made)
                if size >= FILE_BYTES:
                    flush()
        flush()
        yield pa.RecordBatch.from_arrays(
            [pa.array([d[i] for d in done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))],
            names=["file", "size", "records"],
        )

    return stored(chosen.mapInArrow(run, "file string, size long, records long"), "warc-manifest")


MAGIC = re.compile(rb"WARC/1\.[01]\r\n")
LENGTH = re.compile(rb"^content-length:[ \t]*(\d+)[ \t]*$", re.I | re.M)


def parse_header(data: bytes, at: int) -> tuple[int, int] | None:
    """Start of the payload and its length, if a whole header stands at a place."""
    if MAGIC.match(data, at) is None:
        return None
    end = data.find(b"\r\n\r\n", at, at + HEADER_LIMIT)
    if end < 0:
        return None
    m = LENGTH.search(data[at : end + 2].replace(b"\r\n", b"\n"))
    return (end + 4, int(m[1])) if m else None


def candidates(data: bytes, base: int, limit: int, size: int) -> list[tuple[int, int]]:
    """Places below ``limit`` where a record could begin, with the place after it.

    ``base`` is the file offset of the first byte. A successor beyond the file is no
    record's.
    """
    out = []
    for m in MAGIC.finditer(data, 0, limit - base + len(VERSION) - 1):
        if base + m.start() >= limit:
            break
        found = parse_header(data, m.start())
        if found is not None:
            after = base + found[0] + found[1] + 4
            if after <= size:
                out.append((base + m.start(), after))
    return out


def exits_of(places: list[tuple[int, int]], limit: int) -> dict[int, int]:
    """For each candidate the first place of its chain that is beyond the range.

    Successors lie behind, so one walk from the last candidate is enough; a chain that
    meets a place which is no candidate ends there.
    """
    out: dict[int, int] = {}
    for start, after in reversed(places):
        out[start] = after if after >= limit else out.get(after, -1)
    return out


RANGES = "file string, first long, last long, size long"


def ranges(manifest: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """One row per byte range of every file, spread evenly over tasks."""
    step = F.lit(range_bytes)
    cut = manifest.where("size > 0").select(
        "file", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, step.cast("long"))).alias("first")
    )
    cut = cut.select("file", "first", F.least(F.col("first") + step, F.col("size")).alias("last"), "size")
    cut = stored(cut, "warc-ranges")
    return cut.repartition(min(MOST_TASKS, max(1, cut.count())), "file", "first")


def read_range(folder: str, name: str, first: int, last: int, size: int) -> bytes:
    system, path = open_fs(folder)
    with system.open_input_file(f"{path}/{name}") as file:
        return file.read_at(min(size, last) - first, first)


def edges(manifest: DataFrame, folder: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Candidate to successor, a row per candidate: file, start, leaves (the chain's first
    place beyond the range, -1 if it breaks), and its range's first byte."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                data = read_range(folder, r["file"], r["first"], r["last"] + HEADER_LIMIT, r["size"])
                places = candidates(data, r["first"], r["last"], r["size"])
                chain = exits_of(places, r["last"])
                starts = [p for p, _ in places]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["file"]] * len(places), pa.string()), pa.array(starts, pa.int64()),
                     pa.array([chain[p] for p in starts], pa.int64())],
                    names=["file", "start", "leaves"],
                )

    cut = ranges(manifest, range_bytes)
    return cut.mapInArrow(run, "file string, start long, leaves long")


def entries(manifest: DataFrame, folder: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Where the chain from each file's start enters its ranges: file, start.

    Pointer jumping: ``reached`` grows by what the pointers of its places lead to, and
    every pointer is replaced by the pointer of its target, so a chain over n ranges
    takes log2(n) rounds. Only candidates that some chain enters, or file starts, can be
    on a chain; the others were followed inside their range.
    """
    found = stored(edges(manifest, folder, range_bytes), "warc-edges")
    entered = found.where("leaves >= 0").select("file", F.col("leaves").alias("start")).distinct()
    starts = manifest.where("size > 0").select("file", F.lit(0).cast("long").alias("start"))
    jumps = stored(found.join(entered.union(starts).distinct(), ["file", "start"]).where("leaves >= 0"), "warc-jumps")
    reached = stored(starts, "warc-reached")
    known = reached.count()
    while known:
        onward = reached.join(jumps, ["file", "start"]).select("file", F.col("leaves").alias("start"))
        more = stored(reached.union(onward).distinct(), "warc-reached")
        now = more.count()
        reached = more
        if now == known:
            break
        known = now
        onto = jumps.select("file", F.col("start").alias("leaves"), F.col("leaves").alias("after"))
        jumps = stored(jumps.join(onto, ["file", "leaves"]).select("file", "start", F.col("after").alias("leaves")), "warc-jumps")
    return reached


SCHEMA = (
    "file string, offset long, page_id long, url string, payload_bytes long, payload_digest string, record_type string, "
    "refers_to long, stored_digest string"
)


def read_archives(manifest: DataFrame, folder: str, range_bytes: int = RANGE_BYTES, with_payload: bool = False) -> DataFrame:
    """Every reachable response and revisit record.

    A response's ``payload_bytes`` and ``payload_digest`` come from the payload read, a
    revisit's from its header. A task reads one range: from the place where the file's
    chain enters it, record by record, to its end; bytes before belong to the range
    before. ``url`` is null where the header has none: no URL, or one that stands in a
    metadata record. ``with_payload`` adds the payload.
    """
    schema = SCHEMA + (", payload binary" if with_payload else "")
    enter = entries(manifest, folder, range_bytes)
    step = F.lit(range_bytes).cast("long")
    sizes = manifest.select("file", "size")
    jobs = enter.join(sizes, "file").where("start < size")
    jobs = jobs.select("file", "start", F.least(F.floor(F.col("start") / step) * step + step, F.col("size")).alias("last"), "size")
    jobs = stored(jobs, "warc-jobs")
    jobs = jobs.repartition(min(MOST_TASKS, max(1, jobs.count())), "file", "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                yield from records(r)

    def records(r: dict) -> Iterator[pa.RecordBatch]:
        system, path = open_fs(folder)
        rows = []
        with system.open_input_file(f"{path}/{r['file']}") as file:
            at = r["start"]
            data, base = file.read_at(min(r["size"], r["last"] + HEADER_LIMIT) - at, at), at
            while at < r["last"]:
                found = parse_header(data, at - base)
                if found is None:
                    raise ValueError(f"{r['file']}: no record at {at}")
                head = data[at - base : found[0]].decode("utf-8").split("\r\n")[1:]
                fields = {k.lower(): v for k, v in (x.split(": ", 1) for x in head if ": " in x)}
                begin, size = base + found[0], found[1]
                payload = data[found[0] : found[0] + size]
                if len(payload) < size:  # ends beyond what was read
                    payload = file.read_at(size, begin)
                kind = fields.get("warc-type", "")
                if kind in ("response", "revisit"):
                    told = fields.get("warc-payload-digest", "").removeprefix("sha256:")
                    own = hashlib.sha256(payload).hexdigest() if kind == "response" else told
                    page, refers = fields.get("x-page-id"), fields.get("x-refers-to-page")
                    row = [r["file"], at, None if page is None else int(page), fields.get("warc-target-uri"),
                           size if kind == "response" else int(fields["x-payload-length"]), own, kind,
                           None if refers is None else int(refers), told]
                    rows.append([*row, payload] if with_payload else row)
                at = begin + size + 4
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())
        names = [x.split()[0] for x in schema.split(", ")]
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[i] for x in rows], kinds[i]) for i in range(len(names))], names=names
        )

    return jobs.mapInArrow(run, schema)


def archive_digests(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Write all pages, read the archives back, one row per page.

    Repeated pages and pages without id keep a row each, null html is an empty payload,
    other columns are not read, an empty table gives no row.
    """
    folder = fresh_path(spark, "warc")
    manifest = write_archives(df, folder)
    back = read_archives(manifest, folder)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def oracle() -> str:
    return f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha256(b) AS digest FROM p),
f AS (SELECT *, CASE WHEN n >= {LEAST_REVISIT} THEN min(page_id) OVER (PARTITION BY digest) ELSE page_id END AS first FROM d)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM f"""
