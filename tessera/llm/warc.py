"""WARC archives of pages, and an external index merge.

Writing. Each page becomes one WARC/1.1 record with its html as payload in UTF-8. Of pages with
equal payloads the one with the largest page_id is a response, the others are revisits that refer
to it and carry no payload. Each record is a gzip member of its own, so an index entry's offset can be sought.
Spark's text sink writes the members with its committer, so executors can be lost, and the files go to
the shared folder. The sink ends every row with one byte; as a member of less than 16 MB ends
in a zero byte, that byte is the row end (longer ones get an empty member after them). An archive has at
most `records` records of up to `large` bytes, or one longer record.

Which digests several pages have is found without the payloads. Where these digests are few enough they
are broadcast, and no payload is shuffled; else a bitmap of them keeps all other payloads out of the join.

Reading. Archives are read as binary files, one row each, and unpacked member by member; several records in
one member, unpacked archives and records of other writers are read as well (without a page_id; records that
are neither response, resource nor revisit are passed over). The digest is taken again from the payload read;
a revisit has none, so its digest and length are those of its headers.

Index. Every archive gives a capture run, sorted within itself by URL key and timestamp. Runs are
dealt to ranges of (URL key, timestamp, page_id) from a sample of all entries, so one URL may lie in
several ranges. Each task merges the sorted runs that reach it with a loser tree and streams
them out; a range holds `entries_a_range` entries, far smaller than records, which bounds what a task
holds. The result is ordered within and across its partitions.

Pages have no time of capture; unless a column named captured_at is there, page p counts as
captured p seconds after 2020-01-01.

Defined cases: null html is an empty payload; rows of one page_id and payload that are both largest are
both responses; a page without an id is smaller than all others and has no id in its record; pages
without a URL have the URL key ``-``; a captured_at that is null or no timestamp counts as missing. Rows repeated
whole give a record each, under one record id. Extra columns are not read. An empty table gives empty archives
and index. Payloads are kept whole, up to the two GB of a value.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from base64 import b32encode
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import passing, shared_dir, stash, table

EPOCH = 1_577_836_800
CRLF = "\r\n"
#: Base-32 digits as conv() writes them, and as RFC 4648 does.
PLAIN, RFC = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base-32 SHA-1: the 160 bits in eight groups of 20."""
    h = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(h, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), PLAIN, RFC)


def url_key(url: Column) -> Column:
    """Sort key of a URL: host labels from the right, then path and query; without scheme, `www.` and fragment, in lower case."""
    bare = F.regexp_replace(F.lower(F.trim(url)), r"^[a-z][a-z0-9+.-]*://|#.*$", "")
    host = F.regexp_replace(F.regexp_extract(bare, r"^([^/?]*)", 1), r"^www\d*\.|:(?:80|443)$", "")
    labels = F.array_join(F.reverse(F.split(host, r"\.")), ",")
    return F.when(url.isNull() | (F.trim(url) == ""), "-").otherwise(F.concat(labels, F.lit(")"), F.regexp_extract(bare, r"^[^/?]*(.*)$", 1)))


#: So many digests of some 60 bytes are broadcast at most.
FEW_DIGESTS = 500_000


def classified(pages: DataFrame, min_payload: int = 0, few: int = FEW_DIGESTS) -> DataFrame:
    """pages with payload, its bytes and digest, record_type and refers_to.

    Digests are grouped first, without the payloads; only digests that several pages have are
    joined back to the pages, broadcast if there are at most `few`.
    """
    stamp = F.timestamp_seconds(F.lit(EPOCH) + F.coalesce(F.col("page_id"), F.lit(0)))
    if "captured_at" in pages.columns:
        stamp = F.coalesce(F.col("captured_at").cast("string").try_cast("timestamp"), stamp)
    payload = F.coalesce("html", F.lit(""))
    own = pages.select("page_id", "url", payload.alias("payload"), stamp.alias("stamp"))
    own = own.withColumn("bytes", F.octet_length("payload").cast("long")).withColumn("digest", base32_sha1(F.col("payload")))
    slim = own.select("page_id", "bytes", "digest").where(F.col("bytes") >= min_payload)
    several = slim.groupBy("digest", "bytes").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("copies")).where("copies > 1").select("digest", "bytes", "last")
    several = stash(several.withColumn("at", F.xxhash64("digest")))
    if several.count() <= few:
        joined = own.join(F.broadcast(several.drop("at")), ["digest", "bytes"], "left")
    else:
        at = own.withColumn("at", F.xxhash64("digest"))
        joined = passing(at, "at", several.select("at")).drop("at").join(several.drop("at"), ["digest", "bytes"], "left")
        joined = joined.unionByName(passing(at, "at", several.select("at"), others=True).drop("at"), allowMissingColumns=True)
    revisit = F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last"))
    return joined.withColumn("record_type", F.when(revisit, "revisit").otherwise("response")).withColumn("refers_to", F.when(revisit, F.col("last")))


def record(url: Column) -> Column:
    """The text of a record, from the columns of classified()."""
    revisit = F.col("record_type") == "revisit"
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit(""))
    one_line = F.regexp_replace(url, r"[\x00-\x1f\x7f]", "")
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.lit(":"), F.col("digest"), F.lit(">"))),
        line("WARC-Date", F.date_format(F.to_utc_timestamp("stamp", F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        line("WARC-Target-URI", one_line),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        line("WARC-Refers-To", F.when(revisit, F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(":"), F.col("digest"), F.lit(">")))),
        line("X-Page-ID", F.coalesce(F.col("page_id").cast("string"), F.lit("none"))),
        line("X-URL-Key", F.regexp_replace("key", r"[\x00-\x1f\x7f]", "")),
        line("X-Payload-Length", F.col("bytes").cast("string")),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("bytes").cast("string"))),
        F.lit(CRLF),
        F.when(revisit, F.lit("")).otherwise(F.col("payload")),
        F.lit(CRLF + CRLF),
    )


EMPTY_MEMBER = zlib.compress(b"", 9, 31)


def members(rows: DataFrame) -> DataFrame:
    """value, a gzip member of each record, without the zero byte at its end."""

    def run(batches):
        for batch in batches:
            out = []
            for record in batch.column(0):
                member = zlib.compress(record.as_buffer(), 5, 31)
                out.append(member[:-1] if not member[-1] else member + EMPTY_MEMBER[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    return rows.select("value").mapInArrow(run, "value binary")


def write_archives(pages: DataFrame, path: str, records: int = 1000, large: int = 1 << 20, min_payload: int = 0, few: int = FEW_DIGESTS) -> None:
    """Write the records of pages (page_id, url, html) as archives under path, longer ones under path/large=1."""
    rows = classified(pages, min_payload, few).withColumn("key", url_key(F.col("url")))
    most = pages.agg(F.max(F.octet_length("html"))).first()[0] or 0
    kinds = [("large=0", F.col("bytes") <= large, records)] + ([("large=1", F.col("bytes") > large, 1)] if most > large else [])
    for name, which, n in kinds:
        made = members(rows.where(which).select(record(F.col("url")).alias("value"))).select(F.col("value").cast("string"))
        made.write.option("lineSep", "\0").option("maxRecordsPerFile", n).text(f"{path}/{name}")


def unpacked(data: bytes, piece: int = 1 << 16) -> Iterator[tuple[int, bytes]]:
    """Offset and content of each gzip member; data that is not packed counts as one."""
    view, at = memoryview(data), 0
    if data[:2] != b"\x1f\x8b":
        if data:
            yield 0, data
        return
    while at < len(data):
        unpack, start, out = zlib.decompressobj(31), at, []
        while not unpack.eof and at < len(data):
            out.append(unpack.decompress(view[at : at + piece]))
            at = min(at + piece, len(data)) - len(unpack.unused_data)
        if not unpack.eof:
            raise ValueError(f"the member at {start} is cut off")
        yield start, b"".join(out)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes, int]]:
    """Headers, block and offset of each record in unpacked bytes."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split(CRLF)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at {at}")
        headers = {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(headers["Content-Length"])
        if end + 4 + size > len(data):
            raise ValueError(f"the record at {at} is cut off")
        yield headers, data[end + 4 : end + 4 + size], at
        at = end + 4 + size + 4


def key_of(url: str) -> str:
    """What url_key() gives, for records of other writers."""
    bare = re.sub(r"^[a-z][a-z0-9+.-]*://|#.*$", "", url.strip(" ").lower(), flags=re.ASCII)
    host = re.match(r"[^/?]*", bare)[0]
    labels = ",".join(reversed(re.sub(r"^www\d*\.|:(?:80|443)$", "", host, flags=re.ASCII).split(".")))
    return f"{labels}){bare[len(host) :]}" if url.strip(" ") else "-"


def entry(headers: dict[str, str], block: bytes) -> tuple | None:
    """The index entry of a record but its archive and offset; None for other kinds of records."""
    kind = headers.get("WARC-Type")
    if kind not in ("response", "resource", "revisit"):
        return None
    stated = headers.get("WARC-Payload-Digest", "").removeprefix("sha1:")
    refers, page = headers.get("WARC-Refers-To", ""), headers.get("X-Page-ID")
    number = re.match(r"<urn:page:(-?\d+):", refers)
    if kind == "revisit":
        digest, size = stated, int(headers.get("X-Payload-Length", 0))
    else:
        digest, size = b32encode(hashlib.sha1(block).digest()).decode(), len(block)
        if page is not None and digest != stated:
            raise ValueError("the payload's digest differs")
    key = headers.get("X-URL-Key") or key_of(headers.get("WARC-Target-URI", "").strip("<>"))
    return (key, headers["WARC-Date"], int(page) if page and page != "none" else None, "revisit" if kind == "revisit" else "response", int(number[1]) if number else None, size, digest)


ENTRY = "url_key string, stamp string, page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, archive string, offset long"
NAMES = [x.split()[0] for x in ENTRY.split(", ")]


def read_runs(df: DataFrame) -> DataFrame:
    """The index entries of archives (path, content), those of each archive sorted by URL key, timestamp and page_id.

    offset is where a record's member begins in the archive, or where the record does in an unpacked one.
    """

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                archive = path.as_py().rsplit("/", 1)[-1]
                data = content.as_py()
                packed = data[:2] == b"\x1f\x8b"
                rows = []
                for start, member in unpacked(data):
                    for headers, block, at in parse(member):
                        found = entry(headers, block)
                        if found:
                            rows.append((*found, archive, start if packed else at))
                rows.sort(key=order)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), KINDS)] if rows else [pa.array([], t) for t in KINDS], names=NAMES)

    return df.select("path", "content").mapInArrow(run, ENTRY)


KINDS = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]


def order(entry: tuple) -> tuple:
    """URL key as UTF-8 bytes (Spark's order), timestamp, page_id (none first), archive, offset."""
    return entry[0].encode(), entry[1], -1 << 63 if entry[2] is None else entry[2], entry[7], entry[8]


class LoserTree:
    """k-way merge: each inner node keeps the loser of its match, so the next winner needs one path."""

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs = runs
        self.k = max(1, len(runs))
        self.heads: list[tuple | None] = [self.pull(i) for i in range(len(runs))] or [None]
        self.losers = [-1] * self.k
        for i in range(self.k - 1, -1, -1):
            self.play(i)

    def pull(self, i: int) -> tuple | None:
        entry = next(self.runs[i], None)
        return None if entry is None else (order(entry), entry)

    def beats(self, a: int, b: int) -> bool:
        """Whether run a's head comes before run b's; runs at their end come last, equals in the order of runs."""
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return (x[0], a) < (y[0], b)

    def play(self, i: int) -> None:
        """Take run i up from its leaf; at a free node it waits for its opponent."""
        node = (i + self.k) // 2
        while node:
            if self.losers[node] < 0:
                self.losers[node] = i
                return
            if self.beats(self.losers[node], i):
                i, self.losers[node] = self.losers[node], i
            node //= 2
        self.winner = i

    def __iter__(self) -> Iterator[tuple]:
        while self.heads[self.winner] is not None:
            i = self.winner
            yield self.heads[i][1]
            if self.runs:
                self.heads[i] = self.pull(i)
            self.play_again(i)

    def play_again(self, i: int) -> None:
        node = (i + self.k) // 2
        while node:
            if self.beats(self.losers[node], i):
                i, self.losers[node] = self.losers[node], i
            node //= 2
        self.winner = i


def natural_runs(rows: Iterator[tuple]) -> list[list[tuple]]:
    """Maximal ascending stretches: what comes from one sorted run stays together, however the runs arrive."""
    runs: list[list[tuple]] = []
    last = None
    for row in rows:
        key = order(row)
        if last is None or key < last:
            runs.append([])
        runs[-1].append(row)
        last = key
    return runs


def merge_index(runs: DataFrame, entries_a_range: int = 100_000) -> DataFrame:
    """The entries of all runs in one order: (URL key, timestamp, page_id, archive, offset) across partitions and within."""
    n = runs.count()
    ranges = max(1, -(-n // entries_a_range))
    dealt = runs.repartitionByRange(ranges, "url_key", "stamp", F.col("page_id").asc_nulls_first(), "archive", "offset")

    def run(batches):
        rows = (row for batch in batches for row in zip(*[c.to_pylist() for c in batch.columns]))
        merged, part = LoserTree([iter(r) for r in natural_runs(rows)]), []
        for row in merged:
            part.append(row)
            if len(part) == 5000:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*part), KINDS)], names=NAMES)
                part = []
        if part:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*part), KINDS)], names=NAMES)

    return dealt.mapInArrow(run, ENTRY)


def read_archives(spark, path: str) -> DataFrame:
    """path and content of the archives under path, in folders of any depth."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "[!._]*").load(path).select("path", "content")


def capture_history(pages: DataFrame, path: str, min_payload: int = 0, few: int = FEW_DIGESTS) -> DataFrame:
    """Write pages to archives under path, read these back and merge their index."""
    write_archives(pages, path, min_payload=min_payload, few=few)
    return merge_index(stash(read_runs(read_archives(pages.sparkSession, path))))


def query(spark, sf_dir):
    """op5: pages written to archives and read back through the merged index."""
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    index = capture_history(table(spark, sf_dir, "pages", "page_id", "url", "html"), path)
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = r"""
WITH own AS (SELECT page_id, coalesce(html, '') AS p, sha1(coalesce(html, '')) AS h FROM pages),
last AS (SELECT p, max(page_id) AS last FROM own GROUP BY p),
digits AS (
  SELECT page_id, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, 5 * i + 1, 5))::BIGINT >> (15 - 5 * j)) & 31)::INT + 1, 1), '' ORDER BY i, j) AS digest
  FROM own, range(8) a(i), range(4) b(j) GROUP BY page_id)
SELECT o.page_id, octet_length(encode(o.p))::BIGINT AS payload_bytes, d.digest AS payload_digest,
  CASE WHEN o.page_id = l.last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN o.page_id <> l.last THEN l.last END AS refers_to
FROM own o JOIN last l ON o.p = l.p JOIN digits d ON d.page_id = o.page_id
"""
