"""WARC archives of pages, and their capture index by external merge.

Writing: a record per row, as text in DataFrame functions. The payload is the html in UTF-8. Of
records with equal payloads of ``SHARED_BYTES`` or more, that with the largest id is a response
and the others are revisits, which hold HTTP headers only; smaller payloads are always responses.
Records end in CR LF CR LF, which is the writer's line separator; files are gzip streams, written
by Spark's own committer, so a lost executor leaves no half archive.

Reading: every archive is streamed through a decompressor, record by record; a response's
payload is checked against its digest. Up to ``RUN`` captures at a time become a locally sorted
run. Runs are dealt by ranges of (URL key, timestamp, id, ...), so a hot URL spreads over as many
ranges as it needs, and in each range a loser tree merges the runs' slices: all ranges in their
order are the ordered capture history.

Null and empty html is an empty payload, and very long html one record. A null url has no target
line and the key ``-``. Rows that repeat give a record each; with equal ids they are responses
alike. A null id in a group of equal payloads is a revisit, unless all ids there are null. Line
breaks in a url are percent-encoded. Captures of one key and time (ties) are ordered by id, then
archive and offset. An empty table gives no archive and an empty index. Only page_id, url and
html are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
import io
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.storage import remove_dir, shared_dir, stored
from ._common import partitions

SHARED_BYTES = 1000
#: Captures in one sorted run; captures that one range holds on average.
RUN, RANGE = 20_000, 50_000
#: Records of one archive at most: an archive is read as a whole, compressed.
RECORDS = 10_000
#: Captures carry the time of this second (2024-01-01 UTC) plus their id, as pages have no time.
BASE_SECOND = 1704067200
END = "\r\n\r\n"
_ID = "urn:x-page:"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def url_key(url: Column) -> Column:
    """Host labels in reverse, then path and query, lower-cased: ``com,example)/path``."""
    rest = F.regexp_extract(url, "://([^#]*)", 1)
    host, tail = F.regexp_extract(rest, "^([^/?]*)", 1), F.regexp_extract(rest, "^[^/?]*(.*)", 1)
    key = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), tail)
    return F.coalesce(F.lower(F.when(rest == "", url).otherwise(key)), F.lit("-"))


def with_roles(pages: DataFrame) -> DataFrame:
    """``pages`` and _payload, _bytes, _digest, _refers (the response's id for revisits)."""
    payload = F.coalesce("html", F.lit(""))
    marked = pages.withColumns({"_payload": payload, "_bytes": F.octet_length(payload).cast("bigint"), "_digest": F.sha1(payload.cast("binary"))})
    groups = pages.select("page_id", F.octet_length(payload).cast("bigint").alias("_bytes"), F.sha1(payload.cast("binary")).alias("_digest"))
    groups = groups.filter(F.col("_bytes") >= SHARED_BYTES).groupBy("_digest", "_bytes").agg(F.max("page_id").alias("_most"), F.count(F.lit(1)).alias("_n"))
    groups = groups.filter("_n > 1 and _most is not null").drop("_n")
    joined = marked.join(groups, ["_digest", "_bytes"], "left")
    refers = F.when(F.col("_most").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_most")), F.col("_most"))
    return joined.withColumn("_refers", refers).drop("_most")


def records(pages: DataFrame) -> DataFrame:
    """(value): the WARC record of each row, without its end mark."""
    rows, crlf = with_roles(pages), "\r\n"
    name = F.coalesce(F.col("page_id").cast("string"), F.lit("null"))
    second = F.timestamp_seconds(F.lit(BASE_SECOND) + F.coalesce("page_id", F.lit(0)))
    date = F.date_format(F.to_utc_timestamp(second, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{crlf}Content-Type: text/html; charset=utf-8{crlf}Content-Length: "), F.col("_bytes").cast("string"), F.lit(crlf * 2))
    again = F.col("_refers").isNotNull()
    size = F.octet_length(http) + F.when(again, F.lit(0)).otherwise(F.col("_bytes"))
    head = F.concat(
        F.lit(f"WARC/1.1{crlf}WARC-Type: "), F.when(again, "revisit").otherwise("response"),
        F.lit(f"{crlf}WARC-Record-ID: <{_ID}"), name, F.lit(f">{crlf}WARC-Date: "), date,
        F.coalesce(F.concat(F.lit(f"{crlf}WARC-Target-URI: "), url), F.lit("")),
        F.lit(f"{crlf}WARC-Payload-Digest: sha1:"), F.col("_digest"),
        F.when(again, F.concat(F.lit(f"{crlf}WARC-Profile: {_PROFILE}{crlf}WARC-Refers-To: <{_ID}"), F.col("_refers").cast("string"), F.lit(">"))).otherwise(""),
        F.lit(f"{crlf}X-Url-Key: "), F.regexp_replace(url_key(F.col("url")), "[\r\n]", " "),
        F.lit(f"{crlf}Content-Type: application/http;msgtype=response{crlf}Content-Length: "), size.cast("string"), F.lit(crlf * 2),
    )
    return rows.select(F.concat(head, http, F.when(again, "").otherwise(F.col("_payload"))).alias("value"))


def write(pages: DataFrame, path: str) -> None:
    """Archives below ``path``, one ``.warc.gz`` file a partition (names are given after the commit)."""
    records(pages).write.option("lineSep", END).option("maxRecordsPerFile", RECORDS).option("compression", "gzip").text(path)
    spark = pages.sparkSession
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in files.listStatus(folder):
        old = status.getPath()
        if old.getName().endswith(".txt.gz"):
            files.rename(old, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder, old.getName()[: -len("txt.gz")] + "warc.gz"))


class Stream:
    """Bytes of a gzip stream as they are needed; members may follow each other."""

    def __init__(self, data: bytes, piece: int = 1 << 16):
        self.data, self.piece, self.at, self.place = io.BytesIO(data), piece, 0, 0
        self.held, self.inflate = bytearray(), zlib.decompressobj(31)

    def _more(self) -> bool:
        got = self.inflate.unused_data if self.inflate.eof else b""
        if self.inflate.eof:
            self.inflate = zlib.decompressobj(31)
        got = got or self.data.read(self.piece)
        if not got:
            return False
        if self.at:
            del self.held[: self.at]
            self.at = 0
        self.held += self.inflate.decompress(got)
        return True

    def read(self, size: int) -> bytes:
        while len(self.held) - self.at < size:
            if not self._more():
                raise ValueError("the archive ends inside a record")
        out = bytes(self.held[self.at : self.at + size])
        self.at += size
        self.place += size
        return out

    def until(self, mark: bytes) -> bytes | None:
        """What comes before ``mark``, which is skipped; None at the end."""
        seen = 0
        while (found := self.held.find(mark, self.at + seen)) < 0:
            seen = max(0, len(self.held) - self.at - len(mark))
            if not self._more():
                if len(self.held) > self.at:
                    raise ValueError("the archive ends inside a header")
                return None
        return self.read(found + len(mark) - self.at)[: -len(mark)]


def parse(data: bytes) -> Iterator[dict]:
    """Records of an archive: headers in lower case, ``http`` headers, ``payload``, ``offset`` (uncompressed)."""
    stream, mark = Stream(data), END.encode()
    while True:
        offset, head = stream.place, stream.until(mark)
        if head is None:
            return
        lines = head.decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at {offset}")
        fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
        block = stream.read(int(fields["content-length"]))
        if stream.read(len(mark)) != mark:
            raise ValueError(f"the record at {offset} has no end mark")
        http, _, payload = block.partition(mark)
        inner = {k.lower(): v for k, _, v in (x.partition(": ") for x in http.decode("utf-8").split("\r\n")[1:])}
        yield {"fields": fields, "http": inner, "payload": payload, "offset": offset, "length": stream.place - offset}


def _page(name: str | None) -> int | None:
    number = (name or "").strip("<>").removeprefix(_ID)
    return int(number) if number.lstrip("-").isdigit() else None


def capture(record: dict, archive: str) -> tuple:
    """(urlkey, timestamp, page_id, ...) of one record; responses are checked against their digest."""
    f = record["fields"]
    kind, digest, size = f["warc-type"], f["warc-payload-digest"].removeprefix("sha1:"), int(record["http"]["content-length"])
    if kind == "response" and (len(record["payload"]) != size or hashlib.sha1(record["payload"]).hexdigest() != digest):
        raise ValueError(f"the payload at {record['offset']} of {archive} is damaged")
    stamp = "".join(x for x in f["warc-date"] if x.isdigit())
    return f["x-url-key"], stamp, _page(f["warc-record-id"]), kind, size, digest, _page(f.get("warc-refers-to")), archive, record["offset"], record["length"]


_CAPTURE = pa.schema(
    [("urlkey", pa.string()), ("timestamp", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
     ("refers_to", pa.int64()), ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]
)
CAPTURE = "urlkey string, timestamp string, page_id bigint, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint, archive string, offset bigint, length bigint"


def _order(row) -> tuple:
    return row[0].encode(), row[1], row[2] is not None, row[2] or 0, row[7], row[8]


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


def _runs(batches):
    """Archives -> captures with run and place, each run sorted."""
    schema = _CAPTURE.append(pa.field("run", pa.string())).append(pa.field("place", pa.int32()))
    for batch in batches:
        for path, data in zip(batch.column(0).to_pylist(), batch.column(1)):
            archive, rows, number = path.rsplit("/", 1)[-1], [], 0

            def run(rows=rows):
                rows.sort(key=_order)
                return _batch([(*r, f"{archive}:{number}", k) for k, r in enumerate(rows)], schema)  # noqa: B023

            for record in parse(data.as_py()):
                rows.append(capture(record, archive))
                if len(rows) == RUN:
                    yield run()
                    rows.clear()
                    number += 1
            if rows:
                yield run()


def loser_tree(runs: list[list[tuple]], key=_order) -> Iterator[tuple]:
    """K-way merge: inner nodes hold the losers of their matches, so a new head replays one path."""
    k = len(runs)
    if not k:
        return
    at, heads = [0] * k, [(key(r[0]), i) if r else None for i, r in enumerate(runs)]

    def wins(a: int, b: int) -> bool:
        return heads[a] is not None and (heads[b] is None or heads[a] < heads[b])

    tree = [-1] * k
    best = [*([-1] * k), *range(k)]  # winners of the subtrees, while building
    for node in range(k - 1, 0, -1):
        a, b = best[2 * node], best[2 * node + 1]
        best[node], tree[node] = (a, b) if wins(a, b) else (b, a)
    winner = best[1] if k > 1 else 0
    while heads[winner] is not None:
        yield runs[winner][at[winner]]
        at[winner] += 1
        left = at[winner] < len(runs[winner])
        heads[winner] = (key(runs[winner][at[winner]]), winner) if left else None
        node = (winner + k) // 2
        while node:
            if wins(tree[node], winner):
                winner, tree[node] = tree[node], winner
            node //= 2


def _merged(batches):
    """Slices of runs, run by run in their order -> one ordered range."""
    runs: list[list[tuple]] = []
    last = None
    for batch in batches:
        names = batch.column(len(_CAPTURE)).to_pylist()
        for name, row in zip(names, zip(*(batch.column(k).to_pylist() for k in range(len(_CAPTURE))))):
            if name != last:
                runs.append([])
                last = name
            runs[-1].append(row)
    out = []
    for row in loser_tree(runs):
        out.append(row)
        if len(out) == 4096:
            yield _batch(out, _CAPTURE)
            out = []
    if out:
        yield _batch(out, _CAPTURE)


def history(spark, path: str, captures: int) -> DataFrame:
    """The ordered capture index of all archives below ``path`` (about ``captures`` of them)."""
    archives = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path).select("path", "content")
    # written first: dealing by ranges takes a sample, and archives are parsed once
    runs = stored(archives.mapInArrow(_runs, f"{CAPTURE}, run string, place int"), "capture-runs")
    width = max(min(partitions(archives), max(1, captures // 1000)), -(-captures // RANGE))
    dealt = runs.repartitionByRange(width, "urlkey", "timestamp", "page_id", "archive", "offset")
    return dealt.sortWithinPartitions("run", "place").mapInArrow(_merged, CAPTURE)


def write_index(index: DataFrame, path: str) -> None:
    """CDXJ lines, in order: key, timestamp and a JSON object."""
    rest = F.to_json(F.struct("page_id", "record_type", "payload_bytes", "payload_digest", "refers_to", "archive", "offset", "length"))
    index.select(F.concat_ws(" ", "urlkey", "timestamp", rest).alias("value")).write.mode("overwrite").text(path)


def op2(pages: DataFrame) -> DataFrame:
    """The contract's rows, with the capture's key and time, in the order of the merged history."""
    spark, path = pages.sparkSession, shared_dir(pages.sparkSession, "warc")
    write(pages.select("page_id", "url", "html"), path)
    found = history(spark, path, pages.count())
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "urlkey", "timestamp")


def discard(spark, path: str) -> None:
    remove_dir(spark, path)


ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest,
    url, regexp_extract(url, '://([^#]*)', 1) AS rest FROM pages),
g AS (SELECT payload_digest, payload_bytes, max(page_id) AS most FROM p WHERE payload_bytes >= {SHARED_BYTES} GROUP BY 1, 2)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN most IS DISTINCT FROM page_id AND most IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN most IS DISTINCT FROM page_id THEN most END AS refers_to,
  coalesce(lower(CASE WHEN rest = '' THEN url
    ELSE array_to_string(list_reverse(string_split(regexp_extract(rest, '^([^/?]*)', 1), '.')), ',') || ')' || regexp_extract(rest, '^[^/?]*(.*)', 1) END), '-') AS urlkey,
  strftime(make_timestamp(({BASE_SECOND} + coalesce(page_id, 0)) * 1000000), '%Y%m%d%H%M%S') AS timestamp
FROM p LEFT JOIN g USING (payload_digest, payload_bytes)
"""
