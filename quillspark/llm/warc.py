"""WARC archives and a globally ordered capture index by external merge.

write(): one WARC/1.1 record per page, in files of at most `per_file` records, gzip-compressed by Spark's
own text writer (a record ends in a line feed, which the writer adds), so that any file system that Spark
can write works. Records with equal payloads of at least `least` bytes are one response, that with the
largest id, and revisits of it without payload. The response is found by an aggregate over digests, which
is combined before it is shuffled; pages themselves are not shuffled unless the repeated digests are too
many to broadcast.

read(): parses the archives back, checking each response's digest and length. capture_index(): each
archive's captures, sorted, are one run; runs are dealt by ranges of (URL key, timestamp, id) and each
range merges its slices of the runs with a tournament tree of losers, so that the rows of the index are
in global order over its partitions. Hot URLs are split, as timestamp and id belong to the range key; the
number of ranges follows from the number of captures, so that what a merge holds is bounded (RANGE rows).

Captures are dated by `date_col` (a timestamp, date or ISO string), or all alike where it is not given or null.

Defined cases: a null html is an empty payload; a null url has the empty URL key; ids may be numbers or
strings and are never converted to floats; rows that repeat the largest id of a payload are all responses;
a null id is a response unless another page has its payload; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote, unquote, urlsplit

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, small, table, written

CAPTURED = "2024-01-01T00:00:00Z"
PER_FILE, RANGE = 2000, 200_000


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def url_key(url: str | None) -> str:
    """The SURT-style key of a URL: host labels reversed, lower case, without scheme, www and fragment."""
    if not url:
        return ""
    try:
        u = urlsplit(url.strip())
        host, port = (u.hostname or ""), u.port
    except ValueError:
        return url.lower()
    host = re.sub(r"^www\d*\.", "", host)
    place = ",".join(reversed(host.split("."))) + (f":{port}" if port and port not in (80, 443) else "")
    path = unquote(u.path or "/").lower()
    return f"{place}){path.rstrip('/') or '/'}" + (f"?{'&'.join(sorted(u.query.lower().split('&')))}" if u.query else "")


def urn(page_id: str | None) -> str:
    return f"<urn:page:{'' if page_id is None else 'n' + quote(page_id, safe='')}>"


def page_of(name: str) -> str | None:
    name = name.removeprefix("<urn:page:").removesuffix(">")
    return unquote(name[1:]) if name else None


def record(page_id: str | None, url: str | None, payload: bytes, refers_to: str | None, date: str) -> bytes:
    """A record without its last line feed."""
    clean = re.sub(r"[\r\n]", " ", url or "")
    kind = "response" if refers_to is None else "revisit"
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {urn(page_id)}",
        f"WARC-Target-URI: {clean}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: {urn(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        payload = b""
    head += [f"Content-Length: {len(payload)}", "", ""]
    return "\r\n".join(head).encode() + payload + b"\r\n\r"


def write(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date_col: str | None = None, least: int = 0, per_file: int = PER_FILE) -> str:
    """Writes the archives and returns their folder."""
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    if date_col is None:
        date = F.lit(CAPTURED)
    else:
        date = F.coalesce(F.date_format(F.to_timestamp(F.col(date_col)), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(CAPTURED))
    ident = F.col(id_col).cast("string").alias("id")
    p = pages.select(ident, F.col(url_col).cast("string").alias("url"), payload.cast("binary").alias("body"), F.sha1(payload.cast("binary")).alias("sha"), date.alias("date"))
    again = pages.select(F.col(id_col).alias("id"), F.sha1(payload.cast("binary")).alias("sha"), F.octet_length(payload).alias("n")).filter(F.col("n") >= least)
    again = small(again.groupBy("sha").agg(F.max("id").alias("last"), F.count("*").alias("n")).filter("n > 1").select("sha", F.col("last").cast("string").alias("last")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, url, body, last, day in zip(b["id"], b["url"], b["body"], b["last"], b["date"], strict=True):
                out.append(record(i, url, bytes(body), None if last == i else last, day))
            yield pd.DataFrame({"value": out})

    rows = p.join(again, "sha", "left").select("id", "url", "body", "last", "date").mapInPandas(run, "value binary")
    path = new_path(pages.sparkSession, "warc")
    rows.select(F.col("value").cast("string")).write.option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)
    return path


def parse(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers, block) of each record of an uncompressed archive."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        head = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
        n = int(head["Content-Length"])
        yield at, head, data[end + 4 : end + 4 + n]
        at = end + 4 + n
        if data[at : at + 4] != b"\r\n\r\n":
            raise ValueError(f"a record does not end at byte {at}")
        at += 4


def read(spark: SparkSession, path: str, id_kind: str = "long") -> DataFrame:
    """(archive, offset, page_id, url, url_key, captured, payload_bytes, payload_digest, record_type, refers_to)."""
    import zlib

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, content in zip(b["path"], b["content"], strict=True):
                rows = []
                for at, h, block in parse(zlib.decompress(bytes(content), 47)):
                    want, n = h["WARC-Payload-Digest"].removeprefix("sha1:"), int(h["X-Payload-Length"])
                    if h["WARC-Type"] == "response" and (digest(block) != want or len(block) != n):
                        raise ValueError(f"payload of the record at byte {at} of {name} is damaged")
                    to = h.get("WARC-Refers-To")
                    rows.append((name.rsplit("/", 1)[-1], at, page_of(h["WARC-Record-ID"]), h["WARC-Target-URI"], url_key(h["WARC-Target-URI"]), h["WARC-Date"], n, want, h["WARC-Type"], page_of(to) if to else None))
                yield pd.DataFrame(rows, columns=["archive", "offset", "page_id", "url", "url_key", "captured", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    schema = "archive string, offset long, page_id string, url string, url_key string, captured string, payload_bytes long, payload_digest string, record_type string, refers_to string"
    return files.mapInPandas(run, schema).withColumns({c: F.col(c).cast(id_kind) for c in ("page_id", "refers_to")})


class LoserTree:
    """Merges sorted runs: inner nodes keep the loser of their match, so a step replays one path."""

    def __init__(self, runs: list[Iterator[tuple]]) -> None:
        self.runs = runs
        self.heads: list[tuple | None] = [next(r, None) for r in runs]
        self.k = max(1, len(runs))
        self.losers = [-1] * self.k
        for i in range(len(runs)):
            self._play(i)

    def _less(self, i: int, j: int) -> bool:
        a, b = self.heads[i], self.heads[j]
        return a is not None and (b is None or (a, i) < (b, j))

    def _play(self, i: int) -> None:
        node = (i + self.k) // 2
        while node:
            other = self.losers[node]
            if other == -1:  # the first to come waits for its match
                self.losers[node] = i
                return
            if self._less(other, i):
                self.losers[node], i = i, other
            node //= 2
        self.losers[0] = i

    def __iter__(self) -> Iterator[tuple]:
        while self.runs and self.heads[self.losers[0]] is not None:
            i = self.losers[0]
            yield self.heads[i]
            self.heads[i] = next(self.runs[i], None)
            self._play(i)


def capture_index(captures: DataFrame) -> DataFrame:
    """captures in global order of (url_key, captured, page_id) over the partitions of the result."""
    cols, kind = captures.columns, dict(captures.dtypes)["page_id"]
    number = kind in ("tinyint", "smallint", "int", "bigint")
    order = [cols.index(c) for c in ("url_key", "captured", "page_id", "archive", "offset")]
    kept = written(captures, "captures")
    runs = kept.repartitionByRange(max(1, -(-kept.count() // RANGE)), "url_key", "captured", "page_id").sortWithinPartitions("archive", "url_key", "captured", "page_id", "offset")
    runs = runs.withColumns({c: F.col(c).cast("string") for c in ("page_id", "refers_to")})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = cols.index("archive")
        slices: dict[str, list[tuple]] = {}
        for b in batches:
            for r in b.itertuples(index=False, name=None):
                # null ids first; the row follows its key
                key = [(r[i] is not None, "" if r[i] is None else r[i]) for i in order]
                if number:
                    key[2] = (key[2][0], int(key[2][1] or 0))
                slices.setdefault(r[at], []).append((tuple(key), r))
        out = []
        for _, r in LoserTree([iter(s) for s in slices.values()]):
            out.append(r)
            if len(out) == 10_000:
                yield pd.DataFrame(out, columns=cols)
                out = []
        if out:
            yield pd.DataFrame(out, columns=cols)

    return runs.mapInPandas(run, runs.schema).withColumns({c: F.col(c).cast(kind) for c in ("page_id", "refers_to")})


def op6_warc(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    r = capture_index(read(spark, write(pages), dict(pages.dtypes)["page_id"]))
    return r.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
