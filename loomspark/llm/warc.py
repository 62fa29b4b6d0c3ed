"""Web captures: WARC records, their index, and the external merge of index runs.

A capture is a row with a url, a timestamp and a payload.  Its index entry has
the SURT key of the url, the 14-digit timestamp, the digest of the payload and
the place of the record in its run.  Index entries are sorted where they lie
and written as a table, of which each file is a sorted run.  They are not
sorted or shuffled again: a task merges the runs' files with a k-way loser
tree, reading a few thousand entries of each at a time.  More than `FAN_IN`
runs are first merged in groups of that many, in as many passes as it takes;
the last pass is cut into ranges.  Split keys are those of every so-manyth
entry of the sorted runs, and are whole keys (url key, timestamp, id, run,
offset), so a url with very many captures, or one capture that is there very
many times, is cut like any other.  Of a run only the row groups that overlap a
range are read.  The result is in global order: by url key, then timestamp,
then id, and every capture knows its place in the history of its url and in
the whole index.

Payloads never move: what is sorted and merged are index entries.  Runs are
read through pyarrow's file systems, so the shared folder must be one of
theirs (mounted paths, hdfs, s3, gs, abfs).

Defined results: a null or empty url has the key '-' and sorts first; a null
timestamp is written as '-' and comes first in its history; a null payload has
length 0 and the digest of nothing; repeated rows are captures of their own;
payloads of any length are indexed whole; an empty table gives an empty index.
Columns beyond those named are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm import shared
from loomspark.llm.vec import lean

#: Index entries a range of keys should hold, and the fewest for which another is opened while cores are idle.
RANGE, SMALL_RANGE = 1_000_000, 10_000
#: Split keys are chosen among this many entries for each range.
SAMPLES = 64
#: Runs that a task merges at once.
FAN_IN = 64
#: Entries read of a run, and written, at a time; bytes of a row group of a run.
STEP, OUT, GROUP = 2048, 32_768, 1 << 20
#: Ranges up to which the table of what came before each is broadcast.
BROADCAST = 100_000
INDEX = "url_key string, timestamp string, id bigint, url string, digest string, record_offset bigint, record_length bigint, run int"
#: The order of entries, in which no two are equal.
ORDER = ("url_key", "timestamp", "id", "run", "record_offset")


def surt(url: Column) -> Column:
    """Sort-friendly key of a url: reversed host, then port and the rest, in lower case; scheme, `www.`, user and default ports go, and query parameters are sorted."""
    u = F.lower(F.trim(url))
    bare = F.regexp_replace(F.regexp_replace(u, r"^[a-z][a-z0-9+.-]*://", ""), r"#.*$", "")
    authority = F.regexp_extract(bare, r"^([^/?]*)", 1)
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(authority, r"^[^@]*@", ""), r"^www\d*\.", ""), r":(80|443)?$", "")
    tail = F.substring(bare, F.length(authority) + 1, F.length(bare))
    path = F.regexp_extract(tail, r"^([^?]*)", 1)
    query = F.regexp_extract(tail, r"^[^?]*\?(.*)$", 1)
    name, port = F.regexp_extract(host, r"^([^:]*)", 1), F.regexp_extract(host, r"(:.*)?$", 0)
    key = F.concat(
        F.array_join(F.reverse(F.split(name, r"\.")), ","), port, F.lit(")"),
        F.when(path == "", F.lit("/")).otherwise(path),
        F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), F.array_join(F.array_sort(F.split(query, "&")), "&"))),
    )
    return F.when(url.isNull() | (u == ""), F.lit("-")).otherwise(key)


def header(url: str | None, timestamp: str | None, length: int) -> bytes:
    """Header block of a resource record of WARC 1.1; a timestamp has 14 digits."""
    t = timestamp if timestamp and timestamp != "-" else "19700101000000"
    date = f"{t[:4]}-{t[4:6]}-{t[6:8]}T{t[8:10]}:{t[10:12]}:{t[12:14]}Z"
    return f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Target-URI: {url or ''}\r\nWARC-Date: {date}\r\nContent-Type: text/html\r\nContent-Length: {length}\r\n\r\n".encode()


def record(url: str | None, timestamp: str | None, payload: bytes) -> bytes:
    return header(url, timestamp, len(payload)) + payload + b"\r\n\r\n"


_FIELD = re.compile(rb"^([A-Za-z-]+): ?(.*)$", re.M)


def read_records(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, header fields, payload) of the records of an uncompressed file; a broken record raises."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if not data.startswith(b"WARC/", at) or end < 0:
            raise ValueError(f"no record at byte {at}")
        fields = {k.decode().lower(): v.rstrip(b"\r").decode("utf-8", "replace") for k, v in _FIELD.findall(data[at:end])}
        body = end + 4
        stop = body + int(fields["content-length"])
        if data[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} does not end where it says")
        yield at, stop + 4 - at, fields, data[body:stop]
        at = stop + 4


class LoserTree:
    """Merges k sorted iterators: each step replays one path of the tree, log2 k comparisons. Equal keys come from the lower-numbered iterator first."""

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs = runs
        self.k = len(runs)
        self.head = [next(r, None) for r in runs]
        # loser[0] is the winner; the others are inner nodes
        self.loser = [-1] * max(1, self.k)
        for i in range(self.k):
            self._replay(i)

    def _before(self, a: int, b: int) -> bool:
        if a < 0 or b < 0:
            return a < 0  # an empty node wins while the tree is built
        x, y = self.head[a], self.head[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return x < y if a > b else not y < x

    def _replay(self, i: int) -> None:
        node = (i + self.k) // 2
        while node > 0:
            if self._before(self.loser[node], i):
                self.loser[node], i = i, self.loser[node]
            node //= 2
        self.loser[0] = i

    def __iter__(self):
        while self.k:
            i = self.loser[0]
            item = self.head[i]
            if item is None:
                return
            yield item, i
            self.head[i] = next(self.runs[i], None)
            self._replay(i)


def _write_order(batches):
    """Adds record length and offset in the order of the partition, which is the order its records are written in."""
    at = 0
    for b in batches:
        size = b.column(5).to_numpy(zero_copy_only=False)
        ends = at + np.cumsum(size)
        yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(5)), pa.array(ends - size), pa.array(size), b.column(6)], names=["url_key", "timestamp", "id", "url", "digest", "record_offset", "record_length", "run"])
        at = int(ends[-1]) if len(ends) else at


def index_runs(df: DataFrame, id: str = "page_id", url: str = "url", payload: str = "html", timestamp: Column | None = None) -> DataFrame:
    """Index entries of the captures, sorted within each partition: one run each, kept as a table so that run numbers and offsets stay."""
    time = timestamp if timestamp is not None else F.lit(None).cast("timestamp")
    stamp = F.coalesce(F.date_format(time, "yyyyMMddHHmmss"), F.lit("-"))
    body = F.coalesce(F.col(payload), F.lit(""))
    fixed = len(header("", "20000101000000", 0)) - 1 + 4  # all but the url and the digits of the length
    size = F.lit(fixed) + F.coalesce(F.octet_length(F.col(url)), F.lit(0)) + F.octet_length(body) + F.length(F.octet_length(body).cast("string"))
    entries = df.select(surt(F.col(url)).alias("url_key"), stamp.alias("timestamp"), F.col(id).cast("long").alias("id"), F.col(url).alias("url"), F.sha1(body.cast("binary")).alias("digest"), size.cast("long").alias("size"), F.spark_partition_id().alias("run"))
    written = entries.mapInArrow(lean(_write_order), INDEX)
    return _store_runs(written.sortWithinPartitions("url_key", "timestamp", F.asc_nulls_first("id"), "run", "record_offset"))


def _store_runs(df: DataFrame) -> DataFrame:
    """A table of which each file holds one partition in its order, in small row groups."""
    return shared.store(df, "capture-runs", {"parquet.block.size": GROUP, "maxRecordsPerFile": 0})


def _tasks(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A partition for each row."""
    return spark.createDataFrame(spark.sparkContext.parallelize(rows, max(1, len(rows))), schema)


def _keys(b: pa.RecordBatch) -> list[tuple]:
    key, time, id, run, at = (b.column(b.schema.get_field_index(c)).to_pylist() for c in ORDER)
    return [(k, t, i is not None, i or 0, r, a) for k, t, i, r, a in zip(key, time, id, run, at)]


def _bounds(group, place: dict[str, int]) -> tuple[tuple, tuple]:
    """What the keys of a row group begin with at the least and at the most, as far as its statistics tell."""
    low, high = (), ()
    for name in ORDER:
        s = group.column(place[name]).statistics
        if s is None or not s.has_min_max or s.null_count:
            break
        flag = (True,) if name == "id" else ()
        low, high = (*low, *flag, s.min), (*high, *flag, s.max)
        if s.min != s.max:
            break
    return low, high


def _entries(uri: str, low: tuple | None, high: tuple | None, live: list) -> Iterator[tuple]:
    """Keys of a sorted run from `low` to below `high`, each with the batch it lies in and its row; batches are appended to `live` as [batch, first row not given out, next row, base]."""
    system, path = fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", uri))
    with system.open_input_file(path) as source, pq.ParquetFile(source, pre_buffer=False, buffer_size=1 << 16) as file:
        place = {file.schema_arrow.names[i]: i for i in range(len(file.schema_arrow.names))}
        groups = []
        for g in range(file.num_row_groups):
            least, most = _bounds(file.metadata.row_group(g), place)
            if (low is None or most >= low[: len(most)]) and (high is None or least <= high[: len(least)]):
                groups.append(g)
        for b in file.iter_batches(STEP, row_groups=groups) if groups else ():
            keys = _keys(b)
            first = bisect_left(keys, low) if low is not None else 0
            last = bisect_left(keys, high) if high is not None else len(keys)
            if first < last:
                own = [b, first, first, 0]
                live.append(own)
                for at in range(first, last):
                    yield (*keys[at], own, at)
            if last < len(keys):
                return


def _merged(uris: list[str], low: tuple | None = None, high: tuple | None = None) -> Iterator[tuple[pa.RecordBatch, list[int]]]:
    """Batches of the entries of sorted runs in order, with each one's number among those of its url key; keeps a batch of each run and what is about to be written."""
    live: list[list] = []
    picked: list[tuple] = []
    history: list[int] = []
    seen, last = 0, None

    def flush():
        parts, base = [], 0
        for own in live:
            parts.append(own[0].slice(own[1], own[2] - own[1]))
            own[3] = base - own[1]
            base += own[2] - own[1]
        rows = pa.array([own[3] + at for own, at in picked], pa.int64())
        for own in live:
            own[1] = own[2]
        live[:] = [own for own in live if own[2] < own[0].num_rows]
        return pa.Table.from_batches(parts).take(rows).combine_chunks().to_batches()[0]

    for item, _ in LoserTree([_entries(u, low, high, live) for u in uris]):
        own, at = item[-2:]
        seen = seen + 1 if item[0] == last else 1
        last = item[0]
        own[2] = at + 1
        picked.append((own, at))
        history.append(seen)
        if len(picked) == OUT:
            yield flush(), history
            picked, history = [], []
    if picked:
        yield flush(), history


def _merge_group(batches):
    """Rows of a list of runs -> their entries in order."""
    names = [f.split()[0] for f in INDEX.split(", ")]
    for b in batches:
        for uris in b.column(0).to_pylist():
            for out, _ in _merged(uris):
                yield out.select(names)


def _merge_range(uris: list[str]):
    """Rows of (range, low, high) -> the range's entries in order with number in the history and place, both counted within the range."""
    names = [f.split()[0] for f in INDEX.split(", ")]

    def key(cut: dict | None) -> tuple | None:
        return None if cut is None else (cut["url_key"], cut["timestamp"], cut["id"] is not None, cut["id"] or 0, cut["run"], cut["record_offset"])

    def run(batches):
        for b in batches:
            for number, low, high in zip(*(c.to_pylist() for c in b.columns)):
                place = 0
                for out, history in _merged(uris, key(low), key(high)):
                    n = out.num_rows
                    added = [pa.array(history, pa.int64()), pa.array(np.arange(place + 1, place + n + 1)), pa.array(np.full(n, number, np.int32))]
                    yield pa.RecordBatch.from_arrays([*out.select(names).columns, *added], names=[*names, "nth", "place", "range"])
                    place += n

    return run


def _every(step: int):
    """Every step-th row of a partition."""

    def run(batches):
        skip = step // 2
        for b in batches:
            at = np.arange(skip, b.num_rows, step)
            skip = int(at[-1]) + step - b.num_rows if len(at) else skip - b.num_rows
            if len(at):
                yield b.take(pa.array(at))

    return run


def merge_runs(runs: DataFrame, entries_per_range: int = RANGE, fan_in: int = FAN_IN) -> DataFrame:
    """The global index from a table of sorted runs (columns of INDEX, see `index_runs`), with each capture's number in its url's history and in the index.

    The driver sees the names of the runs' files, `SAMPLES` keys for each range
    and a row for each range.
    """
    spark = runs.sparkSession
    total = runs.count()
    files = sorted(runs.inputFiles())
    while len(files) > fan_in:
        groups = [(files[at : at + fan_in],) for at in range(0, len(files), fan_in)]
        files = sorted(_store_runs(_tasks(spark, groups, "uris array<string>").mapInArrow(lean(_merge_group), INDEX)).inputFiles())
    ranges = max(1, -(-total // entries_per_range), min(spark.sparkContext.defaultParallelism, total // SMALL_RANGE))
    size = max(1, -(-total // ranges))
    step = max(1, size // SAMPLES)
    # sorted runs are sampled evenly, so that a range is off its size by at most `step` entries a partition read
    sample = runs.select(*ORDER).mapInArrow(lean(_every(step)), "url_key string, timestamp string, id bigint, run int, record_offset bigint").collect() if ranges > 1 else []
    sample.sort(key=lambda r: (r["url_key"], r["timestamp"], r["id"] is not None, r["id"] or 0, r["run"], r["record_offset"]))
    cuts = [None, *(tuple(r) for r in sample[:: max(1, size // step)][1:]), None]
    entry = "struct<url_key:string,timestamp:string,id:bigint,run:int,record_offset:bigint>"
    work = _tasks(spark, [(k, low, high) for k, (low, high) in enumerate(zip(cuts, cuts[1:]))], f"range int, low {entry}, high {entry}")
    merged = shared.store(work.mapInArrow(lean(_merge_range(files)), INDEX + ", nth bigint, place bigint, range int"), "capture-ranges")
    # what came before: one row for each range, and for a history that crosses ranges what the earlier ones hold of it
    ends = merged.groupBy("range").agg(F.count("*").alias("n"), F.min("url_key").alias("low"), F.max("url_key").alias("high"), F.max_by("nth", "place").alias("tail")).orderBy("range").collect()
    before, carried, base, open_key, open_count = [], {}, 0, None, 0
    for r in ends:
        before.append((r["range"], base))
        base += r["n"]
        if r["low"] == open_key:
            carried[r["range"]] = (open_key, open_count)
        if r["high"] == open_key and r["low"] == r["high"]:
            open_count += r["tail"]
        else:
            open_key, open_count = r["high"], r["tail"]
    rows = [(k, b, *carried.get(k, (None, 0))) for k, b in before]
    offsets = spark.createDataFrame(rows, "range int, base bigint, open_key string, open_count bigint")
    out = merged.join(F.broadcast(offsets) if len(rows) <= BROADCAST else offsets.hint("merge"), "range")
    capture = F.col("nth") + F.when(F.col("url_key") == F.col("open_key"), F.col("open_count")).otherwise(0)
    return out.select("url_key", "timestamp", "id", "url", "digest", "record_offset", "record_length", "run", capture.alias("capture"), (F.col("base") + F.col("place")).alias("position"))


def page_time(id: str = "page_id") -> Column:
    """The crawl time that stands in for the one the pages table lacks: a second for each id, from the start of 2024."""
    return F.timestamp_seconds(F.lit(1704067200) + F.col(id))


def capture_index(df: DataFrame, id: str = "page_id", url: str = "url", payload: str = "html", timestamp: Column | None = None, entries_per_range: int = RANGE, fan_in: int = FAN_IN) -> DataFrame:
    return merge_runs(index_runs(df, id, url, payload, timestamp if timestamp is not None else page_time(id)), entries_per_range, fan_in)


def capture_index_sql(table: str = "pages") -> str:
    """The index of pages in DuckDB SQL, without the place of records in runs."""
    fixed = len(header("", "20000101000000", 0)) - 1 + 4
    return rf"""with a as (select page_id as id, url, coalesce(html, '') as html, lower(trim(url)) as u from {table}),
b as (select *, regexp_replace(regexp_replace(u, '^[a-z][a-z0-9+.-]*://', ''), '#.*$', '') as bare from a),
c as (select *, regexp_extract(bare, '^([^/?]*)', 1) as authority from b),
d as (select *, regexp_replace(regexp_replace(regexp_replace(authority, '^[^@]*@', ''), '^www\d*\.', ''), ':(80|443)?$', '') as host, substr(bare, length(authority) + 1) as tail from c),
e as (select *, regexp_extract(tail, '^([^?]*)', 1) as path, regexp_extract(tail, '^[^?]*\?(.*)$', 1) as query, regexp_extract(host, '^([^:]*)', 1) as name, regexp_extract(host, '(:.*)?$', 0) as port from d),
f as (select id, url, html, case when url is null or u = '' then '-' else array_to_string(list_reverse(string_split(name, '.')), ',') || port || ')' || case when path = '' then '/' else path end || case when query = '' then '' else '?' || array_to_string(list_sort(string_split(query, '&')), '&') end end as url_key,
  coalesce(strftime(make_timestamp((1704067200 + id) * 1000000), '%Y%m%d%H%M%S'), '-') as timestamp from e)
select url_key, timestamp, id, url, sha1(html) as digest, ({fixed} + coalesce(strlen(url), 0) + strlen(html) + length(strlen(html)::varchar))::bigint as record_length,
  row_number() over (partition by url_key order by timestamp, id nulls first) as capture, row_number() over (order by url_key, timestamp, id nulls first) as position from f"""
