"""n-gram Jaccard self-join with a MinHash LSH forest and exact verification.

A document is the set of hashed n-grams of its words (lower-cased runs of
letters and digits, see `vec.words`; a text of fewer than n words is one
n-gram).  Documents with the same words in the same order are one entry, so
copies are never compared with each other.

Forest: each entry has a label in each of `trees` tries, made of `depth`
MinHash values and kept as one integer whose leading bits are those of the
leading values, so that sorted labels are a prefix trie.  `prefix_length`
gives the shortest prefix that may be needed: the longest one by which a pair
at the threshold meets in some trie with the target probability.  Entries that
share it somewhere are brought together once, whole sets and all labels.
There prefixes are matched at full length first and shortened value by value;
what meets is counted exactly, and an entry goes on to shorter prefixes only
while its estimated recall (compared candidates of all it could still meet) is
below 1.  Entries whose candidates all lie deep in the tries stop there,
others go down to the shortest prefix; no candidate of the shortest prefix is
lost by that.

Where candidates meet: connected groups of candidates (at most `block`
entries) meet in one task, and each set is sent once.  Larger groups are cut
by the runs of equal prefixes they are made of, a run by its leader (its
smallest entry), and these into blocks of which every two meet in a task of
their own; a pair that shares several runs is counted in the first of them
only.  Neither partners nor candidates have a cap.

The result has a row for each row of the input: its class (the smallest doc_id
of the documents that links connect) and its links (how many other rows have
at least that similarity with it).  Pairs are counted where they meet and
never written.

Defined results: null texts, texts without words and rows with a null doc_id
have no links and are a class of their own (class_id is the doc_id); equal
texts and repeated rows are links of similarity 1; an empty table gives an
empty result; further columns are not read.  Texts are taken whole: the n-gram
sets of a task are bounded in bytes by cutting blocks finer, down to a single
text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm import shared
from loomspark.llm.vec import lean, mix, pieces, ragged, span_hashes, utf8, words

N = 3
THRESHOLD = 0.5
TARGET = 0.95
TREES = 48
DEPTH = 8
VALUES = 192
BLOCK = 512
#: n-grams of the sets that meet in one task, by which blocks are cut finer (a single larger set is a block).
BLOCK_GRAMS = 4 << 20
PIECE = 1 << 20
#: Bits of a label that tell values beyond the shortest prefix.
FINE = 20
#: Bytes up to which the table of wanted entries is broadcast; a larger one is joined by shuffle.
BROADCAST = 16 << 20


def prefix_length(threshold: float, target: float, trees: int, depth: int) -> int:
    """The longest prefix whose sharing in some trie has the target probability at the threshold."""
    k = depth
    while k > 1 and 1 - (1 - threshold**k) ** trees < target:
        k -= 1
    return k


def ngrams(data: np.ndarray, off: np.ndarray, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every word n-gram in order; rows of fewer than n words have one n-gram, rows without words none."""
    start, end, row = words(data, off)
    h = span_hashes(data, start, end)
    if not len(h):
        return h, row
    first = np.searchsorted(row, np.arange(len(off) - 1))
    number = np.bincount(row, minlength=len(off) - 1)
    # short rows: the words there are, then blanks
    code = np.zeros(len(h), np.uint64)
    at = np.arange(len(h))
    last = first[row] + number[row]
    for k in range(n):
        inside = at + k < last
        code = mix(code * np.uint64(0x9E3779B97F4A7C15) + np.where(inside, h[np.minimum(at + k, len(h) - 1)], np.uint64(k + 1)))
    keep = (at + n <= last) | ((number[row] < n) & (at == first[row]))
    return code[keep], row[keep]


def _functions(values: int) -> tuple[np.ndarray, np.ndarray]:
    r = mix(np.arange(1, 2 * values + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
    return (r[:values] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (r[values:] >> np.uint64(32)).astype(np.uint32)


def signatures(code: np.ndarray, row: np.ndarray, rows: int, values: int = VALUES) -> np.ndarray:
    """MinHash values (rows x values); rows without n-grams hold the largest value."""
    out = np.full((rows, values), 0xFFFFFFFF, np.uint32)
    if not len(code):
        return out
    a, b = _functions(values)
    low, high = (code & np.uint64(0xFFFFFFFF)).astype(np.uint32), (code >> np.uint64(32)).astype(np.uint32)
    present = np.unique(row)
    at = np.searchsorted(row, present)
    for k in range(values):
        x = low * a[k] + (high ^ b[k])
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        x ^= x >> np.uint32(13)
        out[present, k] = np.minimum.reduceat(x, at)
    return out


def _picks(trees: int, depth: int, values: int) -> np.ndarray:
    """The functions of each label (trees x depth): no function is used again before all have been, and none twice in a label if there are enough."""
    at = np.arange(depth)[:, None] * trees + np.arange(trees)[None, :]
    order = np.random.default_rng(20240229).permutation(values)
    # later rounds are shifted, so that a label gets the functions of others
    return order[(at + 7 * (at // values)) % values].T


def fine_bits(depth: int, floor: int) -> int:
    """Bits of a label for each value beyond the shortest prefix."""
    return FINE // (depth - floor) if depth > floor else 0


def labels(signature: np.ndarray, trees: int, depth: int, floor: int) -> np.ndarray:
    """Labels (rows x trees, uint64): a hash of trie and first `floor` values, then some bits of each further value; leading bits are prefixes."""
    picks = _picks(trees, depth, signature.shape[1])
    key = np.broadcast_to(np.arange(1, trees + 1, dtype=np.uint64), (len(signature), trees)).copy()
    for j in range(floor):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + signature[:, picks[:, j]])
    bits = fine_bits(depth, floor)
    for j in range(depth - floor):
        # from the top down: the leading bits hold the shortest prefix
        low = np.uint64(bits * (depth - floor - j))
        value = (mix(signature[:, picks[:, floor + j]].astype(np.uint64)) & np.uint64((1 << bits) - 1)) << (low - np.uint64(bits))
        key = (key >> low << low) | value
    return key


def _digest(code: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """128 bits over the sequence of n-grams of each row."""
    place = np.arange(len(code)) - np.searchsorted(row, row)
    out = []
    for salt in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB):
        v = mix(code ^ mix(place.astype(np.uint64) + np.uint64(salt)))
        total = np.zeros(len(v) + 1, np.uint64)
        np.cumsum(v, out=total[1:])
        edge = np.searchsorted(row, np.arange(rows + 1))
        out.append(mix(total[edge[1:]] - total[edge[:-1]] + np.uint64(salt)).astype(np.int64))
    return out[0], out[1]


def _sketches(df: DataFrame, n: int, trees: int, depth: int, floor: int, text: str, doc_id: str) -> DataFrame:
    """A row for each row of df: doc_id, a hash of the text, and for texts with words (and a doc_id) digest, number of n-grams and labels; kept as a table."""

    def run(batches):
        for batch in batches:
            for b in pieces(batch, "t", PIECE):
                code, row = ngrams(*utf8(b.column(2)), n)
                f1, f2 = _digest(code, row, b.num_rows)
                size = np.bincount(row, minlength=b.num_rows)
                found = labels(signatures(code, row, b.num_rows), trees, depth, floor)
                none = (size == 0) | b.column(0).is_null().to_numpy(zero_copy_only=False)
                off = pa.array(np.arange(0, found.size + 1, trees, dtype=np.int32), mask=np.append(none, False))
                lists = pa.ListArray.from_arrays(off, pa.array(found.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(f1, mask=none), pa.array(f2, mask=none), pa.array(size), lists], names=["doc_id", "h", "f1", "f2", "n", "labels"])

    column = F.col(f"`{text}`")
    read = df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.xxhash64(column).alias("h"), F.lower(column).alias("t"))
    return shared.store(read.mapInArrow(lean(run), "doc_id bigint, h bigint, f1 bigint, f2 bigint, n bigint, labels array<bigint>"), "sketches")


def _entries(sketches: DataFrame) -> DataFrame:
    """One row for each sequence of n-grams: entry, digest, first document, number of rows, n-grams and labels; kept as a table."""
    merged = sketches.where("labels is not null").groupBy("f1", "f2").agg(F.min(F.struct("doc_id", "h")).alias("one"), F.count("*").alias("copies"), F.max("n").alias("n"), F.first("labels").alias("labels"))
    # the table is written once, so the numbers stay
    return shared.store(merged.withColumn("entry", F.monotonically_increasing_id()), "entries")


def _leaders(batches):
    """Rows sorted by key and entry -> (key, leader, entry) for the rows of each run of two or more, its leader's own among them; keeps two numbers of a run, however long."""
    last, leader, said = None, 0, False
    for b in batches:
        if not b.num_rows:
            continue
        key, entry = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        first = np.flatnonzero(np.append(key[0] != last, key[1:] != key[:-1]))
        goes_on = not (len(first) and first[0] == 0)
        head, lead, silent = entry[first], entry[first], np.ones(len(first), bool)
        bounds = first
        if goes_on:
            bounds, lead, silent = np.append(0, first), np.append(leader, head), np.append(not said, silent)
        size = np.diff(np.append(bounds, len(key)))
        others = size - 1
        if goes_on:
            others[0] += 1
        run = np.repeat(np.arange(len(bounds)), size)
        member = np.ones(len(key), bool)
        member[first] = False
        own = np.flatnonzero((others > 0) & silent)
        out_key = np.concatenate([key[bounds[own]], key[member]])
        if len(out_key):
            yield pa.RecordBatch.from_arrays([pa.array(out_key), pa.array(np.concatenate([lead[own], lead[run[member]]])), pa.array(np.concatenate([lead[own], entry[member]]))], names=["key", "leader", "entry"])
        said = bool(others[-1] > 0)
        last, leader = key[-1], lead[-1]


class _Counter:
    """Sets of n-grams, numbered together so that what two of them share can be counted by marking."""

    def __init__(self, group: list[np.ndarray]):
        self.size = np.array([len(x) for x in group], np.int64)
        self.start = np.cumsum(self.size) - self.size
        every, self.code = np.unique(np.concatenate(group), return_inverse=True)
        self.marked = np.zeros(len(every), bool)

    def jaccard(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Similarity of the sets a[i] and b[i] (ordered by a): the first is marked, the members of the second that are marked are counted."""
        size, start = self.size, self.start
        common = np.empty(len(a), np.int64)
        edge = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
        for low, high in zip(edge.tolist(), [*edge[1:].tolist(), len(a)]):
            own = self.code[start[a[low]] : start[a[low]] + size[a[low]]]
            self.marked[own] = True
            # partners in parts of about a million n-grams
            total = np.cumsum(size[b[low:high]])
            at = 0
            while at < high - low:
                end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + (1 << 20), "right")))
                who = b[low + at : low + end]
                length = size[who]
                hits = self.marked[ragged(self.code, start[who], length)]
                common[low + at : low + end] = np.add.reduceat(hits, np.cumsum(length) - length, dtype=np.int64)
                at = end
            self.marked[own] = False
        return common / (size[a] + size[b] - common)


def verify(group: list[np.ndarray], label: np.ndarray, copies: np.ndarray, half: np.ndarray | None, leaders: np.ndarray | None, cell: int, threshold: float, depth: int, floor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each set of a task: how many rows link to it, the smallest number it is linked with, and the prefix length at which it stopped.

    With `half` only pairs across its two values count; with `leaders` (by
    entry and trie) only those whose first common run has the leader `cell`.
    """
    m = len(group)
    links, root, stop = np.zeros(m, np.int64), np.arange(m), np.full(m, floor)
    bits = fine_bits(depth, floor)

    def meet(length: int) -> np.ndarray:
        """Pairs (upper triangle) that share a prefix of that length in some trie."""
        prefix = label >> np.uint64(FINE if length == floor else bits * (depth - length))
        out = np.zeros((m, m), bool)
        if m <= 64:
            np.any(prefix[:, None, :] == prefix[None, :, :], axis=2, out=out)
        else:
            for t in range(prefix.shape[1]):
                column = prefix[:, t]
                out |= column[:, None] == column[None, :]
        out &= np.tri(m, k=-1, dtype=bool).T
        return out

    could = meet(floor)
    if half is not None:
        could &= half[:, None] != half[None, :]
    if leaders is not None and could.any():
        x, y = np.nonzero(could)
        for low in range(0, len(x), 1 << 16):
            a, b = x[low : low + (1 << 16)], y[low : low + (1 << 16)]
            same = (leaders[a] == leaders[b]) & (leaders[a] >= 0)
            could[a, b] = leaders[a, same.argmax(1)] == cell
    left = could.sum(0) + could.sum(1)
    going = left > 0
    found: list[np.ndarray] = []
    counter = None
    for length in range(depth, floor - 1, -1):
        if not going.any():
            break
        # what meets now for the first time, and concerns an entry that has not all it could meet
        now = could & (meet(length) if length > floor else True)
        if now.any():
            could &= ~now
            a, b = np.nonzero(now)
            counter = counter or _Counter(group)
            near = counter.jaccard(a, b) >= threshold
            found.append(np.stack([a[near], b[near]]))
            left = left - now.sum(0) - now.sum(1)
        done = going & (left == 0)
        stop[done] = length
        going &= ~done
    if found:
        a, b = np.concatenate(found, axis=1)
        links += np.bincount(a, copies[b], m).astype(np.int64) + np.bincount(b, copies[a], m).astype(np.int64)
        while len(a):
            new = root.copy()
            np.minimum.at(new, a, root[b])
            np.minimum.at(new, b, root[a])
            new = new[new]
            if np.array_equal(new, root):
                break
            root = new
    return links, root, stop


def _verifier(threshold: float, depth: int, floor: int):
    """Rows sorted by tile -> for each set of it (entry, links, root, prefix, whole); holds the sets of one tile at a time."""

    def settle(rows: list, tile: tuple):
        # a text that is there twice brings its entry twice
        rows = list({r[0]: r for r in rows}.values())
        ids = np.array([r[0] for r in rows], np.int64)
        label = np.stack([r[3] for r in rows]).view(np.uint64)
        leaders, whole = None, rows[0][4] is None
        if not whole:
            # aligned with the tries: the leader of the run that a label lies in, or -1
            key = (label >> np.uint64(FINE)).astype(np.int64)
            leaders = np.full(key.shape, -1, np.int64)
            for i, r in enumerate(rows):
                own = np.array([x["key"] for x in r[4]], np.int64)
                at = np.minimum(np.searchsorted(own, key[i]), len(own) - 1)
                hit = own[at] == key[i]
                leaders[i, hit] = np.array([x["leader"] for x in r[4]], np.int64)[at[hit]]
        half = None if tile[1] == tile[2] else np.array([r[1] for r in rows])
        links, root, stop = verify([r[5] for r in rows], label, np.array([r[2] for r in rows], np.int64), half, leaders, tile[0], threshold, depth, floor)
        return ids, links, ids[root], stop.astype(np.int32), np.full(len(ids), whole)

    def batch_of(out):
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], names=["entry", "links", "root", "prefix", "whole"])

    def run(batches):
        now, rows, out, n = None, [], [], 0
        for b in batches:
            columns = [b.column(k) for k in range(9)]
            flat, off = columns[6].flatten().to_numpy(zero_copy_only=False), columns[6].offsets.to_numpy()
            off = off - off[0]
            runs = columns[7].to_pylist() if columns[7].null_count < b.num_rows else [None] * b.num_rows
            for k, (cell, i, j, entry, part, copies) in enumerate(zip(*(columns[c].to_pylist() for c in range(6)))):
                if (cell, i, j) != now:
                    if now is not None:
                        out.append(settle(rows, now))
                        n += len(rows)
                    now, rows = (cell, i, j), []
                    if n >= 50_000:
                        yield batch_of(out)
                        out, n = [], 0
                # copied, as the batch would stay in memory with any part of it
                rows.append((entry, part, copies, flat[off[k] : off[k + 1]].copy(), runs[k], np.frombuffer(columns[8][k].as_py(), np.uint64)))
        if now is not None:
            out.append(settle(rows, now))
        if out:
            yield batch_of(out)

    return run


def _small(df: DataFrame, row_bytes: int) -> DataFrame:
    """A stored table, marked for broadcast where its measured size allows, else for a join by shuffle."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST else df.hint("merge")


def _sets(df: DataFrame, wanted: DataFrame, n: int, trees: int, depth: int, floor: int, text: str, doc_id: str) -> DataFrame:
    """The wanted entries (doc_id, h, f1, f2, ...) with their labels and whole n-gram sets, as sorted 64-bit hashes."""
    size = wanted.agg(F.sum(64 + 32 * F.size("tiles") + 16 * F.coalesce(F.size("runs"), F.lit(0)))).first()[0] or 0
    docs = df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.xxhash64(F.col(f"`{text}`")).alias("h"), F.lower(F.col(f"`{text}`")).alias("t")).where("doc_id is not null and t is not null")
    carried = ["entry", "copies", "tiles", "runs"]
    joined = docs.join(F.broadcast(wanted) if size <= BROADCAST else wanted.hint("merge"), ["doc_id", "h"]).select("f1", "f2", "t", *carried)

    def run(batches):
        for batch in batches:
            for b in pieces(batch, "t", PIECE):
                code, row = ngrams(*utf8(b.column(2)), n)
                f1, f2 = _digest(code, row, b.num_rows)
                # texts of one hash may differ
                own = (f1 == b.column(0).to_numpy()) & (f2 == b.column(1).to_numpy())
                found = labels(signatures(code, row, b.num_rows), trees, depth, floor)[own]
                edge = np.searchsorted(row, np.arange(b.num_rows + 1))
                sets = [np.unique(code[edge[i] : edge[i + 1]]).tobytes() for i in np.flatnonzero(own)]
                lists = pa.ListArray.from_arrays(np.arange(0, found.size + 1, trees, dtype=np.int32), pa.array(found.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([*(b.column(k).filter(pa.array(own)) for k in range(3, 7)), lists, pa.array(sets, pa.binary())], names=[*carried, "labels", "grams"])

    types = {f.name: f.dataType.simpleString() for f in joined.schema.fields}
    return joined.mapInArrow(lean(run), ", ".join(f"{c} {types[c]}" for c in carried) + ", labels array<bigint>, grams binary")


def classes(df: DataFrame, n: int = N, threshold: float = THRESHOLD, target: float = TARGET, trees: int = TREES, depth: int = DEPTH, block: int = BLOCK, block_grams: int = BLOCK_GRAMS, text: str = "text", doc_id: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Sketches of the rows (doc_id, h, f1, f2), and for each entry f1, f2, one (doc_id and h of its first document), copies, links (to rows of other entries), root (of its class) and prefix."""
    floor = prefix_length(threshold, target, trees, depth)
    sketches = _sketches(df, n, trees, depth, floor, text, doc_id)
    entries = _entries(sketches)
    keys = entries.select(F.explode("labels").alias("label"), "entry").select(F.shiftrightunsigned("label", FINE).alias("key"), "entry")
    members = shared.store(keys.repartition("key").sortWithinPartitions("key", "entry").mapInArrow(lean(_leaders), "key bigint, leader bigint, entry bigint"), "members")
    root = components(members.select(F.col("entry").alias("a"), F.col("leader").alias("b")))
    root = shared.store(root.unionByName(root.select(F.col("root").alias("node"), "root").distinct()), "candidates")
    group = root.join(entries.select(F.col("entry").alias("node"), "n"), "node").groupBy("root").agg(F.count("*").alias("m"), F.sum("n").alias("grams"))
    large = shared.store(group.where((F.col("m") > block) | (F.col("grams") > block_grams)).select("root"), "large")
    whole = F.array(F.struct(F.col("root").alias("cell"), F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("part")))
    wanted = root.join(large, "root", "left_anti").select(F.col("node").alias("entry"), whole.alias("tiles"), F.lit(None).cast("array<struct<key:bigint,leader:bigint>>").alias("runs"))
    has_large = not large.isEmpty()
    if has_large:
        own = members.join(root.join(large, "root", "left_semi").select(F.col("node").alias("entry")), "entry", "left_semi")
        cells = own.select("leader", "entry").distinct().join(entries.select("entry", "n"), "entry")
        sizes = cells.groupBy("leader").agg(F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("n") / block_grams)).cast("int").alias("blocks"))
        placed = cells.join(sizes, "leader").withColumn("part", F.pmod(F.xxhash64("entry"), F.col("blocks")).cast("int"))
        # every two blocks meet: block p is in the tiles (p, q) and (q, p)
        tiles = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).groupBy("entry").agg(F.collect_list(F.struct(F.col("leader").alias("cell"), F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part")).alias("tiles"))
        runs = own.groupBy("entry").agg(F.array_sort(F.collect_list(F.struct("key", "leader"))).alias("runs"))
        wanted = wanted.unionByName(tiles.join(runs, "entry"))
    wanted = shared.store(wanted.join(entries.select("entry", "f1", "f2", "copies", F.col("one.doc_id").alias("doc_id"), F.col("one.h").alias("h")), "entry"), "wanted")
    together = _sets(df, wanted, n, trees, depth, floor, text, doc_id).select(F.explode("tiles").alias("at"), "entry", "copies", "labels", "runs", "grams").select("at.cell", "at.i", "at.j", "entry", "at.part", "copies", "labels", "runs", "grams")
    counted = shared.store(together.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j", "entry").mapInArrow(lean(_verifier(threshold, depth, floor)), "entry bigint, links bigint, root bigint, prefix int, whole boolean"), "counted")
    links = counted.where("whole").select("entry", "links", "root", "prefix")
    if has_large:
        parts = counted.where("not whole")
        joined = components(parts.select(F.col("entry").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "entry")
        links = links.unionByName(parts.groupBy("entry").agg(F.sum("links").alias("links"), F.min("prefix").alias("prefix")).join(joined, "entry", "left").select("entry", "links", F.coalesce("root", "entry").alias("root"), "prefix"))
    out = entries.select("entry", "f1", "f2", "one", "copies").join(links, "entry", "left").select("f1", "f2", "one", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "entry").alias("root"), F.coalesce("prefix", F.lit(floor)).alias("prefix"))
    return sketches.select("doc_id", "h", "f1", "f2"), shared.store(out, "classes")


def _first_of_class(found: DataFrame) -> DataFrame:
    """Entries that have a link or a copy, with `kept`: doc_id and h of the first document of their class."""
    some = found.where("links > 0 or copies > 1")
    return some.join(some.groupBy("root").agg(F.min("one").alias("kept")), "root")


def join(df: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """doc_id, class_id, links and prefix (the length at which its prefixes stopped) for each row of df."""
    sketches, found = classes(df, text=text, doc_id=doc_id, **options)
    some = _first_of_class(found).select("f1", "f2", F.col("kept.doc_id").alias("class_id"), (F.col("links") + F.col("copies") - 1).alias("links"), "prefix")
    some = _small(shared.store(some, "links"), 64)
    return sketches.join(some, ["f1", "f2"], "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"), "prefix")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of the edges (a, b); the root is the smallest node reached. Alternates large-star and small-star rounds on stored tables."""
    edges = shared.store(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = shared.store(large, "large-star")
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(lowest.select("u", F.col("m").alias("v"))).distinct()
        small = shared.store(small, "small-star")
        if small.count() == edges.count() and small.exceptAll(edges).isEmpty():
            return small.select(F.col("u").alias("node"), F.col("v").alias("root"))
        edges = small


def one_of_each(df: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """The rows of df without all but one (the smallest doc_id) of each class of near copies; columns stay.

    Rows are told apart by doc_id and text: where a doc_id has two texts, what
    happens to one does not touch the other, and of rows that repeat both one stays.
    """
    sketches, found = classes(df, text=text, doc_id=doc_id, **options)
    rows = sketches.join(_small(shared.store(_first_of_class(found).select("f1", "f2", "kept"), "firsts"), 64), ["f1", "f2"])
    gone = _small(shared.store(rows.where(F.struct("doc_id", "h") != F.col("kept")).select("doc_id", "h").distinct(), "gone"), 32)
    twice = shared.store(rows.where(F.struct("doc_id", "h") == F.col("kept")).groupBy("doc_id", "h").count().where("count > 1").select("doc_id", "h"), "repeated")
    key, h = F.col(f"row.`{doc_id}`").cast("long"), F.xxhash64(F.col(f"row.`{text}`"))
    packed = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"))
    keyed = packed.select("row", key.alias("doc_id"), h.alias("h"))
    kept = keyed.join(gone, ["doc_id", "h"], "left_anti")
    if not twice.isEmpty():
        # the others pass by; of repeated rows any one is taken
        once = kept.join(twice, ["doc_id", "h"], "left_semi").groupBy("doc_id", "h").agg(F.first("row").alias("row"))
        kept = kept.join(twice, ["doc_id", "h"], "left_anti").select("doc_id", "h", "row").unionByName(once)
    return kept.select("row.*")
