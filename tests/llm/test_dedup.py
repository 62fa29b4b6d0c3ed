"""Exact and near copies, boilerplate lines, the capture index and the pipeline."""

import itertools
import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomspark.llm import exact, lines, nearjoin, warc
from loomspark.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def test_lines_by_join_equal_sql(spark, compare):
    compare(lines.remove(spark.read.parquet(f"{SF}/documents.parquet"), in_place=0), ORACLE_SQL["op4_line_dedup"])


@pytest.mark.parametrize("name", ["op4_line_dedup", "op6_exact_dedup", "op9_capture_index"])
def test_equals_sql(spark, compare, name):
    compare(QUERIES[name](spark, SF), ORACLE_SQL[name])


@pytest.mark.parametrize("target", [1 << 30, 20_000])
def test_exact_at_every_target(spark, compare, target):
    """Large groups are split across tasks, small ones where they lie; the rows are the same."""
    compare(exact.dedup(spark.read.parquet(f"{SF}/documents.parquet"), target=target), exact.dedup_sql())


@pytest.mark.parametrize("target", [1 << 30, 10])
def test_exact_edges(spark, target):
    rows = [(None, None, 1), (None, None, 2), (1, "a", 1), (1, "a", 1), (2, "", 3), (3, "", 4), (None, "a", 5), (5, "ab", 1), (6, "a" * 1_900, 1), (7, "a" * 1_900, 2), (8, "a" * 1_901, 2), (9, "a" * 31, 1), (10, "a" * 32, 1), (11, "a" * 32, 1), (12, "a" * 64, 1), (13, "a\0", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, prefix int")
    got = sorted((r.doc_id if r.doc_id is not None else -1, len(r.text) if r.text is not None else -1) for r in exact.dedup(df, target=target).collect())
    assert got == [(-1, -1), (1, 1), (2, 0), (5, 2), (6, 1_900), (8, 1_901), (9, 31), (10, 32), (12, 64), (13, 2)]
    assert exact.dedup(df, target=target).columns == df.columns
    maps = df.selectExpr("*", "map('k', prefix) as m", "array(struct(map(1, text) as n)) as deep", "1 as row", "2 as tie")
    assert sorted((r.doc_id or -1, r.m["k"]) for r in exact.dedup(maps, target=target).collect())[1:3] == [(1, 1), (2, 3)]
    long = spark.createDataFrame([(i, "x" * 3_000_000 + str(i // 2)) for i in range(4)], "doc_id long, text string")
    assert sorted(r.doc_id for r in exact.dedup(long, target=target).collect()) == [0, 2]
    assert exact.dedup(df.limit(0), target=target).collect() == []


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("ab", max_size=200), max_size=30), st.integers(1, 8))
def test_split(texts, width):
    data = [t.encode() for t in texts]
    ends = list(itertools.accumulate(map(len, data)))
    starts = [e - len(d) for e, d in zip(ends, data)]
    want = defaultdict(list)
    for i, d in enumerate(data):
        want[d].append(i)
    got = exact.split(b"".join(data), starts, ends, list(range(len(data))), 0, width)
    assert sorted(map(sorted, got)) == sorted(g for g in want.values() if len(g) > 1)


def test_line_edges(spark):
    rows = [(i, "shared line\n own %d \n\n" % i, "s%d" % i) for i in range(4)] + [(None, " shared line ", None), (7, None, "s"), (8, "", "s"), (9, "same site", "s"), (9, "same site", "s"), (10, "\n".join(["same site"] * 5), "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as removed_lines", "2 as pos", "3 as h1")
    out = lines.remove(df, sites=4).collect()
    assert sorted(map(repr, out)) == sorted(map(repr, lines.remove(df, sites=4, in_place=0).collect()))
    long = spark.createDataFrame([(i, "\n".join(["y" * 100_000, f"own {i}"] * 20), f"s{i}") for i in range(4)], "doc_id long, text string, source string")
    assert {(r.text, r.removed_lines) for r in lines.remove(long, sites=4).collect()} == {("\n".join([f"own {i}"] * 20), 20) for i in range(4)}
    got = {r.doc_id: (r.text, r.removed_lines) for r in out}
    assert len(out) == len(rows) and got[0] == (" own 0 \n\n", 1) and got[None] == ("", 1) and got[7] == (None, 0) and got[8] == ("", 0)
    assert got[9] == ("same site", 0) and got[10][1] == 0 and out[0].pos == 2
    assert lines.remove(df.limit(0)).collect() == []


def test_lines_near_the_threshold(spark):
    """Lines on just under, just, and just over many sites; there the sketch alone may err."""
    rows = [(k * 1000 + i, f"line {k}", f"site {i}") for k, n in enumerate((195, 199, 200, 201, 260)) for i in range(n)]
    out = lines.remove(spark.createDataFrame(rows, "doc_id long, text string, source string"), sites=200).collect()
    assert {r.doc_id // 1000 for r in out if r.removed_lines} == {2, 3, 4}


def shingles(text, n=3):
    w = re.findall(r"[a-z0-9À-῿⁰-⿿぀-\U0010ffff]+", text.lower())
    return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()


def brute(docs, threshold):
    post, sets = defaultdict(list), {i: shingles(t) for i, t in docs}
    for i, s in sets.items():
        for g in s:
            post[g].append(i)
    both = Counter(p for ids in post.values() for p in itertools.combinations(sorted(ids), 2))
    found = {(a, b): n / (len(sets[a]) + len(sets[b]) - n) for (a, b), n in both.items()}
    return {p: j for p, j in found.items() if j >= threshold}


def links_of(pairs):
    out = Counter()
    for p in pairs:
        out.update(p)
    return out


def classes_of(ids, pairs):
    """Smallest id reached by pairs, for each id."""
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def check_links(rows, docs, want, recall=0.95):
    """Rows of the join against all pairs found by brute force: no link too many, few too few, classes those of links."""
    assert len(rows) == len(docs)
    need, links = links_of(want), Counter({r.doc_id: r.links for r in rows})
    assert all(n <= need[i] for i, n in links.items())
    assert sum(links.values()) >= recall * sum(need.values())
    full, found = classes_of([i for i, _ in docs], want), {r.doc_id: r.class_id for r in rows}
    # a class found is part of one of all links
    assert all(full[c] == full[i] for i, c in found.items())
    assert all(found[i] == full[i] for i in found) or recall < 1
    assert all((links[i] > 0) == (Counter(found.values())[found[i]] > 1) for i in list(found)[:50])


def variants(n, seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    docs, k = [], 0
    for _ in range(n):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 8, 40, 200]))]
        for _ in range(rng.randint(1, 6)):
            docs.append((k, " ".join(w if rng.random() > 0.06 else rng.choice(vocabulary) for w in base)))
            k += 1
    return docs


def test_near_copies_against_brute_force(spark):
    docs = variants(100) + [(10_000 + r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = brute(docs, nearjoin.THRESHOLD)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    rows = nearjoin.join(df).collect()
    check_links(rows, docs, want)
    # the same when groups of candidates are cut into runs and blocks, by number or by size
    for cut in ({"block": 3}, {"block_grams": 200}):
        again = nearjoin.join(df, **cut).collect()
        assert sorted((r.doc_id, r.class_id, r.links) for r in again) == sorted((r.doc_id, r.class_id, r.links) for r in rows)


@pytest.mark.parametrize("block", [512, 16])
def test_large_families(spark, block):
    """50 equal documents, and 200 near copies of one: every one of them is in the class with all its links."""
    rng = random.Random(5)
    base = [f"b{i}" for i in range(150)]
    docs = [(i, "the same words in every one of these fifty texts") for i in range(50)]
    docs += [(100 + k, " ".join(w if rng.random() > 0.02 else f"x{rng.randint(0, 9999)}" for w in base)) for k in range(200)]
    docs += [(900 + k, " ".join(f"{k}u{i}" for i in range(30))) for k in range(5)]
    want = brute(docs, nearjoin.THRESHOLD)
    rows = nearjoin.join(spark.createDataFrame(docs, "doc_id long, text string"), block=block).collect()
    check_links(rows, docs, want, 0.98)
    got = {r.doc_id: (r.class_id, r.links) for r in rows}
    assert all(got[i] == (0, 49) for i in range(50)) and all(got[900 + k] == (900 + k, 0) for k in range(5))
    assert {got[i][0] for i in range(100, 300)} == {100}


def test_recall_at_the_threshold(spark):
    """Pairs of all similarities from the threshold up are found alike."""
    rng = random.Random(1)
    docs = []
    for k in range(250):
        a = [f"{k}x{i}" for i in range(120)]
        b = list(a)
        for i in rng.sample(range(120), rng.randint(1, 14)):
            b[i] = f"{k}y{i}"
        docs += [(2 * k, " ".join(a)), (2 * k + 1, " ".join(b))]
    want = brute(docs, 0.5)
    linked = {r.doc_id for r in nearjoin.join(spark.createDataFrame(docs, "doc_id long, text string")).collect() if r.links}
    for low in (0.5, 0.6, 0.7, 0.8, 0.9):
        band = {p for p, j in want.items() if low <= j < low + 0.1}
        assert len([p for p in band if set(p) <= linked]) >= 0.9 * len(band)
    assert len(linked) >= 0.95 * 2 * len(want)


def test_prefixes_stop_at_different_lengths(spark):
    """Near copies that differ in a word meet at the full prefix, others only once it has been shortened; alone, a document goes down to the shortest."""
    docs = []
    for k in range(40):
        a = [f"{k}x{i}" for i in range(200)]
        for j, changed in enumerate((0, 1)):
            docs.append((10 * k + j, " ".join([*a[: 200 - changed], *(f"{k}z{i}" for i in range(changed))])))
        c = [f"{k}c{i}" for i in range(200)]
        docs += [(10 * k + 2, " ".join(c)), (10 * k + 3, " ".join(w if i % 11 else f"{k}d{i}" for i, w in enumerate(c)))]
        docs.append((10 * k + 4, " ".join(f"{k}e{i}" for i in range(200))))
    by = defaultdict(list)
    for r in nearjoin.join(spark.createDataFrame(docs, "doc_id long, text string")).collect():
        by[r.doc_id % 10].append((r.prefix, r.links))
    assert set(by[0]) == set(by[1]) == {(8, 1)} and set(by[4]) == {(None, 0)}
    assert len([1 for _, n in by[2] if n]) >= 38 and len([1 for p, n in by[2] if n and p < 8]) >= 15


def test_labels_are_sorted_tries():
    """Leading bits of a label agree as long as leading values do."""
    import numpy as np

    rng = np.random.default_rng(2)
    sig = rng.integers(0, 1 << 32, (2, 192), dtype=np.uint32)
    picks = nearjoin._picks(48, 8, 192)
    assert len({int(x) for x in picks[:, :4].ravel()}) == 192 and all(len(set(p)) == 8 for p in picks.tolist())
    for same in range(9):
        other = sig[:1].copy()
        other[0, picks[0, same:]] ^= np.uint32(0x55555555)
        a, b = nearjoin.labels(sig[:1], 48, 8, 4)[0, 0], nearjoin.labels(other, 48, 8, 4)[0, 0]
        if same >= 4:
            assert int(a ^ b) >> (5 * (8 - same)) == 0
        else:
            assert int(a) >> 20 != int(b) >> 20


def test_near_query_against_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    check_links(QUERIES["op8_near_copies"](spark, "/root/testdata/sf0.01").collect(), docs, brute(docs, nearjoin.THRESHOLD))


def test_near_edges(spark):
    text = "one two three four five six seven"
    rows = [(1, text, 0), (2, "“" + text.upper() + "”!", 0), (2, "something else entirely", 0), (None, text, 0), (3, None, 0), (4, "", 0), (5, "...", 0), (6, "one", 0), (7, "one", 0), (8, "one two", 0), (1, text, 0), (9, "w " * 30_000, 0), (10, "w " * 30_001, 0), (11, " ".join(f"v{i}" for i in range(40_000)), 0), (12, " ".join(f"v{i}" for i in range(40_001)), 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, entry int").selectExpr("*", "1 as h", "2 as row", "3 as labels")
    got = sorted((-1 if r.doc_id is None else r.doc_id, -1 if r.class_id is None else r.class_id, r.links) for r in nearjoin.join(df).collect())
    assert got == [(-1, -1, 0), (1, 1, 2), (1, 1, 2), (2, 1, 2), (2, 2, 0), (3, 3, 0), (4, 4, 0), (5, 5, 0), (6, 6, 1), (7, 6, 1), (8, 8, 0), (9, 9, 1), (10, 9, 1), (11, 11, 1), (12, 11, 1)]
    kept = nearjoin.one_of_each(df)
    assert kept.columns == df.columns
    left = sorted((-1 if r.doc_id is None else r.doc_id, (r.text or "")[:9]) for r in kept.collect())
    assert left == [(-1, "one two t"), (1, "one two t"), (2, "something"), (3, ""), (4, ""), (5, "..."), (6, "one"), (8, "one two"), (9, "w w w w w"), (11, "v0 v1 v2 ")]
    assert nearjoin.join(df.limit(0)).collect() == [] and nearjoin.one_of_each(df.limit(0)).collect() == []


def test_leaders_across_batches():
    """Runs may be cut anywhere by batches."""
    import pyarrow as pa

    rng = random.Random(3)
    rows = sorted((rng.randint(0, 12), i) for i in range(60))
    for size in (1, 2, 7, 60):
        parts = [rows[i : i + size] for i in range(0, 60, size)]
        batches = [pa.RecordBatch.from_arrays([pa.array([k for k, _ in p]), pa.array([e for _, e in p])], names=["key", "entry"]) for p in parts]
        got = sorted(tuple(r.values()) for b in nearjoin._leaders(iter(batches)) for r in b.to_pylist())
        first = {}
        for k, e in rows:
            first.setdefault(k, e)
        number = Counter(k for k, _ in rows)
        assert got == sorted((k, first[k], e) for k, e in rows if number[k] > 1)


def test_prefix_length():
    assert nearjoin.prefix_length(0.5, 0.95, 48, 8) == 4
    for s, t, n in ((0.5, 0.9, 10), (0.8, 0.99, 30), (0.3, 0.95, 20)):
        k = nearjoin.prefix_length(s, t, n, 8)
        assert k == 1 or 1 - (1 - s**k) ** n >= t
        assert k == 8 or 1 - (1 - s ** (k + 1)) ** n < t


def test_components(spark):
    """Many random graphs side by side, and a long path."""
    rng = random.Random(4)
    edges = [(1000 * g + rng.randint(0, 25), 1000 * g + rng.randint(0, 25)) for g in range(30) for _ in range(rng.randint(0, 30))]
    edges += [(50_000 + i, 50_001 + i) for i in range(60)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    want = {x: find(x) for x in root if find(x) != x}
    got = {r.node: r.root for r in nearjoin.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {k: v for k, v in got.items() if k != v} == want


def test_loser_tree():
    rng = random.Random(0)
    for k in range(9):
        runs = [sorted((rng.randint(0, 9), i) for i in range(rng.randint(0, 12))) for _ in range(k)]
        merged = list(warc.LoserTree([iter(r) for r in runs]))
        assert merged == sorted(((x, i) for i, r in enumerate(runs) for x in r), key=lambda p: (p[0], p[1]))


@pytest.mark.parametrize("size", [200_000, 40])
def test_capture_ranges(spark, size):
    """However many ranges there are, order and histories are those of one sort."""
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    many = pages.union(pages.selectExpr("page_id + 1000", "url", "html")).union(pages.selectExpr("page_id + 2000", "'http://hot.example/' as url", "html")).repartition(5)
    rows = warc.capture_index(many, entries_per_range=size).orderBy("position").collect()
    keys = [(r.url_key, r.timestamp, r.id) for r in rows]
    assert keys == sorted(keys) and [r.position for r in rows] == list(range(1, 151))
    seen = Counter()
    for r in rows:
        seen[r.url_key] += 1
        assert r.capture == seen[r.url_key]
    html = {r.page_id: r for r in many.collect()}
    for run in {r.run for r in rows}:
        own = sorted((r for r in rows if r.run == run), key=lambda r: r.record_offset)
        data = b"".join(warc.record(r.url, r.timestamp, html[r.id].html.encode()) for r in own)
        read = list(warc.read_records(data))
        assert [(a, n) for a, n, _, _ in read] == [(r.record_offset, r.record_length) for r in own]
        assert [p.decode() for *_, p in read] == [html[r.id].html for r in own]


@pytest.mark.parametrize("fan_in", [2, 3])
def test_capture_passes(spark, fan_in):
    """Runs merged in several passes, with one capture that is there many times and cut over ranges, give the order of one sort."""
    rows = [(k % 7 if k % 3 else 1, f"http://h{k % 5}.example/" if k % 3 else "http://hot.example/", "x" * (k % 4)) for k in range(400)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)
    out = warc.capture_index(df, entries_per_range=30, fan_in=fan_in).orderBy("position").collect()
    keys = [(r.url_key, r.timestamp, r.id, r.run, r.record_offset) for r in out]
    assert keys == sorted(keys) and len(set(keys)) == 400 and [r.position for r in out] == list(range(1, 401))
    assert sorted((r.id, r.url) for r in out) == sorted(r[:2] for r in rows)
    seen = Counter()
    for r in out:
        seen[r.url_key] += 1
        assert r.capture == seen[r.url_key]


def test_runs_are_not_sorted_again(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").repartition(3)
    plan = warc.merge_runs(warc.index_runs(pages), entries_per_range=10)._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "Exchange hashpartitioning" not in plan and "rangepartitioning" not in plan


def test_merge_streams(tmp_path):
    """A range of many times what is read of a run at once keeps a batch of each run and what is about to be written."""
    count, files = 60_000, []
    for run in range(3):
        keys = [(f"k{i * 3 + run:08d}" if i % 3 else "k-hot", "20240101000000", i) for i in range(count)]
        keys.sort()
        t = pa.table({"url_key": [k for k, _, _ in keys], "timestamp": [t for _, t, _ in keys], "id": [i for *_, i in keys], "url": [k for k, _, _ in keys], "digest": ["d"] * count, "record_offset": list(range(count)), "record_length": [1] * count, "run": pa.array([run] * count, pa.int32())})
        pq.write_table(t, tmp_path / f"{run}.parquet", row_group_size=5000)
        files.append(f"file://{tmp_path}/{run}.parquet")
    cut = ("k-hot", "20240101000000", True, 30_000, 1, 7)
    got, widest = [], 0
    for low, high in ((None, cut), (cut, None)):
        for b, history in warc._merged(files, low, high):
            widest = max(widest, pa.total_allocated_bytes())
            got += warc._keys(b)
    assert len(got) == 3 * count and got == sorted(got) and len(set(got)) == len(got)
    assert widest < 64 << 20

    read = []
    system = warc.fs.LocalFileSystem()
    file = pq.ParquetFile(system.open_input_file(str(tmp_path / "0.parquet")))
    place = {c: i for i, c in enumerate(file.schema_arrow.names)}
    for g in range(file.num_row_groups):
        low, high = warc._bounds(file.metadata.row_group(g), place)
        part = warc._keys(file.read_row_group(g).to_batches()[0])
        assert part[0][: len(low)] >= low and part[-1][: len(high)] <= high
        read.append(len(low))
    # a row group of one url tells its keys down to the id
    assert max(read) >= 4


def test_full_index_leads_to_records(spark, compare):
    """Every entry of the registered query is followed to its record; the other columns are those of SQL."""
    index = QUERIES["op9_capture_index_full"](spark, SF)
    compare(index.drop("run", "record_offset"), ORACLE_SQL["op9_capture_index"])
    html = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    runs = defaultdict(list)
    for r in index.collect():
        runs[r.run].append(r)
    for own in runs.values():
        own.sort(key=lambda r: r.record_offset)
        data = b"".join(warc.record(r.url, r.timestamp, html[r.id].encode()) for r in own)
        for r in own:
            one = list(warc.read_records(data[r.record_offset : r.record_offset + r.record_length]))
            assert [p.decode() for *_, p in one] == [html[r.id]]


def test_capture_edges(spark):
    rows = [(1, None, None), (None, "", ""), (3, "http://a.b/", "x"), (3, "http://a.b/", "x"), (4, "https://user@www.A.b:443/Q?b=2&a=1#f", "y"), (5, "a.b:8080", "é")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as run", "2 as url_key")
    out = warc.capture_index(df, entries_per_range=2).orderBy("position").collect()
    assert [r.url_key for r in out] == ["-", "-", "b,a)/", "b,a)/", "b,a)/q?a=1&b=2", "b,a:8080)/"]
    assert [r.capture for r in out] == [1, 2, 1, 2, 1, 1] and out[0].timestamp == "-"
    assert warc.capture_index(df.limit(0)).collect() == []


def test_broken_record():
    with pytest.raises(ValueError):
        list(warc.read_records(b"nothing"))
    with pytest.raises(ValueError):
        list(warc.read_records(warc.record("u", None, b"abc")[:-1] + b"x"))
