"""The outline of markdown, trees, groups, retrieval, upkeep and the calls around them, on fixtures traced by hand."""

import os
import random

import pytest

from loomspark.functions import normalize, outline, terms
from loomspark.operators import chunksets, context, dense, fusion, incremental, keyword, tree
from loomspark.plans import api, cli, queries, server
from loomspark.sources.store import DuplicateKey, Store

NOTES = """\
# Project Notes

## Authentication

**Decision:** Use JWT tokens for API auth.

- Access tokens expire in 15 minutes.
- Refresh tokens expire in 7 days.
- Store tokens in httpOnly cookies.

## Database Schema

**Users table:**

| Column | Type | Notes |
|--------|------|-------|
| id | UUID | Primary key |
| email | TEXT | Unique, indexed |
| created_at | TIMESTAMP | Default now() |

## Deployment

We use Docker containers on AWS ECS.

- Production runs 3 replicas behind ALB.
- Staging runs 1 replica.
"""
APPENDED = "\n## Caching Strategy\n\n**Decision:** Use Redis for session caching.\n\n- TTL of 30 minutes for session data.\n- Cache-aside pattern for database queries.\n"


def shape(text, **options):
    rows = outline.outline(text, **options)
    return [d for d, _ in rows], outline.parents([d for d, _ in rows]), [c for _, c in rows]


def test_notes():
    depth, parent, content = shape(NOTES)
    assert depth == [0, 1, 2, 3, 3, 3, 1, 2, 3, 0, 0, 0, 0, 1, 2, 3, 3]
    assert parent == [None, 0, 1, 2, 2, 2, 0, 6, 7, None, None, None, None, 12, 13, 14, 14]
    assert content[3] == "- Access tokens expire in 15 minutes."


@pytest.mark.parametrize("text, options, depths, contents", [
    ("", {}, [], []),
    ("just a line", {}, [0], None),
    ("## Sub\nbody", {"title": False}, [1, 2], ["Sub", "body"]),
    ("A one. B two. C three.", {}, [0, 1], ["A one.", "B two."]),
    ("# T\nOne here. Two here. Three here.", {}, [0, 1, 1, 1], ["T", "One here. ", "Two here. ", "Three here."]),
    ("See Fig. 3 now. Next one.", {"title": False}, [1, 1], ["See Fig. 3 now. ", "Next one."]),
    ("# T\n\nIntro:\ntext\n\nafter", {}, [0, 1, 2, 1], None),
    ("# T\n【img】\n*caption*\nmore", {}, [0, 1, 2, 1], None),
    ("# T\na) x\niv) y\n3) z\n  - n", {}, [0, 2, 2, 2, 3], ["T", "a. x", "iv. y", "3. z", "- n"]),
    ("# T\n| a | b |\n|---|---|\n| 1 | 2 |\n| 3 | 4 |", {}, [0, 2, 0, 0, 0], None),
    ("# T\n| a | b |\n|---|---|\n", {"attached": True}, [0, 2, 2], None),
    ("# T\n```\ncode\n\n    more\n```\ntext", {}, [0, 2, 0, 0, 0, 1], ["T", "```", "code", "    more", "```", "text"]),
    ("# T\n***\n- - -\n    code\n\ttoo\nhttps://x.org/a\n[t](u)\n[...]", {}, [0, 2, 0, 1, 1, 2], None),
    ("# T\n<table>\n<tr>\n</table>\nx", {}, [0, 2, 0, 0, 1], None),
    ("# A\n# B\n### C\n####### no", {}, [0, 1, 2, 3], ["A", "B", "C", "####### no"]),
    ("# T\n→x", {}, [0, 2], ["T", "x"]),
])
def test_outlines(text, options, depths, contents):
    depth, _, content = shape(text, **options)
    assert depth == depths and (contents is None or content == contents)


def test_limits():
    words = lambda s: len(s.split())
    assert outline.within_limit("a b; c d; e", words, 2) == ["a b; ", "c d; ", "e"]
    assert outline.within_limit("a b c d e", words, 2) == ["a b", "c d", "e"]
    assert outline.within_limit("a b 【x y z】 c", words, 2) == ["a b ", "【x y z】", " c"]
    assert outline.fill_words("aaaa b", len, 3) == ["aaaa", "b"]
    long = "# T\n" + "word " * 600
    depth, _, content = shape(long)
    assert depth == [0, 1, 2] and " ".join(content[1:]).split() == ["word"] * 600


def test_normalize():
    assert normalize.normalize("<p>1,234,567&nbsp;kg</p>") == "1234567 kg"
    assert normalize.normalize("<table><tr><td>a</td><td>b</td></tr><tr><td>c</td></tr></table>") == "a b \nc"
    assert normalize.normalize("ﬁ <script>x</script>3.141 y") == "fi 3141 y"
    assert normalize.normalize(None) is None and normalize.normalize("") == ""


def test_terms(spark):
    df = spark.createDataFrame([("The Cats_1 are É a running",), (None,)], "t string")
    assert [r[0] for r in df.select(terms.terms("t")).collect()] == [["cats_1", "running"], None]
    for w, s in {"caresses": "caress", "ponies": "poni", "running": "run", "relational": "relat", "hopping": "hop", "filing": "file", "happy": "happi", "sky": "sky", "adjustment": "adjust", "controlling": "control", "rate": "rate", "agreed": "agre"}.items():
        assert terms.stem(w) == s, w
    assert terms.match_terms("Café runs") == ["cafe", "run"]


def test_stems_are_remembered_across_texts():
    """A word that comes again in another text is not stemmed again, and what is remembered is bounded in words and their length."""
    terms._known.cache_clear()
    for _ in range(3):
        assert terms.match_terms("Relational ponies, Café " + "running" * 9) == ["relat", "poni", "cafe", terms.stem("running" * 9)]
    found = terms._known.cache_info()
    assert (found.misses, found.currsize, found.hits, found.maxsize) == (3, 3, 6, terms.KNOWN_WORDS)
    assert terms.fold("É\u0301ﬁ ΑΣ x\u0300") == "efi ας x"


def random_trees(spark, seed=0, n=40):
    rng = random.Random(seed)
    rows = [(t, i, rng.randint(0, 4)) for t in range(n) for i in range(rng.randint(0, 25))]
    return rows, spark.createDataFrame(rows, "tree int, local_index int, depth int")


@pytest.mark.parametrize("most", [16, 2])
def test_trees_equal_a_stack(spark, monkeypatch, most):
    """Windows, and the function that takes over in deep trees."""
    monkeypatch.setattr(tree, "MOST_DEPTHS", most)
    rows, df = random_trees(spark)
    by = {}
    for t, i, d in rows:
        by.setdefault(t, []).append(d)
    want = {}
    for t, depths in by.items():
        up = outline.parents(depths)
        for i, p in enumerate(up):
            path, q = [], p
            while q is not None:
                path.insert(0, q)
                q = up[q]
            end = next((j for j in range(i + 1, len(depths)) if depths[j] <= depths[i]), None)
            want[t, i] = (p, path, i not in up, end)
    linked = tree.subtrees(tree.leaves(tree.link(df, ["tree"]), ["tree"]), ["tree"])
    assert {(r.tree, r.local_index): (r.parent, list(r.ancestors), r.is_leaf, r.subtree_end) for r in linked.collect()} == want


def test_ends_of_subtrees_take_one_pass(spark):
    """No window frame reaches from a row to the last one, as Spark goes over the rest of the tree for each row of such a frame."""
    _, df = random_trees(spark)
    plan = tree.subtrees(df, ["tree"])._jdf.queryExecution().executedPlan().toString().lower()
    assert "window" in plan and "unboundedfollowing" not in plan


def notes_chunks(spark):
    rows = [("n", i, d, c) for i, (d, c) in enumerate(outline.outline(NOTES))]
    return tree.link(spark.createDataFrame(rows, "file_path string, local_index int, depth int, content string"), ["file_path"])


def test_groups(spark):
    out = chunksets.simple(notes_chunks(spark), ["file_path"]).orderBy("local_index").collect()
    assert [r.chunk_ids for r in out] == [[0, 1, 2, 3, 4, 5], [0, 6, 7, 8], [9, 10, 11, 15, 16]]
    assert out[1].contents.startswith("Project Notes\nDatabase Schema\n") and out[0].to_embed.startswith("Project Notes Authentication")


def test_root_leaves_join_the_next_group(spark):
    rows = spark.createDataFrame([("x", i, d, str(i)) for i, d in enumerate([0, 0, 1, 2])], "file_path string, local_index int, depth int, content string")
    assert [r.chunk_ids for r in chunksets.simple(tree.link(rows, ["file_path"]), ["file_path"]).collect()] == [[0, 3]]


def test_budgeted_groups_cover_everything():
    rng = random.Random(2)
    for _ in range(60):
        n = rng.randint(1, 30)
        depth = [0] + [rng.randint(1, 4) for _ in range(n - 1)]
        content = ["w " * rng.randint(1, 60) for _ in range(n)]
        groups = chunksets.budgeted_groups(list(range(n)), depth, content, outline.parents(depth), target=120)
        assert sorted({i for g in groups for i in g}) == list(range(n))
        assert not any(set(a) <= set(b) for a in groups for b in groups if a is not b)
    assert chunksets.with_gaps([0, 2], {0: "a", 2: "b"}) == "a\n[...]\nb" and chunksets.budgeted_groups([], [], [], []) == []


def test_context(spark):
    chunks = notes_chunks(spark)
    hits = spark.createDataFrame([("n", [9, 10, 11, 15, 16])], "file_path string, chunk_ids array<int>")
    ids = context.expand(chunks, context.hit_ids(hits))
    (r,) = context.assemble(chunks, ids).collect()
    assert r.chunk_ids == [9, 10, 11, 12, 13, 14, 15, 16] and "  Deployment" in r.context and "[...]" not in r.context
    some = spark.createDataFrame([("n", 0), ("n", 5), ("n", 99)], "file_path string, local_index int")
    (r,) = context.assemble(chunks, some).collect()
    assert r.context == "Project Notes\n[...]\n      - Store tokens in httpOnly cookies." and r.chunk_ids == [0, 5, 99]
    deep = context.expand_deep(chunks, spark.createDataFrame([("n", 0), ("n", 6)], "file_path string, local_index int"))
    assert sorted(r.local_index for r in deep.collect()) == [0, 6, 7, 8]


def test_ranking(spark):
    key = ["chunkset_id"]
    a = spark.createDataFrame([(1, 3.0), (2, 2.0), (3, 1.0)], "chunkset_id int, score double")
    b = spark.createDataFrame([(3, 0.9), (4, 0.8)], "chunkset_id int, score double")
    out = [(r.chunkset_id, round(r.score, 6)) for r in fusion.reciprocal_ranks(a, b, key).orderBy("rank").collect()]
    assert out == [(3, round(1 / 63 + 1 / 61, 6)), (1, round(1 / 61, 6)), (2, round(1 / 62, 6)), (4, round(1 / 62, 6))]
    hits = spark.createDataFrame([("f", i, 10.0 - i, i) for i in range(1, 6)] + [("g", 9, 4.5, 6)], "file_path string, n int, score double, rank int")
    assert fusion.cap_per_file(hits).groupBy("file_path").count().orderBy("file_path").collect()[0]["count"] == 3
    assert [(r.file_path, r.score) for r in fusion.rank_files(hits).collect()] == [("f", 9.0), ("g", 4.5)]


def test_keyword_search(spark):
    df = spark.createDataFrame([(1, "red fox fox"), (2, "red dog"), (3, ""), (4, "blue fish")], "id int, contents string")
    index, stats = keyword.postings(df, ["id"]), keyword.statistics(df)
    assert [r.id for r in keyword.search(df, index, stats, "fox red", ["id"], 3).collect()] == [1, 2, 3]
    assert [r.score for r in keyword.search(df, index, stats, "zebra", ["id"], 2).collect()] == [0.0, 0.0]
    assert keyword.search(df.limit(0), index.limit(0), keyword.statistics(df.limit(0)), "fox", ["id"]).collect() == []
    find = lambda q: [r.id for r in keyword.match(df, q, ["id"]).collect()]
    assert find("foxes") == [1] and sorted(find("red")) == [1, 2] and find("red NOT fox") == [2] and sorted(find("dog OR fi*")) == [2, 4]
    assert find('"red dog"') == [2] and find('"dog red"') == [] and find("red fox") == [1] and sorted(find("(dog OR fish)")) == [2, 4]
    for q in ("geo-blocked", "", "(red", "AND", "red)"):
        with pytest.raises(keyword.QuerySyntaxError):
            keyword.match(df, q, ["id"])


def test_dense(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [0.0, 1.0]), (4, [-1.0, 0.0]), (5, None), (6, [float("nan"), 1.0])], "id int, embedding array<float>")
    assert [(r.id, r.score) for r in dense.search(df, [2.0, 0.0], ["id"], 2).collect()] == [(1, 1.0), (2, 0.0)]
    assert [r.id for r in dense.search(df, [2.0, 0.0], ["id"], 3, 0.5).collect()] == [1]
    texts = spark.createDataFrame([("", "a b"), ("x", "a b")], "to_embed string, contents string")
    v = [list(r.embedding) for r in dense.embed(texts, dense.HashingEmbedder(8)).collect()]
    assert v[0] != v[1] and len(v[0]) == 8


def test_index_and_search(spark, tmp_path):
    file = tmp_path / "notes.md"
    file.write_text(NOTES)
    (tmp_path / ".hidden.md").write_text("# no")
    assert api.status(tmp_path, spark=spark)["files"] == [] and api.search("x", tmp_path, spark=spark) == []
    assert api.index(tmp_path, spark=spark) == {"files_indexed": 1, "chunks_created": 17, "chunksets_created": 3}
    assert api.index(tmp_path, spark=spark)["files_indexed"] == 0
    store = api.open_store(tmp_path, spark=spark)
    file.write_text(NOTES + APPENDED)
    os.utime(file, (1, 1))
    assert api.update_file(store, str(file)) == {"status": "updated", "new_chunks": 4, "new_chunksets": 1}
    rows = store.chunks_of(str(file.resolve())).collect()
    assert [(r.local_index, r.depth, r.parent_local_index) for r in rows[17:]] == [(17, 1, None), (18, 2, 17), (19, 3, 18), (20, 3, 18)]
    assert store.last_heading(str(file.resolve())).content == "Caching Strategy" and store.max_local_index(str(file.resolve())) == 20
    found = api.search("redis caching", tmp_path, spark=spark)
    assert "Redis" in found[0]["context"] and found[0]["score"] > 0
    assert api.search("docker containers", tmp_path, spark=spark)
    both = api.search("redis caching", tmp_path, spark=spark, embedder=dense.HashingEmbedder(32))
    assert "Redis" in both[0]["context"] and store.status()["embedded_chunksets"] == 4
    file.write_text(NOTES + APPENDED + " \n\n")
    os.utime(file, (2, 2))
    assert api.update_file(store, file) == {"status": "unchanged"}
    file.write_text("# Other\n\ntext")
    os.utime(file, (3, 3))
    assert api.update_file(store, file) == {"status": "reindexed", "new_chunks": 2, "new_chunksets": 1}
    info = api.status(tmp_path, spark=spark)
    assert (info["total_chunks"], info["total_chunksets"], info["has_embeddings"]) == (2, 1, False)
    file.unlink()
    api.index(tmp_path, spark=spark)
    assert api.status(tmp_path, spark=spark)["files"]
    api.index(tmp_path, spark=spark, prune=True)
    assert not api.status(tmp_path, spark=spark)["files"]
    store.vacuum()


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "a.md").write_text("# Title\n\nSome words here.\n")
    cli.main(["status", "--path", str(tmp_path)])
    cli.main(["index", str(tmp_path)])
    cli.main(["search", "words", "--path", str(tmp_path)])
    cli.main(["search", "words", "--path", str(tmp_path), "--json", "--top", "1"])
    cli.main(["status", "--path", str(tmp_path)])
    out = capsys.readouterr().out
    assert "No indexed files" in out and "Indexed 1 files: 2 chunks, 1 chunksets" in out and "--- Result 1 (score: " in out and '"file_path"' in out and "Files:     1" in out
    assert "Title" in server.search_tool("words", str(tmp_path)) and "Chunks:    2" in server.status_tool(str(tmp_path)) and "unchanged" in server.index_tool(str(tmp_path), str(tmp_path / "a.md"))


def test_searches_read_what_is_stored(spark, tmp_path):
    """Postings, lengths and stems follow every change, and give what is worked out anew from the groups."""
    for n, text in enumerate((NOTES, NOTES + APPENDED, "# Other\n\nRedis text here")):
        (tmp_path / "a.md").write_text(text)
        (tmp_path / "b.md").write_text("# Second\n\nDocker and tokens.\n")
        os.utime(tmp_path / "a.md", (n, n))
        api.index(tmp_path, spark=spark)
        store = api.open_store(tmp_path, spark=spark)
        groups = store.read("chunksets")
        postings, stats = store.keyword_index()
        key = ["file_path", "local_index"]
        assert stats == keyword.statistics(groups)
        assert sorted(map(tuple, postings.collect())) == sorted(map(tuple, keyword.postings(groups, key).collect()))
    assert [r.contents for r in store.match_chunksets("redis").collect()] == ["Other\nRedis text here"]
    assert [r.content for r in store.match_chunks('"and token"').collect()] == ["Docker and tokens."]
    plain = lambda rows: [(r["file_path"], round(r["score"], 9), r["context"]) for r in rows]
    from loomspark.plans import search as plans

    fresh = plans.hybrid(store.read("chunks"), groups, "redis docker").collect()
    assert plain(api.search("redis docker", tmp_path, spark=spark, embedder=None)) == plain(fresh)


def test_hybrid_search_by_default(spark, tmp_path, monkeypatch):
    """Where an embedder is installed searches use it unasked, also those of the command line and the tools."""
    (tmp_path / "a.md").write_text(NOTES)
    api.index(tmp_path, spark=spark)
    api.search("redis", tmp_path, spark=spark)
    store = api.open_store(tmp_path, spark=spark)
    assert store.status()["embedded_chunksets"] == 0
    monkeypatch.setattr(dense, "default_embedder", lambda: dense.HashingEmbedder(16))
    assert "Docker" in server.search_tool("docker containers", str(tmp_path))
    assert store.status()["embedded_chunksets"] == 3 == store.read("embeddings").where("size(embedding) = 16").count()


def test_manifests_and_buckets(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    schema = "file_path string, char_offset bigint, content_hash string, mtime double"
    rows = spark.createDataFrame([(f"f{i}", i, "", 0.0) for i in range(20)], schema)
    store.merge("files", rows)
    before = store._newest()
    store.rebucket(8)
    assert len(store.manifest()["files"]) > 1 and store.read("files").count() == 20
    # a change that was worked out from an older state does not replace a newer one
    with pytest.raises(OSError):
        store._publish(*before)
    # what a broken writer leaves behind is not read
    (tmp_path / "s" / "new-broken").write_text("{")
    store.merge("files", rows.where("char_offset = 3").withColumn("mtime", rows.mtime + 1))
    assert store.file_record("f3").mtime == 1.0 and store.read("files").count() == 20
    store.delete(rows.where("char_offset > 3"))
    assert store.read("files").count() == 4
    store.vacuum()
    assert store.read("files").count() == 4


def test_token_length_can_be_given(spark, tmp_path):
    (tmp_path / "a.md").write_text("# T\n\n" + "word " * 900)
    assert api.index(tmp_path, spark=spark)["chunks_created"] == 4
    assert api.index(tmp_path, db_path=tmp_path / "other", spark=spark, length=lambda t: len(t.split()))["chunks_created"] == 3
    assert api.index(tmp_path, db_path=tmp_path / "third", spark=spark, length=len)["chunks_created"] == 10


def test_folders_listed_by_spark(spark, tmp_path):
    from loomspark.sources import documents

    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.md").write_bytes(b"# A\r\ntext\r")
    (tmp_path / "b.txt").write_text("no")
    (tmp_path / ".c.md").write_text("no")
    rows = documents.read_folder(spark, f"file://{tmp_path}").collect()
    assert [(r.file_path.rsplit("/", 1)[-1], r.text) for r in rows] == [("a.md", "# A\ntext\n")]
    assert [r.text for r in documents.read_folder(spark, tmp_path).collect()] == ["# A\ntext\n"]


def test_public_names():
    import loomspark

    assert all(callable(getattr(loomspark, n)) for n in loomspark.__all__) and loomspark.__version__
    assert loomspark.index is api.index and loomspark.outline("# A\nb") == [(0, "A"), (1, "b")]
    with pytest.raises(AttributeError):
        loomspark.nothing


def test_store_keys(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    row = spark.createDataFrame([("f", 0, [1], "c", "")], "file_path string, local_index int, chunk_ids array<int>, contents string, to_embed string")
    store.append("chunksets", row)
    with pytest.raises(DuplicateKey):
        store.append("chunksets", row)
    store.merge("chunksets", row.withColumn("contents", row.local_index.cast("string")))
    assert [r.contents for r in store.all_chunksets().collect()] == ["0"]
    assert store.file_record("f") is None and store.max_local_index("f") == -1


def test_stream_equals_batch(spark, tmp_path):
    from loomspark.streaming.appends import outline_stream

    parts = [NOTES, APPENDED]
    schema = "file_path string, seq int, delta string"
    for k, part in enumerate(parts):
        spark.createDataFrame([("n", k, part)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/{k}"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = outline_stream(source).writeStream.format("memory").queryName("pieces").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.table("pieces").orderBy("local_index").collect()
    assert [r.local_index for r in rows] == list(range(21)) and [r.depth for r in rows[17:]] == [1, 2, 3, 3] and rows[18].parent_local_index == 17


def test_registered_queries(spark, compare):
    """A few of the registered queries against their SQL; the driver compares all of them."""
    for name in ("tree_ancestors", "tree_leaves", "pseudo_heading_flags", "chunksets_simple", "expand_deep", "change_actions", "thousands", "normalize_full", "bm25_df", "outline_blocks", "search_flagship", "search_hybrid", "fts_chunks", "upsert_files", "delete_files", "last_heading", "index_status"):
        compare(queries.QUERIES[name](spark, "/root/testdata/sf0.001"), queries.ORACLE_SQL[name])


def test_actions_do_not_depend_on_partitions(spark):
    a = queries.QUERIES["change_actions"](spark, "/root/testdata/sf0.001")
    assert {r.action for r in a.collect()} == {incremental.UNCHANGED, incremental.TOUCHED, incremental.APPEND, incremental.REINDEX}


def test_superset_dedup_of_all_line_items(spark, compare, tmp_path):
    """Against brute force on a fixture with line numbers over 4, and against SQL."""
    rows = [(1, 10, 1), (1, 10, 2), (1, 11, 2), (1, 11, 5), (1, 12, 5), (1, 13, 6), (1, 13, 7), (1, 14, 7), (1, 15, 6), (1, 15, 7), (2, 10, 7), (2, 11, 7), (2, 11, 7)]
    spark.createDataFrame(rows, "l_suppkey long, l_orderkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    sets = {}
    for tree_, order, line in rows:
        sets.setdefault((tree_, order), set()).add(line)
    want = {k: s for k, s in sets.items() if not any(o[0] == k[0] and s <= t and (len(t) > len(s) or o[1] < k[1]) for o, t in sets.items() if o != k)}
    got = {(r.tree, r.local_index): {int(x) for x in r.chunk_ids.split(",")} for r in queries.QUERIES["superset_dedup"](spark, str(tmp_path)).collect()}
    assert got == want and set(want) == {(1, 10), (1, 11), (1, 13), (2, 10)}
    compare(queries.QUERIES["superset_dedup"](spark, "/root/testdata/sf0.001"), queries.ORACLE_SQL["superset_dedup"])


def test_equal_sets_are_compared_once(spark):
    """Before sets of a tree are compared, equal ones are one row; the join therefore reads no more rows than there are different sets."""
    rows = [(t, i, ids) for t in (1, None) for i, ids in enumerate([[1], [2, 1], [1, 2], [1], [3], None, [3], [], [4, None], None])]
    sets = spark.createDataFrame(rows, "tree int, local_index int, chunk_ids array<int>")
    out = chunksets.drop_subsets(sets, ["tree"])
    assert sorted((str(r.tree), r.local_index, r.chunk_ids) for r in out.collect()) == [(t, i, ids) for t in ("1", "None") for i, ids in ((1, [1, 2]), (4, [3]), (5, None), (8, [4, None]), (9, None))]
    named = chunksets.drop_subsets(sets.withColumn("name", sets.local_index.cast("string")), ["tree"]).where("tree = 1").collect()
    assert sorted((r.local_index, r.name) for r in named) == [(1, "1"), (4, "4"), (5, "5"), (8, "8"), (9, "9")]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join LeftAnti") < plan.index("Aggregate [tree") and plan.count("Aggregate [tree") == 2


def test_arrow_functions_hold_few_rows_as_objects(spark):
    """Python's memory does not grow with the rows of a batch, and what comes out does not depend on how it is sliced."""
    import tracemalloc

    import pyarrow as pa

    from loomspark.functions import slices

    def peak(n):
        none = pa.nulls(n)
        docs = pa.array([f"# T{i}\n\n" + "Some words here. And more: ones.\n" * 200 for i in range(n)])
        out = []
        for run in (lambda: incremental.outline_pieces.func(docs, none, none), lambda: terms.stemmed.func(docs), lambda: normalize.normalize_text.func(docs)):
            tracemalloc.start()
            assert len(run()) == n
            out.append(tracemalloc.get_traced_memory()[1])
            tracemalloc.stop()
        return out

    peak(4)
    assert all(b < 1.5 * a for a, b in zip(peak(300), peak(1200)))
    rows = [(i, t, d, c) for i, (t, d, c) in enumerate([(None, None, None), ("", None, None), (NOTES, None, None), (NOTES, 1, "Up"), (None, 1, "Up"), ("x", None, "Up"), ("y", 0, None)])]
    df = spark.createDataFrame(rows, "i int, t string, d int, c string").coalesce(1)
    found = {r.i: [tuple(x) for x in r.p] for r in df.select("i", incremental.outline_pieces("t", "d", "c").alias("p")).collect()}
    want = lambda t, d, c: outline.outline(t) if c is None or d is None else outline.outline("#" * (d + 1) + f" {c}\n" + (t or ""), title=False)[1:]
    assert found == {i: want(t, d, c) for i, t, d, c in rows}
    assert [r[0] for r in df.select(terms.stemmed("t")).collect()] == [terms.match_terms(r[1]) for r in rows]
    assert [r[0] for r in df.select(normalize.normalize_text("t")).collect()] == [normalize.normalize(r[1]) for r in rows]
    texts = pa.array([None, "a b", "", "c"] * 9)
    before, slices.SLICE_CHARS = slices.SLICE_CHARS, 100
    try:
        assert slices.in_slices(terms.match_terms, pa.list_(pa.string()), texts).to_pylist() == [[], ["a", "b"], [], ["c"]] * 9
    finally:
        slices.SLICE_CHARS = before
    assert slices.in_slices(terms.match_terms, pa.list_(pa.string()), texts[:0]).to_pylist() == []
