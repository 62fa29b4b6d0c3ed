"""Trees and texts made from the tables, over all their rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspark.operators import chunksets, tree
from loomspark.sources import scratch
from loomspark.sources.store import Store, search_tables

#: Appended to the lines of every conversation, so that each kind of markup occurs.
MARKS = ["# {0}", "## {0} ##", "- {0}", "3) {0}", "***", "https://example.org/{0}", "[{0}](x)", "    {0}", "", "{0}"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def conversation_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_path, local_index, depth, content): a conversation, its turns, and the lines of each."""
    talk = table(spark, sf_dir, "conversations").where("text is not null")
    name = F.concat(F.lit("conv/"), F.col("conv_id").cast("string"))
    lines = talk.select(name.alias("file_path"), "turn", F.posexplode(F.split("text", "\n")).alias("line", "content")).select("file_path", "turn", (F.col("line") + 1).alias("line"), F.lit(2).alias("depth"), "content").where("trim(content) <> ''")
    turns = talk.select(name.alias("file_path"), "turn", F.lit(0).alias("line"), F.lit(1).alias("depth"), F.concat(F.lit("Turn "), F.col("turn").cast("string"), F.lit(" "), F.coalesce("role", F.lit(""))).alias("content"))
    top = talk.select(name.alias("file_path")).distinct().select("file_path", F.lit(-1).cast("bigint").alias("turn"), F.lit(0).alias("line"), F.lit(0).alias("depth"), F.col("file_path").alias("content"))
    rows = top.unionByName(turns).unionByName(lines)
    order = Window.partitionBy("file_path").orderBy("turn", "line", "content")
    return rows.select("file_path", (F.row_number().over(order) - 1).alias("local_index"), "depth", "content")


CONVERSATION_SQL = """talk as (select 'conv/' || conv_id as file_path, turn, role, text from conversations where text is not null),
lines as (select file_path, turn, u.i as line, 2 as depth, l[u.i] as content from (select *, string_split(text, chr(10)) as l from talk), unnest(range(1, len(l) + 1)) as u(i) where trim(l[u.i]) <> ''),
tree_rows as (select distinct file_path, -1 as turn, 0 as line, 0 as depth, file_path as content from talk union all select file_path, turn, 0, 1, 'Turn ' || turn || ' ' || coalesce(role, '') from talk union all select * from lines),
chunks as (select file_path, (row_number() over (partition by file_path order by turn, line, content) - 1)::int as local_index, depth, content from tree_rows)"""


def spaced_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, lines): the lines of marked_lines of each document, with a blank one after each but the last."""
    rows = marked_lines(spark, sf_dir).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line", "text"))).alias("l"))
    return rows.select("doc_id", F.split(F.array_join("l.text", "\n\n"), "\n").alias("lines"))


def conversation_index(spark: SparkSession, sf_dir: str) -> Store:
    """An index of all conversations, made once: their chunks, groups and what searches read."""
    where, new = scratch.path(spark, f"index of {sf_dir}")
    store = Store(spark, where)
    if new or not store.exists():
        linked = scratch.table(tree.link(conversation_tree(spark, sf_dir), ["file_path"], depths=[0, 1, 2]))
        chunks = linked.select("file_path", "local_index", "content", "depth", F.col("parent").alias("parent_local_index"), "ancestors", F.lit(0).alias("batch_id"))
        groups = scratch.table(chunksets.simple(linked, ["file_path"], embed=False).withColumn("to_embed", F.lit("")))
        files = chunks.select("file_path").distinct().select("file_path", F.lit(0).cast("bigint").alias("char_offset"), F.lit("").alias("content_hash"), F.lit(0.0).alias("mtime"))
        # a vector of the table for each group, in order
        number = F.row_number().over(Window.orderBy("file_path", "local_index")) - 1
        vectors = table(spark, sf_dir, "embeddings")
        own = groups.select("file_path", "local_index", (number % F.lit(max(1, vectors.count()))).alias("vec_id")).join(vectors, "vec_id").select("file_path", "local_index", "embedding")
        store.replace(files, {"files": files, "chunks": chunks, "chunksets": groups, "embeddings": own, **search_tables(chunks, groups)})
    return store


def jagged_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tree, local_index, depth): the lines of every order; depths are left out here and there."""
    items = table(spark, sf_dir, "lineitem")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    return items.select(F.col("l_orderkey").alias("tree"), (F.row_number().over(order) - 1).alias("local_index"), ((F.col("l_partkey") * 7 + F.col("l_linenumber") * 3) % 6).cast("int").alias("depth"))


JAGGED_SQL = """chunks as (select l_orderkey as tree, (row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) - 1)::int as local_index, ((l_partkey * 7 + l_linenumber * 3) % 6)::int as depth from lineitem)"""


def geo_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tree, local_index, depth, name): regions, nations, and the customers and suppliers of each."""
    region, nation = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    customer, supplier = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    top = region.select(F.col("r_regionkey").alias("tree"), F.lit(-1).alias("n"), F.lit(0).alias("kind"), F.lit(0).cast("bigint").alias("key"), F.lit(0).alias("depth"), F.col("r_name").alias("name"))
    mid = nation.select(F.col("n_regionkey").alias("tree"), F.col("n_nationkey").alias("n"), F.lit(0).alias("kind"), F.lit(0).cast("bigint").alias("key"), F.lit(1).alias("depth"), F.col("n_name").alias("name"))
    people = customer.select(F.col("c_nationkey").alias("n"), F.lit(1).alias("kind"), F.col("c_custkey").alias("key"), F.col("c_name").alias("name")).unionByName(supplier.select(F.col("s_nationkey").alias("n"), F.lit(2).alias("kind"), F.col("s_suppkey").alias("key"), F.col("s_name").alias("name")))
    low = people.join(nation.select(F.col("n_nationkey").alias("n"), F.col("n_regionkey").alias("tree")), "n").select("tree", "n", "kind", "key", F.lit(2).alias("depth"), "name")
    order = Window.partitionBy("tree").orderBy("n", "kind", "key")
    return top.unionByName(mid).unionByName(low).select("tree", (F.row_number().over(order) - 1).alias("local_index"), "depth", "name")


GEO_SQL = """geo as (select r_regionkey as tree, -1 as n, 0 as kind, 0 as key, 0 as depth, r_name as name from region union all select n_regionkey, n_nationkey, 0, 0, 1, n_name from nation
 union all select n_regionkey, n_nationkey, 1, c_custkey, 2, c_name from customer join nation on c_nationkey = n_nationkey union all select n_regionkey, n_nationkey, 2, s_suppkey, 2, s_name from supplier join nation on s_nationkey = n_nationkey),
chunks as (select tree, (row_number() over (partition by tree order by n, kind, key) - 1)::int as local_index, depth, name from geo)"""


def marked_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, line, text): every line of every document, with markup put around it in turn."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "content"))
    kind = (F.col("doc_id") + F.col("line")) % len(MARKS)
    marks = F.array(*(F.lit(m) for m in MARKS))
    return lines.select("doc_id", "line", F.replace(F.get(marks, kind.cast("int")), F.lit("{0}"), F.col("content")).alias("text"))


MARKED_SQL = "lines as (select doc_id, (u.i - 1)::int as line, l[u.i] as content from (select doc_id, string_split(text, chr(10)) as l from documents where text is not null), unnest(range(1, len(l) + 1)) as u(i)), marked as (select doc_id, line, replace([" + ", ".join("'" + m + "'" for m in MARKS) + f"][((doc_id + line) % {len(MARKS)} + 1)::int], '{{0}}', content) as text from lines)"


#: Sentence ends and other marks at which lines are taken apart, and those that begin markup.
_PLAIN = r"[^\p{L}\p{N} \n]"


def plain_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_path, text): each conversation as markdown of every kind of block, with lines of letters, digits and spaces only, so that a line is a piece."""
    talk = table(spark, sf_dir, "conversations").where("text is not null")
    lines = F.filter(F.transform(F.split(F.regexp_replace("text", _PLAIN, ""), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    turn, role = F.col("turn").cast("string"), F.coalesce("role", F.lit(""))
    block = F.concat(F.lit("\n## Turn "), turn, F.lit(" "), role, F.lit("\n\n***\n| role | turn |\n|---|---|\n| "), role, F.lit(" | "), turn, F.lit(" |\n\n```\nturn "), turn, F.lit("\n\n# no heading\n```\n\n"), F.array_join(F.transform(lines, lambda x: F.concat(F.lit("- "), x)), "\n"), F.lit("\n"))
    parts = talk.groupBy(F.concat(F.lit("conv/"), F.col("conv_id").cast("string")).alias("file_path")).agg(F.array_sort(F.collect_list(F.struct("turn", block.alias("part")))).alias("p"))
    return parts.select("file_path", F.concat(F.lit("# "), F.col("file_path"), F.lit("\n"), F.array_join("p.part", "")).alias("text"))


#: The chunks that outline makes of plain_markdown: a title, and for each turn its heading (1), a table (3, then 0 for further
#: lines), a code block (3, then 0, blank lines left out) and its lines as items (3).
PLAIN_SQL = r"""talk as (select 'conv/' || conv_id as file_path, turn, coalesce(role, '') as role, list_filter(list_transform(string_split(regexp_replace(text, '[^\p{L}\p{N} \n]', '', 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> '') as l from conversations where text is not null),
pieces as (select distinct file_path, -1 as turn, 0 as n, 0 as depth, file_path as content from talk
 union all select file_path, turn, u.n, u.d, u.c from talk, unnest([{'n': 1, 'd': 1, 'c': 'Turn ' || turn || ' ' || role}, {'n': 2, 'd': 3, 'c': '| role | turn |'}, {'n': 3, 'd': 0, 'c': '|---|---|'}, {'n': 4, 'd': 0, 'c': '| ' || role || ' | ' || turn || ' |'}, {'n': 5, 'd': 3, 'c': '```'}, {'n': 6, 'd': 0, 'c': 'turn ' || turn}, {'n': 7, 'd': 0, 'c': '# no heading'}, {'n': 8, 'd': 0, 'c': '```'}]) as t(u)
 union all select file_path, turn, 8 + u.i, 3, '- ' || l[u.i] from talk, unnest(range(1, len(l) + 1)) as u(i)),
chunks as (select file_path, (row_number() over (partition by file_path order by turn, n) - 1)::int as local_index, depth, content from pieces)"""


def conversation_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_path, text): each conversation as a markdown document."""
    talk = table(spark, sf_dir, "conversations").where("text is not null")
    part = F.concat(F.lit("\n## Turn "), F.col("turn").cast("string"), F.lit(" "), F.coalesce("role", F.lit("")), F.lit("\n\n"), F.regexp_replace("text", "\n", "\n- "), F.lit("\n"))
    parts = talk.groupBy(F.concat(F.lit("conv/"), F.col("conv_id").cast("string")).alias("file_path")).agg(F.array_sort(F.collect_list(F.struct("turn", part.alias("part")))).alias("p"))
    return parts.select("file_path", F.concat(F.lit("# "), F.col("file_path"), F.lit("\n"), F.array_join("p.part", "")).alias("text"))
