"""One query for each operator, over whole tables, with SQL for DuckDB that gives the same rows.

Arrays leave as text so that results compare by value.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.functions import normalize, outline, terms
from loomspark.operators import chunksets, context, dense, fusion, incremental, keyword, tree
from loomspark.plans import corpora, search
from loomspark.plans.corpora import CONVERSATION_SQL, GEO_SQL, JAGGED_SQL, MARKED_SQL, PLAIN_SQL
from loomspark.sources import scratch
from loomspark.sources.store import Store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
KEY = ["file_path", "local_index"]
QUERY = "the thing that turn user thonst and an est"


def query(sql: str | None = None):
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _each_line(kind: str, what: Callable):
    """A function of lines as a column, a batch at a time."""

    @F.pandas_udf(kind)
    def run(lines: pd.Series) -> pd.Series:
        return lines.map(what, na_action="ignore")

    return run


def ids_text(column) -> F.Column:
    return F.array_join(F.transform(column, lambda x: x.cast("string")), ",")


def _chunks(spark, sf_dir):
    """Conversations as linked chunks; their depths are known."""
    return tree.link(corpora.conversation_tree(spark, sf_dir), ["file_path"], depths=[0, 1, 2])


def _groups(spark, sf_dir):
    """The groups of the index of all conversations."""
    return corpora.conversation_index(spark, sf_dir).read("chunksets")


#: parents by definition: the last earlier row that is shallower
_PARENT = "(select max(p.local_index) from chunks p where p.{k} = c.{k} and p.local_index < c.local_index and p.depth < c.depth)"
_LINKED_CONV = """linked as (select *, case when depth = 0 then null when depth = 1 then 0 else last_turn end as parent from (select *, max(case when depth = 1 then local_index end) over (partition by file_path order by local_index rows between unbounded preceding and 1 preceding) as last_turn, coalesce(lead(depth) over (partition by file_path order by local_index), -1) <= depth as is_leaf from chunks)),
leaf as (select *, case when lag(parent) over w is not null and lag(parent) over w is distinct from parent then 1 else 0 end as cut from linked where is_leaf window w as (partition by file_path order by local_index)),
grp as (select *, (sum(cut) over (partition by file_path order by local_index rows unbounded preceding))::int as g from leaf),
sets as (select file_path, g as local_index, list_concat(case arg_min(depth, local_index) when 2 then [0, arg_min(parent, local_index)] when 1 then [0] else [] end, list(local_index order by local_index)) as chunk_ids from grp group by file_path, g),
chunksets as (select s.file_path, s.local_index, s.chunk_ids, string_agg(c.content, chr(10) order by c.local_index) as contents from sets s, unnest(s.chunk_ids) as u(i) join chunks c on c.file_path = s.file_path and c.local_index = u.i group by all)"""
_CONV = f"with {CONVERSATION_SQL}, {_LINKED_CONV}"


# --- lines and markup ----------------------------------------------------------


@query("""select doc_id, (u.i - 1)::int as local_index, l[u.i] as content, 0 as depth from (select doc_id, list_filter(string_split(text, chr(10)), lambda x: length(trim(x)) > 0) as l from documents), unnest(range(1, len(l) + 1)) as u(i)""")
def scan_lines(spark, sf_dir):
    return tree.parse_lines(corpora.table(spark, sf_dir, "documents"), "text", "doc_id")


@query(f"with {MARKED_SQL} select doc_id, line, length(regexp_extract(text, '^[ \\t]{{0,3}}(#{{1,6}})[ \\t]', 1))::int as level from marked where regexp_matches(text, '^[ \\t]{{0,3}}#{{1,6}}[ \\t]')")
def heading_probe(spark, sf_dir):
    level = _each_line("int", lambda x: h.level if (h := outline.heading_of(x)) else None)
    return corpora.marked_lines(spark, sf_dir).select("doc_id", "line", level("text").alias("level")).where("level is not null")


@query(f"with {MARKED_SQL} select doc_id, line, case when regexp_matches(text, '^[ \\t]*[-*+•][ \\t]') then 'bullet' when regexp_matches(text, '^[ \\t]*[0-9]+[.)][ \\t]') then 'number' else 'letter' end as kind from marked where regexp_matches(text, '^[ \\t]*([-*+•]|([0-9]+|[a-zA-ZÀ-ÿ]|[ivxlcdmIVXLCDM]+)[.)])[ \\t]')")
def list_probe(spark, sf_dir):
    def kind(line):
        item = outline.list_item(line)
        return None if item is None else "bullet" if len(item[1]) == 1 else "number" if item[1][:-1].isdigit() else "letter"

    return corpora.marked_lines(spark, sf_dir).select("doc_id", "line", _each_line("string", kind)("text").alias("kind")).where("kind is not null")


@query(f"with {MARKED_SQL} select doc_id, line from marked where regexp_matches(text, '^[ \\t]{{0,3}}((\\*[ \\t]*){{3,}}|(-[ \\t]*){{3,}}|(_[ \\t]*){{3,}})$')")
def thematic_probe(spark, sf_dir):
    return corpora.marked_lines(spark, sf_dir).where(_each_line("boolean", outline.is_thematic)("text")).select("doc_id", "line")


@query(f"with {MARKED_SQL} select doc_id, line from marked where regexp_matches(trim(text), '^(https?://[^ \\t]+|\\[[^\\]]+\\]\\([^)]+\\))$')")
def link_probe(spark, sf_dir):
    return corpora.marked_lines(spark, sf_dir).where(_each_line("boolean", outline.is_link)("text")).select("doc_id", "line")


@query(f"""with {MARKED_SQL}, ends as (select *, max(line) over (partition by doc_id) as last, trim(text, ' ' || chr(9) || chr(13)) as t from marked)
select doc_id, (2 * line)::int as line from ends where line > 0 and line < last and length(t) between 1 and 120 and not regexp_matches(t, '[.!?。！？]$') and not regexp_matches(t, '【[^】]+】') and not regexp_matches(t, '^([-*+•]|([0-9]+|[a-zA-ZÀ-ÿ]|[ivxlcdmIVXLCDM]+)[.)])[ \t]')""")
def pseudo_heading_flags(spark, sf_dir):
    """Lines between blank lines that stand as headings, in documents whose lines are set apart by blank ones."""

    @F.pandas_udf("array<int>")
    def places(lines: pd.Series) -> pd.Series:
        return lines.map(lambda x: [i for i in range(len(x)) if outline.is_pseudo_heading(list(x), i)])

    return corpora.spaced_lines(spark, sf_dir).select("doc_id", F.explode(places("lines")).alias("line"))


# --- trees -----------------------------------------------------------------------


@query(f"with {JAGGED_SQL} select tree, local_index, depth, {_PARENT.format(k='tree')} as parent from chunks c")
def tree_parent(spark, sf_dir):
    return tree.link(corpora.jagged_tree(spark, sf_dir), ["tree"], depths=list(range(6))).select("tree", "local_index", "depth", "parent")


@query(f"""with recursive {JAGGED_SQL}, linked as (select *, {_PARENT.format(k='tree')} as parent from chunks c), up as (select tree, local_index, parent as a from linked where parent is not null union all select u.tree, u.local_index, l.parent from up u join linked l on l.tree = u.tree and l.local_index = u.a where l.parent is not null)
select c.tree, c.local_index, coalesce(string_agg(a::varchar, ',' order by a), '') as ancestors from chunks c left join up u on u.tree = c.tree and u.local_index = c.local_index group by all""")
def tree_ancestors(spark, sf_dir):
    return tree.link(corpora.jagged_tree(spark, sf_dir), ["tree"], depths=list(range(6))).select("tree", "local_index", ids_text("ancestors").alias("ancestors"))


@query(f"""with {JAGGED_SQL}, linked as (select *, {_PARENT.format(k='tree')} as parent from chunks c), named as (select distinct tree, parent from linked where parent is not null)
select l.tree, l.local_index, n.parent is null as is_leaf from linked l left join named n on n.tree = l.tree and n.parent = l.local_index""")
def tree_leaves(spark, sf_dir):
    return tree.leaves(corpora.jagged_tree(spark, sf_dir), ["tree"]).select("tree", "local_index", "is_leaf")


@query(f"with {JAGGED_SQL}, ends as (select *, (select min(n.local_index) from chunks n where n.tree = c.tree and n.local_index > c.local_index and n.depth <= c.depth) as e from chunks c) select tree, local_index, (select count(*) from chunks b where b.tree = x.tree and b.local_index > x.local_index and (x.e is null or b.local_index < x.e)) as below from ends x")
def subtree_size(spark, sf_dir):
    from pyspark.sql import Window

    rows = tree.subtrees(corpora.jagged_tree(spark, sf_dir), ["tree"], depths=list(range(6)))
    n = F.count("*").over(Window.partitionBy("tree"))
    return rows.select("tree", "local_index", (F.coalesce("subtree_end", n) - F.col("local_index") - 1).cast("bigint").alias("below"))


@query(f"with {GEO_SQL}, under as (select tree, local_index, depth, name, coalesce(lead(local_index) over (partition by tree, depth order by local_index), (select count(*) from chunks k where k.tree = c.tree)) as e from chunks c where depth = 1) select tree, name, (e - local_index - 1)::bigint as members from under")
def geo_members(spark, sf_dir):
    from pyspark.sql import Window

    rows = tree.subtrees(corpora.geo_tree(spark, sf_dir), ["tree"], depths=[0, 1, 2])
    n = F.count("*").over(Window.partitionBy("tree"))
    return rows.select("tree", "depth", "name", (F.coalesce("subtree_end", n) - F.col("local_index") - 1).cast("bigint").alias("members")).where("depth = 1").drop("depth")


# --- groups ------------------------------------------------------------------------


@query(f"{_CONV} select file_path, local_index, array_to_string(chunk_ids, ',') as chunk_ids, contents from chunksets")
def chunksets_simple(spark, sf_dir):
    made = chunksets.simple(_chunks(spark, sf_dir), ["file_path"], embed=False)
    return made.select("file_path", F.col("local_index").cast("int"), ids_text("chunk_ids").alias("chunk_ids"), "contents")


@query("with t as (select doc_id, greatest(1, floor(len(list_filter(string_split_regex(text, '[ \\t\\n\\r\\f]+'), lambda x: x <> '')) * 1.3::double))::int as tokens from documents where text is not null) select doc_id, tokens, least(greatest(512, round_even(tokens * 1.1::double, 0)), 7000)::int as token_limit from t")
def token_estimate(spark, sf_dir):
    docs = corpora.table(spark, sf_dir, "documents").where("text is not null").select("doc_id", chunksets.estimated_tokens("text").alias("tokens"))
    return docs.select("doc_id", "tokens", chunksets.token_limit(F.col("tokens")).alias("token_limit"))


def _sets(spark, sf_dir):
    items = corpora.table(spark, sf_dir, "lineitem")
    return items.groupBy(F.col("l_suppkey").alias("tree"), F.col("l_orderkey").alias("local_index")).agg(F.array_sort(F.collect_set(F.col("l_linenumber"))).alias("chunk_ids"))


@query("""with s as (select l_suppkey as tree, l_orderkey as local_index, list_sort(list(distinct l_linenumber)) as ids from lineitem group by all)
select tree, local_index, array_to_string(ids, ',') as chunk_ids from s where not exists (select 1 from s o where o.tree = s.tree and list_has_all(o.ids, s.ids) and (len(o.ids) > len(s.ids) or (len(o.ids) = len(s.ids) and o.local_index < s.local_index)))""")
def superset_dedup(spark, sf_dir):
    """Over all line items: of the sets of a supplier those that no other holds."""
    return chunksets.drop_subsets(_sets(spark, sf_dir), ["tree"]).select("tree", "local_index", ids_text("chunk_ids").alias("chunk_ids"))


@query()
def chunksets_optimized(spark, sf_dir):
    return chunksets.budgeted(corpora.conversation_tree(spark, sf_dir), ["file_path"])


# --- text ------------------------------------------------------------------------


@query("select page_id, regexp_replace(regexp_replace(html, '(?is)<script.*?</script>|<style.*?</style>', '', 'g'), '<[^>]+>', '', 'g') as plain from pages")
def strip_html(spark, sf_dir):
    return corpora.table(spark, sf_dir, "pages").select("page_id", normalize.strip_html("html").alias("plain"))


@query("select doc_id, trim(regexp_replace(text, '[ \\t\\n\\r\\f]+', ' ', 'g')) as plain from documents")
def squeeze_ws(spark, sf_dir):
    return corpora.table(spark, sf_dir, "documents").select("doc_id", normalize.squeeze("text").alias("plain"))


def _thousands(text: str) -> str:
    for mark in (",", r"\."):
        for _ in range(5):
            text = rf"regexp_replace({text}, '([0-9]){mark}([0-9][0-9][0-9])([,. \t\n\r\f)\]}}]|$)', '\1\2\3', 'g')"
    return text


@query(f"select page_id, {_thousands('x')} as plain from (select page_id, html || ' ' || page_id || ',' || lpad((page_id % 1000)::varchar, 3, '0') || '.' || lpad((page_id % 997)::varchar, 3, '0') || ' kg' as x from pages)")
def thousands(spark, sf_dir):
    pages = corpora.table(spark, sf_dir, "pages")
    number = F.concat("html", F.lit(" "), F.col("page_id").cast("string"), F.lit(","), F.lpad((F.col("page_id") % 1000).cast("string"), 3, "0"), F.lit("."), F.lpad((F.col("page_id") % 997).cast("string"), 3, "0"), F.lit(" kg"))
    return pages.select("page_id", normalize.join_thousands(number).alias("plain"))


def _decomposed(text: str) -> str:
    """Compatibility decomposition of the letters and signs up to U+017F, in SQL."""
    import unicodedata

    for c in map(chr, range(0xA0, 0x180)):
        if (d := unicodedata.normalize("NFKD", c)) != c:
            text = f"replace({text}, '{c}', '{d}')"
    return text


_TAGLESS = r"regexp_replace(regexp_replace(html, '(?is)<script.*?</script>|<style.*?</style>', '', 'g'), '<[^>]+>', '', 'g')"
_UNESCAPED = f"regexp_replace(replace(replace(replace({_TAGLESS}, '&middot;', '·'), '&copy;', '©'), '&quot;', '\"'), '&amp;?', '&', 'g')"
_NORMAL = _thousands("x")


@query(f"select page_id, trim({_NORMAL}) as plain from (select page_id, regexp_replace({_decomposed('y')}, '[ \t]+', ' ', 'g') as x from (select page_id, regexp_replace({_UNESCAPED}, '[ \t\n\r\f]+', ' ', 'g') as y from pages))")
def normalize_full(spark, sf_dir):
    return corpora.table(spark, sf_dir, "pages").select("page_id", normalize.normalize_text("html").alias("plain"))


# --- keyword retrieval ---------------------------------------------------------------

_STOP = ", ".join(f"'{w}'" for w in terms.STOP_WORDS)
_WORDS = "list_filter(regexp_extract_all(lower({t}), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda x: x not in (" + _STOP + "))"
_BM25 = """{conv}, texts as (select file_path, local_index, chunk_ids, contents, {words} as w from chunksets), stats as (select count(*) as n, avg(len(w))::double as mean from texts),
posting as (select file_path, local_index, len(w) as dl, t, count(*) as tf from (select *, unnest(w) as t from texts) group by all), q as (select t, count(*) as c from (select unnest({query}) as t) group by t),
weight as (select q.t, c * ln(1 + (n - df + 0.5::double) / (df + 0.5::double)) as v from q join (select t, count(*) as df from posting group by t) using (t), stats),
scored as (select file_path, local_index, sum(v * tf / (tf + 1.5::double * (0.25::double + 0.75::double * dl / mean))) as s from posting join weight using (t), stats group by all),
best as (select file_path, local_index, chunk_ids, contents, coalesce(s, 0) as score, row_number() over (order by coalesce(s, 0) desc, file_path, local_index) as rank from texts left join scored using (file_path, local_index))""".format(conv=_CONV, words=_WORDS.format(t="contents"), query=_WORDS.format(t=f"'{QUERY}'"))


def _bm25(spark, sf_dir, k: int = 15):
    store = corpora.conversation_index(spark, sf_dir)
    return keyword.search(store.read("chunksets"), *store.keyword_index(), QUERY, KEY, k)


@query(f"select doc_id, len(w)::int as n_terms, array_to_string(w, ' ') as terms from (select doc_id, {_WORDS.format(t='text')} as w from documents where text is not null)")
def bm25_tokens(spark, sf_dir):
    docs = corpora.table(spark, sf_dir, "documents").where("text is not null").select("doc_id", terms.terms("text").alias("w"))
    return docs.select("doc_id", F.size("w").alias("n_terms"), F.array_join("w", " ").alias("terms"))


@query(f"select term, count(*) as df, sum(tf)::bigint as cf from (select doc_id, term, count(*) as tf from (select doc_id, unnest({_WORDS.format(t='text')}) as term from documents) group by all) group by term")
def bm25_df(spark, sf_dir):
    return keyword.document_frequencies(corpora.table(spark, sf_dir, "documents"), "text")


@query(f"{_BM25} select file_path, local_index, round(score, 6) as score from best where rank <= 15")
def bm25_topk(spark, sf_dir):
    return _bm25(spark, sf_dir).select("file_path", F.col("local_index").cast("int"), F.round("score", 6).alias("score"))


@query()
def fts_match(spark, sf_dir):
    """Boolean, phrase and prefix matching over the stems kept for the groups of all conversations; stemming has no SQL."""
    return corpora.conversation_index(spark, sf_dir).match_chunksets('turn AND (user OR assistant) NOT "turn 1"').select(*KEY, F.round("rank", 6).alias("rank"))


@query(f"""with {CONVERSATION_SQL}, words as (select file_path, local_index, list_filter(string_split_regex(lower(content), '[^a-z0-9]+'), lambda x: x <> '') as w from chunks where depth = 1),
hits as (select *, list_contains(w, 'user')::int as f from words) select file_path, local_index from hits where f = 1 order by len(w), file_path, local_index limit 50""")
def fts_chunks(spark, sf_dir):
    """Turns of users, by the stems kept for chunks: equal words, so the shorter text ranks first."""
    store = corpora.conversation_index(spark, sf_dir)
    return store.match_chunks("turn AND user", limit=50).select("file_path", F.col("local_index").cast("int"))


_FTS = f"""select doc_id, sum(tf)::bigint as hits from (select doc_id, t, count(*) as tf from (select doc_id, unnest({_WORDS.format(t='text')}) as t from documents) where t in ('thing', 'tion', 'oner') group by all) group by doc_id having count(*) = 3"""


@query(_FTS)
def fts_and_terms(spark, sf_dir):
    """All of three terms, unstemmed."""
    index = keyword.postings(corpora.table(spark, sf_dir, "documents"), ["doc_id"], "text").where(F.col("term").isin("thing", "tion", "oner"))
    return index.groupBy("doc_id").agg(F.sum("tf").alias("hits"), F.count("*").alias("n")).where("n = 3").drop("n")


# --- dense retrieval, fusion, files ------------------------------------------------------

_UNIT = [round(((i * 37) % 64 - 31.5) / 64, 6) for i in range(64)]
_COS = f"(select vec_id, list_cosine_similarity(list_transform(embedding, lambda x: x::double), {_UNIT}::double[]) as s from embeddings where embedding is not null)"


@query(f"select vec_id, round(s, 6) as score from {_COS} order by s desc, vec_id limit 15")
def cosine_topk(spark, sf_dir):
    return dense.search(corpora.table(spark, sf_dir, "embeddings"), _UNIT, ["vec_id"], 15, -2.0).select("vec_id", F.round("score", 6).alias("score"))


@query(f"select vec_id, round(s, 6) as score from (select * from {_COS} order by s desc, vec_id limit 200) where s >= 0.25")
def cosine_cutoff(spark, sf_dir):
    return dense.search(corpora.table(spark, sf_dir, "embeddings"), _UNIT, ["vec_id"], 200, 0.25).select("vec_id", F.round("score", 6).alias("score"))


@query()
def embed_groups(spark, sf_dir):
    """Hashed vectors for the groups of all conversations, by an Arrow function."""
    return dense.embed(_groups(spark, sf_dir).withColumn("to_embed", F.lit("")), dense.HashingEmbedder(64)).select(*KEY, "embedding")


def _lists(spark, sf_dir):
    """Two rankings of the groups: by keyword, and one that stands in for a dense one."""
    groups = _groups(spark, sf_dir)
    by_length = groups.select(*KEY, (F.length("contents") % 1009).cast("double").alias("score")).orderBy(F.desc("score"), *KEY).limit(15)
    return groups, _bm25(spark, sf_dir).select(*KEY, "score"), by_length


_FUSE = f"""{_BM25}, second as (select file_path, local_index, row_number() over (order by length(contents) % 1009 desc, file_path, local_index) as r2 from texts),
fused as (select file_path, local_index, coalesce(1.0::double / (60 + a.rank), 0) + coalesce(1.0::double / (60 + b.r2), 0) as score, a.rank as r1, b.r2 from (select * from best where rank <= 15) a full join (select * from second where r2 <= 15) b using (file_path, local_index)),
hits as (select *, row_number() over (order by score desc, r1 nulls last, r2 nulls last, file_path, local_index) as rank from fused qualify rank <= 15)"""


@query(f"{_FUSE} select file_path, local_index, round(score, 9) as score, rank::int as rank from hits")
def rrf_fuse(spark, sf_dir):
    _, a, b = _lists(spark, sf_dir)
    return fusion.reciprocal_ranks(a, b, KEY, 15).select("file_path", F.col("local_index").cast("int"), F.round("score", 9).alias("score"), "rank")


def _hits(spark, sf_dir):
    """Documents by length, as hits of the sources they come from."""
    docs = corpora.table(spark, sf_dir, "documents").select(F.coalesce("source", F.lit("")).alias("file_path"), F.col("doc_id").alias("local_index"), F.log1p(F.coalesce(F.length("text"), F.lit(0)).cast("double")).alias("score"))
    top = docs.orderBy(F.desc("score"), *KEY).limit(100)
    return fusion.ranked(top, KEY)


_HITS = "with hits as (select * from (select coalesce(source, '') as file_path, doc_id as local_index, ln(1 + coalesce(length(text), 0))::double as score, row_number() over (order by ln(1 + coalesce(length(text), 0)) desc, coalesce(source, ''), doc_id) as rank from documents) where rank <= 100)"


@query(f"{_HITS} select file_path, local_index, rank::int as rank from (select *, row_number() over (partition by file_path order by rank) as n from hits) where n <= 3")
def per_file_cap(spark, sf_dir):
    return fusion.cap_per_file(_hits(spark, sf_dir)).select("file_path", "local_index", "rank")


@query(f"{_HITS} select file_path, round(greatest(0, max(score)), 6) as score, min(rank)::int as first_rank from hits group by file_path order by max(score) desc, min(rank) limit 5")
def file_rank(spark, sf_dir):
    return fusion.rank_files(_hits(spark, sf_dir)).select("file_path", F.round("score", 6).alias("score"), "first_rank")


# --- context ---------------------------------------------------------------------------


def _picked(spark, sf_dir):
    """Every seventh line of every order is a hit."""
    return corpora.jagged_tree(spark, sf_dir).where("(tree * 5 + local_index * 3) % 7 = 0").select(F.col("tree").alias("file_path"), "local_index")


def _jagged(spark, sf_dir):
    rows = corpora.jagged_tree(spark, sf_dir).withColumnRenamed("tree", "file_path")
    return tree.link(rows, ["file_path"], depths=list(range(6)))


_PICKED = f"""with recursive {JAGGED_SQL}, linked as (select *, {_PARENT.format(k='tree')} as parent from chunks c), picked as (select tree, local_index from chunks where (tree * 5 + local_index * 3) % 7 = 0)"""
_UP = "up as (select tree, local_index from {start} union select l.tree, l.parent from up u join linked l on l.tree = u.tree and l.local_index = u.local_index where l.parent is not null)"


@query(f"{_PICKED}, {_UP.format(start='picked')} select tree as file_path, local_index from up")
def expand_ancestors(spark, sf_dir):
    return context.expand(_jagged(spark, sf_dir), _picked(spark, sf_dir)).select("file_path", F.col("local_index").cast("int"))


@query(f"""{_PICKED}, ends as (select *, (select min(n.local_index) from chunks n where n.tree = c.tree and n.local_index > c.local_index and n.depth <= c.depth) as e from chunks c),
low as (select p.tree, p.local_index, e.e from picked p join ends e using (tree, local_index) where not exists (select 1 from picked o where o.tree = p.tree and o.local_index > p.local_index and (e.e is null or o.local_index < e.e))),
found as (select tree, local_index from picked union select c.tree, c.local_index from chunks c join low l on c.tree = l.tree and c.local_index > l.local_index and (l.e is null or c.local_index < l.e)), {_UP.format(start='found')} select tree as file_path, local_index from up""")
def expand_deep(spark, sf_dir):
    return context.expand_deep(_jagged(spark, sf_dir), _picked(spark, sf_dir), depths=list(range(6))).select("file_path", F.col("local_index").cast("int"))


@query(f"""with {CONVERSATION_SQL}, chosen as (select * from chunks where (local_index * 7 + length(file_path)) % 3 <> 0), gaps as (select *, coalesce(local_index - lag(local_index) over (partition by file_path order by local_index) > 1, false) as gap from chosen)
select file_path, string_agg(case when gap then '[...]' || chr(10) else '' end || repeat('  ', depth) || content, chr(10) order by local_index) as context, string_agg(local_index::varchar, ',' order by local_index) as chunk_ids from gaps group by file_path""")
def assemble_context(spark, sf_dir):
    chunks = corpora.conversation_tree(spark, sf_dir)
    some = chunks.where("(local_index * 7 + length(file_path)) % 3 <> 0").select("file_path", "local_index")
    return context.assemble(chunks, some).select("file_path", "context", ids_text("chunk_ids").alias("chunk_ids"))


@query(f"""{_BM25}, hits as (select * from best where rank <= 15), files as (select file_path, greatest(0, max(score)) as score, min(rank) as first_rank from hits group by file_path order by score desc, first_rank limit 5),
capped as (select * from hits where file_path in (select file_path from files) qualify row_number() over (partition by file_path order by rank) <= 3), ids as (select distinct file_path, unnest(chunk_ids) as i from capped),
gaps as (select i.file_path, i, depth, content, coalesce(i - lag(i) over (partition by i.file_path order by i) > 1, false) as gap from ids i join chunks c on c.file_path = i.file_path and c.local_index = i.i)
select file_path, round(score, 6) as score, string_agg(case when gap then '[...]' || chr(10) else '' end || repeat('  ', depth) || content, chr(10) order by i) as context, string_agg(i::varchar, ',' order by i) as chunk_ids from gaps join files using (file_path) group by file_path, score""")
def search_flagship(spark, sf_dir):
    """Keyword search over all conversations, with the context of the best files."""
    store = corpora.conversation_index(spark, sf_dir)
    found = search.hybrid(store.read("chunks"), store.read("chunksets"), QUERY, index=store.keyword_index())
    return found.select("file_path", F.round("score", 6).alias("score"), "context", ids_text("chunk_ids").alias("chunk_ids"))


class FixedEmbedder:
    """Gives every query the same vector; the texts have theirs already."""

    dims, min_score = 64, -0.2

    def embed(self, texts):
        return [_UNIT for _ in texts]


_HYBRID = f"""{_BM25}, numbered as (select *, (row_number() over (order by file_path, local_index) - 1) % (select count(*) from embeddings) as vec_id from chunksets),
near as (select file_path, local_index, s from numbered join {_COS} using (vec_id)), top as (select *, row_number() over (order by s desc, file_path, local_index) as r2 from near qualify r2 <= 15), second as (select * from top where s >= -0.2),
fused as (select file_path, local_index, coalesce(1.0::double / (60 + a.rank), 0) + coalesce(1.0::double / (60 + b.r2), 0) as score, a.rank as r1, b.r2 from (select * from best where rank <= 15) a full join second b using (file_path, local_index)),
hits as (select f.*, c.chunk_ids, row_number() over (order by score desc, r1 nulls last, r2 nulls last, file_path, local_index) as rank from fused f join chunksets c using (file_path, local_index) qualify rank <= 15),
files as (select file_path, greatest(0, max(score)) as score, min(rank) as first_rank from hits group by file_path order by score desc, first_rank limit 5),
capped as (select * from hits where file_path in (select file_path from files) qualify row_number() over (partition by file_path order by rank) <= 3), ids as (select distinct file_path, unnest(chunk_ids) as i from capped),
gaps as (select i.file_path, i, depth, content, coalesce(i - lag(i) over (partition by i.file_path order by i) > 1, false) as gap from ids i join chunks c on c.file_path = i.file_path and c.local_index = i.i)
select file_path, round(score, 6) as score, string_agg(case when gap then '[...]' || chr(10) else '' end || repeat('  ', depth) || content, chr(10) order by i) as context, string_agg(i::varchar, ',' order by i) as chunk_ids from gaps join files using (file_path) group by file_path, score"""


@query(_HYBRID)
def search_hybrid(spark, sf_dir):
    """Keyword and dense search over all conversations, fused, with the context of the best files."""
    store = corpora.conversation_index(spark, sf_dir)
    found = search.hybrid(store.read("chunks"), store.read("chunksets"), QUERY, embedder=FixedEmbedder(), vectors=store.with_embeddings(), index=store.keyword_index())
    return found.select("file_path", F.round("score", 6).alias("score"), "context", ids_text("chunk_ids").alias("chunk_ids"))


# --- store and upkeep --------------------------------------------------------------------


@query("select doc_id, sha256(substr(text, 1, (n_chars // 2)::int)) as content_hash from documents where text is not null")
def prefix_hash(spark, sf_dir):
    docs = corpora.table(spark, sf_dir, "documents").where("text is not null")
    return docs.select("doc_id", incremental.fingerprint("text", F.floor(F.col("n_chars") / 2).cast("int")).alias("content_hash"))


def _listing(spark, sf_dir):
    """All documents as files, and what an index knew of them: some unchanged, some grown, some rewritten, some unknown."""
    docs = corpora.table(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").cast("string").alias("file_path"), F.concat("text", F.when(F.col("doc_id") % 5 == 3, F.lit(" \n\n")).otherwise("")).alias("text"), F.col("doc_id").cast("double").alias("mtime"), F.col("doc_id").alias("d"), F.col("n_chars").alias("n"))
    half = F.when(F.col("d") % 5 == 3, F.col("n")).otherwise(F.floor(F.col("n") / 2))
    records = docs.where("d % 5 <> 4").select("file_path", half.cast("bigint").alias("char_offset"), F.when(F.col("d") % 5 == 2, F.lit("other")).otherwise(incremental.fingerprint("text", half.cast("int"))).alias("content_hash"), F.when(F.col("d") % 5 == 0, F.col("mtime")).otherwise(F.lit(-1.0)).alias("mtime"))
    return docs.drop("d", "n"), records


@query("""with docs as (select doc_id as d, doc_id::varchar as file_path, text || case when doc_id % 5 = 3 then ' ' || chr(10) || chr(10) else '' end as text, n_chars as n, case when doc_id % 5 = 3 then n_chars else n_chars // 2 end as half from documents where text is not null)
select file_path, case when d % 5 = 0 then 'unchanged' when d % 5 = 4 or d % 5 = 2 or half = 0 then 'reindex' when length(trim(substr(text, half::int + 1), ' ' || chr(9) || chr(10) || chr(13))) = 0 then 'touched' else 'append' end as action, case when d % 5 = 0 then null else length(text)::bigint end as char_offset from docs""")
def change_actions(spark, sf_dir):
    plan = incremental.classify(*_listing(spark, sf_dir))
    after = incremental.records_after(plan).select("file_path", "char_offset")
    return plan.select("file_path", "action").join(after, "file_path", "left")


@query(f"{_CONV} select (select count(distinct file_path) from chunks) as files, (select count(*) from chunks) as total_chunks, (select count(*) from chunksets) as total_chunksets")
def index_status(spark, sf_dir):
    return corpora.conversation_index(spark, sf_dir).counts().drop("embedded_chunksets")


@query(f"with {CONVERSATION_SQL} select file_path, coalesce(max(local_index), -1)::int as max_local_index from chunks group by file_path")
def max_local_index(spark, sf_dir):
    return Store.max_local_indexes(corpora.conversation_index(spark, sf_dir).read("chunks"))


@query(f"with {CONVERSATION_SQL} select file_path, max(local_index)::int as local_index, arg_max(content, local_index) as content, arg_max(depth, local_index)::int as depth from chunks where depth <= 1 group by file_path")
def last_heading(spark, sf_dir):
    return Store.last_headings(corpora.conversation_index(spark, sf_dir).read("chunks"))


@query("""with old as (select doc_id::varchar as file_path, n_chars // 2 as char_offset, 'old' as content_hash, 0.0::double as mtime from documents), new as (select doc_id::varchar as file_path, n_chars as char_offset, lang as content_hash, 1.0::double as mtime from documents where n_chars % 2 = 0)
select * from new union all select * from old where file_path not in (select file_path from new)""")
def upsert_files(spark, sf_dir):
    """Records of all documents as files, then those of even length again with other values."""
    store = Store(spark, scratch.path(spark, f"records of {sf_dir}")[0])
    docs = corpora.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("file_path"), "n_chars", "lang")
    store.merge("files", docs.select("file_path", F.floor(F.col("n_chars") / 2).cast("bigint").alias("char_offset"), F.lit("old").alias("content_hash"), F.lit(0.0).alias("mtime")))
    store.merge("files", docs.where("n_chars % 2 = 0").select("file_path", F.col("n_chars").alias("char_offset"), F.col("lang").alias("content_hash"), F.lit(1.0).alias("mtime")))
    return store.read("files")


@query("select doc_id::varchar as file_path, n_chars as char_offset from documents where n_chars % 2 = 0")
def delete_files(spark, sf_dir):
    """Records of all documents as files; those of odd length are deleted again."""
    store = Store(spark, scratch.path(spark, f"deletions of {sf_dir}")[0])
    docs = corpora.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("file_path"), F.col("n_chars").alias("char_offset"), F.lit("").alias("content_hash"), F.lit(0.0).alias("mtime"))
    store.merge("files", docs)
    store.delete(docs.where("char_offset % 2 <> 0"))
    return store.read("files").select("file_path", "char_offset")


@query(f"{_CONV} select file_path, local_index, '[' || array_to_string(chunk_ids, ',') || ']' as json, len(chunk_ids)::int as n from chunksets")
def json_ids_roundtrip(spark, sf_dir):
    rows = _groups(spark, sf_dir).select("file_path", F.col("local_index").cast("int"), F.to_json("chunk_ids").alias("json"))
    return rows.withColumn("n", F.size(F.from_json("json", "array<int>")))


@query(f"with {PLAIN_SQL} select file_path, local_index, depth, content, {_PARENT.format(k='file_path')}::int as parent from chunks c")
def outline_blocks(spark, sf_dir):
    """All conversations as markdown with headings, rules, tables, code and lists, outlined and linked."""
    docs = corpora.plain_markdown(spark, sf_dir)
    none = F.lit(None)
    pieces = docs.select("file_path", F.posexplode(incremental.outline_pieces("text", none.cast("int"), none.cast("string"))).alias("local_index", "piece"))
    linked = tree.link(pieces.select("file_path", "local_index", "piece.depth", "piece.content"), ["file_path"], depths=[0, 1, 2, 3])
    return linked.select("file_path", "local_index", "depth", "content", "parent")


@query(f"with {PLAIN_SQL} select file_path, count(*)::int as new_chunks, 'reindexed' as status from chunks group by file_path union all select 'x/' || conv_id, null, 'unchanged' from conversations where turn = 0 and text is not null")
def index_update(spark, sf_dir):
    """The whole upkeep of an index: all conversations come in as files, beside files (one for each first turn) that are indexed already and come again as they are."""
    store = Store(spark, scratch.path(spark, f"upkeep of {sf_dir} {scratch.token()}")[0])
    first = corpora.table(spark, sf_dir, "conversations").where("turn = 0 and text is not null").select(F.concat(F.lit("x/"), F.col("conv_id").cast("string")).alias("file_path"), "text", F.lit(1.0).alias("mtime"))
    incremental.apply(store, first)
    both = first.unionByName(corpora.plain_markdown(spark, sf_dir).withColumn("mtime", F.lit(2.0)))
    return incremental.apply(store, both).select("file_path", "new_chunks", "status")


@query()
def chunk_markdown(spark, sf_dir):
    """All conversations as markdown, outlined and linked."""
    docs = corpora.conversation_markdown(spark, sf_dir)
    none = F.lit(None)
    pieces = docs.select("file_path", F.posexplode(incremental.outline_pieces("text", none.cast("int"), none.cast("string"))).alias("local_index", "piece"))
    return tree.link(pieces.select("file_path", "local_index", "piece.depth", "piece.content"), ["file_path"]).select("file_path", "local_index", "depth", "content", "parent")


@query()
def incremental_append(spark, sf_dir):
    """The first half of every conversation is indexed, then the whole is brought in: the chunks that come with the second batch."""
    whole = corpora.conversation_markdown(spark, sf_dir)
    cut = F.floor(F.length("text") / 2).cast("int")
    first = whole.select("file_path", F.substring("text", F.lit(1), cut).alias("text"), F.lit(1.0).alias("mtime"))
    empty = spark.createDataFrame([], "file_path string, char_offset bigint, content_hash string, mtime double")
    no_chunks = spark.createDataFrame([], "file_path string, local_index int, content string, depth int, parent_local_index int, ancestors array<int>, batch_id int")
    begun = incremental.classify(first, empty)
    chunks = incremental.new_chunks(begun, no_chunks)
    later = incremental.classify(whole.withColumn("mtime", F.lit(2.0)), incremental.records_after(begun))
    return incremental.new_chunks(later, chunks).drop("ancestors")
