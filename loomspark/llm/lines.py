"""Removal of lines that recur on many sites.

Each line (spaces at its ends aside) has a HyperLogLog sketch of the sites it
occurs on; sketches of one line merge by aggregation, on the map side first.
Lines whose estimate is within the sketch's error of the threshold get an
exact distinct count.  Lines on at least `sites` sites go from every document.

Lines are known by 128 bits of hash.  Where the boilerplate lines are few
(IN_PLACE, measured) every document drops its own where it lies and no text is
shuffled; beyond that documents are joined with the places of their lines.
Both give the same rows.

Defined results: blank lines are never boilerplate; a null site counts as one
site; a null text stays null; a document that loses all its lines keeps an
empty text; repeated rows and repeated lines are treated alike; texts of any
length are treated whole, lines of any length too; an empty table gives an
empty result. Other columns are kept, and `removed_lines` is added.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.llm import shared

SITES = 10
LG_K = 12
SALT = 0x5DEECE66D
#: Boilerplate lines up to which their hashes travel with the plan (16 bytes a line).
IN_PLACE = 50_000


def _hashes(line: Column) -> tuple[Column, Column]:
    return F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(SALT), line).alias("h2")


def _lines(df: DataFrame, text: str, *columns: Column) -> DataFrame:
    """One row for each line that is not blank, with its place and hashes."""
    each = df.select(*columns, F.posexplode(F.split(F.col(f"`{text}`"), "\n")).alias("pos", "line")).withColumn("line", F.trim("line")).where("line <> ''")
    names = [c for c in each.columns if c != "line"]
    return each.select(*names, *_hashes(F.col("line")))


def boilerplate(df: DataFrame, sites: int = SITES, text: str = "text", site: str = "source") -> DataFrame:
    """Hashes of the lines on at least `sites` sites."""
    where = F.coalesce(F.col(f"`{site}`").cast("string"), F.lit("\0")).alias("site")
    lines = _lines(df, text, where).drop("pos")
    sketched = lines.groupBy("h1", "h2").agg(F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch"), F.count("*").alias("n"))
    margin = math.ceil(4 * 1.04 / math.sqrt(1 << LG_K) * sites)
    # a line cannot be on more sites than it has occurrences
    likely = shared.store(sketched.where(F.col("n") >= sites).withColumn("estimate", F.hll_sketch_estimate("sketch")).where(F.col("estimate") >= sites - margin).select("h1", "h2", "estimate"), "line-sketches")
    near = likely.where(F.col("estimate") <= sites + margin).select("h1", "h2")
    exact = lines.join(near, ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.countDistinct("site").alias("n")).where(F.col("n") >= sites)
    return shared.store(likely.where(F.col("estimate") > sites + margin).select("h1", "h2").unionByName(exact.select("h1", "h2")), "boilerplate")


def remove(df: DataFrame, sites: int = SITES, text: str = "text", site: str = "source", doc_id: str = "doc_id", in_place: int = IN_PLACE) -> DataFrame:
    """df without its boilerplate lines, and how many each document lost."""
    names = [c for c in df.columns if c != "removed_lines"]
    gone = boilerplate(df, sites, text, site)
    number = gone.count()
    if number <= in_place:
        known = gone.collect()
        first, second = [r.h1 for r in known], [r.h2 for r in known]

        def stays(line: Column) -> Column:
            bare = F.trim(line)
            h1, h2 = _hashes(bare)
            return (bare == "") | ~(h1.isin(first) & h2.isin(second))

        lines = F.split(F.col(f"row.`{text}`"), "\n")
        cut = df.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row")).withColumn("kept", F.filter(lines, stays) if number else lines).withColumn("lost", F.when(F.col(f"row.`{text}`").isNull(), 0).otherwise(F.size(lines) - F.size("kept")))
        new = F.when(F.col("lost") == 0, F.col(f"row.`{text}`")).otherwise(F.array_join("kept", "\n"))
        return cut.select(*(new.alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in names), F.col("lost").alias("removed_lines"))
    # what goes from a text depends on the text alone, so rows are matched by it and their id
    key = [F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(-(1 << 63))).alias("k0"), F.xxhash64(F.col(f"`{text}`")).alias("k1"), F.hash(F.col(f"`{text}`")).alias("k2")]
    found = _lines(df, text, *key).join(gone, ["h1", "h2"], "left_semi").groupBy("k0", "k1", "k2").agg(F.collect_set("pos").alias("gone"))
    docs = df.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), *key)
    kept = F.array_join(F.filter(F.split(F.col(f"row.{text}"), "\n"), lambda _, i: ~F.array_contains("gone", i)), "\n")
    new = F.when(F.col("gone").isNull(), F.col(f"row.{text}")).otherwise(kept)
    joined = docs.join(found, ["k0", "k1", "k2"], "left")
    return joined.select(*(new.alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in names), F.coalesce(F.size("gone"), F.lit(0)).alias("removed_lines"))


def remove_sql(table: str = "documents", sites: int = SITES) -> str:
    return f"""with lines as (select trim(x) as line, coalesce(source, chr(1)) as site from (select source, unnest(string_split(text, chr(10))) as x from {table})),
boilerplate as (select line from lines where line <> '' group by line having count(distinct site) >= {sites}),
known as (select coalesce(list(line), []) as all_lines from boilerplate),
cut as (select d.* exclude (text), text, list_filter(string_split(text, chr(10)), lambda x: not list_contains(all_lines, trim(x))) as kept from {table} d, known)
select * exclude (text, kept), case when text is null then null else coalesce(array_to_string(kept, chr(10)), '') end as text, (len(string_split(text, chr(10))) - len(kept))::int as removed_lines from cut"""
