"""Keyword retrieval: BM25 over groups of chunks, and boolean full-text matching."""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.functions import terms as T

K1, B = 1.5, 0.75


def postings(df: DataFrame, key: list[str], text: str = "contents", stop_words: list[str] | None = None) -> DataFrame:
    """(term, key, tf, dl): how often each term is in each text, and how many terms the text has. One shuffle, combined on the map side."""
    words = T.terms(text, stop_words)
    each = df.select(*key, words.alias("words")).select(*key, F.size("words").alias("dl"), F.explode("words").alias("term"))
    return each.groupBy("term", *key, "dl").agg(F.count("*").alias("tf")).select("term", *key, F.col("tf").cast("int"), "dl")


def document_frequencies(df: DataFrame, text: str = "contents", stop_words: list[str] | None = None) -> DataFrame:
    """(term, df, cf): in how many texts each term is, and how often in all. One aggregation by term, combined on the map side."""
    words = df.select(T.terms(text, stop_words).alias("words"))
    # a text sends each of its terms once to the sum of texts, and every time to that of occurrences
    each = words.select(F.explode(F.concat(F.transform(F.array_distinct("words"), lambda w: F.struct(w.alias("term"), F.lit(1).alias("d"), F.lit(0).alias("c"))), F.transform("words", lambda w: F.struct(w.alias("term"), F.lit(0).alias("d"), F.lit(1).alias("c"))))).alias("x"))
    return each.groupBy("x.term").agg(F.sum("x.d").alias("df"), F.sum("x.c").alias("cf"))


@dataclass
class Statistics:
    """Number of texts and their mean length in terms."""

    texts: int
    mean_length: float


def statistics(df: DataFrame, text: str = "contents", stop_words: list[str] | None = None) -> Statistics:
    r = df.agg(F.count("*").alias("n"), F.avg(F.coalesce(F.size(T.terms(text, stop_words)), F.lit(0)).cast("double")).alias("mean")).first()
    return Statistics(r["n"], float(r["mean"] or 0.0))


def statistics_of(lengths: DataFrame, length: str = "n_terms") -> Statistics:
    """The same from a table that holds the number of terms of each text."""
    r = lengths.agg(F.count("*").alias("n"), F.avg(F.coalesce(length, F.lit(0)).cast("double")).alias("mean")).first()
    return Statistics(r["n"], float(r["mean"] or 0.0))


def score(index: DataFrame, stats: Statistics, query: str, key: list[str], k1: float = K1, b: float = B, stop_words: list[str] | None = None) -> DataFrame:
    """(key, score) of the texts with a term of the query, each occurrence of a term in the query counting."""
    wanted = Counter(T.query_terms(query, stop_words))
    hit = index.where(F.col("term").isin(list(wanted)) if wanted else F.lit(False))
    found = {r["term"]: r["df"] for r in hit.groupBy("term").agg(F.count("*").alias("df")).collect()}
    if not found:
        return hit.select(*key, F.lit(0.0).alias("score")).limit(0)
    weight = F.create_map(*(F.lit(x) for t, df in found.items() for x in (t, wanted[t] * math.log(1 + (stats.texts - df + 0.5) / (df + 0.5)))))
    part = weight[F.col("term")] * F.col("tf") / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.lit(max(stats.mean_length, 1e-9))))
    return hit.groupBy(*key).agg(F.sum(part).alias("score"))


def search(df: DataFrame, index: DataFrame, stats: Statistics, query: str, key: list[str], k: int = 10, **options) -> DataFrame:
    """The k best rows of df with their score; where fewer have a term of the query, others follow with score 0. Ties in order of the key."""
    spark = df.sparkSession
    scored = score(index, stats, query, key, **options)
    # k rows of keys and scores come to the driver, which cuts the lineage of what follows
    top = [tuple(r) for r in scored.orderBy(F.desc("score"), *key).limit(k).select(*key, "score").collect()]
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in key) + ", score double"
    if len(top) < k:
        known = F.broadcast(spark.createDataFrame(top, kinds))
        rest = df.select(*key).join(known, key, "left_anti").orderBy(*key).limit(k - len(top)).collect()
        top += [(*r, 0.0) for r in rest]
    best = spark.createDataFrame(top, kinds)
    # the files of the keys reach the scan as a filter
    some = df.where(F.col(key[0]).isin(sorted({r[0] for r in top}))) if top else df.limit(0)
    return some.join(F.broadcast(best), key).orderBy(F.desc("score"), *key)


# --- boolean matching --------------------------------------------------------


class QuerySyntaxError(ValueError):
    pass


_TOKEN = re.compile(r'\s*(?:(?P<phrase>"(?:[^"]|"")*")|(?P<word>[^\s"()*]+)(?P<star>\*)?|(?P<paren>[()]))')


def _phrase(stems: Column, words: list[str], prefix: bool) -> Column:
    """Places (counted from 1) at which the words follow each other."""
    n = len(words)
    whole = words[:-1] if prefix else words
    at = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(stems) - n + 1))

    def here(i: Column) -> Column:
        ok = F.size(stems) >= n
        for j, w in enumerate(whole):
            ok = ok & (F.try_element_at(stems, i + j) == w)
        return ok & F.try_element_at(stems, i + n - 1).startswith(words[-1]) if prefix else ok

    return F.filter(at, lambda i: F.coalesce(here(i), F.lit(False)))


def parse_query(query: str):
    """Terms side by side are all wanted; also AND, OR, NOT, (...), "a phrase" and prefix*. Gives a function of the stems that tells whether they match, and one for each phrase that lists its places."""
    tokens, at = [], 0
    query = query.rstrip()
    while at < len(query):
        m = _TOKEN.match(query, at)
        if not m:
            raise QuerySyntaxError(f"syntax error near {query[at:]!r}")
        at = m.end()
        if m["word"] and not re.fullmatch(r"\w+", m["word"]):
            raise QuerySyntaxError(f"syntax error near {m['word']!r}")
        tokens.append(m)
    phrases: list = []
    place = 0

    def peek() -> str:
        return (tokens[place]["paren"] or ("" if tokens[place]["phrase"] else tokens[place]["word"])) if place < len(tokens) else "end"

    def operand():
        nonlocal place
        if peek() == "(":
            place += 1
            inner = either()
            if peek() != ")":
                raise QuerySyntaxError("a bracket is not closed")
            place += 1
            return inner
        if peek() in ("end", ")", "AND", "OR", "NOT"):
            raise QuerySyntaxError("a term is missing")
        m = tokens[place]
        place += 1
        words = T.match_terms(m["phrase"] or m["word"])
        prefix = bool(m["star"])
        if prefix and words:
            words[-1] = T.fold(m["word"])
        if not words:
            return lambda stems: F.lit(True)
        find = lambda stems: _phrase(stems, words, prefix)
        phrases.append(find)
        return lambda stems: F.size(find(stems)) > 0

    def but():
        nonlocal place
        left = operand()
        while peek() == "NOT":
            place += 1
            left = (lambda a, b: lambda stems: a(stems) & ~b(stems))(left, operand())
        return left

    def both():
        nonlocal place
        left = but()
        while peek() not in ("end", ")", "OR"):
            if peek() == "AND":
                place += 1
            left = (lambda a, b: lambda stems: a(stems) & b(stems))(left, but())
        return left

    def either():
        nonlocal place
        left = both()
        while peek() == "OR":
            place += 1
            left = (lambda a, b: lambda stems: a(stems) | b(stems))(left, both())
        return left

    if not tokens:
        raise QuerySyntaxError("the query is empty")
    condition = either()
    if place < len(tokens):
        raise QuerySyntaxError("a bracket too many")
    return condition, phrases


def match(df: DataFrame, query: str, key: list[str], text: str = "contents", limit: int = 20, stems: str | None = None) -> DataFrame:
    """Rows that match, best first (rank: the more negative, the better); words are stemmed and folded. `stems` names a column that holds them already."""
    condition, phrases = parse_query(query)
    words = df.withColumn("stems", F.col(stems) if stems else T.stemmed(text))
    column = F.col("stems")
    counted = words.select("*", F.size(column).alias("length"), *(F.size(p(column)).alias(f"hits{i}") for i, p in enumerate(phrases)), condition(column).alias("matches"))
    r = counted.agg(F.count("*").alias("n"), F.avg("length").alias("mean"), *(F.sum((F.col(f"hits{i}") > 0).cast("long")).alias(f"df{i}") for i in range(len(phrases)))).first()
    rank = F.lit(0.0)
    for i in range(len(phrases)):
        df_i = r[f"df{i}"] or 0
        idf = max(1e-6, math.log((r["n"] - df_i + 0.5) / (df_i + 0.5))) if r["n"] else 0.0
        tf = F.col(f"hits{i}")
        rank = rank - idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * F.col("length") / F.lit(r["mean"] or 1.0)))
    return counted.where("matches").withColumn("rank", rank).select(*df.columns, "rank").orderBy("rank", *key).limit(limit)
