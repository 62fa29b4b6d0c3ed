"""Quality rules as a bitmask ledger.

Every rule is evaluated once for every document.  The ledger is a stored table
that keeps what was measured and one bit for each rule that failed; policies
are masks with a version, so applying another policy, or asking what one rule
alone changes, reads the ledger and no text.

Measuring is one pass over the bytes of the texts, a batch at a time (one
Arrow function, no shuffle); the conditions of the rules are SQL over what was
measured.

Defined results: a null text counts as empty and fails `empty` alone; ratios
of an empty text are 0; a document with a null doc_id or lang is judged like
any other; repeated rows give repeated ledger rows; texts of any length are
measured whole; an empty table gives an empty ledger. Filtering keeps the
columns of its input, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspark.llm import shared
from loomspark.llm.vec import lean, pieces, span_hashes, utf8

SPACE = " \t\n\r\f"
SYMBOLS = "#$%&*|<>{}\\^~"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ"
DIGITS = "0123456789"
STOP = "the of and to in that is was for on with as der die und das den von mit auf les des la le et est une dans pour que el los las una por en de y".split()

#: Words in a row over which `stretch_variety` looks: the distinct share of a whole text falls with its length alone.
STRETCH = 1000

#: Measurements in order: name, and what it is in DuckDB SQL. {t} is the text, w its words, l its lines, d its distinct words.
MEASURES: list[tuple[str, str]] = [
    ("n_chars", "length(t)::bigint"),
    ("n_words", "len(w)::bigint"),
    ("n_lines", "len(l)::bigint"),
    ("word_chars", "length(translate(t, {space}, ''))::bigint"),
    ("symbols", "(length(t) - length(translate(t, {symbols}, '')))::bigint"),
    ("bangs", "(length(t) - length(replace(t, '!', '')))::bigint"),
    ("capitals", "(length(t) - length(translate(t, {upper}, '')))::bigint"),
    ("digits", "(length(t) - length(translate(t, {digits}, '')))::bigint"),
    ("repeats", "len(list_filter(range(1, len(w)), lambda i: w[i] = w[i + 1]))::bigint"),
    ("distinct_words", "len(d)::bigint"),
    ("distinct_lines", "len(list_distinct(l))::bigint"),
    ("stop_words", "len(list_filter(d, lambda x: lower(x) in ({stop})))::bigint"),
    ("ellipses", "len(list_filter(l, lambda x: ends_with(x, '...') or ends_with(x, '…')))::bigint"),
    ("bullets", "len(list_filter(l, lambda x: substr(x, 1, 2) in ('- ', '* ', '• ')))::bigint"),
    ("stretch_words", f"case when len(w) <= {STRETCH} then len(d) else list_sum(list_transform(range(1, len(w) + 1, {STRETCH}), lambda i: len(list_distinct(w[i:i + {STRETCH - 1}])))) end::bigint"),
]

#: Rules in the order of their bits: name, condition under which the document fails, in SQL that both engines read.
RULES: list[tuple[str, str]] = [
    ("empty", "n_words = 0"),
    ("few_words", "n_words between 1 and 2"),
    ("many_words", "n_words > 500000"),
    ("word_length", "n_words > 0 and (word_chars < 2 * n_words or word_chars > 15 * n_words)"),
    ("symbols", "symbols * 4 > n_words"),
    ("bangs", "n_words >= 10 and bangs * 4 > n_words"),
    ("capitals", "n_words >= 10 and capitals * 100 > n_chars * 45"),
    ("digits", "n_words > 0 and digits * 10 > n_chars * 6"),
    ("repeats", "n_words >= 10 and repeats * 10 > n_words * 3"),
    ("variety", "n_words >= 50 and distinct_words * 100 < n_words * 35"),
    ("lines", "n_lines >= 4 and distinct_lines * 2 < n_lines"),
    ("stop_words", "n_words >= 50 and stop_words < 2"),
    ("ellipses", "n_lines >= 4 and ellipses * 10 > n_lines * 3"),
    ("bullets", "n_lines >= 4 and bullets * 10 > n_lines * 9"),
    ("stretch_variety", "n_words >= 50 and stretch_words * 100 < n_words * 35"),
]
BIT = {name: 1 << k for k, (name, _) in enumerate(RULES)}

def mask(*names: str) -> int:
    return sum(BIT[n] for n in names)


#: Versioned policies: the rules that a document may not fail. `v1` and `v2` hold limits that long texts fail for their
#: length (`many_words`, `variety`); `v3` has none.
POLICIES: dict[str, int] = {
    "v1": mask("empty", "many_words", "word_length", "symbols", "bangs", "capitals", "digits", "repeats", "variety", "lines", "ellipses", "bullets"),
    "v2": sum(BIT.values()) - BIT["stretch_variety"],
    "v3": mask("empty", "word_length", "symbols", "bangs", "capitals", "digits", "repeats", "stretch_variety", "lines", "ellipses", "bullets"),
}
POLICY = "v3"


def _quoted(s: str) -> str:
    return "('" + s.replace("\t", "' || chr(9) || '").replace("\n", "' || chr(10) || '").replace("\r", "' || chr(13) || '").replace("\f", "' || chr(12) || '") + "')"


def _fill(sql: str) -> str:
    names = {"symbols": SYMBOLS, "upper": UPPER, "digits": DIGITS, "space": SPACE}
    for k, v in names.items():
        sql = sql.replace("{" + k + "}", _quoted(v))
    return sql.replace("{stop}", ", ".join(f"'{w}'" for w in STOP))


def _bits_sql() -> str:
    return " + ".join(f"case when {c} then {1 << k} else 0 end" for k, (_, c) in enumerate(RULES))


def _flags(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


_IS_SPACE, _IS_SYMBOL, _IS_DIGIT, _IS_CAPITAL = _flags(SPACE), _flags(SYMBOLS), _flags(DIGITS), _flags(UPPER[:26])
#: The other capitals are two bytes, of which this is the first.
_LATIN = _flags("".join(chr(c.encode()[1]) for c in UPPER[26:]))


def _packed(word: bytes) -> int:
    return int.from_bytes(word, "big") | len(word) << 56


_STOP = np.array(sorted(_packed(w.encode()) for w in STOP), np.int64)
_LONGEST_STOP = max(map(len, STOP))


def _distinct(unit: np.ndarray, code: np.ndarray, units: int) -> np.ndarray:
    """Number of distinct codes in each unit. Units number few, so their numbers fit above the bits of a code that tell words of a text apart."""
    if not len(code):
        return np.zeros(units, np.int64)
    bits = max(1, int(units - 1).bit_length()) if units > 1 else 0
    key = (unit.astype(np.uint64) << np.uint64(64 - bits)) | (code >> np.uint64(bits)) if bits else code.copy()
    key.sort()
    first = np.append(True, key[1:] != key[:-1])
    return np.bincount((key[first] >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(int(first.sum()), np.int64), minlength=units)


def measure(data: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """Every measurement of each row, in one pass over the bytes."""
    n = len(off) - 1

    def per_row(flag: np.ndarray) -> np.ndarray:
        total = np.zeros(len(data) + 1, np.int64)
        np.cumsum(flag, out=total[1:])
        return total[off[1:]] - total[off[:-1]]

    space = _IS_SPACE[data]
    lead = (data & 0xC0) != 0x80
    after = np.append(data[1:], np.uint8(0)) if len(data) else data
    out = {"n_chars": per_row(lead), "word_chars": per_row(lead & ~space), "symbols": per_row(_IS_SYMBOL[data]), "bangs": per_row(data == 33), "digits": per_row(_IS_DIGIT[data]), "capitals": per_row(_IS_CAPITAL[data] | ((data == 0xC3) & _LATIN[after]))}
    # words
    word = ~space
    first, last = word.copy(), word.copy()
    if len(data):
        first[1:] &= space[:-1]
        last[:-1] &= space[1:]
        cut = off[1:-1]
        cut = cut[(cut > 0) & (cut < len(data))]
        first[cut] |= word[cut]
        last[cut - 1] |= word[cut - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    row = np.searchsorted(off, start, "right") - 1
    code = span_hashes(data, start, end)
    out["n_words"] = n_words = np.bincount(row, minlength=n)
    same = (code[1:] == code[:-1]) & (row[1:] == row[:-1])
    out["repeats"] = np.bincount(row[1:][same], minlength=n)
    out["distinct_words"] = _distinct(row, code, n)
    # words of a stretch, whose number is that of the row's first stretch and those before it in the row
    stretches = np.maximum(1, -(-n_words // STRETCH))
    base = np.cumsum(stretches) - stretches
    nth = np.arange(len(start)) - (np.cumsum(n_words) - n_words)[row]
    of_stretch = _distinct(base[row] + nth // STRETCH, code, int(stretches.sum()))
    out["stretch_words"] = np.add.reduceat(of_stretch, base) if n else np.zeros(0, np.int64)
    size = end - start
    short = np.flatnonzero(size <= _LONGEST_STOP)
    packed, exact = np.zeros(len(short), np.int64), np.zeros(len(short), np.int64)
    for k in range(_LONGEST_STOP):
        own = size[short] > k
        c = np.where(own, data[np.minimum(start[short] + k, max(len(data) - 1, 0))].astype(np.int64), 0)
        lower = np.where((c >= 65) & (c <= 90), c + 32, c)
        packed, exact = np.where(own, packed << 8 | lower, packed), np.where(own, exact << 8 | c, exact)
    hit = np.isin(packed | size[short].astype(np.int64) << 56, _STOP)
    out["stop_words"] = np.bincount(np.unique(row[short][hit].astype(np.int64) << 40 | exact[hit]) >> 40, minlength=n)
    # lines, also empty ones
    breaks = np.flatnonzero(data == 10)
    # a break at the end of a row is followed by an empty line of it
    of = np.repeat(np.arange(n), per_row(data == 10) + 1)
    begin = np.empty(len(of), np.int64)
    head = np.append(True, of[1:] != of[:-1]) if len(of) else np.zeros(0, bool)
    begin[head] = off[:-1]
    begin[~head] = breaks + 1
    stop = np.empty(len(of), np.int64)
    tail = np.append(head[1:], True) if len(of) else head
    stop[tail] = off[1:]
    stop[~tail] = breaks
    out["n_lines"] = np.bincount(of, minlength=n)
    out["distinct_lines"] = _distinct(of, span_hashes(data, begin, stop), n)

    def at(place: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Bytes at places, 0 outside of their lines."""
        ok = (place >= low) & (place < high)
        return np.where(ok, data[np.clip(place, 0, max(len(data) - 1, 0))], 0) if len(data) else np.zeros(len(place), np.uint8)

    z3, z2, z1 = (at(stop - k, begin, stop) for k in (3, 2, 1))
    out["ellipses"] = np.bincount(of[((z3 == 46) & (z2 == 46) & (z1 == 46)) | ((z3 == 0xE2) & (z2 == 0x80) & (z1 == 0xA6))], minlength=n)
    a0, a1, a2, a3 = (at(begin + k, begin, stop) for k in range(4))
    out["bullets"] = np.bincount(of[(((a0 == 45) | (a0 == 42)) & (a1 == 32)) | ((a0 == 0xE2) & (a1 == 0x80) & (a2 == 0xA2) & (a3 == 32))], minlength=n)
    return out


PIECE = 1 << 19


def _measured(df: DataFrame, text: str) -> DataFrame:
    """The columns of df as c0, c1, ..., whatever their names, then the measurements and the bits."""
    names = df.columns
    at_text = names.index(text)
    plain = df.toDF(*(f"c{i}" for i in range(len(names))))
    schema = T.StructType([*plain.schema.fields, *(T.StructField(name, T.LongType()) for name, _ in MEASURES)])

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for b in pieces(batch, f"c{at_text}", PIECE):
                found = measure(*utf8(b.column(at_text)))
                yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(found[name].astype(np.int64)) for name, _ in MEASURES)], names=schema.names)

    return plain.mapInArrow(lean(run), schema).withColumn("bits", F.expr(f"cast({_bits_sql()} as bigint)"))


def ledger(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document, as a stored table: doc_id, the measurements, and the bits of the rules it fails."""
    measured = _measured(df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")), "text").drop("c1")
    return shared.store(measured, "ledger").withColumnRenamed("c0", doc_id)


_LEDGERS: dict[tuple[str, str], DataFrame] = {}


def ledger_of(df: DataFrame, name: str) -> DataFrame:
    """The ledger of a table that does not change while the application runs, written once and read by all who ask for it by name."""
    key = (df.sparkSession.sparkContext.applicationId, name)
    if key not in _LEDGERS or not shared.holds(_LEDGERS[key]):
        _LEDGERS[key] = ledger(df)
    return _LEDGERS[key]


def passes(bits: Column | str, policy: int) -> Column:
    return (F.col(bits) if isinstance(bits, str) else bits).bitwiseAND(F.lit(policy)) == 0


def judge(df: DataFrame, policies: dict[str, int] | None = None) -> DataFrame:
    """A ledger with a boolean `pass_<version>` for each policy."""
    return df.select("*", *(passes("bits", m).alias(f"pass_{v}") for v, m in (policies or POLICIES).items()))


def keep(df: DataFrame, policy: int = POLICIES[POLICY], text: str = "text") -> DataFrame:
    """The rows of df that fail no rule of the policy, with its columns. They are read from a table that holds the ledger beside them, so each rule is evaluated once."""
    names = df.columns
    stored = shared.store(_measured(df, text), "judged")
    return stored.where(passes("bits", policy)).select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names)))


def ablation(df: DataFrame, policies: dict[str, int] | None = None) -> DataFrame:
    """For each policy and each of its rules: documents failing the rule, failing no other rule of the policy, and kept with and without the rule.

    One aggregation over the bits of a ledger, of which each partition sends one row.
    """
    items = [(v, m, n) for v, m in (policies or POLICIES).items() for n in BIT if m & BIT[n]]
    bits = F.col("bits")
    sums = []
    for i, (_, m, n) in enumerate(items):
        sums += [F.sum((bits.bitwiseAND(F.lit(BIT[n])) != 0).cast("long")).alias(f"a{i}"), F.sum((bits.bitwiseAND(F.lit(m)) == BIT[n]).cast("long")).alias(f"b{i}"), F.sum((bits.bitwiseAND(F.lit(m)) == 0).cast("long")).alias(f"c{i}")]
    if not sums:
        raise ValueError("no policy has a rule")
    one = df.agg(*sums)
    rows = F.explode(F.array(*(F.struct(F.lit(v).alias("policy"), F.lit(n).alias("rule"), *(F.coalesce(F.col(f"{x}{i}"), F.lit(0)).alias(k) for x, k in (("a", "failing"), ("b", "failing_alone"), ("c", "kept")))) for i, (v, _, n) in enumerate(items))))
    return one.select(rows.alias("r")).select("r.*", (F.col("r.kept") + F.col("r.failing_alone")).alias("kept_without"))


def ledger_sql(table: str = "documents", final: str | None = None) -> str:
    """The judged ledger in DuckDB SQL; `final` is a query over `judged` instead."""
    measures = ", ".join(f"{_fill(sql)} as {name}" for name, sql in MEASURES)
    flags = ", ".join(f"(bits & {m}) = 0 as pass_{v}" for v, m in POLICIES.items())
    names = ", ".join(m[0] for m in MEASURES)
    return f"""with texts as (select doc_id, coalesce(text, '') as t from {table}),
split as (select doc_id, t, list_filter(string_split_regex(t, '[ \\t\\n\\r\\f]+'), lambda x: x <> '') as w, string_split(t, chr(10)) as l from texts),
parts as (select *, list_distinct(w) as d from split),
measured as (select doc_id, {measures} from parts),
ledger as (select doc_id, {names}, ({_bits_sql()})::bigint as bits from measured),
judged as (select *, {flags} from ledger)
{final or "select * from judged"}"""


def ablation_sql() -> str:
    parts = []
    for v, m in POLICIES.items():
        for n, b in BIT.items():
            if m & b:
                parts.append(f"select '{v}' as policy, '{n}' as rule, count(*) filter ((bits & {b}) <> 0) as failing, count(*) filter ((bits & {m}) = {b}) as failing_alone, count(*) filter ((bits & {m}) = 0) as kept, count(*) filter ((bits & {m}) in (0, {b})) as kept_without from judged")
    return ledger_sql(final=" union all ".join(parts))
