"""Token ids as Simple-8b words.

A word is 64 bits: a selector of four bits and 60 bits of payload holding n
ids of w bits.  Selector 0 is an escape: the next word is one raw id of up to
64 bits.  A row is cut into blocks of BLOCK ids; blocks start at a word, and
the offsets of their first words are kept, so blocks are coded and decoded
side by side with array operations, and any block can be read alone.

Defined results: null ids or texts give null output; an empty list or text
gives empty bytes and no offsets; ids are read as unsigned; repeated rows are
coded alike and all stay; an empty table gives an empty result; lists and
texts of any length are coded whole; other columns are kept, and one named
like an output is replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from loomspark.llm import bpe
from loomspark.llm.vec import lean, pieces, utf8

BLOCK = 256
#: Number and width of the ids of a word, by selector; selector 0 escapes.
COUNTS = np.array([0, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 1])
WIDTHS = np.array([0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 60])
_BY_COUNT = np.zeros(61, np.uint64)
_BY_COUNT[COUNTS[1:15]] = np.arange(1, 15)


def _bits(v: np.ndarray) -> np.ndarray:
    """Bit lengths, 0 counting as one bit."""
    if not len(v):
        return np.empty(0, np.uint8)
    if int(v.max()) < 1 << 52:
        out = np.frexp(v.astype(np.float64))[1].astype(np.uint8)
    else:
        out = np.zeros(len(v), np.uint8)
        for k in range(64):
            out[v >> np.uint64(k) > 0] = k + 1
    return np.maximum(out, 1)


def encode_rows(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words, word offset of each row (n + 1), word offset of each block within its row, block offset of each row (n + 1)."""
    v = values.astype(np.uint64)
    number = np.diff(offsets)
    blocks = -(-number // BLOCK)
    row_block = np.zeros(len(offsets), np.int64)
    np.cumsum(blocks, out=row_block[1:])
    n_blocks = int(row_block[-1])
    row_of = np.repeat(np.arange(len(number)), blocks)
    start = offsets[:-1][row_of] + (np.arange(n_blocks) - row_block[:-1][row_of]) * BLOCK
    end = np.minimum(start + BLOCK, offsets[1:][row_of])
    n = len(v)
    # most ids that one word can take from each place on: the highest bit length of every window, doubled up
    bits = _bits(v)
    fits = np.ones(n, np.uint8)
    fits[bits > 60] = 0
    levels = {1: bits}
    for p in (2, 4, 8, 16, 32):
        if p <= n:
            h = levels[p // 2]
            levels[p] = np.maximum(h[: n - p + 1], h[p // 2 : n - p // 2 + 1])
    for count, width in zip(COUNTS[13:0:-1].tolist(), WIDTHS[13:0:-1].tolist()):
        if count > n:
            break
        p = 1 << (count.bit_length() - 1)
        h = levels[p]
        m = n - count + 1
        ok = np.maximum(h[:m], h[count - p : count - p + m]) <= width
        np.copyto(fits[:m], count, where=ok)
    # walk all blocks at once
    at, who = start.copy(), np.arange(n_blocks)
    words_of = np.zeros(n_blocks, np.int64)
    steps = []
    rank = _BY_COUNT.astype(np.int64)
    sizes = COUNTS[1:15][::-1]  # ascending
    while len(who):
        a = at[who]
        left = end[who] - a
        take = fits[a].astype(np.int64)
        # never past the end of the block: the largest size that still fits the rest
        over = take > left
        if over.any():
            take[over] = sizes[np.searchsorted(sizes, left[over], "right") - 1]
        steps.append((who, a, take, words_of[who].copy()))
        words_of[who] += np.where(take == 0, 2, 1)
        at[who] = a + np.maximum(take, 1)
        who = who[at[who] < end[who]]
    block_word = np.zeros(n_blocks + 1, np.int64)
    np.cumsum(words_of, out=block_word[1:])
    out = np.zeros(int(block_word[-1]), np.uint64)
    if steps:
        who, a, take, nth = (np.concatenate(x) for x in zip(*steps))
        place = block_word[who] + nth
        for s in range(1, 15):
            i = np.flatnonzero(take == COUNTS[s])
            if len(i):
                word = np.full(len(i), np.uint64(s) << np.uint64(60), np.uint64)
                for k in range(int(COUNTS[s])):
                    word |= v[a[i] + k] << np.uint64(k * int(WIDTHS[s]))
                out[place[i]] = word
        i = np.flatnonzero(take == 0)
        out[place[i] + 1] = v[a[i]]
    row_word = block_word[row_block]
    return out, row_word, block_word[:-1] - row_word[:-1][row_of], row_block


def decode_words(words: np.ndarray, block_start: np.ndarray) -> np.ndarray:
    """All ids of the words; block_start holds the first word of every block, which is what tells an escaped word from a selector."""
    if not len(words):
        return np.empty(0, np.uint64)
    selector = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    # an escape has selector 0 but an escaped word may too; runs of such words are resolved by walking blocks side by side
    zero = np.flatnonzero(selector == 0)
    if len(zero):
        at, stop = block_start.copy(), np.append(block_start[1:], len(words))
        nxt = np.append(zero, len(words))
        while True:
            z = nxt[np.minimum(np.searchsorted(zero, at), len(zero))]
            live = z < stop
            if not live.any():
                break
            raw[z[live] + 1] = True
            at[live] = z[live] + 2
            at[~live] = stop[~live]
    count = np.where(raw, 1, COUNTS[selector])
    place = np.cumsum(count) - count
    out = np.empty(int(count.sum()), np.uint64)
    out[place[raw]] = words[raw]
    for s in range(1, 15):
        i = np.flatnonzero((selector == s) & ~raw)
        if len(i):
            mask = np.uint64((1 << int(WIDTHS[s])) - 1)
            for k in range(int(COUNTS[s])):
                out[place[i] + k] = words[i] >> np.uint64(k * int(WIDTHS[s])) & mask
    return out


def _binary(words: np.ndarray, row_word: np.ndarray, null: np.ndarray) -> pa.Array:
    mask = None
    if null.any():
        mask = pa.py_buffer(np.packbits(~null, bitorder="little").tobytes())
    return pa.Array.from_buffers(pa.binary(), len(null), [mask, pa.py_buffer((row_word * 8).astype(np.int32).tobytes()), pa.py_buffer(words.astype("<u8").tobytes())])


_OUT = (T.StructField("n_tokens", T.IntegerType()), T.StructField("block_offsets", T.ArrayType(T.IntegerType())), T.StructField("packed", T.BinaryType()))


def _packed(values: np.ndarray, offsets: np.ndarray, null: np.ndarray) -> dict[str, pa.Array]:
    words, row_word, block_at, row_block = encode_rows(values, offsets)
    return {"n_tokens": pa.array(np.diff(offsets).astype(np.int32), mask=null), "block_offsets": bpe._lists(block_at.astype(np.int32), row_block, null), "packed": _binary(words, row_word, null)}


def pack_ids(df: DataFrame, ids: str = "ids") -> DataFrame:
    """Replaces an array of ids by n_tokens, block_offsets and packed."""
    keep = [c for c in df.columns if c not in (ids, "n_tokens", "block_offsets", "packed")]
    schema = T.StructType([*(df.schema[c] for c in keep), *_OUT])

    def run(batches):
        for b in batches:
            column = b.column(b.schema.get_field_index(ids))
            null = bpe.nulls(column)
            number = np.where(null, 0, column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            offsets = np.zeros(len(number) + 1, np.int64)
            np.cumsum(number, out=offsets[1:])
            flat = column.flatten()
            if flat.null_count:
                raise ValueError("an id is null")
            yield bpe._replace(b, keep, _packed(flat.to_numpy(zero_copy_only=False), offsets, null), schema)

    return df.mapInArrow(lean(run), schema)


def unpack_ids(df: DataFrame, ids: str = "ids") -> DataFrame:
    """The ids of n_tokens, block_offsets and packed, as an array of long."""
    keep = [c for c in df.columns if c not in (ids, "block_offsets", "packed")]
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(ids, T.ArrayType(T.LongType()))])

    def run(batches):
        for b in batches:
            packed, blocks = (b.column(b.schema.get_field_index(c)) for c in ("packed", "block_offsets"))
            null = bpe.nulls(packed)
            data, off = utf8(packed)
            row_word = off // 8
            n_blocks = np.where(null, 0, blocks.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            within = blocks.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            number = b.column(b.schema.get_field_index("n_tokens")).fill_null(0).to_numpy(zero_copy_only=False)
            values = decode_words(np.frombuffer(data.tobytes(), "<u8"), within + np.repeat(row_word[:-1], n_blocks))
            offsets = np.zeros(len(number) + 1, np.int64)
            np.cumsum(np.where(null, 0, number), out=offsets[1:])
            yield bpe._replace(b, keep, {ids: bpe._lists(values.astype(np.int64), offsets, null)}, schema)

    return df.mapInArrow(lean(run), schema)


def encode_packed(df: DataFrame, path: str = bpe.DEFAULT_VOCABULARY, text: str = "text") -> DataFrame:
    """Token ids of a text column, packed; one pass without an array of ids in between, no shuffle."""
    key, tables = bpe.vocabulary(df.sparkSession, path)
    keep = [c for c in df.columns if c not in (text, "n_tokens", "block_offsets", "packed")]
    schema = T.StructType([*(df.schema[c] for c in keep), *_OUT])

    def run(batches):
        e = bpe.encoder(key, tables)
        for batch in batches:
            for b in pieces(batch, text, bpe.PIECE):
                column = b.column(b.schema.get_field_index(text))
                values, offsets = e.encode(*utf8(column))
                yield bpe._replace(b, keep, _packed(values, offsets, bpe.nulls(column)), schema)

    return df.mapInArrow(lean(run), schema)


