"""BPE, Simple-8b and packing: exact ids, exact round trips, and every edge case they name."""

import base64

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomspark.llm import bpe, packing, simple8b
from loomspark.llm.vec import span_hashes, utf8, words

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
TEXTS = ["", "a", "'s", "don't we'll ''s !'s 'sand  's\n's\t\t x", "  a  ", "a\n\n b", "\n \n", "'llama", "日本語 テスト１２", "é́ ñandú—“q” ٣٤", "a" * 700, "ab" * 3000, "x <|endoftext|> y", " \t a", "1's 2'd", "　　x"]


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.build_tables(bpe.read_ranks(bpe.DEFAULT_VOCABULARY)))


@pytest.fixture(scope="module")
def peer():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(bpe.DEFAULT_VOCABULARY), special_tokens={})


def encoded(e, texts):
    ids, off = e.encode(*utf8(pa.array(texts, pa.string())))
    return [ids[a:b].tolist() for a, b in zip(off, off[1:])]


def test_ids_are_exact(encoder, peer):
    assert encoded(encoder, TEXTS) == [peer.encode_ordinary(t) for t in TEXTS]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from("abe 's\n\tTé1'2.!,llrvtd- 中"), st.characters(exclude_categories=("Cs",)))), max_size=5))
def test_ids_are_exact_for_any_text(texts):
    e, p = _both()
    assert encoded(e, texts) == [p.encode_ordinary(t) for t in texts]


_KEPT = []


def _both():
    if not _KEPT:
        import tiktoken

        ranks = bpe.read_ranks(bpe.DEFAULT_VOCABULARY)
        _KEPT.extend([bpe.Encoder(bpe.build_tables(ranks)), tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})])
    return _KEPT


def test_another_vocabulary(tmp_path):
    """A vocabulary of a few merges, against merging by hand."""
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"bc": 257, b"abc": 258, b"ca": 259, b"abab": 260}
    path = tmp_path / "tiny"
    path.write_text("".join(f"{base64.b64encode(k).decode()} {v}\n" for k, v in ranks.items()))
    e = bpe.Encoder(bpe.build_tables(bpe.read_ranks(str(path))))
    for n in range(1, 6):
        for k in range(3**n):
            word = "".join("abc"[k // 3**i % 3] for i in range(n))
            assert encoded(e, [word])[0] == [ranks[x] for x in bpe._split(word.encode(), ranks, 10**6)]


def test_cache_may_be_emptied(encoder, peer, monkeypatch):
    monkeypatch.setattr(bpe, "MOST_IDS", 3)
    texts = ["one two three", "four five six one", "one two seven"]
    for t in texts * 2:
        assert encoded(encoder, [t]) == [peer.encode_ordinary(t)]


def long_runs():
    import random

    rng = random.Random(1)
    common = lambda n: "".join(chr(0x4E00 + int(rng.random() ** 3 * 3000)) for _ in range(n))
    return ["".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(8000)), common(3400), "，".join(common(rng.randint(1, 400)) for _ in range(60)), "".join(chr(rng.randint(0xE01, 0xE2E)) for _ in range(8000)), "".join(rng.choice("abcdeéß") for _ in range(20_000)), "a" * 20_000, "hah" * 5000, "the" * 5000, "-" * 5001 + "=" * 999, " " * 9001 + "x"]


def test_long_runs_without_a_break(encoder, peer):
    """Runs of 10 kB and more, which are cut into stretches: the ids are those of merging the whole run."""
    texts = long_runs()
    assert encoded(encoder, texts) == [peer.encode_ordinary(t) for t in texts]
    assert [encoded(encoder, [t])[0] for t in texts] == encoded(encoder, texts)


def test_long_runs_are_not_slow(encoder):
    """Ideographs without a break at a fifth of the rate of spaced text or better, both met for the first time."""
    import random
    import time

    rng = random.Random(2)
    took = []
    spaced = " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(60_000))
    for text in (spaced, "".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(100_000))):
        e = bpe.Encoder(encoder.t)
        t = time.time()
        encoded(e, [text])
        took.append((time.time() - t) / len(text.encode()))
    assert took[1] < 5 * took[0]


@pytest.mark.parametrize("part", [1, 50, 4000])
def test_parts_do_not_show(encoder, peer, monkeypatch, part):
    monkeypatch.setattr(bpe, "PART", part)
    texts = [*TEXTS, "", "one  two   three\n four " * 50, "nospace" * 100, ""]
    assert encoded(encoder, texts) == [peer.encode_ordinary(t) for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", min_size=1, max_size=6), min_size=1, max_size=8), st.text("abc", max_size=30))
def test_suffix_automaton(strings, text):
    """After every byte the state stands for the longest suffix read that lies in some string, and each string is the longest of its state."""
    words = [s.encode() for s in dict.fromkeys(strings)]
    edges, link, depth, ends = bpe.suffix_automaton(words)
    assert len(set(ends)) == len(words) and [depth[v] for v in ends] == [len(w) for w in words]
    parts = {w[i:j] for w in words for i in range(len(w)) for j in range(i, len(w) + 1)} | {b""}
    v, n, data = 0, 0, text.encode()
    for k, c in enumerate(data):
        while c not in edges[v] and v:
            v = link[v]
            n = depth[v]
        if c in edges[v]:
            v, n = edges[v][c], n + 1
        assert n == max(j for j in range(k + 2) if data[k + 1 - j : k + 1] in parts)
        seen = [w for w, e in zip(words, ends) if e == v and len(w) == n]
        u = link[v] if v else -1
        while u >= 0:
            seen += [w for w, e in zip(words, ends) if e == u]
            u = link[u]
        assert sorted(seen) == sorted(w for w in words if data[: k + 1].endswith(w))


def test_hash_collision_is_found(encoder, peer, monkeypatch):
    fresh = bpe.Encoder(encoder.t)
    monkeypatch.setattr(bpe, "span_hashes", lambda d, a, b: np.zeros(len(a), np.uint64))
    assert encoded(fresh, ["one two three"]) == [peer.encode_ordinary("one two three")]


def test_columns(spark):
    df = spark.createDataFrame([(1, "hello world", 7), (2, None, 8), (3, "", 9), (1, "hello world", 7)], "doc_id long, text string, ids int")
    out = bpe.encode(df, keep_text=True).orderBy("doc_id").collect()
    assert [r.n_tokens for r in out] == [2, 2, None, 0] and out[2].ids is None and out[3].ids == []
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(df)).collect()}
    assert {k: None if v is None else bytes(v).decode() for k, v in back.items()} == {1: "hello world", 2: None, 3: ""}
    both = bpe.encode_decode(df).collect()
    assert [r.roundtrip for r in both] == [True, None, True, True]
    assert bpe.encode_decode(df.limit(0)).collect() == [] and bpe.encode(df.limit(0)).collect() == []
    packed = simple8b.encode_packed(df.selectExpr("*", "1 as packed", "2 as block_offsets")).collect()
    assert sorted((r.doc_id, r.n_tokens, r.ids) for r in packed if r.doc_id != 2) == [(1, 2, 7), (1, 2, 7), (3, 0, 9)]
    assert [(r.packed, r.block_offsets, r.n_tokens) for r in packed if r.doc_id == 2] == [(None, None, None)] and simple8b.encode_packed(df.limit(0)).collect() == []
    with pytest.raises(Exception, match="outside the vocabulary"):
        bpe.decode(spark.createDataFrame([([99999999],)], "ids array<int>")).collect()


def test_query_against_peer(spark, peer):
    from loomspark.llm.queries import QUERIES

    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    rows = QUERIES["op1_bpe"](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(docs) and all(r.roundtrip and r.ids == peer.encode_ordinary(docs[r.doc_id]) for r in rows)
    packed = simple8b.unpack_ids(QUERIES["op2_token_output"](spark, "/root/testdata/sf0.001")).collect()
    assert {r.doc_id: r.ids for r in packed} == {r.doc_id: r.ids for r in rows}


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 60_000), st.integers(0, 2**64 - 1)), max_size=600), max_size=6))
def test_simple8b_round_trip(rows):
    values = np.array([x for r in rows for x in r], np.uint64)
    off = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
    coded, row_word, block_at, row_block = simple8b.encode_rows(values, off)
    start = block_at + np.repeat(row_word[:-1], np.diff(row_block))
    assert np.array_equal(simple8b.decode_words(coded, start), values)
    for i, r in enumerate(rows):  # every row, and every block, can be read alone
        own = coded[row_word[i] : row_word[i + 1]]
        at = block_at[row_block[i] : row_block[i + 1]]
        assert simple8b.decode_words(own, at).tolist() == r
        for k, a in enumerate(at):
            end = at[k + 1] if k + 1 < len(at) else len(own)
            assert simple8b.decode_words(own[a:end], np.array([0])).tolist() == r[k * simple8b.BLOCK : (k + 1) * simple8b.BLOCK]


def test_simple8b_columns(spark):
    df = spark.createDataFrame([(1, [5, 6], 0), (2, None, 0), (3, [], 0), (4, [1] * 1000, 0)], "doc_id long, ids array<long>, packed int")
    out = {r.doc_id: r for r in simple8b.pack_ids(df).collect()}
    assert out[2].packed is None and out[2].block_offsets is None and bytes(out[3].packed) == b"" and len(out[4].block_offsets) == 4
    back = {r.doc_id: r.ids for r in simple8b.unpack_ids(simple8b.pack_ids(df)).collect()}
    assert back == {1: [5, 6], 2: None, 3: [], 4: [1] * 1000}
    assert simple8b.pack_ids(df.limit(0)).collect() == []


def test_words_and_hashes():
    data, off = utf8(pa.array(["a bc", None, "é-1", "bc"]))
    start, end, row = words(data, off)
    assert [bytes(data[a:b]).decode() for a, b in zip(start, end)] == ["a", "bc", "é", "1", "bc"] and row.tolist() == [0, 0, 2, 2, 3]
    h = span_hashes(data, start, end)
    assert h[1] == h[4] and len(set(h.tolist())) == 4
    start, _, row = words(*utf8(pa.array(["ab", "cd"])))  # words end with their row
    assert start.tolist() == [0, 2] and row.tolist() == [0, 1]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=80), st.integers(1, 6))
def test_best_fit(sizes, most):
    """Against the rule applied literally."""
    fit, got = packing.BestFit(100, most), []
    open_, want = [], []
    for k, s in enumerate(sizes):
        got += fit.add([k], s)
        able = [w for w in open_ if w[0] >= s]
        if able:
            w = min(able, key=lambda w: (w[0], w[2]))
        else:
            if len(open_) >= most:
                full = min(open_, key=lambda w: (w[0], w[2]))
                open_.remove(full)
                want.append(full[1])
            w = [100, [], k]
            open_.append(w)
        w[0] -= s
        w[1].append(k)
        if not w[0]:
            open_.remove(w)
            want.append(w[1])
    assert got == want and len(fit.rooms) <= most
    assert sorted(x for w in got + fit.close() for x in w) == list(range(len(sizes)))


def test_packing_keeps_every_token(spark, peer):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(5, "doc_id")
    for window, fan_in in ((512, 2), (64, 64)):
        rows = packing.pack(docs, window=window, open_windows=4, fan_in=fan_in).collect()
        found = {}
        for r in rows:
            ids, at = np.frombuffer(bytes(r.ids), "<u2"), 0
            assert r.n_tokens == len(ids) == sum(r.lengths) <= window
            for d, s, n in zip(r.doc_ids, r.starts, r.lengths):
                found.setdefault(d, []).append((s, ids[at : at + n].tolist()))
                at += n
        for r in docs.collect():
            whole = [i for _, x in sorted(found[r.doc_id]) for i in x]
            assert whole == peer.encode_ordinary(r.text)
        # few windows are left half empty
        assert sum(r.n_tokens for r in rows) > 0.9 * window * (len(rows) - 8)


def test_packing_edges(spark):
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (None, "some text", 0), (3, "same", 0), (3, "same", 0), (4, "z " * 5000, 0)], "doc_id long, text string, ids int")
    rows = packing.pack(df, window=128).collect()
    ids = [d for r in rows for d in r.doc_ids]
    assert ids.count(3) == 2 and None in ids and 1 not in ids and 2 not in ids
    assert packing.pack(df.limit(0)).collect() == []
