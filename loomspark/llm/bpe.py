"""Byte-level BPE by per-prefix dynamic programming.

For each prefix of a pre-token there is exactly one token that ends the BPE
encoding of that prefix.  A suffix automaton of the vocabulary, walked byte by
byte, holds the longest suffix of the prefix that lies in some token; the
tokens that are suffixes of the prefix are found from its state along suffix
links, longest first.  The one that is compatible with the last token of the
prefix it leaves over (BPE would leave the two side by side) is stored.
Back-pointers from the end give exact ids without simulating merges.

The programme runs for many pre-tokens at a time.  A long pre-token is cut
into stretches that run side by side; as a sequence of tokens of which all
neighbours are compatible is the encoding, only the surroundings of cuts whose
neighbours are not are run again, wider each time.

Vocabularies are read on the driver from a rank file (base64 token, rank) and
travel to the workers as arrays in one broadcast; nothing is trained.

Defined results: a null text has null ids; an empty text has an empty list;
equal texts, and so repeated rows, have equal ids; an empty table gives an
empty result; a text of any length is encoded whole, in parts that end where a
pre-token begins; every other column is kept as it is, and a column named like
an output (`ids`, `n_tokens`, `roundtrip`) is replaced.
"""

from __future__ import annotations

import base64
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from loomspark.llm.vec import Memo, lean, pieces, ragged, span_hashes, utf8

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Bytes of the stretches of a long pre-token, and bytes from which a stretch is run by itself. Both change the time only.
STRETCH, ALONE = 64, 2048
#: Bytes that are encoded at a time; longer texts are cut before spaces.
PART = 1 << 19
PIECE = 1 << 19
#: Ids of known pre-tokens that are kept, and slots (2^n) by which they are found.
MOST_IDS, SLOTS = 1 << 22, 20
#: Bits of an automaton state; what lies above is the length after a step that went along suffix links.
STATE_BITS = 22


@dataclass
class Tables:
    """A vocabulary as arrays. Token numbers are ranks."""

    flat: np.ndarray
    start: np.ndarray
    length: np.ndarray
    left: np.ndarray
    right: np.ndarray
    merge_key: np.ndarray
    merge_id: np.ndarray
    #: The suffix automaton: edges (state << 8 | byte, sorted), suffix links, lengths; the token that a state's longest
    #: string is, or -1; the longest token among the states its suffix links lead to; for each token the next shorter one.
    edge_key: np.ndarray
    edge_to: np.ndarray
    link: np.ndarray
    depth: np.ndarray
    own: np.ndarray
    above: np.ndarray
    shorter: np.ndarray


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


def _split(token: bytes, ranks: dict[bytes, int], below: int) -> list[bytes]:
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 1:
        best, at = below, -1
        for i in range(len(parts) - 1):
            r = ranks.get(parts[i] + parts[i + 1], below)
            if r < best:
                best, at = r, i
        if at < 0:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


def build_tables(ranks: dict[bytes, int]) -> Tables:
    """Merges recovered from the ranks, and the automaton of all tokens."""
    if sorted(ranks.values()) != list(range(len(ranks))):
        raise ValueError("ranks must be 0 .. n - 1, each once")
    if any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("every single byte must be a token")
    tokens = sorted(ranks, key=ranks.__getitem__)
    n = len(tokens)
    left, right = np.arange(n, dtype=np.int64), np.arange(n, dtype=np.int64)
    usable = np.ones(n, bool)
    keys, merged = [], []
    for i, token in enumerate(tokens):
        if len(token) < 2:
            continue
        parts = _split(token, ranks, i)
        if len(parts) != 2:
            usable[i] = False
            continue
        left[i], right[i] = ranks[parts[0]], ranks[parts[1]]
        keys.append(int(left[i]) << 20 | int(right[i]))
        merged.append(i)
    order = np.argsort(np.array(keys, np.int64), kind="stable")
    edges, link, depth, state_of = suffix_automaton([t for i, t in enumerate(tokens)])
    own = np.full(len(link), -1, np.int64)
    for i in np.flatnonzero(usable).tolist():
        # no other token ends wherever this one does, so it is the longest string of its state
        own[state_of[i]] = i
    above = np.full(len(link), -1, np.int64)
    for v in sorted(range(1, len(link)), key=depth.__getitem__):
        u = link[v]
        above[v] = own[u] if own[u] >= 0 else above[u]
    lengths = np.array([len(t) for t in tokens], np.int64)
    keys_of = [v << 8 | c for v, out in enumerate(edges) for c in out]
    to = [x for out in edges for x in out.values()]
    if len(link) >= 1 << STATE_BITS or max(depth) >= 1 << (31 - STATE_BITS):
        raise ValueError("the vocabulary is too large")
    sort = np.argsort(np.array(keys_of, np.int64))
    return Tables(
        np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(lengths) - lengths, lengths, left, right, np.array(keys, np.int64)[order], np.array(merged, np.int64)[order],
        np.array(keys_of, np.int32)[sort], np.array(to, np.int32)[sort], np.array(link, np.int32), np.array(depth, np.int32), own.astype(np.int32), above.astype(np.int32), above[state_of],
    )


def suffix_automaton(strings: list[bytes]) -> tuple[list[dict[int, int]], list[int], list[int], list[int]]:
    """Edges, suffix links and lengths of the states of the automaton of all substrings, and the state of each string."""
    edges: list[dict[int, int]] = [{}]
    link, depth, ends = [-1], [0], []

    def clone(p: int, c: int, q: int) -> int:
        k = len(edges)
        edges.append(dict(edges[q]))
        link.append(link[q])
        depth.append(depth[p] + 1)
        link[q] = k
        while p >= 0 and edges[p].get(c) == q:
            edges[p][c] = k
            p = link[p]
        return k

    for string in strings:
        last = 0
        for c in string:
            q = edges[last].get(c)
            if q is not None:
                last = q if depth[q] == depth[last] + 1 else clone(last, c, q)
                continue
            new = len(edges)
            edges.append({})
            depth.append(depth[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in edges[p]:
                edges[p][c] = new
                p = link[p]
            if p >= 0:
                q = edges[p][c]
                link[new] = q if depth[q] == depth[p] + 1 else clone(p, c, q)
            last = new
        ends.append(last)
    # a state may have been split off after a string ended in it
    for i, string in enumerate(strings):
        v = 0
        for c in string:
            v = edges[v][c]
        ends[i] = v
    return edges, link, depth, ends


def _char_classes() -> np.ndarray:
    """0 other, 1 letter, 2 number, 3 white space, for every code point."""
    import regex

    table = np.zeros(0x110000, np.uint8)
    for first, last in ((0, 0xD800), (0xE000, 0x110000)):
        s = "".join(map(chr, range(first, last)))
        for k, pattern in ((1, r"\p{L}+"), (2, r"\p{N}+"), (3, r"\s+")):
            for m in regex.finditer(pattern, s):
                table[first + m.start() : first + m.end()] = k
    return table


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte position and value of each character of valid UTF-8."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    lead = data[at]
    cp = lead.astype(np.int64)
    for low, high, keep, more in ((0xC0, 0xE0, 0x1F, 1), (0xE0, 0xF0, 0x0F, 2), (0xF0, 0x100, 0x07, 3)):
        i = np.flatnonzero((lead >= low) & (lead < high) if high < 0x100 else lead >= low)
        if len(i):
            v = (lead[i] & keep).astype(np.int64)
            for k in range(1, more + 1):
                v = v << 6 | (data[at[i] + k] & 0x3F)
            cp[i] = v
    return at, cp


class Encoder:
    """Encodes and decodes whole columns; keeps the ids of pre-tokens it has met, up to a fixed number."""

    def __init__(self, tables: Tables):
        self.t = tables
        self.classes = _char_classes()
        self.compatible = Memo(self._compatible, 20)
        self.step = Memo(self._step, 20)
        self._forget()

    def _forget(self) -> None:
        self.known = np.zeros(1 << SLOTS, np.uint64)
        self.at = np.zeros(1 << SLOTS, np.int32)
        self.count = np.full(1 << SLOTS, -1, np.int32)
        self.ids = np.empty(1 << 16, np.int32)
        self.n_ids = 0

    # --- pre-tokens -------------------------------------------------------

    def pretokens(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte starts of the pre-tokens, and for each row the number of the first of its own (n + 1 entries)."""
        at, cp = code_points(data)
        n = len(at)
        row_first = np.searchsorted(at, off)
        if not n:
            return at, np.zeros(len(off), np.int64)
        kind = self.classes[cp]
        new_row = np.zeros(n + 1, bool)
        new_row[row_first] = True
        new_row[n] = True
        start = np.empty(n, bool)
        start[0] = True
        start[1:] = kind[1:] != kind[:-1]
        start |= new_row[:n]
        same_next = ~new_row[1:]
        # the last white space before other text stands alone, or joins it when it is a plain space
        space = np.flatnonzero((kind[:-1] == 3) & (kind[1:] != 3) & same_next[: n - 1])
        start[space] = True
        start[space[cp[space] == 32] + 1] = False
        # 's 't 'm 'd 're 've 'll, where a lone apostrophe begins a pre-token before letters
        c = np.flatnonzero((cp[:-1] == 39) & start[:-1] & (kind[1:] == 1) & same_next[: n - 1])
        if len(c):
            a = cp[c + 1]
            has2 = (c + 2 < n) & same_next[np.minimum(c + 1, n - 1)]
            b = np.where(has2, cp[np.minimum(c + 2, n - 1)], 0)
            two = ((a == 114) & (b == 101)) | ((a == 118) & (b == 101)) | ((a == 108) & (b == 108))
            one = (a == 115) | (a == 116) | (a == 109) | (a == 100)
            hit = one | two
            c, width = c[hit], np.where(one[hit], 2, 3)
            start[c + 1] = False
            after = c + width
            after = after[after < n]
            after = after[~new_row[after] & (kind[after] == 1)]
            start[after] = True
        first = np.flatnonzero(start)
        return at[first], np.searchsorted(at[first], off)

    # --- the dynamic programme -------------------------------------------

    def _step(self, key: np.ndarray) -> np.ndarray:
        """For keys state << 8 | byte the state after the byte, and above it the matched length if suffix links were followed, else 0."""
        t = self.t
        state, byte = key >> 8, key & 255
        out = np.zeros(len(key), np.int64)
        linked = np.zeros(len(key), bool)
        todo = np.arange(len(key))
        while len(todo):
            k = state[todo] << 8 | byte[todo]
            i = np.minimum(np.searchsorted(t.edge_key, k), len(t.edge_key) - 1)
            hit = t.edge_key[i] == k
            found = todo[hit]
            # every byte is a token, so the first state has all edges
            out[found] = t.edge_to[i[hit]] | np.where(linked[found], t.depth[state[found]] + 1, 0) << STATE_BITS
            todo = todo[~hit & (state[todo] != 0)]
            state[todo] = t.link[state[todo]]
            linked[todo] = True
        return out

    def _compatible(self, key: np.ndarray) -> np.ndarray:
        """Whether BPE leaves the two tokens of key (a << 20 | b) side by side."""
        t = self.t
        a, b = key >> 20, key & 0xFFFFF
        limit = np.full(len(key), 1 << 40, np.int64)
        out = np.zeros(len(key), np.int32)
        todo = np.arange(len(key))
        while len(todo):
            x, y, lim = a[todo], b[todo], limit[todo]
            k = x << 20 | y
            i = np.minimum(np.searchsorted(t.merge_key, k), max(0, len(t.merge_key) - 1))
            broken = (t.merge_key[i] == k) & (t.merge_id[i] < lim) if len(t.merge_key) else np.zeros(len(k), bool)
            # undo the later of the two merges that made x and y; a whole side undone means no merge crosses
            x_later = x > y
            nx, ny = t.right[x], t.left[y]
            x_atom, y_atom = nx == x, ny == y
            use_x = np.where(x_later, ~x_atom, y_atom & ~x_atom)
            use_y = np.where(x_later, x_atom & ~y_atom, ~y_atom)
            done = ~use_x & ~use_y
            out[todo[done & ~broken]] = 1
            # after one side is exhausted the limit is that of the side still being undone
            limit[todo] = np.where(use_x, np.where(x_later, x, np.minimum(x, y + 1)), np.where(use_y, np.where(x_later, np.minimum(y + 1, x), y + 1), lim))
            a[todo] = np.where(use_x, nx, x)
            b[todo] = np.where(use_y, ny, y)
            todo = todo[~done & ~broken]
        return out

    def _programme(self, flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many pre-tokens, one after the other, and their numbers."""
        t = self.t
        order = np.argsort(-length, kind="stable")
        start, length = start[order], length[order]
        width, n = int(length[0]), len(start)
        last = np.full((width + 1, n), -1, np.int32)
        state, matched = np.zeros(n, np.int64), np.zeros(n, np.int64)
        alive = np.searchsorted(-length, -np.arange(width), "left")
        for j in range(width):
            m = int(alive[j])
            to = self.step(state[:m] << 8 | flat[start[:m] + j]).astype(np.int64)
            length_now = to >> STATE_BITS
            state[:m] = v = to & ((1 << STATE_BITS) - 1)
            matched[:m] = np.where(length_now > 0, length_now, matched[:m] + 1)
            own = t.own[v]
            who, token = np.arange(m), np.where((own >= 0) & (matched[:m] == t.depth[v]), own, t.above[v]).astype(np.int64)
            while len(who):
                before = j + 1 - t.length[token]
                ok = before == 0
                rest = np.flatnonzero(~ok)
                if len(rest):
                    previous = last[before[rest], who[rest]].astype(np.int64)
                    fits = previous >= 0
                    r = rest[fits]
                    ok[r] = self.compatible(previous[fits] << 20 | token[r]) == 1
                last[j + 1, who[ok]] = token[ok]
                who, token = who[~ok], t.shorter[token[~ok]]
                more = token >= 0
                who, token = who[more], token[more]
        # back-pointers
        position, who, step = length.copy(), np.arange(n), 0
        steps_who, steps_token = [], []
        count = np.zeros(n, np.int64)
        while len(who):
            token = last[position[who], who].astype(np.int64)
            if (token < 0).any():
                raise ValueError("a prefix has no last token; the vocabulary is not a BPE vocabulary")
            steps_who.append(who)
            steps_token.append(token)
            count[who] += 1
            position[who] -= t.length[token]
            who, step = who[position[who] > 0], step + 1
        back = np.empty(n, np.int64)
        back[order] = np.arange(n)
        number = count[back]
        at = np.cumsum(number) - number
        at_sorted = np.empty(n, np.int64)
        at_sorted[back] = at
        out = np.empty(int(number.sum()), np.int32)
        for s, (w, token) in enumerate(zip(steps_who, steps_token)):
            out[at_sorted[w] + count[w] - 1 - s] = token
        return out, number

    def _fits(self, a: int, b: int) -> bool:
        """`_compatible` for one pair, with plain integers."""
        left, right, merge = self._plain[4:7]
        limit = 1 << 40
        while True:
            if merge.get(a << 20 | b, limit) < limit:
                return False
            # undo the later of the two merges that made a and b; a whole side undone means no merge crosses
            if a > b:
                if right[a] != a:
                    limit, a = a, right[a]
                elif left[b] != b:
                    limit, b = b + 1, left[b]
                else:
                    return True
            elif left[b] != b:
                limit, b = b + 1, left[b]
            elif right[a] != a:
                limit, a = a, right[a]
            else:
                return True

    def _alone(self, word: bytes) -> list[int]:
        """The programme for one long stretch, with plain integers."""
        t = self.t
        if not hasattr(self, "_plain"):
            merge = dict(zip(t.merge_key.tolist(), t.merge_id.tolist()))
            edge = dict(zip(t.edge_key.tolist(), t.edge_to.tolist()))
            self._plain = (edge, t.link.tolist(), t.depth.tolist(), (t.own.tolist(), t.above.tolist(), t.shorter.tolist(), t.length.tolist()), t.left.tolist(), t.right.tolist(), merge)
        edge, link, depth, (own, above, shorter, length) = self._plain[:4]
        last, v, matched, seen = [], 0, 0, {}
        for j, byte in enumerate(word):
            while (to := edge.get(v << 8 | byte)) is None:
                v = link[v]
                matched = depth[v]
            v, matched = to, matched + 1
            token = own[v] if own[v] >= 0 and matched == depth[v] else above[v]
            while token >= 0:
                before = j + 1 - length[token]
                if not before:
                    break
                previous = last[before - 1]
                if previous >= 0:
                    k = previous << 20 | token
                    fits = seen.get(k)
                    if fits is None:
                        fits = seen[k] = self._fits(previous, token)
                    if fits:
                        break
                token = shorter[token]
            last.append(token)
        out, at = [], len(word)
        while at:
            if last[at - 1] < 0:
                raise ValueError("a prefix has no last token; the vocabulary is not a BPE vocabulary")
            out.append(last[at - 1])
            at -= length[out[-1]]
        return out[::-1]

    def _stretches(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of byte stretches, each encoded by itself, one after the other, and their numbers; those of like length run together."""
        count, out = np.zeros(len(start), np.int64), []
        for low, high in ((0, 24), (24, STRETCH), (STRETCH, 4 * STRETCH), (4 * STRETCH, ALONE)):
            i = np.flatnonzero((length > low) & (length <= high))
            for j in range(0, len(i), 1 << 14):
                k = i[j : j + (1 << 14)]
                ids, count[k] = self._programme(data, start[k], length[k])
                out.append((k, ids))
        for k in np.flatnonzero(length > ALONE).tolist():
            ids = np.array(self._alone(data[start[k] : start[k] + length[k]].tobytes()), np.int32)
            count[k] = len(ids)
            out.append((np.array([k]), ids))
        at = np.cumsum(count) - count
        flat = np.empty(int(count.sum()), np.int32)
        for k, ids in out:
            c = count[k]
            flat[np.repeat(at[k] - (np.cumsum(c) - c), c) + np.arange(len(ids))] = ids
        return flat, count

    def _words(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-tokens, one after the other, and their numbers."""
        parts = -(-length // STRETCH)
        word = np.repeat(np.arange(len(start)), parts)
        nth = np.arange(len(word)) - np.repeat(np.cumsum(parts) - parts, parts)
        ids, count = self._stretches(data, start[word] + nth * STRETCH, np.minimum(STRETCH, length[word] - nth * STRETCH))
        if (parts == 1).all():
            return ids, count
        word, reach = np.repeat(word, count), 4
        while True:
            inside = np.flatnonzero(word[1:] == word[:-1])
            # neighbours within a stretch fit already; asking again costs a look at the memo
            bad = inside[self.compatible(ids[inside].astype(np.int64) << 20 | ids[inside + 1]) == 0]
            if not len(bad):
                return ids, np.bincount(word, minlength=len(start))
            size = self.t.length[ids]
            first = np.searchsorted(word, word[bad])
            last = np.searchsorted(word, word[bad], "right")
            low, high = np.maximum(first, bad + 1 - reach), np.minimum(last, bad + 1 + reach)
            # windows that overlap are one
            new = np.append(True, low[1:] >= np.maximum.accumulate(high)[:-1])
            at = np.flatnonzero(new)
            low, high = low[at], np.maximum.reduceat(high, at)
            place = np.zeros(len(ids) + 1, np.int64)
            np.cumsum(size, out=place[1:])
            begin = place[low] - place[np.searchsorted(word, word[low])] + start[word[low]]
            again, number = self._stretches(data, begin, place[high] - place[low])
            cover = np.zeros(len(ids) + 1, np.int64)
            cover[low] += 1
            cover[high] -= 1
            kept = np.flatnonzero(np.cumsum(cover)[:-1] == 0)
            # kept ids and the new ones of windows, in order of the ids they stand for
            order = np.argsort(np.concatenate([kept, np.repeat(low, number)]), kind="stable")
            word = np.concatenate([word[kept], np.repeat(word[low], number)])[order]
            ids = np.concatenate([ids[kept], again])[order]
            reach *= 2

    # --- columns ----------------------------------------------------------

    def _learn(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Encodes pre-tokens and keeps them; where each one's ids lie, and their numbers."""
        ids, count = self._words(data, start, end - start)
        at = self.n_ids + np.cumsum(count) - count
        need = self.n_ids + len(ids)
        if need > len(self.ids):
            grown = np.empty(max(need, min(2 * len(self.ids), MOST_IDS)), np.int32)
            grown[: self.n_ids] = self.ids[: self.n_ids]
            self.ids = grown
        self.ids[self.n_ids : need] = ids
        self.n_ids = need
        slot = (hashes >> np.uint64(64 - SLOTS)).astype(np.int64)
        # of two that share a slot the last one stays
        self.known[slot], self.at[slot], self.count[slot] = hashes, at, count
        return at, count

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the offsets of each row's own (n + 1 entries)."""
        if len(data) <= PART:
            return self._encode(data, off)
        # a pre-token begins before a space that follows another character; rows longer than a part are cut there
        row, cuts = np.flatnonzero(np.diff(off) > PART), [off]
        for a, z in zip(off[row].tolist(), off[row + 1].tolist()):
            spaces = a + 1 + np.flatnonzero((data[a + 1 : z] == 32) & (data[a : z - 1] > 32) & (data[a : z - 1] < 127))
            at = a
            while len(spaces) and z - at > PART:
                k = int(np.searchsorted(spaces, at + PART, "right")) - 1
                k = k if k >= 0 and spaces[k] > at else k + 1
                if k >= len(spaces):
                    break
                at = int(spaces[k])
                cuts.append(np.array([at]))
        edge = np.sort(np.concatenate(cuts), kind="stable")
        out, offsets, at, base = [], [np.zeros(1, np.int64)], 0, 0
        while at < len(edge) - 1:
            end = max(at + 1, int(np.searchsorted(edge, edge[at] + PART, "right")) - 1)
            ids, own = self._encode(data[edge[at] : edge[end]], edge[at : end + 1] - edge[at])
            out.append(ids)
            offsets.append(own[1:] + base)
            base += len(ids)
            at = end
        # equal edges belong to empty rows and have equal offsets
        return np.concatenate(out), np.concatenate(offsets)[np.searchsorted(edge, off)]

    def _encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start, row = self.pretokens(data, off)
        if not len(start):
            return np.empty(0, np.int32), np.zeros(len(off), np.int64)
        if self.n_ids > MOST_IDS:
            self._forget()
        end = np.append(start[1:], len(data))
        code, unique = pd.factorize(span_hashes(data, start, end))
        slot = (unique >> np.uint64(64 - SLOTS)).astype(np.int64)
        at, number = self.at[slot].astype(np.int64), self.count[slot].astype(np.int64)
        new = np.flatnonzero((self.known[slot] != unique) | (number < 0))
        if len(new):
            sample = np.empty(len(unique), np.int64)
            sample[code[::-1]] = np.arange(len(code))[::-1]  # the first of each
            at[new], number[new] = self._learn(data, start[sample[new]], end[sample[new]], unique[new])
        count = number[code]
        ids = ragged(self.ids, at[code], count)
        if not np.array_equal(self.decode(ids)[0], data):  # two pre-tokens of one hash
            ids, count = self._words(data, start, end - start)
        total = np.zeros(len(start) + 1, np.int64)
        np.cumsum(count, out=total[1:])
        return ids, total[row]

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the ids, and the number of bytes of each."""
        length = self.t.length[ids]
        return ragged(self.t.flat, self.t.start[ids], length), length


_ENCODERS: dict[str, Encoder] = {}


def encoder(key: str, tables) -> Encoder:
    """One encoder for each worker process and vocabulary."""
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(tables.value if hasattr(tables, "value") else tables)
    return _ENCODERS[key]


_BROADCAST: dict[tuple[str, str], object] = {}


def vocabulary(spark: SparkSession, path: str = DEFAULT_VOCABULARY):
    """(key, broadcast Tables); built once on the driver. The size is that of the vocabulary, not of the data."""
    key = (spark.sparkContext.applicationId, path)
    if key not in _BROADCAST:
        _BROADCAST[key] = spark.sparkContext.broadcast(build_tables(read_ranks(path)))
    return path, _BROADCAST[key]


def _replace(batch: pa.RecordBatch, keep: list[str], new: dict[str, pa.Array], schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([new[c] if c in new else batch.column(batch.schema.get_field_index(c)) for c in [*keep, *new]], names=[*keep, *new])


def _lists(values: np.ndarray, offsets: np.ndarray, null: np.ndarray) -> pa.Array:
    off = pa.array(offsets.astype(np.int32), mask=np.append(null, False)) if null.any() else pa.array(offsets.astype(np.int32))
    return pa.ListArray.from_arrays(off, pa.array(values))


def nulls(column: pa.Array) -> np.ndarray:
    return column.is_null().to_numpy(zero_copy_only=False)


def encode(df: DataFrame, path: str = DEFAULT_VOCABULARY, text: str = "text", ids: str = "ids", n_tokens: str = "n_tokens", keep_text: bool = False) -> DataFrame:
    """Adds the token ids of `text` (which goes unless keep_text) and their number. No shuffle."""
    key, tables = vocabulary(df.sparkSession, path)
    keep = [c for c in df.columns if c not in (ids, n_tokens) and (keep_text or c != text)]
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(n_tokens, T.IntegerType())])

    def run(batches):
        e = encoder(key, tables)
        for batch in batches:
            for b in pieces(batch, text, PIECE):
                column = b.column(b.schema.get_field_index(text))
                values, offsets = e.encode(*utf8(column))
                null = nulls(column)
                yield _replace(b, keep, {ids: _lists(values, offsets, null), n_tokens: pa.array(np.diff(offsets).astype(np.int32), mask=null)}, schema)

    return df.mapInArrow(lean(run), schema)


def decode(df: DataFrame, path: str = DEFAULT_VOCABULARY, ids: str = "ids", text: str = "text") -> DataFrame:
    """Adds the text of the ids as bytes; null ids give null. Ids outside the vocabulary raise."""
    key, tables = vocabulary(df.sparkSession, path)
    keep = [c for c in df.columns if c != text]
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(text, T.BinaryType())])

    def run(batches):
        e = encoder(key, tables)
        for b in batches:
            column = b.column(b.schema.get_field_index(ids))
            null = nulls(column)
            values = column.flatten().to_numpy(zero_copy_only=False)
            if len(values) and (values.min() < 0 or values.max() >= len(e.t.length)):
                raise ValueError("an id lies outside the vocabulary")
            number = np.where(null, 0, column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            data, length = e.decode(values)
            total = np.zeros(len(values) + 1, np.int64)
            np.cumsum(length, out=total[1:])
            row = np.zeros(len(b.column(0)) + 1, np.int64)
            np.cumsum(number, out=row[1:])
            off = total[row].astype(np.int32)
            out = pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer(off.tobytes()), pa.py_buffer(data.tobytes())])
            if null.any():
                out = pa.array([None if n else x for n, x in zip(null, out.to_pylist())], pa.binary())
            yield _replace(b, keep, {text: out}, schema)

    return df.mapInArrow(lean(run), schema)


def encode_decode(df: DataFrame, path: str = DEFAULT_VOCABULARY, text: str = "text", key_columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Key columns, ids, their number, and whether decoding them gives the text back byte for byte; one pass, no shuffle."""
    key, tables = vocabulary(df.sparkSession, path)
    keep = [c for c in key_columns if c in df.columns]
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.IntegerType()), T.StructField("roundtrip", T.BooleanType())])

    def run(batches):
        e = encoder(key, tables)
        for batch in batches:
            for b in pieces(batch, text, PIECE):
                column = b.column(b.schema.get_field_index(text))
                data, off = utf8(column)
                values, offsets = e.encode(data, off)
                null = nulls(column)
                back, length = e.decode(values)
                total = np.zeros(len(values) + 1, np.int64)
                np.cumsum(length, out=total[1:])
                same = total[offsets] == off
                same = same[1:] & same[:-1]
                if not np.array_equal(back, data):
                    same &= np.array([np.array_equal(back[total[offsets[i]] : total[offsets[i + 1]]], data[off[i] : off[i + 1]]) for i in range(len(off) - 1)], bool)
                yield _replace(b, keep, {"ids": _lists(values, offsets, null), "n_tokens": pa.array(np.diff(offsets).astype(np.int32), mask=null), "roundtrip": pa.array(same, mask=null)}, schema)

    return df.select(*keep, text).mapInArrow(lean(run), schema)
