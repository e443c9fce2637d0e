"""Vectorised pre-tokenisation of many texts at once, without regular expressions.

Each code point gets a class from a table; with its neighbours' classes it becomes a symbol; each
symbol is a function from automaton state to automaton state. An associative scan composes these
functions along the text; a slice begins wherever (state before, symbol) says so. The slices are
those of the public byte-level BPE pattern: contractions, optional space + letters / digits /
others, and white space that leaves its last character to the next slice.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache
from itertools import chain

import numpy as np

# The code points of the Unicode property White_Space.
WHITE_SPACE = [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# What may follow an apostrophe in a contraction.
SHORT, LONG = "stmd", ("re", "ve", "ll")

LETTER, DIGIT, OTHER, SPACE, WHITE = range(5)

# Automaton states: what the last character was part of.
S_LETTER, S_DIGIT, S_OTHER, S_LEAD, S_WHITE, S_WHITE_END, S_APO_1, S_APO_2, S_CUT = range(9)
N_STATES = 9
# Symbols.
(Y_LETTER, Y_DIGIT, Y_OTHER, Y_LEAD, Y_WHITE, Y_WHITE_END, Y_APO_1, Y_APO_2, Y_TAIL, Y_TEXT_START) = range(10)


@lru_cache(1)
def class_table() -> np.ndarray:
    """The class of each code point, built from Unicode general categories."""
    names = "".join(map(unicodedata.category, map(chr, range(0x110000)))).encode()
    major = np.frombuffer(names, np.uint8)[::2]
    table = np.full(0x110000, OTHER, np.uint8)
    table[major == ord("L")] = LETTER
    table[major == ord("N")] = DIGIT
    table[WHITE_SPACE] = WHITE
    table[0x20] = SPACE
    return table


@lru_cache(1)
def transitions() -> tuple[np.ndarray, np.ndarray]:
    """(next state, slice begins) by symbol and state."""
    to = np.zeros((10, N_STATES), np.uint8)
    cut = np.ones((10, N_STATES), bool)
    for symbol, state in ((Y_LETTER, S_LETTER), (Y_DIGIT, S_DIGIT), (Y_OTHER, S_OTHER), (Y_LEAD, S_LEAD), (Y_WHITE, S_WHITE), (Y_WHITE_END, S_WHITE_END)):
        to[symbol] = state
        cut[symbol, [state, S_LEAD]] = False
    cut[Y_LEAD] = cut[Y_WHITE_END] = True
    cut[Y_WHITE, S_LEAD] = True
    # An apostrophe with a fitting tail starts a contraction unless it continues a run of others.
    for symbol, state in ((Y_APO_1, S_APO_1), (Y_APO_2, S_APO_2)):
        to[symbol] = state
        to[symbol, [S_OTHER, S_LEAD]] = S_OTHER
        cut[symbol, [S_OTHER, S_LEAD]] = False
    # A letter right after such an apostrophe belongs to the contraction if that one was started.
    to[Y_TAIL] = S_LETTER
    to[Y_TAIL, S_APO_2] = S_APO_1
    to[Y_TAIL, S_APO_1] = S_CUT
    cut[Y_TAIL, [S_LETTER, S_LEAD, S_APO_1, S_APO_2]] = False
    to[Y_TEXT_START] = S_CUT  # only resets; never kept as a slice
    return to, cut


def looked_up(codes: np.ndarray, table: np.ndarray) -> np.ndarray:
    """table[codes] for byte codes and byte values, by the faster bytes.translate."""
    return np.frombuffer(codes.tobytes().translate(np.pad(table.astype(np.uint8), (0, 256 - len(table))).tobytes()), np.uint8)


@lru_cache(1)
def scan_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By symbol: the first next state, whether all next states are equal; by symbol * 16 + state: whether a slice begins."""
    to, cut = transitions()
    begins = np.zeros((10, 16), np.uint8)
    begins[:, :N_STATES] = cut
    return to[:, 0], (to == to[:, :1]).all(axis=1), begins.ravel()


def symbols(cp: np.ndarray, kind: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Symbols of concatenated texts; starts: index of each text's separator (a code point before it)."""
    n = len(cp)
    white = kind >= SPACE
    after = np.zeros(n, bool)  # next character is white space, or the text ends
    after[:-1] = white[1:]
    after[-1:] = True
    ends = starts[1:] - 1
    after[ends[ends >= 0]] = True
    sym = looked_up(kind, np.array([Y_LETTER, Y_DIGIT, Y_OTHER, Y_LEAD, Y_WHITE_END], np.uint8)).copy()
    sym[white & after] = Y_WHITE
    apo = np.flatnonzero(cp == 0x27)
    if len(apo):
        pad = np.concatenate([cp, np.zeros(2, cp.dtype)])
        one, two = pad[apo + 1], pad[apo + 2]
        long = np.zeros(len(apo), bool)
        for a, b in LONG:
            long |= (one == ord(a)) & (two == ord(b))
        short = np.isin(one, [ord(c) for c in SHORT])
        sym[apo[short]] = Y_APO_1
        sym[apo[short] + 1] = Y_TAIL
        sym[apo[long]] = Y_APO_2
        sym[apo[long] + 1] = Y_TAIL
        sym[apo[long] + 2] = Y_TAIL
    sym[starts] = Y_TEXT_START
    return sym


def scan(sym: np.ndarray) -> np.ndarray:
    """The state after each symbol: an associative scan over transition functions.

    Most functions are constant, so their value is the state. The others are composed with what
    stands before them by doubling: each round, a function that is not constant yet takes in the
    composition that ends where its own begins, until every prefix has become constant.
    """
    to, _ = transitions()
    first, constant, _ = scan_tables()
    state = looked_up(sym, first).copy()
    todo = np.flatnonzero(looked_up(sym, ~constant))
    if not len(todo):
        return state
    functions = to[sym[todo]]  # one row per open position
    slot = np.full(len(sym), -1, np.int64)
    slot[todo] = np.arange(len(todo))
    reach = np.ones(len(todo), np.int64)  # how many symbols the row has composed
    live = np.arange(len(todo))
    while len(live):
        before = todo[live] - reach[live]
        held = slot[before]
        closed = held < 0
        # The prefix is constant: its state decides.
        rows = live[closed]
        state[todo[rows]] = functions[rows, state[before[closed]]]
        # The prefix is open too: compose, row[s] = row[prefix[s]].
        rows, prefix = live[~closed], held[~closed]
        functions[rows] = np.take_along_axis(functions[rows], functions[prefix].astype(np.int64), axis=1)
        reach[rows] += reach[prefix]
        slot[todo[live[closed]]] = -1
        live = rows
        flat = (functions[live] == functions[live][:, :1]).all(axis=1) if len(live) else np.zeros(0, bool)
        done = live[flat]
        state[todo[done]] = functions[done, 0]
        slot[todo[done]] = -1
        live = live[~flat]
    return state


class Cut:
    """Slice bounds of many texts: code points, where each slice begins and ends, slices per text."""

    def __init__(self, texts: list[str]):
        self.joined = "\x00" + "\x00".join(texts)
        self.cp = cp = np.frombuffer(self.joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        starts = np.concatenate([[0], np.cumsum(lengths[:-1] + 1)])
        sym = symbols(cp, class_table()[cp], starts)
        begins = np.empty(len(cp), bool)
        begins[0] = True
        begins[1:] = looked_up(sym[1:] * np.uint8(16) + scan(sym)[:-1], scan_tables()[2])
        begins[starts] = True
        at = np.flatnonzero(begins)
        # A separator stands in `at` itself, so it also ends the slice before it.
        separator = sym[at] == Y_TEXT_START
        self.per_text = np.diff(np.append(np.flatnonzero(separator), len(at))) - 1
        self.begin = at[~separator]
        self.end = np.append(at[1:], len(cp))[~separator]


    def short(self, length: np.ndarray) -> np.ndarray:
        """Slices of eight letters or fewer, none of them above 0xFF, as one word each; 0 for all others."""
        low = np.zeros(len(self.cp) + 8, np.uint8)
        low[: len(self.cp)] = self.cp  # letters above 0xFF are cut short here and ruled out below
        word = np.lib.stride_tricks.as_strided(low.view(np.uint8), (len(self.cp), 8), (1, 1))[self.begin].view("<u8").ravel()
        word &= WORD_MASKS[np.minimum(length, 9)]
        high = np.flatnonzero(self.cp > 0xFF)
        if len(high):
            word[np.maximum(np.searchsorted(self.begin, high, "right") - 1, 0)] = 0
        return word


#: By length: which bytes of a word count; none of a slice that is too long.
WORD_MASKS = np.array([*((1 << 8 * n) - 1 for n in range(9)), 0], np.uint64)


def slices(texts: list[str]) -> tuple[list[str], np.ndarray]:
    """(all slices of all texts in order, how many each text has)."""
    if not texts:
        return [], np.zeros(0, np.int64)
    cut = Cut(texts)
    return [cut.joined[a:b] for a, b in zip(cut.begin.tolist(), cut.end.tolist())], cut.per_text


class SliceCache:
    """Encodes texts slice by slice, each distinct slice once.

    An open-addressed table of 32-bit slice hashes, probed for a whole batch at a time, leads to
    entries: the slice's own code points and its ids, in flat pools. A hash only finds an entry; the
    entry counts if its code points are those of the slice, so slices whose hashes are equal never
    exchange ids (all but the first are encoded anew each time). The table doubles as it fills, up to
    2^most_bits places; then, or when a pool is full, only slices that came up again since the last
    such time stay (none, if these alone fill half of it), which bounds its memory.
    """

    R = 0x9E3779B1

    def __init__(self, encode_slices, most_bits: int = 21, most_pooled: int = 1 << 23):
        self.encode_slices = encode_slices  # list of slices → list of their id lists
        self.most_bits, self.most_pooled = most_bits, most_pooled
        self.power = self.inverse = np.ones(1, np.uint32)
        self.reset()

    def reset(self) -> None:
        self._table(14)
        self.place, self.count, self.where, self.span = (np.zeros(1 << 12, np.int32) for _ in range(4))
        self.again, self.short = np.zeros(1 << 12, bool), np.zeros(1 << 12, np.uint64)
        self.used = 0
        self.ids, self.letters = np.zeros(1 << 14, np.int32), np.zeros(1 << 14, np.uint32)
        self.n_ids = self.n_letters = 0

    def _table(self, bits: int) -> None:
        self.bits, self.mask = bits, np.int64((1 << bits) - 1)
        self.keys = np.zeros(1 << bits, np.uint32)
        self.entry = np.zeros(1 << bits, np.int32)

    def hashes(self, cut: Cut) -> np.ndarray:
        n = len(cut.cp)
        if len(self.power) < n + 1:
            step = np.full(max(n + 1, 1 << 18), self.R, np.uint32)
            step[0] = 1
            self.power = np.cumprod(step, dtype=np.uint32)
            step[1:] = pow(self.R, -1, 1 << 32)
            self.inverse = np.cumprod(step, dtype=np.uint32)
        x = cut.cp + np.uint32(0x51ED)
        x *= np.uint32(0x85EBCA6B)
        x ^= x >> np.uint32(15)
        x *= self.power[:n]
        total = np.zeros(n + 1, np.uint32)
        np.cumsum(x, out=total[1:])
        h = (total[cut.end] - total[cut.begin]) * self.inverse[cut.begin]
        h ^= (cut.end - cut.begin).astype(np.uint32) * np.uint32(0xC2B2AE3D)
        h ^= h >> np.uint32(16)
        h *= np.uint32(0x7FEB352D)
        h ^= h >> np.uint32(15)
        h[h == 0] = 1
        if len(self.power) > 1 << 21:  # a very long text's; not kept
            self.power = self.inverse = np.ones(1, np.uint32)
        return h

    def find(self, h: np.ndarray) -> np.ndarray:
        """The entry of each hash, or -1."""
        at = h.astype(np.int64) & self.mask
        out = np.full(len(h), -1, np.int64)
        left = np.arange(len(h))
        while len(left):
            got = self.keys[at[left]]
            hit = got == h[left]
            out[left[hit]] = self.entry[at[left[hit]]]
            left = left[~hit & (got != 0)]
            at[left] = (at[left] + 1) & self.mask
        return out

    def _insert(self, keys: np.ndarray, entry: np.ndarray) -> None:
        """Every round, one key takes each free place; those that met a taken one move on by one."""
        at = keys.astype(np.int64) & self.mask
        left = np.arange(len(keys))
        while len(left):
            free = left[self.keys[at[left]] == 0]
            slot, winner = np.unique(at[free], return_index=True)
            won = free[winner]
            self.keys[slot], self.entry[slot] = keys[won], entry[won]
            left = left[self.keys[at[left]] != keys[left]]
            at[left] = (at[left] + 1) & self.mask

    def _grow(self, most: int) -> None:
        """Doubles the table until `most` entries fill no more than half of it."""
        bits = self.bits
        while 2 * most > 1 << bits:
            bits += 1
        if bits > self.bits:
            held = np.flatnonzero(self.keys)
            keys, entry = self.keys[held], self.entry[held]
            self._table(bits)
            self._insert(keys, entry)

    def _keep_known(self) -> None:
        """Drops the slices that have not come up again."""
        kept = np.flatnonzero(self.again[: self.used])
        if len(kept) > 1 << self.most_bits - 2 or max(self.count[kept].sum(), self.span[kept].sum()) > self.most_pooled // 2:
            kept = kept[:0]
        place, count, where, span, short = (x[kept] for x in (self.place, self.count, self.where, self.span, self.short))
        ids, letters = self.ids, self.letters
        held = np.flatnonzero(self.keys)
        keys = np.zeros(self.used, np.uint32)
        keys[self.entry[held]] = self.keys[held]
        self.reset()
        if len(kept):
            self.used = len(kept)
            self.ids, self.letters = ids[runs(place, count)], letters[runs(where, span)]
            self.n_ids, self.n_letters = len(self.ids), len(self.letters)
            self.count, self.span, self.short = count, span, short
            self.place, self.where = (np.cumsum(x, dtype=np.int32) - x for x in (count, span))
            self.again = np.zeros(len(kept), bool)
            self._grow(self.used)
            self._insert(keys[kept], np.arange(len(kept)))

    def learn(self, cut: Cut, keys: np.ndarray, rows: np.ndarray, short: np.ndarray) -> None:
        """Adds the slices of these rows under their keys, all new."""
        begin, end = cut.begin[rows], cut.end[rows]
        coded = self.encode_slices([cut.joined[a:b] for a, b in zip(begin.tolist(), end.tolist())])
        count = np.fromiter(map(len, coded), np.int64, len(coded))
        new = self.used + np.arange(len(keys))
        self.place, self.count, self.where, self.span = (room(x, self.used + len(keys)) for x in (self.place, self.count, self.where, self.span))
        self.again, self.short = room(self.again, self.used + len(keys)), room(self.short, self.used + len(keys))
        self.again[new], self.short[new] = False, short[rows]
        self.count[new], self.span[new] = count, end - begin
        self.place[new], self.where[new] = self.n_ids + np.cumsum(count) - count, self.n_letters + np.cumsum(end - begin) - (end - begin)
        self.ids, self.letters = room(self.ids, self.n_ids + int(count.sum())), room(self.letters, self.n_letters + int((end - begin).sum()))
        at, self.n_ids = self.n_ids, self.n_ids + int(count.sum())
        self.ids[at : self.n_ids] = np.fromiter(chain.from_iterable(coded), np.int32, self.n_ids - at)
        at, self.n_letters = self.n_letters, self.n_letters + int((end - begin).sum())
        self.letters[at : self.n_letters] = cut.cp[runs(begin, end - begin)]
        self.used += len(keys)
        self._grow(self.used)
        self._insert(keys, new)

    def differing(self, cut: Cut, entry: np.ndarray, length: np.ndarray, short: np.ndarray) -> np.ndarray:
        """Rows whose slice is not what their entry holds: short slices are compared as words, others letter by letter."""
        wrong = self.span[entry] != length
        wrong |= self.short[entry] != short
        rows = np.flatnonzero((short == 0) & ~wrong)
        size = length[rows]
        other = self.letters[runs(self.where[entry[rows]], size)] != cut.cp[runs(cut.begin[rows].astype(np.int32), size)]
        if other.any():
            wrong[rows[np.searchsorted(np.cumsum(size), np.flatnonzero(other), "right")]] = True
        return np.flatnonzero(wrong)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in order, how many each text has)."""
        if not texts:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        cut = Cut(texts)
        h = self.hashes(cut)
        length = (cut.end - cut.begin).astype(np.int32)
        short = cut.short(length)
        entry = self.find(h)
        missing = np.flatnonzero(entry < 0)
        if len(missing):
            keys, first = np.unique(h[missing], return_index=True)
            if self.used + len(keys) > 1 << self.most_bits - 1 or max(self.n_ids, self.n_letters) > self.most_pooled:
                self._keep_known()
                entry = self.find(h)
                missing = np.flatnonzero(entry < 0)
                keys, first = np.unique(h[missing], return_index=True)
            self.again[entry[entry >= 0]] = True
            self.learn(cut, keys, missing[first], short)
            entry[missing] = self.find(h[missing])
        place, count = self.place[entry], self.count[entry]
        source, wrong = self.ids, self.differing(cut, entry, length, short)
        if len(wrong):
            coded = self.encode_slices([cut.joined[a:b] for a, b in zip(cut.begin[wrong].tolist(), cut.end[wrong].tolist())])
            count[wrong] = own = np.fromiter(map(len, coded), np.int64, len(coded))
            place[wrong] = self.n_ids + np.cumsum(own) - own
            source = np.concatenate([self.ids[: self.n_ids], np.fromiter(chain.from_iterable(coded), np.int32, int(own.sum()))])
        ids = source[runs(place, count)]
        bound = np.concatenate([[0], np.cumsum(count, dtype=np.int64)])
        cum = bound[np.concatenate([[0], np.cumsum(cut.per_text)])]
        return ids, np.diff(cum)


def room(held: np.ndarray, need: int) -> np.ndarray:
    """The array, doubled if it holds fewer than `need` values."""
    return held if need <= len(held) else np.concatenate([held, np.zeros(max(len(held), need - len(held)), held.dtype)])


def runs(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, … (length[0] of them), start[1], …"""
    ends = np.cumsum(length, dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if start.dtype == np.int32 and total < 1 << 30 else np.int64
    out = np.repeat((start - (ends - length)).astype(kind), length)
    out += np.arange(total, dtype=kind)
    return out
