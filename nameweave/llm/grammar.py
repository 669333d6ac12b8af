"""Token-ID output: documents' token ids, compressed shard by shard by a Re-Pair grammar, with random access.

A shard is a run of documents in ascending doc_id order, and a block of it about BLOCK_IDS ids. In each block frequent pairs of
neighbouring symbols within documents become nonterminals, each with its rule (left, right) and the number of ids it stands for,
until no pair occurs LEAST times any more, which is when a rule takes more bytes than the symbols that it saves. A turn
replaces many pairs at once: where occurrences overlap, that of the more frequent pair wins, so the most frequent pair is always
replaced wherever it stands, and a pair only becomes a rule if LEAST of its occurrences are left by the better ones. Then the
counts are taken again. A pair that isn't frequent stays so until one of its symbols is replaced, so later turns look at the
places around replacements and at pairs that are still frequent, not at the whole block. A document is a run of symbols of its
own, so it is decoded from its first symbol and the rules alone, and expansion lengths tell which symbol holds the k-th id of it.

File format: a Parquet table with one row per block of a shard, in the columns of BLOCK_SCHEMA; arrays of numbers are
little-endian.
"""

from __future__ import annotations

import re
import string
import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from nameweave.llm.columns import in_batches, text_key
from nameweave.scratch import Table, small

VOCABULARY, END = 50257, 2
#: Bytes of a symbol and of a rule in the file, and how often a pair has to occur to save more than its rule takes.
SYMBOL_BYTES, RULE_BYTES = 3, 12
LEAST = RULE_BYTES // SYMBOL_BYTES + 1
#: Documents dealt to a shard until there are SHARDS of them, ids after which a shard begins another block, words that a worker remembers (twice as many before it forgets the oldest), bytes of a word beyond which it is forgotten first, and bytes of text that are encoded at a time.
SHARD_DOCS, SHARDS, BLOCK_IDS, MEMORY, LONG, CHARACTERS = 4096, 50_000, 1_000_000, 300_000, 100, 1 << 23

BLOCK_FIELDS = "n_docs int, n_ids long, starts binary, left binary, right binary, lengths binary, low binary, high binary"


def _runs(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of flat from starts on, one after another."""
    ends = np.cumsum(sizes)
    return flat[np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(ends, bytes): where each text ends in the bytes of all."""
    _, offsets, raw = texts.buffers()
    ends = np.frombuffer(offsets, np.int32)[texts.offset + 1 : texts.offset + 1 + len(texts)] if len(texts) else np.zeros(0, np.int32)
    return ends, np.frombuffer(raw, np.uint8) if raw else np.zeros(0, np.uint8)


_ALNUM = np.array([chr(i).isalnum() and i < 128 for i in range(256)])


class Encoder:
    """Encodes whole texts with a public tokenizer, word by word from memory where that gives the same ids.

    The tokenizer cuts a text into pieces before it merges bytes, and no piece reaches over the place before a space, unless
    white space stands on both sides of that space (or before it, at the end). So a text without such a space may be cut
    before each of its spaces, and a word that was seen before needs no encoding. New words are encoded many at a time, joined by
    spaces; each begins at the token that begins with a space. MARKS after a letter or digit, up to the end of a word, are a piece, and so
    is a line end with no white space beside it, so words are cut there and their parts remembered. Texts with such spaces or with a special token are encoded whole. Words, and where their ids are, are held as arrays, so that only new words
    become Python objects.
    """

    WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
    UNSAFE = re.compile(f"[{WHITE}] (?:[{WHITE}]|\\Z)")

    MARKS = string.punctuation

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        names = self.tokenizer.get_vocab()
        self.begins = {}
        for c in " \n":
            first = self.tokenizer.id_to_token(self._ids([c])[0][0])
            self.begins[c] = np.zeros(max(names.values()) + 1, bool)
            self.begins[c][[i for name, i in names.items() if name.startswith(first)]] = True
        # by word: whether white space is at its ends, the turn in which it came up last, and where its ids are in flat
        self.words, self.odd, self.seen = pa.array([], pa.string()), np.zeros(0, bool), np.zeros(0, np.int64)
        self.flat, self.starts, self.sizes, self.turn = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64), 0

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _lines(self, words: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """(parts, counts): words cut before each single line end inside them, which is a space in the part that it begins, and each word's number of parts."""
        counts = np.ones(len(words), np.int64)
        at = np.flatnonzero(pc.match_substring(words, "\n").to_numpy(zero_copy_only=False))
        cut = [w.split("\n") for w in words.take(pa.array(at)).to_pylist()]
        clean = [all(x and x.strip() is x for x in parts) for parts in cut]
        at, cut = at[np.array(clean, bool)], [parts for parts, ok in zip(cut, clean, strict=True) if ok]
        if not cut:
            return words, counts
        counts[at] = [len(parts) for parts in cut]
        index = np.repeat(np.arange(len(words)), counts)
        index[np.repeat(counts > 1, counts)] = len(words) + np.arange(counts[at].sum())
        more = pa.array([" " + x if i else x for parts in cut for i, x in enumerate(parts)], words.type)
        return pa.concat_arrays([words, more]).take(pa.array(index)), counts

    def _unmarked(self, words: pa.Array) -> tuple[pa.Array, np.ndarray, pa.Array]:
        """(words, marked, marks): words without the MARKS that follow their last letter or digit, which words had any, and these."""
        base = pc.utf8_rtrim(words, characters=self.MARKS)
        sizes, (ends, raw) = pc.binary_length(base).to_numpy(), _bytes_of(base)
        cut = pc.binary_length(words).to_numpy() - sizes
        last = np.zeros(len(words), np.uint8)
        last[sizes > 0] = raw[ends[sizes > 0] - 1]
        # letters or digits and marks after them are pieces of their own
        marked = (cut > 0) & _ALNUM[last]
        some = np.flatnonzero((cut > 0) & (last > 127))
        marked[some] = [w[-1].isalpha() for w in base.take(pa.array(some)).to_pylist()]
        (ends, raw), cut = _bytes_of(words), cut[marked].astype(np.int64)
        marks = _runs(raw, ends[marked] - cut, cut)
        offsets = np.concatenate(([0], np.cumsum(cut))).astype(np.int32)
        return pc.if_else(pa.array(marked), base, words), marked, pa.StringArray.from_buffers(len(cut), pa.py_buffer(offsets), pa.py_buffer(marks))

    def _forget(self) -> None:
        """Words that came up longest ago, and very long ones."""
        keep = np.flatnonzero(pc.binary_length(self.words).to_numpy() <= LONG)
        keep = np.sort(keep[np.argsort(-self.seen[keep], kind="stable")[:MEMORY]])
        self.words, self.odd, self.seen = self.words.take(pa.array(keep)), self.odd[keep], self.seen[keep]
        self.flat, self.sizes = _runs(self.flat, self.starts[keep], self.sizes[keep]), self.sizes[keep]
        self.starts = np.cumsum(self.sizes) - self.sizes

    def _known(self, words: pa.Array) -> np.ndarray:
        """The place of each of the words in memory, where new ones come in."""
        if len(self.words) > 2 * MEMORY or self.words.nbytes > 4 * LONG * MEMORY:
            self._forget()
        each = words.dictionary_encode()
        rows = np.full(len(each.dictionary), -1)
        # looking up the remembered words among these costs less than a table of them
        at = pc.fill_null(pc.index_in(self.words, value_set=each.dictionary), -1).to_numpy()
        held = np.flatnonzero(at >= 0)
        rows[at[held]] = held
        missing = np.flatnonzero(rows < 0)
        rows[missing] = len(self.words) + np.arange(len(missing))
        new = each.dictionary.take(pa.array(missing))
        self.words = pa.concat_arrays([self.words, new])
        self._learn(new.to_pylist())
        of = rows[each.indices.to_numpy()]
        self.turn += 1
        self.seen[of] = self.turn
        return of

    def _learn(self, new: list[str]) -> None:
        inner = np.fromiter((w[:1] == " " for w in new), bool, len(new))
        odd = np.fromiter((not w or w.strip() is not w for w in new), bool, len(new)) & ~inner
        starts, sizes, parts, n = np.zeros(len(new), np.int64), np.zeros(len(new), np.int64), [self.flat], len(self.flat)
        alone = np.flatnonzero(odd).tolist()
        for c, of in ((" ", np.flatnonzero(~odd & ~inner)), ("\n", np.flatnonzero(inner))):
            texts = [c + new[k].lstrip(" ") for k in of.tolist()]
            for i in range(0, len(texts), 64):  # at more the library's time for a word grows
                some = of[i : i + 64]
                ids = np.array(self._ids(["".join(texts[i : i + 64])])[0], np.uint32)
                at = np.flatnonzero(self.begins[c][ids])
                if len(at) != len(some):
                    alone += some.tolist()
                    continue
                starts[some] = n + at
                sizes[some[:-1]] = at[1:] - at[:-1]
                sizes[some[-1]] = len(ids) - at[-1]
                parts.append(ids)
                n += len(ids)
        for k, ids in zip(alone, self._ids(["\n" + new[k][1:] if inner[k] else " " + new[k] for k in alone]), strict=True):
            starts[k], sizes[k] = n, len(ids)
            parts.append(np.array(ids, np.uint32))
            n += len(ids)
        self.flat = np.concatenate(parts)
        self.odd, self.seen = np.concatenate((self.odd, odd)), np.concatenate((self.seen, np.zeros(len(new), np.int64)))
        self.starts, self.sizes = np.concatenate((self.starts, starts)), np.concatenate((self.sizes, sizes))

    def encode(self, texts: pa.Array, tail: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends): the ids of all texts one after another, each with the ids in tail behind it, and the number of ids up to each text's end."""
        ids, ends, n, first = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)], 0, 0
        sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
        while first < len(texts):
            before = int(sizes[first - 1]) if first else 0
            last = max(first + 1, int(np.searchsorted(sizes, before + CHARACTERS, "right")))
            i, e = self._some(pc.fill_null(texts.slice(first, last - first), ""), tail)
            ids.append(i)
            ends.append(e + n)
            n, first = n + len(i), last
        return np.concatenate(ids), np.concatenate(ends)

    def _some(self, texts: pa.Array, tail: bytes) -> tuple[np.ndarray, np.ndarray]:
        cut = pc.split_pattern(texts, " ")
        cuts = cut.offsets.to_numpy().astype(np.int64)
        cuts -= cuts[0]
        words = cut.flatten().dictionary_encode()
        index, distinct = words.indices.to_numpy().astype(np.int64), words.dictionary
        parts, counts = self._lines(distinct)
        base, marked, marks = self._unmarked(parts)
        of = self._known(base)
        # only words that begin or end with white space, or are empty, can stand at an unsafe space
        whole, odd = set(), self.odd[of][np.cumsum(counts) - counts]
        if odd.any():
            some = np.unique(np.searchsorted(cuts, np.flatnonzero(odd[index]), "right") - 1).tolist()
            whole = {i for i in some if self.UNSAFE.search(texts[i].as_py())}
        for x in self.special:
            whole.update(np.flatnonzero(pc.match_substring(texts, x).to_numpy(zero_copy_only=False)).tolist())
        # a word without a space before it, or a whole text, and the tail are entries of their own
        firsts = distinct.take(pa.array(index[cuts[:-1]])).to_pylist()
        for i in whole:
            firsts[i] = texts[i].as_py()
        others = [*(np.array(x, np.uint32) for x in self._ids(firsts)), np.frombuffer(tail, "<u4"), np.zeros(0, np.uint32)]
        # each part's ids and those of its marks, by turns
        marks = marks.dictionary_encode()
        ids_of = [np.array(x, np.uint32) for x in self._ids(marks.dictionary.to_pylist())]
        n = np.fromiter(map(len, ids_of), np.int64, len(ids_of))
        starts, sizes = np.zeros((len(of), 2), np.int64), np.zeros((len(of), 2), np.int64)
        starts[:, 0], sizes[:, 0] = self.starts[of], self.sizes[of]
        which = marks.indices.to_numpy()
        starts[marked, 1], sizes[marked, 1] = (len(self.flat) + np.cumsum(n) - n)[which], n[which]
        flat = np.concatenate((_runs(np.concatenate((self.flat, *ids_of)), starts.ravel(), sizes.ravel()), *others))
        sizes = np.add.reduceat(sizes.sum(1), np.cumsum(counts) - counts)
        sizes = np.append(sizes, np.fromiter(map(len, others), np.int64, len(others)))
        starts = np.cumsum(sizes) - sizes
        for i in whole:
            index[cuts[i] : cuts[i + 1]] = len(sizes) - 1
        index[cuts[:-1]] = len(distinct) + np.arange(len(texts))
        index = np.insert(index, cuts[1:], len(sizes) - 2)
        n = sizes[index]
        return _runs(flat, starts[index], n), np.cumsum(n)[cuts[1:] + np.arange(len(texts))]

    def __call__(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as unsigned 32-bit integers."""
        ids, ends = self.encode(pa.array(texts, pa.string()))
        return [x.tobytes() for x in np.split(ids, ends[:-1])] if texts else []


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker process, which keeps the words that it knows."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


#: Bits of a place and of a symbol that fit into one sorted number together.
PLACE_BITS, NAME_BITS = 20, 22
_MIX = 0x9E3779B97F4A7C15


def _possible(key: np.ndarray, least: int) -> np.ndarray:
    """Whether a key may occur `least` times, by hashed counts: false only if it doesn't."""
    h = ((key * np.uint64(_MIX)) >> np.uint64(44)).astype(np.int64)
    return (np.bincount(h, minlength=1 << 20) >= least)[h]


def _groups(h: np.ndarray, bits: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(members, sizes) of the groups of at least `least` numbers that are equal above their lowest bits, from sorted numbers."""
    upper = h >> np.uint64(bits)
    begins = np.flatnonzero(np.concatenate(([True], upper[1:] != upper[:-1])))
    n = np.diff(begins, append=len(h))
    some = n >= least
    return h[np.repeat(some, n)], n[some]


def _frequent(at: np.ndarray, key: np.ndarray, least: int, exact: bool, turn: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(places, sizes, pairs, rest): the places of pairs that occur at least `least` times, by group and in order, with each group's size and pair.

    Small names and places are sorted as one number. Else keys are sorted by the upper bits of a hash with their index below;
    places whose rare key shares its hash with another one come back as rest, to be looked at with the next turn's hash.
    """
    if turn == 0:
        some = _possible(key, least)
        at, key = at[some], key[some]
    if not len(at):
        return at, at, key, at
    if exact:
        h = key << np.uint64(PLACE_BITS) | at.view(np.uint64)
        h.sort()
        h, n = _groups(h, PLACE_BITS, least)
        return (h & np.uint64((1 << PLACE_BITS) - 1)).view(np.int64), n, h[np.cumsum(n) - n] >> np.uint64(PLACE_BITS), at[:0]
    bits = max(1, int(len(key) - 1).bit_length())
    low = np.uint64((1 << bits) - 1)
    h = (key * np.uint64(_MIX + 2 * turn)) & ~low | np.arange(len(key), dtype=np.uint64)
    h.sort()
    h, n = _groups(h, bits, least)
    index = (h & low).view(np.int64)
    pairs = key[index[np.cumsum(n) - n]]
    group = np.repeat(np.arange(len(n)), n)
    same = key[index] == pairs[group]
    return at[index[same]], np.bincount(group[same], minlength=len(n)), pairs, at[index[~same]]


def _ascending(at: np.ndarray, flag: np.ndarray) -> np.ndarray:
    """The different places in at, which are those where flag is set, in order: sorted if they are few, else looked up."""
    if 16 * len(at) >= len(flag):
        return np.flatnonzero(flag)
    at = np.sort(at)
    return at[np.diff(at, prepend=-1) > 0]


def _every_other(at: np.ndarray, name: np.ndarray, prv: np.ndarray) -> np.ndarray:
    """Of ascending places, by name: whether each is an even one of its run of overlapping occurrences."""
    follows = np.zeros(len(at), bool)
    follows[1:] = (prv[at[1:]] == at[:-1]) & (name[1:] == name[:-1])
    runs = np.flatnonzero(~follows)
    return (np.arange(len(at)) - np.repeat(runs, np.diff(runs, append=len(at)))) % 2 == 0


def _best_places(at: np.ndarray, p: np.ndarray, prv: np.ndarray, nxt: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Which of the ascending places at, with ranks p, overlap no place of a better rank, nor a chosen one of their own."""
    before, after = rank[prv[at]], rank[nxt[at]]
    best = (p >= before) & (p >= after)
    twins = np.flatnonzero(best & ((p == before) | (p == after)))
    if len(twins):
        best[twins] = _every_other(at[twins], p[twins], prv)
    return best


def grammar(ids: np.ndarray, ends: np.ndarray, vocabulary: int = VOCABULARY, least: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, the first symbol of each document, left, right); ends has the number of ids up to each document's end."""
    least = LEAST if least is None else least
    n = len(ids)
    begins = np.concatenate(([0], ends[:-1])).astype(np.int64) if len(ends) else np.zeros(0, np.int64)
    some = begins < ends
    # neighbours by place; n stands for none, and is a place of its own whose values are never used
    seq, nxt, prv = np.append(ids.astype(np.int64), -1), np.arange(1, n + 2), np.arange(-1, n)
    nxt[ends[some].astype(np.int64) - 1] = n
    prv[begins[some]] = n
    nxt[n] = prv[n] = n
    gone, flag, rank = np.zeros(n + 1, bool), np.zeros(n + 1, bool), np.zeros(n + 1, np.int32)
    lefts, rights, size, turn = [], [], vocabulary, 0
    active = np.flatnonzero(nxt[:n] < n)
    while len(active) >= least:
        exact = n <= 1 << PLACE_BITS and size <= 1 << NAME_BITS
        name = np.uint64(NAME_BITS if exact else 32)
        key = seq[active].view(np.uint64) << name | seq[nxt[active]].view(np.uint64)
        at, n_of, pairs, rest = _frequent(active, key, least, exact, turn)
        turn += 1
        left, right = pairs >> name, pairs & np.uint64((1 << int(name)) - 1)
        count = n_of.copy()
        twins = np.flatnonzero(left == right)  # only such pairs overlap themselves
        if len(twins):
            first = np.cumsum(n_of) - n_of
            own = np.concatenate([at[a : a + m] for a, m in zip(first[twins].tolist(), n_of[twins].tolist(), strict=True)])
            of = np.repeat(np.arange(len(twins)), n_of[twins])
            count[twins] = np.bincount(of[_every_other(own, of, prv)], minlength=len(twins))
        live = count >= least
        by = np.lexsort((right, left, count))[int((~live).sum()) :]  # the others come first
        if not len(by):
            active = np.sort(rest)
            continue
        rank_of = np.zeros(len(pairs), np.int32)
        rank_of[by] = np.arange(1, len(by) + 1)
        left, right = left[by], right[by]
        p = np.repeat(rank_of, n_of)
        rank[at] = p
        flag[at] = p > 0
        at = flagged = _ascending(at[p > 0], flag)
        p = rank[at]
        best = _best_places(at, p, prv, nxt, rank)
        # only pairs that keep enough occurrences beside better ones take part in this turn
        good = np.bincount(p[best], minlength=len(by) + 1) >= least
        good[0] = False
        held = good[p]
        rank[at[~held]] = 0
        taken = []
        best = best[held]
        at, p = at[held], p[held]
        while True:  # until each place is taken or overlaps one that is
            i = at[best]
            taken.append((i, p[best]))
            rank[i] = rank[prv[i]] = rank[nxt[i]] = 0
            held = rank[at] > 0
            at, p = at[held], p[held]
            if not len(at):
                break
            best = _best_places(at, p, prv, nxt, rank)
        i, p = np.concatenate([x for x, _ in taken]), np.concatenate([x for _, x in taken])
        j = nxt[i]
        k = nxt[j]
        seq[i] = (size - 1 + np.cumsum(good))[p]
        nxt[i] = k
        prv[k] = i
        nxt[n] = prv[n] = n
        gone[j] = True
        lefts.append(left[good[1:]].astype(np.uint32))
        rights.append(right[good[1:]].astype(np.uint32))
        size += int(good.sum())
        flag[rest] = True
        flag[i] = True
        flag[prv[i]] = True
        flag[j] = flag[n] = False
        active = np.concatenate((flagged, rest, i, prv[i]))
        active = _ascending(active[flag[active]], flag)
        flag[active] = False
        active = active[nxt[active] < n]
    alive = ~gone[:n]
    starts = np.append(np.cumsum(alive) - alive, alive.sum())[begins]
    cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.uint32)
    return seq[:n][alive].astype(np.uint32), starts, cat(lefts), cat(rights)


def pruned(symbols: np.ndarray, starts: np.ndarray, left: np.ndarray, right: np.ndarray, vocabulary: int = VOCABULARY) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The same without rules that are used once or never: a symbol that is the only use of its rule is written out."""
    n = len(left)
    used = lambda x: np.bincount(x[x >= vocabulary].astype(np.int64) - vocabulary, minlength=n)
    keep = np.ones(n, bool)
    while True:
        in_symbols, in_rules = used(symbols), used(left[keep]) + used(right[keep])
        drop = keep & (in_rules == 0) & (in_symbols <= 1)
        if not drop.any():
            break
        keep &= ~drop
        out = np.zeros(len(symbols), bool)
        big = symbols >= vocabulary
        out[big] = drop[symbols[big] - vocabulary]
        at = np.flatnonzero(out)
        rule = symbols[at] - vocabulary
        starts = starts + np.searchsorted(at, starts)
        symbols = np.repeat(symbols, 1 + out)
        to = at + np.arange(len(at))
        symbols[to], symbols[to + 1] = left[rule], right[rule]
    name = np.concatenate((np.arange(vocabulary), vocabulary + np.cumsum(keep) - 1)).astype(np.uint32)
    return name[symbols], starts, name[left[keep]], name[right[keep]]


def compress(ids: np.ndarray, ends: np.ndarray, vocabulary: int = VOCABULARY, least: int | None = None) -> dict[str, np.ndarray]:
    """Symbols, the first symbol of each document, and rules with their lengths; ends has the number of ids up to each document's end."""
    symbols, starts, left, right = pruned(*grammar(ids, ends, vocabulary, least), vocabulary)
    lengths = [1] * vocabulary
    for a, b in zip(left.tolist(), right.tolist(), strict=True):
        lengths.append(lengths[a] + lengths[b])
    return {"symbols": symbols, "starts": starts.astype(np.uint32), "left": left, "right": right, "lengths": np.array(lengths[vocabulary:], np.uint32)}


def expand(symbols: np.ndarray, left: np.ndarray, right: np.ndarray, sizes: np.ndarray, vocabulary: int = VOCABULARY) -> np.ndarray:
    """The ids that symbols stand for; sizes has the number of ids of every symbol. Each id and each use of a rule is looked at once."""
    s = symbols.astype(np.int64)
    ends = np.cumsum(sizes[s])
    at = ends - sizes[s]
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint32)
    while len(s):
        plain = s < vocabulary
        out[at[plain]] = s[plain]
        at, rule = at[~plain], s[~plain] - vocabulary
        a = left[rule].astype(np.int64)
        at = np.concatenate((at, at + sizes[a]))
        s = np.concatenate((a, right[rule].astype(np.int64)))
    return out


def _pack(doc_ids: list, ids: np.ndarray, ends: np.ndarray) -> dict:
    c = compress(ids, ends)
    s = c["symbols"]
    raw = {"starts": c["starts"].astype("<u4"), "left": c["left"].astype("<u4"), "right": c["right"].astype("<u4"), "lengths": c["lengths"].astype("<u4"), "low": (s & 0xFFFF).astype("<u2"), "high": (s >> 16).astype("u1")}
    return {"doc_ids": doc_ids, "n_docs": len(doc_ids), "n_ids": len(ids)} | {k: v.tobytes() for k, v in raw.items()}


class Block:
    """A block read back: whole, or any document or id of it by itself."""

    def __init__(self, row: dict):
        of = lambda k, kind: np.frombuffer(row[k], kind)
        self.doc_ids, self.starts = row["doc_ids"], of("starts", "<u4")
        self.left, self.right, self.lengths = of("left", "<u4"), of("right", "<u4"), of("lengths", "<u4")
        self.symbols = of("low", "<u2").astype(np.uint32) | of("high", "u1").astype(np.uint32) << 16
        self.sizes = np.concatenate((np.ones(VOCABULARY, np.int64), self.lengths))

    @cached_property
    def before(self) -> np.ndarray:
        """The number of ids before each symbol, and that of all, without expanding any."""
        return np.concatenate(([0], np.cumsum(self.sizes[self.symbols])))

    def document(self, k: int) -> np.ndarray:
        end = self.starts[k + 1] if k + 1 < len(self.starts) else len(self.symbols)
        return expand(self.symbols[self.starts[k] : end], self.left, self.right, self.sizes)

    def token(self, k: int, i: int) -> int:
        """The i-th id of the k-th document: its symbol by bisection, then along one path of the grammar."""
        i += int(self.before[self.starts[k]])
        at = int(np.searchsorted(self.before, i, "right")) - 1
        s, i = int(self.symbols[at]), i - int(self.before[at])
        while s >= VOCABULARY:
            a = int(self.left[s - VOCABULARY])
            n = int(self.sizes[a])
            s, i = (a, i) if i < n else (int(self.right[s - VOCABULARY]), i - n)
        return s

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the number of them up to each document's end."""
        ends = np.append(self.before[self.starts[1:]], self.before[-1]) if len(self.starts) else np.zeros(0, np.int64)
        return expand(self.symbols, self.left, self.right, self.sizes), ends


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def write_shards(docs: DataFrame, tokenizer: str | None = None, end: int = END, shard_docs: int = SHARD_DOCS) -> Table:
    """Writes all documents in ascending doc_id order, nulls first and equal ids by their text's hash, as blocks to the shared folder.

    tokenizer is a path that workers can open; by default each asks for its own copy of the public vocabulary. A range
    of documents is one task, and any number of documents in it pass through in blocks of bounded size. Ranges are by doc_id, hash and
    place in the input, so rows that are equal in all, or without an id, are spread over ranges like any others.
    """
    rows = in_batches(docs).select("doc_id", "text", text_key().alias("key"), F.monotonically_increasing_id().alias("at"))
    shards = min(SHARDS, max(1, -(-docs.select("doc_id").count() // shard_docs)))
    kind = docs.schema["doc_id"].dataType
    arrow = pa.schema([("block", pa.int32()), ("doc_ids", pa.list_(to_arrow_type(kind))), ("n_docs", pa.int32()), ("n_ids", pa.int64()), *((n, pa.binary()) for n in ("starts", "left", "right", "lengths", "low", "high"))])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer or default_tokenizer())
        tail = np.array([end], "<u4").tobytes()
        block, doc_ids, parts, sizes, n = 0, [], [], [], 0

        def flush() -> pa.RecordBatch:
            packed = {"block": block} | _pack(doc_ids, np.concatenate(parts), np.cumsum(np.concatenate(sizes)))
            return pa.RecordBatch.from_pylist([packed], arrow)

        for b in batches:
            docs_of, (ids, ends) = b.column(0).to_pylist(), enc.encode(b.column(1), tail)
            first, done = 0, 0
            while first < len(ends):
                last = min(len(ends), int(np.searchsorted(ends, done + BLOCK_IDS - n)) + 1)
                upto = int(ends[last - 1])
                doc_ids += docs_of[first:last]
                parts.append(ids[done:upto])
                sizes.append(np.diff(ends[first:last], prepend=done))
                n += upto - done
                first, done = last, upto
                if n >= BLOCK_IDS:
                    yield flush()
                    block, doc_ids, parts, sizes, n = block + 1, [], [], [], 0
        if doc_ids:
            yield flush()

    ordered = rows.repartitionByRange(shards, "doc_id", "key", "at").sortWithinPartitions("doc_id", "key", "at").select("doc_id", "text")
    blocks = ordered.mapInArrow(encode, f"block int, doc_ids array<{kind.simpleString()}>, {BLOCK_FIELDS}")
    return Table(blocks.withColumn("shard", F.spark_partition_id()), "token_shards", "zstd")


def read_shards(blocks: DataFrame) -> DataFrame:
    """One row per document, from the files: doc_id, start, n_tokens, ids_crc32.

    start adds the ids of all shards before, of which there are at most SHARDS, and of the shard's blocks before.
    """
    up_to_here = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sums = blocks.groupBy(F.col("shard").alias("s")).agg(F.sum("n_ids").alias("n"))
    shards = sums.select("s", F.coalesce(F.sum("n").over(up_to_here(Window.orderBy("s"))), F.lit(0)).alias("earlier"))
    within = F.coalesce(F.sum("n_ids").over(up_to_here(Window.partitionBy("shard").orderBy("block"))), F.lit(0))
    of = blocks.select("shard", "block", within.alias("within")).join(small(shards), F.col("shard") == F.col("s"))
    before = of.select(F.col("shard").alias("s"), F.col("block").alias("b"), (F.col("earlier") + F.col("within")).alias("before"))
    kind = blocks.schema["doc_ids"].dataType.elementType
    arrow = to_arrow_type(kind)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                ids, ends = Block(row).all()
                raw = memoryview(ids.astype("<u4").tobytes())
                begin = np.concatenate(([0], ends[:-1]))
                crc = [zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(begin.tolist(), ends.tolist(), strict=True)]
                n = len(crc)
                yield pa.RecordBatch.from_arrays([pa.array([row["shard"]] * n, pa.int32()), pa.array([row["block"]] * n, pa.int32()), pa.array(row["doc_ids"], arrow), pa.array(begin, pa.int64()), pa.array(ends - begin, pa.int64()), pa.array(crc, pa.int64())], names=["shard", "block", "doc_id", "local", "n_tokens", "ids_crc32"])

    docs = in_batches(blocks).mapInArrow(decode, f"shard int, block int, doc_id {kind.simpleString()}, local long, n_tokens long, ids_crc32 long")
    return docs.join(small(before), (F.col("shard") == F.col("s")) & (F.col("block") == F.col("b"))).select("doc_id", (F.col("before") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def token_output(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Writes the token ids of docs and reads them back: one row for each row of docs.

    A null or empty text has the end id alone; a long one is encoded whole, in a block of its own length. Rows that share a doc_id
    follow each other by their text's hash, equal rows in any order. An empty table gives none, other columns aren't read. A special token's name in a text is
    that token's id, as the library does it by default.
    """
    return read_shards(write_shards(docs, tokenizer).df)
