"""Byte-level BPE: exact encoding by backtracking, decoding by an offset table.

A text is cut into pieces as the vocabulary's pre-tokenizer does.  For a piece,
an Aho-Corasick automaton over all tokens gives the longest token at a position.
It is accepted if it is compatible with the token before it, that is, if merging
the bytes of the two would give just these two tokens; else shorter tokens are
tried, and a position from which nothing fits is remembered as dead and never
entered again.  A sequence in which all neighbours are compatible is the one
that the merge rules give, so the result is exact, in time linear in the piece.
Decoding looks ids up in one table of bytes through an array of offsets.

The automaton finds matches piece by piece (`Codec.encode_piece`).  For the many
short pieces of a batch, `Codec.encode_many` does the same for all of them at
once in numpy: the automaton's goto function is followed from every position
together, and all pieces take their next step of the search together.

Scale: one narrow Arrow pass over the texts, no shuffle; the vocabulary (50,000
entries) travels with the function, so executors need no file.  A worker keeps
the ids of frequent stretches, up to a bound, which changes speed only.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, tidy

#: Code points with the property White_Space (fixed values).
SPACE = "\t-\r \x85\xa0  -     　"
#: The public byte-level pre-tokenizer's pattern.
PIECES = rf"'(?:[sdmt]|ll|ve|re)| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
#: White space and the run after it.  A piece never goes on over white space that
#: follows something else, so such a stretch is cut into pieces on its own.
STRETCH = re.compile(rf"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
#: Stretches that a worker remembers, at about 60 bytes each.
REMEMBERED = 300_000
ASCII_SPACE = np.frombuffer(b" \t\n\v\f\r", np.uint8)
#: Multipliers of the hash (odd numbers without pattern), and all bits.
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Pairs of tokens whose compatibility is kept in an array: two to this power.
PAIR_BITS = 21
#: Rows of a batch that are Python objects at once.
ROWS = 200
#: Code points of text that are encoded at once.
AT_ONCE = 400_000
#: White space other than the blank and the line feed (fixed values).
OTHER_SPACE = "\t\v\f\r\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in plain}
    rest = [b for b in range(256) if b not in letters]
    return letters | {b: chr(256 + i) for i, b in enumerate(rest)}


class Lexicon:
    """The ids of stretches seen lately, in flat arrays.

    A stretch of up to 24 bytes is three 64-bit words, exactly; a hash of these
    sorts and finds it, and the words themselves are compared.  When the lexicon
    is full, what was not asked for since the last time goes; forgetting costs
    time, never a result.
    """

    def __init__(self, most: int = REMEMBERED):
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.hash, self.word = np.zeros(0, np.uint64), np.zeros((0, 3), np.uint64)
        self.start, self.count, self.used = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, bool)
        self.ids = np.zeros(0, np.uint32)

    def find(self, hashes: np.ndarray, words: np.ndarray) -> np.ndarray:
        """The entry of each stretch, -1 where there is none."""
        if not len(self.hash):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hash, hashes), len(self.hash) - 1)
        same = (self.hash[at] == hashes) & (self.word[at] == words).all(1)
        self.used[at[same]] = True
        return np.where(same, at, -1)

    def add(self, hashes: np.ndarray, words: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        """New entries, with all their ids one after the other."""
        if len(self.hash) + len(hashes) > self.most:
            kept = np.flatnonzero(self.used)
            if len(kept) + len(hashes) > self.most * 3 // 4:
                self.clear()
            else:
                counts_kept = self.count[kept].astype(np.int64)
                self.ids = self.ids[spread(self.start[kept], counts_kept)]
                self.hash, self.word, self.count = self.hash[kept], self.word[kept], self.count[kept]
                self.start, self.used = np.cumsum(counts_kept) - counts_kept, np.zeros(len(kept), bool)
        starts = len(self.ids) + np.cumsum(counts) - counts
        self.ids = np.concatenate([self.ids, ids])
        every = np.concatenate([self.hash, hashes])
        order = np.argsort(every, kind="stable")
        self.hash = every[order]
        self.word = np.concatenate([self.word, words])[order]
        self.start = np.concatenate([self.start, starts])[order]
        self.count = np.concatenate([self.count, counts.astype(np.int32)])[order]
        self.used = np.concatenate([self.used, np.ones(len(hashes), bool)])[order]


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The indexes ``starts[i] .. starts[i] + counts[i] - 1`` of all i, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


class Goto:
    """The goto function of an automaton over tokens, as an open hash table in numpy."""

    def __init__(self, tokens: dict[int, bytes]):
        step: dict[int, int] = {}
        ends = [-1]
        for i, token in tokens.items():
            at = 0
            for b in token:
                at = step.setdefault(at << 8 | b, len(ends))
                if at == len(ends):
                    ends.append(-1)
            ends[at] = i
        self.ends = np.array(ends, np.int32)
        self.bits = max(4, (len(step) * 4).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.to = np.zeros(1 << self.bits, np.int32)
        left = np.fromiter(step, np.int64, len(step))
        to = np.fromiter(step.values(), np.int32, len(step))
        slot = self.slot(left)
        while len(left):
            free = self.keys[slot] < 0
            self.keys[slot[free]] = left[free]  # of several for one slot the last stays
            placed = self.keys[slot] == left
            self.to[slot[placed]] = to[placed]
            left, to, slot = left[~placed], to[~placed], (slot[~placed] + 1) & ((1 << self.bits) - 1)

    def slot(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def follow(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The nodes after ``byte``, -1 where there is none."""
        key = node << 8 | byte
        slot = self.slot(key)
        seen = self.keys[slot]
        out = np.where(seen == key, self.to[slot], -1)
        open_ = np.flatnonzero((seen != key) & (seen >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            at = slot[open_]
            seen = self.keys[at]
            hit = seen == key[open_]
            out[open_[hit]] = self.to[at[hit]]
            open_ = open_[~hit & (seen >= 0)]
        return out

    def longest(self, text: np.ndarray, until: np.ndarray) -> np.ndarray:
        """The longest token from every position of ``text`` that ends by ``until`` there."""
        best = np.full(len(text), -1, np.int32)
        at, node, depth = np.arange(len(text)), np.zeros(len(text), np.int64), 0
        while len(at):
            node = self.follow(node, text[at + depth].astype(np.int64))
            ok = node >= 0
            at, node = at[ok], node[ok].astype(np.int64)
            end = self.ends[node]
            hit = end >= 0
            best[at[hit]] = end[hit]
            depth += 1
            on = at + depth < until[at]
            at, node = at[on], node[on]
        return best


class Stretches:
    """Encodes texts by their stretches: each different one of a batch once, frequent ones from memory.

    Subclasses have ``added`` (ids of special tokens by content) and encode
    stretches in `encode_many` and `encode_stretch`.
    """

    #: Code points of text that are encoded at once.
    at_once = AT_ONCE

    def __init__(self, added: dict[str, int]):
        self.added = added
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.lexicon = Lexicon()

    def encode_many(self, joined: str, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of stretches of ``sizes`` bytes, and how many each has.

        The stretches begin with white space and end with something else, so that,
        joined, they have the same tokens as each for itself.
        """
        raise NotImplementedError

    def encode_stretch(self, stretch: str) -> list[int]:
        raise NotImplementedError

    @staticmethod
    def starts(text: str, raw: bytes) -> np.ndarray:
        """Where stretches begin, in bytes.

        The quick way cuts at blanks and line feeds, which is right if each of
        them stands between two characters that aren't white space.
        """
        plain = not (
            "  " in text or " \n" in text or "\n " in text or "\n\n" in text or text[:1].isspace() or text[-1:].isspace()
            or any(c in text for c in OTHER_SPACE)
        )
        if plain:
            b = np.frombuffer(raw, np.uint8)
            return np.append(0, np.flatnonzero((b == 32) | (b == 10)))
        sizes = [len(x.encode()) for x in STRETCH.findall(text)]
        return np.cumsum([0, *sizes[:-1]])

    def _encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of texts without special tokens."""
        raws = [t.encode() for t in texts]
        bases = np.cumsum([0, *map(len, raws)])
        parts = [self.starts(t, r) + b for t, r, b in zip(texts, raws, bases.tolist()) if r]
        if not parts:
            return [np.zeros(0, np.uint32) for _ in texts]
        start = np.concatenate(parts)
        total = int(bases[-1])
        size = np.diff(np.append(start, total))
        raw = b"".join([*raws, b"\0" * 24])
        # Three words of each stretch, with zeros behind its end.
        view = np.ndarray((total + 17,), "<u8", raw, 0, (1,))
        words = np.empty((len(start), 3), np.uint64)
        for k in range(3):
            own = np.clip(size - 8 * k, 0, 8).astype(np.uint64)
            mask = np.where(own == 8, ALL, (np.uint64(1) << (own * np.uint64(8) & np.uint64(63))) - np.uint64(1))
            words[:, k] = view[np.minimum(start + 8 * k, total)] & mask
        hashes = words[:, 0] * MIX[0]
        for k in (1, 2):
            hashes ^= hashes >> np.uint64(29)
            hashes = (hashes + words[:, k]) * MIX[k]
        hashes ^= hashes >> np.uint64(32)
        # A stretch of more than 24 bytes, or with a zero byte at its end, stands for itself.
        odd = np.flatnonzero((size > 24) | (np.frombuffer(raw, np.uint8)[start + size - 1] == 0))
        hashes[odd] = np.arange(len(odd), dtype=np.uint64)
        words[odd] = 0
        _, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        if (words[first][back] != words).any():  # one hash for two stretches: all stand for themselves
            first, back = np.arange(len(start)), np.arange(len(start))
        single = np.zeros(len(start), bool)
        single[odd] = True
        entry = self.lexicon.find(hashes[first], words[first])
        entry[single[first]] = -1
        lacking = np.flatnonzero(entry < 0)
        ids, counts = self._encode_new(raw, start[first[lacking]], size[first[lacking]])
        # Ids of all different stretches, of the lexicon and new ones, in one array.
        held = len(self.lexicon.ids)
        pool = np.concatenate([self.lexicon.ids, ids])
        at, many = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
        known = np.flatnonzero(entry >= 0)
        at[known], many[known] = self.lexicon.start[entry[known]], self.lexicon.count[entry[known]]
        at[lacking], many[lacking] = held + np.cumsum(counts) - counts, counts
        each = many[back]
        out = pool[spread(at[back], each)]
        keep = np.flatnonzero(~single[first[lacking]])
        own = first[lacking[keep]]
        self.lexicon.add(hashes[own], words[own], ids[spread((np.cumsum(counts) - counts)[keep], counts[keep])], counts[keep])
        ends = np.append(0, np.cumsum(each))[np.searchsorted(start, bases)]
        return [out[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]

    def _encode_new(self, raw: bytes, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the stretches, and how many each has."""
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        b = np.frombuffer(raw, np.uint8)
        # The usual kind begins with ASCII white space; its end is looked at as text below.
        usual = np.isin(b[start], ASCII_SPACE) & (size <= 1000)
        usual[usual] &= ~np.isin(b[(start + size - 1)[usual]], ASCII_SPACE) & (b[(start + size - 1)[usual]] < 0x80)
        more = np.flatnonzero(~usual)
        ids: list = [None] * len(start)
        for i in more.tolist():
            ids[i] = np.array(self.encode_stretch(raw[start[i] : start[i] + size[i]].decode()), np.uint32)
        some = np.flatnonzero(usual)
        counts = np.zeros(len(start), np.int64)
        counts[more] = [len(ids[i]) for i in more.tolist()]
        if len(some):
            joined = b[spread(start[some], size[some])].tobytes().decode()
            got, own = self.encode_many(joined, size[some])
            counts[some] = own
        else:
            got, own = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        out = np.zeros(int(counts.sum()), np.uint32)
        at = np.cumsum(counts) - counts
        out[spread(at[some], own)] = got
        for i in more.tolist():
            out[at[i] : at[i] + counts[i]] = ids[i]
        return out, counts

    def encode_texts(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text, as unsigned 32-bit integers."""
        parts, size = [], 0
        for i, text in enumerate(texts):
            text = text or ""
            cut = self.split.split(text) if self.split is not None and any(t in text for t in self.added) else [text]
            parts += [(i, k % 2, p) for k, p in enumerate(cut)]
            size += len(text)
            if size >= self.at_once or i + 1 == len(texts):
                plain = iter(self._encode_batch([p for _, special, p in parts if not special]))
                ids: dict[int, list[np.ndarray]] = {}
                for j, special, p in parts:
                    ids.setdefault(j, []).append(np.array([self.added[p]], np.uint32) if special else next(plain))
                for x in ids.values():
                    yield x[0] if len(x) == 1 else np.concatenate(x)
                parts, size = [], 0

    def encode(self, text: str | None) -> np.ndarray:
        return next(self.encode_texts([text or ""]))


class Library(Stretches):
    """The same ids by the tokenizers library, which encodes what memory lacks."""

    at_once = 5 * AT_ONCE  # there is room for it, without the codec's tables

    def __init__(self, source: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(source)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        spec = json.loads(source)
        super().__init__({t["content"]: t["id"] for t in spec.get("added_tokens", [])})
        self.lexicon.most *= 4
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.lengths = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():
            self.lengths[i] = len(token)  # one letter for each byte

    def encode_stretch(self, stretch):
        return self.tokenizer.encode(stretch, add_special_tokens=False).ids

    def encode_many(self, joined, sizes):
        # Some thousand bytes at a time: tokens are told apart by their lengths.
        raw = joined.encode()
        ends = np.cumsum(sizes)
        cuts = np.unique(np.append(np.searchsorted(ends, np.arange(4000, len(raw), 4000)), len(sizes) - 1))
        bounds = np.append(0, ends[cuts]).tolist()
        texts = [raw[a:b].decode() for a, b in zip(bounds, bounds[1:])]
        ids = []
        for k in range(0, len(texts), 32):  # what the library returns takes much memory
            ids += [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts[k : k + 32], add_special_tokens=False)]
        ids = np.concatenate(ids)
        upto = np.searchsorted(np.cumsum(self.lengths[ids]), ends) + 1
        return ids, np.diff(np.append(0, upto))


class Codec(Stretches):
    """Encoder and decoder for a byte-level BPE vocabulary in JSON."""

    def __init__(self, source: str):
        import ahocorasick
        import regex

        spec = json.loads(source)
        model = spec["model"]
        of = {c: b for b, c in byte_letters().items()}
        raw = lambda token: bytes(of[c] for c in token)
        self.id_of = {raw(t): i for t, i in model["vocab"].items() if all(c in of for c in t)}
        self.bytes_of = {i: b for b, i in self.id_of.items()}
        super().__init__({t["content"]: t["id"] for t in spec.get("added_tokens", [])})
        self.bytes_of |= {i: t.encode() for t, i in self.added.items()}
        # For each token that merges make: its rank and its two parts.
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}
        for r, pair in enumerate(model["merges"]):
            a, b = (raw(x) for x in (pair if isinstance(pair, list) else pair.split(" ")))
            if a in self.id_of and b in self.id_of and a + b in self.id_of:
                left, right = self.id_of[a], self.id_of[b]
                self.rank.setdefault((left, right), r)
                self.made.setdefault(self.id_of[a + b], (r, left, right))
        self.automaton = ahocorasick.Automaton()
        self.size: dict[int, int] = {}
        for b, i in self.id_of.items():
            if len(b) == 1 or i in self.made:
                self.automaton.add_word(b.decode("latin-1"), i)
                self.size[i] = len(b)
        self.automaton.make_automaton()
        self.widest = max(self.size.values())
        self.goto = Goto({i: self.bytes_of[i] for i in self.size})
        self.shorter = {i: self._shorter(self.bytes_of[i]) for i in self.size}
        self._left: dict[int, list] = {}
        self._right: dict[int, list] = {}
        self._fits: dict[tuple[int, int], bool] = {}
        self.pair_key = np.full(1 << PAIR_BITS, -1, np.int64)
        self.pair_fits = np.zeros(1 << PAIR_BITS, bool)
        self.pieces = regex.compile(PIECES)
        n = max(self.bytes_of) + 1
        self.sizes = np.array([self.size.get(i, 0) for i in range(n)], np.int64)
        self.shorters = np.array([self.shorter.get(i, -1) for i in range(n)], np.int32)
        self.lengths = np.array([len(self.bytes_of.get(i, b"")) for i in range(n)], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)])
        self.table = np.frombuffer(b"".join(self.bytes_of.get(i, b"") for i in range(n)), np.uint8)
        said = [b"%d," % i for i in range(n)]
        self.said_lengths = np.array([len(x) for x in said], np.int64)
        self.said_offsets = np.concatenate([[0], np.cumsum(self.said_lengths)])
        self.said = np.frombuffer(b"".join(said), np.uint8)

    def _shorter(self, b: bytes) -> int:
        """The longest token that is a proper prefix of ``b``, or -1."""
        for n in range(len(b) - 1, 0, -1):
            i = self.id_of.get(b[:n], -1)
            if i in self.size:
                return i
        return -1

    def _edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """The parts of ``token`` at one edge, from its last byte up, each with the rank that ends it."""
        path, until = [], float("inf")
        while True:
            path.append((token, until))
            if token not in self.made:
                return path[::-1]
            until, *parts = self.made[token]
            token = parts[side]

    def fits(self, a: int, b: int) -> bool:
        """Whether the bytes of ``a`` and ``b`` merge to just these two tokens.

        Follows both edges of the seam upwards in the order of ranks.  They don't
        fit if some part left of the seam would merge with one right of it before
        either is merged into its own token; of equal ranks the left one is first.
        """
        key = (a, b)
        if (known := self._fits.get(key)) is not None:
            return known
        left = self._right.get(a) or self._right.setdefault(a, self._edge(a, 1))
        right = self._left.get(b) or self._left.setdefault(b, self._edge(b, 0))
        i = j = 0
        found = True
        while True:
            (p, p_end), (q, q_end) = left[i], right[j]
            across = self.rank.get((p, q))
            if across is not None and across < p_end and across <= q_end:
                found = False
                break
            if i + 1 == len(left) and j + 1 == len(right):
                break
            if p_end <= q_end:
                i += 1
            else:
                j += 1
        if len(self._fits) > 100_000:
            self._fits.clear()
        self._fits[key] = found
        return found

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.id_of.get(piece)
        if whole is not None and whole in self.size:
            return [whole]
        text, n = piece.decode("latin-1"), len(piece)
        longest, size, shorter, known = self.automaton.iter_long, self.size, self.shorter, self._fits
        # Longest match after longest match, as far as neighbours fit; mostly all.
        greedy = [t for _, t in longest(text)]
        last = greedy[0]
        for k in range(1, len(greedy)):
            token = greedy[k]
            ok = known.get((last, token))
            if not (self.fits(last, token) if ok is None else ok):
                break
            last = token
        else:
            return greedy
        out = greedy[:k]
        at = sum(size[t] for t in out)
        dead: set[int] = set()
        while True:
            end = at + size[token]
            if end not in dead and (not out or self.fits(out[-1], token)):
                out.append(token)
                at = end
                if at == n:
                    return out
                token = next(longest(text[at : at + self.widest]))[1]
            elif shorter[token] >= 0:
                token = shorter[token]
            else:
                dead.add(at)
                token = out.pop()
                at -= size[token]

    def encode_stretch(self, stretch):
        return [i for piece in self.pieces.findall(stretch) for i in self.encode_piece(piece.encode())]

    def pairs_fit(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """`fits` for arrays of tokens; what the array of known pairs lacks is worked out once."""
        key = a.astype(np.int64) << 32 | b
        slot = ((key * 0x9E3779B1 ^ key >> 32) & 0x7FFFFFFFFFFFFFFF) % (1 << PAIR_BITS)
        out = self.pair_fits[slot]
        new = np.flatnonzero(self.pair_key[slot] != key)
        if len(new):
            keys, first, back = np.unique(key[new], return_index=True, return_inverse=True)
            found = np.array([self.fits(int(k) >> 32, int(k) & 0xFFFFFFFF) for k in keys], bool)
            out[new] = found[back]
            at = slot[new][first]
            self.pair_key[at], self.pair_fits[at] = keys, found
            # Of several new pairs for one slot the last key stays, and its value must.
            kept = self.pair_key[at] == keys
            self.pair_fits[at[kept]] = found[kept]
        return out

    def encode_many(self, joined, sizes):
        pieces = self.pieces.findall(joined)
        ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        text = np.frombuffer(joined.encode(), np.uint8)
        stop = np.append(np.flatnonzero(text & 0xC0 != 0x80), len(text))[ends]
        start = np.append(0, stop[:-1])
        out, count = self._search(text, start, stop)
        ids = out[spread(start, count)].astype(np.uint32)
        upto = np.cumsum(count)[np.searchsorted(stop, np.cumsum(sizes))]
        return ids, np.diff(np.append(0, upto))

    def _search(self, text: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of each piece from its start on in an array as long as ``text``; how many."""
        longest = self.goto.longest(text, np.repeat(stop, stop - start))
        out = np.zeros(len(text), np.int32)
        dead = np.zeros(len(text) + 1, bool)
        count = np.zeros(len(start), np.int64)
        live = np.arange(len(start))  # pieces in search; the arrays below go with them
        at, token, top = start.copy(), longest[start], start.copy()
        lo, hi = start, stop
        while len(live) > 256:
            end = at + self.sizes[token]
            inner = top > lo
            ok = ~(dead[end] & (end < hi))
            check = np.flatnonzero(ok & inner)
            ok[check] = self.pairs_fit(out[top[check] - 1], token[check])
            out[top[ok]] = token[ok]
            top = top + ok
            at = np.where(ok, end, at)
            less = np.where(ok, -1, self.shorters[token])
            back = ~ok & (less < 0)
            dead[at[back]] = True
            top = top - back
            over = ok & (at == hi)
            ahead = ok & ~over
            token = np.where(ok | back, token, less)
            token[ahead] = longest[at[ahead]]
            token[back] = out[top[back]]
            at[back] -= self.sizes[token[back]]
            if over.any():
                count[live[over]] = (top - lo)[over]
                on = ~over
                live, at, token, top, lo, hi = live[on], at[on], token[on], top[on], lo[on], hi[on]
        for i in live.tolist():  # the last few are quicker one by one
            ids = self.encode_piece(text[start[i] : stop[i]].tobytes())
            out[start[i] : start[i] + len(ids)] = ids
            count[i] = len(ids)
        return out, count

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """The bytes of ``ids``; an id outside the vocabulary has none."""
        return gather(self.table, self.offsets, self.lengths, ids)

    def written(self, ids: np.ndarray) -> bytes:
        """The ids in decimal, joined by commas."""
        return gather(self.said, self.said_offsets, self.said_lengths, ids)[:-1]

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_bytes(np.asarray(ids, np.int64)).decode("utf-8", "replace")


def gather(table: np.ndarray, offsets: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """The stretches ``table[offsets[i] : offsets[i] + lengths[i]]`` of all ids, joined."""
    out = []
    for k in range(0, len(ids), 1 << 18):  # bounded memory for very long texts
        part = ids[k : k + (1 << 18)].astype(np.int64)
        part = part[part < len(lengths)]
        n = lengths[part]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        index = np.arange(total) + np.repeat(offsets[part] - (ends - n), n)
        out.append(table[index].tobytes())
    return b"".join(out)


_codecs: dict[tuple[type, str], Stretches] = {}


def codec(source: str, kind: type[Stretches] = Codec) -> Stretches:
    """The codec of a vocabulary's JSON, made once per worker."""
    key = kind, hashlib.sha256(source.encode()).hexdigest()
    if key not in _codecs:
        _codecs[key] = kind(source)
    return _codecs[key]


def vocabulary(path: str | None = None) -> str:
    """The JSON of the vocabulary file at ``path`` (of the driver)."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """``(id, ids array<int>)`` of every whole text; a null text counts as empty, and has no ids.

    One row per row of ``docs``, repeats and null ids included, in no order.
    """
    ship(docs.sparkSession)
    source = vocabulary(path)

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = codec(source)
        for texts in batches:
            yield pd.Series([ids.astype(np.int32) for ids in own.encode_texts(texts.tolist())])

    return docs.select(F.col(id_col), ids(F.coalesce(F.col(text_col), F.lit(""))).alias("ids"))


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """``(id, text)`` of every row of ids; null ids give an empty text."""
    ship(encoded.sparkSession)
    source = vocabulary(path)

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = codec(source)
        for rows in batches:
            yield pd.Series(["" if r is None else own.decode(np.asarray(r, np.int64)) for r in rows])

    return encoded.select(F.col(id_col), text(F.col(ids_col)).alias("text"))


def round_trip_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """``(id, n_tokens, ids_sha256, decoded_sha256)`` of every whole text.

    Encodes, decodes the ids again and hashes both where they arise, so that ids
    never leave the worker.  Nulls and repeats as in `encode`.
    """
    ship(docs.sparkSession)
    source = vocabulary(path)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(source)
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):  # few texts at a time are Python strings
                part = batch.slice(k, ROWS)
                counts, said, back = [], [], []
                for ids in own.encode_texts(part.column(1).to_pylist()):
                    counts.append(len(ids))
                    said.append(hashlib.sha256(own.written(ids)).hexdigest())
                    back.append(hashlib.sha256(own.decode_bytes(ids)).hexdigest())
                columns = [part.column(0), pa.array(counts, pa.int64()), pa.array(said, pa.string()), pa.array(back, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_bl_t"))
    kind = rows.schema[0].dataType.simpleString()
    return rows.mapInArrow(tidy(digest), f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
