"""Exact, cached use of public tokenizers.

Byte-pair tokenizers first cut a text into pieces and merge inside each piece
alone, so the ids of a text are the ids of its units one after another wherever
the text is cut between pieces. These cuts always are between pieces:

- ``drop_space`` tokenizers (white space is a mere separator): at ASCII white space;
- byte-level tokenizers (white space belongs to pieces): where a run of white
  space starts, because no piece goes from other characters into white space;
- both: between a common letter and the punctuation of ``_MARKS``.

Units repeat a lot. A block of texts is cut by array arithmetic over its bytes, and
each worker process keeps a table from a unit's 128-bit hash to its ids, bounded in
entries and ids; only units that the table lacks go through the tokenizers library,
many at a time. A full table forgets the units that a single block had. Long units are
hashed by a cryptographic hash, others by two polynomial ones; where both of two units
differ in just one of the two, the block is encoded text by text.
Texts with white space other than ASCII's are encoded whole. The results equal
``Tokenizer.encode(text, add_special_tokens=False).ids`` (see the tests).
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np

from knotweave.llm.text import inverse, mix64, powers, release_memory, slices

#: Separators that some regular-expression engines count as white space.
_ODD_ASCII = bytes(range(0x1C, 0x20))
_ODD_UTF8 = (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe1\xa0\x8e", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe2\x81\xa0", b"\xe3\x80\x80", b"\xef\xbb\xbf")
#: Where a long text may be cut: white space begins.
_EDGE = re.compile(rb"[^ \t\n\x0b\x0c\r](?=[ \t\n\x0b\x0c\r])")
#: A word of common letters alone.
_STEM = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
_MARKS = b".,!?;:%#&*$"
#: Bytes of a block, and of a unit that the polynomial hashes may still tell apart.
_BLOCK, _LONG = 1 << 20, 256
#: Odd multipliers of the two hashes (arbitrary fixed values).
_BASES = (np.uint64(0x9FB21C651E98DF25), np.uint64(0xC2B2AE3D27D4EB4F))


def _byte_set(values: bytes) -> np.ndarray:
    out = np.zeros(256, np.bool_)
    out[list(values)] = True
    return out


_SPACE, _MARK = _byte_set(b" \t\n\x0b\x0c\r"), _byte_set(_MARKS)
_ASCII_LETTER = _byte_set(bytes(range(0x41, 0x5B)) + bytes(range(0x61, 0x7B)))
#: Second bytes of À to ÿ, but × and ÷, in UTF-8 (the first is C3).
_LATIN = _byte_set(bytes(x for x in range(0x80, 0xC0) if x not in (0x97, 0xB7)))


def _odd_space(raw: bytes) -> bool:
    return len(raw.translate(None, _ODD_ASCII)) != len(raw) or any(x in raw for x in _ODD_UTF8)


def _room(x: np.ndarray, n: int) -> np.ndarray:
    """``x`` with room for ``n`` rows."""
    while n > len(x):
        x = np.concatenate([x, np.zeros_like(x)])
    return x


def _parts(raw: bytes) -> Iterator[bytes]:
    """A text in parts of about a block, each but the first starting with a run of white space."""
    at = 0
    while len(raw) - at > _BLOCK and (edge := _EDGE.search(raw, at + _BLOCK)):
        yield raw[at : edge.end()]
        at = edge.end()
    yield raw[at:] if at else raw


def _gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs of ``flat`` one after another."""
    return flat[np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]


class CachedEncoder:
    """``encode(texts)``: all ids in one array, and the number of ids of each text."""

    def __init__(self, path: str, drop_space: bool, max_entries: int = 1_000_000, max_ids: int = 8_000_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.drop_space = drop_space
        self.max_entries, self.max_ids = max_entries, max_ids
        # joined units are told apart by ids: byte-level ones open with their white space, words may close with a suffix
        vocabulary = self.tokenizer.get_vocab()
        self.edge = np.zeros(1 + max(vocabulary.values(), default=0), np.bool_)
        self.edge[[i for token, i in vocabulary.items() if (token.endswith("</w>") if drop_space else token[:1] in ("Ġ", "Ċ"))]] = True
        self.words = self._word_tokenizer(path) if drop_space else None
        self._powers = [(np.zeros(0, np.uint64), np.zeros(0, np.uint64))] * 2
        self._reset()

    def _word_tokenizer(self, path: str):
        """The same merges for lower-case words of letters between spaces, without the search for pieces; None if its ids differ."""
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        plain = Tokenizer.from_file(path)
        plain.normalizer = normalizers.Sequence([])
        plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(" ", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        probe = ["a", "Hello", "straße", "Éclair", "ÿ", "Ñandú", "internationalisation", "Xqzjkw"]
        want = [self.tokenizer.encode(x, add_special_tokens=False).ids for x in probe]
        joined = plain.encode(" ".join(probe).lower(), add_special_tokens=False).ids
        closes = all(self.edge[x[-1]] and not self.edge[x[:-1]].any() for x in want if x)
        return plain if closes and joined == [i for x in want for i in x] else None

    def _reset(self) -> None:
        self.key = np.zeros(0, np.uint64)  # first hashes in order
        self.row = np.zeros(0, np.int32)  # where each one's unit is in what follows
        self.rows = 0
        self.check = np.zeros(1 << 14, np.uint64)  # second hash
        self.start = np.zeros(1 << 14, np.int64)
        self.size = np.zeros(1 << 14, np.int32)
        self.again = np.zeros(1 << 14, np.bool_)  # met in a later block than its first
        self.flat = np.zeros(1 << 16, np.uint32)
        self.used = 0

    def _shrink(self) -> None:
        """Forget the units of one block only, and all if that leaves over half."""
        keep = self.again[self.row]
        key, row = self.key[keep], self.row[keep]
        size, start, check = self.size[row], self.start[row], self.check[row]
        if 2 * len(row) > self.max_entries or 2 * int(size.sum()) > self.max_ids:
            self._reset()
            return
        ids = _gather(self.flat, start, size)
        self._reset()
        self._store(ids, size, check)
        self.key, self.row = key, np.arange(len(key), dtype=np.int32)

    def _store(self, ids: np.ndarray, sizes: np.ndarray, check: np.ndarray) -> None:
        k, n = self.rows, self.rows + len(sizes)
        self.check, self.start, self.size, self.again = (_room(x, n) for x in (self.check, self.start, self.size, self.again))
        self.flat = _room(self.flat, self.used + len(ids))
        self.flat[self.used : self.used + len(ids)] = ids
        self.check[k:n], self.size[k:n] = check, sizes
        self.start[k:n] = self.used + np.cumsum(sizes, dtype=np.int64) - sizes
        self.rows, self.used = n, self.used + len(ids)

    def _units(self, a: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First byte and end of every unit of the texts whose first bytes are ``edges``."""
        space = _SPACE[a]
        letter = _ASCII_LETTER[a]
        letter[1:] |= _LATIN[a[1:]] & (a[:-1] == 0xC3)
        cut = np.zeros(len(a), np.bool_)
        cut[1:] = (space[1:] & ~space[:-1]) | (_MARK[a[1:]] & letter[:-1])
        if self.drop_space:
            cut[1:] |= space[:-1] & ~space[1:]
        cut[edges] = True
        first = np.flatnonzero(cut)
        end = np.append(first[1:], len(a))
        if self.drop_space:
            word = ~space[first]
            first, end = first[word], end[word]
        return first, end

    def _hashes(self, buf: bytes, a: np.ndarray, first: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
        size = end - first
        out = []
        for k, base in enumerate(_BASES):
            if len(self._powers[k][0]) < len(a):
                n = max(len(a), _BLOCK + (_BLOCK >> 2))
                self._powers[k] = powers(base, n), powers(inverse(base), n)
            up, down = self._powers[k]
            total = np.zeros(len(a) + 1, np.uint64)
            np.cumsum((a + np.uint64(1)) * up[: len(a)], out=total[1:])
            out.append(mix64((total[end] - total[first]) * down[first] + mix64(size)))
        for i in np.flatnonzero(size > _LONG).tolist():
            digest = hashlib.blake2b(buf[first[i] : end[i]], digest_size=16).digest()
            out[0][i], out[1][i] = np.frombuffer(digest, np.uint64)
        return out

    def _joined(self, tokenizer, texts: list[str], glue: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of units that are joined, and of each its number; None if they can't be told apart."""
        got = tokenizer.encode_batch_fast([glue.join(texts[k : k + 512]) for k in range(0, len(texts), 512)], add_special_tokens=False)
        ids = np.concatenate([np.array(x.ids, np.uint32) for x in got])
        edges = np.flatnonzero(self.edge[ids])
        if len(edges) != len(texts):
            return None
        return ids, np.diff(edges, prepend=-1) if self.drop_space else np.diff(edges, append=len(ids))

    def _learn(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of unknown units one after another, and the number of each."""
        if self.drop_space:
            joins = np.fromiter((_STEM.fullmatch(x) is not None for x in texts), np.bool_, len(texts)) if self.words else np.zeros(len(texts), np.bool_)
        else:
            # safe for a unit with one white space, at its start
            joins = np.fromiter((len(x) > 1 and x[0] in " \n" and not x[1].isspace() for x in texts), np.bool_, len(texts))
        together, alone = np.flatnonzero(joins), np.flatnonzero(~joins)
        group = [texts[i] for i in together.tolist()]
        made = (self._joined(self.words, [x.lower() for x in group], " ") if self.drop_space else self._joined(self.tokenizer, group, "")) if group else None
        if made is None:
            together, alone = together[:0], np.arange(len(texts))
            made = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        rest = [x.ids for x in self.tokenizer.encode_batch_fast([texts[i] for i in alone.tolist()], add_special_tokens=False)] if len(alone) else []
        sizes = np.concatenate([made[1], np.array([len(x) for x in rest], np.int64)])
        ids = np.concatenate([made[0], np.array([i for x in rest for i in x], np.uint32)])
        back = np.argsort(np.concatenate([together, alone]))  # the units in their own order
        starts = np.cumsum(sizes) - sizes
        return _gather(ids, starts[back], sizes[back]), sizes[back]

    def _encode_plain(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        got = [self.tokenizer.encode(x.decode(), add_special_tokens=False).ids for x in texts]
        return np.array([i for x in got for i in x], np.uint32), np.array([len(x) for x in got], np.int64)

    def _encode_block(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and counts of texts none of which is empty."""
        buf = b"".join(texts)
        if len(buf) > 4 * _BLOCK:  # a text that can't be cut
            return self._encode_plain(texts)
        a = np.frombuffer(buf, np.uint8)
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
        first, end = self._units(a, np.concatenate([[0], ends[:-1]]))
        if not len(first):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        if self.rows > self.max_entries or self.used > self.max_ids:
            self._shrink()
        hashes, checks = self._hashes(buf, a, first, end)
        key, one, place = np.unique(hashes, return_index=True, return_inverse=True)
        check = checks[one]
        at = np.searchsorted(self.key, key)
        known = np.zeros(len(key), np.bool_)
        inside = at < len(self.key)
        known[inside] = self.key[at[inside]] == key[inside]
        row = np.zeros(len(key), np.int64)
        row[known] = self.row[at[known]]
        if (check[place] != checks).any() or (self.check[row[known]] != check[known]).any():
            return self._encode_plain(texts)
        self.again[row[known]] = True
        if not known.all():
            new = np.flatnonzero(~known)
            new_one = one[new]
            row[new] = self.rows + np.arange(len(new))
            learned = self._learn([buf[i:j].decode() for i, j in zip(first[new_one].tolist(), end[new_one].tolist(), strict=True)])
            self._store(*learned, check[new])
            self.key = np.insert(self.key, at[new], key[new])
            self.row = np.insert(self.row, at[new], row[new].astype(np.int32))
        row = row[place]
        size = self.size[row].astype(np.int64)
        before = np.concatenate([[0], np.cumsum(size)])[np.searchsorted(first, ends)]
        return _gather(self.flat, self.start[row], size), np.diff(before, prepend=0)

    def encode(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (null: none) one after another, and how many each has."""
        parts: list[bytes] = []
        owner: list[int] = []
        whole: list[bool] = []
        for i, raw in enumerate(texts):
            if raw:
                odd = not self.drop_space and _odd_space(raw)
                for part in (raw,) if odd else _parts(raw):
                    parts.append(part)
                    owner.append(i)
                    whole.append(odd)
        ids = [np.zeros(0, np.uint32)]
        counts = np.zeros(len(parts), np.int64)
        for i, j in slices(parts, _BLOCK):
            # the odd ones are few: each ends a run of the others
            stops = [k for k in range(i, j) if whole[k]]
            for a, b in zip([i, *(k + 1 for k in stops)], [*stops, j], strict=True):
                if a < b:
                    got, counts[a:b] = self._encode_block(parts[a:b])
                    ids.append(got)
                if b < j:
                    got, counts[b : b + 1] = self._encode_plain(parts[b : b + 1])
                    ids.append(got)
        return np.concatenate(ids), np.bincount(owner, counts, len(texts)).astype(np.int64)


_ENCODERS: dict[tuple[str, bool], CachedEncoder] = {}


def encoder(path: str, drop_space: bool) -> CachedEncoder:
    """One encoder a worker process and file; its dictionary lives on in the worker until released."""
    key = (path, drop_space)
    if key not in _ENCODERS:
        _ENCODERS[key] = CachedEncoder(path, drop_space)
    return _ENCODERS[key]


def release_encoders() -> None:
    """Give a reused worker's dictionaries back; tasks of operators that need memory but no tokens start with it."""
    _ENCODERS.clear()
    release_memory()
