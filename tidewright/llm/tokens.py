"""Token ids by the tokenizers library, each different piece of a batch of texts once.

Both vocabularies cut a text before they merge: the byte-level one takes at most one space with a word, the
one with word ends drops white space altogether, and both part letters, digits and other signs. So a text's ids
are those of its pieces one after the other. Texts are cut with NumPy as bytes, the pieces of a batch become an
Arrow dictionary, and only its entries reach Python, where a bounded memo has the frequent ones. A word with
signs whose class isn't plain from the bytes (an apostrophe, other scripts) is one piece, which the tokenizer
cuts itself; a text with white space beyond ASCII, or a special token, is cut by runs of white space.
"""

from __future__ import annotations

import os
import re
from itertools import chain, repeat

import numpy as np
import pyarrow as pa

from . import common

#: Unicode White_Space, as the tokenizers' regular expressions have it.
SPACE = r" \t-\r\x85\xa0  -     　"
RUNS = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
#: The same beyond ASCII, as UTF-8, and the bytes that it begins with.
WIDE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2(?:\x80[\x80-\x8a\xa8\xa9\xaf]|\x81\x9f)|\xe3\x80\x80")
WIDE_FIRST = np.zeros(256, bool)
WIDE_FIRST[[0xC2, 0xE1, 0xE2, 0xE3]] = True
#: Entries and ids beyond which the memo is thinned out, and the longest key kept.
MEMO, POOL, LONGEST = 800_000, 8_000_000, 60
#: Bytes of text cut at a time; longer texts are parted where a single space stands between letters or digits.
SLICE = 8 << 20
PART = re.compile(rb"[A-Za-z0-9] [A-Za-z0-9]")
#: Classes of bytes: white space, letters, digits, other signs, and what needs the tokenizer's own eyes.
BLANK, LETTER, DIGIT, SIGN, OTHER = range(5)
CLASS = np.full(256, OTHER, np.uint8)
CLASS[33:127] = SIGN
CLASS[[9, 10, 11, 12, 13, 32]] = BLANK
CLASS[48:58] = DIGIT
CLASS[65:91] = CLASS[97:123] = LETTER
CLASS[[ord("'"), ord("<")]] = OTHER
#: A-Z to a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Pieces that are merged as they are.
PLAIN = re.compile(rb" ?(?:(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+|[0-9]+|[!-&(-/:;=-@\[-`{-~]+)|[\t-\r ]+")
#: The byte-level alphabet: printable bytes stand for themselves, the others for the code points from 256 on.
_SELF = [*range(33, 127), *range(161, 173), *range(174, 256)]
ALPHABET = {b: c for b, c in zip(_SELF + [b for b in range(256) if b not in set(_SELF)], _SELF + list(range(256, 512)), strict=False) if b != c}


class Memo:
    """The ids of pieces, all in one array; when it is full, only what the last batch asked for is kept."""

    def __init__(self, make):
        self.make, self.known = make, {}
        self.pool, self.ends = np.zeros(0, "<u4"), np.zeros(1, np.int64)
        self.used = self.asked = self.made = 0

    def __call__(self, keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Where each key's ids begin in the pool, and how many they are; good until the next call."""
        if len(self.known) > MEMO or self.used > POOL:
            self.keep(keys)
        which = np.fromiter(map(self.known.get, keys, repeat(-1)), np.int64, len(keys))
        missing = np.flatnonzero(which < 0)
        self.asked, self.made = self.asked + len(keys), self.made + len(missing)
        if len(missing):
            new = [keys[i] for i in missing.tolist()]
            self.add(new, list(map(self.make, new)))
            which[missing] = np.arange(len(self.ends) - 1 - len(new), len(self.ends) - 1)
        begins = self.ends[which]
        return begins, self.ends[which + 1] - begins

    def add(self, keys: list[bytes], ids: list[list[int]]) -> None:
        ends = self.used + np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))
        n, total = len(self.ends) - 1, int(ends[-1])
        if total > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.zeros(2 * total - self.used, "<u4")])
        self.pool[self.used : total] = np.fromiter(chain.from_iterable(ids), "<u4", total - self.used)
        self.ends, self.used = np.concatenate([self.ends, ends]), total
        self.known.update((k, i) for i, k in enumerate(keys, n) if len(k) <= LONGEST)

    def keep(self, keys: list[bytes]) -> None:
        left = {k: self.pool[self.ends[i] : self.ends[i + 1]].tolist() for k in keys if (i := self.known.get(k)) is not None}
        self.known, self.pool, self.ends, self.used = {}, np.zeros(0, "<u4"), np.zeros(1, np.int64), 0
        if left:
            self.add(list(left), list(left.values()))


class Coder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.model._resize_cache(0)  # the memo has what is frequent
        self.drops_space = self.tokenizer.normalizer is not None
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.pieces = Memo(self.merged)

    def exact(self, piece: str) -> list[int]:
        """A piece that the tokenizer cuts from the rest of a text."""
        return self.tokenizer.encode(piece, add_special_tokens=False).ids

    def merged(self, piece: bytes) -> list[int]:
        """Plain pieces go to the tokenizer's merges at once."""
        if piece.isalpha():
            mapped = piece.decode()
        elif piece[1:].isalpha() and piece[0] == 32:
            mapped = "\u0120" + piece[1:].decode()
        elif PLAIN.fullmatch(piece):
            mapped = piece.decode("latin-1").translate(ALPHABET)
        else:
            return self.exact(piece.decode())
        return [t.id for t in self.model.tokenize(mapped)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of whole texts (UTF-8) one after the other, and where each text begins and the last one ends."""
        if not len(texts):
            return np.zeros(0, "<u4"), np.zeros(1, np.int64)
        offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4).astype(np.int64)
        data = texts.buffers()[2] if offsets[-1] > offsets[0] else pa.py_buffer(b"")
        ids, counts = [], np.zeros(len(texts), np.int64)
        begin = 0
        while begin < len(texts):
            end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + SLICE, "right")) - 1)
            if offsets[end] - offsets[begin] <= SLICE:
                own, counts[begin:end] = self.short(data[offsets[begin] : offsets[end]], offsets[begin : end + 1] - offsets[begin])
                ids.append(own)
            else:
                for part in self.parts(data, int(offsets[begin]), int(offsets[end])):
                    own, n = self.short(part, np.array([0, len(part)]))
                    ids.append(own)
                    counts[begin] += n[0]
            begin = end
        return np.concatenate([np.zeros(0, "<u4"), *ids]), np.concatenate([[0], np.cumsum(counts)])

    def closed(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The same with end_id after each text."""
        ids, bounds = self.encode(texts)
        return np.insert(ids, bounds[1:], end_id), bounds + np.arange(len(bounds))

    @staticmethod
    def parts(data: pa.Buffer, at: int, end: int):
        """A long text in parts whose ids don't depend on each other."""
        view = memoryview(data)
        while end - at > SLICE:
            found = PART.search(view, at + SLICE, end)
            if not found:
                break
            yield data[at : found.start() + 1]
            at = found.start() + 1
        yield data[at:end]

    def short(self, buffer: pa.Buffer, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some texts, and how many each has."""
        data = np.frombuffer(buffer, np.uint8)
        if not len(data):
            return np.zeros(0, "<u4"), np.zeros(len(offsets) - 1, np.int64)
        if not self.drops_space and len(odd := self.odd(buffer, data, offsets)):
            return self.mixed(buffer, offsets, odd)
        kind = CLASS[data]
        accents = np.flatnonzero(data == 0xC3)
        accents = accents[accents + 1 < len(data)]
        after = data[accents + 1]
        accents = accents[(after != 0x97) & (after != 0xB7)]
        kind[accents] = kind[accents + 1] = LETTER
        blank = kind == BLANK
        texts = np.zeros(len(data) + 1, bool)  # where texts begin
        texts[offsets] = True
        texts = texts[:-1]
        cut = np.ones(len(data), bool)  # where pieces begin
        np.not_equal(kind[1:], kind[:-1], out=cut[1:])
        if self.drops_space:
            cut |= kind == DIGIT
        else:  # of white space before a word the last is apart from the others, and a space joins the word
            last = np.flatnonzero(blank[:-1] & ~blank[1:] & ~texts[1:])
            cut[last] = True
            cut[last + 1] = data[last] != 32
        cut |= texts
        whole = np.flatnonzero(kind == OTHER)
        if len(whole):  # words that the tokenizer cuts
            edge = blank.copy()
            edge[1:] = (blank[1:] != blank[:-1]) | (texts[1:] & ~blank[1:])
            edge[0] = True
            runs = np.flatnonzero(edge)  # white space and words in turn
            own = np.unique(np.searchsorted(runs, whole, "right") - 1)
            ends = np.append(runs, len(data))[own + 1]
            inside = np.zeros(len(data) + 1, np.int8)
            inside[runs[own] + 1] += 1
            inside[ends] -= 1
            inside = np.cumsum(inside[:-1], dtype=np.int8) > 0
            cut &= ~inside
            inside[runs[own]] = True
        if self.drops_space:
            fold = LOWER[data]
            capital = accents[(data[accents + 1] <= 0x9E)] + 1
            fold[capital] += 32
            if len(whole):
                fold[inside] = data[inside]
            keep = ~blank
            begins = np.flatnonzero(cut & keep)
            place = np.cumsum(keep, dtype=np.int32)
            ends, data = place[begins] - 1, fold[keep]
        else:
            begins = ends = np.flatnonzero(cut)
        bounds = np.append(ends, len(data)).astype(np.int32)
        coded = pa.BinaryArray.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(bounds), pa.py_buffer(data)]).dictionary_encode()
        first, many = self.pieces(coded.dictionary.to_pylist())
        ids, upto = self.joined(first, many, coded.indices.to_numpy())
        return ids, np.diff(upto[np.searchsorted(begins, offsets)])

    def joined(self, first: np.ndarray, many: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces one after the other, and how many are before each."""
        many = many.astype(np.int32)[which]
        upto = np.zeros(len(which) + 1, np.int32)
        np.cumsum(many, out=upto[1:])
        place = np.repeat(first.astype(np.int32)[which] - upto[:-1], many)
        place += np.arange(upto[-1], dtype=np.int32)
        return self.pieces.pool[place], upto

    def odd(self, buffer: pa.Buffer, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Texts with white space beyond ASCII or a special token."""
        found = []
        view = memoryview(buffer)
        if WIDE_FIRST[data].any():
            found += [m.start() for m in WIDE.finditer(view)]
        for special in self.special:
            found += [m.start() for m in re.finditer(re.escape(special), view)]
        return np.unique(np.searchsorted(offsets, np.array(found, np.int64), "right") - 1)

    def mixed(self, buffer: pa.Buffer, offsets: np.ndarray, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ids, counts = [], np.zeros(len(offsets) - 1, np.int64)
        begin = 0
        for i in [*odd.tolist(), len(offsets) - 1]:
            if i > begin:
                own, counts[begin:i] = self.short(buffer[offsets[begin] : offsets[i]], offsets[begin : i + 1] - offsets[begin])
                ids.append(own)
            if i < len(offsets) - 1:
                runs = RUNS.findall(buffer[offsets[i] : offsets[i + 1]].to_pybytes().decode())
                own, _ = self.joined(*self.pieces([x.encode() for x in runs]), np.arange(len(runs)))
                ids.append(own)
                counts[i] = len(own)
            begin = i + 1
        return np.concatenate(ids), counts


_coders: dict[str, Coder] = {}
common.CACHES.append(_coders.clear)


def coder(path: str) -> Coder:
    """One for each tokenizer file and Python worker."""
    if path not in _coders:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _coders[path] = Coder(path)
    return _coders[path]


def vocabulary(name: str) -> str:
    """Path of one of the public tokenizers' files."""
    import public_tokenizers

    return public_tokenizers.path(name)
