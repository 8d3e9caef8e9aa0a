"""Cutting texts for byte-level BPE where no merge can cross, so that encodings of the parts can be kept and reused."""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Fixed value: the pattern that the public vocabulary's pre-tokenizer splits texts by.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

SOLID, LETTER, MARK, SPACE, LINE, INNER, TWO, THREE = (1 << i for i in range(8))
KEPT_PART = 256  # bytes of the longest part that is kept


def _byte_kinds() -> bytes:
    """What a byte says of a character. SOLID: it begins a visible one. LETTER, MARK: an ASCII letter or mark. INNER: not its first byte.
    TWO, THREE: it begins one of two or three bytes that is no white space (white space beyond ASCII starts with C2, E1, E2 or E3).
    LETTER on a first byte and on the inner byte after it, too, says that both are a Latin letter."""
    kinds = [0] * 256
    for b in range(0x21, 0x7F):
        kinds[b] = SOLID | (LETTER if chr(b).isalpha() else 0 if chr(b).isdigit() else MARK)
    kinds[0x20], kinds[0x0A] = SPACE, LINE
    for b in range(0x80, 0xC0):
        kinds[b] = INNER | (LETTER if chr(b + 0x40).isalpha() else 0)
    for b in range(0xC3, 0xE0):
        kinds[b] = SOLID | TWO
    kinds[0xC3] |= LETTER
    for b in (0xE0, *range(0xE4, 0xF0)):
        kinds[b] = SOLID | THREE
    return bytes(kinds)


KINDS = _byte_kinds()


def cuts(data: bytes) -> np.ndarray:
    """Where texts in UTF-8 can be cut so that every pre-token lies inside one part, as a mask of the bytes that start a part: a lone space
    and a lone line end between visible characters, what follows such a line end, and a mark after a letter. Texts may follow one another."""
    kinds = np.frombuffer(b"\0\0\0" + data.translate(KINDS) + b"\0", dtype=np.uint8)
    at = np.flatnonzero(kinds & (SPACE | LINE | MARK))
    here, before = kinds[at], kinds[at - 1]
    visible, letter = (before & SOLID) > 0, (before & (LETTER | INNER)) == LETTER
    wide = np.flatnonzero(before & INNER)
    two, three = kinds[at[wide] - 2], kinds[at[wide] - 3]
    visible[wide] = ((two & TWO) > 0) | (((two & INNER) > 0) & ((three & THREE) > 0))
    letter[wide] = ((two & TWO) > 0) & ((two & before[wide] & LETTER) > 0)
    lone = visible & ((kinds[at + 1] & SOLID) > 0)
    out = np.zeros(len(data), dtype=bool)
    out[at[(lone & ((here & MARK) == 0)) | (letter & ((here & MARK) > 0))] - 3] = True
    out[at[lone & ((here & LINE) > 0)] - 2] = True
    return out


class Kept:
    """Ids of parts in one array, and where those of each part are."""

    def __init__(self):
        self.places, self.used = {}, 0
        self.starts, self.sizes, self.ids = (np.zeros(1024, dtype=d) for d in (np.int64, np.int32, np.int32))
        self.n, self.n_ids = 0, 0

    def find(self, parts: list[bytes]) -> np.ndarray:
        """The place of each part, or -1."""
        return np.fromiter(map(self.places.get, parts, repeat(-1)), dtype=np.int64, count=len(parts))

    def take(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = self.sizes[places]
        return self.ids[runs(self.starts[places], sizes)], sizes

    def add(self, parts: list[bytes], ids: np.ndarray, sizes: np.ndarray) -> None:
        ends = np.cumsum(sizes, dtype=np.int64)
        self.starts = _put(self.starts, self.n, self.n_ids + ends - sizes)
        self.sizes = _put(self.sizes, self.n, sizes)
        self.ids = _put(self.ids, self.n_ids, ids)
        self.places.update(zip(parts, range(self.n, self.n + len(parts))))
        self.n, self.n_ids = self.n + len(parts), self.n_ids + len(ids)
        self.used += sum(map(len, parts)) + 4 * len(ids) + 150 * len(parts)  # a part's text, number and place in the dict


def _put(whole: np.ndarray, at: int, some: np.ndarray) -> np.ndarray:
    if at + len(some) > len(whole):
        whole = np.concatenate([whole, np.zeros(max(len(whole), len(some)), dtype=whole.dtype)])
    whole[at:at + len(some)] = some
    return whole


def runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of runs, one run after another."""
    upto = np.cumsum(sizes, dtype=np.int64)
    return np.repeat(starts - (upto - sizes), sizes) + np.arange(upto[-1] if len(upto) else 0)


class Parts:
    """Ids of texts, put together from the kept ids of their parts: the parts of a batch are numbered by Arrow, each different one is looked
    up or encoded once, and the ids of all are gathered. Twice ``room`` bytes of parts and those of one call are kept at most: when the
    store is full it becomes the old one, from which parts that are met again come back.

    ``encode_many`` takes parts and gives the ids of all one after another and how many each has."""

    def __init__(self, encode_many: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], special: str | None,
                 encode_whole: Callable[[str], list], room: int = 48_000_000):
        self.encode_many, self.special, self.encode_whole = encode_many, special, encode_whole
        self.room, self.kept, self.old = room, Kept(), Kept()

    def _look_up(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of different parts one after another, and how many each has."""
        if self.kept.used > self.room:
            self.old, self.kept = self.kept, Kept()
        places = self.kept.find(parts)
        missing = np.flatnonzero(places < 0)
        found = self.kept.take(places[places >= 0])
        if not len(missing):
            return found
        again = self.old.find([parts[i] for i in missing])
        some = [(np.flatnonzero(places >= 0), *found), (missing[again >= 0], *self.old.take(again[again >= 0]))]
        new = missing[again < 0]
        for at in range(0, len(new), 4096):
            of = new[at:at + 4096]
            some.append((of, *self._encoded([parts[i].decode() for i in of])))
        for of, ids, sizes in some[1:]:
            short = np.array([len(parts[i]) <= KEPT_PART for i in of], dtype=bool)
            if len(of):
                self.kept.add([parts[i] for i in of[short]], ids[np.repeat(short, sizes)], sizes[short])
        order = np.concatenate([of for of, _, _ in some])
        sizes = np.concatenate([s for _, _, s in some]).astype(np.int64)
        back = np.empty(len(parts), dtype=np.int64)
        back[order] = np.arange(len(parts))
        starts = np.cumsum(sizes) - sizes
        return np.concatenate([ids for _, ids, _ in some])[runs(starts[back], sizes[back])], sizes[back]

    def _encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if not self.special or not any(self.special in t for t in texts):
            return self.encode_many(texts)
        ids = [self.encode_whole(t) if self.special in t else self.encode_many([t])[0] for t in texts]
        return np.concatenate(ids).astype(np.int32), np.array([len(x) for x in ids], dtype=np.int32)

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and how many each text has. Null texts have none."""
        texts = pc.fill_null(texts, "").cast(pa.string())
        ends = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset:texts.offset + len(texts) + 1]
        if not len(texts) or ends[0] == ends[-1]:
            return np.zeros(0, dtype=np.int32), np.zeros(len(texts), dtype=np.int64)
        data = texts.buffers()[2][int(ends[0]):int(ends[-1])].to_pybytes()
        ends = ends - ends[0]
        starts = cuts(data)
        if self.special:
            for i in np.flatnonzero(pc.match_substring(texts, self.special).to_numpy(zero_copy_only=False)):
                starts[ends[i]:ends[i + 1]] = False
        starts[ends[:-1][np.diff(ends) > 0]] = True
        starts = np.flatnonzero(starts).astype(np.int32)
        bounds = np.append(starts, np.int32(len(data)))
        parts = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(data)]).dictionary_encode()
        known, lengths = self._look_up(parts.dictionary.to_pylist())
        which = parts.indices.to_numpy()
        sizes = lengths[which]
        upto = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        flat = known[runs((np.cumsum(lengths, dtype=np.int64) - lengths)[which], sizes)]
        return flat, np.diff(upto[np.searchsorted(starts, ends)])


def flat_ids(lists: list) -> tuple[np.ndarray, np.ndarray]:
    """Lists of ids as one array, and their lengths."""
    sizes = np.fromiter(map(len, lists), dtype=np.int32, count=len(lists))
    return np.fromiter(chain.from_iterable(lists), dtype=np.int32, count=int(sizes.sum())), sizes


def slices(sizes: np.ndarray, most: int = 8_000_000, rows: int = 2048):
    """Row ranges of a batch with at most ``most`` bytes each, or one row."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and (total + n > most or i - start >= rows):
            yield start, i
            start, total = i, 0
        total += int(n)
    if start < len(sizes):
        yield start, len(sizes)
