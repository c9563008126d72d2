"""Encoding with public tokenizers inside Arrow functions.

A byte-level BPE never joins what stands before white space with it, so a text may be cut before any space that
follows a character other than white space: the ids of the parts are the ids of the text. Parts repeat across texts;
each worker keeps the ids of the short parts it has met, up to a bound, and gives the library only new ones. Cutting,
looking up and putting together work on whole batches of bytes; no Python object is made for a part that is known.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from . import text

#: Bytes of text that are taken at once.
BATCH_BYTES = 1 << 20
#: Slots of the table of known parts (three quarters are used), longest part in bytes that it can hold, parts at once.
SLOTS, SHORT, AT_ONCE = 1 << 20, 15, 1 << 18
#: Longer parts that are kept, and the longest of those in bytes.
KEPT_LONG, KEPT_BYTES = 20_000, 64
#: New parts given to the library in one string.
JOINED = 512
_ENCODERS: dict[tuple[str, bool], "PartEncoder"] = {}

#: ASCII white space (with 0x1C-0x1F, which some libraries count), and the last two bytes of other white space.
_WHITE = np.zeros(256, bool)
_WHITE[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] = True
_WHITE_PAIRS = np.zeros(1 << 16, bool)
_WHITE_PAIRS[[0xC285, 0xC2A0, 0x9A80, *range(0x8080, 0x808B), 0x80A8, 0x80A9, 0x80AF, 0x819F]] = True
_LOW_BYTES = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def tokenizer_path(name: str) -> str:
    """Where the vocabulary file of that name is."""
    import public_tokenizers

    return public_tokenizers.path(name)


def part_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The first byte of each part: rows start one, and each space after a character other than white space."""
    first = np.zeros(len(data), bool)
    if len(data) > 1:
        first[1:] = (data[1:] == 0x20) & ~_WHITE[data[:-1]]
        odd = np.flatnonzero(first[2:] & (data[1:-1] >= 0x80)) + 2
        first[odd[_WHITE_PAIRS[data[odd - 2].astype(np.int64) << 8 | data[odd - 1]]]] = False
    first[offsets[:-1][np.diff(offsets) > 0]] = True
    return np.flatnonzero(first)


class PartEncoder:
    """The ids of texts, one after another, and how many each has; or only how many."""

    def __init__(self, path: str, counts: bool = False) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        kinds = str(self.tokenizer.pre_tokenizer), str(self.tokenizer.normalizer)
        added = self.tokenizer.get_added_tokens_decoder().values()
        if "ByteLevel" not in kinds[0] or kinds[1] != "None" or any(x.lstrip or x.rstrip or " " in x.content for x in added):
            raise ValueError(f"only byte-level vocabularies without a normalizer or added tokens with spaces can be encoded in parts: {path}")
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        if max(vocabulary.values()) > 0xFFFF:
            raise ValueError("ids over 65535 don't fit the 16-bit integers used here")
        # In the byte-level alphabet a character stands for a byte; special tokens are plain ASCII.
        self.n_bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.n_bytes[i] = len(token)
        self.counts = counts
        # Known parts: a table from their bytes to a number, and the ids of each number in a pool.
        self.keys = np.zeros((2, SLOTS), np.uint64)
        self.number = np.zeros(SLOTS, np.int32)
        self.size = np.zeros(1 << 16, np.int32)
        self.start = np.zeros(1 << 16, np.int64)
        self.pool = np.zeros(1 << 18, np.uint16)
        self.n_known = self.n_pool = self.n_short = 0
        self.kept = (0, 0)
        self.long: dict[bytes, int] = {}

    def _library(self, new: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of new parts, one after another, and how many each has. Parts that start with a space and don't end in
        white space go to the library in one string and are cut again where their bytes end; others could join their
        neighbours and go alone."""
        texts = [x.decode("utf-8", "surrogatepass") for x in new]
        alone = [k for k, x in enumerate(texts) if x[0] != " " or x[-1].isspace() or len(x) > 4 * KEPT_BYTES]
        apart = set(alone)
        rest = [k for k in range(len(texts)) if k not in apart]
        runs = [rest[i : i + JOINED] for i in range(0, len(rest), JOINED)]
        pieces: list[np.ndarray] = []
        sizes = np.zeros(len(texts), np.int64)
        order: list[int] = []
        for run, encoding in zip(runs, self.tokenizer.encode_batch_fast(["".join(texts[k] for k in r) for r in runs], add_special_tokens=False)):
            ids = np.array(encoding.ids, np.int64)
            ends = np.cumsum(np.fromiter((len(new[k]) for k in run), np.int64, len(run)))
            sizes[run] = np.diff(np.searchsorted(np.cumsum(self.n_bytes[ids]), ends, "left") + 1, prepend=0)
            pieces.append(ids)
            order += run
        for k, encoding in zip(alone, self.tokenizer.encode_batch_fast([texts[k] for k in alone], add_special_tokens=False)):
            sizes[k] = len(encoding.ids)
            pieces.append(np.array(encoding.ids, np.int64))
            order.append(k)
        flat, by = np.concatenate([np.zeros(0, np.int64), *pieces]).astype(np.uint16), np.array(order, np.int64)
        starts = np.zeros(len(texts), np.int64)
        starts[by] = np.cumsum(sizes[by]) - sizes[by]
        return flat[_spread(starts, sizes)], sizes

    def _add(self, ids: np.ndarray, sizes: np.ndarray, keep: np.ndarray) -> np.ndarray:
        """Put parts after the known ones, those to keep first; their numbers."""
        order = np.argsort(~keep, kind="stable")
        ids, sizes = ids[_spread((np.cumsum(sizes) - sizes)[order], sizes[order])], sizes[order]
        first, end, n_kept = self.n_known, self.n_known + len(sizes), int(keep.sum())
        if end > len(self.size):
            self.size, self.start = (np.concatenate((x, np.zeros(end, x.dtype))) for x in (self.size, self.start))
        self.size[first:end] = sizes
        if not self.counts:
            if self.n_pool + len(ids) > len(self.pool):
                self.pool = np.concatenate((self.pool, np.zeros(self.n_pool + len(ids), np.uint16)))
            self.pool[self.n_pool : self.n_pool + len(ids)] = ids
            self.start[first:end] = self.n_pool + np.cumsum(sizes) - sizes
        self.n_known, self.kept = end, (first + n_kept, self.n_pool + int(sizes[:n_kept].sum()))
        self.n_pool += len(ids)
        numbers = np.empty(len(order), np.int64)
        numbers[order] = first + np.arange(len(order))
        return numbers

    def _slot(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        h = (a ^ (b * np.uint64(0xC2B2AE3D27D4EB4F))) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xD1342543DE82EF95)
        return (h >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)

    def _find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The numbers of parts, -1 where they aren't known."""
        slot = self._slot(a, b)
        out = np.full(len(a), -1, np.int32)
        left = np.arange(len(a))
        while left.size:
            at = slot[left]
            there = self.keys[1, at]
            same = (there == b[left]) & (self.keys[0, at] == a[left])
            out[left[same]] = self.number[at[same]]
            left = left[~same & (there != 0)]
            slot[left] = (slot[left] + 1) & (SLOTS - 1)
        return out

    def _keep(self, a: np.ndarray, b: np.ndarray, numbers: np.ndarray) -> None:
        slot = self._slot(a, b)
        left = np.arange(len(a))
        while left.size:
            at = slot[left]
            free = self.keys[1, at] == 0
            # Of several for one free slot the last gets it; the rest go on.
            self.keys[0, at[free]], self.keys[1, at[free]], self.number[at[free]] = a[left[free]], b[left[free]], numbers[left[free]]
            got = (self.keys[1, at] == b[left]) & (self.keys[0, at] == a[left])
            left = left[~got]
            slot[left] = (slot[left] + 1) & (SLOTS - 1)

    def _numbers(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The number of each part. data: with 16 bytes after the last part. New parts for which there is no room are
        forgotten at the next call."""
        self.n_known, self.n_pool = self.kept
        words = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
        a = words[starts] & _LOW_BYTES[np.minimum(sizes, 8)]
        # Up to 15 bytes and their number make the key, so parts are told apart exactly.
        b = (words[starts + 8] & _LOW_BYTES[np.clip(sizes - 8, 0, 7)]) | (np.minimum(sizes, 255).astype(np.uint64) << np.uint64(56))
        short = sizes <= SHORT
        out = np.full(len(starts), -1, np.int64)
        out[short] = self._find(a[short], b[short])
        missing = np.flatnonzero(short & (out < 0))
        by_key = missing[np.lexsort((a[missing], b[missing]))]
        first = np.ones(len(by_key), bool)
        first[1:] = (a[by_key[1:]] != a[by_key[:-1]]) | (b[by_key[1:]] != b[by_key[:-1]])
        one = by_key[first]
        new = [data[s : s + n].tobytes() for s, n in zip(starts[one].tolist(), sizes[one].tolist())]
        other = np.flatnonzero(~short).tolist()
        long = [data[starts[k] : starts[k] + sizes[k]].tobytes() for k in other]
        new_long = [x for x in dict.fromkeys(long) if x not in self.long]
        if not new and not long:
            return out
        keep = np.zeros(len(new) + len(new_long), bool)
        room = SLOTS * 3 // 4 - self.n_short
        keep[: min(room, len(new))] = True
        room_long = KEPT_LONG - len(self.long)
        keep[len(new) + np.array([k for k, x in enumerate(new_long) if len(x) <= KEPT_BYTES][:room_long], np.int64)] = True
        numbers = self._add(*self._library(new + new_long), keep)
        out[by_key] = numbers[np.cumsum(first) - 1]
        kept = keep[: len(new)]
        self._keep(a[one[kept]], b[one[kept]], numbers[: len(new)][kept])
        self.n_short += int(kept.sum())
        own = dict(zip(new_long, numbers[len(new) :].tolist()))
        out[other] = [self.long[x] if x in self.long else own[x] for x in long]
        self.long |= {x: own[x] for x, k in zip(new_long, keep[len(new) :].tolist()) if k}
        return out

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, one after another (none where only counts are wanted), and how many each row has."""
        starts = part_starts(data, offsets)
        ends = np.append(starts[1:], len(data))
        padded = np.concatenate((data, np.zeros(16, np.uint8)))
        pieces: list[np.ndarray] = [np.zeros(0, np.uint16)]
        total = np.zeros(len(starts) + 1, np.int64)
        for i in range(0, len(starts), AT_ONCE):
            of = slice(i, i + AT_ONCE)
            numbers = self._numbers(padded, starts[of], ends[of] - starts[of])
            sizes = self.size[numbers].astype(np.int64)
            total[i + 1 : i + 1 + len(sizes)] = sizes
            if not self.counts:
                pieces.append(self.pool[_spread(self.start[numbers], sizes)])
        np.cumsum(total, out=total)
        return np.concatenate(pieces), np.diff(total[np.searchsorted(starts, offsets)])


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for sizes[0] places, and so on."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


def encoder(path: str, counts: bool = False) -> PartEncoder:
    """The worker's encoder of a vocabulary file."""
    if (path, counts) not in _ENCODERS:
        _ENCODERS[path, counts] = PartEncoder(path, counts)
    return _ENCODERS[path, counts]


def encode_slices(texts: pa.Array, path: str, counts: bool = False):
    """First row, end row, ids and how many each row has, for runs of rows of about BATCH_BYTES; nulls are empty texts."""
    encode = encoder(path, counts)
    for a, b, data, offsets in text.slices(texts, BATCH_BYTES):
        yield a, b, *encode(data, offsets)


def with_end(ids: np.ndarray, sizes: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and sizes with end_id after each row."""
    return np.insert(ids, np.cumsum(sizes), np.uint16(end_id)), sizes + 1
