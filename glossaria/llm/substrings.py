"""Substring dedup over words, level by level.

Words are runs without white space; a window is `window` consecutive words of one document.  A
window can only repeat if its shorter windows do, so levels start at a length of about LEAST words and
double until the next one is the window itself.  At each level a window is judged by one shorter window
of that length in it, the one of the smallest hash, the same wherever the window stands, so that only a
part of the shorter windows moves.  Only windows over a repeated one go on to twice the length; when
none survives, nothing more is looked at.  What survives all levels is compared at full length by 128
bits, of two hashes of 64 bits a word each.  A word goes if a window over it also starts in a document
with a smaller doc_id; windows are judged on the input.

Null texts have no words.  A null doc_id is larger than any other; rows with the same id are not
smaller than each other, so a window repeated only among them stays.  Documents shorter than the
window are kept.  Repeats within one document stay unless a smaller document has them too.

A block holds its distinct words once and its documents as numbers of words.
"""

from __future__ import annotations

import hashlib
import pickle

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from glossaria.llm.common import Numbers, hashes_at_length, mixed, starts_of
from glossaria.llm.repeats import exchanged, in_ranges, pack_sorted, packed, unpack_sorted, unpacked

LEAST = 7
_LAST = np.iinfo(np.int64).max


def _least(h: np.ndarray, over: int) -> np.ndarray:
    """The smallest of each `over` neighbours."""
    size = 1
    while size < over:
        step = min(2 * size, over)
        n = len(h) - (step - size)
        h, size = (np.minimum(h[:n], h[step - size :][:n]) if n > 0 else h[:0]), step
    return h


def _in(known: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Which numbers of x are among the ascending ones known."""
    if not len(known):
        return np.zeros(len(x), bool)
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x


def levels_of(window: int) -> list[int]:
    """The lengths before the last: from about LEAST on, each half of the next."""
    found = [window]
    while found[0] >= max(2, 2 * LEAST - 1):
        found.insert(0, -(-found[0] // 2))
    return found[:-1] or [-(-window // 2)]


class _Words:
    """A block's documents as numbers of words, and which windows stay within one document."""

    def __init__(self, state, window: int):
        self.ids, self.sizes, self.words, numbers = state
        self.number = np.frombuffer(unpacked(numbers), np.uint8).reshape(4, -1).T.copy().view("<u4").reshape(-1)
        self.ends = starts_of(self.sizes)
        digests = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, self.words)), "<u8").reshape(-1, 2)
        self.hash, self.other = digests[:, 0][self.number], digests[:, 1]
        of = np.repeat(np.arange(len(self.sizes), dtype=np.int32), np.diff(self.ends))
        n = max(0, len(of) - window + 1)
        self.whole = np.flatnonzero(of[:n] == of[window - 1 :][:n])
        self.of_window = of[self.whole]
        self.doc = np.array([_LAST if i is None else i for i in self.ids], np.int64)

    @staticmethod
    def prepare(ids, texts):
        number = Numbers()
        found = [np.fromiter(map(number.__getitem__, w), np.uint32, len(w)) for w in map(bytes.split, texts)]
        flat = np.concatenate(found) if found else np.empty(0, np.uint32)
        return ids, list(map(len, found)), list(number), packed(np.ascontiguousarray(flat.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def keep_first(docs: DataFrame, window: int = 13) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text): kept words joined by one space."""
    arrow = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string())])
    return _run(docs, window, lambda i, n, gone, words: (i, n, gone, b" ".join(words).decode("utf-8", "replace")), arrow, "doc_id long, n_words long, n_removed long, kept_text string")


def digests(docs: DataFrame, window: int = 13) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256)."""
    arrow = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])
    return _run(docs, window, lambda i, n, gone, words: (i, n, gone, hashlib.sha256(b" ".join(words)).hexdigest()), arrow, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def _run(docs: DataFrame, window: int, row, arrow: pa.Schema, schema: str) -> DataFrame:
    lengths = levels_of(window)

    def lead(w: _Words, length: int) -> np.ndarray:
        """For each window the smallest hash of the windows of that length in it, spread over all ranges again."""
        return mixed(_least(hashes_at_length(w.hash, length), window - length + 1)[w.whole])

    def surviving(w: _Words, level: int, known: np.ndarray | None) -> np.ndarray:
        """Which windows the level before leaves, known being its keys that repeat."""
        return np.ones(len(w.whole), bool) if level == 0 else _in(known, lead(w, lengths[level - 1]))

    def level_keys(level: int):
        def keys(state, known):
            w = _Words(state, window)
            stay = surviving(w, level, known)
            key, of = lead(w, lengths[level])[stay], w.of_window[stay]
            again = (key[1:] == key[:-1]) & (of[1:] == of[:-1])  # mostly the same place still
            return key[np.concatenate(([True], ~again))] if len(key) else key

        return keys

    def full(w: _Words, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Twice 64 bits of the windows that start at `at`."""
        return hashes_at_length(w.hash, window)[at], hashes_at_length(w.other[w.number], window)[at]

    def emit(state, known, crowded, n_parts):
        w = _Words(state, window)
        chosen = surviving(w, len(lengths), known)
        h, check = full(w, w.whole[chosen])
        doc = w.doc[w.of_window[chosen]]
        order = np.lexsort((doc, check, h))
        h, check, doc = h[order], check[order], doc[order]
        first = np.concatenate(([True], (h[1:] != h[:-1]) | (check[1:] != check[:-1]))) if len(h) else np.empty(0, bool)
        h, check, doc = h[first], check[first], doc[first]
        ends = in_ranges(h, n_parts)
        for p, (s, e) in enumerate(zip(ends, ends[1:])):
            if s < e:
                planes = np.ascontiguousarray(doc[s:e].astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes()
                yield p, pickle.dumps((pack_sorted(h[s:e]), check[s:e].astype("<u8").tobytes(), packed(planes)))

    def resolve(sent):
        of, h, check, doc = [], [], [], []
        for k, (_, data) in enumerate(sent):
            a, b, c = pickle.loads(data)
            h.append(unpack_sorted(a))
            check.append(np.frombuffer(b, "<u8"))
            doc.append(np.ascontiguousarray(np.frombuffer(unpacked(c), np.uint8).reshape(8, -1).T).view("<i8").reshape(-1))
            of.append(np.full(len(h[-1]), k, np.int32))
        of, h, check, doc = map(np.concatenate, (of, h, check, doc))
        order = np.lexsort((doc, check, h))
        h, check, doc, of = h[order], check[order], doc[order], of[order]
        first = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (check[1:] != check[:-1]))))
        least = np.repeat(doc[first], np.diff(np.concatenate((first, [len(h)]))))
        late = np.flatnonzero(doc > least)
        late = late[np.argsort(of[late], kind="stable")]
        ends = starts_of(np.bincount(of[late], minlength=len(sent)))
        for k, (block, _) in enumerate(sent):
            its = late[ends[k] : ends[k + 1]]
            if len(its):
                yield block, pickle.dumps((pack_sorted(h[its]), check[its].tobytes()))

    def finish(state, answers):
        w = _Words(state, window)
        h, check = full(w, w.whole) if len(w.whole) else (np.empty(0, np.uint64), np.empty(0, np.uint64))
        doc, goes = w.doc[w.of_window], np.zeros(len(h), bool)
        order = np.argsort(h)
        rising = h[order]  # lookups go faster in order
        same = np.concatenate(([False], rising[1:] == rising[:-1], [False]))
        some = order[same[1:] | same[:-1]] if len(h) else order  # what repeats within the block
        if len(some):
            some = some[np.lexsort((doc[some], check[some], h[some]))]
            new = np.concatenate(([True], (h[some][1:] != h[some][:-1]) | (check[some][1:] != check[some][:-1])))
            first = np.flatnonzero(new)
            goes[some] = doc[some] > np.repeat(doc[some][first], np.diff(np.concatenate((first, [len(some)]))))
        if answers:
            parts = [pickle.loads(a) for a in answers]
            known, tag = np.concatenate([unpack_sorted(a) for a, _ in parts]), np.concatenate([np.frombuffer(b, "<u8") for _, b in parts])
            by = np.lexsort((tag, known))
            known, tag = known[by], tag[by]
            some = order[_in(known, rising)]
            left, right = np.searchsorted(known, h[some], "left"), np.searchsorted(known, h[some], "right")
            for shift in range(int((right - left).max(initial=0))):  # more than one: equal in the first half, not in the second
                at = np.minimum(left + shift, len(known) - 1)
                goes[some] |= (left + shift < right) & (tag[at] == check[some])
        starts, n = w.whole[goes], len(w.hash) + window + 1
        cover = np.bincount(starts, minlength=n) - np.bincount(starts + window, minlength=n)
        gone = np.cumsum(cover)[: len(w.hash)] > 0
        rows = []
        for i, s, e in zip(w.ids, w.ends, w.ends[1:]):
            out, number = gone[s:e], w.number[s:e]
            n = int(out.sum())
            rows.append(row(i, len(out), n, [w.words[k] for k in (number[~out] if n else number).tolist()]))
        return rows

    return exchanged(docs, _Words.prepare, [level_keys(n) for n in range(len(lengths))], emit, resolve, finish, arrow, schema)
