"""Suffix-array dedup over bytes.

Documents are UTF-8 bytes; a byte goes if a string of `length` bytes over it also starts anywhere
else, in the same document or another.  Strings are judged on the input and never cross documents.

Every string of that length is led by one anchor, the `ANCHOR`-byte string of the smallest hash in it
(the leftmost on ties), wherever the string stands.  Anchors that occur once lead nothing that
repeats.  For the others, the stretch of bytes of all strings that one anchor leads (a segment) goes
to the task of the anchor's range; equal segments of a block travel as one, and equal segments of a
range are settled by their number.  Groups too large for one sort are parted exactly, by halves of
the anchor's distance from a string's start and the bytes that all strings of a half share.

A passage that a large part of the corpus holds has as many segments as documents around its edges.
The anchors of `CROWDED` segments or more, all blocks counted, therefore send no segments but names,
96 bits of each different string, dealt over all ranges, so no range gets more than one entry a block
of any string.  What shares a name is then compared by its bytes, again one entry a block and string.

Segments that share an anchor but differ form a text whose suffix array is built by two-stage
sorting: suffixes smaller than their successors are sorted directly, the others are induced by
scanning the buckets of first bytes in order, and common prefixes of neighbours say which strings
repeat.  Only suffixes that a string starts with, and those they are induced from, are sorted; order
beyond `length` bytes doesn't matter and isn't computed.

Null and empty texts have no bytes.  Texts shorter than `length` are kept whole.  Rows that repeat
are separate documents, so both copies go.
"""

from __future__ import annotations

import hashlib
import pickle

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from glossaria.llm.common import mixed, runs, starts_of
from glossaria.llm.repeats import exchanged, in_ranges, pack_sorted, packed, range_of, unpack_sorted, unpacked

ANCHOR = 32
CHUNK = 1 << 20
SORTED = 2 << 20
CROWDED = 1 << 14
_LOW = np.uint64((1 << 28) - 1)
_BREAK = b"\xff"  # not in any UTF-8 text
_A = np.uint64(0x9E3779B97F4A7C15)
_B = np.uint64(0xD6E8FEB86659FD93)


def eights(text: np.ndarray) -> np.ndarray:
    """At each place the next eight bytes as one big-endian number, zeros beyond the end."""
    x = np.zeros(len(text) + 8, np.uint64)
    x[: len(text)] = text
    for step, bits in ((1, 8), (2, 16), (4, 32)):
        x[:-step] = (x[:-step] << np.uint64(bits)) | x[step:]
    return x[: len(text)]


def smaller_than_next(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one; the last is not, being larger than the empty one."""
    n = len(text)
    rises = np.zeros(n, bool)
    if n > 1:
        place = np.where(text[1:] != text[:-1], np.arange(n - 1), n)
        place = np.minimum.accumulate(place[::-1])[::-1]  # the next place where neighbours differ
        inside = place < n
        place = place[inside]
        rises[:-1][inside] = text[place] < text[place + 1]
    return rises


def sorted_directly(words: np.ndarray, which: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first depth bytes, eight at a time, only groups still equal going on."""
    order = which[np.argsort(words[which], kind="stable")]
    words = np.concatenate([words, np.zeros(depth + 8, np.uint64)])
    active = np.arange(len(order))
    group = np.cumsum(np.concatenate(([0], words[order[1:]] != words[order[:-1]])))[: len(order)]  # of the active, rising along the order
    changed = True
    for at in range(8, depth, 8):
        if changed:
            many = np.bincount(group, minlength=1)[group] > 1
            active, group = active[many], group[many]
            place, together = order[active], group[1:] == group[:-1]
        if not len(active):
            break
        key = words[place + at]
        differs = (key[1:] != key[:-1]) & together
        changed = bool(differs.any())
        if changed:  # only groups in which the next bytes differ are sorted
            open_ = np.zeros(int(group[-1]) + 1, bool)
            open_[group[1:][differs]] = True
            some = np.flatnonzero(open_[group])
            by = np.lexsort((key[some], group[some]))
            order[active[some]], key[some] = order[active[some[by]]], key[some[by]]
            group = np.cumsum(np.concatenate(([0], ~together | (key[1:] != key[:-1]))))
    return order


def suffix_array(text: np.ndarray, depth: int, needed: np.ndarray | None = None) -> np.ndarray:
    """All suffixes of a byte array, ordered by at least their first depth bytes.

    If only some are needed, others may be missing: to place a suffix larger than its successor takes
    those after it up to the first that is smaller than its own, and nothing beyond.
    """
    n = len(text)
    if n == 0:
        return np.empty(0, np.int64)
    words, small = eights(text), smaller_than_next(text)
    direct = np.flatnonzero(small)
    if needed is not None:
        after = np.unique(np.searchsorted(direct, np.flatnonzero(needed)))
        direct = direct[after[after < len(direct)]]
    direct = sorted_directly(words, direct, depth)
    of_bucket = starts_of(np.bincount(text[direct], minlength=256))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[text[n - 1]].append(np.array([n - 1]))
    out = []
    for c in range(256):
        large = waiting[c]
        wave = np.concatenate(large) if large else np.empty(0, np.int64)
        found = [wave]
        while len(wave):  # runs of the same byte lead to the same bucket again
            before = wave[wave > 0] - 1
            wave = before[text[before] == c]
            found.append(wave)
        bucket = np.concatenate([*found, direct[of_bucket[c] : of_bucket[c + 1]]])
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[text[before] > c]
        if len(before):
            first = text[before]
            before = before[np.argsort(first, kind="stable")]
            ends = starts_of(np.bincount(first, minlength=256))
            for b in np.unique(first).tolist():
                waiting[b].append(before[ends[b] : ends[b + 1]])
    return np.concatenate(out)


def shares_prefix(text: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Whether the suffixes a[i] and b[i], both of length bytes at least, agree in that many."""
    words = eights(text)
    same, active = np.zeros(len(a), bool), np.arange(len(a))
    for at in range(0, length, 8):
        x, y = words[a[active] + at], words[b[active] + at]
        if at + 8 > length:
            x, y = x >> np.uint64(8 * (at + 8 - length)), y >> np.uint64(8 * (at + 8 - length))
        active = active[x == y]
    same[active] = True
    return same


def repeated_starts(text: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
    """Which of the marked places start a string of that length that another marked place starts too."""
    order = suffix_array(text, length, start)
    order = order[start[order]]
    same = shares_prefix(text, order[:-1], order[1:], length)
    out = np.zeros(len(text), bool)
    out[order[:-1][same]] = out[order[1:][same]] = True
    return out


def _windows(texts: list[bytes], length: int):
    """(places in the block, bytes, starts of the texts in them, their lengths): texts side by side, long ones in windows that overlap by length - 1 bytes."""
    part, own, size, base = [], [], 0, 0
    for t in texts:
        for at in range(0, max(1, len(t) - length + 1), CHUNK):
            piece = t[at : at + CHUNK + length - 1]
            part.append(piece)
            own.append(base + at)
            size += len(piece)
            if size >= CHUNK:
                yield own, part
                part, own, size = [], [], 0
        base += len(t)
    if part:
        yield own, part


def _hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hashes of the ANCHOR bytes from each place on."""
    h, step, factor = mixed(data.astype(np.uint64) + _A), 1, int(_A)
    while step < ANCHOR:
        h, step, factor = h[:-step] * np.uint64(factor) + h[step:], 2 * step, factor * factor % (1 << 64)
    return mixed(h)


def _segments(texts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """Runs of neighbouring strings with the same anchor: their first string's place in the block, how many, the anchor's distance from the first, and its key."""
    over = length - ANCHOR + 1
    found = [(np.empty(0, np.uint32), np.empty(0, np.uint16), np.empty(0, np.uint16), np.empty(0, np.uint64))]
    for places, part in _windows(texts, length):
        data = np.frombuffer(b"".join(part), np.uint8)
        lengths = np.array(list(map(len, part)))
        own, n = starts_of(lengths)[:-1], np.maximum(0, lengths - length + 1)
        if not n.any():
            continue
        h = _hashes(data)
        low = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
        step = 1
        while step < over:
            to = min(2 * step, over)
            low = np.minimum(low[: len(low) - (to - step)], low[to - step :])
            step = to
        start = runs(own, n)
        place = (low[start] & _LOW).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1))))
        in_block = start[first] + np.repeat(np.array(places) - own, n)[first]
        found.append((in_block.astype(np.uint32), np.diff(np.append(first, len(start))).astype(np.uint16), (place[first] - start[first]).astype(np.uint16), mixed(h[place[first]])))
    return tuple(map(np.concatenate, zip(*found)))  # keys are hashes again: the smallest ones, spread over all ranges


def _named(raw: bytes, at: np.ndarray, n: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64 and 32 bits of the n strings from each of the places on, and where they start."""
    found = [(np.empty(0, np.uint64), np.empty(0, np.uint32), np.empty(0, np.int64))]
    for k in range(0, len(at), 1024):
        lengths = n[k : k + 1024] + length - 1
        h = _hashes(np.frombuffer(b"".join(raw[s:e] for s, e in zip(at[k : k + 1024].tolist(), (at[k : k + 1024] + lengths).tolist())), np.uint8))
        first = runs(starts_of(lengths)[:-1], n[k : k + 1024])
        a, b = np.zeros(len(first), np.uint64), np.zeros(len(first), np.uint64)
        for step in [*range(0, length - ANCHOR, ANCHOR), length - ANCHOR]:
            own = h[first + step]
            a, b = mixed(a * _A + own), mixed(b * _B + (own ^ _A))
        found.append((a, (b >> np.uint64(32)).astype(np.uint32), runs(at[k : k + 1024], n[k : k + 1024])))
    return tuple(map(np.concatenate, zip(*found)))


def _by_name(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of names and where each different one starts in it."""
    order = np.lexsort((b, a))
    return order, np.flatnonzero(np.concatenate(([True], (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])))[: len(a)])


def _crowd(a: np.ndarray, b: np.ndarray, n_parts: int) -> dict[int, tuple]:
    """What a block sends to each range of the names of its strings with crowded anchors: each once, and whether it is there twice."""
    order, first = _by_name(a, b)
    twice = np.diff(np.append(first, len(order))) > 1
    one = order[first]
    ends = in_ranges(a[one], n_parts)
    return {p: (pack_sorted(a[one[s:e]]), b[one[s:e]].astype("<u4").tobytes(), packed(np.packbits(twice[s:e]).tobytes())) for p, (s, e) in enumerate(zip(ends, ends[1:])) if s < e}


def _met(crowds: list) -> list[bytes]:
    """Per block the names that are there twice or that other blocks have, too."""
    a = [unpack_sorted(c[0]) for c in crowds]
    sizes = list(map(len, a))
    names = np.empty(sum(sizes), _NAME)
    names["a"], names["b"] = np.concatenate(a), np.concatenate([np.frombuffer(c[1], "<u4") for c in crowds])
    twice = np.concatenate([np.unpackbits(np.frombuffer(unpacked(c[2]), np.uint8), count=n).astype(bool) for c, n in zip(crowds, sizes)])
    order, first = _by_name(names["a"], names["b"])
    n = np.diff(np.append(first, len(order)))
    shared = np.zeros(len(order), bool)
    shared[order] = np.repeat(n > 1, n)
    ends = starts_of(sizes)
    return [names[s:e][(shared | twice)[s:e]].tobytes() for s, e in zip(ends, ends[1:])]


SPANS, SUSPECTS, _SETTLED = b"s", b"n", (1 << 32) - 1
_NAME = np.dtype([("a", "<u8"), ("b", "<u4")])


def _run(docs: DataFrame, length: int, row, arrow: pa.Schema, schema: str) -> DataFrame:
    if not 2 * ANCHOR <= length < 1 << 15:
        raise ValueError(f"strings have {2 * ANCHOR} to {(1 << 15) - 1} bytes")

    def prepare(ids, texts):
        return ids, texts, _segments(texts, length)

    def chosen_of(state, known):
        start, n, lead, key = state[2]
        near = np.minimum(np.searchsorted(known, key), len(known) - 1)
        return start.astype(np.int64), n.astype(np.int64), lead, key, known[near] == key, near

    def emit(state, known, crowded, n_parts):
        raw, out = b"".join(state[1]), {}
        start, n, lead, key, chosen, near = chosen_of(state, known)
        hot = chosen & crowded[near]
        chosen &= ~hot
        for s, m, k, a in zip(*(x[chosen].tolist() for x in (start, n, key, lead))):
            out.setdefault(k, {}).setdefault((raw[s : s + m + length - 1], a), []).append(s)
        parts: dict[int, list] = {}
        for k, segments in out.items():
            parts.setdefault(range_of(k, n_parts), []).append((k, [(text, a, np.array(at, "<u4").tobytes()) for (text, a), at in segments.items()]))
        crowds = _crowd(*_named(raw, start[hot], n[hot], length)[:2], n_parts)
        for p in parts.keys() | crowds.keys():
            yield p, packed(pickle.dumps((parts.get(p, []), crowds.get(p))), 3)

    def resolve(sent):
        groups: dict[int, dict[tuple[bytes, int], list]] = {}
        spans: list[list[np.ndarray]] = [[] for _ in sent]
        crowds = {}
        for k, (_, data) in enumerate(sent):
            segments_of, crowd = pickle.loads(unpacked(data))
            if crowd:
                crowds[k] = crowd
            for key, segments in segments_of:
                own = groups.setdefault(key, {})
                for text, lead, at in segments:
                    own.setdefault((text, lead), []).append((k, np.frombuffer(at, "<u4").astype(np.int64)))
        for k, names in zip(crowds, _met(list(crowds.values())) if crowds else []):
            if names:
                yield sent[k][0], SUSPECTS + packed(names)

        def answer(holders, lo, hi):
            for k, places in holders:
                spans[k].append(np.column_stack([places + lo, places + hi]))

        def settled(own):
            """Answers equal segments: every string in them repeats.  False if there is nothing else to compare."""
            for (text, _), holders in own.items():
                if len(holders) > 1 or len(holders[0][1]) > 1:
                    answer(holders, 0, len(text) - length + 1)
            return len(own) > 1

        def divided(own, lo, hi):
            """A group of at most SORTED bytes, or its parts: strings whose anchor is lo .. hi - 1 bytes in share more than the anchor, by which they part."""
            if not settled(own):
                return
            if hi - lo <= 1 or sum(len(text) for text, _ in own) <= SORTED:
                yield own
                return
            middle = (lo + hi) // 2
            for a, b in ((lo, middle), (middle, hi)):
                parts: dict[bytes, dict] = {}
                for (text, lead), holders in own.items():
                    first, end = max(0, lead - b + 1), min(len(text) - length + 1, lead - a + 1)
                    if first < end:
                        core = text[lead - a : lead - b + 1 + length]
                        parts.setdefault(core, {}).setdefault((text[first : end - 1 + length], lead - first), []).extend((k, at + first) for k, at in holders)
                for part in parts.values():
                    yield from divided(part, a, b)

        def compared(batch):
            text = np.frombuffer(b"".join(t + _BREAK for (t, _), _ in batch), np.uint8)
            ends = starts_of([len(t) + 1 for (t, _), _ in batch])
            start = np.zeros(len(text) + 1, np.int64)
            start[ends[:-1]] += 1
            start[ends[1:] - length] -= 1  # the last string starts `length` before the break
            twice = repeated_starts(text, np.cumsum(start)[:-1] > 0, length)
            edge = np.flatnonzero(np.diff(np.concatenate(([False], twice, [False])).astype(np.int8)))
            which = np.searchsorted(ends, edge[::2], "right") - 1
            for lo, hi, w in zip(edge[::2], edge[1::2], which):
                answer(batch[w][1], lo - ends[w], hi - ends[w])

        batch, size = [], 0
        for own in groups.values():
            for part in divided(own, 0, length - ANCHOR + 1):
                batch += part.items()
                size += sum(len(text) for text, _ in part)
                if size > SORTED:  # parts don't share strings, so they may be sorted apart
                    compared(batch)
                    batch, size = [], 0
        if batch:
            compared(batch)
        for (block, _), found in zip(sent, spans):
            if found:
                yield block, SPANS + packed(np.concatenate(found).astype("<u4").tobytes())

    def recheck(state, known, crowded, answers, n_parts):
        """Of the strings with crowded anchors whose names repeat the bytes; those that repeat in the block are settled here."""
        raw = b"".join(state[1])
        start, n, _, _, chosen, near = chosen_of(state, known)
        hot = chosen & crowded[near]
        a, b, at = _named(raw, start[hot], n[hot], length)
        suspects = np.zeros(0, _NAME)
        for data in answers:
            if data[:1] == SUSPECTS:
                suspects = np.concatenate([suspects, np.frombuffer(unpacked(data[1:]), _NAME)])
        names = np.empty(len(a), _NAME)
        names["a"], names["b"] = a, b
        places: dict[bytes, list] = {}
        for s in at[np.isin(names, suspects)].tolist() if len(suspects) else []:
            places.setdefault(raw[s : s + length], []).append(s)
        again = np.unique(np.array([s for x in places.values() if len(x) > 1 for s in x], np.int64))
        edge = np.flatnonzero(np.diff(again) != 1)
        own = np.column_stack([again[np.append(0, edge + 1)], again[np.append(edge, len(again) - 1)] + 1]) if len(again) else np.empty((0, 2), np.int64)
        parts: dict[int, list] = {}
        for text, x in places.items():
            parts.setdefault(range_of(xxhash.xxh3_64_intdigest(text), n_parts), []).append((text, x[0] if len(x) == 1 else _SETTLED))
        for p, found in parts.items():  # the block's own spans come back with an answer
            yield p, packed(pickle.dumps((b"".join(x[0] for x in found), [x[1] for x in found], own.astype("<u4").tobytes())), 3)
            own = own[:0]

    def confirm(sent):
        holders: dict[bytes, list] = {}
        spans: list[list[np.ndarray]] = [[] for _ in sent]
        for k, (_, data) in enumerate(sent):
            texts, places, own = pickle.loads(unpacked(data))
            spans[k].append(np.frombuffer(own, "<u4").reshape(-1, 2).astype(np.int64))
            for n, place in enumerate(places):
                holders.setdefault(texts[n * length : (n + 1) * length], []).append((k, place))
        for x in holders.values():
            for k, place in x if len(x) > 1 else ():
                if place != _SETTLED:
                    spans[k].append(np.array([[place, place + 1]]))
        for (block, _), found in zip(sent, spans):
            if sum(map(len, found)):
                yield block, SPANS + packed(np.concatenate(found).astype("<u4").tobytes())

    def finish(state, answers):
        ids, texts, _ = state
        ends = starts_of(list(map(len, texts)))
        cover = np.zeros(int(ends[-1]) + 1, np.int64)
        for a in answers:
            if a[:1] == SPANS:
                span = np.frombuffer(unpacked(a[1:]), "<u4").reshape(-1, 2).astype(np.int64)
                np.add.at(cover, span[:, 0], 1)
                np.add.at(cover, span[:, 1] + length - 1, -1)
        gone = np.cumsum(cover) > 0
        rows = []
        for i, text, s in zip(ids, texts, ends):
            out = gone[s : s + len(text)]
            n = int(out.sum())
            spans = int(out[0]) + int((out[1:] & ~out[:-1]).sum()) if n else 0
            rows.append(row(i, len(text), n, spans, np.frombuffer(text, np.uint8)[~out].tobytes() if n else text))
        return rows

    return exchanged(docs, prepare, [lambda state, _: state[2][3]], emit, resolve, finish, arrow, schema, CROWDED, recheck, confirm)


def remove_repeated(docs: DataFrame, length: int = 400) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): kept holds the remaining bytes, which may cut a character."""
    arrow = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])
    return _run(docs, length, lambda *x: x, arrow, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def digests(docs: DataFrame, length: int = 400) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256)."""
    arrow = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])
    return _run(docs, length, lambda i, n, gone, spans, kept: (i, n, gone, spans, hashlib.sha256(kept).hexdigest()), arrow, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
