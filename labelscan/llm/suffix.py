"""Removing repeated passages with suffix arrays that are built by external induced sorting.

A byte goes if a string of ``length`` bytes over it also starts in a document with a smaller identifier.

*Shards.*  Every window of ``length`` bytes has one fingerprint, the least hash of its 24-byte grams, a function of its bytes
alone; so all occurrences of a repeated string have the same fingerprint.  A first pass counts the texts of each fingerprint
(equal texts once); those that only one text has are dropped.  For the rest, the run of windows around a fingerprint (a segment)
goes to the shard of its fingerprint.  Equal segments are combined before they are sent, and a shard holds each segment
once, with its smallest document.  The number of shards follows the bytes to be sorted (``SHARD_BYTES`` each).

*Suffix arrays.*  A shard's segments form one string, whose suffixes are sorted by induction: substrings between
leftmost S-suffixes (LMS) are sorted by a first induction and named, the string of names is sorted (the recursion, by doubling
of names, and only as deep as ``length`` bytes need), and a second induction sorts all suffixes from the LMS ones.
Tuples (position, common prefix with the one before) travel through priority queues ordered by first byte and time of
arrival, which keep to a memory bound, put what exceeds it on disk and are read back in waves.  The common prefix of induced
suffixes is one more than the least along the way between their successors.  Suffixes that share ``length`` bytes are
neighbours; the least document of each such group is what decides.  Text, types, LMS positions and least documents are
memory-mapped files where they are large; only the names of the LMS substrings are sorted in memory.

Edge cases: null and empty texts and those shorter than ``length`` bytes lose nothing; repeated strings within one document
stay; a string that several smaller documents have, or one at several places, counts once; rows that repeat an identifier are separate and don't count against each other; a null identifier is never
smaller and loses nothing; texts of any length are cut into segments as they come; an empty table gives an empty result; columns
besides identifier and text are not looked at.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Bits, Scratch, bitmap

LENGTH = 50
GRAM = 24
#: About how many bytes of segments a shard has.
SHARD_BYTES = 16 << 20
#: Bytes of queue entries that one shard holds in memory, and size from which a shard's arrays are mapped.
MEMORY = 64 << 20
NONE = np.iinfo(np.int64).max
WAVE = 1 << 18


# -- fingerprints -----------------------------------------------------------------------------------------------------


#: Texts are hashed in blocks of about this many bytes.
BLOCK = 1 << 16


def gram_keys(data: np.ndarray) -> np.ndarray:
    """Hashes of all grams; the lowest six bits are the place's, so that equal grams of a window differ."""
    n = len(data) - GRAM + 1
    eight = np.array(np.ndarray((len(data) - 7,), "<u8", data, 0, (1,)))
    h = eight[:n] * np.uint64(0x9E3779B97F4A7C15)
    for k in range(8, GRAM, 8):
        h ^= h >> np.uint64(31)
        h ^= (eight[k : n + k] + np.uint64(0x632BE59BD9B4E019)) * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x165667B19E3779F9)
    h ^= h >> np.uint64(32)
    h &= np.uint64(2**64 - 64)
    h |= np.arange(n, dtype=np.uint64) & np.uint64(63)
    return h


def runs_of(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(fingerprint, text, first window, last window) of the runs of windows whose least gram is the same."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    if len(data) < length:
        return tuple(np.empty(0, np.int64) for _ in range(4))
    low, width, w = gram_keys(data), 1, length - GRAM + 1
    while width < w:  # least of the next ``w`` grams, by doubling
        step = min(width, w - width)
        low = np.minimum(low[: len(low) - step], low[step:])
        width += step
    ends = np.cumsum([len(t) for t in texts])
    starts = ends - np.array([len(t) for t in texts])
    new = np.empty(len(low), bool)
    new[0] = True
    np.not_equal(low[1:], low[:-1], out=new[1:])
    new[starts[starts < len(low)]] = True
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(low)) - 1
    owner = np.searchsorted(ends, first, side="right")
    last = np.minimum(last, ends[owner] - length)  # windows over the end of a text are none
    ok = first <= last
    first, last, owner = first[ok], last[ok], owner[ok]
    return (low[first] >> np.uint64(6)).view(np.int64), owner, first - starts[owner], last - starts[owner]


def blocks(batch: pa.RecordBatch, wanted: Bits, length: int) -> Iterator[tuple[list[int], list[bytes]]]:
    """Identifiers and texts of a batch (identifier, text), those too short or not wanted left out, in blocks."""
    docs, texts, size = [], [], 0
    ids = batch.column(0).to_numpy()
    hit = np.flatnonzero(wanted.has(ids))
    for doc, t in zip(ids[hit].tolist(), batch.column(1).take(pa.array(hit))):
        raw = t.as_py()
        if len(raw) >= length:
            docs.append(doc)
            texts.append(raw)
            size += len(raw)
            if size >= BLOCK:
                yield docs, texts
                docs, texts, size = [], [], 0
    if docs:
        yield docs, texts


def fingerprints(length: int, wanted):
    """(fingerprint, number of texts that have it) of the wanted documents, added up as far as memory goes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = Bits(wanted.value)

        def out() -> pa.RecordBatch:
            f, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(f), pa.array(n.astype(np.int64))], ["f", "n"])

        held, size = [], 0
        for batch in batches:
            for _, texts in blocks(batch, bits, length):
                f, owner, _, _ = runs_of(texts, length)
                order = np.lexsort((f, owner))
                f, owner = f[order], owner[order]
                held.append(f[np.concatenate([[True], (f[1:] != f[:-1]) | (owner[1:] != owner[:-1])])])
                size += len(held[-1])
                if size >= 2_000_000:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    return run


SEGMENTS = "f long, h long, doc long, k long, at int, low long, c long, bytes binary"


def segments(length: int, wanted, shared):
    """SEGMENTS: a text's runs of windows whose fingerprint is shared.

    ``h`` is a hash of the segment's bytes, ``k`` of the text, ``at`` where it starts.  The first of equal segments of a stretch of input carries
    the ``bytes``, how many there are (``c``) and their least document (``low``).
    """
    import xxhash

    types = [pa.int64()] * 4 + [pa.int32(), pa.int64(), pa.int64(), pa.binary()]
    names = [x.split()[0] for x in SEGMENTS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, several = Bits(wanted.value), Bits(shared.value)
        cols: list[list] = [[] for _ in types]
        known: dict[tuple[int, bytes], int] = {}
        for batch in batches:
            for docs, texts in blocks(batch, bits, length):
                f, owner, first, last = runs_of(texts, length)
                hit = several.has(f)
                keys = [xxhash.xxh3_64_intdigest(t) - (1 << 63) for t in texts]
                for x, t, a, b in zip(f[hit].tolist(), owner[hit].tolist(), first[hit].tolist(), last[hit].tolist()):
                    piece, doc = texts[t][a : b + length], docs[t]
                    n = len(cols[0])
                    at = known.setdefault((x, piece), n)
                    if at < n:
                        cols[5][at] = min(cols[5][at], doc)
                        cols[6][at] += 1
                        row = (x, cols[1][at], doc, keys[t], a, None, None, None)
                    else:
                        row = (x, xxhash.xxh3_64_intdigest(piece) - (1 << 63), doc, keys[t], a, doc, 1, piece)
                    for c, v in zip(cols, row):
                        c.append(v)
                if len(cols[0]) >= 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)
                    cols = [[] for _ in types]
                    known.clear()
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

    return run


# -- external induced sorting -----------------------------------------------------------------------------------------


class Queue:
    """A priority queue of (position, common prefix) by first byte, then order of arrival; its excess lies on disk."""

    def __init__(self, keys: int, folder: str, memory: int = MEMORY):
        self.parts: list[list] = [[] for _ in range(keys)]
        self.folder, self.memory, self.held, self.files = folder, memory, 0, 0

    def push(self, key: int, pos: np.ndarray, lcp: np.ndarray) -> None:
        self.parts[key].append((pos, lcp))
        self.held += pos.nbytes + lcp.nbytes
        if self.held > self.memory:
            self.spill()

    def spill(self) -> None:
        """Writes the entries held in memory, one file, keys one after another."""
        name = os.path.join(self.folder, f"{id(self)}-{self.files}")
        self.files += 1
        with open(name, "wb") as out:
            for key, parts in enumerate(self.parts):
                own = [p for p in parts if not isinstance(p[0], str)]
                if own:
                    pos, lcp = (np.concatenate([p[i] for p in own]) for i in (0, 1))
                    at = out.tell()
                    out.write(pos.tobytes())
                    out.write(lcp.tobytes())
                    self.parts[key] = [p for p in parts if isinstance(p[0], str)] + [(name, at, len(pos), pos.dtype)]
        self.held = 0

    def read(self, p: tuple) -> tuple[np.ndarray, np.ndarray]:
        if not isinstance(p[0], str):
            self.held -= p[0].nbytes + p[1].nbytes
            return p
        name, at, n, kind = p
        with open(name, "rb") as f:
            f.seek(at)
            return np.frombuffer(f.read(n * kind.itemsize), kind), np.frombuffer(f.read(n), np.uint8)

    def pop(self, key: int, back: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Takes the entries of a key that have arrived, in order (or the last wave first), in waves of about WAVE entries."""
        parts, self.parts[key] = self.parts[key], []
        wave: list[tuple] = []
        size = 0
        for p in reversed(parts) if back else parts:
            wave.append(self.read(p))
            size += len(wave[-1][0])
            if size >= WAVE:
                yield tuple(np.concatenate(x) for x in zip(*(reversed(wave) if back else wave)))
                wave, size = [], 0
        if wave:
            yield tuple(np.concatenate(x) for x in zip(*(reversed(wave) if back else wave)))


def range_least(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Least of values[first..last], by a table of doubled widths."""
    width = last - first + 1
    level = np.maximum(np.frexp(width.astype(np.float64))[1] - 1, 0)
    out = np.empty(len(first), values.dtype)
    table, k = values, 0
    top = int(level.max()) if len(level) else -1
    while k <= top:
        own = level == k
        if own.any():
            out[own] = np.minimum(table[first[own]], table[last[own] - (1 << k) + 1])
        if k < top:
            table = np.minimum(table[: len(table) - (1 << k)], table[1 << k :])
        k += 1
    return out


def room(folder: str, name: str, n: int, kind, memory: int) -> np.ndarray:
    """An array of zeros, in a file where it exceeds the memory."""
    return np.memmap(os.path.join(folder, name), kind, "w+", shape=(n,)) if n * np.dtype(kind).itemsize > memory else np.zeros(n, kind)


class Inducer:
    """Sorts the suffixes of ``text`` (bytes, 0 ends a segment) by two passes of induction from sorted LMS suffixes."""

    def __init__(self, text: np.ndarray, folder: str, length: int = LENGTH, memory: int = MEMORY):
        self.text, self.folder, self.length, self.memory = text, folder, length, memory
        n = len(text)
        self.word = np.int32 if n < 2**31 else np.int64
        self.small = room(folder, "small", n, bool, memory)
        # types from the end, block by block; equal bytes have the type of the next that differs
        following, kind = -1, False
        for start in reversed(range(0, n, WAVE)):
            own = text[start : start + WAVE].astype(np.int16)
            step = np.sign(np.append(own[1:], following) - own)
            at = np.where(step != 0, np.arange(len(own)), len(own))
            at = np.minimum.accumulate(at[::-1])[::-1]
            self.small[start : start + WAVE] = np.append(step > 0, kind)[at]
            following, kind = own[0], self.small[start]
        found = [start + 1 + np.flatnonzero(self.small[start + 1 : start + 1 + WAVE] & ~self.small[start : start + len(self.small[start + 1 : start + 1 + WAVE])]) for start in range(0, n - 1, WAVE)]
        self.lms = room(folder, "lms", sum(map(len, found)), self.word, memory)
        if found:
            np.concatenate(found, out=self.lms, casting="unsafe")

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common prefixes, at most ``length``, by comparing."""
        out, n = np.zeros(len(a), np.uint8), len(self.text)
        for start in range(0, len(a), WAVE):
            live = np.arange(start, min(start + WAVE, len(a)))
            for k in range(self.length):
                x, y = a[live] + k, b[live] + k
                ok = (x < n) & (y < n)
                ok[ok] = self.text[x[ok]] == self.text[y[ok]]
                live = live[ok]
                if not len(live):
                    break
                out[live] += 1
        return out

    def sorted_lms(self) -> np.ndarray:
        """LMS positions in the order of their suffixes (as deep as ``length`` bytes)."""
        n = len(self.lms)
        if n < 2:
            return self.lms
        by_byte = self.lms[np.argsort(self.text[self.lms], kind="stable")]
        order, at = room(self.folder, "order", n, self.word, self.memory), n
        for p, _ in self.induce(by_byte, False):
            p = p[self.small[p] & ~self.small[p - 1] & (p > 0)]
            order[at - len(p) : at] = p[::-1]
            at -= len(p)
        del by_byte
        # name the LMS substrings: equal ones have equal names
        reduced, name, last = room(self.folder, "reduced", n, np.int64, self.memory), 0, None
        for a in range(0, n, WAVE):
            own = order[a : a + WAVE]
            index = np.searchsorted(self.lms, own)
            size = np.where(index + 1 < n, self.lms[np.minimum(index + 1, n - 1)], len(self.text) - 1) - own
            pos, sizes = (own, size) if last is None else (np.append(last[0], own), np.append(last[1], size))
            same = sizes[1:] == sizes[:-1]
            live, k = np.flatnonzero(same), 0
            while len(live):
                alike = self.text[pos[live + 1] + k] == self.text[pos[live] + k]
                same[live[~alike]] = False
                live = live[alike]
                k += 1
                live = live[sizes[live] >= k]
            names = name + np.cumsum(~same if last is not None else np.append(True, ~same))
            reduced[index] = names
            name, last = names[-1], (own[-1:], size[-1:])
        # the string of names, sorted by doubling; each name stands for two bytes or more
        depth, key, index = 1, room(self.folder, "key", n, np.int64, self.memory), None
        while name < n and depth * 2 <= self.length + 2 * 2:
            for a in range(0, n, WAVE):
                own = reduced[a : a + WAVE] * (n + 2)
                after = reduced[a + depth : a + depth + len(own)]
                own[: len(after)] += after
                key[a : a + WAVE] = own
            index = np.argsort(key, kind="stable")
            name, last = 0, -1
            for a in range(0, n, WAVE):
                own = key[index[a : a + WAVE]]
                names = name + np.cumsum(np.append(own[0] != last, own[1:] != own[:-1]))
                reduced[index[a : a + WAVE]] = names
                name, last = names[-1], own[-1]
            depth *= 2
        if index is None:
            index = np.argsort(reduced, kind="stable")
        for a in range(0, n, WAVE):
            order[a : a + WAVE] = self.lms[index[a : a + WAVE]]
        return order

    def suffixes(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(positions, common prefixes with the one emitted before), the largest suffix first."""
        yield from self.induce(self.sorted_lms(), True)

    def spread(self, pos: np.ndarray, lcp: np.ndarray, queue: Queue, small: bool, since: np.ndarray, carry: bool) -> None:
        """Sends the predecessors of a wave to their queues, in order."""
        least = np.uint8(self.length)
        j = np.flatnonzero(pos > 0)
        j = j[self.small[pos[j] - 1] == small]
        before = pos[j] - 1
        byte = self.text[before]
        order = np.argsort(byte, kind="stable")
        byte, j, before = byte[order], j[order], before[order]
        cuts = np.flatnonzero(np.concatenate([[True], byte[1:] != byte[:-1]])) if len(byte) else np.empty(0, np.int64)
        if carry:
            values = np.empty(len(j), np.uint8)
            inner = np.ones(len(j), bool)
            inner[cuts] = False
            inner = np.flatnonzero(inner)
            values[inner] = range_least(lcp, j[inner - 1] + 1, j[inner])
            values[cuts] = np.minimum(range_least(lcp, np.zeros(len(cuts), np.int64), j[cuts]), since[byte[cuts]])
            values = np.minimum(values.astype(np.int16) + 1, least).astype(np.uint8)
            whole = lcp.min() if len(lcp) else least
            since[:] = np.minimum(since, whole)
            ends = np.append(cuts[1:], len(j)) - 1 if len(cuts) else cuts
            tail = j[ends] + 1
            rest = np.full(len(ends), least, np.uint8)
            more = tail < len(lcp)
            rest[more] = range_least(lcp, tail[more], np.full(more.sum(), len(lcp) - 1))
            since[byte[ends]] = rest
        else:
            values = np.zeros(len(j), np.uint8)
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(j)]):
            queue.push(int(byte[a]), before[a:b], values[a:b])

    def induce(self, seeds: np.ndarray, carry: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        n, least = len(self.text), np.uint8(self.length)
        seed_byte = self.text[seeds]
        bounds = np.searchsorted(seed_byte, np.arange(257))
        seed_lcp = np.zeros(len(seeds), np.uint8)
        if carry and len(seeds):
            seed_lcp[1:] = self.common(seeds[:-1], seeds[1:])
        large, done = Queue(256, self.folder, self.memory), Queue(256, self.folder, self.memory)
        since = np.full(256, 0, np.uint8)
        # the last suffix alone follows from the end of the text
        if not self.small[n - 1]:
            large.push(int(self.text[n - 1]), np.array([n - 1], self.word), np.zeros(1, np.uint8))
        for c in range(256):
            last = None
            while True:
                before = last
                for pos, lcp in large.pop(c):
                    if last is None:
                        lcp = lcp.copy()
                        lcp[0] = 0  # the first of its byte has nothing in common with what lies before
                    self.spread(pos, lcp, large, False, since, carry)
                    done.push(c, pos, lcp)
                    last = pos[-1:]
                if last is before:
                    break
            own, own_lcp = seeds[bounds[c] : bounds[c + 1]], seed_lcp[bounds[c] : bounds[c + 1]].copy()
            if len(own):
                if carry:
                    own_lcp[0] = self.common(last, own[:1])[0] if last is not None else 0
                self.spread(own, own_lcp, large, False, since, carry)
        small = Queue(256, self.folder, self.memory)
        since = np.full(256, 0, np.uint8)
        for c in range(255, -1, -1):
            last = None
            while True:
                before = last
                for pos, lcp in small.pop(c):
                    if last is None:
                        lcp = lcp.copy()
                        lcp[0] = 0
                    self.spread(pos, lcp, small, True, since, carry)
                    yield pos, lcp
                    last = pos[-1:]
                if last is before:
                    break
            for k, (pos, lcp) in enumerate(done.pop(c, back=True)):
                # turned round: the value of an entry is now the one of its successor
                turned = pos[::-1]
                values = np.empty(len(pos), np.uint8)
                values[1:] = lcp[:0:-1]
                values[0] = (self.common(last, turned[:1])[0] if k == 0 else link) if last is not None and carry else 0
                link = lcp[0]
                self.spread(turned, values, small, True, since, carry)
                yield turned, values
                last = turned[-1:]


def least_documents(text: np.ndarray, ends: np.ndarray, docs: np.ndarray, folder: str, length: int = LENGTH, memory: int = MEMORY) -> Iterator[np.ndarray]:
    """For each piece of the text (its 0 byte at ``ends``), for each of its windows, the least document of any piece with an equal window."""
    least = room(folder, "least", len(text), np.int64, memory)
    held: list[np.ndarray] = []

    def settle(groups: np.ndarray, firsts: np.ndarray) -> None:
        piece = np.searchsorted(ends, groups)
        # a window over the end of a piece is none, also where a text holds zero bytes
        own = np.where(groups <= ends[piece] - length, docs[piece], NONE)
        least[groups] = np.repeat(np.minimum.reduceat(own, firsts), np.diff(np.append(firsts, len(groups))))

    for pos, lcp in Inducer(text, folder, length, memory).suffixes():
        new = np.flatnonzero(lcp < length)
        if not len(new):
            held.append(pos)
            continue
        held.append(pos[: new[0]])
        before = np.concatenate(held)
        if len(before):
            settle(before, np.zeros(1, np.int64))
        if len(new) > 1:
            settle(pos[new[0] : new[-1]], new[:-1] - new[0])
        held = [pos[new[-1] :]]
    before = np.concatenate(held) if held else np.empty(0, np.int64)
    if len(before):
        settle(before, np.zeros(1, np.int64))
    start = 0
    for end in ends.tolist():
        yield np.asarray(least[start : end - length + 1])
        start = end + 1


RUNS = "f long, h long, from int, to int, least long"


def shard_runs(length: int, memory: int = MEMORY):
    """RUNS of a shard's segments (f, h, low, c, bytes), sorted by f: windows of a segment that documents before its own have, with the least.

    Where a segment occurs several times, all of it counts for those after the least.  A segment that is the only one of its
    fingerprint shares no window with another, so it isn't sorted.
    """
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]
    names = [x.split()[0] for x in RUNS.split(", ")]

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(map(list, zip(*rows)), types)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads, held, before = [], None, None

        def settle(batch: pa.RecordBatch, after: int | None) -> pa.RecordBatch | None:
            """Writes down segments that have company (``before`` and ``after`` are the neighbours' fingerprints), answers for the others."""
            f, h, low, c = (batch.column(k).to_numpy() for k in range(4))
            size = pc.binary_length(batch.column(4)).to_numpy().astype(np.int64)
            next_ = np.append(f[1:] == f[:-1], after is not None and f[-1] == after)
            last = np.append(before is not None and f[0] == before, f[1:] == f[:-1])
            alone = ~(next_ | last)
            if not alone.all():
                heads.append(tuple(x[~alone] for x in (f, h, low, c, size)))
                text.write(b"\0".join([*batch.column(4).filter(pa.array(~alone)).to_pylist(), b""]))
            told = np.flatnonzero(alone & (c > 1))
            if len(told):
                return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((f[told], h[told], np.zeros(len(told), np.int32), size[told] - length, low[told]), types)], names)
            return None

        with tempfile.TemporaryDirectory() as folder:
            path = os.path.join(folder, "text")
            with open(path, "wb") as text:
                for batch in batches:
                    if not batch.num_rows:
                        continue
                    if held is not None:
                        if (told := settle(held, batch.column(0)[0].as_py())) is not None:
                            yield told
                        before = held.column(0)[-1].as_py()
                    held = batch
                if held is not None and (told := settle(held, None)) is not None:
                    yield told
            if not heads:
                return
            f, h, low, c, sizes = (np.concatenate(x) for x in zip(*heads))
            heads.clear()
            ends = np.cumsum(sizes + 1) - 1
            data = np.memmap(path, np.uint8, "r") if ends[-1] >= memory else np.fromfile(path, np.uint8)
            rows: list[tuple] = []
            for x, y, own, n, found in zip(f.tolist(), h.tolist(), low.tolist(), c.tolist(), least_documents(data, ends, low, folder, length, memory)):
                if n > 1:
                    rows.append((x, y, 0, len(found) - 1, own))
                if (found < own).any():
                    cuts = [0, *(np.flatnonzero(found[1:] != found[:-1]) + 1).tolist(), len(found)]
                    rows += [(x, y, a, b - 1, int(found[a])) for a, b in zip(cuts, cuts[1:]) if found[a] < own]
                if len(rows) >= 100_000:
                    yield out(rows)
                    rows = []
            if rows:
                yield out(rows)

    return run


def having(wanted):
    """The rows (identifier, text) whose identifier may be wanted, with a hash of the text."""
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = Bits(wanted.value)
        for batch in batches:
            hit = batch.filter(pa.array(bits.has(batch.column(0).to_numpy())))
            keys = [xxhash.xxh3_64_intdigest(t.as_py()) - (1 << 63) for t in hit.column(1)]
            yield pa.RecordBatch.from_arrays([hit.column(0), pa.array(keys, pa.int64()), hit.column(1)], ["doc", "k", "data"])

    return run


def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, whole_sha256, n_removed, n_spans, kept_sha256, spans) from (doc, text, intervals)."""
    for batch in batches:
        rows = []
        for doc, text, ranges in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
            raw, spans = text.as_py(), []
            for r in sorted(ranges, key=lambda r: r["a"]):
                if spans and r["a"] <= spans[-1]["b"]:
                    spans[-1]["b"] = max(spans[-1]["b"], r["b"])
                else:
                    spans.append(dict(r))
            kept, at = sha256(), 0
            for s in spans:
                kept.update(raw[at : s["a"]])
                at = s["b"]
            kept.update(raw[at:])
            rows.append({"doc": doc, "whole": sha256(raw).hexdigest(), "n_removed": sum(s["b"] - s["a"] for s in spans), "n_spans": len(spans), "kept_sha256": kept.hexdigest(), "spans": spans})
        yield pa.RecordBatch.from_pylist(rows, CUT)


CUT = pa.schema([("doc", pa.int64()), ("whole", pa.string()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))])


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, memory: int = MEMORY, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans`` (removed byte ranges) of every row."""
    spark = docs.sparkSession
    scratch, share = Scratch(spark, "suffix"), spark.sparkContext.broadcast
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("data"))
    rows = scratch.save(own.select("doc_id", F.octet_length("data").cast("long").alias("n_bytes"), F.sha2("data", 256).alias("sha")), "rows")
    first = scratch.save(rows.groupBy("sha").agg(F.min("doc_id").alias("first"), F.max("n_bytes").alias("size")), "first")

    texts = own.filter(F.col("doc_id").isNotNull() & (F.octet_length("data") >= length))
    wanted = share(bitmap(first.filter(f"first is not null and size >= {length}"), "first"))
    counts = texts.mapInArrow(fingerprints(length, wanted), "f long, n long").groupBy("f").agg(F.sum("n").alias("n")).filter("n > 1").select("f")
    counts = scratch.save(counts, "shared")
    shared = share(bitmap(counts, "f"))
    found = scratch.save(texts.mapInArrow(segments(length, wanted, shared), SEGMENTS), "segments")
    scratch.drop("shared")

    pieces = found.filter("bytes is not null").select("f", "h", "low", "c", "bytes")
    total = pieces.agg(F.coalesce(F.sum(F.octet_length("bytes") + 1), F.lit(0))).first()[0]
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // shard_bytes))
    once = pieces.repartition(shards, "f").groupBy("f", "h").agg(F.min("low").alias("low"), F.sum("c").alias("c"), F.first("bytes").alias("bytes")).sortWithinPartitions("f")
    runs = scratch.save(once.mapInArrow(shard_runs(length, memory), RUNS), "runs")
    hits = found.select("f", "h", "doc", "k", "at").join(runs, ["f", "h"]).filter("least < doc")
    ranges = hits.groupBy("doc", "k").agg(F.collect_list(F.struct((F.col("at") + F.col("from")).alias("a"), (F.col("at") + F.col("to") + length).alias("b"))).alias("ranges"))
    ranges = scratch.save(ranges, "ranges")
    scratch.drop("segments")
    scratch.drop("runs")
    hit = share(bitmap(ranges, "doc"))
    cuts = texts.mapInArrow(having(hit), "doc long, k long, data binary").join(ranges, ["doc", "k"]).select("doc", "data", "ranges")
    cuts = cuts.mapInArrow(cut, "doc long, whole string, n_removed long, n_spans long, kept_sha256 string, spans array<struct<a:int,b:int>>")
    cuts = scratch.save(cuts.dropDuplicates(["doc", "whole"]), "cuts")
    scratch.drop("ranges")

    out = rows.join(first.drop("size"), "sha").join(cuts, (F.col("doc_id") == F.col("doc")) & (F.col("sha") == F.col("whole")), "left")
    copy = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)) & (F.col("n_bytes") >= length)
    nothing = F.array().cast("array<struct<a:int,b:int>>")
    return out.select(
        "doc_id",
        "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        F.when(copy, F.array(F.struct(F.lit(0).alias("a"), F.col("n_bytes").cast("int").alias("b")))).otherwise(F.coalesce("spans", nothing)).alias("spans"),
    )
