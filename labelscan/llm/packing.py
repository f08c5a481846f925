"""Hierarchical multi-length packing of token sequences.

Documents (token ids and an end id) are routed to tiers of context sizes, powers of two up to the window.  A document
of a window or more gives whole windows first; what remains goes to the smallest tier that holds it.  Tiers are packed from
the largest down by best fit: a window opens with a document of its tier, gaps are filled with the longest fitting
documents of that and shorter tiers, and a gap that nothing fits is closed by cutting one document, whose rest stays in its
tier.  So windows are exactly full, whichever tier they belong to, and a full window is a power of two that needs no
padding.  Full windows of a tier are dealt into step groups of equal token counts.

Every task packs the documents of its own partition in bounded chunks, what a chunk leaves goes into the next, and
only the last few ids of a partition can be padded: no shuffle, no hot key, and a recomputed task gives the same rows.

Edge cases: a null text is an empty one and has the end id alone; a text with the string of an added token gets the ids that the
tokenizer itself gives; a document of any length is cut into windows as it comes; of equally long documents the one that came
last is taken first; repeated rows are packed each for itself; columns besides identifier and text are not looked at, whatever
their names; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 2048
TIERS = (2048, 1024, 512, 256)
#: Tokens of a step group, and about how many ids are packed at a time.
STEP_TOKENS = 16 * WINDOW
CHUNK_TOKENS = 1 << 20
#: The last ids of a partition go into powers of two down to this one, then into a padded sequence.
LEAST_TAIL = 32
END_ID = 1
CACHE = 200_000

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


def byte_bpe(json_path: str, ranks_path: str | None = None) -> Callable[[str], list[int]]:
    """An encoder with the ids of the tokenizer file.

    With ``ranks_path``, the same vocabulary as ranks, a faster library does the work.  A blank between two characters that
    aren't white space always starts a token, so words between such blanks are encoded once and remembered (in a bounded table).
    """
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(json_path)
    special = [token.content for token in plain.get_added_tokens_decoder().values()]
    whole = exact = lambda text: plain.encode(text, add_special_tokens=False).ids
    if ranks_path:
        import public_tokenizers
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

        def whole(text: str, slow=whole) -> list[int]:
            try:
                return fast.encode_ordinary(text)
            except BaseException as e:  # its regex engine gives up on extremely long runs of white space
                if isinstance(e, (KeyboardInterrupt, SystemExit)):
                    raise
                return slow(text)

    known: dict[str, list[int]] = {}

    def encode(text: str) -> list[int]:
        if any(token in text for token in special):
            return exact(text)
        first, *rest = text.split(" ")
        if not rest:
            return whole(text)
        if not first or first[-1].isspace():
            return whole(text)
        ids = list(whole(first))
        extend, get = ids.extend, known.get
        for w in rest:
            found = get(w)
            if found is None:
                if not w or w[0].isspace() or w[-1].isspace():
                    return whole(text)
                if len(known) >= CACHE:
                    known.clear()
                found = known[w] = whole(" " + w)
            extend(found)
        return ids

    return encode


class Packer:
    """Packs (doc_id, ids) into windows; ``out`` collects rows of SCHEMA."""

    def __init__(self, partition: int):
        self.base, self.n, self.out, self.steps = partition << 33, 0, [], dict.fromkeys((*TIERS, 0), 0)
        self.pool: list[list[tuple]] = [[] for _ in range(WINDOW)]
        self.mask, self.tokens = 0, 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        n, at = len(ids), 0
        while n - at >= WINDOW:
            self.close([(doc_id, ids, at, at + WINDOW)], WINDOW)
            at += WINDOW
        if at < n:
            self.put((doc_id, ids, at, n))

    def put(self, piece: tuple) -> None:
        n = piece[3] - piece[2]
        self.pool[n].append(piece)
        self.mask |= 1 << n
        self.tokens += n

    def take(self, most: int) -> tuple | None:
        """The longest waiting piece of at most so many ids."""
        fit = (self.mask & ((1 << (most + 1)) - 1)).bit_length() - 1
        if fit <= 0:
            return None
        piece = self.pool[fit].pop()
        if not self.pool[fit]:
            self.mask ^= 1 << fit
        self.tokens -= fit
        return piece

    def shortest(self) -> tuple:
        return self.take((self.mask & -self.mask).bit_length() - 1)

    def pack(self) -> None:
        """Packs while the pool fills windows; the rest waits."""
        for tier, below in zip(TIERS, (*TIERS[1:], 0)):
            while self.tokens >= tier and self.mask >> (below + 1):
                if (opening := self.take(tier)) is None:
                    break
                pieces, gap = [opening], tier - (opening[3] - opening[2])
                while gap:
                    piece = self.take(gap)
                    if piece is None:
                        doc_id, ids, a, b = self.shortest()
                        self.put((doc_id, ids, a + gap, b))
                        piece = (doc_id, ids, a, a + gap)
                    pieces.append(piece)
                    gap -= piece[3] - piece[2]
                self.close(pieces, tier)

    def finish(self) -> None:
        """The last pieces: powers of two, then one padded sequence."""
        self.pack()
        size = WINDOW
        while self.tokens:
            if self.tokens < size and size > LEAST_TAIL:
                size //= 2
                continue
            pieces, gap = [], min(size, self.tokens)
            while gap:
                piece = self.take(gap)
                if piece is None:
                    doc_id, ids, a, b = self.shortest()
                    self.put((doc_id, ids, a + gap, b))
                    piece = (doc_id, ids, a, a + gap)
                pieces.append(piece)
                gap -= piece[3] - piece[2]
            self.close(pieces, size if size in TIERS else 0)

    def close(self, pieces: list[tuple], tier: int) -> None:
        step = self.steps[tier] // (STEP_TOKENS // tier) if tier else 0
        self.steps[tier] += 1
        group = self.base + (step << 3) + (TIERS.index(tier) if tier else len(TIERS))
        at = 0
        for doc_id, ids, a, b in pieces:
            self.out.append((doc_id, a, b - a, zlib.crc32(ids[a:b].tobytes()), len(ids), self.base + self.n, at, tier or WINDOW, group))
            at += b - a
        self.n += 1

    def rows(self) -> pa.RecordBatch:
        columns = zip(*self.out) if self.out else ([] for _ in NAMES)
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(map(list, columns), TYPES)], NAMES)
        self.out = []
        return batch


NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
TYPES = [pa.int32() if x.endswith(" int") else pa.int64() for x in SCHEMA.split(", ")]


def packed(docs: DataFrame, encoder: Callable[[], Callable[[str], list[int]]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: SCHEMA.  ``encoder`` makes the text -> ids function in each task; the end id is appended here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = encoder(), Packer(TaskContext.get().partitionId())
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py() or "")
                ids = np.fromiter(ids, "<u4", len(ids))
                packer.add(doc_id, np.append(ids, np.uint32(END_ID)))
                if packer.tokens >= CHUNK_TOKENS:
                    packer.pack()
                if len(packer.out) >= 20_000:
                    yield packer.rows()
        packer.finish()
        yield packer.rows()

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, SCHEMA)
