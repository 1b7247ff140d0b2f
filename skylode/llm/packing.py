"""Hierarchical packing of token sequences into several context sizes."""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylode.llm.common import kept_in_worker, map_arrow, texts, tokenizer_text

CONTEXT = 2048
TIERS = (256, 512, 1024, 2048)
#: Tokens that a task holds and packs at a time.
WINDOW = 1 << 20
#: Tokens of a step group.
STEP = 32 * CONTEXT
#: The smallest sequence that the rest of a partition is cut to.
LEAST = 64
END = 1
OUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, context long, step_id long"


def token_encoder(spec_text: str):
    """text → ids, equal to those of the tokenizer file with this text, without added special tokens.

    The same merges are run by a faster library: the file's vocabulary in
    byte form gives the ranks. Special tokens that stand in a text are found
    in it, as the file's library does.
    """
    import json

    import tiktoken

    spec = json.loads(spec_text)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    byte_of = {chr(b if b in shown else next(rest)): b for b in range(256)}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(byte_of[c] for c in k): v for k, v in spec["model"]["vocab"].items() if k not in special}
    # The byte-level pre-tokenizer's own pattern.
    words = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    encoding = tiktoken.Encoding("byte_bpe", pat_str=words, mergeable_ranks=ranks, special_tokens=special)
    allowed = set(special)
    return lambda text: encoding.encode_to_numpy(text, allowed_special=allowed, disallowed_special=())


class Packer:
    """Packs one stream of documents, window by window; what is left of a window goes on into the next.

    A piece is (document, start, length). Whole contexts are cut from long
    documents first. What remains of each document is routed to the smallest
    tier that holds it. The longest tier is packed first: each of its pieces
    opens a sequence, whose gap is filled from the shorter tiers, by the
    longest pieces that fit and then by a piece cut to the rest. Then each
    shorter tier does the same in its own context size. So every sequence but
    the very last is exactly as long as a tier, and needs no padding.
    """

    def __init__(self, tiers: tuple[int, ...] = TIERS, least: int = LEAST):
        self.tiers, self.least = tiers, least
        self.pools: list[list[tuple[int, int, int]]] = [[] for _ in tiers]  # of (length, document, start), sorted
        self.full: list[list[tuple[int, int, int]]] = []

    def add(self, document: int, length: int) -> None:
        whole = length - length % self.tiers[-1]
        self.full += [[(document, at, self.tiers[-1])] for at in range(0, whole, self.tiers[-1])]
        self._pool(length - whole, document, whole)

    def _pool(self, length: int, document: int, start: int) -> None:
        if length:
            insort(self.pools[bisect_left(self.tiers, length)], (length, document, start))

    def _fill(self, gap: int, upto: int) -> list[tuple[int, int, int]]:
        """Pieces that fill a gap from the tiers up to one, or fewer if these run out."""
        out = []
        while gap:
            for pool in reversed(self.pools[: upto + 1]):
                if at := bisect_left(pool, (gap + 1,)):
                    length, document, start = pool.pop(at - 1)
                    break
            else:
                pool = next((x for x in self.pools[: upto + 1] if x), None)
                if pool is None:
                    return out
                length, document, start = pool.pop(0)
                self._pool(length - gap, document, start + gap)
                length = gap
            out.append((document, start, length))
            gap -= length
        return out

    def flush(self, last: bool = False) -> list[list[tuple[int, int, int]]]:
        """The sequences of this window: lists of pieces. Tiers whose tokens don't fill a sequence stay, but for the last time."""
        for tier in reversed(range(len(self.tiers))):
            size, pool = self.tiers[tier], self.pools[tier]
            while pool and sum(x[0] for p in self.pools[: tier + 1] for x in p[:size]) >= size:
                length, document, start = pool.pop()
                self.full.append([(document, start, length), *self._fill(size - length, tier)])
        if last:
            left = sum(x[0] for p in self.pools for x in p)
            while left:
                size = 1 << min(left.bit_length() - 1, self.tiers[-1].bit_length() - 1)
                size = size if size >= self.least else left
                self.full.append(self._fill(size, len(self.tiers) - 1))
                left -= size
        out, self.full = self.full, []
        return out


def balanced(lengths: list[int], budget: int = STEP) -> list[int]:
    """The step group of each sequence: longest first, each to the group with the fewest tokens."""
    groups = [(0, g) for g in range(-(-sum(lengths) // budget))]
    out = [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        tokens, g = heapq.heappop(groups)
        out[i] = g
        heapq.heappush(groups, (tokens + lengths[i], g))
    return out


def pack_documents(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """Rows (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, context, step_id), one for each piece.

    ``start`` is a piece's place in its document, ``offset`` that in its
    sequence, ``context`` the size the sequence is padded to: its own length
    if that is a power of two, else the longest context. ``step_id`` groups sequences
    to steps of about equally many tokens. ``with_ids`` adds the ids (binary, little-endian).

    Each task packs its own partition, so nothing is shuffled, and holds one
    window of tokens. At most one sequence of a partition is padded.
    Null and empty texts are the end token alone. Rows repeated, and rows with
    a null doc_id, are packed as documents of their own. An empty table gives no rows.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = kept_in_worker(f"packing {name}", lambda: token_encoder(spec))
        base = TaskContext.get().partitionId() << 32
        packer, held, numbers = Packer(), {}, [0, 0, 0]  # numbers: of documents, sequences and steps so far

        def emit(last: bool) -> pa.RecordBatch:
            sequences = packer.flush(last)
            steps = balanced([sum(p[2] for p in s) for s in sequences])
            rows = []
            for sequence, step in zip(sequences, steps, strict=True):
                used, total = 0, sum(p[2] for p in sequence)
                context = total if total & (total - 1) == 0 else CONTEXT
                for document, start, length in sequence:
                    doc_id, ids, left = held[document]
                    piece = ids[start : start + length].tobytes()
                    row = (doc_id, start, length, zlib.crc32(piece), len(ids), base + numbers[1], used, context, base + numbers[2] + step)
                    rows.append((*row, piece) if with_ids else row)
                    held[document][2] = left - length
                    if left == length:
                        del held[document]
                    used += length
                numbers[1] += 1
            numbers[2] += max(steps, default=-1) + 1
            columns = list(zip(*rows, strict=True)) or [()] * (10 if with_ids else 9)
            arrays = [pa.array(c, pa.int64()) for c in columns[:9]] + [pa.array(c, pa.binary()) for c in columns[9:]]
            return pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in schema.split(", ")])

        tokens = 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts(batch), strict=True):
                ids = np.append(encode(text), np.uint32(END)).astype("<u4")
                held[numbers[0]] = [doc_id, ids, len(ids)]
                packer.add(numbers[0], len(ids))
                numbers[0] += 1
                tokens += len(ids)
                if tokens >= window:
                    yield emit(False)
                    tokens = 0
        yield emit(True)

    spec, name = tokenizer_text(tokenizer_path)
    schema = OUT + ", ids binary" * with_ids
    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), kernel, schema)
