"""SentencePiece encoding and decoding by matching all pieces against an index of the batch's text."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from doctables.llm.wordcache import WordCache, portions

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
PART_CHARS = 1 << 17  #: characters indexed at once, unless one unit alone is longer; the index takes about 500 bytes for each
KEPT = 120_000  #: units of a generation that a worker remembers
PORTION_BYTES = 1 << 21  #: text of whole documents worked on at once
LONG_UNIT = 64  #: longer units merge through a queue
NONE = np.int64(1) << 40


def suffix_order(codes: np.ndarray, depth: int) -> np.ndarray:
    """Positions sorted by the `depth` codes that follow, by prefix doubling."""
    rank = np.unique(codes, return_inverse=True)[1].astype(np.int64)
    reach = 1
    while reach < depth:
        after = np.zeros(len(rank), dtype=np.int64)
        after[:-reach] = rank[reach:] + 1
        rank = np.unique(rank * (len(rank) + 1) + after, return_inverse=True)[1].astype(np.int64)
        reach *= 2
    return np.argsort(rank, kind="stable")


class Pieces:
    """The pieces of a byte-pair model with byte fallback, and units encoded so far."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        count = self.model.vocab_size()
        texts = [self.model.id_to_piece(i) for i in range(count)]
        special = [self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_unused(i) for i in range(count)]
        self.bytes = {int(t[3:5], 16): i for i, t in enumerate(texts) if self.model.is_byte(i)}
        if len(self.bytes) < 256:
            raise ValueError("the model must fall back to bytes")
        self.ids = np.array([i for i in range(count) if not special[i] and not self.model.is_byte(i)], dtype=np.int64)
        self.width = max(len(texts[i]) for i in self.ids)
        kind = f"U{self.width}"
        self.low = np.array([texts[i] for i in self.ids], dtype=kind)
        self.high = np.array([texts[i].ljust(self.width, "\U0010ffff") for i in self.ids], dtype=kind)
        self.sizes = np.array([len(texts[i]) for i in self.ids], dtype=np.int64)
        scores = np.array([self.model.get_score(i) for i in range(count)])
        self.rank = np.unique(-scores, return_inverse=True)[1].astype(np.int64)
        # no piece goes on with a space mark after another character: units can be cut there
        safe = not any(SPACE in texts[i].lstrip(SPACE) for i in self.ids)
        self.units = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+") if safe else re.compile("(?s).+")
        self.out = [b"" if special[i] else bytes([int(t[3:5], 16)]) if self.model.is_byte(i) else t.replace(SPACE, " ").encode() for i, t in enumerate(texts)]
        self.out[self.model.unk_id()] = " ⁇ ".encode()
        self.cache = WordCache(self.encode_units, limit=PART_CHARS, kept=KEPT)

    def edges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All occurrences of all pieces in the text, as (position, piece), sorted by position.

        The text's suffixes are sorted, each piece's range is found by binary search.
        """
        order = suffix_order(codes, self.width)
        padded = np.concatenate((codes, np.zeros(self.width, dtype=codes.dtype)))
        windows = np.lib.stride_tricks.sliding_window_view(padded, self.width)[:-1][order]
        windows = np.ascontiguousarray(windows).view(f"U{self.width}").ravel()
        first = np.searchsorted(windows, self.low, "left")
        count = np.searchsorted(windows, self.high, "right") - first
        piece = np.repeat(np.arange(len(count)), count)
        inside = np.arange(len(piece)) - np.repeat(np.cumsum(count) - count, count)
        at = order[np.repeat(first, count) + inside]
        by_place = np.argsort(at, kind="stable")
        return at[by_place], piece[by_place]

    def encode_units(self, units: list[str]) -> list[bytes]:
        """Ids of each unit as little-endian 32-bit integers."""
        codes = np.frombuffer("\0".join([*units, ""]).encode("utf-32-le"), dtype="<u4")
        at, piece = self.edges(codes)
        # table[p, n]: piece of n characters at p, 0 if there is none
        table = np.zeros((len(codes), self.width + 1), dtype=np.int32)
        table[at, self.sizes[piece]] = self.ids[piece] + 1
        sizes = np.array([len(u) for u in units], dtype=np.int64)
        begins = np.cumsum(sizes + 1) - sizes - 1
        short = np.flatnonzero(sizes <= LONG_UNIT)
        starts, ends, owner = self._merged(table, begins, sizes, short)
        for i in np.flatnonzero(sizes > LONG_UNIT):
            s, e = self._merged_long(table, int(begins[i]), int(sizes[i]))
            starts, ends = np.concatenate((starts, s)), np.concatenate((ends, e))
            owner = np.concatenate((owner, np.full(len(s), i)))
        order = np.argsort(starts, kind="stable")
        starts, ends, owner = starts[order], ends[order], owner[order]
        ids = table[starts, ends - starts].astype(np.int64) - 1
        if (ids < 0).any():
            ids, owner = self._with_bytes(codes, ids, starts, owner)
        raw = ids.astype("<u4").tobytes()
        stops = np.searchsorted(owner, np.arange(len(units)), "right") * 4
        return [raw[a:b] for a, b in zip([0, *stops.tolist()], stops.tolist())]

    def _with_bytes(self, codes, ids, starts, owner):
        """Characters without a piece become the pieces of their UTF-8 bytes."""
        out, own = [], []
        for i, s, o in zip(ids.tolist(), starts.tolist(), owner.tolist()):
            found = [i] if i >= 0 else [self.bytes[b] for b in chr(codes[s]).encode()]
            out += found
            own += [o] * len(found)
        return np.array(out, dtype=np.int64), np.array(own, dtype=np.int64)

    def _ranks(self, table, starts, ends) -> np.ndarray:
        """Rank of the piece that spans from each start to each end, NONE if there is none."""
        size = ends - starts
        piece = table[starts, np.minimum(size, self.width)]
        return np.where((size <= self.width) & (piece > 0), self.rank[np.maximum(piece - 1, 0)], NONE)

    def _merged(self, table, begins, sizes, units):
        """Relax all units at once: in each round every unit takes its best edge over two symbols, the leftmost of equals."""
        owner = np.repeat(units, sizes[units])
        count = sizes[units]
        starts = np.repeat(begins[units], count) + np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        ends, done = starts + 1, []
        while len(owner):
            rank = np.full(len(owner), NONE)
            pair = np.flatnonzero(owner[:-1] == owner[1:])
            rank[pair] = self._ranks(table, starts[pair], ends[pair + 1])
            first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            best = np.minimum.reduceat(rank * len(owner) + np.arange(len(owner)), first)
            open_ = best < NONE * len(owner)
            place = (best % len(owner))[open_]
            ends[place] = ends[place + 1]
            live = np.repeat(open_, np.diff(np.concatenate((first, [len(owner)]))))
            done.append((starts[~live], ends[~live], owner[~live]))
            live[place + 1] = False
            starts, ends, owner = starts[live], ends[live], owner[live]
        return tuple(np.concatenate([d[k] for d in done]) if done else np.zeros(0, dtype=np.int64) for k in range(3))

    def _merged_long(self, table, begin: int, size: int):
        """The same for one long unit, through a queue of edges."""
        after = list(range(1, size + 1))
        before = list(range(-1, size - 1))
        end = list(range(1, size + 1))
        first = np.arange(begin, begin + size - 1)
        ranks = self._ranks(table, first, first + 2)
        queue = [(int(r), i, i + 2) for i, r in enumerate(ranks) if r < NONE]
        heapq.heapify(queue)
        alive = [True] * size

        def push(i: int) -> None:
            j = after[i]
            if j < size and end[j] - i <= self.width and (piece := table[begin + i, end[j] - i]):
                heapq.heappush(queue, (int(self.rank[piece - 1]), i, end[j]))

        while queue:
            _, i, stop = heapq.heappop(queue)
            if not alive[i] or after[i] >= size or end[after[i]] != stop:
                continue
            j = after[i]
            alive[j], end[i], after[i] = False, stop, after[j]
            if after[i] < size:
                before[after[i]] = i
            push(i)
            if before[i] >= 0:
                push(before[i])
        starts = np.flatnonzero(alive)
        return starts + begin, np.array(end, dtype=np.int64)[starts] + begin

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each whole text; distinct units not seen before are indexed together."""
        split = [self.units.findall(t) for t in (self.model.normalize(texts) if texts else [])]
        return list(map(b"".join, self.cache.lists(split)))

    def decode(self, ids) -> str:
        text = b"".join(map(self.out.__getitem__, ids)).decode(errors="replace")
        return text[1:] if text.startswith(" ") else text


@lru_cache(maxsize=4)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def encode(text: Column, model: str = MODEL) -> Column:
    """Ids (array<int>) of each whole text, as the model's library gives them; NULL and empty texts have none."""

    @F.pandas_udf("array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        found = pieces(public_tokenizers.path(model))
        for texts in batches:
            plain = [t or "" for t in texts]
            ids: list[np.ndarray] = []
            for first, last in portions(map(len, plain), PORTION_BYTES):
                ids += [np.frombuffer(raw, dtype="<i4") for raw in found.encode(plain[first:last])]
            yield pd.Series(ids, dtype=object)

    return run(text)


def decode(ids: Column, model: str = MODEL) -> Column:
    """Text of each list of ids; NULL for NULL."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        found = pieces(public_tokenizers.path(model))
        for lists in batches:
            yield pd.Series([None if x is None else found.decode(x.tolist()) for x in lists], dtype=object)

    return run(ids)


def encode_documents(docs: DataFrame, text_col: str = "text", model: str = MODEL, name: str = "ids") -> DataFrame:
    """docs with a column of ids; every row stays, repeated rows and rows without id included.

    NULL and empty texts have an empty list. A column of this name is replaced. Arrow
    batches are worked on in portions of PORTION_BYTES and given back portion by
    portion, so a task holds little more than its input batch.
    """
    kept = docs.drop(name)
    place = kept.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = pieces(public_tokenizers.path(model))
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(place)), 0).to_pylist()
            for first, last in portions(sizes, PORTION_BYTES):
                part = batch.slice(first, last - first)
                raw = found.encode([t or "" for t in part.column(place).to_pylist()])
                ends = np.cumsum([0] + [len(r) // 4 for r in raw], dtype=np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(raw), dtype="<i4")))
                yield pa.RecordBatch.from_arrays([*part.columns, ids], names=[*part.schema.names, name])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField(name, T.ArrayType(T.IntegerType()))]))
