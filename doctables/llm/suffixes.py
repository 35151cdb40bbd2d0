"""Passages that stand more than once, found by merging Burrows-Wheeler transforms of shards."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doctables.llm.rolling import Prefixes, mixed
from doctables.llm.work import saved

LENGTH = 400  #: bytes of a repeated string
ANCHOR = 128  #: bytes whose hash decides where a string is looked for
SYMBOL = 100  #: bytes of one symbol of the transform
CHUNK = 1 << 20  #: bytes of a text that are hashed at once
TASK_BYTES = 1 << 21  #: bytes of contexts merged by one task, on average
SHARD_BYTES = 1 << 19  #: bytes of contexts in one shard
GROUP = 8192  #: different contexts of one anchor that stay together: about 5 MB
SPAN = "array<struct<a: int, b: int>>"


def _keys(text: Column) -> list[Column]:
    """128 bits that stand for a text."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")]


def _chunks(batch: pa.RecordBatch, length: int) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """Rows, offsets and bytes of texts that have a string of `length`, about CHUNK bytes at a time.

    Long texts come in several parts, each with the bytes that its last strings need.
    """
    rows, offsets, parts, size = [], [], [], 0
    for row, text in enumerate(batch.column("text")):
        text = text.as_buffer().to_pybytes() if text.is_valid else b""
        for at in range(0, len(text) - length + 1, CHUNK):
            rows.append(row)
            offsets.append(at)
            parts.append(text[at : at + CHUNK + length - 1])
            size += len(parts[-1])
            if size >= CHUNK:
                yield rows, offsets, parts
                rows, offsets, parts, size = [], [], [], 0
    if rows:
        yield rows, offsets, parts


def _least_in(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` values in a row, from minima within blocks forwards and backwards."""
    n = len(values) - width + 1
    filled = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max)
    filled[: len(values)] = values
    grid = filled.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def anchors(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """(k1, k2, s, n, fp, ctx): the strings of `length` bytes of (k1, k2, text), by the anchor they contain.

    The anchor of a string is its part of `anchor` bytes with the least hash, the
    first of equals, so equal strings have equal anchors at the same place. n strings
    in a row from byte s on share one anchor with hash fp; ctx is the hash of all
    their bytes and of where the anchor lies.
    """
    low = np.uint64((1 << 24) - 1)

    def found(batch):
        for rows, offsets, parts in _chunks(batch, length):
            codes = np.frombuffer(b"".join(parts), dtype=np.uint8)
            ends = np.cumsum([len(p) for p in parts])
            starts = ends - [len(p) for p in parts]
            sums = Prefixes(codes)
            hashes = sums.windows(anchor)
            least = _least_in(hashes & ~low | np.arange(len(hashes), dtype=np.uint64), length - anchor + 1)
            here = np.concatenate([np.arange(a, b - length + 1) for a, b in zip(starts.tolist(), ends.tolist())])
            least = least[here]
            first = np.flatnonzero(np.concatenate(([True], (least[1:] != least[:-1]) | (here[1:] != here[:-1] + 1))))
            s, last = here[first], here[np.append(first[1:], len(here)) - 1]
            place = (least[first] & low).astype(np.int64)
            n = last - s + 1
            whole = sums.spans(s, last + length)
            ctx = mixed(whole * np.uint64(3) + (place - s).astype(np.uint64) * np.uint64(1 << 32) + n.astype(np.uint64))
            part = np.searchsorted(ends, s, side="right")
            row = np.array(rows)[part]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("k1").take(pa.array(row)),
                    batch.column("k2").take(pa.array(row)),
                    pa.array((s - starts[part] + np.array(offsets)[part]).astype(np.int32)),
                    pa.array(n.astype(np.int32)),
                    pa.array(hashes[place].view(np.int64)),
                    pa.array(ctx.view(np.int64)),
                ],
                names=["k1", "k2", "s", "n", "fp", "ctx"],
            )

    def run(batches):
        for batch in batches:
            yield from found(batch)

    return docs.mapInArrow(run, "k1 long, k2 long, s int, n int, fp long, ctx long")


@dataclass
class Shard:
    """Transform of one shard: the symbol before each suffix, in the order of the suffixes."""

    before: np.ndarray  #: uint64, 0 where a string begins
    strings: int  #: strings of the shard, as many as suffixes without a symbol


def _steps(contexts: list[bytes], symbol: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbol of each suffix (0: none left) and the suffix one symbol before it (-1: none).

    A context is read as `symbol` strings, one for each place modulo `symbol`. The
    symbol at a place is the hash (48 bits) of the next `symbol` bytes, so strings of
    `length` bytes are equal if `length / symbol` symbols are.
    """
    sizes = np.array([len(c) for c in contexts])
    stops = np.cumsum(sizes + 1)  # one place behind each context, for the string that ends there
    starts = stops - sizes - 1
    codes = np.frombuffer(b"\0".join(contexts) + b"\0", dtype=np.uint8)
    hashes = np.zeros(len(codes), dtype=np.uint64)
    windows = Prefixes(codes).windows(symbol)
    hashes[: len(windows)] = np.maximum(windows >> np.uint64(16), np.uint64(1))
    where = np.arange(len(codes)) - np.repeat(starts, sizes + 1)
    left = np.repeat(sizes, sizes + 1) - where
    hashes[left < symbol] = 0
    return hashes, np.where(where >= symbol, np.arange(len(codes)) - symbol, -1)


def _by_symbol(symbols: np.ndarray) -> np.ndarray:
    """Stable order of symbols of 48 bits, 16 bits at a time."""
    order = np.argsort(symbols.astype(np.uint16), kind="stable")
    for shift in (16, 32):
        order = order[np.argsort((symbols >> np.uint64(shift)).astype(np.uint16)[order], kind="stable")]
    return order


def shard_transform(hashes: np.ndarray, back: np.ndarray, rounds: int) -> tuple[np.ndarray, Shard]:
    """Suffixes of one shard in the order of their first `rounds` symbols, and its transform."""
    order = np.arange(len(hashes))
    ended = order[hashes == 0]
    for _ in range(rounds):
        before = back[order]
        before = before[before >= 0]
        order = np.concatenate((ended, before[_by_symbol(hashes[before])]))
    before = np.where(back[order] >= 0, hashes[back[order]], 0)
    return order, Shard(before, len(ended))


def merge(shards: list[Shard], rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Interleave of the shards' suffixes, and the common prefix of each with the one before it.

    The interleave says of which shard the next suffix is. It begins as shard after
    shard. In each round the symbol before every suffix is read from the transforms
    in the order of the interleave, and a stable sort by that symbol gives the
    interleave by one symbol more: no suffix is looked at. Suffixes that are equal so
    far stand in an interval, which a round only divides. So the round in which two
    neighbours part is their common prefix, and what is left undivided after the last
    round are the repeated strings.
    """
    before = np.concatenate([s.before for s in shards])
    names = np.arange(len(shards), dtype=np.uint16 if len(shards) < 1 << 16 else np.int64)
    ended = np.repeat(names, [s.strings for s in shards])
    interleave = np.repeat(names, [len(s.before) for s in shards])
    common = np.full(len(before), rounds, dtype=np.int8)
    for depth in range(rounds):
        symbols = np.empty_like(before)
        symbols[np.argsort(interleave, kind="stable")] = before
        going = np.flatnonzero(symbols)
        sort = going[_by_symbol(symbols[going])]
        parted = np.ones(len(before), dtype=bool)  # ended strings are unlike any other
        interval = np.cumsum(common < rounds)[sort]
        symbols = symbols[sort]
        parted[len(ended) + 1 :] = (symbols[1:] != symbols[:-1]) | (interval[1:] != interval[:-1])
        common[parted & (common == rounds)] = depth
        interleave = np.concatenate((ended, interleave[sort]))
    return interleave, common


def _repeated(contexts: list[bytes], lengths: np.ndarray, length: int, symbol: int, shard_bytes: int) -> list[np.ndarray]:
    """For each context the places of its strings that stand elsewhere among the contexts too."""
    rounds = length // symbol
    shards, suffixes, at, base = [], [], 0, 0
    while at < len(contexts):
        end, size = at, 0
        while end < len(contexts) and (end == at or size < shard_bytes):
            size += len(contexts[end]) + 1
            end += 1
        hashes, back = _steps(contexts[at:end], symbol)
        order, shard = shard_transform(hashes, back, rounds)
        shards.append(shard)
        suffixes.append(order + base)
        base += len(hashes)
        at = end
    interleave, common = merge(shards, rounds)
    place = np.empty(base, dtype=np.int64)
    place[np.argsort(interleave, kind="stable")] = np.concatenate(suffixes)
    same = common == rounds
    again = same.copy()
    again[:-1] |= same[1:]
    hit = np.zeros(base, dtype=bool)
    hit[place[again]] = True
    starts = np.concatenate(([0], np.cumsum([len(c) + 1 for c in contexts])[:-1]))
    return [np.flatnonzero(hit[s : s + n]) for s, n in zip(starts.tolist(), lengths.tolist())]


def _runs(places: np.ndarray) -> list[dict]:
    """Runs of consecutive places as first and last."""
    if not len(places):
        return []
    cut = np.flatnonzero(np.diff(places) != 1)
    return [{"a": int(a), "b": int(b)} for a, b in zip(places[np.append(0, cut + 1)], places[np.append(cut, len(places) - 1)])]


def merged_contexts(contexts: DataFrame, tasks: int, length: int, symbol: int, shard_bytes: int) -> DataFrame:
    """(fp, ctx, spans) of contexts (fp, ctx, n, text): which of the n strings stand in several of them.

    Contexts are routed by anchor, so equal strings meet in one task. There they are
    cut into shards, each is transformed, and the transforms are merged.
    """

    def run(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        texts = [t.as_buffer().to_pybytes() for t in table.column("text")]
        hits = _repeated(texts, table.column("n").to_numpy(), length, symbol, shard_bytes)
        some = pa.array([i for i, h in enumerate(hits) if len(h)], pa.int64())
        yield from pa.table(
            {
                "fp": table.column("fp").take(some),
                "ctx": table.column("ctx").take(some),
                "spans": pa.array([_runs(h) for h in hits if len(h)], pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))),
            }
        ).to_batches()

    return contexts.select("fp", "ctx", "n", "text").repartition(tasks, "fp").mapInArrow(run, f"fp long, ctx long, spans {SPAN}")


def single_strings(contexts: DataFrame, length: int) -> DataFrame:
    """(fp, ctx, spans) as `merged_contexts`, for anchors of too many contexts: every string is a row of its own."""

    def run(batches):
        for batch in batches:
            for fp, ctx, text in zip(batch.column("fp").to_pylist(), batch.column("ctx").to_pylist(), batch.column("text")):
                hashes = Prefixes(np.frombuffer(text.as_buffer(), dtype=np.uint8)).windows(length)
                n = len(hashes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([fp] * n, pa.int64()), pa.array([ctx] * n, pa.int64()), pa.array(np.arange(n, dtype=np.int32)), pa.array(hashes.view(np.int64))],
                    names=["fp", "ctx", "at", "string"],
                )

    rows = saved(contexts.select("fp", "ctx", "text").mapInArrow(run, "fp long, ctx long, at int, string long"))
    again = rows.groupBy("fp", "string").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").drop("rows")
    return (
        rows.join(again, ["fp", "string"])
        .groupBy("fp", "ctx")
        .agg(F.collect_list(F.struct(F.col("at").alias("a"), F.col("at").alias("b"))).alias("spans"))
    )


def _cut(texts: DataFrame, length: int) -> DataFrame:
    """Add n_removed, n_spans and kept_sha256 to (text, spans); spans are first bytes of repeated strings."""

    def run(batches):
        for batch in batches:
            removed, runs, digests = [], [], []
            for text, spans in zip(batch.column("text"), batch.column("spans").to_pylist()):
                text = text.as_buffer() if text.is_valid else b""
                view, digest, at, gone, n = memoryview(text), hashlib.sha256(), 0, 0, 0
                for a, b in sorted((s["a"], s["b"] + length) for s in spans or ()):
                    if a > at or not n:
                        digest.update(view[at:a])
                        n += 1
                        gone += b - a
                    elif b > at:
                        gone += b - at
                    at = max(at, b)
                digest.update(view[at:])
                removed.append(gone)
                runs.append(n)
                digests.append(digest.hexdigest())
            rest = [batch.column(i) for i in range(batch.num_columns) if batch.schema.names[i] not in ("text", "spans")]
            names = [n for n in batch.schema.names if n not in ("text", "spans")]
            yield pa.RecordBatch.from_arrays(
                [*rest, pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(digests, pa.string())],
                names=[*names, "n_removed", "n_spans", "kept_sha256"],
            )

    kept = ", ".join(f"{name} {kind}" for name, kind in texts.dtypes if name not in ("text", "spans"))
    return texts.mapInArrow(run, f"{kept}, n_removed long, n_spans long, kept_sha256 string")


def repeated_spans(
    texts: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, symbol: int = SYMBOL,
    group: int = GROUP, task_bytes: int = TASK_BYTES, shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """(k1, k2, spans): first bytes of the strings of (k1, k2, text) that also start elsewhere, in runs."""
    if length % symbol:
        raise ValueError("length must be a multiple of symbol")
    spark = texts.sparkSession
    found = saved(anchors(texts, length, anchor))
    contexts = saved(
        found.groupBy("fp", "ctx", "n").agg(F.count(F.lit(1)).alias("rows"), F.min(F.struct("k1", "k2", "s")).alias("at"))
    )
    shared = saved(contexts.groupBy("fp").agg(F.count(F.lit(1)).alias("different"), F.sum(F.col("n") + length - 1).alias("bytes")).filter("different > 1"))
    # one text of each key, and from it the contexts that stand beside others
    needed = contexts.join(shared.select("fp", (F.col("different") > group).alias("full")), "fp").select("fp", "ctx", "n", "full", "at.*")
    one = texts.groupBy("k1", "k2").agg(F.first("text").alias("text"))
    cut = saved(
        one.join(needed, ["k1", "k2"]).select(
            "fp", "ctx", "n", "full", F.substring(F.col("text").cast("binary"), F.col("s") + 1, F.col("n") + length - 1).alias("text")
        )
    )
    size = shared.filter(F.col("different") <= group).agg(F.sum("bytes")).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // task_bytes))
    some = merged_contexts(cut.filter("not full"), tasks, length, symbol, shard_bytes)
    some = some.union(single_strings(cut.filter("full"), length))
    whole = contexts.filter("rows > 1").select("fp", "ctx", F.array(F.struct(F.lit(0).alias("a"), (F.col("n") - 1).alias("b"))).cast(SPAN).alias("spans"))
    spans = saved(whole.union(some))
    return (
        found.join(spans, ["fp", "ctx"])
        .select("k1", "k2", F.transform("spans", lambda x: F.struct((x["a"] + F.col("s")).alias("a"), (x["b"] + F.col("s")).alias("b"))).alias("spans"))
        .groupBy("k1", "k2")
        .agg(F.flatten(F.collect_set("spans")).alias("spans"))
    )


def drop_repeats(docs: DataFrame, length: int = LENGTH, **settings) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans and kept_sha256, without the bytes of repeated strings.

    A byte goes if it lies in a string of `length` bytes that also starts anywhere
    else in the input, in the same text or another; strings never reach over the end
    of a text. n_spans counts the runs removed, kept_sha256 is the SHA-256 of the
    remaining bytes. `settings` as for `repeated_spans`.

    Strings are taken by the anchor that they contain. Contexts (the strings that
    share an anchor in one text) that are equal are counted; of the others with the
    same anchor the bytes are fetched, transformed shard by shard and merged. Anchors
    with more than `group` different contexts are compared string by string. Strings
    are equal if the 64-bit hashes of their anchors and those of all their symbols are.

    NULL is an empty text; texts of less than `length` bytes lose nothing. Long texts
    are hashed in parts. Repeated rows are texts of their own and remove each other.
    An empty table gives an empty result; other columns are ignored, whatever their
    names.
    """
    rows = docs.select("doc_id", F.coalesce(docs["text"], F.lit("")).alias("text"))
    texts = rows.select(*_keys(F.col("text")), "text")
    spans = repeated_spans(texts.filter(F.octet_length("text") >= length), length, **settings)
    keyed = rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), *_keys(F.col("text")), "text")
    return _cut(keyed.join(spans, ["k1", "k2"], "left").select("doc_id", "n_bytes", "text", "spans"), length)
