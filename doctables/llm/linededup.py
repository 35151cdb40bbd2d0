"""Near-duplicate lines by MinHash over character shingles, with exact verification and union-find."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doctables.llm.work import apart, components, saved

SHINGLE = 7  #: characters of a shingle
SIMILARITY = 0.8
BANDS, ROWS = 13, 6  #: a pair of similarity 0.8 shares a band with probability 0.981, one of 0.85 with 0.998
SPAN = 1 << 17  #: characters whose shingles are hashed at once
VISIBLE = r"[^\x20\x09-\x0D]"
FEW = 32  #: buckets of up to so many lines are joined with themselves
BLOCK = 512  #: lines of a larger bucket compared at once
BLOCK_CHARS = 1 << 19  #: and their characters, unless one line alone has more
EMPTY = np.uint32(0xFFFFFFFF)


def _mixed(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser, so that all bits depend on all bits."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _runs(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    first = total = 0
    for at, size in enumerate(sizes):
        if total and total + size > limit:
            yield first, at
            first, total = at, 0
        total += size
    if first < len(sizes):
        yield first, len(sizes)


def band_keys(lines: list[str], shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """Band keys (lines x bands, int64) of each line; lines that share one may be similar.

    One-permutation MinHash: every shingle's hash falls in one of bands * rows bins,
    each bin keeps its smallest. Bins that stay empty borrow from a filled bin chosen
    by a hash of their own number and the attempt, the same for all lines. A line
    shorter than a shingle is one shingle.
    """
    bins = bands * rows
    out = np.empty((len(lines), bands), dtype=np.int64)
    for first, last in _runs([len(t) for t in lines], SPAN):
        part = lines[first:last]
        hashes, counts = _shingle_hashes(part, shingle)
        owner = np.repeat(np.arange(len(part)) * bins, counts)
        values = np.full(len(part) * bins, EMPTY, dtype=np.uint32)
        owner += ((hashes >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
        np.minimum.at(values, owner, np.minimum(hashes.astype(np.uint32), EMPTY - np.uint32(1)))
        values = _filled(values.reshape(len(part), bins))
        keys = np.zeros((len(part), bands), dtype=np.uint64)
        for r in range(rows):
            keys = keys * np.uint64(0x9E3779B97F4A7C15) + values[:, r::rows].astype(np.uint64) + np.uint64(1)
        keys = _mixed(keys + np.arange(bands, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        out[first:last] = keys.view(np.int64)
    return out


def _shingle_hashes(part: list[str], shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all shingles of the lines, one line after the other, and how many each line has."""
    # a line shorter than a shingle is filled up and gives one
    sizes = np.array([max(len(t), shingle) for t in part], dtype=np.int64)
    filled = "".join(t if len(t) >= shingle else t.ljust(shingle, "\0") for t in part)
    codes = np.frombuffer(filled.encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    end = len(codes) - shingle + 1
    hashes = np.zeros(end, dtype=np.uint64)
    # three characters fit into one word
    for at in range(0, shingle, 3):
        word = codes[at : at + end].copy()
        for k in range(1, min(3, shingle - at)):
            word |= codes[at + k : at + k + end] << np.uint64(21 * k)
        hashes ^= word * np.uint64(0x9E3779B97F4A7C15)
        if at + 3 < shingle:
            hashes = (hashes << np.uint64(23)) | (hashes >> np.uint64(41))
    real = np.ones(end, dtype=bool)
    stops = np.cumsum(sizes)[:-1]
    real[(stops[:, None] - np.arange(1, shingle)[None, :]).ravel()] = False
    return _mixed(hashes[real]), sizes - shingle + 1


@lru_cache(maxsize=4)
def _draws(bins: int) -> np.ndarray:
    """Row b: the bins that an empty bin b borrows from, attempt by attempt; 64 times the bins at most."""
    attempts = np.arange(1, 64 * bins + 1, dtype=np.uint64)
    own = np.arange(bins, dtype=np.uint64) * np.uint64(1 << 20)
    return (_mixed(own[:, None] + attempts[None, :]) % np.uint64(bins)).astype(np.uint16 if bins < 1 << 16 else np.int64)


def _filled(values: np.ndarray) -> np.ndarray:
    """Empty bins take the value of a bin drawn by bin number and attempt, until a filled one is met."""
    row, column = np.nonzero(values == EMPTY)
    if not len(row):
        return values
    original, draws = values.copy(), _draws(values.shape[1])
    done, step = 0, 4
    # lines without any shingle stay empty
    while len(row) and done < draws.shape[1]:
        met = original[row[:, None], draws[column, done : done + step]]
        filled = met != EMPTY
        first = filled.argmax(axis=1)
        found = filled[np.arange(len(row)), first]
        values[row[found], column[found]] = met[found, first[found]]
        row, column = row[~found], column[~found]
        done, step = done + step, min(4 * step, 64)
    return values


def shingles(line: str, size: int = SHINGLE) -> set[str]:
    return {line[i : i + size] for i in range(max(1, len(line) - size + 1))}


def _packed(line: str, size: int) -> np.ndarray | None:
    """The line's different shingles as numbers, where a shingle of one-byte characters fits into 64 bits."""
    if size > 8 or len(line) < size:
        return None
    try:
        codes = np.frombuffer(line.encode("latin-1"), dtype=np.uint8).astype(np.uint64)
    except UnicodeEncodeError:
        return None
    count = len(codes) - size + 1
    out = codes[:count]
    for k in range(1, size):
        out = (out << np.uint64(8)) | codes[k : k + count]
    return _different(np.sort(out))


def _different(ordered: np.ndarray) -> np.ndarray:
    return ordered[np.concatenate(([True], ordered[1:] != ordered[:-1]))]


def _shared(left: str, packed: np.ndarray | None, right: str, size: int) -> tuple[int, int]:
    """How many shingles both lines have, and how many either has; packed are those of left."""
    other = None if packed is None else _packed(right, size)
    if other is None:
        one, two = shingles(left, size), shingles(right, size)
        return len(one & two), len(one | two)
    merged = np.sort(np.concatenate((packed, other)), kind="stable")
    both = int(np.count_nonzero(merged[1:] == merged[:-1]))
    return both, len(merged) - both


def _similar(pairs: DataFrame, size: int, least: float) -> DataFrame:
    """Pairs (a, b) of (a, b, left, right) whose exact Jaccard similarity is at least `least`."""

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep, last, packed = [], None, None
            for left, right in zip(batch["left"], batch["right"]):
                if left != last:
                    last, packed = left, _packed(left, size)
                both, either = _shared(left, packed, right, size)
                keep.append(both >= least * either)
            yield batch.loc[np.array(keep, dtype=bool), ["a", "b"]]

    return pairs.mapInPandas(verify, "a long, b long")


def _verified(pairs: DataFrame, texts: DataFrame, size: int, least: float) -> DataFrame:
    """Verify pairs (a, b) of line numbers against the texts (line, text)."""
    with_right = pairs.join(texts.select(F.col("line").alias("b"), F.col("text").alias("right")), "b")
    both = with_right.join(texts.select(F.col("line").alias("a"), F.col("text").alias("left")), "a")
    return saved(_similar(both.select("a", "b", "left", "right"), size, least))


def _crowd_links(rows: DataFrame, texts: DataFrame, size: int, least: float) -> DataFrame:
    """Links (a, b) of crowded buckets (key, line, component, lead, n) between different components.

    Lines outside the leading component are compared with all lines of their bucket,
    block by block; a block gives at most one link for each line and component.
    """
    rows = saved(rows.drop("n").join(texts, "line"))
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum(F.length("text")) / BLOCK_CHARS)).cast("int")
    rows = rows.join(rows.groupBy("key").agg(blocks.alias("cut")), "key")
    cut = F.col("cut")
    whole = rows.withColumn("h", F.pmod(F.xxhash64(F.lit(1), "line"), cut).cast("int")).withColumn(
        "g", F.explode(F.sequence(F.lit(0), cut - 1))
    )
    small = (
        rows.filter("component <> lead")
        .withColumn("g", F.pmod(F.xxhash64(F.lit(2), "line"), cut).cast("int"))
        .withColumn("h", F.explode(F.sequence(F.lit(0), cut - 1)))
        .select("h", "g", *[F.col(c).alias(f"of_{c}") for c in ("key", "line", "component", "text")])
    )

    def link(own: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
        found = _block_links(own, other, size, least) if len(own) and len(other) else []
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    left = small.groupBy("of_key", "h", "g")
    right = whole.select("key", "h", "g", "line", "component", "text").groupBy("key", "h", "g")
    return saved(left.cogroup(right).applyInPandas(link, "a long, b long"))


def _block_links(own: pd.DataFrame, other: pd.DataFrame, size: int, least: float) -> list[tuple[int, int]]:
    """Exact similarities of each own line with all others at once, by numbered shingles."""
    lines = [*own["of_text"], *other["text"]]
    hashes, counts = _shingle_hashes(lines, size)
    number = np.unique(hashes, return_inverse=True)[1]
    top = int(number.max()) + 1
    each = np.unique(np.repeat(np.arange(len(lines)), counts) * top + number)
    owner, number = each // top, each % top
    begins = np.searchsorted(owner, np.arange(len(lines) + 1))
    rest, sizes = begins[len(own)], np.diff(begins)
    component, line = other["component"].to_numpy(), other["line"].to_numpy()
    out = []
    for i, (a, mine) in enumerate(zip(own["of_line"].tolist(), own["of_component"].tolist())):
        marked = np.zeros(top, dtype=bool)
        marked[number[begins[i] : begins[i + 1]]] = True
        both = np.add.reduceat(marked[number[rest:]].astype(np.int32), begins[len(own) : -1] - rest)
        near = np.flatnonzero((both >= least * (sizes[i] + sizes[len(own) :] - both)) & (component != mine))
        near = near[np.unique(component[near], return_index=True)[1]]
        out += [(a, int(line[j])) for j in near]
    return out


def line_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, at, text) of every line that is not blank; documents without id have none."""
    return _lines(_whole(docs, id_col, text_col)).select("doc", "at", "text")


def _whole(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, of, whole) of every document with id and text; of tells the texts of one id apart."""
    whole = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("whole"))
    return whole.filter("doc is not null and whole is not null").withColumn("of", F.xxhash64(F.lit(2), "whole"))


def _lines(whole: DataFrame) -> DataFrame:
    lines = whole.select("doc", "of", F.posexplode(F.split("whole", "\n", -1)).alias("at", "text"))
    return lines.filter(F.col("text").rlike(VISIBLE))


def line_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    size: int = SHINGLE, least: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS,
) -> DataFrame:
    """One row per line that is not blank: doc, at (its number in the text, from 0), keep_doc, keep_at, kept.

    Lines are linked if they are equal or their sets of character shingles have a
    Jaccard similarity of `least`; of each component one line is kept, the first by
    document and place. keep_doc and keep_at name it; kept marks it. Rows of one id
    are one document: an equal line at the same place is the same line.

    Equal lines are one node, known by 128 bits of hash. Nodes that share a band are
    candidates. In a band's bucket every node is first verified against the most common
    one, which in a group of edited copies is the text they come from; components of
    those links then leave only pairs of different components to be verified, so a
    large group of copies costs its size and not its square. Texts move only for nodes
    that share a bucket.
    """
    whole = _whole(docs, id_col, text_col)
    lines = _lines(whole)
    h1, h2 = F.xxhash64("text"), F.xxhash64(F.lit(1), "text")

    @F.pandas_udf("array<long>")
    def keys(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            which, distinct = pd.factorize(texts)
            yield pd.Series(list(band_keys(distinct.tolist(), size, bands, rows)[which]), dtype=object)

    placed = saved(
        lines.select("doc", "of", "at", h1.alias("h1"), h2.alias("h2"), keys(F.col("text")).alias("keys"))
    )
    nodes = saved(
        placed.groupBy("h1", "h2")
        .agg(F.min(F.struct("doc", "at", "of")).alias("head"), F.any_value("keys").alias("keys"), F.count(F.lit(1)).alias("n"))
        # more common lines have smaller numbers, by powers of two
        .withColumn("line", F.expr("shiftleft(cast(62 - floor(log2(n)) as bigint), 56)") + F.monotonically_increasing_id())
    )
    posted = nodes.select("line", F.explode("keys").alias("key"))
    shared = saved(
        posted.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("line").alias("low"), F.max("line").alias("high")).filter("n > 1")
    )
    crowded = shared.filter("n > 2")
    members = saved(posted.join(crowded.select("key", "low"), "key"))
    pairs = saved(
        shared.select(F.col("low").alias("a"), F.col("high").alias("b"))
        .union(members.filter("line > low").select("low", "line"))
        .distinct()
    )
    wanted = saved(pairs.select(F.explode(F.array("a", "b")).alias("line")).union(members.select("line")).distinct())
    # whole documents are fewer rows to move than their lines; a list is no longer than the document's text
    asked = (
        wanted.join(nodes.select("line", "head.doc", "head.of", "head.at"), "line")
        .groupBy("doc", "of")
        .agg(F.collect_list(F.struct("line", "at")).alias("asked"))
    )
    split = whole.join(asked, ["doc", "of"]).select("asked", F.split("whole", "\n", -1).alias("split"))
    told = split.select(F.explode(F.transform("asked", lambda s: F.struct(s["line"].alias("line"), F.get("split", s["at"]).alias("text")))).alias("s"))
    texts = saved(told.select("s.line", "s.text").dropDuplicates(["line"]))
    links = _verified(pairs, texts, size, least)
    found = saved(components(links))
    inside = saved(
        members.join(found, members.line == found.node, "left").select("key", "line", "low", F.coalesce("component", "line").alias("component"))
    )
    mixed = (
        inside.groupBy("key")
        .agg(
            F.min("component").alias("c0"), F.max("component").alias("c1"), F.count(F.lit(1)).alias("n"),
            F.max(F.when(F.col("line") == F.col("low"), F.col("component"))).alias("lead"),
        )
        .filter("c0 < c1")
        .select("key", "n", "lead")
    )
    open_ = saved(inside.join(mixed, "key"))
    few = open_.filter(F.col("n") <= FEW)
    more = (
        few.alias("x")
        .join(few.alias("y"), "key")
        .filter("x.line < y.line and x.component <> y.component and x.line <> x.low and y.line <> y.low")
        .select(F.col("x.line").alias("a"), F.col("y.line").alias("b"))
        .distinct()
    )
    more = _verified(more, texts, size, least).union(_crowd_links(open_.filter(F.col("n") > FEW), texts, size, least))
    # the stars of the first links stand for them
    found = saved(components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more)))
    grouped = saved(
        nodes.join(found, nodes.line == found.node, "left").select(
            "h1", "h2", "head", F.coalesce("component", "line").alias("component")
        )
    )
    heads = grouped.groupBy("component").agg(F.min("head").alias("keep"))
    keepers = saved(grouped.join(heads, "component").select("h1", "h2", F.col("keep.doc").alias("keep_doc"), F.col("keep.at").alias("keep_at")))
    return placed.select("doc", "at", "h1", "h2").join(keepers, ["h1", "h2"]).select(
        "doc", "at", "h1", "keep_doc", "keep_at", F.expr("doc = keep_doc and at = keep_at").alias("kept")
    )


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without the lines that `line_groups` does not keep; blank lines and their order stay.

    Documents of which no line but blank ones is left, after at least one was taken
    out, are gone. Documents without text, with blank lines only or without id stay as
    they are. Other columns stay, whatever their names.
    """
    of_doc, out, new = apart(docs, "doc", "gone", "text")
    groups = line_groups(docs, id_col, text_col, **options)
    gone = saved(
        groups.filter("not kept").groupBy("doc").agg(F.collect_set(F.struct("at", "h1")).alias(out))
    )
    joined = docs.join(gone.withColumnRenamed("doc", of_doc), docs[id_col] == F.col(of_doc), "left")
    kept = F.filter(
        F.transform(F.split(F.col(text_col), "\n", -1), lambda x, i: F.struct(i.alias("at"), F.xxhash64(x).alias("h1"), x.alias("x"))),
        lambda s: ~F.array_contains(out, F.struct(s["at"].alias("at"), s["h1"].alias("h1"))),
    )
    text = F.when(F.col(out).isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(kept, lambda s: s["x"]), "\n"))
    return (
        joined.withColumn(new, text)
        .filter(F.col(out).isNull() | F.col(new).rlike(VISIBLE))
        .select(*[F.col(new).alias(text_col) if c == text_col else docs[c] for c in docs.columns])
    )
