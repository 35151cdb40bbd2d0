"""Collocations: frequent word sequences, counted by sorting pointers to the places where they start."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from doctables.llm.rolling import Prefixes, mixed
from doctables.llm.work import saved

DEPTH = 5  #: words of the longest phrase
LEAST = 100  #: occurrences that make a candidate
BEST = 2000  #: phrases returned per language
BLOCK = 1 << 20  #: bytes of text that are split into words at once
ROWS = 512  #: texts taken at once
HELD = 1 << 20  #: pairs counted before they leave a task, and four times the pointers
TASK_ROWS = 1 << 20  #: pointers of one sorting task, on average
GROUP_ROWS = 1 << 16  #: pointers with the same leading words that stay together
MOST_BITS = 27  #: size of the filters of frequent words and pairs, as a power of two
ENDS = ".,;:!?\n\v\f\r"
#: A-Z lower, piece ends to newlines, tabs to blanks
TABLE = bytes.maketrans(
    bytes(range(65, 91)) + ENDS.encode() + b"\t", bytes(range(97, 123)) + b"\n" * len(ENDS) + b" "
)
NEXT_WORD = re.compile(rb" *[^ \n]+")


def blocks(texts: list[bytes], size: int = BLOCK) -> Iterator[tuple[bytes, int]]:
    """(bytes, stop): normalized texts joined or cut to about `size`; phrases start before `stop`.

    Long texts are cut where a piece ends, else between two words; then the next
    words follow after `stop`, so that no phrase is lost or counted twice.
    """
    held, length = [], 0
    for text in texts:
        if len(text) <= size:
            held.append(text)
            length += len(text) + 1
        else:
            at = 0
            while at < len(text):
                cut = len(text) if len(text) - at <= size else text.rfind(b"\n", at, at + size) + 1
                end = cut
                if not cut:
                    cut = text.rfind(b" ", at, at + size) + 1
                    if not cut:  # one word longer than a block
                        cut = NEXT_WORD.match(text, at).end()
                    end = cut
                    for _ in range(DEPTH - 1):
                        word = NEXT_WORD.match(text, end)
                        if not word:
                            break
                        end = word.end()
                yield text[at:end], cut - at
                at = cut
        if length >= size:
            yield (blob := b"\n".join(held)), len(blob)
            held, length = [], 0
    if held:
        yield (blob := b"\n".join(held)), len(blob)


class Words:
    """Words of one block: places, 64-bit hashes with the language, and which are followed in their piece."""

    def __init__(self, blob: bytes, stop: int, key: int):
        codes = np.frombuffer(blob, dtype=np.uint8)
        inside = np.concatenate(([0], ((codes != 32) & (codes != 10)).view(np.int8), [0]))
        edges = np.flatnonzero(np.diff(inside))
        self.starts, self.stops = edges[::2], edges[1::2]
        self.hashes = mixed(Prefixes(codes).spans(self.starts, self.stops) ^ np.uint64(key))
        lines = np.cumsum(codes == 10)
        piece = lines[self.starts]
        self.followed = piece[1:] == piece[:-1]
        self.own = int(np.searchsorted(self.starts, stop))

    def pairs(self) -> np.ndarray:
        """Hash of each word and the next one; only where `followed`."""
        return mixed(self.hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + self.hashes[1:])


def _language_key(lang: str, seed: int) -> int:
    codes = np.frombuffer(f"{seed}:{lang}".encode(), dtype=np.uint8)
    return int(Prefixes(codes).spans(np.array([0]), np.array([len(codes)]))[0])


def _words(batch: pa.RecordBatch, seed: int) -> Iterator[tuple[str, bytes, Words]]:
    """(lang, block, words) of a batch of (lang, text)."""
    for at in range(0, batch.num_rows, ROWS):
        part = batch.slice(at, ROWS)
        by_lang: dict[str, list[bytes]] = {}
        for lang, text in zip(part.column(0).to_pylist(), part.column(1)):
            if text.is_valid:
                by_lang.setdefault(lang, []).append(text.as_buffer().to_pybytes().translate(TABLE))
        for lang, texts in by_lang.items():
            key = _language_key(lang, seed)
            for blob, stop in blocks(texts):
                words = Words(blob, stop, key)
                if words.own:
                    yield lang, blob, words


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def word_counts(texts: DataFrame, seed: int) -> DataFrame:
    """(lang, hash, word, n) for all distinct words of (lang, text)."""

    def run(batches):
        for batch in batches:
            for lang, blob, words in _words(batch, seed):
                hashes, first, n = np.unique(words.hashes[: words.own], return_index=True, return_counts=True)
                found = [blob[a:b].decode() for a, b in zip(words.starts[first].tolist(), words.stops[first].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(n)), _signed(hashes), pa.array(found), pa.array(n.astype(np.int64))],
                    names=["lang", "hash", "word", "n"],
                )

    parts = texts.mapInArrow(run, "lang string, hash long, word string, n long")
    return parts.groupBy("lang", "hash", "word").agg(F.sum("n").alias("n"))


class Filter:
    """Bits of the hashes that may be frequent, of a size that is bounded whatever the data."""

    def __init__(self, spark: SparkSession, hashes: DataFrame, most_bits: int = MOST_BITS):
        self.shift = 64 - max(10, min(most_bits, (16 * hashes.count()).bit_length()))
        place = F.shiftrightunsigned("hash", self.shift)
        words = hashes.groupBy(F.shiftright(place, 6).alias("at")).agg(
            F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(hash, {self.shift}) & 63 as int))")).alias("bits")
        )
        table = np.zeros(max(1, (1 << (64 - self.shift)) >> 6), dtype=np.uint64)
        found = words.toArrow()  # at most 2**most_bits / 64 rows
        table[found.column("at").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
        self.sent = spark.sparkContext.broadcast(table)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        place = hashes >> np.uint64(self.shift)
        return (self.sent.value[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)


def pair_counts(texts: DataFrame, seed: int, words_kept: Filter) -> DataFrame:
    """(hash, n) of the pairs of words that may be frequent."""

    def counted(held):
        hashes, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([_signed(hashes), pa.array(n.astype(np.int64))], names=["hash", "n"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for _, _, words in _words(batch, seed):
                good = words_kept(words.hashes)
                both = words.followed & good[:-1] & good[1:]
                both[words.own :] = False
                held.append(words.pairs()[both])
                size += len(held[-1])
                if size >= HELD:
                    yield counted(held)
                    held, size = [], 0
        if held:
            yield counted(held)

    return texts.mapInArrow(run, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))


def _merged(rows: np.ndarray) -> pa.RecordBatch:
    """Distinct rows of word hashes and how often each occurs."""
    key = rows[:, 0]
    for column in range(1, DEPTH):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, column])
    _, first, back, n = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    if not (rows[first][back] == rows).all():  # two rows share a key
        rows_, n = np.unique(rows, axis=0, return_counts=True)
    else:
        rows_ = rows[first]
    return pa.RecordBatch.from_arrays(
        [*[_signed(np.ascontiguousarray(rows_[:, k])) for k in range(DEPTH)], pa.array(n.astype(np.int64))],
        names=[*[f"w{k}" for k in range(DEPTH)], "n"],
    )


def pointers(texts: DataFrame, seed: int, pairs_kept: Filter) -> DataFrame:
    """(w0..w4, n): up to five words from every place on that a candidate may start at, 0 where it must end."""

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for _, _, words in _words(batch, seed):
                going = words.followed & pairs_kept(words.pairs())
                at = np.flatnonzero(going[: words.own])
                going = np.concatenate((going, np.zeros(DEPTH, dtype=bool)))
                rows = np.zeros((len(at), DEPTH), dtype=np.uint64)
                on = np.ones(len(at), dtype=bool)
                for k in range(DEPTH):
                    rows[on, k] = words.hashes[at[on] + k]
                    on = on.copy()
                    on[on] = going[at[on] + k]
                held.append(rows)
                size += len(rows)
                if size >= HELD // 4:
                    yield _merged(np.concatenate(held))
                    held, size = [], 0
        if held:
            yield _merged(np.concatenate(held))

    return texts.mapInArrow(run, ", ".join(f"w{k} long" for k in range(DEPTH)) + ", n long")


def sort_counts(words: np.ndarray, n: np.ndarray, first: np.ndarray, least: int) -> Iterator[tuple[tuple, int]]:
    """(phrase, count) of all phrases with at least `least` occurrences, by multikey three-way quicksort.

    `words` has one column of hashes per place, `n` the weight of each pointer, and
    `first` the number of leading words of a pointer that are counted elsewhere. A
    partition is split by its middle word into less, equal and greater; the weight
    of the equal part is the count of a phrase and it goes on with the next word. A
    partition with less than `least` is abandoned.
    """
    stack = [(np.arange(len(n)), 0)]
    while stack:
        at, depth = stack.pop()
        column = words[at, depth]
        if len(at) == 1 or (column[0] == column).all():
            pivot, equal, others = column[0], at, ()
        else:
            a, b, c = int(column[0]), int(column[len(at) // 2]), int(column[-1])
            pivot = np.uint64(max(min(a, b), min(max(a, b), c)))
            equal, others = at[column == pivot], (at[column < pivot], at[column > pivot])
        for part in others:
            if len(part) and int(n[part].sum()) >= least:
                stack.append((part, depth))
        count = int(n[equal].sum())
        if pivot == 0 or count < least:
            continue
        # all of an equal part have the same leading words, so they agree on where counting begins
        if depth + 1 > int(first[equal[0]]) and depth:
            yield tuple(words[equal[0], : depth + 1].tolist()), count
        if depth + 1 < words.shape[1]:
            stack.append((equal, depth + 1))


def phrase_counts(found: DataFrame, least: int, group_rows: int = GROUP_ROWS, task_rows: int = TASK_ROWS) -> DataFrame:
    """(phrase, a): counts of the phrases of two to five word hashes with `least` occurrences.

    Pointers are routed by their two leading words, so that a task sees all of a
    phrase. Where more than `group_rows` share them, those are routed by three
    words, then four, then five, where equal pointers are one row per portion of
    text; the phrases passed over are counted by grouped sums. The limit grows with
    the rows, so at most 10,000 leading sequences of a length are over it and their
    list may be broadcast.
    """
    total = found.count()
    limit = max(group_rows, total // 10_000)
    routed = found.withColumn("route", F.lit(2))
    passed = []
    for depth in range(2, DEPTH):
        keys = [f"w{k}" for k in range(depth)]
        full = (
            routed.filter((F.col("route") == depth) & (F.col(f"w{depth - 1}") != 0))
            .groupBy(*keys)
            .agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("a"))
            .filter(F.col("rows") > limit)
        )
        full = saved(full)
        if full.isEmpty():
            break
        passed.append(full.filter(F.col("a") >= least).select(F.array(*keys).alias("phrase"), "a"))
        routed = routed.join(F.broadcast(full.select(*keys, F.lit(depth + 1).alias("deeper"))), keys, "left").withColumn(
            "route", F.coalesce("deeper", "route")
        ).drop("deeper")
    if passed:  # rows that end before their route are counted with what was passed over
        routed = routed.filter(F.element_at(F.array(*[f"w{k}" for k in range(DEPTH)]), F.col("route")) != 0)

    def run(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        column = lambda name: table.column(name).to_numpy()
        words = np.stack([column(f"w{k}").view(np.uint64) for k in range(DEPTH)], axis=1)
        phrases, counts = [], []
        for phrase, count in sort_counts(words, column("n"), column("route") - 1, least):
            phrases.append(np.array(phrase, dtype=np.uint64).view(np.int64))
            counts.append(count)
            if len(counts) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(phrases, pa.list_(pa.int64())), pa.array(counts, pa.int64())], names=["phrase", "a"])
                phrases, counts = [], []
        yield pa.RecordBatch.from_arrays([pa.array(phrases, pa.list_(pa.int64())), pa.array(counts, pa.int64())], names=["phrase", "a"])

    tasks = max(int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // task_rows))
    route = F.xxhash64(*[F.when(F.col("route") > k, F.col(f"w{k}")) for k in range(DEPTH)])
    counts = routed.repartition(tasks, route).mapInArrow(run, "phrase array<long>, a long")
    if passed:
        # leading words of five are one row per portion of text, so these are summed
        for one in passed:
            counts = counts.union(one)
    return counts


def collocations(
    docs: DataFrame, least: int = LEAST, best: int = BEST, most_bits: int = MOST_BITS,
    group_rows: int = GROUP_ROWS, task_rows: int = TASK_ROWS,
) -> DataFrame:
    """Best collocations per language: (lang, rank, phrase, a, l, r, n, score).

    Texts are lower-cased (A-Z), cut into pieces at `.,;:!?`, newlines and vertical
    white space, and pieces into words at blanks and tabs. Candidates are phrases of
    two to five words of a piece that occur at least `least` times in their language
    (overlaps count). A candidate cut after k words scores 1000*a*n/(l*r), rounded
    down, where l and r count its parts and n all words; the lowest cut decides, the
    first one of equals. Candidates inside a longer candidate that is as frequent go.
    The `best` of each language remain, by score, count and phrase.

    Words are counted first. A filter of bounded size lets through what may be
    frequent, so pairs are counted of frequent words only and pointers are kept only
    where a frequent pair starts; what the filter lets through wrongly is too rare
    to be counted in the end. Words are known by 64-bit hashes that include the
    language; should a frequent word share its hash with any other word, all is
    repeated with another seed.

    NULL text is empty, NULL lang is `und`. Empty tables and texts give no phrase.
    Repeated rows count each time. Texts are taken in blocks, cut between words with
    the words that follow, so very long ones need no more memory. Other columns are
    ignored, whatever their names.
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(docs["lang"].cast("string"), F.lit("und")).alias("lang"), docs["text"].alias("text"))
    seed = 0
    while True:
        words = saved(word_counts(texts, seed))
        often = saved(words.filter(F.col("n") >= least))
        alike = words.join(often.select("hash").distinct(), "hash").groupBy("hash").count().filter("count > 1")
        if alike.isEmpty():
            break
        seed += 1
    n = words.groupBy("lang").agg(F.sum("n").alias("n"))
    pairs = saved(pair_counts(texts, seed, Filter(spark, often, most_bits)).filter(F.col("n") >= least))
    found = saved(pointers(texts, seed, Filter(spark, pairs, most_bits)))
    candidates = saved(phrase_counts(found, least, group_rows, task_rows))
    scored = saved(scores(candidates, often, n))
    return named(top(_outermost(scored, candidates), best, often), often)


def _outermost(scored: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates without those that stand in a longer one of the same count.

    It is enough to look at one word more: a phrase between the two is as frequent.
    """
    length = F.size("phrase")
    inside = (
        candidates.filter(length > 2)
        .select(F.explode(F.array(F.slice("phrase", F.lit(1), length - 1), F.slice("phrase", F.lit(2), length - 1))).alias("phrase"), F.col("a").alias("longer"))
        .groupBy("phrase")
        .agg(F.max("longer").alias("longer"))
    )
    return scored.join(inside, "phrase", "left").filter("longer is null or longer < a").drop("longer")


def scores(candidates: DataFrame, often: DataFrame, n: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of all candidates, at the cut that scores lowest."""
    counts = candidates.union(often.select(F.array("hash"), "n"))
    cut = candidates.select("phrase", "a", F.explode(F.sequence(F.lit(1), F.size("phrase") - 1)).alias("k"))
    cut = cut.select(
        "phrase", "a", "k", F.slice("phrase", F.lit(1), F.col("k")).alias("head"), F.slice("phrase", F.col("k") + 1, F.size("phrase") - F.col("k")).alias("tail")
    )
    cut = cut.join(counts.select(F.col("phrase").alias("head"), F.col("a").alias("l")), "head")
    cut = cut.join(counts.select(F.col("phrase").alias("tail"), F.col("a").alias("r")), "tail")
    cut = cut.withColumn("first", F.get("phrase", F.lit(0))).join(often.select(F.col("hash").alias("first"), "lang"), "first").join(n, "lang")
    exact = lambda name: f"cast({name} as decimal(19, 0))"
    score = F.expr(f"(cast(1000 * a as decimal(19, 0)) * {exact('n')}) div ({exact('l')} * {exact('r')})")
    return (
        cut.withColumn("score", score)
        .groupBy("lang", "phrase", "a", "n")
        .agg(F.min(F.struct("score", "k", "l", "r")).alias("low"))
        .select("lang", "phrase", "a", "low.l", "low.r", "n", "low.score")
    )


def spelled(rows: DataFrame, often: DataFrame) -> DataFrame:
    """Add `spelling`: the words of `phrase`, joined by blanks."""
    words = rows.select("phrase", F.posexplode("phrase").alias("at", "hash")).join(often.select("hash", "word"), "hash")
    spelling = words.groupBy("phrase").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda w: w["word"]), " ").alias("spelling")
    )
    return rows.join(spelling, "phrase")


def top(rows: DataFrame, best: int, often: DataFrame) -> DataFrame:
    """First `best` rows of each language; a language is cut in parts before it is ranked as a whole."""
    order = [F.desc("score"), F.desc("a"), F.asc("spelling")]
    parts = spelled(rows, often).withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    few = parts.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= best)
    return few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= best)


def named(rows: DataFrame, often: DataFrame) -> DataFrame:
    return rows.select("lang", F.col("rank").cast("long").alias("rank"), F.col("spelling").alias("phrase"), "a", "l", "r", "n", "score")
