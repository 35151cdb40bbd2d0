"""Many fixed words searched at once: one automaton per worker, one pass over each text."""

from __future__ import annotations

import functools
from collections.abc import Sequence

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


@functools.lru_cache(maxsize=8)
def automaton(words: tuple[str, ...]) -> ahocorasick.Automaton | None:
    """Automaton of the words, kept while the worker lives; None without words to look for."""
    made = ahocorasick.Automaton()
    places: dict[str, list[int]] = {}
    for i, word in enumerate(words):
        if word:
            places.setdefault(word, []).append(i)
    for word, at in places.items():
        made.add_word(word, tuple(at))
    if not places:
        return None
    made.make_automaton()
    return made


def places_in(words: tuple[str, ...], text: str | None) -> set[int]:
    """Positions of the words that stand in the text; an empty word stands everywhere."""
    found = {i for i, w in enumerate(words) if not w} if text is not None and "" in words else set()
    made = automaton(words)
    if made is not None and text:
        for at in {at for _, at in made.iter(text)}:
            found.update(at)
    return found


def words_in(text: Column, words: Sequence[str]) -> Column:
    """Sorted positions of the words that a text contains, as written."""
    fixed = tuple(words)

    @F.pandas_udf("array<int>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([sorted(places_in(fixed, t)) for t in texts])

    return run(text)


def _missing(text: str | None, wanted: Sequence[str]) -> set[str]:
    """Those of the words that do not stand in the text; all of them without text.

    The automaton is built over the words; a few words are searched one by one.
    """
    if text is None:
        return set(wanted)
    if len(wanted) < 8:
        return {w for w in wanted if w not in text}
    made = ahocorasick.Automaton()
    for w in wanted:
        made.add_word(w, w)
    made.make_automaton()
    return set(wanted).difference(w for _, w in made.iter(text))


def missing_from(text: Column, values: Column) -> Column:
    """Those of the values (an array) that do not stand in the text; all of them where it is NULL."""

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series, lists: pd.Series) -> pd.Series:
        out = []
        for text, wanted in zip(texts, lists):
            lacking = _missing(text, wanted)
            out.append([w for w in wanted if w in lacking])
        return pd.Series(out)

    return run(text, values)


def missing_places(texts: Column, values: Column) -> Column:
    """Places (from 0) of the values that one of the texts lacks; all places where the array of texts is NULL."""

    @F.arrow_udf("array<int>")
    def run(rows: pa.Array, lists: pa.Array) -> pa.Array:
        # The words of all rows are read at once, which costs less than a list per row.
        words = lists.flatten().to_numpy(zero_copy_only=False)
        ends = (lists.offsets.to_numpy() - lists.offsets[0].as_py()).tolist()
        places, sizes = [], [0]
        for texts, first, last in zip(rows.to_pylist(), ends, ends[1:]):
            wanted = words[first:last]
            lacking = set().union(*[_missing(t, wanted) for t in ([None] if texts is None else texts)])
            places.extend([i for i, w in enumerate(wanted) if w in lacking])
            sizes.append(len(places))
        return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(places, pa.int32()))

    return run(texts, values)
