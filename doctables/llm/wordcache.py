"""Tokenizer work on the distinct words of a batch, for tokenizers that never look across white space."""

from __future__ import annotations

import gc
import os
from collections.abc import Callable, Hashable, Iterable, Iterator
from functools import lru_cache

import numpy as np

BATCH_BYTES = 1 << 20  #: text handed to the tokenizer at once
JOINED = 64  #: words that the tokenizer sees as one text
KEPT = 250_000  #: words of a generation that a worker remembers
LONGEST = 64  #: length of a word worth remembering


class WordCache:
    """Maps words to what `encode` gives for them; one worker keeps the short words of two generations.

    `encode` takes a list of words and gives a list of results. When a generation is
    full, it becomes the older one, and words met again move on to the new one. With
    `parts`, a word is the sum of its parts, which are kept as well.
    """

    def __init__(
        self, encode: Callable[[list], list], parts: Callable[[Hashable], tuple] | None = None,
        limit: int = BATCH_BYTES // 2, kept: int = KEPT,
    ):
        self.encode, self.parts, self.limit, self.kept = encode, parts, limit, kept
        self.known, self.older, self.pieces, self.worn = {}, {}, {}, {}

    def lists(self, texts: list[list]) -> list[list]:
        """The results for the words of each text, in order."""
        gc.disable()  # nothing here is cyclic, and scanning millions of words takes a seventh of the time
        try:
            return self._lists(texts)
        finally:
            gc.enable()

    def _lists(self, texts: list[list]) -> list[list]:
        if len(self.known) > self.kept:
            self.older, self.known = self.known, {}
        get = self.known.get
        found = [list(map(get, words)) for words in texts]
        gaps = [[i for i, r in enumerate(results) if r is None] for results in found]
        fresh = set()
        for words, missing in zip(texts, gaps):
            fresh.update([words[i] for i in missing])
        learnt = self._learn(fresh)
        for words, results, missing in zip(texts, found, gaps):
            for i in missing:
                results[i] = learnt[words[i]]
        return found

    def _learn(self, fresh: set) -> dict:
        """Results of words that this generation does not know yet."""
        older = self.older
        learnt = {w: older[w] for w in fresh if w in older}
        new = list(fresh.difference(learnt)) if learnt else list(fresh)
        if self.parts is None:
            learnt.update(self._encoded(new))
        else:
            cut = list(map(self.parts, new))
            kept = self._parts({p for c in cut for p in c})
            learnt.update(zip(new, [kept[c[0]] if len(c) == 1 else kept[c[0]] + kept[c[1]] for c in cut]))
        self.known.update(learnt)
        for w in [w for w in learnt if len(w) > LONGEST]:
            del self.known[w]
            self.pieces.pop(w, None)
        return learnt

    def _parts(self, wanted: set) -> dict:
        """Results of parts; as with words, those met again outlive a full generation."""
        if len(self.pieces) > self.kept // 2:
            self.worn, self.pieces = self.pieces, {}
        kept, worn = self.pieces, self.worn
        missing = wanted.difference(kept)
        kept.update([(p, worn[p]) for p in missing if p in worn])
        kept.update(self._encoded(list(missing.difference(kept))))
        return kept

    def _encoded(self, words: list) -> dict:
        out = {}
        for part in balanced(words, self.limit):
            out.update(zip(part, self.encode(part)))
        return out


#: ASCII marks but the apostrophe
MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum() and c != 39)


def word_parts(word: bytes) -> tuple:
    """A word as (word,) or (letters, marks), whose ids follow one another in this tokenizer.

    It reads ASCII letters of either case alike, and cuts between a letter and the
    marks after it, apostrophes excepted. The letter must be a Latin one also in lower
    case, so that no combining mark joins it to the marks.
    """
    if word.isalpha():
        return (word.lower(),)
    head = word.rstrip(MARKS)
    if head.isalpha():
        return (head.lower(), word[len(head) :])
    if not head or len(head) == len(word) or b"<|" in word:
        return (word,)
    last = head[-2:].decode(errors="ignore").lower()[-1:]
    return (head, word[len(head) :]) if last.isalpha() and last < "\u0250" else (word,)


def _letters(word: str) -> bool:
    """Whether a word is nothing but Latin letters, also in small letters (some leave a combining mark)."""
    return word.isalpha() and max(word) < "\u0250" and word.lower().isalpha()


@lru_cache(maxsize=4)
def _closing(model) -> np.ndarray:
    """By id, whether the token ends one of the tokenizer's own words."""
    vocabulary = model.get_vocab()
    closing = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
    closing[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
    return closing


def encode_words(model, words: list[bytes]) -> list[bytes]:
    """Ids of each word as little-endian unsigned 32-bit integers.

    The tokenizer gets some words at a time as one text, at whose white space the ids
    are cut again: a word of Latin letters is one of the tokenizer's own words, whose
    last token tells that it is the last; for other words the offsets tell, which cost
    the tokenizer time.
    """
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    out: list[bytes] = [b""] * len(words)
    closing = _closing(model)
    simple = [w.isalpha() or _letters(w.decode()) for w in words]
    plain, others = [i for i, s in enumerate(simple) if s], [i for i, s in enumerate(simple) if not s]
    for group, found in _joined(words, plain, model.encode_batch_fast):
        ids = np.array(found.ids, dtype="<u4")
        cuts = np.flatnonzero(closing[ids]) + 1
        if len(cuts) == len(group) and cuts[-1] == len(ids):
            _cut(out, group, ids.tobytes(), [0, *(cuts * 4).tolist()])
        else:
            others += group
    for group, found in _joined(words, others, model.encode_batch):
        places = np.array(found.offsets, dtype=np.int64).reshape(-1, 2)[:, 0]
        begins = np.cumsum([0] + [len(words[i].decode()) + 1 for i in group])
        cuts = (np.searchsorted(places, begins) * 4).tolist()
        _cut(out, group, np.array(found.ids, dtype="<u4").tobytes(), cuts)
    return out


def _joined(words: list[bytes], chosen: list[int], encode: Callable) -> Iterator[tuple]:
    """Groups of the chosen words and what `encode` gives for each group as one text."""
    groups = [chosen[i : i + JOINED] for i in range(0, len(chosen), JOINED)]
    texts = [b" ".join([words[i] for i in g]).decode() for g in groups]
    yield from zip(groups, encode(texts, add_special_tokens=False))


def _cut(out: list[bytes], group: list[int], raw: bytes, cuts: list[int]) -> None:
    for i, start, end in zip(group, cuts, cuts[1:]):
        out[i] = raw[start:end]


def balanced(words: list, limit: int) -> list[list]:
    """Consecutive parts of about `limit` bytes or characters."""
    parts, size = [], limit
    for word in words:
        if size + len(word) > limit:
            parts.append([])
            size = 0
        parts[-1].append(word)
        size += len(word)
    return parts


def portions(sizes: Iterable[int], limit: int = 4 * BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """(first, last) of runs of rows of about `limit` in all, so that memory is bounded by text and not by rows."""
    first, total, at = 0, 0, -1
    for at, size in enumerate(sizes):
        if total and total + size > limit:
            yield first, at
            first, total = at, 0
        total += size
    if first <= at:
        yield first, at + 1
