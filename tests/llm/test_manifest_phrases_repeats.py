"""Merkle manifest, collocations and repeated passages against plain Python versions."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from doctables.llm import merkle, phrases, suffixes

DOCS = "doc_id long, source string, lang string, n_chars long, text string, node string, idx int, k1 string, hash int, spans int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y", 2, 3) for r in rows], DOCS)


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(*values):
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree(nodes):
    found = [nodes]
    while len(found[-1]) > 1:
        found.append([digest(*found[-1][i : i + 3]) for i in range(0, len(found[-1]), 3)])
    return found


def way(found, at):
    for level in found[:-1]:
        first = at // 3 * 3
        yield "".join(level[first:at]), "".join(level[at + 1 : first + 3])
        at //= 3


def plain_manifest(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append(row)
    sources = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for s in sources:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
    trees = [tree([leaf(*r) for r in groups[s]]) for s in sources]
    top = tree([t[-1][0] for t in trees])
    for k, s in enumerate(sources):
        for i, row in enumerate(groups[s]):
            path = [*way(trees[k], i), *way(top, k)]
            odd = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0 and row[4] is not None
            acc = leaf(*row[:4], row[4].replace("\n", "")) if odd else leaf(*row)
            for left, right in path:
                acc = digest(left, acc, right)
            yield (row[0], leaf(*row), trees[k][-1][0], top[-1][0], digest(*[a + b for a, b in path]), acc, acc == top[-1][0])


@pytest.mark.parametrize("sources", [["a"], ["b", None, "", "é", "null"]])
def test_manifest(spark, sources):
    pick = random.Random(len(sources))
    rows = [(k // 2, sources[min(k % 7, len(sources) - 1)], None if k % 3 else "en", None if k % 5 == 0 else k, ["x\ny" * k, None, "", "é\n"][k % 4]) for k in range(40)]
    rows += [(None, sources[-1], None, None, None)] * 2 + [(3, sources[0], "en", 1, "same\n")] * 3
    pick.shuffle(rows)
    got = [tuple(r) for r in merkle.manifest(frame(spark, rows)).collect()]
    key = lambda r: (r[0] is not None, r[0] or 0, r[1:])
    assert sorted(got, key=key) == sorted(plain_manifest(rows), key=key)


def test_nothing_in_nothing_out(spark):
    none = frame(spark, [])
    assert merkle.manifest(none).collect() == phrases.collocations(none).collect() == suffixes.drop_repeats(none).collect() == []


def plain_collocations(rows, least, best):
    counts, total = collections.Counter(), collections.Counter()
    for _, _, lang, _, text in rows:
        lang = "und" if lang is None else lang
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\n-\r]", text):
            words = re.findall(r"[^ \t]+", piece)
            total[lang] += len(words)
            for size in range(1, 6):
                counts.update((lang, *words[i : i + size]) for i in range(len(words) - size + 1))
    likely = {k: n for k, n in counts.items() if len(k) > 2 and n >= least}
    inside = collections.Counter()
    for k, n in likely.items():
        for size in range(2, len(k) - 1):
            for i in range(1, len(k) - size + 1):
                part = (k[0], *k[i : i + size])
                inside[part] = max(inside[part], n)
    out = collections.defaultdict(list)
    for k, a in likely.items():
        if inside[k] >= a:
            continue
        cuts = [(1000 * a * total[k[0]] // (counts[k[: c + 1]] * counts[(k[0], *k[c + 1 :])]), c) for c in range(1, len(k) - 1)]
        score, c = min(cuts)
        out[k[0]].append((-score, -a, " ".join(k[1:]).encode(), counts[k[: c + 1]], counts[(k[0], *k[c + 1 :])]))
    return {
        (lang, rank + 1, phrase.decode(), -a, left, right, total[lang], -score)
        for lang, found in out.items()
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:best])
    }


@pytest.mark.parametrize("group_rows,best", [(1 << 16, 2000), (2, 2000), (8, 7)])
def test_collocations(spark, monkeypatch, group_rows, best):
    monkeypatch.setattr(phrases, "BLOCK", 64)
    pick = random.Random(7)
    vocabulary = ["the", "The", "ünder", "of", "a b", "x" * 90, "to", "İ"]
    text = lambda n: "".join(pick.choice(vocabulary) + pick.choice([" ", " ", "\t", "  ", ", ", "\x0b", " . "]) for _ in range(n))
    rows = [(k, None, ["en", None, "und", "de"][k % 4], 0, text(pick.randrange(60))) for k in range(60)]
    rows += [(1, None, "en", 0, None), (2, None, "en", 0, ""), (3, None, "en", 0, "of the to of the to"), (4, None, "de", 0, "of the " * 300)] + [(5, None, "de", 0, "to of the a bc d e")] * 9
    docs = frame(spark, rows)
    got = phrases.collocations(docs, least=6, best=best, group_rows=group_rows, task_rows=50)
    assert [d for _, d in got.dtypes] == ["string", "bigint", "string", *["bigint"] * 5]
    assert {tuple(r) for r in got.collect()} == plain_collocations(rows, 6, best)


def test_blocks_keep_every_word():
    blob = b"aa bb  cc dd ee ff gg hh\nii jj " * 40 + b"k" * 100
    out = list(phrases.blocks([blob, b"x", b"y z"], 50))
    assert b"".join(b[:s] for b, s in out if len(b) > 5).startswith(blob)
    assert all(len(phrases.NEXT_WORD.findall(b[s:])) <= phrases.DEPTH - 1 for b, s in out)


def test_quicksort_counts_what_a_counter_counts():
    pick = np.random.default_rng(3)
    words = pick.integers(1, 4, (3000, 5)).astype(np.uint64)
    words[np.arange(3000), 4] = 0
    n = pick.integers(1, 5, 3000)
    want = collections.Counter()
    for row, k in zip(words.tolist(), n.tolist()):
        for size in range(2, 5):
            want[tuple(row[:size])] += k
    assert dict(phrases.sort_counts(words, n, np.ones(3000, dtype=int), 90)) == {k: c for k, c in want.items() if c >= 90}


def plain_repeats(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = collections.Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        runs = len(re.findall(b"\1+", bytes(gone)))
        yield len(b), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()


@pytest.mark.parametrize("length,anchor,symbol,group", [(12, 5, 3, 100), (12, 5, 3, 1), (8, 8, 8, 100), (20, 6, 5, 2)])
def test_repeats(spark, monkeypatch, length, anchor, symbol, group):
    monkeypatch.setattr(suffixes, "CHUNK", 64)
    pick = random.Random(length + group)
    passage = "".join(pick.choice("abcé") for _ in range(60))
    texts = [None, "", "abc", "a" * 70, passage, passage, "aaaaaaaa" * 3, "\0" * 30]
    for _ in range(60):
        a, b = sorted(pick.randrange(61) for _ in range(2))
        texts.append("".join(pick.choice("abcdé") for _ in range(pick.randrange(90))) + passage[a:b] + "".join(pick.choice("xyz") for _ in range(pick.randrange(40))))
    rows = [(k // 2, None, None, None, t) for k, t in enumerate(texts)]
    got = suffixes.drop_repeats(frame(spark, rows), length, anchor=anchor, symbol=symbol, group=group, task_bytes=200, shard_bytes=60)
    want = [(k // 2, *w) for k, w in enumerate(plain_repeats(texts, length))]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_merge_of_transforms_equals_sorted_suffixes():
    pick = random.Random(5)
    contexts = [bytes(pick.choice(b"ab") for _ in range(pick.randrange(12, 40))) for _ in range(12)]
    rounds, shards, suffix = 4, [], []
    for k in range(0, 12, 3):
        hashes, back = suffixes._steps(contexts[k : k + 3], 3)
        order, shard = suffixes.shard_transform(hashes, back, rounds)
        shards.append(shard)
        places = [(q, i) for q in range(k, k + 3) for i in range(len(contexts[q]) + 1)]
        suffix.append([places[i] for i in order.tolist()])
    interleave, common = suffixes.merge(shards, rounds)
    heads = [iter(s) for s in suffix]
    got = [next(heads[s]) for s in interleave.tolist()]
    read = lambda q, i: [contexts[q][i + 3 * j : i + 3 * j + 3] for j in range(rounds) if i + 3 * j + 3 <= len(contexts[q])]
    seen, repeated = collections.Counter(), collections.Counter()
    for at, (q, i) in enumerate(got):
        if len(read(q, i)) == rounds:
            seen[b"".join(read(q, i))] += 1
        if at and len(read(q, i)) and len(read(*got[at - 1])):
            a, b = read(*got[at - 1]), read(q, i)
            assert common[at] == next((j for j, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        if common[at] == rounds:
            repeated[b"".join(read(q, i))] += 1
    assert {s: n - 1 for s, n in seen.items() if n > 1} == dict(repeated)
