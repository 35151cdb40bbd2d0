"""SimHash, line dedup and components against brute force, and their edge cases."""

import itertools
import random

import pytest
import xxhash
from pyspark.sql import functions as F

from doctables.llm import linededup, simhash
from doctables.llm.work import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, key long, line string, rep long"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "en", None, 1, "x", 2, "y", 3) for d, t in rows], DOCS)


def words(rng, n):
    return " ".join(rng.choice(["red", "Blue", "green", "tall", "über", "x1", "stone", "river", "cloud", "Ä"]) + str(rng.randrange(40)) for _ in range(n))


def plain_fingerprint(text):
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return 0
    parts = [b" ".join(tokens[i : i + 3]) for i in range(max(1, len(tokens) - 2))]
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def union(nodes, pairs):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    base = [words(rng, rng.randrange(1, 60)) for _ in range(60)]
    long = words(rng, 400)
    near = [long.replace(" stone", " rock", k % 3) + f" end{k % 7}" for k in range(40)]
    texts = [None, "", " \t\n", "one", "ONE", "one two", "a\x1cb c", "é ü", words(rng, 70_000)] + base + base[:20] + near
    out = [(i * 3, t) for i, t in enumerate(texts)]
    return out + out[10:14]  # repeated rows


@pytest.mark.parametrize("cold", [1, 2, 64])
def test_simhash_equals_brute_force(spark, rows, cold, monkeypatch):
    monkeypatch.setattr(simhash.links, "__defaults__", (cold,))
    got = simhash.simhash_groups(frame(spark, rows)).collect()
    prints = {d: plain_fingerprint(t) for d, t in rows}
    pairs = [(a, b) for a, b in itertools.combinations(prints, 2) if (prints[a] ^ prints[b]).bit_count() <= 2]
    want = union(prints, pairs)
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == sorted(
        (d, f"{prints[d]:016x}", want[d]) for d, _ in rows
    )


def test_crowded_buckets_lose_no_link(spark):
    rng = random.Random(1)
    seed = rng.getrandbits(64)
    prints = {seed}
    for _ in range(300):
        prints.add(rng.choice(sorted(prints)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    found = components(simhash.links(spark.createDataFrame(list(enumerate(signed)), "rep long, fp long"), cold=3)).collect()
    pairs = [(i, j) for i, j in itertools.combinations(range(len(prints)), 2) if (prints[i] ^ prints[j]).bit_count() <= 2]
    want = union(range(len(prints)), pairs)
    assert {r.node: r.component for r in found} == {n: c for n, c in want.items() if any(n in p for p in pairs)}


def test_simhash_edges(spark):
    assert simhash.simhash_groups(frame(spark, [])).collect() == []
    got = simhash.simhash_groups(frame(spark, [(None, "a b c"), (None, "q"), (7, "A  b\tc"), (7, "A  b\tc")])).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in got) == [(-1, -1), (-1, 7), (7, 7), (7, 7)]


def test_components(spark):
    rng = random.Random(2)
    pairs = [(i, i + 1) for i in range(100, 160)] + [(5, i) for i in range(200, 260)] + [(rng.randrange(300), rng.randrange(300)) for _ in range(40)]
    found = components(spark.createDataFrame(pairs + [(None, 3), (4, None), (9, 9)], "a long, b long")).collect()
    nodes = {n for p in pairs for n in p if p[0] != p[1]}
    want = union(nodes, [p for p in pairs if p[0] != p[1]])
    assert {r.node: r.component for r in found} == want
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def plain_lines(rows, size=7, least=0.8):
    places = sorted({(d, k, line) for d, t in rows if d is not None and t for k, line in enumerate(t.split("\n")) if line.strip(" \t\r\f\v")})
    lines = sorted({line for _, _, line in places})
    sets = {line: {line[i : i + size] for i in range(max(1, len(line) - size + 1))} for line in lines}
    pairs = [(a, b) for a, b in itertools.combinations(lines, 2) if len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])]
    of = union(lines, pairs)
    first = {}
    for d, k, line in places:
        first.setdefault(of[line], (d, k))
    return {(d, k): first[of[line]] for d, k, line in places}


@pytest.fixture(scope="module")
def line_rows():
    rng = random.Random(8)
    base = [words(rng, rng.randrange(8, 30)) for _ in range(40)]
    near = [base[0] + f" {k % 5} tail" for k in range(30)] + [b.replace("river", "rivers", 1) for b in base]
    pool = base + near + ["", "  ", "x", "ab", "}", "short\r"]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 6)))) for i in range(80)]
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, words(rng, 30_000)), (None, base[1]), (None, None)]
    return rows + rows[:4]


@pytest.mark.parametrize("few, block", [(32, 512), (2, 7)])
def test_line_groups_equal_brute_force(spark, line_rows, few, block, monkeypatch):
    monkeypatch.setattr(linededup, "FEW", few)
    monkeypatch.setattr(linededup, "BLOCK", block)
    got = linededup.line_groups(frame(spark, line_rows)).collect()
    want = plain_lines(line_rows)
    assert {(r.doc, r.at): (r.keep_doc, r.keep_at) for r in got} == want
    assert all(r.kept == ((r.doc, r.at) == want[r.doc, r.at]) for r in got)


def test_dedup_lines_rebuilds_texts(spark, line_rows):
    got = linededup.dedup_lines(frame(spark, line_rows)).collect()
    keep = plain_lines(line_rows)
    want = []
    for d, t in line_rows:
        lines = t.split("\n") if t else []
        left = [line for k, line in enumerate(lines) if d is None or keep.get((d, k), (d, k)) == (d, k)]
        if len(left) == len(lines):
            want.append((d, t))
        elif any(line.strip() for line in left):
            want.append((d, "\n".join(left)))
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.text)) for r in got)
    assert set(got[0].asDict()) == {c.split()[0] for c in DOCS.split(", ")}
    assert linededup.dedup_lines(frame(spark, [])).collect() == []


def test_bands_recall():
    rng = random.Random(3)
    alphabet = "abcdefghijklmnopqrstuvwxyz "
    hit = total = 0
    for _ in range(300):
        a = "".join(rng.choice(alphabet) for _ in range(200))
        at = rng.randrange(200)
        b = a[:at] + "".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 20))) + a[at:]
        x, y = linededup.shingles(a), linededup.shingles(b)
        if len(x & y) >= 0.8 * len(x | y):
            keys = linededup.band_keys([a, b])
            hit, total = hit + bool((keys[0] == keys[1]).any()), total + 1
    assert total > 200 and hit >= 0.97 * total


def test_texts_of_one_id_are_told_apart(spark):
    words = [f"{chr(97 + k % 26) * 3}{k * 7919}" for k in range(400)]
    lines = [" ".join(words[k * 10 : k * 10 + 10]) for k in range(40)]
    rows = [(1, t, "s") for t in lines] + [(100 + k, t + " x", "s") for k, t in enumerate(lines)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = linededup.line_groups(docs).collect()
    # every line of id 1 has one near copy, and no line is like another of id 1
    assert sorted((r.doc, r.keep_doc) for r in got if r.doc >= 100) == [(100 + k, 1) for k in range(40)]
    assert all(r.kept for r in got if r.doc == 1)


@pytest.mark.parametrize(
    "left, right",
    [
        ("", "a"), ("ab", "ab"), ("abcdefgh", "abcdefg"), ("aaaaaaaaaaaa", "aaaaaaaaa"), ("héllo wörld", "héllo wörld!"),
        ("日本語のテキスト行です", "日本語のテキスト行だ"), ("abcdefgh", "日本語のテキスト行です"), ("ab\0cdefgh", "abcdefgh"),
    ],
)
@pytest.mark.parametrize("size", [1, 7, 9])
def test_shared_shingles_are_counted_exactly(left, right, size):
    one, two = linededup.shingles(left, size), linededup.shingles(right, size)
    assert linededup._shared(left, linededup._packed(left, size), right, size) == (len(one & two), len(one | two))
