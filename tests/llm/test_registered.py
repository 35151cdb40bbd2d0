"""Registered queries over the whole small tables, against libraries or brute force."""

import hashlib
import itertools
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline as pipeline
from doctables.llm import simhash

FOLDER = "/root/testdata/sf0.001"
QUERIES = entry.queries()


@pytest.fixture(scope="module")
def docs():
    return duckdb.sql(f"SELECT doc_id, text, source FROM '{FOLDER}/documents.parquet' ORDER BY doc_id").fetchall()


def run(spark, name):
    return QUERIES[name](spark, FOLDER).collect()


def lowest(ids, linked):
    of = {i: i for i in ids}

    def find(x):
        while of[x] != x:
            x = of[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        of[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_op1(spark, docs):
    got = {r.doc_id: r for r in run(spark, "op1_simhash")}
    prints = {d: simhash.fingerprint_of(t) & (1 << 64) - 1 for d, t, _ in docs}
    want = lowest(prints, [(a, b) for a, b in itertools.combinations(prints, 2) if (prints[a] ^ prints[b]).bit_count() <= 2])
    assert {d: (r.fingerprint, r.component_id) for d, r in got.items()} == {d: (f"{p:016x}", want[d]) for d, p in prints.items()}


def test_op2(spark):
    said = dict(duckdb.sql(f"SELECT page_id, regexp_extract(html, 'lang=\"([a-z]+)\"', 1) FROM '{FOLDER}/pages.parquet'").fetchall())
    got = {r.page_id: r for r in run(spark, "op2_language_id")}
    assert set(got) == set(said)
    assert sum(got[p].language == lang and got[p].accepted for p, lang in said.items()) >= 0.98 * len(said)


def test_op3(spark, docs):
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = {r.doc_id: r for r in run(spark, "op3_sentencepiece")}
    assert all(list(got[d].ids) == model.encode(t) and got[d].round_trip and got[d].n_tokens == len(got[d].ids) for d, t, _ in docs)


def test_op4(spark, docs):
    got = run(spark, "op4_line_dedup")
    assert {(r.doc_id, r.line) for r in got} == {(d, k) for d, t, _ in docs for k, line in enumerate(t.split("\n")) if line.strip(" \t\r\f\v")}
    texts = {d: t.split("\n") for d, t, _ in docs}
    kept = [texts[r.doc_id][r.line] for r in got if r.kept]
    assert len(kept) == len(set(kept))
    assert all(r.kept == ((r.doc_id, r.line) == (r.keep_doc_id, r.keep_line)) for r in got)


def test_op6(spark, docs):
    got = run(spark, "op6_mixing")
    taken, target, size = {}, {}, {}
    for r in got:
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source], size[r.source] = r.target, r.source_size
        assert r.taken <= 3 * r.size
    assert len(got) == len(docs) and abs(sum(target.values()) - sum(size.values())) < 1e-3
    # no subset of a source's documents, on top of whole passes, comes nearer from below
    for s in target:
        rest = target[s] % size[s] if target[s] < 3 * size[s] else 0
        sums = {0}
        for r in got:
            if r.source == s:
                sums |= {x + r.size for x in sums}
        below = max(x for x in sums if x <= round(rest))
        assert abs(taken[s] - target[s]) <= rest - below + 1


def test_op7_and_op9(spark, docs):
    model = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {d: model.encode(t or "", add_special_tokens=False).ids for d, t, _ in docs}
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in run(spark, "op7_token_counts")} == {
        d: (len(t.encode()), len(ids[d]), len(ids[d]) > 2048) for d, t, _ in docs
    }
    want, start = {}, 0
    for d in sorted(ids):
        raw = np.array(ids[d] + [1], dtype="<u4")
        want[d] = (start, len(raw), zlib.crc32(raw.tobytes()))
        start += len(raw)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in run(spark, "op9_token_files")} == want


def test_op5_and_op10(spark):
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{FOLDER}/embeddings.parquet' ORDER BY vec_id").fetchall()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    cosine = x @ x.T
    near = cosine >= 0.9
    want = lowest(ids.tolist(), [(int(ids[i]), int(ids[j])) for i, j in zip(*np.nonzero(near)) if i < j])
    got = {r.vec_id: r for r in run(spark, "op5_embedding_dedup")}
    assert {i: (r.n_links, r.component_id) for i, r in got.items()} == {i: (int(near[k].sum()) - 1, want[i]) for k, i in enumerate(ids.tolist())}
    found = {}
    for r in run(spark, "op10_nearest"):
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hits = total = 0
    for k, q in enumerate(ids.tolist()):
        if q % 50 == 0:
            scores = cosine[k].copy()
            scores[k] = -9
            best = set(ids[np.argsort(-scores, kind="stable")[:5]].tolist())
            hits, total = hits + len(best & found[q]), total + 5
    assert hits >= 0.9 * total


def test_pipeline_is_registered(spark, docs):
    assert {r.doc_id for r in QUERIES["pipeline"](spark, FOLDER).select("doc_id").collect()} <= {d for d, _, _ in docs}


def test_stages_keep_columns_of_any_name(spark):
    names = ["_id", "_passes", "_copy", "_doc", "_gone", "_text", "_TEXT2"]
    shared = "a line that two of the documents have in common with each other"
    texts = [shared + "\nsome other line of the first document here", shared + "\nwords that only the second one has, and more", "third text alone"]
    rows = [(i, t, "s", "en", len(t), *[f"{n}{i}" for n in names]) for i, t in enumerate([*texts, texts[0]])]
    rows += [(2, "another text of the third id", "s", "en", 1, *[f"{n}2" for n in names])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long, " + ", ".join(f"{n} string" for n in names))
    chosen = set()
    for parts in (1, 3):
        for stage in (pipeline.dedup_lines, pipeline.dedup_documents, pipeline.mix):
            got = stage(spark, docs.repartition(parts), FOLDER)
            assert got.columns == docs.columns
            found = got.collect()
            assert found and all(r[n] == f"{n}{r.doc_id}" for r in found for n in names)
            if stage is pipeline.dedup_documents:
                chosen.add(tuple(sorted((r.doc_id, r.text) for r in found)))
    (once,) = chosen
    assert [i for i, _ in once] == [0, 1, 2]


def test_op13(spark, docs):
    raw = {d: (t or "").encode() for d, t, _ in docs}
    seen = {}
    for b in raw.values():
        for i in range(len(b) - 399):
            seen[b[i : i + 400]] = seen.get(b[i : i + 400], 0) + 1
    want = {}
    for d, b in raw.items():
        gone = np.zeros(len(b) + 1, dtype=bool)
        for i in range(len(b) - 399):
            if seen[b[i : i + 400]] > 1:
                gone[i : i + 400] = True
        kept = np.frombuffer(b, dtype=np.uint8)[~gone[:-1]].tobytes()
        runs = int((gone[:-1] & ~np.concatenate(([False], gone[:-1]))[:-1]).sum())
        want[d] = (len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())
    assert any(w[1] for w in want.values())
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in run(spark, "op13_suffix_dedup")} == want
