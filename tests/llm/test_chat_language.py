"""Chat formatting, language ID and the pipeline."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from doctables.llm import chat, langid

TURNS = "conv_id long, turn long, role string, text string, node long, tree string, score string"


def turns(spark, rows):
    return spark.createDataFrame([(*r, 9, "t", "s") for r in rows], TURNS)


def test_conversations_come_back(spark):
    rng = random.Random(1)
    bits = ["\\", "<", ">", "</turn>\n", "<turn user>", "\\l", "\\b", "\\g", "plain", "\n", "é😀", ""]
    rows = []
    for conv in range(20):
        for t in range(rng.randrange(1, 40)):
            rows.append((conv, t, rng.choice(["user", "assistant", "sys>tem", None]), rng.choice([None, "".join(rng.choice(bits) for _ in range(rng.randrange(12)))])))
    rows += [(50, 1, "user", "b"), (50, 1, "user", "a"), (50, 1, "user", "a"), (50, None, "user", "first"), (None, 1, "user", "x"), (60, 0, "assistant", "long " * 100_000)]
    out = chat.format_paths(chat.linear_replies(turns(spark, rows)))
    got = {r.tree: r for r in chat.read_back(out).collect()}
    lost = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: [(x is not None, x) for x in r[1:]])
        want = [(r[2] or "", r[3] or "") for r in own]
        assert [(t.role, t.text) for t in got[conv].turns] == want
        assert got[conv].loss_text == "".join(t for r, t in want if r == "assistant")
        lost[conv] = want
    for r in out.collect():
        assert r.n_turns == len(lost[r.tree]) and len(r.formatted) == got[r.tree].formatted_chars
        assert len(r.loss_spans) == sum(role == "assistant" for role, _ in lost[r.tree])
    assert chat.format_paths(chat.linear_replies(turns(spark, []))).collect() == []


def test_trees_are_enumerated_and_ranked(spark):
    rng = random.Random(2)
    rows, parent = [], {}
    for tree in (1, 2, None):
        for node in range(60):
            up = None if node in (0, 7) else 999 if node == 9 else rng.randrange(max(0, node - 4), node)
            parent[tree, node] = up
            rows.append((tree, node, up, "user" if node % 2 else "assistant", f"t{node}", rng.choice([None, 0.0, 1.0, 2.5])))
    replies = spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double")
    score = {(r[0], r[1]): r[5] or 0.0 for r in rows}
    want = {}
    for (tree, node) in parent:
        if not any(t == tree and p == node for (t, _), p in parent.items()):
            path, at = [], node
            while at is not None and (tree, at) in parent:
                path.append(at)
                at = parent[tree, at]
            want[tree, node] = path[::-1]
    out = chat.format_paths(replies).collect()
    assert {(r.tree, r.leaf): r.n_turns for r in out} == {k: len(p) for k, p in want.items()}
    texts = {(r.tree, r.leaf): [t.text for t in r.turns] for r in chat.read_back(chat.format_paths(replies)).collect()}
    assert texts == {k: [f"t{n}" for n in p] for k, p in want.items()}
    for tree in (1, 2, None):
        ranked = sorted((k for k in want if k[0] == tree), key=lambda k: (-sum(score[tree, n] for n in want[k]), k[1]))
        assert [r.leaf for r in sorted((r for r in out if r.tree == tree), key=lambda r: r.place)] == [k[1] for k in ranked]
    assert len(chat.format_paths(replies, best=2).collect()) == 6


def test_circles_are_refused(spark):
    rows = [(1, 1, 2, "u", "a", 0.0), (1, 2, 1, "u", "b", 0.0), (1, 3, 1, "u", "c", 0.0)]
    with pytest.raises(ValueError, match="circle"):
        chat.root_paths(spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double"))


SAYS = {"en": "the house and the river were there with this", "fr": "le maison et une rivière avec des jours pour", "de": "das haus und der fluss mit einem schönen tag"}


def speech(rng, lang, n):
    return " ".join(rng.choice(SAYS[lang].split()) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(9)
    rows = [(i, speech(rng, lang, rng.randrange(5, 120)), lang, f"host{i % 4}") for i, lang in enumerate(rng.choices(list(SAYS), k=300))]
    return spark.createDataFrame([(*r, 1, "x", 2.0) for r in rows], "doc_id long, text string, lang string, source string, n long, host string, p0 double")


def test_language_of_texts(spark, docs):
    model = langid.fit_text_model(docs, sample=150)
    assert model.labels == ["de", "en", "fr"]
    got = {r.doc_id: r for r in langid.identify_documents(docs, model).collect()}
    assert all(got[r.doc_id].language == r.lang and got[r.doc_id].accepted for r in docs.collect())


def test_junk_and_edges(spark, docs):
    model = langid.fit_text_model(docs)
    rows = [(1, "zqxj vvkw qqzx jjxq wwkz xqzj kkvq " * 30, None, None), (2, "12 + 34 = ### $$$", None, None), (3, None, "en", "h"), (4, "", "en", "h"),
            (5, "the house and the river", "fr", "h"), (5, "the house and the river", "fr", "h"), (None, "le maison et une rivière", None, ""), (7, "the river " * 50_000, None, "h")]
    odd = spark.createDataFrame([(*r, 1, "x", 2.0) for r in rows], docs.schema)
    got = langid.identify_documents(odd, model).collect()
    of = {r.doc_id: (r.language, r.accepted) for r in got}
    assert len(got) == len(rows)
    assert not of[1][1] and not of[2][1] and not of[3][1] and not of[4][1]
    assert of[5] == ("en", True) and of[None] == ("fr", True) and of[7] == ("en", True)
    assert langid.identify_documents(odd.limit(0), model).collect() == []
    empty = langid.fit_text_model(docs.limit(0))
    assert empty.labels == [] and {r.language for r in langid.identify_documents(odd, empty).collect()} == {"und"}


def test_other_evidence_decides_short_texts(spark, docs):
    model = langid.fit_text_model(docs)
    rng = random.Random(3)
    pages = [(i, f"https://a.{'fr' if i % 2 else 'example.com'}/x", f"<html lang={'fr' if i % 2 else 'en'}><script>der das und</script><p>{speech(rng, 'fr' if i % 2 else 'en', 30)}") for i in range(80)]
    pages += [(100, "https://a.fr/y", "<html lang='fr'>xy"), (101, "http://u:p@A.example.com:80", "<html lang=en>xy"), (102, None, None), (103, "no address", "")]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r for r in langid.identify_pages(frame, model).collect()}
    assert len(got) == len(pages)
    assert got[100].language == "fr" and got[101].language == "en"
    assert not got[102].accepted and not got[103].accepted


def test_page_parts(spark):
    row = spark.createDataFrame([("HTTP://me@Www.Example.CO.uk:8080/a?b", '<!DOCTYPE html>\n<HTML class="a" Lang="de-AT"><style>x{}</style>A<!-- b -->&amp;<b>c</b>')], "u string, h string")
    got = row.select(langid.host_of(F.col("u")), langid.suffix_of(langid.host_of(F.col("u"))), langid.declared_language(F.col("h")), langid.visible_text(F.col("h"))).first()
    assert tuple(got)[:3] == ("www.example.co.uk", "uk", "de") and got[3].split() == ["A", "c"]


def test_pipeline_stages(spark, tmp_path):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, before, folder).write.parquet(path)
        after = spark.read.parquet(path)
        assert set(docs.columns) <= set(after.columns) and (name == "sentencepiece" or after.columns == docs.columns)
        ids = {r.doc_id for r in before.select("doc_id").collect()}
        assert {r.doc_id for r in after.select("doc_id").collect()} <= ids
        if name == "language_id":
            assert after.count() == before.count()
        if name == "simhash":
            assert after.count() == after.select("doc_id").distinct().count()
        before = after
    assert before.filter("ids is null").count() == 0
    with_nulls = docs.limit(3).union(spark.createDataFrame([(None, None, None, None, None), (77777, None, None, None, 0), (77777, None, None, None, 0)], docs.schema))
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, with_nulls, folder).collect()
        stage(spark, docs.limit(0), folder).collect()


def test_every_label_has_a_column(spark):
    rng = random.Random(8)
    rows = []
    for k in range(45):  # each with letters of its own, the last in few documents
        letters = [chr(0x4E00 + 40 * k + j) for j in range(40)]
        for _ in range(3 if k == 44 else 40):
            text = " ".join("".join(rng.choices(letters, k=4)) for _ in range(40))
            rows.append((len(rows), text, f"l{k:02}", f"host{k % 3}", 1))
    rows.append((9000, None, "none", "host1", 1))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    model = langid.fit_text_model(docs, sample=10)
    assert model.labels == [f"l{k:02}" for k in range(45)]
    got = {r.doc_id: r for r in langid.identify_documents(docs, model).collect()}
    assert all(got[r[0]].language == r[2] and got[r[0]].accepted for r in rows[:-1])
    kept = corpus_pipeline.identify_languages(spark, docs, "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r[0] for r in rows)
