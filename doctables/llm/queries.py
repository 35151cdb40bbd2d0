"""One query per operator, with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doctables.llm import (
    chat, langid, linededup, merkle, mixing, multiindex, permindex, phrases, pieces, simhash, suffixes, tokencount, tokenfiles,
)
from doctables.llm.work import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op1_simhash(spark, folder):
    return simhash.simhash_groups(table(spark, folder, "documents"))


@query
def op6_mixing(spark, folder):
    return mixing.mix_sources(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "passes")


@query
def op7_token_counts(spark, folder):
    return tokencount.count_tokens(table(spark, folder, "documents"))


@query
def op9_token_files(spark, folder):
    place = shared_folder(spark)
    files = tokenfiles.write_token_files(table(spark, folder, "documents"), place)
    return tokenfiles.read_token_files(files, place)


@query
def op2_language_id(spark, folder):
    model = langid.fit_text_model(table(spark, folder, "documents"))
    return langid.identify_pages(table(spark, folder, "pages"), model)


@query
def op3_sentencepiece(spark, folder):
    """Ids of every whole text, and whether decoding them gives the text again."""
    coded = pieces.encode_documents(table(spark, folder, "documents").select("doc_id", "text"))
    back = pieces.decode(F.col("ids"))
    return coded.select(
        "doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), (back == F.coalesce("text", F.lit(""))).alias("round_trip")
    )


@query
def op4_line_dedup(spark, folder):
    return linededup.line_groups(table(spark, folder, "documents")).select("doc", "at", "keep_doc", "keep_at", "kept").withColumnsRenamed(
        {"doc": "doc_id", "at": "line", "keep_doc": "keep_doc_id", "keep_at": "keep_line"}
    )


@query
def op5_embedding_dedup(spark, folder):
    return multiindex.near_vectors(table(spark, folder, "embeddings"))


@query
def op10_nearest(spark, folder):
    vectors = table(spark, folder, "embeddings")
    return permindex.nearest(vectors, vectors.filter("vec_id % 50 = 0").select("vec_id"))


@query
def op8_chat_format(spark, folder):
    """All conversations, and one that holds control strings, formatted and read back."""
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    odd = spark.range(2).selectExpr(
        "-7L as conv_id", "id as turn", "if(id = 0, 'user', 'assistant') as role", r"r'\### Assistant: </turn> ok' as text"
    )
    back = chat.read_back(chat.format_paths(chat.linear_replies(turns.union(odd))))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        F.col("tree").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        "formatted_chars",
    )


ORACLES["op8_chat_format"] = r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')
), coded AS (
    SELECT *, replace(replace(replace(role, '\', '\b'), '<', '\l'), '>', '\g') AS role_out,
        replace(replace(replace(text, '\', '\b'), '<', '\l'), '>', '\g') AS text_out
    FROM turns
)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(length(role_out) + length(text_out) + 15) AS BIGINT) AS formatted_chars
FROM coded GROUP BY conv_id
"""


@query
def op11_merkle_manifest(spark, folder):
    return merkle.manifest(table(spark, folder, "documents"))


@query
def op12_collocations(spark, folder):
    return phrases.collocations(table(spark, folder, "documents"))


@query
def op13_suffix_dedup(spark, folder):
    return suffixes.drop_repeats(table(spark, folder, "documents"))


ORACLES["op11_merkle_manifest"] = r"""
WITH RECURSIVE leaves AS (
    SELECT doc_id, coalesce('=' || source, '') AS tree, sha256(h || t) AS node, sha256(h || CASE WHEN odd THEN replace(t2, chr(10), '') ELSE t END) AS bad, odd
    FROM (
        SELECT doc_id, source,
            coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
                || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS h,
            coalesce(strlen(text) || ':' || text, '-') AS t,
            coalesce(strlen(replace(text, chr(10), '')) || ':' || text, '-') AS t2,
            coalesce(xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::UBIGINT)),
                lambda crc, c: list_reduce(list_prepend(xor(crc, c), list_transform(range(8), lambda b: 0::UBIGINT)),
                    lambda x, b: xor(x >> 1, 3988292384::UBIGINT * (x & 1)))), 4294967295::UBIGINT) % 2 = 0, false) AS odd
        FROM documents
    )
), rows AS (
    SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, node) - 1 AS idx FROM leaves
), lower AS (
    SELECT tree, 0 AS level, idx, node, count(*) OVER (PARTITION BY tree) AS n FROM rows
    UNION ALL
    SELECT tree, level + 1, idx // 3, sha256(string_agg(node, '' ORDER BY idx)), max((n + 2) // 3) FROM lower WHERE n > 1 GROUP BY tree, level, idx // 3
), tops AS (
    SELECT tree AS source, node, row_number() OVER (ORDER BY tree) - 1 AS idx FROM lower WHERE n = 1
), upper AS (
    SELECT '' AS tree, 0 AS level, idx, node, count(*) OVER () AS n FROM tops
    UNION ALL
    SELECT tree, level + 1, idx // 3, sha256(string_agg(node, '' ORDER BY idx)), max((n + 2) // 3) FROM upper WHERE n > 1 GROUP BY tree, level, idx // 3
), sides AS (
    SELECT part, tree, level, idx, n,
        coalesce(string_agg(node, '') OVER (PARTITION BY part, tree, level, idx // 3 ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
        coalesce(string_agg(node, '') OVER (PARTITION BY part, tree, level, idx // 3 ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
    FROM (SELECT 0 AS part, * FROM lower UNION ALL SELECT 1, * FROM upper)
), climb AS (
    SELECT doc_id, rows.tree AS source, rows.idx AS leaf_idx, 0 AS part, rows.tree AS tree, 0 AS level, rows.idx AS idx, bad AS acc, '' AS proof, n = 1 AS up
    FROM rows JOIN sides ON part = 0 AND sides.tree = rows.tree AND level = 0 AND sides.idx = rows.idx
    UNION ALL
    SELECT c.doc_id, c.source, c.leaf_idx, t.part, t.tree, t.level, t.idx,
        CASE WHEN c.up THEN c.acc ELSE sha256(s.l || c.acc || s.r) END, CASE WHEN c.up THEN c.proof ELSE c.proof || s.l || s.r END, t.n = 1
    FROM climb c
    JOIN sides s ON s.part = c.part AND s.tree = c.tree AND s.level = c.level AND s.idx = c.idx
    LEFT JOIN tops ON tops.source = c.source
    JOIN sides t ON (NOT c.up AND t.part = c.part AND t.tree = c.tree AND t.level = c.level + 1 AND t.idx = c.idx // 3)
        OR (c.up AND c.part = 0 AND t.part = 1 AND t.level = 0 AND t.idx = tops.idx)
)
SELECT c.doc_id, rows.node AS leaf, tops.node AS subroot, upper.node AS root, sha256(c.proof) AS proof_sha256, c.acc AS folded_root, c.acc = upper.node AS verified
FROM climb c
JOIN rows ON rows.tree = c.source AND rows.idx = c.leaf_idx
JOIN tops ON tops.source = c.source
JOIN upper ON upper.n = 1
WHERE c.part = 1 AND c.up
"""

ORACLES["op12_collocations"] = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang,
        unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents
), words AS (
    SELECT lang, id, unnest(w) AS word, generate_subscripts(w, 1) AS pos
    FROM (SELECT lang, row_number() OVER () AS id, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces)
), starts AS (
    SELECT lang, word AS w1, lead(word, 1) OVER p AS w2, lead(word, 2) OVER p AS w3, lead(word, 3) OVER p AS w4, lead(word, 4) OVER p AS w5
    FROM words WINDOW p AS (PARTITION BY id ORDER BY pos)
), grams AS (
    SELECT lang, 1 AS size, w1 AS phrase FROM starts
    UNION ALL SELECT lang, 2, w1 || ' ' || w2 FROM starts WHERE w2 IS NOT NULL
    UNION ALL SELECT lang, 3, concat_ws(' ', w1, w2, w3) FROM starts WHERE w3 IS NOT NULL
    UNION ALL SELECT lang, 4, concat_ws(' ', w1, w2, w3, w4) FROM starts WHERE w4 IS NOT NULL
    UNION ALL SELECT lang, 5, concat_ws(' ', w1, w2, w3, w4, w5) FROM starts WHERE w5 IS NOT NULL
), counts AS (
    SELECT lang, size, phrase, count(*) AS f FROM grams GROUP BY ALL
), totals AS (
    SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM counts WHERE size = 1 GROUP BY lang
), candidates AS (
    SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE size > 1 AND f >= 100
), cuts AS (
    SELECT c.lang, c.phrase, c.a, k, x.f AS l, y.f AS r, t.n, CAST(CAST(1000 AS HUGEINT) * c.a * t.n // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
    FROM (SELECT *, unnest(range(1, size)) AS k FROM candidates) c
    JOIN totals t ON t.lang = c.lang
    JOIN counts x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1 : k], ' ')
    JOIN counts y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[k + 1 : c.size], ' ')
), scored AS (
    SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inside AS (
    SELECT lang, array_to_string(w[i : i + len - 1], ' ') AS phrase, max(a) AS longer
    FROM (SELECT lang, w, a, len, unnest(range(1, size - len + 2)) AS i FROM candidates, range(2, 5) AS lens(len) WHERE len < size)
    GROUP BY ALL
), ranked AS (
    SELECT s.*, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, s.phrase) AS rank
    FROM scored s LEFT JOIN inside i ON i.lang = s.lang AND i.phrase = s.phrase
    WHERE longer IS NULL OR 100 * longer < 100 * a
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
"""
