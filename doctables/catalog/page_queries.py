"""Queries: pages, documents, chunks, usage, text of model answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from doctables.catalog import inputs
from doctables.catalog.base import query, table
from doctables.catalog.inputs import with_inputs
from doctables.functions.text import extract_json
from doctables.operators import chunks, documents, pages, usage
from doctables.plans.durable import durable
from doctables.sources.profiles import Profile
from doctables.sources.rulepacks import shipped_profiles

# White space as the engine strips it: ASCII, separators, and the no-break space.
_WS = "[\\s\\x1C-\\x1F\\x85\\p{Z}]"


def _strip(text: str) -> str:
    return f"regexp_replace({text}, '^{_WS}+|{_WS}+$', '', 'g')"


inputs.CTE["page_stats"] = f"""
SELECT doc_id, page, length(t) AS text_length, CASE WHEN t = '' THEN 0 ELSE len(regexp_split_to_array(t, '{_WS}+')) END AS word_count,
  images AS image_count, length(t) < 40 AND images > 0 AS is_scanned, drawings > 0 AS has_vectors,
  coalesce(tables, CASE WHEN drawings > 8 AND (CASE WHEN t = '' THEN 0 ELSE len(regexp_split_to_array(t, '{_WS}+')) END) > 15 THEN 1 ELSE 0 END) AS table_count,
  {_strip("replace(substr(text, 1, 200), chr(10), ' ')")} AS sample
FROM (SELECT *, {_strip('text')} AS t FROM doc_pages)"""
inputs.NEEDS["page_stats"] = ("doc_pages",)
inputs.CTE["doc_rollup"] = """
SELECT doc_id, n AS page_count, chars AS total_text_length, images AS total_images, round_even(scanned / seen, 2) AS scanned_ratio,
  round_even(least(1.0, chars / seen / 300.0), 2) AS text_availability, round_even(least(1.0, tables / seen), 2) AS table_likelihood, chars > 100 AS has_digital_text
FROM (SELECT doc_id, count(*) AS n, CAST(count(*) AS DOUBLE) AS seen,
    CAST(sum(text_length) AS BIGINT) AS chars, CAST(sum(image_count) AS BIGINT) AS images,
    CAST(sum(CASE WHEN is_scanned THEN 1 ELSE 0 END) AS DOUBLE) AS scanned, CAST(sum(table_count) AS DOUBLE) AS tables
  FROM page_stats GROUP BY doc_id)"""
inputs.NEEDS["doc_rollup"] = ("page_stats",)


def _stats(spark, folder):
    return pages.page_stats(inputs.doc_pages(spark, folder))


@query(with_inputs("SELECT * FROM page_stats", "page_stats"))
def page_stats(spark, folder):
    return _stats(spark, folder)


@query(with_inputs("SELECT * FROM doc_rollup", "doc_rollup"))
def doc_rollup(spark, folder):
    return pages.document_rollup(_stats(spark, folder))


inputs.CTE["layout"] = """
SELECT doc_id, page, length(text) AS char_count, length(text) > 50 AS has_text, images > 0 AND length(text) < 60 AS is_scanned,
  round_even(CAST(length(text) AS DOUBLE) / (595.0 * 842.0) * 10000, 2) AS text_density FROM doc_pages"""
inputs.NEEDS["layout"] = ("doc_pages",)


@query(with_inputs("SELECT * FROM layout", "layout"))
def layout_stats(spark, folder):
    return pages.layout_stats(inputs.doc_pages(spark, folder))


@query(
    with_inputs(
        """SELECT doc_id, count(*) AS page_count, CAST(round(sum(CAST(text_density AS DECIMAL(18, 2))) * 1000) AS BIGINT) // count(*) AS density_milli,
  count(CASE WHEN is_scanned THEN 1 END) > count(*) * 0.5 AS is_scanned FROM layout GROUP BY doc_id""",
        "layout",
    )
)
def layout_rollup(spark, folder):
    stats = pages.layout_stats(inputs.doc_pages(spark, folder))
    # The mean is compared before it is rounded: ties round differently in SQL.
    total = F.sum(F.round(F.col("text_density") * 1000).cast("bigint"))
    exact = stats.groupBy("doc_id").agg(
        F.floor(total / F.count(F.lit(1))).cast("bigint").alias("density_milli")
    )
    return pages.layout_rollup(stats).drop("text_density_avg").join(exact, "doc_id")


@query(
    with_inputs(
        """SELECT doc_id, page, zone, text FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page, zone ORDER BY line_no) AS r FROM (
  SELECT doc_id, page, line_no, {t} AS text, CASE WHEN line_no % 20 < 2 THEN 'header' WHEN line_no % 20 > 17 THEN 'footer' END AS zone FROM doc_lines)
  WHERE zone IS NOT NULL AND length(text) BETWEEN 1 AND 119) WHERE r <= 2""".replace("{t}", _strip("line")),
        "doc_lines",
    )
)
def running_heads(spark, folder):
    place = F.col("line_no") % 20
    blocks = inputs.doc_lines(spark, folder).select(
        "doc_id",
        "page",
        F.col("line_no").alias("block_no"),
        F.col("line").alias("text"),
        (place * 42.0).alias("y0"),
        (place * 42.0 + 40.0).alias("y1"),
        F.lit(842.0).alias("height"),
    )
    return pages.running_heads(blocks).select("doc_id", "page", "zone", "text")


@query(
    with_inputs(
        """SELECT doc_id, page, title, CASE WHEN contains(title, 'ANNEXURE') THEN 'annexure' WHEN contains(title, 'TABLE') THEN 'dataset' ELSE 'body' END AS section_type
FROM (SELECT * FROM (
  SELECT doc_id, page, line_no, {t} AS title FROM (
    SELECT doc_id, page, line_no, CASE WHEN line_no % 5 = 0 THEN upper(replace(line, 'ß', 's')) WHEN line_no % 5 = 1 THEN 'TABLE ' || line
      WHEN line_no % 35 = 2 THEN 'ANNEXURE ' || page ELSE line END AS line FROM doc_lines))
  WHERE length(title) BETWEEN 5 AND 79 AND ((upper(title) = title AND lower(title) <> title) OR regexp_matches(title, '^(SECTION|TABLE|ANNEXURE)')))""".replace("{t}", _strip("line")),
        "doc_lines",
    )
)
def sections(spark, folder):
    i = F.col("line_no")
    lines = inputs.doc_lines(spark, folder).withColumn(
        "line",
        F.when(i % 5 == 0, F.upper(F.replace("line", F.lit("ß"), F.lit("s"))))
        .when(i % 5 == 1, F.concat(F.lit("TABLE "), "line"))
        .when(i % 35 == 2, F.concat(F.lit("ANNEXURE "), F.col("page").cast("string")))
        .otherwise(F.col("line")),
    )
    text = lines.groupBy("doc_id", "page").agg(
        F.expr("listagg(line, '\n') within group (order by line_no)").alias("text")
    )
    return pages.sections(text).drop("line_no")


inputs.CTE["page_links"] = """
SELECT b.doc_id, b.page, a.n > 1 AS split FROM
  (SELECT doc_id, page, count(*) AS n, max_by(len(headers), table_index) AS h, max_by(row_estimate, table_index) AS r FROM page_tables GROUP BY doc_id, page) a
JOIN (SELECT doc_id, page, min_by(len(headers), table_index) AS h, min_by(row_estimate, table_index) AS r FROM page_tables GROUP BY doc_id, page) b
  ON a.doc_id = b.doc_id AND b.page = a.page + 1 WHERE (a.h > 0 AND b.h > 0 AND a.h = b.h) OR (a.r > 5 AND b.r > 5)"""
inputs.NEEDS["page_links"] = ("page_tables",)
inputs.CTE["page_groups"] = """
SELECT doc_id, group_no, CAST(min(page) - 1 AS INTEGER) AS first_page, max(page) AS last_page FROM (
  SELECT doc_id, page, sum(CASE WHEN prev IS NULL OR prev <> page - 1 OR split THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY page) AS group_no
  FROM (SELECT *, lag(page) OVER (PARTITION BY doc_id ORDER BY page) AS prev FROM page_links)) GROUP BY doc_id, group_no"""
inputs.NEEDS["page_groups"] = ("page_links",)


@query(with_inputs("SELECT * FROM page_groups", "page_groups"))
def continuation_groups(spark, folder):
    return pages.continuation_groups(inputs.page_tables(spark, folder))


@query(
    with_inputs(
        """SELECT doc_id, count(*) AS pages_previewed, CAST(sum(coalesce(tables, 0)) AS BIGINT) AS table_count, bool_or(length(text) > 0) AS has_text_layer,
  min(CASE WHEN page = 1 THEN substr(text, 1, 400) END) AS preview FROM doc_pages WHERE page <= 5 GROUP BY doc_id""",
        "doc_pages",
    )
)
def page_preview(spark, folder):
    text = inputs.doc_pages(spark, folder)
    rolled = pages.preview_rollup(pages.page_preview(text))
    return rolled.join(pages.intake_sample(text).select("doc_id", "preview"), "doc_id", "left")


# Words of the test documents stand in for the names and keywords of the packs.
def _named_docs(spark, folder):
    k = F.col("doc_id")
    name = (
        F.when(k % 7 == 0, "TVET_List_2024.pdf").when(k % 7 == 1, "oihd.pdf").when(k % 7 == 2, "province report.pdf")
        .when(k % 7 == 3, "variable name codebook.pdf").otherwise("scan.pdf")
    )
    words = (
        F.when(k % 5 == 0, " SAQA ID and NQF Level of TVET College ").when(k % 5 == 1, " OFO Code, Major Group ")
        .when(k % 5 == 2, " Value Label, Stats SA ").otherwise(" ")
    )
    return table(spark, folder, "documents").select(
        "doc_id", name.alias("filename"), F.concat(words, "text").alias("sample_text")
    )


_PROFILES = shipped_profiles()


def _score_sql(profile) -> str:
    parts = [f"CASE WHEN regexp_matches(f, '{profile.filename_regex}') THEN 5 ELSE 0 END"]
    for word in profile.keywords:
        w = word.lower()
        parts.append(f"CASE WHEN contains(s, '{w}') THEN 2 ELSE 0 END + CASE WHEN contains(f, '{w}') THEN 3 ELSE 0 END")
    return " + ".join(parts)


_TRIED = [p for p in _PROFILES if p.name != "generic_table"]
inputs.CTE["named_docs"] = """
SELECT doc_id, lower(CASE doc_id % 7 WHEN 0 THEN 'TVET_List_2024.pdf' WHEN 1 THEN 'oihd.pdf' WHEN 2 THEN 'province report.pdf'
    WHEN 3 THEN 'variable name codebook.pdf' ELSE 'scan.pdf' END) AS f,
  lower(CASE doc_id % 5 WHEN 0 THEN ' SAQA ID and NQF Level of TVET College ' WHEN 1 THEN ' OFO Code, Major Group ' WHEN 2 THEN ' Value Label, Stats SA ' ELSE ' ' END
    || text) AS s FROM documents"""
inputs.CTE["profile_match"] = f"""
SELECT doc_id, f, s, greatest(s0, s1, s2) AS profile_score, CASE WHEN greatest(s0, s1, s2) < 4 THEN NULL WHEN s0 >= s1 AND s0 >= s2 THEN '{_TRIED[0].name}'
  WHEN s1 >= s2 THEN '{_TRIED[1].name}' ELSE '{_TRIED[2].name}' END AS profile
FROM (SELECT *, {_score_sql(_TRIED[0])} AS s0, {_score_sql(_TRIED[1])} AS s1, {_score_sql(_TRIED[2])} AS s2 FROM named_docs)"""
inputs.NEEDS["profile_match"] = ("named_docs",)


@query(with_inputs("SELECT doc_id, profile, profile_score FROM profile_match", "profile_match"))
def profile_match(spark, folder):
    return documents.match_profiles(_named_docs(spark, folder), _PROFILES).select(
        "doc_id", "profile", "profile_score"
    )


# 250 packs of 20 keywords, made of syllables of the texts.
_SYLLABLES = "er an th on re in ou es st en ti ed ha nd le it ne al ch ve".split()
_MANY = [
    Profile(
        name=f"pack{i}",
        keywords=tuple(_SYLLABLES[k % 20] + _SYLLABLES[k // 20 % 20] + _SYLLABLES[k // 400] for k in range(20 * i, 20 * i + 20)),
    )
    for i in range(250)
]


@query(
    with_inputs(
        f"""SELECT doc_id, CAST(max(score) AS INTEGER) AS profile_score, CASE WHEN max(score) >= 4 THEN 'pack' || arg_max(pack, score * 1000 - pack) END AS profile
FROM (
    SELECT doc_id, pack, sum(CASE WHEN contains(s, w) THEN 2 ELSE 0 END + CASE WHEN contains(f, w) THEN 3 ELSE 0 END) AS score
    FROM named_docs, (SELECT k // 20 AS pack, y[k % 20 + 1] || y[k // 20 % 20 + 1] || y[k // 400 + 1] AS w FROM range(5000) r(k), (SELECT {_SYLLABLES} AS y))
    GROUP BY doc_id, pack
) GROUP BY doc_id""",
        "named_docs",
    )
)
def profile_match_many(spark, folder):
    return documents.match_profiles(_named_docs(spark, folder), _MANY).select("doc_id", "profile", "profile_score")


def _hit_count(profile) -> str:
    return " + ".join(
        f"CASE WHEN contains(f || ' ' || s, '{w.lower()}') THEN 1 ELSE 0 END" for w in profile.keywords
    )


_KIND = " ".join(f"WHEN profile = '{p.name}' THEN '{p.document_type}'" for p in _TRIED)
_CONF = " ".join(
    f"WHEN profile = '{p.name}' THEN round_even(least(0.98, 0.72 + ({_hit_count(p)}) * 0.06), 2)" for p in _TRIED
)
_EXTRACTOR = " ".join(f"WHEN profile = '{p.name}' THEN '{p.recommended_extractor}'" for p in _TRIED)
_SCANNED = "WHEN scanned_ratio >= 0.70 OR NOT has_digital_text THEN"


@query(
    with_inputs(
        f"""SELECT m.doc_id, CASE {_SCANNED} 'SCANNED_IMAGE' {_KIND} WHEN table_likelihood >= 0.5 AND page_count > 3 THEN 'REPEATED_TABULAR'
    WHEN table_likelihood >= 0.5 THEN 'STRUCTURED_TABLE' WHEN text_availability >= 0.6 THEN 'SEMI_STRUCTURED_REPORT' ELSE 'MIXED_DOCUMENT' END AS document_type,
  CAST(CASE {_SCANNED} 0.92 {_CONF} WHEN table_likelihood >= 0.5 THEN 0.85 WHEN text_availability >= 0.6 THEN 0.75 ELSE 0.60 END AS DOUBLE) AS confidence,
  CASE {_SCANNED} 'ocr' {_EXTRACTOR} ELSE 'pdf_tables' END AS extractor
FROM profile_match m JOIN doc_rollup r ON m.doc_id = r.doc_id""",
        "profile_match",
        "doc_rollup",
    )
)
def classify_docs(spark, folder):
    rolled = pages.document_rollup(_stats(spark, folder))
    docs = _named_docs(spark, folder).join(rolled, "doc_id", "left")
    found = documents.classify(docs, _PROFILES).select("doc_id", "classification.*")
    return found.select(
        "doc_id", "document_type", "confidence", F.col("recommended_extractor").alias("extractor")
    )


def _family_sql(text: str) -> str:
    cases = " ".join(
        f"WHEN regexp_matches({text}, '{'|'.join(words)}') THEN '{family}'"
        for family, words in documents.WORD_FAMILIES
    )
    return f"CASE {cases} ELSE 'general_table' END"


@query(
    with_inputs(
        f"""SELECT doc_id, family, CASE WHEN regexp_matches(family, 'qual|tvet') THEN 'qualifications' WHEN regexp_matches(family, 'occup|oihd|ofo') THEN 'occupations'
  WHEN regexp_matches(family, 'codebook|qlfs|survey') THEN 'codebook' ELSE 'pdf_tables' END AS extractor
FROM (SELECT doc_id, {_family_sql("f || ' ' || s")} AS family FROM named_docs)""",
        "named_docs",
    )
)
def word_families(spark, folder):
    family = documents.word_family(F.col("sample_text"), F.col("filename"))
    return _named_docs(spark, folder).select("doc_id", family.alias("family")).withColumn(
        "extractor", documents.choose_extractor(F.col("family"))
    )


_WORDS = ("1", "77", "123", "4567", "the", "Of the", "saqa id")


@query(
    with_inputs(
        "SELECT doc_id, concat_ws(chr(10), "
        + ", ".join(f"CASE WHEN bool_or(contains(lower(text), '{w.lower()}')) THEN '{w.lower()}' END" for w in _WORDS)
        + ") AS corpus FROM doc_pages GROUP BY doc_id",
        "doc_pages",
    )
)
def page_samples(spark, folder):
    """The words of a list that stand anywhere in the whole text of a document."""
    found = documents.found_words(inputs.doc_pages(spark, folder), _WORDS)
    return found.withColumnRenamed("sample_text", "corpus")


# Chunks: pages of one order each, continued where the groups say so. The chain of
# chunk starts is a recursion in SQL.
inputs.CTE["order_pages"] = """
SELECT CAST(floor(l_orderkey / 200) AS BIGINT) AS doc_id, CAST(l_orderkey % 200 + 1 AS INTEGER) AS page,
  string_agg(CAST(l_partkey AS VARCHAR), chr(10) ORDER BY l_linenumber, l_partkey) AS text FROM lineitem GROUP BY l_orderkey"""
inputs.CTE["continued"] = "SELECT DISTINCT doc_id, unnest(range(first_page + 1, last_page + 1)) AS page FROM page_groups"
inputs.NEEDS["continued"] = ("page_groups",)
inputs.CTE["placed"] = """
SELECT p.doc_id, p.page, row_number() OVER (PARTITION BY p.doc_id ORDER BY p.page) - 1 AS pos, count(*) OVER (PARTITION BY p.doc_id) AS n,
  c.page IS NOT NULL AS cont FROM order_pages p LEFT JOIN continued c ON p.doc_id = c.doc_id AND p.page = c.page"""
inputs.NEEDS["placed"] = ("order_pages", "continued")
inputs.CTE["steps"] = """
SELECT a.doc_id, a.pos, a.pos + CASE WHEN b.cont AND a.pos + 4 < a.n THEN 3 ELSE 4 END AS nxt FROM placed a LEFT JOIN placed b ON a.doc_id = b.doc_id AND b.pos = a.pos + 3"""
inputs.NEEDS["steps"] = ("placed",)
inputs.CTE["chain"] = """
SELECT doc_id, CAST(0 AS BIGINT) AS start, CAST(0 AS BIGINT) AS chunk_index FROM (SELECT DISTINCT doc_id FROM placed)
UNION ALL SELECT s.doc_id, CAST(s.nxt AS BIGINT), c.chunk_index + 1 FROM chain c JOIN steps s ON c.doc_id = s.doc_id AND s.pos = c.start
JOIN placed p ON p.doc_id = s.doc_id AND p.pos = s.nxt"""
inputs.NEEDS["chain"] = ("steps",)
inputs.CTE["chunks"] = """
SELECT c.doc_id, c.chunk_index, min(p.page) AS page_start, max(p.page) AS page_end,
  string_agg('=== PAGE ' || p.page || ' ===' || chr(10) || t.text, chr(10) || chr(10) ORDER BY p.page) AS text, min_by(p.cont, p.page) AS is_continuation
FROM chain c JOIN placed p ON p.doc_id = c.doc_id AND p.pos BETWEEN c.start AND c.start + 3 JOIN order_pages t ON t.doc_id = p.doc_id AND t.page = p.page
GROUP BY c.doc_id, c.chunk_index"""
inputs.NEEDS["chunks"] = ("chain",)


def _order_pages(spark, folder):
    k = F.col("l_orderkey")
    return (
        table(spark, folder, "lineitem")
        .withColumn("_part", F.col("l_partkey").cast("string"))
        .groupBy("l_orderkey")
        .agg(F.expr("listagg(_part, '\n') within group (order by l_linenumber, l_partkey)").alias("text"))
        .select(
            F.floor(k / 200).cast("bigint").alias("doc_id"), (k % 200 + 1).cast("int").alias("page"), "text"
        )
    )


def _chunks(spark, folder, texts=True):
    linked = pages.linked_pages(inputs.page_tables(spark, folder))
    # Small blocks, so that documents span several of them.
    return chunks.create_chunks(_order_pages(spark, folder), linked, block=32, texts=texts)


def _recursive(sql: str) -> str:
    return "WITH RECURSIVE" + sql[4:]


@query(
    _recursive(
        with_inputs("SELECT doc_id, chunk_index, page_start, page_end, text, is_continuation FROM chunks", "chunks")
    ),
    name="chunks",
)
def page_chunks(spark, folder):
    return _chunks(spark, folder).drop("pages", "overlap")


@query(
    _recursive(
        with_inputs(
            """SELECT c.doc_id, c.chunk_index, array_to_string((string_split(b.text, chr(10)))[-15:], chr(10)) AS overlap
FROM chunks c LEFT JOIN order_pages b ON c.is_continuation AND b.doc_id = c.doc_id AND b.page = c.page_start - 1""",
            "chunks",
        )
    )
)
def chunk_overlap(spark, folder):
    return _chunks(spark, folder, texts=False).select("doc_id", "chunk_index", "overlap")


@query(
    _recursive(
        with_inputs(
            """SELECT doc_id, chunk_index, sha256('doc' || doc_id || '_' || page_start || '_' || page_end || '_m_v1_default') AS cache_key FROM chunks WHERE chunk_index % 3 <> 0""",
            "chunks",
        )
    )
)
def cache_misses(spark, folder):
    name = F.concat(F.lit("doc"), F.col("doc_id").cast("string"))
    key = chunks.cache_key(name, F.col("page_start"), F.col("page_end"), F.lit("m"), F.lit("v1"))
    work = durable(_chunks(spark, folder, texts=False).select("doc_id", "chunk_index", key.alias("cache_key")))
    return chunks.cache_misses(work, work.filter("chunk_index % 3 = 0").select("cache_key"))


inputs.CTE["costs"] = """
SELECT u.*, round_even(CAST(prompt_tokens AS DOUBLE) / 1000000.0 * coalesce(input_per_m, 0) + CAST(completion_tokens AS DOUBLE) / 1000000.0 * coalesce(output_per_m, 0), 6) AS cost
FROM usage u LEFT JOIN prices p ON u.provider = p.provider AND u.model = p.model"""
inputs.NEEDS["costs"] = ("usage", "prices")


@query(with_inputs("SELECT job_id, turn, model, prompt_tokens, completion_tokens, cost FROM costs", "costs"))
def token_cost(spark, folder):
    priced = usage.with_cost(inputs.usage(spark, folder), inputs.prices(spark))
    return priced.drop("provider")


@query(
    with_inputs(
        "SELECT job_id, count(*) AS calls, CAST(sum(prompt_tokens + completion_tokens) AS BIGINT) AS tokens, round(sum(cost), 6) AS cost FROM costs GROUP BY job_id",
        "costs",
    )
)
def usage_rollup(spark, folder):
    priced = usage.with_cost(inputs.usage(spark, folder), inputs.prices(spark))
    return usage.usage_rollup(priced).withColumn("cost", F.round("cost", 6))


@query("SELECT event_id, trim(props) AS body, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_extract(spark, folder):
    k = F.col("event_id")
    answer = (
        F.when(k % 3 == 0, F.concat(F.lit("Result:\n```json\n"), "props", F.lit("\n```\nDone.")))
        .when(k % 3 == 1, F.concat(F.lit("The answer is "), "props", F.lit(" as asked")))
        .otherwise(F.concat(F.lit("  "), "props", F.lit("\n")))
    )
    body = table(spark, folder, "events").select("event_id", extract_json(answer).alias("body"))
    return body.withColumn("k", F.from_json("body", "k bigint")["k"])


@query(
    """SELECT conv_id, turn, CASE WHEN turn % 2 = 1 AND turn % 3 = 0 THEN NULL ELSE length(text) END AS result,
  CASE WHEN turn % 2 = 1 AND turn % 3 <> 0 THEN 'b (fallback)' ELSE 'a' END AS source FROM conversations"""
)
def fallback_results(spark, folder):
    turns = table(spark, folder, "conversations").select("conv_id", "turn", F.length("text").alias("n"))
    first = turns.select("conv_id", "turn", F.when(F.col("turn") % 2 == 0, F.col("n")).alias("result"), F.lit("a").alias("source"))
    second = turns.select("conv_id", "turn", F.when(F.col("turn") % 3 != 0, F.col("n")).alias("result"), F.lit("b").alias("source"))
    return usage.primary_or_fallback(first, second, ["conv_id", "turn"])
