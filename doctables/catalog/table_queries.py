"""Queries: table reconstruction from raw rows and word positions."""

from __future__ import annotations

from pyspark.sql import functions as F

from doctables.catalog import inputs
from doctables.catalog.base import query, table
from doctables.catalog.inputs import with_inputs
from doctables.operators import layout, stitch, tables
from doctables.plans.skew import top_per_key


def _shown(df, *keys):
    return df.select(*keys, F.array_join("cells", "|").alias("cells"))


@query(
    with_inputs(
        """SELECT doc_id, row_idx, array_to_string(cells, '|') AS cells FROM raw_rows WHERE len(cells) = 1""",
        "raw_rows",
    )
)
def noise_rows(spark, folder):
    return _shown(
        inputs.raw_rows(spark, folder).filter(tables.is_noise(F.col("cells"))), "doc_id", "row_idx"
    )


inputs.CTE["healed"] = """
SELECT doc_id, min(row_idx) AS row_idx, string_agg(nullif(cells[1], ''), ' ' ORDER BY row_idx) AS c1,
  string_agg(nullif(cells[2], ''), ' ' ORDER BY row_idx) AS c2, string_agg(nullif(cells[3], ''), ' ' ORDER BY row_idx) AS c3
FROM (SELECT *, sum(CASE WHEN cells[1] <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY row_idx) AS g
  FROM raw_rows WHERE len(cells) > 1) GROUP BY doc_id, g"""
inputs.NEEDS["healed"] = ("raw_rows",)


@query(with_inputs("SELECT doc_id, row_idx, coalesce(c1, '') || '|' || c2 || '|' || c3 AS cells FROM healed", "healed"))
def heal_rows(spark, folder):
    return _shown(tables.heal_rows(inputs.raw_rows(spark, folder), F.lit(3)), "doc_id", "row_idx")


@query(
    with_inputs(
        """SELECT r.doc_id, r.row_idx, array_to_string(r.cells, '|') AS cells, array_to_string(h.cells, '|') AS headers
FROM raw_rows r JOIN raw_rows h ON r.doc_id = h.doc_id AND h.row_idx = 1 WHERE r.row_idx > 1""",
        "raw_rows",
    )
)
def promote_headers(spark, folder):
    rows = tables.promote_headers(tables.clean_cells(inputs.raw_rows(spark, folder)), min_rows=2)
    return _shown(rows, "doc_id", "row_idx", F.array_join("headers", "|").alias("headers"))


@query(
    with_inputs(
        "SELECT doc_id, 0 AS header_row, 0 AS saqa, 1 AS title, 2 AS nqf, 3 AS framework, 4 AS nsfas, 5 AS colleges FROM list_rows WHERE row_idx = 0 AND doc_id % 2 = 0",
        "list_rows",
    )
)
def header_map(spark, folder):
    from doctables.functions.fixed import QUALIFICATION_ALIASES

    heads = tables.find_header_rows(inputs.list_rows(spark, folder), QUALIFICATION_ALIASES)
    short = ["saqa", "title", "nqf", "framework", "nsfas", "colleges"]
    return heads.select(
        "doc_id", "header_row", *[F.col("places")[i].alias(n) for i, n in enumerate(short)]
    )


# Row 0 is a header for even orders; for odd ones its six letters start no record.
inputs.CTE["list_islands"] = """
SELECT *, sum(CASE WHEN starts THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY row_idx) AS g FROM (
  SELECT doc_id, row_idx, cells, regexp_matches(cells[1], '[0-9]{4,7}') AS starts,
    replace(cells[6], '•', '; ') AS items FROM list_rows
  WHERE (row_idx > 0 OR doc_id % 2 = 1) AND cells[1] <> '123')"""
inputs.NEEDS["list_islands"] = ("list_rows",)


@query(
    with_inputs(
        """SELECT doc_id, min(row_idx) AS row_idx, min_by(cells[1], row_idx) AS saqa_id, string_agg(cells[2], ' ' ORDER BY row_idx) AS qualification,
  min_by(cells[3], row_idx) AS nqf_level, min_by(cells[5], row_idx) AS nsfas_eligible, string_agg(items, '; ' ORDER BY row_idx) AS participating_colleges
FROM list_islands WHERE g > 0 GROUP BY doc_id, g""",
        "list_islands",
    )
)
def wrapped_qualifications(spark, folder):
    return tables.qualification_rows(inputs.list_rows(spark, folder)).drop("page", "table_index", "framework")


@query(
    with_inputs(
        """SELECT doc_id, min(row_idx) AS row_idx, min_by(cells[1], row_idx) AS ofo_code, string_agg(cells[2], ' ' ORDER BY row_idx) AS occupation_title,
  min_by(cells[5], row_idx) AS province FROM (
  SELECT *, sum(CASE WHEN starts THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY row_idx) AS g FROM (
    SELECT *, regexp_full_match(cells[1], '[0-9]{4,6}') AS starts FROM list_rows WHERE row_idx > 0 AND cells[1] <> '123'))
WHERE g > 0 GROUP BY doc_id, g""",
        "list_rows",
    )
)
def wrapped_occupations(spark, folder):
    rows = inputs.list_rows(spark, folder).filter("row_idx > 0")
    return tables.occupation_rows(rows).select(
        "doc_id", "row_idx", "ofo_code", "occupation_title", "province"
    )


inputs.CTE["filled"] = """
SELECT doc_id, row_idx, cells, len(cells) >= 4 AS is_full,
  last_value(CASE WHEN len(cells) >= 4 THEN nullif(cells[1], '') END IGNORE NULLS) OVER w AS var,
  last_value(CASE WHEN len(cells) >= 4 THEN nullif(cells[2], '') END IGNORE NULLS) OVER w AS label
FROM code_rows WHERE row_idx > 0
WINDOW w AS (PARTITION BY doc_id ORDER BY row_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""
inputs.NEEDS["filled"] = ("code_rows",)


@query(
    with_inputs(
        """SELECT doc_id, row_idx, coalesce(var, '') AS variable_name, coalesce(label, '') AS variable_label,
  CASE WHEN is_full THEN cells[3] ELSE cells[1] END AS value, CASE WHEN is_full THEN cells[4] ELSE cells[2] END AS value_label,
  CASE WHEN len(cells) > 4 THEN cells[5] ELSE 'categorical' END AS data_type, '' AS description
FROM filled WHERE is_full OR var IS NOT NULL""",
        "filled",
    )
)
def fill_forward(spark, folder):
    return tables.codebook_rows(inputs.code_rows(spark, folder)).drop("page", "table_index")


@query(
    with_inputs(
        """SELECT doc_id, row_idx, var AS variable_name, label AS variable_label, CASE WHEN is_full THEN parts[3] ELSE parts[1] END AS value,
  CASE WHEN is_full THEN parts[4] ELSE parts[2] END AS value_label FROM (
  SELECT *, last_value(CASE WHEN is_full THEN parts[1] END IGNORE NULLS) OVER w AS var, last_value(CASE WHEN is_full THEN parts[2] END IGNORE NULLS) OVER w AS label
  FROM (SELECT l_orderkey AS doc_id, rn AS row_idx, rn % 3 = 1 AS is_full,
      CASE WHEN rn % 3 = 1 THEN ['V' || CAST(l_partkey AS VARCHAR), 'L ' || l_returnflag, CAST(l_linenumber AS VARCHAR), l_linestatus]
        ELSE [CAST(l_linenumber AS VARCHAR), l_linestatus] END AS parts FROM line_rows WHERE rn % 3 <> 0)
  WINDOW w AS (PARTITION BY doc_id ORDER BY row_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) WHERE var IS NOT NULL""",
        "line_rows",
    )
)
def delimited_lines(spark, folder):
    rn, number = F.col("rn"), F.col("l_linenumber").cast("string")
    line = (
        F.when(
            rn % 3 == 1,
            F.concat(
                F.lit("V"), F.col("l_partkey").cast("string"), F.lit(" |  | L "), "l_returnflag",
                F.lit("|"), number, F.lit("\t"), "l_linestatus",
            ),
        )
        .when(rn % 3 == 2, F.concat(number, F.lit("|"), "l_linestatus"))
        .otherwise(F.concat(F.lit("note|"), number))
    )
    lines = inputs.line_rows(spark, folder).select(
        F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), rn.alias("line_no"), line.alias("line")
    )
    return tables.delimited_lines(lines).select(
        "doc_id", "row_idx", "variable_name", "variable_label", "value", "value_label"
    )


# Lines of 2 or 3 cells (the two words 5 points apart are one cell); the usual
# count is the more frequent one, the lower on a tie.
inputs.CTE["text_lines"] = """
SELECT l_orderkey AS doc_id, rn, CAST(round_even(12.0 * rn / 4 + 0.25, 0) * 4 AS INTEGER) AS y,
  CASE WHEN rn % 2 = 1 THEN [CAST(l_partkey AS VARCHAR), l_returnflag || ' ' || CAST(l_suppkey AS VARCHAR), l_linestatus]
    ELSE [CAST(l_partkey AS VARCHAR), l_returnflag || ' ' || CAST(l_suppkey AS VARCHAR)] END AS cells
FROM line_rows WHERE rn % 5 <> 0"""
inputs.NEEDS["text_lines"] = ("line_rows",)


@query(
    with_inputs(
        """SELECT t.doc_id, t.y AS row_idx,
  array_to_string(CASE WHEN width = 3 AND len(cells) = 2 THEN list_append(cells, '') ELSE cells[1:width] END, '|') AS cells
FROM text_lines t JOIN (
  SELECT doc_id, CASE WHEN count(CASE WHEN len(cells) = 3 THEN 1 END) > count(CASE WHEN len(cells) = 2 THEN 1 END) THEN 3 ELSE 2 END AS width,
    min(y) AS head, count(*) AS n FROM text_lines GROUP BY doc_id) p ON t.doc_id = p.doc_id AND p.n >= 2 AND t.y > p.head""",
        "text_lines",
    )
)
def positional_layout(spark, folder):
    # y of one line differs by up to 4 points; keep the words on their line.
    words = inputs.words(spark, folder).withColumn("y0", F.floor(F.col("y0") / 12) * 12.0 + 1.0)
    return _shown(layout.text_tables(words), "doc_id", "row_idx")


@query(
    with_inputs(
        """SELECT t.doc_id, t.rn AS line_num, cells, head FROM (
  SELECT doc_id, rn, string_agg(word, '|' ORDER BY x0) AS cells FROM (SELECT *, CAST(floor(word_no / 10) AS BIGINT) AS rn FROM words) GROUP BY doc_id, rn HAVING count(*) >= 2) t
JOIN (SELECT doc_id, min(rn) AS first, min_by(cells, rn) AS head, count(*) AS n FROM (
  SELECT doc_id, rn, string_agg(word, '|' ORDER BY x0) AS cells FROM (SELECT *, CAST(floor(word_no / 10) AS BIGINT) AS rn FROM words) GROUP BY doc_id, rn HAVING count(*) >= 2)
  GROUP BY doc_id) h ON t.doc_id = h.doc_id AND n >= 2 AND t.rn > first""",
        "words",
    )
)
def ocr_lines(spark, folder):
    words = inputs.words(spark, folder).select(
        "doc_id",
        "page",
        F.lit(1).alias("block_num"),
        F.floor(F.col("word_no") / 10).alias("line_num"),
        F.col("x0").alias("left"),
        "word_no",
        F.col("word").alias("text"),
    )
    return _shown(layout.ocr_tables(words), "doc_id", "line_num", F.array_join("headers", "|").alias("head"))


# The two header families share no words, so equality decides as similarity does.
inputs.CTE["masters"] = """
SELECT doc_id, page, headers, min(page) OVER (PARTITION BY doc_id, g) AS master_page FROM (
  SELECT *, sum(CASE WHEN prev IS NULL OR prev <> headers[1] THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY page) AS g FROM (
    SELECT doc_id, page, headers, lag(headers[1]) OVER (PARTITION BY doc_id ORDER BY page) AS prev
    FROM (SELECT DISTINCT doc_id, page, headers FROM page_rows)))"""
inputs.NEEDS["masters"] = ("page_rows",)
inputs.CTE["stitched"] = """
SELECT doc_id, master_page, page, row_idx, c1, c2, c3, c4 FROM (
  SELECT doc_id, master_page, min(o) AS o, min_by(page, o) AS page, min_by(row_idx, o) AS row_idx, string_agg(nullif(cells[1], ''), ' ' ORDER BY o) AS c1,
    string_agg(nullif(cells[2], ''), ' ' ORDER BY o) AS c2, string_agg(nullif(cells[3], ''), ' ' ORDER BY o) AS c3, string_agg(nullif(cells[4], ''), ' ' ORDER BY o) AS c4
  FROM (SELECT *, page * 1000 + row_idx AS o,
      sum(CASE WHEN cells[1] <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, master_page ORDER BY page, row_idx) AS g
    FROM (SELECT r.*, m.master_page FROM page_rows r JOIN masters m ON r.doc_id = m.doc_id AND r.page = m.page
      WHERE NOT (row_idx = 0 AND m.master_page <> r.page)))
  GROUP BY doc_id, master_page, g)"""
inputs.NEEDS["stitched"] = ("masters",)


@query(
    with_inputs(
        """SELECT doc_id, master_page, page, row_idx, coalesce(c1, '') || '|' || c2 || '|' || c3 || coalesce('|' || c4, '') AS cells FROM stitched""",
        "stitched",
    )
)
def stitch_tables(spark, folder):
    return _shown(
        stitch.stitch_tables(inputs.page_rows(spark, folder)), "doc_id", "master_page", "page", "row_idx"
    )


@query(
    with_inputs(
        "SELECT doc_id, page, master_page, page = master_page AS is_master FROM masters",
        "masters",
    )
)
def table_masters(spark, folder):
    """The fold with blocks of seven pages, so that documents span several blocks."""
    heads = stitch.table_heads(inputs.page_rows(spark, folder))
    return stitch.assign_masters(heads, block_pages=7).select(
        "doc_id", "page", "master_page", (F.col("page") == F.col("master_page")).alias("is_master")
    )


# Three readings of every table: as is, without the noise, and without headers.
inputs.CTE["readings"] = """
SELECT doc_id, 'pdf_tables' AS method, row_idx, cells, 3 AS width FROM raw_rows
UNION ALL SELECT doc_id, 'pdf_pymupdf', row_idx, cells, 3 FROM raw_rows WHERE len(cells) > 1 AND cells[1] <> ''
UNION ALL SELECT doc_id, 'pdf_text', row_idx, cells[1:2], (SELECT 2) FROM raw_rows WHERE doc_id % 2 = 0"""
inputs.NEEDS["readings"] = ("raw_rows",)
inputs.CTE["reading_scores"] = """
SELECT doc_id, method, round_even(avg(consistent / n * 0.40 + greatest(0.0, 1 - empties / (n * width) * 1.2) * 0.35 + least(1.0, content / (n * width)) * 0.25), 2) AS quality
FROM (SELECT doc_id, method, max(width) AS width, CAST(count(*) AS DOUBLE) AS n, CAST(count(CASE WHEN len(cells) = width THEN 1 END) AS DOUBLE) AS consistent,
    CAST(sum(len(list_filter(cells, lambda c: c = ''))) AS DOUBLE) AS empties, CAST(sum(len(list_filter(cells, lambda c: length(c) > 1))) AS DOUBLE) AS content
  FROM readings GROUP BY doc_id, method) GROUP BY doc_id, method"""
inputs.NEEDS["reading_scores"] = ("readings",)


def _readings(spark, folder):
    rows = inputs.raw_rows(spark, folder)
    head = F.array(F.lit("a"), F.lit("b"), F.lit("c"))
    first = rows.withColumns({"headers": head, "method": F.lit("pdf_tables")})
    second = rows.filter((F.size("cells") > 1) & (F.try_element_at("cells", F.lit(1)) != "")).withColumns(
        {"headers": head, "method": F.lit("pdf_pymupdf")}
    )
    third = rows.filter("doc_id % 2 = 0").withColumns(
        {
            "cells": F.slice("cells", 1, 2),
            "headers": F.array().cast("array<string>"),
            "method": F.lit("pdf_text"),
        }
    )
    return first.unionByName(second).unionByName(third)


@query(with_inputs("SELECT * FROM reading_scores", "reading_scores"))
def extraction_quality(spark, folder):
    return tables.extraction_quality(_readings(spark, folder)).drop("tables")


@query(
    with_inputs(
        """SELECT doc_id, method AS strategy, quality FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY quality >= 0.65 DESC,
  CASE WHEN quality >= 0.65 THEN o END, quality DESC, o) AS r FROM (
  SELECT *, CASE method WHEN 'pdf_tables' THEN 0 WHEN 'pdf_pymupdf' THEN 1 ELSE 3 END AS o FROM reading_scores)) WHERE r = 1""",
        "reading_scores",
    )
)
def best_strategy(spark, folder):
    scores = tables.extraction_quality(_readings(spark, folder)).withColumnRenamed("method", "strategy")
    return tables.best_strategy(scores, F.lit("pdf_tables"))


@query(
    with_inputs(
        """SELECT doc_id, method, count(*) AS rows FROM (
  SELECT doc_id, 'special' AS method FROM raw_rows WHERE doc_id % 3 = 0
  UNION ALL SELECT doc_id, 'generic' FROM raw_rows WHERE doc_id % 3 <> 0) GROUP BY doc_id, method""",
        "raw_rows",
    )
)
def empty_fallback(spark, folder):
    rows = inputs.raw_rows(spark, folder)
    special = rows.filter("doc_id % 3 = 0").withColumn("method", F.lit("special"))
    both = tables.with_fallback(special, rows.withColumn("method", F.lit("generic")))
    return both.groupBy("doc_id", "method").agg(F.count(F.lit(1)).alias("rows"))


@query(
    with_inputs(
        """SELECT doc_id, row_idx, cells[1] AS first, coalesce(cells[2], '') AS second, coalesce(cells[3], '') AS third, '' AS fourth FROM raw_rows""",
        "raw_rows",
    )
)
def rows_to_records(spark, folder):
    named = tables.records_by_position(
        inputs.raw_rows(spark, folder), ["first", "second", "third", "fourth"]
    )
    return named.drop("page", "table_index")


@query(
    with_inputs(
        """SELECT doc_id, page, 'tab_p' || CAST(page AS VARCHAR) || '_1' AS table_id, greatest(0, count(*) - 1) AS row_estimate FROM page_rows GROUP BY doc_id, page""",
        "page_rows",
    )
)
def table_inventory(spark, folder):
    from doctables.operators.pages import table_inventory as inventory

    return inventory(inputs.page_rows(spark, folder)).select("doc_id", "page", "table_id", "row_estimate")


@query(
    with_inputs(
        "SELECT l_suppkey, l_orderkey, rn FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, rn) AS k FROM line_rows) WHERE k <= 20",
        "line_rows",
    )
)
def first_rows_per_group(spark, folder):
    """Caps per group (sample rows, sections, previews) in one form."""
    rows = inputs.line_rows(spark, folder).select("l_suppkey", "l_orderkey", "rn")
    return top_per_key(rows, ["l_suppkey"], ["l_orderkey", "rn"], 20)


@query(
    """SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 1.0 ELSE 0.0 END AS same FROM supplier"""
)
def header_similarity(spark, folder):
    from doctables.functions.similarity import header_similarity as similarity

    names = F.array("s_name", F.lit("Total"))
    other = F.when(F.col("s_suppkey") % 2 == 0, names).otherwise(F.array().cast("array<string>"))
    return table(spark, folder, "supplier").select(
        "s_suppkey", similarity(names, other).alias("same")
    )
