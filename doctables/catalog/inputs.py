"""Document-like inputs derived from the given tables, in Spark and in SQL.

Every input is computed from whole tables by the same expressions on both sides.
`CTE` holds the SQL form; `with_inputs` puts the named ones before a query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from doctables.catalog.base import table
from doctables.functions.lists import let

CTE: dict[str, str] = {}
NEEDS: dict[str, tuple[str, ...]] = {}


def with_inputs(body: str, *names: str) -> str:
    """SQL with the named inputs, and what they need, as common table expressions."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in NEEDS.get(name, ()):
            add(need)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    return "WITH " + ", ".join(f"{n} AS ({CTE[n]})" for n in order) + " " + body


# --- customer_raw: noisy text cells -----------------------------------------------------

CUSTOMER_FIELDS = ["name", "nation_code", "flag", "balance", "province"]

CTE["customer_raw"] = """
SELECT c_custkey AS record_id,
  CASE WHEN c_custkey % 17 = 0 THEN 'N/A' WHEN c_custkey % 13 = 0 THEN '  ' || c_name || '  '
       ELSE c_name END AS name,
  CASE WHEN c_custkey % 11 = 0 THEN '--' WHEN c_custkey % 7 = 0 THEN '0' || CAST(c_nationkey AS VARCHAR)
       ELSE CAST(c_nationkey AS VARCHAR) END AS nation_code,
  CASE c_custkey % 5 WHEN 0 THEN 'yes' WHEN 1 THEN 'N' WHEN 2 THEN 'TRUE' WHEN 3 THEN ' no ' ELSE 'y' END AS flag,
  CASE WHEN c_custkey % 19 = 0 THEN '00' ELSE '' END || CAST(CAST(floor(c_acctbal) AS BIGINT) AS VARCHAR)
    || CASE WHEN c_custkey % 4 = 0 THEN '.50' ELSE '' END AS balance,
  CASE c_custkey % 6 WHEN 0 THEN 'GP' WHEN 1 THEN ' kzn' WHEN 2 THEN 'Western   Cape' WHEN 3 THEN 'lim'
       WHEN 4 THEN c_mktsegment ELSE NULL END AS province
FROM customer"""


def customer_raw(spark: SparkSession, folder: str) -> DataFrame:
    k, nation = F.col("c_custkey"), F.col("c_nationkey").cast("string")
    return table(spark, folder, "customer").select(
        k.alias("record_id"),
        F.when(k % 17 == 0, "N/A")
        .when(k % 13 == 0, F.concat(F.lit("  "), "c_name", F.lit("  ")))
        .otherwise(F.col("c_name"))
        .alias("name"),
        F.when(k % 11 == 0, "--")
        .when(k % 7 == 0, F.concat(F.lit("0"), nation))
        .otherwise(nation)
        .alias("nation_code"),
        F.when(k % 5 == 0, "yes").when(k % 5 == 1, "N").when(k % 5 == 2, "TRUE").when(k % 5 == 3, " no ")
        .otherwise("y").alias("flag"),
        F.concat(
            F.when(k % 19 == 0, "00").otherwise(""),
            F.floor("c_acctbal").cast("bigint").cast("string"),
            F.when(k % 4 == 0, ".50").otherwise(""),
        ).alias("balance"),
        F.when(k % 6 == 0, "GP").when(k % 6 == 1, " kzn").when(k % 6 == 2, "Western   Cape")
        .when(k % 6 == 3, "lim").when(k % 6 == 4, F.col("c_mktsegment")).alias("province"),
    )


# --- line_rows: lineitem with its row number in the order ---------------------------------

CTE["line_rows"] = """
SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey
    ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS BIGINT) AS rn
FROM lineitem"""


def line_rows(spark: SparkSession, folder: str) -> DataFrame:
    # An order has a handful of lines, so numbering them per order is safe.
    window = Window.partitionBy("l_orderkey").orderBy(
        "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"
    )
    return table(spark, folder, "lineitem").withColumn("rn", F.row_number().over(window).cast("bigint"))


# --- order_parts: one multi-value cell per order and return flag ---------------------------

CTE["order_parts"] = """
SELECT l_orderkey AS order_id, l_returnflag AS flag,
  l_orderkey * 10 + CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS row_index,
  string_agg(CAST(l_partkey AS VARCHAR), '; ' ORDER BY l_linenumber, l_partkey) AS parts
FROM lineitem GROUP BY l_orderkey, l_returnflag"""


def order_parts(spark: SparkSession, folder: str) -> DataFrame:
    flag = F.col("l_returnflag")
    place = F.when(flag == "A", 0).when(flag == "N", 1).otherwise(2)
    return (
        table(spark, folder, "lineitem")
        .withColumn("_part", F.col("l_partkey").cast("string"))
        .groupBy("l_orderkey", "l_returnflag")
        .agg(F.expr("listagg(_part, '; ') within group (order by l_linenumber, l_partkey)").alias("parts"))
        .select(
            F.col("l_orderkey").alias("order_id"),
            flag.alias("flag"),
            (F.col("l_orderkey") * 10 + place).alias("row_index"),
            "parts",
        )
    )


# --- orders, two editions ---------------------------------------------------------------

CTE["orders_v1"] = """
SELECT o_orderkey, o_custkey, o_orderstatus, CAST(floor(o_totalprice) AS BIGINT) AS total,
  strftime(o_orderdate, '%Y-%m-%d') AS order_date FROM orders"""
CTE["orders_v2"] = """
SELECT CASE WHEN o_orderkey % 10 = 0 THEN o_orderkey + 10000000 ELSE o_orderkey END AS o_orderkey,
  o_custkey, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
  CASE WHEN o_orderkey % 21 = 0 THEN 0 ELSE CAST(floor(o_totalprice) AS BIGINT) END AS total,
  strftime(o_orderdate, '%Y-%m-%d') AS order_date, o_orderpriority AS priority FROM orders"""


def orders_v1(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(
        "o_orderkey",
        "o_custkey",
        "o_orderstatus",
        F.floor("o_totalprice").cast("bigint").alias("total"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("order_date"),
    )


def orders_v2(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, folder, "orders").select(
        F.when(k % 10 == 0, k + 10_000_000).otherwise(k).alias("o_orderkey"),
        "o_custkey",
        F.when(k % 7 == 0, "X").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"),
        F.when(k % 21 == 0, F.lit(0)).otherwise(F.floor("o_totalprice").cast("bigint")).alias("total"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("order_date"),
        F.col("o_orderpriority").alias("priority"),
    )


# --- customers as read by two models -----------------------------------------------------

CTE["model_a"] = """
SELECT CASE WHEN c_custkey % 50 = 7 THEN NULL ELSE CAST(c_custkey AS VARCHAR) END AS id, c_name AS name,
  c_mktsegment AS segment, CAST(c_nationkey AS VARCHAR) AS nation, c_custkey AS row_index FROM customer"""
CTE["model_b"] = """
SELECT CAST(c_custkey AS VARCHAR) AS id, upper(c_name) || ' ' AS name,
  CASE WHEN c_custkey % 20 = 0 THEN 'CHANGED' ELSE c_mktsegment END AS segment,
  CASE WHEN c_custkey % 30 = 0 THEN NULL ELSE CAST(c_nationkey AS VARCHAR) END AS nation,
  c_custkey AS row_index FROM customer WHERE c_custkey % 33 <> 0"""


def model_a(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, folder, "customer").select(
        F.when(k % 50 != 7, k.cast("string")).alias("id"),
        F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("segment"),
        F.col("c_nationkey").cast("string").alias("nation"),
        k.alias("row_index"),
    )


def model_b(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("c_custkey")
    return (
        table(spark, folder, "customer")
        .filter(k % 33 != 0)
        .select(
            k.cast("string").alias("id"),
            F.concat(F.upper("c_name"), F.lit(" ")).alias("name"),
            F.when(k % 20 == 0, "CHANGED").otherwise(F.col("c_mktsegment")).alias("segment"),
            F.when(k % 30 != 0, F.col("c_nationkey").cast("string")).alias("nation"),
            k.alias("row_index"),
        )
    )


# --- labels as golden table, a rule over documents as extraction -----------------------------

CTE["golden"] = "SELECT CAST(doc_id AS VARCHAR) AS id, CAST(quality AS VARCHAR) AS quality FROM labels"
CTE["predicted"] = """
SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN n_chars >= 200 THEN '1' ELSE '0' END AS quality
FROM documents"""


def golden(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "labels").select(
        F.col("doc_id").cast("string").alias("id"), F.col("quality").cast("string").alias("quality")
    )


def predicted(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(
        F.col("doc_id").cast("string").alias("id"),
        F.when(F.col("n_chars") >= 200, "1").otherwise("0").alias("quality"),
    )


# --- part as a list of qualifications with wrong values ---------------------------------------

CTE["part_records"] = """
SELECT p_partkey AS record_id,
  CASE WHEN p_partkey % 19 = 0 THEN NULL WHEN p_partkey % 17 = 0 THEN 'P-' || CAST(10000 + p_partkey AS VARCHAR)
       ELSE CAST(10000 + p_partkey AS VARCHAR) END AS ofo_code,
  CASE WHEN p_partkey % 23 = 0 THEN 'level' ELSE CAST(p_size AS VARCHAR) END AS nqf_level,
  CASE WHEN p_partkey % 29 = 0 THEN '  ' ELSE p_name END AS occupation_title,
  p_brand AS brand,
  CASE p_partkey % 4 WHEN 0 THEN 'OQSF' WHEN 1 THEN 'Higher Education' WHEN 2 THEN 'general' ELSE p_type END AS framework,
  CASE p_partkey % 7 WHEN 0 THEN 'eligible' WHEN 1 THEN 'no' WHEN 2 THEN '' WHEN 3 THEN 'Pending' ELSE 'Yes' END AS nsfas,
  CAST(p_partkey % 100 AS DOUBLE) / 100 AS confidence
FROM part"""


def part_records(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("p_partkey")
    code = (k + 10000).cast("string")
    return table(spark, folder, "part").select(
        k.alias("record_id"),
        F.when(k % 19 == 0, None).when(k % 17 == 0, F.concat(F.lit("P-"), code)).otherwise(code).alias("ofo_code"),
        F.when(k % 23 == 0, "level").otherwise(F.col("p_size").cast("string")).alias("nqf_level"),
        F.when(k % 29 == 0, "  ").otherwise(F.col("p_name")).alias("occupation_title"),
        F.col("p_brand").alias("brand"),
        F.when(k % 4 == 0, "OQSF").when(k % 4 == 1, "Higher Education").when(k % 4 == 2, "general")
        .otherwise(F.col("p_type")).alias("framework"),
        F.when(k % 7 == 0, "eligible").when(k % 7 == 1, "no").when(k % 7 == 2, "").when(k % 7 == 3, "Pending")
        .otherwise("Yes").alias("nsfas"),
        ((k % 100).cast("double") / 100).alias("confidence"),
    )


def _with_head(first, head, cells):
    """row_idx and cells of a line, preceded by a header row 0 where `first` holds."""
    row = F.struct(F.col("rn").alias("row_idx"), cells.alias("cells"))
    top = F.struct(F.lit(0).cast("bigint").alias("row_idx"), head.alias("cells"))
    return F.inline(F.when(first, F.array(top, row)).otherwise(F.array(row)))


# --- raw_rows: order lines as table rows with wrapped rows and noise ----------------------------

CTE["raw_rows"] = """
SELECT l_orderkey AS doc_id, 1 AS page, 0 AS table_index, rn AS row_idx,
  CASE WHEN rn % 7 = 0 THEN ['Page 3 of 9']
       ELSE [CASE WHEN rn % 3 = 2 THEN '' ELSE CAST(l_partkey AS VARCHAR) END,
             CAST(l_suppkey AS VARCHAR), l_returnflag] END AS cells
FROM line_rows"""
NEEDS["raw_rows"] = ("line_rows",)


def raw_rows(spark: SparkSession, folder: str) -> DataFrame:
    rn = F.col("rn")
    return line_rows(spark, folder).select(
        F.col("l_orderkey").alias("doc_id"),
        F.lit(1).alias("page"),
        F.lit(0).alias("table_index"),
        rn.alias("row_idx"),
        F.when(rn % 7 == 0, F.array(F.lit("Page 3 of 9")))
        .otherwise(
            F.array(
                F.when(rn % 3 == 2, "").otherwise(F.col("l_partkey").cast("string")),
                F.col("l_suppkey").cast("string"),
                F.col("l_returnflag"),
            )
        )
        .alias("cells"),
    )


# --- list_rows: qualification lists with a header, wrapped rows and short rows -------------------

CTE["list_rows"] = """
SELECT l_orderkey AS doc_id, 1 AS page, 0 AS table_index, rn AS row_idx,
  CASE WHEN rn % 4 = 2 THEN ['', 'part ' || CAST(l_linenumber AS VARCHAR), '', '', '', 'Site ' || CAST(l_suppkey AS VARCHAR)]
       WHEN rn % 4 = 0 THEN ['123', 'dropped', '', '', '', '']
       ELSE [CAST(100000 + l_partkey AS VARCHAR), 'Course ' || CAST(l_suppkey AS VARCHAR), CAST(l_linenumber AS VARCHAR),
             'OQSF', l_returnflag, 'Campus ' || CAST(l_suppkey AS VARCHAR) || '•Campus X'] END AS cells
FROM line_rows
UNION ALL
SELECT l_orderkey, 1, 0, 0, CASE WHEN l_orderkey % 2 = 0
  THEN ['SAQA ID', 'Qualification Title', 'NQF Level', 'Sub-Framework', 'NSFAS', 'Participating Colleges']
  ELSE ['a', 'b', 'c', 'd', 'e', 'f'] END
FROM line_rows WHERE rn = 1"""
NEEDS["list_rows"] = ("line_rows",)


def list_rows(spark: SparkSession, folder: str) -> DataFrame:
    lines = line_rows(spark, folder)
    rn, supp = F.col("rn"), F.col("l_suppkey").cast("string")
    text = lambda *xs: F.array(*[F.lit(x) if isinstance(x, str) else x for x in xs])
    number = F.col("l_linenumber").cast("string")
    cells = (
        F.when(
            rn % 4 == 2,
            text("", F.concat(F.lit("part "), number), "", "", "", F.concat(F.lit("Site "), supp)),
        )
        .when(rn % 4 == 0, text("123", "dropped", "", "", "", ""))
        .otherwise(
            text(
                (F.col("l_partkey") + 100000).cast("string"),
                F.concat(F.lit("Course "), supp),
                number,
                "OQSF",
                F.col("l_returnflag"),
                F.concat(F.lit("Campus "), supp, F.lit("•Campus X")),
            )
        )
    )
    head = F.when(
        F.col("doc_id") % 2 == 0,
        text("SAQA ID", "Qualification Title", "NQF Level", "Sub-Framework", "NSFAS", "Participating Colleges"),
    ).otherwise(text("a", "b", "c", "d", "e", "f"))
    key = [F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), F.lit(0).alias("table_index")]
    return lines.withColumn("doc_id", F.col("l_orderkey")).select(*key, _with_head(rn == 1, head, cells))


# --- code_rows: codebook tables with merged cells ----------------------------------------------

CTE["code_rows"] = """
SELECT l_orderkey AS doc_id, 1 AS page, 0 AS table_index, rn AS row_idx,
  CASE WHEN rn % 3 = 1 THEN ['VAR' || CAST(l_partkey AS VARCHAR), CASE WHEN rn % 2 = 0 THEN '' ELSE 'Label ' || CAST(l_suppkey AS VARCHAR) END,
                             CAST(l_linenumber AS VARCHAR), l_returnflag, 'numeric']
       WHEN rn % 3 = 2 THEN [CAST(l_linenumber AS VARCHAR), l_linestatus]
       ELSE ['', '', CAST(l_linenumber AS VARCHAR), l_returnflag] END AS cells
FROM line_rows
UNION ALL SELECT l_orderkey, 1, 0, 0, ['Variable', 'Label', 'Value', 'Value Label'] FROM line_rows WHERE rn = 1"""
NEEDS["code_rows"] = ("line_rows",)


def code_rows(spark: SparkSession, folder: str) -> DataFrame:
    lines = line_rows(spark, folder)
    rn, number = F.col("rn"), F.col("l_linenumber").cast("string")
    cells = (
        F.when(
            rn % 3 == 1,
            F.array(
                F.concat(F.lit("VAR"), F.col("l_partkey").cast("string")),
                F.when(rn % 2 == 0, "").otherwise(F.concat(F.lit("Label "), F.col("l_suppkey").cast("string"))),
                number,
                F.col("l_returnflag"),
                F.lit("numeric"),
            ),
        )
        .when(rn % 3 == 2, F.array(number, F.col("l_linestatus")))
        .otherwise(F.array(F.lit(""), F.lit(""), number, F.col("l_returnflag")))
    )
    key = [F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), F.lit(0).alias("table_index")]
    head = F.array(*[F.lit(x) for x in ("Variable", "Label", "Value", "Value Label")])
    return lines.select(*key, _with_head(rn == 1, head, cells))


# --- page_rows: tables that run over pages ---------------------------------------------------
# A document is 50 orders, a page is one order; two header families alternate, and
# every fifth order repeats its header as first row.

CTE["page_rows"] = """
SELECT CAST(floor(l_orderkey / 50) AS BIGINT) AS doc_id, CAST(l_orderkey % 50 + 1 AS INTEGER) AS page, 0 AS table_index, rn AS row_idx,
  CASE WHEN l_orderkey % 7 < 3 THEN ['Part Key', 'Supplier', 'Quantity'] ELSE ['Zone', 'Yield', 'Box', 'W'] END AS headers,
  CASE WHEN l_orderkey % 7 < 3 THEN [CASE WHEN rn % 3 = 2 THEN '' ELSE CAST(l_partkey AS VARCHAR) END, CAST(l_suppkey AS VARCHAR), l_returnflag]
       ELSE [CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR), l_returnflag, l_linestatus] END AS cells
FROM line_rows
UNION ALL
SELECT CAST(floor(l_orderkey / 50) AS BIGINT), CAST(l_orderkey % 50 + 1 AS INTEGER), 0, 0,
  CASE WHEN l_orderkey % 7 < 3 THEN ['Part Key', 'Supplier', 'Quantity'] ELSE ['Zone', 'Yield', 'Box', 'W'] END,
  CASE WHEN l_orderkey % 7 < 3 THEN ['Part Key', 'Supplier', 'Quantity'] ELSE ['Zone', 'Yield', 'Box', 'W'] END
FROM line_rows WHERE rn = 1 AND l_orderkey % 5 = 0"""
NEEDS["page_rows"] = ("line_rows",)


def page_rows(spark: SparkSession, folder: str) -> DataFrame:
    lines = line_rows(spark, folder)
    k, rn = F.col("l_orderkey"), F.col("rn")
    first = F.array(F.lit("Part Key"), F.lit("Supplier"), F.lit("Quantity"))
    second = F.array(F.lit("Zone"), F.lit("Yield"), F.lit("Box"), F.lit("W"))
    headers = F.when(k % 7 < 3, first).otherwise(second)
    part, supp = F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")
    cells = F.when(
        k % 7 < 3, F.array(F.when(rn % 3 == 2, "").otherwise(part), supp, F.col("l_returnflag"))
    ).otherwise(F.array(part, supp, F.col("l_returnflag"), F.col("l_linestatus")))
    key = [
        F.floor(k / 50).cast("bigint").alias("doc_id"),
        (k % 50 + 1).cast("int").alias("page"),
        F.lit(0).alias("table_index"),
    ]
    return lines.select(
        *key, headers.alias("headers"), _with_head((rn == 1) & (k % 5 == 0), headers, cells)
    )


# --- words: word positions on pages --------------------------------------------------------
# A page is one order. Lines with odd numbers hold three cells (the second of two
# words), the others two cells, and every fifth line a single word.

CTE["words"] = """
SELECT l_orderkey AS doc_id, 1 AS page, rn * 10 + w.no AS word_no, w.x0, w.x0 + 30.0 AS x1, 12.0 * rn + w.no AS y0, w.word
FROM line_rows, LATERAL (
  SELECT 1 AS no, 0.0 AS x0, CAST(l_partkey AS VARCHAR) AS word
  UNION ALL SELECT 2, 100.0, l_returnflag WHERE rn % 5 <> 0
  UNION ALL SELECT 3, 135.0, CAST(l_suppkey AS VARCHAR) WHERE rn % 5 <> 0
  UNION ALL SELECT 4, 300.0, l_linestatus WHERE rn % 5 <> 0 AND rn % 2 = 1) w
"""
NEEDS["words"] = ("line_rows",)


def words(spark: SparkSession, folder: str) -> DataFrame:
    rn = F.col("rn")

    def word(no: int, x0: float, text, show=None):
        one = F.struct(F.lit(no).alias("no"), F.lit(x0).alias("x0"), text.alias("word"))
        return one if show is None else F.when(show, one)

    listed = F.array(
        word(1, 0.0, F.col("l_partkey").cast("string")),
        word(2, 100.0, F.col("l_returnflag"), rn % 5 != 0),
        word(3, 135.0, F.col("l_suppkey").cast("string"), rn % 5 != 0),
        word(4, 300.0, F.col("l_linestatus"), (rn % 5 != 0) & (rn % 2 == 1)),
    )
    return line_rows(spark, folder).select(
        F.col("l_orderkey").alias("doc_id"),
        F.lit(1).alias("page"),
        "rn",
        F.inline(F.filter(listed, lambda w: w.isNotNull())),
    ).select(
        "doc_id",
        "page",
        (F.col("rn") * 10 + F.col("no")).alias("word_no"),
        "x0",
        (F.col("x0") + 30.0).alias("x1"),
        (F.lit(12.0) * F.col("rn") + F.col("no")).alias("y0"),
        "word",
    )


# --- doc_pages: documents cut into pages of 20 lines --------------------------------------------

CTE["doc_lines"] = """
SELECT doc_id, CAST(floor(i / 20) AS INTEGER) + 1 AS page, CAST(i AS BIGINT) AS line_no, line FROM (
  SELECT doc_id, unnest(range(len(l))) AS i, unnest(l) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"""
CTE["doc_pages"] = """
SELECT doc_id, page, string_agg(line, chr(10) ORDER BY line_no) AS text,
  CAST((doc_id + page) % 3 AS INTEGER) AS images, CAST((doc_id + page) % 12 AS INTEGER) AS drawings,
  CASE WHEN page % 2 = 0 THEN CAST(doc_id % 3 AS INTEGER) END AS tables,
  595.0 AS width, 842.0 AS height
FROM doc_lines GROUP BY doc_id, page"""
NEEDS["doc_pages"] = ("doc_lines",)


def doc_lines(spark: SparkSession, folder: str) -> DataFrame:
    return (
        table(spark, folder, "documents")
        .select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
        .select(
            "doc_id",
            (F.floor(F.col("i") / 20).cast("int") + 1).alias("page"),
            F.col("i").cast("bigint").alias("line_no"),
            "line",
        )
    )


def doc_pages(spark: SparkSession, folder: str) -> DataFrame:
    # Cut inside each text value: no shuffle, and a page is at most 20 lines.
    def cut(lines):
        numbers = F.sequence(F.lit(0), F.ceil(F.size(lines) / 20).cast("int") - 1)
        return F.transform(
            numbers, lambda n: F.array_join(F.slice(lines, n * 20 + 1, F.lit(20)), "\n")
        )

    pages = (
        table(spark, folder, "documents")
        .select("doc_id", F.posexplode(let(F.split("text", "\n"), cut)).alias("i", "text"))
        .select("doc_id", (F.col("i") + 1).alias("page"), "text")
    )
    both = F.col("doc_id") + F.col("page")
    return pages.select(
        "doc_id",
        "page",
        "text",
        (both % 3).cast("int").alias("images"),
        (both % 12).cast("int").alias("drawings"),
        F.when(F.col("page") % 2 == 0, (F.col("doc_id") % 3).cast("int")).alias("tables"),
        F.lit(595.0).alias("width"),
        F.lit(842.0).alias("height"),
    )


# --- page_tables: tables per page of a document ---------------------------------------------------
# A document is 200 orders, a page one order; every ninth page has a second table.

CTE["page_tables"] = """
SELECT CAST(floor(l_orderkey / 200) AS BIGINT) AS doc_id, CAST(l_orderkey % 200 + 1 AS INTEGER) AS page, t.table_index,
  CASE WHEN l_orderkey % 11 = 0 THEN [] WHEN l_orderkey % 4 = 0 THEN ['a', 'b', 'c'] ELSE ['a', 'b'] END AS headers,
  n AS row_estimate
FROM (SELECT l_orderkey, CAST(count(*) AS INTEGER) AS n FROM lineitem GROUP BY l_orderkey) o,
  LATERAL (SELECT 0 AS table_index UNION ALL SELECT 1 WHERE l_orderkey % 9 = 0) t"""


def page_tables(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("l_orderkey")
    empty = F.array().cast("array<string>")
    headers = (
        F.when(k % 11 == 0, empty)
        .when(k % 4 == 0, F.array(F.lit("a"), F.lit("b"), F.lit("c")))
        .otherwise(F.array(F.lit("a"), F.lit("b")))
    )
    return (
        table(spark, folder, "lineitem")
        .groupBy("l_orderkey")
        .agg(F.count(F.lit(1)).cast("int").alias("row_estimate"))
        .select(
            F.floor(k / 200).cast("bigint").alias("doc_id"),
            (k % 200 + 1).cast("int").alias("page"),
            F.explode(
                F.when(k % 9 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
            ).alias("table_index"),
            headers.alias("headers"),
            "row_estimate",
        )
    )


# --- usage: one model call per turn ---------------------------------------------------------------

CTE["usage"] = """
SELECT conv_id AS job_id, turn, role AS model, 'local' AS provider,
  greatest(1, CAST(floor(length(text) / 4) AS BIGINT)) AS prompt_tokens, turn * 10 AS completion_tokens
FROM conversations"""
CTE["prices"] = """
SELECT * FROM (VALUES ('local', 'user', 0.6, 1.6), ('local', 'assistant', 3.0, 15.0))
  AS p(provider, model, input_per_m, output_per_m)"""


def usage(spark: SparkSession, folder: str) -> DataFrame:
    from doctables.functions.text import estimate_tokens

    return table(spark, folder, "conversations").select(
        F.col("conv_id").alias("job_id"),
        "turn",
        F.col("role").alias("model"),
        F.lit("local").alias("provider"),
        estimate_tokens(F.col("text")).alias("prompt_tokens"),
        (F.col("turn") * 10).alias("completion_tokens"),
    )


def prices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [("local", "user", 0.6, 1.6), ("local", "assistant", 3.0, 15.0)],
        "provider string, model string, input_per_m double, output_per_m double",
    )


# --- users as records, events as decisions about them ------------------------------------------------

CTE["user_records"] = """
SELECT user_id AS record_id, min(value) AS amount, CAST(user_id % 100 AS DOUBLE) / 100 AS confidence,
  user_id % 4 = 0 AS is_flagged, user_id % 10 = 3 AS review_dismissed, 'valid' AS status
FROM events GROUP BY user_id"""
CTE["decisions"] = """
SELECT user_id AS record_id, event_id, ts, CASE event_type WHEN 'click' THEN 'accept' WHEN 'purchase' THEN 'edit'
    WHEN 'error' THEN 'reject' ELSE 'skip' END AS action,
  CASE event_type WHEN 'click' THEN 'approve_record' WHEN 'error' THEN 'reject_record'
    WHEN 'signup' THEN 'flag_record' ELSE 'view_record' END AS audit_action,
  value FROM events"""


def user_records(spark: SparkSession, folder: str) -> DataFrame:
    u = F.col("user_id")
    return (
        table(spark, folder, "events")
        .groupBy("user_id")
        .agg(F.min("value").alias("amount"))
        .select(
            u.alias("record_id"),
            "amount",
            ((u % 100).cast("double") / 100).alias("confidence"),
            (u % 4 == 0).alias("is_flagged"),
            (u % 10 == 3).alias("review_dismissed"),
            F.lit("valid").alias("status"),
        )
    )


def decisions(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.col("event_type")
    return table(spark, folder, "events").select(
        F.col("user_id").alias("record_id"),
        "event_id",
        "ts",
        F.when(kind == "click", "accept").when(kind == "purchase", "edit").when(kind == "error", "reject")
        .otherwise("skip").alias("action"),
        F.when(kind == "click", "approve_record").when(kind == "error", "reject_record")
        .when(kind == "signup", "flag_record").otherwise("view_record").alias("audit_action"),
        F.lit("amount").alias("field"),
        F.col("value").cast("string").alias("new_value"),
        F.lit(None).cast("string").alias("note"),
    )
