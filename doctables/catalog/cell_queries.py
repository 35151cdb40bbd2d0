"""Queries: normalisation, names, canonical values, schema inference."""

from __future__ import annotations

from pyspark.sql import functions as F

from doctables.catalog import inputs
from doctables.catalog.base import query, table
from doctables.catalog.inputs import CUSTOMER_FIELDS, with_inputs
from doctables.functions import canon, cells, fixed, lists, names, text
from doctables.operators import provenance, schema


def _in(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def normal_sql(source: str, field: str) -> str:
    """SQL of norm, kind and change flag for one field of `source`."""
    code, place = cells.is_code_field(field), cells.is_province_field(field)
    clean = f"trim(regexp_replace({field}, '\\s+', ' ', 'g'))"
    numbers = (
        ""
        if code
        else "WHEN regexp_full_match(clean, '-?[0-9]+') THEN 'int' "
        "WHEN regexp_full_match(clean, '-?[0-9]+\\.[0-9]+') THEN 'float' "
    )
    places = f"WHEN lower(clean) IN ({_in(fixed.PROVINCES)}) THEN 'province' " if place else ""
    pairs = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fixed.PROVINCES.items())
    plain = (
        "regexp_replace(regexp_replace(clean, '^(-?)0+([0-9])', '\\1\\2'), '(\\.[0-9]+?)0+$', '\\1')"
    )
    return f"""
SELECT record_id, '{field}' AS field, raw, norm, CASE kind WHEN 'province' THEN 'str' ELSE kind END AS kind,
  coalesce(CASE WHEN kind = 'null' THEN trim(raw) <> '' WHEN kind IN ('int', 'float') THEN clean <> raw
    WHEN kind = 'bool' THEN upper(norm[1]) || substr(norm, 2) <> raw ELSE norm <> raw END, false) AS is_modified
FROM (SELECT *, CASE WHEN kind = 'null' THEN NULL WHEN kind IN ('int', 'float') THEN
        CASE WHEN {plain} = '-0' THEN '0' ELSE {plain} END
      WHEN kind = 'bool' THEN CASE WHEN lower(clean) IN ({_in(fixed.TRUE_WORDS)}) THEN 'true' ELSE 'false' END
      WHEN kind = 'province' THEN CASE lower(clean) {pairs} END ELSE clean END AS norm
  FROM (SELECT *, CASE WHEN clean IS NULL OR lower(clean) IN ({_in(fixed.NULL_TOKENS)}) THEN 'null' {numbers}
          WHEN lower(clean) IN ({_in((*fixed.TRUE_WORDS, *fixed.FALSE_WORDS))}) THEN 'bool' {places}
          ELSE 'str' END AS kind
    FROM (SELECT record_id, {field} AS raw, {clean} AS clean FROM {source})))"""


inputs.CTE["cells"] = " UNION ALL ".join(normal_sql("customer_raw", f) for f in CUSTOMER_FIELDS)
inputs.NEEDS["cells"] = ("customer_raw",)


def normalized(spark, folder):
    return cells.normalize_frame(inputs.customer_raw(spark, folder), CUSTOMER_FIELDS)


@query(with_inputs("SELECT * FROM cells", "cells"))
def normalize_cells(spark, folder):
    return cells.to_cells(normalized(spark, folder), ["record_id"], CUSTOMER_FIELDS)


@query(
    with_inputs(
        """SELECT record_id, string_agg(CASE WHEN is_modified THEN field END, ',' ORDER BY CASE field
  WHEN 'name' THEN 1 WHEN 'nation_code' THEN 2 WHEN 'flag' THEN 3 WHEN 'balance' THEN 4 ELSE 5 END) AS modified,
  count(CASE WHEN is_modified THEN 1 END) AS n FROM cells GROUP BY record_id""",
        "cells",
    )
)
def modified_fields(spark, folder):
    changed = provenance.modified_fields(normalized(spark, folder), CUSTOMER_FIELDS)
    return normalized(spark, folder).select("record_id", changed.alias("c")).select(
        "record_id",
        F.when(F.size("c") > 0, F.array_join("c", ",")).alias("modified"),
        F.size("c").cast("bigint").alias("n"),
    )


def vote_sql(source: str, fields, lists_too: bool = True) -> str:
    """SQL of the type vote over text columns."""
    parts = []
    for i, f in enumerate(fields):
        parts.append(f"SELECT '{f}' AS field, {i} AS position, CAST({f} AS VARCHAR) AS v FROM {source}")
    many = "WHEN lists / filled >= 0.60 THEN 'LIST' " if lists_too else ""
    many_c = "WHEN lists / filled >= 0.60 THEN lists / filled " if lists_too else ""
    return f"""
SELECT field, position,
  CASE WHEN filled = 0 THEN 'STRING' WHEN bools / filled >= 0.85 THEN 'BOOLEAN' WHEN ints / filled >= 0.85 THEN 'INTEGER'
    WHEN (ints + floats) / filled >= 0.85 THEN 'FLOAT' {many} ELSE 'STRING' END AS data_type,
  round_even(CASE WHEN filled = 0 THEN 0.5 WHEN bools / filled >= 0.85 THEN bools / filled WHEN ints / filled >= 0.85 THEN ints / filled
    WHEN (ints + floats) / filled >= 0.85 THEN (ints + floats) / filled {many_c} ELSE 0.95 END, 2) AS confidence,
  n > 0 AND n = filled AS required
FROM (SELECT field, position, count(*) AS n, CAST(count(CASE WHEN k <> 'blank' THEN 1 END) AS DOUBLE) AS filled,
    count(CASE WHEN k = 'bool' THEN 1 END) AS bools, count(CASE WHEN k = 'int' THEN 1 END) AS ints,
    count(CASE WHEN k = 'float' THEN 1 END) AS floats, count(CASE WHEN k = 'list' THEN 1 END) AS lists
  FROM (SELECT field, position, CASE WHEN v IS NULL OR trim(v) = '' THEN 'blank'
      WHEN lower(trim(v)) IN ('true', 'false', 'yes', 'no') THEN 'bool'
      WHEN regexp_full_match(trim(v), '-?[1-9][0-9]*|-?0') THEN 'int'
      WHEN regexp_full_match(trim(v), '-?[0-9]+\\.[0-9]+') THEN 'float'
      WHEN contains(v, ';') OR len(string_split(v, ',')) > 2 THEN 'list' ELSE 'str' END AS k
    FROM ({" UNION ALL ".join(parts)})) GROUP BY field, position)"""


ORDER_FIELDS = ["o_orderkey", "o_custkey", "o_orderstatus", "total", "order_date"]


@query(with_inputs(vote_sql("orders_v1", ORDER_FIELDS), "orders_v1"))
def infer_types(spark, folder):
    df = inputs.orders_v1(spark, folder)
    return schema.infer_types(df.select(*[F.col(c).cast("string").alias(c) for c in ORDER_FIELDS]), ORDER_FIELDS)


@query(
    with_inputs(
        vote_sql("(SELECT record_id" + "".join(
            f", max(CASE WHEN field = '{f}' THEN norm END) AS {f}" for f in CUSTOMER_FIELDS
        ) + " FROM cells GROUP BY record_id)", CUSTOMER_FIELDS),
        "cells",
    )
)
def infer_normalized(spark, folder):
    """The vote over normal values, where kinds are known."""
    return schema.infer_types(normalized(spark, folder), CUSTOMER_FIELDS)


@query(with_inputs(vote_sql("order_parts", ["order_id", "flag", "parts"]), "order_parts"))
def infer_list_type(spark, folder):
    return schema.infer_types(inputs.order_parts(spark, folder), ["order_id", "flag", "parts"])


@query(
    with_inputs(
        """SELECT field, position, share FROM (
  SELECT field, position, avg(CASE WHEN contains(v, ';') OR contains(v, ',') THEN 1.0 ELSE 0.0 END) AS share FROM (
    SELECT 'order_id' AS field, 0 AS position, CAST(order_id AS VARCHAR) AS v FROM head UNION ALL
    SELECT 'flag', 1, flag FROM head UNION ALL SELECT 'parts', 2, parts FROM head)
  WHERE coalesce(v, '') <> '' GROUP BY field, position)
WHERE share >= 0.35 ORDER BY position LIMIT 1""".replace("FROM head", "FROM order_parts"),
        "order_parts",
    )
)
def detect_list_column(spark, folder):
    return schema.list_columns(inputs.order_parts(spark, folder), ["order_id", "flag", "parts"])


@query(
    """WITH h AS (SELECT DISTINCT p_type || ' ' || p_brand || ' (' || p_name || ')' AS header FROM part)
SELECT header, replace(lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(header, '[^\\w\\s-]', '', 'g'),
   '[-\\s]+', '_', 'g'), '(.)([A-Z][a-z]+)', '\\1_\\2', 'g'), '([a-z0-9])([A-Z])', '\\1_\\2', 'g')), '__', '_') AS snake FROM h"""
)
def header_names(spark, folder):
    header = F.concat("p_type", F.lit(" "), "p_brand", F.lit(" ("), "p_name", F.lit(")"))
    heads = table(spark, folder, "part").select(header.alias("header")).distinct()
    return heads.select("header", names.snake_case(F.col("header")).alias("snake"))


@query(
    """SELECT s_suppkey, CASE WHEN u > 1 THEN n || '_' || CAST(u AS VARCHAR) ELSE n END AS unique_name, display FROM (
  SELECT s_suppkey, n, 'Nation ' || CAST(k AS VARCHAR) AS display, row_number() OVER (PARTITION BY k, n ORDER BY s_suppkey) AS u FROM (
    SELECT s_suppkey, s_nationkey AS k, CASE WHEN s_suppkey % 3 = 0 THEN 'col' ELSE 'name' END AS n FROM supplier))"""
)
def unique_headers(spark, folder):
    heads = table(spark, folder, "supplier").select(
        F.col("s_nationkey").alias("k"),
        "s_suppkey",
        F.when(F.col("s_suppkey") % 3 == 0, "col").otherwise("name").alias("unique_name"),
    )
    shown = names.display_name(F.concat(F.lit("nation_"), F.col("k").cast("string")))
    return names.unique_names(heads, ["k"], "s_suppkey", "unique_name").select(
        "s_suppkey", "unique_name", shown.alias("display")
    )


@query(
    with_inputs(
        """SELECT record_id,
  CASE WHEN contains(fw, 'OQSF') OR contains(fw, 'OCCUPATIONAL') THEN 'OQSF' WHEN contains(fw, 'HEQSF') OR contains(fw, 'HIGHER') THEN 'HEQSF'
    WHEN contains(fw, 'GFET') OR contains(fw, 'GENERAL') OR contains(fw, 'FURTHER') THEN 'GFETQSF' ELSE fw END AS framework,
  CASE WHEN ns IN ('YES', 'ELIGIBLE', 'FUNDED', 'TRUE', '1', 'Y') THEN 'YES' WHEN ns IN ('NO', 'NOT ELIGIBLE', 'UNFUNDED', 'FALSE', '0', 'N', '') THEN 'NO' ELSE ns END AS nsfas,
  band, CASE band WHEN 'high' THEN 1.0 WHEN 'medium' THEN 0.8 ELSE 0.5 END AS score
FROM (SELECT record_id, upper(framework) AS fw, upper(nsfas) AS ns,
  CASE WHEN confidence >= 0.85 THEN 'high' WHEN confidence >= 0.60 THEN 'medium' ELSE 'low' END AS band FROM part_records)""",
        "part_records",
    )
)
def canonical_values(spark, folder):
    band = canon.confidence_band(F.col("confidence"))
    return inputs.part_records(spark, folder).select(
        "record_id",
        canon.framework(F.col("framework")).alias("framework"),
        canon.yes_no(F.col("nsfas")).alias("nsfas"),
        band.alias("band"),
        canon.confidence_score(band).alias("score"),
    )


@query(
    """SELECT p_partkey, regexp_replace(p_brand, '[^0-9]', '', 'g') AS digits, regexp_extract(p_brand || '-' || p_name, '([0-9]+)', 1) AS first_number,
  coalesce(nullif(CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_type END, ''), p_name) AS first_filled,
  'v' || CAST(p_size AS VARCHAR) AS merged_a, p_brand AS merged_b FROM part"""
)
def scalar_text(spark, folder):
    merged = canon.merge_maps(
        F.create_map(F.lit("a"), F.col("p_name"), F.lit("b"), F.col("p_brand")),
        F.create_map(F.lit("a"), F.concat(F.lit("v"), F.col("p_size").cast("string"))),
    )
    return table(spark, folder, "part").select(
        "p_partkey",
        text.digits_only(F.col("p_brand")).alias("digits"),
        text.first_number(F.concat_ws("-", "p_brand", "p_name")).alias("first_number"),
        text.first_filled(F.when(F.col("p_partkey") % 3 != 0, F.col("p_type")).otherwise(" "), F.col("p_name")).alias(
            "first_filled"
        ),
        merged["a"].alias("merged_a"),
        merged["b"].alias("merged_b"),
    )


_ITEM = """CASE rn % 4 WHEN 0 THEN p_name WHEN 1 THEN CAST(rn AS VARCHAR) || '. ' || p_name WHEN 2 THEN 'TVET' ELSE '- ' || upper(p_name) || ' ,' END"""


@query(
    with_inputs(
        f"""SELECT order_id, string_agg(item, '|' ORDER BY pos) AS names, count(*) AS n FROM (
  SELECT order_id, item, pos, row_number() OVER (PARTITION BY order_id, lower(item) ORDER BY pos) AS seen FROM (
    SELECT order_id, pos, trim(regexp_replace(c, '^[0-9]+[.)]\\s*', '')) AS item FROM (
      SELECT order_id, pos, trim(regexp_replace(x, '\\s+', ' ', 'g'), ' ;,-') AS c FROM (
        SELECT order_id, min(rn) AS pos, string_agg(x, ' ' ORDER BY rn) AS x FROM (
          SELECT order_id, rn, x, sum(CASE WHEN order_id % 2 = 1 AND rn > 1 AND (lower(x) IN ({_in(fixed.GLUE_WORDS)}) OR lower(x) LIKE 'college%'
              OR lower(x) LIKE 'campus%' OR prev LIKE '%,' OR prev LIKE '%-') THEN 0 ELSE 1 END) OVER (PARTITION BY order_id ORDER BY rn) AS g FROM (
            SELECT l_orderkey AS order_id, rn, {_ITEM} AS x, lag({_ITEM}) OVER (PARTITION BY l_orderkey ORDER BY rn) AS prev
            FROM line_rows JOIN part ON p_partkey = l_partkey))
        GROUP BY order_id, g))
    WHERE length(c) >= 3 AND lower(c) NOT IN ({_in(fixed.LIST_STOPWORDS)}))
  WHERE item <> '' AND lower(item) NOT IN ({_in(fixed.LIST_STOPWORDS)}))
WHERE seen = 1 GROUP BY order_id""",
        "line_rows",
    )
)
def list_cleaner(spark, folder):
    rn, name = F.col("rn"), F.col("p_name")
    item = (
        F.when(rn % 4 == 0, name)
        .when(rn % 4 == 1, F.concat(rn.cast("string"), F.lit(". "), name))
        .when(rn % 4 == 2, "TVET")
        .otherwise(F.concat(F.lit("- "), F.upper(name), F.lit(" ,")))
    )
    lines = (
        inputs.line_rows(spark, folder)
        .join(table(spark, folder, "part"), F.col("p_partkey") == F.col("l_partkey"))
        .select(F.col("l_orderkey").alias("order_id"), "rn", item.alias("item"))
    )
    cell = lines.groupBy("order_id").agg(
        F.expr("listagg(item, '\n') within group (order by rn)").alias("by_line"),
        F.expr("listagg(item, ';') within group (order by rn)").alias("by_mark"),
        F.count(F.lit(1)).alias("_n"),
    )
    text_of = F.when((F.col("order_id") % 2 == 1) & (F.col("_n") > 1), F.col("by_line")).otherwise(F.col("by_mark"))
    return (
        cell.select("order_id", lists.clean_list(text_of).alias("names"))
        .filter(F.size("names") > 0)
        .select("order_id", F.array_join("names", "|").alias("names"), F.size("names").cast("bigint").alias("n"))
    )
