"""Queries: dedup, decomposition, keys, junctions, comparison of tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from doctables.catalog import inputs
from doctables.catalog.base import query, table
from doctables.catalog.inputs import with_inputs
from doctables.functions import fixed
from doctables.functions.lists import split_items
from doctables.operators import compare, relational, review, schema
from doctables.sources import sinks


def _keyed_lines(spark, folder):
    return inputs.line_rows(spark, folder).withColumn("row_index", F.col("l_orderkey") * 100 + F.col("rn"))


@query(
    with_inputs(
        "SELECT l_partkey, l_orderkey, rn, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, rn) AS k FROM line_rows) WHERE k = 1",
        "line_rows",
    )
)
def dedup_first(spark, folder):
    rows = _keyed_lines(spark, folder).select("l_partkey", "l_orderkey", "rn", "l_suppkey", "row_index")
    return relational.deduplicate(rows, "row_index", ["l_partkey"]).drop("row_index")


@query(
    "SELECT count(*) AS rows, count(DISTINCT l_orderkey) AS unique_rows, count(*) - count(DISTINCT l_orderkey) AS duplicates FROM lineitem"
)
def dedup_count(spark, folder):
    return relational.duplicate_count(table(spark, folder, "lineitem"), ["l_orderkey"])


@query(
    with_inputs(
        """SELECT order_id, flag, row_index FROM (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY row_index) AS k FROM order_parts) WHERE k = 1 AND order_id % 13 <> 0
UNION ALL SELECT NULL, flag, row_index FROM order_parts WHERE order_id % 13 = 0""",
        "order_parts",
    )
)
def decompose_parent(spark, folder):
    rows = inputs.order_parts(spark, folder).withColumn(
        "order_id", F.when(F.col("order_id") % 13 != 0, F.col("order_id"))
    )
    return relational.decompose_parent(rows, "parts", "order_id", "row_index")


@query("SELECT DISTINCT l_orderkey AS order_id, CAST(l_partkey AS VARCHAR) AS item_name FROM lineitem")
def decompose_child(spark, folder):
    return relational.decompose_child(inputs.order_parts(spark, folder), "parts", "order_id", "item_name")


@query(
    """SELECT order_id, string_agg(p, '; ' ORDER BY n) AS part FROM (
  SELECT l_orderkey AS order_id, CAST(l_partkey AS VARCHAR) AS p, l_partkey AS n FROM lineitem GROUP BY l_orderkey, l_partkey) GROUP BY order_id"""
)
def decompose_round_trip(spark, folder):
    rows = inputs.order_parts(spark, folder)
    child = relational.decompose_child(rows, "parts", "order_id", "part").withColumn(
        "n", F.col("part").cast("bigint")
    )
    parents = rows.select("order_id").distinct()
    return relational.joined_children(parents, {"parts": (child, "n", "part")}, "order_id").select(
        "order_id", F.col("parts").alias("part")
    )


def _in(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


@query(
    f"""WITH dim AS (SELECT 'C' || lpad(CAST(r_regionkey + 1 AS VARCHAR), 4, '0') AS college_id, r_name AS college_name FROM region),
names AS (SELECT CASE WHEN p_partkey % 50 = 0 THEN ' ' || upper(p_name) WHEN p_partkey % 61 = 0 THEN 'Asia' WHEN p_partkey % 67 = 0 THEN 'no' ELSE p_name END AS n, p_partkey FROM part),
fresh AS (SELECT trim(n) AS n, min(p_partkey) AS seen FROM names WHERE length(trim(n)) >= 3 AND lower(trim(n)) NOT IN ({_in(fixed.LIST_STOPWORDS)})
  AND trim(n) NOT IN (SELECT college_name FROM dim) GROUP BY trim(n))
SELECT college_id, college_name, NULL AS data_quality_flag FROM dim
UNION ALL SELECT 'C' || CASE WHEN k < 10000 THEN lpad(CAST(k AS VARCHAR), 4, '0') ELSE CAST(k AS VARCHAR) END, n,
  CASE WHEN EXISTS (SELECT 1 FROM fresh o WHERE lower(o.n) = lower(f.n) AND o.seen < f.seen) OR lower(n) IN (SELECT lower(college_name) FROM dim) THEN 'review_possible_variant' END
FROM (SELECT *, row_number() OVER (ORDER BY seen, n) + (SELECT count(*) FROM dim) AS k FROM fresh) f"""
)
def surrogate_keys(spark, folder):
    dim = table(spark, folder, "region").select(
        F.concat(F.lit("C"), F.lpad((F.col("r_regionkey") + 1).cast("string"), 4, "0")).alias("college_id"),
        F.col("r_name").alias("college_name"),
        F.lit(None).cast("string").alias("data_quality_flag"),
    )
    k = F.col("p_partkey")
    name = (
        F.when(k % 50 == 0, F.concat(F.lit(" "), F.upper("p_name")))
        .when(k % 61 == 0, "Asia")
        .when(k % 67 == 0, "no")
        .otherwise(F.col("p_name"))
    )
    names = table(spark, folder, "part").select(name.alias("college_name"), "p_partkey")
    return relational.extend_dimension(dim, names, "college_name", "p_partkey", "college_id")


@query(
    """SELECT DISTINCT l_orderkey AS order_id, 'P' || l_partkey AS part_id FROM lineitem WHERE l_orderkey % 10 <> 0"""
)
def junction_pairs(spark, folder):
    rows = inputs.order_parts(spark, folder)
    dim = table(spark, folder, "part").select(
        F.col("p_partkey").cast("string").alias("name"),
        F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("part_id"),
    )
    stored = (
        table(spark, folder, "lineitem")
        .filter("l_orderkey % 10 = 0")
        .select(
            F.col("l_orderkey").alias("order_id"),
            F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("part_id"),
        )
        .distinct()
    )
    pairs = relational.junction_pairs(
        rows, dim, "order_id", split_items(F.col("parts")), "name", "part_id", stored
    )
    return pairs.select("order_id", "part_id")


@query(
    """SELECT DISTINCT l_orderkey AS order_id, CAST(l_partkey AS VARCHAR) AS name FROM lineitem WHERE l_returnflag = 'R' OR l_orderkey % 3 = 0"""
)
def conditional_junction(spark, folder):
    section = F.when(F.col("flag") == "R", "Section 2: DSPP centres").otherwise("Section 1")
    context = F.when(F.col("order_id") % 3 == 0, "trade")
    rows = inputs.order_parts(spark, folder).filter(relational.is_specialisation(section, context))
    dim = table(spark, folder, "part").select(
        F.col("p_partkey").cast("string").alias("name"), F.col("p_partkey").alias("id")
    )
    return relational.junction_pairs(
        rows, dim, "order_id", split_items(F.col("parts")), "name", "id"
    ).select("order_id", "name")


@query(
    """SELECT n_nationkey, part, suppliers, customers FROM (SELECT n_nationkey, 0 AS part FROM nation)
LEFT JOIN (SELECT s_nationkey AS k, string_agg(s_name, ',' ORDER BY s_suppkey) AS suppliers FROM supplier GROUP BY s_nationkey) ON n_nationkey = k
LEFT JOIN (SELECT c_nationkey AS c, string_agg(c_name || ':' || c_mktsegment, ',' ORDER BY c_custkey) AS customers FROM customer GROUP BY c_nationkey) ON n_nationkey = c"""
)
def relational_nested(spark, folder):
    suppliers = table(spark, folder, "supplier").withColumnRenamed("s_nationkey", "n_nationkey")
    customers = table(spark, folder, "customer").withColumnRenamed("c_nationkey", "n_nationkey")
    nested = relational.nested_children(
        table(spark, folder, "nation"),
        {
            "suppliers": (suppliers, "s_suppkey", ["s_name"]),
            "customers": (customers, "c_custkey", ["c_name", "c_mktsegment"]),
        },
        "n_nationkey",
    )
    joined = lambda c, x: F.when(F.size(c) > 0, F.array_join(F.transform(c, x), ","))
    return nested.select(
        "n_nationkey",
        "part",
        joined("suppliers", lambda s: s["s_name"]).alias("suppliers"),
        joined("customers", lambda c: F.concat_ws(":", c["c_name"], c["c_mktsegment"])).alias("customers"),
    )


@query(
    """SELECT CAST(n_nationkey AS VARCHAR) AS saqa_id, n_name, coalesce(s, '') AS participating_colleges, coalesce(c, '') AS dspp_programmes, 1.0 AS confidence FROM nation
LEFT JOIN (SELECT s_nationkey AS k, string_agg(s_name, '; ' ORDER BY s_suppkey) AS s FROM supplier GROUP BY s_nationkey) ON n_nationkey = k
LEFT JOIN (SELECT c_nationkey AS j, string_agg(c_mktsegment, '; ' ORDER BY c_custkey) AS c FROM customer GROUP BY c_nationkey) ON n_nationkey = j"""
)
def relational_listagg(spark, folder):
    key = lambda c: F.col(c).cast("string").alias("saqa_id")
    parents = table(spark, folder, "nation").select(
        key("n_nationkey"), "n_name", F.lit("high").alias("confidence"), F.lit(None).cast("string").alias("nqf_level")
    )
    suppliers = table(spark, folder, "supplier").select(
        key("s_nationkey"), "s_suppkey", F.col("s_name").alias("college_name")
    )
    customers = table(spark, folder, "customer").select(
        key("c_nationkey"), "c_custkey", F.col("c_mktsegment").alias("programme_context")
    )
    out = sinks.relational_export(parents, (suppliers, "s_suppkey"), (customers, "c_custkey"))
    return out.select(
        "saqa_id", "n_name", "participating_colleges", "dspp_programmes", F.col("_prov_confidence").alias("confidence")
    )


@query(
    """SELECT n_nationkey, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS suppliers,
  (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > 5000) AS customers FROM nation"""
)
def relational_counts(spark, folder):
    suppliers = table(spark, folder, "supplier").withColumnRenamed("s_nationkey", "n_nationkey")
    customers = (
        table(spark, folder, "customer").filter("c_acctbal > 5000").withColumnRenamed("c_nationkey", "n_nationkey")
    )
    nations = table(spark, folder, "nation").select("n_nationkey")
    return relational.counts_per(nations, {"suppliers": suppliers, "customers": customers}, "n_nationkey")


@query(
    with_inputs(
        """SELECT l_suppkey, l_partkey FROM (SELECT l_suppkey, l_partkey, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, rn) AS k FROM line_rows)
WHERE k = 1 AND l_partkey % 3 <> 0 UNION ALL SELECT -1, p_partkey FROM part WHERE p_partkey % 3 = 0""",
        "line_rows",
    )
)
def insert_absent(spark, folder):
    stored = table(spark, folder, "part").filter("p_partkey % 3 = 0").select(
        F.lit(-1).cast("bigint").alias("l_suppkey"), F.col("p_partkey").alias("l_partkey")
    )
    batch = _keyed_lines(spark, folder).select("l_suppkey", "l_partkey", "row_index")
    return relational.insert_absent(stored, batch, "l_partkey", "row_index")


@query(
    """SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'patched' ELSE c_name END AS c_name, c_nationkey FROM customer WHERE c_custkey % 7 <> 0
UNION ALL SELECT c_custkey + 1000000, 'new', NULL FROM customer WHERE c_custkey % 11 = 0"""
)
def apply_changes(spark, folder):
    rows = table(spark, folder, "customer").select("c_custkey", "c_name", "c_nationkey")
    k = F.col("c_custkey")
    return relational.apply_changes(
        rows,
        "c_custkey",
        deletes=rows.filter(k % 7 == 0),
        updates=rows.filter(k % 5 == 0).select("c_custkey", F.lit("patched").alias("c_name")),
        inserts=rows.filter(k % 11 == 0).select((k + 1_000_000).alias("c_custkey"), F.lit("new").alias("c_name")),
    )


@query(
    """SELECT dataset, count(*) AS n, sum(v) AS total FROM (
  SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'a' ELSE 'b' END AS dataset, 1 AS v FROM orders WHERE o_orderkey % 3 <> 1
  UNION ALL SELECT 'c', 1 FROM orders WHERE o_orderkey % 3 = 1) WHERE dataset <> 'b' GROUP BY dataset
UNION ALL SELECT 'b', count(*), count(*) * 2 FROM orders WHERE o_orderkey % 5 = 0"""
)
def merge_run(spark, folder):
    k = F.col("o_orderkey")
    name = F.when(k % 3 == 0, "a").when(k % 3 == 1, "c").otherwise("b")
    orders = table(spark, folder, "orders")
    stored = orders.select(name.alias("dataset"), F.lit(1).alias("v"))
    run = orders.filter(k % 5 == 0).select(F.lit("b").alias("dataset"), F.lit(2).alias("v"))
    merged = relational.merge_run(stored, run, selective=True)
    return merged.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"))


# Both editions joined by key; NULL on one side means added or removed.
inputs.CTE["edition_diff"] = """
SELECT coalesce(o.o_orderkey, n.o_orderkey) AS key, CASE WHEN o.o_orderkey IS NULL THEN 'ADDED' WHEN n.o_orderkey IS NULL THEN 'REMOVED'
    WHEN o.o_orderstatus <> n.o_orderstatus OR o.total <> n.total THEN 'MODIFIED' ELSE 'UNCHANGED' END AS diff_type,
  CASE WHEN o.o_orderstatus <> n.o_orderstatus THEN o.o_orderstatus END AS old_status, CASE WHEN o.o_orderstatus <> n.o_orderstatus THEN n.o_orderstatus END AS new_status,
  o.total <> n.total AS total_changed
FROM orders_v1 o FULL JOIN orders_v2 n ON o.o_orderkey = n.o_orderkey"""
inputs.NEEDS["edition_diff"] = ("orders_v1", "orders_v2")


@query(
    with_inputs(
        """SELECT CAST(key AS VARCHAR) AS key, diff_type, CASE WHEN diff_type <> 'MODIFIED' THEN '' ELSE
  array_to_string(list_filter([CASE WHEN old_status IS NOT NULL THEN 'o_orderstatus' END, CASE WHEN total_changed THEN 'total' END], lambda x: x IS NOT NULL), ',') END AS changed,
  old_status, new_status FROM edition_diff WHERE diff_type <> 'UNCHANGED'""",
        "edition_diff",
    )
)
def dataset_diff(spark, folder):
    diff = compare.dataset_diff(inputs.orders_v1(spark, folder), inputs.orders_v2(spark, folder), "o_orderkey")
    changed = F.col("diff_type") == "MODIFIED"
    return diff.select(
        "key",
        "diff_type",
        F.array_join("changed_fields", ",").alias("changed"),
        F.when(changed, F.col("old_values")["o_orderstatus"]).alias("old_status"),
        F.when(changed, F.col("new_values")["o_orderstatus"]).alias("new_status"),
    )


@query(with_inputs("SELECT diff_type, count(*) AS records FROM edition_diff GROUP BY diff_type", "edition_diff"))
def diff_counts(spark, folder):
    return compare.diff_counts(inputs.orders_v1(spark, folder), inputs.orders_v2(spark, folder), "o_orderkey")


@query(
    with_inputs(
        """SELECT c AS column_name, CASE WHEN c = 'priority' THEN 'new' ELSE 'common' END AS change, CASE WHEN c = 'priority' THEN 0 ELSE n_old END AS old_values, n_new AS new_values
FROM (SELECT count(*) AS n_old FROM orders_v1), (SELECT count(*) AS n_new FROM orders_v2),
  (VALUES ('o_orderkey'), ('o_custkey'), ('o_orderstatus'), ('total'), ('order_date'), ('priority')) v(c)""",
        "orders_v1",
        "orders_v2",
    )
)
def schema_diff(spark, folder):
    old, new = inputs.orders_v1(spark, folder), inputs.orders_v2(spark, folder)
    filled = lambda df, name: schema.column_votes(df, df.columns).select(
        F.col("field").alias("column_name"), F.col("filled").alias(name)
    )
    return (
        compare.schema_diff(old, new)
        .join(filled(old, "old_values"), "column_name", "left")
        .join(filled(new, "new_values"), "column_name", "left")
        .fillna(0, ["old_values", "new_values"])
    )


@query(
    with_inputs(
        """SELECT CAST(key AS VARCHAR) AS key, CASE diff_type WHEN 'ADDED' THEN 'added' WHEN 'REMOVED' THEN 'removed' ELSE 'common' END AS side FROM edition_diff""",
        "edition_diff",
    )
)
def key_sets(spark, folder):
    return compare.key_sets(inputs.orders_v1(spark, folder), inputs.orders_v2(spark, folder), "o_orderkey")


# Without an id the name identifies, and names differ by case only, so it never
# finds an id of the other side.
inputs.CTE["matched"] = """
SELECT a.row_index, a.id AS a_id, b.id AS b_id, a.name AS a_name, b.name AS b_name, a.segment AS a_segment, b.segment AS b_segment,
  a.nation AS a_nation, b.nation AS b_nation, b.id IS NOT NULL AS found
FROM model_a a LEFT JOIN model_b b ON a.id = b.id"""
inputs.NEEDS["matched"] = ("model_a", "model_b")
inputs.CTE["model_conflicts"] = """
SELECT row_index, 'segment' AS field_name, a_segment AS value_a, b_segment AS value_b FROM matched WHERE found AND a_segment <> b_segment
UNION ALL SELECT row_index, 'nation', a_nation, b_nation FROM matched WHERE found AND a_nation <> coalesce(b_nation, '')"""
inputs.NEEDS["model_conflicts"] = ("matched",)


def _matched(spark, folder):
    a, b = inputs.model_a(spark, folder), inputs.model_b(spark, folder)
    return compare.match_extractions(
        a, b, compare.identifier(a.columns), compare.identifier(b.columns), "row_index"
    )


_SKIP = ["row_index"]


@query(with_inputs("SELECT * FROM model_conflicts", "model_conflicts"))
def reconcile_conflicts(spark, folder):
    found = compare.conflicts(_matched(spark, folder), "a", "b", _SKIP)
    return found.select("row_index", "field_name", "value_a", "value_b")


@query(
    with_inputs(
        """SELECT total_records_a, total_records_b, matched_records, matched_records * 4 AS fields_compared, matched_records * 4 - c AS fields_equal,
  round_even((matched_records * 4 - c) / CAST(matched_records * 4 AS DOUBLE) * 100, 2) AS agreement_rate FROM (
  SELECT (SELECT count(*) FROM model_a) AS total_records_a, (SELECT count(*) FROM model_b) AS total_records_b, (SELECT count(*) FROM matched WHERE found) AS matched_records,
    (SELECT count(*) FROM model_conflicts) AS c)""",
        "model_conflicts",
    )
)
def agreement_rate(spark, folder):
    return compare.agreement(_matched(spark, folder), inputs.model_b(spark, folder), _SKIP)


@query(
    with_inputs(
        """SELECT row_index, a_id AS id, a_segment AS segment, found AND a_segment <> b_segment AS segment_conflict, found AND a_nation <> coalesce(b_nation, '') AS nation_conflict FROM matched
UNION ALL SELECT b.row_index, b.id, b.segment, NULL, NULL FROM model_b b WHERE b.id NOT IN (SELECT id FROM model_a WHERE id IS NOT NULL)""",
        "matched",
    )
)
def reconciled_records(spark, folder):
    b = inputs.model_b(spark, folder)
    matched = _matched(spark, folder)
    extra = compare.only_in_b(matched, b, compare.identifier(b.columns))
    return compare.reconciled(matched, _SKIP, extra).select(
        "row_index",
        "id",
        "segment",
        F.col("__conflict_segment").alias("segment_conflict"),
        F.col("__conflict_nation").alias("nation_conflict"),
    )


@query(
    with_inputs(
        """SELECT coalesce(nullif(value_a, ''), value_b, '') AS original_value, 'model_disagreement_' || field_name AS issue, count(*) AS n FROM model_conflicts GROUP BY 1, 2""",
        "model_conflicts",
    )
)
def conflict_review(spark, folder):
    found = compare.conflicts(_matched(spark, folder), "a", "b", _SKIP)
    review = compare.conflicts_to_review(found)
    return review.groupBy("original_value", "issue").agg(F.count(F.lit(1)).alias("n"))


inputs.CTE["golden_pairs"] = """
SELECT coalesce(g.id, p.id) AS id, g.id IS NULL AS extra, p.id IS NULL AS missing, g.quality AS gq, p.quality AS pq FROM golden g FULL JOIN predicted p ON g.id = p.id"""
inputs.NEEDS["golden_pairs"] = ("golden", "predicted")


@query(
    with_inputs(
        """SELECT total_expected, total_actual, matched_records, missing_records, extra_records, field_mismatches, record_recall, record_precision,
  round_even(2 * record_precision * record_recall / greatest(0.001, record_precision + record_recall), 2) AS record_f1,
  round_even((matched_records * 2 - field_mismatches) / CAST(matched_records * 2 AS DOUBLE) * 100, 2) AS field_accuracy FROM (
  SELECT *, round_even(matched_records / CAST(total_expected AS DOUBLE) * 100, 2) AS record_recall, round_even(matched_records / CAST(total_actual AS DOUBLE) * 100, 2) AS record_precision FROM (
    SELECT (SELECT count(*) FROM golden) AS total_expected, (SELECT count(*) FROM predicted) AS total_actual, count(CASE WHEN NOT extra AND NOT missing THEN 1 END) AS matched_records,
      count(CASE WHEN missing THEN 1 END) AS missing_records, count(CASE WHEN extra THEN 1 END) AS extra_records, count(CASE WHEN gq <> pq THEN 1 END) AS field_mismatches FROM golden_pairs))""",
        "golden_pairs",
    )
)
def golden_eval(spark, folder):
    expected = compare.golden_columns(inputs.golden(spark, folder))
    return compare.golden_report(expected, inputs.predicted(spark, folder), compare.golden_key(expected.columns))


@query(
    with_inputs(
        "SELECT id AS identifier, 'quality' AS field_name, gq AS expected_value, pq AS actual_value FROM golden_pairs WHERE gq <> pq",
        "golden_pairs",
    )
)
def eval_mismatches(spark, folder):
    return compare.golden_mismatches(inputs.golden(spark, folder), inputs.predicted(spark, folder), "id")


@query(
    with_inputs(
        "SELECT 'extra' AS side, id AS identifier FROM (SELECT id FROM golden_pairs WHERE extra ORDER BY id LIMIT 10) UNION ALL SELECT 'missing', id FROM (SELECT id FROM golden_pairs WHERE missing ORDER BY id LIMIT 10)",
        "golden_pairs",
    )
)
def golden_samples(spark, folder):
    return compare.golden_samples(inputs.golden(spark, folder), inputs.predicted(spark, folder), "id")


@query(
    """WITH g AS (SELECT row_number() OVER (ORDER BY doc_id) AS n, CAST(quality AS VARCHAR) AS quality FROM labels),
a AS (SELECT row_number() OVER (ORDER BY doc_id) AS n, CASE WHEN n_chars >= 200 THEN '1' ELSE '0' END AS quality FROM documents),
m AS (SELECT count(*) AS matched, count(CASE WHEN g.quality <> a.quality THEN 1 END) AS wrong FROM g JOIN a USING (n)),
c AS (SELECT (SELECT count(*) FROM g) AS expected, (SELECT count(*) FROM a) AS actual, matched, wrong FROM m)
SELECT expected AS total_expected, actual AS total_actual, matched AS matched_records, expected - matched AS missing_records, actual - matched AS extra_records,
  wrong AS field_mismatches, round_even(matched / CAST(expected AS DOUBLE) * 100, 2) AS record_recall, round_even(matched / CAST(actual AS DOUBLE) * 100, 2) AS record_precision,
  round_even((matched - wrong) / CAST(matched AS DOUBLE) * 100, 2) AS field_accuracy FROM c"""
)
def golden_by_row(spark, folder):
    """A golden table without an id column: rows are compared by their place."""
    expected = table(spark, folder, "labels").select("doc_id", F.col("quality").cast("string").alias("quality"))
    actual = inputs.predicted(spark, folder).select(F.col("id").cast("bigint").alias("doc_id"), "quality")
    return compare.golden_report(expected, actual, None, order="doc_id").drop("record_f1")


@query(
    """SELECT o_orderkey, CASE WHEN u.n IS NULL THEN o_orderstatus ELSE 's' || u.n END AS o_orderstatus FROM orders
LEFT JOIN (SELECT l_orderkey, max(l_linenumber) AS n FROM lineitem WHERE l_linenumber < 4 GROUP BY l_orderkey) u ON l_orderkey = o_orderkey"""
)
def repeated_updates(spark, folder):
    """Several updates of a key in one batch: the last by `order` counts."""
    updates = table(spark, folder, "lineitem").filter("l_linenumber < 4").select(
        F.col("l_orderkey").alias("o_orderkey"), F.concat(F.lit("s"), F.col("l_linenumber").cast("string")).alias("o_orderstatus"), "l_linenumber"
    )
    return relational.apply_changes(table(spark, folder, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", updates=updates, order="l_linenumber")


@query(
    """SELECT o_orderkey AS review_id, coalesce(u.n % 2 = 0, false) AS resolved, 'r' || u.n AS resolved_by, 'day ' || u.n AS resolved_at FROM orders
LEFT JOIN (SELECT l_orderkey, max(l_linenumber) AS n FROM lineitem WHERE l_linenumber < 4 GROUP BY l_orderkey) u ON l_orderkey = o_orderkey"""
)
def review_resolve(spark, folder):
    """Review items resolved several times: the last resolution counts and no item is doubled."""
    n = F.col("l_linenumber").cast("string")
    done = table(spark, folder, "lineitem").filter("l_linenumber < 4").select(
        F.col("l_orderkey").alias("review_id"), (F.col("l_linenumber") % 2 == 0).alias("resolved"), F.concat(F.lit("r"), n).alias("resolved_by"),
        F.concat(F.lit("day "), n).alias("resolved_at"), "l_linenumber",
    )
    none = F.lit(None).cast("string")
    items = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("review_id"), F.lit(False).alias("resolved"), none.alias("resolved_by"), none.alias("resolved_at")
    )
    return review.resolve_review(items, done, order="l_linenumber")


@query(with_inputs("SELECT 'job' || row_index % 3 AS job_id, row_index, field_name, value_a, value_b FROM model_conflicts", "model_conflicts"))
def job_conflicts(spark, folder):
    """Conflicts of several jobs reconciled at once, each with its job."""
    job = F.concat(F.lit("job"), (F.col("row_index") % 3).cast("string"))
    a, b = inputs.model_a(spark, folder).withColumn("job", job), inputs.model_b(spark, folder)
    matched = compare.match_extractions(a, b, compare.identifier(a.columns), compare.identifier(b.columns), "row_index")
    return compare.conflicts(matched, "a", "b", _SKIP, job="job").select("job_id", "row_index", "field_name", "value_a", "value_b")
