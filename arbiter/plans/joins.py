"""Join queries: leakage (J1, J2), reconciliation (J6), duplicates (J7),
missing references (J8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from arbiter.operators.leakage import duplicate_states, leakage, leakage_counts
from arbiter.operators.recon import find_duplicates, reconcile, unreferenced
from arbiter.plans import oracle_fixtures as O
from arbiter.plans.registry import query
from arbiter.session import Tables
from arbiter.sources import fixtures as X


def _leak_sql() -> str:
    return f"""WITH r AS ({O.doc_records()}),
      f AS (SELECT state, min(split_rank) AS first_rank FROM r GROUP BY state)
      SELECT (['train', 'valid', 'test'])[f.first_rank + 1] AS first_split, r.split, r.rec_id,
             substr(r.state, 1, 80) AS preview
      FROM r JOIN f ON r.state = f.state WHERE r.split_rank > f.first_rank"""


@query("j1_split_leakage", sql=_leak_sql)
def j1_split_leakage(spark, sf_dir):
    """Documents seen in an earlier split (train → valid → test)."""
    return leakage(X.doc_records(Tables(spark, sf_dir).documents))


@query(
    "j1_leakage_counts",
    sql=lambda: f"SELECT first_split, split, count(*) AS n FROM ({_leak_sql()}) GROUP BY 1, 2",
)
def j1_leakage_counts(spark, sf_dir):
    """J1 summary: leaked rows per (first split, split)."""
    return leakage_counts(leakage(X.doc_records(Tables(spark, sf_dir).documents)))


@query(
    "j2_duplicate_states",
    sql="SELECT sha256(text) AS state_sha256, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1",
)
def j2_duplicate_states(spark, sf_dir):
    """Strict global uniqueness of states."""
    return duplicate_states(X.doc_records(Tables(spark, sf_dir).documents))


# Money in DECIMAL: exact products and order-independent sums, so the result
# does not depend on how rows are partitioned.
def line_total():
    return (
        F.col("l_extendedprice").cast("decimal(15,2)")
        * (1 - F.col("l_discount").cast("decimal(4,2)"))
        * (1 + F.col("l_tax").cast("decimal(4,2)"))
    )


def _recon(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return reconcile(
        t.orders,
        t.lineitem,
        "o_orderkey",
        "l_orderkey",
        F.col("o_totalprice"),
        line_total(),
        tolerance=0.1,
        relative=True,
    )


def _recon_sql() -> str:
    return """WITH o AS (SELECT o_orderkey AS ref, count(*) AS l_n,
          CAST(round(sum(o_totalprice), 2) AS DECIMAL(24,2)) AS a FROM orders GROUP BY 1),
      l AS (SELECT l_orderkey AS ref, count(*) AS r_n,
          CAST(round(sum(CAST(l_extendedprice AS DECIMAL(15,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))
                         * (1 + CAST(l_tax AS DECIMAL(4,2)))), 2) AS DECIMAL(24,2)) AS b
          FROM lineitem GROUP BY 1)
      SELECT coalesce(o.ref, l.ref) AS ref, a, b,
        CASE WHEN o.ref IS NULL OR l.ref IS NULL THEN 'needs_review'
             WHEN l_n > 1 THEN 'mismatch'
             WHEN a = b THEN 'match'
             WHEN abs(a - b) <= 0.1 * abs(b) THEN 'match' ELSE 'mismatch' END AS status
      FROM o FULL OUTER JOIN l ON o.ref = l.ref"""


@query("j6_reconcile", sql=lambda: f"SELECT ref, a, b, status FROM ({_recon_sql()})")
def j6_reconcile(spark, sf_dir):
    """Order totals (invoices) vs summed line items (PO lines), 10 % relative tolerance."""
    return _recon(spark, sf_dir).select("ref", "a", "b", "status")


@query("j6_reconcile_counts", sql=lambda: f"SELECT status, count(*) AS n FROM ({_recon_sql()}) GROUP BY 1")
def j6_reconcile_counts(spark, sf_dir):
    """J6 summary: match / mismatch / needs_review counts."""
    return _recon(spark, sf_dir).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def _boundary_sides(orders):
    """Amounts a cent below, at and above the last cent within 10 %, and rows without a reference."""
    k = F.col("o_orderkey")
    ref = F.when(k % 11 != 0, k)
    cents = (k % 9973) * 100 + 15
    paid = cents + F.floor(cents / 10) + (k % 3 - 1)
    hundredth = F.lit("0.01").cast("decimal(3,2)")
    return (
        orders.select(ref.alias("ref"), (paid.cast("long") * hundredth).alias("amount")),
        orders.where(k % 13 != 0).select(ref.alias("ref"), (cents.cast("long") * hundredth).alias("amount")),
    )


@query(
    "j6_boundary",
    sql="""WITH o AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderkey END AS ref,
          (o_orderkey % 9973) * 100 + 15 AS bc FROM orders),
      l AS (SELECT ref, k, CAST((bc + bc // 10 + k % 3 - 1) * 0.01 AS DECIMAL(24,2)) AS a FROM o),
      r AS (SELECT ref, k, CAST(bc * 0.01 AS DECIMAL(24,2)) AS b FROM o WHERE k % 13 <> 0)
      SELECT l.ref, a, b, CASE WHEN b IS NULL THEN 'needs_review'
          WHEN abs(a - b) * 10 <= abs(b) THEN 'match' ELSE 'mismatch' END AS status
        FROM l LEFT JOIN r ON l.ref = r.ref WHERE l.ref IS NOT NULL
      UNION ALL SELECT NULL, a, NULL, 'needs_review' FROM l WHERE ref IS NULL
      UNION ALL SELECT NULL, NULL, b, 'needs_review' FROM r WHERE ref IS NULL""",
)
def j6_boundary(spark, sf_dir):
    """J6 at the edge of the tolerance (half cents) and with rows that have no reference."""
    left, right = _boundary_sides(Tables(spark, sf_dir).orders)
    r = reconcile(left, right, "ref", "ref", F.col("amount"), F.col("amount"), tolerance=0.1, relative=True)
    return r.select("ref", "a", "b", "status")


J7_COLS = [
    "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax", "l_returnflag", "l_linestatus",
]


def _dup_sql() -> str:
    order = ", ".join(f"{c} ASC NULLS FIRST" for c in ["l_shipdate", *J7_COLS[2:]])
    cols = ", ".join(J7_COLS)
    return f"""SELECT {cols} FROM (
        SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {order}) AS rn
        FROM lineitem) WHERE rn > 1"""


@query("j7_duplicate_lines", sql=_dup_sql)
def j7_duplicate_lines(spark, sf_dir):
    """Repeated (l_orderkey, l_linenumber) rows after the first by ship date."""
    li = Tables(spark, sf_dir).lineitem.select("l_shipdate", *J7_COLS)
    d = find_duplicates(li, ["l_orderkey", "l_linenumber"], ["l_shipdate"])
    return d.select(*J7_COLS)


@query(
    "j8_unreferenced",
    sql="SELECT o_orderkey, o_custkey, o_totalprice FROM orders o WHERE NOT EXISTS "
    "(SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)",
)
def j8_unreferenced(spark, sf_dir):
    """Orders (payments) with no line item (invoice) reference."""
    t = Tables(spark, sf_dir)
    o = t.orders.select("o_orderkey", "o_custkey", "o_totalprice")
    return unreferenced(o, t.lineitem, "o_orderkey", "l_orderkey")
