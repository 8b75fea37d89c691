"""Catalog entries: cleaning, validation, normalization and profiling of
``lineitem``."""

from pyspark.sql import functions as F

from weft.operators import cleaning as cl
from weft.plans.catalog import query

KEYS = ["l_orderkey", "l_linenumber"]
REQUIRED = ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"]


def lineitem_rules():
    """Validation rules for lineitem (true = valid)."""
    c = F.col
    return {
        "quantity_positive": c("l_quantity") > 0,
        "price_positive": c("l_extendedprice") > 0,
        "discount_range": c("l_discount").between(0, 0.1),
        "tax_nonnegative": c("l_tax") >= 0,
        "returnflag_domain": c("l_returnflag").isin("A", "N", "R"),
        "linestatus_domain": c("l_linestatus").isin("O", "F"),
        "shipdate_present": c("l_shipdate").isNotNull(),
    }


RULES_SQL = {
    "quantity_positive": "l_quantity > 0",
    "price_positive": "l_extendedprice > 0",
    "discount_range": "l_discount BETWEEN 0 AND 0.1",
    "tax_nonnegative": "l_tax >= 0",
    "returnflag_domain": "l_returnflag IN ('A', 'N', 'R')",
    "linestatus_domain": "l_linestatus IN ('O', 'F')",
    "shipdate_present": "l_shipdate IS NOT NULL",
}
VALID_SQL = " AND ".join(f"coalesce({v}, false)" for v in RULES_SQL.values())
CLEAN_SQL = """cleaned AS (
  SELECT DISTINCT ON (l_orderkey, l_linenumber)
         l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount,
         l_tax, trim(l_returnflag) AS l_returnflag, trim(l_linestatus) AS l_linestatus, l_shipdate
  FROM lineitem
  WHERE l_orderkey IS NOT NULL AND l_linenumber IS NOT NULL AND l_quantity IS NOT NULL
    AND l_extendedprice IS NOT NULL
  ORDER BY l_orderkey, l_linenumber, l_partkey NULLS FIRST, l_suppkey NULLS FIRST,
           l_quantity NULLS FIRST, l_extendedprice NULLS FIRST, l_discount NULLS FIRST,
           l_tax NULLS FIRST, trim(l_returnflag) NULLS FIRST, trim(l_linestatus) NULLS FIRST,
           l_shipdate NULLS FIRST)"""


def _clean(m):
    return cl.clean(m.raw("lineitem"), KEYS, REQUIRED)


@query("clean_rows", f"WITH {CLEAN_SQL} SELECT * FROM cleaned")
def q_clean(m):
    """D1 on lineitem."""
    return _clean(m)


@query("validation_failures", "SELECT l_orderkey, l_linenumber, rule FROM (\n"
       + "\nUNION ALL\n".join(
           f"SELECT l_orderkey, l_linenumber, '{k}' AS rule FROM lineitem WHERE NOT coalesce({v}, false)"
           for k, v in RULES_SQL.items()) + ")")
def q_validation(m):
    """D3 on lineitem."""
    return cl.validate(m.raw("lineitem"), lineitem_rules(), KEYS)


@query("normalize_column", """
SELECT l_orderkey, l_linenumber, l_extendedprice,
  CAST(CASE WHEN max(l_extendedprice) OVER () = min(l_extendedprice) OVER () THEN NULL ELSE
       (l_extendedprice - min(l_extendedprice) OVER ())
       / (max(l_extendedprice) OVER () - min(l_extendedprice) OVER ()) END AS DECIMAL(18,6)) AS l_extendedprice_minmax,
  CAST(CASE WHEN stddev_samp(l_extendedprice) OVER () = 0 THEN NULL ELSE
       (l_extendedprice - avg(l_extendedprice) OVER ()) / stddev_samp(l_extendedprice) OVER () END
       AS DECIMAL(18,6)) AS l_extendedprice_z
FROM lineitem""")
def q_normalize(m):
    """W9 / D2 on lineitem prices."""
    li = m.raw("lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return cl.normalize(li, "l_extendedprice")


def steps():
    """The declared steps: clean, then keep the rows that pass every rule but the domains."""
    rules = {k: v for k, v in lineitem_rules().items() if k.endswith(("positive", "range"))}
    return [("clean", lambda d: cl.clean(d, KEYS, REQUIRED)),
            ("validate", lambda d: d.where(cl.valid_flag(rules)))]


IN_RANGE_SQL = " AND ".join(f"coalesce({v}, false)" for k, v in RULES_SQL.items() if k.endswith(("positive", "range")))


@query("run_summary", f"""WITH {CLEAN_SQL}
SELECT (SELECT count(*) FROM lineitem) AS records_processed, count(*) AS records_kept,
       count(*) FILTER (WHERE {VALID_SQL}) AS valid_records,
       CAST(CAST(count(*) FILTER (WHERE {VALID_SQL}) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS DECIMAL(18,6))
         AS valid_share,
       'clean, validate' AS steps_applied
FROM cleaned WHERE {IN_RANGE_SQL}""")
def q_run_summary(m):
    """D4 + D5 / A17: the declared steps (clean, validate) and their summary."""
    return cl.run_summary(m.raw("lineitem"), steps(), cl.valid_flag(lineitem_rules()))


PROFILE_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
                "l_shipdate"]
NUMERIC_COLS = PROFILE_COLS[:8]


@query("profile_schema", "\nUNION ALL\n".join(
    f"""SELECT '{c}' AS column_name, count(*) AS n_rows, count(*) - count({c}) AS n_nulls,
       count(DISTINCT {c}) AS n_distinct,
       {f'CAST(min({c}) AS DOUBLE)' if c in NUMERIC_COLS else 'CAST(NULL AS DOUBLE)'} AS min_value,
       {f'CAST(max({c}) AS DOUBLE)' if c in NUMERIC_COLS else 'CAST(NULL AS DOUBLE)'} AS max_value,
       {f'CAST(min({c}) AS VARCHAR)' if c not in NUMERIC_COLS else 'CAST(NULL AS VARCHAR)'} AS min_text,
       {f'CAST(max({c}) AS VARCHAR)' if c not in NUMERIC_COLS else 'CAST(NULL AS VARCHAR)'} AS max_text
FROM lineitem""" for c in PROFILE_COLS))
def q_profile(m):
    """A16 on lineitem (exact distinct counts)."""
    return cl.profile(m.raw("lineitem"), PROFILE_COLS)
