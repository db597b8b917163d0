"""Programs over the sample tables, with the SQL that DuckDB checks them by: one key for each operator of the language."""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .engine import Engine
from .lang import ast as A
from .lang.parser import parse_expression

SOURCES = """
datasource region (r_regionkey, r_name) from PARQUET file "region.parquet";
datasource nation (n_nationkey, n_name, n_regionkey) from PARQUET file "nation.parquet";
datasource customer (c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment) from PARQUET file "customer.parquet";
datasource supplier (s_suppkey, s_name, s_nationkey, s_acctbal) from PARQUET file "supplier.parquet";
datasource part (p_partkey, p_name, p_brand, p_type, p_size, p_retailprice) from PARQUET file "part.parquet";
datasource orders (o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority) from PARQUET file "orders.parquet";
datasource lineitem (l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) from PARQUET file "lineitem.parquet";
datasource events (event_id, ts, user_id, event_type, value, props) from PARQUET file "events.parquet";
datasource embeddings (vec_id, embedding, label) from PARQUET file "embeddings.parquet";
"""

QUERIES: dict[str, tuple[str, str, str]] = {}


def add(key: str, model: str, query: str, oracle: str) -> None:
    QUERIES[key] = (model, query, oracle)


# projection and filters

add("select_arith", "", "(l_orderkey, l_linenumber, net = l_extendedprice * (1 - l_discount), chain = round(l_quantity - l_tax + l_discount - 1, 6)) from lineitem",
    "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net, round(l_quantity - (l_tax + (l_discount - 1)), 6) AS chain FROM lineitem")
add("where_alias_inline", "concept priced (l_orderkey, l_linenumber, net = l_extendedprice * (1 - l_discount)) from lineitem where net > 50000;", "from priced",
    "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net FROM lineitem WHERE l_extendedprice * (1 - l_discount) > 50000")
add("where_null_checks", "concept perCustomer (c_custkey = c.c_custkey, s_name = s.s_name) from customer c, @Optional supplier s (s_suppkey = c.c_custkey);", "(c_custkey) from perCustomer where s_name = Null",
    "SELECT c_custkey FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey WHERE s_name IS NULL")
add("where_not_null", "concept perCustomer (c_custkey = c.c_custkey, o_orderkey = o.o_orderkey) from customer c, @Optional orders o (o_custkey = c.c_custkey);", "(c_custkey, o_orderkey) from perCustomer where o_orderkey != Null and not (o_orderkey < 10)",
    "SELECT c_custkey, o_orderkey FROM customer JOIN orders ON o_custkey = c_custkey WHERE NOT o_orderkey < 10")
add("between_inlist", "", '(p_partkey, p_size) from part where p_size between [10, 20] and p_brand in ["Brand#11", "Brand#12", "Brand#23"]',
    "SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 10 AND 20 AND p_brand IN ('Brand#11', 'Brand#12', 'Brand#23')")
add("bool_precedence", "", '(o_orderkey) from orders where o_orderstatus = "F" and o_totalprice > 200000 or o_orderpriority = "1-URGENT"',
    "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND (o_totalprice > 200000 OR o_orderpriority = '1-URGENT')")
add("bool_precedence_or", "", '(o_orderkey) from orders where o_orderstatus = "F" or o_totalprice > 200000 and o_orderpriority = "1-URGENT"',
    "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' OR (o_totalprice > 200000 AND o_orderpriority = '1-URGENT')")
add("unary_minus_not", "", "(c_custkey, m = round(-c_acctbal + 10, 2)) from customer where not c_acctbal > 0 and c_nationkey > 5",
    "SELECT c_custkey, round(-(c_acctbal + 10), 2) AS m FROM customer WHERE NOT (c_acctbal > 0 AND c_nationkey > 5)")
add("unique_concept", "@Unique concept segments (c_mktsegment, c_nationkey) from customer;", "from segments", "SELECT DISTINCT c_mktsegment, c_nationkey FROM customer")
add("unique_query", "", "@Unique (o_orderpriority, o_orderstatus) from orders", "SELECT DISTINCT o_orderpriority, o_orderstatus FROM orders")
add("private_attr", "concept priced (l_orderkey, l_linenumber, @Private net = l_extendedprice * (1 - l_discount), gross = net * (1 + l_tax)) from lineitem;", "from priced",
    "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS gross FROM lineitem")
add("parent_filter", "", '(o_orderkey, o_totalprice) from orders (o_orderstatus = "F", o_orderpriority = "5-LOW")', "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '5-LOW'")
add("inferred_from_where", "concept c2 (key, doubled) from customer c where key = c.c_custkey and doubled = c.c_acctbal * 2 and c.c_nationkey > 5;", "(key, doubled = round(doubled, 2)) from c2",
    "SELECT c_custkey AS key, round(c_acctbal * 2, 2) AS doubled FROM customer WHERE c_nationkey > 5")

# joins

add("join_inner", "concept co (o_orderkey, c_name, o_totalprice) from orders o, customer c (c_custkey = o.o_custkey);", "from co", "SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON c_custkey = o_custkey")
add("join_where_key", "concept co (o_orderkey, c_name) from orders o, customer c where o.o_custkey = c.c_custkey and o.o_totalprice > 100000;", "from co", "SELECT o_orderkey, c_name FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_totalprice > 100000")
add("join_left_optional", "concept co (c_custkey = c.c_custkey, s_name) from customer c, @Optional supplier s (s_suppkey = c.c_custkey);", "from co", "SELECT c_custkey, s_name FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey")
add("join_right", "concept co (c_custkey = c.c_custkey, s_name) from @Optional supplier s, customer c (c_custkey = s.s_suppkey);", "from co", "SELECT c_custkey, s_name FROM supplier RIGHT JOIN customer ON c_custkey = s_suppkey")
add("join_full", "concept sc (s_suppkey, c_custkey) from @Optional supplier s, @Optional customer c (c_custkey = s.s_suppkey);", "from sc", "SELECT s_suppkey, c_custkey FROM supplier FULL JOIN customer ON c_custkey = s_suppkey")
add("join_optional_fold3", "concept fold (c_custkey = c.c_custkey, o_orderkey = o.o_orderkey, l_linenumber) from @Optional customer c, @Optional orders o (o_custkey = c.c_custkey), lineitem l (l_orderkey = o.o_orderkey);", "from fold",
    "SELECT c_custkey, o_orderkey, l_linenumber FROM customer FULL JOIN orders ON o_custkey = c_custkey RIGHT JOIN lineitem ON l_orderkey = o_orderkey")
add("join_cross", "concept pairs (a = x.r_name, b = y.r_name) from region x, region y;", "from pairs", "SELECT x.r_name AS a, y.r_name AS b FROM region x, region y")
add("join_self", "concept same (a = x.n_name, b = y.n_name) from nation x, nation y (n_regionkey = x.n_regionkey) where x.n_nationkey < y.n_nationkey;", "from same",
    "SELECT x.n_name AS a, y.n_name AS b FROM nation x JOIN nation y ON y.n_regionkey = x.n_regionkey WHERE x.n_nationkey < y.n_nationkey")
add("join_derived_agg", "concept top (c_name, cnt = t.cnt) from customer c, <(k = o_custkey, cnt = count()) from orders group by k> t (k = c.c_custkey) where t.cnt > 12;", "from top",
    "SELECT c_name, cnt FROM customer JOIN (SELECT o_custkey AS k, count(*) AS cnt FROM orders GROUP BY 1) t ON k = c_custkey WHERE cnt > 12")
add("join_literal_key", 'concept urgent (c_custkey = c.c_custkey, o_orderkey) from customer c, @Optional orders o (o_custkey = c.c_custkey, o_orderpriority = "1-URGENT");', "from urgent",
    "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderpriority = '1-URGENT'")
add("join_theta_postfilter", "concept big (c_custkey = c.c_custkey, o_orderkey) from customer c, @Optional orders o (o_custkey = c.c_custkey) where o.o_totalprice > c.c_acctbal * 20;", "from big",
    "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > c_acctbal * 20")
add("join_three_keys", "concept trip (n = count()) from lineitem a, lineitem b (l_orderkey = a.l_orderkey, l_linenumber = a.l_linenumber, l_partkey = a.l_partkey);", "from trip",
    "SELECT count(*) AS n FROM lineitem a JOIN lineitem b ON b.l_orderkey = a.l_orderkey AND b.l_linenumber = a.l_linenumber AND b.l_partkey = a.l_partkey")

# aggregates

add("group_by_sum_count", "", "(o_orderpriority, n = count(), total = round(sum(o_totalprice), 2), low = min(o_totalprice), high = max(o_totalprice), mean = round(avg(o_totalprice), 3), filled = count(o_custkey)) from orders group by o_orderpriority",
    "SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total, min(o_totalprice) AS low, max(o_totalprice) AS high, round(avg(o_totalprice), 3) AS mean, count(o_custkey) AS filled FROM orders GROUP BY 1")
add("group_by_expr", "", "(band = p_size / 10, n = count()) from part group by band", "SELECT p_size / 10 AS band, count(*) AS n FROM part GROUP BY 1")
add("agg_distinct", "", '(l_returnflag, parts = count("DISTINCT", l_partkey), qty = sum("DISTINCT", l_quantity)) from lineitem group by l_returnflag',
    "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, sum(DISTINCT l_quantity) AS qty FROM lineitem GROUP BY 1")
add("agg_global", "", "(n = count(), low = min(o_totalprice)) from orders", "SELECT count(*) AS n, min(o_totalprice) AS low FROM orders")
add("agg_global_empty", "", "(n = count(), low = min(o_totalprice)) from orders where o_totalprice < 0 - 1", "SELECT count(*) AS n, min(o_totalprice) AS low FROM orders WHERE o_totalprice < -1")
add("having_alias", "", "(o_custkey, n = count()) from orders group by o_custkey having n > 15", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 15")
add("having_count", "", "(o_custkey) from orders group by o_custkey having count() > 15 and max(o_totalprice) > 100000", "SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 15 AND max(o_totalprice) > 100000")
add("agg_ratio", "", "(l_returnflag, l_linestatus, qty = sum(l_quantity), revenue = round(sum(l_extendedprice * (1 - l_discount)), 4), price = round(sum(l_extendedprice) / sum(l_quantity), 3), n = count()) from lineitem group by l_returnflag, l_linestatus",
    "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS qty, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue, round(sum(l_extendedprice) / sum(l_quantity), 3) AS price, count(*) AS n FROM lineitem GROUP BY 1, 2")

# cubes, inheritance, relationships

CUBE = 'concept cube orderMetrics metrics (cnt = count(), total = sum(o_totalprice), best = max(o_totalprice)) dimensions (o_orderstatus, o_orderpriority) from orders where o_totalprice > 1000;'
add("cube_metrics", CUBE, "(cnt, total = round(total, 2), o_orderstatus, o_orderpriority) from orderMetrics",
    "SELECT count(*) AS cnt, round(sum(o_totalprice), 2) AS total, o_orderstatus, o_orderpriority FROM orders WHERE o_totalprice > 1000 GROUP BY 3, 4")
add("cube_inherited_with_without", CUBE + "concept cube byCustomer is orderMetrics m with metrics small = min(o_totalprice) without metrics best with dimensions o_custkey without dimensions o_orderstatus where o_custkey > 100 having cnt > 3;",
    "(cnt, total = round(total, 2), small, o_orderpriority, o_custkey) from byCustomer",
    "SELECT count(*) AS cnt, round(sum(o_totalprice), 2) AS total, min(o_totalprice) AS small, o_orderpriority, o_custkey FROM orders WHERE o_totalprice > 1000 AND o_custkey > 100 GROUP BY 4, 5 HAVING count(*) > 3")
add("cube_inherited_removed_metric_inline", CUBE + "concept cube means is orderMetrics m with metrics mean = m.total / m.cnt without metrics total, cnt;", "(best, mean = round(mean, 3), o_orderstatus, o_orderpriority) from means",
    "SELECT max(o_totalprice) AS best, round(sum(o_totalprice) / count(*), 3) AS mean, o_orderstatus, o_orderpriority FROM orders WHERE o_totalprice > 1000 GROUP BY 3, 4")
add("query_over_cube", CUBE, '(o_orderpriority, total = round(sum(total), 2)) from orderMetrics (o_orderstatus = "F") group by o_orderpriority',
    "SELECT o_orderpriority, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_totalprice > 1000 AND o_orderstatus = 'F' GROUP BY 1")
add("cube_global", "concept cube totals metrics (cnt = count(), size = max(p_size)) from part;", "from totals", "SELECT count(*) AS cnt, max(p_size) AS size FROM part")
add("inherit_override", "concept rich is customer with c_name = upper(c_name), level = floor(c_acctbal / 1000) without c_mktsegment where c_acctbal > 5000;", "from rich",
    "SELECT c_custkey, c_nationkey, c_acctbal, upper(c_name) AS c_name, CAST(floor(c_acctbal / 1000) AS BIGINT) AS level FROM customer WHERE c_acctbal > 5000")
add("inherit_multi_parent", "concept placed is nation n, region r (r_regionkey = n.n_regionkey) without r.r_regionkey;", "from placed", "SELECT n_nationkey, n_name, n_regionkey, r_name FROM nation JOIN region ON r_regionkey = n_regionkey")
add("inherit_chain", "concept a is customer where c_acctbal > 0; concept b is a with twice = c_acctbal * 2 where c_nationkey < 10; concept d is b without c_name order by c_custkey asc limit 50;", "(c_custkey, twice = round(twice, 2)) from d",
    "SELECT c_custkey, round(c_acctbal * 2, 2) AS twice FROM customer WHERE c_acctbal > 0 AND c_nationkey < 10 ORDER BY c_custkey LIMIT 50")
BETWEEN = "concept lives between customer c, nation n where c.c_nationkey = n.n_nationkey;"
add("between_struct", BETWEEN, "(key = v.c.c_custkey, nation = v.n.n_name) from lives v", "SELECT c_custkey AS key, n_name AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey")
add("dotted_chain", BETWEEN + "concept where_ between lives v, region r where v.n.n_regionkey = r.r_regionkey;", "(key = w.v.c.c_custkey, name = w.r.r_name) from where_ w",
    "SELECT c_custkey AS key, r_name AS name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON r_regionkey = n_regionkey")

# generics and macros

add("generic_source", 'concept daily[source] (day = floor(s.ts, "day"), n = count()) from $source s group by day;', 'from daily[source: "events"]',
    "SELECT date_trunc('day', ts) AS day, count(*) AS n FROM events GROUP BY 1")
add("generic_nested", 'concept only[source, kind] is $source s where s.event_type = kind; concept perUser[source, kind] (user_id, n = count(), total = round(sum(value), 2)) from only[source: source, kind: kind] group by user_id;', 'from perUser[source: "events", kind: "click"]',
    "SELECT user_id, count(*) AS n, round(sum(value), 2) AS total FROM events WHERE event_type = 'click' GROUP BY 1")
add("generic_name_expression", 'concept counted[what] (n = count()) from $(concat(what, "s"));', 'from counted[what: "order"]', "SELECT count(*) AS n FROM orders")
add("concept_attributes_macro", 'concept attributes money[src] (total = round(sum(x.o_totalprice), 2), mean = round(sum(x.o_totalprice) / count(), 2)) from $src x; concept byStatus (money[src: "orders", x: "o"], o_orderstatus) from orders o group by o_orderstatus;', "from byStatus",
    "SELECT round(sum(o_totalprice), 2) AS total, round(sum(o_totalprice) / count(*), 2) AS mean, o_orderstatus FROM orders GROUP BY 3")

# sets

SETS = 'concept f (k = o_custkey, p = o_orderpriority) from orders where o_orderstatus = "F"; concept o (p = o_orderpriority, k = o_custkey) from orders where o_orderstatus = "O"; concept x (k = o_custkey, p = o_orderpriority) from orders where o_totalprice > 200000;'
F_, O_, X_ = ("SELECT o_custkey AS k, o_orderpriority AS p FROM orders WHERE " + c for c in ("o_orderstatus = 'F'", "o_orderstatus = 'O'", "o_totalprice > 200000"))
add("union_by_name_reordered", SETS + "concept u union of f, o;", "from u", f"{F_} UNION {O_}")
add("union_three", SETS + "concept u union of f, o, x;", "from u", f"{F_} UNION {O_} UNION {X_}")
add("intersect_", SETS + "concept u intersect of f, o;", "from u", f"{F_} INTERSECT {O_}")
add("minus_", SETS + "concept u minus f, o, x;", "from u", f"({F_} EXCEPT {O_}) EXCEPT {X_}")
add("union_with_null_columns", "concept a (k = c_custkey, v = c_acctbal, w = Null) from customer; concept b (w = s_name, k = s_suppkey, v = Null) from supplier; concept u union of a, b;", "from u",
    "SELECT c_custkey AS k, c_acctbal AS v, NULL::VARCHAR AS w FROM customer UNION SELECT s_suppkey, NULL, s_name FROM supplier")

# subqueries

add("in_subquery", "", "(c_custkey) from customer where c_custkey in <(o_custkey) from orders where o_totalprice > 300000>", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
add("not_in_subquery", "", "(c_custkey) from customer where not c_custkey in <(o_custkey) from orders where o_totalprice > 300000>", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
add("not_in_with_nulls", "", "(n_nationkey, out = not n_nationkey in <(k = case when r_regionkey = 2 then Null else r_regionkey) from region>) from nation",
    "SELECT n_nationkey, n_nationkey NOT IN (SELECT CASE WHEN r_regionkey = 2 THEN NULL ELSE r_regionkey END FROM region) AS out FROM nation")
add("exists_correlated", "", "(c_custkey) from customer c where exists <(o_orderkey) from orders o where o.o_custkey = c.c_custkey and o.o_totalprice > 250000>",
    "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)")
add("not_exists", "", "(c_custkey) from customer c where not exists <(o_orderkey) from orders o where o.o_custkey = c.c_custkey and o.o_totalprice > 250000>",
    "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)")
add("exists_in_or", "", "(c_custkey) from customer c where c_acctbal < 0 or exists <(o_orderkey) from orders o where o.o_custkey = c.c_custkey and o.o_totalprice > 250000>",
    "SELECT c_custkey FROM customer WHERE c_acctbal < 0 OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)")
add("exists_in_projection", "", "(c_custkey, has = if (exists <(o_orderkey) from orders o (o_custkey = c.c_custkey)>) then 1 else 0) from customer c",
    "SELECT c_custkey, CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) THEN 1 ELSE 0 END AS has FROM customer")
add("gt_all", "", "(p_partkey) from part p where p_retailprice >= all <(v = q.p_retailprice) from part q where q.p_brand = p.p_brand>", "SELECT p_partkey FROM part p WHERE p_retailprice >= ALL (SELECT q.p_retailprice FROM part q WHERE q.p_brand = p.p_brand)")
add("gt_all_empty", "", '(r_name) from region where r_regionkey > all <(n_nationkey) from nation where n_name = "nowhere">', "SELECT r_name FROM region WHERE r_regionkey > ALL (SELECT n_nationkey FROM nation WHERE n_name = 'nowhere')")
add("eq_any", "", "(n_name) from nation where n_nationkey = any <(c_nationkey) from customer where c_acctbal > 9900>", "SELECT n_name FROM nation WHERE n_nationkey = ANY (SELECT c_nationkey FROM customer WHERE c_acctbal > 9900)")
add("lt_any_grouped", "", "(p_partkey) from part where p_retailprice < any <(m = avg(p_retailprice)) from part group by p_brand>",
    "SELECT p_partkey FROM part WHERE p_retailprice < ANY (SELECT avg(p_retailprice) FROM part GROUP BY p_brand)")
add("quantified_value", "", "(n_nationkey, above = n_nationkey > all <(r_regionkey) from region>) from nation", "SELECT n_nationkey, n_nationkey > ALL (SELECT r_regionkey FROM region) AS above FROM nation")
for _quantifier, _op, _sql in [("all", "<", "<"), ("all", "<=", "<="), ("all", ">=", ">="), ("all", "=", "="), ("all", "!=", "<>"), ("any", "<", "<"), ("any", "<=", "<="), ("any", ">", ">"), ("any", ">=", ">="), ("any", "!=", "<>"), ("any", "=", "=")]:
    # values and nulls on both sides, as a filter and as a value
    _key, _inner = f"quantified_{_quantifier}_{['lt', 'le', 'gt', 'ge', 'eq', 'ne'][['<', '<=', '>', '>=', '=', '!='].index(_op)]}", "case when r_regionkey = 4 then Null else r_regionkey + 3"
    _outer, _theirs = "(case when n_nationkey = 7 then Null else n_nationkey)", "CASE WHEN n_nationkey = 7 THEN NULL ELSE n_nationkey END"
    _sub = f"{_sql} {_quantifier.upper()} (SELECT r_regionkey + 3 FROM region)"
    _nulls = f"{_sql} {_quantifier.upper()} (SELECT CASE WHEN r_regionkey = 4 THEN NULL ELSE r_regionkey + 3 END FROM region)"
    add(_key, "", f"(n_nationkey, v = {_outer} {_op} {_quantifier} <(k = {_inner}) from region>, w = {_outer} {_op} {_quantifier} <(k = r_regionkey + 3) from region>) from nation",
        f"SELECT n_nationkey, ({_theirs}) {_nulls} AS v, ({_theirs}) {_sub} AS w FROM nation")
    _some = "r_regionkey = 1" if (_quantifier, _op) == ("all", "=") else "r_regionkey > 2"
    add(f"{_key}_filter", "", f"(n_nationkey) from nation where {_outer} {_op} {_quantifier} <(k = r_regionkey + 3) from region where {_some}>",
        f"SELECT n_nationkey FROM nation WHERE ({_theirs}) {_sql} {_quantifier.upper()} (SELECT r_regionkey + 3 FROM region WHERE {_some})")
add("unique_pred", "", "(c_custkey) from customer c where unique <(o_orderpriority) from orders o (o_custkey = c.c_custkey)>",
    "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c.c_custkey AND o_orderpriority IS NOT NULL GROUP BY o_orderpriority HAVING count(*) > 1)")

# windows

EV = "partition by (user_id) order by (ts asc, event_id asc)"
EVS = "PARTITION BY user_id ORDER BY ts NULLS FIRST, event_id"
for _name, _call, _sql in [
    ("sum", "round(sum(value) over ({w}), 4)", "round(sum(value) OVER ({w}), 4)"), ("avg", "avg(event_id) over ({w})", "avg(event_id) OVER ({w})"), ("min", "min(value) over ({w})", "min(value) OVER ({w})"), ("max", "max(value) over ({w})", "max(value) OVER ({w})"),
    ("count", "count() over ({w})", "count(*) OVER ({w})"), ("row_number", "row_number() over ({w})", "CAST(row_number() OVER ({w}) AS INTEGER)"), ("rank", "rank() over ({w})", "CAST(rank() OVER ({w}) AS INTEGER)"), ("dense_rank", "dense_rank() over ({w})", "CAST(dense_rank() OVER ({w}) AS INTEGER)"),
    ("percent_rank", "round(percent_rank() over ({w}), 6)", "round(percent_rank() OVER ({w}), 6)"), ("cume_dist", "round(cume_dist() over ({w}), 6)", "round(cume_dist() OVER ({w}), 6)"), ("lead", "lead(value, 2, 0) over ({w})", "lead(value, 2, 0) OVER ({w})"), ("lag", "lag(event_type) over ({w})", "lag(event_type) OVER ({w})"),
    ("ntile", "ntile(4) over ({w})", "CAST(ntile(4) OVER ({w}) AS INTEGER)"), ("first_value", "first_value(event_type) over ({w})", "first_value(event_type) OVER ({w})"), ("last_value", "last_value(event_type) over ({w})", "last_value(event_type) OVER ({w})"), ("nth_value", "nth_value(event_type, 2) over ({w})", "nth_value(event_type, 2) OVER ({w})"),
]:
    add(f"window_{_name}", "", f"(event_id, w = {_call.format(w=EV)}) from events", f"SELECT event_id, {_sql.format(w=EVS)} AS w FROM events")
for _name, _bounds, _sql in [("frame_rows_both", "rows between (2, 1)", "ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING"), ("frame_rows_lower_only", "rows between (3, unbounded)", "ROWS BETWEEN 3 PRECEDING AND CURRENT ROW"), ("frame_rows_upper_only", "rows between (unbounded, 1)", "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 FOLLOWING"), ("frame_rows_current", "rows between (unbounded, 0)", "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW")]:
    add(_name, "", f"(event_id, w = count(value) over ({EV} {_bounds}), m = max(value) over ({EV} {_bounds})) from events", f"SELECT event_id, count(value) OVER ({EVS} {_sql}) AS w, max(value) OVER ({EVS} {_sql}) AS m FROM events")
add("frame_range_num", "", "(l_orderkey, l_linenumber, w = sum(l_quantity) over (partition by (l_orderkey) order by (l_linenumber asc) range between (1, 1))) from lineitem",
    "SELECT l_orderkey, l_linenumber, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS w FROM lineitem")
add("window_inside_agg", "concept cube stays metrics (@Private next = coalesce(lead(e.ts) over (partition by (e.user_id) order by (e.ts asc, e.event_id asc)), e.ts), gap = max(next - e.ts), n = count()) dimensions (user_id) from events e;", "(user_id, n, gap = round(gap, 3)) from stays",
    "SELECT user_id, count(*) AS n, round(max(date_diff('microsecond', ts, nxt) / 1000000.0), 3) AS gap FROM (SELECT *, coalesce(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), ts) AS nxt FROM events) GROUP BY 1")
add("agg_inside_window", "", "(o_orderpriority, r = rank() over (order by (n desc)), n = count()) from orders group by o_orderpriority", "SELECT o_orderpriority, CAST(rank() OVER (ORDER BY count(*) DESC) AS INTEGER) AS r, count(*) AS n FROM orders GROUP BY 1")

# scalar functions

add("string_fns", "", '(c_custkey, u = upper(c_name), l = lower(c_mktsegment), n = length(c_name), hit = like(c_name, "%1%")) from customer', "SELECT c_custkey, upper(c_name) AS u, lower(c_mktsegment) AS l, CAST(length(c_name) AS INTEGER) AS n, c_name LIKE '%1%' AS hit FROM customer")
add("substring_replace", "", '(c_custkey, a = substring(c_name, 2, 5), b = substring(c_name, 4), r = replace(c_name, "0", "zero")) from customer', "SELECT c_custkey, substring(c_name, 2, 5) AS a, substring(c_name, 4) AS b, replace(c_name, '0', 'zero') AS r FROM customer")
add("concat_nulls", "concept co (c_custkey = c.c_custkey, p = o.o_orderpriority) from customer c, @Optional orders o (o_custkey = c.c_custkey);", '(c_custkey, t = concat("x", p, "y")) from co',
    "SELECT c_custkey, 'x' || o_orderpriority || 'y' AS t FROM customer LEFT JOIN orders ON o_custkey = c_custkey")
add("math_fns", "", "(s_suppkey, m = mod(s_suppkey, 7), a = abs(s_acctbal), q = round(sqrt(abs(s_acctbal)), 6)) from supplier", "SELECT s_suppkey, s_suppkey % 7 AS m, abs(s_acctbal) AS a, round(sqrt(abs(s_acctbal)), 6) AS q FROM supplier")
add("round_floor_ceil_n", "", "(s_suppkey, r = round(s_acctbal, 1), f = cast(floor(s_acctbal), float), c = cast(ceil(s_acctbal), float)) from supplier", "SELECT s_suppkey, round(s_acctbal, 1) AS r, floor(s_acctbal) AS f, ceil(s_acctbal) AS c FROM supplier")
add("trunc_neg", "", "(s_suppkey, t = cast(trunc(0 - s_acctbal), float)) from supplier", "SELECT s_suppkey, trunc(0 - s_acctbal) AS t FROM supplier")
add("floor_ts_day", "", '(event_id, d = floor(ts, "day"), h = floor(ts, "hour")) from events', "SELECT event_id, date_trunc('day', ts) AS d, date_trunc('hour', ts) AS h FROM events")
add("ceil_ts_day", "", '(event_id, d = ceil(ts, "day")) from events', "SELECT event_id, CASE WHEN date_trunc('day', ts) = ts THEN date_trunc('day', ts) ELSE date_trunc('day', ts) + INTERVAL 1 DAY END AS d FROM events")
add("coalesce_cast", "concept co (c_custkey = c.c_custkey, k = o.o_orderkey) from customer c, @Optional orders o (o_custkey = c.c_custkey);", "(c_custkey, k = coalesce(k, 0), t = cast(c_custkey, string(2)), i = cast(c_custkey, int), b = cast(1, boolean)) from co",
    "SELECT c_custkey, coalesce(o_orderkey, 0) AS k, substring(CAST(c_custkey AS VARCHAR), 1, 2) AS t, CAST(c_custkey AS INTEGER) AS i, TRUE AS b FROM customer LEFT JOIN orders ON o_custkey = c_custkey")
add("case_if", "", '(p_partkey, s = case when p_size < 10 then "small" when p_size < 30 then "middle" else "large", e = if p_size = 1 then 1 else 0) from part',
    "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'middle' ELSE 'large' END AS s, CASE WHEN p_size = 1 THEN 1 ELSE 0 END AS e FROM part")
add("list_map_item", 'concept things (p_partkey, sizes = [p_size, 7, 9], names = ["brand": p_brand, "type": p_type]) from part;', '(p_partkey, a = sizes[0], z = sizes[5], b = names["brand"]) from things', "SELECT p_partkey, p_size AS a, NULL::INTEGER AS z, p_brand AS b FROM part")
add("list_column_item", "", "(vec_id, first = cast(embedding[0], float), none = embedding[99999]) from embeddings", "SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS first, NULL::FLOAT AS none FROM embeddings")
add("number_literals", "", "(r_regionkey, a = 3000000000, b = 1.5, c = 7 / 2, d = true) from region", "SELECT r_regionkey, 3000000000::DOUBLE AS a, 1.5::DOUBLE AS b, 7 / 2 AS c, TRUE AS d FROM region")

# order and limits

add("order_mixed", "concept o is orders order by o_orderpriority desc, o_orderkey asc limit 100;", "(o_orderkey, o_orderpriority) from o", "SELECT o_orderkey, o_orderpriority FROM orders ORDER BY o_orderpriority DESC, o_orderkey LIMIT 100")
add("topk_offset", "", "(o_orderkey, o_totalprice) from orders order by o_totalprice desc, o_orderkey asc limit 20 offset 10", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 10")
add("offset_only", "", "(n_nationkey) from nation order by n_nationkey asc offset 10", "SELECT n_nationkey FROM nation ORDER BY n_nationkey OFFSET 10")

# functions

add("def_function_macro", "def taxed(price, rate) { return price * (1 + rate) }; concept t (l_orderkey, l_linenumber, g = taxed(l_extendedprice, l_tax)) from lineitem;", "from t", "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 + l_tax) AS g FROM lineitem")
add("lambda_call", "", "(p_partkey, v = ((a, b) => { return a * 10 + b })(p_size, 1)) from part", "SELECT p_partkey, p_size * 10 + 1 AS v FROM part")
add("def_function_loop", "def digits(n) { var total = 0; var rest = n; while rest > 0 do { total = total + mod(rest, 10); rest = floor(rest / 10) }; return total }; concept d (p_partkey, s = digits(p_partkey)) from part;", "from d",
    "SELECT p_partkey, CAST(list_sum(list_transform(string_split(CAST(p_partkey AS VARCHAR), ''), lambda x: CAST(x AS INTEGER))) AS DOUBLE) AS s FROM part")
add("def_function_if", "def band(price, size) { var base = price * 2; if size > 20 then { base = base + size } else { if size > 10 then { return 0 - 1.5 } }; return base - price }; concept b (p_partkey, v = round(band(p_retailprice, p_size), 4)) from part;", "from b",
    "SELECT p_partkey, round(CASE WHEN p_size > 20 THEN p_retailprice * 2 + p_size - p_retailprice WHEN p_size > 10 THEN -1.5 ELSE p_retailprice * 2 - p_retailprice END, 4) AS v FROM part")
add("def_function_for", "def triangle(n) { var s = 0; for (var i = 1; i <= n; i++) { if i = 3 then { continue }; if i > 40 then { break }; s = s + i }; return s }; concept f (p_partkey, s = triangle(p_size)) from part;", "from f",
    "SELECT p_partkey, CAST(least(p_size, 40) * (least(p_size, 40) + 1) // 2 - CASE WHEN p_size >= 3 THEN 3 ELSE 0 END AS DOUBLE) AS s FROM part")
add("def_function_foreach", 'def weigh(n) { var l; var m; for (x in [1, 2, 3]) { l[] = x * n }; m["a"] = l[0]; m["b"] = l[2]; var s = 0; for (k, v in m) { s = s + v }; do { s-- } while s > 50; return s }; concept w (p_partkey, s = weigh(p_size)) from part;', "from w",
    "SELECT p_partkey, CAST(CASE WHEN p_size * 4 - 1 <= 50 THEN p_size * 4 - 1 ELSE 50 END AS DOUBLE) AS s FROM part")
add("def_function_nulls", "def other(x) { var y = x; while false do { y++ }; return y != 2 }; def plain(x) { return x != 2 }; concept o (n_nationkey, k = case when n_nationkey = 5 then Null else n_nationkey) from nation; concept p (n_nationkey, a = other(k), b = plain(k)) from o;", "from p",
    "SELECT n_nationkey, CASE WHEN n_nationkey = 5 THEN NULL ELSE n_nationkey <> 2 END AS a, CASE WHEN n_nationkey = 5 THEN NULL ELSE n_nationkey <> 2 END AS b FROM nation")
add("current_functions", "", "(r_regionkey, a = current_date() != Null, b = current_timestamp() != Null, c = current_time() != Null) from region", "SELECT r_regionkey, TRUE AS a, TRUE AS b, TRUE AS c FROM region")
add("cast_list_record", "concept things (p_partkey, l = cast([p_size, 2.7], list<int>)) from part;", "(p_partkey, a = l[0], b = l[1]) from things", "SELECT p_partkey, p_size AS a, 2 AS b FROM part")

TELECOM = """
concept enriched[kind] (user_id, ts, value, day = floor(ts, "day"), big = if value > 50 then 1 else 0) from events e where event_type = kind;
concept attributes dims[kind] (user_id, day) from enriched[kind: "click"] src;
concept cube clicks metrics (clickValue = sum(c.value), bigClicks = sum(c.big)) dimensions (dims[kind: "click", src: "c"]) from enriched[kind: "click"] c;
concept cube views metrics (viewCount = count()) dimensions (dims[kind: "view", src: "v"]) from enriched[kind: "view"] v;
concept cube buys metrics (@Private next = coalesce(lead(b.ts) over (partition by (b.user_id, b.day) order by (b.ts asc)), b.ts), span = max(next) - min(b.ts)) dimensions (dims[kind: "purchase", src: "b"]) from enriched[kind: "purchase"] b;
concept clicksPart is clicks with viewCount = Null, span = Null;
concept viewsPart is views with clickValue = Null, bigClicks = Null, span = Null;
concept buysPart is buys with clickValue = Null, bigClicks = Null, viewCount = Null;
concept parts union of clicksPart, viewsPart, buysPart;
concept cube activity metrics (clickValue = max(p.clickValue), bigClicks = max(p.bigClicks), viewCount = max(p.viewCount), span = max(p.span)) dimensions (user_id, day) from parts p;
"""
add("telecom_style_pipeline", TELECOM, "(user_id, day, clickValue = round(clickValue, 3), bigClicks, viewCount, span) from activity", """
WITH e AS (SELECT *, date_trunc('day', ts) AS day FROM events),
c AS (SELECT user_id, day, round(sum(value), 3) AS clickValue, CAST(sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) AS BIGINT) AS bigClicks FROM e WHERE event_type = 'click' GROUP BY 1, 2),
v AS (SELECT user_id, day, count(*) AS viewCount FROM e WHERE event_type = 'view' GROUP BY 1, 2),
b AS (SELECT user_id, day, CAST(date_diff('microsecond', min(ts), max(ts)) / 1000000.0 AS DOUBLE) AS span FROM e WHERE event_type = 'purchase' GROUP BY 1, 2),
k AS (SELECT user_id, day FROM c UNION SELECT user_id, day FROM v UNION SELECT user_id, day FROM b)
SELECT user_id, day, clickValue, bigClicks, viewCount, span FROM k LEFT JOIN c USING (user_id, day) LEFT JOIN v USING (user_id, day) LEFT JOIN b USING (user_id, day)""")

FLAGSHIP = """
concept bigOrder is orders where o_totalprice > 100000;
concept segmentTotals (segment = c.c_mktsegment, cnt = count(), total = sum(b.o_totalprice)) from bigOrder b, customer c (c_custkey = b.o_custkey) group by segment;
"""
add("flagship", FLAGSHIP, "(segment, cnt, total = round(total, 2)) from segmentTotals", "SELECT c_mktsegment AS segment, count(*) AS cnt, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_totalprice > 100000 GROUP BY 1")


def run(spark: SparkSession, sf_dir: str, key: str) -> DataFrame:
    model, query, _ = QUERIES[key]
    return Engine(spark, SOURCES + model, base=sf_dir).query(query)


# what the text of the language does not reach


def interval_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals are made with the API."""
    engine = Engine(spark, SOURCES, base=sf_dir)
    later = A.Attribute("later", A.Binary("+", A.Name("o_orderdate"), A.Interval(3, "month")))
    select = engine.model.subquery(A.Query((A.Attribute("o_orderkey"), later), (A.Parent(A.Reference("orders")),)), None)
    return spark.sql(engine.lowering.query(select))


def range_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range of time; intervals are made with the API."""
    engine = Engine(spark, SOURCES, base=sf_dir)
    window = A.Window("count", (), (A.Name("event_type"),), (A.OrderBy(A.Name("ts")),), range=(A.Interval("1:00", "hour", "minute"), A.Interval("0:30", "hour", "minute")))
    select = engine.model.subquery(A.Query((A.Attribute("event_id"), A.Attribute("n", window)), (A.Parent(A.Reference("events")),)), None)
    return spark.sql(engine.lowering.query(select))


def from_files(kind: str, types: bool):
    """Writes a table in a format, to a folder that driver and executors share, and queries it there."""

    def go(spark: SparkSession, sf_dir: str) -> DataFrame:
        folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/formats_{uuid.uuid4().hex[:12]}"
        rows = Engine(spark, SOURCES, base=sf_dir).query("(s_suppkey, s_name, s_nationkey, s_acctbal) from supplier")
        rows.write.option("header", True).option("rowTag", "row").format(kind.lower()).save(f"{folder}/supplier")
        names = "int s_suppkey, s_name, int s_nationkey, float s_acctbal" if types else "s_suppkey, s_name, s_nationkey, s_acctbal"
        engine = Engine(spark, f'datasource s ({names}) from {kind} file "supplier"; concept rich is s where s_acctbal > 1000;', base=folder)
        return engine.query("(k = cast(s_suppkey, int), s_name, n = cast(s_nationkey, int), b = round(s_acctbal, 2)) from rich")

    return go


def set_all(kind: str):
    def go(spark: SparkSession, sf_dir: str) -> DataFrame:
        words = {"union": "union of", "intersect": "intersect of", "minus": "minus"}
        return Engine(spark, SOURCES + SETS + f"concept u {words[kind]} f, o;", base=sf_dir, every=True).query("from u")

    return go


def function_concept_udtf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql.functions import udtf

    @udtf(returnType="half: int, twice: int")
    class Halves:
        def eval(self, n: int):
            yield n // 2, n * 2

    engine = Engine(spark, SOURCES + "concept halves (half, twice, @Input n) by halve; concept h (p_partkey, half, twice) from part p, halves x (n = p.p_size);", base=sf_dir)
    engine.register_table("halve", Halves)
    return engine.query("from h")


MATERIALIZED = """
@Materialized(type = "{kind}", strategy = "{strategy}", uniqueKey = "{key}", operator = "{operator}", TargetName = "{target}")
concept cube daily metrics (n = count(), total = sum(e.value)) dimensions ({key}) from kept e;
"""
_numbers = itertools.count()


def materialized(kind: str, strategy: str, operator: str, value: str, key: str, first: str, second: str):
    """Writes the cube over the rows that ``first`` keeps, then runs it again over those that ``second`` keeps."""

    def go(spark: SparkSession, sf_dir: str) -> DataFrame:
        target = f"mat_{uuid.uuid4().hex[:12]}_{next(_numbers)}"
        for i, where in enumerate((first, second)):
            text = SOURCES + f"concept kept is events where {where};" + MATERIALIZED.format(kind=kind, strategy=strategy, key=key, operator=operator, target=target)
            Engine(spark, text, base=sf_dir).materialize(parse_expression(value) if i else None, full=not i)
        return spark.sql(f"SELECT {key}, n, round(total, 3) AS total FROM {target}")

    return go


def delete_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .operators.materialize import delete

    target = f"mat_{uuid.uuid4().hex[:12]}"
    engine = Engine(spark, SOURCES + f'@Materialized(type = "Table", TargetName = "{target}") concept kept is customer without c_name;', base=sf_dir)
    engine.materialize()
    delete(engine, target, parse_expression("c_acctbal < 0 or c_nationkey in [1, 2, 3]"))
    return spark.table(target)


def materialized_view(kind: str):
    def go(spark: SparkSession, sf_dir: str) -> DataFrame:
        target = f"mat_{uuid.uuid4().hex[:12]}"
        engine = Engine(spark, SOURCES + f'@Materialized(type = "{kind}", TargetName = "{target}") concept kept is customer where c_acctbal > 5000; concept over (c_mktsegment, n = count()) from kept group by c_mktsegment;', base=sf_dir)
        engine.materialize()
        return engine.query("from over")

    return go


ALL_EVENTS, PART = "value != Null or value = Null", "value > 20"
_SUM = "count(*) AS n, round(sum(value), 3) AS total"
OTHERS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "interval_add": (interval_add, "SELECT o_orderkey, o_orderdate + INTERVAL 3 MONTH AS later FROM orders"),
    "frame_range_interval": (range_interval, "SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND INTERVAL 30 MINUTE FOLLOWING) AS n FROM events"),
    **{f"read_{kind.lower()}{'_typed' if types else ''}": (from_files(kind, types), "SELECT CAST(s_suppkey AS INTEGER) AS k, s_name, CAST(s_nationkey AS INTEGER) AS n, round(s_acctbal, 2) AS b FROM supplier WHERE s_acctbal > 1000") for kind, types in (("CSV", False), ("CSV", True), ("JSON", False), ("JSON", True), ("ORC", False), ("XML", False), ("PARQUET", True))},
    "union_all": (set_all("union"), f"{F_} UNION ALL SELECT k, p FROM ({O_})"),
    "intersect_all": (set_all("intersect"), f"{F_} INTERSECT ALL {O_}"),
    "minus_all": (set_all("minus"), f"{F_} EXCEPT ALL {O_}"),
    "function_concept_udtf": (function_concept_udtf, "SELECT p_partkey, p_size // 2 AS half, p_size * 2 AS twice FROM part"),
    "mat_table": (materialized("Table", "", "=", "0", "event_type", PART, ALL_EVENTS), f"SELECT event_type, {_SUM} FROM events GROUP BY 1"),
    "mat_view": (materialized_view("View"), "SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_acctbal > 5000 GROUP BY 1"),
    "mat_snapshot": (materialized_view("MaterializedView"), "SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_acctbal > 5000 GROUP BY 1"),
    "mat_incremental_delete_insert": (materialized("Incremental", "InsertDelete", "in", '["click", "view"]', "event_type", PART, ALL_EVENTS), f"SELECT event_type, {_SUM} FROM events WHERE value > 20 OR event_type IN ('click', 'view') GROUP BY 1"),
    "mat_append": (materialized("Incremental", "Append", "=", '"click"', "event_type", PART, ALL_EVENTS), f"SELECT event_type, {_SUM} FROM events WHERE value > 20 GROUP BY 1 UNION ALL SELECT event_type, {_SUM} FROM events WHERE event_type = 'click' GROUP BY 1"),
    "mat_merge": (materialized("Incremental", "Merge", "<", "100", "user_id", "user_id > 50", PART), f"SELECT user_id, {_SUM} FROM events WHERE (user_id < 100 AND value > 20) OR (user_id >= 100) OR (user_id > 50 AND user_id < 100 AND user_id NOT IN (SELECT user_id FROM events WHERE user_id < 100 AND value > 20)) GROUP BY 1"),
    "mat_insert_override_merge": (materialized("Incremental", "InsertOverrideMerge", "between", "[20, 60]", "user_id", ALL_EVENTS, PART), f"SELECT user_id, {_SUM} FROM events WHERE user_id NOT BETWEEN 20 AND 60 OR value > 20 GROUP BY 1"),
    "delete_rows": (delete_rows, "SELECT c_custkey, c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE NOT coalesce(c_acctbal < 0 OR c_nationkey IN (1, 2, 3), FALSE)"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    plain = {key: (lambda spark, sf_dir, key=key: run(spark, sf_dir, key)) for key in QUERIES}
    return plain | {key: go for key, (go, _) in OTHERS.items()}


def oracle_sql() -> dict[str, str]:
    return {key: sql for key, (_, _, sql) in QUERIES.items()} | {key: sql for key, (_, sql) in OTHERS.items()}
