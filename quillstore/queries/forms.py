"""Queries of SQL forms and of functions by family, over whole tables; clocks and sessions by what must hold of them."""

from __future__ import annotations

from ..functions import info
from ..plans.rewrite import rewrite
from .registered import mysql, query, views

# -- joins, grouping, frames, set operations ----------------------------------------------

mysql("join_right", "SELECT n.n_name, c.c_custkey FROM nation AS n RIGHT JOIN customer AS c ON n.n_nationkey = c.c_nationkey AND n.n_regionkey = 1")
mysql("join_cross", "SELECT n.n_nationkey, r.r_regionkey FROM nation AS n CROSS JOIN region AS r")
mysql("join_natural", "SELECT doc_id, toxic, lang FROM labels NATURAL JOIN documents")
mysql("join_using", "SELECT doc_id, quality, source FROM labels JOIN documents USING (doc_id)")
mysql("join_left_nulls", "SELECT n.n_nationkey, count(s.s_suppkey) AS n, sum(s.s_acctbal) IS NULL AS none FROM nation AS n LEFT JOIN supplier AS s ON n.n_nationkey = s.s_nationkey AND s.s_acctbal > 9000 GROUP BY n.n_nationkey")
mysql("outer_join_constants", "SELECT c.c_custkey, o.o_orderkey FROM customer AS c LEFT JOIN orders AS o ON c.c_custkey = o.o_custkey WHERE c.c_custkey = 7 AND (o.o_orderstatus = 'O' OR o.o_orderstatus IS NULL)")
mysql("grouping_sets", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())")
mysql(
    "window_range",
    "SELECT o_orderkey, count(*) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey RANGE BETWEEN 50 PRECEDING AND 50 FOLLOWING) AS near,"
    " sum(o_custkey) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS so_far FROM orders",
    "SELECT o_orderkey, count(*) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey RANGE BETWEEN 50 PRECEDING AND 50 FOLLOWING) AS near,"
    " CAST(sum(o_custkey) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS so_far FROM orders",
)
mysql("except_all", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey AS k FROM supplier")
mysql("intersect_all", "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey AS k FROM supplier")
mysql("row_comparison", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_returnflag, l_linestatus) = ('R', 'F') AND (l_orderkey, l_linenumber) >= (100, 2) AND row(l_linenumber, 1) <> row(3, 1)",
      "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F' AND (l_orderkey > 100 OR (l_orderkey = 100 AND l_linenumber >= 2)) AND l_linenumber <> 3")
mysql("row_in_list", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_orderkey, l_linenumber) IN ((1, 1), (2, 1), (3, 2), (7, 9))")
mysql("deviations", "SELECT l_returnflag, round(std(l_quantity), 6) AS s, round(stddev(l_tax), 6) AS t, round(stddev_pop(l_discount), 6) AS p FROM lineitem GROUP BY l_returnflag",
      "SELECT l_returnflag, round(stddev_pop(l_quantity), 6) AS s, round(stddev_pop(l_tax), 6) AS t, round(stddev_pop(l_discount), 6) AS p FROM lineitem GROUP BY l_returnflag")
mysql("first_rows", "SELECT n_regionkey, first_row(n_regionkey) AS f, any_value(n_regionkey) AS a FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, any_value(n_regionkey) AS f, any_value(n_regionkey) AS a FROM nation GROUP BY n_regionkey")
mysql("exists_subquery", "SELECT s_suppkey FROM supplier AS s WHERE EXISTS (SELECT 1 FROM lineitem AS l WHERE l.l_suppkey = s.s_suppkey AND l.l_quantity > 45)")
mysql("scalar_subquery", "SELECT p_partkey FROM part WHERE p_retailprice > (SELECT avg(p_retailprice) FROM part)")
mysql("union_types", "SELECT c_custkey AS k FROM customer UNION ALL SELECT c_acctbal AS k FROM customer", "SELECT CAST(c_custkey AS DOUBLE) AS k FROM customer UNION ALL SELECT c_acctbal AS k FROM customer")
mysql("group_by_expression", "SELECT l_linenumber % 3 AS g, count(*) AS n, max(l_quantity) AS m FROM lineitem GROUP BY l_linenumber % 3 HAVING count(*) > 1 ORDER BY g")

# -- functions ----------------------------------------------------------------------------

mysql(
    "angles_and_logs",
    "SELECT p_partkey, round(cos(p_size), 9) AS a, round(sin(p_size), 9) AS b, round(tan(p_size), 6) AS c, round(cot(p_size), 6) AS d, power(p_size, 2) AS e, round(asin(p_size / 100), 9) AS f, round(atan(p_size), 9) AS g, round(atan(p_size, 2), 9) AS h, round(atan2(p_size, 3), 9) AS i,"
    " CAST(ceiling(p_retailprice) AS DOUBLE) AS j, round(degrees(p_size), 6) AS k, round(radians(p_size), 9) AS l, round(pi(), 9) AS m, round(log(p_size), 9) AS n, round(log(2, p_size), 9) AS o, CAST(~p_partkey AS CHAR) AS p FROM part",
    "SELECT p_partkey, round(cos(p_size), 9) AS a, round(sin(p_size), 9) AS b, round(tan(p_size), 6) AS c, round(1 / tan(p_size), 6) AS d, pow(p_size, 2) AS e, round(asin(p_size / 100), 9) AS f, round(atan(p_size), 9) AS g, round(atan2(p_size, 2), 9) AS h, round(atan2(p_size, 3), 9) AS i,"
    " ceil(p_retailprice) AS j, round(degrees(p_size), 6) AS k, round(radians(p_size), 9) AS l, round(pi(), 9) AS m, round(ln(p_size), 9) AS n, round(log2(p_size), 9) AS o, CAST(18446744073709551615 - p_partkey AS VARCHAR) AS p FROM part",
)
mysql(
    "random_values",
    "SELECT count(*) AS n, min(r) >= 0 AS a, max(r) < 1 AS b, min(s) >= 0 AND max(s) < 1 AS c, count(DISTINCT u) = count(*) AS d, min(length(u)) AS e, min(u REGEXP '^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$') AS f, min(length(x)) AS g"
    " FROM (SELECT rand() AS r, rand(7) AS s, uuid() AS u, random_bytes(16) AS x FROM customer) AS t",
    "SELECT count(*) AS n, true AS a, true AS b, true AS c, true AS d, CAST(36 AS BIGINT) AS e, true AS f, CAST(16 AS BIGINT) AS g FROM customer",
)
mysql(
    "clocks",
    "SELECT now() >= TIMESTAMP '2020-01-01 00:00:00' AS a, current_timestamp() = now() AS b, localtime() = now() AS c, localtimestamp = now() AS d, sysdate() >= now() AS e, curdate() >= DATE '2020-01-01' AS f, curdate() = current_date() AS g, current_date = date(now()) AS h,"
    " curtime() REGEXP '^[0-2][0-9]:[0-5][0-9]:[0-5][0-9]$' AS i, current_time() = curtime() AS j, utc_date() >= DATE '2020-01-01' AS k, utc_time() REGEXP '^[0-2][0-9]:[0-5][0-9]:[0-5][0-9]$' AS l, abs(timestampdiff(hour, utc_timestamp(), now())) <= 14 AS m, datediff(utc_date(), curdate()) BETWEEN -1 AND 1 AS n,"
    " unix_timestamp() > 1577836800 AS o",
    "SELECT " + ", ".join(f"true AS {c}" for c in "abcdefghijklmno"),
)
mysql(
    "session_values",
    "SELECT connection_id() >= 1 AS a, current_role() AS b, length(current_user()) > 0 AS c, current_user = current_user() AS d, database() AS e, schema() AS f, found_rows() AS g, last_insert_id() AS h, last_insert_id(7) AS i, row_count() AS j, user() = session_user() AS k,"
    " system_user() = current_user() AS l, version() REGEXP '^5[.]7' AS m, collation('a') AS n, coercibility('a') AS o, coercibility(NULL) AS p, @@autocommit AS q, any_value(3) AS r",
    "SELECT true AS a, 'NONE' AS b, true AS c, true AS d, 'default' AS e, 'default' AS f, 0 AS g, 0 AS h, 7 AS i, -1 AS j, true AS k, true AS l, true AS m, 'utf8mb4_bin' AS n, 4 AS o, 6 AS p, '1' AS q, 3 AS r",
)


@query("SELECT o_orderkey, 10 AS a, 15 AS b, 15 AS c, 40 AS d, 45 AS e, 3 AS f, 3 AS g, 4 AS h, CAST(o_orderkey + 5 AS BIGINT) AS i FROM orders")
def variables_and_sequences(spark, sf_dir):
    text = "SELECT o_orderkey, nextval('s') AS a, nextval('s') AS b, lastval('s') AS c, setval('s', 40) AS d, nextval('s') AS e, setvar('v', 3) AS f, getvar('v') AS g, @v + 1 AS h, o_orderkey + getparam(1) AS i FROM orders"
    views(spark, sf_dir, text)
    with info.using(info.Scope()):
        info.create_sequence("s", 10, 5)
        return spark.sql(rewrite(text), args={"p1": 5})


mysql(
    "date_functions",
    "SELECT o_orderkey, adddate(o_orderdate, interval 1 week) AS a, adddate(o_orderdate, 3) AS b, subdate(o_orderdate, interval 1 year) AS c, subdate(o_orderdate, 31) AS d, convert_tz(o_orderdate, '+00:00', '+05:30') AS e, DATE '1996-02-29' AS f, TIME '10:11:12' AS g, dayofmonth(o_orderdate) AS h,"
    " get_format(DATE, 'EUR') AS i, makedate(1996, 1 + o_orderkey % 366) AS j, microsecond('10:11:12.000345') AS k, period_add(199501, o_orderkey % 50) AS l, subtime('10:00:00', '00:30:00') AS m, time(o_orderdate) AS n, timestamp(o_orderdate) AS o, timestampadd(minute, 5, o_orderdate) AS p,"
    " to_seconds(o_orderdate) AS q, CAST(from_unixtime(o_orderkey * 3600) AS CHAR) AS r, from_unixtime(o_orderkey * 3600, '%Y-%m-%d') AS s, timestamp('2020-01-01', '01:02:03') AS t FROM orders",
    "SELECT o_orderkey, o_orderdate + INTERVAL 7 DAY AS a, o_orderdate + INTERVAL 3 DAY AS b, o_orderdate - INTERVAL 1 YEAR AS c, o_orderdate - INTERVAL 31 DAY AS d, o_orderdate + INTERVAL 330 MINUTE AS e, DATE '1996-02-29' AS f, '10:11:12' AS g, CAST(day(o_orderdate) AS INTEGER) AS h,"
    " '%d.%m.%Y' AS i, CAST(DATE '1996-01-01' + CAST(o_orderkey % 366 AS INTEGER) AS DATE) AS j, CAST(345 AS BIGINT) AS k, CAST((1995 + (o_orderkey % 50) // 12) * 100 + (o_orderkey % 50) % 12 + 1 AS BIGINT) AS l, '09:30:00' AS m, strftime(o_orderdate, '%H:%M:%S') AS n, o_orderdate AS o, o_orderdate + INTERVAL 5 MINUTE AS p,"
    " CAST(date_diff('second', TIMESTAMP '1970-01-01', o_orderdate) + 62167219200 AS BIGINT) AS q, strftime(make_timestamp(o_orderkey * 3600 * 1000000), '%Y-%m-%d %H:%M:%S') AS r, strftime(make_timestamp(o_orderkey * 3600 * 1000000), '%Y-%m-%d') AS s, TIMESTAMP '2020-01-01 01:02:03' AS t FROM orders",
)
mysql("tso_times", "SELECT o_orderkey, CAST(tidb_parse_tso(o_orderkey * 262144 * 1000) AS CHAR) AS a FROM orders", "SELECT o_orderkey, CASE WHEN o_orderkey > 0 THEN strftime(make_timestamp(o_orderkey * 1000000), '%Y-%m-%d %H:%M:%S') END AS a FROM orders")
mysql(
    "text_functions",
    "SELECT p_partkey, lcase(p_name) AS a, lower(p_brand) AS b, ucase(p_type) AS c, ltrim(concat('  ', p_name)) AS d, rtrim(concat(p_name, '  ')) AS e, mid(p_name, 2, 3) AS f, substr(p_name, 3) AS g, position('e' in p_name) AS h, character_length(p_name) AS i, convert(p_name using utf8mb4) AS j,"
    " weight_string(p_type) AS k, format_bytes(p_partkey % 1000) AS l, format_bytes(p_partkey % 1000 * 1048576) AS m, format_nano_time(p_partkey % 1000 * 1000) AS n, name_const('x', 5) AS o, is_ipv4_compat(inet6_aton('::10.0.5.9')) AS p, is_ipv4_compat(inet6_aton('::ffff:10.0.5.9')) AS q FROM part",
    "SELECT p_partkey, lower(p_name) AS a, lower(p_brand) AS b, upper(p_type) AS c, p_name AS d, p_name AS e, substring(p_name, 2, 3) AS f, substring(p_name, 3) AS g, CAST(instr(p_name, 'e') AS INTEGER) AS h, CAST(length(p_name) AS BIGINT) AS i, p_name AS j, upper(hex(encode(p_type))) AS k,"
    " p_partkey % 1000 || ' bytes' AS l, CASE WHEN p_partkey % 1000 = 0 THEN '0 bytes' ELSE (p_partkey % 1000) || '.00 MiB' END AS m, CASE WHEN p_partkey % 1000 = 0 THEN '0 ns' ELSE (p_partkey % 1000) || '.00 us' END AS n, 5 AS o, CAST(1 AS BIGINT) AS p, CAST(0 AS BIGINT) AS q FROM part",
)
mysql(
    "codes",
    "SELECT c_custkey, sha(c_name) AS a, CAST(decode(encode(c_name, 'key'), 'key') AS CHAR) AS b, CAST(uncompress(compress(c_name)) AS CHAR) AS c, length(encode(c_name, 'key')) AS d FROM customer",
    "SELECT c_custkey, sha1(c_name) AS a, c_name AS b, c_name AS c, CAST(strlen(c_name) AS BIGINT) AS d FROM customer",
)
mysql(
    "json_edits",
    "SELECT event_id, json_unquote(json_extract(json_object('t', event_type), '$.t')) AS a, json_insert('{\"k\": 1}', '$.k', 2, '$.u', user_id) AS b, json_replace('{\"k\": 1}', '$.k', user_id, '$.z', 3) AS c, json_array_append('[1, [2]]', '$[1]', user_id) AS d, json_array_insert('[1, 2]', '$[1]', user_id) AS e,"
    " json_merge_preserve('[1]', json_array(user_id)) AS f, json_quote(event_type) AS g, json_storage_size('{\"k\": 1}') > 0 AS h FROM events",
    "SELECT event_id, event_type AS a, '{\"k\": 1, \"u\": ' || user_id || '}' AS b, '{\"k\": ' || user_id || '}' AS c, '[1, [2, ' || user_id || ']]' AS d, '[1, ' || user_id || ', 2]' AS e, '[1, ' || user_id || ']' AS f, '\"' || event_type || '\"' AS g, true AS h FROM events",
)
