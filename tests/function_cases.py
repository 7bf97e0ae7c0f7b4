"""MySQL expressions and their values, worked out from the public documentation."""

CASES = [
    # common, compare, control
    ("coalesce(NULL, 3, 4)", 3), ("isnull(NULL)", 1), ("greatest(2, 5, 3)", 5), ("greatest(2, NULL)", None), ("least('b', 'a')", "a"), ("least(1, NULL)", None),
    ("interval(23, 1, 15, 17, 30, 44, 200)", 3), ("interval(NULL, 1)", -1), ("interval(0, 1, 2)", 0), ("if(1 < 2, 'y', 'n')", "y"), ("if(0, 'y', 'n')", "n"), ("if(NULL, 1, 2)", 2),
    ("ifnull(NULL, 10)", 10), ("nullif(1, 1)", None), ("case 2 when 1 then 'a' when 2 then 'b' end", "b"), ("case when 1 > 2 then 'a' else 'c' end", "c"), ("2 in (1, 2)", True), ("NULL <=> NULL", True),
    ("'abc' like 'a%'", True), ("'a_c' like 'a\\_c'", True), ("'abc' not like 'b%'", True), ("'abc' regexp '^a.c$'", True), ("1 xor 1", False), ("1 and 0", False), ("0 or 2", True), ("not 0", True), ("!5", False),
    ("5 between 1 and 5", True), ("NULL is null", True), ("1 is true", True), ("any_value(7)", 7),
    # math
    ("abs(-5)", 5), ("acos(2)", None), ("asin(0)", 0.0), ("atan(1, 1)", 0.7853981633974483), ("atan2(1, 1)", 0.7853981633974483), ("ceil(1.2)", 2.0), ("ceiling(-1.2)", -1.0), ("conv('a', 16, 2)", "1010"), ("conv(-17, 10, -18)", "-H"),
    ("crc32('MySQL')", 3259397556), ("degrees(pi())", 180.0), ("floor(-1.2)", -2.0), ("ln(0)", None), ("log(2, 65536)", 16.0), ("log(1, 5)", None), ("log2(8)", 3.0), ("log10(100)", 2.0), ("pow(2, 3)", 8.0), ("radians(180)", 3.141592653589793),
    ("round(1.298, 1)", 1.3), ("round(-1.58)", -2.0), ("round(2.5)", 3.0), ("sign(-32)", -1), ("sqrt(-1)", None), ("sqrt(16)", 4.0), ("truncate(1.999, 1)", 1.9), ("truncate(-1.999, 1)", -1.9), ("truncate(122, -2)", 100.0),
    ("7 / 2", 3.5), ("7 / 0", None), ("7 div 2", 3), ("-7 div 2", -3), ("7 div 0", None), ("7 % 3", 1), ("-7 mod 3", -1), ("7 mod 0", None), ("1 << 3", 8), ("1 << 64", 0), ("-1 >> 60", 15), ("5 & 3", 1), ("5 | 3", 7), ("5 ^ 3", 6), ("~0", 18446744073709551615.0), ("bit_count(29)", 4), ("1 + 2 * 3", 7), ("-(3)", -3),
    # strings
    ("ascii('2')", 50), ("ascii('')", 0), ("ascii('é')", 195), ("bin(12)", "1100"), ("bit_length('text')", 32), ("char(77, 121, 83)", "MyS"), ("char_length('née')", 3), ("length('née')", 4), ("octet_length('é')", 2), ("concat('a', NULL)", None), ("concat('a', 1)", "a1"),
    ("concat_ws(',', 'a', NULL, 'b')", "a,b"), ("elt(1, 'a', 'b')", "a"), ("elt(0, 'a')", None), ("elt(3, 'a')", None), ("export_set(5, 'Y', 'N', ',', 4)", "Y,N,Y,N"), ("export_set(6, '1', '0', ',', 10)", "0,1,1,0,0,0,0,0,0,0"), ("field('b', 'a', 'b')", 2), ("field('z', 'a')", 0), ("find_in_set('b', 'a,b,c')", 2), ("find_in_set('a,', 'a,')", 0),
    ("format(12332.123456, 4)", "12,332.1235"), ("format(12332.2, 0)", "12,332"), ("from_base64(to_base64('abc'))", b"abc"), ("hex('abc')", "616263"), ("hex(255)", "FF"), ("insert('Quadratic', 3, 4, 'What')", "QuWhattic"), ("insert('Quadratic', -1, 4, 'What')", "Quadratic"), ("insert('Quadratic', 3, 100, 'What')", "QuWhat"),
    ("instr('foobarbar', 'bar')", 4), ("lcase('ABC')", "abc"), ("left('foobarbar', 5)", "fooba"), ("right('foobarbar', 4)", "rbar"), ("left('abc', -1)", ""), ("locate('bar', 'foobarbar', 5)", 7), ("locate('', 'abc', 2)", 2), ("locate('x', 'abc', 9)", 0), ("lpad('hi', 4, '??')", "??hi"), ("lpad('hi', 1, '?')", "h"), ("lpad('hi', -1, '?')", None), ("lpad('hi', 5, '')", None), ("rpad('hi', 5, '?')", "hi???"),
    ("ltrim('  a')", "a"), ("rtrim('a  ')", "a"), ("make_set(1 | 4, 'hello', 'nice', 'world')", "hello,world"), ("make_set(0, 'a')", ""), ("mid('Quadratically', 5, 6)", "ratica"), ("oct(12)", "14"), ("ord('2')", 50), ("ord('é')", 50089), ("position('bar' in 'foobar')", 4), ("quote('Don\\'t!')", "'Don\\'t!'"), ("quote(NULL)", "NULL"), ("repeat('ab', 3)", "ababab"), ("repeat('a', -1)", ""),
    ("replace('www.a.com', 'w', 'Ww')", "WwWwWw.a.com"), ("reverse('abc')", "cba"), ("space(3)", "   "), ("strcmp('a', 'b')", -1), ("strcmp('a', 'a')", 0), ("substring('Quadratically', 5)", "ratically"), ("substring('abc', 0)", ""), ("substring('Sakila', -3)", "ila"), ("substring('Sakila', -9)", ""), ("substring('foobarbar' from 4)", "barbar"), ("substr('abcdef', 2, 3)", "bcd"), ("substring_index('www.mysql.com', '.', 2)", "www.mysql"), ("substring_index('www.mysql.com', '.', -2)", "mysql.com"),
    ("to_base64('abc')", "YWJj"), ("trim('  bar ')", "bar"), ("trim(leading 'x' from 'xxxbarxxx')", "barxxx"), ("trim(both 'xy' from 'xyxybarxy')", "bar"), ("trim(trailing 'xyz' from 'barxxyz')", "barx"), ("ucase('a')", "A"), ("unhex('4D7953514C')", b"MySQL"), ("unhex('GG')", None), ("upper('é')", "É"), ("weight_string('ab')", "6162"), ("convert('abc' using utf8)", "abc"),
    # time
    ("adddate('2008-01-02', interval 31 day)", "2008-02-02 00:00:00"), ("date_add('2018-01-31', interval 1 month)", "2018-02-28 00:00:00"), ("date_add('2018-05-01 00:00:00', interval '1:30' minute_second)", "2018-05-01 00:01:30"), ("date_sub('1998-01-02', interval 31 day)", "1997-12-02 00:00:00"), ("date_add('2100-12-31 23:59:59', interval '1-2' year_month)", "2102-02-28 23:59:59"), ("date_sub('2005-01-01 00:00:00', interval '1 1:1:1' day_second)", "2004-12-30 22:58:59"), ("'2018-12-31 23:59:59' + interval 1 second", "2019-01-01 00:00:00"),
    ("addtime('01:00:00', '02:30:00')", "03:30:00"), ("addtime('2007-12-31 23:59:59', '1:1:2')", "2008-01-01 01:01:01"), ("subtime('01:00:00', '02:30:00')", "-01:30:00"), ("convert_tz('2004-01-01 12:00:00', '+00:00', '+10:00')", "2004-01-01 22:00:00"), ("convert_tz('2004-01-01 12:00:00', 'UTC', '+10:00')", None), ("date('2003-12-31 01:02:03')", "2003-12-31"), ("date('nonsense')", None),
    ("date_format('2009-10-04 22:23:00', '%W %M %Y')", "Sunday October 2009"), ("date_format('2007-10-04 22:23:00', '%H:%i:%s')", "22:23:00"), ("date_format('1999-01-01', '%X %V')", "1998 52"), ("date_format('2006-06-01', '%D %y %a %d %m %b %j')", "1st 06 Thu 01 06 Jun 152"), ("date_format('1999-01-01', '%U %u %v %x %w')", "00 00 53 1998 5"), ("datediff('2007-12-31 23:59:59', '2007-12-30')", 1),
    ("dayname('2007-02-03')", "Saturday"), ("dayofmonth('2007-02-03')", 3), ("dayofweek('2007-02-03')", 7), ("dayofyear('2007-02-03')", 34), ("extract(year from '2019-07-02')", 2019), ("extract(year_month from '2019-07-02 01:02:03')", 201907), ("extract(day_minute from '2019-07-02 01:02:03')", 20102), ("extract(microsecond from '2003-01-02 10:30:00.000123')", 123), ("from_days(730669)", "2000-07-03"), ("to_days('2007-10-07')", 733321), ("to_seconds('2009-11-29')", 63426672000), ("from_unixtime(1447430881)", "2015-11-13 16:08:01"), ("from_unixtime(1447430881, '%Y %D %M %h:%i:%s')", "2015 13th November 04:08:01"),
    ("get_format(date, 'EUR')", "%d.%m.%Y"), ("hour('272:59:59')", 272), ("hour('10:05:03')", 10), ("last_day('2003-02-05')", "2003-02-28"), ("makedate(2011, 32)", "2011-02-01"), ("makedate(2011, 0)", None), ("makedate(70, 1)", "1970-01-01"), ("maketime(12, 15, 30)", "12:15:30"), ("maketime(12, 60, 30)", None), ("microsecond('12:00:00.123456')", 123456), ("minute('2008-02-03 10:05:03')", 5), ("monthname('2008-02-03')", "February"), ("period_add(200801, 2)", 200803), ("period_diff(200802, 200703)", 11), ("quarter('2008-04-01')", 2),
    ("sec_to_time(2378)", "00:39:38"), ("sec_to_time(99999999)", "838:59:59"), ("second('10:05:03')", 3), ("str_to_date('01,5,2013', '%d,%m,%Y')", "2013-05-01"), ("str_to_date('a', '%Y')", None), ("time('2003-12-31 01:02:03')", "01:02:03"), ("time_format('100:00:00', '%H %k %h %I %l')", "100 100 04 04 4"), ("time_to_sec('22:23:00')", 80580), ("timediff('2008-12-31 23:59:59', '2008-12-30 01:01:01')", "46:58:58"), ("timediff('01:00:00', '2008-12-30 01:01:01')", None), ("timestamp('2003-12-31')", "2003-12-31 00:00:00"), ("timestamp('2003-12-31 12:00:00', '12:00:00')", "2004-01-01 00:00:00"),
    ("timestampadd(minute, 1, '2003-01-02')", "2003-01-02 00:01:00"), ("timestampdiff(month, '2003-02-01', '2003-05-01')", 3), ("timestampdiff(year, '2002-05-01', '2001-01-01')", -1), ("unix_timestamp('2015-11-13 10:20:19')", 1447410019), ("week('2008-02-20')", 7), ("week('2008-02-20', 0)", 7), ("week('2008-02-20', 1)", 8), ("week('2008-12-31', 1)", 53), ("week('2000-01-01', 0)", 0), ("week('2000-01-01', 2)", 52), ("week('2000-01-01', 5)", 0), ("weekday('2008-02-03 22:23:00')", 6), ("weekofyear('2008-02-20')", 8), ("yearweek('1987-01-01')", 198652), ("year('1987-01-01')", 1987),
    ("date '2020-02-29'", "2020-02-29"), ("tidb_parse_tso(443852055297916932)", "2023-08-27 18:33:41.687000"),
    # information, misc
    ("connection_id()", 1), ("row_count()", -1), ("format_bytes(512)", "512 bytes"), ("format_bytes(18446744073709551615)", "16.00 EiB"), ("format_nano_time(3501)", "3.50 us"), ("coercibility('abc')", 4), ("name_const('n', 14)", 14), ("inet_aton('10.0.5.9')", 167773449), ("inet_aton('127.255')", 2130706687), ("inet_aton('127')", 127), ("inet_aton('256.1.1.1')", None), ("inet_ntoa(167773449)", "10.0.5.9"), ("inet_ntoa(-1)", None), ("inet6_ntoa(inet6_aton('fdfe::5a55:caff:fefa:9089'))", "fdfe::5a55:caff:fefa:9089"), ("inet6_ntoa(inet6_aton('10.0.5.9'))", "10.0.5.9"), ("is_ipv4('10.0.5.9')", 1), ("is_ipv4('10.0.5.256')", 0), ("is_ipv4(NULL)", 0), ("is_ipv6('::1')", 1), ("is_ipv4_mapped(inet6_aton('::ffff:198.51.100.1'))", 1), ("is_ipv4_compat(inet6_aton('::198.51.100.1'))", 1),
    # crypto
    ("md5('testing')", "ae2b1fca515949e5d54fb22b8ed95575"), ("sha1('abc')", "a9993e364706816aba3e25717850c26c9cd0d89d"), ("sha2('abc', 224)", "23097d223405d8228642a477bda255b32aadbce4bda0b3f7e36c9da7"), ("sha2('abc', 100)", None), ("password('mypass')", "*6C8989366EAF75BB670AD8EA7A7FC1176A95CEF4"), ("password('')", ""), ("cast(aes_decrypt(aes_encrypt('text', 'pw'), 'pw') as char)", "text"), ("cast(uncompress(compress('any string')) as char)", "any string"), ("uncompressed_length(compress(repeat('a', 30)))", 30), ("cast(decode(encode('abc', 'k'), 'k') as char)", "abc"), ("length(random_bytes(16))", 16),
    # JSON
    ("json_type('[1]')", "ARRAY"), ("json_type('\"a\"')", "STRING"), ("json_extract('[10, 20, [30, 40]]', '$[1]')", "20"), ("json_extract('{\"a\": {\"b\": 1}}', '$.a.b', '$.a')", "[1, {\"b\": 1}]"), ("json_extract('[1, [2, 3]]', '$[1][*]')", "[2, 3]"), ("json_extract('{\"a\": 1}', '$.x')", None), ("json_unquote('\"a\\\\nb\"')", "a\nb"), ("json_unquote('abc')", "abc"),
    ("json_set('{\"a\": 1, \"b\": [2, 3]}', '$.a', 10, '$.c', 'x')", "{\"a\": 10, \"b\": [2, 3], \"c\": \"x\"}"), ("json_insert('{\"a\": 1}', '$.a', 10, '$.c', NULL)", "{\"a\": 1, \"c\": null}"), ("json_replace('{\"a\": 1}', '$.a', 10, '$.c', 1)", "{\"a\": 10}"), ("json_remove('[\"a\", [\"b\", \"c\"], \"d\"]', '$[1]')", "[\"a\", \"d\"]"), ("json_merge('[1, 2]', 'true')", "[1, 2, true]"), ("json_merge_preserve('{\"a\": 1}', '{\"a\": 2, \"b\": 3}')", "{\"a\": [1, 2], \"b\": 3}"), ("json_object('id', 87, 'name', 'carrot')", "{\"id\": 87, \"name\": \"carrot\"}"), ("json_array(1, 'abc', NULL, 1.5)", "[1, \"abc\", null, 1.5]"), ("json_array(json_array(1))", "[[1]]"),
    ("json_contains('{\"a\": 1, \"b\": 2}', '1', '$.a')", 1), ("json_contains('[1, 2, [3]]', '[1, 3]')", 1), ("json_contains('[1, 2]', '[1, 3]')", 0), ("json_contains('[1, [2, 3]]', '[2]')", 1), ("json_contains_path('{\"a\": 1}', 'one', '$.a', '$.e')", 1), ("json_contains_path('{\"a\": 1}', 'all', '$.a', '$.e')", 0), ("json_valid('{\"a\": 1}')", 1), ("json_valid('hello')", 0), ("json_valid(NULL)", None), ("json_valid('{\"a\": NaN}')", 0), ("json_type('1.5')", "DOUBLE"), ("json_type('7')", "INTEGER"), ("json_type('null')", "NULL"), ("json_type('true')", "BOOLEAN"), ("json_type('{}')", "OBJECT"), ("json_type(NULL)", None), ("json_length('[]')", 0), ("json_length('{\"a\": [1, 2]}', '$.a')", 2), ("json_unquote('\"x')", '"x'), ("json_unquote(NULL)", None), ("json_array_append('[\"a\", [\"b\"]]', '$[1]', 1)", "[\"a\", [\"b\", 1]]"), ("json_array_insert('[\"a\", 1]', '$[1]', 'x')", "[\"a\", \"x\", 1]"), ("json_quote('a\"b')", "\"a\\\"b\""), ("json_search('[\"abc\", {\"x\": \"abc\"}]', 'all', 'a%')", "[\"$[0]\", \"$[1].x\"]"), ("json_depth('[10, {\"a\": 20}]')", 3), ("json_keys('{\"a\": 1, \"b\": {\"c\": 30}}')", "[\"a\", \"b\"]"), ("json_keys('[1]')", None), ("json_length('[1, 2, {\"a\": 3}]')", 3), ("json_length('{\"a\": 1}', '$.b')", None), ("json_length('3')", 1), ("json_storage_size('{\"a\": 1}')", 8),
    # casts
    ("cast('12abc' as signed)", 12), ("cast('x' as signed)", 0), ("cast(2.5 as signed)", 3), ("cast('2020-01-02' as date)", "2020-01-02"), ("cast(5 as char)", "5"), ("cast('1.239' as decimal(5, 2))", 1.24), ("'A' collate utf8mb4_general_ci = 'a'", True), ("@@version", "5.7.25-quillstore"), ("0x41 = 'A'", True),
]
