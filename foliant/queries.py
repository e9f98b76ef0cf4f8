"""The package's own queries over the driver's tables, and the SQL that each is held against.

The star schema carries the document workspace: customers are users, orders projects (o_custkey their owner, o_orderdate
their last update), lineitems files; region, nation, customer and supplier are the keyed chain with two child lists;
documents are contents, conversations chats, events edits. Replies, code blocks and marks that the tables don't have are
composed of their columns, in the same way on both sides.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.functions import checks as v
from foliant.functions import text as t
from foliant.functions.lexer import RULES, tokenised
from foliant.operators import collections as c
from foliant.operators import reads, replay, writes
from foliant.operators import requests as gate
from foliant.plans import compiling, edits, processes, retries, splitter, workers
from foliant.session import new_folder, prepared
from foliant.sources import answers as recorded
from foliant.sources import tables
from foliant.sources.files import assets_as_base64, refused, table, to_write, without_deleted, write_files
from foliant.streaming import debounce, feeds, timers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

OWNER, PROJECT = 37, 33


def query(sql: str | None = None) -> Callable:
    def register(f: Callable) -> Callable:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            prepared(spark)
            return f(lambda name: table(spark, folder, name))

        QUERIES[f.__name__] = run
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


# ---- reads


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate FROM orders WHERE o_custkey = 37 ORDER BY o_orderdate DESC, o_orderkey")
def r1_owner_list(read):
    return reads.newest_first(read("orders"), "o_custkey", OWNER, "o_orderdate", "o_orderkey").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate")


@query("""
SELECT n_nationkey, n_name, coalesce(c.n, 0) AS n_customers, coalesce(c.keys, '') AS customers, coalesce(s.n, 0) AS n_suppliers, coalesce(s.keys, '') AS suppliers
FROM nation LEFT JOIN (SELECT c_nationkey, count(*) AS n, string_agg(c_custkey::VARCHAR, ',' ORDER BY c_custkey) AS keys FROM customer GROUP BY 1) c ON n_nationkey = c_nationkey
LEFT JOIN (SELECT s_nationkey, count(*) AS n, string_agg(s_suppkey::VARCHAR, ',' ORDER BY s_suppkey) AS keys FROM supplier GROUP BY 1) s ON n_nationkey = s_nationkey""")
def r2_nested_children(read):
    customers, suppliers = read("customer").select("c_custkey", "c_nationkey", "c_name"), read("supplier").select("s_suppkey", "s_nationkey", "s_name")
    held = reads.nested(read("nation"), "n_nationkey", customers=(customers, "c_nationkey"), suppliers=(suppliers, "s_nationkey"))

    def keys(name: str, key: str):
        return F.array_join(F.transform(name, lambda x: x[key].cast("string")), ",")

    return held.select("n_nationkey", "n_name", F.size("customers").cast("long").alias("n_customers"), keys("customers", "c_custkey").alias("customers"), F.size("suppliers").cast("long").alias("n_suppliers"), keys("suppliers", "s_suppkey").alias("suppliers"))


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 33 LIMIT 1")
def r3_point_lookup(read):
    return reads.lookup(read("orders"), "o_orderkey", PROJECT).select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT c_custkey, c_name, n_nationkey, n_name, n_regionkey FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def r4_child_with_parent(read):
    return reads.with_parent(read("customer"), "c_nationkey", read("nation"), "n_nationkey").select("c_custkey", "c_name", "parent.*")


@query("SELECT s_suppkey, s_name, n_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey = 7")
def r5_asset_with_parent(read):
    held = reads.with_parent(read("supplier"), "s_nationkey", read("nation"), "n_nationkey")
    return held.where("s_suppkey = 7").select("s_suppkey", "s_name", "parent.n_name")


@query("SELECT * FROM lineitem WHERE l_orderkey = 33")
def r6_list_files(read):
    return reads.children(read("lineitem"), "l_orderkey", PROJECT)


@query("SELECT * FROM supplier WHERE s_nationkey = 5")
def r7_list_assets(read):
    return reads.children(read("supplier"), "s_nationkey", 5)


@query("SELECT * FROM lineitem WHERE l_orderkey = 33 AND l_linenumber <> 1")
def r8_except_active(read):
    return reads.children_except(read("lineitem"), "l_orderkey", PROJECT, "l_linenumber", 1)


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey = 37)")
def r9_owner_semi(read):
    return reads.owned(read("lineitem"), "l_orderkey", read("orders"), "o_orderkey", "o_custkey", OWNER).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@query("""
SELECT event_id, user_id, wanted, CASE WHEN o_orderkey IS NULL THEN 'not_found' WHEN o_custkey = user_id THEN 'ok' ELSE 'forbidden' END AS status
FROM (SELECT event_id, user_id, event_id * 3 AS wanted FROM events) LEFT JOIN orders ON o_orderkey = wanted""")
def r10_outcome(read):
    requests = read("events").select("event_id", "user_id", (F.col("event_id") * 3).alias("wanted"))
    return reads.outcome(requests, "wanted", "user_id", read("orders"), "o_orderkey", "o_custkey")


@query("""
SELECT event_id, user_id FROM events e WHERE EXISTS (SELECT 1 FROM customer c WHERE c_custkey = e.user_id AND TIMESTAMP '2024-01-01' + to_hours(c_custkey * 5) > e.ts)""")
def r11_session_gate(read):
    sessions = read("customer").select(F.col("c_custkey").alias("holder"), F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(0, c_custkey * 5)").alias("expires_at"))
    return reads.with_session(read("events"), "user_id", "ts", sessions, "holder", "expires_at").select("event_id", "user_id")


# ---- writes


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT 100 + r_regionkey, r_name, 0 FROM region")
def w1_insert(read):
    rows = read("region").select((F.col("r_regionkey") + 100).alias("n_nationkey"), F.col("r_name").alias("n_name"))
    return writes.insert(read("nation"), rows, n_regionkey=F.lit(0))


@query(r"""
SELECT o_orderkey AS project_id, 'main.tex' AS file_name, 'tex' AS file_type, '\documentclass{article}' || chr(10) || '\begin{document}' || chr(10) || 'Hello World' || chr(10) || '\end{document}' AS content
FROM orders WHERE o_orderstatus = 'P'""")
def w2_first_files(read):
    return writes.first_files(read("orders").where("o_orderstatus = 'P'"), "o_orderkey")


@query("SELECT p_partkey, p_name, p_brand FROM part UNION ALL SELECT 1000000 + s_suppkey, s_name, 'tex' FROM supplier")
def w3_insert_file(read):
    rows = read("supplier").select((F.col("s_suppkey") + 1_000_000).alias("p_partkey"), F.col("s_name").alias("p_name"), F.lit(None).cast("string").alias("p_brand"))
    return writes.insert(read("part").select("p_partkey", "p_name", "p_brand"), rows, p_brand=F.lit("tex"))


@query("SELECT s_suppkey, s_name, '/uploads/' || s_nationkey || '/' || s_name AS asset_url FROM supplier")
def w4_asset_url(read):
    return read("supplier").select("s_suppkey", "s_name", t.asset_url(F.col("s_nationkey").cast("string"), F.col("s_name")).alias("asset_url"))


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey = 33 THEN 'edited' ELSE o_orderpriority END AS o_orderpriority, CASE WHEN o_orderkey = 33 THEN TIMESTAMP '2030-01-01' ELSE o_orderdate END AS o_orderdate FROM orders""")
def w5_update(read):
    out = writes.update(read("orders"), F.col("o_orderkey") == PROJECT, o_orderpriority=F.lit("edited"), o_orderdate=F.expr("timestamp_ntz'2030-01-01'"))
    return out.select("o_orderkey", "o_orderpriority", "o_orderdate")


@query("SELECT p_partkey, CASE WHEN p_partkey = 12 THEN 'renamed' ELSE p_name END AS p_name FROM part")
def w6_rename(read):
    return writes.update(read("part").select("p_partkey", "p_name"), F.col("p_partkey") == 12, p_name=F.lit("renamed"))


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 AND o_orderkey % 2 = 0 THEN '' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 7 = 0 AND o_orderkey % 3 = 0 THEN 'new' ELSE o_orderpriority END AS o_orderpriority,
CASE WHEN o_orderkey % 7 = 0 THEN TIMESTAMP '2030-01-01' ELSE o_orderdate END AS o_orderdate FROM orders""")
def w7_patch(read):
    orders = read("orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_orderdate")
    changes = orders.where("o_orderkey % 7 = 0").select("o_orderkey", F.expr("CASE WHEN o_orderkey % 2 = 0 THEN '' END").alias("o_orderstatus"), F.expr("CASE WHEN o_orderkey % 3 = 0 THEN 'new' END").alias("o_orderpriority"))
    return writes.patch(orders, changes, "o_orderkey", "o_orderstatus", "o_orderpriority", touched="o_orderdate", now=F.expr("timestamp_ntz'2030-01-01'"))


@query("""
SELECT 'nation' AS tab, n_nationkey::BIGINT AS id FROM nation WHERE n_regionkey <> 2 UNION ALL
SELECT 'customer', c_custkey FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2) UNION ALL
SELECT 'supplier', s_suppkey FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)""")
def w8_cascade_delete(read):
    nation = read("nation")
    kept = writes.cascade(nation, "n_nationkey", nation.where("n_regionkey = 2"), (read("customer"), "c_nationkey"), (read("supplier"), "s_nationkey"))
    parts = [df.select(F.lit(name).alias("tab"), F.col(key).cast("long").alias("id")) for df, name, key in zip(kept, ("nation", "customer", "supplier"), ("n_nationkey", "c_custkey", "s_suppkey"), strict=True)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("SELECT * FROM supplier WHERE s_suppkey <> 9")
def w9_delete(read):
    return writes.delete(read("supplier"), F.col("s_suppkey") == 9)


@query("SELECT c_custkey, 'changed' AS c_mktsegment FROM customer WHERE c_nationkey = 4")
def w_returning(read):
    return writes.returning(read("customer").select("c_custkey", "c_nationkey", "c_mktsegment"), F.col("c_nationkey") == 4, c_mktsegment=F.lit("changed")).drop("c_nationkey")


# ---- checks


@query("""
SELECT doc_id, length(text) BETWEEN 1 AND 100 AND length(source) <= 500 AS project_ok, length(lang || source) BETWEEN 1 AND 255 AS file_ok, length(source) >= 1 AND doc_id % 3 < 2 AS asset_ok, length(text) > 0 AS source_ok,
length(source) >= 8 AS password_ok, doc_id % 2 = 0 AS uuid_ok, CASE WHEN doc_id % 3 = 0 THEN 'tex' ELSE lang END AS kind, CASE WHEN doc_id % 4 = 0 THEN '' ELSE source END AS content, CASE WHEN doc_id % 5 = 0 THEN 'qwen-qwq-32b' ELSE lang END AS model FROM documents""")
def v_checks(read):
    text, lang, source = F.col("text"), F.col("lang"), F.col("source")
    # a hash in the form of an identifier, with a wrong digit in every other row
    uuid = F.expr(r"regexp_replace(md5(cast(text AS binary)), '^(.{8})(.{4}).(.{3}).(.{3})(.{12})$', concat('$1-$2-', if(doc_id % 2 = 0, '4', '0'), '$3-a$4-$5'))")
    fields = v.with_defaults(source, F.expr("CASE WHEN doc_id % 3 <> 0 THEN lang END"), F.expr("CASE WHEN doc_id % 4 <> 0 THEN source END"))
    return read("documents").select(
        "doc_id", v.project_ok(text, source).alias("project_ok"), v.file_name_ok(F.concat(lang, source)).alias("file_ok"), v.asset_ok(source, F.expr("CASE doc_id % 3 WHEN 0 THEN 'image' WHEN 1 THEN 'file' ELSE lang END")).alias("asset_ok"), v.source_ok(text).alias("source_ok"),
        v.password_ok(source).alias("password_ok"), v.is_uuid(uuid).alias("uuid_ok"), fields["type"].alias("kind"), fields["content"].alias("content"), v.model_or_default(F.expr("CASE WHEN doc_id % 5 <> 0 THEN lang END")).alias("model"),
    )


@query("SELECT conv_id, bool_and(role IN ('system', 'user', 'assistant')) AND count(*) >= 1 AS ok FROM conversations GROUP BY conv_id")
def v6_chat(read):
    return read("conversations").groupBy("conv_id").agg(v.chat_ok(F.collect_list("role"), F.lit("key")).alias("ok"))


# ---- collections


@query("""
SELECT conv_id, coalesce(min_by(text, turn) FILTER (role = 'assistant'), min_by(text, turn)) AS first_text FROM conversations GROUP BY conv_id""")
def l1_first_match(read):
    held = read("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    return held.select("conv_id", c.first_of(F.col("m"), lambda x: x["role"] == "assistant")["text"].alias("first_text"))


@query("""
SELECT conv_id, string_agg(CASE WHEN turn = 1 THEN 'edited' ELSE role END, ',' ORDER BY turn) AS changed, coalesce(string_agg(role, ',' ORDER BY turn) FILTER (turn <> 1), '') AS dropped,
string_agg(role, ',' ORDER BY turn) || ',user,assistant' AS added FROM conversations GROUP BY conv_id""")
def l2_l3_l4_lists(read):
    held = read("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("m"))
    m = F.col("m")

    def roles(items):
        return F.array_join(F.transform(items, lambda x: x["role"]), ",")

    more = [F.struct(F.lit(0).cast("long").alias("turn"), F.lit(r).alias("role")) for r in ("user", "assistant")]
    return held.select("conv_id", roles(c.replaced(m, lambda x: x["turn"] == 1, lambda x: F.struct(x["turn"].alias("turn"), F.lit("edited").alias("role")))).alias("changed"), roles(c.removed(m, lambda x: x["turn"] == 1)).alias("dropped"), roles(c.appended(m, *more)).alias("added"))


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations WHERE role <> 'system') WHERE n <= 3")
def l5_last_3(read):
    return c.last_n(read("conversations"), "conv_id", "turn", 3, F.col("role") != "system").select("conv_id", "turn", "role")


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 10")
def l5_last_10(read):
    return c.last_n(read("conversations"), "conv_id", "turn", 10).select("conv_id", "turn", "role")


@query("""
SELECT conv_id, string_agg(turn::VARCHAR, ',' ORDER BY CASE WHEN turn % 3 = 0 THEN 9 - turn ELSE turn END, turn) AS turns FROM conversations GROUP BY conv_id""")
def l6_reply_order(read):
    item = F.struct(F.when(F.col("turn") % 3 == 0, 9 - F.col("turn")).alias("reply"), F.col("turn").alias("task"))
    held = read("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(item)).alias("m"))
    return held.select("conv_id", F.array_join(F.transform(c.by_reply_order(F.col("m"), "reply", "task"), lambda x: x["task"].cast("string")), ",").alias("turns"))


@query("""
SELECT doc_id, concat_ws(chr(10), nullif(lang, 'en'), CASE WHEN doc_id % 2 = 0 THEN source END) AS kept, least(doc_id % 4, 3)::BIGINT AS n, ['a', 'b', 'c'][(doc_id % 3 + 1)::INTEGER] AS turn, lang IN ('en', 'fr') AS known FROM documents""")
def l7_l13_lists(read):
    items = F.array(F.when(F.col("lang") == "en", "").otherwise(F.col("lang")), F.when(F.col("doc_id") % 2 == 0, F.col("source")))
    return read("documents").select(
        "doc_id", c.joined_lines(c.truthy(items)).alias("kept"), F.size(c.numbered((F.col("doc_id") % 4).cast("int"))).cast("long").alias("n"), c.in_turn(F.col("doc_id"), ["a", "b", "c"]).alias("turn"), c.any_of(F.array("lang"), ["en", "fr"]).alias("known")
    )


# ---- text

TRIM = r"regexp_replace(regexp_replace({0}, '\A[\t\n\x0B\f\r \x{{A0}}]+', ''), '[\t\n\x0B\f\r \x{{A0}}]+\z', '')"
PREPROCESS = TRIM.format(r"regexp_replace(regexp_replace(regexp_replace(text, '%[^\n\r]*', '', 'g'), '[ \t]+', ' ', 'g'), '\n[\t\n\x0B\f\r \x{A0}]*\n', chr(10) || chr(10), 'g')")


@query("SELECT doc_id, ceil(length(text) / 4.0)::BIGINT AS tokens FROM documents")
def t1_tokens(read):
    return read("documents").select("doc_id", t.token_estimate(F.col("text")).alias("tokens"))


@query(rf"SELECT doc_id, md5(regexp_replace(text, '%[^\n\r]*', '', 'g')) AS stripped, md5(regexp_replace(text, '[ \t]+', ' ', 'g')) AS squeezed, md5({PREPROCESS}) AS processed FROM documents")
def t2_t6_preprocess(read):
    x = F.col("text")
    return read("documents").select("doc_id", *[F.md5(f(x).cast("binary")).alias(n) for n, f in (("stripped", t.strip_comments), ("squeezed", t.squeeze_blanks), ("processed", t.preprocess))])


REPLY_SQL = """
(SELECT doc_id, text, CASE doc_id % 5 WHEN 0 THEN 'CHUNK_ID: ' || doc_id || chr(10) || 'UPDATED_LATEX:' || chr(10) || '```latex' || chr(10) || ' ' || source || chr(10) || '```' || chr(10) || 'CHANGES_SUMMARY: - ' || lang
 WHEN 1 THEN 'CHANGES_SUMMARY: No Changes needed' WHEN 2 THEN '```' || chr(10) || lang || '``` ```latex' || chr(10) || 'b```' WHEN 3 THEN 'chunk_id: 4 CHUNK_ID:x ```python' || chr(10) || 'q```' ELSE source END AS reply FROM documents)"""


def replies(read) -> DataFrame:
    return read("documents").selectExpr(
        "doc_id", "text", "source",
        r"""CASE doc_id % 5 WHEN 0 THEN 'CHUNK_ID: ' || doc_id || '\nUPDATED_LATEX:\n```latex\n ' || source || '\n```\nCHANGES_SUMMARY: - ' || lang WHEN 1 THEN 'CHANGES_SUMMARY: No Changes needed'
        WHEN 2 THEN '```\n' || lang || '``` ```latex\nb```' WHEN 3 THEN 'chunk_id: 4 CHUNK_ID:x ```python\nq```' ELSE source END AS reply""",
    )


@query(rf"""
SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN trim(regexp_extract(reply, '```latex\n ([^\n]*)', 1)) WHEN 2 THEN regexp_extract(reply, '```\n([a-z]*)', 1) END AS code, CASE WHEN doc_id % 5 = 0 THEN doc_id::INTEGER END AS chunk,
CASE doc_id % 5 WHEN 0 THEN '- ' || split_part(reply, '- ', -1) WHEN 1 THEN 'No Changes needed' END AS summary, CASE WHEN doc_id % 5 <= 1 THEN doc_id % 5 = 1 END AS unchanged FROM {REPLY_SQL}""")
def t7_t13_replies(read):
    r = F.col("reply")
    return replies(read).select("doc_id", t.updated_block(r).alias("code"), t.chunk_id(r).alias("chunk"), t.changes_summary(r).alias("summary"), t.says_no_change(t.changes_summary(r)).alias("unchanged"))


@query(r"""
SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN 'x [CODE BLOCK TRUNCATED FOR CONTEXT] ' || text ELSE 'x ```latex' || chr(10) || 'y``` ' || text END AS code, 'User request: ' || text AS prompt FROM conversations""")
def t11_t12_hidden(read):
    rows = read("conversations").select("conv_id", "turn", "role", "text", F.concat(F.lit("x ```latex\ny``` "), "text").alias("with_code"))
    prompt = t.document_prompt(F.col("role"), F.col("text"))
    return rows.select("conv_id", "turn", t.hide_code(F.col("with_code"), F.col("role") == "assistant").alias("code"), t.hide_document(prompt).alias("prompt"))


@query("""
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 0 ELSE ceil((event_id % 100) / 10.0)::BIGINT END AS wait, event_id % 4 = 0 AS limited, coalesce(nullif(json_extract_string(props, '$.k'), ''), 'none') AS k, 'none' AS missing FROM events""")
def t14_t16_errors(read):
    message = F.expr("CASE WHEN event_id % 3 = 0 THEN 'limit' ELSE concat('Please Try again in ', cast(event_id % 100 / 10.0 AS decimal(10, 1)), 's') END")
    limit = F.expr("CASE WHEN event_id % 4 = 0 THEN 'max_tokens must be less than or equal to 8' ELSE 'max_tokens' END")
    return read("events").select("event_id", t.retry_after(message).alias("wait"), t.is_token_limit(limit).alias("limited"), t.json_or(F.col("props"), "$.k", F.lit("none")).alias("k"), t.json_or(F.col("props"), "$.none", F.lit("none")).alias("missing"))


@query(r"""
SELECT page_id, CASE WHEN name LIKE '%.tex' THEN 'tex' ELSE coalesce(nullif(split_part(name, '.', -1), ''), 'txt') END AS kind, CASE WHEN name = '' THEN 'document' WHEN strpos(name, '.tex') > 0 THEN coalesce(nullif(substr(name, 1, strpos(name, '.tex') - 1) || substr(name, strpos(name, '.tex') + 4), ''), 'document') ELSE name END || '.pdf' AS download,
CASE WHEN name LIKE '%.tex' THEN name ELSE name || '.tex' END AS suffixed
FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'p' || page_id || '.tex' WHEN 1 THEN url WHEN 2 THEN 'x.' ELSE 'README' END AS name FROM pages)""")
def t17_t18_names(read):
    rows = read("pages").selectExpr("page_id", "CASE page_id % 4 WHEN 0 THEN 'p' || page_id || '.tex' WHEN 1 THEN url WHEN 2 THEN 'x.' ELSE 'README' END AS name")
    n = F.col("name")
    return rows.select("page_id", t.file_type(n).alias("kind"), t.download_name(n).alias("download"), t.with_suffix(n).alias("suffixed"))


@query("""
SELECT doc_id, base64(encode(text)) AS coded, text AS back, 'aGk=' AS content, CASE WHEN lang = 'en' THEN 'image' ELSE 'file' END AS kind FROM documents""")
def t19_t21_base64(read):
    coded = t.encoded(F.col("text"))
    url = F.concat(F.when(F.col("lang") == "en", "data:image/png;base64,").otherwise("data:application/pdf;base64,"), F.lit("aGk="))
    mime = F.when(F.col("lang") == "en", "image/png").otherwise("application/pdf")
    return read("documents").select("doc_id", coded.alias("coded"), t.decoded(coded).cast("string").alias("back"), t.data_url_content(url).alias("content"), t.asset_kind(mime).alias("kind"))


@query("SELECT doc_id, doc_id % 6 IN (0, 2, 4) AS inside FROM documents")
def t20_paths(read):
    path = F.expr("element_at(array('a/b.tex', '../x', './a/../b', '/etc/x', 'a/./b/../c', 'a/../../b'), cast(doc_id % 6 + 1 AS int))")
    return read("documents").select("doc_id", t.inside(path).alias("inside"))


@query(r"""
SELECT page_id, route, CASE WHEN page_id % 2 = 0 AND route = 'public' THEN '/dashboard' WHEN page_id % 2 = 1 AND route = 'private' THEN '/login' ELSE 'next' END AS decision
FROM (SELECT page_id, CASE WHEN path LIKE '/api/auth%' THEN 'auth' WHEN path LIKE '/\_next%' ESCAPE '\' OR path LIKE '/api/trpc%' OR path LIKE '/api/upload%' OR path LIKE '/uploads%' OR regexp_matches(path, '\.(ico|svg|png|jpg|jpeg|gif|webp|css|js)$') THEN 'open' WHEN path IN ('/login', '/register') THEN 'public' ELSE 'private' END AS route
FROM (SELECT page_id, CASE page_id % 6 WHEN 0 THEN '/login' WHEN 1 THEN '/api/auth/x' WHEN 2 THEN '/_next/y' WHEN 3 THEN '/img/' || page_id || '.png' WHEN 4 THEN '/api/trpc/z' ELSE regexp_extract(url, '^[a-z]+://[^/]+(.*)$', 1) END AS path FROM pages))""")
def t25_t26_routes(read):
    path = F.expr(r"CASE page_id % 6 WHEN 0 THEN '/login' WHEN 1 THEN '/api/auth/x' WHEN 2 THEN '/_next/y' WHEN 3 THEN '/img/' || page_id || '.png' WHEN 4 THEN '/api/trpc/z' ELSE regexp_extract(url, '^[a-z]+://[^/]+(.*)$', 1) END")
    rows = read("pages").select("page_id", t.route_class(path).alias("route"))
    return rows.select("page_id", "route", t.route_decision(F.col("route"), F.col("page_id") % 2 == 0).alias("decision"))


@query("SELECT event_id, strftime(ts, '%b %-d, %Y, %I:%M %p') AS shown, substr(event_type || props, 1, 15) AS start FROM events")
def t23_t28_shown(read):
    return read("events").select("event_id", t.shown_date(F.col("ts")).alias("shown"), t.header_start(F.concat("event_type", "props")).alias("start"))


@query("""
SELECT doc_id, md5('CHUNK_ID: 1' || chr(10) || 'TOTAL_CHUNKS: 3' || chr(10) || chr(10) || 'Here is body chunk 1 of 3:' || chr(10) || chr(10) || '```latex' || chr(10) || text || chr(10) || '```' || chr(10) || chr(10) || 'User editing instruction: ' || lang) AS prompt,
'✅ Agent 1 (a): completed' || chr(10) || '⏳ Agent 2 (b): ' || lang || chr(10) || '⏳ Agent 3 (a): ' || source AS lines FROM documents""")
def t29_t30_prompts(read):
    prompt = t.chunk_prompt(F.lit(1), F.lit(3), F.col("text"), F.col("lang"))
    return read("documents").select("doc_id", F.md5(prompt.cast("binary")).alias("prompt"), t.worker_lines(F.array(F.lit("completed"), "lang", "source"), ["a", "b"]).alias("lines"))


def lexer_sql() -> str:
    """Tokens one after the other, for each document: the rest of a line against all rules of the state at once.

    DuckDB's patterns can't look behind, so names of environments are found by what comes before the place. Runs of plain
    characters in formulas, which are tokens each, are taken at once and dealt out at the end.
    """
    end = r"\n\r\x{2028}\x{2029}"
    matches, kinds = [], []
    for state, rules in RULES.items():
        kept = [r for r in rules if not r[0].startswith("(?<=")]
        groups = []
        for pattern, _, _ in kept:
            found = re.sub(r"\\.|\[(?:\\.|[^\]\\])*\]|\.|\((?!\?)", lambda m: {".": f"[^{end}]", "(": "(?:"}.get(m[0], m[0]), pattern)
            groups.append(rf"((?:[^\\{{}}()\[\]_^\-+*/=<>$%{end}]+)|[^{end}])" if pattern == "." else f"({found})")
        whole = f"^(?s:(.*?))(?:{'|'.join(groups)})"
        names = ["skip", *(f"{state}{k}" for k in range(len(kept)))]
        matches.append(f"CASE WHEN state = '{state}' THEN regexp_extract(rest, '{whole}', {names}) END AS {state}")
        for k, (pattern, kind, to) in enumerate(kept):
            hit = f"{state}.{state}{k} <> ''"
            kinds.append(f"WHEN {hit} THEN {{'skip': {state}.skip, 'found': {state}.{state}{k}, 'kind': '{kind}', 'each': {'true' if pattern == '.' else 'false'}, 'next': '{'root' if to == 'pop' else to or state}'}}")
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, string_split('\\section{{' || lang || '}} $x_1 + ' || doc_id || '$ % ' || source || chr(10) || replace(text, '|', '$'), chr(10)) AS lines FROM documents),
t AS (SELECT doc_id, 0::BIGINT AS line, 0::BIGINT AS pos, 'root' AS state, NULL::BIGINT AS a, NULL::BIGINT AS b, NULL::VARCHAR AS kind, false AS each FROM d UNION ALL
  SELECT doc_id, CASE WHEN m IS NULL THEN line + 1 ELSE line END, CASE WHEN m IS NULL THEN 0 ELSE pos + length(m.skip) + length(m.found) END, coalesce(m.next, state), pos + length(m.skip), pos + length(m.skip) + length(m.found), m.kind, coalesce(m.each, false)
  FROM (SELECT *, CASE WHEN named <> '' THEN {{'skip': '', 'found': named, 'kind': 'type.environment', 'each': false, 'next': 'root'}} {' '.join(kinds)} END AS m
    FROM (SELECT *, {', '.join(matches)}, CASE WHEN state = 'root' AND regexp_matches(front, '\\\\(begin|end)\\{{$') AND regexp_matches(rest, '^[a-zA-Z0-9*]+\\}}') THEN regexp_extract(rest, '^[a-zA-Z0-9*]+') ELSE '' END AS named
      FROM (SELECT t.doc_id, t.line, t.pos, t.state, substr(lines[t.line + 1], t.pos + 1) AS rest, substr(lines[t.line + 1], 1, t.pos) AS front FROM t JOIN d USING (doc_id) WHERE t.line < len(lines)))))
SELECT doc_id, line::INTEGER AS line, a::INTEGER AS start, b::INTEGER AS "end", kind FROM t WHERE kind IS NOT NULL AND NOT each UNION ALL
SELECT doc_id, line::INTEGER, k::INTEGER, (k + 1)::INTEGER, kind FROM (SELECT doc_id, line, kind, unnest(range(a, b)) AS k FROM t WHERE each)"""


@query(lexer_sql())
def t31_tokens(read):
    """All tokens of all documents with their places, behind a first line that has a command, a formula and a comment."""
    code = F.concat(F.lit("\\section{"), "lang", F.lit("} $x_1 + "), F.col("doc_id").cast("string"), F.lit("$ % "), "source", F.lit("\n"), F.regexp_replace("text", r"\|", "\\$"))
    return tokenised(read("documents").select("doc_id", code.alias("code")), "doc_id", "code")


# ---- splitting

#: Texts with an opening line, environments and blank lines, composed of the documents' lines.
LATEX = [
    "doc_id",
    r"""array_join(concat(CASE WHEN doc_id % 3 = 0 THEN array('\\documentclass{article}', '\\begin{document}') ELSE array() END,
transform(split(text, '\n', -1), (l, i) -> CASE WHEN (i + doc_id) % 11 = 3 THEN concat('\\begin{figure}', l) WHEN (i + doc_id) % 11 = 6 THEN concat(l, '\\end{figure}') WHEN (i + doc_id) % 17 = 2 THEN '\\begin{itemize}\\end{itemize}' WHEN (i + doc_id) % 23 = 5 THEN '\\end{table*}' WHEN (i + doc_id) % 29 = 7 THEN '\\begin{center}' ELSE l END)), '\n') AS code""",
]

LINES_SQL = r"""
WITH raw AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
numbered AS (SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) - 1 AS i FROM raw),
made AS (SELECT doc_id, i, CASE WHEN (i + doc_id) % 11 = 3 THEN '\begin{figure}' || x WHEN (i + doc_id) % 11 = 6 THEN x || '\end{figure}' WHEN (i + doc_id) % 17 = 2 THEN '\begin{itemize}\end{itemize}' WHEN (i + doc_id) % 23 = 5 THEN '\end{table*}' WHEN (i + doc_id) % 29 = 7 THEN '\begin{center}' ELSE x END AS line FROM numbered),
"""


def counted_files(files: dict[str, str], limit: int) -> tuple[bytes | None, str, str, str | None]:
    """In place of a compiler."""
    if "main.tex" not in files:
        raise ValueError("no main file")
    return f"%PDF {len(files)}".encode(), f"files: {len(files)}", "", None


def latex(read) -> DataFrame:
    docs = read("documents")
    return docs.selectExpr(*LATEX)


@query("""
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 0 END::INTEGER AS preamble_lines, len(string_split(text, chr(10)))::INTEGER AS body_lines FROM documents""")
def d1_d2_parts(read):
    held = splitter.parts(latex(read), "doc_id", "code")
    return held.select("doc_id", F.when(F.col("preamble") == "", 0).otherwise(F.size(splitter.lines(F.col("preamble")))).alias("preamble_lines"), F.size("body").alias("body_lines"))


@query(LINES_SQL + r"""
moves AS (SELECT doc_id, i, (regexp_extract(line, '\\begin\{([^}]+)\}', 1) = 'figure')::INTEGER - (regexp_extract(line, '\\end\{([^}]+)\}', 1) = 'figure')::INTEGER AS d,
  (regexp_extract(line, '\\begin\{([^}]+)\}', 1) = 'itemize')::INTEGER - (regexp_extract(line, '\\end\{([^}]+)\}', 1) = 'itemize')::INTEGER AS e FROM made),
sums AS (SELECT doc_id, i, sum(d) OVER w AS s, sum(e) OVER w AS r FROM moves WINDOW w AS (PARTITION BY doc_id ORDER BY i))
SELECT doc_id, i::INTEGER AS i, s - least(0, min(s) OVER w) = 0 AND r - least(0, min(r) OVER w) = 0 AS safe FROM sums WINDOW w AS (PARTITION BY doc_id ORDER BY i)""")
def d4_d5_safe_lines(read):
    return splitter.safe_lines(splitter.parts(latex(read), "doc_id", "code"), "doc_id")


#: The same bodies with their safe lines, cut one chunk after the other, and the chunks that aren't blank. Only figures and itemizes are ever open in them.
CHUNKS_SQL = LINES_SQL.replace("WITH raw", "WITH RECURSIVE raw") + r"""
moves AS (SELECT doc_id, i, line, (regexp_extract(line, '\\begin\{([^}]+)\}', 1) = 'figure')::INTEGER - (regexp_extract(line, '\\end\{([^}]+)\}', 1) = 'figure')::INTEGER AS d,
  (regexp_extract(line, '\\begin\{([^}]+)\}', 1) = 'itemize')::INTEGER - (regexp_extract(line, '\\end\{([^}]+)\}', 1) = 'itemize')::INTEGER AS e FROM made),
sums AS (SELECT doc_id, i, line, sum(d) OVER w AS s, sum(e) OVER w AS r FROM moves WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
judged AS (SELECT doc_id, i, line, s - least(0, min(s) OVER w) = 0 AND r - least(0, min(r) OVER w) = 0 AS safe FROM sums WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
body AS (SELECT doc_id, count(*) AS n, list(line ORDER BY i) AS lines, list(i ORDER BY i) FILTER (WHERE safe) AS safe FROM judged GROUP BY doc_id),
cut AS (SELECT doc_id, 0 AS k, 0::BIGINT AS last, NULL::BIGINT AS best FROM body WHERE n >= 12 UNION ALL
  SELECT doc_id, k + 1, best + 1, best FROM (SELECT doc_id, k, greatest(coalesce(list_sort(list_transform(list_filter(safe, lambda s: s > last), lambda s: {'d': abs(s - last - ceil(n / 6.0)), 's': s}))[1].s, last + ceil(n / 6.0)::BIGINT), last + 1) AS best FROM cut JOIN body USING (doc_id) WHERE k < 5 AND last < n)),
ends AS (SELECT doc_id, list(best ORDER BY k) AS ends FROM cut WHERE k > 0 GROUP BY doc_id),
bounds AS (SELECT doc_id, n, lines, list_concat([-1], coalesce(ends, []), [n - 1]) AS b FROM body LEFT JOIN ends USING (doc_id)),
pieces AS (SELECT doc_id, n, list_transform(range(1, len(b)), lambda k: array_to_string(list_slice(lines, b[k] + 2, b[k + 1] + 1), chr(10))) AS c FROM bounds),
chunked AS (SELECT doc_id, CASE WHEN n < 12 THEN c ELSE list_filter(c, lambda x: regexp_matches(x, '[^ \t\n\r]')) END AS chunks FROM pieces)
"""


@query(CHUNKS_SQL + r"SELECT doc_id, len(chunks)::INTEGER AS n_chunks, md5(array_to_string(chunks, '<cut>')) AS chunks_md5, CASE WHEN doc_id % 3 = 0 THEN 40 ELSE 0 END AS preamble_chars FROM chunked")
def d7_d8_chunks(read):
    held = splitter.split(latex(read), "doc_id", "code", 6)
    return held.select("doc_id", F.size("chunks").alias("n_chunks"), F.md5(F.array_join("chunks", "<cut>").cast("binary")).alias("chunks_md5"), F.length("preamble").alias("preamble_chars"))


# the documents as they are have no environments, so every line is safe; cuts follow from the number of lines, and blank chunks go
@query(r"""
WITH held AS (SELECT doc_id, string_split(text, chr(10)) AS l, len(string_split(text, chr(10))) AS n FROM documents),
pieces AS (SELECT doc_id, n, list_transform(range(0, 4), lambda k: array_to_string(CASE WHEN k < 3 THEN list_slice(l, k * (ceil(n / 4.0)::BIGINT + 1) + 1, (k + 1) * (ceil(n / 4.0)::BIGINT + 1)) ELSE list_slice(l, 3 * (ceil(n / 4.0)::BIGINT + 1) + 1, n) END, chr(10))) AS c FROM held)
SELECT doc_id, CASE WHEN n < 8 THEN 1 ELSE len(list_filter(c, lambda x: regexp_matches(x, '[^ \t\n\r]'))) END::INTEGER AS n_chunks FROM pieces""")
def d8_plain_counts(read):
    return splitter.split(read("documents"), "doc_id", "text", 4).select("doc_id", F.size("chunks").alias("n_chunks"))


# ---- dataflows


@query(f"SELECT doc_id, CASE WHEN ceil(length({PREPROCESS}) / 4.0) <= 6000 THEN 'single' ELSE 'parallel' END AS route FROM documents")
def p1_route(read):
    return read("documents").select("doc_id", edits.route(t.token_estimate(t.preprocess(F.col("text")))).alias("route"))


@query(CHUNKS_SQL.rstrip().rstrip(",") + r""",
tasks AS (SELECT doc_id, unnest(chunks) AS chunk, generate_subscripts(chunks, 1) AS id, len(chunks) AS total FROM chunked),
taken AS (SELECT doc_id, total, id, CASE WHEN id % 4 = 1 THEN rtrim('edited ' || chunk, ' ' || chr(9) || chr(10) || chr(13)) WHEN id % 4 = 2 THEN CASE WHEN length(chunk) > 500 THEN chunk ELSE 'short' END ELSE chunk END AS text,
  CASE id % 4 WHEN 0 THEN '**Agent ' || id || ':** no change' WHEN 1 THEN '**Agent ' || id || ':** edited' END AS line FROM tasks),
merged AS (SELECT doc_id, max(total) AS total, string_agg(text, chr(10) ORDER BY id) AS body, string_agg(line, chr(10) ORDER BY id) AS said FROM taken GROUP BY doc_id)
SELECT doc_id, md5(CASE WHEN doc_id % 3 = 0 THEN '\documentclass{article}' || chr(10) || '\begin{document}' || chr(10) || body || chr(10) || '\end{document}' || chr(10) ELSE body END) AS merged_md5,
'✅ **Parallel editing complete!**' || chr(10) || chr(10) || '📊 Document: ~7 tokens → ' || total || ' chunks' || chr(10) || '🤖 ' || total || ' agents completed successfully' || chr(10) || chr(10) || '**Changes Summary:**' || CASE WHEN said IS NULL THEN '' ELSE chr(10) || said END AS summary FROM merged""")
def p2_p8_parallel_edit(read):
    """Scatter, replies composed of the chunks, gather, assemble. The replies travel with their tasks, so that documents are split once."""
    tasks = edits.scatter(splitter.split(latex(read), "doc_id", "code", edits.TARGET_CHUNKS), "doc_id", "preamble")
    form = "CASE chunk_id % 4 WHEN 0 THEN 'CHANGES_SUMMARY: no change' WHEN 1 THEN concat('CHUNK_ID: ', chunk_id, '\\nUPDATED_LATEX:\\n```latex\\nedited ', chunk, '\\n```\\nCHANGES_SUMMARY: edited') WHEN 2 THEN '```\\nshort\\n```' END"
    merged = edits.gather(tasks.withColumn("reply", F.expr(form)), "doc_id", "preamble", "total")
    whole = edits.assembled(F.col("preamble"), F.col("chunks"))
    return merged.select("doc_id", F.md5(whole.cast("binary")).alias("merged_md5"), edits.summary(F.lit(7), F.col("total"), F.col("total"), F.col("summaries")).alias("summary"))


@query(rf"""
SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN CASE WHEN length(text) > 500 AND length(source) < length(text) * 0.5 THEN 'chunk' ELSE 'reply' END WHEN 2 THEN CASE WHEN length(text) > 500 THEN 'chunk' ELSE 'reply' END ELSE 'chunk' END AS taken
FROM (SELECT doc_id, text, source FROM documents)""")
def p6_choose(read):
    rows = replies(read).select("doc_id", "text", edits.replied_block(F.col("reply")).alias("found"), t.changes_summary(F.col("reply")).alias("summary"))
    return rows.select("doc_id", F.when(edits.chosen(F.col("text"), F.col("found"), F.col("summary")) == F.col("text"), "chunk").otherwise("reply").alias("taken"))


@query("""
SELECT doc_id, md5(CASE WHEN doc_id % 2 = 0 THEN '\\begin{document}' || chr(10) ELSE '' END || text || chr(10) || lang || CASE WHEN doc_id % 2 = 0 THEN chr(10) || '\\end{document}' || chr(10) ELSE '' END) AS whole FROM documents""".replace("\\\\", "\\"))
def p7_assemble(read):
    preamble = F.when(F.col("doc_id") % 2 == 0, "\\begin{document}").otherwise("")
    return read("documents").select("doc_id", F.md5(edits.assembled(preamble, F.array("text", "lang")).cast("binary")).alias("whole"))


@query("""
SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN '[CODE BLOCK TRUNCATED FOR CONTEXT]' ELSE '```latex' || chr(10) || '```' END || text AS content
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations WHERE turn % 5 <> 4) WHERE n <= 4""")
def p9_history(read):
    rows = read("conversations").select("conv_id", "turn", "role", F.concat(F.lit("```latex\n```"), "text").alias("raw"))
    return edits.history(rows, "conv_id", "turn", F.col("role"), F.col("raw"), F.col("turn") % 5 == 4, F.lit(True), 4).select("conv_id", "turn", "content")


@query("""
SELECT o_custkey, name, data FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, name ORDER BY rank DESC, data DESC) AS n FROM (
SELECT DISTINCT o_custkey, 'main.tex' AS name, 'text' AS data, 0 AS rank FROM orders UNION ALL SELECT o_custkey, o_orderstatus || '.png', o_orderpriority, 1 FROM orders UNION ALL
SELECT o_custkey, CASE WHEN o_orderkey % 9 = 0 THEN 'main.tex' ELSE o_orderstatus || '.png' END, 'file' || o_orderkey, 2 FROM orders WHERE o_orderkey % 3 = 0)) WHERE n = 1""")
def p10_manifest(read):
    orders = read("orders")
    main = orders.select("o_custkey", F.lit("main.tex").alias("name"), F.lit("text").alias("data")).distinct()
    images = orders.select("o_custkey", F.concat("o_orderstatus", F.lit(".png")).alias("name"), F.col("o_orderpriority").alias("data"))
    files = orders.where("o_orderkey % 3 = 0").select("o_custkey", F.expr("CASE WHEN o_orderkey % 9 = 0 THEN 'main.tex' ELSE concat(o_orderstatus, '.png') END").alias("name"), F.concat(F.lit("file"), "o_orderkey").alias("data"))
    return compiling.manifest(main, images, files, "o_custkey", "name", "data")


@query("""
SELECT doc_id, pdf, CASE WHEN message IS NULL THEN concat_ws(chr(10), nullif(out, ''), err) ELSE coalesce(nullif(concat_ws(chr(10), nullif(out, ''), err, nullif(message, '')), ''), 'Unknown compilation error') END AS logs, message IS NULL OR pdf IS NOT NULL AS success, message IS NOT NULL AND pdf IS NULL AS failed
FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'pdf' END AS pdf, CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang END AS out, CASE WHEN doc_id % 5 = 0 THEN source END AS err, CASE doc_id % 7 WHEN 0 THEN 'broken' WHEN 1 THEN '' END AS message FROM documents)""")
def p12_p13_outcome(read):
    rows = read("documents").selectExpr("doc_id", "CASE WHEN doc_id % 2 = 0 THEN 'pdf' END AS pdf", "CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang END AS out", "CASE WHEN doc_id % 5 = 0 THEN source END AS err", "CASE doc_id % 7 WHEN 0 THEN 'broken' WHEN 1 THEN '' END AS message")
    rows = rows.select("doc_id", compiling.outcome(F.col("pdf"), F.col("out"), F.col("err"), F.col("message")).alias("o")).select("doc_id", "o.*")
    return rows.withColumn("failed", compiling.failed(F.col("success"), F.col("pdf")))


@query("""
SELECT event_id, CASE WHEN status < 400 THEN 'done' WHEN status = 429 AND attempt <= 3 THEN 'retry' WHEN event_id % 5 = 0 AND attempt = 1 THEN 'fallback' ELSE 'error' END AS action,
CASE WHEN status = 429 AND attempt <= 3 THEN CASE WHEN event_id % 5 = 0 THEN 5 ELSE greatest(event_id % 13, 5) END ELSE 0 END::BIGINT AS wait, CASE WHEN status = 400 AND event_id % 5 = 0 AND attempt = 1 THEN 8192 ELSE 32768 END AS max_tokens
FROM (SELECT event_id, [200, 429, 400][(event_id % 3 + 1)::INTEGER] AS status, event_id % 4 + 1 AS attempt FROM events)""")
def p14_p15_next_step(read):
    rows = read("events").selectExpr(
        "event_id", "element_at(array(200, 429, 400), cast(event_id % 3 + 1 AS int)) AS status", "event_id % 4 + 1 AS attempt",
        """CASE WHEN event_id % 5 = 0 THEN '{"error": {"message": "max_tokens must be less than or equal to 9"}}' ELSE concat('{"error": {"message": "try again in ', event_id % 13, 's"}}') END AS body""",
    )
    return rows.select("event_id", compiling.next_step(F.col("status"), F.col("attempt"), F.col("body")).alias("s")).select("event_id", "s.*")


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '' ELSE event_type END AS content, CASE WHEN event_id % 2 = 0 THEN 'asked' ELSE 'm' END AS model FROM events")
def src6_answers(read):
    """The content and model of recorded answers of a chat service."""
    body = F.expr("""CASE WHEN event_id % 2 = 0 THEN '{}' ELSE concat('{"model": "m", "choices": [{"message": {"content": "', event_type, '"}}]}') END""")
    return read("events").select("event_id", compiling.answer(body, F.lit("asked")).alias("a")).select("event_id", "a.*")


@query("SELECT doc_id, doc_id % 2 = 0 AS written, CASE WHEN doc_id % 2 = 0 THEN octet_length(encode(text))::BIGINT END AS bytes FROM documents")
def snk1_snk2_files(read):
    """What would be written, and what is refused as it would leave the folder."""
    files = read("documents").select("doc_id", F.expr("concat(CASE WHEN doc_id % 2 = 0 THEN 'a/' ELSE '../' END, doc_id)").alias("name"), t.encoded(F.col("text")).alias("data"))
    good = to_write(files, "name", "data").select(F.element_at(F.split("name", "/"), -1).cast("long").alias("doc_id"), F.lit(True).alias("written"), F.octet_length("content").cast("long").alias("bytes"))
    return good.unionByName(refused(files, "name").select("doc_id", F.lit(False).alias("written"), F.lit(None).cast("long").alias("bytes")))


@query("SELECT * FROM supplier WHERE s_suppkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)")
def snk3_deleted(read):
    gone = read("customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("s_suppkey"))
    return without_deleted(read("supplier"), "s_suppkey", gone).select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 7 = 0 THEN '' ELSE base64(encode(s_name)) END AS data FROM supplier")
def src3_src5_snk1_assets(read):
    """Files are decoded and written below a shared folder, then read back for their metadata; some were never written."""
    assets = read("supplier").select("s_suppkey", F.concat("s_nationkey", F.lit("/"), "s_suppkey", F.lit(".txt")).alias("path"), t.encoded(F.col("s_name")).alias("upload"))
    folder = new_folder(assets.sparkSession, "assets")
    write_files(to_write(assets.where("s_suppkey % 7 <> 0"), "path", "upload"), folder).agg(F.sum("bytes")).collect()
    return assets_as_base64(assets.select("s_suppkey", "path"), "path", folder).select("s_suppkey", "data")


@query("""
SELECT c_nationkey, CASE WHEN c_nationkey % 5 <> 0 THEN base64(encode('%PDF ' || n)) END AS pdf, CASE WHEN c_nationkey % 5 = 0 THEN 'no main file' ELSE 'files: ' || n END AS logs, c_nationkey % 5 <> 0 AS success
FROM (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1)""")
def p11_compiled(read):
    """A stand-in for the compiler counts the files and fails where there is no main file."""
    files = read("customer").select("c_nationkey", F.expr("CASE WHEN c_nationkey % 5 <> 0 AND c_custkey = min(c_custkey) OVER (PARTITION BY c_nationkey) THEN 'main.tex' ELSE c_name END").alias("name"), F.col("c_mktsegment").alias("data"))
    rows = compiling.compiled(files, "c_nationkey", "name", "data", counted_files)
    return rows.select("c_nationkey", F.base64("pdf").alias("pdf"), "logs", "success")


# ---- time


@query("""
WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS run FROM g)
SELECT user_id, max(ts) + INTERVAL 2 HOUR AS saved_at, count(*) AS n_edits, max_by(event_type, ts) AS event_type, max_by(props, ts) AS props FROM r GROUP BY user_id, run""")
def s1_debounce(read):
    return debounce.debounced(read("events"), "user_id", "ts", "event_type", "props", pause="2 hours")


@query("""
SELECT user_id, max_by(s, event_id) AS status, min_by(s, event_id) = 'pending' AND bool_and(p IS NULL OR (p = 'pending' AND s IN ('done', 'error')) OR (p = 'done' AND s IN ('applied', 'rejected'))) AS valid
FROM (SELECT *, lag(s) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM (SELECT user_id, event_id, CASE row_number() OVER (PARTITION BY user_id ORDER BY event_id) WHEN 1 THEN 'pending' WHEN 2 THEN CASE WHEN user_id % 3 = 0 THEN 'error' ELSE 'done' END ELSE CASE WHEN event_id % 2 = 0 THEN 'applied' ELSE 'rejected' END END AS s FROM events)) GROUP BY user_id""")
def s2_states(read):
    """All events of a user are the moves of one edit: pending, done or error, then applied or rejected, which ends it."""
    at = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    state = F.when(at == 1, "pending").when(at == 2, F.when(F.col("user_id") % 3 == 0, "error").otherwise("done")).otherwise(F.when(F.col("event_id") % 2 == 0, "applied").otherwise("rejected"))
    return debounce.final_states(read("events").select("user_id", "event_id", state.alias("s")), "user_id", "event_id", "s")


#: Events arrive up to an hour late, in three landings.
ARRIVAL, LATENESS, LANDINGS = "ts + make_interval(0, 0, 0, 0, 0, 0, event_id * 7919 % 3600)", "1 hours", 3


@query(ORACLE_SQL["s1_debounce"])
def s1_stream_saves(read):
    """The same saves from a stream in append mode, with a timer for each editor: all events, then what closes the feed."""

    def build(stream: DataFrame) -> DataFrame:
        edits = feeds.open_rows(debounce.stream_of(stream, "ts", LATENESS), "ts")
        return timers.saves(edits, "user_id", "ts", "event_type", "props", pause="2 hours")

    found = feeds.incrementally(feeds.landings(read("events"), "ts", ARRIVAL, LANDINGS, "3 days"), build)
    return found.withColumn("saved_at", F.col("saved_at").cast("timestamp_ntz"))


@query("""
WITH RECURSIVE e AS (SELECT user_id, ts, CASE event_type WHEN 'click' THEN 'pending' WHEN 'view' THEN 'done' WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'applied' ELSE 'rejected' END AS s,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, count(*) OVER (PARTITION BY user_id) AS last FROM events),
taken AS (SELECT e.*, NULL::VARCHAR AS was, NULL::TIMESTAMP AS until, NULL::VARCHAR AS before, s = 'pending' AS ok FROM e WHERE n = 1 UNION ALL
  SELECT user_id, ts, s, n, last, was, until, before, CASE WHEN before IS NULL THEN s = 'pending' WHEN before = 'pending' THEN s IN ('done', 'error') ELSE s IN ('applied', 'rejected') END
  FROM (SELECT e.user_id, e.ts, e.s, e.n, e.last, h.state AS was, h.deadline AS until, CASE WHEN e.ts <= h.deadline THEN h.state END AS before
    FROM (SELECT user_id, n, CASE WHEN ok THEN CASE WHEN s IN ('pending', 'done') THEN s END ELSE before END AS state, CASE WHEN ok THEN ts + INTERVAL 12 HOUR ELSE until END AS deadline FROM taken) h JOIN e ON e.user_id = h.user_id AND e.n = h.n + 1)),
held AS (SELECT *, CASE WHEN ok THEN CASE WHEN s IN ('pending', 'done') THEN s END ELSE before END AS state, CASE WHEN ok THEN ts + INTERVAL 12 HOUR ELSE until END AS deadline FROM taken)
SELECT user_id, ts AS at, before, s AS status, CASE WHEN ok THEN 'settled' ELSE 'refused' END AS outcome FROM held WHERE NOT ok OR s NOT IN ('pending', 'done') UNION ALL
SELECT user_id, until, was, NULL, 'expired' FROM held WHERE was IS NOT NULL AND ts > until UNION ALL
SELECT user_id, deadline, state, NULL, 'expired' FROM held WHERE n = last AND state IS NOT NULL""")
def s2_stream_outcomes(read):
    """Events as moves of edits, one edit a user at a time, from a stream that delivers some events twice."""
    events = read("events").withColumn("s", F.expr("CASE event_type WHEN 'click' THEN 'pending' WHEN 'view' THEN 'done' WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'applied' ELSE 'rejected' END"))

    def build(stream: DataFrame) -> DataFrame:
        moves = feeds.open_rows(debounce.stream_of(stream, "ts", LATENESS).dropDuplicatesWithinWatermark(["event_id", feeds.CLOSING]), "ts")
        return timers.outcomes(moves, "user_id", "ts", "event_id", "s", limit="12 hours")

    events = events.select("event_id", "user_id", "ts", "s")
    parts = feeds.landings(events.unionByName(events.where("event_id % 9 = 4")), "ts", ARRIVAL, LANDINGS, "3 days")
    return feeds.incrementally(parts, build).withColumn("at", F.col("at").cast("timestamp_ntz"))


# ---- answers of a chat service, workers and programs

#: Conversations as a record of answers: what an assistant said is a completion, what others said an error with a wait.
RECORDED_SQL = """
SELECT conv_id * 1000 + turn AS request, CASE WHEN role = 'assistant' THEN 200 ELSE 429 END AS status, CASE WHEN role = 'assistant' THEN coalesce(text, '') ELSE '' END AS content,
CASE WHEN role = 'assistant' THEN 'm' ELSE 'asked' END AS model, CASE WHEN role = 'assistant' THEN 0 ELSE turn + 1 END AS wait FROM conversations"""


def spoken(read) -> DataFrame:
    completion = "to_json(named_struct('model', 'm', 'choices', array(named_struct('message', named_struct('role', role, 'content', text)))))"
    busy = "to_json(named_struct('error', named_struct('message', concat('Please try again in ', turn, '.5s'))))"
    return read("conversations").selectExpr("conv_id", "conv_id * 1000 + turn AS request", "1 AS call", "CASE WHEN role = 'assistant' THEN 200 ELSE 429 END AS status", f"CASE WHEN role = 'assistant' THEN {completion} ELSE {busy} END AS body")


def interpreted(answers: DataFrame) -> DataFrame:
    found = compiling.answer(F.col("body"), F.lit("asked"))
    return answers.select("request", "status", found["content"].alias("content"), found["model"].alias("model"), t.retry_after(F.get_json_object("body", "$.error.message")).alias("wait"))


@query(RECORDED_SQL)
def src6_recorded_answers(read):
    """Answers are written as a record, read back by its source, and interpreted."""
    made = spoken(read)
    folder = new_folder(made.sparkSession, "answers")
    recorded.record(made, folder, 1)
    return interpreted(recorded.recorded(made.sparkSession, folder))


@query(RECORDED_SQL)
def src6_answer_stream(read):
    """The same from a stream over the record, which grows between two runs."""
    made = spoken(read)
    spark = made.sparkSession
    folder = new_folder(spark, "answers")
    for landing, part in enumerate((made.where("conv_id % 2 = 0"), made.where("conv_id % 2 <> 0 OR conv_id IS NULL")), 1):
        recorded.record(part, f"{folder}/in", landing)
        found = interpreted(recorded.recorded_stream(spark, f"{folder}/in"))
        found.writeStream.format("parquet").options(path=f"{folder}/out", checkpointLocation=f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{folder}/out")


@query("""
WITH RECURSIVE a AS (SELECT user_id * 100 + day(ts) AS request, row_number() OVER (PARTITION BY user_id, day(ts) ORDER BY ts, event_id) AS call, event_type AS k, event_id, props FROM events),
f AS (SELECT DISTINCT request, 0 AS n, 'calling' AS state, 'calling' AS was, 1 AS attempt, 0 AS waited, 32768 AS max_tokens, NULL::VARCHAR AS k, NULL::BIGINT AS event_id, NULL::VARCHAR AS props FROM a UNION ALL
  SELECT f.request, n + 1, CASE WHEN a.k = 'view' THEN 'done' WHEN state = 'fallback' THEN 'error' WHEN a.k IN ('click', 'purchase') AND attempt <= 3 THEN 'calling' WHEN a.k = 'error' AND attempt = 1 THEN 'fallback' ELSE 'error' END, state,
    attempt + 1, waited + CASE WHEN state = 'calling' AND a.k IN ('click', 'purchase') AND attempt <= 3 THEN CASE WHEN a.k = 'click' THEN greatest(a.event_id % 13 + 1, 5) ELSE 5 END ELSE 0 END,
    CASE WHEN state = 'calling' AND a.k = 'error' AND attempt = 1 THEN 8192 ELSE max_tokens END, a.k, a.event_id, a.props FROM f JOIN a ON a.request = f.request AND a.call = f.n + 1 WHERE state IN ('calling', 'fallback')),
ends AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY request ORDER BY n DESC) = 1)
SELECT request, CASE WHEN state IN ('calling', 'fallback') THEN 'waiting' ELSE state END AS state, n AS calls, waited::BIGINT AS waited, max_tokens, CASE WHEN state = 'done' THEN props END AS content, CASE WHEN state = 'done' THEN 'asked' END AS model,
CASE WHEN state = 'error' THEN CASE WHEN was = 'calling' AND k IN ('click', 'purchase') THEN 'TOO_MANY_REQUESTS' ELSE 'BAD_REQUEST' END END AS code,
CASE WHEN state = 'error' THEN CASE WHEN was = 'fallback' THEN 'Fallback failed: ' || CASE k WHEN 'click' THEN '{"error":{"message":"try again in ' || event_id % 13 || '.5s"}}' WHEN 'purchase' THEN '{"error":{"message":"slow down"}}' WHEN 'error' THEN '{"error":{"message":"max_tokens must be less than or equal to 16384"}}' ELSE 'out of order' END
  ELSE CASE k WHEN 'click' THEN 'try again in ' || event_id % 13 || '.5s' WHEN 'purchase' THEN 'slow down' WHEN 'error' THEN 'max_tokens must be less than or equal to 16384' ELSE 'Groq API error (500)' END END END AS message FROM ends""")
def p14_p15_retry_loop(read):
    """A request for each user and day, whose calls get the day's events as their answers."""
    answers = read("events").selectExpr(
        "user_id * 100 + day(ts) AS request", "row_number() OVER (PARTITION BY user_id, day(ts) ORDER BY ts, event_id) AS call", "CASE event_type WHEN 'view' THEN 200 WHEN 'click' THEN 429 WHEN 'purchase' THEN 429 WHEN 'error' THEN 400 ELSE 500 END AS status",
        """CASE event_type WHEN 'view' THEN to_json(named_struct('choices', array(named_struct('message', named_struct('content', props))))) WHEN 'click' THEN concat('{"error":{"message":"try again in ', event_id % 13, '.5s"}}')
        WHEN 'purchase' THEN '{"error":{"message":"slow down"}}' WHEN 'error' THEN '{"error":{"message":"max_tokens must be less than or equal to 16384"}}' ELSE 'out of order' END AS body""",
    )
    requests = answers.select("request").distinct().withColumn("model", F.lit("asked"))
    return retries.ended(requests, "request", "model", answers, "call", "status", "body")


def stand_in_worker(prompt: str, model: str) -> str:
    """In place of a service: it edits, fails, says nothing of use, or leaves as it is, by the number of the chunk, and is late for a few documents."""
    head, rest = prompt.split("```latex\n", 1)
    chunk, request = rest.rsplit("\n```", 1)
    k, doc = int(head.split("\n")[0].split(": ")[1]), int(request.rsplit(": ", 1)[1])
    if doc % 400 == 7 and k == 1:
        time.sleep(60)
    if k % 4 == 2:
        raise ValueError(f"worker {model} failed")
    return [f"```\nleft alone\n```\nCHANGES_SUMMARY: no change", f"CHUNK_ID: {k}\nUPDATED_LATEX:\n```latex\nedited {chunk}\n```\nCHANGES_SUMMARY: edited", "", "done, I think"][k % 4]


WORKED_SQL = CHUNKS_SQL.rstrip().rstrip(",") + r""",
tasks AS (SELECT doc_id, unnest(chunks) AS chunk, generate_subscripts(chunks, 1) AS id, len(chunks) AS total FROM chunked),
taken AS (SELECT *, CASE WHEN TAKEN THEN rtrim('edited ' || chunk, ' ' || chr(9) || chr(10) || chr(13)) ELSE chunk END AS text, CASE STATUS ELSE 'completed' END AS status FROM tasks),
merged AS (SELECT doc_id, string_agg(text, chr(10) ORDER BY id) AS body, string_agg(status, chr(10) ORDER BY id) AS statuses, count(*) FILTER (WHERE status <> 'completed') AS n_failed FROM taken GROUP BY doc_id)
SELECT doc_id, md5(CASE WHEN doc_id % 3 = 0 THEN '\documentclass{article}' || chr(10) || '\begin{document}' || chr(10) || body || chr(10) || '\end{document}' || chr(10) ELSE body END) AS merged_md5, statuses, n_failed FROM merged"""


def merged_with_statuses(rows: DataFrame) -> DataFrame:
    held = edits.gather(rows, "doc_id", "preamble")
    failed = F.size(F.filter("statuses", lambda s: s != "completed")).cast("long")
    return held.select("doc_id", F.md5(edits.assembled(F.col("preamble"), F.col("chunks")).cast("binary")).alias("merged_md5"), F.array_join("statuses", "\n").alias("statuses"), failed.alias("n_failed"))


MODEL_SQL = "['" + "', '".join(edits.WORKER_MODELS) + "'][((id - 1) % 6 + 1)::INTEGER]"


@query(WORKED_SQL.replace("TAKEN", "id % 4 = 1 AND NOT (doc_id % 400 = 7 AND id = 1)").replace("STATUS", f"WHEN doc_id % 400 = 7 AND id = 1 THEN 'error: timed out after 4 seconds' WHEN id % 4 = 2 THEN 'error: worker ' || {MODEL_SQL} || ' failed'"))
def p2_p4_isolated_workers(read):
    """Chunks are dealt out to workers, of which some fail and some are late; the documents come together all the same."""
    # chunks are made twice, for the workers and for what comes back, so the table is dealt out first, as its file may be one task's
    docs = latex(read).repartition(workers.shares(read("documents").sparkSession), "doc_id")
    tasks = edits.scatter(splitter.split(docs, "doc_id", "code", edits.TARGET_CHUNKS), "doc_id", "preamble")
    prompt = t.chunk_prompt(F.col("chunk_id"), F.col("total"), F.col("chunk"), F.col("doc_id").cast("string"))
    done = workers.worked(tasks.withColumn("prompt", prompt), "doc_id", "prompt", stand_in_worker, seconds=4)
    return merged_with_statuses(edits.with_replies(tasks, done, "doc_id"))


@query(WORKED_SQL.replace("TAKEN", "(doc_id + id) % 7 <> 3").replace("STATUS", "WHEN (doc_id + id) % 7 = 3 THEN 'error: no reply'"))
def p3_p4_replies_by_table(read):
    """Replies are a table: out of order, some missing, some there twice, of which the later one comes to nothing."""
    tasks = edits.scatter(splitter.split(latex(read), "doc_id", "code", edits.TARGET_CHUNKS), "doc_id", "preamble")
    texts = F.expr("""CASE WHEN (doc_id + chunk_id) % 7 = 3 THEN array() WHEN (doc_id + chunk_id) % 5 = 1 THEN array('edited ', 'too late ') ELSE array('edited ') END""")
    replies = tasks.select("doc_id", "chunk_id", "chunk", F.posexplode(texts).alias("at", "head"))
    reply = F.concat(F.lit("UPDATED_LATEX:\n```latex\n"), "head", "chunk", F.lit("\n```"))
    return merged_with_statuses(edits.with_replies(tasks, replies.select("doc_id", "chunk_id", reply.alias("reply"), "at"), "doc_id", "at"))


@query("""
WITH o AS (SELECT o_custkey, string_agg(o_orderpriority, '' ORDER BY o_orderkey || '.txt') AS whole, bool_or(o_custkey % 7 = 5 AND o_orderkey % 4 = 1) AS escapes, string_agg('../' || o_orderkey || '.txt', ',' ORDER BY '../' || o_orderkey || '.txt') FILTER (WHERE o_custkey % 7 = 5 AND o_orderkey % 4 = 1) AS outside FROM orders GROUP BY o_custkey)
SELECT o_custkey, CASE WHEN escapes OR o_custkey % 500 = 3 OR o_custkey % 5 = 2 THEN NULL ELSE sha256(whole) END AS product, CASE WHEN escapes THEN 'Invalid filename (path traversal): ' || split_part(outside, ',', 1) WHEN o_custkey % 500 = 3 THEN 'timed out after 4 seconds'
WHEN o_custkey % 5 = 2 THEN 'broken' || chr(10) || chr(10) || 'Command failed: sh main.tex' WHEN o_custkey % 5 = 4 THEN 'made' || chr(10) || chr(10) || 'Command failed: sh main.tex' ELSE 'made' || chr(10) END AS logs,
NOT escapes AND o_custkey % 500 <> 3 AND o_custkey % 5 <> 2 AS success FROM o""")
def p11_supervised(read):
    """A shell in place of a compiler puts a customer's order files together; it fails with and without a product, goes beyond its time, and is refused files outside its folder."""
    orders = read("orders")
    name = F.expr("concat(CASE WHEN o_custkey % 7 = 5 AND o_orderkey % 4 = 1 THEN '../' ELSE '' END, o_orderkey, '.txt')")
    script = F.expr("CASE WHEN o_custkey % 500 = 3 THEN 'sleep 600 & sleep 600' WHEN o_custkey % 5 = 2 THEN 'echo broken >&2; exit 3' WHEN o_custkey % 5 = 4 THEN 'cat [0-9]*.txt > main.pdf; echo made; exit 12' ELSE 'cat [0-9]*.txt > main.pdf; echo made' END")
    files = orders.select("o_custkey", name.alias("name"), F.col("o_orderpriority").cast("binary").alias("data"))
    main = orders.select("o_custkey").distinct().select("o_custkey", F.lit("main.tex").alias("name"), script.cast("binary").alias("data"))
    rows = processes.compiled(main.unionByName(files), "o_custkey", "name", "data", ["sh", "main.tex"], "main.pdf", limit=4)
    return rows.select("o_custkey", F.sha2("pdf", 256).alias("product"), "logs", "success")


# ---- writes that land, batches of requests, logs


@query("""
SELECT o_orderkey, o_custkey, CASE WHEN o_custkey % 50 = 20 AND o_orderkey % 13 <> 4 THEN 'renamed' ELSE o_orderstatus END AS o_orderstatus, o_orderpriority FROM orders WHERE o_orderkey % 97 <> 5
UNION ALL SELECT -s_suppkey, s_nationkey, 'new', s_name FROM supplier""")
def snk5_landed_changes(read):
    """A table in folders by key takes an update, a deletion and an insertion one after the other, and is read back."""
    orders = read("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    landed = tables.created(orders, "o_orderkey", new_folder(orders.sparkSession, "table"), 16)
    changes = orders.where("o_custkey % 50 = 20").select("o_orderkey", F.expr("CASE WHEN o_orderkey % 13 <> 4 THEN 'renamed' END").alias("o_orderstatus"), F.lit(None).cast("string").alias("o_orderpriority"))
    tables.updated(landed, changes, "o_orderstatus", "o_orderpriority")
    tables.deleted(landed, orders.where("o_orderkey % 97 = 5"))
    tables.inserted(landed, read("supplier").select((-F.col("s_suppkey")).alias("o_orderkey"), F.col("s_nationkey").cast("long").alias("o_custkey"), F.lit("new").alias("o_orderstatus"), F.col("s_name").alias("o_orderpriority")))
    return landed.rows()


#: Events as requests: customers are files of their nation, regions own nations.
REQUESTED = [
    "event_id AS request", "CASE WHEN event_id % 251 = 3 THEN 'delete_project' WHEN event_id % 31 = 5 THEN 'update_project' ELSE CASE event_type WHEN 'purchase' THEN 'create' WHEN 'error' THEN 'delete' WHEN 'click' THEN 'rename' ELSE 'update' END END AS op", "event_id % 5 AS asker", "user_id % 40 * 9 + event_id % 7 + CASE WHEN event_id % 4 = 1 THEN 1000000 ELSE 0 END AS file",
    "user_id % 27 AS project", "CASE WHEN event_id % 17 = 0 THEN '' ELSE concat(event_type, '-', event_id) END AS name", "CASE WHEN event_id % 19 <> 0 THEN props END AS content",
    "CASE WHEN event_id % 23 = 0 THEN repeat('x', 501) WHEN event_id % 3 = 0 THEN props END AS description",
]

#: One request after the other of each file, with what is known of the file; projects end by their own requests.
REQUESTS_SQL = f"""
WITH RECURSIVE q AS (SELECT {', '.join(REQUESTED)} FROM events),
w AS (SELECT *, CASE WHEN op IN ('create', 'rename') THEN length(name) BETWEEN 1 AND 255 WHEN op = 'update' THEN content IS NOT NULL WHEN op = 'update_project' THEN length(name) BETWEEN 1 AND 100 AND (description IS NULL OR length(description) <= 500) ELSE true END AS valid, (SELECT n_regionkey FROM nation WHERE n_nationkey = project) AS asked_of FROM q),
ends AS (SELECT project, min(request) AS until FROM w WHERE op = 'delete_project' AND asked_of = asker GROUP BY project),
of_projects AS (SELECT w.*, CASE WHEN NOT valid THEN 'invalid' WHEN asked_of = asker AND (until IS NULL OR request <= until) THEN 'ok' ELSE 'unauthorized' END AS outcome FROM w LEFT JOIN ends USING (project) WHERE op IN ('update_project', 'delete_project')),
v AS (SELECT w.*, until AS asked_until, row_number() OVER (PARTITION BY file ORDER BY request) AS n FROM w LEFT JOIN ends USING (project) WHERE op NOT IN ('update_project', 'delete_project')),
start AS (SELECT f.file, c.c_custkey IS NOT NULL AS used, c.c_custkey IS NOT NULL AS alive, n_regionkey AS owner, c_nationkey AS project, c_name AS name, c_mktsegment AS content, until FROM (SELECT file FROM v UNION SELECT c_custkey FROM customer) f LEFT JOIN customer c ON c_custkey = file LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN ends ON ends.project = c_nationkey),
f AS (SELECT file, 0::BIGINT AS n, NULL::BIGINT AS request, NULL::VARCHAR AS outcome, used, alive, owner, project::BIGINT AS project, name, content, until FROM start UNION ALL
  SELECT file, n, request, outcome, used OR made, CASE WHEN made THEN true WHEN outcome = 'ok' AND op = 'delete' THEN false ELSE alive END, CASE WHEN made THEN asked_of ELSE owner END, CASE WHEN made THEN new_project ELSE project END,
    CASE WHEN made OR (outcome = 'ok' AND op = 'rename') THEN new_name ELSE name END, CASE WHEN made THEN coalesce(new_content, '') WHEN outcome = 'ok' AND op = 'update' THEN new_content ELSE content END, CASE WHEN made THEN asked_until ELSE until END
  FROM (SELECT *, outcome = 'ok' AND op = 'create' AS made FROM (SELECT f.file, v.n, v.request, v.op, v.asked_of, v.asked_until, v.project AS new_project, v.name AS new_name, v.content AS new_content, f.used, f.alive, f.owner, f.project, f.name, f.content, f.until,
    CASE WHEN NOT v.valid THEN 'invalid' WHEN v.op = 'create' THEN CASE WHEN v.asked_of IS DISTINCT FROM v.asker OR v.request > v.asked_until THEN 'unauthorized' WHEN f.used THEN 'taken' ELSE 'ok' END
      WHEN f.alive AND f.owner = v.asker AND (f.until IS NULL OR v.request < f.until) THEN 'ok' ELSE 'unauthorized' END AS outcome FROM f JOIN v ON v.file = f.file AND v.n = f.n + 1)))
"""


def requested(read) -> tuple[DataFrame, DataFrame]:
    """The outcomes and the files that they are about."""
    files = read("customer").select(F.col("c_custkey").alias("file"), F.col("c_nationkey").cast("long").alias("project"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("content"))
    projects = read("nation").select(F.col("n_nationkey").cast("long").alias("project"), F.col("n_regionkey").cast("long").alias("owner"))
    return gate.judged(read("events").selectExpr(*REQUESTED), files, projects), files


@query(REQUESTS_SQL + "SELECT request, file, outcome FROM f WHERE n > 0 UNION ALL SELECT request, file, outcome FROM of_projects")
def w3_w9_requests(read):
    """What becomes of each request of a batch."""
    return requested(read)[0].select("request", "file", "outcome")


@query(REQUESTS_SQL + "SELECT file, project, name, content FROM f JOIN (SELECT file, max(n) AS n FROM f GROUP BY file) USING (file, n) WHERE alive AND until IS NULL")
def w3_w9_files_after(read):
    """The files after the batch."""
    outcomes, files = requested(read)
    return gate.applied(files, outcomes)


@query(REQUESTS_SQL + """SELECT n_nationkey::BIGINT AS project, n_regionkey::BIGINT AS owner, coalesce(max_by(name, request) FILTER (outcome = 'ok' AND op = 'update_project'), any_value(n_name)) AS name,
max_by(description, request) FILTER (outcome = 'ok' AND op = 'update_project' AND description IS NOT NULL) AS description FROM nation LEFT JOIN of_projects ON project = n_nationkey GROUP BY n_nationkey, n_regionkey HAVING NOT coalesce(bool_or(outcome = 'ok' AND op = 'delete_project'), false)""")
def w7_w8_projects_after(read):
    """The projects after the batch."""
    projects = read("nation").select(F.col("n_nationkey").cast("long").alias("project"), F.col("n_regionkey").cast("long").alias("owner"), F.col("n_name").alias("name"), F.lit(None).cast("string").alias("description"))
    return gate.applied_projects(projects, requested(read)[0])


@query("""
WITH l AS (SELECT user_id, event_id, json_extract_string(props, '$.k') AS element, CASE event_type WHEN 'error' THEN 'remove' WHEN 'purchase' THEN 'replace' WHEN 'signup' THEN 'replace' ELSE 'append' END AS op FROM events),
r AS (SELECT user_id, element, max(event_id) FILTER (WHERE op = 'remove') AS removed FROM l GROUP BY ALL),
s AS (SELECT l.user_id, l.element, min(event_id) FILTER (WHERE op = 'append') AS since, max(event_id) AS last FROM l JOIN r ON l.user_id = r.user_id AND l.element = r.element WHERE removed IS NULL OR event_id > removed GROUP BY ALL)
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY since)::INTEGER AS place, element, 'edit ' || last AS content FROM s WHERE since IS NOT NULL""")
def l2_l4_replayed_log(read):
    """Events as a log of list edits: what each user's list comes to."""
    op = F.expr("CASE event_type WHEN 'error' THEN 'remove' WHEN 'purchase' THEN 'replace' WHEN 'signup' THEN 'replace' ELSE 'append' END")
    log = read("events").select("user_id", "event_id", F.get_json_object("props", "$.k").alias("element"), op.alias("op"), F.concat(F.lit("edit "), "event_id").alias("content"))
    return replay.replayed(log, "user_id", "element", "event_id", "op", "content")
