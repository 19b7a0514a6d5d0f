"""Queries A01 to A21: jobs over files, and the same jobs over text columns of the driver tables.

Workbooks and archives are covered by tests on generated files; the queries here read tables of any size.
"""

from __future__ import annotations

from pyspark.sql.types import DateType, DoubleType, LongType, StructField, StructType

from .. import contracts
from ..functions import text
from ..operators import filters, quality
from ..plans import build
from ..sources import files, publish, table_functions
from ..shared import new_folder
from .base import F, Registry, once, p, q_receipts, table
from .functions import SENSITIVE_SQL
from .quality import receipts_contract, validated_sql

QUERIES = Registry()


@QUERIES.add("a01_coerced_scan", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS period, o_totalprice FROM orders")
def a01(s, d):
    wanted = StructType([StructField("o_orderkey", LongType()), StructField("o_orderdate", DateType()), StructField("o_totalprice", DoubleType())])
    found, errors = files.load_tables(s, d, {"orders": wanted, "no_such_table": wanted})
    assert set(found) == {"orders"} and not errors
    return found["orders"].withColumnRenamed("o_orderdate", "period")


@QUERIES.add("a02_delimited_round_trip", "SELECT o_orderkey, o_orderstatus, o_totalprice, CAST(o_orderdate AS DATE) AS o_orderdate, o_orderpriority FROM orders")
def a02(s, d):
    """All orders through CSV files of both separators, plain and packed, found out by the tasks that read them."""
    orders = table(s, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", F.to_date("o_orderdate").alias("o_orderdate"), "o_orderpriority")
    folder = new_folder(s, "csv")
    kinds = {"semicolon": (False, ";"), "semicolon_gz": (True, ";"), "comma": (False, ","), "comma_gz": (True, ",")}
    for i, (name, kind) in enumerate(kinds.items()):
        mine = F.pmod(F.xxhash64("o_orderkey"), F.lit(len(kinds))) == i  # a null key has a hash too: each order is of one kind
        publish.write_csv(orders.filter(mine), f"{folder}/{name}", *kind, quoted=True)
    schema = "o_orderkey long, o_orderstatus string, o_totalprice double, o_orderdate date, o_orderpriority string"
    return files.read_delimited(s, [f"{folder}/{name}" for name in kinds], schema, "*.{csv,csv.gz}", quoted=True)


@QUERIES.add("a17_manifest_rows", "SELECT CAST(count(*) AS BIGINT) AS n_rows, true AS hashes_agree FROM lineitem")
def a17(s, d):
    """What the sink says it wrote, against hashes of the files as they lie there."""
    folder = new_folder(s, "csv")
    told = publish.write_csv(table(s, d, "lineitem"), folder, compressed=True)
    both = told.join(publish.checksums(s, folder, "*.csv.gz").withColumnRenamed("sha256", "found"), "source_file", "full_outer")
    return both.agg(F.sum("rows").alias("n_rows"), F.bool_and(F.col("sha256").eqNullSafe(F.col("found"))).alias("hashes_agree"))


@QUERIES.add("a04_melt_by_dictionary", """
SELECT c_custkey, coalesce(section, 'UNMAPPED') AS section, sum(CAST(v AS DOUBLE)) * 1000 AS value FROM (SELECT c_custkey, unnest(['B1', 'B2', 'C1', 'Z1']) AS field, unnest([c_nationkey, c_custkey % 7, c_custkey % 11, 1]) AS v FROM customer)
JOIN (VALUES ('B1', 'B'), ('B2', 'B'), ('C1', 'C'), ('Z1', NULL)) x(field, section) USING (field) GROUP BY ALL""")
def a04(s, d):
    wide = table(s, d, "customer").select("c_custkey", F.col("c_nationkey").alias("B1"), (F.col("c_custkey") % 7).alias("B2"), (F.col("c_custkey") % 11).alias("C1"), F.lit(1).alias("Z1"), F.lit(9).alias("unused"))
    dictionary = s.createDataFrame([("B1", "B"), ("B2", "B"), ("C1", "C"), ("Z1", None)], "field string, section string")
    return files.melted(wide, dictionary, ["c_custkey"])


@QUERIES.add("a05_admitted_files", "SELECT page_id, page_id % 5 AS schema_id, 'missing_dictionary' AS reason FROM pages WHERE page_id % 5 NOT IN (SELECT DISTINCT n_nationkey % 4 FROM nation)")
def a05(s, d):
    listing = table(s, d, "pages").select("page_id", (F.col("page_id") % 5).alias("schema_id"))
    return files.admitted(listing, table(s, d, "nation").select((F.col("n_nationkey") % 4).alias("schema_id")), "schema_id")[1]


@QUERIES.add("a06_distinct_content", """
SELECT doc_id, sha256(text) AS sha256, count(*) OVER (PARTITION BY text) AS n_copies FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY 'doc_' || doc_id || '.txt') = 1""")
def a06(s, d):
    docs = table(s, d, "documents").select("doc_id", F.concat(F.lit("/raw/doc_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.col("text").cast("binary").alias("content"))
    return files.distinct_files(docs).select("doc_id", "sha256", "n_copies")


@QUERIES.add("a07_dated_names", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS cutoff, CAST(o_orderdate AS DATE) - 1 AS period FROM orders")
def a07(s, d):
    name = F.concat(F.lit("/raw/report_"), F.date_format("o_orderdate", "dd.MM.yyyy"), F.lit(".zip"))
    return files.dated_names(table(s, d, "orders").select("o_orderkey", name.alias("path"))).select("o_orderkey", "cutoff", "period")


@QUERIES.add("a11_html_links", r"""
SELECT page_id, CAST(i - 1 AS INT) AS place, l[i] AS href FROM (SELECT page_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(html, '(?i)<a\s[^>]*?href\s*=\s*["'']([^"'']*)["'']', 1) AS l FROM pages))""")
def a11(s, d):
    return files.html_links(table(s, d, "pages"), "page_id", "html")


@QUERIES.add("a12_split_status", "SELECT page_id FROM pages WHERE page_id % 4 <> 0")
def a12(s, d):
    rows = table(s, d, "pages").select("page_id", F.col("url").alias("path"), F.when(F.col("page_id") % 4 == 0, "BadZipFile").alias("error"))
    return files.split_status(rows)[0].select("page_id")


_LINK = r"""'(?i)<a\s[^>]*?href\s*=\s*["'']([^"'']*)["''][^>]*>([^<]*)</a>'"""
_LABEL = "replace(replace(replace(replace({}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&')"


def _links_sql(pages: str) -> str:
    """page_id, place, label, href of each link of some pages."""
    label = _LABEL.format(r"trim(regexp_replace(t[i], '\s+', ' ', 'g'))")
    return f"SELECT page_id, CAST(i - 1 AS INT) AS place, {label} AS label, l[i] AS href FROM (SELECT page_id, l, t, unnest(range(1, len(l) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(html, {_LINK}, 1) AS l, regexp_extract_all(html, {_LINK}, 2) AS t FROM {pages}))"


@QUERIES.add("a11_links_in_sql", _links_sql("pages"))
def a11_links(s, d):
    """The links of all pages by a table function, called from SQL."""
    table_functions.register(s)
    return s.sql("SELECT p.page_id, l.place, l.label, l.href FROM {pages} p, LATERAL html_links(p.html) l", pages=table(s, d, "pages"))


@QUERIES.add("a12_archives_in_sql", f"{_links_sql('pages WHERE page_id % 4 <> 0')} UNION ALL SELECT page_id, NULL, 'BadZipFile', NULL FROM pages WHERE page_id % 4 = 0")
def a12_archives(s, d):
    """Pages packed into nested archives, half of every fourth cut off: the links of the whole ones, and the errors of the others."""
    table_functions.register(s)
    packed = files.archived(table(s, d, "pages").select(F.col("page_id").cast("string").alias("path"), "html"), "path", "html", nested=True)
    sent = packed.select(F.col("path").cast("long").alias("page_id"), F.when(F.col("path") % 4 == 0, F.expr("substring(content, 1, length(content) div 2)")).otherwise(F.col("content")).alias("content"))
    return s.sql("SELECT f.page_id, l.place, coalesce(l.label, split_part(l.error, ':', 1)) AS label, l.href FROM {sent} f, LATERAL archive_links(f.content, members => '%page.html') l", sent=sent)


@QUERIES.add("a16_publishable", "SELECT region_id, CAST(NULL AS VARCHAR) AS region_name_ru, period, ytd AS pit_ytd_rub, flow AS pit_flow_rub FROM receipts", "receipts")
def a16(s, d):
    df = q_receipts(s, d).withColumnsRenamed({"ytd": "pit_ytd_rub", "flow": "pit_flow_rub"})
    return publish.publishable("pit_receipts", df).select("region_id", "region_name_ru", "period", "pit_ytd_rub", "pit_flow_rub")


@QUERIES.add("a16_table_summary", "SELECT 'receipts' AS table_name, count(*) AS n_rows, min(period) AS earliest, max(period) AS latest, count(DISTINCT region_id) AS n_regions FROM receipts", "receipts")
def a16_summary(s, d):
    return publish.summary("receipts", q_receipts(s, d))


@QUERIES.add("a18_checksum_mismatches", "SELECT 'hash_agrees' AS check_id, count(*) AS observed FROM documents WHERE doc_id % 20 = 5")
def a18(s, d):
    docs = table(s, d, "documents")
    name = F.col("doc_id").cast("string").alias("source_file")
    facts = docs.select(name, F.sha2("text", 256).alias("source_sha256"))
    manifest = docs.select(name, F.when(F.col("doc_id") % 20 == 5, "changed").otherwise(F.sha2("text", 256)).alias("sha256"))
    return quality.check_provenance(facts, manifest).filter("check_id = 'hash_agrees'").select("check_id", "observed")


@QUERIES.add("a20_inventory", "SELECT doc_id, lang AS family, strlen(text) AS bytes, sha256(text) AS sha256, count(*) OVER (PARTITION BY text) AS n_equal FROM documents")
def a20(s, d):
    docs = table(s, d, "documents").select(F.concat_ws(".", F.col("doc_id").cast("string"), "lang").alias("path"), F.octet_length("text").cast("long").alias("length"), F.col("text").cast("binary").alias("content"))
    return files.inventory(docs).select(F.split("name", "\\.")[0].cast("long").alias("doc_id"), "family", "bytes", "sha256", "n_equal")


@QUERIES.add("a20_file_shapes", r"""
WITH l AS (SELECT doc_id, unnest(range(1, len(p) + 1)) AS i, p FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)), x AS (SELECT doc_id, i, p[i] AS line, regexp_replace(p[i], '"[^"]*"', '', 'g') AS bare, p[1] AS head, regexp_replace(p[1], '"[^"]*"', '', 'g') AS own FROM l),
y AS (SELECT *, CASE WHEN length(head) - length(replace(head, ';', '')) > length(head) - length(replace(head, ',', '')) THEN ';' ELSE ',' END AS sep FROM x)
SELECT doc_id, sep, CAST(length(any_value(own)) - length(replace(any_value(own), sep, '')) + 1 AS INT) AS n_columns, count(*) - 1 AS n_rows,
  count(*) FILTER (trim(line) <> '' AND length(bare) - length(replace(bare, sep, '')) <> length(own) - length(replace(own, sep, ''))) AS n_irregular, count(*) FILTER (trim(line) = '') AS n_blank FROM y GROUP BY doc_id, sep""")
def a20_shapes(s, d):
    """Every text as a delimited file: rows, columns and irregular rows."""
    lines = table(s, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("place", "value"))
    return files.file_shapes(lines, "doc_id")


@QUERIES.add("a21_text_profile", """
, x AS (SELECT lang, len(string_split(line, ' ')) AS width, string_split(line, ' ')[1] AS k FROM (SELECT lang, unnest(string_split(text, chr(10))) AS line FROM documents)), w AS (SELECT lang, width, count(*) AS n FROM x GROUP BY ALL), k AS (SELECT lang, sum(CASE WHEN n > 1 THEN n ELSE 0 END) AS r FROM (SELECT lang, k, count(*) AS n FROM x GROUP BY ALL) GROUP BY lang)
SELECT lang, CAST(sum(n) AS BIGINT) AS n_lines, arg_max(width, struct_pack(a := n, b := width)) AS width, CAST(any_value(r) AS BIGINT) AS n_repeated_keys, CAST(sum(n) - max(n) AS BIGINT) AS n_other_widths FROM w JOIN k USING (lang) GROUP BY lang""".replace("\n, x AS", "\nWITH x AS", 1))
def a21(s, d):
    lines = table(s, d, "documents").select("lang", F.explode(F.split("text", "\n")).alias("value"))
    return files.text_profile(lines, " ", group="lang").drop("n_grouped_numbers")


_ANY_SECRET = " OR ".join(f"regexp_matches(text, '{shape}')" for name, shape in SENSITIVE_SQL.items() if name != "machine_path")


@QUERIES.add("b19_sanitized", rf"""
SELECT doc_id, sha256(CASE WHEN {_ANY_SECRET} THEN NULL WHEN regexp_matches(text, '^https?://') THEN text WHEN NOT regexp_matches(text, '{SENSITIVE_SQL["machine_path"]}') THEN text
  WHEN regexp_matches(text, '^[/\\]|^[A-Za-z]:') THEN regexp_replace(regexp_replace(replace(text, '\', '/'), '/+$', ''), '(?s)^.*/', '') END) AS clean FROM documents""")
def b19_sanitized(s, d):
    return table(s, d, "documents").select("doc_id", F.sha2(text.sanitized("text"), 256).alias("clean"))


def contract_tables(s, d):
    """All tables of the contracts but the events, each with a source and a vintage."""
    of = lambda name, df, source: filters.project(df.withColumns({"source_id": F.lit(source), "source_vintage": F.year("period").cast("string"), "quality_status": F.lit("verified")}), contracts.CONTRACTS[name])
    production = p.production(s, d).filter("index_value IS NOT NULL").withColumnRenamed("section", "okved_section").withColumns({"frequency": F.lit("monthly"), "index_measure": F.lit("yoy")})
    regions = table(s, d, "nation").select(F.col("n_nationkey").cast("string").alias("region_id"), F.col("n_name").alias("region_name_en"), F.col("n_name").alias("region_name_ru"))
    sources = table(s, d, "supplier").select(F.col("s_suppkey").cast("string").alias("source_id"), F.col("s_name").alias("publisher"), F.lit("register").alias("dataset_name"), F.col("s_name").alias("local_path"), F.sha2("s_name", 256).alias("sha256"))
    return {
        "pit_receipts": receipts_contract(s, d), "industrial_production": of("industrial_production", production, "s2"), "budget_execution": of("budget_execution", p.revenue(s, d).withColumn("frequency", F.lit("quarterly")), "s3"),
        "regions": filters.project(regions, contracts.CONTRACTS["regions"]), "sources": filters.project(sources, contracts.CONTRACTS["sources"]),
    }


_OF_PANEL = "SELECT '{}' AS table_name, count(*) AS n_rows, min(period) AS earliest, max(period) AS latest, count(DISTINCT region_id) AS n_regions FROM {}"


@QUERIES.add("l33_gated_summary", " UNION ALL ".join([
    _OF_PANEL.format("pit_receipts", "receipts"), _OF_PANEL.format("industrial_production", "production WHERE index_value IS NOT NULL"), _OF_PANEL.format("budget_execution", "revenue"),
    "SELECT 'regions', count(*), NULL, NULL, count(DISTINCT n_nationkey) FROM nation", "SELECT 'sources', count(*), NULL, NULL, NULL FROM supplier",
]), "receipts production revenue")
def l33(s, d):
    """The whole build over all five tables: checks, gate, publication, and the manifest as a reader of the snapshot finds it."""
    folder = new_folder(s, "snapshot")
    build.build_and_promote(contract_tables(s, d), folder)
    return publish.snapshot(s, folder)[1]


@QUERIES.add("k10_observed_checks", validated_sql(), "receipts")
def k10_observed(s, d):
    """The events of k09, counted in the pass that writes the table."""
    return s.createDataFrame(publish.staged("pit_receipts", receipts_contract(s, d), new_folder(s, "staged"))[0], quality.EVENT)


@QUERIES.add("l35_coverage_audit", """
, c AS (SELECT region_id, period, CASE WHEN r IS NULL OR e IS NULL OR b IS NULL THEN 'blocked' WHEN abs(r - e - b) <= 0.02 THEN 'passed' ELSE 'failed' END AS status FROM (SELECT region_id, period, max(CASE WHEN metric_code = 'revenue_total' THEN actual_ytd_rub END) AS r, max(CASE WHEN metric_code = 'expenditure_total' THEN actual_ytd_rub END) AS e, max(CASE WHEN metric_code = 'budget_balance' THEN actual_ytd_rub END) AS b FROM fiscal GROUP BY ALL)),
q AS (SELECT CAST(last_day(m + INTERVAL 2 MONTH) AS DATE) AS period FROM (SELECT unnest(generate_series(date_trunc('quarter', min(period)), max(period), INTERVAL 3 MONTH)) AS m FROM c))
SELECT region_id, period, coalesce(status, 'absent') AS status FROM (SELECT region_id, period FROM (SELECT DISTINCT region_id FROM c), q) LEFT JOIN c USING (region_id, period)""", "fiscal")
def l35(s, d):
    """The territory x period matrix, a row a cell."""
    found = once(quality.accounting_checks(p.fiscal(s, d)).filter("check_id = 'revenue_minus_spending_is_balance'"), "accounting")
    status = F.when(F.col("status") == "not_assessable", "blocked").otherwise(F.col("status"))
    return quality.coverage_cells(found.select("region_id", "period", status.alias("status")), "region_id", "quarterly")
