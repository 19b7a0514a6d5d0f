"""Queries B01 to B19 and H01 to H20."""

from __future__ import annotations

from pyspark.sql.types import DateType, DoubleType, StringType, StructField, StructType

from ..functions import calendar as cal
from ..functions import lineage, numbers, text
from ..operators import filters
from .base import F, Registry, p, q_monthly, q_receipts, table

QUERIES = Registry()
CONTRACT = StructType([StructField("region_id", StringType()), StructField("period", DateType()), StructField("ytd", DoubleType()), StructField("source_id", StringType())])


@QUERIES.add("b01_contract_projection", "SELECT region_id, period, ytd, NULL::VARCHAR AS source_id FROM receipts", "receipts")
def b01(s, d):
    return filters.project(q_receipts(s, d), CONTRACT)


@QUERIES.add("b02_region_filter", "SELECT region_id, section, period, flow FROM receipts WHERE region_id = '7'", "receipts")
def b02(s, d):
    return filters.of_region(q_receipts(s, d), "7").select("region_id", "section", "period", "flow")


@QUERIES.add("b03_same_month_history", "SELECT region_id, section, period, flow FROM monthly WHERE month(period) = 6 AND period <= DATE '1999-06-30'", "monthly")
def b03(s, d):
    return filters.same_month_until(q_monthly(s, d), "1999-06-30").select("region_id", "section", "period", "flow")


@QUERIES.add("b04_same_day_history", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS period FROM orders WHERE month(o_orderdate) = 6 AND day(o_orderdate) = 30 AND CAST(o_orderdate AS DATE) <= DATE '1999-06-30'")
def b04(s, d):
    df = table(s, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("period"))
    return filters.same_month_until(df, "1999-06-30", same_day=True)


@QUERIES.add("b05_without_totals", """
SELECT * FROM (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN ' total ' WHEN 1 THEN o_orderstatus WHEN 2 THEN 'b–e' ELSE o_orderpriority END AS kind, CASE o_orderkey % 7 WHEN 0 THEN 'Итого ' WHEN 1 THEN 'B-E' ELSE o_orderpriority END AS label FROM orders)
WHERE upper(trim(coalesce(kind, ''))) NOT IN ('TOTAL', 'ALL', 'B-E', 'B–E', 'B—E', 'ВСЕГО') AND lower(trim(coalesce(label, ''))) NOT IN ('total', 'all industries', 'всего', 'итого')""")
def b05(s, d):
    code, name = F.col("o_orderkey") % 5, F.col("o_orderkey") % 7
    kind = F.when(code == 0, " total ").when(code == 1, F.col("o_orderstatus")).when(code == 2, "b–e").otherwise(F.col("o_orderpriority"))
    label = F.when(name == 0, "Итого ").when(name == 1, "B-E").otherwise(F.col("o_orderpriority"))
    return filters.without_totals(table(s, d, "orders").select("o_orderkey", kind.alias("kind"), label.alias("label")), "kind", names=("label",))


@QUERIES.add("b06_first_nonempty", "SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END, 'Unmapped') AS label FROM orders")
def b06(s, d):
    blank = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus")).otherwise("  ")
    return table(s, d, "orders").select("o_orderkey", text.first_nonempty(blank, default="Unmapped").alias("label"))


@QUERIES.add("b07_lenient_number", "SELECT event_id, TRY_CAST(CASE WHEN event_id % 3 = 0 THEN event_type ELSE CAST(user_id AS VARCHAR) END AS DOUBLE) AS n FROM events")
def b07(s, d):
    mixed = F.when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise(F.col("user_id").cast("string"))
    return table(s, d, "events").select("event_id", numbers.number(mixed).alias("n"))


@QUERIES.add("b08_strict_number", "SELECT event_id FROM events WHERE event_id % 3 = 0")
def b08(s, d):
    mixed = F.when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise(F.col("user_id").cast("string"))
    return table(s, d, "events").filter(numbers.strict_violation(mixed)).select("event_id")


@QUERIES.add("b09_offending_values", "SELECT string_agg(DISTINCT o_orderstatus, ', ' ORDER BY o_orderstatus) AS offenders, count(*) AS n FROM orders WHERE o_orderstatus NOT IN ('O')")
def b09(s, d):
    bad = table(s, d, "orders").filter(~F.col("o_orderstatus").isin("O"))
    return bad.agg(F.array_join(F.sort_array(F.collect_set("o_orderstatus")), ", ").alias("offenders"), F.count(F.lit(1)).alias("n"))


@QUERIES.add("b10_full_match", "SELECT c_custkey, regexp_full_match(c_name, 'Customer#[0-9]+') AS named FROM customer")
def b10(s, d):
    return table(s, d, "customer").select("c_custkey", F.regexp_like("c_name", F.lit("^Customer#[0-9]+$")).alias("named"))


@QUERIES.add("b11_unit_scaling", "SELECT o_orderkey, o_totalprice * 1000 AS scaled FROM orders")
def b11(s, d):
    return table(s, d, "orders").select("o_orderkey", numbers.scaled("o_totalprice", 1000.0).alias("scaled"))


@QUERIES.add("b12_classify_revenue", """
SELECT c_custkey, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'PIT' WHEN 'BUILDING' THEN 'CIT' WHEN 'FURNITURE' THEN 'Own-source revenue' WHEN 'HOUSEHOLD' THEN 'Transfers from other budgets' END AS concept FROM customer""")
def b12(s, d):
    """Codes and names made of customers' names: by a code's suffix, else by what the name says."""
    segment = F.col("c_mktsegment")
    code = F.concat_ws(" ", "c_name", F.when(segment == "AUTOMOBILE", "10102000010000110").when(segment == "FURNITURE", "10000000000000000").otherwise("1"))
    name = F.concat_ws(" ", "c_name", F.when(segment == "BUILDING", "Corporate INCOME tax").when(segment == "HOUSEHOLD", "Transfers from other budgets"))
    return table(s, d, "customer").select("c_custkey", text.classify_revenue(code, name).alias("concept"))


@QUERIES.add("b13_status_labels", "SELECT region_id, section, period, CASE WHEN flow < 0 THEN 'negative' WHEN flow > 1000000 THEN 'large' ELSE 'ordinary' END AS status FROM receipts", "receipts")
def b13(s, d):
    return q_receipts(s, d).select("region_id", "section", "period", F.when(F.col("flow") < 0, "negative").when(F.col("flow") > 1000000, "large").otherwise("ordinary").alias("status"))


@QUERIES.add("b14_calendar_predicates", """
SELECT o_orderkey, o = last_day(o) AS month_end, o = last_day(date_trunc('quarter', o) + INTERVAL 2 MONTH) AS quarter_end, o = date_trunc('month', o) AS month_start FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS o FROM orders)""")
def b14(s, d):
    df = table(s, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("o"))
    return df.select("o_orderkey", cal.is_month_end("o").alias("month_end"), cal.is_quarter_end("o").alias("quarter_end"), cal.is_month_start("o").alias("month_start"))


@QUERIES.add("b15_alias_selection", "SELECT c_custkey, c_nationkey AS region_id FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE upper(n_name) IN (SELECT upper(n_name) FROM nation WHERE n_nationkey = 3) OR n_nationkey = 5)")
def b15(s, d):
    nations = table(s, d, "nation").select(F.col("n_nationkey").alias("region_id"), F.array(F.lower("n_name"), F.col("n_nationkey").cast("string")).alias("aliases"))
    name = table(s, d, "nation").filter("n_nationkey = 3").first()["n_name"]
    return filters.selected(table(s, d, "customer").select("c_custkey", F.col("c_nationkey").alias("region_id")), nations, [name.upper(), "5"])


@QUERIES.add("b16_prefix_rename", "SELECT region_id, period AS prior_period, flow AS prior_flow FROM receipts", "receipts")
def b16(s, d):
    return filters.prefixed(q_receipts(s, d).select("region_id", "period", "flow"), "prior_", ["period", "flow"])


@QUERIES.add("b17_basename", "SELECT page_id, CAST(page_id AS VARCHAR) || '.html' AS name FROM pages")
def b17(s, d):
    path = F.concat(F.lit("C:\\raw/2026\\"), F.col("page_id").cast("string"), F.lit(".html"))
    return table(s, d, "pages").select("page_id", text.basename(path).alias("name"))


@QUERIES.add("b18_large_moves", "SELECT event_id, value IS NOT NULL AND abs(value) > 10 AND NOT abs(abs(value) - 10) <= 1e-10 AS flag FROM events")
def b18(s, d):
    return table(s, d, "events").select("event_id", numbers.large_move("value").alias("flag"))


#: SQL of the shapes that must not be published, as in functions.text.
SENSITIVE_SQL = {
    "github_token": r"(?i)gh[pousr]_[A-Za-z0-9]{20,}", "github_pat": r"(?i)github_pat_[A-Za-z0-9_]{20,}", "sk_token": r"(?i)sk-(?:proj-)?[A-Za-z0-9_-]{24,}", "access_key": r"(?i)AKIA[A-Z0-9]{16}",
    "private_key": r"(?i)-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----", "user_info_url": r"(?i)https?://[^\s/]+:[^\s/@]+@", "signed_url": r"(?i)[?&](?:access_token|token|api_key|signature|X-Amz-Signature)=[^\s&]+",
    "machine_path": r"/(?:Users|home|private|tmp|var/folders)/|(?:^|[^A-Za-z0-9])[A-Za-z]:[\\/]",
}


@QUERIES.add("b19_sensitive_scan", "SELECT doc_id, " + ", ".join(f"coalesce(regexp_matches(text, '{shape}'), false) AS {name}" for name, shape in SENSITIVE_SQL.items()) + " FROM documents")
def b19(s, d):
    return table(s, d, "documents").select("doc_id", *[c.alias(n) for n, c in text.sensitive("text").items()])


@QUERIES.add("h01_clean_text", r"SELECT c_custkey, trim(regexp_replace(lower(c_name || '  X  y '), '\s+', ' ', 'g')) AS t FROM customer")
def h01(s, d):
    return table(s, d, "customer").select("c_custkey", text.clean_text(F.concat("c_name", F.lit("  X  y "))).alias("t"))


@QUERIES.add("h02_name_key", r"SELECT doc_id, sha256(regexp_replace(replace(replace(lower(nfc_normalize(text)), 'ß', 'ss'), 'ё', 'е'), '[\s\x{00A0}.\-–—]+', '', 'g')) AS k FROM documents")
def h02(s, d):
    return table(s, d, "documents").select("doc_id", F.sha2(text.name_key("text"), 256).alias("k"))


@QUERIES.add("h03_latin_section", "SELECT o_orderkey, upper(trim(o_orderpriority)) AS section FROM orders")
def h03(s, d):
    """Priorities spelt with look-alike letters, in lower case and between blanks."""
    odd = F.concat(F.lit(" "), F.lower(F.translate("o_orderpriority", text.LATIN_SECTIONS, text.CYRILLIC_SECTIONS)), F.lit(" "))
    return table(s, d, "orders").select("o_orderkey", text.latin_section(odd).alias("section"))


@QUERIES.add("h04_code_keys", "SELECT o_orderkey, CAST(o_orderkey % 100 AS VARCHAR) AS k, lpad(CAST(o_orderkey % 100 AS VARCHAR), 4, '0') AS padded FROM orders")
def h04(s, d):
    code = (F.col("o_orderkey") % 100).cast("string")
    return table(s, d, "orders").select("o_orderkey", text.code_key(F.lpad(code, 6, "0")).alias("k"), text.pad_code(code, 4).alias("padded"))


@QUERIES.add("h05_code_suffix", "SELECT c_custkey, regexp_replace(c_name, '[^0-9]', '', 'g') AS digits, suffix(regexp_replace(c_name, '[^0-9]', '', 'g'), '7') AS sevens FROM customer")
def h05(s, d):
    return table(s, d, "customer").select("c_custkey", text.digits("c_name").alias("digits"), text.code_endswith("c_name", "7").alias("sevens"))


@QUERIES.add("h06_join_code_parts", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber <> 3 THEN CAST(l_partkey AS VARCHAR) || CAST(l_suppkey AS VARCHAR) END AS code FROM lineitem")
def h06(s, d):
    cells = F.array(F.lit("name"), F.when(F.col("l_linenumber") == 3, "x").otherwise(F.col("l_partkey").cast("string")), F.col("l_suppkey").cast("string"))
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", text.join_code_parts(cells, 2, 2).alias("code"))


@QUERIES.add("h07_parse_decimal", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(CAST(o_totalprice AS DECIMAL(20,2)) AS DOUBLE) END AS amount FROM orders")
def h07(s, d):
    shown = F.replace(F.replace(F.format_number("o_totalprice", 2), F.lit(","), F.lit(" ")), F.lit("."), F.lit(","))
    raw = F.when(F.col("o_orderkey") % 5 == 0, "…").otherwise(shown)
    return table(s, d, "orders").select("o_orderkey", numbers.parse_decimal(raw).cast("double").alias("amount"))


@QUERIES.add("h08_window_month", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 AND (o_orderstatus <> 'P' OR month(o_orderdate) = 1) THEN month(o_orderdate) END AS m FROM orders")
def h08(s, d):
    """Headers of the orders' months: a window from January on, or a month by itself, which only January is a window of; a year before it makes it none."""
    month = F.element_at(F.array(*map(F.lit, text.MONTHS_RU)), F.month("o_orderdate"))
    header = F.when((F.col("o_orderstatus") == "P") | (F.month("o_orderdate") == 1), month).otherwise(F.concat(F.lit("Январь – "), month, F.dayofmonth("o_orderdate").cast("string")))
    dated = F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.year("o_orderdate").cast("string"), F.lit(" "), header)).otherwise(header)
    return table(s, d, "orders").select("o_orderkey", text.window_month(dated).cast("long").alias("m"))


@QUERIES.add("h09_slots", "SELECT o_orderkey, CAST(year(o_orderdate) * 12 + month(o_orderdate) AS INT) AS month_slot, CAST(year(o_orderdate) * 4 + quarter(o_orderdate) AS INT) AS quarter_slot FROM orders")
def h09(s, d):
    return table(s, d, "orders").select("o_orderkey", cal.slot("o_orderdate", F.lit("monthly")).alias("month_slot"), cal.slot("o_orderdate", F.lit("quarterly")).alias("quarter_slot"))


@QUERIES.add("h10_shift_period", "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) + INTERVAL 12 MONTH AS DATE) AS later, CAST(last_day(CAST(o_orderdate AS DATE) + INTERVAL 3 MONTH) AS DATE) AS month_end FROM orders")
def h10(s, d):
    o = F.to_date("o_orderdate")
    return table(s, d, "orders").select("o_orderkey", cal.shift_period(o, 12).alias("later"), cal.shift_period(o, 3, "month_end").alias("month_end"))


@QUERIES.add("h11_parse_date", "SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderdate AS DATE) END AS parsed, strftime(o_orderdate, '%m(%Y)') AS sheet FROM orders")
def h11(s, d):
    name = F.concat(F.lit("report_"), F.when(F.col("o_orderkey") % 7 == 0, "31.02.2020").otherwise(F.date_format("o_orderdate", "dd.MM.yyyy")), F.lit(".zip"))
    return table(s, d, "orders").select("o_orderkey", cal.parse_date(name).alias("parsed"), F.date_format("o_orderdate", "MM(yyyy)").alias("sheet"))


@QUERIES.add("h12_safe_growth", "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN (5000 / c_acctbal - 1) * 100 END AS growth FROM customer")
def h12(s, d):
    return table(s, d, "customer").select("c_custkey", numbers.safe_growth(F.lit(5000.0), "c_acctbal").alias("growth"))


@QUERIES.add("h13_shares", "SELECT s_suppkey, CASE WHEN 10000 > 0 THEN s_acctbal / 10000 * 100 END AS share_pct, CASE WHEN s_acctbal > 0 THEN 100 / s_acctbal * 100 END AS contribution_pp FROM supplier")
def h13(s, d):
    return table(s, d, "supplier").select("s_suppkey", numbers.share("s_acctbal", F.lit(10000.0)).alias("share_pct"), numbers.growth_of_change(F.lit(100.0), "s_acctbal").alias("contribution_pp"))


@QUERIES.add("h14_within", "SELECT s_suppkey, abs(s_acctbal - 5000) <= 1000 AS near, isfinite(s_acctbal) AS finite FROM supplier")
def h14(s, d):
    return table(s, d, "supplier").select("s_suppkey", numbers.within("s_acctbal", F.lit(5000.0), 1000.0).alias("near"), numbers.is_finite("s_acctbal").alias("finite"))


@QUERIES.add("h15_content_hash", "SELECT doc_id, sha256(text) AS sha256, 'src_' || substr(sha256(text), 1, 12) AS short_id FROM documents")
def h15(s, d):
    return table(s, d, "documents").select("doc_id", lineage.content_hash("text").alias("sha256"), lineage.short_id("src_", "text").alias("short_id"))


@QUERIES.add("h16_evidence", "SELECT s_suppkey, 1 + CAST(s_suppkey % 2 = 0 AS INT) AS n_sources, s_name AS first_file FROM supplier")
def h16(s, d):
    df = table(s, d, "supplier").select("s_suppkey", F.struct(F.col("s_name").alias("file")).alias("a"), F.when(F.col("s_suppkey") % 2 == 0, F.struct(F.lit("other").alias("file"))).alias("b"))
    found = lineage.sources_of(F.col("a"), F.col("a"), F.col("b"))
    return df.select("s_suppkey", F.size(found).alias("n_sources"), F.get(found, F.lit(0))["file"].alias("first_file"))


@QUERIES.add("h17_issue_list", """
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity > 25 AND l_discount > 0.05 THEN 'large;cheap' WHEN l_quantity > 25 THEN 'large' WHEN l_discount > 0.05 THEN 'cheap' ELSE 'matched' END AS issues FROM lineitem""")
def h17(s, d):
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", lineage.issue_list((F.col("l_quantity") > 25, "large"), (F.col("l_discount") > 0.05, "cheap")).alias("issues"))


@QUERIES.add("h18_calendar_reindex", """
, b AS (SELECT region_id, date_trunc('month', min(period)) AS a, max(period) AS z FROM prices GROUP BY ALL), c AS (SELECT region_id, CAST(last_day(unnest(generate_series(CAST(a AS DATE), z, INTERVAL 1 MONTH))) AS DATE) AS period FROM b)
SELECT region_id, count(*) AS n_months, max(period) AS last_month FROM c WHERE period <= (SELECT last_day(max(period)) FROM prices) GROUP BY region_id""", "prices")
def h18(s, d):
    span = p.prices(s, d).groupBy("region_id").agg(F.min("period").alias("a"), F.last_day(F.max("period")).alias("z"))
    return span.select("region_id", F.explode(cal.calendar("a", "z")).alias("period")).groupBy("region_id").agg(F.count(F.lit(1)).alias("n_months"), F.max("period").alias("last_month"))


@QUERIES.add("h19_territory_scope", """
SELECT s_suppkey, CASE WHEN s_suppkey % 10 = 0 THEN 'national' WHEN s_nationkey % 4 = 0 THEN 'federal_district' WHEN s_suppkey % 3 = 0 OR s_nationkey % 4 = 1 THEN 'region' ELSE 'surveyed_city' END AS scope FROM supplier""")
def h19(s, d):
    """Suppliers as territories: codes of their keys, names of their names."""
    key = F.col("s_suppkey").cast("string")
    code = F.when(F.col("s_suppkey") % 10 == 0, "643").when(F.col("s_suppkey") % 3 == 0, F.concat(key, F.lit("00000000"))).otherwise(F.concat(F.lit("45"), key, F.lit("1")))
    kind = F.col("s_nationkey") % 4
    name = F.concat_ws(" ", "s_name", F.when(kind == 0, "Федеральный округ").when(kind == 1, "автономный округ"))
    return table(s, d, "supplier").select("s_suppkey", text.territory_scope(code, name).alias("scope"))


@QUERIES.add("h20_json_array", "SELECT s_suppkey, '[\"' || s_name || '\",\"x\"]' AS j FROM supplier")
def h20(s, d):
    return table(s, d, "supplier").select("s_suppkey", text.json_array(F.array("s_name", F.lit("x"))).alias("j"))
