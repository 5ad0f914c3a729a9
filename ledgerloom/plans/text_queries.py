"""Queries over the scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import taxid, text
from ..operators import classify, config, geometry
from .catalogue import query, table

BLANK = text.BLANK


@query(r"SELECT doc_id, trim(regexp_replace(lower(strip_accents(coalesce(text, ''))), '[^a-z0-9]+', ' ', 'g')) AS normal FROM documents")
def norm_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.norm(F.col("text")).alias("normal"))


@query(f"SELECT conv_id, turn, trim(regexp_replace(coalesce(text, ''), '{BLANK}+', ' ', 'g')) AS squished FROM conversations")
def squish_text(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", text.squish(F.col("text")).alias("squished"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(CAST(l_extendedprice AS DECIMAL(20,2)) AS DOUBLE) AS amount, true AS numeric,
  CAST(NULL AS DOUBLE) AS not_an_amount FROM lineitem""")
def parse_amount(spark, sf):
    """Half of the amounts with the no-break spaces that printed forms have."""
    blank = F.when(F.col("l_linenumber") % 2 == 0, F.lit("\u00a0")).otherwise(F.lit(" "))
    price = F.concat(blank, F.lit("$"), blank, text.printed(F.col("l_extendedprice").cast("decimal(20,2)"), 2))
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        text.to_number(price).cast("double").alias("amount"), text.is_numeric(price).alias("numeric"),
        text.to_number(F.concat(price, F.lit(" 1.234"))).cast("double").alias("not_an_amount"),
    )


@query(f"""SELECT doc_id, CAST(count(*) FILTER (WHERE regexp_matches(w, '^-?\\$?{BLANK}*\\d{{1,3}}(\\.\\d{{3}})*(,\\d+)?$|^-?\\$?{BLANK}*\\d+(,\\d+)?$')) AS BIGINT) AS amounts, count(*) AS words
  FROM (SELECT doc_id, unnest(list_filter(string_split_regex(coalesce(text, '') || ' $\u00a01.000 -$\u00a0\u20037,5 $\u00a0x 12\u00a0500', '[ \t\n\r]+'), lambda x: x <> '')) AS w FROM documents) GROUP BY doc_id""")
def numeric_words(spark, sf):
    whole = F.concat(F.coalesce("text", F.lit("")), F.lit(" $\u00a01.000 -$\u00a0\u20037,5 $\u00a0x 12\u00a0500"))
    words = F.filter(F.split(whole, "[ \t\n\r]+"), lambda w: w != "")
    return table(spark, sf, "documents").select("doc_id", F.explode(words).alias("w")).groupBy("doc_id").agg(F.count_if(text.is_numeric(F.col("w"))).alias("amounts"), F.count("*").alias("words"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(year(l_shipdate) * 10000 + month(l_shipdate) * 100 + day(l_shipdate) AS INTEGER) AS key, CAST(20263199 AS INTEGER) AS off_calendar FROM lineitem")
def date_key(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        text.date_key(F.date_format("l_shipdate", "dd/MM/yyyy")).alias("key"), text.date_key(F.lit("99/31/2026")).alias("off_calendar"),
    )


@query("""WITH d AS (SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS b FROM customer),
s AS (SELECT c_custkey, b, list_sum(list_transform(range(1, len(b) + 1), lambda i: CAST(b[len(b) - i + 1] AS INTEGER) * ((i - 1) % 6 + 2))) AS s FROM d),
r AS (SELECT c_custkey, b, 11 - CAST(s AS BIGINT) % 11 AS r FROM s)
SELECT c_custkey, CASE r WHEN 11 THEN '0' WHEN 10 THEN 'K' ELSE CAST(r AS VARCHAR) END AS digit, true AS printed_is_valid,
  lpad(b, 3, '0') AS body_of_printed, false AS wrong_is_valid FROM r""")
def check_digit(spark, sf):
    digit = taxid.check_digit(F.col("c_custkey"))
    body = F.lpad(F.col("c_custkey").cast("string"), 3, "0")
    printed = taxid.tax_id(F.concat_ws("-", text.printed(F.col("c_custkey") + 1_000_000), taxid.check_digit(F.col("c_custkey") + 1_000_000)))
    wrong = taxid.tax_id(F.concat_ws("-", text.printed(F.col("c_custkey") + 1_000_000), F.when(taxid.check_digit(F.col("c_custkey") + 1_000_000) == "7", "8").otherwise("7")))
    return table(spark, sf, "customer").select("c_custkey", digit.alias("digit"), printed["valid"].alias("printed_is_valid"), body.alias("body_of_printed"), wrong["valid"].alias("wrong_is_valid"))


_NAME = "list_filter(string_split_regex(trim(regexp_replace(coalesce(text, ''), '[^A-Za-z ]+', '', 'g')), ' +'), lambda x: x <> '')[1:CAST(doc_id % 6 AS INTEGER)]"


@query(f"""SELECT doc_id, coalesce(w[1], '') AS paternal, CASE WHEN len(w) > 2 THEN w[2] ELSE '' END AS maternal,
  CASE WHEN len(w) > 2 THEN array_to_string(w[3:], ' ') ELSE coalesce(w[2], '') END AS given FROM (SELECT doc_id, {_NAME} AS w FROM documents)""")
def split_name(spark, sf):
    words = F.filter(F.split(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z ]+", "")), " +"), lambda w: w != "")
    some = F.slice(words, 1, (F.col("doc_id") % 6).cast("int"))
    name = F.when(F.col("doc_id") % 2 == 0, F.array_join(some, "\u00a0")).otherwise(F.array_join(some, " \u2003"))
    return table(spark, sf, "documents").select("doc_id", taxid.split_name(name).alias("n")).select("doc_id", "n.*")


@query("""SELECT c_custkey, regexp_matches(upper(c_mktsegment) || ' ' || (['DE', 'LOS', 'Y', 'RIO', 'SANTA', 'DELL'])[CAST(c_custkey % 6 AS INTEGER) + 1], '(?i)\\s(DE|DEL|LA|LAS|LOS|Y|SAN|SANTA|DA|DOS|VON|VAN|MC|SAINT)$') AS unfinished FROM customer""".replace("\\\\", "\\"))
def unfinished_name(spark, sf):
    last = F.get(F.array(*map(F.lit, ["DE", "LOS", "Y", "RIO", "SANTA", "DELL"])), (F.col("c_custkey") % 6).cast("int"))
    return table(spark, sf, "customer").select("c_custkey", taxid.unfinished_name(F.concat_ws(" ", F.upper("c_mktsegment"), last)).alias("unfinished"))


@query("""SELECT o_orderkey, CAST(month(o_orderdate) AS INTEGER) AS month, CAST(year(o_orderdate) AS INTEGER) AS year, strftime(o_orderdate, '%m/%Y') AS text,
  CAST(month(o_orderdate) AS VARCHAR) || CAST(year(o_orderdate) AS VARCHAR) AS code FROM orders""")
def printed_period(spark, sf):
    line = F.concat(F.lit("Periodo: "), F.date_format("o_orderdate", "MM/yyyy"), F.lit(" Ord. 3673/01"))
    return table(spark, sf, "orders").select("o_orderkey", text.period(line).alias("p")).select("o_orderkey", "p.*")


@query(r"""SELECT doc_id, nullif(regexp_extract(text, '\d+\.\d+\.\d+\.\d+', 0), '') AS first_address, nullif(regexp_extract(text, '\((\d{3})\) 555', 1), '') AS area FROM documents""")
def first_match(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.first_match(F.col("text"), r"\d+\.\d+\.\d+\.\d+").alias("first_address"), text.first_match(F.col("text"), r"\((\d{3})\) 555", 1).alias("area"))


@query("SELECT o_orderkey, replace(format('{:,}', CAST(round(o_totalprice) AS BIGINT)), ',', '.') AS printed FROM orders")
def printed_amount(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", text.printed(F.round("o_totalprice").cast("long")).alias("printed"))


@query("SELECT page_id, substr(sha256(coalesce(html, '')), 1, 16) AS digest FROM pages")
def short_digest(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.short_digest(F.coalesce("html", F.lit("")).cast("binary")).alias("digest"))


@query(r"""SELECT doc_id, regexp_matches(t, '^\d{1,3}(\.\d{3})*-[\dkK]$') OR regexp_matches(t, '^-?\$?\s*\d{1,3}(\.\d{3})*(,\d+)?$|^-?\$?\s*\d+(,\d+)?$') OR ends_with(t, ':')
  OR regexp_matches(t, '^[A-Za-z0-9]{6,}(\s*-\s*[A-Za-z0-9]{2,})+$') AS is_value
  FROM (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '1.234.567' WHEN 1 THEN 'Periodo:' WHEN 2 THEN 'ABCDEF12 - 34 - XY' WHEN 3 THEN '9.068.054-' || CAST(doc_id % 10 AS VARCHAR) ELSE lang END AS t FROM documents)""")
def header_values(spark, sf):
    k = F.col("doc_id") % 5
    t = F.when(k == 0, "1.234.567").when(k == 1, "Periodo:").when(k == 2, "ABCDEF12 - 34 - XY").when(k == 3, F.concat(F.lit("9.068.054-"), (F.col("doc_id") % 10).cast("string"))).otherwise(F.col("lang"))
    return table(spark, sf, "documents").select("doc_id", text.is_value(t).alias("is_value"))


@query(r"""WITH k AS (SELECT p_partkey, [p_brand || ' ' || p_type || ' ' || p_name, p_type || ' ' || p_name, p_name] AS k, p_brand || ' > ' || p_type || ' > ' || p_name AS label FROM part)
SELECT p_partkey, label, array_to_string(list_transform(k, lambda x: trim(regexp_replace(lower(strip_accents(x)), '[^a-z0-9]+', ' ', 'g'))), '|') AS keys FROM k""")
def heading_keys(spark, sf):
    above = F.array("p_brand", "p_type")
    return table(spark, sf, "part").select("p_partkey", F.array_join(F.concat(above, F.array("p_name")), " > ").alias("label"), F.array_join(geometry.search_keys(above, F.col("p_name")), "|").alias("keys"))


@query(r"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x)), lambda x: x <> '')[2:7] AS l FROM documents)
SELECT doc_id, array_to_string(list_filter(l, lambda x: length(x) <= 60 AND NOT regexp_matches(x, '(?i)^(per[íi]odo|n[úu]mero de folio|folio|rut|identificaci[oó]n|direcci[oó]n|nombre o raz[oó]n|tel[eé]fono|comuna)') AND NOT regexp_matches(x, '^[A-Za-z0-9]{6,}(\s*-\s*[A-Za-z0-9]{2,})+$'))[1:3], chr(10)) AS lines FROM l""")
def institution_lines(spark, sf):
    return table(spark, sf, "documents").select("doc_id", classify.institution_lines(F.coalesce("text", F.lit(""))).alias("lines"))


@query("""WITH n AS (SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'Caja de Compensación Los Andes' WHEN 1 THEN 'Caja de compensacion 18 de Septiembre' WHEN 2 THEN n_name END AS s FROM nation)
SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'CAJA LOS ANDES' WHEN 1 THEN 'CAJA 18 DE SEPTIEMBRE' WHEN 2 THEN s ELSE '' END AS short, CAST(CASE n_nationkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 4 END AS INTEGER) AS code FROM n""")
def institution_codes(spark, sf):
    k = F.col("n_nationkey") % 4
    name = F.when(k == 0, "Caja de Compensación Los Andes").when(k == 1, "Caja de compensacion 18 de Septiembre").when(k == 2, F.col("n_name"))
    return table(spark, sf, "nation").select("n_nationkey", classify.short_fund(name).alias("short"), classify.code_of(name, config.FUND_CODES, "^caja de compensacion ").alias("code"))


@query("""SELECT l_orderkey, min(l_linenumber) FILTER (WHERE l_returnflag = 'R') AS header, (SELECT min(b.l_linenumber) FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_returnflag = 'N' AND b.l_linenumber > (SELECT min(c.l_linenumber) FROM lineitem c WHERE c.l_orderkey = a.l_orderkey AND c.l_returnflag = 'R')) AS data
  FROM lineitem a WHERE l_orderkey IS NOT NULL GROUP BY l_orderkey""")
def header_and_data_rows(spark, sf):
    rows = table(spark, sf, "lineitem").where("l_orderkey is not null").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_returnflag"))).alias("rows"))
    header = geometry.head(F.filter("rows", lambda r: r["l_returnflag"] == "R"))["l_linenumber"]
    rows = rows.withColumn("header", header)
    data = geometry.head(F.filter("rows", lambda r: (r["l_returnflag"] == "N") & (r["l_linenumber"] > F.col("header"))))["l_linenumber"]
    return rows.select("l_orderkey", "header", data.alias("data"))


@query("SELECT event_id, CAST(least(99, round((event_id % 20 + (user_id % 10) / 10) / 20 * 100)) AS INTEGER) AS percent FROM events")
def progress_percent(spark, sf):
    return table(spark, sf, "events").select("event_id", text.progress(F.col("event_id") % 20 + 1, F.lit(20), F.col("user_id") % 10, F.lit(10)).alias("percent"))
