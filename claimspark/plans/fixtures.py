"""Claims, documents, pages and replies that are derived from the star schema and the text table, by integer arithmetic only.

The SELECT texts run in Spark and, with the other engine's spelling of integer division, in the oracle's SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimspark.operators.records import parse_claim_lines
from claimspark.session import no_rows

LINES_PER_PAGE = 3

FX_DOCUMENTS = """select s_suppkey * 2 + v as doc_id, 'doc-' || cast(s_suppkey * 2 + v as string) || '.pdf' as filename, cast(null as string) as title,
case when v = 0 then s_name else s_name || ' Ltd.' end as publisher,
case when s_suppkey % 11 = 10 then null when v = 0 then '2002-05' else 'March 12, 2003' end as published_at, s_nationkey, s_suppkey, v
from supplier cross join (select 0 as v union all select 1 as v) vs"""

FX_NUMBERS = """select d.doc_id * 1000 + (b.fy - 1990) as claim_id, d.doc_id, 1 as page_no, d.s_nationkey, b.fy, d.v, d.s_suppkey + d.v as k,
case when d.v = 0 then n_name else n_name || ' Limited' end as subject, n_name,
case when (d.s_suppkey + d.v) % 4 = 2 then b.cents + b.cents {div} 50 when (d.s_suppkey + d.v) % 4 = 3 then b.cents - b.cents {div} 100 else b.cents end as c
from fx_documents d join nation on n_nationkey = d.s_nationkey
join (select s_nationkey, year(l_shipdate) + case when month(l_shipdate) >= 4 then 1 else 0 end as fy, sum(cast(round(l_extendedprice * 100) as bigint)) as cents
from lineitem join supplier on l_suppkey = s_suppkey group by 1, 2) b on b.s_nationkey = d.s_nationkey where b.fy between 1995 and 2002"""

FX_CLAIMS = """select claim_id, doc_id, page_no, subject, case when v = 0 then 'revenue' else 'revenues' end as metric_raw,
case when k % 7 = 3 then 'Truckload revenue' else 'Revenue from operations' end as label,
case when k % 3 = 0 then cast((c + 500000) {div} 1000000 {div} 100 as string) || '.' || lpad(cast((c + 500000) {div} 1000000 % 100 as string), 2, '0')
when k % 3 = 1 then cast((c + 50000) {div} 100000 {div} 100 as string) || '.' || lpad(cast((c + 50000) {div} 100000 % 100 as string), 2, '0')
else cast((c + 50000) {div} 100000 as string) end as value_raw,
case when k % 3 = 0 then 'INR million' when k % 3 = 1 then 'Rs. lakh' else 'INR thousand' end as unit_raw,
case (fy + k) % 6 when 0 then 'FY' || cast(fy as string) when 1 then cast(fy - 1 as string) || '-' || cast(fy as string) when 2 then 'FY' || cast(fy - 1 as string) || '/' || cast(fy as string)
when 3 then 'year ended March 31, ' || cast(fy as string) when 4 then 'for the year ended 31 March ' || cast(fy as string) else 'FY ' || cast(fy as string) end as period_raw,
case (k {div} 3) % 3 when 0 then 'consolidated' when 1 then 'standalone' end as scope_raw,
case k % 5 when 1 then 'provisional' when 2 then 'advance_estimate' when 3 then 'projection' else 'actual' end as basis_raw,
'Revenue was ' || n_name as quote, case when v = 0 then 'N' || cast(s_nationkey as string) end as cin, 'verified' as status, s_nationkey, fy, k, v from fx_numbers"""

FX_STATES = """select o_orderkey as claim_id, o_orderkey % (select count(*) from fx_documents) + (select min(doc_id) from fx_documents) as doc_id, 1 as page_no,
case when o_custkey % 2 = 1 then c_name else 'Mr. ' || c_name end as subject, 'order_status' as metric_raw, 'Order status' as label, o_orderstatus as value_raw, cast(null as string) as unit_raw,
substr(cast(o_orderdate as string), 1, 10) as period_raw, cast(null as string) as scope_raw, 'actual' as basis_raw, 'status ' || o_orderstatus as quote, cast(o_custkey as string) as din, 'verified' as status, o_custkey, c_name
from orders join customer on o_custkey = c_custkey"""

STAR = ("supplier", "nation", "lineitem", "orders", "customer", "part", "documents")


def _spark_sql(text: str) -> str:
    return text.format(div="div") if "{div}" in text else text


def oracle_ctes() -> str:
    """The same tables as common table expressions of the oracle."""
    tables = (("fx_documents", FX_DOCUMENTS), ("fx_numbers", FX_NUMBERS), ("fx_claims", FX_CLAIMS), ("fx_states", FX_STATES))
    return "with " + ",\n".join(f"{name} as ({sql.format(div='//')})" for name, sql in tables)


class Fixtures:
    """Derived tables of one folder, each built when it is asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{table}.parquet")

    def documents(self) -> DataFrame:
        return self.spark.sql(FX_DOCUMENTS.replace("from supplier", "from {supplier}"), supplier=self.read("supplier"))

    def claims(self) -> DataFrame:
        """Figures: revenue by nation and fiscal year, as each of the nation's suppliers prints it."""
        numbers = _spark_sql(FX_NUMBERS).replace("from fx_documents", "from {fx_documents}").replace("join nation on", "join {nation} nation on").replace("from lineitem join supplier on", "from {lineitem} lineitem join {supplier} supplier on")
        rows = self.spark.sql(numbers, fx_documents=self.documents(), nation=self.read("nation"), lineitem=self.read("lineitem"), supplier=self.read("supplier"))
        rows = self.spark.sql(_spark_sql(FX_CLAIMS).replace("from fx_numbers", "from {fx_numbers}"), fx_numbers=rows)
        return rows.withColumn("keys", F.when(F.col("cin").isNotNull(), F.create_map(F.lit("cin"), "cin")).otherwise(F.create_map().cast("map<string,string>"))).drop("cin", "s_nationkey", "fy", "k", "v")

    def states(self) -> DataFrame:
        """States: each order's status, of its customer."""
        docs = self.documents()
        sql = FX_STATES.replace("fx_documents", "{fx_documents}").replace("from orders join customer on", "from {orders} orders join {customer} customer on")
        rows = self.spark.sql(sql, fx_documents=docs, orders=self.read("orders"), customer=self.read("customer"))
        return rows.withColumn("keys", F.create_map(F.lit("din"), "din")).drop("din", "o_custkey", "c_name")

    def aliases(self) -> DataFrame:
        return no_rows(self.spark, "alias string, key string, source string")

    def pages(self) -> DataFrame:
        """Documents' texts, three lines to a page, some with declarations on top."""
        rows = self.read("documents").select("doc_id", F.split(F.coalesce("text", F.lit("")), "\n").alias("l"))
        rows = rows.select("doc_id", "l", F.explode(F.sequence(F.lit(1), F.ceil(F.size("l") / LINES_PER_PAGE).cast("int"))).alias("page_no"))
        body = F.array_join(F.slice("l", (F.col("page_no") - 1) * LINES_PER_PAGE + 1, F.lit(LINES_PER_PAGE)), "\n")
        units = F.when(F.col("doc_id") % 4 == 0, "(All amounts in Indian Rupees in million)\n").otherwise("")
        scope = F.when(F.col("doc_id") % 6 == 0, "Standalone Balance Sheet as at March 31, 2024\n").otherwise("")
        return rows.select("doc_id", "page_no", F.concat(units, scope, body).alias("text"), F.element_at("l", (F.col("page_no") - 1) * LINES_PER_PAGE + 1).alias("first_line"))

    def paged_documents(self) -> DataFrame:
        return self.pages().groupBy("doc_id").agg(F.max("page_no").alias("page_count"))

    def quotes(self) -> DataFrame:
        """A quote for each page whose first line has three words and more, cited on its own page, beside it, or out of range."""
        words = F.split(F.trim(F.regexp_replace("first_line", r"\s+", " ")), " ")
        rows = self.pages().withColumn("w", words).where(F.size("w") >= 3)
        quote = F.concat(F.array_join(F.slice("w", 1, 6), " "), F.when(F.col("doc_id") % 7 == 0, " 98765").otherwise(""))
        return rows.select((F.col("doc_id") * 10_000 + F.col("page_no")).alias("claim_id"), "doc_id", (F.col("page_no") + F.col("doc_id") % 4 - 1).cast("int").alias("page_no"), quote.alias("quote"), F.lit("unverified").alias("status"))

    def resumed_replies(self) -> tuple[DataFrame, DataFrame]:
        """A slice of pages 1 to 8 for each document, and parsed replies to requests from each page on: they hold doc_id % 9 pages, 0 being cut off at once and 8 all; every eleventh document has none."""
        docs = self.documents().select("doc_id", (F.col("doc_id") % 9).alias("w"))
        rows = docs.where("doc_id % 11 <> 5").select("doc_id", "w", F.explode(F.sequence(F.lit(1), F.lit(8))).alias("start"))
        end = F.when(F.col("w") == 0, F.col("start") - 1).otherwise(F.least(F.col("start") + F.col("w") - 1, F.lit(8)))
        rows = rows.withColumn("end", end.cast("int")).withColumn("pages", F.filter(F.sequence(F.lit(1), F.lit(8)), lambda p: (p >= F.col("start")) & (p <= F.col("end"))))
        line = F.transform("pages", lambda p: F.to_json(F.struct(F.lit("claim").alias("type"), p.alias("page"), F.lit("revenue").alias("metric"), F.lit("q").alias("quote"))))
        replies = rows.select("doc_id", "start", F.array_join(line, "\n").alias("text"), F.when(F.col("end") < 8, "MAX_TOKENS").otherwise("STOP").alias("finish_reason"))
        return docs.select("doc_id", F.lit(1).alias("first"), F.lit(8).alias("last")), parse_claim_lines(replies)

    def responses(self) -> DataFrame:
        """Claims of a document as JSON lines, between fences; some with a bad line, some cut off."""
        fields = F.struct(F.lit("claim").alias("type"), F.substring("period_raw", -2, 2).cast("int").alias("page"), "subject", F.col("metric_raw").alias("metric"), "label", F.col("value_raw").alias("value"), F.col("unit_raw").alias("unit"), F.col("period_raw").alias("period"), F.col("scope_raw").alias("scope"), F.col("basis_raw").alias("basis"), "quote", "keys")
        lines = self.claims().groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("claim_id", F.to_json(fields).alias("j")))), lambda x: x["j"]), "\n").alias("j"))  # eight years at most
        bad = F.when(F.col("doc_id") % 5 == 0, "not json\n").otherwise("")
        return lines.select("doc_id", F.lit(1).alias("response_id"), F.concat(F.lit("```json\n"), bad, "j", F.lit("\n```")).alias("text"), F.when(F.col("doc_id") % 9 == 0, "MAX_TOKENS").otherwise("STOP").alias("finish_reason"))
