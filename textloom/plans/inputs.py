"""Inputs in the shape of the filings domain, made from the given tables by the same rule in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


FORM = "case o_orderpriority when '1-URGENT' then '10K' when '2-HIGH' then '10Q' when '3-MEDIUM' then '8K' when '4-NOT SPECIFIED' then 'DEF14A' else '13D' end"
#: A tail of layout lines, so that every line filter has work.
JUNK = "{nl}Table of Contents ..... 3{nl}Page 21{nl}- 12 -{nl}{nl}{nl}iv{nl}See  Table of Contents{nl}12345{nl}"


def stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    yy = "date_format(o_orderdate, 'yy')"
    stem = f"concat(lpad(cast(o_custkey as string), 10, '0'), '_', lpad(cast(o_custkey as string), 10, '0'), {yy}, lpad(cast(o_orderkey as string), 6, '0'), '_', {FORM})"
    return table(spark, sf_dir, "orders").select(F.expr(stem).alias("stem"), "o_orderkey", "o_custkey", "o_totalprice")


STEMS_SQL = f"""(select lpad(cast(o_custkey as varchar), 10, '0') || '_' || lpad(cast(o_custkey as varchar), 10, '0') || strftime(o_orderdate, '%y')
  || lpad(cast(o_orderkey as varchar), 6, '0') || '_' || {FORM} as stem, o_orderkey, o_custkey, o_totalprice from orders)"""


def index_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a filing index; every 97th lacks a field, every 89th has a bad date."""
    orders, people = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    both = orders.join(people, orders["o_custkey"] == people["c_custkey"])
    line = f"""concat(cast(o_custkey as string), '|', c_name, '|', {FORM}, '|',
      case when o_orderkey % 89 = 0 then 'n/a' else date_format(o_orderdate, 'yyyy-MM-dd') end, '|', 'edgar/data/', o_custkey, '/',
      lpad(cast(o_custkey as string), 10, '0'), '-', date_format(o_orderdate, 'yy'), '-', lpad(cast(o_orderkey as string), 6, '0'), '.txt')"""
    return both.select(F.expr(f"case when o_orderkey % 97 = 0 then c_name else {line} end").alias("value"))


INDEX_SQL = f"""(select case when o_orderkey % 97 = 0 then c_name else cast(o_custkey as varchar) || '|' || c_name || '|' || {FORM} || '|'
  || case when o_orderkey % 89 = 0 then 'n/a' else strftime(o_orderdate, '%Y-%m-%d') end || '|' || 'edgar/data/' || o_custkey || '/'
  || lpad(cast(o_custkey as varchar), 10, '0') || '-' || strftime(o_orderdate, '%y') || '-' || lpad(cast(o_orderkey as varchar), 6, '0') || '.txt' end as value
  from orders join customer on o_custkey = c_custkey)"""
ROWS_SQL = f"""(select lpad(p[1], 10, '0') as cik, p[2] as company, p[3] as form, p[4] as filed,
  replace(regexp_extract(p[5], '(\\d{{10}}-\\d{{2}}-\\d{{6}})\\.txt$', 1), '-', '') as accession, cast(substring(p[4], 1, 4) as integer) as year
  from (select string_split(value, '|') as p from {INDEX_SQL}) where len(p) = 5 and regexp_matches(p[4], '^\\d{{4}}-\\d{{2}}-\\d{{2}}$'))"""

LINE = """concat('Revenues of $', format_number(l_extendedprice, 2), ' up ', cast(l_linenumber as string), '.25%, 1,234,', cast(100 + l_linenumber as string),
  case when l_orderkey % 3 = 0 then ' under Item 7A(b)-1' else ' see the note' end, case when l_orderkey % 5 = 0 then ' and 150bps' else ' and basis points' end,
  case when l_partkey % 2 = 0 then ' §251(h)' else '' end, ' CUSIP 88160R10', cast(l_linenumber as string), case when l_suppkey % 7 = 0 then ' RevenueFromContractWithCustomer $ABC' else '' end)"""


def filing_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.expr(LINE).alias("line"))


LINES_SQL = """(select l_orderkey, l_linenumber, 'Revenues of $' || format('{:,.2f}', l_extendedprice) || ' up ' || l_linenumber || '.25%, 1,234,' || (100 + l_linenumber)
  || case when l_orderkey % 3 = 0 then ' under Item 7A(b)-1' else ' see the note' end || case when l_orderkey % 5 = 0 then ' and 150bps' else ' and basis points' end
  || case when l_partkey % 2 = 0 then ' §251(h)' else '' end || ' CUSIP 88160R10' || l_linenumber || case when l_suppkey % 7 = 0 then ' RevenueFromContractWithCustomer $ABC' else '' end as line
  from lineitem)"""


def junky(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.concat("text", F.lit(JUNK.format(nl="\n"))).alias("text"))


JUNKY_SQL = "(select doc_id, text || replace('" + JUNK.replace("{nl}", "~") + "', '~', chr(10)) as text from documents)"


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of three stub tokenizers (words, quarters of bytes, bytes) for documents named like filings."""
    docs = table(spark, sf_dir, "documents").select(
        F.expr("concat('0001493761_0001044321', lpad(cast(doc_id % 30 as string), 2, '0'), lpad(cast(doc_id as string), 6, '0'), '_', case when doc_id % 3 = 0 then '10K' when doc_id % 3 = 1 then '13D' else '8K' end)").alias("doc"), "text"
    )
    from textloom.functions.text import era, form_label

    counted = docs.select("doc", form_label(F.col("doc")).alias("form"), era(F.col("doc")).alias("era"), F.octet_length("text").cast("long").alias("bytes"),
                          F.size(F.split("text", "[ \\n]+")).cast("long").alias("words"))
    kinds = F.array(F.struct(F.lit("words").alias("tokenizer"), F.col("words").alias("tokens")), F.struct(F.lit("quarters").alias("tokenizer"), F.expr("bytes div 4 + 1").alias("tokens")), F.struct(F.lit("bytes").alias("tokenizer"), F.col("bytes").alias("tokens")))
    return counted.select("doc", "form", "era", "bytes", F.explode(kinds).alias("k")).select("k.tokenizer", "doc", "form", "era", "k.tokens", "bytes")


FACTS_SQL = """(select k.tokenizer as tokenizer, doc, regexp_extract(doc, '[^_]*$') as form,
  case when substring(doc, 22, 2) >= '19' then '2019+' else 'pre-2019' end as era, k.tokens as tokens, bytes from
  (select doc, bytes, unnest([{'tokenizer': 'words', 'tokens': words}, {'tokenizer': 'quarters', 'tokens': bytes // 4 + 1}, {'tokenizer': 'bytes', 'tokens': bytes}]) as k from
    (select '0001493761_0001044321' || lpad(cast(doc_id % 30 as varchar), 2, '0') || lpad(cast(doc_id as varchar), 6, '0') || '_'
      || case when doc_id % 3 = 0 then '10K' when doc_id % 3 = 1 then '13D' else '8K' end as doc,
      cast(strlen(text) as bigint) as bytes, cast(len(string_split_regex(text, '[ \\n]+')) as bigint) as words from documents)))"""
