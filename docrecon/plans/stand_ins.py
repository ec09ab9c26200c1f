"""Views of the given tables as the relations that the operators work on, in Spark and in SQL.

Documents give lines; the other side of a reconciliation is the same lines after edits that the line's place decides.
Orders are units and their lineitems the items, in an order of all their columns, as line numbers repeat.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ITEM_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, pos (from 0), line."""
    return table(spark, sf_dir, "documents").select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


def edited_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other side: doc_id, pos, section, line. Of seven kinds two are as they were, the others lower case, broken by
    a hyphen, with a mark added, left out, or spaced out."""
    kind = F.pmod(F.col("doc_id") * 31 + F.col("pos"), F.lit(7))
    line = F.when(kind == 1, F.lower("line")).when(kind == 2, F.concat(F.expr("substring(line, 1, 3)"), F.lit("-\n"), F.expr("substring(line, 4)"))).when(kind == 3, F.concat("line", F.lit("!"))).when(kind == 5, F.replace(F.col("line"), F.lit(" "), F.lit("  "))).otherwise(F.col("line"))
    return doc_lines(spark, sf_dir).filter(kind != 4).select("doc_id", "pos", F.expr("pos div 3").alias("section"), line.alias("line"))


def part_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p_partkey, raw: a code made of a part's kind, brand number and size."""
    raw = F.concat(F.upper(F.substring("p_type", 1, 3)), F.lit("."), F.regexp_extract("p_brand", "[0-9]+", 0), F.lit(".0"), F.col("p_size").cast("string"), F.lit("."))
    return table(spark, sf_dir, "part").select("p_partkey", raw.alias("raw"))


def supplier_codes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(used, declared) codes of suppliers: l_suppkey, prefix, segments. Used ones name brand and size; declared ones
    the brand alone for parts of every third key, brand and size for every fifth."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.upper(F.substring("p_type", 1, 1)).alias("prefix"), F.regexp_extract("p_brand", "[0-9]+", 0).alias("b"), F.col("p_size").cast("string").alias("s"))
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").distinct().join(parts, "l_partkey")
    used = rows.select("l_suppkey", "prefix", F.array("b", "s").alias("segments")).distinct()
    key = F.col("l_partkey") + F.col("l_suppkey")
    declared = rows.filter((F.pmod(key, F.lit(3)) == 0) | (F.pmod(key, F.lit(5)) == 0)).select("l_suppkey", "prefix", F.when(F.pmod(key, F.lit(3)) == 0, F.array("b")).otherwise(F.array("b", "s")).alias("segments")).distinct()
    return used, declared


# The same relations as SQL, for DuckDB.
SQL_LINES = "lines as (select doc_id, source, k - 1 as pos, line from (select doc_id, source, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as k from documents))"
SQL_EDITED = (
    SQL_LINES
    + ", edited as (select doc_id, pos, pos // 3 as section, case (doc_id * 31 + pos) % 7 when 1 then lower(line) when 2 then substring(line, 1, 3) || '-' || chr(10) || substring(line, 4) when 3 then line || '!' when 5 then replace(line, ' ', '  ') else line end as line from lines where (doc_id * 31 + pos) % 7 <> 4)"
)
SQL_CODES = "codes as (select p_partkey, upper(substring(p_type, 1, 3)) || '.' || regexp_extract(p_brand, '[0-9]+') || '.0' || p_size || '.' as raw from part)"
SQL_SUPPLIER = (
    "r as (select distinct l_suppkey, l_partkey from lineitem), p as (select p_partkey as l_partkey, upper(substring(p_type, 1, 1)) as prefix, regexp_extract(p_brand, '[0-9]+') as b, p_size::varchar as s from part), "
    "used as (select distinct l_suppkey, prefix, [b, s] as segments from r join p using (l_partkey)), "
    "declared as (select distinct l_suppkey, prefix, case when (l_partkey + l_suppkey) % 3 = 0 then [b] else [b, s] end as segments from r join p using (l_partkey) where (l_partkey + l_suppkey) % 3 = 0 or (l_partkey + l_suppkey) % 5 = 0)"
)


_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def sql_squeeze(c: str) -> str:
    return f"trim(regexp_replace({c}, '{_SPACE}+', ' ', 'g'))"


def sql_tr_lower(c: str) -> str:
    return f"lower(translate(nfc_normalize({c}), 'İI', 'iı'))"


def sql_norm(c: str) -> str:
    return rf"translate(regexp_replace({sql_tr_lower(c)}, '[^\p{{L}}\p{{N}}]', '', 'g'), 'ı', 'i')"


def sql_compare_key(c: str) -> str:
    joined = rf"regexp_replace(replace(nfc_normalize({c}), chr(173), ''), '-[ \t]*\n{_SPACE}*', '', 'g')"
    return sql_squeeze(f"replace({joined}, '-', '')")


def sql_form_key(c: str) -> str:
    return f"replace({sql_tr_lower(sql_compare_key(c))}, ' ', '')"


def sql_text_status(a: str, b: str) -> str:
    return f"case when {sql_squeeze(a)} = {sql_squeeze(b)} then 'AYNI' when {sql_form_key(a)} = {sql_form_key(b)} then 'SADECE_BİÇİM_FARKI' else 'METİN_FARKLI' end"


def sql_layer(c: str) -> str:
    bare = f"regexp_replace(regexp_replace(nfc_normalize({c}), '[-\u00ad–—]', '', 'g'), '{_SPACE}+', '', 'g')"
    quotes = '"' * 5 + "''" * 4
    return f"translate(lower(translate({bare}, 'İI', 'iı')), '“”„«»‘’ʻ`ı', '{quotes}i')"


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as spans of pages: a source is a document and a text a page on which 50 lines fit one below another. The
    first line there is a running title and the last the page's number; every 13th line is rotated."""
    at = F.col("pos") % 50
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    text = F.when(at == 49, F.col("doc_id").cast("string")).when(at == 0, F.concat(F.lit("Page "), F.col("doc_id").cast("string"), F.lit(" of "), F.col("source"))).otherwise(F.col("line"))
    return rows.select("source", F.col("doc_id").alias("page"), "pos", text.alias("text"), (at * 16.84).alias("y0"), (at * 16.84 + 12).alias("y1"), F.lit(842.0).alias("height"), (F.col("pos") % 13 == 7).alias("rotated"), (F.char_length("line") % 64).alias("color"))


SQL_SPANS = (
    SQL_LINES
    + ", spans as (select source, doc_id as page, pos, case pos % 50 when 49 then doc_id::varchar when 0 then 'Page ' || doc_id || ' of ' || source else line end as text, "
    + "(pos % 50) * 16.84::double as y0, (pos % 50) * 16.84::double + 12 as y1, 842.0::double as height, pos % 13 = 7 as rotated, length(line) % 64 as color from lines)"
)
