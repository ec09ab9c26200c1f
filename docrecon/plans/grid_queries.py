"""Queries of cells, grids, tables, titles and learned codes, each beside its SQL."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from docrecon.functions import labels as L
from docrecon.functions.keys import norm_label
from docrecon.operators import cells, matching, tables
from docrecon.plans import stand_ins as S
from docrecon.plans.queries import _CELL, query

# ---- cells: a code list of each part on both sides, an item list of each order


_NAMES = "case p_partkey % 5 when 0 then p_name when 1 then p_name || ' becerisi' when 2 then upper(p_name) when 3 then p_name || 'x' else '' end"
_SHEET = f"concat('D', p_size, '.1. ', {_NAMES}, chr(10), 'Sayfa(lar)/e-içerik(ler):', chr(10), 'KB', p_size, ' ', p_name, chr(10), case when p_partkey % 7 = 0 then 'yok' when p_partkey % 7 = 1 then 'free text' else concat('E', p_size, '. same') end)"
_DOCUMENT = "concat('D', p_size, '.01. ', p_name, chr(10), chr(10), case p_partkey % 3 when 0 then concat('KB', p_size, '. ', p_name) when 1 then concat('KB', p_size) else '' end, chr(10), chr(10), case when p_partkey % 7 = 1 then 'free text' else concat('E', p_size, '. same') end)"


def _code_lists(spark, sf):
    return S.table(spark, sf, "part").select("p_partkey", F.expr(_SHEET.replace("chr(10)", "'\\n'")).alias("sheet"), F.expr(_DOCUMENT.replace("chr(10)", "'\\n'")).alias("document"))


# By what the texts above are made of: the first code's names, the second with and without name, the third on one side.
# An I of the upper case is no i in Turkish.
_FIRST = "case when p_partkey % 5 in (0, 1) or (p_partkey % 5 = 2 and not contains(p_name, 'i')) then 'BİÇİM' when p_partkey % 5 = 4 then 'YALNIZCA_PDF' else 'FARKLI' end"
_ENTRIES = f"""e as (select p_partkey, 'D|' || p_size || '.1' as key, {_FIRST} as status, case when {_FIRST} <> 'FARKLI' then 'suffix' end as note, 0 as place from part
union all select p_partkey, 'KB|' || p_size, case p_partkey % 3 when 0 then 'BİÇİM' when 1 then 'AYNI' else 'YALNIZCA_SİSTEM' end, case p_partkey % 3 when 0 then 'suffix' when 1 then 'nameless' end, 1 from part
union all select p_partkey, 'E|' || p_size, case when p_partkey % 7 = 0 then 'YALNIZCA_PDF' else 'AYNI' end, null, 2 from part where p_partkey % 7 <> 1
union all select p_partkey, '?free text', 'AYNI', null, 2 from part where p_partkey % 7 = 1)"""


@query(f"with {_ENTRIES} select p_partkey, key, status, note from e")
def q_code_list_diff(spark, sf):
    return cells.code_list_diff(_code_lists(spark, sf), ["p_partkey"], "sheet", "document").select("p_partkey", "key", "status", "note")


@query(
    f"""with {_ENTRIES} select p_partkey, case when bool_and(status = 'AYNI') then 'AYNI' when bool_and(status in ('AYNI', 'BİÇİM')) then 'BİÇİM' else 'FARKLI' end as status,
    coalesce(max(case when p_partkey % 3 = 2 then 'KB' || p_size || ' ' || p_name end), '') as only_sheet, coalesce(max(case when p_partkey % 7 = 0 then 'E' || p_size || '. same' end), '') as only_document,
    coalesce(string_agg(case when note = 'nameless' then key end, '; '), '') as nameless, coalesce(string_agg(case when status = 'FARKLI' then key end, '; '), '') as differing from e join part using (p_partkey) group by p_partkey"""
)
def q_code_cells(spark, sf):
    return cells.code_cells(_code_lists(spark, sf), ["p_partkey"], "sheet", "document")


_ITEM_LISTS = """i as (select l_orderkey, l_partkey, max(l_quantity) as q from lineitem group by 1, 2), c as (select l_orderkey, string_agg('Part ' || l_partkey, chr(10) order by l_partkey) filter (where l_partkey % 9 <> 0) as sheet,
    string_agg(case when l_partkey % 10 = 3 then 'PART-' || l_partkey else 'Part ' || l_partkey end, ', ' order by l_partkey) filter (where l_partkey % 11 <> 0) as document from i group by 1)"""


def _item_lists(spark, sf):
    rows = S.table(spark, sf, "lineitem").select("l_orderkey", "l_partkey").distinct()
    names = lambda kept, text: F.transform(F.array_sort(F.collect_list(F.when(kept, F.struct("l_partkey", text.alias("t"))))), lambda x: x["t"])
    plain = F.concat(F.lit("Part "), F.col("l_partkey").cast("string"))
    other = F.when(F.col("l_partkey") % 10 == 3, F.concat(F.lit("PART-"), F.col("l_partkey").cast("string"))).otherwise(plain)
    return rows.groupBy("l_orderkey").agg(F.array_join(names(F.col("l_partkey") % 9 != 0, plain), "\n").alias("sheet"), F.array_join(names(F.col("l_partkey") % 11 != 0, other), ", ").alias("document"))


@query(
    f"""with {_ITEM_LISTS}, s as (select l_orderkey, l_partkey % 9 <> 0 as s, l_partkey % 11 <> 0 as d, l_partkey % 10 = 3 as odd, l_partkey from i),
    g as (select l_orderkey, count(*) filter (where s) as ns, count(*) filter (where d) as nd, bool_or(s and not d) as os, bool_or(d and not s) as od, bool_or(s and d and odd) as odd,
    string_agg('Part ' || l_partkey, '; ' order by l_partkey) filter (where s and not d) as a, string_agg(case when odd then 'PART-' else 'Part ' end || l_partkey, '; ' order by l_partkey) filter (where d and not s) as b from s group by 1),
    t as (select *, case when ns = 0 and nd = 0 then 'BOŞ' when nd = 0 then 'YALNIZCA_SİSTEM' when ns = 0 then 'YALNIZCA_PDF' when os or od then 'FARKLI' when odd then 'BİÇİM' else 'AYNI' end as status from g)
    select l_orderkey, status, case when status = 'FARKLI' then coalesce(a, '') else '' end as only_sheet, case when status = 'FARKLI' then coalesce(b, '') else '' end as only_document from t"""
)
def q_item_cells(spark, sf):
    return cells.item_cells(_item_lists(spark, sf), ["l_orderkey"], "sheet", "document").select("l_orderkey", "status", F.array_join(F.array_sort(F.split("only_sheet", "; "), _by_number), "; ").alias("only_sheet"), F.array_join(F.array_sort(F.split("only_document", "; "), _by_number), "; ").alias("only_document"))


def _by_number(a, b):
    x, y = (F.regexp_extract(c, "[0-9]+", 0).try_cast("long") for c in (a, b))
    return F.when(x < y, -1).when(x > y, 1).otherwise(0)


# ---- the grid: a text is a theme, three lines an outcome with two components


def _grid_side(lines):
    at, lo = F.col("pos") % 3, F.expr("cast(pos div 3 as int)")
    none = F.lit(None).cast("int")
    own = lines.select(F.col("doc_id").alias("theme"), lo.alias("lo"), F.when(at > 0, at.cast("int")).alias("pos"), F.when(at == 0, "Outcome").otherwise("Component").alias("header"), F.col("line").alias("value"))
    top = lines.filter("pos = 0").select(F.col("doc_id").alias("theme"), none.alias("lo"), none.alias("pos"), F.lit("Theme").alias("header"), F.col("line").alias("value"))
    code = lines.filter("pos % 3 = 0").select(F.col("doc_id").alias("theme"), lo.alias("lo"), none.alias("pos"), F.lit("Codes").alias("header"), F.concat(F.lit("D"), F.char_length("line").cast("string"), F.lit(". Name")).alias("value"))
    return own.unionByName(top).unionByName(code)


def _grid(spark, sf):
    return cells.grid_cells(_grid_side(S.doc_lines(spark, sf)), _grid_side(S.edited_lines(spark, sf)), ["Codes"])


_SIDE = """(select doc_id as theme, pos // 3 as lo, case when pos % 3 > 0 then pos % 3 end as pos, case when pos % 3 = 0 then 'Outcome' else 'Component' end as header, line as value from {0} union all select doc_id, null, null, 'Theme', line from {0} where pos = 0
    union all select doc_id, pos // 3, null, 'Codes', 'D' || length(line) || '. Name' from {0} where pos % 3 = 0)"""
_GRID = f"""{S.SQL_EDITED}, x as (select coalesce(l.theme, r.theme) as theme, coalesce(l.lo, r.lo) as lo, coalesce(l.pos, r.pos) as pos, coalesce(l.header, r.header) as header, coalesce(l.value, '') as l, coalesce(r.value, '') as r
    from {_SIDE.format("lines")} l full join {_SIDE.format("edited")} r on l.theme = r.theme and l.lo is not distinct from r.lo and l.pos is not distinct from r.pos and l.header = r.header),
    y as (select *, {S.sql_squeeze("l")} as a, {S.sql_squeeze("r")} as b from x), g as (select theme, lo, pos, header, l, r, {_CELL} as status from y)"""
_ROW_STATUS = "['FARKLI', 'YALNIZCA_SİSTEM', 'YALNIZCA_PDF', 'BİÇİM', 'AYNI', 'BOŞ']"


@query(f"with {_GRID} select theme, lo::int as lo, pos::int as pos, header, status from g")
def q_grid_cells(spark, sf):
    return _grid(spark, sf).select("theme", "lo", "pos", "header", "status")


@query(
    f"""with {_GRID}, o as (select distinct theme, lo from g where lo is not null), p as (select distinct theme, lo, pos from g where header = 'Component'), rows as (select o.theme, o.lo, coalesce(p.pos, 0) as pos from o left join p using (theme, lo)
    union all select distinct theme, null, 0 from g where theme not in (select theme from o)), f as (select *, row_number() over (partition by theme order by lo, pos) = 1 as first_of_theme, lo is not null and row_number() over (partition by theme, lo order by pos) = 1 as first_of_lo from rows),
    k as (select theme, lo, pos, min(list_position({_ROW_STATUS}, status)) as r from g group by 1, 2, 3)
    select f.theme, f.lo::int as lo, f.pos::int as pos, first_of_theme, first_of_lo, coalesce({_ROW_STATUS}[least(case when first_of_theme then t.r end, case when first_of_lo then l.r end, c.r)], 'BOŞ') as status
    from f left join k t on t.theme = f.theme and t.lo is null left join k l on l.theme = f.theme and l.lo = f.lo and l.pos is null left join k c on c.theme = f.theme and c.lo = f.lo and c.pos = f.pos"""
)
def q_grid(spark, sf):
    return cells.grid_rows(_grid(spark, sf), "Component")


@query(
    f"""with {_GRID}, h as (select theme, case when header = 'Component' then 'Outcome' else header end as header, header = 'Codes' as codes, lo, pos, l, r, status from g where lo is not null)
    select theme, header, case when codes then coalesce(array_to_string(list_sort(list_distinct(list(trim(r)) filter (where trim(r) <> ''))), chr(10)), '') else coalesce(string_agg(trim(r), chr(10) order by lo, coalesce(pos, -1)) filter (where trim(r) <> ''), '') end as sheet,
    case when codes then coalesce(array_to_string(list_sort(list_distinct(list(trim(l)) filter (where trim(l) <> ''))), chr(10)), '') else coalesce(string_agg(trim(l), chr(10) order by lo, coalesce(pos, -1)) filter (where trim(l) <> ''), '') end as document, count(*)::int as members,
    case when count(*) filter (where status <> 'BOŞ') = 0 then 'BOŞ' when count(distinct status) filter (where status <> 'BOŞ') = 1 then max(status) filter (where status <> 'BOŞ') when bool_or(status not in ('AYNI', 'BİÇİM', 'BOŞ')) then 'FARKLI' else 'BİÇİM' end as status from h group by theme, header, codes"""
)
def q_merged_cells(spark, sf):
    return cells.merged_cells(_grid(spark, sf), "Outcome", "Component").select("theme", "header", F.coalesce("sheet", F.lit("")).alias("sheet"), F.coalesce("document", F.lit("")).alias("document"), "members", "status")


# ---- expected tables: a customer is a document, a priority a context, an order a unit with its items as outcomes

_UNITS = """u as (select o_custkey as doc, o_orderkey as unit, o_orderpriority as context, row_number() over (partition by o_custkey, o_orderpriority order by o_orderdate, o_orderkey) as "order", 'Unit ' || o_orderkey as name,
    floor(o_totalprice / 1000)::bigint as h, coalesce(n, 0) as los from orders left join (select l_orderkey, count(*) as n from lineitem group by 1) on l_orderkey = o_orderkey),
t as (select distinct doc, context as "table", context || ' table' as title from u where doc % 13 <> 0),
r as (select doc, context as "table", unit as n, "order", case when unit % 13 = 0 then '1. other' when unit % 5 = 0 then 'X' || name else "order" || '. ' || name end as name, case when unit % 17 = 0 then 'x' else (los + (unit % 10 = 0)::int)::varchar end as count_raw,
    case when unit % 17 <> 0 then los + (unit % 10 = 0)::int end as count, case when unit % 19 <> 0 then h + (unit % 23 = 0)::int end as hours, false as is_total from u where unit % 11 <> 0 and doc % 13 <> 0
    union all select doc, context, -1, null, null, null, sum(los) + max(doc % 3), null, true from u where doc % 13 <> 0 group by 1, 2)"""


def _expected(spark, sf):
    """units, tables and rows: some rows are missing, some have no or another name or count."""
    counts = S.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    units = S.table(spark, sf, "orders").join(counts, "o_orderkey", "left").select(
        F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("unit"), F.col("o_orderpriority").alias("context"), F.row_number().over(Window.partitionBy("o_custkey", "o_orderpriority").orderBy("o_orderdate", "o_orderkey")).alias("order"),
        F.concat(F.lit("Unit "), F.col("o_orderkey").cast("string")).alias("name"), F.floor(F.col("o_totalprice") / 1000).cast("long").alias("h"), F.coalesce("n", F.lit(0)).alias("los"),
    )
    listed = units.filter("doc % 13 <> 0")
    tabs = listed.select("doc", F.col("context").alias("table"), F.concat("context", F.lit(" table")).alias("title"), F.lit(tables.SUMMARY).alias("role")).distinct()
    given = F.col("los") + (F.col("unit") % 10 == 0).cast("int")
    name = F.when(F.col("unit") % 13 == 0, "1. other").when(F.col("unit") % 5 == 0, F.concat(F.lit("X"), "name")).otherwise(F.concat(F.col("order").cast("string"), F.lit(". "), "name"))
    rows = listed.filter("unit % 11 <> 0").select(
        "doc", F.col("context").alias("table"), F.col("unit").alias("n"), "order", name.alias("name"), F.when(F.col("unit") % 17 == 0, "x").otherwise(given.cast("string")).alias("count_raw"), F.when(F.col("unit") % 17 != 0, given).alias("count"),
        F.when(F.col("unit") % 19 != 0, F.col("h") + (F.col("unit") % 23 == 0).cast("int")).alias("hours"), F.lit(False).alias("is_total"),
    )
    totals = listed.groupBy("doc", F.col("context").alias("table")).agg((F.sum("los") + F.max(F.col("doc") % 3)).alias("count"))
    none = {c: F.lit(None).cast(rows.schema[c].dataType) for c in ("order", "name", "count_raw", "hours")}
    return units, tabs, rows.unionByName(totals.select("doc", "table", F.lit(-1).cast("long").alias("n"), "count", *[v.alias(k) for k, v in none.items()], F.lit(True).alias("is_total")))


_KEY = "nullif(lower(regexp_replace(regexp_replace({0}, '^[0-9]+\\. ', ''), '[^A-Za-z0-9]', '', 'g')), '')"
_ROWS = f"""{_UNITS}, k as (select *, {_KEY.format("name")} as key from r where "order" is not null), bn as (select doc, "table", key, min(n) as n from k where key is not null group by 1, 2, 3 having count(*) = 1), bo as (select doc, "table", "order", min(n) as n from k group by 1, 2, 3 having count(*) = 1),
m as (select u.*, t."table", coalesce(bn.n, bo.n) as n, case when t."table" is null then 'no table' when bn.n is not null then 'name' when bo.n is not null then 'order' else 'ambiguous' end as how, (t."table" is not null)::bigint as candidates
    from u left join t on t.doc = u.doc and t."table" = u.context left join bn on bn.doc = u.doc and bn."table" = t."table" and bn.key = {_KEY.format("u.name")} left join bo on bo.doc = u.doc and bo."table" = t."table" and bo."order" = u."order")"""


@query(f'with {_ROWS} select doc, unit, candidates, "table", n, how from m')
def q_match_rows(spark, sf):
    units, tabs, rows = _expected(spark, sf)
    return tables.match_rows(units, tabs, rows)


@query(
    f"""with {_ROWS}, j as (select m.*, r.name as row_name, r.count, r.hours from m left join r on r.doc = m.doc and r."table" = m."table" and r.n = m.n), used as (select distinct doc, "table", n from m where n is not null), un as (select t.* from t anti join used using (doc, "table")),
x as (select doc, count(*) as units, sum(los)::bigint as los from u group by 1), a as (select doc, count(*) as n, case when count(*) = count(count) then sum(count)::bigint end as expected from r where "order" is not null group by 1), ok as (select x.*, a.n, a.expected from x join a using (doc) where doc in (select doc from t) and doc not in (select doc from un))
select doc, unit, 'EXPECTED_TABLE_AMBIGUOUS' as code, 'INFO' as severity, candidates::varchar as detail from m where candidates <> 1 union all select doc, unit, 'EXPECTED_ROW_AMBIGUOUS', 'INFO', "table" from m where how = 'ambiguous'
union all select doc, unit, 'UNIT_NAME_MISMATCH', 'NEEDS_REVIEW', row_name from j where n is not null and {_KEY.format("row_name")} <> {_KEY.format("name")} union all select doc, null, 'EXPECTED_TABLE_UNMATCHED', 'INFO', "table" from un
union all select r.doc, null, 'MISSING_UNIT', 'FAIL', r."table" || '/' || r."order" from r semi join used using (doc, "table") anti join used q on q.doc = r.doc and q."table" = r."table" and q.n = r.n where r."order" is not null
union all select doc, unit, 'EXPECTED_COUNT_MISSING', 'INFO', los::varchar from j where n is null or count is null union all select doc, unit, 'LO_COUNT_MISMATCH', 'FAIL', (los - count)::varchar from j where n is not null and count <> los
union all select doc, null, 'EXPECTED_TABLE_NOT_FOUND', 'INFO', null from x where doc not in (select doc from t) union all select doc, null, 'EXPECTED_TOTAL_UNKNOWN', 'INFO', los::varchar from x where doc in (select doc from un)
union all select doc, null, 'UNIT_COUNT_MISMATCH', 'FAIL', (units - n)::varchar from ok where n <> units union all select doc, null, 'LO_TOTAL_MISMATCH', 'FAIL', (los - expected)::varchar from ok where expected <> los"""
)
def q_expected_findings(spark, sf):
    units, tabs, rows = _expected(spark, sf)
    return tables.expected_findings(units, tabs, rows)


@query(
    f"""with {_UNITS}, s as (select doc, "table", sum(count) filter (where "order" is not null) as s, count(*) filter (where "order" is not null and count is null) as open, min(count) filter (where is_total) as total from r group by 1, 2)
select doc, null::bigint as unit, 'EXPECTED_COUNT_UNREADABLE' as code, 'INFO' as severity, count_raw as detail from r where "order" is not null and count is null union all select doc, null, 'TABLE_TOTAL_INCONSISTENT', 'NEEDS_REVIEW', (total - s)::bigint::varchar from s where open = 0 and s <> total
union all select l_orderkey % 1000, null, 'LO_LIST_UNPARSED', 'NEEDS_REVIEW', 'line ' || l_linenumber from lineitem where l_partkey % 37 = 0"""
)
def q_table_findings(spark, sf):
    _, tabs, rows = _expected(spark, sf)
    code = F.when(F.col("l_partkey") % 37 != 0, F.concat(F.lit("MAT."), F.col("l_partkey").cast("string")))
    listed = S.table(spark, sf, "lineitem").select((F.col("l_orderkey") % 1000).alias("doc"), code.alias("code"), F.concat(F.lit("line "), F.col("l_linenumber").cast("string")).alias("text"))
    return tables.table_findings(tabs, rows, listed)


@query(
    """with u as (select o_custkey as doc, o_orderkey as unit, o_orderpriority as context, row_number() over (partition by o_custkey, o_orderpriority order by o_orderdate, o_orderkey) as "order" from orders), o as (select distinct l_orderkey as unit, 'MAT.' || l_partkey as code from lineitem),
c as (select u.doc, u.context, u."order", u.unit, o.code || case when hash_ = 0 then 'x' else '' end as code from u join (select *, (length(code) + unit) % 9 as hash_ from o) o using (unit)),
n as (select doc, context, "order", count(*) as codes from c group by 1, 2, 3), a as (select unit, doc, context, "order", case when doc % 5 = 0 then 0 when doc % 7 = 0 then 2 else 1 end as a from u), f as (select a.*, codes, case when unit % 8 = 0 then codes + 1 else codes end as given from a left join n using (doc, context, "order"))
select doc, unit, 'LIMITED_TABLE_AMBIGUOUS' as code, 'NEEDS_REVIEW' as severity, a || '/1' as detail from f where a <> 1 and exists (select 1 from n where n.doc = f.doc and n.context = f.context)
union all select doc, unit, 'LIMITED_TABLE_AMBIGUOUS', 'NEEDS_REVIEW', a || '/0' from f where a > 0 and not exists (select 1 from n where n.doc = f.doc and n.context = f.context)
union all select doc, unit, 'LIMITED_ROW_AMBIGUOUS', 'NEEDS_REVIEW', context || ' alt1/' || context || ' list' from f where a = 1 and codes is null and exists (select 1 from n where n.doc = f.doc and n.context = f.context)
union all select doc, unit, 'LIMITED_LO_COUNT_MISMATCH', 'NEEDS_REVIEW', given || '/' || codes from f where a = 1 and given <> codes
union all select f.doc, f.unit, 'LIMITED_LO_NOT_FOUND', 'NEEDS_REVIEW', c.code from f join c using (doc, context, "order") where a = 1 and codes is not null and c.code like '%x'"""
)
def q_limited_findings(spark, sf):
    """Two alternative tables for some documents, none for others; a list of outcome codes each, of which some are wrong."""
    units, _, _ = _expected(spark, sf)
    outcomes = S.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("unit"), F.concat(F.lit("MAT."), F.col("l_partkey").cast("string")).alias("code")).distinct()
    named = units.select("doc", "unit", "context", "order").join(outcomes, "unit")
    wrong = F.when((F.char_length("code") + F.col("unit")) % 9 == 0, F.concat("code", F.lit("x"))).otherwise(F.col("code"))
    listed = named.select("doc", F.concat("context", F.lit(" list")).alias("table"), "order", F.col("unit").alias("column"), wrong.alias("code"))
    held = units.filter("doc % 5 <> 0").withColumn("k", F.explode(F.when(F.col("doc") % 7 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    sizes = named.groupBy("unit").agg(F.count("*").alias("codes"))
    rows = held.join(sizes, "unit", "left").select("doc", F.concat("context", F.lit(" alt"), F.col("k").cast("string")).alias("table"), "order", (F.col("codes") + (F.col("unit") % 8 == 0).cast("int")).alias("count"))
    tabs = rows.select("doc", "table", F.col("table").alias("title"), F.lit(tables.ALTERNATIVE).alias("role")).distinct().unionByName(listed.select("doc", "table", F.col("table").alias("title"), F.lit(tables.LO_LIST).alias("role")).distinct())
    return tables.limited_findings(units, named.select("doc", "unit", "code"), tabs, rows, listed)


@query(
    f"""with {_UNITS}, s as (select *, case when unit % 29 = 0 then 0 when unit % 31 = 0 then 2 else 1 end as k, case when unit % 7 = 0 then h || ' saat' else h::varchar end as text, case when unit % 19 <> 0 then h + (unit % 23 = 0)::int end as hours from u)
select doc, unit, 'HOURS_NOT_FOUND' as code, 'INFO' as severity, k::varchar as detail from s where k <> 1 union all select doc, unit, 'HOURS_UNREADABLE', 'INFO', text from s where k = 1 and unit % 7 = 0
union all select doc, unit, 'EXPECTED_HOURS_MISSING', 'INFO', h::varchar from s where k = 1 and unit % 7 <> 0 and hours is null union all select doc, unit, 'HOURS_MISMATCH', 'FAIL', hours || '/' || h from s where k = 1 and unit % 7 <> 0 and hours <> h"""
)
def q_hours_findings(spark, sf):
    units, _, _ = _expected(spark, sf)
    text = F.when(F.col("unit") % 7 == 0, F.concat(F.col("h").cast("string"), F.lit(" saat"))).otherwise(F.col("h").cast("string"))
    times = F.when(F.col("unit") % 29 == 0, 0).when(F.col("unit") % 31 == 0, 2).otherwise(1)
    sections = units.select("doc", "unit", text.alias("text"), F.explode(F.array_repeat(F.lit(1), times)).alias("k"))
    expected = units.select("doc", "unit", F.when(F.col("unit") % 19 != 0, F.col("h") + (F.col("unit") % 23 == 0).cast("int")).alias("hours"))
    return tables.hours_findings(units, sections, expected)


_LABEL_WORDS = ["alpha", "bravo", "charlie", "delta", "echo", "foxtrot", "golf", "hotel"]


@query(
    f"""with w as (select {_LABEL_WORDS} as w), i as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 as pos from lineitem),
s as (select l_orderkey % 1000 as doc, l_orderkey as unit, pos, w[(case when l_suppkey % 6 = 0 then l_partkey % 8 else pos % 8 end + 1)::int] as norm, case when l_partkey % 9 <> 0 then w[(l_partkey % 8 + 1)::int] end as line from i, w),
l as (select distinct doc, norm, list_position((select w from w), norm) as place from (select doc, unnest((select w from w)) as norm from s)), d as (select distinct doc, unit from s), o as (select doc, unit, list(place order by pos, place) as o from s join l using (doc, norm) group by 1, 2)
select doc, unit, 'DUPLICATE_SECTION' as code, 'NEEDS_REVIEW' as severity, norm as detail from s group by doc, unit, norm having count(*) > 1 union all select doc, unit, 'MISSING_SECTION', 'NEEDS_REVIEW', norm from (select doc, unit, norm from d join l using (doc)) anti join s using (doc, unit, norm)
union all select doc, unit, 'EMPTY_SECTION', 'WARNING', norm from s where line is null union all select doc, unit, 'SECTION_ORDER', 'NEEDS_REVIEW', array_to_string(o, ',') from o where o <> list_sort(o) union all select doc, unit, 'SECTION_LEAKAGE', 'FAIL', line from s where line is not null"""
)
def q_section_findings(spark, sf):
    """An order's items as sections of a unit: mostly in the order of the labels, each with one line or none."""
    words = F.lit(_LABEL_WORDS)
    items = S.table(spark, sf, "lineitem").withColumn("pos", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*S.ITEM_ORDER)) - 1)
    at = F.when(F.col("l_suppkey") % 6 == 0, F.col("l_partkey") % 8).otherwise(F.col("pos") % 8)
    line = F.when(F.col("l_partkey") % 9 != 0, F.element_at(words, (F.col("l_partkey") % 8 + 1).cast("int")))
    rows = items.select((F.col("l_orderkey") % 1000).alias("doc"), F.col("l_orderkey").alias("unit"), F.col("pos").alias("section"), "pos", F.element_at(words, (at + 1).cast("int")).alias("norm"), F.lit("TEXT").alias("kind"), line.alias("content"))
    lines = rows.filter("content is not null").select("doc", "unit", "section", F.col("content").alias("norm"), F.col("content").alias("text"))
    known = rows.select("doc").distinct().select("doc", F.posexplode(words).alias("place", "norm")).select("doc", (F.col("place") + 1).alias("place"), "norm", F.col("norm").alias("text"))
    return tables.section_findings(rows, lines, known)


# ---- titles, labels and codes


@query("""select p_partkey, case when p_partkey % 6 < 4 then p_size::int end as "order", case when p_partkey % 6 < 4 then p_name end as name, case when p_partkey % 6 < 2 then true when p_partkey % 6 < 4 then false end as standard from part""")
def q_unit_title(spark, sf):
    text = F.expr("case p_partkey % 6 when 0 then concat(p_size, '. TEMA: ', p_name) when 1 then concat(' ', p_size, ' . Tema :\n', p_name, ' ') when 2 then concat('TEMA ', p_size, ': ', p_name) when 3 then concat('tema ', p_size, ' : ', p_name) when 4 then concat(p_size, '. BÖLÜM: ', p_name) else p_name end")
    found = S.table(spark, sf, "part").select("p_partkey", L.unit_title(text, F.lit("Tema"), F.lit(False)).alias("t"))
    return found.select("p_partkey", "t.order", "t.name", "t.standard")


@query("select p_partkey, case when p_partkey % 5 < 3 then 'MAT' when p_partkey % 5 = 4 then 'Bu' end as prefix, case p_partkey % 5 when 0 then 'nnn' when 1 then 'nna' when 2 then 'ann' when 4 then 'annn' end as types, case when p_partkey % 5 in (0, 3) then 'MAT' || case when p_partkey % 5 = 0 then '.' else ' ' end || p_size || '.1.' || (p_partkey % 9) || '.' end as code from part")
def q_lo_codes(spark, sf):
    """The shape that a line's code has, and the code itself where it has the learned shape nnn under any writing."""
    text = F.expr("case p_partkey % 5 when 0 then concat('MAT.', p_size, '.1.', p_partkey % 9, '. ', p_name) when 1 then concat(' MAT.', p_size, '.1.SÖS ', p_name) when 2 then concat('MAT.II.', p_size, '.1 ', p_name) when 3 then concat('MAT ', p_size, '.1.', p_partkey % 9, '. ', p_name) else concat('Bu MAT.', p_size, '.1.1. ', p_name) end")
    rows = S.table(spark, sf, "part").withColumn("t", text).withColumn("s", F.when(F.col("p_partkey") % 5 != 3, L.lo_shape(F.col("t"))))
    return rows.select("p_partkey", "s.prefix", "s.types", L.leading_code(F.col("t"), F.lit("MAT"), F.lit("nnn")).alias("code"))


@query("with c as (select l_suppkey, l_orderkey, l_partkey, l_linenumber, case when l_partkey % 4 = 0 then 'nna' else 'nnn' end as types, 'P' || chr((65 + l_suppkey % 5)::int) as prefix from lineitem where l_partkey % 7 <> 0), g as (select l_suppkey, prefix, types, count(*) as n, min(l_orderkey * 100 + l_linenumber) as first from c group by 1, 2, 3) select l_suppkey, prefix, types, n from (select *, row_number() over (partition by l_suppkey order by n desc, first) as r from g) where r = 1")
def q_learn_lo_shape(spark, sf):
    text = F.expr("case when l_partkey % 7 = 0 then concat('P', chr(65 + l_suppkey % 5), '.', l_partkey, '.1. two numbers') when l_partkey % 4 = 0 then concat('P', chr(65 + l_suppkey % 5), '.', l_partkey, '.1.D metin') else concat('P', chr(65 + l_suppkey % 5), '. ', l_partkey, '.1.', l_linenumber, '. Metin') end")
    rows = S.table(spark, sf, "lineitem").select("l_suppkey", (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("at"), text.alias("t"))
    return L.learn_lo_shape(rows, "l_suppkey", ["at"], "t")


_STARTS = "select p_partkey, k, case p_partkey % 3 when 0 then substring(k, 1, 9) when 1 then substring(k, 1, 4) || 'q' || substring(k, 6, 5) else 'zzzz' || k end as n from (select p_partkey, regexp_replace(p_name, '[^a-z0-9]', '', 'g') as k from part)"


@query(
    f"""with p as ({_STARTS}), q as (select distinct n from p where length(n) >= 8), m as (select distinct length(n) + d as m from q, (values (-1), (0), (1)) as x(d)), b as (select distinct substring(k, 1, m) as b from p, m where length(k) >= m),
s as (select distinct n from q where exists (select 1 from b where abs(length(b) - length(n)) <= 1 and levenshtein(n, b) <= 2))
select p_partkey, n as norm, s.n is not null as starts from p left join s using (n)"""
)
def q_label_starts(spark, sf):
    """Of all parts' names: shortened and misspelt beginnings, and texts that begin nothing."""
    part = S.table(spark, sf, "part").withColumn("k", norm_label(F.col("p_name")))
    norm = F.when(F.col("p_partkey") % 3 == 0, F.substring("k", 1, 9)).when(F.col("p_partkey") % 3 == 1, F.concat(F.substring("k", 1, 4), F.lit("q"), F.substring("k", 6, 5))).otherwise(F.concat(F.lit("zzzz"), "k"))
    rows = part.select("p_partkey", "k", norm.alias("norm"))
    found = matching.begins_vocabulary(rows, rows, "norm", "k").withColumn("starts", F.lit(True))
    return rows.join(found, "norm", "left").select("p_partkey", "norm", F.coalesce("starts", F.lit(False)).alias("starts"))
