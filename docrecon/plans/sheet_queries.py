"""Queries of spreadsheets, hand-entered values, application blocks and fields of spans, each beside its SQL."""

from pyspark.sql import functions as F

from docrecon.functions.status import text_status
from docrecon.operators import fields, sheets
from docrecon.plans import stand_ins as S
from docrecon.plans.queries import query

THEME, LO, COMPONENT = "Tema", "Öğrenme Çıktısı", "Süreç Bileşeni"


def _cells(spark, sf):
    """A document's lines as rows of a sheet. Some sheets begin without a theme, one column in them is never filled."""
    at = F.col("pos")
    where = {THEME: (at % 6 == 0) & ~((at == 0) & (F.col("doc_id") % 4 == 1)), LO: at % 2 == 0, COMPONENT: at % 5 != 3, "A": at % 6 == 0, "B": at % 2 == 0, "C": at % 3 == 0, "D": F.lit(False)}
    cells = F.explode(F.array(*[F.struct(F.lit(h).alias("header"), F.when(c, F.col("line")).otherwise(" ").alias("value")) for h, c in where.items()])).alias("c")
    return S.doc_lines(spark, sf).select(F.col("doc_id").alias("file"), (at + 2).alias("row"), cells).select("file", "row", "c.*")


_CELLS = f"""{S.SQL_LINES}, h as (select unnest(['{THEME}', '{LO}', '{COMPONENT}', 'A', 'B', 'C', 'D']) as header), c as (select doc_id as file, pos + 2 as row, header, line as value from lines, h where regexp_replace(line, '\\s', '', 'g') <> '' and case header
    when '{THEME}' then pos % 6 = 0 and not (pos = 0 and doc_id % 4 = 1) when '{LO}' then pos % 2 = 0 when '{COMPONENT}' then pos % 5 <> 3 when 'A' then pos % 6 = 0 when 'B' then pos % 2 = 0 when 'C' then pos % 3 = 0 else false end)"""
_LEVELS = f"""{_CELLS}, m as (select file, row, bool_or(header = '{THEME}') as t, bool_or(header = '{LO}') as l from c group by 1, 2), n as (select file, header, count(*) as n, count(*) filter (where t) as nt, count(*) filter (where l) as nl from c join m using (file, row) where header in ('A', 'B', 'C', 'D') group by 1, 2),
    v as (select d.file, h.header, case when n is null then 'empty' when n = nt then 'theme' when n = nl then 'lo' else 'component' end as level from (select distinct doc_id as file from lines) d cross join (from h where length(header) = 1) h left join n on n.file = d.file and n.header = h.header)"""


@query(f"with {_LEVELS} select * from v")
def q_sheet_levels(spark, sf):
    cells = _cells(spark, sf)
    return sheets.column_levels(cells, cells.select("file", "header").distinct(), THEME, LO, COMPONENT)


@query(f"with {_LEVELS} select header, coalesce(arg_min(level, file) filter (where level <> 'empty'), 'empty') as level, min(file) as first from v group by header")
def q_sheet_merged_levels(spark, sf):
    levels = q_sheet_levels(spark, sf)
    return sheets.merged_levels(levels, levels.select("file", F.col("file").alias("place")).distinct())


@query(
    f"""with {_CELLS}, k as (select *, case header when '{THEME}' then 0 when '{LO}' then 1 else 2 end as o from c where length(header) > 1), t as (select *, sum((o = 0)::int) over (partition by file order by row, o) as t from k),
l as (select *, sum((o = 1)::int) over (partition by file, t order by row, o) as l from t where t > 0), p as (select *, sum((o = 2)::int) over (partition by file, t, l order by row, o) as p from l where o < 2 or l > 0)
select file, row::int as row, header, value, t::bigint as theme_pos, case when o > 0 then l end::bigint as lo_pos, case when o = 2 then p end::bigint as component_pos from p"""
)
def q_sheet_tree(spark, sf):
    return sheets.theme_tree(_cells(spark, sf), THEME, LO, COMPONENT)


@query(
    """select p_partkey, case when p_partkey % 4 in (0, 1) then 1 end::int as theme, case when p_partkey % 3 <> 2 then 2 end::int as lo, case when p_partkey % 5 <> 4 then 3 end::int as component,
    nullif(concat_ws(', ', case when p_partkey % 4 > 1 then 'Tema' end, case when p_partkey % 3 = 2 then 'Öğrenme Çıktısı' end, case when p_partkey % 5 = 4 then 'Süreç Bileşeni' end), '') as error from part"""
)
def q_sheet_columns(spark, sf):
    heads = F.array(F.expr("case p_partkey % 4 when 0 then 'TEMA' when 1 then 'Ünite ' else 'Konu' end"), F.expr("case p_partkey % 3 when 2 then 'Çıktı' else 'öğrenme-çıktısı' end"), F.expr("case p_partkey % 5 when 4 then 'Süreç' else 'Süreç Bileşenleri' end"))
    headers = S.table(spark, sf, "part").select(F.col("p_partkey").alias("file"), F.posexplode(heads).alias("col", "header")).withColumn("col", F.col("col") + 1)
    return sheets.required_columns(headers).withColumnRenamed("file", "p_partkey")


@query("select p_partkey, 'file' || p_partkey || '!' || case when p_size > 26 then chr((64 + (p_size - 1) // 26)::int) else '' end || chr((65 + (p_size - 1) % 26)::int) || (p_partkey % 100 + 1) as address from part")
def q_sheet_address(spark, sf):
    name = F.concat(F.lit("file"), F.col("p_partkey").cast("string"))
    return S.table(spark, sf, "part").select("p_partkey", sheets.address(name, F.col("p_partkey") % 100 + 1, F.col("p_size")).alias("address"))


_OVERRIDES = """case p_partkey % 7 when 0 then '' when 1 then p_size || '-' || (p_size + 2) || ', 99' when 2 then 'yok' when 3 then 'x-' || p_size else p_size::varchar end"""


@query(
    f"""with o as (select p_partkey, case when p_partkey % 5 = 0 then p_name else '' end as title, {_OVERRIDES} as pages, case p_partkey % 3 when 0 then p_size || '.0' when 1 then '' else 'page ' || p_size end as start, p_size from part where p_partkey % 11 <> 0),
g as (select *, case when p_partkey % 7 = 3 then 'pages: ' || pages when start like 'page %' then 'start: ' || start end as error from o where title || pages || start <> '')
select p_partkey::varchar as name, case when error is null then nullif(title, '') end as title, case when error is null then case p_partkey % 7 when 0 then null when 1 then p_size || ',' || (p_size + 1) || ',' || (p_size + 2) || ',99' when 2 then '' else p_size::varchar end end as pages,
case when error is null and start <> '' then p_size::int end as start, error from g"""
)
def q_overrides(spark, sf):
    pages = F.expr("case p_partkey % 7 when 0 then '' when 1 then concat(p_size, '-', p_size + 2, ', 99') when 2 then 'yok' when 3 then concat('x-', p_size) else cast(p_size as string) end")
    start = F.expr("case p_partkey % 3 when 0 then concat(p_size, '.0') when 1 then '' else concat('page ', p_size) end")
    rows = S.table(spark, sf, "part").select(F.when(F.col("p_partkey") % 11 != 0, F.col("p_partkey").cast("string")).alias("name"), F.when(F.col("p_partkey") % 5 == 0, F.col("p_name")).alias("title"), F.lit(" ").alias("code"), pages.alias("pages"), start.alias("start"))
    return sheets.read_overrides(rows).select("name", "title", F.array_join(F.col("pages").cast("array<string>"), ",").alias("pages"), "start", "error")


@query("select c_custkey, case when c_custkey % 3 = 0 then c_name end as title from customer")
def q_override_names(spark, sf):
    rows = S.table(spark, sf, "customer")
    return sheets.with_new_names(rows.filter("c_custkey % 3 = 0").select("c_custkey", F.col("c_name").alias("title")), rows, "c_custkey")


_BLOCKS = """{0} as (select doc_id, code, arg_max(body, top) as body from (select doc_id, b, max(code) as code, min(pos) as top, trim(coalesce(string_agg(line, chr(10) order by pos) filter (where code is null), '')) as body
    from (select *, sum((code is not null)::int) over (partition by doc_id order by pos) as b from (select doc_id, pos, line, case when {1} then 'MAT.' || pos end as code from {2})) group by 1, 2) group by 1, 2)"""


@query(
    f"""with {S.SQL_EDITED}, {_BLOCKS.format("d", "pos % 4 = 0", "lines")}, {_BLOCKS.format("s", "pos % 4 = 0 and pos % 12 <> 8 or pos % 20 = 19", "edited")},
j as (select coalesce(a.doc_id, b.doc_id) as doc_id, coalesce(a.code, b.code) as code, a.body as document, b.body as sheet from (from d where code is not null) a full join (from s where code is not null) b on a.doc_id = b.doc_id and a.code = b.code)
select doc_id, code, case when sheet is null then 'EXCELDE_YOK' when document is null then 'PDF_DE_YOK' else 'both' end as side, case when sheet is null then 'PDF_DE_VAR_EXCELDE_YOK' when document is null then 'EXCELDE_VAR_PDF_DE_YOK' else {S.sql_text_status("document", "sheet")} end as status from j
union all select doc_id, null, 'loose', 'İNCELEME_GEREKLİ' from s where code is null and body <> ''"""
)
def q_application_blocks(spark, sf):
    """Every fourth line is a code alone; the sheet lacks some and has others."""
    at = F.col("pos")
    code = F.concat(F.lit("MAT."), at.cast("string"))
    document = sheets.application_blocks(S.doc_lines(spark, sf), ["doc_id"], "pos", "line", F.when(at % 4 == 0, code))
    sheet = sheets.application_blocks(S.edited_lines(spark, sf), ["doc_id"], "pos", "line", F.when(((at % 4 == 0) & (at % 12 != 8)) | (at % 20 == 19), code))
    found = sheets.compare_blocks(document, sheet, ["doc_id"], text_status)
    side = F.when(F.col("code").isNull(), "loose").when(F.col("sheet").isNull(), "EXCELDE_YOK").when(F.col("document").isNull(), "PDF_DE_YOK").otherwise("both")
    return found.select("doc_id", "code", side.alias("side"), "status")


# ---- fields: the words of a line as spans of one row; long ones reach the next


def _spans(spark, sf):
    words = S.doc_lines(spark, sf).select(F.col("doc_id").alias("field"), F.col("pos").alias("row"), F.posexplode(F.split("line", " ")).alias("i", "text"))
    x0 = (F.col("i") * 50).cast("double")
    return words.select("field", "row", x0.alias("x0"), (x0 + F.char_length("text") * 6).alias("x1"), F.lit(10.0).alias("size"), (F.col("row") * 100_000 + F.col("i")).alias("id"), F.expr("row div 40").alias("page"), "text")


_OFFSETS = f"""{S.SQL_LINES}, w as (select doc_id as field, pos as row, k - 1 as i, text from (select doc_id, pos, unnest(string_split(line, ' ')) as text, generate_subscripts(string_split(line, ' '), 1) as k from lines)),
    x as (select *, i * 50.0 as x0, i * 50.0 + length(text) * 6 as x1, row * 100000 + i as id, row // 40 as page from w where regexp_replace(text, '\\s', '', 'g') <> ''),
    g as (select *, case when x0 - lag(x1) over v > 1.5 and not regexp_matches(lag(text) over v, '[ \\t]$') and not regexp_matches(text, '^[ \\t]') then ' ' else '' end || text as piece from x window v as (partition by field, row order by x0, id)),
    o as (select *, sum(length(piece)) over (partition by field, row order by x0, id) as t from g), l as (select field, row, string_agg(piece, '' order by x0, id) as line from g group by 1, 2),
    z as (select field, row, regexp_replace(line, '^\\s+|\\s+$', '', 'g') as line, length(line) - length(regexp_replace(line, '^\\s+', '')) as lead from l), a as (select *, coalesce(sum(length(line) + 1) over (partition by field order by row rows between unbounded preceding and 1 preceding), 0) as top from z),
    s as (select o.*, (least(greatest(t - length(text) - lead, 0), length(line)) + top)::int as start, (least(greatest(t - lead, 0), length(line)) + top)::int as end_ from o join a using (field, row))"""


@query(f"with {_OFFSETS} select field, id, start, end_ as \"end\" from s")
def q_span_offsets(spark, sf):
    return fields.span_offsets(_spans(spark, sf)).select("field", "id", "start", "end")


@query(f"with {_OFFSETS}, t as (select field, string_agg(line, chr(10) order by row) as text from a group by 1) select t.field, t.text, string_agg(distinct page::varchar, ',' order by page::varchar) as pages, count(*) as spans from t join s on s.field = t.field group by t.field, t.text")
def q_field_texts(spark, sf):
    found = fields.field_texts(fields.span_offsets(_spans(spark, sf)))
    return found.select("field", "text", F.array_join(F.array_sort(F.col("pages").cast("array<string>")), ",").alias("pages"), F.size("ids").cast("long").alias("spans"))


@query(
    f"""with {_OFFSETS}, t as (select field, string_agg(line, chr(10) order by row) as text from a group by 1), r as (select field, text, 10 as b, 40 as e from t), c as (select *, substring(text, b + 1, e - b) as s from r),
d as (select field, regexp_replace(s, '^\\s+|\\s+$', '', 'g') as text, b + length(s) - length(regexp_replace(s, '^\\s+', '')) as b from c) select d.field, d.text, string_agg(s.id::varchar, ',' order by s.row, s.x0, s.id) as ids from d join s on s.field = d.field and s.start < d.b + length(d.text) and s.end_ > d.b where d.text <> '' group by d.field, d.text"""
)
def q_sub_fields(spark, sf):
    """Characters 10 to 40 of each field."""
    offsets = fields.span_offsets(_spans(spark, sf))
    texts = fields.field_texts(offsets)
    found = fields.sub_fields(texts, offsets, texts.select(F.lit(1).alias("part"), "field", F.lit(10).alias("start"), F.lit(40).alias("end")))
    return found.select("field", "text", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


@query(
    f"""with {_OFFSETS}, t as (select field, string_agg(line, chr(10) order by row) as text from a group by 1), n as (select field, text, substring(text, 21, 12) as needle from t where length(text) >= 32), p as (select *, instr(text, needle) - 1 as top, needle = trim(needle, ' ' || chr(10) || chr(9)) as clean from n)
select p.field, needle, s.id, s.page::int as page from p join s on s.field = p.field and s.start < top + 12 and s.end_ > top where clean and needle <> ''"""
)
def q_text_places(spark, sf):
    """Twelve characters of each field, looked for in it; needles with white space at an end are left out."""
    offsets = fields.span_offsets(_spans(spark, sf))
    texts = fields.field_texts(offsets)
    needle = F.substring("text", 21, 12)
    wanted = texts.filter((F.char_length("text") >= 32) & (needle == F.regexp_replace(needle, r"^[ \n\t]+|[ \n\t]+$", ""))).select("field", needle.alias("needle"))
    return fields.text_places(offsets, texts, wanted).select("field", "needle", "id", F.col("page").cast("int").alias("page"))
