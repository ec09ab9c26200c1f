"""Queries of a document's own structure pages, beside their SQL. Events stand in for spans: a user is a document, ten
events of a user a page, and every fifth page is empty."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from docrecon.operators import code_checks as C
from docrecon.operators import segment
from docrecon.operators import structure_pages as P
from docrecon.plans import stand_ins as S
from docrecon.plans.queries import query


def page_spans(spark, sf):
    """Some signups are titles and some errors structure headings or codes; pages differ in scale."""
    at = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    rows = S.table(spark, sf, "events").select(F.col("user_id").alias("doc"), F.col("event_id").alias("e"), F.col("event_type").alias("t"), at.alias("n"))
    rows = rows.withColumns({"page": F.expr("cast(n div 10 + n div 40 as int)"), "idx": F.expr("cast(n % 10 as int)")})
    is_title = F.expr("t = 'signup' and e % 3 = 0")
    text = F.expr("case when t = 'signup' and e % 3 = 0 then concat('1. TEMA: ', e % 2) when t = 'error' and e % 4 = 0 then 'Programın yapısı' when t = 'error' and e % 7 = 0 then 'EBRU.I.1.1. kod' else concat(t, ' ', e) end")
    scale = F.when((F.col("doc") + F.col("page")) % 3 == 0, 0.75).otherwise(1.0)
    size = F.expr("case when t = 'signup' and e % 3 = 0 then 12 + e % 5 when t = 'error' and e % 4 = 0 then 16 when t = 'error' and e % 7 = 0 then 30 else 10 + e % 6 end") * scale
    return rows.select("doc", "page", "idx", (F.col("idx") * 14.0 - F.col("e") % 2 * 20).cast("double").alias("y0"), text.alias("text"), size.cast("double").alias("size"), F.when(is_title, F.when(F.col("e") % 5 == 0, 0x00FF00).otherwise(0x0000FF + F.col("e") % 2 * 0x050000)).otherwise(F.lit(0x333333)).cast("int").alias("color"), is_title.alias("is_title"), F.expr("t <> 'view'").alias("marked"), F.expr("t <> 'purchase'").alias("bold"))


SQL_PAGES = f"""e as (select user_id as doc, event_id as e, event_type as t, row_number() over (partition by user_id order by ts, event_id) - 1 as n from events),
b as (select *, (n // 10 + n // 40)::int as page, (n % 10)::int as idx, t = 'signup' and e % 3 = 0 as is_title, t = 'error' and e % 4 = 0 as is_hint, t = 'error' and e % 4 <> 0 and e % 7 = 0 as is_code from e),
s as (select *, idx * 14.0::double - e % 2 * 20 as y0, case when is_title then '1. TEMA: ' || e % 2 when is_hint then 'Programın yapısı' when is_code then 'EBRU.I.1.1. kod' else t || ' ' || e end as text,
    (case when is_title then 12 + e % 5 when is_hint then 16 when is_code then 30 else 10 + e % 6 end * case when (doc + page) % 3 = 0 then 0.75 else 1 end)::double as size, case when e % 5 = 0 then -1 else e % 2 end as hue from b),
hue as (select doc, arg_max(green, (n, -first)) as green from (select doc, hue, hue = -1 as green, count(*) as n, min(page * 1000000 + (y0 + 100) * 1000 + idx) as first from s where is_title group by 1, 2) group by 1),
tt as (select s.*, row_number() over (partition by doc order by page, y0, idx) as k, count(*) over (partition by doc) as m from s join hue using (doc) where is_title and (hue = -1) = green),
md as (select doc, list_sort(list(size))[count(*) // 2 + 1] as median, min(page) as fp from tt group by 1),
f as (select tt.doc, tt.text as title, tt.size, median, fp from tt join md using (doc) where k = 1),
h as (select doc, arg_max(page, page * 100 + idx) as hp, arg_max(text, page * 100 + idx) as heading, arg_max(s.size, page * 100 + idx) as large from s join md using (doc) where is_hint and page <= fp group by 1),
nx as (select doc, arg_min(text, k) as nxt from tt join md using (doc) where page > fp group by 1),
hd as (select s.doc, s.page, s.size from s anti join tt on tt.doc = s.doc and tt.e = s.e where s.t <> 'view' and s.t <> 'purchase'),
op as (select doc, page from (select doc, page, row_number() over (partition by doc order by page) as r from (select distinct doc, page from tt) join md using (doc) where page <> fp) where r <= 6),
sc as (select f.doc from f where (select count(*) from hd where hd.doc = f.doc and hd.page = f.fp) >= 5 and (select count(*) from hd semi join op on op.doc = hd.doc and op.page = hd.page where hd.doc = f.doc) >= 5
    and (select list_sort(list(hd.size))[count(*) // 2 + 1] from hd where hd.doc = f.doc and hd.page = f.fp) < 0.85 * (select list_sort(list(hd.size))[count(*) // 2 + 1] from hd semi join op on op.doc = hd.doc and op.page = hd.page where hd.doc = f.doc)),
w as (select f.*, hp, heading, large, case when fp = hp then 'heading_page' when fp - hp <= 10 and nxt = title then 'repeated' when f.size < median * 0.9 then 'small' when f.doc in (select doc from sc) then 'scaled' end as why from f left join h using (doc) left join nx using (doc)),
pg as (select doc, page, max(case when not is_code then size end) as top, bool_or(e in (select e from tt)) as titled from s group by 1, 2),
x as (select doc, fp, fp as page, coalesce(large, median) * 0.95 as stop from w where why is not null
    union all select x.doc, x.fp, pg.page, x.stop from x join pg on pg.doc = x.doc and pg.page = x.page + 1 where not titled and coalesce(top < x.stop, true))"""


@query(
    f"""with recursive {SQL_PAGES} select doc, hp as heading_page, heading, case when why is not null then fp end as title_page, case when why is not null then title end as title, why, case when why is not null then fp end as first_page, last_page,
case when why is null then 'STRUCTURE_PAGE_NOT_FOUND' end as code from (select distinct doc from s) left join w using (doc) left join (select doc, max(page) as last_page from x group by 1) using (doc)"""
)
def q_structure_pages(spark, sf):
    return P.structure_pages(page_spans(spark, sf))


# ---- what a unit declares and uses


def checked_codes(spark, sf):
    """(used, declared) as units' codes; field skills declare the prefix E alone, and L is declared in full only."""
    parts = S.table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.upper(F.substring("p_type", 1, 1)).alias("prefix"), F.regexp_extract("p_brand", "[0-9]+", 0).alias("b"), F.col("p_size").cast("string").alias("s"))
    rows = S.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("unit"), "l_partkey").distinct().join(parts, "l_partkey")
    used = rows.select("unit", "prefix", F.expr("if(l_partkey % 7 = 0, array(b), array(b, s))").alias("segments"))
    key = F.col("l_partkey") + F.col("unit")
    category = F.when(F.col("prefix") == "E", "ALAN BECERİLERİ").otherwise(F.concat(F.lit("Giriş > K"), (F.col("l_partkey") % 3 + F.when(F.col("prefix") == "M", 5).otherwise(0)).cast("string")))
    declared = rows.filter(key % 4 == 0).select("unit", F.col("l_partkey").alias("place"), category.alias("category"), "prefix", F.when((key % 8 == 0) & (F.col("prefix") != "L"), F.array("b")).otherwise(F.array("b", "s")).alias("segments"))
    return used, declared


SQL_CHECKED = """r as (select distinct l_suppkey as unit, l_partkey as k from lineitem), m as (select unit, k, upper(substring(p_type, 1, 1)) as prefix, regexp_extract(p_brand, '[0-9]+') as b, p_size::varchar as s from r join part on p_partkey = k),
u as (select distinct unit, prefix, case when k % 7 = 0 then [b] else [b, s] end as g from m),
d as (select unit, k as place, case when prefix = 'E' then 'ALAN BECERİLERİ' else 'Giriş > K' || (k % 3 + case when prefix = 'M' then 5 else 0 end) end as category, prefix, case when (k + unit) % 8 = 0 and prefix <> 'L' then [b] else [b, s] end as g from m where (k + unit) % 4 = 0),
c as (select * from d where category <> 'ALAN BECERİLERİ'), lm as (select prefix, min(len(g)) as least from d group by 1),
un as (select u.*, coalesce(len(g) < least, false) as incomplete from u left join lm using (prefix) where prefix not in (select prefix from d where category = 'ALAN BECERİLERİ') and not exists (select 1 from d where d.unit = u.unit and d.prefix = u.prefix and u.g[1:len(d.g)] = d.g)),
pc as (select un.unit, un.prefix, un.g, count(distinct category) as a, min(category) as ca, count(distinct category) filter (where c.g[1] = un.g[1]) as b, min(category) filter (where c.g[1] = un.g[1]) as cb from un join c on c.unit = un.unit and c.prefix = un.prefix group by all),
pl as (select unit, prefix, g, case when a = 1 then ca when b = 1 then cb end as category from pc where a = 1 or b = 1)"""


@query(f"with {SQL_CHECKED} select unit, prefix, array_to_string(g, '.') as code, incomplete from un")
def q_undeclared_codes(spark, sf):
    used, declared = checked_codes(spark, sf)
    return C.undeclared_codes(used, declared, ["unit"]).select("unit", "prefix", F.array_join("segments", ".").alias("code"), "incomplete")


@query(
    f"""with {SQL_CHECKED}, hd as (select unit, category, prefix, g, min(place) as place, prefix || array_to_string(g, '.') as code from c group by 1, 2, 3, 4),
mt as (select distinct hd.unit, hd.category, u.prefix || array_to_string(u.g, '.') as code from hd join u on u.unit = hd.unit and u.prefix = hd.prefix and u.g[1:len(hd.g)] = hd.g),
mi as (select un.unit, coalesce(pl.category, '(kategorisi belirlenemeyen)') as category, un.prefix || array_to_string(un.g, '.') as code from un left join pl on pl.unit = un.unit and pl.prefix = un.prefix and pl.g = un.g where not incomplete),
t as (select unit, category from hd union select unit, category from mi),
x as (select unit, category, string_agg(code, ', ' order by place, code) as declared, string_agg(code, ', ' order by place, code) filter (where not exists (select 1 from u where u.unit = hd.unit and u.prefix = hd.prefix and u.g[1:len(hd.g)] = hd.g)) as unused from hd group by 1, 2),
y as (select unit, category, string_agg(code, ', ' order by code) as used from mt group by 1, 2), z as (select unit, category, string_agg(code, ', ' order by code) as undeclared from mi group by 1, 2)
select unit, category, coalesce(declared, '') as declared, concat_ws(', ', used, undeclared) as used, coalesce(unused, '') as unused, coalesce(undeclared, '') as undeclared from t left join x using (unit, category) left join y using (unit, category) left join z using (unit, category)"""
)
def q_code_checks(spark, sf):
    """Declared and used codes of each category of each unit."""
    return C.code_checks(C.code_roles(*checked_codes(spark, sf), ["unit"]), ["unit"])


@query(
    f"""with {SQL_CHECKED} select unit, prefix, array_to_string(g, '.') as code, category, 'placed' as how from pl semi join un using (unit, prefix, g)
union all select n.unit, n.prefix, array_to_string(n.g, '.'), q.category, case when q.category is not null then 'prefix' end from (select * from un anti join pl using (unit, prefix, g)) n left join (select distinct unit, prefix, category from d) q on q.unit = n.unit and q.prefix = n.prefix"""
)
def q_declaring_sections(spark, sf):
    """Sections in which an undeclared code was to be expected."""
    used, declared = checked_codes(spark, sf)
    found = C.declaring_sections(C.undeclared_codes(used, declared, ["unit"]), declared, ["unit"])
    return found.select("unit", "prefix", F.array_join("segments", ".").alias("code"), "category", "how")


_APPLICATIONS = rf"""{S.SQL_LINES}, r as (select source, doc_id, pos // 3 as section, pos, line, length(line) % 4 = 0 as m from lines), h as (select doc_id, source, section, min(pos) as pos, min(case when m then pos end) as code, arg_min(line, pos) as line from r group by 1, 2, 3),
k as (select *, regexp_extract(line, '^\s*(\S+)', 1) as key, min(case when pos = code then pos end) over (partition by doc_id) as f from h), a as (select * from k where pos > f and code is not null),
v as (select source, key, count(*) as n, min((doc_id, section)) as first from a where pos = code group by 1, 2), l as (select source, key as label from (select *, row_number() over (partition by source order by n desc, first) as o from v) where o = 1),
w as (select doc_id, section, code from a join l using (source) where key <> label)"""


@query(f"with {_APPLICATIONS} select doc_id, section::bigint as section, pos, pos = code as starts from r join w using (doc_id, section) where pos >= code")
def q_unlabelled_applications(spark, sf):
    """Application rows under another section's label, the first of each section being APPLICATIONS_LABEL_MISSING."""
    rows = S.doc_lines(spark, sf).withColumns({"section": F.expr("pos div 3"), "m": F.char_length("line") % 4 == 0})
    kinds = segment.first_section(rows, "doc_id", "section", "pos", F.col("m"))
    key = F.regexp_extract("line", r"^\s*(\S+)", 1)
    sections = rows.groupBy("source", "doc_id", "section").agg(F.min_by(key, "pos").alias("key")).join(kinds, ["doc_id", "section"])
    moved = segment.unlabelled_applications(rows, sections, "source", "doc_id", "section", "pos", "m")
    first = F.col("pos") == F.min("pos").over(Window.partitionBy("doc_id", "section"))
    return moved.select("doc_id", "section", "pos", first.alias("starts"))
