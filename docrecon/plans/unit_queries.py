"""Queries of units, labels, codes and answers, each beside its SQL.

Events stand in for spans: a user is a document, 40 events of a user a page, two events a line; the event's type is the
colour that a span has.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from docrecon.functions import codes, labels
from docrecon.functions.keys import norm_label
from docrecon.operators import answers as A
from docrecon.operators import cells, diff
from docrecon.operators import code_columns as K
from docrecon.operators import declarations as D
from docrecon.operators import label_lines as L
from docrecon.operators import table_cells as T
from docrecon.operators import units as U
from docrecon.operators.scans import kept
from docrecon.plans import grid_queries as G
from docrecon.plans import stand_ins as S
from docrecon.plans.queries import query
from docrecon.streaming import ingest


def unit_spans(spark, sf):
    """doc, page, idx, row, text, x0, y0, x1, y1, size, kind, label, is_title. Signups are titles, clicks labels, errors
    headings or marked text, the others body."""
    at = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    rows = S.table(spark, sf, "events").select("user_id", "event_id", "event_type", at.alias("n"))
    idx, row, e = F.col("n") % 40, F.expr("cast(n % 40 div 2 as int)"), F.col("event_id")
    kind = F.expr("case event_type when 'signup' then 'title' when 'click' then case when event_id % 9 = 4 then 'note' else 'label' end when 'error' then case when event_id % 3 = 0 then 'heading' else 'body' end else 'body' end")
    x0 = F.when((idx % 2 == 0) & (e % 4 != 3), F.when(e % 11 == 0, 20).otherwise(60)).otherwise(F.when(e % 5 == 0, 150).otherwise(200)).cast("double")
    y0 = (row * 14 + F.when(F.col("event_type").isin("view", "purchase") & (e % 3 == 0), 9).when(e % 6 == 0, 3).otherwise(0)).cast("double")
    text = F.expr("case when event_type <> 'signup' then concat(event_type, ' ', event_id % 17) when event_id % 4 = 0 then concat(event_id % 8, '. SINIF') else concat(event_id % 9, '. TEMA: ', event_id % 23) end")
    return rows.select(
        F.col("user_id").alias("doc"), F.expr("cast(n div 40 as int)").alias("page"), idx.cast("int").alias("idx"), row.alias("row"), text.alias("text"), x0.alias("x0"), y0.alias("y0"), (x0 + 80 + e % 3 * 30).alias("x1"),
        (y0 + 10 + e % 2).alias("y1"), F.when(e % 10 == 0, 16.0).otherwise(12.0).alias("size"), kind.alias("kind"), F.when(F.col("event_type") == "click", e).alias("label"), ((F.col("event_type") == "signup") & (e % 4 != 0)).alias("is_title"),
    )


SQL_UNIT_SPANS = """e as (select user_id as doc, event_id as e, event_type as t, row_number() over (partition by user_id order by ts, event_id) - 1 as n from events),
spans as (select doc, (n // 40)::int as page, (n % 40)::int as idx, (n % 40 // 2)::int as row,
    case when t <> 'signup' then t || ' ' || e % 17 when e % 4 = 0 then e % 8 || '. SINIF' else e % 9 || '. TEMA: ' || e % 23 end as text,
    case when n % 2 = 0 and e % 4 <> 3 then case when e % 11 = 0 then 20 else 60 end else case when e % 5 = 0 then 150 else 200 end end::double as x0,
    (n % 40 // 2 * 14 + case when t in ('view', 'purchase') and e % 3 = 0 then 9 when e % 6 = 0 then 3 else 0 end)::double as y0, x0 + 80 + e % 3 * 30 as x1, y0 + 10 + e % 2 as y1, case when e % 10 = 0 then 16.0 else 12.0 end as size,
    case t when 'signup' then 'title' when 'click' then case when e % 9 = 4 then 'note' else 'label' end when 'error' then case when e % 3 = 0 then 'heading' else 'body' end else 'body' end as kind,
    case when t = 'click' then e end as label, t = 'signup' and e % 4 <> 0 as is_title from e)"""

#: The same states by windows over whole documents.
SQL_ROLES = f"""{SQL_UNIT_SPANS},
rw as (select doc, page, row, max(x0) filter (where kind <> 'label') as other, max((kind = 'label')::int) as labelled from spans group by 1, 2, 3),
tp as (select doc, page, label, x1, coalesce(other < x1 - 2, true) as is_top from spans join rw using (doc, page, row) where kind = 'label'),
ed as (select doc, page, max(x1) as edge from tp where not is_top group by 1, 2),
a as (select s.*, labelled, tp.is_top, edge, lag(kind) over w as before, lag(struct_pack(page := s.page, x0 := x0, x1 := s.x1, y0 := y0, y1 := y1, size := size)) over w as p
    from spans s join rw using (doc, page, row) left join tp on tp.doc = s.doc and tp.page = s.page and tp.label = s.label and kind = 'label' left join ed on ed.doc = s.doc and ed.page = s.page where kind <> 'note' window w as (partition by s.doc order by s.page, idx)),
b as (select *, kind = 'title' and coalesce(before, '') <> 'title' as starts, coalesce(before = 'title' and page = p.page and (abs((y0 + y1) / 2 - (p.y0 + p.y1) / 2) < 3
    or (y0 - p.y1 between 0 and 0.8 * p.size and least(x1, p.x1) > greatest(x0, p.x0) and abs(size - p.size) < 0.5)), false) as joins from a),
c as (select *, sum(starts::int) over (partition by doc order by page, idx) as run from b),
d as (select *, coalesce(max(case when kind = 'title' and is_title then run end) over (partition by doc order by page, idx rows between unbounded preceding and 1 preceding) = run, false) and kind = 'title' as after from c),
f as (select *, kind = 'title' and is_title and not after as opens, kind = 'title' and not is_title and not after as ctx from d),
g as (select *, sum(opens::int) over w as u, sum((kind = 'label')::int) over w as ls, sum((ctx and (starts or not joins))::int) over w as cs, sum((after and not joins)::int) over w as bs from f window w as (partition by doc order by page, idx)),
h as (select *, last_value(case when opens then 1 when starts or kind = 'heading' then 0 end ignore nulls) over w as state, last_value(case when opens then ls end ignore nulls) over w as l0, last_value(case when opens then bs end ignore nulls) over w as b0,
    last_value(case when ctx then cs when kind = 'heading' then 0 end ignore nulls) over w as held, last_value(case when kind = 'label' then is_top end ignore nulls) over w as under from g window w as (partition by doc order by page, idx)),
i as (select *, last_value(case when opens then coalesce(held, 0) end ignore nulls) over (partition by doc order by page, idx) as has, coalesce(state = 1, false) as inside, ls - l0 as sec from h),
j as (select *, case when opens then 'title' when after then case when bs > b0 then 'subtitle' else 'title' end when ctx then 'context' when kind = 'heading' then 'heading' when kind = 'label' then case when inside then 'label' else 'orphan' end
    when inside and labelled = 0 and not (sec > 0 and coalesce(under, false)) and coalesce(x0 < edge - 20, false) then 'note' when inside then 'content' else 'outside' end as role from i),
roles as (select doc, page, idx, row, text, x0, y0, x1, y1, size, label, role, case when inside and role not in ('heading', 'orphan', 'note', 'context') then u end::int as unit,
    case when role in ('label', 'content') then sec end::int as section, case when role = 'context' then cs when inside and role not in ('heading', 'orphan', 'note') then nullif(has, 0) end::int as context from j
    union all select doc, page, idx, row, text, x0, y0, x1, y1, size, label, 'note', null, null, null from spans where kind = 'note')"""


@query(f"with {SQL_ROLES} select doc, page, idx, role, unit, section, context from roles")
def q_span_roles(spark, sf):
    return U.span_roles(unit_spans(spark, sf)).select("doc", "page", "idx", "role", "unit", "section", "context")


@query(
    f"""with {SQL_ROLES}, t as (select doc, unit, string_agg(text, ' ' order by page, idx) as title, min(page) as page from roles where role = 'title' group by 1, 2),
x as (select doc, context, string_agg(text, ' ' order by page, idx) as c from roles where role = 'context' group by 1, 2),
z as (select doc, unit, max(context) as context, count(distinct section) as sections, count(*) filter (where role = 'content') as content from roles where unit is not null group by 1, 2)
select t.doc, t.unit, title, x.c as context, page, sections, content from t join z using (doc, unit) left join x on x.doc = t.doc and x.context = z.context"""
)
def q_extract_units(spark, sf):
    return U.units(U.span_roles(unit_spans(spark, sf)))


@query(
    f"""with {SQL_ROLES} select doc, page, 'ORPHAN_LABEL' as code, text, 1 as spans from roles where role = 'orphan'
union all select doc, page, 'PAGE_NOTES', null, count(*) from roles where role = 'note' group by 1, 2"""
)
def q_orphan_labels(spark, sf):
    return U.orphan_labels(U.span_roles(unit_spans(spark, sf)))


@query(
    f"""with {SQL_ROLES}, l as (select doc, unit, section, page as lp, x1 as lx, y0 as ly, (y0 + y1) / 2 as lm, size as ls from roles where role = 'label'),
r as (select doc, unit, section, page, row, min(x0) as x, min(y0) as y0, max(y1) as y1, min_by((y0 + y1) / 2, idx) as y from roles where role = 'content' group by all),
m as (select r.*, n.lx, n.ly, n.lm, n.ls, o.lp as op, o.lm as om, r.y >= n.ly - 0.5 * n.ls and x >= n.lx - 2 as fits, lag(y1) over w as b, lag(y) over w as a from r join l n on n.doc = r.doc and n.unit = r.unit and n.section = r.section + 1 and n.lp = r.page
    left join l o on o.doc = r.doc and o.unit = r.unit and o.section = r.section window w as (partition by r.doc, r.unit, r.section order by row)),
t as (select *, min(row) over (partition by doc, unit, section) as first from m where row > coalesce((select max(row) from m k where k.doc = m.doc and k.unit = m.unit and k.section = m.section and not k.fits), -1)),
ok as (select doc, unit, section from t where row = first and (a is not null or op = page) and (a is null or y >= ly or y0 - b > 0.5 * ls) and abs(y - lm) < abs(y - coalesce(a, om)))
select doc, unit, section, page, row, section + 1 as "to" from t semi join ok using (doc, unit, section)"""
)
def q_pulled_rows(spark, sf):
    return U.pulled_rows(U.span_roles(unit_spans(spark, sf)))


# ---- labels over several lines


def label_lines(spark, sf):
    """Brands are documents, ten parts a page; a part's name is a label of one word a line, and a third line here and there."""
    at = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")) - 1
    parts = S.table(spark, sf, "part").select("p_brand", F.col("p_partkey").alias("k"), "p_size", F.split("p_name", " ").alias("w"), at.alias("n"))
    rows = parts.withColumn("l", F.explode(F.expr("sequence(0, if(p_size % 2 = 0, 2, 1))")))
    text = F.expr("case l when 0 then concat(w[0], if(k % 5 = 0, ' VE', '')) when 1 then case when k % 11 = 0 then concat(substring(w[1], 1, char_length(w[1]) - 1), 'q') when k % 6 = 0 then concat('ile ', w[1]) else w[1] end else concat(w[0], ' ', w[1]) end")
    gap = F.expr("case k % 4 when 0 then 12.0D when 1 then 15.0D when 2 then 13.0D else 20.0D end")
    y0, x0 = (F.col("n") % 10) * 60 + F.col("l") * gap, F.expr("60.0D + l * case k % 9 when 0 then 200 when 1 then 70 else 0 end")
    return rows.select(
        F.col("p_brand").alias("doc"), F.expr("cast(n div 10 as int)").alias("page"), (F.col("n") % 10 * 3 + F.col("l")).cast("int").alias("line"), text.alias("text"), x0.alias("x0"), y0.alias("y0"), (x0 + 80).alias("x1"), (y0 + 8).alias("y1"),
        F.lit(10.0).alias("size"), F.expr("if(l > 0 and p_size % 13 = 0, 1, 0)").alias("color"), F.expr("if(l > 0 and k % 8 = 0, 1, 2)").alias("rank"),
    )


SQL_LABEL_LINES = r"""p as (select p_brand, p_partkey as k, p_size, string_split(p_name, ' ') as w, row_number() over (partition by p_brand order by p_partkey) - 1 as n from part),
q as (select *, unnest(range(0, case when p_size % 2 = 0 then 3 else 2 end)) as l from p),
lines as (select p_brand as doc, (n // 10)::int as page, (n % 10 * 3 + l)::int as line,
    case l when 0 then w[1] || case when k % 5 = 0 then ' VE' else '' end when 1 then case when k % 11 = 0 then substring(w[2], 1, length(w[2]) - 1) || 'q' when k % 6 = 0 then 'ile ' || w[2] else w[2] end else w[1] || ' ' || w[2] end as text,
    60.0::double + l * case k % 9 when 0 then 200 when 1 then 70 else 0 end as x0, x0 + 80 as x1, (n % 10) * 60 + l * case k % 4 when 0 then 12.0::double when 1 then 15.0 when 2 then 13.0 else 20.0 end as y0, y0 + 8 as y1, 10.0 as size,
    case when l > 0 and p_size % 13 = 0 then 1 else 0 end as color, case when l > 0 and k % 8 = 0 then 1 else 2 end as rank from q),
keyed as (select *, regexp_replace(lower(text), '[^a-z0-9]', '', 'g') as norm, row_number() over (partition by doc, page order by line) as i from lines),
known as (select p_brand as doc, list(distinct regexp_replace(p_name, '[^a-z0-9]', '', 'g')) as keys from part where p_size < 25 group by 1)"""


def _begins(key):
    return f"(len(list_filter(b.keys, lambda x: starts_with(x, {key}))) > 0)"


def _misspelt_start(key):
    return f"(length({key}) >= 8 and len(list_filter(b.keys, lambda x: len(list_filter([length({key}) - 1, length({key}), length({key}) + 1], lambda m: length(x) >= m and levenshtein({key}, substring(x, 1, m)) <= 2)) > 0)) > 0)"


def _starts(key):
    near = f"(length({key}) >= 8 and len(list_filter(b.keys, lambda x: length(x) >= 8 and levenshtein({key}, x) <= case when length({key}) < 12 then 1 else 2 end)) = 1)"
    return f"({key} <> '' and ({_begins(key)} or {_misspelt_start(key)} or {near}))"


_WHY = rf"""case when not (b.color = a.color and (b.y0 + b.y1 - a.y0 - a.y1) / 2 > 0 and ((b.y0 + b.y1 - a.y0 - a.y1) / 2 <= 1.6 * a.size or b.y0 - a.y1 <= 0.6 * a.size) and least(r.x1, b.x1) - greatest(r.x0, b.x0) > -2) then 'first'
    when {_begins("(r.key || b.norm)")} then 'prefix' when {_misspelt_start("(r.key || b.norm)")} then 'variant' when b.y0 - a.y1 <= 0.6 * a.size and a.rank = b.rank then
    case when regexp_matches(' ' || lower(a.text), '\s(ve|ile|veya|ya da)\s*$') or regexp_matches(lower(b.text), '^\s*(ve|ile|veya|ya da)\s') then 'connector' when not {_starts("r.key")} and not {_starts("b.norm")} then 'unknown' else 'first' end else 'first' end"""


@query(
    f"""with recursive {SQL_LABEL_LINES}, all_lines as (select keyed.*, coalesce(keys, []) as keys from keyed left join known using (doc)),
r as (select doc, page, i, line, line as label, 'first' as why, norm as key, x0, x1 from all_lines where i = 1
    union all select doc, page, i, line, case why when 'first' then line else label end, why, case why when 'first' then norm else key || norm end, case why when 'first' then bx0 else least(x0, bx0) end, case why when 'first' then bx1 else greatest(x1, bx1) end
    from (select b.doc, b.page, b.i, b.line, r.label, {_WHY} as why, r.key, b.norm, r.x0, r.x1, b.x0 as bx0, b.x1 as bx1 from r join all_lines a on a.doc = r.doc and a.page = r.page and a.i = r.i join all_lines b on b.doc = r.doc and b.page = r.page and b.i = r.i + 1))
select doc, page, line, label, why from r"""
)
def q_merged_labels(spark, sf):
    """Lines of labels put together by the document's vocabulary."""
    known = S.table(spark, sf, "part").filter("p_size < 25").select(F.col("p_brand").alias("doc"), norm_label(F.col("p_name")).alias("key"))
    return L.merged_lines(label_lines(spark, sf), known=known)


_LEAD = "(b.color = a.color and (b.rank = a.rank) and least(r.x1, b.x1) - greatest(r.x0, b.x0) > -2"


@query(
    f"""with recursive {SQL_LABEL_LINES}, sp as (select doc, page, line, round_even((y0 - py1) * 2, 0) / 2 as half from (select *, lag(y1) over w as py1, lag(x0) over w as px0, lag(x1) over w as px1, lag(color) over w as pc, lag(rank) over w as pr, lag(size) over w as ps from lines window w as (partition by doc, page order by line))
    where color = pc and rank = pr and least(x1, px1) - greatest(x0, px0) > -2 and y0 - py1 between -0.3 * ps and ps),
md as (select doc, arg_max(half, (n, -first)) as half from (select doc, half, count(*) as n, min(page * 1000 + line) as first from sp group by 1, 2) group by 1),
lm as (select doc, greatest(half, 0) * 1.4 + 0.5 as top from md), al as (select keyed.*, top from keyed left join lm using (doc)),
r as (select doc, page, i, line, line as label, x0, x1, y1 from al where i = 1
    union all select doc, page, i, line, case when ok then label else line end, case when ok then least(x0, bx0) else bx0 end, case when ok then greatest(x1, bx1) else bx1 end, case when ok then greatest(y1, by1) else by1 end
    from (select b.doc, b.page, b.i, b.line, r.label, r.x0, r.x1, r.y1, b.x0 as bx0, b.x1 as bx1, b.y1 as by1, coalesce({_LEAD} and b.y0 - r.y1 between -0.3 * a.size and a.size and b.y0 - r.y1 <= b.top), false) as ok from r join al a on a.doc = r.doc and a.page = r.page and a.i = r.i join al b on b.doc = r.doc and b.page = r.page and b.i = r.i + 1))
select doc, page, line, label from r"""
)
def q_adaptive_labels(spark, sf):
    """Lines of labels put together by each document's own line spacing."""
    lines = label_lines(spark, sf)
    return L.merged_lines(lines, "by_learned_leading", limits=L.learned_limits(lines)).drop("why")


# ---- codes and columns by section


def coded(spark, sf):
    """(used, declared) codes: a supplier is a unit, its parts' brands and sizes the codes."""
    parts = S.table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.upper(F.substring("p_type", 1, 1)).alias("prefix"), F.regexp_extract("p_brand", "[0-9]+", 0).alias("b"), F.col("p_size").cast("string").alias("s"), "p_name")
    rows = S.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("unit"), "l_partkey").repartition("l_partkey").distinct().join(parts, "l_partkey")
    used = rows.select("unit", (F.col("l_partkey") % 4).alias("lo"), "prefix", F.array("b", "s").alias("segments"))
    key = F.col("l_partkey") + F.col("unit")
    category = F.element_at(F.array(*(F.lit(c) for c in CATEGORIES)), (F.col("l_partkey") % 6 + 1).cast("int"))
    declared = rows.filter((key % 3 == 0) | (key % 5 == 0)).select("unit", F.col("l_partkey").alias("place"), category.alias("category"), "prefix", F.when(key % 3 == 0, F.array("b")).otherwise(F.array("b", "s")).alias("segments"), F.col("p_name").alias("entry"))
    return used, declared


CATEGORIES = ("Giriş > KAVRAMSAL BECERİLER", "Giriş > DEĞERLER", "Giriş > EĞİLİMLER", "Okuryazarlık Becerileri", "Sosyal-Duygusal Öğrenme", "ALAN BECERİLERİ")
SQL_CODED = f"""r as (select distinct l_suppkey as unit, l_partkey from lineitem), p as (select p_partkey as l_partkey, upper(substring(p_type, 1, 1)) as prefix, regexp_extract(p_brand, '[0-9]+') as b, p_size::varchar as s, p_name from part), m as (select * from r join p using (l_partkey)),
u as (select distinct unit, l_partkey % 4 as lo, prefix, [b, s] as segments from m),
d as (select unit, l_partkey as place, {list(CATEGORIES)}[l_partkey % 6 + 1] as category, prefix, case when (l_partkey + unit) % 3 = 0 then [b] else [b, s] end as segments, p_name as entry from m where (l_partkey + unit) % 3 = 0 or (l_partkey + unit) % 5 = 0),
c as (select u.*, max(struct_pack(place := place, category := category, entry := entry)) filter (where d.segments = u.segments) as ex, min(struct_pack(place := place, category := category)) filter (where u.segments[1:len(d.segments)] = d.segments) as co, min(struct_pack(place := place, category := category)) filter (where place is not null) as pr
    from u left join d on d.unit = u.unit and d.prefix = u.prefix group by all),
cats as (select unit, lo, prefix, array_to_string(segments, '.') as code, coalesce(ex.category, co.category, pr.category) as category, ex.entry as entry, case when ex is not null then 'exact' when co is not null then 'cover' when pr is not null then 'prefix' end as how from c)"""


@query(f"with {SQL_CODED} select * from cats")
def q_code_categories(spark, sf):
    used, declared = coded(spark, sf)
    return K.code_categories(used, declared, ["unit"]).select("unit", "lo", "prefix", F.array_join("segments", ".").alias("code"), "category", "entry", "how")


_FOLDED = f"translate({S.sql_norm('''trim(string_split(category, '>')[-1])''')}, 'ğşçöüı', 'gscoui')"


@query(
    f"""with {SQL_CODED}, h as (select unnest({list(K.CODE_COLUMNS)}) as header, unnest({[list(v) for v in K.CODE_COLUMNS.values()]}) as words)
select unit, lo, prefix, code, header, entry from (select *, {_FOLDED} as n from cats where category is not null), h where len(list_filter(words, lambda w: contains(n, w))) > 0"""
)
def q_column_codes(spark, sf):
    used, declared = coded(spark, sf)
    found = K.column_codes(K.code_categories(used, declared, ["unit"]))
    return found.select("unit", "lo", "prefix", F.array_join("segments", ".").alias("code"), "header", "entry")


@query(
    f"""with {SQL_CODED}, n as (select distinct unit, prefix, segments from u where not exists (select 1 from d where d.unit = u.unit and d.prefix = u.prefix and u.segments[1:len(d.segments)] = d.segments)),
k as (select * from d where category <> 'ALAN BECERİLERİ'), x as (select n.unit, n.prefix, n.segments, count(distinct category) as a, min(category) as ca, count(distinct category) filter (where k.segments[1] = n.segments[1]) as b, min(category) filter (where k.segments[1] = n.segments[1]) as cb
    from n join k on k.unit = n.unit and k.prefix = n.prefix group by all)
select unit, prefix, array_to_string(segments, '.') as code, case when a = 1 then ca else cb end as category from x where a = 1 or b = 1"""
)
def q_placed_undeclared(spark, sf):
    used, declared = coded(spark, sf)
    undeclared = codes.uncovered(used.select("unit", "prefix", "segments").distinct(), declared, ["unit"])
    return K.placed_undeclared(undeclared, declared, ["unit"]).select("unit", "prefix", F.array_join("segments", ".").alias("code"), "category")


@query(f"with {SQL_CODED} select u.unit, u.lo, u.prefix, array_to_string(u.segments, '.') as code, arg_min(entry, place) as entry from u left join d on d.unit = u.unit and d.prefix = u.prefix and d.segments = u.segments group by 1, 2, 3, 4")
def q_declared_entry(spark, sf):
    used, declared = coded(spark, sf)
    return K.declared_entries_of(used.distinct(), declared, ["unit"]).select("unit", "lo", "prefix", F.array_join("segments", ".").alias("code"), "entry")


_SECTIONS = f"""s as (select p_brand as unit, p_partkey as pos, case when p_partkey % 17 = 0 then null else {S.sql_norm("p_name")} end as key, case p_partkey % 7 when 0 then 'group' when 1 then 'applications' else 'other' end as kind from part where p_partkey % 3 = 0),
h as (select distinct case p_partkey % 4 when 0 then p_name when 1 then p_name || ' (ek)' when 2 then p_name || ' / Programlar' else 'Öğrenme-Öğretme Uygulamaları / ' || p_name end as header from part where p_partkey % 3 = 1),
k as (select header, {S.sql_norm("regexp_replace(header, '\\([^)]*\\)', '', 'g')")} as hk from h),
f as (select unit, header, arg_max(pos, (length(key), -pos)) as pos from k join s on key <> '' and kind <> 'group' and (hk = key or (length(key) >= 8 and starts_with(hk, key))) group by 1, 2)"""


@query(f"with {_SECTIONS} select * from f union all select unit, header, min(pos) from s, k where kind = 'applications' and starts_with(hk, 'öğrenmeöğretmeuygulamalari') and not exists (select 1 from f where f.unit = s.unit and f.header = k.header) group by 1, 2")
def q_header_sections(spark, sf):
    part = S.table(spark, sf, "part")
    key = F.when(F.col("p_partkey") % 17 != 0, norm_label(F.col("p_name")))
    sections = part.filter("p_partkey % 3 = 0").select(F.col("p_brand").alias("unit"), F.col("p_partkey").alias("pos"), key.alias("key"), F.expr("case p_partkey % 7 when 0 then 'group' when 1 then 'applications' else 'other' end").alias("kind"))
    header = F.expr("case p_partkey % 4 when 0 then p_name when 1 then concat(p_name, ' (ek)') when 2 then concat(p_name, ' / Programlar') else concat('Öğrenme-Öğretme Uygulamaları / ', p_name) end")
    return K.header_sections(part.filter("p_partkey % 3 = 1").select(header.alias("header")), sections, ["unit"])


# ---- a second reader's answers


def page_sides(spark, sf):
    """(extracted, seen): an order is a page, its items what stands there; the other reader drops, misreads and turns around."""
    parts = S.table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_size")
    at = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*S.ITEM_ORDER))
    rows = S.table(spark, sf, "lineitem").withColumn("pos", at).join(parts, "l_partkey")
    kind = F.expr("case l_returnflag when 'A' then 'unit_titles' when 'N' then 'section_headings' else 'codes' end")
    text = F.when(F.col("l_returnflag") == "R", F.concat(F.lit("D"), F.col("p_size").cast("string"), F.lit("."), (F.col("l_partkey") % 2).cast("string"))).otherwise(F.col("p_name"))
    left = rows.select(F.col("l_orderkey").alias("page"), kind.alias("kind"), "pos", F.col("l_suppkey").alias("unit"), text.alias("text"), "l_partkey")
    misread = F.expr("case when l_partkey % 5 = 1 then concat(left(text, char_length(text) - 1), 'q') when l_partkey % 5 = 2 then upper(text) else text end")
    right = left.filter("l_partkey % 7 <> 0").select("page", "kind", (100 - F.col("pos")).alias("pos"), misread.alias("text"))
    return left.drop("l_partkey"), right


SQL_PAGES = f"""i as (select *, row_number() over (partition by l_orderkey order by {", ".join(S.ITEM_ORDER)}) as pos from lineitem),
x as (select l_orderkey as page, case l_returnflag when 'A' then 'unit_titles' when 'N' then 'section_headings' else 'codes' end as kind, pos, l_suppkey as unit, case when l_returnflag = 'R' then 'D' || p_size || '.' || l_partkey % 2 else p_name end as text, l_partkey from i join part on p_partkey = l_partkey),
y as (select page, kind, 100 - pos as pos, case when l_partkey % 5 = 1 then left(text, length(text) - 1) || 'q' when l_partkey % 5 = 2 then upper(text) else text end as text from x where l_partkey % 7 <> 0),
xk as (select *, case when kind = 'codes' then rtrim(regexp_replace(text, '\\s+', '', 'g'), '.') else {S.sql_norm("text")} end as key from x), yk as (select *, case when kind = 'codes' then rtrim(regexp_replace(text, '\\s+', '', 'g'), '.') else {S.sql_norm("text")} end as key from y),
e as (select page, kind, xk.pos as l, yk.pos as r, row_number() over (partition by page, kind order by xk.pos, yk.pos) as n from xk join yk using (page, kind) where xk.key = yk.key or (kind <> 'codes' and length(xk.key) >= 6 and levenshtein(xk.key, yk.key) <= greatest(1, length(xk.key) // 10))),
w as (select page, kind, n, l, r, true as ok, l as done, [r] as taken from e where n = 1
    union all select page, kind, n, l, r, ok, case when ok then l else done end, case when ok then list_append(taken, r) else taken end from (select e.*, e.l <> w.done and not list_contains(w.taken, e.r) as ok, w.done, w.taken from w join e on e.page = w.page and e.kind = w.kind and e.n = w.n + 1)),
pairs as (select page, kind, l, r from w where ok)"""


@query(
    f"""with recursive {SQL_PAGES}, un as (select page, arg_min(unit, (kind, pos)) as unit from x group by 1)
select x.page, x.kind, unit, case when r is null then 'YALNIZCA_PDF_CIKARIMI' else 'UYUMLU' end as status, case when r is null then 'GEMINI_NOT_CONFIRMED' end as code, x.text as extracted, y.text as seen from x left join pairs p on p.page = x.page and p.kind = x.kind and p.l = x.pos left join y on y.page = x.page and y.kind = x.kind and y.pos = p.r
union all select y.page, y.kind, un.unit, 'YALNIZCA_GEMINI', 'GEMINI_NOT_EXTRACTED', null, y.text from y left join un using (page) where not exists (select 1 from pairs p where p.page = y.page and p.kind = y.kind and p.r = y.pos)"""
)
def q_compared_pages(spark, sf):
    return A.compared_pages(*page_sides(spark, sf))


_ANSWER = "case doc_id % 3 when 0 then replace(substring(text, 20, 30), ' ', '-  ') when 1 then {} || substring(text, 5, 12) else substring(text, 1, 2) end"


@query(
    rf"""with a as (select doc_id as cell, {_ANSWER.format("'zq'")} as answer, {S.sql_layer("text")} as page from documents), k as (select *, {S.sql_layer("answer")} as key from a), g as (select *, length(key) >= 3 and contains(page, key) as stands from k)
select cell, '' as value, case when stands then answer end as answer, case when not stands then answer end as unverified from g"""
)
def q_applied_answers(spark, sf):
    docs = S.table(spark, sf, "documents")
    cells_ = docs.select(F.col("doc_id").alias("cell"), F.lit("").alias("value"))
    answers = docs.select(F.col("doc_id").alias("cell"), F.col("doc_id").alias("page"), F.expr(_ANSWER.format("'zq'")).alias("answer"))
    return A.applied_answers(cells_, answers, docs.select(F.col("doc_id").alias("page"), "text"))


@query("select page, array_to_string(list_sort(list_distinct(list(cell))), ',') as cells from (select p_partkey as cell, unnest([p_size, p_size % 7]) as page from part) group by 1")
def q_page_tasks(spark, sf):
    found = A.page_tasks(S.table(spark, sf, "part").select(F.col("p_partkey").alias("cell"), F.expr("array(p_size, p_size % 7)").alias("pages")))
    return found.select("page", F.array_join("cells", ",").alias("cells"))


@query(
    f"""with {G._GRID}, h as (select * from g where l <> '' or r <> ''), t as (select theme, case when count(*) filter (where l <> '') = 0 then 'YALNIZCA_SİSTEM' when count(*) filter (where r <> '') = 0 then 'YALNIZCA_PDF' end as ts from h group by 1),
o as (select theme, lo, case when count(*) filter (where l <> '') = 0 then 'YALNIZCA_SİSTEM' when count(*) filter (where r <> '') = 0 then 'YALNIZCA_PDF' end as ls from h where lo is not null group by 1, 2),
w as (select h.*, ts, ls from h join t using (theme) left join o on o.theme = h.theme and o.lo = h.lo)
select theme, lo::int as lo, pos::int as pos, header, status, r as sheet, l as document from w where ts is null and ls is null and status in ('FARKLI', 'YALNIZCA_SİSTEM', 'YALNIZCA_PDF')
union all select theme, case when ts is null then lo end::int as lo, null, '*', max(coalesce(ts, ls)), coalesce(max(case when pos is null and ((ts is null and header = 'Outcome') or (ts is not null and header = 'Theme' and lo is null)) then r end), ''),
    coalesce(max(case when pos is null and ((ts is null and header = 'Outcome') or (ts is not null and header = 'Theme' and lo is null)) then l end), '') from w where coalesce(ts, ls) is not null group by 1, 2"""
)
def q_diff_items(spark, sf):
    """Each difference of the grid once, one-sided themes and outcomes as one row."""
    return cells.diff_items(G._grid(spark, sf))


# ---- expected tables from cells: a customer's orders are the rows of a table


def table_cells(spark, sf):
    """doc, table, row, col, x0, y0, x1, y1, text. Headers of two rows; some tables have a title row, some no order column."""
    at = Window.partitionBy("o_custkey")
    rows = S.table(spark, sf, "orders").select(F.col("o_custkey").alias("doc"), "o_orderkey", F.row_number().over(at.orderBy("o_orderkey")).alias("n"), F.floor(F.col("o_totalprice") / 10000).cast("long").alias("h"), (F.col("o_orderkey") % 9).alias("c"))
    one = rows.groupBy("doc").agg(F.count("*").alias("k"), F.sum("c").alias("cs"), F.sum("h").alias("hs"))
    head = [
        "0, 0, 0.0D, 450.0D, if(doc % 4 = 0, concat(doc % 12, '. SINIF DERSİ'), null)", "1, 0, 0.0D, 50.0D, if(doc % 3 <> 0, 'Sıra', null)", "1, 1, 50.0D, 200.0D, if(doc % 5 <> 0, 'TEMA', 'Ana Temalar')", "1, 2, 200.0D, 300.0D, 'Öğrenme Çıktısı Sayısı'",
        "1, 3, 300.0D, 450.0D, 'Süre'", "2, 3, 300.0D, 400.0D, 'Ders Saati'", "2, 4, 400.0D, 450.0D, 'Oran'", "int(k + 3), 1, 50.0D, 200.0D, 'TOPLAM'", "int(k + 3), 2, 200.0D, 300.0D, string(cs)", "int(k + 3), 3, 300.0D, 400.0D, string(hs)",
    ]
    body = [
        "int(n + 2), 0, 0.0D, if(doc % 3 = 0, 45.0D, 50.0D), case when doc % 3 <> 0 then string(n) when doc % 6 = 0 then concat(n, '.') end", "int(n + 2), 1, 50.0D, 200.0D, concat(if(doc % 6 = 3, concat(n, '. '), ''), 'Unit ', o_orderkey)",
        "int(n + 2), 2, 200.0D, 300.0D, if(o_orderkey % 13 = 0, '-', string(c))", "int(n + 2), 3, 300.0D, 400.0D, string(h)", "int(n + 2), 4, 400.0D, 450.0D, concat('% ', h)",
    ]
    spread = lambda df, parts: df.selectExpr("doc", f"stack({len(parts)}, {', '.join(parts)}) as (row, col, x0, x1, text)")
    cells_ = spread(one, head).unionByName(spread(rows, body)).filter("text is not null")
    return cells_.select("doc", F.lit(0).alias("table"), "row", "col", "x0", (F.col("row") * 20.0).alias("y0"), "x1", (F.col("row") * 20.0 + 18).alias("y1"), "text")


SQL_CELLS = """o as (select o_custkey as doc, o_orderkey as k, row_number() over (partition by o_custkey order by o_orderkey) as n, floor(o_totalprice / 10000)::bigint as h, o_orderkey % 9 as c from orders), s as (select doc, count(*) as k, sum(c) as cs, sum(h) as hs from o group by 1),
cells as (select * from (
    select doc, 0 as row, 0 as col, 0.0 as x0, 450.0 as x1, case when doc % 4 = 0 then doc % 12 || '. SINIF DERSİ' end as text from s union all select doc, 1, 0, 0, 50, case when doc % 3 <> 0 then 'Sıra' end from s union all select doc, 1, 1, 50, 200, case when doc % 5 <> 0 then 'TEMA' else 'Ana Temalar' end from s
    union all select doc, 1, 2, 200, 300, 'Öğrenme Çıktısı Sayısı' from s union all select doc, 1, 3, 300, 450, 'Süre' from s union all select doc, 2, 3, 300, 400, 'Ders Saati' from s union all select doc, 2, 4, 400, 450, 'Oran' from s
    union all select doc, k + 3, 1, 50, 200, 'TOPLAM' from s union all select doc, k + 3, 2, 200, 300, cs::varchar from s union all select doc, k + 3, 3, 300, 400, hs::varchar from s
    union all select doc, n + 2, 0, 0, case when doc % 3 = 0 then 45 else 50 end, case when doc % 3 <> 0 then n::varchar when doc % 6 = 0 then n || '.' end from o union all select doc, n + 2, 1, 50, 200, case when doc % 6 = 3 then n || '. ' else '' end || 'Unit ' || k from o
    union all select doc, n + 2, 2, 200, 300, case when k % 13 = 0 then '-' else c::varchar end from o union all select doc, n + 2, 3, 300, 400, h::varchar from o union all select doc, n + 2, 4, 400, 450, '% ' || h from o) where text is not null),
wd as (select doc, min(row) as row, max(x1) - min(x0) as w from cells group by 1), ti as (select doc, row, max(text) as title from cells join wd using (doc, row) group by doc, row, w having count(*) = 1 and max(x1 - x0) >= 0.8 * w),
b as (select * from cells anti join ti using (doc, row)), f as (select *, min(case when regexp_full_match(text, '[0-9]+|-') then row end) over (partition by doc) as start from b),
hd as (select *, case when contains(text, 'Çıktı') then 'lo' when contains(text, 'Saat') then 'hours' when contains(text, 'Sıra') then 'order' when contains(lower(text), 'tema') then 'name' end as role from f where row < start or start is null),
hn as (select doc, arg_min(x0, (lower(text) <> 'tema', x0)) as nx from hd where role = 'name' group by 1), ho as (select doc, bool_or(role = 'order') as has from hd group by 1),
cv as (select f.doc, f.row, f.col, arg_min(struct_pack(role := hd.role), (hd.x1 - hd.x0, hd.row, hd.col)) as r from f join hd on hd.doc = f.doc and (f.x0 + f.x1) / 2 between hd.x0 - 1 and hd.x1 + 1 where f.row >= f.start group by 1, 2, 3),
dr as (select f.*, coalesce(r.role, case when not coalesce(has, false) and regexp_full_match(text, '[0-9]+\\s*\\.') and x1 <= nx + 1 then 'order' end) as role, coalesce(has, false) as has from f left join cv on cv.doc = f.doc and cv.row = f.row and cv.col = f.col left join hn on hn.doc = f.doc left join ho on ho.doc = f.doc where f.row >= f.start),
tx as (select doc, row, has, string_agg(text, ' ' order by col) filter (where role = 'order') as o, string_agg(text, ' ' order by col) filter (where role = 'name') as name, string_agg(text, ' ' order by col) filter (where role = 'lo') as count_raw, string_agg(text, ' ' order by col) filter (where role = 'hours') as h from dr where role is not null group by 1, 2, 3)"""


@query(
    f"""with {SQL_CELLS}, v as (select doc, row, case when o is not null then try_cast(rtrim(o, '.') as int) when not has then try_cast(nullif(regexp_extract(name, '^\\s*([0-9]+)\\s*\\.\\s*\\S', 1), '') as int) end as "order", name, count_raw, case when regexp_full_match(count_raw, '[0-9]+') then count_raw::int end as "count", case when regexp_full_match(h, '[0-9]+') then h::int end as hours from tx)
select doc, row::int as n, "order", name, count_raw, "count", hours, row = max(row) over (partition by doc) and "order" is null and "count" is not null as is_total from v"""
)
def q_table_rows(spark, sf):
    """Rows of expected tables, by the roles of their columns."""
    return T.table_rows(table_cells(spark, sf), "Tema").drop("table")


@query(f"with {SQL_CELLS} select doc, title from ti")
def q_inner_titles(spark, sf):
    return T.inner_titles(table_cells(spark, sf), "Tema").select("doc", "title")


_ABOVE = """t as (select distinct l_orderkey as doc, 300.0::double as top, case when l_orderkey % 5 = 0 then 260.0::double else 0 end as after from lineitem),
l as (select l_orderkey as doc, row_number() over (partition by l_orderkey order by {order}) as row, * from lineitem),
x as (select doc, row, 180 + row * 17.0 + l_partkey % 3 * 2 as y0, y0 + 10 + l_suppkey % 2 as y1, case when l_partkey % 11 = 0 then 14.0 else 12.0 end as size, l_suppkey % 2 as color, l_suppkey % 3 = 0 as heading, l_partkey || ' ' || l_suppkey as text from l)"""


@query(
    f"""with {_ABOVE.format(order=", ".join(S.ITEM_ORDER))}, b as (select x.*, top, lead(struct_pack(color := color, size := size, y0 := y0, heading := heading)) over w as n, max(case when heading then row end) over (partition by doc) as last from x join t using (doc)
    where y1 <= top + 1 and y0 >= greatest(after, top - 90) window w as (partition by doc order by row)),
g as (select *, coalesce(heading and n.heading and color = n.color and abs(size - n.size) <= 0.5 and n.y0 - y1 <= 0.6 * size, false) as goes from b),
s as (select *, coalesce(max(case when row < last and not goes then row end) over (partition by doc), -1) as stop, max(case when y1 >= top - 40 then row end) over (partition by doc) as near from g)
select doc, string_agg(text, chr(10) order by row) as title from s where case when last is not null then row > stop and row <= last else row = near end group by 1"""
)
def q_outer_titles(spark, sf):
    """Titles above tables: an order is a page whose items are lines above its table."""
    at = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*S.ITEM_ORDER))
    rows = S.table(spark, sf, "lineitem").withColumn("row", at)
    y0 = F.lit(180.0) + F.col("row") * 17.0 + F.col("l_partkey") % 3 * 2
    lines = rows.select(F.col("l_orderkey").alias("doc"), F.lit(1).alias("page"), "row", F.lit(0.0).alias("x0"), y0.alias("y0"), F.lit(100.0).alias("x1"), (y0 + 10 + F.col("l_suppkey") % 2).alias("y1"), F.when(F.col("l_partkey") % 11 == 0, 14.0).otherwise(12.0).alias("size"), (F.col("l_suppkey") % 2).alias("color"), (F.col("l_suppkey") % 3 == 0).alias("heading"), F.concat_ws(" ", "l_partkey", "l_suppkey").alias("text"))
    tables_ = rows.select(F.col("l_orderkey").alias("doc")).distinct().select("doc", F.lit(0).alias("table"), F.lit(1).alias("page"), F.lit(0.0).alias("x0"), F.lit(300.0).alias("y0"), F.lit(200.0).alias("x1"), F.when(F.col("doc") % 5 == 0, 260.0).otherwise(0.0).alias("after"))
    return T.outer_titles(tables_, lines).drop("table")


@query(
    """with i as (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) as n from lineitem where l_orderkey % 4 <> 3),
c as (select l_orderkey as doc, n, n || case when l_partkey % 2 = 0 then '. ' else ' ' end || 'Unit ' || l_suppkey as name, ['MAT.5.1.' || n || '.', case when l_partkey % 3 = 0 then 'MAT.5.x' when l_partkey % 3 = 1 then 'MAT. 5.2.' || l_suppkey else 'MAT.5.3.1. text' end] as raws from i)
select doc, n as col, case when contains(name, '. ') then n::int end as "order", name, k - 1 as place, raws[k] as raw, regexp_full_match(raws[k], 'MAT\\. ?[0-9]+\\.[0-9]+\\.[0-9]+\\.?') as parsed from c, (values (1), (2)) as v(k)"""
)
def q_outcome_lists(spark, sf):
    """Tables that list codes under units: an order is a table, its items the columns; some tables have one row too few."""
    at = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*S.ITEM_ORDER))
    rows = S.table(spark, sf, "lineitem").withColumn("n", at)
    name = F.concat(F.col("n").cast("string"), F.when(F.col("l_partkey") % 2 == 0, ". ").otherwise(" "), F.lit("Unit "), F.col("l_suppkey").cast("string"))
    second = F.expr("case l_partkey % 3 when 0 then 'MAT.5.x' when 1 then concat('MAT. 5.2.', l_suppkey) else 'MAT.5.3.1. text' end")
    raw = F.concat(F.lit("MAT.5.1."), F.col("n").cast("string"), F.lit(".\n"), second)
    place = lambda row, col, text: [F.col("l_orderkey").alias("doc"), F.lit(0).alias("table"), F.lit(row).alias("row"), col.cast("int").alias("col"), *(F.lit(0.0).alias(c) for c in ("x0", "y0", "x1", "y1")), text.alias("text")]
    heads = rows.filter("n = 1")
    cells_ = rows.select(*place(0, F.col("n"), name)).unionByName(rows.filter("l_orderkey % 4 <> 3").select(*place(1, F.col("n"), raw)))
    cells_ = cells_.unionByName(heads.select(*place(0, F.lit(0), F.lit("TEMA")))).unionByName(heads.select(*place(1, F.lit(0), F.lit("Öğrenme Çıktıları"))))
    schemes = heads.select(F.col("l_orderkey").alias("doc"), F.lit("MAT").alias("prefix"), F.lit("nnn").alias("types"))
    return T.outcome_lists(cells_, "Tema", schemes).drop("table")


# ---- declared codes: a supplier's section declares the codes of its parts

_PIECES = {
    "spark": "case l_partkey % 9 when 0 then concat('(', code, '. ', p_name, ')') when 1 then concat(code, ',') when 2 then concat(code, '.', p_name) when 3 then concat('ve ', p_name, 'x-', code) when 4 then concat(code, '. ', p_name, ' (', 'Z', code, '. alt, Y', code, '. üst (iç))') else concat(code, '. ', p_name) end",
    "code": "concat(upper(substring(p_type, 1, 1)), p_size, '.', l_partkey % 13)",
}


def declaring(spark, sf):
    """unit, text: declarations in the order of parts, parted by commas; first a plain one."""
    parts = S.table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_type", "p_size")
    rows = S.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("unit"), "l_partkey").distinct().join(parts, "l_partkey").withColumn("code", F.expr(_PIECES["code"])).withColumn("piece", F.expr(_PIECES["spark"]))
    packed = rows.groupBy("unit", (F.col("l_partkey") % 50).alias("section")).agg(F.array_sort(F.collect_list(F.struct("l_partkey", "piece"))).alias("all"))
    return packed.select("unit", "section", F.concat(F.lit("A1. Önce, "), F.array_join(F.transform("all", lambda x: x["piece"]), ", ")).alias("text"))


#: Which pieces declare what, as the rules say it: a code after a comma or a parenthesis and before a full stop and a blank or
#: letter, or before a comma. A code alone has no name unless what follows it, in parentheses or no code, is part of its text.
_SQL_DECLARING = """p as (select p_partkey as l_partkey, p_name, upper(substring(p_type, 1, 1)) || p_size || '.' || p_partkey % 13 as code from part), r as (select distinct l_suppkey as unit, l_partkey from lineitem),
x as (select unit, l_partkey % 50 as section, l_partkey, code, p_name, l_partkey % 9 as k, coalesce(lead(l_partkey % 9) over (partition by unit, l_partkey % 50 order by l_partkey), 9) as next from r join p using (l_partkey)),
d as (select unit, section, l_partkey, 0 as n, code || case when k = 1 then '' else '.' end as code, k = 1 and next not in (0, 3) as bare, k not in (1, 2) as usual, null as parent from x where k <> 3
    union all select unit, section, l_partkey, 1, 'Z' || code || '.', false, true, code from x where k = 4 union all select unit, section, l_partkey, 2, 'Y' || code || '.', false, true, code from x where k = 4),
s as (select distinct unit, section from x)"""


@query(
    f"""with {_SQL_DECLARING} select unit, section, code, 'DECLARATION_NAME_MISSING' as finding from d where bare union all select unit, section, code, 'CODE_FORMAT_ANOMALY' from d where not bare and not usual
union all select unit, section, code, 'DECLARATION_UNPARSED_CODE' from x where k = 3"""
)
def q_declaration_findings(spark, sf):
    found = D.declaration_findings(declaring(spark, sf), ["unit", "section"])
    return found.select("unit", "section", F.col("detail").alias("code"), F.col("code").alias("finding"))


@query()
def q_declared_codes(spark, sf):
    """Declared codes with parents and places in the text."""
    found = D.declared_codes(declaring(spark, sf))
    return found.select("unit", "section", "pos", "start", "end", "code", "parent", "entry", "usual", F.expr("substring(text, start + 1, char_length(entry)) = entry").alias("stands"))


# ---- files that are new or changed: a document is a file, its length and source what a listing says of it


@query(
    """with f as (select 'doc/' || doc_id as path, n_chars as length, source as m, doc_id from documents), n as (select path, sha1(path || '|' || length || '|' || m || '|v2') as signature from f),
s as (select path, sha1(path || '|' || (length + case when doc_id % 5 = 0 then 1 else 0 end) || '|' || m || '|' || case when doc_id % 7 = 0 then 'v1' else 'v2' end) as signature from f where doc_id % 3 <> 0)
select path, signature, case when path in (select path from s) then 'changed' else 'new' end as status from n where signature not in (select signature from s)"""
)
def q_pending_files(spark, sf):
    docs = S.table(spark, sf, "documents").select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"), F.col("n_chars").alias("length"), F.col("source").alias("modificationTime"), "doc_id")
    before = docs.filter("doc_id % 3 <> 0").withColumn("length", F.col("length") + F.when(F.col("doc_id") % 5 == 0, 1).otherwise(0))
    mark = lambda df, settings: df.select("path", ingest.signature(F.col("path"), F.col("length"), F.col("modificationTime"), settings).alias("signature"))
    seen = mark(before.filter("doc_id % 7 = 0"), "v1").unionByName(mark(before.filter("doc_id % 7 <> 0"), "v2"))
    return ingest.pending(docs, seen, "v2")


# ---- statuses that another section or the scope decide, and codes of headings


@query(
    f"""with {S.SQL_LINES}, l as (select distinct doc_id, pos // 3 as section, {S.sql_norm("line")} as key from lines), r as (select distinct doc_id, case when doc_id % 2 = 0 and section % 2 = 0 then section + 1 else section end as section, key from l where section % 5 <> 4),
d as (select coalesce(l.doc_id, r.doc_id) as doc_id, coalesce(l.section, r.section) as section, coalesce(l.key, r.key) as key, case when r.doc_id is null then 'PDF_DE_VAR_EXCELDE_YOK' when l.doc_id is null then 'EXCELDE_VAR_PDF_DE_YOK' else 'AYNI' end as status from l full join r on l.doc_id = r.doc_id and l.section = r.section and l.key = r.key),
w as (select d.*, (select min(l.section) from l where l.doc_id = d.doc_id and l.key = d.key and l.section <> d.section and length(l.key) >= 20) as other from d)
select doc_id, section::bigint as section, key, case when doc_id % 10 = 3 then 'KAPSAM_DIŞI' when status = 'EXCELDE_VAR_PDF_DE_YOK' and other is not null then 'YANLIŞ_BÖLÜM' else status end as status from w"""
)
def q_section_statuses(spark, sf):
    """Texts of the sheet alone that stand in another section of the document, and units outside the scope."""
    ids = ["doc_id", "section", "key"]
    left = S.doc_lines(spark, sf).select("doc_id", F.expr("pos div 3").alias("section"), norm_label(F.col("line")).alias("key")).distinct()
    right = left.filter("section % 5 <> 4").withColumn("section", F.when((F.col("doc_id") % 2 == 0) & (F.col("section") % 2 == 0), F.col("section") + 1).otherwise(F.col("section")))
    found = kept(diff.set_diff(left, right, ids), "diff")
    alone = found.filter("status = 'EXCELDE_VAR_PDF_DE_YOK'").select(*ids)
    placed = diff.wrong_section(found, diff.found_elsewhere(alone, left, "doc_id", "section", "key"), ids)
    scope = S.table(spark, sf, "documents").filter("doc_id % 10 <> 3").select("doc_id")
    return diff.out_of_scope(placed, scope, "doc_id").select(*ids, "status")


@query(
    """with t as (select p_partkey, case p_partkey % 6 when 0 then 'MAT.' || p_size || '.1.' || p_partkey % 9 || '. ' || p_name when 1 then 'MAT.' || p_size || '.0.SÖS' when 2 then 'MAT. ' || p_size || '.' || p_partkey % 9 || '.' when 3 then 'MAT.' || p_size || '.' || p_partkey % 9 || '. ' || p_name when 4 then 'MAT' || p_size || ' 1 2; ' || p_name else 'Bu MAT.' || p_size || '.1.1' end as t from part),
c as (select *, regexp_extract(t, '^(MAT *[.]? *[0-9]+(?: *[.] *| +)[0-9]+(?: *[.] *| +)[0-9]+[.]?)(?:[ ;,)]|$)', 1) as strict, regexp_full_match(t, 'MAT *[.]? *(?:[0-9]+|[A-ZÇĞİÖŞÜ]{1,4}[0-9]*)(?:(?: *[.] *| +)(?:[0-9]+|[A-ZÇĞİÖŞÜ]{1,4}[0-9]*)){1,2}[.]?') as alone from t)
select p_partkey, case when strict <> '' then strict when alone then t end as code from c"""
)
def q_outcome_code(spark, sf):
    """The code of an outcome's heading: of the learned types, or of any if the line is nothing else."""
    text = F.expr("case p_partkey % 6 when 0 then concat('MAT.', p_size, '.1.', p_partkey % 9, '. ', p_name) when 1 then concat('MAT.', p_size, '.0.SÖS') when 2 then concat('MAT. ', p_size, '.', p_partkey % 9, '.') when 3 then concat('MAT.', p_size, '.', p_partkey % 9, '. ', p_name) when 4 then concat('MAT', p_size, ' 1 2; ', p_name) else concat('Bu MAT.', p_size, '.1.1') end")
    return S.table(spark, sf, "part").select("p_partkey", labels.outcome_code(text, F.lit("MAT"), F.lit("nnn")).alias("code"))
