"""Queries of structure learning, segmentation, expected tables, locations and reports, each beside its SQL."""

from pyspark.sql import functions as F

from docrecon.operators import expected, layout, locate, report, schema, segment
from docrecon.plans import stand_ins as S
from docrecon.plans.queries import _NAMED, findings, query
from docrecon.shipping import shared_folder, ship
from docrecon.streaming import ingest

# Label lines: the first two words of a line; units are runs of three lines.
_LABELS = rf"{S.SQL_LINES}, b as (select source, doc_id * 100000 + pos // 3 as unit, pos, regexp_extract(line, '^\s*(\S+)', 1) as label from lines)"


def _label_lines(spark, sf):
    return S.doc_lines(spark, sf).select("source", F.struct("doc_id", F.expr("pos div 3").alias("place")).alias("unit"), "pos", F.regexp_extract("line", r"^\s*(\S+)", 1).alias("label"))


@query(
    f"""with {_LABELS}, k as (select *, {S.sql_norm('label')} as key from b), u as (select source, count(distinct unit) as n from b group by 1), v as (select source, key, count(distinct unit) as units, avg(pos) as mean from k where key <> '' group by 1, 2),
s as (select source, key, label, row_number() over (partition by source, key order by count(*) desc, min(unit * 100000 + pos)) as r from k where key <> '' group by source, key, label)
select source, key, label, units, (row_number() over (partition by source order by mean, key))::int as place from v join u using (source) join s using (source, key) where r = 1 and units >= greatest(2, 0.05 * n)"""
)
def q_learn_labels(spark, sf):
    return schema.learn_labels(_label_lines(spark, sf), "source", "unit", "pos", "label", share=0.05)


@query(f"with {_LABELS}, c as (select distinct source, pos % 6 as color, {S.sql_norm('label')} as key from b), v as (select distinct source, key from (select source, {S.sql_norm('label')} as key from b) group by source, key having count(*) >= 5) select source, color::int as color, count(distinct key) as hits from c join v using (source, key) group by 1, 2 having count(distinct key) >= 2")
def q_confirm_colors(spark, sf):
    from docrecon.functions.keys import norm_label

    rows = _label_lines(spark, sf).select("source", (F.col("pos") % 6).alias("color"), norm_label(F.col("label")).alias("key"))
    vocabulary = rows.groupBy("source", "key").agg(F.count("*").alias("n")).filter("n >= 5")
    return schema.confirmed_values(rows, vocabulary, "source", "color", "key")


@query("""with p as (select o_custkey, o_orderkey, row_number() over (partition by o_custkey, o_orderpriority order by o_orderdate, o_orderkey) as g, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as a, 1 + o_orderkey % 3 as number from orders)
select o_custkey, sum((a = number)::int)::bigint as fits_all, sum((g = number)::int)::bigint as fits_group, count(*) as units, case when sum((a = number)::int) >= sum((g = number)::int) then 'all' else 'group' end as scheme from p group by 1""")
def q_code_scheme(spark, sf):
    rows = S.table(spark, sf, "orders").withColumn("number", 1 + F.col("o_orderkey") % 3)
    return schema.code_scheme(rows, "o_custkey", "o_orderkey", "o_orderpriority", "o_orderdate", "number")


@query(
    rf"""with l as (select p_partkey, case p_partkey % 4 when 0 then upper(p_name) when 1 then replace(p_name, ' ', ' ve ') when 2 then p_name || 'x' else p_name end as label from part), v as (select distinct p_name as word from part where p_partkey % 2 = 0),
w as (select word, {S.sql_norm('word')} as k, {S.sql_norm("array_to_string(list_filter(regexp_extract_all(lower(word), '[a-z0-9]+'), lambda x: x not in ('and', 've', 'ile')), '')")} as l from v), e as (select k, min(word) as e from w group by k), c as (select l, min(word) as w from w group by l having count(distinct word) = 1),
q as (select p_partkey, label, {S.sql_norm('label')} as k, {S.sql_norm("array_to_string(list_filter(regexp_extract_all(lower(label), '[a-z0-9]+'), lambda x: x not in ('and', 've', 'ile')), '')")} as l from l)
select p_partkey, label, coalesce(e.e, c.w) as resolved, case when e.e is not null then 'exact' when c.w is not null then 'connector' else 'unknown' end as kind from q left join e using (k) left join c using (l)"""
)
def q_resolve_labels(spark, sf):
    part = S.table(spark, sf, "part")
    label = F.when(F.col("p_partkey") % 4 == 0, F.upper("p_name")).when(F.col("p_partkey") % 4 == 1, F.replace(F.col("p_name"), F.lit(" "), F.lit(" ve "))).when(F.col("p_partkey") % 4 == 2, F.concat("p_name", F.lit("x"))).otherwise(F.col("p_name"))
    return schema.resolve_labels(part.select("p_partkey", label.alias("label")), part.filter("p_partkey % 2 = 0").select(F.col("p_name").alias("word")).distinct(), "label", "word")


_UNKNOWN = "b as (select user_id % 7 as doc, user_id as unit, event_id, case when event_id % 50 = 0 then event_type || ' and' when event_id % 61 = 0 then upper(event_type) || '-' when event_id % 53 = 0 then event_type || 's label text' else event_type || ' label text' end as label from events where user_id % 3 <> 0 or event_type <> 'click')"


@query(
    f"""with {_UNKNOWN}, k as (select *, {S.sql_norm("array_to_string(list_filter(regexp_extract_all(lower(label), '[a-z0-9]+'), lambda x: x not in ('and', 've', 'ile')), '')")} as key, {S.sql_norm('label')} as norm from b),
f as (select doc, key, min(event_id) as seen from k group by 1, 2), n as (select a.doc, a.key, o.key as other, o.seen from f a join f o on o.doc = a.doc and o.seen < a.seen and length(a.key) >= 12 and length(o.key) >= 12 and levenshtein(a.key, o.key) <= 2),
h as (select n.* from n where not exists (select 1 from n m where m.doc = n.doc and m.key = n.other)), g as (select f.doc, f.key, coalesce(c.other, f.key) as grp from f left join (select doc, key, arg_min(other, seen) as other from h group by 1, 2) c using (doc, key)),
x as (select k.*, grp from k join g using (doc, key)), u as (select doc, count(distinct unit) as total from b group by 1), c as (select doc, grp, count(distinct unit) as units, total from x join u using (doc) group by doc, grp, total having count(distinct unit) >= greatest(2, ceil(total * 50 / 100))),
m as (select doc, grp, norm as main from (select doc, grp, norm, row_number() over (partition by doc, grp order by count(*) desc, min(event_id)) as r from x group by 1, 2, 3) where r = 1)
select doc, 'LABEL_NOT_IN_STRUCTURE' as code, null::bigint as unit, trim(arg_min(label, event_id)) as label, units, case when units = total then 'INFO' else 'NEEDS_REVIEW' end as severity from x join c using (doc, grp) join m using (doc, grp) where norm = main group by doc, grp, units, total
union all select doc, 'LABEL_TEXT_VARIANT', unit, label, 1, 'NEEDS_REVIEW' from x join c using (doc, grp) join m using (doc, grp) where norm <> main"""
)
def q_recurring_unknown(spark, sf):
    kind = F.when(F.col("event_id") % 50 == 0, F.concat("event_type", F.lit(" and"))).when(F.col("event_id") % 61 == 0, F.concat(F.upper("event_type"), F.lit("-"))).when(F.col("event_id") % 53 == 0, F.concat("event_type", F.lit("s label text"))).otherwise(F.concat("event_type", F.lit(" label text")))
    rows = S.table(spark, sf, "events").filter("user_id % 3 <> 0 or event_type <> 'click'").select((F.col("user_id") % 7).alias("doc"), F.col("user_id").alias("unit"), "event_id", kind.alias("label"))
    return schema.recurring_unknown(rows, "doc", "unit", "event_id", "label", share=0.5)


@query(f"with {S.SQL_LINES}, o as (select *, sum((pos % 5 = 0)::int) over (partition by doc_id order by pos) as outer_pos from lines), i as (select *, sum((length(line) % 3 = 0 and pos % 5 <> 0)::int) over (partition by doc_id, outer_pos order by pos) as inner_pos from o) select doc_id, outer_pos::bigint as outer_pos, inner_pos::bigint as inner_pos, string_agg(line, chr(10) order by pos) as text from i group by 1, 2, 3")
def q_nested_items(spark, sf):
    rows = segment.nested_items(S.doc_lines(spark, sf), ["doc_id"], ["pos"], F.col("pos") % 5 == 0, F.char_length("line") % 3 == 0)
    return segment.item_texts(rows, ["doc_id", "outer_pos", "inner_pos"], "pos", "line")


@query(f"with {S.SQL_LINES}, r as (select doc_id, pos // 3 as section, pos, length(line) % 4 = 0 as m from lines), h as (select doc_id, section, min(pos) as pos, arg_min(m, pos) as m, max(m::int) as any_m from r group by 1, 2), f as (select *, min(case when m then pos end) over (partition by doc_id) as f from h) select doc_id, section::bigint as section, case when pos = f then 'learning_outcomes' when pos > f and any_m = 1 then 'applications' else 'other' end as kind from f")
def q_classify_sections(spark, sf):
    rows = S.doc_lines(spark, sf).withColumn("section", F.expr("pos div 3"))
    return segment.first_section(rows, "doc_id", "section", "pos", F.char_length("line") % 4 == 0)


@query(f"""with recursive {S.SQL_SPANS}, e as (select page, pos, color, text, row_number() over (partition by page order by pos) as k from spans), r as (select page, k, color as a, 0 as run from e where k = 1
union all select e.page, e.k, case when abs(e.color - r.a) > 10 then e.color else r.a end, case when abs(e.color - r.a) > 10 then run + 1 else run end from r join e on e.page = r.page and e.k = r.k + 1)
select page, run, string_agg(text, ' ' order by k) as text from r join e using (page, k) group by page, run""")
def q_title_runs(spark, sf):
    """Runs of a page's spans whose colour stays near the run's first."""
    return segment.title_runs(S.spans(spark, sf).select("page", "pos", "color", "text"), ["page"], "pos", "color", "text")


@query(
    rf"""with {S.SQL_SPANS}, m as (select *, regexp_replace(trim(text), '[0-9]+', '#', 'g') as shape, y1 <= height * 0.075 or y0 >= height * 0.925 as edge from spans where trim(text) <> ''),
z as (select source, count(distinct page) as pages from spans group by 1), s as (select source, 'edge' as kind, shape, count(distinct page) as n from m where edge group by all union all select source, 'tilted', shape, count(distinct page) from m where rotated group by all),
k as (select s.* from s join z using (source) where n >= 3 and n >= 0.3 * pages)
select source, page, pos::int as pos, max(why) as why from (select m.source, m.page, m.pos, k.kind as why from m join k on k.source = m.source and k.shape = m.shape and ((k.kind = 'edge' and m.edge) or (k.kind = 'tilted' and m.rotated))
union all select source, page, pos, 'number' from m where edge and try_cast(trim(text) as bigint) = page and not exists (select 1 from k where k.source = m.source and k.shape = m.shape and k.kind = 'edge')) group by all"""
)
def q_furniture(spark, sf):
    found = layout.furniture(S.spans(spark, sf), "source", "page", "text", "y0", "y1", "height", "rotated")
    return found.select("source", "page", "pos", "why")


_EXPECTED = "u as (select o_orderkey as unit, o_custkey as context, o_orderpriority as name, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as place from orders), r as (select unit + 1000000 as exp_row, context, case when unit % 5 = 0 then 'other' else name end as name, case when unit % 7 = 0 then place + 100 else place end as place from u where unit % 11 <> 0)"
_UNIQUE = "(select unit, exp_row from (select *, count(*) over (partition by unit) as a, count(*) over (partition by exp_row) as b from (select distinct unit, exp_row from {u} join {r} using ({k}))) where a = 1 and b = 1)"


def _expected(spark, sf):
    from pyspark.sql import Window

    units = S.table(spark, sf, "orders").select(F.col("o_orderkey").alias("unit"), F.col("o_custkey").alias("context"), F.col("o_orderpriority").alias("name"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).alias("place"))
    rows = units.filter("unit % 11 <> 0").select((F.col("unit") + 1000000).alias("exp_row"), "context", F.when(F.col("unit") % 5 == 0, "other").otherwise(F.col("name")).alias("name"), F.when(F.col("unit") % 7 == 0, F.col("place") + 100).otherwise(F.col("place")).alias("place"))
    return units, rows


_MATCHED = f"{_EXPECTED}, n as {_UNIQUE.format(u='u', r='r', k='context, name')}, u2 as (select * from u anti join n using (unit)), r2 as (select * from r anti join n using (exp_row)), p as {_UNIQUE.format(u='u2', r='r2', k='context, place')}, m as (select unit, coalesce(n.exp_row, p.exp_row) as exp_row, case when n.exp_row is not null then 'name' when p.exp_row is not null then 'place' else 'none' end as how from u left join n using (unit) left join p using (unit))"


@query(f"with {_MATCHED} select * from m")
def q_match_expected(spark, sf):
    units, rows = _expected(spark, sf)
    return expected.match_expected(units, rows, "context", "name", "place", "unit", "exp_row")


@query(f"with {_EXPECTED}, a as (select context, name, count(distinct unit) as units from u group by 1, 2), b as (select context, name, count(distinct exp_row) as n from r group by 1, 2) select unit, units, n as \"rows\", 'EXPECTED_ROW_AMBIGUOUS' as code, 'INFO' as severity from u join a using (context, name) join b using (context, name) where units > 1 or n > 1")
def q_ambiguous_rows(spark, sf):
    units, rows = _expected(spark, sf)
    return expected.ambiguous_rows(units, rows, ["context", "name"], "unit", "exp_row")


@query(f"with {_MATCHED}, s as (select exp_row from m where exp_row is not null) select exp_row, context, name, place from r anti join s using (exp_row) where context in (select context from r join s using (exp_row))")
def q_missing_expected(spark, sf):
    units, rows = _expected(spark, sf)
    return expected.missing_units(rows, expected.match_expected(units, rows, "context", "name", "place", "unit", "exp_row"), "context", "exp_row").select("exp_row", "context", "name", "place")


@query("select o_orderkey, page, min(x)::double as x0, min(y)::double as y0, max(x + 5)::double as x1, max(y + 2)::double as y1, count(*) as spans from (select distinct l_orderkey as o_orderkey, case when l_partkey % 5 = 0 then -l_partkey else l_partkey end as id from lineitem) join (select p_partkey as id, p_size % 4 as page, p_retailprice as x, p_partkey % 100 as y from part) using (id) group by 1, 2")
def q_span_boxes(spark, sf):
    """Every fifth part's id is one that no span has."""
    named = F.when(F.col("l_partkey") % 5 == 0, -F.col("l_partkey")).otherwise(F.col("l_partkey"))
    fields = S.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set(named).alias("ids"))
    spans = S.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") % 4).alias("page"), F.col("p_retailprice").alias("x0"), (F.col("p_partkey") % 100).cast("double").alias("y0"), (F.col("p_retailprice") + 5).alias("x1"), (F.col("p_partkey") % 100 + 2).cast("double").alias("y1"))
    return locate.span_boxes(fields, spans, "o_orderkey", "ids", "id", "page")


@query(f"with {S.SQL_LINES} select source, line, min(doc_id) as doc_id from lines group by 1, 2 having count(*) = 1")
def q_only_place(spark, sf):
    return locate.only_place(S.doc_lines(spark, sf), ["source"], "line", "doc_id")


@query("with a as (select o_orderkey, min(l_partkey) as p from orders join lineitem on l_orderkey = o_orderkey and l_quantity > 40 group by 1), b as (select o_orderkey, min(l_suppkey) as p from orders join lineitem on l_orderkey = o_orderkey and l_discount > 0.05 group by 1), c as (select o_orderkey, o_custkey as p from orders where o_orderkey % 2 = 0) select o_orderkey, coalesce(a.p, b.p, c.p) as place, case when a.p is not null then 'part' when b.p is not null then 'supplier' when c.p is not null then 'customer' else 'none' end as source from orders left join a using (o_orderkey) left join b using (o_orderkey) left join c using (o_orderkey)")
def q_first_place(spark, sf):
    orders, items = S.table(spark, sf, "orders"), S.table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    chain = [("part", items.filter("l_quantity > 40").withColumn("place", F.col("l_partkey"))), ("supplier", items.filter("l_discount > 0.05").withColumn("place", F.col("l_suppkey"))), ("customer", orders.filter("o_orderkey % 2 = 0").withColumn("place", F.col("o_custkey")))]
    return locate.first_place(orders.select("o_orderkey"), chain, "o_orderkey", "place")


@query("select s_suppkey, n_name, r_name, case when row_number() over (partition by r_name order by n_name, s_suppkey) = 1 then r_name end as shown_r_name, case when row_number() over (partition by r_name, n_name order by n_name, s_suppkey) = 1 then n_name end as shown_n_name from supplier join nation on n_nationkey = s_nationkey join region on r_regionkey = n_regionkey")
def q_blank_repeats(spark, sf):
    nation = S.table(spark, sf, "nation").join(F.broadcast(S.table(spark, sf, "region")), F.col("r_regionkey") == F.col("n_regionkey"))
    rows = S.table(spark, sf, "supplier").join(F.broadcast(nation), F.col("n_nationkey") == F.col("s_nationkey")).select("s_suppkey", "n_name", "r_name")
    return report.blank_repeats(rows, ["r_name", "n_name"], ["n_name", "s_suppkey"])


@query(f"with {_NAMED}, i as (select *, case code when 'LO_COUNT_MISMATCH' then 'counts' when 'EXPECTED_COUNT_MISSING' then 'counts' when 'DUPLICATE_SECTION' then 'sections' else code end as issue from g) select issue, count(distinct l_orderkey) as files, count(*) as total from i group by issue")
def q_issue_groups(spark, sf):
    names = spark.createDataFrame([("LO_COUNT_MISMATCH", "counts"), ("EXPECTED_COUNT_MISSING", "counts"), ("DUPLICATE_SECTION", "sections")], "code string, issue string")
    return report.issue_groups(findings(spark, sf), F.broadcast(names), "l_orderkey", "code")


@query("select user_id, min(value) filter (where event_type = 'click') as click, min(value) filter (where event_type = 'purchase') as purchase, min(value) filter (where event_type = 'view') as view from events where event_type in ('click', 'purchase', 'view') group by user_id")
def q_wide_grid(spark, sf):
    rows = S.table(spark, sf, "events").filter(F.col("event_type").isin("click", "purchase", "view"))
    return report.wide_grid(rows, ["user_id"], "event_type", ["click", "purchase", "view"], F.col("value"))


@query("""select o_orderkey, '{"o_orderkey":' || o_orderkey || ',"items":[' || coalesce(string_agg('{"l_partkey":' || l_partkey || ',"l_returnflag":"' || l_returnflag || '"}', ',' order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice), '') || ']}' as json from orders left join lineitem on l_orderkey = o_orderkey group by o_orderkey""")
def q_nested_json(spark, sf):
    items = S.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.struct(*S.ITEM_ORDER).alias("place"), "l_partkey", "l_returnflag")
    return report.nested_json(S.table(spark, sf, "orders").select("o_orderkey"), items, "o_orderkey", ["place"], ["l_partkey", "l_returnflag"])


@query("select event_type, date_trunc('day', ts) as start, count(*) as n from events group by 1, 2")
def q_drift_counts(spark, sf):
    return ingest.drift_counts(S.table(spark, sf, "events"), "ts", "event_type").select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("select count(*) as n, sum(event_id)::bigint as ids, min(event_id) as first, max(event_id) as last from events")
def q_incremental_ingest(spark, sf):
    """Takes the events file by file through a stream into a table, twice: the second run finds nothing new."""
    import uuid

    ship(spark)
    base = f"{shared_folder(spark)}/ingest-{uuid.uuid4().hex}"
    schema_of = S.table(spark, sf, "events").schema

    def sink(batch, number):
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    for _ in range(2):
        ingest.ingest_stream(spark, sf, schema_of, f"{base}/state", sink, pattern="events.parquet")
    done = spark.read.schema(schema_of).parquet(f"{base}/out")
    return done.agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"), F.min("event_id").alias("first"), F.max("event_id").alias("last"))
