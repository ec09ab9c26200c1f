"""One query per operator over the stand-in relations, each beside its SQL."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docrecon.functions import codes as C
from docrecon.functions import folds, keys, status
from docrecon.operators import checks, diff, layout, matching, sequences, votes
from docrecon.plans import stand_ins as S
from docrecon.shipping import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# ---- keys, codes and statuses


@query(f"with {S.SQL_LINES} select doc_id, pos, {S.sql_norm('line')} as norm, {S.sql_tr_lower('line')} as low from lines")
def q_norm_key(spark, sf):
    return S.doc_lines(spark, sf).select("doc_id", "pos", keys.norm_label(F.col("line")).alias("norm"), keys.tr_lower(F.col("line")).alias("low"))


@query(f"with {S.SQL_EDITED} select doc_id, pos, {S.sql_compare_key('line')} as key from edited")
def q_compare_key(spark, sf):
    return S.edited_lines(spark, sf).select("doc_id", "pos", keys.compare_key(F.col("line")).alias("key"))


@query("select doc_id, length(text) - length(replace(text, '.', '')) as removed, text as cleaned from documents")
def q_control_chars(spark, sf):
    dirty = S.table(spark, sf, "documents").withColumn("dirty", F.replace(F.col("text"), F.lit("."), F.lit(".\x07")))
    clean = keys.visible(F.col("dirty"))
    return dirty.select("doc_id", (F.char_length("dirty") - F.char_length(clean)).cast("long").alias("removed"), clean.alias("cleaned"))


@query(rf"with {S.SQL_LINES} select doc_id, pos, trim(regexp_replace(line || ' (' || pos || ')', '\([^)]*\)', '', 'g')) as bare, translate({S.sql_tr_lower('line')}, 'ğşçöüı', 'gscoui') as ascii, case when length(line) > 60 then substring(line, 1, 59) || '…' else line end as short from lines")
def q_text_views(spark, sf):
    line = F.concat("line", F.lit(" ("), F.col("pos").cast("string"), F.lit(")"))
    return S.doc_lines(spark, sf).select("doc_id", "pos", keys.strip_parens(line).alias("bare"), keys.ascii_norm(F.col("line")).alias("ascii"), keys.short(F.col("line")).alias("short"))


@query(
    rf"""with {S.SQL_CODES} select p_partkey, regexp_extract(raw, '^\s*(\p{{L}}+)', 1) as prefix,
    list_aggregate(list_transform(s, lambda x: case when regexp_full_match(x, '[0-9]+') then (x::bigint)::varchar else x end), 'string_agg', '.') as segments,
    list_aggregate(list_transform(s, lambda x: case when regexp_full_match(x, '[0-9]+') then 'n' else 'a' end), 'string_agg', '') as types,
    regexp_replace(regexp_replace(raw, '\p{{Lu}}+', 'A', 'g'), '[0-9]+', 'N', 'g') as shape
    from (select *, regexp_extract_all(regexp_replace(raw, '^\s*\p{{L}}+', ''), '\p{{L}}+[0-9]*|[0-9]+') as s from codes)"""
)
def q_code_parse(spark, sf):
    segments = C.code_segments(F.col("raw"))
    return S.part_codes(spark, sf).select("p_partkey", C.code_prefix(F.col("raw")).alias("prefix"), F.array_join(segments, ".").alias("segments"), F.array_join(C.segment_types(segments), "").alias("types"), C.code_shape(F.col("raw")).alias("shape"))


# Codes in parentheses and outside, one of them in both places; broken by a line's end; with a comma; of an outcome.
_CODE_TEXT = "concat('see (', upper(substring(p_type, 1, 2)), p_size, '.', p_partkey % 7, ') and (x', p_size, ', D', p_size, ') or E', p_partkey % 5, '.1, Q', p_size, ', D', p_size, ' (KB2.\\n', p_size, ', MAT', p_size, '.1) KB', p_size, ',4 cm_E9_', if(p_partkey % 2 = 0, ' E-\\n8.2', ''), '.')"


@query("""select p_partkey, concat_ws(',', upper(substring(p_type, 1, 2)) || p_size || '.' || (p_partkey % 7), 'D' || p_size, 'E' || (p_partkey % 5) || '.1', 'KB2.' || p_size, case when p_partkey % 2 = 0 then 'E8.2' end) as codes from part""")
def q_extract_codes(spark, sf):
    rows = S.table(spark, sf, "part").select("p_partkey", F.expr(_CODE_TEXT).alias("t"))
    return rows.select("p_partkey", F.array_join(C.used_codes(F.col("t"), ["E"], "MAT"), ",").alias("codes"))


@query("select p_partkey, 'KB' || p_size || ',4;SDB' as codes from part")
def q_malformed_codes(spark, sf):
    rows = S.table(spark, sf, "part").select("p_partkey", F.expr("concat('text KB9,9 (KB', p_size, ',4, SDB, OB', p_size, ') and (D7, x)')").alias("t"))
    return rows.select("p_partkey", F.array_join(C.malformed_codes(F.col("t"), ["KB", "SDB", "OB", "D"]), ";").alias("codes"))


@query("""with p as (select p_partkey, p_name, p_size, length(p_name) as n from part) select p_partkey, '(KB2.' || p_size || ', ' || p_name || 'x) 3.' || chr(10) || '4' as view, n + length(p_size::varchar) + 14 as size,
    n + length(p_size::varchar) + 13 + 4 as last from p""")
def q_dehyphen(spark, sf):
    raw = F.expr("concat('(KB2.\\n', p_size, ', ', p_name, '-\\n x) 3.\\n4')")
    return S.table(spark, sf, "part").withColumn("t", raw).select("p_partkey", keys.dehyphen(F.col("t")).alias("view"), F.size(keys.dehyphen_places(F.col("t"))).cast("long").alias("size"), F.array_max(keys.dehyphen_places(F.col("t"))).cast("long").alias("last"))


_COVERS = "d.l_suppkey = u.l_suppkey and d.prefix = u.prefix and u.segments[1:len(d.segments)] = d.segments"


@query(f"with {S.SQL_SUPPLIER} select l_suppkey, prefix, array_to_string(segments, '.') as code from used u where not exists (select 1 from declared d where {_COVERS})")
def q_used_not_declared(spark, sf):
    used, declared = S.supplier_codes(spark, sf)
    return C.uncovered(used, declared, ["l_suppkey"]).select("l_suppkey", "prefix", F.array_join("segments", ".").alias("code"))


@query(f"with {S.SQL_SUPPLIER}, few as (select * from used where segments[2]::int % 2 = 0) select l_suppkey, prefix, array_to_string(segments, '.') as code from declared d where not exists (select 1 from few u where {_COVERS})")
def q_declared_not_used(spark, sf):
    used, declared = S.supplier_codes(spark, sf)
    return C.uncovering(declared, used.filter(F.col("segments")[1].cast("int") % 2 == 0), ["l_suppkey"]).select("l_suppkey", "prefix", F.array_join("segments", ".").alias("code"))


@query(f"with {S.SQL_SUPPLIER}, m as (select prefix, min(len(segments)) as n from used group by prefix) select l_suppkey, d.prefix, array_to_string(segments, '.') as code, n::int as least from declared d join m using (prefix) where len(segments) < n")
def q_incomplete_code(spark, sf):
    used, declared = S.supplier_codes(spark, sf)
    least = used.groupBy("prefix").agg(F.min(F.size("segments")).alias("least"))
    return declared.join(least, "prefix").filter(F.size("segments") < F.col("least")).select("l_suppkey", "prefix", F.array_join("segments", ".").alias("code"), "least")


@query("with c as (select distinct p_partkey, 'K' || (p_partkey % 3) as x, p_type, upper(substring(p_type, 1, 3)) as prefix, regexp_extract(p_brand, '[0-9]+')::bigint as b, p_size::bigint as z, case p_partkey % 3 when 0 then '' when 1 then 'SÖS' else 'L' || p_size end as skill from part), d as (select min(p_partkey) as p_partkey, prefix, b, z, skill from c group by prefix, b, z, skill) select p_partkey, dense_rank() over (order by prefix, b, z, skill <> '', skill)::int as place from d")
def q_code_sort(spark, sf):
    skill = F.when(F.col("p_partkey") % 3 == 1, ".SÖS").when(F.col("p_partkey") % 3 == 2, F.concat(F.lit(".L"), F.col("p_size").cast("string"))).otherwise("")
    raw = S.part_codes(spark, sf).join(S.table(spark, sf, "part").select("p_partkey", skill.alias("skill")), "p_partkey").select("p_partkey", F.concat(F.rtrim("raw", F.lit(".")), "skill").alias("raw"))
    rows = raw.groupBy("raw").agg(F.min("p_partkey").alias("p_partkey")).withColumns({"prefix": C.code_prefix(F.col("raw")), "segments": C.code_segments(F.col("raw"))})
    return C.code_places(rows, "prefix", "segments").select("p_partkey", "place")


@query(f"with {S.SQL_EDITED} select doc_id, pos, {S.sql_text_status('l.line', 'e.line')} as status from lines l join edited e using (doc_id, pos)")
def q_text_status(spark, sf):
    a, b = S.doc_lines(spark, sf).select("doc_id", "pos", F.col("line").alias("a")), S.edited_lines(spark, sf).select("doc_id", "pos", F.col("line").alias("b"))
    return a.join(b, ["doc_id", "pos"]).select("doc_id", "pos", status.text_status(F.col("a"), F.col("b")).alias("status"))


_CELL = f"case when a = '' and b = '' then 'BOŞ' when a = '' then 'YALNIZCA_SİSTEM' when b = '' then 'YALNIZCA_PDF' when a = b then 'AYNI' when {S.sql_form_key('a')} = {S.sql_form_key('b')} then 'BİÇİM' else 'FARKLI' end"


@query(
    f"with {S.SQL_EDITED}, c as (select doc_id, pos, {S.sql_squeeze('l.line')} as a, {S.sql_squeeze('''coalesce(e.line, '')''')} as b from (select doc_id, pos, case when pos % 11 = 5 then '' else line end as line from lines) l left join edited e using (doc_id, pos)), "
    f"s as (select doc_id, {_CELL} as status from c) select status, count(*) as n from s group by status"
)
def q_cell_status(spark, sf):
    a = S.doc_lines(spark, sf).select("doc_id", "pos", F.when(F.col("pos") % 11 == 5, "").otherwise(F.col("line")).alias("a"))
    b = S.edited_lines(spark, sf).select("doc_id", "pos", F.col("line").alias("b"))
    return a.join(b, ["doc_id", "pos"], "left").select(status.cell_status(F.col("a"), F.col("b")).alias("status")).groupBy("status").agg(F.count("*").alias("n"))


@query(
    f"with {S.SQL_EDITED}, s as (select {S.sql_text_status('l.line', 'e.line')} as status from lines l join edited e using (doc_id, pos)), c as (select status, count(*) as n from s group by status) "
    f"select (k - 1)::int as place, t.status, coalesce(c.n, 0)::bigint as n from (select unnest({list(status.ITEM_STATUSES)}) as status, generate_subscripts({list(status.ITEM_STATUSES)}, 1) as k) t left join c using (status)"
)
def q_status_summary_zero_fill(spark, sf):
    return diff.status_counts(q_text_status(spark, sf), "status", status.ITEM_STATUSES)


# ---- votes, medians, windows


@query("select source, lang, w::bigint as weight from (select *, row_number() over (partition by source order by w desc, first) as r from (select source, lang, sum(length(trim(text)) // 500) as w, min(doc_id) as first from documents group by all)) where r = 1")
def q_weighted_mode(spark, sf):
    return votes.weighted_mode(S.table(spark, sf, "documents"), ["source"], "lang", F.floor(F.char_length(F.trim("text")) / 500), ["doc_id"])


@query("with f as (select user_id, event_type, count(*) as n, min(epoch_us(ts)::hugeint * 1000000000 + event_id) as k from events group by all) select user_id, event_type, n from (select *, row_number() over (partition by user_id order by n desc, k) as r from f) where r = 1")
def q_majority_first_seen(spark, sf):
    return votes.first_seen_mode(S.table(spark, sf, "events"), ["user_id"], "event_type", ["ts", "event_id"])


@query("select user_id, list_sort(list(value))[count(value) // 2 + 1] as median, count(value) as n from events where value is not null group by user_id")
def q_upper_median(spark, sf):
    return votes.upper_median(S.table(spark, sf, "events"), ["user_id"], "value")


@query("""with q as (select l_orderkey, string_agg(l_returnflag || l_linestatus, '>' order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) as sequence from lineitem group by l_orderkey),
m as (select sequence as modal from q group by sequence order by count(*) desc, min(l_orderkey) limit 1) select l_orderkey, sequence, sequence = modal as is_modal from q, m""")
def q_skill_order(spark, sf):
    return votes.modal_sequence(S.table(spark, sf, "lineitem").withColumn("skill", F.concat("l_returnflag", "l_linestatus")), "l_orderkey", "skill", S.ITEM_ORDER)


@query("select c_custkey, case when count(*) over (partition by s) = 1 then s else c_name || ' / ' || c_custkey end as label from (select *, substring(c_name, 1, 9) || right(c_name, 2) as s from customer)")
def q_unique_label(spark, sf):
    rows = S.table(spark, sf, "customer")
    return votes.unique_labels(rows, F.concat(F.substring("c_name", 1, 9), F.expr("right(c_name, 2)")), F.concat_ws(" / ", "c_name", F.col("c_custkey").cast("string"))).select("c_custkey", "label")


@query("select conv_id, turn, block, first_value(case when role = 'user' then text end ignore nulls) over (partition by conv_id, block order by turn) as parent from (select *, count(*) filter (where role = 'user') over (partition by conv_id order by turn) as block from conversations)")
def q_forward_fill_parent(spark, sf):
    rows = sequences.blocks(S.table(spark, sf, "conversations"), ["conv_id"], ["turn"], F.col("role") == "user")
    return sequences.forward_fill(rows, ["conv_id"], ["turn"], F.when(F.col("role") == "user", F.col("text")), "parent").select("conv_id", "turn", "block", "parent")


@query(f"with {S.SQL_LINES}, b as (select *, sum(case when pos % 4 = 0 or length(line) < 20 then 1 else 0 end) over (partition by doc_id order by pos) as block from lines) select doc_id, block::bigint as block, count(*) as n, min(pos)::int as first, max(pos)::int as last, sum(length(line))::bigint as chars from b group by doc_id, block")
def q_section_sessions(spark, sf):
    rows = sequences.blocks(S.doc_lines(spark, sf), ["doc_id"], ["pos"], (F.col("pos") % 4 == 0) | (F.char_length("line") < 20))
    return sequences.block_summary(rows, ["doc_id"], "block", "pos", "line")


@query("""with t as (select o_custkey as title, o_orderkey as tab, floor(o_totalprice / 50000)::bigint as hours from orders), w as (select *, max(hours) over (partition by title) as top from t)
select tab as o_orderkey, title as o_custkey, hours, case when hours < top and sum((hours = top)::int) over (partition by title) = 1 then 'ALTERNATIVE' else 'SUMMARY' end as role from w""")
def q_expected_alternative(spark, sf):
    rows = S.table(spark, sf, "orders").withColumn("hours", F.floor(F.col("o_totalprice") / 50000))
    return sequences.expected_alternatives(rows, "o_custkey", "o_orderkey", "hours")


# ---- checks


_ITEMS = "i as (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) as r from lineitem)"


@query("select o_orderkey as l_orderkey, m as expected, coalesce(n, 0) as found, case when m is null then 'NEEDS_REVIEW' when m = n then 'PASS' else 'FAIL' end as status from orders left join (select l_orderkey, max(l_linenumber)::bigint as m, count(*) as n from lineitem group by 1) on o_orderkey = l_orderkey")
def q_count_mismatch(spark, sf):
    units = S.table(spark, sf, "orders").withColumnRenamed("o_orderkey", "l_orderkey")
    return checks.count_check(units, S.table(spark, sf, "lineitem"), "l_orderkey", F.max("l_linenumber"))


@query("select l_orderkey, parts, total from (select l_orderkey, sum(l_linenumber)::bigint as parts from lineitem group by 1) join (select l_orderkey, sum(l_linenumber)::bigint + case when l_orderkey % 10 = 0 then 1 else 0 end as total from lineitem group by 1) using (l_orderkey) where parts <> total")
def q_total_inconsistent(spark, sf):
    rows = S.table(spark, sf, "lineitem")
    totals = rows.groupBy("l_orderkey").agg(F.sum("l_linenumber").alias("t")).select("l_orderkey", (F.col("t") + F.when(F.col("l_orderkey") % 10 == 0, 1).otherwise(0)).alias("total"))
    return checks.total_check(rows, totals, "l_orderkey", "l_linenumber", "total")


@query("select o_orderkey, o_custkey from orders where o_orderkey not in (select l_orderkey from lineitem)")
def q_missing_unit(spark, sf):
    return S.table(spark, sf, "orders").join(S.table(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey", "o_custkey")


_FINDINGS = "f as (select l_orderkey, 4 as s from (select l_orderkey, max(l_linenumber) as m, count(*) as n from lineitem group by 1) where m <> n union all select l_orderkey, 3 from (select l_orderkey, l_partkey from lineitem group by 1, 2 having count(*) > 1) union all select l_orderkey, 2 from lineitem where l_quantity > 45 union all select o_orderkey, 1 from orders where o_orderkey not in (select l_orderkey from lineitem))"


def findings(spark, sf) -> DataFrame:
    """Findings of several checks over the orders: l_orderkey, code, severity."""
    rows = S.table(spark, sf, "lineitem")
    units = S.table(spark, sf, "orders").withColumnRenamed("o_orderkey", "l_orderkey")
    return checks.all_findings(
        checks.finding(checks.count_check(units, rows, "l_orderkey", F.max("l_linenumber")).filter("status = 'FAIL'"), ["l_orderkey"], "LO_COUNT_MISMATCH", "FAIL"),
        checks.finding(checks.duplicates(rows, ["l_orderkey", "l_partkey"]), ["l_orderkey"], "DUPLICATE_SECTION", "NEEDS_REVIEW"),
        checks.finding(rows.filter("l_quantity > 45"), ["l_orderkey"], "CODE_FORMAT_ANOMALY", "WARNING"),
        checks.finding(units.join(rows, "l_orderkey", "left_anti"), ["l_orderkey"], "EXPECTED_COUNT_MISSING", "INFO"),
    )


@query(f"with {_FINDINGS}, m as (select l_orderkey, max(s) as s from f group by 1) select o_orderkey as l_orderkey, case coalesce(m.s, 1) when 4 then 'FAIL' when 3 then 'NEEDS_REVIEW' when 2 then 'WARNING' else 'PASS' end as status from orders left join m on o_orderkey = l_orderkey")
def q_unit_status(spark, sf):
    return checks.worst_status(S.table(spark, sf, "orders").withColumnRenamed("o_orderkey", "l_orderkey"), findings(spark, sf), "l_orderkey")


_NAMED = _FINDINGS + ", g as (select l_orderkey, ['EXPECTED_COUNT_MISSING', 'CODE_FORMAT_ANOMALY', 'DUPLICATE_SECTION', 'LO_COUNT_MISMATCH'][s] as code from f)"


@query(f"with {_NAMED} select code, count(distinct l_orderkey) as files, count(*) as total, min(l_orderkey) as first from g group by code")
def q_finding_types(spark, sf):
    return findings(spark, sf).groupBy("code").agg(F.countDistinct("l_orderkey").alias("files"), F.count("*").alias("total"), F.min("l_orderkey").alias("first"))


@query(f"with {_NAMED}, c as (select o_custkey, code, count(*) as n from g join orders on o_orderkey = l_orderkey group by 1, 2) select o_custkey, string_agg(code || ':' || n, ', ' order by r) as top from (select *, row_number() over (partition by o_custkey order by n desc, code) as r from c) where r <= 2 group by o_custkey")
def q_topk_checks(spark, sf):
    owners = S.table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    counts = findings(spark, sf).join(owners, "l_orderkey").groupBy("o_custkey", "code").agg(F.count("*").alias("n"))
    top = sequences.top_per_key(counts, "o_custkey", [F.desc("n"), F.col("code")], 2)
    text = F.transform(F.array_sort(F.collect_list(F.struct("rank", "code", "n"))), lambda x: F.concat_ws(":", x["code"], x["n"].cast("string")))
    return top.groupBy("o_custkey").agg(F.array_join(text, ", ").alias("top"))


@query(f"with {_ITEMS} select l_orderkey, l_linenumber, r::int as expected, l_partkey, l_suppkey from i where l_linenumber <> r")
def q_sequence_gap(spark, sf):
    return checks.sequence_gaps(S.table(spark, sf, "lineitem"), "l_orderkey", "l_linenumber", S.ITEM_ORDER).select("l_orderkey", "l_linenumber", "expected", "l_partkey", "l_suppkey")


@query(f"with {_ITEMS}, a as (select l_orderkey, r, substring('{checks.ALPHABET}', (case when l_partkey % 17 = 0 then r + 1 else r end)::int, 1) as letter from i) select l_orderkey, string_agg(letter, '' order by r) as letters, bool_and(letter = substring('{checks.ALPHABET}', r::int, 1)) as good from a group by l_orderkey")
def q_letter_sequence(spark, sf):
    w = Window.partitionBy("l_orderkey").orderBy(*S.ITEM_ORDER)
    rows = S.table(spark, sf, "lineitem").withColumn("r", F.row_number().over(w))
    at = F.col("r") + F.when(F.col("l_partkey") % 17 == 0, 1).otherwise(0)
    return checks.letter_sequence(rows.withColumn("letter", F.substring(F.lit(checks.ALPHABET), at, F.lit(1))), "l_orderkey", "letter", ["r"])


@query("select conv_id, count(*) as violations from (select conv_id, k, lag(k) over (partition by conv_id order by turn) as b from (select *, case when conv_id % 3 = 0 and turn in (1, 2) then 3 - turn else turn end as k from conversations)) where b > k group by conv_id")
def q_order_violation(spark, sf):
    rank = F.when((F.col("conv_id") % 3 == 0) & F.col("turn").isin(1, 2), 3 - F.col("turn")).otherwise(F.col("turn"))
    return checks.order_violations(S.table(spark, sf, "conversations").withColumn("k", rank), "conv_id", "k", ["turn"])


@query("select l_orderkey, l_partkey, count(*) as n from lineitem group by 1, 2 having count(*) > 1")
def q_duplicate_key(spark, sf):
    return checks.duplicates(S.table(spark, sf, "lineitem"), ["l_orderkey", "l_partkey"])


@query("with a as (select distinct l_orderkey, l_partkey from lineitem where l_partkey % 5 <> 0), b as (select distinct l_orderkey, l_partkey from lineitem where l_partkey % 7 <> 0) select *, 'APPLICATION_MISSING' as code, 'FAIL' as severity from (select * from a except select * from b) union all select *, 'APPLICATION_UNKNOWN_CODE', 'FAIL' from (select * from b except select * from a)")
def q_application_xref(spark, sf):
    rows = S.table(spark, sf, "lineitem")
    return checks.cross_reference(rows.filter("l_partkey % 5 <> 0"), rows.filter("l_partkey % 7 <> 0"), ["l_orderkey", "l_partkey"], "APPLICATION_MISSING", "APPLICATION_UNKNOWN_CODE")


@query("with r as (select distinct event_type, user_id as u from events where event_type <> 'view' or user_id % 5 <> 0), z as (select event_type, count(*) as size from r group by 1) select a.event_type, b.event_type as other, count(*) as shared, size, count(*) = size as subset from r a join r b on a.u = b.u and a.event_type <> b.event_type join z on z.event_type = a.event_type group by a.event_type, b.event_type, size")
def q_column_level(spark, sf):
    rows = S.table(spark, sf, "events").filter("event_type <> 'view' or user_id % 5 <> 0")
    return checks.subset_pairs(rows, "event_type", "user_id")


@query(f"with {S.SQL_LINES} select doc_id, pos::int as pos, case when pos % 3 <> 1 and pos % 5 = 0 then 'DOUBLE_ASSIGNED_SPANS' else 'UNASSIGNED_SPANS' end as code from lines where (pos % 3 <> 1) = (pos % 5 = 0)")
def q_coverage_partition(spark, sf):
    rows = S.doc_lines(spark, sf)
    return checks.coverage(rows, [rows.filter("pos % 3 <> 1"), rows.filter("pos % 5 = 0")], ["doc_id", "pos"])


@query(rf"with {S.SQL_EDITED} select doc_id, pos::int as pos from edited join documents using (doc_id) where not contains(regexp_replace(text, '[ \t-\r]+', '', 'g'), regexp_replace(line, '[ \t-\r]+', '', 'g'))")
def q_fidelity(spark, sf):
    return checks.not_in_source(S.edited_lines(spark, sf), S.table(spark, sf, "documents"), "doc_id", "line", "text", ["doc_id", "pos"]).select("doc_id", "pos")


# ---- reconciliation


@query("with c as (select p_brand, l_suppkey, count(*) as n, min(l_orderkey) as o from lineitem join part on p_partkey = l_partkey group by 1, 2) select p_brand, l_suppkey, n from (select *, row_number() over (partition by p_brand order by n desc, o, l_suppkey) as r from c) where r = 1")
def q_match_plurality(spark, sf):
    pairs = S.table(spark, sf, "lineitem").join(S.table(spark, sf, "part"), F.col("p_partkey") == F.col("l_partkey"))
    return diff.plurality(pairs, "p_brand", "l_suppkey", F.col("l_orderkey"))


_DIFF = f"""with {S.SQL_EDITED}, a as (select doc_id, substring(line, 1, 6) as code, count(*) as n, case when count(*) = 1 then min(line) end as document from lines group by 1, 2), b as (select doc_id, substring(line, 1, 6) as code, count(*) as n, case when count(*) = 1 then min(line) end as sheet from edited group by 1, 2)"""


@query(f"{_DIFF} select doc_id, code, document, sheet, case when a.n > 1 or b.n > 1 then 'İNCELEME_GEREKLİ' when b.n is null then 'PDF_DE_VAR_EXCELDE_YOK' when a.n is null then 'EXCELDE_VAR_PDF_DE_YOK' else {S.sql_text_status('document', 'sheet')} end as status from a full join b using (doc_id, code)")
def q_item_diff(spark, sf):
    code = F.substring("line", 1, 6)
    return diff.keyed_diff(S.doc_lines(spark, sf).withColumn("code", code), S.edited_lines(spark, sf).withColumn("code", code), ["doc_id", "code"], "line")


_REMATCH = f"with {S.SQL_LINES}, n as (select doc_id, pos, {S.sql_norm('line')} as name from lines), l as (select doc_id, pos as key, name from n), r as (select doc_id, case when pos % 4 = 1 then pos + 1000 else pos end as key, name from n)"


@query(f"{_REMATCH}, a as (select * from l anti join r using (doc_id, key)), b as (select * from r anti join l using (doc_id, key)), a1 as (select doc_id, name, key as left_key, row_number() over (partition by doc_id, name order by key) as n from a), b1 as (select doc_id, name, key as right_key, row_number() over (partition by doc_id, name order by key) as n from b) select doc_id, name, left_key::int as left_key, right_key::int as right_key, 'KOD_FARKLI' as status from a1 join b1 using (doc_id, name, n)")
def q_title_rematch(spark, sf):
    rows = S.doc_lines(spark, sf).select("doc_id", F.col("pos").alias("key"), keys.norm_label(F.col("line")).alias("name"))
    moved = rows.withColumn("key", F.when(F.col("key") % 4 == 1, F.col("key") + 1000).otherwise(F.col("key")))
    return diff.rematch(rows, moved, ["doc_id"], "key", "name")


@query(f"with {S.SQL_EDITED} select doc_id, pos::int as pos, l.line as document, e.line as sheet, case when e.line is null then 'PDF_DE_VAR_EXCELDE_YOK' else {S.sql_text_status('l.line', 'e.line')} end as status from lines l left join edited e using (doc_id, pos)")
def q_positional_diff(spark, sf):
    return diff.positional_diff(S.doc_lines(spark, sf), S.edited_lines(spark, sf), ["doc_id"], "pos", "line")


@query(f"with {S.SQL_EDITED}, a as (select distinct doc_id, {S.sql_norm('line')} as name from lines), b as (select distinct doc_id, {S.sql_norm('line')} as name from edited) select coalesce(a.doc_id, b.doc_id) as doc_id, coalesce(a.name, b.name) as name, case when b.name is null then 'PDF_DE_VAR_EXCELDE_YOK' when a.name is null then 'EXCELDE_VAR_PDF_DE_YOK' else 'AYNI' end as status from a full join b on a.doc_id = b.doc_id and a.name = b.name")
def q_set_diff(spark, sf):
    name = keys.norm_label(F.col("line"))
    return diff.set_diff(S.doc_lines(spark, sf).withColumn("name", name), S.edited_lines(spark, sf).withColumn("name", name), ["doc_id", "name"])


@query(f"with {S.SQL_LINES}, f as (select doc_id, pos // 3 as section, {S.sql_norm('line')} as key from lines), m as (select doc_id, section + 1 as section, key from f where section % 2 = 0) select m.doc_id, m.section::bigint as section, m.key, min(f.section)::bigint as found_in from m join f on f.doc_id = m.doc_id and f.key = m.key and f.section <> m.section and length(f.key) >= 20 group by 1, 2, 3")
def q_found_elsewhere(spark, sf):
    rows = S.doc_lines(spark, sf).select("doc_id", F.expr("pos div 3").alias("section"), keys.norm_label(F.col("line")).alias("key"))
    moved = rows.filter("section % 2 = 0").withColumn("section", F.col("section") + 1)
    return diff.found_elsewhere(moved, rows, "doc_id", "section", "key")


@query("with m as (select c_custkey from customer where c_acctbal > 9500), g as (select distinct c_nationkey from customer semi join m using (c_custkey)) select c_custkey, c_nationkey from customer where c_nationkey in (from g) or not exists (from g)")
def q_default_scope(spark, sf):
    rows = S.table(spark, sf, "customer")
    return diff.default_scope(rows, rows.filter("c_acctbal > 9500"), "c_nationkey", "c_custkey").select("c_custkey", "c_nationkey")


@query("select o_custkey, count(*) as units, min(o_orderkey) as first, max(o_orderkey) as last, string_agg(o_orderpriority, ', ' order by o_orderkey) as names from orders group by o_custkey")
def q_group_ranges(spark, sf):
    names = F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))), lambda x: x["o_orderpriority"])
    return S.table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("units"), F.min("o_orderkey").alias("first"), F.max("o_orderkey").alias("last"), F.array_join(names, ", ").alias("names"))


# ---- matching and layout


@query("with v as (select distinct p_name from part where length(p_name) >= 8), l as (select distinct case when p_partkey % 3 = 0 then 'x' || p_name when p_partkey % 3 = 1 then substring(p_name, 2) else substring(p_name, 1, 4) || 'q' || substring(p_name, 6) end as label from part) select label, p_name, levenshtein(label, p_name)::int as distance from l, v where length(label) >= 8 and levenshtein(label, p_name) between 1 and case when length(label) < 12 then 1 else 2 end")
def q_fuzzy_label(spark, sf):
    rows = S.table(spark, sf, "part")
    label = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("x"), "p_name")).when(F.col("p_partkey") % 3 == 1, F.expr("substring(p_name, 2)")).otherwise(F.expr("concat(substring(p_name, 1, 4), 'q', substring(p_name, 6))"))
    return matching.fuzzy_variants(rows.select(label.alias("label")), rows, "label", "p_name")


@query("with v as (select distinct p_name from part where length(p_name) >= 8), l as (select distinct substring(p_name, 1, 4) || 'q' || substring(p_name, 6) as label from part), m as (select label, p_name, levenshtein(label, p_name) as d from l, v where length(label) >= 8 and levenshtein(label, p_name) between 1 and case when length(label) < 12 then 1 else 2 end) select label, min(p_name) as p_name, min(d)::int as distance from m group by label having count(*) = 1")
def q_fuzzy_unique(spark, sf):
    rows = S.table(spark, sf, "part")
    found = matching.fuzzy_variants(rows.select(F.expr("concat(substring(p_name, 1, 4), 'q', substring(p_name, 6))").alias("label")), rows, "label", "p_name")
    return matching.unique_variant(found, "label", "p_name")


_TOKENS = r"list_filter(list_transform(regexp_split_to_array({}, '[^\p{{L}}\p{{N}}_]+'), lambda x: {}), lambda x: x <> '')"


@query(f"with {S.SQL_LINES}, t as (select doc_id, pos, {_TOKENS.format('line', S.sql_norm('x'))} as t from lines), p as (select p_partkey, {_TOKENS.format('text', S.sql_norm('x'))} as p from (select item_id as p_partkey, unnest([text, array_to_string(string_split(text, ' ')[2:4], ' ')]) as text from benchmark)), q as (select distinct p_partkey * 1000 + len(p) as phrase_id, p from p where len(p) > 0), x as (select doc_id, pos, t, unnest(range(1, len(t) + 1)) as i from t) select doc_id, pos::int as pos, phrase_id, (i - 1)::int as \"at\" from x join q on t[i] = p[1] and t[i:i + len(p) - 1] = p")
def q_token_containment(spark, sf):
    """Whole items, and three words of each, in lines."""
    texts = S.doc_lines(spark, sf).select("doc_id", "pos", keys.label_tokens(F.col("line")).alias("tokens"))
    words = F.split("text", " ")
    phrases = S.table(spark, sf, "benchmark").select("item_id", F.explode(F.array("text", F.array_join(F.slice(words, 2, 3), " "))).alias("text")).select("item_id", keys.label_tokens(F.col("text")).alias("phrase"))
    named = phrases.filter(F.size("phrase") > 0).select((F.col("item_id").cast("long") * 1000 + F.size("phrase")).alias("phrase_id"), "phrase").distinct()
    return matching.contained_phrases(texts, named, "tokens", "phrase", "phrase_id", ["doc_id", "pos"])


@query(f"with b as (select item_id, {S.sql_layer('text')} as k from benchmark), d as (select doc_id, {S.sql_layer('text')} as p from documents) select item_id, doc_id, instr(p, k)::int as \"at\" from d join b on contains(p, k) where length(k) >= 12")
def q_text_layer_search(spark, sf):
    return matching.find_in_layer(S.table(spark, sf, "benchmark"), S.table(spark, sf, "documents"), "item_id", "text", "doc_id", "text")


@query(r"with l as (select distinct source, doc_id, regexp_replace(trim(line), '[0-9]+', '#', 'g') as shape from (select source, doc_id, unnest(string_split(text, chr(10))) as line from documents)), p as (select source, count(distinct doc_id) as pages from documents group by 1) select source, shape, count(*) as n, pages from l join p using (source) where shape <> '' group by source, shape, pages having count(*) >= 3 and count(*) >= 0.05 * pages")
def q_repeated_lines(spark, sf):
    return layout.repeated_lines(S.doc_lines(spark, sf), "source", "doc_id", "line", share=0.05)


@query("with c as (select distinct (l_orderkey * 7919 + l_partkey * 104729) % 16777216 as color from lineitem), b as (select distinct (p_partkey * 15485863) % 16777216 as base from part), d as (select color, base, greatest(abs((color >> 16) - (base >> 16)), abs(((color >> 8) & 255) - ((base >> 8) & 255)), abs((color & 255) - (base & 255))) as d from c, b) select color, count(*) as near from d where d <= 10 group by color")
def q_rgb_near(spark, sf):
    colors = S.table(spark, sf, "lineitem").select(F.pmod(F.col("l_orderkey") * 7919 + F.col("l_partkey") * 104729, F.lit(16777216)).alias("color"))
    base = S.table(spark, sf, "part").select(F.pmod(F.col("p_partkey") * 15485863, F.lit(16777216)).alias("base"))
    return layout.near_colors(colors, base, "color", "base")


@query("select l_orderkey, l_linenumber, l_partkey, l_suppkey, box from lineitem join (select p_partkey as box, p_size as page, p_retailprice * 10 as x0, p_retailprice * 10 + 3000 as x1, p_partkey % 40 as y0, p_partkey % 40 + 4 as y1 from part) on page = l_partkey % 50 and l_extendedprice between x0 and x1 and l_quantity between y0 and y1")
def q_range_box(spark, sf):
    boxes = S.table(spark, sf, "part").select(F.col("p_partkey").alias("box"), F.col("p_size").cast("long").alias("page"), (F.col("p_retailprice") * 10).alias("x0"), (F.col("p_retailprice") * 10 + 3000).alias("x1"), (F.col("p_partkey") % 40).alias("y0"), (F.col("p_partkey") % 40 + 4).alias("y1"))
    points = S.table(spark, sf, "lineitem").withColumn("page", F.col("l_partkey") % 50)
    return layout.points_in_boxes(points, boxes, "page", "l_extendedprice", "l_quantity", 3000.0, cell_y=4.0).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "box")


@query("""with recursive e as (select user_id, event_id, value, row_number() over (partition by user_id order by value, event_id) as k from events where value is not null), r as (select user_id, event_id, k, value as a, 1 as n from e where k = 1
union all select e.user_id, e.event_id, e.k, case when e.value - r.a > 3 then e.value else r.a end, case when e.value - r.a > 3 then n + 1 else n end from r join e on e.user_id = r.user_id and e.k = r.k + 1) select user_id, event_id, n::int as "row" from r""")
def q_row_cluster(spark, sf):
    spans = S.table(spark, sf, "events").filter("value is not null").select("user_id", "event_id", "value")
    return layout.group_rows(spans, ["user_id"], "value", "event_id").select("user_id", "event_id", "row")


# ---- JSON and scans


@query("select event_id, try_cast(props->>'k' as bigint) as k from events")
def q_json_contract(spark, sf):
    return S.table(spark, sf, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query()
def q_word_diff(spark, sf):
    """Word edits between both sides of each line that is on both; null marks a pair beyond the guard."""
    ship(spark)
    a, b = S.doc_lines(spark, sf).select("doc_id", "pos", F.col("line").alias("a")), S.edited_lines(spark, sf).select("doc_id", "pos", F.col("line").alias("b"))
    marked = a.join(b, ["doc_id", "pos"]).withColumn("d", folds.word_diff()(F.col("a"), F.col("b")))
    count = lambda op: F.size(F.filter("d", lambda x: x["op"] == op))
    return marked.select("doc_id", "pos", count("same").alias("same"), count("del").alias("deleted"), count("ins").alias("inserted"))


@query(r"""with c as (select doc_id, k, c, sum(case c when '(' then 1 when ')' then -1 else 0 end) over w as s from (select doc_id, unnest(string_split(text, '')) as c, generate_subscripts(string_split(text, ''), 1) as k from documents) window w as (partition by doc_id order by k)),
d as (select *, s - least(0, min(s) over (partition by doc_id order by k)) as depth from c), e as (select *, coalesce(sum((c = ',' and depth = 0)::int) over (partition by doc_id order by k rows between unbounded preceding and 1 preceding), 0) as n from d),
g as (select doc_id, n, trim(string_agg(case when c = ',' and depth = 0 then '' else c end, '' order by k), ' ' || chr(9) || chr(10) || chr(13)) as entry, max(case when c = ',' and depth = 0 then 0 else least(depth, 1) end) filter (where k = m) as open from (select *, max(k) over (partition by doc_id, n) as m from e) group by 1, 2)
select doc_id, (row_number() over (partition by doc_id order by n) - 1)::int as pos, open::int as open, entry from g where entry <> ''""")
def q_declared_entries(spark, sf):
    """Entries of a document's declaration line, here its text cut at commas outside parentheses."""
    ship(spark)
    rows = S.table(spark, sf, "documents").select("doc_id", F.explode(folds.declared_entries(F.col("text"))).alias("e"))
    return rows.select("doc_id", "e.pos", "e.open", "e.entry")


@query(
    f"with {S.SQL_LINES}, k as (select doc_id, pos, nfc_normalize(line) as line, {S.sql_layer('line')} as norm from lines) select doc_id, pos::int as pos, norm, case when norm <> '' then length(regexp_extract(line, '^({S._SPACE}|[-\u00ad–—])*')) end::int as first, "
    f"case when norm <> '' then length(line) - length(regexp_extract(line, '({S._SPACE}|[-\u00ad–—])*$')) - 1 end::int as last from k"
)
def q_indexed_key(spark, sf):
    """Each line's key with the place of its first and last character in the raw line."""
    ship(spark)
    rows = S.doc_lines(spark, sf).withColumn("k", folds.indexed_key(F.col("line")))
    return rows.select("doc_id", "pos", "k.norm", F.array_min("k.idx").alias("first"), F.array_max("k.idx").alias("last"))


@query(f"with {S.SQL_EDITED}, a as (select doc_id, pos // 3 as section, count(*) as document from lines group by 1, 2), b as (select doc_id, section, count(*) as sheet from edited group by 1, 2) select doc_id, section::bigint as section, document, sheet, 'SAYI_FARKLI' as status from a join b using (doc_id, section) where document <> sheet")
def q_count_differs(spark, sf):
    return diff.count_differs(S.doc_lines(spark, sf).withColumn("section", F.expr("pos div 3")), S.edited_lines(spark, sf), ["doc_id", "section"])
