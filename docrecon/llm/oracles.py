"""SQL that gives the rows of those queries that SQL can express, for DuckDB over the same tables."""

from docrecon.llm.license_scan import PHRASES, TEMPLATES
from docrecon.llm.quality_rules import BOILERPLATE, LineRules

_LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PLAIN = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_BLANK = r"regexp_extract_all(coalesce({}, ''), '[^\x20\x09-\x0D]+')"


def near_duplicates(words: int = 4, percent: int = 80) -> str:
    """Exact sets, all pairs that share a shingle, and the smallest id within reach."""
    return rf"""
with recursive w as (select doc_id, regexp_extract_all({_LOWER.format("text")}, '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < {words} then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - {words} + 2), lambda i: array_to_string(w[i:i + {words} - 1], ' ')) end) as s from w),
n as (select doc_id, count(*) as n from s group by doc_id),
f as (select s from s group by s having count(*) > 1),
p as (select a.doc_id as a, b.doc_id as b, count(*) as shared from (select * from s semi join f using (s)) a join (select * from s semi join f using (s)) b on a.s = b.s and a.doc_id <> b.doc_id group by 1, 2),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * shared >= {percent} * (x.n + y.n - shared)),
r(doc_id, seen) as (select doc_id, doc_id from w union select r.doc_id, l.b from r join l on l.a = r.seen)
select w.doc_id, coalesce(any_value(n.n), 0)::bigint as n_shingles, min(r.seen) as component_id, w.doc_id = min(r.seen) as kept
from w left join n using (doc_id) join r using (doc_id) group by w.doc_id"""


def license_scan(threshold: float = 0.8) -> str:
    """Phrase places by comparing slices at every word; templates by counting every block of every document."""
    hits = " union all ".join(
        f"select doc_id, '{label}' as label, unnest(list_filter(range(0, len(w) - {n - 1}), lambda i: w[i + 1:i + {n}] = {phrase.split()})) as place from w where len(w) >= {n}"
        for phrase, label in PHRASES.items() for n in [len(phrase.split())]
    )
    notices = ", ".join("({}, {})".format(i, ", ".join("'" + x.replace("'", "''") + "'" for x in t)) for i, t in enumerate(TEMPLATES))
    return f"""
with w as (select doc_id, {_PLAIN.format("text")} as w from documents),
h as ({hits}),
n as (select template, label, ' ' || name || ' ' as name, {_PLAIN.format("text")} as t from (values {notices}) as v(template, label, name, text)),
k as (select *, len(list_distinct(t)) as m, len(t) as size from n),
x as (select doc_id, k.*, unnest(range(0, greatest(len(w) - size, 1), size)) as i, w from w, k where len(list_intersect(list_distinct(t), w)) >= {threshold} * m - 1e-9),
z as (select doc_id, template, label, m, i, least(len(w), i + 2 * size) as j, len(list_intersect(list_distinct(t), w[i + 1:i + 2 * size])) as shared, contains(' ' || array_to_string(w[i + 1:i + 2 * size], ' ') || ' ', name) as named from x),
y as (select * from z where shared >= {threshold} * m - 1e-9),
t as (select * from y as o where named or not exists (select 1 from y where y.doc_id = o.doc_id and y.label <> o.label and y.i < o.j and o.i < y.j and (y.named or y.shared * o.m > o.shared * y.m))),
b as (select doc_id, count(*) as n, min(place) as lo, max(place) as hi, string_agg(distinct label, ',' order by label) as labels from h group by doc_id),
a as (select doc_id, string_agg(distinct label, ',' order by label) as labels from (select doc_id, label from h union all select doc_id, label from t) group by doc_id),
s as (select doc_id, max(shared / m) as share, string_agg(label || '#' || template || '@' || i || ':' || shared || '/' || m, ',' order by i, template) as blocks from y group by doc_id)
select w.doc_id, len(w)::bigint as n_words, coalesce(b.n, 0)::bigint as n_base, b.lo::bigint as first_word, b.hi::bigint as last_word,
    coalesce(b.labels, '') as base_labels, coalesce(a.labels, '') as labels, case when b.n > 0 then 1.0 else coalesce(s.share, 0.0) end::double as score, coalesce(s.blocks, '') as blocks
from w left join b using (doc_id) left join a using (doc_id) left join s using (doc_id)"""


def quality_rules(rules: LineRules = LineRules()) -> str:
    blank = r"' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    notices = " or ".join(f"contains(lower(bare), '{x}')" for x in BOILERPLATE)
    return rf"""
with d as (select doc_id, coalesce(text, '') as text, {_BLANK.format("text")} as w from documents),
x as (select doc_id, unnest(range(0, len(w) - 2)) as i, w from d where len(w) >= 3),
g as (select doc_id, i, count(*) over (partition by doc_id, w[i + 1:i + 3]) as n from x),
rep as (select doc_id, count(distinct p) as n from (select doc_id, unnest([i, i + 1, i + 2]) as p from g where n > 1) group by doc_id),
l as (select doc_id, k, line, trim(line, {blank}) as bare from (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as k from d)),
v as (select *, regexp_replace(line, '[ \t-\r]+', '', 'g') as seen from l where bare <> ''),
f as (select *, length(regexp_replace(seen, '[^#*$%&|<>!?{{}}=_~^+@\\]+', '', 'g')) as marks, length(regexp_replace(seen, '[^\p{{L}}]+', '', 'g')) as letters,
    length(regexp_replace(seen, '[^\p{{Lu}}]+', '', 'g')) as capitals, len({_BLANK.format("line")}) as n from v),
c as (select doc_id, sum(length(line)) as total, count(*) as lines, count(distinct line) as kinds, coalesce(sum(length(line)) filter (where not (
      marks > {rules.max_mark_share} * length(seen) or (letters >= {rules.min_upper_letters} and capitals > {rules.max_upper_share} * letters)
      or (n < {rules.min_line_words} and not regexp_matches(bare, '[.!?:;…。！？"''”’)\]]$'))
      or len(regexp_extract_all(bare, '[ \t-\r][|»›>•·/][ \t-\r]')) >= {rules.max_separators}
      or {notices} or regexp_matches(bare, '^(©|\(c\) ?[0-9]{{4}})'))), 0) as held from f group by doc_id)
select d.doc_id, len(w)::bigint as n_words, length(regexp_replace(text, '[ \t-\r]+', '', 'g'))::bigint as word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::bigint as n_symbols, coalesce(lines - kinds, 0)::bigint as n_dup_lines, coalesce(rep.n, 0)::bigint as n_repeat_words,
    len(w) < 50 or 100 * coalesce(rep.n, 0) > 50 * len(w) as base_failed,
    not (len(w) < 50 or 100 * coalesce(rep.n, 0) > 50 * len(w)) and coalesce(held, 0) >= {rules.min_kept_share} * coalesce(total, 0) as kept
from d left join rep using (doc_id) left join c using (doc_id)"""


def decontamination(window: int = 10) -> str:
    return f"""
with d as (select doc_id, {_PLAIN.format("text")} as w from documents),
b as (select item_id, {_PLAIN.format("text")} as w from benchmark),
i as (select distinct item_id, unnest(case when len(w) = 0 then [] when len(w) <= {window} then [w] else list_transform(range(1, len(w) - {window - 2}), lambda k: w[k:k + {window - 1}]) end) as s from b),
z as (select distinct len(s) as n from i),
x as (select doc_id, n, unnest(range(1, len(w) - n + 2)) as k, w from d, z where len(w) >= n),
h as (select x.doc_id, x.k, x.n, i.item_id from x join i on i.s = x.w[x.k:x.k + x.n - 1]),
c as (select doc_id, count(distinct p) as n from (select doc_id, unnest(range(k, k + n)) as p from h) group by doc_id),
o as (select doc_id, count(distinct item_id) as n, sha256(string_agg(distinct item_id::varchar, ',' order by item_id::varchar)) as s from h group by doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(c.n, 0)::bigint as n_hit, coalesce(o.n, 0)::bigint as n_items, coalesce(o.s, sha256('')) as items_sha256, coalesce(c.n, 0) > 0 as contaminated
from d left join c using (doc_id) left join o using (doc_id)"""


def fill_in_middle(seed: int = 1, plain_percent: int = 10, spm_percent: int = 20) -> str:
    """Pieces by slices of the token list; what is restored must be the text."""
    return f"""
with d as (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') as w, sha256('{seed}:' || coalesce(doc_id::varchar, '')) as g from documents),
h as (select *, len(w) as n, [('0x' || substring(g, k, 8))::bigint for k in [1, 9, 17, 25]] as h from d),
c as (select *, least(h[1] % (n + 1), h[2] % (n + 1)) as i, greatest(h[1] % (n + 1), h[2] % (n + 1)) as j,
    case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h[3] % 100 >= {100 - plain_percent} then 'plain' when h[4] % 100 < {spm_percent} then 'spm' else 'psm' end as form from h),
x as (select *, array_to_string(w[:i], '') as p, array_to_string(w[i + 1:j], '') as m, array_to_string(w[j + 1:], '') as s from c)
select doc_id, n::bigint as n, form, case when form <> 'plain' then length(p)::bigint end as prefix_chars, case when form <> 'plain' then length(m)::bigint end as middle_chars,
    sha256(case form when 'plain' then text when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256, sha256(text) as restored_sha256
from x"""


def conversation_repair() -> str:
    """A row at a time, per state the least (cost, audit) with the text so far; CRC-32 bit by bit."""
    bit = "case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end"
    crc = f"xor(list_reduce(list_transform(string_split(k, ''), lambda x: ascii(x)::bigint), lambda a, b: list_reduce(range(8), lambda x, i: {bit}, xor(a, b)), 4294967295::bigint), 4294967295::bigint)"

    def path(source, letter, cost, piece, when="true"):
        return f"case when {source} is not null and ({when}) then struct_pack(c := {source}.c + {cost}, a := {source}.a || '{letter}', t := {source}.t || case when {source}.t = '' then '' else chr(10) end || {piece}) end"

    def least(*offers):
        return f"list_min([{', '.join(offers)}])"

    def kept(source, initial):
        return path(source, "K", "more", "role || ':' || text", f"held and left(role, 1) = '{initial}'")

    def turned(source, name):
        return path(source, "R", "3 + more", f"'{name}:' || text", "held")

    def gone(source):
        return f"case when {source} is not null then struct_pack(c := {source}.c + 4, a := {source}.a || 'D', t := {source}.t) end"

    def added(source, name):
        return path(source, "I", "3", f"'{name}:'")

    steps = ", ".join([
        f"{gone('r.s0')} as s0", f"{least(gone('r.s1'), kept('r.s0', 's'))} as s1",
        f"{least(gone('r.s2'), *(f for x in ('r.s0', 'r.s1', 'r.s3') for f in (kept(x, 'u'), turned(x, 'user'))))} as s2",
        f"{least(gone('r.s3'), kept('r.s2', 'a'), turned('r.s2', 'assistant'))} as s3",
    ])
    user = least("s2", *(added(x, "user") for x in ("s0", "s1", "s3")))
    answer = least("s3", added("s2", "assistant"))
    none = "null::struct(c bigint, a varchar, t varchar)"
    return rf"""
with recursive z as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as k from conversations),
g as (select *, {crc} % 20 as kind from z),
d as (select conv_id, turn, case kind when 4 then 'user' else role end as role, case kind when 1 then '' when 2 then translate(text, '.!?', '') else text end as text,
    unnest(case kind when 3 then [0, 1] else [0] end) as copy from g where kind <> 0),
n as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as i, regexp_replace(text, '[ 	-
]+$', '') as bare from d),
e as (select *, row_number() over (partition by conv_id, role, text order by i) as seen, lag(left(role, 1)) over (partition by conv_id order by i) as before from n),
f as (select *, case when bare = '' then 1 when seen > 1 then 2 when right(bare, 1) not in ('.', '!', '?') then 3 else 0 end as fault from e),
q as (select *, fault in (0, 3) as held, case when fault = 3 then 3 else 0 end as more from f),
r(conv_id, i, s0, s1, s2, s3) as (
    select conv_id, 0::bigint, s0, s1, s2, {answer} from (select conv_id, s0, s1, {user} as s2, s3 from (select distinct conv_id, struct_pack(c := 0::bigint, a := '', t := '') as s0, {none} as s1, {none} as s2, {none} as s3 from conversations))
    union all
    select conv_id, i, s0, s1, s2, {answer} from (select conv_id, i, s0, s1, {user} as s2, s3 from (select r.conv_id, q.i, {steps} from r join q on q.conv_id is not distinct from r.conv_id and q.i = r.i + 1))),
b as (select conv_id, {least("s0", "s3")} as best from r qualify row_number() over (partition by conv_id order by i desc) = 1),
t as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (where fault = 1) as blank, count(*) filter (where fault = 2) as duplicate, count(*) filter (where fault = 3) as truncated,
    count(*) filter (where before is not null and before || left(role, 1) not in ('su', 'ua', 'au')) as illegal from q group by conv_id)
select b.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal,
    best.c::bigint as cost, best.a as audit, sha256(best.t) as repaired_sha256
from b left join t on t.conv_id is not distinct from b.conv_id"""


ORACLE_SQL = {
    "op2_near_duplicates": near_duplicates(),
    "op3_license_scan": license_scan(),
    "op6_quality_rules": quality_rules(),
    "op7_decontamination": decontamination(),
    "op12_fill_in_middle": fill_in_middle(),
    "op13_conversation_repair": conversation_repair(),
}
