"""DuckDB SQL with the results of the operators that SQL can express."""

_SPACE = r"[\x20\x09-\x0D]"
_WORD = r"[^\x20\x09-\x0D]+"

_EXACT = rf"""
with t as (select doc_id, coalesce(text, '') as text, regexp_replace(coalesce(text, ''), '{_SPACE}', '', 'g') as norm from documents)
select doc_id,
       first_value(doc_id) over (partition by norm order by length(text) desc, doc_id) as keep_id,
       count(*) over (partition by norm) as group_size,
       doc_id = first_value(doc_id) over (partition by norm order by length(text) desc, doc_id) as kept,
       sha256(norm) as text_sha256
from t
"""

_EMBEDDINGS = """
with recursive
able as (
  select vec_id, label, [x::double for x in embedding] as v from embeddings
  where label is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
normed as (select vec_id, label, v, sqrt(list_dot_product(v, v)) as n from able),
links as (
  select a.vec_id as u, b.vec_id as v from normed a join normed b
  on a.label = b.label and a.vec_id <> b.vec_id and len(a.v) = len(b.v)
  where list_dot_product(a.v, b.v) / (a.n * b.n) >= 0.93),
walk(id, root) as (select vec_id, vec_id from embeddings union select l.v, w.root from walk w join links l on l.u = w.id),
comp as (select id, min(root) as component_id from walk group by id)
select e.vec_id, (select count(*) from links l where l.u = e.vec_id) as n_links, c.component_id, e.vec_id = c.component_id as kept
from embeddings e join comp c on c.id = e.vec_id
"""

_MIX = rf"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::bigint as size,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::varchar, 'null')), 1, 12))::bigint as bits
  from documents),
s0 as (select source, sum(size)::bigint as source_size from d group by source),
s1 as (select *, [1.0::double, 2.0::double, 3.0::double][(row_number() over (order by source nulls last) - 1) % 3 + 1] as weight from s0),
s2 as (select *, source_size * 3.0::double as most, source_size * 3.0::double / weight as room from s1),
s3 as (
  select *, row_number() over (order by room, source nulls last) as n,
    (sum(source_size) over ()::double - coalesce(sum(most) over (order by room, source nulls last rows between unbounded preceding and 1 preceding), 0))
    / (sum(weight) over () - coalesce(sum(weight) over (order by room, source nulls last rows between unbounded preceding and 1 preceding), 0)) as level
  from s2),
s4 as (select source, source_size, coalesce(least(most, weight * (select arg_min(level, n) from s3 where room >= level)), most) as target from s3),
k0 as (select source, length(bin(size)) as class, sum(size)::bigint as words from d where size > 0 group by source, class),
k1 as (
  select k0.*, s4.target, class + 4 as odds,
    (target - coalesce(sum(words) over (partition by k0.source order by class desc rows between unbounded preceding and 1 preceding), 0) * 3.0::double)
    / (sum((class + 4) * words) over (partition by k0.source order by class desc rows between current row and unbounded following))::double as level
  from k0 join s4 on k0.source is not distinct from s4.source),
k2 as (
  select k1.*, least(3.0::double, coalesce(arg_max(case when level * odds <= 3.0::double then level end, case when level * odds <= 3.0::double then class end) over (partition by source), 3.0::double) * odds) as wanted from k1),
k3 as (select *, floor(wanted)::bigint as certain, wanted - floor(wanted) as p from k2),
s6 as (select *, target - sum(certain * words) over (partition by source) as residual from k3),
r0 as (
  select d.doc_id, d.size, s4.source, s4.source_size, s4.target, coalesce(s.certain, 0) as certain, coalesce(s.p, 0) as p, s.residual, (bits + 0.5::double) / 281474976710656.0::double as u
  from d join s4 on d.source is not distinct from s4.source left join s6 s on d.source is not distinct from s.source and length(bin(d.size)) = s.class and d.size > 0),
r1 as (select *, case when p > 0 then u * (1 - p) / (u * (1 - p) + (1 - u) * p) end as rank from r0),
r as (
  select *, coalesce(sum(case when p > 0 then size else 0 end) over (partition by source order by rank nulls last, doc_id rows between unbounded preceding and 1 preceding), 0) as before from r1),
h as (select *, before + size / 2.0::double <= residual as head from r),
g as (select source, any_value(residual) - sum(case when head then size else 0 end) as gap from h where p > 0 group by source),
x as (
  select h.source, arg_min(h.doc_id, {{'a': abs(gap - case when head then -size else size end), 'b': h.doc_id}}) as turned
  from h join g on h.source is not distinct from g.source
  where p > 0 and abs(gap - case when head then -size else size end) < abs(gap) group by h.source),
c as (
  select h.*, h.certain + case when p > 0 and head <> coalesce(h.doc_id = x.turned, false) then 1 else 0 end as copies
  from h left join x on h.source is not distinct from x.source)
select doc_id, size, source_size, target, copies::bigint as copies, (copies * size)::bigint as taken from c
"""

_AUDIT = rf"""
with letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as f),
orders as (
  select a.f || b.f || c.f || d.f || e.f as filter_order from letters a, letters b, letters c, letters d, letters e
  where len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
texts as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '{_WORD}') as words from documents),
docs as (
  select doc_id, part,
    (case when len(words) < 50 then 'A' else '' end) || (case when 100 * len(list_distinct(words)) < 65 * len(words) then 'B' else '' end)
    || (case when 100 * len(regexp_extract_all(text, '[A-Z]')) > 5 * length(text) then 'C' else '' end)
    || (case when regexp_matches(text, '[#$%&*|]') then 'D' else '' end)
    || (case when doc_id > min(doc_id) over (partition by text) then 'E' else '' end) as fails
  from texts),
told as (
  select docs.part, docs.fails, coalesce(l.good, 0) as good, coalesce(l.bad, 0) as bad
  from docs left join (select doc_id, max(coalesce((quality = 1)::int, 0)) as good, max(coalesce((toxic = 1)::int, 0)) as bad from labels group by doc_id) l on docs.doc_id = l.doc_id),
steps as (
  select told.*, o.filter_order, s.step::int as step, contains(fails, filter_order[s.step]) as hit,
    length(regexp_replace(fails, '[^' || filter_order[1:s.step] || ']', '', 'g')) - contains(fails, filter_order[s.step])::int > 0 as gone
  from told, orders o, range(1, 6) s(step)),
summed as (
  select part, filter_order, step,
    count(*) filter (not hit and not gone) as kept, count(*) filter (hit and not gone) as removed, count(*) filter (hit and gone) as redundant,
    count(*) filter (fails = filter_order[step]) as unique_fails,
    coalesce(sum(good) filter (hit and not gone), 0)::bigint as good_lost, coalesce(sum(bad) filter (hit and not gone), 0)::bigint as toxic_lost
  from steps group by part, filter_order, step)
select *, (sum(removed) over (partition by part, filter_order[step]))::bigint as shapley from summed
"""

_CRC_TABLE = "select list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t"


def _crc32(text: str) -> str:
    """CRC-32 of a text in UTF-8, next to a relation `crc` of _CRC_TABLE."""
    tail = lambda shift: f"128 + ((unicode(c) >> {shift}) & 63)"
    return f"""xor(list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(string_split({text}, ''), lambda c: case
    when c = '' then []::bigint[]
    when unicode(c) < 128 then [unicode(c)::bigint]
    when unicode(c) < 2048 then [192 + (unicode(c) >> 6), {tail(0)}]::bigint[]
    when unicode(c) < 65536 then [224 + (unicode(c) >> 12), {tail(6)}, {tail(0)}]::bigint[]
    else [240 + (unicode(c) >> 18), {tail(12)}, {tail(6)}, {tail(0)}]::bigint[] end))), lambda c, b: xor(c >> 8, crc.t[(xor(c, b) & 255) + 1])), 4294967295::bigint)"""


_SPELLING = rf"""
with recursive
crc as ({_CRC_TABLE}),
runs as (
  select doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run from documents),
counted as (select coalesce(doc_id::varchar, 'null') || ':' || run as told, run, count(*) as n from runs group by told, run),
hashed as (select run, n, {_crc32('told')} as h from counted, crc),
slipped as (select n, case when h % 97 = 0 then run[1 : h % length(run)] || run[h % length(run) + 2 :] else run end as word from hashed),
words as (select word, sum(n)::bigint as n from slipped where length(word) >= 5 group by word having sum(n) >= 3),
holes as (select word, n, length(word) as l, i, word[1 : i - 1] || word[i + 1 :] as rest from (select *, unnest(range(1, length(word) + 1)) as i from words)),
near as (
  select a.word, a.n, b.word as other, b.n as other_n from holes a join holes b on a.l = b.l and a.i = b.i and a.rest = b.rest and a.word <> b.word
  union select a.word, a.n, b.word, b.n from holes a join words b on a.rest = b.word
  union select b.word, b.n, a.word, a.n from holes a join words b on a.rest = b.word),
best as (
  select word, count(*) as n_near, first(other order by other_n desc, other) as other, max(other_n) as other_n from near group by word),
forms as (
  select w.word, w.n, coalesce(b.n_near, 0) as n_near, case when b.other_n >= 2 * w.n then b.other end as form, case when b.other_n >= 2 * w.n then b.other_n end as form_n
  from words w left join best b on w.word = b.word),
walk(word, latest, form) as (
  select word, word, form from forms union all select w.word, w.form, f.form from walk w join forms f on f.word = w.form)
select f.word, f.form, w.latest as root, f.n, f.n_near::bigint as n_near, f.form_n::bigint as form_n from forms f join walk w on w.word = f.word and w.form is null
"""



def _hex(text: str, digits: int) -> str:
    return f"('0x' || substr(md5({text}), 1, {digits}))::bigint"


def _kd_level(before: str, after: str) -> str:
    """Each node with over one shard in it is cut along its widest dimension at the weighted median."""
    return f"""
{after}_nodes as (
  select low, high, sum(size)::bigint as total, list_position(w, list_max(w)) as dim, low + (high - low) // 2 as mid, sum(size)::double * ((high - low) // 2) / (high - low) as goal
  from (select *, [(max(c0) over n - min(c0) over n)::double / greatest(max(c0) over () - min(c0) over (), 1), (max(c1) over n - min(c1) over n)::double / greatest(max(c1) over () - min(c1) over (), 1),
      (max(c2) over n - min(c2) over n)::double / greatest(max(c2) over () - min(c2) over (), 1)] as w from {before} window n as (partition by low))
  where high - low > 1 group by low, high, w),
{after}_keyed as (
  select b.*, n.total, n.mid, n.goal, [c0, c1, c2][n.dim] * 4294967296 + tie as key from {before} b left join {after}_nodes n on b.low = n.low),
{after}_sums as (
  select *, sum(size) over (partition by low, key) as w, sum(size) over (partition by low order by key) as till,
    sum(size) over (partition by low, key, pick) as w2, sum(size) over (partition by low, key order by pick) as till2 from {after}_keyed),
{after}_sided as (
  select *, case
      when till <= goal then true
      when till - w > goal then false
      when w <= total * 0.01::double then goal - (till - w) >= w / 2
      when till - w + till2 <= goal then true
      when till - w + till2 - w2 > goal then false
      else goal - (till - w + till2 - w2) >= w2 / 2 end as on_left from {after}_sums),
{after} as (
  select doc_id, size, text_crc32, tie, pick, seat, c0, c1, c2,
    case when mid is null or on_left then low else mid end as low, case when mid is null or not on_left then high else mid end as high from {after}_sided)"""


_SHARDS = rf"""
with
crc as ({_CRC_TABLE}),
d0 as (
  select doc_id, coalesce(text, '') as text, md5(coalesce(text, '')) as digest, coalesce(doc_id::varchar, 'null') as name,
    coalesce({_hex("source", 4)} + 1, 0) as p0, coalesce({_hex("lang", 4)} + 1, 0) as p1, octet_length(encode(coalesce(text, '')))::bigint + 1 as size from documents),
l0 as (
  select doc_id, size, {_crc32("text")} as text_crc32, ('0x' || substr(digest, 1, 8))::bigint as tie, {_hex("name", 8)} as pick, {_hex("name || ':' || digest", 8)} as seat,
    min(p0) over g as c0, min(p1) over g as c1, (length(bin(size)) - 1) * 1024 + floor(size * 1024 / pow(2, length(bin(size)) - 1))::bigint - 1024 as c2, 0 as low, 8 as high
  from d0, crc window g as (partition by digest, size)),
{_kd_level("l0", "l1")},{_kd_level("l1", "l2")},{_kd_level("l2", "l3")}
select doc_id, size, text_crc32, 'bytes' as law, low::int as shard, row_number() over (partition by low order by seat, doc_id nulls first) - 1 as slot, null::int as grown_shard from l3
"""

SQL = {"op1_exact_dedup": _EXACT, "op2_embedding_near_dedup": _EMBEDDINGS, "op3_mixing": _MIX, "op11_spelling_variants": _SPELLING, "op12_sharding": _SHARDS, "op13_filter_audit": _AUDIT}
