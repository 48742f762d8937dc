"""DuckDB statements that give the rows of those queries that SQL can express."""

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SPACED = r"[^\x20\x09-\x0D]+"

OP2 = f"""
with d as (select doc_id, regexp_extract_all({LOWER}, '{ALNUM}') w from documents),
b as (select item_id, regexp_extract_all({LOWER}, '{ALNUM}') w from benchmark),
win as (select distinct cast(item_id as varchar) item, w[i : i + least(10, len(w)) - 1] g
  from b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) t(i) where len(w) > 0),
sizes as (select distinct len(g) n from win),
p as (select doc_id, s.n, t.i, w[t.i : t.i + s.n - 1] g from d, sizes s, unnest(range(1, len(w) - s.n + 2)) t(i)),
h as (select p.doc_id, p.i, p.n, win.item from p join win on p.g = win.g),
words as (select doc_id, count(distinct k) n_hit from h, unnest(range(i, i + n)) t(k) group by doc_id),
items as (select doc_id, coalesce(list_sort(list(distinct item) filter (item is not null)), []) items from h group by doc_id)
select d.doc_id, cast(len(w) as bigint) n_words, coalesce(n_hit, 0) n_hit, cast(coalesce(len(items), 0) as bigint) n_items,
  sha256(coalesce(array_to_string(items, ','), '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from d left join words using (doc_id) left join items using (doc_id)
"""

OP3 = """
with recursive v as (select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) e from embeddings where label is not null),
l as (select a.vec_id a, b.vec_id b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id
  where list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= 0.98),
reach(n, m) as (select vec_id, vec_id from embeddings union select r.n, l.b from reach r join l on r.m = l.a),
c as (select n, min(m) m from reach group by n),
k as (select a, count(*) n from l group by a)
select vec_id, coalesce(k.n, 0) n_links, c.m component_id, vec_id = c.m kept
from embeddings join c on c.n = vec_id left join k on k.a = vec_id
"""

OP5 = f"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '{SPACED}') w from documents),
g as (select doc_id, i, array_to_string(w[i : i + 34], ' ') s from d, unnest(range(1, len(w) - 33)) t(i)),
r as (select s from g group by s having count(*) > 1),
gone as (select distinct doc_id, k from g join r using (s), unnest(range(i, i + 35)) t(k)),
per as (select doc_id, list(k) ks from gone group by doc_id)
select d.doc_id, cast(len(w) as bigint) n_words, cast(coalesce(len(ks), 0) as bigint) n_removed,
  sha256(coalesce(array_to_string(list_filter(w, lambda x, i: ks is null or not list_contains(ks, i)), ' '), '')) kept_sha256
from d left join per using (doc_id)
"""

OP6 = f"""
with recursive d as (select doc_id, regexp_extract_all({LOWER}, '{SPACED}') w from documents),
s as (select distinct doc_id, array_to_string(w[i : i + 3], ' ') g from d, unnest(range(1, greatest(len(w) - 3, 1) + 1)) t(i) where len(w) > 0),
n as (select doc_id, count(*) n from s group by doc_id),
o as (select a.doc_id a, b.doc_id b, count(*) k from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
l as (select a, b from o join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 85 * (x.n + y.n - k)),
reach(n, m) as (select doc_id, doc_id from d union select r.n, l.b from reach r join l on r.m = l.a),
c as (select n doc_id, min(m) component_id from reach group by 1)
select d.doc_id, coalesce(n.n, 0) n_shingles, component_id from d join c using (doc_id) left join n using (doc_id)
"""

_LEVELS = ["domain", "lang", "source"]


def _share(name: str, base: str, level: str, parent: list[str], weight: str) -> str:
    """One level of the budget tree: water-filling by windows over the parent."""
    path = ", ".join([*parent, level])
    over = f"partition by {', '.join(parent)}" if parent else ""
    before = f"over ({over} order by ratio, {level} rows between unbounded preceding and 1 preceding)"
    return f"""
{name}_a as (select {path}, sum(cap) cap, first(budget) given, case when sum(cap) > 0 then {weight} else 0.0 end weight from {base} group by {path}),
{name}_b as (select *, case when weight > 0 then cap / weight else 0.0 end ratio from {name}_a),
{name}_c as (select *, given >= coalesce(sum(cap) {before}, 0) + ratio * (sum(weight) over ({over}) - coalesce(sum(weight) {before}, 0)) is_full from {name}_b),
{name}_d as (select {path}, case when is_full then cap else greatest(0.0, (given - sum(case when is_full then cap else 0.0 end) over ({over})) * weight
  / sum(case when is_full then 0.0 else weight end) over ({over})) end got from {name}_c),
{name} as (select x.* exclude (budget), y.got budget from {base} x join {name}_d y using ({path}))"""


OP9 = f"""
with r as (select doc_id, coalesce(cast(doc_id as varchar), md5(text), '') as name, case when n < 2 then 'web' when n = 2 then 'books' else 'forum' end as domain, coalesce(lang, '') lang, coalesce(source, '') source,
    cast(len(regexp_extract_all(text, '{SPACED}')) as bigint) n_tokens
  from (select *, try_cast(regexp_extract(coalesce(source, ''), '([0-9]+)', 1) as integer) % 4 n from documents)),
rows_ as (select * from r where n_tokens > 0),
leaf as (select domain, lang, source, cast(sum(n_tokens) as double) tokens, cast(sum(n_tokens) as double) * 4.0 cap from rows_ group by all),
l0 as (select *, least(sum(tokens) over () * 0.5, sum(cap) over ()) budget from leaf),
{_share("l1", "l0", "domain", [], "first(case domain when 'web' then 5.0 when 'books' then 3.0 when 'forum' then 2.0 else 1.0 end)")},
{_share("l2", "l1", "lang", ["domain"], "first(case lang when 'en' then 4.0 when 'de' then 2.0 else 1.0 end)")},
{_share("l3", "l2", "source", ["domain", "lang"], "1.0")},
plan as (select domain, lang, source, cast(tokens as bigint) tokens, cast(floor(budget + 1e-6) as bigint) budget from l3),
p as (select *, cast(floor(budget / tokens) as integer) as whole, budget - cast(floor(budget / tokens) as bigint) * tokens rest from plan),
x as (select rows_.*, whole, rest, md5(concat_ws(':', '13', whole, name)) key from rows_ join p using (domain, lang, source)),
y as (select *, coalesce(sum(n_tokens) over (partition by domain, lang, source order by key, n_tokens rows between unbounded preceding and 1 preceding), 0) as start_ from x)
select doc_id, domain, lang, source, whole epoch, n_tokens, cast(least(n_tokens, rest - start_) as bigint) take_tokens from y where start_ < rest
union all
select doc_id, domain, lang, source, cast(e as integer), n_tokens, n_tokens from x, unnest(range(0, whole)) t(e)
"""

OP11 = f"""
with d as (select doc_id, coalesce(text, '') t, coalesce(lang, '') part, regexp_extract_all(coalesce(text, ''), '{SPACED}') w from documents),
m as (select part,
    case when len(w) < 100 then 1 else 0 end + case when 100 * len(list_distinct(w)) < 80 * len(w) then 2 else 0 end
    + case when 100 * len(regexp_extract_all(t, '[A-Z]')) > 10 * length(t) then 4 else 0 end + case when regexp_matches(t, '[#$%&*|]') then 8 else 0 end
    + case when doc_id > min(doc_id) over (partition by t) then 16 else 0 end fails,
    exists (select 1 from labels l where l.doc_id = d.doc_id and l.quality = 1) good, exists (select 1 from labels l where l.doc_id = d.doc_id and l.toxic = 1) toxic
  from d),
c as (select part, fails, count(*) n, count(*) filter (good) good, count(*) filter (toxic) toxic from m group by all),
f(name, bit) as (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o as (select a.name || b.name || c.name || d.name || e.name filter_order from f a, f b, f c, f d, f e where a.bit | b.bit | c.bit | d.bit | e.bit = 31),
s as (select filter_order, cast(i as integer) step, f.bit own, coalesce((select sum(g.bit) from f g where strpos(substr(filter_order, 1, i - 1), g.name) > 0), 0)::int before
  from o, unnest(range(1, 6)) t(i), f where f.name = substr(filter_order, i, 1)),
x as (select part, filter_order, step, own,
    sum(case when fails & (before | own) = 0 then n else 0 end) kept, sum(case when fails & own > 0 and fails & before = 0 then n else 0 end) removed,
    sum(case when fails & own > 0 and fails & before > 0 then n else 0 end) redundant, sum(case when fails = own then n else 0 end) unique_fails,
    sum(case when fails & own > 0 and fails & before = 0 then good else 0 end) good_lost, sum(case when fails & own > 0 and fails & before = 0 then toxic else 0 end) toxic_lost
  from c, s group by part, filter_order, step, own)
select part, filter_order, step, kept::bigint kept, removed::bigint removed, redundant::bigint redundant, unique_fails::bigint unique_fails,
  good_lost::bigint good_lost, toxic_lost::bigint toxic_lost, (sum(removed) over (partition by part, own))::bigint shapley from x
"""


def _round(i: int) -> str:
    """Round i of k-means: assignment a, then centroids c of the next round by exact floored means."""
    return f"""
a{i} as materialized (select vec_id, row_no, v, arg_min(cluster, (d, cluster)) cluster, min(d) d from (
    select x.vec_id, x.row_no, x.v, c.cluster, list_sum(list_transform(list_zip(x.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint d from x, c{i} c) group by all),
m{i} as (select cluster, j, sum(v[j])::hugeint s, count(*)::hugeint n from a{i}, unnest(range(1, 65)) t(j) group by all),
c{i + 1} as materialized (select c.cluster, coalesce(n.v, c.v) v from c{i} c left join (
    select cluster, list(((s - ((s % n) + n) % n) // n)::bigint order by j) v from m{i} group by cluster) n using (cluster)),"""


OP13 = f"""
with e as (select vec_id, embedding, row_number() over () row_no from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda y: y is null or not isfinite(y))) = 0),
x as materialized (select vec_id, row_no, list_transform(embedding, lambda y: floor(256 * y::double)::bigint) v from e),
c0 as materialized (select (row_number() over (order by sha256('2:' || vec_id), v))::int - 1 cluster, v from x qualify cluster < 40),
{"".join(_round(i) for i in range(6))}
f as (select cluster, sha256(array_to_string(v, ',')) centroid_sha256 from c5)
select vec_id, cluster, d distance, (sum(d) over (partition by cluster))::bigint cluster_inertia, (sum(d) over ())::bigint inertia, centroid_sha256
from a5 join f using (cluster)
"""

ORACLES = {"op11_filter_audit": OP11, "op13_clustering": OP13, "op2_decontamination": OP2, "op3_embedding_dedup": OP3, "op5_substring_dedup": OP5, "op6_jaccard_join": OP6, "op9_mixing": OP9}
