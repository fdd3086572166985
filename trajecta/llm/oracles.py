"""SQL for the queries of this subpackage that SQL can express: all pairs, for small tables."""

COMPONENTS = """edge as (select a, b from link union select b, a from link),
reach as (select id v, id r from item union select edge.b, reach.r from reach join edge on edge.a = reach.v),
root as (select v, min(r) component_id from reach group by v)"""

NEAR_VECTORS = f"""with recursive item as (select vec_id id from embeddings),
ok as (select vec_id, label, cast(embedding as double[]) e from embeddings where label is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
link as (select x.vec_id a, y.vec_id b from ok x join ok y on x.label = y.label and len(x.e) = len(y.e) and x.vec_id <> y.vec_id where list_cosine_similarity(x.e, y.e) >= 0.98),
{COMPONENTS}
select i.id vec_id, (select count(*) from link where a = i.id) n_links, component_id, i.id = component_id kept from item i join root on root.v = i.id"""

NEAR_DOCUMENTS = rf"""with recursive item as (select doc_id id from documents),
w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents),
s as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')] else [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)] end) sh from w),
n as (select doc_id, count(*) n from s group by 1),
p as (select x.doc_id a, y.doc_id b, count(*) c from s x join s y on x.sh = y.sh and x.doc_id < y.doc_id group by 1, 2),
link as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
{COMPONENTS}
select i.id doc_id, coalesce(n.n, 0) n_shingles, component_id, i.id = component_id kept from item i join root on root.v = i.id left join n on n.doc_id = i.id"""

#: Optimal partitioning: a state is cost * 2**20 + segments, one step for each end day, then the cuts backwards.
CHANGE_POINTS = """with recursive daily as (select vendor_id, date_diff('day', date '1970-01-01', cast(shipped_at as date)) d, sum(quantity)::bigint x from sale_lines where flag = 'kept' and quantity is not null and shipped_at is not null group by 1, 2),
span as (select vendor_id, min(d) a, max(d) b from daily group by 1),
dense as (select s.vendor_id, a, g.d - a + 1 i, coalesce(x, 0)::hugeint x from (select *, unnest(range(a, b + 1)) d from span) g join span s using (vendor_id, a, b) left join daily y on y.vendor_id is not distinct from g.vendor_id and y.d = g.d),
run as (select vendor_id, a, i, sum(x) over w s, sum(x * x) over w q from dense window w as (partition by vendor_id order by i)),
lists as (select vendor_id, a, count(*) n, [0::hugeint] || list(s::hugeint order by i) s, [0::hugeint] || list(q::hugeint order by i) q from run group by 1, 2),
dp as (select vendor_id, a, n, s, q, 0 j, [-20000::hugeint * 1048576] state, [null::bigint] back from lists
union all select vendor_id, a, n, s, q, j + 1, state || [case when len(held) > 0 then list_min(held) end], back || [case when len(held) > 0 then starts[list_position(held, list_min(held))] end] from
(select *, list_filter(range(0, greatest(j + 2 - least_days, 0)), lambda i: state[i + 1] is not null) starts, list_transform(list_filter(range(0, greatest(j + 2 - least_days, 0)), lambda i: state[i + 1] is not null), lambda i: state[i + 1] + 1 + 1048576::hugeint * (20000 + (j + 1 - i) * cast(floor(1000 * ln(1 + ((j + 1 - i) * (q[j + 2] - q[i + 1]) - (s[j + 2] - s[i + 1]) * (s[j + 2] - s[i + 1])) // ((j + 1 - i) * (j + 1 - i)))) as hugeint))) held from (select *, least(n, 7) least_days from dp where j < n))),
done as (select vendor_id, a, n, s, q, state, back from dp where j = n),
cuts as (select vendor_id, a, n, s, q, back, state[n + 1] best, n e, back[n + 1] b from done union all select vendor_id, a, n, s, q, back, best, b, back[b + 1] from cuts where b > 0),
segs as (select vendor_id, row_number() over (partition by vendor_id order by b) segment_no, a + b first_day, e - b n_days, s[e + 1] - s[b + 1] total, 1 + ((e - b) * (q[e + 1] - q[b + 1]) - (s[e + 1] - s[b + 1]) * (s[e + 1] - s[b + 1])) // ((e - b) * (e - b)) spread, count(*) over (partition by vendor_id) n_segments, cast(floor(best / 1048576.0) as bigint) best_cost from cuts)
select vendor_id, cast(segment_no as int) segment_no, first_day::bigint first_day, n_days::bigint n_days, total::bigint total, spread::bigint spread, (n_days * cast(floor(1000 * ln(spread)) as bigint))::bigint as cost, n_segments, best_cost from segs"""

#: CRC-32 from its table, words by it, and near words by keys with a character skipped or masked.
VARIANTS = r"""with recursive step as (select k, k::bigint c, 0 i from range(256) r(k) union all select k, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i + 1 from step where i < 8),
tab as (select list(c order by k) t from step where i = 8),
run as (select coalesce(doc_id::varchar, '') id, unnest(list_transform(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+'), lambda r: translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))) w from documents),
seen as (select id, w, count(*) n, hex(id || ':' || w) x from run where length(w) >= 7 group by 1, 2),
hashed as (select w, n, xor(list_reduce(list_transform(range(0, len(x) // 2), lambda i: ('0x' || x[2 * i + 1:2 * i + 2])::bigint), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::bigint), 4294967295) h from seen, tab),
words as (select case when h % 31 = 0 then left(w, h % length(w)) || substr(w, h % length(w) + 2) else w end word, sum(n)::bigint n from hashed group by 1 having length(word) >= 7 and sum(n) >= 2),
spot as (select word, unnest(range(1, length(word) + 1)) i from words),
masked as (select word, i || ':' || left(word, i - 1) || '*' || substr(word, i + 1) k from spot),
shorter as (select distinct word, left(word, i - 1) || substr(word, i + 1) k from spot),
pair as (select x.word a, y.word b from masked x join masked y on x.k = y.k and x.word <> y.word union all select s.word, w.word from shorter s join words w on w.word = s.k union all select w.word, s.word from shorter s join words w on w.word = s.k),
best as (select a, b, w.n, count(*) over (partition by a) n_near, row_number() over (partition by a order by w.n desc, b) r from pair join words w on w.word = b),
formed as (select w.word, w.n, coalesce(n_near, 0) n_near, case when best.n >= 10 * w.n then b end form, case when best.n >= 10 * w.n then best.n end form_n from words w left join best on a = word and r = 1),
chain as (select word, word root from formed union all select c.word, f.form from chain c join formed f on f.word = c.root where f.form is not null),
ended as (select c.word, root from chain c join formed f on f.word = root where f.form is null)
select word, form, root, n, n_near, form_n from formed join ended using (word)"""

ORACLES = {"op9_pivot_index": NEAR_VECTORS, "op10_circulant_minhash": NEAR_DOCUMENTS, "op12_change_points": CHANGE_POINTS, "op13_errata_variants": VARIANTS}
