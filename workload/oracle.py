"""The same results in plain SQL, written for checking and not for speed.

``base`` gives the graph, its patterns and parameters; ``clustered`` adds the
clusters of one method; ``merged`` adds types; each is a list of CTEs.
"""

from __future__ import annotations

from workload.graph import graph_ctes

SEED = 42
LOSS = 0.3
FS = "chr(30)"
IS = "chr(31)"


# The value grammar, written anew here so that a fault in the package's patterns shows.
DIGITS = "[0-9]+"
INTEGER_PATTERN = f"^([+]|-)?{DIGITS}$"
DECIMAL = f"({DIGITS}|{DIGITS}[.]|{DIGITS}[.]{DIGITS}|[.]{DIGITS})([eE]([+]|-)?{DIGITS})?"
HEXADECIMAL = (
    "0[xX]([0-9a-fA-F]+|[0-9a-fA-F]+[.]|[0-9a-fA-F]*[.][0-9a-fA-F]+)[pP]([+]|-)?[0-9]+"
)
DOUBLE_PATTERN = f"^([+]|-)?(NaN|Infinity|({DECIMAL}|{HEXADECIMAL})[fFdD]?)$"
LENIENT_DATE_PATTERN = "^(-[0-9]|[0-9])"
IP_PATTERN = "^([0-9]|[0-9][0-9]|[0-9][0-9][0-9])([.]([0-9]|[0-9][0-9]|[0-9][0-9][0-9])){3}$"


def c32(text: str) -> str:
    return f"(('0x' || substr(md5({text}), 1, 8))::BIGINT)"


def h01(text: str) -> str:
    return f"({c32(text)} / 4294967296::DOUBLE)"


def codes(label: str, dim: int) -> str:
    half = 1_000_000 // (2 * dim)
    parts = [f"{c32(f'''('{SEED}|{i}|' || {label})''')} % {2 * half + 1} - {half}" for i in range(dim)]
    return "[" + ", ".join(parts) + "]"


def base(loss: float, noise: float = 0.0) -> list[str]:
    """Graph and patterns; elements lose labels and properties at these rates."""
    label = f"case when {h01(f'''('{SEED}|' || node_id)''')} < {loss}::DOUBLE then '' else label end"

    def present(key: str) -> str:
        safe = f" and {h01(f"""('{SEED}|' || {key} || '|' || x)""")} >= {noise}::DOUBLE" if noise > 0 else ""
        return f"list_filter(names, lambda x, i: vals[i] is not null{safe})"

    return [
        graph_ctes(),
        f"""
nodes as (
  select *, array_to_string(pset, {IS}) as pkey from (
    select node_id, label as true_label, {label} as label, {present("node_id")} as pset from raw_nodes)),
edges as (
  select e.*, array_to_string(e.pset, {IS}) as pkey, s.label as src_key, d.label as dst_key,
         s.true_label as true_src, d.true_label as true_dst
  from (select edge_id, src_id, dst_id, edge_type, {present("edge_id")} as pset from raw_edges) e
  join nodes s on s.node_id = e.src_id join nodes d on d.node_id = e.dst_id),
np as (
  select md5(label || {FS} || pkey) as pattern_id, label as label_key, pkey,
         any_value(pset) as pset, count(*) as n
  from nodes group by label, pkey),
ep as (
  select md5(edge_type || {FS} || src_key || {FS} || dst_key || {FS} || pkey) as pattern_id,
         edge_type, src_key, dst_key, pkey, any_value(pset) as pset, count(*) as n
  from edges group by edge_type, src_key, dst_key, pkey)""",
    ]


def _all_codes(kind: str) -> str:
    if kind == "n":
        return codes("label_key", 5)
    return f"list_concat(list_concat({codes('edge_type', 10)}, {codes('src_key', 4)}), {codes('dst_key', 4)})"


def features() -> str:
    """Non-zero components of the feature vectors of both kinds of patterns."""
    parts = []
    for element, kind, dims in (("node", "n", 5), ("edge", "e", 18)):
        parts.append(
            f"""
select '{element}' as element, pattern_id, i as idx, c[i + 1]::DOUBLE / 1000000::DOUBLE as value
from (select pattern_id, {_all_codes(kind)} as c, unnest(range(0, {dims})) as i from {kind}p)
where c[i + 1] <> 0
union all
select '{element}', p.pattern_id, {dims} + v.rank, 1::DOUBLE
from (select pattern_id, unnest(pset) as name from {kind}p) p
join (select name, row_number() over (order by name) - 1 as rank
      from (select distinct unnest(pset) as name from {kind}p)) v on v.name = p.name"""
        )
    return " union all ".join(parts)


def moments(kind: str) -> str:
    """Moments of the distances of all pairs of elements of one kind, by pairs of patterns."""
    p = f"(select pset, n, {_all_codes(kind)} as codes from {kind}p)"
    return f"""
select sum(pairs)::DOUBLE as n_pairs,
  case when sum(pairs) > 0 then round(sum(pairs * square)::DOUBLE / sum(pairs)::DOUBLE, 6) end as mean_square,
  case when sum(pairs) > 0 then round(sqrt(sum(pairs * square)::DOUBLE / sum(pairs)::DOUBLE), 6) end as rms_distance
from (
  select a.n::DOUBLE * b.n::DOUBLE / 2 as pairs,
    list_sum(list_transform(range(1, len(a.codes) + 1),
      lambda i: (a.codes[i] - b.codes[i]) * (a.codes[i] - b.codes[i])))::DOUBLE / 1000000000000::DOUBLE
    + len(list_filter(a.pset, lambda x: not list_contains(b.pset, x)))
    + len(list_filter(b.pset, lambda x: not list_contains(a.pset, x))) as square
  from {p} a, {p} b where a.codes <> b.codes or a.pset <> b.pset)"""


def _stats(kind: str) -> str:
    """Distance sample of one kind of patterns; p is the CTE prefix."""
    p = f"{kind}p"
    code = _all_codes(kind)
    draw = f"""md5('{SEED}|' || pattern_id || '|' || copy::varchar)"""
    share = f"""least(10000 / (select sum(n) from {p})::DOUBLE, 1::DOUBLE)"""
    return f"""
{p}c as (select *, {code} as codes from {p}),
{kind}s as (
  select *, row_number() over (order by draw, pattern_id, copy) as rank, count(*) over () as m from (
    select *, {draw} as draw from (
      select pattern_id, pset, codes, unnest(range(1, copies + 1)) as copy from (
        select *, floor(n * {share} + {h01(f"('{SEED}|' || pattern_id)")})::BIGINT as copies
        from {p}c)))),
{kind}pairs as (
  select sqrt(list_sum(list_transform(range(1, len(a.codes) + 1),
           lambda i: (a.codes[i] - b.codes[i]) * (a.codes[i] - b.codes[i])))::DOUBLE
         / 1000000000000::DOUBLE
         + len(list_filter(a.pset, lambda x: not list_contains(b.pset, x)))
         + len(list_filter(b.pset, lambda x: not list_contains(a.pset, x)))) as d
  from {kind}s a join {kind}s b
    on b.rank > a.rank and b.rank <= a.rank + least(a.m - 1, ceil(10000 / a.m::DOUBLE))),
{kind}stats as (
  select count(*) as n_pairs, round(avg(d), 6) as avg_distance, round(min(d), 6) as min_distance,
         round(max(d), 6) as max_distance, round(stddev_samp(d), 6) as stddev_distance
  from {kind}pairs where d > 0)"""


def params() -> str:
    """nlsh, elsh, nmh, emh: one row each."""
    few = "case when n_labels <= 3 then {0}::DOUBLE when n_labels <= 10 then {1}::DOUBLE else {2}::DOUBLE end"
    return f"""{_stats("n")},{_stats("e")},
nsize as (select sum(n)::BIGINT as n, count(distinct label_key) as n_labels from np),
esize as (select sum(n)::BIGINT as n from ep),
nlsh as (
  select n, coalesce(case when b > 0 then round(b, 6) end, 0.2::DOUBLE) as bucket,
    greatest(15, floor(least(25, greatest(5, n // 30000)) * {few.format(1.5, 1.0, 0.8)}))::INTEGER as tables
  from (select *, avg_distance * 1.2::DOUBLE * {few.format(0.8, 1.0, 1.5)} as b from nsize, nstats)),
elsh as (
  select n, coalesce(case when b > 0 then round(b, 6) end, 0.2::DOUBLE) as bucket,
    least(20, greatest(3, n // 20000))::INTEGER as tables
  from (select *, avg_distance * 1.2::DOUBLE as b from esize, estats)),
nmh as (
  select n, greatest(25, floor(least(25, greatest(5, n // 3000)) * {few.format(2.0, 1.5, 1.0)}))::INTEGER as tables
  from nsize),
emh as (select n, least(20, greatest(3, n // 2000))::INTEGER as tables from esize)"""


def _lsh(kind: str) -> str:
    p, dims = f"{kind}p", 5 if kind == "n" else 18
    ce = c32(f"('{SEED}|E|' || t::varchar || '|' || i::varchar)") + " % 2001 - 1000"
    cp = c32(f"('{SEED}|P|' || t::varchar || '|' || x)") + " % 2001 - 1000"
    return f"""
{kind}t as (select unnest(range(0, (select tables from {kind}lsh))) as t),
{kind}names as (select distinct unnest(pset) as x from {p}),
{kind}width as (
  select t, greatest(1, round(sqrt((
      coalesce((select sum(({cp}) * ({cp})) from {kind}names), 0)
      + list_sum(list_transform(range(0, {dims}), lambda i: ({ce}) * ({ce}))))::DOUBLE)
    * ((select bucket from {kind}lsh) * 1000000::DOUBLE)))::BIGINT as width
  from {kind}t),
{kind}c as (
  select p.*, h.cluster_id from {p} p join (
    select pattern_id, md5(string_agg(b::varchar, ',' order by t)) as cluster_id from (
      select pattern_id, t, (
          list_sum(list_transform(range(0, {dims}), lambda i: codes[i + 1] * ({ce})))::BIGINT
          + coalesce(list_sum(list_transform(pset, lambda x: 1000000 * ({cp}))), 0)::BIGINT
          + (1000000000000000 // width + 1) * width) // width as b
      from {p}c, {kind}width)
    group by pattern_id) h on h.pattern_id = p.pattern_id)"""


def _minhash(kind: str) -> str:
    p, prime = f"{kind}p", 2**31 - 1
    props = "list_transform(pset, lambda x: 'P:' || x)"
    one = "case when {0} <> '' then ['{1}:' || {0}] else [] end"
    labels = (
        [one.format("label_key", "L")]
        if kind == "n"
        else ["['T:' || edge_type]", one.format("src_key", "S"), one.format("dst_key", "D")]
    )
    tokens = props
    for part in reversed(labels):
        tokens = f"list_concat({part}, {tokens})"
    a = c32(f"('{SEED}|a|' || t::varchar)") + f" % {prime - 1} + 1"
    b = c32(f"('{SEED}|b|' || t::varchar)") + f" % {prime}"
    return f"""
{kind}tok as (
  select pattern_id, list_transform({tokens}, lambda x: {c32('x')} % {prime}) as hs from {p}),
{kind}c as (
  select p.*, h.cluster_id from {p} p join (
    select pattern_id, md5(string_agg(b::varchar, ',' order by t)) as cluster_id from (
      select pattern_id, t,
        coalesce(list_min(list_transform(hs, lambda h: (h * ({a}) + ({b})) % {prime})), -1) as b
      from {kind}tok, (select unnest(range(0, (select tables from {kind}mh))) as t))
    group by pattern_id) h on h.pattern_id = p.pattern_id)"""


def _kmeans(kind: str, k: int = 10, rounds: int = 6) -> str:
    p, dims = f"{kind}p", 5 if kind == "n" else 18
    ctes = [
        f"""
{kind}kr as (
  select pattern_id, n, 'E|' || i::varchar as dim, codes[i + 1]::BIGINT as x
  from (select pattern_id, n, codes, unnest(range(0, {dims})) as i from {p}c)
  union all
  select pattern_id, n, 'P|' || name, 1000000 from (select pattern_id, n, unnest(pset) as name from {p})),
{kind}k0 as (
  select f.cluster, r.dim, r.x from {kind}kr r join (
    select pattern_id, row_number() over (order by md5('1|' || pattern_id), pattern_id) - 1 as cluster
    from {p}) f on f.pattern_id = r.pattern_id where f.cluster < {k})"""
    ]
    for r in range(rounds + 1):
        ctes.append(
            f"""
{kind}a{r} as (
  select pattern_id, n, cluster from (
    select p.pattern_id, p.n, s.cluster, row_number() over (
      partition by p.pattern_id order by s.square - 2 * coalesce(d.product, 0), s.cluster) as place
    from {p} p
      cross join (select cluster, sum(x * x)::BIGINT as square from {kind}k{r} group by cluster) s
      left join (
        select r.pattern_id, c.cluster, sum(r.x * c.x)::BIGINT as product
        from {kind}kr r join {kind}k{r} c on c.dim = r.dim group by r.pattern_id, c.cluster) d
      on d.pattern_id = p.pattern_id and d.cluster = s.cluster)
  where place = 1),
{kind}k{r + 1} as (
  select t.cluster, t.dim, (t.total + 2000000 * z.size) // z.size - 2000000 as x
  from (
    select a.cluster, r.dim, sum(r.n * r.x)::BIGINT as total
    from {kind}kr r join {kind}a{r} a on a.pattern_id = r.pattern_id group by a.cluster, r.dim) t
  join (select cluster, sum(n)::BIGINT as size from {kind}a{r} group by cluster) z on z.cluster = t.cluster
  where (t.total + 2000000 * z.size) // z.size - 2000000 <> 0)"""
        )
    ctes.append(
        f"""
{kind}c as (
  select p.*, 'cluster_' || a.cluster::varchar as cluster_id
  from {p} p join {kind}a{rounds} a on a.pattern_id = p.pattern_id)"""
    )
    return ",".join(ctes)


def clustered(loss: float, method: str, noise: float = 0.0) -> list[str]:
    """nc and ec: patterns with cluster_id."""
    make = {"lsh": _lsh, "minhash": _minhash, "kmeans": _kmeans}[method]
    return [*base(loss, noise), params(), make("n"), make("e")]


def merged(loss: float, method: str, noise: float = 0.0) -> list[str]:
    """ncl, labeled, absorbed, nmember, ntyped, ntypes; etyped/etypes by ends and by type."""
    absorbing = "false" if method == "kmeans" else "jaccard >= 0.9::DOUBLE"
    return [
        *clustered(loss, method, noise),
        f"""
ncl as (
  select cluster_id, list_sort(coalesce(list(distinct label_key) filter (label_key <> ''), [])) as labels
  from nc group by cluster_id),
labeled as (
  select cluster_id, labels, md5('N' || {FS} || array_to_string(labels, {IS})) as type_id
  from ncl where len(labels) > 0),
ltyped as (
  select c.pattern_id, c.label_key, c.pset, c.n, l.type_id, l.labels from nc c
  join labeled l on l.cluster_id = c.cluster_id),
lsets as (
  select type_id, any_value(labels) as labels, list_sort(list(distinct x)) as items
  from (select type_id, labels, unnest(pset) as x from ltyped) group by type_id),
usets as (
  select cluster_id, list_sort(list(distinct x)) as items from (
    select cluster_id, unnest(pset) as x from nc
    where cluster_id in (select cluster_id from ncl where len(labels) = 0))
  group by cluster_id),
jac as (
  select u.cluster_id, l.type_id, l.labels,
    len(list_intersect(u.items, l.items))::DOUBLE
      / (len(u.items) + len(l.items) - len(list_intersect(u.items, l.items))) as jaccard
  from usets u, lsets l),
absorbed as (
  select cluster_id, type_id, labels, jaccard from (
    select *, row_number() over (partition by cluster_id order by jaccard desc, labels) as r
    from jac where {absorbing}) where r = 1),
abstract as (
  select cluster_id, md5('U' || {FS} || cluster_id) as type_id, labels from ncl
  where len(labels) = 0 and cluster_id not in (select cluster_id from absorbed)),
nmember as (
  select cluster_id, type_id, labels from labeled
  union all select cluster_id, type_id, labels from absorbed
  union all select cluster_id, type_id, labels from abstract),
ntyped as (
  select c.pattern_id, c.pset, c.n, m.type_id, m.labels from nc c
  join nmember m on m.cluster_id = c.cluster_id),
ecl as (
  select cluster_id, list_sort(list(distinct edge_type)) as types,
    list_sort(coalesce(list(distinct src_key) filter (src_key <> ''), [])) as srcs,
    list_sort(coalesce(list(distinct dst_key) filter (dst_key <> ''), [])) as dsts
  from ec group by cluster_id),
etyped as (
  select c.*, l.types, md5('E' || {FS} || array_to_string(l.types, {IS}) || {FS}
    || array_to_string(l.srcs, {IS}) || {FS} || array_to_string(l.dsts, {IS})) as type_id
  from ec c join ecl l on l.cluster_id = c.cluster_id),
rtyped as (
  select c.*, l.types, md5('E' || {FS} || array_to_string(l.types, {IS})) as type_id
  from ec c join ecl l on l.cluster_id = c.cluster_id)""",
        *[_node_rows(t, s) for t, s in (("ltypes", "ltyped"), ("ntypes", "ntyped"))],
        *[_edge_rows(t, s) for t, s in (("etypes", "etyped"), ("rtypes", "rtyped"))],
    ]


def _props(typed: str) -> str:
    return f"""
    select c.type_id, list_sort(list({{'name': x, 'cnt': c.cnt, 'man': c.cnt = t.n}})) as props
    from (select type_id, x, sum(n)::BIGINT as cnt from (
            select type_id, n, unnest(pset) as x from {typed}) group by type_id, x) c
    join (select type_id, sum(n)::BIGINT as n from {typed} group by type_id) t
      on t.type_id = c.type_id
    group by c.type_id"""


def _node_rows(name: str, typed: str) -> str:
    return f"""
{name} as (
  select t.type_id, t.labels, t.n, coalesce(p.props, []) as props from (
    select type_id, any_value(labels) as labels, sum(n)::BIGINT as n from {typed}
    group by type_id) t
  left join ({_props(typed)}) p on p.type_id = t.type_id)"""


def _edge_rows(name: str, typed: str) -> str:
    return f"""
{name} as (
  select t.*, coalesce(p.props, []) as props from (
    select type_id, any_value(types) as types, sum(n)::BIGINT as n,
      list_sort(coalesce(list(distinct src_key) filter (src_key <> ''), [])) as srcs,
      list_sort(coalesce(list(distinct dst_key) filter (dst_key <> ''), [])) as dsts
    from {typed} group by type_id) t
  left join ({_props(typed)}) p on p.type_id = t.type_id)"""


PROPS_TEXT = (
    "array_to_string(list_transform(props, lambda p: p.name || ':' || p.cnt::varchar"
    " || case when p.man then ':m' else ':o' end), ',')"
)


def flags(value: str = "val") -> str:
    t = f"regexp_replace({value}, '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g')"
    return f"""
    regexp_matches({t}, '{INTEGER_PATTERN}') and try_cast({t} as integer) is not null as is_integer,
    regexp_matches({t}, '{DOUBLE_PATTERN}') as is_double,
    regexp_matches({t}, '{LENIENT_DATE_PATTERN}') as is_date,
    lower({t}) in ('true', 'false', 'yes', 'no', '1', '0') as is_boolean,
    case when regexp_matches({t}, '{IP_PATTERN}')
      then list_max(list_transform(string_split({t}, '.'), lambda p: p::integer)) <= 255
      else false end as is_ip"""


def typing(kind: str) -> str:
    """<kind>flags, <kind>full, <kind>sample counts; kind is node or edge."""
    count = (
        "count(*) as total, count(*) filter (is_integer) as int_cnt,"
        " count(*) filter (is_double) as dbl_cnt, count(*) filter (is_date) as date_cnt,"
        " count(*) filter (is_boolean) as bool_cnt, count(*) filter (is_ip) as ip_cnt"
    )
    order = c32("(id || '|' || name)")
    return f"""
{kind}flags as (
  select id, name, row_number() over (partition by name order by {order}, id) as r, {flags()}
  from {kind}_values),
{kind}full as (select name, {count} from {kind}flags group by name),
{kind}sample as (select name, {count} from {kind}flags where r <= 1000 group by name)"""


UNANIMOUS = """case when name = 'locationIP' or ip_cnt = total then 'String'
    when int_cnt = total then 'Integer' when dbl_cnt = total then 'Double'
    when date_cnt = total then 'Date' when bool_cnt = total then 'Boolean' else 'String' end"""
BEST = "greatest(int_cnt, dbl_cnt, date_cnt, bool_cnt)"
MAJORITY = f"""case when name = 'locationIP' or ip_cnt = total or {BEST} = 0 then 'String'
    when int_cnt = {BEST} then 'Integer' when dbl_cnt = {BEST} then 'Double'
    when date_cnt = {BEST} then 'Date' else 'Boolean' end"""
SUPPORT = f"""case when name = 'locationIP' or ip_cnt = total or {BEST} = 0 then 1::DOUBLE
    else {BEST}::DOUBLE / total end"""

CARD = """
pairs as (select distinct edge_type, src_id, dst_id from raw_edges),
card as (
  select o.edge_type, o.mx as max_dst_per_src, o.mn as min_dst_per_src, round(o.av, 6) as avg_dst_per_src,
    i.mx as max_src_per_dst, i.mn as min_src_per_dst, round(i.av, 6) as avg_src_per_dst,
    case when o.mx = 1 and i.mx = 1 then '1:1' when i.mx = 1 then '1:N'
      when o.mx = 1 then 'N:1' else 'N:N' end as cardinality
  from (select edge_type, max(c) as mx, min(c) as mn, avg(c) as av from (
          select edge_type, src_id, count(*) as c from pairs group by all) group by edge_type) o
  join (select edge_type, max(c) as mx, min(c) as mn, avg(c) as av from (
          select edge_type, dst_id, count(*) as c from pairs group by all) group by edge_type) i
    on i.edge_type = o.edge_type)"""


def evaluation() -> str:
    """neval and eeval: one row per element with prediction and truth."""
    return f"""
neval as (
  select n.node_id, t.type_id, t.labels as predicted, [n.true_label] as actual
  from nodes n join ntyped t on t.pattern_id = md5(n.label || {FS} || n.pkey)),
eeval as (
  select e.edge_id, t.type_id, r.types as ptypes, r.srcs as psrc, r.dsts as pdst, e.edge_type,
    case when e.src_key = '' then [] else [e.src_key] end as asrc,
    case when e.dst_key = '' then [] else [e.dst_key] end as adst
  from edges e join etyped t on t.pattern_id =
    md5(e.edge_type || {FS} || e.src_key || {FS} || e.dst_key || {FS} || e.pkey)
  join etypes r on r.type_id = t.type_id),
nmaj as (
  select type_id, l as majority from (
    select type_id, l, row_number() over (partition by type_id order by count(*) desc, l) as r
    from (select type_id, unnest(actual) as l from neval) group by type_id, l) where r = 1),
emaj as (
  select type_id, edge_type as majority from (
    select type_id, edge_type, row_number() over (partition by type_id order by count(*) desc, edge_type) as r
    from eeval group by type_id, edge_type) where r = 1)"""


def scores(rows: str) -> str:
    """Select with tp, fp, fn, precision, recall, f1 from (truth, hit) rows."""
    return f"""
select tp, fp, fn, round(p, 6) as precision, round(r, 6) as recall,
  round(case when p + r > 0 then 2 * p * r / (p + r) else 0 end, 6) as f1
from (select *, tp::DOUBLE / (tp + fp) as p, tp::DOUBLE / (tp + fn) as r from (
  select sum(tp)::BIGINT as tp, sum(fp)::BIGINT as fp, sum(greatest(n - tp, 0))::BIGINT as fn from (
    select truth, count(*) as n, count(*) filter (hit) as tp, count(*) filter (not hit) as fp
    from ({rows}) group by truth)))"""


def query(ctes: list[str], select: str, recursive: bool = False) -> str:
    return f"with {'recursive ' if recursive else ''}{','.join(ctes)}\n{select}"
