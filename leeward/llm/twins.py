r"""SQL that an independent engine answers the exact operators with: the same results from plain joins, windows spelled out as text."""

_WORDS = r"list_filter(regexp_split_to_array({text}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

WORD_WINDOWS = f"""with w as (select doc_id, {_WORDS.format(text="coalesce(text, '')")} as words from documents),
    windows as (select doc_id, i, md5(array_to_string(words[i : i + 49], ' ')) as k
      from (select doc_id, words, unnest(range(1, len(words) - 48)) as i from w where len(words) >= 50)),
    firsts as (select k, min(doc_id) as least from windows group by 1),
    gone as (select distinct doc_id, unnest(range(i, i + 50)) as p
      from (select v.doc_id, v.i from windows v join firsts f on f.k = v.k where v.doc_id > f.least)),
    places as (select doc_id, unnest(range(1, len(words) + 1)) as p, unnest(words) as word from w),
    told as (select a.doc_id, count(*) as n_words, count(g.p) as n_removed,
        string_agg(case when g.p is null then word end, ' ' order by a.p) as kept
      from places a left join gone g on g.doc_id = a.doc_id and g.p = a.p group by 1)
    select w.doc_id, coalesce(n_words, 0) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
    from w left join told t on t.doc_id = w.doc_id"""

JACCARD_GROUPS = f"""with recursive w as (select doc_id, {_WORDS.format(text=_LOWER)} as words from documents),
    shingles as (select distinct doc_id, s from (
      select doc_id, array_to_string(words[i : i + 2], ' ') as s
        from (select doc_id, words, unnest(range(1, len(words) - 1)) as i from w where len(words) >= 3)
      union all select doc_id, array_to_string(words, ' ') from w where len(words) between 1 and 2)),
    sizes as (select doc_id, count(*) as n from shingles group by 1),
    pairs as (select a.doc_id as x, b.doc_id as y, count(*) as c from shingles a join shingles b on b.s = a.s and b.doc_id > a.doc_id group by 1, 2),
    links as (select x, y from pairs join sizes a on a.doc_id = x join sizes b on b.doc_id = y where 100 * c >= 90 * (a.n + b.n - c)),
    ties as (select x, y from links union all select y, x from links),
    reach as (select x, y from ties union select r.x, e.y from reach r join ties e on e.x = r.y)
    select w.doc_id, coalesce(s.n, 0) as n_shingles, least(w.doc_id, coalesce(m.y, w.doc_id)) as component_id
    from w left join sizes s on s.doc_id = w.doc_id left join (select x, min(y) as y from reach group by 1) m on m.x = w.doc_id"""

BYTE_STRINGS = """with b as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
    strings as (select doc_id, i, md5(substr(h, 2 * i + 1, 200)) as k
      from (select doc_id, h, unnest(range(0, length(h) // 2 - 99)) as i from b where length(h) >= 200)),
    lost as (select doc_id, i from (select *, row_number() over (partition by k order by doc_id, i) as r from strings) where r > 1),
    edges as (select doc_id, i, i + 100 as e, max(i + 100) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding) as before from lost),
    runs as (select doc_id, i, e, sum(case when before is null or i > before then 1 else 0 end) over (partition by doc_id order by i) as run from edges),
    spans as (select doc_id, run, min(i) as s, max(e) as e from runs group by 1, 2),
    next as (select doc_id, s, e, coalesce(lead(s) over (partition by doc_id order by s), 1000000000) as s2 from spans),
    told as (select n.doc_id, count(*) as n_spans, sum(n.e - n.s) as n_removed, min(n.s) as s0,
        string_agg(substr(b.h, 2 * n.e + 1, 2 * (n.s2 - n.e)), '' order by n.s) as rest
      from next n join b on b.doc_id = n.doc_id group by 1)
    select b.doc_id, length(b.h) // 2 as n_bytes, coalesce(cast(n_removed as bigint), 0) as n_removed, coalesce(n_spans, 0) as n_spans,
      sha256(unhex(case when n_spans is null then b.h else concat(substr(b.h, 1, 2 * s0), rest) end)) as kept_sha256
    from b left join told t on t.doc_id = b.doc_id"""

HARD_NEGATIVES = """with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
        list_transform(embedding, lambda x: floor(256 * cast(x as double))) as q
      from embeddings where vec_id is not null and label is not null and embedding is not null
        and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
    scores as (select a.vec_id as anchor_id, a.label as own, b.vec_id, b.label, cast(list_inner_product(a.q, b.q) as bigint) as score
      from v a join v b on b.vec_id <> a.vec_id and a.vec_id % 50 = 0),
    positives as (select anchor_id, vec_id as positive_id, score as positive_score from scores where own = label
      qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
    select anchor_id, positive_id, cast(row_number() over w as integer) as rank, vec_id as negative_id, positive_score, score as negative_score
    from positives join scores s using (anchor_id)
    where own <> label and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score
    window w as (partition by anchor_id, positive_id order by score desc, vec_id)
    qualify row_number() over w <= 3"""

_FIELD = "coalesce(strlen(cast({0} as varchar)) || ':' || cast({0} as varchar), '-')"
_LEAF = "sha256(concat(" + ", ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", "{text}")) + "))"
_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
# CRC-32 of a short string: every character is mixed in (256 and more), then eight shifts follow.
_CRC = """xor(list_reduce(list_concat([4294967295], flatten([[256 + ascii(c), 0, 0, 0, 0, 0, 0, 0, 0] for c in string_split({0}, '')])),
      lambda a, x: case when x >= 256 then xor(a, x - 256) when a % 2 = 1 then xor(a >> 1, 3988292384) else a >> 1 end), 4294967295)"""

MERKLE_LEAVES = f"""with recursive leaves as (select doc_id, coalesce('=' || lang, '') as grp, {_LEAF.format(text="text")} as leaf,
        case when {_CRC.format("cast(doc_id as varchar)")} % 3 = 0 then {_LEAF.format(text=_LOWERED)} end as changed from documents),
    slots as (select *, row_number() over (partition by grp order by doc_id nulls first, leaf) - 1 as slot from leaves),
    low as (select grp, 0 as level, slot, leaf as h, count(*) over (partition by grp) as n from slots
      union all select grp, level + 1, slot // 8, sha256(string_agg(h, '' order by slot)), (any_value(n) + 7) // 8 from low where n > 1 group by grp, level, slot // 8),
    subs as (select grp, h as subroot, row_number() over (order by grp) - 1 as slot from low where n = 1),
    high as (select 0 as level, slot, subroot as h, count(*) over () as n from subs
      union all select level + 1, slot // 8, sha256(string_agg(h, '' order by slot)), (any_value(n) + 7) // 8 from high where n > 1 group by level, slot // 8),
    top as (select h as root from high where n = 1),
    steps as (select s.doc_id, s.slot as leaf_slot, s.grp, l.level, string_agg(o.h, '' order by o.slot) filter (o.slot < l.slot) as before,
        string_agg(o.h, '' order by o.slot) filter (o.slot > l.slot) as after
      from slots s join low l on l.grp = s.grp and l.n > 1 and l.slot = s.slot // cast(power(8, l.level) as bigint)
        join low o on o.grp = l.grp and o.level = l.level and o.slot // 8 = l.slot // 8 group by all),
    steps_high as (select s.grp, l.level, string_agg(o.h, '' order by o.slot) filter (o.slot < l.slot) as before,
        string_agg(o.h, '' order by o.slot) filter (o.slot > l.slot) as after
      from subs s join high l on l.n > 1 and l.slot = s.slot // cast(power(8, l.level) as bigint)
        join high o on o.level = l.level and o.slot // 8 = l.slot // 8 group by all),
    way as (select grp, leaf_slot, level, coalesce(before, '') as before, coalesce(after, '') as after from steps
      union all select s.grp, s.slot, 1000 + level, coalesce(before, ''), coalesce(after, '') from slots s join steps_high h on h.grp = s.grp),
    numbered as (select *, row_number() over (partition by grp, leaf_slot order by level) as step from way),
    folds as (select grp, slot, 0 as step, coalesce(changed, leaf) as h from slots
      union all select f.grp, f.slot, f.step + 1, sha256(concat(before, h, after)) from folds f join numbered w on w.grp = f.grp and w.leaf_slot = f.slot and w.step = f.step + 1),
    folded as (select grp, slot, arg_max(h, step) as folded_root from folds group by 1, 2),
    proofs as (select grp, leaf_slot, sha256(string_agg(before || after, '' order by step)) as proof_sha256 from numbered group by 1, 2)
    select s.doc_id, s.leaf, b.subroot, t.root, coalesce(p.proof_sha256, sha256('')) as proof_sha256, f.folded_root, f.folded_root = t.root as verified
    from slots s join subs b on b.grp = s.grp cross join top t join folded f on f.grp = s.grp and f.slot = s.slot
      left join proofs p on p.grp = s.grp and p.leaf_slot = s.slot"""
