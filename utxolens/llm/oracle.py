"""DuckDB SQL of the training-data queries that SQL can express."""

from __future__ import annotations

from .licences import COVER, K, PHRASES, SLACK, STRETCH, TEMPLATES
from .phrases import FACTOR, INSIDE, LEAST, LONGEST, TOP
from .queries import SHARDS
from .sharding import DIGITS


def op2_sharding() -> str:
    # the largest score is the largest hash, as the weights are equal
    def best(n: int) -> str:
        digest = (f"('0x' || substr(md5(s || ':' || coalesce(doc_id::varchar, '')), 1, {DIGITS}))::bigint")
        return f"list_sort(list_transform(range({n}), lambda s: [{digest}, -s]), 'desc')[1]"

    return f"""
with recursive tab0(i, c, k) as (
    select i, i::ubigint, 0 from range(256) t(i)
    union all
    select i, case when c & 1 = 1 then xor(c >> 1, 3988292384::ubigint) else c >> 1 end, k + 1
    from tab0 where k < 8),
tab as (select list(c order by i) as l from tab0 where k = 8),
bytes as (select doc_id, encode(coalesce(text, '')) as b, hex(encode(coalesce(text, ''))) as h, l
          from documents, tab),
crc as (select doc_id, octet_length(b) as n,
        list_reduce(list_prepend(4294967295::ubigint, list_transform(range(octet_length(b)),
            lambda i: ('0x' || substr(h, 2 * i + 1, 2))::ubigint)),
            lambda a, x: xor(a >> 8, l[xor(a & 255, x)::bigint + 1])) as c
        from bytes),
rows_ as (select doc_id, (n + 16)::bigint as size, xor(c, 4294967295::ubigint)::bigint as text_crc32,
          -{best(SHARDS)}[2] as shard, -{best(SHARDS + 1)}[2] as grown_shard from crc)
select doc_id, size, text_crc32, 'key' as law, shard::int as shard,
       row_number() over (partition by shard order by doc_id, text_crc32, size) - 1 as slot,
       grown_shard::int as grown_shard
from rows_"""


def op10_licences() -> str:
    runs = ", ".join(
        f"({t}, '{label}', {len(ws)}, {q}, '{' '.join(ws[q:q + K])}')"
        for t, (label, text) in enumerate(TEMPLATES) for ws in [text.split()]
        for q in range(len(ws) - K + 1))
    phrases = ", ".join(f"('{n}', '{p}', {len(p.split())})" for n, p in PHRASES.items())
    return rf"""
with tmpl(tid, label, size, q, run) as (values {runs}),
phrase(label, phrase, k) as (values {phrases}),
w as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from documents),
places as (select doc_id, w, unnest(range(len(w))) as p from w),
base as (select doc_id, label, p from places, phrase
         where array_to_string(w[p + 1 : p + k], ' ') = phrase),
bases as (select doc_id, count(*) as n_base, min(p) as first_word, max(p) as last_word,
          list(distinct label) as own from base group by doc_id),
hit as (select doc_id, tid, label, size, p, q, p - q as d from places
        join tmpl on array_to_string(w[p + 1 : p + {K}], ' ') = run where p + {K} <= len(w)),
diag as (select *, case when d - lag(d) over (partition by doc_id, tid order by d) <= {SLACK}
                   then 0 else 1 end as new
         from (select distinct doc_id, tid, d from hit)),
runs as (select *, sum(new) over (partition by doc_id, tid order by d) as run_no from diag),
span as (select doc_id, tid, label, size, run_no, min(p) as s, max(p) + {K} as e,
         len(list_distinct(flatten(list(range(q, q + {K}))))) / size as share
         from hit join runs using (doc_id, tid, d)
         group by doc_id, tid, label, size, run_no),
good as (select doc_id, list(distinct label) as found, max(round(share, 6)) as best from span
         where share >= {COVER} and e - s <= {STRETCH} * size + {SLACK} group by doc_id)
select w.doc_id, len(w.w)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base,
       first_word::bigint as first_word, last_word::bigint as last_word,
       coalesce(array_to_string(list_sort(own), ','), '') as base_labels,
       coalesce(array_to_string(list_sort(list_distinct(
           list_concat(coalesce(own, []), coalesce(found, [])))), ','), '') as labels,
       greatest(case when n_base > 0 then 1.0 else 0.0 end, least(coalesce(best, 0.0), 1.0))::double as score
from w left join bases using (doc_id) left join good using (doc_id)"""


def op12_phrases() -> str:
    grams = " union all ".join(
        f"select lang, unnest(list_transform(range(1, len(w) - {n - 2}), lambda i: w[i : i + {n - 1}])) as ws from seq"
        for n in range(2, LONGEST + 1))
    return rf"""
with pieces as (select coalesce(lang, 'und') as lang,
        unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-]')) as piece from documents),
seq as (select lang, list_filter(regexp_split_to_array(piece, '[ 	]+'), lambda x: x <> '') as w
        from pieces),
uni as (select lang, [w] as ws, count(*) as f from (select lang, unnest(w) as w from seq) group by all),
total as (select lang, sum(f)::bigint as n from uni group by lang),
cand as (select lang, ws, count(*) as f from ({grams}) group by all having count(*) >= {LEAST}),
part as (select * from uni where f >= {LEAST} union all select * from cand),
cut as (select lang, ws, f, unnest(range(1, len(ws))) as k from cand),
scored as (select cut.lang, cut.ws, cut.f as a, k, l.f as l, r.f as r,
        ({FACTOR}::hugeint * cut.f) // (l.f + r.f) as score
        from cut join part l on l.lang = cut.lang and l.ws = cut.ws[1:k]
        join part r on r.lang = cut.lang and r.ws = cut.ws[k+1:len(cut.ws)]),
low as (select * from scored
        qualify row_number() over (partition by lang, ws order by score, k) = 1),
inner_ as (select lang, ws as big, f, unnest(range(2, len(ws))) as size from cand),
sub as (select lang, f, big[s : s + size - 1] as ws from
        (select *, unnest(range(1, len(big) - size + 2)) as s from inner_)),
top as (select lang, ws, max(f) as longer from sub group by all),
kept as (select low.* from low left join top using (lang, ws)
         where longer is null or 100::hugeint * longer < {INSIDE}::hugeint * a),
named as (select *, array_to_string(ws, ' ') as phrase from kept),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank
           from named)
select lang, rank::bigint as rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n,
       score::bigint as score
from ranked join total using (lang) where rank <= {TOP}"""


def oracle_sql() -> dict[str, str]:
    return {"op2_sharding": op2_sharding(), "op10_licences": op10_licences(),
            "op12_phrases": op12_phrases()}
