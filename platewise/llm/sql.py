"""SQL that defines the results of those operators that SQL can state, for the oracle engine."""

from __future__ import annotations

from platewise.llm.quality import STOP_WORDS


def _field(name: str) -> str:
    return (f"case when {name} is null then '-' else cast(octet_length(encode(cast({name} as varchar))) as varchar) || ':' || "
            f"cast({name} as varchar) end")


#: CRC-32 of a decimal number's text, bit by bit.
_CRC = ("xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(cast(doc_id as varchar), ''), "
        "lambda c: ascii(c)::bigint)), lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], "
        "lambda x, z: xor(x >> 1, 3988292384::bigint * (x & 1)))), 4294967295::bigint)")

_HEAD = " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars"))

MERKLE = f"""with recursive d as (
  select doc_id, source, {_HEAD} as head, text,
         case when {_CRC} % 2 = 0 then replace(text, chr(10), '') else text end as cut from documents),
l as (select doc_id, source, sha256(head || {_field('text')}) as leaf, sha256(head || {_field('cut')}) as tampered,
        dense_rank() over (order by source nulls first) as g from d),
r as (select *, row_number() over (partition by g order by doc_id) - 1 as i, count(*) over (partition by g) as n from l),
nodes as (select 0 as lvl, g, i, n, leaf as h from r
  union all select lvl + 1, g, i // 3, (n + 2) // 3, sha256(string_agg(h, '' order by i)) from nodes where n > 1 group by lvl, g, n, i // 3),
top as (select 0 as lvl, g - 1 as i, (select max(g) from r) as n, h from nodes where n = 1
  union all select lvl + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' order by i)) from top where n > 1 group by lvl, n, i // 3),
steps as (select 0 as part, lvl, g, i, n, coalesce(string_agg(h, '') over (w rows between unbounded preceding and 1 preceding), '') as before,
    coalesce(string_agg(h, '') over (w rows between 1 following and unbounded following), '') as after
  from nodes window w as (partition by lvl, g, i // 3 order by i)
  union all select 1, lvl, 0, i, n, coalesce(string_agg(h, '') over (w rows between unbounded preceding and 1 preceding), ''),
    coalesce(string_agg(h, '') over (w rows between 1 following and unbounded following), '')
  from top window w as (partition by lvl, i // 3 order by i)),
walk as (select doc_id, g, 0 as part, 0 as lvl, i, tampered as x, '' as proof from r
  union all
  select w.doc_id, w.g, case when s.n = 1 then 1 else w.part end, case when s.n = 1 then 0 else w.lvl + 1 end,
    case when s.n = 1 then w.g - 1 else w.i // 3 end, case when s.n = 1 then w.x else sha256(s.before || w.x || s.after) end,
    case when s.n = 1 then w.proof else w.proof || s.before || s.after end
  from walk w join steps s on s.part = w.part and s.lvl = w.lvl and s.i = w.i and s.g = case when w.part = 0 then w.g else 0 end
  where w.part = 0 or s.n > 1),
ends as (select w.doc_id, w.x, w.proof from walk w join top t on w.part = 1 and t.lvl = w.lvl and t.i = w.i and t.n = 1)
select r.doc_id, r.leaf, sub.h as subroot, root.h as root, sha256(e.proof) as proof_sha256, e.x as folded_root, e.x = root.h as verified,
  r.source, r.i as leaf_rank, cast(length(e.proof) // 64 as bigint) as siblings
from r join (select g, h from nodes where n = 1) sub on sub.g = r.g cross join (select h from top where n = 1) root
join ends e on e.doc_id = r.doc_id"""

_TERMS = (r"unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))")

LEXICAL = f"""with it as (select item_id, term, count(*) as times from (select item_id, {_TERMS} as term from benchmark) group by all),
tf as (select doc_id, term, count(*) as tf from (select doc_id, {_TERMS} as term from documents) group by all),
len as (select doc_id, cast(sum(tf) as bigint) as n from tf group by doc_id),
every as (select count(*) as nd, cast(sum(n) as bigint) as nl from len),
w as (select term, cast(floor(1000 * ln((2 * nd + 2)::double / (2 * count(*) + 1))) as bigint) as w from tf, every group by term, nd),
scored as (
  select item_id, tf.doc_id,
         cast(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * nd) // nl)))) as bigint) as score
  from it join tf using (term) join w using (term) join len on len.doc_id = tf.doc_id, every group by item_id, tf.doc_id)
select item_id, cast(rank as integer) as rank, doc_id, score from (
  select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from scored where score > 0) where rank <= 20"""

_STOP = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))

QUALITY = rf"""with t as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
w as (select r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as ws,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from t),
g as (select r, unnest(list_transform(range(1, len(ws) - 1), lambda i: [ws[i], ws[i + 1], ws[i + 2]])) as g,
        unnest(range(1, len(ws) - 1)) as i from w where len(ws) > 2),
again as (select r, i from (select r, i, count(*) over (partition by r, g) as times from g) where times > 1),
c as (select r, count(distinct i + k) as n from again, (values (0), (1), (2)) as o(k) group by r),
m as (select doc_id, cast(len(ws) as bigint) as n_words, cast(length(array_to_string(ws, '')) as bigint) as word_chars,
        cast(len(list_filter(ws, lambda x: x in ({_STOP}))) as bigint) as n_stop, coalesce(c.n, 0) as n_repeat_words,
        cast(len(ls) as bigint) as n_lines, cast(len(ls) - len(list_distinct(ls)) as bigint) as n_dup_lines,
        cast(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols
  from w left join c on c.r = w.r),
f as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from m)
select *, case when base_failed then false else
    word_chars / n_words::double between 2.0::double and 12.0::double and n_symbols / n_words::double <= 0.1::double
    and n_stop / n_words::double >= 0.03::double and n_dup_lines / greatest(n_lines, 1)::double <= 0.4::double
    and n_repeat_words / n_words::double <= 0.5::double end as kept
from f"""

ORACLES = {"op9_quality_rules": QUALITY, "op12_lexical_search": LEXICAL, "op13_merkle_manifest": MERKLE}
