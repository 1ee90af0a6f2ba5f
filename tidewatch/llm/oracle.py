"""DuckDB SQL of the registered queries that SQL can express."""

from __future__ import annotations

#: The words of a text, as the operators cut them: only A-Z is lower-cased.
_WORDS = """regexp_extract_all(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"""

def _crc_table() -> list[int]:
    """crc32 of single bytes, from its rule: shift right, on a set bit exclusive or with the polynomial."""
    table = list(range(256))
    for _ in range(8):
        table = [v >> 1 ^ (0xEDB88320 if v & 1 else 0) for v in table]
    return table


def _clustering(k: int = 40, rounds: int = 5, dim: int = 64) -> str:
    """Plain rounds of assignment and update, unrolled."""
    parts = [f"""kept as materialized (
  select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v from embeddings
  where len(embedding) = {dim} and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)""",
             f"""c0 as materialized (
  select row_number() over (order by sha256('2:' || vec_id), v) - 1 as c, v from kept order by 1 limit {k})"""]
    for n in range(rounds + 1):
        parts.append(f"""a{n} as materialized (
  select r, min({{'d': list_inner_product(k.v, k.v) - 2 * list_inner_product(k.v, c.v) + list_inner_product(c.v, c.v), 'c': c}}) as best
  from kept k cross join c{n} c group by r)""")
        if n < rounds:
            parts.append(f"""m{n} as materialized (
  select c, i, floor(sum(x) / count(*)) as x from (
    select best.c as c, unnest(v) as x, generate_subscripts(v, 1) as i from a{n} join kept using (r)) group by c, i)""")
            parts.append(f"""c{n + 1} as materialized (
  select c0.c, coalesce(m.v, c0.v) as v from c{n} c0 left join (select c, list(x order by i) as v from m{n} group by c) m using (c))""")
    return "with " + ",\n".join(parts) + f"""
select vec_id, cast(best.c as integer) as cluster, cast(best.d as bigint) as distance,
  cast(sum(best.d) over (partition by best.c) as bigint) as cluster_inertia, cast(sum(best.d) over () as bigint) as inertia,
  sha256(array_to_string(list_transform(c.v, lambda x: cast(cast(x as bigint) as varchar)), ',')) as centroid_sha256
from a{rounds} join kept using (r) join c{rounds} c on c.c = best.c"""


ORACLE: dict[str, str] = {
    "op13_centroid_clustering": _clustering(),
    "op11_conversation_prefix_trie": r"""
with turns as (
  select conv_id, row_number() over (partition by conv_id order by turn nulls first, key) - 1 as pos, key, words from (
    select conv_id, turn, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || ':' || coalesce(text, '')) as key,
      len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as words from conversations where conv_id is not null)),
convs as (select conv_id, count(*) as n from turns group by conv_id),
hs as (
  select conv_id, (4294967295 - list_reduce(list_prepend(cast(4294967295 as bigint),
    list_transform(string_split(cast(conv_id as varchar), ''), lambda ch: cast(ascii(ch) as bigint))),
    lambda acc, byte: xor(acc // 256, CRC_TABLE[xor(acc, byte) % 256 + 1]))) % 4 as h from convs),
rebuilt as (
  select c.conv_id, t.pos + 1 as depth, t.key, t.words from convs c join hs using (conv_id)
    join turns t on t.conv_id = c.conv_id - c.conv_id % 20 and t.pos < h
  union all
  select t.conv_id, t.pos - h + least(h, coalesce(b.n, 0)) + 1, t.key, t.words from turns t join hs using (conv_id)
    left join convs b on b.conv_id = t.conv_id - t.conv_id % 20 where t.pos >= h),
paths as (
  select conv_id, 0 as depth, '' as path, 0 as words from convs
  union all select conv_id, depth, string_agg(key, '') over (partition by conv_id order by depth), words from rebuilt),
ends as (select conv_id, max(depth) as depth, max_by(path, depth) as path from paths group by conv_id),
nodes as (select path, depth, min(conv_id) as conv_id, count(*) as n, any_value(words) as words from paths group by path, depth),
ended as (select path, string_agg(cast(conv_id as varchar), ',' order by conv_id) as ids from ends group by path),
kids as (select path[1:(depth - 1) * 32] as path, count(*) as n from nodes where depth > 0 group by 1),
above as (select n.path, n.depth, n.n, n.words, unnest(range(n.depth + 1)) as up from nodes n),
totals as (
  select a.path[1:up * 32] as path, count(*) filter (k.path is null) as leaves, sum((a.n - 1) * a.words) as saved
  from above a left join kids k on k.path = a.path group by 1)
select n.conv_id, cast(n.depth as bigint) as depth, p.conv_id as parent_conv_id, n.n as n_convs, coalesce(k.n, 0) as n_children,
  t.leaves as n_leaves, cast(t.saved as bigint) as saved_tokens, sha256(coalesce(e.ids, '')) as ends_sha256
from nodes n join totals t using (path) left join nodes p on n.depth > 0 and p.path = n.path[1:(n.depth - 1) * 32]
left join kids k on k.path = n.path left join ended e on e.path = n.path""".replace("CRC_TABLE", str(_crc_table())),
    "op1_exact_topk_search": """
with whole as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select a.vec_id as query_id, b.vec_id, cast(list_inner_product(a.v, b.v) as bigint) as score
  from whole a join whole b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id)
select query_id, cast(rank as integer) as rank, vec_id, score from (
  select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored)
where rank <= 5""",
    "op6_benchmark_decontamination": f"""
with docs as (select row_number() over () as r, doc_id, {_WORDS.format(text="coalesce(text, '')")} as w from documents),
items as (select cast(item_id as varchar) as item_id, {_WORDS.format(text="coalesce(text, '')")} as w from benchmark),
windows as (
  select item_id, w[s:s + least(len(w), 13) - 1] as p from (
    select item_id, w, unnest(generate_series(1, greatest(len(w) - 12, 1))) as s from items where len(w) > 0)),
sizes as (select distinct len(p) as size from windows),
spots as (
  select r, s, size, w[s:s + size - 1] as p from (
    select r, w, size, unnest(generate_series(1, len(w) - size + 1)) as s from docs, sizes where len(w) >= size)),
met as (select r, s, size, item_id from spots join windows using (p)),
hit as (select r, count(distinct i) as n from (select r, unnest(generate_series(s, s + size - 1)) as i from met) group by r),
named as (select r, count(*) as n, string_agg(item_id, ',' order by item_id collate "C") as ids
          from (select distinct r, item_id from met) group by r)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(hit.n, 0) as bigint) as n_hit,
  cast(coalesce(named.n, 0) as bigint) as n_items, sha256(coalesce(ids, '')) as items_sha256,
  coalesce(hit.n, 0) > 0 and 20 * coalesce(hit.n, 0) >= len(w) as contaminated
from docs left join hit using (r) left join named using (r)""",
    "op8_chat_format": r"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok'
  union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
sized as (
  select *, length(role) + length(text) + length('### : </turn>') + 1
    + length(text) - length(replace(replace(replace(text, '\', ''), '#', ''), '<', ''))
    + length(role) - length(replace(replace(replace(replace(role, '\', ''), '#', ''), '<', ''), ':', '')) as chars
  from turns)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  cast(sum(chars) as bigint) as formatted_chars
from sized group by conv_id""",
}
