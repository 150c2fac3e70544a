"""DuckDB SQL that states the queries' results independently, where SQL can."""

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2 = r"""
with turns as (
  select conv_id, turn, coalesce(role, '') role, coalesce(text, '') text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized as (
  select *, len(role) + len(text) + len('<|im_start|><|im_end|>') + 2
    + len(regexp_extract_all(text, '[<\[]\\*(\|im_start\|>|\|im_end\|>|\|endoftext\|>|\|system\|>|\|user\|>|\|assistant\|>|s>|/s>|<SYS>>|</SYS>>|INST\]|/INST\])')) n
  from turns
)
select conv_id, count(*) n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn)) turns_sha256,
  cast(coalesce(sum(len(text)) filter (role = 'assistant'), 0) as bigint) loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn) filter (role = 'assistant'), '')) loss_sha256,
  cast(sum(n) as bigint) formatted_chars
from sized group by conv_id
"""

OP5 = rf"""
with recursive words as (
  select doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') w from documents
), sets as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end s from words
), items as (select doc_id, unnest(s) g from sets
), pairs as (
  select a.doc_id x, b.doc_id y, count(*) n from items a join items b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2
), link as (
  select x, y from pairs join sets p on p.doc_id = x join sets q on q.doc_id = y
  where 100 * n >= 85 * (len(p.s) + len(q.s) - n)
), reach as (select doc_id x, doc_id y from sets union select reach.x, link.y from reach join link on link.x = reach.y
), least as (select x doc_id, min(y) component_id from reach group by 1)
select doc_id, cast(len(s) as bigint) n_shingles, component_id, doc_id = component_id kept from sets join least using (doc_id)
"""

OP6 = """
with recursive raw as (select vec_id, cast(embedding as double[]) v from embeddings
), ok as (
  select vec_id, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) u from raw
  where v is not null and len(v) > 0 and len(list_filter(v, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(v, lambda x: x <> 0)) > 0
), link as (
  select a.vec_id x, b.vec_id y from ok a join ok b on a.vec_id <> b.vec_id and len(a.u) = len(b.u) and list_dot_product(a.u, b.u) >= 0.95
), reach as (select vec_id x, vec_id y from raw union select reach.x, link.y from reach join link on link.x = reach.y
), least as (select x vec_id, min(y) component_id from reach group by 1
), counts as (select x vec_id, count(*) n from link group by 1)
select vec_id, coalesce(n, 0) n_links, component_id, vec_id = component_id kept from least left join counts using (vec_id)
"""

OP7 = rf"""
with docs as (
  select doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents
), items as (
  select item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark
), places as (select item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) i from items where len(w) > 0
), wins as (select distinct item_id, least(len(w), 13) n, array_to_string(w[i:i + 12], ' ') g from places
), lens as (select distinct n from wins
), grams as (select doc_id, n, w, unnest(range(1, len(w) - n + 2)) i from docs, lens where len(w) >= n
), hit as (select doc_id, i, grams.n, item_id from grams join wins on grams.n = wins.n and array_to_string(w[i:i + grams.n - 1], ' ') = g
), covered as (select doc_id, count(distinct k) n_hit from (select doc_id, unnest(range(i, i + n)) k from hit) group by 1
), owners as (select doc_id, count(*) n_items, string_agg(s, ',' order by s) items from (select distinct doc_id, cast(item_id as varchar) s from hit) group by 1)
select doc_id, cast(len(w) as bigint) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(items, '')) items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) contaminated
from docs left join covered using (doc_id) left join owners using (doc_id)
"""

ORACLES = {
    "op2_chat_format": OP2,
    "op5_minhash_dedup": OP5,
    "op6_embedding_dedup": OP6,
    "op7_decontamination": OP7,
}
