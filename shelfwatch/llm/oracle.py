"""DuckDB SQL for the corpus queries that SQL can express, written from the contracts."""

from __future__ import annotations

TOKENS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"

SOURCE_MIX = f"""
with sized as (
  select doc_id, source, {TOKENS} as size,
         substr(md5(coalesce(cast(doc_id as varchar), '') || ':' || coalesce(text, '')), 1, 15) as hash
  from documents
), sources as (
  select source, sum(size) as source_size,
         [3, 1, 2][1 + (row_number() over (order by source is null, source) - 1) % 3] as weight
  from sized group by source
), levels as (  -- the level at which source f is just full, and the words taken there
  select 2.0 * f.source_size / f.weight as level, sum(least(2.0 * s.source_size, s.weight * 2.0 * f.source_size / f.weight)) as filled
  from sources f, sources s group by f.source, f.source_size, f.weight
), budget as (select 1.5 * sum(source_size) as words from sources
), below as (select coalesce(max(level), 0) as level from levels, budget where filled <= words
), final as (
  select below.level + coalesce(
      (words - sum(least(2.0 * source_size, weight * below.level)))
      / nullif(sum(case when 2.0 * source_size / weight > below.level then weight end), 0), 0) as level
  from sources, below, budget group by below.level, words
), targets as (
  select source, source_size, least(2.0 * source_size, weight * level) as target,
         case when source_size > 0 then floor(least(2.0 * source_size, weight * level) / source_size) else 0 end as rounds
  from sources, final
), running as (
  select s.*, t.source_size, t.target, t.rounds, t.target - t.rounds * t.source_size as extra,
         sum(size) over (partition by s.source order by hash rows between unbounded preceding and current row) as upto
  from sized s join targets t on s.source is not distinct from t.source
)
select doc_id, size, cast(source_size as bigint) as source_size, target,
       cast(rounds * size + case when upto <= extra then size
                                 when upto - size <= extra and 2 * (extra - (upto - size)) >= size then size
                                 else 0 end as bigint) as taken
from running
"""

URL_FILTER = """
with rules(host, path, verdict) as (
  values ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
         ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), rests as (
  select row_number() over () as row, page_id,
         case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest
  from pages
), parts as (
  select row, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path
  from rests
)
select any_value(page_id) as page_id, any_value(p.host) as host, any_value(p.path) as path,
       arg_max(r.host || r.path, length(r.host || r.path)) as rule,
       coalesce(arg_max(r.verdict, length(r.host || r.path)), 'allow') as verdict
from parts p left join rules r
  on (p.host = r.host or ends_with(p.host, '.' || r.host)) and starts_with(p.path, r.path)
group by row
"""

DECONTAMINATION = r"""
with docs as (
  select row_number() over () as row, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words
  from documents
), items as (
  select cast(item_id as varchar) as item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words
  from benchmark
), windows as (
  select distinct item_id, least(13, len(words)) as size, array_to_string(words[i:i + 12], ' ') as gram
  from (select *, unnest(range(1, greatest(len(words) - 12, 1) + 1)) as i from items where len(words) > 0)
), sizes as (select distinct size from windows
), grams as (
  select row, i, size, array_to_string(words[i:i + size - 1], ' ') as gram
  from (select d.*, size, unnest(range(1, len(words) - size + 2)) as i from docs d, sizes where len(words) >= size)
), hits as (
  select row, i, w.size, item_id from grams g join windows w on g.size = w.size and g.gram = w.gram
), counted as (
  select row, count(distinct word) as n_hit
  from (select row, unnest(range(i, i + size)) as word from hits) group by row
), ids as (
  select row, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids
  from (select distinct row, item_id from hits) group by row
)
select doc_id, len(words) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * n_hit >= len(words) as contaminated
from docs left join counted using (row) left join ids using (row)
"""

# CRC-32 (polynomial EDB88320) by half bytes.
_CRC_TABLE = [0x00000000, 0x1DB71064, 0x3B6E20C8, 0x26D930AC, 0x76DC4190, 0x6B6B51F4, 0x4DB26158, 0x5005713C,
              0xEDB88320, 0xF00F9344, 0xD6D6A3E8, 0xCB61B38C, 0x9B64C2B0, 0x86D3D2D4, 0xA00AE278, 0xBDBDF21C]

BYTE_SHARDS = f"""
with docs as (
  select doc_id, hex(encode(coalesce(text, ''))) as bytes, md5(coalesce(text, '')) as digest from documents
), halves as (  -- of each byte the lower half first
  select *, len(bytes) // 2 + 8 as size,
         list_transform(range(len(bytes)), lambda i: strpos('0123456789ABCDEF', bytes[i + 2 - 2 * (i % 2)]) - 1) as nibbles
  from docs
), sums as (
  select doc_id, digest, size,
         xor(4294967295::bigint, list_reduce(list_prepend(4294967295::bigint, nibbles::bigint[]),
             lambda crc, n: xor(crc >> 4, ({_CRC_TABLE}::bigint[])[1 + (xor(crc, n) & 15)]))) as text_crc32
  from halves
), running as (
  select *, sum(size) over (order by doc_id nulls first, digest rows unbounded preceding) - size as before,
         sum(size) over () as total
  from sums
), placed as (
  select *, cast(least(24 * (2 * before + size) // (2 * total), 23) as integer) as shard from running
)
select doc_id, cast(size as bigint) as size, text_crc32, 'bytes' as law, shard,
       row_number() over (partition by shard order by doc_id nulls first, digest) - 1 as slot, cast(null as integer) as grown_shard
from placed
"""

# what pairs of ids (a, b) link, in either direction, to the smallest id that each id reaches
_REACH = """reach(id, other) as (
  select a, b from links union select r.id, l.b from reach r join links l on r.other = l.a
), lowest as (select id, min(least(id, other)) as low from reach group by id)"""

VECTOR_LINKS = f"""
with recursive usable as (
  select vec_id, label, embedding::double[] as v from embeddings
  where label is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0
), links as (
  select a.vec_id as a, b.vec_id as b from usable a join usable b
    on a.label = b.label and a.vec_id <> b.vec_id and len(a.v) = len(b.v)
  where list_cosine_similarity(a.v, b.v) >= 0.93
), {_REACH}
select vec_id, (select count(*) from links where a = vec_id) as n_links, coalesce(low, vec_id) as component_id,
       coalesce(low, vec_id) = vec_id as kept
from embeddings left join lowest on id = vec_id
"""

NGRAM_JOIN = r"""
with recursive docs as (
  select doc_id, coalesce(text, '') as text,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words
  from documents
), shingles as (
  select distinct doc_id, array_to_string(words[i:i + 4], ' ') as shingle
  from (select *, unnest(range(1, greatest(len(words) - 4, 1) + 1)) as i from docs where len(words) > 0)
), sizes as (select doc_id, count(*) as n from shingles group by doc_id
), shared as (
  select a.doc_id as a, b.doc_id as b, count(*) as n_shared
  from shingles a join shingles b on a.shingle = b.shingle and a.doc_id <> b.doc_id group by 1, 2
), links as (
  select a, b from shared join sizes x on x.doc_id = a join sizes y on y.doc_id = b where n_shared >= 0.8 * (x.n + y.n - n_shared)
  union all
  select x.doc_id, y.doc_id from docs x join docs y on x.text = y.text and x.doc_id <> y.doc_id
  where len(x.words) = 0
), """ + _REACH + """
select doc_id, coalesce(low, doc_id) as class_id, (select count(*) from links where a = doc_id) as n_links,
       coalesce(low, doc_id) = doc_id as kept
from docs left join lowest on id = doc_id
"""

REPEATED_PASSAGES = r"""
with docs as (
  select row_number() over () as row, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents
), windows as (
  select row, i, array_to_string(words[i:i + 34], ' ') as gram
  from (select *, unnest(range(1, len(words) - 33)) as i from docs where len(words) >= 35)
), repeated as (select gram from windows group by gram having count(*) > 1
), gone as (select distinct row, unnest(range(i, i + 35)) as i from windows semi join repeated using (gram)
), kept as (
  select row, count(*) as n_kept, string_agg(word, ' ' order by i) as kept
  from (select row, unnest(words) as word, unnest(range(1, len(words) + 1)) as i from docs) anti join gone using (row, i)
  group by row
)
select doc_id, cast(len(words) as bigint) as n_words, len(words) - coalesce(n_kept, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from docs left join kept using (row)
"""

PREFIX_TRIE = f"""
with originals as (
  select conv_id, turn, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) as digest,
         length(coalesce(text, '')) as tokens
  from conversations where conv_id is not null
), turns as (
  select *, row_number() over (partition by conv_id order by turn nulls first, digest) as place from originals
), convs as (
  select conv_id, conv_id - conv_id % 100 as source,
         xor(4294967295::bigint, list_reduce(list_prepend(4294967295::bigint, list_transform(range(len(hex(encode(conv_id::varchar)))),
             lambda i: strpos('0123456789ABCDEF', hex(encode(conv_id::varchar))[i + 2 - 2 * (i % 2)]) - 1)::bigint[]),
             lambda crc, n: xor(crc >> 4, ({_CRC_TABLE}::bigint[])[1 + (xor(crc, n) & 15)]))) % 6 as taken
  from (select distinct conv_id from turns)
), rebuilt as (
  select c.conv_id, place, digest, tokens from convs c join turns t on t.conv_id = c.source where place <= taken
  union all
  select conv_id, place, digest, tokens from convs join turns using (conv_id) where place > taken
), paths as (
  select conv_id, coalesce(string_agg(digest, '' order by place), '') as path, list(tokens order by place) filter (place is not null) as tokens
  from convs left join rebuilt using (conv_id) group by conv_id
), prefixes as (
  select conv_id, path, d, path[1:32 * d] as node, case when d > 0 then tokens[d] else 0 end as tokens
  from (select *, unnest(range(0, len(path) // 32 + 1)) as d from paths)
), nodes as (
  select node, d, min(conv_id) as conv_id, count(*) as n_convs, any_value(tokens) as tokens,
         sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (path = node), '')) as ends_sha256
  from prefixes group by node, d
), families as (
  select n.*, p.conv_id as parent_conv_id, (select count(*) from nodes c where c.d = n.d + 1 and starts_with(c.node, n.node)) as n_children
  from nodes n left join nodes p on n.d > 0 and p.node = n.node[1:32 * (n.d - 1)]
), subtrees as (
  select n.node, count(*) filter (b.n_children = 0) as n_leaves, sum((b.n_convs - 1) * b.tokens) as saved_tokens
  from families n join families b on starts_with(b.node, n.node) group by n.node
)
select conv_id, cast(d as bigint) as depth, parent_conv_id, n_convs, n_children, n_leaves,
       cast(saved_tokens as bigint) as saved_tokens, ends_sha256
from families join subtrees using (node)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_source_mix": SOURCE_MIX, "op4_vector_links": VECTOR_LINKS, "op5_byte_shards": BYTE_SHARDS,
        "op6_ngram_join": NGRAM_JOIN, "op9_decontamination": DECONTAMINATION, "op10_url_filter": URL_FILTER,
        "op11_repeated_passages": REPEATED_PASSAGES, "op13_prefix_trie": PREFIX_TRIE,
    }
