"""DuckDB SQL for the contract queries that SQL can express."""

OP1 = """
with doc_words as (
  select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') w from documents
), item_words as (
  select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') w from benchmark
), windows as (
  select distinct item_id, least(10, len(w)) k, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') g
  from (select *, unnest(generate_series(1, greatest(1, len(w) - 9))) i from item_words where len(w) > 0)
), sizes as (select distinct k from windows),
occurrences as (
  select d.doc_id, d.i, d.k, x.item_id from (
    select doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') g
    from (select doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) i from doc_words, sizes where len(w) >= k)) d
  join windows x on x.g = d.g and x.k = d.k
), hits as (
  select doc_id, count(distinct p) n_hit from (select doc_id, unnest(generate_series(i, i + k - 1)) p from occurrences) group by 1
), found as (
  select doc_id, count(distinct item_id) n_items, string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) items from occurrences group by 1
)
select d.doc_id, coalesce(len(d.w), 0)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items,
       sha256(coalesce(items, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from doc_words d left join hits using (doc_id) left join found using (doc_id)
"""

OP8 = """
with recursive doc_words as (
  select doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+'), []) w from documents
), shingles as (
  select distinct doc_id, hash(array_to_string(w[i : i + 4], ' ')) g
  from (select doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) i from doc_words where len(w) > 0)
), sizes as (select doc_id, count(*) n from shingles group by 1),
common as (
  select a.doc_id a, b.doc_id b, count(*) n from shingles a join shingles b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2
), links as (
  select c.a, c.b from common c join sizes x on x.doc_id = c.a join sizes y on y.doc_id = c.b
  where 100 * c.n >= 75 * (x.n + y.n - c.n)
), reach(a, b) as (
  select a, b from links union select r.a, l.b from reach r join links l on r.b = l.a
)
select d.doc_id, coalesce(s.n, 0)::bigint n_shingles, least(d.doc_id, coalesce(r.low, d.doc_id)) component_id,
       d.doc_id <= coalesce(r.low, d.doc_id) kept
from doc_words d left join sizes s using (doc_id) left join (select a, min(b) low from reach group by 1) r on r.a = d.doc_id
"""

OP9 = """
with doc_words as (
  select doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) w from documents
), windows as (
  select doc_id, i, hash(array_to_string(w[i : i + 34], ' ')) g
  from (select doc_id, w, unnest(generate_series(1, len(w) - 34)) i from doc_words where len(w) >= 35)
), repeated as (
  select doc_id, i from windows where g in (select g from windows group by g having count(*) > 1)
), gone as (
  select distinct doc_id, unnest(generate_series(i, i + 34)) p from repeated
), kept as (
  select d.doc_id, string_agg(d.x, ' ' order by d.p) t
  from (select doc_id, unnest(w) x, generate_subscripts(w, 1) p from doc_words) d left join gone g on g.doc_id = d.doc_id and g.p = d.p
  where g.p is null group by 1
), removed as (select doc_id, count(*) n from gone group by 1)
select d.doc_id, len(w)::bigint n_words, coalesce(r.n, 0)::bigint n_removed, sha256(coalesce(k.t, '')) kept_sha256
from doc_words d left join kept k using (doc_id) left join removed r using (doc_id)
"""

#: CRC-32 in SQL: the table of its 256 steps by its rule, then one step a byte.
_CRC_STEPS = """crc_table as (
  select list(list_reduce(range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i) order by i) steps from range(256) r(i)
)"""


def _crc(text: str) -> str:
    byte = f"('0x' || substr(hex(encode({text})), 2 * j + 1, 2))::bigint"
    return f"xor(list_reduce(list_transform(range(octet_length(encode({text}))), lambda j: {byte}), lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)"


OP11 = f"""
with recursive {_CRC_STEPS},
runs as (
  select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\u00C0-\u00FF]+')) x from documents
), counted as (select doc_id, x, count(*) n from runs group by all),
checked as (select x, n, {_crc("doc_id || ':' || x")} h from counted, crc_table),
changed as (
  select case when h % 97 = 0 then substr(x, 1, (h % length(x))::bigint) || substr(x, (h % length(x))::bigint + 2) else x end word, n from checked
), words as (select word, sum(n)::bigint n from changed where length(word) >= 5 group by 1 having sum(n) >= 3),
cuts as (select word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) cut from (select *, unnest(generate_series(1, length(word))) i from words)),
near as (
  select a.word, a.n, b.word other, b.n m from cuts a join words b on a.cut = b.word
  union select b.word, b.n, a.word, a.n from cuts a join words b on a.cut = b.word
  union select a.word, a.n, b.word, b.n from cuts a join cuts b on a.i = b.i and a.cut = b.cut and a.word <> b.word
), best as (
  select word, count(*) n_near, arg_min(other, (-m, encode(other))) other, max(m) m from near group by 1
), formed as (
  select w.word, w.n, coalesce(n_near, 0)::bigint n_near, case when m >= 2 * n then other end form, case when m >= 2 * n then m end form_n from words w left join best using (word)
), walk(word, top) as (
  select word, word from formed union all select k.word, f.form from walk k join formed f on f.word = k.top where f.form is not null
)
select f.word, f.form, k.top root, f.n, f.n_near, f.form_n
from formed f join (select w.word, w.top from walk w join formed e on e.word = w.top where e.form is null) k on k.word = f.word
"""

OP12 = """
with payloads as (select page_id, coalesce(html, '') p, max(page_id) over (partition by coalesce(html, '')) last from pages)
select page_id, octet_length(encode(p))::bigint payload_bytes,
       array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(sha1(p), 1 + 10 * (k // 8), 10))::bigint >> (35 - 5 * (k % 8))) & 31) + 1, 1)), '') payload_digest,
       case when page_id = last then 'response' else 'revisit' end record_type, case when page_id <> last then last end refers_to
from payloads
"""

OP13 = f"""
with {_CRC_STEPS},
doc_words as (
  select doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) w from documents
), raw as (select doc_id, unnest(w) x from doc_words),
target as (
  select unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) x from benchmark
), features as (
  select x, {_crc("x")} % 10000 bucket from (select x from raw union select x from target), crc_table
), s as (select bucket, count(*) n from raw join features using (x) group by 1),
t as (select bucket, count(*) n from target join features using (x) group by 1),
gains as (
  select f.bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::double * ((select count(*) from raw) + 10000) / ((coalesce(s.n, 0) + 1)::double * ((select count(*) from target) + 10000))))::bigint gain
  from (select distinct bucket from features) f left join s using (bucket) left join t using (bucket)
), weights as (
  select doc_id, floor(sum(gain) / count(*))::bigint weight from raw join features using (x) join gains using (bucket) group by 1
), scored as (
  select d.doc_id, len(d.w)::bigint n_features, coalesce(w.weight, 0) weight,
         coalesce(w.weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::bigint + 0.5::double) / 4294967296)))::bigint score
  from doc_words d left join weights w using (doc_id)
), ranked as (
  select doc_id, row_number() over (order by score desc, doc_id) place, count(*) over () n from scored where n_features >= 20
)
select d.doc_id, n_features, weight, score, case when place <= 10 * n // 100 then place end::bigint rank
from scored d left join ranked r using (doc_id)
"""

SQL = {"op12_warc": OP12, "op11_spelling_variants": OP11, "op13_importance": OP13, "op8_near_dedup": OP8, "op1_decontaminate": OP1, "op9_substring_dedup": OP9}
