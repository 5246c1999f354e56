"""What SQL can say of the operators' results, in DuckDB's dialect."""

from __future__ import annotations

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: Words cut at white space.
WORDS = rf"regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+')"

BYTES = "octet_length(encode(coalesce(text, '')))"
PAYLOADS = f"""select doc_id, {BYTES} as n_bytes, {BYTES} + k as payload_bytes, sha256(encode(coalesce(text, '')) || repeat('\\xFF'::blob, k)) as payload_sha256
from (select *, case when {BYTES} = 0 then 576 else (576 - {BYTES} % 576) % 576 end as k from documents)"""


def places(phrase: str) -> str:
    words = phrase.split()
    same = ", ".join(f"'{w}'" for w in words)
    return f"list_filter(range(0, greatest(len(w) - {len(words) - 1}, 0)), lambda i: w[i + 1:i + {len(words)}] = [{same}])"


def licences(base: dict[str, str]) -> str:
    """Of the phrases and their labels."""
    found = ", ".join(f"{places(p)} as p{i}" for i, p in enumerate(base))
    names = [f"p{i}" for i in range(len(base))]
    every = " || ".join(names)
    labels = ", ".join(f"case when len(p{i}) > 0 then '{v}' end" for i, v in enumerate(base.values()))
    return f"""select doc_id, len(w) as n_words, len({every}) as n_base, list_min({every}) as first_word, list_max({every}) as last_word,
array_to_string(list_sort(list_distinct(list_filter([{labels}], lambda x: x is not null))), ',') as base_labels
from (select doc_id, w, {found} from (select doc_id, regexp_extract_all({LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents))"""


def near_duplicates(percent: int) -> str:
    """Links by shingle sets in full, and all that can be reached by them."""
    return f"""with recursive words as (select doc_id, {WORDS} as w from documents),
shingles as (select distinct doc_id, unnest(case when len(w) >= 5 then list_transform(range(0, len(w) - 4), lambda i: array_to_string(w[i + 1:i + 5], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from words),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
common as (select a.doc_id as a, b.doc_id as b, count(*) as c from shingles a join shingles b on a.s = b.s and a.doc_id <> b.doc_id group by all),
links as (select a, b from common join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * c >= {percent} * (x.n + y.n - c)),
reach as (select doc_id, doc_id as root from documents union select b, root from reach join links on a = doc_id)
select d.doc_id, coalesce(n, 0) as n_shingles, component_id, d.doc_id = component_id as kept
from documents d left join sizes using (doc_id) join (select doc_id, min(root) as component_id from reach group by doc_id) using (doc_id)"""


REPEATED = f"""with words as (select doc_id, {WORDS} as w from documents),
windows as (select doc_id, i, md5(array_to_string(w[i + 1:i + 50], ' ')) as h from (select doc_id, w, unnest(range(0, greatest(len(w) - 49, 0))) as i from words)),
found as (select distinct doc_id, i from windows join (select h, min(doc_id) as first from windows group by h) using (h) where doc_id > first),
runs as (select doc_id, i, sum(starts) over (partition by doc_id order by i) as run from (select *, (i - coalesce(lag(i) over (partition by doc_id order by i), -99) > 50)::int as starts from found))
select doc_id, min(i) as start, max(i) + 50 as "end", max(i) + 50 - min(i) as n_words from runs group by doc_id, run"""

#: CRC-32 of a short string: each byte, then a step for each of its bits.
CRC = """xor(list_reduce(flatten(list_transform(range(0, length({0})), lambda i: [256 + ascii(substr({0}, i + 1, 1)), -1, -1, -1, -1, -1, -1, -1, -1])),
lambda c, x: case when x >= 0 then xor(c, x - 256) else xor(c >> 1, case when c & 1 = 1 then 3988292384 else 0 end) end, 4294967295::bigint), 4294967295)"""
BASE_SCORES = f"""with tokens as (select doc_id, unnest({WORDS} || [' ']) as t, {CRC.format('doc_id::varchar')} % 7 = 2 as held_out from documents),
train as (select t, count(*) as c from tokens where not held_out group by t), whole as (select sum(c) as n, count(*) as v from train)
select doc_id, held_out, count(*) as n_tokens, count(c) as n_known, any_value(n)::bigint as train_tokens, round(sum(log10((coalesce(c, 0) + 1) / (n + v + 1))), 4) as base_score
from tokens left join train using (t), whole group by doc_id, held_out"""

EDITED = """select doc_id, n as n_chars, sha256(left(text, n - n // 2) || left(following, n // 2)) as edited_sha256
from (select doc_id, coalesce(text, '') as text, length(coalesce(text, '')) as n, coalesce(lead(coalesce(text, '')) over w, first_value(coalesce(text, '')) over w) as following from documents window w as (order by doc_id desc rows between unbounded preceding and unbounded following))"""
