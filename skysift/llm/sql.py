"""DuckDB SQL for the operators that it can express."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from skysift.llm import centroids, hilbert_shards, host_rules, phrases, revisits, url_filter

WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"


def _host_rules() -> str:
    rules = host_rules.RULES
    soft = host_rules.SOFT
    sums = ", ".join(f"sum(f_{r}) as f_{r}" for r in rules)
    moments = ", ".join(f"sum(f_{r}) / sum(n) as m_{r}, sum(f_{r} * f_{r} / n) / sum(n) as q_{r}" for r in rules)
    strength = ", ".join(
        f"case when m_{r} * (1 - m_{r}) = 0 then 1e6 else least(greatest(m_{r} * (1 - m_{r}) / greatest(q_{r} - m_{r} * m_{r} - m_{r} * (1 - m_{r}) * hosts / total, 1e-9) - 1, 1.0), 1e6) end as s_{r}"
        for r in rules)
    shrunk = ", ".join(f"(f_{r} + m_{r} * s_{r}) / (n + s_{r}) as rate_{r}" for r in rules)
    worst = ", ".join(f"rate_{r}" for r in rules)
    against = " or ".join([f"greatest({worst}) >= {host_rules.BLOCKED}", *(f"(({x}) and rate_{r} >= {host_rules.NOTORIOUS})" for r, x in soft.items())])
    return rf"""
with split as (select doc_id, source, coalesce(text, '') as text, {WORDS} as ws from documents),
word as (select doc_id, unnest(ws) as x, unnest(range(len(ws))) as p from split),
win as (select doc_id, p, x, lead(x) over o as y, lead(x, 2) over o as z from word window o as (partition by doc_id order by p)),
twice as (select doc_id, p from win where z is not null qualify count(*) over (partition by doc_id, x, y, z) > 1),
covered as (select doc_id, count(distinct q) as n from (select doc_id, unnest([p, p + 1, p + 2]) as q from twice) group by doc_id),
line as (select doc_id, unnest(string_split(text, chr(10))) as l from split),
dup as (select doc_id, count(*) - count(distinct l) as n from line where regexp_matches(l, '[^\x20\x09-\x0D]') group by doc_id),
m as (
  select doc_id, source, len(ws)::bigint as n_words, length(array_to_string(ws, ''))::bigint as word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
    coalesce(dup.n, 0)::bigint as n_dup_lines, coalesce(covered.n, 0)::bigint as n_repeat_words
  from split left join dup using (doc_id) left join covered using (doc_id)),
host as (
  select source, count(*)::double as n, {sums}
  from (select source, {", ".join(f"({x})::int::double as f_{r}" for r, x in rules.items())} from m) group by source),
prior as (select *, {strength} from (select count(*) as hosts, sum(n) as total, {moments} from host)),
verdict as (select source, {shrunk} from host, prior)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({rules["few"]}) or ({rules["repeats"]}) as base_failed,
  not (({rules["few"]}) or ({rules["repeats"]})) and not ({against}) as kept
from m join verdict on m.source is not distinct from verdict.source
"""


def _hilbert_shards(shards: int = 8) -> str:
    bits, top = hilbert_shards.BITS, 1 << hilbert_shards.BITS
    table = "[" + ", ".join(map(str, hilbert_shards.curve_table(4))) + "]"
    cells = ("c_size", "c_id", "c_source", "c_lang")
    corner = " + ".join(f"(({c} >> level) & 1) * {1 << j}" for j, c in enumerate(cells))

    def string_cell(name: str) -> str:
        # The bytes behind what the least and the greatest value begin with, as a number.
        skip = f"(select coalesce(max(k), 0) from range(1, 64) r(k), ends where strlen({name}_low) >= k and left(hex({name}_low), 2 * k) = left(hex({name}_high), 2 * k))"
        number = lambda x: f"('0x' || rpad(substr(hex({x}), 2 * {skip} + 1, {2 * hilbert_shards.PREFIX}), {2 * hilbert_shards.PREFIX}, '0'))::bigint"
        low, high = (f"(select {number(f'{name}_{at}')} from ends)" for at in ("low", "high"))
        return f"coalesce((({number(name)} - {low})::hugeint * {top} // ({high} - {low} + 1))::bigint, 0)"

    # Accumulators: the checksum; place along the curve * 64 + state.
    return rf"""
with crc as (select list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t),
d as (
  select doc_id, source, lang, strlen(coalesce(text, '')) + 1 as size, hex(coalesce(text, '')) as h from documents),
ends as (select min(doc_id) as id_low, max(doc_id) as id_high, min(source) as source_low, max(source) as source_high, min(lang) as lang_low, max(lang) as lang_high from d),
c as (
  select doc_id, size, xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(h, '..'), lambda b: ('0x' || b)::bigint)),
      lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) as text_crc32,
    least(2 * (length(bin(size)) - 1) + case when size > 1 then (size >> (length(bin(size)) - 2)) & 1 else 0 end, {top - 1}) as c_size,
    ((doc_id - id_low) * {top} // (id_high - id_low + 1))::bigint as c_id, {string_cell("source")} as c_source, {string_cell("lang")} as c_lang
  from d, ends, crc),
p as (select *, list_reduce(list_prepend(0::bigint, range({bits - 1}, -1, -1)), lambda a, level:
      ((a // 64) * 16 + ({table}[(a % 64) * 16 + {corner} + 1] & 15)) * 64 + ({table}[(a % 64) * 16 + {corner} + 1] >> 4)) // 64 as place from c),
n as (select *, row_number() over (order by place, text_crc32, doc_id) - 1 as nth, count(*) over () as total from p)
select doc_id, size::bigint as size, text_crc32::bigint as text_crc32, 'rows' as law, (nth * {shards} // total)::int as shard,
  (nth - ((nth * {shards} // total) * total + {shards - 1}) // {shards})::bigint as slot, null::int as grown_shard
from n
"""


def _revisits() -> str:
    head = "^[A-Za-z][A-Za-z0-9+.-]*://"
    permitted = ", ".join(f"'{h}'" for h in revisits.PERMITTED)
    return rf"""
with p as (select page_id, url, 1600000000 + page_id * 60 as t, md5(coalesce(html, '')) as tag, strlen(coalesce(html, '')) as size, sha256(coalesce(html, '')) as digest from pages),
rec as (
  select page_id * 8 as record_id, 'response' as kind, url, t as ts, tag as etag, t::varchar as modified, digest,
    ['content-type: text/html', 'content-length: ' || size, 'etag: ' || tag, 'last-modified: ' || t, 'cache-control: max-age=60', 'server: s' || page_id % 5] as headers from p
  union all select page_id * 8 + 1, 'revisit', url || '#again', t + 600, tag, null, null,
    ['date: ' || (t + 600), 'cache-control: max-age=120', 'content-length: 0', 'etag: ' || tag] from p
  union all select page_id * 8 + 2, 'revisit', regexp_replace(url, '^https?://', 'HTTPS://'), t + 7200, o, t::varchar, null,
    ['date: ' || (t + 7200), 'cache-control: max-age=120', 'content-length: 0', 'etag: ' || o]
    from (select *, case when page_id % 3 = 0 then 'x' || tag else 'W/' || tag end as o from p)
  union all select page_id * 8 + 3, 'revisit', url, t + 90000, null, t::varchar, null,
    ['date: ' || (t + 90000), 'cache-control: max-age=120', 'content-length: 0', 'expires: ' || (t + 90000)] from p
  union all select page_id * 8 + 4, 'revisit', url, t - 5, null, null, null, ['date: ' || (t - 5), 'cache-control: max-age=120', 'content-length: 0'] from p),
bare as (select * exclude (url), regexp_replace(url, '#.*$', '') as u from rec),
parts as (
  select *, regexp_replace(regexp_replace(lower(regexp_extract(u, '{head}([^/?]*)', 1)), '^(www|m)\.', ''), ':(80|443)$', '')
      || regexp_replace(regexp_extract(u, '{head}[^/?]*([^?]*)', 1), '/+$', '') as place,
    array_to_string(list_sort(list_filter(string_split(regexp_extract(u, '[?](.*)$', 1), '&'), lambda x: x <> '' and not regexp_matches(x, '^(utm_[^=]*|ref)(=|$)'))), '&') as q
  from bare),
c as (select * exclude (u, place, q), place || case when q = '' then '' else '?' || q end as canonical from parts),
found as (
  select v.record_id, v.canonical, v.etag, v.modified, v.headers,
    arg_max({{'id': r.record_id, 'etag': r.etag, 'modified': r.modified, 'digest': r.digest, 'headers': r.headers}}, r.ts::hugeint * 1000000000000 + r.record_id) as r
  from (from c where kind = 'revisit') v left join (from c where kind = 'response') r
    on v.canonical = r.canonical and (r.ts < v.ts or r.ts = v.ts and r.record_id < v.record_id)
  group by all),
judged as (
  select *, case when r is null or r.id is null then 'no_response' when etag is null and modified is null then 'unvalidated'
    when etag is not null then case when regexp_replace(etag, '^W/', '') = regexp_replace(r.etag, '^W/', '') then 'resolved' else 'mismatch' end
    when modified = r.modified then 'resolved' else 'mismatch' end as status,
    list_filter(headers, lambda h: split_part(h, ': ', 1) in ({permitted})) as fresh from found)
select record_id, canonical, status, case when status in ('resolved', 'unvalidated') then r.id end as refers_to, case when status in ('resolved', 'unvalidated') then r.digest end as digest,
  array_to_string(list_sort(case when status in ('resolved', 'unvalidated')
    then list_concat(list_filter(r.headers, lambda h: not list_contains(list_transform(fresh, lambda f: split_part(f, ': ', 1)), split_part(h, ': ', 1))), fresh)
    else headers end), chr(10)) as headers
from judged
"""



def _canonical(url: str) -> str:
    """The canonical form of a URL expression; its fragment goes first."""
    head, u = "^[A-Za-z][A-Za-z0-9+.-]*://", f"regexp_replace({url}, '#.*$', '')"
    query = f"array_to_string(list_sort(list_filter(string_split(regexp_extract({u}, '[?](.*)$', 1), '&'), lambda x: x <> '' and not regexp_matches(x, '^(utm_[^=]*|ref)(=|$)'))), '&')"
    return rf"""(regexp_replace(regexp_replace(lower(regexp_extract({u}, '{head}([^/?]*)', 1)), '^(www|m)\.', ''), ':(80|443)$', '')
      || regexp_replace(regexp_extract({u}, '{head}[^/?]*([^?]*)', 1), '/+$', '') || case when {query} = '' then '' else '?' || {query} end)"""


def _collocations() -> str:
    least, top, inside = phrases.SUPPORT, phrases.TOP, phrases.INSIDE_PERCENT
    return rf"""
with piece as (
  select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}'), '[.,;:!?\x0A-\x0D]')) as x from documents),
w as (select lang, list_filter(string_split_regex(x, '[\x20\x09]+'), lambda y: y <> '') as ws from piece),
total as (select lang, sum(len(ws))::bigint as n from w group by lang),
size as (select unnest(range(1, {phrases.LONGEST + 1})) as k),
occ as (select lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) as phrase from w, size),
f as (select lang, k, phrase, count(*) as a from occ group by all having count(*) >= {least}),
cut as (
  select f.lang, f.k, phrase, a, size.k as c, array_to_string(string_split(phrase, ' ')[1:size.k], ' ') as head, array_to_string(string_split(phrase, ' ')[size.k + 1:], ' ') as tail
  from f, size where size.k < f.k),
scored as (
  select cut.*, x.a as l, y.a as r, (1000000::hugeint * cut.a * cut.a // (x.a::hugeint * y.a))::bigint as score
  from cut join f x on x.lang = cut.lang and x.phrase = head join f y on y.lang = cut.lang and y.phrase = tail),
lowest as (select * from scored qualify row_number() over (partition by lang, phrase order by score, c) = 1),
longer as (
  select lang, unnest([array_to_string(string_split(phrase, ' ')[1:2], ' '), array_to_string(string_split(phrase, ' ')[2:3], ' ')]) as phrase, a as longer from f where k = 3),
kept as (
  select * from lowest t where not exists (select 1 from longer o where o.lang = t.lang and o.phrase = t.phrase and 100 * o.longer >= {inside} * t.a))
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score
from kept join total using (lang) qualify rank <= {top}
"""


def _url_filter() -> str:
    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in url_filter.RULES)
    return rf"""
with rules(verdict, h, p) as (values {rules}),
page as (
  select row_number() over () as i, page_id, {_canonical("case when contains(url, '://') then url end")} as canonical, html,
    translate(coalesce(regexp_extract(url, '{url_filter.PARTS}', 1), ''), '{ascii_uppercase}', '{ascii_lowercase}') as host, coalesce(regexp_extract(url, '{url_filter.PARTS}', 2), '') as path from pages),
bad as (select distinct {_canonical("url")} as canonical from pages where regexp_matches(html, '{url_filter.JUNK}')),
fit as (
  select i, h || p as rule, verdict from page join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p)
  qualify row_number() over (partition by i order by length(h || p) desc, length(h) desc, verdict desc) = 1)
select page_id, host, path, rule, coalesce(verdict, case when bad.canonical is not null then 'block' else 'allow' end) as verdict, bad.canonical is not null as listed
from page left join fit using (i) left join bad on bad.canonical = page.canonical
"""


def _centroids() -> str:
    size = centroids.SIZE
    far = f"list_sum(list_transform(range(1, {size + 1}), lambda i: (v[i] - c[i]) * (v[i] - c[i])))::bigint"
    parts = [f"""q as materialized (
  select row_number() over () as i, vec_id, list_transform(embedding, lambda x: floor({centroids.SCALE} * x::double)::bigint) as v from embeddings
  where len(embedding) = {size} and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = {size})""",
        f"""c0 as materialized (
  select row_number() over (order by h) - 1 as k, v as c from (select sha256('{centroids.SEED}:' || vec_id) as h, v from q order by h limit {centroids.CLUSTERS}))"""]
    for r in range(centroids.ROUNDS + 1):
        parts.append(f"a{r} as materialized (select i, any_value(vec_id) as vec_id, any_value(v) as v, min({{'d': {far}, 'k': k}}) as best from q, c{r} group by i)")
        if r < centroids.ROUNDS:
            parts.append(f"""c{r + 1} as materialized (
  select k, coalesce(m.c, c{r}.c) as c from c{r} left join (
    select k, list((s - ((s % n) + n) % n) // n order by j) as c from (
      select best.k as k, j, sum(v[j])::bigint as s, count(*) as n from a{r}, range(1, {size + 1}) t(j) group by all) group by k) m using (k))""")
    last = centroids.ROUNDS
    return f"""
with {", ".join(parts)}
select vec_id, best.k::int as cluster, best.d as distance, sum(best.d) over (partition by best.k)::bigint as cluster_inertia, sum(best.d) over ()::bigint as inertia,
  sha256(array_to_string(c, ',')) as centroid_sha256
from a{last} join c{last} on c{last}.k = best.k
"""


ORACLES = {
    "op3_not_modified_revisits": _revisits(), "op6_host_rules": _host_rules(), "op7_hilbert_shards": _hilbert_shards(),
    "op11_son_collocations": _collocations(), "op12_bloom_url_filter": _url_filter(), "op13_integer_centroids": _centroids(),
}
