"""DuckDB SQL for the operators whose results SQL can express as a whole."""

from __future__ import annotations

#: Base 32 of a SHA-1 in hex: eight groups of five hex digits are four digits each.
_DIGIT = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hx, 1 + 5 * (k // 4), 5))::int >> (15 - 5 * (k % 4))) & 31), 1)"

WARC = f"""
with p as (select page_id, encode(coalesce(html, '')) as b from pages),
h as (select page_id, octet_length(b)::bigint as payload_bytes, sha1(b) as hx, row_number() over same as nth, first_value(page_id) over same as first_id
      from p window same as (partition by b order by page_id nulls last))
select page_id, payload_bytes, array_to_string([{_DIGIT} for k in range(32)], '') as payload_digest,
  case when nth = 1 then 'response' else 'revisit' end as record_type, case when nth > 1 then first_id end as refers_to
from h"""


def vector_codes(parts: int = 8, width: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """One step of assignment and one of means per round, over a row per vector, part and place within it."""
    steps = f"""
with kept as (select row_number() over (order by vec_id nulls last, embedding) as n, vec_id, label, embedding from embeddings
  where embedding is not null and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0),
cells as materialized (select n, p, d, floor({scale} * embedding[p * {width} + d + 1]::double)::bigint as x
  from kept, range({parts}) as a(p), range({width}) as b(d)),
book0 as materialized (select p, n - 1 as e, d, x as c from cells where n <= {entries})"""
    for k in range(rounds + 1):
        steps += f""",
far{k} as (select n, cells.p, e, sum((x - c) * (x - c)) as far from cells join book{k} as b on b.p = cells.p and b.d = cells.d group by n, cells.p, e),
near{k} as materialized (select n, p, arg_min(e, (far, e)) as e, min(far)::bigint as far from far{k} group by n, p)"""
        if k < rounds:
            steps += f""",
mean{k} as (select cells.p, near{k}.e, d, sum(x)::bigint as s, count(*) as m from cells join near{k} on near{k}.n = cells.n and near{k}.p = cells.p group by cells.p, near{k}.e, d),
book{k + 1} as materialized (select b.p, b.e, b.d, case when m is null then c else (s - ((s % m) + m) % m) // m end as c from book{k} as b left join mean{k} as t on t.p = b.p and t.e = b.e and t.d = b.d)"""
    return f"""{steps},
coded as (select n, string_agg(printf('%02x', e), '' order by p) as code, sum(far)::bigint as error from near{rounds} group by n),
hash as (select sha256(string_agg(c::varchar, ',' order by p, e, d)) as codebooks_sha256 from book{rounds})
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256 from kept join coded using (n), hash"""


VECTOR_CODES = vector_codes()
