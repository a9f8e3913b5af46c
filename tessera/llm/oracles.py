"""DuckDB SQL of the queries that SQL can express, with values of its own."""

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

SUBSTRINGS = f"""
with d as (select doc_id, {_WORDS.format("coalesce(text, '')")} w from documents),
i as (select doc_id, w, unnest(range(1, len(w) + 1)) p from d),
s as (select doc_id, p, array_to_string(list_slice(w, p, p + 12), ' ') k from i where p + 12 <= len(w)),
m as (select k, min(doc_id) f from s group by k),
g as (select doc_id, p from s join m using (k) where f < doc_id),
c as (select distinct doc_id, p + r.range q from g, range(13) r),
o as (select i.doc_id, count(c.q) n_removed, string_agg(w[p], ' ' order by p) filter (c.q is null) kept from i left join c on c.doc_id = i.doc_id and c.q = i.p group by 1)
select d.doc_id, len(w)::bigint n_words, coalesce(n_removed, 0) n_removed, sha256(coalesce(kept, '')) kept_sha256 from d left join o using (doc_id)"""

NGRAM_JOIN = f"""
with recursive d as (select doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} w from documents),
i as (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) p from d where len(w) > 0),
s as (select distinct doc_id, array_to_string(list_slice(w, p, p + 4), ' ') k from i),
n as (select doc_id, count(*) n from s group by 1),
c as (select a.doc_id a, b.doc_id b, count(*) c from s a join s b on a.k = b.k and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from c join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 80 * (x.n + y.n - c)),
e as (select a, b from l union all select b, a from l),
r(a, b) as (select a, b from e union select r.a, e.b from r join e on e.a = r.b)
select d.doc_id, coalesce(any_value(n.n), 0) n_shingles, least(d.doc_id, coalesce(min(r.b), d.doc_id)) component_id
from d left join n on n.doc_id = d.doc_id left join r on r.a = d.doc_id group by d.doc_id"""


def _count(pattern: str) -> str:
    return f"len(regexp_extract_all(x, '{pattern}'))"


_WORD = r"[^\x20\x09-\x0D]+"
_PHRASES = (
    "accept all cookies|add to cart|all rights reserved|back to top|by using this site|click here|cookie policy|create an account|"
    "enable javascript|follow us on|forgot your password|javascript is disabled|leave a comment|log in to|lorem ipsum|"
    "newsletter|powered by|privacy policy|read more|share on|sign up for|skip to content|subscribe to|terms of service|"
    "terms of use|this site uses cookies|we use cookies"
)
_BOILERPLATE = r"(?i)(?:^|[^\p{L}\p{N}_])(?:" + _PHRASES + r")(?:[^\p{L}\p{N}_]|$)"

QUALITY = f"""
with d as (select doc_id, coalesce(text, '') t, {_WORDS.format("coalesce(text, '')")} w, string_split(coalesce(text, ''), chr(10)) lines from documents),
i as (select doc_id, w, unnest(range(1, len(w) + 1)) p from d),
s as (select doc_id, p, array_to_string(list_slice(w, p, p + 7), ' ') k from i where p + 7 <= len(w)),
m as (select doc_id, k from s group by 1, 2 having count(*) > 1),
c as (select doc_id, count(distinct p + r.range) n from s semi join m on m.doc_id = s.doc_id and m.k = s.k, range(8) r group by 1),
l as (select doc_id, unnest(lines) x from d),
k as (select doc_id, x, {_count(_WORD)} n, {_count("(?:^|[ ])[|»›·•>][ ]|[|]$")} sep, {_count("[!?]{2,}")} shout, {_count(r"[#*$%&|<>{}~^=\\]{2,}")} clutter from l),
f as (select doc_id, x, n, n > 0 and (sep >= 3 and sep * 2 >= n - sep or shout * 10 >= n * 3 or clutter * 10 >= n * 3 or n >= 60 and not regexp_matches(x, '[.!?…。！？．｡؟۔।॥։።፧။។]')
or n <= 30 and {_count(_BOILERPLATE)} * 10 >= n) bad from k),
z as (select doc_id, sum(n) filter (not bad) n_left, count(*) filter (n > 0) - count(distinct x) filter (n > 0) dup from f group by 1),
o as (select d.doc_id, len(w)::bigint n_words, length(array_to_string(w, ''))::bigint word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::bigint n_symbols, dup::bigint n_dup_lines,
coalesce(c.n, 0)::bigint n_repeat_words, coalesce(n_left, 0)::bigint n_left from d join z using (doc_id) left join c using (doc_id)),
b as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words base_failed from o)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and not 100 * (n_words - n_left) > 50 * n_words kept, n_left from b"""

ORACLES = {"op2_substrings": SUBSTRINGS, "op4_ngram_join": NGRAM_JOIN, "op5_quality": QUALITY}
