"""Parts that the SQL versions of the queries share."""

from __future__ import annotations

from linkspan.functions.text import ADDRESS_STOP, ALIASES, STOP


def _list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def normal(x: str) -> str:
    return f"array_to_string(regexp_extract_all(strip_accents(replace(replace(lower({x}), 'ß', 'ss'), '&', ' and ')), '[a-z0-9]+'), ' ')"


def domain(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^\\s+|\\s+$', '', 'g'), '\\.(?:com|net|org|in|co|fr)(?:/.*)?$', '', 'i')"


ALIAS = "case t " + " ".join(f"when '{a}' then '{b}'" for a, b in ALIASES.items()) + " else t end"

DOCUMENTS = """raw as (select 'S' || src || '-' || doc_id as entity_id, array_to_string(w[1:6], ' ') as business_name,
  (n_chars % 997) || ' ' || array_to_string(w[7:14], ' ') || ' ' || (n_chars + 10000) as business_address, lang as country, src as source, text, lang
  from (select *, cast(substr(source, 4) as int) % 3 + 1 as src, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') as w from documents))"""

PARTS = "raw as (select 'S' || (p_partkey % 3 + 1) || '-' || p_partkey as entity_id, p_name as business_name, p_brand as business_address, 'XX' as country, cast(p_partkey % 3 + 1 as int) as source from part)"

PARTIES = """raw as (select 'S1-' || c_custkey as entity_id, c_name as business_name, '' as business_address, n_name as country, 1 as source from customer join nation on c_nationkey = n_nationkey
  union all select 'S2-' || s_suppkey, s_name, '', n_name, 2 from supplier join nation on s_nationkey = n_nationkey)"""

PREPARED = f"""norm as (select entity_id, source, {normal(domain("business_name"))} as name, {normal("business_address")} as address, {normal("country")} as country from raw),
prep as (select entity_id, source, name, country,
  array_to_string(list_filter(string_split(name, ' '), lambda t: not list_contains({_list(STOP)}, t)), '') as compact,
  list_sort(list_distinct(list_filter(string_split(name, ' '), lambda t: t <> '' and not list_contains({_list(STOP)}, t)))) as nt,
  list_sort(list_distinct(list_transform(list_filter(string_split(address, ' '), lambda t: t <> ''), lambda t: {ALIAS}))) as "at" from norm)"""

#: The first version strips no domains.
PREPARED_V1 = PREPARED.replace(normal(domain("business_name")), normal("business_name"))

RANKED = f"""tok as (select entity_id, country, t, row_number() over (partition by entity_id order by length(t) desc, t) as rk from (select entity_id, country, unnest(nt) as t from prep) qualify rk <= 8),
num as (select entity_id, country, t, row_number() over (partition by entity_id order by t) as rk from (select entity_id, country, unnest("at") as t from prep) where regexp_full_match(t, '[0-9]+') qualify rk <= 4),
plc as (select entity_id, country, t, row_number() over (partition by entity_id order by length(t) desc, t) as rk from (select entity_id, country, unnest("at") as t from prep)
  where length(t) >= 3 and not regexp_full_match(t, '[0-9]+') and not list_contains({_list(ADDRESS_STOP)}, t) qualify rk <= 8)"""

S = "chr(1)"
KEY_SQL = {
    "exact": f"select distinct entity_id, 'exact' || {S} || country || {S} || name as key from prep where name <> ''",
    "compact": f"select distinct entity_id, 'compact' || {S} || country || {S} || compact as key from prep where name <> ''",
    "token": f"select distinct entity_id, 'token' || {S} || country || {S} || t as key from tok where length(t) >= 4",
    "name_pair": f"select distinct a.entity_id, 'name_pair' || {S} || a.country || {S} || least(a.t, b.t) || {S} || greatest(a.t, b.t) as key from tok a join tok b on a.entity_id = b.entity_id and a.rk < b.rk and b.rk <= 6",
    "number_name": f"select distinct a.entity_id, 'number_name' || {S} || a.country || {S} || a.t || {S} || b.t as key from num a join tok b on a.entity_id = b.entity_id and b.rk <= 4",
    "name_gram": f"select distinct entity_id, 'name_gram' || {S} || country || {S} || substring(t, i, 4) as key from (select entity_id, country, t, unnest(range(1, least(length(t) - 3, 24) + 1)) as i from tok where rk <= 3 and length(t) >= 6)",
    "address_pair": f"select distinct a.entity_id, 'address_pair' || {S} || a.country || {S} || least(a.t, b.t) || {S} || greatest(a.t, b.t) as key from plc a join plc b on a.entity_id = b.entity_id and a.rk < b.rk and b.rk <= 6",
    "number_address": f"select distinct a.entity_id, 'number_address' || {S} || a.country || {S} || a.t || {S} || b.t as key from num a join plc b on a.entity_id = b.entity_id and b.rk <= 4",
    "address_exact": f'''select distinct entity_id, 'address_exact' || {S} || country || {S} || array_to_string("at", chr(2)) as key from prep where len("at") > 0''',
}
KEY_SQL_V1 = {
    "prefix": f"select distinct entity_id, 'prefix' || {S} || country || {S} || substring(t, 1, 5) as key from tok where rk <= 3 and length(t) >= 6",
    "pair": KEY_SQL["name_pair"].replace("'name_pair'", "'pair'"),
}
ALL_KEYS = "keys as (" + " union ".join(KEY_SQL.values()) + ")"
ALL_KEYS_V1 = "keys as (" + " union ".join([KEY_SQL[k] for k in ("exact", "token", "number_name")] + list(KEY_SQL_V1.values())) + ")"
POOL = """post as (select k.entity_id, key, source from keys k join prep using (entity_id)),
asked as (select distinct key from post where source = 1),
size as (select key, count(*) as n from post semi join asked using (key) where source <> 1 group by key),
pool as (select distinct q.entity_id as eid, t.entity_id as tid from post q join post t on q.key = t.key join size s on s.key = q.key where q.source = 1 and t.source <> 1 and s.n <= 100)"""
PAIRS = """pairs as (select eid, tid, a.name as an, b.name as bn, a.compact as ac, b.compact as bc, a.nt as ant, b.nt as bnt, a."at" as aat, b."at" as bat, a.country as aco, b.country as bco
  from pool join prep a on a.entity_id = eid join prep b on b.entity_id = tid)"""


def jaccard(a: str, b: str) -> str:
    return f"(case when len({a}) + len({b}) = 0 then 0.0::double else len(list_intersect({a}, {b}))::double / (len({a}) + len({b}) - len(list_intersect({a}, {b}))) end)"


def containment(a: str, b: str) -> str:
    return f"(case when len({a}) = 0 or len({b}) = 0 then 0.0::double else len(list_intersect({a}, {b}))::double / least(len({a}), len({b})) end)"


def grams(x: str, n: int) -> str:
    return f"list_distinct(list_transform(range(1, greatest(length({x}) - {n - 2}, 1)), lambda i: substring({x}, i, {n})))"


def digits(x: str) -> str:
    return f"list_filter({x}, lambda t: regexp_full_match(t, '[0-9]+'))"


def postal(x: str) -> str:
    return f"list_filter({x}, lambda t: regexp_full_match(t, '[0-9]{{5,6}}'))"


EQUAL = "(case when ac = bc and ac <> '' then 1.0::double else 0.0::double end)"
CHEAP = f"(3 * greatest(greatest({jaccard('ant', 'bnt')}, {EQUAL}), {jaccard('aat', 'bat')}) + least(greatest({jaccard('ant', 'bnt')}, {EQUAL}), {jaccard('aat', 'bat')}))"
CHEAP_V1 = f"(3 * {jaccard('ant', 'bnt')} + {jaccard('aat', 'bat')} + 2 * (an = bn)::int::double)"


def chain(*parts: str) -> str:
    return "with " + ",\n".join(parts)


TRUTH = "truth as (select a.entity_id as eid, b.entity_id as tid from raw a join raw b on a.text = b.text and a.lang = b.lang where a.source = 1 and b.source <> 1)"
