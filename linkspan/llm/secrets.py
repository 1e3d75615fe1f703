"""Secret scans by corpus-wide ownership frequency, in DataFrame expressions only.

Three base kinds of secrets are found by pattern. Candidates of a fourth kind, long tokens that mix
letters and digits, are credentials only if the corpus says so: every candidate's value is hashed,
and the distinct owners and distinct repositories that hold the hash are counted over all rows. A
value that more than ``OWNERS`` owners hold, or that more than ``REPOSITORIES`` repositories hold even
if they have one owner, is a widely copied example. Any other is owner-specific and is reported as kind
``owned``. The base kinds are always reported; ``n_example`` counts the reported spans whose value is
widely copied, and ``n_live`` those that look live; ``max_owners`` and ``max_repositories`` are the
largest counts among a row's reported values (0 where it has none).

Owner and repository are columns of the input. The table of documents has one column for both
(source); its distinct texts stand for repositories, so that exact copies of a file count once.

Defined cases: a null or empty text has no spans; a null owner counts as one owner of its own; null
ids and repeated rows are rows like any other; further columns are ignored; an empty table gives an
empty result. Positions are code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkspan.llm.common import materialise, numbered, spread, table, text_of
from linkspan.llm.spans import apart, matches, per_row

BASE = ("assign", "access", "hex")
ADDED = ("owned",)
#: A value that more owners hold is a widely copied example.
OWNERS = 2
#: So is one that more repositories hold, whoever owns them.
REPOSITORIES = 10
#: Different characters that a candidate of the added kind has at least.
VARIETY = 10
#: The patterns of the base kinds.
KEYWORD = r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]"""
ASSIGN = KEYWORD + r"""\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: A whole run of the characters that credentials are written in; a run is tried once, from its start.
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{24,}+"


def find(rows: DataFrame, uid: str, text: str, owner: str) -> DataFrame:
    """All spans of rows (uid, text, owner): uid, kind, start, end, value, owners, repositories."""
    likely = F.col(text).rlike(KEYWORD) | F.col(text).rlike(HEX) | F.col(text).rlike(ACCESS) | F.col(text).rlike(TOKEN)
    hits = materialise(rows.where(likely).select(uid, text, owner, F.xxhash64(text, F.crc32(F.col(text).cast("binary"))).alias("repository")))
    found = matches(hits, uid, text, {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "owned": TOKEN})
    held = F.when(F.col("kind") == "assign", F.regexp_extract("value", ASSIGN, 1)).otherwise(F.col("value"))
    found = found.withColumn("held", held).where((F.col("kind") != "assign") | (F.length("held") >= 6))
    found = materialise(found.join(hits.select(uid, owner, "repository"), uid).withColumn("h", F.xxhash64("held", F.length("held"))))
    base = found.where(F.col("kind") != "owned")
    loose = found.where((F.col("kind") == "owned") & F.col("value").rlike("[0-9]") & F.col("value").rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split("value", ""))) >= VARIETY))
    kept = base.unionByName(apart(loose, base, uid))
    owners = kept.select("h", owner, "repository").distinct()
    by = owners.groupBy("h", owner).agg(F.count(F.lit(1)).alias("n"))
    counts = by.groupBy("h").agg(F.count(F.lit(1)).alias("owners"))
    # a repository may have several owners: it counts once
    held_by = owners.select("h", "repository").distinct().groupBy("h").agg(F.count(F.lit(1)).alias("repositories"))
    rows_ = kept.groupBy("h").agg(F.count(F.lit(1)).alias("rows_"))
    counts = materialise(counts.join(held_by, "h").join(rows_, "h"))
    out = spread(kept, counts, "h", "rows_").withColumn("copied", (F.col("owners") > OWNERS) | (F.col("repositories") > REPOSITORIES))
    return out.where((F.col("kind") != "owned") | ~F.col("copied")).select(uid, "kind", "start", "end", "held", "owners", "repositories", "copied")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source") -> DataFrame:
    """Counts, digests and spans of every row of docs."""
    rows = numbered(docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text_"), F.col(owner_col).cast("string").alias("owner_")), "uid")
    found = materialise(find(rows, "uid", "text_", "owner_"))
    counted = per_row(rows.select("doc_id", "uid"), found, "uid", BASE, ADDED, by_kind=False)
    live = found.groupBy("uid").agg(
        F.count(F.when(~F.col("copied"), 1)).alias("n_live"), F.count(F.when(F.col("copied"), 1)).alias("n_example"),
        F.max("owners").alias("max_owners"), F.max("repositories").alias("max_repositories"),
    )
    return counted.join(live, "uid", "left").withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in live.columns[1:]}).drop("uid")


def op4_ownership_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets of every document."""
    return scan(table(spark, sf_dir, "documents"))


ORACLE = r"""
with d as (select doc_id, coalesce(text, '') as text, source as owner, row_number() over () as uid from documents),
m as (select uid, owner, text, 'assign' as kind, 0 as ord, regexp_extract_all(text, P0) as ms, string_split_regex(text, P0) as ps from d
  union all select uid, owner, text, 'access', 1, regexp_extract_all(text, P1), string_split_regex(text, P1) from d
  union all select uid, owner, text, 'hex', 2, regexp_extract_all(text, P2), string_split_regex(text, P2) from d
  union all select uid, owner, text, 'owned', 3, regexp_extract_all(text, P3), string_split_regex(text, P3) from d),
x as (select uid, owner, text, kind, ord, unnest(ms) as value, unnest(list_transform(ps[1:len(ms)], lambda p: length(p))) as gap, generate_subscripts(ms, 1) as i from m where len(ms) > 0),
y as (select *, sum(gap + length(value)) over (partition by uid, kind order by i) as e,
  case when kind = 'assign' then regexp_extract(value, P0, 1) else value end as held from x),
z as (select *, e - length(value) as s from y where (kind <> 'assign' or length(held) >= 6)
  and (kind <> 'owned' or (regexp_matches(value, '[0-9]') and regexp_matches(value, '[A-Za-z]') and len(list_distinct(string_split(value, ''))) >= 10))),
f as (select * from z where kind <> 'owned' or not exists (select 1 from z b where b.kind <> 'owned' and b.uid = z.uid and b.s < z.e and z.s < b.e)),
o as (select held, count(distinct coalesce('=' || owner, '')) as owners, count(distinct text) as repositories from f group by held),
g as (select f.*, owners, repositories, owners > 2 or repositories > 10 as copied from f join o using (held) where kind <> 'owned' or (owners <= 2 and repositories <= 10)),
c as (select uid, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,
  count(*) filter (not copied) as n_live, count(*) filter (copied) as n_example, max(owners) as max_owners, max(repositories) as max_repositories,
  string_agg(kind || ':' || s::bigint || ':' || e::bigint, ',' order by s, ord) filter (kind <> 'owned') as base,
  string_agg(kind || ':' || s::bigint || ':' || e::bigint, ',' order by s, ord) as spans from g group by uid)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256,
  coalesce(spans, '') as spans, coalesce(n_live, 0) as n_live, coalesce(n_example, 0) as n_example,
  coalesce(max_owners, 0) as max_owners, coalesce(max_repositories, 0) as max_repositories from d left join c using (uid)
"""
for _i, _p in enumerate((r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", ACCESS, HEX, "[A-Za-z0-9+/_=-]{24,}")):
    ORACLE = ORACLE.replace(f"P{_i})", f"'{_p}')").replace(f"P{_i},", f"'{_p}',")
