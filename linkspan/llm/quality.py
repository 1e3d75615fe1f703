"""Quality rules by cross-document line frequency.

Lines are normalised (A-Z lower-cased, digit runs to 0, white space to single spaces, trimmed) and
hashed. A line is common in a host when more than ``max(LINE_DOCS, LINE_SHARE x texts of the host)``
different texts of that host hold it; exact copies of a text count once, so that copying a clean
document does not make its lines common. Common lines are removed. A document is depleted, and
rejected, when fewer than ``MIN_WORDS`` words are left or when more than ``DEPLETED`` of its words
went. The base rules (too few words, too many words in repeated five-word windows) reject too.

Defined cases: a null text counts as empty and fails the base rules; a null host is a host of its
own; null ids and repeated rows are rows like any other; lines without a word are never common;
further columns pass through :func:`clean` untouched, whatever their names.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from linkspan.llm.common import WORDS, free_name, map_texts, materialise, numbered, pick, small_batches, table

MIN_WORDS = 10
REPEAT_PERCENT = 20
#: A common line is in more than this many texts of its host, and in more than this share of them.
LINE_DOCS = 20
LINE_SHARE = 0.02
#: A document that loses more than this share of its words is depleted.
DEPLETED = 0.8
#: Up to so many common lines are broadcast (16 bytes each); beyond, the join shuffles.
BROADCAST_LINES = 200_000
WINDOW = 5
SPACES = re.compile(r"[\x20\x09-\x0D]+")
DIGITS = re.compile(r"[0-9]+")
ASCII_LOWER = {i: i + 32 for i in range(65, 91)}
#: The characters that count as symbols.
SYMBOLS = "#*$%&|<>"
NO_SYMBOLS = str.maketrans("", "", SYMBOLS)


def normalise(line: str) -> str:
    return SPACES.sub(" ", DIGITS.sub("0", line.translate(ASCII_LOWER))).strip(" ")


def repeated_words(words: list[str], window: int = WINDOW) -> int:
    """Words in windows that are found twice or more. Windows of equal hash are compared as they are."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    mixed = np.zeros(n, dtype=np.uint64)
    for k in range(window):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
    order = np.argsort(mixed, kind="stable")
    same = mixed[order][1:] == mixed[order][:-1]
    if not same.any():
        return 0
    at: dict[tuple, list[int]] = {}
    for i in order[np.concatenate([same, [False]]) | np.concatenate([[False], same])].tolist():
        at.setdefault(tuple(words[i : i + window]), []).append(i)
    covered = np.zeros(len(words) + 1, dtype=np.int64)
    for starts in at.values():
        if len(starts) > 1:
            np.add.at(covered, starts, 1)
            np.add.at(covered, [min(i + window, len(words)) for i in starts], -1)
    return int((np.cumsum(covered)[:-1] > 0).sum())


def measure(text: str | None) -> tuple[int, int, int, int, int, list[tuple[int, int]]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and (hash, words) of each different normalised line."""
    if not text:
        return 0, 0, 0, 0, 0, []
    words = WORDS.findall(text)
    seen, dup, lines = set(), 0, {}
    for line in text.split("\n"):
        n = len(WORDS.findall(line))
        if n:
            dup += line in seen
            seen.add(line)
            h = _signed(normalise(line))
            lines[h] = lines.get(h, 0) + n
    return len(words), sum(map(len, words)), len(text) - len(text.translate(NO_SYMBOLS)), dup, repeated_words(words), list(lines.items())


MEASURED = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, line_hash array<bigint>, line_words array<int>, text_hash binary"


def _per_batch():
    def run(texts: list) -> dict[str, list]:
        out = [measure(t) for t in texts]
        found = {n: [x[k] for x in out] for k, n in enumerate(("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))}
        found["line_hash"] = [[h for h, _ in x[5]] for x in out]
        found["line_words"] = [[n for _, n in x[5]] for x in out]
        found["text_hash"] = [hashlib.blake2b((t or "").encode("utf-8", "surrogatepass"), digest_size=16).digest() for t in texts]
        return found

    return run


def common_lines(measured: DataFrame, line_docs: int = LINE_DOCS, line_share: float = LINE_SHARE) -> DataFrame:
    """host and line_hash of the lines above the limits. Counts are summed within tasks before any shuffle, so a hot host or line is no hot task."""
    texts = measured.groupBy("host", "text_hash").agg(F.first("line_hash").alias("line_hash"))
    limit = texts.groupBy("host").agg(F.greatest(F.lit(float(line_docs)), F.count(F.lit(1)) * line_share).alias("limit"))
    counts = texts.select("host", F.explode("line_hash").alias("line_hash")).groupBy("host", "line_hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > line_docs)
    both = counts.alias("c").join(limit.alias("l"), F.col("c.host").eqNullSafe(F.col("l.host")))
    return both.where(F.col("n") > F.col("limit")).select("c.host", "line_hash")


def judge(docs: DataFrame, host_col: str = "source", text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> tuple[DataFrame, DataFrame]:
    """The verdict on every row of docs, with its row number `uid` and the kept columns; and the common lines."""
    rows = docs.select(*keep, F.col(host_col).cast("string").alias("host"), F.col(text_col).alias("text_"), F.monotonically_increasing_id().alias("uid"))  # read once, by materialise()
    measured = materialise(map_texts(rows, "text_", (*keep, "host", "uid"), _per_batch, MEASURED))
    common = materialise(common_lines(measured))
    lines = measured.select("uid", "host", F.explode(F.arrays_zip("line_hash", "line_words")).alias("x")).select("uid", "host", F.col("x.line_hash").alias("line_hash"), F.col("x.line_words").alias("words"))
    side = F.broadcast(common) if common.count() <= BROADCAST_LINES else common
    hit = lines.alias("a").join(side.alias("b"), (F.col("a.line_hash") == F.col("b.line_hash")) & F.col("a.host").eqNullSafe(F.col("b.host")))
    removed = hit.groupBy("uid").agg(F.sum("words").alias("removed_words"))
    judged = measured.join(removed, "uid", "left").withColumn("removed_words", F.coalesce("removed_words", F.lit(0)).cast("long"))
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    left = F.col("n_words") - F.col("removed_words")
    depleted = (left < MIN_WORDS) | (F.col("removed_words") > DEPLETED * F.col("n_words"))
    return judged.select(*keep, "uid", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & ~depleted).alias("kept"), "removed_words"), common


def clean(docs: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text") -> DataFrame:
    """The rows of docs that pass, without their common lines; the columns stay as they are (n_chars, where it is one, follows the text)."""
    uid, gone, host = (free_name(docs, n) for n in ("row_uid", "gone_lines", "host_of_lines"))
    fixed = numbered(docs, uid)
    verdict, common = judge(fixed, host_col, text_col, keep=(uid,))
    changed = materialise(verdict.where(~F.col("kept") | (F.col("removed_words") > 0)).select(uid, "kept"))
    untouched = pick(fixed, changed.select(uid), uid, "left_anti").select(*docs.columns)
    hashes = common.groupBy(F.col("host").alias(host)).agg(F.collect_set("line_hash").alias(gone))  # at most lines of a text / LINE_SHARE for each host
    side = F.broadcast(hashes) if common.count() <= BROADCAST_LINES else hashes
    touched = pick(fixed, changed.where("kept").select(uid), uid, "left_semi")
    touched = touched.join(side, touched[host_col].cast("string").eqNullSafe(F.col(host)), "left").select(*docs.columns, gone)
    stripped = _strip(touched, text_col, gone)
    if "n_chars" in docs.columns:
        stripped = stripped.withColumn("n_chars", F.length(text_col).cast(docs.schema["n_chars"].dataType))
    return untouched.unionByName(stripped.select(*docs.columns))


def _signed(line: str) -> int:
    h = xxhash.xxh3_64_intdigest(line.encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


def _strip(df: DataFrame, text_col: str, gone: str) -> DataFrame:
    """df without the lines whose hash is in `gone`, and without that column."""
    small_batches(df.sparkSession)
    kept = [c for c in df.columns if c not in (text_col, gone)]
    schema = StructType([df.schema[c] for c in kept] + [df.schema[text_col]])

    def run(batches):
        for b in batches:
            texts = []
            for text, hashes in zip(b.column(text_col).to_pylist(), b.column(gone).to_pylist(), strict=True):
                known = set(hashes or ())
                texts.append("\n".join(x for x in text.split("\n") if not WORDS.search(x) or _signed(normalise(x)) not in known))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(texts, pa.string())], names=[*kept, text_col])

    return df.mapInArrow(run, schema)


def op2_line_frequency_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every document."""
    return judge(table(spark, sf_dir, "documents"))[0].drop("uid")


ORACLE = r"""
with d as (select doc_id, source as host, coalesce(text, '') as text, row_number() over () as uid from documents),
w as (select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words, string_split(text, chr(10)) as lines from d),
g as (select uid, i, list_slice(words, i, i + 4) as gram from (select uid, words, unnest(range(1, len(words) - 3)) as i from w where len(words) >= 6)),
rep as (select uid, count(distinct i + k) as n_repeat_words from
  (select uid, i, count(*) over (partition by uid, gram) as c from g) cross join range(0, 5) as r(k) where c > 1 group by uid),
l as (select uid, host, text, unnest(lines) as line, generate_subscripts(lines, 1) as at from w),
lw as (select *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) as n,
  trim(regexp_replace(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]+', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') as norm from l
  where regexp_matches(line, '[^\x20\x09-\x0D]')),
dup as (select uid, count(*) - count(distinct line) as n_dup_lines from lw group by uid),
host_n as (select host, greatest(20.0, count(distinct text) * 0.02) as lim from d group by host),
common as (select c.host, norm from (select host, norm, count(distinct text) as c from lw group by host, norm) c
  join host_n h on c.host is not distinct from h.host where c.c > lim),
gone as (select uid, sum(n) as removed_words from lw join common c on lw.norm = c.norm and lw.host is not distinct from c.host group by uid),
s as (select doc_id, len(words) as n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) as word_chars,
  length(text) - length(translate(text, '#*$%&|<>', '')) as n_symbols, coalesce(n_dup_lines, 0) as n_dup_lines,
  coalesce(n_repeat_words, 0) as n_repeat_words, coalesce(removed_words, 0) as removed_words
  from w left join rep using (uid) left join dup using (uid) left join gone using (uid)),
b as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from s)
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols, n_dup_lines::bigint as n_dup_lines,
  n_repeat_words::bigint as n_repeat_words, base_failed,
  not base_failed and n_words - removed_words >= 10 and removed_words <= 0.8 * n_words as kept, removed_words::bigint as removed_words from b
"""
