"""Personal data by bootstrapped contextual extraction, in DataFrame expressions only.

Four base kinds (email, ip, card, phone) are found by pattern and are the seeds. Every seed is an
instance, and so is every other run of tokens with a digit or an at sign, with one space between them,
that holds at least ``DIGITS`` digits or an at sign, and every single token of that kind; punctuation
around them is left out. The words around an instance make its lexical patterns: two words to the left,
two words to the right, and one on either side. Identifiers of fewer digits, and names, are no
instances, so they are not found. Patterns and instances form a graph whose edges join distinct values and
patterns. ``ROUNDS`` times, a pattern's confidence is the mean score of the values that it
surrounds, damped by ``DAMP`` for small support, and an unlabelled value's score is the highest
confidence among its patterns. Only patterns that at least ``SUPPORT`` distinct seed values induce
take part. Values that end at ``CONFIDENT`` or more are reported as kind ``found``.

Values and patterns are hashed and counted by distinct pairs, summed within tasks first: thousands
of copies of one text weigh as one.

Defined cases: a null or empty text has no spans; null ids and repeated rows are rows like any
other; further columns are ignored; an empty table gives an empty result. Positions are code
points, ends exclusive. Candidates that overlap a base span are not reported again, nor are tokens
within a run that is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkspan.llm.common import discard, free_name, materialise, numbered, pick, spread, table, text_of
from linkspan.llm.spans import apart, matches, per_row

BASE = ("email", "ip", "card", "phone")
ADDED = ("found",)
ROUNDS = 3
SUPPORT = 3
DAMP = 1.0
CONFIDENT = 0.7
DIGITS = 5
#: The patterns of the base kinds. A run is tried from its start, or from where the match before ended.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A token with a digit or an at sign, and a run of them.
TOKEN = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
RUN = TOKEN + r"(?:\x20[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+)*+"
#: Punctuation that is no part of an identifier.
OPENS, CLOSES = "([{<\"'", ".,;:!?)]}>\"'"
OCTET = r"^0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$"


def luhn(digits: Column) -> Column:
    """Whether a string of at most some dozen digits passes Luhn's test."""
    n = F.length(digits)
    each = F.transform(
        F.sequence(F.lit(1), n),
        lambda i: (F.substring(digits, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 1, 2).otherwise(1)),
    )
    return F.aggregate(each, F.lit(0), lambda a, d: a + F.when(d > 9, d - 9).otherwise(d)) % 10 == 0


def valid(kind: Column, value: Column) -> Column:
    """Whether a match of a base kind holds. Long runs of digits are told apart by length before any arithmetic."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    few = F.when((kind == "card") & F.length(digits).between(16, 19), digits).otherwise(F.lit("1"))
    return (
        F.when(kind == "email", True)
        .when(kind == "ip", F.forall(F.split(value, "\\."), lambda x: x.rlike(OCTET)))
        .when(kind == "card", F.length(digits).between(16, 19) & luhn(few))
        .when(kind == "phone", F.length(digits).between(8, 15))
    )


def _contexts(instances: DataFrame) -> DataFrame:
    """(pattern, value, seed) of every instance, distinct."""
    sides = (("L ", "l2", "l1"), ("R ", "r1", "r2"), ("C ", "l1", "r1"))
    patterns = F.array(*(F.concat(F.lit(k), F.col(x), F.lit(" "), F.col(y)) for k, x, y in sides))
    edges = instances.select(F.xxhash64("value", F.length("value")).alias("v"), "seed", F.explode(F.filter(patterns, lambda p: p.isNotNull())).alias("pattern"))
    return edges.groupBy(F.xxhash64("pattern").alias("p"), "v").agg(F.max("seed").alias("seed"))


def bootstrap(instances: DataFrame) -> DataFrame:
    """v and score of the unlabelled values that end above the threshold; instances: value, seed, l2, l1, r1, r2."""
    edges = _contexts(instances)
    induced = edges.groupBy("p").agg(F.sum(F.col("seed").cast("int")).alias("k"), F.count(F.lit(1)).alias("n")).where(F.col("k") >= SUPPORT)
    edges = materialise(spread(edges, induced.select("p", "n"), "p", "n"))
    scores = materialise(edges.groupBy("v").agg(F.max("seed").alias("seed"), F.max(F.col("seed").cast("double")).alias("score"), F.count(F.lit(1)).alias("n")))
    for _ in range(ROUNDS):
        confidence = spread(edges, scores.select("v", "score", "n"), "v", "n").groupBy("p").agg((F.sum("score") / (F.count(F.lit(1)) + DAMP)).alias("confidence"), F.count(F.lit(1)).alias("n"))
        best = spread(edges, materialise(confidence), "p", "n").groupBy("v").agg(F.max("seed").alias("seed"), F.max("confidence").alias("confidence"), F.count(F.lit(1)).alias("n"))
        scores = materialise(best.select("v", "seed", F.when(F.col("seed"), 1.0).otherwise(F.col("confidence")).alias("score"), "n"))
    return scores.where(~F.col("seed") & (F.col("score") >= CONFIDENT)).select("v", "score")


def find(rows: DataFrame, uid: str, text: str) -> DataFrame:
    """All spans of rows (uid, text): uid, kind, start, end."""
    hits = materialise(rows.where(F.col(text).rlike("[0-9@]")).select(uid, text))
    base = matches(hits, uid, text, PATTERNS, context=True)
    base = materialise(base.where(valid(F.col("kind"), F.col("value"))).withColumn("seed", F.lit(True)))
    loose = matches(hits, uid, text, {"run": RUN, "token": TOKEN}, context=True)
    opened = F.ltrim("value", F.lit(OPENS))
    loose = loose.withColumn("start", F.col("start") + F.length("value") - F.length(opened)).withColumn("value", F.rtrim(opened, F.lit(CLOSES))).withColumn("end", F.col("start") + F.length("value"))
    loose = loose.where(F.col("value").contains("@") | (F.length(F.regexp_replace("value", "[^0-9]", "")) >= DIGITS))
    loose = materialise(apart(loose, base, uid).withColumn("seed", F.lit(False)))
    discard(hits)
    sure = bootstrap(base.unionByName(loose))
    value = F.xxhash64("value", F.length("value"))
    often = materialise(loose.groupBy(value.alias("v")).agg(F.count(F.lit(1)).alias("n")).join(sure.select("v"), "v"))
    added = materialise(spread(loose.withColumn("v", value), often, "v", "n").select(uid, "kind", "start", "end"))
    runs, tokens = (added.where(F.col("kind") == k).withColumn("kind", F.lit("found")) for k in ("run", "token"))
    return base.select(uid, "kind", "start", "end").unionByName(runs).unionByName(apart(tokens, runs, uid).select(uid, "kind", "start", "end"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, digest and spans of every row of docs."""
    rows = numbered(docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text_")), "uid")
    found = materialise(find(rows, "uid", "text_"))
    return per_row(rows.select("doc_id", "uid"), found, "uid", BASE, ADDED, by_kind=True).drop("uid")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs, each span replaced by its kind in angle brackets; overlapping spans become one, named after the first. The columns stay as they are (n_chars, where it is one, follows the text)."""
    uid, spans, done, new = (free_name(docs, n) for n in ("row_uid", "spans_found", "text_parts", "text_redacted"))
    fixed = numbered(docs, uid)
    found = find(fixed.select(uid, text_of(text_col).alias("text_")), uid, "text_")
    ordered = materialise(found.groupBy(uid).agg(F.array_sort(F.collect_list(F.struct("start", "end", "kind"))).alias(spans)))
    text = F.col(text_col)
    # a running end over the sorted spans: what stands before a span is kept from the end so far
    step = F.aggregate(
        spans,
        F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("parts")),
        lambda a, s: F.struct(
            F.greatest(a["at"], s["end"]).alias("at"),
            F.when(s["start"] < a["at"], a["parts"])
            .otherwise(F.concat(a["parts"], F.array(F.substring(text, (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")), F.concat(F.lit("<"), s["kind"], F.lit(">")))))
            .alias("parts"),
        ),
    )
    marked = pick(fixed, ordered, uid, "left").withColumn(done, step)
    tail = F.substring(text, (F.col(done)["at"] + 1).cast("int"), F.length(text))
    out = marked.withColumn(new, F.when(F.col(spans).isNull(), text).otherwise(F.concat(F.array_join(F.col(done)["parts"], ""), tail)))
    cols = {text_col: F.col(new)}
    if "n_chars" in docs.columns:
        cols["n_chars"] = F.when(F.col(spans).isNull(), F.col("n_chars")).otherwise(F.length(new).cast(docs.schema["n_chars"].dataType))
    return out.select(*(cols[c].alias(c) if c in cols else F.col(c) for c in docs.columns))


def op9_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The personal data of every document."""
    return scan(table(spark, sf_dir, "documents"))
