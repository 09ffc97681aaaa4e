"""Personal data: fixed shapes, and identifiers found by bootstrapped contexts.

Fixed shapes (email, ip, card, phone) are regular expressions and checks. Their
matches, and strings shaped like keys, are the seeds of the second part. All
matches, and every other token that holds a digit, are instances; the two words
to the left of an instance, the two to its right, and the one to either side
are its patterns. Where a text starts, and where it or the next instance ends
what follows, stands a mark, and so does the instance before, so that each has
all three. Patterns and
instances score each other for a few rounds over the graph of who occurs with
whom. Instances not yet known that stand in a pattern of high confidence are
found as kind "other". A token without a digit is found by its shape only (an
email), never by its context.

DataFrame and SQL functions only. A position comes from the lengths of what
split() leaves between matches, since both walk a text in the same way. The
expressions differ from the plain ones in what makes them linear: possessive
repeats, and lookbehinds that start only where a run starts; the matches are
the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtok.llm.common import materialize

KINDS = ("email", "ip", "card", "phone")
SHAPES = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
INSTANCE = r"(?<![A-Za-z0-9._%+@-])(?=[A-Za-z._%+@-]*+[0-9])[A-Za-z0-9._%+@-]{3,}[A-Za-z0-9]"
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
KEY = "^(?:[0-9a-fA-F]{32,}|AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36})$"
#: Rounds, and what makes a pattern: distinct instances, and their mean score.
ROUNDS, SUPPORT, CONFIDENCE = 3, 3, 0.8
#: Characters to either side of an instance that its patterns are taken from.
WINDOW = 200


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    digits = F.transform(F.regexp_extract_all(F.reverse(_digits(m)), F.lit("[0-9]"), F.lit(0)), lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise(x.cast("int") * 2 - F.when(x.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(digits, F.lit(0), lambda a, x: a + x) % 10 == 0


def valid(kind: str, m: Column) -> Column:
    return {
        "email": F.lit(True),
        "ip": m.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"),
        "card": _luhn(m),
        "phone": F.length(_digits(m)).between(9, 15),
    }[kind]


def _pieces(i: int, kind: str) -> Column:
    """Of each match in order: its kind and place among them, what it is, how far it is from the one before, and what stands around it."""
    found, parts = F.col(f"_{kind}"), F.col(f"_{kind}_parts")
    pairs = F.zip_with(found, F.slice(parts, 1, F.size(found)), lambda m, p: F.struct(m.alias("match"), F.length(p).alias("gap"), F.right(p, F.lit(WINDOW)).alias("before")))
    pairs = F.zip_with(pairs, F.slice(parts, 2, F.size(found)), lambda x, p: F.struct(x["match"].alias("match"), x["gap"].alias("gap"), x["before"].alias("before"), F.left(p, F.lit(WINDOW)).alias("after")))
    return F.transform(pairs, lambda x, at: F.struct(F.lit(i).alias("kind"), at.alias("at"), x["match"].alias("match"), x["gap"].alias("gap"), F.concat(F.when(at == 0, F.lit("^ ^ ")).otherwise(F.lit("# # ")), x["before"]).alias("before"), x["after"].alias("after")))


def _patterns(before: Column, after: Column) -> Column:
    """Hashes of the two words before with what is glued to the instance, of the two after, and of the one to either side."""
    plain = lambda c: F.lower(F.regexp_replace(c, r"\S*[0-9@]\S*", "#"))
    left, right = plain(before), F.concat(plain(after), F.lit(" $ $"))
    two, to = F.regexp_extract(left, r"(\S+\s+\S+\s+\S*)\z", 1), F.regexp_extract(right, r"^(\S*\s+\S+\s+\S+)", 1)
    one, next_one = F.regexp_extract(left, r"(\S+\s+\S*)\z", 1), F.regexp_extract(right, r"^(\S*\s+\S+)", 1)
    return F.array(F.xxhash64(F.lit("left"), two), F.xxhash64(F.lit("right"), to), F.xxhash64(F.lit("both"), one, next_one))


def occurrences(rows: DataFrame) -> DataFrame:
    """rows' own columns but text, with the pieces of all kinds, instances last."""
    keep = [c for c in rows.columns if c != "text"]
    t = F.coalesce("text", F.lit(""))
    none = F.array().cast("array<string>")
    # a look for what every match needs is far cheaper than the match
    needs = {"email": F.instr(t, "@") > 0, "ip": t.rlike(r"[0-9]\.[0-9]"), "card": t.rlike(r"[0-9][\x20-]?[0-9][\x20-]?[0-9]"), "phone": F.instr(t, "+") > 0, "instance": t.rlike("[0-9]")}
    every = {**SHAPES, "instance": INSTANCE}
    found = rows.select(*keep, t.alias("text"), *(F.when(needs[k], F.regexp_extract_all(t, F.lit(p), F.lit(0))).otherwise(none).alias(f"_{k}") for k, p in every.items()))
    parted = found.select(*keep, *(f"_{k}" for k in every), *(F.when(F.size(f"_{k}") > 0, F.split("text", p, -1)).otherwise(none).alias(f"_{k}_parts") for k, p in every.items()))
    return parted.select(*keep, F.concat(*(_pieces(i, k) for i, k in enumerate(every))).alias("pieces"))


def instances(found: DataFrame, key: list[str]) -> DataFrame:
    """key, kind, start, end, instance, patterns and seed of each valid match, and of each other token that none of those overlaps."""
    flat = found.select(*key, F.inline("pieces")).repartition(*key)
    size = F.length("match")
    end = F.sum(F.col("gap") + size).over(Window.partitionBy(*key, "kind").orderBy("at")).cast("int")
    flat = flat.select("*", (end - size).alias("start"), end.alias("end"))
    ok = F.lit(False)
    for i, k in enumerate(KINDS):
        ok = ok | ((F.col("kind") == i) & valid(k, F.col("match")))
    flat = flat.select("*", ok.alias("base")).where(F.col("base") | (F.col("kind") == len(KINDS)))
    before, after = (Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1) for order in ((F.asc("start"), F.asc("kind")), (F.desc("start"), F.desc("kind"))))
    flat = flat.select("*", F.max(F.when(F.col("base"), F.col("end"))).over(before).alias("reach")).select("*", F.min(F.when(F.col("base"), F.col("start"))).over(after).alias("next"))
    apart = F.col("base") | ~(F.coalesce(F.col("reach") > F.col("start"), F.lit(False)) | F.coalesce(F.col("next") < F.col("end"), F.lit(False)))
    return flat.where(apart).select(*key, "kind", "start", "end", F.xxhash64("match").alias("instance"), _patterns(F.col("before"), F.col("after")).alias("patterns"), (F.col("base") | F.col("match").rlike(KEY)).alias("seed"))


def learn_patterns(found: DataFrame) -> DataFrame:
    """pattern: those whose instances score high after the rounds, over all occurrences."""
    seen = found.select(F.explode("patterns").alias("pattern"), "instance", F.col("seed").cast("double").alias("score"))
    edges = materialize(seen.groupBy("pattern", "instance").agg(F.max("score").alias("score")), "edges")
    apart = lambda c: F.col(c).bitwiseXOR(F.lit(0)).alias(c)  # noqa: E731  hides the partitioning, so that a hot key can be split
    patterns = None
    for k in range(ROUNDS):
        patterns = edges.groupBy("pattern").agg(F.avg("score").alias("mean"), F.count("*").alias("n")).where((F.col("n") >= SUPPORT) & (F.col("mean") >= CONFIDENCE))
        patterns = materialize(patterns, "patterns")
        if k + 1 < ROUNDS:
            # an instance has the chance that not all of its patterns are wrong
            missed = edges.join(patterns, "pattern").groupBy("instance").agg((1 - F.exp(F.sum(F.log(1.000001 - F.col("mean"))))).alias("now"))
            edges = materialize(edges.join(missed.select(apart("instance"), "now"), "instance", "left").select("pattern", "instance", F.greatest("score", F.coalesce("now", F.lit(0.0))).alias("score")), "edges")
    return patterns.select("pattern")


def find_spans(rows: DataFrame, key: list[str]) -> DataFrame:
    """rows' columns but text, with spans: kind (index in KINDS, 4 for other), start, end, in that order.

    Rows with the same key, which is never null, must have the same text.
    """
    found = materialize(occurrences(rows), "occurrences")
    every = materialize(instances(found, key), "instances")
    base = every.where(F.col("kind") < len(KINDS)).select(*key, "kind", "start", "end")
    fresh = every.where(F.col("kind") == len(KINDS)).select(*key, "kind", "start", "end", F.explode("patterns").alias("pattern"))
    more = fresh.join(learn_patterns(every), "pattern").select(*key, "kind", "start", "end").distinct()
    spans = base.union(more).groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("kind", "start", "end"))).alias("spans"))
    none = F.array().cast("array<struct<kind:int,start:int,end:int>>")
    rest = [c for c in found.columns if c != "pieces"]
    return found.select(*rest).join(spans, key, "left").select(*rest, F.coalesce("spans", none).alias("spans"))


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_other of each row of docs.

    A null or empty text has no spans, and the hash of the empty text. Rows
    with the same or a null id are searched each; no rows give no rows; other
    columns are ignored.
    """
    rows = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    out = find_spans(rows, ["row"])
    name = F.array(*map(F.lit, (*KINDS, "other")))
    said = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(name, x["kind"]), x["start"], x["end"])), ",")
    base = F.filter("spans", lambda x: x["kind"] < len(KINDS))
    number = lambda i: F.size(F.filter("spans", lambda x: x["kind"] == i)).cast("long")
    counts = [number(i).alias(f"n_{k}") for i, k in enumerate((*KINDS, "other"))]
    return out.select("doc_id", *counts[:4], F.sha2(said(base), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"), counts[4])


def mask(docs: DataFrame) -> DataFrame:
    """docs with every span replaced by its kind in brackets; all rows, all columns.

    Overlapping spans are replaced as one, by the kind that starts first. Texts
    without a digit or an @ have no spans and take no part in the join.
    """
    some = F.coalesce("text", F.lit("")).rlike("[0-9@]")
    key = lambda c: [F.xxhash64(c).alias("__h"), F.crc32(c.cast("binary")).alias("__c"), F.length(c).alias("__n")]
    names = ["__h", "__c", "__n"]
    spans = find_spans(docs.where(some).select("text", *key(F.col("text"))).dropDuplicates(names), names).where(F.size("spans") > 0)
    tag = F.array(*(F.lit(f"[{k.upper()}]") for k in (*KINDS, "other")))
    ordered = F.array_sort(F.transform("spans", lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))))
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        new = F.concat(acc["out"], F.array(F.substring(F.col("text"), acc["at"] + 1, x["start"] - acc["at"]), F.get(tag, x["kind"])))
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.when(x["start"] >= acc["at"], new).otherwise(acc["out"]).alias("out"))

    def end(acc: Column) -> Column:
        return F.concat(F.array_join(acc["out"], ""), F.substring(F.col("text"), acc["at"] + 1, F.length("text")))

    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__doc")  # other columns may have any names
    hit = docs.where(some).select(whole, "text", *key(F.col("text"))).join(spans.select(*names, ordered.alias("__spans")), names, "left")
    masked = F.when(F.col("__spans").isNotNull(), F.aggregate("__spans", first, step, end)).otherwise(F.col("text"))
    return docs.where(~some).union(hit.select(*(masked.alias(c) if c == "text" else F.col("__doc")[c].alias(c) for c in docs.columns)))
