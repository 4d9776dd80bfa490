"""Personal data by bootstrapped contextual extraction, with built-in functions only.

Seeds are the spans of fixed patterns (email, ip, card, phone). Seeds and identifier-like
tokens that no base span covers (with a digit, five characters or more) are instances;
the words about each give its lexical patterns: the word before, the two words before,
the word after, and the words on both sides. Patterns and instances make a graph, which
Spark scores in rounds: a pattern's score is the mean score of its occurrences, seeds
counting 1 and unconfirmed instances 0. A pattern with a score of CONFIDENT and SEEDS
different confirmed instances is confident; an instance that stands in one is confirmed
with the best such score, and counts for all its other patterns from the next round on.
So what one pattern finds induces the next. Rounds go on until one confirms nothing.
Confident patterns then extract the tokens in them: spans of the kind `context`.

Edges are summed before anything is joined, so a frequent word or identifier is one
row a pair; joins deal the rows of a key over parts; rounds are stored in the shared
folder.

Defined results: a null text is empty; rows that repeat a doc_id are searched each;
spans of different kinds may overlap; the words about an instance end at the next
instances of its kind, and a digit between a word and an instance parts them; of tied
pattern scores any is the best, as only the score counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, salted_join, stored
from .spans import kinds_of, let, listed, masked, matches, scanned

#: Fixed patterns, rewritten to be linear-time; the same leftmost non-overlapping matches.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: An identifier-like token: white space about it, a digit inside, five characters or more.
TOKEN = r"(?<!\S)(?=\S{5})[^\s0-9]*+[0-9]\S*+"
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"

BASE = ["email", "ip", "card", "phone"]
KINDS = [*BASE, "context"]
CONFIDENT, SEEDS = 0.5, 3


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of 12 to 19 digits passes the Luhn check."""
    n = F.length(digits)
    doubled = F.transform(
        F.sequence(F.lit(1), n),
        lambda i: (lambda d: F.when((n - i) % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d))(F.substring(digits, i, F.lit(1)).cast("int")),
    )
    return F.coalesce(F.when(n.between(12, 19), F.aggregate(doubled, F.lit(0), lambda a, b: a + b) % 10 == 0), F.lit(False))


def base_spans(text: Column, near: bool = False) -> dict[str, Column]:
    """Matches of each base kind that meet its condition."""
    return {
        "email": matches(text, EMAIL, text.contains("@"), near),
        "ip": F.filter(matches(text, IP, text.contains("."), near), lambda x: x["hit"].rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")),
        "card": F.filter(matches(text, CARD, text.rlike(r"[0-9](?:[\x20-]?[0-9]){11}"), near), lambda x: luhn(_digits(x["hit"]))),
        "phone": F.filter(matches(text, PHONE, text.contains("+"), near), lambda x: F.length(_digits(x["hit"])).between(9, 15)),
    }


def _instance(x: Column, seed: bool) -> Column:
    """start, end, token, patterns, seed of a match."""
    token = F.regexp_replace(F.lower(x["hit"]), r"^[^\p{L}\p{N}]++|(?<![^\p{L}\p{N}])[^\p{L}\p{N}]++$", "")
    left, wide, right = (x["near"][c] for c in ("left", "wide", "right"))
    some = [
        F.when(left != "", F.concat(left, F.lit(" _"))),
        F.when(wide != "", F.concat(wide, F.lit(" _"))),
        F.when(right != "", F.concat(F.lit("_ "), right)),
        F.when((left != "") & (right != ""), F.concat(left, F.lit(" _ "), right)),
    ]
    return F.struct(x["start"].alias("start"), x["end"].alias("end"), token.alias("token"), F.array_compact(F.array(*some)).alias("patterns"), F.lit(seed).alias("seed"))


def _searched(docs: DataFrame, doc_id: Column, text: Column) -> DataFrame:
    """row, doc_id, counts, base spans and instances of each text, stored."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), doc_id.alias("doc_id"), F.coalesce(text.cast("string"), F.lit("")).alias("text"))
    found = rows.select("row", "doc_id", *[c.alias(k) for k, c in base_spans(F.col("text"), True).items()], matches(F.col("text"), TOKEN, near=True).alias("tokens"))
    found = found.withColumn("base", kinds_of({k: F.col(k) for k in BASE}, BASE))
    free = apart(F.col("tokens"), F.col("base"))
    seeds = [F.transform(k, lambda x: _instance(x, True)) for k in BASE]
    return stored(found.select("row", "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE], "base", F.concat(*seeds, F.transform(free, lambda x: _instance(x, False))).alias("instances")), "pii")


def apart(tokens: Column, spans: Column) -> Column:
    """The tokens that no span overlaps: in order of start, no span before one ends after its start, and the next begins after it."""
    far = F.lit((1 << 31) - 1)

    def kept(x: Column) -> Column:
        left = F.transform(x["all"], lambda m: F.when(m["rank"] == 0, m["end"]).otherwise(0))
        right = F.reverse(F.transform(x["all"], lambda m: F.when(m["rank"] == 0, m["start"]).otherwise(far)))
        ends = let(left, lambda v: scanned(v, lambda a, b: F.greatest(a, b)))
        starts = F.reverse(let(right, lambda v: scanned(v, lambda a, b: F.least(a, b))))
        return let(F.struct(x["all"].alias("all"), x["tokens"].alias("tokens"), ends.alias("ends"), starts.alias("starts")), free)

    def free(y: Column) -> Column:
        own = F.filter(y["all"], lambda m, i: (m["rank"] == 1) & (F.get(y["ends"], i) <= m["start"]) & (F.get(y["starts"], i) >= m["end"]))
        return F.transform(own, lambda m: F.get(y["tokens"], m["at"]))

    one = lambda x, rank, at: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), at.alias("at"))
    every = F.array_sort(F.concat(F.transform(spans, lambda s: one(s, 0, F.lit(0))), F.transform(tokens, lambda t, i: one(t, 1, i))))
    return F.when((F.size(spans) > 0) & (F.size(tokens) > 0), let(F.struct(every.alias("all"), tokens.alias("tokens")), kept)).otherwise(tokens)


def occurrences(found: DataFrame) -> DataFrame:
    """row, start, end, token, patterns, seed: every instance that has a pattern."""
    return found.filter(F.size("instances") > 0).select("row", F.explode("instances").alias("c")).select("row", "c.*").filter((F.size("patterns") > 0) & (F.col("token") != ""))


def patterns(seen: DataFrame) -> DataFrame:
    """pattern, score: the confident patterns, at the fixed point."""
    edges = seen.select(F.explode("patterns").alias("pattern"), "token", "seed").groupBy("pattern", "token").agg(F.count("*").alias("n"), F.max("seed").cast("double").alias("s"))
    edges = stored(edges, "edges")
    while True:
        score = (F.sum(F.col("n") * F.col("s")) / F.sum("n")).alias("score")
        every = edges.groupBy("pattern").agg(score, F.count_if(F.col("s") > 0).alias("held"))
        sure = stored(every.filter((F.col("score") >= CONFIDENT) & (F.col("held") >= SEEDS)).select("pattern", "score"), "patterns")
        new = stored(salted_join(edges.filter("s = 0"), sure, "pattern", "token").groupBy("token").agg(F.max("score").alias("best")), "confirmed")
        if new.isEmpty():
            return sure
        s = F.when(F.col("s") > 0, F.col("s")).otherwise(F.coalesce("best", F.lit(0.0))).alias("s")
        edges = stored(salted_join(edges, new, "token", "pattern", "left").select("pattern", "token", "n", s), "edges")


def extracted(docs: DataFrame, doc_id: Column, text: Column) -> DataFrame:
    """row, doc_id, n_*, base, more: base spans and those that the method adds."""
    found = _searched(docs, doc_id, text)
    seen = stored(occurrences(found), "instances")
    open_ = seen.filter("not seed").select("row", "start", "end", F.explode("patterns").alias("pattern"))
    span = F.struct("start", F.lit(len(BASE)).alias("rank"), "end", F.lit("context").alias("kind"))
    new = salted_join(open_, patterns(seen), "pattern", "row").groupBy("row").agg(F.collect_set(span).alias("more"))  # within one text
    return found.drop("instances").join(new, "row", "left").withColumn("more", F.coalesce("more", F.filter("base", lambda x: F.lit(False))))


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    found = extracted(docs, F.col("doc_id"), F.col("text"))
    both = F.array_sort(F.concat("base", "more"))
    return found.select("doc_id", *[f"n_{k}" for k in BASE], F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(both).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """The documents with every span of their texts replaced by its kind in brackets; n_chars follows the text.

    Spans return to their rows by two hashes of id and text, which stay the same however the rows are read
    again; rows alike in both have the same spans. The join is a merge at every size, as the texts are its
    larger side and the spans have no bound.
    """
    key = [F.xxhash64("doc_id", "text"), F.xxhash64(F.lit(1), "text", "doc_id")]
    k1, k2, mark = fresh(docs, "_k1", "_k2", "_spans")
    found = extracted(docs, F.struct(key[0].alias("a"), key[1].alias("b")), F.col("text")).filter((F.size("base") > 0) | (F.size("more") > 0))
    marks = found.select(F.col("doc_id.a").alias(k1), F.col("doc_id.b").alias(k2), F.array_sort(F.concat("base", "more")).alias(mark)).dropDuplicates([k1, k2])
    rows = docs.withColumns({k1: key[0], k2: key[1]}).join(marks.hint("merge"), [k1, k2], "left")
    text = F.when(F.col(mark).isNull(), F.col("text")).otherwise(masked(F.col("text"), F.col(mark)))
    rows = rows.withColumn("text", text)
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.col(mark).isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])
