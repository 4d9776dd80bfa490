"""Places of regular expressions in texts, with built-in functions only.

The pieces between matches (split) and the matches themselves (regexp_extract_all)
come from the same left-to-right search, so running sums of their lengths are the
places, in code points. Running sums and maxima are doubling scans, so a text with n
matches takes n log n steps. Patterns must be linear-time on any text: possessive
quantifiers, and a look-behind that lets a run be tried from its start alone. \\G
there keeps the place right after a match a legal start, as it is for plain patterns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Code points in the pieces that a text is cut into before spans are replaced.
PIECE = 1024
_TYPE = "array<struct<start:int,end:int,hit:string>>"
_WIDE = "array<struct<start:int,end:int,hit:string,near:struct<left:string,wide:string,right:string>>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def scanned(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """Running results of an associative operation, by doubling distances."""
    steps = F.array(*[F.lit(1 << k) for k in range(31)])

    def step(s: Column, p: Column) -> Column:
        return F.transform(s, lambda x, i: F.when(i >= p, op(F.get(s, i - p), x)).otherwise(x))

    return F.aggregate(F.filter(steps, lambda p: p < F.size(values)), values, step)


def words_near(before: Column, after: Column) -> Column:
    """The word before a place, the two words before it, and the word after it; '' without."""
    last = F.regexp_extract(before, r"(?<!\p{L})(\p{L}++)[^\p{L}\p{N}]*+$", 1)
    other = F.regexp_extract(before, r"(?<!\p{L})(\p{L}++)[^\p{L}\p{N}]++\p{L}++[^\p{L}\p{N}]*+$", 1)
    wide = F.when(other != "", F.concat(other, F.lit(" "), last)).otherwise("")
    right = F.regexp_extract(after, r"^[^\p{L}\p{N}]*+(\p{L}++)", 1)
    return F.struct(F.lower(last).alias("left"), F.lower(wide).alias("wide"), F.lower(right).alias("right"))


def matches(text: Column, pattern: str, needs: Column | None = None, near: bool = False) -> Column:
    """All leftmost non-overlapping matches: start, end, hit and, with `near`, the words about each, up to the next matches.

    `needs` is a cheap condition without which there is none.
    """
    kind = _WIDE if near else _TYPE
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    both = F.struct(hits.alias("hits"), F.split(text, pattern, -1).alias("gaps"))

    def one(x: Column, hit: Column, end: Column, i: Column) -> Column:
        more = [words_near(F.get(x["gaps"], i), F.get(x["gaps"], i + 1)).alias("near")] if near else []
        return F.struct((end - F.length(hit)).alias("start"), end.alias("end"), hit.alias("hit"), *more)

    def placed(x: Column) -> Column:
        longs = F.transform(x["hits"], lambda h, i: F.length(h) + F.length(F.get(x["gaps"], i)))
        ended = F.struct(x["hits"].alias("hits"), x["gaps"].alias("gaps"), let(longs, lambda n: scanned(n, lambda a, b: a + b)).alias("ends"))
        return let(ended, lambda y: F.transform(y["hits"], lambda h, i: one(y, h, F.get(y["ends"], i), i)))

    found = F.when(text.rlike(pattern), let(both, placed))
    return F.coalesce(found if needs is None else F.when(needs, found), F.array()).cast(kind)


def kinds_of(found: dict[str, Column], order: list[str]) -> Column:
    """One array of start, rank, end, kind, in order of start, then of kind as listed."""

    def ranked(kind: str, column: Column) -> Column:
        rank = order.index(kind)
        return F.transform(column, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), F.lit(kind).alias("kind")))

    return F.array_sort(F.concat(*[ranked(k, c) for k, c in found.items()]))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def masked(text: Column, spans: Column) -> Column:
    """The text with every span, or run of overlapping spans, replaced by its first kind in brackets. spans: sorted."""

    def cut(x: Column, a: Column, b: Column) -> Column:
        i, j = F.floor(a / PIECE).cast("int"), F.floor(b / PIECE).cast("int")
        return F.substring(F.array_join(F.slice(x["pieces"], i + 1, j - i + 1), ""), a - i * PIECE + 1, b - a)

    def replaced(x: Column) -> Column:
        first = F.filter(x["spans"], lambda s, i: (i == 0) | (s["start"] >= F.get(x["ends"], i - 1)))  # the first of each run
        last = F.filter(x["ends"], lambda e, i: F.coalesce(F.get(x["spans"], i + 1)["start"] >= e, F.lit(True)))
        return let(F.struct(x["pieces"].alias("pieces"), x["n"].alias("n"), first.alias("first"), last.alias("last")), put)

    def put(y: Column) -> Column:
        parts = F.transform(y["first"], lambda s, j: F.concat(cut(y, F.when(j > 0, F.get(y["last"], j - 1)).otherwise(0), s["start"]), F.lit("["), F.upper(s["kind"]), F.lit("]")))
        return F.concat(F.array_join(parts, ""), cut(y, F.element_at(y["last"], -1), y["n"]))

    ends = let(F.transform(spans, lambda s: s["end"]), lambda e: scanned(e, lambda a, b: F.greatest(a, b)))
    pieces = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{PIECE}}}"), F.lit(0))
    whole = F.struct(spans.alias("spans"), ends.alias("ends"), pieces.alias("pieces"), F.length(text).alias("n"))
    return F.when(F.size(spans) > 0, let(whole, replaced)).otherwise(text)
