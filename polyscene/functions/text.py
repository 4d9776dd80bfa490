"""Text, key and time functions as Column expressions; no Python runs on executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dims import STOPWORDS

#: Word edges for letters of any script.
EDGE, END = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
#: White space that patterns here treat as such.
SPACE = r"[ \t\n\r\f]"
MODALITY = "rgb|ir|event|depth|audio"
NUMBER_WORDS = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten"]
DIRECTIONS = ["left", "right", "above", "below", "front", "behind", "before", "after"]
ARTICLE = r"(?i)^(?:a|an|the) +"
TRAILING = ["on", "in", "at", "to", "from", "by", "of", "with", "for", "a", "an", "the", "and", "or", "as", "but"]
SEPARATORS = [", followed by", ". ", ",", " and ", " or ", " while ", " as ", " because ", " which "]


def _words(*names: str) -> Column:
    return F.array(*map(F.lit, names))


def stripped(c: Column, chars: str) -> Column:
    """Without leading and trailing characters of a regex class body."""
    return F.regexp_replace(c, f"^[{chars}]+|[{chars}]+$", "")


def clean(c: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, f"{SPACE}+", " "))


def tokens(c: Column) -> Column:
    """Distinct lower-case ASCII words of two characters or more that are no stopwords."""
    # runs of two or more; no lambda, so that the whole expression is compiled
    found = F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]{2,}"), F.lit(0))
    return F.coalesce(F.sort_array(F.array_except(found, _words(*dict.fromkeys(STOPWORDS)))), F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct tokens; 0 if either side is empty. Both are sets."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def token_keys(tokens: Column) -> Column:
    """64-bit hashes of tokens: sets of numbers intersect several times faster than sets of strings."""
    return F.transform(tokens, lambda t: F.xxhash64(t))


def sentences(c: Column) -> Column:
    return F.filter(F.transform(F.split(clean(c), r"(?<=[.!?]) +"), lambda x: F.trim(x)), lambda s: s != "")


def numbered_items(c: Column) -> Column:
    """number, item of texts with two or more markers such as `1.`; the text before the first is dropped."""
    text = clean(c)
    marks = F.regexp_extract_all(text, F.lit(r"(?:^| )([0-9]+)\. *"), F.lit(1))
    parts = F.split(text, r"(?:^| )[0-9]+\. *", -1)
    items = F.zip_with(marks, F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda n, p: F.struct(n.try_cast("int").alias("number"), clean(stripped(p, " .;")).alias("item")))
    none = F.array().cast("array<struct<number:int,item:string>>")
    return F.when(F.size(marks) >= 2, F.filter(items, lambda x: x["item"] != "")).otherwise(none)


def fused_pairs(question: Column, answer: Column) -> Column:
    """number, question, answer: paired by number, else by place if as many, else whole; empty without both."""
    q, a = numbered_items(question), numbered_items(answer)
    kind = "array<struct<number:int,question:string,answer:string>>"
    whole = F.when((question != "") & (answer != ""), F.array(F.struct(F.lit(None).cast("int").alias("number"), question.alias("question"), answer.alias("answer")))).otherwise(F.array().cast(kind))
    matched = F.filter(F.transform(q, lambda x: F.struct(x["number"].alias("number"), x["item"].alias("question"), F.try_element_at(F.filter(a, lambda y: y["number"] == x["number"]), F.lit(-1))["item"].alias("answer"))), lambda x: x["answer"].isNotNull())
    placed = F.zip_with(q, a, lambda x, y: F.struct(x["number"].alias("number"), x["item"].alias("question"), y["item"].alias("answer")))
    split = F.when(F.size(matched) > 0, matched).when(F.size(q) == F.size(a), placed).otherwise(whole)
    return F.when((F.size(q) == 0) | (F.size(a) == 0), whole).otherwise(split)


def numbered_text(c: Column) -> Column:
    """Items after markers such as `1.` or `1)` with white space behind; the whole text without one."""
    text = F.trim(c)
    parts = F.split(text, rf"(?:^|{SPACE})[0-9]+[.)]{SPACE}+", -1)
    items = F.filter(F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(text == "", F.array().cast("array<string>")).when(F.size(parts) < 2, F.array(text)).otherwise(items)


def question_items(c: Column) -> Column:
    text, numbered = F.trim(c), numbered_text(c)
    parts = F.filter(F.transform(F.split(text, r"\?", -1), lambda x: F.trim(x)), lambda x: x != "")
    asked = F.transform(parts, lambda x: F.concat(x, F.lit("?")))
    return F.when(text == "", F.array().cast("array<string>")).when(F.size(numbered) > 1, numbered).when(F.size(asked) > 1, asked).otherwise(F.array(text))


def answer_items(c: Column) -> Column:
    text, numbered = F.trim(c), numbered_text(c)
    parts = F.filter(F.transform(F.split(text, rf"(?<=[.!?]){SPACE}+", -1), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(text == "", F.array().cast("array<string>")).when(F.size(numbered) > 1, numbered).when(F.size(parts) > 1, parts).otherwise(F.array(text))


def exported_pairs(question: Column, answer: Column) -> Column:
    """question, answer paired by place, the shorter side padded with ''."""
    q = question_items(question)
    a = F.when(F.size(q) > 1, answer_items(answer)).otherwise(numbered_text(answer))
    pairs = F.zip_with(q, a, lambda x, y: F.struct(F.coalesce(x, F.lit("")).alias("question"), F.coalesce(y, F.lit("")).alias("answer")))
    return F.filter(pairs, lambda p: (p["question"] != "") | (p["answer"] != ""))


def number_tokens(c: Column) -> Column:
    low = F.lower(c)
    digits = F.regexp_extract_all(low, F.lit(f"{EDGE}([0-9]+){END}"), F.lit(1))
    words = F.regexp_extract_all(low, F.lit("[a-z]+"), F.lit(0))
    return F.array_sort(F.array_distinct(F.concat(digits, F.array_intersect(words, _words(*NUMBER_WORDS)))))


def direction_tokens(c: Column) -> Column:
    return F.array_sort(F.array_intersect(F.regexp_extract_all(F.lower(c), F.lit("[a-z]+"), F.lit(0)), _words(*DIRECTIONS)))


def polarity_tokens(c: Column) -> Column:
    low = F.lower(c)
    yes = F.when(low.rlike(f"{EDGE}(?:yes|true|visible|present){END}"), F.lit("positive"))
    no = F.when(low.rlike(f"{EDGE}(?:no|false|not|none|absent|invisible|without){END}"), F.lit("negative"))
    return F.array_sort(F.array_compact(F.array(yes, no)))


def conflict(a: Column, b: Column) -> Column:
    """Both token sets hold something and differ."""
    return (F.size(a) > 0) & (F.size(b) > 0) & (a != b)


def yes_no(c: Column) -> Column:
    return F.lower(clean(c)).isin("yes", "no", "true", "false")


def looks_like_question(c: Column) -> Column:
    return F.lower(clean(c)).rlike("^(?:what|where|when|which|how|why|is|are|do|does|did|was|were) ")


def first_fragment(c: Column) -> Column:
    """The first item of an answer."""
    text = stripped(clean(c), " .,:;")
    parts = F.filter(F.transform(F.split(text, r" *[0-9]+\. *", -1), lambda p: stripped(p, " .,:;")), lambda p: p != "")
    return F.when(F.size(parts) > 0, F.try_element_at(parts, F.lit(1))).otherwise(text)


def trim_answer(c: Column, most: int = 8) -> Column:
    """A short answer: no article, one sentence or phrase, at most so many words, no dangling preposition."""
    text = F.regexp_replace(clean(stripped(c, " .,:;")), ARTICLE, "")
    sentence = stripped(F.regexp_extract(text, r"[^.!?]*[.!?]", 0), " .!?,;")
    ends = text.rlike("[.!?]") & ((F.size(F.split(sentence, " ")) <= most) | (sentence == ""))
    phrase = text
    for s in reversed(SEPARATORS):
        phrase = F.when(F.instr(text, s) > 0, F.trim(F.substring_index(text, s, 1))).otherwise(phrase)
    words = F.split(F.trim(phrase), " +")
    cut = F.array_join(F.slice(words, 1, most), " ")
    neat = F.regexp_replace(cut, rf"(?i)(?: (?:{'|'.join(TRAILING)}))+$", "")
    short = F.when(F.size(words) <= most, F.array_join(words, " ")).otherwise(neat)
    return F.when(text == "", F.lit("")).when(ends, sentence).otherwise(stripped(short, " .,:;"))


def timestamp(seconds: Column) -> Column:
    """HH:MM:SS.mmm; not below zero, hours not wrapped."""
    ms = F.bround(F.greatest(seconds, F.lit(0.0)) * 1000).cast("long")
    parts = [(F.floor(ms / 3600000)), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60]
    two = [F.when(p < 100, F.lpad(p.cast("string"), 2, "0")).otherwise(p.cast("string")) for p in parts]
    return F.concat(F.concat_ws(":", *two), F.lit("."), F.lpad((ms % 1000).cast("string"), 3, "0"))


def slug(c: Column) -> Column:
    """Lower case, runs of other characters than letters and digits as _, qa_pair if nothing stays."""
    s = stripped(F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), "[^a-z0-9]+", "_"), "_")
    return F.when(s == "", F.lit("qa_pair")).otherwise(s)


def without_fence(c: Column) -> Column:
    """Without a Markdown code fence about the text."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(c), r"^```[a-zA-Z]*[ \n]*", ""), r"[ \n]*```$", ""))


def json_object(c: Column) -> Column:
    """From the first { to the last }; null without."""
    found = F.regexp_extract(without_fence(c), r"(?s)\{.*\}", 0)
    return F.when(found != "", found)


def json_list(c: Column) -> Column:
    """From the first [ to the last ]; null without."""
    found = F.regexp_extract(without_fence(c), r"(?s)\[.*\]", 0)
    return F.when(found != "", found)


def base_name(c: Column) -> Column:
    return F.element_at(F.split(F.replace(c, F.lit("\\"), F.lit("/")), "/"), -1)


def fusion_key(c: Column) -> Column:
    """The sample of a raw key: lower-case stem without modality and day or night, _ for -."""
    stem = F.lower(F.regexp_replace(base_name(c), r"(?<=.)\.[^.]*$", ""))
    for pattern in (rf"_(?:{MODALITY})$", rf"^(?:{MODALITY})_", "_(?:night|day)$", "^(?:night|day)_", rf"_(?:night|day)_(?:{MODALITY})$"):
        stem = F.regexp_replace(stem, pattern, "")
    stem = stripped(F.regexp_replace(F.replace(stem, F.lit("-"), F.lit("_")), "_+", "_"), "_")
    return F.when(stem != "", stem).otherwise(F.replace(F.lower(c), F.lit("\\"), F.lit("/")))


def reasoning_key(c: Column) -> Column:
    """The last part of a raw key without one modality suffix; case stays."""
    return F.regexp_replace(base_name(c), rf"_(?:{MODALITY})$", "")


def pair_key(c: Column) -> Column:
    """A path with day and night taken out of its stem; the folder stays."""
    path = F.replace(c, F.lit("\\"), F.lit("/"))
    stem = F.lower(F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", ""))
    stem = stripped(F.regexp_replace(F.regexp_replace(F.regexp_replace(stem, "_night|_day", ""), "night|day", ""), "__+", "_"), "_")
    folder = F.regexp_extract(path, "^(.*)/[^/]*$", 1)
    return F.when(folder != "", F.concat(folder, F.lit("/"), stem)).otherwise(stem)


def section_name(c: Column) -> Column:
    """Lower case; audio sections without a number at the end."""
    s = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return F.when(s.startswith("audio_"), F.regexp_replace(s, "_[0-9]+$", "")).otherwise(s)
