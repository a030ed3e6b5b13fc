"""Text primitives as Column expressions; nothing here leaves the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SENTENCE = r"[^。！？.!?\n]+[。！？.!?\n]?"


def tokens(text: Column, shortest: int = 2, stopwords: tuple[str, ...] = ()) -> Column:
    """Lower-case runs of letters and digits of at least `shortest` characters, stop words left out."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    kept = F.filter(words, lambda w: F.length(w) >= shortest)
    return F.filter(kept, lambda w: ~w.isin(*stopwords)) if stopwords else kept


def token_set(text: Column) -> Column:
    """Distinct tokens; null where there is none."""
    found = F.array_distinct(tokens(text))
    return F.when(F.size(found) > 0, found)


def bigrams(words: Column) -> Column:
    """Distinct pairs of neighbouring tokens, joined."""
    # No lambda refers to `words` itself, which would be evaluated again for each element.
    pairs = F.zip_with(words, F.slice(words, F.lit(2), F.greatest(F.size(words), F.lit(1))), lambda a, b: F.concat(a, b))
    return F.array_distinct(F.filter(pairs, lambda p: p.isNotNull()))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays without repeats; 0 where either is empty or null."""
    both = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(both.cast("double"), F.size(a) + F.size(b) - both), F.lit(0.0))


def overlap(a: Column, b: Column) -> Column:
    """The share of a that is in b; 0 where a is empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(a)), F.lit(0.0))


def sentences(text: Column, longest_dropped: int = 3) -> Column:
    """Sentences with their end mark, trimmed; very short ones are dropped."""
    found = F.transform(F.regexp_extract_all(text, F.lit(SENTENCE), 0), lambda s: F.trim(s))
    return F.filter(found, lambda s: F.length(s) > longest_dropped)


def replace_terms(text: Column, terms: dict[str, str]) -> Column:
    """Replaces each variant by its standard term, longest first; equal lengths in the order given."""
    order = sorted(terms.items(), key=lambda kv: -len(kv[0]))
    return reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), order, text)


def cut_at_sentence(text: Column, limit: int, mark: str = " [cut]") -> Column:
    """At most `limit` characters: up to the last sentence end if that lies beyond half, else with an ellipsis."""
    head = F.substring(text, 1, limit)
    whole = F.regexp_extract(head, r"(?s)^(.*[.!?。！？\n])", 1)
    return (
        F.when(F.length(text) <= limit, text)
        .when(F.length(whole) > limit / 2, F.concat(whole, F.lit(mark)))
        .otherwise(F.concat(head, F.lit("...")))
    )


def document_name(path: Column) -> Column:
    """The last part of a path without its extension, lower case."""
    last = F.element_at(F.split(path, "/"), -1)
    return F.lower(F.trim(F.regexp_replace(last, r"\.(md|txt|pdf)$", "")))


def first_int(text: Column) -> Column:
    """The first whole number in a text; null without one."""
    return F.nullif(F.regexp_extract(text, r"(\d{1,9})", 1), F.lit("")).cast("int")


def numbers(text: Column) -> Column:
    """Numbers as they are written."""
    return F.regexp_extract_all(text, F.lit(r"\d+(?:\.\d+)?"), 0)


def without_reasoning(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)^\s*<think>.*?</think>\s*", "")


def json_part(text: Column) -> Column:
    """The outermost array or object in a model's answer, without code fences."""
    bare = F.regexp_replace(text, r"```(?:json)?", "")
    return F.regexp_extract(bare, r"(?s)(\[.*\]|\{.*\})", 1)


def permutation(answer: Column, n: Column) -> Column:
    """A ranking from a model's answer: integers from 1 to n, first mention counts, missing ones appended in order."""
    said = F.transform(F.regexp_extract_all(answer, F.lit(r"\d{1,9}"), 0), lambda x: x.cast("int"))
    valid = F.array_distinct(F.filter(said, lambda x: (x >= 1) & (x <= n)))
    return F.concat(valid, F.array_except(F.sequence(F.lit(1), n), valid))


def age_range(text: Column) -> Column:
    """struct(low, high) of "0-60"; both the first whole number where there is no range; null without one."""
    pattern = r"(\d{1,9})\s*[-~到]\s*(\d{1,9})"
    part = lambda n: F.nullif(F.regexp_extract(text, pattern, n), F.lit("")).cast("int")
    return F.struct(F.coalesce(part(1), first_int(text)).alias("low"), F.coalesce(part(2), first_int(text)).alias("high"))


# Chinese numerals as an article's number reads them, one after the other.
NUMERALS = dict(zip("一二三四五六七八九十百千", (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 100, 1000), strict=True))


def article_key(number: Column) -> Column:
    """struct(other, n, text), which sorts articles: numbered ones first, by their Arabic or Chinese number (each numeral adds
    to ten times what came before), then the others by their text."""
    said = F.regexp_extract(number, r"第([一二三四五六七八九十百千\d]+)[条项]", 1)
    values = F.create_map(*(x for k, v in NUMERALS.items() for x in (F.lit(k), F.lit(v))))
    digit = lambda c: F.coalesce(F.try_element_at(values, c), F.lit(0)).cast("long")
    spoken = F.aggregate(F.split(said, ""), F.lit(0).cast("long"), lambda a, c: F.when(c == "", a).otherwise(a * 10 + digit(c)))
    n = F.when(said.rlike(r"^\d+$"), said.try_cast("long")).otherwise(spoken)
    numbered = said != ""
    return F.struct((~numbered).cast("int").alias("other"), F.when(numbered, n).alias("n"), F.when(~numbered, number).alias("text"))


# What a regulation's name holds besides its subject: numbers of issue, then the offices that issue it.
ISSUES = (
    r"[（(][^）)]*[发函公告号令][^）)]*[）)]",
    r"(?:银保监|保监|金寿险|国金|金融|保险)?(?:办|会)?(?:发|函)\s*[〔\[]?\d+[\]〕]?\s*号",
    r"\d{4}年第\d+号",
    r"通知公告\d{4}[-/]\d{1,2}[-/]\d{1,2}",
    r"中国(?:银行)?保险监督管理委员会(?:办公厅|人身险监管部)?",
    r"中国(?:银行)?保监会(?:办公厅)?",
    r"国家金融监督管理总局(?:人身险司)?",
    r"中国银保监会(?:办公厅)?",
    r"中国保监会(?:办公厅)?",
    r"原中国(?:银行)?保监会(?:办公厅)?",
    r"银保监会(?:办公厅)?",
    r"保监会(?:办公厅)?",
    r"\s+",
)


def regulation_name(name: Column, patterns: tuple[str, ...] = ISSUES) -> Column:
    """The name without offices, numbers of issue and white space; as it is, where nothing else is left."""
    bare = reduce(lambda c, p: F.regexp_replace(c, p, ""), patterns, name)
    return F.coalesce(F.nullif(F.regexp_replace(bare, "^[_：: -]+|[_：: -]+$", ""), F.lit("")), name)


def file_name(name: Column, most: int = 240) -> Column:
    """The name as a file's: without signs, white space as _, at most `most` bytes of whole characters."""
    bare = F.regexp_replace(name, "[<>:\"/\\\\|?*（）【】《》、，。！？；：'…—〔〕「」]", "")
    bare = F.regexp_replace(F.regexp_replace(bare, r"\s*&\s*", "&"), r"\s+", "_")
    cut = F.make_valid_utf8(F.substring(bare.cast("binary"), 1, most).cast("string"))
    whole = F.when(F.octet_length(bare) <= most, bare).otherwise(F.regexp_replace(cut, "\ufffd+$", ""))
    return F.regexp_replace(whole, "^_+|_+$", "")


def cache_key(scope: Column, text: Column) -> Column:
    """scope:digest, of the scope and the text together."""
    return F.concat(scope, F.lit(":"), F.sha2(F.concat(scope, F.lit(":"), text), 256))
