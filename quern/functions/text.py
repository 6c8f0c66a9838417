"""Tokenisers and string functions as columns. Word characters are Unicode letters, digits and underscores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

W = r"\p{L}\p{N}_"

# Stop words of the lexical reranker, coverage and diversity.
CONTENT_STOP = """a an the and or but is are was were be been being of in on at to for with by from as it this that these those
what which who how why when where do does did i you we they he she them""".split()
# Stop words of the weighted reranker lack these three.
RERANK_STOP = [w for w in CONTENT_STOP if w not in ("being", "which", "who")]
# Stop words of keyword search have one more.
KEYWORD_STOP = [*CONTENT_STOP, "like"]
# Stop words of query cleaning.
QUERY_STOP = """a an the and or but is are was were be been being of in on at to for with by from as it this that these those
what which who how why when where do does did i you we they he she them im me my your our us his her its their
can could would should will may might must have has had want wants wanted need needs tell give show ask asking thinking wondering
please kindly just really actually basically curious wonder wondered precisely exactly briefly detailed detail thanks thank thx""".split()


def strings(words: list[str]) -> Column:
    return F.array(*(F.lit(w) for w in words)) if words else F.array().cast("array<string>")


def squeeze(text: Column) -> Column:
    """White space runs as one space, ends trimmed."""
    # a run that is one space stays as it is: it is no match
    return F.trim(F.regexp_replace(text, r" \s+|[\t\n\x0B\f\r]\s*", " "))


def tokens(text: Column) -> Column:
    """Lower-cased words, apostrophes included."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(rf"[{W}']+"), F.lit(0))


def content_terms(text: Column, stop: list[str] = CONTENT_STOP) -> Column:
    """The set of lower-cased words of two characters or more that are no stop words."""
    return F.array_except(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(rf"[{W}']{{2,}}"), F.lit(0)), strings(stop))


def rerank_terms(text: Column) -> Column:
    return content_terms(text, RERANK_STOP)


def keyword_tokens(text: Column) -> Column:
    """ASCII words for keyword search, with repeats."""
    return phrase_tokens(keyword_phrase(text))


def phrase_tokens(phrase: Column) -> Column:
    """The words for keyword search of a keyword_phrase."""
    return F.filter(F.split(phrase, " "), lambda t: (F.length(t) >= 2) & ~t.isin(KEYWORD_STOP))


def keyword_phrase(text: Column) -> Column:
    """All ASCII words, lower-cased, joined by one space."""
    return F.lower(F.array_join(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[A-Za-z0-9_']+"), F.lit(0)), " "))


def ascii_word_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[A-Za-z0-9_']+"), F.lit(0)))


def query_words(text: Column) -> Column:
    """Words that begin and end with a word character, in their own case."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"[{W}](?:[{W}']*[{W}])?"), F.lit(0))


def query_terms(text: Column) -> Column:
    """Content words of a query in order, first of each spelling but for case."""
    words = F.filter(query_words(text), lambda t: (F.length(t) >= 2) & ~F.lower(t).isin(QUERY_STOP))
    return distinct_ignoring_case(words)


def distinct_ignoring_case(words: Column) -> Column:
    low = F.transform(words, lambda x: F.lower(x))
    return F.filter(words, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)


def with_shingles(df: DataFrame, text: str, out: str, n: int = 4) -> DataFrame:
    """Adds the set of n-word shingles; a shorter text is one shingle; no words give none. Words are a column of their own, found once."""
    t = f"__{out}_t"
    x = df.withColumn(t, tokens(F.col(text)))
    many = F.transform(F.sequence(F.lit(1), F.greatest(F.size(t) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(F.col(t), i, n), " "))
    return x.withColumn(out, F.when(F.size(t) == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(many))).drop(t)


def sentences(text: Column) -> Column:
    """Sentences end at . ! or ? before white space, and at line ends."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])\s+|\n+"), lambda s: F.trim(s)), lambda s: s != "")


def prose_sentences(text: Column) -> Column:
    """Sentences end at . ! or ? before white space and a capital, digit, quote or parenthesis."""
    return F.filter(F.transform(F.split(squeeze(text), r"(?<=[.!?])\s+(?=[A-Z0-9\"'(])"), lambda s: F.trim(s)), lambda s: s != "")


def jaccard(a: Column, b: Column) -> Column:
    """0 where either set is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def estimate_tokens(text: Column) -> Column:
    """A quarter of the characters, rounded up; nothing for empty texts."""
    n = F.length(F.coalesce(text, F.lit("")))
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.ceil(n / 4))).cast("long")


def stored_tokens(text: Column) -> Column:
    """A quarter of the characters, rounded down, 1 at least."""
    return F.greatest(F.lit(1), F.floor(F.length(F.coalesce(text, F.lit(""))) / 4)).cast("long")


def uuid5_url(name: Column) -> Column:
    """UUID version 5 in the URL namespace."""
    space = F.unhex(F.lit("6ba7b8119dad11d180b400c04fd430c8"))
    h = F.sha1(F.concat(space, F.encode(name, "UTF-8")))
    hex_digit = F.substring(h, 17, 1)
    high = F.element_at(F.array(*(F.lit(x) for x in "89ab")), (F.conv(hex_digit, 16, 10).cast("int") % 4 + 1).cast("int"))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), high, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def source_id(path: Column) -> Column:
    return F.concat(F.lit("file:"), F.substring(F.sha1(path), 1, 12))


def verbatim_share(candidate: Column, source: Column, ratio: float = 0.5) -> Column:
    """Whether so many of the candidate's lines are verbatim in the source, white space aside."""
    lines = F.filter(F.transform(F.split(candidate, r"\n"), squeeze), lambda x: x != "")
    found = F.filter(lines, lambda x: F.contains(squeeze(source), x))
    return F.when(F.size(lines) == 0, F.lit(False)).otherwise(F.size(found) >= F.size(lines) * ratio)


def scrub_preamble(text: Column) -> Column:
    """Three rounds of dropping a label and paired quotes around a preamble."""

    def once(t: Column) -> Column:
        t = F.trim(F.regexp_replace(t, r"(?i)^\s*(?:preamble|context|summary)\s*[:\-]\s*", ""))
        return F.trim(F.regexp_replace(t, r"^([\"'`])([\s\S]*)\1$", "$2"))

    return reduce(lambda t, _: once(t), range(3), F.trim(text))


def excerpt(text: Column, most: int, tail: int = 500) -> Column:
    """The head and the tail of a long document."""
    head = F.rtrim(F.substring(text, F.lit(1), F.lit(most - tail - 100)))
    return F.when(F.length(text) <= most, text).otherwise(F.concat(head, F.lit("\n...\n"), F.ltrim(F.right(text, F.lit(tail)))))
