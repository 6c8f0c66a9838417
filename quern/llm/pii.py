"""PII and information-theoretic sanitisation, in DataFrame functions alone.

Fixed patterns find the protected entities: e-mail addresses, IPv4 addresses, payment cards and phone numbers. A term (a run of
letters and digits, lower-cased) discloses an entity, or that a text holds a kind of entity at all, if seeing the term tells so: over
the distinct texts of the whole corpus, of ``support`` texts or more with both, the pointwise information
log2 P(entity | term) - log2 P(entity) must reach ``least_bits``, and the share P(entity | term) must reach ``least_share`` even at the
lower end of its confidence interval (Wilson, Z). Terms count wherever they stand in a text that holds the entity, but not
inside an entity. A disclosing term is a span in every text, whether the entity stands there or not; ``sanitise`` replaces entities by their
kind, generalises terms (letters and digits by their shape) and removes those whose share reaches ``removal_share``.

Texts that agree to the letter count once, so copies don't make their own words disclosing. Offsets are code
points, ends exclusive. Nulls are empty texts without spans. Each row gets a row; rows that share a doc_id are kept apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Kind, pattern (possessive where no match can need less, so that no long run overflows the matcher), and what a text must hold.
PATTERNS = (
    ("email", r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    ("ip", r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "."),
    ("card", r"[0-9]++(?:[\x20-][0-9]++)*+", None),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+"),
)
SUPPORT = 3
#: Standard deviations of the confidence interval: 95 % on one side.
Z = 1.645
LEAST_SHARE = 0.5
REMOVAL_SHARE = 0.9
LEAST_BITS = 4.0
#: So many candidate terms go to all executors; more are joined by a shuffle.
MOST_SENT = 50_000
#: One in so many distinct texts, by their hash, bounds a term's frequency from below before all are counted.
PART = 8
#: Spans that are gathered before they join the others, so that no array is copied for each span of a text.
GATHER = 256
_SPAN = "array<struct<kind:string,start:int,end:int,value:string>>"
#: Terms, and what parts them.
TERM, PARTED = r"[\p{L}\p{N}]+", r"[^\p{L}\p{N}]+"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(x: Column) -> Column:
    d = F.reverse(_digits(x))
    place = F.sequence(F.lit(1), F.length(d))
    digit = lambda i: F.substring(d, i, F.lit(1)).cast("int")
    part = lambda i: F.when(i % 2 == 1, digit(i)).otherwise(digit(i) * 2 - F.when(digit(i) > 4, 9).otherwise(0))
    return F.aggregate(F.transform(place, part), F.lit(0), lambda a, b: a + b) % 10 == 0


def _valid(kind: str, x: Column) -> Column:
    if kind == "ip":
        return ~F.exists(F.split(x, r"\."), lambda p: ~F.regexp_replace(p, "^0+(?=[0-9])", "").rlike("^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        n = F.length(_digits(x))
        return F.when(n.between(12, 19), _luhn(x)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(x)).between(9, 15)
    return F.lit(True)


def _matches(text: Column, pattern: str, span) -> Column:
    """The spans of the matches of a pattern: what lies between matches gives the places.

    span(match, start, end) is a span or null, which is left out. An aggregate copies what it has gathered at each step, so
    matches are taken in blocks of GATHER, and a text's spans are joined once for each block.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    none = F.array().cast(_SPAN)

    def add(acc, x):
        start = acc["at"] + F.length(x["gap"])
        made = F.array_compact(F.array(span(x["hit"], start, start + F.length(x["hit"])))).cast(_SPAN)
        return F.struct(F.coalesce(start + F.length(x["hit"]), F.lit(0)).alias("at"), F.concat(acc["few"], made).alias("few"))

    def of(all_):
        def block(acc, i):
            few = F.aggregate(F.slice(all_, i * GATHER + 1, F.lit(GATHER)), F.struct(acc["last"]["at"].alias("at"), none.alias("few")), add)
            return F.struct(few.alias("last"), F.concat(acc["out"], acc["last"]["few"]).alias("out"))

        first = F.struct(F.struct(F.lit(0).alias("at"), none.alias("few")).alias("last"), none.alias("out"))
        return F.aggregate(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / GATHER).cast("int")), first, block, lambda acc: F.concat(acc["out"], acc["last"]["few"]))

    # the one element of an array, so that a lambda has the matches by a name and does not find them again for each block
    matches = F.arrays_zip(hits.alias("hit"), F.slice(gaps, 1, F.size(hits)).alias("gap"))
    return F.flatten(F.transform(F.filter(F.array(matches), lambda m: F.size(m) > 0), of))


def _found(text: Column, kind: str, pattern: str, hint: str | None) -> Column:
    """All valid matches of a kind."""

    def span(hit, start, end):
        return F.when(_valid(kind, hit), F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), hit.alias("value")))

    can = F.contains(text, F.lit(hint)) if hint else text.rlike("[0-9]")
    return F.when(can, _matches(text, pattern, span)).otherwise(F.array().cast(_SPAN))


def _order(kind: Column) -> Column:
    return F.array_position(F.array(*(F.lit(k) for k, *_ in PATTERNS), F.lit("term")), kind)


def _sorted(spans: Column) -> Column:
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), _order(s["kind"]).alias("k"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value")))
    return F.transform(F.array_sort(keyed), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def entities(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, base): the protected entities of each text."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.select("doc_id", "text", _sorted(F.concat(*(_found(F.col("text"), *p) for p in PATTERNS))).alias("base"))


def _terms(text: Column) -> Column:
    return F.array_remove(F.array_distinct(F.split(F.lower(text), PARTED)), "")


def disclosures(docs: DataFrame, found: DataFrame, *, text_col: str = "text", support: int = SUPPORT, least_share: float = LEAST_SHARE, least_bits: float = LEAST_BITS) -> tuple[DataFrame, DataFrame]:
    """The terms (term, entity, share, bits) that disclose an entity or a kind, and (key, term) of all texts that hold one of the terms looked at.

    found: (key, text, base) of the distinct texts that hold an entity.
    """
    bare = F.col("text")
    for _, pattern, _ in PATTERNS:
        bare = F.regexp_replace(bare, pattern, " ")
    names = F.array_distinct(F.concat(F.transform("base", lambda s: s["kind"]), F.transform("base", lambda s: F.concat_ws(":", s["kind"], s["value"]))))
    held = found.select("key", F.explode(names).alias("entity"))
    often = held.groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity")).where(F.col("n_entity") >= support)
    words = found.select("key", F.explode(_terms(bare)).alias("term"))
    pair = held.join(often.select("entity"), "entity").join(words, "key").groupBy("term", "entity").agg(F.count(F.lit(1)).alias("n_both")).where(F.col("n_both") >= support)
    # texts with the term and any entity are a lower bound of all texts with it: most common words go here
    around = words.groupBy("term").agg(F.count(F.lit(1)).alias("n_near"))
    pair = materialise(pair.join(around, "term").where(F.col("n_both") >= least_share * F.col("n_near")).select("term", "entity", "n_both"), "candidates")
    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("key", F.xxhash64("text"))

    def holding(rows: DataFrame, terms: DataFrame) -> DataFrame:
        small = terms.limit(MOST_SENT + 1).count() <= MOST_SENT
        return rows.select("key", F.explode(_terms(F.col("text"))).alias("term")).join(F.broadcast(terms) if small else terms, "term", "left_semi")

    # a count over part of the texts is a lower bound as well, and rules out the common words that are left: no pair is lost
    part = texts.where(F.pmod("key", F.lit(PART)) == 0).groupBy("key").agg(F.first("text").alias("text"))
    least = holding(part, pair.select("term").distinct()).groupBy("term").agg(F.count(F.lit(1)).alias("n_part"))
    pair = materialise(pair.join(least, "term", "left").where(F.col("n_both") >= least_share * F.coalesce("n_part", F.lit(0))).drop("n_part"), "candidates")
    where = holding(texts, pair.select("term").distinct())
    where = materialise(where.distinct(), "places")
    per_term = where.groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))
    n_texts = texts.select("key").distinct().count()
    n = F.greatest("n_term", "n_both").cast("double")
    share = F.col("n_both") / n
    low = (share + Z * Z / (2 * n) - Z * F.sqrt(share * (1 - share) / n + Z * Z / (4 * n * n))) / (1 + Z * Z / n)
    rated = pair.join(per_term, "term").join(often, "entity").select("term", "entity", share.alias("share"), low.alias("low"), (F.log2(share) - F.log2(F.col("n_entity") / F.lit(n_texts))).alias("bits"))
    return rated.where((F.col("low") >= least_share) & (F.col("bits") >= least_bits)).drop("low"), where


def find(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", support: int = SUPPORT, least_share: float = LEAST_SHARE, least_bits: float = LEAST_BITS) -> DataFrame:
    """(doc_id, text, base, spans, terms): spans are base and the disclosing terms, terms those with their shares."""
    found = entities(docs, id_col=id_col, text_col=text_col)
    hit = found.where(F.size("base") > 0).select(F.xxhash64("text").alias("key"), "text", "base").groupBy("key").agg(F.first("text").alias("text"), F.first("base").alias("base"))
    told, where = disclosures(docs, materialise(hit, "entities"), text_col=text_col, support=support, least_share=least_share, least_bits=least_bits)
    worst = told.groupBy("term").agg(F.max("share").alias("share"))
    marks = materialise(where.join(worst, "term").groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("term", "share"))).alias("told")), "marks")
    every = found.withColumn("key", F.xxhash64("text")).join(marks, "key", "left")

    def span(hit, start, end):
        clear = F.forall("base", lambda b: (b["end"] <= start) | (b["start"] >= end))
        return F.when(F.map_contains_key("told", F.lower(hit)) & clear, F.struct(F.lit("term").alias("kind"), start.alias("start"), end.alias("end"), F.lower(hit).alias("value")))

    more = F.when(F.col("told").isNull(), F.array().cast(_SPAN)).otherwise(_matches(F.col("text"), TERM, span))
    # a column of its own: a lambda would evaluate it for every element
    every = every.select("doc_id", "text", "base", "told", more.alias("more"))
    rated = F.transform("more", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), F.col("told")[s["value"]].alias("share")))
    return every.select("doc_id", "text", "base", F.when(F.size("more") > 0, _sorted(F.concat("base", "more"))).otherwise(F.col("base")).alias("spans"), rated.alias("terms"))


def sanitised(removal_share: float = REMOVAL_SHARE) -> Column:
    """The text of (text, base, terms): entities become [KIND]; disclosing terms are generalised to their shape, or removed at removal_share."""
    shape = lambda w: F.regexp_replace(F.regexp_replace(w, r"\p{N}", "0"), r"\p{L}", "x")
    base = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("to")))
    more = F.transform("terms", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.when(s["share"] >= removal_share, F.lit("")).otherwise(shape(s["value"])).alias("to")))
    done = F.aggregate(
        F.array_sort(F.concat(base, more)),
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        # overlapping entities (a card inside a phone number): the first one stands for both
        lambda acc, s: F.when(s["start"] < acc["at"], F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))).otherwise(
            F.struct(s["end"].alias("at"), F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"]), s["to"]).alias("out"))
        ),
        lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))),
    )
    return F.when(F.size("base") + F.size("terms") > 0, done).otherwise(F.col("text"))


def sanitise(found: DataFrame, *, removal_share: float = REMOVAL_SHARE) -> DataFrame:
    """(doc_id, text) of what find returns, sanitised."""
    return found.select("doc_id", sanitised(removal_share).alias("text"))


def _is(kind: str):
    return lambda x: x == kind


def op9_pii(spark, sf_dir: str) -> DataFrame:
    """op9 over the whole of documents: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_terms, sanitised_sha256."""
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    clean = F.sha2(sanitised(), 256).alias("sanitised_sha256")
    counts = [F.size(F.filter(F.transform("base", lambda s: s["kind"]), _is(k))).cast("long").alias(f"n_{k}") for k, *_ in PATTERNS]
    return found.select("doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"), F.size("terms").cast("long").alias("n_terms"), clean)
