"""Benchmark decontamination by template canonicalisation (operator 5).

A text becomes a template: numbers, units (words after a number, or signs) and names (capitalised words inside a
sentence) are replaced by typed placeholders, other words are lower-cased. Windows of ``WINDOW`` template tokens are
hash-joined with those of the benchmark, so a question whose numbers or names were exchanged still meets its source. Matches of one
document and item that lie at one offset form an alignment; it is a leak if it has enough windows and its slots agree:
each name or unit of the item stands for one of the document throughout, and different names for different names. A number
is changed slot by slot: that two of an item's numbers are equal may be chance, and a new version need not keep it.

DataFrame functions only. Two Bloom filters of bounded size, of the benchmark's token pairs and of its windows, keep places that
can't match from going on; a window of the benchmark passes both, and the join itself is exact. Texts are cut into
segments of ``SEGMENT`` tokens that overlap by a window, so a row stays small however long the text is. Items with fewer
tokens than a window match as a whole. Windows with fewer than half plain words, and items with fewer than ``LEAST``
tokens, match only with equal values, as tables of numbers would share their templates.

A capitalised word that opens a sentence, line or text may be a name, and a spelled number a number: windows with such
words have a second form, in which they are placeholders. Names are told by capitals, which a copy may have lost or gained, so
windows with names have a third form, in which all words are words. Windows match by any of their forms. Alignments are judged
by first forms alone, by the first two, and by all.

Defined cases: null and empty texts and items have no windows; repeated rows of a document give one result, repeated
items each their own; rows without id take no part; empty tables give an empty result; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import BROADCAST_BYTES, cut, fence, let, table

WINDOW = 8
LEAST = 5
#: Windows of one alignment that make a leak: a run of WINDOW + RUN - 1 tokens (or the whole item, if it has fewer).
RUN = 6
#: Tokens of a text in one row.
SEGMENT = 4096
#: Placeholders; a raw token of the kind holds its value behind the digit. A word has no digits.
NUMBER, UNIT, NAME = "0", "1", "2"
#: Stands before a word that may be a name.
MAYBE = "3"
#: No mark is greater or equal, every word is.
WORDS_FROM = "4"
#: Fixed list: words that count as units after a number.
UNITS = "mm cm m km g kg mg l ml s ms min h hour hours minute minutes second seconds day days week weeks month months year years inch inches foot feet mile miles pound pounds ounce ounces dollar dollars euro euros cent cents percent degrees meter meters metre metres gram grams liter liters litre litres watt watts volt volts".split()
#: Signs that are units wherever they stand, and their values.
SIGNS = {"%": "percent", "$": "dollar", "€": "euro", "£": "pound", "°": "degree"}
#: A letter in place of the point or comma within a number, which so stays one token.
POINT = "\ua78f"
#: What stands before a point or name is tested after its first character, so that it is tested nowhere else.
POINTS = r"[.,](?<=\d[.,])(?=\d)"
NAMES = r"""\p{Lu}(?<=[\p{L}\d,;:)'"’] {1,3}\p{Lu})\p{Ll}+(?![\p{L}\d])"""
#: A capital that opens a word; where NAMES are marked already, it may be a name.
INITIALS = r"\p{Lu}(?<![\p{L}\d]\p{Lu})\p{Ll}+(?![\p{L}\d])"
SPELLED = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million".split()
APART = r"[^\p{L}\d]+"


def tokens(text: Column) -> Column:
    """Raw tokens in order: words, and marks with their values; units that are words are told by the token before."""

    def figures(t: Column) -> Column:
        t = F.regexp_replace(F.regexp_replace(t, POINTS, POINT), rf"\d[\d{POINT}]*", f" {NUMBER}$0 ")
        return reduce(lambda x, sign: F.replace(x, F.lit(sign), F.lit(f" {UNIT}{SIGNS[sign]} ")), SIGNS, t)

    marked = let(text, lambda t: F.when(t.rlike(r"[\d%$€£°]"), figures(t)).otherwise(t))
    named = F.regexp_replace(F.regexp_replace(marked, NAMES, f" {NAME}$0 "), INITIALS, f"{MAYBE}$0")
    return F.array_remove(F.split(F.lower(named), APART), "")


def value(t: Column) -> Column:
    """What a raw token stands for."""
    return F.when(t < WORDS_FROM, F.substring(t, 2, 1 << 30)).otherwise(t)


def is_mark(t: Column, mark: str) -> Column:
    return F.startswith(t, F.lit(mark))


def plain(t: Column, before: Column) -> Column:
    """First form of a raw token: words that may be names or numbers are words."""
    kind = F.when(is_mark(t, MAYBE), value(t)).otherwise(F.substring(t, 1, 1))
    return F.when(t < WORDS_FROM, kind).when(t.isin(UNITS) & is_mark(before, NUMBER), UNIT).otherwise(t)


def free(t: Column, before: Column) -> Column:
    """Second form: they are placeholders, and so is a unit after a spelled number."""
    kind = F.when(~is_mark(t, MAYBE), F.substring(t, 1, 1)).when(value(t).isin(SPELLED), NUMBER).otherwise(NAME)
    unit = t.isin(UNITS) & (is_mark(before, NUMBER) | F.ltrim(before, F.lit(MAYBE)).isin(SPELLED))
    return F.when(t < WORDS_FROM, kind).when(t.isin(SPELLED), NUMBER).when(unit, UNIT).otherwise(t)


def blind(t: Column, before: Column) -> Column:
    """Third form: names are words, too, so that letter case tells nothing."""
    word = value(t)
    return F.when(word.isin(UNITS) & is_mark(before, NUMBER), UNIT).when(t >= NAME, word).otherwise(F.substring(t, 1, 1))


FORMS = (plain, free, blind)
LAST = len(FORMS) - 1
#: Columns: an item's windows, by form, that may have other values.
PLAIN = [f"plain{f}" for f in range(len(FORMS))]


def formed(raw: Column, at: Column, size: Column, form: Callable[[Column, Column], Column]) -> Column:
    """The window of ``size`` template tokens from place ``at`` of an array of raw tokens."""
    return F.transform(F.sequence(at, at + size - 1), lambda i: form(F.get(raw, i), F.get(raw, i - 1)))


def heavy(toks: Column) -> Column:
    """Fewer than half plain words."""
    return 2 * F.size(F.filter(toks, lambda t: ~t.isin(NUMBER, NAME, UNIT))) < F.size(toks)


def bitmap_of(rows: DataFrame, count: int, at: tuple[int, ...] = (0,)) -> Callable[[Column], Column]:
    """A test that all values of ``h`` pass and few others: a Bloom filter of 2**16 to 2**22 bits, by their number.

    at: the bits of a value from which its probes are taken."""
    bits = min(22, max(16, (16 * count).bit_length()))
    probes = lambda h: [F.shiftrightunsigned(h, k).bitwiseAND(F.lit((1 << bits) - 1)) for k in at]
    places = rows.select(F.explode(F.array(*probes(F.col("h")))).alias("p"))
    words = places.groupBy(F.shiftright("p", 6).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("bits"))
    found = {r.word: r.bits for r in words.collect()}  # at most 2**16 words
    literal = F.expr("cast(split('" + ",".join(str(found.get(i, 0)) for i in range(1 << (bits - 6))) + "', ',') as array<bigint>)")

    def test(h: Column) -> Column:
        one = lambda p: F.getbit(F.get(literal, F.shiftright(p, 6).cast("int")), p.bitwiseAND(F.lit(63)).cast("int")) == 1
        return reduce(lambda a, b: a & b, map(one, probes(h)))

    return test


def match_key(h: Column, exact: Column, words: Column) -> Column:
    """Windows that match with equal values only are joined by these."""
    return F.when(exact, F.xxhash64(h, F.array_join(words, " "))).otherwise(h)


def benchmark_windows(items: DataFrame, item: str, text: str) -> DataFrame:
    """item_id, at, size, h, form, exact, key, toks, theirs, pairs, total, and plain windows by form; short items as a whole.

    pairs: hashes of the token pairs that a document's second form can have where it holds the window.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = fence(items.where(F.col(item).isNotNull()).select(F.col(item).alias("item_id"), tokens(body).alias("raw")))
    n = F.size("raw")
    size = F.least(F.lit(WINDOW), n)
    places = F.when(n > 0, F.sequence(F.lit(0), n - size)).otherwise(F.array().cast("array<int>"))
    rows = rows.select("item_id", "raw", n.alias("n"), size.alias("size"), F.explode(places).alias("at"))
    forms = F.array(*[F.struct(F.lit(f).alias("form"), formed(F.col("raw"), F.col("at"), F.col("size"), form).alias("toks")) for f, form in enumerate(FORMS)])
    rows = rows.select("item_id", "raw", "n", "size", "at", F.explode(forms).alias("w")).select("item_id", "raw", "n", "size", "at", "w.*")
    rows = rows.withColumn("exact", heavy(F.col("toks")) | (F.col("n") < LEAST)).withColumn("theirs", F.transform(F.slice("raw", F.col("at") + 1, F.col("size")), value))
    rows = cut(rows.withColumn("h", F.xxhash64("toks")).withColumn("key", match_key(F.col("h"), F.col("exact"), F.col("theirs"))))
    totals = rows.groupBy("item_id", "raw").agg(*[F.count_distinct(F.when((F.col("form") == f) & ~F.col("exact"), F.col("at"))).alias(c) for f, c in enumerate(PLAIN)])
    # A word may stand at a sentence's start, or for a number or unit, in the document.
    others = lambda t: F.array_distinct(F.array(t, F.lit(NAME), F.when(t.isin(SPELLED), NUMBER).otherwise(t), F.when(t.isin(UNITS), UNIT).otherwise(t)))
    both = lambda a, b: F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: F.xxhash64(x, y))))
    pairs = F.array_distinct(F.flatten(F.zip_with(F.slice("toks", F.lit(1), F.col("size") - 1), F.slice("toks", F.lit(2), F.col("size") - 1), lambda a, b: both(others(a), others(b)))))
    # A later form that is the first isn't kept twice.
    differs = (F.col("form") == 0) | (F.col("toks") != formed(F.col("raw"), F.col("at"), F.col("size"), plain))
    rows = rows.where(differs).join(totals, ["item_id", "raw"])
    return rows.select("item_id", "at", "size", "h", "form", "exact", "key", "toks", "theirs", pairs.alias("pairs"), (F.col("n") - F.col("size") + 1).alias("total"), *PLAIN)


def segments(docs: DataFrame, ident: str, text: str) -> DataFrame:
    """id, base, raw: raw tokens of a text from place base - 1 (null before the first) to the end of the last window that starts in the segment."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = fence(docs.where(F.col(ident).isNotNull()).select(F.col(ident).alias("id"), F.concat(F.array(F.lit(None).cast("string")), tokens(body)).alias("raw")))
    bases = F.sequence(F.lit(0), F.greatest(F.size("raw") - 2, F.lit(0)), F.lit(SEGMENT))
    parts = F.transform(bases, lambda b: F.struct(b.alias("base"), F.slice("raw", b + 1, SEGMENT + WINDOW).alias("raw")))
    whole = F.array(F.struct(F.lit(0).alias("base"), F.col("raw")))
    return rows.select("id", F.explode(F.when(F.size("raw") <= SEGMENT, whole).otherwise(parts)).alias("s")).select("id", "s.*")


def document_runs(docs: DataFrame, sizes: list[int], pair_test: Callable[[Column], Column], test: Callable[[Column], Column], ident: str, text: str) -> DataFrame:
    """id, at, size, run, raw: runs of neighbouring windows that pass both tests. at: the first window's place; raw: their
    raw tokens, with the one before; run: a digest of these."""
    rows = fence(segments(docs, ident, text))
    rows = fence(rows.withColumn("free", F.transform("raw", lambda t, i: free(t, F.get("raw", i - 1)))))
    # The second form has every placeholder that any form has; where it has a name, the item may have any word.
    rows = fence(rows.withColumn("marks", F.transform("free", lambda t, i: pair_test(F.xxhash64(t, F.get("free", i + 1))))))

    def places(size: int) -> Column:
        """Places in the segment where all token pairs of a window may be the benchmark's."""
        last = F.least(F.lit(SEGMENT), F.size("raw") - size)
        may = lambda i: reduce(lambda a, b: a & b, [F.get("marks", i + k) for k in range(size - 1)], F.lit(True))
        return F.when(last >= 1, F.filter(F.sequence(F.lit(1), last), may)).otherwise(F.array().cast("array<int>"))

    def windows(size: int) -> Column:
        """Those whose window may be the benchmark's, in any form."""
        named = lambda i: F.exists(F.slice("raw", i + 1, size), lambda t: is_mark(t, NAME))
        first = lambda i: let(F.xxhash64(F.slice("free", i + 1, size)), test) | let(F.xxhash64(formed(F.col("raw"), i, F.lit(size), plain)), test)
        return F.filter(f"p{size}", lambda i: first(i) | (named(i) & let(F.xxhash64(formed(F.col("raw"), i, F.lit(size), blind)), test)))

    def runs(size: int) -> Column:
        here = F.col(f"p{size}")
        first = F.filter(here, lambda x, k: F.coalesce(F.get(here, k - 1) < x - 1, F.lit(True)))
        last = F.filter(here, lambda x, k: F.coalesce(F.get(here, k + 1) > x + 1, F.lit(True)))
        return F.zip_with(first, last, lambda a, b: F.struct((F.col("base") + a - 1).alias("at"), F.lit(size).alias("size"), F.slice("raw", a, b - a + size + 1).alias("raw")))

    some = lambda: " or ".join(f"size(p{size}) > 0" for size in sizes)
    rows = fence(rows.select("id", "base", "raw", "free", *[places(size).alias(f"p{size}") for size in sizes])).where(some())
    rows = fence(rows.withColumns({f"p{size}": windows(size) for size in sizes})).where(some())
    found = rows.select("id", F.explode(F.concat(*map(runs, sizes))).alias("r")).select("id", "r.*")
    return found.withColumn("run", F.sha2(F.concat_ws(" ", F.col("size").cast("string"), F.transform("raw", lambda t: F.coalesce(t, F.lit(".")))), 256))


def run_matches(runs: DataFrame, bench: DataFrame, test: Callable[[Column], Column], broadcast: bool) -> DataFrame:
    """run, item_id, delta, judge, windows, plain, total, plain_total, start, stop, slots of distinct runs; places count from a run's first."""
    at = F.explode(F.sequence(F.lit(1), F.size("raw") - F.col("size"))).alias("i")
    rows = fence(runs.select("run", "size", "raw", at))
    forms = F.array(*[F.struct(F.lit(f).alias("own_form"), formed(F.col("raw"), F.col("i"), F.col("size"), form).alias("own_toks")) for f, form in enumerate(FORMS)])
    own = F.transform(F.slice("raw", F.col("i") + 1, F.col("size")), value).alias("own")
    rows = fence(rows.select("run", "size", (F.col("i") - 1).alias("at"), own, F.explode(F.array_distinct(forms)).alias("f"))).select("run", "size", "at", "own", "f.*")
    rows = fence(rows.withColumn("h", F.xxhash64("own_toks"))).where(test(F.col("h")))
    # Which key a window goes by depends on its tokens and, for short items, on its size.
    hits = rows.withColumn("key", match_key(F.col("h"), heavy(F.col("own_toks")) | (F.col("size") < LEAST), F.col("own"))).drop("h")
    theirs = bench.select("key", "size", "item_id", F.col("at").alias("item_at"), "form", "exact", "toks", "theirs", "total", *PLAIN)
    met = hits.join(F.broadcast(theirs) if broadcast else theirs, ["key", "size"]).where("own_toks = toks and (not exact or own = theirs)")
    slots = F.filter(F.arrays_zip(F.col("toks").alias("t"), F.col("theirs").alias("item"), F.col("own").alias("doc")), lambda p: p["t"].isin(NUMBER, NAME, UNIT))
    met = met.select("run", "item_id", (F.col("at") - F.col("item_at")).alias("delta"), "at", F.struct(F.greatest("form", "own_form").alias("form"), "exact", "size", "total", *PLAIN, slots.alias("slots")).alias("m"))
    # Of the forms by which a window matches, the first.
    met = met.groupBy("run", "item_id", "delta", "at").agg(F.min("m").alias("m")).select("run", "item_id", "delta", "at", "m.*")
    return met.withColumn("judge", F.explode(F.sequence("form", F.lit(LAST)))).groupBy("run", "item_id", "delta", "judge").agg(
        F.count("*").alias("windows"),
        F.count_if(~F.col("exact")).alias("plain"),
        F.max("total").alias("total"),
        F.get(F.array(*[F.max(c) for c in PLAIN]), F.col("judge")).alias("plain_total"),
        F.min("at").alias("start"),
        F.max(F.col("at") + F.col("size")).alias("stop"),
        F.array_distinct(F.flatten(F.collect_set("slots"))).alias("slots"),
    )


def leaks(docs: DataFrame, items: DataFrame, ident: str = "doc_id", item: str = "item_id", text: str = "text", item_text: str = "text") -> DataFrame:
    """ident, item_id, kind (verbatim or reparameterised), windows, slots, changed, start, stop (token places)."""
    bench = cut(benchmark_windows(items, item, item_text))
    room = F.octet_length(F.array_join("toks", " ")) + F.octet_length(F.array_join("theirs", " ")) + 16 * (F.size("toks") + 8)
    summary = bench.agg(F.count("*").alias("n"), F.collect_set("size").alias("sizes"), F.sum(room).alias("bytes")).first()
    pairs = bench.select(F.explode("pairs").alias("h")).distinct()
    test, pair_test = bitmap_of(bench, summary.n, (0, 21, 42)), bitmap_of(pairs, pairs.count())
    found = cut(document_runs(docs, sorted(summary.sizes) or [WINDOW], pair_test, test, ident, text))
    # A passage that many documents hold is matched once.
    distinct = found.groupBy("run").agg(F.first("size").alias("size"), F.first("raw").alias("raw"))
    partial = cut(run_matches(distinct, bench, test, (summary.bytes or 0) <= BROADCAST_BYTES))
    parts = partial.agg(F.sum(F.octet_length(F.to_json("slots")) + 128)).first()[0] or 0
    held = cut(found.select("id", "run", F.col("at").alias("first")).distinct())  # beside a written table: AQE splits a run that many hold
    met = held.join(F.broadcast(partial) if parts <= BROADCAST_BYTES else partial, "run")
    lined = met.groupBy("id", "item_id", (F.col("first") + F.col("delta")).alias("delta"), "judge").agg(
        *[F.sum(c).alias(c) for c in ("windows", "plain")],
        *[F.max(c).alias(c) for c in ("total", "plain_total")],
        F.min(F.col("first") + F.col("start")).alias("start"),
        F.max(F.col("first") + F.col("stop")).alias("stop"),
        F.array_distinct(F.flatten(F.collect_set("slots"))).alias("slots"),
    )
    kinds = lambda side, only: F.size(F.array_distinct(F.transform(F.filter("slots", lambda p: p["t"] == only), lambda p: p[side])))
    of = lambda only: F.size(F.filter("slots", lambda p: p["t"] == only))
    agree = (kinds("item", NAME) == of(NAME)) & (kinds("doc", NAME) == of(NAME)) & (kinds("item", UNIT) == of(UNIT))
    changed = F.size(F.filter("slots", lambda p: p["item"] != p["doc"]))
    # All of its windows, or all of those that may have other values.
    enough = (F.col("windows") >= F.least(F.lit(RUN), F.col("total"))) | ((F.col("plain") > 0) & (F.col("plain") >= F.least(F.lit(RUN), F.col("plain_total"))))
    found = lined.where(enough & agree)
    rest = F.struct(F.when(changed > 0, "reparameterised").otherwise("verbatim").alias("kind"), "windows", F.size("slots").alias("slots"), changed.alias("changed"), "start", "stop")
    found = found.groupBy("id", "item_id", "delta").agg(F.max_by(rest, F.struct("windows", -F.col("judge"))).alias("r"))
    return found.select(F.col("id").alias(ident), "item_id", "r.*")


def without_leaks(docs: DataFrame, items: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the documents that hold a leak; rows without id stay."""
    found = leaks(docs, items, ident, text=text).select(ident).distinct()
    return docs.join(found, ident, "left_anti")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op5_decontamination": op5_decontamination}
