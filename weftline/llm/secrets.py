"""Secret scans: fixed patterns and character Markov models (operator 9).

Base spans come from three patterns. The method adds spans: runs of 20 or more token characters for which a first-order
Markov model of random strings is likelier than one of ordinary identifiers, by ``MARGIN`` nats in all and ``RATE`` a
transition, and which touch no base span. A run's transitions count once each, and it needs ``DISTINCT`` of them, so
repeated characters are no evidence.
Both models are transition counts over labelled samples (random strings in four alphabets; identifiers of English words
in six styles, and the corpus's own words), summed by a grouped aggregation; what reaches the driver is one number for
each pair of printable characters.

DataFrame functions only. Spark has no function for match positions, so matches are wrapped in two marks that no
pattern fits (and that are replaced in the text beforehand, one character for one), the text is split at them, and
lengths of the pieces give code-point offsets.

Defined cases: null text counts as empty; a text without spans has an empty list, whose digest is that of the empty
text; repeated rows are scanned each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from pydoc_data.topics import topics

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import let, table

#: Fixed patterns: kind, pattern, and what a match must satisfy.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = (
    ("assign", ASSIGN, lambda m: F.length(F.regexp_extract(m, ASSIGN, 1)) >= 8),
    # A match's greedy run of fewer characters holds no longer one, so the minimum can stand in the pattern.
    ("access", r"AKIA[A-Z0-9]{12,}", None),
    ("hex", r"[0-9a-f]{32,}", None),
)
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
KIND = "markov"
MARGIN, RATE = 10.0, 0.5
#: Distinct transitions that a random string has at least.
DISTINCT = 10
#: Documents from which ordinary words are taken as labelled samples, and random strings and identifiers made.
FIT_ROWS = 5000
MADE = 3000
CHUNK = 256


def spans(text: Column, kind: str, pattern: str, test) -> Column:
    """Array of (start, kind, end, m) of leftmost matches that don't overlap; ``text`` holds neither mark."""
    none = F.array().cast("array<struct<start:bigint,kind:string,end:bigint,m:string>>")

    def places(parts: Column) -> Column:
        def sums(lengths: Column) -> Column:
            # Sums of whole chunks, so that offsets take k * (k / CHUNK + CHUNK) steps for k matches, not k * k.
            whole = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / CHUNK).cast("int")), lambda c: F.aggregate(F.slice(lengths, c * CHUNK + 1, CHUNK), F.lit(0).cast("long"), lambda a, x: a + x))

            def place(chunks: Column) -> Column:
                def one(i: Column) -> Column:
                    c = F.floor(i / CHUNK).cast("int")
                    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
                    start = total(F.slice(chunks, F.lit(1), c)) + total(F.slice(lengths, c * CHUNK + 1, i - c * CHUNK)) - (i - 1)
                    m = F.substring_index(F.get(parts, i), "\x02", 1)
                    return F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + F.length(m)).alias("end"), m.alias("m"))

                return F.transform(F.sequence(F.lit(1), F.size(lengths) - 1), one)

            return let(whole, place)

        return let(F.transform(parts, lambda p: F.length(p).cast("long")), sums)

    found = let(F.split(F.regexp_replace(text, pattern, "\x01$0\x02"), "\x01", -1), places)
    if test:
        found = F.filter(found, lambda s: test(s["m"]))
    return F.when(text.rlike(pattern), found).otherwise(none)


def english() -> list[str]:
    """Words of the Python language's documentation, which comes with Python: some 3000."""
    return sorted({w.lower() for text in topics.values() for w in re.findall(r"[A-Za-z]{2,14}", text)})


def samples(docs: DataFrame, fit_rows: int = FIT_ROWS, made: int = MADE, ident: str = "doc_id", text: str = "text", vocabulary: list[str] | None = None) -> DataFrame:
    """token, random: labelled samples. Random: generated strings in four alphabets. Ordinary: identifiers made of a
    vocabulary, and the words of a bounded sample of documents that hold no digit."""
    spark = docs.sparkSession
    ids = spark.range(made)
    digest = F.sha2(F.col("id").cast("string"), 256)
    base64 = F.regexp_replace(F.base64(F.unhex(digest)), "=", "")
    plain = F.regexp_replace(base64, "[+/]", "7")
    random = ids.select(F.explode(F.array(F.substring(digest, 1, 40), base64, F.substring(F.upper(plain), 1, 20), F.substring(F.lower(plain), 1, 32))).alias("token"), F.lit(True).alias("random"))
    vocabulary = vocabulary or english()
    words = F.split(F.lit(" ".join(vocabulary)), " ")
    word = lambda n: F.element_at(words, (F.pmod(F.xxhash64("id", F.lit(n)), F.lit(len(vocabulary))) + 1).cast("int"))
    four = [F.col(f"w{n}") for n in range(4)]
    camel = F.concat(four[0], *[F.initcap(w) for w in four[1:]])
    styles = F.array(F.concat_ws("_", *four), F.concat_ws("-", *four), camel, F.concat(F.initcap(four[3]), F.initcap(four[2]), F.initcap(four[1])), F.upper(F.concat_ws("_", *four[:3])), F.concat_ws("/", *four))
    number = F.when(F.pmod(F.xxhash64("id"), F.lit(3)) == 0, F.pmod(F.xxhash64("id", F.lit(9)), F.lit(10_000)).cast("string")).otherwise("")
    ordinary = ids.select(number.alias("number"), *[word(n).alias(f"w{n}") for n in range(4)]).select("number", F.explode(styles).alias("token"))
    ordinary = ordinary.select(F.concat("token", "number").alias("token"), F.lit(False).alias("random"))
    rows = docs.count()
    part = F.pmod(F.xxhash64(ident), F.lit(max(1, -(-rows // fit_rows)))) == 0
    own = docs.where(part).select(F.explode(F.split(F.coalesce(F.col(text), F.lit("")), r"[^A-Za-z0-9+/_=-]+")).alias("token"), F.lit(False).alias("random"))
    own = own.where("length(token) >= 4 and not token rlike '[0-9]'")
    return random.unionAll(ordinary).unionAll(own)


def fit(labelled: DataFrame) -> list[float]:
    """Log-likelihood ratio of each transition, at 96 * (first - 32) + (second - 32) of the printable codes."""
    token = F.regexp_replace("token", r"[^\x20-\x7F]", "")
    at = F.explode(F.sequence(F.lit(1), F.length("t") - 1)).alias("i")
    pairs = labelled.select(token.alias("t"), "random").where("length(t) > 1").select("t", "random", at)
    pairs = pairs.select("random", F.expr("ascii(substring(t, i, 1))").alias("a"), F.expr("ascii(substring(t, i + 1, 1))").alias("b"))
    counts = {(r.random, r.a, r.b): r.n for r in pairs.groupBy("random", "a", "b").agg(F.count("*").alias("n")).collect()}  # at most 2 * 96 * 96 rows
    sums: dict = {}
    for (random, a, _), n in counts.items():
        sums[random, a] = sums.get((random, a), 0) + n
    size, smooth = 66, 0.5  # characters of a candidate; what each transition counts beforehand
    chance = lambda random, a, b: math.log((counts.get((random, a, b), 0) + smooth) / (sums.get((random, a), 0) + smooth * size))
    return [round(chance(True, a, b) - chance(False, a, b), 4) for a in range(32, 128) for b in range(32, 128)]


def likely_random(token: Column, model: Column, margin: float = MARGIN, rate: float = RATE) -> Column:
    """Whether the distinct transitions of a token of printable characters speak for a random string."""
    code = lambda i: F.ascii(F.substr(token, i, F.lit(1))) - 32
    steps = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(token) - 1), lambda i: code(i) * 96 + code(i + 1)))
    ratio = lambda found: F.aggregate(found, F.lit(0.0), lambda s, x: s + F.get(model, x))
    return let(steps, lambda found: let(ratio(found), lambda r: (F.size(found) >= DISTINCT) & (r > margin) & (r > rate * F.size(found))))


def scan_secrets(docs: DataFrame, model: list[float], margin: float = MARGIN, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """ident, base and added: arrays of (start, kind, end), in code points, end exclusive; in order."""
    clean = docs.select(ident, F.translate(F.coalesce(F.col(text), F.lit("")), "\x01\x02", "\x03\x03").alias("_t"))
    rank = {kind: i for i, (kind, _, _) in enumerate(BASE)}
    order = lambda a: F.transform(F.array_sort(F.transform(a, lambda s: F.struct(s["start"].alias("start"), F.coalesce(*[F.when(s["kind"] == k, i) for k, i in rank.items()], F.lit(len(rank))).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"), s["m"].alias("m")))), lambda s: F.struct(s["start"], s["kind"], s["end"], s["m"]))
    found = clean.select(ident, order(F.concat(*[spans(F.col("_t"), *b) for b in BASE])).alias("base"), spans(F.col("_t"), KIND, CANDIDATE, None).alias("more"))
    table_ = F.expr("cast(split('" + ",".join(map(str, model)) + "', ',') as array<double>)")
    free = lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    added = F.filter("more", lambda s: free(s) & likely_random(s["m"], table_, margin))
    return found.select(ident, "base", added.alias("added"))


def listed(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan_secrets(docs, fit(samples(docs)))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    merged = F.array_sort(F.concat(F.transform("base", lambda s: F.struct(s["start"], F.coalesce(*[F.when(s["kind"] == k, i) for i, (k, _, _) in enumerate(BASE)]).alias("r"), s["kind"], s["end"])), F.transform("added", lambda s: F.struct(s["start"], F.lit(len(BASE)).alias("r"), s["kind"], s["end"]))))
    return found.select("doc_id", *[count(kind) for kind, _, _ in BASE], F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(merged).alias("spans"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op9_secret_scan": op9_secret_scan}
