"""Language identification by Bayesian evidence fusion (operator 8).

Four pieces of evidence on a page multiply: its text's likelihood under each language (hashed byte trigrams, counted
over all labelled documents), the language that its markup declares, its address suffix, and a prior of its host. What
declarations, suffixes and hosts say is estimated by grouped sums of the pages' posteriors from text alone, always
without the page's own part, so that nothing confirms itself; a host's share is smoothed towards its parent domain's, that
towards the whole. The suffix is evidence of its own and enters the host prior nowhere.

Text of n trigrams counts as at most ``EFFECTIVE`` independent ones, as neighbours repeat each other.

Defined cases: a page without text, declaration or host is judged by what it has; null html and URL count as empty;
labelled documents without text or language aren't counted; without labelled documents every language is null; repeated
pages are judged each (and count each towards their host); an empty table gives an empty result; other columns aren't
read.
"""

from __future__ import annotations

import html as markup
import re
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import hashed
from weftline.llm.common import cut, table

BITS = 14
EFFECTIVE = 60.0
SMOOTH = 0.5
#: Pages that a host's own share must have to count as much as its parent's.
STRENGTH = 5.0
DROPPED = re.compile(r"(?is)<(script|style|noscript|template)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>")
DECLARED = re.compile(r"""(?is)<html\b[^>]*?\blang\s*=\s*["']?([A-Za-z]+)|<meta\b[^>]*?(?:content-language|og:locale)[^>]*?content\s*=\s*["']?([A-Za-z]+)""")
HOST = re.compile(r"(?s)^.*?://([^/?#]*)")


def text_of(page: str) -> str:
    return markup.unescape(DROPPED.sub(" ", page))


def declared(page: str) -> str:
    found = DECLARED.search(page)
    return (found[1] or found[2]).lower() if found else ""


def trigram_model(docs: DataFrame, lang: str = "lang", text: str = "text") -> tuple[list[str], np.ndarray]:
    """Languages, and the log-likelihood of each bucket (rows) under each; from all labelled documents.

    The driver gets a row for each language and bucket: languages times 2 ** BITS.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(1 << BITS, np.int64))
        for batch in batches:
            for name, body in zip(batch.column(lang).to_pylist(), batch.column(text), strict=True):
                for block in hashed.buckets(body.as_py().lower().encode(), BITS):
                    sums[name] += np.bincount(block, minlength=1 << BITS)
        for name, n in sums.items():
            at = np.nonzero(n)[0]
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at])], ["lang", "bucket", "n"])

    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(lang, text)
    rows = known.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow().to_pydict()
    langs = sorted(set(rows["lang"]))
    n = np.zeros((1 << BITS, len(langs)))
    place = {name: i for i, name in enumerate(langs)}
    for name, bucket, count_ in zip(rows["lang"], rows["bucket"], rows["n"], strict=True):
        n[bucket, place[name]] = count_
    return langs, np.log((n + SMOOTH) / (n.sum(axis=0) + SMOOTH * len(n)))


def likelihood(body: str, model: np.ndarray) -> np.ndarray:
    """Log-likelihood of a text under each language, less the best one's."""
    sums, n = np.zeros(model.shape[1]), 0
    for block in hashed.buckets(body.lower().encode(), BITS):
        sums += np.bincount(block, minlength=len(model)) @ model
        n += len(block)
    sums *= min(1.0, EFFECTIVE / n) if n else 0.0
    return sums - sums.max(initial=-np.inf) if len(sums) else sums


def evidence(pages: DataFrame, langs: list[str], model: np.ndarray, ident: str, url: str, page: str) -> DataFrame:
    """ident, host, parent, suffix, declared, said (log-likelihoods of the text)."""
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for address, body in zip(batch.column(url).to_pylist(), batch.column(page), strict=True):
                body = body.as_py() or ""
                host = (m[1].lower().rstrip(".") if (m := HOST.match(address or "")) else "").rsplit("@", 1)[-1].split(":")[0]
                labels = host.split(".")
                said = declared(body)
                rows.append((host, ".".join(labels[-3:]) if len(labels) > 3 else ".".join(labels[-2:]), labels[-1], said if said in langs or not said else "other", likelihood(text_of(body), shared.value)))
            strings = [pa.array([r[i] for r in rows], pa.string()) for i in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column(ident), *strings, pa.array([r[4] for r in rows], pa.list_(pa.float64()))], [ident, "host", "parent", "suffix", "declared", "said"])

    kind = dict(pages.dtypes)[ident]
    return pages.select(ident, url, page).mapInArrow(read, f"`{ident}` {kind}, host string, parent string, suffix string, declared string, said array<double>")


def shares(column: str, n: int, lead: str) -> list[Column]:
    return [F.sum(F.col(column)[i]).alias(f"{lead}{i}") for i in range(n)]


def identify(pages: DataFrame, docs: DataFrame, ident: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """ident, lang, probability, text_lang, declared, host."""
    langs, model = trigram_model(docs)
    k = len(langs)
    if not k:
        return pages.select(ident, *[F.lit(None).cast(t).alias(c) for c, t in (("lang", "string"), ("probability", "double"), ("text_lang", "string"), ("declared", "string"), ("host", "string"))])
    rows = evidence(pages, langs, model, ident, url, page)
    total = sum((F.exp(F.col("said")[i]) for i in range(k)), F.lit(0.0))
    rows = cut(rows.withColumn("post", F.array(*[F.exp(F.col("said")[i]) / total for i in range(k)])))
    # One row for each host, suffix and declaration; the sums of all pages, by declaration, are langs + 2 rows.
    hosts = rows.groupBy("host", "parent", "suffix").agg(*shares("post", k, "h"))
    up = lambda key, lead: hosts.groupBy(key).agg(*[F.sum(f"h{i}").alias(f"{lead}{i}") for i in range(k)])
    tally = cut(hosts.join(up("parent", "p"), "parent").join(up("suffix", "s"), "suffix"))
    said = {r.declared: np.array([r[f"d{i}"] for i in range(k)]) for r in rows.groupBy("declared").agg(*shares("post", k, "d")).collect()}
    whole = np.sum(list(said.values()), axis=0) if said else np.zeros(k)
    suffixes = tally.agg(F.count_distinct("suffix")).first()[0]
    joined = rows.join(tally.drop("parent", "suffix"), "host")
    own = [F.col("post")[i] for i in range(k)]
    rest = lambda sums: [F.greatest(x - own[i], F.lit(0.0)) for i, x in enumerate(sums)]
    others = rest([F.lit(float(x)) for x in whole])
    base = [(x + 1) / (float(whole.sum()) - 1 + k) for x in others]
    level = lambda lead, below: [(x + STRENGTH * below[i]) / (sum((F.col(f"{lead}{j}") for j in range(k)), F.lit(0.0)) - 1 + STRENGTH) for i, x in enumerate(rest([F.col(f"{lead}{j}") for j in range(k)]))]
    prior = level("h", level("p", base))
    # P(suffix | language) and P(declared | language), with one more count for each value that there could be.
    suffix = [F.ln((x + 1) / (others[i] + suffixes)) for i, x in enumerate(rest([F.col(f"s{i}") for i in range(k)]))]
    sums = [F.coalesce(*[F.when(F.col("declared") == d, float(n[i])) for d, n in said.items()], F.lit(0.0)) for i in range(k)]
    says = [F.ln((x + 1) / (others[i] + k + 2)) for i, x in enumerate(rest(sums))]
    logs = F.array(*[F.col("said")[i] + says[i] + suffix[i] + F.ln(prior[i]) for i in range(k)])
    scored = joined.select(ident, "host", "declared", "post", logs.alias("logs")).withColumn("top", F.array_max("logs"))
    named = F.array(*[F.lit(x) for x in langs])
    at = lambda a: F.element_at(named, F.array_position(a, F.array_max(a)).cast("int"))
    likely = F.lit(1.0) / F.aggregate("logs", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("top")))
    return scored.select(ident, at(F.col("logs")).alias("lang"), F.round(likely, 6).alias("probability"), at(F.col("post")).alias("text_lang"), "declared", "host")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op8_language_id": op8_language_id}
