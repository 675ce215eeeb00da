"""Language ID by Bayesian evidence fusion.

log P(lang | row) = prior of the host + P(declared markup language | lang) + P(address suffix | lang) + P(code in the path | lang)
+ text likelihood, up to a constant.

* Text: naive Bayes over all byte trigrams of the whole text, hashed to BINS, learned from at most SAMPLE labelled rows.  Trigrams
  overlap, so their sum counts as DISCOUNT independent ones at most.
* Markup, suffix, code: what a text posterior says by value, from grouped aggregation over all rows, every value with a row of its own.
  A missing value is no evidence.
* Host: counts of the text posteriors by host, smoothed to those of its domain, and these to all rows; a row's own count is left out.

Null and empty texts have no text evidence; with no evidence at all the prior decides.  Below CONFIDENT the language is "und" and
kept is false.  Repeated rows get the same result.  Texts and pages of any length are read whole, in time proportional to their length, broken markup
included.  Without labelled rows every language is "und".  A null host shares the empty host.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placemill.llm.common import cut, mapped, small_batches, table
from placemill.llm.page_text import tokens
from placemill.llm.words import _LOWER, text_buffers

SAMPLE, BINS = 4000, 32_768
DISCOUNT = 60.0
#: Values of an evidence table (a short text and a number for each language) up to which it is broadcast; a larger one is joined by a shuffle.
BROADCAST_VALUES = 10_000
#: Pseudo-rows by which a host counts as its domain, and a domain as all rows; and those of each value of an evidence table.
SMOOTH, VALUE_SMOOTH = 5.0, 0.5
CONFIDENT = 0.5
SLICE = 1_000_000

KEYS = ["kind", "id", "host", "domain", "suffix", "code", "declared"]
KEY_SCHEMA = "kind string, id long, host string, domain string, suffix string, code string, declared string"


def _trigrams(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bins of trigrams, bounds by row) of a few MB of texts at a time."""
    raw, at = text_buffers(column)
    n, a = len(at) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(at, at[a] + SLICE, side="right")) - 1)
        x = _LOWER[raw[at[a] : at[b]]].astype(np.uint32)
        offsets = at[a : b + 1] - at[a]
        if len(x) >= 3:
            gram = x[:-2] | x[1:-1] << np.uint32(8) | x[2:] << np.uint32(16)
            gram = (gram * np.uint32(2654435761)) >> np.uint32(32 - (BINS.bit_length() - 1))
        else:
            gram = np.zeros(0, dtype=np.uint32)
        yield a, gram, offsets
        a = b


def train(labelled: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """(languages, log probabilities by language and bin) from labelled (id, text, lang)."""
    chosen = labelled.filter("lang IS NOT NULL AND id IS NOT NULL").select(F.col("id").alias("_id"), F.col("lang").alias("_lang"))
    chosen = chosen.orderBy(F.xxhash64("_id"), "_id", "_lang").limit(sample)  # no more than `sample` rows
    texts = labelled.select("id", "text").join(F.broadcast(chosen), F.col("id") == F.col("_id")).select("_lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for first, gram, offsets in _trigrams(batch.column(1)):
                for k in range(len(offsets) - 1):
                    n = np.bincount(gram[offsets[k] : max(offsets[k], offsets[k + 1] - 2)], minlength=BINS)
                    total[langs[first + k]] = total.get(langs[first + k], 0) + n
        for lang, n in total.items():
            bins = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(bins)), pa.array(bins), pa.array(n[bins].astype(np.int64))], ["lang", "bin", "n"])

    counts = mapped(texts, count, "lang string, bin long, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(set(counts["lang"]))
    seen = np.zeros((len(langs), BINS))
    for k, lang in enumerate(langs):
        own = counts[counts["lang"] == lang]
        seen[k, own["bin"]] = own["n"]
    smoothed = seen + 0.5
    return langs, np.log(smoothed / smoothed.sum(axis=1, keepdims=True)).astype(np.float32)


def text_evidence(rows: DataFrame, langs: list[str], logs: np.ndarray) -> DataFrame:
    """KEYS with e0, e1, ...: the text's log likelihood by language, relative to the likeliest."""
    model = rows.sparkSession.sparkContext.broadcast(logs)
    names = [f"e{k}" for k in range(len(langs))]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_ = model.value
        for batch in batches:
            out = np.zeros((len(names), batch.num_rows))
            for first, gram, offsets in _trigrams(batch.column(len(KEYS))):
                begins = np.minimum(offsets[:-1], len(gram))
                ends = np.maximum(begins, offsets[1:] - 2)  # a text of n bytes has n - 2 trigrams
                n = ends - begins
                for k in range(len(names)):
                    run = np.concatenate(([0.0], np.cumsum(table_[k][gram], dtype=np.float64)))
                    out[k, first : first + len(n)] = (run[ends] - run[begins]) * np.minimum(1.0, DISCOUNT / np.maximum(n, 1))
            out -= out.max(axis=0)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(KEYS)], *[pa.array(x) for x in out]], [*KEYS, *names])

    return mapped(rows.select(*KEYS, "text"), score, KEY_SCHEMA + "".join(f", {c} double" for c in names))


def _total(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def _value_table(seen: DataFrame, column: str, n: int) -> DataFrame:
    """(column, l0, l1, ...): log P(value | language) of every value, from rows with p0, p1, ..."""
    by = cut(seen.filter(F.col(column).isNotNull()).groupBy(column).agg(*[F.sum(f"p{k}").alias(f"c{k}") for k in range(n)]))
    every = by.agg(F.count("*").alias("values"), *[F.sum(f"c{k}").alias(f"a{k}") for k in range(n)]).first()
    log = lambda k: F.log((F.col(f"c{k}") + VALUE_SMOOTH) / ((every[f"a{k}"] or 0.0) + VALUE_SMOOTH * every["values"]))
    values = by.select(column, *[log(k).alias(f"{column}_l{k}") for k in range(n)])
    return F.broadcast(values) if every["values"] <= BROADCAST_VALUES else values


def fuse(evidence: DataFrame, langs: list[str]) -> DataFrame:
    """KEYS with lang, confidence, text_lang and kept from `text_evidence`."""
    n = len(langs)
    each = range(n)
    names = F.array(*[F.lit(x) for x in langs])
    raw = _total([F.exp(F.col(f"e{k}")) for k in each])
    seen = evidence.withColumns({f"p{k}": F.exp(F.col(f"e{k}")) / raw for k in each})
    # the host's prior: counts by host, then domain, then all
    hosts = cut(seen.groupBy("host", "domain").agg(F.count("*").alias("h"), *[F.sum(f"p{k}").alias(f"h{k}") for k in each]))
    domains = hosts.groupBy("domain").agg(F.sum("h").alias("d"), *[F.sum(f"h{k}").alias(f"d{k}") for k in each])
    every = hosts.agg(F.sum("h").alias("h"), *[F.sum(f"h{k}").alias(f"h{k}") for k in each]).first()
    rows = every["h"] or 0
    base = [((every[f"h{k}"] or 0.0) + 1.0) / (rows + n) for k in each]
    prior = {f"t{k}": (F.col(f"d{k}") + SMOOTH * base[k]) / (F.col("d") + SMOOTH) for k in each}
    hosts = hosts.join(domains, "domain").withColumns(prior).select("host", "domain", "h", *[f"{x}{k}" for x in "ht" for k in each])
    out = seen.join(hosts, ["host", "domain"])
    score = [F.col(f"e{k}") + F.log((F.greatest(F.col(f"h{k}") - F.col(f"p{k}"), F.lit(0.0)) + SMOOTH * F.col(f"t{k}")) / (F.col("h") - 1 + SMOOTH)) for k in each]
    for column in ("declared", "suffix", "code"):
        out = out.join(_value_table(seen, column, n), column, "left")
        score = [s + F.coalesce(F.col(f"{column}_l{k}"), F.lit(0.0)) for k, s in enumerate(score)]
    out = out.withColumn("_s", F.array(*score)).withColumn("_p", F.transform("_s", lambda x: F.exp(x - F.array_max("_s"))))
    confidence = F.round(F.lit(1.0) / F.aggregate("_p", F.lit(0.0), lambda a, x: a + x), 6)
    text = F.array(*[F.col(f"e{k}") for k in each])
    best = F.element_at(names, F.array_position("_s", F.array_max("_s")).cast("int"))
    out = out.withColumn("confidence", confidence).withColumn("kept", F.col("confidence") >= CONFIDENT)
    out = out.withColumn("lang", F.when(F.col("kept"), best).otherwise(F.lit("und"))).withColumn("text_lang", F.element_at(names, F.array_position(text, F.array_max(text)).cast("int")))
    return out.select(*KEYS, "lang", "confidence", "text_lang", "kept")


_LANG = re.compile(r"\blang\s*=\s*[\"']?([a-z]{2,3})\b", re.IGNORECASE)
_CLOSED = {name: re.compile(rf"</{name}\s*>", re.IGNORECASE) for name in ("script", "style")}


def read_page(page: str) -> tuple[str | None, str]:
    """(declared language of the first html tag that has one, text outside tags, comments, scripts and styles), in one linear pass over the page.

    A script or a style that isn't closed reaches to the end of the page.
    """
    parts, declared, jump = [], None, None
    source = tokens(page)
    while True:
        try:
            text, tag, attributes, to = source.send(jump)
        except StopIteration:
            return declared, " ".join(parts)
        jump = None
        parts.append(text)
        if tag == "html" and declared is None and (found := _LANG.search(attributes)):
            declared = found[1].lower()
        if tag in _CLOSED and not attributes.endswith("/"):
            end = _CLOSED[tag].search(page, to)
            jump = end.end() if end else len(page)


@F.arrow_udf(returnType=T.StructType([T.StructField("declared", T.StringType()), T.StructField("text", T.StringType())]))
def _read(pages: pa.Array) -> pa.Array:
    found = [read_page(x.as_py() or "") for x in pages]
    return pa.StructArray.from_arrays([pa.array([d for d, _ in found], pa.string()), pa.array([t for _, t in found], pa.string())], ["declared", "text"])


def web_rows(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """KEYS and text of pages: the markup's language, and from the address host, domain, suffix and a language code in the path."""
    small_batches(pages.sparkSession)
    url = F.col(url_col)
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    empty = lambda c: F.when(c != "", c)
    rows = pages.select(
        F.lit("pages").alias("kind"), F.col(id_col).cast("long").alias("id"), host.alias("host"), F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1).alias("domain"),
        empty(F.regexp_extract(host, r"\.([a-z0-9-]+)$", 1)).alias("suffix"),
        empty(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"//[^/]*/([a-zA-Z]{2})(?:[-_][a-zA-Z]{2})?(?:[/?#]|$)", 1))).alias("code"),
        _read(html_col).alias("read"),
    )
    return rows.select("kind", "id", "host", "domain", "suffix", "code", "read.declared", "read.text")


def document_rows(docs: DataFrame) -> DataFrame:
    """KEYS and text of documents: the source is the host, and there is no markup or address."""
    none = F.lit(None).cast("string")
    return docs.select(
        F.lit("documents").alias("kind"), F.col("doc_id").cast("long").alias("id"), F.coalesce("source", F.lit("")).alias("host"), F.lit("").alias("domain"),
        none.alias("suffix"), none.alias("code"), none.alias("declared"), "text",
    )


def identify(rows: DataFrame, labelled: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """KEYS, lang, confidence, text_lang and kept of rows (KEYS, text), with a model of labelled (id, text, lang)."""
    langs, logs = train(labelled, sample)
    if not langs:
        und = F.lit("und")
        return rows.select(*KEYS, und.alias("lang"), F.lit(0.0).alias("confidence"), und.alias("text_lang"), F.lit(False).alias("kept"))
    return fuse(cut(text_evidence(rows, langs, logs)), langs)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and each page."""
    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    found = identify(document_rows(docs).unionByName(web_rows(pages)), docs.select(F.col("doc_id").alias("id"), "text", "lang"))
    of = lambda kind: F.when(F.col("kind") == kind, F.col("id"))
    return found.select("kind", of("documents").alias("doc_id"), of("pages").alias("page_id"), "lang", "confidence", "text_lang", "declared", "kept")


SQL = None
