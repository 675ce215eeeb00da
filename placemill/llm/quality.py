"""Quality rules: learned decision lists over statistics of whole texts.

`learn` is sequential covering: a rule, a conjunction of thresholds on statistics, is grown on two thirds of the rows that no
earlier rule covers, literal by literal with the largest gain, then pruned on the other third from its end; it enters the list if it is
precise enough there.  Rules that drop may need exceptions, rules that keep, which come before them.  The first rule that holds decides: `verdict` emits
the list as an ordered Spark conditional expression; rows under no rule are kept.

A document also fails outright, whatever the list says, below 20 words or if more than 30 % of its words stand in repeated
8-word windows.  Null and empty texts have all statistics 0 and so fail.  Repeated rows get a result each.  Without labels, or
without a precise rule, the list is empty and only the outright failures go.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placemill.llm.common import as_rows, release, small_batches, table
from placemill.llm.words import _WS, mix, slices

#: Labelled rows that the list is learned from, at most; those with the smallest hash of their id.
SAMPLE = 4000
WINDOW = 8

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct_words", "n_upper", "n_digits", "n_marks", "n_lines"]
STATS_TYPE = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS])

_SYMBOL, _UPPER, _DIGIT, _MARK = (np.isin(np.arange(256), list(s)) for s in (b"#*$%&|<>", bytes(range(65, 91)), bytes(range(48, 58)), b".!?"))


def statistics(texts: pa.Array) -> pa.Array:
    """COUNTS of each text."""
    out = {c: np.zeros(len(texts), dtype=np.int64) for c in COUNTS}
    for w in slices(texts):
        here = slice(w.first, w.first + w.rows)

        def by_row(flags: np.ndarray) -> np.ndarray:
            run = np.concatenate(([0], np.cumsum(flags)))
            return run[w.offsets[1:]] - run[w.offsets[:-1]]  # noqa: B023

        out["n_words"][here] = np.diff(w.bounds)
        out["word_chars"][here] = by_row(((w.data & 0xC0) != 0x80) & ~_WS[w.data])
        for c, t in (("n_symbols", _SYMBOL), ("n_upper", _UPPER), ("n_digits", _DIGIT), ("n_marks", _MARK)):
            out[c][here] = by_row(t[w.data])
        raw = w.data.tobytes()
        for k in range(w.rows):
            lines = [x for x in raw[w.offsets[k] : w.offsets[k + 1]].split(b"\n") if x.strip()]
            out["n_lines"][w.first + k], out["n_dup_lines"][w.first + k] = len(lines), len(lines) - len(set(lines))
        if len(w.start):
            own = mix(w.row.astype(np.uint64))
            words = w.hashes()
            order = np.argsort(mix(words ^ own))
            new = np.ones(len(order), dtype=bool)
            new[1:] = (words[order[1:]] != words[order[:-1]]) | (w.row[order[1:]] != w.row[order[:-1]])
            out["n_distinct_words"][here] = np.bincount(w.row[order[new]], minlength=w.rows)
            windows, whole = w.windows(words, WINDOW)
            at = np.flatnonzero(whole)
            order = at[np.argsort(mix(windows[at] ^ own[at]))]
            twin = (windows[order[1:]] == windows[order[:-1]]) & (w.row[order[1:]] == w.row[order[:-1]])
            if twin.any():
                again = np.zeros(len(words) + 1, dtype=np.int64)
                for starts in (order[1:][twin], order[:-1][twin]):
                    starts = np.unique(starts)
                    np.add.at(again, starts, 1)
                    np.add.at(again, starts + WINDOW, -1)
                out["n_repeat_words"][here] = np.bincount(w.row[np.cumsum(again)[:-1] > 0], minlength=w.rows)
    release()
    return pa.StructArray.from_arrays([pa.array(out[c]) for c in COUNTS], COUNTS)


_stats = F.arrow_udf(statistics, STATS_TYPE)


def stats(docs: DataFrame) -> Column:
    """The statistics of docs' text."""
    small_batches(docs.sparkSession)
    return _stats("text")


def base_failed(s: Column) -> Column:
    return (s["n_words"] < 20) | (100 * s["n_repeat_words"] > 30 * s["n_words"])


def features(s: Column) -> dict[str, Column]:
    """Ratios that the rules set thresholds on; 0 where there is nothing to divide by."""
    ratio = lambda a, b: F.coalesce(s[a] / F.nullif(s[b], F.lit(0)), F.lit(0.0))
    return {
        "n_words": s["n_words"].cast("double"),
        "chars_per_word": ratio("word_chars", "n_words"),
        "symbols_per_char": ratio("n_symbols", "word_chars"),
        "symbols_per_word": ratio("n_symbols", "n_words"),
        "dup_lines": ratio("n_dup_lines", "n_lines"),
        "repeated_words": ratio("n_repeat_words", "n_words"),
        "distinct_words": ratio("n_distinct_words", "n_words"),
        "upper": ratio("n_upper", "word_chars"),
        "digits": ratio("n_digits", "word_chars"),
        "marks_per_word": ratio("n_marks", "n_words"),
        "words_per_line": ratio("n_words", "n_lines"),
    }


@dataclass(frozen=True)
class Literal:
    feature: str
    above: bool
    threshold: float

    def holds(self, values: np.ndarray) -> np.ndarray:
        return values > self.threshold if self.above else values <= self.threshold


class Shield(tuple):
    """A rule whose texts are kept, whatever later rules say."""


#: Literals that all have to hold; its verdict is to drop, unless it is a Shield.
Rule = tuple[Literal, ...] | Shield


def _covers(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    held = np.ones(n, dtype=bool)
    for lit in rule:
        held &= lit.holds(x[lit.feature])
    return held


def _best(x: dict[str, np.ndarray], bad: np.ndarray) -> tuple[float, Literal | None]:
    """The literal with the largest gain in information over the rows given, times the bad ones that it covers."""
    p, n = int(bad.sum()), len(bad)
    before, best = np.log2(p / n), (0.0, None)
    for name, values in x.items():
        order = np.argsort(values, kind="stable")
        v, run = values[order], np.cumsum(bad[order])
        ends = np.flatnonzero(v[1:] > v[:-1])  # a threshold stands between two values
        if not len(ends):
            continue
        for above in (False, True):
            pos = (p - run[ends] if above else run[ends]).astype(float)
            size = (n - ends - 1 if above else ends + 1).astype(float)
            gain = np.where(pos > 0, pos * (np.log2(np.maximum(pos, 1e-9) / size) - before), 0.0)
            k = int(np.argmax(gain))
            if gain[k] > best[0] + 1e-9:
                best = (float(gain[k]), Literal(name, above, float((v[ends[k]] + v[ends[k] + 1]) / 2)))
    return best


def _rule(x: dict[str, np.ndarray], wanted: np.ndarray, rows: np.ndarray, alive: np.ndarray, grow: np.ndarray) -> tuple[Literal, ...]:
    """A conjunction for the wanted ones of rows: grown on the part `grow` of them until it covers no other, then pruned from its end on the other part of those alive."""
    n, rule, rows = len(wanted), (), rows & grow
    while (wanted & rows).any() and (~wanted & rows).any():
        gain, literal = _best({k: v[rows] for k, v in x.items()}, wanted[rows])
        if literal is None:
            break
        rule += (literal,)
        rows = rows & literal.holds(x[literal.feature])
    test = alive & ~grow

    def worth(r: tuple[Literal, ...]) -> float:
        c = _covers(r, x, n) & test
        return ((c & wanted).sum() - (c & ~wanted).sum()) / max(1, c.sum())

    while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
        rule = rule[:-1]
    return rule


def learn(x: dict[str, np.ndarray], bad: np.ndarray, precision: float = 0.9, support: int = 5) -> list[Rule]:
    """The decision list, in its order, its default being to keep.

    Rules that drop are learned one after the other, each on the rows that no earlier rule covers.  One that isn't precise enough gets exceptions before it: a
    rule that keeps (`Shield`) is learned among what it covers, and it is learned again.  A rule enters if at least `support` of the rows
    that it covers are of its verdict, and the share `precision` of them, on all rows and on those it wasn't grown on.  The list ends
    when no rule is good enough; neither its length nor that of a rule has a limit.
    """
    n, grow = len(bad), np.arange(len(bad)) % 3 != 2
    rules: list[Rule] = []
    alive = np.ones(n, dtype=bool)

    def enters(rule: tuple[Literal, ...], wanted: np.ndarray) -> bool:
        covered = _covers(rule, x, n) & alive
        seen = covered & ~grow
        return bool(rule) and (covered & wanted).sum() >= support and all((c & wanted).sum() >= precision * c.sum() for c in (covered, seen))

    while (bad & alive & grow).sum() >= support:
        rule: Rule = _rule(x, bad, alive, alive, grow)
        if not enters(rule, bad):
            rule = Shield(_rule(x, ~bad, alive & _covers(rule, x, n), alive, grow)) if rule else ()
            if not enters(rule, ~bad):
                break
        rules.append(rule)
        alive &= ~_covers(rule, x, n)
    while rules and isinstance(rules[-1], Shield):  # nothing comes after it that it could keep a row from
        rules.pop()
    return rules


def verdict(rules: list[Rule], s: Column) -> Column:
    """True where a text is kept: the decision list as one ordered conditional expression."""
    x, chain = features(s), None
    for rule in rules:
        held = F.lit(True)
        for lit in rule:
            held = held & (x[lit.feature] > lit.threshold if lit.above else x[lit.feature] <= lit.threshold)
        keep = F.lit(isinstance(rule, Shield))
        chain = F.when(held, keep) if chain is None else chain.when(held, keep)
    return F.lit(True) if chain is None else chain.otherwise(F.lit(True))


def learned(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, **options) -> list[Rule]:
    """The decision list from the labelled rows of docs (doc_id, text), labels (doc_id, quality)."""
    chosen = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_id"), (F.col("quality") == 0).alias("_bad"))
    chosen = chosen.orderBy(F.xxhash64("_id"), "_id", "_bad").limit(sample)  # no more than `sample` rows: they may be broadcast and collected
    s, own = F.col("_s"), docs.select("doc_id", "text")
    rows = own.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("_id", "_bad", stats(own).alias("_s"))
    x = features(s)
    # what fails outright needs no rule; repeated ids may make more than `sample` rows, of which the first in a fixed order are taken
    rows = rows.filter(~base_failed(s)).select("_id", "_bad", *[c.alias(k) for k, c in x.items()])
    rows = rows.orderBy(F.xxhash64("_id"), "_id", "_bad", *x).limit(sample).toPandas()
    if not len(rows) or not rows["_bad"].any():
        return []
    rows = rows.iloc[np.lexsort((*[rows[k] for k in x], rows["_bad"], rows["_id"], mix(rows["_id"].to_numpy().astype(np.uint64))))]
    return learn({k: rows[k].to_numpy() for k in x}, rows["_bad"].to_numpy().astype(bool), **options)


def judged(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """(doc_id, COUNTS, base_failed, kept), a row for each row of docs."""
    s = F.col("_s")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), stats(docs).alias("_s"))
    return rows.select("doc_id", *[s[c].alias(c) for c in COUNTS], base_failed(s).alias("base_failed"), (~base_failed(s) & verdict(rules, s)).alias("kept"))


def quality_filter(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of docs that are kept, with all their columns, whatever these are called."""
    rules = learned(docs, labels, **options)
    s = F.col("_s")
    rows = docs.select(as_rows(docs).alias("row"), stats(docs).alias("_s"))
    return rows.filter(~base_failed(s) & verdict(rules, s)).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judged(docs, learned(docs, table(spark, sf_dir, "labels")))


SQL = None
