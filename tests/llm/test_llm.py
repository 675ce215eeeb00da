"""Every training-data operator against brute force on a small fixture with nulls, empty and long texts, ties and repeated rows."""

import collections
import hashlib
import html
import os
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from placemill.llm import exact_dedup, jaccard_join, language_id, line_dedup, mixing, packing, page_text, quality, registry, substring_dedup, token_count
from placemill.llm.common import components, ranked
from placemill.llm.words import slices

WORD = re.compile("[^\x20\x09-\x0d]+")


def words(text):
    return WORD.findall(text or "")


def bag(frame):
    return collections.Counter(tuple(r) for r in frame.collect())


# helpers


def test_words_of_buffers():
    r = random.Random(1)
    texts = [None, "", " ", "a", "é\x0bz", "\x1c x y "] + ["".join(r.choice("ab é\n\t漢") for _ in range(r.randint(0, 30))) for _ in range(300)]
    seen = {}
    for w in slices(pa.array(texts), limit=40):
        raw, hashes = w.data.tobytes(), w.hashes()
        for k in range(w.rows):
            a, b = w.bounds[k], w.bounds[k + 1]
            found = [raw[s:e].decode() for s, e in zip(w.start[a:b], w.end[a:b], strict=True)]
            assert found == words(texts[w.first + k])
            for x, h in zip(found, hashes[a:b], strict=True):
                assert seen.setdefault(x, h) == h
    assert len(set(seen.values())) == len(seen)


def test_ranks_and_components(spark):
    frame = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("id"), (F.col("id") % 10).alias("v"))
    got = ranked(frame, [F.col("id")]).collect()
    assert all(r["rank"] == r["id"] + 1 for r in got)
    r = random.Random(2)
    pairs = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(180)] + [(k, k + 1) for k in range(1000, 1040)] + [(2000, k) for k in range(2001, 2100)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    got = {x["id"]: x["component"] for x in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: find(x) for x in up if find(x) != x}


# 1


def test_language_of_held_out_rows(spark, docs):
    labelled = docs.filter("doc_id < 5000 and lang is not null").select(F.col("doc_id").alias("id"), "text", "lang")
    found = language_id.identify(language_id.document_rows(docs.filter("text is not null")), labelled.filter("id % 3 <> 0"))
    both = found.join(labelled.filter("id % 3 = 0").select("id", F.col("lang").alias("given")), "id")
    n, right = both.count(), both.filter("lang = given").count()
    assert n > 50 and right / n >= 0.95


def test_markup_address_and_host_decide_where_the_text_is_silent(spark):
    text = {"en": "the house and the garden of the king with that water", "fr": "la maison et le jardin du roi avec cette eau pour les"}
    pages = [(k, f"http://{lang}.host{k % 2}.{tld}/{lang}/{k}", f'<html lang="{lang}"><p>{text[lang]} {k}</p>') for k, (lang, tld) in enumerate([("en", "com"), ("fr", "fr")] * 30)]
    pages += [(900, "http://fr.host1.fr/x", "<p></p>"), (901, "http://en.host0.com/x", '<html lang="en">1'), (902, None, None), (903, "http://other.org/fr/1", "<html lang='fr'>")]
    labelled = spark.createDataFrame([(k, t, lang) for k, (lang, t) in enumerate(text.items())], "id long, text string, lang string")
    frame = language_id.web_rows(spark.createDataFrame(pages, "page_id long, url string, html string"))
    got = {r["id"]: r for r in language_id.identify(frame, labelled).collect()}
    assert len(got) == 64 and all(got[k]["lang"] == lang for k, lang in enumerate(["en", "fr"] * 30))
    assert (got[900]["lang"], got[901]["lang"], got[903]["lang"]) == ("fr", "en", "fr") and got[902]["confidence"] <= 0.6


@pytest.mark.parametrize("part", ["<script>", "<html ", "<!--", "<style>", "<html lang=", "<", "<a '", "</script", "<script>x</style>"])
def test_broken_pages_are_read_in_linear_time(part):
    took = []
    for n in (50_000, 200_000):
        start = time.process_time()
        language_id.read_page(part * n)
        took.append(time.process_time() - start)
    assert took[1] < 12 * max(took[0], 0.05)


def test_pages_are_read_like_their_markup():
    page = '<!doctype html><HTML class=x LANG="DE-at"><head><title>T</title><style>p {}</style ></head><!-- <html lang=fr> --><script type="a>b">if (a < b) "</p>"</SCRIPT><p>one<b>two</b></p><script/>three'
    declared, text = language_id.read_page(page)
    assert declared == "de" and text.split() == ["T", "one", "two", "three"]
    assert language_id.read_page("") == (None, "") and language_id.read_page("a < b <script>c") == (None, "a < b  ")


def test_language_without_labels_or_rows(spark, docs, empty):
    none = docs.limit(0).select(F.col("doc_id").alias("id"), "text", "lang")
    found = language_id.identify(language_id.document_rows(docs), none)
    assert found.count() == docs.count() and [r["lang"] for r in found.select("lang").distinct().collect()] == ["und"]
    labelled = docs.select(F.col("doc_id").alias("id"), "text", "lang")
    assert language_id.identify(language_id.document_rows(empty), labelled).count() == 0


def brute_fusion(rows, langs):
    """(lang, confidence) of rows (host, domain, suffix, code, declared, e), from the formula of the docstring."""
    n = len(langs)
    p = [np.exp(r[5]) / np.exp(r[5]).sum() for r in rows]
    total = (sum(p) + 1.0) / (len(rows) + n)
    out = []
    for r, own in zip(rows, p, strict=True):
        same = [q for o, q in zip(rows, p, strict=True) if o[:2] == r[:2]]
        near = [q for o, q in zip(rows, p, strict=True) if o[1] == r[1]]
        domain = (sum(near) + language_id.SMOOTH * total) / (len(near) + language_id.SMOOTH)
        score = r[5] + np.log((sum(same) - own + language_id.SMOOTH * domain) / (len(same) - 1 + language_id.SMOOTH))
        for k in (2, 3, 4):
            if r[k] is not None:
                have = [(o[k], q) for o, q in zip(rows, p, strict=True) if o[k] is not None]
                every, mine = sum(q for _, q in have), sum(q for v, q in have if v == r[k])
                score = score + np.log((mine + language_id.VALUE_SMOOTH) / (every + language_id.VALUE_SMOOTH * len({v for v, _ in have})))
        x = np.exp(score - score.max())
        out.append((langs[int(np.argmax(score))], 1 / x.sum()))
    return out


@pytest.mark.parametrize("most", [10_000, 0])
def test_fusion_against_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(language_id, "BROADCAST_VALUES", most)
    r, langs = random.Random(4), ["de", "en", "fr"]
    pick = lambda *v: r.choice([*v, None])
    rows = []
    for _ in range(150):
        host = r.choice(["a.x.de", "b.x.de", "c.y.fr", "d.z.com", ""])
        e = np.array([r.uniform(-6, 0) for _ in langs])
        rows.append((host, host[2:], pick("de", "fr", "com"), pick("de", "en"), pick("de", "fr", "xx"), e - e.max()))
    schema = language_id.KEY_SCHEMA + ", e0 double, e1 double, e2 double"
    frame = spark.createDataFrame([("pages", k, *x[:5], *map(float, x[5])) for k, x in enumerate(rows)], schema)
    got = {x["id"]: x for x in language_id.fuse(frame, langs).collect()}
    for k, (lang, confidence) in enumerate(brute_fusion(rows, langs)):
        assert got[k]["confidence"] == pytest.approx(confidence, abs=1e-5) and got[k]["kept"] == (got[k]["confidence"] >= 0.5)
        assert got[k]["lang"] == (lang if got[k]["kept"] else "und")


def test_every_labelled_language_is_learned(spark):
    labelled = spark.createDataFrame([(k, chr(0x4E00 + k) * 40, f"l{k:03}") for k in range(80)], "id long, text string, lang string")
    assert language_id.train(labelled)[0] == [f"l{k:03}" for k in range(80)]


# 2


def brute_list(rules, stats):
    """Whether a text is kept, literal by literal in the order of the list."""
    ratio = lambda a, b: stats[a] / stats[b] if stats[b] else 0.0
    x = {
        "n_words": stats["n_words"], "chars_per_word": ratio("word_chars", "n_words"), "symbols_per_char": ratio("n_symbols", "word_chars"), "symbols_per_word": ratio("n_symbols", "n_words"),
        "dup_lines": ratio("n_dup_lines", "n_lines"), "repeated_words": ratio("n_repeat_words", "n_words"), "distinct_words": ratio("n_distinct_words", "n_words"), "upper": ratio("n_upper", "word_chars"),
        "digits": ratio("n_digits", "word_chars"), "marks_per_word": ratio("n_marks", "n_words"), "words_per_line": ratio("n_words", "n_lines"),
    }
    if stats["n_words"] < 20 or 100 * stats["n_repeat_words"] > 30 * stats["n_words"]:
        return False
    return not any(all(x[lit.feature] > lit.threshold if lit.above else x[lit.feature] <= lit.threshold for lit in rule) for rule in rules)


def test_verdict_against_the_list(docs):
    lit = quality.Literal
    for rules in ([], [(lit("upper", True, 0.05), lit("n_words", False, 300.0))], [(lit("marks_per_word", False, 0.08),), (lit("words_per_line", True, 9.0), lit("chars_per_word", True, 4.5), lit("digits", False, 0.01))]):
        got = quality.judged(docs, rules).collect()
        assert [r["kept"] for r in got] == [brute_list(rules, r.asDict()) for r in got] and len(got) == docs.count()


def test_the_list_is_the_same_in_every_run(spark):
    d = "/root/testdata/sf0.01"
    table, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    twice = table.union(table.withColumn("text", F.upper("text")))
    assert quality.learned(twice, labels, sample=100) == quality.learned(twice.repartition(5), labels.repartition(3), sample=100)


def brute_statistics(text):
    w = words(text)
    windows = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    covered = {k + j for k in range(len(w) - 7) if windows[tuple(w[k : k + 8])] > 1 for j in range(8)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_statistics_against_brute_force(rows):
    r = random.Random(6)
    texts = [t for _, t, _ in rows] + [" ".join(r.choice("abc") for _ in range(r.randint(0, 60))) for _ in range(300)]
    got = quality.statistics(pa.array(texts, pa.string())).to_pylist()
    assert [tuple(g[c] for c in quality.COUNTS[:5]) for g in got] == [brute_statistics(t) for t in texts]


def test_covering_finds_planted_rules():
    r = np.random.default_rng(3)
    x = {"a": r.random(3000), "b": r.random(3000), "c": r.random(3000)}
    bad = (x["a"] > 0.8) & (x["b"] <= 0.5) | (x["c"] > 0.95)
    rules = quality.learn(x, bad)
    held = np.zeros(3000, dtype=bool)
    for rule in rules:
        held |= quality._covers(rule, x, 3000)
    assert rules and (held == bad).mean() > 0.98
    assert quality.learn(x, np.zeros(3000, dtype=bool)) == [] and quality.learn(x, r.random(3000) < 0.2) == []


def test_exceptions_come_before_the_rule(spark):
    """Good rows without a pattern inside a bad region: the list needs a rule that keeps, and its place in the list decides."""
    r = np.random.default_rng(11)
    x = {k: r.random(6000) for k in ("n_words", "upper", "digits")}
    bad = (x["upper"] > 0.5) & ((x["digits"] <= 0.7) | (r.random(6000) < 0.02)) & (r.random(6000) > 0.06)
    rules = quality.learn(x, bad)
    assert rules and not isinstance(rules[-1], quality.Shield)
    kept = np.array([brute_verdict(rules, {k: v[i] for k, v in x.items()}) for i in range(6000)])
    assert (kept == ~bad).mean() > 0.95

    lit = quality.Literal
    keep, drop = quality.Shield((lit("digits", True, 0.7),)), (lit("upper", True, 0.5),)
    for rules, want in (([keep, drop], [True, False, True]), ([drop, keep], [False, False, True])):
        assert [brute_verdict(rules, {"digits": d, "upper": u}) for d, u in ((0.8, 0.9), (0.1, 0.9), (0.1, 0.1))] == want
    text = "AB 12 " * 3 + " ".join(f"Ab{k}" for k in range(30))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    keep, drop = quality.Shield((lit("digits", True, 0.1),)), (lit("upper", True, 0.1),)
    assert [quality.judged(docs, rules).first()["kept"] for rules in ([keep, drop], [drop, keep])] == [True, False]


def brute_verdict(rules, x):
    for rule in rules:
        if all(x[lit.feature] > lit.threshold if lit.above else x[lit.feature] <= lit.threshold for lit in rule):
            return isinstance(rule, quality.Shield)
    return True


def brute_covering(x, bad, precision=0.9, support=5):
    """The covering, written again over all thresholds of a small table."""
    n = len(bad)
    holds = lambda rule, i: all(x[f][i] > t if above else x[f][i] <= t for f, above, t in rule)

    def grown(wanted, rows, alive):
        rule, rows = [], [i for i in rows if i % 3 != 2]
        while any(wanted[i] for i in rows) and not all(wanted[i] for i in rows):
            p, best = sum(wanted[i] for i in rows), (0.0, None)
            for f in x:
                values = sorted({x[f][i] for i in rows})
                cuts = [(a + b) / 2 for a, b in zip(values, values[1:], strict=False)]
                for above in (False, True):
                    top = (0.0, None)
                    for t in cuts:
                        inside = [i for i in rows if (x[f][i] > t) == above]
                        pos = sum(wanted[i] for i in inside)
                        gain = pos * (np.log2(pos / len(inside)) - np.log2(p / len(rows))) if pos else 0.0
                        if top[1] is None or gain > top[0] + 1e-12:
                            top = (gain, (f, above, t))
                    if top[1] is not None and top[0] > best[0] + 1e-9:
                        best = top
            if best[1] is None:
                break
            rule.append(best[1])
            rows = [i for i in rows if holds(rule, i)]

        def worth(r):
            c = [i for i in alive if i % 3 == 2 and holds(r, i)]
            return sum(1 if wanted[i] else -1 for i in c) / max(1, len(c))

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule.pop()
        return rule

    def enters(rule, wanted, alive):
        c = [i for i in alive if holds(rule, i)]
        seen = [i for i in c if i % 3 == 2]
        return bool(rule) and sum(wanted[i] for i in c) >= support and all(sum(wanted[i] for i in g) >= precision * len(g) for g in (c, seen))

    good, alive, out = [not b for b in bad], list(range(n)), []
    while sum(bad[i] for i in alive if i % 3 != 2) >= support:
        rule, keep = grown(bad, alive, alive), False
        if not enters(rule, bad, alive):
            rule, keep = grown(good, [i for i in alive if holds(rule, i)], alive) if rule else [], True
            if not enters(rule, good, alive):
                break
        out.append((keep, tuple(rule)))
        alive = [i for i in alive if not holds(rule, i)]
    while out and out[-1][0]:
        out.pop()
    return out


@pytest.mark.parametrize("seed", range(6))
def test_covering_against_brute_force(seed):
    r = np.random.default_rng(seed)
    n = 120
    x = {"a": r.integers(0, 12, n) / 4, "b": r.integers(0, 9, n) / 2, "c": r.random(n)}
    bad = (x["a"] > 1.5) & (x["b"] <= 3) & (r.random(n) < [0.97, 0.85, 0.7][seed % 3])
    got = [(isinstance(rule, quality.Shield), tuple((t.feature, t.above, t.threshold) for t in rule)) for rule in quality.learn(x, bad)]
    assert got == brute_covering({k: v.tolist() for k, v in x.items()}, bad.tolist())


def test_quality_on_held_out_labels(spark, docs):
    d = "/root/testdata/sf0.01"
    table, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rules = quality.learned(table, labels.filter("doc_id % 2 = 0"))
    both = quality.judged(table, rules).join(labels.filter("doc_id % 2 = 1"), "doc_id").filter("not base_failed")
    assert both.filter("quality = 1 and not kept").count() == 0
    whole = quality.judged(docs, rules)
    assert whole.count() == docs.count() and whole.filter("base_failed and kept").count() == 0
    kept = quality.quality_filter(docs, labels.limit(0))
    assert kept.columns == docs.columns and kept.count() == quality.judged(docs, []).filter("kept").count()


# 3


def brute_mix(rows, weights=(5, 2, 1), most=3, seed=17):
    sizes = [(d, s, len(words(t))) for d, t, s in rows]
    total = collections.Counter()
    for _, s, n in sizes:
        total[s] += n
    names = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % 3] for k, s in enumerate(names)}
    target, left, open_ = {}, sum(total.values()), set(names)
    while True:  # share, fix those above their limit, share the rest again
        share = {s: left * weight[s] / sum(weight[t] for t in open_) for s in open_}
        full = {s for s in open_ if share[s] > most * total[s]}
        if not full:
            target |= share
            break
        for s in full:
            target[s] = most * total[s]
            left -= target[s]
        open_ -= full
    return sizes, total, target


def test_mix_against_resharing(docs, rows):
    sizes, total, target = brute_mix(rows)
    got = [tuple(r) for r in mixing.mix_documents(docs).collect()]
    assert collections.Counter((r[0], r[1], r[2]) for r in got) == collections.Counter(sizes)
    taken = collections.Counter()
    for _, s, size, source_size, goal, words_taken in got:
        assert source_size == total[s] and goal == pytest.approx(target[s]) and words_taken in (0, size, 2 * size, 3 * size)
        taken[s] += words_taken
    largest = {s: max(n for _, t, n in sizes if t == s) for s in total}
    assert sum(taken.values()) <= sum(total.values())
    assert all(abs(taken[s] - target[s]) <= largest[s] + max(largest.values()) for s in total)
    assert sorted(map(str, got)) == sorted(str(tuple(r)) for r in mixing.mix_documents(docs.repartition(7)).collect())


def test_mix_ends_at_the_budget_beyond_all_ticks(spark):
    draw = random.Random(7)
    sizes = [(k, f"host{k}", 1 + int(draw.lognormvariate(2, 1.5))) for k in range(3000)]
    got = [tuple(r) for r in mixing.mix(spark.createDataFrame(sizes, "doc_id long, source string, size long")).select("doc_id", "size", "target", "taken").collect()]
    budget = sum(size for _, _, size in sizes)
    order = sorted((size / target + e * size / target, hashlib.md5(f"17:{k}".encode()).hexdigest(), k, e, size) for k, size, target, _ in got for e in range(3))
    want, upto, last = collections.Counter(), 0, 0.0
    for finish, _, k, _, size in order:
        upto += size
        if upto > budget:
            break
        want[k] += size
        last = finish
    assert last > 1.5 and {k: taken for k, _, _, taken in got if taken} == want


def brute_taken(sizes, target, most=3, seed=17):
    """Words taken by id, from the order of all copies; sizes (id, source, size)."""
    served, order = collections.Counter(), []
    for k, s, n in sorted(sizes, key=lambda x: (hashlib.md5(f"{seed}:{x[0]}".encode()).hexdigest(), x[0], x[2])):
        served[s] += n
        total = sum(m for _, t, m in sizes if t == s)
        order += [(served[s] / target[s] + e * total / target[s], hashlib.md5(f"{seed}:{k}".encode()).hexdigest(), k, e, n) for e in range(most) if n]
    taken, upto = collections.Counter(), 0
    for _, _, k, _, n in sorted(order):
        upto += n
        if upto > sum(m for _, _, m in sizes):
            break
        taken[k] += n
    return taken


@pytest.mark.parametrize("case", ["b100 a10 b100 c300", "b5 c17 a40 b10", *range(6)])
def test_mix_takes_no_more_than_the_budget(spark, case):
    draw = random.Random(case)
    listed = [(x[0], int(x[1:])) for x in case.split()] if isinstance(case, str) else [(draw.choice("abcd"), draw.randint(0, 120)) for _ in range(draw.randint(1, 9))]
    sizes = [(k, s, n) for k, (s, n) in enumerate(listed)]
    got = [tuple(r) for r in mixing.mix(spark.createDataFrame(sizes, "doc_id long, source string, size long").coalesce(1)).select("doc_id", "source", "target", "taken").collect()]
    target = {s: t for _, s, t, _ in got}
    assert {k: n for k, _, _, n in got if n} == dict(brute_taken(sizes, target))
    assert sum(n for _, _, _, n in got) <= sum(n for _, _, n in sizes)


CLASH = ["_own", "_gone", "_id", "_key", "_words", "_copy", "_n", "_size", "_lost", "_quality_stats", "_s", "row", "own", "gone", "left", "id", "size", "words", "copy", "key", "n", "_v", "_part", "bucket", "h1", "lost", "listed"]


def test_columns_of_clashing_names_are_carried_along(spark):
    text = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
    base = spark.createDataFrame([(k, f"{text} {k % 3}\nsecond line\nthird line", "s") for k in range(6)], "doc_id long, text string, source string")
    docs = base.withColumns({c: F.concat(F.lit(f"{c}-"), F.col("doc_id").cast("string")) for c in CLASH})
    labels = spark.createDataFrame([], "doc_id long, quality long")
    outs = {"quality": quality.quality_filter(docs, labels), "lines": line_dedup.line_dedup(docs), "near": jaccard_join.one_of_each(docs), "mix": mixing.mixed(docs)}
    for name, out in outs.items():
        assert out.columns == docs.columns, name
        found = out.collect()
        assert found and all(r[c] == f"{c}-{r['doc_id']}" for r in found for c in CLASH), name


@pytest.mark.parametrize("seed", range(8))
def test_what_is_written_is_what_is_taken(spark, seed):
    """Repeated ids, in one and in several sources, of equal and of other sizes."""
    r = random.Random(seed)
    rows = [(r.choice([None, *range(4)]), " ".join(["w"] * r.randint(0, 9)), r.choice(["a", "b", None]), k) for k in range(r.randint(1, 25))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, own int").repartition(3)
    taken, written = mixing.mix_documents(docs), mixing.mixed(docs)
    by = lambda frame, n: collections.Counter({(x["doc_id"], x["source"]): x["s"] for x in frame.groupBy("doc_id", "source").agg(F.sum(n).alias("s")).collect() if x["s"]})
    copies = written.withColumn("n", mixing.word_count(F.col("text")))
    assert by(copies, F.col("n")) == by(taken, F.col("taken"))
    assert (copies.agg(F.sum("n")).first()[0] or 0) <= sum(len(t.split()) for _, t, _, _ in rows)
    assert all(x["count"] <= 3 for x in written.groupBy("own").count().collect())


def test_mixed_rows_repeat_as_taken(docs, empty):
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    n = {r["doc_id"]: r["n"] for r in out.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    for r in mixing.mix_documents(docs).filter("size > 0 and doc_id <> 900008").collect():
        assert n.get(r["doc_id"], 0) == r["taken"] // r["size"]
    assert mixing.mix_documents(empty).count() == 0 and mixing.mixed(empty).count() == 0


# 4


def test_page_blocks():
    cases = {
        '<div>x<span class="ad">buy</span>y</div>': "x\ny", "a<br>b<p>c &amp; d&nbsp;e</p><ul><li>x<li>y</ul>": "a b\nc & d e\nx\ny", "<p>1 < 2 &lt;b&gt;</p><script>x</p></script>z": "1 < 2 <b>\nz",
        "<nav>n</nav><main><header><h1>T</h1></header><p>q<aside>no</aside>r</p></main><footer>f": "T\nq\nr", '<article>t<div id="comments"><p>c</p></div><form>f</form></article><p>o': "t", "": "",
        '<article><p><b>A.<br><p>B</article>': "A.\nB", "<p>a<!-- <p>b -->c</p><style>p{}</style><p cla": "ac",
    }
    for page, want in cases.items():
        assert page_text.main_text(page_text.blocks(page), None) == want, page
    assert page_text.blocks(None) == []


def test_named_parts_of_an_article_stay_unless_containers():
    page = '<article><h2 id="related-work">Related work</h2><p class="notice">Note that <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds.</p><object>Old text</object>'
    page += '<div class="related">More to read</div><ul class="share"><li>Send</li></ul></article><p class="notice">We use cookies</p>'
    found = page_text.blocks(page)
    assert page_text.main_text(found, None) == "Related work\nNote that x=2 holds.\nOld text"
    assert [t for t, _, away in found if away] == ["More to read", "Send", "We use cookies"]


def test_common_lines_are_longest():
    def longest(a, b):
        m = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                m[i + 1][j + 1] = m[i][j] + 1 if x == y else max(m[i][j + 1], m[i + 1][j])
        return m[-1][-1]

    r = random.Random(3)
    for _ in range(3000):
        a, b = ([r.randint(0, 4) for _ in range(r.randint(0, 9))] for _ in "ab")
        found = page_text.shared_lines(a, b)
        rest = iter(b)
        assert len(found) == longest(a, b) and all(a[k] in rest for k in found) and found == sorted(set(found))


def test_long_alignments_are_split():
    r = random.Random(8)
    for _ in range(500):
        a, b = ([r.randint(0, 5) for _ in range(r.randint(0, 40))] for _ in "ab")
        found, rest = page_text.shared_lines(a, b, cells=4), iter(b)
        assert len(found) == len(page_text.shared_lines(a, b)) and all(a[k] in rest for k in found) and found == sorted(set(found))


@pytest.mark.parametrize("part", ["<a x ", "<a '", "<div>x", "<a '' ", "<", "<!--", "<script>", "</", "<p", "<p '>' \""])
def test_broken_pages_take_linear_time(part):
    import time

    begun = time.process_time()
    for end in ("", ">", "'\" >", "<p>end"):
        page_text.blocks(part * 50_000 + end)
    assert time.process_time() - begun < 8


def test_differences_against_brute_force(spark):
    r = random.Random(12)
    lines = [f"line number {k} of the pool" for k in range(12)]
    texts = {(h, k): [r.choice(lines) for _ in range(3)] + [f"own words of {h} {k} that no other page has, and many more of them {r.random()}" * 4] for h in "ab" for k in range(8)}
    pages = [(i, f"http://{h}.example/{k:02}/x", "".join(f"<p>{t}</p>" for t in texts[h, k])) for i, (h, k) in enumerate(texts)]
    got = {x["page_id"]: x["text"] for x in page_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    for i, (h, k) in enumerate(texts):
        near = sorted(((-len(__import__("os").path.commonprefix([f"/{k:02}/x", f"/{j:02}/x"])), (-1, 1).index(j - k)), j) for j in (k - 1, k + 1) if (h, j) in texts)
        mine, other = texts[h, k], texts[h, near[0][1]]
        gone = page_text.shared_lines([hash(x) for x in mine], [hash(x) for x in other])
        assert len(got[i].split("\n")) == len(mine) - len(gone) and set(got[i].split("\n")) <= set(mine)


def test_pages_against_their_articles(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    odd = spark.createDataFrame([
        (801, "http://h.x/a/1", "<div>menu one</div><p>first text of the page here</p><div>foot</div>"), (802, "http://h.x/a/2", "<div>menu one</div><p>second other text, longer</p><div>foot</div>"),
        (803, None, None), (804, "http://q.x/", ""), (802, "http://h.x/a/2", "<div>menu one</div><p>second other text, longer</p><div>foot</div>"),
        (805, "http://c.x/1", "<p>copy of a page</p>"), (806, "http://c.x/2", "<p>copy of a page</p>"),
    ], "page_id long, url string, html string")
    got = collections.defaultdict(list)
    for r in page_text.extract(pages.select("page_id", "url", "html").union(odd)).collect():
        assert r["n_chars"] == len(r["text"])
        got[r["page_id"]].append(r["text"])
    for r in pages.collect():
        article = r["html"].split("<article>")[1].split("</article>")[0]
        blocks = [" ".join(html.unescape(re.sub("<[^>]+>", "", b.replace("<br>", " "))).split()) for b in re.split("</?(?:p|h1)>", article)]
        assert got[r["page_id"]] == ["\n".join(b for b in blocks if b)]
    assert got[801] == ["first text of the page here"] and got[802] == ["second other text, longer"] * 2 and got[803] == got[804] == [""] and got[805] == got[806] == ["copy of a page"]
    assert page_text.extract(pages.limit(0)).count() == 0


# 5


def test_a_short_page_of_a_template_is_no_copy(spark):
    """A neighbour that has nearly all of a short page's text may still be another page; pages without an id are compared too."""
    lines = {"http://h.x/a/1": ["nav", "same line", "two"], "http://h.x/a/2": ["nav", "same line", "three", "four five six"]}
    for ids in ([1, 2], [None, None]):
        pages = [(i, url, "".join(f"<p>{t}</p>" for t in ts)) for i, (url, ts) in zip(ids, lines.items(), strict=True)]
        got = {r["url"]: r["text"] for r in page_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
        assert got == {"http://h.x/a/1": "two", "http://h.x/a/2": "three\nfour five six"}


def test_runs_of_copies_are_compared_beyond_the_run(spark):
    frame = "<div>Home of all things</div><div>{}</div><div>Imprint of the host</div>"
    body = "One long report that stands in several copies on this host with many words to it"
    texts = [*[("/a%d" % k, f"{body}</div><div>copy {k}") for k in range(5)], ("/b", "Quite another text about something else, just as long as the report of the copies is")]
    pages = spark.createDataFrame([(k, f"http://h.example{path}", frame.format(text)) for k, (path, text) in enumerate(texts)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in page_text.extract(pages).collect()}
    assert got == {k: text.replace("</div><div>", "\n") for k, (_, text) in enumerate(texts)}


def test_pages_with_articles_are_differenced_too(spark):
    """On a host where all pages have an article: their shared lines go, and the article takes back its own."""
    page = "<div>Home of all things</div><div>{0} only here</div><article><p>{1}</p><p>A sentence that both articles have</p></article><div>Imprint of the host</div>"
    own = ["The first report, with many words of its own that stand nowhere else", "Another text of quite other words, which is just as long as the first"]
    pages = spark.createDataFrame([(k, f"http://h.example/a/{k}", page.format(k, t)) for k, t in enumerate(own)], "page_id long, url string, html string")
    got = {r["page_id"]: (r["text"], r["n_shared"], r["n_taken_back"]) for r in page_text.extract(pages).collect()}
    assert got == {k: (f"{t}\nA sentence that both articles have", 3, 1) for k, t in enumerate(own)}
    assert page_text.left_lines([("menu", False, False), ("ad", False, True), ("own", True, False), ("both", True, False)], [0, 3]) == ([2, 3], 1)


@pytest.mark.parametrize("parts", ["1", "13", "60"])
def test_runs_over_several_ranges_against_brute_force(spark, parts):
    r = random.Random(21)
    pages = []
    for host in ("a.example", "b.example", "c.example"):
        while len(pages) % 40 or not any(host in p[1] for p in pages):
            body, frame = f"report {r.random()} of many words " * 4, [f"frame line {r.randint(0, 3)}" for _ in range(3)]
            tag = r.choice(["div", "article"])
            for _ in range(min(r.choice([1, 1, 2, 25]), 40 - len(pages) % 40)):
                lines = [frame[0], f"row {r.randint(0, 9)}", body, *frame[1:]]
                pages.append((len(pages), f"http://{host}/{len(pages):04}", f"<p>{lines[0]}</p><{tag}><p>{lines[1]}</p><p>{lines[2]}</p></{tag}><p>{lines[3]}</p><p>{lines[4]}</p>"))

    found = [page_text.blocks(p[2]) for p in pages]
    keys = [[page_text.line_key(t) for t, _, _ in f] for f in found]
    shared = lambda i, j: page_text.shared_lines(keys[i], keys[j])
    size = lambda i: sum(len(t) for t, _, _ in found[i])
    copies = lambda i, j: sum(len(found[i][k][0]) for k in shared(i, j)) > page_text.COPY_SHARE * max(size(i), size(j))
    runs = []
    for i in range(len(pages)):
        if i % 40 and copies(i, i - 1):
            runs[-1].append(i)
        else:
            runs.append([i])
    assert len(pages) == 120 and max(map(len, runs)) > 20 and len(runs) > 15
    want = {}
    for k, run in enumerate(runs):
        for i in run:
            near = [*(x[-1] for x in runs[k - 1 : k]), *(x[0] for x in runs[k + 1 : k + 2]), run[0], run[-1]]
            near = sorted((j for j in near if j // 40 == i // 40 and j != i), key=lambda j: -len(os.path.commonprefix([f"/{i:04}", f"/{j:04}"])))
            gone = next((shared(i, j) for j in near if not copies(i, j)), [])
            want[i] = (page_text.main_text(found[i], gone), len(gone))
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        rows = page_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    assert {x["page_id"]: (x["text"], x["n_shared"]) for x in rows} == want


def test_token_counts_against_the_library(docs, rows, empty):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=token_count.vocabulary_path())
    want = collections.Counter((d, len((t or "").encode()), n := len(model.encode(t or "")), n > 4096) for d, t, _ in rows)
    assert bag(token_count.token_counts(docs)) == want and token_count.token_counts(empty).count() == 0
    counter, r = token_count.counter(token_count.vocabulary_path()), random.Random(5)
    assert counter.split and all(len(model.encode(w)) == 1 for w in list(counter.whole)[:500] if w != token_count.ALONE)
    for _ in range(5000):
        t = "".join(r.choice(" " * 4 + "\n\tabetion▁éÀ漢🙂.,<s>0") for _ in range(r.randint(0, 14)))
        assert counter.count(t) == len(model.encode(t)), t


def test_token_counts_when_the_memory_overflows(monkeypatch):
    monkeypatch.setattr(token_count, "REMEMBERED", 16_000)
    c = token_count.Counter(token_count.vocabulary_path())
    texts = [" ".join(f"zq{k}x{j}" for j in range(300)) for k in range(10)]
    assert [c.count(t) for t in texts] == [len(c.model.encode(t)) for t in texts]


# 6


def brute_lines(rows, least, long):
    texts = {(d, t or ""): [(k, x) for k, x in enumerate((t or "").split("\n")) if words(x)] for d, t, _ in rows if d is not None}
    first, alone = {}, {}
    for key in sorted(texts, key=lambda k: k[0]):
        lines = [x for _, x in texts[key]]
        for j in range(len(lines)):
            alone.setdefault(lines[j], (key, j))
            if j + least <= len(lines):
                first.setdefault(tuple(lines[j : j + least]), (key, j))
    gone = set()
    for key, listed in texts.items():
        lines = [x for _, x in listed]
        for j in range(len(lines)):
            if j + least <= len(lines) and first[tuple(lines[j : j + least])] != (key, j):
                gone |= {(key[0], listed[q][0]) for q in range(j, j + least)}
            if len(words(lines[j])) >= long and alone[lines[j]] != (key, j):
                gone.add((key[0], listed[j][0]))
    return gone


@pytest.mark.parametrize("least", [1, 2, 3, 5])
def test_repeated_runs_against_brute_force(docs, rows, least):
    got = {(r["doc_id"], r["place"]) for r in line_dedup.repeated(docs, least, 50).collect()}
    assert got == brute_lines(rows, least, 50)


def test_line_dedup_keeps_columns_and_bytes(docs, rows, empty):
    out = line_dedup.line_dedup(docs)
    assert out.columns == docs.columns and out.count() == docs.count() and line_dedup.line_dedup(empty).count() == 0
    gone, texts = brute_lines(rows, 2, 50), dict((d, t) for d, t, _ in rows if d is not None)
    for r in out.filter("doc_id is not null").collect():
        t = texts[r["doc_id"]]
        if not any(d == r["doc_id"] for d, _ in gone):
            assert r["text"] == t
        else:
            assert r["text"] == "\n".join(x for k, x in enumerate(t.split("\n")) if (r["doc_id"], k) not in gone)
    left = line_dedup.line_dedup(docs, drop_emptied=True)
    assert left.filter("doc_id between 6000 and 6019").count() <= 20 and left.filter("doc_id = 900002").count() == 1


# 7


def test_encoder_against_the_library(rows):
    from tokenizers import Tokenizer

    path = packing.vocabulary_path()
    model, encoder, r = Tokenizer.from_file(path), packing.Encoder(path), random.Random(1)
    tokens = [*" \t\n'stremdll.,!_0²½ªºéÉßÀ漢🙂ΣςI İıſ\x1c\x85\xa0Á", "<|endoftext|>", "<|startoftext|>", "'re", "'LL"]
    texts = [t or "" for _, t, _ in rows] + ["".join(r.choice(tokens) for _ in range(r.randint(0, 12))) for _ in range(5000)]
    for t in texts:
        assert list(np.frombuffer(encoder.ids(t), dtype="<u4")) == model.encode(t, add_special_tokens=False).ids, t


def test_encoder_when_the_memory_overflows(monkeypatch):
    monkeypatch.setattr(packing, "WORDS", 50)
    monkeypatch.setattr(packing, "PARTS", 50)
    e = packing.Encoder(packing.vocabulary_path())
    for k in range(30):
        t = " ".join(f"zq{k}x{j}" for j in range(10)) + " and the same words"
        assert list(np.frombuffer(e.ids(t), dtype="<u4")) == e.model.encode(t, add_special_tokens=False).ids


def test_packed_pieces(docs, rows, empty):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(packing.vocabulary_path())
    want = collections.Counter()
    for d, t, _ in rows:
        ids = np.asarray([*model.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        for k, a in enumerate(range(0, len(ids), 2048)):
            part = ids[a : a + 2048]
            want[(d, k, a, len(part), zlib.crc32(part.tobytes()))] += 1
    got = packing.pack(packing.pieces(docs), shard=100).collect()
    assert collections.Counter(tuple(r)[:5] for r in got) == want
    at = collections.defaultdict(list)
    for r in got:
        at[r["sequence_id"]].append((r["offset"], r["length"]))
    for placed in at.values():
        end = 0
        for offset, length in sorted(placed):
            assert offset == end
            end += length
        assert end <= 2048
    assert packing.pack(packing.pieces(empty)).count() == 0
    with_ids = packing.pieces(docs.filter("doc_id = 3"), with_ids=True).collect()
    assert list(np.frombuffer(with_ids[0]["ids"], dtype="<u4"))[-1] == 0


@pytest.mark.parametrize("seed", range(20))
def test_best_two_fit_is_valid_and_tight(seed):
    r = np.random.default_rng(seed)
    lengths = r.integers(1, [50, 700, 1500, 2049][seed % 4], size=r.integers(1, 1500))
    sequence, offset = packing.best_two_fit(lengths, 2048)
    used = np.bincount(sequence, weights=lengths).astype(int)
    assert used.max() <= 2048 and len(used) <= 1.02 * lengths.sum() / 2048 + 1 + (lengths > 1024).sum() * (seed % 4 == 3)
    for s in range(len(used)):
        mine = np.flatnonzero(sequence == s)
        mine = mine[np.argsort(offset[mine])]
        assert (offset[mine] == np.concatenate(([0], np.cumsum(lengths[mine])[:-1]))).all()


# 8


def brute_exact(rows):
    groups = collections.defaultdict(list)
    for d, t, _ in rows:
        groups[t or ""].append(d)
    out = collections.Counter()
    for t, ids in groups.items():
        keep = max((d for d in ids if d is not None), default=None)
        for d, n in collections.Counter(ids).items():
            for k in range(n):
                out[(d, keep, len(ids), d == keep and k == 0, hashlib.sha256(t.encode()).hexdigest())] += 1
    return out


def test_exact_dedup_and_collisions(docs, rows, empty):
    assert bag(exact_dedup.exact_dedup(docs)) == brute_exact(rows)
    assert bag(exact_dedup.exact_dedup(docs, hasher=lambda t: F.substring(t, 1, 1))) == brute_exact(rows)
    assert exact_dedup.exact_dedup(empty).count() == 0
    first = {r["keep_id"] for r in exact_dedup.exact_dedup(docs, keep="first").filter("doc_id = 6003").collect()}
    assert first == {3}


# 9


def brute_components(rows, size=4, percent=85):
    texts = {}
    for d, t, _ in rows:
        if d is not None:
            texts[d] = min(texts.get(d, t or ""), t or "")
    sets = {}
    for d, t in texts.items():
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t))
        sets[d] = frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])
    up = {d: d for d in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            if x and y and 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                n = len(x & y)
                if 100 * n >= percent * (len(x) + len(y) - n):
                    p, q = find(a), find(b)
                    up[max(p, q)] = min(p, q)
    return {d: (len(sets[d]), find(d)) for d in sets}


@pytest.mark.parametrize("many, block, cost, hot", [(64, 2000, 200, 1000), (3, 2, 2, 1)])
def test_components_against_all_pairs(docs, rows, empty, monkeypatch, many, block, cost, hot):
    for name, value in (("MANY", many), ("BLOCK", block), ("COST", cost), ("HOT", hot)):
        monkeypatch.setattr(jaccard_join, name, value)
    got = jaccard_join.jaccard_components(docs)
    want = brute_components(rows)
    assert got.count() == docs.count()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got.filter("doc_id is not null").collect()} == want
    if many == 64:
        assert jaccard_join.jaccard_components(empty).count() == 0
        one = jaccard_join.one_of_each(docs)
        assert one.columns == docs.columns and {r["doc_id"] for r in one.collect()} - {None} == {d for d, (_, c) in want.items() if d == c}


def test_a_family_of_near_copies(spark, monkeypatch):
    r = random.Random(9)
    base = [f"w{k}" for k in range(120)]
    texts = []
    for k in range(150):
        t = list(base)
        for _ in range(r.randint(0, 6)):
            t[r.randrange(120)] = f"x{r.randrange(10_000)}"
        texts.append((k, " ".join(t)))
    monkeypatch.setattr(jaccard_join, "MANY", 8)
    got = jaccard_join.jaccard_components(spark.createDataFrame(texts, "doc_id long, text string"))
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in got.collect()} == brute_components([(d, t, None) for d, t in texts])


# 10


def brute_substrings(rows, window=13):
    first = {}
    for d, t, _ in rows:
        if d is not None:
            w = words(t)
            for k in range(len(w) - window + 1):
                key = tuple(w[k : k + window])
                first[key] = min(first.get(key, d), d)
    out = collections.Counter()
    for d, t, _ in rows:
        w, gone = words(t), set()
        if d is not None:
            for k in range(len(w) - window + 1):
                if first[tuple(w[k : k + window])] < d:
                    gone |= set(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[(d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())] += 1
    return out


@pytest.mark.parametrize("batches, fan", [(1, 4), (4, 1)])
def test_substrings_against_brute_force(docs, rows, empty, batches, fan):
    assert bag(substring_dedup.substring_dedup(docs, batches=batches, fan=fan)) == brute_substrings(rows)
    if batches == 1:
        assert substring_dedup.substring_dedup(empty).count() == 0


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_a_line_in_every_document(spark, monkeypatch, most):
    """Eight batches that all have one line; the closer look is broadcast, or joined where that is too much."""
    monkeypatch.setattr(substring_dedup, "BROADCAST_ROWS", most)
    r = random.Random(12)
    line = " ".join(f"w{k}" for k in range(20))
    some = lambda n: " ".join(r.choice("abcdefghij") + str(r.randint(0, 40)) for _ in range(n))
    rows = [(k, f"{some(r.randint(0, 30))}\n{line}\n{some(r.randint(0, 30))}", "s") for k in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    assert bag(substring_dedup.substring_dedup(docs, batches=8)) == brute_substrings(rows)


def test_incremental_batches(spark, docs, rows):
    index = substring_dedup.FingerprintIndex(spark, fan=1)
    got = collections.Counter()
    for low, high in ((0, 100), (101, 6000), (6001, 10**7)):
        got += bag(index.add(docs.filter(F.col("doc_id").between(low, high)).select("doc_id", "text")))
    assert any(len(names) == 1 for names in index.runs.values())
    with pytest.raises(ValueError, match="not larger"):
        index.add(docs.filter("doc_id = 3").select("doc_id", "text"))
    index.close()
    assert got == brute_substrings([r for r in rows if r[0] is not None])
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("fingerprints_")]


def test_runs_reach_their_writer_in_order(spark):
    """Before a run is written its rows lie in the order of buckets and keys, so that the writer's sort of whole rows has nothing left to do."""
    index = substring_dedup.FingerprintIndex(spark)
    rows = spark.range(4000).select(F.xxhash64("id").alias("h1"), F.col("id").alias("h2"), F.col("id").alias("first"), F.lit(1).alias("n"))
    before = spark.conf.get("spark.sql.optimizer.plannedWrite.enabled")
    for kind, df in (("window", rows), ("fp", rows.select(F.col("h1").alias("fp"), F.col("h2").alias("owner"), (F.col("h2") > 5).alias("shared")))):
        keys = index.KEYS[kind]
        placed = index._arranged(df.repartition(3), kind).select(F.spark_partition_id().alias("task"), F.pmod(F.hash(*keys), F.lit(index.buckets)).alias("bucket"), *keys).collect()
        for task in range(3):
            got = [tuple(r)[1:] for r in placed if r["task"] == task]
            assert len(got) > 1000 and {r[0] for r in got} == set(range(index.buckets)) and got == sorted(got)
    assert sum(index.add(spark.createDataFrame([(1, "a " * 30), (2, "a " * 30)], "doc_id long, text string")).toPandas()["n_removed"]) == 30
    index.close()
    assert spark.conf.get("spark.sql.optimizer.plannedWrite.enabled") == before


def test_an_index_is_saved_and_opened_again(spark, docs, rows, tmp_path):
    rows = [r for r in rows if r[0] is not None]
    part = lambda low, high: docs.filter(F.col("doc_id").between(low, high)).select("doc_id", "text")
    index = substring_dedup.FingerprintIndex(spark, fan=1)
    got = bag(index.add(part(0, 100)))
    index.save(f"file://{tmp_path}/index")
    again = substring_dedup.FingerprintIndex.load(spark, f"file://{tmp_path}/index")
    assert (again.runs, again.last) == (index.runs, index.last)
    # a session whose catalog doesn't know the tables
    for name in [n for names in index.runs.values() for n in names]:
        files = spark.table(name).inputFiles()
        assert files and spark.conf.get("spark.sql.warehouse.dir").rstrip("/").removeprefix("file:") in files[0]
    got += bag(again.add(part(101, 10**7)))
    again.close()
    assert got == brute_substrings(rows)


# queries and the pipeline


def test_queries_are_registered():
    names = sorted(registry.queries(), key=lambda n: int(re.match(r"op(\d+)_", n)[1]))
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in names] == list(range(1, 14)) and set(registry.oracle_sql()) <= set(names)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_queries_match_their_sql(spark, name):
    import duckdb

    d = "/root/testdata/sf0.001"
    c = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    df = registry.queries()[name](spark, d)
    want = c.sql(registry.oracle_sql()[name])
    order = sorted(df.columns)
    places = [want.columns.index(x) for x in order]
    assert collections.Counter(tuple(r[x] for x in order) for r in df.collect()) == collections.Counter(tuple(r[k] for k in places) for r in want.fetchall())


def test_pipeline_against_its_brute_force(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    rules = quality.learned(docs, spark.read.parquet(f"{d}/labels.parquet"))
    kept = {r["doc_id"] for r in quality.judged(docs, rules).filter("kept").collect()}
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect() if r["doc_id"] in kept]
    gone = brute_lines(rows, 2, 50)
    lines = [(i, "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone), s) for i, t, s in rows]
    lines = [(i, t, s) for (i, t, s), (_, old, _) in zip(lines, rows, strict=True) if words(t) or t == old]
    groups = brute_components(lines, 5, 80)
    one = [r for r in lines if groups[r[0]][1] == r[0]]
    stage = docs
    for (name, f), want in zip(corpus_pipeline.STAGES[:3], (rows, lines, one), strict=True):
        stage = spark.createDataFrame(f(spark, stage, d).collect(), docs.schema)
        assert collections.Counter((r["doc_id"], r["text"], r["source"]) for r in stage.collect()) == collections.Counter(want), name
    _, total, target = brute_mix(one)
    mixed = spark.createDataFrame(corpus_pipeline.STAGES[3][1](spark, stage, d).collect(), docs.schema)
    taken = collections.Counter()
    for r in mixed.collect():
        taken[r["source"]] += len(words(r["text"]))
    largest = max(len(words(t)) for _, t, _ in one)
    assert all(abs(taken[s] - target[s]) <= 2 * largest for s in total)
    packed = corpus_pipeline.STAGES[4][1](spark, mixed, d)
    assert packed.select(F.sum("length")).first()[0] == packing.pieces(mixed).select(F.sum("length")).first()[0]


def test_pipeline_runs_whole(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 100 and {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns)
