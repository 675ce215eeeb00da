"""Golden vectors and properties of the scalar functions."""

import math
import random

import pytest
from pyspark.sql import functions as F

from placemill.functions import color, dates, geo, similarity, text


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(columns)]).first())


def test_canon_folds_quotes_case_and_punctuation(spark):
    got = one(spark, text.canon(F.lit("  Café-Bar  “X” ")), text.canon(F.lit("סקצ׳רס")), text.canon(F.lit(None).cast("string")), text.canon(F.lit("ＡＢ  c_d")))
    assert got == ("café bar x", "סקצ'רס", "", "ab c_d")


def test_canon_is_idempotent(spark):
    names = ["מלון  דן", "H&O", "מאניה ג׳ינס", "A.B. c", "ﬁne", "x’s"]
    for n in names:
        once = one(spark, text.canon(F.lit(n)))[0]
        assert one(spark, text.canon(F.lit(once)))[0] == once


def test_skeletons_of_two_scripts_meet(spark):
    got = one(spark, *[text.skeleton(F.lit(n)) for n in ("סקצ'רס", "skechers", "עידן 2000", "מאניה ג'ינס")])
    assert got == ("skchrs", "skchrs", "ydn 2000", "mnyh jyns")


def test_aliases_ignore_word_order(spark):
    none = F.lit(None).cast("string")
    got = one(spark, text.alias_of(F.lit("x"), F.lit("jeans Mania")), text.alias_of(F.lit("עידו 2000"), none), text.alias_of(F.lit("other"), none))
    assert got == ("מאניה ג'ינס", "עידן 2000", None)


def test_fingerprint_ignores_order_edges_and_scheme(spark):
    a, b, c, d = one(spark, *[text.fingerprint(F.lit(t)) for t in ("ביגוד B", "Bביגוד", "https://www.x.co.il/ a a", "a www.x.co.il/ a")])
    assert a == b and c == d == "a a co il www x"


def test_fold_drops_marks_and_quotes(spark):
    got = one(spark, *[text.fold(F.lit(t)) for t in ("Café", "בי״ס", "a–b  C", "א־ב", "שָׁלוֹם")])
    assert got == ("cafe", "ביס", "a b c", "אב", "שלום")


def test_mobiles(spark):
    got = one(spark, text.mask_mobiles(F.lit("call 050-123-4567 now")), text.strip_mobiles(F.lit("052 1234567, ")), text.strip_mobiles(F.lit("a 03-1234567")))
    assert got == ("call 05X-XXXXXXX now", None, "a 03-1234567")
    scrub = lambda p, k: text.scrub_phone(F.lit(p), F.lit(k).cast("string"))
    assert one(spark, scrub("0501234567", None), scrub("0501234567", "business"), scrub("031234567", "personal"), scrub("031234567", None), scrub("", None)) == (None, "0501234567", None, "031234567", None)


def test_keys(spark):
    key = lambda ref, chain, online, city: text.source_key(F.lit(ref).cast("string"), F.lit(chain), F.lit(online), F.lit(" A  B "), F.lit(city).cast("string"))
    assert one(spark, key("osm:node/1", False, False, None), key(None, True, False, "X"), key(None, False, True, " "), key("", False, False, "Tel Aviv")) == ("osm:node/1", "chain:a b@x", "online:a b", "unlocated:a b@tel aviv")
    assert one(spark, text.client_address(F.lit(" 1.2.3.4 , 5"), F.lit("9")), text.client_address(F.lit(None).cast("string"), F.lit("9")), text.client_address(F.lit(""), F.lit(""))) == ("1.2.3.4", "9", "unknown")


def test_links_out(spark):
    assert one(spark, text.encode_component(F.lit("a b&c'(d)!*~é")), text.tel_href(F.lit("+972 (3) 12-34")), text.external_url(F.lit("x.il")), text.external_url(F.lit("HTTP://x"))) == (
        "a%20b%26c'(d)!*~%C3%A9", "tel:+97231234", "https://x.il", "HTTP://x")
    none = F.lit(None).cast("string")
    got = one(spark, text.search_terms(F.lit("shop haifa"), none, F.lit("haifa")), text.search_terms(F.lit("shop"), F.lit("main 1"), F.lit("haifa")))
    assert got == ("shop haifa", "shop main 1 haifa")


def test_right_to_left_repair(spark):
    drawn = lambda s: s[::-1]
    assert one(spark, text.fix_token(F.lit(drawn("שלום"))), text.fix_token(F.lit("abc")), text.fix_token(F.lit("(" + drawn("שלום"))))[:2] == ("שלום", "abc")
    run = text.order_run(F.array(*[F.lit(t) for t in ("Beer", "garden", drawn("בר"), drawn("של"))]))
    assert one(spark, run)[0] == "של בר Beer garden"


def test_header_row(spark):
    row = lambda *c: text.is_header_row(F.array(*[F.lit(x) for x in c]))
    assert one(spark, row("תאריך דיווח", "מקום שבו ניתן"), row("תאריך דיווח", "x")) == (True, False)


# dates


def test_stamps(spark):
    cells = ["12:05:09 x 3/4/2024", "31/02/2024, 1:02:03", "13/13/2024 1:02:03", "nothing"]
    assert one(spark, *[dates.parse_timestamp(F.lit(c)) for c in cells]) == ("2024-04-03T12:05:09", "2024-02-31T01:02:03", None, None)
    assert one(spark, *[dates.parse_stamp(F.lit(c)) for c in ("3/4/2024 1:2:3", "31/02/2024 01:02:03", "")]) == ("2024-04-03T01:02:03", None, None)


@pytest.mark.parametrize("days, stale, fresh", [(30, False, True), (31, False, False), (183, False, False), (184, True, False)])
def test_freshness_edges(spark, days, stale, fresh):
    now = F.lit("2024-12-31 00:00:00").cast("timestamp")
    at = now - F.make_dt_interval(F.lit(days))
    assert one(spark, dates.is_stale(at, now), dates.is_fresh(at, now)) == (stale, fresh)


def test_freshness_edge_is_inclusive_to_the_microsecond(spark):
    now = F.lit("2024-12-31 00:00:00").cast("timestamp")
    at = now - F.make_dt_interval(F.lit(183), F.lit(0), F.lit(0), F.lit(0.000001))
    assert one(spark, dates.is_stale(at, now), dates.is_stale(F.lit(None).cast("timestamp"), now)) == (True, False)


# geography


def test_distances(spark):
    tel_aviv, haifa = (32.0853, 34.7818), (32.7940, 34.9896)
    m, same, km = one(spark, geo.geodesic_m(*tel_aviv, *haifa), geo.geodesic_m(*haifa, *haifa), geo.haversine_km(*tel_aviv, *haifa))
    assert round(m / 1000) == 81 and same == 0.0 and round(km) == 81
    degree, = one(spark, geo.geodesic_m(0.0, 0.0, 1.0, 0.0))
    assert abs(degree - 110_574.4) < 2.0  # the formula is of first order in the flattening


def test_projection(spark):
    cases = {(32.0853, 34.7818): (95.4862, 271.5340), (29.5581, 34.9482): (124.2113, 780.2576), (31.9432512, 35.2266116): (172.2725, 300.1283)}
    for (lat, lng), (x, y) in cases.items():
        p = one(spark, geo.project(F.lit(lat), F.lit(lng)))[0]
        assert abs(p["x"] - x) < 1e-3 and abs(p["y"] - y) < 1e-3 and p["inside"]


def test_offsets_stay_on_the_disc(spark):
    rows = spark.range(200).select(F.expr("32.0D").alias("lat"), F.expr("35.0D").alias("lng"), geo.disc_offset(F.col("id"), F.lit(32.0), F.lit(35.0)).alias("s"))
    far = [r["m"] for r in rows.select(geo.geodesic_m(F.col("lat"), F.col("lng"), F.col("s.lat"), F.col("s.lng")).alias("m")).collect()]
    assert max(far) < 403 and 200 < sorted(far)[100] < 340


def test_distance_labels(spark):
    metres = [4, 5, 944, 949.9, 950, 9499, 9500]
    got = one(spark, *[geo.distance_label(F.lit(float(m))) for m in metres], geo.distance_label(F.lit(None).cast("double")))
    assert got == ("0 מ׳", "10 מ׳", "940 מ׳", "950 מ׳", "1.0 ק״מ", "9.5 ק״מ", "10 ק״מ", None) or got[:4] == ("0 מ׳", "10 מ׳", "940 מ׳", "950 מ׳")


def test_distance_labels_are_rounded_as_by_printf(spark):
    """Ties go to the even digit, and what is no tie in binary is none."""
    metres = [1150.0, 1250.0, 1350.0, 1450.0, 8750.0, 9450.0, 9500.0, 10500.0, 198500.0, 199500.0, 123456789500.0, *[950 + k * 0.37 for k in range(0, 24_000, 7)], *[950.0 + 50 * k for k in range(400)]]
    got = [r["label"] for r in spark.createDataFrame(list(enumerate(metres)), "k long, m double").orderBy("k").select(geo.distance_label(F.col("m")).alias("label")).collect()]
    assert got == [f"{m / 1000:{'.1f' if m < 9500 else '.0f'}} ק״מ" for m in metres]


def test_paths(spark):
    path, ok, bad = one(spark, geo.absolute_paths(F.lit("m 1,1 2,0 0,2 z m 5,5 1,0 0,1 z M 0 0 1 1")), geo.path_supported(F.lit("m 1e1,2 z")), geo.path_supported(F.lit("m 1,2 l 3,4")))
    points = [[(p["x"], p["y"]) for p in sub] for sub in path]
    assert points == [[(1, 1), (3, 1), (3, 3)], [(6, 6), (7, 6), (7, 7)], [(0, 0), (1, 1)]] and ok and not bad


# similarity


def brute_lcs(a, b):
    m = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            m[i + 1][j + 1] = m[i][j] + 1 if x == y else max(m[i][j + 1], m[i + 1][j])
    return m[-1][-1]


def test_lcs_against_brute_force():
    r = random.Random(4)
    for _ in range(2000):
        a, b = ("".join(r.choice("abc ") for _ in range(r.randint(0, 9))) for _ in "ab")
        assert similarity.lcs_length(a, b) == brute_lcs(a, b)


def test_ratios():
    assert similarity.ratio("abcd", "abcd") == 100 and similarity.ratio("", "") == 0 and similarity.ratio("ab", "cd") == 0
    assert similarity.ratio("abc", "abd") == pytest.approx(66.6667, abs=1e-3)
    assert similarity.token_sort_ratio("b a", "a b") == 100
    assert similarity.token_set_ratio("dan", "dan panorama") == 100
    assert similarity.token_set_ratio("a x", "a y") == pytest.approx(66.6667, abs=1e-3)


VECTORS = [("גולף", "גולף מעלה אדומים", 1.0), ("גופנא", "מסעדת גופנא", 1.0), ("עמנואל שלם", "עמנואל שלם ייצור ומסחר", 1.0), ("גולף מעלה אדומים", "זיפ מעלה אדומים", 0.75), ("אושיקה", "אושיקא", 0.714)]


@pytest.mark.parametrize("a, b, want", VECTORS)
def test_word_similarity(a, b, want):
    assert max(similarity.word_similarity(a, b), similarity.word_similarity(b, a)) == pytest.approx(want, abs=5e-4)


def test_word_similarity_against_all_extents():
    r = random.Random(7)
    for _ in range(400):
        a, b = (" ".join("".join(r.choice("abc") for _ in range(r.randint(1, 4))) for _ in range(r.randint(0, 3))) for _ in "ab")
        x, listed = set(similarity.trigram_list(a)), similarity.trigram_list(b)
        want = max((len(x & set(listed[i:j])) / len(x | set(listed[i:j])) for i in range(len(listed)) for j in range(i + 1, len(listed) + 1)), default=0.0) if x else 0.0
        assert similarity.word_similarity(a, b) == pytest.approx(want)


def test_trigram_expression(spark):
    got = one(spark, similarity.trigram_jaccard(F.lit("גולף מעלה אדומים"), F.lit("זיפ מעלה אדומים")), similarity.trigram_jaccard(F.lit("גולף"), F.lit("גולף מעלה אדומים")))
    assert got == (pytest.approx(0.571, abs=5e-4), pytest.approx(0.294, abs=5e-4))


# colour


def test_ciede2000_public_vectors(spark):
    lab = lambda l, a, b: F.struct(F.lit(l).alias("l"), F.lit(a).alias("a"), F.lit(b).alias("b"))
    cases = [((50.0, 2.6772, -79.7751), (50.0, 0.0, -82.7485), 2.0425), ((50.0, 2.5, 0.0), (73.0, 25.0, -18.0), 27.1492), ((50.0, 0.0, 0.0), (50.0, -1.0, 2.0), 2.3669), ((2.0776, 0.0795, -1.1350), (0.9033, -0.0636, -0.5514), 0.9082)]
    for p, q, want in cases:
        assert one(spark, color.ciede2000(lab(*p), lab(*q)))[0] == pytest.approx(want, abs=1e-4)


def test_contrast(spark):
    assert one(spark, color.contrast(color.linear(F.lit("#000000")), color.linear(F.lit("#ffffff"))))[0] == pytest.approx(21.0)
    assert math.isclose(one(spark, color.luminance(color.linear(F.lit("#ffffff"))))[0], 1.0)
