"""Golden vectors of the trust rules, near matches, links and the other operators."""

import random

import pytest
from pyspark.sql import functions as F

from placemill.functions.similarity import word_similarity
from placemill.operators import cells, ingest, layout, links, reads, resolve, trust
from placemill.streaming import trust_stream

DAY = "2024-03-{:02d} 10:00:00"


def events(spark, rows):
    """rows: (place, kind, who, day); ids in order."""
    listed = [(k, p, kind, who, DAY.format(day) if isinstance(day, int) else day) for k, (p, kind, who, day) in enumerate(rows)]
    return spark.createDataFrame(listed, "id long, place_id long, kind string, reporter string, created_at string").withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))


def state(spark, source, status, rows, **more):
    place = spark.createDataFrame([(1, source, status, 0, 0)], "id long, source string, status string, confirm_count int, report_count int")
    r = trust.trust_state(place, events(spark, [(1, *x) for x in rows]) if rows else events(spark, [(2, "confirm", "x", 1)]), **more).first()
    return r["status"], r["confirm_count"], r["report_count"]


A = [("new_submission", "alice", 1), ("confirm", "alice", 2), ("confirm", "bob", 3)]


def test_two_vouchers_publish(spark):
    assert state(spark, "user_submission", "pending", A[:1]) == ("pending", 1, 0)
    assert state(spark, "user_submission", "pending", A[:2]) == ("pending", 1, 0)
    assert state(spark, "user_submission", "pending", A) == ("published", 2, 0)


def test_three_reporters_flag(spark):
    carol = [("not_working", "carol", d) for d in (4, 5, 6)]
    assert state(spark, "user_submission", "pending", A + carol) == ("published", 2, 1)
    assert state(spark, "user_submission", "pending", [*A, *carol, ("not_working", "dave", 7)]) == ("published", 2, 2)
    flagged = [*A, *carol, ("not_working", "dave", 7), ("not_working", "erin", 8)]
    assert state(spark, "user_submission", "pending", flagged) == ("reported_not_working", 2, 3)
    assert state(spark, "user_submission", "pending", [*flagged, ("confirm", "zoe", 9)])[0] == "reported_not_working"


def test_one_report_pulls_what_one_person_put_there(spark):
    assert state(spark, "user_submission", "published", [("new_submission", "a", 1), ("not_working", "omer", 2)]) == ("reported_not_working", 1, 1)
    two = [("new_submission", "a", 1), ("confirm", "b", 2), ("not_working", "s", 3), ("not_working", "t", 4)]
    assert state(spark, "user_submission", "published", two) == ("published", 2, 2)
    assert state(spark, "user_submission", "published", [*two, ("not_working", "u", 5)]) == ("reported_not_working", 2, 3)
    assert state(spark, "pdf_import", "published", [("not_working", "a", 1), ("not_working", "b", 2)]) == ("published", 0, 2)
    assert state(spark, "pdf_import", "published", [("confirm", "c", 1), ("not_working", "a", 2)]) == ("published", 1, 1)


def test_failures_age_out_at_sixty_days(spark):
    rows = [("not_working", "a", "2024-01-01 00:00:00"), ("not_working", "b", "2024-01-02 00:00:00"), ("not_working", "c", "2024-03-01 00:00:00")]
    assert state(spark, "pdf_import", "published", rows) == ("published", 0, 2)  # the first is exactly 60 days old
    rows[0] = ("not_working", "a", "2024-01-01 00:00:01")
    assert state(spark, "pdf_import", "published", rows)[0] == "reported_not_working"


def test_restore_closes_open_failures(spark):
    rows = events(spark, [(1, "not_working", w, d) for w, d in (("a", 1), ("b", 2), ("c", 3), ("frank", 6))])
    acts = spark.createDataFrame([(100, 1, "restore", DAY.format(5))], "id long, place_id long, action string, created_at string").withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))
    place = spark.createDataFrame([(1, "pdf_import", "published")], "id long, source string, status string")
    r = trust.trust_state(place, rows, moderation=acts).first()
    assert (r["status"], r["report_count"]) == ("published", 1)


def test_fold_against_a_sequential_simulation(spark):
    r = random.Random(3)
    rows = [(r.randint(0, 12), r.choice(["confirm", "new_submission", "not_working"]), r.choice("abcdef"), r.randint(1, 28)) for _ in range(400)]
    places = [(p, r.choice(["pdf_import", "user_submission"]), r.choice(["pending", "published"])) for p in range(14)]
    frame = spark.createDataFrame(places, "id long, source string, status string")
    got = {x["id"]: (x["status"], x["confirm_count"], x["report_count"]) for x in trust.trust_state(frame, events(spark, rows), 5).collect()}
    for p, source, status in places:
        vouchers, failed, confirms, count = set(), [], 0, 0
        for day, _, kind, who in sorted((d, k, kind, who) for k, (q, kind, who, d) in enumerate(rows) if q == p):
            if kind != "not_working":
                vouchers.add(who)
                confirms = len(vouchers)
                status = "published" if status == "pending" and confirms >= 2 else status
            else:
                failed.append((day, who))
                count = len({w for d, w in failed if d > day - 5})
                status = "reported_not_working" if status == "published" and count >= (1 if source == "user_submission" and confirms <= 1 else 3) else status
        assert got[p] == (status, confirms, count), p


def test_rate_limit_refuses_the_sixth(spark):
    rows = events(spark, [(1, "confirm", "a", f"2024-03-01 10:{m:02d}:00") for m in (0, 1, 2, 3, 4, 59)] + [(1, "confirm", "a", "2024-03-01 11:01:01")])
    assert [r["limited"] for r in trust.rate_limited(rows).orderBy("id").collect()] == [False] * 5 + [True, False]


def test_stream_matches_batch(spark, tmp_path):
    rows = events(spark, [(k % 3, kind, who, 1 + k) for k, (kind, who) in enumerate([("confirm", "a"), ("not_working", "b"), ("confirm", "c"), ("confirm", "d"), ("not_working", "e"), ("confirm", "a")])])
    places = spark.createDataFrame([(k, "user_submission", "pending") for k in range(3)], "id long, source string, status string")
    rows.repartition(1).write.parquet(str(tmp_path / "in"))
    seen = {}

    def sink(df, number):
        seen.update({r["id"]: tuple(r) for r in df.collect()})

    q = trust_stream.run(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), lambda: places, str(tmp_path / "log"), sink, str(tmp_path / "check"))
    q.awaitTermination(120)
    assert seen == {r["id"]: tuple(r) for r in trust.trust_state(places, rows).collect()}


# reads


def shops(spark, rows):
    c = "id long, name_he string, lat double, lng double, status string"
    more = {"name_en": None, "city": "x", "address_he": None, "category": "cafe", "is_chain": False, "is_online": False, "benefit_fighter_card": True, "benefit_vacation_voucher": False, "source": "pdf_import", "confirm_count": 0, "provider_ref": None}
    return spark.createDataFrame(rows, c).withColumns({k: F.lit(v).cast("string") if v is None else F.lit(v) for k, v in more.items()})


GOLF, ZIP = "גולף מעלה אדומים", "זיפ מעלה אדומים"
PROBES = [(31.7770, 35.2981, GOLF, 1), (31.7770, 35.2980, "גולף", 1), (31.7770, 35.2981, "קסטרו מעלה אדומים", None), (31.7771, 35.2983, "אושיקה", None), (31.7900, 35.2980, GOLF, None), (31.7771, 35.2983, ZIP, None)]


def test_near_match_vectors(spark):
    own = shops(spark, [(1, GOLF, 31.7770, 35.2980, "published"), (2, ZIP, 31.7771, 35.2983, "rejected")])
    probes = spark.createDataFrame([(k, a, b, n) for k, (a, b, n, _) in enumerate(PROBES)], "probe_id long, lat double, lng double, name string")
    got = {r["probe_id"]: r["id"] for r in reads.near_matches(probes, own).collect()}
    assert got == {k: want for k, (_, _, _, want) in enumerate(PROBES) if want}


def test_grid_join_against_brute_force(spark):
    r = random.Random(5)
    own = shops(spark, [(k, "same", 31.7 + r.random() / 200, 35.2 + r.random() / 200, "published") for k in range(150)])
    probes = spark.createDataFrame([(k, 31.7 + r.random() / 200, 35.2 + r.random() / 200, "same") for k in range(60)], "probe_id long, lat double, lng double, name string")
    from placemill.functions import geo

    both = probes.crossJoin(own.select("id", F.col("lat").alias("a"), F.col("lng").alias("b"))).withColumn("m", geo.geodesic_m(F.col("lat"), F.col("lng"), F.col("a"), F.col("b"))).filter("m <= 75")
    want = {x["probe_id"]: x["id"] for x in both.groupBy("probe_id").agg(F.min_by("id", F.struct("m", "id")).alias("id")).collect()}
    assert {x["probe_id"]: x["id"] for x in reads.near_matches(probes, own).collect()} == want


def test_filters(spark):
    own = shops(spark, [(1, "Café Noir", 32.0, 35.0, "published"), (2, "b", None, None, "published"), (3, "c", 32.0, 35.0, "pending")])
    ids = lambda df: sorted(r["id"] for r in df.collect())
    assert ids(reads.places_all(own)) == [1] and ids(reads.unmapped(own)) == [2] and ids(reads.places_near(own, 32.0, 35.0)) == [1]
    assert ids(reads.places_all(own, benefit="nonsense")) == [] and ids(reads.places_all(own, categories=[])) == [] and ids(reads.explore(own, categories=[])) == [1, 2, 3]
    assert ids(reads.search(own, "noir CAFE")) == [1] and ids(reads.search(own, "")) == [1, 2, 3]
    assert (reads.search_limit(None, "ab"), reads.search_limit(99, "ab"), reads.search_limit(5, "a"), reads.clamp_radius(5), reads.clamp_radius(None)) == (8, 20, 0, 100.0, 25_000.0)


# links

FTID = "0x151cd7:0x8a5fb3c"
LINKS = [
    ("https://www.google.com/maps/place/Shop+One/@31.1,35.1,17z/data=!3m1!4b1!4m6!3m5!1s0x151CD7:0x8A5FB3C!8m2!3d31.5!4d35.25", ("pin", 31.5, 35.25, f"gmaps:ftid/{FTID}", "Shop One")),
    ("look: https://maps.google.com/maps?q=31.5,35.2).", ("pin", 31.5, 35.2, None, None)),
    ("https://maps.app.goo.gl/abc", ("needs_expanding", None, None, None, None)),
    (f"https://www.google.com/maps?q=My+Shop&ftid={FTID}", ("no_position", None, None, f"gmaps:ftid/{FTID}", "My Shop")),
    ("https://www.google.com/search?q=31.8,35.3&kgmid=/g/11abcd", ("search_share", None, None, "gmaps:mid/g/11abcd", None)),
    ("https://www.google.com/maps?cid=1234", ("no_position", None, None, "gmaps:cid/1234", None)),
    ("31.5, 35.2", ("pin", 31.5, 35.2, None, None)),
    ("48.85, 2.35", ("outside_israel", 48.85, 2.35, None, None)),
    ("https://maps.app.goo.gl.evil.com/x", ("not_a_map_link", None, None, None, None)),
    ("https://evilgoogle.com/maps?q=31.5,35.2", ("not_a_map_link", None, None, None, None)),
    ("https://www.google.com/maps/place/31%C2%B048'01.8%22N+35%C2%B012'00.0%22E/@31.8,35.2,17z", ("pin", 31.8, 35.2, None, None)),
    ("hello", ("not_a_map_link", None, None, None, None)),
]


def test_links(spark):
    frame = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(LINKS)], "id long, t string")
    got = {r["id"]: tuple(r["p"])[:5] for r in frame.select("id", links.parse_link(F.col("t")).alias("p")).collect()}
    assert got == {k: want for k, (_, want) in enumerate(LINKS)}


def test_pages_and_listings(spark):
    marker = '<meta content="Shop · Main 1" property="og:title"><img src="https://maps.google.com/maps/api/staticmap?center=1,2&amp;zoom=17&amp;markers=color:red%7C31.8,35.3">'
    camera = "APP_INITIALIZATION_STATE=[[[1200.5,35.25,31.75],"
    region = "APP_INITIALIZATION_STATE=[[[90000.5,35.25,31.75],"
    frame = spark.createDataFrame([(0, marker), (1, camera), (2, region)], "id long, t string").select("id", links.parse_page(F.col("t")).alias("p"))
    assert {r["id"]: r["p"] and tuple(r["p"]) for r in frame.collect()} == {0: (31.8, 35.3, "Shop"), 1: (31.75, 35.25, None), 2: None}
    body = ")]}'\n" + '[[null,[0,0,0,0,0,0,0,0,0,[0,0,31.5,35.5],"0X1:0x2","Shop"]]]'
    got = spark.createDataFrame([(body,)], "b string").select(links.listing_of(F.col("b"), F.lit("0x1:0x2")).alias("hit"), links.listing_of(F.col("b"), F.lit("0x1:0x3")).alias("miss"), links.feature_cid(F.lit("0x1:0xff")).alias("cid")).first()
    assert tuple(got["hit"]) == (31.5, 35.5, None, None) and got["miss"] is None and got["cid"] == "255"


# resolution and ingest


def record(spark, rows):
    base = {"name_en": None, "category": "cafe", "phone": None, "url": None, "status": "works", "alias": None}
    frame = spark.createDataFrame(rows, "id long, name_he string, kind string, city string, note_he string, confidence double, benefit_fighter_card boolean, benefit_vacation_voucher boolean, reported_dates array<string>")
    return frame.withColumns({k: F.lit(v).cast("string") for k, v in base.items()}).withColumn("sources", F.array(F.struct(F.col("id").alias("row"))))


def test_clusters_and_collapse(spark):
    rows = [
        (1, "מלון דן", "single_location", "חיפה", "a", 0.7, True, False, ["2024-02-01"]), (2, "מלון דן פנורמה", "single_location", "חיפה", None, 0.8, True, False, []),
        (3, "מלון דן.", "single_location", "חיפה", "b", 0.9, False, True, ["2024-01-01"]), (4, "מלון דן", "single_location", "אילת", None, 0.9, True, False, []), (5, "skechers store", "chain", None, None, 0.9, True, False, []),
        (6, "skecher store", "chain", "x", "a", 0.6, True, False, []),
    ]
    records = record(spark, rows)
    clusters = resolve.cluster(records)
    by = {}
    for r in clusters.collect():
        by.setdefault((r["block"], r["cluster_id"]), set()).add(r["id"])
    assert sorted(map(sorted, by.values())) == [[1, 3], [2], [4], [5, 6]]
    out = {tuple(r["merged_names"]): r for r in resolve.collapse(records, clusters).collect()}
    r = out[("מלון דן", "מלון דן.")]
    assert (r["name_he"], r["note_he"], r["first_reported_at"], r["last_reported_at"], r["report_count"], r["confidence"], r["benefit_fighter_card"], r["benefit_vacation_voucher"]) == (
        "מלון דן.", "b a", "2024-01-01", "2024-02-01", 2, 0.9, True, True)


def test_joined_clusters_are_the_streamed_ones(spark):
    draw = random.Random(3)
    words = ["cafe", "coffee", "dan", "danny", "hotel", "hotels", "garden", "gardens", "burger", "burgers", "a"]
    name = lambda: " ".join(draw.choice(words) for _ in range(draw.randint(1, 3)))
    rows = [(k, name(), draw.choice(["", "", name()]), draw.choice(["x", "Y"]), draw.choice(["chain", "single_location", "online_only"]), draw.choice([None, None, "brand"])) for k in range(300)]
    records = spark.createDataFrame(rows, "id long, name_he string, name_en string, city string, kind string, alias string")
    streamed, joined = (sorted(tuple(r) for r in resolve.cluster(records, streamed=n).collect()) for n in (10_000, 0))
    assert streamed == joined and len(streamed) == 300


def test_locate_guards(spark):
    none = F.lit(None).cast("string")
    pois = spark.createDataFrame([("n1", "מלון הילטון", 32.0, 34.8), ("n2", "מלון הרלינגטון", 32.0, 34.8), ("n3", "גולדה", 32.0, 34.8), ("n4", "גולדה", 31.2, 34.8)], "poi string, name string, lat double, lon double")
    pois = pois.withColumns({c: none for c in ("name_he", "name_en", "brand", "city", "street", "housenumber", "phone", "website")}).withColumn("category", F.lit("tourism=hotel"))
    towns = spark.createDataFrame([("תל אביב", 32.05, 34.8)], "key string, lat double, lon double")
    asked = spark.createDataFrame([(1, "מלון הילטון", "תל אביב"), (2, "גולדה", "תל אביב"), (3, "גולדה", "nowhere"), (4, "!!", None), (5, "מלון", None)], "place long, name_he string, city string")
    got = {r["place"]: (r["poi"], r["reason"]) for r in resolve.locate(asked, pois, towns).collect()}
    assert got == {1: ("n1", None), 2: ("n3", None), 3: (None, "city_unresolved"), 4: (None, "no_osm_match"), 5: (None, "no_osm_match")}


def test_locate_searches_all_points(spark):
    from placemill.plans import catalogue

    d = "/root/testdata/sf0.001"
    got = {r["place"]: (r["poi"], r["match_confidence"]) for r in catalogue.queries()["locate_places"](spark, d).collect()}
    pois = catalogue._pois(spark, d)
    medians = {r["key"]: (r["lat"], r["lon"]) for r in resolve.city_medians(pois).collect()}
    asked = []
    for r in catalogue.places(spark, d).select("id", "name_he", "city").collect():
        name = r["name_he"] + (" hotel" if r["id"] % 3 == 0 else "")
        city = "nowhere" if r["id"] % 11 == 0 else r["city"].lower().replace("#", " ") if r["id"] % 4 else None
        if city is None or city in medians:
            asked.append((r["id"], name, *medians.get(city, (None, None))))
    asked = spark.createDataFrame(asked, "place long, query string, centre_lat double, centre_lon double")
    every = asked.crossJoin(resolve.search_space(pois).join(pois.select("poi", "lat", "lon"), "poi"))
    want = {r["place"]: (r["poi"], round(r["match_confidence"], 3)) for r in resolve.judged(every).collect()}
    assert {k: v for k, v in got.items() if v[0] is not None} == want
    assert {int(poi) % 10 for poi, _ in want.values()} - {3}


def test_upper_median(spark):
    pois = spark.createDataFrame([("A b", float(k), float(-k)) for k in (1, 2, 3, 4)] + [("c", 1.0, 1.0)], "city string, lat double, lon double")
    assert [tuple(r) for r in resolve.city_medians(pois).collect()] == [("a b", 3.0, -2.0)]


def test_upsert_keeps_what_it_does_not_own(spark):
    old = spark.createDataFrame([("a", "x", "published", 3), ("b", "y", "pending", 1)], "source_key string, name_he string, status string, confirm_count int")
    new = spark.createDataFrame([("a", None, "pending", 0), ("c", "z", "published", 0)], "source_key string, name_he string, status string, confirm_count int")
    got = sorted(tuple(r) for r in ingest.upsert(old, new, owned=["name_he"], defaults={"confirm_count": 0, "status": "pending"}).collect())
    assert got == [("a", None, "published", 3), ("b", "y", "pending", 1), ("c", "z", "pending", 0)]


def test_constraints_let_nulls_pass(spark):
    rows = shops(spark, [(1, "a", None, None, "published"), (2, "b", 1.0, 1.0, "nonsense"), (3, "c", 1.0, 1.0, None)]).withColumns({"pin_unavailable": F.lit(False), "location_precision": F.lit("exact")})
    assert sorted(tuple(r) for r in ingest.violations(rows, ingest.constraints()).collect()) == [(1, "published_needs_pin"), (2, "status")]


def test_points_and_rows(spark):
    got = spark.range(1).select(ingest.parse_point(F.lit("SRID=4326;POINT(35.2 31.5)")).alias("p")).first()["p"]
    assert tuple(got) == (31.5, 35.2)


def test_category_of_tags(spark):
    pairs = [("amenity", "cafe", "cafe"), ("shop", "massage", "spa"), ("shop", "x", "other"), (None, "x", "other")]
    frame = spark.createDataFrame([(k, a, b) for k, (a, b, _) in enumerate(pairs)], "id long, a string, b string")
    assert [r["c"] for r in frame.orderBy("id").select(ingest.category_of(F.col("a"), F.col("b")).alias("c")).collect()] == [c for _, _, c in pairs]


# cells and layout


def test_cell_difference(spark):
    rows = spark.createDataFrame([(1, "2024-01-01T00:00:00", " a b ", None), (2, "2024-01-02T00:00:00", "b, a", "c"), (3, None, "", "new")], "row long, reported_at string, vacation_voucher string, fighter_card string")
    every = cells.cells(rows)
    assert every.count() == 4
    known, new = every.filter("row = 1"), every.filter("row > 1")
    added = cells.diff(new, known)
    assert sorted(r["text"] for r in added.collect()) == ["c", "new"]
    assert [tuple(r) for r in cells.verify(new, added, "2024-01-01T12:00:00").select("row", "field").collect()] == [(2, "vacation_voucher")]


def test_layout(spark):
    values = spark.createDataFrame([(1, v) for v in (1.0, 1.5, 1.9, 5.0, 9.0, 9.2)], "page long, v double")
    got = sorted((round(r["position"], 3), r["n"]) for r in layout.merged_positions(values, ["page"], "v", 0.6).collect())
    assert got == [(1.467, 3), (5.0, 1), (9.1, 2)]
    edges = F.array(*[F.lit(float(x)) for x in (0, 10, 20)])
    assert tuple(spark.range(1).select(*[layout.bucket(F.lit(v), edges).alias(f"b{k}") for k, v in enumerate((-1.0, 0.0, 9.9, 10.0, 20.0))]).first()) == (None, 0, 0, 1, None)
    chars = spark.createDataFrame([(1, k, c, float(k), k + 1.0, t, t + 1) for k, (c, t) in enumerate([("a", 0.0), ("b", 0.0), (" ", 0.0), ("c", 0.0), ("d", 9.0)])], "page long, seq long, text string, x0 double, x1 double, top double, bottom double")
    assert sorted(r["text"] for r in layout.runs(chars).collect()) == ["ab c", "d"]


TABLES = ["part", "events", "supplier", "customer", "orders", "documents", "lineitem", "nation", "region", "pages", "conversations"]


def _catalogue():
    from placemill.plans import catalogue, more  # noqa: F401

    return catalogue


def test_every_query_has_its_sql():
    c = _catalogue()
    assert set(c.oracle_sql()) == set(c.queries()) and len(c.queries()) > 120


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(_catalogue().queries()))
def test_queries_match_their_sql(spark, duck, name):
    df = _catalogue().queries()[name](spark, "/root/testdata/sf0.001")
    order = sorted(df.columns)
    want = duck.sql(_catalogue().oracle_sql()[name])
    assert sorted(want.columns) == order
    places = [want.columns.index(x) for x in order]
    text = lambda rows: sorted(map(str, rows))
    assert text(tuple(r[x] for x in order) for r in df.collect()) == text(tuple(r[k] for k in places) for r in want.fetchall())


def test_locate_ties_go_by_position(spark):
    none = None
    pois = [(f"n/{k}", "dan hotel", none, none, none, "x", none, none, none, none, "cafe", 31.5 + (2.0 if k < 11 else 0.0), 35.0, k) for k in range(14)]
    pois.append(("n/99", "hotel", none, none, none, "x", none, none, "03-1", "u", "cafe", 31.5, 35.0, 99))
    frame = spark.createDataFrame(pois, "poi string, name string, name_he string, name_en string, brand string, city string, street string, housenumber string, phone string, website string, category string, lat double, lon double, ord long")
    towns = spark.createDataFrame([("here", 31.5, 35.0)], "key string, lat double, lon double")
    asked = [(1, "Dan hotel", None), (2, "dan hotel", "Here"), (3, "hotel", "Here"), (4, "dan hotel", "!!"), (5, "hotel dan", ""), (6, "dan", "Here")]
    got = {r["place"]: r for r in resolve.locate(spark.createDataFrame(asked, "place long, name_he string, city string"), frame, towns).collect()}
    # the first of the order without a town; of the twelve candidates only the last one is near the town; a town without letters is one that isn't known
    assert (got[1]["poi"], got[2]["poi"], got[5]["poi"]) == ("n/0", "n/11", "n/0") and got[4]["reason"] == "city_unresolved"
    assert got[3]["poi"] is None or got[3]["poi"] == "n/99"
    assert got[2]["provider_ref"] == "osm:n/11" and got[2]["name_osm"] == "dan hotel" and got[6]["reason"] == "no_osm_match"


def test_sheets_of_several_files(spark, tmp_path):
    from placemill.sources import files

    head = "\ufeff\u05ea\u05d0\u05e8\u05d9\u05da,x,v,f\n"
    (tmp_path / "a.csv").write_text(head + '1/2/2024 10:00:00,,"Two\nlines", \n2/2/2024 10:00:00,,,card\nshort,row,gone\n', encoding="utf-8")
    (tmp_path / "b.csv").write_text(head + "31/2/2024 10:00:00,,late,\n", encoding="utf-8")
    got = sorted(tuple(r) for r in files.sheet_cells(spark, str(tmp_path)).collect())
    assert got == sorted([(2, "2024-02-01T10:00:00", "vacation_voucher", "Two\nlines"), (3, "2024-02-02T10:00:00", "fighter_card", "card"), (5, None, "vacation_voucher", "late")])


def test_json_files(spark, tmp_path):
    from placemill.sources import files

    rows = spark.createDataFrame([(2, "b"), (1, "a")], "id long, name string")
    files.write_json(rows, f"{tmp_path}/out")
    assert spark.read.json(f"{tmp_path}/out").count() == 2
    (tmp_path / "array.json").write_text('[{"id": 1}, {"id": 2}]')
    assert files.read_json(spark, f"{tmp_path}/array.json").count() == 2
    files.replace_table(rows, f"{tmp_path}/v1", "id")
    assert [r["id"] for r in spark.read.parquet(f"{tmp_path}/v1").orderBy("id").collect()] == [1, 2]
    good = '{"name_he": "x", "kind": "chain", "category": "cafe", "confidence": 0.5}'
    (tmp_path / "answers.jsonl").write_text(f'{{"index": 0, "places": [{good}, {{"name_he": "", "kind": "chain", "category": "cafe", "confidence": 2}}]}}\nnot json\n')
    valid, wrong = files.read_answers(spark, f"{tmp_path}/answers.jsonl")
    assert [(r["index"], r["name_he"]) for r in valid.collect()] == [(0, "x")]
    assert sorted(r["why"] for r in wrong.collect()) == ["name,confidence", "not JSON of this shape"]
    body = spark.range(1).select(files.parse_answers(F.lit(f'[{{"index": 3, "places": [{good}]}}]')).alias("a"), files.parse_answers(F.lit("no")).alias("b")).first()
    assert body["a"][0]["index"] == 3 and body["b"] is None


def test_pins_outside_the_country_are_refused(spark):
    own = shops(spark, [(1, "a", None, None, "published")]).withColumns({"location_precision": F.lit("exact"), "pin_unavailable": F.lit(True)})
    far = spark.createDataFrame([(1, 50.0, 10.0, "town")], "id long, lat double, lng double, location_precision string")
    with pytest.raises(ValueError, match="outside"):
        ingest.with_pins(own, far)
    near = spark.createDataFrame([(1, 31.0, 35.0, "town")], "id long, lat double, lng double, location_precision string")
    r = ingest.with_pins(own, near).first()
    assert (r["lat"], r["location_precision"], r["pin_unavailable"]) == (31.0, "town", False)


def test_near_matches_at_the_pole_and_the_date_line(spark):
    own = shops(spark, [(1, "pole", 89.9999, 10.0, "published"), (2, "line", 0.0, 179.9999, "published"), (3, "far", 70.0, 20.0, "published")])
    probes = spark.createDataFrame([(1, 89.9999, -170.0, "pole"), (2, 0.0, -179.9999, "line"), (3, 70.0, 20.001, "far")], "probe_id long, lat double, lng double, name string")
    assert {r["probe_id"]: r["id"] for r in reads.near_matches(probes, own).collect()} == {1: 1, 2: 2, 3: 3}


def test_window_trust_against_the_fold(spark):
    import random

    draw = random.Random(5)
    own = [(k, draw.choice(["user_submission", "pdf_import"]), draw.choice(["pending", "published", "rejected"]), draw.randint(0, 3), draw.randint(0, 3)) for k in range(60)]
    frame = spark.createDataFrame(own, "id long, source string, status string, confirm_count int, report_count int")
    rows = events(spark, [(draw.randrange(60), draw.choice(["confirm", "not_working", "not_working", "new_submission"]), draw.choice("abcde"), draw.randint(1, 28)) for _ in range(900)])
    none = spark.createDataFrame([], "id long, place_id long, action string, created_at timestamp_ntz")
    a, b = (sorted(tuple(r) for r in trust.trust_state(frame, rows, 5, m).collect()) for m in (None, none))
    assert a == b


def test_near_matches_of_copies_are_not_paired(spark):
    """A doorway of very many places and probes of one name: 400 million pairs, one comparison of names."""
    at = [F.lit(31.777).alias("lat"), F.lit(35.298).alias("lng")]
    own = spark.range(20_000).select((F.col("id") + 5).alias("id"), F.lit("golf").alias("name_he"), *at, F.lit("published").alias("status"))
    probes = spark.range(20_000).select(F.col("id").alias("probe_id"), *at, F.lit("golf").alias("name"))
    got = reads.near_matches(probes, own).groupBy("id", "distance_m", "name_similarity").count().collect()
    assert [tuple(r) for r in got] == [(5, 0.0, 1.0, 20_000)]


def test_names_that_may_be_alike_all_meet_and_others_seldom(spark):
    """Against all pairs: none that is alike is missed, and names that share only a usual word don't meet."""
    rng = random.Random(7)
    words = ["golf", "castro", "zip", "קפה", "İzmir", "ß", "shop"]
    names = sorted({" ".join(rng.choices(words, k=rng.randint(1, 3))) for _ in range(60)} | {f"shop {k * 7919 % 100_000}" for k in range(200)} | {"shop 123456", "shop 1234567", "!!", ""})
    one = spark.createDataFrame([(n, n, 10 + k % 2, -3, 4) for k, n in enumerate(names)], "one string, name string, x long, y long, z long")
    got = {(r["one"], r["other"]) for r in reads.alike_nearby(one, None, 1, 0.9).collect()}
    alike = {(a, b) for a in names for b in names if max(word_similarity(a, b), word_similarity(b, a)) > 0.9}
    assert alike <= got and len(got) < len(names) ** 2 / 20
    far = one.withColumn("x", F.when(F.col("x") == 10, 12).otherwise(F.col("x"))).withColumnRenamed("one", "other").filter("x = 12")
    assert reads.alike_nearby(one.filter("x = 10"), far, 1, 0.9).isEmpty() and not reads.alike_nearby(one.filter("x = 10"), far, 2, 0.9).isEmpty()


def test_names_that_share_their_rarest_trigrams_only_do_not_meet(spark):
    """Within each of 20 groups all names have the group's rare word; a pair that isn't alike isn't written, however rare what it shares is."""
    rng, words = random.Random(5), ["alon", "brik", "cedu", "dorf", "ezgi", "fyop", "ghux", "hilt", "ivra", "jump", "kelb", "lnoq"]
    names = sorted({f"{' '.join(rng.sample(words, 3))} w{g}" for g in range(20) for _ in range(30)})
    one = spark.createDataFrame([(k, n, 1, 2, 3) for k, n in enumerate(names)], "one long, name string, x long, y long, z long")
    got = {(names[r["one"]], names[r["other"]]) for r in reads.alike_nearby(one, None, 1, 0.9).collect()}
    alike = {(a, b) for a in names for b in names if max(word_similarity(a, b), word_similarity(b, a)) > 0.9}
    assert alike <= got and len(got) < 1.2 * len(alike)
    pairs = reads.alike_nearby(one, one.withColumnRenamed("one", "other"), 1, 0.9).collect()  # the same rows as two tables
    assert {(names[r["one"]], names[r["other"]]) for r in pairs} == got
