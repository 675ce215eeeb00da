"""Queries of the place operators over the driver's tables, each over whole tables, with SQL for the oracle where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placemill.functions import color, dates, geo, similarity, text
from placemill.operators import cells, ingest, layout, links, reads, resolve, trust
from placemill.operators.settle import numbered
from placemill.plans import oracle, tables
from placemill.plans.tables import AS_OF, PLACES_SQL, REPORTS_SQL, duck, places, read, reports

AT = (31.5, 35.0)
DAYS = 7
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

WITH_PLACES = f"WITH places AS ({duck(PLACES_SQL)})"
WITH_REPORTS = f"WITH places AS ({duck(PLACES_SQL)}), reports AS ({duck(REPORTS_SQL)})"
VISIBLE_SQL = "status IN ('published', 'reported_not_working')"


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(SQL)


def _geodesic_sql(lat, lng, at: str = "") -> str:
    """The same first-order formula, from the columns lat and lng (of the table `at`) to a point."""
    a, b = f"radians(CAST({lat} AS DOUBLE))", f"radians(CAST({lng} AS DOUBLE))"
    f, g, l = f"((radians({at}lat) + {a}) / 2)", f"((radians({at}lat) - {a}) / 2)", f"((radians({at}lng) - {b}) / 2)"
    return f"""(SELECT CASE WHEN s <= 1e-20 THEN 0.0 ELSE 2 * w * {geo.AXIS!r} * (1 + {geo.FLATTENING!r} * ((3 * r - 1) / (2 * k) * pow(sin(f) * cos(g), 2) - (3 * r + 1) / (2 * s) * pow(cos(f) * sin(g), 2))) END
        FROM (SELECT *, sqrt(s * k) / w AS r FROM (SELECT *, atan(sqrt(s / k)) AS w FROM (SELECT {f} AS f, {g} AS g,
             pow(sin({g}) * cos({l}), 2) + pow(cos({f}) * sin({l}), 2) AS s, pow(cos({g}) * cos({l}), 2) + pow(sin({f}) * sin({l}), 2) AS k))))"""


# reads


def _near(where: str, limit: int) -> str:
    return f"""{WITH_PLACES}, d AS (SELECT *, {_geodesic_sql(*AT)} AS m FROM places WHERE {VISIBLE_SQL} AND lat IS NOT NULL AND {where})
        SELECT id, name_he, category, round(m, 3) AS distance_m FROM d WHERE m <= 25000 ORDER BY m, id LIMIT {limit}"""


@query(_near("true", 300))
def near_places(spark, sf_dir):
    return reads.places_near(places(spark, sf_dir), *AT).select("id", "name_he", "category", F.round("distance_m", 3).alias("distance_m"))


@query(_near("benefit_vacation_voucher AND category IN ('cafe', 'hotel', 'spa')", 50))
def near_filtered(spark, sf_dir):
    found = reads.places_near(places(spark, sf_dir), *AT, benefit="vacation_voucher", categories=["cafe", "hotel", "spa"], limit=50)
    return found.select("id", "name_he", "category", F.round("distance_m", 3).alias("distance_m"))


@query(f"""{WITH_PLACES} SELECT id, round(2 * 6371.0 * asin(sqrt(pow(sin((radians(CAST({AT[0]} AS DOUBLE)) - radians(lat)) / 2), 2)
    + cos(radians(lat)) * cos(radians(CAST({AT[0]} AS DOUBLE))) * pow(sin((radians(CAST({AT[1]} AS DOUBLE)) - radians(lng)) / 2), 2))), 6) AS km FROM places WHERE lat IS NOT NULL""")
def haversine_distances(spark, sf_dir):
    return places(spark, sf_dir).filter(reads.has_point()).select("id", F.round(geo.haversine_km(F.col("lat"), F.col("lng"), *AT), 6).alias("km"))


@query(f"{WITH_PLACES} SELECT id, name_he, category, lat, lng, distance_m FROM (SELECT *, CAST(NULL AS DOUBLE) AS distance_m FROM places) WHERE {VISIBLE_SQL} AND lat IS NOT NULL ORDER BY name_he, id LIMIT 2000")
def all_places(spark, sf_dir):
    return reads.places_all(places(spark, sf_dir)).select("id", "name_he", "category", "lat", "lng", "distance_m")


@query(f"{WITH_PLACES} SELECT id, name_he, city, lat, lng FROM places WHERE id = 17 AND {VISIBLE_SQL}")
def place_by_id(spark, sf_dir):
    return reads.place_by_id(places(spark, sf_dir), 17).select("id", "name_he", "city", "lat", "lng")


@query(f"{WITH_PLACES} SELECT id, name_he, is_chain, is_online, location_precision, CAST(NULL AS DOUBLE) AS lat FROM places WHERE {VISIBLE_SQL} AND (is_chain OR is_online OR lat IS NULL)")
def unmapped_places(spark, sf_dir):
    return reads.unmapped(places(spark, sf_dir)).select("id", "name_he", "is_chain", "is_online", "location_precision", "lat")


@query(f"{WITH_PLACES} SELECT count(*) AS n FROM places WHERE status = 'published'")
def published_count(spark, sf_dir):
    return reads.published_count(places(spark, sf_dir))


@query(f"""{WITH_PLACES} SELECT count(*) AS total, count(*) FILTER (benefit_vacation_voucher AND NOT benefit_fighter_card) AS voucher_only, count(*) FILTER (NOT benefit_vacation_voucher OR benefit_fighter_card) AS fighter
    FROM places WHERE {VISIBLE_SQL} AND lat IS NOT NULL""")
def hero_counts(spark, sf_dir):
    return reads.hero_counts(places(spark, sf_dir))


@query(f"{WITH_PLACES} SELECT status, location_precision, lat IS NOT NULL AS has_point, count(*) AS n FROM places GROUP BY ALL")
def precision_hist(spark, sf_dir):
    return reads.precision_histogram(places(spark, sf_dir))


WORDS = "contains(lower(concat_ws(' ', name_he, city, address_he)), 'small') AND contains(lower(concat_ws(' ', name_he, city, address_he)), 'a')"


@query(f"{WITH_PLACES} SELECT id, name_he FROM places WHERE {WORDS}")
def search_places(spark, sf_dir):
    return reads.search(places(spark, sf_dir), " a  SMALL").select("id", "name_he")


@query(f"{WITH_PLACES} SELECT category, count(*) AS n FROM places WHERE {VISIBLE_SQL} AND benefit_fighter_card AND contains(lower(concat_ws(' ', name_he, city, address_he)), 'a') GROUP BY category")
def facet_counts(spark, sf_dir):
    every = places(spark, sf_dir).filter(reads.visible())
    return reads.facet_counts(every.filter(reads.has_point()), every.filter(~reads.has_point()), "fighter_card", "a")


SPONSORS = [{"name": "GREEN", "until": "2024-12-31"}, {"name": "x", "id": 12, "until": "2024-12-31"}, {"name": "red", "until": "2024-01-01"}]


@query(f"""{WITH_PLACES} SELECT id, contains(lower(name_he), 'green') OR id = 12 AS sponsored,
    row_number() OVER (ORDER BY contains(lower(name_he), 'green') OR id = 12 DESC, name_he, id) AS place FROM places WHERE {VISIBLE_SQL}""")
def sponsored_order(spark, sf_dir):
    found = places(spark, sf_dir).filter(reads.visible())
    ordered = reads.sponsored_first(found, [F.col("name_he"), F.col("id")], SPONSORS, "2024-06-01")
    return numbered(ordered).select("id", "sponsored", "place")


def _queue(where: str, order: str, limit: int) -> str:
    return f"{WITH_PLACES} SELECT id, name_he, report_count, confirm_count FROM places WHERE {where} ORDER BY {order} LIMIT {limit}"


def _queued(found: DataFrame) -> DataFrame:
    return found.select("id", "name_he", "report_count", "confirm_count")


@query(_queue("status = 'pending'", "(id * 7919) % 1000, id", 500))
def admin_pending(spark, sf_dir):
    return _queued(reads.admin_pending(places(spark, sf_dir).withColumn("created_at", F.expr("(id * 7919) % 1000"))))


@query(_queue("status = 'reported_not_working'", "report_count DESC, id", 200))
def admin_flagged(spark, sf_dir):
    return _queued(reads.admin_flagged(places(spark, sf_dir)))


@query(_queue("status = 'reported_not_working' AND confirm_count > 0", "confirm_count DESC, id", 100))
def admin_revived(spark, sf_dir):
    return _queued(reads.admin_revived(places(spark, sf_dir)))


@query(f"""{WITH_PLACES}, c AS (SELECT floor((lng / 360 + 0.5) * 131072.0 / 46)::BIGINT AS cell_x,
    floor((0.5 - ln((1 + sin(radians(lat))) / (1 - sin(radians(lat)))) / (4 * pi())) * 131072.0 / 46)::BIGINT AS cell_y FROM places WHERE {VISIBLE_SQL} AND lat IS NOT NULL)
    SELECT cell_x, cell_y, count(*) AS n, CASE WHEN count(*) < 10 THEN 0 WHEN count(*) < 100 THEN 1 ELSE 2 END::INT AS step FROM c GROUP BY cell_x, cell_y""")
def map_clusters(spark, sf_dir):
    return reads.map_clusters(places(spark, sf_dir), 8).select("cell_x", "cell_y", "n", "step")


@query(f"""{WITH_PLACES} SELECT id, CASE WHEN status = 'reported_not_working' THEN 'dead' WHEN benefit_fighter_card AND benefit_vacation_voucher THEN 'both'
    WHEN benefit_vacation_voucher THEN 'voucher' ELSE 'fighter' END AS rail FROM places""")
def row_rails(spark, sf_dir):
    return places(spark, sf_dir).select("id", reads.row_rail().alias("rail"))


@query(f"""{WITH_PLACES}, r AS (SELECT *, CASE WHEN status = 'reported_not_working' THEN 'dead' WHEN benefit_fighter_card AND benefit_vacation_voucher THEN 'both' WHEN benefit_vacation_voucher THEN 'voucher' ELSE 'fighter' END AS rail
    FROM places WHERE lat IS NOT NULL AND lng IS NOT NULL)
    SELECT id, '{{"type":"Feature","geometry":{{"type":"Point","coordinates":[' || lng || ',' || lat || ']}},"properties":{{"id":' || id || ',"name":"' || name_he || '","category":"' || category || '","rail":"' || rail || '"}}}}' AS feature FROM r""")
def geojson_features(spark, sf_dir):
    return reads.geojson(places(spark, sf_dir))


def _near_match_sql(probes: str) -> str:
    """CTEs up to best (probe_id, id, name_he, name_similarity, distance_m) for probes (probe_id, lat, lng, name), each against every place."""
    return f"""{WITH_PLACES}, probes AS ({probes}),
    near AS (SELECT probe_id, p.name, s.id, s.name_he, {_geodesic_sql("p.lat", "p.lng", "s.")} AS distance_m FROM probes p JOIN places s ON abs(s.lat - p.lat) < 0.01 AND abs(s.lng - p.lng) < 0.01 WHERE {VISIBLE_SQL} AND s.lat IS NOT NULL),
    pairs AS (SELECT DISTINCT name_he AS x, name AS y FROM near WHERE distance_m <= 75), {oracle.word_similarities("pairs")},
    best AS (SELECT probe_id, id, name_he, similarity AS name_similarity, distance_m FROM near JOIN near_words ON x = name_he AND y = name WHERE distance_m <= 75 AND similarity > 0.9
             QUALIFY row_number() OVER (PARTITION BY probe_id ORDER BY similarity DESC, distance_m, id) = 1)"""


@query(_near_match_sql("SELECT id AS probe_id, lat + 0.0001::DOUBLE AS lat, lng, name_he || ' new' AS name FROM places WHERE lat IS NOT NULL") + " SELECT probe_id, id, name_he, name_similarity, round(distance_m, 3) AS distance_m FROM best")
def near_match(spark, sf_dir):
    """Every place, moved by some metres and named a little differently, against all places."""
    own = places(spark, sf_dir).filter(reads.has_point())
    probes = own.select(F.col("id").alias("probe_id"), (F.col("lat") + 0.0001).alias("lat"), F.col("lng"), F.concat("name_he", F.lit(" new")).alias("name"))
    return reads.near_matches(probes, own).withColumn("distance_m", F.round("distance_m", 3))


# trust


@query(f"{WITH_REPORTS} SELECT place_id, count(DISTINCT CASE WHEN kind <> 'not_working' THEN reporter END) AS vouches FROM reports GROUP BY place_id")
def vouch_counts(spark, sf_dir):
    return trust.vouch_counts(reports(spark, sf_dir))


@query(f"""{WITH_REPORTS} SELECT place_id, count(DISTINCT CASE WHEN kind = 'not_working' AND created_at > TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY THEN reporter END) AS failures
    FROM reports GROUP BY place_id""")
def failure_counts(spark, sf_dir):
    return trust.failure_counts(reports(spark, sf_dir), AS_OF, DAYS)


@query(f"""{WITH_REPORTS}, v AS (SELECT * FROM reports WHERE kind <> 'not_working')
    SELECT a.id, a.place_id, count(DISTINCT b.reporter) AS vouches FROM v a JOIN v b ON a.place_id = b.place_id AND (b.created_at, b.id) <= (a.created_at, a.id) GROUP BY a.id, a.place_id""")
def running_vouches(spark, sf_dir):
    return trust.running_vouches(reports(spark, sf_dir)).select("id", "place_id", "vouches")


@query(f"""{WITH_REPORTS}, f AS (SELECT * FROM reports WHERE kind = 'not_working')
    SELECT a.id, a.place_id, count(DISTINCT b.reporter)::INT AS failures FROM f a JOIN f b ON a.place_id = b.place_id AND b.created_at <= a.created_at AND b.created_at > a.created_at - INTERVAL 7 DAY
    GROUP BY a.id, a.place_id""")
def trailing_failures(spark, sf_dir):
    return trust.trailing_failures(reports(spark, sf_dir), DAYS).select("id", "place_id", "failures")


TRUST_SQL = f"""{WITH_REPORTS},
    v AS (SELECT * FROM reports WHERE kind <> 'not_working'), f AS (SELECT * FROM reports WHERE kind = 'not_working'),
    vn AS (SELECT a.place_id, a.created_at, a.id, count(DISTINCT b.reporter) AS n FROM v a JOIN v b ON a.place_id = b.place_id AND (b.created_at, b.id) <= (a.created_at, a.id) GROUP BY ALL),
    fn AS (SELECT a.place_id, a.created_at, a.id, count(DISTINCT b.reporter) AS n FROM f a JOIN f b ON a.place_id = b.place_id AND (b.created_at, b.id) <= (a.created_at, a.id)
           AND b.created_at > a.created_at - INTERVAL 7 DAY GROUP BY ALL),
    fv AS (SELECT fn.*, coalesce((SELECT max(vn.n) FROM vn WHERE vn.place_id = fn.place_id AND (vn.created_at, vn.id) < (fn.created_at, fn.id)), 0) AS before FROM fn),
    hit AS (SELECT DISTINCT p.id FROM places p JOIN fv ON p.id = fv.place_id
            WHERE (p.status = 'published' OR p.status = 'pending' AND before >= 2)
              AND fv.n >= CASE WHEN source = 'user_submission' AND CASE WHEN before = 0 THEN confirm_count ELSE before END <= 1 THEN 1 ELSE 3 END),
    tv AS (SELECT place_id, max(n) AS n, max(created_at) AS at FROM vn GROUP BY place_id),
    tf AS (SELECT place_id, arg_max(n, (created_at, id)) AS n FROM fn GROUP BY place_id)
    SELECT p.id, CASE WHEN hit.id IS NOT NULL THEN 'reported_not_working' WHEN status = 'pending' AND coalesce(tv.n, 0) >= 2 THEN 'published' ELSE status END AS status,
           coalesce(tv.n, confirm_count)::INT AS confirm_count, coalesce(tf.n, report_count)::INT AS report_count, strftime(tv.at, '%Y-%m-%d %H:%M:%S') AS confirmed
    FROM places p LEFT JOIN hit ON p.id = hit.id LEFT JOIN tv ON tv.place_id = p.id LEFT JOIN tf ON tf.place_id = p.id"""


@query(TRUST_SQL)
def trust_state(spark, sf_dir):
    found = trust.trust_state(places(spark, sf_dir), reports(spark, sf_dir), DAYS)
    return found.select("id", "status", "confirm_count", "report_count", F.date_format("last_confirmed_at", "yyyy-MM-dd HH:mm:ss").alias("confirmed"))


@query(f"""{WITH_REPORTS}, t AS (SELECT place_id, max(created_at) AS last_at FROM reports WHERE kind <> 'not_working' GROUP BY place_id),
    j AS (SELECT p.id, status, (source = 'user_submission' AND confirm_count <= 1) AS alone, last_at, TIMESTAMP '2024-02-20 00:00:00' - last_at AS age FROM places p LEFT JOIN t ON t.place_id = p.id)
    SELECT id, last_at IS NULL AS unverified, alone AS single_source, coalesce(age <= INTERVAL 30 DAY, false) AS fresh, coalesce(age > INTERVAL 183 DAY, false) AS stale,
           CASE WHEN status = 'reported_not_working' THEN 'reported' WHEN status = 'pending' THEN 'pending' WHEN alone THEN 'single_source' WHEN age > INTERVAL 183 DAY THEN 'stale'
                WHEN age <= INTERVAL 30 DAY THEN 'fresh' ELSE '' END AS badge FROM j""")
def freshness_badges(spark, sf_dir):
    last = reports(spark, sf_dir).filter(trust.is_vouch()).groupBy(F.col("place_id").alias("id")).agg(F.max(F.col("created_at").cast("timestamp")).alias("last_confirmed_at"))
    return trust.badges(places(spark, sf_dir).join(last, "id", "left"), "2024-02-20 00:00:00")


@query(f"""{WITH_REPORTS}, d AS (SELECT *, count(*) OVER (PARTITION BY reporter ORDER BY created_at RANGE BETWEEN INTERVAL 48 HOUR PRECEDING AND CURRENT ROW) AS around,
    count(*) OVER (PARTITION BY reporter, created_at ORDER BY id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS later FROM reports)
    SELECT id, reporter, around - later >= 5 AS limited FROM d""")
def rate_limited_reports(spark, sf_dir):
    return trust.rate_limited(reports(spark, sf_dir), seconds=172_800).select("id", "reporter", "limited")


@query(f"{WITH_REPORTS} SELECT r.id, r.place_id FROM reports r WHERE NOT EXISTS (SELECT 1 FROM places p WHERE p.id = r.place_id AND p.status <> 'rejected')")
def orphan_reports(spark, sf_dir):
    return trust.orphans(reports(spark, sf_dir), places(spark, sf_dir).filter("status <> 'rejected'")).select("id", "place_id")


@query("""WITH a AS (SELECT event_id, user_id, ts, event_type <> 'error' AS ok FROM events)
    SELECT event_id AS id, coalesce(sum((NOT ok)::INT) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 172800000000 PRECEDING AND 1 PRECEDING), 0) >= 3 AS locked FROM a""")
def admin_lockouts(spark, sf_dir):
    attempts = read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("who"), F.col("ts").alias("at"), (F.col("event_type") != "error").alias("ok"))
    return trust.lockouts(attempts, failures=3, minutes=2880).select("id", "locked")


# keys and hashes


@query("SELECT c_custkey AS id, substring(sha256('salt:' || c_name), 1, 32) AS hash FROM customer")
def reporter_hashes(spark, sf_dir):
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), text.reporter_hash("salt", F.col("c_name")).alias("hash"))


@query("SELECT doc_id AS id, substring(sha256(encode('v1') || '\\x00'::BLOB || encode('m') || '\\x00'::BLOB || encode(text)), 1, 32) AS cache_key FROM documents")
def cache_keys(spark, sf_dir):
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), text.cache_key("v1", "m", F.col("text")).alias("cache_key"))




@query(f"""{WITH_PLACES}, h AS (SELECT id, lat, lng, sha256(id::VARCHAR) AS h FROM places WHERE lat IS NOT NULL),
    o AS (SELECT *, ('0x' || substring(h, 1, 8))::BIGINT::DOUBLE / 4294967295 * 2 * pi() AS a, sqrt(('0x' || substring(h, 9, 8))::BIGINT::DOUBLE / 4294967295) * 400.0 AS r FROM h)
    SELECT id, round(lat + r * cos(a) / 111320.0, 6) AS lat, round(lng + r * sin(a) / (111320.0 * cos(radians(lat))), 6) AS lng FROM o""")
def disc_offsets(spark, sf_dir):
    spot = geo.disc_offset(F.col("id"), F.col("lat"), F.col("lng"))
    return places(spark, sf_dir).filter(reads.has_point()).withColumn("s", spot).select("id", "s.lat", "s.lng")


@query(f"""{WITH_PLACES} SELECT id, coalesce(provider_ref, CASE WHEN is_chain THEN 'chain' WHEN is_online THEN 'online' ELSE 'unlocated' END || ':' || lower(trim(name_he)) || '@' || lower(city)) AS source_key FROM places""")
def source_keys(spark, sf_dir):
    c = F.col
    return places(spark, sf_dir).select("id", text.source_key(c("provider_ref"), c("is_chain"), c("is_online"), c("name_he"), c("city")).alias("source_key"))


@query(f"""{WITH_PLACES} SELECT id, name_he || ' ' || address_he || CASE WHEN contains(name_he || ' ' || address_he, city) THEN '' ELSE ' ' || city END AS terms FROM places""")
def nav_terms(spark, sf_dir):
    return places(spark, sf_dir).select("id", text.search_terms(F.col("name_he"), F.col("address_he"), F.col("city")).alias("terms"))


@query(f"""{WITH_PLACES}, t AS (SELECT *, lat IS NOT NULL AND location_precision <> 'town' AS usable, replace(replace(name_he || ' ' || address_he || ' ' || city, ' ', '%20'), '#', '%23') AS terms FROM places)
    SELECT id, CASE WHEN usable THEN 'point' ELSE 'https://www.google.com/maps/search/?api=1&query=' || terms END AS google,
           CASE WHEN starts_with(provider_ref, 'osm:') THEN 'https://www.openstreetmap.org/' || substring(provider_ref, 5) END AS osm FROM t""")
def nav_urls(spark, sf_dir):
    to = links.navigation()
    return places(spark, sf_dir).select("id", F.when(links.usable_point(), "point").otherwise(to["google"]).alias("google"), to["osm"].alias("osm"))


@query("""WITH m AS (SELECT o_orderkey AS id, o_totalprice AS m FROM orders) SELECT id, CASE WHEN m < 950 THEN (floor(m / 10 + 0.5) * 10)::BIGINT::VARCHAR || ' מ׳'
    WHEN m < 9500 THEN printf('%.1f', m / 1000) || ' ק״מ' ELSE printf('%.0f', m / 1000) || ' ק״מ' END AS label FROM m""")
def distance_labels(spark, sf_dir):
    m = F.col("o_totalprice")
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), geo.distance_label(m).alias("label"))


# cells

ROWS_SQL = "SELECT p_partkey AS row, strftime(TIMESTAMP '2024-01-01' + INTERVAL 1 HOUR * (p_partkey % 500), '%Y-%m-%dT%H:%M:%S') AS reported_at, p_name || ', ' || p_brand AS vacation_voucher, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE ' ' || p_type || '! ' END AS fighter_card FROM part"
CELLS_SQL = f"WITH r AS ({ROWS_SQL}), c AS (SELECT row, reported_at, 'vacation_voucher' AS field, trim(vacation_voucher) AS text FROM r UNION ALL SELECT row, reported_at, 'fighter_card', trim(fighter_card) FROM r WHERE fighter_card IS NOT NULL)"
PRINT_SQL = "array_to_string(list_sort(list_filter(string_split_regex(lower(regexp_replace(text, '[^A-Za-z0-9_]+', ' ', 'g')), ' +'), lambda x: x <> '')), ' ')"
DIFF_SQL = f"""{CELLS_SQL}, p AS (SELECT *, {PRINT_SQL} AS print FROM c), k AS (SELECT DISTINCT print FROM p WHERE row % 4 = 0), n AS (SELECT * FROM p WHERE row % 4 <> 0),
    a AS (SELECT * FROM n WHERE print NOT IN (SELECT print FROM k))"""
END = "2024-01-15T00:00:00"


def _rows(spark, sf_dir) -> DataFrame:
    stamp = F.date_format(F.timestamp_seconds(F.lit(1_704_067_200) + 3600 * (F.col("p_partkey") % 500)), "yyyy-MM-dd'T'HH:mm:ss")
    voucher, card = F.concat("p_name", F.lit(", "), "p_brand"), F.when(F.col("p_partkey") % 3 != 0, F.concat(F.lit(" "), "p_type", F.lit("! ")))
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("row"), stamp.alias("reported_at"), voucher.alias("vacation_voucher"), card.alias("fighter_card"))


def _sheets(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """A quarter of the rows as the snapshot, with the words of a cell in another order, and the rest as the newer sheet."""
    every = cells.cells(_rows(spark, sf_dir))
    return every.filter("row % 4 <> 0"), every.filter("row % 4 = 0").withColumn("text", F.array_join(F.reverse(F.split("text", " ")), " "))


@query(f"{CELLS_SQL} SELECT * FROM c")
def cell_unpivot(spark, sf_dir):
    return cells.cells(_rows(spark, sf_dir))


@query(f"{CELLS_SQL} SELECT text, count(*) AS n, min(row) AS first_row FROM c GROUP BY text")
def cell_occurrences(spark, sf_dir):
    return cells.occurrences(_rows(spark, sf_dir)).select("text", "n", F.col("occurrences")[0]["row"].alias("first_row"))


@query(f"{DIFF_SQL} SELECT row, field, text, print FROM a")
def cell_diff(spark, sf_dir):
    return cells.diff(*_sheets(spark, sf_dir)).select("row", "field", "text", "print")


@query(f"""{DIFF_SQL} SELECT n.field, count(*) AS cells, (SELECT count(*) FROM a WHERE a.field = n.field) AS added, (SELECT count(*) FROM a WHERE a.field = n.field AND reported_at > '{END}') AS newer
    FROM n GROUP BY n.field""")
def diff_summary(spark, sf_dir):
    new, known = _sheets(spark, sf_dir)
    return cells.diff_summary(new, cells.diff(new, known), END)


@query(f"{DIFF_SQL} SELECT row, field FROM n WHERE reported_at > '{END}' AND print IN (SELECT print FROM k)")
def verify_diff(spark, sf_dir):
    new, known = _sheets(spark, sf_dir)
    return cells.verify(new, cells.diff(new, known), END).select("row", "field")


@query(f"{CELLS_SQL} SELECT max(reported_at) AS snapshot_end FROM c WHERE row % 4 = 0")
def snapshot_end(spark, sf_dir):
    return cells.snapshot_end(_sheets(spark, sf_dir)[1])


@query(f"{DIFF_SQL} SELECT row, reported_at, CASE WHEN field = 'vacation_voucher' THEN text END AS vacation_voucher, CASE WHEN field = 'fighter_card' THEN text END AS fighter_card FROM a")
def added_rows(spark, sf_dir):
    return cells.to_raw_rows(cells.diff(*_sheets(spark, sf_dir))).drop("page")


STAMPS_SQL = "SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%d/%m/%Y') || ' at 7:05:09' WHEN 1 THEN '23:59:00 | ' || strftime(o_orderdate, '%d/%m/%Y') ELSE '31/02/' || year(o_orderdate) || ' 01:02:03' END AS cell, o_orderdate AS d FROM orders"


@query(f"""WITH s AS ({STAMPS_SQL}) SELECT id, CASE id % 3 WHEN 0 THEN strftime(d, '%Y-%m-%d') || 'T07:05:09' WHEN 1 THEN strftime(d, '%Y-%m-%d') || 'T23:59:00' ELSE year(d) || '-02-31T01:02:03' END AS stamp,
    CAST(NULL AS VARCHAR) AS strict FROM s""")
def parse_timestamps(spark, sf_dir):
    d, key = F.col("o_orderdate"), F.col("o_orderkey") % 3
    day = F.date_format(d, "dd/MM/yyyy")
    cell = F.when(key == 0, F.concat(day, F.lit(" at 7:05:09"))).when(key == 1, F.concat(F.lit("23:59:00 | "), day)).otherwise(F.concat(F.lit("31/02/"), F.year(d).cast("string"), F.lit(" 01:02:03")))
    found = read(spark, sf_dir, "orders").withColumn("cell", cell)
    return found.select(F.col("o_orderkey").alias("id"), dates.parse_timestamp(F.col("cell")).alias("stamp"), dates.parse_stamp(F.col("cell")).alias("strict"))


# texts


@query(r"SELECT c_custkey AS id, regexp_replace('call ' || '05' || (c_custkey % 10) || '-' || lpad(((c_custkey * 7919) % 10000000)::VARCHAR, 7, '0') || ' or ' || c_name, '\b0(5\d)[\s\-.]?(\d{3})[\s\-.]?(\d{4})\b', '05X-XXXXXXX', 'g') AS masked FROM customer")
def redact_phones(spark, sf_dir):
    number = F.concat(F.lit("05"), (F.col("c_custkey") % 10).cast("string"), F.lit("-"), F.lpad(((F.col("c_custkey") * 7919) % 10_000_000).cast("string"), 7, "0"))
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), text.mask_mobiles(F.concat(F.lit("call "), number, F.lit(" or "), F.col("c_name"))).alias("masked"))


@query(r"SELECT conv_id, turn, nullif(trim(regexp_replace(text, '\b0(5\d)[\s\-.]?(\d{3})[\s\-.]?(\d{4})\b', '', 'g'), ' ,-'), '') AS note FROM conversations")
def redact_notes(spark, sf_dir):
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", text.strip_mobiles(F.col("text")).alias("note"))


@query("SELECT c_custkey AS id, trim(regexp_replace(regexp_replace(lower(c_name || ' ' || c_mktsegment), '[^a-z0-9_'' ]', ' ', 'g'), ' +', ' ', 'g')) AS canon FROM customer")
def canon_text(spark, sf_dir):
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), text.canon(F.concat("c_name", F.lit(" "), "c_mktsegment")).alias("canon"))


@query("SELECT c_custkey AS id, trim(regexp_replace(regexp_replace(lower(c_name || ' ' || c_mktsegment), '[^a-z0-9_'' ]', ' ', 'g'), '[aeiou_'']| +(?:$)', '', 'g')) AS skeleton FROM customer")
def skeleton_text(spark, sf_dir):
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), text.skeleton(F.concat("c_name", F.lit(" "), "c_mktsegment")).alias("skeleton"))


@query("SELECT o_orderkey AS id, trim(regexp_replace(replace(lower(o_orderpriority), '-', ' '), ' +', ' ', 'g')) AS fold FROM orders")
def fold_text(spark, sf_dir):
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), text.fold(F.col("o_orderpriority")).alias("fold"))


@query(r"SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace(strip_accents(lower(coalesce(text, ''))), '[׳״''\"`‘’“”]', '', 'g'), '[־‐-―-]', ' ', 'g'), '\s+', ' ', 'g'))) AS fold FROM documents")
def fold_documents(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2(text.fold(F.col("text")), 256).alias("fold"))


@query("SELECT p_partkey AS id, coalesce(array_to_string(list_filter(string_split(lower(p_name || ' hotel the bar'), ' '), lambda x: x NOT IN ('hotel', 'the', 'bar', '')), ' '), '') AS core FROM part")
def distinctive_names(spark, sf_dir):
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), text.distinctive_of(text.canon(F.concat("p_name", F.lit(" hotel the bar")))).alias("core"))


GRAMS_SQL = "list_distinct(flatten(list_transform(string_split(lower({0}), ' '), lambda w: list_transform(range(1, len(w) + 2), lambda k: substring('  ' || w || ' ', k, 3)))))"


NAMES_SQL = f"WITH RECURSIVE n AS (SELECT DISTINCT p_name FROM part), g AS (SELECT p_name AS n, {GRAMS_SQL.format('p_name')} AS g FROM n), p AS (SELECT a.n AS x, b.n AS y, a.g AS gx, b.g AS gy FROM g a JOIN g b ON a.n < b.n AND list_has_any(a.g, b.g))"


def _name_pairs(spark, sf_dir) -> DataFrame:
    """All pairs (a, b) of distinct names that have a trigram in common."""
    grams = read(spark, sf_dir, "part").select("p_name").distinct().withColumn("t", F.explode(similarity.trigrams(F.col("p_name"))))
    return grams.toDF("a", "t").join(grams.toDF("b", "t"), "t").filter("a < b").select("a", "b").distinct()


@query(f"""{NAMES_SQL} SELECT x AS a, y AS b, round(len(list_intersect(gx, gy))::DOUBLE / (len(gx) + len(gy) - len(list_intersect(gx, gy))), 6) AS similarity FROM p""")
def trigram_similarity(spark, sf_dir):
    return _name_pairs(spark, sf_dir).select("a", "b", F.round(similarity.trigram_jaccard(F.col("a"), F.col("b")), 6).alias("similarity"))


@query(f"""{NAMES_SQL}, q AS (SELECT x, y FROM p), {oracle.similarities("q")}, {oracle.word_similarities("q")}
    SELECT a.x AS a, a.y AS b, round(similarity, 6) AS word, round(indel, 6) AS indel, round(sort_score, 6) AS sort, round(set_score, 6) AS words FROM alike a JOIN near_words w ON w.x = a.x AND w.y = a.y""")
def name_matches(spark, sf_dir):
    a, b = F.col("a"), F.col("b")
    scores = {"word": similarity.name_similarity(a, b), "indel": similarity.indel_ratio(a, b), "sort": similarity.sort_ratio(a, b), "words": similarity.set_ratio(a, b)}
    return _name_pairs(spark, sf_dir).withColumns({k: F.round(v, 6) for k, v in scores.items()})


# resolution


def _pois(spark, sf_dir) -> DataFrame:
    none = F.lit(None).cast("string")
    found = places(spark, sf_dir).filter(reads.has_point())
    return found.select(
        F.col("id").cast("string").alias("poi"), F.col("name_he").alias("name"), none.alias("name_he"), none.alias("name_en"), none.alias("brand"), "city", F.col("address_he").alias("street"), none.alias("housenumber"),
        none.alias("phone"), none.alias("website"), F.col("category"), "lat", F.col("lng").alias("lon"), F.col("id").alias("ord"),
    )


MEDIANS_SQL = f"""{WITH_PLACES}, g AS (SELECT lower(regexp_replace(city, '[^A-Za-z0-9_ ]', ' ', 'g')) AS key, list_sort(list(lat)) AS a, list_sort(list(lng)) AS o, count(*) AS n FROM places WHERE lat IS NOT NULL GROUP BY 1)
    SELECT key, a[n // 2 + 1] AS lat, o[n // 2 + 1] AS lon FROM g WHERE n >= 3"""


@query(MEDIANS_SQL)
def city_medians(spark, sf_dir):
    return resolve.city_medians(_pois(spark, sf_dir))


def _localities(spark, sf_dir) -> DataFrame:
    kinds = F.array(*[F.lit(k) for k in [*resolve.SETTLEMENT_RANK, "farm"]])
    own = places(spark, sf_dir).filter(reads.has_point())
    none = F.lit(None).cast("string")
    return own.select(F.col("city").alias("name"), none.alias("name_he"), F.when(F.col("id") % 5 == 0, F.col("name_he")).alias("name_en"), F.element_at(kinds, (F.col("id") % 7 + 1).cast("int")).alias("kind"), "lat", F.col("lng").alias("lon"), F.col("id").alias("ord"))


@query(f"""{WITH_PLACES}, l AS (SELECT id, id % 7 AS rank, lat, lng, unnest([city, CASE WHEN id % 5 = 0 THEN name_he END]) AS name FROM places WHERE lat IS NOT NULL),
    k AS (SELECT *, trim(lower(regexp_replace(name, '[^A-Za-z0-9_ ]', ' ', 'g'))) AS key FROM l WHERE name IS NOT NULL),
    f AS (SELECT key, lat, lng AS lon FROM k QUALIFY row_number() OVER (PARTITION BY key ORDER BY rank, id) = 1)
    SELECT * FROM f""")
def locality_index(spark, sf_dir):
    return resolve.locality_index(_localities(spark, sf_dir), _pois(spark, sf_dir))


def _located(spark, sf_dir) -> DataFrame:
    """Every place under its name with a word more or less, in its city, against the points of interest."""
    asked = places(spark, sf_dir).select(F.col("id").alias("place"), F.when(F.col("id") % 3 == 0, F.concat("name_he", F.lit(" hotel"))).otherwise(F.col("name_he")).alias("name_he"),
        F.when(F.col("id") % 11 == 0, F.lit("nowhere")).when(F.col("id") % 4 != 0, F.col("city")).alias("city"))
    pois = _pois(spark, sf_dir)
    return resolve.locate(asked, pois, resolve.city_medians(pois))


ASKED_SQL = "SELECT id AS place, CASE WHEN id % 3 = 0 THEN name_he || ' hotel' ELSE name_he END AS name_he, CASE WHEN id % 11 = 0 THEN 'nowhere' WHEN id % 4 <> 0 THEN city END AS city FROM places"
LOCATED_SQL = oracle.located(WITH_PLACES, ASKED_SQL, "WITH " + MEDIANS_SQL.removeprefix(f"{WITH_PLACES}, "))


@query(LOCATED_SQL + " SELECT place, poi, provider_ref, name_osm, lat, lng, address_he, osm_category, match_confidence, reason FROM located")
def locate_places(spark, sf_dir):
    return _located(spark, sf_dir).drop("phone", "url")


@query(LOCATED_SQL + " SELECT coalesce(reason, 'located') AS reason, count(*) AS n FROM located GROUP BY 1")
def locate_summary(spark, sf_dir):
    return resolve.locate_summary(_located(spark, sf_dir))


def _records(spark, sf_dir) -> DataFrame:
    c, none = F.col, F.lit(None).cast("string")
    kind = F.when(c("is_chain"), "chain").when(c("is_online"), "online_only").otherwise("single_location")
    name = F.when(c("id") % 4 == 0, F.concat("name_he", F.lit("s"))).otherwise(c("name_he"))
    return places(spark, sf_dir).select(
        "id", name.alias("name_he"), none.alias("name_en"), F.when(c("id") % 2 == 0, c("city")).otherwise(F.lower("city")).alias("city"), kind.alias("kind"), "category", none.alias("phone"),
        F.when(c("id") % 6 == 0, F.concat(F.lit("http://x/"), c("id").cast("string"))).alias("url"), F.when(c("id") % 5 == 0, c("address_he")).alias("note_he"),
        F.when(c("id") % 13 == 0, "reported_not_working").otherwise("works").alias("status"), (c("id") % 10 / 10).alias("confidence"), "benefit_fighter_card", "benefit_vacation_voucher",
        F.array(F.concat(F.lit("2024-01-"), F.lpad((c("id") % 28 + 1).cast("string"), 2, "0"))).alias("reported_dates"), F.array(F.struct(c("id").alias("row"), c("name_he").alias("raw"))).alias("sources"), none.alias("alias"),
    )


RECORDS_SQL = """SELECT id, CASE WHEN id % 4 = 0 THEN name_he || 's' ELSE name_he END AS name_he, CASE WHEN id % 2 = 0 THEN city ELSE lower(city) END AS city,
    CASE WHEN is_chain THEN 'chain' WHEN is_online THEN 'online_only' ELSE 'single_location' END AS kind, category, CASE WHEN id % 6 = 0 THEN 'http://x/' || id END AS url, CASE WHEN id % 5 = 0 THEN address_he END AS note_he,
    CASE WHEN id % 13 = 0 THEN 'reported_not_working' ELSE 'works' END AS status, (id % 10)::DOUBLE / 10 AS confidence, benefit_fighter_card, benefit_vacation_voucher, '2024-01-' || lpad((id % 28 + 1)::VARCHAR, 2, '0') AS day FROM places"""
CLUSTERS_SQL = oracle.clustered(WITH_PLACES, RECORDS_SQL)
MERGED_SQL = CLUSTERS_SQL + """,
    noted AS (SELECT r.*, c.block, c.cluster_id, c.position FROM records r JOIN clusters c ON c.id = r.id),
    notes AS (SELECT block, cluster_id, string_agg(note_he, ' ' ORDER BY first_at) AS note FROM (SELECT block, cluster_id, note_he, min(position) AS first_at FROM noted WHERE note_he <> '' GROUP BY ALL) GROUP BY block, cluster_id),
    merged AS (SELECT r.block, r.cluster_id, arg_min(id, position) AS id, arg_min(name_he, position) AS name_he, CAST(NULL AS VARCHAR) AS name_en, arg_min(city, position) FILTER (city <> '') AS city, arg_min(kind, position) AS kind,
        arg_min(category, position) AS category, CAST(NULL AS VARCHAR) AS phone, arg_min(url, position) FILTER (url <> '') AS url, bool_or(benefit_fighter_card) AS benefit_fighter_card, bool_or(benefit_vacation_voucher) AS benefit_vacation_voucher,
        min(day) AS first_reported_at, max(day) AS last_reported_at, count(*)::INT AS sources, array_to_string(list_sort(list(DISTINCT name_he)), '|') AS merged_names, count(DISTINCT name_he) AS names, max(confidence) AS confidence,
        CASE WHEN bool_or(status = 'reported_not_working') THEN 'reported_not_working' ELSE 'works' END AS status, count(*)::INT AS report_count FROM noted r GROUP BY r.block, r.cluster_id)"""


@query(CLUSTERS_SQL + " SELECT id, block, cluster_id, position FROM clusters")
def dedup_clusters(spark, sf_dir):
    return resolve.cluster(_records(spark, sf_dir))


@query(MERGED_SQL + " SELECT m.* EXCLUDE (names), nullif(trim(substring(note, 1, 200), ' ,-'), '') AS note_he FROM merged m LEFT JOIN notes n ON n.block = m.block AND n.cluster_id = m.cluster_id")
def cluster_collapse(spark, sf_dir):
    records = _records(spark, sf_dir)
    out = resolve.collapse(records, resolve.cluster(records))
    return out.withColumns({"sources": F.size("sources"), "merged_names": F.array_join("merged_names", "|")})


@query(MERGED_SQL + """ SELECT 'total' AS section, 'records' AS key, count(*) AS n FROM records
    UNION ALL SELECT 'total', unnest(['clusters', 'fighter_card', 'vacation_voucher', 'both', 'several_names']), unnest([count(*), count(*) FILTER (benefit_fighter_card), count(*) FILTER (benefit_vacation_voucher),
        count(*) FILTER (benefit_fighter_card AND benefit_vacation_voucher), count(*) FILTER (names > 1)]) FROM merged
    UNION ALL SELECT 'kind', kind, count(*) FROM merged GROUP BY kind UNION ALL SELECT 'category', category, count(*) FROM merged GROUP BY category UNION ALL SELECT 'status', status, count(*) FROM merged GROUP BY status""")
def merge_report(spark, sf_dir):
    records = _records(spark, sf_dir)
    return resolve.merge_report(records, resolve.collapse(records, resolve.cluster(records)))


@query(f"{WITH_PLACES}, r AS (SELECT id % 10 / 10.0 >= 0.6 AS sure FROM places) SELECT sure, count(*) AS n FROM r GROUP BY sure")
def confidence_routing(spark, sf_dir):
    sure, rest = resolve.publishable(_records(spark, sf_dir))
    return sure.select(F.lit(True).alias("sure")).union(rest.select(F.lit(False))).groupBy("sure").agg(F.count("*").alias("n"))


# ingest

OLD = "id % 3 <> 0"


def _import(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    own = places(spark, sf_dir).withColumn("source_key", F.concat(F.lit("k"), F.col("id").cast("string"))).select("source_key", "name_he", "category", "status", "confirm_count")
    new = own.filter("cast(substring(source_key, 2) as long) % 2 = 0").withColumns({"name_he": F.upper("name_he"), "status": F.lit("published"), "confirm_count": F.lit(0)})
    return own.filter("cast(substring(source_key, 2) as long) % 3 <> 0"), new


@query(f"""{WITH_PLACES}, o AS (SELECT 'k' || id AS source_key, name_he, category, status, confirm_count FROM places WHERE {OLD}), n AS (SELECT 'k' || id AS source_key, upper(name_he) AS name_he, category FROM places WHERE id % 2 = 0)
    SELECT coalesce(o.source_key, n.source_key) AS source_key, coalesce(n.name_he, o.name_he) AS name_he, coalesce(n.category, o.category) AS category,
           CASE WHEN n.source_key IS NOT NULL THEN 'published' ELSE o.status END AS status, coalesce(o.confirm_count, 0) AS confirm_count FROM o FULL JOIN n ON o.source_key = n.source_key""")
def upsert_merge(spark, sf_dir):
    current, new = _import(spark, sf_dir)
    return ingest.upsert(current, new, defaults={"confirm_count": 0})


@query(f"""{WITH_PLACES}, b AS (SELECT name_he AS source_key, id, status, CASE status WHEN 'published' THEN 0 ELSE 1 END AS side FROM places WHERE status IN ('published', 'pending'))
    SELECT source_key, id, status FROM b QUALIFY row_number() OVER (PARTITION BY source_key ORDER BY side, id) = 1""")
def first_per_key(spark, sf_dir):
    own = places(spark, sf_dir).select(F.col("name_he").alias("source_key"), "id", "status", F.col("id").alias("ord"))
    return ingest.first_per_key(own.filter("status = 'published'"), own.filter("status = 'pending'")).select("source_key", "id", "status")


@query(f"""{WITH_PLACES}, p AS (SELECT *, id % 23 = 0 AND id % 2 = 0 AS pin_unavailable FROM places)
    SELECT id, 'published_needs_pin' AS violated FROM p WHERE status = 'published' AND NOT is_chain AND NOT is_online AND NOT pin_unavailable AND lat IS NULL
    UNION ALL SELECT id, 'has_benefit' FROM p WHERE NOT (benefit_fighter_card OR benefit_vacation_voucher)""")
def constraint_violations(spark, sf_dir):
    return ingest.violations(places(spark, sf_dir).withColumn("pin_unavailable", F.expr("id % 23 = 0 AND id % 2 = 0")), ingest.constraints())


@query(f"{WITH_PLACES} SELECT name_he, count(*) AS n FROM places GROUP BY name_he HAVING count(*) > 1")
def duplicate_names(spark, sf_dir):
    return ingest.duplicate_keys(places(spark, sf_dir), "name_he")


@query(f"{WITH_PLACES} SELECT id, CASE WHEN status = 'pending' AND lat IS NULL AND NOT is_chain AND NOT is_online THEN 'published' ELSE status END AS status FROM places")
def publish_unpinned(spark, sf_dir):
    return ingest.publish_unpinned(places(spark, sf_dir).withColumn("pin_unavailable", F.lit(False))).select("id", "status")


TOWNS_SQL = "SELECT city AS town, min(lat) AS lat, min(lng) AS lng FROM places WHERE lat IS NOT NULL AND city <> 'Brand#11' GROUP BY city"


@query(f"""{WITH_PLACES}, t AS ({TOWNS_SQL}), e AS (SELECT id, CAST(31.0 AS DOUBLE) AS lat, CAST(35.0 AS DOUBLE) AS lng FROM places WHERE id % 46 = 0),
    d AS (SELECT p.id, t.lat AS t_lat, t.lng AS t_lng, e.lat AS e_lat, e.lng AS e_lng, sha256(p.id::VARCHAR) AS h FROM places p LEFT JOIN t ON t.town = p.city LEFT JOIN e ON e.id = p.id
          WHERE status = 'published' AND p.lat IS NULL AND NOT is_chain AND NOT is_online),
    o AS (SELECT *, ('0x' || substring(h, 1, 8))::BIGINT::DOUBLE / 4294967295 * 2 * pi() AS a, sqrt(('0x' || substring(h, 9, 8))::BIGINT::DOUBLE / 4294967295) * 400.0 AS r FROM d WHERE e_lat IS NOT NULL OR t_lat IS NOT NULL)
    SELECT id, round(coalesce(e_lat, t_lat + r * cos(a) / 111320.0), 6) AS lat, round(coalesce(e_lng, t_lng + r * sin(a) / (111320.0 * cos(radians(t_lat)))), 6) AS lng,
           CASE WHEN e_lat IS NOT NULL THEN 'exact' ELSE 'town' END AS location_precision FROM o""")
def town_pins(spark, sf_dir):
    own = places(spark, sf_dir)
    towns = own.filter("lat IS NOT NULL AND city <> 'Brand#11'").groupBy(F.col("city").alias("town")).agg(F.min("lat").alias("lat"), F.min("lng").alias("lng"))
    exact = own.filter("id % 46 = 0").select("id", F.lit(31.0).alias("lat"), F.lit(35.0).alias("lng"))
    found = ingest.town_pins(own, towns, exact)
    return found.select("id", "lat", "lng", "location_precision")


@query(_near_match_sql("""SELECT a.id AS probe_id, a.lat + CASE WHEN a.id % 2 = 0 THEN 0.0001::DOUBLE ELSE 0.5::DOUBLE END AS lat, a.lng, a.name_he || ' x' AS name FROM places a WHERE lat IS NOT NULL AND provider_ref IS NULL""") + """
    SELECT p.id AS submission, CASE WHEN p.provider_ref IS NULL AND b.id IS NULL THEN 'published' ELSE 'confirmed_existing' END AS outcome, CASE WHEN p.provider_ref IS NOT NULL THEN p.id ELSE b.id END AS place
    FROM places p LEFT JOIN best b ON b.probe_id = p.id WHERE p.lat IS NOT NULL""")
def submission_outcomes(spark, sf_dir):
    own = places(spark, sf_dir).filter(reads.has_point())
    sent = own.select(F.col("id").alias("submission"), "provider_ref", F.concat("name_he", F.lit(" x")).alias("name_he"), (F.col("lat") + F.when(F.col("id") % 2 == 0, 0.0001).otherwise(0.5)).alias("lat"), "lng")
    return ingest.submission_outcomes(sent, own)


TAGS = [("amenity", "cafe"), ("shop", "shoes"), ("shop", "rare"), ("office", "government"), ("tourism", "viewpoint"), ("craft", "any"), ("highway", "bus_stop"), ("leisure", "park")]
TAG_SQL = "CASE p_partkey % 8 " + " ".join(f"WHEN {k} THEN '{{}}'" for k in range(8)) + " END"
TAGGED_SQL = f"SELECT p_partkey AS id, {TAG_SQL.format(*[k for k, _ in TAGS])} AS key, {TAG_SQL.format(*[v for _, v in TAGS])} AS value FROM part"


def _tagged(spark, sf_dir) -> DataFrame:
    pick = lambda k: F.element_at(F.array(*[F.lit(t[k]) for t in TAGS]), (F.col("p_partkey") % 8 + 1).cast("int"))
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), pick(0).alias("key"), pick(1).alias("value"), "p_name")


@query(f"WITH t AS ({TAGGED_SQL}) SELECT id, CASE key || ':' || value WHEN 'amenity:cafe' THEN 'cafe' WHEN 'shop:shoes' THEN 'shoes' WHEN 'office:government' THEN 'gov_service' ELSE 'other' END AS category FROM t")
def category_guess(spark, sf_dir):
    return _tagged(spark, sf_dir).select("id", ingest.category_of(F.col("key"), F.col("value")).alias("category"))


@query(f"WITH t AS ({TAGGED_SQL}) SELECT id, key || '=' || value AS category FROM t WHERE key IN ('shop', 'craft') OR value IN ('cafe', 'viewpoint')")
def osm_filter(spark, sf_dir):
    found = _tagged(spark, sf_dir).withColumn("category", ingest.business_tag(F.create_map("key", "value")))
    return found.filter("category IS NOT NULL").select("id", "category")


@query(f"""WITH t AS (SELECT t.id, key, value, p_name FROM ({TAGGED_SQL}) t JOIN part ON p_partkey = t.id),
    o AS (SELECT *, CASE WHEN id % 2 = 0 THEN 'node' ELSE 'way' END AS type, 31::DOUBLE + id::DOUBLE / 1000 AS a FROM t),
    c AS (SELECT *, CASE WHEN id % 2 = 0 THEN 31::DOUBLE ELSE (((0::DOUBLE + a) + (a + 0.01::DOUBLE)) + (a + 0.02::DOUBLE)) / 3 END AS y, CASE WHEN id % 2 = 0 THEN 35::DOUBLE ELSE (((0::DOUBLE + 35::DOUBLE) + (35::DOUBLE + 0.02::DOUBLE)) + (35::DOUBLE + 0.04::DOUBLE)) / 3 END AS x
          FROM o WHERE key IN ('shop', 'craft') OR value IN ('cafe', 'viewpoint')),
    f AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY p_name, round(y, 5), round(x, 5) ORDER BY type, id) = 1)
    SELECT type || '/' || id AS poi, p_name AS name, CAST(NULL AS VARCHAR) AS name_he, CAST(NULL AS VARCHAR) AS name_en, CAST(NULL AS VARCHAR) AS brand, CAST(NULL AS VARCHAR) AS city, CAST(NULL AS VARCHAR) AS street,
           CAST(NULL AS VARCHAR) AS housenumber, CAST(NULL AS VARCHAR) AS phone, CAST(NULL AS VARCHAR) AS website, key || '=' || value AS category, round(y, 6) AS lat, round(x, 6) AS lon FROM f""")
def osm_points(spark, sf_dir):
    t = _tagged(spark, sf_dir)
    at = F.array(*[F.struct((F.lit(31.0) + F.col("id") / 1000 + k / 100).alias("lat"), (F.lit(35.0) + k / 50).alias("lon")) for k in range(3)])
    node = F.col("id") % 2 == 0
    objects = t.select(
        F.when(node, "node").otherwise("way").alias("type"), "id", F.map_concat(F.create_map("key", "value"), F.create_map(F.lit("name"), F.col("p_name"))).alias("tags"),
        F.when(node, F.lit(31.0)).alias("lat"), F.when(node, F.lit(35.0)).alias("lon"), F.when(~node, at).alias("node_coords"),
    )
    return ingest.points_of_interest(objects)


# links

LINK_SQL = """SELECT p_partkey AS id, CASE p_partkey % 6
    WHEN 0 THEN 'see https://www.google.com/maps/place/Some+Shop/@31.5,35.' || (p_partkey % 90 + 10) || ',17z/data=!3m1!4b1!8m2!3d31.' || (p_partkey % 90 + 10) || '!4d35.25).'
    WHEN 1 THEN 'https://maps.app.goo.gl/x' || p_partkey WHEN 2 THEN 'https://www.google.com/maps?q=48.85,2.35' WHEN 3 THEN '31.' || (p_partkey % 90 + 10) || ', 35.1'
    WHEN 4 THEN 'https://example.com/maps?q=31.5,35.1' ELSE 'https://www.google.com/search?q=Shop+' || p_partkey || '&kgmid=/g/11abcd' END AS pasted FROM part"""


@query(f"""WITH l AS ({LINK_SQL}) SELECT id, CASE id % 6 WHEN 0 THEN 'pin' WHEN 1 THEN 'needs_expanding' WHEN 2 THEN 'outside_israel' WHEN 3 THEN 'pin' WHEN 4 THEN 'not_a_map_link' ELSE 'search_share' END AS kind,
    CASE WHEN id % 6 IN (0, 3) THEN ('31.' || (id % 90 + 10))::DOUBLE WHEN id % 6 = 2 THEN 48.85 END AS lat, CASE id % 6 WHEN 0 THEN 35.25 WHEN 3 THEN 35.1 WHEN 2 THEN 2.35 END::DOUBLE AS lng,
    CASE WHEN id % 6 = 5 THEN 'gmaps:mid/g/11abcd' END AS provider_ref, CASE id % 6 WHEN 0 THEN 'Some Shop' WHEN 5 THEN 'Shop ' || id END AS name FROM l""")
def parse_links(spark, sf_dir):
    found = spark.sql(LINK_SQL.replace("FROM part", "FROM {part}"), part=read(spark, sf_dir, "part"))
    return found.withColumn("p", links.parse_link(F.col("pasted"))).select("id", "p.kind", "p.lat", "p.lng", "p.provider_ref", "p.name")


@query("SELECT page_id, lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)) AS host FROM pages")
def url_hosts(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", links.url_host(F.col("url")).alias("host"))


# projection, layout and colour


@query(f"""{WITH_PLACES} SELECT id, round((lng - 34.228663) / (35.935383 - 34.228663) * 294.62534, 4) AS x, round((33.434207 - lat) / (33.434207 - 29.496766) * 792.60406, 4) AS y FROM places WHERE lat IS NOT NULL""")
def project_points(spark, sf_dir):
    return places(spark, sf_dir).filter(reads.has_point()).withColumn("p", geo.project(F.col("lat"), F.col("lng"))).select("id", F.round("p.x", 4).alias("x"), F.round("p.y", 4).alias("y"))


@query("""WITH v AS (SELECT l_suppkey AS page, l_quantity AS v FROM lineitem), b AS (SELECT *, CASE WHEN v - lag(v) OVER o <= 1.0 THEN 0 ELSE 1 END AS begins FROM v WINDOW o AS (PARTITION BY page ORDER BY v)),
    c AS (SELECT *, sum(begins) OVER (PARTITION BY page ORDER BY v ROWS UNBOUNDED PRECEDING) AS chain FROM b)
    SELECT page, round(avg(v), 6) AS position, count(*) AS n FROM c GROUP BY page, chain""")
def merged_positions(spark, sf_dir):
    values = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("page"), F.col("l_quantity").alias("v"))
    return layout.merged_positions(values, ["page"], "v", 1.0).select("page", F.round("position", 6).alias("position"), "n")


def _sight(kind: str | None) -> str:
    """The three channels in linear light as someone with the deficiency sees them."""
    if kind is None:
        return "r, g, b"
    clip = lambda row: f"greatest(0, least(1, 0::DOUBLE + r * {row[0]}::DOUBLE + g * {row[1]}::DOUBLE + b * {row[2]}::DOUBLE))"
    return ", ".join(f"{clip(row)} AS {c}" for row, c in zip(color.VIENOT[kind], "rgb", strict=True))


def _lab_sql(kind: str | None) -> str:
    xyz = [f"(r * {x}::DOUBLE + g * {y}::DOUBLE + b * {z}::DOUBLE) / {w}::DOUBLE" for (x, y, z), w in zip(color.TO_XYZ, color.WHITE, strict=True)]
    root = lambda t: f"CASE WHEN {t} > pow(6::DOUBLE / 29, 3) THEN pow({t}, 1::DOUBLE / 3) ELSE {t} / (3 * pow(6::DOUBLE / 29, 2)) + 4::DOUBLE / 29 END"
    return f"""SELECT id, 116 * fy - 16 AS l, 500 * (fx - fy) AS a, 200 * (fy - fz) AS b FROM (SELECT id, {root('x')} AS fx, {root('y')} AS fy, {root('z')} AS fz FROM
        (SELECT id, {xyz[0]} AS x, {xyz[1]} AS y, {xyz[2]} AS z FROM (SELECT id, {_sight(kind)} FROM light)))"""


KINDS_OF_SIGHT = {"normal": None} | {k: k for k in color.VIENOT}


@query("WITH hex AS (SELECT id, substring(md5(id::VARCHAR), 1, 6) AS h FROM (SELECT s_suppkey AS id FROM supplier UNION SELECT s_suppkey + 1 FROM supplier)),"
    " parts AS (SELECT id, ('0x' || substring(h, 1, 2))::INT::DOUBLE / 255 AS r, ('0x' || substring(h, 3, 2))::INT::DOUBLE / 255 AS g, ('0x' || substring(h, 5, 2))::INT::DOUBLE / 255 AS b FROM hex),"
    " light AS (SELECT id, " + ", ".join(f"CASE WHEN {c} <= 0.04045::DOUBLE THEN {c} / 12.92::DOUBLE ELSE pow(({c} + 0.055::DOUBLE) / 1.055::DOUBLE, 2.4::DOUBLE) END AS {c}" for c in "rgb") + " FROM parts),"
    " shine AS (SELECT id, r * 0.2126::DOUBLE + g * 0.7152::DOUBLE + b * 0.0722::DOUBLE + 0.05::DOUBLE AS y FROM light), "
    + ", ".join(f"{name}_lab AS ({_lab_sql(kind)}), {name}_two AS (SELECT p.id, p.l AS pl, p.a AS pa, p.b AS pb, q.l AS ql, q.a AS qa, q.b AS qb FROM {name}_lab p JOIN {name}_lab q ON q.id = p.id + 1)" for name, kind in KINDS_OF_SIGHT.items())
    + " SELECT s_suppkey AS id, round(greatest(u.y, v.y) / least(u.y, v.y), 6) AS contrast, " + ", ".join(f"(SELECT round({oracle.delta_e('p', 'q')}, 6) FROM {name}_two t WHERE t.id = s_suppkey) AS {name}" for name in KINDS_OF_SIGHT)
    + " FROM supplier JOIN shine u ON u.id = s_suppkey JOIN shine v ON v.id = s_suppkey + 1")
def palette_checks(spark, sf_dir):
    """The difference and the contrast of pairs of colours made from the suppliers' keys, for each kind of sight."""
    code = lambda c: F.concat(F.lit("#"), F.substring(F.md5(c.cast("string")), 1, 6))
    pairs = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), color.linear(code(F.col("s_suppkey"))).alias("a"), color.linear(code(F.col("s_suppkey") + 1)).alias("b"))
    a, b = F.col("a"), F.col("b")
    out = {"normal": F.round(color.ciede2000(color.lab(a), color.lab(b)), 6), "contrast": F.round(color.contrast(a, b), 6)}
    for kind in color.VIENOT:
        out[kind] = F.round(color.ciede2000(color.lab(color.simulate(a, kind)), color.lab(color.simulate(b, kind))), 6)
    return pairs.select("id", *[v.alias(k) for k, v in out.items()])
