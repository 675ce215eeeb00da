"""More queries over the driver's tables, with their SQL: texts beyond ASCII, links, layout, ingest, review, moderation.

Importing this module registers them with the catalogue.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from placemill.functions import color, dates, geo, text
from placemill.operators import cells, ingest, layout, links, reads, resolve, trust
from placemill.operators.settle import numbered
from placemill.plans.catalogue import CELLS_SQL, OLD, TAGS, TAGGED_SQL, TOWNS_SQL, VISIBLE_SQL, WITH_PLACES, WITH_REPORTS, _localities, _near_match_sql, _records, _rows, _tagged, MERGED_SQL, CLUSTERS_SQL, oracle, query
from placemill.plans.tables import places, read, reports


def _pick(key: Column, values: list) -> Column:
    """The value at key modulo their number."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (key % len(values) + 1).cast("int"))


def _case(key: str, values: list) -> str:
    quoted = ["NULL" if v is None else str(v) if isinstance(v, int | float) else "'" + str(v).replace("'", "''") + "'" for v in values]
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(quoted)) + " END"


def _parts(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_name", "p_brand", "p_type")


# texts: (written, canonical, skeleton, folded, fingerprint, published spelling)
SPELLINGS = [
    ("סקצ׳רס", "סקצ'רס", "skchrs", "סקצרס", "סקצ׳רס", "סקצ'רס"), ("מאניה ג׳ינס", "מאניה ג'ינס", "mnyh jyns", "מאניה גינס", "ג׳ינס מאניה", "מאניה ג'ינס"),
    ("  Café-Bar  “X” ", "café bar x", "cf br x", "cafe bar x", "bar café x", None), ("ＡＢ  c_d", "ab c_d", "b cd", "ab c_d", "ab c_d", None), ("עידו 2000", "עידו 2000", "ydv 2000", "עידו 2000", "2000 עידו", "עידן 2000"),
    ("https://X.co.il/ב", "https x co il ב", "https x c l b", "https://x.co.il/ב", "co il x ב", None), ("ﬁne Ünit–7", "fine ünit 7", "fn nt 7", "fine unit 7", "7 fine ünit", None),
]


@query("SELECT p_partkey AS id, " + ", ".join(f"{_case('p_partkey', [s[k] for s in SPELLINGS])} AS {n}" for k, n in ((1, "canon"), (2, "skeleton"), (3, "fold"), (4, "print"), (5, "alias"))) + " FROM part")
def spellings(spark, sf_dir):
    """Names in Hebrew, with vowel letters, full-width forms and ligatures."""
    own = _parts(spark, sf_dir).withColumn("w", _pick(F.col("id"), [s[0] for s in SPELLINGS]))
    w = F.col("w")
    return own.select("id", text.canon(w).alias("canon"), text.skeleton(w).alias("skeleton"), text.fold(w).alias("fold"), text.fingerprint(w).alias("print"), text.alias_of(w, F.lit(None).cast("string")).alias("alias"))


DRAWN = [(["Beer", "garden", "רב", "לש"], "של בר Beer garden"), (["םולש"], "שלום"), (["(" + "םולש" + ")"], "(" + "שלום" + ")"), (["abc", "12"], "12 abc"), (["2000ןדיע"], "עידן2000"), (["a", "b", "ג", "c"], "c ג a b")]


@query(f"SELECT p_partkey AS id, {_case('p_partkey', [d[1] for d in DRAWN])} AS said FROM part")
def reading_order(spark, sf_dir):
    """Drawn words, a sixth of the rows each, in the order in which one reads them."""
    drawn = F.element_at(F.array(*[F.array(*[F.lit(w) for w in d[0]]) for d in DRAWN]), (F.col("id") % len(DRAWN) + 1).cast("int"))
    return _parts(spark, sf_dir).select("id", text.order_run(drawn).alias("said"))


@query("SELECT p_partkey AS id, p_name || ', ' || p_brand AS text, p_partkey % 3 = 2 AS header FROM part")
def squashed_cells(spark, sf_dir):
    """Cells with stray separators, wide spaces and direction marks; and which rows are headers."""
    own = _parts(spark, sf_dir)
    cell = F.concat(F.lit(" ;‏-  "), F.regexp_replace("p_name", " ", "　 "), F.lit(", "), F.col("p_brand"), F.lit(" ;,‎ "))
    said = F.array(F.lit("תאריך דיווח"), F.when(F.col("id") % 3 == 2, "מקומות שבהם").otherwise(""), F.when(F.col("id") % 3 > 0, "x"), F.lit(""))
    return own.select("id", text.squash(cell).alias("text"), text.is_header_row(said).alias("header"))


@query("""SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 1 THEN '0501234567' WHEN 3 THEN '03-1234567' END AS phone, p_partkey % 5 IN (0, 2) AS personal,
    CASE p_partkey % 5 WHEN 0 THEN 'tel:0521234567' WHEN 1 THEN 'tel:0501234567' WHEN 2 THEN 'tel:031234567' WHEN 3 THEN 'tel:031234567' ELSE 'tel:' END AS tel,
    CASE WHEN p_partkey % 2 = 0 THEN 'https://example.com/' ELSE 'HTTP://example.com/' END || p_partkey AS url FROM part""")
def contacts(spark, sf_dir):
    """Personal phones are left out; links to call and to open."""
    own = _parts(spark, sf_dir)
    phone, kind = _pick(F.col("id"), ["052-123 4567", "0501234567", "03-1234567", "03-1234567", ""]), _pick(F.col("id"), ["unknown", "business", "personal", "business", "personal"])
    url = F.concat(_pick(F.col("id"), ["example.com/", "HTTP://example.com/"]), F.col("id").cast("string"))
    return own.select("id", text.scrub_phone(phone, kind).alias("phone"), text.is_personal_phone(phone, kind).alias("personal"), text.tel_href(phone).alias("tel"), text.external_url(url).alias("url"))


@query("""SELECT c_custkey AS id, substring(sha256('salt:' || CASE c_custkey % 3 WHEN 0 THEN '10.0.0.' || c_custkey WHEN 1 THEN '9.9.9.9' ELSE 'unknown' END), 1, 32) AS hash FROM customer""")
def forwarded_reporters(spark, sf_dir):
    key = F.col("c_custkey")
    forwarded = F.when(key % 3 == 0, F.concat(F.lit(" 10.0.0."), key.cast("string"), F.lit(" , 1.1.1.1")))
    return read(spark, sf_dir, "customer").select(key.alias("id"), text.reporter_hash("salt", text.client_address(forwarded, F.when(key % 3 == 1, "9.9.9.9"))).alias("hash"))


MONTHS = "list_value(" + ", ".join(f"'{m}'" for m in dates.HEBREW_MONTHS) + ")"


@query(f"""WITH o AS (SELECT o_orderkey AS id, o_orderdate + INTERVAL 22 HOUR AS seen, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderdate + INTERVAL 30 HOUR END AS confirmed FROM orders),
    l AS (SELECT id, coalesce(confirmed, seen) AS heard, timezone('Asia/Jerusalem', timezone('UTC', coalesce(confirmed, seen))) AS there FROM o)
    SELECT id, strftime(heard, '%Y-%m-%d %H') AS signal, day(there) || ' ב' || {MONTHS}[month(there)] || ' ' || year(there) AS shown FROM l""")
def last_signals(spark, sf_dir):
    """When a place was last heard of, and how its page says the day."""
    at = F.col("o_orderdate").cast("timestamp")
    last = dates.last_signal(F.when(F.col("o_orderkey") % 3 != 0, at + F.expr("INTERVAL 30 HOUR")), at + F.expr("INTERVAL 22 HOUR"))
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.date_format(last, "yyyy-MM-dd HH").alias("signal"), dates.display_date(last).alias("shown"))


@query("""SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') || 'T07:05:09' WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') || 'T23:59:00' END AS stamp FROM orders""")
def strict_timestamps(spark, sf_dir):
    d, key = F.col("o_orderdate"), F.col("o_orderkey") % 4
    cell = F.when(key == 0, F.concat(F.lit(" "), F.date_format(d, "d/M/yyyy"), F.lit(" 7:05:09 "))).when(key == 1, F.concat(F.date_format(d, "dd/MM/yyyy"), F.lit(" 23:59:00")))
    cell = F.coalesce(cell, F.when(key == 2, F.concat(F.lit("31/02/"), F.year(d).cast("string"), F.lit(" 01:02:03"))).otherwise("soon"))
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), dates.parse_stamp(cell).alias("stamp"))


# reads


@query(f"""{WITH_PLACES}, c AS (SELECT category, count(*) AS n FROM places GROUP BY category),
    f AS (SELECT unnest([{", ".join(f"'{c}'" for c in reads.CATEGORIES)}]) AS category, unnest(range(1, {len(reads.CATEGORIES) + 1})) AS ord) SELECT category, n, ord::INT AS ord FROM c JOIN f USING (category)""")
def category_chips(spark, sf_dir):
    return reads.category_chips(places(spark, sf_dir).groupBy("category").agg(F.count("*").alias("n")))


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 7 = 0 THEN 25000 ELSE least(200000, greatest(100, round_even(c_acctbal * 50, 0))) END::DOUBLE AS radius,
    CASE WHEN len(trim(substring(c_mktsegment, 1, (c_custkey % 4)::INT))) < 2 THEN 0 ELSE least(20, greatest(1, CASE WHEN c_custkey % 5 = 0 THEN 8 ELSE c_custkey % 40 - 5 END)) END::INT AS results FROM customer""")
def read_limits(spark, sf_dir):
    """The radius and the number of results that a request gets."""
    key = F.col("c_custkey")
    wanted = F.when(key % 5 != 0, (key % 40 - 5).cast("int"))
    return read(spark, sf_dir, "customer").select(
        key.alias("id"), reads.radius_of(F.when(key % 7 != 0, F.col("c_acctbal") * 50)).alias("radius"), reads.limit_of(wanted, F.expr("substring(c_mktsegment, 1, cast(c_custkey % 4 as int))")).alias("results")
    )


@query(f"{WITH_PLACES} SELECT id, name_he, status, confirm_count FROM places WHERE {VISIBLE_SQL}")
def public_places(spark, sf_dir):
    return reads.public_view(places(spark, sf_dir)).select("id", "name_he", "status", "confirm_count")


@query(f"{WITH_REPORTS} SELECT id, place_id, kind, created_at FROM reports WHERE false")
def public_reports(spark, sf_dir):
    return reads.public_reports(reports(spark, sf_dir))


@query(f"{WITH_PLACES} SELECT coalesce(provider_ref, 'local-' || (id - 1)) AS id, name_he, 'published' AS status, 'exact' AS location_precision, 'pdf_import' AS source, 0 AS confirm_count, lat, lng FROM places")
def fallback_rows(spark, sf_dir):
    own = places(spark, sf_dir).withColumn("ord", F.col("id") - 1).drop("id", "status")
    return reads.fallback_places(own).select("id", "name_he", "status", "location_precision", "source", "confirm_count", "lat", "lng")


@query(f"{WITH_PLACES} SELECT city, count(*) AS n FROM places GROUP BY city ORDER BY n DESC, city LIMIT 6")
def top_towns(spark, sf_dir):
    return reads.top_towns(places(spark, sf_dir))


@query(f"{WITH_PLACES} SELECT id, name_he FROM places WHERE lat IS NOT NULL ORDER BY md5('11:' || id), id LIMIT 10")
def spot_check(spark, sf_dir):
    return reads.spot_check(places(spark, sf_dir).filter(reads.has_point())).select("id", "name_he")


@query(f"""{WITH_PLACES} SELECT id, CASE WHEN status = 'reported_not_working' THEN 'dead' ELSE CASE WHEN benefit_fighter_card AND benefit_vacation_voucher THEN 'both' WHEN benefit_vacation_voucher THEN 'voucher' ELSE 'fighter' END
    || CASE WHEN source = 'user_submission' AND confirm_count <= 1 THEN '-new' ELSE '' END END AS icon FROM places""")
def icon_kinds(spark, sf_dir):
    return places(spark, sf_dir).select("id", reads.icon_kind().alias("icon"))


@query(f"""{WITH_PLACES}, t AS (SELECT *, lat IS NOT NULL AND location_precision <> 'town' AS usable, replace(replace(name_he || ' ' || address_he || ' ' || city, ' ', '%20'), '#', '%23') AS terms FROM places)
    SELECT id, 'https://www.google.com/maps/search/?api=1&query=' || CASE WHEN usable THEN lat || '%2C' || lng ELSE terms END AS google, 'https://waze.com/ul?' || CASE WHEN usable THEN 'll=' || lat || ',' || lng || '&navigate=yes' ELSE 'q=' || terms END AS waze FROM t""")
def navigation_links(spark, sf_dir):
    to = links.navigation()
    return places(spark, sf_dir).select("id", to["google"].alias("google"), to["waze"].alias("waze"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_totalprice / 10 < 950 THEN (floor(o_totalprice / 10 / 10 + 0.5) * 10)::BIGINT::VARCHAR || ' מ׳' WHEN o_totalprice / 10 < 9500 THEN printf('%.1f', o_totalprice / 10 / 1000) || ' ק״מ'
    ELSE printf('%.0f', o_totalprice / 10 / 1000) || ' ק״מ' END AS label FROM orders""")
def far_labels(spark, sf_dir):
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), geo.distance_label(F.col("o_totalprice") / 10).alias("label"))


@query(f"{WITH_PLACES} SELECT id, lat BETWEEN 29.4 AND 33.4 AND lng BETWEEN 34.2 AND 35.9 AS shown, lat BETWEEN 29.4 AND 33.45 AND lng BETWEEN 34.2 AND 35.95 AS town FROM places WHERE lat IS NOT NULL")
def inside_bounds(spark, sf_dir):
    lat, lng = F.col("lat"), F.col("lng")
    return places(spark, sf_dir).filter(reads.has_point()).select("id", geo.in_bounds(lat, lng).alias("shown"), geo.in_bounds(lat, lng, geo.TOWN_BOUNDS).alias("town"))


# links


@query("""SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN 31.8 WHEN 1 THEN 31.75 WHEN 4 THEN 31.25 END::DOUBLE AS lat, CASE p_partkey % 6 WHEN 0 THEN 35.3 WHEN 1 THEN 35.25 WHEN 4 THEN 35.5 END::DOUBLE AS lng,
    CASE WHEN p_partkey % 6 = 0 THEN p_name || '''s' END AS name FROM part""")
def listing_pages(spark, sf_dir):
    """Listings' pages: a marker, a camera that is near, one that is far, a preview of a region, one that is close, and no map at all."""
    static = "https://maps.google.com/maps/api/staticmap?center=31.25,35.5&amp;zoom="
    own = _parts(spark, sf_dir)
    marker = F.concat(F.lit('<meta content="'), F.col("p_name"), F.lit(f'&#39;s · Main 1" property="og:title"><img src="{static}17&amp;markers=color:red%7C31.8,35.3">'))
    rest = _pick(F.col("id"), ["", "APP_INITIALIZATION_STATE=[[[1200.5,35.25,31.75],", "APP_INITIALIZATION_STATE=[[[90000.5,35.25,31.75],", f'<img src="{static}9">', f'<img src="{static}16">', "<p>none</p>"])
    page = F.when(F.col("id") % 6 == 0, marker).otherwise(rest)
    return own.select("id", links.parse_page(page).alias("p")).select("id", "p.lat", "p.lng", "p.name")


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 3 < 2 THEN 31.5 END::DOUBLE AS lat, CASE WHEN p_partkey % 3 < 2 THEN 35 + (p_partkey % 10)::DOUBLE / 10 END AS lng, CASE WHEN p_partkey % 3 = 1 THEN p_type END AS address,
    p_partkey::VARCHAR AS cid, p_name AS name, CASE WHEN p_partkey % 2 = 0 THEN 'Main 1' END AS street FROM part""")
def listing_ids(spark, sf_dir):
    """A search's nested answer has the listing of exactly this id, or none; the id's second half as a number; a title's parts."""
    own, key = _parts(spark, sf_dir), F.col("id")
    feature = F.concat(F.lit("0x1:0x"), F.lower(F.hex(key)))
    deep = F.concat(F.lit(")]}'\n[[null,[0,0,0,0,0,0,0,0,0,[0,0,31.5,"), (35 + key % 10 / 10).cast("string"), F.lit("],\""), feature, F.lit("\",\"x\""), F.repeat(F.lit(",0"), 27), F.lit(",\""), F.col("p_type"), F.lit("\"]]]"))
    body = F.when(key % 3 == 1, deep).when(key % 3 == 0, F.concat(F.lit("[[[0,0,0,0,0,0,0,0,0,[0,0,31.5,"), (35 + key % 10 / 10).cast("string"), F.lit("],\""), F.upper(feature), F.lit("\"]]]"))).otherwise("[[0,[\"0x1:0x2\"]]]")
    title = F.concat(F.col("p_name"), F.when(key % 2 == 0, " · Main 1 · more").otherwise(""))
    out = own.select("id", links.listing_of(body, feature).alias("l"), links.feature_cid(feature).alias("cid"), links.title_parts(title).alias("t"))
    return out.select("id", "l.lat", "l.lng", "l.address", "cid", "t.name", F.col("t.address").alias("street"))


# outlines, grids and runs


@query("""SELECT p_partkey AS id, 2 AS outlines, round(((x + 5) * 3 + 1) / 3, 6) AS west_x, round((x + (x + 10) + (x + 10)) / 3, 6) AS first_x, p_partkey % 2 = 0 AS supported FROM (SELECT p_partkey, (p_partkey % 50)::DOUBLE AS x FROM part)""")
def outline_paths(spark, sf_dir):
    """Relative paths of two outlines, the second of which starts from where the first began."""
    own, x = _parts(spark, sf_dir), (F.col("id") % 50).cast("string")
    path = F.concat(F.lit("m "), x, F.lit(",1 10,0 0,10 z m 5,5 1,0 -1,1"), F.when(F.col("id") % 2 == 0, " z").otherwise(" z l 1,1"))
    found = own.withColumn("paths", geo.absolute_paths(F.regexp_replace(path, " l 1,1", "")))
    shift = F.transform("paths", lambda p: geo.centroid(p)["x"])
    return found.select("id", F.size("paths").alias("outlines"), F.round(shift[1], 6).alias("west_x"), F.round(shift[0], 6).alias("first_x"), geo.path_supported(path).alias("supported"))


@query("SELECT p_partkey AS id, 3 AS corners, round((p_partkey % 50)::DOUBLE - 100, 6) AS x FROM part")
def westernmost_outlines(spark, sf_dir):
    x = (F.col("id") % 50).cast("string")
    path = F.concat(F.lit("M 200,0 M "), x, F.lit(" 1 3 4 5 9 z m -100,0 0,1 0,2 z"))
    west = geo.westernmost(geo.absolute_paths(path))
    return _parts(spark, sf_dir).select("id", F.size(west).alias("corners"), F.round(geo.centroid(west)["x"], 6).alias("x"))


@query(f"{WITH_PLACES} SELECT id, round((792.60406::DOUBLE - (33.434207 - lat) / (33.434207 - 29.496766) * 792.60406) / 792.60406 * 1.9, 6) AS delay FROM places WHERE lat IS NOT NULL")
def wave_delays(spark, sf_dir):
    return places(spark, sf_dir).filter(reads.has_point()).select("id", F.round(geo.wave_delay(geo.project(F.col("lat"), F.col("lng"))["y"]), 6).alias("delay"))


DISTRICTS = [(100.0, 100.0), (120.0, 200.0), (172.0, 290.0), (90.0, 300.0), (110.0, 420.0), (130.0, 500.0), (100.0, 600.0), (120.0, 700.0)]


@query("SELECT unnest(['eight', 'absolute', 'closed', 'inside', 'judea_and_samaria', 'no_gaza']) AS \"check\", unnest([true, true, true, true, true, true]) AS ok")
def outline_contract(spark, sf_dir):
    """Eight drawn districts, as many as the smallest regions and nations allow, against the outline's contract."""
    nations = read(spark, sf_dir, "nation").filter(f"n_nationkey < {len(DISTRICTS)}")
    at = F.element_at(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in DISTRICTS]), F.col("n_nationkey") + 1)
    corner = lambda dx, dy: F.concat((at["x"] + dx).cast("string"), F.lit(","), (at["y"] + dy).cast("string"))
    return geo.outline_checks(nations.select(F.concat(F.lit("M "), corner(-9, 0), F.lit(" L "), corner(9, 0), F.lit(" L "), corner(0, 9), F.lit(" Z")).alias("d")))


@query("SELECT l_orderkey AS o, l_linenumber AS n, CASE WHEN l_quantity < 5 THEN NULL WHEN l_quantity < 20 THEN 0 WHEN l_quantity < 30 THEN 1 WHEN l_quantity < 45 THEN 2 END::INT AS slot FROM lineitem")
def bucketed(spark, sf_dir):
    edges = F.array(*[F.lit(float(x)) for x in (5, 20, 30, 45)])
    return read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), layout.bucket(F.col("l_quantity"), edges).alias("slot"))


GRID_SQL = """WITH v AS (SELECT DISTINCT l_suppkey AS page, l_linenumber * 100 AS position FROM lineitem), w AS (SELECT s_suppkey AS page, CASE WHEN s_suppkey % 3 = 0 THEN 400 ELSE 700 END AS width FROM supplier),
    i AS (SELECT page, position::DOUBLE AS position, row_number() OVER (PARTITION BY page ORDER BY position) AS n, count(*) OVER (PARTITION BY page) AS m FROM v JOIN w USING (page) WHERE position < width - 40),
    c AS (SELECT page, position AS low, lead(position) OVER (PARTITION BY page ORDER BY position) AS high, row_number() OVER (PARTITION BY page ORDER BY position) - 1 AS slot FROM i WHERE n <= 5 AND m > 4),
    h AS (SELECT DISTINCT l_suppkey AS page, l_quantity AS position FROM lineitem WHERE l_suppkey % 2 = 0), b AS (SELECT DISTINCT l_suppkey AS page, l_quantity AS position FROM lineitem),
    r AS (SELECT page, position FROM h QUALIFY count(*) OVER (PARTITION BY page) >= 3),
    d AS (SELECT page, position, lead(position) OVER (PARTITION BY page ORDER BY position) AS next, lag(position) OVER (PARTITION BY page ORDER BY position) IS NULL AS first FROM b WHERE page NOT IN (SELECT page FROM r)),
    e AS (SELECT * FROM r UNION ALL SELECT page, position - 6 FROM d WHERE first UNION ALL SELECT page, CASE WHEN next IS NULL THEN position + 12 ELSE (position + next) / 2 END FROM d),
    s AS (SELECT page, position AS low, lead(position) OVER (PARTITION BY page ORDER BY position) AS high, row_number() OVER (PARTITION BY page ORDER BY position) - 1 AS slot FROM e)"""


@query(f"{GRID_SQL} SELECT page, 'column' AS side, slot, low, high FROM c WHERE high IS NOT NULL UNION ALL SELECT page, 'row', slot, low, high FROM s WHERE high IS NOT NULL")
def page_grids(spark, sf_dir):
    """Columns between ruled lines where there are five before the margin; rows between ruled lines, or midway between lines of text."""
    lines = read(spark, sf_dir, "lineitem").withColumnRenamed("l_suppkey", "page")
    widths = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("page"), F.when(F.col("s_suppkey") % 3 == 0, 400).otherwise(700).alias("width"))
    columns = layout.column_bounds(lines.select("page", (F.col("l_linenumber") * 100.0).alias("position")).distinct(), widths)
    baselines = lines.select("page", F.col("l_quantity").alias("position")).distinct()
    rows = layout.row_bounds(baselines.filter("page % 2 = 0"), baselines)
    order = ["page", "side", F.col("slot").cast("long").alias("slot"), "low", "high"]
    return columns.withColumn("side", F.lit("column")).select(*order).unionByName(rows.withColumn("side", F.lit("row")).select(*order))


CHARS_SQL = """SELECT l_suppkey AS page, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_quantity, l_extendedprice) AS seq, CASE WHEN l_linenumber % 3 = 0 THEN ' ' ELSE chr((97 + l_orderkey % 26)::INT) END AS text,
    l_quantity + l_linenumber AS x0, l_quantity + l_linenumber + CASE WHEN l_linenumber % 2 = 0 THEN 1 ELSE 3 END AS x1, (l_orderkey % 3)::DOUBLE AS top, (l_orderkey % 3 + 1)::DOUBLE AS bottom FROM lineitem"""


@query(f"""WITH RECURSIVE c AS ({CHARS_SQL}),
    w AS (SELECT page, seq, text, x0, bottom, 1 AS run, top, x1, true AS begins FROM c WHERE seq = 1
        UNION ALL SELECT c.page, c.seq, c.text, c.x0, c.bottom, CASE WHEN on_ THEN w.run ELSE w.run + 1 END, CASE WHEN on_ THEN w.top ELSE c.top END, CASE WHEN on_ THEN greatest(w.x1, c.x1) ELSE c.x1 END, NOT on_
        FROM (SELECT w.*, abs(c.x0 - w.x1) <= 0.6 AND abs(c.top - w.top) <= 1.2 AS on_ FROM w JOIN c ON c.page = w.page AND c.seq = w.seq + 1) w JOIN c ON c.page = w.page AND c.seq = w.seq + 1),
    r AS (SELECT page, run, string_agg(text, '' ORDER BY seq) AS drawn, arg_min(x0, seq) AS x0, max(x1) AS x1, arg_min(top, seq) AS top, max(bottom) AS bottom FROM w GROUP BY page, run)
    SELECT page, run, trim(regexp_replace(drawn, ' +', ' ', 'g')) AS text, x0, x1, top, bottom FROM r WHERE trim(drawn) <> ''""")
def drawn_runs(spark, sf_dir):
    """Characters made from the order lines, as runs."""
    key, line = F.col("l_orderkey"), F.col("l_linenumber")
    x0 = F.col("l_quantity") + line
    chars = read(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("page"), F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")).alias("seq"), F.when(line % 3 == 0, " ").otherwise(F.char(97 + key % 26)).alias("text"),
        x0.alias("x0"), (x0 + F.when(line % 2 == 0, 1).otherwise(3)).alias("x1"), (key % 3).cast("double").alias("top"), (key % 3 + 1).cast("double").alias("bottom"),
    )
    return layout.runs(chars)


@query("""WITH f AS (SELECT l_suppkey AS page, l_orderkey AS run, l_linenumber AS n, l_quantity AS x0, l_quantity + 2 AS x1, l_linenumber::DOUBLE AS top FROM lineitem),
    g AS (SELECT page, CASE WHEN x0 + 1 < 10 THEN NULL WHEN x0 + 1 < 30 THEN 0 WHEN x0 + 1 < 50 THEN 1 END AS "column", CASE WHEN top + 0.5 < 1 THEN NULL WHEN top + 0.5 < 4 THEN 0 WHEN top + 0.5 < 7 THEN 1 END AS "row", 'w' || run AS text, top, x1 FROM f)
    SELECT page, "row"::BIGINT AS "row", "column"::BIGINT AS "column", string_agg(text, ' ' ORDER BY top, -x1, text) AS text FROM g WHERE "row" IS NOT NULL AND "column" IS NOT NULL GROUP BY page, "row", "column\"""")
def page_cells(spark, sf_dir):
    """Runs in the cells of a grid: lines from the top, each from the right."""
    lines = read(spark, sf_dir, "lineitem").withColumnRenamed("l_suppkey", "page")
    found = lines.select("page", F.concat(F.lit("w"), F.col("l_orderkey").cast("string")).alias("text"), F.col("l_quantity").alias("x0"), (F.col("l_quantity") + 2).alias("x1"), F.col("l_linenumber").cast("double").alias("top"), (F.col("l_linenumber") + 1.0).alias("bottom"))
    grid = lambda edges: lines.select("page").distinct().select("page", F.inline(F.array(*[F.struct(F.lit(k).cast("long").alias("slot"), F.lit(a).alias("low"), F.lit(b).alias("high")) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))])))
    return layout.cells(found, grid([1.0, 4.0, 7.0]), grid([10.0, 30.0, 50.0])).select("page", F.col("row").cast("long").alias("row"), F.col("column").cast("long").alias("column"), "text")


# ingest


@query(f"""{WITH_PLACES}, r AS (SELECT *, CASE WHEN id % 8 = 0 THEN 'not_located' WHEN id % 8 = 1 THEN '' END AS why FROM places)
    SELECT coalesce(provider_ref, CASE WHEN is_chain THEN 'chain' WHEN is_online THEN 'online' ELSE 'unlocated' END || ':' || lower(name_he) || '@' || lower(city)) AS source_key, name_he, is_chain,
           CASE WHEN NOT is_chain AND NOT is_online AND lat IS NOT NULL THEN 'SRID=4326;POINT(' || lng || ' ' || lat || ')' END AS location, CASE WHEN NOT is_chain AND NOT is_online THEN lat END AS lat,
           'pending' AS status, coalesce(nullif(why, ''), 'low_confidence') AS review_reason FROM r""")
def import_rows(spark, sf_dir):
    """Rows of an import with their keys and points, and the points read back."""
    none = F.lit(None).cast("string")
    own = places(spark, sf_dir).withColumns({"phone": none, "url": none, "note_he": none, "first_reported_at": none, "review_reason": F.when(F.col("id") % 8 == 0, "not_located").when(F.col("id") % 8 == 1, "")})
    return ingest.to_rows(own, "pending").withColumn("lat", ingest.parse_point(F.col("location"))["lat"]).select("source_key", "name_he", "is_chain", "location", "lat", "status", "review_reason")


@query(f"""{WITH_PLACES}, r AS (SELECT id, status, lat IS NULL AND status = 'published' AND NOT is_chain AND NOT is_online AS bad, CASE WHEN id % 2 = 0 THEN 'old' END AS why FROM places)
    SELECT id, CASE WHEN bad THEN 'pending' ELSE status END AS status, CASE WHEN bad THEN coalesce(why, 'not_geocoded') ELSE why END AS review_reason FROM r""")
def demoted_rows(spark, sf_dir):
    own = places(spark, sf_dir).withColumns({"location": F.when(F.col("lat").isNotNull(), "x"), "review_reason": F.when(F.col("id") % 2 == 0, "old")})
    return ingest.demoted(own).select("id", "status", "review_reason")


HIT_TYPES = ["N", "way", "relation", "x", None]


@query(f"""WITH t AS ({TAGGED_SQL}), h AS (SELECT id, key, value, {_case('id', HIT_TYPES)} AS type FROM t)
    SELECT id, 'osm:' || CASE type WHEN 'N' THEN 'node' ELSE type END || '/' || id AS provider_ref, CASE key || ':' || value WHEN 'amenity:cafe' THEN 'cafe' WHEN 'shop:shoes' THEN 'shoes' WHEN 'office:government' THEN 'gov_service' ELSE 'other' END AS category
    FROM h WHERE type IN ('N', 'way', 'relation') AND key <> 'highway' AND id % 11 <> 0""")
def remote_candidates(spark, sf_dir):
    """A geocoder's complete hits that can be businesses."""
    hits = _tagged(spark, sf_dir).select("id", F.col("id").alias("object_id"), _pick(F.col("id"), HIT_TYPES).alias("object_type"), F.when(F.col("id") % 11 != 0, F.col("p_name")).alias("name"), "key", "value", F.lit(31.5).alias("lat"), F.lit(35.0).alias("lng"))
    return ingest.remote_candidates(hits).select("id", "provider_ref", "category")


TOWN_HITS = ["place", "shop", "boundary", "landuse", "amenity"]


@query(f"""WITH h AS (SELECT p_brand AS town, p_partkey AS hit, p_size % 2 AS phase, {_case('p_partkey', TOWN_HITS)} AS category, 29 + (p_partkey % 60)::DOUBLE / 10 AS lat, 34.5::DOUBLE + (p_partkey % 13)::DOUBLE / 7 AS lng, p_name AS matched FROM part)
    SELECT town, round(lat, 6) AS lat, round(lng, 6) AS lng, matched FROM h WHERE lat BETWEEN 29.4::DOUBLE AND 33.45::DOUBLE AND lng BETWEEN 34.2::DOUBLE AND 35.95::DOUBLE AND category IN ('place', 'boundary', 'landuse')
    QUALIFY row_number() OVER (PARTITION BY town ORDER BY phase, hit) = 1""")
def resolved_towns(spark, sf_dir):
    """The first hit of each town that is a settlement inside the bounds, the structured search's before the free one's."""
    key = F.col("p_partkey")
    hits = read(spark, sf_dir, "part").select(F.col("p_brand").alias("town"), key.alias("hit"), (F.col("p_size") % 2).alias("phase"), _pick(key, TOWN_HITS).alias("category"), (29 + key % 60 / 10).alias("lat"), (34.5 + key % 13 / 7).alias("lng"), F.col("p_name").alias("matched"))
    return ingest.resolved_towns(hits)


@query(f"{WITH_PLACES} SELECT id, CASE WHEN lat IS NOT NULL OR is_online THEN 'published' ELSE 'pending' END AS status, CASE WHEN lat IS NULL AND NOT is_online THEN 'not_geocoded' END AS review_reason, 'user_submission' AS source FROM places")
def seeded_rows(spark, sf_dir):
    return ingest.seed_rows(places(spark, sf_dir)).select("id", "status", "review_reason", "source")


SETTLED = ["city", "hamlet", "farm", "suburb", None]


@query(f"""WITH o AS (SELECT p_partkey AS id, p_name, {_case('p_partkey', SETTLED)} AS kind, CASE WHEN p_partkey % 7 = 0 THEN 'way' ELSE 'node' END AS type FROM part)
    SELECT p_name AS name, CASE WHEN id % 2 = 0 THEN 'He ' || id END AS name_he, kind, round(31 + id::DOUBLE / 1000, 6) AS lat, id AS ord FROM o WHERE kind IN ('city', 'hamlet', 'suburb') AND type = 'node' AND id % 13 <> 0""")
def settlements(spark, sf_dir):
    """Named settlements among map objects: nodes of the kinds that are towns."""
    own, key = _parts(spark, sf_dir), F.col("id")
    tags = F.map_filter(F.create_map(F.lit("place"), _pick(key, SETTLED), F.lit("name"), F.when(key % 13 != 0, F.col("p_name")), F.lit("name:he"), F.when(key % 2 == 0, F.concat(F.lit("He "), key.cast("string")))), lambda k, v: v.isNotNull())
    objects = own.select("id", F.when(key % 7 == 0, "way").otherwise("node").alias("type"), tags.alias("tags"), (31 + key / 1000).alias("lat"), F.lit(35.0).alias("lon"))
    return ingest.localities(objects).select("name", "name_he", "kind", "lat", "ord")


@query("""SELECT p_partkey AS id, list_filter([CASE WHEN p_partkey % 5 = 0 THEN 'name' END, CASE WHEN p_partkey % 3 = 0 THEN 'bounds' END, CASE WHEN p_partkey % 7 = 0 THEN 'category' END, CASE WHEN p_partkey % 4 = 0 THEN 'benefit' END,
    CASE WHEN p_partkey % 6 = 0 THEN 'note' END, CASE WHEN p_partkey % 9 = 0 THEN 'provider_ref' END], lambda x: x IS NOT NULL)::VARCHAR AS failed FROM part""")
def submission_checks(spark, sf_dir):
    """What is wrong with submissions."""
    key = F.col("id")
    sent = _parts(spark, sf_dir).select(
        "id", F.when(key % 5 == 0, "  ").otherwise(F.col("p_name")).alias("name_he"), F.when(key % 3 == 0, 45.0).otherwise(31.5).alias("lat"), F.lit(35.0).alias("lng"), F.col("p_type").alias("address_he"), F.col("p_brand").alias("city"),
        F.when(key % 7 == 0, "bank").otherwise("cafe").alias("category"), F.lit(False).alias("benefit_fighter_card"), (key % 4 != 0).alias("benefit_vacation_voucher"), F.when(key % 6 == 0, F.repeat(F.lit("x"), 201)).alias("note_he"),
        F.when(key % 9 == 0, "osm:area/1").when(key % 2 == 0, F.concat(F.lit("osm:node/"), key.cast("string"))).alias("provider_ref"),
    )
    return _failed(sent, ingest.submission_errors(), ["name", "bounds", "category", "benefit", "note", "provider_ref"])


def _failed(rows: DataFrame, checks: dict, names: list[str]) -> DataFrame:
    listed = F.filter(F.array(*[F.when(~F.coalesce(checks[n], F.lit(True)), F.lit(n)) for n in names]), lambda x: x.isNotNull())
    return rows.select("id", F.concat(F.lit("["), F.array_join(listed, ", "), F.lit("]")).alias("failed"))


@query("""SELECT event_id AS id, list_filter([CASE WHEN event_id % 3 = 0 THEN 'place' END, CASE WHEN event_type NOT IN ('click', 'view') THEN 'kind' END, CASE WHEN event_id % 5 = 0 THEN 'note' END], lambda x: x IS NOT NULL)::VARCHAR AS failed FROM events""")
def report_checks(spark, sf_dir):
    key = F.col("event_id")
    uuid = F.concat(F.lpad(F.hex(key), 8, "0"), F.when(key % 3 == 0, "-0000-0000-0000").otherwise("-0000-4000-8000-0123456789aB"))
    kind = F.when(F.col("event_type") == "click", "confirm").when(F.col("event_type") == "view", "not_working").otherwise(F.col("event_type"))
    sent = read(spark, sf_dir, "events").select(key.alias("id"), uuid.alias("place_id"), kind.alias("kind"), F.when(key % 5 == 0, F.repeat(F.lit("x"), 201)).otherwise("fine").alias("note"))
    return _failed(sent, ingest.report_errors(), ["place", "kind", "note"])


@query(f"""{WITH_REPORTS}, r AS (SELECT id, CASE WHEN id % 7 = 0 THEN 'rumour' ELSE kind END AS kind, CASE id % 3 WHEN 0 THEN 'fighter_card' WHEN 1 THEN 'other' END AS benefit_type, id % 11 = 0 AS long FROM reports)
    SELECT id, 'kind' AS violated FROM r WHERE kind = 'rumour' UNION ALL SELECT id, 'benefit_type' FROM r WHERE benefit_type = 'other' UNION ALL SELECT id, 'note' FROM r WHERE long""")
def report_violations(spark, sf_dir):
    key = F.col("id")
    own = reports(spark, sf_dir).withColumns({"kind": F.when(key % 7 == 0, "rumour").otherwise(F.col("kind")), "benefit_type": F.when(key % 3 == 0, "fighter_card").when(key % 3 == 1, "other"), "note": F.when(key % 11 == 0, F.repeat(F.lit("n"), 201)).otherwise("n")})
    return ingest.violations(own, ingest.report_constraints())


@query(f"{WITH_PLACES}, f AS (SELECT id, CASE WHEN id % 5 = 0 THEN '' WHEN id % 5 = 1 THEN NULL ELSE 'k' || id END AS source_key, name_he FROM places), p AS (SELECT DISTINCT CASE WHEN id % 4 = 0 THEN name_he ELSE 'k' || id END AS key FROM places WHERE id % 3 = 0)"
       " SELECT id FROM f WHERE coalesce(nullif(source_key, ''), name_he) NOT IN (SELECT key FROM p)")  # fmt: skip
def not_among_places(spark, sf_dir):
    key = F.concat(F.lit("k"), F.col("id").cast("string"))
    own = places(spark, sf_dir)
    found = own.select("id", F.when(F.col("id") % 5 == 0, "").when(F.col("id") % 5 != 1, key).alias("source_key"), "name_he")
    return ingest.not_among(found, own.filter("id % 3 = 0").select(F.when(F.col("id") % 4 != 0, key).alias("source_key"), "name_he")).select("id")


def _sent(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Submissions near every second place that has a point, far from the others, with other benefits."""
    own = places(spark, sf_dir)
    at = own.filter(reads.has_point())
    sent = at.select(F.col("id").alias("submission"), "provider_ref", F.concat("name_he", F.lit(" x")).alias("name_he"), (F.col("lat") + F.when(F.col("id") % 2 == 0, 0.0001).otherwise(0.5)).alias("lat"), "lng", "category",
        (F.col("id") % 3 == 0).alias("benefit_fighter_card"), (F.col("id") % 4 < 2).alias("benefit_vacation_voucher"), F.when(F.col("id") % 6 == 0, "note").alias("note_he"))
    return sent, own


EFFECTS_SQL = _near_match_sql("SELECT a.id AS probe_id, a.lat + CASE WHEN a.id % 2 = 0 THEN 0.0001::DOUBLE ELSE 0.5::DOUBLE END AS lat, a.lng, a.name_he || ' x' AS name FROM places a WHERE lat IS NOT NULL AND provider_ref IS NULL") + """,
    sent AS (SELECT p.id AS submission, CASE WHEN p.provider_ref IS NOT NULL THEN p.id ELSE b.id END AS place, p.id % 3 = 0 AS f, p.id % 4 < 2 AS v, CASE WHEN p.id % 6 = 0 THEN 'note' END AS note FROM places p LEFT JOIN best b ON b.probe_id = p.id WHERE p.lat IS NOT NULL)"""


@query(EFFECTS_SQL + """, w AS (SELECT place, bool_or(f) AS f, bool_or(v) AS v FROM sent WHERE place IS NOT NULL GROUP BY place)
    SELECT id, benefit_fighter_card OR f AS benefit_fighter_card, benefit_vacation_voucher OR v AS benefit_vacation_voucher FROM places JOIN w ON place = id WHERE f AND NOT benefit_fighter_card OR v AND NOT benefit_vacation_voucher""")
def widened_benefits(spark, sf_dir):
    return ingest.submission_effects(*_sent(spark, sf_dir))[0]


@query(EFFECTS_SQL + " SELECT submission, place AS place_id, CASE WHEN place IS NULL THEN 'new_submission' ELSE 'confirm' END AS kind, CASE WHEN f THEN 'fighter_card' ELSE 'vacation_voucher' END AS benefit_type, note FROM sent")
def submitted_reports(spark, sf_dir):
    return ingest.submission_effects(*_sent(spark, sf_dir))[1]


@query(EFFECTS_SQL + " SELECT submission, p.name_he || ' x' AS name_he, category, f AS benefit_fighter_card, 'published' AS status, 'user_submission' AS source FROM sent JOIN places p ON p.id = submission WHERE place IS NULL")
def submitted_places(spark, sf_dir):
    return ingest.submission_effects(*_sent(spark, sf_dir))[2].select("submission", "name_he", "category", "benefit_fighter_card", "status", "source")


def _towns(spark, sf_dir) -> DataFrame:
    return places(spark, sf_dir).filter("lat IS NOT NULL AND city <> 'Brand#11'").groupBy(F.col("city").alias("town")).agg(F.min("lat").alias("lat"), F.min("lng").alias("lng")).filter("lat > 29.42 AND lng > 34.22")


@query(f"""{WITH_PLACES}, t AS (SELECT * FROM ({TOWNS_SQL}) WHERE lat > 29.42 AND lng > 34.22) SELECT city, count(*) AS n FROM places WHERE status = 'published' AND lat IS NULL AND NOT is_chain AND NOT is_online AND city NOT IN (SELECT town FROM t) GROUP BY city""")
def unresolved_towns(spark, sf_dir):
    return ingest.unresolved_towns(places(spark, sf_dir), _towns(spark, sf_dir))


@query(f"""{WITH_PLACES}, t AS (SELECT * FROM ({TOWNS_SQL}) WHERE lat > 29.42 AND lng > 34.22), d AS (SELECT p.*, t.town IS NOT NULL AND status = 'published' AND p.lat IS NULL AND NOT is_chain AND NOT is_online AS pinned FROM places p LEFT JOIN t ON t.town = p.city)
    SELECT id, lat IS NOT NULL OR pinned AS has_point, CASE WHEN pinned THEN 'town' ELSE location_precision END AS location_precision, lat IS NULL AND NOT pinned AS pin_unavailable FROM d""")
def pinned_places(spark, sf_dir):
    """Places with the points of their towns, and which still have none."""
    own = places(spark, sf_dir).withColumn("pin_unavailable", F.col("lat").isNull())
    found = ingest.with_pins(own, ingest.town_pins(own, _towns(spark, sf_dir)))
    return found.select("id", reads.has_point().alias("has_point"), "location_precision", "pin_unavailable")


# records, cache and review


def _answers(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Texts of the sheet with where they stand, and what was read in each: the business and its brand."""
    found = cells.occurrences(_rows(spark, sf_dir))
    place = lambda name, kind: F.struct(
        name.alias("name_he"), F.lit(None).cast("string").alias("name_en"), F.lit("x").alias("city_hint"), F.lit(kind).alias("kind"), F.lit("cafe").alias("category"), F.when(F.length("text") % 2 == 0, "050-1234567").otherwise("03-1234567").alias("phone"),
        F.lit("unknown").alias("phone_kind"), F.lit(None).cast("string").alias("url"), F.lit("").alias("note_he"), F.lit("works").alias("status"), F.lit(0.9).alias("confidence"))
    return found, found.select("text", F.array(place(F.element_at(F.split("text", " "), 1), "chain"), place(F.reverse("text"), "single_location")).alias("places"))


@query(f"""{CELLS_SQL}, o AS (SELECT text, count(*) AS n, bool_or(field = 'fighter_card') AS f, bool_or(field = 'vacation_voucher') AS v, count(reported_at) AS dates FROM c GROUP BY text),
    b AS (SELECT *, unnest([string_split(text, ' ')[1], reverse(text)]) AS name_he, unnest(['chain', 'single_location']) AS kind FROM o)
    SELECT name_he, kind, kind = 'chain' AS is_chain, CASE WHEN len(text) % 2 = 1 THEN '03-1234567' END AS phone, len(text) % 2 = 0 AS phone_redacted, f AS benefit_fighter_card, v AS benefit_vacation_voucher, n::INT AS n_sources, dates::INT AS n_dates FROM b""")
def built_records(spark, sf_dir):
    found = resolve.build_records(*_answers(spark, sf_dir))
    return found.select("name_he", "kind", "is_chain", "phone", "phone_redacted", "benefit_fighter_card", "benefit_vacation_voucher", F.size("sources").alias("n_sources"), F.size("reported_dates").alias("n_dates"))


def _cache(spark, sf_dir) -> DataFrame:
    """Answers to the texts of every fourth row."""
    own = cells.cells(_rows(spark, sf_dir).filter("row % 4 = 0")).select("text").distinct()
    return own.select(text.cache_key("v1", "m", F.col("text")).alias("cache_key"), F.length("text").alias("places"))


@query(f"{CELLS_SQL} SELECT DISTINCT text FROM c WHERE text NOT IN (SELECT text FROM c WHERE row % 4 = 0)")
def cache_misses(spark, sf_dir):
    return cells.missing_from_cache(cells.occurrences(_rows(spark, sf_dir)), _cache(spark, sf_dir), "v1", "m").select("text")


@query(f"{CELLS_SQL} SELECT DISTINCT text, len(text)::INT AS places FROM c WHERE text IN (SELECT text FROM c WHERE row % 4 = 0)")
def cache_hits(spark, sf_dir):
    return cells.from_cache(cells.occurrences(_rows(spark, sf_dir)), _cache(spark, sf_dir), "v1", "m").select("text", "places")


REASONS = ["no_osm_match", "low_confidence", "city_unresolved", None, "not_geocoded"]


def _review(spark, sf_dir) -> DataFrame:
    own = places(spark, sf_dir)
    return own.select("id", _pick(F.col("id"), REASONS).alias("review_reason"), F.when(F.col("is_chain"), "chain").otherwise("single_location").alias("kind"))


@query(f"{WITH_PLACES} SELECT id, {_case('id', REASONS)} AS review_reason FROM places WHERE id % 5 IN (0, 4) AND NOT is_chain")
def retryable_review(spark, sf_dir):
    return resolve.retryable(_review(spark, sf_dir)).select("id", "review_reason")


@query(f"{WITH_PLACES} SELECT id, {_case('id', REASONS)} AS review_reason FROM places WHERE id % 5 IN (1, 3) UNION ALL SELECT id, 'not_located' FROM places WHERE id % 10 = 0")
def refreshed_review(spark, sf_dir):
    new = places(spark, sf_dir).filter("id % 10 = 0").select("id", F.lit("not_located").alias("review_reason"))
    return resolve.refreshed_review(_review(spark, sf_dir), new).select("id", "review_reason")


@query(f"{MERGED_SQL} SELECT id, row_number() OVER (ORDER BY kind, name_he, id) AS place FROM merged")
def published_order(spark, sf_dir):
    """Merged records in the order in which they are written."""
    return numbered(resolve.published_order(_merged(spark, sf_dir))).select("id", "place")


@query(f"{MERGED_SQL} SELECT id, row_number() OVER (ORDER BY confidence, id) AS place FROM merged")
def review_order(spark, sf_dir):
    return numbered(resolve.review_order(_merged(spark, sf_dir))).select("id", "place")


def _merged(spark, sf_dir) -> DataFrame:
    records = _records(spark, sf_dir)
    return resolve.collapse(records, resolve.cluster(records))


# moderation


def _acts(spark, sf_dir) -> DataFrame:
    """Clicks are acts of moderators on the places that reports are about."""
    n = places(spark, sf_dir).count()
    acts = ["approve", "restore", "reject", "locate", "edit"]
    own = read(spark, sf_dir, "events").filter("event_type = 'click'")
    key = F.col("event_id")
    return own.select(
        key.alias("id"), ((key * 31 + F.col("user_id")) % n).alias("place_id"), _pick(key, acts).alias("action"), F.col("ts").cast("timestamp_ntz").alias("created_at"), F.when(key % 2 == 0, F.concat(F.lit("New "), key.cast("string"))).alias("name_he"),
        F.when(key % 3 == 0, F.concat(F.lit("Town "), key.cast("string"))).alias("city"), (31 + key % 100 / 100).alias("lat"), F.lit(35.0).alias("lng"), F.concat(F.lit("osm:node/"), key.cast("string")).alias("provider_ref"), F.lit(None).cast("string").alias("address_he"),
    )


ACTS_SQL = """SELECT event_id AS id, (event_id * 31 + user_id) % (SELECT count(*) FROM part) AS place_id, CASE event_id % 5 WHEN 0 THEN 'approve' WHEN 1 THEN 'restore' WHEN 2 THEN 'reject' WHEN 3 THEN 'locate' ELSE 'edit' END AS action, ts AS created_at,
    CASE WHEN event_id % 2 = 0 THEN 'New ' || event_id END AS name_he, CASE WHEN event_id % 3 = 0 THEN 'Town ' || event_id END AS city, 31 + (event_id % 100)::DOUBLE / 100 AS lat, 'osm:node/' || event_id AS provider_ref FROM events WHERE event_type = 'click'"""


@query(f"""{WITH_REPORTS.replace("WITH places", "WITH RECURSIVE places", 1)}, acts AS ({ACTS_SQL}),
    e AS (SELECT place_id, created_at, id, kind, reporter FROM reports UNION ALL SELECT place_id, created_at, id, action, NULL FROM acts),
    n AS (SELECT *, row_number() OVER (PARTITION BY place_id ORDER BY created_at, id, kind) AS k FROM e),
    w AS (SELECT id, source, status, confirm_count AS confirms, report_count AS reports, []::VARCHAR[] AS vouchers, []::STRUCT(who VARCHAR, at_time TIMESTAMP)[] AS failed, 0::BIGINT AS k FROM places
        UNION ALL SELECT id, source,
            CASE WHEN kind IN ('confirm', 'new_submission') THEN CASE WHEN status = 'pending' AND len(more) >= 2 THEN 'published' ELSE status END
                 WHEN kind = 'not_working' THEN CASE WHEN status = 'published' AND recent >= CASE WHEN source = 'user_submission' AND confirms <= 1 THEN 1 ELSE 3 END THEN 'reported_not_working' ELSE status END
                 WHEN kind IN ('approve', 'locate', 'restore') THEN 'published' WHEN kind = 'reject' THEN 'rejected' ELSE status END,
            CASE WHEN kind IN ('confirm', 'new_submission') THEN len(more)::INT ELSE confirms END, CASE WHEN kind = 'not_working' THEN recent::INT WHEN kind = 'restore' THEN 0 ELSE reports END,
            CASE WHEN kind IN ('confirm', 'new_submission') THEN more ELSE vouchers END, CASE WHEN kind = 'not_working' THEN down WHEN kind = 'restore' THEN []::STRUCT(who VARCHAR, at_time TIMESTAMP)[] ELSE failed END, k
        FROM (SELECT *, len(list_distinct(list_transform(list_filter(down, lambda f: f.at_time > created_at - INTERVAL 7 DAY), lambda f: f.who))) AS recent FROM
            (SELECT w.id, w.source, w.status, w.confirms, w.reports, w.vouchers, w.failed, n.k, n.kind, n.created_at, CASE WHEN list_contains(w.vouchers, n.reporter) THEN w.vouchers ELSE list_append(w.vouchers, n.reporter) END AS more,
                list_append(w.failed, struct_pack(who := n.reporter, at_time := n.created_at::TIMESTAMP)) AS down FROM w JOIN n ON n.place_id = w.id AND n.k = w.k + 1)))
    SELECT id, status, confirms AS confirm_count, reports AS report_count FROM w QUALIFY row_number() OVER (PARTITION BY id ORDER BY k DESC) = 1""")
def moderated_trust(spark, sf_dir):
    """Trust states where moderators approve, reject, restore and locate among the reports."""
    return trust.trust_state(places(spark, sf_dir), reports(spark, sf_dir), 7, _acts(spark, sf_dir)).select("id", "status", "confirm_count", "report_count")


@query(f"""{WITH_PLACES}, acts AS ({ACTS_SQL}), o AS (SELECT *, (created_at, id) AS at_order FROM acts WHERE action IN ('locate', 'edit')),
    m AS (SELECT place_id, arg_max(name_he, at_order) FILTER (action = 'edit' AND name_he IS NOT NULL) AS name_he, arg_max(struct_pack(v := city), at_order) FILTER (action = 'locate' OR city IS NOT NULL) AS city,
          arg_max(lat, at_order) FILTER (action = 'locate') AS lat, arg_max(provider_ref, at_order) FILTER (action = 'locate') AS provider_ref, bool_or(action = 'locate') AS located FROM o GROUP BY place_id)
    SELECT p.id, coalesce(m.name_he, p.name_he) AS name_he, CASE WHEN m.city IS NOT NULL THEN m.city.v ELSE p.city END AS city, coalesce(m.lat, p.lat) AS lat, coalesce(m.provider_ref, p.provider_ref) AS provider_ref,
           CASE WHEN m.located THEN NULL ELSE p.address_he END AS address_he, CASE WHEN m.located THEN 'exact' ELSE p.location_precision END AS location_precision, CASE WHEN m.located THEN false ELSE p.lat IS NULL END AS pin_unavailable
    FROM places p LEFT JOIN m ON m.place_id = p.id""")
def edited_places(spark, sf_dir):
    """Places with what moderators located and edited."""
    own = places(spark, sf_dir).withColumn("pin_unavailable", F.col("lat").isNull())
    return trust.edited(own, _acts(spark, sf_dir)).select("id", "name_he", "city", "lat", "provider_ref", "address_he", "location_precision", "pin_unavailable")


@query(f"{WITH_REPORTS} SELECT date_trunc('hour', created_at) AS hour, kind, count(*) AS n FROM reports GROUP BY 1, 2")
def hourly_reports(spark, sf_dir):
    """Reports by hour and kind, by the function that the stream uses."""
    from placemill.streaming.trust_stream import hourly_kinds

    found = hourly_kinds(reports(spark, sf_dir).withColumn("created_at", F.col("created_at").cast("timestamp")))
    return found.select(F.col("hour.start").cast("timestamp_ntz").alias("hour"), "kind", "n")


# contracts


#: What a table of events, and of places, has to look like: position, column and type.
EVENT_SHAPE = [("event_id", "bigint"), ("ts", "timestamp_ntz"), ("user_id", "bigint"), ("event_type", "string"), ("value", "double"), ("props", "string"), ("session", "string")]
SHAPE_SQL = ", ".join(f"('{c}', {k}, '{t}')" for k, (c, t) in enumerate(EVENT_SHAPE))
KIND_SQL = "CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' WHEN 'TIMESTAMP_NS' THEN 'timestamp_ntz' ELSE column_type END"


@query(f"""WITH want AS (SELECT * FROM (VALUES {SHAPE_SQL}) AS v(name, position, kind)), got AS (SELECT column_name AS name, row_number() OVER () - 1 AS position, {{KIND}} AS kind FROM (DESCRIBE SELECT * FROM events)),
    n AS (SELECT count(*) AS n, count(event_id) AS event_id, count(ts) AS ts, count(user_id) AS user_id, count(event_type) AS event_type, count(value) AS value, count(props) AS props FROM events),
    filled AS (UNPIVOT n ON event_id, ts, user_id, event_type, value, props INTO NAME name VALUE filled)
    SELECT w.name AS "column", w.position::INT AS position, w.kind AS expected, coalesce(g.kind, 'none') AS found, g.position IS NOT DISTINCT FROM w.position AND g.kind = w.kind AS ok, coalesce(filled, 0) AS filled, (SELECT n FROM n) AS n_rows
    FROM want w LEFT JOIN got g USING (name) LEFT JOIN filled f ON f.name = w.name""".replace("{KIND}", KIND_SQL))
def column_contracts(spark, sf_dir):
    """The given events against the shape that is asked of them: place and type of each column, and in how many rows it is filled."""
    return ingest.shape_contract(read(spark, sf_dir, "events"), EVENT_SHAPE)


TABLES = ["customer", "supplier", "part", "orders", "lineitem"]


@query("SELECT column_name AS \"column\", count(DISTINCT table_name) AS tables FROM (" + " UNION ALL ".join(f"SELECT split_part(column_name, '_', 2) AS column_name, '{t}' AS table_name FROM (DESCRIBE SELECT * FROM {t})" for t in ("customer", "supplier", "part", "orders", "lineitem")) + ") GROUP BY 1 HAVING count(DISTINCT table_name) < 5")
def schema_drift(spark, sf_dir):
    """Fields, without their table's letter, that some of the given tables have and others lack, and how many have them: from the keys of their rows."""
    own = {t: read(spark, sf_dir, t) for t in TABLES}
    return ingest.key_drift({t: f.toDF(*[c.split("_", 1)[1] for c in f.columns]) for t, f in own.items()})


def _palette_sql() -> str:
    from placemill.plans.catalogue import SQL

    every = " AND ".join(f"{k} >= 20" for k in ("normal", *color.VIENOT))
    return f"SELECT id, {every} AS distinct_to_all, contrast >= 4.5 AS legible, contrast >= 7 AS body FROM ({SQL['palette_checks']})"


@query(_palette_sql())
def palette_verdicts(spark, sf_dir):
    """Which pairs of colours keep the palette's limits."""
    code = lambda c: F.concat(F.lit("#"), F.substring(F.md5(c.cast("string")), 1, 6))
    pairs = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), color.linear(code(F.col("s_suppkey"))).alias("a"), color.linear(code(F.col("s_suppkey") + 1)).alias("b"))
    a, b = F.col("a"), F.col("b")
    return pairs.select("id", color.distinct_to_all(a, b).alias("distinct_to_all"), color.legible(a, b).alias("legible"), color.legible(a, b, color.MIN_BODY).alias("body"))
