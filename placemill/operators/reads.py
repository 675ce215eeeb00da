"""Read queries over places: lists, nearest first, facets, search, queues, counts.

`places` has at least id, name_he, name_en, city, category, lat, lng, is_chain, is_online, the two benefit flags, source, status and
confirm_count.  A missing point is a null lat or lng.  Every order ends with the id.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from placemill.functions import dates, geo, text
from placemill.functions.similarity import GRAM_BUCKETS, gram_buckets, gram_lists, name_similarity
from placemill.operators.settle import dealt, settled

VISIBLE = ["published", "reported_not_working"]
BENEFITS = {"fighter_card": "benefit_fighter_card", "vacation_voucher": "benefit_vacation_voucher"}
CATEGORIES = ["restaurant", "cafe", "hotel", "zimmer", "spa", "clothing", "shoes", "sports", "electronics", "toys", "jewelry", "attraction", "gov_service", "other"]
PLACE_COLUMNS = [
    "id", "provider_ref", "name_he", "name_en", "category", "is_chain", "is_online", "lat", "lng", "address_he", "city", "phone", "url", "benefit_fighter_card",
    "benefit_vacation_voucher", "note_he", "source", "status", "confirm_count", "report_count", "first_reported_at", "last_confirmed_at", "location_precision", "distance_m",
]


def visible() -> Column:
    return F.col("status").isin(*VISIBLE)


def has_point() -> Column:
    return F.col("lat").isNotNull() & F.col("lng").isNotNull()


def benefit_filter(benefit: str | None) -> Column:
    """Null is no filter; an unknown benefit matches nothing."""
    if benefit is None:
        return F.lit(True)
    return F.col(BENEFITS[benefit]) if benefit in BENEFITS else F.lit(False)


def category_filter(categories: list[str] | None) -> Column:
    """Null is no filter; an empty list matches nothing."""
    if categories is None:
        return F.lit(True)
    return F.col("category").isin(*categories) if categories else F.lit(False)


def place_view(places: DataFrame, distance: Column | None = None) -> DataFrame:
    """The public columns, in their order; those that the input lacks are null."""
    d = (F.lit(None).cast("double") if distance is None else distance).alias("distance_m")
    return places.select(*[d if c == "distance_m" else F.col(c) if c in places.columns else F.lit(None).cast("string").alias(c) for c in PLACE_COLUMNS])


def clamp_radius(metres: float | None) -> float:
    return 25_000.0 if metres is None or math.isnan(metres) else min(200_000.0, max(100.0, float(round(metres))))


def places_near(places: DataFrame, lat: float, lng: float, radius_m: float = 25_000, benefit: str | None = None, categories: list[str] | None = None, limit: int | None = 300) -> DataFrame:
    """Visible places within a radius, nearest first; the box of the circle is compared first, on plain columns."""
    distance = geo.geodesic_m(F.col("lat"), F.col("lng"), lat, lng)
    found = places.filter(visible() & has_point() & geo.near_box(F.col("lat"), F.col("lng"), lat, lng, radius_m) & benefit_filter(benefit) & category_filter(categories))
    found = place_view(found, distance).filter(F.col("distance_m") <= radius_m)
    return found.orderBy("distance_m", "id").limit(limit) if limit is not None else found


def places_all(places: DataFrame, benefit: str | None = None, categories: list[str] | None = None, limit: int | None = 2000) -> DataFrame:
    found = place_view(places.filter(visible() & has_point() & benefit_filter(benefit) & category_filter(categories)))
    return found.orderBy("name_he", "id").limit(limit) if limit is not None else found


def place_by_id(places: DataFrame, place_id) -> DataFrame:
    return place_view(places.filter(visible() & (F.col("id") == place_id)))


def unmapped(places: DataFrame) -> DataFrame:
    """Visible places that no map can show."""
    return place_view(places.filter(visible() & (F.col("is_chain") | F.col("is_online") | ~has_point())).withColumns({"lat": F.lit(None).cast("double"), "lng": F.lit(None).cast("double")}))


def matches_words(hay: Column, query: str | Column) -> Column:
    """Every word of the folded query is somewhere in the folded text."""
    words = F.filter(F.split(text.fold(F.lit(query) if isinstance(query, str) else query), " "), lambda w: w != "")
    return F.forall(words, lambda w: F.contains(hay, w))


def search(places: DataFrame, query: str) -> DataFrame:
    own = places.withColumn("_hay", text.haystack(F.col("name_he"), F.col("name_en"), F.col("city"), F.col("address_he")))
    return own.filter(matches_words(F.col("_hay"), query)).drop("_hay")


def search_limit(limit: int | None, query: str) -> int:
    """Results of the search box: none for a query of one letter, else 1 to 20."""
    return 0 if len(query.strip()) < 2 else min(20, max(1, 8 if limit is None else limit))


def explore(places: DataFrame, benefit: str | None = None, categories: list[str] | None = None, query: str = "") -> DataFrame:
    """The list's own filters, where an empty set of categories is no filter."""
    return search(places.filter(benefit_filter(benefit) & category_filter(categories or None)), query)


def facet_counts(mapped: DataFrame, others: DataFrame | None, benefit: str | None = None, query: str = "") -> DataFrame:
    """Rows by category under all filters but the category's own; `others` (unmapped ones) are left out near a point."""
    pool = mapped if others is None else mapped.unionByName(others)
    return explore(pool, benefit, None, query).groupBy("category").agg(F.count("*").alias("n"))


def category_chips(counts: DataFrame) -> DataFrame:
    """Categories that have rows, in their fixed order."""
    place = F.array_position(F.array(*[F.lit(c) for c in CATEGORIES]), F.col("category"))
    return counts.filter("n > 0").withColumn("ord", place.cast("int")).orderBy("ord", "category")


def is_sponsored(sponsors: list[dict], today: str) -> Column:
    """By id where the deal names one, else by a folded part of the name; a deal ends with its last day."""
    name, found = text.fold(F.col("name_he")), F.lit(False)
    for s in sponsors:
        if s["until"] >= today:
            found = found | ((F.col("id").cast("string") == str(s["id"])) if s.get("id") is not None else F.contains(name, text.fold(F.lit(s["name"]))))
    return found


def sponsored_first(places: DataFrame, order: list[Column], sponsors: list[dict], today: str) -> DataFrame:
    marked = places.withColumn("sponsored", is_sponsored(sponsors, today))
    return marked.orderBy(F.desc("sponsored"), *order)


def admin_pending(places: DataFrame, limit: int = 500) -> DataFrame:
    return places.filter("status = 'pending'").orderBy("created_at", "id").limit(limit)


def admin_flagged(places: DataFrame, limit: int = 200) -> DataFrame:
    return places.filter("status = 'reported_not_working'").orderBy(F.desc("report_count"), "id").limit(limit)


def admin_revived(places: DataFrame, limit: int = 100) -> DataFrame:
    return places.filter("status = 'reported_not_working' AND confirm_count > 0").orderBy(F.desc("confirm_count"), "id").limit(limit)


def published_count(places: DataFrame) -> DataFrame:
    return places.agg(F.count_if(F.col("status") == "published").alias("n"))


def hero_counts(places: DataFrame) -> DataFrame:
    voucher_only = F.col("benefit_vacation_voucher") & ~F.col("benefit_fighter_card")
    return places.filter(visible() & has_point()).agg(F.count("*").alias("total"), F.count_if(voucher_only).alias("voucher_only"), F.count_if(~voucher_only).alias("fighter"))


def precision_histogram(places: DataFrame) -> DataFrame:
    return places.groupBy("status", "location_precision", has_point().alias("has_point")).agg(F.count("*").alias("n"))


def map_clusters(places: DataFrame, zoom: int, max_zoom: int = 13) -> DataFrame:
    """Points by cell of a map's grid, with the size step that each cluster is drawn in; beyond max_zoom each point is alone."""
    shown = places.filter(visible() & has_point())
    if zoom > max_zoom:
        cells = [F.col("id").cast("long").alias("cell_x"), F.lit(0).cast("long").alias("cell_y")]
    else:
        x, y = geo.map_cell(F.col("lat"), F.col("lng"), zoom)
        cells = [x.alias("cell_x"), y.alias("cell_y")]
    n = F.count("*")
    return shown.groupBy(*cells).agg(n.alias("n"), F.avg("lat").alias("lat"), F.avg("lng").alias("lng"), F.when(n < 10, 0).when(n < 100, 1).otherwise(2).alias("step"))


def alike_nearby(one: DataFrame, other: DataFrame | None, reach: int, least: float) -> DataFrame:
    """The pairs (one, other) of rows of one (one, name, x, y, z) and other (other, name, x, y, z) in cubes at most `reach` apart each way whose names may be alike by more than `least`.

    Where `other` is None, one's rows meet one another.  Of the trigrams of the name that is looked for, less than the share 1 - least may lack in the other
    name.  So of its rarest ones, one more than may lack, the other has one, and an equi-join on a cell and such a trigram misses no pair, whichever of both names is
    looked for.  A cell is 4 * reach cubes wide, so that a cube's reach touches two at most each way.  What is rare is known by counts of 65,536 hashes; it
    decides the speed only.  A row's trigrams go along as 128 bits, so pairs that lack too many go before anything is written.  `one` and `other`
    are written for each trigram, so they had better be numbers.
    """

    often = [0] * GRAM_BUCKETS
    for rows in [one] if other is None else [one, other]:
        for r in rows.select(F.explode(gram_buckets(F.col("name"))).alias("b")).groupBy("b").agg(F.count("*").alias("n")).collect():  # 65,536 rows at most
            often[r["b"]] += r["n"]

    def listed(rows: DataFrame, side: str) -> DataFrame:
        return settled(rows.withColumn("g", gram_lists(F.col("name"), least, often)).select(side, "x", "y", "z", "g.*"))

    def cell(axis: str, shift: int) -> Column:
        return F.floor((F.col(axis) + shift) / (4 * reach))

    def keyed(rows: DataFrame, side: str, cells: list[Column], grams: Column) -> DataFrame:
        at = rows.withColumn("gram", F.explode(grams)).withColumns({f"c_{a}": c for a, c in zip("xyz", cells, strict=True)})
        for a in "xyz":
            at = at.withColumn(f"c_{a}", F.explode(f"c_{a}"))
        inside = [(F.col(a) - 4 * reach * F.col(f"c_{a}")).cast("int").alias(f"{side}_{a}") for a in "xyz"]
        # cells and trigrams of one hash meet needlessly, but what meets is looked at again
        return at.select(F.xxhash64("c_x", "c_y", "c_z", "gram").alias("key"), side, *inside, *[F.col(m).alias(f"{side}_{m}") for m in ("low", "high", "lack")], "gram")

    def met(asked: DataFrame, a: str, there: DataFrame, b: str) -> DataFrame:
        bucket = F.pmod(F.col("gram"), F.lit(GRAM_BUCKETS)).alias("bucket")
        rare = keyed(asked, a, [F.array_distinct(F.array(cell(v, -reach), cell(v, reach))) for v in "xyz"], F.slice("ranked", F.lit(1), F.col("lack") + 1)).drop("gram")
        looked_for = asked.select(F.explode(F.slice("ranked", F.lit(1), F.col("lack") + 1)).alias("gram")).select(bucket).distinct()  # 65,536 rows at most
        every = keyed(there, b, [F.array(cell(v, 0)) for v in "xyz"], F.col("ranked")).drop(f"{b}_lack").withColumn("bucket", bucket).join(F.broadcast(looked_for), "bucket", "left_semi").drop("bucket", "gram")
        pairs = rare.hint("merge").join(every, "key")
        for v in "xyz":
            pairs = pairs.filter(F.abs(F.col(f"{a}_{v}") - F.col(f"{b}_{v}")) <= reach)
        lacks = [F.bit_count(F.col(f"{a}_{m}").bitwiseAND(F.bitwise_not(F.col(f"{b}_{m}")))) for m in ("low", "high")]
        return pairs.filter(lacks[0] + lacks[1] <= F.col(f"{a}_lack")).select("one", "other")

    ones = listed(one, "one")
    if other is not None:
        others = listed(other, "other")
        return met(ones, "one", others, "other").union(met(others, "other", ones, "one")).distinct()
    found = met(ones, "one", ones.withColumnRenamed("one", "other"), "other").filter("one <> other")
    found = found.select(F.least("one", "other").alias("one"), F.greatest("one", "other").alias("other")).distinct()
    return found.union(found.select("other", "one")).union(one.select("one", F.col("one").alias("other")))


def near_spots(asked: DataFrame, there: DataFrame, radius_m: float, least: float) -> DataFrame:
    """(p_lat, p_lng, p_name, lat, lng, name_he, name_similarity, distance_m): the distinct spots of there (lat, lng, name_he) in the radius of those of asked (p_lat, p_lng, p_name), with names like theirs.

    The grid is cubes round the earth's centre, so poles and the date line are places like others.  A pair of names is compared once, wherever it meets.
    """
    at = lambda lat, lng: [c.alias(n) for n, c in zip("xyz", geo.cubes(F.col(lat), F.col(lng), radius_m), strict=True)]
    one, other = dealt(asked.distinct(), "one"), dealt(there.distinct(), "other")
    met = alike_nearby(one.select("one", F.col("p_name").alias("name"), *at("p_lat", "p_lng")), other.select("other", F.col("name_he").alias("name"), *at("lat", "lng")), 1, least)
    met = met.join(one, "one").join(other, "other").drop("one", "other")
    near = settled(met.withColumn("distance_m", geo.geodesic_m(F.col("lat"), F.col("lng"), F.col("p_lat"), F.col("p_lng"))).filter(F.col("distance_m") <= radius_m))
    alike = near.select("p_name", "name_he").distinct().withColumn("name_similarity", name_similarity(F.col("name_he"), F.col("p_name"))).filter(F.col("name_similarity") > least)
    return near.join(alike, ["p_name", "name_he"])


def _asked(probes: DataFrame, *more: str) -> DataFrame:
    return probes.filter(has_point()).select(*more, F.col("lat").alias("p_lat"), F.col("lng").alias("p_lng"), F.col("name").alias("p_name"))


def near_scored(probes: DataFrame, places: DataFrame, radius_m: float = 75, least: float = 0.9, carry: tuple[str, ...] = ()) -> DataFrame:
    """(probe_id, id, name_he, name_similarity, distance_m) of the visible places in the radius of each probe (probe_id, lat, lng, name) whose names are like its own; with the columns `carry` of both.

    Probes and places of one spot and name are one in the search.
    """
    shown = places.filter(visible() & has_point()).select("id", "name_he", "lat", "lng", *[c for c in carry if c in places.columns])
    found = near_spots(_asked(probes), shown.select("lat", "lng", "name_he"), radius_m, least)
    scored = found.join(_asked(probes, "probe_id", *[c for c in carry if c in probes.columns]), ["p_lat", "p_lng", "p_name"]).join(shown, ["lat", "lng", "name_he"])
    return scored.select("probe_id", "id", "name_he", "name_similarity", "distance_m", *carry)


def near_matches(probes: DataFrame, places: DataFrame, radius_m: float = 75, least: float = 0.9) -> DataFrame:
    """For each probe (probe_id, lat, lng, name) the place in the radius whose name is most like it, if that is more than `least`.

    Of places of one spot and name only the least id can be it, and probes of one spot and name have the same one, so copies are never paired.
    """
    first = places.filter(visible() & has_point()).groupBy("lat", "lng", "name_he").agg(F.min("id").alias("id"))
    found = near_spots(_asked(probes), first.select("lat", "lng", "name_he"), radius_m, least).join(first, ["lat", "lng", "name_he"])
    match, order = F.struct("id", "name_he", "name_similarity", "distance_m"), F.struct(-F.col("name_similarity"), "distance_m", "id")
    best = found.groupBy("p_lat", "p_lng", "p_name").agg(F.min_by(match, order).alias("best")).select("p_lat", "p_lng", "p_name", "best.*")
    own = _asked(probes, "probe_id").join(best, ["p_lat", "p_lng", "p_name"])
    return own.groupBy("probe_id").agg(F.min_by(match, order).alias("best")).select("probe_id", "best.*")


def row_rail() -> Column:
    """What a row's edge says: dead, or its benefits."""
    both = F.col("benefit_fighter_card") & F.col("benefit_vacation_voucher")
    return F.when(F.col("status") == "reported_not_working", "dead").when(both, "both").when(F.col("benefit_vacation_voucher"), "voucher").otherwise("fighter")


def icon_kind() -> Column:
    """Which pin the map draws: dead, or its benefits, with a mark where one submitter's word is all there is."""
    kind = F.when(F.col("benefit_fighter_card") & F.col("benefit_vacation_voucher"), "both").when(F.col("benefit_vacation_voucher"), "voucher").otherwise("fighter")
    return F.when(F.col("status") == "reported_not_working", "dead").otherwise(F.concat(kind, F.when(dates.is_single_source(F.col("source"), F.col("confirm_count")), "-new").otherwise("")))


def radius_of(metres: Column) -> Column:
    """`clamp_radius` of a column."""
    return F.when(metres.isNull() | F.isnan(metres), 25_000.0).otherwise(F.least(F.lit(200_000.0), F.greatest(F.lit(100.0), F.bround(metres))))


def limit_of(limit: Column, query: Column) -> Column:
    """`search_limit` of columns."""
    return F.when(F.length(F.trim(query)) < 2, 0).otherwise(F.least(F.lit(20), F.greatest(F.lit(1), F.coalesce(limit, F.lit(8)))))


def public_view(places: DataFrame) -> DataFrame:
    """What anyone may select: visible places, the public columns."""
    return place_view(places.filter(visible()))


def public_reports(reports: DataFrame) -> DataFrame:
    """What anyone may select of the reports: nothing, since they tell who reported."""
    return reports.drop("reporter", "ip_hash").filter(F.lit(False))


def fallback_places(rows: DataFrame, ord_col: str = "ord") -> DataFrame:
    """The importer's own rows as places, for when there is no database: published, at doorways, without reports; rows without a reference are named by their place."""
    none = F.lit(None)
    fixed = {
        "id": F.coalesce("provider_ref", F.concat(F.lit("local-"), F.col(ord_col).cast("string"))), "status": F.lit("published"), "location_precision": F.lit("exact"), "source": F.lit("pdf_import"),
        "confirm_count": F.lit(0), "report_count": F.lit(0), "last_confirmed_at": none.cast("timestamp"), "distance_m": none.cast("double"),
    }
    return rows.withColumns(fixed | {c: none.cast("double") for c in ("lat", "lng") if c not in rows.columns}).drop(ord_col)


def top_towns(places: DataFrame, n: int = 6) -> DataFrame:
    """The n towns of the most places; of equal counts by name."""
    return places.filter(F.col("city") != "").groupBy("city").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "city").limit(n)


def spot_check(rows: DataFrame, n: int = 10, seed: int = 11, id_col: str = "id") -> DataFrame:
    """n rows to look at by hand, the same ones in every run: those of the least seeded hash of the id."""
    return rows.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string"))), id_col).limit(n)


def geojson(places: DataFrame) -> DataFrame:
    """(id, feature): a GeoJSON feature for each place with a point."""
    properties = F.struct("id", F.col("name_he").alias("name"), "category", row_rail().alias("rail"))
    geometry = F.struct(F.lit("Point").alias("type"), F.array("lng", "lat").alias("coordinates"))
    feature = F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), properties.alias("properties")))
    return places.filter(has_point()).select("id", feature.alias("feature"))
