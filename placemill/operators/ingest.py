"""What enters the table: keys, upserts, checks, pins, submissions and points of interest from tagged map objects."""

from __future__ import annotations

from functools import reduce
from itertools import zip_longest

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from placemill.functions import geo, text
from placemill.operators.reads import CATEGORIES, near_matches

# The columns that an import owns, the map objects that are businesses, and what they are to us.
IMPORT_COLUMNS = [
    "source_key", "provider_ref", "name_he", "name_en", "category", "is_chain", "is_online", "location", "address_he", "city", "phone", "url",
    "benefit_fighter_card", "benefit_vacation_voucher", "note_he", "source", "status", "review_reason", "first_reported_at",
]
BUSINESS_TAGS: dict[str, list[str] | None] = {
    "amenity": ["restaurant", "cafe", "fast_food", "bar", "pub", "ice_cream", "food_court", "biergarten", "nightclub", "cinema", "theatre", "marketplace", "pharmacy", "fuel", "bank"],
    "tourism": ["hotel", "hostel", "guest_house", "motel", "apartment", "chalet", "resort", "attraction", "museum", "theme_park", "zoo", "aquarium", "camp_site", "caravan_site", "picnic_site", "viewpoint"],
    "leisure": ["fitness_centre", "sports_centre", "water_park", "bowling_alley", "swimming_pool", "golf_course", "beach_resort", "amusement_arcade"],
    "office": ["travel_agent", "estate_agent"],
    "craft": None,
    "shop": None,
}
SETTLEMENTS = ["city", "town", "village", "suburb", "neighbourhood", "hamlet"]
NOT_BUSINESSES = ["highway", "place", "boundary", "landuse", "natural", "waterway", "railway", "barrier", "man_made", "power", "route", "aeroway"]
TOWN_KINDS = ["place", "boundary", "landuse"]
CATEGORY_OF_TAG = {
    "restaurant": ["amenity:restaurant", "amenity:fast_food", "amenity:food_court", "amenity:bar", "amenity:pub"],
    "cafe": ["amenity:cafe", "amenity:ice_cream", "shop:bakery", "shop:pastry"],
    "attraction": ["amenity:cinema", "amenity:theatre", "amenity:nightclub", "tourism:attraction", "tourism:museum", "tourism:theme_park", "tourism:zoo", "leisure:water_park", "leisure:bowling_alley"],
    "clothing": ["shop:clothes", "shop:boutique", "shop:fashion", "shop:department_store"],
    "shoes": ["shop:shoes"],
    "sports": ["shop:sports", "shop:bicycle", "shop:outdoor", "leisure:fitness_centre", "leisure:sports_centre"],
    "electronics": ["shop:electronics", "shop:mobile_phone", "shop:computer"],
    "toys": ["shop:toys", "shop:baby_goods"],
    "jewelry": ["shop:jewelry", "shop:watches"],
    "hotel": ["tourism:hotel", "tourism:hostel", "tourism:motel", "tourism:resort"],
    "zimmer": ["tourism:guest_house", "tourism:chalet", "tourism:apartment"],
    "spa": ["amenity:spa", "shop:beauty", "shop:massage"],
    "gov_service": ["office:government", "amenity:townhall"],
}
OBJECT_TYPES = {"N": "node", "W": "way", "R": "relation"}
STATUSES = ["published", "pending", "rejected", "reported_not_working"]
KINDS = ["confirm", "not_working", "new_submission"]
BENEFIT_TYPES = ["fighter_card", "vacation_voucher"]
PROVIDER_REF = r"^(osm:(node|way|relation)/\d{1,20}|gmaps:(ftid/0x[0-9a-f]{1,16}:0x[0-9a-f]{1,16}|cid/\d{1,20}|place/[\w-]{10,128}|mid/g/\w{4,32}))$"


def category_of(key: Column, value: Column) -> Column:
    """Our category of a map tag, "other" for all that isn't listed."""
    tag, out = F.concat(key, F.lit(":"), value), F.lit(None).cast("string")
    for category, tags in CATEGORY_OF_TAG.items():
        out = F.coalesce(out, F.when(tag.isin(*tags), category))
    return F.coalesce(out, F.lit("other"))


def business_tag(tags: Column) -> Column:
    """key=value of the first key that makes a map object a business, in the keys' fixed order; null for others."""
    found = []
    for key, values in BUSINESS_TAGS.items():
        value = F.try_element_at(tags, F.lit(key))
        found.append(F.when(value.isNotNull() if values is None else value.isin(*values), F.concat(F.lit(f"{key}="), value)))
    return F.coalesce(*found)


def _tag(*names: str) -> Column:
    return F.coalesce(*[F.nullif(F.try_element_at(F.col("tags"), F.lit(n)), F.lit("")) for n in names])


def _point() -> tuple[Column, Column]:
    """A node's own point, or the mean of a way's valid nodes."""
    valid = F.filter("node_coords", lambda c: c["lat"].isNotNull() & c["lon"].isNotNull())
    mean = lambda a: F.aggregate(valid, F.lit(0.0), lambda s, c: s + c[a]) / F.nullif(F.size(valid), F.lit(0))
    return F.coalesce("lat", mean("lat")), F.coalesce("lon", mean("lon"))


def localities(objects: DataFrame) -> DataFrame:
    """Settlements (nodes) of objects (type, id, tags, lat, lon, node_coords)."""
    kind = _tag("place")
    return objects.filter((F.col("type") == "node") & kind.isin(*SETTLEMENTS) & _tag("name").isNotNull()).select(
        _tag("name").alias("name"), _tag("name:he").alias("name_he"), _tag("name:en").alias("name_en"), kind.alias("kind"), F.bround("lat", 6).alias("lat"), F.bround("lon", 6).alias("lon"), F.col("id").alias("ord")
    )


def points_of_interest(objects: DataFrame) -> DataFrame:
    """Businesses of objects, one for each (name, place to 5 decimals), the first by type and id."""
    lat, lon = _point()
    settlement = (F.col("type") == "node") & F.coalesce(_tag("place").isin(*SETTLEMENTS), F.lit(False)) & _tag("name").isNotNull()
    found = objects.filter(~settlement).withColumns({"category": business_tag(F.col("tags")), "name": _tag("name"), "lat": lat, "lon": lon})
    found = found.filter("category IS NOT NULL AND name IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL")
    one = Window.partitionBy("name", F.bround("lat", 5), F.bround("lon", 5)).orderBy("type", "id")
    return found.withColumn("_n", F.row_number().over(one)).filter("_n = 1").select(
        F.concat_ws("/", "type", "id").alias("poi"), "name", _tag("name:he").alias("name_he"), _tag("name:en").alias("name_en"), _tag("brand").alias("brand"), _tag("addr:city").alias("city"),
        _tag("addr:street").alias("street"), _tag("addr:housenumber").alias("housenumber"), _tag("phone", "contact:phone").alias("phone"), _tag("website", "contact:website").alias("website"),
        "category", F.bround("lat", 6).alias("lat"), F.bround("lon", 6).alias("lon"),
    )


def remote_candidates(hits: DataFrame, deny: bool = True) -> DataFrame:
    """Complete hits of a geocoder (object_type, object_id, name, key, value, lat, lng) as candidates with a reference and a category."""
    types = F.create_map(*[F.lit(x) for k, v in OBJECT_TYPES.items() for x in (k, v)])
    kind = F.coalesce(F.try_element_at(types, F.upper(F.substring("object_type", 1, 1))), F.lit(None))
    whole = hits.filter(kind.isNotNull() & F.col("object_id").isNotNull() & F.coalesce(F.col("name") != "", F.lit(False)) & F.col("lat").isNotNull() & F.col("lng").isNotNull())
    whole = whole.filter(~F.coalesce(F.col("key").isin(*NOT_BUSINESSES), F.lit(False))) if deny else whole
    return whole.withColumn("provider_ref", F.concat(F.lit("osm:"), kind, F.lit("/"), F.col("object_id").cast("string"))).withColumn("category", category_of(F.col("key"), F.col("value")))


def resolved_towns(hits: DataFrame) -> DataFrame:
    """The first hit of each town inside the bounds that is a settlement, structured queries before free ones."""
    ok = geo.in_bounds(F.col("lat"), F.col("lng"), geo.TOWN_BOUNDS) & F.col("category").isin(*TOWN_KINDS)
    best = F.min_by(F.struct(F.bround("lat", 6).alias("lat"), F.bround("lng", 6).alias("lng"), F.substring("matched", 1, 120).alias("matched")), F.struct("phase", "hit"))
    return hits.filter(ok).groupBy("town").agg(best.alias("b")).select("town", "b.*")


def to_rows(records: DataFrame, status: str) -> DataFrame:
    """Import rows of located records."""
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    physical = ~F.coalesce(F.col("is_chain"), F.lit(False)) & ~F.coalesce(F.col("is_online"), F.lit(False))
    point = F.when(physical & F.col("lat").isNotNull() & F.col("lng").isNotNull(), F.concat(F.lit("SRID=4326;POINT("), F.col("lng").cast("string"), F.lit(" "), F.col("lat").cast("string"), F.lit(")")))
    reason = F.coalesce(F.nullif("review_reason", F.lit("")), F.lit("low_confidence" if status == "pending" else None).cast("string"))
    key = text.source_key(F.col("provider_ref"), F.col("is_chain"), F.col("is_online"), F.col("name_he"), F.col("city"))
    return records.select(
        key.alias("source_key"), "provider_ref", F.substring("name_he", 1, 160).alias("name_he"), "name_en", "category", flag("is_chain"), flag("is_online"), point.alias("location"), "address_he", "city",
        "phone", "url", flag("benefit_fighter_card"), flag("benefit_vacation_voucher"), "note_he", F.lit("pdf_import").alias("source"), F.lit(status).alias("status"), reason.alias("review_reason"), "first_reported_at",
    )


def parse_point(location: Column) -> Column:
    """struct<lat, lng> of an EWKT point, whose first number is the longitude."""
    number = lambda k: F.regexp_extract(location, r"POINT\(\s*(-?[\d.eE+-]+)\s+(-?[\d.eE+-]+)\s*\)", k).try_cast("double")
    return F.struct(number(2).alias("lat"), number(1).alias("lng"))


def demoted(rows: DataFrame) -> DataFrame:
    """rows with published physical ones without a pin made pending, and why."""
    bad = (F.col("status") == "published") & ~F.col("is_chain") & ~F.col("is_online") & F.col("location").isNull()
    return rows.withColumns({"status": F.when(bad, "pending").otherwise(F.col("status")), "review_reason": F.when(bad, F.coalesce("review_reason", F.lit("not_geocoded"))).otherwise(F.col("review_reason"))})


def first_per_key(published: DataFrame, pending: DataFrame) -> DataFrame:
    """One row for each source_key: published before pending, then in their order (ord)."""
    both = published.withColumn("_side", F.lit(0)).unionByName(pending.withColumn("_side", F.lit(1)))
    one = Window.partitionBy("source_key").orderBy("_side", "ord")
    return both.withColumn("_n", F.row_number().over(one)).filter("_n = 1").drop("_n", "_side")


def upsert(current: DataFrame, new: DataFrame, key: str = "source_key", owned: list[str] | None = None, defaults: dict | None = None) -> DataFrame:
    """current with new merged in: the owned columns of new win, everything else of a known row stays; a null key is never equal."""
    owned = [c for c in (owned or IMPORT_COLUMNS) if c in new.columns and c != key]
    own = new.select(key, *[F.col(c).alias(f"_new_{c}") for c in owned], F.lit(True).alias("_new"))
    joined = current.join(own, key, "full_outer")
    take = lambda c: F.when(F.col("_new"), F.col(f"_new_{c}")).otherwise(F.col(c))
    rest = lambda c: F.coalesce(F.col(c), F.lit((defaults or {})[c])) if c in (defaults or {}) else F.col(c)
    return joined.select(*[F.col(key) if c == key else (take(c) if c in owned else rest(c)).alias(c) for c in current.columns])


def constraints() -> dict[str, Column]:
    """What every place has to fulfil; a null is no violation."""
    c = F.col
    away = c("is_chain") | c("is_online")
    located = c("lat").isNotNull() & c("lng").isNotNull()
    return {
        "source": c("source").isin("pdf_import", "user_submission"), "status": c("status").isin(*STATUSES), "category": c("category").isin(*CATEGORIES),
        "has_benefit": c("benefit_fighter_card") | c("benefit_vacation_voucher"), "location_shape": ~away | ~located,
        "published_needs_pin": (c("status") != "published") | away | c("pin_unavailable") | located, "precision": c("location_precision").isin("exact", "town"),
    }


def report_constraints() -> dict[str, Column]:
    c = F.col
    return {"kind": c("kind").isin(*KINDS), "benefit_type": c("benefit_type").isNull() | c("benefit_type").isin(*BENEFIT_TYPES), "note": c("note").isNull() | (F.length("note") <= 200)}


def violations(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """(id, violated): a row for each check that a row fails, in one pass."""
    failed = F.array(*[F.when(~F.coalesce(p, F.lit(True)), F.lit(name)) for name, p in checks.items()])
    return rows.select("id", F.explode(F.filter(failed, lambda x: x.isNotNull())).alias("violated"))


def duplicate_keys(rows: DataFrame, key: str) -> DataFrame:
    return rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")


def publish_unpinned(places: DataFrame) -> DataFrame:
    """places with pending physical ones without a point published as such."""
    due = (F.col("status") == "pending") & F.col("lat").isNull() & ~F.col("is_chain") & ~F.col("is_online")
    return places.withColumns({"pin_unavailable": F.when(due, True).otherwise(F.col("pin_unavailable")), "status": F.when(due, "published").otherwise(F.col("status"))})


def town_pins(places: DataFrame, towns: DataFrame, exact: DataFrame | None = None) -> DataFrame:
    """(id, lat, lng, location_precision) of published physical places without a point: a known doorway, else the town's disc; the rest is left out.

    towns has town, lat and lng; exact has id, lat and lng.
    """
    due = places.filter((F.col("status") == "published") & F.col("lat").isNull() & ~F.col("is_chain") & ~F.col("is_online")).select("id", "city")
    centre = towns.select(F.col("town").alias("city"), F.col("lat").alias("t_lat"), F.col("lng").alias("t_lng"))
    found = due.join(centre, "city", "left")
    if exact is not None:
        found = found.join(exact.select("id", F.col("lat").alias("e_lat"), F.col("lng").alias("e_lng")), "id", "left")
    else:
        found = found.withColumns({"e_lat": F.lit(None).cast("double"), "e_lng": F.lit(None).cast("double")})
    spot = geo.disc_offset(F.col("id"), F.col("t_lat"), F.col("t_lng"))
    pinned = found.filter("e_lat IS NOT NULL OR t_lat IS NOT NULL").withColumn("spot", spot)
    return pinned.select("id", F.coalesce("e_lat", "spot.lat").alias("lat"), F.coalesce("e_lng", "spot.lng").alias("lng"), F.when(F.col("e_lat").isNotNull(), "exact").otherwise("town").alias("location_precision"))


def unresolved_towns(places: DataFrame, towns: DataFrame, exact: DataFrame | None = None) -> DataFrame:
    """(city, n): towns that would have pinned places but have no centre."""
    due = places.filter((F.col("status") == "published") & F.col("lat").isNull() & ~F.col("is_chain") & ~F.col("is_online")).select("id", "city")
    due = due if exact is None else due.join(exact.select("id"), "id", "left_anti")
    return due.join(towns.select(F.col("town").alias("city")), "city", "left_anti").groupBy("city").agg(F.count("*").alias("n"))


def with_pins(places: DataFrame, pins: DataFrame) -> DataFrame:
    """places with the points of `town_pins`, whose pins aren't missing any more; refused as a whole if one of them lies outside the country."""
    outside = pins.filter((F.col("location_precision") == "town") & ~geo.in_bounds(F.col("lat"), F.col("lng"), geo.TOWN_BOUNDS)).limit(1).collect()
    if outside:
        raise ValueError(f"place {outside[0]['id']} would be pinned outside the country")
    new = pins.select("id", F.col("lat").alias("_lat"), F.col("lng").alias("_lng"), F.col("location_precision").alias("_precision"))
    take = {"lat": F.coalesce("_lat", "lat"), "lng": F.coalesce("_lng", "lng"), "location_precision": F.coalesce("_precision", "location_precision"), "pin_unavailable": F.when(F.col("_lat").isNotNull(), False).otherwise(F.col("pin_unavailable"))}
    return places.join(new, "id", "left").select(*[take.get(c, F.col(c)).alias(c) for c in places.columns])


def not_among(found: DataFrame, places: DataFrame) -> DataFrame:
    """The rows of found whose source_key, or name where they have none, no row of places has."""
    key = F.coalesce(F.nullif("source_key", F.lit("")), F.col("name_he"))
    return found.withColumn("_key", key).join(places.select(key.alias("_key")).distinct(), "_key", "left_anti").drop("_key")


def submission_errors() -> dict[str, Column]:
    c = F.col
    return {
        "name": F.length(F.trim("name_he")).between(1, 160), "bounds": geo.in_bounds(c("lat"), c("lng")), "address": F.length("address_he") <= 300, "city": F.length("city") <= 80,
        "category": c("category").isin(*CATEGORIES), "benefit": c("benefit_fighter_card") | c("benefit_vacation_voucher"), "note": F.length("note_he") <= 200,
        "provider_ref": F.regexp_like("provider_ref", F.lit(PROVIDER_REF)),
    }


def report_errors() -> dict[str, Column]:
    uuid = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
    return {"place": F.regexp_like("place_id", F.lit(uuid)), "kind": F.col("kind").isin("confirm", "not_working"), "note": F.length("note") <= 200}


def submission_outcomes(submissions: DataFrame, places: DataFrame) -> DataFrame:
    """(submission, outcome, place): what each submission does against the places as they stand.

    A known reference confirms that place; else a near match does; else it is published.  Submissions of one batch don't see each other.
    """
    known = places.filter("provider_ref IS NOT NULL").select("provider_ref", F.col("id").alias("by_ref"))
    named = submissions.join(known, "provider_ref", "left")
    rest = named.filter("by_ref IS NULL").select(F.col("submission").alias("probe_id"), "lat", "lng", F.col("name_he").alias("name"))
    near = near_matches(rest, places).select(F.col("probe_id").alias("submission"), F.col("id").alias("by_name"))
    out = named.join(near, "submission", "left").withColumn("place", F.coalesce("by_ref", "by_name"))
    return out.select("submission", F.when(F.col("place").isNull(), "published").otherwise("confirmed_existing").alias("outcome"), "place")


def submission_effects(submissions: DataFrame, places: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(places with widened benefits (id, two flags), reports to add, places to add) of submissions (submission, provider_ref, name_he, lat, lng, category, two flags, note_he).

    A known place gets a confirmation, and the benefits that it lacked; a new one is published with a report of its submission.
    """
    flags = ["benefit_fighter_card", "benefit_vacation_voucher"]
    judged = submission_outcomes(submissions, places).join(submissions, "submission")
    known = judged.filter("outcome = 'confirmed_existing'")
    said = known.groupBy(F.col("place").alias("id")).agg(*[F.bool_or(F.coalesce(F.col(f), F.lit(False))).alias(f"_{f}") for f in flags])
    widened = places.select("id", *flags).join(said, "id").filter(" OR ".join(f"(_{f} AND NOT {f})" for f in flags))
    widened = widened.select("id", *[(F.col(f) | F.col(f"_{f}")).alias(f) for f in flags])
    benefit = F.when(F.col("benefit_fighter_card"), "fighter_card").otherwise("vacation_voucher")
    kind = F.when(F.col("outcome") == "confirmed_existing", "confirm").otherwise("new_submission")
    added = judged.select("submission", F.col("place").alias("place_id"), kind.alias("kind"), benefit.alias("benefit_type"), F.col("note_he").alias("note"))
    fresh = judged.filter("outcome = 'published'").select("submission", "provider_ref", "name_he", "lat", "lng", "category", *flags, "note_he", F.lit("published").alias("status"), F.lit("user_submission").alias("source"))
    return widened, added, fresh


def column_contract(**frames: DataFrame) -> list[tuple[str, int, str | None, str | None]]:
    """(frame, position, expected, found) wherever a frame's columns differ, in number or order, from those of the first."""
    (_, first), *rest = frames.items()
    out = []
    for name, frame in rest:
        for k, (a, b) in enumerate(zip_longest(first.columns, frame.columns)):
            if a != b:
                out.append((name, k, a, b))
    return out


def seed_rows(rows: DataFrame) -> DataFrame:
    """Self-reported rows: published where they have a point or are online, else pending."""
    ready = (F.col("lat").isNotNull() & F.col("lng").isNotNull()) | F.col("is_online")
    return rows.withColumns({"status": F.when(ready, "published").otherwise("pending"), "review_reason": F.when(~ready, "not_geocoded"), "source": F.lit("user_submission")})


def shape_contract(rows: DataFrame, shape: list[tuple[str, str]]) -> DataFrame:
    """(column, position, expected, found, ok, filled, n_rows) of each column of the shape [(name, type)]: whether rows has it at that place and of that type, and in how many rows it has a value."""
    there = {f.name: (k, f.dataType.simpleString()) for k, f in enumerate(rows.schema.fields)}
    known = [c for c, _ in shape if c in there]
    counts = rows.agg(F.count("*").alias("_n"), *[F.count(c).alias(c) for c in known])
    each = [
        F.struct(
            F.lit(c).alias("column"), F.lit(k).alias("position"), F.lit(t).alias("expected"), F.lit(there[c][1] if c in there else "none").alias("found"), F.lit(there.get(c) == (k, t)).alias("ok"),
            (F.col(c) if c in there else F.lit(0).cast("long")).alias("filled"), F.col("_n").alias("n_rows"),
        )
        for k, (c, t) in enumerate(shape)
    ]
    return counts.select(F.inline(F.array(*each)))


def key_drift(frames: dict[str, DataFrame]) -> DataFrame:
    """(column, tables): keys that rows of some of the frames have and those of others lack, with the number of frames that have them; a frame's keys are those of its rows."""
    keys = None
    for name, frame in frames.items():
        own = frame.select(F.explode(F.array(*[F.lit(c) for c in frame.columns])).alias("column")).distinct().withColumn("frame", F.lit(name))
        keys = own if keys is None else keys.unionByName(own)
    return keys.groupBy("column").agg(F.count("*").alias("tables")).filter(F.col("tables") < len(frames))


def schema_drift(**frames: DataFrame) -> list[str]:
    """Columns that some of the frames have and others lack."""
    sets = [set(f.columns) for f in frames.values()]
    return sorted(reduce(set.union, sets, set()) - (set.intersection(*sets) if sets else set()))
