"""Entity resolution: records, blocking, greedy clusters, their collapse, and matching to points of interest."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from placemill.functions import geo, text
from placemill.functions.similarity import set_ratio, sort_ratio, token_set_ratio, token_sort_ratio, word_grams
from placemill.operators.settle import settled

# Fixed values.
SAME_NAME, MIN_CONFIDENCE = 88, 0.6
MATCH_CONFIDENCE, MIN_SORT, MIN_CORE, CITY_KM, CANDIDATES, MIN_CITY_POIS = 0.87, 75.0, 80.0, 25.0, 12, 3
SETTLEMENT_RANK = ["city", "town", "village", "suburb", "neighbourhood", "hamlet"]
LOCATE_REASONS = ["no_osm_match", "low_match_confidence", "not_located", "not_geocoded", "no_google_result", "city_unresolved"]
#: Distinct names of a block up to which it is clustered as one stream.
STREAMED = 5000
RETRYABLE = ["no_osm_match", "low_match_confidence", "not_located", "not_geocoded"]


def build_records(occurrences: DataFrame, answers: DataFrame) -> DataFrame:
    """A record for each place read in a text: answers (text, places array<struct>) joined to the text's occurrences."""
    both = occurrences.join(answers, "text").select("occurrences", F.explode("places").alias("p"), "text").select("p.*", "occurrences", "text")
    has = lambda b: F.exists("occurrences", lambda o: o["benefit"] == b)
    personal = text.is_personal_phone(F.col("phone"), F.col("phone_kind"))
    return both.select(
        "name_he", "name_en", F.col("city_hint").alias("city"), "kind", "category", text.scrub_phone(F.col("phone"), F.col("phone_kind")).alias("phone"), personal.alias("phone_redacted"),
        "url", "note_he", "status", "confidence", (F.col("kind") == "chain").alias("is_chain"), (F.col("kind") == "online_only").alias("is_online"),
        has("fighter_card").alias("benefit_fighter_card"), has("vacation_voucher").alias("benefit_vacation_voucher"),
        F.filter(F.transform("occurrences", lambda o: o["reported_at"]), lambda d: d.isNotNull()).alias("reported_dates"),
        F.transform("occurrences", lambda o: F.struct(o["row"].alias("row"), o["benefit"].alias("benefit"), text.mask_mobiles(F.col("text")).alias("raw"))).alias("sources"),
        text.alias_of(F.col("name_he"), F.col("name_en")).alias("alias"),
    )


def publishable(records: DataFrame, least: float = MIN_CONFIDENCE) -> tuple[DataFrame, DataFrame]:
    """(those sure enough and of a clear kind, the rest for review)."""
    sure = F.coalesce((F.col("confidence") >= least) & (F.col("kind") != "unclear"), F.lit(False))
    return records.filter(sure), records.filter(~sure)


def block_key(kind: Column, city: Column) -> Column:
    return F.when(kind == "chain", "chain").when(kind == "online_only", "online").otherwise(F.concat(F.lit("loc:"), text.canon(city)))


class _Named:
    """A cluster's head as the rules compare it."""

    def __init__(self, alias, en, he):
        self.alias, self.en, self.he = alias, en, he

    def same(self, other: "_Named", threshold: float) -> bool:
        if self.alias and self.alias == other.alias or self.en and self.en == other.en or self.he == other.he:
            return True
        # an indel ratio can't reach the threshold when lengths differ too much, which spares most alignments
        if 200.0 * min(len(self.he), len(other.he)) < threshold * (len(self.he) + len(other.he)):
            return False
        return token_sort_ratio(self.he, other.he) >= threshold and token_set_ratio(self.he, other.he) >= threshold


def cluster(records: DataFrame, id_col: str = "id", threshold: float = SAME_NAME, streamed: int = STREAMED) -> DataFrame:
    """(id, block, cluster_id, position): greedy clusters inside blocks, longest name first; each record joins the first cluster whose head is the same place.

    Exact repeats of (alias, English name, name) are compared once.  A block is one city, or all chains.  Where no block has more than `streamed`
    distinct names, blocks are read as streams in the clusters' order and only the heads are held.  Larger blocks are clustered by joins: names that share
    a trigram are compared, and the heads are found in rounds, with the same result.
    """
    canonical = records.select(
        F.col(id_col).alias("id"), block_key(F.col("kind"), F.col("city")).alias("block"), "name_he", F.col("alias"),
        text.canon(F.col("name_en")).alias("_en"), text.canon(F.col("name_he")).alias("_he"), (-F.length("name_he")).alias("_size"),
    )
    largest = canonical.groupBy("block").agg(F.approx_count_distinct("_he").alias("n")).agg(F.max("n")).first()[0] or 0
    return _streamed_clusters(canonical, threshold) if largest <= streamed else _joined_clusters(canonical, threshold)


def _lost(length: Column, threshold: float) -> Column:
    """Trigrams that a text of this length can lose to one that is as like it as the threshold: their letters differ by d = (1 - threshold / 100) of both lengths at most, and each insertion or deletion costs three."""
    share = 1 - threshold / 100
    return F.floor(3 * share * (1 + (1 + share) / (1 - share)) * length)


def _length_fits(x: Column, y: Column, threshold: float) -> Column:
    return 200.0 * F.least(x, y) >= threshold * (x + y)


def _alike(names: DataFrame, threshold: float) -> DataFrame:
    """(block, x, y), x < y: the names (block, _he) of a block that are the same place by their letters.

    Each name meets others under its rarest trigrams only, one more than it can lose.  Names with fewer trigrams than that meet under all of them.
    """
    grams = names.select("block", "_he", F.explode(word_grams(F.col("_he"))).alias("t"))
    counted = grams.join(grams.groupBy("block", "t").agg(F.count("*").alias("df")), ["block", "t"])
    ranked = counted.withColumn("_n", F.row_number().over(Window.partitionBy("block", "_he").orderBy("df", "t"))).filter(F.col("_n") <= _lost(F.length("_he"), threshold) + 1).select("block", "t", "_he")
    met = ranked.withColumnRenamed("_he", "x").join(ranked.withColumnRenamed("_he", "y"), ["block", "t"]).filter("x < y").select("block", "x", "y").distinct()
    near = met.filter(_length_fits(F.length("x"), F.length("y"), threshold))
    texts = near.select("x", "y").distinct().filter(sort_ratio(F.col("x"), F.col("y")) >= threshold).filter(set_ratio(F.col("x"), F.col("y")) >= threshold)
    return near.join(texts, ["x", "y"]).select("block", "x", "y")


def candidates(queries: DataFrame, names: DataFrame, least: float = MATCH_CONFIDENCE) -> DataFrame:
    """(query, name): a superset of the pairs of distinct canonical texts whose set ratio is 100 * least or more, by two joins on rare parts.

    A set ratio that high has one of three reasons.  All words of one text are in the other, or those of one text that aren't are at most 2 (1 - least) / (2 - least)
    of its letters: then the texts meet under a word of the one's rarest words whose letters are more than that.  Or the texts, each word once, are alike by
    their letters: then they meet under a trigram that is among the rarest of both, one more than each can lose, and their lengths are near.
    """
    threshold, sides = 100 * least, {}
    once = lambda c: F.array_distinct(F.filter(F.split(c, " "), lambda w: w != ""))
    parts = {"w": once, "t": lambda c: word_grams(c)}
    for kind, f in parts.items():
        own = {n: df.select(n, F.explode(f(F.col(n))).alias(kind)) for n, df in (("query", queries), ("name", names))}
        df = own["query"].select(kind).unionByName(own["name"].select(kind)).groupBy(kind).agg(F.count("*").alias("df"))
        for n, rows in own.items():
            rarest = Window.partitionBy(n).orderBy("df", kind)
            length = F.length(F.array_join(once(F.col(n)), " "))
            counted = rows.join(df, kind)
            if kind == "w":
                before = F.coalesce(F.sum(F.length("w")).over(rarest.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
                rare = counted.withColumn("_before", before).filter(F.col("_before") <= 2 * (1 - least) / (2 - least) * length)
            else:
                rare = counted.withColumn("_n", F.row_number().over(rarest)).filter(F.col("_n") <= _lost(length, threshold) + 1)
            sides[kind, n] = rows, rare.select(n, kind, length.alias(f"{n}_length"))
    pair = ["query", "name"]
    words = sides["w", "query"][1].join(sides["w", "name"][0], "w").select(*pair).unionByName(sides["w", "query"][0].join(sides["w", "name"][1], "w").select(*pair))
    letters = sides["t", "query"][1].join(sides["t", "name"][1], "t").filter(_length_fits(F.col("query_length"), F.col("name_length"), threshold)).select(*pair)
    return words.unionByName(letters).distinct()


def _joined_clusters(canonical: DataFrame, threshold: float) -> DataFrame:
    """The heads are the names that match no earlier head: in each round those without an undecided earlier match are heads, and what matches them is decided too."""
    nodes = settled(canonical.groupBy("block", "alias", "_en", "_he").agg(F.min(F.struct("_size", "name_he", "id")).alias("first")).withColumn("node", F.col("first")["id"]))
    side = lambda n: nodes.select("block", *[F.col(c).alias(f"{c}_{n}") for c in ("node", "first", "alias", "_en", "_he")])
    a, b = side("a"), side("b")
    apart = F.col("first_a") < F.col("first_b")
    both = lambda c: a.join(b, (a["block"] == b["block"]) & (F.col(f"{c}_a") == F.col(f"{c}_b")) & ((F.col(f"{c}_a") != "") | F.lit(c == "_he"))).filter(apart).select("node_a", "node_b")
    letters = _alike(nodes.select("block", "_he").distinct(), threshold)
    letters = letters.union(letters.select("block", F.col("y").alias("x"), F.col("x").alias("y"))).toDF("block", "_he_a", "_he_b")
    spelled = letters.join(a, ["block", "_he_a"]).join(b, ["block", "_he_b"]).filter(apart).select("node_a", "node_b")
    matches = settled(both("alias").union(both("_en")).union(both("_he")).union(spelled).distinct())
    edges, open_, heads = matches, nodes.select("node"), None
    while True:
        new = settled(open_.join(edges.select(F.col("node_b").alias("node")).distinct(), "node", "left_anti"))
        heads = new if heads is None else heads.unionByName(new)
        if edges.isEmpty():
            break
        members = edges.join(new, F.col("node_a") == F.col("node")).select(F.col("node_b").alias("node")).distinct()
        open_ = settled(open_.join(new, "node", "left_anti").join(members, "node", "left_anti"))
        left = edges.join(open_, F.col("node_a") == F.col("node"), "left_semi")
        edges = settled(left.join(open_, F.col("node_b") == F.col("node"), "left_semi"))
    heads = settled(heads.join(nodes, "node").select("block", F.col("node").alias("head"), "first"))
    joined = matches.join(heads.select(F.col("head").alias("node_a"), "first"), "node_a").groupBy("node_b").agg(F.min(F.struct("first", F.col("node_a").alias("head"))).alias("h"))
    own = heads.select(F.col("head").alias("node"), "head").unionByName(joined.select(F.col("node_b").alias("node"), F.col("h")["head"].alias("head")).join(heads.select(F.col("head").alias("node")), "node", "left_anti"))
    numbered = heads.select("head", (F.row_number().over(Window.partitionBy("block").orderBy("first")) - 1).cast("long").alias("cluster_id"))
    placed = nodes.join(own, "node").join(numbered, "head").select("block", "alias", "_en", "_he", "cluster_id")
    keys = [canonical[c].eqNullSafe(placed[c]) for c in ("block", "alias", "_en", "_he")]
    rows = canonical.join(placed, keys[0] & keys[1] & keys[2] & keys[3]).select(canonical["id"], canonical["block"], "cluster_id", "_size", "name_he")
    position = F.row_number().over(Window.partitionBy("block", "cluster_id").orderBy("_size", "name_he", "id")) - 1
    return rows.select("id", "block", "cluster_id", position.cast("long").alias("position"))


def _streamed_clusters(canonical: DataFrame, threshold: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, heads, known = None, [], {}
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["block"] != block:
                    block, heads, known = r["block"], [], {}
                key = (r["alias"], r["_en"], r["_he"])
                at = known.get(key)
                if at is None:
                    me = _Named(*key)
                    at = next((k for k, (h, _) in enumerate(heads) if me.same(h, threshold)), None)
                    if at is None:
                        at = len(heads)
                        heads.append([me, 0])
                    known[key] = at
                out.append((r["id"], block, at, heads[at][1]))
                heads[at][1] += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["id", "block", "cluster_id", "position"]) if out else pa.RecordBatch.from_pylist([], schema=pa.schema([("id", pa.int64()), ("block", pa.string()), ("cluster_id", pa.int64()), ("position", pa.int64())]))

    dealt = canonical.repartition("block").sortWithinPartitions("block", "_size", "name_he", "id")
    return dealt.select("id", "block", "alias", "_en", "_he").mapInArrow(run, "id long, block string, cluster_id long, position long")


def collapse(records: DataFrame, clusters: DataFrame, id_col: str = "id") -> DataFrame:
    """One record for each cluster: its head, with what the others add."""
    rows = records.withColumnRenamed(id_col, "id").join(clusters, "id")
    first = lambda c: F.min_by(c, F.when(F.coalesce(F.col(c) != "", F.lit(False)), F.col("position")))
    head = lambda c: F.min_by(c, "position")
    listed = F.transform(F.sort_array(F.collect_list(F.struct("position", "note_he"))), lambda s: s["note_he"])
    note = F.substring(F.array_join(F.array_distinct(F.filter(listed, lambda n: n != "")), " "), 1, 200)
    sources = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("position", "sources"))), lambda s: s["sources"]))
    dates = F.flatten(F.collect_list("reported_dates"))
    out = rows.groupBy("block", "cluster_id").agg(
        head("id").alias("id"), F.coalesce(head("alias"), head("name_he")).alias("name_he"), first("name_en").alias("name_en"), first("city").alias("city"), head("kind").alias("kind"),
        head("category").alias("category"), first("phone").alias("phone"), first("url").alias("url"), note.alias("note_he"), F.bool_or("benefit_fighter_card").alias("benefit_fighter_card"),
        F.bool_or("benefit_vacation_voucher").alias("benefit_vacation_voucher"), F.array_min(dates).alias("first_reported_at"), F.array_max(dates).alias("last_reported_at"),
        sources.alias("sources"), F.array_sort(F.collect_set("name_he")).alias("merged_names"), F.max("confidence").alias("confidence"),
        F.when(F.bool_or(F.col("status") == "reported_not_working"), "reported_not_working").otherwise("works").alias("status"),
    )
    return out.withColumn("note_he", text.strip_mobiles(F.col("note_he"))).withColumn("report_count", F.size("sources"))


def merge_report(records: DataFrame, merged: DataFrame) -> DataFrame:
    """(section, key, n): records and clusters by kind, category and status, benefits, and clusters of several names."""
    by = lambda c: merged.groupBy(F.lit(c).alias("section"), F.col(c).alias("key")).agg(F.count("*").alias("n"))
    f, v = F.col("benefit_fighter_card"), F.col("benefit_vacation_voucher")
    counts = {"clusters": F.count("*"), "fighter_card": F.count_if(f), "vacation_voucher": F.count_if(v), "both": F.count_if(f & v), "several_names": F.count_if(F.size("merged_names") > 1)}
    wide = merged.agg(*[c.alias(k) for k, c in counts.items()])
    tall = wide.select(F.lit("total").alias("section"), F.explode(F.create_map(*[x for k in counts for x in (F.lit(k), F.col(k))])).alias("key", "n"))
    return tall.unionByName(records.agg(F.lit("total").alias("section"), F.lit("records").alias("key"), F.count("*").alias("n"))).unionByName(by("kind")).unionByName(by("category")).unionByName(by("status"))


def city_medians(pois: DataFrame, least: int = MIN_CITY_POIS) -> DataFrame:
    """(key, lat, lon): the upper median of the coordinates of a city's points of interest, each by itself, where there are enough."""
    upper = lambda c: F.element_at(F.sort_array(F.collect_list(c)), (F.floor(F.count("*") / 2) + 1).cast("int"))
    keyed = pois.withColumn("key", text.canon(F.col("city"))).filter("key <> ''")
    return keyed.groupBy("key").agg(F.count("*").alias("n"), upper("lat").alias("lat"), upper("lon").alias("lon")).filter(F.col("n") >= least).drop("n")


def locality_index(localities: DataFrame, pois: DataFrame | None = None) -> DataFrame:
    """(key, lat, lon): each settlement name once, the largest kind first, then cities known only from points of interest."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(k) for k in SETTLEMENT_RANK]), F.col("kind")), F.lit(0)), F.lit(10))
    named = localities.withColumn("_rank", rank).withColumn("_name", F.explode(F.array("name", "name_he", "name_en")))
    named = named.withColumn("key", text.canon(F.col("_name"))).filter("key <> ''")
    known = named.groupBy("key").agg(F.min_by(F.struct("lat", "lon"), F.struct("_rank", "ord")).alias("at")).select("key", "at.lat", "at.lon")
    return known if pois is None else known.unionByName(city_medians(pois).join(known, "key", "left_anti"))


def search_space(pois: DataFrame) -> DataFrame:
    """(poi, name, hit): every name that a point of interest answers to; hit is its place in the order of all names (`ord` of the points, else their id)."""
    order = F.col("ord") if "ord" in pois.columns else F.col("poi")
    each = pois.select("poi", order.alias("_ord"), F.posexplode(F.array("name", "name_he", "name_en", "brand")).alias("_k", "_n")).withColumn("name", text.canon(F.col("_n")))
    return each.filter("name <> ''").select("poi", "name", F.struct(F.col("_ord").alias("ord"), F.col("_k").alias("k")).alias("hit"))


def judged(candidates: DataFrame, least: float = MATCH_CONFIDENCE, radius_km: float = CITY_KM, limit: int | None = CANDIDATES) -> DataFrame:
    """The best candidate of each place that passes all guards, with its confidence.

    candidates has place, query (canonical), name (canonical), hit (order), lat, lon and centre_lat, centre_lon (null for no city).
    """
    scored = candidates.withColumn("set_score", set_ratio(F.col("query"), F.col("name"))).filter(F.col("set_score") >= least * 100)
    if limit is not None:
        scored = _first(scored, "place", limit, F.desc("set_score"), F.col("hit"))
    return _nearest(_same_words(scored), radius_km)


def _first(rows: DataFrame, by: str, limit: int, *order: Column) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("_n") <= limit).drop("_n")


def _same_words(scored: DataFrame) -> DataFrame:
    """Those of (query, name, set_score) whose order of words and distinctive words agree, with sort_score."""
    scored = scored.withColumn("sort_score", sort_ratio(F.col("query"), F.col("name"))).filter(F.col("sort_score") >= MIN_SORT)
    scored = scored.withColumns({"core": text.distinctive_of(F.col("query")), "other": text.distinctive_of(F.col("name"))})
    alike = F.greatest(set_ratio(F.col("core"), F.col("other")), set_ratio(text.skeleton_of(F.col("core")), text.skeleton_of(F.col("other"))))
    core = F.when((F.col("core") == "") & (F.col("other") == ""), 100.0).when((F.col("core") == "") | (F.col("other") == ""), 0.0).otherwise(alike)
    return scored.filter(core >= MIN_CORE).drop("core", "other")


def _nearest(scored: DataFrame, radius_km: float) -> DataFrame:
    """(place, poi, match_confidence): the best of each place's that is not too far from the city."""
    far = geo.haversine_km(F.col("centre_lat"), F.col("centre_lon"), F.col("lat"), F.col("lon")) > radius_km
    scored = scored.filter(~F.coalesce(far, F.lit(False))).withColumn("confidence", (F.col("set_score") * 0.6 + F.col("sort_score") * 0.4) / 100)
    pick = F.min_by(F.struct("poi", "confidence"), F.struct(-F.col("confidence"), -F.col("set_score"), "hit"))
    return scored.groupBy("place").agg(pick.alias("b")).select("place", "b.poi", F.col("b.confidence").alias("match_confidence"))


def _or_null(frame: DataFrame, column: str) -> Column:
    return F.nullif(F.col(column), F.lit("")) if column in frame.columns else F.lit(None).cast("string")


def locate(places: DataFrame, pois: DataFrame, localities: DataFrame, least: float = MATCH_CONFIDENCE, radius_km: float = CITY_KM) -> DataFrame:
    """(place, poi, provider_ref, name_osm, lat, lng, address_he, phone, url, osm_category, match_confidence, reason) for places (place, name_he, city, and phone and url if known).

    Candidates come from equi-joins on rare words and trigrams, so no name is compared with all others.  They join distinct queries and distinct names:
    the scores and the order of a query's candidates depend on nothing else, so each pair of texts is scored once, and of the points
    that share a name only the first of the order, as many as a query has candidates, can be among them.  Equal scores go by that order.
    A city that is said but not known leaves a place unresolved, also one that has no letters.
    """
    asked = places.withColumns({"query": text.canon(F.col("name_he")), "city_key": text.canon(F.col("city")), "own_phone": _or_null(places, "phone"), "own_url": _or_null(places, "url")})
    asked = asked.join(localities.select(F.col("key").alias("city_key"), F.col("lat").alias("centre_lat"), F.col("lon").alias("centre_lon")), "city_key", "left")
    unresolved = F.coalesce(F.col("city") != "", F.lit(False)) & F.col("centre_lat").isNull()
    open_ = asked.filter((F.col("query") != "") & ~unresolved)
    space = search_space(pois)
    met = candidates(open_.select("query").distinct(), space.select("name").distinct(), least)
    scored = met.withColumn("set_score", set_ratio(F.col("query"), F.col("name"))).filter(F.col("set_score") >= least * 100)
    scored = _first(scored.join(_first(space, "name", CANDIDATES, F.col("hit")), "name"), "query", CANDIDATES, F.desc("set_score"), F.col("hit"))
    scored = _same_words(scored).join(pois.select("poi", "lat", "lon"), "poi").join(open_.select("place", "query", "centre_lat", "centre_lon"), "query")
    found = _nearest(scored, radius_km).join(pois, "poi")
    street = F.nullif(F.concat_ws(" ", _or_null(pois, "street"), _or_null(pois, "housenumber")), F.lit(""))
    found = found.select(
        "place", "poi", F.concat(F.lit("osm:"), F.col("poi").cast("string")).alias("provider_ref"), F.col("name").alias("name_osm"), "lat", F.col("lon").alias("lng"), street.alias("_street"), _or_null(pois, "city").alias("_town"),
        _or_null(pois, "phone").alias("_phone"), _or_null(pois, "website").alias("_url"), F.col("category").alias("osm_category"), F.col("match_confidence").alias("_exact"),
    )
    out = asked.select("place", "query", "city", "own_phone", "own_url", unresolved.alias("_unresolved")).join(found, "place", "left")
    reason = F.when(F.col("query") == "", "no_osm_match").when(F.col("_unresolved"), "city_unresolved").when(F.col("poi").isNull(), "no_osm_match").when(F.col("_exact") < least, "low_match_confidence")
    address = F.when(F.col("poi").isNotNull(), F.nullif(F.concat_ws(", ", "_street", F.coalesce("_town", F.nullif("city", F.lit("")))), F.lit("")))
    return out.select(
        "place", "poi", "provider_ref", "name_osm", "lat", "lng", address.alias("address_he"), F.coalesce("own_phone", "_phone").alias("phone"), F.coalesce("own_url", "_url").alias("url"), "osm_category",
        F.round("_exact", 3).alias("match_confidence"), reason.alias("reason"),
    )


def locate_summary(located: DataFrame) -> DataFrame:
    return located.groupBy(F.coalesce("reason", F.lit("located")).alias("reason")).agg(F.count("*").alias("n"))


def refreshed_review(old: DataFrame, new: DataFrame) -> DataFrame:
    """The review list with the reasons of this pass in place of all locating passes before it."""
    return old.filter(~F.coalesce(F.col("review_reason").isin(*LOCATE_REASONS), F.lit(False))).unionByName(new, allowMissingColumns=True)


def retryable(review: DataFrame) -> DataFrame:
    return review.filter(F.col("review_reason").isin(*RETRYABLE) & (F.col("kind") == "single_location"))


def published_order(merged: DataFrame) -> DataFrame:
    """The records to publish as they are written: by kind and name."""
    return merged.orderBy("kind", "name_he", "id")


def review_order(merged: DataFrame) -> DataFrame:
    """The records for review, the least sure first."""
    return merged.orderBy("confidence", "id")
