"""Queries that write the given tables to the shared folder in the formats of the importers, and read them again.

Importing this module registers them with the catalogue.
"""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from placemill.functions import text
from placemill.operators import reads, resolve, spatial
from placemill.operators.search_index import SearchIndex
from placemill.operators.settle import shared_folder
from placemill.plans.catalogue import AT, SQL, WITH_PLACES, oracle, query
from placemill.plans.tables import places, read
from placemill.sources import files


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# sheets: cells with commas, quotes and line breaks; every seventh has no date, every fifth no voucher, every third no card
@query("""WITH p AS (SELECT *, row_number() OVER (ORDER BY p_partkey) + 1 AS row FROM part)
    SELECT row, CASE WHEN p_partkey % 7 > 0 THEN strftime(TIMESTAMP '2024-01-01' + INTERVAL 1 HOUR * (p_partkey % 500), '%Y-%m-%dT%H:%M:%S') END AS reported_at, 'vacation_voucher' AS field, p_name || ', "' || p_brand || '"' || chr(10) || 'line two' AS text FROM p WHERE p_partkey % 5 > 0
    UNION ALL SELECT row, CASE WHEN p_partkey % 7 > 0 THEN strftime(TIMESTAMP '2024-01-01' + INTERVAL 1 HOUR * (p_partkey % 500), '%Y-%m-%dT%H:%M:%S') END, 'fighter_card', p_type FROM p WHERE p_partkey % 3 > 0""")
def sheet_rows(spark, sf_dir):
    """The benefit cells of sheets, read in splits."""
    key = F.col("p_partkey")
    stamp = F.date_format(F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(hours=(key % 500).cast("int")), "d/M/yyyy H:mm:ss")
    voucher = F.concat(F.col("p_name"), F.lit(', "'), F.col("p_brand"), F.lit('"\nline two'))
    rows = read(spark, sf_dir, "part").select(
        key, F.when(key % 7 > 0, stamp).otherwise("").alias("date"), F.lit("-").alias("ignored"), F.when(key % 5 > 0, voucher).otherwise(" ").alias("voucher"), F.when(key % 3 > 0, F.col("p_type")).otherwise(" ").alias("fighter")
    )
    path = _folder(spark, "sheets")
    rows.repartitionByRange(4, key).sortWithinPartitions(key).drop("p_partkey").write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return files.split_sheet_cells(spark, path)


def _answers(spark, sf_dir) -> str:
    """Answers as JSON Lines: some lines are none, some places have no name, a wrong kind or category, or too much confidence."""
    key = F.col("p_partkey")
    one = F.struct(
        F.when(key % 11 > 0, F.col("p_name")).otherwise("").alias("name_he"), F.concat(F.lit("place "), key.cast("string")).alias("city_hint"), F.when(key % 13 > 0, "chain").otherwise("shop").alias("kind"),
        F.when(key % 4 > 0, "cafe").otherwise("hotel").alias("category"), ((key % 120) / 100).alias("confidence"),
    )
    line = F.when(key % 17 > 0, F.to_json(F.struct(key.cast("int").alias("index"), F.array(one).alias("places")))).otherwise(F.concat(F.lit("json "), key.cast("string")))
    path = _folder(spark, "answers")
    read(spark, sf_dir, "part").select(line.alias("value")).write.text(path)
    return path


CHECKED_SQL = """SELECT p_partkey AS id, p_name, p_partkey % 17 > 0 AS whole, p_partkey % 11 > 0 AS name, p_partkey % 13 > 0 AS kind, p_partkey % 120 <= 100 AS confidence FROM part"""


@query(f"SELECT id::INT AS index, p_name AS name_he, 'chain' AS kind, CASE WHEN id % 4 > 0 THEN 'cafe' ELSE 'hotel' END AS category, (id % 120)::DOUBLE / 100 AS confidence FROM ({CHECKED_SQL}) WHERE whole AND name AND kind AND confidence")
def answers_valid(spark, sf_dir):
    """The places of answers that have what a place has to have."""
    return files.read_answers(spark, _answers(spark, sf_dir))[0].select("index", "name_he", "kind", "category", "confidence")


@query(f"""SELECT id, CASE WHEN whole THEN array_to_string(list_filter([CASE WHEN NOT name THEN 'name' END, CASE WHEN NOT kind THEN 'kind' END, CASE WHEN NOT confidence THEN 'confidence' END], lambda x: x IS NOT NULL), ',')
    ELSE 'not JSON of this shape' END AS why FROM ({CHECKED_SQL}) WHERE NOT (whole AND name AND kind AND confidence)""")
def answers_rejected(spark, sf_dir):
    """What is wrong with the other lines."""
    wrong = files.read_answers(spark, _answers(spark, sf_dir))[1]
    return wrong.select(F.regexp_extract("line", "(?:place|json) ([0-9]+)", 1).cast("long").alias("id"), "why")


@query("SELECT p_partkey AS id, p_name AS name, CASE WHEN p_partkey % 3 > 0 THEN p_retailprice END AS price FROM part")
def json_arrays(spark, sf_dir):
    """The parts from files that are one JSON array each, of 500 keys."""
    key = F.col("p_partkey")
    row = F.struct(key.alias("id"), F.col("p_name").alias("name"), F.when(key % 3 > 0, F.col("p_retailprice")).alias("price"))
    arrays = read(spark, sf_dir, "part").groupBy(F.floor(key / 500).alias("of")).agg(F.to_json(F.collect_list(row)).alias("value"))
    path = _folder(spark, "arrays")
    arrays.write.partitionBy("of").text(path)
    return files.read_json(spark, path, spark.createDataFrame([], "id long, name string, price double").schema).select("id", "name", "price")


@query("SELECT p_partkey AS id, p_name AS name, p_size AS size FROM part")
def table_versions(spark, sf_dir):
    """The parts from a table's new version, beside an older one that is still there."""
    path, own = _folder(spark, "tables"), read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_size").alias("size"))
    files.replace_table(own.filter("size > 10"), f"{path}/1", "id")
    files.replace_table(own, f"{path}/2", "id")
    return spark.read.parquet(f"{path}/2")


REMOTE_SQL = f"""SELECT a.id AS place, {oracle.CANON.format('a.name_he')} AS query, {oracle.CANON.format("b.name_he || CASE WHEN b.id % 4 = 0 THEN ' the' ELSE '' END")} AS name, b.id AS hit, b.id AS poi, b.lat, b.lng AS lon,
    CASE WHEN a.id % 3 > 0 THEN a.lat END AS centre_lat, CASE WHEN a.id % 3 > 0 THEN a.lng END AS centre_lon FROM places a JOIN places b ON b.id BETWEEN a.id AND a.id + 9 WHERE a.lat IS NOT NULL AND b.lat IS NOT NULL"""


@query(f"""{WITH_PLACES.replace("WITH places", "WITH RECURSIVE places", 1)}, hits AS ({REMOTE_SQL}), met AS (SELECT DISTINCT query AS x, name AS y FROM hits WHERE query <> '' AND name <> ''), {oracle.similarities('met')},
    cores AS (SELECT x, y, {oracle.CORE.format('x')} AS cx, {oracle.CORE.format('y')} AS cy FROM alike), skeletons AS (SELECT *, {oracle.SKELETON.format('cx')} AS kx, {oracle.SKELETON.format('cy')} AS ky FROM cores),
    core_pairs AS (SELECT cx AS x, cy AS y FROM skeletons WHERE cx <> '' AND cy <> '' UNION SELECT kx, ky FROM skeletons WHERE kx <> '' AND ky <> ''), {oracle.similarities('core_pairs', 'core_alike')},
    fit AS (SELECT k.x, k.y FROM skeletons k LEFT JOIN core_alike c ON c.x = cx AND c.y = cy LEFT JOIN core_alike d ON d.x = kx AND d.y = ky WHERE cx = '' AND cy = '' OR cx <> '' AND cy <> '' AND greatest(coalesce(c.set_score, 0), coalesce(d.set_score, 0)) >= 80),
    best AS (SELECT place, poi, (set_score * 0.6::DOUBLE + sort_score * 0.4::DOUBLE) / 100::DOUBLE AS confidence, set_score, hit FROM hits JOIN alike a ON a.x = query AND a.y = name JOIN fit f ON f.x = query AND f.y = name
             WHERE set_score >= 87 AND sort_score >= 75 AND NOT coalesce({oracle.HAVERSINE.format('centre_lat', 'centre_lon', 'lat', 'lon')} > 25, false) QUALIFY row_number() OVER (PARTITION BY place ORDER BY confidence DESC, set_score DESC, hit) = 1)
    SELECT place, poi, round(confidence, 3) AS match_confidence FROM best WHERE confidence >= 0.87""")
def judged_remote(spark, sf_dir):
    """The hits that a geocoder gave for each place, ten of the nearest keys, judged by the guards of the local pass."""
    own = places(spark, sf_dir).filter(reads.has_point())
    keys = F.explode(F.sequence(F.col("id"), F.col("id") + 9)).alias("hit")
    asked = own.select(F.col("id").alias("place"), text.canon(F.col("name_he")).alias("query"), F.when(F.col("id") % 3 > 0, F.col("lat")).alias("centre_lat"), F.when(F.col("id") % 3 > 0, F.col("lng")).alias("centre_lon"), keys)
    named = text.canon(F.concat("name_he", F.when(F.col("id") % 4 == 0, " the").otherwise("")))
    hits = own.select(F.col("id").alias("hit"), F.col("id").alias("poi"), named.alias("name"), "lat", F.col("lng").alias("lon"))
    found = resolve.judged(asked.join(hits, "hit"), limit=None)
    return found.filter(F.col("match_confidence") >= resolve.MATCH_CONFIDENCE).withColumn("match_confidence", F.round("match_confidence", 3))


@query(SQL["near_places"])
def near_sorted_places(spark, sf_dir):
    """Places near a point, from a table that is sorted along a curve."""
    path = _folder(spark, "curve")
    spatial.write(places(spark, sf_dir), path)
    return spatial.places_near(spark, path, *AT).select("id", "name_he", "category", F.round("distance_m", 3).alias("distance_m"))


@query(SQL["search_places"])
def search_indexed(spark, sf_dir):
    """The search box on an index of trigrams, the places added in two runs."""
    own, index = places(spark, sf_dir), SearchIndex(spark, _folder(spark, "search"))
    index.add(own.filter("id % 3 = 0"))
    index.add(own.filter("id % 3 <> 0"))
    return index.search(" a  SMALL").select("id", "name_he")
