"""Map links: what a pasted text says about a place, as Column expressions (only percent-decoding can fail, and then gives null)."""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placemill.functions import geo, text
from placemill.functions.color import let

# Hosts and the forms in which links carry a position or an identity.
SHORT_HOSTS = ["maps.app.goo.gl", "goo.gl", "g.co", "share.google"]
MAPS_HOST = r"^(?:maps\.)?google\.[a-z]{2,3}(?:\.[a-z]{2,3})?$"
NUMBER = r"-?\d{1,3}(?:\.\d+)?"
POSITIONS = [f"!8m2!3d({NUMBER})!4d({NUMBER})", f"!3d({NUMBER})!4d({NUMBER})", f"/@({NUMBER}),({NUMBER})[,/]", f"/maps/search/({NUMBER}),({NUMBER})"]
PAIR = rf"^\s*({NUMBER}),\s*({NUMBER})\s*$"
POSITION_PARAMETERS = ["q", "query", "ll", "center", "daddr", "sll"]
NOT_NAMES = [r"^-?\d+(?:\.\d+)?\s*,\s*-?\d+(?:\.\d+)?$", r"\d+°\d+'[\d.]+\"[NSEW]", r"(?i)^[23456789CFGHJMPQRVWX]{4,8}\+[23456789CFGHJMPQRVWX]{2,3}\b"]
INVISIBLE = "[‎‏‪-‮⁦-⁩​﻿]"
CAMERA = rf"APP_INITIALIZATION_STATE=\[\[\[(\d+(?:\.\d+)?(?:e\d+)?),({NUMBER}),({NUMBER})\]"
STATIC_MAP = r"https?://maps\.google(?:apis)?\.com/maps/api/staticmap\?[^\"'\s<>]+"
TITLE = r"<meta\s+content=\"([^\"]*)\"\s+(?:property=\"og:title\"|itemprop=\"name\")"
MAX_CAMERA_M, MIN_ZOOM = 5000, 14


def _match(subject: Column, pattern: str, group: int = 0) -> Column:
    return F.when(F.regexp_like(subject, F.lit(pattern)), F.regexp_extract(subject, pattern, group))


def url_host(url: Column) -> Column:
    return F.lower(_match(url, r"(?i)^https?://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def host_kind(url: Column) -> Column:
    """short, maps or null; a host is equal to a known one, or is nothing."""
    bare = F.regexp_replace(url_host(url), r"^www\.", "")
    return F.when(bare.isin(*SHORT_HOSTS), "short").when(F.regexp_like(bare, F.lit(MAPS_HOST)), "maps")


def first_map_url(pasted: Column) -> Column:
    """The first map link in a text, without the punctuation that prose adds at its end."""
    urls = F.transform(F.regexp_extract_all(pasted, F.lit(r"(?i)(https?://[^\s<>\"]+)"), F.lit(1)), lambda u: F.regexp_replace(u, r"[.,;:!?')\]}]+$", ""))
    return F.try_element_at(F.filter(urls, lambda u: host_kind(u).isNotNull()), F.lit(1))


def parameter(url: Column, name: str) -> Column:
    """The decoded value of a query parameter, null if it is missing."""
    raw = _match(url, rf"[?&]{name}=([^&#]*)", 1)
    return F.try_url_decode(raw)


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#]*([^?#]*)", 1)


def _pair(value: Column, pattern: str = PAIR) -> Column:
    point = lambda v: F.when(F.regexp_like(v, F.lit(pattern)), F.struct(*[F.regexp_extract(v, pattern, k).cast("double").alias(n) for k, n in ((1, "lat"), (2, "lng"))]))
    return let(value, point)


def position(url: Column) -> Column:
    """struct<lat, lng>: the marker, any marker, the view, the search path, then the parameters."""
    return F.coalesce(*[_pair(url, p) for p in POSITIONS], *[_pair(parameter(url, p)) for p in POSITION_PARAMETERS])


def identity(url: Column) -> Column:
    """The provider's own id of the listing, in the form that references have."""
    tagged = lambda tag, value: F.concat(F.lit(f"gmaps:{tag}"), value)
    feature = r"(?i)!1s(0x[0-9a-f]+:0x[0-9a-f]+)"
    place = F.coalesce(parameter(url, "query_place_id"), parameter(url, "place_id"))
    return F.coalesce(
        tagged("ftid/", F.lower(_match(url, feature, 1))), tagged("ftid/", F.lower(_match(parameter(url, "ftid"), r"(?i)^0x[0-9a-f]+:0x[0-9a-f]+$"))),
        tagged("cid/", _match(parameter(url, "cid"), r"^\d{1,20}$")), tagged("place/", _match(place, r"^[\w-]{10,128}$")), tagged("mid", _match(parameter(url, "kgmid"), r"^/g/\w{4,32}$")),
    )


def clean_name(raw: Column) -> Column:
    """A name, unless what stands there is empty, a position or a plus code."""

    def checked(name: Column) -> Column:
        odd = F.lit(False)
        for pattern in NOT_NAMES:
            odd = odd | F.regexp_like(name, F.lit(pattern))
        return F.when((name != "") & ~odd, F.substring(name, 1, 160))

    return let(F.trim(F.regexp_replace(raw, INVISIBLE, "")), checked)


def suggested_name(url: Column) -> Column:
    return clean_name(F.try_url_decode(_match(path(url), r"/maps/place/([^/@?]+)", 1)))


def parse_link(pasted: Column) -> Column:
    """struct<kind, lat, lng, provider_ref, name, url> of a pasted text; kind is one of pin, outside_israel, needs_expanding, no_position, search_share, not_a_map_link."""

    def facts(url: Column) -> Column:
        return F.struct(
            url.alias("url"), F.when(url.isNull(), _pair(pasted)).otherwise(position(url)).alias("at"), identity(url).alias("ref"), host_kind(url).alias("host"), (path(url) == "/search").alias("search"),
            suggested_name(url).alias("name"), clean_name(parameter(url, "q")).alias("q"),
        )

    def decided(f: Column) -> Column:
        at = f["at"]
        kind = (
            F.when(f["host"] == "short", "needs_expanding").when(f["url"].isNotNull() & f["search"], "search_share").when(at.isNull() & f["ref"].isNotNull(), "no_position")
            .when(at.isNull(), "not_a_map_link").when(geo.in_bounds(at["lat"], at["lng"]), "pin").otherwise("outside_israel")
        )
        return F.struct(f.alias("f"), kind.alias("kind"))

    def told(d: Column) -> Column:
        f, kind = d["f"], d["kind"]
        pinned, named = kind.isin("pin", "outside_israel"), kind.isin("pin", "no_position", "search_share")
        name = F.when(kind == "pin", f["name"]).when(kind == "no_position", F.coalesce(f["name"], f["q"])).when(kind == "search_share", f["q"])
        return F.struct(
            kind.alias("kind"), F.when(pinned, f["at"]["lat"]).alias("lat"), F.when(pinned, f["at"]["lng"]).alias("lng"), F.when(named, f["ref"]).alias("provider_ref"), name.alias("name"),
            F.when(kind.isin("needs_expanding", "no_position"), f["url"]).alias("url"),
        )

    return let(let(let(first_map_url(pasted), facts), decided), told)


def parse_page(html: Column) -> Column:
    """struct<lat, lng, name> of a listing's page: the preview's marker, its centre if close enough, else the camera; null without a point."""
    page = F.replace(html, F.lit("&amp;"), F.lit("&"))
    preview = _match(page, STATIC_MAP)
    marker = _pair(F.element_at(F.split(parameter(preview, "markers"), r"\|"), -1))
    centre = F.when(parameter(preview, "zoom").try_cast("double") >= MIN_ZOOM, _pair(parameter(preview, "center")))
    camera = F.when(
        _match(page, CAMERA, 1).try_cast("double") <= MAX_CAMERA_M, F.struct(_match(page, CAMERA, 3).cast("double").alias("lat"), _match(page, CAMERA, 2).cast("double").alias("lng"))
    )
    at = F.coalesce(marker, centre, camera)
    title = F.replace(F.replace(_match(page, TITLE, 1), F.lit("&#39;"), F.lit("'")), F.lit("&quot;"), F.lit('"'))
    return F.when(at.isNotNull(), F.struct(at["lat"].alias("lat"), at["lng"].alias("lng"), clean_name(F.element_at(F.split(title, " · "), 1)).alias("name")))


def feature_cid(ftid: Column) -> Column:
    """The decimal id in the second half of a feature id."""
    return F.conv(F.regexp_extract(ftid, r"(?i)0x[0-9a-f]+:0x([0-9a-f]+)", 1), 16, 10)


def _listing(body: str | None, feature: str | None) -> dict | None:
    """The listing with exactly this id in a nested search answer; never the most alike one."""
    if not body or not feature:
        return None
    try:
        stack = [json.loads(re.sub(r"^\)\]\}'\s*", "", body))]
    except ValueError:
        return None
    while stack:
        node = stack.pop()
        if not isinstance(node, list):
            continue
        if len(node) > 10 and isinstance(node[10], str) and node[10].lower() == feature.lower() and isinstance(node[9], list) and len(node[9]) > 3:
            lat, lng = node[9][2:4]
            if all(isinstance(x, int | float) and not isinstance(x, bool) for x in (lat, lng)):
                said = [re.sub(INVISIBLE, "", node[k]).strip()[:200] if len(node) > k and isinstance(node[k], str) else "" for k in (39, 166)]
                return {"lat": float(lat), "lng": float(lng), "address": said[0] or None, "city": said[1] or None}
        stack.extend(reversed(node))
    return None


LISTING = T.StructType([T.StructField(n, t) for n, t in (("lat", T.DoubleType()), ("lng", T.DoubleType()), ("address", T.StringType()), ("city", T.StringType()))])


def listing_of(body: Column, feature: Column) -> Column:
    kind = pa.struct([("lat", pa.float64()), ("lng", pa.float64()), ("address", pa.string()), ("city", pa.string())])

    def run(bodies: pa.Array, features: pa.Array) -> pa.Array:
        return pa.array([_listing(b, f) for b, f in zip(bodies.to_pylist(), features.to_pylist(), strict=True)], kind)

    return F.arrow_udf(run, LISTING)(body, feature)


def usable_point() -> Column:
    return F.col("lat").isNotNull() & F.col("lng").isNotNull() & ~F.col("location_precision").eqNullSafe("town")


def navigation() -> dict[str, Column]:
    """Links out by name: to the point where it is good enough to drive to, else a search."""
    c = F.col
    terms = text.encode_component(text.search_terms(c("name_he"), c("address_he"), c("city")))
    lat, lng = c("lat").cast("string"), c("lng").cast("string")
    osm = F.when(c("provider_ref").startswith("osm:"), F.concat(F.lit("https://www.openstreetmap.org/"), F.substring("provider_ref", 5, 200)))
    google, waze = F.lit("https://www.google.com/maps/search/?api=1&query="), F.lit("https://waze.com/ul?")
    return {
        "google": F.concat(google, F.when(usable_point(), F.concat(lat, F.lit("%2C"), lng)).otherwise(terms)),
        "waze": F.concat(waze, F.when(usable_point(), F.concat(F.lit("ll="), lat, F.lit(","), lng, F.lit("&navigate=yes"))).otherwise(F.concat(F.lit("q="), terms))),
        "osm": osm,
    }


def title_parts(title: Column) -> Column:
    """struct<name, address> of 'Name · Address'."""
    parts = F.split(title, " · ")
    return F.struct(F.trim(F.element_at(parts, 1)).alias("name"), F.trim(F.try_element_at(parts, F.lit(2))).alias("address"))
