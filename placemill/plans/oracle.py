"""SQL that the oracle runs for name similarities, greedy clusters and colours, as common table expressions."""

from __future__ import annotations

CANON = "trim(regexp_replace(regexp_replace(lower(coalesce({0}, '')), '[^a-z0-9_'' ]', ' ', 'g'), ' +', ' ', 'g'))"


def similarities(pairs: str, name: str = "alike") -> str:
    """CTEs of `name` (x, y, indel, sort_score, set_score) for a relation of distinct canonical texts (x, y) of under 62 letters.

    The longest common subsequence goes letter by letter, with a bit for each letter of the other text.
    """
    words = lambda c: f"list_distinct(string_split({c}, ' '))"
    joined = lambda c: f"array_to_string(list_sort({c}), ' ')"
    return f"""{name}_t AS (SELECT x, y, {joined("string_split(x, ' ')")} AS sx, {joined("string_split(y, ' ')")} AS sy,
        {joined(f"list_intersect({words('x')}, {words('y')})")} AS common, {joined(f"list_filter({words('x')}, lambda w: NOT list_contains({words('y')}, w))")} AS ox,
        {joined(f"list_filter({words('y')}, lambda w: NOT list_contains({words('x')}, w))")} AS oy FROM {pairs}),
    {name}_p AS (SELECT x AS a, y AS b FROM {name}_t UNION SELECT sx, sy FROM {name}_t UNION SELECT ox, oy FROM {name}_t),
    {name}_r AS (SELECT a, b, 0::BIGINT AS i, (1::BIGINT << len(a)) - 1 AS v FROM {name}_p
        UNION ALL SELECT a, b, i + 1, ((v + u) | (v - u)) & ((1::BIGINT << len(a)) - 1) FROM (
            SELECT *, v & coalesce(list_sum(list_transform(range(1, len(a) + 1), lambda k: CASE WHEN substring(a, k, 1) = substring(b, i + 1, 1) THEN 1::BIGINT << (k - 1) ELSE 0::BIGINT END)), 0)::BIGINT AS u
            FROM {name}_r WHERE i < len(b))),
    {name}_l AS (SELECT a, b, bit_count(xor(v, (1::BIGINT << len(a)) - 1))::DOUBLE AS n FROM {name}_r WHERE i = len(b)),
    {name} AS (SELECT x, y, 200::DOUBLE * p.n / (len(x) + len(y)) AS indel, 200::DOUBLE * s.n / (len(sx) + len(sy)) AS sort_score,
        CASE WHEN common <> '' AND (ox = '' OR oy = '') THEN 100::DOUBLE ELSE greatest(100::DOUBLE * (1::DOUBLE - (len(ox) + len(oy) - 2 * o.n) / (lx + ly)),
            CASE WHEN common <> '' THEN 100::DOUBLE * (1::DOUBLE - (1 + len(ox))::DOUBLE / (len(common) + lx)) END, CASE WHEN common <> '' THEN 100::DOUBLE * (1::DOUBLE - (1 + len(oy))::DOUBLE / (len(common) + ly)) END) END AS set_score
        FROM (SELECT *, len(common) + (common <> '')::INT + len(ox) AS lx, len(common) + (common <> '')::INT + len(oy) AS ly FROM {name}_t) t
        JOIN {name}_l p ON p.a = x AND p.b = y JOIN {name}_l s ON s.a = sx AND s.b = sy JOIN {name}_l o ON o.a = ox AND o.b = oy)"""


GRAM_LIST = "flatten(list_transform(list_filter(string_split(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> ''), lambda w: list_transform(range(1, len(w) + 2), lambda k: substring('  ' || w || ' ', k, 3))))"


def word_similarities(pairs: str, name: str = "near_words") -> str:
    """CTEs of `name` (x, y, similarity): the best trigram similarity of one text's words to a stretch of the other's, either way."""
    return f"""{name}_g AS (SELECT x, y, list_distinct({GRAM_LIST.format('x')}) AS mine, {GRAM_LIST.format('y')} AS other FROM (SELECT x, y FROM {pairs} UNION SELECT y, x FROM {pairs})),
    {name}_e AS (SELECT x, y, mine, list_slice(other, f, t) AS part FROM {name}_g, unnest(range(1, len(other) + 1)) AS a(f), unnest(range(1, len(other) + 1)) AS b(t) WHERE t >= f),
    {name}_s AS (SELECT x, y, max(len(list_intersect(mine, part))::DOUBLE / (len(mine) + len(list_distinct(part)) - len(list_intersect(mine, part)))) AS s FROM {name}_e GROUP BY x, y),
    {name} AS (SELECT p.x, p.y, greatest(u.s, v.s) AS similarity FROM (SELECT DISTINCT x, y FROM {pairs}) p JOIN {name}_s u ON u.x = p.x AND u.y = p.y JOIN {name}_s v ON v.x = p.y AND v.y = p.x)"""


GENERIC = "('hotel', 'cafe', 'coffee', 'restaurant', 'bar', 'pizza', 'burger', 'the', 'and', 'of', '')"
CORE = f"array_to_string(list_filter(string_split({{0}}, ' '), lambda w: w NOT IN {GENERIC}), ' ')"
SKELETON = "trim(regexp_replace(lower(regexp_replace({0}, '[aeiou]|[^a-zA-Z0-9 ]', '', 'g')), ' +', ' ', 'g'))"
HAVERSINE = "2 * 6371::DOUBLE * asin(sqrt(pow(sin((radians({2}) - radians({0})) / 2), 2) + cos(radians({0})) * cos(radians({2})) * pow(sin((radians({3}) - radians({1})) / 2), 2)))"


def located(with_places: str, asked: str, medians: str) -> str:
    """All CTEs up to `located` (place, poi, name, lat, lng, street, town, category, confidence, exact, reason), every query against every name."""
    return f"""{with_places.replace("WITH places", "WITH RECURSIVE places", 1)}, medians AS ({medians}),
    asked AS (SELECT *, {CANON.format('name_he')} AS query, {CANON.format('city')} AS city_key FROM ({asked})),
    placed AS (SELECT a.*, m.lat AS c_lat, m.lon AS c_lon, coalesce(city, '') <> '' AND m.key IS NULL AS unresolved FROM asked a LEFT JOIN medians m ON m.key = a.city_key),
    space AS (SELECT id, {CANON.format('name_he')} AS name, lat, lng FROM places WHERE lat IS NOT NULL AND lng IS NOT NULL),
    met AS (SELECT DISTINCT a.query AS x, s.name AS y FROM (SELECT DISTINCT query FROM placed WHERE query <> '' AND NOT unresolved) a, (SELECT DISTINCT name FROM space) s), {similarities('met')},
    best AS (SELECT * FROM (SELECT x, y, set_score, sort_score, s.id, s.lat, s.lng, row_number() OVER (PARTITION BY x ORDER BY set_score DESC, s.id) AS n FROM alike JOIN space s ON s.name = y WHERE set_score >= 87) WHERE n <= 12),
    cores AS (SELECT *, {CORE.format('x')} AS cx, {CORE.format('y')} AS cy FROM (SELECT DISTINCT x, y FROM best)),
    skeletons AS (SELECT *, {SKELETON.format('cx')} AS kx, {SKELETON.format('cy')} AS ky FROM cores),
    core_pairs AS (SELECT cx AS x, cy AS y FROM skeletons WHERE cx <> '' AND cy <> '' UNION SELECT kx, ky FROM skeletons WHERE kx <> '' AND ky <> ''), {similarities('core_pairs', 'core_alike')},
    fit AS (SELECT k.x, k.y FROM skeletons k LEFT JOIN core_alike c ON c.x = cx AND c.y = cy LEFT JOIN core_alike d ON d.x = kx AND d.y = ky
            WHERE cx = '' AND cy = '' OR cx <> '' AND cy <> '' AND greatest(coalesce(c.set_score, 0), coalesce(d.set_score, 0)) >= 80),
    judged AS (SELECT a.place, b.id, (set_score * 0.6::DOUBLE + sort_score * 0.4::DOUBLE) / 100::DOUBLE AS confidence, set_score FROM placed a JOIN best b ON b.x = a.query JOIN fit f ON f.x = b.x AND f.y = b.y
               WHERE NOT unresolved AND sort_score >= 75 AND NOT coalesce({HAVERSINE.format('c_lat', 'c_lon', 'b.lat', 'b.lng')} > 25, false)),
    chosen AS (SELECT * FROM judged QUALIFY row_number() OVER (PARTITION BY place ORDER BY confidence DESC, set_score DESC, id) = 1),
    located AS (SELECT a.place, p.id::VARCHAR AS poi, 'osm:' || p.id AS provider_ref, p.name_he AS name_osm, p.lat, p.lng, CASE WHEN p.id IS NOT NULL THEN p.address_he || ', ' || p.city END AS address_he, p.category AS osm_category,
               round(confidence, 3) AS match_confidence, CASE WHEN query = '' THEN 'no_osm_match' WHEN unresolved THEN 'city_unresolved' WHEN p.id IS NULL THEN 'no_osm_match' WHEN confidence < 0.87 THEN 'low_match_confidence' END AS reason
               FROM placed a LEFT JOIN chosen c ON c.place = a.place LEFT JOIN places p ON p.id = c.id)"""


def clustered(with_places: str, records: str) -> str:
    """All CTEs up to `clusters` (id, block, cluster_id, position) and `records`: the greedy rule, record by record."""
    return f"""{with_places.replace("WITH places", "WITH RECURSIVE places", 1)}, records AS ({records}),
    keyed AS (SELECT id, name_he, {CANON.format('name_he')} AS he, CASE kind WHEN 'chain' THEN 'chain' WHEN 'online_only' THEN 'online' ELSE 'loc:' || {CANON.format('city')} END AS block FROM records),
    firsts AS (SELECT block, he, min((-len(name_he), name_he, id)) AS first FROM keyed GROUP BY block, he),
    listed AS (SELECT *, row_number() OVER (PARTITION BY block ORDER BY first) AS i FROM firsts),
    met AS (SELECT DISTINCT b.he AS x, a.he AS y FROM listed a JOIN listed b ON a.block = b.block AND a.i < b.i), {similarities('met')},
    same AS (SELECT b.block, b.i, list(a.i) AS earlier FROM listed b JOIN listed a ON a.block = b.block AND a.i < b.i JOIN alike ON x = b.he AND y = a.he WHERE sort_score >= 88 AND set_score >= 88 GROUP BY b.block, b.i),
    steps AS (SELECT l.block, l.i, l.he, coalesce(s.earlier, []::BIGINT[]) AS earlier FROM listed l LEFT JOIN same s ON s.block = l.block AND s.i = l.i),
    walk AS (SELECT block, 0::BIGINT AS i, []::BIGINT[] AS heads, 0::BIGINT AS head FROM (SELECT DISTINCT block FROM listed)
        UNION ALL SELECT w.block, s.i, CASE WHEN joined IS NULL THEN list_append(heads, s.i) ELSE heads END, coalesce(joined, s.i)
        FROM (SELECT w.block, s.i, heads, list_filter(heads, lambda h: list_contains(s.earlier, h))[1] AS joined FROM walk w JOIN steps s ON s.block = w.block AND s.i = w.i + 1) w JOIN steps s ON s.block = w.block AND s.i = w.i),
    ranked AS (SELECT block, i, head, dense_rank() OVER (PARTITION BY block ORDER BY head) - 1 AS cluster_id FROM walk WHERE i > 0),
    clusters AS (SELECT k.id, k.block, r.cluster_id, row_number() OVER (PARTITION BY k.block, r.cluster_id ORDER BY -len(k.name_he), k.name_he, k.id) - 1 AS position
        FROM keyed k JOIN listed l ON l.block = k.block AND l.he = k.he JOIN ranked r ON r.block = l.block AND r.i = l.i)"""


def delta_e(p: str, q: str) -> str:
    """The CIE's 2000 difference of two lab colours given as prefixes of columns l, a, b, as a scalar subquery."""
    seven = lambda c: f"sqrt(pow({c}, 7) / (pow({c}, 7) + pow(25::DOUBLE, 7)))"
    hue = lambda a, b: f"((degrees(atan2({b}, {a})) % 360 + 360) % 360)"
    cos = lambda d: f"cos(radians({d}))"
    return f"""(SELECT sqrt(pow(dl / sl, 2) + pow(dc / sc, 2) + pow(dh / sh, 2) - 2 * {seven('c')} * sin(radians(60 * exp(-pow((h - 275) / 25, 2)))) * (dc / sc) * (dh / sh)) FROM
        (SELECT *, 1 + 0.015::DOUBLE * pow(l - 50, 2) / sqrt(20 + pow(l - 50, 2)) AS sl, 1 + 0.045::DOUBLE * c AS sc,
            1 + 0.015::DOUBLE * c * (1 - 0.17::DOUBLE * {cos('h - 30')} + 0.24::DOUBLE * {cos('2 * h')} + 0.32::DOUBLE * {cos('3 * h + 6')} - 0.20::DOUBLE * {cos('4 * h - 63')}) AS sh FROM
        (SELECT l, dl, (cp + cq) / 2 AS c, cq - cp AS dc, 2 * sqrt(cp * cq) * sin(radians(CASE WHEN cp * cq = 0 THEN 0 WHEN hq - hp > 180 THEN hq - hp - 360 WHEN hq - hp < -180 THEN hq - hp + 360 ELSE hq - hp END) / 2) AS dh,
            CASE WHEN cp * cq = 0 THEN hp + hq WHEN abs(hq - hp) <= 180 THEN (hp + hq) / 2 WHEN hp + hq < 360 THEN (hp + hq) / 2 + 180 ELSE (hp + hq) / 2 - 180 END AS h FROM
        (SELECT ({p}l + {q}l) / 2 AS l, {q}l - {p}l AS dl, sqrt(pow(ap, 2) + pow({p}b, 2)) AS cp, sqrt(pow(aq, 2) + pow({q}b, 2)) AS cq, {hue('ap', f'{p}b')} AS hp, {hue('aq', f'{q}b')} AS hq FROM
        (SELECT {p}a * (1 + g) AS ap, {q}a * (1 + g) AS aq FROM (SELECT 0.5::DOUBLE * (1 - {seven(f"((sqrt(pow({p}a, 2) + pow({p}b, 2)) + sqrt(pow({q}a, 2) + pow({q}b, 2))) / 2)")}) AS g))))))"""
