"""Names, notes and keys as Column expressions.

Only Unicode normalisation needs Python (`nfkc`, `nfkd`: Arrow UDFs); everything around it stays in the JVM.
"""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# They decide which spellings are one name.
GERESH = "׳'’`′"
GERSHAYIM = "״“”″"
DIGRAPHS = {"ג'": "j", "צ'": "ch", "ז'": "zh", "ת'": "th", "ד'": "dh"}
LETTERS = {
    "א": "", "ב": "b", "ג": "g", "ד": "d", "ה": "h", "ו": "v", "ז": "z", "ח": "h", "ט": "t", "י": "y", "כ": "k", "ך": "k", "ל": "l", "מ": "m",
    "ם": "m", "נ": "n", "ן": "n", "ס": "s", "ע": "", "פ": "p", "ף": "p", "צ": "ts", "ץ": "ts", "ק": "k", "ר": "r", "ש": "sh", "ת": "t",
}
ALIASES = {
    "ydn 2000": "עידן 2000",
    "ydv 2000": "עידן 2000",
    "skchrs": "סקצ'רס",
    "skchr": "סקצ'רס",
    "skttsrs": "סקצ'רס",
    "mnyh jyns": "מאניה ג'ינס",
    "mnyh gyns": "מאניה ג'ינס",
    "mn jns": "מאניה ג'ינס",
}
GENERIC_WORDS = [
    "מלון", "מלונות", "בית", "אכסניה", "אכסניית", "הוסטל", "צימר", "צימרים",
    "וילה", "וילות", "כפר", "נופש", "אירוח", "סוויטת", "סוויטות",
    "מסעדה", "מסעדת", "קפה", "בר", "פאב", "פיצה", "פיצרייה", "שווארמה",
    "פלאפל", "חומוס", "סושי", "בורגר", "המבורגר", "שיפודי", "שיפודיה",
    "גלידת", "גלידה", "מאפיית", "מאפייה", "בייקרי", "קונדיטוריה",
    "חנות", "חנויות", "רשת", "סניף", "סניפי", "מרכז", "מועדון", "יקב",
    "נעלי", "ביגוד", "בגדי", "אתר", "משרד",
    "hotel", "cafe", "coffee", "restaurant", "bar", "pizza", "burger",
    "the", "and", "of",
]
MOBILE = r"\b0(5\d)[\s\-.]?(\d{3})[\s\-.]?(\d{4})\b"
MASKED = "05X-XXXXXXX"
HEADER_MARKERS = ["מקום שבו", "תאריך דיווח", "מקומות שבהם", "החזר זוגי"]
#: Marks that search ignores: Latin ones and vowel points (the range holds the maqaf too), quotes, and dashes that become spaces.
MARKS = "[̀-֑ͯ-ׇ]"
QUOTES = "[׳״'\"`‘’“”]"
DASHES = "[־‐-―-]"


def _normalised(form: str):
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else t if t.isascii() else unicodedata.normalize(form, t) for t in texts.to_pylist()], pa.string())

    return F.arrow_udf(run, T.StringType())


def nfkc(text: Column) -> Column:
    return _normalised("NFKC")(text)


def nfkd(text: Column) -> Column:
    return _normalised("NFKD")(text)


def spaced(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def canon(text: Column) -> Column:
    """A name without case, punctuation and typographic quotes; null is empty."""
    plain = F.translate(F.translate(nfkc(F.coalesce(text, F.lit(""))), GERESH, "'" * len(GERESH)), GERSHAYIM, '"' * len(GERSHAYIM))
    return spaced(F.regexp_replace(F.lower(plain), r"[^\p{L}\p{N}_\s']", " "))


def skeleton_of(canonical: Column) -> Column:
    """The consonants of a canonical name in Latin letters, so that two scripts can meet."""
    out = canonical
    for pair, latin in DIGRAPHS.items():
        out = F.replace(out, F.lit(pair), F.lit(latin.upper()))  # upper case: kept from the vowel rule below
    for letter, latin in LETTERS.items():
        if len(latin) != 1:
            out = F.replace(out, F.lit(letter), F.lit(latin.upper()))
    single = {k: v for k, v in LETTERS.items() if len(v) == 1}
    out = F.translate(out, "".join(single), "".join(single.values()))
    return spaced(F.lower(F.regexp_replace(out, r"[aeiou]|[^a-zA-Z\p{Nd}\s]", "")))


def skeleton(text: Column) -> Column:
    return skeleton_of(canon(text))


def sorted_words(text: Column) -> Column:
    return F.array_join(F.array_sort(F.filter(F.split(text, " "), lambda w: w != "")), " ")


def alias_of(name_he: Column, name_en: Column, aliases: dict[str, str] | None = None) -> Column:
    """The published spelling of a known brand, by its English name first; null for others."""
    table = F.create_map(*[F.lit(x) for k, v in (aliases or ALIASES).items() for x in (" ".join(sorted(k.split())), v)])
    return F.coalesce(*[F.try_element_at(table, F.nullif(sorted_words(skeleton(n)), F.lit(""))) for n in (name_en, name_he)])


def fingerprint(text: Column) -> Column:
    """Identity of a free-text cell that ignores order, punctuation, script edges and a link's scheme; null is empty."""
    edges = F.regexp_replace(nfkc(F.coalesce(text, F.lit(""))), r"(?<=[֐-׿])(?=[A-Za-z0-9])|(?<=[A-Za-z0-9])(?=[֐-׿])", " ")
    words = F.split(F.lower(F.regexp_replace(edges, r"[^\p{L}\p{N}_֐-׿]+", " ")), r"(?U)\s+")
    return F.array_join(F.array_sort(F.filter(words, lambda w: ~w.isin("", "http", "https"))), " ")


def distinctive_of(canonical: Column) -> Column:
    """The words of a canonical name that say which business it is."""
    return F.array_join(F.filter(F.split(canonical, " "), lambda w: (w != "") & ~w.isin(*GENERIC_WORDS)), " ")


def fold(text: Column) -> Column:
    """A text as the search box compares it."""
    plain = F.regexp_replace(F.regexp_replace(nfkd(F.lower(F.coalesce(text, F.lit("")))), MARKS, ""), QUOTES, "")
    return spaced(F.regexp_replace(plain, DASHES, " "))


def haystack(name_he: Column, name_en: Column, city: Column, address: Column) -> Column:
    return fold(F.concat_ws(" ", *[F.nullif(c, F.lit("")) for c in (name_he, name_en, city, address)]))


def squash(text: Column) -> Column:
    """A cell without bidirectional marks, runs of white space and stray separators at its ends."""
    plain = spaced(F.translate(nfkc(text), "‎‏ ﻿", "    "))
    return F.regexp_replace(plain, r"^[\s,;.\-–]+|[\s,;]+$", "")


def is_header_row(cells: Column) -> Column:
    joined = F.concat_ws(" ", F.filter(cells, lambda c: c != ""))
    return sum((F.contains(joined, F.lit(m)).cast("int") for m in HEADER_MARKERS), F.lit(0)) >= 2


def mask_mobiles(text: Column) -> Column:
    return F.regexp_replace(text, MOBILE, MASKED)


def strip_mobiles(text: Column) -> Column:
    """Without mobile numbers and the separators that they leave at the ends; nothing left is null."""
    return F.nullif(F.btrim(F.regexp_replace(text, MOBILE, ""), F.lit(" ,-")), F.lit(""))


def is_personal_phone(phone: Column, kind: Column) -> Column:
    mobile = F.regexp_like(phone, F.lit(MOBILE)) & ~F.coalesce(kind == "business", F.lit(False))
    return F.coalesce(phone != "", F.lit(False)) & (F.coalesce(kind == "personal", F.lit(False)) | mobile)


def scrub_phone(phone: Column, kind: Column) -> Column:
    return F.when(~is_personal_phone(phone, kind), F.nullif(phone, F.lit("")))


def cache_key(version: str, model: str, text: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("\0", F.lit(version), F.lit(model), text), 256), 1, 32)


def client_address(forwarded: Column, real: Column) -> Column:
    first = F.nullif(F.trim(F.element_at(F.split(forwarded, ","), 1)), F.lit(""))
    return F.coalesce(first, F.nullif(real, F.lit("")), F.lit("unknown"))


def reporter_hash(salt: str, address: Column) -> Column:
    return F.substring(F.sha2(F.concat(F.lit(f"{salt}:"), address), 256), 1, 32)


def source_key(provider_ref: Column, is_chain: Column, is_online: Column, name: Column, city: Column) -> Column:
    prefix = F.when(F.coalesce(is_chain, F.lit(False)), "chain").when(F.coalesce(is_online, F.lit(False)), "online").otherwise("unlocated")
    place = F.nullif(F.lower(F.trim(F.coalesce(city, F.lit("")))), F.lit(""))
    own = F.concat(prefix, F.lit(":"), F.lower(spaced(name)), F.coalesce(F.concat(F.lit("@"), place), F.lit("")))
    return F.coalesce(F.nullif(provider_ref, F.lit("")), own)


def search_terms(name: Column, address: Column, city: Column) -> Column:
    said = F.concat(name, F.lit(" "), F.coalesce(address, F.lit("")))
    town = F.nullif(city, F.lit(""))
    return F.concat_ws(" ", name, F.nullif(address, F.lit("")), F.when(~F.contains(said, town), town))


def encode_component(text: Column) -> Column:
    """Percent-encoding that leaves A-Z a-z 0-9 - _ . ! ~ * ' ( ) alone, and writes a space as %20."""
    out = F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))
    for code, char in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(char))
    return out


def tel_href(phone: Column) -> Column:
    return F.concat(F.lit("tel:"), F.regexp_replace(phone, r"[^\d+]", ""))


def external_url(url: Column) -> Column:
    return F.when(F.regexp_like(url, F.lit("(?i)^https?://")), url).otherwise(F.concat(F.lit("https://"), url))


# Right-to-left repair of text that was drawn glyph by glyph.
HEBREW = "[֐-׿יִ-ﭏ]"
MIRRORED = ("()[]{}<>“”", ")(][}{><”“")
ISLAND = r"[A-Za-z0-9][A-Za-z0-9.,:/&+_'\-]*"


def fix_token(token: Column) -> Column:
    """A drawn word in reading order: Hebrew is turned round, with its Latin and number islands turned back."""
    turned = F.reverse(F.translate(token, *MIRRORED))
    # split into islands and the rest, and turn each island back
    marked = F.regexp_replace(turned, f"({ISLAND})", "\u0001$1\u0002")
    parts = F.regexp_extract_all(marked, F.lit("(\u0001[^\u0002]*\u0002|[^\u0001]+)"), F.lit(1))
    fixed = F.transform(parts, lambda p: F.when(p.startswith("\u0001"), F.reverse(F.translate(p, "\u0001\u0002", ""))).otherwise(p))
    return F.when(F.regexp_like(token, F.lit(HEBREW)), F.array_join(fixed, "")).otherwise(token)


def order_run(tokens: Column) -> Column:
    """Words drawn left to right in reading order: groups go right to left, a group of Latin words keeps its order."""
    latin = lambda t: F.regexp_like(t, F.lit("[A-Za-z]")) & ~F.regexp_like(t, F.lit(HEBREW))
    empty = F.array().cast("array<struct<latin:boolean,words:array<string>>>")

    def add(groups: Column, token: Column) -> Column:
        last = F.try_element_at(groups, F.lit(-1))
        join = F.coalesce(latin(token) & last["latin"], F.lit(False))
        one = F.struct(latin(token).alias("latin"), F.array(token).alias("words"))
        more = F.struct(F.lit(True).alias("latin"), F.concat(last["words"], F.array(token)).alias("words"))
        return F.when(join, F.concat(F.slice(groups, 1, F.greatest(F.size(groups) - 1, F.lit(0))), F.array(more))).otherwise(F.concat(groups, F.array(one)))

    groups = F.reverse(F.aggregate(tokens, empty, add))
    return F.array_join(F.transform(groups, lambda g: F.array_join(F.transform(g["words"], fix_token), " ")), " ")
