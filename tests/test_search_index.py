"""The index of trigrams against a scan of all places, also after places were added."""

import random

from placemill.operators import reads
from placemill.operators.search_index import SearchIndex

SCHEMA = "id long, name_he string, name_en string, city string, address_he string"


def test_search_by_index_is_the_scan(spark, tmp_path):
    r = random.Random(6)
    words = ["בורגר", "הבורגר", "קפה", "Café", "cafe", "garden", "a", "ab", "Tel-Aviv", "חיפה", "zoo", None, ""]
    some = lambda a, b: [(k, *(" ".join(filter(None, (r.choice(words) for _ in range(r.randint(0, 3))))) or None for _ in range(4))) for k in range(a, b)]
    first, second = spark.createDataFrame(some(0, 300), SCHEMA), spark.createDataFrame(some(300, 420), SCHEMA)
    index = SearchIndex(spark, str(tmp_path / "index"))
    index.add(first)
    for queries, every in ((["cafe gar", "בורגר"], first), (["cafe", "a", "ab zoo", "", "  ", "CAFÉ  חיפה", "tel aviv", "nothing", "בורגר קפה", "arde"], first.union(second))):
        if every is not first:
            index.add(second)
        for q in queries:
            got, want = (sorted(x["id"] for x in f.select("id").collect()) for f in (index.search(q), reads.search(every, q)))
            assert got == want, q
    assert index.lookup("a ab") is None and "PushedFilters: [In(gram" in index.lookup("garden")._jdf.queryExecution().toString()
