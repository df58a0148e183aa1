import pytest
from support import rows

from tenderloom.operators import catalog as K


@pytest.fixture(scope="module")
def articles(spark):
    return spark.createDataFrame(
        [
            (1, "4006381333931", "Bosch drill GSR", "Bosch", "Tools"),
            (2, "4006381333932", "Bosch hammer", "Bosch", "Tools"),
            (3, "0012345678905", "Makita drill", "Makita", "Tools"),
            (4, "1400000000007", "Bosch drill kit", "Bosch", "Office"),
            (5, "", "No code", None, "Office"),
        ],
        "article_id INT, ean STRING, article_name STRING, brand STRING, category_name STRING",
    )


def test_audit(articles):
    got = rows(K.audit_ean_catalog(articles))
    assert ("EAN-13", True, None, "Germany", 1) in got
    assert ("EAN-13", False, "Wrong check digit.", "Germany", 1) in got
    assert (None, False, "EAN must contain only digits.", "Unknown", 1) in got
    assert {r[3] for r in got} == {"Germany", "United States", "Unknown / Unassigned", "Unknown"}


def test_country_lookup_is_an_equi_join(articles):
    plan = K.tag_issuing_country(articles)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "NestedLoop" not in plan


def test_lookup(spark, articles):
    keys = spark.createDataFrame([("4006-381333931",), ("9999",)], "lookup STRING")
    got = rows(K.lookup_ean(keys, articles).select("lookup", "article_id", "hint"))
    assert got == [("4006-381333931", 1, None), ("9999", None, K.NOT_FOUND_HINT)]


def test_prefixes(spark, articles):
    keys = spark.createDataFrame([("400*",), ("4006381333931",), ("77",), ("*",)], "prefix STRING")
    got = rows(K.prefix_search(keys, articles).select("prefix", "article_id"))
    assert got == [("400*", 1), ("400*", 2), ("4006381333931", 1)]


def test_names(spark, articles):
    terms = spark.createDataFrame([("DRILL bosch",), ("drill",), ("saw",), ("dril",)], "term STRING")
    assert rows(K.name_search(terms, articles).select("term", "article_id")) == [
        ("DRILL bosch", 1),
        ("DRILL bosch", 4),
        ("drill", 1),
        ("drill", 3),
        ("drill", 4),
    ]
    only = K.name_search(terms, articles, category="Office", brand="Bosch")
    assert rows(only.select("term", "article_id")) == [("DRILL bosch", 4), ("drill", 4)]


def brute_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("edits", [1, 2])
def test_similar_names_equal_brute_force(spark, edits):
    names = ["drill", "drills", "drlil", "trill", "thrill", "dr", "d", "rill", "grille", "krill 2"]
    terms = ["drill", "DRIL", "kril 2", "d", "zzz"]
    catalog = spark.createDataFrame(list(enumerate(names)), "article_id INT, article_name STRING")
    got = K.similar_names(spark.createDataFrame([(t,) for t in terms], "term STRING"), catalog, 100, edits)
    expected = {
        (t, n, brute_distance(t.lower(), n)) for t in terms for n in names if brute_distance(t.lower(), n) <= edits
    }
    assert {(r.term, r.article_name, r.distance) for r in got.collect()} == expected


def test_similar_names_take_the_nearest(spark):
    catalog = spark.createDataFrame([(i, "abcd") for i in range(50)] + [(99, "abc")], "article_id INT, article_name STRING")
    got = K.similar_names(spark.createDataFrame([("abc",)], "term STRING"), catalog, 3)
    assert rows(got.select("match_rank", "article_id")) == [(1, 99), (2, 0), (3, 1)]
    with pytest.raises(ValueError):
        K.similar_names(catalog, catalog, 3, max_edits=3)


def test_long_terms_meet_only_what_shares_a_long_piece(spark):
    from tenderloom.operators.matching import rarest_key_pairs, text_grams

    texts = ["saw 123 231 312 1231", "ean 1231231231231 here", "12312312312", "x", ""]
    items = spark.createDataFrame(list(enumerate(texts)), "article_id INT, text STRING")
    terms = spark.createDataFrame([(t, t) for t in ("1231231231231", "23", "x", "231 31", "saw 12")], "term STRING, text STRING")
    pairs = rarest_key_pairs(
        text_grams(terms, "term", "text", whole_if_short=True), text_grams(items, "article_id", "text"), "term", "article_id"
    )
    got = rows(pairs)
    # All grams of three letters of the barcode are in the first text too.
    assert got == [("1231231231231", 1), ("23", 0), ("23", 1), ("23", 2), ("231 31", 0), ("saw 12", 0), ("x", 3)]
