import pytest
from pyspark.sql import functions as F

from lattica.operators import aggregate as A
from lattica.operators.filters import Facet, Filter, MetadataFilter, facets_filter, parse_filter

PRODUCTS = [("prod1", "electronics", "299.99", "10"), ("prod2", "electronics", "499.99", "5"), ("prod3", "clothing", "79.99", "20"), ("prod4", "clothing", "59.99", "15"), ("prod5", "books", "19.99", "50")]


@pytest.fixture(scope="module")
def products(spark):
    data = [(i, {"category": c, "price": p, "stock": s}) for i, c, p, s in PRODUCTS] + [("bare", None), ("odd", {"price": "cheap"})]
    return spark.createDataFrame(data, "id string, metadata map<string,string>")


@pytest.mark.parametrize(
    "text, ids",
    [
        ("price > 100", {"prod1", "prod2"}), ("price BETWEEN 50 AND 100", {"prod3", "prod4"}), ("stock = 10", {"prod1"}), ("category IN ('books', 'clothing') AND price < 60", {"prod4", "prod5"}),
        ("category = books OR category = clothing AND stock > 15", {"prod3", "prod5"}), ("NOT category = 'books'", {"prod1", "prod2", "prod3", "prod4"}), ("(stock > 15) AND (price < 50)", {"prod5"}),
        ("category LIKE 'ELEC%'", {"prod1", "prod2"}), ("category REGEX '^c'", {"prod3", "prod4"}), ("stock NOT IN (5, 10)", {"prod3", "prod4", "prod5"}), ("stock:50", {"prod5"}), ("stock:=50", {"prod5"}),
    ],
)
def test_parsed_filters(products, text, ids):
    assert {r["id"] for r in products.where(parse_filter(text).column()).collect()} == ids


def test_missing_keys_by_flavour(products):
    f = Filter("!=", "category", "books")
    assert "bare" not in {r["id"] for r in products.where(f.column()).collect()}
    assert {"bare", "odd"} <= {r["id"] for r in products.where(f.column(flavour="post")).collect()}
    assert not products.where(Filter("like", "category", "ELEC%").column(flavour="post")).count()


@pytest.mark.parametrize("text", ["", "price >", "price > 1 extra", "(price > 1", "price ~ 1"])
def test_bad_filters(text):
    with pytest.raises(ValueError):
        parse_filter(text)


def test_builder_is_empty_until_used():
    assert MetadataFilter().is_empty() and not MetadataFilter().equal("a", 1).is_empty()
    with pytest.raises(ValueError):
        MetadataFilter().build()


def test_facets(products):
    get = lambda k: F.element_at("metadata", k)
    found = products.where(facets_filter({"price": Facet("range", (50, None)), "category": Facet("prefix", "CLO")}, get))
    assert {r["id"] for r in found.collect()} == {"prod3", "prod4"}


def test_grouped_sums(products):
    get = lambda k: F.element_at("metadata", k)
    got = {r["category"]: r["value"] for r in A.aggregate(products, "sum", get("stock"), {"category": get("category")}).collect()}
    assert got == {"electronics": 15.0, "clothing": 35.0, "books": 50.0}
    assert A.aggregate(products.limit(0), "sum", get("stock")).first()["value"] == 0.0
    assert A.aggregate(products, "min", get("price")).first()["value"] == 19.99
    with pytest.raises(ValueError):
        A.aggregate(products, "sum")
    with pytest.raises(ValueError):
        A.aggregate(products, "count", by={})
