"""Names, concepts and values shown on a page."""

import pytest
from pyspark.sql import functions as F

from skein.functions import names
from skein.operators.ranking import proof_triple


def value(spark, column, **cells):
    return spark.createDataFrame([tuple(cells.values())], ", ".join(f"{k} string" for k in cells)).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "name, base",
    [
        ("HOLMA 2-door cabinet - Varde dark grey", "holma 2-door cabinet"),
        ("Summer Linen Trousers Black", "summer linen trousers"),
        ("Rug £1,299.00 (large)", "rug"),
        ("coast matRM42.50", "coast mat"),
        ("Try 2 chairs", "try 2 chairs"),
        ("Option: Red chair | blue", "red chair"),
        ("Black", "black"),
    ],
)
def test_base_names(spark, name, base):
    assert value(spark, names.base_name(F.col("a")), a=name) == base


def test_same_product(spark):
    same = lambda a, b: value(spark, names.same_product(F.col("a"), F.col("b")), a=a, b=b)
    assert same("HOLMA, 2-door cabinet, Varde pale blue", "HOLMA 2-door cabinet, Varde dark grey")
    assert not same("Blender 30", "Blender 20") and not same("", "x") and same("", " ")


@pytest.mark.parametrize("shown, amount", [("£1,299.00", 1299.0), ("1.234,50 €", 1234.5), ("199 kr", 199.0), ("1'299", 1299.0), ("free", None), (None, None)])
def test_amounts(spark, shown, amount):
    assert value(spark, names.amount_of(F.col("a")), a=shown) == amount


def test_concepts(spark):
    concept = lambda n, k="text": value(spark, names.concept_of(F.col("a"), F.col("b")), a=n, b=k)
    assert [concept("Sale price"), concept("Title"), concept("Item-No"), concept("Fee", "money"), concept("Wash care"), concept("!!")] == ["price", "product_name", "sku", "price", "wash_care", "field"]
    assert value(spark, names.fits_concept("price", F.col("a")), a="data.offers[0].price") and not value(spark, names.fits_concept("price", F.col("a")), a="unitprice")
    ranks = [value(spark, names.concept_rank("sku", F.col("a")), a=p) for p in ("x.sku", "x.gtin13", "x.other")]
    assert ranks == [0, 4, 8]


def test_shown_on_page(spark):
    shown = lambda kind, v, source="api": value(spark, names.shown_on_page(kind, F.col("s"), F.col("v"), F.col("t")), s=source, v=v, t="<Oak &amp; Ash® Chair> now 1.299,50 €")
    assert shown("text", "Oak & Ash ® Chair") and not shown("text", "Elm") and shown("text", "Elm", "xpath")
    assert shown("money", "1299.50") and not shown("money", "1200") and shown("url", "https://x") is None and shown("text", None) is None


def test_proof_triples_fall_back(spark):
    frame = lambda rows: spark.createDataFrame(rows, "o int, n string, p double")
    pick = lambda rows: tuple(proof_triple(frame(rows), "n", "p", "o").first())
    assert pick([(0, "a", 1.0), (1, "a - red", 2.0), (2, "b", 1.0), (3, "c", 1.0), (4, "d", 3.0)]) == (0, 2, 4)
    assert pick([(0, "a", 1.0), (1, "b", 1.0), (2, "c", 1.0)]) == (0, 1, 2)
    assert pick([(0, "a", 1.0), (1, "a", 1.0), (2, "a", 1.0), (3, "b", 1.0)]) == (0, 1, 2)
    assert proof_triple(frame([(0, "a", 1.0)]), "n", "p", "o").count() == 0
