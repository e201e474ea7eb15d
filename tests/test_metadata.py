from pyspark.sql import functions as F

from quire.functions.metadata import author_of, doi_of, language_of, title_of, year_of
from quire.operators.routing import cheapest, routed_models


def test_defaults(spark):
    one = lambda column: spark.range(1).select(column).first()[0]
    text = lambda v: F.lit(v).cast("string")
    titles = {("A title", "x.pdf"): "A title", ("N/A", "my_long-name.v2.pdf"): "my long name.v2", (None, ".hidden"): ".hidden", ("unknown", ""): "Untitled", ("none", "_.txt"): "_.txt", ("t" * 300, "x"): "t" * 255}
    assert {k: one(title_of(text(k[0]), text(k[1]))) for k in titles} == titles
    authors = {("Ibn A", "sahih.pdf"): "Ibn A", (None, "x.pdf"): "Anonymous", ("null", "The Sahih.pdf"): "Sahih International", ("Divinely given", "SAHIH"): "Sahih International", ("Divinely given", "x"): "Divinely given"}
    assert {k: one(author_of(text(k[0]), text(k[1]))) for k in authors} == authors
    assert [one(language_of(text(v))) for v in ("Arabic", "undefined", None)] == ["Arabic", "English", "English"]
    assert [one(year_of(text(v))) for v in ("c. 1995-1999", "95", "none", None)] == ["1995", None, None, None]
    assert [one(doi_of(text(v))) for v in (" https://doi.org/10.1/x ", "http://doi.org/10.2", "n/a", None)] == ["10.1/x", "10.2", None, None]


def test_routing(spark):
    prices = spark.createDataFrame([("lite", 0.1, False), ("eye", 0.2, True), ("alpha", 0.1, None), ("broken", None, True)], "model string, price double, vision boolean")
    assert tuple(cheapest(prices).first()) == ("alpha", "eye")
    rows = [(1, "google/lite", False, False), (2, "old-name", False, True), (3, "maker/x", False, False), (4, "auto", True, True), (5, None, False, True), (6, "", None, None), (7, "google/auto", False, False)]
    asked = spark.createDataFrame(rows, "n int, model string, vision boolean, has_key boolean")
    got = {r["n"]: (r["final_model"], r["router"]) for r in routed_models(asked, prices).collect()}
    assert got == {1: ("lite", False), 2: ("alpha", False), 3: ("maker/x", True), 4: ("eye", False), 5: ("openrouter/free", True), 6: ("alpha", False), 7: ("alpha", False)}
