import time
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from quire.functions import markup
from quire.functions import text as T
from quire.functions.vector import DIMENSIONS, cosine_distance, hashed_embedding, hashed_vector
from quire.sources.languages import language_names


def one(spark, column, *values, schema="x string"):
    return [r[0] for r in spark.createDataFrame([v if isinstance(v, tuple) else (v,) for v in values], schema).select(column).collect()]


def test_csv_guard(spark):
    bad = ["=SUM(A1:A10)", "+cmd", "-2+3", "@SUM(1,2)", "  =1+1", "\t=x", "   +1234"]
    assert one(spark, T.csv_guard("x"), *bad) == ["'" + b for b in bad]
    assert one(spark, T.csv_guard("x"), "Normal Document Title", None) == ["Normal Document Title", None]


def test_money(spark):
    rows = [("0.027", "IDR", 16300.0), ("0.027", "SAR", 3.75), ("0.027", "USD", 1.0), ("1234.5", "USD", 1.0), ("1234.5", "IDR", 16200.0), ("0.125", "EUR", 1.0)]
    found = one(spark, T.money("a", "c", "r"), *rows, schema="a string, c string, r double")
    assert found == ["Rp 440 (~$0.0270)", "SR 0.10 (~$0.0270)", "$0.0270", "$1234.50", "Rp 19,998,900 (~$1234.50)", "€0.12 (~$0.12)"]


def test_currency(spark):
    assert one(spark, T.currency_of("x"), "id-ID,id;q=0.9", "ar-SA", "de-DE", "en-GB", "en-US", None) == ["IDR", "SAR", "EUR", "GBP", "USD", "USD"]
    assert one(spark, T.currency_of("x", F.lit("TRY")), "id-ID") == ["TRY"]


def test_costs(spark):
    cost = lambda name, **k: one(spark, T.model_cost(F.lit(name), F.lit(10000), F.lit(5000), **k), "x")[0]
    assert cost("gemini-3.5-flash") == Decimal("0.060000") and cost("some-embedding") == 0 and cost("x-lite") == Decimal("0.010000")
    price = lambda v: F.lit(v).cast("decimal(20,12)")
    assert cost("pro", price_in=price("0.00000125"), price_out=price("0.00001")) == Decimal("0.062500")
    assert one(spark, T.router_cost(F.lit("a:free"), F.lit(1), F.lit(1)), "x") == [0]


def test_percent_and_compact(spark):
    rows = [("30", "100"), ("0", "100"), ("50", "0"), (None, None), ("invalid", "total")]
    assert one(spark, T.percent("a", "b"), *rows, schema="a string, b string") == [30, 0, 100, 100, 0]
    assert one(spark, T.compact_number("x"), "1500000", "45200", "350", None, "invalid") == ["1.5M", "45.2K", "350", "0", "0"]


def test_language(spark):
    names = language_names(spark)
    values = ["ar", "id", "bahasa", "english", "Unknown", "xyz", "", None]
    assert one(spark, T.normal_language("x", names), *values) == ["Arabic", "Indonesian", "Indonesian", "English", "Unknown", "Xyz", "Unknown", "Unknown"]
    # bibliographic codes, names and codes of their own, and codes that are not known
    want = {
        "ger": "German", "FRE": "French", "chi": "Chinese", "dut": "Dutch", "gre": "Greek", "per": "Persian (Farsi)", "fas": "Persian (Farsi)", "farsi": "Persian (Farsi)", "cze": "Czech", "ces": "Czech", "rum": "Romanian",
        "slo": "Slovak", "bur": "Burmese", "arm": "Armenian", "geo": "Georgian", "mal": "Malay", "msa": "Malay", "fil": "Filipino", "tl": "Filipino", "tagalog": "Filipino", "nor": "Norwegian", "nb": "Norwegian", "ben": "Bengali",
        "zh-hans": "Chinese (Simplified)", "zh-hant": "Chinese (Traditional)", "heb": "Hebrew", "he": "Hebrew", "ind": "Indonesian", "kur": "Kurdish", "pus": "Pashto", "lao": "Lao", "swa": "Swahili", "uz": "Uzbek", "yor": "Yoruba", "hau": "Hausa",
        "mya": "Mya", "hye": "Hye", "is": "Is", "isl": "Isl", "icelandic": "Icelandic",
    }
    assert one(spark, T.normal_language("x", names), *want) == list(want.values())
    # of 66 languages: both codes and the name, less four codes, and the others beside them
    assert 195 <= len(names) <= 215 and all(names.values())


def test_preference(spark):
    yes = ["remember that I prefer short answers", "always write responses in Arabic", "I prefer classical sources"]
    assert one(spark, T.is_preference("x"), *yes, "what is the capital of France?", "when was this book written?", None) == [True] * 3 + [False] * 3


def test_retry_delay_and_errors(spark):
    values = ["Please retry in 14.059141309s.", "{'retryDelay': '14s'}", '"retryDelay": "15"', "generic", "Retry in 5.s", "retryDelay: 7s", '"retryDelay": 7']
    assert one(spark, T.retry_delay("x"), *values) == [14.059141309, 14.0, 15.0, None, 5.0, None, None]
    assert one(spark, T.is_rate_limit("x"), "429 Too Many Requests", "Daily quota exceeded", "Internal Server Error", None) == [True, True, False, False]
    assert one(spark, T.is_cascadable("x"), "Model NOT_FOUND", "fine") == [True, False]


def test_client_ip(spark):
    rows = [("192.168.1.1, 10.0.0.1, 127.0.0.1", "1.1.1.1"), (None, "10.0.0.1"), (None, None), ("", "")]
    assert one(spark, T.client_ip("a", "b"), *rows, schema="a string, b string") == ["192.168.1.1", "10.0.0.1", "127.0.0.1", "127.0.0.1"]


def test_actions_and_details(spark):
    assert one(spark, T.action_name("x"), "delete", " upload-fresh ", "Pipeline failed", None) == ["DELETE", "UPLOAD", "EXTRACTION_FAILED", ""]
    rows = [("said", "{}"), ("", '{"details": "inside"}'), (None, '{"k": 1}'), (None, None)]
    assert one(spark, T.audit_details("a", "b"), *rows, schema="a string, b string") == ["said", "inside", '{"k": 1}', ""]


def test_excerpt_slug_ids(spark):
    assert one(spark, T.excerpt("x"), " a\n\n b ", "y" * 600, None) == ["a b", "y" * 500 + "...", ""]
    assert one(spark, T.slug("x"), "Hello,  World -- x_1!", "  ") == ["hello-world-x_1", ""]
    assert one(spark, T.id_list("x"), "1, 2,,x, 3", None) == [[1, 2, 3], []]
    assert one(spark, T.quoted_yaml("x"), "title: A \"b\"\nlist:\n  - x\nauthor: 'Me'") == ['title: "A \\"b\\""\nlist:\n  - x\nauthor: "Me"']
    assert one(spark, T.log_line(F.lit("GET"), "x", F.lit(200), F.lit("5ms")), "http://h/p?q=1") == ["HTTP GET /p?q=1 - Status: 200 - Latency: 5ms"]
    assert one(spark, T.known("x"), "N/A", " none ", "Nature", "") == [None, None, "Nature", None]


PARAGRAPHS = "Paragraph 1 is here.\n\nParagraph 2 is slightly longer but splits on newline boundaries.\n\nParagraph 3 is also here."


def test_chunks(spark):
    p1, p2, p3 = PARAGRAPHS.split("\n\n")
    assert one(spark, T.chunks("x", F.lit(100)), PARAGRAPHS) == [[p1 + "\n\n" + p2, p3]]
    headed = "## Page 1\n### Surah One\n" + "آية. " * 30 + "\n### Surah Two\n" + "آية. " * 30
    (found,) = one(spark, T.chunks("x", F.lit(150)), headed)
    assert len(found) >= 2 and any("Surah One" in c for c in found) and any("Surah Two" in c for c in found)
    assert one(spark, T.chunks("x", F.lit(10)), "", None, "a" * 30) == [[], [], ["a" * 30]]
    assert one(spark, T.chunks("x", F.lit(12)), "One two. Three four. Five") == [["One two.", "Three four.", "Five"]]
    assert one(spark, T.chunk_size("x"), "Arabic", "Hungarian", "English", None) == [500, 500, 1200, 1200]


def test_chunk_metadata(spark):
    text = "## Page 3\nChapter One: Start\nbody words"
    df = spark.createDataFrame([(text,), ("plain text",)], "x string").select(T.chunk_page("x").alias("p"), T.chunk_chapter("x").alias("c"), T.word_count("x").alias("n"))
    assert [tuple(r) for r in df.collect()] == [(3, "Page 3", 8), (1, "", 2)]
    assert [r[0] for r in df.select(T.chunk_anchor(F.col("p"), F.col("c"))).collect()] == ["p3-page-3", "page-1"]


def test_embedding(spark):
    import numpy as np

    a, b = hashed_vector("text"), hashed_vector("other")
    assert len(a) == DIMENSIONS and abs((a**2).sum() - 1) < 1e-12 and (a == hashed_vector("text")).all() and not (a == b).all() and hashed_vector("").sum() == 0
    (found,) = one(spark, hashed_embedding("x"), "text")
    assert np.allclose(found, a)
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 2.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(cosine_distance(F.col("a"), F.col("b"))).collect()] == [0.0, 1.0, None]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("<p>a<script>alert(1)</script><a href='javascript:x' title='t'>b</a></p>", '<p>a<a title="t">b</a></p>'),
        ("<font color=red>x</font><div dir='rtl' onclick=y>&amp; z</div>", 'x<div dir="rtl">&amp; z</div>'),
        ("<br><img src=x>1 < 2", "<br>1 &lt; 2"),
    ],
)
def test_sanitize(text, want):
    assert markup.sanitize(text) == want


def test_rtl_of_nested_and_open_elements():
    # an element goes up to the first closing tag of its name; what is inside stays as it is
    assert markup.tag_rtl("<div><p>السلام</p></div>") == '<div dir="rtl" class="arabic-text"><p>السلام</p></div>'
    assert markup.tag_rtl("<li>a<li>سلام</li></li>") == "<li>a<li>سلام</li></li>"
    assert markup.tag_rtl("<p>سلام <td>سلام</td>") == '<p>سلام <td dir="rtl" class="arabic-text">سلام</td>'
    assert markup.tag_rtl("""<P dir='ltr' class='k'>É سلام</P>""") == """<P dir="rtl" class='k arabic-text'>É سلام</P>"""
    assert markup.tag_rtl("<b>سلام</b>") == "<b>سلام</b>"
    began = time.perf_counter()
    markup.tag_rtl("<p>x" * 40_000 + "<td>س</td>" * 20_000)
    assert time.perf_counter() - began < 5


def test_rtl():
    assert markup.tag_rtl("<p>السلام</p>") == '<p dir="rtl" class="arabic-text">السلام</p>'
    assert markup.tag_rtl('<p class="x">12 السلام</p><p>Latin السلام</p>') == '<p class="x arabic-text" dir="rtl">12 السلام</p><p>Latin السلام</p>'


def test_render_and_front_matter():
    assert markup.render("# T\n\na **b** <script>x</script>\n\n- one\n- two") == "<h1>T</h1>\n<p>a <strong>b</strong> </p>\n<ul><li>one</li><li>two</li></ul>"
    assert "<th>a</th>" in markup.render("| a | b |\n|---|---|\n| 1 | 2 |")
    found = markup.front_matter('Introduction\n# Model-generated heading\nDetails\n```json\n[{"question": "q", "answer": "a"}]\n```')
    assert found == {"text": "Introduction\nDetails", "yaml": "", "pairs": [{"question": "q", "answer": "a"}]}
    assert markup.front_matter("---\ntitle: x\n---\nbody") == {"text": "body", "yaml": "title: x", "pairs": []}
    assert markup.front_matter("```yaml\na: 1\n```\nbody")["yaml"] == "a: 1"
    assert markup.slug_unicode("Tafsir  القرآن, 2!") == "tafsir-القرآن-2"


def test_long_texts_are_chunked_in_linear_time():
    found = T.chunk_text("word one.\n\n" * 150_000, 1200)
    assert "\n\n".join(found) == "\n\n".join(["word one."] * 150_000) and max(map(len, found)) <= 1200
    sentence = "a" * 50 + ". "
    assert max(map(len, T.chunk_text(sentence * 30_000, 500))) <= 500 and T.chunk_text("b" * 5000, 500) == ["b" * 5000]
