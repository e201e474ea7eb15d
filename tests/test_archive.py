import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from quire.operators import archive as A
from quire.sources.bundle import BundleSource, master_text

AT = "2024-02-01T00:00:00+00:00"


def docs(spark):
    rows = [
        (3, "Tafsir: Book", "Ibn A", "Arabic", "PDF", "h3", "c.pdf", 4, 1_500_000, "raw 3", "refined 3"),
        (1, "Tafsir: Book", "Ibn A", "Arabic", "CSV", "h1", "a.csv", 2, 250_000, "raw 1", None),
        (7, "!!!", None, "", None, "h7", "old name.txt", None, None, None, ""),
        (9, None, "É. B", "French", "TXT", "h9", None, 1, 0, "raw 9", None),
    ]
    kinds = "doc_id long, title string, author string, language string, document_type string, file_hash string, original_filename string, page_count int, cost_micro long, raw_markdown string, refined_markdown string"
    return spark.createDataFrame(rows, kinds).repartition(3)


def test_files_and_master(spark):
    made = A.archived(docs(spark), AT)
    found = {r["path"]: r["content"] for r in A.files(made).collect()}
    names = ["001_tafsir-book", "002_tafsir-book", "003_document_7", "004_document_9"]
    folders = [("arabic", "ibn-a"), ("arabic", "ibn-a"), ("unknown", "unknown"), ("french", "é-b")]
    assert set(found) == {p for n, (lang, author) in zip(names, folders, strict=True) for p in (f"documents/{n}.md", f"Language/{lang}/{n}.md", f"Author/{author}/{n}.md")}
    assert found["documents/002_tafsir-book.md"] == f'---\ntitle: "Tafsir: Book"\nauthor: "Ibn A"\nlanguage: "Arabic"\ndocument_type: "PDF"\nsource_hash: "h3"\nexported_at: "{AT}"\n---\n\nrefined 3'
    assert found["documents/003_document_7.md"].endswith(A.EMPTY) and found["Author/ibn-a/001_tafsir-book.md"].endswith("raw 1")
    section = {r["ordinal"]: r["section"] for r in A.master(made).collect()}[2]
    assert section.startswith("<!-- SOURCE_START_2: Tafsir: Book by Ibn A (Arabic) [Type: PDF, Hash: h3] -->") and section.endswith("refined 3\n\n<!-- SOURCE_END_2 -->\n\n---\n\n")
    assert A.files(made, views=False).count() == 4


def test_written_bundle(spark, tmp_path):
    folder = str(tmp_path / "bundle")
    made = A.archived(docs(spark), AT)
    A.write_archive(made, folder, AT)
    told = json.load(open(f"{folder}/manifest.json"))
    assert (told["document_count"], told["total_pages"], told["total_cost_usd"], told["exported_at"]) == (4, 7, 1.75, AT)
    assert [p["first"] for p in told["parts"]] == sorted(p["first"] for p in told["parts"])
    assert len(os.listdir(f"{folder}/parts")) == 3 * len(told["parts"])
    packed = {}
    for p in told["parts"]:
        with zipfile.ZipFile(f"{folder}/{p['files']}") as z:
            packed |= {n: z.read(n).decode() for n in z.namelist()}
    assert packed == {r["path"]: r["content"] for r in A.files(made).collect()}
    entries = [json.loads(x) for p in told["parts"] for x in open(f"{folder}/{p['entries']}")]
    assert [e["id"] for e in entries] == [1, 3, 7, 9] and entries[1]["export_path"] == "documents/002_tafsir-book.md" and entries[0]["cost_usd"] == 0.25
    text = b"".join(master_text(folder)).decode()
    assert text.startswith("# Master Digital") and text.index("SOURCE_END_1 ") < text.index("SOURCE_START_2:") and text.count("SOURCE_START_") == 4


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    folder = str(tmp_path / "bundle")
    spark.dataSource.register(BundleSource)
    rows = spark.range(8, numPartitions=4).select(F.col("id").alias("ordinal"), F.concat(F.lit("f"), "id").alias("path"), F.lit("x").alias("content"), F.lit("s").alias("section"), F.lit("{}").alias("entry"), F.lit(1).cast("long").alias("pages"), F.lit(0.0).alias("cost"))
    broken = rows.withColumn("content", F.when(F.col("ordinal") == 7, F.raise_error(F.lit("broken"))).otherwise(F.col("content")))
    with pytest.raises(Exception, match="broken"):
        broken.write.format("bundle").mode("append").option("folder", folder).save()
    assert not os.path.exists(f"{folder}/manifest.json")
    open(f"{folder}/parts/{'0' * 32}.zip", "w").close()  # as a lost executor leaves it
    rows.write.format("bundle").mode("append").option("folder", folder).save()
    told = json.load(open(f"{folder}/manifest.json"))
    assert told["document_count"] == 8 and len(os.listdir(f"{folder}/parts")) == 3 * len(told["parts"])
