"""Queries of the library do their whole job, and what a task holds does not grow with its rows."""

import pyarrow as pa
from pyspark.sql import functions as F

from folioflow.operators import production
from folioflow.plans import narration, shelf
from folioflow.sources import epub_writer, markup

SF = "/root/testdata/sf0.1"


def test_page_titles_take_a_seventh_of_the_bookmarks(spark):
    found = narration.page_titles(spark, SF).collect()
    parts = spark.read.parquet(f"{SF}/part.parquet").select("p_brand", "p_partkey", "p_size", "p_name").collect()
    plain = {}
    for p in sorted(parts, key=lambda p: p["p_partkey"]):
        if p["p_size"] % 7 == 0 and p["p_partkey"] % 5:
            plain.setdefault((p["p_brand"], p["p_partkey"] % 11), []).append(" ".join(p["p_name"].split()))
    assert {(r["book_id"], r["page_no"]): r["titles"] for r in found} == {k: "|".join(v) for k, v in plain.items()}
    assert sum(map(len, plain.values())) > len(parts) / 10


def test_items_come_in_pieces():
    values = pa.array(["a" * n for n in (0, 3 * markup.MOST_HELD, 10, 0, 20)])
    found = [list(zip(*piece)) for piece in markup.in_pieces(values, lambda raw: [(raw[k : k + 1000],) for k in range(0, len(raw), 1000)])]
    assert [(k, x) for piece in found for k, x in piece] == [(k, v[n : n + 1000]) for k, v in enumerate(values.to_pylist()) for n in range(0, len(v), 1000)]
    assert len(found) == 4 and all(sum(len(x) for _, x in piece) <= markup.MOST_HELD for piece in found)
    assert list(markup.in_pieces(pa.array([None, ""]), lambda raw: [])) == []


def test_books_are_packed_without_pandas(spark):
    files = spark.createDataFrame([("b", n, f"<p>Satır {n}</p>") for n in (2, 1)], "book string, n int, html string")
    packed = epub_writer.pack(files, "book", "n", "html")
    assert "FlatMapGroupsInArrow" in packed._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in packed.collect()] == [("b", epub_writer.archive([("p1", "<p>Satır 1</p>"), ("p2", "<p>Satır 2</p>")], title="b", nav=[("p1.xhtml#top", "Part 0")]))]


def test_references_are_decoded_once(spark):
    plan = shelf.unescaped_text(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == 1


def test_outcomes_of_many_pages_leave_together(spark):
    batch = pa.record_batch({"book_id": ["b"] * 450, "page_no": pa.array(range(450), pa.int32()), "sentences": [[{"spoken": "a", "speakable": True, "gap": "sentence"}]] * 450})
    groups = list(production._page_groups(batch))
    assert [len(g) for g in groups] == [200, 200, 50] and [p["page_no"] for g in groups for p in g] == list(range(450))
    rows = [("b", k, "failed", None, None, None, None, "x") for k in range(3)]
    assert production._outcomes(rows).num_rows == 3
    pages = spark.createDataFrame([("b", k, "Bir. İki.", [(0, 4, "sentence"), (5, 9, "paragraph")]) for k in range(450)], "book_id string, page_no int, text string, sentences array<struct<start:int,end:int,gap:string>>").coalesce(1)
    made = production.produce(pages, production.mock_engine("x"), lambda text, heading: text, keep_pcm=True).select("page_no", "state", "duration_ms", F.length("pcm").alias("n")).collect()
    assert [tuple(r) for r in made] == [(k, "produced", 930, 14880) for k in range(450)]


def test_blocks_of_books_are_parsed_once(spark):
    plan = shelf.shelved_blocks(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.split("\n") if "MapInArrow" in line and "is_heading" in line]
