"""Long lists in rows of bounded size."""

from pyspark.sql import functions as F

from sparkcorpus.operators import segments


def test_an_owner_of_a_million_children(spark, tmp_path):
    rows = spark.range(1_000_003).select(F.lit("big").alias("corpus_id"), F.pmod(F.col("id") * 7919, F.lit(1000)).alias("uploaded_at"), F.col("id"))
    rows = rows.union(spark.sql("SELECT CAST(NULL AS STRING), 5L, 1L UNION ALL SELECT 'small', 1L, 2L UNION ALL SELECT 'small', 1L, 1L"))
    segments.segments(rows, "corpus_id", ["uploaded_at", "id"], 1000, range_rows=200_000).write.parquet(f"{tmp_path}/s")
    made = spark.read.parquet(f"{tmp_path}/s")
    assert made.agg(F.max("n")).first()[0] == 1000 and made.where("corpus_id = 'big'").count() == 1001
    assert [r.n for r in made.where("corpus_id = 'big'").orderBy(F.desc("segment")).limit(2).collect()] == [3, 1000]
    # the items of all segments, one after another, are the rows in order
    items = made.where("corpus_id = 'big'").select("segment", F.posexplode("items").alias("place", "x"))
    wrong = items.selectExpr("segment * 1000 + place AS at", "x.*").join(
        rows.where("corpus_id = 'big'").selectExpr("uploaded_at AS u", "id AS i", "row_number() OVER (ORDER BY uploaded_at, id) - 1 AS at"), "at")
    assert wrong.count() == 1_000_003 and wrong.where("u <> uploaded_at OR i <> id").count() == 0
    key = made.where("segment = 411").first()["last"]
    want = rows.where("corpus_id = 'big'").where(F.struct("uploaded_at", "id") > F.struct(F.lit(key.uploaded_at).cast("long").alias("uploaded_at"), F.lit(key.id).cast("long").alias("id"))).orderBy("uploaded_at", "id")
    got = segments.page(made, "corpus_id", "big", 25, after=(key.uploaded_at, key.id)).collect()
    assert [tuple(r) for r in got] == [(r.uploaded_at, r.id) for r in want.limit(25).collect()]
    middle = got[11]
    assert [tuple(r) for r in segments.page(made, "corpus_id", "big", 5, after=tuple(middle)).collect()] == [tuple(r) for r in got[12:17]]


def test_small_and_odd_owners(spark):
    rows = spark.createDataFrame([("a", 1, 2), ("a", 1, 1), (None, 3, 3), ("b", 2, 9)], "owner string, part int, place int")
    made = segments.segments(rows, "owner", ["part", "place"], 1)
    assert sorted(((r.owner, r.segment, r.n, tuple(r["items"][0])) for r in made.collect()), key=str) == [
        ("a", 0, 1, (1, 1)), ("a", 1, 1, (1, 2)), ("b", 0, 1, (2, 9)), (None, 0, 1, (3, 3))]
    assert [tuple(r) for r in segments.page(made, "owner", None, 9).collect()] == [(3, 3)]
    assert segments.page(made, "owner", "none", 9).count() == 0
    assert segments.segments(rows.limit(0), "owner", ["part"], 5).count() == 0


def test_labels_of_examples(spark):
    labels = spark.createDataFrame([("e", "d1"), ("e", "d2"), ("f", "d2"), ("f", "gone")], "example_id string, document_id string")
    docs = spark.createDataFrame([("d1", "z.txt"), ("d2", "a.txt")], "id string, original_filename string")
    made = segments.example_segments(labels, docs)
    got = {r.example_id: [tuple(i) for i in r["items"]] for r in made.collect()}
    assert got == {"e": [("a.txt", "d2"), ("z.txt", "d1")], "f": [("a.txt", "d2")]}
