"""Rounding, vectors of texts and manifests of files on small cases."""

import math
import os
import random

from pyspark.sql import functions as F

from quarry.functions import rounding
from quarry.functions.rounding import half_even
from quarry.operators import embedding
from quarry.sources import manifest


def test_half_even_is_that_of_the_binary_value(spark):
    r = random.Random(1)
    values = [0.125, 0.375, 2.675, 1.005, 0.5, 1.5, 2.5, -0.5, -1.5, -2.675, 0.0, 1e-5, 5e-5, 1e-320, 4503599627370497.5, 9007199254740993.0, 1e22, -1e300, 0.045, 1234567.125, 1 / 3, 8.345, 0.285, 1.115]
    values += [r.uniform(-1000, 1000) for _ in range(800)] + [r.randrange(10**6) / 8 for _ in range(300)] + [r.randrange(10**7) / 1000 + 0.0005 for _ in range(300)] + [r.uniform(-1, 1) * 10.0 ** r.randrange(-12, 16) for _ in range(400)]
    rows = spark.createDataFrame([(v,) for v in values], "x double").select("x", *(half_even(F.col("x"), n).alias(f"d{n}") for n in range(5))).collect()
    for row in rows:
        assert [row[f"d{n}"] for n in range(5)] == [round(row["x"], n) for n in range(5)], row["x"]
    odd = spark.createDataFrame([(None,), (math.nan,), (math.inf,), (-math.inf,)], "x double").select(half_even(F.col("x"), 2).alias("y")).collect()
    assert odd[0]["y"] is None and math.isnan(odd[1]["y"]) and odd[2]["y"] == math.inf and odd[3]["y"] == -math.inf


def test_vectors(spark):
    texts = {1: "toll dues toll", 2: "dues rail", 3: None, 4: "rail port ship", 5: "the of"}
    docs = spark.createDataFrame(sorted(texts.items()), "id long, text string")
    weights = embedding.rarity(docs, "id")
    stored = embedding.embed(docs, weights, "id").cache()
    got = {r["id"]: r for r in stored.collect()}
    assert len(got[1]["vector"]) == 2 and abs(sum(x["value"] ** 2 for x in got[1]["vector"]) - 1) < 1e-12
    idf = {w: math.log(6 / (n + 1)) for w, n in (("toll", 1), ("dues", 2))}
    assert abs(got[1]["size"] - math.hypot((1 + math.log(2)) * idf["toll"], idf["dues"])) < 1e-12
    assert got[3]["vector"] == got[5]["vector"] == [] and got[3]["size"] == 0.0
    asked = embedding.embed(spark.createDataFrame([(0, "rail unheard")], "q long, text string"), weights, "q")
    scores = {r["id"]: r["score"] for r in embedding.dot(stored, asked, "id", "q").collect()}
    assert set(scores) == {2, 4} and scores[2] > scores[4] > 0
    now = spark.createDataFrame([(1, "toll dues toll"), (2, "dues port"), (6, "ship")], "id long, text string")
    fresh = {r["id"]: r for r in embedding.refresh(stored, now, weights, "id").collect()}
    assert {i: r["made"] for i, r in fresh.items()} == {1: False, 2: True, 6: True} and fresh[1]["vector"] == got[1]["vector"]
    assert embedding.embed(docs.limit(0), weights, "id").count() == 0


def test_refresh_meets_what_is_stored_once(spark):
    """Texts made from narrow rows are found again, taken over or made as they would be from the texts; they are not shuffled or written."""
    make = lambda rows: rows.selectExpr("*", "concat('k', n) as id", "concat('toll ', repeat('dues ', n % 5), n) as text")
    stored_of = lambda rows, w: embedding.embed(rows, w, "id").select("id", "content", "vector", "size")
    old, new = make(spark.range(60).toDF("n")), spark.range(30, 90).toDF("n")
    weights = embedding.rarity(old, "id")
    stored = stored_of(old, weights)
    got = embedding.refresh(stored, new, weights, "id", make=make)
    plain = embedding.refresh(stored, make(new), weights, "id")
    assert got.columns == plain.columns == ["id", "content", "vector", "size", "made"]
    want = stored_of(make(new), weights).withColumn("made", F.substring("id", 2, 9).cast("int") >= 60)
    assert sorted(map(str, got.collect())) == sorted(map(str, plain.collect())) == sorted(map(str, want.collect()))
    written = [f for f in got.inputFiles() if "-met-" in f]
    assert written and spark.read.parquet(*written).columns == ["n", "_held"]
    twice = spark.createDataFrame([("a", None), ("a", None), ("b", ""), ("c", "toll")], "id string, text string")
    kept = embedding.refresh(stored_of(twice.where("id > 'a'"), weights), twice, weights, "id").collect()
    assert sorted((r["id"], r["made"]) for r in kept) == [("a", True), ("a", True), ("b", False), ("c", False)]


def put(folder, name, text, at):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}.json", "w") as f:
        f.write(text)
    os.utime(f"{folder}/{name}.json", (at, at))


def test_only_changed_files_are_read(spark, tmp_path):
    folder, versions = f"{tmp_path}/files", f"file://{tmp_path}/versions"
    for name in "abcd":
        put(folder, name, name, 1000)
    load = lambda: {os.path.basename(r["path"]): r["status"] for r in manifest.refresh(spark, folder, versions).collect()}
    assert load() == {f"{x}.json": "new" for x in "abcd"}
    put(folder, "b", "B!", 2000)
    put(folder, "c", "c", 2000)
    put(f"{folder}/sub", "e", "E", 2000)
    put(folder, "empty", "", 2000)
    os.remove(f"{folder}/d.json")
    os.chmod(f"{folder}/a.json", 0)
    assert load() == {"a.json": "same", "b.json": "changed", "c.json": "touched", "d.json": "removed", "e.json": "new"}
    assert load() == {"a.json": "same", "b.json": "same", "c.json": "same", "e.json": "same"}
    assert manifest.versions(spark, versions) == [0, 1, 2]
    found = manifest.changes(manifest.read_version(spark, versions, 0), manifest.read_version(spark, versions, 1))
    assert [os.path.basename(p) for p in manifest.to_read(found)] == ["b.json", "e.json"]


def test_vectors_shuffle_no_tokens(spark):
    docs = spark.createDataFrame([(1, "toll dues toll"), (2, "rail"), (2, "dues rail"), (3, None)], "id long, text string")
    found = embedding.counted(docs, "id")
    weights = embedding.rarity_of(found)
    assert {r["df"] for r in weights.collect()} == {1, 2} and weights.count() == 3
    made = embedding.embed(docs, weights, "id")
    assert "token" not in made._jdf.queryExecution().executedPlan().toString()
    got = made.collect()
    assert sorted((r["id"], r["places"]) for r in got) == [(1, 2), (2, 2), (2, 2), (3, 0)] and len({str(r["vector"]) for r in got if r["id"] == 2}) == 1


def test_numbers_of_vectors_without_vectors(spark):
    """Places and largest values are told where the vectors are made, and rarities where the places are; no place is a row."""
    docs = spark.createDataFrame([(1, "toll dues toll"), (2, "rail toll"), (2, "dues rail"), (3, None), (4, "section 12, section 12 and rule 5"), (5, "section 77, section 12 and rule 5")], "id long, text string")
    found = embedding.counted(docs, "id").cache()
    weights = embedding.rarity_of(found)
    assert {r["df"] for r in weights.collect()} == {1, 2} and "Generate" not in weights._jdf.queryExecution().executedPlan().toString().split("InMemory")[0]
    whole = embedding.unit(embedding.weighed(found, weights)).selectExpr("id", "size", "places", "array_max(transform(vector, x -> x.value)) as most")
    assert sorted(map(str, embedding.weighed(found, weights, whole=False).select("id", "size", "places", "most").collect())) == sorted(map(str, whole.collect()))


def test_half_even_by_doubles(spark):
    r = random.Random(2)
    values = [0.5, 1.5, 0.125, 2.675, 1.005, 68719476735.5, 1e-300, 3e-39] + [r.randrange(10**9) / 8 for _ in range(500)] + [r.randrange(10**9) / 10000 + 0.00005 for _ in range(500)] + [r.uniform(0, 1) * 10.0 ** r.randrange(-6, 10) for _ in range(500)]
    rows = spark.createDataFrame([(v,) for v in values], "x double").select("x", *(rounding._by_doubles(F.col("x"), n).alias(f"d{n}") for n in range(5))).collect()
    for row in rows:
        assert [row[f"d{n}"] for n in range(5)] == [round(row["x"], n) for n in range(5)], row["x"]
