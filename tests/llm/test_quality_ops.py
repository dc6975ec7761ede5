"""The Kneser-Ney classifier against a plain version, and its accuracy on held-out labels."""

import math
from collections import Counter, defaultdict

import pytest
from conftest import table
from pyspark.sql import functions as F

from quarry.llm import quality


class PlainModel:
    """Interpolated modified Kneser-Ney over bytes, n-gram by n-gram."""

    def __init__(self, texts, order):
        self.order = order
        top = Counter(g for t in texts for g in self.grams(t))
        self.levels = {order: top}
        for k in range(order - 1, 0, -1):
            self.levels[k] = Counter(g[1:] for g in self.levels[k + 1])
        self.stats, self.discounts = {}, {}
        for k, level in self.levels.items():
            n = [max(sum(c == i for c in level.values()), 1) for i in (1, 2, 3, 4)]
            y = n[0] / (n[0] + 2 * n[1])
            self.discounts[k] = [min(max(i - (i + 1) * y * n[i] / n[i - 1], 0.05), i) for i in (1, 2, 3)]
            own = defaultdict(lambda: [0, 0.0])
            for g, c in level.items():
                own[g[:-1]][0] += c
                own[g[:-1]][1] += self.discounts[k][min(c, 3) - 1]
            self.stats[k] = own

    def grams(self, text):
        b = bytes([quality.START]) * (self.order - 1) + text.encode()
        return [b[i : i + self.order] for i in range(len(b) - self.order + 1)]

    def p(self, g):
        k = len(g)
        if not k:
            return 1 / 256
        lower = self.p(g[1:])
        if g[:-1] not in self.stats[k]:
            return lower
        total, taken = self.stats[k][g[:-1]]
        c = self.levels[k].get(g, 0)
        return (c - (self.discounts[k][min(c, 3) - 1] if c else 0)) / total + taken / total * lower

    def log_ppl(self, text):
        g = self.grams(text)
        return -sum(math.log(self.p(x)) for x in g) / len(g)


def calibrating(spark, ids):
    rows = spark.createDataFrame([(i,) for i in ids], "doc_id long").where(quality.calibrating(F.col("doc_id")))
    return {r["doc_id"] for r in rows.collect()}


@pytest.mark.parametrize("order", [2, 4])
def test_perplexity(spark, edge_rows, order):
    rows = [r for r in edge_rows if r[0] not in (8, 9)] + [(500 + i, f"plain text number {i} of the set", "en") for i in range(20)] + [(600, "#@!% ZZ", "en")]
    labels = spark.createDataFrame([(500 + i, 1, 0) for i in range(20)] + [(1, 1, 0), (3, 1, 1), (600, 0, 0), (None, 1, 0), (500, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(table(spark, rows).repartition(3), labels, order=order).toPandas()
    left_out = calibrating(spark, range(1, 520))
    model = PlainModel([t for i, t, _ in rows if (i == 1 or 500 <= (i or 0) < 520) and i not in left_out], order)
    assert len(got) == len(rows)
    own = sorted((len((t or "").encode()), 0.0 if not t else round(model.log_ppl(t), 4)) for _, t, _ in rows)
    mine = sorted((int(r.n_bytes), 0.0 if r.log_ppl != r.log_ppl else round(r.log_ppl, 4)) for r in got.itertuples())
    assert [n for n, _ in mine] == [n for n, _ in own] and [x for _, x in mine] == pytest.approx([x for _, x in own], abs=2e-4)
    assert not got[got.doc_id == 600].accepted.item() and got[got.n_bytes == 0].accepted.all() and got[(got.doc_id >= 500) & (got.doc_id < 520)].accepted.all()


def test_no_labels(spark, edge, edge_rows, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.classify(edge, none).where("accepted").count() == len(edge_rows)
    assert quality.classify(empty, none).count() == 0


def test_quantiles(spark):
    scored = spark.createDataFrame([("en", i / 100) for i in range(1, 101)] + [(None, 5.0), ("fr", None)], "lang string, log_ppl double")
    got = {r["lang"]: r["threshold"] for r in quality.thresholds(scored, 0.9, 0.0).collect()}
    assert set(got) == {"en", None} and 0.9 <= got["en"] <= 0.9 + 2 * quality.BIN and 5.0 <= got[None] <= 5.0 + 2 * quality.BIN


def test_held_out_accuracy(spark):
    """Trained on labels of even ids, most bad documents of odd ids go and nearly all good ones stay."""
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rated = quality.classify(docs, labels.where("doc_id % 2 = 0")).join(labels.where("doc_id % 2 = 1"), "doc_id")
    share = {r["quality"]: r["kept"] for r in rated.groupBy("quality").agg(F.avg(F.col("accepted").cast("double")).alias("kept")).collect()}
    assert share[1] > 0.97 and share[0] < 0.35


def test_margin_falls_with_the_root_of_documents(spark):
    """A threshold exceeds the quantile by the margin over the root of the language's trusted documents, however many there are."""
    scored = spark.createDataFrame([("en", i / 100) for i in range(1, 101)] + [("fr", i / 10) for i in range(1, 11)] + [("de", 1.0)], "lang string, log_ppl double")
    got = {r["lang"]: r["threshold"] for r in quality.thresholds(scored, 0.99, 0.6).collect()}
    for lang, quantile, n in (("en", 0.99, 100), ("fr", 1.0, 10), ("de", 1.0, 1)):
        assert quantile <= got[lang] - 0.6 / n**0.5 <= quantile + 2 * quality.BIN
