"""License scans against a search in lists of words, and the expressions that are parsed."""

import re

import pytest

from quarry.llm import licenses


def by_lists(text):
    """Words, places and labels of the base phrases."""
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    places, labels = [], set()
    for phrase, label in licenses.BASE.items():
        own = phrase.split()
        for i in range(len(words) - len(own) + 1):
            if words[i : i + len(own)] == own:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


TEXTS = [
    None, "", " . ", "Under the MIT\n# License", "undr the mit license", "under the mit licenses", "É under THE mit license, under-the-MIT-license É", "apache license, version 2.0 apache license version 20", "CC BY-NC 4.0 cc by NC-SA ccbync",
    "İunder the mit license", "日本 under the mit license日本", "x " * 30_000 + "under the mit license " + "y " * 30_000, "cc by cc by nc by nc", "\x7f`@[{ cc\tby\x00nc",
]


def test_base_phrases(spark, edge, edge_rows):
    docs = spark.createDataFrame([(i, t, i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string, n_words int, labels string")
    got = {r["doc_id"]: tuple(r)[1:6] for r in licenses.scan(docs).collect()}
    assert got == {i: by_lists(t) for i, t in enumerate(TEXTS)}
    rows = sorted((str(r["doc_id"]), *tuple(r)[1:6]) for r in licenses.scan(edge).collect())
    assert [str(r) for r in rows] == [str(r) for r in sorted((str(i), *by_lists(t)) for i, t, _ in edge_rows)]


def test_empty(spark, empty):
    assert licenses.scan(empty).collect() == []


def test_the_sample(spark, data):
    import pyarrow.parquet as pq

    texts = pq.read_table(f"{data}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    got = {r["doc_id"]: tuple(r)[1:6] for r in licenses.scan(spark.read.parquet(f"{data}/documents.parquet")).collect()}
    assert got == {r["doc_id"]: by_lists(r["text"]) for r in texts}


@pytest.mark.parametrize(
    ("text", "labels", "score"),
    [
        ("# SPDX-License-Identifier: MIT", "mit", 1.0),
        ("/* SPDX-License-Identifier: (GPL-2.0-only WITH Linux-syscall-note) OR BSD-3-Clause */", "bsd-3,gpl-2", 1.0),
        ("SPDX-License-Identifier: GPL-2.0-or-later AND MIT", "gpl-2,mit", 0.4),
        ("SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0", "gpl-2", 0.7),
        ("SPDX-License-Identifier: MIT AND (Apache-2.0 OR GPL-3.0+", "apache-2,gpl-3,mit", 1.0),
        ("SPDX-License-Identifier: MIT OR\nGPL-3.0", "mit", 1.0),
        ("License-Expression: CC-BY-NC-4.0", "cc-by-nc", 0.2),
        ("spdx license identifier of a file: MIT", "", 0.0),
        ("SPDX-License-Identifier: see the file", "", 0.0),
        ("SPDX-License-Identifier: OR AND ) (", "", 0.0),
        ("Dual licensed under the MIT license or the GNU General Public License, version 3.", "gpl-3,mit", 1.0),
        ("Under the MIT license and under the GNU General Public License version 3", "gpl-3,mit", 0.4),
        ("MIT license. Parts: Mozilla Public License, version 2.0", "mit,mpl-2", 0.7),
        ("GNU General Public License version 2 with the Classpath Exception", "gpl-2", 0.7),
        ("under the MIT license, cc by-nc-sa", "cc-by-nc,cc-by-nc-sa,mit", 0.2),
        ("no terms at all", "", 0.0),
    ],
)
def test_labels_and_score(spark, text, labels, score):
    row = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (row["labels"], row["score"]) == (labels, score)


def test_shunting_yard():
    assert licenses.postfix("a or b and c with d".split()) == "a b c d with and or".split()
    assert licenses.postfix("( a or b ) and c".split()) == "a b or c and".split()
    assert licenses.postfix("a or b or c".split()) == "a b or c or".split()


def test_phrases_are_words(spark):
    docs = spark.createDataFrame([(1, "New Phrase")], "doc_id long, text string")
    assert licenses.scan(docs, {"new phrase": "new"}).first()["base_labels"] == "new"
    with pytest.raises(ValueError):
        licenses.scan(docs, {"New phrase": "new"})
