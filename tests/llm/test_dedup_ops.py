"""Exact and near duplicates and repeated strings against brute force."""

import hashlib
from collections import Counter, defaultdict

import pytest
from conftest import table, words

from quarry.llm import exact, jaccard, suffix


def key(v):
    return None if v is None or v != v else int(v)


def test_exact(edge, edge_rows, empty):
    got = exact.groups(edge).toPandas()
    by = defaultdict(list)
    for i, t, _ in edge_rows:
        by[t or ""].append(i)
    want = Counter()
    for t, ids in by.items():
        top = max((i for i in ids if i is not None), default=None)
        for i in ids:
            want[(i, top, len(ids), hashlib.sha256(t.encode()).hexdigest())] += 1
    assert Counter((key(r.doc_id), key(r.keep_id), r.group_size, r.text_sha256) for r in got.itertuples()) == want
    kept = got[got.kept]
    assert kept.text_sha256.is_unique and len(kept) == len(by) and all(key(r.doc_id) == key(r.keep_id) for r in kept.itertuples())
    assert exact.groups(empty).count() == 0 and exact.deduplicate(empty).count() == 0
    rows = exact.deduplicate(edge)
    assert rows.columns == edge.columns and Counter(r["text"] or "" for r in rows.collect()) == Counter(dict.fromkeys(by, 1))


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_exact_hot_text(spark, keep):
    """A text with most of the rows is dealt to several parts, and still one row stays."""
    rows = [(i, "hot" if i % 3 else f"cold {i % 7}", "en") for i in range(900)] + [(None, "hot", "en")]
    got = exact.groups(table(spark, rows).repartition(5), keep=keep).toPandas()
    hot = got[got.text_sha256 == hashlib.sha256(b"hot").hexdigest()]
    end = 899 if keep == "largest" else 1
    assert len(hot) == 601 and set(hot.keep_id) == {end} and set(hot.group_size) == {601} and hot[hot.kept].doc_id.tolist() == [end]
    assert got[got.kept].shape[0] == 8
    assert sorted(r["doc_id"] for r in exact.deduplicate(table(spark, rows), keep=keep).where("text = 'hot'").collect()) == [end]


def brute_classes(rows, n=5, least=0.8):
    sets = []
    for _, t, _ in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    links, up = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or (a and b and len(a & b) >= least * len(a | b) - 1e-9):
                links[i] += 1
                links[j] += 1
                up[max(find(i), find(j))] = min(find(i), find(j))
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(i)
    name = {i: min((rows[k][0] for k in g if rows[k][0] is not None), default=None) for g in groups.values() for i in g}
    return Counter((rows[i][0], name[i], links[i]) for i in range(len(rows)))


def variants(seed, n, size):
    """Texts that each differ from one text by a word or two."""
    base = words(seed, size).split()
    out = []
    for k in range(n):
        w = list(base)
        w[(k * 7) % size] = f"x{k}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("block", [512, 3])
def test_near_duplicates(spark, edge_rows, block, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "CORE", 2)
    rows = [*edge_rows, *((100 + i, t, "en") for i, t in enumerate(variants(5, 14, 120))), *((200 + i, t, "en") for i, t in enumerate(variants(6, 5, 40)))]
    got = jaccard.near_duplicates(table(spark, rows).repartition(4)).toPandas()
    assert Counter((key(r.doc_id), key(r.class_id), r.n_links) for r in got.itertuples()) == brute_classes(rows)


def test_near_duplicates_by_bytes(spark, monkeypatch):
    """Buckets of many bytes are split too; sides of one document, and pairs of sides of which one is empty, count once."""
    monkeypatch.setattr(jaccard, "BLOCK_BYTES", 1500)
    rows = [(i, t, "en") for i, t in enumerate(variants(5, 9, 120))] + [(50 + i, t, "en") for i, t in enumerate(variants(6, 2, 400))] + [(70, variants(5, 9, 120)[3], "de")]
    got = jaccard.near_duplicates(table(spark, rows).repartition(4)).collect()
    assert Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in got) == brute_classes(rows)


@pytest.mark.parametrize(("block", "core"), [(40, 8), (16, 2), (7, 2)])
def test_near_duplicates_around_centres(spark, block, core, monkeypatch):
    """Documents around a centre, some at the edge of it, between two centres and in copies, have the links of a full comparison."""
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "CORE", core)
    texts = variants(5, 60, 120)
    for k in range(0, 60, 3):  # two changes, within reach of some only
        w = texts[k].split()
        w[(k * 11 + 50) % 120] = f"y{k}"
        texts.append(" ".join(w))
    other = variants(5, 40, 120)
    texts += [" ".join([*t.split()[:110], *"some other end of the text as the second template has".split()]) + f" z{k % 5}" for k, t in enumerate(other)]
    rows = [(i, t, "en") for i, t in enumerate(texts)] + [(500 + i, texts[i % 7], "de") for i in range(20)] + [(None, texts[1], "en")]
    got = jaccard.near_duplicates(table(spark, rows).repartition(4)).collect()
    assert Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in got) == brute_classes(rows)


def test_centres_link_within_half_the_distance():
    """All pairs around one centre are linked, and a block of one template has one centre for nearly all."""
    import pyarrow as pa

    texts = variants(5, 50, 150) + variants(9, 30, 150)
    grams, counts = jaccard.ngrams(pa.array(texts), 5)
    keys = [tuple(k) for k in jaccard.around_centres(grams, counts, 0.8, 8).tolist()]
    ends = counts.cumsum()
    sets = [set(grams[e - c : e].tolist()) for e, c in zip(ends, counts, strict=True)]
    assert len(set(keys[:50])) == len(set(keys[50:])) == 1 and len(set(keys)) == 2 and (0, 0) not in keys
    assert all(len(a & b) >= 0.8 * len(a | b) for i, a in enumerate(sets) for j, b in enumerate(sets) if keys[i] == keys[j])


def test_near_duplicates_of_the_sample(spark):
    """All links of a thousand documents are found, each counted once."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = jaccard.near_duplicates(docs).collect()
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()]
    sets = [set(zip(*(w[k:] for k in range(5)), strict=False)) if len(w) >= 5 else {tuple(w)} if w else set() for w in ((t or "").lower().split() for _, t, _ in rows)]
    by = defaultdict(list)
    for k, grams in enumerate(sets):
        for g in grams or [()]:
            by[g].append(k)
    shared = Counter((a, b) for own in by.values() for x, b in enumerate(own) for a in own[:x])
    links = Counter()
    for (a, b), n in shared.items():
        if n >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
            links.update((rows[a][0], rows[b][0]))
    assert {r["doc_id"]: r["n_links"] for r in got} == {i: links[i] for i, _, _ in rows} and sum(links.values()) > 100


def test_near_duplicates_empty(empty):
    assert jaccard.near_duplicates(empty).count() == 0


def test_band_choice():
    bands, rows = jaccard.choose_bands(0.8, 0.999)
    assert bands * rows <= 96 and 1 - (1 - 0.8**rows) ** bands >= 0.999


def brute_removal(rows, length):
    data = [(i, (t or "").encode()) for i, t, _ in rows]
    seen = Counter(b[k : k + length] for _, b in data for k in range(len(b) - length + 1))
    out = Counter()
    for i, b in data:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = b"\x01" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        runs = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out[(i, len(b), len(b) - len(kept), runs, hashlib.sha256(kept).hexdigest())] += 1
    return out


@pytest.mark.parametrize("hot", [1024, 1])
def test_repeats(spark, edge_rows, hot):
    passage = words(40, 60)
    rows = [r for r in edge_rows if r[0] not in (8, 9)]
    rows += [(300 + k, words(50 + k, 30 + k) + " " + passage[k % 3 :] + " " + words(90 + k, 20), "en") for k in range(12)]
    rows += [(400, passage[:150] + words(7, 9) + passage[60:300] + words(8, 9) + passage[:150], "en"), (401, "é" * 200, "fr"), (402, "é" * 90 + "x" + "é" * 90, "fr")]
    got = suffix.remove_repeats(table(spark, rows).repartition(4), length=100, hot=hot).select("row.doc_id", "kept", "text", "n_bytes", "n_removed", "n_spans").toPandas()
    own = Counter((key(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in got.itertuples())
    assert own == brute_removal(rows, 100)
    assert all(bytes(r.kept).decode(errors="ignore") == r.text for r in got.itertuples())


@pytest.mark.parametrize("hot", [1024, 1])
def test_two_lengths(spark, edge_rows, hot):
    """Repeats of two lengths, settled at once, are those of each length alone."""
    passage = words(40, 70)
    rows = [r for r in edge_rows if r[0] not in (8, 9)]
    rows += [(300 + k, words(50 + k, 30 + k) + " " + passage[k * 5 : 140 + 20 * k] + " " + words(90 + k, k), "en") for k in range(9)]
    rows += [(400, passage[:150] + words(7, 9) + passage[60:300] + words(8, 9) + passage[:150], "en"), (401, "é" * 200, "fr"), (402, words(9, 30) + passage[-150:], "en"), (403, words(10, 30) + passage[-150:], "en")]
    got = suffix.remove_repeats(table(spark, rows).repartition(4), length=180, passage=100, hot=hot).select("row.doc_id", "kept", "n_bytes", "n_removed", "n_spans", "n_passage").toPandas()
    assert Counter((key(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in got.itertuples()) == brute_removal(rows, 180)
    shorter = Counter((i, n, gone) for i, n, gone, _, _ in brute_removal(rows, 100).elements())
    assert Counter((key(r.doc_id), r.n_bytes, r.n_passage) for r in got.itertuples()) == shorter != Counter((key(r.doc_id), r.n_bytes, r.n_removed) for r in got.itertuples())


def test_repeats_of_long_texts(spark, edge_rows):
    rows = [r for r in edge_rows if r[0] in (1, 2, 3, 8, 9)]
    got = suffix.remove_repeats(table(spark, rows), length=400).select("row.doc_id", "n_bytes", "n_removed").toPandas()
    assert all(r.n_removed == r.n_bytes for r in got.itertuples() if r.doc_id in (1, 2, 9)) and len(got) == len(rows)
    assert got[got.doc_id == 8].n_removed.tolist() == [50_000]


def test_repeats_empty(empty):
    assert suffix.remove_repeats(empty).count() == 0
