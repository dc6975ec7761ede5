"""Merkle manifests and prefix tries against plain recomputation."""

import hashlib
import random
import zlib

import pytest
from compare import duck, rows
from pyspark.sql import functions as F

from quarry.llm import merkle, queries, trie


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def tree(digests):
    """Top, and each leaf's siblings with its own place among them."""
    paths, own, nodes = [[] for _ in digests], [[i] for i in range(len(digests))], list(digests)
    while len(nodes) > 1:
        up, ups = [], []
        for a in range(0, len(nodes), 3):
            run = nodes[a : a + 3]
            for k in range(len(run)):
                for x in own[a + k]:
                    paths[x].append((k, run[:k] + run[k + 1 :]))
            up.append(digest("".join(run)))
            ups.append([x for o in own[a : a + 3] for x in o])
        nodes, own = up, ups
    return nodes[0], paths


def manifest_of(docs):
    """Rows (doc_id, leaf, subroot, root, proof) of documents (doc_id, source, lang, n_chars, text)."""
    leaf = lambda r: digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))
    groups = {}
    for r in docs:
        groups.setdefault(r[1], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for g in groups.values():
        g.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {s: tree([leaf(r) for r in groups[s]]) for s in names}
    root, up = tree([trees[s][0] for s in names])
    return sorted(str((r[0], leaf(r), trees[s][0], root, digest("".join(x for _, sib in p + up[i] for x in sib)))) for i, s in enumerate(names) for r, p in zip(groups[s], trees[s][1], strict=True))


DOCS = "doc_id long, source string, lang string, n_chars long, text string, grp string, size int, path string, level int"


def found(spark, docs):
    made = spark.createDataFrame([(*r, "g", 1, "p", 2) for r in docs], DOCS).repartition(5)
    out = merkle.manifest(made).collect()
    assert all(r["verified"] and r["folded_root"] == r["root"] for r in out)
    return sorted(str(tuple(r[c] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256"))) for r in out)


def test_nulls_ties_and_repeated_rows(spark):
    docs = [(i, f"s{i % 3}", "en", 3, f"text {i}") for i in range(40)] + [(None, "s1", None, None, None), (3, None, "en", 0, ""), (3, None, "en", 0, None), (7, "", "en", 1, "é\n日本"), (7, "-", "en", 1, "x" * 300_000)]
    docs += [(5, "s9", "en", 1, "same")] * 30 + [(5, "s9", "en", 1, "other")] * 2
    assert found(spark, docs) == manifest_of(docs)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 82])
def test_sizes(spark, n):
    docs = [(i, "one", "en", i, str(i)) for i in range(n)]
    assert found(spark, docs) == manifest_of(docs)


def test_several_rounds_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(merkle, "LEVELS", 2)
    monkeypatch.setattr(merkle, "ROWS", 40)
    docs = [(i, "hot" if i % 3 else f"s{i % 100}", "en", i, str(i)) for i in range(700)]
    assert found(spark, docs) == manifest_of(docs)


def test_empty_manifest(spark):
    assert merkle.manifest(spark.createDataFrame([], DOCS)).collect() == []


def test_changes_are_found(spark):
    docs = spark.createDataFrame([(i, "s", "en", 1, f"a\nb{i}", "g", 1, "p", 2) for i in range(20)], DOCS)
    changed = F.when(F.col("doc_id") == 7, merkle.leaf(text=F.lit("else")))
    assert [r["doc_id"] for r in merkle.manifest(docs, found=changed).where("not verified").collect()] == [7]


@pytest.mark.parametrize("name", ["op12_merkle_manifest", "op13_prefix_trie"])
def test_equal_sql(spark, data, name):
    got, want = queries.QUERIES[name](spark, data).toPandas(), duck(data).sql(queries.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def trie_of(turns):
    """Nodes of conversations from rows (conv_id, turn, role, text), as the operator lists them."""
    own = {}
    for c, t, role, text in turns:
        if c is not None:
            role, text = role or "", text or ""
            own.setdefault(c, []).append(((t is not None, t or 0), role, hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest(), text))
    plain = {}
    for c, rows_ in own.items():
        signed = lambda b: int.from_bytes(b, "big", signed=True)
        rows_.sort(key=lambda r: (r[0], r[1], signed(r[2][:8]), signed(r[2][8:16])))
        plain[c] = [(r[1], r[3]) for r in rows_]
    built = {c: plain.get(c - c % 100, [])[: (h := zlib.crc32(str(c).encode()) % 6)] + plain[c][h:] for c in plain}
    nodes = {}
    for c, path in built.items():
        for d in range(len(path) + 1):
            nodes.setdefault(tuple(path[:d]), []).append(c)
    kids = {n: [m for m in nodes if len(m) == len(n) + 1 and m[: len(n)] == n] for n in nodes}

    def below(n):
        leaves, saved = (0, 0) if kids[n] else (1, 0)
        for k in kids[n]:
            a, b = below(k)
            leaves, saved = leaves + a, saved + b
        return leaves, saved + (len(nodes[n]) - 1) * (len(n[-1][1]) if n else 0)

    out = []
    for n, members in nodes.items():
        ends = digest(",".join(str(c) for c in sorted(c for c in members if len(built[c]) == len(n))))
        out.append(str((min(members), len(n), min(nodes[n[:-1]]) if n else None, len(members), len(kids[n]), *below(n), ends)))
    return sorted(out)


def nodes_of(spark, turns):
    made = spark.createDataFrame([(*t, 1, "k") for t in turns], "conv_id long, turn long, role string, text string, depth int, k1 string").repartition(4)
    return sorted(str(tuple(r)[:8]) for r in trie.prefix_trie(made).collect())


def test_trie(spark):
    r = random.Random(5)
    turns = [(c, t, r.choice(["user", "assistant", None]), r.choice(["a", "é日", "", None, "long text"])) for c in range(0, 330) for t in range(r.randrange(0, 9))]
    turns += [(100, 1, "user", "same"), (100, 1, "user", "same"), (101, None, "user", "first"), (101, None, None, None), (None, 1, "user", "no one's"), (2**61, 0, "user", "x"), (777, 0, "user", "alone")]
    assert nodes_of(spark, turns) == trie_of(turns)


def test_trie_of_copies_and_a_long_conversation(spark, monkeypatch):
    monkeypatch.setattr(trie, "PIECE", 7)
    turns = [(c, t, "user", f"t{t}") for c in range(1000, 1150) for t in range(7)] + [(1200, t, "user", f"t{t % 5}") for t in range(700)] + [(1201, 0, "user", "same")] * 300
    assert nodes_of(spark, turns) == trie_of(turns)


def test_empty_trie(spark):
    assert nodes_of(spark, []) == []
