from __future__ import annotations

import random
from hashlib import sha256

import duckdb
import pytest
from pyspark.sql import functions as F

from footfall.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf int, tree string"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def plain_leaf(doc, source, lang, n_chars, text):
    fields = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc, source, lang, n_chars, text)]
    return h(*fields)


def plain_tree(nodes):
    """Levels of a tree, the leaves first."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([h(*below[i : i + 3]) for i in range(0, len(below), 3)])
    return levels


def plain(data):
    sources = sorted({r[3] for r in data}, key=lambda s: (s is not None, (s or "").encode()))
    trees, rows = {}, {}
    for source in sources:
        mine = [(doc, plain_leaf(doc, s, lang, n, text), text, lang, n) for doc, text, lang, s, n in data if s == source]
        rows[source] = sorted(mine, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        trees[source] = plain_tree([r[1] for r in rows[source]])
    upper = plain_tree([trees[s][-1][0] for s in sources])
    out = []
    for number, source in enumerate(sources):
        for pos, (doc, leaf, text, lang, n) in enumerate(rows[source]):
            changed = doc is not None and doc % 3 == 0
            digest = plain_leaf(doc, source, lang, n, text and text.replace("\n", "")) if changed else leaf
            proof = []
            for levels, at in ((trees[source], pos), (upper, number)):
                for level in levels[:-1]:
                    run = list(range(at // 3 * 3, min(at // 3 * 3 + 3, len(level))))
                    proof += [level[i] for i in run if i != at]
                    digest = h(*(digest if i == at else level[i] for i in run))
                    at //= 3
            root = upper[-1][0]
            out.append((doc, leaf, trees[source][-1][0], root, tuple(proof), digest, digest == root))
    return sorted(out, key=repr)


def table(spark, data):
    return spark.createDataFrame([(*r, 7, "mine") for r in data], SCHEMA)


def found(spark, data, levels):
    docs = table(spark, data)
    result = merkle.checked(docs, F.replace("text", F.lit("\n"), F.lit("")), F.col("doc_id") % 3 == 0, levels)
    return result.collect()


def rows(number, seed=1):
    rng = random.Random(seed)
    data = [(None, "no id", "en", "a", 5), (None, None, None, None, None), (3, "", "en", None, 0), (3, "a\nb", "en", "lone", 3), (3, "x\ny" * 30_000, "é", "ü", 1)]
    data += [(9, "same\n", "en", "a", 5)] * 4
    data += [(i, rng.choice(["one\ntwo", "plain", "", None, "zoë\n"]), "en", rng.choice(["a", "a", "a", "b", "Z", "ü"]), i) for i in range(number)]
    return data


@pytest.mark.parametrize("levels", [1, 2, 8])
def test_checked_equals_plain_trees(spark, levels):
    data = rows(150)
    got = found(spark, data, levels)
    assert sorted([(r.doc_id, r.leaf, r.subroot, r.root, tuple(r.proof), r.folded_root, r.verified) for r in got], key=repr) == plain(data)


def test_versions_share_all_but_their_path(spark):
    got = found(spark, rows(60), 2)
    assert {r.root for r in got} == {got[0].root}
    for r in got:
        assert (r.copied is None) == (r.doc_id is None or r.doc_id % 3 != 0)
        if r.copied is not None:
            assert r.copied[-1] == r.folded_root and len(r.copied) == merkle.height(r.n) + merkle.height(len({x.source for x in got}))
    assert any(not r.verified for r in got) and any(r.verified and r.copied for r in got)


def test_one_row_and_no_row(spark):
    (only,) = found(spark, [(5, "a", "en", "s", 1)], 8)
    assert only.root == only.subroot == only.leaf == only.folded_root and only.proof == [] and only.verified
    assert found(spark, [], 8) == []


def test_sql_equals_plain(spark):
    data = rows(90)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", data)
    got = con.execute(merkle.checked_sql("doc_id % 3 = 0", "replace(text, chr(10), '')")).fetchall()
    want = [(*r[:4], h(*r[4]), *r[5:]) for r in plain(data)]
    assert sorted(got, key=repr) == sorted(want, key=repr)
