"""The Merkle manifest against plain recursion."""

import hashlib

import pytest
from pyspark.sql import functions as F

from pitchline.llm import merkle, queries


def digest(told):
    return hashlib.sha256(told.encode()).hexdigest()


def levels(nodes):
    out = [nodes]
    while len(nodes) > 1:
        nodes = [digest("".join(nodes[i : i + 2])) for i in range(0, len(nodes), 2)]
        out.append(nodes)
    return out


def way(tree, i):
    out = []
    for level in tree[:-1]:
        out.append(((level[i ^ 1], "L" if i & 1 else "R") if i ^ 1 < len(level) else ("", "-")))
        i >>= 1
    return "".join(s for s, _ in out), "".join(side for _, side in out)


def postorder(tree, level, i):
    below = [n for k in (2 * i, 2 * i + 1) if level and k < len(tree[level - 1]) for n in postorder(tree, level - 1, k)]
    return [*below, tree[level][i]]


@pytest.mark.parametrize("n", [*range(1, 35), 64, 100])
def test_log_and_places_against_recursion(n):
    leaves = [digest(str(i)) for i in range(n)]
    tree = levels(leaves)
    height = len(tree) - 1
    log = merkle.append_log(leaves, height)
    assert log == postorder(tree, height, 0)
    for i in range(n):
        assert merkle.siblings(log, i, n, height) == way(tree, i)


SIZES = {None: 1, "": 2, "de": 8, "en": 77, "é": 3, "zz": 64}


@pytest.fixture(scope="module")
def leaves(spark):
    rows = [(i if i % 5 else None, lang, digest(f"{lang}{i % 70}"), 2**60 + i) for lang, n in SIZES.items() for i in range(n)]
    return spark.createDataFrame(rows, "id long, lang string, leaf string, `Root` long").repartition(7, "id")


def test_manifest_against_recursion(leaves):
    got = merkle.manifest(leaves, "lang", ["id"], bits=2).collect()
    held = leaves.collect()
    rows = {x: sorted((r for r in held if r.lang == x), key=lambda r: (r.id is not None, r.id or 0, r.leaf)) for x in SIZES}
    trees = {x: levels([r.leaf for r in rows[x]]) for x in SIZES}
    names = sorted(SIZES, key=lambda x: (x is not None, (x or "").encode()))
    top = levels([trees[x][-1][0] for x in names])
    want = [(x, r.id, r.leaf, trees[x][-1][0], top[-1][0], *(a + b for a, b in zip(way(trees[x], i), way(top, names.index(x))))) for x in SIZES for i, r in enumerate(rows[x])]
    key = lambda t: tuple((v is not None, v) if v is not None else (False, "") for v in t)
    assert sorted(((r.lang, r.id, r.leaf, r.subroot, r.root, r.siblings, r.sides) for r in got), key=key) == sorted(want, key=key)
    folded = merkle.manifest(leaves, "lang", ["id"], bits=3).select("root", merkle.fold(F.col("leaf"), F.col("siblings"), F.col("sides")).alias("f"), merkle.fold(F.lit(digest("x")), F.col("siblings"), F.col("sides")).alias("g")).collect()
    assert len(folded) == len(held) and all(r.f == r.root == top[-1][0] != r.g for r in folded)


def test_log_table_is_the_postorder_of_every_tree(leaves):
    nodes = merkle.number(leaves.select(F.coalesce("lang", F.lit("?")).alias("_tree"), "id", F.col("leaf").alias("_node")), ["id", "_node"])
    log = merkle.append_log_table(merkle.build(nodes, 2), 2).collect()
    for name in {r.tree for r in log}:
        mine = sorted((r.position, r.node) for r in log if r.tree == name)
        order = [r["_node"] for r in nodes.where(F.col("_tree") == name).orderBy("_i").collect()]
        tree = levels(order)
        assert mine == list(enumerate(postorder(tree, len(tree) - 1, 0)))


def test_empty_table_and_lone_leaf(spark):
    none = spark.createDataFrame([], "id long, lang string, leaf string")
    assert merkle.manifest(none, "lang", ["id"]).count() == 0
    one = merkle.manifest(spark.createDataFrame([(None, None, "ab")], none.schema), "lang", ["id"]).first()
    assert (one.subroot, one.root, one.siblings, one.sides) == ("ab", "ab", "", "")


def test_query_tells_tampered_rows(spark, tmp_path):
    rows = [(1, "a", "en", 3, "x y"), (None, None, None, None, None), (3, "", "en", None, ""), (3, "", "en", None, ""), (9, "é", "fr", 1, "é" * 3)] + [(k, "s", "de", k, "w" * k) for k in range(20, 60)]
    spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    import zlib

    got = queries.op11_merkle_manifest(spark, str(tmp_path)).collect()
    told = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = {r[0]: digest("".join(told(r[k]) for k in (0, 1, 2, 3, 4))) for r in rows}
    assert len(got) == len(rows) and all(r.leaf == leaf[r.doc_id] for r in got)
    bad = {r[0] for r in rows if r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0}
    assert bad and {r.doc_id for r in got if not r.verified} == bad
