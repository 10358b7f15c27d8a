import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrylens.llm import merkle_manifest as M

DOCS = "doc_id long, text string, lang string, source string, n_chars long, leaf string, root int"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(*fields):
    return H(*("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def tree(leaves):
    """Levels of a tree of three."""
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i : i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def path(levels, i):
    out = []
    for level in levels[:-1]:
        run = range(i // 3 * 3, min(i // 3 * 3 + 3, len(level)))
        out.append(([level[k] for k in run if k < i], [level[k] for k in run if k > i]))
        i //= 3
    return out


def brute(rows, change):
    """doc_id, leaf, subroot, root, proof, folded, verified of (doc_id, text, lang, source, n_chars) rows."""
    by = {}
    for doc_id, text, lang, source, n in rows:
        own = leaf(doc_id, source, lang, n, text)
        by.setdefault(source, []).append((doc_id is not None, doc_id or 0, own, leaf(doc_id, source, lang, n, change(doc_id, text)), doc_id))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(by[s])]) for s in names}
    top = tree([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, (_, _, own, other, doc_id) in enumerate(sorted(by[s])):
            steps = path(trees[s], i) + path(top, k)
            cur = other
            for left, right in steps:
                cur = H(*left, cur, *right)
            out.append((doc_id, own, trees[s][-1][0], top[-1][0], H(*(x for left, right in steps for x in left + right)), cur, cur == top[-1][0]))
    return sorted(out, key=str)


def newlines(doc_id, text):
    import zlib

    return text.replace("\n", "") if text is not None and doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0 else text


def received():
    torn = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
    return [torn if c == "text" else F.col(c) for c in M.FIELDS]


@pytest.mark.parametrize("levels", [1, 2, 8])
def test_against_brute_force(spark, levels):
    r = random.Random(levels)
    rows = [(i, r.choice(["a\nb", "x", None, "", "é\n\n"]), r.choice(["en", None]), r.choice(["hot"] * 60 + ["b", "B", "é", None, "one"]), r.choice([3, None])) for i in range(150)]
    rows += [(151, "only", "en", "alone", 4), (None, "n\n", "en", "hot", 1), (None, None, None, None, None), (7, "x", "en", "hot", 3), (7, "x", "en", "hot", 3)]
    docs = spark.createDataFrame([(*x, "clash", 1) for x in rows], DOCS)
    got = [tuple(x) for x in M.merkle_manifest(docs.repartition(5), received=received(), depth=levels).collect()]
    assert sorted(got, key=str) == brute(rows, newlines)
    assert {x[-1] for x in got} == {True, False}


def test_every_size(spark):
    for n in [*range(1, 30), 81, 82, 100]:
        leaves = [H(str(i)) for i in range(n)]
        levels = M.levels_of(np.frombuffer("".join(leaves).encode(), np.uint8).reshape(-1, 64), len(tree(leaves)) - 1)
        assert [[row.tobytes().decode() for row in level] for level in levels] == tree(leaves)
        for i in range(n):
            way = M.siblings(levels, i)
            assert M.unpack_path(M.pack_path(way)) == way
            assert M.fold(leaves[i].encode(), way).decode() == tree(leaves)[-1][0]


def test_numbers_do_not_depend_on_partitions(spark):
    rows = [("a", i % 50) for i in range(3000)] + [("b", 1)] * 500 + [(c, 0) for c in "cdefgh"]
    for parts in (1, 7):
        got = M.numbered(spark.createDataFrame(rows, "run string, id int").repartition(parts), "run", ["id"], "numbered-test").collect()
        for name in "abcdefgh":
            mine = sorted((x for x in got if x.run == name), key=lambda x: x["at"])
            assert [x["at"] for x in mine] == list(range(len(mine))) and [x.id for x in mine] == sorted(x.id for x in mine)


def test_defined_cases(spark):
    empty = spark.createDataFrame([], DOCS)
    assert M.merkle_manifest(empty).count() == 0
    one = M.merkle_manifest(spark.createDataFrame([(1, "t" * 300_000, None, None, None, "", 0)], DOCS)).first()
    assert one.leaf == one.subroot == one.root == one.folded_root == leaf(1, None, None, None, "t" * 300_000) and one.verified and one.proof_sha256 == H()
