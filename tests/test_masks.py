"""Copies of one mask collapse by region and size."""

import random

import pytest

from assaymill.operators import corpus as C
from assaymill.operators import splits as S


def fold(files):
    """The rule file by file: name, region, size."""
    held = {}
    for name, roi, size in sorted(files):
        rank = ("(" in name, len(name), name)
        if roi not in held or held[roi][1] == size or rank < held[roi][2]:
            held[roi] = (name, size, rank)
    return {roi: v[0] for roi, v in held.items()}


CASES = [
    [("a_palpebral(1).png", "palpebral", 10), ("a_palpebral.png", "palpebral", 10)],
    [("a_papebral.png", "palpebral", 10), ("a_palpebral(1).png", "palpebral", 11)],
    [("a_papebral.png", "palpebral", 10), ("a_palpebral.png", "palpebral", 10)],
    [("a_forniceal.png", "forniceal", 5), ("b_forniceal.png", "forniceal", 6), ("b_forniceal(2).png", "forniceal", 5)],
    [("x_forniceal_palpebral.png", "forniceal_palpebral", 1)],
]
_rng = random.Random(6)
for _ in range(30):
    names = _rng.sample(["a_palpebral.png", "a_papebral.png", "a_palpebral(1).png", "b_palpebral.png", "b_palpebral(2).png", "cc_palpebral.png"], _rng.randint(2, 6))
    CASES.append([(n, "palpebral", _rng.randint(1, 3)) for n in names])


def test_collapsed_masks(spark):
    rows = [("s", str(k), name, size, f"s/{k}/{name}") for k, files in enumerate(CASES) for name, _, size in files]
    rows += [("s", "0", "photo.jpg", 10, "s/0/photo.jpg"), ("s", "99", "photo.png", 3, "s/99/photo.png")]
    df = spark.createDataFrame(rows, "site string, folder string, name string, length long, path string").repartition(3)
    got = {}
    for r in C.collapsed_masks(df).collect():
        got.setdefault(int(r.folder), {})[r.roi] = r.path.rsplit("/", 1)[1]
    assert got == {k: fold(files) for k, files in enumerate(CASES)}


def test_folds_keep_every_assignment(spark):
    people = spark.createDataFrame([(f"p{k}", k) for k in range(20)], "id string, v int")
    folds = S.kfold(people, "id")
    joined = S.with_records(folds, people.where("v < 15"), "id")
    assert joined.count() == 100 and joined.where("v IS NULL").count() == 25


@pytest.mark.parametrize("sites", [["a", "b", "c"], ["a", "b"]])
def test_site_holdout_rows(spark, sites):
    people = spark.createDataFrame([(f"{s}{k}", s) for s in "abcd" for k in range(4)], "id string, site string")
    rows = S.site_holdout(people, "id", "site", sites).collect()
    want = {(f"{a}->{b}", f"{s}{k}", "train" if s == a else "test") for a in sites for b in sites if a != b for s in (a, b) for k in range(4)}
    assert {(r.fold, r.id, r.split) for r in rows} == want and len(rows) == len(want)
