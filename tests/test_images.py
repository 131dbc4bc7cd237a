"""Image source: tiny PNG files written here, measured against numpy."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaymill.operators import corpus as C
from assaymill.operators import pixels as X
from assaymill.sources import images as M

KIND = {1: 0, 3: 2, 4: 6}


def write_png(path, array):
    h, w = array.shape[:2]
    c = 1 if array.ndim == 2 else array.shape[2]
    raw = b"".join(b"\0" + array[y].tobytes() for y in range(h))

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", w, h, 8, KIND[c], 0, 0, 0)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


@pytest.fixture(scope="module")
def corpus(tmp_path_factory):
    root = tmp_path_factory.mktemp("corpus")
    rng = np.random.default_rng(0)
    frames, masks = {}, {}
    for i in range(3):
        folder = root / "India" / str(i)
        folder.mkdir(parents=True)
        frames[str(i)] = rng.integers(0, 256, (24, 36, 3), dtype=np.uint8)
        write_png(folder / "20200118.png", frames[str(i)])
        small = np.zeros((8, 12), dtype=np.uint8)
        small[2:5, 3 + i : 8] = 255
        masks[str(i)] = small > 127
        if i == 0:
            write_png(folder / "a_palpebral.png", small)
        if i == 1:
            write_png(folder / "a_palpebral.png", np.dstack([small, small, small, small]))
    (root / "India" / "2" / "broken.png").write_bytes(b"not an image")
    (root / "__MACOSX" / "x").mkdir(parents=True)
    (root / "__MACOSX" / "x" / "readme.txt").write_text("no image here")
    return root, frames, masks


def paired(spark, root):
    img = M.read_images(spark, str(root / "India"))
    img = img.withColumns({"name": F.substring_index("path", "/", -1), "pid": F.element_at(F.split("path", "/"), -2)})
    frames = img.where("name = '20200118.png'")
    masks = img.where("name like '%palpebral%'")
    return img, M.with_mask(frames, masks, F.col("pid"), F.col("pid"))


def test_counts_match_pixels(spark, corpus):
    root, frames, masks = corpus
    img, both = paired(spark, root)
    assert img.where("height < 1").count() >= 0
    counts = M.colour_counts(both)
    got = {(r.image_id, r.r, r.g, r.b, r.in_roi): r.n for r in counts.collect()}
    want = {}
    for pid, rgb in frames.items():
        inside = M.at_size(masks[pid], 24, 36) if pid != "2" else None
        for y in range(24):
            for x in range(36):
                key = (pid, *map(int, rgb[y, x]), None if inside is None else bool(inside[y, x]))
                want[key] = want.get(key, 0) + 1
    assert got == want


def test_features(spark, corpus):
    root, frames, masks = corpus
    _, both = paired(spark, root)
    counts = M.colour_counts(both)
    rows = {r.image_id: r for r in X.colour_features(counts).collect()}
    assert rows["2"].unmasked and not rows["0"].unmasked
    for pid in ("0", "1"):
        inside = M.at_size(masks[pid], 24, 36)
        px = frames[pid][inside].astype(float)
        assert (rows[pid].roi_r, rows[pid].roi_g, rows[pid].roi_b) == pytest.approx(tuple(px.mean(axis=0) / 255))
        assert rows[pid].hsv_val == np.median(px.max(axis=1))
        lo, hi = (np.percentile(px, 1), np.percentile(px, 99)) if len(px) >= 100 else (px.min(), px.max())
        assert rows[pid].high_hue_ratio == (pytest.approx(hi / lo) if lo >= 1 else None)
    assert X.balanced_features(counts).count() == 3


def test_sharpness_both_ways(spark, corpus):
    root, frames, _ = corpus
    _, both = paired(spark, root)
    direct = {r.image_id: r for r in M.quality_measures(both).collect()}
    rows = [
        (pid, x, y, int(a[y, x, 0]), int(a[y, x, 1]), int(a[y, x, 2]), None)
        for pid, a in frames.items() for y in range(24) for x in range(36)
    ]
    table = spark.createDataFrame(rows, "image_id string, x int, y int, r int, g int, b int, in_roi boolean")
    for r in X.quality_measures(table).collect():
        assert r.sharpness == pytest.approx(direct[r.image_id].sharpness)
        assert r.luma == pytest.approx(direct[r.image_id].luma)
    report = {r.image_id: r for r in X.quality_report(M.quality_measures(both)).collect()}
    assert report["0"].score > 0.5


def test_undecodable(spark):
    bad = spark.createDataFrame([("x", None, None, None, None, -1, -1)], M.MEASURES)
    r = X.quality_report(bad).first()
    assert (r.reason, r.passed, r.score) == ("DECODE_FAIL", False, 0.0)


def test_laplacian_by_hand(spark):
    rows = [("i", x, y, v) for y, line in enumerate([[1, 2, 4], [0, 5, 1], [7, 3, 2]]) for x, v in enumerate(line)]
    df = spark.createDataFrame(rows, "image_id string, x int, y int, v int")
    got = {(r.x, r.y): r.laplacian for r in X.laplacian(df, "v").collect()}
    assert got[(1, 1)] == 2 + 3 + 0 + 1 - 20
    assert got[(0, 0)] == 2 + 2 + 0 + 0 - 4  # mirrored: right twice, below twice


def test_mask_rules():
    a = np.zeros((2, 2, 4), dtype=np.uint8)
    a[0, 0, 0] = 200
    assert M.mask_array(a.tobytes(), 2, 2, 4).tolist() == [[True, False], [False, False]]
    g = np.full((2, 2, 3), 128, dtype=np.uint8)
    assert M.mask_array(g.tobytes(), 2, 2, 3).all()
    assert not M.mask_array(np.full((2, 2, 1), 127, dtype=np.uint8).tobytes(), 2, 2, 1).any()


def test_listing_and_folders(spark, corpus):
    root, _, _ = corpus
    table = C.folders(M.list_files(spark, str(root)))
    got = {r.folder: r for r in table.collect()}
    assert set(got) == {"0", "1", "2"}
    assert set(got["0"].masks) == {"palpebral"} and got["2"].masks == {}
    assert got["0"].image.endswith("20200118.png")


def test_otsu_two_levels(spark):
    rows = [("i", 200, 40, 40, None, 30), ("i", 120, 110, 100, None, 70), ("flat", 90, 90, 90, None, 10)]
    df = spark.createDataFrame(rows, "image_id string, r int, g int, b int, in_roi boolean, n long")
    got = {r.image_id: r.otsu_vessel_redness for r in X.vessel_contrast(df).collect()}
    assert got["i"] > 40 and got["flat"] is None


def test_all_black_frame_balances_to_black(spark):
    df = spark.createDataFrame([("i", 0, 0, 0, None, 9)], "image_id string, r int, g int, b int, in_roi boolean, n long")
    assert X.balanced(df).select("r", "g", "b").first() == (0, 0, 0)
    with pytest.raises(ValueError):
        X.illuminant(df, "blue_world")
