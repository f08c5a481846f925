"""Captions, positions and pixel metrics against direct versions."""

import random

import numpy as np
import pytest

from labelscan.operators import overlays, pixels, positions

DECISIONS = "image_id int, pos int, text string, left int, top int, width int, height int, image_width int, image_height int"


def direct_captions(rows, char=6, line=11):
    """One image's captions, one after the other."""
    out, occupied = {}, []
    for _, pos, text, x, y, w, h, iw, ih in sorted(rows, key=lambda r: r[1]):
        if None in (x, y, w, h) or w <= 0 or h <= 0 or x + w <= 0 or y + h <= 0 or x >= iw or y >= ih:
            continue
        left, top, bottom = max(0, x), max(0, y), min(ih - 1, y + h)
        room = max(1, iw - 8)
        if char * len(text) > room:
            while text and char * (len(text) + 3) > room:
                text = text[:-1]
            text += "..."
        cw, ch = char * len(text) + 6, line + 6
        cx = min(left, max(0, iw - cw))
        cy = min(max(0, top - ch - 2 if top >= ch + 2 else bottom + 2), max(0, ih - ch))
        heights = [cy] + [cy + s * o for o in range(ch + 2, ih, ch + 2) for s in (1, -1)]
        for c in (min(max(0, c), max(0, ih - ch)) for c in heights):
            if not any(cx < o[2] and cx + cw > o[0] and c < o[3] and c + ch > o[1] for o in occupied):
                cy = c
                break
        occupied.append((cx, cy, cx + cw, cy + ch))
        out[pos] = (text, occupied[-1])
    return out


def test_captions(spark):
    rnd = random.Random(2)
    data = [(i, p, "x" * rnd.randrange(0, 40), rnd.choice([None, *range(-20, 130)]), rnd.randrange(-20, 110), rnd.randrange(-1, 60), rnd.randrange(0, 30), rnd.choice([1, 40, 120]) if i % 2 else 120, 14 if i % 5 == 0 else 100) for i in range(40) for p in range(9)]
    data = [(*r[:7], *data[9 * r[0]][7:]) for r in data]  # one size for an image
    got = {(r["image_id"], r["pos"]): (r["caption"], tuple(r["caption_box"])) for r in overlays.placed(spark.createDataFrame(data, DECISIONS)).collect()}
    want = {(i, p): v for i in range(40) for p, v in direct_captions([r for r in data if r[0] == i]).items()}
    assert got == want and len(want) > 100


def test_nearby_captions_do_not_overlap_and_edges_stay_inside(spark):
    data = [(1, 0, "Generic Product Name - PASS - BISCUITS", 20, 55, 80, 20, 300, 120), (1, 1, "Net Quantity - PASS - 100g", 120, 55, 50, 20, 300, 120), (2, 0, "Date - VIOLATION - 22/07/26", 110, 58, 20, 20, 120, 70), (3, 0, "Consumer Care - REVIEW", None, None, None, None, 200, 120)]
    got = {(r["image_id"], r["pos"]): r for r in overlays.placed(spark.createDataFrame(data, DECISIONS)).collect()}
    a, b = got[1, 0]["caption_box"], got[1, 1]["caption_box"]
    assert a["right"] <= b["left"] or b["right"] <= a["left"] or a["bottom"] <= b["top"] or b["bottom"] <= a["top"]
    assert (3, 0) not in got
    box, caption = got[2, 0]["box"], got[2, 0]["caption_box"]
    assert min(*box, *caption) >= 0 and box["right"] < 120 and box["bottom"] < 70 and caption["right"] <= 120 and caption["bottom"] <= 70


def test_positions_and_zip(spark):
    rnd = random.Random(5)
    data = [(rnd.choice([None, 1, 1, 1, *range(50)]), k) for k in range(500)]
    df = spark.createDataFrame(data, "v int, k int").repartition(5)
    want = {k: n for n, (_, k) in enumerate(sorted(data, key=lambda r: (r[0] is not None, r[0] or 0, r[1])))}
    for ranges in (2, 7, 200):
        assert {r["k"]: r["position"] for r in positions.with_positions(df, "v", "k", ranges=ranges).collect()} == want
    short = spark.createDataFrame([(x, chr(97 + n)) for n, x in enumerate((3.5, -1.0, 7.25))], "at double, name string")
    got = positions.zipped(spark.range(10), short, "id", "at")
    assert {(r["id"], r["name"]) for r in got.collect()} == {(0, "b"), (1, "a"), (2, "c")}
    assert positions.zipped(spark.range(0), short, "id", "at").collect() == [] and positions.with_positions(short.limit(0), "at").collect() == []
    uploads = spark.createDataFrame([(1, 0, None), (1, 1, " "), (1, 2, None), (1, 3, None), (1, 4, "top")], "id int, pos int, label string")
    assert [r["label"] for r in positions.labelled(uploads, "id").orderBy("pos").collect()] == ["front", "back", "side", "image-4", "top"]


def whole(raw, h, w, c):
    """Metrics of an image as one array."""
    g = pixels.grey(raw, h, w, c).astype(np.float64)
    pad = lambda g, n: np.pad(g, [(1, 1) if k == n else (0, 0) for k in (0, 1)], mode="reflect" if g.shape[n] > 1 else "edge")
    v, u = pad(g, 0), pad(g, 1)
    e = v[:-2] + v[2:] + u[:, :-2] + u[:, 2:] - 4 * g
    return e.var(), g.mean(), (g >= 250).mean(), g.std()


@pytest.mark.parametrize("side", (1, 2, 5, 64))
def test_pixel_metrics_of_tiles(spark, side):
    rnd = np.random.default_rng(side)
    data = [(k, w, h, c, rnd.integers(0, 256, w * h * c, dtype=np.uint8).tobytes()) for k, (w, h, c) in enumerate([(1, 1, 1), (1, 9, 1), (7, 1, 3), (5, 5, 4), (11, 13, 1), (6, 17, 3)])]
    data += [(90, 4, 4, 1, b"short"), (91, 0, 4, 1, b"x"), (92, 2, 2, 2, b"12345678"), (93, None, None, None, b"not an image"), (94, 3, 3, 1, None), (95, 3, 3, 1, b""), (96, -2, -2, 1, b"1234")]
    df = spark.createDataFrame(data, "id long, width int, height int, channels int, pixels binary").repartition(3)
    got = {r["id"]: r for r in pixels.metrics(df, side).collect()}
    for k, w, h, c, raw in data[:6]:
        assert [got[k][x] for x in ("blur", "brightness", "glare", "contrast")] == pytest.approx(whole(raw, h, w, c), abs=1e-6) and got[k]["problem"] is None
    assert {k: got[k]["problem"][36:-2] for k in got if k >= 90} == {90: "size and pixels differ", 91: "size and pixels differ", 92: "image must be grayscale, BGR, or BGRA", 93: "image must be grayscale, BGR, or BGRA", 94: "image must not be empty", 95: "image must not be empty", 96: "size and pixels differ"}


def test_unusable_images_are_reviewed_safely(spark):
    flat, dark = np.full((1200, 1600), 150, np.uint8), np.full((150, 200, 3), 20, np.uint8)
    sharp = np.kron(np.random.default_rng(0).integers(0, 2, (120, 160)) * 170 + 40, np.ones((10, 10))).astype(np.uint8)
    data = [(0, 1600, 1200, 1, flat.tobytes()), (1, 200, 150, 3, dark.tobytes()), (2, 1600, 1200, 1, sharp.tobytes()), (3, None, None, 1, b"not an image")]
    got = {r["id"]: r for r in pixels.assessed(pixels.metrics(spark.createDataFrame(data, "id long, width int, height int, channels int, pixels binary"), 256)).collect()}
    assert got[0]["readability_rank"] == 2 and got[0]["recommendation"] == "REVIEW" and got[1]["status"] == "POOR"
    assert got[2]["status"] == "GOOD" and got[2]["recommendation"] == "PROCEED" and got[2]["explanation"] == "Image quality is good and the label is likely readable."
    bad = got[3]
    assert (bad["status"], bad["quality_score"], bad["recommendation"], bad["allows_ocr"], bad["blur_score"]) == ("POOR", 0.0, "REVIEW", False, 0.0)
    assert bad["explanation"] == "Image quality needs review: Image could not be assessed safely (size and pixels differ)."
