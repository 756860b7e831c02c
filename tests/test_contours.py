"""Cards on backgrounds, and the steps that find them."""

import numpy as np
import pytest

from docspark.vision import contours
from docspark.vision import image as im


def on_a_desk(corners, size=(1200, 900), colour=(60, 95, 150), seed=1):
    """A drawn card at these corners over a noisy background."""
    w, h = size
    card = im.drawn_card(856, 540, seed)
    rng = np.random.default_rng(seed)
    out = np.clip(np.array(colour) + rng.normal(0, 4, (h, w, 1)), 0, 255).astype(np.uint8)
    m = im.homography(np.array(corners, np.float64), np.array([[0, 0], [855, 0], [855, 539], [0, 539]], np.float64))
    y, x = np.mgrid[0:h, 0:w]
    z = m[2, 0] * x + m[2, 1] * y + m[2, 2]
    u, v = np.rint((m[0, 0] * x + m[0, 1] * y + m[0, 2]) / z).astype(int), np.rint((m[1, 0] * x + m[1, 1] * y + m[1, 2]) / z).astype(int)
    inside = (u >= 0) & (u < 856) & (v >= 0) & (v < 540)
    out[inside] = card[v[inside], u[inside]]
    return out


@pytest.mark.parametrize("corners", [
    [[200, 180], [1000, 180], [1000, 685], [200, 685]],
    [[230, 140], [1010, 240], [945, 740], [165, 640]],
    [[180, 200], [1020, 170], [990, 700], [210, 680]],
])
@pytest.mark.parametrize("colour", [(60, 95, 150), (30, 30, 30)])
def test_card_on_a_desk(corners, colour):
    quad, score = contours.card_corners(on_a_desk(corners, colour=colour))
    true = np.array(corners, np.float64)
    grown = true.mean(axis=0) + contours.GROWN * (true - true.mean(axis=0))
    assert score > 0.8 and np.abs(quad - grown).max() < 0.03 * 1200


def test_card_that_fills_the_picture():
    for size in ((428, 270), (1600, 1009)):
        card = im.drawn_card(*size, 3)
        quad, score = contours.card_corners(card)
        assert score == contours.CONTENT_SCORE and (quad == im.content_quad(card)).all()
    for blank in (np.full((50, 80, 3), 255, np.uint8), np.zeros((1, 1, 3), np.uint8), np.full((5, 3, 3), 9, np.uint8)):
        assert contours.card_corners(blank)[1] == contours.CONTENT_SCORE


def test_regions_and_hulls():
    mask = np.zeros((12, 12), bool)
    mask[1:4, 1:5], mask[4, 5], mask[8:11, 7:11] = True, True, True
    sizes = sorted(tuple(np.ptp(p, axis=0).tolist()) for p in contours.regions(mask))
    assert sizes == [(3, 2), (4, 3)]
    assert contours.regions(np.zeros((3, 3), bool)) == []
    u = np.array(["#..#", "#..#", "####"])
    assert len(contours.regions(np.array([list(r) for r in u]) == "#")) == 1
    outline = contours.hull(np.array([[0, 0], [4, 0], [4, 2], [0, 2], [2, 1], [2, 0]]))
    assert len(outline) == 4 and contours.area(outline) == 8


def test_least_box_of_a_turned_rectangle():
    a = np.deg2rad(20)
    turn = np.array([[np.cos(a), -np.sin(a)], [np.sin(a), np.cos(a)]])
    box = np.array([[0, 0], [10, 0], [10, 4], [0, 4]]) @ turn.T
    got = contours.least_box(np.vstack([box[:1], (box[:1] + box[1:2]) / 2, box[1:]]))
    assert contours.area(got) == pytest.approx(40)
    assert contours.four_corners(contours.hull(np.array([[np.cos(t), np.sin(t)] for t in np.linspace(0, 6.2, 40)]) * 100)) is None
