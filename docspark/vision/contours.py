"""A card on a background: regions of five masks, their hulls as quads, the best of them by shape and size.

The search runs on a copy of at most ``SEARCH`` pixels a side, with sizes of
kernels in proportion, so its cost does not grow with the picture. A region
counts by its convex hull; edges are strong gradients, and weak ones beside them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from docspark import dims
from docspark.vision import image as im

SEARCH = 400
# Share of the picture that a card takes, and of each shape: least width and height, weight of the aspect, most it may be off.
LEAST, MOST, FULL = 0.22, 0.96, 0.65
FOUR_CORNERS, BOX = (0.45, 0.40, 0.70, 0.40), (0.45, 0.35, 0.65, 0.35)
ASPECT = dims.CANONICAL_WIDTH / dims.CANONICAL_HEIGHT
CONTENT_SCORE, NEAR, GROWN = 0.95, 0.04, 1.025


def _wider(mask: np.ndarray, size: int) -> np.ndarray:
    return im._most_around(mask, size) if size > 1 else mask


def _closed(mask: np.ndarray, size: int) -> np.ndarray:
    return ~_wider(~_wider(mask, size), size)


def _mean_around(g: np.ndarray, size: int) -> np.ndarray:
    p = np.pad(g.astype(np.float64), size // 2, mode="edge")
    total = np.pad(p.cumsum(axis=0).cumsum(axis=1), ((1, 0), (1, 0)))
    return (total[size:, size:] - total[:-size, size:] - total[size:, :-size] + total[:-size, :-size]) / size**2


def edges(g: np.ndarray, weak: float, strong: float) -> np.ndarray:
    """Where the gradient is strong, or weak next to strong."""
    slope = np.hypot(im.sobel_x(g), im.sobel_x(g.T).T)
    return (slope > weak) & _wider(slope > strong, 3)


def masks(image: np.ndarray) -> Iterator[np.ndarray]:
    """Tint, joined edges, local range, darker than around, edges at two scales."""
    g, part = im.gray(image), max(image.shape[:2]) / dims.PROCESSING_MAX_DIM
    odd = lambda size: max(3, int(size * part)) | 1
    tint = np.abs(image[:, :, 0].astype(np.float64) - image[:, :, 2])
    if tint.max() > tint.min():
        tint = im.softened(np.rint((tint - tint.min()) * 255 / (tint.max() - tint.min())).astype(np.uint8))
        yield _closed(tint > im.otsu(tint), odd(15))
    soft = im.softened(g)
    yield _closed(edges(soft, 35, 110), odd(11))
    spread = _wider(soft, 3).astype(np.int64) + _wider(255 - soft, 3) - 255
    spread = spread.astype(np.uint8)
    yield _wider(spread > im.otsu(spread), odd(9))
    yield _closed(soft < _mean_around(soft, odd(31)) - 6, odd(15))
    yield _wider(edges(soft, 30, 100), 3)
    h, w = g.shape
    if min(h, w) >= 8:
        half = _wider(edges(im.softened(im.resize(g, w // 2, h // 2)), 30, 100), 3)
        yield half[np.minimum(np.arange(h) // 2, h // 2 - 1)][:, np.minimum(np.arange(w) // 2, w // 2 - 1)]


def regions(mask: np.ndarray) -> list[np.ndarray]:
    """Of each set of touching pixels (corners count) the ends of its runs, as x, y."""
    step = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    (rows, first), last = np.nonzero(step == 1), np.nonzero(step == -1)[1] - 1
    root = list(range(len(rows)))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    starts = np.searchsorted(rows, np.arange(mask.shape[0] + 1))
    for y in range(1, mask.shape[0]):
        a, b = int(starts[y - 1]), int(starts[y])
        while a < starts[y] and b < starts[y + 1]:
            if first[a] <= last[b] + 1 and first[b] <= last[a] + 1:
                root[top(b)] = top(a)
            if last[a] < last[b]:
                a += 1
            else:
                b += 1
    of = np.array([top(i) for i in range(len(rows))], np.int64)
    order = np.argsort(of, kind="stable")
    groups = np.split(order, np.flatnonzero(np.diff(of[order])) + 1) if len(order) else []
    return [np.concatenate([np.stack([first[k], rows[k]], 1), np.stack([last[k], rows[k]], 1)]) for k in groups]


def hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull, in turn."""
    p = np.unique(points, axis=0).tolist()

    def chain(way: list[list[int]]) -> list[list[int]]:
        out: list[list[int]] = []
        for x, y in way:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (y - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (x - out[-2][0]):
                out.pop()
            out.append([x, y])
        return out[:-1]

    return np.array(chain(p) + chain(p[::-1]), np.float64) if len(p) > 2 else np.array(p, np.float64)


def area(polygon: np.ndarray) -> float:
    x, y = polygon.T
    return float(abs((x * np.roll(y, -1) - y * np.roll(x, -1)).sum()) / 2)


def four_corners(outline: np.ndarray) -> np.ndarray | None:
    """The hull with its flattest corners taken off until four are left; None if that strays from it."""
    left = outline
    while len(left) > 4:
        a, b = np.roll(left, 1, axis=0) - left, np.roll(left, -1, axis=0) - left
        left = np.delete(left, np.abs(a[:, 0] * b[:, 1] - a[:, 1] * b[:, 0]).argmin(), axis=0)
    side = np.roll(left, -1, axis=0) - left
    length = np.hypot(*side.T)
    if len(left) < 4 or not length.all():
        return None
    off = outline[:, None] - left[None]
    away = np.abs(side[:, 0] * off[:, :, 1] - side[:, 1] * off[:, :, 0]) / length
    around = np.hypot(*(np.roll(outline, -1, axis=0) - outline).T).sum()
    return left if away.min(axis=1).max() <= 0.028 * around else None


def least_box(outline: np.ndarray) -> np.ndarray:
    """The rectangle of least area around a hull: one of its sides lies on a side of the hull."""
    best, found = np.inf, outline
    for x, y in np.roll(outline, -1, axis=0) - outline:
        turn = np.array([[x, y], [-y, x]]) / np.hypot(x, y)
        (x0, y0), (x1, y1) = (outline @ turn.T).min(axis=0), (outline @ turn.T).max(axis=0)
        if (x1 - x0) * (y1 - y0) < best:
            best, found = (x1 - x0) * (y1 - y0), np.array([[x0, y0], [x1, y0], [x1, y1], [x0, y1]]) @ turn
    return found


def _score(quad: np.ndarray, share: float, shape: tuple[float, float, float, float], width: int, height: int, by_length: bool) -> float:
    """0 for what is too small or too far from the shape of a card."""
    least_w, least_h, weight, most_off = shape
    side = np.hypot(*(np.roll(quad, -1, axis=0) - quad).T)
    w, h = (side[0] + side[2]) / 2, (side[1] + side[3]) / 2
    w, h = (max(w, h), min(w, h)) if by_length else (w, h)
    off = abs(max(w, h) / max(min(w, h), 1e-6) - ASPECT) / ASPECT
    if w < least_w * width or h < least_h * height or off >= most_off:
        return 0.0
    return weight * max(0.0, 1 - off) + (1 - weight) * min(share / FULL, 1.0)


def best_quad(image: np.ndarray) -> tuple[np.ndarray, float] | None:
    """Corners and score of what looks most like a card; of equals the first."""
    h, w = image.shape[:2]
    shrunk = min(1.0, SEARCH / max(h, w))
    small = im.resize(image, max(1, round(w * shrunk)), max(1, round(h * shrunk))) if shrunk < 1 else image
    sh, sw = small.shape[:2]
    best, score = None, 0.0
    for mask in masks(small):
        for points in regions(mask):
            if np.prod(np.ptp(points, axis=0) + 1) < LEAST * sw * sh:
                continue
            outline = hull(points)
            share = area(outline) / (sw * sh) if len(outline) > 3 else 0.0
            if not LEAST <= share < MOST:
                continue
            for quad, shape, by_length in ((four_corners(outline), FOUR_CORNERS, False), (least_box(outline), BOX, True)):
                if quad is not None:
                    quad = im.order_corners(quad)
                    s = _score(quad, share, shape, sw, sh, by_length)
                    if s > score:
                        best, score = quad, s
    return None if best is None else (best * [w / sw, h / sh], score)


def card_corners(image: np.ndarray) -> tuple[np.ndarray, float]:
    """Corners of the card and how sure they are: what stands on a background, a little grown; else all that is no white frame."""
    content, found = im.content_quad(image), best_quad(image)
    if found is None:
        return content, CONTENT_SCORE
    quad, score = found
    low, high = content.min(axis=0), content.max(axis=0)
    size = np.maximum(high - low, 1.0)
    margins = np.maximum(np.r_[(quad.min(axis=0) - low) / size, (high - quad.max(axis=0)) / size], 0)
    if margins.min() < NEAR and area(quad) > size.prod() * FULL:
        return content, CONTENT_SCORE
    middle = quad.mean(axis=0)
    return np.clip(middle + GROWN * (quad - middle), low, high), score
