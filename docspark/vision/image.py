"""Image functions in numpy: decoding, scaling, quality, quads, rectification, block scores, field regions.

Images are height x width x 3 arrays of bytes, blue first. Kernels of image
libraries (area and cubic scaling, Lanczos) are replaced by
plain numpy ones, so pixels may differ by rounding while the rules are the same.
"""

from __future__ import annotations

import re
import zlib

import numpy as np

from docspark import dims


#: Pixels as they are, after a line of planes (1, 3 or 4, blue first), width and height.
_PLAIN = re.compile(rb"BGR([134]) (\d+) (\d+)\n")


def decode(raw: bytes | None) -> np.ndarray | None:
    """A PNG, a binary PGM or PPM of 8 bits, or plain pixels; None for anything else, which is then a row with an error, not a failure.

    Pictures in files, JPEG among them, come as plain pixels from ``uploads.pictures``.
    """
    raw = raw or b""
    if raw.startswith(b"\x89PNG\r\n\x1a\n"):
        return _png(raw)
    plain, m = _PLAIN.match(raw), re.match(rb"P([56])\s+(\d+)\s+(\d+)\s+255\s", raw)
    if plain:
        planes, w, h, at = int(plain[1]), int(plain[2]), int(plain[3]), plain.end()
    elif m:
        planes, w, h, at = 3 if m[1] == b"6" else 1, int(m[2]), int(m[3]), m.end()
    else:
        return None
    if not w * h or len(raw) - at < w * h * planes:
        return None
    pixels = np.frombuffer(raw, np.uint8, w * h * planes, at).reshape(h, w, planes)
    if planes == 1:
        return np.repeat(pixels, 3, axis=2)
    return pixels[:, :, :3].copy() if plain else pixels[:, :, ::-1].copy()


def _png(raw: bytes) -> np.ndarray | None:
    """A PNG of 8 bits a sample that is not interlaced: gray, colour or palette, with or without alpha (which is dropped)."""
    at, data, palette, header = 8, [], None, None
    while at + 12 <= len(raw):
        size, kind = int.from_bytes(raw[at : at + 4], "big"), raw[at + 4 : at + 8]
        part = raw[at + 8 : at + 8 + size]
        header = part if kind == b"IHDR" else header
        palette = np.frombuffer(part[: len(part) // 3 * 3], np.uint8).reshape(-1, 3) if kind == b"PLTE" else palette
        if kind == b"IDAT":
            data.append(part)
        at += size + 12
    if not header or len(header) < 13 or header[8] != 8 or header[12] or header[9] not in _SAMPLES or (header[9] == 3 and palette is None):
        return None
    w, h, planes = int.from_bytes(header[:4], "big"), int.from_bytes(header[4:8], "big"), _SAMPLES[header[9]]
    try:
        lines = zlib.decompress(b"".join(data))
    except zlib.error:
        return None
    if not w * h or len(lines) < h * (w * planes + 1):
        return None
    lines = np.frombuffer(lines, np.uint8, h * (w * planes + 1)).reshape(h, -1)
    out, above = np.empty((h, w, planes), np.uint8), np.zeros((w, planes), np.int64)
    for y, line in enumerate(lines):
        above = _unfiltered(line[0], line[1:].reshape(w, planes).astype(np.int64), above)
        out[y] = above
    if header[9] == 3:
        return palette[np.minimum(out[:, :, 0], len(palette) - 1)][:, :, ::-1].copy()
    return out[:, :, 2::-1].copy() if planes >= 3 else np.repeat(out[:, :, :1], 3, axis=2)


#: Samples of a pixel by colour type.
_SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def _unfiltered(kind: int, line: np.ndarray, above: np.ndarray) -> np.ndarray:
    """A line of a PNG from what is stored of it and the line above."""
    if kind == 0:
        return line
    if kind == 1:
        return line.cumsum(axis=0) & 255
    if kind == 2:
        return (line + above) & 255
    left, corner, out = np.zeros(line.shape[1], np.int64), np.zeros(line.shape[1], np.int64), np.empty_like(line)
    for x in range(len(line)):
        up = above[x]
        if kind == 3:
            guess = (left + up) // 2
        else:
            p = left + up - corner
            by = np.abs(np.stack([p - left, p - up, p - corner]))
            guess = np.choose(by.argmin(axis=0), [left, up, corner])
        left, corner = (line[x] + guess) & 255, up
        out[x] = left
    return out


def encode(image: np.ndarray) -> bytes:
    return f"P6 {image.shape[1]} {image.shape[0]} 255\n".encode() + np.ascontiguousarray(image[:, :, ::-1]).tobytes()


def gray(image: np.ndarray) -> np.ndarray:
    if image.ndim == 2:
        return image
    return np.rint(image @ np.array([0.114, 0.587, 0.299])).astype(np.uint8)


def hsv(image: np.ndarray) -> np.ndarray:
    """Hue in half degrees, saturation and value in 0 to 255."""
    b, g, r = (image[:, :, k].astype(np.float64) for k in range(3))
    top, low = np.maximum(np.maximum(r, g), b), np.minimum(np.minimum(r, g), b)
    span = top - low
    safe = np.where(span > 0, span, 1)
    hue = np.where(top == r, (g - b) / safe, np.where(top == g, 2 + (b - r) / safe, 4 + (r - g) / safe)) * 60
    saturation = np.where(top > 0, span / np.where(top > 0, top, 1) * 255, 0)
    return np.stack([np.where(span > 0, hue % 360 / 2, 0), saturation, top], axis=2)


def resize(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """Bilinear; the mean of the covered pixels where it shrinks by two or more."""
    data = image.astype(np.float64)
    for axis, n in ((0, height), (1, width)):
        size = data.shape[axis]
        if size >= 2 * n:
            cuts = (np.arange(n) * size) // n
            data = np.add.reduceat(data, cuts, axis=axis) / np.diff(np.append(cuts, size)).reshape([-1 if a == axis else 1 for a in range(data.ndim)])
        else:
            at = np.clip((np.arange(n) + 0.5) * size / n - 0.5, 0, size - 1)
            low = np.floor(at).astype(int)
            part = (at - low).reshape([-1 if a == axis else 1 for a in range(data.ndim)])
            data = data.take(low, axis) * (1 - part) + data.take(np.minimum(low + 1, size - 1), axis) * part
    return np.rint(data).astype(np.uint8)


def normalize(image: np.ndarray) -> tuple[np.ndarray, float]:
    """Longest side to the processing size, enlarged four times at the utmost; and the scale."""
    h, w = image.shape[:2]
    scale = min(dims.PROCESSING_MAX_DIM / max(w, h), 4.0)
    return resize(image, round(w * scale), round(h * scale)), scale


def _around(g: np.ndarray) -> np.ndarray:
    return np.pad(g.astype(np.float64), 1, mode="reflect" if min(g.shape) > 1 else "edge")


def blur_score(g: np.ndarray) -> float:
    p = _around(g)
    return float((p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * p[1:-1, 1:-1]).var())


def sobel_x(g: np.ndarray) -> np.ndarray:
    p = _around(g)
    d = p[:, 2:] - p[:, :-2]
    return d[:-2] + 2 * d[1:-1] + d[2:]


def measures(image: np.ndarray) -> dict[str, float]:
    g = gray(image)
    return {"blur_score": blur_score(g), "brightness": float(g.mean()), "contrast": float(g.std()), "glare_ratio": float((g > 245).mean())}


def crop_issues(crop: np.ndarray | None) -> list[str]:
    if crop is None or not crop.size:
        return ["empty_crop"]
    g = gray(crop)
    return ["crop_too_small"] * (g.shape[0] < dims.CROP_HEIGHT_MIN) + ["crop_blurry"] * (blur_score(g) < dims.BLUR_MIN * 0.5)


def content_quad(image: np.ndarray, white: int = 250) -> np.ndarray:
    """Corners of what is not a white frame; of all, if nothing is."""
    inked = gray(image) < white
    rows, columns = np.flatnonzero(inked.any(axis=1)), np.flatnonzero(inked.any(axis=0))
    h, w = image.shape[:2]
    y0, y1 = (rows[0], rows[-1]) if len(rows) else (0, h - 1)
    x0, x1 = (columns[0], columns[-1]) if len(columns) else (0, w - 1)
    return np.array([[x0, y0], [x1, y0], [x1, y1], [x0, y1]], np.float64)


def order_corners(points: np.ndarray) -> np.ndarray:
    """Top left, top right, bottom right, bottom left: by height, then by side; by angle around the middle if that crosses."""
    p = np.asarray(points, np.float64).reshape(4, 2)
    by_y = p[np.argsort(p[:, 1], kind="stable")]
    top, bottom = by_y[:2][np.argsort(by_y[:2, 0], kind="stable")], by_y[2:][np.argsort(by_y[2:, 0], kind="stable")]
    quad = np.array([top[0], top[1], bottom[1], bottom[0]])
    edge = np.roll(quad, -1, axis=0) - quad
    following = np.roll(edge, -1, axis=0)
    if (edge[:, 0] * following[:, 1] - edge[:, 1] * following[:, 0] < 0).any():
        middle = p.mean(axis=0)
        quad = p[np.argsort(np.arctan2(p[:, 1] - middle[1], p[:, 0] - middle[0]), kind="stable")]
        quad = np.roll(quad, -int(quad.sum(axis=1).argmin()), axis=0)
    return quad


def homography(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    rows, right = [], []
    for (x, y), (u, v) in zip(source, target, strict=True):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        right += [u, v]
    return np.append(np.linalg.solve(np.array(rows, np.float64), np.array(right, np.float64)), 1).reshape(3, 3)


def rectify(image: np.ndarray, corners: np.ndarray, width: int = dims.CANONICAL_WIDTH, height: int = dims.CANONICAL_HEIGHT) -> np.ndarray:
    """The quad as a full card, by bilinear look-up."""
    card = np.array([[0, 0], [width - 1, 0], [width - 1, height - 1], [0, height - 1]], np.float64)
    m = homography(card, order_corners(corners))
    y, x = np.mgrid[0:height, 0:width]
    z = m[2, 0] * x + m[2, 1] * y + m[2, 2]
    u, v = (m[0, 0] * x + m[0, 1] * y + m[0, 2]) / z, (m[1, 0] * x + m[1, 1] * y + m[1, 2]) / z
    u, v = np.clip(u, 0, image.shape[1] - 1), np.clip(v, 0, image.shape[0] - 1)
    x0, y0 = u.astype(int), v.astype(int)
    x1, y1 = np.minimum(x0 + 1, image.shape[1] - 1), np.minimum(y0 + 1, image.shape[0] - 1)
    fx, fy = (u - x0)[:, :, None], (v - y0)[:, :, None]
    out = (image[y0, x0] * (1 - fx) + image[y0, x1] * fx) * (1 - fy) + (image[y1, x0] * (1 - fx) + image[y1, x1] * fx) * fy
    return np.rint(out).astype(np.uint8)


def _part(image: np.ndarray, y0: float, y1: float, x0: float, x1: float) -> np.ndarray:
    h, w = image.shape[:2]
    return image[int(y0 * h) : int(y1 * h), int(x0 * w) : int(x1 * w)]


def photo_score(card: np.ndarray) -> float:
    region = _part(card, 0.05, 0.67, 0.03, 0.31)
    if not region.size:
        return 0.0
    c = hsv(region)
    return min(float(c[:, :, 1].std() + c[:, :, 2].std()) / 110.0, 1.0)


def edge_density(image: np.ndarray) -> float:
    return float((np.abs(sobel_x(gray(image))) > 40).mean()) if image.size else 0.0


def barcode_score(card: np.ndarray) -> float:
    return min(edge_density(_part(card, 0.50, 0.98, 0.30, 0.98)) * 3.0, 1.0)


def barcode_present(crop: np.ndarray | None) -> bool:
    return crop is not None and crop.size > 0 and edge_density(crop) > 0.15


def _most_around(g: np.ndarray, size: int) -> np.ndarray:
    """The brightest value in a square around each pixel: the paper behind the ink."""
    for axis in (0, 1):
        p = np.pad(g, [(size // 2, size // 2) if a == axis else (0, 0) for a in (0, 1)], mode="edge")
        g = np.lib.stride_tricks.sliding_window_view(p, size, axis=axis).max(axis=-1)
    return g


def ink(image: np.ndarray, size: int, most: int) -> np.ndarray:
    g = gray(image)
    paper = _most_around(g, size).astype(np.float64)
    return np.rint(g * 255.0 / np.maximum(paper, 1)) < most


def header_bottom(card: np.ndarray) -> int:
    """Below the green band and the line of print under it: where fields may begin."""
    h, w = card.shape[:2]
    c = hsv(card[: int(0.38 * h), int(0.28 * w) :])
    green = (c[:, :, 0] >= 28) & (c[:, :, 0] <= 95) & (c[:, :, 1] >= 30) & (c[:, :, 2] >= 30) & (c[:, :, 2] <= 235)
    rows = np.flatnonzero(green.sum(axis=1) >= max(8, int(w * 0.70 * 0.018)))
    band = int(rows[-1]) + 12 if len(rows) else int(0.24 * h)
    low, left = min(h, band + int(0.15 * h)), int(0.33 * w)
    if low > band:
        lines = np.flatnonzero(ink(card[band:low, left:], 15, 180).sum(axis=1) >= max(8, int((w - left) * 0.03)))
        if len(lines):
            return max(band, min(band + int(lines[-1]) + 14, int(0.37 * h)))
    return max(band, int(0.28 * h))


def otsu(g: np.ndarray) -> int:
    """The threshold that parts dark from light with the greatest variance between them."""
    counts = np.bincount(g.ravel(), minlength=256).astype(np.float64)
    below, mass = counts.cumsum(), (counts * np.arange(256)).cumsum()
    above = below[-1] - below
    with np.errstate(divide="ignore", invalid="ignore"):
        between = below * above * (mass / below - (mass[-1] - mass) / above) ** 2
    return int(np.nan_to_num(between).argmax())


def softened(g: np.ndarray) -> np.ndarray:
    """By the five-tap binomial kernel both ways."""
    for axis in (0, 1):
        p = np.pad(g.astype(np.float64), [(2, 2) if a == axis else (0, 0) for a in (0, 1)], mode="reflect" if min(g.shape) > 2 else "edge")
        g = sum(k * p.take(np.arange(i, i + g.shape[axis]), axis) for i, k in enumerate((1, 4, 6, 4, 1))) / 16
    return np.rint(g).astype(np.uint8)


def number_strip(card: np.ndarray) -> tuple[int, int, float]:
    """Top, bottom and confidence of the strip of digits: around the middle of the rows with ink, else where it usually is."""
    h, w = card.shape[:2]
    window = slice(int(0.70 * h), int(0.89 * h))
    digits = softened(gray(card)[window, int(0.33 * w) :]) if card[window, int(0.33 * w) :].size else np.zeros((0, 0), np.uint8)
    per_row = (digits <= otsu(digits)).sum(axis=1) if digits.size else np.zeros(0, np.int64)
    inked = np.flatnonzero(per_row >= per_row.max(initial=1) * 0.15)
    height = max(int(0.14 * h), int(len(inked) * 1.5))
    usual = int(0.71 * h), int(0.88 * h)
    if not digits.size:
        y0, y1, confidence = *usual, 0.75
    elif not len(inked):
        y0, y1, confidence = *usual, 0.85
    else:
        y0 = np.clip(window.start + int(inked.mean()) - int(height * 0.45), window.start, int(0.74 * h))
        y1, confidence = min(window.stop, y0 + height), 0.95
    return max(int(0.710 * h), int(y0)), min(int(0.880 * h), max(int(0.860 * h), int(y1))), confidence


def runs(places: np.ndarray, gap: int, least: int) -> list[tuple[int, int]]:
    """First and last of each run of places, cut at steps above ``gap``; runs shorter than ``least`` do not count."""
    if not len(places):
        return []
    cuts = np.flatnonzero(np.diff(places) > gap)
    firsts, lasts = places[np.r_[0, cuts + 1]], places[np.r_[cuts, len(places) - 1]]
    return [(int(a), int(b)) for a, b in zip(firsts, lasts, strict=True) if b - a >= least]


#: By lines of print: those of the name, margin of its end, distance from the middle between both, and how far down it may reach.
_BLOCKS = {1: (1, 6, 0, 0.490), 2: (1, 4, 2, 1.0), 3: (2, 6, 0, 0.490)}


def text_blocks(card: np.ndarray, start: int) -> dict[str, tuple[int, int]]:
    """Top and bottom of the name and of the address, by the lines of print below ``start``."""
    h, w = card.shape[:2]
    low = int(0.710 * h)
    top = start if start < low - 40 else int(0.28 * h)
    profile = ink(card, 19, 185)[top:low, int(0.33 * w) : int(0.98 * w)].sum(axis=1).astype(np.float64)
    size = max(5, int(h * 0.015)) | 1
    spread = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    kernel = np.exp(-((np.arange(size) - size // 2) ** 2) / (2 * spread**2))
    smooth = np.convolve(np.pad(profile, size // 2, mode="reflect"), kernel / kernel.sum(), mode="valid")
    active = np.flatnonzero(smooth > max(20.0, float(np.percentile(smooth, 40))))
    lines = [(top + a, top + b) for a, b in runs(active, 6, 8)] if len(active) > 30 else []
    if not lines:
        middle = min(int(0.460 * h), int(top + (low - top) * 0.45))
        return {"name": (top, middle), "address": (middle, low)}
    # the name has one line, or two of three and more; what it leaves is the address
    taken, pad, apart, most = _BLOCKS[min(len(lines), 3)]
    end = lines[taken - 1][1]
    name = max(top, lines[0][0] - 4), min(end + pad, int(most * h))
    if len(lines) == taken:
        return {"name": name, "address": (name[1] + 2, low)}
    begin = lines[taken][0]
    free = (end + begin) // 2 - apart
    last = lines[-1 if taken == 2 else taken][1]
    return {"name": (name[0], min(name[1], free)), "address": (max(top + 1, min(begin - 6, free)), min(low, last + pad))}


def localize(card: np.ndarray) -> list[tuple[str, int, int, int, int, float]]:
    """The six front fields: name, x, y, w, h and confidence, before overlaps are parted."""
    h, w = card.shape[:2]
    start = header_bottom(card)
    left, right = int(0.33 * w), int(0.98 * w)
    y0, y1, sure = number_strip(card)
    boxes = [
        ("photo", int(0.03 * w), int(0.05 * h), int(0.31 * w), int(0.67 * h), 0.98),
        ("national_id", left, y0, right, y1, sure),
        ("date_of_birth", int(0.03 * w), int(0.68 * h), int(0.35 * w), int(0.85 * h), 0.95),
        ("serial_number", int(0.03 * w), int(0.85 * h), int(0.35 * w), int(0.98 * h), 0.95),
    ]
    for field, (y0, y1) in text_blocks(card, start).items():
        y0 = max(start, min(h - 1, y0))
        boxes.append((field, left, y0, max(left + 10, right), max(y0 + 10, min(h, y1)), 0.95))
    return [(f, x0, y0, max(1, x1 - x0), max(1, y1 - y0), c) for f, x0, y0, x1, y1, c in boxes]


def drawn_card(width: int = 856, height: int = 540, seed: int = 42) -> np.ndarray:
    """A card for tests: green header, portrait, lines of print, digits."""
    rng = np.random.default_rng(seed)
    card = np.full((height, width, 3), 225, np.uint8)
    box = lambda y0, y1, x0, x1, c: card.__setitem__((slice(int(y0 * height), int(y1 * height)), slice(int(x0 * width), int(x1 * width))), c)
    box(0.03, 0.16, 0.40, 0.97, (60, 140, 90))
    box(0.18, 0.23, 0.50, 0.95, (20, 20, 20))
    card[int(0.06 * height) : int(0.66 * height), int(0.04 * width) : int(0.30 * width)] = rng.integers(0, 255, (int(0.66 * height) - int(0.06 * height), int(0.30 * width) - int(0.04 * width), 3))
    for k, y in enumerate((0.31, 0.39, 0.50, 0.58)):
        box(y, y + 0.04, 0.45 + 0.05 * (k % 2), 0.95, (15, 15, 15))
    for k in range(14):
        box(0.77, 0.83, 0.40 + 0.04 * k, 0.42 + 0.04 * k, (10, 10, 10))
    return card
