"""Image variants of a crop for recognition, by preprocessor, in numpy."""

from __future__ import annotations

import numpy as np

from docspark import dims
from docspark.vision import image as im

# Least heights, paper sizes, clip limits and strengths of the filters.
LEAST = {"digits": 60, "text": 60, "gender": 40, "serial": 40}
PAPER = {"digits": 15, "text": 19}
CLIP = {"digits": 2.5, "text": 2.0, "gender": 1.5, "serial": 2.0}
TILES, DENOISE = 8, 6.0


def enlarged(crop: np.ndarray, least: int) -> np.ndarray:
    """To a height of ``least``, if it is lower."""
    h, w = crop.shape[:2]
    return crop if h >= least or not h else im.resize(crop, max(1, int(w * least / h)), least)


def evened(g: np.ndarray, size: int = 15) -> np.ndarray:
    """Brightness against the paper around it."""
    paper = np.maximum(im._most_around(g, size).astype(np.float64), 1)
    return np.clip(np.rint(g * 255.0 / paper), 0, 255).astype(np.uint8)


def blurred(g: np.ndarray, sigma: float) -> np.ndarray:
    """By a Gaussian kernel of three deviations either way."""
    reach = int(np.ceil(3 * sigma))
    kernel = np.exp(-(np.arange(-reach, reach + 1) ** 2) / (2 * sigma**2))
    out = g.astype(np.float64)
    for axis in (0, 1):
        p = np.pad(out, [(reach, reach) if a == axis else (0, 0) for a in (0, 1)], mode="reflect" if min(g.shape) > reach else "edge")
        out = sum(k * p.take(np.arange(i, i + g.shape[axis]), axis) for i, k in enumerate(kernel / kernel.sum()))
    return out


def unblurred(g: np.ndarray) -> np.ndarray:
    """Sharper by what a blur takes away."""
    return np.clip(np.rint(1.8 * g - 0.8 * np.rint(blurred(g, 2.0))), 0, 255).astype(np.uint8)


def crisp(g: np.ndarray) -> np.ndarray:
    """Each pixel against its four neighbours."""
    p = np.pad(g.astype(np.int64), 1, mode="reflect" if min(g.shape) > 1 else "edge")
    return np.clip(5 * p[1:-1, 1:-1] - p[:-2, 1:-1] - p[2:, 1:-1] - p[1:-1, :-2] - p[1:-1, 2:], 0, 255).astype(np.uint8)


def stretched(g: np.ndarray) -> np.ndarray:
    """From the darkest to the brightest value over the whole range."""
    low, high = int(g.min()), int(g.max())
    return g if high == low else np.rint((g.astype(np.float64) - low) * 255 / (high - low)).astype(np.uint8)


def locally_equalized(g: np.ndarray, clip: float) -> np.ndarray:
    """Histogram equalization by tiles, no bin above ``clip`` times the mean; between the middles of tiles, in proportion.

    What is cut off goes evenly to all bins. The picture is mirrored up to whole tiles.
    """
    h, w = g.shape
    th, tw = -(-h // TILES), -(-w // TILES)
    rows, columns = th * TILES - h, tw * TILES - w
    p = np.pad(g, ((0, rows), (0, columns)), mode="reflect" if rows < h and columns < w else "edge")
    tiles = p.reshape(TILES, th, TILES, tw).swapaxes(1, 2).reshape(TILES * TILES, -1).astype(np.int64)
    counts = np.bincount((tiles + 256 * np.arange(TILES * TILES)[:, None]).ravel(), minlength=256 * TILES * TILES).reshape(-1, 256)
    most = max(1, int(clip * th * tw / 256))
    over = np.maximum(counts - most, 0).sum(axis=1, keepdims=True)
    # the rest that 256 does not divide goes to the first bins
    counts = np.minimum(counts, most) + over // 256 + (np.arange(256) < over % 256)
    maps = np.clip(np.rint(counts.cumsum(axis=1) * 255.0 / (th * tw)), 0, 255).reshape(TILES, TILES, 256)

    def between(n: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = (np.arange(n) + 0.5) / size - 0.5
        low = np.floor(at).astype(int)
        return np.clip(low, 0, TILES - 1), np.clip(low + 1, 0, TILES - 1), at - low

    (y0, y1, fy), (x0, x1, fx) = between(h, th), between(w, tw)
    y0, y1, fy = y0[:, None], y1[:, None], fy[:, None]
    top = maps[y0, x0, g] * (1 - fx) + maps[y0, x1, g] * fx
    return np.rint(top * (1 - fy) + (maps[y1, x0, g] * (1 - fx) + maps[y1, x1, g] * fx) * fy).astype(np.uint8)


def denoised(g: np.ndarray, strength: float = DENOISE, patch: int = 7, window: int = 21) -> np.ndarray:
    """The mean of the pixels in a window, those with patches like this one's counting most (non-local means)."""
    reach, half = window // 2, patch // 2
    pad = reach + half
    p = np.pad(g.astype(np.int32), pad, mode="reflect" if min(g.shape) > pad else "edge")
    h, w = g.shape
    # sums of all squares may run over 32 bits, differences of them, a patch each, cannot
    here = p[reach : reach + h + 2 * half, reach : reach + w + 2 * half]
    total, weights = np.zeros((h, w), np.float32), np.zeros((h, w), np.float32)
    part = np.float32(-1 / (patch**2 * strength**2))
    sums = np.zeros((h + 2 * half + 1, w + 2 * half + 1), np.uint32)
    for dy in range(window):
        for dx in range(window):
            there = p[dy : dy + h + 2 * half, dx : dx + w + 2 * half]
            off = here - there
            np.cumsum(np.cumsum((off * off).view(np.uint32), axis=0, dtype=np.uint32), axis=1, dtype=np.uint32, out=sums[1:, 1:])
            apart = sums[patch:, patch:] - sums[:-patch, patch:] - sums[patch:, :-patch] + sums[:-patch, :-patch]
            weight = np.exp(apart.astype(np.float32) * part)
            total += weight * there[half : half + h, half : half + w]
            weights += weight
    return np.rint(total / weights).astype(np.uint8)


def parted(g: np.ndarray) -> np.ndarray:
    return np.where(g > im.otsu(g), 255, 0).astype(np.uint8)


def preprocessor(field: str, field_type: str) -> str:
    return dims.FIELD_PREPROCESSOR.get(field) or dims.TYPE_PREPROCESSOR.get(field_type) or "text"


def of(crop: np.ndarray, kind: str) -> dict[str, np.ndarray]:
    """The variants of a preprocessor, in the order of the catalog; barcodes keep their size."""
    img = enlarged(crop, LEAST.get(kind, 0))
    g = im.gray(img)
    even = evened(g, PAPER[kind]) if kind in PAPER else g
    made = {
        "illum_sharpened": lambda: stretched(unblurred(even)),
        "clahe_norm": lambda: locally_equalized(even, CLIP[kind]),
        "otsu_thresh": lambda: parted(locally_equalized(even, CLIP[kind])),
        "rgb_original": lambda: img[:, :, ::-1],
        "illum_norm": lambda: even,
        "ink_isolated": lambda: evened(img.min(axis=2), PAPER[kind]),
        "denoised_norm": lambda: denoised(even),
        "rgb_minimal": lambda: img[:, :, ::-1],
        "contrast_norm": lambda: stretched(g),
        "clahe_only": lambda: locally_equalized(g, CLIP[kind]),
        "sharpened": lambda: crisp(stretched(g)),
    }
    return {name: made[name]() for name in dims.VARIANTS[kind]}
