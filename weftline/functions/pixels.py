"""Picture arithmetic on arrays (height, width, 3 in red, green, blue or height, width), without image libraries.

Models for objects and labels are not part of this library; what they would give is taken as input.
"""

from __future__ import annotations

import numpy as np

FLAT_VARIANCE = 0.012
SCENE_VARIANCE = 0.040


def grey(a: np.ndarray, colour: bool | None = None) -> np.ndarray:
    """Brightness from 0 to 1 by the Rec. 601 weights; a last axis of colours is told by the number of axes."""
    colour = a.ndim == 3 if colour is None else colour
    a = a.astype(np.float64) / 255
    return a @ np.array([0.299, 0.587, 0.114]) if colour else a


def resized(a: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear resize to a given size, the ratio not kept."""
    h, w = a.shape[:2]
    y = np.clip((np.arange(height) + 0.5) * h / height - 0.5, 0, h - 1)
    x = np.clip((np.arange(width) + 0.5) * w / width - 0.5, 0, w - 1)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = (y - y0)[:, None], (x - x0)[None, :]
    if a.ndim == 3:
        fy, fx = fy[..., None], fx[..., None]
    a = a.astype(np.float64)
    top = a[y0][:, x0] * (1 - fx) + a[y0][:, x1] * fx
    return top * (1 - fy) + (a[y1][:, x0] * (1 - fx) + a[y1][:, x1] * fx) * fy


def difference_hash(a: np.ndarray) -> tuple[int, int]:
    """128 bits (high, low) that say where a 17 x 8 picture gets darker to the right; signed 64-bit halves."""
    g = resized(grey(a), 8, 17)
    bits = (g[:, :-1] > g[:, 1:] + 1e-12).ravel()
    halves = [int(sum(1 << i for i, b in enumerate(bits[k : k + 64]) if b)) for k in (64, 0)]
    return tuple(v - (1 << 64) if v >> 63 else v for v in halves)


def corners(a: np.ndarray, share: float = 0.08) -> np.ndarray:
    """Pixels of the four corner blocks."""
    h, w = a.shape[:2]
    k, m = max(1, int(h * share)), max(1, int(w * share))
    return np.concatenate([b.reshape(-1, *a.shape[2:]) for b in (a[:k, :m], a[:k, -m:], a[-k:, :m], a[-k:, -m:])])


def background(a: np.ndarray) -> dict:
    """Mean and summed variance of the corners, the kind of background, and the share of nearly white border."""
    c = corners(a).astype(np.float64) / 255
    mean, variance = c.mean(axis=0), float((c**2).mean(axis=0).sum() - (c.mean(axis=0) ** 2).sum())
    kind = "SOLIDCOLOR" if variance < FLAT_VARIANCE else "REALLIFE" if variance > SCENE_VARIANCE else "UNKNOWN"
    return {"mean": mean, "variance": max(0.0, variance), "kind": kind, "near_white": float((grey(corners(a), a.ndim == 3) > 0.94).mean())}


def subject_box(a: np.ndarray, away: float = 0.15) -> tuple[int, int, int, int]:
    """Left, top, width and height of the pixels that differ from the border's mean; the whole if none do."""
    x = a.astype(np.float64) / 255
    x = x[..., None] if x.ndim == 2 else x
    h, w = x.shape[:2]
    k, m = max(1, int(h * 0.05)), max(1, int(w * 0.05))
    border = np.concatenate([b.reshape(-1, x.shape[2]) for b in (x[:k], x[-k:], x[:, :m], x[:, -m:])]).mean(axis=0)
    far = np.sqrt(((x - border) ** 2).sum(axis=2)) >= away
    if not far.any():
        return 0, 0, w, h
    ys, xs = np.flatnonzero(far.any(axis=1)), np.flatnonzero(far.any(axis=0))
    return int(xs[0]), int(ys[0]), int(xs[-1] - xs[0] + 1), int(ys[-1] - ys[0] + 1)


def touched_edges(box: tuple[int, int, int, int], height: int, width: int) -> str:
    """The picture's edges that a box touches, of t, b, l, r."""
    x, y, w, h = box
    return "".join(n for n, hit in (("t", y <= 0), ("b", y + h >= height), ("l", x <= 0), ("r", x + w >= width)) if hit)


def edge_density(a: np.ndarray, threshold: float = 0.1) -> float:
    """Share of pixels whose brightness changes sharply."""
    g = grey(a)
    if min(g.shape) < 2:
        return 0.0
    dx, dy = np.diff(g, axis=1)[:-1], np.diff(g, axis=0)[:, :-1]
    return float((np.hypot(dx, dy) > threshold).mean())


def colour_clusters(a: np.ndarray, least: float = 0.01) -> int:
    """Buckets of 8 x 8 x 8 colours that hold at least this share of the pixels."""
    x = (a if a.ndim == 3 else np.repeat(a[..., None], 3, axis=2)) // 32
    code = x[..., 0].astype(int) * 64 + x[..., 1] * 8 + x[..., 2]
    return int((np.bincount(code.ravel(), minlength=512) >= least * code.size).sum())


def illustration(a: np.ndarray) -> bool:
    """Many edges, a white border and few colours."""
    return edge_density(a) >= 0.12 and background(a)["near_white"] >= 0.8 and colour_clusters(a) <= 8


#: Luminance up to which a pixel is black and from which it is white, and the share that is worth a flag (fixed values).
BLACK, WHITE, FLAGGED = 0.02, 0.98, 0.25


def exposure(a: np.ndarray) -> tuple[float, float]:
    """Shares of nearly black and nearly white pixels."""
    g = grey(a)
    return float((g <= BLACK).mean()), float((g >= WHITE).mean())


def centred_square(a: np.ndarray) -> np.ndarray:
    """The largest square around the middle."""
    h, w = a.shape[:2]
    n = min(h, w)
    y, x = (h - n) // 2, (w - n) // 2
    return a[y : y + n, x : x + n]


def stretched(a: np.ndarray, top: int, bottom: int, left: int, right: int) -> np.ndarray:
    """A picture widened at its sides: mirrored up to a quarter, mirrored with the edge up to 1.42, else white."""
    h, w = a.shape[:2]
    ratio = max((h + top + bottom) / h, (w + left + right) / w)
    pad = [(top, bottom), (left, right)] + [(0, 0)] * (a.ndim - 2)
    if ratio <= 1.25 and max(top, bottom) < h and max(left, right) < w:
        return np.pad(a, pad, mode="reflect")
    if ratio <= 1.42:
        return np.pad(a, pad, mode="symmetric")
    return np.pad(a, pad, constant_values=255)


def centred_on_canvas(a: np.ndarray, margin: float = 0.042) -> np.ndarray:
    """The subject in the middle of a square canvas with a margin, the background widened."""
    x, y, w, h = subject_box(a)
    crop = a[y : y + h, x : x + w]
    side = int(np.floor(max(w, h) * (1 + 2 * margin)))
    side = max(max(w, h), side - side % 2 - 2)
    top, left = (side - h) // 2, (side - w) // 2
    return stretched(crop, top, side - h - top, left, side - w - left)


def detail_crop(a: np.ndarray, edges: str) -> np.ndarray:
    """A square that keeps the sides the subject touches: from those sides, or from the middle."""
    h, w = a.shape[:2]
    n = min(h, w)
    y = 0 if "t" in edges and "b" not in edges else h - n if "b" in edges and "t" not in edges else (h - n) // 2
    x = 0 if "l" in edges and "r" not in edges else w - n if "r" in edges and "l" not in edges else (w - n) // 2
    return a[y : y + n, x : x + n]


def equalized(g: np.ndarray, tiles: int = 8, clip: float = 2.0) -> np.ndarray:
    """Contrast-limited adaptive equalization of a picture of one byte per pixel, tile by tile with blended edges."""
    h, w = g.shape
    tiles = max(1, min(tiles, h, w))
    ys, xs = np.linspace(0, h, tiles + 1).astype(int), np.linspace(0, w, tiles + 1).astype(int)
    maps = np.zeros((tiles, tiles, 256))
    for i in range(tiles):
        for j in range(tiles):
            t = g[ys[i] : ys[i + 1], xs[j] : xs[j + 1]]
            hist = np.bincount(t.ravel(), minlength=256).astype(float)
            limit = max(1.0, clip * t.size / 256)
            over = np.maximum(hist - limit, 0).sum()
            maps[i, j] = np.cumsum(np.minimum(hist, limit) + over / 256) * 255 / t.size
    cy, cx = (ys[:-1] + ys[1:]) / 2, (xs[:-1] + xs[1:]) / 2
    fy, fx = np.clip(np.interp(np.arange(h), cy, np.arange(tiles)), 0, tiles - 1), np.clip(np.interp(np.arange(w), cx, np.arange(tiles)), 0, tiles - 1)
    y0, x0 = np.floor(fy).astype(int), np.floor(fx).astype(int)
    y1, x1 = np.minimum(y0 + 1, tiles - 1), np.minimum(x0 + 1, tiles - 1)
    wy, wx = (fy - y0)[:, None], (fx - x0)[None, :]
    at = lambda i, j: maps[i[:, None], j[None, :], g]
    out = (at(y0, x0) * (1 - wx) + at(y0, x1) * wx) * (1 - wy) + (at(y1, x0) * (1 - wx) + at(y1, x1) * wx) * wy
    return np.clip(np.round(out), 0, 255).astype(np.uint8)


def feathered(a: np.ndarray, b: np.ndarray, width: int) -> np.ndarray:
    """Two pictures side by side whose edges of ``width`` columns run into each other by a raised cosine."""
    if not width:
        return np.concatenate([a, b], axis=1)
    t = 0.5 - 0.5 * np.cos(np.pi * (np.arange(width) + 0.5) / width)
    t = t[None, :, None] if a.ndim == 3 else t[None, :]
    mid = a[:, -width:] * (1 - t) + b[:, :width] * t
    return np.concatenate([a[:, :-width], mid.round().astype(a.dtype), b[:, width:]], axis=1)


def jpeg_header(content: bytes) -> tuple[int, int, int] | None:
    """Width, height and orientation (1 if not given) of a JPEG, from its header alone; None if it is none."""
    if content[:2] != b"\xff\xd8":
        return None
    i, orientation = 2, 1
    while i + 4 <= len(content) and content[i] == 0xFF:
        marker, size = content[i + 1], int.from_bytes(content[i + 2 : i + 4], "big")
        body = content[i + 4 : i + 2 + size]
        if marker == 0xE1 and body[:6] == b"Exif\0\0":
            orientation = _orientation(body[6:]) or 1
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC) and len(body) >= 5:
            return int.from_bytes(body[3:5], "big"), int.from_bytes(body[1:3], "big"), orientation
        i += 2 + size
    return None


def _orientation(tiff: bytes) -> int | None:
    order = {b"II": "little", b"MM": "big"}.get(tiff[:2])
    if not order or len(tiff) < 10:
        return None
    at = int.from_bytes(tiff[4:8], order)
    for k in range(int.from_bytes(tiff[at : at + 2], order)):
        e = tiff[at + 2 + 12 * k : at + 14 + 12 * k]
        if len(e) == 12 and int.from_bytes(e[:2], order) == 0x0112:
            v = int.from_bytes(e[8:10], order)
            return v if 1 <= v <= 8 else None
    return None


def png_size(content: bytes) -> tuple[int, int] | None:
    """Width and height of a PNG, from its header alone."""
    if content[:8] != b"\x89PNG\r\n\x1a\n" or len(content) < 24:
        return None
    return int.from_bytes(content[16:20], "big"), int.from_bytes(content[20:24], "big")


def oriented(a: np.ndarray, orientation: int) -> np.ndarray:
    """A picture as it is meant to be seen, by its orientation mark (1 to 8)."""
    if orientation in (2, 4, 5, 7):
        a = a[:, ::-1]
    turns = {3: 2, 4: 2, 5: 1, 6: 3, 7: 3, 8: 1}.get(orientation, 0)
    return np.ascontiguousarray(np.rot90(a, turns))


def face_cut(a: np.ndarray, faces: list[tuple[int, int, int, int]]) -> np.ndarray:
    """A picture from three quarters down its lowest face on; as it is without faces."""
    if not faces:
        return a
    x, y, w, h = max(faces, key=lambda f: f[1] + f[3] / 2)
    cut = int(y + 0.75 * h)
    return a[cut:] if 0 < cut < a.shape[0] else a
