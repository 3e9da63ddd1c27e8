"""Numpy kernels for single images: uint8 arrays of height x width x channels, channels in BGR order."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from .. import config

#: Channel means and deviations of the usual image-classification training set, in RGB order.
MEAN, DEVIATION = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)


def grey(image: np.ndarray) -> np.ndarray:
    return image.astype(np.float64) @ np.array([0.114, 0.587, 0.299])


def _around(x: np.ndarray, by: int) -> np.ndarray:
    pad = [(by, by), (by, by)] + [(0, 0)] * (x.ndim - 2)
    return np.pad(x, pad, mode="reflect" if min(x.shape[:2]) > by else "edge")


def convolve(x: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    r = kernel.shape[0] // 2
    padded, (h, w) = _around(x.astype(np.float64), r), x.shape[:2]
    return sum(kernel[i, j] * padded[i : i + h, j : j + w] for i in range(kernel.shape[0]) for j in range(kernel.shape[1]))


def blur_metric(image: np.ndarray) -> float:
    """Variance of the four-neighbour Laplacian: low for blurred images."""
    return float(convolve(grey(image), np.array([[0, 1, 0], [1, -4, 1], [0, 1, 0]])).var())


def over_exposed(image: np.ndarray, level: int = 245) -> float:
    return float((image >= level).mean())


def sharpen(image: np.ndarray) -> np.ndarray:
    kernel = -np.ones((3, 3))
    kernel[1, 1] = 9
    return np.clip(np.rint(convolve(image, kernel)), 0, 255).astype(np.uint8)


def bilateral(image: np.ndarray, size: int, colour: float, space: float) -> np.ndarray:
    """Edge-preserving smoothing over a disc of ``size`` pixels across."""
    r, x = size // 2, image.astype(np.float64)
    padded, (h, w) = _around(x, r), image.shape[:2]
    total, weights = np.zeros_like(x), np.zeros((h, w, 1))
    for dy in range(-r, r + 1):
        for dx in range(-r, r + 1):
            if dx * dx + dy * dy <= r * r:
                near = padded[r + dy : r + dy + h, r + dx : r + dx + w]
                away = np.abs(near - x).sum(2, keepdims=True)
                weight = np.exp(-(dx * dx + dy * dy) / (2 * space**2) - away**2 / (2 * colour**2))
                total, weights = total + weight * near, weights + weight
    return np.clip(np.rint(total / weights), 0, 255).astype(np.uint8)


# The primaries of sRGB and the white of daylight (D65), as published.
_XYZ = np.array([[0.4124564, 0.3575761, 0.1804375], [0.2126729, 0.7151522, 0.0721750], [0.0193339, 0.1191920, 0.9503041]])
_WHITE = np.array([0.950456, 1.0, 1.088754])


def lab_of(image: np.ndarray) -> np.ndarray:
    """CIE L*a*b* of a BGR image: L from 0 to 100."""
    c = image[:, :, ::-1] / 255.0
    linear = np.where(c <= 0.04045, c / 12.92, ((c + 0.055) / 1.055) ** 2.4)
    t = linear @ _XYZ.T / _WHITE
    f = np.where(t > (6 / 29) ** 3, np.cbrt(t), t / (3 * (6 / 29) ** 2) + 4 / 29)
    return np.stack([116 * f[..., 1] - 16, 500 * (f[..., 0] - f[..., 1]), 200 * (f[..., 1] - f[..., 2])], 2)


def bgr_of(lab: np.ndarray) -> np.ndarray:
    """The BGR image of CIE L*a*b* values."""
    fy = (lab[..., 0] + 16) / 116
    f = np.stack([fy + lab[..., 1] / 500, fy, fy - lab[..., 2] / 200], 2)
    t = np.where(f > 6 / 29, f**3, 3 * (6 / 29) ** 2 * (f - 4 / 29)) * _WHITE
    linear = np.clip(t @ np.linalg.inv(_XYZ).T, 0, None)
    c = np.where(linear <= 0.0031308, 12.92 * linear, 1.055 * linear ** (1 / 2.4) - 0.055)
    return np.clip(np.rint(c[:, :, ::-1] * 255), 0, 255).astype(np.uint8)


def equalise(image: np.ndarray, clip: float, tiles: int) -> np.ndarray:
    """Contrast-limited adaptive histogram equalisation of the lightness in L*a*b*; a and b stay."""
    lab = lab_of(image)
    v = np.clip(np.rint(lab[..., 0] * 2.55), 0, 255).astype(np.int64)
    h, w = v.shape
    tables = np.empty((tiles, tiles, 256))
    for i in range(tiles):
        for j in range(tiles):
            tile = v[i * h // tiles : max(i * h // tiles + 1, (i + 1) * h // tiles), j * w // tiles : max(j * w // tiles + 1, (j + 1) * w // tiles)]
            count = np.bincount(tile.ravel(), minlength=256).astype(np.float64)
            limit = max(1.0, clip * tile.size / 256)
            over = np.maximum(count - limit, 0).sum()
            tables[i, j] = np.cumsum(np.minimum(count, limit) + over / 256) * 255 / tile.size
    y, x = (np.arange(h) + 0.5) * tiles / h - 0.5, (np.arange(w) + 0.5) * tiles / w - 0.5
    y0, x0 = np.clip(np.floor(y).astype(int), 0, tiles - 1), np.clip(np.floor(x).astype(int), 0, tiles - 1)
    y1, x1 = np.minimum(y0 + 1, tiles - 1), np.minimum(x0 + 1, tiles - 1)
    fy, fx = np.clip(y - y0, 0, 1)[:, None], np.clip(x - x0, 0, 1)[None, :]
    at = lambda a, b: tables[a[:, None], b[None, :], v]
    new = (at(y0, x0) * (1 - fx) + at(y0, x1) * fx) * (1 - fy) + (at(y1, x0) * (1 - fx) + at(y1, x1) * fx) * fy
    lab[..., 0] = np.clip(new, 0, 255) / 2.55
    return bgr_of(lab)


def enhance(image: np.ndarray) -> np.ndarray:
    """Smoothing and contrast by the image's smaller side, then sharpening of those over 150 pixels.

    Fixed values: the sizes that part the tiers, and each tier's filter settings."""
    m = min(image.shape[:2])
    if m < 100:
        out = bilateral(image, 5, 30, 30)
    elif m < 200:
        out = bilateral(equalise(image, 2.5, 6), 7, 50, 50)
    else:
        out = bilateral(equalise(image, 3.0, 8), 9, 75, 75)
    return sharpen(out) if m > 150 else out


def _weights(size: int, new: int, kind: str) -> np.ndarray:
    """Matrix that resamples one side. kind: lanczos (of 4), cubic or area."""
    at = (np.arange(new) + 0.5) * size / new - 0.5
    if kind == "area":
        low, high = np.arange(new) * size / new, (np.arange(new) + 1) * size / new
        cells = np.arange(size)
        out = np.clip(np.minimum(high[:, None], cells + 1) - np.maximum(low[:, None], cells), 0, None)
        return out / out.sum(1, keepdims=True)
    reach = 4 if kind == "lanczos" else 2
    out = np.zeros((new, size))
    for k in range(-reach + 1, reach + 1):
        cell = np.floor(at).astype(int) + k
        d = at - cell
        if kind == "lanczos":
            value = np.sinc(d) * np.sinc(d / reach) * (np.abs(d) < reach)
        else:
            a, d = -0.75, np.abs(d)
            value = np.where(d <= 1, (a + 2) * d**3 - (a + 3) * d**2 + 1, np.where(d < 2, a * d**3 - 5 * a * d**2 + 8 * a * d - 4 * a, 0))
        np.add.at(out, (np.arange(new), np.clip(cell, 0, size - 1)), value)
    return out / out.sum(1, keepdims=True)


def resize(image: np.ndarray, width: int, height: int, kind: str = "lanczos") -> np.ndarray:
    rows, cols = _weights(image.shape[0], height, kind), _weights(image.shape[1], width, kind)
    return np.clip(np.rint(np.einsum("yi,ijc,xj->yxc", rows, image.astype(np.float64), cols, optimize=True)), 0, 255).astype(np.uint8)


def letterbox(image: np.ndarray, target: int, colour: int = 128) -> np.ndarray:
    h, w = image.shape[:2]
    scale = target / max(h, w)
    new_w, new_h = int(w * scale), int(h * scale)
    if not new_w or not new_h:
        raise ValueError("a side of the image would vanish")
    kind = "lanczos" if scale > 1 else "area" if scale < 0.5 else "cubic"
    out = np.full((target, target, image.shape[2]), colour, np.uint8)
    top, left = (target - new_h) // 2, (target - new_w) // 2
    out[top : top + new_h, left : left + new_w] = resize(image, new_w, new_h, kind)
    return out


def _spread(mask: np.ndarray, by: int) -> np.ndarray:
    padded, (h, w) = np.pad(mask, by), mask.shape
    return np.logical_or.reduce([padded[i : i + h, j : j + w] for i in range(2 * by + 1) for j in range(2 * by + 1)])


def components(mask: np.ndarray, diagonal: bool) -> np.ndarray:
    """A number from 1 on for each connected set of the mask, 0 elsewhere. Runs of a row are joined to those of the row
    before, so the work follows the number of runs."""
    h, w = mask.shape
    flat = np.zeros((h, w + 2), np.int8)
    flat[:, 1:-1] = mask
    steps = np.diff(flat, axis=1)
    row, start = np.nonzero(steps == 1)
    end = np.nonzero(steps == -1)[1]
    up = list(range(len(row)))

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    first = np.searchsorted(row, np.arange(h + 1)).tolist()
    starts, ends, more = start.tolist(), end.tolist(), int(diagonal)
    for y in range(1, h):
        i, j = first[y - 1], first[y]
        while i < first[y] and j < first[y + 1]:
            if starts[i] < ends[j] + more and starts[j] < ends[i] + more:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
            if ends[i] < ends[j]:
                i += 1
            else:
                j += 1
    roots = np.array([root(i) for i in range(len(row))], np.int64)
    number = np.unique(roots, return_inverse=True)[1] + 1 if len(roots) else roots
    out = np.zeros((h, w + 1), np.int64)
    np.add.at(out, (row, start), number)
    np.add.at(out, (row, end), -number)
    return np.cumsum(out, axis=1)[:, :w]


def outlined(mask: np.ndarray) -> list[tuple[float, tuple[int, int, int, int]]]:
    """Area inside the outer outline of each connected set, through its pixels' centres, and its bounding box."""
    h, w = mask.shape
    ground = components(np.pad(~mask, 1, constant_values=True), False)
    label = components((ground != ground[0, 0])[1:-1, 1:-1], True)  # holes belong to the set around them
    n = int(label.max(initial=0))
    if not n:
        return []
    cells = np.stack([label[:-1, :-1], label[:-1, 1:], label[1:, :-1], label[1:, 1:]])
    inside = (cells > 0).sum(0)
    area = np.bincount(cells.max(0).ravel(), np.where(inside == 4, 1.0, np.where(inside == 3, 0.5, 0.0)).ravel(), n + 1)
    ys, xs = np.nonzero(label)
    low, high = np.full((2, n + 1), max(h, w)), np.full((2, n + 1), -1)
    for axis, at in enumerate((xs, ys)):
        np.minimum.at(low[axis], label[ys, xs], at)
        np.maximum.at(high[axis], label[ys, xs], at)
    return [(float(area[i]), (int(low[0, i]), int(low[1, i]), int(high[0, i]) + 1, int(high[1, i]) + 1)) for i in range(1, n + 1)]


def largest_foreground(image: np.ndarray, least: float = config.LEAST_FOREGROUND) -> tuple[int, int, int, int] | None:
    """Bounding box (x1, y1, x2, y2) of the set of edges with the largest outline; None if it covers less than ``least``.

    Edges are strong gradients of the smoothed brightness and weak ones that touch them; gaps are closed."""
    x = np.arange(-2, 3)
    bell = np.exp(-(x**2) / (2 * 1.1**2))
    smooth = convolve(grey(image), np.outer(bell, bell) / bell.sum() ** 2)
    sobel = np.array([[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]])
    strength = np.abs(convolve(smooth, sobel)) + np.abs(convolve(smooth, sobel.T))
    weak = components(strength > 50, True)
    touched = np.zeros(int(weak.max(initial=0)) + 1, bool)
    touched[weak[strength > 150]] = True
    touched[0] = False
    found = outlined(~_spread(~_spread(touched[weak], 4), 4))
    if not found:
        return None
    _, best = max(found, key=lambda f: f[0])
    return best if (best[2] - best[0]) * (best[3] - best[1]) / strength.size >= least else None


def query_crop(image: np.ndarray, target: int, ratio: float = config.QUERY_PADDING, least: float = config.LEAST_FOREGROUND) -> np.ndarray:
    """Padded largest foreground, or else the centre square, stretched to target x target."""
    h, w = image.shape[:2]
    if found := largest_foreground(image, least):
        x1, y1, x2, y2 = found
        dx, dy = int((x2 - x1) * ratio), int((y2 - y1) * ratio)
        x1, y1, x2, y2 = max(0, x1 - dx), max(0, y1 - dy), min(w, x2 + dx), min(h, y2 + dy)
    else:
        side = min(h, w)
        x1, y1 = (w - side) // 2, (h - side) // 2
        x2, y2 = x1 + side, y1 + side
    return resize(image[y1:y2, x1:x2], target, target)


def to_model(image: np.ndarray) -> np.ndarray:
    """RGB floats, normalised for each channel."""
    return (image[:, :, ::-1].astype(np.float32) / 255 - np.array(MEAN, np.float32)) / np.array(DEVIATION, np.float32)


def decode_png(content: bytes) -> np.ndarray:
    """BGR pixels of a PNG of 8 bits a channel that is not interlaced. ValueError if it is anything else."""
    if content[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG image")
    at, data, head = 8, b"", None
    try:
        while at < len(content):
            size, kind = struct.unpack_from(">I4s", content, at)
            body = content[at + 8 : at + 8 + size]
            head, data, at = (struct.unpack(">IIBBBBB", body) if kind == b"IHDR" else head), data + (body if kind == b"IDAT" else b""), at + 12 + size
        w, h, depth, colour, _, _, interlaced = head
        channels = {0: 1, 2: 3, 4: 2, 6: 4}[colour]
        raw = np.frombuffer(zlib.decompress(data), np.uint8).reshape(h, 1 + w * channels)
    except (struct.error, zlib.error, KeyError, TypeError, ValueError) as e:
        raise ValueError(f"broken or unusual PNG: {e}") from e
    if depth != 8 or interlaced:
        raise ValueError("only 8 bits a channel, not interlaced")
    out = np.zeros((h + 1, w + 1, channels), np.int64)  # a row and a column of zeros before the image
    for y in range(h):
        line, above, now, mode = raw[y, 1:].reshape(w, channels).astype(np.int64), out[y], out[y + 1], raw[y, 0]
        if mode == 0:
            now[1:] = line
        elif mode == 1:
            now[1:] = np.cumsum(line, axis=0) & 255
        elif mode == 2:
            now[1:] = (line + above[1:]) & 255
        else:
            for x in range(1, w + 1):
                left, up, corner = now[x - 1], above[x], above[x - 1]
                if mode == 3:
                    near = (left + up) // 2
                else:
                    p = left + up - corner
                    a, b, c = abs(p - left), abs(p - up), abs(p - corner)
                    near = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
                now[x] = (line[x - 1] + near) & 255
    image = out[1:, 1:].astype(np.uint8)
    return np.repeat(image[:, :, :1], 3, axis=2) if channels < 3 else image[:, :, 2::-1]
