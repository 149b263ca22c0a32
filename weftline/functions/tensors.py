"""What stands before and after a vision model: prompts to ids, pictures to tensors, outputs to boxes and labels.

The models themselves are not part of this library; their outputs are arrays like any others.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Ids of the public word-level vocabulary with lower-cased texts (fixed values): start, end, padding, and length.
START, END, PAD, LENGTH = 49406, 49407, 0, 77
WORD_VOCABULARY = "/opt/tokenizers/word_bpe_49k.json"
#: Channel means and deviations that pictures are normalized by (public constants of the model family).
MEAN, DEVIATION = (0.48145466, 0.4578275, 0.40821073), (0.26862954, 0.26130258, 0.27577711)


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


def prompt_ids(texts: list[str], path: str = WORD_VOCABULARY) -> np.ndarray:
    """Each text as LENGTH ids: start, at most 75 of its tokens, end, padding."""
    out = np.full((len(texts), LENGTH), PAD, np.int64)
    for row, e in zip(out, _tokenizer(path).encode_batch([t or "" for t in texts], add_special_tokens=False), strict=True):
        ids = [START, *e.ids[: LENGTH - 2], END]
        row[: len(ids)] = ids
    return out


def picture_tensor(a: np.ndarray, side: int = 224) -> np.ndarray:
    """A picture as channels x height x width of normalized numbers."""
    from weftline.functions.pixels import resized

    rgb = np.repeat(a[..., None], 3, axis=2) if a.ndim == 2 else a
    x = resized(rgb, side, side) / 255
    return ((x - np.array(MEAN)) / np.array(DEVIATION)).transpose(2, 0, 1).astype(np.float32)


def detections(output: np.ndarray, side: int = 640, least: float = 0.33, most: int = 4) -> list[tuple[float, float, float, float, float, int]]:
    """Rows (left, top, right, bottom, confidence, class) of a detector as shares of the picture, the surest first."""
    rows = [(*np.clip(r[:4] / side, 0, 1).tolist(), float(r[4]), int(r[5])) for r in output if r[4] >= least]
    return sorted(rows, key=lambda r: -r[4])[:most]


def people(found: list[tuple[float, float, float, float, float, int]], person: int = 0, least: float = 0.66, hero_area: float = 0.05) -> dict:
    """Whether people are seen, how many, and whether one is large; absence is less sure than presence."""
    own = [r for r in found if r[5] == person and r[4] >= least]
    area = max(((r[2] - r[0]) * (r[3] - r[1]) for r in own), default=0.0)
    return {"has_human": bool(own), "count": len(own), "hero": area >= hero_area, "confidence": max((r[4] for r in own), default=0.40)}


def label_scores(logits: np.ndarray, features: list[str], values: list[str], thresholds: dict[str, float], weak: float = 0.25) -> dict[str, tuple[str, float, str]]:
    """Per feature its winning value, the value's share among the feature's prompts, and how much it counts."""
    out = {}
    for f in dict.fromkeys(features):
        at = [i for i, x in enumerate(features) if x == f]
        e = np.exp(logits[at] - logits[at].max())
        p = e / e.sum()
        k = int(p.argmax())
        kind = "influential" if p[k] >= thresholds.get(f, 0.5) else "trivial" if p[k] >= weak else "none"
        out[f] = (values[at[k]], float(p[k]), kind)
    return out
