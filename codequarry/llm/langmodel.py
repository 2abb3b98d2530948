"""Interpolated Kneser-Ney character trigrams for seven languages and code, as one dense table."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from codequarry.llm.seed_texts import OTHERS, TEXTS

LANGS = [*TEXTS]
CODE_CLASS = LANGS.index("code")
_LETTERS = "abcdefghijklmnopqrstuvwxyzäöüßéèêàçñáíóúâîôûëïœ" + "абвгдеёжзийклмнопрстуфхцчшщъыьэюя"
(SPACE, DIGIT, STOP, QUOTE, HYPHEN, UNDER, SLASH, BRACKET, OPERATOR, HAN, HIRA, KATA, CJKP, OTHER, INVERTED) = range(
    len(_LETTERS), len(_LETTERS) + 15
)
SIZE = len(_LETTERS) + 15
DISCOUNT = 0.75


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Class of each code point of the first 65,536; beyond, Han or other."""
    lut = np.full(1 << 16, OTHER, dtype=np.uint8)
    for i, ch in enumerate(_LETTERS):
        lut[ord(ch)] = i
        if len(ch.upper()) == 1:
            lut[ord(ch.upper())] = i
    for group, c in (
        (" \t\r\n\u00a0", SPACE), ("0123456789", DIGIT), (".,;:!?…", STOP), ("\"'`’‘“”„«»", QUOTE), ("-–—", HYPHEN), ("_", UNDER), ("/\\", SLASH),
        ("()[]{}", BRACKET), ("=<>+*%&|^~$#@", OPERATOR), ("。、，；：！？（）「」『』・《》", CJKP), ("¿¡", INVERTED),
    ):
        for ch in group:
            lut[ord(ch)] = c
    lut[0x4E00:0xA000] = HAN
    lut[0x3400:0x4DC0] = HAN
    lut[0x3005] = HAN
    lut[0x3041:0x30A0] = HIRA
    lut[0x30A1:0x3100] = KATA
    lut[0x30FB] = CJKP
    return lut


def encode(text: str) -> np.ndarray:
    u = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)
    return np.where(u < 1 << 16, classes()[np.minimum(u, (1 << 16) - 1)], HAN if len(u) == 0 else OTHER).astype(np.int64)


def _model(text: str) -> np.ndarray:
    """log2 P(c | a, b) for all classes, by interpolated Kneser-Ney with one discount."""
    a = encode(" " + " ".join(text.split()) + " ")
    n = SIZE
    tri = np.zeros((n, n, n), dtype=np.float32)
    np.add.at(tri, (a[:-2], a[1:-1], a[2:]), 1)
    kinds = (tri > 0)
    before = kinds.sum(axis=0).astype(np.float32)  # contexts of (b, c)
    total2 = before.sum(axis=1, keepdims=True)
    uni = (before > 0).sum(axis=0).astype(np.float32)
    p1 = (np.maximum(uni - DISCOUNT, 0) + DISCOUNT * (uni > 0).sum() / n) / max(1.0, uni.sum())
    new2 = (before > 0).sum(axis=1, keepdims=True)
    p2 = np.where(total2 > 0, (np.maximum(before - DISCOUNT, 0) + DISCOUNT * new2 * p1) / np.maximum(total2, 1), p1)
    total3 = tri.sum(axis=2, keepdims=True)
    new3 = kinds.sum(axis=2, keepdims=True)
    p3 = np.where(total3 > 0, (np.maximum(tri - DISCOUNT, 0) + DISCOUNT * new3 * p2) / np.maximum(total3, 1), p2)
    return np.log2(p3).astype(np.float16).reshape(-1)


@lru_cache(maxsize=2)
def table(others: bool = False) -> np.ndarray:
    return np.stack([_model(x) for x in (OTHERS if others else TEXTS).values()], axis=1)


def score(texts: list[str], others: bool = False) -> np.ndarray:
    """Mean log2 probability of each text under each model, (texts, LANGS), or under those of other languages."""
    width = len(OTHERS) if others else len(LANGS)
    if not texts:
        return np.zeros((0, width))
    joined = " ".join(texts)
    c = encode(" " + joined + " ")
    idx = (c[:-2] * SIZE + c[1:-1]) * SIZE + c[2:]
    lens = np.array([len(t) for t in texts], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(lens[:-1] + 1)])
    out = np.empty((len(texts), width), dtype=np.float32)
    step = 1 << 18
    cum = np.zeros(width)
    # Sums by text from running totals, in blocks so that memory stays small.
    bounds = np.concatenate([starts, starts + lens])
    at = np.zeros((len(bounds), width))
    order = np.argsort(bounds, kind="stable")
    sorted_bounds = bounds[order]
    done = 0
    for b in range(0, len(idx), step):
        part = table(others)[idx[b : b + step]].astype(np.float64).cumsum(axis=0)
        hi = np.searchsorted(sorted_bounds, b + len(part), side="right")
        pos = sorted_bounds[done:hi] - b
        at[order[done:hi]] = cum + np.where(pos[:, None] > 0, part[np.maximum(pos, 1) - 1], 0)
        done = hi
        cum = cum + part[-1]
    at[order[done:]] = cum
    k = len(texts)
    out[:] = (at[k:] - at[:k]) / np.maximum(lens, 1)[:, None]
    return out
