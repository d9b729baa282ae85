"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, the same on every machine. A letter trigram is bound from its letters:
the product of the first letter's vector turned twice, the second's turned once and the third's as it is. A text is the
bundle, that is the sum, of its trigrams; a language's prototype is the bundle of its training texts; a text gets the
language whose prototype has the largest cosine with it. Bundles add up, so prototypes come from partial sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quireflow.llm.common import in_arrow, text_blocks

DIMENSIONS = 1024
SEED = 20
_DENSE = 32  # a dense product costs about so many times less an entry than adding single rows


@cache
def _is_letter() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


_letters: dict[int, np.ndarray] = {}


def _letter(code: int) -> np.ndarray:
    """Vector of a letter; code 0 stands for anything between words."""
    if code not in _letters:
        if len(_letters) > 1 << 15:  # of all writing systems together; they can be made again at any time
            _letters.clear()
        _letters[code] = np.random.default_rng([SEED, code]).integers(0, 2, DIMENSIONS, np.int8) * 2 - 1
    return _letters[code]


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Position of the text, and key, of each letter trigram of the texts.

    Lower case; what stands between letters counts as one blank, and a blank stands before and after a text.
    """
    lowered = ["\n" + t.lower() + "\n" for t in texts]
    codes = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    doc = np.repeat(np.arange(len(texts)), np.fromiter(map(len, lowered), np.int64, len(texts)))
    codes[~_is_letter()[codes]] = 0
    keep = codes != 0
    keep[1:] |= (codes[:-1] != 0) | (doc[1:] != doc[:-1])
    keep[:1] = True
    codes, doc = codes[keep], doc[keep]
    if len(codes) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    whole = doc[:-2] == doc[2:]
    return doc[:-2][whole], (codes[:-2] << 42 | codes[1:-1] << 21 | codes[2:])[whole]


def _bound(keys: np.ndarray) -> np.ndarray:
    """Vectors of trigrams."""
    parts = [keys >> 42, keys >> 21 & 0x1FFFFF, keys & 0x1FFFFF]
    out = np.ones((len(keys), DIMENSIONS), np.int8)
    for turns, codes in zip((2, 1, 0), parts, strict=True):
        known, at = np.unique(codes, return_inverse=True)
        out *= np.stack([np.roll(_letter(int(c)), turns) for c in known])[at]
    return out


def bundles(row: np.ndarray, keys: np.ndarray, rows: int) -> np.ndarray:
    """Sum of the trigram vectors of each row."""
    out = np.zeros((rows, DIMENSIONS), np.float32)
    if not len(keys):
        return out
    known, at = np.unique(keys, return_inverse=True)
    pairs, times = np.unique(at * rows + row, return_counts=True)  # by trigram, then by row
    gram, row = pairs // rows, pairs % rows
    for start in range(0, len(known), 2048):
        a, b = np.searchsorted(gram, [start, start + 2048])
        vectors = _bound(known[start:start + 2048]).astype(np.float32)
        used, at = np.unique(row[a:b], return_inverse=True)
        if len(used) * len(vectors) <= _DENSE * (b - a):
            counts = np.zeros((len(used), len(vectors)), np.float32)
            counts[at, gram[a:b] - start] = times[a:b]
            out[used] += counts @ vectors
        else:
            for c in range(a, b, 4096):
                d = min(c + 4096, b)
                order = np.argsort(row[c:d], kind="stable") + c
                heads = np.flatnonzero(np.diff(row[order], prepend=-1))
                out[row[order][heads]] += np.add.reduceat(vectors[gram[order] - start] * times[order, None], heads)
    return out


def fit_prototypes(rows: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, np.ndarray]:
    """Prototype of each language of `rows`; null languages and texts are left out.

    One pass over the texts; each task gives one partial sum a language, and those meet in an aggregation. What comes to
    the driver is languages x DIMENSIONS numbers, however many rows there are.
    """
    def work(batches: Iterator[dict]) -> Iterator[dict]:
        names: dict[str, int] = {}
        sums: list[np.ndarray] = []
        for batch, texts in text_blocks(batches, "text", 1 << 18):
            own = np.array([names.setdefault(x, len(names)) for x in batch["lang"].to_pylist()])
            sums += [np.zeros(DIMENSIONS) for _ in range(len(names) - len(sums))]
            doc, keys = trigrams(texts)
            for k, part in zip(used := np.unique(own), bundles(np.searchsorted(used, own[doc]), keys, len(used)), strict=True):
                sums[k] += part
        for name, k in names.items():
            yield {"lang": [name] * DIMENSIONS, "place": np.arange(DIMENSIONS, dtype=np.int32), "total": sums[k]}

    learned = rows.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    parts = in_arrow(learned, work, "lang string, place int, total double")
    out: dict[str, np.ndarray] = {}
    for name, place, total in parts.groupBy("lang", "place").agg(F.sum("total")).toLocalIterator():
        out.setdefault(name, np.zeros(DIMENSIONS))[place] = total
    return {name: v / max(np.linalg.norm(v), 1e-9) for name, v in sorted(out.items())}


def predict(rows: DataFrame, prototypes: dict[str, np.ndarray], keep: dict[str, Column], text: str = "text") -> DataFrame:
    """The columns of `keep`, then lang_pred, score: one row for each row given.

    `keep` names columns to carry along. score is the cosine with the best prototype, 0 where it is negative. A null text, or one without a
    letter, is `und` with score 0, and so is every text when there are no prototypes; ties go to the language first in
    the alphabet. Texts are read whole. Repeated rows give repeated results.
    """
    names = sorted(prototypes)
    model = np.stack([prototypes[n] for n in names]).astype(np.float32) if names else np.zeros((0, DIMENSIONS), np.float32)
    chosen = rows.select(*[column.alias(name) for name, column in keep.items()], F.col(text).alias("__text"))

    def work(batches: Iterator[dict]) -> Iterator[dict]:
        for batch, texts in text_blocks(batches, "__text", 1 << 18):
            doc, keys = trigrams(texts)
            pred, score = np.full(len(texts), "und", object), np.zeros(len(texts))
            if names:
                sums = bundles(doc, keys, len(texts))
                size = np.linalg.norm(sums, axis=1)
                cosines = sums @ model.T / np.maximum(size, 1e-9)[:, None]
                said = np.bincount(doc, minlength=len(texts)) > 0
                best = cosines.argmax(axis=1)
                pred[said] = np.array(names, object)[best[said]]
                score[said] = np.clip(cosines[np.arange(len(texts)), best], 0, 1)[said]
            out = {n: c for n, c in batch.items() if n != "__text"}
            yield out | {"lang_pred": list(pred), "score": score}

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema if f.name != "__text"]
    return in_arrow(chosen, work, ", ".join([*fields, "lang_pred string", "score double"]))
