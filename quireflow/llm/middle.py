"""Fill-in-middle transformation of texts, by rotating blocks of bytes in place, and its inverse.

A text is cut into prefix, middle and suffix at line ends that a hash of its key chooses. Sentinels are inserted in a
bytearray, and the segments change places by rotations of three reversals each. The inverse finds the sentinels, rotates
back and deletes them, which gives the text byte for byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quireflow.llm.common import in_arrow, text_blocks

PREFIX, SUFFIX, MIDDLE = SENTINELS = (b"<P>", b"<S>", b"<M>")
_SWAP = 1 << 16


def reverse(data: bytearray, start: int, end: int) -> None:
    """Reverses data[start:end] in place, a block from each end at a time."""
    while end - start > 1:
        size = min(_SWAP, (end - start) // 2)
        head = data[start:start + size]
        data[start:start + size] = data[end - size:end][::-1]
        data[end - size:end] = head[::-1]
        start, end = start + size, end - size


def rotate(data: bytearray, start: int, between: int, end: int) -> None:
    """Lets data[start:between] and data[between:end] change places."""
    reverse(data, start, between)
    reverse(data, between, end)
    reverse(data, start, end)


def line_ends(text: bytes) -> np.ndarray:
    """Where each line ends, its line feed included; the last line may have none."""
    ends = np.flatnonzero(np.frombuffer(text, np.uint8) == 10) + 1
    return np.append(ends, len(text)) if text and not text.endswith(b"\n") else ends


def characters(text: bytes | bytearray | memoryview) -> int:
    """Code points of UTF-8 bytes: all bytes but those that go on a character."""
    return int(np.count_nonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80))


def arrange(text: bytes, low: int, high: int, form: str) -> bytearray:
    """The text with sentinels, cut at the byte places low and high, in the order of `form`: psm, or spm."""
    data = bytearray(text)
    data[high:high] = SUFFIX
    data[low:low] = MIDDLE
    data[0:0] = PREFIX
    suffix = high + len(PREFIX) + len(MIDDLE)
    rotate(data, low + len(PREFIX) if form == "psm" else 0, suffix, len(data))
    return data


def rebuild(output: bytes, form: str) -> bytearray:
    """The text that arrange() was given."""
    data = bytearray(output)
    if form == "plain":
        return data
    if form == "psm":
        rotate(data, data.find(SUFFIX), data.find(MIDDLE), len(data))
    else:
        rotate(data, 0, data.find(PREFIX), len(data))
    # each stands once, in this order; the last is deleted first
    for at, sign in [(data.find(sign), sign) for sign in (SUFFIX, MIDDLE, PREFIX)]:
        del data[at:at + len(sign)]
    return data


def fill_in_middle(rows: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 7, rate: int = 100, suffix_first: int = 50) -> DataFrame:
    """key, n, form, prefix_chars, middle_chars, output: one row for each row given.

    n is the number of lines. Of 100 texts about `rate` are transformed, and of 100 of those about `suffix_first` to the
    order suffix, prefix, middle (spm), the others to prefix, suffix, middle (psm); which, and where they are cut, follows
    from the SHA-256 of `seed`:`key` alone. A text that is null, empty or holds a sentinel stays as it is (plain, a null
    as an empty text, the numbers of characters null). A row without a key is hashed as if it were the empty string.
    Repeated rows give repeated results, no row gives none. Other columns are ignored.
    """
    def work(batches: Iterator[dict]) -> Iterator[dict]:
        for batch, texts in text_blocks(batches, "text"):
            out = {"n": [], "form": [], "prefix_chars": [], "middle_chars": [], "output": []}
            for name, raw in zip(batch["name"].to_pylist(), texts, strict=True):
                body = raw or b""
                digest = hashlib.sha256(f"{seed}:{name or ''}".encode()).digest()
                first, second, chance, order = (int.from_bytes(digest[4 * k:4 * k + 4], "big") for k in range(4))
                ends = line_ends(body)
                if not body or any(sign in body for sign in SENTINELS) or chance % 100 >= rate:
                    row = (len(ends), "plain", None, None, body)
                else:
                    form = "spm" if order % 100 < suffix_first else "psm"
                    low, high = (int(ends[k - 1]) if k else 0 for k in sorted((first % (len(ends) + 1), second % (len(ends) + 1))))
                    view = memoryview(body)
                    row = (len(ends), form, characters(view[:low]), characters(view[low:high]), bytes(arrange(body, low, high, form)))
                for column, value in zip(out.values(), row, strict=True):
                    column.append(value)
            yield {"key": batch["key"]} | out

    kind = rows.schema[key].dataType.simpleString()
    chosen = rows.select(F.col(key).alias("key"), F.col(key).cast("string").alias("name"), F.col(text).cast("binary").alias("text"))
    found = in_arrow(chosen, work, f"key {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output binary")
    return found.withColumn("output", F.col("output").cast("string")).withColumnRenamed("key", key)


def restore(rows: DataFrame, output: str = "output", form: str = "form", out: str = "restored") -> DataFrame:
    """Adds the text that fill_in_middle() turned into `output`; null where output or form is."""
    names = rows.columns

    def work(batches: Iterator[dict]) -> Iterator[dict]:
        for batch, outputs in text_blocks(batches, "__output"):
            forms = batch[form].to_pylist()
            texts = [bytes(rebuild(o or b"", f)) if f is not None and known else None
                     for o, f, known in zip(outputs, forms, batch["__output"].is_valid().to_pylist(), strict=True)]
            yield {name: batch[name] for name in names} | {"__restored": texts}

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    found = in_arrow(rows.withColumn("__output", F.col(output).cast("binary")), work, f"{fields}, `__restored` binary")
    return found.withColumn(out, F.col("__restored").cast("string")).drop("__restored")
