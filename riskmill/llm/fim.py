"""Fill-in-middle transformation: whole texts cut at code points, rearranged as UTF-8 bytes, and rebuilt.

Texts stay the byte buffers in which they arrive. For a slice of rows, one pass over the bytes makes a sparse exception
index: for each multibyte character its place in code points and the excess bytes up to and with it. A code point cut
becomes a byte cut by one sorted search: the cut plus the excess of the exceptions before it. Between exceptions (in an
ASCII text: everywhere) that is plain arithmetic, and nothing is decoded. The same index turns byte cuts back.

A text is left plain if it is empty, holds one of the three marks, or is chosen to stay plain. Otherwise prefix, middle and
suffix are put in the order of the form, each behind its mark:

    psm   <P>prefix<S>suffix<M>middle
    spm   <S>suffix<P>prefix<M>middle

A rearranged text holds each mark once, since its source holds none and a mark can't arise across a border: every mark
begins with the only < and ends with the only > of itself. ``restored`` therefore finds the parts by their marks alone.

Draws come from the SHA-256 of a salt and the decimal identifier, so they are the same under any partitioning.

Defined cases: a null text is empty, and an empty text is plain; a null identifier is drawn for as an empty one; rows that
repeat an identifier are cut by the same draws, each by its own length; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The marks of the three parts.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
FORMS = ("plain", "psm", "spm")


@dataclass(frozen=True)
class Fim:
    """Shares in percent: texts left plain whatever they hold, and suffix-first texts among the others."""

    plain: int = 10
    suffix_first: int = 20
    salt: str = "1:"
    slice_bytes: int = 8 << 20


class Exceptions:
    """The sparse exception index of texts that lie one after another in a byte array.

    ``data`` are UTF-8 bytes, ``begin`` and ``end`` the bounds of each text. Per multibyte character it holds the byte
    where it starts (``at``) and the excess (bytes beyond the first) of all multibyte characters up to it (``excess``,
    with a zero in front). Code point places follow from both.
    """

    def __init__(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray):
        self.begin, self.end = begin, end
        self.at = np.flatnonzero(data >= 0xC0)
        lead = data[self.at]
        self.excess = np.zeros(len(self.at) + 1, np.int64)
        np.cumsum(1 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0), out=self.excess[1:])
        # Place of each exception, in code points from the start of the data.
        self.point = self.at - self.excess[:-1]
        self.before = self.excess[np.searchsorted(self.at, begin)]
        self.length = end - begin - (self.excess[np.searchsorted(self.at, end)] - self.before)

    def byte(self, cut: np.ndarray) -> np.ndarray:
        """Bytes from each text's start to its code point ``cut`` (0 to its length)."""
        point = self.begin - self.before + cut
        # Texts without bytes between two cuts share the places; exceptions strictly before the cut count.
        return cut + self.excess[np.searchsorted(self.point, point)] - self.before

    def code_point(self, byte: np.ndarray) -> np.ndarray:
        """The reverse: code points of each text before the byte where a character starts."""
        return byte - (self.excess[np.searchsorted(self.at, self.begin + byte)] - self.before)


def draws(doc_id: Column, salt: str) -> list[Column]:
    """Four unsigned 32-bit draws of an identifier, as long."""
    digest = F.sha2(F.concat(F.lit(salt), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of the batches with at most ``most`` bytes in their ``text`` column (or one longer text).

    With each its bytes and the bounds of its texts; nothing is copied or decoded.
    """
    for batch in batches:
        column = batch.column(text)
        wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
        kind = np.int64 if wide else np.int32
        _, places, content = column.buffers()
        bounds = np.frombuffer(places, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
        data = np.frombuffer(content, np.uint8) if content is not None else np.empty(0, np.uint8)
        first = 0
        while first < len(column):
            last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + most, "right")) - 1)
            part = bounds[first : last + 1]
            yield batch.slice(first, last - first), data[part[0] : part[-1]], part - part[0]
            first = last


def transform(docs: DataFrame, how: Fim = Fim(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every row; ``output`` is the rearranged text."""
    h1, h2, h3, h4 = draws(F.col("doc_id"), how.salt)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).select(
        "doc_id", "text", h1.alias("h1"), h2.alias("h2"),
        F.when(h3 % 100 >= 100 - how.plain, 0).when(h4 % 100 < how.suffix_first, 2).otherwise(1).alias("wanted"),
    )
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch, data, bounds in slices(batches, "text", how.slice_bytes):
            index = Exceptions(data, bounds[:-1], bounds[1:])
            n = index.length
            h1, h2 = (batch.column(c).to_numpy() % (n + 1) for c in ("h1", "h2"))
            one, two = np.minimum(h1, h2), np.maximum(h1, h2)
            cut_one, cut_two = index.byte(one), index.byte(two)
            wanted, body = batch.column("wanted").to_numpy(), data.tobytes()
            form, output = np.zeros(len(n), np.int64), []
            for i, (a, e) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                text = body[a:e]
                if text and wanted[i] and not any(m in text for m in (PREFIX, SUFFIX, MIDDLE)):
                    form[i] = wanted[i]
                    text = arranged(text, int(cut_one[i]), int(cut_two[i]), FORMS[form[i]])
                output.append(text)
            plain = form == 0
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(n), pa.array([FORMS[f] for f in form]),
                    pa.array(one, mask=plain), pa.array(two - one, mask=plain),
                    pa.array(output, pa.binary()).view(pa.string()),
                ],
                names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    return rows.mapInArrow(
        run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string"
    )


def arranged(text: bytes, one: int, two: int, form: str) -> bytes:
    """``text`` cut at two bytes, in the order of ``form``."""
    prefix, middle, suffix = text[:one], text[one:two], text[two:]
    if form == "spm":
        return b"".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))
    return b"".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))


def rebuilt(output: bytes, form: str) -> bytes:
    """The text that ``arranged`` was given, from what it returned."""
    if form == "plain":
        return output
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    at, to = output.index(second), output.index(MIDDLE)
    head, tail, middle = output[len(first) : at], output[at + len(second) : to], output[to + len(MIDDLE) :]
    prefix, suffix = (head, tail) if form == "psm" else (tail, head)
    return prefix + middle + suffix


def restored(transformed: DataFrame) -> DataFrame:
    """``transformed`` (with form and output) and a column ``restored``: the texts it was made from."""
    names = [c for c in transformed.columns if c != "restored"]
    rows = transformed.select(*names)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def run(batches):
        for batch in batches:
            forms = batch.column("form").to_pylist()
            texts = [rebuilt(v.as_buffer().to_pybytes(), f) for v, f in zip(batch.column("output"), forms, strict=True)]
            column = pa.array(texts, pa.binary()).view(pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, column], names=[*names, "restored"])

    return rows.mapInArrow(run, f"{schema}, restored string")


def digests(docs: DataFrame, how: Fim = Fim()) -> DataFrame:
    """Per row what ``transform`` decided, and digests of its output and of the text ``restored`` from it."""
    back = restored(transform(docs, how))
    return back.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2(F.encode("output", "utf-8"), 256).alias("output_sha256"),
        F.sha2(F.encode("restored", "utf-8"), 256).alias("restored_sha256"),
    )
