"""Fill-in-the-middle: documents cut at two unit boundaries and put in prefix-suffix-middle or suffix-prefix-middle order.

Whether a unit ends between two characters is a predicate of the two. A text is cut into chunks that overlap by
one character, so every pair of neighbours lies in one chunk; chunks count their boundaries by themselves, running
sums of the counts say which chunk owns the boundary of a rank, and only the owners of the two cuts are read again
for the exact place. Texts of up to ``long`` bytes do that inside one task; the chunks of longer ones are rows that Spark
deals out, counts and running sums included, and only the text's two places come back to it.

Null and empty texts have no unit and stay plain, as texts do that hold a sentinel. Repeated rows and ids
each give their row; an id's draw depends on seed and id only (a null id draws as the empty text); other columns are
ignored whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ionweave.llm.common import slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
CHUNK, LONG = 1 << 15, 100_000  # characters of a chunk; bytes of a text whose chunks are dealt out

#: Of code points, whether a unit ends after each but the last.
Boundary = Callable[[np.ndarray], np.ndarray]


def lines(codes: np.ndarray) -> np.ndarray:
    """Units are lines with their newline."""
    return codes[:-1] == 10


def words(codes: np.ndarray) -> np.ndarray:
    """Units are words with the white space after them."""
    white = (codes == 32) | ((codes >= 9) & (codes <= 13))
    return white[:-1] & ~white[1:]


def codes_of(piece: str) -> np.ndarray:
    return np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32)


def chunk_count(n_chars: int, size: int) -> int:
    return max(1, -(-(n_chars - 1) // size))


def chunk_at(text: str, k: int, size: int) -> str:
    """Chunk ``k``: its pairs start at ``k * size``; the last character is the next chunk's first."""
    return text[k * size : (k + 1) * size + 1]


def draw(doc_id: int | None, seed: int) -> list[int]:
    """Four unsigned 32-bit numbers of an id."""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(h[k : k + 8], 16) for k in range(0, 32, 8)]


def ranks(h: list[int], n: int) -> tuple[int, int]:
    """Units before the first and before the second cut."""
    a, b = h[0] % (n + 1), h[1] % (n + 1)
    return min(a, b), max(a, b)


def cut_places(text: str, h: list[int], boundary: Boundary, size: int) -> tuple[int, int, int]:
    """(units, place of the first cut, of the second)."""
    m = chunk_count(len(text), size)
    sums = np.cumsum([np.count_nonzero(boundary(codes_of(chunk_at(text, k, size)))) for k in range(m)]) if len(text) > 1 else np.zeros(1, np.int64)
    n = int(sums[-1]) + bool(text)

    def place(rank: int) -> int:
        if rank in (0, n):
            return len(text) if rank else 0
        k = int(np.searchsorted(sums, rank))  # the first chunk whose sum reaches the rank
        return k * size + place_in(chunk_at(text, k, size), rank - (int(sums[k - 1]) if k else 0), boundary)

    first, second = ranks(h, n)
    return n, place(first), place(second)


def place_in(piece: str, rank: int, boundary: Boundary) -> int:
    """Where the boundary of a rank (from 1) in a chunk lies."""
    return int(np.flatnonzero(boundary(codes_of(piece)))[rank - 1]) + 1


def arrange(text: str, h: list[int], first: int, second: int, rate: int, spm: int) -> tuple[str, str, int | None, int | None]:
    """(form, output, characters of the prefix, of the middle)."""
    if not text or h[2] % 100 >= rate or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)):
        return "plain", text, None, None
    prefix, middle, suffix = text[:first], text[first:second], text[second:]
    if h[3] % 100 < spm:
        return "spm", f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}", first, second - first
    return "psm", f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}", first, second - first


SHAPE = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def fill_in_middle(docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50, boundary: Boundary = lines, size: int = CHUNK, long: int = LONG) -> DataFrame:
    """``(doc_id, n, form, prefix_chars, middle_chars, output)`` of every row; ``n`` is the number of units.

    ``rate`` per cent of documents are transformed, ``spm`` per cent of them with the suffix first.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def batch(ids, rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows)) if rows else [()] * 5
        kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
        n, form, output, prefix, middle = (pa.array(c, k) for c, k in zip(cols, kinds))
        return pa.RecordBatch.from_arrays([ids, n, form, prefix, middle, output], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1, 4000, 16_000_000):
            rows = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                h, text = draw(i, seed), t or ""
                n, first, second = cut_places(text, h, boundary, size)
                rows.append((n, *arrange(text, h, first, second, rate, spm)))
            yield batch(b.column(0), rows)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2, 100, 16_000_000):
            for i, digest, text in zip(*(b.column(k).to_pylist() for k in range(3))):
                m = chunk_count(len(text), size)
                for lo in range(0, m, 64):
                    part = [chunk_at(text, k, size) for k in range(lo, min(m, lo + 64))]
                    yield pa.RecordBatch.from_arrays([pa.array([i] * len(part), pa.int64()), pa.array([digest] * len(part)), pa.array(range(lo, lo + len(part)), pa.int64()), pa.array(part)], ["doc_id", "digest", "k", "piece"])

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [int(np.count_nonzero(boundary(codes_of(p)))) for p in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(n, pa.int64())], ["doc_id", "digest", "k", "inner"])

    def owners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each chunk, the ranks that it owns."""
        for b in batches:
            out = []
            for i, digest, k, inner, before, total in zip(*(b.column(c).to_pylist() for c in range(6))):
                for which, rank in enumerate(ranks(draw(i, seed), total + 1)):
                    if before < rank <= before + inner:
                        out.append((i, digest, k, which, rank - before))
            cols = list(zip(*out)) if out else [()] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["doc_id", "digest", "k", "which", "rank"])

    def rescan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = [k * size + place_in(p, r, boundary) for k, r, p in zip(*(b.column(c).to_pylist() for c in (2, 4, 5)))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), pa.array(at, pa.int64())], ["doc_id", "digest", "which", "at"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1, 4000, 16_000_000):
            rows = []
            for i, text, total, *at in zip(*(b.column(c).to_pylist() for c in range(5))):
                h, n = draw(i, seed), total + 1
                first, second = (len(text) if r == n else 0 if a is None else a for r, a in zip(ranks(h, n), at))
                rows.append((n, *arrange(text, h, first, second, rate, spm)))
            out = batch(b.column(0), rows)
            yield pa.RecordBatch.from_arrays([*out.columns, b.column(5)], [*out.schema.names, "copies"])

    is_long = F.coalesce(F.octet_length("text"), F.lit(0)) > max(long, 1)
    short = own.where(~is_long).mapInArrow(whole, SHAPE)
    # equal rows are cut once
    large = own.where(is_long).groupBy("doc_id", "text").agg(F.count("*").alias("copies")).withColumn("digest", F.sha2(F.col("text").cast("binary"), 256))
    chunks = large.select("doc_id", "digest", "text").mapInArrow(pieces, "doc_id long, digest string, k long, piece string").repartition("doc_id", "digest", "k")
    counted = chunks.mapInArrow(counts, "doc_id long, digest string, k long, inner long")
    text_rows = Window.partitionBy("doc_id", "digest")  # two numbers a chunk of one text
    sums = counted.withColumns({"before": F.sum("inner").over(text_rows.orderBy("k")) - F.col("inner"), "total": F.sum("inner").over(text_rows)})
    owned = sums.select("doc_id", "digest", "k", "inner", "before", "total").mapInArrow(owners, "doc_id long, digest string, k long, which int, rank long")
    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["digest"] == b["digest"])
    again = owned.join(chunks, same(owned, chunks) & (owned["k"] == chunks["k"])).select(owned["doc_id"], owned["digest"], owned["k"], "which", "rank", "piece")
    places = again.mapInArrow(rescan, "doc_id long, digest string, which int, at long")
    totals = counted.groupBy("doc_id", "digest").agg(F.sum("inner").alias("total"))
    cuts = places.groupBy("doc_id", "digest").agg(F.max(F.when(F.col("which") == 0, F.col("at"))).alias("first"), F.max(F.when(F.col("which") == 1, F.col("at"))).alias("second"))
    rows = large.join(totals, same(large, totals)).select(large["doc_id"], large["digest"], "text", "copies", "total")
    rows = rows.join(cuts, same(rows, cuts), "left").select(rows["doc_id"], "text", "total", "first", "second", "copies")
    done = rows.mapInArrow(build, f"{SHAPE}, copies long")
    return short.unionByName(done.withColumn("copies", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("copies"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of."""
    order = F.when(form == "psm", F.array(F.lit(2), F.lit(4), F.lit(3))).otherwise(F.array(F.lit(3), F.lit(4), F.lit(2)))
    # split once: plain texts aside, each sentinel stands once
    joined = F.transform(F.array(F.split(output, "<[PSM]>", -1)), lambda part: F.array_join(F.transform(order, lambda k: F.try_element_at(part, k)), ""))
    return F.when(form == "plain", output).otherwise(F.element_at(joined, 1))
