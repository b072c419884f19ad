"""Document fingerprints as invertible Bloom lookup sketches, in DataFrame functions only.

A text's paragraphs (lines; a long line is cut by its content, at the first ``CUT`` character after ``LEAST`` others, so an
insertion changes the pieces around it only) are hashed to sealed 64-bit digests, whose low 16 bits check the other 48. A
sketch has three subtables of ``SLOTS`` cells; a digest goes to one cell of each, and a cell is the
exclusive-or of its digests. Two sketches subtract cell by cell by exclusive-or, which cancels what both have; a
cell whose seal holds has a single digest left, and peeling such digests recovers those that only one
version has. The fingerprint is that sketch. Where peeling stalls, both versions are sketched again
in as many groups of cells as their digests ask for, placed by another hash; groups that stall are sketched again in their turn,
up to ``RETRIES`` times, when the chance that anything is left is below 1e-60.

Null texts count as empty; a paragraph that repeats in a text counts once; equal texts have equal
fingerprints; texts without paragraphs are alike; whole texts are read however long. Rows are put in order by narrow
keys (id and text hash), in ranges of about ``RANGE`` keys that split repeated and missing ids by the text hash; each
document then sends the document before it only as much of its text as that one needs. Rows of equal id are ordered
by text hash, equal rows are each other's next, and rows without an id come last. Other columns are ignored; an empty table gives no
rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ionweave.llm.common import cut

LEAST, SLOTS, ROUNDS, RETRIES, PER_GROUP, RANGE = 160, 8, 9, 40, 4, 500_000
#: Characters that end a piece: sentence ends, rare letters, and parts of scripts without either.
CUT = "[.!?;。！？kvwzKVWZжчщЖЧЩأ-اあ-く一-叿가-꿿]"
PATTERN = f"[^\n]{{{LEAST},}}?{CUT}|[^\n]+"
CELLS = 3 * SLOTS


def _seal(high: Column) -> Column:
    """The 16 bits that check a digest's upper 48."""
    return F.xxhash64(high).bitwiseAND(F.lit(0xFFFF))


def _sealed(h: Column) -> Column:
    return h.bitwiseAND(F.lit(-0x10000)).bitwiseOR(_seal(F.shiftrightunsigned(h, 16)))


def digests(text: Column) -> Column:
    """Distinct sealed hashes of a text's paragraph pieces."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(PATTERN), 0), lambda p: _sealed(F.xxhash64(p))))


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _none() -> Column:
    return F.array().cast("array<bigint>")


def _put(cell: Column, keys: Column, subtable: int, slot: Column, seed: Column | None) -> Column:
    """``cell`` with those of ``keys`` that belong in it added (or taken out, which is the same)."""
    place = lambda k: k if seed is None else F.xxhash64(k, seed)
    mine = lambda k: F.shiftrightunsigned(place(k), 16 + 3 * subtable).bitwiseAND(F.lit(SLOTS - 1)) == slot
    return F.aggregate(keys, cell, lambda a, k: F.when(mine(k), a.bitwiseXOR(k)).otherwise(a))


def _over(subtable: int, keys: Column, seed: Column | None, empty: bool):
    return (lambda i: _put(F.lit(0).cast("long"), keys, subtable, i, seed)) if empty else (lambda c, i: _put(c, keys, subtable, i, seed))


def cells(keys: Column, seed: Column | None = None) -> Column:
    """The ``CELLS`` cells of one group's digests, placed by ``seed``."""
    slots = F.array(*[F.lit(i).cast("long") for i in range(SLOTS)])
    return F.concat(*[F.transform(slots, _over(j, keys, seed, True)) for j in range(3)])


def peel(difference: Column, seed: Column | None = None) -> Column:
    """The digests that peeling a difference of sketches recovers; null if it stalls."""
    single = lambda table: F.array_distinct(F.filter(table, lambda c: (c != 0) & (_seal(F.shiftrightunsigned(c, 16)) == c.bitwiseAND(F.lit(0xFFFF)))))
    without = lambda table, got: F.concat(*[F.transform(F.slice(table, 1 + j * SLOTS, SLOTS), _over(j, got, seed, False)) for j in range(3)])
    state = lambda table, found: F.struct(table.alias("table"), found.alias("found"))
    step = lambda st, _: _let(single(st.table), lambda got: F.when(F.size(got) == 0, st).otherwise(state(without(st.table, got), F.concat(st.found, got))))
    clean = lambda st: F.forall(st.table, lambda c: c == 0) & (F.size(F.array_distinct(st.found)) == F.size(st.found))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), state(difference, _none()), step, lambda st: F.when(clean(st), st.found))


def subtract(left: Column, right: Column) -> Column:
    return F.zip_with(left, right, lambda a, b: a.bitwiseXOR(b))


def _groups(keys: Column, side: Column, seed: Column) -> Column:
    """Keys in ``side`` x ``side`` groups, split by some bits and then by others."""
    bits = lambda k, shift: F.shiftrightunsigned(F.xxhash64(k, seed), shift).bitwiseAND(F.lit(0xFFFFF))
    part = lambda ks, shift: F.transform(F.sequence(F.lit(0), side - 1), lambda g: F.filter(ks, lambda k: F.pmod(bits(k, shift), side) == g))
    return F.flatten(F.transform(part(keys, 26), lambda ks: part(ks, 44)))


def retry(left: Column, right: Column) -> Column:
    """The digests that differ, from sketches in groups; groups that stall are sketched again by another hash.

    A difference of sketches is the sketch of both versions' digests put in together.
    """
    state = lambda rest, found: F.struct(rest.alias("rest"), found.alias("found"))
    peeled = lambda g, seed: F.struct(g.alias("g"), F.when(F.size(g) == 0, _none()).otherwise(peel(cells(g, seed), seed)).alias("got"))

    def turn(st, seed):
        side = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(st.rest) / PER_GROUP)).cast("int"))
        tried = _let(side, lambda s: F.transform(_groups(st.rest, s, seed), lambda g: peeled(g, seed)))
        stalled = lambda x: F.flatten(F.transform(F.filter(x, lambda y: y.got.isNull()), lambda y: y.g))
        done = lambda x: F.flatten(F.transform(F.filter(x, lambda y: y.got.isNotNull()), lambda y: y.got))
        return F.when(F.size(st.rest) == 0, st).otherwise(_let(tried, lambda x: state(stalled(x), F.concat(st.found, done(x)))))

    return F.aggregate(F.sequence(F.lit(1), F.lit(RETRIES)), state(F.concat(left, right), _none()), turn, lambda st: F.when(F.size(st.rest) == 0, st.found))


def with_difference(df: DataFrame, name: str, left: tuple[str, str], right: tuple[str, str]) -> DataFrame:
    """``df`` with the recovered digests that only one of two versions has, each a (digests, sketch) pair of columns."""
    df = df.withColumn(name, peel(subtract(F.col(left[1]), F.col(right[1]))))
    return df.withColumn(name, F.when(F.col(name).isNull(), retry(F.col(left[0]), F.col(right[0]))).otherwise(F.col(name)))


def likeness(difference: Column, left: Column, right: Column) -> Column:
    """Share of the two versions' digests that both have, 0 to 1, given the recovered difference."""
    total = F.size(left) + F.size(right)
    return F.when(total == 0, F.lit(1.0)).otherwise(1.0 - F.size(difference) / total)


def text_of(sketch: Column) -> Column:
    """A sketch as a hexadecimal string."""
    return F.lower(F.array_join(F.transform(sketch, lambda c: F.lpad(F.hex(c), 16, "0")), ""))


def sketched(df: DataFrame, text: str, keys: str, sketch: str) -> DataFrame:
    """``df`` with the digests and the sketch of a text column."""
    return df.withColumn(keys, digests(F.col(text))).withColumn(sketch, cells(F.col(keys)))


def compare(df: DataFrame, old: str, new: str) -> DataFrame:
    """``df`` with what a text column lost and gained against another: ``lost`` and ``gained`` digests, and ``likeness``."""
    both = sketched(sketched(df.withColumns({"old_text": F.coalesce(old, F.lit("")), "new_text": F.coalesce(new, F.lit(""))}), "old_text", "old_keys", "old_sketch"), "new_text", "new_keys", "new_sketch")
    found = with_difference(both, "found", ("old_keys", "old_sketch"), ("new_keys", "new_sketch"))
    has = lambda keys: F.filter("found", lambda k: F.array_contains(keys, k))
    out = {"lost": has("old_keys"), "gained": has("new_keys"), "likeness": likeness(F.col("found"), F.col("old_keys"), F.col("new_keys"))}
    return found.withColumns(out).drop("old_text", "new_text", "old_keys", "old_sketch", "new_keys", "new_sketch", "found")


# --- the next document -------------------------------------------------------------------------
KEY = ["none", "id", "th"]  # a row's key: no id, the id, the text hash


def _linked(rows: DataFrame) -> DataFrame:
    """Each distinct key with its number of rows ``m`` and the key and length of the one before it in falling order."""
    keys = rows.groupBy(*KEY).agg(F.count("*").alias("m"), F.min("n").alias("n"))
    order = [F.col("none"), F.col("id").desc(), F.col("th")]
    parts = int((rows.count() // RANGE) + 1)
    placed = cut(keys.repartitionByRange(parts, *order).withColumn("p", F.spark_partition_id()))
    own = F.struct(*KEY, "n")
    falling = F.struct(F.col("none"), F.bitwise_not("id"), F.col("th"))
    last = placed.groupBy("p").agg(F.max_by(own, falling).alias("last"))  # a row for each range
    before = last.withColumn("ahead", F.lag("last").over(Window.orderBy("p"))).crossJoin(F.broadcast(last.agg(F.max_by("last", "p").alias("end")))).select("p", F.coalesce("ahead", "end").alias("ahead"))
    inside = placed.withColumn("prev", F.lag(own).over(Window.partitionBy("p").orderBy(*order)))
    return inside.join(before, "p").select(*KEY, "m", F.coalesce("prev", "ahead").alias("prev"))


def with_next(docs: DataFrame) -> DataFrame:
    """``(doc_id, t, keys, sketch, ahead, next_keys, next_sketch)``: every document with what its edit takes of the next by falling id.

    ``ahead`` is the first half as many characters of the next text; the last document's next is the first.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    number = F.col("doc_id").cast("long")
    rows = docs.select(number.isNull().alias("none"), F.coalesce(number, F.lit(0)).alias("id"), F.xxhash64(text).alias("th"), text.alias("t"), F.length(text).alias("n"))
    linked = _linked(rows.drop("t"))
    one = rows.select(*KEY, "t").repartition(*KEY).groupBy(*KEY).agg(F.first("t").alias("t"))
    own = sketched(one.join(linked, KEY), "t", "keys", "sketch")
    half = lambda n: F.floor(n / 2).cast("int")
    sent = own.select(*[F.col(f"prev.{c}").alias(c) for c in KEY], F.substr("t", F.lit(1), half(F.col("prev.n"))).alias("ahead"), F.col("keys").alias("next_keys"), F.col("sketch").alias("next_sketch"))
    both = own.drop("prev").join(sent, KEY).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("m").cast("int"))))
    twin = F.col("copy") < F.col("m")  # the next is an equal row
    return both.select(
        F.when(~F.col("none"), F.col("id")).alias("doc_id"),
        "t",
        "keys",
        "sketch",
        F.when(twin, F.substr("t", F.lit(1), half(F.length("t")))).otherwise(F.col("ahead")).alias("ahead"),
        F.when(twin, F.col("keys")).otherwise(F.col("next_keys")).alias("next_keys"),
        F.when(twin, F.col("sketch")).otherwise(F.col("next_sketch")).alias("next_sketch"),
    )


def edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness to each other and to the next's."""
    edited = F.concat(F.expr("substring(t, 1, length(t) - cast(floor(length(t) / 2) as int))"), F.col("ahead"))
    df = with_next(docs).withColumn("edited", edited)
    df = df.select("doc_id", F.length("t").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "keys", "sketch", "next_keys", "next_sketch", digests(F.col("edited")).alias("edited_keys"))
    df = df.withColumn("edited_sketch", cells(F.col("edited_keys")))
    df = with_difference(df, "d_edited", ("keys", "sketch"), ("edited_keys", "edited_sketch"))
    df = with_difference(df, "d_next", ("keys", "sketch"), ("next_keys", "next_sketch"))
    return df.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        text_of(F.col("sketch")).alias("fingerprint"),
        text_of(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("d_edited"), F.col("keys"), F.col("edited_keys")).alias("near_edited"),
        likeness(F.col("d_next"), F.col("keys"), F.col("next_keys")).alias("near_next"),
    )
