"""Document fingerprints in SQL functions only: one-permutation MinHash.

Each 5-word shingle is hashed once; the top bits choose one of ``BINS`` bins and
the least hash of a bin counts. One marker per bin, larger than any hash of it, is
sorted in with the hashes, so the first entry of each bin in the sorted array is
its least hash or, in an empty bin, its marker. An empty bin takes over the bin
that a hash of (bin, attempt) names, at the first attempt that meets a filled
one; after ``ATTEMPTS`` misses the filled bins are ranked by a hash of the pair,
which draws as evenly. The low ``BITS`` of each bin are kept, as one hexadecimal
digit. Two fingerprints agree on a digit with probability J + (1 - J) / 2^BITS,
and ``likeness`` takes that bias out.

Defined results: a null text is an empty one. Texts without words have the
fingerprint of dashes, which is like another of its kind (1) and like no other
(0). Rows of equal doc_id: each is returned, and the least text of an id stands
for it as the next document. A row without a doc_id has no place in the order:
its next document is the first. With one document, it is its own next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHINGLE = 5
BINS = 256
BITS = 4
ATTEMPTS = 6
_BIN_BITS = 8
_LOW_BITS = 63 - _BIN_BITS
_DIGITS = "0123456789abcdef"
BLANK = "-" * BINS


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _shingle_hashes(words: str) -> Column:
    """63-bit hashes of the shingles of an array of words."""
    n = F.size(words)
    word = F.col(words)
    full = F.transform(F.sequence(F.lit(0), n - SHINGLE), lambda i: F.xxhash64(*(F.get(word, i + k) for k in range(SHINGLE))))
    hashes = F.when(n >= SHINGLE, full).when(n > 0, F.array(F.xxhash64(word))).otherwise(F.array().cast("array<bigint>"))
    return F.transform(hashes, lambda h: F.shiftrightunsigned(h, 1))


def _marker(j: int) -> int:
    return (j << _LOW_BITS) | ((1 << _LOW_BITS) - 1)


def _donor(j: int, attempt: int) -> int:
    """A fixed hash of (bin, attempt), as a bin."""
    x = (j * 0x9E3779B97F4A7C15 + attempt * 0xD6E8FEB86659FD93) % (1 << 64)
    x = (x ^ (x >> 32)) * 0xFF51AFD7ED558CCD % (1 << 64)
    return (x ^ (x >> 29)) % BINS


def _literal(values: list[int], kind: str = "") -> Column:
    return F.expr(f"array({', '.join(f'{v}{kind}' for v in values)})")


def with_fingerprint(df: DataFrame, text: str, into: str) -> DataFrame:
    """``df`` with the fingerprint of a text column, computed in named steps so
    that no step is evaluated twice."""
    w, s, v, f = (f"_{into}_{x}" for x in ("words", "sorted", "least", "filled"))
    df = df.withColumn(w, _words(F.col(text)))
    markers = _literal([_marker(j) for j in range(BINS)], "L")
    df = df.withColumn(s, F.sort_array(F.concat(_shingle_hashes(w), markers)))
    first = F.filter(F.col(s), lambda x, i: (i == 0) | (F.shiftright(x, _LOW_BITS) != F.shiftright(F.get(F.col(s), i - 1), _LOW_BITS)))
    low = (1 << _LOW_BITS) - 1
    df = df.withColumn(v, F.transform(first, lambda x: F.when(x.bitwiseAND(F.lit(low)) != low, x)))
    df = df.withColumn(f, F.filter(F.col(v), lambda x: x.isNotNull()))
    tries = [_literal([_donor(j, a) for j in range(BINS)]) for a in range(1, ATTEMPTS + 1)]

    def fill(x: Column, j: Column) -> Column:
        ranked = F.array_min(F.transform(F.col(f), lambda d: F.struct(F.xxhash64(j, F.shiftright(d, _LOW_BITS)).alias("r"), d.alias("d"))))
        return F.coalesce(x, *(F.get(F.col(v), F.get(t, j)) for t in tries), ranked["d"])

    digit = F.transform(F.col(v), lambda x, j: F.substring(F.lit(_DIGITS), (fill(x, j).bitwiseAND(F.lit(15)) + 1).cast("int"), F.lit(1)))
    return df.withColumn(into, F.when(F.size(f) > 0, F.array_join(digit, "")).otherwise(F.lit(BLANK))).drop(w, s, v, f)


def likeness(a: str | Column, b: str | Column) -> Column:
    """Estimated Jaccard similarity of two fingerprints, 0 to 1."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    place = F.sequence(F.lit(1), F.lit(BINS))
    same = F.size(F.filter(place, lambda i: F.substring(a, i, F.lit(1)) == F.substring(b, i, F.lit(1))))
    chance = 1.0 / (1 << BITS)
    corrected = F.greatest(F.lit(0.0), (same / BINS - chance) / (1 - chance))
    return F.when((a == BLANK) | (b == BLANK), (a == b).cast("double")).otherwise(corrected)


def with_next(docs: DataFrame, columns: list[str], slots: int | None = None) -> DataFrame:
    """Each row with ``_next``: a struct of ``columns`` of the document with the
    next larger doc_id (after the last: of the first).

    Slots are ranges of doc_id of about equal size, so each document moves once,
    to its slot; the first document of a slot is put at the end of the slot before
    it too. Only the bounds and first ids of the slots, a fixed number, are
    gathered."""
    slots = slots or max(2, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    shares = ", ".join(str(k / slots) for k in range(1, slots))
    bounds = docs.agg(F.expr(f"percentile_approx(doc_id, array({shares}), 10000)")).first()[0] or []
    slot = F.coalesce(F.size(F.filter(_literal(sorted(set(bounds)), "L"), lambda b: b <= F.col("doc_id"))), F.lit(0)) if bounds else F.lit(0)
    firsts = {r["s"]: r["first"] for r in docs.groupBy(slot.alias("s")).agg(F.min("doc_id").alias("first")).collect()}
    order = sorted((f, s) for s, f in firsts.items() if f is not None)
    echoes = [(f, order[i - 1][1]) for i, (f, _) in enumerate(order)]
    if order and docs.where("doc_id IS NULL").limit(1).count():
        # rows without an id have slots of their own, each with the first document at its end
        echoes += [(order[0][0], -1 - k) for k in range(slots)]
    own = F.when(F.col("doc_id").isNotNull(), slot).otherwise(-1 - F.pmod(F.xxhash64(*columns), F.lit(slots))).cast("int")
    places = F.array(F.struct(own.alias("slot"), F.lit(False).alias("echo")))
    for first in {f for f, _ in echoes}:
        more = F.array(*(F.struct(F.lit(s).alias("slot"), F.lit(True).alias("echo")) for f, s in echoes if f == first))
        places = F.when(F.col("doc_id") == first, F.concat(F.array(F.struct(own.alias("slot"), F.lit(False).alias("echo"))), more)).otherwise(places)
    placed = docs.withColumn("_place", F.explode(places)).withColumn("_slot", F.col("_place.slot")).withColumn("_echo", F.col("_place.echo")).drop("_place")
    backwards = Window.partitionBy("_slot").orderBy(F.desc("_echo"), F.desc("doc_id"), *(F.desc(c) for c in columns))
    row = F.struct("doc_id", *columns)
    placed = placed.withColumn("_after", F.lag(row).over(backwards))
    # rows of equal doc_id share the next other document
    other = F.when(~F.col("_after.doc_id").eqNullSafe(F.col("doc_id")) | (F.lit(len(order) == 1)), F.col("_after"))
    placed = placed.withColumn("_next", F.last(other, ignorenulls=True).over(backwards.rowsBetween(Window.unboundedPreceding, 0)))
    return placed.where(~F.col("_echo")).drop("_slot", "_echo", "_after")


def fingerprint_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next) per document row. The edited text has its last half
    replaced by the beginning of the next document."""
    base = docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("text"))
    both = with_next(with_fingerprint(base, "text", "fingerprint"), ["text", "fingerprint"])
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring(F.coalesce("_next.text", F.lit("")), F.lit(1), half))
    both = both.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "fingerprint", F.coalesce("_next.fingerprint", "fingerprint").alias("_next"))
    both = with_fingerprint(both, "edited", "edited_fingerprint")
    return both.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        likeness("fingerprint", "edited_fingerprint").alias("near_edited"), likeness("fingerprint", "_next").alias("near_next"),
    )
