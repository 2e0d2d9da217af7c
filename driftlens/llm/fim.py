"""Fill-in-middle examples: a text cut in three and written in another order.

Both cuts are numbers of code points, drawn from a hash of the document's id. A text's
bytes know them through its boundary set (``boundaries``): container search and local
select give both byte offsets, so that the text is then cut as bytes, inside the JVM,
without another walk over its letters. Only texts that are rearranged go to the Python
side, and two numbers a text come back.

Defined cases. A null or empty text is plain and gives the empty text. A null id draws
as an empty id. A text that holds a sentinel stays plain, so restoring is exact.
Rows of one id make the same draws; every row gives one row, whatever other columns
there are. An empty table gives none. A text's length is bounded by its column only:
blocks hold about ``BLOCK_BYTES`` or one longer text, at one byte a byte.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftlens.llm.boundaries import BoundarySet

SENTINELS = ("<P>", "<S>", "<M>")  # prefix, suffix, middle
SEED = "1"
REARRANGED = 90  # percent of texts that are not left plain
SUFFIX_FIRST = 20  # percent of rearranged texts in suffix-prefix-middle order
BLOCK_BYTES = 1 << 22


def byte_offsets(texts: pa.Array, cuts: list[np.ndarray]) -> list[np.ndarray]:
    """Byte offset in each text of each of its cuts, given in code points."""
    texts = texts.fill_null("").cast(pa.large_string()).cast(pa.large_binary())
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    out = [np.zeros(len(texts), np.int64) for _ in cuts]
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + BLOCK_BYTES, side="right")) - 1)
        first = bounds[at:to] - bounds[at]
        starts = BoundarySet.of_code_points(data[bounds[at] : bounds[to]])
        before = starts.rank(first)
        for cut, result in zip(cuts, out, strict=True):
            result[at:to] = starts.select(before + cut[at:to]) - first
        at = to
    return out


@F.arrow_udf(T.StructType().add("a", T.IntegerType()).add("b", T.IntegerType()))
def _cut_offsets(texts: pa.Array, low: pa.Array, high: pa.Array) -> pa.Array:
    cuts = [x.fill_null(0).to_numpy(zero_copy_only=False) for x in (low, high)]
    return pa.StructArray.from_arrays([pa.array(x, pa.int32()) for x in byte_offsets(texts, cuts)], ["a", "b"])


def _draw(digest: Column, k: int) -> Column:
    """The k-th 8-digit group of a hex digest."""
    return F.conv(F.substring(digest, 8 * k - 7, 8), 16, 10).cast("long")


def fill_in_middle(docs: DataFrame, text: str = "text", key: str = "doc_id", *, seed: str = SEED, rearranged: int = REARRANGED,
                   suffix_first: int = SUFFIX_FIRST, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """(key, n, form, prefix_chars, middle_chars, output) per document row; ``form`` is
    plain, psm or spm, and ``output`` the text to train on."""
    d = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("text"))
    d = d.withColumns({"n": F.length("text").cast("long"), "h": F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)})
    plain = (F.col("n") == 0) | (_draw(F.col("h"), 3) % 100 >= rearranged)
    for s in sentinels:
        plain = plain | F.contains("text", F.lit(s))
    psm_or_spm = F.when(_draw(F.col("h"), 4) % 100 < suffix_first, "spm").otherwise("psm")
    c1, c2 = (_draw(F.col("h"), k) % (F.col("n") + 1) for k in (1, 2))
    d = d.withColumns({"form": F.when(plain, "plain").otherwise(psm_or_spm), "low": F.least(c1, c2), "high": F.greatest(c1, c2)}).drop("h")
    moved = F.col("form") != "plain"
    d = d.withColumn("at", _cut_offsets(F.when(moved, F.col("text")), F.when(moved, F.col("low")), F.when(moved, F.col("high"))))
    raw, a, b = F.col("text").cast("binary"), F.col("at.a"), F.col("at.b")
    prefix, middle, suffix = F.substring(raw, F.lit(1), a), F.substring(raw, a + 1, b - a), F.substring(raw, b + 1, F.octet_length("text") - b)
    p, s, m = (F.lit(x.encode()) for x in sentinels)
    output = (
        F.when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle))
        .when(F.col("form") == "spm", F.concat(s, suffix, p, prefix, m, middle))
        .otherwise(raw)
    )
    return d.select(F.col(key), "n", "form", F.when(moved, F.col("low")).alias("prefix_chars"),
                    F.when(moved, F.col("high") - F.col("low")).alias("middle_chars"), output.cast("string").alias("output"))


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that ``output`` was made of. A rearranged text holds each sentinel once."""
    parts = F.split(output, "|".join(r"\Q" + x + r"\E" for x in sentinels), -1)
    one, two, three = (F.get(parts, F.lit(k)) for k in (1, 2, 3))
    return F.when(form == "psm", F.concat(one, three, two)).when(form == "spm", F.concat(two, three, one)).otherwise(output)


def fill_in_middle_digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256)."""
    d = fill_in_middle(docs)
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return d.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"),
                    sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))
