"""One-permutation MinHash fingerprints: DataFrame functions only.

Each shingle is hashed once; the leading bits name a bin, and a bin keeps its least hash. An empty bin takes the value
of another by optimal densification: a 2-universal hash of bin and attempt names the bins to try. Of each bin only the
low-order bits are stored, eight bins in a long; the estimate is corrected for their chance agreement.

Shingles are rows that are aggregated where their text lies: the texts are dealt out once, by a key that every later
grouping contains, so that neither shingles nor bins are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

#: Bins, stored bits of each bin, and words of a shingle.
BINS, BITS, SHINGLE = 256, 8, 5
#: Hashes have 63 bits; the first eight name the bin.
_SHIFT = 55
#: The prime of the hash family that densification draws its attempts from, and how many are drawn before a permutation decides.
_PRIME, _ATTEMPTS = 2147483647, 12
_SPACE = " \t\n\x0b\f\r"


def _probe(bin_: Column, attempt: int) -> Column:
    return ((bin_ * (48271 * (2 * attempt + 1) % _PRIME) + 69621 * (attempt + 1)) % _PRIME % BINS).cast("int")


def bin_minima(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys and minima: the least hash of each bin of ``text``, in the order of bins; an empty bin has its last possible value.

    A row without words has an empty array. ``rows`` should be partitioned by a column among ``keys`` already.
    """
    trimmed = F.trim(F.col(text), F.lit(_SPACE))
    split = rows.select(*keys, F.when(trimmed != "", F.split(trimmed, r"[\x20\x09-\x0D]+")).alias("w"))
    # numbers below 0 stand for the bins' last values, so that each bin has a row
    numbered = split.select(*keys, "w", F.explode(F.sequence(F.when(F.col("w").isNull(), -1).otherwise(-BINS), F.when(F.col("w").isNull(), -1).otherwise(F.greatest(F.size("w") - SHINGLE, F.lit(0))))).alias("i"))
    shingle = F.shiftrightunsigned(F.xxhash64(*(F.get("w", F.col("i") + k) for k in range(SHINGLE))), 1)
    last = F.shiftleft((-F.col("i") - 1).cast("long"), _SHIFT).bitwiseOR(F.lit((1 << _SHIFT) - 1).cast("long"))
    value = F.when(F.col("w").isNull(), F.lit(None).cast("long")).when(F.col("i") < 0, last).otherwise(shingle)
    hashed = numbered.select(*keys, value.alias("h"))
    least = hashed.groupBy(*keys, F.shiftright("h", _SHIFT).alias("bin")).agg(F.min("h").alias("h"))
    return least.groupBy(*keys).agg(F.sort_array(F.collect_list("h")).alias("minima"))


def packed(minima: Column) -> Column:
    """Densified low-order bits, eight bins in each long; an empty array stays empty. ``minima`` must be a plain column."""
    tail = F.lit((1 << _SHIFT) - 1).cast("long")
    full = lambda x: F.when(x.bitwiseAND(tail) != tail, x)
    # the bin that comes first in a permutation of its own, for the few that no attempt fills
    found = lambda i: F.array_min(F.transform(F.filter(minima, lambda x: x.bitwiseAND(tail) != tail), lambda x: F.struct(F.xxhash64(i, F.shiftright(x, _SHIFT)).alias("r"), x.alias("x"))))["x"]
    dense = F.transform(minima, lambda x, i: F.coalesce(full(x), *(full(F.get(minima, _probe(i.cast("long"), t))) for t in range(_ATTEMPTS)), found(i)))
    low = F.lit((1 << BITS) - 1).cast("long")

    def eight(d: Column, j: Column) -> Column:
        parts = [F.shiftleft(F.get(d, j * 8 + k).bitwiseAND(low), 8 * (7 - k)) for k in range(8)]
        for p in parts[1:]:
            parts[0] = parts[0].bitwiseOR(p)
        return parts[0]

    # one value at a time is bound to a name, so that the densified array is made once
    return F.flatten(F.transform(F.array(dense), lambda d: F.when(F.size(d) == 0, F.array().cast("array<long>")).otherwise(F.transform(F.sequence(F.lit(0), F.lit(BINS // 8 - 1)), lambda j: eight(d, j)))))


def as_text(fingerprint: Column) -> Column:
    """Two hexadecimal digits for each bin."""
    return F.array_join(F.transform(fingerprint, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two packed fingerprints, 0 to 1. Without words a text is like such texts only."""
    ones = F.lit(0x0101010101010101).cast("long")

    def unequal(x: Column, y: Column) -> Column:
        """How many of eight bytes differ: each byte is folded into its lowest bit."""
        z = x.bitwiseXOR(y)
        for n in (4, 2, 1):
            mask = {4: 0x0F0F0F0F0F0F0F0F, 2: 0x3333333333333333, 1: 0x5555555555555555}[n]
            z = z.bitwiseOR(F.shiftrightunsigned(z, n).bitwiseAND(F.lit(mask).cast("long")))
        return F.bit_count(z.bitwiseAND(ones))

    differ = F.aggregate(F.zip_with(a, b, unequal), F.lit(0), lambda n, x: n + x)
    chance = 1.0 / (1 << BITS)
    value = (1 - differ / F.lit(float(BINS)) - chance) / (1 - chance)
    return F.when(a == b, 1.0).when((F.size(a) == 0) | (F.size(b) == 0) | a.isNull() | b.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fingerprint (packed longs) of every whole text.

    Words are parted by white space; a shingle has five words (a shorter text is one shingle); equal texts have equal
    fingerprints. A null text counts as empty; without words the fingerprint is an empty array. Null ids pass through;
    rows that repeat both id and text are returned once. Other columns are not read; no rows give no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("of", F.xxhash64("doc_id", "text"))
    return bin_minima(rows.repartition("of"), ["of", "doc_id"], "text").select("doc_id", packed(F.col("minima")).alias("fingerprint"))


def in_line(docs: DataFrame, buckets: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document with the text of the next one, by descending id; the last document's next is the first.

    Ids fall into ranges of about equal numbers of documents, whose bounds come from approximate quantiles (a bounded
    number of values); each range is ordered in a task of its own, and the first document of a range is dealt to the
    range before as well (column ``lent``). Rows that repeat an id stand in the order of their texts, rows without an
    id come last. Returns k (the range), rn (the place in it), lent, doc_id, text, next_text.
    """
    buckets = buckets or 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    ids = rows.select("doc_id")
    cuts = ids.agg(F.percentile_approx("doc_id", [k / buckets for k in range(1, buckets)] or [0.5], 10000).alias("q")).first().q or []
    cuts = sorted(set(cuts))
    # range 0 holds the largest ids; ids that are null follow all others
    above = F.size(F.filter(F.array(*(F.lit(c).cast("long") for c in cuts)), lambda c: c < F.col("doc_id"))) if cuts else F.lit(0)
    rows = rows.withColumn("k", F.when(F.col("doc_id").isNull(), len(cuts) + 1).otherwise(len(cuts) - above))
    firsts = rows.groupBy("k").agg(F.max("doc_id").alias("top")).orderBy("k").collect()
    seat = lambda k, lent: F.struct(k.cast("int").alias("k"), F.lit(lent).alias("lent"))
    seats = F.array(seat(F.col("k"), False))
    if firsts:
        before = F.create_map(*(F.lit(x) for i, r in enumerate(firsts) for x in (r.k, firsts[i - 1].k)))
        tops = F.create_map(*(F.lit(x) for r in firsts for x in (r.k, -1 if r.top is None else r.top)))
        is_top = F.col("doc_id").isNull() | (F.col("doc_id") == tops[F.col("k")])
        seats = F.when(is_top, F.array(seat(F.col("k"), False), seat(before[F.col("k")], True))).otherwise(seats)
    seated = rows.select("doc_id", "text", F.explode(seats).alias("seat")).select(F.col("seat.k").alias("k"), F.col("seat.lent").alias("lent"), "doc_id", "text")
    # so many partitions, whatever their size: a text becomes many rows of shingles, which are to stay in memory
    seated = seated.repartition(buckets, "k")
    line = Window.partitionBy("k").orderBy("lent", F.col("doc_id").desc_nulls_last(), "text")
    return seated.select("k", F.row_number().over(line).alias("rn"), "lent", "doc_id", "text", F.lead("text").over(line).alias("next_text"))


def compare_with_edits(docs: DataFrame, buckets: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of an edited one, whose last third is replaced by the next document's beginning.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, next_fingerprint (packed longs). The last
    floor(n_chars / 3) code points give way to as many of the next text, or all of it if that has fewer. The order of
    documents and its edge cases are those of in_line; a null text is an empty one; no rows give no rows.
    """
    line = in_line(docs, buckets, id_col, text_col)
    edited = F.expr("concat(substring(text, 1, length(text) - cast(floor(length(text) / 3) as int)), substring(next_text, 1, cast(floor(length(text) / 3) as int)))")
    texts = F.when(F.col("lent"), F.array("text")).otherwise(F.array(F.col("text"), edited))
    both = line.select("k", "rn", F.posexplode(texts).alias("which", "t"))
    made = bin_minima(both, ["k", "rn", "which"], "t").select("k", "rn", "which", packed(F.col("minima")).alias("f"))
    order = Window.partitionBy("k").orderBy("rn")
    paired = made.groupBy("k", "rn").agg(*(F.max(F.when(F.col("which") == n, F.col("f"))).alias(c) for n, c in ((0, "fingerprint"), (1, "edited_fingerprint"))))
    paired = paired.select("k", "rn", "fingerprint", "edited_fingerprint", F.lead("fingerprint").over(order).alias("next_fingerprint"))
    digests = line.where(~F.col("lent")).select("k", "rn", "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(edited, 256).alias("edited_sha256"))
    return digests.join(paired, ["k", "rn"]).drop("k", "rn")
