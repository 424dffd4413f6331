"""I-Match fingerprints with randomised lexicons, from DataFrame functions only.

The lexicon is the terms whose share of documents lies within a band: terms that nearly every document has tell nothing, and rare
ones change with every edit. Of a text's distinct terms those in the lexicon stay, sorted; they are hashed once for each of
SUBSETS random parts of the lexicon. Parts come in several densities, so that short texts meet a few dense parts and long texts
differ in a few sparse ones. The likeness of two texts is the share of equal hashes among the parts that either has terms in.

Bound: a document has t distinct terms on average, so at most t / LOW terms can be in a share of LOW documents or more, however
many documents there are. The lexicon is therefore safe to broadcast. Terms meet it in the tasks that hold the texts, and only
what is in the lexicon is gathered again, by document.

Cases: a null text counts as empty; a text without lexicon terms (the empty one as well) is fingerprinted by its own hash, so it
is like equal texts only; repeated rows count as documents of their own; of equal keys the larger hash of the text comes first by
descending key, null keys come last; a corpus of one document is its own next one; columns other than the key and the text take no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bind, blank_null, written

LOW, HIGH = 0.002, 0.2
DENSITIES = (8, 32, 128, 512)
SUBSETS = 64
#: A prime, so that (a * x + b) mod PRIME < PRIME / density deals terms over subsets.
PRIME = (1 << 31) - 1
SEPARATORS = r"[\x20\x09-\x0D]+"
#: Documents of one bucket of neighbouring ids, in bytes of input. The bounds of buckets are a constant in the plan and their heads are
#: broadcast, so there are at most MOST_BUCKETS (of 0.8 GB at 100 TB); KEYS keys for each bucket are looked at to find the bounds.
BUCKET_BYTES = 8 << 20
MOST_BUCKETS = 1 << 17
KEYS = 32


def terms_of(text: Column) -> Column:
    """Distinct terms, and the empty string once."""
    return F.array_union(F.array(F.lit("")), F.split(text, SEPARATORS))


def multipliers() -> list[tuple[int, int, int]]:
    """(a, b, limit) of each subset."""
    return [((s * 1103515245 + 12345) % (PRIME - 1) + 1, (s * 69069 + 1) * 2654435761 % PRIME, PRIME // DENSITIES[s % len(DENSITIES)]) for s in range(SUBSETS)]


def lexicon(docs: DataFrame, n: int, low: float = LOW, high: float = HIGH) -> DataFrame:
    """term, df, code and mask: bit s of mask is set if the term is in subset s. n: how many documents there are."""
    counted = docs.select(F.explode(terms_of(blank_null())).alias("term")).where("term != ''").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    code = F.conv(F.substring(F.md5("term"), 1, 15), 16, 10).cast("bigint")
    x = F.pmod(F.col("code"), F.lit(PRIME))
    mask = F.lit(0).cast("bigint")
    for s, (a, b, limit) in enumerate(multipliers()):
        mask = mask.bitwiseOR(F.when(F.pmod(x * F.lit(a).cast("bigint") + b, F.lit(PRIME)) < limit, F.shiftleft(F.lit(1).cast("bigint"), s)).otherwise(F.lit(0).cast("bigint")))
    return counted.where((F.col("df") >= max(2, low * n)) & (F.col("df") <= high * n)).withColumn("code", code).withColumn("mask", mask)


def hashes(kept: Column, own: Column) -> Column:
    """array<int>: for each subset a number of 28 bits and one, or 0 where no kept term (code, mask) is in it. own: hash of the text."""

    def number(x: Column) -> Column:
        return F.conv(F.substring(F.md5(x), 1, 7), 16, 10).cast("int") + 1

    def one(s: Column, entries: Column) -> Column:
        inside = F.transform(F.filter(entries, lambda e: F.getbit(e["mask"], s) == 1), lambda e: e["code"].cast("string"))
        return bind(inside, lambda i: F.when(F.size(i) == 0, F.lit(0)).otherwise(number(F.array_join(i, ","))))

    def of_density(g: int, entries: Column) -> Column:
        # the sparser a density's subsets, the fewer terms are in any of them
        bits = sum(1 << s for s in range(g, SUBSETS, len(DENSITIES)))
        met = F.filter(entries, lambda e: e["mask"].bitwiseAND(F.lit(bits - (1 << 64) if bits >> 63 else bits).cast("bigint")) != 0)
        return bind(met, lambda m: F.transform(F.sequence(F.lit(g), F.lit(SUBSETS - 1), F.lit(len(DENSITIES))), lambda s: one(s, m)))

    def all_of(entries: Column) -> Column:
        every = F.concat(*[of_density(g, entries) for g in range(len(DENSITIES))])
        return F.when(F.size(entries) == 0, F.array_repeat(number(F.concat(F.lit("text:"), own)), SUBSETS)).otherwise(every)

    return bind(F.sort_array(kept), all_of)


def as_text(hashes: Column) -> Column:
    return F.array_join(F.transform(hashes, lambda x: x.cast("string")), ".")


def likeness(a: Column, b: Column) -> Column:
    """Equal hashes among the subsets in which either has terms; 0 if there are none."""
    pairs = F.arrays_zip(a.alias("a"), b.alias("b"))
    return bind(pairs, lambda z: F.coalesce(F.size(F.filter(z, lambda x: (x["a"] == x["b"]) & (x["a"] > 0))) / F.nullif(F.size(F.filter(z, lambda x: x["a"] + x["b"] > 0)), F.lit(0)), F.lit(0.0)))


def place_of(value: Column, bounds: Column, most: int) -> Column:
    """How many of the sorted bounds are <= value: binary search as a fold over the powers of two."""
    steps, s = [], 1
    while s <= most:
        steps.append(s)
        s *= 2
    halves = F.array(*[F.lit(x) for x in reversed(steps)])
    return F.aggregate(halves, F.lit(0), lambda at, x: F.when(F.coalesce(F.get(bounds, at + x - 1) <= value, F.lit(False)), at + x).otherwise(at))


def with_next(docs: DataFrame, rows: int, key: str = "doc_id") -> DataFrame:
    """docs (key, text) with bucket, its place there, and next_text, the text of the next document by descending key; the last one's is the
    first's. rows: how many documents there are. head: whether the next document is in another bucket.

    Documents are dealt into buckets of neighbouring keys, one shuffle. Only a bucket's last row looks into another bucket; heads of
    buckets are found by key, so that no text moves for it, and joined by bucket. Of equal keys the larger row hash comes first, null
    keys come last.
    """
    spark = docs.sparkSession
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    n = min(MOST_BUCKETS, max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), size // BUCKET_BYTES, 2), max(2, rows))  # sizes may be unknown
    lot = F.pmod(F.xxhash64(key, F.lit(5)), F.lit(1 << 30)) <= int(min(1.0, KEYS * n / max(1, rows)) * (1 << 30))
    places = ", ".join(f"{i / n}D" for i in range(1, n))
    found = docs.where(lot).select(F.col(key).alias("k")).agg(F.expr(f"percentile_approx(k, array({places}), {10 * n})").alias("bounds"))
    bounds = sorted(set(written(found, "bounds", release=False).first()[0] or []))
    # one constant, as text: a list of literals would cost the driver a call each
    known = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")
    bucket = F.when(F.col(key).isNull(), F.lit(-1)).otherwise(place_of(F.col(key), known, n)) if bounds else F.lit(-1)
    keyed = docs.withColumn("tie", F.xxhash64("text"))
    # as many rows as there are buckets, at most MOST_BUCKETS, whatever the input is
    least = F.lit(-(1 << 63)).cast("bigint")
    tops = keyed.groupBy(bucket.alias("bucket")).agg(F.max(F.struct(F.coalesce(F.col(key), least).alias("k"), F.col("tie").alias("t"))).alias("top"))
    above = Window.orderBy(F.col("bucket").desc())
    tops = tops.select(F.coalesce(F.lag("bucket").over(above), F.min("bucket").over(Window.orderBy(F.lit(1)))).alias("before"), F.col("top.k").alias("k"), F.col("top.t").alias("t"))
    heads = keyed.join(F.broadcast(tops), (F.coalesce(F.col(key), least) == F.col("k")) & (F.col("tie") == F.col("t"))).dropDuplicates(["before"])
    order = Window.partitionBy("bucket").orderBy(F.col(key).asc_nulls_first(), "tie")
    led = keyed.withColumn("bucket", bucket).withColumns({"place": F.row_number().over(order), "led": F.lag("text").over(order)})
    joined = led.join(heads.select("before", F.col("text").alias("head")), F.col("bucket") == F.col("before"), "left")
    return joined.select(key, "text", "bucket", "place", F.coalesce("led", "head").alias("next_text"), F.col("led").isNull().alias("head"))


def fingerprints(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, n_chars, the digest of the edited text (its last half replaced by the next document's head), fingerprints of the text, the
    edited text and the next text as arrays, and the likeness of the first to the other two."""
    base = docs.select(F.col(key), blank_null().alias("text"))
    n = base.count()
    lex = written(lexicon(base, n).select(F.xxhash64("term").alias("h"), "code", "mask"), "lexicon")
    half = F.floor(F.length("text") / 2).cast("int")
    paired = with_next(base, n, key).withColumn("edited", F.concat(F.left("text", F.length("text") - half), F.left("next_text", half)))
    # a text is printed once: what follows it has its print in the row before, but for the first row of a bucket
    kinds = F.array(*[F.struct(F.lit(i).alias("kind"), F.col(c).alias("t")) for i, c in enumerate(("text", "edited"))])
    other = F.when(F.col("head"), F.array(F.struct(F.lit(2).alias("kind"), F.col("next_text").alias("t")))).otherwise(F.array().cast("array<struct<kind:int,t:string>>"))
    told = paired.select(
        "bucket", "place", key, F.length("text").cast("bigint").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), F.explode(F.concat(kinds, other)).alias("of")
    )
    # the empty term stands for the text itself, so that texts without lexicon terms stay
    terms = told.withColumn("own", F.md5("of.t")).withColumn("term", F.explode(terms_of(F.col("of.t")))).withColumn("h", F.xxhash64("term"))
    met = terms.join(F.broadcast(lex), "h", "left").where("code is not null or term = ''")
    row = F.when(F.col("term") == "", F.struct(key, "n_chars", "edited_sha256"))
    kept = [F.collect_list(F.when((F.col("of.kind") == i) & F.col("code").isNotNull(), F.struct("code", "mask"))).alias(f"kept{i}") for i in range(3)]
    owns = [F.first(F.when(F.col("of.kind") == i, F.col("own")), True).alias(f"own{i}") for i in range(3)]
    # by bucket and place: the rows of a document lie in one task already
    grouped = met.groupBy("bucket", "place").agg(F.first(row, True).alias("row"), *kept, *owns)
    prints = [hashes(F.col(f"kept{i}"), F.col(f"own{i}")).alias(c) for i, c in enumerate(("print", "edited_print"))]
    far = F.when(F.col("own2").isNotNull(), hashes(F.col("kept2"), F.col("own2"))).alias("far")
    out = grouped.select("bucket", "place", "row.*", *prints, far)
    out = out.withColumn("next_print", F.coalesce("far", F.lag("print").over(Window.partitionBy("bucket").orderBy("place")))).drop("bucket", "place", "far")
    return out.withColumns({"near_edited": likeness(F.col("print"), F.col("edited_print")), "near_next": likeness(F.col("print"), F.col("next_print"))})
