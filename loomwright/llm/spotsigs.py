"""SpotSigs fingerprints: chains of content words that follow common-word anchors.

Words are lower-cased runs of letters and digits. A spot is an anchor word and the next
``CHAIN`` words that are not common words; the fingerprint is the set of the spots' 64-bit
hashes, written in ascending order of their hex digits. A text without a spot (too short, or of
none of the languages) uses every word as an anchor, and a text of fewer than two words
is one signature. Two fingerprints are compared by the Jaccard coefficient of their sets.

Everything is DataFrame functions, and time is linear in a text's length: words are looked up one
by one, and a run of anchors is read once, however long. ``near_classes`` and ``near_pairs`` first make classes of equal fingerprints, deal them by set length (sets of too
different lengths never meet), take candidates from shared signatures in prefixes ordered by
rarity and verify the exact coefficient. ``near_pairs`` gives every pair; ``near_classes`` compares
the members of a prefix's signature with the shortest of them, and only those that are not alike
to it with all the others, so a group of near copies leaves as a star.

Nulls are empty texts; equal texts, repeated rows among them, have equal fingerprints; two empty
texts are alike (1). Very long texts are read whole. Rows of one doc_id (ties) follow each other
in any order, null ids first. An empty table has no rows. Only doc_id and text are read, so other
columns may have any name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import stored
from ..operators.components import components
from ._common import partitions, settled

#: Common words of English, French, German and Spanish that start a spot.
ANCHORS = (
    "the is was are that with for "
    "le les est un une dans pour "
    "der die das ist und nicht mit "
    "el los es una por con para"
).split()
#: Further common words, which never are content words.
COMMON = (
    "a an and as at be but by from had has have he her his i in it its not of on or she so they this to we were which who will you "
    "au aux avec ce ces de des du en et il elle je la mais ne nous ou par pas plus que qui se ses son sur vous "
    "als am an auch auf aus bei dem den des dass ein eine einen einer er es für hat ich ihr im in sich sie sind so von vor war wie wir zu zum zur "
    "al como de del e ella en ese esta este ha la las le lo más mi no o pero que se si sin su sus te y yo"
).split()
CHAIN = 2


#: Marks an anchor in the line of words that the patterns below read; no word holds it.
_MARK = "\x01"
_GAP, _CONTENT = f"(?:{_MARK}[^ ]+ )", f"[^ {_MARK}]+ "
#: A run of anchors; its group, empty if the text ends before, goes on to the ``CHAIN``-th content word. A word is read ``CHAIN + 1`` times at most.
_RUN = f"(?:(?=({_GAP}++{_CONTENT}" + f"{_GAP}*+{_CONTENT}" * (CHAIN - 1) + f"))|){_GAP}++"


def let(value: Column, then) -> Column:
    """``then`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def signatures(text: Column) -> Column:
    """The sorted set of a text's signature hashes (array of longs)."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return let(words, _of_words)


def _of_words(words: Column) -> Column:
    others = [w for w in COMMON if w not in ANCHORS]
    marked = F.transform(words, lambda w: F.when(w.isin(ANCHORS), F.concat(F.lit(_MARK), w)).when(~w.isin(others), w))
    line = F.concat(F.array_join(marked, " "), F.lit(" "))  # nulls, the other common words, are left out
    runs = F.filter(F.regexp_extract_all(line, F.lit(_RUN), F.lit(1)), lambda r: r != "")
    rest = F.greatest(F.size(words) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(words, F.lit(1), rest), F.slice(words, F.lit(2), rest), lambda a, b: F.xxhash64(F.concat_ws(" ", a, b)))
    single = F.array(F.xxhash64(F.array_join(words, " ")))
    found = let(runs, lambda own: F.when(F.size(own) > 0, F.flatten(F.transform(own, _of_run))).when(rest > 0, pairs).otherwise(single))
    return F.sort_array(F.array_distinct(found))


def _of_run(run: Column) -> Column:
    """Anchors in a row and the content words after them -> a hash for each different anchor before them."""
    chain = F.rtrim(F.regexp_replace(run, _GAP, ""))
    lead = F.translate(F.regexp_extract(run, f"^{_GAP}++", 0), _MARK, "")
    anchors = F.array_distinct(F.split(F.rtrim(lead), " "))
    return F.transform(anchors, lambda a: F.xxhash64(F.concat_ws(" ", a, chain)))


def printed(signs: Column) -> Column:
    return F.array_join(F.transform(signs, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), " ")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard coefficient of two sets of signatures."""
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def with_next(docs: DataFrame, columns: list[str], derived: dict[str, Column] | None = None) -> DataFrame:
    """``docs``, the ``derived`` columns and ``next_<column>``: the row that follows in ascending doc_id (after the last: the first).

    Rows are dealt into buckets between quantiles of doc_id, whose number follows the session's
    partitions; each bucket also gets a copy of the first row of the one after it, so no task
    sees more than its bucket. Among equal ids the order is any; nulls come first.
    """
    levels = max(1, math.ceil(math.log2(4 * partitions(docs))))
    count = (1 << levels) - 1
    id_ = F.col("doc_id").cast("bigint")
    cuts = docs.agg(F.percentile_approx(id_, [(k + 1) / (count + 1) for k in range(count)], 100 * (count + 1))).first()[0]
    if cuts is None:  # no row, or no id at all
        bucket = F.lit(0)
    else:
        bounds = F.array(*[F.lit(c).cast("bigint") for c in cuts])
        # binary search: how many cuts are at most the id
        steps = F.array(*[F.lit(1 << k) for k in reversed(range(levels))])
        bucket = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.coalesce(F.element_at(bounds, at + step) <= id_, F.lit(False)), at + step).otherwise(at))
    firsts = docs.groupBy(bucket.alias("_bucket")).agg(F.min_by(F.struct("doc_id"), F.coalesce(id_, F.lit(-(1 << 63)))).alias("_id"))
    order = Window.orderBy("_bucket")  # at most one row a bucket
    ahead = firsts.select("_bucket", F.coalesce(F.lead("_id").over(order), F.first("_id").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("_id"))
    ahead = ahead.select(F.col("_id.doc_id").alias("_first"), F.col("_bucket").alias("_to"))
    # at most ``count`` + 1 pairs of numbers
    copies = docs.join(F.broadcast(ahead), F.col("doc_id").eqNullSafe(F.col("_first")))
    copies = copies.select(*docs.columns, F.col("_to").alias("_bucket"), F.lit(1).alias("_copy"))
    dealt = docs.select("*", bucket.alias("_bucket"), F.lit(0).alias("_copy")).unionByName(copies)
    # derived here, once a row: above the join that finds the copies it would be done twice
    dealt = dealt.withColumns(derived or {})
    order = Window.partitionBy("_bucket").orderBy("_copy", "doc_id")
    return dealt.withColumns({f"next_{c}": F.lead(c).over(order) for c in columns}).filter("_copy = 0").drop("_bucket", "_copy")


def op3(docs: DataFrame) -> DataFrame:
    """The contract's rows."""
    text = F.coalesce("text", F.lit(""))
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"))
    both = with_next(own, ["text", "signs"], {"signs": signatures(F.col("text"))})
    size = F.length("text")
    cut = F.floor(size / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), size - cut), F.substring("next_text", F.lit(1), cut))
    both = both.select("doc_id", size.cast("bigint").alias("n_chars"), edited.alias("edited"), "signs", "next_signs")
    both = both.select("*", signatures(F.col("edited")).alias("edited_signs"))
    return both.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        printed(F.col("signs")).alias("fingerprint"), printed(F.col("edited_signs")).alias("edited_fingerprint"),
        likeness(F.col("signs"), F.col("edited_signs")).alias("near_edited"), likeness(F.col("signs"), F.col("next_signs")).alias("near_next"),
    )


#: Signatures are ordered by how often those of their share of the hash space occur; so many shares.
SHARES = 1 << 16


def _prefixes(classes: DataFrame, threshold: float) -> DataFrame:
    """(k, n, s): of each class the signatures among which two sets that reach the threshold share one.

    Any one order of all signatures serves; counts by share of the hash space, a fixed number of them,
    put frequent ones last. Sets that are too short to be alike to another one have no row.
    """
    share = lambda s: s.bitwiseAND(F.lit(SHARES - 1)).cast("int")
    counts = classes.select(F.explode("signs").alias("s")).groupBy(share(F.col("s")).alias("share")).agg(F.count(F.lit(1)).alias("d")).collect()  # SHARES rows at most
    spread = [0] * SHARES
    for r in counts:
        spread[r.share] = r.d
    often = F.split(F.lit(",".join(map(str, spread))), ",").cast("array<bigint>")  # folded into one constant
    by = F.sort_array(F.transform("signs", lambda s: F.struct(F.get(often, share(s)).alias("d"), s.alias("s"))))
    sized = classes.select("k", F.size("signs").alias("n"), by.alias("by")).filter(F.col("n") >= math.floor(threshold / (1 - threshold) + 1e-9))
    prefix = F.slice("by", F.lit(1), F.col("n") - F.ceil(F.col("n") * threshold - 1e-9).cast("int") + 1)
    return sized.select("k", "n", F.explode(prefix).alias("p")).select("k", "n", F.col("p.s").alias("s"))


def _band(n: Column, threshold: float) -> Column:
    """Lengths within the threshold lie in one band or in neighbouring ones."""
    return F.floor(F.log(n.cast("double")) / math.log(1 / threshold)).cast("int")


def near_classes(signed: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(k, near_class) from (doc_id, signs): of each different set (k, its hash) the least doc_id that links reach.

    A link joins two sets whose coefficient is ``threshold`` or more. In a bucket (a signature of the
    prefix and a length band) the shortest set leads; sets that are alike to it leave with one link,
    and each of the others is compared with all of the bucket, so no link is lost.
    """
    classes = signed.groupBy(F.xxhash64("signs").alias("k")).agg(F.min("doc_id").alias("id"), F.first("signs").alias("signs"))
    classes = stored(classes, "spot-classes")
    signs = classes.select("k", "signs")
    band = _band(F.col("n"), threshold)
    rare = _prefixes(classes, threshold).select("k", "n", "s", F.explode(F.array(band, band + 1)).alias("band"))
    rare = stored(rare, "spot-prefixes")
    lead = rare.groupBy("s", "band").agg(F.min(F.struct("n", "k")).alias("lead"), F.count(F.lit(1)).alias("members")).filter("members > 1")
    led = rare.join(lead, ["s", "band"]).select("s", "band", "k", "n", F.col("lead.k").alias("to"), F.col("lead.n").alias("to_n")).filter(F.col("k") != F.col("to"))
    led = stored(led, "spot-led")

    def alike(pairs: DataFrame) -> DataFrame:
        """(k, to) of the pairs that reach the threshold; lengths that differ too much are left out first."""
        fits = pairs.filter(F.least("n", "to_n") >= F.greatest("n", "to_n") * threshold - 1e-9).select("k", "to").distinct()
        met = fits.join(signs, "k").join(signs.select(F.col("k").alias("to"), F.col("signs").alias("other")), "to")
        return met.filter(likeness(F.col("signs"), F.col("other")) >= threshold - 1e-12).select("k", "to")

    first = stored(alike(led), "spot-stars")
    open_ = led.join(first, ["k", "to"], "left_anti").select("s", "band", "k", "n")
    others = rare.select("s", "band", F.col("k").alias("to"), F.col("n").alias("to_n"))
    settled(signed.sparkSession)
    second = alike(open_.join(others, ["s", "band"]).filter(F.col("k") != F.col("to")).select(F.least("k", "to").alias("k"), F.greatest("k", "to").alias("to"), "n", "to_n"))
    roots = components(first.unionByName(second).select(F.col("k").alias("u"), F.col("to").alias("v")))
    rooted = classes.select("k", "id").join(roots, F.col("k") == F.col("node"), "left").withColumn("root", F.coalesce("root", "k"))
    least = rooted.groupBy("root").agg(F.min("id").alias("near_class"))
    return rooted.select("k", "root").join(least, "root").select("k", "near_class")


def near_pairs(docs: DataFrame, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(membership, pairs): doc_id -> class of equal fingerprints (its least doc_id), and pairs of classes
    (a < b) whose coefficient is ``threshold`` or more.

    Sets of length n are compared with lengths n to n / threshold only; two sets that reach the
    threshold share a signature among the n - ceil(threshold n) + 1 rarest of each.
    """
    own = stored(docs.select("doc_id", signatures(F.coalesce("text", F.lit(""))).alias("signs")), "spots")
    classes = stored(own.groupBy("signs").agg(F.min("doc_id").alias("class")), "spot-classes")
    membership = own.join(classes, "signs").select("doc_id", "class")
    rare = _prefixes(classes.withColumnRenamed("class", "k"), threshold).withColumnRenamed("k", "class")
    band = _band(F.col("n"), threshold)
    left = rare.select(F.col("class").alias("a"), F.col("n").alias("na"), "s", F.explode(F.array(band, band + 1)).alias("band"))
    right = rare.select(F.col("class").alias("b"), F.col("n").alias("nb"), "s", band.alias("band"))
    fits = (F.col("na") <= F.col("nb")) & (F.col("na") >= F.col("nb") * threshold - 1e-9) & ((F.col("na") < F.col("nb")) | (F.col("a") < F.col("b")))
    met = left.join(right, ["s", "band"]).filter(fits).select("a", "b").distinct()
    signs = classes.select("class", "signs")
    met = met.join(signs.select(F.col("class").alias("a"), F.col("signs").alias("sa")), "a").join(signs.select(F.col("class").alias("b"), F.col("signs").alias("sb")), "b")
    near = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), likeness(F.col("sa"), F.col("sb")).alias("likeness"))
    return membership, near.filter(F.col("likeness") >= threshold - 1e-12)
