"""N-gram Jaccard join by vertical partitioning.

The n-grams of all documents have one global order. Documents are sets of 64-bit n-gram hashes; sets that
are equal are one class, whose id is a hash of the set. The join finds every pair of classes whose Jaccard
similarity reaches the threshold, in three passes:

1. *Prefixes.* A pair with similarity t shares at least l(n) n-grams within the first n - ceil(t n) + l'(n)
   of each set in the global order (here l(n) = n/25, l'(n) = n/20; with partners of at most n/t n-grams
   l' covers the partner's l). Prefix n-grams are counted over the corpus; a class with fewer than l(n)
   repeated ones has no partner and leaves. This is exact and moves a quarter of the n-grams once.
2. *Rarity.* For the classes left, all n-grams are counted; a class needs ceil(t n) repeated ones. Of those
   the rarest m - ceil(t n) + 1 must hold one that a partner shares: these are the postings.
3. *Vertical verification.* The global order is cut into fragments; each candidate pair's overlap is counted
   in every fragment by itself and summed for the pair.

Candidates of a posting list never become all its pairs: each member meets a few pivots of its list first, those
that consist most of what the list's documents share; verified links are contracted to components. Afterwards only
members of different components are compared, inside the join, by size and by parity signatures: the
signatures' Hamming distance is a lower bound of the sets' symmetric difference, so a pair beyond the
allowed difference is never emitted, and none within it is lost. What remains is verified.

Hot keys: counts are combined before the shuffle; the joins on n-grams are sort-merge joins that adaptive execution
splits when one key is hot; classes in very many pairs are salted where pairs meet their n-grams, and long lists are
cut into a grid of cells on both sides where their members meet each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components, join_split
from .memory import lean
from .scratch import drop_spent_shuffles, materialise, only_result
from .words import PLACES, SPACED, mix, shingles, split_words, text_batches

#: Parts of the global order in which overlaps are counted by themselves.
FRAGMENTS = 4
#: Pivots that every member of a posting list meets.
PIVOTS = 2
#: Classes whose ids are broadcast to pick their texts; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: 64-bit words of a parity signature.
SIGNATURE = 8
#: A class in more than this share of all pairs is heavy, and its n-grams are copied so often.
HEAVY, SALTS = 1024, 32
#: Members of a list that meet the others in one cell.
CELL = 1024

_SIGNATURE = [f"s{i}" for i in range(SIGNATURE)]



def _sets(texts: list[bytes | None], n: int) -> Iterator[np.ndarray]:
    words = split_words(texts, SPACED)
    first, hashes = shingles(words, n)
    at = np.searchsorted(words.doc[first], np.arange(len(texts) + 1))
    bounds = words.bounds()
    hashes = hashes.view(np.int64)
    for k in range(len(texts)):
        have = bounds[k + 1] - bounds[k]
        if have >= n:
            yield np.unique(hashes[at[k] : at[k + 1]])
        elif have:
            own = words.hash[bounds[k] : bounds[k + 1]]
            yield mix(np.sum(own * PLACES[n : n + have], keepdims=True, dtype=np.uint64)).view(np.int64)
        else:
            yield np.empty(0, np.int64)


def _class_id(grams: np.ndarray) -> int | None:
    if not len(grams):
        return None
    g = grams.view(np.uint64)
    return int(mix(np.array([np.sum(mix(g + np.uint64(len(g))), dtype=np.uint64)])).view(np.int64)[0])


def needed(n: int, percent: int) -> int:
    """Least overlap of a set of n with any partner: ceil(percent n / 100)."""
    return -(-percent * n // 100)


def _prefix_length(n: int, percent: int) -> int:
    return min(n, n - needed(n, percent) + max(1, n // 20))


def _lists(values: list[np.ndarray]) -> pa.Array:
    sizes = np.cumsum([0, *map(len, values)])
    flat = np.concatenate([*values, np.empty(0, np.int64)]) if values else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(flat, pa.int64()))


def _scan(id_type: pa.DataType, n: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for lo, texts in text_batches(batch):
                ids, sizes, prefixes = [], [], []
                for grams in _sets(texts, n):
                    ids.append(c := _class_id(grams))
                    sizes.append(len(grams))
                    if c is None or c in seen:  # a copy within this task adds nothing to the counts but its own class
                        prefixes.append(grams[:0])
                    else:
                        seen.add(c)
                        prefixes.append(grams[: _prefix_length(len(grams), percent)])
                if len(seen) > 1_000_000:
                    seen.clear()  # only saves work: nothing depends on it
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, len(texts)).cast(id_type), batch.column(2).slice(lo, len(texts)), pa.array(sizes, pa.int64()), pa.array(ids, pa.int64()), _lists(prefixes)],
                    ["doc_id", "text_hash", "n_shingles", "class", "prefix"],
                )

    return run


def signature(grams: np.ndarray) -> np.ndarray:
    """Parity of the number of n-grams at each place: sets that differ in d n-grams differ in d places at most."""
    place = (mix(grams.view(np.uint64)) >> np.uint64(32)).astype(np.int64) % (64 * SIGNATURE)
    return np.packbits((np.bincount(place, minlength=64 * SIGNATURE) & 1).astype(bool)).view(np.int64)


def _full(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in text_batches(batch):
                sets = list(_sets(texts, n))
                marks = np.array([signature(grams) for grams in sets], np.int64).reshape(-1, SIGNATURE)
                yield pa.RecordBatch.from_arrays([pa.array([_class_id(g) for g in sets], pa.int64()), _lists(sets), *(pa.array(m) for m in marks.T.copy())], ["class", "grams", *_SIGNATURE])

    return run


def _meet(pairs: DataFrame, parts: DataFrame, side: str, total: int) -> DataFrame:
    """pairs with the n-grams of one side by fragment; heavy classes, at most HEAVY, are salted by the other side."""
    other, grams = ("b", "ga") if side == "a" else ("a", "gb")
    named = parts.select(F.col("class").alias(side), "fragment", F.col("grams").alias(grams))
    heavy = F.broadcast(pairs.groupBy(side, *({"fragment"} & {*pairs.columns})).count().filter(F.col("count") > max(1, total // HEAVY)).select(F.col(side).alias("hot")).distinct())
    salt = F.when(F.col("hot").isNotNull(), F.pmod(F.xxhash64(other), F.lit(SALTS))).otherwise(0).cast("int").alias("salt")
    rows = pairs.join(heavy, F.col(side) == F.col("hot"), "left").select(*pairs.columns, salt)
    copies = F.explode(F.when(F.col("hot").isNotNull(), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("salt")
    held = named.join(heavy, F.col(side) == F.col("hot"), "left").select(side, "fragment", grams, copies)
    return rows.join(held, [side, "salt", *({"fragment"} & {*pairs.columns})]).drop("salt")


def _linked(pairs: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """Of (a, b, na, nb) pairs those that reach the threshold: overlaps counted in each fragment and summed."""
    pairs = materialise(pairs, "pairs")
    total = pairs.count()
    met = _meet(_meet(pairs, parts, "b", total), parts, "a", total)
    counted = met.select("a", "b", "na", "nb", F.size(F.array_intersect("ga", "gb")).alias("k"))
    summed = counted.groupBy("a", "b", "na", "nb").agg(F.sum("k").alias("k"))
    return summed.filter(F.col("k") * 100 >= (F.col("na") + F.col("nb") - F.col("k")) * percent).select("a", "b")


def _in_reach(percent: int):
    return (F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent) & (F.col("a") != F.col("b"))


def _survivors(scan: DataFrame, percent: int) -> DataFrame:
    """Pass 1: the (doc_id, text_hash) of one document for each class that may have a partner."""
    postings = scan.select("class", F.explode("prefix").alias("gram"))
    repeated = postings.groupBy("gram").agg(F.count("*").alias("c")).filter("c > 1").select("gram")
    hits = postings.join(repeated, "gram").groupBy("class").agg(F.count("*").alias("hits"))
    classes = scan.filter("class is not null").groupBy("class", "n_shingles").agg(F.min(F.struct("doc_id", "text_hash")).alias("of"))
    enough = classes.join(hits, "class").filter(F.col("hits") >= F.greatest(F.lit(1), F.floor(F.col("n_shingles") / 25)))
    return materialise(enough.select("class", "of.doc_id", "of.text_hash"), "survivors")


def _grams_of(docs: DataFrame, chosen: DataFrame, n: int) -> DataFrame:
    """The whole sets of the chosen classes."""
    chosen_docs = chosen.select(F.col("doc_id").alias("c_id"), F.col("text_hash").alias("c_hash")).distinct()
    if chosen.count() <= BROADCAST_ROWS:
        chosen_docs = F.broadcast(chosen_docs)
    picked = docs.join(chosen_docs, F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("text_hash") == F.col("c_hash")), "left_semi")
    sets = materialise(picked.select("doc_id", "text", "text_hash").mapInArrow(lean(_full(n)), "class long, grams array<long>, " + ", ".join(f"{c} long" for c in _SIGNATURE)), "sets")
    counted = sets.agg(F.count("class"), F.countDistinct("class")).first()
    return sets if counted[0] == counted[1] else materialise(sets.dropDuplicates(["class"]), "sets")


def _postings(sets: DataFrame, percent: int) -> DataFrame:
    """Pass 2: (class, n, shared, gram) of the rarest repeated n-grams, enough to meet every partner in one.

    shared: the share of the set, in 1/10000, that is repeated in the corpus.
    """
    grams = sets.select("class", F.explode("grams").alias("gram"))
    counts = grams.groupBy("gram").agg(F.count("*").alias("c")).filter("c > 1")
    rare = grams.join(counts, "gram").groupBy("class").agg(F.array_sort(F.collect_list(F.struct("c", "gram"))).alias("list"))
    need = F.ceil(F.col("n") * percent / 100)
    kept = rare.join(sets.select("class", F.size("grams").cast("long").alias("n")), "class").filter(F.size("list") >= need)
    rarest = F.slice("list", F.lit(1), (F.size("list") - need + 1).cast("int"))
    shared = F.floor(F.size("list") * 10000 / F.col("n"))
    return materialise(kept.select("class", "n", shared.alias("shared"), F.explode(rarest).alias("p")).select("class", "n", "shared", "p.gram"), "postings")


def _between(lo: int, hi: int, last: bool):
    return lambda g: (g >= F.lit(lo)) & ((g <= F.lit(hi)) if last else (g < F.lit(hi)))


def _parts(sets: DataFrame, postings: DataFrame) -> DataFrame:
    """(class, fragment, grams) of the classes in the postings: the global order cut into ranges."""
    wanted = sets.join(postings.select("class").distinct(), "class", "left_semi")
    width = 2**64 // FRAGMENTS
    cuts = [-(2**63) + i * width for i in range(FRAGMENTS)] + [2**63 - 1]
    cut = [F.struct(F.lit(i).alias("fragment"), F.filter("grams", _between(cuts[i], cuts[i + 1], i + 1 == FRAGMENTS)).alias("grams")) for i in range(FRAGMENTS)]
    return materialise(wanted.select("class", F.explode(F.array(*cut)).alias("f")).select("class", "f.fragment", "f.grams").filter(F.size("grams") > 0), "fragments")


def _pivot_pairs(postings: DataFrame) -> DataFrame:
    """Each member of a posting list with the list's pivots; pivots follow one order for all lists."""
    order = [F.struct(-F.col("shared"), F.xxhash64("class", F.lit(k))) for k in range(PIVOTS)]
    pivots = postings.groupBy("gram").agg(F.count("*").alias("c"), *(F.min(F.struct(o.alias("o"), F.col("class"), F.col("n"))).alias(f"p{k}") for k, o in enumerate(order))).filter("c > 1")
    each = F.explode(F.array(*(F.struct(F.col(f"p{k}.class").alias("a"), F.col(f"p{k}.n").alias("na")) for k in range(PIVOTS)))).alias("p")
    pairs = join_split(postings, pivots.withColumnRenamed("c", "d"), "gram", postings.count()).select(F.col("class").alias("b"), F.col("n").alias("nb"), each)
    return pairs.select(F.col("p.a").alias("a"), "b", F.col("p.na").alias("na"), "nb")


def _cross_pairs(postings: DataFrame, sets: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """Pairs of one posting list, of different components so far, whose sizes and signatures allow a link."""
    level = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.25))).cast("int")
    tagged = postings.join(roots, F.col("class") == F.col("node"), "left").select("gram", "class", "n", F.coalesce("root", "class").alias("comp"), level.alias("level"))
    tagged = materialise(tagged, "tagged")
    # lists of one component have no such pair
    members = tagged.groupBy("gram").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("m")).filter("lo <> hi")
    mixed = members.select("gram", F.ceil(F.col("m") / CELL).cast("int").alias("cells"), F.col("m").alias("d"))
    marks = sets.select("class", *_SIGNATURE)
    tagged = materialise(join_split(tagged, mixed, "gram", tagged.count()).join(marks, "class"), "mixed")
    own, each = F.pmod(F.xxhash64("class"), F.col("cells")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("cells") - 1))
    left, right = tagged.withColumn("row", own).withColumn("column", each), tagged.withColumn("column", own).withColumn("row", each)
    # sizes within 5 : 4 are at most one level apart; rounding of the logarithm can make it two
    names = {"class": "a", "n": "na", "comp": "ca"} | {c: f"a{c}" for c in _SIGNATURE}
    cell = ("gram", "row", "column")
    left = left.select(*cell, "level", *(F.col(c).alias(to) for c, to in names.items()))
    names = {"class": "b", "n": "nb", "comp": "cb", "level": "lb"} | {c: f"b{c}" for c in _SIGNATURE}
    right = right.select(*cell, *(F.col(c).alias(to) for c, to in names.items()), F.explode(F.array(*(F.col("level") + k for k in range(3)))).alias("level"))
    differ = sum((F.bit_count(F.col(f"a{c}").bitwiseXOR(F.col(f"b{c}"))) for c in _SIGNATURE), F.lit(0))
    allowed = differ * (100 + percent) <= (F.col("na") + F.col("nb")) * (100 - percent)
    l, r = left.alias("l"), right.alias("r")
    on = (F.col("l.gram") == F.col("r.gram")) & (F.col("l.row") == F.col("r.row")) & (F.col("l.column") == F.col("r.column")) & (F.col("l.level") == F.col("r.level")) & (F.col("ca") != F.col("cb")) & _in_reach(percent) & allowed
    met = l.join(r, on & ((F.col("l.level") > F.col("lb")) | (F.col("a") > F.col("b"))))
    return met.select("a", "b", "na", "nb")


def _distinct_pairs(pairs: DataFrame, percent: int) -> DataFrame:
    near = pairs.filter(_in_reach(percent))
    swap = F.col("a") > F.col("b")
    return near.select(
        F.when(swap, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("b"),
        F.when(swap, F.col("nb")).otherwise(F.col("na")).alias("na"), F.when(swap, F.col("na")).otherwise(F.col("nb")).alias("nb"),
    ).distinct()


@only_result
def jaccard_components(docs: DataFrame, *, n: int = 5, percent: int = 80) -> DataFrame:
    """Group documents whose n-gram sets are linked by Jaccard similarity of at least percent/100.

    docs: doc_id and text; further columns are ignored, whatever their names. Returns one row for each row of
    docs: doc_id, n_shingles (size of its set), class (id of its set; null without words), component_id
    (smallest doc_id reachable by links, its own included).

    Null and empty texts have the empty set and are linked with nothing. A text with fewer than n words is
    its whole word sequence as one n-gram. Repeated rows are documents of one class. A null doc_id is kept
    as a row, and never becomes a component_id unless all ids of the component are null.
    """
    if not 80 <= percent <= 100:
        raise ValueError("the prefix bounds hold for 80 to 100 percent")
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    id_type = docs.schema["doc_id"].dataType
    schema = f"doc_id {id_type.simpleString()}, text_hash long, n_shingles long, class long, prefix array<long>"
    from pyspark.sql.pandas.types import to_arrow_type

    scan = materialise(docs.mapInArrow(lean(_scan(to_arrow_type(id_type), n, percent)), schema), "scan")
    drop_spent_shuffles(spark)
    chosen = _survivors(scan, percent)
    drop_spent_shuffles(spark)
    sets = _grams_of(docs, chosen, n)
    drop_spent_shuffles(spark)
    postings = _postings(sets, percent)
    drop_spent_shuffles(spark)
    parts = _parts(sets, postings)
    drop_spent_shuffles(spark)
    links = materialise(_linked(_distinct_pairs(_pivot_pairs(postings), percent), parts, percent), "links")
    drop_spent_shuffles(spark)
    roots = connected_components(links)
    more = materialise(_linked(_distinct_pairs(_cross_pairs(postings, sets, roots, percent), percent), parts, percent), "links")
    drop_spent_shuffles(spark)
    if not more.isEmpty():
        roots = connected_components(links.unionByName(more))
    return _labelled(scan, roots)


def _labelled(scan: DataFrame, roots: DataFrame) -> DataFrame:
    classes = scan.filter("class is not null").groupBy("class").agg(F.min("doc_id").alias("least"))
    rooted = materialise(classes.join(roots, F.col("class") == F.col("node"), "left").select("class", "least", F.coalesce("root", "class").alias("root")), "rooted")
    lowest = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("d"))
    of_class = join_split(rooted, lowest, "root", rooted.count()).select("class", "component_id")
    out = scan.select("doc_id", "n_shingles", "class").join(of_class, "class", "left")
    return out.select("doc_id", "n_shingles", "class", F.coalesce("component_id", "doc_id").alias("component_id"))
