"""Near copies by the Jaccard similarity of 5-word shingles.

A document is the set of its case-folded 5-word shingles, hashed; equal sets are one class.
Minima of ``BANDS * ROWS`` permutations, ``ROWS`` to a key, make pairs that share a key
candidates: at the similarity of 0.8 all keys differ once in 14,000 pairs, above it less.
Every candidate is then verified on the whole sets, so that no link is a guess.

Keys held by more than ``SMALL`` sets don't give all pairs. A few members, the centres, are compared
with the others that share a second key with them; this joins most of a family in a few links. What
is in different components after that is compared by prefixes: the shingles of each set are ordered
by rarity, sets that are similar enough share one of the first fifth, and sizes and positions bound
how much they can have in common. This leaves out no link between two components, and members of
one component are not compared again.

Defined cases: texts of fewer words than a shingle have one shingle; texts without words and
rows without id link to nothing; repeated rows fall into one class.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import maybe_in, pieces, stage
from .components import components
from .passages import Texts, rolling, scrambled

SHINGLE = 5
#: Similarity of at least FOUR fifths, in whole numbers.
OVER, UNDER = 4, 5
BANDS, ROWS = 24, 5
#: A key of more sets than this is searched from centres, up to these places in each round.
SMALL = 32
CENTRES = (2, 6, 14)
#: Prefix rows of one shingle that meet in one join key.
SHARE = 512
PIECE_BYTES = 1 << 20
U = np.uint64
FACTORS = np.random.default_rng(42).integers(0, 1 << 63, BANDS * ROWS, U) * U(2) + U(1)


def shingle_sets(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of all texts, text by text, and their number in each text."""
    texts = Texts(pc.ascii_lower(column))
    words = texts.words.hashes(0)
    at, row = texts.windows(size)
    short = np.flatnonzero((texts.count > 0) & (texts.count < size))
    whole = [rolling(words[texts.first[k]:texts.first[k] + texts.count[k]], int(texts.count[k]), 0) for k in short]
    value = np.concatenate([rolling(words, size, 0)[at], *whole])
    row = np.concatenate([row, short])
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    new = np.concatenate([[True], (value[1:] != value[:-1]) | (row[1:] != row[:-1])])[:len(value)]
    return value[new], np.bincount(row[new], minlength=len(column))


def set_ids(value: np.ndarray, begin: np.ndarray) -> np.ndarray:
    return scrambled(np.add.reduceat(scrambled(value ^ U(0x9E3779B97F4A7C15)), begin))


def band_keys(value: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """One row of keys for each set."""
    out = np.empty((len(begin), BANDS), U)
    for band in range(BANDS):
        key = np.full(len(begin), band, U)
        for factor in FACTORS[band * ROWS:(band + 1) * ROWS]:
            key = scrambled(key * U(0x9DDFEA08EB382D69) + np.minimum.reduceat(value * factor, begin))
        out[:, band] = key
    return out


def lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(values.view(np.int64)))


def sets_of(docs: DataFrame, size: int, whole: bool) -> DataFrame:
    """doc_id, set_id, n and either the keys or the ``whole`` set, of documents that have words."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", PIECE_BYTES):
                value, count = shingle_sets(part.column("text"), size)
                some = np.flatnonzero(count)
                if not len(some):
                    continue
                n = count[some]
                begin = np.cumsum(n) - n
                held = lists(value, n) if whole else lists(band_keys(value, begin).ravel(), np.full(len(n), BANDS))
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(some)), pa.array(set_ids(value, begin).view(np.int64)), pa.array(n, pa.int64()), held], ["doc_id", "set_id", "n", "held"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    return docs.mapInArrow(rows, "doc_id long, set_id long, n long, held array<long>")


def similar_enough(common: Column, a: Column, b: Column) -> Column:
    return UNDER * common >= OVER * (a + b - common)


def shared_keys(classes: DataFrame, small: int) -> tuple[DataFrame, DataFrame]:
    """Members (key, s) of keys that few sets share, and (key, s, held) of those that many do."""
    keyed = classes.select(F.explode("held").alias("key"), F.struct("set_id", "n").alias("s"))
    shared = stage(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("held_by")).where("held_by > 1"), "shared-keys")
    members = stage(maybe_in(keyed, keyed["key"], shared, shared["key"]).join(shared, "key"), "key-members")
    many = members.where(F.col("held_by") > small).select("key", "s", F.col("s.set_id").alias("set_id"))
    many = stage(many.join(classes.select("set_id", "held"), "set_id").select("key", "s", "held"), "large-keys")
    return members.where(F.col("held_by") <= small).select("key", "s"), many


def in_order(pairs: DataFrame) -> DataFrame:
    """Different pairs (a, b) of the sets x and y whose sizes allow the similarity, a < b."""
    pairs = pairs.where(similar_enough(F.least("x.n", "y.n"), F.col("x.n"), F.col("y.n")) & (F.col("x.set_id") != F.col("y.set_id")))
    return pairs.select(F.least("x.set_id", "y.set_id").alias("a"), F.greatest("x.set_id", "y.set_id").alias("b")).distinct()


def few_pairs(members: DataFrame) -> DataFrame:
    few = members.groupBy("key").agg(F.collect_set("s").alias("all"))
    pairs = few.select("all", F.explode("all").alias("x")).select("x", F.explode("all").alias("y"))
    return in_order(pairs.where("x.set_id < y.set_id"))


Check = Callable[[DataFrame], DataFrame]


def ends(links: DataFrame) -> DataFrame:
    return links.select(F.col("a").alias("set_id")).union(links.select(F.col("b").alias("set_id"))).distinct()


def centre_links(many: DataFrame, links: DataFrame, verified: Check, centres: Sequence[int]) -> DataFrame:
    """``links`` (a, b) and those that the centres of large keys find.

    The first centres ask all members, so that what smaller keys link is joined as well; each
    later round has fresh centres and asks the members without any link.
    """
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.xxhash64("s.set_id"), "s.set_id"))
    ranked = many.withColumn("place", place).where(F.col("place") <= centres[-1])
    middle = stage(ranked.select("key", "place", F.col("s").alias("y"), F.col("held").alias("y_held")), "centres")
    members = many.select("key", F.col("s").alias("x"), "held", F.col("s.set_id").alias("set_id"))
    before = 0
    for last in centres:
        asked = members.join(ends(links), "set_id", "left_anti") if before else members
        pairs = asked.join(middle.where((F.col("place") > before) & (F.col("place") <= last)), "key")
        pairs = stage(in_order(pairs.where(F.size(F.array_intersect("held", "y_held")) > 1)), "centre-pairs")
        links = links.union(stage(verified(pairs), "centre-links"))
        before = last
    return links


def bridging_pairs(sets: DataFrame, links: DataFrame) -> DataFrame:
    """Pairs (a, b) of ``sets`` (set_id, held) in different components of ``links`` that may be similar enough.

    No similar pair is missing. A shingle's most frequent component meets the others only, never itself;
    shingles of many sets are divided into shares.
    """
    label = components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))).select(F.col("u").alias("set_id"), F.col("v").alias("label"))
    tokens = sets.select("set_id", F.explode("held").alias("t"))
    often = tokens.groupBy("t").agg(F.count(F.lit(1)).alias("f"))
    ordered = tokens.join(often, "t").groupBy("set_id").agg(F.sort_array(F.collect_list(F.struct("f", "t"))).alias("all"))
    first = ordered.withColumn("n", F.size("all").cast("long")).withColumn("first", F.expr(f"slice(all, 1, cast(n - ({OVER} * n + {UNDER - 1}) div {UNDER} + 1 as int))"))
    heads = first.join(label, "set_id", "left").select("set_id", F.coalesce("label", "set_id").alias("label"), "n", F.posexplode("first").alias("p", "x"))
    heads = stage(heads.where("x.f > 1").select("set_id", "label", "n", "p", "x.t", "x.f"), "prefixes")
    main = heads.groupBy("t", "label").agg(F.count(F.lit(1)).alias("c")).groupBy("t").agg(F.max_by("label", F.struct("c", "label")).alias("main"), F.count(F.lit(1)).alias("labels"))
    heads = stage(heads.join(main.where("labels > 1").drop("labels"), "t").withColumn("shares", F.ceil(F.col("f") / SHARE)), "mixed-prefixes")
    row = F.struct("set_id", "label", "n", "p")
    others = heads.where("label <> main").select("t", row.alias("x"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)).alias("share"))
    all_of = heads.select("t", row.alias("y"), F.pmod(F.xxhash64("set_id"), "shares").alias("share"))
    total = OVER + UNDER
    fits = F.expr(f"x.label <> y.label and least(x.n - x.p, y.n - y.p) >= ({OVER} * (x.n + y.n) + {total - 1}) div {total}")
    return in_order(others.join(all_of, ["t", "share"]).where(fits))


def similar_links(docs: DataFrame, also: DataFrame | None = None, size: int = SHINGLE, small: int = SMALL, centres: Sequence[int] = CENTRES) -> DataFrame:
    """Links (u, v) between documents, by doc_id, that connect what is similar enough.

    ``also`` has further candidates (u, v), verified like the others.
    """
    table = stage(sets_of(docs, size, False), "sets")
    classes = stage(table.groupBy("set_id").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("copies"), F.any_value("n").alias("n"), F.any_value("held").alias("held")), "set-classes")
    few, many = shared_keys(classes, small)
    pairs = few_pairs(few)
    if also is not None:
        ids = table.select("doc_id", "set_id").distinct()
        x, y = ids.select(F.col("doc_id").alias("u"), F.col("set_id").alias("x")), ids.select(F.col("doc_id").alias("v"), F.col("set_id").alias("y"))
        more = also.join(x, "u").join(y, "v").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        pairs = pairs.union(more).distinct()
    pairs = stage(pairs, "candidates")
    ids = ends(pairs).union(many.select("s.set_id")).distinct()
    wanted = stage(ids.join(classes.select("set_id", "class_id"), "set_id"), "wanted")
    # the sets of candidates only; the document that stands for a class may share its id with others
    whole = sets_of(maybe_in(docs, docs["doc_id"].cast("long"), wanted, wanted["class_id"]), size, True)
    sets = stage(whole.join(wanted, "set_id").where("doc_id = class_id").groupBy("set_id").agg(F.any_value("held").alias("held")), "candidate-sets")

    def verified(some: DataFrame) -> DataFrame:
        both = some.join(sets.select(F.col("set_id").alias("a"), F.col("held").alias("x")), "a").join(sets.select(F.col("set_id").alias("b"), F.col("held").alias("y")), "b")
        return both.where(similar_enough(F.size(F.array_intersect("x", "y")), F.size("x"), F.size("y"))).select("a", "b")

    close = stage(verified(pairs), "close")
    if not many.isEmpty():
        close = centre_links(many, close, verified, centres)
        crowd = sets.join(many.select("s.set_id").distinct(), "set_id")
        close = close.union(stage(verified(stage(bridging_pairs(crowd, close), "bridging-pairs")), "bridges"))
    names = wanted.select("set_id", "class_id")
    close = close.join(names.withColumnsRenamed({"set_id": "a", "class_id": "u"}), "a").join(names.withColumnsRenamed({"set_id": "b", "class_id": "v"}), "b").select("u", "v")
    same = classes.where("copies > 1").select("set_id", "class_id")
    copies = table.select("doc_id", "set_id").join(same, "set_id").select(F.col("doc_id").alias("u"), F.col("class_id").alias("v"))
    return close.union(copies).where("u <> v")
