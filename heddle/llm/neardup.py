"""Near-duplicate documents by MinHash.

A text's set is its distinct word shingles. One-permutation hashing takes the least hash in each of `bins` bins; an
empty bin borrows from the first full one in an order of its own (optimal densification). Bands of `rows` bins are
buckets. Texts with equal sets count as one, by the least id. In each bucket the least id is the centre of a star and
only the pairs (centre, member) are candidates, so a bucket of any size has no more pairs than members. Links are
confirmed on the full sets, and their components taken.

A star can miss a link between two members that are unlike the centre, so pairs of members that are still in different
components are looked for, without making all pairs of a bucket. Such a bucket first gets another centre, its hub: of
the component of its member with most links, the document with most links.

If one of the two then lies within FAR of the hub, let A be what a member's set has beyond the hub's set, and D what it lacks
of it. Two members are as alike as asked for only if the symmetric difference of their sets is small, and that is
the one of their (A, D): so they share an element of A, or else A + A' + |D - D'| (sizes) is within the bound. The first
are found by an inverted index of the rarest elements of A (prefix filter), the others by the sizes, which fit few pairs.
If both lie farther: by an inverted index of the rarest elements of the full sets of all such members.

All this only yields candidates, confirmed on the full sets. Hence no link between texts that share a bucket is lost, and
texts as alike as asked for share one but for a chance of about (1 - similarity ** rows) ** (bins / rows).

Null and empty texts, and those without words, have empty sets and are linked with nothing. Ids are of any type with an
order. Rows with one id and text are one document; rows with one id and other texts are documents of their own, and each
has the least id of its component, so that several rows of an id may be kept. Rows with a null id aren't linked: their
component is null and they are kept. An empty table gives no rows. Texts of any length are read whole. Extra columns,
whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mapped, mix, sized, slices, utf8, written
from .words import lowered, shingles

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


#: Jaccard distance up to which a member's set is compared with others' by way of its hub's.
FAR = 0.4


class Sketcher:
    def __init__(self, bins: int, rows: int, seed: int = 5):
        if bins % rows:
            raise ValueError("rows must divide bins")
        self.bins, self.rows = bins, rows
        self.edges = np.array([-(-(b << 32) // bins) << 32 for b in range(bins)], np.uint64)
        rng = np.random.default_rng(seed)
        self.order = np.array([rng.permutation(bins) for _ in range(bins)])

    def signature(self, own: np.ndarray) -> np.ndarray:
        """own: ascending distinct hashes, one at least."""
        at = np.searchsorted(own, self.edges)
        full = at < np.append(at[1:], len(own))
        out = own[np.minimum(at, len(own) - 1)]
        empty = np.flatnonzero(~full)
        if len(empty):
            order = self.order[empty]
            out[empty] = out[order[np.arange(len(empty)), full[order].argmax(1)]]
        return out

    def keys(self, signatures: np.ndarray) -> np.ndarray:
        """A bucket number for each band of each signature."""
        bands = signatures.reshape(len(signatures), -1, self.rows)
        acc = np.broadcast_to(np.arange(bands.shape[1], dtype=np.uint64), bands.shape[:2])
        for r in range(self.rows):
            acc = mix(acc * np.uint64(0xC2B2AE3D27D4EB4F) + bands[:, :, r])
        return acc.view(np.int64)


def sketch(docs: DataFrame, width: int, bins: int, rows: int, id_col: str, text: str) -> DataFrame:
    """doc_id, n_shingles, h1 and h2 (a hash of the set, null if it is empty), keys."""
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("n_shingles", T.LongType()), T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher = Sketcher(bins, rows)
        for batch in slices(batches, "text"):
            data, offsets = utf8(batch.column(1))
            hashes, at = shingles(lowered(data), offsets, width)
            n = batch.num_rows
            counts, sums = np.zeros(n, np.int64), np.zeros((n, 2), np.uint64)
            signatures = []
            full = np.flatnonzero(np.diff(at) > 0)
            for i in full:
                own = np.unique(hashes[at[i] : at[i + 1]])
                counts[i] = len(own)
                sums[i] = own.sum(), np.bitwise_xor.reduce(mix(own + np.uint64(77)))
                signatures.append(sketcher.signature(own))
            keys = sketcher.keys(np.array(signatures)) if signatures else np.zeros((0, bins // rows), np.int64)
            sizes = np.zeros(n + 1, np.int32)
            sizes[full + 1] = bins // rows
            none = counts == 0
            h = mix(sums + counts[:, None].astype(np.uint64)).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts), pa.array(h[:, 0], mask=none), pa.array(h[:, 1], mask=none), pa.ListArray.from_arrays(pa.array(np.cumsum(sizes, dtype=np.int32)), pa.array(keys.ravel()))], names=schema.names)

    return mapped(docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")), run, schema)


def paired(pairs: DataFrame, docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """The texts of pairs (a, b) of ids; only texts of ids that occur are moved."""
    ids = written(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct())
    texts = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).join(sized(ids, ids.count()), "id", "left_semi").dropDuplicates(["id"])
    return pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b").join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a").select("a", "b", "text_a", "text_b")


def full_sets(batch: pa.RecordBatch, width: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Sets of both texts of each pair; the first text is read once for a run of its pairs."""

    def sets(column: pa.Array) -> list[np.ndarray]:
        data, offsets = utf8(column)
        hashes, at = shingles(lowered(data), offsets, width)
        return [np.unique(hashes[s:e]) for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]

    ids = batch.column(0).to_numpy(zero_copy_only=False)
    first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
    left = [s for s, n in zip(sets(batch.column(2).take(pa.array(first))), np.diff(np.append(first, len(ids))).tolist(), strict=True) for _ in range(n)]
    return left, sets(batch.column(3))


def within(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which elements of x are in y; both ascending."""
    if not len(y):
        return np.zeros(len(x), bool)
    return y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x


def confirm(pairs: DataFrame, docs: DataFrame, width: int, id_col: str, text: str) -> DataFrame:
    """a, b, n_a, n_b, common: sizes of the full sets and of their intersection, for each pair of ids."""
    both = paired(pairs, docs, id_col, text)
    schema = T.StructType([both.schema["a"], both.schema["b"], *[T.StructField(c, T.LongType()) for c in ("n_a", "n_b", "common")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text_b"):
            left, right = full_sets(batch, width)
            common = [int(np.count_nonzero(within(x, y))) for x, y in zip(left, right, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(x) for x in left], pa.int64()), pa.array([len(y) for y in right], pa.int64()), pa.array(common, pa.int64())], names=schema.names)

    return mapped(both, run, schema)


def beyond(pairs: DataFrame, docs: DataFrame, width: int, id_col: str, text: str) -> DataFrame:
    """a, b and the elements of b's set that a's lacks, for each pair of ids."""
    both = paired(pairs, docs, id_col, text)
    schema = T.StructType([both.schema["a"], both.schema["b"], T.StructField("extra", T.ArrayType(T.LongType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text_b"):
            extra = [y[~within(y, x)].view(np.int64) for x, y in zip(*full_sets(batch, width), strict=True)]
            ends = np.cumsum([0, *map(len, extra)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(extra)))], names=schema.names)

    return mapped(both, run, schema)


def components(links: DataFrame) -> DataFrame:
    """id and label (the least id reachable) of each id in links (a, b). Minima spread along links and jump along labels until none changes."""
    both = written(links.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("near")), F.struct(F.col("b").alias("id"), F.col("a").alias("near")))).alias("x")).select("x.*").distinct())
    now = written(both.groupBy("id").agg(F.least(F.col("id"), F.min("near")).alias("label")))
    while True:
        spread = both.join(now.select(F.col("id").alias("near"), "label"), "near").groupBy("id").agg(F.min("label").alias("other"))
        step = now.join(spread, "id").select("id", F.col("label").alias("old"), F.least("label", "other").alias("label"))
        jump = step.join(now.select(F.col("id").alias("label"), F.col("label").alias("beyond")), "label", "left")
        new = written(jump.select("id", "old", F.least("label", "beyond").alias("label")))
        if new.filter("label < old").isEmpty():
            return now
        now = new.select("id", "label")


def all_elements(ids: DataFrame, docs: DataFrame, width: int, id_col: str, text: str) -> DataFrame:
    """rep, n (its set's size) and e, for each element of the sets of some ids."""
    texts = docs.select(F.col(id_col).alias("rep"), F.col(text).alias("text")).join(sized(ids, ids.count()), "rep", "left_semi").dropDuplicates(["rep"])
    schema = T.StructType([texts.schema["rep"], T.StructField("n", T.LongType()), T.StructField("set", T.ArrayType(T.LongType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            data, offsets = utf8(batch.column(1))
            hashes, at = shingles(lowered(data), offsets, width)
            sets = [np.unique(hashes[s:e]).view(np.int64) for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            ends = np.cumsum([0, *map(len, sets)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(ends)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets)))], names=schema.names)

    return mapped(texts, run, schema).select("rep", "n", F.explode("set").alias("e"))


def rarest(elements: DataFrame, context: list[str], size: str, prefix: Column) -> DataFrame:
    """Of each member's elements (a row for each, with their number in `size`) the `prefix` rarest of its context, by (frequency, element).

    Elements that one member alone has come first in that order and match nothing: they are counted, not kept.
    Elements whose holders are all in one component are left out, too.
    """
    common = elements.groupBy(*context, "e").agg(F.count("*").alias("f"), F.min("label").alias("low"), F.max("label").alias("high")).filter("f > 1")
    kept = elements.join(common, [*context, "e"])
    member = Window.partitionBy(*context, "rep")
    turn = F.row_number().over(member.orderBy("f", "e")) + F.col(size) - F.count("*").over(member)
    return written(kept.withColumn("turn", turn).filter((F.col("turn") <= prefix) & (F.col("low") < F.col("high"))).drop("turn", "f", "low", "high"))


def missed(hubs: DataFrame, labels: DataFrame, docs: DataFrame, width: int, percent: int, id_col: str, text: str) -> DataFrame:
    """Pairs (a, b) that may be links between components: see the module's text. hubs: measured pairs of a hub and a member."""
    own = labels.select(F.col("id").alias("rep"), "label")
    share = percent / 100
    bound = (1 - share) / (1 + share)  # of the sum of two sets' sizes: what their symmetric difference may be
    reach = bound * (1 + 1 / share)  # the same of one set's size, whatever the other's
    near = hubs.filter(F.col("away") <= FAR + 1 - share + 1e-9)
    # members about a centre: a and d count what they have beyond its set and what they lack of it
    around = near.select(F.col("a").alias("center"), F.col("b").alias("rep"), F.col("n_b").alias("n"), (F.col("n_b") - F.col("common")).alias("a"), (F.col("n_a") - F.col("common")).alias("d"), "away")
    around = around.join(own, "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    centers = own.select(F.col("rep").alias("center"), F.col("label").alias("center_label"))
    around = around.join(centers, "center", "left").withColumn("out", F.col("label") != F.coalesce("center_label", "center"))
    # where all members are in the centre's component, or there is only one, nothing is open
    open_ = around.groupBy("center").agg(F.count_if("out").alias("outs"), F.count("*").alias("m")).filter("outs > 0 and m > 1").select("center")
    around = written(around.join(open_, "center", "left_semi").select("center", "rep", "n", "a", "d", "away", "label", "out"))
    ids = ["rep", "n", "a", "d", "away", "label"]
    other = [F.col(c).alias(f"{c}_2") for c in ids]
    alike = (F.col("label") != F.col("label_2")) & (F.least("n", "n_2") * 100 >= F.greatest("n", "n_2") * percent)
    fits = alike & (F.least("away", "away_2") <= FAR) & (F.abs(F.col("away") - F.col("away_2")) <= 1 - share + 1e-9)
    limit = (F.col("n") + F.col("n_2")) * bound + 1e-9
    result = [F.least("rep", "rep_2").alias("a"), F.greatest("rep", "rep_2").alias("b")]

    # pairs that share nothing beyond the centre's set: a + a' + |d - d'| is small, so one of them lacks more than it adds
    slack = F.col("a") + F.col("d") - F.col("n") * reach
    context = around.groupBy("center").agg(F.max(F.col("d") - F.col("a")).alias("most"), F.min(F.when(F.col("out"), slack)).alias("least"))
    sides = around.join(context, "center")
    x = sides.filter(F.col("out") & (slack <= F.col("most"))).select("center", *ids)
    y = sides.filter(F.col("d") - F.col("a") >= F.col("least")).select("center", *other)
    by_size = x.join(y, "center").filter(fits & (F.col("a") + F.col("a_2") + F.abs(F.col("d") - F.col("d_2")) <= limit)).select(*result)

    # pairs that share something beyond it
    extra = written(beyond(around.select(F.col("center").alias("a"), F.col("rep").alias("b")), docs, width, id_col, text))
    extra = extra.select(F.col("a").alias("center"), F.col("b").alias("rep"), F.explode("extra").alias("e")).join(around, ["center", "rep"])
    index = rarest(extra, ["center"], "a", F.floor(F.col("n") * reach + 1e-9) + 1)
    by_extra = index.filter("out").select("center", "e", *ids).join(index.select("center", "e", *other), ["center", "e"]).filter(fits & (F.abs(F.col("a") + F.col("d") - F.col("a_2") - F.col("d_2")) <= limit)).select(*result)

    # pairs far from their centres
    far = written(hubs.filter(F.col("away") > FAR).select(F.col("b").alias("rep")).distinct())
    whole = all_elements(far, docs, width, id_col, text).join(own, "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    index = rarest(whole, [], "n", F.col("n") - F.ceil(F.col("n") * share - 1e-9) + 1)
    by_element = index.join(index.select("e", *[F.col(c).alias(f"{c}_2") for c in ("rep", "n", "label")]), "e").filter(alike & (F.col("rep") < F.col("rep_2"))).select(*result)
    return by_size.unionByName(by_extra).unionByName(by_element).distinct()


def near_duplicates(docs: DataFrame, width: int = 3, percent: int = 85, bins: int = 160, rows: int = 5, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept (the component's least id) for each row of docs."""
    text_hash = F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(3), text).alias("b"))
    named = docs.select(F.col(id_col).alias("doc_id"), text_hash.alias("of"), F.col(text).alias("text"))
    several = named.filter("doc_id is not null").groupBy("doc_id").agg((F.min("of") != F.max("of")).alias("several")).filter("several")
    if isinstance(docs.schema[id_col].dataType, NUMERIC) and several.isEmpty():
        return by_numbers(docs, width, percent, bins, rows, id_col, text)
    # texts are known by numbers, and components by the least id in them
    number = F.when(F.col("doc_id").isNotNull(), F.monotonically_increasing_id())
    texts = written(named.dropDuplicates(["doc_id", "of"]).withColumn("number", number))
    found = by_numbers(texts, width, percent, bins, rows, "number", "text").withColumnsRenamed({"doc_id": "number", "component_id": "label"})
    known = written(texts.filter("number is not null").select("doc_id", "of", "number").join(found.select("number", "n_shingles", "label"), "number"))
    least = known.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    known = known.join(least, "label").select("doc_id", "of", "n_shingles", "component_id")
    out = named.select("doc_id", "of").filter("doc_id is not null").join(known, ["doc_id", "of"]).select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))
    nameless = sketch(named.filter("doc_id is null"), width, bins, rows, "doc_id", "text")
    return out.unionByName(nameless.select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept")))


def by_numbers(docs: DataFrame, width: int, percent: int, bins: int, rows: int, id_col: str, text: str) -> DataFrame:
    """near_duplicates where ids are numbers and rows with one id have one text."""
    drawn = written(sketch(docs, width, bins, rows, id_col, text))
    sets = written(drawn.filter("n_shingles > 0 and doc_id is not null").groupBy("h1", "h2").agg(F.min("doc_id").alias("rep")))
    owners = drawn.join(sets.select("h1", "h2", F.col("rep").alias("doc_id")), ["h1", "h2", "doc_id"], "left_semi").select(F.col("doc_id").alias("rep"), "n_shingles", F.explode("keys").alias("key")).distinct()
    good = F.col("common") * 100 >= (F.col("n_a") + F.col("n_b") - F.col("common")) * percent
    away = 1 - F.col("common") / (F.col("n_a") + F.col("n_b") - F.col("common"))
    shared = owners.groupBy("key").agg(F.count("*").alias("n"), F.min("rep").alias("center")).filter("n > 1").select("key", "center")
    members = written(owners.select("key", "rep").join(shared, "key"))
    star = members.filter("rep != center").select(F.col("center").alias("a"), F.col("rep").alias("b")).distinct()
    checked = written(confirm(written(star), docs, width, id_col, text))
    links = checked.filter(good).select("a", "b")
    labels = components(links)

    degrees = links.select(F.col("a").alias("rep")).union(links.select("b")).groupBy("rep").agg(F.count("*").alias("degree"))
    spoken = members.select("key", "rep").join(degrees, "rep", "left").join(labels.select(F.col("id").alias("rep"), "label"), "rep", "left").select("key", "rep", F.coalesce("degree", F.lit(0)).alias("degree"), F.coalesce("label", "rep").alias("label"))
    spoken = written(spoken)
    best = F.max(F.struct("degree", (-F.col("rep")).alias("minus"), "label")).alias("top")
    hubs = spoken.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("n"), best).filter("low < high and n > 2").select("key", F.col("top.label").alias("label"))
    middles = spoken.groupBy("label").agg(best).select("label", (-F.col("top.minus")).alias("hub"))
    hubs = hubs.join(middles, "label").select("key", "hub")
    spokes = written(spoken.join(hubs, "key").filter("rep != hub").select("hub", "rep").distinct())
    known = checked.select(F.col("a").alias("hub"), F.col("b").alias("rep"), F.col("n_a").alias("n_hub"), F.col("n_b").alias("n"), "common")
    known = known.unionByName(known.select(F.col("rep").alias("hub"), F.col("hub").alias("rep"), F.col("n").alias("n_hub"), F.col("n_hub").alias("n"), "common"))
    new = spokes.join(known.select("hub", "rep"), ["hub", "rep"], "left_anti").select(F.col("hub").alias("a"), F.col("rep").alias("b"))
    new = written(confirm(written(new), docs, width, id_col, text))
    checked = written(checked.unionByName(new))
    links = checked.filter(good).select("a", "b")
    labels = components(links)
    measured = known.select(F.col("hub").alias("a"), F.col("rep").alias("b"), F.col("n_hub").alias("n_a"), F.col("n").alias("n_b"), "common").unionByName(new).join(spokes.select(F.col("hub").alias("a"), F.col("rep").alias("b")), ["a", "b"], "left_semi").dropDuplicates(["a", "b"])
    rest = written(missed(written(measured.withColumn("away", away)), labels, docs, width, percent, id_col, text).join(checked.select("a", "b"), ["a", "b"], "left_anti"))
    if not rest.isEmpty():
        more = written(confirm(rest, docs, width, id_col, text).filter(good).select("a", "b"))
        if not more.isEmpty():
            labels = components(links.unionByName(more))
    found = sets.join(labels.select(F.col("id").alias("rep"), "label"), "rep", "left").select("h1", "h2", F.coalesce("label", "rep").alias("component"))
    joined = drawn.select("doc_id", "n_shingles", "h1", "h2").join(found, ["h1", "h2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
