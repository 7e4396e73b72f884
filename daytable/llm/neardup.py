"""Near-duplicate documents by ProbMinHash.

Similarity is the probability Jaccard index of word shingles weighted by their counts: two documents' registers agree
with exactly that probability.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daytable.llm.bpe import in_portions
from daytable.llm.common import cut, in_small_batches, or_empty, small_join, squeezed, table, unsqueezed
from daytable.llm.components import components
from daytable.llm.words import gram_hashes, mixed, word_hashes

GRAM, ALIKE = 5, 0.8
#: 25 bands of 4 registers: a pair of similarity 0.8 shares no band with probability (1 - 0.8^4)^25 = 2e-6.
BANDS, ROWS = 25, 4
REGISTERS = BANDS * ROWS
#: Groups of as many texts or fewer are compared pair by pair, larger ones with one of them.
FEW = 4
#: Turns with pivots go on while one in so many pairs is a link; the exact join does the rest.
WORTH = 10
#: Pairs beyond which they are dealt to tasks of about PAIRS each.
MANY, PAIRS = 50_000, 4_000
#: Rows of one shingle that a task joins with the others of that shingle; a hot shingle goes to several tasks.
SALTED = 256


def shingles(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of a text's word shingles, ascending, and how often each occurs."""
    return np.unique(gram_hashes(word_hashes(text.split()), GRAM), return_counts=True)


def prob_min_hash(sets: list[tuple[np.ndarray, np.ndarray]], registers: int = REGISTERS) -> np.ndarray:
    """For each weighted set, the element that arrives first in each register (0 for an empty set), as rows.

    An element's arrivals are a Poisson process whose rate is its weight, drawn from its own hash: after each exponential
    gap it comes to a random register. Times only grow, so an element is done once it is later than the latest register of
    its set. All elements of all sets take their next step together.
    """
    sizes = np.array([len(x) for x, _ in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    element = np.concatenate([x for x, _ in sets] + [np.zeros(0, np.uint64)])
    weight = np.concatenate([w for _, w in sets] + [np.zeros(0, np.int64)]).astype(float)
    time = np.zeros(len(element))
    first, who = np.full(len(sets) * registers, np.inf), np.zeros(len(sets) * registers, np.uint64)
    step = 0
    while len(element):
        step += 1
        draw = mixed(element + np.uint64(step * 0xD1342543DE82EF95 & (1 << 64) - 1))
        gap = ((draw >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53
        time = time - np.log(gap) / weight
        at = owner * registers + (mixed(draw) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(first, at, time)
        won = time == first[at]
        who[at[won]] = element[won]
        latest = first.reshape(len(sets), registers).max(1)
        on = time < latest[owner]
        owner, element, weight, time = owner[on], element[on], weight[on], time[on]
    return who.reshape(len(sets), registers)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """The probability Jaccard index: the sum over shared elements d of 1 / sum over e of max(a_e / a_d, b_e / b_d).

    The inner sum depends on d by the ratio a_d / b_d and the scale of a_d only, so each ratio is worked out once.
    """
    if not len(a[0]) or not len(b[0]):
        return 0.0
    shared, at_a, at_b = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(shared):
        return 0.0
    x, y = a[1][at_a].astype(float), b[1][at_b].astype(float)
    only_a, only_b = a[1].sum() - x.sum(), b[1].sum() - y.sum()
    total, ratios = 0.0, x / y
    for ratio, n in zip(*np.unique(ratios, return_counts=True), strict=True):
        total += (x[ratios == ratio] / (np.maximum(x, y * ratio).sum() + only_a + only_b * ratio)).sum()
    return float(total)


def digest(text: bytes) -> bytes | None:
    """What texts of the same words share, whatever white space is between them; nothing without words."""
    return hashlib.blake2b(b" ".join(text.split()), digest_size=16).digest() if text.strip() else None


def digests(text: Column) -> Column:

    @F.arrow_udf("binary")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([digest(x or b"") for x in texts.cast(pa.large_binary()).to_pylist()], pa.binary())

    return of(text)


def sketches(text: Column) -> Column:
    """A struct: digest of the text's words (null without words) and the keys of its bands."""

    @F.arrow_udf("struct<words:binary,bands:array<bigint>>")
    def of(texts: pa.Array) -> pa.Array:
        found, keys = [], []
        for portion in in_portions([x or b"" for x in texts.cast(pa.large_binary()).to_pylist()]):
            found += map(digest, portion)
            rows = prob_min_hash([shingles(t) for t in portion]).reshape(len(portion), BANDS, ROWS)
            key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), rows.shape[:2])
            for k in range(ROWS):
                key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, :, k])
            keys.append(key.view(np.int64))
        flat = np.concatenate(keys).ravel() if keys else np.zeros(0, np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, BANDS), pa.int32()), pa.array(flat))
        return pa.StructArray.from_arrays([pa.array(found, pa.binary()), lists], ["words", "bands"])

    return of(text)


def alike(a: Column, b: Column, least: float) -> Column:
    """Whether two squeezed texts are similar by `least` or more, from their words."""

    @F.arrow_udf("boolean")
    def of(left: pa.Array, right: pa.Array) -> pa.Array:
        kept: dict[bytes, tuple] = {}

        def known(text: bytes) -> tuple:
            if text not in kept:
                if len(kept) > 200:
                    kept.clear()
                kept[text] = shingles(unsqueezed(text))
            return kept[text]

        pairs = zip(*(x.cast(pa.large_binary()).to_pylist() for x in (left, right)), strict=True)
        return pa.array([similarity(known(x), known(y)) >= least - 1e-9 for x, y in pairs], pa.bool_())

    return of(a, b)


def similar(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b), cut already, whose squeezed texts, from texts (node, text), are alike."""
    side = lambda n: texts.select(F.col("node").alias(f"{n}_node"), F.col("text").alias(f"{n}_text"))
    met, many = small_join(side("a"), pairs, F.col("a") == F.col("a_node")), pairs.count()
    if many > MANY:  # else their texts meet in fewer tasks than there are cores
        met = met.repartition(-(-many // PAIRS), "b")
    met = met.join(side("b"), F.col("b") == F.col("b_node"))
    return met.filter(alike(F.col("a_text"), F.col("b_text"), least)).select("a", "b").distinct()


def texts_of(docs: DataFrame, asked: DataFrame, most: int = 250_000) -> DataFrame:
    """(node, text), squeezed, for the nodes of asked (of, words, node), cut already, from docs (doc, text): the text of the
    document `of` that has these words. Up to `most` nodes, 10 MB, are broadcast; beyond, squeezed texts are shuffled."""
    nodes, on = asked.count(), F.col("doc") == F.col("of")
    ready = {"own": digests(F.col("text")), "text": squeezed(F.col("text"))}
    found = docs.join(F.broadcast(asked), on).withColumns(ready) if nodes <= most else docs.withColumns(ready).join(asked, on)
    found = cut(found.filter("own = words").select("node", "text"))
    return found if found.count() == nodes else cut(found.dropDuplicates(["node"]))  # rows that are repeated whole


def with_pivots(members: DataFrame) -> DataFrame:
    """members (key, score, node) with `n` and `pivot`, the size of their group and its node of highest score, for groups of
    two or more. Of a group only these two numbers are ever gathered; its members meet them in a table that is cut, so that
    those of a hot band may be split."""
    best = F.max(F.struct("score", -F.col("node")))
    groups = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"), best.alias("best")).filter("n > 1")
    return small_join(members, cut(groups.select("key", "n", (-F.col("best.col2")).alias("pivot"))), ["key"])


def pairs_of(met: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, from with_pivots: all of a group of FEW or fewer, each with the pivot in others.

    A small group travels as an array of at most FEW nodes."""
    other = (F.col("n") > FEW) & (F.col("node") != F.col("pivot"))
    star = met.filter(other).select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b"))
    few = met.filter(F.col("n") <= FEW).groupBy("key").agg(F.array_sort(F.collect_set("node")).alias("nodes"))
    each = few.select(F.explode("nodes").alias("a"), "nodes").select("a", F.explode(F.filter("nodes", lambda x: x > F.col("a"))).alias("b"))
    return star.union(each).distinct()


def rest_of(met: DataFrame, labels: DataFrame) -> DataFrame:
    """Members (key, score, node) of large groups that are in another class than their pivot."""
    label = lambda n: labels.select(F.col("node").alias(f"{n}_of"), F.col("label").alias(f"{n}_label"))
    large = small_join(met.filter(F.col("n") > FEW), label("node"), F.col("node") == F.col("node_of"), "left")
    large = small_join(large, label("pivot"), F.col("pivot") == F.col("pivot_of"), "left")
    return large.filter(F.coalesce("node_label", "node") != F.coalesce("pivot_label", "pivot")).select("key", "score", "node")


def shares(text: Column) -> Column:
    """The shingles of a squeezed text as an array of structs: gram, own, its share of the text's weight, and one, the least
    share that a shingle can have."""

    @F.arrow_udf("array<struct<gram:bigint,own:double,one:double>>")
    def of(texts: pa.Array) -> pa.Array:
        sets = [shingles(unsqueezed(t)) for t in texts.cast(pa.large_binary()).to_pylist()]
        ends = np.cumsum([0, *(len(x) for x, _ in sets)])
        gram = np.concatenate([x for x, _ in sets] + [np.zeros(0, np.uint64)]).view(np.int64)
        own = np.concatenate([w / w.sum() for _, w in sets] + [np.zeros(0)])
        one = np.concatenate([np.full(len(w), 1 / w.sum()) for _, w in sets] + [np.zeros(0)])
        each = pa.StructArray.from_arrays([pa.array(gram), pa.array(own), pa.array(one)], ["gram", "own", "one"])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), each)

    return of(text)


PREFIX = ("node", "label", "gram", "own", "one", "upto", "rest", "grams", "short")


def prefixes(texts: DataFrame, least: float) -> DataFrame:
    """PREFIX's columns from texts (node, label, text): each text's rarest shingles, of mass over 1 - least; short are the
    first of these, of mass over 1 - 2 / (1 + 1 / least). upto is the mass so far, rest the number of shingles from this one
    on, of `grams`."""
    rows = texts.select("node", "label", shares(F.col("text")).alias("all")).select("node", "label", F.size("all").alias("grams"), F.inline("all"))
    often = cut(rows.groupBy(F.col("gram").alias("of")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    rows = small_join(rows, often, F.col("gram") == F.col("of"), "left").withColumn("n", F.coalesce("n", F.lit(1)))
    so_far = Window.partitionBy("node").orderBy("n", "gram").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({"upto": F.sum("own").over(so_far), "rest": F.col("grams") - F.count(F.lit(1)).over(so_far) + 1}).withColumn("before", F.col("upto") - F.col("own"))
    short = F.col("before") <= 1 - 2 / (1 + 1 / least) + 1e-6
    return rows.filter(F.col("before") <= 1 - least + 1e-6).withColumn("short", short).select(*PREFIX)


def unexcluded(texts: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b), a < b, of texts (node, label, text) with different labels: all that may be alike.

    Let s and t be the shares of two texts' weights that lie on shared shingles. Then the probability Jaccard index is at
    most 1 / (1 / s + 1 / t - 1): with normalised weights and r = a_d / b_d the sum for d is at least 1 + r (1 - t), and
    x y / (y + c x) is concave. So the smaller of s and t is at least `least`, the larger 2 / (1 + 1 / least), and alike
    texts share a shingle that is in the short prefix of one and the prefix of the other. What comes before the first such
    shingle in either is not shared, and of what comes from there on no more shingles than the shorter rest has; both must
    leave s and t large enough together. Shingles where they would not be are left out: they come after the first shared
    one, if there is any. In the same way, what two texts share up to the last shingle that they met at, with what comes
    after it, bounds s and t. Pairs meet as numbers, never as texts.
    """
    enough = lambda s, t: (s > 0) & (t > 0) & (1 / s + 1 / t <= 1 + 1 / least + 1e-6)
    share = lambda mass, grams, shared, one: F.least(mass, 1 - (grams - shared) * one)
    rows = cut(prefixes(texts, least))
    met = rows.groupBy(F.col("gram").alias("of")).agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("low"), F.max("label").alias("high"), F.max("short").alias("any"))
    met = cut(met.filter("any and low <> high").select("of", F.ceil(F.col("n") / SALTED).cast("int").alias("salts")))
    rows = small_join(rows, met, F.col("gram") == F.col("of"))
    numbers = ("own", "one", "upto", "rest", "grams")
    left = rows.filter("short").select(F.col("gram").alias("l_gram"), F.pmod(F.xxhash64("node"), "salts").cast("int").alias("l_salt"), *(F.col(c).alias(f"l_{c}") for c in ("node", "label", *numbers)))
    right = rows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    met = (F.col("l_gram") == F.col("gram")) & (F.col("l_salt") == F.col("salt")) & (F.col("l_label") != F.col("label"))
    once = (F.col("l_node") < F.col("node")) | ~F.col("short") & (F.col("l_node") != F.col("node"))
    fewer = F.least("l_rest", "rest")
    bound = lambda p: share(1 - F.col(f"{p}upto") + F.col(f"{p}own"), F.col(f"{p}grams"), fewer, F.col(f"{p}one"))
    both = left.join(right, met & once & enough(bound("l_"), bound("")))
    turn = F.col("l_node") > F.col("node")
    pick = lambda c, other: F.when(turn, F.col(other)).otherwise(F.col(c))
    sides = [(f"{x}_{n}", *ends) for x, at in (("a", 1), ("b", -1)) for n in numbers for ends in [(f"l_{n}", n)[::at]]]
    both = both.select(pick("l_node", "node").alias("a"), pick("node", "l_node").alias("b"), *(pick(l, r).alias(n) for n, l, r in sides))
    of = lambda x: [F.sum(f"{x}_own").alias(f"{x}_own"), F.max(f"{x}_upto").alias(f"{x}_upto"), F.min(f"{x}_rest").alias(f"{x}_rest"), F.first(f"{x}_grams").alias(f"{x}_grams"), F.first(f"{x}_one").alias(f"{x}_one")]
    pairs = both.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), *of("a"), *of("b"))
    shared = F.col("n") + F.least("a_rest", "b_rest") - 1
    most = lambda x: share(F.col(f"{x}_own") + 1 - F.col(f"{x}_upto"), F.col(f"{x}_grams"), shared, F.col(f"{x}_one"))
    return pairs.filter(enough(most("a"), most("b"))).select("a", "b")


def undecided(met: DataFrame, labels: DataFrame) -> DataFrame:
    """(node, label) of all nodes of the large groups, from with_pivots, that hold more than one class."""
    met = cut(small_join(met.filter(F.col("n") > FEW).select("key", F.col("node").alias("of")), labels, F.col("of") == F.col("node"), "left"))
    met = met.select("key", F.col("of").alias("node"), F.coalesce("label", "of").alias("label"))
    keys = met.groupBy(F.col("key").alias("of")).agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high")
    return small_join(met, cut(keys), F.col("key") == F.col("of")).select("node", "label").distinct()


def links_of(nodes: DataFrame, docs: DataFrame, least: float) -> DataFrame:
    """(node, label): the components of the nodes (node, doc, words, bands) that are linked with any; texts are in docs (doc, text)."""
    bands = nodes.select("node", F.explode("bands").alias("band"))
    sizes = cut(bands.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    bands = cut(small_join(bands, sizes, ["band"]).select("band", "n", "node"))
    asked = bands.groupBy(F.col("node").alias("in_band")).agg(F.sum("n").alias("score"))
    asked = cut(nodes.select("node", F.col("doc").alias("of"), "words").join(asked, F.col("node") == F.col("in_band")).drop("in_band"))
    texts = texts_of(docs, asked.drop("score"))
    members = bands.select(F.col("band").alias("key"), F.col("node").alias("member")).join(asked.select("node", "score"), F.col("member") == F.col("node")).select("key", "score", "node")
    first = done = links = labels = None
    while True:
        met = cut(with_pivots(members))
        first = met if done is None else first
        pairs = pairs_of(met)
        pairs = cut(pairs if done is None else small_join(pairs, done, ["a", "b"], "left_anti"))
        new = cut(similar(pairs, texts, least))
        asked_now, linked = pairs.count(), new.count()
        if done is None or linked:
            links = new if done is None else cut(links.union(new))
            labels = cut(components(links))
        done = pairs if done is None else cut(done.union(pairs))
        if linked * WORTH < asked_now or not asked_now:
            break
        members = rest_of(met, labels)
    left = cut(undecided(first, labels))
    if left.isEmpty():
        return labels
    named = small_join(texts.withColumnRenamed("node", "of"), left, F.col("of") == F.col("node")).select("node", "label", "text")
    pairs = unexcluded(named, least)
    new = cut(similar(cut(small_join(pairs, done, ["a", "b"], "left_anti")), texts, least))
    return cut(components(cut(links.union(new))))


def classes(docs: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """(rows, classes) of docs (doc, text): doc and words, the digest of the text, for each row; and for each words that a
    known document has, class_id, the smallest document of its class, and whether these words stand for the class."""
    rows = cut(docs.select("doc", sketches(F.col("text")).alias("sketch")).select("doc", "sketch.*"))
    known = rows.filter("words is not null and doc is not null")
    nodes = known.groupBy("words").agg(F.min("doc").alias("doc"), F.first("bands").alias("bands"))
    nodes = cut(nodes.withColumn("node", F.monotonically_increasing_id()))
    labels = links_of(nodes, docs, least).withColumnsRenamed({"node": "of", "label": "of_label"})
    named = small_join(nodes.drop("bands"), labels, F.col("node") == F.col("of"), "left")
    named = cut(named.select("words", "doc", "node", F.coalesce("of_label", "node").alias("label")))
    first = named.groupBy(F.col("label").alias("of")).agg(F.min(F.struct("doc", "words")).alias("first"))
    met = named.join(first, F.col("label") == F.col("of"))
    return rows.select("doc", "words"), cut(met.select("words", F.col("first.doc").alias("class_id"), (F.col("first.words") == F.col("words")).alias("stands")))


def plain(docs: DataFrame, id: str, text: str) -> DataFrame:
    return docs.select(F.col(id).alias("doc"), or_empty(F.col(text)).alias("text"))


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", least: float = ALIKE) -> DataFrame:
    """(doc, class_id) for each row of docs: class_id is the smallest id of the documents that it is linked with.

    Texts with equal words (white space aside) are one node, whatever documents they are in. Nodes that share a band are
    candidates; a candidate pair is a link if its probability Jaccard index is `least` or more, worked out from both whole
    texts, however long. Classes are the connected components. Texts of fewer than five words are one shingle; a document
    without words, or with a null text, is alone; a null id is alone and its class null. Rows that share an id each get the
    class of their own text. Other columns of docs play no part. An empty table gives an empty table.

    Groups that share a band are never paired off: a group of more than FEW is compared with one of its nodes, the one that
    shares bands most often, which in a group of copies is next to their origin. What is not in that node's class then is
    compared with the next such node, and so on while that finds a link in one of WORTH pairs. All nodes of large groups that
    hold more than one class then, those in a pivot's class too, are compared by an exact prefix join (see unexcluded), so
    that each of their pairs of different classes is worked out from both texts or is excluded by a bound.
    """
    rows, found = classes(plain(docs, id, text), least)
    alone = rows.filter("words is null or doc is null").select("doc", F.col("doc").alias("class_id"))
    return rows.filter("words is not null and doc is not null").join(found, "words").select("doc", "class_id").unionByName(alone)


def keep_first(docs: DataFrame, id: str = "doc_id", text: str = "text", least: float = ALIKE) -> DataFrame:
    """docs with one row of each class of near duplicates, of the smallest id and one text; columns as they were.

    Rows that share an id but not their text are only dropped where their texts are near duplicates. Rows with a null id or
    without words all stay. Of rows that are repeated whole one stays.

    What goes, or is there more than once, is told by ids and digests; rows of other ids stay as they are read, and whole
    rows are shuffled only where more ids are concerned than can be broadcast.
    """
    rows, found = classes(plain(docs, id, text), least)
    known = rows.filter("words is not null and doc is not null").groupBy("doc", "words").agg(F.count(F.lit(1)).alias("n"))
    odd = known.join(found, "words").withColumn("stays", F.col("stands") & (F.col("doc") == F.col("class_id"))).filter("not stays or n > 1")
    odd = cut(odd.select(F.col("doc").alias("__doc"), F.col("words").alias("__words"), F.col("stays").alias("__stays")))
    ids = cut(odd.select("__doc").distinct())
    clean = small_join(docs, ids, F.col(id) == F.col("__doc"), "left_anti")
    doubtful = small_join(docs, ids, F.col(id) == F.col("__doc"), "left_semi").withColumn("__own", digests(F.col(text)))
    met = small_join(doubtful, odd, (F.col(id) == F.col("__doc")) & (F.col("__own") == F.col("__words")), "left")
    other = met.filter("__doc is null").select(docs.columns)
    once = met.filter("__stays").dropDuplicates([id, "__own"]).select(docs.columns)
    return clean.unionByName(other).unionByName(once)


def op3_prob_min_hash(spark, sf_dir: str) -> DataFrame:
    in_small_batches(spark)
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("doc").alias("doc_id"), "class_id")
