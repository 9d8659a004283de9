"""Similarity join of documents by the Jaccard coefficient of their word shingles: a grouped prefix join.

Tokens (shingles) are ordered from rare to frequent. With p(n) = n - ceil(t n) + 1, two sets of similarity t or more
share tokens among their first p(n), and at least
    ceil(t (n1 + n2) / (1 + t)) - max(ceil(t n1), ceil(t n2)) + 1
of them, as beyond its prefix a set has ceil(t n) - 1 tokens.

1. Token counts over all documents, kept for tokens frequent enough to matter to the order.
2. Equal sets become one entity; entities of equal size and prefix become one group, which alone meets others.
3. Each entity is compared with its group's leader, and each group with a likely neighbour and the centre of its
   surroundings; then each class with the few that share most tokens: classes form from a few comparisons each.
4. Classes that share enough prefix tokens, and whose bitmaps allow it, are expanded, and members of different
   classes whose bitmaps allow a link are compared. No link between classes is lost, and links within a class need no proof.
Comparisons are exact, on the whole sets. Copies of a text cost one row in every step after the first.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import discard, in_batches, list_column, written
from tessera.llm.components import components
from tessera.llm.shingles import shingle_sets, signature

#: Tokens that are held in a task before their counts are sent on.
HELD = 1 << 20
#: A set's bitmap: for each of 64 * len(BITS) cells, whether it holds an odd number of the set's tokens. Two sets differ
#: in as many tokens at least as their bitmaps do in cells, so a pair whose bitmaps differ by more than a link allows
#: has no link.
BITS = [f"b{k}" for k in range(8)]


def frequent_tokens(texts: DataFrame, words: int, share: float, least: int = 8, most: int = 1 << 19) -> np.ndarray:
    """Sorted tokens that ``least`` documents or more hold, the ``most`` most frequent; they come last in the order.

    Counts cover all documents, but only tokens in the lowest ``share`` of the hash range, which make up nearly all
    prefixes: others need no demotion, as the order is by hash. A task counts what it holds before it sends it on,
    so a token that all documents hold costs a row a task. The bounds on the result affect speed and nothing else.
    """
    top = np.uint64(int(min(1.0, share) * ((1 << 64) - 1)))
    parts = 4 * int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent(held: list[np.ndarray]) -> pa.RecordBatch:
            token, times = np.unique(np.concatenate(held), return_counts=True)
            owner = ((token >> np.uint64(34)) * np.uint64(parts) // ((top >> np.uint64(34)) + np.uint64(1))).astype(np.int64)
            part, once, many, n = [], [], [], []
            for p in range(parts):
                a, b = np.searchsorted(owner, [p, p + 1])
                single = times[a:b] == 1
                part.append(p)
                once.append(token[a:b][single].tobytes())
                many.append(token[a:b][~single].tobytes())
                n.append(times[a:b][~single].astype(np.int32).tobytes())
            return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), *(pa.array(x, pa.binary()) for x in (once, many, n))], names=["part", "once", "many", "n"])

        held, size = [], 0
        for batch in batches:
            for _, sets in shingle_sets(batch, words):
                low = [s[: np.searchsorted(s, top)] for s in sets]
                held += low
                size += sum(map(len, low))
                if size >= HELD:
                    yield sent(held)
                    held, size = [], 0
        if size:
            yield sent(held)

    def total(table: pa.Table) -> pa.Table:
        read = lambda name, kind: np.frombuffer(b"".join(table.column(name).to_pylist()), kind)
        once, many, n = read("once", np.uint64), read("many", np.uint64), read("n", np.int32)
        token, where = np.unique(np.concatenate([once, many]), return_inverse=True)
        times = np.bincount(where, weights=np.concatenate([np.ones(len(once)), n]), minlength=len(token)).astype(np.int64)
        some = times >= least
        return pa.table({"token": token[some].astype(np.int64), "n": times[some]})

    counted = in_batches(texts, count, "part int, once binary, many binary, n binary").groupBy("part").applyInArrow(total, "token long, n long")
    found = counted.orderBy(F.desc("n"), "token").limit(most).select("token").toArrow().column("token").to_numpy()
    return np.sort(found.astype(np.uint64))


def least_shared(small: Column, large: Column, num: int, den: int) -> Column:
    """A lower bound of the prefix tokens that two similar sets of such sizes share (0 or less says nothing)."""
    return small * F.lit(num / (num + den)) + large * F.lit(num / (num + den) - num / den)


def sized_alike(a: Column, b: Column, num: int, den: int) -> Column:
    return F.least(a, b) * F.lit(den) >= F.greatest(a, b) * F.lit(num)


def prefixes(docs: DataFrame, frequent: np.ndarray, words: int, num: int, den: int) -> DataFrame:
    """doc_id, place, text_key, n, sig, prefix (array of long) and bitmap (BITS) of every document; empty sets have n 0."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)  # bounded by ``most`` of frequent_tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = shared.value
        for batch in batches:
            for part, sets in shingle_sets(batch, words):
                size, sig, prefix, cells = [], [], [], np.zeros((len(sets), 64 * len(BITS)), bool)
                for row, s in zip(cells, sets, strict=True):
                    n = len(s)
                    row[:] = np.bincount((s % np.uint64(len(row))).astype(np.int64), minlength=len(row)) & 1
                    take = n + (-n * num // den) + 1 if n else 0
                    first = s[:take]
                    if len(frequent) and n:
                        late = frequent[np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)] == s
                        if late[:take].any():
                            first = np.concatenate([s[~late], s[late]])[:take]
                    size.append(n)
                    sig.append(signature(s))
                    prefix.append(first)
                at = np.concatenate([[0], np.cumsum([len(x) for x in prefix])])
                flat = np.concatenate(prefix).astype(np.int64)
                bits = np.packbits(cells, axis=1).view(np.int64)
                columns = [part.column("doc_id"), part.column("place"), part.column("text_key"), pa.array(size, pa.int64()), pa.array(sig, pa.int64()), list_column(flat, at, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(b, pa.int64()) for b in bits.T.copy()], names=["doc_id", "place", "text_key", "n", "sig", "prefix", *BITS])

    return in_batches(docs, run, "doc_id long, place long, text_key long, n long, sig long, prefix array<long>, " + ", ".join(f"{b} long" for b in BITS))


def may_link(x: str, y: str, num: int, den: int) -> Column:
    """Whether sizes and bitmaps of the structs x and y allow a link: sets that differ in d tokens of n1 + n2 are similar
    only if d (num + den) <= (den - num) (n1 + n2)."""
    apart = reduce(add, [F.bit_count(F.col(f"{x}.{b}").bitwiseXOR(F.col(f"{y}.{b}"))) for b in BITS])
    total = F.col(f"{x}.n") + F.col(f"{y}.n")
    return sized_alike(F.col(f"{x}.n"), F.col(f"{y}.n"), num, den) & (apart * F.lit(num + den) <= F.lit(den - num) * total)


def chosen(docs: DataFrame, ids: DataFrame, most: int = 1 << 20, by: str = "doc_id") -> DataFrame:
    """docs whose doc_id (or other column) is in ids; ids are broadcast only if there are no more than ``most``."""
    few = ids.limit(most + 1).count() <= most
    return docs.join(F.broadcast(ids) if few else ids, by, "left_semi")


def placed(documents: DataFrame) -> DataFrame:
    """doc_id, place (where a text is found again), text_key, text: all rows with an id, and each text of those without once.

    place is the id, or the hash of a text without one.
    """
    place = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(F.lit("place"), "text"))
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), place.alias("place"), F.xxhash64("text").alias("text_key"), "text")
    nameless = docs.where("doc_id is null").dropDuplicates(["place"])
    return docs.where("doc_id is not null").unionByName(written(nameless, "nameless"))


def once(table: DataFrame, key: list[str]) -> DataFrame:
    """A written table with one row for each key, where rows of a key are equal: repeated rows of documents bring theirs again.

    Keys are counted without the other columns; rows whose key comes once, nearly all, are not shuffled.
    """
    again = written(table.groupBy(*key).agg(F.count(F.lit(1)).alias("times")).where("times > 1").select(*key), "again")
    if again.isEmpty():
        return table
    several = table.join(again, key, "left_semi").dropDuplicates(key)
    return written(table.join(again, key, "left_anti").unionByName(several), "once")


def verified(pairs: DataFrame, docs: DataFrame, entities: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b: signatures) whose sets are similar; only texts that a pair needs leave their place."""
    needed = pairs.select(F.col("a").alias("sig")).unionAll(pairs.select(F.col("b").alias("sig"))).distinct()
    ids = written(entities.select("sig", "place").join(needed, "sig").select("place").distinct(), "needed")
    texts = chosen(docs, ids, by="place")

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, sets in shingle_sets(batch, words):
                yield pa.RecordBatch.from_arrays([pa.array([signature(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["sig", "tokens"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                common = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                keep.append(common * den >= num * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    sets = once(written(in_batches(texts, to_sets, "sig long, tokens binary"), "sets"), ["sig"])
    left = pairs.join(sets.select(F.col("sig").alias("a"), F.col("tokens").alias("x")), "a")
    both = left.join(sets.select(F.col("sig").alias("b"), F.col("tokens").alias("y")), "b")
    links = written(in_batches(both.select("a", "b", "x", "y"), compare, "a long, b long"), "links")
    discard(ids, sets)
    return links


def merged(known: DataFrame, links: DataFrame) -> DataFrame:
    """known with classes that links (a, b: classes) join as one, named by the smallest: rounds see classes, not members."""
    found = components(links).select(F.col("node").alias("class"), F.col("component").alias("found"))
    return known.join(found, "class", "left").withColumn("class", F.coalesce("found", "class")).drop("found")


def apart(met: DataFrame, known: DataFrame) -> DataFrame:
    """The rows of met (token, group, n), with the classes of each group's members, of tokens that several classes hold."""
    held = met.select("token", "group", "n").join(known.select("group", "class").distinct(), "group")
    token = Window.partitionBy("token")
    spread = held.withColumns({"low": F.min("class").over(token), "high": F.max("class").over(token)})
    return spread.where("low < high").drop("low", "high")


def meeting(met: DataFrame, known: DataFrame, num: int, den: int) -> DataFrame:
    """ca, cb, shared: pairs of classes (ca < cb) that share the prefix tokens that a link between members would need.

    A class has the range of its members' sizes, and of each cell of their bitmaps whether it is 1 in all (bit_and) or in
    any (bit_or): where two classes' cells are the same in all members and differ between them, so do all pairs' cells.
    Members of different groups share only tokens that met holds; members of one group share their whole prefix, whether
    or not another group holds any of it, so classes with members in one group are a pair of their own.
    """
    held = apart(met, known).select("token", "class").distinct()
    cells = [x for b in BITS for x in (F.bit_and(b).alias(f"all_{b}"), F.bit_or(b).alias(f"any_{b}"))]
    kind = known.groupBy("class").agg(F.min("n").alias("low"), F.max("n").alias("high"), *cells)
    rows = held.join(kind, "class").select("token", F.struct(*kind.columns).alias("c"))
    x, y = rows.select("token", F.col("c").alias("x")), rows.select("token", F.col("c").alias("y"))

    def differing(b: str) -> Column:
        all_x, any_x, all_y, any_y = (F.col(f"{c}.{k}_{b}") for c in "xy" for k in ("all", "any"))
        mixed = all_x.bitwiseXOR(any_x).bitwiseOR(all_y.bitwiseXOR(any_y))
        return F.bit_count(all_x.bitwiseXOR(all_y).bitwiseAND(F.bitwise_not(mixed)))

    sizes = (F.col("x.high") * den >= F.col("y.low") * num) & (F.col("y.high") * den >= F.col("x.low") * num)
    cells = reduce(add, [differing(b) for b in BITS]) * F.lit(num + den) <= F.lit(den - num) * (F.col("x.high") + F.col("y.high"))
    allowed = (F.col("x.class") < F.col("y.class")) & sizes & cells
    pairs = x.join(y, "token").where(allowed)
    pairs = pairs.select(F.col("x.class").alias("ca"), F.col("y.class").alias("cb"), F.least("x.low", "y.low").alias("low"), F.greatest("x.high", "y.high").alias("high"))
    pairs = pairs.groupBy("ca", "cb", "low", "high").agg(F.count(F.lit(1)).alias("shared"))
    pairs = pairs.where(F.col("shared") >= least_shared(F.col("low"), F.col("high"), num, den) - 1e-6).select("ca", "cb", "shared")

    split = known.groupBy("group").agg(F.min("class").alias("first"), F.max("class").alias("last")).where("first < last").select("group")
    prefix = F.col("n") - F.ceil(F.col("n") * num / den) + 1
    within = known.select("group", "class", prefix.alias("prefix")).distinct().join(split, "group")
    within = within.join(kind, "class").select("group", "prefix", F.struct(*kind.columns).alias("c"))
    x, y = within.select("group", "prefix", F.col("c").alias("x")), within.select("group", F.col("c").alias("y"))
    inner = x.join(y, "group").where(allowed).select(F.col("x.class").alias("ca"), F.col("y.class").alias("cb"), F.col("prefix").alias("shared"))
    return pairs.unionAll(inner).groupBy("ca", "cb").agg(F.max("shared").alias("shared"))


def beside(met: DataFrame, num: int, den: int) -> DataFrame:
    """For each group the one (a, b) that most often stands before it among the groups of a token, if that is often."""
    likely = met.where((F.col("before") != F.col("group")) & sized_alike(F.col("n"), F.col("before_n"), num, den))
    likely = likely.groupBy("group", "before", "n", "before_n").agg(F.count(F.lit(1)).alias("shared"))
    often = F.col("shared") >= 0.5 * least_shared(F.least("n", "before_n"), F.greatest("n", "before_n"), num, den)
    return likely.where(often).groupBy(F.col("group").alias("a")).agg(F.max_by("before", F.struct("shared", "before")).alias("b"))


def central(met: DataFrame, num: int, den: int) -> DataFrame:
    """For each group the centre (a, b) that most of its tokens name, if enough do for a link.

    A token's centre is the group whose tokens are held most in all: among edited copies of a text, the one that was
    edited least, with which most others are linked, whether or not they are with each other. One pair a group at most.
    """
    rows = met.select("token", "group", "n").distinct()
    held = rows.groupBy("token").agg(F.count(F.lit(1)).alias("held"))
    weight = rows.join(held, "token").groupBy("group").agg(F.sum("held").alias("weight"))
    centres = rows.join(weight, "group").groupBy("token").agg(F.max_by(F.struct("group", "n"), F.struct("weight", "group")).alias("c"))
    named = rows.join(centres, "token").where((F.col("c.group") != F.col("group")) & sized_alike(F.col("n"), F.col("c.n"), num, den))
    counted = named.groupBy("group", "n", F.col("c.group").alias("b"), F.col("c.n").alias("bn")).agg(F.count(F.lit(1)).alias("shared"))
    enough = F.col("shared") >= 0.5 * least_shared(F.least("n", "bn"), F.greatest("n", "bn"), num, den)
    return counted.where(enough).groupBy(F.col("group").alias("a")).agg(F.max_by("b", F.struct("shared", "b")).alias("b"))


def similar_documents(documents: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id of similar_classes."""
    return similar_classes(documents, words, num, den).select("doc_id", "n_shingles", "component_id")


def similar_classes(documents: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id, class_id, text_key for every row: classes of documents linked by similarity >= num / den.

    A document's set is its distinct ``words``-word shingles (words: runs of anything but white space, A-Z folded), or
    its whole sequence if it has fewer words. Null and empty texts have empty sets and link with nothing. Equal texts
    are always linked. component_id is the smallest doc_id of the class; rows of null doc_id get their class's, or null.
    Repeated rows come back as often as they came; rows that share a doc_id and not their texts are documents of their
    own. An empty table gives no rows. Very long texts are sets like any other; columns other than doc_id and text play
    no part. class_id is the same for the rows of a class and null for empty sets, text_key is Spark's xxhash64 of the
    text. Signatures of sets have 64 bits.
    """
    docs = placed(documents)
    frequent = frequent_tokens(docs, words, 3 * (1 - num / den))
    listed = written(prefixes(docs, frequent, words, num, den), "prefixes")
    rows = listed.select("doc_id", "place", "text_key", "n", "sig")
    # Equal sets: one entity. Equal sizes and prefixes: one group, known by its smallest entity.
    real = listed.where("n > 0").select("doc_id", "place", "n", "sig", F.xxhash64("n", "prefix").alias("key"), *BITS)
    entities = written(real.groupBy("sig", "n", "key", *BITS).agg(F.min("doc_id").alias("doc_id"), F.min("place").alias("place")), "entities")
    groups = entities.groupBy("key").agg(F.min("sig").alias("group"))
    members = written(entities.join(groups, "key").select("sig", "n", "doc_id", "place", "group", *BITS), "members")

    token = Window.partitionBy("token").orderBy("n", "group")
    leaders = members.where("sig = group").select("place", "sig")
    led = once(listed, ["place", "sig"]).join(leaders, ["place", "sig"])
    tokens = led.select(F.explode("prefix").alias("token"), F.col("sig").alias("group"), F.col("n").cast("int").alias("n"))
    met = tokens.select("token", "group", "n", F.lag("group").over(token).alias("before"), F.lag("n").over(token).alias("before_n"), F.lead("group").over(token).alias("after"))
    met = written(met.where("before is not null or after is not null").drop("after"), "tokens")

    pairs = members.where("sig != group").select(F.col("sig").alias("a"), F.col("group").alias("b"))
    pairs = pairs.unionAll(beside(met, num, den)).unionAll(central(met, num, den))
    pairs = written(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    links = verified(pairs, docs, members, words, num, den)
    known = written(merged(members.withColumn("class", F.col("sig")), links), "classes")
    # Each class meets the few that share most tokens with it, by its first member; what links makes fewer classes.
    close = meeting(met, known, num, den)
    both = close.unionAll(close.select(F.col("cb").alias("ca"), F.col("ca").alias("cb"), "shared"))
    best = both.withColumn("rank", F.row_number().over(Window.partitionBy("ca").orderBy(F.desc("shared"), "cb"))).where("rank <= 4")
    pairs = written(best.select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct(), "pairs")
    known = written(merged(known, verified(pairs, docs, members, words, num, den)), "classes")

    # All other classes that meet in enough tokens, as pairs of groups; then their members, of the class of fewer members
    # first, where sizes and bitmaps allow a link.
    close = meeting(met, known, num, den)
    counts = known.groupBy("class").agg(F.count(F.lit(1)).alias("members"))
    close = close.join(counts.select(F.col("class").alias("ca"), F.col("members").alias("ma")), "ca").join(counts.select(F.col("class").alias("cb"), F.col("members").alias("mb")), "cb")
    few = F.col("ma") <= F.col("mb")
    close = close.select(F.when(few, F.col("ca")).otherwise(F.col("cb")).alias("ca"), F.when(few, F.col("cb")).otherwise(F.col("ca")).alias("cb"))
    member = F.struct("sig", "n", *BITS)
    a, b = known.select(F.col("class").alias("ca"), member.alias("x")), known.select(F.col("class").alias("cb"), member.alias("y"))
    more = close.join(a, "ca").join(b, "cb").where(may_link("x", "y", num, den)).select(F.col("x.sig").alias("a"), F.col("y.sig").alias("b"))
    more = written(more, "pairs")
    discard(met)
    late = verified(more, docs, members, words, num, den)
    of_class = lambda name: known.select(F.col("sig").alias(name), F.col("class").alias(f"c{name}"))
    late = late.join(of_class("a"), "a").join(of_class("b"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    final = merged(known, late)

    smallest = final.groupBy("class").agg(F.min("doc_id").alias("component_id"))
    of_entity = final.select("sig", "class").join(smallest, "class")
    found = rows.join(of_entity, "sig", "left")
    out = ["doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), F.col("class").alias("class_id"), "text_key"]
    nameless = documents.where("doc_id is null").select(F.xxhash64(F.lit("place"), "text").alias("place"))
    return found.where("doc_id is not null").select(*out).unionAll(nameless.join(found.where("doc_id is null"), "place").select(*out))
