"""Near-duplicate detection by Order MinHash.

A text is its words (lower case; a word is a run of ASCII letters, digits, ``_`` and all
characters outside ASCII) and their shingles of five.  Shingles are labelled with their
occurrence number, so repeats count.  Each of ``SKETCHES`` hash functions picks the
``PICKED`` labelled shingles with the least hashes and keeps them in text order; two texts
get the same value when they share these shingles in the same order, which is likely for
texts of small edit distance and unlikely for texts that only share vocabulary or have
their parts rearranged.

Candidates that share a value are verified by alignment: the longest common subsequence of
their shingle sequences, found bit-parallel within the band that the threshold leaves.
With M shingles aligned of n and m, similarity is M / (n + m - M): the Jaccard similarity
of the shingles, counting only those in order.  0.8 or more is a link; linked texts form
classes.

Scale: texts with the same words are one node.  In the first round each bucket links its
members to the one that meets most others in its buckets (the middle of a group of near
copies), so a bucket of n members makes n - 1 candidates, not n * n.  Buckets whose
members are not yet of one class are looked at again.  Up to ``LARGE`` members are
compared directly.  Members of larger ones are reduced to their differences from the
middle.  What two members share follows from the sizes of their differences and what
those have in common, so if neither is the middle's near copy they must share some of
them, and one at least in a prefix of each, if both are put in one order.  Any order will do;
here differences that many have in a sample come last, so few meet on them.  Only prefixes
are read out.  Members far from their middle (boilerplate) go through the same join with all
their shingles.  The bounds lose nothing, and no bucket is expanded into its pairs.

Edge cases: null is an empty text; a text of one to four words is a single shingle; texts
without words are near duplicates only if equal; of a class the smallest doc_id is kept (a
null doc_id is larger than any), and repeated rows of it alike; an empty table gives an
empty result; other columns take no part.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from docloom.llm.columns import text_of
from docloom.llm.components import components
from docloom.storage import Scratch, materialize

WORDS, THRESHOLD = 5, 0.8
#: Hash functions, and labelled shingles each of them picks.
SKETCHES, PICKED = 24, 4
#: Members up to which all pairs of a bucket of several classes are compared.
LARGE = 16
#: Shingles up to which a text gets a bucket for itself without each one of them, too: up to
#: there a link has at most one shingle more, and sketches would miss some.
SHORT = 9
#: Rows of a narrow table up to which it is sent to every executor instead of shuffled.
SMALL_ROWS = 100_000
#: Members whose parts are counted for the order of prefixes, and parts that are told as frequent.
SAMPLED, FREQUENT = 1024, 50_000
#: Texts whose sketches Python holds at once.
TEXTS = 256
#: Bytes of a text hashed at once.
STRETCH = 1 << 20

_WORD = np.array([c >= 128 or chr(c).isalnum() or c == 95 for c in range(256)])
_MASK = (1 << 64) - 1


def _odd(n: int, seed: int) -> np.ndarray:
    return np.array([int.from_bytes(hashlib.blake2b(f"{seed}.{i}".encode(), digest_size=8).digest(), "little") | 1 for i in range(n)], np.uint64)


_BASE, _STEP, _ORDER, _SEEDS = int(_odd(1, 1)[0]), _odd(WORDS, 2), _odd(PICKED, 3), _odd(SKETCHES, 4)
_MIX = _odd(2, 5)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX[0]
    x = (x ^ (x >> np.uint64(29))) * _MIX[1]
    return x ^ (x >> np.uint64(32))


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word, in order."""
    raw = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)
    parts, at = [], 0
    while at < len(raw):
        end = min(at + STRETCH, len(raw))
        if end < len(raw):  # end where no word is cut
            back = np.flatnonzero(~_WORD[raw[at:end]])
            ahead = np.flatnonzero(~_WORD[raw[end:]]) if not len(back) else ()
            end = at + int(back[-1]) + 1 if len(back) else end + int(ahead[0]) if len(ahead) else len(raw)
        b = raw[at:end]
        inside = _WORD[b]
        starts = np.flatnonzero(inside & ~np.append(False, inside[:-1]))
        if len(starts):
            places = np.arange(len(b)) - np.repeat(np.append(0, starts), np.diff(np.append(np.append(0, starts), len(b))))
            powers = np.multiply.accumulate(np.append(np.uint64(1), np.full(int(places.max()), _BASE, np.uint64)))
            parts.append(np.add.reduceat(np.where(inside, (b.astype(np.uint64) + np.uint64(1)) * powers[places], np.uint64(0)), starts))
        at = end
    return _mix(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def shingles(words: np.ndarray) -> np.ndarray:
    """Hashes of runs of five words; of all words, if there are fewer."""
    size = min(WORDS, len(words))
    if not size:
        return words
    total = np.zeros(len(words) - size + 1, np.uint64)
    for i in range(size):
        total += words[i : len(words) - size + 1 + i] * _STEP[i]
    return _mix(total + np.uint64(size))


def labels(text_shingles: np.ndarray) -> np.ndarray:
    """Shingles told apart by their occurrence number."""
    order = np.argsort(text_shingles, kind="stable")
    ranked = text_shingles[order]
    first = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
    nth = np.arange(len(ranked)) - np.repeat(first, np.diff(np.append(first, len(ranked))))
    labelled = text_shingles.copy()
    labelled[order] += nth.astype(np.uint64) * _MIX[0]
    return labelled


def sketch(text_shingles: np.ndarray) -> np.ndarray:
    """The ordered values of all hash functions."""
    labelled = labels(text_shingles)
    out = np.zeros(SKETCHES, np.uint64)
    for j, seed in enumerate(_SEEDS):
        if len(labelled) > PICKED:
            hashed = _mix(labelled * seed)
            picked = np.sort(np.argpartition(hashed, PICKED)[:PICKED])
        else:
            picked = np.arange(len(labelled))
        out[j] = (labelled[picked] * _ORDER[: len(picked)]).sum() + np.uint64(j)
    return _mix(out).view(np.int64)


def aligned(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Length of the longest common subsequence whose cells lie within ``band`` of the
    diagonal; a bit for each cell of a row of the band."""
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    head = int(differ[0]) if len(differ) else n
    a, b = a[head:], b[head:]
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[::-1][:n] != b[::-1][:n])
    tail = int(differ[0]) if len(differ) else n
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if not len(a) or not len(b):
        return head + tail
    places = defaultdict(list)
    for i, x in enumerate(a.tolist()):
        places[x].append(i)
    width = 2 * band + 1
    full = open_ = (1 << width) - 1
    low, found = -band, 0
    for i, x in enumerate(b.tolist()):
        if i:
            found += 1 - (open_ & 1)
            open_ = (open_ >> 1) | (1 << (width - 1))
            low += 1
        match = 0
        for p in places.get(x, ()):
            if low <= p < low + width:
                match |= 1 << (p - low)
        if match:
            hit = open_ & match
            open_ = ((open_ + hit) | (open_ - hit)) & full
    return head + tail + found + width - open_.bit_count()


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """In-order Jaccard similarity of two shingle sequences; exact from ``THRESHOLD`` up."""
    total = len(a) + len(b)
    if not total:
        return 1.0
    band = int(total * (1 - 2 * THRESHOLD / (1 + THRESHOLD))) + 1
    if abs(len(a) - len(b)) > band:
        return 0.0
    m = aligned(a, b, band)
    return m / (total - m)


def short_buckets(text_shingles: np.ndarray) -> np.ndarray:
    """The sequence, and the sequence without each one shingle, of a short text."""
    if not 0 < len(text_shingles) <= SHORT:
        return np.zeros(0, np.int64)
    kept = [text_shingles] + [np.delete(text_shingles, i) for i in range(len(text_shingles))]
    order = np.cumprod(np.full(SHORT, _MIX[0], np.uint64))
    return _mix(np.array([(x * order[: len(x)]).sum() + np.uint64(len(x)) for x in kept if len(x)], np.uint64)).view(np.int64)


def _sketches(batches):
    """Some texts at a time leave as Arrow, so that a batch's are never all held as strings."""
    for batch in batches:
        for at in range(0, batch.num_rows, TEXTS):
            some, nodes, counts, made = batch.slice(at, TEXTS), [], [], []
            for text in some.column(2):
                text = text.as_py()
                words = word_hashes(text)
                s = shingles(words)
                nodes.append(hashlib.md5(words.tobytes() if len(words) else b"\0" + text.encode("utf-8", "surrogatepass")).digest())
                counts.append(len(s))
                made.append(np.append(sketch(s), short_buckets(s)) if len(s) else None)
            columns = [some.column(0), some.column(1), pa.array(nodes, pa.binary()), pa.array(counts, pa.int32()), pa.array(made, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_key", "node", "n", "sketch"])


def _verified(batches):
    last, last_shingles = None, None
    for batch in batches:
        keep = []
        for a, text_a, text_b in zip(batch["a"], batch["text_a"], batch["text_b"], strict=True):
            if a != last:
                last, last_shingles = a, shingles(word_hashes(text_a))
            keep.append(similarity(last_shingles, shingles(word_hashes(text_b))) >= THRESHOLD)
        yield batch[["a", "b"]][np.array(keep, bool)]


def _alike(n: str, m: str):
    """Shingle counts that can reach the threshold."""
    return F.least(n, m) >= F.lit(THRESHOLD) * F.greatest(n, m)


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, node, n, sketch of every document, written once."""
    rows = docs.select(F.col("doc_id").cast("long"), F.unhex(F.md5(F.encode(text_of(), "UTF-8"))).alias("text_key"), text_of().alias("text"))
    return materialize(rows.mapInArrow(_sketches, "doc_id long, text_key binary, node binary, n int, sketch array<long>"), "omh-sketches")


def links(docs: DataFrame, made: DataFrame) -> DataFrame:
    """Verified links (a, b) between nodes that suffice for the classes."""
    nodes = materialize(
        made.where("n > 0").groupBy("node").agg(F.min(F.struct("doc_id", "text_key")).alias("at"), F.first("n").alias("n"), F.first("sketch").alias("sketch")),
        "omh-nodes",
    )
    entries = nodes.select("node", "n", F.posexplode("sketch").alias("j", "v")).select("node", "n", F.xxhash64(F.least("j", F.lit(SKETCHES)), "v").alias("bucket")).distinct()
    shared = entries.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1")
    met = materialize(entries.join(shared, "bucket"), "omh-buckets")
    keyed = docs.select(F.col("doc_id").cast("long").alias("d"), F.unhex(F.md5(F.encode(text_of(), "UTF-8"))).alias("k"), text_of().alias("text"))

    def texts(wanted: DataFrame) -> DataFrame:
        """node, text of the wanted nodes."""
        which = materialize(nodes.join(wanted, "node", "left_semi").select("node", "at"), "omh-wanted")
        found = keyed.join(_small(which), F.col("d").eqNullSafe(F.col("at.doc_id")) & (F.col("k") == F.col("at.text_key")))
        return materialize(found.select("node", "text").dropDuplicates(["node"]), "omh-texts")

    def with_texts(pairs: DataFrame) -> DataFrame:
        found = texts(pairs.select(F.col("a").alias("node")).unionAll(pairs.select(F.col("b").alias("node"))).distinct())
        second = pairs.join(found.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
        return second.join(found.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")

    def verify(pairs: DataFrame) -> DataFrame:
        both = with_texts(pairs).select("a", "b", "text_a", "text_b")
        return materialize(both.mapInPandas(_verified, "a binary, b binary"), "omh-verified")

    def rooted(rows: DataFrame, classes: DataFrame, node: str, root: str) -> DataFrame:
        """Add the class of ``node`` as ``root``."""
        joined = rows.join(_small(classes.select(F.col("node").alias(node), F.col("root").alias("_root"))), node, "left")
        return joined.withColumn(root, F.coalesce("_root", node)).drop("_root")

    # the member that meets most others is the middle of its bucket
    meets = met.groupBy("node").agg(F.sum("members").alias("meets"))
    middles = met.join(meets, "node").groupBy("bucket").agg(F.max(F.struct("meets", "node", "n")).alias("r"))
    starred = materialize(met.join(middles.select("bucket", F.col("r.node").alias("centre"), F.col("r.n").alias("centre_n")), "bucket"), "omh-starred")
    star = starred.where((F.col("node") != F.col("centre")) & _alike("n", "centre_n"))
    tested = materialize(_pairs(star, "node", "centre"), "omh-star")
    found = verify(tested)

    # buckets that are not of one class yet
    classes = materialize(components(found, "omh-first"), "omh-classes")
    classed = materialize(rooted(starred, classes, "node", "root"), "omh-classed")
    mixed = classed.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("bucket")
    open_ = materialize(classed.join(mixed, "bucket"), "omh-open")
    few = open_.where(F.col("members") <= LARGE)
    other = few.select(F.col("node").alias("b"), F.col("n").alias("m"), F.col("root").alias("other"), "bucket")
    near = few.join(other, "bucket").where((F.col("root") != F.col("other")) & (F.col("node") < F.col("b")) & _alike("n", "m"))
    pairs = _pairs(near, "node", "b")

    # many members: by what they have other than the middle
    apart = open_.where((F.col("members") > LARGE) & (F.col("node") != F.col("centre"))).select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()
    differing = materialize(with_texts(materialize(apart, "omh-apart")).mapInPandas(_differences, _DIFFERENCES), "omh-differences")
    # of links, one with less than half in common with the middle, the other has less than 5/8
    strangers = differing.where("8 * common < 5 * n").select("node").distinct()
    whole = texts(strangers).mapInPandas(_shingled, _DIFFERENCES)
    parts = materialize(differing.where("2 * common >= n").unionAll(whole), "omh-parts")
    crowded = materialize(_by_parts(rooted(parts, classes, "node", "root")).unionAll(pairs).distinct().join(tested, ["a", "b"], "left_anti"), "omh-cross")
    found, tested = found.unionAll(verify(crowded)), tested.unionAll(crowded)

    # members with the middle's shingles in another order escape that bound: each is
    # compared to all with the middle's shingles, one of each middle in a round
    tight = parts.where((F.col("weight") <= F.col("n_centre")) & (F.length("centre") > 0)).select("centre", "node")
    done = None
    while True:
        classes = materialize(components(found, "omh-round"), "omh-classes")
        placed = rooted(rooted(tight, classes, "node", "root"), classes, "centre", "main")
        loose = placed.where("root <> main").select("centre", "node")
        if done is not None:
            loose = loose.join(done, ["centre", "node"], "left_anti")
        turn = materialize(loose.groupBy("centre").agg(F.min("node").alias("node")), "omh-turn")
        if turn.isEmpty():
            return found
        against = placed.join(rooted(turn, classes, "node", "its").withColumnRenamed("node", "it"), "centre").where("root <> its")
        pairs = materialize(_pairs(against, "node", "it").join(tested, ["a", "b"], "left_anti"), "omh-loose")
        found, tested = found.unionAll(verify(pairs)), tested.unionAll(pairs)
        done = turn if done is None else done.unionAll(turn)


def _small(table: DataFrame) -> DataFrame:
    """A materialised table, to be sent to all executors if it is small by count."""
    return F.broadcast(table) if table.count() <= SMALL_ROWS else table


def _pairs(rows: DataFrame, a: str, b: str) -> DataFrame:
    return rows.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


_DIFFERENCES = "centre binary, node binary, n int, n_centre int, common int, weight long, parts array<long>"


def _differences(batches):
    """For pairs of a middle (a) and a member (b): what either has and the other has not."""
    last, known = None, None
    for batch in batches:
        rows = []
        for a, b, text_a, text_b in zip(batch["a"], batch["b"], batch["text_a"], batch["text_b"], strict=True):
            if a != last:
                last, known = a, labels(shingles(word_hashes(text_a)))
            mine = labels(shingles(word_hashes(text_b)))
            common = np.intersect1d(mine, known)
            lost, won = len(known) - len(common), len(mine)
            parts = None
            if 2 * len(common) >= won:
                parts = np.concatenate([np.setdiff1d(known, common) ^ _MIX[1], np.setdiff1d(mine, common)]).view(np.int64)
            rows.append((a, b, won, len(known), len(common), 4 * won + 9 * lost - 4 * len(known), parts))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in _DIFFERENCES.split(", ")])


def _shingled(batches):
    """Members that have little in common with their middle: all their shingles."""
    for batch in batches:
        rows = []
        for node, text in zip(batch["node"], batch["text"], strict=True):
            mine = labels(shingles(word_hashes(text)))
            rows.append((b"", node, len(mine), 0, 0, 4 * len(mine), mine.view(np.int64)))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in _DIFFERENCES.split(", ")])


def _frequent(rows: DataFrame) -> np.ndarray:
    """The parts that most of a sample of members have, the most frequent last."""
    every = max(1, rows.count() // SAMPLED)
    each = rows.where(F.pmod(F.xxhash64("node"), F.lit(every)) == 0).select(F.explode("parts").alias("_often"))
    counted = each.groupBy("_often").agg(F.count("*").alias("n")).where("n > 2").orderBy(F.desc("n"), "_often").limit(FREQUENT)
    return np.array([r._often for r in counted.collect()][::-1], np.int64)


_PREFIXES = "centre binary, node binary, root binary, n int, n_centre int, weight long, most int, short int, long int, prefix array<long>"


def _prefixes(frequent: np.ndarray):
    """For each member as much of its parts as must be looked at: ``short`` of them by those
    that are found, ``long`` by those that look (none for the middle's near copies)."""
    order = np.argsort(frequent)
    known, place = np.append(frequent[order], np.iinfo(np.int64).max), np.append(order + 1, 0)

    def made(batches):
        for batch in batches:
            rows = []
            for centre, node, root, n, n_centre, weight, parts in batch.itertuples(index=False):
                short = long = len(parts) - (4 * n + 4) // 5 + 1
                if centre:
                    short, long = len(parts) - weight // 9, len(parts) - (weight - n_centre + 8) // 9 + 1 if weight > n_centre else 0
                if max(short, long) > 0:
                    parts = np.asarray(parts, np.int64)
                    at = np.searchsorted(known, parts)
                    late = np.where(known[at] == parts, place[at], 0)
                    rows.append((centre, node, root, n, n_centre, weight, len(parts), short, long, parts[np.lexsort((parts, late))[: max(short, long)]]))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _PREFIXES.split(", ")])

    return made


def _by_parts(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) that can reach the threshold, by prefixes of their parts.

    With d shingles of the middle (of n_c) missing, a member of n has the weight
    w = 4 n + 9 d - 4 n_c; two members are links only if 9 times the number of their common
    parts is w + w' - n_c or more.  The middle itself reaches the threshold with a member
    exactly if w <= n_c.  So of two members in doubt one has w > n_c, and both must have
    that many parts and share one in their prefixes; at the first that they share, what
    follows in both must be enough, too.  Parts that only members of one class have in
    their prefixes are left out.
    """
    rows = materialize(rows.select("centre", "node", "root", "n", "n_centre", "weight", "parts"), "omh-placed")
    made = materialize(rows.mapInPandas(_prefixes(_frequent(rows)), _PREFIXES), "omh-prefixes")
    each = made.select("*", F.posexplode("prefix").alias("nth", "part")).drop("prefix")
    probes = F.col("nth") < F.col("long")
    shared = each.groupBy("centre", "part").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.max(probes).alias("probed")).where("lo <> hi and probed")
    told = materialize(each.join(shared.select("centre", "part"), ["centre", "part"]), "omh-told")
    index = told.where("nth < short").select("centre", "part", *[F.col(c).alias(f"{c}_b") for c in ("node", "root", "n", "weight", "most", "nth")])
    enough = F.expr("9 * least(most - nth, most_b - nth_b) >= weight + weight_b - n_centre")
    met = told.where(probes).join(index, ["centre", "part"]).where((F.col("root") != F.col("root_b")) & enough & _alike("n", "n_b"))
    return _pairs(met, "node", "node_b")


def classed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_key, node of every document; node, root of every linked node)."""
    with Scratch() as scratch:
        sketched = sketches(docs)
        classes = materialize(components(links(docs, sketched), "omh"), "omh-roots")
        made = materialize(sketched.select("doc_id", "text_key", "node"), "omh-nodes-of")
        scratch.leave(made.join(classes, "node", "left"))
    return made, classes


def near_duplicates(docs: DataFrame) -> DataFrame:
    """A row for each document: doc_id, class_id, class_size, kept."""
    made, classes = classed(docs)
    rows = made.select("doc_id", "node").join(classes, "node", "left").select("doc_id", F.coalesce("root", "node").alias("root"))
    groups = rows.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    return rows.join(groups, "root").select("doc_id", "class_id", "class_size", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: of each class the first by id (then by text)."""
    made, classes = classed(docs)
    rows = made.select("doc_id", "text_key", F.col("node")).join(classes, "node", "left")
    firsts = rows.groupBy(F.coalesce("root", "node").alias("root")).agg(F.min(F.struct(_known("doc_id").alias("d"), F.col("text_key").alias("k"))).alias("at")).select(F.col("at.d").alias("_omh_d"), F.col("at.k").alias("_omh_k"))
    keyed = docs.withColumns({"_omh_d": _known("doc_id"), "_omh_k": F.unhex(F.md5(F.encode(text_of(), "UTF-8")))})
    return keyed.join(firsts, ["_omh_d", "_omh_k"], "left_semi").dropDuplicates(["_omh_d", "_omh_k"]).select(*docs.columns)


def _known(identity: str):
    """An id that joins: null is larger than any."""
    return F.coalesce(F.col(identity).cast("long"), F.lit((1 << 63) - 1))
