"""Near duplicates by MinHash, with sequential Bayesian verification of banded candidates.

A document's set holds the hashes (64 bits) of its shingles.  Documents with one set form a class (its key has 128 bits); one
node per class goes on.  MinHash signatures are cut into ``BANDS`` bands of ``ROWS`` values; a pair at the least similarity 0.8
meets in no band with probability (1 - 0.8 ** 5) ** 36, below 1e-6.

Inside a band bucket members are compared with the bucket's smallest member, so a large group of copies costs a few pairs a
member: first each node with the smallest hub of all its buckets, then, across components only, with its other hubs.  Candidates
are judged by batches of signature values: with a uniform prior, the similarity after m matches of n has a Beta
posterior, and a pair goes as soon as its chance of reaching the threshold falls below ``MISS``.  Survivors are verified exactly on
their full sets, which only their documents send through a shuffle.

Buckets that still hold several components are left to an exact join of their documents: shingles are ordered from rare to
common, and a pair needs a common shingle in both prefixes, early enough in both sets.  A group of loose variants of one text thus
yields the few pairs that share their rarer parts, not all pairs, and none is missed: no cap on buckets or candidates.

Components come from alternating joins that pull every node to its smallest neighbour; group counts are aggregated before each
shuffle and hot keys meet only in joins that Spark can split.  Nothing about documents reaches the driver but row counts.

Defined results: a null or empty text has an empty set and links with nothing; a row with a null id is never linked and is its own
kept document (its component is null); rows that share an id are one document; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.common import written as materialise
from tidewell.llm.words import WordHasher, mix, series, shingles

WORDS = 5
SIMILARITY = 80  # percent
ROWS, BANDS = 5, 36
CHECKED, BATCH = 128, 16  # signature values that verification reads, and how many at a time
MISS = 1e-6


def least_matches(similarity: int = SIMILARITY, miss: float = MISS) -> list[int]:
    """After each batch: the fewest matches that leave a chance of ``miss`` or more to reach ``similarity``.

    With a uniform prior, P(s >= t | m of n) is the chance of at most m successes in n + 1 trials of t.
    """
    t, need = similarity / 100, []
    for n in range(BATCH, CHECKED + 1, BATCH):
        below, m = 0.0, -1
        while below < miss:
            m += 1
            below += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        need.append(m)
    return need


def _minhash(values: np.ndarray, scale: np.ndarray, shift: np.ndarray) -> np.ndarray:
    low = (values >> np.uint64(32)).astype(np.uint32)
    best = np.full(len(scale), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 2048):
        np.minimum(best, (scale * low[None, at:at + 2048] + shift).min(axis=1), out=best)
    return best


def signatures(docs: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """Per row: ``doc_id``, ``n_shingles``, class key ``k1, k2``, ``sig`` (CHECKED values, 16 bits each) and band hashes."""
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    id_type = rows.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        count = ROWS * BANDS
        scale = ((series(3, count) >> np.uint64(32)).astype(np.uint32) | np.uint32(1))[:, None]
        shift = (series(4, count) >> np.uint64(32)).astype(np.uint32)[:, None]
        band_seed = series(5, BANDS)
        for batch in batches:
            n, k1, k2, sigs, bands = [], [], [], [], []
            for _, hashes, bounds in hasher.column(batch.column(1)):
                for a, b in zip(bounds[:-1], bounds[1:]):
                    s = shingles(hashes[a:b], words)
                    n.append(len(s))
                    if not len(s):
                        for out in (k1, k2, sigs, bands):
                            out.append(None)
                        continue
                    k1.append(int(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum().view(np.int64)))
                    k2.append(int(mix(s ^ np.uint64(0x14057B7EF767814F)).sum().view(np.int64)))
                    best = _minhash(s, scale, shift)
                    sigs.append(best[:CHECKED].astype(np.uint16).tobytes())
                    folded = band_seed.copy()
                    for row in best.reshape(BANDS, ROWS).T.astype(np.uint64):
                        folded = mix(folded ^ row)
                    bands.append(folded.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()),
                 pa.array(sigs, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "k1", "k2", "sig", "bands"])

    return rows.mapInArrow(
        run, f"doc_id {id_type}, n_shingles long, k1 long, k2 long, sig binary, bands array<long>")


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """``doc_id`` and ``shingles`` (distinct hashes) of rows (doc_id, text)."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            for first, hashes, bounds in hasher.column(batch.column(1)):
                sets = [shingles(hashes[a:b], words).view(np.int64) for a, b in zip(bounds[:-1], bounds[1:])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(sets)), pa.array(sets, pa.list_(pa.int64()))], ["doc_id", "shingles"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, shingles array<long>")


def plausible(pairs: DataFrame, nodes: DataFrame, similarity: int) -> DataFrame:
    """Pairs (hub, rep) that no batch of signature values makes implausible."""
    need = least_matches(similarity)
    sig = lambda name: nodes.select(F.col("rep").alias(name), F.col("sig").alias(f"{name}_sig"))
    both = pairs.join(sig("rep"), "rep").join(sig("hub"), "hub").select("hub", "rep", "hub_sig", "rep_sig")
    id_type = both.schema["hub"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, CHECKED) for i in (2, 3))
            alive, matches = np.arange(len(a)), np.zeros(len(a), np.int64)
            for step, least in enumerate(need):
                part = slice(step * BATCH, (step + 1) * BATCH)
                matches = matches + (a[alive, part] == b[alive, part]).sum(axis=1)
                alive, matches = alive[matches >= least], matches[matches >= least]
            yield pa.RecordBatch.from_arrays([batch.column(i).take(pa.array(alive)) for i in (0, 1)], ["hub", "rep"])

    return both.mapInArrow(run, f"hub {id_type}, rep {id_type}")


def verified(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """Pairs whose full sets reach the similarity."""
    side = lambda name: sets.select(F.col("doc_id").alias(name), F.col("shingles").alias(f"{name}_set"))
    both = pairs.join(side("rep"), "rep").join(side("hub"), "hub")
    shared = F.size(F.array_intersect("hub_set", "rep_set")).cast("long")
    union = F.size("hub_set") + F.size("rep_set") - shared
    # not made distinct here: an aggregate by hub would keep Spark from splitting a hub that many pairs name
    return both.where(shared * 100 >= union * similarity).select("hub", "rep")


def components(edges: DataFrame, label: str = "edges") -> DataFrame:
    """``node``, ``root`` (the smallest node it reaches) for every node that is not its own root; edges are (low, high)."""
    edges = materialise(edges.select("low", "high").where("low < high").distinct(), label)
    while True:
        least = edges.groupBy("high").agg(F.min("low").alias("least"))
        # every node points to its smallest neighbour, and its other neighbours join that one
        joined = edges.join(least, "high")
        sideways = joined.where("low > least").select(F.col("least").alias("low"), F.col("low").alias("high"))
        star = least.select(F.col("least").alias("low"), "high").unionByName(sideways).distinct()
        star = materialise(star, label)
        # then to the smallest neighbour of that neighbour
        up = star.groupBy("high").agg(F.min("low").alias("upper")).withColumnRenamed("high", "_mid")
        lifted = star.join(up, F.col("low") == F.col("_mid"), "left")
        lifted = materialise(lifted.select(F.coalesce("upper", "low").alias("low"), "high", F.col("upper").isNotNull().alias("moved")).distinct(), label)
        counts = lifted.agg(F.count(F.lit(1)), F.count_distinct("high"), F.coalesce(F.max("moved"), F.lit(False))).first()
        edges = lifted.select("low", "high").distinct()
        if counts[0] == counts[1] and not counts[2]:
            return lifted.select(F.col("high").alias("node"), F.col("low").alias("root"))


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, similarity: int = SIMILARITY
) -> DataFrame:
    """Per row: ``key``, ``n_shingles``, ``component_id`` (smallest id reachable) and ``kept`` (it is that one)."""
    rows = materialise(signatures(docs, key, text, words), "signatures")
    texts = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    usable = rows.where("n_shingles > 0 and doc_id is not null")
    classes = usable.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "sig", "bands")).alias("first"))
    nodes = materialise(classes.select("k1", "k2", "first.*").withColumnRenamed("doc_id", "rep"), "nodes")

    members = nodes.select("rep", F.explode("bands").alias("bucket"))
    buckets = members.groupBy("bucket").agg(F.min("rep").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    placed = materialise(members.join(buckets, "bucket"), "buckets")

    roots = None

    def root(column: str) -> Column:
        return F.coalesce(F.col(f"{column}_root"), F.col(column))

    def with_roots(frame: DataFrame, *columns: str) -> DataFrame:
        for c in columns:
            frame = frame.join(roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root")), c, "left")
        return frame

    def linked(pairs: DataFrame) -> DataFrame:
        """The pairs that are near duplicates."""
        left = materialise(plausible(pairs, nodes, similarity), "candidates")
        return verified(left, materialise(_sets_of(texts, left, words), "sets"), similarity)

    def take(found: DataFrame) -> DataFrame:
        """The components with more links."""
        edges = found.select(F.least("hub", "rep").alias("low"), F.greatest("hub", "rep").alias("high"))
        if roots is not None:
            edges = edges.unionByName(roots.select(F.col("root").alias("low"), F.col("node").alias("high")))
        return materialise(components(edges), "components")

    # first the bucket's smallest member: the smallest of them for every node, then those that are in other components
    starred = placed.where("rep != first").select(F.col("first").alias("hub"), "rep")
    nearest = materialise(starred.groupBy("rep").agg(F.min("hub").alias("hub")), "nearest")
    roots = take(materialise(linked(nearest).unionByName(_same_id(usable, nodes)), "links"))
    others = starred.distinct().join(nearest.withColumnRenamed("hub", "own"), "rep").where("hub != own").drop("own")
    others = with_roots(others, "hub", "rep").where(root("hub") != root("rep")).select("hub", "rep")
    others = materialise(others, "pairs")
    if not others.isEmpty():
        roots = take(materialise(linked(others), "links"))

    # what is left are buckets of several components: an exact join of their documents
    open_ = materialise(_open(with_roots(placed, "rep").select("bucket", "rep", root("rep").alias("root"))), "open")
    if not open_.isEmpty():
        ids = open_.select(F.col("rep").alias("doc_id"))
        sets = materialise(shingle_sets(texts.join(ids, "doc_id", "left_semi"), words).distinct(), "sets")
        close = materialise(_prefix_pairs(open_, sets, similarity), "pairs")
        left = materialise(plausible(close, nodes, similarity), "candidates")
        roots = take(materialise(verified(left, sets, similarity), "links"))
    return _labelled(rows, nodes, roots, key)


def _open(placed: DataFrame) -> DataFrame:
    """Documents of buckets that hold several components: ``rep``, ``root`` and ``odd`` (outside the largest one somewhere)."""
    parts = placed.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n"))
    main = parts.groupBy("bucket").agg(F.max(F.struct("n", "root"))["root"].alias("main"), F.count(F.lit(1)).alias("parts"))
    here = placed.join(main.where("parts > 1"), "bucket")
    return here.groupBy("rep", "root").agg(F.max(F.col("root") != F.col("main")).alias("odd"))


def _prefix_pairs(open_: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """Every pair (hub, rep) of different components, one of them odd, that the prefixes of their sets allow.

    Shingles are ordered by their number of documents here, rarest first.  Two sets of sizes a and b that reach the
    similarity t share at least t / (1 + t) * (a + b) shingles, so the first one they share leaves that many in both.
    """
    each = sets.select("doc_id", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle"))
    common = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("df"))
    order = Window.partitionBy("doc_id", "n").orderBy("df", "shingle")
    placed = each.join(common, "shingle").withColumn("at", F.row_number().over(order))
    prefix = placed.where((F.col("n") - F.col("at") + 1) * 100 >= F.col("n") * similarity)
    prefix = prefix.join(open_.withColumnRenamed("rep", "doc_id"), "doc_id").select("doc_id", "root", "odd", "n", "at", "shingle")
    prefix = materialise(prefix, "prefixes")
    left = prefix.where("odd").select("shingle", *[F.col(c).alias(f"a_{c}") for c in ("doc_id", "root", "n", "at")])
    right = prefix.select("shingle", *[F.col(c).alias(f"b_{c}") for c in ("doc_id", "root", "n", "at", "odd")])
    rest = F.least(F.col("a_n") - F.col("a_at"), F.col("b_n") - F.col("b_at")) + 1
    fits = (rest * (100 + similarity) >= (F.col("a_n") + F.col("b_n")) * similarity) & (F.col("a_root") != F.col("b_root"))
    once = ~F.col("b_odd") | (F.col("a_doc_id") < F.col("b_doc_id"))  # two odd ones meet from both sides
    pairs = left.join(right, "shingle").where(fits & once)
    return pairs.select(F.least("a_doc_id", "b_doc_id").alias("hub"), F.greatest("a_doc_id", "b_doc_id").alias("rep")).distinct()


def _same_id(usable: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links between the classes that hold rows of one id."""
    key = F.struct("k1", "k2")
    several = usable.groupBy("doc_id").agg(F.min(key).alias("a"), F.max(key).alias("b")).where("a != b").select("doc_id")
    rows = usable.select("doc_id", "k1", "k2").join(several, "doc_id", "left_semi")
    return rows.join(nodes.select("k1", "k2", "rep"), ["k1", "k2"]).where("rep != doc_id").select(
        F.col("rep").alias("hub"), F.col("doc_id").alias("rep"))


def _sets_of(texts: DataFrame, pairs: DataFrame, words: int) -> DataFrame:
    ids = pairs.select(F.explode(F.array("hub", "rep")).alias("doc_id")).distinct()
    return shingle_sets(texts.join(ids, "doc_id", "left_semi"), words).distinct()


def _labelled(rows: DataFrame, nodes: DataFrame, roots: DataFrame, key: str) -> DataFrame:
    """Give every row its component."""
    known = nodes.select("k1", "k2", "rep").join(roots, F.col("rep") == F.col("node"), "left")
    known = known.select("k1", "k2", F.coalesce("root", "rep").alias("component_id"))
    out = rows.select("doc_id", "n_shingles", "k1", "k2").join(known, ["k1", "k2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))).withColumnRenamed("doc_id", key)


def keep_one(docs: DataFrame, key: str = "doc_id", **more) -> DataFrame:
    """One document of each group, with all columns; rows without an id all stay, rows of one kept id become one."""
    found = near_duplicates(docs, key, **more)
    ids = found.where(F.col("kept") & F.col(key).isNotNull()).select(F.col(key).alias("_kept_id")).distinct()
    # rows of one id differ in what they hold: the same one stays whatever task runs again
    order = F.xxhash64(*[c for c, kind in docs.dtypes if "map<" not in kind])
    kept = docs.join(ids, F.col(key) == F.col("_kept_id"), "left_semi").groupBy(F.col(key).alias("_id")).agg(
        F.min_by(F.struct(*docs.columns), order).alias("_row")).select("_row.*")
    return kept.unionByName(docs.where(F.col(key).isNull()))


def oracle() -> str:
    """Two-word shingles, every pair that shares one, and the closure of the links."""
    return r"""
        with recursive words as (
            select doc_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x20\x09-\x0D]+') as w from documents),
        shingled as (
            select doc_id, list_distinct(case len(w) when 0 then [] when 1 then [w[1]]
                else list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) end) as s from words),
        classes as (
            select list_sort(s) as s, min(doc_id) as rep, list(doc_id) as ids from shingled where len(s) > 0 group by list_sort(s)),
        each as (select rep, len(s) as n, unnest(s) as shingle from classes),
        shared as (
            select a.rep as a, b.rep as b, any_value(a.n) + any_value(b.n) as total, count(*) as common
            from each a join each b on a.shingle = b.shingle and a.rep < b.rep
                and 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
            group by a.rep, b.rep),
        links as (select a, b from shared where 100 * common >= 80 * (total - common)),
        both_ways as (select a, b from links union all select b, a from links),
        reach as (
            select rep as node, rep as seen from classes
            union select reach.node, both_ways.b from reach join both_ways on reach.seen = both_ways.a),
        roots as (select node, min(seen) as root from reach group by node),
        placed as (select unnest(ids) as doc_id, root from classes join roots on node = rep)
        select shingled.doc_id, len(s)::bigint as n_shingles, coalesce(root, shingled.doc_id) as component_id,
            shingled.doc_id = coalesce(root, shingled.doc_id) as kept
        from shingled left join placed on placed.doc_id = shingled.doc_id"""
