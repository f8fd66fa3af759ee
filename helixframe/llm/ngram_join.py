"""N-gram Jaccard self-join with token-combination prefixes.

Tokens (shingles) have one global order: by document frequency (powers of two), then
hash. Two similar
sets of sizes n miss at most tau = n - ceil(t n) of each other's tokens, so their prefixes
share a signature if tau + 1 removals are needed to break a prefix. A rare token is a
signature by itself and counts 1. A frequent one (in ``frequent_share`` of all documents
or more) only is one together with another of its class, where classes cut the frequent
tokens by hash into more parts for larger sets; c tokens of a class count c - 1, so
prefixes that reach into frequent tokens are extended. Sets of fewer than
``combine_from`` tokens have too few for classes and index all tokens singly. The two
parameters decide the work, not the result. Tokens of one document are never sent.

Equal sets are one class throughout; signatures, links and components join classes.
Candidates of a signature are first paired with its least altered class (a star), verified
on whole sets and merged into components; what a signature still has in different
components is then paired in full, where sizes, places and bitmaps of the sets allow
the overlap, and verified, so that no link between components is lost.

Null or empty texts have an empty set and link with nothing; null ids take part and
are no component's id unless all are null; repeated rows give repeated results, and
rows of one id with different texts are documents of their own; an empty table gives an
empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from helixframe.llm import chunks
from helixframe.llm.components import components
from helixframe.llm.rows import boxed, unboxed
from helixframe.llm.text import LOWER, mix, shingle_set, word_hashes
from helixframe.session import materialise

FREQUENT_SHARE = 1 / 64  # of the documents
BITS = 2048  # slots of a set's bitmap
COMBINE_FROM = 64  # tokens of a set from which frequent ones are combined


def need(n: int, percent: int) -> int:
    """Removals after which a prefix may hold no signature: tau + 1."""
    return n - -(-percent * n // 100) + 1


def levels(n: int, percent: int) -> range:
    """log2 of the sizes that a set of n tokens may be similar to."""
    return range((-(-percent * n // 100)).bit_length() - 1, (100 * n // percent).bit_length())


def parts(level: int) -> int:
    return max(1, 2 ** level // 12)


def part_of(tokens: np.ndarray, level: int) -> np.ndarray:
    return (mix(tokens ^ np.uint64(0x517CC1B727220A95)) % np.uint64(parts(level))).astype(np.int64)


def signatures(tokens: np.ndarray, shared: np.ndarray, frequency: np.ndarray, percent: int, frequent: int,
               combine_from: int = COMBINE_FROM) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of a set and their places; ``shared`` and ``frequency`` (log2) tell of its tokens, ``frequent`` (log2) where frequent ones begin.

    The place bounds the common tokens: if a signature is the first that two sets share, by
    the rank of its last token, at most n - place tokens are common. No rare token before it
    is, and of the frequent ones before it at most one per class.
    """
    n, want = len(tokens), need(len(tokens), percent)
    if n - int(shared.sum()) >= want:  # the prefix is filled with tokens of this document alone
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    order = np.lexsort((tokens, frequency))
    t, s, f = tokens[order], shared[order], frequency[order]
    out, places, plain = [], [], False
    for level in levels(n, percent):
        combined = (f >= frequent) & (2 ** level >= combine_from)
        if plain and not combined[:want].any():
            continue
        counts = np.ones(n, np.int64)
        where = np.flatnonzero(combined)
        p = part_of(t[where], level)
        _, first = np.unique(p, return_index=True)
        counts[where[first]] = 0
        stop = int(np.searchsorted(np.cumsum(counts), want)) + 1
        single = np.flatnonzero(~combined[:stop] & s[:stop])
        out.append(mix(t[single]))
        places.append(single)
        inside = where < stop
        for q in np.unique(p[inside]):
            ranks = where[inside & (p == q)]
            own = t[ranks]
            a, b = np.triu_indices(len(own), 1)
            lo, hi = np.minimum(own[a], own[b]), np.maximum(own[a], own[b])
            out.append(mix(lo * np.uint64(0x9E3779B97F4A7C15) + hi + np.uint64(level)))
            places.append(np.maximum(0, ranks[b] - parts(level)))
        plain |= not combined[:stop].any()
    found, places = np.concatenate(out), np.concatenate(places)
    order = np.lexsort((places, found))
    found, first = np.unique(found[order], return_index=True)
    return found, places[order][first]


def bitmap(tokens: np.ndarray) -> np.ndarray:
    """Which of BITS hash slots the set occupies, as 64-bit words."""
    used = np.zeros(BITS, bool)
    used[(tokens & np.uint64(BITS - 1)).astype(np.int64)] = True
    return np.packbits(used).view(np.int64)


def set_of(text: bytes, k: int) -> np.ndarray:
    return shingle_set(word_hashes(text.translate(LOWER)), k)


def class_of(tokens: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(tokens.tobytes())


def counted(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    values, counts = np.unique(prints, return_counts=True)
    return values, counts.astype("<u4")


def _keys(k: int, buckets: int):
    """Each chunk's tokens by bucket: distinct prints and in how many of its documents each stands."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, body in zip(batch["chunk"].to_pylist(), batch["body"].to_pylist()):
                to, prints = chunks.place(np.concatenate([set_of(t, k) for t in chunks.unpack_texts(body)]), buckets)
                rows = [(b, chunks.dump(*counted(prints[at]))) for b, at in chunks.by_bucket(to, buckets)]
                yield pa.RecordBatch.from_arrays([pa.array([chunk] * len(rows), pa.int64()), pa.array([b for b, _ in rows], pa.int32()),
                                                  pa.array([d for _, d in rows], pa.binary())], ["chunk", "bucket", "body"])
    return run


def _frequencies(table: pa.Table) -> pa.Table:
    """Per chunk, which of its keys other documents hold too, and log2 of in how many."""
    bucket, chunk_ids = table["bucket"][0].as_py(), table["chunk"].to_pylist()
    pairs = [chunks.load(b, "<u4", "<u4") for b in table["body"].to_pylist()]
    values, back = np.unique(np.concatenate([p for p, _ in pairs]), return_inverse=True)
    counts = np.bincount(back, np.concatenate([c for _, c in pairs]), len(values))
    values, log = values[counts > 1], np.floor(np.log2(counts[counts > 1])).astype(np.uint8)
    bodies = []
    for p, _ in pairs:
        at = np.minimum(np.searchsorted(values, p), max(0, len(values) - 1))
        own = at[values[at] == p] if len(values) else at[:0]
        bodies.append(chunks.dump(values[own], log[own]))
    return pa.table([pa.array(chunk_ids, pa.int64()), pa.array([bucket] * len(chunk_ids), pa.int32()), pa.array(bodies, pa.binary())],
                    names=["chunk", "bucket", "body"])


def _signatures(k: int, percent: int, buckets: int, frequent: int, combine_from: int):
    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        keys, logs = [], []
        for b, body in zip(answers["bucket"].to_pylist(), answers["body"].to_pylist()):
            p, log = chunks.load(body, "<u4", "u1")
            keys.append((np.uint64(b) << np.uint64(32)) | p.astype(np.uint64))
            logs.append(log)
        keys, logs = np.concatenate(keys or [np.empty(0, np.uint64)]), np.concatenate(logs or [np.empty(0, np.uint8)])
        order = np.argsort(keys)
        keys, logs = np.append(keys[order], np.uint64(2 ** 64 - 1)), np.append(logs[order], 0)
        seen, found, places, owners, sizes, tokens, bits = set(), [], [], [], [], [], []
        ids, versions, every_size, every_class = sum(texts["ids"].to_pylist(), []), sum(texts["sizes"].to_pylist(), []), [], []
        for body in texts["body"].to_pylist():
            for text in chunks.unpack_texts(body):
                s = set_of(text, k)
                name = class_of(s)
                every_size.append(len(s))
                every_class.append(name)
                if not len(s) or name in seen:
                    continue
                seen.add(name)
                wanted = chunks.join_key(*chunks.place(s, buckets))
                at = np.searchsorted(keys, wanted)
                shared = keys[at] == wanted
                sig, place = signatures(s, shared, np.where(shared, logs[at], 0), percent, frequent, combine_from)
                if len(sig):
                    owners.append(name)
                    found.append(sig.view(np.int64))
                    places.append(place.astype(np.int32))
                    bits.append(bitmap(s))
                    sizes.append(len(s))
                    tokens.append(s.view(np.int64))
        rest = len(owners)
        return pa.table([pa.array([*owners, None], pa.binary()), pa.array([*sizes, None], pa.int64()), pa.array([*found, None], pa.list_(pa.int64())),
                         pa.array([*places, None], pa.list_(pa.int32())), pa.array([*tokens, None], pa.list_(pa.int64())), pa.array([*bits, None], pa.list_(pa.int64())),
                         *[pa.array([None] * rest + [x], pa.list_(pa.int64())) for x in (ids, versions, every_size)],
                         pa.array([None] * rest + [every_class], pa.list_(pa.binary()))],
                        names=["class", "n", "signatures", "places", "tokens", "bits", "ids", "versions", "sizes", "classes"])
    return run


def _fits(a: str, b: str, percent: int):
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _may_overlap(percent: int) -> Column:
    """Bounds on the overlap of sets x and y: by the places of a first shared signature, then by slots only one side occupies."""
    wanted = percent * (F.col("n_x") + F.col("n_y"))
    def enough(overlap: Column) -> Column:
        return overlap * (100 + percent) >= wanted
    def alone(a: str, b: str) -> Column:
        # Written out word by word: compiled, where a higher-order function would be interpreted for every pair.
        return reduce(lambda s, i: s + F.bit_count(F.get(a, F.lit(i)).bitwiseAND(F.bitwise_not(F.get(b, F.lit(i))))), range(BITS // 64), F.lit(0))
    return (enough(F.least(F.col("n_x") - F.col("place_x"), F.col("n_y") - F.col("place_y")))
            & enough(F.least(F.col("n_x") - alone("bits_x", "bits_y"), F.col("n_y") - alone("bits_y", "bits_x"))))


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of classes whose sets are similar enough."""
    def side(x: str) -> DataFrame:
        return sets.select(F.col("class").alias(x), F.col("tokens").alias(f"t_{x}"))
    both = F.size(F.array_intersect("t_a", "t_b"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", both.alias("i"), (F.size("t_a") + F.size("t_b")).alias("n"))
    return joined.filter(100 * F.col("i") >= percent * (F.col("n") - F.col("i"))).select("a", "b")


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, percent: int = 85, **work) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable by links)."""
    return _grouped(docs, id_col, text_col, k, percent, **work).select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("first.doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def _grouped(docs: DataFrame, id_col: str, text_col: str, k: int, percent: int, frequent_share: float = FREQUENT_SHARE, combine_from: int = COMBINE_FROM) -> DataFrame:
    """doc_id, version (hash of the text), n_shingles and ``first``, the smallest (doc_id, version) of the component, per document."""
    buckets = chunks.bucket_count(docs.sparkSession)
    packs = chunks.pack(docs, None, id_col, text_col, "join-packs", F.xxhash64(text_col))
    total = packs.agg(F.sum(F.size("ids"))).first()[0] or 0
    frequent = max(1, int(max(2, frequent_share * total)).bit_length() - 1)
    keys = packs.select("chunk", "body").mapInArrow(_keys(k, buckets), "chunk long, bucket int, body binary")
    heard = chunks.answer(keys, ["bucket"], _frequencies, "chunk long, bucket int, body binary")
    schema = ("class binary, n long, signatures array<long>, places array<int>, tokens array<long>, bits array<long>, "
              "ids array<long>, versions array<long>, sizes array<long>, classes array<binary>")
    both = materialise(chunks.rejoin(packs, heard, _signatures(k, percent, buckets, frequent, combine_from), schema), "join-signatures")
    own = both.filter("class IS NOT NULL")
    sets = own.select("class", "tokens").dropDuplicates(["class"])
    rows = own.select("class", "n", F.explode(F.arrays_zip("signatures", "places")).alias("s")).select("class", "n", F.col("s.signatures").alias("sig"), F.col("s.places").alias("place"))

    # Star: every class of a signature with the one that has the fewest rarer tokens, the least altered copy.
    ends = rows.groupBy("sig").agg(F.min(F.struct("place", "class", "n")).alias("lo"), F.min("class").alias("first"), F.max("class").alias("last"))
    ends = ends.filter(F.col("first") != F.col("last"))
    lists = materialise(ends.select("sig", F.col("lo.class").alias("a"), F.col("lo.n").alias("n_a")), "join-lists")
    members = materialise(rows.join(lists, "sig").select("sig", "place", F.col("class").alias("b"), "n", "a", "n_a").distinct(), "join-members")
    tried = materialise(members.filter("a != b").filter(_fits("n", "n_a", percent)).select("a", "b").distinct(), "join-stars")
    needed = tried.select(F.col("a").alias("class")).union(tried.select(F.col("b").alias("class"))).distinct()
    links = materialise(_verify(tried, sets.join(needed, "class", "left_semi"), percent), "join-links")
    roots = materialise(components(links), "join-roots")

    # What is left: members outside the main component of a signature, with all members of other components.
    at = members.select("sig", "place", "b", "n").join(roots, F.col("b") == F.col("node"), "left").select("sig", "place", "b", "n", F.coalesce("root", "b").alias("root"))
    main = at.groupBy("sig", "root").agg(F.count(F.lit(1)).alias("m")).groupBy("sig").agg(F.max_by("root", "m").alias("main"), F.count(F.lit(1)).alias("roots"))
    maps = own.select(F.col("class").alias("b"), "bits").dropDuplicates(["b"])
    open_lists = materialise(at.join(main.filter("roots > 1").select("sig", "main"), "sig").join(maps, "b"), "join-open")
    def side(df: DataFrame, x: str) -> DataFrame:
        return df.select("sig", F.col("b").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("n", "place", "root", "bits")], *(["main"] if x == "y" else []))
    apart = F.expr("root_x != root_y and (root_y = main or x < y)")
    more = (side(open_lists.filter("root != main"), "x").join(side(open_lists, "y"), "sig").filter(apart & _fits("n_x", "n_y", percent) & _may_overlap(percent))
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    more = materialise(more.join(tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti"), "join-rest")
    needed = more.select(F.col("a").alias("class")).union(more.select(F.col("b").alias("class"))).distinct()
    late = materialise(_verify(more, sets.join(needed, "class", "left_semi"), percent), "join-late-links")
    if late.limit(1).count():
        roots = components(links.unionByName(late))

    each = both.filter("class IS NULL").select(F.explode(F.arrays_zip("ids", "versions", "sizes", "classes")).alias("d"))
    each = each.select(F.col("d.ids").alias("doc_id"), F.col("d.versions").alias("version"), F.col("d.sizes").alias("n_shingles"), F.col("d.classes").alias("class"))
    placed = each.join(roots, F.col("class") == F.col("node"), "left").select("doc_id", "version", "n_shingles", F.coalesce("root", "class").alias("root"))
    placed = materialise(placed, "join-placed")
    # null ids come last; written first, so that the join sees two plain sides and can split a large component
    least = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "version")).alias("first")
    first = materialise(placed.filter("n_shingles > 0").groupBy("root").agg(least), "join-firsts")
    return placed.join(first, "root", "left").drop("root")


def apply(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """One document of each group, the smallest by id, then by text hash, in the input's columns.

    Rows equal in id and text are one document, of which one row stays; rows of one id
    with unlike texts are decided each for itself. Rows without a shingle or an id stay.
    """
    p = {"k": 4, "percent": 85} | params
    groups = _grouped(docs, id_col, text_col, **p).filter("n_shingles > 0 AND doc_id IS NOT NULL")
    groups = materialise(groups.select("doc_id", "version", ((F.col("doc_id") == F.col("first.doc_id")) & (F.col("version") == F.col("first.version"))).alias("stays")), "join-groups")
    lost = groups.filter("NOT stays").select("doc_id", "version").distinct()
    rows = boxed(docs, id=F.col(id_col).cast("long"), text_hash=F.xxhash64(text_col))
    same = (F.col("id") == F.col("doc_id")) & (F.col("text_hash") == F.col("version"))
    kept = rows.join(lost, same, "left_anti")
    again = materialise(groups.filter("stays").groupBy("doc_id", "version").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "join-again")
    if again.limit(1).count():
        once = kept.join(again, same, "left_semi").dropDuplicates(["id", "text_hash"])
        kept = kept.join(again, same, "left_anti").unionByName(once)
    return unboxed(kept, docs.columns)
