"""Exact Jaccard join of documents on word 5-shingles, by filters under several global token orders.

1. One pass shingles every whole text: size, class key (hash of the whole set), four minima under
   pure hash orders, the packed set, and a sketch of token frequencies over all documents.
2. Star links: classes that share a minimum are compared with one class of that bucket only, so a
   group of thousands of near copies costs a few links each, not all pairs. Like all other candidates
   they must pass the prefix filters under every order before they're verified.
3. Completeness: under the first order (rare tokens first, then hash) two sets with Jaccard >= 0.75
   must share m tokens of their prefixes of n - ceil(0.75 n) + m tokens, for any m; m grows with n, so
   that long documents which share a few tokens by chance are no candidates. For pairs across
   components that share as many, parity bitmaps (set bits of the exclusive or never exceed the
   symmetric difference) must allow a link (tokens that very many classes share are compared by
   bitmap in tiles, so that their pairs never become rows), they must share as many prefix tokens under every other
   order, and what is left is verified exactly. Any order is correct, so an approximate frequency sketch is enough.
4. Connected components over the verified links.

Tokens are 64-bit hashes; packed sets keep 48 bits of each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, components, free_shuffles, pruning, settle, ship, slices

WORDS = 5
NUM, DEN = 75, 100
SEEDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)
ORDERS = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)
SKETCH_BITS = 18
PARITY_BITS = 2048
#: Seeds whose buckets are linked in one round; a round skips what earlier ones have joined, and its own
#: hash chooses the bucket's class that the others are compared with.
STAR_ROUNDS = ((0,), (1,), (2, 3), (0, 1, 2, 3))
#: Up to so many class keys (8 bytes each) a set of keys is broadcast to prune a scan; above, it is a shuffled join.
BROADCAST_KEYS = 500_000
#: Up to so many classes with their components (16 bytes each) are broadcast, so that postings carry components and packed sets aren't shuffled.
BROADCAST_GROUPS = 2_000_000
#: A prefix token of more classes than CROWD is compared in tiles of blocks of about TILE classes.
CROWD, TILE = 48, 1024
#: Postings are shuffled in so many turns, of a part of the tokens each: only a part of them is on disk at once.
TURNS = 3
#: Up to so many of a token's rows of one component are held to see whether another component has it.
MOST_HELD = 500_000
#: So many of a class's crowded tokens tell tiles which pairs another one has.
LOW_TOKENS = 64
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
ROW = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("k", T.LongType())]
    + [T.StructField(f"m{i}", T.LongType()) for i in range(len(SEEDS))]
    + [T.StructField("packed", T.BinaryType()), T.StructField("bits", T.BinaryType()), T.StructField("counts", T.ArrayType(T.IntegerType()))]
)
POSTING = "token long, comp long, k long, n long"


class WordHashes(dict):
    """Hash of each word, remembered; emptied when it grows beyond a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def shingle_set(text: bytes | None, hashes: WordHashes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes of a text; empty without words."""
    found = text.translate(_LOWER).split() if text else []
    if not found:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found))
    size = min(words, len(w))
    out = np.full(len(w) - size + 1, size, np.uint64)
    for i in range(size):
        out = out * np.uint64(0x9FB21C651E98DF25) + w[i : len(w) - size + 1 + i]
    out = mix(out)
    out.sort()
    return out[np.concatenate(([True], out[1:] != out[:-1]))] if len(out) > 1 else out


def pack(tokens: np.ndarray) -> bytes:
    """Sorted tokens' top 48 bits as differences, stored by byte plane: the upper planes compress away."""
    t = tokens >> np.uint64(16)
    d = np.concatenate((t[:1], t[1:] - t[:-1]))
    return d.view(np.uint8).reshape(-1, 8)[:, :6].T.tobytes()


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(6, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :6] = planes.T
    return np.cumsum(out.view(np.uint64).ravel(), dtype=np.uint64)


def parity(tokens: np.ndarray) -> bytes:
    """For each remainder by a power of two (PARITY_BITS, or the first that is no less than the size),
    whether an odd number of tokens has it."""
    size = max(PARITY_BITS, 1 << (len(tokens) - 1).bit_length())
    return np.packbits(np.bincount((tokens % np.uint64(size)).astype(np.int64), minlength=size).astype(np.uint8) & 1).tobytes()


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps (rows of 64-bit words) for fewer remainders: halves cancel where both are odd."""
    while bits.shape[-1] > words:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] ^ bits[..., half:]
    return bits


def order_keys(tokens: np.ndarray, levels: np.ndarray, seed: int) -> np.ndarray:
    """The global order of a seed: rarer level first, then hash."""
    level = levels[(tokens >> np.uint64(48 - SKETCH_BITS)).astype(np.int64)].astype(np.uint64)
    return (level << np.uint64(58)) | (mix(tokens * np.uint64(seed)) >> np.uint64(6))


def must_share(n: int) -> int:
    """Prefix tokens that a set of n shares with any set it is linked with (the smaller of both counts)."""
    return 1 + n // 64


def prefix_length(n: int) -> int:
    return n - -(-NUM * n // DEN) + must_share(n)


def prefix(tokens: np.ndarray, n: int, levels: np.ndarray, seed: int) -> np.ndarray:
    p = min(prefix_length(n), len(tokens))
    return tokens[np.argpartition(order_keys(tokens, levels, seed), p - 1)[:p]]


def _scan(batches):
    hashes, seen = WordHashes(), set()
    counts = np.zeros(1 << SKETCH_BITS, np.int64)
    schema = pa.schema([(f.name, pa.int64()) for f in ROW.fields[:-3]] + [("packed", pa.binary()), ("bits", pa.binary()), ("counts", pa.list_(pa.int32()))])
    for batch in batches:
        for part in slices(batch, 1):
            rows, tokens = [], []
            for text in part.column(1).cast(pa.binary()).to_pylist():
                s = shingle_set(text, hashes)
                if not len(s):
                    rows.append((0, 0, *[0] * len(SEEDS), None, None))
                    continue
                tokens.append(s)
                with np.errstate(over="ignore"):
                    key = int((mix(s * np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64) + np.uint64(len(s))).astype(np.int64))
                    low = [int(mix(s * np.uint64(x)).min().astype(np.int64)) for x in SEEDS]
                packed = bits = None
                if key not in seen:
                    if len(seen) > 100_000:
                        seen.clear()
                    seen.add(key)
                    packed, bits = pack(s), parity(s)
                rows.append((len(s), key, *low, packed, bits))
            if tokens:
                counts += np.bincount((np.concatenate(tokens) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(counts))
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, pa.int64()) for c in cols[:-2]], *[pa.array(c, pa.binary()) for c in cols[-2:]], pa.nulls(len(rows), pa.list_(pa.int32()))], schema=schema)
    for at in range(0, len(counts), 4096):
        row = pa.array([counts[at : at + 4096].clip(0, 2**31 - 1).tolist()], pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([-1], pa.int64()), *[pa.array([0], pa.int64())] * (1 + len(SEEDS)), *[pa.array([None], pa.binary())] * 2, row], schema=schema)


def _postings(levels: np.ndarray, turn: int):
    """Prefix tokens (token, comp, k, n) of rows (k, n, packed, comp) that are for this turn."""

    def run(batches):
        for batch in batches:
            for part in map(pa.RecordBatch.to_pydict, slices(batch, 2)):
                tokens = [prefix(unpack(x), n, levels, ORDERS[0]) for x, n in zip(part["packed"], part["n"], strict=True)]
                tokens = [t[t % np.uint64(TURNS) == turn] for t in tokens]
                if tokens:
                    sizes = [len(t) for t in tokens]
                    rows = [np.repeat(np.array(part[c], np.int64), sizes) for c in ("comp", "k", "n")]
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).astype(np.int64)), *map(pa.array, rows)], names=["token", "comp", "k", "n"])

    return run


def _shared(batches):
    """Of rows (token, class or component, ...) sorted by all columns, the distinct ones of tokens that several classes or components have.

    A token's rows are held until it shows a second component; of one with very many rows they're let through.
    """
    held, count, mixed, last = [], 0, False, None  # of the last token: rows held, how many, whether its rows go out; its last row
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        before = rows[:, :-1] if last is None else np.concatenate((last, rows[:, :-1]), 1)
        new = (rows[:, rows.shape[1] - before.shape[1] :] != before).any(0)
        previous, last, rows = last, rows[:, -1:], rows[:, np.concatenate(([True], new)) if last is None else new]
        if not rows.shape[1]:
            continue
        starts = np.flatnonzero(np.concatenate(([True], rows[0, 1:] != rows[0, :-1])))
        several = np.minimum.reduceat(rows[1], starts) < np.maximum.reduceat(rows[1], starts)
        out = []
        if previous is not None and previous[0, 0] == rows[0, 0]:
            several[0] |= mixed or previous[1, 0] != rows[1, 0] or count > MOST_HELD
            out = held if several[0] else []
        if several[0] or len(starts) > 1 or previous is None or previous[0, 0] != rows[0, 0]:
            held, count = [], 0
        mixed = bool(several[-1])
        if not mixed:
            held = [*held, rows[:, starts[-1] :]]
            count += rows.shape[1] - int(starts[-1])
        out = np.concatenate([*out, rows[:, np.repeat(several, np.diff(np.append(starts, rows.shape[1])))]], 1)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=batch.schema.names)


def linked(a: np.ndarray, b: np.ndarray, n_a: int, n_b: int, levels: np.ndarray) -> bool:
    """Filters under all orders, then the exact test."""
    for seed in ORDERS:
        if len(np.intersect1d(prefix(a, n_a, levels, seed), prefix(b, n_b, levels, seed), assume_unique=True)) < min(must_share(n_a), must_share(n_b)):
            return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return DEN * both >= NUM * (n_a + n_b - both)


def _verify(levels: np.ndarray):
    def run(batches):
        for batch in batches:
            for part in slices(batch, 4):
                p = part.to_pydict()
                keep = [linked(unpack(x), unpack(y), n, m, levels) for x, y, n, m in zip(p["packed_a"], p["packed_b"], p["n_a"], p["n_b"], strict=True)]
                yield part.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def _may_link(batches):
    for batch in batches:
        keep = []
        for x, y, n in zip(batch.column("bits_a").to_pylist(), batch.column("bits_b").to_pylist(), (batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy()).tolist(), strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            words = min(len(x), len(y))
            keep.append(int(np.bitwise_count(folded(x, words) ^ folded(y, words)).sum()) <= n - 2 * -(-NUM * n // (NUM + DEN)))
        yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep, pa.bool_())) for c in ("a", "b")], names=["a", "b"])


def _tile_pairs(batches):
    """Pairs (a, b) of different components that the bitmaps allow, within rows of equal (token, i, j).

    Rows come sorted by these; a tile i < j holds two blocks, whose rows are compared with each other. A
    pair is left to the tile of a smaller token where both rows' `low` (their first crowded tokens) show one.
    """
    rows: list[tuple] = []
    key = None

    def pairs():
        k, n, comp = (np.array([r[c] for r in rows], np.int64) for c in (0, 1, 2))
        words = np.array([len(r[3]) // 8 for r in rows])
        second = np.array([r[4] for r in rows]) == key[2]
        first = ~second if key[1] != key[2] else np.ones(len(rows), bool)
        lower = [{t for t in r[5] if t < key[0]} for r in rows]
        found = [np.zeros((2, 0), np.int64)]
        sizes = sorted(set(words.tolist()))
        bits = {w: np.frombuffer(b"".join([rows[r][3] for r in np.flatnonzero(words == w)]), np.uint64).reshape(-1, w) for w in sizes}
        for w in sizes:  # a bitmap is compared with those of its size and of the next one on either side
            for v in (w // 2, w, w * 2):
                left, right = np.flatnonzero(words == w), np.flatnonzero(words == v)
                if not len(right):
                    continue
                x_bits, y_bits = folded(bits[w], min(v, w))[first[left]], folded(bits[v], min(v, w))[second[right]]
                left, right = left[first[left]], right[second[right]]
                step = max(1, 2_000_000 // max(1, y_bits.size))
                for at in range(0, len(left) if len(right) else 0, step):
                    x = left[at : at + step]
                    both = n[x][:, None] + n[right]
                    least = -(-NUM * both // (NUM + DEN))
                    near = (np.bitwise_count(x_bits[at : at + step][:, None] ^ y_bits).sum(axis=2, dtype=np.int64) <= both - 2 * least) & (comp[x][:, None] != comp[right]) & (least <= np.minimum(n[x][:, None], n[right]))
                    p, q = (x[i] for x, i in zip((x, right), np.nonzero(near), strict=True))
                    mine = np.array([lower[a].isdisjoint(lower[b]) for a, b in zip(p.tolist(), q.tolist(), strict=True)], bool)
                    found.append(np.stack((k[p[mine]], k[q[mine]])))
        a, b = np.concatenate(found, 1)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    for batch in batches:
        cols = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
        for token, i, j, *row in zip(*cols, strict=True):
            if key != (token, i, j):
                if rows:
                    yield pairs()
                rows, key = [], (token, i, j)
            rows.append(tuple(row))
    if rows:
        yield pairs()


def _crowded_pairs(placed: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """Candidate pairs that share a token of `placed`, compared by bitmap in tiles of at most 2 x TILE rows.

    The pairs of a crowded token are never rows of a join: only those that may be links leave a tile.
    """
    keys = scratch.keep(placed.select("k").distinct(), "crowd")
    own = sets.select("k", "bits").join(F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys, "k", "left_semi").dropDuplicates(["k"])
    many = placed.groupBy("token").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("blocks"))
    rows = placed.join(many, "token").withColumn("own", F.pmod(F.xxhash64("k"), F.col("blocks")).cast("int"))
    low = placed.groupBy("k").agg(F.slice(F.array_sort(F.collect_set("token")), 1, LOW_TOKENS).alias("low"))
    rows = rows.join(own, "k").join(low, "k").select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with"))
    rows = rows.select("token", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), "k", "n", "comp", "bits", "own", "low")
    rows = rows.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j")
    return rows.mapInArrow(_tile_pairs, "a long, b long").distinct()


def _pair_links(pairs: DataFrame, sets: DataFrame, levels: np.ndarray, scratch: Scratch) -> DataFrame:
    """Those of pairs (a, b: class keys) that are links."""

    def with_both(pairs: DataFrame, column: str) -> DataFrame:
        keys = scratch.keep(pairs.select(F.col("a").alias("k")).union(pairs.select("b")).distinct(), "keys")
        few = keys.count() <= BROADCAST_KEYS
        own = sets.select("k", "n", column).join(F.broadcast(keys) if few else keys, "k", "left_semi").dropDuplicates(["k"])
        for side in "ab":
            pairs = pairs.join(own.select(*[F.col(c).alias(f"{c if c != 'k' else ''}{'_' if c != 'k' else ''}{side}") for c in ("k", "n", column)]), side)
        return pairs.select("a", "b", "n_a", "n_b", f"{column}_a", f"{column}_b")

    likely = scratch.keep(with_both(pairs, "bits").mapInArrow(_may_link, "a long, b long"), "likely")
    out = scratch.keep(with_both(likely, "packed").mapInArrow(_verify(levels), "a long, b long"), "links")
    scratch.drop(likely)
    free_shuffles(pairs.sparkSession)
    return out


def fits(a: str, b: str):
    """Sizes that allow a link."""
    return (F.col(a) * DEN >= F.col(b) * NUM) & (F.col(b) * DEN >= F.col(a) * NUM)


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (smallest doc_id reachable by links).

    Null and wordless texts have n_shingles 0 and are linked with nothing: component_id is their doc_id.
    Rows with equal sets are always linked. A null doc_id never becomes a component_id unless the whole
    component has no other; repeated rows give repeated results. Other columns are not read.
    """
    ship(__name__)
    ship(f"{__package__}.common")
    spark = docs.sparkSession
    settle(spark)
    with Scratch(spark) as scratch:
        found = scratch.keep(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_scan, ROW), "shingles", "zstd")
        count = found.where("n = -1").select("doc_id", F.posexplode("counts").alias("i", "c")).groupBy((F.col("doc_id") + F.col("i")).alias("i")).agg(F.sum("c").alias("c"))
        levels = np.zeros(1 << SKETCH_BITS, np.uint8)  # 2^18 counters at any input size
        for row in count.where("c > 0").toLocalIterator():
            levels[row[0]] = int(row[1]).bit_length()
        rows = found.where("n > 0")
        sets = rows.where("packed is not null").select("k", "n", "packed", "bits")
        classes = scratch.keep(rows.groupBy("k").agg(F.min("n").alias("n"), *[F.min(f"m{i}").alias(f"m{i}") for i in range(len(SEEDS))]), "classes")
        links = groups = None
        for turn, seeds in enumerate(STAR_ROUNDS):
            minima = classes.select("k", "n", F.explode(F.array(*[F.struct(F.lit(i).alias("o"), F.col(f"m{i}").alias("m")) for i in seeds])).alias("x")).select("k", "n", "x.o", "x.m")
            if groups is not None:
                minima = minima.join(groups.withColumnRenamed("node", "k"), "k", "left")
            minima = minima.withColumn("comp", F.coalesce("comp", "k") if groups is not None else F.col("k"))
            low = minima.groupBy("o", "m").agg(F.min(F.struct(F.xxhash64(F.lit(turn), "o", "k").alias("by"), "k", "n", "comp")).alias("rep"), F.count(F.lit(1)).alias("many")).where("many > 1")
            stars = minima.join(low, ["o", "m"]).where(F.col("comp") != F.col("rep.comp")).where(fits("n", "rep.n"))
            stars = scratch.keep(stars.select(F.col("rep.k").alias("a"), F.col("k").alias("b")).distinct(), "stars")
            found_links = _pair_links(stars, sets, levels, scratch)
            links = found_links if links is None else links.union(found_links)
            scratch.drop(stars)
            previous, groups = groups, scratch.keep(components(links, scratch), "groups")
            scratch.drop(previous)
        scratch.drop(classes)
        settle(spark)
        named = groups.withColumnRenamed("node", "k")
        if few := groups.count() <= BROADCAST_GROUPS:
            own = sets.drop("bits").join(F.broadcast(named), "k", "left")
        else:  # then a token's rows are told apart by class, and joined with their components after
            own = sets.drop("bits").withColumn("comp", F.lit(None).cast("long"))
        own = own.select("k", "n", "packed", F.coalesce("comp", "k").alias("comp"))
        parts = []
        for turn in range(TURNS):
            posts = own.mapInArrow(_postings(levels, turn), POSTING).repartition("token").sortWithinPartitions("token", "comp", "k")
            parts.append(scratch.keep(posts.mapInArrow(_shared, POSTING), "placed"))
            free_shuffles(spark)
        placed = spark.read.schema(POSTING).parquet(*[p._scratch_path for p in parts])
        if not few:
            placed = scratch.keep(placed.drop("comp").join(named, "k", "left").withColumn("comp", F.coalesce("comp", "k")), "placed")
            free_shuffles(spark)
        crowd = placed.groupBy("token").agg(F.count(F.lit(1)).alias("many"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where(F.col("many") > CROWD)
        crowd = scratch.keep(crowd.select("token", (F.col("lo") < F.col("hi")).alias("mixed")), "crowded")
        free_shuffles(spark)
        light = placed.join(pruning(crowd.select("token")), "token", "left_anti")
        crowd = crowd.where("mixed").select("token")
        x, y = (light.select("token", *[F.col(c).alias(f"{c}_{s}") for c in ("k", "n", "comp")]) for s in "ab")
        pairs = x.join(y, "token").where("k_a < k_b and comp_a <> comp_b").where(fits("n_a", "n_b"))
        least = F.lit(1) + F.floor(F.least(F.min("n_a"), F.min("n_b")) / 64)
        pairs = pairs.groupBy(F.col("k_a").alias("a"), F.col("k_b").alias("b")).agg((F.count(F.lit(1)) >= least).alias("enough")).where("enough").select("a", "b")
        pairs = pairs.union(_crowded_pairs(placed.join(pruning(crowd), "token", "left_semi"), sets, scratch)).distinct()
        more = _pair_links(scratch.keep(pairs, "pairs"), sets, levels, scratch)
        ends = scratch.keep(components(links.union(more), scratch), "ends")
        named = rows.select("doc_id", "n", "k").join(ends.withColumnRenamed("node", "k"), "k", "left").withColumn("comp", F.coalesce("comp", "k"))
        named = scratch.keep(named.select("doc_id", "n", "comp"), "named")
        first = named.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
        out = named.join(first, "comp").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
        return scratch.result(out.union(found.where("n = 0").select("doc_id", "n", "doc_id")), "components")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, whose doc_id is the smallest of their component.

    Texts without words are linked with nothing and stay; so do rows with a null doc_id. Rows that share
    a doc_id are one document and stay or go together.
    """
    cols = docs.columns
    ids = F.col("doc_id").cast("long")
    found = jaccard_components(docs).where("doc_id is not null and n_shingles > 0 and doc_id <> component_id").select("doc_id").distinct()
    framed = docs.select(F.struct(*[docs[c] for c in cols]).alias("row"), ids.alias("doc_id"))
    return framed.join(pruning(found), "doc_id", "left_anti").select("row.*")
