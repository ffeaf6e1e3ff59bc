"""MinHash near-duplicates with sequential Bayesian verification.

1. Every document's set of word shingles gets a key (equal sets: equal key) and a
   signature of HASHES minimum hashes. Equal sets are one node from here on.
2. Signatures are cut into bands; equal band values make a bucket. Buckets with the same
   members count once.
3. Every member of a bucket is compared with the bucket's smallest node, its hub. Members
   are dealt to parts of bounded size and the hub is sent to each part once, not to each
   pair. Where that leaves a bucket with several components, the members outside the hub's
   component are compared with each other and with the hub's component in tiles of bounded
   size: signatures first, bucket by bucket, then the sets of what is left, drawn together
   over all buckets, the most similar first, until they are connected. Pairs within one
   component need no comparison. So no pair of a bucket goes unexamined that could join two
   components, a hub's component is copied once per tile of the others only, and a task
   returns links that join or pairs that connect, never all pairs.
4. A comparison looks at BATCH hashes at a time and stops once the posterior probability
   (uniform prior) of reaching the threshold falls below MISS; survivors are verified on
   their full shingle sets.
5. Verified links are contracted by alternating large-star and small-star steps.

Words: A-Z lower-cased, then runs of characters other than ASCII white space. A set:
distinct WIDTH-word shingles, as 64-bit hashes; a text of fewer words, but not none, is one
shingle. Linked: 100 * intersection >= PERCENT * union.

Defined results: null text or text without words has an empty set, linked with nothing;
rows with equal doc_id are one document: each row has its own set's size, and all have the
smallest component that any of their texts reaches; a null doc_id is linked with nothing,
its component and kept are null; ties have no effect (components are smallest ids); every
row gives a row; an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

NAME = "op9_minhash_near_dup"
#: Defaults of the operator; the query's contract asks for 2-word shingles.
WIDTH, PERCENT = 5, 80
BANDS, ROWS = 25, 5
HASHES = BANDS * ROWS
BATCH, MISS = 25, 1e-6
#: Members of one bucket and side that meet in one group of a task, and their shingles.
TILE, TILE_WORDS = 512, 1 << 20
#: Rows of ids that are sent to every task rather than dealing the sets out anew; beyond, both sides are dealt.
SENT_ROWS = 1 << 19
#: Bits of the filter that tells which documents' sets are needed; larger inputs make it less sharp, not larger.
FILTER_BITS = 1 << 27
MEMO = 250_000

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_MIX = np.random.default_rng(20)
_A = _MIX.integers(0, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _MIX.integers(0, 1 << 32, HASHES, dtype=np.uint32)


class WordHash(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > MEMO:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingles(text: bytes | None, width: int, words: WordHash) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    found = text.translate(_LOWER).split() if text else []
    if not found:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    n = max(1, len(h) - width + 1)
    with np.errstate(over="ignore"):
        total = np.full(n, min(width, len(h)), np.uint64)
        for k in range(min(width, len(h))):
            total = _mix(total * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n])
    return np.unique(total)


def _key(raw: bytes) -> bytes:
    return hashlib.blake2b(raw, digest_size=16).digest()


def signature(found: np.ndarray) -> np.ndarray:
    """The minimum of each hash function over a set, in steps that stay in a core's cache."""
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    found = (found >> np.uint64(32)).astype(np.uint32)
    with np.errstate(over="ignore"):
        for at in range(0, len(found), 128):
            x = found[at : at + 128, None] * _A
            x += _B
            np.minimum(out, x.min(axis=0), out=out)
    return out.astype("<u4")


def _sign_kernel(width: int):
    def run(batches):
        words = common.kept("word hashes", WordHash)
        for part in common.slices(batches, "text"):
            sizes, keys, signs = [], [], []
            for text in common.raw_texts(part.column("text")):
                s = shingles(text, width, words)
                sizes.append(len(s))
                keys.append(_key(s.tobytes()) if len(s) else None)
                signs.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(signs, pa.binary())], ["doc_id", "n_shingles", "key", "sign"])

    return run


def _set_kernel(width: int, bits, mask: int):
    def run(batches):
        words, found = common.kept("word hashes", WordHash), bits.value
        for part in common.slices(batches, "text"):
            at = part.column("h").to_numpy(zero_copy_only=False).astype(np.int64) & mask
            wanted = np.flatnonzero((found[at >> 3] >> (at & 7)) & 1)
            if len(wanted):
                part = part.take(pa.array(wanted))
                sets = [shingles(t, width, words).tobytes() for t in common.raw_texts(part.column("text"))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(map(_key, sets), pa.binary()), pa.array(sets, pa.binary())], ["node", "key", "set"])

    return run


def least_matches(percent: int = PERCENT, batch: int = BATCH, miss: float = MISS) -> list[tuple[int, int]]:
    """(hashes seen, fewest matches to go on): after m of n matches the similarity has a Beta(m+1, n-m+1)
    posterior, and P(similarity >= t) = P(Binomial(n+1, t) <= m)."""
    t, out = percent / 100, []
    for n in range(batch, HASHES + 1, batch):
        tail, m = 0.0, -1
        while m < n:
            tail += math.comb(n + 1, m + 1) * t ** (m + 1) * (1 - t) ** (n - m)
            m += 1
            if tail >= miss:
                break
        out.append((n, m))
    return out


def _signs(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u4").reshape(-1, HASHES)


_PAIRS = "a bigint, b bigint"


def _links(found: list[tuple[int, int]]) -> pa.RecordBatch:
    ordered = [(min(x), max(x)) for x in found]
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in ordered], pa.int64()), pa.array([x for _, x in ordered], pa.int64())], ["a", "b"])


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets reach the threshold; sizes alone may tell that they don't."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    at = np.searchsorted(y, x)
    both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
    return both > 0 and 100 * both >= percent * (len(x) + len(y) - both)


def survivors(one: np.ndarray, signs: np.ndarray, rows: np.ndarray, steps) -> tuple[np.ndarray, np.ndarray]:
    """Those of rows whose signatures may still reach the threshold with one, and their matches; a batch of hashes at a time."""
    matches, before = np.zeros(len(rows), np.int64), 0
    for n, least in steps:
        if not len(rows):
            break
        matches = matches + (signs[rows, before:n] == one[before:n]).sum(axis=1)
        on = matches >= least
        rows, matches, before = rows[on], matches[on], n
    return rows, matches


def _star_kernel(percent: int):
    """Verified links of hubs with their members. Rows come sorted: a hub's own rows, then some of its members."""
    steps = least_matches(percent)

    def run(batches):
        at, heads = None, []
        for part in common.slices(batches, "set"):
            group = list(zip(*(part.column(c).to_pylist() for c in ("hub", "parts", "salt")), strict=True))
            node = part.column("node").to_pylist()
            signs = _signs(part.column("sign"))
            sets = [np.frombuffer(x, np.uint64) for x in part.column("set").to_pylist()]
            found, i = [], 0
            while i < len(node):
                if group[i] != at:
                    at, heads = group[i], []
                j = i
                while j < len(node) and group[j] == at and node[j] == at[0]:
                    heads.append((signs[j].copy(), sets[j].copy()))
                    j += 1
                i = j
                while j < len(node) and group[j] == at:
                    j += 1
                for sign, own in heads:
                    rows, _ = survivors(sign, signs, np.arange(i, j), steps)
                    found += [(at[0], node[k]) for k in rows.tolist() if _linked(own, sets[k], percent)]
                i = j
            yield _links(found)

    return run


_PLACE = ["bucket", "i", "with_rest", "j"]


def _sides(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    side = table.column("side").to_numpy()
    left = np.flatnonzero(side == 0)
    return left, np.flatnonzero(side == 1) if side.max() else left


def _near_kernel(percent: int):
    """Pairs of a tile, of different components, whose signatures may link them: as many as connect what all such pairs connect."""
    steps = least_matches(percent)

    def run(table: pa.Table) -> pa.Table:
        node, comp = table.column("node").to_numpy(), table.column("component").to_numpy()
        sign = _signs(table.column("sign").combine_chunks())
        left, right = _sides(table)
        root, found = np.arange(len(node)), []
        for i in left.tolist():
            rows, _ = survivors(sign[i], sign, right[comp[right] != comp[i]], steps)
            new, at = np.unique(root[rows], return_index=True)
            apart = new != root[i]
            if apart.any():
                found += [(int(node[i]), int(node[rows[k]])) for k in at[apart].tolist()]
                root[np.isin(root, new[apart])] = root[i]
        return pa.Table.from_batches([_links(found)])

    return run


def _tile_kernel(percent: int):
    """Verified links of a tile that join components."""
    steps = least_matches(percent)

    def run(table: pa.Table) -> pa.Table:
        node, comp = table.column("node").to_numpy(), table.column("component").to_numpy().copy()
        sign = _signs(table.column("sign").combine_chunks())
        sets = [np.frombuffer(x, np.uint64) for x in table.column("set").to_pylist()]
        left, right = _sides(table)
        links = []
        for i in left.tolist():
            rows, matches = survivors(sign[i], sign, right[comp[right] != comp[i]], steps)
            for j in rows[np.argsort(-matches, kind="stable")].tolist():
                if comp[i] != comp[j] and _linked(sets[i], sets[j], percent):
                    links.append((int(node[i]), int(node[j])))
                    comp[comp == comp[j]] = comp[i]
        return pa.Table.from_batches([_links(links)])

    return run


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node with a link, as a written table; component is the smallest node reachable. links(a, b)."""
    edges = common.materialize(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "dup-edges")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        before, edges = edges, common.materialize(small, "dup-edges")
        common.forget(before)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    both = edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    out = common.materialize(both, "dup-components")
    common.forget(edges)
    return out


def _bits(nodes: DataFrame, many: int) -> tuple[np.ndarray, int]:
    """A filter of at most FILTER_BITS bits over xxhash64 of node."""
    size = 1 << 15
    while size < FILTER_BITS and size < 16 * many:
        size *= 2
    place = nodes.select(F.xxhash64("node").bitwiseAND(F.lit(size - 1)).alias("p"))
    rows = place.select((F.col("p") / 32768).cast("bigint").alias("k"), (F.col("p") % 32768).alias("i")).groupBy("k").agg(F.bitmap_construct_agg("i").alias("bits")).collect()
    out = np.zeros(size // 8, np.uint8)
    for r in rows:
        out[r["k"] * 4096 : (r["k"] + 1) * 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out, size - 1


def _parts(n: Column, words: Column) -> Column:
    """Parts of at most about TILE members and TILE_WORDS shingles."""
    return F.ceil(F.greatest(n / TILE, words / TILE_WORDS)).cast("int")


def _sent(narrow: DataFrame, counted: DataFrame) -> DataFrame:
    """narrow as the side of a join that is broadcast, if the written table that bounds it has at most SENT_ROWS rows."""
    return F.broadcast(narrow) if counted.count() <= SENT_ROWS else narrow


def _star_links(member: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Links of every bucket's hub with its members; a hub meets each distinct member once. A hub's members are dealt to parts of
    bounded size by their hash, and the hub goes to every part, so no part is larger where a bucket is."""
    pairs = member.where("node <> hub").groupBy("hub", "node").agg(F.max("parts").alias("parts")).withColumn("salt", F.pmod(F.xxhash64("node"), "parts").cast("int"))
    pairs = common.materialize(pairs, "dup-pairs")
    at = ["hub", "parts", "salt"]
    asked = pairs.select(*at, "node").unionByName(pairs.select(*at).distinct().withColumn("node", F.col("hub")))
    dealt = _sent(asked, pairs).join(nodes, "node").select(*at, "node", "sign", "set").repartition(*at).sortWithinPartitions(*at, F.col("node") != F.col("hub"))
    links = common.materialize(dealt.mapInArrow(_star_kernel(percent), _PAIRS), "dup-links")
    common.forget(pairs)
    return links


def _placed(member: DataFrame, groups: DataFrame, parts: DataFrame, nodes: DataFrame) -> DataFrame:
    """The columns of nodes for every tile in which a member(bucket, node, size, parts) of a bucket of several components
    is compared: members outside the component of the bucket's hub (the rest) meet each other and the hub's component;
    members of the hub's component don't meet. groups(bucket, hub, parts), parts(node, component)."""
    on = ["bucket", "tile"]
    every = lambda many: F.explode(F.sequence(F.lit(0), F.col(many) - 1)).alias("tile")
    heads = groups.join(parts.select(F.col("node").alias("hub"), F.col("component").alias("of_hub")), "hub", "left").select("bucket", F.coalesce("of_hub", "hub").alias("of_hub"), every("parts"))
    now = member.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node")).withColumn("tile", F.pmod(F.xxhash64("node"), "parts").cast("int"))
    now = now.join(heads, on).select(*on, "node", "size", "parts", "component", (F.col("component") != F.col("of_hub")).alias("rest"))
    now = common.materialize(now, "dup-apart")
    rest = now.where("rest").groupBy("bucket", "parts").agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    open_ = rest.select("bucket", _parts(F.col("n"), F.col("words")).alias("rests"), every("parts"))
    met = _sent(now.join(open_, on), now).join(nodes, "node")
    own = F.pmod(F.xxhash64("node", F.lit(1)), "rests").cast("int")

    def place(i: Column, with_rest: bool, j: Column, side: Column) -> Column:
        return F.struct(i.cast("int").alias("i"), F.lit(with_rest).alias("with_rest"), j.cast("int").alias("j"), side.cast("int").alias("side"))

    tiles, rests = F.sequence(F.lit(0), F.col("parts") - 1), F.sequence(F.lit(0), F.col("rests") - 1)
    with_rests = F.transform(rests, lambda o: place(F.least(own, o), True, F.greatest(own, o), (own > o).cast("int")))
    places = F.when(F.col("rest"), F.concat(F.transform(tiles, lambda t: place(own, False, t, F.lit(0))), with_rests)).otherwise(F.transform(rests, lambda o: place(o, False, F.col("tile"), F.lit(1))))
    return met.withColumn("p", F.explode(places)).select("bucket", "p.*", "component", *nodes.columns)


def _tile_links(member: DataFrame, groups: DataFrame, parts: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Links that join components inside buckets which the comparisons with hubs left apart. Signatures meet first, bucket by
    bucket; what may still be linked is drawn together over all buckets, so a set travels once per tile of such a group and
    not once per bucket."""
    met = _placed(member.where("n > 2"), groups.where("n > 2"), parts, nodes.select("node", "sign"))
    near = common.materialize(met.groupBy(*_PLACE).applyInArrow(_near_kernel(percent), _PAIRS), "dup-near")
    drawn = components(near)
    sizes = member.groupBy("node").agg(F.min("size").alias("size"))
    again = common.materialize(drawn.join(sizes, "node").select(F.col("component").alias("bucket"), "node", "size"), "dup-again")
    heads = again.groupBy("bucket").agg(F.min("node").alias("hub"), F.count("*").alias("n"), F.sum("size").alias("words"))
    heads = common.materialize(heads.select("bucket", "hub", _parts(F.col("n"), F.col("words")).alias("parts")), "dup-heads")
    met = _placed(again.join(heads.select("bucket", "parts"), "bucket"), heads, parts, nodes)
    links = common.materialize(met.groupBy(*_PLACE).applyInArrow(_tile_kernel(percent), _PAIRS), "dup-tiled")
    common.forget(near, drawn, again, heads)
    return links


def _same_id_links(known: DataFrame, again: DataFrame, reps: DataFrame) -> DataFrame:
    """Links between the nodes of one doc_id's different texts."""
    ids = again.where("low < high").select("doc_id")
    nodes = known.join(ids, "doc_id", "left_semi").select("doc_id", "key").distinct().join(reps.select("key", "node"), "key").select("doc_id", "node")
    return nodes.join(nodes.groupBy("doc_id").agg(F.min("node").alias("a")), "doc_id").select("a", F.col("node").alias("b"))


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs(doc_id, text)."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    rows = common.materialize(docs.mapInArrow(_sign_kernel(width), "doc_id bigint, n_shingles bigint, key binary, sign binary"), "dup-signs")
    known = rows.where("key is not null and doc_id is not null")
    again = common.materialize(known.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).where("n > 1"), "dup-again")
    repeated = not again.isEmpty()
    reps = known.groupBy("key").agg(F.min("doc_id").alias("node"), F.count("*").alias("many"), F.min("n_shingles").alias("size"), F.min("sign").alias("sign"))
    reps = common.materialize(reps, "dup-nodes")

    band = F.explode(F.array(*(F.xxhash64(F.substring("sign", 1 + 4 * ROWS * k, 4 * ROWS), F.lit(k)) for k in range(BANDS))))
    bands = reps.select("node", "size", band.alias("bucket"))
    groups = bands.groupBy("bucket").agg(
        F.count("*").alias("n"), F.min("node").alias("hub"), F.max("node").alias("last"), F.sum(F.xxhash64("node") % (1 << 40)).alias("members"), F.sum("size").alias("words")
    )
    groups = groups.where("hub < last").groupBy("n", "hub", "last", "members", "words").agg(F.min("bucket").alias("bucket"))
    groups = common.materialize(groups.select("bucket", "n", "hub", _parts(F.col("n"), F.col("words")).alias("parts")), "dup-buckets")
    member = common.materialize(bands.join(groups, "bucket"), "dup-members")

    wanted = member.select("node").distinct()
    bits, mask = _bits(wanted, wanted.count())
    sent = spark.sparkContext.broadcast(bits)
    sets = docs.where("doc_id is not null").select("doc_id", "text", F.xxhash64("doc_id").alias("h")).mapInArrow(_set_kernel(width, sent, mask), "node bigint, key binary, set binary")
    nodes = sets.join(reps.join(wanted, "node", "left_semi").select("node", "key", "sign"), ["node", "key"])
    nodes = common.materialize((nodes.dropDuplicates(["node", "key"]) if repeated else nodes).select("node", "sign", "set"), "dup-sets")
    sent.destroy()

    links = stars = _star_links(member, nodes, percent)
    if repeated:
        links = links.unionByName(_same_id_links(known, again, reps))
    parts = components(links)
    more = _tile_links(member, groups, parts, nodes, percent)
    if not more.isEmpty():
        before, parts = parts, components(links.unionByName(more))
        common.forget(before)
    merged = reps.select("key", "node", "many").join(parts, "node", "left").where("many > 1 or component is not null").select("key", F.coalesce("component", "node").alias("component"))
    out = rows.join(merged, "key", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
    common.forget(again, groups, member, nodes, stars, more)
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def keep_one(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """docs without the documents that are not the first of their group; of rows with one doc_id, one stays (the one whose text
    has the smallest hash). Rows with a null doc_id all stay. Extra columns pass through."""
    found = near_duplicates(docs.select("doc_id", "text"), width, percent)
    gone = common.materialize(found.where("not kept").select("doc_id").distinct(), "dup-gone")
    again = common.materialize(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("_rows")).where("_rows > 1").select("doc_id"), "dup-twice")
    left = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    if again.isEmpty():
        return left
    once = left.join(again, "doc_id", "left_anti").select(*docs.columns)
    same = left.join(again, "doc_id", "left_semi").select(F.col("doc_id").alias("_id"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"))
    one = same.groupBy("_id").agg(F.min_by("_row", F.xxhash64("_row.text")).alias("_row")).select("_row.*")
    return once.unionByName(one)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"), width=2)


SQL = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select doc_id, case when len(w) = 0 then [] when len(w) = 1 then w else list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) end as s from w),
e as (select doc_id, len(s) as n, unnest(s) as g from s),
p as (select a.doc_id as a, b.doc_id as b, any_value(a.n) + any_value(b.n) as total, count(*) as i from e a join e b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from p where 100 * i >= 80 * (total - i)),
sym as (select a, b from l union select b, a from l),
reach as (select a as n, a as r from sym union select reach.n, sym.b from reach join sym on reach.r = sym.a),
c as (select n, min(r) as c from reach group by n)
select s.doc_id, cast(len(s.s) as bigint) as n_shingles, coalesce(c.c, s.doc_id) as component_id, coalesce(c.c, s.doc_id) = s.doc_id as kept
from s left join c on c.n = s.doc_id
"""
