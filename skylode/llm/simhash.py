"""Near duplicates by SimHash fingerprints, linked through pivot distance tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skylode.llm.common import each_salt, keep_rows, map_arrow, salt, salts_of, texts
from skylode.operators.graph import connected_components
from skylode.runtime import cut

SEED = 42
#: Words to a shingle of a fingerprint.
FINGERPRINT_WORDS = 3
#: Bit ranges (low, width) of the three bands: of two fingerprints within 2 bits, one band at least is equal.
BANDS = ((0, 22), (22, 21), (43, 21))
#: A key shared by more fingerprints than this is linked through midpoints instead of pairs.
CROWD = 512
PIVOTS = 16


#: For texts that are alike to a degree: hash functions of the sketch, bands of two of them, standard errors by which a sketch may fall short,
#: the size up to which all pairs of a band's bucket are compared at once, and that of the blocks which larger buckets are compared in.
HASHES, BANDED, ERRORS, SMALL_BUCKET, BLOCK = 256, 10, 4.0, 64, 512
#: Salts that the members of a larger bucket are dealt to, and classes of texts to a cell in which pairs are verified.
LEADER_SALTS, CELL = 16, 1000


def _shingles(text: str, words: int) -> tuple[np.ndarray, int]:
    """XXH64 values of the shingles, repeats included, as rows of 8 bytes, the most significant first; and how many there are."""
    import xxhash

    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros((0, 8), np.uint8), 0
    joined = [b" ".join(z) for z in zip(*(found[i:] for i in range(words)), strict=False)] or [b" ".join(found)]
    return np.frombuffer(b"".join([xxhash.xxh64_digest(x, SEED) for x in joined]), dtype=np.uint8).reshape(-1, 8), len(joined)


def _majority(raw: np.ndarray, count: int) -> int:
    # How often each byte value stands at each of the 8 places, then how often each bit is set.
    seen = np.bincount((raw + np.arange(0, 2048, 256)).ravel(), minlength=2048).reshape(8, 256)
    ones = seen @ np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
    return int.from_bytes(np.packbits(2 * ones > count).tobytes(), "big")


def fingerprint(text: str, words: int) -> int:
    """The 64 bits set in over half of the shingles' XXH64 values; zero where there are no words."""
    raw, count = _shingles(text, words)
    return _majority(raw, count) if count else 0


def fingerprints(docs: DataFrame, words: int = FINGERPRINT_WORDS) -> DataFrame:
    """Rows (doc_id, fp): every document's fingerprint as a signed 64-bit integer."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(x, words) for x in texts(batch)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found)], names=["doc_id", "fp"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), kernel, "doc_id long, fp long")


def _distinct(text: str, words: int) -> np.ndarray:
    """The values of the distinct shingles, in order."""
    return np.unique(_shingles(text, words)[0].copy().view(">u8").ravel()).astype("<u8")


def _name(own: np.ndarray) -> int:
    """A signed 64-bit name of a set of shingles."""
    import xxhash

    named = xxhash.xxh64_intdigest(own.tobytes(), SEED)
    return named - (1 << 64) if named >> 63 else named


def sketches(docs: DataFrame, words: int = 5, row: Column | None = None) -> DataFrame:
    """Rows (doc_id, row, fp, node, size, sketch array<long>, keys array<long>): what ``row`` gives, the fingerprint over ``FINGERPRINT_WORDS``, name and size of the set of shingles, two bits of each of the smallest hash values, and keys of pairs of these."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        random = np.random.default_rng(SEED)
        times = random.integers(1, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
        for batch in batches:
            fps, names, sizes, bits, keys = [], [], [], [], []
            for text in texts(batch):
                fps.append(fingerprint(text, FINGERPRINT_WORDS))
                whole = _distinct(text, words)
                names.append(_name(whole))
                sizes.append(len(whole))
                low = np.full(HASHES, 0xFFFFFFFF, np.uint32)
                # The last bytes vary as freely as any; mixed, so that a product orders them differently for each function.
                own = np.unique(whole.astype(np.uint32))
                for at in range(0, len(own), 4096):
                    product = own[at : at + 4096, None] * times[None, :]
                    low = np.minimum(low, (product ^ (product >> np.uint32(15))).min(axis=0))
                two = np.unpackbits((low & np.uint32(3)).astype(np.uint8)[:, None], axis=1)[:, -2:]
                bits.append(np.packbits(two.ravel()).view(np.int64))
                pair = low[: 2 * BANDED].astype(np.uint64)
                keys.append(((pair[0::2] << np.uint64(32) | pair[1::2]) * np.uint64(0x9E3779B97F4A7C15) + np.arange(BANDED, dtype=np.uint64)).view(np.int64))
            lists = [pa.array([x.tolist() for x in c], pa.list_(pa.int64())) for c in (bits, keys)]
            fp = pa.array(np.array(fps, dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), fp, pa.array(names, pa.int64()), pa.array(sizes, pa.int64()), *lists], names=["doc_id", "row", "fp", "node", "size", "sketch", "keys"])

    own = F.lit("") if row is None else row
    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", own.alias("row")), kernel, "doc_id long, row string, fp long, node long, size long, sketch array<long>, keys array<long>")


def pivots(count: int = PIVOTS) -> list[int]:
    """Reference fingerprints: a fixed multiplicative sequence, signed."""
    return [((i + 1) * 0x9E3779B97F4A7C15 * ((i << 1) + 0x2545F491) + 0x1B873593 * i) % (1 << 64) - (1 << 63) for i in range(count)]


def _bits(low: int, width: int) -> Column:
    return F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << width) - 1))


def _keys() -> Column:
    """Nine keys: a band, and a third of the remaining bits. Two fingerprints within 2 bits share one at least."""
    keys = []
    for b, (low, width) in enumerate(BANDS):
        rest = [bit for bit in range(64) if not low <= bit < low + width]
        cuts = (0, 14, 28, len(rest))
        for third in range(3):
            own = rest[cuts[third] : cuts[third + 1]]
            key, at = _bits(low, width), width
            start = own[0]
            for i, bit in enumerate(own):  # runs of neighbouring bits
                if i + 1 == len(own) or own[i + 1] != bit + 1:
                    key = key.bitwiseOR(F.shiftleft(_bits(start, bit - start + 1), at))
                    at += bit - start + 1
                    start = own[i + 1] if i + 1 < len(own) else 0
            keys.append(key.bitwiseOR(F.lit((3 * b + third) << 40)))
    return F.array(*keys)


def near_links(fps: DataFrame, distance: int = 2, count: int = PIVOTS, crowd: int = CROWD) -> DataFrame:
    """Rows (u, v) that connect exactly the distinct fingerprints ``fp`` at ``distance`` (2 at most) or fewer bits.

    Candidates share one of nine keys, which loses no pair. A table of
    Hamming distances to the pivots discards a candidate whose largest
    coordinate difference is over ``distance`` (the triangle inequality),
    and the survivors are verified. Fingerprints with a key that more than
    ``crowd`` others share aren't paired on it: each is linked to its 65
    neighbours within one bit instead. Two fingerprints within 2 bits have
    such a neighbour in common and others don't, so these links (through
    points that need not be fingerprints of any document) are exact also,
    and as many as the fingerprints.
    """
    if not 0 <= distance <= 2:
        raise ValueError("the keys are complete to a distance of 2")
    keyed = fps.select("fp", F.explode(_keys()).alias("key"))
    shared = cut(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    calm, hot = shared.where(F.col("n") <= crowd).select("key"), shared.where(F.col("n") > crowd).select("key")
    coordinates = [F.bit_count(F.col("fp").bitwiseXOR(F.lit(p))).cast("tinyint").alias(f"d{i}") for i, p in enumerate(pivots(count))]
    rows = cut(keyed.join(calm, "key", "left_semi").select("key", "fp", *coordinates))
    a, b = rows.alias("a"), rows.alias("b")
    differences = [F.abs(F.col(f"a.d{i}").cast("int") - F.col(f"b.d{i}")) for i in range(count)]
    near = (F.greatest(*differences) <= distance) if count > 1 else (differences[0] <= distance)
    verified = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= distance
    pairs = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") < F.col("b.fp")) & near & verified)
    links = pairs.select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v"))
    if distance < 2 or hot.isEmpty():
        if distance == 2 or hot.isEmpty():
            return links
        raise ValueError("midpoints are exact for a distance of 2 only")
    crowded = keyed.join(hot, "key", "left_semi").select("fp").distinct()
    points = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    return links.unionByName(crowded.select(F.col("fp").alias("u"), F.explode(points).alias("v")))


def near_duplicates(docs: DataFrame, words: int = FINGERPRINT_WORDS, distance: int = 2, crowd: int = CROWD) -> DataFrame:
    """Rows (doc_id, fp, component_id), one for each row of ``docs``.

    ``component_id`` is the smallest doc_id that links reach. Null and empty
    texts, and texts without words, have the fingerprint 0 and are linked like
    any other. A null doc_id keeps its row and is no component's id unless
    the component has no other. Repeated rows stay repeated. An empty table
    gives no rows. Of the other columns none is read.
    """
    found = cut(fingerprints(docs, words))
    classes = cut(found.groupBy("fp").agg(F.min("doc_id").alias("least"), salts_of(salt("doc_id")).alias("salted")))
    groups = connected_components(near_links(classes.select("fp"), distance, crowd=crowd)).withColumnRenamed("node", "fp")
    known = _with_least(cut(classes.select("fp", "least").join(groups, "fp")), "fp")
    labels = cut(classes.join(known, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"), "salted"))
    return found.withColumn("salt", salt("doc_id")).join(labels.withColumn("salt", each_salt("salted")), ["fp", "salt"]).select("doc_id", "fp", "component_id")


def _fingerprint_links(found: DataFrame) -> DataFrame:
    """Links (u, v) of the nodes of ``found`` (fp, node) that connect what :func:`near_links` connects of their fingerprints: a star about the smallest node of each component."""
    held = cut(found.select("fp", "node").distinct())
    each = cut(held.groupBy("fp").agg(F.min("node").alias("least"), salts_of(salt("node")).alias("salted")))
    groups = connected_components(near_links(each.select("fp"))).withColumnRenamed("node", "fp")
    known = _with_least(cut(each.select("fp", "least").join(groups, "fp")), "fp")
    labels = each.join(known, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("u"), each_salt("salted").alias("salt"))
    return cut(held.withColumn("salt", salt("node")).join(labels, ["fp", "salt"]).where("u != node").select("u", F.col("node").alias("v")).distinct())


def _with_least(members: DataFrame, node: str) -> DataFrame:
    """Rows (``node``, component, component_id): the smallest ``least`` of each component, joined by salt to its members, so that a large component spreads over many tasks."""
    smallest = members.groupBy("component").agg(F.min("least").alias("component_id"), salts_of(salt(node)).alias("held"))
    placed = smallest.select("component", "component_id", each_salt("held").alias("salt"))
    return members.withColumn("salt", salt(node)).join(placed, ["component", "salt"]).select(node, "component", "component_id")


class _Forest:
    """Which nodes are connected, by union and find; and the links that connected them."""

    def __init__(self, components: list[int]):
        first: dict[int, int] = {}
        self.parent = [first.setdefault(c, i) for i, c in enumerate(components)]
        self.links: list[tuple[int, int]] = []

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def link(self, pairs: list[tuple[int, int]], sets: list[np.ndarray], similarity: float) -> None:
        """Joins the pairs of places, in order, whose sets are alike, but for those that are connected by then. Each set is in order."""
        needed = sorted({i for p in pairs for i in p})
        values = np.unique(np.concatenate([*(sets[i] for i in needed), np.zeros(0, "<u8")]))
        own = {i: np.searchsorted(values, sets[i]).astype(np.int32) for i in needed}
        marked, last = np.zeros(len(values), bool), None
        for a, b in pairs:
            if self.root(a) == self.root(b):
                continue
            if a != last:
                if last is not None:
                    marked[own[last]] = False
                marked[own[a]], last = True, a
            both = int(np.count_nonzero(marked[own[b]]))
            if both + 1e-9 >= similarity * (len(own[a]) + len(own[b]) - both):
                self.parent[self.root(b)] = self.root(a)
                self.links.append((a, b))

    def table(self, nodes: list[int]) -> pa.Table:
        return pa.table({c: pa.array([nodes[x[i]] for x in self.links], pa.int64()) for i, c in enumerate("uv")})


def _sets(table: pa.Table) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), "<u8") for x in table.column("own")]


def _verified_pairs(pairs: pa.Table, sets: pa.Table, similarity: float) -> pa.Table:
    """Of pairs (u, v) those whose sets are alike, less pairs that others of the cell connect already."""
    nodes = sets.column("node").to_pylist()
    place = {n: i for i, n in enumerate(nodes)}
    forest = _Forest(nodes)
    forest.link([(place[u], place[v]) for u, v in sorted(zip(pairs.column("u").to_pylist(), pairs.column("v").to_pylist(), strict=True))], _sets(sets), similarity)
    return forest.table(nodes)


def shingle_sets(docs: DataFrame, classes: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """Rows (node, own binary): the sets of the classes that ``nodes`` names, made anew from one text of each."""
    chosen = classes.join(nodes, "node", "left_semi").select(F.col("least").alias("chosen")).distinct()

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [_distinct(x, words) for x in texts(batch)]
            yield pa.RecordBatch.from_arrays([pa.array([_name(x) for x in own], pa.int64()), pa.array([x.tobytes() for x in own], pa.binary())], names=["node", "own"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = rows.join(chosen, F.col("doc_id").eqNullSafe(F.col("chosen")), "left_semi")
    # An id may have several texts, and null stands for many, so names decide.
    return map_arrow(rows.select("text"), kernel, "node long, own binary").join(nodes, "node", "left_semi").dropDuplicates(["node"])


def verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame, words: int, similarity: float) -> DataFrame:
    """Links (u, v) that connect what those of ``pairs`` connect whose sets of shingles are alike by ``similarity``, counted exactly.

    Pairs are dealt to cells by u, and each cell gets the sets that its pairs name once.
    """
    pairs = cut(pairs.distinct())
    nodes = cut(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct())
    count = nodes.count()
    if not count:
        return pairs
    cells = pairs.withColumn("cell", F.pmod(F.xxhash64("u"), F.lit(LEADER_SALTS + count // CELL)))
    needed = cells.select(F.col("cell").alias("to"), F.explode(F.array("u", "v")).alias("node")).distinct().join(shingle_sets(docs, classes, nodes, words), "node")
    return cut(cells.groupBy("cell").cogroup(needed.groupBy("to")).applyInArrow(lambda a, b: _verified_pairs(a, b, similarity), "u long, v long"))


def _passing(similarity: float) -> float:
    """The least share of equal sketch values, less what chance gives, that a pair of this similarity shows but for a few standard errors."""
    equal = 0.25 + 0.75 * similarity
    return similarity - ERRORS * (equal * (1 - equal) / HASHES) ** 0.5 / 0.75


def _matrix(table: pa.Table, column: str, width: int) -> np.ndarray:
    return np.asarray(table.column(column).combine_chunks().flatten(), np.int64).reshape(-1, width)


def _linked_cell(rows: pa.Table, similarity: float) -> pa.Table:
    """The links of one cell: members of one block of a bucket with each other, or those of one block with those of another.

    Pairs are sifted by sketch and size, in matrices; what passes, is in different components and has not met in the bucket of an earlier key, is verified
    at once. Only links leave the cell, fewer than it has members.
    """
    rows = rows.sort_by([("block", "ascending"), ("node", "ascending")])
    sketch, keys = _matrix(rows, "sketch", HASHES // 32).view(np.uint64), _matrix(rows, "keys", BANDED)
    block, size, component = (rows.column(c).to_numpy() for c in ("block", "size", "component"))
    band, odd = rows.column("band")[0].as_py(), np.uint64(0x5555555555555555)
    second = np.flatnonzero(block == block[-1])
    pairs = []
    for a in np.flatnonzero(block == block[0]):
        others = second[second > a]
        apart = sketch[others] ^ sketch[a]
        unequal = np.bitwise_count((apart | apart >> np.uint64(1)) & odd).sum(axis=1)
        fine = ((1 - unequal / HASHES) - 0.25) / 0.75 >= _passing(similarity)
        fine &= np.minimum(size[others], size[a]) + 1e-9 >= similarity * np.maximum(size[others], size[a])
        fine &= (component[others] != component[a]) & ~(keys[others, :band] == keys[a, :band]).any(axis=1)
        near = others[fine]
        pairs += [(int(a), int(b)) for b in near[np.argsort(unequal[fine], kind="stable")]]
    nodes = rows.column("node").to_pylist()
    forest = _Forest(component.tolist())
    if pairs:
        forest.link(pairs, _sets(rows), similarity)
    return forest.table(nodes)


def _in_blocks(docs: DataFrame, classes: DataFrame, hot: DataFrame, links: DataFrame, words: int, similarity: float) -> DataFrame:
    """The links (u, v) inside buckets ``hot`` between members that ``links`` leave in different components, each pair tested in the first bucket that it shares."""
    known = cut(hot.drop("size").join(connected_components(links), "node", "left").withColumn("component", F.coalesce("component", "node")))
    parted = known.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
    blocks = F.ceil(F.col("n") / F.lit(BLOCK))
    dealt = cut(known.join(parted, "key", "left_semi").withColumn("blocks", blocks).select("node", "component", "key", "band", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).alias("block")))
    nodes = cut(dealt.select("node").distinct())
    members = cut(shingle_sets(docs, classes, nodes, words).join(classes.select("node", "size", "sketch", "keys"), "node"))
    cells = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    cells = cells.select("node", "component", "key", "band", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    columns = ("key", "i", "j", "node", "component", "band", "block", "size", "sketch", "keys", "own")
    return cut(cells.join(members, "node").select(*columns).groupBy("key", "i", "j").applyInArrow(lambda t: _linked_cell(t, similarity), "u long, v long"))


def _labelled(docs: DataFrame, words: int, similarity: float, row: Column | None = None, by_fingerprint: bool = False) -> DataFrame:
    """Rows (doc_id, row, component, component_id), see :func:`alike_documents`; ``component`` names the component whether it has an id or not."""
    found = cut(sketches(docs, words, row))
    classes = cut(found.groupBy("node").agg(F.min("doc_id").alias("least"), salts_of(salt("doc_id")).alias("salted"), F.first("size").alias("size"), F.first("sketch").alias("sketch"), F.first("keys").alias("keys")))
    keyed = classes.select("node", "size", F.posexplode("keys").alias("band", "key"))
    shared = cut(keyed.groupBy("key").agg(F.count("*").alias("n"), F.min_by("node", F.xxhash64("key", "node")).alias("leader")).where("n > 1"))
    rows = cut(keyed.join(shared, "key"))
    words_of = [F.col("sketch")[i].alias(f"s{i}") for i in range(HASHES // 32)]
    drawn = classes.select("node", *words_of)
    calm, hot = rows.where(F.col("n") <= SMALL_BUCKET), rows.where(F.col("n") > SMALL_BUCKET)

    def alike(a: str, b: str) -> Column:
        x, y = F.col(f"{a}.size"), F.col(f"{b}.size")
        unequal = F.lit(0)
        for i in range(HASHES // 32):
            z = F.col(f"{a}.s{i}").bitwiseXOR(F.col(f"{b}.s{i}"))
            unequal = unequal + F.bit_count(z.bitwiseOR(F.shiftrightunsigned(z, 1)).bitwiseAND(F.lit(0x5555555555555555)))
        share = (F.lit(1.0) - unequal / F.lit(float(HASHES)) - 0.25) / 0.75
        return (F.least(x, y) + 1e-9 >= similarity * F.greatest(x, y)) & (share >= _passing(similarity))

    def near(a: DataFrame, b: DataFrame, on: Column) -> DataFrame:
        return a.alias("a").join(b.alias("b"), on & alike("a", "b")).select(F.col("a.node").alias("u"), F.col("b.node").alias("v"))

    same_key = F.col("a.key") == F.col("b.key")
    meeting = calm.join(drawn, "node")
    candidates = near(meeting, meeting, same_key & (F.col("a.node") < F.col("b.node")))
    crowded = not hot.isEmpty()
    if crowded:
        # Members are salted, and each leader goes to every salt: the members of one bucket spread over that many tasks.
        members = hot.join(drawn, "node")
        salted = members.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(LEADER_SALTS)))
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(LEADER_SALTS - 1).cast("long")))
        leaders = members.where("node = leader").withColumn("salt", every)
        candidates = candidates.unionByName(near(salted, leaders, same_key & (F.col("a.salt") == F.col("b.salt")) & (F.col("a.node") != F.col("b.node"))))
    links = verified(docs, classes, candidates, words, similarity)
    if by_fingerprint:
        links = _fingerprint_links(found).unionByName(links)
    if crowded:
        links = links.unionByName(_in_blocks(docs, classes, hot, links, words, similarity))
    groups = connected_components(links)
    labels = cut(classes.join(groups, "node", "left").select("node", F.coalesce("component", "node").alias("component"), "least"))
    named = _with_least(labels, "node").join(classes.select("node", each_salt("salted").alias("salt")), "node")
    return found.select("doc_id", "row", "node", salt("doc_id").alias("salt")).join(named, ["node", "salt"]).select("doc_id", "row", "component", "component_id")


def alike_documents(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """Rows (doc_id, component_id), one for each row of ``docs``: components of texts whose shingle sets are alike to this degree.

    At 0.8 the fingerprints of two texts differ by ten bits or so, too many for keys that lose no pair, so
    candidates share the two smallest hash values of one of ten bands: at 0.8 all bands
    miss with probability (1 - 0.8^2)^10 < 1e-4. The sizes of the sets must allow the similarity, and the share of
    equal pairs of bits in the sketches, less what chance gives, must reach it less four standard errors (a miss in 30,000 at 0.8). Both only
    filter: what is left is linked if the sets themselves are alike.

    Every pair that shares a key is tested, or in one component already. Buckets of up to 64 are compared pair by pair. The members
    of a larger one, such as thousands of copies of a text, are compared with a leader first. Then the buckets that still have several
    components are cut into blocks, which meet each other in cells of bounded size; a cell tests its pairs itself and gives links alone.

    Texts with equal sets are one class. Null texts count as empty; texts without words are alike. A null doc_id keeps its row
    and is no component's id unless the component has no other. Repeated rows stay repeated; an empty table gives no rows.
    """
    return _labelled(docs, words, similarity).select("doc_id", "component_id")


def keep_one(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs``, all columns, that stay: exactly one of each of the components that the links of :func:`near_duplicates` and of :func:`alike_documents` make together, that with the smallest doc_id.

    Rows without a doc_id come last; repeated rows, and rows that share an id inside a component, leave one.
    """
    key = F.concat_ws(":", F.sha2(F.coalesce("text", F.lit("")), 256), F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("-")))
    labels = _labelled(docs, words, similarity, key, by_fingerprint=True)
    order = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "row")
    return keep_rows(docs, key, labels.groupBy("component").agg(F.min(order)["row"].alias("key")))


def hex64(fp: str = "fp") -> Column:
    """16 lowercase hex digits of a signed 64-bit integer."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
