"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints within T differing bits agree, in some part i of their bits, up to the
threshold t_i of that part, whenever the thresholds of m parts sum to T - m + 1.
Parts hold correlated bits, so that a part's entropy isn't spent twice; thresholds
come from a dynamic program over estimated candidates and probes.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, drop_saved, lower_ascii, map_arrow, may_hold, pieces, save, text_key, words
from .components import components

#: Cost of a shuffled probe row against a compared pair.
ROW_COST, PAIR_COST = 60.0, 1.0
#: Rows of one role that a cell of a bucket holds; buckets beyond it are dealt to a grid of cells.
CELL = 20_000
#: Pairs compared at once.
CHUNK = 1 << 21


def hashes(text: str | None, size: int) -> np.ndarray:
    w = words(lower_ascii(text)) if text else []
    if not w:
        return np.zeros(0, np.uint64)
    if len(w) < size:
        grams = [" ".join(w)]
    else:
        grams = map(" ".join, zip(*[w[i:] for i in range(size)], strict=False))
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(g, 42) for g in grams), np.uint64, max(1, len(w) - size + 1))


def majority(h: np.ndarray) -> int:
    """Bits set in over half of h; zero for none."""
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(h), 1 << 14):
        ones += np.unpackbits(h[lo : lo + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def mix(h: np.ndarray) -> np.ndarray:
    """A second hash of the same shingles."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, size: int, second: bool = False) -> DataFrame:
    """(doc_id, fp, fp2) as signed longs; fp2, a second fingerprint, is 0 unless asked for. A null text has no words."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64()), ("fp2", pa.int64())])

    def run(batches):
        for b in batches:
            for part in pieces(b):
                one, two = [], []
                for text in part.column("text").to_pylist():
                    h = hashes(text, size)
                    one.append(signed(majority(h)))
                    two.append(signed(majority(mix(h))) if second else 0)
                yield batch(schema, part.column("doc_id"), one, two)

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, fp long, fp2 long")


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """How many, and how often each two bits are set together, over all fingerprints: 4,096 sums."""
    schema = pa.schema([("i", pa.int32()), ("n", pa.int64())])

    def run(batches):
        total, n = np.zeros((64, 64)), 0
        for b in batches:
            fp = b.column("fp").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(fp, axis=1, bitorder="little").astype(np.float32)
            total += bits.T @ bits
            n += len(bits)
        yield batch(schema, np.arange(4097, dtype=np.int32), np.append(total.ravel(), n).astype(np.int64))

    got = dict(map(tuple, map_arrow(fps.select("fp"), run, "i int, n long").groupBy("i").agg(F.sum("n")).collect()))
    return got.get(4096, 0), np.array([got.get(i, 0) for i in range(4096)], float).reshape(64, 64)


def correlated_order(n: int, together: np.ndarray) -> list[int]:
    """Bits in an order that keeps correlated ones side by side."""
    p = np.diag(together) / max(n, 1)
    var = np.maximum(p * (1 - p), 1e-9)
    corr = np.abs((together / max(n, 1) - np.outer(p, p)) / np.sqrt(np.outer(var, var)))
    np.fill_diagonal(corr, 0)
    left = set(range(64))
    cur = int(corr.sum(1).argmax())
    out = [cur]
    left.remove(cur)
    while left:
        recent = corr[out[-8:]].sum(0)
        cur = max(sorted(left), key=lambda b: recent[b])
        out.append(cur)
        left.remove(cur)
    return out


@dataclass(frozen=True)
class Plan:
    order: tuple[int, ...]
    widths: tuple[int, ...]
    thresholds: tuple[int, ...]  # -1: the part isn't probed


def within(differ: np.ndarray, t: int) -> float:
    """Chance that two fingerprints differ in t bits of a part at most, each bit by its own chance."""
    d = np.zeros(t + 2)
    d[0] = 1
    for q in differ:
        d[1:] = d[1:] * (1 - q) + d[:-1] * q
        d[0] *= 1 - q
    return float(d[: t + 1].sum())


def make_plan(n: int, together: np.ndarray, bits: int) -> Plan:
    """Number of parts and their thresholds with the least estimated cost."""
    order = correlated_order(n, together)
    p = np.diag(together) / max(n, 1)
    differ = np.clip(2 * p * (1 - p), 0.05, 0.5)[order]
    best = (math.inf, None)
    for m in range(1, bits + 2):
        widths = [64 // m + (i < 64 % m) for i in range(m)]
        cuts = np.cumsum([0, *widths])
        need = bits - m + 1
        # spent thresholds (+1, so that -1 spends nothing) -> cost, choice
        table = {0: (0.0, ())}
        for i in range(m):
            new: dict[int, tuple[float, tuple]] = {}
            for spent, (cost, chosen) in table.items():
                for t in range(-1, min(need + m - spent - 1, 3) + 1):
                    probes = sum(math.comb(widths[i], k) for k in range(t + 1)) / 2
                    pairs = n * n / 2 * within(differ[cuts[i] : cuts[i + 1]], t) if t >= 0 else 0
                    c = cost + (n * (1 + probes) * ROW_COST + pairs * PAIR_COST if t >= 0 else 0)
                    if spent + t + 1 not in new or c < new[spent + t + 1][0]:
                        new[spent + t + 1] = (c, (*chosen, t))
            table = new
        if need + m in table and table[need + m][0] < best[0]:
            best = (table[need + m][0], Plan(tuple(order), tuple(widths), table[need + m][1]))
    return best[1]


def flips(width: int, t: int) -> np.ndarray:
    """Masks of 1 to t bits."""
    out, level = [], [(0, 0)]
    for _ in range(t):
        level = [(m | 1 << b, b + 1) for m, lo in level for b in range(lo, width)]
        out += [m for m, _ in level]
    return np.array(out, np.int64)


ROWS = "key long, probe boolean, node long, fp long, fp2 long"


def probe_rows(reps: DataFrame, plan: Plan) -> DataFrame:
    """A row for each part under its own value, and one for each value within the part's threshold.

    Of two values only the one with the lowest differing bit unset probes the other, so that a pair meets once in a part.
    """
    schema = pa.schema([("key", pa.int64()), ("probe", pa.bool_()), ("node", pa.int64()), ("fp", pa.int64()), ("fp2", pa.int64())])
    cuts = np.cumsum([0, *plan.widths])
    masks = [flips(w, t) if t > 0 else np.zeros(0, np.int64) for w, t in zip(plan.widths, plan.thresholds, strict=True)]

    def run(batches):
        for b in batches:
            for s in pieces(b, 2048):
                node, fp, fp2 = (s.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("node", "fp", "fp2"))
                bits = np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, list(plan.order)].astype(np.int64)
                for i, t in enumerate(plan.thresholds):
                    if t < 0:
                        continue
                    v = bits[:, cuts[i] : cuts[i + 1]] @ (np.int64(1) << np.arange(plan.widths[i], dtype=np.int64)) if plan.widths[i] < 63 else fp
                    key = v * 64 + i if plan.widths[i] < 58 else v
                    yield batch(schema, key, np.zeros(len(fp), bool), node, fp, fp2)
                    if len(masks[i]):
                        low = masks[i] & -masks[i]
                        r, c = np.nonzero((v[:, None] & low[None, :]) == 0)
                        yield batch(schema, (v[r] ^ masks[i][c]) * 64 + i, np.ones(len(r), bool), node[r], fp[r], fp2[r])

    return map_arrow(reps.select("node", "fp", "fp2"), run, ROWS)


class Forest:
    """Union-find over the nodes of one sorted run of rows; takes only links that join two trees."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def find(self, i: int) -> int:
        p = self.label
        while p[i] != i:
            p[i] = p[p[i]]
            i = p[i]
        return int(i)

    def settle(self) -> None:
        while True:
            up = self.label[self.label]
            if (up == self.label).all():
                return
            self.label = up

    def add(self, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
        out, lo, step = [], 0, 1024
        while lo < len(i):
            a, b = i[lo : lo + step], j[lo : lo + step]
            self.settle()
            open_ = self.label[a] != self.label[b]
            for x, y in zip(a[open_].tolist(), b[open_].tolist(), strict=True):
                p, q = self.find(x), self.find(y)
                if p != q:
                    self.label[max(p, q)] = min(p, q)
                    out.append((x, y))
            lo, step = lo + step, step * 2
        return out


def links_of(key, probe, node, fp, fp2, bits: int, bits2: int) -> tuple[np.ndarray, np.ndarray]:
    """Verified links of whole buckets, reduced to a forest over the run: nothing that they connect is lost."""
    order = np.lexsort((probe, key))
    key, probe, node, fp, fp2 = (x[order] for x in (key, probe, node, fp, fp2))
    fp, fp2 = fp.view(np.uint64), fp2.view(np.uint64)  # bits of a negative number are counted by its absolute value
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[start, len(key)])
    group = np.repeat(np.arange(len(start)), size)
    owned = np.bincount(group, ~probe, len(start)).astype(np.int64)  # index rows, first in their bucket
    # an index row meets the index rows after it, a probe row all of them
    rank = np.arange(len(key)) - start[group]
    first = np.where(probe, start[group], np.arange(len(key)) + 1)
    many = np.where(probe, owned[group], owned[group] - rank - 1)
    rows = np.flatnonzero(many > 0)
    ids, at = np.unique(node, return_inverse=True)
    forest, out = Forest(len(ids)), []
    ends = np.cumsum(many[rows])
    lo = 0
    while lo < len(rows):
        done = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, done + CHUNK, side="right")))
        r, n = rows[lo:hi], many[rows[lo:hi]]
        i = np.repeat(r, n)
        j = np.repeat(first[r], n) + (np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n))
        near = np.bitwise_count(fp[i] ^ fp[j]) <= bits
        i, j = i[near], j[near]
        if bits2 < 64:
            near = np.bitwise_count(fp[i] ^ fp[j]).astype(np.int64) + np.bitwise_count(fp2[i] ^ fp2[j]) <= bits + bits2
            i, j = i[near], j[near]
        out += forest.add(at[i], at[j])
        lo = hi
    a, b = np.array(out, np.int64).reshape(-1, 2).T if out else (np.zeros(0, np.int64),) * 2
    return ids[a], ids[b]


def spread(rows: DataFrame, cell: int = CELL) -> DataFrame:
    """Adds part: large buckets become a grid of cells. A row has a line by hash and stands in every cell of its line, so any two rows meet in a cell."""
    sizes = rows.groupBy("key").agg(F.sum((~F.col("probe")).cast("long")).alias("n"), F.sum(F.col("probe").cast("long")).alias("p")).filter((F.col("n") > 0) & ((F.col("n") > cell) | (F.col("p") > 8 * cell)))
    heavy = save(sizes.select(F.col("key").alias("_key"), F.ceil(F.greatest(F.col("n") / cell, F.col("p") / (8 * cell))).alias("_n")), "heavy")
    if heavy.isEmpty():
        drop_saved(heavy)
        return rows.withColumn("part", F.lit(0).cast("long"))
    met = rows.join(heavy, F.col("key") == F.col("_key"), "left").withColumn("_n", F.coalesce("_n", F.lit(1).cast("long")))
    own = F.pmod(F.xxhash64("fp", "fp2", "node"), F.col("_n"))
    cells = F.transform(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1), lambda x: F.least(x, own) * 1_000_000 + F.greatest(x, own))
    return met.withColumn("part", F.explode(cells)).drop("_key", "_n")


def links(reps: DataFrame, bits: int, bits2: int = 64, plan: Plan | None = None, cell: int = CELL) -> DataFrame:
    """(a, b) between nodes whose fingerprints differ in bits at most: enough of them to connect all that are connected.

    bits2 under 64 also asks that both fingerprints together differ in bits + bits2 at most.
    """
    if plan is None:
        plan = make_plan(*bit_statistics(reps), bits)
    rows = spread(probe_rows(reps, plan), cell)
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        held: list[pa.RecordBatch] = []
        count, last = 0, None

        def out(parts):
            t = pa.Table.from_batches(parts)
            k, p, n, f, g, c = (t.column(x).to_numpy() for x in ("key", "probe", "node", "fp", "fp2", "part"))
            # one number for key and cell
            if len(k) and c.any():
                _, k = np.unique(np.stack([k, c]), axis=1, return_inverse=True)
                k = k.ravel()
            return batch(schema, *links_of(k, p, n.astype(np.int64), f.astype(np.int64), g.astype(np.int64), bits, bits2))

        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            count += b.num_rows
            if count >= 200_000:
                t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                k, c = t.column("key").to_numpy(), t.column("part").to_numpy()
                cut = np.flatnonzero((k != k[-1]) | (c != c[-1]))
                if len(cut):  # the last bucket may go on in the next batch
                    at = int(cut[-1]) + 1
                    yield out([t.slice(0, at)])
                    held, count = [t.slice(at)], t.num_rows - at
        if held:
            yield out(held)

    dealt = rows.repartition("key", "part").sortWithinPartitions("key", "part")
    return map_arrow(dealt, run, "a long, b long")


def groups(docs: DataFrame, size: int = 4, bits: int = 4, bits2: int = 64, cell: int = CELL) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp, fp2) for every row, and (fp, fp2, node, root) for every different pair of fingerprints.

    node is the least doc_id with the fingerprints, root the least one reachable.
    Fingerprints of which no row has a doc_id have null for both and link nothing.
    """
    fps = save(fingerprints(docs, size, bits2 < 64), "fingerprints")
    reps = save(fps.groupBy("fp", "fp2").agg(F.min("doc_id").alias("node")), "representatives")
    found = save(links(reps.filter("node IS NOT NULL"), bits, bits2, None, cell), "links")
    met = components(found)
    drop_saved(found)
    out = reps.join(met.select(F.col("node").alias("_n"), "root"), F.col("node") == F.col("_n"), "left").select("fp", "fp2", "node", F.coalesce("root", "node").alias("root"))
    return fps, out


def near_duplicates(docs: DataFrame, **params) -> DataFrame:
    """doc_id, fp, component_id for every row."""
    fps, reps = groups(docs, **params)
    return fps.join(reps.withColumnsRenamed({"fp": "_f", "fp2": "_g"}), (F.col("fp") == F.col("_f")) & (F.col("fp2") == F.col("_g"))).select("doc_id", "fp", F.col("root").alias("component_id"))


# --- near-duplicates by the shingles themselves -----------------------------------------------------

#: Stage defaults: shingles of five words; a pair is linked if its shingle sets have a Jaccard similarity of 0.8 at least.
STAGE = {"size": 5, "least": 0.8}
#: Bits of 64 in which candidates by fingerprints differ at most. At a similarity of 0.8 the mean is 9.7: what is farther apart is left to the bands.
RADIUS = 10
#: Min-hashes in a band, and bands. A pair at 0.8 shares no band with a chance of (1 - 0.8^4)^24, 3 in a million.
DEPTH, BANDS = 4, 24
#: Fingerprints turn a candidate away beyond so many of 128 bits. Pairs at 0.8 differ in 19, with a deviation of 4; unrelated ones in 64.
FAR = 48
#: Nodes in a line when shingle sets are dealt to blocks.
LINE = 1000
_DRAW = np.random.default_rng(20).integers(0, 1 << 63, (2, DEPTH * BANDS), np.uint64)
_FLIP, _ODD = _DRAW[0], _DRAW[1] * np.uint64(2) + np.uint64(1)


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Hashes of the different shingles, sorted."""
    return np.unique(hashes(text, size))


def band_keys(s: np.ndarray) -> np.ndarray:
    """A key for each band of min-hashes of a set; none for an empty set."""
    if not len(s):
        return np.zeros(0, np.int64)
    low = np.full(DEPTH * BANDS, (1 << 64) - 1, np.uint64)
    for lo in range(0, len(s), 1 << 12):
        low = np.minimum(low, mix((s[lo : lo + (1 << 12), None] ^ _FLIP) * _ODD).min(0))
    keys = np.arange(BANDS, dtype=np.uint64)
    for m in low.reshape(BANDS, DEPTH).T:
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + m)
    return keys.view(np.int64)


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, _key, node, n, fp, fp2, keys) for every row; node is a digest of the shingle set, n its size."""
    schema = pa.schema([("doc_id", pa.int64()), ("_key", pa.int64()), ("node", pa.int64()), ("n", pa.int64()), ("fp", pa.int64()), ("fp2", pa.int64()), ("keys", pa.list_(pa.int64()))])

    def run(batches):
        for b in batches:
            for part in pieces(b):
                rows = []
                for text in part.column("text").to_pylist():
                    s = shingle_set(text, size)
                    rows.append((signed(xxhash.xxh64_intdigest(s.tobytes(), 7)), len(s), signed(majority(s)), signed(majority(mix(s))), band_keys(s)))
                yield batch(schema, part.column("doc_id"), part.column("_key"), *zip(*rows, strict=True))

    return map_arrow(docs.select("doc_id", text_key().alias("_key"), "text"), run, "doc_id long, _key long, node long, n long, fp long, fp2 long, keys array<long>")


def hopeful(pairs: DataFrame, about: DataFrame, least: float) -> DataFrame:
    """The (a, b) worth a look at their shingles: sizes that allow the similarity, and near fingerprints. about has node, n, fp, fp2."""
    side = lambda x: about.select(*[F.col(c).alias(f"{x}_{c}") for c in about.columns])
    met = pairs.join(side("a"), F.col("a") == F.col("a_node")).join(side("b"), F.col("b") == F.col("b_node"))
    return met.filter(_near(F.col("a_n"), F.col("b_n"), F.col("a_fp"), F.col("b_fp"), F.col("a_fp2"), F.col("b_fp2"), least)).select("a", "b")


def _near(n, m, fp, gp, fp2, gp2, least: float):
    differ = F.bit_count(fp.bitwiseXOR(gp)) + F.bit_count(fp2.bitwiseXOR(gp2))
    return (F.least(n, m) >= F.greatest(n, m) * F.lit(least)) & (differ <= FAR)


def reach(sa: np.ndarray, others: list[np.ndarray], least: float) -> np.ndarray:
    """Which of the other sorted sets have the Jaccard similarity with sa; no set is empty."""
    size = np.array([len(x) for x in others])
    flat = np.concatenate(others)
    hit = sa[np.minimum(np.searchsorted(sa, flat), len(sa) - 1)] == flat
    both = np.add.reduceat(hit, np.r_[0, np.cumsum(size)[:-1]], dtype=np.int64)
    return both / (len(sa) + size - both) >= least


def verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The (a, b) whose shingle sets reach the similarity.

    Nodes have a line by hash, and pairs of lines are blocks. A set goes once to each
    block that asks for it, so the pairs of a large group don't carry it each.
    """
    lines = 16 + sets.count() // LINE
    line = [F.pmod(F.xxhash64(c), F.lit(lines)) for c in ("a", "b")]
    dealt = pairs.select("a", "b", (line[0] * lines + line[1]).alias("block"))
    asked = dealt.select(F.explode(F.array("a", "b")).alias("a"), "block").distinct()
    of_block = asked.join(sets.withColumnRenamed("node", "a"), "a").select("block", F.lit(0).alias("kind"), "a", F.lit(None).cast("long").alias("b"), "set")
    both = of_block.unionByName(dealt.select("block", F.lit(1).alias("kind"), "a", "b", F.lit(None).cast("array<long>").alias("set")))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        block, held = None, {}
        for batch_ in batches:
            for part in pieces(batch_, 256):
                of, kind, x, y = (part.column(c).to_pylist() for c in ("block", "kind", "a", "b"))
                col, asked_of = part.column("set"), {}

                def flush():
                    return [(a, b) for a, bs in asked_of.items() for b, ok in zip(bs, reach(held[a], [held[b] for b in bs], least), strict=True) if ok]

                out = []
                for i in range(part.num_rows):
                    if of[i] != block:
                        out += flush()
                        asked_of.clear()
                        block, held = of[i], {}
                    if kind[i]:
                        asked_of.setdefault(x[i], []).append(y[i])
                    else:
                        held[x[i]] = np.array(col[i].values)
                out += flush()
                if out:
                    yield batch(schema, *zip(*out, strict=True))

    return map_arrow(both.repartition("block").sortWithinPartitions("block", "kind", "a"), run, "a long, b long")


def shingle_sets(docs: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """(node, set) of the rows given as doc_id, _key, node. Only texts that may be among them are shuffled."""
    schema = pa.schema([("node", pa.int64()), ("set", pa.list_(pa.int64()))])

    def run(batches):
        for b in batches:
            for part in pieces(b, 128):
                yield batch(schema, part.column("node"), [np.sort(shingle_set(t, size).view(np.int64)) for t in part.column("text").to_pylist()])

    asked = nodes.select(F.col("doc_id").alias("_d"), F.col("_key").alias("_k"), "node")
    some = may_hold(docs.select("doc_id", text_key().alias("_key"), "text"), F.col("_key"), asked.select("_k"), "_may").filter("_may").drop("_may")
    met = some.join(asked, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_key") == F.col("_k")))
    return map_arrow(met.select("node", "text"), run, "node long, set array<long>").dropDuplicates(["node"])


def joined_within(node: np.ndarray, root: np.ndarray, n: np.ndarray, fp: np.ndarray, fp2: np.ndarray, keys: np.ndarray, line: np.ndarray, sets: list[np.ndarray], band: int, both_lines: bool, least: float) -> list[tuple[int, int]]:
    """Links between the sets of one cell of a bucket that aren't joined yet, as a forest: no pair becomes a row.

    A pair is looked at in the first band only in which it agrees, and in one cell of
    it: rows of one line in that line's own cell, others where both lines meet.
    """
    _, label = np.unique(root, return_inverse=True)
    fp, fp2, out = fp.view(np.uint64), fp2.view(np.uint64), []
    for i in range(len(node) - 1):
        rest = slice(i + 1, None)
        ok = label[rest] != label[i]
        if both_lines:
            ok &= line[rest] != line[i]
        ok &= np.minimum(n[rest], n[i]) >= np.maximum(n[rest], n[i]) * least
        at = np.flatnonzero(ok) + i + 1
        at = at[np.bitwise_count(fp[at] ^ fp[i]).astype(np.int64) + np.bitwise_count(fp2[at] ^ fp2[i]) <= FAR]
        at = at[(keys[at] == keys[i]).argmax(1) == band] if len(at) else at
        if not len(at):
            continue
        for j in at[reach(sets[i], [sets[j] for j in at], least)].tolist():
            if label[i] != label[j]:
                out.append((int(node[i]), int(node[j])))
                label[label == label[j]] = label[i]
    return out


def in_cells(open_: DataFrame, cell: int) -> DataFrame:
    """Adds line, part and both: a bucket of more than cell rows has lines by hash, and a cell for every line and for every two of them; a row stands in all cells of its line."""
    large = save(open_.groupBy("key").count().filter(F.col("count") > cell).select(F.col("key").alias("_key"), F.ceil(F.col("count") / cell).alias("_n")), "large")
    met = open_.join(large, F.col("key") == F.col("_key"), "left").withColumn("_n", F.coalesce("_n", F.lit(1).cast("long"))).withColumn("line", F.pmod(F.xxhash64("node"), F.col("_n")))
    cells = F.transform(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1), lambda x: F.struct(F.least(x, F.col("line")).alias("lo"), F.greatest(x, F.col("line")).alias("hi")))
    return met.withColumn("part", F.explode(cells)).drop("_key", "_n")


def more_links(open_: DataFrame, sets: DataFrame, least: float, cell: int) -> DataFrame:
    """(a, b) from all pairs of sets that share a bucket, have other roots and the similarity: enough of them to connect all that are connected. A task holds the sets of one cell."""
    rows = in_cells(open_, cell).join(sets, "node")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        now, held = None, []

        def flush():
            key, lo, hi = now
            cols = [np.array([h[c] for h in held], np.int64) for c in range(5)]
            keys = np.stack([h[5] for h in held])
            band = int((keys[0] == key).argmax())
            return joined_within(*cols, keys, np.array([h[6] for h in held]), [h[7] for h in held], band, lo != hi, least)

        for b in batches:
            for part in pieces(b, 256):
                name = ("key", "lo", "hi", "node", "root", "n", "fp", "fp2", "line")
                key, lo, hi, *rest, line = (part.column(c).to_pylist() for c in name)
                keys, own, out = part.column("keys"), part.column("set"), []
                for i in range(part.num_rows):
                    if (at := (key[i], lo[i], hi[i])) != now:
                        out += flush() if len(held) > 1 else []
                        now, held = at, []
                    held.append((*(c[i] for c in rest), keys[i].values.to_numpy(), line[i], np.array(own[i].values)))
                if out:
                    yield batch(schema, *zip(*out, strict=True))
        if len(held) > 1 and (out := flush()):
            yield batch(schema, *zip(*out, strict=True))

    dealt = rows.select("key", "part.lo", "part.hi", "node", "root", "n", "fp", "fp2", "line", "keys", "set")
    return map_arrow(dealt.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "node"), run, "a long, b long")


#: Sets of a line in a large bucket.
LINE_SETS = 500


def by_fingerprints(docs: DataFrame, reps: DataFrame, size: int, least: float) -> tuple[DataFrame, DataFrame]:
    """(a, b) and (node, set), both saved: links with the similarity among candidates by the pigeonhole on fingerprints, RADIUS bits apart at most, and the sets of all candidates."""
    near = save(links(reps.select("node", "fp", "fp2"), RADIUS, FAR - RADIUS).distinct(), "near")
    sets = save(shingle_sets(docs, reps.select("doc_id", "_key", "node").join(_ends(near), "node", "left_semi"), size), "sets")
    found = save(verified(near, sets, least), "links")
    drop_saved(near)
    return found, sets


def alike(docs: DataFrame, size: int, least: float, cell: int = LINE_SETS) -> tuple[DataFrame, DataFrame]:
    """(doc_id, _key, node) of every row, and (node, root) of the sets linked to others: components over all pairs with the similarity.

    The pigeonhole on SimHash fingerprints gives the candidates, shingles verify them,
    and components are formed. What that radius can't reach is looked for in bands of
    min-hashes, among sets that are in different components by then: buckets of one
    component go at once. In the others, first each set is compared with the bucket's
    least node only, which joins most of a large group at a cost in proportion to it
    and is combined before the shuffle. Buckets that hold several groups after that are
    gone through pair by pair within tasks, in cells of a bounded number of sets; only
    links come out.
    """
    sketched = save(sketches(docs, size), "sketches")
    rows = sketched.select("doc_id", "_key", "node")
    reps = save(sketched.filter("n > 0").groupBy("node").agg(F.min(F.struct("doc_id", "_key")).alias("r"), *[F.first(c).alias(c) for c in ("n", "fp", "fp2", "keys")]).select("node", "r.*", "n", "fp", "fp2", "keys"), "representatives")
    about, place = reps.select("node", "n", "fp", "fp2"), reps.select("doc_id", "_key", "node")
    found, sets = by_fingerprints(docs, reps, size, least)
    first = components(found)
    dealt = _rooted(reps, first).select(F.explode("keys").alias("key"), "node", "root")
    centres = dealt.groupBy("key").agg(F.min(F.struct("node", "root")).alias("c"), F.min("root").alias("r"), F.max("root").alias("s")).filter("r < s").select("key", F.col("c.node").alias("c"), F.col("c.root").alias("c_root"))
    shared = save(dealt.join(centres, "key"), "buckets")
    drop_saved(first)
    stars = save(hopeful(shared.filter("root <> c_root").select(F.col("c").alias("a"), F.col("node").alias("b")).distinct(), about, least), "stars")
    others = save(shingle_sets(docs, place.join(_ends(stars), "node", "left_semi").join(sets, "node", "left_anti"), size), "sets")
    held = sets.unionByName(others)
    starred = save(found.unionByName(verified(stars, held, least)), "links")
    second = components(starred)
    known = save(_rooted(shared.select("key", "node"), second), "rooted")
    drop_saved(shared)
    mixed = known.groupBy("key").agg(F.min("root").alias("r"), F.max("root").alias("s")).filter("r < s").select("key")
    open_ = save(known.join(mixed, "key", "left_semi").join(reps.select("node", "n", "fp", "fp2", "keys"), "node"), "open")
    drop_saved(known, second)
    ends = open_.select("node").distinct()
    more = save(shingle_sets(docs, place.join(ends, "node", "left_semi").join(held, "node", "left_anti"), size), "sets")
    all_links = save(starred.unionByName(more_links(open_, held.join(ends, "node", "left_semi").unionByName(more), least, cell)), "links")
    out = components(all_links)
    drop_saved(stars, sets, others, found, starred, open_, more, all_links, reps)
    rows._saved = sketched._saved
    return rows, out


def _rooted(nodes: DataFrame, met: DataFrame) -> DataFrame:
    """nodes with root; a node without links is its own."""
    return nodes.join(met.select(F.col("node").alias("_n"), F.col("root").alias("_r")), F.col("node") == F.col("_n"), "left").withColumn("root", F.coalesce("_r", "node")).drop("_n", "_r")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()


def deduplicate(docs: DataFrame, size: int = STAGE["size"], least: float = STAGE["least"]) -> DataFrame:
    """docs with one document of each group: the one with the least doc_id, a null id counting as the greatest, then the least key of the text.

    Rows are told apart by doc_id and text; of rows that agree in both, one stays. Texts
    without words (null, empty) are copies of each other. Columns of any name are kept
    as they are. Only rows that may go, or that repeat, are shuffled with their texts.
    """
    rows, met = alike(docs, size, least)
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "_key")
    group = rows.groupBy("node", "doc_id", "_key").agg(F.count(F.lit(1)).alias("c")).join(met.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left").select("doc_id", "_key", "c", F.coalesce("root", "node").alias("root"))
    group = save(group, "groups")
    drop_saved(met, rows)
    keep = group.groupBy("root").agg(F.min(order).alias("k")).select(F.col("k.doc_id").alias("_d"), F.col("k._key").alias("_k"))
    # rows that go, and rows that stay but once; the join is by row, so a large group is dealt to all tasks
    met = group.join(keep, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_key") == F.col("_k")), "left")
    odd = save(met.select("doc_id", "_key", "c", F.col("_k").isNull().alias("gone")).filter("gone OR c > 1").select(F.col("doc_id").alias("_d"), F.col("_key").alias("_k"), "gone"), "odd")
    drop_saved(group)
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).withColumn("_key", text_key("row.text"))
    asked = may_hold(row, F.col("_key"), odd.select("_k"), "_may")
    maybe = asked.filter("_may").join(odd, F.col("row.doc_id").eqNullSafe(F.col("_d")) & (F.col("_key") == F.col("_k")), "left").filter("gone IS NULL OR NOT gone")
    hashed = F.xxhash64(*[F.col(f"row.`{f.name}`") for f in docs.schema if "map" not in f.dataType.simpleString()])
    once = maybe.filter("gone IS NOT NULL").groupBy(F.col("row.doc_id").alias("_d"), "_key").agg(F.min_by("row", hashed).alias("row"))
    out = asked.filter("NOT _may").select("row").unionByName(maybe.filter("gone IS NULL").select("row")).unionByName(once.select("row"))
    return out.select("row.*")
