"""Phrase collocations by hierarchical pair naming.

Frequent words get ids. A frequent phrase of k words is a pair of frequent phrases of
k - 1 words that stand one word apart; the pair gets an id of its own by a join over the
whole corpus, and every position that starts such a phrase is renamed to it. The two
parts of a pair are its parents: following left or right parents gives the counts of
every cut, and a phrase stands inside a longer one if it is a parent of it.

Texts are held in blocks: word codes of a block beside the block's own dictionary. Only
dictionaries are counted and shuffled; texts stay where they are. As long as a level's
names are few (HELD), every task holds them and renames its blocks; beyond, blocks'
dictionaries are joined with the names, and a block is renamed by its own part of the
result, so that no dictionary of the corpus is ever in one place. A hot word costs a row
a block either way.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import batch, drop_saved, lower_ascii, map_arrow, may_hold, pieces, save

#: A word, or what ends a piece.
TOKEN_RE = re.compile(r"[^\x20\x09.,;:!?\x0A-\x0D]+|[.,;:!?\x0A-\x0D]+")
ENDS = frozenset(".,;:!?\n\v\f\r")
#: Words of a block at most (a piece is never divided, so a block may pass this by one piece).
BLOCK = 600_000
#: Names that a task holds: of words, of pairs (24 bytes each).
HELD_WORDS, HELD_PAIRS = 400_000, 1_500_000
#: A language's least phrase count, longest phrase, and share (in hundredths) of a longer phrase that makes it redundant.
LEAST, LONGEST, INSIDE = 30, 4, 80

CODED = pa.schema([("block", pa.int64()), ("lang", pa.string()), ("codes", pa.binary()), ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int32()))])


class _Block:
    """Codes of one language's words, 0 between pieces."""

    def __init__(self) -> None:
        self.codes: list[int] = []
        self.of: dict[str, int] = {}

    def add(self, tokens: list[str]) -> None:
        of, codes = self.of, self.codes
        for t in tokens:
            codes.append(0 if t[0] in ENDS else of.setdefault(t, len(of) + 1))
        codes.append(0)

    def row(self, block: int, lang: str) -> tuple:
        c = np.array(self.codes, np.uint32)
        return block, lang, packed(c), list(self.of), np.bincount(c, minlength=len(self.of) + 1)[1:].astype(np.int32)


def packed(codes: np.ndarray) -> bytes:
    return zstandard.compress(codes.astype("<u4").tobytes(), 1)


def unpacked(b: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(b), "<u4").astype(np.int64)


def _numbers() -> Iterator[int]:
    """Numbers that no other task gives."""
    at = TaskContext.get().partitionId() << 32
    while True:
        yield at
        at += 1


def coded(docs: DataFrame) -> DataFrame:
    """block, lang, codes, words, counts. A null lang is und; a null text has no words."""

    def run(batches):
        number, open_ = _numbers(), defaultdict(_Block)
        for b in batches:
            for part in pieces(b):
                rows = []
                for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist(), strict=True):
                    tokens = TOKEN_RE.findall(lower_ascii(text or ""))
                    at = 0
                    while at < len(tokens):
                        block = open_[lang]
                        end = min(len(tokens), at + BLOCK)
                        while end < len(tokens) and tokens[end][0] not in ENDS:
                            end += 1
                        block.add(tokens[at:end])
                        at = end
                        if len(block.codes) >= BLOCK:
                            rows.append(open_.pop(lang).row(next(number), lang))
                # languages may be many: what is open stays bounded in all
                if sum(len(x.codes) for x in open_.values()) >= 2 * BLOCK:
                    rows += [x.row(next(number), lang) for lang, x in open_.items()]
                    open_.clear()
                if rows:
                    yield batch(CODED, *zip(*rows, strict=True))
        if open_:
            yield batch(CODED, *zip(*(x.row(next(number), lang) for lang, x in open_.items()), strict=True))

    return map_arrow(docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text"), run, "block long, lang string, codes binary, words array<string>, counts array<int>")


def adjacent(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Positions whose code and next code are both set, their pair keys, and the factor of the left one."""
    m = int(codes.max(initial=0)) + 1
    at = np.flatnonzero((codes[:-1] > 0) & (codes[1:] > 0)) if len(codes) > 1 else np.zeros(0, np.int64)
    return at, codes[at] * m + codes[at + 1] if len(at) else at, m


def squeezed(codes: np.ndarray) -> np.ndarray:
    """Codes without those that have no neighbour, and with one 0 between runs: all that longer phrases need."""
    on = codes > 0
    before, after = np.concatenate([[False], on[:-1]]), np.concatenate([on[1:], [False]])
    keep = (on & (before | after)) | (~on & before)
    codes = codes[keep]
    on = codes > 0
    return codes[on | np.concatenate([[False], on[:-1]])] if len(codes) else codes


PAIRS = pa.schema([("block", pa.int64()), ("l", pa.int64()), ("r", pa.int64()), ("n", pa.int64())])
NAMED = pa.schema([("block", pa.int64()), ("codes", pa.binary()), ("ids", pa.list_(pa.int64()))])


def pairs(named: DataFrame) -> DataFrame:
    """block, l, r, n: each block's distinct pairs of neighbours by id, with their count in it."""

    def run(batches):
        for b in batches:
            for block, codes, ids in zip(*(b.column(c).to_pylist() for c in ("block", "codes", "ids")), strict=True):
                _, keys, m = adjacent(unpacked(codes))
                u, n = np.unique(keys, return_counts=True)
                ids = np.array([0, *ids], np.int64)
                for s in range(0, len(u), 20_000):
                    k = u[s : s + 20_000]
                    yield batch(PAIRS, np.full(len(k), block, np.int64), ids[k // m], ids[k % m], n[s : s + 20_000])

    return map_arrow(named.select("block", "codes", "ids"), run, "block long, l long, r long, n long")


def renaming(codes: np.ndarray, found) -> np.ndarray:
    """Codes of the positions that start a named pair: its place, from 1, among what found gives, which are the named ones of a text's distinct pair keys, in order."""
    at, keys, m = adjacent(codes)
    wanted = found(np.unique(keys), m)
    out = np.zeros(len(codes), np.int64)
    if len(wanted):
        k = np.minimum(np.searchsorted(wanted, keys), len(wanted) - 1)
        out[at] = np.where(wanted[k] == keys, k + 1, 0)
    return squeezed(out)


def renamed(named: DataFrame, names: DataFrame) -> DataFrame:
    """block, codes, ids: positions that start a named pair hold it, all others nothing. names: l, r, id."""
    return renamed_held(named, names) if names.count() <= HELD_PAIRS else renamed_joined(named, names)


def renamed_held(named: DataFrame, names: DataFrame) -> DataFrame:
    l, r, new = (names.select("l", "r", "id").toArrow().column(c).to_numpy() for c in ("l", "r", "id"))  # noqa: E741
    ls, rs = np.unique(l), np.unique(r)
    keys = np.searchsorted(ls, l) * len(rs) + np.searchsorted(rs, r)
    order = np.argsort(keys)
    held = named.sparkSession.sparkContext.broadcast((ls, rs, keys[order], new[order]))

    def run(batches):
        ls, rs, names_, ids_of = held.value

        def place(x, among):
            k = np.minimum(np.searchsorted(among, x), max(len(among) - 1, 0))
            return k, among[k] == x if len(among) else np.zeros(len(x), bool)

        for b in batches:
            rows = []
            for block, codes, ids in zip(*(b.column(c).to_pylist() for c in ("block", "codes", "ids")), strict=True):
                ids, new = np.array([0, *ids], np.int64), []

                def found(u, m, ids=ids, new=new):
                    (i, there), (j, here) = place(ids[u // m], ls), place(ids[u % m], rs)
                    k, named_ = place(i * len(rs) + j, names_)
                    ok = there & here & named_
                    new.append(ids_of[k[ok]])
                    return u[ok]

                out = renaming(unpacked(codes), found)
                if len(out):
                    rows.append((block, packed(out), new[0]))
            if rows:
                yield batch(NAMED, *zip(*rows, strict=True))

    return map_arrow(named.select("block", "codes", "ids"), run, "block long, codes binary, ids array<long>")


def renamed_joined(named: DataFrame, names: DataFrame) -> DataFrame:
    key = lambda: F.xxhash64("l", "r")
    asked = may_hold(pairs(named).drop("n"), key(), names.select(key().alias("key")), "_may").filter("_may").drop("_may")
    found = asked.join(names.select("l", "r", "id"), ["l", "r"]).groupBy("block").agg(F.collect_list("l").alias("l"), F.collect_list("r").alias("r"), F.collect_list("id").alias("id"))

    def run(batches):
        for b in batches:
            rows = []
            for block, codes, ids, l, r, new in zip(*(b.column(c).to_pylist() for c in ("block", "codes", "ids", "l", "r", "id")), strict=True):  # noqa: E741
                ids = np.array([0, *ids], np.int64)
                order = np.argsort(ids)
                of = lambda x, s=ids[order], order=order: order[np.searchsorted(s, np.array(x, np.int64))]
                seq = unpacked(codes)
                wanted = of(l) * (int(seq.max(initial=0)) + 1) + of(r)
                by = np.argsort(wanted)
                out = renaming(seq, lambda u, m, w=wanted[by]: w)
                if len(out):
                    rows.append((block, packed(out), np.array(new, np.int64)[by]))
            if rows:
                yield batch(NAMED, *zip(*rows, strict=True))

    return map_arrow(named.join(found, "block"), run, "block long, codes binary, ids array<long>")


def words_named(blocks: DataFrame, words: DataFrame) -> DataFrame:
    """block, codes, ids of blocks of words; words that have no name are gaps. words: lang, word, id."""
    return words_held(blocks, words) if words.count() <= HELD_WORDS else words_joined(blocks, words)


def words_held(blocks: DataFrame, words: DataFrame) -> DataFrame:
    table: dict[str, dict[str, int]] = defaultdict(dict)
    for r in words.select("lang", "word", "id").toLocalIterator():
        table[r["lang"]][r["word"]] = r["id"]
    held = blocks.sparkSession.sparkContext.broadcast(dict(table))

    def run(batches):
        for b in batches:
            for part in pieces(b, 1):
                of = held.value.get(part.column("lang")[0].as_py(), {})
                ids = np.array([0, *(of.get(w, 0) for w in part.column("words")[0].as_py())], np.int64)
                to = np.cumsum(ids > 0) * (ids > 0)
                out = squeezed(to[unpacked(part.column("codes")[0].as_py())])
                if len(out):
                    yield batch(NAMED, part.column("block"), [packed(out)], [ids[ids > 0]])

    return map_arrow(blocks.select("block", "lang", "codes", "words"), run, "block long, codes binary, ids array<long>")


def words_joined(blocks: DataFrame, words: DataFrame) -> DataFrame:
    key = lambda: F.xxhash64("lang", "word")
    each = blocks.select("block", "lang", F.posexplode("words").alias("at", "word"))
    each = may_hold(each, key(), words.select(key().alias("key")), "_may").filter("_may").drop("_may")
    found = each.join(words.select("lang", "word", "id"), ["lang", "word"]).groupBy("block").agg(F.collect_list("at").alias("at"), F.collect_list("id").alias("id"))

    def run(batches):
        for b in batches:
            rows = []
            for block, codes, at, new in zip(*(b.column(c).to_pylist() for c in ("block", "codes", "at", "id")), strict=True):
                seq = unpacked(codes)
                to = np.zeros(max(int(seq.max(initial=0)), max(at) + 1) + 1, np.int64)
                to[np.array(at, np.int64) + 1] = np.arange(1, len(at) + 1)
                out = squeezed(to[seq])
                if len(out):
                    rows.append((block, packed(out), new))
            if rows:
                yield batch(NAMED, *zip(*rows, strict=True))

    return map_arrow(blocks.select("block", "codes").join(found, "block"), run, "block long, codes binary, ids array<long>")


def with_ids(df: DataFrame, name: str) -> DataFrame:
    """df with an id of its own, from 1, for each row, written once, so that ids stay as they are."""
    return save(df.withColumn("id", F.monotonically_increasing_id() + 1), name)


def chained(names: DataFrame, parts: DataFrame) -> DataFrame:
    """Named pairs with their words, and the counts of their beginnings (heads) and ends (tails) of 1, 2, ... words, from those of their parents."""
    left = parts.select(F.col("id").alias("l"), "lang", F.col("words").alias("lw"), F.concat("heads", F.array("f")).alias("heads"))
    right = parts.select(F.col("id").alias("r"), F.col("words").alias("rw"), F.concat("tails", F.array("f")).alias("tails"))
    return names.join(left, "l").join(right, "r").select("id", "lang", F.concat("lw", F.slice("rw", -1, 1)).alias("words"), "f", "heads", "tails")


def score(a: Column, l: Column, r: Column) -> Column:
    """floor(2000000 * a / (l + r)); the product may pass 64 bits."""
    return F.call_function("div", F.lit(2_000_000).cast("decimal(10,0)") * a.cast("decimal(20,0)"), (l + r).cast("decimal(20,0)"))


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, inside: int = INSIDE, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's phrases of 2 to longest words with the best worst cut.

    Words and pieces follow ASCII; only A-Z are lower-cased. A null lang is und, a null
    or empty text has no words, repeated rows all count. A phrase that occurs at least
    least times is a candidate; it goes if a longer one that holds it has inside
    hundredths of its count. Longer phrases are never more frequent than their parts,
    so the pairs made of a phrase decide. Ties of the score go to the more frequent,
    then to the phrase of lower bytes. Other columns are ignored; an empty table gives
    no rows.
    """
    blocks = save(coded(docs), "blocks")
    sizes = save(blocks.groupBy("lang").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda s, x: s + x)).alias("n")), "sizes")
    counted = blocks.select("lang", F.explode(F.arrays_zip(F.col("words").alias("word"), F.col("counts").alias("c"))).alias("x")).groupBy("lang", F.col("x.word").alias("word")).agg(F.sum("x.c").alias("f"))
    names = with_ids(counted.filter(F.col("f") >= least), "words")
    named = save(words_named(blocks, names), "named1")
    drop_saved(blocks)
    level = names.select("id", "lang", F.array("word").alias("words"), "f", *(F.array().cast("array<long>").alias(c) for c in ("heads", "tails")))
    levels = []
    for k in range(2, longest + 1):
        names = with_ids(pairs(named).groupBy("l", "r").agg(F.sum("n").alias("f")).filter(F.col("f") >= least), f"names{k}")
        had = named
        if k < longest:
            named = save(renamed(named, names), f"named{k}")
        drop_saved(had)
        level = save(chained(names, level), f"phrases{k}")
        levels.append((names, level))

    out = None
    for k, (_, level) in enumerate(levels):
        if k + 1 < len(levels):
            above = levels[k + 1][0]
            held = above.select(F.col("l").alias("id"), "f").unionByName(above.select(F.col("r").alias("id"), "f")).groupBy("id").agg(F.max("f").alias("above"))
            level = level.join(held, "id", "left").filter(F.coalesce(F.col("above").cast("decimal(20,0)") * 100 < F.col("f").cast("decimal(20,0)") * inside, F.lit(True)))
        # cut after j + 1 words: heads[j] against the tail of the rest
        cuts = F.transform("heads", lambda l, j: F.struct(score(F.col("f"), l, F.get("tails", F.size("tails") - 1 - j)).alias("score"), j.alias("j"), l.alias("l"), F.get("tails", F.size("tails") - 1 - j).alias("r")))
        part = level.select("lang", F.array_join("words", " ").alias("phrase"), F.col("f").alias("a"), F.array_min(cuts).alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
        out = part if out is None else out.unionByName(part)
    by = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    first = out.withColumn("rank", F.row_number().over(by).cast("long")).filter(F.col("rank") <= top)
    return first.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


SQL = """
WITH piece AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS p FROM documents),
ws AS (SELECT lang, regexp_extract_all(p, '[^\\x20\\x09]+') AS w FROM piece),
grams AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
    FROM (SELECT lang, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM ws, (VALUES (1), (2), (3), (4)) ks(k) WHERE len(w) >= k)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 30),
sizes AS (SELECT lang, count(*) AS n FROM grams WHERE k = 1 GROUP BY lang),
cand AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
cuts AS (SELECT c.lang, c.k, c.phrase, c.a, j, x.f AS l, y.f AS r, (2000000::HUGEINT * c.a) // (x.f + y.f) AS score
    FROM (SELECT *, unnest(generate_series(1, k - 1)) AS j FROM cand) c
    JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:j], ' ')
    JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[j + 1:], ' ')),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inner_ AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS above
    FROM (SELECT *, unnest(generate_series(1, k - m + 1)) AS i FROM (SELECT *, unnest(generate_series(2, k - 1)) AS m FROM cand WHERE k > 2)) GROUP BY ALL),
stay AS (SELECT c.* FROM lowest c LEFT JOIN inner_ i USING (lang, phrase) WHERE i.above IS NULL OR 100 * i.above < 80 * c.a)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM stay) JOIN sizes USING (lang)
WHERE rank <= 2000
"""
