"""Source divergence audit: how far the term shares of a language's sources lie from each other and from the language.

Rows become their terms, counted by (lang, source, term), and every group gets every kept
term of its language, with a count of zero where it has none; the groups of a language are
joined with each other term by term, and sums ranked. Shares are integers in
billionths, smoothed by one occurrence, so all arithmetic is exact.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import batch, drop_saved, lower_ascii, map_arrow, pieces, save

#: Runs of ASCII letters and of anything beyond ASCII.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Parts into which the terms of a language are dealt where they meet its groups, so that one language is many tasks.
SALTS = 64
#: Cells that a task holds before it hands them on.
HELD = 300_000
#: Shares are in billionths.
SCALE = 1_000_000_000


def named(docs: DataFrame) -> DataFrame:
    return docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")), "text")


CELLS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("d", pa.int64())])
TERM_RE = re.compile(TERM)


def cells(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), d (rows that hold it). Tasks count the matches of the rows they read before these become rows."""

    def run(batches):
        held: dict[tuple[str, str], tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))

        def rows():
            for (lang, source), (n, d) in held.items():
                terms = list(n)
                yield batch(CELLS, [lang] * len(terms), [source] * len(terms), terms, list(n.values()), [d[t] for t in terms])
            held.clear()

        for b in batches:
            for part in pieces(b):
                for lang, source, text in zip(*(part.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
                    n, d = held[lang, source]
                    found = TERM_RE.findall(lower_ascii(text or ""))
                    n.update(found)
                    d.update(set(found))
                if sum(len(n) for n, _ in held.values()) > HELD:
                    yield from rows()
        yield from rows()

    return map_arrow(named(docs), run, "lang string, source string, term string, n long, d long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))


def kept_cells(docs: DataFrame, least: int) -> DataFrame:
    """lang, source, term, n, total (in the language) of the terms in at least so many rows of the language."""
    found = save(cells(docs), "cells")
    kept = found.groupBy("lang", "term").agg(F.sum("d").alias("d"), F.sum("n").alias("total")).filter(F.col("d") >= least).drop("d")
    out = save(found.drop("d").join(kept, ["lang", "term"]), "kept")
    drop_saved(found)
    return out


def share(n: Column, total: Column, v: Column) -> Column:
    """1 + floor(SCALE * (n + 1) / (total + v)); decimals where the product may pass 64 bits."""
    wide = F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * (n + 1).cast("decimal(20,0)"), (total + v).cast("decimal(20,0)"))
    return F.lit(1) + F.when(n < 2**33, F.call_function("div", F.lit(SCALE).cast("long") * (n + 1), total + v)).otherwise(wide)


def apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def divergence(docs: DataFrame, least: int = 3, top: int = 200) -> DataFrame:
    """lang, source, part, item, value, rank.

    Part pair: for each group each other source of its language, by the sum over all
    kept terms of (p - q)^2 / q; all of them. Part term: for each group the kept terms
    it uses more than its language does, the first top of them. Null lang, source and
    text count as ''; rows are documents, repeated ones too; a group without terms has
    a share for every kept term; a language without kept terms has distances of 0 and
    no terms. Other columns are ignored; an empty table gives no rows. A sum stays
    below 2^63 as long as a language keeps fewer than 10^9 terms.
    """
    kept = kept_cells(docs, least)
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
    sizes = kept.groupBy("lang", "term").agg(F.first("total").alias("total")).groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("lang_n"))
    groups = named(docs).select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(sizes, "lang", "left").na.fill(0, ["group_n", "v", "lang_n"])
    groups = save(groups.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("source"))).withColumn("least", share(F.lit(0).cast("long"), F.col("group_n"), F.greatest("v", F.lit(1)))), "groups")

    shares = kept.join(groups, ["lang", "source"]).select("lang", "source", "term", "k", share(F.col("n"), F.col("group_n"), F.col("v")).alias("p"), share(F.col("total"), F.col("lang_n"), F.col("v")).alias("q"))
    shares = save(shares, "shares")
    terms = shares.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), apart(F.col("p"), F.col("q")).alias("value"))

    # every group's share of a term: its own, or that of a count of zero
    salts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))
    langs = groups.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("k", "least"))).alias("groups")).withColumn("salt", salts)
    by_term = shares.groupBy("lang", "term").agg(F.map_from_entries(F.collect_list(F.struct("k", "p"))).alias("of")).withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(SALTS)))
    dense = by_term.join(langs, ["lang", "salt"]).select("lang", F.transform("groups", lambda g: F.coalesce(F.element_at("of", g["k"]), g["least"])).alias("ps"))
    left = dense.select("lang", "ps", F.posexplode("ps").alias("i", "p"))
    sums = left.select("lang", "i", "p", F.posexplode("ps").alias("j", "q")).filter("i <> j").groupBy("lang", "i", "j").agg(F.sum(apart(F.col("p"), F.col("q"))).alias("value"))
    other = groups.select("lang", F.col("source").alias("item"), (F.col("k") - 1).alias("j"))
    pairs = groups.select("lang", "source", (F.col("k") - 1).alias("i")).join(other, "lang").filter("i <> j").join(sums, ["lang", "i", "j"], "left")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0).cast("long")).alias("value"))

    by = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    first = terms.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(by)).unionByName(first)


SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}') AS ts FROM documents),
words AS (SELECT r, lang, source, unnest(ts) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS total FROM words GROUP BY ALL HAVING count(DISTINCT r) >= 3),
sizes AS (SELECT lang, count(*) AS v, sum(total) AS lang_n FROM kept GROUP BY lang),
cells AS (SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY ALL),
sums AS (SELECT lang, source, sum(n) AS group_n FROM cells GROUP BY ALL),
groups AS (SELECT g.lang, g.source, coalesce(group_n, 0) AS group_n FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN sums USING (lang, source)),
dense AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (g.group_n + z.v) AS p,
    1 + (1000000000::HUGEINT * (k.total + 1)) // (z.lang_n + z.v) AS q
    FROM groups g JOIN kept k USING (lang) JOIN sizes z USING (lang) LEFT JOIN cells c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
distances AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
    FROM dense a JOIN dense b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
parts AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(d.value, 0) AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN distances d ON d.lang = a.lang AND d.source = a.source AND d.item = b.source
    UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM dense WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts)
WHERE part = 'pair' OR rank <= 200
"""
