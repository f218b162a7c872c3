"""Main text of web pages by wrappers: union-free regular expressions over a site's token streams.

Every page is a stream of element and text tokens. Pages of a host are aligned one after
the other: what agrees is merged, an element that one side lacks becomes optional, one
that recurs becomes repeated (with all that stands between, as a repeated group of
optional elements), texts that differ become slots, and texts that agree stay part of
the template. Each token of the wrapper carries what its pages had there, which says
whether it is article, menu or template; pages are then read along their wrapper.
"""

from __future__ import annotations

import json
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, drop_saved, map_arrow, pieces, save
from .markup import BEGIN, HEADING, TEXT, events

#: A wrapper token: signature, says other, says main, pages, occurrences, characters, those in links, digest of its texts where all agree, optional, repeated, group of repetition, tokens inside.
SIG, OTHER, MAIN, PAGES, OCC, CHARS, LINKS, SAME, OPT, PLUS, GROUP, KIDS = range(12)
#: Two elements of a signature are one token if their contents overlap so far.
ALIKE = 0.6
#: Pages on which a text must agree, while others differ, to be template.
TEMPLATE = 3
#: Ways of choosing the article, see levels().
WAYS = 5
#: Tokens a task holds before it hands its wrappers on; partial wrappers merged in a task.
TOKENS, FAN_IN = 20_000, 32


def weights(t: list) -> dict[str, int]:
    out: dict[str, int] = {}
    for k in t[KIDS]:
        out[k[SIG]] = out.get(k[SIG], 0) + k[CHARS] + 1
    return out


def overlap(a: dict[str, int], b: dict[str, int]) -> float:
    """Mean share of either side's content, by characters, that stands in elements the other has too; empty ones go with anything."""
    if not a or not b:
        return ALIKE
    both = a.keys() & b.keys()
    return (sum(a[s] for s in both) / sum(a.values()) + sum(b[s] for s in both) / sum(b.values())) / 2


def scale(a: float, b: float, leaf: bool) -> float:
    """How near two sizes are; those of elements that hold nothing but text say nothing."""
    return 1.0 if leaf else (min(a, b) / max(a, b)) ** 0.25


def is_leaf(signatures) -> bool:
    return all(s[0] == "#" for s in signatures)


def best(t: list, among: list, within: bool) -> int:
    """Index of the token that t is an occurrence of, or -1: the one of its signature most like it. within: a page, where siblings must also be of a size to be one token."""
    found = [k for k, x in enumerate(among) if x[SIG] == t[SIG]]
    if not found or t[SIG][0] == "#":
        return found[0] if found else -1
    mine, at, most = weights(t), -1, 0.0
    for k in found:
        theirs = weights(among[k])
        same = overlap(mine, theirs)
        sized = same * scale(t[CHARS] / t[OCC] + 1, among[k][CHARS] / among[k][OCC] + 1, is_leaf(mine) or is_leaf(theirs))
        if sized > most and (sized if within else same) >= ALIKE:
            at, most = k, sized
    return at


def add(a: list, b: list, pages: bool) -> None:
    """b, an occurrence of a on another page or again on the same, goes into a."""
    a[OTHER], a[MAIN] = a[OTHER] and b[OTHER], a[MAIN] and b[MAIN]
    a[PAGES] = a[PAGES] + b[PAGES] if pages else max(a[PAGES], b[PAGES])
    a[OCC], a[CHARS], a[LINKS] = a[OCC] + b[OCC], a[CHARS] + b[CHARS], a[LINKS] + b[LINKS]
    if a[SAME] != b[SAME]:
        a[SAME] = None
    if pages:
        a[OPT], a[PLUS] = a[OPT] or b[OPT], a[PLUS] or b[PLUS]
    a[KIDS] = aligned(a[KIDS], b[KIDS], pages)


def aligned(a: list, b: list, pages: bool = True) -> list:
    """Two contents as one. Tokens only one side has become optional, in their place; tokens in another order become a repeated group."""
    if not a or not b:
        out = a or b
        for t in out:
            t[OPT] = True
        return out
    out, met, last, crossed = list(a), set(), -1, []
    become = {id(t): t for t in a}  # the token that each token of a side is part of now
    place: list[tuple[int, list]] = []  # tokens of b alone, with the token of a they follow
    for t in b:
        k = best(t, a, False)
        if k >= 0 and k not in met:
            met.add(k)
            become[id(t)] = a[k]
            add(a[k], t, pages)
            if k < last:
                crossed.append((k, last))
            last = max(last, k)
        else:
            t[OPT] = True
            become[id(t)] = t
            place.append((last, t))
    for k, t in enumerate(a):
        t[OPT] = t[OPT] or k not in met
    for after, t in reversed(place):
        out.insert(after + 1, t)
    at = {id(t): k for k, t in enumerate(out)}
    spans = [(at[id(a[k])], at[id(a[j])]) for k, j in crossed]
    # groups of either side stay groups over whatever has come between
    for groups in (a, b):
        found: dict[int, list[int]] = {}
        for t in groups:
            if t[GROUP]:
                found.setdefault(t[GROUP], []).append(at[id(become[id(t)])])
        spans += [(min(x), max(x)) for x in found.values()]
    return grouped(out, spans)


def grouped(tokens: list, spans: list[tuple[int, int]]) -> list:
    """Spans that overlap become one repeated group."""
    for t in tokens:
        t[GROUP] = 0
    group, end = 0, -1
    for i, j in sorted(spans):
        if i > end:
            group += 1
        for t in tokens[i : j + 1]:
            t[GROUP], t[PLUS] = group, True
            if j > i:
                t[OPT] = True
        end = max(end, j)
    return tokens


def folded(kids: list) -> list:
    """One page's content with recurring elements as one repeated token, and what stands between as their group."""
    out: list = []
    first: list[int] = []
    last: list[int] = []
    for pos, t in enumerate(kids):
        k = best(t, out, True)
        if k < 0:
            out.append(t)
            first.append(pos)
            last.append(pos)
        else:
            add(out[k], t, False)
            last[k] = pos
    spans = []
    for k, (i, j) in enumerate(zip(first, last, strict=True)):
        if j > i:
            spans.append((k, max(m for m in range(len(out)) if first[m] <= j)))
    return grouped(out, spans)


def token(sig: str, chars: int, links: int, same: int | None, kids: list, other: bool = False, main: bool = False) -> list:
    return [sig, other, main, 1, 1, chars, links, same, False, False, 0, kids]


def text_token(text: str, links: int) -> list:
    return token("#a" if 2 * links > len(text) else "#", len(text), links, xxhash.xxh3_64_intdigest(text), [])


def element(sig: str, other: bool, main: bool, kids: list) -> list:
    same = [k[SAME] for k in kids]
    digest = None if None in same else xxhash.xxh3_64_intdigest(repr((sig, same)))
    return token(sig, sum(k[CHARS] for k in kids), sum(k[LINKS] for k in kids), digest, folded(kids), other, main)


def wrapper_of(page: str) -> list:
    """The wrapper of a single page."""
    stack: list[tuple] = [("", False, False, [])]
    for e in events(page):
        if e[0] == BEGIN:
            stack.append((e[1], e[2], e[3], []))
        elif e[0] == TEXT:
            stack[-1][3].append(text_token(e[1], e[2]))
        else:
            done = element(*stack.pop())
            stack[-1][3].append(done)
    return element(*stack[0])


def size_of(t: list) -> int:
    return 1 + sum(size_of(k) for k in t[KIDS])


def expression(t: list) -> str:
    """The wrapper as a regular expression over tokens, for reading."""
    out, group = [], 0
    for k in t[KIDS]:
        if k[GROUP] != group:
            out.append((")+" if group else "") + ("(" if k[GROUP] else ""))
            group = k[GROUP]
        one = k[SIG] if k[SIG][0] == "#" else f"<{k[SIG]}>{expression(k)}</>"
        out.append(one + ("?" if k[OPT] else ""))
    return " ".join([*out, ")+"] if group else out)


# --- what of a wrapper is article ----------------------------------------------------------------

CONTAINERS = frozenset("div section ul ol dl table tbody thead tr td center details hgroup address".split())


def name_of(t: list) -> str:
    return t[SIG].partition(".")[0]


def walk(t: list):
    yield t
    for k in t[KIDS]:
        yield from walk(k)


def told_apart(t: list, parent: list) -> bool:
    """Template: the same text on all of several pages whose other texts differ."""
    return t[SAME] is not None and parent[SAME] is None and t[PAGES] >= TEMPLATE and t[PAGES] >= parent[PAGES] and not t[OPT]


def guarded(t: list) -> bool:
    """Holds what only an article's surroundings hold, whatever its name says: a form or a layout around the whole page."""
    return name_of(t) not in ("article", "header") and any(name_of(k) in ("article", "main", "h1") and not k[OTHER] and not (k[SAME] is not None and k[PAGES] >= TEMPLATE) for k in walk(t) if k is not t)


def left_out(t: list, parent: list, inside: bool) -> bool:
    """Whether a token and all in it are no part of the article. inside: of an article or main element."""
    name = name_of(t)
    if name[:1] == "#":
        return False
    if t[OTHER] and not guarded(t) or name == "header" and not inside:
        return True
    if name in CONTAINERS and t[CHARS] and t[LINKS] > (0.8 if inside else 0.6) * t[CHARS]:
        return True
    return (name in CONTAINERS or "." in t[SIG] and name not in HEADING) and told_apart(t, parent)


def levels(root: list) -> dict[int, int]:
    """For each token by id: a bit for each way of choosing the article that takes the texts right in it. The ways: article elements, main elements, elements whose class says so, the innermost element with most of the text, and all that is not left out; each with the page's heading if it has none."""
    out: dict[int, int] = {}
    kept: dict[int, int] = {}  # characters that are not left out

    def keep(t: list, parent: list, inside: bool) -> int:
        if left_out(t, parent, inside):
            return 0
        inside = inside or name_of(t) in ("article", "main")
        kept[id(t)] = t[CHARS] if t[SIG][:1] == "#" else sum(keep(k, t, inside) for k in t[KIDS])
        return kept[id(t)]

    def outermost(t: list, wanted) -> list:
        if id(t) not in kept:
            return []
        return [t] if wanted(t) else [x for k in t[KIDS] for x in outermost(k, wanted)]

    root_ = token("", 0, 0, None, [root])
    keep(root, root_, False)

    def take(t: list, bit: int) -> None:
        if id(t) in kept:
            out[id(t)] = out.get(id(t), 0) | bit
            for k in t[KIDS]:
                take(k, bit)

    def headings(t: list) -> list:
        """h1 outside of what is left out, a page's header included."""
        if name_of(t) == "h1":
            return [] if t[SAME] is not None and t[PAGES] >= TEMPLATE else [t]
        return [x for k in t[KIDS] if name_of(k) == "header" or id(k) in kept for x in headings(k)] if t is root or id(t) in kept or name_of(t) == "header" else []

    total = kept.get(id(root), 0)
    pages = max(1, root[PAGES])
    regions = []
    for wanted, least in ((lambda t: name_of(t) == "article", 0.25), (lambda t: name_of(t) == "main", 0.25), (lambda t: t[MAIN], 0.4)):
        found = outermost(root, wanted)
        regions.append(found if found and sum(kept[id(t)] for t in found) >= least * total * min(1, max(t[PAGES] for t in found) / pages) else [])
    at = root
    while True:
        most = [k for k in at[KIDS] if k[SIG][0] != "#" and kept.get(id(k), 0) >= 0.8 * kept.get(id(at), 0) and any(x[SIG][0] != "#" for x in k[KIDS])]
        if not most or not kept.get(id(at)):
            break
        at = most[0]
    regions += [[at], [root]]
    heads = headings(root)
    for k, region in enumerate(regions):
        for t in region:
            take(t, 1 << k)
        if region and heads and not any(name_of(x) == "h1" for t in region for x in walk(t)):
            for h in heads:
                for x in walk(h):
                    kept.setdefault(id(x), x[CHARS])
                take(h, 1 << k)
    return out


def rules(root: list) -> str:
    """What reading a page needs of its wrapper: signature, bits, weights, tokens inside (where these differ in bits) and size."""
    bits = levels(root)

    def rule(t: list) -> list:
        mine = bits.get(id(t), 0)
        kids = [] if all(bits.get(id(x), 0) == mine for x in walk(t)) else [rule(k) for k in t[KIDS]]
        return [t[SIG], mine, weights(t), kids, t[CHARS] / t[OCC] + 1]

    return json.dumps(rule(root), separators=(",", ":"), ensure_ascii=False)


@lru_cache(64)
def rules_read(text: str) -> list:
    return json.loads(text)


def text_of(page: str, rule: list) -> str:
    """The blocks of the article, one a line: by the first way of choosing it that finds any."""
    root: list = ["", [], 0]
    stack, texts = [root], []
    for e in events(page):
        if e[0] == BEGIN:
            stack[-1][1].append(new := [e[1], [], 0])
            stack.append(new)
        elif e[0] == TEXT:
            stack[-1][1].append(("#a" if 2 * e[2] > len(e[1]) else "#", e[1], len(e[1])))
        else:
            done = stack.pop()
            done[2] = sum(k[2] for k in done[1])

    def of(t, among: list) -> list | None:
        found = [r for r in among if r[0] == t[0]]
        if len(found) < 2 or t[0][0] == "#":
            return found[0] if found else None
        mine: dict[str, int] = {}
        for k in t[1]:
            mine[k[0]] = mine.get(k[0], 0) + k[2] + 1
        return max(found, key=lambda r: overlap(mine, r[2]) * scale(t[2] + 1, r[4], is_leaf(mine) or is_leaf(r[2])))

    def read(t, r: list | None, bits: int) -> None:
        if t[0] and t[0][0] == "#":
            texts.append((bits, t[1]))
            return
        for k in t[1]:
            below = of(k, r[3]) if r and r[3] else None
            read(k, below, below[1] if below else bits if not (r and r[3]) else 0)

    read(root, rule, rule[1])
    for way in range(WAYS):
        if any(b >> way & 1 for b, _ in texts):
            return "\n".join(x for b, x in texts if b >> way & 1)
    return ""


# --- over a table of pages -----------------------------------------------------------------------

#: Pages of a URL without a host are a site of their own.
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
PARTIAL = pa.schema([("host", pa.string()), ("wrapper", pa.string())])


def with_host(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "url", "html", F.lower(F.coalesce(F.regexp_extract("url", HOST, 1), F.lit(""))).alias("host"))


def dump(t: list) -> str:
    return json.dumps(t, separators=(",", ":"), ensure_ascii=False)


def partial_wrappers(pages: DataFrame) -> DataFrame:
    """host, wrapper: each task aligns the pages it reads, host by host."""

    def run(batches):
        held: dict[str, list] = {}
        size = 0
        for b in batches:
            for part in pieces(b, 64):
                for host, page in zip(part.column("host").to_pylist(), part.column("html").to_pylist(), strict=True):
                    new = wrapper_of(page or "")
                    if host in held:
                        add(held[host], new, True)
                    else:
                        held[host] = new
                    size += size_of(new)
                # size counts before merging: look at what is held only when it may be too much
                if size > TOKENS:
                    size = sum(size_of(t) for t in held.values())
                    if size > TOKENS:
                        yield batch(PARTIAL, list(held), [dump(t) for t in held.values()])
                        held, size = {}, 0
        if held:
            yield batch(PARTIAL, list(held), [dump(t) for t in held.values()])

    return map_arrow(pages.select("host", "html"), run, "host string, wrapper string")


def merged(partial: DataFrame, buckets: DataFrame) -> DataFrame:
    """One wrapper for each host and bucket. buckets: host and its number of buckets."""

    def one(pdf):
        found = [json.loads(w) for w in sorted(pdf["wrapper"])]
        for t in found[1:]:
            add(found[0], t, True)
        pdf = pdf.iloc[:1][["host", "wrapper"]].copy()
        pdf["wrapper"] = dump(found[0])
        return pdf

    dealt = partial.join(buckets, "host").withColumn("bucket", F.pmod(F.xxhash64("wrapper", F.monotonically_increasing_id()), F.col("buckets")))
    return dealt.groupBy("host", "bucket").applyInPandas(one, "host string, wrapper string")


def infer(pages: DataFrame) -> DataFrame:
    """host, wrapper (JSON) of a table of pages.

    A task aligns its own pages; partial wrappers are merged some FAN_IN at a time in
    as many rounds as the host with the most needs, so no host is one task's work.
    """
    wrappers = save(partial_wrappers(with_host(pages)), "wrappers")
    while (most := wrappers.groupBy("host").count().agg(F.max("count")).first()[0] or 0) > 1:
        buckets = wrappers.groupBy("host").agg(F.count(F.lit(1)).alias("n")).select("host", F.ceil(F.col("n") / (FAN_IN if most > FAN_IN else most)).alias("buckets"))
        before = wrappers
        wrappers = save(merged(wrappers, buckets), "wrappers")
        drop_saved(before)
    return wrappers


EXTRACTED = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row.

    text holds the article's blocks, one a line; a null or empty page, or one without
    an article, has an empty one. Menus, headers, footers, sidebars, notices, adverts,
    forms, comments of readers and template texts are left out; in an article, lists
    and boxes that are links but for a fifth go with the menus. br is white space
    within its block; white space is what Unicode says. Rows without a host are a site
    of their own; repeated rows are read alike. Other columns are ignored; an empty
    table gives no rows.
    """

    def to_rules(batches):
        for b in batches:
            yield batch(PARTIAL, b.column("host"), [rules(json.loads(w)) for w in b.column("wrapper").to_pylist()])

    wrappers = infer(pages)
    found = save(map_arrow(wrappers.select("host", "wrapper"), to_rules, "host string, rules string"), "rules")
    drop_saved(wrappers)

    def run(batches):
        for b in batches:
            for part in pieces(b, 64):
                texts = [text_of(page, rules_read(r)) if page else "" for page, r in zip(part.column("html").to_pylist(), part.column("rules").to_pylist(), strict=True)]
                yield batch(EXTRACTED, part.column("page_id"), part.column("url"), texts, [len(t) for t in texts])

    return map_arrow(with_host(pages).join(found, "host").select("page_id", "url", "html", "rules"), run, "page_id long, url string, text string, n_chars long")
