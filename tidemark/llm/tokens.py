"""Token ids of whole texts by the tokenizers library, and a Huffman-coded file format for them."""

from __future__ import annotations

import heapq
import os
import string
import zlib
from array import array
from codecs import charmap_decode
from collections import Counter
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, drop_saved, map_arrow, pieces, save, text_key

END = 0
SPECIAL = "<|endoftext|>"
#: Units that a worker remembers; older ones go when it is full.
REMEMBER = 250_000
#: Characters of texts that are cut into units together.
SLICE = 1 << 22
#: White space other than blank and newline, as Unicode has it: a text with any is encoded in one piece.
OTHER_SPACE = "".join(map(chr, [9, 11, 12, 13, 28, 29, 30, 31, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: Marks the unit at the start of a text; texts that hold it are encoded in one piece.
FIRST = "\0"
PUNCTUATION, ID = string.punctuation, attrgetter("id")
RUNS = [a + b + c for a in " \n" for b in " \n" for c in " \n"]


def _byte_letters() -> list[str]:
    """The character that a byte-level vocabulary shows for each byte: itself if it is printable, else the next from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Units(dict):
    """unit -> ids as bytes, made when first asked for; None isn't kept. When it is full, one generation of older units is kept beside it."""

    def __init__(self, make):
        self.make, self.older = make, {}
        super().__init__()

    def __missing__(self, unit: str) -> bytes | None:
        raw = self.older.get(unit)
        if raw is None:
            raw = self.make(unit)
        if raw is not None:
            self.keep(unit, raw)
        return raw

    def keep(self, unit: str, raw: bytes) -> None:
        if len(self) >= REMEMBER:
            self.older = dict(self)
            self.clear()
        self[unit] = raw


class Encoder:
    """encode(text) as bytes of little-endian unsigned 32-bit ids.

    A byte-level tokenizer of this kind never joins what stands before a blank or
    newline to what follows, unless white space runs on. So a text is cut before each
    of them and each distinct unit encoded once and remembered; texts with other
    white space, with runs of three or at their end, or with the special token's
    string are encoded in one piece. Either way the ids are the library's.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = self.tokenizer.token_to_id(SPECIAL)
        self.words, self.odds, self.tails = Units(self.word), Units(self.odd), {}
        self.tokenize, self.letters = self.tokenizer.model.tokenize, "".join(_byte_letters())
        self.newline = self.whole("\n")
        self.by_unit = self.special is not None and '"ByteLevel"' in (head := self.tokenizer.to_str()) and '"normalizer":null' in head.replace(" ", "")

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def plain(self, text: str) -> bool:
        """May the text be cut?"""
        if not self.by_unit or text[-2:].isspace() or SPECIAL in text or FIRST in text:
            return False
        return not any(map(text.__contains__, OTHER_SPACE)) and not any(map(text.__contains__, RUNS))

    def word(self, core: str) -> bytes | None:
        """Ids of a unit without punctuation at its end, if it is one word: that is one piece of the pre-tokenizer, with the blank before it but not the newline, and goes straight to the library's model."""
        lead = core[:1]
        bare = lead == FIRST or lead == "\n"
        word = core[1:] if bare else core
        if not word.isalpha():
            return None
        shown = word if word.isascii() else charmap_decode(word.encode(), "strict", self.letters)[0]
        raw = array("I", map(ID, self.tokenize(shown if bare else "Ġ" + shown))).tobytes()
        return self.newline + raw if lead == "\n" else raw

    def known(self, cores: list[str]) -> list[bytes | None]:
        """words of each; new words after a blank are spelled in the vocabulary's letters all at once."""
        got = list(map(self.words.get, cores))
        missing = [i for i, raw in enumerate(got) if raw is None]
        new = [i for i in missing if cores[i].isalpha() and cores[i] not in self.words.older]
        shown = charmap_decode((" " + "\0 ".join([cores[i] for i in new])).encode(), "strict", self.letters)[0].split(self.letters[0])
        for i, s in zip(new, shown, strict=False):
            got[i] = raw = array("I", map(ID, self.tokenize(s))).tobytes()
            self.words.keep(cores[i], raw)
        for i in missing:
            if got[i] is None:
                got[i] = self.words[cores[i]]
        return got

    def odd(self, unit: str) -> bytes:
        """Ids of a unit that isn't a word with punctuation or none."""
        return self.whole(unit[1:] if unit[:1] == FIRST else unit if unit[:1] == "\n" else " " + unit)

    def tail(self, tail: str) -> bytes:
        """Ids of the punctuation after a word: a piece of its own."""
        if tail not in self.tails:
            if len(self.tails) > 10_000:
                self.tails = {}
            self.tails[tail] = self.whole(tail)
        return self.tails[tail]

    def unit(self, unit: str) -> bytes:
        """A unit begins with FIRST at the start of a text, with a newline, or else with a blank that isn't shown."""
        core = unit.rstrip(PUNCTUATION)
        raw = self.words[core]
        return self.odds[unit] if raw is None else raw + self.tail(unit[len(core) :]) if len(core) < len(unit) else raw

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if not self.plain(text):
            return self.whole(text)
        units = text.replace("\n", " \n").split(" ")
        units[0] = FIRST + units[0]
        return b"".join(map(self.unit, units))

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """encode() of each. Texts that may be cut go through together, SLICE characters at a time: Arrow finds the slice's different units, only these are looked up, and their ids are put back into place."""
        out, held, size = [b""] * len(texts), [], 0
        for i, t in enumerate(texts):
            if len(t) > SLICE or not self.plain(t):
                out[i] = self.encode(t)
            elif t:
                if size + len(t) > SLICE:
                    self.cut(texts, held, out)
                    held, size = [], 0
                held.append(i)
                size += len(t)
        if held:
            self.cut(texts, held, out)
        return out

    def cut(self, texts: list[str], rows: list[int], out: list[bytes]) -> None:
        units = pa.compute.split_pattern(pa.array([FIRST + texts[i].replace("\n", " \n") for i in rows], pa.string()), " ")
        named = units.flatten().dictionary_encode()
        cores = pa.compute.utf8_rtrim(named.dictionary, PUNCTUATION).dictionary_encode()
        of_core = self.known(cores.dictionary.to_numpy(zero_copy_only=False).tolist())
        raw = list(map(of_core.__getitem__, cores.indices.to_numpy().tolist()))
        size = pa.compute.binary_length(cores.dictionary).take(cores.indices)
        rest = np.flatnonzero(pa.compute.not_equal(size, pa.compute.binary_length(named.dictionary)).to_numpy(zero_copy_only=False) | np.array([r is None for r in raw], bool))
        for i, unit in zip(rest.tolist(), named.dictionary.take(pa.array(rest)).to_numpy(zero_copy_only=False), strict=True):
            raw[i] = self.odds[unit] if raw[i] is None else raw[i] + self.tail(unit[len(unit.rstrip(PUNCTUATION)) :])
        ids = pa.array(raw, pa.binary()).take(named.indices)
        data, at = memoryview(ids.buffers()[2] or b""), np.frombuffer(ids.buffers()[1], np.int32)[units.offsets.to_numpy()].tolist()
        for i, lo, hi in zip(rows, at, at[1:], strict=False):
            out[i] = bytes(data[lo:hi])


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each Python worker, kept between tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


END_BYTES = np.array([END], "<u4").tobytes()


def together(b: pa.RecordBatch) -> int:
    """Rows of a batch to encode at once: about SLICE bytes of text, 1,024 rows at most."""
    return max(1, min(1024, SLICE * b.num_rows // max(1, b.nbytes)))


def encoded(part: pa.RecordBatch, path: str) -> list[bytes]:
    """Ids of each row's text with the end id; a null text has the end id only."""
    return [e + END_BYTES for e in encoder(path).encode_batch([t or "" for t in part.column("text").to_pylist()])]


# --- Huffman ---------------------------------------------------------------------------------------

#: Tokens between two bit-offset checkpoints; tokens in a block, about (whole documents).
STEP, BLOCK = 128, 1 << 18


def code_lengths(counts: np.ndarray, longest: int) -> np.ndarray:
    """Huffman code lengths of the symbols with counts > 0, none over longest (their Kraft sum stays at most 1)."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        out[used] = 1
        return out
    heap = [(int(counts[s]), i) for i, s in enumerate(used)]
    heapq.heapify(heap)
    parent = np.zeros(2 * len(used) - 1, np.int64)
    for new in range(len(used), 2 * len(used) - 1):
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        parent[a[1]] = parent[b[1]] = new
        heapq.heappush(heap, (a[0] + b[0], new))
    depth = np.zeros(2 * len(used) - 1, np.int64)
    for i in range(2 * len(used) - 3, -1, -1):
        depth[i] = depth[parent[i]] + 1
    d = np.minimum(depth[: len(used)], longest)
    # cut codes overfill the code space: lengthen the rarest codes that still can be, then shorten where there is room
    room = (1 << longest) - int((1 << (longest - d)).sum())
    for i in np.argsort(counts[used], kind="stable"):
        while room < 0 and d[i] < longest:
            d[i] += 1
            room += 1 << (longest - int(d[i]))
    for i in np.argsort(-counts[used], kind="stable"):
        while d[i] > 1 and room >= 1 << (longest - int(d[i])):
            room -= 1 << (longest - int(d[i]))
            d[i] -= 1
    out[used] = d
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes by length, then symbol."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    codes, code, last = np.zeros(len(lengths), np.uint64), 0, 0
    for s in order.tolist():
        n = int(lengths[s])
        code <<= n - last
        codes[s], last = code, n
        code += 1
    return codes


class Codec:
    def __init__(self, lengths: np.ndarray):
        self.lengths, self.codes = lengths.astype(np.int64), canonical(lengths)
        self.longest = int(lengths.max(initial=1))
        self._table: np.ndarray | None = None

    @property
    def table(self) -> np.ndarray:
        """Symbol and length (low five bits) by the next longest bits."""
        if self._table is None:
            table = np.ones(1 << self.longest, np.uint32)
            used = np.flatnonzero(self.lengths)
            order = used[np.lexsort((used, self.lengths[used]))]
            fill = 1 << (self.longest - self.lengths[order])
            table[: int(fill.sum())] = np.repeat(order << 5 | self.lengths[order], fill)
            self._table = table
        return self._table

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Bits (highest first) and the bit offset of every STEP-th token."""
        n = self.lengths[ids]
        if len(ids) and not n.all():
            raise ValueError("an id has no code")
        end = np.cumsum(n)
        start = end - n
        total = int(end[-1]) if len(end) else 0
        # a code lies in one 64-bit word or two
        word, off = start >> 6, start & 63
        code, left = self.codes[ids], 64 - off - n
        high = np.where(left >= 0, code << np.maximum(left, 0).astype(np.uint64), code >> np.maximum(-left, 0).astype(np.uint64))
        out = np.zeros((total >> 6) + 2, np.uint64)
        if len(ids):
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            out[word[first]] = np.bitwise_or.reduceat(high, first)
            over = np.flatnonzero(left < 0)  # at most one code spills into each word
            out[word[over] + 1] |= code[over] << (64 + left[over]).astype(np.uint64)
        return out.astype(">u8").tobytes()[: (total + 7) // 8], start[::STEP].astype(np.uint32 if total < 1 << 32 else np.uint64)

    def decode(self, data: bytes, checkpoints: np.ndarray, n: int) -> np.ndarray:
        """All stretches between checkpoints (32 or 64 bits wide) at once, a token of each at a step."""
        table = self.table
        raw = np.frombuffer(data + bytes(8), np.uint8).astype(np.uint32)
        # 32 bits from every byte on: a window of up to 25 bits at any bit
        wide = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
        pos, out = checkpoints.copy(), np.zeros((STEP, len(checkpoints)), np.int32)
        shift, mask = np.uint32(32 - self.longest), np.uint32((1 << self.longest) - 1)
        for j in range(min(STEP, n)):
            got = table.take((wide.take(pos >> 3, mode="clip") >> (shift - (pos & 7))) & mask)
            out[j] = got >> 5
            pos += got & 31
        return out.T.ravel()[:n]


def checkpoints_of(raw: bytes, n: int) -> np.ndarray:
    """Of a block of n tokens: 64 bits each where a block has more than 2^32 of them."""
    return np.frombuffer(raw, np.uint32 if len(raw) == 4 * -(-n // STEP) else np.uint64)


def token_counts(placed_: DataFrame) -> DataFrame:
    """(id, n) from the rows of COUNTS that placed() adds: one from each task, already added up."""
    schema = pa.schema([("id", pa.int32()), ("n", pa.int64())])

    def run(batches):
        for b in batches:
            for raw in b.column("ids").to_pylist():
                k = len(raw) // 12
                yield batch(schema, np.frombuffer(raw, "<u4", k).astype(np.int32), np.frombuffer(raw, "<i8", k, 4 * k))

    return map_arrow(placed_.filter(F.col("bucket") == COUNTS).select("ids"), run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))


def fit_codec(counts: DataFrame) -> Codec:
    """Counts by id come to the driver: as many rows as the vocabulary has ids."""
    got = counts.orderBy("id").toArrow()
    ids, n = got["id"].to_numpy(), got["n"].to_numpy()
    all_counts = np.zeros(int(ids.max(initial=0)) + 1, np.int64)
    all_counts[ids] = n
    need = max(1, int(np.ceil(np.log2(max(2, len(ids))))))
    return Codec(code_lengths(all_counts, min(25, max(12, need + 2))))


# --- files --------------------------------------------------------------------------------------------

#: Documents that a range of ids holds, about, and ranges at most.
RANGE, RANGES = 4000, 16_384

FILE = "bucket int, first long, n_tokens long, doc_ids array<long>, doc_tokens array<int>, checkpoints binary, payload binary"


def ranges(docs: DataFrame) -> np.ndarray:
    """Bounds (id, text key) of ranges at quantiles over all ids, null as the least; rows up to a bound belong to its range.

    An id that is several of the quantiles holds as many ranges' rows and is divided
    evenly by the key of the text, which is a hash.
    """
    n = docs.count()
    parts = min(RANGES, max(1, n // RANGE))
    key = F.coalesce("doc_id", F.lit(NONE))
    cuts = docs.agg(F.percentile_approx(key, [i / parts for i in range(1, parts)] or [1.0], max(10_000, parts * 20))).first()[0] if parts > 1 else []
    out = []
    for k, times in sorted(Counter(cuts or []).items()):
        out += [(k, NONE + j * (2**64 // times)) for j in range(1, times)] + [(k, 2**63 - 1)]
    return np.array(out, np.int64).reshape(-1, 2)


#: Stands for a null id, in the order of ids.
NONE = -(2**63)


def bucket_of(bounds: np.ndarray, ids: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """How many bounds lie below each (id, key)."""
    at = np.searchsorted(bounds[:, 0], ids, side="left")
    several = bounds[:-1][bounds[1:, 0] == bounds[:-1, 0], 0]
    for k in np.unique(several[np.isin(several, ids)]):  # divided ids
        rows, own = ids == k, bounds[bounds[:, 0] == k, 1]
        at[rows] += np.searchsorted(own, keys[rows], side="left")
    return at.astype(np.int32)


def tokenized(docs: DataFrame, path: str, bounds: np.ndarray, kind: str) -> DataFrame:
    """(bucket, doc_id, _key, ids) with the end id; null ids go before all others."""
    schema = pa.schema([("bucket", pa.int32()), ("doc_id", pa.int64()), ("_key", pa.int64()), ("ids", pa.binary())])

    def run(batches):
        for b in batches:
            for part in pieces(b, together(b)):
                d, key = part.column("doc_id"), part.column("_key")
                at = bucket_of(bounds, d.fill_null(NONE).to_numpy(), key.to_numpy())
                raw = encoded(part, path)
                yield batch(schema, at, d, key, raw if kind == "<u4" else [np.frombuffer(r, "<u4").astype(kind).tobytes() for r in raw])

    return map_arrow(docs.select("doc_id", text_key().alias("_key"), "text"), run, "bucket int, doc_id long, _key long, ids binary")


#: Bucket of the rows that hold a task's counts of ids instead of a document.
COUNTS = -1


def placed(ids: DataFrame, kind: str) -> DataFrame:
    """Rows by bucket and doc_id, each with its tokens (n) and those of its bucket before it (at): the one shuffle of ids.

    A last row of each task, in the bucket COUNTS, has the ids it met and how often, so
    that counting needs no pass of its own. A running count and these are all that a
    task holds.
    """
    width = int(kind[2])
    schema = pa.schema([("bucket", pa.int32()), ("at", pa.int64()), ("n", pa.int64()), ("doc_id", pa.int64()), ("ids", pa.binary())])

    def run(batches):
        now, at, total = None, 0, np.zeros(1 << 16, np.int64)
        for b in batches:
            for part in pieces(b):
                c = np.bincount(np.frombuffer(b"".join(part.column("ids").to_pylist()), kind))
                if len(c) > len(total):
                    total = np.pad(total, (0, len(c) - len(total)))
                total[: len(c)] += c
            k, n = b.column("bucket").to_numpy(), pa.compute.binary_length(b.column("ids")).to_numpy() // width
            out = np.zeros(len(k), np.int64)
            for i, (bucket, size) in enumerate(zip(k.tolist(), n.tolist(), strict=True)):
                if bucket != now:
                    now, at = bucket, 0
                out[i] = at
                at += size
            yield batch(schema, b.column("bucket"), out, n, b.column("doc_id"), b.column("ids"))
        used = np.flatnonzero(total)
        if len(used):
            yield batch(schema, [COUNTS], [0], [0], [None], [used.astype("<u4").tobytes() + total[used].astype("<i8").tobytes()])

    ordered = ids.repartition("bucket").sortWithinPartitions("bucket", F.col("doc_id").asc_nulls_first(), "_key", "ids").drop("_key")
    return map_arrow(ordered, run, "bucket int, at long, n long, doc_id long, ids binary")


def write_ids(docs: DataFrame, out: str, vocabulary: str | None = None) -> None:
    """Encodes docs into the file format at out: <out>/codec (id, length) and <out>/blocks.

    A block holds whole documents of about BLOCK tokens: their ids and token counts,
    the Huffman payload and the bit offset of every STEP-th token. Blocks decode by
    themselves; first is the place of a block's first token in the whole sequence by
    ascending doc_id. Null doc_ids come first, rows of one id in order of their text's key.
    Spark's commit of the table makes the files appear at once.
    """
    spark, path = docs.sparkSession, vocabulary or default_vocabulary()
    kind = "<u2" if encoder(path).tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
    width = int(kind[2])
    bounds = ranges(docs.select("doc_id"))
    saved = save(placed(tokenized(docs, path, bounds, kind), kind), "ids")
    codec = fit_codec(token_counts(saved))
    ids = saved.filter(F.col("bucket") != COUNTS)
    used = np.flatnonzero(codec.lengths)
    spark.createDataFrame(list(zip(used.tolist(), codec.lengths[used].tolist(), strict=True)), "id int, length int").coalesce(1).write.parquet(f"{out}/codec")
    totals = dict(ids.groupBy("bucket").agg(F.sum("n")).collect())  # a row for each range, RANGES at most
    base, at = {}, 0
    for k in sorted(totals):
        base[k], at = at, at + totals[k]
    shared = spark.sparkContext.broadcast((codec.lengths.astype(np.uint8), base))
    schema = pa.schema([("bucket", pa.int32()), ("first", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int32())), ("checkpoints", pa.binary()), ("payload", pa.binary())])

    def run(batches):
        lengths, start = shared.value
        c = Codec(lengths)
        bucket, first, held = None, 0, 0
        names, raws = [], []

        def flush():
            data, check = c.encode(np.frombuffer(b"".join(raws), kind).astype(np.int64))
            return batch(schema, [bucket], [first], [held], [names], [[len(r) // width for r in raws]], [check.tobytes()], [data])

        for b in batches:
            for k, place, d, raw in zip(*(b.column(n).to_pylist() for n in ("bucket", "at", "doc_id", "ids")), strict=True):
                # the reader may cut the saved table anywhere, so a block also ends where a row doesn't follow
                if names and (k != bucket or held >= BLOCK or start[k] + place != first + held):
                    yield flush()
                    names, raws, held = [], [], 0
                if not names:
                    bucket, first = k, start[k] + place
                names.append(d)
                raws.append(raw)
                held += len(raw) // width
        if names:
            yield flush()

    map_arrow(ids.drop("n"), run, FILE).write.option("compression", "none").parquet(f"{out}/blocks")
    drop_saved(saved)


def read_codec(spark: SparkSession, path: str) -> Codec:
    got = spark.read.parquet(f"{path}/codec").toArrow()
    ids = got["id"].to_numpy()
    lengths = np.zeros(int(ids.max(initial=0)) + 1, np.uint8)
    lengths[ids] = got["length"].to_numpy()
    return Codec(lengths)


def decoded(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32[, ids] of every document, from the files."""
    shared = spark.sparkContext.broadcast(read_codec(spark, path).lengths.astype(np.uint8))
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + ([("ids", pa.list_(pa.int32()))] if with_ids else [])
    schema = pa.schema(fields)

    def run(batches):
        c = Codec(shared.value)
        for b in batches:
            for i in range(b.num_rows):
                r = {n: b.column(n)[i] for n in ("first", "n_tokens", "doc_ids", "doc_tokens", "checkpoints", "payload")}
                ids = c.decode(r["payload"].as_py(), checkpoints_of(r["checkpoints"].as_py(), r["n_tokens"].as_py()), r["n_tokens"].as_py()).astype("<u4")
                sizes = np.array(r["doc_tokens"].as_py(), np.int64)
                ends = np.cumsum(sizes)
                raw = memoryview(ids.tobytes())
                crc = [zlib.crc32(raw[4 * (e - s) : 4 * e]) for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]
                extra = [[ids[e - s : e].astype(np.int32) for s, e in zip(sizes, ends, strict=True)]] if with_ids else []
                yield batch(schema, r["doc_ids"].as_py(), r["first"].as_py() + ends - sizes, sizes, crc, *extra)

    names = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    return map_arrow(spark.read.parquet(f"{path}/blocks").select("first", "n_tokens", "doc_ids", "doc_tokens", "checkpoints", "payload"), run, names)


def read_from(spark: SparkSession, path: str, block_first: int, skip: int, n: int) -> np.ndarray:
    """n tokens from the skip-th of the block that begins at block_first: only the stretches from the checkpoint before it are decoded."""
    row = spark.read.parquet(f"{path}/blocks").filter(F.col("first") == block_first).select("n_tokens", "checkpoints", "payload").first()
    check, lo = checkpoints_of(bytes(row["checkpoints"]), row["n_tokens"]), skip // STEP
    hi = min(len(check), (skip + n + STEP - 1) // STEP)
    got = read_codec(spark, path).decode(bytes(row["payload"]), check[lo:hi], min(row["n_tokens"] - lo * STEP, (hi - lo) * STEP))
    return got[skip - lo * STEP :][:n]
