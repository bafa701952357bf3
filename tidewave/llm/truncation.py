"""Texts that lost their end, told from complete ones by a backward character n-gram model of how texts end."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewave.session import broadcast_if_small, checkpointed, spread

#: Lengths of the final contexts in characters and in shapes, and weight of the shorter context.
ORDERS, SHAPES, BACKOFF = (2, 4, 7, 11, 16), (1, 2, 4, 6, 9), 3.0
TABLES = len(ORDERS) + len(SHAPES)
#: Log odds beyond which one of the two models is not believed: its counts are those of contexts that overlap.
SURE = 10.0
#: Share of a shorter context's places from which a longer one stands at the same places.
SAME = 0.9
#: Characters gathered at once, positions hashed at once (few enough for a core's cache), contexts that wait to be counted together,
#: and counted ones that a task holds before it gives them out.
GATHER, WINDOW, SEEN, HELD = 1 << 20, 1 << 16, 1 << 22, 1 << 22
#: Bits of the filter of wanted contexts: at least, for each context, and at most. It only spares the shuffle what is surely
#: not wanted, so at the most it lets more pass, and counts stay exact.
FILTER_LEAST, FILTER_EACH, FILTER_MOST = 1 << 20, 16, 1 << 30
#: Bits that the filter is built by at a time.
FILTER_BLOCK = 1 << 20
#: A length is a pile if this log likelihood ratio speaks for it against the lengths within PILE_NEAR of it, and a limit if at most
#: this share of the source's texts is longer without an ending of its own kind.
PILE_EVIDENCE, PILE_NEAR, BEYOND_SHARE = 10.0, 256, 0.005
#: Longest mark, in characters, that can stand in place of the rest, and the share of a pile's texts that must end in it.
MARK_MOST, MARK_SHARE = 40, 0.8
#: Fixed value: the character that decoders put for bytes that are none, such as a character cut in two.
REPLACEMENT = "\ufffd"

_BOUNDARY = re.compile(r'boundary="?([^"\s;]+)')
_HEADER = re.compile(r"[A-Za-z][A-Za-z0-9-]*: ")
_CODED = re.compile(r"[A-Za-z0-9+/]+={0,2}")
_QUOTED, _QUOTED_END = re.compile(r"=[0-9A-F]{2}|=\r?\n"), re.compile(r"=[0-9A-F]?$")
#: Letters from which a line can be one of an encoded body.
LINE = 60


def _canonical() -> np.ndarray:
    """Character -> symbol: lower case, one symbol for all digits."""
    to = np.arange(0x110000, dtype=np.uint32)
    for c in range(0x600):
        low = chr(c).lower()
        to[c] = ord("0") if chr(c).isdigit() else ord(low) if len(low) == 1 else c
    return to


CANONICAL = _canonical()
UPPER, LOWER, DIGIT = 1, 2, 3


def _kinds() -> np.ndarray:
    """Character -> kind: capital, other letter, digit, or 0."""
    to = np.zeros(0x110000, dtype=np.uint32)
    for c in range(0x3400):
        x = chr(c)
        to[c] = DIGIT if x.isdigit() else UPPER if x.isupper() else LOWER if x.isalpha() else 0
    to[0x3400:0xA000] = to[0xAC00:0xD7B0] = to[0x20000:0x30000] = LOWER
    return to


KINDS = _kinds()
_STEPS = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(max(ORDERS))], np.uint64)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def characters(text: str) -> np.ndarray:
    return np.frombuffer(text.replace("\r\n", "\n").encode("utf-32-le", "surrogatepass"), np.uint32)


#: Characters read for the final contexts at first; further back only where they hold too few symbols.
TAIL = 320


def final_contexts(texts: list[str]) -> np.ndarray:
    """A row for each text: hashes of the contexts at its end, those of characters first. Texts aren't empty.

    However long its runs of letters or digits are, a text is read as far back as its contexts reach.
    """
    gap = np.zeros(max(ORDERS), np.uint32)
    size = TAIL
    tails = [characters(t[-size:]) for t in texts]
    short = np.array([i for i, t in enumerate(texts) if len(t) > size], np.int64)
    while True:
        raw = np.concatenate([x for t in tails for x in (gap, t)])
        ends = np.cumsum([len(gap) + len(t) for t in tails]) - 1
        seq, at = shapes(raw)
        last = np.searchsorted(at, ends, "right") - 1
        held = last - np.searchsorted(at, ends + 1 - [len(t) for t in tails])
        short = short[(held[short] <= max(SHAPES)) | np.array([len(tails[i]) < max(ORDERS) for i in short], bool)]
        if not len(short):
            break
        size *= 8
        for i in short:
            tails[i] = characters(texts[i][-size:])
        short = np.array([i for i in short if len(texts[i]) > size], np.int64)
    out = np.empty((len(texts), TABLES), np.int64)
    for o, h in contexts(CANONICAL[raw]):
        out[:, o] = h[ends]
    for o, h in contexts(seq, SHAPES, len(ORDERS)):
        out[:, o] = h[last]
    return out


def shapes(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shape symbols, first positions): each run of letters or digits is one symbol, a word told by its first letter."""
    kind = KINDS[codes]
    start = np.ones(len(codes), bool)
    start[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 0)
    start[1:] &= ~((kind[1:] == LOWER) & (kind[:-1] == UPPER))  # a capital goes on as a word
    at = np.flatnonzero(start)
    return np.where(kind[at] > 0, kind[at], codes[at]), at


def contexts(codes: np.ndarray, orders: tuple[int, ...] = ORDERS, first: int = 0) -> Iterator[tuple[int, np.ndarray]]:
    """(number of the order, from `first`, 64-bit hashes) of the contexts that end at each position, read backward.

    Contexts of different orders have different hashes.
    """
    c = codes.astype(np.uint64) + np.uint64(1)
    h = np.zeros(len(c), np.uint64)
    for k in range(max(orders)):
        h[k:] += c[: len(c) - k] * _STEPS[k]
        if k + 1 in orders:
            o = first + orders.index(k + 1)
            x = (h + np.uint64((o + 1) * 0xA24BAED4963EE407 % (1 << 64))) * _MIX
            yield o, ((x ^ (x >> np.uint64(32))) * _MIX).view(np.int64)


def state(text: str) -> str:
    """What the structure says of the end: open or closed parts, open markup, an encoded tail out of step, a header."""
    out = []
    if "boundary=" in text:
        out.append("parts-open" if any(f"--{b}--" not in text for b in _BOUNDARY.findall(text)) else "parts-closed")
    if "<html" in text:
        out.append("html-open" if "</html>" not in text else "html-closed")
    end = len(text.rstrip("\n\r"))
    begin = text.rfind("\n", 0, end) + 1
    last = text[begin:end]
    before = text[text.rfind("\n", 0, max(0, begin - 1)) + 1 : max(0, begin - 1)].rstrip("\r")
    coded = _CODED.fullmatch(last) and (len(last) >= LINE or len(before) >= LINE and _CODED.fullmatch(before))
    if coded:
        out.append("coded-odd" if len(last) % 4 else "coded-even")
    elif _QUOTED_END.search(text, max(0, len(text) - 2)) and _QUOTED.search(text):
        out.append("quoted-cut")
    if "\n\n" not in text and "\n\r\n" not in text and _HEADER.match(text):
        out.append("header")
    return "+".join(out) or "plain"


PROFILE = "key bigint, source string, lang string, at_limit string, chars int, bytes int, state string, cut_state string, ctx array<bigint>"


def profile(docs: DataFrame) -> DataFrame:
    """One narrow row for each text (key, text, source, lang, at_limit, stripped): lengths, structure and hashes of its final contexts.

    What is read is the text without its last `stripped` characters, the mark in place of the rest. cut_state is the structure
    that the same text would show when cut at one place fixed by its key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column(0)
            texts = [t[: len(t) - m] or t for t, m in zip(b.column(1).to_pylist(), b.column(5).to_pylist())]
            rows = []
            for k, t in zip(keys.to_pylist(), texts):
                cut = 1 + zlib.crc32(str(k).encode()) % max(1, len(t) - 1)
                rows.append((len(t), len(t.encode("utf-8", "surrogatepass")), state(t), state(t[:cut])))
            c = list(zip(*rows)) if rows else [[]] * 4
            ctx = [final_contexts(texts[i : i + 2000]) for i in range(0, len(texts), 2000)]
            ctx = np.concatenate(ctx) if ctx else np.zeros((0, TABLES), np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ctx) + 1, dtype=np.int32) * TABLES), pa.array(ctx.ravel()))
            kinds = [pa.int32(), pa.int32(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([keys, b.column(2), b.column(3), b.column(4), *(pa.array(x, t) for x, t in zip(c, kinds)), lists], ["key", "source", "lang", "at_limit", "chars", "bytes", "state", "cut_state", "ctx"])

    return docs.select("key", "text", "source", "lang", "at_limit", "stripped").mapInArrow(run, PROFILE)


def filter_bits(ctx: np.ndarray, bits: int, which: int) -> np.ndarray:
    """The first or second place (0, 1) of each context in a filter of `bits` bits, a power of two."""
    x = ctx.view(np.uint64)
    return (x & np.uint64(bits - 1) if which else x >> np.uint64(65 - bits.bit_length())).view(np.int64)


def wanted(ends: DataFrame, bits: int) -> np.ndarray:
    """Bitmap of `bits` bits with the two places of every ctx of `ends`; built in blocks by the tasks."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.concatenate([filter_bits(b.column(0).to_numpy(), bits, k) for k in (0, 1)])
            yield pa.RecordBatch.from_arrays([pa.array((at // FILTER_BLOCK).astype(np.int32)), pa.array((at % FILTER_BLOCK).astype(np.int32))], ["block", "at"])

    def packed(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(FILTER_BLOCK, bool)
        for b in batches:
            held[b.column("at").to_numpy()] = True
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([np.packbits(held, bitorder="little").tobytes()])], ["block", "held"])

    out = np.zeros(bits // 8, np.uint8)
    blocks = ends.select("ctx").mapInArrow(places, "block int, at int").groupBy("block").applyInArrow(packed, "block int, held binary")
    for r in blocks.toLocalIterator():
        a = r["block"] * FILTER_BLOCK // 8
        out[a : a + FILTER_BLOCK // 8] = np.frombuffer(r["held"], np.uint8)
    return out


def totals(ctx: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct ctx, sum of n)."""
    by = np.argsort(ctx)
    ctx, n = ctx[by], n[by]
    at = np.flatnonzero(np.r_[True, ctx[1:] != ctx[:-1]]) if len(ctx) else np.zeros(0, np.int64)
    return ctx[at], np.add.reduceat(n, at) if len(at) else n


def continued(docs: DataFrame, ends: DataFrame) -> DataFrame:
    """(ctx, n): how often each ctx of `ends` (distinct) stands inside a text, followed by more; every position of every text counts.

    A filter sized from the counted ends keeps what surely isn't wanted from the shuffle; what passes is summed in the tasks,
    which hold a fixed number of contexts, and joined by its whole hash. Contexts that stand nowhere have 0.
    """
    bits = max(FILTER_LEAST, min(FILTER_MOST, 1 << (FILTER_EACH * ends.count()).bit_length()))
    shared = docs.sparkSession.sparkContext.broadcast(wanted(ends, bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_bits = shared.value
        most = max(ORDERS)
        gap = np.zeros(most, np.uint32)
        seen: list[tuple[np.ndarray, np.ndarray]] = []
        counted: list[tuple[np.ndarray, np.ndarray]] = []

        def passing(h: np.ndarray, n: np.ndarray | None = None) -> None:
            for k in (0, 1):
                at = filter_bits(h, bits, k)
                ok = (held_bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
                h, n = h[ok], None if n is None else n[ok]
            if n is None:
                h, n = np.unique(h, return_counts=True)
            else:
                h, n = totals(h, n.astype(np.int64))
            seen.append((h, n))

        def merge(most_seen: int, most_counted: int) -> Iterator[pa.RecordBatch]:
            if sum(len(h) for h, _ in seen) > most_seen:
                both = [*counted, *seen]
                counted[:] = [totals(np.concatenate([h for h, _ in both]), np.concatenate([n for _, n in both]))]
                seen.clear()
            if sum(len(h) for h, _ in counted) > most_counted:
                for h, n in counted:
                    for i in range(0, len(h), 50_000):
                        yield pa.RecordBatch.from_arrays([pa.array(h[i : i + 50_000]), pa.array(n[i : i + 50_000])], ["ctx", "n"])
                counted.clear()

        def add(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            raw = np.concatenate([x for p in parts for x in (gap, p)])
            inner = np.ones(len(raw), bool)
            ends = np.cumsum([most + len(p) for p in parts])
            for p, e in zip(parts, ends):
                inner[e - most - len(p) : e - len(p)] = False
            inner[ends - 1] = False
            for a in range(0, len(raw), WINDOW):
                lo = max(0, a - most)
                ok = inner[a : a + WINDOW]
                for _, h in contexts(CANONICAL[raw[lo : a + WINDOW]]):
                    passing(h[a - lo :][ok])
                lo, back = max(0, a - 256), 256
                while lo and len(shapes(raw[lo:a])[1]) <= max(SHAPES):
                    back *= 4
                    lo = max(0, a - back)
                seq, at = shapes(raw[lo : a + WINDOW])
                size = np.add.reduceat(inner[lo : a + WINDOW] & (np.arange(lo, lo + len(raw[lo : a + WINDOW])) >= a), at, dtype=np.int64)
                ok = size > 0
                for _, h in contexts(seq, SHAPES, len(ORDERS)):
                    passing(h[ok], size[ok])
            yield from merge(SEEN, HELD)

        parts: list[np.ndarray] = []
        size = 0
        for b in batches:
            for t in b.column(0):
                p = characters(t.as_py())
                parts.append(p)
                size += len(p)
                if size >= GATHER:
                    yield from add(parts)
                    parts, size = [], 0
        if parts:
            yield from add(parts)
        yield from merge(0, 0)

    inner = docs.select("text").mapInArrow(run, "ctx bigint, n bigint").groupBy("ctx").agg(F.sum("n").alias("n"))
    return ends.select("ctx").join(inner, "ctx", "left").select("ctx", F.coalesce("n", F.lit(0)).alias("n"))


def text_ends(texts: DataFrame) -> DataFrame:
    """(source, hash, chars, bytes, tail) of each different text of a source: all that limits and marks are learned from."""
    return texts.select("source", F.xxhash64("text").alias("hash"), F.length("text").cast("long").alias("chars"), F.octet_length("text").cast("long").alias("bytes"), F.right("text", F.lit(MARK_MOST)).alias("tail")).distinct()


UNITS = ("chars", "bytes")


def piles(ends: DataFrame) -> DataFrame:
    """(source, unit, pile, n): lengths that far more of a source's different texts have than lengths near them.

    Judged by the likelihood ratio of the count against the one that the neighbouring lengths let expect, so that the same
    rule holds for few texts and for many.
    """
    each = ends.select("source", F.explode(F.array(*[F.struct(F.lit(u).alias("unit"), F.col(u).alias("length")) for u in UNITS])).alias("l"))
    counts = each.groupBy("source", "l.unit", "l.length").agg(F.count("*").alias("n"))
    near = Window.partitionBy("source", "unit").orderBy("length").rangeBetween(-PILE_NEAR, PILE_NEAR)
    expected = (F.sum("n").over(near) - F.col("n") + 1) / (2 * PILE_NEAR)
    n = F.col("n")
    found = counts.withColumn("expected", expected).where((n > F.col("expected")) & (n * F.log(n / F.col("expected")) - (n - F.col("expected")) >= PILE_EVIDENCE))
    return found.select("source", "unit", F.col("length").alias("pile"), "n")


def marks(ends: DataFrame, heaps: DataFrame, rows: int) -> DataFrame:
    """(source, unit, pile, mark): of each pile the longest ending that nearly all of its different texts share, or ''.

    The ending is learned: systems that cut at a length and then say so leave texts that all end alike. `rows`: number of piles.
    """
    side = broadcast_if_small(heaps.withColumnsRenamed({"source": "__s"}), rows)
    own = F.when(F.col("unit") == "chars", F.col("chars")).otherwise(F.col("bytes"))
    ends = ends.join(side, (F.col("source") == F.col("__s")) & (own == F.col("pile"))).select("source", "unit", "pile", "tail")
    each = ends.select("source", "unit", "pile", F.explode(F.sequence(F.lit(1), F.length("tail"))).alias("k"), "tail")
    suffix = each.groupBy("source", "unit", "pile", F.expr("right(tail, k)").alias("mark")).agg(F.count("*").alias("shared"))
    long = suffix.join(heaps, ["source", "unit", "pile"]).where(F.col("shared") >= MARK_SHARE * F.col("n"))
    best = long.groupBy("source", "unit", "pile").agg(F.max_by("mark", F.length("mark")).alias("mark"))
    return heaps.select("source", "unit", "pile").join(best, ["source", "unit", "pile"], "left").select("source", "unit", "pile", F.coalesce("mark", F.lit("")).alias("mark"))


def limits(ends: DataFrame) -> DataFrame:
    """(source, unit, pile, mark, length): where a source cuts, in characters or bytes, and what it puts in place of the rest.

    length is the pile's own without its mark. Such a length is a limit if hardly any of the source's texts is longer, but for those
    of piles that end in a mark of the same limit. Of several limits of a source and unit the greatest counts.
    """
    heaps = checkpointed(piles(ends))
    many = heaps.count()
    learned = marks(ends, heaps, many)
    size = F.when(F.col("unit") == "chars", F.length("mark")).otherwise(F.octet_length("mark"))
    learned = checkpointed(learned.withColumn("length", F.col("pile") - size))
    side = learned.withColumnsRenamed({"source": "__s", "pile": "__pile", "mark": "__mark"})
    own = F.when(F.col("unit") == "chars", F.col("chars")).otherwise(F.col("bytes"))
    beyond = ends.join(broadcast_if_small(side, many), (F.col("source") == F.col("__s")) & (own > F.col("length")))
    explained = (own == F.col("__pile")) & (F.col("__mark") != "") & F.col("tail").endswith(F.col("__mark"))
    # a text longer than a limit meets each of the limit's piles, and is explained by one of them at most
    longer = beyond.groupBy("source", "unit", "length").agg((F.count("*") / F.count_distinct("__pile") - F.count_if(explained)).alias("longer"))
    all_texts = ends.groupBy("source").agg(F.count("*").alias("all"))
    cuts = learned.join(longer, ["source", "unit", "length"], "left").join(all_texts, "source").where(F.coalesce("longer", F.lit(0)) <= BEYOND_SHARE * F.col("all"))
    top = cuts.groupBy("source", "unit").agg(F.max("length").alias("length"))
    return cuts.join(top, ["source", "unit", "length"], "left_semi").select("source", "unit", "pile", "mark", "length")


def placed(texts: DataFrame) -> DataFrame:
    """`texts` with at_limit ('no', 'yes', or 'marked' where a learned mark stands in place of the rest) and stripped, the mark's characters."""
    known = checkpointed(limits(checkpointed(text_ends(texts))))
    many = known.count()
    rows = texts
    for unit, n in zip(UNITS, (F.length("text"), F.octet_length("text"))):
        own = known.where(F.col("unit") == unit)
        plain = own.groupBy(F.col("source").alias(f"__{unit}_source")).agg(F.max("length").alias(f"__{unit}"))
        ended = own.where("mark <> ''").select(F.col("source").alias(f"__{unit}_of"), F.col("pile").alias(f"__{unit}_pile"), F.col("mark").alias(f"__{unit}_mark"))
        rows = rows.join(broadcast_if_small(plain, many), F.col("source") == F.col(f"__{unit}_source"), "left")
        rows = rows.join(broadcast_if_small(ended, many), (F.col("source") == F.col(f"__{unit}_of")) & (n == F.col(f"__{unit}_pile")) & F.col("text").endswith(F.col(f"__{unit}_mark")), "left")
    mark = F.coalesce("__chars_mark", "__bytes_mark")
    broken = F.when(F.col("text").endswith(REPLACEMENT), 1).otherwise(0)
    whole = F.octet_length("text") - 3 * broken
    near = (F.length("text") == F.col("__chars")) | ((whole <= F.col("__bytes")) & (whole > F.col("__bytes") - 4))
    at = F.when(mark.isNotNull(), "marked").when(F.coalesce(near, F.lit(False)), "yes").otherwise("no")
    return rows.select(*texts.columns, at.alias("at_limit"), F.coalesce(F.length(mark), F.lit(0)).alias("stripped"))


def language(lang: Column) -> Column:
    """Two letters, whichever way the language is spelt; unknown ones are one group."""
    two = F.lower(F.substring(F.trim(lang), 1, 2))
    return F.when(two.rlike("^[a-z]{2}$"), two).otherwise(F.lit("und"))


STEPS, OWN = 40, 30.0
#: Log odds by which being cut off must outweigh being complete.
MARGIN = 1.0


def _priors(pdf: pd.DataFrame) -> pd.DataFrame:
    """Share of cut-off texts of a (source, at its limit) and of each language in it, by expectation maximisation.

    Rows are (language, evidence bin, count). A language's share is drawn to that of the whole by OWN texts.
    """
    lr = np.exp(-pdf["bin"].to_numpy() / 4.0)  # cut off against complete
    n = pdf["n"].to_numpy(float)
    share = 0.05 if pdf["at_limit"].iloc[0] == "no" else 0.5
    for _ in range(STEPS):
        share = float(np.clip((n * (share * lr / (share * lr + 1 - share))).sum() / n.sum(), 1e-4, 1 - 1e-4))
    out = []
    for lang, g in pdf.groupby("lang"):
        m, l = n[pdf["lang"] == lang], lr[pdf["lang"] == lang]
        s = share
        for _ in range(STEPS):
            s = float(((m * (s * l / (s * l + 1 - s))).sum() + OWN * share) / (m.sum() + OWN))
        out.append((pdf["source"].iloc[0], pdf["at_limit"].iloc[0], lang, np.log((1 - s) / s)))
    return pd.DataFrame(out, columns=["source", "at_limit", "lang", "threshold"])


def scored(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, source, lang, at_limit, evidence, threshold, cut_off) of every text that is not null, empty or blank.

    1. Every distinct text's final contexts are counted, then every other place of the corpus where one of them is followed
       by more. P(end | context) backs off from the longest context to the base rate; a text's own end is left out.
    2. evidence = log odds of ending against going on, relative to the base rate, the mean of a model of characters and one of
       shapes (words and numbers as one symbol each), plus the log ratio of the text's structure among texts with
       convincing ends to that among texts cut at a fixed random place. A second round counts only the ends that the
       first found complete.
    3. The threshold on it is the log odds of being complete among texts of that source, off its learned limit, at it, or at it with a
       learned mark in place of the rest, and language, by expectation maximisation, less MARGIN. The contexts of a marked text are
       those before its mark.

    Texts of null source or language form groups of their own. Empty table: no rows.
    """
    texts = spread(docs).select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"), F.coalesce("source", F.lit("")).alias("source"), language(F.col("lang")).alias("lang")).where(F.col(text).rlike(r"\S"))
    prof = checkpointed(profile(placed(texts)))
    # the final contexts of each distinct end, once: repeated texts have equal contexts, lengths and structure
    alike = ["chars", "bytes", "state", "ctx"]
    distinct = prof.dropDuplicates(alike)
    ends = checkpointed(distinct.select(F.explode("ctx").alias("ctx")).groupBy("ctx").agg(F.count("*").alias("e")))
    inside = checkpointed(continued(texts, ends))
    total = distinct.agg(F.count("*").alias("e"), F.sum("chars").alias("n")).first()
    base = min(0.5, ((total["e"] or 0) + 1) / ((total["n"] or 0) + 2))
    first = judged(prof, ends.join(inside, "ctx"), base, F.lit(True))
    kept = first.where("not cut_off").dropDuplicates(alike).select(F.explode("ctx").alias("ctx")).groupBy("ctx").agg(F.count("*").alias("e"))
    counts = inside.join(kept, "ctx", "left").select("ctx", F.coalesce("e", F.lit(0)).alias("e"), "n")
    again = judged(first.select(*prof.columns, F.col("cut_off").alias("was_cut")), counts, base, ~F.col("was_cut"))
    return again.drop("ctx", "was_cut").withColumnRenamed("key", key)


#: Parts that the ends of one context are spread over: one context may end a third of all texts.
SALTS = 16


def judged(prof: DataFrame, counts: DataFrame, base: float, counted: Column) -> DataFrame:
    """`prof` with evidence, threshold and cut_off; `counted`: whether a text's own end is among the counts."""
    each = prof.select("key", F.posexplode("ctx").alias("o", "ctx"), F.pmod(F.xxhash64("key"), F.lit(SALTS)).alias("salt"), counted.cast("double").alias("own"))
    copies = counts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumn("salt", F.col("salt").cast("bigint"))
    seen = F.struct("o", F.greatest(F.col("e") - F.col("own"), F.lit(0.0)).alias("e"), F.col("n").cast("double").alias("n"))
    found = each.join(copies, ["ctx", "salt"]).groupBy("key").agg(F.array_sort(F.collect_list(seen)).alias("seen"))

    def lift(those: Column) -> Column:
        # a longer context that stands at nearly the same places as the shorter one says nothing new
        start = F.struct(F.lit(base).alias("p"), F.lit(float("inf")).alias("of"))
        step = lambda c, s: F.when(s["e"] + s["n"] <= SAME * c["of"], F.struct(((s["e"] + BACKOFF * c["p"]) / (s["e"] + s["n"] + BACKOFF)).alias("p"), (s["e"] + s["n"]).alias("of"))).otherwise(c)
        p = F.aggregate(those, start, step, lambda c: c["p"])
        odds = F.log(p) - F.log1p(-p) - F.lit(float(np.log(base / (1 - base))))
        return F.greatest(F.lit(-SURE), F.least(F.lit(SURE), odds))

    letters, forms = lift(F.filter("seen", lambda s: s["o"] < len(ORDERS))), lift(F.filter("seen", lambda s: s["o"] >= len(ORDERS)))
    rows = checkpointed(prof.join(found.select("key", letters.alias("letters"), forms.alias("forms")), "key"))
    rows = rows.withColumn("ending", (F.col("letters") + F.col("forms")) / 2)
    sure = rows.where("ending > 3 and at_limit = 'no'").groupBy("state").agg(F.count("*").alias("c"))
    cut = rows.groupBy(F.col("cut_state").alias("state")).agg(F.count("*").alias("m"))
    shape = rows.select("state").distinct().join(sure, "state", "left").join(cut, "state", "left").select("state", F.coalesce("c", F.lit(0)).alias("c"), F.coalesce("m", F.lit(0)).alias("m"))
    sums = shape.agg(F.sum("c").alias("c"), F.sum("m").alias("m")).first()
    ratio = F.log((F.col("c") + 0.5) / ((sums["c"] or 0) + 1)) - F.log((F.col("m") + 0.5) / ((sums["m"] or 0) + 1))
    # states are joined from six words, so there are a few dozen at most
    rows = rows.join(F.broadcast(shape.select("state", ratio.alias("structure"))), "state")
    rows = rows.withColumn("evidence", F.col("ending") + F.col("structure"))
    bins = rows.groupBy("source", "at_limit", "lang", F.round(4 * F.greatest(F.lit(-15.0), F.least(F.lit(15.0), F.col("evidence")))).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    priors = bins.groupBy("source", "at_limit").applyInPandas(_priors, "source string, at_limit string, lang string, threshold double")
    priors = checkpointed(priors)  # a row for each source, place at its limit and language
    rows = rows.join(broadcast_if_small(priors, priors.count()), ["source", "at_limit", "lang"])
    return rows.withColumn("cut_off", F.col("evidence") + F.col("threshold") < -MARGIN)


def shares(rows: DataFrame) -> DataFrame:
    """(source, texts, cut_off, share): how often each source cuts texts off."""
    return rows.groupBy("source").agg(F.count("*").alias("texts"), F.count_if("cut_off").alias("cut_off"), F.avg(F.col("cut_off").cast("double")).alias("share"))
