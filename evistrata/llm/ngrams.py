"""Jaccard join of word n-gram sets with adaptive multi-match prefixes.

Two sets that are similar enough share, for every ``l``, at least ``l`` tokens within their
prefixes of length ``n - ceil(t n) + l``, whatever order all sets are sorted by.  Each document
chooses its own ``l``: the prefix grows while the estimated cost of its candidates falls, and a
pair must share as many prefix tokens as the smaller ``l`` of the two before it is verified.

1. Documents with the same words are one class, a node of the graph of links.
2. Tokens are ordered rare first.  Frequency classes come from a table of fixed size, filled
   from the counts of all prefix tokens under hash order; any table gives the same links.
3. Prefix tokens are counted, each class picks its ``l`` and keeps the postings it needs.
4. Short posting lists give all their pairs, and those that share enough tokens are candidates.
   Bucket counts of both sets bound their overlap from above; pairs that pass are verified on
   the whole sets.  Sets are hashes of 64 bits.
5. Long lists, which are left where sets consist of frequent tokens, do not give their pairs.
   Each has a pivot; every member is compared with it and described by its difference from it.
   Two members that both link with the pivot are connected.  Any other two that link either
   differ so little from the pivot together that the closest linked member serves for all of
   them, or share an element of the beginnings of their differences, in one order, those first
   that few members of the pivot have.  Elements of linked members count only where a member that is not linked may have
   them.  Lists of elements are treated as lists of tokens are: short ones give their pairs,
   long ones get a pivot of their own.

Work tables are written to the shared folder; nothing about documents passes the driver.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from evistrata.llm.base import BATCH_ROWS, map_batches, stage, texts, worker_state
from evistrata.llm.components import components

ODD = np.uint64(0x9E3779B97F4A7C15)
ORDER_BITS = 20
#: Bits of the places that elements around a pivot have in tables of fixed size.
PLACE_BITS = 18
#: Size of the bitmaps that Spark's ``bitmap_or_agg`` takes.
BITMAP_BYTES = 4096


@dataclass(frozen=True)
class Settings:
    """Documents link when intersection / union >= ``numerator`` / ``denominator``.

    ``width`` words make a token.  ``longest`` is the largest ``l``; ``verify_cost`` the cost of
    verifying a candidate, in posting entries.  Lists of over ``short`` classes are compared
    through pivots, and those of elements within them that would give more pairs than ``short``
    classes do, to a depth of ``levels``.  Tokens in at
    least ``frequent`` of hash-order prefixes ``ahead`` times as long are ordered late, the
    ``order_entries`` most frequent buckets of them at most.  Only the first three change what links; the rest is cost.
    """

    width: int = 5
    numerator: int = 4
    denominator: int = 5
    longest: int = 4
    verify_cost: int = 8
    short: int = 128
    frequent: int = 16
    order_entries: int = 1 << 17
    ahead: int = 3
    levels: int = 6

    def prefix(self, n: int, l: int) -> int:
        return min(n, n - -(-self.numerator * n // self.denominator) + l)


# --- sets of tokens -----------------------------------------------------------

def words_of(text: str) -> list[bytes]:
    """Lower-cased (A-Z) words between ASCII white space."""
    return text.encode().lower().split()


def class_key(words: list[bytes]) -> bytes | None:
    """128 bits that documents with the same words share."""
    return blake2b(b" ".join(words), digest_size=16).digest() if words else None


def _mix(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(31))) * ODD
    return values ^ (values >> np.uint64(29))


def tokens_of(words: list[bytes], width: int) -> np.ndarray:
    """Sorted distinct token hashes; fewer words than ``width`` are one token."""
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < width:
        return np.array([xxh3_64_intdigest(b" ".join(words), len(words))], np.uint64)
    known = worker_state("word-hashes")
    if len(known) > 600_000:
        known.clear()
    for word in set(words).difference(known):
        known[word] = xxh3_64_intdigest(word)
    hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    mixed = hashes[: len(hashes) - width + 1].copy()
    for i in range(1, width):
        mixed = _mix(mixed) + hashes[i : len(hashes) - width + 1 + i]
    return np.unique(_mix(mixed))


def bucket_counts(tokens: np.ndarray) -> np.ndarray:
    """Tokens by hash bucket: 64 buckets, or 512 for large sets."""
    buckets = 64 if len(tokens) < 1500 else 512
    return np.bincount((tokens % np.uint64(buckets)).astype(np.int64), minlength=buckets).astype("<u4")


def overlap_bound(left: bytes, right: bytes) -> int:
    """No intersection is larger than this."""
    a, b = np.frombuffer(left, "<u4"), np.frombuffer(right, "<u4")
    if len(a) != len(b):
        a, b = a.reshape(-1, 64).sum(axis=0), b.reshape(-1, 64).sum(axis=0)
    return int(np.minimum(a, b).sum())


def _first_tokens(tokens: np.ndarray, order: np.ndarray | None, settings: Settings) -> np.ndarray:
    """The prefix of a set: tokens by frequency class, then by hash; without ``order``, ``ahead`` prefixes in hash order."""
    if order is None:
        return tokens[: settings.ahead * settings.prefix(len(tokens), settings.longest)].view(np.int64) if len(tokens) else tokens.view(np.int64)
    if len(tokens):
        late = order[(tokens >> np.uint64(64 - ORDER_BITS)).astype(np.int64)]
        if late.any():
            tokens = tokens[np.argsort(late, kind="stable")]
    return tokens[: settings.prefix(len(tokens), settings.longest)].view(np.int64) if len(tokens) else tokens.view(np.int64)


def _signatures(docs: DataFrame, settings: Settings, order: np.ndarray | None) -> DataFrame:
    """Text digest, class key (null without words), set size, prefix under ``order`` (default: hash order) and bucket counts per row."""
    rows = texts(docs).withColumn("digest", F.unhex(F.md5("text")))

    def make():
        def work(batch):
            found: dict[str, list] = {"key": [], "n": [], "prefix": [], "counts": []}
            for text in batch.column("text").to_pylist():
                words = words_of(text)
                tokens = tokens_of(words, settings.width)
                values = (class_key(words), len(tokens), _first_tokens(tokens, order, settings), bucket_counts(tokens).tobytes() if words else None)
                for name, value in zip(found, values):
                    found[name].append(value)
            return {"doc_id": batch.column("doc_id"), "digest": batch.column("digest"), **found}

        return work

    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_batches(rows, make, f"doc_id {kind}, digest binary, key binary, n long, prefix array<long>, counts binary")


def _late_classes(docs: DataFrame, settings: Settings) -> np.ndarray:
    """Frequency class by the first bits of a token, 0 for rare ones.

    At most ``order_entries`` rows of counts reach the driver.
    """
    plain = _signatures(docs, settings, None)
    counted = plain.select(F.explode("prefix").alias("token")).groupBy("token").count().filter(F.col("count") >= settings.frequent)
    bucket = F.shiftrightunsigned("token", 64 - ORDER_BITS).cast("int").alias("bucket")
    top = counted.groupBy(bucket).agg(F.max("count").alias("df")).orderBy(F.desc("df"), "bucket").limit(settings.order_entries)
    top = top.select("bucket", F.length(F.bin("df")).alias("class")).toArrow()
    order = np.zeros(1 << ORDER_BITS, np.uint8)
    order[top["bucket"].to_numpy()] = top["class"].to_numpy()
    return order


# --- candidates -----------------------------------------------------------------

def _postings(classes: DataFrame, settings: Settings) -> DataFrame:
    """``token, node, n, pos, l, rare, df`` of the prefix tokens that more than one class has.

    ``l`` minimises the estimated cost: entries to scan, and candidates to verify, which are at
    most the entries divided by ``l``.  ``rare`` counts prefix tokens that no other class has.
    """
    num, den, longest = settings.numerator, settings.denominator, settings.longest
    spread = classes.select("node", "n", F.size("prefix").alias("width"), F.posexplode("prefix").alias("pos", "token"))
    df = spread.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    shared = spread.join(df, "token")
    base = f"(n - (({num} * n + {den - 1}) div {den}))"
    costs = [
        F.expr(f"sum(if(pos < {base} + {l}, df - 1, 0)) * (1 + {settings.verify_cost}D / {l})").alias(f"cost{l}") for l in range(1, longest + 1)
    ]
    chosen = shared.groupBy("node").agg(*costs, (F.first("width") - F.count(F.lit(1))).alias("rare"), F.first("n").alias("n"))
    least = F.least(*[f"cost{l}" for l in range(1, longest + 1)]) if longest > 1 else F.col("cost1")
    pick = F.lit(longest)
    for l in range(longest - 1, 0, -1):
        pick = F.when(F.col(f"cost{l}") == least, F.lit(l)).otherwise(pick)
    # no more tokens can be asked for than two linked sets are sure to share
    pick = F.greatest(F.lit(1), F.least(pick, F.expr(f"cast(({num} * n + {den - 1}) div {den} as int)")))
    chosen = chosen.select("node", pick.alias("l"), "rare")
    return stage(
        shared.join(chosen, "node").filter(F.expr(f"pos < {base} + l")).select("token", "node", "n", "pos", "l", "rare", "df"), "postings"
    )


def _fits(settings: Settings, left: str, right: str) -> str:
    """Whether sizes allow a link and the shared token lies within both prefixes for this pair."""
    num, den = settings.numerator, settings.denominator
    need = f"(({num} * ({left}.n + {right}.n) + {num + den - 1}) div {num + den})"
    l = f"least({left}.l, {right}.l)"
    return (
        f"{den} * least({left}.n, {right}.n) >= {num} * greatest({left}.n, {right}.n) "
        f"and {left}.pos < {left}.n - {need} + {l} and {right}.pos < {right}.n - {need} + {l}"
    )


def _short_pairs(postings: DataFrame, settings: Settings) -> DataFrame:
    """Pairs that share at least the smaller ``l`` of tokens with short lists.

    A pair with fewer such tokens can only link if it shares a token with a long list as well.
    """
    short = postings.filter(F.col("df") <= settings.short)
    pairs = short.alias("x").join(short.alias("y"), F.expr("x.token = y.token and x.node < y.node and " + _fits(settings, "x", "y")))
    counted = pairs.groupBy(F.col("x.node").alias("a"), F.col("y.node").alias("b")).agg(
        F.count(F.lit(1)).alias("shared"), F.min(F.expr("least(x.l, y.l)")).alias("l")
    )
    return counted.filter("shared >= l").select("a", "b")


# --- verification ---------------------------------------------------------------

def _both(pairs: DataFrame, table: DataFrame, value: str) -> DataFrame:
    left = table.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col(value).alias("left"))
    right = table.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col(value).alias("right"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "n_a", "n_b", "left", "right")


def _checked(pairs: DataFrame, settings: Settings, overlap) -> DataFrame:
    """The pairs whose ``overlap`` of ``left`` and ``right`` reaches the threshold."""
    def make():
        def work(batch):
            columns = [batch.column(name).to_pylist() for name in ("n_a", "n_b", "left", "right")]
            good = []
            for n_a, n_b, left, right in zip(*columns):
                shared = overlap(left, right)
                good.append(settings.denominator * shared >= settings.numerator * (n_a + n_b - shared))
            return {"a": batch.column("a"), "b": batch.column("b"), "good": good}

        return work

    return map_batches(pairs, make, "a long, b long, good boolean").filter("good").drop("good")


def _shared_tokens(left: bytes, right: bytes) -> int:
    a, b = np.frombuffer(left, np.uint64), np.frombuffer(right, np.uint64)
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum())


def _whole_sets(docs: DataFrame, needed: DataFrame, settings: Settings, repeats: bool) -> DataFrame:
    """``node, n, tokens`` of the needed nodes (``node, rep, key``).

    Ids may repeat: a text counts if it has the node's key, and once if there are ``repeats``.
    """
    rows = texts(docs).join(needed.select("node", F.col("rep").alias("doc_id"), "key"), "doc_id")

    def make():
        def work(batch):
            found: dict[str, list] = {"node": [], "n": [], "tokens": []}
            for node, text, key in zip(*(batch.column(name).to_pylist() for name in ("node", "text", "key"))):
                words = words_of(text)
                if class_key(words) == key:
                    tokens = tokens_of(words, settings.width)
                    for name, value in zip(found, (node, len(tokens), tokens.tobytes())):
                        found[name].append(value)
            return found

        return work

    sets = map_batches(rows.select("node", "text", "key"), make, "node long, n long, tokens binary")
    return sets.dropDuplicates(["node"]) if repeats else sets


# --- long lists -------------------------------------------------------------------

def _pivots(lists: DataFrame) -> DataFrame:
    """``token, pivot``: the member with the fewest rare tokens, then twice the best pivot of the lists that this one is in.

    The lists of a group of near copies come to share one pivot that way.  A pivot need not be
    a member of its list: any node will do as the centre, as long as a list has just one.
    """
    chosen = lists.groupBy("token").agg(F.min(F.struct("rare", "node")).alias("p"))
    best = lists.select("token", "node").join(chosen, "token").groupBy("node").agg(F.min("p").alias("q"))
    for _ in range(2):
        chosen = chosen.join(best, F.col("p.node") == F.col("node")).select("token", F.col("q").alias("p"))
    return chosen.select("token", F.col("p.node").alias("pivot"))


def _differences(lists: DataFrame, sets: DataFrame, settings: Settings) -> DataFrame:
    """``pivot, node, n, d, linked, diff``: each member of a list against the list's pivot.

    ``diff`` holds the ``d`` tokens that only one of the two sets has.
    """
    numerator, denominator = settings.numerator, settings.denominator
    pairs = lists.join(_pivots(lists), "token").filter("node <> pivot").select("pivot", "node").distinct()
    own = pairs.join(sets.select("node", "n", "tokens"), "node")
    both = own.join(sets.select(F.col("node").alias("pivot"), F.col("tokens").alias("center")), "pivot")

    def make():
        def work(batch):
            sizes, linked, diffs = [], [], []
            for tokens, center in zip(*(batch.column(name).to_pylist() for name in ("tokens", "center"))):
                a, b = np.frombuffer(tokens, np.uint64), np.frombuffer(center, np.uint64)
                diff = np.setxor1d(a, b, assume_unique=True)
                shared = (len(a) + len(b) - len(diff)) // 2
                sizes.append(len(diff))
                linked.append(denominator * shared >= numerator * (shared + len(diff)))
                diffs.append(diff.view(np.int64))
            return {"pivot": batch.column("pivot"), "node": batch.column("node"), "n": batch.column("n"), "d": sizes, "linked": linked, "diff": diffs}

        return work

    return map_batches(both.select("pivot", "node", "n", "tokens", "center"), make, "pivot long, node long, n long, d long, linked boolean, diff array<long>")


def _places(pivot: int, elements: np.ndarray) -> np.ndarray:
    """Places of elements around a pivot in a table of fixed size."""
    return (_mix(elements ^ _mix(np.array([pivot], np.int64).view(np.uint64))) >> np.uint64(64 - PLACE_BITS)).astype(np.int64)


def _marked_places(rows: DataFrame, mark) -> np.ndarray:
    """The places that ``mark(batch, marks)`` sets for any batch of ``rows``, as a table of booleans.

    A task gives one bitmap of fixed size, in parts, however many rows it reads; Spark joins
    them, so the driver gets one bitmap.
    """
    def run(batches):
        marks = np.zeros(1 << PLACE_BITS, bool)
        for batch in batches:
            mark(batch, marks)
        parts = np.packbits(marks).reshape(-1, BITMAP_BYTES)
        at = np.flatnonzero(parts.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([parts[i].tobytes() for i in at], pa.binary())], ["part", "bits"])

    marks = np.zeros((1 << PLACE_BITS) // 8, np.uint8).reshape(-1, BITMAP_BYTES)
    for row in rows.mapInArrow(run, "part int, bits binary").groupBy("part").agg(F.bitmap_or_agg("bits").alias("bits")).collect():
        marks[row["part"]] = np.frombuffer(row["bits"], np.uint8)
    return np.unpackbits(marks.reshape(-1)).astype(bool)


def _elements(diffs: DataFrame, settings: Settings) -> DataFrame:
    """``pivot, node, n, d, linked, pos, element``: the beginnings of differences.

    A beginning is as long as a link can leave before the first shared element, whatever the
    other set: ``denominator - numerator`` of ``numerator`` of the set's size.  Elements that
    many members have come last: they are counted in a table of fixed size, whole however the
    rows are dealt, which changes cost only.  Of linked members only elements count that one that is not
    linked may have.  At most 2^PLACE_BITS numbers as Arrow columns and one bitmap reach the driver.
    """
    spare, numerator = settings.denominator - settings.numerator, settings.numerator

    def places_of(batch, pick) -> list[np.ndarray]:
        return [pick(pivot, np.array(diff, np.int64).view(np.uint64), n) for pivot, diff, n in zip(*(batch.column(name).to_pylist() for name in ("pivot", "diff", "n")))]

    def count(batches):
        totals = np.zeros(1 << PLACE_BITS, np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH_ROWS):
                found = places_of(batch.slice(start, BATCH_ROWS), lambda pivot, elements, n: _places(pivot, elements))
                place, times = np.unique(np.concatenate([np.empty(0, np.int64), *found]), return_counts=True)
                totals[place] += times
        at = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(totals[at], pa.int64())], ["place", "times"])

    common = np.zeros(1 << PLACE_BITS, np.uint8)
    repeated = diffs.mapInArrow(count, "place int, times long").groupBy("place").agg(F.sum("times").alias("times")).filter("times > 1")
    repeated = repeated.select("place", F.length(F.bin("times")).alias("class")).toArrow()
    common[repeated["place"].to_numpy()] = repeated["class"].to_numpy()

    def first(pivot: int, elements: np.ndarray, n: int) -> np.ndarray:
        order = np.argsort(common[_places(pivot, elements)], kind="stable")
        return elements[order[: spare * n // numerator + 1]]

    def mark(batch, marks: np.ndarray) -> None:
        for places in places_of(batch, lambda pivot, elements, n: _places(pivot, first(pivot, elements, n))):
            marks[places] = True

    seen = _marked_places(diffs.filter("not linked"), mark)

    def make():
        def work(batch):
            kept = []
            for (pivot, elements), linked in zip(places_of(batch, lambda pivot, elements, n: (pivot, first(pivot, elements, n))), batch.column("linked").to_pylist()):
                at = np.flatnonzero(seen[_places(pivot, elements)]) if linked else np.arange(len(elements))
                kept.append((at, elements[at].view(np.int64)))
            return {name: batch.column(name) for name in ("pivot", "node", "n", "d", "linked")} | {"pos": [at for at, _ in kept], "element": [e for _, e in kept]}

        return work

    marked = map_batches(diffs, make, "pivot long, node long, n long, d long, linked boolean, pos array<long>, element array<long>")
    each = marked.select("pivot", "node", "n", "d", "linked", F.explode(F.arrays_zip("pos", "element")).alias("e"))
    return each.select("pivot", "node", "n", "d", "linked", F.col("e.pos").alias("pos"), F.col("e.element").alias("element"))


def _links_in_long_lists(lists: DataFrame, sets: DataFrame, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """Links, and pairs still to verify, that connect all that link within ``lists`` (``token, node, rare``).

    With ``s = numerator + denominator`` and ``k = denominator - numerator``, two sets link if
    ``s * |x ^ y| <= k * (n_x + n_y)``; and ``|x ^ y| = d_x + d_y - 2 * |diff_x & diff_y|``.
    """
    s, k = settings.numerator + settings.denominator, settings.denominator - settings.numerator
    links = sets.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)
    pairs = links
    for level in range(settings.levels + 1):
        diffs = stage(_differences(lists, sets, settings), "differences")
        links = links.unionByName(diffs.filter("linked").select(F.col("pivot").alias("a"), F.col("node").alias("b")))
        # close to the pivot together: one of the two links with it, and the closest such member will do
        closest = diffs.filter("linked").groupBy("pivot").agg(F.min(F.struct(F.expr(f"{s} * d - {k} * n").alias("slack"), "node")).alias("best"))
        near = diffs.filter("not linked").join(closest, "pivot").filter(F.expr(f"{s} * d - {k} * n + best.slack <= 0"))
        links = links.unionByName(near.select(F.col("best.node").alias("a"), F.col("node").alias("b")))
        # otherwise they share elements of their differences
        elements = _elements(diffs, settings)
        counts = elements.groupBy("pivot", "element").agg(F.count(F.lit(1)).alias("df"), F.count_if(~F.col("linked")).alias("open")).filter("df > 1 and open > 0")
        # what a list costs are its pairs, and linked members do not meet each other
        counts = counts.select("pivot", "element", F.expr("open * (df - open) + open * (open - 1) div 2").alias("cost"))
        shared = stage(elements.join(counts, ["pivot", "element"]), "elements")
        last, most = level == settings.levels, settings.short * (settings.short - 1) // 2
        few = shared if last else shared.filter(F.col("cost") <= most)
        need = f"(({s} * (x.d + y.d) - {k} * (x.n + y.n) + {2 * s - 1}) div {2 * s})"
        found = few.filter("not linked").alias("x").join(few.alias("y"), F.expr(
            f"x.pivot = y.pivot and x.element = y.element and (y.linked and x.node <> y.node or x.node < y.node) "
            f"and {settings.denominator} * least(x.n, y.n) >= {settings.numerator} * greatest(x.n, y.n) "
            f"and {need} > 0 and x.pos <= x.d - {need} and y.pos <= y.d - {need}"
        ))
        pairs = pairs.unionByName(found.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")))
        if last:
            break
        many = shared.filter(F.col("cost") > most)
        if many.isEmpty():
            break
        lists = many.select(F.struct("pivot", "element").alias("token"), "node", F.col("d").alias("rare"))
    return links, pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


# --- the operator -----------------------------------------------------------------

def _labelled(docs: DataFrame, settings: Settings) -> DataFrame:
    """``doc_id, digest, n, component_id`` per row; ``digest`` tells the texts of one id apart."""
    signed = stage(_signatures(docs, settings, _late_classes(docs, settings)), "signatures")
    repeats = not signed.filter("key is not null").groupBy("doc_id", "key").count().filter("count > 1").isEmpty()
    grouped = signed.filter("key is not null and doc_id is not null").groupBy("key")
    classes = stage(
        grouped.agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("counts").alias("counts"))
        .withColumn("node", F.monotonically_increasing_id()),
        "classes",
    )
    postings = _postings(classes, settings)
    short = stage(_checked(_both(_short_pairs(postings, settings), classes, "counts"), settings, overlap_bound), "pairs")
    long = postings.filter(F.col("df") > settings.short).select("token", "node", "rare")

    involved = short.select(F.explode(F.array("a", "b")).alias("node")).unionByName(long.select("node")).distinct()
    sets = stage(_whole_sets(docs, involved.join(classes.select("node", "rep", "key"), "node"), settings, repeats), "sets")
    links = _checked(_both(short, sets, "tokens"), settings, _shared_tokens)
    if not long.isEmpty():
        around, pairs = _links_in_long_lists(long, sets, settings)
        links = links.unionByName(around).unionByName(_checked(_both(pairs, sets, "tokens"), settings, _shared_tokens))
    found = components(links)

    names = classes.select("key", "node", "rep")
    member = names.join(found, "node", "left")
    least = member.filter("component is not null").groupBy("component").agg(F.min("rep").alias("least"))
    member = member.join(least, "component", "left").select("key", F.coalesce("least", "rep").alias("component_id"))
    return signed.select("doc_id", "digest", "key", "n").join(member, "key", "left").select(
        "doc_id", "digest", "n", F.coalesce("component_id", "doc_id").alias("component_id")
    )


def jaccard_components(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``doc_id``, ``n_tokens`` (set size) and ``component_id`` per row.

    ``component_id`` is the least ``doc_id`` reachable by links.  Documents without words (also
    null and empty texts) have no tokens and link with nothing, not with each other either.
    Rows that repeat id and text give one row each and link.  If an id repeats with other
    texts, each row is judged by its own text.  Rows without id link through their text but are
    nobody's component.  Very long texts count as a whole; an empty table gives an empty result.
    """
    return _labelled(docs, settings).select("doc_id", F.col("n").alias("n_tokens"), "component_id")


def keep_one(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows of ``docs`` without those that a link leads from to a lesser id.

    Rows without id stay.  If an id repeats with other texts, only the texts that link to a
    lesser id go.
    """
    gone = _labelled(docs, settings).filter("component_id <> doc_id").select("doc_id", F.col("digest").alias("_digest"))
    marked = docs.withColumn("_digest", F.unhex(F.md5(F.coalesce("text", F.lit("")))))
    return marked.join(gone, ["doc_id", "_digest"], "left_anti").select(*docs.columns)
