"""Near-duplicate documents by ProbMinHash, banding and verification.

A document's shingles, weighted by how often they occur in it, each send a Poisson process of
arrivals, faster for heavier ones; each arrival falls on a random component, and a component keeps
the shingle that arrives first. A shingle stops as soon as its next arrival is later than every
component's first. Two documents agree on a component with the probability Jaccard similarity of
their weighted shingles. Where shingles repeat, a second signature with all weights 1 does the same
for their sets. Either similarity makes a link, each with bands, a prefilter and an exact
verification of its own.

Documents with the same words are one node. Nodes that agree on a band share a bucket; buckets are
never expanded into pairs (see ``bucket_components``). After the first round, nodes are left out
whose shingles are too rarely those of others for a link.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.llm.common import drop, noted, row_key, small, written
from engram.llm.components import bucket_components, bucket_entries, parted
from engram.llm.textblock import TERM, U64, Block, RollingHash, blocks, lowered, mix

_STEP = U64(0xD1B54A32D192ED03)


@dataclass(frozen=True)
class NearRules:
    """Shingles of ``words`` words (a shorter document is one shingle); a link has a similarity of
    ``least`` or more, that of its weighted shingles or that of their sets; ``bands`` bands of
    ``rows`` components for either: at a similarity of 0.8 a link shares no band in 1 of 40 000
    cases. Signatures have ``more`` components without a band. Candidates are verified unless more
    than ``unlike`` of all components of either signature differ, as links of 0.8 do in 1 of 30 000
    cases."""

    words: int = 5
    least: float = 0.8
    bands: int = 20
    rows: int = 4
    more: int = 130
    unlike: float = 0.3145

    @property
    def components(self) -> int:
        return self.bands * self.rows + self.more


def word_hashes(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts of a block, A-Z in lower case, and the text of each."""
    starts, ends = block.words(TERM)
    return RollingHash(lowered(block.data))(starts, ends), block.text_of(starts)


def shingles(word: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text: hash, number of occurrences, text; ascending by text and hash."""
    size = len(word)
    if not size:
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.searchsorted(text, text, side="left")
    last = np.searchsorted(text, text, side="right")
    at = np.flatnonzero((np.arange(size) + n <= last) | ((last - first < n) & (np.arange(size) == first)))
    value = np.zeros(len(at), U64)
    for k in range(n):
        there = at + k
        inside = there < last[at]
        value = np.where(inside, mix(value * _STEP + word[np.minimum(there, size - 1)] + U64(k + 1)), value)
    owner = text[at]
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.ones(len(at), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    places = np.flatnonzero(new)
    return value[places], np.diff(np.append(places, len(at))), owner[places]


def signatures(value: np.ndarray, weight: np.ndarray, text: np.ndarray, texts: int, m: int) -> np.ndarray:
    """For each text, the shingle that arrives first at each of m components (0 in a text without shingles)."""
    found = np.zeros(texts * m, U64)
    count = np.bincount(text, minlength=texts)
    single = count[text] == 1
    found.reshape(texts, m)[text[single]] = value[single][:, None]
    first = np.full(texts * m, np.inf)
    active = np.flatnonzero(~single)
    time, late, draw = np.zeros(len(value)), np.full(texts, np.inf), 0
    while len(active):
        draw += 1
        bits = mix(value[active] + _STEP * np.full(1, draw, U64))
        time[active] -= np.log((((bits >> U64(11)).astype(np.float64)) + 0.5) * 2.0**-53) / weight[active]
        early = time[active] < late[text[active]]
        active, bits = active[early], bits[early]
        cell = text[active] * m + (mix(bits ^ _STEP) % U64(m)).astype(np.int64)
        better = time[active] < first[cell]
        at, who = cell[better], active[better]
        order = np.argsort(-time[who], kind="stable")
        first[at[order]] = time[who[order]]
        found[at[order]] = value[who[order]]
        late = first.reshape(texts, m).max(axis=1)
    return found.reshape(texts, m)


#: Seven components to a long, seven bits of each.
_PACKED, _SEVENS, _EIGHTS = 7, 0x7F7F7F7F7F7F7F, 0x80808080808080


def packed(signature: np.ndarray) -> np.ndarray:
    """Seven bits of each component, seven components to a long."""
    texts, m = signature.shape
    bits = np.zeros((texts, -(-m // _PACKED), 8), np.uint8)
    flat = np.zeros((texts, bits.shape[1] * _PACKED), np.uint8)
    flat[:, :m] = (mix(signature) & U64(0x7F)).astype(np.uint8)
    bits[:, :, :_PACKED] = flat.reshape(texts, -1, _PACKED)
    return bits.view("<i8")[:, :, 0]


def differing(a: Column, b: Column, longs: int) -> Column:
    """How many components of two packed signatures differ."""
    unlike = [F.bit_count((F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i))) + F.lit(_SEVENS)).bitwiseAND(F.lit(_EIGHTS))) for i in range(longs)]
    return reduce(Column.__add__, unlike)


def sketch(block: Block, rules: NearRules) -> tuple[list[bytes], list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Of each text, the digest of its words (of its bytes, if it has none); its band keys and packed
    signatures by weights and by sets; and whether any of its shingles repeats, so that they differ."""
    word, text = word_hashes(block)
    texts = len(block.lengths)
    place = np.arange(len(word), dtype=np.int64) - np.searchsorted(text, text, side="left")
    parts = []
    hashed = RollingHash(block.data)(block.offsets[:-1], block.offsets[1:])
    wordless = np.bincount(text, minlength=texts) == 0
    for seed in (U64(1), U64(2)):
        total = np.zeros(len(word) + 1, U64)
        np.cumsum(mix(word * (seed + seed + U64(1)) + place.astype(U64) * _STEP + seed), out=total[1:])
        ends = np.searchsorted(text, np.arange(texts), side="right")
        starts = np.searchsorted(text, np.arange(texts), side="left")
        parts.append(np.where(wordless, mix(hashed + seed), mix(total[ends] - total[starts] + (ends - starts).astype(U64))))
    digests = [row.tobytes() for row in np.stack(parts, axis=1).astype(">u8")]
    value, times, owner = shingles(word, text, rules.words)
    repeats = np.zeros(texts, bool)
    repeats[owner[times > 1]] = True
    by_set = signatures(value, np.ones(len(value), np.int64), owner, texts, rules.components)
    by_weight, here = by_set.copy(), np.flatnonzero(repeats[owner])
    if len(here):
        again = np.cumsum(repeats) - 1
        by_weight[repeats] = signatures(value[here], times[here], again[owner[here]], int(repeats.sum()), rules.components)
    keys = []
    for signature in (by_weight, by_set):
        key = np.zeros((texts, rules.bands), U64)
        for r in range(rules.rows):
            key = mix(key * _STEP + signature[:, r :: rules.rows][:, : rules.bands])
        keys.append(mix(key + np.arange(1, rules.bands + 1, dtype=U64)[None, :] * _STEP))
    return digests, keys, [packed(by_weight), packed(by_set)], repeats


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of shingles."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def probability_jaccard(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray) -> float:
    """Probability Jaccard similarity of shingles a and b with weights na and nb.

    It adds, over common shingles d, 1 / sum over all j of max(na[j] / na[d], nb[j] / nb[d]); the
    left one is larger from where the ratio of both weights is that of d upwards, so sums along the
    order of ratios give all of them at once.
    """
    _, ia, ib = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(ia):
        return 0.0
    x, y = na[ia].astype(float), nb[ib].astype(float)
    order = np.argsort(x / y, kind="stable")
    x, y = x[order], y[order]
    ratio = x / y
    upwards = np.cumsum(x[::-1])[::-1] + (na.sum() - x.sum())
    before = np.concatenate([[0.0], np.cumsum(y)])[:-1] + (nb.sum() - y.sum())
    first = np.searchsorted(ratio, ratio, side="left")
    return float((1 / (upwards[first] / x + before[first] / y)).sum())


def linked(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray, least: float) -> bool:
    """Whether either similarity is ``least`` or more; without repeats they are the same."""
    if similarity(a, b) >= least:
        return True
    return (na.sum() > len(a) or nb.sum() > len(b)) and probability_jaccard(a, na, b, nb) >= least


def _similar(rules: NearRules):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for side_a in blocks([batch], "ta"):
                rows = side_a.rows
                sides = []
                for name in ("ta", "tb"):
                    block = side_a if name == "ta" else next(blocks([rows], name, 1 << 40))
                    value, times, owner = shingles(*word_hashes(block), rules.words)
                    at = np.searchsorted(owner, np.arange(len(rows) + 1))
                    sides.append([(value[i:j], times[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)])
                alike = [linked(*a, *b, rules.least) for a, b in zip(*sides, strict=True)]
                yield rows.select(["a", "b"]).filter(pa.array(alike, pa.bool_()))

    return compare


def _possible(entries: DataFrame, texts: DataFrame, rules: NearRules) -> DataFrame:
    """Without nodes that can't have a link to another component of their buckets.

    A link by sets between n and m shingles takes least / (1 + least) * (n + m) common ones. Common
    ones are those that nodes of other components have too, and m is at least the smallest number in
    the node's bucket. Probability Jaccard is at most 1 less the distance in variation of the weights
    over their sums, so in a link by weights common ones have ``least`` of the node's weight;
    where no node of a bucket repeats a shingle, links by weights are links by sets.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            value, times, owner = shingles(*word_hashes(block), rules.words)
            own = block.rows.select(["node", "comp"]).take(pa.array(owner))
            yield pa.record_batch([*own.columns, pa.array(value.astype(np.int64)), pa.array(times)], names=["node", "comp", "s", "times"])

    held = entries.select("node", "comp").distinct()
    shingled = texts.join(held, "node").select("node", "comp", "text").mapInArrow(rows, "node binary, comp binary, s long, times long")
    shingled = shingled.select(F.xxhash64("node").alias("n"), F.xxhash64("comp").alias("c"), "s", "times")
    across = shingled.groupBy("s").agg(F.min("c").alias("_c"), F.max("c").alias("_d")).where("_c <> _d").select("s", F.lit(1).alias("_across"))
    share = written(shingled.join(across, "s", "left").groupBy("n").agg(F.count("_across").alias("common"), F.count(F.lit(1)).alias("size"), F.sum(F.col("_across") * F.col("times")).alias("held"), F.sum("times").alias("weight")))
    sized = entries.withColumn("n", F.xxhash64("node")).join(share, "n")
    fewest = sized.groupBy("key").agg(F.min("size").alias("fewest"), F.max(F.col("weight") > F.col("size")).alias("repeats"))
    needed = rules.least / (1 + rules.least) * (F.col("size") + F.greatest("fewest", rules.least * F.col("size")))
    may = (F.col("common") >= needed - 1e-9) | (F.col("repeats") & (F.col("held") >= rules.least * F.col("weight") - 1e-9))
    return written(parted(sized.join(fewest, "key").where(may).select(*entries.columns)))


def near_duplicates(docs: DataFrame, rules: NearRules = NearRules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id (smallest doc_id of its class), class_size, _k (tells rows apart that share an id), _comp (the class).

    A class is a connected component of links: documents with the same words, or whose shingles have
    a similarity of ``rules.least`` or more, by probability Jaccard of their numbers of occurrences
    or by Jaccard of their sets. Texts without words are alike only if their bytes are; null is like
    the empty text. Rows may share an id; a null id can be in a class but names it only if all its
    ids are null. Other columns are ignored; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("_k", row_key("doc_id", "text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, limit=2 << 20):
            digests, keys, parts, repeats = sketch(block, rules)
            lists = []
            for by_weight, by_set in (keys, parts):
                flat = np.concatenate([by_weight, by_set], axis=1)
                taken = np.ones(flat.shape, bool)
                taken[:, by_weight.shape[1] :] = repeats[:, None]
                offsets = np.concatenate([[0], np.cumsum(taken.sum(axis=1))]).astype(np.int32)
                lists.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat[taken].astype(np.int64))))
            worded = pa.array(np.bincount(word_hashes(block)[1], minlength=len(digests)) > 0)
            yield pa.record_batch([block.rows.column("doc_id"), block.rows.column("_k"), pa.array(digests, pa.binary()), *lists, worded], names=["doc_id", "_k", "node", "bands", "parts", "worded"])

    made = written(rows.mapInArrow(sketches, f"doc_id {kind}, _k long, node binary, bands array<long>, parts array<long>, worded boolean"))
    with noted() as scratch:
        nodes = made.where("worded").groupBy("node").agg(F.min(F.struct("doc_id", "_k")).alias("rep"), F.first("bands").alias("bands"), F.first("parts").alias("sign"))
        nodes = written(nodes, release=True)
        entries = written(bucket_entries(nodes.select("node", F.explode(F.array_distinct("bands")).alias("key")), nodes.select("node", "sign")), release=True)

        wanted = nodes.join(entries.select("node").distinct(), "node", "left_semi").select("node", F.col("rep.doc_id").alias("_doc"), F.col("rep._k").alias("_row"))
        texts = rows.join(wanted, (rows["_k"] == wanted["_row"]) & rows["doc_id"].eqNullSafe(wanted["_doc"])).select("node", "text")
        texts = written(texts.dropDuplicates(["node"]), release=True)
        drop(docs.sparkSession, scratch, entries, texts)
    longs = -(-rules.components // _PACKED)

    def close(a: Column, b: Column) -> Column:
        most = rules.unlike * rules.components
        sets = [F.when(F.size(x) > longs, F.slice(x, longs + 1, longs)).otherwise(x) for x in (a, b)]
        repeats = (F.size(a) > longs) | (F.size(b) > longs)
        return (differing(a, b, longs) <= most) | (repeats & (differing(*sets, longs) <= most))

    def similar(pairs: DataFrame) -> DataFrame:
        left, right = (texts.select(F.col("node").alias(x), F.col("text").alias(f"t{x}")) for x in "ab")
        return pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInArrow(_similar(rules), "a binary, b binary")

    component = bucket_components(entries, close, similar, lambda now: _possible(now, texts, rules))
    made = made.select("doc_id", "_k", "node")
    named = made.groupBy("node").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    if component is None:
        named = named.withColumn("_comp", F.col("node"))
    else:
        placed = written(named.join(component, "node", "left"))
        of_comp = written(placed.where("comp IS NOT NULL").groupBy("comp").agg(F.min("class_id").alias("class_id"), F.sum("class_size").alias("class_size")))
        connected = placed.select("node", "comp").join(small(of_comp), "comp").select("node", "class_id", "class_size", F.col("comp").alias("_comp"))
        named = placed.where("comp IS NULL").select("node", "class_id", "class_size", F.col("node").alias("_comp")).unionByName(connected)
    # rows of a hot node are split by the join's planner, as both of its sides are written tables
    return made.join(written(named), "node").select("doc_id", "class_id", "class_size", "_k", "_comp")


def keep_one(docs: DataFrame, rules: NearRules = NearRules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each class the row with the smallest id (then text hash), once.

    Columns may have any names.
    """
    names = docs.columns
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))
    ident, text = (f"c{names.index(c)}" for c in (id_col, text_col))
    classes = written(near_duplicates(plain, rules, ident, text).select("doc_id", "_k", "_comp"))
    chosen = classes.groupBy("_comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_k")).alias("_first"))
    chosen = written(chosen.select(F.col("_first.doc_id").alias("_doc"), F.col("_first._k").alias("_row")))
    keyed = plain.withColumn("_key", row_key(ident, text))
    kept = keyed.join(chosen, (keyed["_key"] == chosen["_row"]) & keyed[ident].eqNullSafe(chosen["_doc"])).drop("_doc", "_row")
    times = classes.groupBy("doc_id", "_k").agg(F.count(F.lit(1)).alias("_times")).where("_times > 1").select(F.col("doc_id").alias("_doc"), F.col("_k").alias("_row"))
    times = written(times)
    if not times.isEmpty():
        on = (kept["_key"] == times["_row"]) & kept[ident].eqNullSafe(times["_doc"])
        kept = kept.join(times, on, "left_anti").unionByName(kept.join(times, on, "left_semi").dropDuplicates(["_key", ident]))
    return kept.drop("_key").toDF(*names)
