"""MinHash near-dedup: consistent weighted samples of TF-IDF shingles, banded, then verified.

Weights are the number of times a shingle of five words occurs in a text, times its
inverse document frequency. Frequencies are counted for all documents in a table of
fixed size; its expected collisions are taken off. Shingles in fewer than a RARE share of
all documents, and counts within the table's noise, are not told apart: what a family of
near-copies shares must not weigh less than what its members change.

A sample is the (shingle, level) that improved consistent weighted sampling picks among
the shingles of one of BINS parts of the hash range; REPEATS independent passes give
REPEATS samples per band. Alike texts have total weights of a ratio of ``threshold`` at
least, so of the texts that share a band only those of one class of size, or of two
neighbouring ones, are compared: first with the LEADERS texts that meet most others in
their groups. A group whose texts these links join has nothing left to join; in all others
every pair of texts not joined yet is compared, in blocks of about LOCAL texts. Links have a
weighted Jaccard similarity of at least ``threshold``; classes are their connected components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from splitlane.llm import arrays as A
from splitlane.llm.components import connected_components
from splitlane.llm.tables import in_small_batches
from splitlane.operators.filters import union_sources
from splitlane.session import settle

SHINGLE = 5
THRESHOLD = 0.8
BINS = 16  # bands
REPEATS = 4  # samples that must agree in a band
TABLE = 1 << 18
RARE = 0.5  # above the share of the largest family to be expected
LEADERS = 3  # texts of a group that all its others are compared with first
LOCAL = 512  # texts that one task compares, about
_COLUMNS = 1024
_QUANTILES = 1 << 16


def shingles(data: np.ndarray, off: np.ndarray, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, times) of every distinct shingle of each text, ordered; a shorter text is one shingle."""
    starts, ends, first = A.word_table(data, off)
    words = A.word_hashes(data, starts, ends)
    n = np.diff(first)
    wide = np.maximum(n - width + 1, (n > 0).astype(np.int64))
    text = np.repeat(np.arange(len(n)), wide)
    begin = A.grouped_ranges(first[:-1], wide)
    hashes = A.span_hashes(words, A.WORD_BASE, begin, np.minimum(begin + width, first[1:][text]))
    order = np.lexsort((hashes, text))
    text, hashes = text[order], hashes[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (hashes[1:] != hashes[:-1])
    at = np.flatnonzero(new)
    return text[at], hashes[at], np.diff(np.append(at, len(text)))


def _cell(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - 18)).astype(np.int64)


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen, docs = np.zeros(TABLE, np.int64), 0
    for batch in A.slices(batches, "text"):
        _, hashes, _ = shingles(*A.text_buffers(batch.column(0)))
        seen += np.bincount(_cell(hashes), minlength=TABLE)
        docs += batch.num_rows
    at = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(seen[at], docs))], ["cell", "docs"])


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    """Of every cell of the table, over all documents; TABLE numbers, however many documents there are."""
    counts = docs.select("text").mapInArrow(_count_rows, "cell long, docs long").groupBy("cell").agg(F.sum("docs").alias("docs"))
    table = counts.toArrow()
    cell, number = table["cell"].to_numpy(), table["docs"].to_numpy()
    found = np.zeros(TABLE)
    found[cell[cell >= 0]] = number[cell >= 0]
    total = float(number[cell < 0].sum())
    alone = found - (found.sum() - found) / (TABLE - 1)
    least = max(np.sqrt(total), RARE * total)
    return (1 + np.log10((1 + total) / (1 + np.maximum(alone, least)))).astype(np.float32)


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Quantiles of a Gamma(2, 1) variable, of the log of one, and of a uniform one, in random order."""
    p = (np.arange(_QUANTILES) + 0.5) / _QUANTILES
    x = np.linspace(0.0, 40.0, 1 << 20)
    gamma = np.interp(p, 1 - np.exp(-x) * (1 + x), x)
    rng = np.random.default_rng(9)
    return rng.permutation(gamma), np.log(rng.permutation(gamma)), rng.permutation(p)


def band_keys(text: np.ndarray, shingle: np.ndarray, weight: np.ndarray, texts: int) -> np.ndarray:
    """BINS keys for each of ``texts`` texts; texts without shingles have keys too, to be ignored."""
    gamma, log_gamma, uniform = A.remembered(("quantiles",), _tables)
    low = np.uint64(_QUANTILES - 1)
    keys = np.zeros((texts, BINS), np.uint64)
    log_weight = np.log(weight)
    for repeat in range(REPEATS):
        h = A.mix(shingle + A.powers(A.BYTE_BASE, REPEATS + 1)[repeat + 1])
        r = gamma[(h & low).astype(np.int64)]
        c = log_gamma[((h >> np.uint64(16)) & low).astype(np.int64)]
        beta = uniform[((h >> np.uint64(32)) & low).astype(np.int64)]
        level = np.floor(log_weight / r + beta)
        rank = c - r * (level - beta) - r
        cell = text * BINS + (h >> np.uint64(60)).astype(np.int64)
        least = np.full(texts * BINS, np.inf)
        np.minimum.at(least, cell, rank)
        best = rank == least[cell]
        sample = np.full(texts * BINS, np.iinfo(np.uint64).max)
        np.minimum.at(sample, cell[best], A.mix(shingle[best] + level[best].astype(np.int64).view(np.uint64) * A.MIX_2))
        sample = sample.reshape(texts, BINS)
        empty = np.isinf(least).reshape(texts, BINS)
        # An empty bin takes the sample of another, tried in an order that only the bin decides.
        tries = np.random.default_rng(100 + repeat)
        full, filled = ~empty, sample.copy()
        for b in range(BINS):
            lacking = empty[:, b].copy()
            for other in tries.permutation(BINS):
                takes = lacking & full[:, other]
                filled[takes, b] = sample[takes, other]
                lacking &= ~takes
        keys = A.mix(keys * A.WORD_BASE + filled + np.uint64(repeat))
    return A.mix(keys + np.arange(BINS, dtype=np.uint64) * A.MIX_1)


def _band_rows(idf: np.ndarray, threshold: float):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in A.slices(batches, "text"):
            text, shingle, times = shingles(*A.text_buffers(batch.column(1)))
            weight = times * idf[_cell(shingle)]
            keys = band_keys(text, shingle, weight, batch.num_rows)
            some = np.unique(text)
            # Slightly wider classes than needed, so that rounding can't part alike texts.
            total = np.bincount(text, weight, minlength=batch.num_rows)[some]
            size = np.floor(np.log(total) / (-np.log(threshold) * 1.001)).astype(np.int32)
            tid = batch.column(0).take(pa.array(np.repeat(some, BINS)))
            band = np.tile(np.arange(BINS, dtype=np.int32), len(some))
            yield pa.RecordBatch.from_arrays(
                [tid, pa.array(band), pa.array(keys[some].ravel().view(np.int64)), pa.array(np.repeat(size, BINS))],
                ["tid", "band", "key", "size"],
            )

    return rows


def _weighted(column: pa.Array, idf: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """Distinct shingles, their weights and total of each text."""
    text, shingle, times = shingles(*A.text_buffers(column))
    weight = times * idf[_cell(shingle)]
    cuts = np.searchsorted(text, np.arange(len(column) + 1))
    return [(shingle[a:b], weight[a:b], float(weight[a:b].sum())) for a, b in zip(cuts, cuts[1:])]


def _likeness(one, other) -> float:
    _, x, y = np.intersect1d(one[0], other[0], assume_unique=True, return_indices=True)
    common = float(np.minimum(one[1][x], other[1][y]).sum())
    return common / (one[2] + other[2] - common)


def _similarity_rows(idf: np.ndarray):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in A.slices(batches, "text"):
            pairs = zip(_weighted(batch.column(2), idf), _weighted(batch.column(3), idf))
            likeness = np.array([_likeness(a, b) for a, b in pairs])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(likeness)], ["tid", "leader", "likeness"]
            )

    return rows


def _likeness_matrix(texts: list[tuple[np.ndarray, np.ndarray, float]], idf: np.ndarray) -> np.ndarray:
    """Weighted Jaccard similarities of all pairs of a bounded group.

    The k-th occurrence of a shingle is a feature of its own, weighing what the shingle does;
    then the common weight is the weight of common features, a product of matrices.
    """
    number = np.concatenate([np.rint(w / idf[_cell(h)]).astype(np.int64) for h, w, _ in texts])
    text = np.repeat(np.arange(len(texts)), [len(h) for h, *_ in texts])
    shingle = np.concatenate([h for h, *_ in texts])
    text, shingle = np.repeat(text, number), np.repeat(shingle, number)
    occurrence = A.grouped_ranges(np.zeros(len(number), np.int64), number).astype(np.uint64)
    feature, column = np.unique(A.mix(shingle + occurrence * A.MIX_1), return_inverse=True)
    weight = np.zeros(len(feature), np.float32)
    weight[column] = np.sqrt(idf[_cell(shingle)])
    held = np.bincount(column)
    # Features of one text alone are common to no pair.
    place = np.cumsum(held > 1) - 1
    shared = held[column] > 1
    text, column, at = text[shared], place[column[shared]], weight[column[shared]]
    common = np.zeros((len(texts), len(texts)), np.float32)
    order = np.argsort(column, kind="stable")
    text, column, at = text[order], column[order], at[order]
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, _COLUMNS):
        a, b = np.searchsorted(column, [lo, lo + _COLUMNS])
        block = np.zeros((len(texts), _COLUMNS), np.float32)
        block[text[a:b], column[a:b] - lo] = at[a:b]
        common += block @ block.T
    total = np.array([t for *_, t in texts])
    return common / (total[:, None] + total[None, :] - common)


def _local_links(idf: np.ndarray, threshold: float):
    """Links of a block: all pairs of different roots are looked at, those that join two classes returned."""

    def links(table: pa.Table) -> pa.Table:
        tids = table["tid"].to_pylist()
        texts = _weighted(table["text"].combine_chunks(), idf)
        likeness = _likeness_matrix(texts, idf)
        code = np.unique(np.array(table["root"].to_pylist(), object), return_inverse=True)[1]
        apart = code[:, None] != code[None, :]
        root = list(range(code.max() + 1))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        found: list[tuple[int, int, float]] = []
        # Products in single precision: pairs near the threshold are worked out once more.
        for i, j in zip(*np.nonzero(np.tril((likeness >= threshold - 1e-3) & apart, -1))):
            one, other = find(code[i]), find(code[j])
            if one != other and (exact := _likeness(texts[i], texts[j])) >= threshold:
                root[one] = other
                found.append((i, j, exact))
        return pa.table(
            {
                "a": pa.array([tids[i] for i, _, _ in found], pa.binary()),
                "b": pa.array([tids[j] for _, j, _ in found], pa.binary()),
                "likeness": pa.array([x for *_, x in found], pa.float64()),
            }
        )

    return links


def _blocks(members: DataFrame, links: DataFrame) -> DataFrame:
    """grp, i, j, tid, root: blocks in which all pairs of a group's texts that ``links`` don't join meet.

    The texts of a group's largest class are joined among themselves. They and the rest are
    dealt into parts of about LOCAL / 2 texts; each part of the rest meets every other part.
    """
    roots = connected_components(links).select(F.col("node").alias("tid"), "root")
    rooted = settle(members.join(roots, "tid", "left").withColumn("root", F.coalesce("root", "tid")), "rooted")
    held = rooted.groupBy("grp", "root").agg(F.count(F.lit(1)).alias("n"))
    groups = held.groupBy("grp").agg(
        F.sum("n").alias("n"), F.max("n").alias("most"), F.max_by("root", F.struct("n", "root")).alias("top")
    )
    side = max(LOCAL // 2, 1)
    whole = F.col("n") <= LOCAL
    parts = settle(
        groups.filter("most < n").select(
            "grp",
            "top",
            F.when(whole, 1).otherwise(F.ceil((F.col("n") - F.col("most")) / side)).cast("int").alias("rest"),
            F.when(whole, 0).otherwise(F.ceil(F.col("most") / side)).cast("int").alias("tops"),
        ),
        "parts",
    )
    drawn = F.xxhash64("tid", "grp")
    topmost = (F.col("root") == F.col("top")) & (F.col("tops") > 0)
    part = F.when(topmost, F.col("rest") + F.pmod(drawn, "tops")).otherwise(F.pmod(drawn, "rest")).cast("int")
    # A part of the largest class meets those of the rest only.
    last = F.when(topmost, F.col("rest")).otherwise(F.col("rest") + F.col("tops")) - 1
    other = F.explode(F.sequence(F.lit(0), last)).alias("other")
    met = rooted.join(parts, "grp").select("grp", "tid", "root", part.alias("part"), other, (F.col("rest") + F.col("tops")).alias("parts"))
    return met.filter("part != other or parts = 1").select(
        "grp", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "tid", "root"
    )


def text_ids(docs: DataFrame) -> DataFrame:
    """tid (md5 of the text, 16 bytes) and text of every row."""
    text = F.coalesce("text", F.lit(""))
    return in_small_batches(docs).select(F.unhex(F.md5(text)).alias("tid"), text.alias("text"))


def near_links(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """a, b, likeness: pairs of tids of different texts at least ``threshold`` alike, found by bands."""
    texts = text_ids(docs)
    idf = inverse_frequencies(texts)
    bands = settle(texts.mapInArrow(_band_rows(idf, threshold), "tid binary, band int, key long, size int"), "bands")
    # Least and greatest halves of the tids, as numbers: binary values would have every band row sorted.
    halves = [F.conv(F.hex(F.substring("tid", at, 8)), 16, -10).cast("long") for at in (1, 9)]
    ends = [end(half) for half in halves for end in (F.min, F.max)]
    least = bands.groupBy("band", "key").agg(*[e.alias(f"end{k}") for k, e in enumerate(ends)])
    shared = least.filter("end0 != end1 or end2 != end3")
    members = settle(
        bands.join(settle(shared.select("band", "key"), "shared"), ["band", "key"])
        .withColumn("size", F.explode(F.array("size", F.col("size") + 1)))
        .select(F.xxhash64("band", "key", "size").alias("grp"), "tid")
        .distinct(),
        "members",
    )
    needed = members.select("tid").distinct()
    known = settle(texts.groupBy("tid").agg(F.first("text").alias("text")).join(needed, "tid", "left_semi"), "texts")
    # Most groups are found by many bands: groups of the same texts count once.
    alike = members.groupBy("grp").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("tid").cast("decimal(38,0)")).alias("same")
    )
    sizes = settle(alike.filter("n > 1").groupBy("n", "same").agg(F.min("grp").alias("grp")).select("grp", "n"), "sizes")
    sized = settle(members.join(sizes, "grp"), "sized")
    met = settle(sized.groupBy("tid").agg(F.sum("n").alias("met")), "met")
    central = Window.partitionBy("grp").orderBy(F.desc("met"), "tid")
    leaders = settle(
        sized.join(met, "tid")
        .withColumn("k", F.row_number().over(central))
        .filter(F.col("k") <= LEADERS)
        .select("grp", F.col("tid").alias("leader")),
        "leaders",
    )
    rated = settle(
        sized.join(leaders, "grp")
        .filter("tid != leader")
        .select("tid", "leader")
        .distinct()
        .join(known, "tid")
        .join(known.select(F.col("tid").alias("leader"), F.col("text").alias("other")), "leader")
        .select("tid", "leader", "text", "other")
        .mapInArrow(_similarity_rows(idf), "tid binary, leader binary, likeness double"),
        "rated",
    )
    led = rated.filter(F.col("likeness") >= threshold).select(F.col("tid").alias("a"), F.col("leader").alias("b"), "likeness")
    # Where at most one text isn't a leader, all pairs have been compared.
    blocks = _blocks(sized.filter(F.col("n") > LEADERS + 1).select("grp", "tid"), led)
    local = (
        blocks.join(known, "tid")
        .groupBy("grp", "i", "j")
        .applyInArrow(_local_links(idf, threshold), "a binary, b binary, likeness double")
    )
    return union_sources([led, settle(local, "links")])


def near_classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """tid, class_id, first_tid: the class of every distinct text, known by its smallest doc_id.

    ``first_tid`` is the text of that document (the smallest tid, if several share the id).
    A class without any doc_id has none.
    """
    roots = connected_components(near_links(docs, threshold))
    keys = docs.select(F.col("doc_id"), F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("tid"))
    firsts = settle(keys.groupBy("tid").agg(F.min("doc_id").alias("first")), "firsts")
    rooted = settle(
        firsts.join(roots.withColumnRenamed("node", "tid"), "tid", "left").withColumn("root", F.coalesce("root", "tid")),
        "rooted",
    )
    least = F.min(F.struct(F.col("first").isNull().alias("none"), "first", "tid"))
    classes = settle(rooted.groupBy("root").agg(least.alias("m")).select("root", "m.first", "m.tid"), "classes")
    return settle(
        rooted.select("tid", "root").join(
            classes.select("root", F.col("first").alias("class_id"), F.col("tid").alias("first_tid")), "root"
        ).drop("root"),
        "classes",
    )


def near_dedup(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with class_id, the smallest doc_id of its class, and is_first.

    Equal texts share a class, as do texts linked by a weighted Jaccard similarity of
    ``threshold`` or more. Null and empty texts, and texts without a word, are classes of
    their own (class_id is their doc_id). Texts of fewer than five words are one shingle.
    One row of each class is_first; of equal rows with the smallest doc_id all are.
    Columns named like the two results are replaced.
    """
    plain = docs.drop("class_id", "is_first")
    classes = near_classes(docs, threshold)
    classes = classes.withColumnsRenamed({c: f"_near_{c}" for c in classes.columns})
    tid = F.unhex(F.md5(F.coalesce(plain["text"], F.lit(""))))
    joined = plain.withColumn("_near_of", tid).join(classes, F.col("_near_of") == F.col("_near_tid"))
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    first = F.col("doc_id").eqNullSafe(F.col("_near_class_id")) & (F.col("_near_of") == F.col("_near_first_tid"))
    return joined.select(
        *plain.columns,
        F.when(worded, F.col("_near_class_id")).otherwise(F.col("doc_id")).alias("class_id"),
        (~worded | first).alias("is_first"),
    )
