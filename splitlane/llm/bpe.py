"""Byte-level BPE: encoding by a pair occurrence index, and decoding.

Texts are cut into pieces by the vocabulary's pattern; the distinct pieces of a batch are
merged together: an index maps each pair's rank to all places where the pair stands, the
active ranks are applied in ascending order, and each merge updates the lists of the pairs
it makes. A merge only makes pairs of higher ranks, so one pass over the ranks is enough.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from splitlane.llm import arrays as A

# Fixed value: the published pattern of this family of vocabularies, with white space spelled out.
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
BATCH_BYTES = 8 << 20


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in the vocabulary's files."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [letters[b] for b in range(256)]


class Vocabulary:
    """The tables of a byte-level BPE tokenizer file, given its content."""

    def __init__(self, content: str) -> None:
        self.content = content
        parsed = json.loads(content)
        vocab, pairs = parsed["model"]["vocab"], parsed["model"]["merges"]
        letters = _byte_letters()
        self.specials: dict[str, int] = {t["content"]: t["id"] for t in parsed["added_tokens"]}
        self.byte_ids = np.array([vocab[c] for c in letters], np.int64)
        split = [tuple(p.split(" ")) if isinstance(p, str) else tuple(p) for p in pairs]
        keys = np.array([(vocab[a] << 32) | vocab[b] for a, b in split], np.int64)
        order = np.argsort(keys, kind="stable")
        #: Sorted pair keys with their ranks, and the id that each rank makes.
        self.merges = keys[order], order, np.array([vocab[a + b] for a, b in split], np.int64)
        of = {c: b for b, c in enumerate(letters)}
        self.token_table = [b""] * (max([*vocab.values(), *self.specials.values()]) + 1)
        for token, i in vocab.items():
            self.token_table[i] = bytes(of[c] for c in token)
        for token, i in self.specials.items():
            self.token_table[i] = token.encode()
        self.pieces = regex.compile(PATTERN)
        longest_first = sorted(self.specials, key=len, reverse=True)
        self.special_pattern = regex.compile("|".join(map(regex.escape, longest_first))) if longest_first else None


def load_vocabulary(path: str) -> Vocabulary:
    """Read on the driver; the file's content is sent to the tasks, its size doesn't grow with the data."""
    with open(path, encoding="utf-8") as f:
        return Vocabulary(f.read())


def _ranks(vocabulary: Vocabulary, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Rank of each pair; -1 where there is none."""
    keys, order, _ = vocabulary.merges
    pair = (left << 32) | right
    at = np.minimum(np.searchsorted(keys, pair), len(keys) - 1)
    return np.where(keys[at] == pair, order[at], -1)


def merge_pieces(vocabulary: Vocabulary, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all pieces, one after the other, and where each piece's ids begin."""
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    total = int(sizes.sum())
    raw = np.frombuffer(b"".join(pieces), np.uint8)
    first = np.cumsum(sizes) - sizes
    # Places are numbered from 1, so that 0 and total + 1 stand for "none".
    symbol = np.full(total + 2, -1, np.int64)
    symbol[1:-1] = vocabulary.byte_ids[raw]
    after, before = np.arange(1, total + 3), np.arange(-1, total + 1)
    live = np.ones(total + 2, bool)
    fence = np.zeros(total + 2, bool)  # the piece begins here
    fence[first[sizes > 0] + 1] = True
    fence[-1] = True
    made = vocabulary.merges[2]
    index: dict[int, list[np.ndarray]] = {}
    active: list[int] = []

    def note(places: np.ndarray) -> None:
        """Enter the pairs that start at ``places`` into the index."""
        nxt = after[places]
        places = places[~fence[nxt]]
        if not len(places):
            return
        rank = _ranks(vocabulary, symbol[places], symbol[after[places]])
        known = rank >= 0
        rank, places = rank[known], places[known]
        by = np.argsort(rank, kind="stable")
        rank, places = rank[by], places[by]
        cuts = np.flatnonzero(np.diff(rank)) + 1
        for r, group in zip(rank[np.concatenate([[0], cuts])] if len(rank) else (), np.split(places, cuts)):
            r = int(r)
            if r not in index:
                index[r] = []
                heapq.heappush(active, r)
            index[r].append(group)

    note(np.arange(1, total + 1))
    keys, order, _ = vocabulary.merges
    pair_of = np.empty(len(keys), np.int64)
    pair_of[order] = keys
    while active:
        rank = heapq.heappop(active)
        lists = index.pop(rank)
        places = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
        left, right = int(pair_of[rank]) >> 32, int(pair_of[rank]) & 0xFFFFFFFF
        nxt = after[places]
        places = places[live[places] & (symbol[places] == left) & (symbol[nxt] == right) & ~fence[nxt]]
        if left == right and len(places) > 1:
            # In a run of equal symbols every second pair is merged, from its left end.
            places = np.sort(places)
            follows = np.concatenate([[False], after[places[:-1]] == places[1:]])
            place_in_run = np.arange(len(places)) - np.maximum.accumulate(np.where(follows, 0, np.arange(len(places))))
            places = places[place_in_run % 2 == 0]
        if not len(places):
            continue
        nxt = after[places]
        symbol[places] = made[rank]
        live[nxt] = False
        after[places] = after[nxt]
        before[after[places]] = places
        inner = places[~fence[places]]
        # A neighbour on the left may itself have just been merged: then it is among the places.
        note(np.union1d(before[inner], places) if len(inner) else places)
    kept = np.flatnonzero(live[1:-1])
    return symbol[1:-1][kept], np.searchsorted(kept, np.append(first, total))


class _Numbering(dict):
    """Numbers keys in the order in which they are first asked for."""

    def __missing__(self, key: str) -> int:
        self[key] = number = len(self)
        return number


def encode_texts(vocabulary: Vocabulary, texts: list[str]) -> list[np.ndarray]:
    """The ids of each text as unsigned 32-bit numbers."""
    number = _Numbering()
    of = number.__getitem__
    specials, cut = vocabulary.specials, vocabulary.special_pattern
    rows: list[np.ndarray] = []
    find = vocabulary.pieces.findall
    for text in texts:
        if cut is not None and any(s in text for s in specials):
            parts: list[int] = []
            at = 0
            for m in cut.finditer(text):
                parts += map(of, find(text[at : m.start()]))
                parts.append(-1 - specials[m.group()])
                at = m.end()
            parts += map(of, find(text[at:]))
        else:
            parts = list(map(of, find(text)))
        rows.append(np.array(parts, np.int64))
    ids, begins = merge_pieces(vocabulary, [p.encode() for p in number]) if number else (np.zeros(0, np.int64), np.zeros(1, np.int64))
    ids = ids.astype("<u4")
    size = np.diff(begins)
    out = []
    for parts in rows:
        special = parts < 0
        if special.any():
            out.append(
                np.concatenate(
                    [np.array([-1 - p], "<u4") if p < 0 else ids[begins[p] : begins[p + 1]] for p in parts]
                )
            )
            continue
        n = size[parts]
        before = np.cumsum(n) - n
        out.append(ids[np.arange(int(n.sum())) + np.repeat(begins[parts] - before, n)])
    return out


def _vocabulary(sent) -> Vocabulary:
    content = sent.value
    return A.remembered(("vocabulary", content), lambda: Vocabulary(content))


def decode_ids(vocabulary: Vocabulary, ids: np.ndarray) -> str:
    """The text of token ids; bytes that aren't UTF-8 become U+FFFD."""
    return b"".join(map(vocabulary.token_table.__getitem__, ids.tolist())).decode("utf-8", "replace")


def bpe_decode(ids: Column, vocabulary: Vocabulary) -> Column:
    """The text of a binary column of ids as bpe_roundtrip() gives them; null stays null."""
    sent = SparkSession.active().sparkContext.broadcast(vocabulary.content)

    @F.arrow_udf(T.StringType())
    def decode(column: pa.Array) -> pa.Array:
        known = _vocabulary(sent)
        rows = column.to_pylist()
        return pa.array([None if x is None else decode_ids(known, np.frombuffer(x, "<u4")) for x in rows], pa.string())

    return decode(ids)


def _gathered(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    """Small batches put together to about BATCH_BYTES of text, as pieces are merged once per batch."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.column(text).nbytes for b in held) >= BATCH_BYTES:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def bpe_roundtrip(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``docs`` with ``ids`` (little-endian unsigned 32-bit numbers), ``n_tokens`` and ``decoded``.

    Null and empty texts have no ids. A text may be of any length, but is encoded in one
    piece. Strings of special tokens in a text become those tokens. Rows are treated one
    by one, so repeated rows and ties make no difference. Columns named like the results
    are replaced.
    """
    plain = docs.drop("ids", "n_tokens", "decoded")
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary.content)
    at = plain.columns.index("text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _vocabulary(sent)
        for batch in A.slices(_gathered(batches, at), "text", BATCH_BYTES):
            ids = encode_texts(known, batch.column(at).fill_null("").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    pa.array([x.tobytes() for x in ids], pa.binary()),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([decode_ids(known, x) for x in ids], pa.string()),
                ],
                [*batch.schema.names, "ids", "n_tokens", "decoded"],
            )

    results = [("ids", T.BinaryType()), ("n_tokens", T.LongType()), ("decoded", T.StringType())]
    return plain.mapInArrow(rows, T.StructType(plain.schema.fields + [T.StructField(*r) for r in results]))
