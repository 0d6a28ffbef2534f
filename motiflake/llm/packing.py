"""Best-fit packing of token pieces into sequences.

Documents become token ids and are cut only if longer than a sequence. A packer is bounded-space online best-fit: it keeps a
fixed number of open bins in a bitset keyed by free space (one bit for each amount of space that some open bin has). A
piece goes to the bin with the least space that holds it; if none does, a new bin opens, and if too many are open the
fullest closes first. Pieces are dealt to packers by hash and arrive in the order of another. A packer looks AHEAD pieces
ahead and takes those longest first: a bounded buffer, no sort of its whole input.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, read, share_code

CAPACITY, END = 1_024, 2
#: Bins that a packer keeps open at most; pieces that it sorts before it places them.
OPEN, AHEAD = 1_024, 4_096
#: Documents for each packer, about.
PACKER_DOCS = 20_000
#: Tasks that packers are dealt to, at most.
TASKS = 50_000
#: Characters that are tokenized before the pieces leave.
BATCH_CHARS = 4 << 20
#: White space as the vocabulary's pattern knows it. A longer run of it than LONG_RUN is encoded by itself: the pattern's
#: lookahead goes back over a run one symbol at a time, on a stack of its own.
_BLANK = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
LONG_RUN = 10_000
_LONG = re.compile(rf"(?<!{_BLANK}){_BLANK}{{{LONG_RUN},}}")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _same_as_ranks(model: dict) -> bool:
    """Whether byte ranks alone give the ids of the file's model: byte-level BPE without a normalizer whose merges are in
    the order of the ids that they make."""
    bpe, split = model["model"], model.get("pre_tokenizer") or {}
    plain = not model.get("normalizer") and bpe["type"] == "BPE" and not any(bpe.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback"))
    whole = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
    made = [bpe["vocab"].get("".join(m) if isinstance(m, list) else m.replace(" ", "", 1)) for m in bpe["merges"]]
    return plain and whole and None not in made and made == sorted(made)


@cache
def tokenizer(path: str):
    """text -> ids (uint32), the ids that the tokenizers library gives for the file at `path` without special tokens added.

    Ordinary text goes through tiktoken, built from the same file's vocabulary, which is four times as fast; texts that
    hold a special token's string go through tokenizers, which gives that token, and so does every text if the file's model
    is not one that ranks alone express. Runs of white space of any length are cut out where the pattern ends a match."""
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    special = [t["content"] for t in model.get("added_tokens", [])]
    slow = cache(lambda: Tokenizer.from_file(path))  # few texts need it, and it is large
    slowly = lambda text: np.array(slow().encode(text, add_special_tokens=False).ids, dtype=np.uint32)
    if not _same_as_ranks(model):
        return slowly
    # The vocabulary writes a byte as a character: printable ones as themselves, the others from code point 256 on.
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(c): c for c in shown} | {chr(256 + i): c for i, c in enumerate(c for c in range(256) if c not in set(shown))}
    ranks = {bytes(byte[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}
    fast = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    one = tiktoken.Encoding("packing-run", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})  # a text as one match

    def encode(text: str) -> np.ndarray:
        if any(s in text for s in special):
            return slowly(text)
        parts, at = [], 0
        for run in _LONG.finditer(text) if len(text) >= LONG_RUN else ():
            # A match of the pattern takes a run but for its last symbol, which may lead what follows.
            end = run.end() - (run.end() < len(text))
            parts += [np.array(fast.encode_ordinary(text[at : run.start()]), dtype=np.uint32), np.array(one.encode_ordinary(text[run.start() : end]), dtype=np.uint32)]
            at = end
        rest = np.array(fast.encode_ordinary(text[at:] if at else text), dtype=np.uint32)
        return np.concatenate([*parts, rest]) if parts else rest

    return encode


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: one if it fits; else full ones after a first that may be shorter."""
    first = n % capacity or capacity
    return [(0, min(n, first)), *((s, capacity) for s in range(first, n, capacity))]


def _tokens(path: str, capacity: int):
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows, strict=True), kinds, strict=True)], [n for n, _ in kinds])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, rows, held = tokenizer(path), [], 0
        for b in batches:
            for i, t in zip(b.column(0), b.column(1), strict=True):
                doc, text = i.as_py(), t.as_py() or ""
                ids = np.append(encode(text), np.uint32(END)).astype("<u4")
                rows += [(doc, k, s, n, ids[s : s + n].tobytes()) for k, (s, n) in enumerate(cut(len(ids), capacity))]
                held += len(text)
                if held >= BATCH_CHARS:
                    yield batch(rows)
                    rows, held = [], 0
        if rows:
            yield batch(rows)

    return run


def pieces(spark: SparkSession, docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length and ids (little-endian 32-bit) of every piece of every row of `docs` (doc_id, text).
    A null text is empty: one piece, the end token. Texts of any length are encoded whole; rows that repeat give their
    pieces each; an empty table gives none; other columns are left out."""
    share_code(spark)
    path = vocabulary or default_vocabulary()
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(_tokens(path, capacity)), "doc_id long, piece int, start long, length long, ids binary")


class Packer:
    """Bounded-space online best-fit."""

    def __init__(self, capacity: int = CAPACITY, open_bins: int = OPEN):
        self.capacity, self.limit, self.open, self.made, self.closed = capacity, open_bins, 0, 0, 0
        self.bits = 0  # bit s: some open bin has s tokens of space
        self.by_space: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, n: int) -> tuple[int, int]:
        """The bin and the offset of a piece of `n` tokens."""
        fits = self.bits >> n
        if fits:
            space = n + (fits & -fits).bit_length() - 1
            bin_ = self._take(space)
        else:
            if self.open >= self.limit:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
                self.closed += 1
            space, bin_ = self.capacity, self.made
            self.made += 1
        if space > n:
            self.by_space[space - n].append(bin_)
            self.bits |= 1 << (space - n)
            self.open += 1
        return bin_, self.capacity - space

    def _take(self, space: int) -> int:
        bins = self.by_space[space]
        bin_ = bins.pop()
        if not bins:
            self.bits &= ~(1 << space)
        self.open -= 1
        return bin_


def _packed(capacity: int, open_bins: int, ahead: int):
    """Rows (packer, length, others ...) in order of packer: the others, with their place."""

    def placed(packer: Packer, number: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        (b,) = pa.Table.from_batches(held).combine_chunks().to_batches()
        lengths = b.column(1).to_numpy()
        sequences, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
        for i in np.argsort(-lengths, kind="stable").tolist():
            bin_, offsets[i] = packer.add(int(lengths[i]))
            sequences[i] = (number << 40) + bin_
        return pa.RecordBatch.from_arrays([*b.columns[2:], pa.array(sequences), pa.array(offsets)], [*b.schema.names[2:], "sequence_id", "offset"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, packer, held, count = None, None, [], 0
        for b in batches:
            numbers, at = b.column(0).to_numpy(), 0
            while at < len(numbers):
                if held and (count == ahead or numbers[at] != now):
                    yield placed(packer, now, held)
                    held, count = [], 0
                if numbers[at] != now:
                    now, packer = int(numbers[at]), Packer(capacity, open_bins)
                others = np.flatnonzero(numbers[at : at + ahead - count] != now)
                n = int(others[0]) if len(others) else min(ahead - count, len(numbers) - at)
                held.append(b.slice(at, n))
                at, count = at + n, count + n
        if held:
            yield placed(packer, now, held)

    return run


def packed(spark: SparkSession, parts: DataFrame, packers: int, capacity: int = CAPACITY, open_bins: int = OPEN, ahead: int = AHEAD) -> DataFrame:
    """The rows of `parts` (doc_id, piece, length <= capacity, ids or ids_crc32, and any others) with sequence_id and offset.

    Pieces go to packers by a hash of doc_id, piece, checksum and the partition that they come from, so rows that share an
    id, or repeat whole, spread too; packers go to tasks by number, as many to each. A packer's pieces arrive in the order
    of another hash. The same files read in the same splits give the same result; rows that repeat whole may trade
    places. An empty table gives none."""
    share_code(spark)
    crc = F.col("ids_crc32") if "ids_crc32" in parts.columns else F.crc32("ids")
    by = [F.col("doc_id"), F.col("piece"), crc]
    dealt = parts.withColumns({"__packer": F.pmod(F.xxhash64(*by, F.spark_partition_id()), F.lit(packers)), "__mix": F.xxhash64(*by, F.lit(3))})
    tasks = min(packers, TASKS)
    dealt = dealt.repartitionById(tasks, (F.col("__packer") % tasks).cast("int")).sortWithinPartitions("__packer", "__mix", "doc_id", "piece")
    out = ", ".join(f"{n} {t}" for n, t in parts.dtypes) + ", sequence_id long, offset long"
    return dealt.select("__packer", F.col("length").alias("__n"), *parts.columns).mapInArrow(lean(_packed(capacity, open_bins, ahead)), out)


def _packers(docs: DataFrame) -> int:
    return max(1, round(docs.count() / PACKER_DOCS))


def pack(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Every piece of `docs` (doc_id, text) in its place: doc_id, piece, start, length, ids (little-endian 32-bit),
    sequence_id, offset. Other columns are left out; nulls, long texts, repeats and empty tables as pieces() and packed()
    have them."""
    docs = docs.select("doc_id", "text")
    return packed(spark, pieces(spark, docs), _packers(docs))


def sequences(placed: DataFrame) -> DataFrame:
    """sequence_id, n_docs (pieces) and ids (little-endian 32-bit) of every sequence of pack(): what a trainer reads.

    A sequence has at most as many pieces as tokens, so a group is bounded."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    found = placed.groupBy("sequence_id").agg(parts.alias("parts"))
    ids = F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    return found.select("sequence_id", F.size("parts").alias("n_docs"), ids.alias("ids"))


def digest(found: DataFrame) -> DataFrame:
    """`found`, pieces placed or not, with ids_crc32 for ids."""
    return found.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), *[c for c in ("sequence_id", "offset") if c in found.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: every piece of every document in its sequence. Only the ids' checksum goes through the exchange."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    return packed(spark, digest(pieces(spark, docs)), _packers(docs))
