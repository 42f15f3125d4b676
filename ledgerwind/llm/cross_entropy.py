"""Cross-entropy difference: matched target and background bigram models over one vocabulary of token ids.

Both models count the same events: tokens of a public tokenizer, a start and an end mark, and pairs of neighbours. Every
token of every document is counted, and every distinct pair has a count of its own, in a Spark table that grows with the
corpus; only the counts of single tokens, which the vocabulary bounds, are broadcast. With the same smoothing,

    p(w | v) = (c(v, w) + WEIGHT * p(w)) / (c(v) + WEIGHT),   p(w) = (c(w) + 1/2) / (n + V/2),

a document's score is the mean over its tokens of -log2 p_target + log2 p_background: the lower, the more it is like the
target. The background is the whole corpus, the target included. The models are matched in all but their texts: in vocabulary,
events and smoothing, and no model scores a document that it was made of. A document's own counts are taken out of the
background and, if it is of the target, out of the target model before it is scored; so a target document is judged by the
other target documents, and one that occurs twice still meets its copy.

Documents are scored in blocks of about BLOCK tokens. A block sends each of its distinct pairs once, with the block's
counts, and gets the corpus's counts of these pairs back; so a common pair has one row a block, however often it occurs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerwind.llm.shared import text_bytes, written
from ledgerwind.llm.word_tokens import encoder, slices

#: BLOCK: tokens at which a block of documents is closed; no document is divided.
BLOCK, WEIGHT = 1 << 20, 4.0
#: Target documents' ids up to which they are broadcast (8 bytes each); beyond, they are joined by shuffle.
BROADCAST_IDS = 1_000_000


@dataclass
class Counts:
    """Of one model: each token, and each token as a context."""

    tokens: np.ndarray
    contexts: np.ndarray


def vocabulary(tokenizer: str) -> int:
    """Number of tokens with the start and the end mark, which are the last two."""
    return encoder(tokenizer).tokenizer.get_vocab_size() + 2


def slots(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """The number of each pair of tokens, which no other pair has."""
    return before.astype(np.int64) << 32 | after.astype(np.int64)


def transitions(ids: list[bytes], kind: str, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens before and after each step of all texts, end to end, and where each text begins."""
    arrays = [np.frombuffer(x, kind) for x in ids]
    starts = np.cumsum([0, *(len(x) + 1 for x in arrays)])
    after = np.empty(starts[-1], np.int64)
    for at, x in zip(starts, arrays, strict=False):
        after[at : at + len(x)] = x
    after[starts[1:] - 1] = size - 1
    before = np.concatenate([[0], after[:-1]])
    before[starts[:-1]] = size - 2
    return before, after, starts[:-1]


def _tokens(tokenizer: str, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, block, held = encoder(tokenizer), TaskContext.get().partitionId() << 32, 0
        for batch in slices(batches):
            ids, blocks = [enc.encode(x.as_py()) for x in batch.column("text")], []
            for x in ids:
                if held >= most:
                    block, held = block + 1, 0
                held += len(x) // enc.dtype.itemsize + 1
                blocks.append(block)
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), batch.column("doc_id"), batch.column("target"), pa.array(ids, pa.binary())], ["block", "doc_id", "target", "ids"])

    return run


def _counted(kind: str, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(block, pair, target, whole): how often each pair occurs in target documents and in all of a block, or of a part of it."""

        def done(block: int, ids: list[bytes], own: list[bytes]) -> Iterator[pa.RecordBatch]:
            pairs, whole = np.unique(slots(*transitions(ids, kind, size)[:2]), return_counts=True)
            target = np.zeros(len(pairs), np.int64)
            if own:
                some, n = np.unique(slots(*transitions(own, kind, size)[:2]), return_counts=True)
                target[np.searchsorted(pairs, some)] = n
            for at in range(0, len(pairs), 100_000):
                part = slice(at, at + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pairs[part]), block)), pa.array(pairs[part]), pa.array(target[part]), pa.array(whole[part])], ["block", "pair", "target", "whole"])

        now, ids, own = None, [], []
        for batch in slices(batches):
            for block, target, x in zip(batch.column("block").to_pylist(), batch.column("target").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if block != now and ids:
                    yield from done(now, ids, own)
                    ids, own = [], []
                now = block
                ids.append(x)
                if target:
                    own.append(x)
        if ids:
            yield from done(now, ids, own)

    return run


def single_counts(pairs: DataFrame, size: int) -> tuple[Counts, Counts]:
    """Target and background counts of single tokens, from those of pairs; at most 4 * size numbers come to the driver."""
    sides = {"contexts": F.shiftright("pair", 32), "tokens": F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))}
    sums = [pairs.groupBy(F.lit(name).alias("side"), of.alias("token")).agg(F.sum("target").alias("target"), F.sum("whole").alias("whole")) for name, of in sides.items()]
    found, out = sums[0].unionByName(sums[1]).toPandas(), []
    for model in ("target", "whole"):
        counts = Counts(np.zeros(size), np.zeros(size))
        for name in sides:
            part = found[found["side"] == name]
            getattr(counts, name)[part["token"].to_numpy(np.int64)] = part[model].to_numpy(np.float64)
        out.append(counts)
    return out[0], out[1]


@dataclass
class Steps:
    """The steps of a block of documents: tokens before and after, and how often their document has the pair and either one.

    rank orders the steps' pairs by number, so that sorted by document and rank all steps with an equal pair, and all with an
    equal token before, are neighbours. A token comes after a step as often as before one, but for the end mark.
    """

    before: np.ndarray
    after: np.ndarray
    rank: np.ndarray
    lengths: np.ndarray

    def __post_init__(self) -> None:
        self.document = np.repeat(np.arange(len(self.lengths)), self.lengths)
        key = self.document << 40 | self.rank
        order = np.argsort(key)

        def counts(of: np.ndarray) -> np.ndarray:
            first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            n, out = np.diff([*first, len(of)]), np.empty(len(of))
            out[order] = np.repeat(n, n)
            return out

        self.own_pair, self.own_before = counts(key[order]), counts(self.document[order] << 32 | self.before[order])
        self.own_after = np.append(self.own_before[1:], 1.0)
        self.own_after[np.cumsum(self.lengths) - 1] = 1.0


def losses(model: Counts, steps: Steps, counts: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Bits of each step's second token after its first, where counts are the steps' pairs' own; inside: documents that the model holds."""
    held = inside[steps.document]
    single = (model.tokens[steps.after] - held * steps.own_after + 0.5) / (model.tokens.sum() - held * steps.lengths[steps.document] + 0.5 * len(model.tokens))
    return -np.log2((counts - held * steps.own_pair + WEIGHT * single) / (model.contexts[steps.before] - held * steps.own_before + WEIGHT))


def score(docs: DataFrame, target_ids: DataFrame, tokenizer: str, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_tokens, target_loss, background_loss, score) for each row of docs (doc_id, text).

    target_ids (doc_id) names the documents of the target; repeated or unknown ids and nulls change nothing. Losses are
    mean bits a token, the end mark included (n_tokens counts it), so null and empty texts have one token; each row is left
    out of the models that score it. Without (other) target rows the target model is its smoothing alone. Repeated rows count and return each; a null doc_id is never of
    the target; other columns are ignored; an empty table gives none.
    """
    spark, kind, size = docs.sparkSession, encoder(tokenizer).dtype.str, vocabulary(tokenizer)
    wanted = written(target_ids.select(F.col("doc_id").cast("long").alias("_id")).filter("_id is not null").distinct(), "target-ids")
    if wanted.count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    mine: Column = F.col("_id").isNotNull().alias("target")
    rows = docs.select(F.col("doc_id").cast("long"), text_bytes()).join(wanted, F.col("doc_id") == F.col("_id"), "left").select("doc_id", mine, "text")
    tokens = written(rows.mapInArrow(_tokens(tokenizer, block), "block long, doc_id long, target boolean, ids binary"), "lm-tokens")
    parts = written(tokens.mapInArrow(_counted(kind, size), "block long, pair long, target long, whole long"), "lm-pairs")
    counts = written(parts.groupBy("pair").agg(F.sum("target").alias("target"), F.sum("whole").alias("whole")), "lm-counts")
    shared = spark.sparkContext.broadcast(single_counts(counts, size))  # of single tokens only

    def run(own: pa.Table, known: pa.Table) -> pa.Table:
        target, background = shared.value
        before, after, starts = transitions(own.column("ids").to_pylist(), kind, size)
        pairs = known.column("pair").to_numpy()
        order, lengths = np.argsort(pairs), np.diff([*starts, len(after)])
        rank = np.searchsorted(pairs, slots(before, after), sorter=order)
        at, steps = order[rank], Steps(before, after, rank, lengths)
        mine = own.column("target").to_numpy().astype(bool)
        parts = ((target, "target", mine), (background, "whole", np.ones(len(mine), bool)))
        one, two = (np.add.reduceat(losses(m, steps, known.column(c).to_numpy()[at], inside), starts) / lengths for m, c, inside in parts)
        return pa.Table.from_arrays([own.column("doc_id"), pa.array(lengths), pa.array(one), pa.array(two), pa.array(one - two)], NAMES)

    known = parts.select("block", "pair").join(counts, "pair")
    texts = tokens.select("block", "doc_id", "target", "ids").groupBy("block")
    return texts.cogroup(known.groupBy("block")).applyInArrow(run, "doc_id long, n_tokens long, target_loss double, background_loss double, score double")


NAMES = ["doc_id", "n_tokens", "target_loss", "background_loss", "score"]
