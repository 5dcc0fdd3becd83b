"""LM scoring with a hidden Markov model, trained by Baum-Welch over all partitions.

Tokens are words (runs of other than white space, A-Z lower-cased) and one end a text. The base model is
add-one unigrams over the training tokens. The hidden Markov model has STATES states; each emits the TOP
most frequent training tokens with probabilities of its own, and every other word, seen or not, through one of RARE
classes, by its hash; the words of a class divide its mass as the base model does. So every text has an
exact likelihood, all words of all languages teach the states, and what is broadcast has a size fixed by
STATES, TOP and RARE alone.

1. Texts are packed in blocks of BLOCK bytes: distinct words once, tokens as numbers of them.
2. Distinct words of blocks are counted over the corpus by joins; nothing that grows with the corpus is
   broadcast. Each block gets back its words' counts and becomes a row of symbols.
3. Each Baum-Welch round runs forward and backward on sequences of CUT tokens of all training texts
   side by side, adds expected counts within each task, and sums them across tasks. Every training token is
   in a sequence, but one step in CUT between tokens counts as a start; scoring cuts nothing.
4. Scoring runs the scaled forward recursion along each whole text.

Defined cases: null, empty and blank texts are their end alone; ids are hashed as text, and a null id is
learned from; repeated rows count and are scored each; ties among frequent words go by the word; with no
training text every base probability is 1/1 and the score equals the base score; an empty table gives an
empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from warpline.llm.common import buffers, materialise, partitions, release, remove, small_batches, table

STATES, TOP, RARE, ROUNDS, CUT, BLOCK, LANES = 8, 16_384, 4096, 4, 256, 8 << 20, 2048
TASK_BLOCKS = 8  # blocks whose words one task puts together
PRIOR, STAY = 100.0, 0.95


def held_out(id_col: str = "doc_id", folds: int = 7, fold: int = 2) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == fold, F.lit(False))


BLOCKS = pa.schema([("blk", pa.int64()), ("docs", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("held", pa.list_(pa.bool_())), ("tokens", pa.binary()), ("words", pa.binary()), ("counts", pa.binary())])


def blocks(docs: DataFrame, held: Column, id_col: str, text_col: str) -> DataFrame:
    """Texts packed with their own dictionary; word 0 of each block is the end, written as an empty string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        press = zstandard.ZstdCompressor(level=1)
        part, number = TaskContext.get().partitionId(), 0
        index: dict[bytes, int] = {b"": 0}
        ids: list[list[int]] = []
        meta: list[tuple[int | None, bool]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal index, ids, meta, size, number
            flat = np.concatenate([np.array(x, np.int32) for x in ids])
            sizes = np.array([len(x) for x in ids], np.int32)
            train = np.repeat(~np.array([m[1] for m in meta]), sizes)
            counts = np.bincount(flat[train], minlength=len(index)).astype(np.int64)
            row = {"blk": [part << 32 | number], "docs": [[m[0] for m in meta]], "sizes": [sizes], "held": [[m[1] for m in meta]], "tokens": [press.compress(flat.tobytes())], "words": [press.compress(b"\n".join(index))], "counts": [press.compress(counts.tobytes())]}
            index, ids, meta, size, number = {b"": 0}, [], [], 0, number + 1
            return table(row, BLOCKS)

        for b in batches:
            raw, off = buffers(b.column(1))
            data = raw.tobytes().lower()
            for doc, out, s, e in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), off[:-1].tolist(), off[1:].tolist(), strict=True):
                setdefault = index.setdefault
                got = [setdefault(w, len(index)) for w in data[s:e].split()]
                got.append(0)
                ids.append(got)
                meta.append((doc, out))
                size += e - s
                if size >= BLOCK:
                    yield flush()
        if ids:
            yield flush()

    small_batches(docs.sparkSession)
    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"), held.alias("held"))
    return own.mapInArrow(run, "blk long, docs array<long>, sizes array<int>, held array<boolean>, tokens binary, words binary, counts binary")


def block_words(packed: DataFrame) -> DataFrame:
    """blk, local (number of the word in its block), word, n (training tokens in the block)."""
    schema = pa.schema([("blk", pa.int64()), ("local", pa.int32()), ("word", pa.binary()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor()
        for b in batches:
            for blk, words, counts in zip(*(c.to_pylist() for c in b.columns), strict=True):
                w = open_.decompress(words).split(b"\n")
                n = np.frombuffer(open_.decompress(counts), np.int64)
                for s in range(0, len(w), 50_000):
                    part = w[s : s + 50_000]
                    yield table({"blk": np.full(len(part), blk), "local": np.arange(s, s + len(part), dtype=np.int32), "word": part, "n": n[s : s + len(part)]}, schema)

    return packed.select("blk", "words", "counts").mapInArrow(run, "blk long, local int, word binary, n long")


@dataclass
class Model:
    start: np.ndarray  # states
    move: np.ndarray  # states by states
    emit: np.ndarray  # symbols by states; the classes of all other words come last


def first_model(words: list[bytes], base: np.ndarray, rest: np.ndarray | float) -> Model:
    """States start out leaning to words by the hash of their first two bytes, and to classes in turn, and tend to stay."""
    lean = np.array([xxhash.xxh3_64_intdigest(w[:2]) % STATES for w in words], np.int64)
    share = np.full((len(words) + np.size(rest), STATES), 1.0)
    share[np.arange(len(words)), lean] = 3.0
    if np.size(rest) > 1:
        others = np.arange(np.size(rest))
        share[len(words) + others, others % STATES] = 3.0
    emit = share * np.append(base, rest)[:, None]
    move = np.full((STATES, STATES), (1 - STAY) / (STATES - 1)) + np.eye(STATES) * (STAY - (1 - STAY) / (STATES - 1))
    return Model(np.full(STATES, 1 / STATES), move, emit / emit.sum(axis=0))


def expected(model: Model, seqs: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected (emissions, moves, starts) of sequences laid end to end, run side by side."""
    k = len(model.start)
    emit, moves, starts = np.zeros(model.emit.shape), np.zeros((k, k)), np.zeros(k)
    offsets = np.cumsum(sizes) - sizes
    order = np.argsort(-sizes, kind="stable")
    move = model.move.astype(np.float32)
    table_ = model.emit.astype(np.float32)
    for s in range(0, len(order), LANES):
        lanes = order[s : s + LANES]
        size, off = sizes[lanes], offsets[lanes]
        steps = int(size[0])
        live = np.searchsorted(-size, -np.arange(steps), "left")  # sequences longer than each step
        alpha = np.zeros((steps, len(lanes), k), np.float32)
        b = np.zeros_like(alpha)
        scale = np.ones((steps, len(lanes)), np.float32)
        symbol = np.zeros((steps, len(lanes)), np.int64)
        for t in range(steps):
            n = live[t]
            symbol[t, :n] = seqs[off[:n] + t]
            b[t, :n] = table_[symbol[t, :n]]
            a = (alpha[t - 1, :n] @ move if t else np.broadcast_to(model.start.astype(np.float32), (n, k))) * b[t, :n]
            scale[t, :n] = a.sum(axis=1)
            alpha[t, :n] = a / scale[t, :n, None]
        beta = np.ones((len(lanes), k), np.float32)
        gamma = alpha  # filled from the end: alpha is not needed after its step
        for t in range(steps - 1, -1, -1):
            n = live[t]
            if t + 1 < steps and live[t + 1]:
                m = live[t + 1]
                ahead = b[t + 1, :m] * beta[:m] / scale[t + 1, :m, None]
                moves += (alpha[t, :m].T @ ahead).astype(np.float64) * model.move
                beta[:m] = ahead @ move.T
            gamma[t, :n] = alpha[t, :n] * beta[:n]
        starts += gamma[0].sum(axis=0)
        used = np.arange(len(lanes))[None, :] < live[:, None]
        flat, g = symbol[used], gamma[used]
        for j in range(k):
            emit[:, j] += np.bincount(flat, weights=g[:, j], minlength=len(emit))
    return emit, moves, starts


def likelihoods(model: Model, seqs: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """log10 likelihood of each whole sequence by the scaled forward recursion."""
    out = np.zeros(len(sizes))
    offsets = np.cumsum(sizes) - sizes
    order = np.argsort(-sizes, kind="stable")
    size, off = sizes[order], offsets[order]
    a = None
    logs = np.zeros(len(order))
    for t in range(int(size[0]) if len(size) else 0):
        n = int(np.searchsorted(-size, -t, "left"))
        b = model.emit[seqs[off[:n] + t]]
        a = (a[:n] @ model.move if t else np.broadcast_to(model.start, (n, len(model.start)))) * b
        c = a.sum(axis=1)
        a /= c[:, None]
        logs[:n] += np.log10(c)
    out[order] = logs
    return out


CODED = pa.schema([("docs", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("held", pa.list_(pa.bool_())), ("symbols", pa.binary()), ("known", pa.list_(pa.int64())), ("base", pa.list_(pa.float64())), ("inside", pa.list_(pa.float64()))])
CODED_DDL = "docs array<long>, sizes array<int>, held array<boolean>, symbols binary, known array<long>, base array<double>, inside array<double>"


def code(packed: DataFrame, columns: DataFrame, total: int, distinct: int, tops: int, rest: np.ndarray) -> DataFrame:
    """Blocks with tokens as symbols, and each text's base score and the part of it within the classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press, open_ = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
        for b in batches:
            for r in b.to_pylist():
                tokens = np.frombuffer(open_.decompress(r["tokens"]), np.int32)
                count, symbol = np.frombuffer(r["c"], np.int64), np.frombuffer(r["s"], np.uint16)
                sizes = np.array(r["sizes"], np.int64)
                starts = np.cumsum(sizes) - sizes
                log = np.log10((count + 1) / (total + distinct + 1))
                within = np.where(symbol >= tops, log - np.log10(rest[np.maximum(symbol.astype(np.int64) - tops, 0)]), 0.0)
                add = np.add.reduceat
                row = {"docs": [r["docs"]], "sizes": [r["sizes"]], "held": [r["held"]], "symbols": [press.compress(symbol[tokens].tobytes())], "known": [add((count > 0)[tokens].astype(np.int64), starts)], "base": [add(log[tokens], starts)], "inside": [add(within[tokens], starts)]}
                yield table(row, CODED)

    return packed.select("blk", "docs", "sizes", "held", "tokens").join(columns, "blk").mapInArrow(run, CODED_DDL)


def rare_class(word: Column, classes: int) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(classes)).cast("int")


def _columns(counted: DataFrame, tops: int, classes: int, n_blocks: int) -> DataFrame:
    """blk, c (counts of the block's words in their order), s (their symbols), as binaries."""
    schema = pa.schema([("blk", pa.int64()), ("c", pa.binary()), ("s", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        now = None

        def done() -> pa.RecordBatch:
            return table({"blk": [now], "c": [np.concatenate([h[0] for h in held]).tobytes()], "s": [np.concatenate([h[1] for h in held]).tobytes()]}, schema)

        for b in batches:
            blk, c, s = (np.asarray(b.column(i)) for i in range(3))
            cut = [0, *(np.flatnonzero(blk[1:] != blk[:-1]) + 1).tolist(), len(blk)]
            for x, y in zip(cut, cut[1:]):
                if x == y:
                    continue
                if held and blk[x] != now:
                    yield done()
                    held = []
                now = int(blk[x])
                held.append((c[x:y].astype(np.int64), s[x:y].astype(np.uint16)))
        if held:
            yield done()

    rows = counted.select("blk", "local", F.coalesce("c", F.lit(0)).cast("long").alias("c"), F.coalesce("symbol", F.lit(tops) + rare_class(F.col("word"), classes)).cast("int").alias("s"))
    tasks = max(partitions(counted.sparkSession), -(-n_blocks // TASK_BLOCKS))
    return rows.repartition(tasks, "blk").sortWithinPartitions("blk", "local").select("blk", "c", "s").mapInArrow(run, "blk long, c binary, s binary")


def _round(coded: DataFrame, model: Model) -> list:
    """Expected counts of all training texts: a row for each symbol, move and start."""
    sent = coded.sparkSession.sparkContext.broadcast(model)
    k, symbols = STATES, len(model.emit)
    schema = pa.schema([("key", pa.int32()), *((f"v{j}", pa.float64()) for j in range(k))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor()
        total = np.zeros((symbols + k + 1, k))
        for b in batches:
            for sizes, held, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                flat = np.frombuffer(open_.decompress(raw), np.uint16)
                size, learn = np.array(sizes, np.int64), ~np.array(held)
                flat = flat[np.repeat(learn, size)]
                size = size[learn]
                if not len(size):
                    continue
                pieces = -(-size // CUT)
                last = np.cumsum(pieces) - 1
                cut = np.full(int(pieces.sum()), CUT, np.int64)
                cut[last] = size - (pieces - 1) * CUT
                emit, moves, starts = expected(sent.value, flat, cut)
                total[:symbols] += emit
                total[symbols : symbols + k] += moves
                total[-1] += starts
        at = np.flatnonzero(total.any(axis=1))
        yield table({"key": at.astype(np.int32), **{f"v{j}": total[at, j] for j in range(k)}}, schema)

    parts = coded.select("sizes", "held", "symbols").mapInArrow(run, "key int, " + ", ".join(f"v{j} double" for j in range(k)))
    return parts.groupBy("key").agg(*[F.sum(f"v{j}").alias(f"v{j}") for j in range(k)]).toArrow()


def train(coded: DataFrame, words: list[bytes], base: np.ndarray, rest: np.ndarray, rounds: int) -> Model:
    model = first_model(words, base, rest)
    prior = PRIOR * np.append(base, rest)[:, None]
    symbols = len(words) + len(rest)
    for _ in range(rounds):
        got = _round(coded, model)  # TOP + RARE + STATES + 1 rows at most
        total = np.zeros((symbols + STATES + 1, STATES))
        total[got["key"].to_numpy()] = np.stack([got[f"v{j}"].to_numpy() for j in range(STATES)], axis=1)
        emit = total[:symbols] + prior
        move = total[symbols : symbols + STATES] + 1.0
        start = total[-1] + 1.0
        model = Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))
    return model


def most_frequent(counts: DataFrame, top: int) -> list:
    """The top rows of (word, c). A histogram of counts first shows which rows can be among them, as
    otherwise every task would send the driver its own top rows."""
    step = F.floor(F.log2("c") * 16).cast("int")
    histogram = sorted(((r["b"], r["n"]) for r in counts.groupBy(step.alias("b")).agg(F.count("*").alias("n")).collect()), reverse=True)  # 16 rows a power of two
    total, bound = 0, 0
    for bound, n in histogram:
        total += n
        if total >= top:
            break
    return counts.filter(step >= bound).orderBy(F.desc("c"), "word").limit(top).collect()


SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def score(docs: DataFrame, *, held: Column | None = None, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, top: int = TOP) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every text."""
    packed = materialise(blocks(docs, held_out(id_col) if held is None else held, id_col, text_col))
    words = block_words(packed)  # unpacked twice rather than stored
    counts = materialise(words.groupBy("word").agg(F.sum("n").alias("c")).filter("c > 0"))
    release(docs.sparkSession)
    sums = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    total, distinct = int(sums["n"] or 0), int(sums["v"])
    best = [(bytes(r["word"]), r["c"]) for r in most_frequent(counts, top)]
    tops = len(best)
    base = np.array([(c + 1) / (total + distinct + 1) for _, c in best])
    spark = docs.sparkSession
    symbols = spark.createDataFrame([(bytearray(w), i) for i, (w, _) in enumerate(best)], "word binary, symbol int")
    known = counts.join(F.broadcast(symbols), "word", "left")  # at most top rows are broadcast
    known = materialise(known)
    remove(counts)
    # mass of each class: its words and one unknown word
    classes = RARE if distinct else 1
    rest = np.ones(classes)
    for r in known.filter("symbol is null").groupBy(rare_class(F.col("word"), classes).alias("k")).agg((F.sum("c") + F.count("*")).alias("n")).collect():  # RARE rows at most
        rest[r["k"]] += r["n"]
    rest /= total + distinct + 1
    columns = materialise(_columns(words.select("blk", "local", "word").join(known, "word", "left"), tops, classes, packed.count()))
    remove(known)
    release(spark)
    coded = materialise(code(packed, columns, total, distinct, tops, rest))
    remove(packed, columns)
    release(spark)
    model = train(coded, [w for w, _ in best], base, rest, rounds if tops else 0)
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor()
        for b in batches:
            for r in b.to_pylist():
                flat = np.frombuffer(open_.decompress(r["symbols"]), np.uint16)
                sizes = np.array(r["sizes"], np.int64)
                value = likelihoods(sent.value, flat, sizes) + np.array(r["inside"])
                n = len(sizes)
                yield table({"doc_id": r["docs"], "held_out": r["held"], "n_tokens": sizes, "n_known": r["known"], "train_tokens": np.full(n, total), "base_score": r["base"], "score": value}, SCORED)

    return coded.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
