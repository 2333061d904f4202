"""Operator 8: language-model scores by a log-bilinear model trained with noise-contrastive estimation.

Tokens are 64-bit hashes of the words (A-Z lower-cased, runs of bytes outside space and tab to
carriage return), then one end for each text.

*Counts.* Every training word is counted: in each block of rows first, then by key. Totals are
aggregates of that table; nothing of it is sampled and only its ``OWN_SLOTS`` most frequent rows
reach the driver. Documents are dealt into blocks of about ``BLOCK_CHARS`` characters; a block asks
for its distinct words, the answers are joined by word and meet the block's texts again, so a very
frequent word costs one row for each block and no task holds the whole vocabulary. Words with slots of their own are
not asked for: their counts come with the model.

*Model.* Every word has a slot: each of the ``OWN_SLOTS`` most frequent words one of its own, all others
one of at most ``SHARED_SLOTS`` shared ones by hash, and the end one; their number grows with the distinct words up
to these bounds, which the driver's and a task's memory set. Two previous slots predict the next:
``h = C2 r_a + C1 r_b``; slots lie in classes of about the square root of their number, and
``P(slot | a, b) = P(class | h) P(slot | class, h)``, each a softmax of ``h . q + bias``, so it is normalised
exactly. A word of a shared slot has the slot's probability times its add-one share of the slot's
training tokens, unseen words of the slot together being one more word; so the probabilities of all
next tokens sum to one.

*Training.* Noise-contrastive estimation against the unigrams, for classes and within a class. Every task goes
through all slot trigrams of its training texts, counted in pieces, in weighted mini-batches that start
from the same parameters, and the tasks' parameters are averaged, a row by how often each task met it. So the steps grow with the
corpus; a corpus of less than ``STEPS`` mini-batches is gone through several times. Trigrams stay on executors.

Null texts are empty: one token, the end. A null id counts as '' in the split. Without training rows
all counts are 0 and the base score is 0. Repeated rows are scored and counted each on their own.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, hash_words, hold_out, map_arrow, table, text_bytes

OWN_SLOTS, SHARED_SLOTS = 32_768, 4_096
BLOCK_CHARS = 20_000_000
WIDTH = 15
CLASS_NOISE, NOISE = 32, 2
STEPS, BATCH, RUN = 800, 4096, 8
RATE = 0.07
#: Characters that a task of the training goes through.
TASK_CHARS = 64_000_000
PIECE = 8 << 20
#: First bits of a word's hash by which its slot is looked up.
INDEX_BITS = 17
#: Rows of words that a task hands over at a time.
WORD_ROWS = 1 << 18
#: Contexts whose softmax is made at a time, and parameter rows that are averaged at a time.
CONTEXTS, ROWS = 2_048, 1024


def token_pieces(column: pa.Array):
    """Yield (first row, word hashes as signed integers, offsets) for bounded pieces of a batch."""
    data, offsets = text_bytes(column)
    low, texts = 0, len(offsets) - 1
    while low < texts:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + PIECE, "right")) - 1)
        hashes, first = hash_words(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
        yield low, hashes.view(np.int64), first
        low = high


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n): occurrences of every word in all texts."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        word, n = np.unique(np.concatenate([h for _, h, _ in token_pieces(batch.column(text))]), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(word), pa.array(n)], names=["word", "n"])

    return map_arrow(docs.select(text), run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _sums(at: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct rows, sums of their values)."""
    order = np.argsort(at)
    at = at[order]
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return at[first], np.add.reduceat(values[order], first, axis=0)


class Model:
    """Slots: 0 .. own-1 the frequent words, then the shared ones, then the end; as context the end is the begin.

    ``params`` has a row of WIDTH weights and a bias for each slot as context, slot and class as targets, then C2 and C1
    with a row and a column of zeros, so that all products run over whole rows.
    """

    def __init__(self, words: np.ndarray, shared: int, n: np.ndarray | None = None):
        """``n``: training tokens of each of ``words``."""
        self.n = np.zeros(len(words), np.int64) if n is None else n
        self.order = np.argsort(words.view(np.uint64))
        self.words = words.view(np.uint64)[self.order]
        self.own, self.shared = len(words), shared
        self.begins = np.searchsorted(self.words >> np.uint64(64 - INDEX_BITS), np.arange((1 << INDEX_BITS) + 1, dtype=np.uint64)).astype(np.int32)
        self.end = self.own + shared
        self.slots = self.end + 1
        self.size = max(1, int(np.ceil(np.sqrt(self.slots))))
        self.classes = -(-self.slots // self.size)
        rng = np.random.default_rng(5)
        self.starts = np.cumsum([0, self.slots, self.slots, self.classes, WIDTH + 1, WIDTH + 1])
        self.params = (0.1 * rng.standard_normal((self.starts[-1], WIDTH + 1))).astype(np.float32)
        r, _, _, c2, c1 = self.parts(self.params)
        r[:, WIDTH], c2[:], c1[:] = 0, 0, 0
        c2[:WIDTH, :WIDTH], c1[:WIDTH, :WIDTH] = np.eye(WIDTH) * 0.5, np.eye(WIDTH)

    def parts(self, params: np.ndarray) -> list[np.ndarray]:
        return [params[a:b] for a, b in zip(self.starts[:-1], self.starts[1:], strict=True)]

    def weigh(self, tokens: np.ndarray, distinct: np.ndarray) -> None:
        """Training tokens of each slot, and distinct words of it."""
        self.rest = np.log10(tokens + distinct + 1.0)
        n = tokens + 0.5
        self.cum = np.cumsum(n / n.sum())
        first = np.arange(0, self.slots, self.size)
        mass = np.add.reduceat(n, first)
        self.class_cum = np.cumsum(mass / mass.sum())
        self.low = np.concatenate([[0.0], self.cum])[first]
        self.high = self.cum[np.minimum(first + self.size, self.slots) - 1]
        within = n / np.repeat(mass, np.diff([*first, self.slots]))
        self.log_class = np.log(mass / mass.sum()).astype(np.float32)
        self.log_within = np.log(within).astype(np.float32)
        _, q, c, _, _ = self.parts(self.params)
        q[:, WIDTH], c[:, WIDTH] = self.log_within, self.log_class

    def index(self, hashes: np.ndarray) -> np.ndarray:
        """Slots of words: found among the words with the same first bits, else by hash one of the shared."""
        h = hashes.view(np.uint64)
        out = (((h & np.uint64(0xFFFFFFFF)) * np.uint64(self.shared)) >> np.uint64(32)).astype(np.int64)
        out += self.own
        bucket = (h >> np.uint64(64 - INDEX_BITS)).astype(np.int32)
        at, end = self.begins[bucket], self.begins[bucket + 1]
        open_ = np.flatnonzero(at < end)
        at, end, h = at[open_], end[open_], h[open_]
        while len(open_):
            hit = self.words[at] == h
            out[open_[hit]] = self.order[at[hit]]
            at = at + 1
            more = ~hit & (at < end)
            open_, at, end, h = open_[more], at[more], end[more], h[more]
        return out

    def sequence(self, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(codes of each token's context, slots of the tokens, offsets), an end after each text."""
        texts = len(first) - 1
        offsets = first + np.arange(texts + 1)
        slot = np.full(len(hashes) + texts, self.end, np.int64)
        slot[np.arange(len(hashes)) + np.repeat(np.arange(texts), np.diff(first))] = self.index(hashes)
        one = np.concatenate([[self.end], slot[:-1]]) if len(slot) else slot
        two = np.concatenate([[self.end], one[:-1]]) if len(slot) else slot
        two[offsets[:-1]] = self.end  # the token before a text's first is the last text's end, which reads as begin
        return two * self.slots + one, slot, offsets

    def step(self, params: np.ndarray, seen: np.ndarray, rng, a: np.ndarray, b: np.ndarray, w: np.ndarray, n: np.ndarray) -> None:
        """One mini-batch by Adagrad, in place; ``seen`` holds each row's sum of mean squared gradients."""
        r, q, c, c2, c1 = self.parts(params)
        x, y, weight = r[a], r[b], (n / n.sum()).astype(np.float32)[:, None]
        full = x @ c2 + y @ c1
        full[:, WIDTH] = 1  # meets the bias
        cls = w // self.size
        # classes: one set of noise for the mini-batch
        noise = np.minimum(np.searchsorted(self.class_cum, rng.random(CLASS_NOISE)), self.classes - 1)
        bias, own = self.log_class + np.float32(np.log(CLASS_NOISE)), c[cls]
        hit = weight[:, 0] * (1 / (1 + np.exp(bias[cls] - np.einsum("bd,bd->b", full, own))) - 1)
        miss = bias[noise] - full @ c[noise].T
        np.exp(miss, out=miss)
        miss += 1
        miss = weight / miss
        back = hit[:, None] * own + miss @ c[noise]
        gc = np.zeros_like(c)
        at, sums = _sums(cls, hit[:, None] * full)
        gc[at] += sums
        np.add.at(gc, noise, miss.T @ full)
        # within the class: noise of its own for each row
        low, high = self.low[cls][:, None], self.high[cls][:, None]
        other = np.searchsorted(self.cum, low + rng.random((len(w), NOISE)) * (high - low), "right")
        other = np.clip(other, (cls * self.size)[:, None], np.minimum((cls + 1) * self.size, self.slots)[:, None] - 1)
        at = np.concatenate([w[:, None], other], 1)
        rows = q[at]
        d = 1 / (1 + np.exp(self.log_within[at] + np.float32(np.log(NOISE)) - np.einsum("bnd,bd->bn", rows, full)))
        d[:, 0] -= 1
        d *= weight
        back += np.einsum("bn,bnd->bd", d, rows)
        back[:, WIDTH] = 0
        at, d = at.ravel(), d.ravel()
        order = np.argsort(at)
        at = at[order]
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        gq = at[first], np.add.reduceat(d[order, None] * full[order // (NOISE + 1)], first, axis=0)
        gr = _sums(np.concatenate([a, b]), np.concatenate([back @ c2.T, back @ c1.T]))
        _, _, of_class, of_two, of_one = (slice(i, j) for i, j in zip(self.starts[:-1], self.starts[1:], strict=True))
        for i, g in (gr, (gq[0] + self.starts[1], gq[1]), (of_class, gc), (of_two, x.T @ back), (of_one, y.T @ back)):
            total = seen[i] + np.einsum("nd,nd->n", g, g) / (WIDTH + 1)
            seen[i] = total
            params[i] -= g * (np.float32(RATE) / (np.sqrt(total) + np.float32(1e-8)))[:, None]

    def finish(self, params: np.ndarray) -> None:
        r, q, c, c2, c1 = self.parts(params)
        self.two, self.one = r @ c2, r @ c1
        self.two[:, WIDTH] = 1
        self.q, self.c = q, c
        del self.params

    @cached_property
    def class_tables(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """For a slot two and one back: exp of its share of each class's logit, and the largest such share, taken off."""
        made = []
        for context in (self.two, self.one):
            z = context @ self.c.T
            most = z.max(1)
            z -= most[:, None]
            made.append((np.exp(z, out=z), most))
        return made

    def log10(self, codes: np.ndarray, slots: np.ndarray) -> np.ndarray:
        """log10 P(slot | context) of each pair.

        A class's unnormalised probability is a product of a part for either context slot, so the sum
        over classes is the product of two rows of a table; within the class a matrix product gives all logits.
        """
        out, cls = np.zeros(len(slots)), slots // self.size
        (two, most_two), (one, most_one) = self.class_tables
        order = np.argsort(cls.astype(np.int16) if self.classes < 1 << 15 else cls, kind="stable")
        bounds = np.searchsorted(cls[order], np.arange(self.classes + 1))
        for k in np.flatnonzero(np.diff(bounds)):
            rows = self.q[k * self.size : (k + 1) * self.size]
            for low in range(bounds[k], bounds[k + 1], CONTEXTS):
                i = order[low : min(low + CONTEXTS, bounds[k + 1])]
                a, b = np.divmod(codes[i], self.slots)
                h = self.two[a] + self.one[b]
                whole = np.log(np.einsum("nk,nk->n", two[a], one[b])) + most_two[a] + most_one[b]
                z = h @ rows.T
                hit = z[np.arange(len(z)), slots[i] - k * self.size] + h @ self.c[k] - whole
                z -= (most := z.max(1, keepdims=True))
                out[i] = hit - most[:, 0] - np.log(np.exp(z, out=z).sum(1))
        return out / np.log(10)


def slot_counts(counts: DataFrame, model: Model) -> DataFrame:
    """(slot, n, v): training tokens and distinct words of every slot that has any."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        slot = model.index(batch.column("word").to_numpy())
        rows, sums = _sums(slot, np.stack([batch.column("n").to_numpy(), np.ones(len(slot), np.int64)], 1))
        return pa.RecordBatch.from_arrays([pa.array(rows), pa.array(sums[:, 0]), pa.array(sums[:, 1])], names=["slot", "n", "v"])

    return map_arrow(counts, run, "slot long, n long, v long").groupBy("slot").agg(F.sum("n").alias("n"), F.sum("v").alias("v"))


def train(docs: DataFrame, model: Model, tokens: int, chars: int, text: str = "text") -> None:
    """Train on all slot trigrams of all texts; only parameters leave the executors."""
    epochs = max(1, -(-STEPS * BATCH // max(1, tokens)))

    def run(batches):
        rng, params, kept = np.random.default_rng(7), model.params.copy(), []
        seen, met = np.zeros(len(params), np.float32), np.zeros(len(params))

        def learn(code: np.ndarray, slot: np.ndarray, n: np.ndarray) -> None:
            # neighbours share a context, so short runs of them are cheap to take together
            order = (rng.permutation(-(-len(code) // RUN))[:, None] * RUN + np.arange(RUN)).ravel()
            order = order[order < len(code)]
            for low in range(0, len(order), BATCH):
                i = order[low : low + BATCH]
                a, b, w = code[i] // model.slots, code[i] % model.slots, slot[i]
                with np.errstate(over="ignore"):  # an infinite exponential is a probability of 0
                    model.step(params, seen, rng, a, b, w, n[i])
            for at in (code // model.slots, code % model.slots, slot + model.starts[1], slot // model.size + model.starts[2]):
                met[:] += np.bincount(at, n, len(met))
            met[model.starts[3] :] += n.sum()

        for whole in batches:
            for _, h, f in token_pieces(whole.column(0)):
                code, slot, _ = model.sequence(h, f)
                rows, n = np.unique(code * model.slots + slot, return_counts=True)
                piece = (rows // model.slots, rows % model.slots, n.astype(np.float64))
                learn(*piece)
                if epochs > 1:  # less than STEPS mini-batches in all
                    kept.append(piece)
        for _ in range(epochs - 1):
            for piece in kept:
                learn(*piece)
        if met.any():
            for low in range(0, len(params), ROWS):
                at = low + np.flatnonzero(met[low : low + ROWS])
                if len(at):
                    made = [pa.array([low // ROWS], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (at.astype(np.int32), met[at], params[at]))]
                    yield pa.RecordBatch.from_arrays(made, names=["part", "at", "met", "data"])

    def add(one: pa.Table) -> pa.Table:
        part = one.column("part")[0].as_py()
        total = np.zeros((ROWS, WIDTH + 2))
        for at, m, data in zip(*(one.column(k) for k in ("at", "met", "data")), strict=True):
            i, m = np.frombuffer(at.as_py(), np.int32) - part * ROWS, np.frombuffer(m.as_py())[:, None]
            total[i] += np.concatenate([np.frombuffer(data.as_py(), np.float32).reshape(-1, WIDTH + 1) * m, m], 1)
        return pa.table([one.column("part").slice(0, 1), pa.array([total.tobytes()], pa.binary())], names=["part", "data"])

    rows = docs.select(text).coalesce(max(1, -(-chars // TASK_CHARS)))  # each task sends its parameters
    made = rows.mapInArrow(run, "part int, at binary, met binary, data binary").groupBy("part").applyInArrow(add, "part int, data binary")
    out = model.params.copy()
    for row in made.collect():  # the parameters once
        total = np.frombuffer(row["data"]).reshape(-1, WIDTH + 2)
        low, m = row["part"] * ROWS, total[: len(out) - row["part"] * ROWS, -1]
        total = total[: len(m)]
        out[low : low + len(total)][m > 0] = (total[m > 0, :-1] / m[m > 0, None]).astype(np.float32)
    model.finish(out)


def score(docs: DataFrame, usable, doc_id: str = "doc_id", text: str = "text", block_chars: int = BLOCK_CHARS, keep: tuple = ()) -> DataFrame:
    """doc_id, the columns ``keep``, n_tokens, n_known, train_tokens, base_score, score for each row.

    ``usable``: a boolean column; the model and the counts learn from the rows where it holds.
    """
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.coalesce(usable, F.lit(False)).alias("usable"), *keep)
    usable_docs = docs.where("usable")
    counts = checkpointed(word_counts(usable_docs))
    whole = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    size = docs.agg(F.coalesce(F.sum(F.col("usable").cast("long")), F.lit(0)).alias("ends"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()
    tokens, distinct = whole["n"] + size["ends"], whole["v"] + (size["ends"] > 0)
    top = counts.orderBy(F.desc("n"), "word").limit(OWN_SLOTS).toPandas()
    model = Model(top["word"].to_numpy(np.int64), max(1, min(SHARED_SLOTS, whole["v"] - len(top))), top["n"].to_numpy(np.int64))
    got = slot_counts(counts, model).toPandas()  # at most OWN_SLOTS + SHARED_SLOTS rows
    of_slot = np.zeros((2, model.slots))
    of_slot[:, got["slot"].to_numpy(np.int64)] = got[["n", "v"]].to_numpy(np.float64).T
    of_slot[0, model.end] = size["ends"]
    model.weigh(*of_slot)
    train(usable_docs, model, int(tokens), int(size["chars"]))
    blocks = max(1, -(-int(size["chars"]) // block_chars))
    dealt = docs.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int")).repartition(blocks, "block")

    def ask(batches):
        """The distinct words of each block that have no slot of their own; a task holds those of its blocks."""
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            block = batch.column("block").to_numpy()
            for low, h, f in token_pieces(batch.column("text")):
                owner, other = np.repeat(block[low : low + len(f) - 1], np.diff(f)), model.index(h) >= model.own
                owner, h = owner[other], h[other]
                for k in np.unique(owner).tolist():
                    held.setdefault(k, []).append(np.unique(h[owner == k]))
        for k, found in held.items():
            words = np.unique(np.concatenate(found))
            for low in range(0, len(words), WORD_ROWS):
                part = words[low : low + WORD_ROWS]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), k, np.int32)), pa.array(part)], names=["block", "word"])

    asked = dealt.mapInArrow(ask, "block int, word long")  # with all columns, so that texts are dealt once for both readers
    answers = asked.join(counts, "word").select("block", "word", "n")
    base_of = np.log10(tokens + distinct + 1)
    kept = [f for f in docs.select(*keep).schema.fields]
    names = [f.name for f in kept]
    schema = "doc_id " + docs.schema["doc_id"].dataType.simpleString() + "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in kept)
    schema += ", n_tokens long, n_known long, train_tokens long, base_score double, score double"
    ends, total = int(size["ends"]), int(tokens)

    def run(texts: pa.Table, answered: pa.Table) -> pa.Table:
        word, n = (answered.column(k).to_numpy() for k in ("word", "n"))
        order = np.argsort(word)
        word, n, known = word[order], n[order], np.append(model.n, 0)
        out = []
        for low, h, f in token_pieces(texts.column("text").combine_chunks() if texts.num_rows else pa.array([], pa.string())):
            ctx, slot, offsets = model.sequence(h, f)
            shared = (slot >= model.own) & (slot < model.end)
            c = known[np.minimum(slot, model.own)]
            c[offsets[1:] - 1] = ends
            if len(word):
                is_word = np.ones(len(slot), bool)
                is_word[offsets[1:] - 1] = False
                other = h[shared[is_word]]
                at = np.minimum(np.searchsorted(word, other), len(word) - 1)
                c[shared] = np.where(word[at] == other, n[at], 0)
            log = model.log10(ctx, slot) + np.where(shared, np.log10(c + 1.0) - model.rest[slot], 0)
            sums = [np.add.reduceat(x, offsets[:-1]) for x in (np.log10(c + 1.0) - base_of, log, (c > 0).astype(np.int64))]
            out.append((np.diff(offsets), sums[2], sums[0], sums[1]))
        columns = [np.concatenate([o[k] for o in out]) if out else np.zeros(0) for k in range(4)]
        made = [columns[0].astype(np.int64), columns[1].astype(np.int64), np.full(len(columns[0]), total, np.int64), columns[2].astype(np.float64), columns[3].astype(np.float64)]
        return pa.table([texts.column(k) for k in ("doc_id", *names)] + [pa.array(m) for m in made], names=["doc_id", *names, "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, schema)


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", hold_out(F.col("doc_id"), 7, 2).alias("held_out"))
    out = score(docs, ~F.col("held_out"), keep=("held_out",))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
