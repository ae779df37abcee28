"""LM scoring by a gated recurrent network trained in numpy (operator 5).

Tokens are a text's lower-cased words and one end; Arrow cuts, counts and looks
up the words of some megabytes of texts at a time. All training words are
counted; the HEAD most frequent are looked up from a broadcast list of bounded
size, the others' counts come by a join on the word. The network's symbols are
the VOCABULARY most frequent words and one for all others, whose share is
divided among them by their counts plus one (one share for unseen words).

Softmax is factored: classes of about equal mass, then the words of a class.
Documents run in LANES side by side; a lane's state is carried from window to
window and cleared where a document starts, so a document's score is the log
probability of the whole of it. Training is truncated backpropagation over
windows of STEPS tokens with adaptive steps.

Training documents are dealt whole, by a hash of their id and text, to shards
of about SHARD_TOKENS tokens, and to ROUNDS rounds. In a round every shard
starts from the same parameters and learns its documents of that round, the
state carried over each document to its end, in as many lanes as the longest
document leaves about equally long (windows are longer where lanes are fewer),
a lane's documents in the order of the hash; then parameters and step sizes are averaged by tokens, over a task's shards and on in
a tree of fan-in FAN. So a score depends on
the documents alone, not on how the table or the cluster is cut.
"""

from __future__ import annotations

import heapq
import pickle
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WorkTables, gathered, mix64, per_worker, pieces, releasing

HEAD, VOCABULARY, CLASSES, HIDDEN = 1 << 18, 2047, 40, 16
LANES, STEPS, RATE, CLIP = 256, 16, 0.3, 1.0
#: Scores are log masses and bounded states' products; none comes near this bound, which keeps exp finite.
TOP = np.float32(60)
FOLDS, HELD = 7, 2
#: Tokens of a shard, and rounds between which shards are averaged.
SHARD_TOKENS, ROUNDS = 1 << 22, 4
#: Steps of a window at most, where few lanes are left: in scoring, and in training (the reach of its gradients).
LONGEST, REACH = 4096, 512
#: Lanes of a shard at least, however long its longest document.
FEWEST = 8
#: Tasks of a round at most; each takes its shards one after the other.
TASKS = 10_000
#: Distinct words that a task counts before it passes them on, and tables averaged at a time.
FLUSH, FAN = 400_000, 16
#: No word holds a space.
END = b" "


def words_of(batch: pa.RecordBatch) -> tuple[pa.Array, np.ndarray]:
    """Lower-cased words of all texts, one after the other, and how many each text has; bytes need not be valid UTF-8."""
    text = pc.fill_null(batch.column(batch.schema.get_field_index("text")).cast(pa.string(), safe=False), "")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(text))  # at runs of the six ASCII spaces, with empty words at the edges
    words = lists.flatten()
    full = pc.greater(pc.binary_length(words), 0)
    before = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    offsets = lists.offsets.to_numpy()
    return words.filter(full), np.diff(before[offsets - offsets[0]])


def ranks_of(words: pa.Array, sizes: np.ndarray, listed: pa.Array, other: int) -> np.ndarray:
    """Places in listed of each text's tokens, its end included; `other` where not listed."""
    found = pc.fill_null(pc.index_in(words, listed), other).to_numpy(zero_copy_only=False).astype(np.int64)
    end = pc.index(listed, pa.scalar(END.decode())).as_py()
    return np.insert(found, np.cumsum(sizes), other if end < 0 else end)


def _listed(words: list[bytes]) -> pa.Array:
    return pa.array(words, pa.binary()).cast(pa.string(), safe=False)


def fold(doc_id: int | None) -> int:
    """crc32 of the id as text, modulo FOLDS; a null id counts as empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS


class Network:
    """Gated recurrent network with a class-factored softmax; parameters are float32 arrays in one list."""

    def __init__(self, counts: np.ndarray, seed: int = 0):
        """counts: of the symbols, the last being all other words."""
        rng = np.random.default_rng(seed)
        n, h = len(counts), HIDDEN
        mass = np.cumsum(counts + 1.0)
        cls = np.minimum((mass - (counts + 1.0) / 2) / mass[-1] * CLASSES, CLASSES - 1).astype(np.int64)
        self.cls = np.unique(cls, return_inverse=True)[1].astype(np.int16)  # small numbers sort fast
        self.first = np.searchsorted(self.cls, np.arange(int(self.cls[-1]) + 2))
        share = np.log((counts + 1.0) / mass[-1])
        whole = np.log(np.add.reduceat(counts + 1.0, self.first[:-1]) / mass[-1])
        small = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
        self.params = [
            small(n, 3 * h), small(h, 3 * h),  # of a symbol and of the state: update gate, reset gate, candidate
            small(h, len(whole)), whole.astype(np.float32),  # classes
            small(n, h), (share - whole[self.cls]).astype(np.float32),  # words in their class
        ]
        self.squares = [np.full(p.shape, 1e-2, np.float32) for p in self.params]

    def packed(self) -> bytes:
        """Parameters and their sums of squared gradients."""
        return b"".join(x.tobytes() for x in [*self.params, *self.squares])

    def unpack(self, raw: bytes) -> None:
        flat, at = np.frombuffer(raw, np.float32).copy(), 0
        for some in (self.params, self.squares):
            for k, p in enumerate(some):
                some[k] = flat[at : at + p.size].reshape(p.shape)
                at += p.size

    def run(self, ids: np.ndarray, starts: np.ndarray, state: np.ndarray, keep: bool = False):
        """States before each token (steps, lanes, hidden), the last state, and what backpropagation needs.

        Within a step lanes come last in memory, so that gates are whole blocks.
        """
        h, (steps, lanes) = HIDDEN, ids.shape
        across, inputs = np.ascontiguousarray(self.params[1].T), _turned(self.params[0][ids])
        out = np.empty((steps, h, lanes), np.float32)
        kept = tuple(np.empty((steps, n, lanes), np.float32) for n in (2 * h, h, h)) if keep else None
        state = np.ascontiguousarray(state.T)
        for t, fresh in enumerate(starts.any(axis=1).tolist()):
            if fresh:
                state = np.where(starts[t], np.float32(0), state)
            out[t] = state
            x, y = inputs[t], across @ state
            gates = y[: 2 * h]
            gates += x[: 2 * h]
            np.negative(gates, out=gates)
            np.exp(gates, out=gates)
            gates += 1
            np.reciprocal(gates, out=gates)
            c = gates[h:] * y[2 * h :]
            c += x[2 * h :]
            np.tanh(c, out=c)
            if keep:
                kept[0][t], kept[1][t], kept[2][t] = gates, c, y[2 * h :]
            state = state - c
            state *= gates[:h]
            state += c
        return out.transpose(0, 2, 1), state.T, kept

    def log_probs(self, states: np.ndarray, ids: np.ndarray, train: bool = False):
        """Natural log probability of each symbol; with train, also gradients of the mean loss."""
        _, _, wc, bc, ww, bw = self.params
        cls = self.cls[ids]
        order = np.argsort(cls, kind="stable")  # a class's rows are a slice from here on
        states, ids, cls = states[order], ids[order], cls[order]
        edges = np.searchsorted(cls, np.arange(len(self.first)))
        rows, ones = np.arange(len(ids)), np.ones(max(len(ids), len(ww)), np.float32)
        scores, logp = self._raised(states, wc, bc, rows, cls, ones, train)
        if train:
            scores[rows, cls] -= 1
            grads = [states.T @ scores, ones[: len(ids)] @ scores, np.zeros_like(ww), np.zeros_like(bw)]
            back = scores @ wc.T
        for k in range(len(self.first) - 1):
            low, high, a, b = self.first[k], self.first[k + 1], edges[k], edges[k + 1]
            if high - low < 2 or a == b:
                continue
            s, pick = states[a:b], ids[a:b] - low
            scores, some = self._raised(s, ww[low:high].T, bw[low:high], rows[: b - a], pick, ones, train)
            logp[a:b] += some
            if train:
                scores[rows[: b - a], pick] -= 1
                grads[2][low:high] = scores.T @ s
                grads[3][low:high] = ones[: b - a] @ scores
                back[a:b] += scores @ ww[low:high]
        found = np.empty_like(logp)
        found[order] = logp
        if not train:
            return found
        turned = np.empty_like(back)
        turned[order] = back
        return found, grads, turned

    @staticmethod
    def _raised(states, weights, bias, rows, pick, ones, train):
        """Probabilities of all columns (masses without train), and the log probability of each row's pick."""
        scores = states @ weights
        scores += bias
        np.minimum(scores, TOP, out=scores)
        logp = scores[rows, pick]
        np.exp(scores, out=scores)
        total = scores @ ones[: scores.shape[1]]
        logp -= np.log(total)
        if train:
            scores *= np.reciprocal(total)[:, None]
        return scores, logp

    def learn(self, ids: np.ndarray, starts: np.ndarray, state: np.ndarray) -> np.ndarray:
        """One step over a window (steps, lanes); returns the state to carry on."""
        h, across = HIDDEN, self.params[1]
        states, state, (gates, c, yc) = self.run(ids, starts, state, keep=True)
        _, grads, back = self.log_probs(states.reshape(-1, h), ids.reshape(-1), train=True)
        states = states.transpose(0, 2, 1)
        back = _turned(back.reshape(*ids.shape, h))
        z, r = gates[:, :h], gates[:, h:]
        # what a state's gradient is multiplied by, for the candidate, the update gate and (after that of the candidate) the reset gate
        by_c = (1 - z) * (1 - c * c)
        by_z = (states - c) * z * (1 - z)
        by_r = yc * r * (1 - r)
        dx = np.empty((len(ids), 3 * h, ids.shape[1]), np.float32)
        dy = np.empty_like(dx)
        down = np.zeros_like(states[0])
        for t in range(len(ids) - 1, -1, -1):
            dc = np.multiply(down, by_c[t], out=dx[t, 2 * h :])
            np.multiply(down, by_z[t], out=dx[t, :h])
            np.multiply(dc, by_r[t], out=dx[t, h : 2 * h])
            dy[t, : 2 * h] = dx[t, : 2 * h]
            np.multiply(dc, r[t], out=dy[t, 2 * h :])
            down *= z[t]
            down += across @ dy[t]
            down += back[t]
            if starts[t].any():
                down[:, starts[t]] = 0
        dacross = np.matmul(states, dy.transpose(0, 2, 1)).sum(axis=0)
        order = np.argsort(ids.astype(np.uint16), axis=None, kind="stable")
        used, at = np.unique(ids.reshape(-1)[order], return_index=True)
        rows = np.add.reduceat(_turned(dx).reshape(-1, 3 * h)[order], at, axis=0)
        for k, part, grad in ((0, used, rows), (1, slice(None), dacross), (2, slice(None), grads[0]), (3, slice(None), grads[1]), (4, slice(None), grads[2]), (5, slice(None), grads[3])):
            grad /= STEPS
            np.clip(grad, -CLIP, CLIP, out=grad)
            self.squares[k][part] += grad * grad
            self.params[k][part] -= RATE * grad / np.sqrt(self.squares[k][part])
        return state


def _turned(x: np.ndarray) -> np.ndarray:
    """The last two axes exchanged, in memory too."""
    return np.ascontiguousarray(x.transpose(0, 2, 1))


class Lanes:
    """Deals documents' symbols to lanes and hands out windows (ids, starts, document numbers), each (steps, lanes)."""

    def __init__(self, lanes: int = LANES, steps: int = STEPS, longest: int = LONGEST):
        self.steps, self.longest, self.docs = steps, longest, 0
        self.rows = [[] for _ in range(lanes)]
        self.sizes = np.zeros(lanes, np.int64)

    def add(self, symbols: np.ndarray, lane: int | None = None) -> None:
        """Without a lane, to the one with the fewest tokens."""
        lane = int(self.sizes.argmin()) if lane is None else lane
        self.rows[lane].append((self.docs, symbols))
        self.sizes[lane] += len(symbols)
        self.docs += 1

    def _flat(self, lane: int, n: int):
        """The lane's next n tokens; the rest stays."""
        ids, docs, starts = np.zeros(n, np.int64), np.full(n, -1, np.int64), np.zeros(n, bool)
        at = 0
        while at < n and self.rows[lane]:
            doc, symbols = self.rows[lane][0]
            fresh = doc >= 0
            take = min(n - at, len(symbols))
            number = doc if fresh else -1 - doc
            ids[at : at + take], docs[at : at + take], starts[at] = symbols[:take], number, fresh
            if take < len(symbols):
                self.rows[lane][0] = (-1 - number, symbols[take:])
            else:
                self.rows[lane].pop(0)
            at += take
        self.sizes[lane] -= at
        return ids, starts, docs

    def windows(self, last: bool = False, pad: bool = False):
        """Full windows; the last call also gives what is left, in windows that are longer as lanes run out.

        With pad, lanes that end within the same `steps` tokens end together,
        those that are shorter with symbols of document -1.
        """
        n = int(self.sizes.min()) // self.steps * self.steps
        if n:
            yield from self._cut(np.arange(len(self.rows)), n, self.steps)
        while last and self.sizes.any():
            live = np.flatnonzero(self.sizes)
            n = min(self.sizes[live].min(), self.longest)
            n = max(n, min(self.sizes[live].max(), self.steps)) if pad else n
            yield from self._cut(live, int(n), self.steps * len(self.rows) // len(live))

    def _cut(self, lanes: np.ndarray, n: int, steps: int):
        ids, starts, docs = (np.stack(x, axis=1) for x in zip(*[self._flat(k, n) for k in lanes], strict=True))
        for t in range(0, n, steps):
            yield lanes, ids[t : t + steps], starts[t : t + steps], docs[t : t + steps]


def _column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def _training(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in gathered(batches):
        yield batch.filter(pa.array([fold(doc) != HELD for doc in _column(batch, "doc_id")], pa.bool_()))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ends, held = 0, []

    def merged(tables: list[pa.Table]) -> pa.Table:
        sums = pa.concat_tables(tables).group_by("word", use_threads=False).aggregate([("n", "sum")])
        return pa.table({"word": sums.column("word"), "n": sums.column("n_sum")})

    def out(table: pa.Table):
        return pa.table({"word": table.column("word").cast(pa.binary()), "n": table.column("n")}).to_batches()

    for batch in _training(batches):
        ends += batch.num_rows
        found = words_of(batch)[0].value_counts()
        held.append(pa.table({"word": found.field("values"), "n": found.field("counts")}))
        if sum(map(len, held)) > 2 * FLUSH:
            held = [merged(held)]
            if len(held[0]) > FLUSH:
                yield from out(held.pop())
    if ends:
        yield from out(merged([*held, pa.table({"word": [END.decode()], "n": [ends]})]))


def _head(key: str, shared) -> pa.Array:
    return per_worker("head", key, lambda: _listed(pickle.loads(shared.value)["words"]))


def _symbols(shared, symbols: int, shards: int):
    """Training documents as symbols: round, shard, place (a hash), and the symbols' 16 bits each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed = _listed(pickle.loads(shared.value)["words"][: symbols - 1])
        for batch in _training(batches):
            words, sizes = words_of(batch)
            found = ranks_of(words, sizes, listed, symbols - 1).astype("<u2")
            ends = np.concatenate([[0], 2 * np.cumsum(sizes + 1)]).astype(np.int32)
            parts = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(ends), pa.py_buffer(found)])
            keys = [xxhash.xxh3_64_intdigest(raw or b"", seed=(doc or 0) & 0xFFFFFFFF) for doc, raw in zip(_column(batch, "doc_id"), _column(batch, "text"), strict=True)]
            key = mix64(np.asarray(keys, np.uint64))
            columns = [pa.array((key >> np.uint64(40)) % np.uint64(ROUNDS), pa.int32()), pa.array((mix64(key) % np.uint64(shards)).astype(np.int64)), pa.array(key.view(np.int64)), parts]
            yield pa.RecordBatch.from_arrays(columns, names=["round", "shard", "place", "symbols"])

    return run


def _even_lanes(parts: list[np.ndarray]) -> Lanes:
    """A shard's documents of a round in lanes that end at about the same time: the longest are dealt first, each to the lane with the fewest tokens."""
    sizes = np.array([len(x) for x in parts])
    count = int(np.clip(sizes.sum() // sizes.max(), FEWEST, LANES))
    lanes, filled, lane_of = Lanes(count, min(STEPS * LANES // count, REACH), REACH), [(0, k) for k in range(count)], np.zeros(len(parts), np.int64)
    for doc in np.argsort(-sizes, kind="stable"):
        size, lane_of[doc] = filled[0]
        heapq.heapreplace(filled, (size + int(sizes[doc]), int(lane_of[doc])))
    for doc, lane in zip(parts, lane_of.tolist(), strict=True):
        lanes.add(doc, lane)
    return lanes


def _train(shared, model):
    """One row per task that has a shard: tokens seen, and its shards' parameters averaged by tokens; rows come sorted by shard and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, current, total, weight, parts = pickle.loads(shared.value), None, None, 0, []

        def end():
            nonlocal total, weight
            network, lanes, seen = Network(plan["symbols"]), _even_lanes(parts), sum(map(len, parts))
            network.unpack(model.value)
            state = np.zeros((len(lanes.rows), HIDDEN), np.float32)
            for at, ids, starts, _ in lanes.windows(True):
                state[at] = network.learn(ids, starts, state[at])
            one = np.frombuffer(network.packed(), np.float32).astype(np.float64) * seen
            total, weight = one if total is None else total + one, weight + seen

        for batch in pieces(batches, "symbols"):
            for shard, raw in zip(_column(batch, "shard"), _column(batch, "symbols"), strict=True):
                if shard != current:
                    if current is not None:
                        end()
                    current, parts = shard, []
                parts.append(np.frombuffer(raw, "<u2"))
        if current is not None:
            end()
            merged = (total / weight).astype(np.float32).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([weight], pa.int64()), pa.array([merged], pa.binary())], names=["part", "seen", "params"])

    return run


def _mean(table: pa.Table) -> pa.Table:
    seen, total = 0, None
    for k in np.argsort(table.column("part").to_numpy()):
        n = table.column("seen")[k].as_py()
        one = np.frombuffer(table.column("params")[k].as_py(), np.float32).astype(np.float64) * n
        total, seen = one if total is None else total + one, seen + n
    return pa.table({"part": [table.column("part")[0].as_py() // FAN], "seen": [seen], "params": pa.array([(total / seen).astype(np.float32).tobytes()], pa.binary())})


def _learned(lean: DataFrame, tables: WorkTables, shared, symbols: int, train_tokens: int, start: bytes) -> bytes:
    """The parameters after all rounds."""
    spark = lean.sparkSession
    shards = max(1, -(-train_tokens // SHARD_TOKENS))
    dealt = tables.save(lean.mapInArrow(releasing(_symbols(shared, symbols, shards)), "round int, shard long, place long, symbols binary"), "symbols", by="round")
    params = start
    for turn in range(ROUNDS):
        model = spark.sparkContext.broadcast(params)
        rows = dealt.where(F.col("round") == turn).select("shard", "place", "symbols").repartition(min(shards, TASKS), "shard").sortWithinPartitions("shard", "place")
        trained = tables.save(rows.mapInArrow(_train(shared, model), "part long, seen long, params binary"), "trained")
        while trained.count() > 1:
            group = trained.withColumn("group", F.floor(F.col("part") / FAN))
            trained = tables.save(group.groupBy("group").applyInArrow(lambda t: _mean(t.select(["part", "seen", "params"])), "part long, seen long, params binary"), "trained")
        found = trained.first()
        params = bytes(found["params"]) if found else params
    return params


def _score(key: str, shared, model, symbols: int):
    names = ["uid", "doc_id", "held_out", "n_tokens", "known", "log_counts", "rare", "log_prob", "outside", "tail", "tail_n"]
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, plan = _head(key, shared), pickle.loads(shared.value)
        logs = np.log10(np.concatenate([plan["counts"], [0]]) + 1.0)  # the last: words beyond the head
        network = Network(plan["symbols"])
        network.unpack(model.value)
        lanes, state, base = Lanes(steps=32), np.zeros((LANES, HIDDEN), np.float32), TaskContext.get().partitionId() << 33
        rows: dict[int, list] = {}

        def step(last: bool):
            for lane, ids, starts, docs in lanes.windows(last, pad=True):
                states, state[lane], _ = network.run(ids, starts, state[lane])
                logp = network.log_probs(states.reshape(-1, HIDDEN), ids.reshape(-1)).astype(np.float64)
                found, where = np.unique(docs, return_inverse=True)
                for doc, value, n in zip(found.tolist(), np.bincount(where.reshape(-1), logp).tolist(), np.bincount(where.reshape(-1)).tolist(), strict=True):
                    if doc >= 0:
                        rows[doc][7] += value
                        rows[doc][11] -= n

        def done():
            out = [rows.pop(k)[:11] for k in [k for k, r in rows.items() if not r[11]]]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

        for batch in gathered(batches):
            words, sizes = words_of(batch)
            found, ends = ranks_of(words, sizes, index, HEAD), np.cumsum(sizes + 1)
            starts, outside = ends - sizes - 1, found >= symbols - 1
            each = logs[np.minimum(found, len(logs) - 1)]
            unknown = np.flatnonzero(np.delete(found, ends - 1) >= HEAD)
            tail, cuts = words.take(pa.array(unknown)).cast(pa.binary()).to_pylist(), np.searchsorted(unknown, np.cumsum(sizes)).tolist()
            # of each document: the sums over its tokens, one at least
            sums = [np.add.reduceat(x, starts).tolist() for x in ((found < HEAD).astype(np.int64), each, np.where(outside, each, 0.0), outside.astype(np.int64))]
            symbol, low = np.minimum(found, symbols - 1).astype("<u2"), 0
            for doc, start, end, high, known, log, rare, out in zip(_column(batch, "doc_id"), starts.tolist(), ends.tolist(), cuts, *sums, strict=True):
                times = Counter(tail[low:high])
                if found[end - 1] >= HEAD:
                    times[END] = 1
                rows[lanes.docs] = [base + lanes.docs, doc, fold(doc) == HELD, end - start, known, log, rare, 0.0, out, list(times), list(times.values()), end - start]
                lanes.add(symbol[start:end])
                low = high
            step(False)
            yield from done()
        step(True)
        yield from done()

    return run


def lm_scores(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Scores are log10 probabilities of whole texts, however long. Null and
    empty texts are the end token alone. A null doc_id is a training row.
    Repeated rows are counted and scored each. Words of equal counts are ranked
    by their bytes. Without training rows every word is unseen. Other columns
    of docs are not read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    tables = WorkTables(spark, "lm")
    lean = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    counts = tables.save(lean.mapInArrow(releasing(_count), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "counts")
    whole = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    n, v = whole["n"], whole["v"]
    top = counts.orderBy(F.desc("n"), "word").limit(HEAD).toArrow()  # HEAD rows at most
    words, head = top.column("word").to_pylist(), top.column("n").to_numpy().astype(np.int64)
    symbols = min(VOCABULARY, len(words)) + 1
    others = n - int(head[: symbols - 1].sum())
    plan = {"words": [bytes(w) for w in words], "counts": head, "symbols": np.concatenate([head[: symbols - 1], [others]]).astype(np.float64)}
    shared, key = spark.sparkContext.broadcast(pickle.dumps(plan)), tables.root
    params = _learned(lean, tables, shared, symbols, n, Network(plan["symbols"]).packed())
    model = spark.sparkContext.broadcast(params)
    schema = "uid long, doc_id long, held_out boolean, n_tokens long, known long, log_counts double, rare double, log_prob double, outside long, tail array<binary>, tail_n array<long>"
    # long texts first, so that no lane is left with one alone at the end
    ordered = lean.withColumn("size", F.octet_length("text")).sortWithinPartitions(F.desc("size")).drop("size")
    rows = tables.save(ordered.mapInArrow(releasing(_score(key, shared, model, symbols)), schema), "scores")
    tail = rows.select("uid", F.explode(F.arrays_zip("tail", "tail_n")).alias("x")).select("uid", F.col("x.tail").alias("word"), F.col("x.tail_n").alias("times"))
    # the tail's words are none of the HEAD most frequent
    joined = tail.join(counts, "word").groupBy("uid").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("logs"))
    every = float(np.log10(n + v + 1.0))
    # what words outside the network's symbols share: their counts plus one each, and one for the unseen
    share = float(np.log10(others + (v - (symbols - 1)) + 1.0))
    out = rows.drop("tail", "tail_n").join(joined, "uid", "left")
    logs, more = F.coalesce("logs", F.lit(0.0)), F.coalesce("more", F.lit(0))
    return out.select(
        "doc_id", "held_out", "n_tokens",
        (F.col("known") + more).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("log_counts") + logs - F.col("n_tokens") * F.lit(every)).alias("base_score"),
        (F.col("log_prob") / F.lit(float(np.log(10))) + F.col("rare") + logs - F.col("outside") * F.lit(share)).alias("score"),
    )
