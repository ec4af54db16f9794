"""A gated recurrent language model with class-factored output, trained and applied on Spark."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import durable, map_arrow, one_thread, raw, tree_sum

HIDDEN = 16
#: Output symbols: CLASSES classes of MEMBERS symbols each. The last RARE symbols each stand
#: for all other words of a like form, the others for the most frequent words and the end.
CLASSES, MEMBERS, RARE = 64, 64, 256
#: Words at most whose counts every task gets; the counts of all others come by a join.
SHARED = 131_072
#: Rounds of training; a round takes the documents of one hash bucket, and averages.
ROUNDS = 4
#: Gradients run back through WINDOW tokens, the state through whole documents; each is trained on PASSES times.
WINDOW, LANES, PASSES, RATE = 32, 256, 2, 0.02
#: Symbols of whole documents after which a task trains on what it holds.
HELD = 1 << 21


def words(text: bytes | None) -> list[bytes]:
    """Words end at ASCII white space; A-Z are lower-cased."""
    return (text or b"").lower().split()


def form(word: bytes) -> int:
    """Which of the rare symbols stands for a word: by its first and last bytes."""
    return zlib.crc32(word[:2] + b" " + word[-2:]) % RARE


class Network:
    """The parameters in one vector, and views of it."""

    symbols = CLASSES * MEMBERS

    def __init__(self, flat: np.ndarray | None = None, hidden: int = HIDDEN):
        self.hidden = h = hidden
        shapes = {"x": (self.symbols, 3 * h), "u": (h, 3 * h), "c": (h, CLASSES), "cb": (CLASSES,), "w": (CLASSES, h, MEMBERS), "wb": (CLASSES, MEMBERS)}
        sizes = [int(np.prod(s)) for s in shapes.values()]
        self.flat = np.zeros(sum(sizes), np.float32) if flat is None else flat
        for (name, shape), part in zip(shapes.items(), np.split(self.flat, np.cumsum(sizes)[:-1])):
            setattr(self, name, part.reshape(shape))

    @classmethod
    def fresh(cls, weight: np.ndarray, hidden: int = HIDDEN, seed: int = 1) -> Network:
        """Small random weights, and output biases that give the symbols' own frequencies."""
        net, rng = cls(hidden=hidden), np.random.default_rng(seed)
        net.flat[:] = rng.normal(0, 0.1, len(net.flat))
        net.x[:, :hidden] += 1.0  # keep the state at first
        share = (weight + 0.5).reshape(CLASSES, MEMBERS)
        net.cb[:] = np.log(share.sum(1) / share.sum())
        net.wb[:] = np.log(share / share.sum(1, keepdims=True))
        return net

    def step(self, inputs: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, ...]:
        h = self.hidden
        a, g = self.x[inputs], state @ self.u
        gates = a[:, : 2 * h]
        gates += g[:, : 2 * h]
        np.exp(np.negative(gates, out=gates), out=gates)
        gates += 1
        np.reciprocal(gates, out=gates)
        z, r, n = gates[:, :h], gates[:, h:], a[:, 2 * h :]
        n += r * g[:, 2 * h :]
        np.tanh(n, out=n)
        return n + z * (state - n), z, r, n, g[:, 2 * h :]

    def _members(self, states: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens in order of class, where each class begins, and the scores of their class's symbols."""
        order = np.argsort(which, kind="stable")
        cuts = np.searchsorted(which[order], np.arange(CLASSES + 1))
        held, logits = states[order], np.empty((len(which), MEMBERS), np.result_type(states, self.w))
        for k in np.flatnonzero(np.diff(cuts)).tolist():
            np.matmul(held[cuts[k] : cuts[k + 1]], self.w[k], out=logits[cuts[k] : cuts[k + 1]])
        logits += self.wb[which[order]]
        return order, cuts, logits

    def log_probability(self, states: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """Natural logarithms of the targets' probabilities: class, then symbol in its class."""
        out, ones = np.empty(len(targets), np.float64), np.ones(max(CLASSES, MEMBERS), np.float32)
        for start in range(0, len(targets), 16_384):  # as much as stays in the processor's cache
            some = slice(start, start + 16_384)
            held, aim = states[some], targets[some]
            which, member, rows = aim // MEMBERS, aim % MEMBERS, np.arange(len(aim))
            logits = held @ self.c
            logits += self.cb
            found = logits[rows, which].astype(np.float64)
            found -= np.log(np.exp(logits, out=logits) @ ones[:CLASSES].astype(logits.dtype))
            order, _, logits = self._members(held, which)
            own = logits[rows, member[order]].astype(np.float64)
            found[order] += own - np.log(np.exp(logits, out=logits) @ ones[:MEMBERS].astype(logits.dtype))
            out[some] = found
        return out

    def gradient(self, inputs: np.ndarray, targets: np.ndarray, mask: np.ndarray, state: np.ndarray, fresh: np.ndarray | None = None) -> tuple[Network, np.ndarray, float]:
        """Gradient of the mean loss over one window (time x lanes), and the state after it.

        The state starts anew where ``fresh`` is set.
        """
        out = Network(hidden=self.hidden)
        state, loss = self.add_gradient(out, inputs, targets, mask, state, fresh)
        out.flat /= max(1, int(mask.sum()))
        return out, state, loss

    def add_gradient(self, out: Network, inputs: np.ndarray, targets: np.ndarray, mask: np.ndarray, state: np.ndarray, fresh: np.ndarray | None = None) -> tuple[np.ndarray, float]:
        """Add the gradient of a window's summed loss to ``out``; the state after it, and the loss."""
        h, (time, lanes) = self.hidden, inputs.shape
        kept, befores = [], np.empty((time, lanes, h), np.float32)
        states, whole = np.empty((time, lanes, h), np.float32), mask.all(1)
        starts = np.zeros(time, bool) if fresh is None else fresh.any(1)
        for t in range(time):
            if starts[t]:
                state = np.where(fresh[t][:, None], np.float32(0), state)
            befores[t] = state
            new, *rest = self.step(inputs[t], state)
            kept.append(rest)
            state = new if whole[t] else np.where(mask[t][:, None], new, state)
            states[t] = state
        on = slice(None) if whole.all() else np.flatnonzero(mask.ravel())
        flat, aim = states.reshape(-1, h)[on], targets.ravel()[on]
        which, member, rows = aim // MEMBERS, aim % MEMBERS, np.arange(len(aim))
        p = flat @ self.c
        p += self.cb
        np.exp(p, out=p)
        p /= p.sum(1, keepdims=True)
        loss = -np.log(p[rows, which] + 1e-30).sum()
        p[rows, which] -= 1
        out.c += flat.T @ p
        out.cb += p.sum(0)
        back = p @ self.c.T
        order, cuts, p = self._members(flat, which)
        np.exp(p, out=p)
        p /= p.sum(1, keepdims=True)
        loss -= np.log(p[rows, member[order]] + 1e-30).sum()
        p[rows, member[order]] -= 1
        held, more = flat[order], np.empty((len(aim), h), np.float32)
        for k in np.flatnonzero(np.diff(cuts)).tolist():
            part = slice(cuts[k], cuts[k + 1])
            out.w[k] += held[part].T @ p[part]
            out.wb[k] += p[part].sum(0)
            np.matmul(p[part], self.w[k].T, out=more[part])
        back[order] += more
        into = np.zeros((time * lanes, h), np.float32)
        into[on] = back
        into = into.reshape(time, lanes, h)
        # The last third of ``gates`` is the candidate's, before and after the reset gate.
        carry, gates, pieces = np.zeros((lanes, h), np.float32), np.empty((time, lanes, 3 * h), np.float32), np.empty((time, lanes, 3 * h), np.float32)
        for t in range(time - 1, -1, -1):
            z, r, n, g = kept[t]
            before, live = befores[t], mask[t][:, None]
            d = carry + into[t]
            if not whole[t]:
                d = np.where(live, d, 0)
            keep = d * z
            dn = (d - keep) * (1 - n * n)
            piece, gate = pieces[t], gates[t]
            np.multiply((before - n) * keep, 1 - z, out=piece[:, :h])
            np.multiply(dn * g * r, 1 - r, out=piece[:, h : 2 * h])
            piece[:, 2 * h :] = dn
            gate[:, : 2 * h] = piece[:, : 2 * h]
            np.multiply(dn, r, out=gate[:, 2 * h :])
            keep += gate @ self.u.T
            carry = keep if whole[t] else np.where(live, keep, carry)
            if starts[t]:
                carry = np.where(fresh[t][:, None], np.float32(0), carry)
        out.u += befores.reshape(-1, h).T @ gates.reshape(-1, 3 * h)
        ids = inputs.ravel()[on]
        order = np.argsort(ids, kind="stable")
        first = np.flatnonzero(np.r_[True, np.diff(ids[order]) > 0])
        if len(ids):
            out.x[ids[order][first]] += np.add.reduceat(pieces.reshape(-1, 3 * h)[on][order], first, axis=0)
        return state, float(loss)


def train(net: Network, texts: list[np.ndarray], passes: int = PASSES, rate: float = RATE, seed: int = 0) -> int:
    """Truncated backpropagation over whole texts of symbols, whose first is input only; Adam. The number of targets.

    Texts are dealt out to lanes of like lengths, in random order in each; the state runs
    through all windows of a text and starts anew with the next. Windows are added up to
    a step of half a full one's tokens at least, so that a long text's end, left alone in
    its lane, does not steer the network; what is left over makes a smaller step.
    """
    rng = np.random.default_rng(seed)
    m, v, count, done = np.zeros_like(net.flat), np.zeros_like(net.flat), 0, 0
    total, held, enough, spare = Network(hidden=net.hidden), 0, WINDOW * LANES // 2, np.empty_like(net.flat)

    def step(size: float) -> None:
        nonlocal done
        g = total.flat
        g *= min(1.0 / held, 1.0 / (float(np.sqrt(g @ g)) + 1e-9))
        done += 1
        np.multiply(m, 0.9, out=m)
        np.add(m, np.multiply(g, 0.1, out=spare), out=m)
        np.multiply(v, 0.99, out=v)
        np.multiply(g, g, out=spare)
        np.add(v, np.multiply(spare, 0.01, out=spare), out=v)
        np.sqrt(np.divide(v, 1 - 0.99**done, out=spare), out=spare)
        np.divide(m, np.add(spare, 1e-6, out=spare), out=spare)
        net.flat -= np.multiply(spare, size * rate / (1 - 0.9**done), out=spare)

    texts = [s for s in texts if len(s) > 1]
    for _ in range(passes if texts else 0):
        lanes = min(LANES, len(texts))
        queue, dealt = [(0, k) for k in range(lanes)], [[] for _ in range(lanes)]
        for i in sorted(rng.permutation(len(texts)).tolist(), key=lambda i: -len(texts[i])):
            size, lane = heapq.heappop(queue)
            dealt[lane].append(texts[i])
            heapq.heappush(queue, (size + len(texts[i]) - 1, lane))
        dealt.sort(key=lambda own: -sum(len(s) - 1 for s in own))
        lengths = np.array([sum(len(s) - 1 for s in own) for own in dealt])
        own = [lane[i] for lane in dealt for i in rng.permutation(len(lane))]
        before, after = np.concatenate([s[:-1] for s in own]), np.concatenate([s[1:] for s in own])
        first = np.zeros(len(before), bool)
        first[np.cumsum([0] + [len(s) - 1 for s in own[:-1]])] = True
        begin = np.cumsum(lengths) - lengths
        state = np.zeros((lanes, net.hidden), np.float32)
        for start in range(0, int(lengths[0]), WINDOW):
            live = int((lengths > start).sum())
            time = np.arange(start, min(start + WINDOW, int(lengths[0])))[:, None]
            mask = time < lengths[:live]
            at = np.where(mask, begin[:live] + time, 0)
            state, _ = net.add_gradient(total, before[at].astype(np.int64), after[at].astype(np.int64), mask, state[:live], first[at] & mask)
            n = int(mask.sum())
            count, held = count + n, held + n
            if held >= enough:
                step(1.0)
                total.flat[:], held = 0, 0
    if held:
        step(held / enough if done else 1.0)
    return count


def document_scores(net: Network, texts: list[np.ndarray], lanes: int = 512, window: int = 64) -> np.ndarray:
    """Natural log-probability of each whole sequence of symbols, its end symbol last.

    Documents are dealt out to lanes, longest first, one after the other in each; the
    state runs through all windows of a document and starts anew with the next.
    """
    total = np.zeros(len(texts))
    order = sorted((i for i in range(len(texts)) if len(texts[i])), key=lambda i: -len(texts[i]))
    lanes = min(lanes, len(order))
    if not lanes:
        return total
    queue, dealt = [(0, k) for k in range(lanes)], [[] for _ in range(lanes)]
    for i in order:
        size, lane = heapq.heappop(queue)
        dealt[lane].append(i)
        heapq.heappush(queue, (size + len(texts[i]), lane))
    dealt.sort(key=lambda own: -sum(len(texts[i]) for i in own))
    lengths = np.array([sum(len(texts[i]) for i in own) for own in dealt])
    aims = [np.concatenate([texts[i] for i in own]) for own in dealt]
    of = [np.repeat(own, [len(texts[i]) for i in own]) for own in dealt]
    state = np.zeros((lanes, net.hidden), np.float32)
    for start in range(0, int(lengths[0]), window):
        live = int((lengths > start).sum())
        size = min(window, int(lengths[0]) - start)
        aim, doc = np.zeros((size, live), np.int64), np.full((size, live), -1, np.int64)
        before = np.zeros((size, live), np.int64)
        fresh = np.ones((size, live), bool)
        for k in range(live):
            n = min(size, lengths[k] - start)
            aim[:n, k], doc[:n, k] = aims[k][start : start + n], of[k][start : start + n]
            lag = of[k][start - 1 : start + n - 1] if start else np.r_[-1, of[k][: n - 1]]
            fresh[:n, k] = lag != doc[:n, k]
            before[:n, k] = aims[k][start - 1 : start + n - 1] if start else np.r_[0, aims[k][: n - 1]]
        before[fresh] = 0  # symbol 0 is the end: each text starts after one
        held, state = np.empty((size, live, net.hidden), np.float32), state[:live]
        keep = ~fresh
        for t in range(size):
            if not keep[t].all():
                state = state * keep[t][:, None]
            state = net.step(before[t], state)[0]
            held[t] = state
        on = np.flatnonzero(doc.ravel() >= 0)
        found = net.log_probability(held.reshape(-1, net.hidden)[on], aim.ravel()[on])
        total += np.bincount(doc.ravel()[on], found, len(texts))
    return total


@dataclass
class Vocabulary:
    """Counts of the leading words, and totals over all."""

    index: dict[bytes, int]
    counts: np.ndarray
    tokens: int
    distinct: int
    #: Tokens and distinct words that each rare symbol stands for.
    rare_tokens: np.ndarray
    rare_words: np.ndarray
    #: The symbol of each leading word; the last entry stands for words that lead not.
    symbols: np.ndarray | None = None

    @property
    def named(self) -> int:
        """Leading words with a symbol of their own; symbol 0 is the end."""
        return min(len(self.counts), CLASSES * MEMBERS - RARE - 1)

    def encode(self, text: bytes | None) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Words, their places among the leading words (or -1), and symbols with the end."""
        found = words(text)
        return found, *self.encode_words(found)

    def encode_words(self, found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        at = np.fromiter(map(self.index.get, found, repeat(-1)), np.int64, len(found))
        if self.symbols is None:
            first = CLASSES * MEMBERS - RARE
            self.symbols = np.array([i + 1 if i < self.named else first + form(w) for w, i in self.index.items()] + [-1], np.int64)
        out = np.zeros(len(found) + 1, np.int64)
        out[:-1] = self.symbols[at]
        for k in np.flatnonzero(at < 0).tolist():
            out[k] = CLASSES * MEMBERS - RARE + form(found[k])
        return at, out


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Rows (word, n) over whole texts: counted in each task, then added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[bytes, int] = {}

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(list(own), pa.binary()), pa.array(list(own.values()), pa.int64())], ["word", "n"])
            own.clear()
            return out

        for batch in batches:
            for t in batch.column(0).to_pylist():
                for w in words(t):
                    own[w] = own.get(w, 0) + 1
                if len(own) > 400_000:
                    yield flush()
        yield flush()

    return docs.select(raw(text)).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(counts: DataFrame, documents: int, shared: int = SHARED) -> Vocabulary:
    """The leading words go to the driver; of all others only totals by form do.

    Words lead that occur more often than a least count, the smallest that leaves no more
    than ``shared`` of them: found from the number of words of each count, so that no task
    sends more than its own leading words.
    """
    kinds, least = 0, 0
    for n, k in counts.groupBy("n").agg(F.count("*").alias("k")).orderBy(F.desc("n")).toLocalIterator():
        kinds += k
        if kinds > shared:
            least = n
            break
    top = counts.where(F.col("n") > least).toPandas().sort_values(["n", "word"], ascending=[False, True])
    names, n = [bytes(w) for w in top["word"]], top["n"].to_numpy(np.int64)
    index = {w: i for i, w in enumerate(names)}
    named = min(len(n), CLASSES * MEMBERS - RARE - 1)

    def by_form(batch: pa.RecordBatch) -> pa.RecordBatch:
        at = np.array([form(w) for w in batch.column(0).to_pylist()], np.int64)
        tokens = np.bincount(at, batch.column(1).to_numpy(), RARE)
        return pa.RecordBatch.from_arrays([pa.array(np.arange(RARE)), pa.array(tokens.astype(np.int64)), pa.array(np.bincount(at, minlength=RARE))], ["form", "tokens", "words"])

    tokens, distinct = np.zeros(RARE, np.int64), np.zeros(RARE, np.int64)
    for k, a, b in map_arrow(counts, by_form, "form long, tokens long, words long").groupBy("form").agg(F.sum("tokens"), F.sum("words")).collect():
        tokens[k], distinct[k] = a, b
    total, kinds = int(tokens.sum()), int(distinct.sum())
    for w, c in zip(names[:named], n[:named]):
        tokens[form(w)] -= c
        distinct[form(w)] -= 1
    return Vocabulary(index, n, total + documents, kinds + (1 if documents else 0), tokens, distinct)


def fit(docs: DataFrame, counts: DataFrame, key: str = "doc_id", text: str = "text", rounds: int = ROUNDS, shared: int = SHARED) -> tuple[Vocabulary, Network]:
    """Vocabulary and network of the texts of ``docs``, whose words ``counts`` has.

    In each round every task trains a copy of the network on its own whole documents of
    that round; the copies are averaged in a tree, weighted by their tokens.
    """
    spark = docs.sparkSession
    n = docs.count()
    vocab = vocabulary(counts, n, shared)
    weight = np.zeros(CLASSES * MEMBERS)
    weight[0], weight[1 : vocab.named + 1], weight[-RARE:] = n, vocab.counts[: vocab.named], vocab.rare_tokens
    net = Network.fresh(weight)
    given = spark.sparkContext.broadcast(vocab)
    source = docs.select(raw(text).alias("t"), F.xxhash64(key, F.lit(5)).alias("h"))
    for k in range(rounds if n else 0):
        start = spark.sparkContext.broadcast(net.flat)

        def run(batches: Iterator[pa.RecordBatch], k=k, start=start) -> Iterator[pa.RecordBatch]:
            one_thread()
            own, seen, texts, held = Network(start.value.copy()), 0, [], 0
            for batch in batches:
                for t in batch.column(0).to_pylist():
                    texts.append(np.r_[0, given.value.encode(t)[2]].astype(np.int16))
                    held += len(texts[-1])
                    if held > HELD:
                        seen += train(own, texts, seed=k)
                        texts, held = [], 0
            seen += train(own, texts, seed=k)
            yield pa.RecordBatch.from_arrays([pa.array([np.r_[own.flat.astype(float) * seen, seen].tobytes()], pa.binary())], ["state"])

        total = tree_sum(source.where(F.pmod("h", F.lit(rounds)) == k).select("t").mapInArrow(run, "state binary"))
        if total is not None and total[-1] > 0:
            net = Network((total[:-1] / total[-1]).astype(np.float32))
    return vocab, net


def score(docs: DataFrame, counts: DataFrame, vocab: Vocabulary, net: Network, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, n_tokens, n_known, train_tokens, base_score, score) of each whole text.

    ``base_score`` is the add-one unigram log10 probability of the words and the end,
    ``score`` the network's: a leading word's symbol, or a rare symbol and then the word
    by its count among the words of that form (one more for a word never seen). Counts of
    words beyond the shared ones come by a join, one row for each such word of a document.
    Null texts are empty. Rows without a key are left out; repeated rows come out repeated.
    Where nothing was learned the scores are equal. Other columns are ignored.
    """
    spark = docs.sparkSession
    given = spark.sparkContext.broadcast((vocab, net))
    log_n = float(np.log10(vocab.tokens + vocab.distinct + 1))
    ends = int(vocab.tokens - (vocab.rare_tokens.sum() + vocab.counts[: vocab.named].sum()))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        one_thread()
        vocab, net = given.value
        logs = np.log10(vocab.counts + 1.0)
        rare_log = np.log10(vocab.rare_tokens + vocab.rare_words + 1.0)
        sequences, known, base, model, rest, times, cuts = [], [], [], [], [], [], [0]
        for t in batch.column(1).to_pylist():
            found, at, symbols = vocab.encode(t)
            lead, others = at[at >= 0], np.flatnonzero(at < 0).tolist()
            forms = symbols[symbols >= CLASSES * MEMBERS - RARE] - (CLASSES * MEMBERS - RARE)
            known.append(len(lead) + (ends > 0))
            base.append(float(logs[lead].sum() + np.log10(ends + 1.0)))
            model.append(float(logs[lead[lead >= vocab.named]].sum() - rare_log[forms].sum()))
            own: dict[bytes, int] = {}
            for k in others:
                own[found[k]] = own.get(found[k], 0) + 1
            rest += own.keys()
            times += own.values()
            cuts.append(len(rest))
            sequences.append(symbols)
        n = np.array([len(s) for s in sequences])
        model = document_scores(net, sequences) / np.log(10) + np.array(model) if vocab.tokens else np.array(base) - n * log_n
        rest = pa.StructArray.from_arrays([pa.array(rest, pa.binary()), pa.array(times, pa.int64())], ["word", "k"])
        rest = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), rest)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(known, pa.int64()),
                                           pa.array(np.array(base) - n * log_n), pa.array(model), rest],
                                          [key, "n_tokens", "known", "base", "model", "rest"])

    source = docs.where(F.col(key).isNotNull()).select(key, raw(text).alias("#t"))
    kind = docs.schema[key].dataType.simpleString()
    scored = map_arrow(source, run, f"`{key}` {kind}, n_tokens long, known long, base double, model double, rest array<struct<word:binary,k:long>>", rows=2048)
    # The number is written with the row: it tells repeated rows apart and stays the same for every reader.
    scored = durable(scored.withColumn("#row", F.monotonically_increasing_id()))
    each = scored.select("#row", F.explode("rest").alias("w")).select("#row", "w.word", "w.k")
    met = each.join(counts, "word", "left").groupBy("#row").agg(
        F.sum(F.col("k") * F.log10(F.coalesce("n", F.lit(0)) + 1)).alias("more"), F.sum(F.when(F.col("n") > 0, F.col("k"))).alias("met"))
    more = F.coalesce("more", F.lit(0.0))
    return scored.drop("rest").join(met, "#row", "left").select(
        key, "n_tokens", (F.col("known") + F.coalesce("met", F.lit(0))).alias("n_known"), F.lit(vocab.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + more).alias("base_score"), (F.col("model") + more).alias("score"))
