"""A convolutional text classifier for toxic documents, trained in numpy.

A word (lower case, without punctuation) is the sum of hashed embeddings of itself and of its first letters;
filters of one to three words slide over the whole text, the largest response of each is pooled, and a logistic
unit weighs them. Embeddings start at zero, so a word unlike all training words is neutral. Each language has its
own threshold, set on labelled documents held out from training. The model's size is fixed, whatever the corpus.
"""

from __future__ import annotations

import copy
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.llm import common as c

BUCKETS, DIMS, FILTERS, WIDTHS = 1 << 19, 8, 8, (1, 2, 3)
PREFIXES = (3, 4, 5, 6)
_PAD = max(WIDTHS) - 1
_strip = re.compile(r"[\W_]+").sub
_SCORES = pa.schema([("doc_id", pa.int64()), ("toxicity", pa.float64()), ("toxic", pa.bool_())])


def features(words: list[str]) -> np.ndarray:
    """Buckets of each word and its prefixes; a word without letters or digits, or too short a one, fills with -1."""
    out = np.full((len(words), len(PREFIXES) + 1), -1, np.int32)
    h = xxhash.xxh3_64_intdigest
    for row, word in zip(out, words):
        word = _strip("", word.lower())
        if word:
            row[0] = h(word) % BUCKETS
            for k, n in enumerate(PREFIXES, 1):
                if len(word) <= n:
                    break
                row[k] = h(word[:n], 1) % BUCKETS
    return out


@dataclass
class Net:
    table: np.ndarray  # (BUCKETS + 1, DIMS); the last row is zero and stands for -1
    filters: list[np.ndarray]  # for each width (width, DIMS, FILTERS)
    bias: np.ndarray
    out: np.ndarray
    offset: float
    thresholds: dict[str | None, float]  # None: of languages without labels

    def words(self, feats: np.ndarray) -> np.ndarray:
        return self.table[feats].sum(axis=1, dtype=np.float32)

    def responses(self, embedded: np.ndarray, codes: np.ndarray) -> list[np.ndarray]:
        """For each width, the response of a window that starts at each padded position."""
        out = []
        for width, f in zip(WIDTHS, self.filters):
            n = len(codes) - _PAD
            r = (embedded @ f[0])[codes[:n]]
            for j in range(1, width):
                r += (embedded @ f[j])[codes[j : n + j]]
            out.append(r)
        return out

    def logits(self, offsets: np.ndarray, codes: np.ndarray, embedded: np.ndarray) -> np.ndarray:
        """One for each document, of codes into ``embedded``; a document without words is judged on padding."""
        starts, ends, padded = pad(offsets, codes, len(embedded))
        embedded = np.vstack([embedded, np.zeros((1, DIMS), np.float32)])
        bounds = np.stack([starts, ends], axis=1).reshape(-1)
        pooled = [np.maximum.reduceat(r, bounds, axis=0)[::2] for r in self.responses(embedded, np.append(padded, np.full(_PAD, len(embedded) - 1)))]
        hidden = np.maximum(np.hstack(pooled) + self.bias, 0)
        return hidden @ self.out + self.offset

    def threshold(self, lang: str | None) -> float:
        return self.thresholds.get(lang, self.thresholds[None])


def pad(offsets: np.ndarray, codes: np.ndarray, fill: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each document's windows start and end, and codes with padding after each document.

    A document's last window is padding throughout, so none reaches into the next document.
    """
    n, gap = np.diff(offsets), _PAD + 1
    starts = offsets[:-1] + np.arange(len(n)) * gap
    out = np.full(len(codes) + len(n) * gap, fill, np.int64)
    out[np.arange(len(codes)) + np.repeat(np.arange(len(n)) * gap, n)] = codes
    return starts, starts + n + 1, out


@dataclass
class Gradients:
    """Of the loss (mean weighted cross-entropy) of some documents."""

    filters: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    offset: float
    words: np.ndarray  # of each row of ``embedded``; the last is padding


def gradients(net: Net, embedded: np.ndarray, starts: np.ndarray, ends: np.ndarray, padded: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Gradients:
    """embedded: word vectors and, last, padding; padded: rows of it, those of a document from its start to its end."""
    best = []
    for r in net.responses(embedded, padded):
        at = np.stack([s + r[s:e].argmax(axis=0) for s, e in zip(starts, ends)])
        best.append((at, np.take_along_axis(r, at, axis=0)))
    hidden = np.maximum(np.hstack([b[1] for b in best]) + net.bias, 0)
    p = 1 / (1 + np.exp(-np.clip(hidden @ net.out + net.offset, -30, 30)))
    error = ((p - y) * weight / len(y)).astype(embedded.dtype)
    down = np.outer(error, net.out) * (hidden > 0)
    filters = []
    words = np.zeros_like(embedded)
    for k, (width, (at, _)) in enumerate(zip(WIDTHS, best)):
        g = down[:, k * FILTERS : (k + 1) * FILTERS]
        d = np.zeros_like(net.filters[k])
        for j in range(width):
            at_word = padded[at + j]
            d[j] = np.einsum("nf,nfd->df", g, embedded[at_word])
            np.add.at(words, at_word.reshape(-1), (g[:, :, None] * net.filters[k][j].T[None]).reshape(-1, DIMS))
        filters.append(d)
    return Gradients(filters, down.sum(axis=0), hidden.T @ error, float(error.sum()), words)


def blank(rng: np.random.Generator) -> tuple[Net, list[np.ndarray]]:
    """A net before training, and the squared gradients of its table and of each of dense()."""
    net = Net(
        np.zeros((BUCKETS + 1, DIMS), np.float32),
        [rng.normal(0, 0.5, (w, DIMS, FILTERS)).astype(np.float32) for w in WIDTHS],
        np.full(FILTERS * len(WIDTHS), 0.1, np.float32),
        rng.normal(0, 0.5, FILTERS * len(WIDTHS)).astype(np.float32),
        0.0,
        {None: 0.0},
    )
    return net, [np.zeros_like(net.table)] + [np.zeros_like(f) for f in net.filters] + [np.zeros_like(net.bias), np.zeros_like(net.out), np.zeros(1, np.float32)]


def dense(net: Net) -> list[np.ndarray]:
    """All parameters but the table; the offset as a copy."""
    return [*net.filters, net.bias, net.out, np.array([net.offset])]


def toxic_share(toxic: int, count: int) -> float:
    return min(max(toxic / count if count else 0.5, 0.02), 0.98)


def epoch(net: Net, spent: list[np.ndarray], offsets: np.ndarray, codes: np.ndarray, feats: np.ndarray, y: np.ndarray, share: float, rng: np.random.Generator, batch: int, rate: float) -> None:
    """Take each document once, in random order, ``batch`` at a step. share: of toxic documents among all there are."""
    weight = np.where(y > 0, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)

    def step(value: np.ndarray, used: np.ndarray, grad: np.ndarray) -> None:
        used += grad * grad
        value -= rate * grad / (np.sqrt(used) + 1e-6)

    order = rng.permutation(len(y))
    for a in range(0, len(order), batch):
        docs = order[a : a + batch]
        n = offsets[docs + 1] - offsets[docs]
        flat = codes[np.repeat(offsets[docs], n) + c.ranges(n)]
        seen, inverse = np.unique(flat, return_inverse=True)
        embedded = np.vstack([net.words(feats[seen]), np.zeros((1, DIMS), np.float32)])
        starts, _, padded = pad(np.concatenate([[0], np.cumsum(n)]), inverse, len(seen))
        padded = np.append(padded, np.full(_PAD, len(seen)))
        g = gradients(net, embedded, starts, starts + n + 1, padded, y[docs], weight[docs])
        moved = np.flatnonzero(np.abs(g.words[:-1]).sum(axis=1))
        rows, back = np.unique(feats[seen[moved]], return_inverse=True)
        d_rows = np.zeros((len(rows), DIMS), np.float32)
        np.add.at(d_rows, back.reshape(-1), np.repeat(g.words[moved], feats.shape[1], axis=0))
        d_rows, rows = d_rows[rows >= 0], rows[rows >= 0]
        used = spent[0][rows] + d_rows * d_rows
        spent[0][rows] = used
        net.table[rows] -= rate * d_rows / (np.sqrt(used) + 1e-6)
        for k, d in enumerate(g.filters):
            step(net.filters[k], spent[1 + k], d)
        step(net.bias, spent[-3], g.bias)
        step(net.out, spent[-2], g.out)
        spent[-1] += g.offset**2
        net.offset -= float(rate * g.offset / (np.sqrt(spent[-1][0]) + 1e-6))


def fit(texts: list[str], toxic: np.ndarray, epochs: int = 8, batch: int = 64, rate: float = 0.1, seed: int = 7, least_documents: int = 2) -> Net:
    """Train on labelled texts; both classes weigh the same. Words and prefixes that fewer than ``least_documents`` of the
    texts have stay at zero, as words never seen do: what one document alone has can't be told from its topic."""
    rng = np.random.default_rng(seed)
    net, spent = blank(rng)
    offsets, codes, words = c.word_codes(pa.array(texts, pa.large_string()))
    feats = features(words)
    seen_in = _documents(offsets, codes, feats)
    feats[seen_in[feats] < least_documents] = -1
    y = toxic.astype(np.float32)
    for _ in range(epochs):
        epoch(net, spent, offsets, codes, feats, y, toxic_share(int(y.sum()), len(y)), rng, batch, rate)
    return net


def fit_rows(rows: DataFrame, chains: int, epochs: int = 8, batch: int = 64, rate: float = 0.1, seed: int = 7, least_documents: int = 2) -> Net:
    """fit() on every row of doc_id, text, toxic, however many. Each of ``chains`` tasks or fewer takes its part of them
    from the same net in slices; then the nets are averaged, an embedding over the tasks that moved it, and the next of
    ``epochs`` rounds begins. The driver holds one net and adds up pieces of others; a task holds a net and a slice."""
    spark = rows.sparkSession
    parts = rows.select(F.pmod(F.xxhash64("doc_id"), F.lit(chains)).cast("int").alias("chain"), "doc_id", "text", "toxic").repartitionById(chains, F.col("chain"))
    parts = parts.sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", "toxic", "text").select("text", "toxic")
    coded = c.keep(parts.mapInArrow(_coded, _CODED), "training")
    seen_in = np.zeros(BUCKETS + 1, np.int64)
    for r in coded.where("seen IS NOT NULL").select("seen").toLocalIterator():
        seen_in += c.unpack(r["seen"])[0]
    n, toxic = coded.agg(F.sum("docs"), F.sum("toxic")).first()
    share, rare = toxic_share(toxic or 0, n or 0), seen_in < least_documents
    net, spent = blank(np.random.default_rng(seed))
    for k in range(epochs):
        shared = spark.sparkContext.broadcast((net, spent, rare))

        @c.tidy
        def run(batches: Iterator[pa.RecordBatch], shared=shared, k=k) -> Iterator[pa.RecordBatch]:
            old, old_spent, rare = shared.value
            net, spent = copy.deepcopy((old, old_spent))  # other tasks begin from these too
            rng, docs = np.random.default_rng([seed, k]), 0
            for b in batches:
                for blob in b.column("part"):
                    lengths, codes, feats, y = c.unpack(blob.as_py())
                    feats = feats.reshape(-1, len(PREFIXES) + 1)
                    epoch(net, spent, np.concatenate([[0], np.cumsum(lengths)]), codes, np.where(rare[feats], -1, feats), y.astype(np.float32), share, rng, batch, rate)
                    docs += len(y)
            if docs:
                yield from _changes(old, old_spent, net, spent, docs)

        done = c.keep(coded.where("part IS NOT NULL").select("part").mapInArrow(run, _CHANGES), "round")
        _average(net, spent, done)
        c.forget(done)
        shared.destroy()
    c.forget(coded)
    return net


_CODED = "docs long, toxic long, seen binary, part binary"
_CHANGES = "docs long, rows binary, rest binary"


@c.tidy
def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What epoch() needs, a row for each slice; last, how many of the documents have each feature."""
    row = lambda *x: pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(x, (pa.int64(), pa.int64(), pa.binary(), pa.binary()))], ["docs", "toxic", "seen", "part"])
    seen = np.zeros(BUCKETS + 1, np.int64)
    for batch in batches:
        for part in c.slices(batch):
            offsets, codes, words = c.word_codes(part.column("text"))
            feats, y = features(words), part.column("toxic").to_numpy().astype(np.int8)
            seen += _documents(offsets, codes, feats)
            yield row(len(y), int(y.sum()), None, c.pack(np.diff(offsets), codes, feats.reshape(-1), y))
    yield row(0, 0, c.pack(seen), None)


def _changes(old: Net, old_spent: list[np.ndarray], net: Net, spent: list[np.ndarray], docs: int) -> Iterator[pa.RecordBatch]:
    """How far each embedding that moved has moved, in pieces; and the other parameters as they are."""
    row = lambda *x: pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(x, (pa.int64(), pa.binary(), pa.binary()))], ["docs", "rows", "rest"])
    moved = np.flatnonzero(((net.table != old.table) | (spent[0] != old_spent[0])).any(axis=1))
    for a in range(0, len(moved), 1 << 16):
        rows = moved[a : a + (1 << 16)]
        yield row(docs, c.pack(rows, (net.table[rows] - old.table[rows]).reshape(-1), (spent[0][rows] - old_spent[0][rows]).reshape(-1)), None)
    yield row(docs, None, c.pack(*(x.reshape(-1) for x in (*dense(net), *spent[1:]))))


def _average(net: Net, spent: list[np.ndarray], done: DataFrame) -> None:
    """Put into ``net`` and ``spent`` the mean of what the tasks of a round came to."""
    # sums in double precision hardly depend on the order in which rows come
    tables, by = [np.zeros(net.table.shape), np.zeros(net.table.shape)], np.zeros(len(net.table), np.int64)
    rest, docs = [np.zeros(x.size) for x in (*dense(net), *spent[1:])], 0
    for r in done.toLocalIterator():
        if r["rows"] is not None:
            rows, *moves = c.unpack(r["rows"])
            by[rows] += 1
            for total, m in zip(tables, moves):
                total[rows] += m.reshape(-1, DIMS)
        else:
            docs += r["docs"]
            for total, x in zip(rest, c.unpack(r["rest"])):
                total += r["docs"] * x.astype(float)
    for value, total in zip((net.table, spent[0]), tables):
        value += total / np.maximum(by, 1)[:, None]
    if docs:
        *params, offset = dense(net)
        for value, total in zip((*params, offset, *spent[1:]), rest):
            value[...] = (total / docs).reshape(value.shape)
        net.offset = float(offset[0])


def _documents(offsets: np.ndarray, codes: np.ndarray, feats: np.ndarray) -> np.ndarray:
    """How many training documents have each feature."""
    out = np.zeros(BUCKETS + 1, np.int64)
    for a in range(0, len(offsets) - 1, 200):
        bounds = offsets[a : a + 201]
        of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        once = np.unique(of * np.int64(len(feats)) + codes[bounds[0] : bounds[-1]])
        doc, word = once // len(feats), once % len(feats)
        pairs = np.unique((doc[:, None] * np.int64(BUCKETS + 1) + feats[word] % (BUCKETS + 1)).reshape(-1))
        out += np.bincount(pairs % (BUCKETS + 1), minlength=BUCKETS + 1)
    return out


def predict(net: Net, texts: pa.Array) -> np.ndarray:
    offsets, codes, words = c.word_codes(texts)
    return net.logits(offsets, codes, net.words(features(words)))


def calibrated(logits: np.ndarray, toxic: np.ndarray, weights: np.ndarray) -> float:
    """The threshold of the best weighted F1, in the middle of the gap it falls into."""
    order = np.argsort(-logits, kind="stable")
    z, y, w = logits[order], toxic[order].astype(float), weights[order]
    true = np.cumsum(y * w)
    f1 = 2 * true / (np.cumsum(w) + (y * w).sum() + 1e-12)
    last = np.append(z[1:] < z[:-1], True)  # equal scores fall on one side
    k = int(np.argmax(np.where(last, f1, -1)))
    return float((z[k] + z[k + 1]) / 2) if k + 1 < len(z) else float(z[k] - 1)


#: Text that the driver trains on by itself; and the text of a task beyond that, of which there are so many at most.
AT_ONCE, CHAIN_BYTES, CHAINS = 16 << 20, 32 << 20, 64


def train(docs: DataFrame, labels: DataFrame, per_class: int | None = None, held_out: float = 0.25, prior: float = 20.0, least_documents: int = 2, class_bytes: int | None = None, at_once: int = AT_ONCE, chain_bytes: int = CHAIN_BYTES) -> Net:
    """Train on all labelled documents: at the driver by fit() if they have no more than ``at_once`` bytes of text, else by
    fit_rows() in tasks of about ``chain_bytes``. Only on request, at most ``per_class`` documents and ``class_bytes`` of
    text of each language and label are taken, chosen by a hash of doc_id; a document that exceeds the bytes by itself is
    not chosen then.

    A share ``held_out`` of them sets the thresholds, weighed as the labels occur. A language's threshold is drawn to the
    threshold of all as if ``prior`` documents of its rarer class spoke for that: the fewer it has, the nearer it is. No
    threshold is below the score of a text without words. least_documents: see fit(). Rows with a null text, doc_id or label are not used, nor labels other than 0 and 1. Without a document of either class nothing counts as toxic.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IN (0, 1)").distinct()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held = c.mix(b.column("doc_id").to_numpy().view(np.uint64) + c.U64(99)) % c.U64(1000) < c.U64(round(1000 * held_out))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("toxic"), pa.array(held)], ["doc_id", "toxic", "held"])

    known = c.keep(known.mapInArrow(split, "doc_id long, toxic int, held boolean"), "labelled")
    texts = docs.where("text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    rows = texts.join(c.few(known), "doc_id")
    counts = lambda: rows.groupBy("lang", "toxic", "held").agg(F.count("*").alias("n"), F.sum(F.octet_length("text").cast("long")).alias("bytes")).collect()
    there = taken = counts()
    if per_class is not None or class_bytes is not None:
        rows = rows.join(F.broadcast(_sample(rows, per_class, class_bytes)), ["doc_id", "toxic"], "left_semi")
        taken = counts()
    classes = {h: {r["toxic"] for r in taken if r["held"] == h} for h in (True, False)}
    if classes[True] | classes[False] != {0, 1}:
        return Net(np.zeros((BUCKETS + 1, DIMS), np.float32), [np.zeros((w, DIMS, FILTERS), np.float32) for w in WIDTHS], np.zeros(FILTERS * len(WIDTHS), np.float32), np.zeros(FILTERS * len(WIDTHS), np.float32), 0.0, {None: np.inf})
    apart = classes[True] == classes[False] == {0, 1}  # else all train, and all set the thresholds
    if sum(r["bytes"] for r in taken) <= at_once:
        whole = rows.select("doc_id", "lang", "text", "toxic", "held").toArrow().sort_by([("doc_id", "ascending"), ("toxic", "ascending"), ("text", "ascending")])
        learn, judge = (whole.filter(pc.invert(whole["held"])), whole.filter(whole["held"])) if apart else (whole, whole)
        net = fit(learn["text"].to_pylist(), learn["toxic"].to_numpy().astype(int), least_documents=least_documents)
        text = judge["text"].combine_chunks()
        z = np.concatenate([predict(net, part.column("text")) for part in c.slices(pa.record_batch({"text": text}))])
        y, lang = judge["toxic"].to_numpy().astype(int), judge["lang"]
        del whole, learn, judge, text
    else:
        size = sum(r["bytes"] for r in taken if not (apart and r["held"]))
        net = fit_rows(rows.where("NOT held") if apart else rows, min(CHAINS, -(-size // chain_bytes)), least_documents=least_documents)
        judged = logits(rows.where("held") if apart else rows, net).toArrow()  # a few bytes for each document held out
        z, y, lang = judged["z"].to_numpy(), judged["toxic"].to_numpy().astype(int), judged["lang"]
    lang = np.array(lang.to_pylist(), dtype=object)
    net.thresholds = thresholds(z, y, lang, _ratios(there, taken), prior)
    # rounding differs a little between batches, hence the margin
    neutral = float(predict(net, pa.array([""]))[0]) + 1e-3
    net.thresholds = {k: max(t, neutral) for k, t in net.thresholds.items()}
    c.trim()  # the driver has other work after this
    return net


def _sample(rows: DataFrame, per_class: int | None, class_bytes: int | None) -> DataFrame:
    """doc_id and toxic of the documents that train() takes where it is given bounds."""
    per_class, class_bytes = (1 << 62 if x is None else x for x in (per_class, class_bytes))
    rank = Window.partitionBy("lang", "toxic").orderBy(F.xxhash64("doc_id"), "doc_id")
    sizes = rows.select("doc_id", "lang", "toxic", F.octet_length("text").cast("long").alias("bytes"))
    first = sizes.where(F.col("bytes") <= class_bytes).withColumn("k", F.row_number().over(rank)).where(F.col("k") <= per_class)
    return c.keep(first.withColumn("all", F.sum("bytes").over(rank.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("all") <= class_bytes).select("doc_id", "toxic").distinct(), "chosen")


def _ratios(there: list, taken: list) -> dict[tuple[str | None, int], float]:
    """How many labelled documents of a language and label each one taken stands for."""
    a, b = Counter(), Counter()
    for counter, found in ((a, there), (b, taken)):
        for r in found:
            counter[r["lang"], r["toxic"]] += r["n"]
    return {key: a[key] / n for key, n in b.items()}


def thresholds(z: np.ndarray, y: np.ndarray, lang: np.ndarray, ratios: dict[tuple[str | None, int], float], prior: float) -> dict[str | None, float]:
    w = np.array([ratios[key] for key in zip(lang, y.tolist())], float)
    out = {None: calibrated(z, y, w)}
    for key in set(lang) - {None}:
        mine = lang == key
        if k := int(min((y[mine] == 0).sum(), (y[mine] == 1).sum())):
            out[key] = (k * calibrated(z[mine], y[mine], w[mine]) + prior * out[None]) / (k + prior)
    return out


def logits(rows: DataFrame, net: Net) -> DataFrame:
    """lang, toxic and z, what the net says before any threshold, of each row."""
    model = rows.sparkSession.sparkContext.broadcast(net)

    @c.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = model.value
        for batch in batches:
            for part in c.slices(batch):
                yield pa.RecordBatch.from_arrays([part.column("lang"), part.column("toxic"), pa.array(predict(net, part.column("text")).astype(float))], ["lang", "toxic", "z"])

    return rows.select("lang", "toxic", "text").mapInArrow(run, "lang string, toxic int, z double")


def _over(net: Net, docs: DataFrame, schema: str | object, emit) -> DataFrame:
    model = docs.sparkSession.sparkContext.broadcast(net)

    @c.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = model.value
        for batch in batches:
            for part in c.slices(batch):
                text = part.column("text")
                absent = pc.is_null(text).to_numpy(zero_copy_only=False)
                z = predict(net, text)
                limits = np.array([net.threshold(x) for x in part.column("lang").cast(pa.string()).to_pylist()])
                yield emit(part, z, absent, (z > limits) & ~absent)

    return docs.mapInArrow(run, schema)


def score(docs: DataFrame, net: Net) -> DataFrame:
    """doc_id, toxicity (a probability) and toxic (above the language's threshold) of every row.

    docs needs doc_id, text and lang. A null text has null toxicity and isn't toxic; an empty text is scored as no
    words, a text of any length whole; a null or unknown lang takes the threshold of all languages; a null doc_id stays
    null. Repeated rows are scored each; other columns, of whatever name, are ignored; an empty table gives no rows.
    """

    def emit(part: pa.RecordBatch, z: np.ndarray, absent: np.ndarray, toxic: np.ndarray) -> pa.RecordBatch:
        p = 1 / (1 + np.exp(-np.clip(z.astype(float), -700, 700)))
        return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(p, mask=absent), pa.array(toxic)], schema=_SCORES)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    return _over(net, rows, "doc_id long, toxicity double, toxic boolean", emit)


def clean(docs: DataFrame, net: Net) -> DataFrame:
    """The rows that score() doesn't call toxic, with all their columns: null and empty texts, null ids and repeated rows
    stay as they are; an empty table gives no rows."""
    return _over(net, docs, docs.schema, lambda part, z, absent, toxic: part.filter(pa.array(~toxic)))
