"""Toxicity by nearest labelled examples: exact TF-IDF cosine, block-max inverted index, weighted votes.

The index holds labelled examples from outside the held-out fold, ``PER_LABEL`` of each label in expectation, drawn by a
hash of the id. Its terms are all words of all examples. Where chi-square over the examples says that they tell the
labels apart, beginnings of words (four to seven letters) are terms too, and so is "these make up at least 1/256, 1/128,
1/64 of the words". A term weighs (1 + ln count) * idf * telling: idf from all documents, telling the square root of its
chi-square, 1 where that is within chance. Supports are counted once per group of near copies.

Examples stand in blocks, those of one weightiest term together; each term keeps its largest weight per block, so the
sum of a document's weights times those bounds the cosine in a block. Blocks are scored exactly in falling order of the
bound until no bound reaches the k-th best: the neighbours are exact. An example's vote weighs the square of
its cosine over its label's drawing rate. The share of toxic votes is turned into a probability by isotonic regression, fitted on
the quarter of the examples (whole groups of near copies) that the index and the weights do without.

Null and empty texts, and texts that share no term with an example, score the prior. Equal cosines go to the smaller id.
Without labelled rows of both labels every score is the prior, 0 without any. Repeated ids among labels count once, toxic if any
is; all texts of an id among documents are examples under its label. Repeated documents are rows of their own; an
empty table gives an empty result; very long texts are counted whole; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.textkernel import Powers, PrefixHash, cut, held_out, mix, over_text, word_bounds

PER_LABEL = 2000
SUPPORT = 3
NEIGHBOURS = 12
BLOCK = 128
DENSE = 8
PREFIXES = (4, 5, 6, 7)
#: Shares of a document's words, as 1 / level, from which on a word or beginning counts as frequent.
LEVELS = (256, 128, 64)
#: One in so many groups of near copies is for calibration.
CALIBRATE = 4
THRESHOLD = 0.7
#: Word bytes: as elsewhere, and the apostrophe.
_KEEP = bytes(c if chr(c).isalnum() and c < 128 or c >= 128 or c == 39 else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    return text.lower().encode().translate(_KEEP).split()


def beginnings(word: bytes) -> list[bytes]:
    """Inflected and compound forms share those."""
    if len(word) < PREFIXES[0]:
        return []
    if word.isascii():
        return [word[:n] for n in PREFIXES if len(word) >= n]
    w = word.decode(errors="replace")
    return [w[:n].encode() for n in PREFIXES if len(w) >= n]


def _copy_group(raw: bytes, powers: Powers) -> int:
    """Least hash of the five-word shingles: near copies mostly share it."""
    data = np.frombuffer(raw, np.uint8)
    starts, ends, _ = word_bounds(data, np.array([0, len(data)]))
    if not len(starts):
        return 0
    h, n = PrefixHash(data, powers).of(starts, ends), min(5, len(starts))
    total = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        total = total * np.uint64(0x100000001B3) + h[i : len(h) - n + 1 + i]
    return int(mix(total).min().view(np.int64))


def _ranges(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """start[0]..end[0]-1, start[1]..end[1]-1, and so on."""
    n = end - start
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())


class Examples:
    """Labelled texts: the words of each with their counts, as runs of arrays. Terms are numbers: words first, then beginnings
    (``names`` has both), then what is frequent. Those that are not words are made a few texts at a time, by ``terms``."""

    def __init__(self, rows: list[tuple[int, int, int, bytes, bytes]], rates: list[float]) -> None:
        rows = sorted(rows)
        self.doc, self.toxic, self.group = (np.array([r[k] for r in rows], np.int64) for k in range(3))
        self.rate = np.array(rates)[self.toxic] if len(rows) else np.zeros(0)
        words: dict[bytes, int] = {}
        own = [np.array([words.setdefault(w, len(words)) for w in r[3].split()], np.int32) for r in rows]
        self.start = np.concatenate([[0], np.cumsum([len(o) for o in own], dtype=np.int64)])
        self.word, self.count = np.concatenate([*own, np.zeros(0, np.int32)]), np.frombuffer(b"".join(r[4] for r in rows), np.int32)
        stems: dict[bytes, int] = {}
        of = [np.array([stems.setdefault(b, len(words) + len(stems)) for b in beginnings(w)], np.int32) for w in words]
        self.first = np.concatenate([[0], np.cumsum([len(o) for o in of], dtype=np.int64)])
        self.stems = np.concatenate([*of, np.zeros(0, np.int32)])  # the beginnings of each word
        self.words, self.names = len(words), [*words, *stems]

    def __len__(self) -> int:
        return len(self.doc)

    @property
    def size(self) -> int:
        """Terms that there can be."""
        return len(self.names) * (1 + len(LEVELS))

    def of(self, mask: np.ndarray) -> Examples:
        out = Examples.__new__(Examples)
        vars(out).update(vars(self))
        out.doc, out.toxic, out.group, out.rate = (x[mask] for x in (self.doc, self.toxic, self.group, self.rate))
        at = np.flatnonzero(mask)
        runs = _ranges(self.start[at], self.start[at + 1])
        out.word, out.count, out.start = self.word[runs], self.count[runs], np.concatenate([[0], np.cumsum(self.start[at + 1] - self.start[at])])
        return out

    def terms(self, rows: int = 256):
        """(row, term, count) of some texts at a time, by row; a count of 0 is that of a term which is not a word."""
        names = len(self.names)
        for i in range(0, len(self), rows):
            j = min(i + rows, len(self))
            word, count = (x[self.start[i] : self.start[j]].astype(np.int64) for x in (self.word, self.count))
            row = np.repeat(np.arange(i, j), np.diff(self.start[i : j + 1]))
            n = self.first[word + 1] - self.first[word]
            key, at = np.unique(np.repeat(row, n) * max(names, 1) + self.stems[_ranges(self.first[word], self.first[word + 1])], return_inverse=True)
            total = np.concatenate([count, np.bincount(at, np.repeat(count, n), len(key)).astype(np.int64)])
            rows_, stem = np.concatenate([row, key // max(names, 1)]), np.concatenate([word, key % max(names, 1)])
            length = np.bincount(row - i, count, j - i)[rows_ - i]
            out = [(row, word, count), (rows_[len(row) :], stem[len(row) :], np.zeros(len(key), np.int64))]
            for k, v in enumerate(LEVELS):
                many = (total > 1) & (total * v >= length)
                out.append((rows_[many], names + stem[many] * len(LEVELS) + k, np.zeros(many.sum(), np.int64)))
            r, t, c = (np.concatenate(x) for x in zip(*out))
            order = np.lexsort((t, r))
            yield r[order], t[order], c[order]

    def speakers(self) -> tuple[np.ndarray, np.ndarray]:
        """Which speak for their group of near copies, those of the smallest id; and labels, toxic if any of the group is."""
        groups, first, at = np.unique(self.group, return_index=True, return_inverse=True)
        mask = np.zeros(len(self), bool)
        mask[first] = True
        toxic = np.zeros(len(groups), np.int64)
        np.maximum.at(toxic, at, self.toxic)
        return mask, toxic[at]


def telling(x: Examples) -> tuple[np.ndarray, np.ndarray]:
    """For each term the root of its chi-square where it is beyond chance, else 1; and which are."""
    speaks, toxic = x.speakers()
    n, t = np.zeros(x.size), np.zeros(x.size)
    for row, term, _ in x.terms():
        own = speaks[row]
        n += np.bincount(term[own], minlength=x.size)
        t += np.bincount(term[own], toxic[row[own]], x.size)
    total, bad = float(speaks.sum()), float(toxic[speaks].sum())
    chance = 2 * math.log(max(int((n >= SUPPORT).sum()), 2)) + 4
    gap = t * total - n * bad
    chi = gap * gap * total / np.maximum(n * (total - n) * bad * (total - bad), 1e-9)
    sure = (n >= SUPPORT) & (n < total) & (chi >= chance)
    return np.where(sure, np.sqrt(chi), 1.0), sure


def draw_examples(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> tuple[Examples, float]:
    """The drawn examples with all their terms, and the share of toxic rows among all labelled ones."""
    rated = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy(F.col("doc_id").cast("long")).agg((F.max(F.col("toxic").cast("int")) > 0).cast("int").alias("toxic"))
    n = {r["toxic"]: r["count"] for r in rated.groupBy("toxic").count().collect()}
    rates = [min(1.0, per_label / max(n.get(k, 0), 1)) for k in (0, 1)]
    draw = F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1 << 30)) / float(1 << 30)
    drawn = cut(rated.filter(draw < F.when(F.col("toxic") == 1, rates[1]).otherwise(rates[0])))
    texts = docs.filter(F.col("text").isNotNull()).select(F.col("doc_id").cast("long"), "text")
    texts = texts.join(F.broadcast(drawn), "doc_id").dropDuplicates()  # about 2 * per_label rows, broadcast two numbers each

    def make():
        powers = Powers()

        def work(texts: pa.Array) -> list[pa.Array]:
            own = [t.as_py() for t in texts]
            counts = [Counter(words_of(t)) for t in own]
            groups = [_copy_group(t.lower().encode(), powers) for t in own]
            return [pa.array(groups, pa.int64()), pa.array([b" ".join(c) for c in counts], pa.binary()), pa.array([np.array(list(c.values()), np.int32).tobytes() for c in counts], pa.binary())]

        return work

    rows = over_text(texts, make, "grp long, words binary, counts binary", ["doc_id", "toxic"]).collect()
    share = n.get(1, 0) / max(sum(n.values()), 1)
    return Examples([(r["doc_id"], r["toxic"], r["grp"], bytes(r["words"]), bytes(r["counts"])) for r in rows], rates), share


class Space:
    """The terms of the index, sorted, their weight beside idf, and how a text is searched for them."""

    def __init__(self, x: Examples) -> None:
        weight, used = telling(x)
        used[x.word] = True
        self.terms, self.weight = np.flatnonzero(used), weight[used]
        # Places of words; of beginnings, and of levels of either, where they tell.
        self.words: dict[bytes, int] = {}
        self.beginnings: dict[bytes, int] = {}
        self.levels: tuple[dict[bytes, list[tuple[int, int]]], ...] = ({}, {})
        for place, t in enumerate(self.terms.tolist()):
            if t < x.words:
                self.words[x.names[t]] = place
            elif t < len(x.names):
                self.beginnings[x.names[t]] = place
            else:
                stem, k = divmod(t - len(x.names), len(LEVELS))
                self.levels[int(stem >= x.words)].setdefault(x.names[stem], []).append((LEVELS[k], place))

    def parts(self) -> tuple:
        return self.words, self.beginnings, self.levels


def reader(places: dict[bytes, int], begins: dict[bytes, int], levels: tuple[dict, dict]):
    """Text -> places of its terms, and counts, from the parts of a space."""
    by_word, by_beginning = levels
    stems = {*begins, *by_beginning}
    heads = {b[: PREFIXES[0]] for b in stems}  # bytes, so a head may end inside a character

    def of(text: str | None) -> tuple[np.ndarray, np.ndarray]:
        words = words_of(text) if text else []
        ids, counts, more = [], [], {}
        for word, n in Counter(words).items():
            place = places.get(word)
            if place is not None:
                ids.append(place)
                counts.append(n)
                if n > 1 and word in by_word:
                    more[word, False] = n
            if word[: PREFIXES[0]] in heads:
                for b in beginnings(word):
                    if b in stems:
                        more[b, True] = more.get((b, True), 0) + n
        for (stem, begins_so), n in more.items():
            found = [p for v, p in (by_beginning if begins_so else by_word).get(stem, ()) if n > 1 and n * v >= len(words)]
            if begins_so and stem in begins:
                found.append(begins[stem])
            ids += found
            counts += [0] * len(found)
        return np.array(ids, np.int64), np.array(counts, np.int64)

    return of


def unit_weights(ids: np.ndarray, counts: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """(1 + ln count) * weight, scaled to length 1."""
    w = (1.0 + np.log(np.maximum(counts, 1))) * weight[ids]
    return w / np.sqrt((w * w).sum())


class BlockMax:
    """Inverted index over examples in blocks. Rows of (doc_id, toxic, weight of its vote, ids, unit weights).

    A term that more than one in ``DENSE`` examples have is a row of a matrix instead of a list of postings."""

    def __init__(self, rows: list[tuple[int, int, float, np.ndarray, np.ndarray]], terms: int) -> None:
        # Examples that share their weightiest term stand together, which makes the bounds tight.
        rows = sorted((r for r in rows if len(r[3])), key=lambda r: (int(r[3][int(np.argmax(r[4]))]), r[0]))
        self.doc, self.toxic, self.say = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], float), np.array([r[2] for r in rows], float)
        self.blocks = -(-len(rows) // BLOCK)
        if not rows:
            return
        term, weight = np.concatenate([r[3] for r in rows]).astype(np.int64), np.concatenate([r[4] for r in rows])
        example = np.repeat(np.arange(len(rows)), [len(r[3]) for r in rows])
        often = np.flatnonzero(np.bincount(term, minlength=terms) * DENSE > len(rows))
        self.dense_of = np.full(terms, -1, np.int32)
        self.dense_of[often] = np.arange(len(often))
        self.dense = np.zeros((len(often), len(rows)))
        rare = self.dense_of[term] < 0
        self.dense[self.dense_of[term[~rare]], example[~rare]] = weight[~rare]
        order = np.flatnonzero(rare)[np.lexsort((example[rare], term[rare]))]
        term, self.example, self.weight = term[order], example[order].astype(np.int32), weight[order]
        block = self.example // BLOCK
        opens = np.ones(len(term), bool)
        opens[1:] = (term[1:] != term[:-1]) | (block[1:] != block[:-1])
        first = np.flatnonzero(opens)
        self.of_entry = np.append(first, len(term))  # an entry for each term and block: where its examples are
        self.entry_block, self.most = block[first], np.maximum.reduceat(self.weight, first) if len(first) else np.zeros(0)
        self.of_term = np.searchsorted(term[first], np.arange(terms + 1))

    def nearest(self, ids: np.ndarray, q: np.ndarray, k: int) -> list[tuple[float, int]]:
        """(cosine, example) of the k nearest with cosine over 0."""
        if not self.blocks or not len(ids):
            return []
        often = self.dense_of[ids]
        base = q[often >= 0] @ self.dense[often[often >= 0]]
        ids, q = ids[often < 0], q[often < 0]
        start, end = self.of_term[ids], self.of_term[ids + 1]
        entry, q = _ranges(start, end), np.repeat(q, end - start)
        block, total = self.entry_block[entry], len(self.doc)
        bound = np.bincount(block, q * self.most[entry], self.blocks) + np.maximum.reduceat(base, np.arange(0, total, BLOCK))
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        score, hit, i, step, least = np.zeros(0), np.zeros(0, np.int64), 0, 4, -1.0
        while i < len(order) and bound[order[i]] >= least - 1e-9:
            part = order[i : i + step]
            open_ = np.zeros(self.blocks, bool)
            open_[part] = True
            at = open_[block]
            start, end = self.of_entry[entry[at]], self.of_entry[entry[at] + 1]
            posting = _ranges(start, end)
            own = np.bincount(self.example[posting], self.weight[posting] * np.repeat(q[at], end - start), total)
            new = _ranges(part * BLOCK, np.minimum((part + 1) * BLOCK, total))
            value = own[new] + base[new]
            score, hit = np.concatenate([score, value[value > 0]]), np.concatenate([hit, new[value > 0]])
            if len(score) > k:
                near = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k] - 1e-9)
                best = near[np.lexsort((self.doc[hit[near]], -np.round(score[near], 12)))][:k]
                score, hit = score[best], hit[best]
                least = score.min()
            i, step = i + step, 4 * step
        best = np.lexsort((self.doc[hit], -np.round(score, 12)))
        return list(zip(score[best].tolist(), hit[best].tolist()))

    def share(self, found: list[tuple[float, int]]) -> float | None:
        """Share of toxic votes, None without any."""
        at = [i for _, i in found]
        w = np.array([s * s for s, _ in found]) * self.say[at] if found else np.zeros(0)
        return float(w @ self.toxic[at] / w.sum()) if w.sum() > 0 else None


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Monotone steps of least squares as (mean x, value); each step's value is drawn to ``prior`` by one row's weight."""
    steps: list[list[float]] = []
    for a in np.unique(x):
        at = x == a
        steps.append([w[at].sum(), (w[at] * y[at]).sum(), (w[at] * x[at]).sum()])
        while len(steps) > 1 and steps[-2][1] * steps[-1][0] >= steps[-1][1] * steps[-2][0]:
            last = steps.pop()
            steps[-1] = [p + q for p, q in zip(steps[-1], last)]
    n, t, at = np.array(steps).T
    return at / n, np.maximum.accumulate((t + prior) / (n + 1))


def fitted(docs: DataFrame, x: Examples, prior: float) -> tuple[Space, np.ndarray, BlockMax, tuple[np.ndarray, np.ndarray] | None]:
    """Terms, their weights, the index, and the curve from the share of votes to a probability."""
    away = mix(x.group.view(np.uint64) + np.uint64(1)) % np.uint64(CALIBRATE) == 0
    own, rest = x.of(~away), x.of(away)
    space = Space(own)
    n, df = 0, np.zeros(len(space.terms))
    for r in document_frequencies(docs, space).collect():  # a row per term of the index
        if r["term"] < 0:
            n = r["n"]
        else:
            df[r["term"]] = r["n"]
    weight = (np.log((1.0 + n) / (1.0 + df)) + 1.0) * space.weight

    places = np.full(x.size, -1, np.int32)
    places[space.terms] = np.arange(len(space.terms))

    def units(e: Examples):
        found = [(np.zeros(0, np.int64), np.zeros(0))] * len(e)
        for row, term, count in e.terms():
            place = places[term]
            known = place >= 0
            row, place, count = row[known], place[known].astype(np.int64), count[known]
            cuts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else []
            for a, b in zip(cuts, [*cuts[1:], len(row)]):
                found[row[a]] = place[a:b], unit_weights(place[a:b], count[a:b], weight)
        return found

    index = BlockMax([(int(d), int(t), 1.0 / r, *v) for d, t, r, v in zip(own.doc, own.toxic, own.rate, units(own))], len(space.terms))
    votes = [(s, t, 1.0 / r) for v, t, r in zip(units(rest), rest.toxic, rest.rate) if (s := index.share(index.nearest(*v, NEIGHBOURS))) is not None]
    curve = None
    if len({t for _, t, _ in votes}) == 2:
        curve = isotonic(*(np.array(c, float) for c in zip(*votes)), prior)
    return space, weight, index, curve


def document_frequencies(docs: DataFrame, space: Space) -> DataFrame:
    """term (place), n: number of documents with each term; of all documents under -1."""
    shared, size = docs.sparkSession.sparkContext.broadcast(space.parts()), len(space.terms)

    def kernel(batches):
        of, n, df = reader(*shared.value), 0, np.zeros(size, np.int64)
        for batch in batches:
            for text in batch.column(0):
                df[of(text.as_py())[0]] += 1
            n += len(batch)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], n))], ["term", "n"])

    return docs.select("text").mapInArrow(kernel, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def score_documents(docs: DataFrame, labels: DataFrame, k: int = NEIGHBOURS, per_label: int = PER_LABEL) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence (``doc_id:cosine:label`` of the three nearest examples)."""
    fold = F.coalesce(held_out("doc_id", 3, 1), F.lit(True))
    x, prior = draw_examples(docs, labels.filter(~fold), per_label)
    space, weight, index, curve = fitted(docs, x, prior) if len(set(x.toxic.tolist())) == 2 else (Space(Examples([], [])), np.zeros(0), BlockMax([], 0), None)
    # About 2 * per_label examples; arrays only, as workers may lack the class.
    shared = docs.sparkSession.sparkContext.broadcast((space.parts(), weight, vars(index), curve))

    def make():
        terms, weight, own, curve = shared.value
        of, index = reader(*terms), BlockMax.__new__(BlockMax)
        vars(index).update(own)

        def work(texts: pa.Array) -> list[pa.Array]:
            scores, evidence = [], []
            for text in texts:
                ids, counts = of(text.as_py())
                found = index.nearest(ids, unit_weights(ids, counts, weight), k) if len(ids) else []
                share = index.share(found)
                score = prior if share is None else share if curve is None else np.interp(share, *curve)
                scores.append(min(1.0, max(0.0, float(score))))
                evidence.append(",".join(f"{index.doc[i]}:{s:.3f}:{index.toxic[i]:.0f}" for s, i in found[:3]))
            return [pa.array(scores, pa.float64()), pa.array([int(s >= THRESHOLD) for s in scores], pa.int32()), pa.array(evidence, pa.string())]

        return work

    return over_text(docs.select(F.col("doc_id").cast("long"), fold.alias("held_out"), "text"), make, "score double, predicted int, evidence string", ["doc_id", "held_out"])
