"""Toxicity by a weighted finite-state grammar over clauses.

Weighted transducers are composed over the words of a clause. The insult transducer writes I for a word that
begins with a stem of its lexicon, with the stem's log-likelihood ratio as weight, and the threat transducer X
for a verb of violence, with more weight where an intention comes before it. Reported speech, negation and
target then rewrite the I or X that they reach and add their own weights, so that "you are a X", "not a X" and
"they said X" end as different symbols. Weights along a path add up. A word's evidence reaches the score only through
the symbol that its clause's path ends it in: the features of a text are, for each symbol, the weight of its
matches and the number of clauses with it. Clauses without a match don't count, nor do isolated words.

The lexicon is learned from labelled texts: beginnings of words (the invented languages inflect) that are
more frequent in toxic ones. So are further words of the classes target, negation and report: those near
matches of toxic or of other texts. All counts are made on the executors; the driver gets the few beginnings
that are left and a row of features for each labelled text, never texts. A logistic model with a normal prior
joins the features; where the labels hold no example of a symbol, the prior's hand-set weight stands.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.llm.common import cut, docs_of, held_out, held_out_col, ids_of, sample_of, sliced, tables

#: Labelled rows that the lexicon and the weights are fitted on, at most.
TRAIN_ROWS = 8_000
#: Entries of the learned lexicon, and learned words of a class, at most.
LEXICON, CONTEXT = 300, 50
THRESHOLD = 0.3
WORD = re.compile(r"[^\W\d_]+")
CLAUSE_END = re.compile(r"[.!?;:\n]")

#: Classes of closed-set words, in the four languages: target, negation, report, intention.
CLOSED = {
    "T": "you your you're u yourself they them their he she his her these those people du dein deine ihr euch sie tu toi vous ton votre ils elles usted tú vosotros ellos ellas".split(),
    "N": "not no never isn't aren't wasn't don't hardly without nicht kein keine nie ne pas jamais nunca sin".split(),
    "R": "said says say told called calls claimed quoted wrote reported allegedly sagte sagt schrieb dit disait dijo dice llamó".split(),
    "W": "will shall gonna going werde werden vais va voy vamos".split(),
}
THREATS = "kill hurt beat shoot stab burn murder strangle destroy töten umbringen erschießen schlagen tuer frapper brûler matar golpear quemar".split()
#: Words before a match that negation and report reach.
NEAR, FAR = 3, 12


class Transducer:
    """A deterministic weighted transducer: (state, symbol) -> (state, symbol, weight)."""

    def __init__(self, step: Callable, start=0) -> None:
        self.step, self.start = step, start

    def __matmul__(self, other: Transducer) -> Transducer:
        """First self, then other; weights add up."""

        @cache
        def step(state, symbol):
            s, mid, a = self.step(state[0], symbol)
            t, out, b = other.step(state[1], mid)
            return (s, t), out, a + b

        return Transducer(step, (self.start, other.start))

    def run(self, symbols: list[str]) -> list[tuple[str, float]]:
        state, out = self.start, []
        for x in symbols:
            state, y, w = self.step(state, x)
            out.append((y, w))
        return out


def _scoped(trigger: str, mark: str, reach: int, weight: float = 0.0) -> Transducer:
    """Insults and threats (I, X) within reach tokens after the trigger's class get the mark and the weight."""

    def step(state: int, symbol: str):
        if symbol == trigger:
            return reach, symbol, 0.0
        if symbol[-1] in "IX" and state:
            return state, mark + symbol, weight
        return max(0, state - 1), symbol, 0.0

    return Transducer(step)


def _threat(state: int, symbol: str):
    """V becomes X; an intention up to four tokens before it adds weight."""
    if symbol == "W":
        return 4, "O", 0.0
    if symbol == "V":
        return 0, "X", 2.0 if state else 1.0
    return max(0, state - 1), symbol, 0.0


THREAT = Transducer(_threat)
NEGATION = _scoped("N", "n", NEAR, -1.0)
REPORTED = _scoped("R", "r", FAR, -0.5)
TARGET = _scoped("T", "t", 4, 1.0)
GRAMMAR = THREAT @ REPORTED @ NEGATION @ TARGET
#: The target may follow, too: the same transducer from the clause's end.
BACKWARD = THREAT @ TARGET

#: What a match may end as, with the prior's means: of its weight (in tens), and of the clauses that have it.
SYMBOLS = {"I": (1.0, 1.0), "tI": (1.2, 2.0), "nI": (0.2, -0.5), "rI": (0.2, -0.5), "X": (0.5, 0.5), "tX": (1.0, 2.5), "nX": (0.2, -0.5), "rX": (0.2, -0.5)}


def clause_symbols(classes: list[str]) -> list[tuple[int, str, float]]:
    """(place, symbol, weight) of a clause's insults and threats; marks of report and of negation go before targets."""
    forth = GRAMMAR.run(classes)
    back = BACKWARD.run(classes[::-1])[::-1]
    out = []
    for i, ((f, w), (b, _)) in enumerate(zip(forth, back, strict=True)):
        if f[-1] in "IX":
            mark = "r" if "r" in f else "n" if "n" in f else "t" if "t" in f or "t" in b else ""
            out.append((i, mark + f[-1], w + (mark == "t" and "t" not in f)))
    return out


class Lexicon:
    """The insult transducer (stems with their rates in toxic and other texts), and the classes of other words."""

    def __init__(self, stems: list[tuple[str, float, float]], learned: dict[str, list[str]] | None = None) -> None:
        self.stems, self.learned = stems, learned or {}
        self.ratio = np.array([np.log(a / b) for _, a, b in stems])
        self.drift = np.array([a - b for _, a, b in stems])
        self._of = {s: k for k, (s, _, _) in enumerate(stems)}
        self._lengths = sorted({len(s) for s in self._of}, reverse=True)
        self._class = {w: c for part in (CLOSED, self.learned) for c, ws in part.items() for w in ws} | dict.fromkeys(THREATS, "V")
        self._found, self._known = None, {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_found": None, "_known": {}}

    def hits(self, text: str) -> Iterator[int]:
        """Where words that may match begin."""
        if self._found is None:
            import ahocorasick

            self._found = ahocorasick.Automaton()
            for w in [*self._of, *THREATS]:
                self._found.add_word(w, len(w))
            self._found.make_automaton()
        for end, n in self._found.iter(text):
            at = end - n + 1
            if not at or not text[at - 1].isalpha():
                yield at

    def stem(self, word: str) -> int | None:
        """The longest stem that the word begins with."""
        for n in self._lengths:
            k = self._of.get(word[:n]) if n <= len(word) else None
            if k is not None:
                return k
        return None

    def read(self, word: str) -> tuple[str, int | None]:
        """The class that the word comes into the grammar with, and the stem where it is I."""
        got = self._known.get(word)
        if got is None:
            k = None if self._class.get(word) == "V" else self.stem(word)
            got = ("I", k) if k is not None else (self._class.get(word, "O"), None)
            if len(self._known) < 200_000:
                self._known[word] = got
        return got

    def clauses(self, text: str) -> Iterator[tuple[list[str], list[tuple[int, str, float]], list[int | None]]]:
        """Words, matches and stems of each clause, whole, that has a match."""
        upto = 0
        for at in sorted(set(self.hits(text))):
            if at < upto:
                continue
            lo = 1 + max(text.rfind(c, upto, at) for c in ".!?;:\n")
            lo = lo or upto
            end = CLAUSE_END.search(text, at)
            upto = end.end() if end else len(text)
            words = WORD.findall(text, lo, upto)
            read = [self.read(w) for w in words]
            matches = clause_symbols([c for c, _ in read])
            if matches:
                yield words, matches, [k for _, k in read]

    def features(self, text: str) -> np.ndarray:
        """For each symbol the weight of its matches and the number of clauses with it (as log1p)."""
        text = text.lower()
        n = len(SYMBOLS)
        weight, clauses, stems = np.zeros(n), np.zeros(n), [set() for _ in range(n)]
        for _, matches, stem in self.clauses(text):
            here = set()
            for i, symbol, w in matches:
                s = AT[symbol]
                here.add(s)
                weight[s] += w
                if stem[i] is not None:
                    weight[s] += self.ratio[stem[i]]
                    stems[s].add(stem[i])
            clauses[list(here)] += 1
        n_words = max(1, len(text) / 6)
        for s in range(n):  # what a text of this length holds of these stems anyway
            if stems[s]:
                weight[s] -= n_words * self.drift[list(stems[s])].sum()
        return np.r_[np.clip(weight, -20, 40) / 10, np.log1p(clauses)]


AT = {s: i for i, s in enumerate(SYMBOLS)}


def beginnings(word: str) -> list[str]:
    return [word[:n] for n in range(3, 1 + min(12, len(word)))]


def learn_lexicon(rows: DataFrame, most: int = LEXICON) -> Lexicon:
    """Word beginnings of 3 to 12 letters that set toxic texts apart, best first, none inside another's work. rows: text, toxic.

    First the beginnings that toxic texts go on from in many ways (copies of a text always go on alike), then
    their counts in all texts; both are sums over tasks.
    """

    def ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 64):
            seen = set()
            for text in b.column(0).to_pylist():
                words = WORD.findall(text.lower())
                seen.update((p, zlib.crc32(after.encode())) for w, after in set(zip(words, [*words[1:], ""], strict=True)) for p in beginnings(w))
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in seen], pa.string()), pa.array([a for _, a in seen], pa.int64())], names=["p", "after"])

    size = {r.toxic: r for r in rows.groupBy("toxic").agg(F.count("*").alias("n"), F.sum(F.greatest(F.lit(1.0), F.length("text") / 6)).alias("words")).collect()}
    n = [size[y].n if y in size else 0 for y in (0, 1)]
    n_words = [float(size[y].words) if y in size else 0.0 for y in (0, 1)]
    least = max(3, n[1] // 100)
    varied = rows.filter("toxic = 1").select("text").mapInArrow(ways, "p string, after long").distinct().groupBy("p").count().filter(F.col("count") >= least)
    variety = dict(varied.toArrow().to_pandas().itertuples(index=False, name=None))  # as many as the bounded sample has

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits, docs, parts = (Counter(), Counter()), (Counter(), Counter()), {}
        for b in sliced(batches, 64):
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                mine = Counter()
                for w, c in Counter(WORD.findall(text.lower())).items():
                    if w not in parts:
                        parts[w] = [p for p in beginnings(w) if p in variety]
                    for p in parts[w]:
                        mine[p] += c
                hits[y].update(mine)
                docs[y].update(mine.keys())
            if len(parts) > 200_000:
                parts.clear()
        names = list(hits[0] | hits[1])
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *[pa.array([c[p] for p in names], pa.int64()) for c in (*hits, *docs)]], names=["p", "h0", "h1", "d0", "d1"])

    summed = rows.select("text", "toxic").mapInArrow(counts, "p string, h0 long, h1 long, d0 long, d1 long").groupBy("p").agg(*[F.sum(c).alias(c) for c in ("h0", "h1", "d0", "d1")])
    ra, rb = (F.col("h1") + 0.5) / (n_words[1] + 1), (F.col("h0") + 0.5) / (n_words[0] + 1)
    found = summed.withColumns({"ra": ra, "rb": rb, "b": (F.col("d0") + 0.5) / (max(1, n[0]) + 1)}).filter("ra > 3 * rb").collect()
    rows_ = []
    for r in found:
        a = min(variety[r.p], r.d1) + 0.5
        lift = np.log(a / (max(1, n[1]) + 1)) - np.log(r.b)
        if lift > 1.2:
            rows_.append((lift * a, len(r.p), r.p, r.ra, r.rb))
    rows_.sort(key=lambda r: (-round(r[0], 6), -r[1], r[2]))
    kept: list[tuple[str, float, float]] = []
    for _, _, p, a, b in rows_:  # a shorter or longer form of a kept stem adds only what sharpens it
        if len(kept) == most:
            break
        near = [k for k in kept if k[0].startswith(p) or p.startswith(k[0])]
        if any(k[0].startswith(p) for k in near) or any(a / b < 2 * k[1] / k[2] for k in near):
            continue
        kept.append((p, float(a), float(b)))
    return Lexicon(kept)


def learn_classes(rows: DataFrame, lexicon: Lexicon, most: int = CONTEXT, least: int = 8, lift: float = 1.2) -> dict[str, list[str]]:
    """Words by class: before matches of toxic texts (T), right before (N) or farther before (R) those of others.

    A word needs `least` texts, and the odds of the matches it stands before must differ from those of all matches by `lift` (log).
    """

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 64):
            out = []
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                seen: Counter = Counter()
                for words, matches, _ in lexicon.clauses(text.lower()):
                    for i, _, _ in matches:
                        seen[""] += 1
                        seen.update({(words[j], i - j > NEAR) for j in range(max(0, i - FAR), i) if lexicon.read(words[j])[0] == "O"})
                out += [(*(k if k else ("", False)), y, c) for k, c in seen.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], t) for j, t in enumerate((pa.string(), pa.bool_(), pa.int32(), pa.int64()))], names=["w", "far", "y", "c"])

    of = lambda y: F.sum(F.when(F.col("y") == y, F.col("c")).otherwise(0))
    seen = rows.select("text", "toxic").mapInArrow(near, "w string, far boolean, y int, c long").groupBy("w", "far").agg(of(1).alias("a"), of(0).alias("b"), F.count("*").alias("texts")).filter(F.col("texts") >= least).collect()
    base = next(((r.a, r.b) for r in seen if r.w == ""), (0, 0))
    odds = [(np.log((r.a + 0.5) / (r.b + 0.5)) - np.log((base[0] + 0.5) / (base[1] + 0.5)), r.w, r.far) for r in seen if r.w]
    out: dict[str, list[str]] = {}
    for c, picked in (("T", sorted((-o, w) for o, w, far in odds if o > lift and not far)), ("N", sorted((o, w) for o, w, far in odds if o < -lift and not far)), ("R", sorted((o, w) for o, w, far in odds if o < -lift and far))):
        taken = {w for ws in out.values() for w in ws}
        out[c] = [w for _, w in picked if w not in taken][:most]
    return out


def fit_weights(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Logistic weights, intercept last, by Newton's method under a normal prior."""
    prior = np.array([*(w for w, _ in SYMBOLS.values()), *(c for _, c in SYMBOLS.values()), -4.0])
    x = np.c_[x, np.ones(len(x))]
    hold = np.r_[np.full(x.shape[1] - 1, 0.5), 1e-3]
    w = prior.copy()
    for _ in range(rounds if len(x) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + hold * (w - prior)
        h = (x.T * (p * (1 - p) + 1e-6)) @ x + np.diag(hold)
        step = np.linalg.solve(h, g)
        w -= step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return w


class Model:
    """Lexicon and weights; small, and sent to the executors whole."""

    def __init__(self, docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> None:
        usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out_col())
        picked = sample_of(usable, train_rows).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        rows = cut(docs.join(F.broadcast(picked), "doc_id").select("text", "toxic").limit(2 * train_rows))  # picked: train_rows at most
        self.lexicon = learn_lexicon(rows)
        self.lexicon = Lexicon(self.lexicon.stems, learn_classes(rows, self.lexicon))
        lexicon = self.lexicon

        def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in sliced(batches):
                yield pa.RecordBatch.from_arrays([pa.array([lexicon.features(t) for t in b.column(0).to_pylist()], pa.list_(pa.float64())), b.column(1)], names=["x", "toxic"])

        found = rows.select("text", "toxic").mapInArrow(make, "x array<double>, toxic int").toArrow()
        x = np.array(found.column("x").to_pylist()).reshape(found.num_rows, 2 * len(SYMBOLS))
        self.weights = fit_weights(x, found.column("toxic").to_numpy().astype(float))

    def features(self, texts: list[str]) -> np.ndarray:
        return np.array([self.lexicon.features(t) for t in texts]).reshape(len(texts), 2 * len(SYMBOLS))

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(np.c_[x, np.ones(len(x))] @ self.weights, -30, 30)))


def score_toxicity(df: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row: doc_id, held_out, score (0 to 1), predicted, clauses (matched ones).

    Fitted on at most train_rows rows with a toxic label that are not held out. A null text is empty and
    scores as a text without a match. Rows without an id are left out; rows that repeat an id are each
    scored. Without usable labels the lexicon is empty and threats alone count.
    """
    docs = docs_of(df)
    model = Model(docs, labels, train_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            ids = ids_of(b)
            x = model.features(b.column(1).to_pylist())
            p = model.score(x)
            clauses = np.rint(np.expm1(x[:, len(SYMBOLS) :])).sum(axis=1).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([held_out(i) for i in ids.tolist()]), pa.array(p), pa.array((p >= threshold).astype(np.int32)), pa.array(clauses)], names=["doc_id", "held_out", "score", "predicted", "clauses"])

    return docs.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, clauses long")


def keep_clean(df: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of df, all columns, whose text scores below threshold; rows with a null or empty text stay, a missing id doesn't matter."""
    model = Model(docs_of(df), labels, train_rows)
    at = df.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            texts = b.column(at).to_pylist()
            p = model.score(model.features([t or "" for t in texts]))
            yield b.filter(pa.array((p < threshold) | np.array([not t for t in texts], bool)))

    return df.mapInArrow(run, df.schema)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(tables(spark, sf_dir, "documents"), tables(spark, sf_dir, "labels"))
