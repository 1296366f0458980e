"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text.

Folding lower-cases, maps look-alike letters of other scripts, digits and signs used as letters to one sign (i, l and 1
fold together), drops accents and invisible signs, and turns all other signs into blanks.  Lexicon entries are word
beginnings of 4 to 9 folded letters or whole words, learned from labelled texts: entries that are frequent in toxic and
rare in other texts in many different contexts, then entries that cover toxic texts without a match; the weight is the
log odds.
Exception phrases (whole words, or a word with the word before it) in which an entry occurs in other texts but not in
toxic ones cancel the matches inside them.  A text's evidence is the largest weight of its matches and the sum of the
weights normalised by length; a logistic over both gives the score.

Fitted on a bounded sample: at most ``TOXIC_SAMPLE`` texts of label 1 and ``CLEAN_SAMPLE`` of label 0 (all, when there
are fewer), chosen by a hash of doc_id.  Of the entries seen in at least ``MIN_DOCS`` toxic ones the 20 x ``MAX_TERMS``
most frequent are candidates; the lexicon holds at most ``MAX_TERMS`` entries and as many exception phrases.  Scoring covers every row and whole texts; labels, lang, source and doc_id are no
inputs.

Defined results: a null text is the empty text; a text without matches gets the score of no evidence.  Null labels are
not learned from.  Without labels of both kinds the lexicon is empty and every score is the share of label 1 (0 without
labels).  Extra columns are ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import itertools
import unicodedata
import zlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profilebook.llm.common import bounded_sample, fold, landed, text_of

TOXIC_SAMPLE, CLEAN_SAMPLE = 6_000, 12_000
MIN_DOCS, MIN_WEIGHT, STRONG, MAX_TERMS = 3, 2.5, 22.0, 2_000
PREFIX = range(4, 10)

#: Letters of other scripts that look like Latin ones, and digits and signs written for letters.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "е": "e", "н": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ł": "l", "ø": "o",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "ß": "ss",
}
INVISIBLE = "­​‌‍⁠﻿"


class Folding(dict):
    """Translation table, filled as signs are met."""

    def __missing__(self, point: int) -> str:
        sign = chr(point)
        if sign in INVISIBLE:
            out = ""
        else:
            base = unicodedata.normalize("NFKD", sign.lower())
            letters = [LOOKALIKES.get(c, c) for c in (LOOKALIKES.get(sign.lower(), base)) if not unicodedata.combining(c)]
            out = "".join(c if c.isalpha() else " " for c in letters).replace("l", "i") or ("" if unicodedata.combining(sign) else " ")
        self[point] = out
        return out


def fold_text(text: str, table: dict) -> str:
    """Folded words, each led by one blank and the last followed by one."""
    return " " + " ".join(text.translate(table).split()) + " "


def entries(word: str) -> list[str]:
    """Possible lexicon entries of a folded word: its beginnings and itself."""
    return [f" {word[:k]}" for k in PREFIX if k <= len(word)] + [f" {word} "]


class Lexicon:
    """Weighted entries, exception phrases and the logistic over the evidence."""

    def __init__(self, weights: dict[str, float], exceptions: list[str], logit: list[float]):
        self.weights, self.exceptions, self.logit = weights, exceptions, logit

    def automaton(self) -> ahocorasick.Automaton:
        a = ahocorasick.Automaton()
        for e in self.exceptions:
            a.add_word(e, (0.0, len(e)))
        for e, w in self.weights.items():
            a.add_word(e, (w, len(e)))
        a.make_automaton()
        return a


def evidence(folded: str, automaton) -> tuple[float, float]:
    """The largest weight of a word that matches, and the sum of the weights by the logarithm of the length."""
    if not len(automaton):
        return 0.0, 0.0
    hits, spared = {}, []
    for end, (weight, size) in automaton.iter(folded):
        begin = end - size + 1
        if weight:
            hits[begin] = max(weight, hits.get(begin, 0.0))
        else:
            spared.append((begin, end))
    spared.sort()
    begins, furthest = [b for b, _ in spared], list(itertools.accumulate((e for _, e in spared), max))
    kept = [w for at, w in hits.items() if not ((k := bisect.bisect_right(begins, at)) and furthest[k - 1] > at)]
    return max(kept, default=0.0), sum(kept) / np.log2(2 + folded.count(" "))


def _sample(labels: DataFrame, label: str) -> DataFrame:
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("y"))
    return bounded_sample(known.filter("y = 1"), "doc_id", TOXIC_SAMPLE).unionByName(bounded_sample(known.filter("y = 0"), "doc_id", CLEAN_SAMPLE))


def _entry_counts(texts: DataFrame) -> DataFrame:
    """entry, toxic, clean: in how many sampled texts of each label an entry occurs."""

    def run(batches):
        table = Folding()
        for b in batches:
            counts: dict[str, list[int]] = {}
            for y, text in zip(b.column("y").to_pylist(), b.column("text").to_pylist()):
                for e in {e for w in set(fold_text(text, table).split()) for e in entries(w)}:
                    counts.setdefault(e, [0, 0])[y] += 1
            yield pa.RecordBatch.from_pydict({"entry": list(counts), "toxic": [c[1] for c in counts.values()], "clean": [c[0] for c in counts.values()]},
                                             schema=pa.schema([("entry", pa.string()), ("toxic", pa.int64()), ("clean", pa.int64())]))

    return texts.mapInArrow(run, "entry string, toxic long, clean long").groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _postings(texts: DataFrame, weights: dict[str, float]) -> list[dict[str, set[int]]]:
    """For each sampled toxic text (bounded by TOXIC_SAMPLE rows) the candidate entries in it, with their contexts.

    A context is a hash of the words before and after: copies of a text repeat its contexts, other texts do not.
    """
    def run(batches):
        table = Folding()
        for b in batches:
            out = []
            for text in b.column("text").to_pylist():
                words = fold_text(text, table).split()
                found: dict[str, set[int]] = {}
                for i, w in enumerate(words):
                    for e in entries(w):
                        if e in weights:
                            found.setdefault(e, set()).add(zlib.crc32(f"{words[i - 1] if i else ''} {words[i + 1] if i + 1 < len(words) else ''}".encode()))
                out.append([(e, sorted(c)) for e, c in sorted(found.items())])
            kind = pa.list_(pa.struct([("entry", pa.string()), ("contexts", pa.list_(pa.int64()))]))
            yield pa.RecordBatch.from_arrays([pa.array([[{"entry": e, "contexts": c} for e, c in o] for o in out], type=kind)], names=["found"])

    rows = texts.filter("y = 1").select("text").mapInArrow(run, "found array<struct<entry:string,contexts:array<long>>>").collect()
    return [{f["entry"]: set(f["contexts"]) for f in r["found"]} for r in rows]


def _choose(postings: list[dict[str, set[int]]], weights: dict[str, float], share: float) -> dict[str, float]:
    """Entries well supported by different contexts, then entries that cover texts which these leave uncovered.

    The support of an entry is the number of its different contexts, so rare words of much copied texts have little.
    It is well supported when 2 * support * -ln(share of toxic texts) is at least STRONG.  Of a word's beginnings the
    best supported one counts, the shorter at a tie.
    """
    where: dict[str, dict[int, set[int]]] = {}
    for i, found in enumerate(postings):
        for e, c in found.items():
            where.setdefault(e, {})[i] = c
    support = {e: len(set().union(*w.values())) for e, w in where.items()}
    chosen: dict[str, float] = {}
    held = lambda e: any(e[:k] in chosen for k in range(5, len(e)))
    for e in sorted(where, key=lambda e: (-support[e] * weights[e], len(e), e)):
        if len(chosen) < MAX_TERMS and -2 * support[e] * np.log(share) >= STRONG and not held(e):
            chosen[e] = weights[e]
    open_texts = {i for i, found in enumerate(postings) if not chosen.keys() & found.keys()}
    while open_texts and len(chosen) < MAX_TERMS:
        gain = {e: len(set().union(*(w[i] for i in w.keys() & open_texts))) for e, w in where.items() if w.keys() & open_texts and e not in chosen}
        best = max(gain, key=lambda e: (gain[e], weights[e], -len(e), e), default=None)
        if best is None or gain[best] < MIN_DOCS:
            break
        chosen[best] = weights[best]
        open_texts -= where[best].keys()
    return chosen


def _exceptions(texts: DataFrame, weights: dict[str, float]) -> list[str]:
    """Phrases around a match that occur in two or more sampled clean texts and in no toxic one."""
    if not weights:
        return []

    def run(batches):
        table, automaton = Folding(), Lexicon(weights, [], []).automaton()
        for b in batches:
            out = []
            for y, text in zip(b.column("y").to_pylist(), b.column("text").to_pylist()):
                folded, phrases = fold_text(text, table), set()
                for end, (_, size) in automaton.iter(folded):
                    begin = end - size + 1
                    stop = folded.index(" ", begin + 1)
                    phrases.add(folded[begin:stop + 1])
                    if begin:
                        phrases.add(folded[folded.rindex(" ", 0, begin):stop + 1])
                out += [(p, y) for p in phrases]
            yield pa.RecordBatch.from_pydict({"phrase": [p for p, _ in out], "y": [y for _, y in out]}, schema=pa.schema([("phrase", pa.string()), ("y", pa.int32())]))

    found = texts.mapInArrow(run, "phrase string, y int").groupBy("phrase").agg(F.sum("y").alias("toxic"), F.count("*").alias("n"))
    return sorted(r["phrase"] for r in found.filter("toxic = 0 and n >= 2").orderBy(F.desc("n"), "phrase").limit(MAX_TERMS).collect())


def _logistic(x: np.ndarray, y: np.ndarray) -> list[float]:
    """Logistic regression by Newton steps with a small ridge; the columns are an intercept and the evidence."""
    a = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(a.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        h = a.T @ (a * (p * (1 - p))[:, None]) + 0.1 * np.eye(a.shape[1])
        beta += np.linalg.solve(h, a.T @ (y - p) - 0.1 * beta)
    return beta.tolist()


def _columns(total: np.ndarray, scaled: np.ndarray) -> np.ndarray:
    return np.column_stack([np.minimum(total, 6.0), np.minimum(scaled, 6.0)])


def _evidence_table(docs: DataFrame, lexicon: Lexicon, extra: str) -> DataFrame:
    """``extra``, total, scaled for every row of docs (``extra``, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(vars(lexicon))

    def run(batches):
        table, automaton = Folding(), Lexicon(**shared.value).automaton()
        for b in batches:
            got = [evidence(fold_text(t, table), automaton) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(extra), pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.float64())], names=[extra, "total", "scaled"])

    return docs.select(extra, "text").mapInArrow(run, docs.select(extra).schema.add("total", "double").add("scaled", "double"))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Lexicon:
    """Learn entries, exceptions and the logistic from labelled documents."""
    sample = F.broadcast(_sample(labels, label))  # at most TOXIC_SAMPLE + CLEAN_SAMPLE narrow rows
    # Landed: the passes below read the sampled texts, not the corpus.
    texts = landed(docs.select("doc_id", text_of().alias("text")).join(sample, "doc_id").select("y", "text"), "labelled")
    n = {r["y"]: r["n"] for r in texts.groupBy("y").agg(F.count("*").alias("n")).collect()}
    toxic, clean = n.get(1, 0), n.get(0, 0)
    if not toxic or not clean:
        return Lexicon({}, [], [30.0 if toxic else -30.0, 0.0, 0.0])
    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1.0)) - F.log((F.col("clean") + 0.5) / (clean + 1.0))
    found = _entry_counts(texts).withColumn("w", odds).filter((F.col("toxic") >= MIN_DOCS) & (F.col("w") >= MIN_WEIGHT))
    weights = {r["entry"]: float(r["w"]) for r in found.orderBy(F.desc("toxic"), "entry").limit(20 * MAX_TERMS).collect()}
    chosen = _choose(_postings(texts, weights), weights, toxic / (toxic + clean))
    lexicon = Lexicon(chosen, _exceptions(texts, chosen), [])
    got = sorted((r["y"], r["total"], r["scaled"]) for r in _evidence_table(texts, lexicon, "y").collect())
    total, scaled = (np.array([g[k] for g in got]) for k in (1, 2))
    lexicon.logit = _logistic(_columns(total, scaled), np.array([g[0] for g in got], dtype=float))
    return lexicon


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id, score, total (largest weight found) of every document."""
    b0, b1, b2 = lexicon.logit
    rows = _evidence_table(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")), lexicon, "doc_id")
    z = F.lit(b0) + F.lit(b1) * F.least("total", F.lit(6.0)) + F.lit(b2) * F.least("scaled", F.lit(6.0))
    return rows.select("doc_id", (1 / (1 + F.exp(-z))).alias("score"), "total")


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted; learned from rows whose id fold (modulo 3) is not 1."""
    lexicon = train(docs, labels.filter(fold(F.col("doc_id"), 3) != 1))
    return score(docs, lexicon).select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
