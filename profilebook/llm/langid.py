"""Language identification: a linear-chain conditional random field over the words of code-switched text.

Every word gets a state (a language).  Its features are the character n-grams (1 to 4) of the lower-cased letters between
begin and end marks, so affixes are n-grams that hold a mark, and a whole-word lexicon feature; features are hashed to
``BUCKETS`` weights per language.  Learned transition weights join neighbouring words.  Forward-backward gives each word
its posterior over the languages; the text's language is the one with the largest mean posterior over its words with
letters, the score is that mean.  Forward and backward passes are exact over whole texts: texts are cut into blocks of
``BLOCK`` words whose transfer matrices are multiplied first, so all blocks of a batch advance together.

Fitted on a bounded sample: at most ``SAMPLE`` labelled documents (all, when there are fewer), as evenly as may be from the
languages and chosen by a hash of doc_id; of each the first ``SAMPLE_CHARS`` characters, of all ``TRAIN_WORDS`` words in
spans drawn from them.  Training sequences interleave spans of 5 to 40 words of differently labelled documents, which is where the
transition weights meet switches.  Scoring covers every row; lang, source and doc_id are no inputs.

Defined results: ``und`` with score 0 for a null text, a text without letters, and when nothing could be learned.  Words
without letters have no evidence of their own and take part through the transitions only.  Ties go to the language that
is first in alphabetical order.  Extra columns are ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profilebook.llm.common import even_sample, fold
from profilebook.llm.words import MULT, mix, pieces, split_words

SAMPLE, SAMPLE_CHARS = 2_000, 20_000
TRAIN_WORDS = 100_000
BUCKETS = 2 ** 17
ORDERS = 4
BLOCK = 32
#: Bytes of text whose words a task holds in arrays at once (a longer text is alone).
PIECE = 1_000_000
EPOCHS, RATE = 25, 0.3
MARK = 1
UNKNOWN = "und"


def letter_table() -> tuple[np.ndarray, np.ndarray]:
    """For every code point: is it a letter, and its lower-case form."""
    points = np.arange(0x110000, dtype=np.uint32)
    letter = np.zeros(0x110000, dtype=bool)
    lower = points.copy()
    for p in range(0x110000):
        c = chr(p)
        if c.isalpha():
            letter[p] = True
            low = c.lower()
            if len(low) == 1:
                lower[p] = ord(low)
    return letter, lower


def word_features(words: list[bytes], letter: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature buckets of distinct words: flat buckets, where each word's begin, and which words have letters."""
    text = b"\n".join(words).decode("utf-8", "replace")
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    word = np.concatenate([[0], np.cumsum(points == 10)])[:len(points)] if len(points) else np.zeros(0, np.int64)
    keep = letter[points]
    points, word = lower[points[keep]], word[keep]
    n = np.bincount(word, minlength=len(words)).astype(np.int64)
    # Letters between two marks, one word after the other.
    begin = np.concatenate([[0], np.cumsum(n + 2)])[:-1]
    first = np.concatenate([[0], np.cumsum(n)])[:-1]
    marked = np.full(int((n + 2).sum()), MARK, dtype=np.uint64)
    marked[begin[word] + 1 + np.arange(len(word)) - first[word]] = points
    owner = np.repeat(np.arange(len(words)), n + 2)
    buckets, owners = [], []
    with np.errstate(over="ignore"):
        rolling = np.zeros(len(marked), dtype=np.uint64)
        for k in range(1, ORDERS + 1):
            m = len(marked) - k + 1
            if m <= 0:
                break
            rolling = mix(rolling[:m] + marked[k - 1:] * np.uint64(MULT[k % 8]) + np.uint64(k))
            ok = (owner[:m] == owner[k - 1:]) & (n[owner[:m]] > 0)
            if k == 1:
                ok &= marked != MARK
            buckets.append(rolling[ok] % np.uint64(BUCKETS))
            owners.append(owner[:m][ok])
        if len(marked):
            scrambled = mix(marked + (np.arange(len(marked)) - begin[owner]).astype(np.uint64) * np.uint64(MULT[5]))
            whole = mix(np.add.reduceat(scrambled, begin) if len(begin) else np.zeros(0, np.uint64))
            full = n > 0
            buckets.append(whole[full] % np.uint64(BUCKETS))
            owners.append(np.flatnonzero(full))
    flat, own = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (buckets, owners))
    order = np.argsort(own, kind="stable")
    counts = np.bincount(own.astype(np.int64), minlength=len(words))
    return flat[order].astype(np.int64), np.concatenate([[0], np.cumsum(counts)]), n > 0


def emissions(features: np.ndarray, starts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Sum of the weights of each word's features, scaled by the root of their number."""
    out = np.zeros((len(starts) - 1, weights.shape[1]))
    size = np.diff(starts)
    full = size > 0
    if full.any():
        out[full] = np.add.reduceat(weights[features], starts[:-1][full], axis=0) / np.sqrt(size[full])[:, None]
    return out


def posteriors(emission: np.ndarray, counts: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact forward-backward over sequences laid one after the other.

    Returns each word's posterior and the expected transitions, summed over all sequences.
    """
    k = emission.shape[1]
    e = np.exp(emission - emission.max(axis=1, keepdims=True))
    t = np.exp(transition - transition.max())
    blocks = (counts + BLOCK - 1) // BLOCK
    nb = int(blocks.sum())
    first = np.concatenate([[0], np.cumsum(blocks)])[:-1]
    starts = np.concatenate([[0], np.cumsum(counts)])[:-1]
    owner = np.repeat(np.arange(len(counts)), counts)
    inside = np.arange(len(e)) - starts[owner]
    row, col = first[owner] + inside // BLOCK, inside % BLOCK
    grid = np.ones((nb, BLOCK, k))
    grid[row, col] = e
    real = np.zeros((nb, BLOCK), dtype=bool)
    real[row, col] = True
    # Transfer matrix of each block; places behind a sequence's end leave it as it is.
    product = np.broadcast_to(np.eye(k), (nb, k, k)).copy()
    for s in range(BLOCK):
        step = (product.reshape(-1, k) @ t).reshape(nb, k, k) * grid[:, s][:, None, :]
        product = np.where(real[:, s][:, None, None], step, product)
        if s % 8 == 7:
            product /= product.max(axis=(1, 2), keepdims=True)
    inward, outward = np.empty((nb, k)), np.empty((nb, k))
    most = int(blocks.max()) if len(blocks) else 0
    ahead = np.full((len(counts), k), 1.0 / k)
    behind = np.ones((len(counts), k))
    for j in range(most):
        has = np.flatnonzero(blocks > j)
        at = first[has] + j
        inward[at] = ahead[has]
        nxt = np.einsum("nk,nkl->nl", ahead[has], product[at])
        ahead[has] = nxt / nxt.sum(axis=1, keepdims=True)
    for j in range(most - 1, -1, -1):
        has = np.flatnonzero(blocks > j)
        at = first[has] + j
        outward[at] = behind[has]
        prv = np.einsum("nkl,nl->nk", product[at], behind[has])
        behind[has] = prv / prv.sum(axis=1, keepdims=True)
    alpha, current = np.empty((nb, BLOCK, k)), inward
    for s in range(BLOCK):
        step = (current @ t) * grid[:, s]
        step /= step.sum(axis=1, keepdims=True)
        current = np.where(real[:, s][:, None], step, current)
        alpha[:, s] = current
    posterior, current, moved = np.empty((nb, BLOCK, k)), outward, np.zeros((k, k))
    for s in range(BLOCK - 1, -1, -1):
        p = alpha[:, s] * current
        posterior[:, s] = p / p.sum(axis=1, keepdims=True)
        here = real[:, s]
        message = grid[:, s] * current
        before = alpha[:, s - 1] if s else inward
        pair = before[:, :, None] * t[None] * message[:, None, :]
        pair /= pair.sum(axis=(1, 2), keepdims=True)
        moved += pair[here].sum(axis=0)
        back = message @ t.T
        back /= back.sum(axis=1, keepdims=True)
        current = np.where(here[:, None], back, current)
    return posterior[row, col], moved


class Crf:
    """Languages, feature weights (BUCKETS x languages) and transition weights."""

    def __init__(self, languages: list[str], weights: np.ndarray, transition: np.ndarray):
        self.languages, self.weights, self.transition = languages, weights, transition


def fit(texts: list[str], langs: list[str], seed: int = 5) -> Crf:
    """Maximum likelihood by Adagrad on interleaved spans of the labelled texts."""
    languages = sorted(set(langs))
    k = len(languages)
    if k < 2:
        return Crf(languages, np.zeros((BUCKETS, k), dtype=np.float32), np.zeros((k, k)))
    rng = np.random.RandomState(seed)
    letter, lower = letter_table()
    flat, counts = split_words(pa.array(texts), False)
    coded = flat.dictionary_encode()
    ids = coded.indices.to_numpy(zero_copy_only=False)
    ends = np.cumsum(counts)
    spans = []
    for d in range(len(texts)):
        at, end = int(ends[d] - counts[d]), int(ends[d])
        while at < end:
            size = int(rng.randint(5, 41))
            spans.append((at, min(at + size, end), languages.index(langs[d])))
            at += size
    order, taken, total = rng.permutation(len(spans)), [], 0
    for s in order:
        if total >= TRAIN_WORDS:
            break
        taken.append(spans[s])
        total += spans[s][1] - spans[s][0]
    words = np.concatenate([ids[a:b] for a, b, _ in taken])
    truth = np.concatenate([np.full(b - a, y) for a, b, y in taken])
    lengths = np.array([sum(b - a for a, b, _ in taken[i:i + 4]) for i in range(0, len(taken), 4)])
    used, words = np.unique(words, return_inverse=True)
    dictionary = coded.dictionary.to_pylist()
    features, starts, _ = word_features([dictionary[i] for i in used], letter, lower)
    size = np.diff(starts)
    scale = 1 / np.sqrt(np.maximum(size, 1))
    active, local = np.unique(features, return_inverse=True)
    owner = np.repeat(np.arange(len(size)), size)
    weights, transition = np.zeros((len(active), k)), np.zeros((k, k))
    sq_w, sq_t = np.full((len(active), k), 1e-6), np.full((k, k), 1e-6)
    begins = np.cumsum(lengths) - lengths
    inner = np.ones(len(words), dtype=bool)
    inner[begins] = False
    at = np.flatnonzero(inner)
    seen = np.bincount(truth[at - 1] * k + truth[at], minlength=k * k).reshape(k, k)
    for _ in range(EPOCHS):
        emission = emissions(local, starts, weights)[words]
        posterior, moved = posteriors(emission, lengths, transition)
        residual = -posterior
        residual[np.arange(len(words)), truth] += 1
        by_word = np.stack([np.bincount(words, residual[:, c], len(size)) for c in range(k)], axis=1) * scale[:, None]
        grad = np.stack([np.bincount(local, by_word[owner, c], len(active)) for c in range(k)], axis=1) / len(words) * 1000 - 0.01 * weights
        sq_w += grad ** 2
        weights += RATE * grad / np.sqrt(sq_w)
        step = (seen - moved) / len(words) * 100 - 0.01 * transition
        sq_t += step ** 2
        transition += RATE * step / np.sqrt(sq_t)
    full = np.zeros((BUCKETS, k), dtype=np.float32)
    full[active] = weights
    return Crf(languages, full, transition)


def train(docs: DataFrame, sample: int = SAMPLE) -> Crf:
    """Fit on at most ``sample`` documents with a language and a text."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    rows = even_sample(known, "doc_id", "lang", sample).select("lang", F.substring("text", 1, SAMPLE_CHARS).alias("text"))
    got = sorted((r["lang"], r["text"]) for r in rows.collect())
    return fit([t for _, t in got], [x for x, _ in got])


def _label_batch(texts: pa.Array, model: Crf, letter: np.ndarray, lower: np.ndarray):
    """Words, words per text, each word's posterior and whether it has letters."""
    flat, counts = split_words(texts, False)
    if not len(flat) or not model.languages:
        return flat, counts, np.zeros((len(flat), max(len(model.languages), 1))), np.zeros(len(flat), dtype=bool)
    coded = flat.dictionary_encode()
    features, starts, has = word_features(coded.dictionary.to_pylist(), letter, lower)
    ids = coded.indices.to_numpy(zero_copy_only=False)
    full = counts > 0
    posterior, _ = posteriors(emissions(features, starts, model.weights)[ids], counts[full], model.transition)
    return flat, counts, posterior, has[ids]


def label_words(docs: DataFrame, model: Crf) -> DataFrame:
    """doc_id, words (word, lang, probability): every word of every text with its most probable language."""
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))

    def run(batches):
        letter, lower = letter_table()
        crf = Crf(**shared.value)
        for whole in batches:
            for b in pieces(whole, "text", PIECE):
                flat, counts, posterior, _ = _label_batch(b.column("text"), crf, letter, lower)
                best = posterior.argmax(axis=1)
                names = crf.languages or [UNKNOWN]
                rows, at = [], 0
                for n in counts:
                    rows.append([{"word": w.decode("utf-8", "replace"), "lang": names[j], "probability": float(p[j])}
                                 for w, j, p in zip(flat.slice(at, n).to_pylist(), best[at:at + n], posterior[at:at + n])])
                    at += n
                kind = pa.list_(pa.struct([("word", pa.string()), ("lang", pa.string()), ("probability", pa.float64())]))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(rows, type=kind)], names=["doc_id", "words"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, words array<struct<word:string,lang:string,probability:double>>")


def _predict_batches(shared, batches):
    """Rows as they came plus lang_pred and score."""
    letter, lower = letter_table()
    crf = Crf(**shared.value)
    for whole in batches:
        for b in pieces(whole, "text", PIECE):
            _, counts, posterior, has = _label_batch(b.column("text"), crf, letter, lower)
            owner = np.repeat(np.arange(len(counts)), counts)[has]
            sums = np.stack([np.bincount(owner, posterior[has, c], len(counts)) for c in range(posterior.shape[1])], axis=1)
            n = np.bincount(owner, minlength=len(counts))
            best = sums.argmax(axis=1)
            score = np.where(n > 0, sums.max(axis=1) / np.maximum(n, 1), 0.0)
            lang = [crf.languages[j] if m else UNKNOWN for j, m in zip(best, n)]
            names = [c for c in b.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(lang, pa.string()), pa.array(np.clip(score, 0, 1))], names=[*names, "lang_pred", "score"])


def predict(docs: DataFrame, model: Crf) -> DataFrame:
    """doc_id, lang_pred, score of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lambda it: _predict_batches(shared, it), "doc_id long, lang_pred string, score double")


def predict_rows(docs: DataFrame, model: Crf) -> DataFrame:
    """doc (the whole row), lang_pred, score of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))
    rows = docs.select(F.struct("*").alias("doc"))
    schema = rows.select("doc").schema.add("lang_pred", "string").add("score", "double")

    def run(batches):
        # The text is taken from the row, so that it reaches the task once.
        return _predict_batches(shared, (pa.RecordBatch.from_arrays([d, d.field("text")], names=["doc", "text"]) for d in (b.column("doc") for b in batches)))

    return rows.mapInArrow(run, schema)


def languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from rows whose id fold (modulo 4) is not 2."""
    model = train(docs.filter(fold(F.col("doc_id"), 4) != 2))
    return predict(docs, model).select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


def known(docs: DataFrame, least: float = 0.35) -> DataFrame:
    """doc (the whole row), lang_pred, score of the documents whose language is known with a score of ``least`` or more.

    The score is the mean posterior of the language over the words, so a text mixed evenly of two languages passes; one
    mixed evenly of three or more goes, as does one without letters."""
    found = predict_rows(docs, train(docs.filter(fold(F.col("doc_id"), 4) != 2)))
    return found.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least))
