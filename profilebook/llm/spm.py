"""SentencePiece encoding and decoding by the tokenizers library.

The model's protobuf is read field by field; from it a ``tokenizers`` tokenizer is rebuilt: the normaliser (identity, or
the library's precompiled character map, white space collapsed and trimmed where the model says so), the meta space
marker, and the pieces as a unigram model with its scores or, when the model says so, as byte pair merges ordered by
score, both with byte fallback.  Batches are encoded by the library's own threads; where no piece can cross a blank, each
distinct word of a batch is encoded once and the texts' ids are put together from them.  Parity with the ``sentencepiece``
library is verified for every text: where words are parted by single blanks each distinct word of a batch is encoded by
both, else the whole text.  Byte pair pieces of equal score (runs of blanks) have no merge order of their own, and a text
may hold the marker itself; where the two libraries differ the row has the sentencepiece library's ids and ``same`` is
false.

The model file's path is a parameter; the driver reads it (its size is checked against ``MAX_MODEL``) and sends its
bytes with the job, so executors need no file.

Defined results: a null or empty text has no tokens and decodes to the empty text.  Decoding gives back the normalised
text; ``roundtrip`` says whether it equals the text itself.  Extra columns are ignored.  An empty table gives an empty
result.
"""

from __future__ import annotations

import itertools
import json
import os
import struct
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profilebook.llm.common import text_of
from profilebook.llm.words import pieces

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MAX_MODEL = 64_000_000
#: Bytes of text whose ids a task holds at once (a longer text is alone); larger pieces meet fewer words twice.
PIECE = 1_000_000
THREADS = "2"
MARK = "▁"
#: Distinct words that are encoded as one text.
JOINED = 256
#: Piece types and model types of the format.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def fields(data: bytes):
    """(number, value) of a protobuf message; numbers stay numbers, everything else bytes."""
    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(data):
        tag, at = varint(at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(at)
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, at = data[at:at + size], at + size
        elif kind == 2:
            size, at = varint(at)
            value, at = data[at:at + size], at + size
        else:
            raise ValueError(f"wire type {kind} is not part of the format")
        yield tag >> 3, value


def parse_model(data: bytes) -> dict:
    """Pieces (text, score, type), trainer and normaliser settings of a model file."""
    model = {"pieces": [], "type": UNIGRAM, "byte_fallback": False, "prefix": True, "collapse": True, "escape": True, "charsmap": b""}
    for number, value in fields(data):
        if number == 1:
            piece = dict(fields(value))
            model["pieces"].append((piece[1].decode(), struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0, piece.get(3, NORMAL)))
        elif number == 2:
            trainer = dict(fields(value))
            model["type"], model["byte_fallback"] = trainer.get(3, UNIGRAM), bool(trainer.get(35, 0))
        elif number == 3:
            norm = dict(fields(value))
            model.update(charsmap=norm.get(2, b""), prefix=bool(norm.get(3, 1)), collapse=bool(norm.get(4, 1)), escape=bool(norm.get(5, 1)))
    return model


def build(data: bytes):
    """The model as a tokenizers.Tokenizer."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    model = parse_model(data)
    texts = [p[0] for p in model["pieces"]]
    unknown = next((i for i, p in enumerate(model["pieces"]) if p[2] == UNKNOWN), 0)
    if model["type"] == UNIGRAM:
        core = models.Unigram([(t, s) for t, s, _ in model["pieces"]], unk_id=unknown, byte_fallback=model["byte_fallback"])
    elif model["type"] == BPE:
        ids = {t: i for i, t in enumerate(texts)}
        score = {t: s for t, s, kind in model["pieces"] if kind in (NORMAL, USER, UNUSED)}
        merges = [(-score[t], ids[t[:i]], t[:i], t[i:]) for t in score for i in range(1, len(t)) if t[:i] in score and t[i:] in score]
        core = models.BPE(vocab=ids, merges=[(a, b) for _, _, a, b in sorted(merges)], unk_token=texts[unknown], fuse_unk=True, byte_fallback=model["byte_fallback"])
    else:
        raise ValueError("only unigram and byte pair models can be rebuilt")
    tok = Tokenizer(core)
    steps = [normalizers.Precompiled(model["charsmap"])] if model["charsmap"] else []
    if model["collapse"]:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Strip()]
    if model["prefix"]:
        steps.append(normalizers.Prepend(MARK))
    steps.append(normalizers.Replace(" ", MARK))
    tok.normalizer = normalizers.Sequence(steps)
    if not any(MARK in t.lstrip(MARK) for t in texts):
        # No piece has a marker behind another sign, so no merge crosses these places: words are encoded one by one.
        tok.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}+[^{MARK}]*|[^{MARK}]+"), "isolated")
    tail = [decoders.Strip(" ", 1, 0)] if model["prefix"] else []
    tok.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *tail])
    return tok


def _bytes(path: str) -> bytes:
    if os.path.getsize(path) > MAX_MODEL:
        raise ValueError(f"{path} is larger than {MAX_MODEL} bytes")
    with open(path, "rb") as f:
        return f.read()


def _encode_batch(tok, texts: list[str]) -> list[list[int]]:
    return [e.ids if t else [] for t, e in zip(texts, tok.encode_batch_fast(texts, add_special_tokens=False))]


def _decode_batch(tok, ids: list[list[int]]) -> list[str]:
    return tok.decode_batch(ids, skip_special_tokens=False)


def word_starts(data: bytes) -> np.ndarray | None:
    """For each id whether its piece begins with the marker; None if ids of words do not make up the ids of texts."""
    model = parse_model(data)
    texts = [p[0] for p in model["pieces"]]
    if model["charsmap"] or model["collapse"] or not model["prefix"] or any(MARK in t.lstrip(MARK) for t in texts):
        return None
    return np.array([t.startswith(MARK) for t in texts])


class Words:
    """Both libraries for one model, and encoding word by word."""

    def __init__(self, tok, check, starts: np.ndarray | None):
        self.tok, self.check, self.starts = tok, check, starts

    def ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
        """The words' ids one after the other, where each word's begin, whether they are those of the sentencepiece
        library, whose ids count where the two differ, and whether they decode to the word.

        No piece crosses a blank, so ``JOINED`` words are encoded and decoded as one text; if both libraries give the same
        ids for it, and these decode to it, that holds for each of its words, else they are looked at one by one.  None if
        a word has no piece that begins with the marker, or more than one."""
        joined = [" ".join(words[i:i + JOINED]) for i in range(0, len(words), JOINED)]
        chunks = _encode_batch(self.tok, joined)
        flat = np.fromiter(itertools.chain.from_iterable(chunks), dtype=np.int32)
        begin = np.flatnonzero(self.starts[flat])
        if len(begin) != len(words) or begin[0]:
            return None
        agree = np.ones(len(words), dtype=bool)
        within = lambda ks: [i for k in ks for i in range(k * JOINED, min((k + 1) * JOINED, len(words)))]
        back = np.ones(len(words), dtype=bool)
        failed = within(k for k, (a, b) in enumerate(zip(joined, _decode_batch(self.tok, chunks))) if a != b)
        if odd := within(k for k, (a, b) in enumerate(zip(chunks, self.check.encode(joined, num_threads=1) if self.check else chunks)) if a != b):
            own = np.split(flat, begin[1:])
            for i, expected in zip(odd, self.check.encode([words[i] for i in odd], num_threads=1)):
                if own[i].tolist() != expected:
                    own[i], agree[i] = np.array(expected, dtype=np.int32), False
            flat, begin = np.concatenate(own), np.concatenate([[0], np.cumsum([len(x) for x in own])])[:-1]
        if look := sorted({*odd, *failed}):
            own = np.split(flat, begin[1:])
            back[look] = [words[i] == t for i, t in zip(look, _decode_batch(self.tok, [own[i].tolist() for i in look]))]
        return flat, begin, agree, back

    def encode(self, texts: pa.Array) -> tuple[list[np.ndarray], np.ndarray, np.ndarray] | None:
        """The ids of texts whose words are parted by single blanks, whether they are the sentencepiece library's and whether
        they decode to the text; each distinct word is encoded and decoded once."""
        parts = pc.split_pattern(texts, " ")
        coded = parts.flatten().dictionary_encode()
        got = self.ids(coded.dictionary.to_pylist())
        if got is None:
            return None
        flat, begin, agree, back = got
        index = coded.indices.to_numpy()
        n = np.diff(begin, append=len(flat))[index]
        end = np.cumsum(n)
        ids = flat[np.arange(end[-1]) + np.repeat(begin[index] - (end - n), n)]
        offsets = parts.offsets.to_numpy() - parts.offsets[0].as_py()
        cuts = np.concatenate([[0], end])[offsets]
        every = lambda x: np.logical_and.reduceat(x[index], offsets[:-1])
        return [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:])], every(agree), every(back)


def encode_texts(tok, starts: np.ndarray | None, texts: pa.Array) -> list[np.ndarray]:
    """The ids of every text."""
    return checked_texts(Words(tok, None, starts), texts)[0]


def checked_texts(words: Words, texts: pa.Array) -> tuple[list[np.ndarray], list[bool], list[bool]]:
    """The ids of every text, whether they are those of the library ``words.check`` (True throughout without one), and whether
    they decode to the text."""
    tok, check = words.tok, words.check
    out: list = [None] * len(texts)
    same, back = [True] * len(texts), [True] * len(texts)
    if words.starts is not None and len(texts):
        other = pc.match_substring_regex(texts, f"^$|^ | $|  |{MARK}").to_numpy(zero_copy_only=False)
        plain = np.flatnonzero(~other)
        if len(plain) and (got := words.encode(texts.take(pa.array(plain)))):
            for i, ids, agree, whole in zip(plain, *got):
                out[i], same[i], back[i] = ids, bool(agree), bool(whole)
    rest = [i for i, x in enumerate(out) if x is None]
    if rest:
        whole = texts.take(pa.array(rest, pa.int64())).to_pylist()
        for i, own, expected in zip(rest, _encode_batch(tok, whole), check.encode(whole, num_threads=1) if check else itertools.repeat(None)):
            same[i] = expected is None or own == expected
            out[i] = np.array(own if same[i] else expected, dtype=np.int32)
        for i, text, t in zip(rest, whole, _decode_batch(tok, [out[i].tolist() for i in rest])):
            back[i] = text == t
    return out, same, back


def encode(docs: DataFrame, path: str = MODEL, keep: Sequence[str] = (), piece: int = PIECE) -> DataFrame:
    """doc_id, ids (array of int), same, roundtrip for every whole text, and the columns ``keep`` (long) as they are.

    ``same``: the tokenizers library's ids are the sentencepiece library's, compared for every text (word by word where
    words are parted by single blanks).  Where they differ the row holds the sentencepiece library's."""
    shared = docs.sparkSession.sparkContext.broadcast(_bytes(path))
    arrow = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("same", pa.bool_()), ("roundtrip", pa.bool_()), *((c, pa.int64()) for c in keep)])

    def run(batches):
        import sentencepiece

        os.environ.setdefault("RAYON_NUM_THREADS", THREADS)
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        tok = build(shared.value)
        words = Words(tok, sentencepiece.SentencePieceProcessor(model_proto=shared.value), word_starts(shared.value))
        for whole in batches:
            for b in pieces(whole, "text", piece, 10_000):
                ids, same, back = checked_texts(words, b.column("text"))
                offsets = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), lists, pa.array(same), pa.array(back), *(b.column(c) for c in keep)], schema=arrow)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"), *(F.col(c).cast("long").alias(c) for c in keep))
    return rows.mapInArrow(run, ", ".join(["doc_id long, ids array<int>, same boolean, roundtrip boolean", *(f"{c} long" for c in keep)]))


def decode(encoded: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id, text for every row of doc_id, ids (a null list decodes to the empty text)."""
    shared = encoded.sparkSession.sparkContext.broadcast(_bytes(path))

    def run(batches):
        tok = build(shared.value)
        for b in batches:
            texts = _decode_batch(tok, [x or [] for x in b.column("ids").to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")


def token_table(docs: DataFrame, path: str = MODEL, keep: Sequence[str] = (), piece: int = PIECE) -> DataFrame:
    """doc_id, n_tokens, ids, same, roundtrip, and the columns ``keep``."""
    return encode(docs, path, keep, piece).select("doc_id", F.size("ids").alias("n_tokens"), "ids", "same", "roundtrip", *keep)
