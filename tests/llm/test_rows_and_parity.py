"""Stages that drop rows keep one row of each group, whatever the ids; op8 compares every text; long texts."""

from __future__ import annotations

import pyarrow as pa
import sentencepiece

from profilebook.llm import exact, fingerprint, langid, linedup, minhash, mixing, spm
from tests.llm.test_native import table

LONG = " ".join(f"word{i} other{i % 97}" for i in range(60))


def test_near_groups_of_repeated_ids_leave_one_row_each(spark):
    other = " ".join(f"x{i}" for i in range(40))
    rows = [(1, LONG), (4, LONG), (4, other), (4, other), (None, other + " more"), (9, ""), (9, ""), (9, None), (2, "alone here")]
    d = table(spark, rows)
    got = sorted(((r["doc_id"], r["text"]) for r in minhash.drop_near(d).collect()), key=repr)
    # rows without words are linked with nothing
    assert got == sorted([(1, LONG), (None, other + " more"), (9, ""), (9, ""), (9, None), (2, "alone here")], key=repr)
    assert minhash.drop_near(d).columns == d.columns and minhash.drop_near(table(spark, [])).collect() == []


def test_exact_groups_of_repeated_ids_leave_one_row_each(spark):
    rows = [(1, "t"), (4, "t"), (4, "other"), (4, "other"), (None, "other"), (None, "z"), (3, ""), (5, None)]
    got = sorted(((r["doc_id"], r["text"]) for r in exact.drop_copies(table(spark, rows)).collect()), key=repr)
    assert got == sorted([(4, "t"), (4, "other"), (None, "z"), (5, None)], key=repr)


class Odd:
    """A library that knows one word otherwise."""

    def __init__(self, path):
        self.real = sentencepiece.SentencePieceProcessor(model_file=path)

    def encode(self, texts, num_threads=1):
        return [[y for w in t.split(" ") for y in ([7, 8] if w == "three" else self.real.encode(w))] if "  " not in t else x
                for t, x in zip(texts, self.real.encode(texts))]


def test_every_word_is_compared():
    data = spm._bytes(spm.MODEL)
    tok, starts = spm.build(data), spm.word_starts(data)
    texts = pa.array(["one two three", "one two", "three", "", "two  blanks", "x three y three"])
    ids, same, back = spm.checked_texts(spm.Words(tok, Odd(spm.MODEL), starts), texts)
    assert same == [False, True, False, True, True, False] and back == same
    own = spm.encode_texts(tok, starts, texts)
    assert [i for i in range(6) if ids[i].tolist() != own[i].tolist()] == [0, 2, 5]
    assert ids[0].tolist() == [*own[1].tolist(), 7, 8]
    real = sentencepiece.SentencePieceProcessor(model_file=spm.MODEL)
    known = spm.Words(tok, real, starts)
    ids, same, back = spm.checked_texts(known, texts)
    assert back == [tok.decode(x.tolist(), skip_special_tokens=False) == t for x, t in zip(ids, texts.to_pylist())]
    again = spm.checked_texts(known, texts)
    assert [x.tolist() for x in again[0]] == [x.tolist() for x in ids] and again[1] == same
    assert all(same) and [x.tolist() for x in ids] == real.encode(texts.to_pylist())


def test_very_long_texts(spark):
    big = " ".join(f"w{i % 5003}" for i in range(200_000))
    d = table(spark, [(1, big), (2, big + " end"), (3, "short text"), (4, "y" * 1_000_000)])
    groups = {r["doc_id"]: r["component_id"] for r in minhash.near_groups(d).collect()}
    assert groups == {1: 1, 2: 1, 3: 3, 4: 4}
    assert {r["doc_id"]: r["n_chars"] for r in fingerprint.fingerprints(d).collect()} == {1: len(big), 2: len(big) + 4, 3: 10, 4: 1_000_000}
    assert linedup.dedup_lines(d).count() == mixing.mix(d).count() == 4
    model = langid.fit(["the house and the tree", "das Haus und der Baum"] * 30, ["en", "de"] * 30)
    assert {r["doc_id"] for r in langid.predict(d, model).collect()} == {1, 2, 3, 4}
