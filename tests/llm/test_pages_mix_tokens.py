"""HTML extraction, source mixing, SentencePiece and the pipeline."""

from __future__ import annotations

import bisect
import html as references
import itertools
import random
import re

import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from profilebook.llm import html, mixing, spm
from profilebook.llm.common import read
from tests.llm.test_native import table

SF = "/root/testdata/sf0.01"


def expected(page):
    """The article of the test pages, cut out by their one known layout."""
    article = re.search(r"<article>(.*?)</article>", page, re.S)[1].replace("<br>", " ")
    blocks = (" ".join(references.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", article))
    return "\n".join(b for b in blocks if b)


def test_pages_match_layout(spark):
    pages = read(spark, SF, "pages")
    got = {r["page_id"]: r for r in html.main_texts(pages).collect()}
    for r in pages.collect():
        assert got[r["page_id"]]["text"] == expected(r["html"]) and got[r["page_id"]]["n_chars"] == len(expected(r["html"]))


MADE = """<!DOCTYPE html><html><head><title>T</title><style>p > a {}</style></head><body class="has-sidebar">
<header><h2>Site</h2></header><nav><ul><li><a href="/a">one</a></li></ul></nav><div class="cookie-notice">We use cookies, accept</div>
<main><h1>A &amp; B</h1><p>First&nbsp;para   with <b>bo</b>ld<br>text.</p><div class="ad-slot">Buy this now</div><ul><li>item one</li><li>item 2 &lt; 3</li></ul>
<script>if (a < b) document.write("<p>no</p>")</script><p title="x > y">Second 1 < 2 para &#233;</p><form><label>Name</label><input></form>
<section id="comments"><p>great post</p></section><p>Last one</p></main><aside>More links</aside><footer>&copy; all</footer></body></html>"""


def test_made_page(spark):
    weights = html.train(read(spark, SF, "pages"))
    want = "A & B\nFirst para with bold text.\nitem one\nitem 2 < 3\nSecond 1 < 2 para é\nLast one"
    assert html.extract(MADE, weights) == want
    assert html.extract(MADE.replace("main>", "article>"), weights) == want
    assert html.extract(MADE.replace("</ul></nav>", "</ul>"), weights) == want
    assert html.extract(MADE.replace("main>", "div>"), weights) == want


def test_best_run_is_the_best():
    rng = random.Random(0)
    for _ in range(200):
        s = [rng.choice([-2, -1, -0.5, 0, 1, 2.5]) for _ in range(12)]
        best = max((sum(s[a:b]) for a in range(12) for b in range(a + 1, 13)), default=0)
        a, b = html.best_run(s)
        assert sum(s[a:b]) == pytest.approx(max(best, 0))


def test_pages_nulls_and_empty(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<p>"), (4, "u", "plain words only"), (5, "u", "<!-- open"), (6, "u", "<script>x"), (7, "u", "<p>" * 5000 + "deep")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {r["page_id"]: r["text"] for r in html.main_texts(pages).collect()}
    assert got == {1: "", 2: "", None: "", 4: "plain words only", 5: "", 6: "", 7: "deep"}
    assert html.main_texts(pages.filter("false")).collect() == []


def test_schedule_deviates_less_than_one_block():
    rng = random.Random(4)
    for _ in range(30):
        quota = mixing.quotas({s: rng.randint(1, 50) for s in range(rng.randint(1, 12))}, rng.randint(12, 120))
        period, slots = sum(quota.values()), mixing.schedule(quota)
        assert sorted(itertools.chain(*slots.values())) == list(range(period))
        for s, q in quota.items():
            assert all(abs(bisect.bisect_left(slots[s], t) - q * t / period) < 1 for t in range(period + 1))
            for j, t in enumerate(slots[s]):
                assert j * period // q <= t < -(-(j + 1) * period // q)


def test_mix_keeps_every_row_and_weight(spark):
    rows = [(i, f"t{i}", None, "abc"[min(i % 5, 2)], 1) for i in range(500)] + [(None, None, None, None, None), (7, "t7", None, "c", 1)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("h", F.lit(1)).withColumn("part", F.lit(1))
    got = mixing.mix(d, {"a": 1, "b": 2, "c": 1}, block=4, period=20).select("doc.*", "slot", "place", "block").collect()
    assert len(got) == len({r["place"] for r in got}) == 502
    assert sorted(map(repr, (r["doc_id"] for r in got))) == sorted(map(repr, (r[0] for r in rows)))
    first = [r["source"] for r in sorted(got, key=lambda r: r["slot"]) if r["slot"] < 40]
    assert {s: first.count(s) for s in "abc"} == {"a": 40, "b": 80, "c": 40}
    assert max(r["slot"] for r in got if r["source"] is not None) < min(r["slot"] for r in got if r["source"] is None)
    mixed = mixing.mixed(d)
    assert mixed.columns == d.columns and mixed.count() == 502 and mixing.mix(d.filter("false")).collect() == []


def test_too_many_sources(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_SOURCES", 3)
    d = spark.range(10).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.col("id").cast("string").alias("source"))
    with pytest.raises(ValueError):
        mixing.mix(d)


def test_tokens_equal_the_library(spark):
    d = read(spark, SF, "documents")
    odd = table(spark, [(-1, "  two  blanks   here "), (-2, "日本語 🙂 ▁ mark"), (-3, "<s> </s> <0x41>\x00\ttab\nline"), (-4, ""), (-5, None), (-6, "a" * 30_000), (-7, " " * 40 + "z")])
    both = d.select("doc_id", "text").union(odd.select("doc_id", "text")).withColumn("ids", F.lit(0))
    texts = {r["doc_id"]: r["text"] or "" for r in both.collect()}
    sp = sentencepiece.SentencePieceProcessor(model_file=spm.MODEL)
    got = spm.token_table(both).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r["ids"] == sp.encode(texts[r["doc_id"]]) and r["n_tokens"] == len(r["ids"])
    assert sum(r["roundtrip"] for r in got) >= len(got) - 2
    back = {r["doc_id"]: r["text"] for r in spm.decode(spm.encode(both)).collect()}
    assert all(back[i] == t for i, t in texts.items() if "▁" not in t)


def test_words_make_up_the_ids_of_texts():
    rng = random.Random(5)
    made = ["".join(rng.choice("ab  \n\té漢<s>▁") for _ in range(rng.randint(0, 12))) for _ in range(500)]
    texts = ["", " ", "a", " a", "a ", "a  b", "▁", "a ▁b", "\n", "\na b\n", "日本 語", "😀 x", "<s> </s> <unk>", *made]
    data = spm._bytes(spm.MODEL)
    tok, starts = spm.build(data), spm.word_starts(data)
    whole = spm._encode_batch(tok, texts)
    assert starts is not None
    assert [x.tolist() for x in spm.encode_texts(tok, starts, pa.array(texts))] == whole
    assert [x.tolist() for x in spm.encode_texts(tok, None, pa.array(texts))] == whole
    assert [x.tolist() for x in spm.encode_texts(tok, starts, pa.array(texts).slice(9, 40))] == whole[9:49]
    assert spm.encode_texts(tok, starts, pa.array([], pa.string())) == []


def test_unigram_models_are_rebuilt():
    """A unigram model's protobuf, written here field by field, gives the same ids in both libraries."""
    def varint(n):
        out = b""
        while True:
            out += bytes([n & 127 | (128 if n > 127 else 0)])
            n >>= 7
            if not n:
                return out

    def field(number, kind, value):
        return varint(number << 3 | kind) + (varint(value) if kind == 0 else value if kind == 5 else varint(len(value)) + value)

    import struct
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *((f"<0x{i:02X}>", 0.0, 6) for i in range(256)), ("▁", -2.0, 1), ("▁ab", -3.0, 1), ("ab", -3.5, 1), ("a", -4.0, 1),
              ("b", -4.5, 1), ("c", -5.0, 1), ("bc", -4.2, 1), ("▁a", -3.8, 1)]
    model = b"".join(field(1, 2, field(1, 2, t.encode()) + field(2, 5, struct.pack("<f", s)) + field(3, 0, k)) for t, s, k in pieces)
    model += field(2, 2, field(3, 0, 1) + field(35, 0, 1)) + field(3, 2, field(1, 2, b"identity") + field(3, 0, 1) + field(4, 0, 1) + field(5, 0, 1))
    sp, tok = sentencepiece.SentencePieceProcessor(model_proto=model), spm.build(model)
    for t in ("abc ab", "  a  b c ", "cab é abcab", "bcbc"):
        assert tok.encode(t, add_special_tokens=False).ids == sp.encode(t)


def test_pipeline_stages(spark):
    """Each stage's decisions against what its operator says of that stage's own input, and the last stage's rows."""
    docs = read(spark, "/root/testdata/sf0.001", "documents")
    extra = spark.createDataFrame([(10 ** 6, None, None, "s", 0), (10 ** 6 + 1, "12 34", None, "s", 5)], docs.schema)
    docs = docs.union(extra)
    seen = [docs.cache()]
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, seen[-1], "").cache()
        if stage is not corpus_pipeline.STAGES[-1][1]:
            assert out.columns == docs.columns
        seen.append(out)
    ids = [{r["doc_id"] for r in d.collect()} for d in seen]
    assert 10 ** 6 not in ids[1] and 10 ** 6 + 1 not in ids[1] and len(ids[1]) == len(ids[0]) - 2
    assert ids[2] <= ids[1] and ids[3] <= ids[2] and ids[4] == ids[3] == ids[5]
    assert seen[4].count() == seen[3].count()
    assert all(r["n_chars"] == len(r["text"]) for r in seen[2].collect())
    sp = sentencepiece.SentencePieceProcessor(model_file=spm.MODEL)
    texts = {r["doc_id"]: r["text"] for r in seen[4].collect()}
    assert all(r["ids"] == sp.encode(texts[r["doc_id"]]) for r in seen[5].collect())
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
