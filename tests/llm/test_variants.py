"""Spelling variants against brute force over all pairs of words, and edge cases."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import duckdb
import pandas as pd
import pytest

from profilebook.llm import variants

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA)


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain(rows):
    counts: Counter = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-z\u00C0-\u00FF]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run[:h % len(run)] + run[h % len(run) + 1:] if h % 97 == 0 else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None
    out = []
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out)


def corpus():
    draw = random.Random(5)
    letters = "abé×ÿz"
    words = ["".join(draw.choice(letters) for _ in range(draw.randint(4, 9))) for _ in range(60)]
    words += [w[:k] + draw.choice(letters) + w[k + draw.randint(0, 1):] for w in words for k in [draw.randint(0, len(w))] * 2]
    words += [w + w[-1] for w in words[:20]] + [w[1:] for w in words[:20]] + ["aaaaa", "aaaaaa", "aaaaaaa", "Colour", "color", "colours", "ÀÀÀÀÀ", "ààààà"]
    return [(i, " ".join(draw.choice(words) for _ in range(60)) + ", COLOUR_colour2colour") for i in range(60)] + [
        (None, "aaaaa " * 40), (None, None), (3, ""), (4, "colour " * 30_000), (4, "colour " * 30), (5, "a" * 50_000 + " " + "a" * 50_001), (6, "12 %")]


@pytest.mark.parametrize("most", [2, 40, 8_192])
def test_variants_match_brute_force(spark, most):
    rows = corpus() + [(1, "b" * 50_000 + "a " + "b" * 50_001 + " ")] * 3
    assert sorted(map(tuple, variants.spelling_variants(table(spark, rows), most).collect())) == plain(rows)


def test_sql_matches_brute_force():
    rows = corpus()
    con = duckdb.connect()
    con.register("documents", pd.DataFrame({"doc_id": pd.array([r[0] for r in rows], dtype="Int64"), "text": pd.array([r[1] for r in rows], dtype="string")}))
    cur = con.execute(variants.ORACLE)
    assert [d[0] for d in cur.description] == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(cur.fetchall()) == plain(rows)


def test_words_of_every_letter_in_a_hole_of_one(spark):
    rows = [(i, f"ab{c}cd ab{c}{c}cd abcd{c}") for i, c in enumerate("abcdefghijklmnopqrstuvwxyzàéîõü")] * 3
    assert sorted(map(tuple, variants.spelling_variants(table(spark, rows), 5).collect())) == plain(rows)


def test_empty_table_and_clashing_columns(spark):
    assert variants.spelling_variants(table(spark, [])).collect() == []
    rows = [(1, "colour colour colour color color color color color color")]
    wide = table(spark, rows).selectExpr("*", "1 AS word", "2 AS n", "3 AS m", "4 AS block", "5 AS form", "6 AS root", "7 AS best")
    assert sorted(map(tuple, variants.spelling_variants(wide).collect())) == plain(rows)
