"""Language identification, hard negatives and collocations: brute force, held-out accuracy, edge cases."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from attestor.llm import collocations, hard_negatives, language_id
from attestor.llm.queries import QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", None) for i, t, lang in rows], DOCS)


def plain_collocations(rows, least, longest=4, top=2000):
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = lang or "und"
        body = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", body):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    found = {}
    often = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    for (lang, p), a in often.items():
        inside = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))  # noqa: B023, E731
        if any(other == lang and len(q) > len(p) and inside(q) and 100 * b >= 80 * a for (other, q), b in often.items()):
            continue
        score, k = min((2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p)))
        found.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return {(lang, rank, p.decode(), -a, left, right, n[lang], -score) for lang, all_ in found.items() for rank, (score, a, p, left, right) in enumerate(sorted(all_)[:top], 1)}


def odd_texts():
    rng = random.Random(3)
    words = "The the of A a Ünï ünï x y \x00 b c".split(" ")
    rows = [(i, "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ". ", "\n", ", ", "\r"]) for _ in range(rng.randrange(60))), rng.choice(["en", "en", "de", None])) for i in range(60)]
    return [*rows, rows[0], (None, None, "en"), (61, "", None), (62, " \n", "fr"), (63, "a b " * 40, "one"), (64, "b", "one"), (65, " ".join(rng.choice(words) for _ in range(3000)), "long")]


def test_collocations_match_brute_force(spark):
    rows = odd_texts()
    docs = docs_of(spark, rows).selectExpr("*", "1 AS phrase", "2 AS f", "'x' AS prefix")
    for least, top in ((3, 2000), (8, 3)):
        assert {tuple(r) for r in collocations.collocations(docs, least=least, top=top).collect()} == plain_collocations(rows, least, top=top)
    assert collocations.collocations(docs.where("false")).count() == 0
    assert collocations.collocations(docs.where("text IS NULL")).count() == 0


def test_slices_cut_between_pieces(monkeypatch):
    texts = [(t or "").encode() for _, t, _ in odd_texts()]
    want = collocations._slices(pa.array(texts, pa.binary()))
    whole = [(w, bool(b)) for ids, words, fresh in want for w, b in zip(words.take(pa.array(ids)).to_pylist(), fresh)]
    monkeypatch.setattr(collocations, "SLICE", 50)
    parts = list(collocations._slices(pa.array(texts, pa.binary())))
    assert len(parts) > 20
    assert [(w, bool(b)) for ids, words, fresh in parts for w, b in zip(words.take(pa.array(ids)).to_pylist(), fresh)] == whole


def test_scores_beyond_64_bits(spark):
    """Counts so large that their products need decimals."""
    big = 9_000_000_000_000
    expr = "(CAST(a AS DECIMAL(20, 0)) * CAST(2000000 AS DECIMAL(7, 0))) div (CAST(l AS DECIMAL(20, 0)) + CAST(r AS DECIMAL(20, 0)))"
    got = spark.createDataFrame([(big, big + 1, big + 2)], "a long, l long, r long").select(F.expr(expr)).first()[0]
    assert got == big * 2000000 // (2 * big + 3)


def plain_negatives(rows, positives=5, negatives=3, every=50):
    kept = {}
    for i, label, x in rows:
        if i is None or label is None or x is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        v = tuple(math.floor(256 * float(np.float32(c))) for c in x)
        kept[i] = min(kept.get(i, (label, v)), (label, v))
    dot = lambda a, b: sum(p * q for p, q in zip(a, b))
    out = set()
    for a, (label, v) in kept.items():
        if a % every:
            continue
        scored = [(-dot(v, w), i, other) for i, (other, w) in kept.items() if i != a]
        for s, p, _ in sorted(x for x in scored if x[2] == label)[:positives]:
            fit = sorted((t, i) for t, i, other in scored if other != label and 50 * -s <= 100 * -t <= 95 * -s)[:negatives]
            out |= {(a, p, rank, i, -s, -t) for rank, (t, i) in enumerate(fit, 1)}
    return out


@pytest.mark.parametrize("spread", [2, 400])
def test_hard_negatives_match_brute_force(spark, spread):
    """Few values make many ties; odd rows take no part."""
    rng = random.Random(spread)
    rows = [(i, rng.randrange(4), [rng.randrange(-spread, spread + 1) / 200 for _ in range(70)]) for i in range(400)]
    rows += [rows[3], rows[50], (7, 0, [0.5] * 70), (500, None, [1.0] * 70), (501, 1, None), (502, 1, [math.nan] * 70), (503, 1, [None] * 70), (504, 1, [math.inf]), (None, 1, [1.0] * 70)]
    rows += [(600, 1, [2.0] * 3), (601, 1, []), (650, 9, [1.0] * 70), (700, 0, [0.0] * 70)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").selectExpr("*", "'x' AS id", "1 AS codes", "2 AS i")
    got = hard_negatives.hard_negatives(df, F.col("id") % 50 == 0)
    assert {tuple(r) for r in got.collect()} == plain_negatives(rows)
    assert hard_negatives.hard_negatives(df.where("false"), F.col("id") % 50 == 0).count() == 0


def test_intervals_hold_every_score():
    """At every level the score lies between the bounds, which narrow."""
    rng = np.random.default_rng(4)
    v = rng.integers(-300, 300, (200, 128)) * (rng.random((200, 128)) < 0.5)
    codes, align, rest = hard_negatives.encode(v)
    lists = lambda m: pa.array(m.reshape(len(v), -1).tolist())
    rows = pa.table({"id": range(200), "label": [0] * 200, "v": lists(v), "codes": lists(codes.view(np.int64)), "align": lists(align), "rest": lists(rest)})
    block = hard_negatives._Block(rows.slice(0, 20), rows)
    true = (v[:20, None] * v[None]).sum(axis=2)
    i, j = np.arange(20)[:, None], np.arange(200)[None]
    estimate, before = 0.0, math.inf
    for level in range(hard_negatives.LEVELS):
        met = block.meet(i, j, level)
        estimate = estimate + met * block.align[j, level]
        wide = block.width(i, j, level, met if level == 0 else None)
        assert (np.abs(true - estimate) <= wide).all()
        assert wide.mean() < before
        before = wide.mean()
    x, y = np.indices(true.shape).reshape(2, -1)
    assert (block.score(x, y) == true[x, y]).all()


def test_languages_of_held_out_documents(spark):
    rows = QUERIES["op11_language_id"](spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 200
    assert sum(r.lang_pred == r.lang for r in rows) >= 0.97 * len(rows)
    assert sum(r.lang_pred == r.lang for r in rows if r.accepted) >= 0.99 * sum(r.accepted for r in rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_id_takes_odd_rows(spark):
    rows = [(1, "le chat est sur la table", "fr"), (2, "the cat is on the table", "en"), (3, None, "en"), (4, "123 -- !", "fr"), (5, "the dog and the cat", None), (5, "the dog and the cat", "en"), (6, "", "en"), (7, "le chien est ici " * 5000, "fr"), (None, "est sur la", "fr")]
    docs = docs_of(spark, rows).selectExpr("*", "1 AS score", "2 AS h", "3 AS bucket")
    model = language_id.learn(docs)
    assert sorted(name for name, _ in model) == ["en", "fr"]
    got = {(r.doc_id, r.text): r for r in language_id.predict(docs, model).collect()}
    assert got[3, None].lang_pred == got[4, "123 -- !"].lang_pred == got[6, ""].lang_pred == "und"
    assert got[7, rows[7][1]].lang_pred == "fr" and got[5, "the dog and the cat"].lang_pred == "en"
    assert {r.lang_pred for r in language_id.predict(docs, []).collect()} == {"und"}
    assert language_id.predict(docs.where("false"), model).count() == 0 and language_id.learn(docs.where("false")) == []


def test_prediction_reads_only_the_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language_id.learn(docs)
    one = {r.doc_id: r.lang_pred for r in language_id.predict(docs, model).collect()}
    other = {r.doc_id: r.lang_pred for r in language_id.predict(docs.withColumns({"lang": F.lit("xx"), "source": F.lit(None)}), model).collect()}
    assert one == other
