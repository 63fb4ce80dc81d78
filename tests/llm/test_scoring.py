"""Language model, quality votes, personal data."""

import random

import brute
import pytest
from pyspark.sql import functions as F

from leeward.llm import perplexity, pii, quality


def test_kneser_ney(corpus, documents):
    train = [t for i, t in corpus if i % 3]
    model = perplexity.fit(documents.where("doc_id % 3 != 0"), bytes_per_bucket=20_000)
    n, wanted = brute.kneser_ney(train, [t for _, t in corpus])
    assert model.train_tokens == n
    got = {r.doc_id: r.lm for r in perplexity.score(documents, model).select("doc_id", "lm").collect()}
    for (i, _), (tokens, known, base, score) in zip(corpus, wanted):
        assert (got[i].n_tokens, got[i].n_known) == (tokens, known)
        assert got[i].base_score == pytest.approx(base, abs=1e-8) and got[i].score == pytest.approx(score, abs=1e-8)


def test_chances_add_up_to_one(spark):
    docs = spark.createDataFrame([(1, "a b a c"), (2, "b b c"), (3, None)], "doc_id long, text string")
    model = perplexity.fit(docs)
    # What follows "a": a known word, the end or an unknown word; the word's own end comes on top and is divided out.
    texts = spark.createDataFrame([(0, "a"), (1, "a a"), (2, "a b"), (3, "a c"), (4, "a zzz"), (5, "b"), (6, "c"), (7, "zzz")], "doc_id long, text string")
    s = {r.doc_id: r.lm.score for r in perplexity.score(texts, model).collect()}
    n, wanted = brute.kneser_ney(["a b a c", "b b c", None], ["a", "a a", "a b", "a c", "a zzz", "b", "c", "zzz"])
    assert [s[k] for k in range(8)] == pytest.approx([w[3] for w in wanted])
    assert n == 10 and model.vocabulary == 4


def test_model_without_tokens(spark, documents):
    model = perplexity.fit(documents.where(F.lit(False)))
    rows = perplexity.score(documents, model).select("lm").collect()
    assert all(r.lm.score == 0 and r.lm.base_score == 0 and r.lm.n_known == 0 for r in rows)
    assert perplexity.score(documents.where(F.lit(False)), model).count() == 0


def _texts(rng, n):
    good = lambda: " ".join(rng.choices(["the", "river", "slowly", "Peter", "reads,", "a", "book.", "and", "sings"], k=rng.choice([8, 40, 200])))
    bad = lambda: " ".join(rng.choices(["BUY!!", "NOW!!", "$$$", "CLICK!!", "%%%"], k=rng.choice([8, 40, 200])))
    return [(i, good() if i % 2 else bad(), i % 2) for i in range(n)]


def test_neighbours_vote(spark):
    rows = _texts(random.Random(1), 200)
    docs = spark.createDataFrame([(i, t, 3.0) for i, t, _ in rows], "doc_id long, text string, label double")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows if i < 120] + [(1, 0), (3, None), (None, 1), (5, 7)], "doc_id long, quality int")
    model = quality.fit(docs, labels, per_class=40)
    assert len(model.vectors) <= 80 and len({*model.labels.tolist()}) == 2
    got = {r.doc_id: r.score for r in quality.score(docs, model).select("doc_id", "score").collect()}
    assert all((got[i] >= 0.5) == (q == 1) for i, _, q in rows if i >= 120)
    assert all(0 <= s <= 1 for s in got.values())


def test_votes_of_awkward_texts(documents, spark):
    nothing = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.fit(documents, nothing)
    assert {r.score for r in quality.score(documents, model).select("score").collect()} == {0.5}
    one = documents.select("doc_id", F.lit(1).alias("quality"))
    scores = quality.score(documents, quality.fit(documents, one)).select("doc_id", "score").collect()
    assert len(scores) == documents.count() and all(r.score == pytest.approx(1) for r in scores)
    assert quality.score(documents.where(F.lit(False)), model).count() == 0


PERSONAL = [
    None, "", "a@b.cc, x.y+z@mail-1.example.com. b@c@d.ee a@b.c_d@e.f", "1.2.3.4 256.1.1.1 001.002.003.255 1.2.3.4.5 9.9.9",
    "4111 1111 1111 1111 and 4111-1111-1111-1112, 0000000000000", "+49 (30) 1234-5678 +1 23 ++123456789 (call) +1 ... 2",
    "é😀 a@b.de 日本 10.0.0.1", "9" * 4000 + " " + "a" * 4000 + " " + "1.1.1." * 800, "x@y.z " * 500, "12 " * 3000, "%" * 3000 + "@",
]


def test_base_spans(spark):
    rows = list(enumerate(PERSONAL)) + [(2, PERSONAL[2]), (None, PERSONAL[3]), (4, PERSONAL[5])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = pii.report(docs).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    for i, text in rows:
        spans = brute.personal(text)
        base = ",".join(f"{n}:{a}:{b}" for _, a, b, n in spans)
        counts = tuple(sum(s[3] == k for s in spans) for k in pii.KINDS)
        match = [r for r in by[i] if r.base_sha256 == brute.sha(base)]
        assert match, (i, text and text[:60])
        assert (match[0].n_email, match[0].n_ip, match[0].n_card, match[0].n_phone) == counts
        assert set(base.split(",")) <= {*match[0].spans.split(","), ""}
    assert pii.report(docs.where(F.lit(False))).count() == 0


def test_redaction(spark):
    docs = spark.createDataFrame([(1, "mail a@b.de now", "k"), (2, None, "k"), (3, "nothing", None)], "doc_id long, text string, match string")
    out = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert out == {1: "mail [email] now", 2: None, 3: "nothing"}
