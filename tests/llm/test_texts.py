import base64
import random
import unicodedata

import numpy as np
import pytest
import tiktoken

from gaugeflow.llm import bpe, labelled, packing, quality, rules
from gaugeflow.llm.textstats import text_statistics

from .odd_texts import ODD

DOCS = "doc_id long, text string"
WORDS = [("en", w, i) for i, w in enumerate("the of and to a in is it that was for on with not you have this we my at so if has there by an do about then when no after".split())]
WORDS += [("de", w, 0) for w in "der die das und ist nicht ich ein zu in mit auf es dass war bei mir noch aber wenn hat für den nach wieder".split()]
WORDS += [("fr", w, 0) for w in "le la les de est un une que ne pas je il pour dans avec plus ce qui mais tout mon si en du".split()]
WORDS += [("es", w, 0) for w in "el la los de y que en un una no es se por con mi para lo ya muy pero al ha cuando".split()]
WORDS += [("ru", w, 0) for w in "и в не на я что с у меня как по это но был когда так мой всё уже".split()]
WORDS += [("ja", w, i) for i, w in enumerate("です ます ました こと この その".split())]


@pytest.fixture(scope="module")
def reference():
    with open(bpe.rank_file(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    r = random.Random(4)
    odd = ["", None, " ", "\n\n  \t x", "<|endoftext|>", "don't we'LL", "a" * 5000, "ééé 日本語のテキスト", "​zero width", "👍👍🏽 ok", "0123456789" * 30, "\r\n\r\n", "�\u0000"]
    return odd + ["".join(chr(r.choice([r.randint(32, 126), r.randint(160, 1200), r.randint(0x3040, 0x30FF), 10, 32])) for _ in range(r.randint(1, 300))) for _ in range(200)] + [t for _, t, _ in labelled.labelled_documents(200, 1)]


def test_encoding_equals_reference(spark, reference):
    data = list(enumerate(texts()))
    df = spark.createDataFrame(data, DOCS).selectExpr("*", "1 AS key", "2 AS ids")
    got = {r["doc_id"]: r["ids"] for r in bpe.encode_column(df).collect()}
    assert len(got) == len(data)
    for i, t in data:
        assert got[i] == (reference.encode_ordinary(t) if t else [])
    counts = {r["doc_id"]: r["n_tokens"] for r in bpe.count_tokens(df).collect()}
    assert counts == {i: len(x) for i, x in got.items()}
    assert bpe.encode_column(df.limit(0)).count() == 0


def test_long_text_and_decoding_round_trip(reference):
    enc = bpe.encoder(bpe.rank_file())
    text = " ".join(t for t in texts() if t) * 20
    flat, offsets = enc.encode([text, None, text])
    half = offsets[1]
    assert reference.decode(flat[:half].tolist()) == text and np.array_equal(flat[:half], flat[offsets[2] :])


def test_perfect_hash_is_minimal():
    keys = np.random.default_rng(1).integers(0, 2**63, 20_000).astype(np.uint64)
    h = bpe.PerfectHash(np.unique(keys))
    assert sorted(h.index(np.unique(keys)).tolist()) == list(range(len(np.unique(keys))))


def test_best_fit_respects_every_capacity():
    r = np.random.default_rng(2)
    sizes = r.integers(1, 1025, 3000)
    where, at = packing.best_fit(sizes)
    for b in range(where.max() + 1):
        mine = np.flatnonzero(where == b)
        assert sizes[mine].sum() <= 1024 and len(mine) <= 64 and (((sizes[mine] + 127) // 128) ** 2).sum() <= 80
        o = mine[np.argsort(at[mine])]
        assert (at[o] == np.concatenate([[0], np.cumsum(sizes[o])[:-1]])).all()
    assert (where.max() + 1) * 1024 <= 1.01 * sizes.sum() + 1024


def test_each_capacity_binds_on_its_own():
    bins = lambda sizes, **kw: int(packing.best_fit(np.array(sizes), **kw)[0].max()) + 1
    assert bins([600, 500]) == 2 and bins([600, 500], capacity=1100) == 1
    many = [3] * 65
    assert bins(many) == 2 and bins(many, max_docs=65) == 1
    tiled = [129] * 7 + [2] * 54
    assert sum(tiled) <= 1024 and len(tiled) <= 64
    assert bins(tiled) == 2 and bins(tiled, max_tiles=90) == 1
    with pytest.raises(ValueError):
        packing.best_fit(np.array([1024]), max_tiles=63)


def test_packing_keeps_everything(spark):
    r = random.Random(3)
    data = [(i, r.choice([0, None, r.randint(1, 300), r.randint(1, 1024), r.randint(1025, 9000)])) for i in range(600)] + [(5, 100), (5, 100), (None, 7)]
    out = packing.pack(spark.createDataFrame(data, "doc_id long, n_tokens long"), group_pieces=200).toPandas()
    placed = out[out.container_id.notna()]
    assert placed.n_tokens.sum() == sum(n or 0 for _, n in data)
    assert placed.groupby("container_id").n_tokens.sum().max() <= 1024
    assert len(out[out.container_id.isna()]) == sum(1 for _, n in data if not n)
    cut = placed[placed.piece > 0].doc_id.unique()
    assert all(n > 1024 for i, n in data if i in set(cut) and n and i != 5)
    one = placed[placed.doc_id == max((n or 0, i) for i, n in data if i is not None and i != 5)[1]].sort_values("piece")
    assert (one.token_start == np.arange(len(one)) * 1024).all()
    again = packing.pack(spark.createDataFrame(data, "doc_id long, n_tokens long").repartition(3), group_pieces=200).toPandas()
    key = ["container_id", "doc_id", "piece", "at"]
    assert sorted(map(str, out[key].values.tolist())) == sorted(map(str, again[key].values.tolist()))
    assert packing.pack(spark.createDataFrame([], "doc_id long, n_tokens long")).count() == 0


def test_rule_list_learns_and_exports(spark):
    r = np.random.default_rng(5)
    x = r.random((900, 3))
    y = np.where(x[:, 0] > 0.7, "a", np.where((x[:, 1] < 0.3) & (x[:, 2] > 0.4), "b", "rest")).astype(object)
    learned = rules.induce(x, y, ("a", "b"))
    assert (rules.apply(learned, x, "rest") == y).mean() > 0.97
    df = spark.createDataFrame([(float(a), float(b), float(c)) for a, b, c in x], "f0 double, f1 double, f2 double").selectExpr("*", rules.to_case(learned, ("f0", "f1", "f2"), "rest") + " AS kind")
    assert [k["kind"] for k in df.collect()] == rules.apply(learned, x, "rest").tolist()
    assert rules.to_case([], ("f0",), "rest") == "'rest'"


def common(spark):
    return spark.createDataFrame(WORDS, "lang string, word string, word_rank int")


def test_statistics(spark):
    data = [(1, "The pump is on. It is\nthe end!"), (2, None), (3, ""), (4, " \n\t \n"), (5, "- a1\n- b2"), (6, "pump,1,2\nhose,3,4"), (7, "> The pump\n> is on.\n-- \nme")]
    got = {r["doc_id"]: r for r in text_statistics(spark.createDataFrame(data, DOCS), common(spark)).collect()}
    assert (got[1]["n_words"], got[1]["n_lines"], got[1]["ends_share"], got[1]["common_share"]) == (8, 2, 0.5, pytest.approx(6 / 8))
    assert all(got[i]["n_words"] == 0 and got[i]["n_lines"] == 0 for i in (2, 3, 4))
    assert got[5]["bullet_share"] == 1.0 and got[6]["cell_share"] == 1.0
    assert got[7]["n_words"] == 4
    same = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b")], DOCS).selectExpr("*", "1 AS n_words", "2 AS _text")
    assert text_statistics(same, common(spark)).count() == 3 and text_statistics(same.limit(0), common(spark).limit(0)).count() == 0


def test_signature_goes_only_at_the_end_and_whole_texts_count(spark):
    data = [(1, "The pump is on.\n--\n" + "it is the end of the line " * 40 + "\nand that was it"), (2, "The pump is on.\n--\n" + "me " * 100), (3, "a " * 200_000), (4, "x" * 300_000)]
    got = {r["doc_id"]: r for r in text_statistics(spark.createDataFrame(data, DOCS), common(spark)).collect()}
    assert got[1]["n_words"] == 4 + 280 + 4 and got[2]["n_words"] == 4
    assert (got[3]["n_words"], got[4]["longest_run"]) == (200_000, 300_000)


def brute(text):
    """The plainest statistics again, character by character."""
    lines = [x for x in text.split("\n") if x.strip()]
    words, current = [], ""
    for ch in text + " ":
        if unicodedata.category(ch)[0] in "LMN":
            current += ch.lower()
        elif current:
            words.append(current)
            current = ""
    solid = [ch for ch in text if not ch.isspace()]
    ends = sum(x.rstrip().rstrip("\"')]")[-1:] in ".!?" for x in lines)
    known = {w for _, w, _ in WORDS}
    share = lambda a, b: a / b if b else 0.0
    return {
        "n_words": len(words),
        "n_lines": len(lines),
        "common_share": share(sum(w in known for w in words), len(words)),
        "letter_ratio": share(sum(ch.isalpha() for ch in solid), len(solid)),
        "digit_ratio": share(sum(ch.isdigit() for ch in solid), len(solid)),
        "distinct_share": share(len(set(words)), len(words)),
        "ends_share": share(ends, len(lines)),
        "longest_run": max([len(x) for x in text.split()], default=0),
    }


def test_statistics_against_brute_force(spark):
    r = random.Random(9)
    pool = ["the", "Pump", "und", "é", "x1", "42", "off", "well-known", "end.", "(so)", "No!", "A,B"]
    data = [(i, "".join(r.choice(pool) + r.choice([" ", " ", "  ", "\n", "\t"]) for _ in range(r.randint(0, 60)))) for i in range(120)]
    for got in text_statistics(spark.createDataFrame(data, DOCS), common(spark)).collect():
        want = brute(data[got["doc_id"]][1])
        assert {k: got[k] for k in want} == pytest.approx(want), data[got["doc_id"]][1]


def test_notations_that_the_sample_does_not_compose(spark):
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(ODD)], DOCS)
    got = {r["doc_id"]: r["kind"] for r in quality.document_kinds(df, common(spark)).collect()}
    assert len(ODD) >= 60 and np.mean([got[i] == k for i, (k, _) in enumerate(ODD)]) >= 0.8


def test_held_out_kinds(spark):
    held = labelled.labelled_documents(400, 77)
    df = spark.createDataFrame([(i, t) for i, t, _ in held] + [(-1, None), (-2, ""), (-3, "[deleted]"), (-4, "   ")], DOCS)
    got = {r["doc_id"]: r["kind"] for r in quality.document_kinds(df, common(spark), 1_500).select("doc_id", "kind").collect()}
    assert np.mean([got[i] == k for i, _, k in held]) > 0.93
    assert {got[i] for i in (-1, -2, -3, -4)} == {"prose"}
    assert quality.no_prose(quality.document_kinds(df.limit(0), common(spark), 1_500)).count() == 0
