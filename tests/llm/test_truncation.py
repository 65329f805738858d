import random
from types import SimpleNamespace

import numpy as np
import pytest

from millrace.llm import truncation as T

NAMES = [f"{a}{b}" for a in ("Bre", "Sko", "Tha", "Qui", "Nor") for b in ("vick", "land", "mire", "sten", "dor")]
NOUNS = "ledger harbour shard planner orchard meadow kettle bridge lantern festival cluster index".split()
VERBS = "watches merges counts binds stores carries".split()


def sentence(rng):
    return f"The {rng.choice(NOUNS)} {rng.choice(VERBS)} the {rng.choice(NOUNS)} near {rng.choice(NAMES)}{rng.choice(['.', '.', '!', '?'])}"


def corpus(seed=1, n=1500):
    """(id, text, source, lang, limit or break?) of two sources: one holds 300 characters, one breaks off now and then."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        text = " ".join(sentence(rng) for _ in range(rng.randrange(2, 12)))
        if rng.random() < 0.3:
            text += f"\n\nThanks,\n{rng.choice(NAMES)}"
        source, cut = rng.choice(["field", "wire"]), False
        if source == "field" and len(text) > 300:
            text, cut = text[:300], True
        elif source == "wire" and rng.random() < 0.1:
            at = rng.randrange(20, len(text) - 5)
            text, cut = text[:at], True
        out.append((i, text + rng.choice(["", "", " ", "\n"]), source, rng.choice(["en", "EN", None]), cut))
    return out


def run(spark, data, schema="doc_id long, text string, source string, lang string, same boolean"):
    return {r["id"]: r["truncated"] for r in T.truncated_texts(spark.createDataFrame(data, schema).repartition(4)).collect()}


def test_finds_cuts_of_a_synthetic_corpus(spark):
    data = corpus()
    got = run(spark, data)
    true = {r[0] for r in data if r[4]}
    found = {i for i, t in got.items() if t}
    assert len(got) == len(data)
    assert len(true & found) >= 0.93 * len(true) and len(true & found) >= 0.95 * len(found)
    at_limit = {r[0] for r in data if r[4] and r[2] == "field"}
    assert len(at_limit & found) >= 0.99 * len(at_limit)


def test_null_blank_long_and_copies(spark):
    data = corpus(2, 600)
    cut = next(r for r in data if r[4] and r[2] == "field")
    whole = " ".join(sentence(random.Random(9)) for _ in range(3))
    data += [(9001, None, "field", "en", False), (9002, "", None, None, False), (9003, " \n\t", "wire", "en", False), (9004, cut[1], "wire", "xx", True), (9005, whole, None, None, False), (9006, "x" * 300_000, "wire", "en", False)]
    got = run(spark, data)
    assert not {9001, 9002, 9003} & set(got) and {9004, 9005, 9006} <= set(got)
    assert got[cut[0]] and got[9004] and not got[9005]


def test_empty(spark):
    schema = "doc_id long, text string, source string, lang string"
    empty = spark.createDataFrame([], schema)
    assert T.truncated_texts(empty).count() == 0
    assert T.truncated_texts(spark.createDataFrame([(1, None, None, None)], schema)).count() == 0
    one = spark.createDataFrame([(1, "One text.", "s", "en")], schema)
    assert T.truncated_texts(one).count() == 1
    rates = T.truncation_rates(empty.unionByName(one), T.truncated_texts(one)).collect()
    assert [(r["source"], r["texts"]) for r in rates] == [("s", 1)]


def test_contexts_do_not_depend_on_neighbours():
    texts = ["Alpha beta.", "x", "One two\nthree", "日本語 text…", "A" * 50]
    codes = np.arange(5)
    joint = T.Positions(texts, codes)
    together = np.stack(list(joint.keys(joint.last)), 1)
    for i, t in enumerate(texts):
        p = T.Positions([t], codes[i : i + 1])
        assert (np.stack(list(p.keys(p.last)), 1)[0] == together[i]).all()


def test_long_texts_in_pieces(monkeypatch):
    import pyarrow as pa

    rng = random.Random(4)
    texts = [" ".join(sentence(rng) for _ in range(40)) for _ in range(3)]
    p = T.Positions(texts, np.zeros(3, np.int64))
    model = np.unique(np.concatenate([k for k in p.keys(p.last)]))
    batch = pa.RecordBatch.from_arrays([pa.array([0, 0, 0]), pa.array(texts)], names=["code", "text"])
    total = lambda: dict(zip(*(c.to_pylist() for c in next(iter(T._inner_counter(SimpleNamespace(value=model))(iter([batch])))).columns), strict=True))
    whole = total()
    monkeypatch.setattr(T, "PIECE", 250)
    monkeypatch.setattr(T, "BLOCK_CHARS", 100)
    pieces = total()
    assert whole.keys() == pieces.keys()
    assert all(abs(whole[k] - pieces[k]) <= 60 for k in whole)


@pytest.mark.parametrize(("text", "end", "bare", "run"), [("Fin.  \n", "Fin.", "Fin", "."), ("half wo\ufffd", "half wo", "half wo", ""), ("half wo...", "half wo...", "half wo", "..."), ("half wo \u2026 \n", "half wo \u2026", "half wo", "\u2026"), ("d\u00e9j\u00e0 vu".encode().decode("latin-1"), "d\u00e9j\u00e0 vu", "d\u00e9j\u00e0 vu", ""), ("\u00e9tait pr\u00ea".encode().decode("latin-1")[1:-1], "tait pr", "tait pr", ""), ("l&#39;\u00e9t\u00e9", "l'\u00e9t\u00e9", "l'\u00e9t\u00e9", ""), ("the le\u2705dger", "the ledger", "the ledger", ""), ("fine \U0001f44d", "fine \U0001f44d", "fine", "\U0001f44d"), ("?!", "?!", "", ""), ("cafe\u0301", "cafe\u0301", "cafe\u0301", "")])
def test_ending(text, end, bare, run):
    got = T.ending(text)
    assert (got[0], got[2]) == (end, run) and got[1] == bare.replace("\ufffd", "e")


def test_small_sources_keep_their_contexts_and_a_model_may_be_a_table(spark, monkeypatch):
    docs = spark.createDataFrame([r[:4] for r in corpus(3, 400)], "doc_id long, text string, source string, lang string").repartition(4)
    scores = lambda: {r["id"]: (r["whole"], r["truncated"]) for r in T.truncated_texts(docs).collect()}
    whole = scores()
    monkeypatch.setattr(T, "CAPACITY", 8)
    monkeypatch.setattr(T, "HOT", 16, raising=False)
    table = scores()
    assert table.keys() == whole.keys()
    assert all(t == pytest.approx(whole[i][0], abs=1e-6) and cut == whole[i][1] for i, (t, cut) in table.items())


def test_any_padding_behind_the_end(spark):
    data, end = [r[:4] for r in corpus(2, 300)], "The ledger watches the harbour near"
    data += [(9100 + i, end + pad, "wire", "en") for i, pad in enumerate(["", " " * 5000, "\u00a0" * 900 + "\ufffd" * 900 + "\n"])]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string, lang string").repartition(4)
    whole = {r["id"]: r["whole"] for r in T.truncated_texts(docs).where("id >= 9100").collect()}
    assert whole[9101] == pytest.approx(whole[9100]) and whole[9102] == pytest.approx(whole[9100])


def test_texts_with_one_closing_formula_all_count(spark):
    rng = random.Random(5)
    formula = "\nThis note was carried from the harbour office of the northern meadow and counted by the keeper of the"
    data = [r[:4] for r in corpus(6, 400)] + [(9200 + i, f"{sentence(rng)} {i} {sentence(rng)}{formula}", "notes", "en") for i in range(60)]
    assert not any(cut for i, cut in run(spark, [(*r, False) for r in data]).items() if i >= 9200)


def test_lookup_and_counts_equal_plain_ones():
    rng = np.random.default_rng(3)
    keys = np.unique(np.concatenate([rng.integers(0, 1 << 63, 5000, np.uint64) * np.uint64(2), np.arange(300, dtype=np.uint64) + np.uint64(1 << 50)]))
    asked = np.concatenate([keys, keys + np.uint64(1), np.zeros(3, np.uint64)])
    at, hit = T.Lookup(keys).find(asked)
    assert (hit == np.isin(asked, keys)).all() and (keys[at[hit]] == asked[hit]).all()
    assert not T.Lookup(keys[:0]).find(asked)[1].any()
    texts = [sentence(random.Random(i)) + "\n" + "Ab, c! " * i for i in range(40)]
    p = T.Positions(texts, np.arange(40) % 3)
    inner = ~p.blank
    inner[p.last] = False
    every = list(p.keys(np.flatnonzero(inner)))
    model = np.unique(np.concatenate([np.stack(list(p.keys(p.last)), 1).ravel(), *every]))[::1]
    lookup = T.Lookup(model)
    total = np.zeros(len(model))
    for at, n in p.known(inner, lookup.find):
        total += np.bincount(at, n, len(model))
    plain = np.bincount(np.searchsorted(model, np.concatenate(every)), minlength=len(model))
    assert (total == plain).all()


def test_many_small_sources_and_a_wide_field(spark):
    """Sources of two texts each, beside one of two limits; the rates come by a join either way."""
    rng = random.Random(11)
    data = []
    for i in range(1200):
        text = " ".join(sentence(rng) for _ in range(rng.randrange(4, 14)))
        cut, source = False, f"s{i // 2}"
        if i < 700:
            source, at = "field", 250 if i < 350 else 420
            text, cut = text[:at], len(text) > at
        data.append((i, text, source, "en", cut))
    got = run(spark, data)
    true = {r[0] for r in data if r[4]}
    found = {i for i, t in got.items() if t}
    assert len(true & found) >= 0.97 * len(true) and len(true & found) >= 0.97 * len(found)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert run(spark, data) == got
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_what_is_put_behind_a_cut_is_seen_at_the_limit(spark):
    rng = random.Random(12)
    data = []
    for i in range(800):
        text = " ".join(sentence(rng) for _ in range(rng.randrange(2, 10)))
        cut = i % 2 == 0 and len(text) > 300
        data.append((i, f"{text[:297]}>>>" if cut else text, "field" if i % 2 == 0 else "wire", "en", cut))
    got = run(spark, data)
    assert all(got[r[0]] for r in data if r[4])


def test_a_text_of_no_source_goes_by_all_sources(spark):
    data = corpus(13, 900)
    at_limit = [r[1] for r in data if r[4] and r[2] == "field"][:5]
    data += [(9300 + i, t[:299] + "e", None, "en", True) for i, t in enumerate(at_limit)]
    got = run(spark, data)
    assert all(got[9300 + i] for i in range(5))
