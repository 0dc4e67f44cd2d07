"""Language, toxicity and quality."""

import collections
import math
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest

from lectern.llm import langid, quality, toxicity
from tests.llm.helpers import ENGLISH, GERMAN, prose


def test_languages_are_told_apart(spark):
    rows = [(k, prose(k, 60, ENGLISH), "en") for k in range(20)] + [(100 + k, prose(k, 60, GERMAN), "de") for k in range(20)]
    profiles = langid.fit_profiles(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3))
    tests = [(k, prose(900 + k, 25, v), x) for k, (v, x) in enumerate([(ENGLISH, "en"), (GERMAN, "de")] * 10)]
    odd = [(50, None, None), (51, "", None), (52, "123 456 !!", None), (53, prose(1, 40_000, GERMAN), "de"), (50, None, None)]
    found = langid.identify(spark.createDataFrame(tests + odd, "doc_id long, text string, lang_pred string"), profiles).collect()
    assert len(found) == len(tests) + len(odd)
    by = {r.doc_id: r for r in found}
    assert all(by[i].lang_pred == x for i, _, x in tests)
    assert [by[i].lang_pred for i in (50, 51, 52, 53)] == ["und", "und", "und", "de"]
    assert by[50].score == 0.0 and all(0 <= r.score <= 1 for r in found)


def test_language_counts_match_brute_force():
    texts = ["Ab, ab\nb", "", "äA"]
    owner, gram, n = langid.count_grams(texts, __import__("numpy").arange(3))
    got = {}
    for o, g, c in zip(owner, gram, n, strict=True):
        s = "".join(chr(int(g) >> k & 0x1FFFFF) for k in (42, 21, 0) if int(g) >> k & 0x1FFFFF)
        got[(int(o), s)] = int(c)
    expected = collections.Counter()
    for i, words in enumerate([["ab", "ab", "b"], [], ["äa"]]):
        for w in words:
            p = f"\x01{w}\x01"
            expected.update((i, p[a : a + k]) for k in (1, 2, 3) for a in range(len(p) - k + 1) if p[a : a + k] != "\x01")
    assert got == dict(expected)


def _slow_grams(texts):
    """n-gram -> count, as numbers of three code points, over padded runs of letters."""
    found = collections.Counter()
    for text in texts:
        for word in re.findall(r"[^\W\d_]+", (text or "").lower()):
            p = f"\x01{word}\x01"
            found.update(p[a : a + k] for k in (1, 2, 3) for a in range(len(p) - k + 1) if p[a : a + k] != "\x01")
    number = lambda g: sum(ord(c) << 21 * (len(g) - 1 - k) for k, c in enumerate(g))
    return [number(g) for g, n in sorted(found.items(), key=lambda x: (-x[1], number(x[0])))]


@pytest.mark.parametrize(("size", "head"), [(30, 10), (1200, 400)])
def test_out_of_place_distance_against_brute_force(spark, monkeypatch, size, head):
    """Profiles cut short, equal counts, equally near languages, texts without a known n-gram."""
    r = random.Random(8)
    vocabulary = {"en": ENGLISH, "de": GERMAN, "xx": ["ab", "ba", "abba"], "xy": ["ab", "ba", "abba"]}
    rows = [(k, prose(k, r.randrange(3, 40), v), x) for k, (x, v) in enumerate([*vocabulary.items()] * 6)]
    rows += [(900 + k, t, x) for k, (_, t, x) in enumerate([q for q in rows if q[2] == "xx"])] + [(990, "lonely", None), (991, None, "en")]
    rows = [q if q[2] != "xy" else (q[0], rows[q[0] - 1][1], "xy") for q in rows]  # xy is taught what xx is
    profiles = langid.fit_profiles(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3), size)
    expected = {x: _slow_grams(t for _, t, y in rows if y == x)[:size] for x in vocabulary}
    assert {k: v.tolist() for k, v in profiles.items() if k != "xx"} == {k: v for k, v in expected.items() if k != "xx"}
    longest = max(len(v) for v in profiles.values())
    texts = [prose(500 + k, r.randrange(1, 60), r.choice(list(vocabulary.values()))) for k in range(60)] + ["", None, "123", "ωψ", "abba", "q" * 5000]
    classify = langid.classifier(profiles, head)
    label, score = (x.to_pylist() for x in classify(pa.array(texts, pa.string())))
    for text, got, s in zip(texts, label, score, strict=True):
        grams = _slow_grams([text])[:head]
        place = {k: {g: i for i, g in enumerate(v.tolist())} for k, v in profiles.items()}
        distance = {k: sum(min(abs(place[k][g] - i), longest) if g in place[k] else longest for i, g in enumerate(grams)) for k in profiles}
        best = min(sorted(profiles), key=distance.get)
        assert (got, s) == (("und", 0.0) if not grams else (best, pytest.approx(1 - distance[best] / (len(grams) * longest))))


def test_languages_of_null_ids_repeated_rows_and_clashing_columns(spark):
    rows = [(None, prose(1, 40, GERMAN), "de", "x"), (None, prose(1, 40, GERMAN), "de", "x"), (2, prose(2, 40), "en", "y"), (2, prose(2, 40), "en", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, Score string")
    found = langid.identify(df, langid.fit_profiles(df)).collect()
    assert [(r.doc_id, r.lang_pred) for r in sorted(found, key=lambda r: r.doc_id or 0)] == [(None, "de")] * 2 + [(2, "en")] * 2 and "Score" not in found[0].asDict()


def test_no_training_data_means_undetermined(spark):
    docs = spark.createDataFrame([(1, "some words", None)], "doc_id long, text string, lang string")
    assert langid.fit_profiles(docs) == {}
    assert langid.identify(docs, {}).first().lang_pred == "und"
    assert langid.identify(docs.limit(0), {}).count() == 0


@pytest.mark.parametrize(
    ("text", "hits"),
    [("you bilge", 1), ("you b1lge!", 1), ("уou rаscаl", 1), ("bìlgë", 1), ("bil\u200bge", 1), ("ra$cal", 1), ("bilges", 0), ("bilge$$$", 1), ("the bilge pump", 0), ("bilge", 1), ("bilge pump bilge", 1), ("", 0), ("ｂｉｌｇｅ", 1), ("bilge1", 1), ("bilg3", 1), ("bilg3!", 1), ("bilg3!!", 1), ("bilge!", 1), ("ra5ca|", 0), ("ra5ca1", 0), ("bilg3 pump", 0), ("bilge pump5", 0), ("bilge pum9", 1), ("3bilg3", 0)],
)
def test_folding_boundaries_and_exceptions(text, hits):
    matcher = toxicity.Matcher(toxicity.Lexicon({"bilge": 1.0, "rascal": 1.0}, {}, ("bilge pump",)))
    assert toxicity.density(matcher, text)[1] == hits


def _slow_density(lexicon, text):
    """The same by looking at every term at every place."""
    text = "".join(toxicity._table().get(ord(c), c) or "" for c in text.lower())
    symbols = "0134578@$!|"
    letters = "oieastbasil"
    outs = ["", ""]
    for k, c in enumerate(text):
        rest, before = text[k:].lstrip(symbols), text[:k].rstrip(symbols)
        touches = rest != "" and rest[0].isalpha(), before != "" and before[-1].isalpha() and text[k : len(text) - len(rest)].strip("!|") != ""
        for i, read in enumerate((touches[0], any(touches))):
            outs[i] += letters[symbols.index(c)] if c in symbols and read else c
    hits, spared = {}, []
    for out in outs:
        letter = lambda k: 0 <= k < len(out) and out[k].isalpha()  # noqa: B023, E731
        starts = [k for k in range(len(out)) if not letter(k - 1)]
        spared += [(k, k + len(x)) for x in lexicon.exceptions for k in starts if out.startswith(x, k) and not letter(k + len(x))]
        for k in starts:
            for stem, terms in ((True, lexicon.stems), (False, lexicon.words)):
                for x, w in terms.items():
                    if out.startswith(x, k) and (stem or not letter(k + len(x))):
                        hits[k] = max(hits.get(k, (0.0, 0)), (w, k + len(x)))
    total = sum(w for k, (w, end) in hits.items() if not any(a <= k and end <= b for a, b in spared))
    return total / max(20, len(text.split())) ** 0.5


def test_density_against_every_term_at_every_place():
    lexicon = toxicity.Lexicon({"bilge": 1.0, "rascal": 2.5, "gash": 0.5}, {"grum": 1.5, "bil": 0.25}, ("bilge pump", "old rascal", "rascal bilge pump"))
    matcher = toxicity.Matcher(lexicon)
    r = random.Random(3)
    parts = ["bilge", "b1lge", "pump", "old", "ra$cal", "RASCAL", "grumfe", "billow", "gash", "g4sh", "ga5hes", "11", "$$", "x", "é", "!!bilge", "bilge!!", "rаscаl", "\u200b", "bilg3", "bilg3!", "ga5h", "ga5", "pump5", "0ld", "grum7!!", "7", "ra5ca1"]
    for _ in range(600):
        text = "".join(r.choice(parts) + r.choice([" ", " ", "\n", "", "-", "  "]) for _ in range(r.randrange(12)))
        assert toxicity.density(matcher, text)[0] == pytest.approx(_slow_density(lexicon, text)), text


def test_long_runs_take_time_in_proportion():
    began = time.process_time()
    assert toxicity.fold("1" * 1_000_000) == "1" * 1_000_000
    assert toxicity.fold("1" * 1_000_000 + "x") == "i" * 1_000_000 + "x"
    matcher = toxicity.Matcher(toxicity.Lexicon({"bilge": 1.0}, {}, ("bilge pump",)))
    assert toxicity.density(matcher, "bilge pump " * 50_000 + "bilge")[1] == 1
    assert toxicity.density(matcher, "x" * 3_000_000)[1] == 0
    assert toxicity._phrases(matcher, "y" * 1_000_000 + " bilge " + "z" * 1_000_000) == {"y" * 1_000_000 + " bilge", "bilge " + "z" * 1_000_000}
    assert time.process_time() - began < 10


def test_toxicity_learns_words_and_stems(spark):
    rows, labels = [], []
    for k in range(400):
        bad = k % 4 == 0
        extra = f" grumf{'aeiou'[k % 5]}{k % 7} snarkel" if bad else ""
        rows.append((k, prose(k, 50) + extra))
        labels.append((k, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    lexicon = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert "snarkel" in lexicon.words and "grumf" in lexicon.stems and not set(ENGLISH) & set(lexicon.words)
    assert list(lexicon.scores) == sorted(lexicon.scores)
    tests = [(1, prose(1000, 60) + " grumfe9 snarkel"), (2, prose(1001, 60)), (3, None), (4, ""), (5, prose(7, 50_000)), (1, prose(1000, 60) + " grumfe9 snarkel")]
    found = toxicity.score(spark.createDataFrame(tests, "doc_id long, text string"), lexicon).collect()
    by = {r.doc_id: r.score for r in found}
    assert len(found) == 6 and by[1] > 0.5 and max(by[2], by[3], by[4], by[5]) < 0.3


def test_toxicity_finds_harmless_phrases(spark):
    rows = [(k, prose(k, 50) + (" vile bilge" if k % 4 == 0 else " bilge pump" if k % 40 == 1 else "")) for k in range(600)]
    labels = [(k, int(k % 4 == 0)) for k in range(600)] + [(None, 1), (3, None)]
    lexicon = toxicity.fit(spark.createDataFrame(rows + [(None, "bilge")], "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert "bilge pump" in lexicon.exceptions and not any("vile" in x for x in lexicon.exceptions)
    matcher = toxicity.Matcher(lexicon)
    assert toxicity.density(matcher, "a bilge pump")[1] == 0 and toxicity.density(matcher, "a bilge")[1] == 1


def test_a_lexicon_beyond_its_bound_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "MOST_TERMS", 1)
    docs = spark.createDataFrame([(k, "bilge rascal" if k < 5 else "fine words") for k in range(50)], "doc_id long, text string")
    with pytest.raises(ValueError, match="MOST_TERMS"):
        toxicity.fit(docs, spark.createDataFrame([(k, int(k < 5)) for k in range(50)], "doc_id long, toxic int"))


def test_toxicity_without_toxic_labels_is_flat(spark):
    docs = spark.createDataFrame([(1, "some words", 3.0), (2, None, 1.0), (None, "", 2.0)], "doc_id long, text string, SCORE double")
    for labels in ([], [(1, 0)], [(1, None)]):
        lexicon = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert [r.score for r in toxicity.score(docs, lexicon).collect()] == [0.0] * 3
    assert toxicity.score(docs.limit(0), lexicon).count() == 0


def test_quality_separates_junk_and_estimates_the_prior(spark):
    good = [(k, ". ".join(prose(10 * k + j, 12) for j in range(6)) + ".") for k in range(300)]
    junk = [(1000 + k, " ".join(w.upper() + "!!" for w in prose(k, 60).split())) for k in range(60)] + [(2000 + k, " | ".join(prose(k, 60).split())) for k in range(60)]
    docs = spark.createDataFrame(good + junk, "doc_id long, text string").repartition(3)
    model = quality.fit(docs.where("doc_id < 150"), docs)
    assert 0.5 < model.prior < 0.9
    more = [(9000, None), (9001, ""), (9002, prose(3, 40_000))]
    by = {r.doc_id: r.score for r in quality.score(docs.union(spark.createDataFrame(more, "doc_id long, text string")), model).collect()}
    right = sum(by[i] >= 0.3 for i, _ in good) + sum(by[i] < 0.3 for i, _ in junk)
    assert right >= 0.97 * (len(good) + len(junk)) and all(0 <= s <= 1 for s in by.values()) and len(by) == 423


def test_quality_fit_sees_all_unlabelled_texts(spark):
    """Beyond the rows that the fit starts on, means, deviations, prior and weights still come from all of them."""
    good = [(k, ". ".join(prose(10 * k + j, 12) for j in range(6)) + ".") for k in range(300)]
    junk = [(1000 + k, " | ".join(prose(k, 60).split())) for k in range(100)]
    docs = spark.createDataFrame(good + junk, "doc_id long, text string").repartition(3)
    whole, part = quality.fit(docs.where("doc_id < 150"), docs), quality.fit(docs.where("doc_id < 150"), docs, 40)
    x = quality.features(pa.array([t for _, t in good + junk])).astype(float)
    for model in (whole, part):
        assert np.allclose(model.mean, x.mean(0), atol=1e-5) and np.allclose(model.scale, x.std(0) + 1e-3, atol=1e-4)
    assert 0.5 < part.prior < 0.9
    by = {r.doc_id: r.score for r in quality.score(docs, part).collect()}
    assert sum(by[i] >= 0.3 for i, _ in good) + sum(by[i] < 0.3 for i, _ in junk) >= 0.97 * len(by)


def test_quality_is_the_same_for_any_split_and_above_and_below_the_sample(spark):
    good = [(k, ". ".join(prose(10 * k + j, 12) for j in range(6)) + ".") for k in range(300)]
    junk = [(1000 + k, " | ".join(prose(k, 60).split())) for k in range(100)]
    rows = good + junk + good[:7]
    for most in (12_000, 120):
        found = []
        for n in (2, 12):
            docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(n)
            model = quality.fit(docs.where("doc_id < 150"), docs, most)
            found.append(sorted((r.doc_id, r.score) for r in quality.score(docs, model).collect()))
        assert np.allclose([s for _, s in found[0]], [s for _, s in found[1]], atol=1e-6)


def _slow_features(text):
    """The vector of a text, character by character and word by word."""
    data = (text or "").encode()
    sets = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\x0b\x0c", b"\n", b".,;:", b"!?", b"'\"()-", b"#$%&*", b"|<>{}[]\\/=_", b"@^~`+"]
    kind = [next((k for k, s in enumerate(sets) if c in s), 11) for c in data]
    words = re.findall(rb"[^\x20\x09-\x0D]+", data)
    n, size, m = quality.CLASSES, max(1, len(data)), max(1, len(words))
    singles, pairs = collections.Counter(kind), collections.Counter(zip(kind, kind[1:]))
    ends = collections.Counter()
    for w in words:
        k = [next((i for i, s in enumerate(sets) if c in s), 11) for c in w]
        ends[((k[-1] * n + k[max(len(k) - 2, 0)]) * 0x9E3779B1 >> 7) % quality.ENDINGS] += 1
    lengths = [len(w) for w in words]
    mean = sum(lengths) / m
    runs = [tuple(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [tuple(words)] if words else []
    more = [math.log1p(len(data)), math.log1p(len(words)), mean, math.sqrt(max(0.0, sum(x * x for x in lengths) / m - mean**2)), len(set(words)) / m, sum(a == b for a, b in zip(words, words[1:])) / m]
    more += [len(set(runs)) / max(1, len(runs)), len(words) / (data.count(b"\n") + 1), sum(x >= 20 for x in lengths) / m, sum(x == 1 for x in lengths) / m, len(set(words)) / math.sqrt(m), float(not data)]
    return [singles[k] / size for k in range(n)] + [math.sqrt(pairs[a, b] / size) for a in range(n) for b in range(n)] + [math.sqrt(ends[k] / m) for k in range(quality.ENDINGS)] + more


def test_quality_features_against_a_slow_version():
    texts = ["", None, "a", "Ab, cd!! 12\n\nx  y", prose(1, 300), "é ß 😀 word word word", " | ".join(prose(2, 60).split()), "x" * 5000, "a\nb\n" * 400, "\t \x0b", 'He said: "no" (yes) - #1 $2 {x} @y ~z']
    got = quality.features(pa.array(texts, pa.string()))
    for text, row in zip(texts, got, strict=True):
        assert np.allclose(row, _slow_features(text), atol=1e-4), text


def test_names_with_dots_pass_through(spark):
    rows = [(k, prose(k, 30), k, "x") for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `a.b` int, `Score.x` string")
    model = quality.fit(docs.where("doc_id < 20"), docs)
    lexicon = toxicity.fit(docs, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int"))
    profiles = langid.fit_profiles(docs.selectExpr("doc_id", "text", "'en' as lang"))
    for found in (quality.score(docs, model), toxicity.score(docs, lexicon), langid.identify(docs, profiles)):
        assert found.columns[:4] == docs.columns and [(r["doc_id"], r["a.b"]) for r in found.orderBy("doc_id").collect()] == [(k, k) for k in range(40)]


def test_quality_without_positives(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    model = quality.fit(docs.limit(0), docs)
    assert {r.score for r in quality.score(docs, model).collect()} == {0.5}


def test_quality_of_empty_tables_repeated_rows_null_ids_and_clashing_columns(spark):
    rows = [(k, ". ".join(prose(10 * k + j, 12) for j in range(4)) + ".", "a") for k in range(60)] + [(None, " | ".join(prose(k, 30).split()), "b") for k in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, Score string")
    model = quality.fit(df.where("doc_id < 30"), df)
    twice = quality.score(df.unionByName(df), model, ["doc_id", "text"]).collect()
    assert len(twice) == 180 and len({(r.text, r.score) for r in twice}) == 90 and set(twice[0].asDict()) == {"doc_id", "text", "score"}
    assert quality.score(df.limit(0), model).count() == 0
    none = quality.fit(df.limit(0), df.limit(0))
    assert quality.score(df, none).select("score").distinct().count() == 1


def test_quality_scores_against_the_formula(spark):
    """Scores of whole texts of all lengths, from the model's own numbers and each text's own features."""
    texts = [". ".join(prose(10 * k + j, 12) for j in range(4)) for k in range(50)] + [" | ".join(prose(k, 30).split()) for k in range(50)] + ["", None, "x" * 200_000, "a\nb\n" * 9000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    model = quality.fit(df.where("doc_id < 25"), df)
    got = {r.doc_id: r.score for r in quality.score(df, model).collect()}
    for k, text in enumerate(texts):
        x = np.clip((quality.features(pa.array([text], pa.string()))[0] - model.mean) / model.scale, -6, 6)
        z = float(x.astype(float) @ model.weights.astype(float) + model.bias)
        assert got[k] == pytest.approx(1 / (1 + math.exp(-min(max(z, -60), 60))), abs=2e-4)


def test_non_negative_risk_does_not_run_away():
    import numpy as np

    r = np.random.default_rng(0)
    p, n = r.normal(1.5, 1, (400, 5)), r.normal(-1.5, 1, (400, 5))
    u = np.concatenate([r.normal(1.5, 1, (600, 5)), r.normal(-1.5, 1, (200, 5))])
    w, b = quality.minimise(p, u, 0.75)
    assert ((p @ w + b) > 0).mean() > 0.9 and ((n @ w + b) < 0).mean() > 0.9
    assert 0.55 < quality.estimate_prior(p @ w + b, u @ w + b) < 0.9
