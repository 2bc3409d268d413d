"""Toxicity, the hidden Markov model and language identification: held-out quality, exact sums, odd rows."""

import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from corpus_data import SCHEMA, frame, prose, rows
from pyspark.sql import functions as F

from allocora.llm import hmm, langid, toxicity

INSULTS = ["blarghed", "snorvik", "quazzle", "drimpet"]


def labelled(count, seed):
    draw = random.Random(seed)
    out = []
    for i in range(count):
        words = prose(draw, draw.randint(20, 60)).split(" ")
        toxic = i % 4 == 0
        if toxic:
            for _ in range(draw.randint(1, 2)):
                words.insert(draw.randrange(len(words)), draw.choice(INSULTS))
        out.append((i, " ".join(words), toxic))
    return out


@pytest.fixture(scope="module")
def machine():
    return toxicity.fit([(toxic, toxicity.fragments(text)) for _, text, toxic in labelled(800, 3)])


def worst(machine, text):
    return max(machine.decide(sorted(toxicity.fragments(text))), default=machine.floor)


def test_held_out_texts_are_told_apart(machine):
    texts = labelled(400, 4)
    predicted = machine.probability(np.array([worst(machine, t) for _, t, _ in texts])) >= toxicity.THRESHOLD
    toxic = np.array([t for *_, t in texts])
    assert predicted[toxic].mean() > 0.97
    assert predicted[~toxic].mean() < 0.02


@pytest.mark.parametrize("disguised", ["SNORVIK", "s.n.o.r.v.i.k", "s n o r v i k", "snorvik!!!", "qu4zzle", "(drimpet)", "so-snorvik"])
def test_disguised_insults_score_high(machine, disguised):
    assert machine.probability(worst(machine, f"gorda lemnu {disguised} hurasu jois")) >= toxicity.THRESHOLD


def test_inserted_letter_is_stepped_over(machine):
    assert worst(machine, "blarxghed") > worst(machine, "gordalem") + 0.5


def test_only_copies_are_dropped():
    draw = random.Random(7)
    texts = [{"the", "and", *(prose(draw, 30).lower().split())} for _ in range(300)]
    near = [t - {sorted(t)[0]} | {"other"} for t in texts[:40]]
    far = [set(sorted(t)[: len(t) // 2]) | {f"new{i}" for i in range(10)} for t in texts[40:80]]
    mixed = [*texts, *texts[:20], *near, *far, set(), set()]
    alike = lambda a, b: a == b or len(a & b) >= toxicity.ALIKE * len(a | b)
    kept = []
    for t in mixed:
        if not any(alike(t, k) for k in kept):
            kept.append(t)
    assert toxicity._different(mixed) == kept
    assert len(kept) >= len(texts) + len(far)


def test_every_different_text_counts_for_a_witness():
    draw = random.Random(8)
    up = [{"the", "and", "of", *draw.sample(range(400), 20)} for _ in range(300)]
    up = [{str(w) for w in t} | ({"snorvik"} if i % 30 == 0 else set()) for i, t in enumerate(up)]
    down = [{"the", "and", "of", *map(str, draw.sample(range(400), 20))} for _ in range(2000)]
    counts = Counter(w for t in down for w in t)
    assert toxicity.witnesses(up, counts, len(down)) == ["snorvik"]
    assert toxicity.witnesses(up[:1] * 500, counts, len(down)) == []


def test_rare_words_are_no_witnesses_by_chance():
    draw = random.Random(9)
    texts = [{f"w{draw.randrange(40_000)}" for _ in range(60)} for _ in range(2400)]
    counts = Counter(w for t in texts[300:] for w in t)
    up = Counter(w for t in texts[:300] for w in t)
    assert sum(c >= toxicity.SUPPORT and w not in counts for w, c in up.items()) > 15
    assert len(toxicity.witnesses(texts[:300], counts, 2100)) <= 5


def test_kernel_of_unit_vectors():
    marks = toxicity.Landmarks(["idiot", "moron", "banana"])
    kernel = marks.kernel(["idiot", "idixot", "xyz", "banana", ""])
    assert np.allclose([kernel[0, 0], kernel[3, 2]], 1, atol=1e-5)
    assert 0.2 < kernel[1, 0] < 1 and kernel[2].max() < 0.2 and (kernel[4] == 0).all()

    def subsequences(word):
        codes = toxicity._codes(word)
        out = Counter()
        for i, j, k in itertools.combinations(range(len(codes)), 3):
            if k - i < toxicity.SPAN:
                out[codes[i], codes[j], codes[k]] += toxicity.DECAY ** (k - i - 2)
        return out

    a, b = subsequences("idixot"), subsequences("idiot")
    norm = lambda x: math.sqrt(sum(v * v for v in x.values()))
    assert kernel[1, 0] == pytest.approx(sum(a[s] * b[s] for s in a) / norm(a) / norm(b), abs=1e-5)


def test_pruned_decisions_are_exact(machine):
    words = sorted({w for _, t, _ in labelled(30, 9) for w in toxicity.fragments(t)} | set(INSULTS) | {"", "…", "a" * 300 + "snorvik"})
    full = []
    for word in words:
        codes, _ = toxicity._windows([word])
        values = []
        for c in codes:
            ids, weights = toxicity._features(np.array([c], np.int32))
            if ids.shape[1] and (ids > 0).any():
                values.append(float((machine.weights[ids] @ weights)[0] / toxicity._norms(ids, weights)[0] + machine.bias))
        full.append(max([machine.floor, *values]))
    assert np.allclose(machine.decide(words), full, atol=1e-4)
    assert full[words.index("a" * 300 + "snorvik")] > machine.floor


def test_without_labels_there_is_one_score():
    model = toxicity.fit([(False, {"a"}), (False, {"b"})])
    assert model.probability(model.decide(["a", "zzz"])) == pytest.approx([0.25, 0.25], abs=0.01)
    assert 0 <= toxicity.fit([]).probability(np.array([-1.0]))[0] <= 1


def test_toxicity_in_spark(spark):
    texts = labelled(300, 5)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t, _ in texts] + [(None, None, None, None, None), (900, "", None, None, 0)], SCHEMA)
    labels = spark.createDataFrame([(i, 1, int(t)) for i, _, t in texts] + [(None, None, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.trained(docs, labels)
    swapped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.trained(docs, swapped)
    assert (again.weights == model.weights).all() and (again.shares == model.shares).all()
    scored = {r["doc_id"]: r["toxicity"] for r in toxicity.with_score(docs, model).collect()}
    assert all(0 <= s <= 1 for s in scored.values())
    assert scored[None] == scored[900]
    held = [(scored[i] >= 0.7, t) for i, _, t in texts if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(p == t for p, t in held) / len(held) > 0.95
    kept = toxicity.without_toxic(docs, model)
    assert kept.columns == docs.columns
    assert kept.count() == sum(s < 0.7 for s in scored.values())
    empty = spark.createDataFrame([], SCHEMA)
    assert toxicity.with_score(empty, toxicity.trained(empty, labels)).count() == 0


def small_model(seed=1):
    draw = np.random.default_rng(seed)
    return hmm.Model(draw.dirichlet(np.ones(hmm.STATES)), draw.dirichlet(np.ones(hmm.STATES), hmm.STATES), draw.dirichlet(np.ones(hmm.CLASSES), hmm.STATES))


def paths(sequence, model):
    """Probability of every way through the states."""
    out = {}
    for path in itertools.product(range(hmm.STATES), repeat=len(sequence)):
        p = model.start[path[0]] * model.emit[path[0], sequence[0]]
        for a, b, c in zip(path, path[1:], sequence[1:], strict=False):
            p *= model.step[a, b] * model.emit[b, c]
        out[path] = p
    return out


def test_forward_and_backward_equal_all_paths():
    model = small_model()
    sequences = [[3], [5, 3, 5], [1, 2000, 7, 1]]
    lengths = np.array([len(s) for s in sequences])
    flat = np.array([c for s in sequences for c in s], np.uint16)
    every = [paths(s, model) for s in sequences]
    assert hmm.log10_likelihood(flat, lengths, model) == pytest.approx([math.log10(sum(p.values())) for p in every])
    starts, steps, emissions = np.zeros(hmm.STATES), np.zeros((hmm.STATES, hmm.STATES)), np.zeros((hmm.CLASSES, hmm.STATES))
    for sequence, ways in zip(sequences, every, strict=True):
        total = sum(ways.values())
        for path, p in ways.items():
            starts[path[0]] += p / total
            for a, b in itertools.pairwise(path):
                steps[a, b] += p / total
            for state, c in zip(path, sequence, strict=True):
                emissions[c, state] += p / total
    found = hmm.expected_counts(flat, lengths, np.ones(3, bool), model)
    for got, expected in zip(found, (starts, steps, emissions), strict=True):
        assert np.allclose(got, expected, atol=1e-4)


def test_baum_welch_raises_the_likelihood():
    draw = np.random.default_rng(2)
    sequences = [np.concatenate([draw.integers(0, 20, 30) + 40 * (k % 2), [hmm.END]]).astype(np.uint16) for k in range(40)]
    cut = hmm._cut(sequences)
    model, scores = hmm._started(), []
    for _ in range(6):
        scores.append(hmm.log10_likelihood(cut[0], cut[1], model).sum())
        model = hmm.estimated(*hmm.expected_counts(*cut, model))
    assert scores == sorted(scores)
    assert np.allclose(model.emit.sum(axis=1), 1) and np.allclose(model.step.sum(axis=1), 1)


def test_hmm_scores(spark, monkeypatch):
    monkeypatch.setattr(hmm, "BLOCK_TOKENS", 900)
    data = rows(80)
    found = hmm.score(frame(spark, data)).collect()
    assert len(found) == len(data)
    lower = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    counts = Counter()
    for i, text, *_ in data:
        if not held(i):
            counts.update([*lower(text), None])
    total, kinds = sum(counts.values()), len(counts)
    expected = sorted(
        (
            -1 if i is None else i,
            held(i),
            len(lower(t)) + 1,
            sum(counts[w] > 0 for w in [*lower(t), None]),
            total,
            round(sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in [*lower(t), None]), 6),
        )
        for i, t, *_ in data
    )
    got = sorted((-1 if r[0] is None else r[0], r[1], r[2], r[3], r[4], round(r[5], 6)) for r in found)
    assert got == expected
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in found)
    held_out = [r for r in found if r["held_out"] and r["n_tokens"] > 5]
    assert sum(r["score"] for r in held_out) > sum(r["base_score"] for r in held_out)
    assert hmm.score(spark.createDataFrame([], SCHEMA)).count() == 0


def test_hmm_counts_meet_in_buckets(spark, monkeypatch):
    """Blocks exchange slices of their word lists, not a row per word; totals come back to the right words."""
    tables, write = {}, hmm.written
    monkeypatch.setattr(hmm, "written", lambda df, label: tables.setdefault(label, write(df, label)))
    monkeypatch.setattr(hmm, "BLOCK_TOKENS", 1500)
    draw = random.Random(5)
    data = [(i, " ".join(f"w{int(draw.paretovariate(0.4)) % 5000}" for _ in range(200)), "", "", 0) for i in range(60)]
    data += [(60, None, "", "", 0), (61, "", "", "", 0), (61, "w1 w1 onlyhere", "", "", 0), (None, "W1 w2", "", "", 0)]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    counts = Counter(w for i, t, *_ in data if not held(i) for w in [*(t or "").lower().split(), None])
    known = sorted((-1 if i is None else i, sum(counts[w] > 0 for w in [*(t or "").lower().split(), None])) for i, t, *_ in data)
    for bucket_words in (400_000, 300):
        monkeypatch.setattr(hmm, "BUCKET_WORDS", bucket_words, raising=False)
        tables.clear()
        found = hmm.score(spark.createDataFrame(data, SCHEMA)).collect()
        assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_known"]) for r in found) == known
        blocks, rows_of_counts = tables["hmm_blocks"].count(), tables["hmm_counts"].count()
        entries = tables["hmm_blocks"].select(F.sum(F.octet_length("shapes") / 2)).first()[0]
        buckets = int(entries) // bucket_words + 1
        assert blocks > 4 and entries > 2000
        assert rows_of_counts <= (blocks + 1) * buckets


def test_order_of_words_matters(spark):
    draw = random.Random(1)
    words = [[f"a{k}" for k in range(30)], [f"b{k}" for k in range(30)]]
    texts = [" ".join(draw.choice(words[i % 2]) for _ in range(40)) for i in range(200)]
    mixed = " ".join(itertools.chain.from_iterable(zip(texts[0].split(), texts[1].split(), strict=True)))
    in_turn = " ".join([*texts[0].split(), *texts[1].split()])
    docs = spark.createDataFrame([(i, t, "", "", 0) for i, t in enumerate([*texts, mixed, in_turn])], SCHEMA)
    score = {r["doc_id"]: r["score"] for r in hmm.score(docs).collect()}
    assert score[201] > score[200] + 1


def test_language_of_pages(spark):
    draw = random.Random(8)
    words = {"en": "the of and thing ion wha sher".split(), "de": "der und ein schaft keit lich ung".split()}
    text = lambda lang, n: " ".join(draw.choice(words[lang]) + draw.choice(words[lang]) for _ in range(n))
    docs = spark.createDataFrame([(i, text(lang, 80), lang, "s", 0) for i, lang in enumerate(["en", "de"] * 40)] + [(500, None, "fr", None, 0), (501, "x", None, None, 0)], SCHEMA)
    page = lambda lang, n: f'<html lang="{lang}"><script>der der der</script><body><p>{text(lang, n)}</p></body></html>'
    pages = [(i, f"http://www.{lang}site.example/{lang}/{i}", page(lang, 60)) for i, lang in enumerate(["en", "de", "de"] * 20)]
    odd = [
        (100, "http://www.desite.example/1", "<html><body>xq</body></html>"),
        (101, "http://www.ensite.example/", None),
        (102, None, page("en", 60)),
        (103, "http://www.ensite.example/en/", '<html lang="en">' + text("de", 60) + "</html>"),
        (104, None, None),
        (None, "not an address", ""),
    ]
    made = spark.createDataFrame(pages + odd, "page_id long, url string, html string").withColumns({c: F.lit("x") for c in ("language", "host", "p0", "l0")})
    found = {r["page_id"]: r for r in langid.identify(made, docs).collect()}
    assert len(found) == len(pages) + len(odd)
    assert all(found[i]["language"] == lang for i, lang in enumerate(["en", "de", "de"] * 20))
    assert found[100]["language"] == "de" and found[101]["language"] == "en" and found[102]["language"] == "en"
    assert found[103]["text_language"] == "de" and found[103]["declared"] == "en"
    assert found[104]["language"] in ("de", "en") and found[104]["host"] is None
    assert all(0 < r["probability"] <= 1 for r in found.values())
    assert langid.identify(made.limit(0), docs).count() == 0
    assert {r["language"] for r in langid.identify(made, docs.limit(0)).collect()} == {None}


def fused_by_hand(pages, docs):
    """Language and probability of each page, one at a time from the definitions."""
    languages = sorted({lang for lang, _ in docs})
    shares = []
    for lang in languages:
        counts = np.full(langid.BUCKETS, langid.SMOOTHING)
        for other, text in docs:
            if other == lang:
                np.add.at(counts, langid.trigrams(text), 1)
        shares.append(np.log(counts / counts.sum()).astype(np.float32).astype(np.float64))
    likes, says, groups = [], [], []
    for _, url, page in pages:
        found = langid.trigrams(langid.visible_text(page))
        weight = langid.TEMPER * min(len(found), langid.MOST_TRIGRAMS)
        likes.append(np.array([share[found].mean() * weight if len(found) else 0.0 for share in shares]))
        odds = np.exp(likes[-1] - likes[-1].max())
        says.append(odds / odds.sum())
        host, domain, suffix, path = langid.address_parts(url)
        declared = re.search(r'<html lang="(..)"', page or "")
        groups.append((suffix, domain, host, declared and declared[1], path))
    whole = sum(says)
    out = {}
    for i, (page_id, *_) in enumerate(pages):
        own = [sum((says[j] for j in range(len(pages)) if j != i and groups[j][level] == groups[i][level]), np.zeros(len(languages))) for level in range(5)]
        prior = (whole + langid.SMOOTHING) / (whole.sum() + langid.SMOOTHING * len(languages))
        for level in range(3):
            prior = (own[level] + langid.BORROWED * prior) / (own[level].sum() + langid.BORROWED)
        total = np.log(prior) + likes[i]
        for level in (3, 4):
            if groups[i][level] is not None:
                total += np.log((own[level] + langid.SMOOTHING) / (whole + langid.SMOOTHING * (len(languages) + 1)))
        odds = np.exp(total - total.max())
        out[page_id] = languages[int(total.argmax())], (odds / odds.sum()).max()
    return out


def test_languages_equal_a_fusion_by_hand(spark):
    draw = random.Random(10)
    words = {lang: ["".join(draw.choice(letters) for _ in range(draw.randint(2, 6))) for _ in range(40)] for lang, letters in (("de", "aeinrstu"), ("en", "aehinost"), ("fr", "aeilnrsu"))}
    docs = [(lang, " ".join(draw.choices(words[lang], k=draw.randint(5, 60)))) for lang in words for _ in range(12)]
    pages = []
    for i in range(160):
        lang = draw.choice(list(words))
        body = " ".join(draw.choices(words[lang], k=draw.choice([0, 1, 2, 3, 400])))
        declared = draw.choice(["", f' lang="{lang}"', f' lang="{draw.choice(list(words))}"'])
        host = draw.choice([f"{lang}{i % 4}.site{i % 3}.{lang}", f"www.site{i % 3}.com", "a.b.com"])
        url = draw.choice([f"http://{host}/{lang}/{i}", f"http://{host}/{i}", None])
        pages.append((i, url, f"<html{declared}><p>{body}</p></html>" if i % 20 else None))
    made = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(5)
    found = {r["page_id"]: (r["language"], r["probability"]) for r in langid.identify(made, spark.createDataFrame(docs, "lang string, text string")).collect()}
    expected = fused_by_hand(pages, docs)
    assert {i: lang for i, (lang, _) in found.items()} == {i: lang for i, (lang, _) in expected.items()}
    assert all(abs(found[i][1] - expected[i][1]) < 1e-9 for i in expected)
    assert len(set(found.values())) > 100


@pytest.mark.parametrize(
    ("url", "parts"),
    [
        ("https://m.a.example.net:80/en/1?x=1", ("m.a.example.net", "example.net", "net", "en")),
        ("http://EXAMPLE.de", ("example.de", "example.de", "de", None)),
        ("http://user@h.fr/longer/", ("h.fr", "h.fr", "fr", None)),
        ("nothing", (None, None, None, None)),
        (None, (None, None, None, None)),
    ],
)
def test_address_parts(url, parts):
    assert langid.address_parts(url) == parts


def test_few_different_letters_apart_are_put_together():
    assert "boob" in toxicity.fragments("such b o o b again")
    assert "aaaa" in toxicity.fragments("a a a a")
    assert toxicity.fragments("not a b here") == {"not", "a", "b", "here"}


def test_windows_overlap_by_half():
    word = "x" * 30 + "snorvikgorda" + "y" * 40
    codes, _ = toxicity._windows([word])
    inner = toxicity._codes("snorvikgorda")[1:-1]
    for shift in range(60):
        codes, _ = toxicity._windows(["x" * shift + "snorvikgorda" + "y" * 70])
        assert any(c[i : i + len(inner)] == inner for c in codes for i in range(len(c)))
    assert len(toxicity._windows(["x" * 43])[0]) == 1
