"""Problems 8 to 10 on small texts: brute force, guarantees, nulls, repeats, very long and empty texts."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.llm import leakage, packing, queries, textstats

WORDS = [f"{a}{b}" for a in ("ba", "co", "du", "fe", "gi") for b in ("lor", "mip", "nat", "sek")]


# --- 8


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 300), max_size=25))
def test_plan_places_every_item_within_capacity(histogram):
    sizes, demand = np.array(sorted(histogram), np.int64), np.array([histogram[s] for s in sorted(histogram)], np.int64)
    placed = np.zeros(len(sizes), np.int64)
    for c in packing.plan(sizes, demand, 40):
        assert c.copies > 0 and (c.amounts > 0).all() and int((sizes[c.classes] * c.amounts).sum()) <= 40
        placed[c.classes] += c.copies * c.amounts
    assert (placed == demand).all()


def test_plan_solves_the_program_over_many_lengths():
    sizes = np.arange(1, 601)
    demand, shares = np.full(600, 20), {}
    bound, configs = float(sizes @ demand) / 2000, packing.plan(sizes, demand, 2000, shares)
    covered = np.zeros(600)
    for a, times in packing.cover(packing.Knapsack(sizes, 2000), demand, []):
        covered += times * a / demand
    assert covered == pytest.approx(np.ones(600))
    assert shares["value"] < 1.005 * bound and shares["lp"] > 0.7 * sizes @ demand
    assert sum(c.copies for c in configs) < 1.01 * bound


def first_fit(sizes, demand, units):
    """Containers that first-fit needs, longest items first."""
    room = []
    for s, n in sorted(zip(sizes.tolist(), demand.tolist(), strict=True), reverse=True):
        for _ in range(n):
            k = next((k for k, r in enumerate(room) if r >= s), None)
            if k is None:
                room.append(units - s)
            else:
                room[k] -= s
    return len(room)


def test_program_beats_first_fit_where_lengths_are_awkward():
    e = 10  # over a half, a little over and under a quarter: full containers exist, first-fit does not find them
    sizes, demand, shares = np.array([1000 - 2 * e, 1000 + e, 1000 + 2 * e, 2000 + e]), np.array([120, 60, 60, 60]), {}
    used = sum(c.copies for c in packing.plan(sizes, demand, 4000, shares))
    assert first_fit(sizes, demand, 4000) == 110 and used <= 92 and shares["lp"] / (sizes @ demand) > 0.9
    assert shares["bound"] <= 90.001 and shares["value"] < 91


@pytest.mark.parametrize("parts", [2, 3, 4])
def test_bound_counts_items_just_over_a_part(parts):
    sizes, demand, shares = np.array([1200 // parts + 1]), np.array([300]), {}
    used = sum(c.copies for c in packing.plan(sizes, demand, 1200, shares))
    assert used == -(-300 // (parts - 1)) and shares["bound"] == pytest.approx(300 / (parts - 1), rel=1e-4)


@settings(max_examples=30, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 60), min_size=1, max_size=8))
def test_bound_is_below_what_is_used(histogram):
    sizes, demand, shares = np.array(sorted(histogram), np.int64), np.array([histogram[s] for s in sorted(histogram)], np.int64), {}
    used = sum(c.copies for c in packing.plan(sizes, demand, 40, shares))
    assert shares["bound"] <= used + 1e-6 and shares["bound"] <= shares["value"] * 1.0001


def test_knapsack_is_optimal():
    rng = random.Random(0)
    for _ in range(30):
        sizes = np.array(sorted(rng.sample(range(1, 12), 5)))
        values, limit = np.array([rng.random() for _ in sizes]), np.array([rng.randrange(4) for _ in sizes])
        a = packing.Knapsack(sizes, 20).best(values, limit)
        assert (a <= limit).all() and (a * sizes).sum() <= 20
        best = max(sum(v * x for v, x in zip(values, combo, strict=True)) for combo in np.ndindex(*(limit + 1)) if (np.array(combo) * sizes).sum() <= 20)
        assert float((a * values).sum()) == pytest.approx(best, rel=1e-5)


def check_packing(items, placed, capacities):
    by_kind = defaultdict(lambda: defaultdict(list))
    for r in placed:
        by_kind[r.container_kind][r.container_id].append(r)
    for kind, capacity in capacities.items():
        empty = by_kind[kind].pop(None, [])
        assert sorted(r.item for r in empty) == sorted(i for i, s in items if not s)
        assert all(sum(r.size for r in rows) <= capacity for rows in by_kind[kind].values())
        assert sorted(by_kind[kind]) == list(range(len(by_kind[kind])))
        pieces = Counter((r.item, r.piece, r.size) for rows in by_kind[kind].values() for r in rows)
        want = Counter()
        for item, size in items:
            for k in range(-(-(size or 0) // capacity)):
                want[item, k, min(capacity, size - k * capacity)] += 1
        assert pieces == want


def test_pack_small_tables_with_nulls_repeats_and_giants(spark):
    rng = random.Random(1)
    items = [(k, rng.choice([None, 0, 1, 3, 3, 3, 9, 10, 11, 57, 5000])) for k in range(300)] + [(7, 3)] * 40
    df = spark.createDataFrame([(a, b, 1, 2) for a, b in items], "item long, size long, piece int, salt int")
    capacities = {"small": 10, "odd": 4097, "one": 1}
    check_packing(items, packing.pack(df, capacities).collect(), capacities)
    assert packing.pack(df.limit(0), capacities).count() == 0 and packing.pack(df, {}).count() == 0
    with pytest.raises(ValueError):
        packing.pack(df, {"none": 0})


def test_too_many_kinds_of_containers_are_an_error(spark, tmp_path):
    spark.range(101).selectExpr("cast(id as string) AS container_kind", "id + 1 AS capacity_tokens").write.parquet(f"{tmp_path}/containers.parquet")
    with pytest.raises(ValueError):
        queries.p8_packing(spark, str(tmp_path))


def test_hot_lengths_are_ranked_in_salted_groups(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_ITEMS", 20)
    items = [(k, 3) for k in range(500)] + [(k, 4) for k in range(500, 560)]
    check_packing(items, packing.pack(spark.createDataFrame(items, "item long, size long"), {"c": 10}).collect(), {"c": 10})


def test_packing_leaves_little_space(spark):
    rng = random.Random(2)
    items = [(k, max(1, int(rng.lognormvariate(5, 0.9)))) for k in range(4000)]
    placed = packing.pack(spark.createDataFrame(items, "item long, size long"), {"c": 512})
    used = placed.select("container_id").distinct().count()
    assert sum(s for _, s in items) / (used * 512) > 0.98


@pytest.mark.parametrize("file", ["byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_tokenizers_count(file):
    public = pytest.importorskip("public_tokenizers")
    count = packing.load_tokenizer(public.path(file))
    sizes = count(["", "hello world", "<|endoftext|> is text", "é" * 1000])
    assert sizes[0] == 0 and 2 <= sizes[1] <= 4 and sizes[2] > 1 and sizes[3] > 100


def test_both_forms_of_a_vocabulary_agree():
    public = pytest.importorskip("public_tokenizers")
    texts = ["The warm barrel opened.\n\nÜber uns: 42 %", "a  b\tc", "日本語 text"]
    assert packing.load_tokenizer(public.path("byte_bpe_50k.tiktoken"))(texts) == packing.load_tokenizer(public.path("byte_bpe_50k.json"))(texts)


# --- 9


def brute_leaks(docs, items):
    out = set()
    for d, text in docs:
        w = leakage.words(text)
        for i, t in items:
            v = leakage.words(t)
            n = min(leakage.SPAN_WORDS, len(v))
            grams = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if v else set()
            if any(tuple(w[k : k + n]) in grams for k in range(len(w) - n + 1)):
                out.add((d, i))
    return out


def test_words_ignore_case_accents_and_invisible_characters():
    assert leakage.words("Él co­mpró​, STRASSE_x ½ 日本") == leakage.words("el COMPRO strasse x ½ 日本".replace("½", "1 2")) or leakage.words("Él co­mpró​") == ["el", "compro"]
    assert leakage.words("él straße") == ["el", "strasse"] == leakage.words("ÉL STRASSE")
    assert leakage.words(None) == [] == leakage.words(" \n-–!")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60), st.integers(1, 12), st.data())
def test_winnowing_never_misses_a_shared_span(a, span, data):
    h = np.array(a, np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    start = data.draw(st.integers(0, max(0, len(a) - span)))
    shared = h[start : start + span]
    other = np.concatenate([np.array(data.draw(st.lists(st.integers(10, 13), max_size=8)), np.uint64), shared, np.array(data.draw(st.lists(st.integers(10, 13), max_size=8)), np.uint64)])
    if len(shared) == span:
        assert set(leakage.winnow(h, span)[1].tolist()) & set(leakage.winnow(other, span)[1].tolist())


def test_leaks_match_brute_force(spark):
    rng = random.Random(3)
    items = [(k, " ".join(rng.choice(WORDS) for _ in range(rng.choice([1, 2, 3, 5, 8, 11, 12, 13, 40])))) for k in range(40)] + [(100, None), (101, "--"), (102, "")]
    items += [(103, items[8][1]), (104, "shared opening line of words " + items[9][1])]
    docs = [(0, None), (1, ""), (2, "x" * 100_000)]
    for k in range(3, 160):
        w = [rng.choice(WORDS[:12]) for _ in range(rng.randrange(0, 90))]
        _, t = rng.choice(items)
        v = (t or "").split()
        if v:
            a = rng.randrange(len(v))
            cut = v[a : a + rng.choice([3, 11, 12, 13, 40])]
            at = rng.randrange(len(w) + 1)
            w[at:at] = [x.upper() if rng.random() < 0.3 else x[:1] + "­" + x[1:] for x in cut]
        docs.append((k, rng.choice([" ", ", ", "\n"]).join(w)))
    docs += [docs[10], docs[11]]
    d = spark.createDataFrame([(*x, 1, "w") for x in docs], "doc_id long, text string, item_id int, words string")
    i = spark.createDataFrame(items, "item_id long, text string")
    got = leakage.leaks(d, "doc_id", "text", i, "item_id", "text")
    assert Counter((r.doc_id, r.item_id) for r in got.collect()) == Counter(brute_leaks(docs, items))
    assert leakage.leaks(d.limit(0), "doc_id", "text", i, "item_id", "text").count() == 0
    assert leakage.leaks(d, "doc_id", "text", i.limit(0), "item_id", "text").count() == 0


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    items = [(k, " ".join(WORDS[(k + j) % 20] for j in range(14))) for k in range(9)]
    docs = spark.createDataFrame([(k, items[k][1]) for k in range(9)], "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, text string")
    whole = {tuple(r) for r in leakage.leaks(docs, "doc_id", "text", i, "item_id", "text").collect()}
    monkeypatch.setattr(leakage, "BLOCK_WORDS", 30)
    assert {tuple(r) for r in leakage.leaks(docs, "doc_id", "text", i, "item_id", "text").collect()} == whole


def test_project_tables_match_brute_force(spark, tiny):
    docs = [tuple(r) for r in spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{tiny}/eval_items.parquet").select("item_id", "text").collect()]
    grams = defaultdict(set)
    for i, t in items:
        v = leakage.words(t)
        n = min(12, len(v))
        for k in range(len(v) - n + 1):
            grams[tuple(v[k : k + n])].add(i)
    want = set()
    for d, t in docs:
        w = leakage.words(t)
        for n in {len(g) for g in grams}:
            for k in range(len(w) - n + 1):
                want |= {(d, i) for i in grams.get(tuple(w[k : k + n]), ())}
    assert {tuple(r) for r in queries.p9_found(spark, tiny).collect()} == want


# --- 10


def page(rng, kind):
    the = lambda: rng.choice(["the", "a", "this", "our", "every"])
    noun = lambda: rng.choice(WORDS) + rng.choice(["", "an", "ir", "ol", "un"]) + rng.choice(["", "d", "s", "t", "k"])
    more = lambda words: " ".join(words() for _ in range(rng.randrange(3)))

    def sentence():
        parts = [the().capitalize(), more(noun), noun(), rng.choice(["saw", "took", "sold"]), the(), noun(), more(lambda: f"{rng.choice(['with', 'in', 'on'])} {the()} {noun()}"), rng.choice(["", f"and {the()} {noun()}"]), rng.choice(["", "", f"{rng.randrange(90)} times"])]
        return " ".join(x for x in parts if x) + rng.choice([".", ".", "!", ", they said."])

    body = {
        "prose": lambda: "".join(sentence() + rng.choice(["\n", " ", " "]) for _ in range(rng.randrange(3, 12))),
        "wrapped": lambda: " ".join(sentence() for _ in range(9)).replace(" in ", "\n"),
        "list": lambda: "\n".join(noun() for _ in range(rng.randrange(12, 30))),
        "table": lambda: "\n".join(f"{noun()};{rng.randrange(9999)};{rng.randrange(99)}" for _ in range(15)),
        "junk": lambda: "\n".join("".join(rng.choice("+*#=<>{}|~") for _ in range(60)) for _ in range(8)),
        "salad": lambda: " ".join(noun() for _ in range(60)) + ".",
    }[kind]()
    return f"Home\nContact\nImprint\nWe use cookies on this page. Accept all or leave it.\nA title of the page\n{body}\n© 2020 example"


def test_prose_is_told_from_the_rest(spark):
    rng = random.Random(4)
    kinds = ["prose"] * 12 + ["wrapped"] * 2 + ["list", "table", "junk", "salad"]
    pages = [(k, kind := rng.choice(kinds), page(rng, kind), "EN ", 1, 2) for k in range(600)]
    pages += [(1000, "none", None, "en", 1, 2), (1001, "none", " \n", None, 1, 2), (1002, "prose", "Home\nContact\nWe use cookies on this page. Accept all or leave it.", "xx", 1, 2)]
    pages += [pages[0]]
    hosts = lambda k: None if k % 10 == 0 else f"h{k % 7}"
    docs = spark.createDataFrame([(a, c, d, hosts(a), e, f) for a, _, c, d, e, f in pages], "doc_id long, text string, lang string, source string, n int, distance int").repartition(5)
    common = spark.createDataFrame([("en", w) for w in "the a this our every with in on and".split()] + [("de", "und"), (None, "x"), ("de", None)], "lang string, word string")
    q = textstats.quality(docs, "doc_id", "text", "lang", "source", common)
    got = [(r.id, r.prose) for r in q.collect()]
    assert len(got) == len(pages)
    kind_of = {p[0]: p[1] for p in pages}
    assert [kind_of[k] for k, prose in got if prose and kind_of[k] not in ("prose", "wrapped")] == []
    assert len([k for k, prose in got if not prose and kind_of[k] in ("prose", "wrapped")]) <= 5
    parts = q.where("distance is not null").select((sum((F.col(f"d_{s}") for s in textstats.STATISTICS), F.lit(0.0)) - F.col("distance")).alias("d"))
    assert parts.where("abs(d) > 1e-6").count() == 0


def test_quality_without_prose_or_documents(spark):
    common = spark.createDataFrame([("en", "the")], "lang string, word string")
    docs = spark.createDataFrame([(1, "the one page here", "en", None), (2, None, "en", "h")], "doc_id long, text string, lang string, host string")
    assert {r.id: r.prose for r in textstats.quality(docs, "doc_id", "text", "lang", "host", common).collect()} == {1: True, 2: False}
    assert textstats.quality(docs.limit(0), "doc_id", "text", "lang", "host", common).count() == 0
    assert textstats.quality(docs, "doc_id", "text", "lang", "host", common.limit(0)).count() == 2


def test_furniture_is_counted_per_content_and_host(spark):
    rng = random.Random(6)
    body = lambda: " ".join(rng.choice(WORDS) + rng.choice("abcdefgh") for _ in range(30)) + "."
    copied = "Alpha\nBeta\nGamma\n" + "a longer line that the copies share " * 4
    pages = [("small", f"Own menu\nOdd {k}\n{body()}") for k in range(10)] + [("big", f"Odd {k}\nCommon\n{body()}") for k in range(100, 400)]
    pages += [(f"mirror{k % 40}", copied) for k in range(200)] + [(None, "Own menu"), (None, None), ("big", "")]
    everywhere, per_host = textstats.furniture(spark.createDataFrame(pages, "h string, t string"), "t", "h")
    hosted = {r.host: set(r.furniture) for r in per_host.collect()}
    h = textstats.entry_hash
    assert everywhere == {h("Own menu"), h("Common")} and hosted == {"small": {h("Own menu")}, "big": {h("Common")}}
    assert textstats.furniture(spark.createDataFrame([], "h string, t string"), "t", "h")[0] == set()


def test_chi_square_and_consistency():
    assert textstats.chi_square_quantile(0.95, 1) == pytest.approx(3.8415, abs=1e-3) and textstats.chi_square_quantile(0.99, 7) == pytest.approx(18.4753, abs=1e-3)
    x = np.random.default_rng(0).normal(size=(200_000, 3))
    d = (x * x).sum(axis=1)
    core = x[d <= np.quantile(d, 0.8)]
    assert np.diag(np.cov(core.T)) * textstats.consistency(0.8, 3) == pytest.approx(np.ones(3), abs=0.02)


def test_fitted_prose_has_the_covariance_of_its_data(spark):
    """Statistics that hang together do so in the estimate, and outliers do not widen it."""
    rng = random.Random(7)
    rows = []
    for k in range(3000):
        words, far = rng.randrange(40, 400), k % 25 == 0
        alpha = int(words * (1 - min(0.5, abs(rng.gauss(0.02, 0.01)))))
        ratio = rng.gauss(0.4, 0.03)
        rows.append(("en", words, alpha, int(alpha * (5 + 10 * (ratio - 0.4) + rng.gauss(0, 0.05))), int(words * 0.2), words * 6, max(1, words // 12), max(1, words // 13), 0 if far else int(alpha * ratio), "en"))
    measured = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"id long, label string, {textstats.MEASURES}")
    fit = textstats.fit_prose(measured, ["en"])["en"]
    cov = np.linalg.inv(fit.inverse)
    m = {c: np.array([r[k + 1] for r in rows if r[8]], float) for k, c in enumerate(textstats._COUNTS)}
    plain = np.cov(textstats.statistics(m, fit.typical).T)
    k, j = textstats.STATISTICS.index("word_length"), textstats.STATISTICS.index("common_words")
    assert cov[k, j] / np.sqrt(cov[k, k] * cov[j, j]) > 0.8
    assert (np.diag(cov)[[k, j]] / np.diag(plain)[[k, j]]).tolist() == pytest.approx([1, 1], rel=0.2)


def test_entry_hash_is_sparks(spark):
    texts = ["", "a", "Über uns", "x" * 500, "日本"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(F.xxhash64("t"))
    assert [r[0] for r in df.collect()] == [textstats.entry_hash(t) for t in texts]


def test_spoiled_text_is_repaired():
    assert textstats.repaired("SpÃ¤te KÃ¼che für â€œuns") == "Späte Küche für “uns"
    assert textstats.repaired("Ã©© Ã") == "Ã©© Ã" or "©" in textstats.repaired("Ã©© Ã")


def test_statistics_of_one_text():
    r = textstats.Reader(set(), {"the": ("en",), "and": ("en",)})
    m = dict(zip(textstats._NAMES, r.measure("A title\nThe cat, and 12 dogs. Ran!\n- no"), strict=True))
    assert (m["n"], m["alpha"], m["letters"], m["lines"], m["ended"], m["hits"], m["found"]) == (7, 6, 18, 2, 1, 2, "en")


def test_plain_statistics_of_odd_texts(spark):
    texts = [None, "", " \n\t ", "Hello, world!\n\nno end\nYes.)", "日本語 123 _x_", "x" * 200_000]
    df = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "i long, t string, word_count int")
    got = {r.id: tuple(r)[1:] for r in textstats.plain_statistics(df, "i", "t").collect()}
    assert got[0] == got[1] == got[2] == (0, None, None, None)
    assert got[3] == (5, pytest.approx(18 / 5), pytest.approx(4 / 22), pytest.approx(2 / 3))
    assert got[4][:2] == (3, pytest.approx(7 / 3)) and got[5][:3] == (1, 200_000.0, 0.0)
    assert textstats.plain_statistics(df.limit(0), "i", "t").count() == 0
