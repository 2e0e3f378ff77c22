import random

import pytest

from corpusgate.llm import leakage, mixing

WORDS = [f"w{i}" for i in range(40)]


def brute(docs, items, n):
    runs = lambda t: {tuple(w[i : i + n]) for w in [leakage.words_of(t or "")] for i in range(len(w) - n + 1)}
    return sorted({(d, i) for d, t in docs if d is not None for i, x in items if runs(t) & runs(x)})


def test_leaks_equal_brute_force(spark):
    rnd = random.Random(3)
    text = lambda k: " ".join(rnd.choice(WORDS[:12]) for _ in range(k))
    items = [(i, "s", text(30)) for i in range(12)] + [(90, "s", "too short"), (91, "s", None)]
    docs = [(i, text(60) + " " + rnd.choice(items[:12])[2].upper().replace(" ", ", ")[:200]) for i in range(40)] + [(100, None), (101, ""), (102, "   "), (None, items[0][2])]
    docs.append(docs[0])
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, suite string, item_text string")
    assert sorted(map(tuple, leakage.leaked_items(d, i, 8).collect())) == brute(docs, [(a, c) for a, _, c in items], 8)
    # Blocks of few words give the same rows.
    assert sorted(map(tuple, leakage.leaked_items(d, i, 8, block_words=60).collect())) == brute(docs, [(a, c) for a, _, c in items], 8)
    assert leakage.leaked_items(d.limit(0), i).count() == 0 and leakage.leaked_items(d, i.limit(0)).count() == 0


def test_items_are_cut_into_blocks_that_the_alphabet_can_tell_apart(spark, monkeypatch):
    items = spark.createDataFrame([(1, "a b c d"), (2, "e f g"), (3, "h"), (4, None), (None, "i j")], "item_id long, item_text string")
    assert [[i for i, _ in b] for b in leakage.item_blocks(items, 4)] == [[1], [2, 3]] and leakage.BLOCK_WORDS <= leakage.LETTERS
    monkeypatch.setattr(leakage, "LETTERS", 3)
    with pytest.raises(ValueError, match="item 1 has more than 3 distinct words"):
        list(leakage.item_blocks(items, 4))


def test_spans_map_to_the_original_text(spark):
    passage = "one Two_three, FOUR five-six seven"
    p = leakage.Passages([(1, "zero one two three four five six seven eight")], 5)
    text = f"İ intro: {passage}! end"
    (span,) = p.spans_in(text)
    assert span[0] == 1 and text[span[1] : span[2]] == passage and span[3] == 7
    assert p.spans_in("one two three four") == [] and leakage.Passages([], 5).items_in("a b") == set()


@pytest.mark.parametrize("seed", range(4))
def test_stretches_equal_brute_force(seed):
    rnd = random.Random(seed)
    n = rnd.randint(2, 9)
    items = [(i, " ".join(rnd.choice(WORDS[:4]) for _ in range(rnd.randint(0, 25)))) for i in range(8)]
    p = leakage.Passages(items, n)
    for _ in range(30):
        words = [rnd.choice(WORDS[:5]) for _ in range(rnd.randint(0, 40))]
        text = " ".join(words)
        want = []
        for i, t in items:
            held = {tuple(t.split()[k : k + n]) for k in range(len(t.split()) - n + 1)}
            starts = [k for k in range(len(words) - n + 1) if tuple(words[k : k + n]) in held]
            for k in starts:
                if k - 1 not in starts:
                    last = k
                    while last + 1 in starts:
                        last += 1
                    at = lambda j: len(" ".join(words[:j])) + (j > 0)
                    want.append((i, at(k), at(last + n - 1) + len(words[last + n - 1]), last + n - k))
        assert p.spans_in(text) == sorted(want)
        assert p.items_in(text) == {w[0] for w in want}


def test_water_filling():
    got = {s.source: s.tokens for s in mixing.water_fill([("a", 0.5, 1, 100), ("b", 0.25, 2, 1000), ("c", 0.25, 1, 10_000), ("none", 0.1, 5, 0)], 1000)}
    assert got["a"] == 100 and got["none"] == 0 and got["b"] == pytest.approx(450) and got["c"] == pytest.approx(450)
    assert sum(s.tokens for s in mixing.water_fill([("a", 0.5, 1, 10), ("b", 0.5, 3, 10)], 1000)) == 40
    assert mixing.water_fill([], 10) == [] and mixing.largest_exact_total([]) == 0
    wanted = [("a", 0.6, 2, 100), ("b", 0.3, 1, 1000), ("z", 0.1, 1, 0)]
    total = mixing.largest_exact_total(wanted)
    assert total == pytest.approx(300) and {s.source: round(s.tokens) for s in mixing.water_fill(wanted, total)} == {"a": 200, "b": 100, "z": 0}


def test_mix_respects_caps_and_amounts(spark):
    rnd = random.Random(1)
    counted = [(i, rnd.choice(["a"] * 5 + ["b", None, "unlisted"]), rnd.randint(0, 9)) for i in range(3000)]
    df = spark.createDataFrame(counted, "doc_id long, source string, n_tokens long")
    have = {s: sum(n for _, x, n in counted if x == s) for s in ("a", "b")}
    shares = mixing.water_fill([("a", 0.5, 1, have["a"]), ("b", 0.5, 3, have["b"])], have["b"] * 5)
    rows = mixing.mix(df, shares, seed=7).collect()
    caps, used = {"a": 1, "b": 3}, {}
    assert len({r.doc_id for r in rows}) == len(rows)
    for r in rows:
        assert 1 <= r.copies <= caps[r.source] and r.n_tokens > 0
        used[r.source] = used.get(r.source, 0) + r.copies * r.n_tokens
    for s in shares:
        assert s.tokens - 10 < used[s.source] <= s.tokens + 1e-6
    again = mixing.mix(df.repartition(7), shares, seed=7).collect()
    assert {(r.doc_id, r.copies) for r in again} == {(r.doc_id, r.copies) for r in rows}
    # Finer ranges, of which few documents are ranked, pick the same ones.
    fine = mixing.mix(df, shares, seed=7, ranked=2).collect()
    assert {(r.doc_id, r.copies) for r in fine} == {(r.doc_id, r.copies) for r in rows}
    assert mixing.mix(df, [], 1).count() == 0


def test_token_counts(spark):
    docs = spark.createDataFrame([(1, "a", "hello world"), (2, "a", None), (3, None, ""), (4, "b", "x " * 5000)], "doc_id long, source string, text string")
    got = {r.doc_id: r.n_tokens for r in mixing.token_counts(docs).collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] > 4000


def test_mix_of_an_empty_corpus(spark):
    docs = spark.createDataFrame([], "doc_id long, source string, text string")
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    assert mixing.mixed_documents(docs, targets).count() == 0
    assert mixing.mix_report(docs, targets).first().actual_share == 0.0


def test_reached_shares_are_the_planned_ones(spark, sf):
    from corpusgate.session import read_table

    docs, targets = read_table(spark, sf, "documents"), read_table(spark, sf, "mix_targets")
    for total in (None, "exact"):
        rows = mixing.mix_report(docs, targets, total).collect()
        all_ = sum(r.used_tokens for r in rows)
        longest = 2000
        assert all_ > 0 and all(abs(r.share_gap) * all_ <= longest * len(rows) for r in rows)
        assert all(r.most_copies <= r.max_repeats for r in rows)
        if total == "exact":
            there = sum(r.target_share for r in rows if r.available_tokens)
            assert all(abs(r.actual_share - r.target_share / there) * all_ <= longest * len(rows) for r in rows if r.available_tokens)
